import pytest
from octavo.operators import ogg
from octavo.plans import catalog


def test_long_packets_go_over_pages():
    for n in (0, 254, 255, 65_024, 65_025, 65_026, 130_050, 200_000):
        packet = bytes(i % 251 for i in range(n))
        pages = ogg.long_packet(packet, 7, 3, 960)
        assert len(pages) == (n // 255 + 255) // 255
        got = ogg.parse(b"".join(pages))
        assert [x for p in got for x in p[3]] == [packet] and [p[1] for p in got] == list(range(3, 3 + len(pages)))
        if len(pages) > 1:
            with pytest.raises(ValueError):
                ogg.parse(b"".join(pages[:-1]))
            with pytest.raises(ValueError):
                ogg.parse(b"".join(pages[1:]))


def test_query_takes_whole_turns(spark, tmp_path):
    rows = [(1, 0, "a" * 3000), (1, 1, "é" * 70_000), (1, 2, None), (1, 3, "x" * 65_025), (1, 4, "end"), (2, 0, "b" * 2001)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(map(tuple, catalog.QUERIES["ogg_round_trip"](spark, str(tmp_path)).collect())) == [(1, 5, True), (2, 1, True)]
