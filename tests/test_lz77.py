import random
import tracemalloc

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from octavo.functions import bits
from octavo.operators import lz77


def plain(data, lazy, depth):
    """The rule a byte at a time: chains of equal three bytes, nearest first, then the parse."""
    last, chain = {}, []
    for i in range(len(data)):
        key = data[i : i + 3] if i + 3 <= len(data) else None
        chain.append(last.get(key, -1) if key else -1)
        last[key] = i

    def best(i):
        most, length, offset, at, left = min(258, len(data) - i), 2, 0, chain[i], depth
        while at >= 0 and i - at <= 32768 and left:
            n = next((k for k in range(most) if data[at + k] != data[i + k]), most)
            if n > length:
                length, offset = n, i - at
                if n >= 64 or n == most:
                    break
            at, left = chain[at], left - 1
        return (length, offset) if length > 3 or 0 < offset <= 4096 else (0, 0)

    made, start, i = [], 0, 0
    while i < len(data):
        length, offset = best(i)
        if length and lazy and length < 64 and i + 1 < len(data):
            n, far = best(i + 1)
            if n and 4 * (n - length) + offset.bit_length() - far.bit_length() > 2:
                length = 0
        if not length:
            i += 1
            continue
        made.append((i - start, length, offset))
        i += length
        start = i
    return made + [(len(data) - start, 0, 0)] * (start < len(data))


def contents(rng):
    head = rng.randbytes(200)
    yield from (b"", b"a", b"aaa", b"aaaa", b"abc" * 400, bytes(2000), rng.randbytes(2000), head + rng.randbytes(4000) + head[:3] + b"x" + head + rng.randbytes(32700) + head * 2)
    for _ in range(40):
        k = rng.choice([1, 2, 3, 5, 20])
        yield bytes(rng.randrange(k) for _ in range(rng.randrange(900)))


def test_steps_of_many_chunks_are_those_of_the_plain_search():
    rng = random.Random(1)
    data = list(contents(rng))
    for lazy, depth in ((True, 16), (False, 16), (True, 1), (False, 128)):
        assert [lz77.steps(x, lazy, depth) for x in data] == [plain(x, lazy, depth) for x in data]
    rng.shuffle(data)
    got = pa.concat_arrays(lz77.parsed.func(iter([pa.array([*data, None], pa.binary()), pa.array([], pa.binary())])))
    assert got.to_pylist() == [[dict(zip(lz77.NAMES, s, strict=True)) for s in plain(x, True, 16)] for x in data] + [None]


def test_a_batch_is_parsed_and_replayed_in_slices():
    rng = random.Random(2)
    words = [bytes(rng.choices(b"abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    batch = pa.array([b" ".join(rng.choices(words, k=350)) for _ in range(1000)], pa.binary())
    tracemalloc.start()
    most = 0
    for made in lz77.parsed.func(iter([batch])):
        most = max(most, len(made))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 and peak < 56e6  # a dictionary a step took 72 MB for these 2.3 MB, and in proportion to a batch
    made = pa.concat_arrays(lz77.parsed.func(iter([batch])))
    back = list(lz77.replayed.func(iter([(batch, made)])))
    assert len(back) > 4 and pa.concat_arrays(back) == batch


def test_replay_uses_the_literals_alone():
    made = pa.array([[{"literals": 2, "length": 5, "offset": 2}, {"literals": 1, "length": 0, "offset": 0}], None, []], pa.list_(pa.struct([(n, pa.int32()) for n in lz77.NAMES])))
    data = pa.array([b"ab?????c", b"x", b""], pa.binary())
    assert pa.concat_arrays(lz77.replayed.func(iter([(data, made)]))).to_pylist() == [b"abababac", None, b""]
    assert pa.concat_arrays(lz77.replayed.func(iter([(data.take(pa.array([None, 0])), made.take(pa.array([0, 0])))]))).to_pylist() == [None, b"abababac"]
    with pytest.raises(ValueError):
        list(lz77.replayed.func(iter([(pa.array([b"abc", b"ab"]), pa.array([[(3, 0, 0)], [(1, 1, 2)]], made.type))])))
    with pytest.raises(ValueError):
        list(lz77.replayed.func(iter([(pa.array([b"abc"]), pa.array([[(2, 0, 0)]], made.type))])))


def test_replays_of_null_empty_and_long_texts(spark, tmp_path):
    text = "the cat and the hat " * 9000
    spark.createDataFrame([(1, None), (2, ""), (3, "ab"), (4, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.size, r.same) for r in entry.queries()["lz77_replays"](spark, str(tmp_path)).collect()}
    assert got == {1: (None, True), 2: (0, True), 3: (2, True), 4: (180000, True)}


def test_counts_leave_a_batch_summed(spark, sf):
    """One row a length and batch, and the query's slots are those of the steps."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame([(x.encode(),) for x in [*texts, "", "abc" * 90]] + [(None,)], "bytes binary").coalesce(1)
    rows = lz77.match_counts(df, "bytes").collect()
    assert len(rows) == len({r.length for r in rows}) <= lz77.LONGEST - lz77.SHORTEST + 1
    want = {}
    for x in [*texts, "", "abc" * 90]:
        for literals, length, _ in lz77.steps(x.encode()):
            n = want.setdefault(length, [0, 0])
            want[length] = [n[0] + 1, n[1] + literals]
    want.pop(0)
    assert {r.length: [r.matches, r.literals] for r in rows} == want
    slots, got = [s for s in bits.length_slots()], {r.slot: (r.matches, r.bytes, r.literals) for r in entry.queries()["lz77_statistics"](spark, sf).collect()}
    for slot, base, _ in slots:
        some = [s for x in texts for s in lz77.steps(x.encode()) if s[1] and max(k for k, b, _ in slots if b <= s[1]) == slot]
        assert base and got.get(slot, (0, 0, 0)) == (len(some), sum(s[1] for s in some), sum(s[0] for s in some))
