import math
import random

from octavo.operators import rangecoder as rc


def calls_of(rng, n):
    made = []
    for _ in range(n):
        kind = rng.choice(["symbol", "bit", "bits", "uniform", "laplace"])
        if kind == "symbol":
            total = rng.randint(2, 4000)
            low = rng.randrange(total)
            made.append((kind, low, rng.randint(low + 1, total), total))
        elif kind == "bit":
            made.append((kind, int(rng.random() < 0.2), rng.randint(1, 8), 0))
        elif kind == "bits":
            n_bits = rng.randint(0, 12)
            made.append((kind, rng.randrange(1 << n_bits), n_bits, 0))
        elif kind == "uniform":
            total = rng.choice([2, 255, 256, 257, 1000, 70000, 1 << 31])
            made.append((kind, rng.randrange(total), total, 0))
        else:
            made.append((kind, rng.randint(-6, 6), rng.randint(3000, 15000), rng.randint(1000, 11000)))
    return made


def read(packet, calls):
    d = rc.Decoder(packet)
    for kind, a, b, c in calls:
        if kind == "symbol":
            assert a <= d.place(c) < b
            d.take(a, b, c)
        elif kind == "laplace":
            assert d.laplace(b, c) == a
        else:
            assert getattr(d, kind)(b) == a


def test_calls_are_read_back():
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 50, 300):
        for _ in range(20):
            calls = calls_of(rng, n)
            e = rc.replay(calls)
            packet = e.packet()
            read(packet, calls)
            read(e.packet(len(packet) + 7), calls)
            # used() is the code's size from above, and the packet takes two bytes more at most (its two ends).
            assert len(packet) * 8 <= e.used() + 16


def test_size_is_the_entropy():
    rng = random.Random(2)
    calls = [("symbol", 0, 900, 1000) if rng.random() < 0.9 else ("symbol", 900, 1000, 1000) for _ in range(5000)]
    need = sum(-math.log2((b - a) / c) for _, a, b, c in calls)
    assert abs(8 * len(rc.replay(calls).packet()) - need) < 0.001 * need + 24


def test_known_codes():
    # Certain symbols cost nothing; one even bit is one bit of the first byte: below half it is 0, else 1.
    assert rc.Encoder().used() == 1 and rc.Encoder().packet() == b""
    one = rc.Encoder()
    one.bit(1, 1)
    zero = rc.Encoder()
    zero.bit(0, 1)
    assert one.packet() == b"\x80" and zero.packet() in (b"", b"\x00")
    raw = rc.Encoder()
    raw.bits(5, 3)
    raw.bits(1, 6)
    assert raw.packet()[-2:] == bytes([0, 0b1101])


def test_laplace_intervals_fill_the_total():
    for first, decay in ((3000, 11456), (15000, 1000), (32700, 0), (72 * 128, 127 * 64)):
        found = rc.laplace_intervals(first, decay, rc.TOTAL)
        spans = sorted(found.values())
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) == rc.TOTAL
    e = rc.Encoder()
    most = max(rc.laplace_intervals(3000, 9000, rc.TOTAL))
    assert e.laplace(10**5, 3000, 9000) == most


def test_packets_of_rows(spark):
    rng = random.Random(3)
    rows = [(i, calls_of(rng, 20)) for i in range(30)] + [(98, []), (99, None)]
    schema = rc.T.StructType([rc.T.StructField("id", rc.T.LongType()), rc.T.StructField("calls", rc.CALL)])
    for r in rc.packets(spark.createDataFrame(rows, schema), "id", "calls").collect():
        calls = dict(rows)[r.id] or []
        assert r.used == rc.replay(calls).used()
        read(bytes(r.packet), calls)
