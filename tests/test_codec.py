import random
from itertools import groupby, product

import numpy as np
import pytest
from octavo.functions import codec
from octavo.operators import bitstream
from pyspark.sql import functions as F


def brute_bits(fields, low_first):
    bits = "".join(format(v, f"0{w}b")[:: -1 if low_first else 1] for v, w in fields if w)
    return bits


def test_packing_of_bits():
    rng = random.Random(1)
    for _ in range(200):
        fields = [(rng.randrange(1 << w) if w else 0, w) for w in (rng.randint(0, 17) for _ in range(rng.randint(0, 40)))]
        v, w = np.array([f[0] for f in fields], np.int64), np.array([f[1] for f in fields], np.int64)
        low, high = brute_bits(fields, True), brute_bits(fields, False)
        assert bitstream.pack(v, w) == bytes(int(low[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(low), 8))
        assert bitstream.pack(v, w, False, True) == b"".join(bytes([x]) + b"\0" * (x == 255) for x in (int(high[i : i + 8].ljust(8, "1"), 2) for i in range(0, len(high), 8)))
        # Appended streams are the stream of all fields.
        k = len(fields) // 2
        both = np.concatenate([bitstream.bits_of(v[:k], w[:k], True), bitstream.bits_of(v[k:], w[k:], True)])
        assert np.packbits(both, bitorder="little").tobytes() == bitstream.pack(v, w)


def test_pulse_indexes_count_all_vectors():
    for n, k in ((2, 3), (3, 4), (4, 2), (5, 1)):
        found = {bitstream.pulse_index(list(y)) for y in product(range(-k, k + 1), repeat=n) if sum(map(abs, y)) == k}
        assert found == set(range(bitstream.pulse_counts(n, k)[n][k]))


def test_packets_split_as_merged():
    rng = random.Random(2)
    for _ in range(300):
        same = rng.randint(0, 1275)
        frames = [rng.randbytes(same if rng.random() < 0.5 else rng.randint(0, 1275)) for _ in range(rng.randint(1, 48))]
        assert bitstream.split(bitstream.merge(0x80, frames)) == frames
    padded = bytes([0x83, 0x42, 255, 1]) + b"abcd" + b"\0" * 255
    assert bitstream.split(padded) == [b"ab", b"cd"]
    for bad in (b"", bytes([0x81]) + b"abc", bytes([0x83]), bytes([0x83, 0]), bytes([0x82, 252]), bytes([0x80]) + b"x" * 1276, bytes([0x83, 49])):
        with pytest.raises(ValueError):
            bitstream.split(bad)
    assert [bitstream.frame_samples(c << 3) for c in (0, 3, 12, 13, 16, 19)] == [480, 2880, 480, 960, 120, 960]


def brute_items(run, zero):
    n = len(run)
    found = 0
    while n:
        if zero and n >= 11:
            n -= min(n, 138)
        elif zero and n >= 3 or not zero and found and len(run) >= 4 and n >= 3:
            n -= min(n, 10 if zero else 6)
        else:
            n -= 1
        found += 1
    return found


def test_runs_and_divisors(spark):
    t = spark.range(1, 600).select("id", bitstream.run_items(F.lit(True), F.col("id")).alias("z"), bitstream.run_items(F.lit(False), F.col("id")).alias("o"))
    for r in t.collect():
        run = [len(list(g)) for _, g in groupby([0] * r.id)][0]
        assert (r.z, r.o) == (brute_items([0] * run, True), brute_items([1] * run, False)), r
    import math

    rows = [(0, 0), (0, 5), (-12, 18), (12586269025, 20365011074), (2**62, 6), (None, 3)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", codec.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.g == (None if r.a is None else math.gcd(r.a, r.b)) for r in got)
