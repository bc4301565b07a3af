"""A Bloom filter of keys, built by the executors and broadcast under a fixed size bound."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = 64
#: 256 MiB: 12 bits a key up to 180 million keys; at a thousand million still 2 bits and two thirds of the absent keys proven so.
MAX_BITS = 2**31
BITS_PER_KEY = 12
MOST_PROBES = 5


def probes(bits_per_key: float) -> int:
    """How many bits a key sets: the number with the fewest false positives, from 1 to MOST_PROBES."""
    return max(1, min(MOST_PROBES, round(bits_per_key * math.log(2))))


def _bits(h: np.ndarray, width: int, times: int) -> Iterator[np.ndarray]:
    """``times`` bit positions below ``width`` (a power of two) for each 64-bit hash."""
    u = h.astype(np.uint64)
    a, b = u >> np.uint64(8), (u >> np.uint64(35)) | np.uint64(1)
    for i in range(times):
        yield ((a + np.uint64(i) * b) & np.uint64(width - 1)).astype(np.int64)


def _segment(h: np.ndarray) -> np.ndarray:
    return (h.astype(np.uint64) & np.uint64(SEGMENTS - 1)).astype(np.int64)


class BloomFilter:
    """Membership test on 64-bit hashes: False proves absence.

    At most MAX_BITS bits whatever the number of keys, which bounds what is collected and
    broadcast; beyond BITS_PER_KEY a key sets fewer bits and more keys pass, which the exact join sorts out.
    """

    def __init__(self, segments: dict[int, bytes], width: int, times: int = MOST_PROBES):
        self.width, self.times = width, times
        blank = bytes(width // 8)
        self.bits = np.frombuffer(b"".join(segments.get(i, blank) for i in range(SEGMENTS)), dtype=np.uint8)

    @classmethod
    def build(cls, keys: DataFrame, hash_col: str, expected: int) -> "BloomFilter":
        width = 1024
        while width * SEGMENTS < min(MAX_BITS, BITS_PER_KEY * max(1, expected)):
            width *= 2
        times = probes(width * SEGMENTS / max(1, expected))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False)
                seg = _segment(h)
                for s in np.unique(seg):
                    own, bits = h[seg == s], held.setdefault(int(s), np.zeros(width, dtype=bool))
                    for at in _bits(own, width, times):
                        bits[at] = True
            if held:
                packed = [np.packbits(b, bitorder="little").tobytes() for b in held.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], names=["segment", "bits"])

        h = F.col(hash_col)
        once = keys.where(h.isNotNull()).select(h.alias("h"), h.bitwiseAND(F.lit(SEGMENTS - 1)).alias("s")).distinct()
        built = once.repartition(SEGMENTS // 4, "s").select("h").mapInArrow(run, "segment int, bits binary").collect()
        return cls({r["segment"]: bytes(r["bits"]) for r in built}, width, times)

    def might_contain(self, h: np.ndarray) -> np.ndarray:
        base, found = _segment(h) * self.width, np.ones(len(h), dtype=bool)
        for at in _bits(h, self.width, self.times):
            at = base + at
            found &= (self.bits[at >> 3] >> (at & 7)) & 1 == 1
        return found

    def column(self, df: DataFrame, hash_col: Column) -> Column:
        """A boolean column: might the hash be among the keys?"""
        shared = df.sparkSession.sparkContext.broadcast((self.bits.tobytes(), self.width, self.times))

        @F.pandas_udf("boolean")
        def probe(h: pd.Series) -> pd.Series:
            bits, width, times = shared.value
            it = BloomFilter.__new__(BloomFilter)
            it.bits, it.width, it.times = np.frombuffer(bits, dtype=np.uint8), width, times
            return pd.Series(it.might_contain(h.to_numpy(dtype=np.int64)))

        return probe(hash_col)
