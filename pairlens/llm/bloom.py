"""A broadcast Bloom filter of bounded size, built by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

U = K.U
FILTER_BITS = 22  # of one part
GROUP = 1_000_000  # hashes that one call takes


class Filter:
    """A Bloom filter of 64-bit hashes, 12 bits for each, or all of ``most_mb`` if that is less.

    With more hashes than 12 bits each it answers yes more often, by as many probes as suit the bits that each has; the joins that
    follow every use do the rest. With ``most_mb`` 0 there is no filter: ``may_hold`` lets everything through. A part is
    built in groups of some ``GROUP`` hashes at most, whatever their number is.
    """

    def __init__(self, keys: DataFrame, column: str, most_mb: int) -> None:
        number = keys.count()
        self.parts = parts = max(1, min(number * 12, most_mb << 23) >> FILTER_BITS)
        self.probes = probes = max(1, min(4, int(0.7 * (parts << FILTER_BITS) / max(1, number))))
        self.bits: np.ndarray | None = None
        if number and not most_mb:
            return

        def build(table: pa.Table) -> pa.Table:
            bits = np.zeros(1 << FILTER_BITS, bool)
            h = table.column("h").to_numpy().view(U)
            for j in range(probes):
                bits[_probe(h, j)] = True
            return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        self.bits = np.zeros(parts << (FILTER_BITS - 3), np.uint8)
        groups = -(-number // (parts * GROUP)) or 1
        dealt = keys.select(F.col(column).alias("h"), F.pmod(column, F.lit(parts)).cast("int").alias("part"), F.pmod(F.xxhash64(column), F.lit(groups)).cast("int").alias("group"))
        for r in dealt.groupBy("part", "group").applyInArrow(build, "part int, bits binary").toLocalIterator():
            self.bits[r["part"] << (FILTER_BITS - 3) :][: 1 << (FILTER_BITS - 3)] |= np.frombuffer(r["bits"], np.uint8)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        of = np.mod(K.signed(h), self.parts).astype(np.int64) << FILTER_BITS
        keep = np.ones(len(h), bool)
        for j in range(self.probes):
            pos = of | _probe(h, j).astype(np.int64)
            keep &= (self.bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1
        return keep


def _probe(h: np.ndarray, j: int) -> np.ndarray:
    return K.mix(h + U(j)) & U((1 << FILTER_BITS) - 1)
