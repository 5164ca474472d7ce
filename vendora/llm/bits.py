"""Sets of 64-bit keys as bitmaps of a fixed greatest size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 26                  # log2 of the bits: 8 MB


def bitmap(keys: DataFrame, column: str, most: int = MOST) -> np.ndarray:
    """Bits set at the low ``most`` bits of each key; built in the tasks, so what
    reaches the driver is at most 2**most bits however many keys there are."""
    at = F.col(column).bitwiseAND((1 << most) - 1) + 1          # Spark's buckets count from one
    rows = (keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow())
    out = np.zeros(1 << (most - 3), np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        b = np.frombuffer(bits, np.uint8)
        lo = (bucket - 1) * len(b)
        out[lo:lo + len(b)] = b[:len(out) - lo]
    return out


def hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the set (all that are, and a few that aren't)."""
    at = keys.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def may_hold(df: DataFrame, ident, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``ident`` may be among the keys (a long column): all that are,
    few others.  Put before a join, it spares the shuffle the rest."""
    import pyarrow as pa
    bits = df.sparkSession.sparkContext.broadcast(bitmap(keys, column))

    def run(batches):
        for batch in batches:
            keep = hits(bits.value, np.asarray(batch.column(0)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[1:]], names=batch.schema.names[1:])
    return df.select(ident.alias("__ident"), *df.columns).mapInArrow(run, df.schema)


def runs_of_many(key: str, member: str, names: list, odd: str | None = None):
    """Batches of a partition sorted by ``key`` in; the rows whose key stands with
    two different members or more out, and those whose ``odd`` is odd.  Holds one run
    at a time."""
    import pyarrow as pa

    def run(batches):
        rest = None

        def whole(x):
            k = x[key]
            first = np.append(True, k[1:] != k[:-1])
            start = np.flatnonzero(first)
            many = np.maximum.reduceat(x[member], start) != np.minimum.reduceat(x[member], start)
            keep = many[np.cumsum(first) - 1]
            if odd:
                keep |= x[odd] & 1 == 1
            return pa.RecordBatch.from_arrays([pa.array(x[c][keep]) for c in names], names=names)

        for batch in batches:
            x = {c: np.asarray(batch.column(batch.schema.get_field_index(c))) for c in names}
            if rest is not None:
                x = {c: np.concatenate([rest[c], x[c]]) for c in names}
            if not len(x[key]):
                continue
            other = np.flatnonzero(x[key] != x[key][-1])
            last = int(other[-1]) + 1 if len(other) else 0      # the last run may go on in the next batch
            rest = {c: x[c][last:] for c in names}
            if last:
                yield whole({c: x[c][:last] for c in names})
        if rest is not None and len(rest[key]):
            yield whole(rest)
    return run
