"""Tables too large to broadcast, served to blocks of documents.

A model over a corpus (word counts, context statistics) grows with it, so no
task can hold it.  Documents are hashed into blocks of a fixed text size; each
block asks for the distinct keys it holds, dealt into buckets; a bucket sums the
keys of all blocks and sends each block the values in the order it asked.  What
moves is one number for each block and distinct key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32 << 20           # text bytes of a block


def n_buckets(n_blocks: int) -> int:
    """Buckets of keys, so that a bucket's keys from all blocks stay about as many as a block's."""
    return min(max(32, n_blocks), 1 << 16)


def in_blocks(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK) -> tuple[int, DataFrame]:
    """Number of blocks, and (block, key, text) with null texts empty.  Only the number of blocks depends
    on the size of the table."""
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total, rows = src.agg(F.sum(F.octet_length("text").cast("long")), F.count("*")).first()
    # rows count too, else a table of empty texts would be one block
    n = max(1, -(-((total or 0) + 64 * rows) // block_bytes))
    return n, src.select(F.pmod(F.xxhash64(F.col("key").cast("string"), F.xxhash64("text")), F.lit(n)).cast("int").alias("block"), "key", "text")


class Slots:
    """Index of int64 keys: position of each key of a sorted array, for values that are all in it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(10, int(8 * max(len(keys), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        at = self._at(keys)
        self.table[at] = np.arange(len(keys), dtype=np.int32)
        # two keys in a slot: both are looked up by search instead
        clash = self.table[at] != np.arange(len(keys))
        self.table[at[clash]] = -2
        self.any_clash = bool(clash.any())

    def _at(self, values: np.ndarray) -> np.ndarray:
        return (values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, values: np.ndarray) -> np.ndarray:
        out = self.table[self._at(values)]
        if self.any_clash:
            miss = np.flatnonzero(out == -2)
            out[miss] = np.searchsorted(self.keys, values[miss])
        return out


def count_distinct(keys: list, weights: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of (keys, weights) pieces with their summed weights."""
    k = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    w = np.concatenate(weights) if weights else np.zeros(0, np.int64)
    order = np.argsort(k, kind="stable")
    k, w = k[order], w[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(w, first) if len(k) else w
