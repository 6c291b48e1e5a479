"""Sharding: best-fit-decreasing bin packing of indivisible groups, planned on a size histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_in, join_hot, small_batches, stage

#: Sizes up to EXACT are classes of their own; above, a class spans 1/1024 of its size. So there are at most 65,536 + 47 * 1,024 classes.
EXACT, FINE = 65_536, 10


class Tree:
    """A treap of (remaining capacity, first bin) -> number of alike bins; ``ceiling`` finds the tightest that fits."""

    def __init__(self) -> None:
        self.root = None

    @staticmethod
    def _priority(key) -> int:
        return hash((key, 0x9E3779B9)) & 0xFFFFFFFF

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[2] > b[2]:
            a[4] = self._merge(a[4], b)
            return a
        b[3] = self._merge(a, b[3])
        return b

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[4], right = self._split(node[4], key)
            return node, right
        left, node[3] = self._split(node[3], key)
        return left, node

    def add(self, key, value) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, value, self._priority(key), None, None]), right)

    def remove(self, key) -> None:
        left, rest = self._split(self.root, key)
        _, right = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(left, right)

    def ceiling(self, least: int):
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= least:
                best, node = node, node[3]
            else:
                node = node[4]
        return best and (best[0], best[1])

    def largest(self):
        node = self.root
        while node is not None and node[4] is not None:
            node = node[4]
        return node and (node[0], node[1])


def plan(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over (size, count) classes.

    Returns runs (class index, first rank, count, first bin, items a bin): the items of a run go to successive bins. Alike
    bins are one entry of the tree, so the work follows the number of classes, not of items. Without ``bins`` new bins are
    opened as needed; with it, an item that fits nowhere goes to the emptiest bin. An item above ``capacity`` has a bin of
    its own (in the fixed case the emptiest).
    """
    tree, opened, runs = Tree(), 0, []
    if bins:
        tree.add((capacity, 0), bins)
        opened = bins
    for k, (size, count) in sorted(enumerate(sizes), key=lambda x: -x[1][0]):
        rank = 0
        while count:
            found = tree.ceiling(size) if size else tree.largest()
            if found is None and bins is None:
                many = max(1, -(-count // max(1, capacity // max(size, 1))))
                tree.add((max(capacity, size), opened), many)
                opened += many
                continue
            over = found is None
            (rest, first), alike = found or tree.largest()
            tree.remove((rest, first))
            each = 1 if over else min(count, rest // size if size else count)
            full = 1 if over else min(alike, count // each)
            runs.append((k, rank, each * full, first, each))
            tree.add((rest - each * size, first), full)
            if alike > full:
                tree.add((rest, first + full), alike - full)
            rank, count = rank + each * full, count - each * full
    return runs


def even_capacity(sizes: list[tuple[int, int]], bins: int) -> int:
    """What each bin holds if the items above the mean have bins of their own and the rest is shared out evenly."""
    total, left = sum(s * n for s, n in sizes), bins
    for size, count in sorted(sizes, reverse=True):
        for _ in range(count):
            if left <= 1 or size * left <= total:
                return -(-total // left)
            total, left = total - size, left - 1
    return -(-total // max(left, 1))


def size_class(size):
    """The class of a group's size: exact up to EXACT, then by its leading FINE bits after the first."""
    shift = F.greatest(F.floor(F.log2(size.cast("double"))).cast("int") - FINE, F.lit(0))
    return F.when(size <= EXACT, size).otherwise(F.call_function("shiftleft", F.expr("0L") + F.floor(size / F.pow(F.lit(2.0), shift)).cast("long"), shift))


def pack_groups(groups: DataFrame, size_col: str, key_cols: list[str], bins: int | None, capacity: int | None, out: str) -> DataFrame:
    """Add ``out``, the bin of each row of ``groups`` (unique by ``key_cols``)."""
    spark = groups.sparkSession
    classed = groups.withColumn("_cls", size_class(F.col(size_col)))
    seen = sorted((r["_cls"], r["n"], -(-r["s"] // r["n"])) for r in classed.groupBy("_cls").agg(F.count(F.lit(1)).alias("n"), F.sum(size_col).alias("s")).collect())
    sizes = [(s, n) for _, n, s in seen]
    runs = plan(sizes, capacity or even_capacity(sizes, bins or 1), bins)
    at = sorted((k, rank, first, each) for k, rank, _, first, each in runs)
    ids = {c: k for k, (c, _, _) in enumerate(seen)}
    start = spark.sparkContext.broadcast((np.array([k * 2**44 + r for k, r, _, _ in at], dtype=np.int64), np.array(at, dtype=np.int64).reshape(-1, 4), np.array(sorted(ids), dtype=np.int64)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins, table, classes = start.value
        for rows in batches:
            rank = rows["_place"].to_numpy(np.int64)
            k = np.searchsorted(classes, rows["_cls"].to_numpy(np.int64))
            run = table[np.searchsorted(begins, k * 2**44 + rank, side="right") - 1]
            rows[out] = run[:, 2] + (rank - run[:, 1]) // run[:, 3]
            yield rows.drop(columns=["_cls", "_place"])

    ranked = dense_rank_in(classed, ["_cls"], key_cols, "_place")
    schema = ", ".join(f"`{c}` {t}" for c, t in groups.dtypes) + f", `{out}` long"
    return ranked.select(*groups.columns, "_cls", "_place").mapInPandas(place, schema)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row in one of ``shards`` shards of nearly equal bytes; rows with equal texts are never parted.

    A row's size is the UTF-8 bytes of its text plus 1; a null text has none and belongs with the empty texts. Groups of
    equal texts enter by size, largest first, the shard with the least room that still holds them; the capacity is the even
    share. A group above the even share fills a shard alone and the others share the rest. The driver sees the histogram
    of size classes only (its length is bounded); groups, ranks and slots are computed by all tasks. Groups above 64 KB
    count as the mean of their class, within 0.1 %.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (0, 1, ... in each shard), grown_shard (null). Repeated
    rows are placed each; null ids are allowed. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 10_000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = stage(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group")), "sized")
    groups = stage(one.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "groups")
    placed = stage(pack_groups(groups, "_bytes", ["_group"], shards, None, "_shard").select("_group", "_shard", "_rows"), "placed")
    rows = dense_rank_in(join_hot(one, placed, ["_group"], "_rows", ["doc_id"]), ["_shard"], ["doc_id", "_group"], "slot", max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
