"""Near-duplicates by HyperMinHash registers, banded, with every link confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, release, small_batches, stage
from .components import components

SHINGLE, PERCENT = 5, 75
#: 128 registers in 32 bands of 4: two sets at Jaccard 0.75 share no band with probability (1 - 0.75^4)^32 = 5e-6.
REGISTERS, BAND, MANTISSA = 128, 4, 10
#: Pairs whose estimate is this many standard deviations below the threshold are not verified (about 1 link in 300,000).
DEVIATIONS = 4.5
#: Members of a bucket, and elements of their sets, that one task compares; larger buckets are compared in pairs of blocks.
BLOCK, BLOCK_ELEMENTS = 2048, 1_000_000
#: Partners that a bucket's smallest is verified with at once: its set moves once for so many.
PARTNERS = 512
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z lower-cased, words parted by ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed((total + each[k : len(words) - n + 1 + k]) * _C1)
    return np.unique(total)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Per bucket of the hashes the smallest value as 6 bits of leading zeros (plus 1) and 10 bits of mantissa; 0: empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        own = _mixed(hashes + _C1)
        keys = np.sort(((own & np.uint64(REGISTERS - 1)) << np.uint64(53)) | (own >> np.uint64(11)))
        bucket = (keys >> np.uint64(53)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        part, length = np.frexp((keys[first] & np.uint64(2**53 - 1)).astype(np.float64))
        mantissa = np.maximum(0, (part * 2 - 1) * 2**MANTISSA).astype(np.int64)
        out[bucket[first]] = ((54 - length.astype(np.int64)) << MANTISSA | mantissa).astype(np.uint16)
    return out


_MEMO: dict = {}


def _donors() -> np.ndarray:
    if "donors" not in _MEMO:
        at = np.arange(REGISTERS * 4096, dtype=np.uint64)
        _MEMO["donors"] = (_mixed(at * _C1 + _C2) % np.uint64(REGISTERS)).astype(np.int64).reshape(REGISTERS, 4096)
    return _MEMO["donors"]


def densified(regs: np.ndarray) -> np.ndarray:
    """Empty registers borrow from full ones in an order that depends on the register only, so that a borrowed one still agrees with the probability of the Jaccard similarity."""
    full = regs > 0
    if full.all() or not full.any():
        return regs
    out, empty, start, width = regs.copy(), np.flatnonzero(~full), 0, 8
    while len(empty) and start < 4096:
        choice = _donors()[empty, start : start + width]
        good = full[choice]
        at, found = good.argmax(1), good.any(1)
        out[empty[found]] = regs[choice[found, at[found]]]
        empty, start, width = empty[~found], start + width, min(width * 4, 2048)
    if len(empty):
        out[empty] = regs[np.flatnonzero(full)[0]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the compressed registers."""
    packed = densified(regs).astype("<u2").view("<u8")  # BAND registers of 16 bits
    return _mixed(packed ^ (np.arange(1, len(packed) + 1, dtype=np.uint64) * _C1)).view(np.int64)


def _chance(a: int, b: int) -> float:
    """The probability that registers of different values agree; a, b: quarters of the log2 of the elements a register has."""
    if (a, b) in _MEMO:
        return _MEMO[a, b]
    la, lb = 2.0 ** (a / 4), 2.0 ** (b / 4)
    zeros = np.arange(0, 40, dtype=np.float64)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(2**MANTISSA) / 2**MANTISSA)
    high = low + 2.0 ** -(zeros + 1) / 2**MANTISSA
    _MEMO[a, b] = float(((np.exp(-la * low) - np.exp(-la * high)) * (np.exp(-lb * low) - np.exp(-lb * high))).sum() / (-np.expm1(-la) * -np.expm1(-lb)))
    return _MEMO[a, b]


def estimate(equal: np.ndarray, union: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from counts of equal and of occupied registers, corrected for agreement by chance."""
    quarters = lambda x: np.clip(np.rint(4 * np.log2(np.maximum(x, 1) / REGISTERS)), -28, 160).astype(int)
    pairs, at = np.unique(np.stack([quarters(n), quarters(m)]), axis=1, return_inverse=True)
    chance = np.array([_chance(int(a), int(b)) for a, b in pairs.T])[at.reshape(-1)] if len(n) else np.empty(0)
    return (equal / np.maximum(union, 1) - chance) / (1 - chance)


def may_link(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether the estimates leave a link possible; left, right: rows of registers."""
    full = (left > 0) | (right > 0)
    union = full.sum(1)
    found = estimate(((left == right) & full).sum(1), union, n, m)
    t = percent / 100
    return (found >= t - DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(union, 1))) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n, f1 and f2 (a 128-bit hash of its shingle set), regs, bands."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for ident, text in zip(rows["_id"], rows["_text"], strict=True):
                own = shingle_set(text)
                f = xxhash.xxh3_128_intdigest(own.tobytes())
                regs = registers(own)
                out.append((ident, len(own), (f >> 64) - 2**63, (f & (2**64 - 1)) - 2**63, regs.tobytes() if len(own) else None, band_keys(regs) if len(own) else None))
            got = pd.DataFrame(out, columns=["doc_id", "n", "f1", "f2", "regs", "bands"])
            yield got.assign(doc_id=got["doc_id"].astype("Int64"))

    one = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return one.mapInPandas(made, "doc_id long, n long, f1 long, f2 long, regs binary, bands array<long>")


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, REGISTERS)


def estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose registers leave a link possible."""
    own = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
    first = stage(reps.join(own, reps.rep == own.a).select("a", F.col("n").alias("n_a"), F.col("regs").alias("r_a"), "degree"), "pivots")
    second = reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b"))
    near = join_hot(pairs, first, ["a"], "degree", ["b"]).join(second, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.loc[may_link(_regs(rows["r_a"]), _regs(rows["r_b"]), rows["n_a"].to_numpy(), rows["n_b"].to_numpy(), percent), ["a", "b"]]

    return near.mapInPandas(keep, "a long, b long")


def sets_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, elements (the sorted hashes, 8 bytes each) of the rows of ``docs`` with an id in ``ids``.rep and that row's set (f1)."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("_text")).join(ids, "rep")

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(rep, own) for rep, own, f in zip(rows["rep"], (shingle_set(x).tobytes() for x in rows["_text"]), rows["f1"], strict=True) if (xxhash.xxh3_128_intdigest(own) >> 64) - 2**63 == f]
            if out:
                yield pd.DataFrame(out, columns=["rep", "elements"])

    return texts.select("rep", "_text", "f1").mapInPandas(made, "rep long, elements binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of sorted distinct elements."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets are similar.

    Pairs with one ``a`` are taken PARTNERS at a time, and its set moves once for them; a task holds that set and streams
    the others.
    """
    own = stage(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    dealt = join_hot(pairs, own, ["a"], "degree", ["b"]).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("degree") / PARTNERS)).alias("part"))
    first = own.select(F.col("a").alias("rep"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("degree") / PARTNERS) - 1)).alias("part"), F.lit(0).alias("turn"))
    sides = first.unionByName(dealt.select(F.col("b").alias("rep"), "a", "part", F.lit(1).alias("turn")))
    met = sets.join(sides, "rep").repartition("a", "part").sortWithinPartitions("a", "part", "turn", "rep")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pivot = None, None
        for rows in batches:
            out = []
            for rep, elements, a, turn in zip(rows["rep"], rows["elements"], rows["a"], rows["turn"], strict=True):
                own = np.frombuffer(elements, np.uint64)
                if turn == 0:
                    at, pivot = a, own
                elif at == a and similar(pivot, own, percent):
                    out.append((a, rep))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return met.select("rep", "elements", "a", "turn").mapInPandas(confirm, "a long, b long")


def links_between(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the components of a bucket, confirmed on the full sets.

    ``members``: key, size, total, rep, label, n, regs, bands, elements. A bucket above BLOCK members or BLOCK_ELEMENTS
    elements is compared in pairs of blocks. A pair is looked at in the first band it shares; labels that a link has
    joined aren't compared again, so a block gives fewer links than it has rows.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("total") / BLOCK_ELEMENTS)).cast("int")
    spread = members.withColumn("_own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    spread = spread.select("key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "rep", "label", "n", "regs", "bands", "elements")
    group = ["key", "_i", "_j"]

    def compare(got: list[pd.DataFrame]) -> Iterator[tuple[int, int]]:
        rows = pd.concat(got) if len(got) > 1 else got[0]
        names, label = np.unique(rows["label"].to_numpy(), return_inverse=True)
        if len(names) < 2:
            return
        rep, n, own = (rows[c].to_numpy() for c in ("rep", "n", "_own"))
        regs, bands, elements = _regs(rows["regs"]), np.stack(rows["bands"].to_numpy()), [np.frombuffer(x, np.uint64) for x in rows["elements"]]
        key, across = rows["key"].iloc[0], rows["_i"].iloc[0] != rows["_j"].iloc[0]
        order = np.argsort(-np.bincount(label)[label], kind="stable")  # the largest component first: others are compared with it
        for place, k in enumerate(order):
            rest = order[:place]
            rest = rest[label[rest] != label[k]]
            if across:
                rest = rest[own[rest] != own[k]]
            if not len(rest):
                continue
            same = bands[rest] == bands[k]
            rest = rest[same.argmax(1) == np.flatnonzero(bands[k] == key)[0]]
            if len(rest):
                rest = rest[may_link(regs[[k]], regs[rest], np.full(len(rest), n[k]), n[rest], percent)]
            for other in rest:
                if label[other] != label[k] and similar(elements[k], elements[other], percent):
                    yield min(rep[k], rep[other]), max(rep[k], rep[other])
                    label[label == label[k]] = label[other]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, at = [], None
        for rows in batches:
            out = []
            for key, part in rows.groupby(group, sort=False):
                if at is not None and key != at:
                    out += compare(open_)
                    open_ = []
                at = key
                open_.append(part)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if open_:
            yield pd.DataFrame([*compare(open_)], columns=["a", "b"], dtype="int64")

    return spread.repartition(*group).sortWithinPartitions(*group).mapInPandas(stream, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components of all rows.

    A row's set is its distinct five-word shingles; one with fewer words has its whole sequence as one shingle; one without
    words (or text) has none and links with nothing. Rows link if 100 * intersection >= ``percent`` * union.

    1. Rows with equal sets are one class, whose smallest id stands for it.
    2. Classes meet in buckets of banded HyperMinHash registers. Each is paired with its bucket's smallest; pairs that the
       collision-corrected estimate leaves possible are verified on the full sets; linked ones become components.
    3. In buckets that still hold several components, members of different components are compared block by block, by
       estimate and then on the full sets, and only links that join components leave the task. So copies that step 2 has
       joined aren't compared again, and no link between components that met in any bucket is lost.

    Returns doc_id, n_shingles, component_id, kept. Rows with one id and different texts count as linked, and if that id
    stands for several classes its links to others come from one of them (the least by hash); repeated rows are returned
    each. Very long texts are sets like others, one text at a time. Null ids are returned, never chosen. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    feats = stage(features(docs, id_col, text_col), "features")
    classes = stage(feats.filter("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    held = [feats.doc_id == classes.rep, feats.f1 == classes.f1, feats.f2 == classes.f2]
    reps = feats.filter("n > 0").join(classes, held, "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.min(F.struct("f1", "f2", "n", "regs", "bands")).alias("own"))
    reps = stage(reps.select("rep", "own.f1", "own.n", "own.regs", "own.bands"), "reps")
    bands = reps.select(F.explode("bands").alias("key"), "rep", "n")
    shared = stage(bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).filter("size > 1"), "shared")
    buckets = stage(join_hot(bands.drop("n"), shared, ["key"], "size", ["rep"]), "buckets")
    star = stage(buckets.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    sets = stage(sets_of(reps.select("rep", "f1").join(buckets.select("rep").distinct(), "rep"), docs, id_col, text_col), "sets")
    near = stage(estimated(star, reps, percent), "near")
    links = stage(verified(near, sets, percent), "links")
    found = stage(components(links), "components")
    large = stage(buckets.filter("size > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "large")
    open_ = stage(large.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_rows")).filter("_lo != _hi").select("key", "_rows"), "open")
    members = join_hot(large, open_, ["key"], "_rows", ["rep"]).drop("_rows").join(reps.drop("f1"), "rep").join(sets, "rep")
    more = stage(links_between(members, percent), "between")
    if not more.isEmpty():
        found = stage(components(links.unionByName(more)), "components")
    release(shared, buckets, star, near, links, large, open_, more, sets)
    whole = stage(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("label", "rep").alias("_component"), "rows"), "whole")
    named = join_hot(feats.filter("n > 0").select("doc_id", "n", "f1", "f2"), whole, ["f1", "f2"], "rows", ["doc_id"], "left").select("doc_id", "n", "_component")
    out = named.unionByName(feats.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("_component")))
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
