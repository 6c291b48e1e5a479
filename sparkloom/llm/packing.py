"""Packing: shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_rank_in, per_process, small_batches, stage

MAX_TOKENS, END_ID = 2048, 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """text -> the ids that ``tokenizers`` gives for the vocabulary; strings of its special tokens give their ids.

    Beside a ``.json`` vocabulary, its ``.tiktoken`` ranks give the same ids faster for texts without such a string.
    """
    import os

    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    whole = lambda text: own.encode(text, add_special_tokens=False).ids
    ranks = path[: -len(".json")] + ".tiktoken"
    if not (path.endswith(".json") and os.path.exists(ranks)):
        return whole
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    added = [t.content for t in own.get_added_tokens_decoder().values()]
    return lambda text: whole(text) if any(x in text for x in added) else fast(text)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, max_tokens: int, vocabulary: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids with the end id, cut every ``max_tokens``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = per_process(f"encoder {vocabulary}", lambda: encoder(vocabulary))
        for rows in batches:
            out = []
            for ident, text in zip(rows["_id"], rows["_text"], strict=True):
                ids = np.array([*encode(text), END_ID], dtype="<u4")
                out += [(ident, at, len(p := ids[at : at + max_tokens]), zlib.crc32(p.tobytes()), len(ids)) for at in range(0, len(ids), max_tokens)]
            made = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    one = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return one.mapInPandas(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(counts: dict[int, int], max_tokens: int) -> list[tuple[int, list[int]]]:
    """(how often, lengths) patterns. Lengths come longest first; each enters the pack with the most room, else a new one.

    A new pack takes as many of the length as it holds, for it has the most room until then. A length splits at most one
    pattern and opens at most two, so there are at most three times as many patterns as lengths.
    """
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        # lengths come in falling order, and a pack takes the same length again while it has the most room
        while left:
            room = max((r for r, packs in by_room.items() if packs), default=0)
            if room < length:
                many = max_tokens // length
                if left >= many:
                    by_room[max_tokens - many * length].append((left // many, [length] * many))
                if left % many:
                    by_room[max_tokens - left % many * length].append((1, [length] * (left % many)))
                break
            often, lengths = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            if often > left:
                by_room[room].append((often - left, lengths))
                often = left
            by_room[room - length].append((often, [*lengths, length]))
            left -= often
    return [p for _, packs in sorted(by_room.items()) for p in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): the pieces of a length, by rank, in the slots of the patterns."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for often, lengths in patterns:
        offset = 0
        for length in lengths:
            out.append((length, used[length], sequence, offset))
            used[length] += often
            offset += length
        sequence += often
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Every document's token ids, in pieces, placed in sequences of at most ``max_tokens``.

    A document's ids (a null text has none) end with id 1. They are cut every ``max_tokens``; the histogram of the pieces'
    lengths, at most ``max_tokens`` numbers, is packed on the driver, and pieces find their slots by their rank among the
    pieces of their length, so no task and no driver holds more than a batch of pieces. Texts are tokenized once.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Very long texts are tokenized whole and lie in
    many pieces. Repeated rows are packed each; pieces that tie in length take slots in the order of their ids; a null id
    stays null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stage(token_pieces(docs, id_col, text_col, max_tokens, vocabulary or default_vocabulary()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(shortest_pack_first(counts, max_tokens)))
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = dense_rank_in(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "_rank_of_length", salts)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = table.value
        begins = at[:, 0] * 2**44 + at[:, 1]
        for rows in batches:
            rank = rows["_rank_of_length"].to_numpy(np.int64)
            slot = at[np.searchsorted(begins, rows["length"].to_numpy(np.int64) * 2**44 + rank, side="right") - 1]
            yield rows.drop(columns="_rank_of_length").assign(doc_id=rows["doc_id"].astype("Int64"), sequence_id=slot[:, 2] + rank - slot[:, 1], offset=slot[:, 3])

    return ranked.select(*pieces.columns, "_rank_of_length").mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
