"""Language ID: known words by their log frequency in each language, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .common import small_batches, stage

LONGEST = 5
#: A word that isn't in the model says less about the language than one that is.
UNSEEN_WEIGHT = 0.5
#: Different words that a task holds, and how many of them it looks up at once.
HELD, CHUNK = 200_000, 50_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; other numbers than digits (as ``²``) end a run too."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows (_lang, _text); counted within tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*key, n) for key, n in seen.items()], columns=["lang", "word", "n"])
            seen.clear()
            return out

        for rows in batches:
            for lang, text in zip(rows["_lang"], rows["_text"], strict=True):
                seen.update((lang, w) for w in words_of(text))
            if len(seen) > HELD:
                yield flush()
        yield flush()

    return docs.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, word: an n-gram of 1 to LONGEST characters of `` word ``, n."""

    def grams(lang: str, own: list[str], many: np.ndarray) -> Iterator[pd.DataFrame]:
        codes, sizes = hashed.points([f" {w} " for w in own])
        owner, place = np.repeat(np.arange(len(own)), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        for size in range(1, LONGEST + 1):
            end = np.flatnonzero(place >= size - 1) + 1
            if not len(end):
                continue
            _, first, back = np.unique(hashed.keys(np.zeros(len(end), np.uint64), codes, end, np.full(len(end), size), LONGEST), return_index=True, return_inverse=True)
            n = np.bincount(back.reshape(-1), many[owner[end - 1]].astype(float)).astype(np.int64)
            points = codes[(end[first] - size)[:, None] + np.arange(size)].astype("<u4")
            yield pd.DataFrame({"lang": np.full(len(n), lang, object), "word": np.ascontiguousarray(points).view(f"<U{size}").reshape(-1).tolist(), "n": n})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            for lang, rows in pd.concat(held).groupby("lang", sort=False):
                yield from grams(lang, rows["word"].tolist(), rows["n"].to_numpy())
            held.clear()

        for rows in batches:
            if len(rows):
                held.append(rows)
            if sum(map(len, held)) >= CHUNK:
                yield from flush()
        if held:
            yield from flush()

    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.sparkSession.sparkContext.defaultParallelism)
    return words.repartition(parts, "word").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def gram_hashes(grams: list[str]) -> np.ndarray:
    codes, sizes = hashed.points(grams)
    return hashed.keys(np.zeros(len(sizes), np.uint64), codes, np.cumsum(sizes), sizes, LONGEST)


def log_table(counts: DataFrame, langs: list[str], totals: np.ndarray, hashes: Callable[[list[str]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of all keys (word), made by the tasks, and for each its log frequency in every language (smoothed by half a count) less their mean."""

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {name: k for k, name in enumerate(langs)}
        for rows in batches:
            if len(rows):
                yield pd.DataFrame({"key": hashes(rows["word"].tolist()).view(np.int64), "lang": rows["lang"].map(at).astype(np.int32), "n": rows["n"]})

    rows = counts.mapInPandas(coded, "key long, lang int, n long").toArrow()
    keys, back = np.unique(rows["key"].to_numpy().view(np.uint64), return_inverse=True)
    logs = np.full((len(keys), len(langs)), 0.5, np.float32)
    np.add.at(logs, (back.reshape(-1), rows["lang"].to_numpy()), rows["n"].to_numpy().astype(np.float32))
    np.log(logs, out=logs)
    logs -= np.log(totals + 0.5 * max(len(keys), 1)).astype(np.float32)
    if len(keys):
        logs -= logs.mean(1, keepdims=True)
    return keys, logs


def train(docs: DataFrame) -> tuple:
    """(languages, sorted word hashes and their logs, sorted n-gram hashes and their logs, log share of the rows) from rows with _lang and _text, neither null."""
    share = {r["_lang"]: r["n"] for r in docs.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(share)
    words = stage(word_counts(docs), "words")
    grams = stage(gram_counts(words), "grams")
    sums = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = np.array([max(1, sums.get(name, 0)) for name in langs], float)
    prior = np.log(np.array([share[name] for name in langs], float) / max(1, sum(share.values())))
    return langs, *log_table(words, langs, total, word_hashes), *log_table(grams, langs, total, gram_hashes), prior


def unseen(words: list[str], hashes: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """For each word the mean over the known n-grams of the longest size that has any; zeros if none has."""
    out = np.zeros((len(words), logs.shape[1]), np.float32)
    codes, sizes = hashed.points([f" {w} " for w in words])
    owner, place = np.repeat(np.arange(len(words)), sizes), np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.ones(len(words), bool)
    for size in range(LONGEST, 0, -1):
        end = np.flatnonzero((place >= size - 1) & left[owner]) + 1
        if not len(end):
            continue
        at, there = hashed.find(hashes, hashed.keys(np.zeros(len(end), np.uint64), codes, end, np.full(len(end), size), LONGEST))
        mine, at = owner[end - 1][there], at[there]
        if len(mine):
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            out[mine[first]] = UNSEEN_WEIGHT * np.add.reduceat(logs[at], first, axis=0) / np.diff(first, append=len(mine))[:, None]
            left[mine[first]] = False
    return out


def identify(docs: DataFrame, model: tuple) -> DataFrame:
    """_id, _train, lang_pred, score for rows with _id, _text and _train."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, known, word_logs, hashes, gram_logs, prior = shared.value
        vocabulary: dict[str, int] = {}
        logs = np.zeros((0, len(langs)), np.float32)
        for rows in batches:
            if len(vocabulary) > HELD:
                vocabulary, logs = {}, logs[:0]
            texts = [words_of(text) if isinstance(text, str) else [] for text in rows["_text"]]
            ids = [np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in text), np.int64, len(text)) for text in texts]
            new = list(islice(vocabulary, len(logs), None))
            for k in range(0, len(new), CHUNK):
                part = new[k : k + CHUNK]
                at, there = hashed.find(known, word_hashes(part))
                more = np.zeros((len(part), len(langs)), np.float32)
                more[there] = word_logs[at[there]]
                if langs and not there.all():
                    more[~there] = unseen([w for w, k in zip(part, there, strict=True) if not k], hashes, gram_logs)
                logs = np.concatenate([logs, more])
            out = []
            for own in ids:
                if not len(own) or not langs:
                    out.append(("und", 0.0))
                    continue
                total = prior + logs[own].sum(0, dtype=np.float64)
                p = np.exp(total - total.max())
                best = int(p.argmax())
                out.append((langs[best], float(p[best] / p.sum())))
            made = pd.DataFrame(out, columns=["lang_pred", "score"])
            made.insert(0, "_id", rows["_id"].to_numpy() if rows["_id"].notna().all() else rows["_id"].astype("Int64"))
            made.insert(1, "_train", rows["_train"].to_numpy())
            yield made

    return docs.select("_id", "_train", "_text").mapInPandas(predict, f"_id {dict(docs.dtypes)['_id']}, _train boolean, lang_pred string, score double")


def language_id(docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The predicted language of every row, learned from the rows where the condition ``train_on`` holds.

    Words are runs of letters, lower-cased. A known word adds its log frequency in each language; an unseen one the mean of
    its longest known character n-grams, of 5 characters first and 1 last. All training rows are counted, and the
    model holds every counted word and n-gram. Only text and a non-null lang of training rows are used; no column but the text enters a
    prediction.

    Returns doc_id, held_out (not ``train_on``), lang_pred ('und' if the text is null or has no letter, or nothing was
    learned), score (the posterior; 0 for 'und'). Equal posteriors give the first language by name. Very long texts are read
    whole. Repeated rows are returned each; null ids are held out if the condition is null. An empty table gives an empty result; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    one = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.coalesce(train_on, F.lit(False)).alias("_train"))
    model = train(one.filter("_train and _lang is not null and _text is not null").select("_lang", "_text"))
    found = identify(one, model)
    return found.select(F.col("_id").alias("doc_id"), (~F.col("_train")).alias("held_out"), "lang_pred", "score")
