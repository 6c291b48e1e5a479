"""Quality rules: counts of repetition and symbols, and perplexity bands of a modified Kneser-Ney model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed
from .common import join_few, release, small_batches, stage

ORDER = 5
START, END = "\x02", "\x03"
#: Slots of a task's table of n-grams (counted, or scored): a few tens of MB. What finds its slot taken goes another way.
SLOTS = 1 << 20
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A language's band of log perplexity: its median less and plus so many spreads. A spread is the distance of the quartile
#: from the median for a text of one word; it narrows with the square root of the number of words. At sf0.1 each side costs
#: fewer than one in a thousand of the labelled clean documents that pass the base rules.
BELOW, ABOVE = 6.0, 4.5
_C = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def running(words: list[bytes]) -> str:
    """A text as the model reads it: its words parted by one space, between START and END."""
    return START + b" ".join(words).decode("utf-8", "replace").replace("\0", "\ufffd") + END


def seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang))


class Windows:
    """The n-grams of running texts that end with each character after START, of ORDER characters (fewer at the start)."""

    def __init__(self, texts: list[str], seeds: np.ndarray) -> None:
        self.codes, self.sizes = hashed.points(texts)
        self.seeds = np.repeat(seeds, self.sizes)
        place = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.end = np.flatnonzero(place > 0) + 1
        self.depth = np.minimum(place[self.end - 1] + 1, ORDER)
        self.keys = hashed.window_keys(self.seeds, self.codes, ORDER)[self.end - 1]
        short = np.flatnonzero(self.depth < ORDER)
        self.keys[short] = self.of(short, self.depth[short])

    def of(self, at: np.ndarray, depth: np.ndarray, back: int = 0) -> np.ndarray:
        """Keys of the n-grams of ``depth`` characters that end ``back`` characters before the end of the windows ``at``."""
        end = self.end[at] - back
        return hashed.keys(self.seeds[self.end[at] - 1], self.codes, end, depth, ORDER)

    def grams(self, at: np.ndarray) -> np.ndarray:
        """The n-grams of the windows ``at``, each as ORDER code points, 0 after its own."""
        step = np.arange(ORDER)
        where = np.minimum((self.end[at] - self.depth[at])[:, None] + step, len(self.codes) - 1)
        return np.where(step < self.depth[at][:, None], self.codes[where], 0).astype("<u4")


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SLOTS - 1)).astype(np.int64)


def gram_counts(docs: DataFrame, lang: str = "_lang", text: str = "_text") -> DataFrame:
    """lang, gram, n: all character n-grams of ORDER, and the shorter ones at the start, of all running texts; n-grams go on over spaces."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a table by slot; an n-gram whose slot another one holds is counted within its batch
        held, many = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64)
        grams, owner = np.zeros((SLOTS, ORDER), "<u4"), np.zeros(SLOTS, np.int32)
        names: list[str] = []
        number: dict[str, int] = {}

        def frame(points: np.ndarray, own: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"lang": np.array(names, object)[own], "gram": np.ascontiguousarray(points).view(f"<U{ORDER}").reshape(-1).tolist(), "n": n})

        for rows in batches:
            of = [number.setdefault(x, len(number)) for x in rows[lang]]
            names = list(number)
            seeds = np.array([seed(x) for x in names], np.uint64)[of]
            got = Windows([running(words_of(x)) for x in rows[text]], seeds)
            if not len(got.keys):
                continue
            slot = slots_of(got.keys)
            new, first, n = np.unique(got.keys[held[slot] != got.keys], return_index=True, return_counts=True)
            many += np.bincount(slot[held[slot] == got.keys], minlength=SLOTS)
            if not len(new):
                continue
            first = np.flatnonzero(held[slot] != got.keys)[first]
            langs = np.repeat(np.array(of, np.int32), got.sizes)[got.end[first] - 1]
            at = slots_of(new)
            chosen = np.zeros(len(new), bool)
            chosen[np.unique(at, return_index=True)[1]] = True
            chosen &= many[at] == 0
            held[at[chosen]], many[at[chosen]], owner[at[chosen]] = new[chosen], n[chosen], langs[chosen]
            grams[at[chosen]] = got.grams(first[chosen])
            if not chosen.all():
                yield frame(got.grams(first[~chosen]), langs[~chosen], n[~chosen])
        full = np.flatnonzero(many)
        if len(full):
            yield frame(grams[full], owner[full], many[full])

    return docs.select(lang, text).mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, alpha) and (lang, gram: context, gamma) of an interpolated modified Kneser-Ney model.

    Below the highest order an n-gram counts the different characters before it; at the start of a text it keeps its
    count. Discounts come from the counts of counts of each language and order. Every n-gram is returned; a context's gamma
    is the mass that its n-grams leave.
    """
    levels = [counts.filter(F.length("gram") == ORDER)]
    for k in range(ORDER - 1, 0, -1):
        inner = levels[-1].groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        start = counts.filter((F.length("gram") == k) & F.col("gram").startswith(START))
        levels.append(inner.unionByName(start.select("lang", "gram", "n")).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    every = levels[0].select("lang", "gram", "n")
    for level in levels[1:]:
        every = every.unionByName(level.select("lang", "gram", "n"))
    every = stage(every.withColumn("k", F.length("gram")).withColumn("h", F.expr("substring(gram, 1, length(gram) - 1)")), "grams")
    of = [F.sum((F.col("n") == c).cast("double")).alias(f"n{c}") for c in (1, 2, 3, 4)]
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    cut = lambda c: F.least(F.greatest(c - (c + 1) * y * F.col(f"n{c + 1}") / F.greatest(f"n{c}", F.lit(1.0)), F.lit(0.05)), F.lit(c - 0.05))
    discounts = every.groupBy("lang", "k").agg(*of).select("lang", "k", cut(1).alias("d1"), cut(2).alias("d2"), cut(3).alias("d3"))
    totals = every.groupBy("lang", "k", "h").agg(F.sum("n").alias("total"))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    alpha = every.join(totals, ["lang", "k", "h"]).join(discounts, ["lang", "k"]).select("lang", "gram", "h", ((F.col("n") - d) / F.col("total")).alias("alpha"))
    alpha = stage(alpha, "alpha")
    release(every)
    gamma = alpha.groupBy("lang", F.col("h").alias("gram")).agg(F.greatest(1 - F.sum("alpha"), F.lit(1e-4)).alias("gamma"))
    return alpha, gamma


class Model:
    """Sorted arrays of n-gram hashes with their alphas, and of context hashes with their gammas."""

    def __init__(self, a: np.ndarray, alpha: np.ndarray, g: np.ndarray, gamma: np.ndarray) -> None:
        self.a, self.alpha, self.g, self.gamma = a, alpha, g, gamma
        self.held, self.logs = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.float32)

    def arrays(self) -> tuple:
        return self.a, self.alpha, self.g, self.gamma

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), missing)
        at, there = hashed.find(keys, wanted)
        return np.where(there, values[at], missing)

    def scores(self, langs: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each running text the sum of the natural logs of its characters' probabilities (its end included), and their number.

        What was scored before is found in a table by slot; of n-grams that share a slot the last one stays there.
        """
        got = Windows(texts, np.array([seed(x) for x in langs], np.uint64))
        slot = slots_of(got.keys)
        logs = self.logs[slot].astype(np.float64)
        missing = np.flatnonzero(self.held[slot] != got.keys)
        if len(missing):
            new, first, back = np.unique(got.keys[missing], return_index=True, return_inverse=True)
            first = missing[first]
            depth = got.depth[first]
            p = np.full(len(new), 1 / 1024)
            for k in range(1, ORDER + 1):
                now = np.minimum(k, depth)
                better = self._find(self.a, self.alpha, got.of(first, now), 0.0) + self._find(self.g, self.gamma, got.of(first, now - 1, 1), 1.0) * p
                p = np.where(k <= depth, better, p)
            fresh = np.log(np.maximum(p, 1e-12))
            logs[missing] = fresh[back.reshape(-1)]
            at = slots_of(new)
            self.held[at] = new  # of several for a slot numpy keeps the last, here and in the next line
            self.logs[at] = fresh
        every = np.zeros(len(got.codes))
        every[got.end - 1] = logs
        return np.add.reduceat(every, np.cumsum(got.sizes) - got.sizes), got.sizes - 1


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that occur twice or more; ids: a number for each word."""
    if len(ids) < window + 1:
        return 0
    n = len(ids) - window + 1
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key + ids[k : k + n]) * _C
    ordered = np.sort(key)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    _, back, many = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int64)
    hit = np.flatnonzero(many[back.reshape(-1)] > 1)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str, ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ids: a number for each word of the text."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(ids), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """_id, lang and COLUMNS of rows with _id, _lang and _text (neither null)."""
    shared = docs.sparkSession.sparkContext.broadcast(model.arrays())

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for rows in batches:
            langs = rows["_lang"].tolist()
            counts, texts = [], []
            for text in rows["_text"]:
                words = words_of(text)
                counts.append(base_counts(text, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))))
                texts.append(running(words))
            logs, sizes = own.scores(langs, texts) if texts else (np.empty(0), np.empty(0))
            made = pd.DataFrame(counts, columns=[c.split()[0] for c in COLUMNS.split(", ")][:-1])
            made["log_perplexity"] = np.where(made["n_words"].to_numpy(np.int64) > 0, -logs / np.maximum(sizes, 1), np.nan)
            made["log_perplexity"] = made["log_perplexity"].astype("Float64").mask(made["n_words"] == 0)
            made.insert(0, "lang", langs)
            made.insert(0, "_id", rows["_id"].to_numpy() if rows["_id"].notna().all() else rows["_id"].astype("Int64"))
            yield made

    return docs.mapInPandas(score, f"_id {dict(docs.dtypes)['_id']}, lang string, {COLUMNS}")


def sorted_arrays(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of (lang, gram), made by the tasks and sorted, with their values."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            if len(own):
                points, sizes = hashed.points(own["gram"].tolist())
                seeds = {name: seed(name) for name in own["lang"].unique()}
                keys = hashed.keys(np.array([seeds[x] for x in own["lang"]], np.uint64), points, np.cumsum(sizes), sizes, ORDER)
                yield pd.DataFrame({"key": keys.view(np.int64), "value": own[value].astype(np.float32)})

    table = rows.mapInPandas(hashes, "key long, value float").toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["value"].to_numpy()[order]


def train(docs: DataFrame) -> Model:
    counts = stage(gram_counts(docs), "counts")
    alpha, gamma = kneser_ney(counts)
    made = Model(*sorted_arrays(alpha.select("lang", "gram", "alpha"), "alpha"), *sorted_arrays(gamma, "gamma"))
    release(counts, alpha)
    return made


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The counts and the verdict on every row.

    A character 5-gram model of the running texts of each language (words parted by one space; a null language is one of its
    own), whose n-grams go on over spaces, is counted over all rows; its perplexity of a text is per character. A row fails the base rules with fewer than 20 words or with over 30 % of
    its words in repeated 8-word windows. Of the others those are kept whose log perplexity lies in their language's band,
    whose middle and width come from the quartiles over all rows of the language that pass the base rules. A language
    whose texts all score alike keeps them.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity. A null
    text counts as empty and fails (its log_perplexity is null). Very long texts are read whole, one batch of rows at a time.
    Repeated rows are returned each, and texts that tie have one verdict; null ids stay. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    one = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col), F.lit("und")).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = stage(scored(one, train(one)), "scored")
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    good = rows.filter(~failed)
    middle = stage(good.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("_middle")), "middle")
    away = F.expr("(log_perplexity - _middle) * sqrt(n_words)")
    spread = join_few(good, middle, ["lang"], "inner").groupBy("lang").agg(F.first("_middle").alias("_middle"), F.percentile_approx(away, [0.25, 0.75], 10_000).alias("q"))
    low = F.expr(f"-{BELOW} * greatest(-q[0], 0.05)")
    high = F.expr(f"{ABOVE} * greatest(q[1], 0.05)")
    bands = stage(spread.select("lang", "_middle", low.alias("_low"), high.alias("_high")), "bands")
    judged = join_few(rows, bands, ["lang"], "left").withColumn("_away", away)
    kept = ~failed & F.coalesce(F.col("_away").between(F.col("_low"), F.col("_high")), F.lit(False))
    return judged.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"), "log_perplexity")
