"""Mixing sources to target weights by soft membership. DataFrame functions only."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: The classifier is fitted on at most this many labelled rows (those with the smallest hashes of their ids) and has this many feature buckets.
LABELLED, BUCKETS = 20_000, 1 << 18
#: A bucket counts for a domain if the likelihood-ratio statistic (G squared) of its share there against elsewhere is above this.
SURE = 15.0
#: That a text lacks a bucket counts only for buckets that fewer of the rows have; whether a text has a common word depends on its length.
RARE = 0.1
#: At most so many steps; they end where one lowers the sum by less than CLOSE of what no document at all would miss. RIDGE keeps a step finite.
STEPS, CLOSE, RIDGE = 12, 1e-7, 1e-3
#: Totals that miss the wanted ones by more than this share of the whole are reported by a warning.
TOLERATED = 0.01


#: White space, with the points that end the word before it.
CUT = r"[.,;:!?]*[\x20\x09-\x0D]+"
SPACES, POINTS = " \t\n\x0b\x0c\r", ".,;:!?"


def n_words(text: Column) -> Column:
    """How many words, parted by ASCII white space, a text has."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def features(text: Column) -> Column:
    """The distinct words of a text (lower case, without points at their ends) and their distinct shapes (each run of letters as ``a``)."""
    low = F.lower(F.ltrim(F.rtrim(text, F.lit(POINTS + SPACES)), F.lit(SPACES)))
    shapes = F.array_distinct(F.split(F.regexp_replace(low, r"\p{L}+", "a"), CUT))
    return F.concat(F.array_distinct(F.split(low, CUT)), F.transform(shapes, lambda s: F.concat(F.lit("\x01"), s)))


def bucket(feature: Column) -> Column:
    return F.pmod(F.xxhash64(feature), F.lit(BUCKETS)).cast("int")


def _surprise(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, seen * F.log(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)


def weights_of(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """(bucket, w_0, w_1, ...) and each domain's constant: a Bernoulli naive Bayes score is the constant plus the weights of the buckets present.

    A weight is 0 where the bucket's share in the domain isn't surely different.
    """
    chosen = labelled.filter(F.col("domain").isin(domains) & F.col("_id").isNotNull()).orderBy(F.xxhash64("_id"), "_id", "domain").limit(LABELLED)
    rows = docs.select("_id", "_text").join(F.broadcast(chosen), "_id").select("_id", "domain", features(F.col("_text")).alias("_features"))
    rows = stage(rows, "labelled")
    sums = rows.agg(*[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)], F.count(F.lit(1)).alias("n")).first()
    total = sums["n"] or 0
    size = {d: sums[f"n{k}"] or 0 for k, d in enumerate(domains)}
    each = rows.select("domain", F.array_distinct(F.transform("_features", bucket)).alias("_buckets"))
    counts = each.select("domain", F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    weights = []
    for k, d in enumerate(domains):
        a, rest = F.col(f"n{k}").cast("double"), total - size[d]
        b = F.col("n") - a
        share = F.col("n") / float(max(total, 1))
        gain = _surprise(a, size[d] * share) + _surprise(b, rest * share) + _surprise(size[d] - a, size[d] * (1 - share)) + _surprise(rest - b, rest * (1 - share))
        here, anywhere = (a + 0.5) / (size[d] + 1.0), (F.col("n") + 0.5) / (total + 1.0)
        absent = F.when(anywhere < RARE, F.log((1 - here) / (1 - anywhere))).otherwise(0.0)
        weights += [F.when(2 * gain > SURE, x).otherwise(0.0).alias(f"{name}_{k}") for name, x in (("w", F.log(here / anywhere) - absent), ("absent", absent))]
    prior = {d: math.log((size[d] + 1) / (total + len(domains))) for d in domains}
    found = stage(counts.select("bucket", *weights).filter(F.greatest(*[F.abs(f"w_{k}") for k in range(len(domains))], F.lit(0.0)) > 0), "weights")
    without = found.agg(*[F.sum(f"absent_{k}").alias(f"absent_{k}") for k in range(len(domains))]).first()
    return found.drop(*[f"absent_{k}" for k in range(len(domains))]), {d: prior[d] + (without[f"absent_{k}"] or 0.0) for k, d in enumerate(domains)}


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """_id, _words, p_0, p_1, ...: each row's posterior of each domain."""
    table, prior = weights_of(docs, labelled, domains)
    names = [f"w_{k}" for k in range(len(domains))]
    marked = docs.select(F.monotonically_increasing_id().alias("_row"), "_id", n_words(F.col("_text")).alias("_words"), features(F.col("_text")).alias("_features"))
    each = marked.select("_row", "_id", "_words", F.explode("_features").alias("_feature")).select("_row", "_id", "_words", bucket(F.col("_feature")).alias("bucket"))
    scored = each.join(F.broadcast(table), "bucket", "left").groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_words").alias("_words"), *[F.sum(w).alias(w) for w in names])
    logits = [F.coalesce(w, F.lit(0.0)) + prior[d] for w, d in zip(names, domains, strict=True)]
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    scored = scored.select("_id", "_words", *[F.exp(x - top).alias(f"e_{k}") for k, x in enumerate(logits)])
    whole = sum((F.col(f"e_{k}") for k in range(1, len(domains))), F.col("e_0"))
    return scored.select("_id", "_words", *[(F.col(f"e_{k}") / whole).alias(f"p_{k}") for k in range(len(domains))])


def fitted_rates(rows: DataFrame, targets: list[float], anchor: int, max_rate: float | None) -> tuple[Column, list[float], list[float]]:
    """A rate for each of ``rows`` (_words, p_0, ...) by projected gradient steps, the totals it gives, and the wanted ones.

    Minimises the sum over the domains of (total - wanted)^2 / available over rates from 0 (to ``max_rate`` where it is
    given), from rates of 1. The wanted total of the whole is such that domain ``anchor`` is wanted as it is. A step is the
    gradient in the metric of the Gram matrix of the rows that aren't at a bound, which a few steps suffice for; one that
    raises the sum is taken again as a plain gradient. It costs one aggregate of the rows; the driver holds the domains'
    totals and their Gram matrix.
    """
    names = [f"p_{k}" for k in range(len(targets))]
    pairs = [(j, k) for j in range(len(names)) for k in range(j, len(names))]

    def sums(rate: Column) -> tuple[np.ndarray, np.ndarray]:
        inside = (rate > 0) if max_rate is None else (rate > 0) & (rate < float(max_rate))
        free = F.when(inside, F.col("_words")).otherwise(0)
        held = rows.withColumn("_rate", rate).withColumn("_free", free)
        got = held.agg(*[F.sum(F.col("_words") * F.col(p) * F.col("_rate")) for p in names], *[F.sum(F.col("_free") * F.col(names[j]) * F.col(names[k])) for j, k in pairs]).first()
        gram = np.zeros((len(names), len(names)))
        for (j, k), x in zip(pairs, got[len(names) :], strict=True):
            gram[j, k] = gram[k, j] = x or 0.0
        return np.array([x or 0.0 for x in got[: len(names)]]), gram

    def moved(rate: Column, by: np.ndarray) -> Column:
        after = F.greatest(rate - sum((F.col(p) * float(x) for p, x in zip(names, by, strict=True)), F.lit(0.0)), F.lit(0.0))
        return after if max_rate is None else F.least(after, F.lit(float(max_rate)))

    rate = F.lit(1.0) if max_rate is None else F.lit(min(1.0, float(max_rate)))
    now, gram = sums(rate)
    have = now if max_rate is None or max_rate >= 1 else now / max_rate
    whole = have[anchor] / targets[anchor] if targets[anchor] > 0 else have.sum()
    wanted, scale = np.array(targets) * whole, np.where(have > 0, have, 1.0)
    missed = lambda totals: float((((totals - wanted) ** 2) / scale).sum())
    for _ in range(STEPS):
        slope = (now - wanted) / scale
        plain = moved(rate, slope)
        trial = moved(rate, np.linalg.solve(gram / scale[:, None] + RIDGE * np.eye(len(names)), slope))
        after, next_gram = sums(trial)
        if missed(after) > missed(now):
            trial, (after, next_gram) = plain, sums(plain)
        if missed(now) - missed(after) <= CLOSE * float((scale * (wanted / scale) ** 2).sum()):
            if missed(after) < missed(now):
                rate, now = trial, after
            break
        rate, now, gram = trial, after, next_gram
    return rate, now.tolist(), wanted.tolist()


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], anchor: str, max_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A rate and a number of copies for every row, so that the expected tokens of each domain meet the target weights.

    A token is a word (parted by ASCII white space). ``labelled``: doc_id, domain. A naive Bayes classifier (of hashed words
    and word shapes) learns the domains from at most LABELLED labelled rows and gives every row a posterior of each. Rates
    are fitted by projected gradient least squares over all rows; without ``max_rate`` they have no upper bound, so that a
    scarce domain is repeated. A row has floor(rate + u) copies, where u in [0, 1) is a hash of its id. Totals that miss the
    wanted ones (a share of 0 is never met in full, for every text may belong to every domain) by over TOLERATED of the
    whole are reported by a warning.

    Returns doc_id, n_words, p_<domain>..., rate, copies. A null text is empty: it has the domains' shares as posterior and no
    weight. Very long texts are read whole, row by row. Repeated rows and rows with a null id are rows of their own (of equal
    ids equal copies). An empty table gives an empty result; labels of unknown rows or domains are ignored, as are other
    columns.
    """
    domains = sorted(targets)
    one = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = stage(posteriors(one, labelled.select(F.col("doc_id").alias("_id"), "domain"), domains), "posteriors")
    rate, totals, wanted = fitted_rates(rows, [targets[d] for d in domains], domains.index(anchor), max_rate)
    missed = max((abs(a - b) for a, b in zip(totals, wanted, strict=True)), default=0.0) / max(sum(wanted), 1.0)
    if missed > TOLERATED:
        warnings.warn(f"the mix misses its wanted totals {dict(zip(domains, wanted, strict=True))}: it has {dict(zip(domains, totals, strict=True))}", stacklevel=2)
    u = F.pmod(F.xxhash64(F.lit("mix"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    out = rows.withColumn("rate", rate)
    return out.select(F.col("_id").alias("doc_id"), F.col("_words").alias("n_words"), *[F.col(f"p_{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate", F.floor(F.col("rate") + u).cast("long").alias("copies"))
