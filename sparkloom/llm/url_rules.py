"""URL filters: a sorted sweep over reversed-host keys with a stack of the active nested rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

SEP = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url):
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(host):
    """``www.example.com`` becomes ``com<SEP>example<SEP>www<SEP>``: a host and its subdomains are one interval of keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(SEP, F.reverse(F.split(host, r"\."))), F.lit(SEP)))


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by part, key, and rules first. The stack holds the rules of each host key that is a prefix of the current one."""
    part, stack = None, []  # [(key, {path: (action, rule, length)}, lengths of the paths, longest first)]
    for rows in batches:
        out = []
        for own, key, is_url, path, ident, host, action, rule in zip(*(rows[c] for c in ("_part", "_key", "_is_url", "_path", "_ident", "_host", "_action", "_rule")), strict=True):
            if own != part:
                part, stack = own, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, []))
                at = stack[-1]
                old = at[1].get(path)
                if old is None or action < old[0]:  # of equal rules with different actions the first by name holds
                    at[1][path] = (action, rule)
                if len(path) not in at[2]:
                    at[2].append(len(path))
                    at[2].sort(reverse=True)
                continue
            best = None
            for _, rules, lengths in stack:
                for n in lengths:
                    if n <= len(path) and (found := rules.get(path[:n])):
                        if best is None or len(found[1]) >= len(best[1]):  # of equally long rules the deeper host holds
                            best = found
                        break
            out.append((ident, host, path, best and best[1], best and best[0]))
        yield pd.DataFrame(out, columns=["_ident", "host", "path", "rule", "verdict"])


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The verdict on each url by the longest rule that fits it.

    ``rules`` has host, path and action (allow or block). A rule fits its host and all subdomains if the url's path starts
    with its path. Range-partitioned by (host key, path, id), so one host may hold any share of the rows; each part is
    preceded by the rules of the ancestors of its first key (their number is bounded by parts times labels). Without a rule
    the verdict is ``default``. A null url or one without ``://`` has an empty host and path and fits no rule; rules with a
    null or empty host or a null path are ignored. Of equally long rules the one with the longer host holds, of equal rules
    with different actions the first action by name. Very long urls are judged whole. Repeated rows are judged each. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = urls.sparkSession
    small_batches(spark)
    url = urls.select(F.col(id_col).alias("_ident"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"))
    url = url.select(host_key(F.col("_host")).alias("_key"), F.lit(1).alias("_is_url"), "_path", "_ident", "_host", F.lit(None).cast("string").alias("_action"), F.lit(None).cast("string").alias("_rule"))
    rule = rules.filter("host != '' and path is not null and action is not null").select(
        host_key(F.translate("host", UPPER, LOWER)).alias("_key"), F.lit(0).alias("_is_url"), F.col("path").alias("_path"), F.lit(None).cast(url.schema["_ident"].dataType).alias("_ident"), F.lit(None).cast("string").alias("_host"), F.col("action").alias("_action"), F.concat(F.translate("host", UPPER, LOWER), "path").alias("_rule")
    )
    order = ["_key", "_is_url", "_path", "_ident"]
    ranged = stage(url.unionByName(rule).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "urls")
    first = ranged.groupBy("_part").agg(F.min("_key").alias("_first"))
    labels = F.split(F.expr("substring(_first, 1, length(_first) - 1)"), SEP)
    above = first.select("_part", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.concat_ws(SEP, F.slice(labels, 1, n)), F.lit(SEP)))).alias("_key")).filter("length(_key) > 1")
    carried = rule.join(above, "_key")
    rows = ranged.unionByName(carried.select(ranged.columns)).repartition("_part").sortWithinPartitions("_part", *order)
    kind = dict(urls.dtypes)[id_col]
    judged = rows.mapInPandas(sweep, f"_ident {kind}, host string, path string, rule string, verdict string")
    return judged.select(F.col("_ident").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
