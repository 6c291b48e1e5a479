import glob

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import hyperminhash, mixing, perplexity, queries, recipes, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_sql(spark, duck, name):
    frame = queries.queries()[name](spark, SF)
    found = duck.execute(sql.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in frame.columns]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(str(tuple(r)) for r in frame.collect()) == sorted(str(tuple(row[k] for k in order)) for row in found.fetchall())


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    expected = {
        "quality rules": lambda d: {r.doc_id for r in perplexity.quality(d).collect() if r.kept},
        "exact dedup": lambda d: {max(x.doc_id for x in rows) for rows in by_text(d).values()},
        "near dedup": lambda d: {r.component_id for r in hyperminhash.near_dedup(d).collect()},
        "mixing": lambda d: {r.doc_id for r in mixing.mixed(d, queries.labelled_domains(spark.read.parquet(f"{SF}/labels.parquet")), queries.MIX, "good").collect() if r.copies},
    }

    def by_text(d):
        out = {}
        for r in d.collect():
            out.setdefault(r.text, []).append(r)
        return out

    for name, step in corpus_pipeline.STAGES[:-1]:
        want = expected[name](docs)
        after = corpus_pipeline.stage(step(spark, docs, SF), "test")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert {r.doc_id for r in after.collect()} == want and len(want) <= before
        docs, before = after, len(want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    assert before > 100


def test_repeated_rows_leave_one_in_the_pipeline(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (2, "b", "en", "s", 1)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert sorted(r.doc_id for r in corpus_pipeline.exact(spark, docs, SF).collect()) == [1, 2]
    assert recipes.exact_dedup(docs).count() == 3


def test_stages_take_nulls_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = [F.lit(99).alias(c) for c in ("copies", "_copy", "mixed_id", "kept", "component_id", "keep_id", "_id", "rate", "label", "_Copies")]
    odd = docs.unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars")).select("*", *more)
    for name, step in corpus_pipeline.STAGES[:-1]:
        for given in (odd, odd.limit(0)):
            after = step(spark, given, SF)
            assert after.dtypes == given.dtypes, name
            assert all(r["copies"] == 99 and r["_copy"] == 99 for r in after.collect()), name
    assert corpus_pipeline.packed(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.packed(spark, odd, SF).count() > 60


def test_the_mix_of_the_query_meets_its_targets(spark):
    found = queries.op7_source_mixing(spark, "/root/testdata/sf0.01").collect()
    total = {d: sum(r.n_words * r.rate * r[f"p_{d}"] for r in found) for d in queries.MIX}
    assert all(abs(total[d] / sum(total.values()) - share) < 0.01 for d, share in queries.MIX.items())
