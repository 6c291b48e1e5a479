import pytest

from sparkloom.llm import mixing

MIX = {"good": 0.9, "bad": 0.1}


@pytest.fixture()
def tables(spark, documents, prose):
    rows = [(k, prose(40)) for k in range(184)] + [(200 + k, prose(30) + " rotten foul") for k in range(16)]
    labels = spark.createDataFrame([(k, "good" if k < 200 else "bad") for k, _ in rows if k % 2 == 0] + [(9999, "good"), (1, "unknown"), (None, "bad")], "doc_id long, domain string")
    return documents(rows), labels


def test_totals_meet_the_targets(tables):
    docs, labels = tables
    found = mixing.mixed(docs, labels, MIX, anchor="good").collect()
    assert len(found) == 200
    total = {d: sum(r.n_words * r.rate * r[f"p_{d}"] for r in found) for d in MIX}
    assert abs(total["good"] / sum(total.values()) - 0.9) < 0.01
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in found)
    good, bad = [r for r in found if r.doc_id < 200], [r for r in found if r.doc_id >= 200]
    assert min(r.p_good for r in good) > 0.9 and min(r.p_bad for r in bad) > 0.9


def test_rates_are_bounded_and_an_unwanted_domain_goes(tables):
    docs, labels = tables
    found = mixing.mixed(docs, labels, {"good": 1.0, "bad": 0.0}, anchor="good", max_rate=1.0).collect()
    assert all(0 <= r.rate <= 1 for r in found)
    assert sum(r.copies == 0 for r in found if r.doc_id < 200) <= 2 and sum(r.copies for r in found if r.doc_id >= 200) <= 2


def test_projected_gradient_agrees_with_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 50)
    words = rng.integers(1, 200, 50)
    rows = spark.createDataFrame([(int(w), *map(float, x)) for w, x in zip(words, p, strict=True)], "_words long, p_0 double, p_1 double, p_2 double")
    targets = [0.5, 0.3, 0.2]
    rate, now, wanted = mixing.fitted_rates(rows, targets, 0, None)
    have = (words[:, None] * p).sum(0)
    x, want = np.ones(50), np.array(targets) * have[0] / 0.5
    for _ in range(3000):
        x = np.maximum(0, x - p @ (((x * words) @ p - want) / have))
    assert np.allclose(wanted, want)
    assert np.allclose((x * words) @ p, now, rtol=0.01), ((x * words) @ p, now, wanted)
    assert np.allclose([r[0] for r in rows.select(rate.alias("r")).collect()], x, atol=0.02)


def test_nulls_empty_tables_and_no_labels(spark, documents):
    labels = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, domain string")
    assert mixing.mixed(documents([]), labels, MIX, anchor="good").count() == 0
    found = mixing.mixed(documents([(1, None), (2, ""), (None, "a b"), (2, "")]), labels.filter("false"), MIX, anchor="good").collect()
    assert sorted(r.n_words for r in found) == [0, 0, 0, 2] and all(abs(r.p_good + r.p_bad - 1) < 1e-9 for r in found)


def test_no_python_in_the_plan(tables):
    docs, labels = tables
    plan = mixing.posteriors(docs.selectExpr("doc_id AS _id", "text AS _text"), labels.selectExpr("doc_id AS _id", "domain"), ["bad", "good"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_long_texts_and_repeated_rows(spark, documents, prose):
    labels = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, domain string")
    found = mixing.mixed(documents([(1, prose(30)), (2, "foul " * 300_000), (3, "same text"), (3, "same text")]), labels, MIX, anchor="good").collect()
    assert sorted(r.n_words for r in found) == [2, 2, 30, 300_000]
    twice = [r for r in found if r.doc_id == 3]
    assert len(twice) == 2 and twice[0].copies == twice[1].copies


def test_missed_totals_are_reported(spark, documents, prose):
    labels = spark.createDataFrame([(k, "good" if k < 30 else "bad") for k in range(40)], "doc_id long, domain string")
    docs = documents([(k, prose(30) + ("" if k < 30 else " rotten foul")) for k in range(40)])
    with pytest.warns(UserWarning, match="misses its wanted totals"):
        mixing.mixed(docs, labels, {"good": 0.3, "bad": 0.7}, anchor="good", max_rate=1.0)
