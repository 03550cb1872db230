"""Quality and toxicity: held-out accuracy, and what they do with little or odd input."""

import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import rule_ensemble, severity
from sluice.llm.queries import QUERIES
from tests.conftest import DATA


def test_quality_holds_out_a_third(spark):
    folder = f"{DATA}/sf0.01"
    scored = QUERIES["op1_quality_rules"](spark, folder)
    assert scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark, documents, labels, odd, none):
    model = rule_ensemble.fit(documents, labels, "quality")
    out = rule_ensemble.score(odd, model)
    assert out.count() == odd.count() and set(out.columns) == {*odd.columns, "predicted"}
    assert out.where("score is null or predicted is null").isEmpty() and rule_ensemble.score(none, model).collect() == []
    nothing = rule_ensemble.fit(documents, labels.limit(0), "quality")
    assert nothing.rules == () and rule_ensemble.score(odd, nothing).where("score = 0.5").count() == odd.count()
    one = rule_ensemble.fit(documents, labels.withColumn("quality", F.lit(1)), "quality")
    assert one.rules == () and one.intercept > 0


def test_rules_compile_to_what_they_hold_for(spark, documents, labels):
    model = rule_ensemble.fit(documents, labels, "quality")
    stats = documents.select("doc_id", *(c.cast("double").alias(n) for n, c in rule_ensemble.statistics(F.col("text")).items())).toPandas().sort_values("doc_id")
    x = {n: stats[n].to_numpy() for n in stats.columns[1:]}
    total = model.intercept + sum(w * r.holds(x) for r, w in model.rules)
    got = rule_ensemble.score(documents, model).orderBy("doc_id").toPandas()["score"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-total)))


def plain_statistics(text):
    """The counted statistics as plain Python reads them."""
    words = text.split()
    upper, lower = (lambda c: unicodedata.category(c) == "Lu"), (lambda c: unicodedata.category(c) == "Ll")
    symbol = lambda c: unicodedata.category(c)[0] not in "LN" and not c.isspace()
    return {
        "capital_words": sum(any(upper(a) and upper(b) for a, b in zip(w, w[1:])) and not any(map(lower, w)) for w in words),
        "symbol_runs": sum(len(w) > 1 and w[-1] == w[-2] and symbol(w[-1]) for w in words),
        "alone_symbols": sum(all(map(symbol, w)) for w in words),
        "repeated_words": sum(a == b for a, b in zip(words, words[1:])),
    }


def test_statistics_are_what_they_say(spark):
    texts = ["THE end of ABC-1 aB Abc XY9 9XY", "a == b ===x =- -- !! (( x!! é!!", "so so so the the end", "ÄÖ ÄöÜ 中文 ÉÉ1 123 12", "", "A B CC D EEe"]
    columns = [c.alias(n) for n, c in rule_ensemble.statistics(F.col("text")).items()]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", *columns).collect():
        n = max(1, len(r["text"].split()))
        assert {k: round(r[k] * n) for k in plain_statistics("")} == plain_statistics(r["text"])


def test_statistics_of_a_megabyte_take_seconds(spark):
    """Numbers, text without small letters or spaces, ruled lines, one word, one letter: none may take quadratic time."""
    size = 1 << 20
    texts = ["123 " * (size // 4), "中文字" * (size // 3), "=" * size + "x", "= " * (size // 2), "A" * size, "a" * size, "AB" * (size // 2) + "c", "-=" * (size // 2) + " ", "x " * (size // 2), "\n" * size]
    model = rule_ensemble.RuleEnsemble(0.0, tuple((rule_ensemble.Rule(((n, True, 0.1),)), 1.0) for n in rule_ensemble.statistics(F.lit(""))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    assert len(rule_ensemble.score(docs, model).collect()) == len(texts)
    assert time.perf_counter() - began < 60


def test_repeated_ids_are_one_sampled_row(spark, documents, labels):
    from sluice.llm.common import labelled_sample

    many = documents.unionByName(documents).unionByName(documents.withColumn("text", F.lit(None).cast("string")))
    assert labelled_sample(many, labels, "quality", 50, [F.length("text").alias("n")]).count() <= 50
    once, thrice = (severity.fit(d, labels, "toxic") for d in (documents, documents.unionByName(documents)))
    assert once == thrice


def test_lasso_finds_the_one_that_matters():
    rng = np.random.default_rng(2)
    z = rng.integers(0, 2, (2000, 12)).astype(float)
    y = (rng.random(2000) < np.where(z[:, 3] > 0, 0.9, 0.1)).astype(float)
    _, w = rule_ensemble.lasso_logistic(z, y, 0.02)
    assert w[3] > 1 and np.abs(np.delete(w, 3)).max() < 0.1


def test_toxicity_is_found(spark):
    folder = f"{DATA}/sf0.01"
    rows = QUERIES["op5_toxicity_severity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert np.mean([r["predicted"] for r in toxic]) >= 0.9 and sum(r["predicted"] for r in clean) == 0
    assert {r["grade"] for r in toxic} >= {1, 2, 3} and all(0 <= r["severity"] <= severity.GRADES for r in rows)


def test_toxicity_of_rows_held_out(spark):
    folder = f"{DATA}/sf0.1"
    docs, known = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = severity.fit(docs, known.where(~held_out), "toxic")
    rows = severity.score(docs.join(known.where(held_out).select("doc_id", "toxic"), "doc_id"), model).collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) > 30 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01


def test_toxicity_of_odd_rows(documents, labels, odd, none):
    model = severity.fit(documents, labels, "toxic")
    out = severity.score(odd, model)
    assert out.count() == odd.count() and out.where("predicted != 0").isEmpty()
    assert [c for c in out.columns if c not in ("severity", "grade", "score", "predicted")] == [c for c in odd.columns if c != "score"]
    assert severity.score(none, model).collect() == []
    assert severity.score(documents, severity.fit(documents, labels.limit(0), "toxic")).where("predicted != 0").isEmpty()


def test_grades_rise_with_the_value():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    latent = 6 * x[:, 0] + rng.logistic(size=3000)
    grade = np.searchsorted([2.0, 3.0, 4.5], latent)
    theta, w = severity.fit_cumulative(x, grade, 3, penalty=0.001)
    assert np.all(np.diff(theta) > 0) and w[0] > 3 and np.abs(w[1:]).max() < 1
    p = severity.Severity(tuple(theta), {}).grade_probabilities(np.array([0.0, 3.0, 6.0]))
    assert np.allclose(p.sum(axis=1), 1) and np.all(np.diff(p @ np.arange(4)) > 0)


@pytest.mark.parametrize("texts", [["", "idiot", "Idiots! idiotic"]])
def test_words_and_stems_count(texts):
    model = severity.Severity((1.0, 2.0, 3.0), {"idiot": 1.0, "idio*": 0.5})
    assert np.allclose(model.values(texts), [0, 1.5 * np.log(2), 0.5 * np.log(3)])
