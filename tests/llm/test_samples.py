"""What bounded samples must not lose: languages with few texts, labelled documents among many other labels, small sources."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language, mixing, quality


def test_a_language_of_few_repeated_texts_is_learnt(spark):
    rng = np.random.default_rng(1)
    english = ["the", "of", "house", "river", "stone", "under", "walks", "light"]
    rows = [(i, " ".join(rng.choice(english, 12)), "en") for i in range(3000)]
    rows += [(3000 + i, ["zqaz wuxq kzzy", "qqzx yyxw zkkq", "xwzy qkzx wwyq"][i % 3], "xx") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(docs).groupBy(F.col("doc_id") >= 3000, "lang_pred").count().collect()
    assert {(r[0], r["lang_pred"]): r["count"] for r in found} == {(False, "en"): 3000, (True, "xx"): 9000}


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    rows = [(i, "good words here now" if i % 2 else "bad spam offer click", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    others = spark.range(1000, 60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    setting = quality.Settings(sample=150)
    weights = quality.fit(docs, labels.unionByName(others), settings=setting)
    found = docs.select((F.col("doc_id") % 2).alias("y"), (quality.score(F.col("text"), weights, setting) >= 0.5).alias("p")).distinct().collect()
    assert sorted(map(tuple, found)) == [(0, False), (1, True)]


def test_features_of_the_sample_are_bounded(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, " ".join(map(str, range(5000))))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    part, whole = quality.fit(docs, labels, settings=quality.Settings(values=100)), quality.fit(docs, labels)
    assert 0 < np.count_nonzero(part) < 30 < 1000 < np.count_nonzero(whole)


def test_sources_beyond_the_largest_are_wanted_alike(spark):
    rows = [(i, "some plain words of a text that goes on", "en", f"s{i % 60:02}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    shares = mixing.plan(mixing.measured(docs), mixing.Targets()).shares[0]
    assert len(shares) == 33 and np.allclose(shares[:32], 1 / 60) and np.isclose(shares[32], 28 / 60)
