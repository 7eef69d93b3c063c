"""Every text operator on null, empty, very long, repeated and clashing input, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, fingerprint, language, mixing, near_duplicates, pages, pii, quality, repeats, sharding

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and goes home again at night", "en", "a", 72),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "en", None, 4),
    (5, LONG, "de", "b", len(LONG)),
    (5, LONG, "de", "b", len(LONG)),
    (6, "The quick brown fox jumps over the lazy dog and goes home again at night", "en", "b", 72),
    (7, "1234 5678 @ ###", "fr", "c", 15),
    (None, "a text without an id", "en", "a", 20),
    (8, "\U0001f600 éè café 中文", "fr", "a", 12),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "size", "shard", "class_id", "kept", "row", "_h", "_id", "_k", "_first", "_held", "_tokens", "_p", "_0", "node", "key", "label")


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, SCHEMA)
    return out.withColumns({c: F.lit(f"x{c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 0), (5, 1, None), (6, None, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "quick brown fox jumps over the lazy dog and goes home")], "item_id long, text string")


def held(rows, *columns):
    return [tuple(r[c] for c in columns) for r in rows]


def test_pii(docs, none):
    settings = pii.Settings(steps=5, variants=50)
    rows = pii.find_spans(docs, settings).collect()
    assert len(rows) == len(ROWS) and all(r["n_ip"] == r["n_email"] == 0 for r in rows)
    assert {r["base_sha256"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    assert pii.find_spans(none, settings).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {16}
    assert sharding.shard(none, 4).count() == 0
    whole = sharding.assign(docs, 4)
    assert whole.count() == len(ROWS) and set(docs.columns) <= set(whole.columns)
    assert sharding.assign(none, 4).count() == 0


def test_repeats(docs, none):
    rows = {r["doc_id"]: r for r in repeats.remove(docs).collect()}
    assert rows[2]["n_words"] == rows[3]["n_words"] == rows[4]["n_words"] == 0
    assert rows[6]["n_removed"] == 0 and rows[1]["n_removed"] == 0  # shorter than a window
    fives = [r["n_removed"] for r in repeats.remove(docs).where("doc_id = 5").collect()]
    assert sorted(fives) == [0, 60_000]
    assert repeats.remove(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and {r["topic"] for r in rows if r["doc_id"] in (2, 3, 4)} == {"empty"}
    assert all(0 <= r["probability"] <= 1 for r in rows)
    assert mixing.mix(none).count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and all(r["_tokens"] == "x_tokens" for r in kept.collect())
    assert mixing.sample(none).count() == 0


def test_language(docs, none):
    rows = language.identify(docs).collect()
    assert len(rows) == len(ROWS)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if r["doc_id"] in (2, 3, 4, 7))
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_fingerprint(docs, none, spark):
    rows = fingerprint.compare_neighbours(docs).collect()
    assert len(rows) == len(ROWS)
    empty = next(r for r in rows if r["doc_id"] == 3)
    assert empty["n_chars"] == 0 and empty["fingerprint"] == "3::"
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 6)}) == 1
    assert fingerprint.compare_neighbours(none).count() == 0
    one = fingerprint.compare_neighbours(docs.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, lines string, _hash string"
    rows = [(1, "http://a.b/c", None, "x", "y", "z"), (2, None, "", "x", "y", "z"), (3, "http://a.b/d", "<p>Hello&amp;<b>you", "x", "y", "z"), (3, "http://a.b/d", "<p>Hello&amp;<b>you", "x", "y", "z"), (None, "odd url", "<nav>menu</nav>main  \n text<script>x</script>", "x", "y", "z")]
    found = pages.extract(spark.createDataFrame(rows, schema)).collect()
    texts = {}
    for r in found:
        texts.setdefault(r["page_id"], []).append(r["text"])
    assert texts == {1: [""], 2: [""], 3: ["Hello&you"] * 2, None: ["main text"]}
    assert pages.extract(spark.createDataFrame([], schema)).count() == 0


def test_near_duplicates(docs, none):
    rows = near_duplicates.classes(docs).collect()
    assert len(rows) == len(ROWS)
    group = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows}
    assert group[1] == group[6] == (1, 2) and group[5] == (5, 2) and group[2] == group[4] == (2, 3)
    assert near_duplicates.classes(none).count() == 0
    kept = near_duplicates.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(held(kept.collect(), "doc_id"), key=str) == sorted([(1,), (2,), (5,), (7,), (8,), (None,)], key=str)
    assert near_duplicates.distinct_documents(none).count() == 0


def test_decontaminate(docs, none, benchmark):
    assert sorted(held(decontaminate.find(docs, benchmark).collect(), "doc_id", "item_id")) == [(1, 4), (6, 4)]
    clean = decontaminate.clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 2
    assert decontaminate.find(none, benchmark).count() == 0
    assert decontaminate.find(docs, benchmark.where("false")).count() == 0
    assert decontaminate.clean(docs, benchmark.where("false")).count() == len(ROWS)


def test_quality(docs, none, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert {r["score"] for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_pipeline_stages(docs, none, labels, benchmark, spark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            kept = [c for c in table.columns if c not in sharding.COLUMNS]
            assert set(kept) <= set(out.columns) and out.count() <= table.count(), name
            if name != "sharding":
                assert out.columns == table.columns
