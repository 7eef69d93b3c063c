"""Packing, centroid clustering and fill-in-middle against plain versions, on odd rows and as registered queries."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import fim, packing, yinyang
from tessera.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, row string, n long, _k long, _text string"
ODD = [
    (1, "one two three\nfour five \U0001f600 six\n", None, "x", 3, 4, "t"),
    (2, None, "en", None, None, None, None),
    (3, "", "en", "x", 0, 0, ""),
    (4, "a", "en", "x", 0, 0, ""),
    (5, "mark <S> here", "en", "x", 0, 0, ""),
    (6, "word " * 40_000, "en", "x", 0, 0, ""),
    (6, "word " * 40_000, "en", "x", 0, 0, ""),
    (6, "another text of the same id", "en", "x", 0, 0, ""),
    (None, "no id at all", "en", "x", 0, 0, ""),
    (None, None, None, None, None, None, None),
    (7, "é" * 1024, "fr", "x", 0, 0, ""),
    (8, "水" * 2049, "fr", "x", 0, 0, ""),
    (9, "ends here<|endoftext|> and goes on", "en", "x", 0, 0, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def same_as_sql(spark, name):
    mine, con = QUERIES[name](spark, SF).toPandas(), duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs, columns = con.execute(SQL[name]).df(), sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    rows = lambda df: Counter(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)))
    assert rows(mine) == rows(theirs)


# Fill-in-middle


def plain_fim(doc_id, text, units=list):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = units(text)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def words(text):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and not text[end].isspace():
            end += 1
        while end < len(text) and text[end].isspace():
            end += 1
        out.append(text[at:end])
        at = end
    return out


UNITS = {"code_points": (fim.CODE_POINTS, list), "words": (fim.WORDS, words), "lines": (fim.LINES, lambda t: t.splitlines(keepends=True))}


@pytest.mark.parametrize("unit", UNITS)
def test_fim_of_odd_rows(odd, unit):
    how, units = UNITS[unit]
    setting = fim.Settings(unit=how)
    out = fim.transform(odd, setting).withColumn("restored", fim.restored(F.col("output"), F.col("form"), setting)).collect()
    found = sorted((repr(tuple(r["row"])), (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in out)
    assert found == sorted((repr(r), plain_fim(r[0], r[1], units)) for r in ODD)
    assert all(r["restored"] == (r["row"]["text"] or "") for r in out)


@pytest.mark.parametrize("size", [1, 3])
def test_fim_runs_of_any_size(spark, size):
    unit = fim.Unit("(?s).", f"(?s).{{1,{size}}}", size)
    rows = [(i, "ab\ncdé\U0001f600 <M"[: i % 12] * (1 + i % 3)) for i in range(60)]
    out = {r["row"]["doc_id"]: r["output"] for r in fim.transform(spark.createDataFrame(rows, "doc_id long, text string"), fim.Settings(unit=unit)).collect()}
    assert out == {i: plain_fim(i, t)[4] for i, t in rows}


def test_fim_none(odd):
    assert fim.digests(odd.where("false")).count() == 0


def test_fim_query(spark):
    same_as_sql(spark, "op13_fill_in_middle")
    forms = {r["form"]: r["count"] for r in QUERIES["op13_fill_in_middle"](spark, SF).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm", "spm"}


# Packing


def check_packed(rows, texts, capacity=2048):
    """rows: of one document id each; every id of every text is in exactly one piece, and sequences are gapless."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by) == set(texts)
    for i, parts in by.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return padding / (padding + total)


def test_packing_query(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert check_packed(QUERIES["op11_packing"](spark, SF).collect(), texts) < 0.02


def test_packing_more_workers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    packed = packing.pack(docs.repartition(7, "doc_id"), packing.public(), with_ids=False)
    assert check_packed(packed.collect(), dict(docs.collect())) < 0.015


def test_packing_odd_rows(odd):
    rows = [r.asDict() for r in packing.pack(odd, packing.public(), with_ids=False).collect()]
    once = [r for r in rows if r["doc_id"] in (1, 2, 3, 4, 5, 7, 8, 9)]
    assert {r["doc_id"]: r["doc_tokens"] for r in once if r["doc_id"] in (2, 3)} == {2: 1, 3: 1}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sum(len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ODD)
    assert sum(r["length"] for r in rows) == wanted
    places = [(r["sequence_id"], r["offset"] + k) for r in rows for k in range(r["length"])]
    assert len(places) == len(set(places))  # repeated rows too have places of their own
    assert 50256 in tokenizer.encode(ODD[-1][1], add_special_tokens=False).ids
    assert packing.pack(odd.where("false"), packing.public()).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "some words of text " * (i * 7 % 50)) for i in range(80)], "doc_id long, text string")
    packed = packing.pack(docs, packing.public(capacity=64)).cache()
    made = {r["sequence_id"]: (r["ids"], r["tokens"]) for r in packing.sequences(packed, 64).collect()}
    for ids, tokens in made.values():
        assert len(ids) == (tokens if tokens & (tokens - 1) == 0 else 64) and not any(ids[tokens:])
    for r in packed.collect():
        assert made[r["sequence_id"]][0][r["offset"] : r["offset"] + r["length"]] == r["ids"]


@given(st.integers(1, 20_000), st.integers(2, 4096), st.floats(0, 0.2))
@settings(max_examples=300, deadline=None)
def test_lengths(n, capacity, slack):
    parts = packing.lengths(n, capacity, slack)
    assert sum(parts) == n and all(0 < p <= capacity for p in parts)
    assert all(p == capacity for p in parts[: n // capacity])
    for p in parts:
        empty = capacity - capacity // p * p
        assert empty <= max(slack * capacity, capacity // p)  # a cut part leaves less than a token a piece


RANKS, WHOLE = packing._encoder(packing.public()), packing._encoder(packing.public(ranks=None))


@given(st.text(max_size=80) | st.text(alphabet="ab 'sS\n\t\r1٣²é水 ​\U0001f600_-.<|>", max_size=80))
@settings(max_examples=1500, deadline=None)
def test_ranks_give_the_vocabulary_ids(text):
    assert RANKS(text).tolist() == WHOLE(text).tolist()


# Centroid clustering


def plain_clusters(vectors, setting):
    """(cluster, distance) of each vector and the centroids, by full scans over Python integers."""
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.sha256(f"{setting.seed}:{vectors[i][0]}".encode()).hexdigest(), vectors[i][1]))
    centroids = [list(vectors[i][1]) for i in order[: setting.clusters]]
    x = [v for _, v in vectors]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    found = [nearest(v) for v in x]
    for _ in range(setting.rounds):
        for k in range(len(centroids)):
            own = [v for v, (_, c) in zip(x, found) if c == k]
            if own:
                centroids[k] = [sum(column) // len(own) for column in zip(*own)]
        found = [nearest(v) for v in x]
    return found, centroids


@pytest.mark.parametrize("kind", ["blobs", "ties", "large"])
def test_yinyang_is_exact(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "blobs":
        x = rng.integers(-60, 60, (9, 6))[rng.integers(0, 9, 600)] + rng.integers(-3, 4, (600, 6))
    elif kind == "ties":
        x = rng.integers(0, 3, (600, 6))
    else:
        x = rng.integers(-yinyang.LARGEST, yinyang.LARGEST, (600, 6))
    setting = yinyang.Settings(clusters=9, rounds=6, size=6, scale=1, per_group=3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, x array<int>")
    state, centroids = yinyang.cluster(vectors, yinyang.first_centroids(vectors, setting), setting)
    found, wanted = plain_clusters(rows, setting)
    out = {r["vec_id"]: (r["distance"], r["cluster"]) for r in state.collect()}
    assert out == dict(enumerate(found)) and centroids.tolist() == wanted


def test_yinyang_filters_leave_out_work():
    rng = np.random.default_rng(4)
    middles = rng.integers(-500, 500, (24, 8))
    x = middles[rng.integers(0, 24, 3000)] + rng.integers(-4, 5, (3000, 8))
    group = yinyang.grouped(middles, 4)
    state = yinyang.begun(x, middles, group)
    nearer = middles + rng.integers(-1, 2, middles.shape)
    shift = np.sqrt(((nearer - middles).astype(float) ** 2).sum(axis=1))
    state = yinyang.moved(x, state, nearer, shift, group, False)
    assert state[4].sum() < 0.05 * x.shape[0] * 24
    assert (state[0] == yinyang.squared(x, nearer).argmin(axis=1)).all()


def test_yinyang_odd_rows(spark):
    nan, inf, good = float("nan"), float("inf"), [0.25] * 64
    rows = [(1, good), (1, good), (2, None), (3, []), (4, [0.1] * 63), (5, [nan] + [0.0] * 63), (6, [inf] + [0.0] * 63), (7, [None] + [0.0] * 63), (None, [-0.5] * 64), (8, [1e30] + [0.0] * 63)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    out = yinyang.clustered(table).collect()
    assert sorted((r["vec_id"] or 0, r["distance"]) for r in out) == [(0, 0), (1, 0), (1, 0), (8, 0)]
    assert len({r["cluster"] for r in out if r["vec_id"] == 1}) == 1 and all(r["inertia"] == 0 for r in out)
    none = yinyang.clustered(table.where("false"))
    assert none.count() == 0 and none.columns == yinyang.clustered(table).columns


def test_yinyang_query(spark):
    same_as_sql(spark, "op12_clusters")
