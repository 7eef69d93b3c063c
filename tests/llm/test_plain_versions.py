"""Fingerprints and the two classifiers against plain versions, ties, and texts that are read in slices."""

import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, fingerprint, language, near_duplicates, quality, repeats
from tessera.llm.common import Memo

M = (1 << 64) - 1
RNG = np.random.default_rng(5)
WORDS = ["stone", "ärger", "réseau", "naïve", "один", "два", "水", "lamp", "river", "42", "q!", "Straße", "the", "of"]


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words, n))


def mixed(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & M
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & M
    return x ^ x >> 33


def plain_fingerprint(text):
    """Code point by code point: a piece ends where the hash of the last seven points falls on the block size."""
    if not text:
        return "3::"
    points = [mixed(ord(c) + 1) for c in text]

    def signs(block):
        out, piece, power, fresh = [], 0, 1, True
        for i, v in enumerate(points):
            piece, power, fresh = (piece + v * power) & M, power * 0x5851F42D4C957F2D & M, False
            rolled = mixed(sum(points[i - k] << 5 * k for k in range(min(7, i + 1))) & M)
            if rolled % block == block - 1 and len(out) < 127:
                out.append(piece)
                piece, power, fresh = 0, 1, True
        return "".join(fingerprint.SIGNS[mixed(p) >> 58] for p in out + [piece] * (not fresh))

    block = 3
    while block * 64 < len(text):
        block *= 2
    while block > 3 and len(signs(block)) < 32:
        block //= 2
    return f"{block}:{signs(block)}:{signs(2 * block)}"


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 50)
    monkeypatch.setattr(repeats, "AT_ONCE", 7)


TEXTS = ["", "a", "aaaaaaaaaa", "x" * 400, " ", prose(3), prose(30), prose(200), prose(700), "\U0001f600" * 5 + "é", "a\udc80b"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_code_point_by_code_point(text):
    assert fingerprint.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_in_slices(text, small_slices):
    assert fingerprint.fingerprint(text) == plain_fingerprint(text)


def test_slices_cut_no_word(small_slices):
    for text in [*TEXTS, "\n\n".join(TEXTS[5:9]), "one two\x1fthree " * 20]:
        parts = list(common.slices(text))
        assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
        assert all(p[0].isspace() for p in parts[1:])


def test_features_in_slices(monkeypatch):
    text, settings = prose(500), language.Settings()
    whole = [np.concatenate(f) for f in (quality.features(text, 18, Memo()), language.counts(text, settings))] + [near_duplicates.word_hashes(text, Memo())]
    monkeypatch.setattr(common, "SLICE", 50)
    sliced = [np.concatenate(f) for f in (quality.features(text, 18, Memo()), language.counts(text, settings))] + [near_duplicates.word_hashes(text, Memo())]
    assert all(np.array_equal(a, b) for a, b in zip(whole, sliced))


def test_words_of_a_chunk_in_slices(monkeypatch):
    import zstandard

    blob = " ".join(t.encode("utf-8", "surrogatepass").decode("latin-1") for t in TEXTS).encode("latin-1")
    args = np.zeros(1, np.int64).tobytes(), np.array([len(blob)], np.int64).tobytes(), zstandard.compress(blob)
    whole = repeats.Chunk(*args).words
    monkeypatch.setattr(repeats, "AT_ONCE", 7)
    assert len(whole) == len([w for w in blob.split() if w]) and np.array_equal(repeats.Chunk(*args).words, whole)


def test_long_texts_take_little_memory():
    text = prose(20_000) + " "
    text = text * (10_000_000 // len(text))  # ten million characters
    for work in (fingerprint.fingerprint, lambda t: language.counts(t, language.Settings()), lambda t: near_duplicates.word_hashes(t, Memo())):
        work(text[:100])
        tracemalloc.start()
        work(text)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 16 * len(text)


def plain_learn(rows, classes, alpha, l1, l2, passes, beta=1.0):
    """Weights (coordinate, class) by FTRL, one coordinate at a time; rows are (coordinates to values, label)."""
    z, n = {}, {}

    def weight(key):
        a, b = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - np.sign(a) * l1) / ((beta + b**0.5) / alpha + l2)

    rng = np.random.default_rng(7)
    for _ in range(passes):
        for r in rng.permutation(len(rows)):
            x, label = rows[r]
            outs = [sum(v * weight((i, c)) for i, v in x.items()) for c in range(classes)]
            if classes == 1:
                errors = [1 / (1 + np.exp(-outs[0])) - label]
            else:
                e = [np.exp(o - max(outs)) for o in outs]
                errors = [v / sum(e) - (c == label) for c, v in enumerate(e)]
            steps = [((i, c), v * errors[c]) for i, v in x.items() for c in range(classes)]
            steps = [(k, g, weight(k)) for k, g in steps]
            for k, g, w in steps:
                before = n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (n[k] ** 0.5 - before**0.5) / alpha * w
    return {k: weight(k) for k in z}


def plain_quality(text):
    tokens = [xxhash.xxh64_intdigest(t.encode()) for t in quality.TOKEN.findall(text or "")]
    keys = tokens + [(a * 0x9E3779B97F4A7C15 + b) & M for a, b in zip(tokens, tokens[1:])]
    count = {}
    for k in keys:
        at = mixed(k) >> 46
        if at:
            count[at] = count.get(at, 0) + 1
    x = {at: np.log1p(c) for at, c in count.items()}
    norm = sum(v * v for v in x.values()) ** 0.5
    return {0: 1.0} | {at: v * 4 / norm for at, v in x.items()}


def test_quality_against_a_plain_version(spark):
    good, bad = ["stone", "lamp", "river", "the", "of"], ["q!", "42", "buy", "now", "$$$"]
    data = [(i, prose(12, good if i % 2 else bad)) for i in range(60)] + [(60, None), (61, ""), (62, "the of"), (62, "the of")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (60, None)], "doc_id long, quality int")
    out = [(r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in quality.classify(docs, labels).collect()]
    held = {r["doc_id"] for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()}
    train = [(plain_quality(t), 0 if i == 3 else i % 2) for i, t in data[:60] if i not in held]
    w = plain_learn(train, 1, 0.5, 0.01, 0.1, 3)
    plain = {t: 1 / (1 + np.exp(-sum(v * w.get((k, 0), 0.0) for k, v in plain_quality(t).items()))) for _, t in data}
    assert sorted(i for i, *_ in out) == sorted(i for i, _ in data)
    for i, held_out, score, predicted in out:
        assert held_out == (i in held) and score == pytest.approx(plain[dict(data)[i]], abs=1e-4) and predicted == (score >= 0.5)


def gram(points):
    h = len(points) * 0x9E3779B1 & 0xFFFFFFFF
    for p in points:
        h = (h ^ p) * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 15
    return (h * 0xC2B2AE35 & 0xFFFFFFFF) >> 18


def plain_counts(text):
    points, out = [ord(c) for c in text.lower()], {}
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            k = gram(points[i : i + n])
            out[k] = out.get(k, 0) + 1
    return out


def test_language_against_a_plain_version(spark):
    spoken = {"en": ["stone", "lamp", "river", "the"], "fr": ["réseau", "naïve", "pierre", "le"], "ru": ["один", "два", "река", "и"]}
    data = [(i, prose(6, spoken[l]), l) for i in range(66) for l in [("en", "fr", "ru")[i % 3]]]
    data += [(90, None, "en"), (91, "", "fr"), (92, "½ 12 ②", "ru"), (93, "the lamp", None), (94, "то да", "ru"), (94, "то да", "ru")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    settings = language.Settings()
    out = language.identify(docs).collect()
    model = language.fit(docs, use=~common.held_out())

    train = [(t, l) for i, t, l in data if l and language.has_letter(t or "") and i not in {r["doc_id"] for r in out if r["held_out"]}]
    df = {}
    for t, _ in train:
        for k in plain_counts(t):
            df[k] = df.get(k, 0) + 1
    idf = lambda k: np.log((1 + len(train)) / (1 + df.get(k, 0))) + 1
    assert model.languages == sorted(spoken) and all(model.idf[k] == pytest.approx(idf(k)) for k in range(0, 1 << 14, 17))

    def vector(t):
        x = {k: np.log1p(c) * idf(k) for k, c in plain_counts(t).items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        return {k: v * 4 / norm for k, v in x.items()}

    hashed = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = sorted({(hashed[t], model.languages.index(l), t) for t, l in train})
    rows = [(vector(t), y) for _, y, t in rows]
    learn, check = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    w = plain_learn(learn, 3, 0.3, 0.02, 0.1, settings.passes)
    outs = lambda x: np.array([sum(v * w.get((k, c), 0.0) for k, v in x.items()) for c in range(3)])
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    temperature = min(np.geomspace(0.2, 5, 33), key=lambda t: -sum(np.log(soft(outs(x) / t)[y]) for x, y in check))
    assert model.temperature == pytest.approx(temperature)
    for r in out:
        text = {i: t for i, t, _ in data}[r["doc_id"]]
        if language.has_letter(text or ""):
            p = soft(outs(vector(text)) / temperature)
            assert r["lang_pred"] == model.languages[int(p.argmax())] and r["score"] == pytest.approx(p.max(), abs=1e-4)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_ties_between_languages(spark):
    """Equal texts under two languages teach both the same, up to the order of updates; the result is the same each time."""
    docs = spark.createDataFrame([(i, f"stone lamp {i // 2 % 5}", ("aa", "bb")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    first, again = (sorted(map(tuple, language.identify(d).collect())) for d in (docs, docs.repartition(7)))
    assert first == again and {r[2] for r in first} <= {"aa", "bb"}
    even = language.Model(["aa", "bb"], np.ones(1 << 14), np.zeros((1 << 14, 2), np.float32), 1.0, language.Settings())
    assert [tuple(r[0]) for r in docs.limit(2).select(language.predict(F.col("text"), even)).collect()] == [("aa", 0.5)] * 2


def test_ties_between_near_duplicates(spark):
    """Ids and texts that are equal: the smallest id names the class and one row of it stays, in any order of the rows."""
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(7, text), (3, text), (3, text), (5, text), (9, "other words stand here alone")], "doc_id long, text string")
    for d in (docs, docs.orderBy(F.desc("doc_id")), docs.repartition(5)):
        assert sorted(map(tuple, near_duplicates.classes(d).collect())) == [(3, 3, 4), (3, 3, 4), (5, 3, 4), (7, 3, 4), (9, 9, 1)]
        assert sorted(r["doc_id"] for r in near_duplicates.distinct_documents(d).collect()) == [3, 9]
