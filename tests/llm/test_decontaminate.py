"""Decontamination against a plain version, and its cases."""

import re
import time

import numpy as np
import pytest

from tessera.llm import decontaminate, near_duplicates
from tessera.llm.common import HotTexts, hashed_text
from tessera.llm.decontaminate import NUMBER_WORDS, UNITS, Settings

ITEM = "a farmer has 12 apples and gives 5 apples to his friend Maria before lunch today"
LONG = "In the old town a baker named Otto sells fresh bread each morning and late in the evening when the market closes for the night he walks with Otto the dog along the river to his home"
DENSE = ["12 plus 7 is 19 and 19 minus 4 is 15 and 15 plus 8 is 23", "The guests were Anna Berta Clara Dora Emma Frida Greta Hanna Ida and Julia", "Born 4 May 1871 in Riga, died 1930"]
PART = "a farmer has 12 apples and gives 5 apples to his friend before lunch today then he adds 7 and 9 and 4 and 12 and 5"
ROLES = "first 3 then 4 and 3 or 4 as 3 with 4 go on to the very last of them"
ITEMS = [(1, ITEM), (2, LONG), *enumerate(DENSE, 3), (6, PART), (7, ROLES), (8, "prime"), (9, "7 9"), (10, ITEM), (11, None), (12, "..."), (13, "the boat is green")]

CASES = [  # a text, and the items that it holds
    (ITEM, {1, 10}),
    ("Now: a farmer has 70 apples and gives 31 apples to his friend Peter before lunch today", {1, 10}),
    ("a farmer has 5 apples and gives 5 apples to his friend Maria before lunch today", {1, 10}),
    ("nothing of this kind is in here at all, it is another text about farmers and apples", set()),
    (LONG.replace("Otto the", "Hugo the"), {2}),
    (LONG.replace("named Otto", "named Hugo"), {2}),
    *[(f"some words before it {t} and some after it", {i}) for i, t in enumerate(DENSE, 3)],
    ("13 plus 9 is 22 and 22 minus 5 is 17 and 17 plus 2 is 19", set()),
    ("The guests were Karl Otto Paul Max Hugo Ernst Fritz Hans Kurt and Emil", set()),
    (PART.replace("12 apples", "70 apples").replace("5 apples", "31 apples"), {6, 1, 10}),
    (ROLES, {7}),
    ("prime", {8}),
    ("Prime!", {8}),
    ("a prime number", set()),
    ("7 9", {9}),
    ("7 9 10", set()),
    ("we saw that the boat is green and old", {13}),
    (None, set()),
    ("", set()),
]


def plain(text):
    """(word, value, kind) of each word."""
    out, begins = [], True
    for m in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]", text or ""):
        low = m.lower()
        if m in ".!?:\n":
            begins = True
            continue
        kind = 2 if m[0].isdigit() or low in NUMBER_WORDS else 3 if low in UNITS and out and out[-1][2] == 2 else 1 if m[0].isupper() and m[1:] == low[1:] and len(m) > 1 and not begins and low not in UNITS else 0
        out.append((f"<{kind}>" if kind else low, low, kind))
        begins = False
    return out


def agree(item, doc, places, shift):
    there, back = {}, {}
    for p in places:
        if item[p][2]:
            if there.setdefault(item[p][1], doc[p + shift][1]) != doc[p + shift][1]:
                return False
            if item[p][2] == 1 and back.setdefault(doc[p + shift][1], item[p][1]) != item[p][1]:
                return False
    return True


def plainly(doc_text, item_text):
    doc, item, s = plain(doc_text), plain(item_text), Settings()
    size = min(8, len(item))
    if not size or size < 3:
        return bool(size) and [w[1] for w in doc] == [w[1] for w in item]
    need = 5 if size == 8 else min(5, max(3, size - 2))
    forms = [item] + ([[("<1>", item[0][1], 1), *item[1:]]] if item[0][2] == 0 and item_text[0].isupper() else [])
    covered, longest = set(), 0
    for shift in range(-len(item), len(doc)):
        hits = []
        for p in range(len(item) - size + 1):
            if 0 <= p + shift and p + shift + size <= len(doc):
                for form in forms[: 1 + (p == 0)]:
                    a, b = form[p : p + size], doc[p + shift : p + shift + size]
                    dense = [sum(w[2] == 0 for w in x) < need for x in (a, b)]
                    if dense[0] == dense[1] and all(x[dense[0]] == y[dense[0]] for x, y in zip(a, b)) and agree(form, doc, range(p, p + size), shift):
                        hits.append((p, form))
        best = set()
        for i in range(len(hits)):
            for j in range(i, len(hits)):
                places = {q for p, _ in hits[i : j + 1] for q in range(p, p + size)}
                form = hits[i][1]
                if agree(form, doc, sorted(places), shift):
                    best = max(best, places, key=len)
                    run = max(len(r) for r in re.findall("1+", "".join("01"[q in places] for q in range(len(item)))))
                    longest = max(longest, run)
        covered |= best
    return len(covered) >= s.coverage * len(item) or longest >= s.run


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    texts = [t for t, _ in CASES]
    for _ in range(60):  # pieces of items, with words exchanged, in other text
        item = [t for _, t in ITEMS if t and len(t.split()) > 7][int(rng.integers(0, 7))].split()
        low = int(rng.integers(0, 6))
        piece = item[low : low + int(rng.integers(4, 30))]
        for _ in range(int(rng.integers(0, 4))):
            piece[int(rng.integers(0, len(piece)))] = ["5", "12", "Otto", "Maria", "apples", "river"][int(rng.integers(0, 6))]
        texts.append(" ".join(["so", "it", "was"][: int(rng.integers(0, 4))] + piece + ["and", "then", "we", "left"]))
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, item long"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("settings", [Settings(), Settings(filter_bits=8, common=0, salt=2)])
def test_against_a_plain_version(tables, settings):
    rows, docs, benchmark = tables
    found = sorted((r["doc_id"] or -1, r["item_id"]) for r in decontaminate.find(docs, benchmark, settings).collect())
    wanted = sorted((d or -1, i) for d, text, _ in rows for i, item in ITEMS if plainly(text, item))
    assert found == wanted
    kept = sorted(r["text"] or "" for r in decontaminate.clean(docs, benchmark, settings).collect())
    assert kept == sorted(text or "" for _, text, _ in rows if not any(plainly(text, item) for _, item in ITEMS))


def test_cases(tables):
    rows, docs, benchmark = tables
    items = dict(ITEMS)
    for text, wanted in CASES:
        assert {i for i, item in items.items() if plainly(text, item)} == wanted, text


def test_values_and_runs():
    memo, s = decontaminate.Words(), Settings()
    t = decontaminate.template(["Pay 3 km", None, "Bob saw 4 km and Rita"], memo)
    assert t.begins.tolist() == [0, 3, 3, 9] and t.slot.tolist() == [0, 2, 3, 0, 0, 2, 3, 0, 1]
    one = {h for at, hs in decontaminate.windows(t, 3, s) for h in hs.tolist()}
    alone = decontaminate.template(["Bob saw 4 km and Rita"], memo)
    assert {h for at, hs in decontaminate.windows(alone, 3, s) for h in hs.tolist()} < one


def test_slices_are_one_text(monkeypatch):
    text, s = " ".join(f"word{'abcdef'[i % 6]} {i} and" for i in range(500)), Settings()
    t = decontaminate.template([text], decontaminate.Words())
    whole = [x for at, h in decontaminate.windows(t, 8, s) for x in zip(at.tolist(), h.tolist())]
    monkeypatch.setattr(decontaminate, "SLICE", 37)
    assert [x for at, h in decontaminate.windows(t, 8, s) for x in zip(at.tolist(), h.tolist())] == whole


def test_many_copies_of_one_item(spark):
    """Every document quotes one item: the windows' hashes are as skewed as can be."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", f"concat('Note ', id, ': {ITEM}') AS text")
    found = decontaminate.find(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string"), Settings(salt=1000))
    assert found.selectExpr("count(*)", "count(distinct doc_id)").first()[:] == (30_000, 30_000)


def test_a_text_that_repeats_an_item(spark):
    """Each repetition is a diagonal of its own; a fifth of the item on many diagonals is no more than that."""
    words = ITEM.split()
    texts = [(1, f"{ITEM} so. " * 2_000), (2, " ".join([*words[:8], "so it was then."] * 2_000)), (3, ITEM)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find(docs, spark.createDataFrame(ITEMS[:1], "item_id long, text string")).collect()}
    assert all(found[i]["coverage"] == 1 and found[i]["longest_run"] == len(words) and found[i]["verbatim"] for i in (1, 3))
    assert (2 in found) == plainly(" ".join([*words[:8], "so it was then."] * 3), ITEM)


def test_very_many_rows_of_one_text(spark):
    """500,000 rows of one text, dealt over tasks in the last join, with null and equal ids among them."""
    docs = spark.range(500_000).selectExpr("if(id % 3 = 0, null, id % 1000) AS doc_id", f"if(id % 5 = 0, '', '{ITEM}') AS text")
    benchmark = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    began = time.perf_counter()
    assert decontaminate.find(docs, benchmark).count() == 400_000
    assert decontaminate.clean(docs, benchmark).count() == 100_000
    assert near_duplicates.classes(docs).groupBy("class_size").count().orderBy("count").collect() == [(100_000, 100_000), (400_000, 400_000)]
    assert time.perf_counter() - began < 240


def test_hot_texts_are_split(spark):
    rows = spark.createDataFrame([(i, "a" if i < 3_500 else f"b{i}") for i in range(4_000)], "doc_id long, text string").select("doc_id", *hashed_text())
    hot = HotTexts(rows.groupBy("_h1", "_h2").count().withColumnRenamed("count", "_n"), 4_000)
    assert [r["_salts"] for r in hot.hot.collect()] == [4]
    texts = rows.where("doc_id in (1, 3600, 3700)").select("_h1", "_h2", "doc_id").withColumnRenamed("doc_id", "other")
    assert hot.join(rows, texts).groupBy("other").count().orderBy("other").collect() == [(1, 3_500), (3600, 1), (3700, 1)]
    assert hot.join(rows, texts, "left_anti").count() == 498
