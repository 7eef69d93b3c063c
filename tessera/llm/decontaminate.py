"""Benchmark decontamination by template canonicalisation.

Texts become sequences of words in which numbers, units after a number, and names (capitalised words that begin no
sentence) are replaced by placeholders of their type. Windows of the benchmark's templates are hash-joined with those
of every document, as DataFrames. Matches on one diagonal (place in the document minus place in the item) are put
together into maximal runs whose slots agree: one value of the item stands for one value of the document throughout,
and two names of the item never for one of the document. Two numbers of the item may become the same one, as they do
by chance when a question is given other numbers. So a copied question is found, and so is one whose numbers and names
were exchanged. Windows with few plain words (arithmetic, lists of names) say too little as templates; they are joined
by the values that stand in the text.

A document matches an item if consistent windows cover `coverage` of the item's words or `run` words on end. Of the
runs of one diagonal that contradict each other the one that covers most counts.

Before the join a bit set of `filter_bits` bits (its size is a parameter and does not grow with the benchmark) drops
those windows of documents that no item has. Windows that more than `common` items share are joined only for pairs that
another window has found, unless an item can match by such windows alone; windows that many documents have are salted.
Matches are gathered by diagonal, of which each has at most one for each form and place of the item, so that a long text
that repeats an item is no large group; rows of one text with many copies are dealt over tasks in the last join.

Defined cases: null and empty texts match nothing; items of fewer than `window` words are one window of their own
length; those of one or two words match only a document that has no other words; items without words match nothing;
repeated items and documents each give their rows, also under null or equal ids; other columns are left as they are.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HotTexts, Memo, boxed, hashed_text, mix64, stored

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:\n]")
PLAIN, CAPITAL, NUMBER, BREAK, UNIT = range(5)
NAME_SLOT, NUMBER_SLOT, UNIT_SLOT = 1, 2, 3

# Words for numbers, and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons pound pounds lb lbs ounce ounces oz ml cl l liter liters litre litres gallon gallons cup cups second seconds sec s minute minutes min hour hours h day days week weeks month months year years percent degree degrees dollar dollars usd euro euros eur cent cents mph kmh watt watts w kw kwh volt volts v amp amps joule joules newton newtons hz khz mhz ghz byte bytes kb mb gb tb".split()
)

SLICE = 1 << 18  # words whose windows are hashed at once
LONG = 1 << 20  # code points that are canonicalised at once; a longer text goes alone


@dataclass(frozen=True)
class Settings:
    window: int = 8
    plain: int = 5  # words of a window that must be no placeholder
    coverage: float = 0.5
    run: int = 13
    filter_bits: int = 24
    common: int = 64
    salt: int = 200_000  # matches of one window that meet in a task


class Words(Memo):
    """token -> hash of its lower-case form with its class in the low three bits."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = PLAIN
        if token in ".!?:\n":
            kind = BREAK
        elif token[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif token[0].isupper() and token[1:] == low[1:] and len(token) > 1:
            kind = CAPITAL
        value = self[token] = self.hashed(low) & ~7 | kind
        return value


@dataclass(frozen=True)
class Template:
    """Words of several texts, one after the other."""

    values: np.ndarray  # hashes of what stands in the text
    slot: np.ndarray  # kind of placeholder, 0 for none
    begins: np.ndarray  # place of the first word of each text, and the end

    def words(self) -> np.ndarray:
        """Hashes with placeholders."""
        return np.where(self.slot > 0, self.slot.astype(np.uint64) + np.uint64(10), self.values)


def template(texts: Sequence[str | None], memo: Words) -> Template:
    t, sizes = array("Q"), []
    for text in texts:
        before = len(t)
        if text:
            t.extend(map(memo.__getitem__, TOKEN.findall(text) if len(text) < LONG else (m[0] for m in TOKEN.finditer(text))))
        sizes.append(len(t) - before)
    t = np.frombuffer(t, np.uint64) if t else np.zeros(0, np.uint64)
    kind = (t & np.uint64(7)).astype(np.int8)
    stop = kind == BREAK
    ends = np.cumsum([0, *sizes])
    first = np.concatenate([[True], stop[:-1]])[: len(t)]
    first[ends[:-1][np.array(sizes, dtype=np.int64) > 0]] = True
    words = np.concatenate([[0], np.cumsum(~stop)])
    t, kind, first = t[~stop], kind[~stop], first[~stop]
    after_number = np.concatenate([[False], kind[:-1] == NUMBER])[: len(t)]
    begins = words[ends]
    after_number[begins[:-1][begins[:-1] < len(t)]] = False
    slot = np.where((kind == CAPITAL) & ~first, NAME_SLOT, np.where(kind == NUMBER, NUMBER_SLOT, np.where((kind == UNIT) & after_number, UNIT_SLOT, 0))).astype(np.int8)
    return Template(t >> np.uint64(3), slot, begins)


def windows(t: Template, length: int, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (among all words) and hashes of the windows of `length` words that lie in one text: of the template, or of the values where plain words are few."""
    plain = settings.plain if length == settings.window else min(settings.plain, max(3, length - 2))
    number = np.searchsorted(t.begins, np.arange(len(t.values)), side="right") if length > 1 else None
    words, whole = t.words(), np.diff(t.begins)
    for low in range(0, max(0, len(words) - length + 1), SLICE):
        n = min(SLICE, len(words) - length + 1 - low)
        if length < 3:  # only texts that have no other words
            starts = t.begins[:-1][whole == length]
            at = starts[(starts >= low) & (starts < low + n)] - low
        else:
            at = np.flatnonzero(number[low : low + n] == number[low + length - 1 : low + length - 1 + n])
        slots = np.concatenate([[0], np.cumsum(t.slot[low : low + n + length - 1] > 0)])
        dense = length - (slots[at + length] - slots[at]) < plain
        h = np.where(dense, np.uint64(64 + length), np.uint64(length))
        by_word, by_value = mix64(words[low : low + n + length - 1]), mix64(t.values[low : low + n + length - 1])
        for k in range(length):
            h = (h ^ np.where(dense, by_value[at + k], by_word[at + k])) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
        yield at + low, h


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that a window sets."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


WINDOW = "hash long, item long, place int, length int, words int, slots binary, item_values binary"


def item_windows(benchmark: DataFrame, settings: Settings) -> DataFrame:
    """The windows of each distinct text of the benchmark; item: the text's hash."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for b in batches:
            out = []
            for item, text in zip(b["item"], b["text"]):
                t = template([text], memo)
                n = len(t.values)
                if not n:
                    continue
                length = min(settings.window, n)
                forms = [t]
                if not t.slot[0] and text.lstrip(" \n\t.!?:\"'([")[:1].isupper():  # where other words come before it, it looks like a name
                    forms.append(Template(t.values, np.concatenate([[NAME_SLOT], t.slot[1:]]).astype(np.int8), t.begins))
                low = t.values.astype(np.uint32)
                for k, form in enumerate(forms):
                    for at, h in windows(form, length, settings):
                        at, h = (at, h) if not k else (at[at == 0], h[at == 0])
                        out += [(hash_, item, p, length, n, form.slot[p : p + length].tobytes(), low[p : p + length].tobytes()) for p, hash_ in zip(at.tolist(), h.view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WINDOW.split(", ")])

    texts = benchmark.select("text").where(F.length("text") > 0).distinct()
    return texts.select(F.xxhash64("text").alias("item"), "text").mapInPandas(cut, WINDOW).dropDuplicates(["hash", "item", "place", "slots"])


def window_filter(cut: DataFrame, bits: int) -> np.ndarray:
    """The bit set of all windows, 2^bits bits: what comes to the driver is bounded by that."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(np.concatenate(_bits(b["hash"].to_numpy().view(np.uint64), bits)))
            yield pd.DataFrame({"at": at})

    out = np.zeros(1 << max(0, bits - 6), np.uint64)
    marked = cut.select("hash").mapInPandas(mark, "at long")
    words = marked.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("set")).toArrow()
    if words.num_rows:
        out[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return out.view(np.uint8)  # bits from the lowest on


def _in_filter(held: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    a, b = _bits(h, bits)
    return (held[a >> 3] >> (a & 7).astype(np.uint8) & 1 > 0) & (held[b >> 3] >> (b & 7).astype(np.uint8) & 1 > 0)


def _batches(texts: pd.Series) -> Iterator[range]:
    """Ranges of texts that are canonicalised together."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > LONG:
            yield range(low, i)
            low, size = i, 0
        size += n
    yield range(low, len(texts))


def document_windows(docs: DataFrame, held: np.ndarray, lengths: list[int], settings: Settings) -> DataFrame:
    """The windows of documents (_h1, _h2, text) that pass the filter, equal texts once: _h1, _h2, hash, at, doc_values."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Words()
        for b in batches:
            one, two, texts = b["_h1"].to_numpy(), b["_h2"].to_numpy(), b["text"].tolist()
            for part in _batches(texts):
                t = template([texts[i] for i in part], memo)
                low = t.values.astype(np.uint32)
                for length in lengths:
                    for at, h in windows(t, length, settings):
                        hit = _in_filter(held, h, settings.filter_bits)
                        if hit.any():
                            at, h = at[hit], h[hit]
                            of = np.searchsorted(t.begins, at, side="right") - 1
                            values = low[at[:, None] + np.arange(length)]
                            yield pd.DataFrame({"_h1": one[part.start + of], "_h2": two[part.start + of], "hash": h.view(np.int64), "at": (at - t.begins[of]).astype(np.int32), "doc_values": [v.tobytes() for v in values]})

    found = docs.mapInPandas(search, "_h1 long, _h2 long, hash long, at int, doc_values binary")
    return found.dropDuplicates(["_h1", "_h2", "hash", "at"])


Match = tuple[int, int, int, bytes, np.ndarray, np.ndarray]  # at, place, length, slots, the item's values, the document's


def agrees(m: Match, forward: dict, backward: dict) -> bool:
    """Whether the window's slots agree with the values seen so far, which take them up if so."""
    _, _, _, slots, item, doc = m
    seen, back = {}, {}
    for kind, a, b in zip(slots, item.tolist(), doc.tolist()):
        if kind and forward.get(a, seen.setdefault(a, b)) != b or a in seen and seen[a] != b:
            return False
        if kind == NAME_SLOT and (backward.get(b, back.setdefault(b, a)) != a or back.get(b, a) != a):
            return False
    forward.update(seen)
    backward.update(back)
    return True


def runs(found: list[Match]) -> list[list[Match]]:
    """The maximal runs of these windows of one diagonal, in the order of their places, whose slots agree."""
    found = [m for m in found if agrees(m, {}, {})]
    out, start, forward, backward = [], 0, {}, {}
    for k, m in enumerate(found):
        if not agrees(m, forward, backward):
            out.append(found[start:k])
            forward, backward, start = {}, {}, k
            agrees(m, forward, backward)
            while start and agrees(found[start - 1], forward, backward):
                start -= 1
    return [*out, found[start:]] if found else []


def judged(found: list[Match]) -> tuple[list[int], int, bool]:
    """Of the matches of one diagonal: the item's places that its best run covers, longest run of words, and whether a run has all the item's values."""
    best: list[int] = []
    longest, verbatim = 0, False
    for run in runs(sorted(found, key=lambda m: m[1])):
        places = sorted({p for _, place, length, *_ in run for p in range(place, place + length)})
        breaks = np.flatnonzero(np.diff(places) > 1)
        longest = max(longest, int(np.diff(np.concatenate([[-1], breaks, [len(places) - 1]])).max()))
        verbatim |= all((item == doc).all() for *_, item, doc in run)
        best = max(best, places, key=len)
    return best, longest, verbatim


def _verdicts():
    @F.pandas_udf("places array<int>, longest int, verbatim boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        values = lambda x: np.frombuffer(x, np.uint32)
        for every in batches:
            rows = [judged([(m["at"], m["place"], m["length"], m["slots"], values(m["item_values"]), values(m["doc_values"])) for m in ms]) for ms in every]
            yield pd.DataFrame(rows, columns=["places", "longest", "verbatim"])

    return judge


def held_texts(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """_h1, _h2 (the hashes of a text of docs), item (an item's text hash), coverage, longest_run, verbatim of every match."""
    schema = "_h1 long, _h2 long, item long, coverage double, longest_run int, verbatim boolean"
    cut = stored(item_windows(benchmark, settings), "windows")
    lengths = sorted(r["length"] for r in cut.select("length").distinct().collect())  # `window` numbers at most
    if not lengths:
        return docs.sparkSession.createDataFrame([], schema)
    hits = stored(document_windows(docs.select("_h1", "_h2", "text"), window_filter(cut, settings.filter_bits), lengths, settings), "hits")

    total = hits.count()
    most = max(settings.salt, total // 10_000)
    hot = hits.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > most).select("hash", F.ceil(F.col("n") / most).cast("int").alias("salts"))  # 10,000 rows at most
    hot = stored(hot, "hot")
    salted = hits.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.pmod(F.xxhash64("_h1", "at"), F.coalesce("salts", F.lit(1)))).drop("salts")
    spread = lambda w: w.join(F.broadcast(hot), "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")

    shared = stored(cut.groupBy("hash").agg(F.count_distinct("item").alias("items")).where(F.col("items") > settings.common).select("hash"), "shared")
    if shared.isEmpty():
        matched = salted.join(spread(cut), ["hash", "salt"])
    else:
        common = cut.join(shared, "hash", "left_semi")
        enough = F.pandas_udf(lambda places, lengths, words: pd.Series([_can_match(p, n, w, settings) for p, n, w in zip(places, lengths, words)], dtype=bool), "boolean")
        alone = common.groupBy("item").agg(F.collect_list("place").alias("p"), F.collect_list("length").alias("l"), F.first("words").alias("w")).where(enough("p", "l", "w")).select("item")
        alone = stored(alone, "alone")
        rest = common.join(alone, "item", "left_anti")
        matched = stored(salted.join(spread(cut.join(shared, "hash", "left_anti").unionByName(common.join(alone, "item", "left_semi"))), ["hash", "salt"]).drop("salt"), "matched")
        pairs = matched.select("_h1", "_h2", "item").distinct()
        matched = matched.unionByName(pairs.join(rest, "item").join(hits, ["_h1", "_h2", "hash"]))
    listed = F.collect_list(F.struct("at", "place", "length", "slots", "item_values", "doc_values"))
    diagonals = matched.groupBy("_h1", "_h2", "item", F.expr("at - place").alias("diagonal")).agg(listed.alias("found"), F.first("words").alias("words"))
    diagonals = diagonals.select("_h1", "_h2", "item", "words", _verdicts()("found").alias("v"))
    places = diagonals.select("_h1", "_h2", "item", "words", "v.longest", "v.verbatim", F.explode("v.places").alias("place"))
    coverage = F.count_distinct("place") / F.first("words")
    found = places.groupBy("_h1", "_h2", "item").agg(coverage.alias("coverage"), F.max("longest").alias("longest_run"), F.bool_or("verbatim").alias("verbatim"))
    return found.where((F.col("coverage") >= settings.coverage) | (F.col("longest_run") >= settings.run))


def _can_match(places: np.ndarray, lengths: np.ndarray, words: int, settings: Settings) -> bool:
    """Whether these windows of an item are enough for a match."""
    covered = np.zeros(words + 1, np.int8)
    for p, n in zip(places, lengths):
        covered[p : p + n] = 1
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered])))
    longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    return covered.sum() >= settings.coverage * words or longest >= settings.run


def _counted(ids: DataFrame) -> DataFrame:
    return ids.groupBy("_h1", "_h2").agg(F.count("*").alias("_n"))


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, coverage, longest_run, verbatim."""
    found = stored(held_texts(docs.select("text", *hashed_text()), benchmark, settings), "found")
    ids = stored(docs.select("doc_id", *hashed_text()), "ids")
    held = HotTexts(_counted(ids), ids.count()).join(ids, found)
    items = benchmark.select("item_id", F.xxhash64("text").alias("item"))
    return held.join(items, "item").select("doc_id", "item_id", "coverage", "longest_run", "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were; judged by their text, so null and repeated ids too."""
    held = stored(held_texts(docs.select("text", *hashed_text()), benchmark, settings).select("_h1", "_h2").distinct(), "held")
    hot = HotTexts(_counted(docs.select(*hashed_text())), docs.count())
    return hot.join(boxed(docs, "text").select("row", *hashed_text()), held, "left_anti").select("row.*")
