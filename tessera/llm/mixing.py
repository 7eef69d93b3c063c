"""Mixing to target weights by iterative proportional fitting, with DataFrame and SQL functions only.

Documents fall into cells (source, language, topic). The tokens wanted of each cell are raked in turn to the target
marginals of each dimension, under the cap that no cell gives more tokens than it has: a cell's multiplier may grow
beyond 1, its share taken does not, and the other cells of the category make up for it in the next rounds. What is
taken over what is there is the probability of the cell's documents, rounded to six places. A document is kept if a
hash of its id lies under it.

Targets that a category's own tokens can't meet are cut to them, and the rest is shared out among the dimension's other
categories in proportion to their targets; `achieved` reports what was wanted, what could be reached and what was.

Categories: sources and languages that the targets name; where a dimension has no targets, its `categories` largest
ones by tokens, with targets in proportion to a root of their tokens (`temper`), which lifts small ones. All further
ones together are "other". Topics are those of form, found by k-means over five whole-numbered features (digits, signs,
line ends, capitals, length) from stated centroids (`FORMS`), fitted on all documents. So the table of cells is bounded
by the parameters, however large the corpus. Raking runs inside Spark on one row of arrays.

Defined cases: null sources and languages are "other"; null and empty texts have topic "empty" and no tokens, and
probability 1, as they weigh nothing; targets of categories without tokens are shared among the others; repeated
rows get equal decisions; rows with a null id are decided by their text; equal distances go to the first topic and
sources of equal size to the first name; an empty table gives an empty result; other columns are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import boxed, stored

OTHER = "other"
WORD = r"[^\x20\x09-\x0D]+"

# Stated centroids: per mille of digits, signs, line ends (of words), capitals, and 50 times the binary digits of the length in words.
FORMS = {
    "prose": (0, 0, 20, 20, 400),
    "long": (0, 0, 20, 20, 600),
    "short": (0, 0, 0, 20, 200),
    "listing": (0, 0, 300, 20, 400),
    "numeric": (200, 20, 20, 20, 400),
    "noisy": (20, 200, 20, 20, 400),
}
COUNTED = {"digits": "[0-9]", "signs": r"[#$%&*|<>={}!\\\[\]^~]", "breaks": r"\n", "capitals": "[A-Z]"}
FEATURES = ("_f0", "_f1", "_f2", "_f3", "_f4")


@dataclass(frozen=True)
class Targets:
    source: dict[str, float] | None = None
    lang: dict[str, float] | None = None
    topic: dict[str, float] = field(default_factory=lambda: {"prose": 45.0, "long": 30.0, "short": 10.0, "listing": 8.0, "numeric": 4.0, "noisy": 3.0})
    budget: float = 0.5
    categories: int = 32
    temper: float = 0.5
    rounds: int = 40
    fits: int = 4
    seed: int = 23


DIMENSIONS = ("source", "lang", "topic")
Centroids = list[tuple[int, ...]]


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs (with text) and _tokens and the features of form."""
    text, count = F.col("text"), {k: F.regexp_count("text", F.lit(v)).cast("long") for k, v in COUNTED.items()}
    out = docs.withColumn("_tokens", tokens_of(text))
    share = lambda n, of: F.least(F.lit(1000).cast("long"), F.floor(1000 * n / F.greatest(of, F.lit(1))))
    chars = F.length("text").cast("long")
    made = [share(count["digits"], chars), share(count["signs"], chars), share(count["breaks"], F.col("_tokens")), share(count["capitals"], chars), 50 * F.length(F.bin(F.col("_tokens") + 1)).cast("long")]
    return out.withColumns({f: F.coalesce(v, F.lit(0)).cast("long") for f, v in zip(FEATURES, made)})


def nearest_form(centroids: Centroids) -> Column:
    costs = []
    for k, c in enumerate(centroids):
        parts = [(F.col(f) - F.lit(x)) * (F.col(f) - F.lit(x)) for f, x in zip(FEATURES, c)]
        costs.append(F.struct(sum(parts[1:], parts[0]).alias("cost"), F.lit(k).alias("k")))
    return F.array_min(F.array(*costs))["k"]


def fit_forms(rows: DataFrame, targets: Targets) -> Centroids:
    """Centroids after `fits` rounds of k-means over all documents with words; means are whole numbers, towards zero."""
    now = list(FORMS.values())
    for _ in range(targets.fits):
        means = rows.where("_tokens > 0").groupBy(nearest_form(now).alias("k")).agg(*[F.expr(f"sum({f}) div count(*)").alias(f) for f in FEATURES]).collect()  # a row a form
        found = {r["k"]: tuple(r[f] for f in FEATURES) for r in means}
        now = [found.get(k, c) for k, c in enumerate(now)]
    return now


def topic_of(centroids: Centroids) -> Column:
    names = F.array(*[F.lit(n) for n in FORMS])
    return F.when(F.col("_tokens") == 0, "empty").otherwise(F.element_at(names, nearest_form(centroids) + 1))


@dataclass(frozen=True)
class Plan:
    """Category names and target shares (of which the last is "other") of each dimension, and the topics' centroids."""

    names: tuple[list[str], ...]
    shares: tuple[list[float], ...]
    centroids: Centroids


def plan(rows: DataFrame, targets: Targets) -> Plan:
    names, shares = [], []
    for d in DIMENSIONS:
        wanted = getattr(targets, d)
        if wanted is None:
            sizes = rows.where(F.col(d).isNotNull() & (F.col(d) != OTHER)).groupBy(F.col(d).alias("name")).agg(F.sum("_tokens").alias("n")).where("n > 0")
            largest = sizes.orderBy(F.desc("n"), "name").limit(targets.categories).collect()
            listed = [(r["name"], r["n"]) for r in largest]
            # Categories beyond the largest are raked as one, whose wish is the sum of theirs, so that none of them loses by it.
            few = sizes.where(~F.col("name").isin([n for n, _ in listed])).agg(F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(targets.temper))).alias("wish")).first()
            total = rows.agg(F.sum("_tokens")).first()[0] or 0
            unnamed = total - sum(n for _, n in listed) - (few["n"] or 0)
            wanted = {name: float(n) ** targets.temper for name, n in listed} | {OTHER: float(unnamed) ** targets.temper + (few["wish"] or 0.0)}
        kept = [n for n in wanted if n != OTHER]
        values = [wanted[n] for n in kept] + [wanted.get(OTHER, 0.0)]
        names.append(kept)
        shares.append([v / sum(values) for v in values] if sum(values) else values)
    return Plan(tuple(names), tuple(shares), fit_forms(rows, targets))


def categorised(rows: DataFrame, p: Plan) -> DataFrame:
    """rows with _topic and the numbers _0, _1, _2 of their categories; the last of each dimension is "other"."""
    out = rows.withColumn("_topic", topic_of(p.centroids))
    for i, d in enumerate(DIMENSIONS):
        value = F.col("_topic" if d == "topic" else d)
        known = F.create_map(*[F.lit(x) for k, n in enumerate(p.names[i]) for x in (n, k)]) if p.names[i] else F.create_map(F.lit(""), F.lit(0))
        out = out.withColumn(f"_{i}", F.coalesce(known[value] if p.names[i] else F.lit(None), F.lit(len(p.names[i]))).cast("int"))
    return out


def _total(array: str) -> str:
    return f"aggregate({array}, 0D, (_a, _x) -> _a + _x)"


def cell_probabilities(rows: DataFrame, p: Plan, targets: Targets) -> DataFrame:
    """_0, _1, _2, _t (own tokens), _p of every cell of `rows` (as categorised() gives them)."""
    cells = rows.groupBy("_0", "_1", "_2").agg(F.sum("_tokens").cast("double").alias("t")).where("t > 0")
    one = cells.agg(F.sort_array(F.collect_list(F.struct("_0", "_1", "_2", "t"))).alias("c"))
    shares = ", ".join(f"array({', '.join(f'{v!r}D' for v in s)})" for s in p.shares)
    one = one.selectExpr("c", "transform(c, x -> x.t) AS own", "array(c._0, c._1, c._2) AS place", f"array({shares}) AS shares")
    one = stored(one, "shares").withColumn("budget", F.expr(f"{targets.budget!r}D * {_total('own')}"))
    # Sums by category of dimension d of the arrays' elements; w: an expression of x (the multiplier) and o (own tokens).
    sums = "transform(shares[{d}], (_, k) -> aggregate(zip_with(zip_with({w}, own, (x, o) -> least(x, 1D) * o), place[{d}], (y, j) -> if(j = k, y, 0D)), 0D, (_a, _x) -> _a + _x))"
    # Each step is one row that is written, so that no expression stands inside the loop of another.
    one = stored(one.select("*", *[F.expr(sums.format(d=d, w="transform(own, _ -> 1D)")).alias(f"had{d}") for d in range(len(DIMENSIONS))]), "cells")
    scales = []
    for d in range(len(DIMENSIONS)):
        reached = _total(f"zip_with(shares[{d}], had{d}, (v, h) -> least(h, v * (b.lo + b.hi) / 2))")
        halve = f"if({reached} < budget, named_struct('lo', (b.lo + b.hi) / 2, 'hi', b.hi), named_struct('lo', b.lo, 'hi', (b.lo + b.hi) / 2))"
        scales.append(F.expr(f"aggregate(sequence(1, 100), named_struct('lo', 0D, 'hi', budget * 1e9D), (b, _) -> {halve}).hi").alias(f"scale{d}"))
    one = stored(one.select("*", *scales), "scales")
    wanted = ", ".join(f"zip_with(shares[{d}], had{d}, (v, h) -> least(h, v * scale{d}))" for d in range(len(DIMENSIONS)))
    one = stored(one.withColumn("wanted", F.expr(f"array({wanted})")), "wanted")
    turn = f"i % {len(DIMENSIONS)}"
    step = f"aggregate(array({sums.format(d=turn, w='w')}), w, (acc, s) -> zip_with(acc, place[{turn}], (x, j) -> if(s[j] > 0, least(x * wanted[{turn}][j] / s[j], 1e9D), 0D)))"
    one = one.withColumn("w", F.expr(f"aggregate(sequence(0, {targets.rounds * len(DIMENSIONS) - 1}), transform(own, _ -> {targets.budget!r}D), (w, i) -> {step})"))
    return stored(one.select("c", "w"), "raked").selectExpr("inline(arrays_zip(c, w))").selectExpr("c._0", "c._1", "c._2", "c.t AS _t", "round(least(w, 1D), 6) AS _p")


def achieved(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """dimension, category, target (share wanted), present (share of all tokens), reachable (the most that the category's tokens allow), reached (expected share)."""
    rows = stored(measured(docs.select("source", "lang", "text")).drop("text"), "measured")
    p = plan(rows, targets)
    cells = stored(cell_probabilities(categorised(rows, p), p, targets), "mix")
    out = None
    for i, d in enumerate(DIMENSIONS):
        names = F.array(*[F.lit(n) for n in (*p.names[i], OTHER)])
        shares = F.array(*[F.lit(v) for v in p.shares[i]])
        by = cells.groupBy(f"_{i}").agg(F.sum("_t").alias("t"), F.sum(F.col("_t") * F.col("_p")).alias("e"))
        whole = cells.agg(F.sum("_t").alias("all"), F.sum(F.col("_t") * F.col("_p")).alias("taken"))  # one row
        at = F.col(f"_{i}") + 1
        part = by.join(F.broadcast(whole)).select(F.lit(d).alias("dimension"), F.element_at(names, at).alias("category"), F.element_at(shares, at).alias("target"), (F.col("t") / F.col("all")).alias("present"), F.least(F.lit(1.0), F.col("t") / F.col("taken")).alias("reachable"), (F.col("e") / F.col("taken")).alias("reached"))
        out = part if out is None else out.unionByName(part)
    return out


def _with_decision(rows: DataFrame, cells: DataFrame, targets: Targets) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{targets.seed} "), key).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    joined = rows.withColumn("_unit", unit).join(F.broadcast(cells.drop("_t")), ["_0", "_1", "_2"], "left")  # cells are bounded by the categories
    return joined.withColumn("_p", F.coalesce("_p", F.lit(1.0))).withColumn("_kept", F.col("_unit") < F.col("_p"))


def _cells(docs: DataFrame, targets: Targets) -> tuple[Plan, DataFrame]:
    rows = stored(measured(docs.select("source", "lang", "text")).drop("text"), "measured")
    p = plan(rows, targets)
    return p, stored(cell_probabilities(categorised(rows, p), p, targets), "mix")


def sample(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """The kept documents, all columns as they were."""
    p, cells = _cells(docs, targets)
    rows = categorised(measured(boxed(docs, "doc_id", "source", "lang", "text")), p)
    return _with_decision(rows, cells, targets).where("_kept").select("row.*")


def mix(docs: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and kept of every document."""
    docs = docs.select("doc_id", "source", "lang", "text")
    hashed = docs.withColumn("_text", F.when(F.col("doc_id").isNull(), F.col("text")))
    rows = stored(measured(hashed).drop("text").withColumnRenamed("_text", "text"), "measured")
    p = plan(rows, targets)
    rows = categorised(rows, p)
    cells = stored(cell_probabilities(rows, p, targets), "mix")
    return _with_decision(rows, cells, targets).select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"), F.col("_p").alias("probability"), F.col("_kept").alias("kept"))


def sql(targets: Targets = Targets()) -> str:
    """mix() over documents in DuckDB's SQL, for targets without named sources and languages and a temper of 0.5."""
    counted = {k: f"len(regexp_extract_all(text, '{v}'))" for k, v in COUNTED.items()}
    share = lambda n, of: f"least(1000, CAST(floor(1000.0::DOUBLE * {n} / greatest({of}, 1)) AS BIGINT))"
    made = [share(counted["digits"], "length(text)"), share(counted["signs"], "length(text)"), share(counted["breaks"], "tokens"), share(counted["capitals"], "length(text)"), "50 * length(bin(tokens + 1))"]
    fields = ", ".join(f"coalesce({v}, 0) AS {f}" for f, v in zip(FEATURES, made))
    ctes = [
        f"raw AS (SELECT *, row_number() OVER () AS n, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS tokens FROM documents)",
        f"measured AS MATERIALIZED (SELECT n, doc_id, source, lang, CASE WHEN doc_id IS NULL THEN text END AS text, tokens, {fields} FROM raw)",
        "form0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {', '.join(map(str, c))})" for k, (n, c) in enumerate(FORMS.items())) + f") AS v(k, name, {', '.join('c' + f for f in FEATURES)}))",
    ]
    cost = " + ".join(f"({f} - c{f}) * ({f} - c{f})" for f in FEATURES)
    for i in range(targets.fits + 1):
        near = f"(SELECT m.n, min({{'cost': {cost}, 'k': k}}).k AS k FROM measured m, form{i} GROUP BY m.n)"
        if i < targets.fits:
            means = f"SELECT k AS kk, {', '.join(f'CAST(sum({f}) // count(*) AS BIGINT) AS m{f}' for f in FEATURES)} FROM measured JOIN {near} USING (n) WHERE tokens > 0 GROUP BY k"
            ctes.append(f"form{i + 1} AS MATERIALIZED (SELECT k, name, {', '.join(f'coalesce(m{f}, c{f}) AS c{f}' for f in FEATURES)} FROM form{i} LEFT JOIN ({means}) ON k = kk)")
        else:
            ctes.append(f"formed AS MATERIALIZED (SELECT m.*, CASE WHEN tokens = 0 THEN 'empty' ELSE name END AS topic FROM measured m JOIN {near} USING (n) JOIN form0 USING (k))")
    ctes.append("everything AS (SELECT sum(tokens) AS total FROM formed)")
    for i, d in enumerate(DIMENSIONS[:2]):
        ctes.append(f"sized{i} AS MATERIALIZED (SELECT {d} AS name, sum(tokens) AS t, row_number() OVER (ORDER BY sum(tokens) DESC, {d}) - 1 AS k FROM formed WHERE {d} IS NOT NULL AND {d} <> '{OTHER}' GROUP BY {d} HAVING sum(tokens) > 0)")
        ctes.append(f"big{i} AS (SELECT * FROM sized{i} WHERE k < {targets.categories})")
        few = f"coalesce((SELECT sum(sqrt(t::DOUBLE)) FROM sized{i} WHERE k >= {targets.categories}), 0.0::DOUBLE)"
        ctes.append(f"all{i} AS (SELECT k, sqrt(t::DOUBLE) AS v FROM big{i} UNION ALL SELECT (SELECT count(*) FROM big{i}), sqrt(((SELECT total FROM everything) - coalesce(sum(t), 0))::DOUBLE) + {few} FROM sized{i})")
        ctes.append(f"wish{i} AS (SELECT list(v / (SELECT list_sum(list(v ORDER BY k)) FROM all{i}) ORDER BY k) AS shares FROM all{i})")
    topics = [n for n in targets.topic if n != OTHER]
    values = [targets.topic[n] for n in topics] + [targets.topic.get(OTHER, 0.0)]
    ctes.append(f"wish2 AS (SELECT [{', '.join(f'{v / sum(values)!r}::DOUBLE' for v in values)}] AS shares)")
    number = " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(topics))
    ctes.append(f"placed AS MATERIALIZED (SELECT f.*, coalesce(b0.k, (SELECT count(*) FROM big0)) AS p0, coalesce(b1.k, (SELECT count(*) FROM big1)) AS p1, CASE topic {number} ELSE {len(topics)} END AS p2 FROM formed f LEFT JOIN big0 b0 ON b0.name = source LEFT JOIN big1 b1 ON b1.name = lang)")
    ctes.append("cells AS (SELECT p0, p1, p2, sum(tokens)::DOUBLE AS t FROM placed GROUP BY ALL HAVING sum(tokens) > 0)")
    ctes.append(f"one AS (SELECT list(t ORDER BY p0, p1, p2) AS own, [list(p0 ORDER BY p0, p1, p2), list(p1 ORDER BY p0, p1, p2), list(p2 ORDER BY p0, p1, p2)] AS place, {targets.budget!r}::DOUBLE * list_sum(list(t ORDER BY p0, p1, p2)) AS budget, [(SELECT shares FROM wish0), (SELECT shares FROM wish1), (SELECT shares FROM wish2)] AS shares FROM cells)")
    sums = "list_transform(shares[{d}], lambda v, k: list_sum(list_transform(own, lambda o, i: CASE WHEN place[{d}][i] = k - 1 THEN {x} * o ELSE 0.0::DOUBLE END)))"
    ctes.append(f"had AS (SELECT *, [{', '.join(sums.format(d=d, x='1.0::DOUBLE') for d in (1, 2, 3))}] AS had FROM one)")
    halves = []
    for d in (1, 2, 3):
        reached = f"list_sum(list_transform(shares[{d}], lambda v, k: least(had[{d}][k], v * (lo[{d}] + hi[{d}]) / 2)))"
        halves.append((f"CASE WHEN {reached} < budget THEN (lo[{d}] + hi[{d}]) / 2 ELSE lo[{d}] END", f"CASE WHEN {reached} < budget THEN hi[{d}] ELSE (lo[{d}] + hi[{d}]) / 2 END"))
    ctes.append(f"halved AS (SELECT 0 AS i, *, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS lo, [budget * 1e9, budget * 1e9, budget * 1e9] AS hi FROM had UNION ALL SELECT i + 1, own, place, budget, shares, had, [{', '.join(a for a, _ in halves)}], [{', '.join(b for _, b in halves)}] FROM halved WHERE i < 100)")
    ctes.append("aims AS (SELECT own, place, budget, shares, list_transform(shares, lambda s, d: list_transform(s, lambda v, k: least(had[d][k], v * hi[d]))) AS wanted FROM halved WHERE i = 100)")
    step = sums.format(d="d", x="least(w[i], 1.0::DOUBLE)")
    ctes.append(f"summed AS (SELECT 0 AS r, own, place, shares, wanted, list_transform(own, lambda o: {targets.budget!r}::DOUBLE) AS w FROM aims UNION ALL SELECT r + 1, own, place, shares, wanted, list_transform(w, lambda x, i: CASE WHEN s[place[d][i] + 1] > 0 THEN least(x * wanted[d][place[d][i] + 1] / s[place[d][i] + 1], 1e9::DOUBLE) ELSE 0.0::DOUBLE END) FROM (SELECT *, {step} AS s FROM (SELECT *, r % 3 + 1 AS d FROM summed WHERE r < {3 * targets.rounds})))")
    ctes.append(f"mixed AS (SELECT unnest(place[1]) AS p0, unnest(place[2]) AS p1, unnest(place[3]) AS p2, round(least(unnest(w), 1.0::DOUBLE), 6) AS p FROM summed WHERE r = {3 * targets.rounds})")
    unit = f"CAST('0x' || substr(md5('{targets.seed} ' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE"
    return f"WITH RECURSIVE {', '.join(ctes)} SELECT doc_id, source, lang, topic, tokens, coalesce(p, 1.0::DOUBLE) AS probability, {unit} < coalesce(p, 1.0::DOUBLE) AS kept FROM placed LEFT JOIN mixed USING (p0, p1, p2)"
