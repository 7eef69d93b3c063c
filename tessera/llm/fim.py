"""Fill-in-middle transformation on relations of units.

Every text is matched into runs of units, which posexplode() numbers. A window sums the lengths of the runs before each
one, cut requests ("after u units") meet the run that holds their unit's ordinal in a join, and the offsets found are
gathered per document, where substrings are then put together. A row of a run holds up to `size` units, so that the units of
a corpus needn't be a row each; with a size of 1 it is one unit.

Texts, forms and cuts depend on doc_id and text alone. Defined cases: a null text is empty, an empty text is plain; a null
doc_id counts as an empty one; rows that repeat a doc_id with another text are cut by their own length, equal rows
equally; texts that contain a marker are plain; other columns travel in the struct `row`, so that no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Unit:
    """What texts are cut between: a pattern of one unit, which tiles every text, and one of a run of up to `size` of them."""

    one: str
    run: str
    size: int


CODE_POINTS = Unit("(?s).", "(?s).{1,1024}", 1024)
WORDS = Unit(r"\S+\s*|\s+", r"\S+\s*|\s+", 1)
LINES = Unit(r"[^\n]*\n|[^\n]+", r"[^\n]*\n|[^\n]+", 1)


@dataclass(frozen=True)
class Settings:
    unit: Unit = CODE_POINTS
    seed: int = 1
    cut: int = 90  # of a hundred texts, how many are cut
    suffix_first: int = 20  # of a hundred texts that are cut, how many have their suffix first
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


KEY = ["_k1", "_k2"]


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _decided(docs: DataFrame, settings: Settings) -> DataFrame:
    """docs in a struct `row`, with key, text, runs of units, their number n, the form and the two cuts (in units)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    out = docs.select(F.struct("*").alias("row"), text.alias("_text"), number.alias("_d"), F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_k2"))
    h1, h2, h3, h4 = (F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    out = out.withColumn("_runs", _matches(F.col("_text"), settings.unit.run))
    last = F.size(_matches(F.coalesce(F.try_element_at("_runs", F.lit(-1)), F.lit("")), settings.unit.one))
    out = out.withColumn("n", F.when(F.size("_runs") == 0, F.lit(0)).otherwise((F.size("_runs") - 1) * settings.unit.size + last).cast("long"))
    marked = F.contains("_text", F.lit(settings.prefix)) | F.contains("_text", F.lit(settings.suffix)) | F.contains("_text", F.lit(settings.middle))
    plain = (F.col("n") == 0) | marked | (h3 % 100 >= settings.cut)
    form = F.when(plain, "plain").when(h4 % 100 < settings.suffix_first, "spm").otherwise("psm")
    one, other = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return out.withColumn("form", form).withColumn("_a", F.least(one, other)).withColumn("_b", F.greatest(one, other)).drop("_d")


def offsets(decided: DataFrame, unit: Unit) -> DataFrame:
    """Where the cuts of each text that is cut lie: key, prefix_end and middle_end in code points."""
    cut = decided.where("form <> 'plain'")
    run_of = lambda u: F.floor((u - 1) / unit.size).cast("int")
    inside = lambda u: F.char_length(F.concat_ws("", F.slice(_matches(F.col("_piece"), unit.one), F.lit(1), (u - F.col("_run") * unit.size).cast("int"))))
    asked = [F.when((F.col(u) > 0) & (run_of(F.col(u)) == F.col("_run")), F.struct(F.col(u).alias("u"), inside(F.col(u)).alias("within"))) for u in ("_a", "_b")]
    runs = cut.select(*KEY, "_a", "_b", F.posexplode("_runs").alias("_run", "_piece"))
    runs = runs.select(*KEY, "_run", F.char_length("_piece").alias("_chars"), F.array_compact(F.array(*asked)).alias("_asked")).distinct()  # equal rows count once
    before = Window.partitionBy(*KEY).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_chars").over(before), F.lit(0)).cast("long")).where(F.size("_asked") > 0)
    requests = cut.select(*KEY, F.explode(F.array(F.struct(F.lit("prefix_end").alias("which"), F.col("_a").alias("u")), F.struct(F.lit("middle_end").alias("which"), F.col("_b").alias("u")))).alias("r"))
    requests = requests.select(*KEY, "r.which", "r.u", run_of(F.col("r.u")).alias("_run")).where("u > 0").distinct()
    met = runs.join(requests, [*KEY, "_run"])
    at = met.select(*KEY, "which", (F.col("_before") + F.expr("filter(_asked, p -> p.u = u)[0].within")).alias("at"))
    return at.groupBy(*KEY).agg(*[F.max(F.when(F.col("which") == c, F.col("at"))).alias(c) for c in ("prefix_end", "middle_end")])


def transform(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every row of docs as struct `row`, with n (units), form, prefix_chars, middle_chars and output (the text as it is trained on)."""
    decided = _decided(docs, settings)
    found = decided.select("row", *KEY, "n", "form").join(offsets(decided, settings.unit), KEY, "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    a, b = F.coalesce("prefix_end", F.lit(0)).cast("int"), F.coalesce("middle_end", F.lit(0)).cast("int")
    head, middle, tail = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, F.char_length(text))
    p, s, m = (F.lit(x) for x in (settings.prefix, settings.suffix, settings.middle))
    output = F.when(F.col("form") == "psm", F.concat(p, head, s, tail, m, middle)).when(F.col("form") == "spm", F.concat(s, tail, p, head, m, middle)).otherwise(text)
    cut = F.col("form") != "plain"
    return found.select("row", "n", "form", F.when(cut, a.cast("long")).alias("prefix_chars"), F.when(cut, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output was made from, from output and form alone; texts with markers were left plain, so each is found once."""
    p, s, m = settings.prefix, settings.suffix, settings.middle
    before = F.substring_index(output, m, 1)
    middle = F.substring(output, F.char_length(before) + 1 + len(m), F.char_length(output))
    first, second = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)
    rest = F.substring(before, F.char_length(first) + 1, F.char_length(before))
    one = F.substring(rest, F.lit(1), F.instr(rest, second) - 1)
    two = F.substring(rest, F.instr(rest, second) + F.char_length(second), F.char_length(rest))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row."""
    out = transform(docs)
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def sql() -> str:
    """The digests in SQL, by substring alone."""
    h = lambda k: f"CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT)"
    return f"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents
), c AS (
    SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), p AS (
    SELECT *, substring(x, 1, a) AS head, substring(x, a + 1, b - a) AS mid, substring(x, b + 1, n) AS tail FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256,
    sha256(x) AS restored_sha256
FROM p
"""
