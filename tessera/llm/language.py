"""Language identification: TF-IDF character n-grams, sparse multinomial logistic regression by FTRL with
elastic-net penalties, then temperature scaling.

Document frequencies are counted over all training documents; the regression is fitted on a bounded sample of
them (`per_language` distinct texts a language at most, about). All languages are learnt; the model grows with their
number (2^bits weights each). A letter is a character of category L. Defined cases: a text that is null or has no letter is
`und` with score 0; without any training row every text is `und`; ties go to the smaller language code;
repeated rows get equal results; other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import code_points, held_out
from tessera.llm.ftrl import Ftrl, epochs


def has_letter(text: str) -> bool:
    """Whether a character has the category L."""
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    orders: tuple[int, ...] = (1, 2, 3)
    per_language: int = 1000
    passes: int = 2


def counts(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of the lower-cased code points and how often each occurs."""
    low, total = text.lower(), np.zeros(1 << settings.bits, np.int64)
    for start in range(0, len(low), common.SLICE):
        c = code_points(low[start : start + common.SLICE + max(settings.orders) - 1])
        for n in settings.orders:
            size = min(common.SLICE, len(c) - n + 1)  # n-grams that begin in this slice
            if size > 0:
                h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
                for k in range(n):
                    h = (h ^ c[k : size + k]) * np.uint32(0x85EBCA6B)
                    h ^= h >> np.uint32(15)
                h *= np.uint32(0xC2B2AE35)
                total += np.bincount(h >> np.uint32(32 - settings.bits), minlength=len(total))
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text, settings)
    x = np.log1p(n) * idf[at]
    return at, x * (4 / max(np.sqrt(x @ x), 1e-12))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    settings: Settings


def _document_frequency(train: DataFrame, settings: Settings) -> tuple[int, np.ndarray]:
    """Number of training documents, and in how many of them each hashed n-gram occurs."""

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs = np.zeros(1 << settings.bits, np.int64), 0
        for b in batches:
            for t in b["text"]:
                df[counts(t, settings)[0]] += 1
                docs += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"at": np.append(at, -1), "n": np.append(df[at], docs)})

    found = train.select("text").mapInPandas(per_task, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << settings.bits)
    real = found[found["at"] >= 0]
    df[real["at"].to_numpy(int)] = real["n"]
    return int(found.loc[found["at"] < 0, "n"].sum()), df


def fit(docs: DataFrame, use: Column | None = None, settings: Settings = Settings()) -> Model | None:
    train = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if use is not None:
        train = train.where(use)
    texts = train.select("lang", F.xxhash64("text", F.lit(5)).alias("h")).distinct()  # equal texts count once, as they are drawn once
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    n_docs, df = _document_frequency(train, settings)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    languages = sorted(sizes)
    unit = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)  # equal texts are drawn together and count once
    rate = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, settings.per_language / n))])
    number = F.create_map(*[F.lit(v) for i, lang in enumerate(languages) for v in (lang, i)])
    sample = train.where(unit < rate[F.col("lang")]).select(F.xxhash64("text").alias("id"), "text", number[F.col("lang")].alias("y"))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [vector(t, idf, settings) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "at": [a.astype(np.int32).tobytes() for a, _ in rows], "x": [x.astype(np.float32).tobytes() for _, x in rows]})

    found = sample.mapInPandas(sparse, "id long, y int, at binary, x binary").dropDuplicates(["id", "y"]).toPandas().sort_values(["id", "y"])
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), int(y)) for a, x, y in zip(found["at"], found["x"], found["y"])]
    check = rows[::5] if len(rows) >= 25 else rows
    learn = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 25 else rows
    weights = epochs(Ftrl(1 << settings.bits, len(languages) + (len(languages) == 1), alpha=0.3, l1=0.02, l2=0.1), learn, settings.passes).weights()
    outs = np.array([x @ weights[at] for at, x, _ in check]).reshape(len(check), -1)
    truth = np.array([y for *_, y in check], int)

    def loss(t: float) -> float:
        z = outs / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    return Model(languages, idf, weights, min(np.geomspace(0.2, 5, 33), key=loss) if len(check) else 1.0, settings)


def predict(text: Column, model: Model | None) -> Column:
    """Struct (lang_pred, score) for each text."""

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            for i, t in enumerate(texts):
                if model is not None and t and has_letter(t):
                    at, x = vector(t, model.idf, model.settings)
                    z = x @ model.weights[at] / model.temperature
                    e = np.exp(z - z.max())
                    best = int(np.argmax(e[: len(model.languages)]))
                    names[i], scores[i] = model.languages[best], e[best] / e.sum()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return identify(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; only documents that are not held out are learnt from."""
    model = fit(docs.select("doc_id", "text", "lang"), use=~held_out())
    return docs.select("doc_id", held_out().alias("held_out"), predict(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
