"""Quality classifier: hashed word n-grams, logistic regression by FTRL, scored as sparse dot products.

fit() learns from a bounded sample of labelled documents (`sample`, of those in the table the ones of smallest hashed id,
with at most `values` feature values in all), in one task of that bounded size; the driver gets the weights alone. score() adds a
probability to every row and reads whole texts. Defined cases: null and empty texts are scored by the bias
alone; labels that are null are skipped; a document with several labels counts with its smallest one, an id with several texts with one of them; with no
labelled rows every score is 0.5; repeated rows get equal scores; other columns are left as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memo, held_out, mix64, slices
from tessera.llm.ftrl import Ftrl, epochs

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    sample: int = 6000
    values: int = 20_000_000
    passes: int = 3


def features(text: str | None, bits: int, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed one- and two-word features with damped counts of unit length; coordinate 0 is the bias."""
    one = np.concatenate([np.empty(0, np.uint64), *(np.array([memo[t] for t in TOKEN.findall(s)], np.uint64) for s in slices(text or ""))])
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    at = (mix64(np.concatenate([one, two])) >> np.uint64(64 - bits)).astype(np.int64)
    at, count = np.unique(at[at > 0], return_counts=True)
    x = np.log1p(count)
    if len(x):
        x *= 4 / np.sqrt(x @ x)
    return np.concatenate([[0], at]), np.concatenate([[1.0], x])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", use: Column | None = None, settings: Settings = Settings()) -> np.ndarray:
    """Weights learnt from at most settings.sample labelled documents among those that `use` (a column of labels) admits."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if use is not None:
        known = known.where(use)
    rank = F.xxhash64("doc_id", F.lit(11))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # before the limit: labels of other documents take no place in it
    chosen = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("_y")).orderBy(rank, "doc_id").limit(settings.sample)
    bits = settings.bits

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo()
        for b in batches:
            rows = [features(t, bits, memo) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["_y"], "at": [a.astype(np.int32).tobytes() for a, _ in rows], "x": [x.astype(np.float32).tobytes() for _, x in rows]})

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(sparse, "doc_id long, y int, at binary, x binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("y", "at", "x")).alias("m")).select("doc_id", "m.*", F.lit(1).alias("one"))  # one text for each id

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("doc_id")
        rows, left = [], settings.values
        for a, x, y in zip(sample["at"], sample["x"], sample["y"]):
            left -= len(x) // 4
            if left >= 0:
                rows.append((np.frombuffer(a, np.int32), np.frombuffer(x, np.float32), int(y)))
        weights = epochs(Ftrl(1 << bits), rows, settings.passes).weights()[:, 0]
        return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()]})

    learnt = found.groupBy("one").applyInPandas(train, "weights binary").first()  # at most settings.sample rows
    return np.frombuffer(learnt["weights"], np.float32) if learnt else np.zeros(1 << bits, np.float32)


def score(text: Column, weights: np.ndarray, settings: Settings = Settings()) -> Column:
    """Column of probabilities that label 1 holds."""
    bits = settings.bits

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Memo()
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                at, x = features(t, bits, memo)
                out[i] = weights[at] @ x
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return probability(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held-out documents' labels are not read."""
    weights = fit(docs, labels, use=~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), score(F.col("text"), weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
