"""Scorers and name detectors given by the user, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..operators.joins import scored_once

Scorer = Callable[[pd.Series, pd.Series], pd.Series]
Detector = Callable[[str], list[str]]


def scored(requests: DataFrame, query: str, doc: str, scorer: Scorer, out: str = "score") -> DataFrame:
    """Scores every (query, document) of ``requests``; equal pairs are scored once. Scores must be finite."""

    @F.pandas_udf(DoubleType())
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in batches:
            s = scorer(q, d).astype(float)
            if not s.map(lambda x: x == x and abs(x) != float("inf")).all():
                raise ValueError("a score is not finite")
            yield s

    return scored_once(requests, [query, doc], lambda keys: keys.withColumn(out, udf(F.col(query), F.col(doc))))


def detected(text: Column, detector: Detector, window: int = 1200, overlap: int = 100) -> Column:
    """Distinct names that a detector finds in overlapping windows of a text, longest first; none in a null text.

    Windows are cut as ``chunked`` does, but one at a time: no batch of them is ever held.
    """

    def names(t: str | None) -> list[str]:
        at = range(0, max(len(t) - 1, 0) + 1, window - overlap) if t is not None else ()
        return sorted({n for i in at for n in detector(t[i : i + window])}, key=lambda n: (-len(n), n))

    @F.arrow_udf(ArrayType(StringType()))
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array((names(t.as_py()) for t in texts), pa.list_(pa.string()))

    return udf(text)
