"""Hooks for models that a user brings: decisions that are checked before they count, and sentence vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsmill.operators.lines import grounding_issue

ACTIONS, SEVERITIES = ("skip", "deliver", "digest"), ("high", "medium", "low")
DECISION = "struct<action:string,severity:string,confidence:double,headline:string>"


def model_decisions(posts: DataFrame, answer: Column) -> DataFrame:
    """Rule decisions (action, severity, confidence, headline beside raw_text) with a model's over them where it is valid.

    answer is the model's JSON for a row, such as a user's pandas UDF over raw_text gives it. An answer that isn't
    JSON, has an unknown action or severity, or a headline that doesn't rest on the text leaves the rules' decision;
    confidence is clamped to [0, 1], and what an answer leaves out comes from the rules. decided_by says who decided.
    """
    got = posts.withColumn("_m", F.from_json(answer, DECISION.removeprefix("struct<").removesuffix(">").replace(":", " ")))
    m = lambda c: F.col(f"_m.{c}")
    known = m("action").isin(*ACTIONS) & m("severity").isin(*SEVERITIES)
    rests = m("headline").isNull() | (grounding_issue(F.col("raw_text"), m("headline")) == "")
    ok = F.coalesce(known & rests, F.lit(False))
    pick = lambda c, v: F.when(ok, F.coalesce(v, F.col(c))).otherwise(F.col(c))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), m("confidence")))
    new = {c: pick(c, sure if c == "confidence" else m(c)) for c in ("action", "severity", "confidence", "headline")}
    return got.withColumns({**new, "decided_by": F.when(ok, "model").otherwise("rules")}).drop("_m")


def embed(posts: DataFrame, text: str, encoder: Callable[[list[str]], Iterable[list[float]]], out: str = "embedding") -> DataFrame:
    """Adds the vectors of a user's encoder, called once a batch of texts; null texts get no vector."""

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            got = iter(encoder(list(texts.dropna())))
            yield pd.Series([None if isna else list(next(got)) for isna in texts.isna()], index=texts.index, dtype=object)

    return posts.withColumn(out, F.pandas_udf(vectors, "array<float>")(F.col(text)))
