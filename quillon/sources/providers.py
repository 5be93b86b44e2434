"""Providers by environment, all off unless registered: embeddings and language models."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED_CHARS = 24_000
#: name -> factory of a function from texts to vectors; the factory runs once per Python worker.
EMBEDDERS: dict[str, Callable[[], Callable[[list[str]], list[list[float]]]]] = {}
MODELS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def status(env: dict[str, str] = os.environ) -> dict[str, str]:
    """Which provider each stage would use."""
    pick = lambda var, known: v if (v := env.get(var, "off").lower()) in known else "off"
    return {"embedding": pick("DOCUMENT_EMBEDDING_PROVIDER", EMBEDDERS), "analysis": pick("DOCUMENT_ANALYSIS_PROVIDER", MODELS)}


def embed(df: DataFrame, text: str, provider: str = "off", to: str = "embedding") -> DataFrame:
    """df with vectors of a text column; null for blank texts, for failures and while the provider is off."""
    if provider not in EMBEDDERS:
        return df.withColumn(to, F.lit(None).cast("array<double>"))
    factory = EMBEDDERS[provider]

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            usable = texts.fillna("").str.strip() != ""
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if usable.any():
                try:
                    out[usable] = pd.Series(list(model(list(texts[usable].str[:EMBED_CHARS]))), index=texts.index[usable])
                except Exception:  # a provider's failure leaves the rows without vectors
                    pass
            yield out

    return df.withColumn(to, run(F.col(text)))


def prompt(text: Column, matters: list[tuple[str, str, str]], kept: Column | None = None) -> Column:
    """The request to a language model: the fields wanted, the matters there are, the one that is set already, and the clipped text."""
    from quillon.functions.text import clip

    listed = "\n".join(f"- {i}: {n} ({r})" for i, n, r in matters) or "-"
    head = "Return one JSON object with title, doc_type, doc_date (YYYY-MM-DD or empty), persons, summary (three sentences at most), tags and matter_id (one of the matters below, or null). Name no person, date or matter that the text does not hold; it may have been misread.\nMatters:\n"
    set_ = F.coalesce(F.concat(F.lit("\nThe matter is "), kept), F.lit("")) if kept is not None else F.lit("")
    return F.concat(F.lit(head + listed), set_, F.lit("\nText:\n"), clip(text))


def ask(prompts: Column, text: Column, model: str) -> Column:
    """A registered model's answers; null for blank texts and where the model fails. Answers come in Arrow batches, a model per Python worker."""
    factory = MODELS[model]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        answer = factory()
        for texts in batches:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            usable = texts.notna()
            if usable.any():
                try:
                    out[usable] = pd.Series(list(answer(list(texts[usable]))), index=texts.index[usable], dtype=object)
                except Exception:  # a model's failure leaves the rules' analysis
                    pass
            yield out

    return run(F.when(F.trim(text) != "", prompts))
