"""External models as per-partition clients, with deterministic offline stand-ins.

A client factory is called once per task; its client maps a list of prompts to a list of (text, error). Rows keep
their order column, so results that arrive in any order can be told apart.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.functions.vectors import hashed_vector

Client = Callable[[list[str]], list[tuple[str | None, str | None]]]


def echo_client() -> Client:
    """Stand-in: a digest of the prompt as the description."""
    return lambda prompts: [('{"code_description": "' + hashlib.sha256(p.encode()).hexdigest()[:16] + '"}', None) for p in prompts]


def complete(rows: DataFrame, id_col: str, prompt_col: str, factory: Callable[[], Client] = echo_client, batch: int = 64) -> DataFrame:
    """(id, reply, error) of each prompt; a client's exception becomes the error of its batch."""
    src = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(prompt_col), F.lit("")).alias("prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for f in frames:
            prompts, replies = f["prompt"].tolist(), []
            for a in range(0, len(prompts), batch):
                part = prompts[a : a + batch]
                try:
                    got = client(part)
                except Exception as e:  # noqa: BLE001  what a client raises is data here
                    got = [(None, str(e))] * len(part)
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} replies to {len(part)} prompts")
                replies += got
            # A frame per Arrow batch, not per request: making a frame takes longer than many a request.
            yield pd.DataFrame({"id": f["id"].to_numpy(), "reply": [r[0] for r in replies], "error": [r[1] for r in replies]})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, reply string, error string")


def answered(rows: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Rows without an error; with ``keep_empty``, rows with one stay and have an empty reply."""
    if keep_empty:
        return rows.withColumn("reply", F.when(F.col("error").isNull(), F.col("reply")).otherwise(F.lit("")))
    return rows.filter("error is null")


def prefix_judge(n: int = 3) -> Client:
    """Stand-in: whether the two names, one a line, begin alike; a blank name is an error."""

    def judge(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        pairs = [p.split("\n") for p in prompts]
        return [(None, "no name") if not (a and b) else (str(a[:n] == b[:n]), None) for a, b in pairs]

    return judge


def judged(rows: DataFrame, id_col: str, truth: str, prediction: str, factory: Callable[[], Client] = prefix_judge, pause: float = 0.0) -> DataFrame:
    """(id, similarity, similarity_score, error) of pairs of names; an error counts as not similar.

    Each pair is a request of its own, ``pause`` seconds after the one before, so that a paid service's pace is kept.
    """

    def paced() -> Client:
        client = factory()

        def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            if pause:
                time.sleep(pause)
            return client(prompts)

        return ask

    blank = lambda c: F.coalesce(T.strip(F.col(c)), F.lit(""))
    asked = rows.select(F.col(id_col).alias("id"), F.concat(blank(truth), F.lit("\n"), blank(prediction)).alias("prompt"))
    got = complete(asked, "id", "prompt", paced, batch=1)
    true = F.col("error").isNull() & F.coalesce(T.verdict_of(F.col("reply")), F.lit(False))
    return got.select("id", true.alias("similarity"), true.cast("double").alias("similarity_score"), "error")


def digest_client() -> Client:
    """Stand-in: a digest of the prompt as the name; a prompt that mentions nothing is an error."""
    return lambda prompts: [(f"assistant: {hashlib.md5(p.encode()).hexdigest()[:8]} ", None) if p else (None, "empty prompt") for p in prompts]


def predicted(rows: DataFrame, id_col: str, messages: str, factory: Callable[[], Client] = digest_client) -> DataFrame:
    """(id, ground_truth, predicted_name) of conversations (array of role, content): only the first turn is sent, the
    last is the truth; a failed request predicts nothing."""
    c = F.col(messages)
    conv = rows.select(F.col(id_col).alias("id"), c[0]["content"].alias("prompt"), F.element_at(c, -1)["content"].alias("ground_truth"))
    got = answered(complete(conv, "id", "prompt", factory), keep_empty=True)
    return conv.select("id", "ground_truth").join(got, "id").select("id", "ground_truth", T.clean_reply(F.col("reply")).alias("predicted_name"))


def embed(rows: DataFrame, text_col: str, encode: Callable[[str], np.ndarray] = hashed_vector) -> DataFrame:
    """Adds ``vec``; each distinct text is encoded once and joined back."""
    texts = rows.select(F.col(text_col).alias("_t")).filter("_t is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"_t": f["_t"], "vec": [encode(t).tolist() for t in f["_t"]]})

    return rows.join(texts.mapInPandas(run, "_t string, vec array<double>"), F.col(text_col) == F.col("_t"), "left").drop("_t")
