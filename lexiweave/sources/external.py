"""Calls of models and services from within a query, by functions that are handed in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds between two calls of a proposer by one task; fixed value of the service's limit of 8 a minute.
CALL_GAP = 7.5


class TooManyCalls(Exception):
    """The service asks to wait."""


def propose(df: DataFrame, key: str, prompt: str, call: Callable[[str], list[str]], gap: float = CALL_GAP, tasks: int = 1) -> DataFrame:
    """(key, status, proposals): what a service proposes for each prompt, null prompts skipped.

    ``call`` is handed in and runs in the workers. Each of ``tasks`` tasks
    waits ``gap`` seconds between calls; one call that is told to wait is tried
    once more. Failures are rows of status error, so that a run goes on.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, status string, proposals array<string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = -gap
        for part in parts:
            rows = []
            for k, p in zip(part[key], part["_prompt"], strict=True):
                for again in (True, False):
                    time.sleep(max(0.0, last + gap - time.monotonic()) if last > -gap else 0.0)
                    last = time.monotonic()
                    try:
                        got = [x for x in call(p) if x and x.strip()]
                        rows.append((k, "resolved" if got else "unresolved", got))
                        break
                    except TooManyCalls:
                        if not again:
                            rows.append((k, "error", []))
                    except Exception:  # any failure of a foreign service is a row, not the end of the run
                        rows.append((k, "error", []))
                        break
            yield pd.DataFrame(rows, columns=[key, "status", "proposals"])

    return df.select(key, F.col(prompt).alias("_prompt")).filter("_prompt IS NOT NULL").repartition(tasks).mapInPandas(run, schema)


def settle(proposals: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, status, target_id, score): the best of the proposed words that the table words (word, target_id, score) has.

    A key all of whose proposals are unknown is unresolved; errors stay errors.
    """
    offered = proposals.select(key, F.explode("proposals").alias("p")).select(key, F.lower(F.trim("p")).alias("word"))
    best = offered.join(words.select("word", "target_id", "score"), "word").groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("n"), "target_id")).alias("b"))
    j = proposals.select(key, "status").join(best, key, "left")
    status = F.when(F.col("b").isNotNull(), "resolved").when(F.col("status") == "error", "error").otherwise("unresolved")
    return j.select(key, status.alias("status"), F.col("b.target_id").alias("target_id"), (-F.col("b.n")).alias("score"))


def embed_missing(rows: DataFrame, done: DataFrame, row_id: str, text: str, encode: Callable[[list[str]], list[list[float]]], replace: bool = False) -> DataFrame:
    """(row_id, text, vector) of the rows without a vector, or of all to be replaced; null and blank texts are left out.

    ``encode`` is handed in; it sees each different text of a batch once.
    """
    todo = rows.select(row_id, F.col(text).alias("text")).filter("trim(text) <> ''")
    if not replace:
        todo = todo.join(done.select(row_id), row_id, "left_anti")
    schema = f"{row_id} {dict(todo.dtypes)[row_id]}, text string, vector array<float>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            distinct = list(dict.fromkeys(part["text"]))
            known = dict(zip(distinct, encode(distinct), strict=True))
            yield part.assign(vector=part["text"].map(known))

    return todo.mapInPandas(run, schema)
