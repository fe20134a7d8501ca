"""Candidate selection by a question-answering service, as a pluggable function of prompts.

There is no network here: the interface takes any function from prompts to answers (texts, or Answers with the tokens
they took); the default answers by word overlap, so that results can be repeated, and counts words as tokens. Calls are
made in Arrow batches, with retries.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import text as X


@dataclass(frozen=True)
class Answer:
    """What a service said, and the tokens it counted."""

    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0


def overlap_answer(prompt: str) -> Answer:
    """The candidate that shares the most words with the record, or [0] if none shares any."""
    anchor, _, listed = prompt.partition("Given entity record:\n")[2].partition("\n\nCandidate records:\n")
    words = set(re.findall(r"\w+", anchor.lower()))
    best, most = 0, 0
    for number, text in re.findall(r"\[(\d+)\] (.*)", listed):
        shared = len(words & set(re.findall(r"\w+", text.lower())))
        if shared > most:
            best, most = int(number), shared
    return Answer(f"[{best}]", len(prompt.split()), 1)


def ask(rows: DataFrame, answer: Callable[[str], str | Answer] = overlap_answer, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Add answer, prompt_tokens, completion_tokens and error to rows with a prompt.

    Waits double between retries, up to ten times `wait`; a row whose last try failed has an error and no tokens.
    """

    def one(prompt: str) -> tuple[str | None, int, int, str | None]:
        for attempt in range(retries):
            try:
                found = answer(prompt)
                return (found.text, found.prompt_tokens, found.completion_tokens, None) if isinstance(found, Answer) else (found, 0, 0, None)
            except Exception as e:  # the service's own errors become a column
                error = f"{type(e).__name__}: {e}"
                if attempt + 1 < retries:
                    time.sleep(min(2**attempt, 10) * wait)
        return None, 0, 0, error

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [one(p) for p in part["prompt"]]
            yield part.assign(**{name: [x[i] for x in found] for i, name in enumerate(("answer", "prompt_tokens", "completion_tokens", "error"))})

    return rows.mapInPandas(batches, f"{schema}, answer string, prompt_tokens long, completion_tokens long, error string")


def candidate_prompts(candidates: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_fields: list[str], right_fields: list[str]) -> DataFrame:
    """left_id, candidate_ids (by rank), prompt; candidates are (left_id, right_id, rank), a bounded number per row."""
    l = left.select(F.col(left_id).alias("left_id"), X.serialize_record(left_fields).alias("anchor"))  # noqa: E741
    r = right.select(F.col(right_id).alias("right_id"), X.serialize_record(right_fields).alias("candidate"))
    listed = candidates.join(r, "right_id").groupBy("left_id").agg(F.array_sort(F.collect_list(F.struct("rank", "right_id", "candidate"))).alias("c"))
    return listed.join(l, "left_id").select("left_id", F.col("c.right_id").alias("candidate_ids"), X.make_prompt("anchor", F.col("c.candidate")).alias("prompt"))


def select(prompts: DataFrame, answer: Callable[[str], str | Answer] = overlap_answer) -> DataFrame:
    """left_id, candidate_ids, prediction (0: none), predicted_id, prompt_tokens, completion_tokens, error."""
    found = ask(prompts, answer).withColumn("prediction", X.parse_prediction("answer", F.size("candidate_ids")))
    return found.select("left_id", "candidate_ids", "prediction", F.try_element_at("candidate_ids", F.nullif("prediction", F.lit(0))).alias("predicted_id"), "prompt_tokens", "completion_tokens", "error")


def judge_selection(selected: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows for metrics.selector_metrics; matches are (left_id, right_id)."""
    true = matches.groupBy("left_id").agg(F.collect_set("right_id").alias("true_ids"))
    joined = selected.join(true, "left_id", "left")
    has = F.col("true_ids").isNotNull()
    return joined.select("left_id", "prediction", has.alias("has_match"), F.coalesce(F.arrays_overlap("candidate_ids", "true_ids"), F.lit(False)).alias("candidate_hit"), F.coalesce(F.array_contains("true_ids", F.col("predicted_id")), F.lit(False)).alias("correct"), "prompt_tokens", "completion_tokens", "error")


def first_candidates(scored: DataFrame, k: int) -> DataFrame:
    """Ranks 1 to k of (left_id, right_id, score)."""
    rank = F.row_number().over(Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)
