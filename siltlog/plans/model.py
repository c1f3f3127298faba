"""Calling a model function on prompts, with a fallback.

A model function maps a frame with ``system_prompt`` and ``user_prompt`` to the
same rows with ``text`` and the three token counts. It runs in the workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltlog.functions.json_text import json_in_text, without_fence
from siltlog.plans.ledger import Ledger, call_key, model_name, read_ledger
from siltlog.session import materialize, setting

ModelFunction = Callable[[pd.DataFrame], pd.DataFrame]

PROMPTS = ["system_prompt", "user_prompt"]
TOKEN_COLUMNS = ("prompt_token_count", "candidates_token_count", "total_token_count")
ANSWER_COLUMNS = ("text", "model_ord", "error", *TOKEN_COLUMNS)
RESPONSE_SCHEMA = (
    "stage string, batch_id long, system_prompt string, user_prompt string, text string, "
    "prompt_token_count long, candidates_token_count long, total_token_count long, "
    "model_ord int, error string"
)

# A prompt may take tens of kilobytes, and a worker holds each several times: in the batch, as
# strings, and again in the reply. It keeps the most it ever took, beside a JVM whose
# heap may be full.
CALL_BATCH = "1m"
# Readers take thousands of rows of a row group at a time, and an answer is as long as its prompt.
ANSWER_GROUP = str(4 << 20)

Note = Callable[[dict, int, str | None], None]


def _answers(asked: pd.DataFrame, rows: Sequence[dict], models: Sequence[ModelFunction], note: Note | None = None) -> None:
    """Ask each model in turn for the rows that still have no answer, and complete the records.

    ``asked`` has the prompts of ``rows`` in the same order. A frame for each call costs far
    more than most of its rows, so answers are kept in the records and only the
    prompts are cut from a frame. ``note(row, order, error)`` hears of each row and
    model as soon as the model has replied.
    """
    records = dict(zip(asked.index, rows, strict=True))
    for row in rows:
        row.update(text=None, model_ord=None, error=None, **dict.fromkeys(TOKEN_COLUMNS, 0))
    for order, model in enumerate(models):
        left = [i for i, row in records.items() if row["text"] is None]
        if not left:
            break
        try:
            reply = model(asked.copy() if len(left) == len(asked) else asked.loc[left])  # a model may change its frame
        except Exception as problem:  # a failed model leaves its rows to the next one
            for i in left:
                records[i]["error"] = f"{type(problem).__name__}: {problem}"
        else:
            for i, text, *tokens in zip(reply.index, *[reply[c].tolist() for c in ("text", *TOKEN_COLUMNS)]):
                if not pd.isna(text) and text != "":
                    records[i].update(zip(TOKEN_COLUMNS, tokens), text=text, model_ord=order, error=None)
            for i in left:
                if records[i]["text"] is None:
                    records[i]["error"] = records[i]["error"] or "no answer"
        if note:
            for i in left:
                note(records[i], order, records[i]["error"])


def _framed(rows: Sequence[dict], columns: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(columns))
    return out.assign(model_ord=pd.Series([row["model_ord"] for row in rows], out.index, dtype=object))


def _answer(pdf: pd.DataFrame, models: Sequence[ModelFunction]) -> pd.DataFrame:
    """:func:`_answers` for the rows of one frame."""
    rows = pdf.to_dict("records")
    _answers(pdf[PROMPTS], rows, models)
    return _framed(rows, [*pdf.columns, *ANSWER_COLUMNS]).set_index(pdf.index)


def _answers_once(asked: pd.DataFrame, rows: Sequence[dict], models: Sequence[ModelFunction], ledger: Ledger) -> None:
    """:func:`_answers` for the rows the ledger has no answer for; every call is kept in it."""
    names = [model_name(m) for m in models]
    keys = [call_key(row["stage"], names, row["system_prompt"], row["user_prompt"]) for row in rows]
    key_of = {id(row): key for row, key in zip(rows, keys)}
    unknown = []
    for place, (row, key) in enumerate(zip(rows, keys)):
        if (found := ledger.answer(key)) is None:
            unknown.append(place)
        else:
            row.update({c: found[c] for c in ("text", *TOKEN_COLUMNS, "model_ord")}, error=None)

    def note(row: dict, order: int, error: str | None) -> None:
        text = None if row["text"] is None else str(row["text"])
        tokens = {c: int(row[c]) for c in TOKEN_COLUMNS}
        own = {c: row[c] for c in ("stage", "system_prompt", "user_prompt")} | {"batch_id": int(row["batch_id"])}
        ledger.keep(key_of[id(row)], own | tokens | {"model_ord": order, "model": names[order], "text": text, "error": error})

    if unknown:
        _answers(asked.iloc[unknown], [rows[place] for place in unknown], models, note)


def _whole_calls(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of a multiple of ``size``, but for the last, however they were batched."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        over = len(held) % size
        if over < len(held):
            yield held.iloc[: len(held) - over]
            held = held.iloc[len(held) - over :].copy() if over else None
    if held is not None:
        yield held


def ask(
    requests: DataFrame,
    models: ModelFunction | Sequence[ModelFunction],
    parallelism: int | None = None,
    prompts_per_call: int = 1,
    ledger: str | None = None,
    at_once: int = 1,
) -> DataFrame:
    """Answer ``(stage, batch_id, system_prompt, user_prompt)`` rows.

    A model gets ``prompts_per_call`` rows at a time, and what it cannot answer of
    them goes to the next model; other rows are not touched by its failure. A task
    has up to ``at_once`` calls under way. Answers are costly and may differ between
    calls, so they are written once and every later step reads that table. With a
    ``ledger``, a folder that tasks can reach, each call is kept there as it is
    answered and never paid twice; see :mod:`siltlog.plans.ledger`.
    """
    chain = [models] if callable(models) else list(models)
    columns = [name.split()[0] for name in RESPONSE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Ledger(ledger) if ledger else None
        with ThreadPoolExecutor(at_once) as calls:
            for pdf in _whole_calls(batches, prompts_per_call * at_once):
                asked, rows = pdf[PROMPTS], pdf.to_dict("records")

                def answer(first: int) -> None:
                    part = slice(first, first + prompts_per_call)
                    if kept:
                        _answers_once(asked.iloc[part], rows[part], chain, kept)
                    else:
                        _answers(asked.iloc[part], rows[part], chain)

                for _ in calls.map(answer, range(0, len(rows), prompts_per_call)):
                    pass
                yield _framed(rows, columns)

    tasks = parallelism or requests.sparkSession.sparkContext.defaultParallelism
    spread = requests.select("stage", "batch_id", "system_prompt", "user_prompt").repartition(tasks)
    with (
        setting(requests.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", CALL_BATCH),
        setting(requests.sparkSession, "parquet.block.size", ANSWER_GROUP),
    ):
        return materialize(spread.mapInPandas(run, RESPONSE_SCHEMA), "model-answers")


def answer_status(responses: DataFrame) -> DataFrame:
    """``stage, batch_id, status, error``: ``answered``, ``no_answer`` or ``unreadable``."""
    parsed = json_in_text(F.col("text"))
    status = (
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no_answer")
        .when(parsed.isNull() | F.is_variant_null(parsed), "unreadable")
        .otherwise("answered")
    )
    return responses.select("stage", "batch_id", status.alias("status"), "error")


class LostAnswers(ValueError):
    """Some batches have no readable answer, so a result would be incomplete."""


def failed_batches(responses: DataFrame, on_failed: str = "raise") -> DataFrame:
    """The batches without a readable answer; with ``raise`` there must be none."""
    if on_failed not in ("raise", "keep"):
        raise ValueError("on_failed is 'raise' or 'keep'")
    failed = answer_status(responses).where("status <> 'answered'")
    if on_failed == "raise":
        some = failed.orderBy("batch_id").limit(5).collect()
        if some:
            told = ", ".join(f"{r['stage']} batch {r['batch_id']}: {r['status']}" for r in some)
            raise LostAnswers(f"answers are missing ({told}, ...); on_failed='keep' gives what there is")
    return failed


def usage_of(responses: DataFrame) -> DataFrame:
    return responses.select("stage", *TOKEN_COLUMNS)


def audit_records(responses: DataFrame) -> DataFrame:
    """One record per call: prompts, answer without its fence, and the parsed JSON text."""
    return responses.select(
        "stage",
        "batch_id",
        "model_ord",
        "user_prompt",
        without_fence(F.col("text")).alias("response"),
        F.to_json(json_in_text(F.col("text"))).alias("parsed"),
        "error",
    )


def save_audit(responses: DataFrame, path: str) -> None:
    """Write the records of :func:`audit_records`, by stage and batch.

    Records written again for a batch replace the ones before, so a repeated run
    leaves one record for each call.
    """
    records = audit_records(responses).withColumns({"of_stage": F.col("stage"), "of_batch": F.col("batch_id")})
    written = records.write.partitionBy("of_stage", "of_batch").mode("overwrite")
    written.option("partitionOverwriteMode", "dynamic").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The records of a ledger, with the answers as :func:`audit_records` gives them."""
    return audit_records(read_ledger(spark, path))
