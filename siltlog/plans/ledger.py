"""A ledger of model calls: one small file for each, written as soon as it is answered.

A call is known by a hash of its stage, the models and both prompts. Before a task
asks, it looks the call up, so a task that is tried again, a second task on the same
row, or a later run of the same analysis asks only what nobody has answered.
Files are written under another name and then renamed; the same call written twice
is the same file. Answers are kept apart from attempts that failed, which are asked
again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from hashlib import sha256
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

ANSWERS, FAILURES = "answers", "failures"
RECORD_SCHEMA = (
    "stage string, batch_id long, model_ord int, model string, system_prompt string, user_prompt string, text string, "
    "prompt_token_count long, candidates_token_count long, total_token_count long, error string"
)


def model_name(model) -> str:
    return getattr(model, "name", None) or f"{model.__module__}.{model.__qualname__}"


def call_key(stage: str, models: Sequence[str], system_prompt: str, user_prompt: str) -> str:
    return sha256(json.dumps([stage, list(models), system_prompt, user_prompt]).encode()).hexdigest()


class Ledger:
    """The ledger's folder as a task sees it."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def _file(self, kind: str, name: str) -> str:
        # Two levels keep folders small.
        return f"{self.root}/{kind}/{name[:2]}/{name}.json"

    def answer(self, key: str) -> dict | None:
        path = self._file(ANSWERS, key)
        if self.files.get_file_info(path).type != fs.FileType.File:
            return None
        with self.files.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def _write(self, path: str, record: dict) -> None:
        folder = path.rsplit("/", 1)[0]
        self.files.create_dir(folder, recursive=True)
        draft = f"{folder}/_{uuid4().hex}"  # hidden from Spark's readers
        with self.files.open_output_stream(draft) as stream:
            stream.write(json.dumps(record).encode())
        self.files.move(draft, path)

    def keep(self, key: str, record: dict) -> None:
        """Write a call that was answered, or one model's attempt that wasn't."""
        if record["error"] is None:
            self._write(self._file(ANSWERS, key), record)
        else:
            self._write(self._file(FAILURES, f"{key}-{record['model_ord']}"), record)


def read_ledger(spark: SparkSession, path: str, kind: str = ANSWERS) -> DataFrame:
    """One row per answered call, or with ``kind="failures"`` per model and call without an
    answer; none for a ledger that nothing was written to."""
    folder = f"{path.rstrip('/')}/{kind}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], RECORD_SCHEMA)
    return spark.read.schema(RECORD_SCHEMA).option("recursiveFileLookup", True).json(folder)
