"""Which folders of a store are current: numbered versions, each one small file.

A version lists the days of a store with the run that wrote each, so a new version
may keep the folders of days it doesn't change. Its file is written under another
name and then renamed, which is the commit: readers see the version before or the
version after, and a writer that ends early leaves the one before. Two writers
can't both commit the same number.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from pyspark.sql import SparkSession

FOLDER = "logs/_versions"  # hidden from readers of the folder it is in


@dataclass(frozen=True)
class Version:
    """``days`` names the run of each day's folder and ``rows`` counts its rows; ``epochs`` are
    the stream epochs the store holds."""

    number: int = 0
    source: str = "unknown"
    days: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    patterns: str | None = None
    epochs: list[int] = field(default_factory=list)

    def folders(self, table: str, days=None) -> list[str]:
        """The folders of a table, below the store's path, that hold the given days."""
        return [f"{table}/run={run}/log_date={day}" for day, run in sorted(self.days.items()) if days is None or day in days]


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder, hadoop.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, file, _ = _files(spark, path)
    return fs.exists(file)


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, in order."""
    fs, folder, _ = _files(spark, f"{path}/{FOLDER}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def read(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version, the latest by default; None if there is none."""
    if number is None:
        known = numbers(spark, path)
        if not known:
            return None
        number = known[-1]
    fs, file, _ = _files(spark, f"{path}/{FOLDER}/{number:010d}.json")
    stream = fs.open(file)
    try:
        return Version(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: Version) -> Version:
    """Make ``version`` the current one; fails if its number is taken."""
    fs, folder, new_path = _files(spark, f"{path}/{FOLDER}")
    fs.mkdirs(folder)
    draft, final = new_path(folder, f"_draft-{uuid4().hex}"), new_path(folder, f"{version.number:010d}.json")
    stream = fs.create(draft, False)
    stream.write(bytearray(json.dumps(asdict(version)).encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version.number} of {path} was committed by another writer")
    return version


def rename(spark: SparkSession, path: str, to: str) -> None:
    fs, folder, new_path = _files(spark, path)
    if not fs.rename(folder, new_path(to)):
        raise RuntimeError(f"{path} could not be renamed to {to}")


def subfolders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Values of the folders ``<prefix>=<value>`` below a path."""
    fs, folder, _ = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(n.removeprefix(f"{prefix}=") for n in names if n.startswith(f"{prefix}="))
