"""Keeping a caller's columns apart from the columns an operator adds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pack(df: DataFrame, keep: Sequence[str] | None = None, /, **added: Column) -> DataFrame:
    """All of ``df``, or its columns ``keep``, as the one column ``row``, and ``added`` next to it.

    No name an operator uses can then clash with a column of the caller.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)]).alias("row"), *[c.alias(n) for n, c in added.items()])


def unpack(df: DataFrame, added: Sequence[str] = ()) -> DataFrame:
    """The caller's columns again, then ``added``; a column of the caller that has
    the name of an added one comes back as ``input_<name>``, or with more of
    ``input_`` in front if the caller has that column too."""
    names = df.schema["row"].dataType.fieldNames()
    clashing = {name.lower() for name in added}
    taken = clashing | {name.lower() for name in names}
    own = []
    for name in names:
        new = name
        while new.lower() in (taken if new != name else clashing):
            new = f"input_{new}"
        taken.add(new.lower())
        own.append(F.col(f"row.`{name}`").alias(new))
    return df.select(*own, *added)
