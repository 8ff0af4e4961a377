"""Seeded row order that does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.text import quoted


def row_hash(key: Sequence[str], seed: int) -> Column:
    """md5 of ``seed|key1|key2...``: a repeatable pseudo-random order of rows."""
    parts = [F.lit(str(seed)), *[F.col(quoted(k)).cast("string") for k in key]]
    return F.md5(F.concat_ws("|", *parts))


def content_hash(columns: Sequence[str], seed: int) -> Column:
    """md5 over the whole row, to order rows that share one key."""
    body = F.to_json(F.struct(*[quoted(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.md5(F.concat(F.lit(f"{seed}|"), body))


def class_of(label: str | None) -> Column:
    """Class of a row: its label as text, a missing label being the class ''."""
    if label is None:
        return F.lit("")
    return F.coalesce(F.col(quoted(label)).cast("string"), F.lit(""))
