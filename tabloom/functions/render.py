"""Rows as readable text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_text(c: Column, dtype: T.DataType, decimals: int | None = None) -> Column:
    """Readable text of one value; ``decimals`` fixes the digits of fractions."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)) and decimals is not None:
        fixed = c.try_cast(f"decimal(38,{decimals})").cast("string")
        return F.coalesce(fixed, c.cast("string"))
    return c.cast("string")


def render_input(
    features: Iterable[tuple[str, Column]], sep: str = ", ", kv: str = ": "
) -> Column:
    """``name: value`` parts joined by ``sep``; missing values are left out."""
    parts = [F.when(text.isNotNull(), F.concat(F.lit(name + kv), text)) for name, text in features]
    return F.concat_ws(sep, *parts) if parts else F.lit("")
