"""Free-text override notes: ``key: value`` parts separated by comma or newline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.text import strip

# Number syntax accepted for a typed value.
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
DECIMAL = (
    r"(?i)^[+-]?(([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?"
    r"|inf|infinity|nan)$"
)


def override_pairs(c: Column) -> Column:
    """Array of ``struct<key, pos, value>``, the last value of a key winning.

    Sorting by (key, position) puts the winner last in its run, so the pass over
    the array stays linear after the sort.
    """
    parts = F.split(F.coalesce(c, F.lit("")), "[,\n]")
    pairs = F.transform(
        parts,
        lambda part, pos: F.struct(
            strip(F.substring_index(part, ":", 1)).alias("key"),
            pos.alias("pos"),
            strip(F.substr(part, F.instr(part, F.lit(":")) + 1)).alias("value"),
            F.contains(part, F.lit(":")).alias("pair"),
        ),
    )
    kept = F.array_sort(
        F.filter(pairs, lambda p: p["pair"] & (F.length(p["key"]) > 0) & (F.length(p["value"]) > 0))
    )
    # `kept` is named once through a one-element array, so it is computed once.
    winners = F.transform(
        F.array(kept),
        lambda run: F.filter(
            run, lambda p, i: F.coalesce(F.get(run, i + 1)["key"] != p["key"], F.lit(True))
        ),
    )
    return F.get(winners, F.lit(0))


def parse_overrides(df: DataFrame, col: str) -> DataFrame:
    """One row per override with its value typed.

    Adds ``key``, ``kind`` (bool, int, float or string), the text ``value`` and
    the typed columns ``bool_value``, ``int_value`` and ``float_value``.
    """
    rows = df.withColumn("_pair", F.explode(override_pairs(F.col(col))))
    value = F.col("_pair.value")
    digits = F.replace(value, F.lit("_"), F.lit(""))
    kind = (
        F.when(F.lower(value).isin("true", "false"), "bool")
        .when(value.rlike(INTEGER), "int")
        .when(value.rlike(DECIMAL), "float")
        .otherwise("string")
    )
    return (
        rows.withColumns({"key": F.col("_pair.key"), "value": value, "kind": kind})
        .withColumns(
            {
                "bool_value": F.when(F.col("kind") == "bool", F.lower("value") == "true"),
                "int_value": F.when(F.col("kind") == "int", digits.try_cast("decimal(38,0)")),
                "float_value": F.when(F.col("kind") == "float", digits.try_cast("double")),
            }
        )
        .drop("_pair")
    )
