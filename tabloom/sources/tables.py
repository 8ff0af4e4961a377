"""Labelled tables: reading, type inference, header alignment, scan health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.text import as_plain, quoted
from tabloom.session import local_table
from tabloom.sources.blocks import CSV, read_records

# The texts that mean "missing" in a CSV cell.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Number and boolean syntax of a CSV cell.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity)\s*$"
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")

# Columns inferred per pass; a wider table takes several passes.
INFER_CHUNK = 200
CORRUPT = "_corrupt_record"


def _plain_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """Every cell as text, by Spark's own reader."""
    return spark.read.options(header=True, inferSchema=False, multiLine=multi_line, escape='"', mode="PERMISSIVE").csv(path)


def _in_blocks(spark: SparkSession, path: str) -> bool:
    """Whether lines end at line feeds and folders are no columns; other tables go to Spark's own reader."""
    lines = spark.read.option("lineSep", "\n").text(path)
    head = lines.limit(1).collect()
    return lines.columns == ["value"] and not any("\r" in r["value"].rstrip("\r") for r in head)


def _csv_cells(spark: SparkSession, path: str, names: Sequence[str], block_bytes: int | None) -> DataFrame:
    """Every cell as text in columns ``c0, c1, ...``, and ``_corrupt_record``; cut into records by many tasks."""
    cells = ", ".join(f"c{i} string" for i in range(len(names))) + f", {CORRUPT} string"
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": CORRUPT}
    rows = read_records(spark, path, CSV, lambda c: F.from_csv(F.regexp_replace(c, "\\r\\z", ""), cells, options), block_bytes)
    return rows.filter("NOT _first").drop("_first")


def _csv_text(spark: SparkSession, path: str, multi_line: bool, block_bytes: int | None = None) -> DataFrame:
    """Every cell as text under its own name."""
    plain = _plain_csv(spark, path, multi_line)
    if not multi_line or not plain.columns or not _in_blocks(spark, path):
        return plain
    rows = _csv_cells(spark, path, plain.columns, block_bytes)
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(plain.columns)])


def _text(value: str) -> str:
    """String literal in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _texts(values: Sequence[str]) -> str:
    return ", ".join(_text(v) for v in values)


def _present(name: str, na_tokens: Sequence[str]) -> str:
    """The cell, null when it holds a missing token, in SQL."""
    c = quoted(name)
    return c if not na_tokens else f"CASE WHEN {c} NOT IN ({_texts(na_tokens)}) THEN {c} END"


def infer_types(text: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> dict[str, str]:
    """Column types over the whole file: bigint, double, boolean or string.

    Whole numbers with missing cells become double, booleans with missing cells
    stay text, dates stay text.
    """
    types: dict[str, str] = {}
    for start in range(0, len(text.columns), INFER_CHUNK):
        names = text.columns[start:start + INFER_CHUNK]
        stats = [
            F.expr(
                f"struct(count(*) AS rows, count({v}) AS present, "
                f"count_if({v} RLIKE {_text(INTEGER)} AND try_cast({v} AS BIGINT) IS NOT NULL) AS whole, "
                f"count_if({v} RLIKE {_text(NUMBER)}) AS number, count_if({v} IN ({_texts(BOOLEANS)})) AS bool)"
            )
            for v in (f"({_present(name, na_tokens)})" for name in names)
        ]
        for name, s in zip(names, text.agg(*stats).first()):
            complete = s["present"] == s["rows"] and s["rows"] > 0
            if complete and s["whole"] == s["present"]:
                types[name] = "bigint"
            elif s["number"] == s["present"]:
                types[name] = "double"
            elif complete and s["bool"] == s["present"]:
                types[name] = "boolean"
            else:
                types[name] = "string"
    return types


def read_csv(
    spark: SparkSession, path: str, na_tokens: Sequence[str] = NA_TOKENS, multi_line: bool = True, block_bytes: int | None = None
) -> DataFrame:
    """CSV with header: missing tokens to null, types inferred over the whole file.

    Quoted cells may contain line breaks. Files are cut into blocks all the same (see ``blocks``): the text is read twice,
    first for the quotes, then for the records, which are kept as Parquet in the shared folder; types
    are inferred from there. ``block_bytes`` sets the size of a block. ``multi_line=False`` is for tables
    known to hold no such breaks, and leaves the text where it is. Files whose lines end at a bare carriage return, and folders that
    name columns, are read by one task a file.
    """
    text = _csv_text(spark, path, multi_line, block_bytes)
    types = infer_types(text, na_tokens)
    return text.selectExpr(
        *[f"try_cast({_present(n, na_tokens)} AS {types[n]}) AS {quoted(n)}" for n in text.columns]
    )


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", na_tokens: Sequence[str] = NA_TOKENS, multi_line: bool = True,
    block_bytes: int | None = None,
) -> DataFrame:
    """A labelled table; NaN counts as missing."""
    if fmt == "csv":
        return read_csv(spark, path, na_tokens, multi_line, block_bytes)
    df = spark.read.format(fmt).load(path)
    floats = [f for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns(
        {f.name: as_plain(F.col(f"`{f.name}`")).cast(f.dataType) for f in floats}
    ) if floats else df


def schema_alignment(train: DataFrame, test: DataFrame) -> DataFrame:
    """Columns on one side only: ``(column, side)`` with side "missing in test" or
    "missing in train". Reads schemas, not rows."""
    left, right = set(train.columns), set(test.columns)
    rows = [(c, "missing in test") for c in sorted(left - right)]
    rows += [(c, "missing in train") for c in sorted(right - left)]
    return local_table(train.sparkSession, rows, "column string, side string")


def scan_health(spark: SparkSession, path: str, multi_line: bool = True, block_bytes: int | None = None) -> DataFrame:
    """One row ``(path, ok, n_columns, n_rows, n_corrupt, message)``; never raises
    for an unreadable input.

    A record is corrupt when it has more or fewer cells than the header. Line breaks
    inside quotes belong to their cell unless ``multi_line=False``.
    """

    def verdict(ok, columns=0, rows=0, corrupt=0, message=""):
        return local_table(
            spark,
            [(path, ok, columns, rows, corrupt, message)],
            "path string, ok boolean, n_columns int, n_rows bigint, n_corrupt bigint, message string",
        )

    try:
        names = _plain_csv(spark, path, multi_line).columns
    except AnalysisException as error:
        return verdict(False, message=f"ERROR: cannot read: {error.getCondition() or str(error)[:200]}")
    if not names:
        return verdict(False, message="ERROR: no columns to parse")
    if any(not ch.isprintable() or ch == "�" for n in names for ch in n):
        return verdict(False, len(names), message="ERROR: header holds control characters, not a text table")
    if multi_line and _in_blocks(spark, path):
        checked = _csv_cells(spark, path, names, block_bytes)
        rows, corrupt = checked.agg(F.count("*"), F.count(CORRUPT)).first()
    else:
        checked = spark.read.options(
            header=True, multiLine=multi_line, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
        ).schema(", ".join(f"{quoted(n)} string" for n in names) + f", {CORRUPT} string").csv(path)
        # Every column is referenced: a pruned CSV scan would not notice missing cells.
        longest = F.max(F.length(F.concat_ws(",", *[quoted(n) for n in names])))
        rows, corrupt, _ = checked.agg(F.count("*"), F.count(CORRUPT), longest).first()
    if rows == 0:
        return verdict(True, len(names), 0, 0, "header only, no rows")
    message = f"{corrupt} of {rows} records do not fit the header" if corrupt else "ok"
    return verdict(True, len(names), rows, corrupt, message)
