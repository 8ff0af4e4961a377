"""Choosing columns: identifiers, metadata, feature candidates, projection edits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.profile import (
    SKETCH_RSD,
    is_numeric,
    is_text_like,
    profile_from_values,
    sketch_profile,
    value_table,
)
from tabloom.session import local_table

# Names that never are features (compared in lower case), and the
# distinct share above which a text column identifies its row.
METADATA_NAMES = (
    "id", "sample", "patient_id", "sample_id", "index", "study", "source", "source_file", "trial_id",
)
IDENTIFIER_SHARE = 0.5


def identifier_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text-like columns with rows, distinct values and the identifier verdict.

    A sketch settles the columns far from the limit; exact distinct counts are
    taken only for columns within ten standard errors of it.
    """
    names = [f.name for f in df.schema if is_text_like(f.dataType) and (columns is None or f.name in columns)]
    schema = "column string, n_unique long, n_rows long, is_identifier boolean"
    if not names:
        return local_table(df.sparkSession, [], schema)
    sketched = {r["column"]: r for r in sketch_profile(df, names).collect()}
    margin = 10 * SKETCH_RSD
    near = []
    rows = []
    for name in names:
        n, total = sketched[name]["n_unique"], sketched[name]["n_rows"]
        limit = IDENTIFIER_SHARE * total
        if total and abs(n - limit) <= margin * n:
            near.append(name)
        else:
            rows.append((name, n, total, n > limit))
    if near:
        exact = profile_from_values(df, value_table(df, near), near)
        rows += [
            (r["column"], r["n_unique"], r["n_rows"], r["n_unique"] > IDENTIFIER_SHARE * r["n_rows"])
            for r in exact.collect()
        ]
    return local_table(df.sparkSession, rows, schema)


def identifier_columns(df: DataFrame) -> DataFrame:
    """Text-like columns whose distinct values exceed half the rows."""
    return identifier_profile(df).filter("is_identifier").select("column")


def feature_candidates(df: DataFrame, target: str, identifiers: Sequence[str] | None = None) -> DataFrame:
    """Columns that may serve as features, in table order.

    ``(column, position, numeric)``; booleans count as numeric here. Target,
    identifiers and metadata names are left out.
    """
    rows = [(c.column, c.position, c.numeric) for c in candidates(df, target, identifiers)]
    return local_table(df.sparkSession, rows, "column string, position int, numeric boolean")


@dataclass(frozen=True)
class Candidate:
    column: str
    position: int
    numeric: bool


def candidates(df: DataFrame, target: str, identifiers: Sequence[str] | None = None) -> list[Candidate]:
    open_names = [
        f.name for f in df.schema if f.name != target and f.name.lower() not in METADATA_NAMES
    ]
    if identifiers is None:
        wanted = [n for n in open_names if is_text_like(df.schema[n].dataType)]
        identifiers = [r["column"] for r in identifier_profile(df, wanted).filter("is_identifier").collect()]
    position = {n: i for i, n in enumerate(df.columns)}
    return [
        Candidate(n, position[n], _numeric_or_bool(df.schema[n].dataType))
        for n in open_names
        if n not in set(identifiers)
    ]


def _numeric_or_bool(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or isinstance(dtype, T.BooleanType)


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target; NaN is missing as well."""
    present = F.col(f"`{target}`").isNotNull()
    if isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType)):
        present = present & ~F.isnan(F.col(f"`{target}`"))
    return df.filter(present)


@dataclass(frozen=True)
class FeatureEdit:
    selected: tuple[str, ...]
    dropped: tuple[str, ...]
    unknown: tuple[str, ...]


def edit_features(
    available: Sequence[str],
    selected: Sequence[str],
    dropped: Sequence[str] = (),
    drop: Sequence[str] = (),
    add: Sequence[str] = (),
    keep_only: Sequence[str] | None = None,
) -> FeatureEdit:
    """Drop, add and keep-only edits in that order; names ignore case.

    Added names are resolved against ``available``; those found nowhere are
    reported as ``unknown`` and left out.
    """
    actual = {n.lower(): n for n in reversed(list(available))}
    chosen = list(selected)
    out = list(dropped)

    def move_out(leaving):
        nonlocal chosen
        out.extend(f for f in chosen if leaving(f) and f not in out)
        chosen = [f for f in chosen if not leaving(f)]

    unwanted = {n.strip().lower() for n in drop}
    move_out(lambda f: f.lower() in unwanted)

    unknown = []
    for name in (n.strip() for n in add):
        resolved = actual.get(name.lower())
        if resolved is None:
            unknown.append(name)
            continue
        if resolved.lower() not in {f.lower() for f in chosen}:
            chosen.append(resolved)
        out = [f for f in out if f.lower() != name.lower()]

    if keep_only is not None:
        kept = {n.strip().lower() for n in keep_only}
        move_out(lambda f: f.lower() not in kept)
    return FeatureEdit(tuple(chosen), tuple(out), tuple(unknown))


def project_features(
    df: DataFrame,
    selected: Sequence[str],
    drop: Sequence[str] = (),
    add: Sequence[str] = (),
    keep_only: Sequence[str] | None = None,
    always: Sequence[str] = (),
) -> tuple[DataFrame, FeatureEdit]:
    """The table narrowed to the edited feature list, after the ``always`` columns."""
    edit = edit_features(df.columns, selected, drop=drop, add=add, keep_only=keep_only)
    names = [*always, *[f for f in edit.selected if f not in always]]
    return df.select(*[f"`{n}`" for n in names]), edit
