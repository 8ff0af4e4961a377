"""Rows to instruction examples. Narrow projections: batch and streaming alike."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.keys import class_of
from tabloom.functions.render import as_text, render_input
from tabloom.functions.text import WHITESPACE, as_plain, quoted, strip
from tabloom.operators.columns import drop_missing_target
from tabloom.operators.profile import is_numeric, with_totals
from tabloom.operators.quantiles import medians
from tabloom.session import local_table
from tabloom.spec import LITERAL_MAP_LIMIT, LabelMap, PrepSpec

# Fixed value: default length limit of an example, in tokens.
CUTOFF = 4096


def _fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def _with_label(df: DataFrame, target: str, mapping: LabelMap, into: str) -> DataFrame:
    """Adds the label of the raw target value, null outside the mapping."""
    raw = F.col(quoted(target)).cast("string")
    if not len(mapping):
        return df.withColumn(into, raw)
    dtype = df.schema[target].dataType
    if _fractional(dtype):
        # Numbers are compared as numbers: their spelling as text differs between writers.
        key, pairs, kind = as_plain(F.col(quoted(target))), list(mapping.by_number(isinstance(dtype, T.FloatType)).items()), "double"
    else:
        key, pairs, kind = raw, mapping.pairs, "string"
    if not pairs:
        return df.withColumn(into, F.lit(None).cast("string"))
    if len(pairs) <= LITERAL_MAP_LIMIT:
        literals = [x for value, label in pairs for x in (F.lit(value).cast(kind), F.lit(label))]
        return df.withColumn(into, F.try_element_at(F.create_map(*literals), key))
    # A local relation of known size: the optimizer broadcasts it below its limit only.
    table = local_table(df.sparkSession, pairs, f"_raw {kind}, _mapped string")
    return df.join(table, key == F.col("_raw"), "left").withColumn(into, F.col("_mapped")).drop("_raw", "_mapped")


def map_target(
    df: DataFrame, target: str, mapping: LabelMap, unmapped: str = "drop", into: str = "label"
) -> DataFrame:
    """Adds the label of the raw target value; rows without a target are dropped.

    Without a mapping the raw text is the label. A target held as fractions is compared with the keys as numbers: an
    integer column that had gaps matches keys with and without the ``.0``, however large and whatever the length of the mapping.
    """
    raw = F.col(quoted(target)).cast("string")
    labelled = _with_label(drop_missing_target(df, target), target, mapping, into)
    if unmapped == "drop":
        return labelled.filter(F.col(into).isNotNull())
    if unmapped == "keep":
        return labelled.withColumn(into, F.coalesce(F.col(into), raw))
    message = F.concat(F.lit(f"no label for {target} = "), raw)
    return labelled.withColumn(into, F.when(F.col(into).isNull(), F.raise_error(message)).otherwise(F.col(into)))


def fit_medians(df: DataFrame, spec: PrepSpec) -> PrepSpec:
    """The spec with medians of this (training) table for its "median" features."""
    wanted = [f for f in spec.features if spec.policy(f) == "median"]
    found = medians(df, wanted) if wanted else {}
    return replace(spec, medians=found)


def _clean(df: DataFrame, spec: PrepSpec) -> list[tuple[str, Column, T.DataType]]:
    """Per feature its cleaned value and type."""
    out = []
    for name in spec.features:
        dtype = df.schema[name].dataType
        value = as_plain(F.col(f"`{name}`")) if _fractional(dtype) else F.col(f"`{name}`")
        policy = spec.policy(name)
        if policy == "literal":
            value = F.coalesce(as_text(value, dtype, spec.decimals), F.lit(spec.missing_literal))
            dtype = T.StringType()
        elif policy == "median":
            if not is_numeric(dtype):
                raise ValueError(f"{name} is {dtype.simpleString()}; only numbers have a median")
            if name not in spec.medians:
                raise ValueError(f"no median fitted for {name}: call fit_medians on the training table")
            value = F.coalesce(value.cast("double"), F.lit(spec.medians[name]).cast("double"))
            dtype = T.DoubleType()
        out.append((name, value, dtype))
    return out


def clean_features(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """Missing feature values handled by policy: left, replaced by text or by the median."""
    if not spec.medians:
        spec = fit_medians(df, spec)
    return df.withColumns({name: value for name, value, _ in _clean(df, spec)})


def input_text(df: DataFrame, spec: PrepSpec) -> Column:
    """The ``name: value`` text of a row."""
    parts = [(name, as_text(value, dtype, spec.decimals)) for name, value, dtype in _clean(df, spec)]
    return render_input(parts, spec.separator, spec.key_value)


def build_examples(df: DataFrame, spec: PrepSpec, keep: Sequence[str] | None = None) -> DataFrame:
    """``(*keep, instruction, input, output)``, one example per row with a target.

    ``keep`` (default ``spec.keep``) are key columns carried along. Medians are never
    fitted here: a "median" feature needs ``fit_medians`` on the training rows, and a
    separate test table takes the same fitted spec.
    """
    carried = spec.keep if keep is None else keep
    labelled = map_target(df, spec.target, spec.mapping, spec.unmapped, "_output")
    return labelled.select(
        *[f"`{k}`" for k in carried],
        F.lit(spec.instruction).alias("instruction"),
        input_text(labelled, spec).alias("input"),
        F.col("_output").alias("output"),
    )


def preparation_summary(examples: DataFrame, set_col: str = "set", label: str = "output") -> DataFrame:
    """Per set and class: examples, the total of the set, and percent."""
    counts = examples.groupBy(set_col, class_of(label).alias("label")).agg(F.count("*").alias("n"))
    return with_totals(counts, set_col).withColumn("pct", F.try_divide(F.col("n") * F.lit(100.0), F.col("total")))


def preparation_dropped(df: DataFrame, spec: PrepSpec) -> DataFrame:
    """``(reason, n_rows, pct)``: rows of a table that become no example, and those that do.

    ``missing_target``: the target is null or NaN; ``no_label``: the mapping lacks its value and ``spec.unmapped`` is "drop";
    ``kept``. One pass; an empty table gives zeros and a null percent.
    """
    value = F.col(quoted(spec.target))
    present = (as_plain(value) if _fractional(df.schema[spec.target].dataType) else value).isNotNull()
    labelled = _with_label(df.select(quoted(spec.target)), spec.target, spec.mapping, "_label")
    lost = present & F.col("_label").isNull() if spec.unmapped == "drop" else F.lit(False)
    counts = labelled.agg(
        F.count("*").alias("rows"), F.count_if(~present).alias("missing_target"), F.count_if(lost).alias("no_label"))
    reasons = {"missing_target": F.col("missing_target"), "no_label": F.col("no_label"),
               "kept": F.col("rows") - F.col("missing_target") - F.col("no_label")}
    listed = F.array(*[F.struct(F.lit(r).alias("reason"), n.alias("n_rows")) for r, n in reasons.items()])
    return counts.select("rows", F.inline(listed)).select(
        "reason", "n_rows", F.try_divide(F.col("n_rows") * F.lit(100.0), F.col("rows")).alias("pct"))


def token_count(*texts: Column) -> Column:
    """Whitespace tokens of the texts together; missing text has none."""
    joined = strip(F.concat_ws(" ", *texts))
    # Every whitespace character becomes a blank, so runs split in one linear pass.
    blank = F.translate(joined, WHITESPACE, " " * len(WHITESPACE))
    return F.when(F.length(joined) == 0, 0).otherwise(
        F.size(F.filter(F.split(blank, " "), lambda t: F.length(t) > 0))
    )


def length_report(
    examples: DataFrame, columns: Sequence[str] = ("instruction", "input", "output"), cutoff: int = CUTOFF
) -> DataFrame:
    """Examples, tokens and the share of examples longer than the cutoff.

    Lengths are counted first, so the percentiles see one row per distinct length.
    """
    lengths = examples.select(token_count(*[F.col(f"`{c}`") for c in columns]).alias("tokens"))
    counts = lengths.groupBy("tokens").agg(F.count("*").alias("n"))
    over = F.sum(F.when(F.col("tokens") > cutoff, F.col("n")).otherwise(0))
    return counts.agg(
        F.sum("n").alias("examples"),
        F.sum(F.col("tokens") * F.col("n")).alias("total_tokens"),
        F.min("tokens").alias("min_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.percentile("tokens", [0.5, 0.95], F.col("n")).alias("p"),
        over.alias("over_cutoff"),
    ).select(
        "examples",
        "total_tokens",
        "min_tokens",
        F.try_divide(F.col("total_tokens").cast("double"), F.col("examples")).alias("mean_tokens"),
        F.col("p")[0].alias("p50_tokens"),
        F.col("p")[1].alias("p95_tokens"),
        "max_tokens",
        "over_cutoff",
        F.try_divide(F.col("over_cutoff").cast("double"), F.col("examples")).alias("over_share"),
    )
