"""Full-table checks of prepared examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.keys import row_hash
from tabloom.functions.payload import is_one_json_object
from tabloom.spec import EXAMPLE_FIELDS, LabelMap

# Fixed value: rows of a spot check.
SAMPLE_ROWS = 3
# Up to this many labels membership is one IN set; more are joined.
IN_SET_LIMIT = 1000

REPORT = "rule string, checked bigint, failed bigint, example_key string"


def sample_rows(df: DataFrame, key: Sequence[str], k: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """k rows without replacement (all when fewer), by seeded order: a top-k, no sort."""
    return df.withColumn("_h", row_hash(key, seed)).orderBy("_h", *key).limit(k).drop("_h")


def _report(df: DataFrame, rules: Mapping[str, Column], key: Sequence[str]) -> DataFrame:
    """One pass: per rule the rows checked, the rows failing and the lowest failing key."""
    name = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in key])
    entries = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.count("*").alias("checked"),
            F.count_if(~F.coalesce(passed, F.lit(False))).alias("failed"),
            F.min(F.when(~F.coalesce(passed, F.lit(False)), name)).alias("example_key"),
        )
        for rule, passed in rules.items()
    ]
    return df.agg(F.array(*entries).alias("r")).select(F.inline("r"))


def check_format(raw: DataFrame, col: str, key: Sequence[str]) -> DataFrame:
    """Raw JSON records: valid, exactly the three keys, all of them non-empty strings."""
    text = F.col(f"`{col}`")
    valid = is_one_json_object(text)
    keys = F.array_sort(F.json_object_keys(text))
    exact = keys == F.array(*[F.lit(f) for f in sorted(EXAMPLE_FIELDS)])
    body = F.try_parse_json(text)
    strings = [F.schema_of_variant(F.try_variant_get(body, f"$.{f}", "variant")) == "STRING" for f in EXAMPLE_FIELDS]
    filled = [F.length(F.get_json_object(text, f"$.{f}")) > 0 for f in EXAMPLE_FIELDS]
    all_of = lambda conditions: reduce(lambda a, b: a & b, conditions)
    return _report(
        raw,
        {
            "valid_json": valid,
            "exact_keys": valid & exact,
            "string_values": valid & all_of(strings),
            "non_empty": valid & all_of(filled),
        },
        key,
    )


def _label_rule(labels: Sequence[str]) -> Column:
    return F.col("output").isin(list(labels))


def check_labels(examples: DataFrame, mapping: LabelMap, key: Sequence[str]) -> DataFrame:
    """The output is one label of the mapping."""
    if len(mapping.labels) <= IN_SET_LIMIT:
        return _report(examples, {"known_label": _label_rule(mapping.labels)}, key)
    # A local relation of known size: the optimizer broadcasts it below its limit only.
    known = mapping.as_table(examples.sparkSession).select(F.col("label").alias("output")).distinct()
    marked = examples.join(known.withColumn("_known", F.lit(True)), "output", "left")
    return _report(marked, {"known_label": F.col("_known").isNotNull()}, key)


def _input_rule(columns: Sequence[str], sep: str, kv: str) -> Column:
    names = [F.lit(c) for c in columns]
    # The separator is literal text, split() takes a pattern.
    parts = F.split(F.col("input"), "\\Q" + sep + "\\E")
    strange = F.filter(
        parts,
        lambda p: ~(F.contains(p, F.lit(kv)) & F.array_contains(F.array(*names), F.substring_index(p, kv, 1))),
    )
    return (F.length("input") > 0) & (F.size(strange) == 0)


def check_input(
    examples: DataFrame, columns: Sequence[str], key: Sequence[str], sep: str = ", ", kv: str = ": "
) -> DataFrame:
    """The input reads as ``name: value`` parts over the selected features.

    A value that itself contains the separator breaks its part and is reported.
    """
    return _report(examples, {"input_parts": _input_rule(columns, sep, kv)}, key)


def consistency_differences(train: DataFrame, test: DataFrame) -> DataFrame:
    """Instructions and labels that occur on one side only: ``(aspect, value, side)``."""

    def seen(df: DataFrame, side: str) -> DataFrame:
        return (
            df.select(F.expr("stack(2, 'instruction', instruction, 'label', output) AS (aspect, value)"))
            .groupBy("aspect", "value").agg(F.lit(True).alias(f"in_{side}"))
        )

    both = seen(train, "train").join(seen(test, "test"), ["aspect", "value"], "full")
    return both.filter("in_train IS NULL OR in_test IS NULL").select(
        "aspect", "value", F.when(F.col("in_train"), "train").otherwise("test").alias("side")
    )


def check_consistency(train: DataFrame, test: DataFrame) -> DataFrame:
    """Report form: shared instruction, shared labels, same columns."""

    def seen(df: DataFrame) -> DataFrame:
        return df.select(
            F.expr("stack(2, 'same_instruction', instruction, 'same_labels', output) AS (rule, value)")
        ).distinct()

    both = seen(train).withColumn("l", F.lit(True)).join(
        seen(test).withColumn("r", F.lit(True)), ["rule", "value"], "full"
    )
    one_sided = F.col("l").isNull() | F.col("r").isNull()
    values = both.groupBy("rule").agg(
        F.count("*").alias("checked"),
        F.count_if(one_sided).alias("failed"),
        F.min(F.when(one_sided, F.col("value"))).alias("example_key"),
    )
    names = sorted(set(train.columns) ^ set(test.columns))
    structure = train.sparkSession.range(1).select(
        F.lit("same_structure").alias("rule"),
        F.lit(len(set(train.columns) | set(test.columns))).cast("long").alias("checked"),
        F.lit(len(names)).cast("long").alias("failed"),
        F.lit(names[0] if names else None).cast("string").alias("example_key"),
    )
    return values.unionByName(structure)


def verify_examples(
    train: DataFrame,
    test: DataFrame | None,
    mapping: LabelMap,
    columns: Sequence[str],
    key: Sequence[str],
    sep: str = ", ",
    kv: str = ": ",
) -> DataFrame:
    """All checks: ``(set, rule, checked, failed, example_key)``.

    The row rules of a set share one pass over it.
    """
    rules = {f"non_empty_{f}": F.length(f"`{f}`") > 0 for f in EXAMPLE_FIELDS}
    rules["input_parts"] = _input_rule(columns, sep, kv)
    in_line = len(mapping.labels) <= IN_SET_LIMIT
    if in_line:
        rules["known_label"] = _label_rule(mapping.labels)

    def one_set(df: DataFrame, name: str) -> DataFrame:
        found = _report(df, rules, key)
        if not in_line:
            found = found.unionByName(check_labels(df, mapping, key))
        return found.select(F.lit(name).alias("set"), "*")

    report = one_set(train, "train")
    if test is not None:
        both = check_consistency(train, test).select(F.lit("both").alias("set"), "*")
        report = report.unionByName(one_set(test, "test")).unionByName(both)
    return report
