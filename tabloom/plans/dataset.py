"""The main path: labelled table to split, balanced example sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import fields as dataclass_fields
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.balance import balance
from tabloom.operators.examples import build_examples, fit_medians, map_target
from tabloom.operators.features import Selection, select_features
from tabloom.operators.split import DEFAULT_RATIO, TEST, TRAIN, assign_split, split
from tabloom.sources.stages import read_stage, write_stage
from tabloom.spec import PrepSpec

# Entry points: a run starts at "table", or later from a saved stage.
STAGES = ("examples", "split", "balanced")


def apply_selection(spec: PrepSpec, selection: Selection) -> PrepSpec:
    """The spec with the features of an ensemble selection, when one was made."""
    return replace(spec, features=selection.selected) if selection.selected else spec


def _parameters(spec: PrepSpec, choose_features: bool, ratio: float, seed: int, task: str, strategy: str) -> dict[str, dict]:
    """What each stage depends on, as given by the caller. Medians and chosen features follow from these and the table."""
    fields = {f.name: getattr(spec, f.name) for f in dataclass_fields(spec) if f.name != "mapping"}
    told = {k: dict(v) if isinstance(v, Mapping) else list(v) if isinstance(v, tuple) else v for k, v in fields.items()}
    # Without its order a mapping would not be the same: labels are tried in it.
    examples = {**told, "mapping": [list(p) for p in spec.mapping.pairs], "choose_features": choose_features}
    if choose_features or any(spec.policy(f) == "median" for f in spec.features):
        # These are fitted on the training side.
        examples |= {"seed": seed, "task": task, "ratio": ratio}
    split_by = {**examples, "ratio": ratio, "seed": seed, "task": task}
    return {"examples": examples, "split": split_by, "balanced": {**split_by, "strategy": strategy}}


def prepare(
    table: DataFrame,
    spec: PrepSpec,
    key: Sequence[str],
    root: str,
    run_id: str,
    *,
    test_table: DataFrame | None = None,
    ratio: float = DEFAULT_RATIO,
    strategy: str = "none",
    task: str = "multiclass",
    choose_features: bool = False,
    seed: int = 42,
    start: str = "table",
) -> dict[str, DataFrame]:
    """Examples, split and balanced training side, each written as a stage table.

    With a separate test table nothing is split; a run made that way stays so when it
    is started again, since the saved examples tell. ``start`` names a saved stage of
    this run to go on from; that stage and those before it are read, the later ones
    are made again. A stage that is read must have been made with the same parameters, else ``StageMismatch`` is
    raised. Only training rows are balanced, after the split.

    Medians the spec does not bring are fitted on training rows: the table, or without
    a test table those of its rows that this ratio, seed and task put on the training side.
    """
    spark: SparkSession = table.sparkSession
    done: dict[str, DataFrame] = {}
    spec = replace(spec, keep=tuple(key))
    made = _parameters(spec, choose_features, ratio, seed, task, strategy)

    if start == "table":
        if choose_features:
            found = select_features(table, spec.target, task, key=key, exclude=key)
            spec = apply_selection(spec, found)
        if not spec.medians and any(spec.policy(f) == "median" for f in spec.features):
            fitted_on = table
            if test_table is None:
                labelled = map_target(table, spec.target, spec.mapping, spec.unmapped, "_label")
                fitted_on = split(labelled, key, "_label", ratio, seed, task).filter(F.col("split") == TRAIN)
            spec = fit_medians(fitted_on, spec)
        examples = build_examples(table, spec).withColumn("set", F.lit("all"))
        if test_table is not None:
            examples = examples.unionByName(build_examples(test_table, spec).withColumn("set", F.lit(TEST)))
        done["examples"] = write_stage(examples, root, run_id, "examples", made["examples"])
    elif start in STAGES:
        done["examples"] = read_stage(spark, root, run_id, "examples", made["examples"])
    else:
        raise ValueError(f"start must be table or one of {STAGES}, not {start!r}")

    if start in ("table", "examples"):
        rows = done["examples"]
        if not rows.filter(F.col("set") == TEST).isEmpty():
            main, other = rows.filter(F.col("set") != TEST), rows.filter(F.col("set") == TEST)
            marked = assign_split(main.drop("set"), other.drop("set"))
        else:
            marked = split(rows.drop("set"), key, "output", ratio, seed, task)
        done["split"] = write_stage(marked, root, run_id, "split", made["split"])
    else:
        done["split"] = read_stage(spark, root, run_id, "split", made["split"])

    if start == "balanced":
        # The default strategy means: as it was balanced.
        done["balanced"] = read_stage(spark, root, run_id, "balanced", made["balanced" if strategy != "none" else "split"])
        return done
    train = done["split"].filter(F.col("split") == TRAIN).drop("split")
    done["balanced"] = write_stage(balance(train, strategy, "output", key, seed), root, run_id, "balanced", made["balanced"])
    return done
