"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source whose target is r times its size gives each document floor(r) certain copies. The
rest f = r - floor(r) is a sample with inclusion probability f: documents are ranked by the
random odds u / (1 - u) over the inclusion odds f / (1 - f), where u comes from a keyed hash,
and taken from the smallest on until the words left over are reached. Sample size is
counted in words, and the last document of a source is the one whose size fits what is then left.

No source is ranked in one task. The place where the words run out is found by counting
words per source in buckets of ranks, each round dividing the bucket in which it lies
by 4,096, until it holds at most ``RESOLVE_ROWS`` rows. Rows never move: they are compared with a table of one
row per source, which is broadcast only if small.

Inclusion probability is one number per source unless ``expected`` gives each document its own
(copies wanted, at most ``most``); documents then differ in their odds and certain copies.

Defined cases: a null text has size zero; documents of size zero follow their rank like any
other; a null source is a source, ordered last; rows equal in id and text share a fate; null ids are
ranked by their text alone; an empty table gives an empty result; other columns are
ignored (``plan_mix``) or carried along (``mix``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import as_rows, stage, text_of

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
HEX_STEP = 3
HEX_DIGITS = 12
KEY_DIGITS = 13
# Open buckets of a source up to this many rows are ranked in one task.
RESOLVE_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``(source, source_size, target)`` from one row per source ``(source, source_size)``.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words. No target is above
    ``most`` times its size: with sources ordered by size over weight, those that the
    common share per weight would lift over the bound come first, so that one running sum finds
    them all. The windows run over sources, never over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    weighed = sizes.select("source", "source_size", weight.alias("w"))
    bound = F.col("source_size") * F.lit(float(most))
    weighed = weighed.withColumn("bound", bound).withColumn("ratio", bound / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(up), F.lit(0.0))
    shared = weighed.withColumn("share", left / F.sum("w").over(on))
    capped = F.col("share") >= F.col("ratio")
    # The first source under its bound sets the share of all that are.
    free = F.min(F.when(~capped, F.struct("ratio", "share"))).over(every)["share"]
    target = F.when(capped | free.isNull(), F.col("bound")).otherwise(F.least(F.col("w") * free, F.col("bound")))
    return shared.select("source", "source_size", target.alias("target"))


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, expected: Column | None) -> DataFrame:
    text = text_of(f"`{text_col}`")
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.md5(text))
    number = F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("double")
    return docs.select(
        as_rows(docs).alias("_row"), F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text).alias("size"),
        ((number + 0.5) / F.lit(float(16 ** HEX_DIGITS))).alias("_u"),
        (F.lit(None) if expected is None else expected).cast("double").alias("_expected"),
    )


def _join(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with the columns of their source. ``per_source`` is a staged table of one row per
    source: its size decides whether it is broadcast."""
    named = per_source.withColumnRenamed("source", "_source")
    return rows.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _drawn(rows: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Rows with ``source_size``, ``target``, ``_copies`` (certain ones) and ``_key``, the rank of
    those that take part in the sample, else null. Keys have one length."""
    met = _join(rows, targets)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wanted = F.least(F.greatest(F.coalesce("_expected", ratio), F.lit(0.0)), F.lit(float(most)))
    met = met.withColumn("_copies", F.floor(wanted).cast("long")).withColumn("_part", wanted - F.floor(wanted))
    odds = F.col("_u") / (1 - F.col("_u")) * (1 - F.col("_part")) / F.col("_part")
    # x / (1 + x) keeps the order of the odds and maps them into (0, 1).
    place = F.least(F.floor(odds / (1 + odds) * F.lit(float(1 << 52))), F.lit((1 << 52) - 1)).cast("long")
    key = F.lpad(F.hex(place), KEY_DIGITS, "0")
    return met.withColumn("_key", F.when(F.col("_part") > 0, key)).drop("_part", "_u", "_expected")


def _cuts(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source, cut, gap)``: keys <= cut have together ``gap`` words less than wanted,
    and the next key would have more than wanted.

    ``units`` has (source, size, _key), ``wanted`` (source, want)."""
    state = wanted.select("source", "want", F.lit("").alias("prefix"), F.lit("").alias("cut"), F.lit(0).cast("long").alias("got"))
    run = Window.partitionBy("source").rowsBetween(Window.unboundedPreceding, 0)
    for length in [*range(HEX_STEP, KEY_DIGITS, HEX_STEP), KEY_DIGITS]:
        near = _join(units, state).filter(F.col("_key").startswith(F.col("prefix")))
        width = stage(near.groupBy("source", F.substring("_key", 1, length).alias("bucket")).agg(
            F.sum("size").alias("n"), F.count("*").alias("rows")), "buckets")
        met = _join(width, state).withColumn("total", F.col("got") + F.sum("n").over(run.orderBy("bucket")))
        below = F.col("total") <= F.col("want")
        step = met.groupBy("source").agg(
            F.max(F.when(below, F.col("bucket"))).alias("below"), F.max(F.when(below, F.col("total"))).alias("reached"),
            F.min(F.when(~below, F.struct("bucket", "rows"))).alias("next"),
        )
        # A cut inside the bucket comes before all keys that have the bucket as prefix.
        state = stage(_join(state, stage(step, "step")).select(
            "source", "want", F.coalesce(F.col("next.bucket"), F.lit("~")).alias("prefix"), F.col("next.rows").alias("rows"),
            F.coalesce(F.rpad("below", KEY_DIGITS, "G"), F.col("cut")).alias("cut"), F.coalesce("reached", "got").alias("got"),
        ), "cuts")
        if (state.agg(F.max("rows")).first()[0] or 0) <= RESOLVE_ROWS:
            break
        state = state.drop("rows")
    near = _join(units, state.drop("rows")).filter(F.col("_key").startswith(F.col("prefix")))
    keys = near.groupBy("source", "_key", "want", "got").agg(F.sum("size").alias("n"))
    totals = keys.withColumn("total", F.col("got") + F.sum("n").over(run.orderBy("_key"))).filter("total <= want")
    last = stage(totals.groupBy("source").agg(F.max("_key").alias("below"), F.max("total").alias("reached")), "last")
    return _join(state.drop("rows"), last).select(
        "source", F.coalesce("below", "cut").alias("cut"), (F.col("want") - F.coalesce("reached", "got")).alias("gap")
    )


def _sample(rows: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """``(source, cut, last)``: documents with a key <= cut or = last are in the sample."""
    drawn = _drawn(rows, targets, most)
    certain = drawn.groupBy("source").agg(F.sum(F.col("_copies") * F.col("size")).alias("sure"))
    want = F.greatest(F.round(F.col("target") - F.coalesce("sure", F.lit(0))).cast("long"), F.lit(0).cast("long"))
    wanted = stage(_join(targets, stage(certain, "certain")).select("source", want.alias("want")), "wanted")
    # Documents without words move no cut; they are compared with it like all others.
    units = drawn.filter("_key IS NOT NULL AND size > 0").select("source", "size", "_key")
    cuts = stage(_cuts(units, wanted), "cuts")
    # The document that fits the words still missing best, the smallest key among equals.
    over = _join(units, cuts).filter("_key > cut")
    same = over.groupBy("source", "_key", "gap").agg(F.sum("size").alias("n")).filter("n < 2 * gap")
    fit = same.groupBy("source").agg(F.min(F.struct(F.abs(F.col("n") - F.col("gap")), "_key"))["_key"].alias("last"))
    return stage(_join(cuts, stage(fit, "fit")).select("source", "cut", "last"), "sample")


def _planned(docs, id_col, text_col, source_col, weights, most, seed, expected):
    """The ranked rows, narrow and staged, with their copies; and a function that gives
    copies to other ranked rows of the same documents."""
    rows = _ranked(docs, id_col, text_col, source_col, seed, expected)
    narrow = stage(rows.drop("_row"), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, most), "targets")
    sample = _sample(narrow, targets, most)

    def copies(ranked: DataFrame) -> DataFrame:
        found = _join(_drawn(ranked, targets, most), sample)
        more = F.coalesce((F.col("_key") <= F.col("cut")) | F.col("_key").eqNullSafe(F.col("last")), F.lit(False))
        return found.withColumn("_copies", F.col("_copies") + (more & F.col("_key").isNotNull()).cast("long"))

    return rows, narrow, copies


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: str = SEED, expected: Column | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` (words taken,
    copies counted)."""
    _, narrow, copies = _planned(docs, id_col, text_col, source_col, weights, most, seed, expected)
    return copies(narrow).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("_copies") * F.col("size")).alias("taken")
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: str = SEED, expected: Column | None = None,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    rows, _, copies = _planned(docs, id_col, text_col, source_col, weights, most, seed, expected)
    one = F.lit(1).cast("long")
    planned = copies(rows).filter("_copies > 0")
    return planned.withColumn("_n", F.explode(F.sequence(one, F.col("_copies")))).select("_row.*")
