"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions only.

First pass: every text hash sets two bits of a blocked Bloom filter. Bits are
counted with partial aggregation and only those hit twice or more stay, as 4 KB
bitmaps, one per block. Second pass: a row whose two bits both stayed is possibly
repeated. Only such rows are shuffled and compared by SHA-256; all others are
known to be single and pass straight through.

The filter takes ``bits_per_row`` bits for a row and ``max_bits`` at most, so what
is broadcast never exceeds ``max_bits / 8`` bytes. Beyond ``max_bits /
bits_per_row`` rows more single rows pass for possibly repeated and take the
shuffle; the result stays the same.

Defined cases: a null text counts as empty; empty texts are equal to each other;
an id that is null loses to any other, and a group of null ids keeps one of them;
of rows equal in id and text one is kept; an empty table gives an empty result;
other columns are ignored (``exact_groups``) or carried along whatever their
names (``exact_dedup``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_rows, stage, text_of

BLOCK_BITS = 32_768
BITS_PER_ROW = 16
MAX_BITS = 1 << 31


def _positions(key: str, blocks: int) -> tuple[Column, Column, Column]:
    """Block and two bits inside it, from disjoint bits of one 64-bit hash."""
    h = F.xxhash64(key)
    first = h.bitwiseAND(F.lit(BLOCK_BITS - 1))
    second = F.shiftrightunsigned(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1))
    return F.pmod(F.shiftrightunsigned(h, 30), F.lit(blocks).cast("long")), first, second


def repeated_bits(
    hashes: DataFrame, key: str, rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS
) -> tuple[DataFrame, int]:
    """The bits that two or more rows set, as ``(_block, _map)``, and the number of
    blocks. At most ``max_bits / 8`` bytes."""
    blocks = max(1, math.ceil(min(rows * bits_per_row, max_bits) / BLOCK_BITS))
    block, first, second = _positions(key, blocks)
    hits = hashes.select(block.alias("_block"), F.explode(F.array(first, second)).alias("_bit"))
    twice = hits.groupBy("_block", "_bit").agg(F.count("*").alias("n")).filter("n >= 2")
    maps = twice.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    return stage(maps, "bloom"), blocks


def mark_repeated(rows: DataFrame, key: str, bits: DataFrame, blocks: int, flag: str = "_repeated") -> DataFrame:
    """Add ``flag``: true where the filter says that ``key`` may be repeated.
    Never false for a repeated key."""
    block, first, second = _positions(key, blocks)
    kept = rows.columns

    def has(bit: str) -> Column:
        byte = F.expr(f"substring(_map, cast({bit} div 8 as int) + 1, 1)")
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.expr(f"shiftleft(1, cast({bit} % 8 as int))").bitwiseAND(value) != 0

    placed = rows.select("*", block.alias("_block"), first.alias("_first"), second.alias("_second"))
    # The bitmaps are bounded by the size of the filter.
    met = placed.join(F.broadcast(bits), "_block", "left")
    return met.select(*kept, F.coalesce(has("_first") & has("_second"), F.lit(False)).alias(flag))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays. See the module for the
    defined cases.
    """
    hashes = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_of(text_col), 256).alias("text_sha256"))
    bits, blocks = repeated_bits(hashes, "text_sha256", docs.count(), bits_per_row, max_bits)
    marked = stage(mark_repeated(hashes, "text_sha256", bits, blocks), "marked")
    single = marked.filter("NOT _repeated").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    # Rows equal in id and text are interchangeable: count them, write them out again.
    copies = marked.filter("_repeated").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("_n"))
    groups = stage(
        copies.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("_n").alias("group_size")), "groups"
    )
    members = copies.join(groups, "text_sha256")
    one = F.lit(1).cast("long")
    members = members.withColumn("_i", F.explode(F.sequence(one, F.col("_n")))).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256",
    )
    return single.unionAll(members)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS,
) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows that the filter calls single do not move. Of the others one row per text is
    kept by a partially aggregated maximum, so a group of any size sends at most one
    row per task. Rows equal in id and text are told apart by their other columns.
    """
    hashed = docs.select(
        as_rows(docs).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.sha2(text_of(f"`{text_col}`"), 256).alias("_sha")
    )
    bits, blocks = repeated_bits(hashed, "_sha", docs.count(), bits_per_row, max_bits)
    marked = mark_repeated(hashed, "_sha", bits, blocks)
    plain = [f"_row.`{f.name}`" for f in docs.schema if f.name not in (id_col, text_col) and _orderable(f.dataType)]
    order = F.struct("_id", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(plain)])
    kept = marked.filter("_repeated").groupBy("_sha").agg(F.max_by("_row", order).alias("_row"))
    return marked.filter("NOT _repeated").select("_row.*").unionAll(kept.select("_row.*"))


def _orderable(kind) -> bool:
    return not any(word in kind.simpleString() for word in ("map<", "variant", "interval"))
