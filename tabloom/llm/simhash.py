"""SimHash near-deduplication with a distributed binary trie self-join.

1. Fingerprints: each text becomes 64 bits (majority vote over the XXH64 values of its
   word shingles). Equal fingerprints collapse to one class, represented by its
   smallest id.
2. Links: with at most three differing bits at least one of four 16-bit blocks is
   equal. Every class is sent to four groups, one for each block and its value; there
   the trie (block first, then the other bits) is joined with itself below the node
   of that block (``trie.link``). A group with more than ``HOT_GROUP`` classes is first
   split into pairs of its nodes six bits further down, dropping pairs over the budget.
   A task gives back at most one link per member: which smaller member it hangs to.
3. Components: ``components.components`` joins the links of all groups.

Defined cases: a null text counts as empty; texts without words have fingerprint zero
and are linked like any other; fewer words than a shingle give one shingle of them all;
rows without id get a fingerprint and take no part in the linking (``component_id``
null, kept); rows sharing an id share a component; an empty table gives an empty
result; other columns are ignored or, in ``simhash_dedup``, carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import trie
from tabloom.llm.common import as_rows, per_text, stage, text_of
from tabloom.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
HOT_GROUP = 65_536
SPLIT_BITS = 6
# A task works on whole groups, about so many members at a time.
BATCH_MEMBERS = 200_000
PIECE_BYTES = 1 << 20
SPACE = b" \t\n\v\f\r"

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OF = (np.arange(8) * 256).astype(np.int64)


def words_in_pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time; no word is cut."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in SPACE:
            end += 1
        yield data[at:end].lower().split()
        at = end


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the UTF-8 bytes of a text, as an unsigned number."""
    votes, total, tail = np.zeros(64, np.int64), 0, []

    def vote(shingles: list[bytes]) -> None:
        nonlocal votes, total
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
        places = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OF
        counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256)
        votes += (counts @ _BYTE_BITS).ravel()
        total += len(shingles)

    for piece in words_in_pieces(data):
        words = tail + piece
        if len(words) >= shingle:
            vote([b" ".join(s) for s in zip(*(words[i:] for i in range(shingle)))])
            tail = words[len(words) - shingle + 1:] if shingle > 1 else []
        else:
            tail = words
    if not total and tail:
        vote([b" ".join(tail)])
    bits = (votes * 2 > total).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` per row; ``fp`` is the fingerprint as a signed long."""

    def make():
        def signed(data: bytes) -> tuple[int]:
            value = fingerprint(data, shingle)
            return (value - (1 << 64) if value >> 63 else value,)

        return signed

    return per_text(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")), make, "fp bigint")


def _group_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Links inside groups. Rows come sorted by group (turn, block, lo, hi) and then by
    the rotated fingerprint; a group of a node pair has lo < hi."""
    held: list[pa.Table] = []
    rows = 0

    def work(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("turn", "block", "lo", "hi")])
        value = table.column("turned").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        node = table.column("node").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        last = np.append(first[1:], len(value))
        lo, hi = key[2, first], key[3, first]
        # Node pairs: the members of the lower node come first.
        shift = np.uint64(64 - BLOCK_BITS - SPLIT_BITS)
        below = ((value >> shift) & np.uint64((1 << SPLIT_BITS) - 1)).astype(np.int64) <= np.repeat(lo, last - first)
        count = np.add.reduceat(below, first)
        split = lo < hi
        cut = first + count
        roots = [first, np.where(split, cut, last), np.where(split, cut, first), last]
        real = (roots[1] > roots[0]) & (roots[3] > roots[2])
        labels = trie.link(value, [r[real] for r in roots], BLOCK_BITS, budget)
        hung = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[labels[hung]])], names=["a", "b"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= BATCH_MEMBERS:
            table = pa.concat_tables(held)
            ends = np.stack([table.column(c).to_numpy() for c in ("turn", "block", "lo", "hi")])
            open_from = np.flatnonzero((ends != ends[:, -1:]).any(axis=0))
            if len(open_from):
                yield work(table.slice(0, open_from[-1] + 1))
                table = table.slice(open_from[-1] + 1)
            held, rows = [table], table.num_rows
    if rows:
        yield work(pa.concat_tables(held))


def fingerprint_links(classes: DataFrame, budget: int = MAX_BITS, hot: int = HOT_GROUP) -> DataFrame:
    """Links ``(a, b)`` between the nodes of distinct fingerprints ``(fp, node)`` that
    connect all fingerprints differing in at most ``budget`` (3 at most) bits."""
    if not 1 <= budget < BLOCKS:
        raise ValueError(f"budget must be from 1 to {BLOCKS - 1}")
    turn = F.explode(F.array(*[F.lit(i) for i in range(BLOCKS)])).alias("turn")
    turned = classes.select("node", "fp", turn).withColumn(
        "turned",
        F.expr(f"shiftleft(fp, {BLOCK_BITS} * turn) | CASE WHEN turn = 0 THEN 0L "
               f"ELSE shiftrightunsigned(fp, 64 - {BLOCK_BITS} * turn) END"),
    )
    # The sign bit is flipped so that signed order is the order of the bits.
    grouped = turned.select(
        "turn", F.expr(f"cast(shiftrightunsigned(turned, {64 - BLOCK_BITS}) AS int)").alias("block"), "node",
        F.expr("turned ^ (-9223372036854775807L - 1L)").alias("turned"),
        F.expr(f"cast(shiftrightunsigned(turned, {64 - BLOCK_BITS - SPLIT_BITS}) & {(1 << SPLIT_BITS) - 1} AS int)").alias("part"),
    )
    sizes = stage(grouped.groupBy("turn", "block").count().filter(F.col("count") > hot).drop("count"), "hotgroups")
    mates = F.expr(f"filter(sequence(0, {(1 << SPLIT_BITS) - 1}), q -> bit_count(part ^ q) <= {budget})")
    whole = grouped.select("turn", "block", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), "turned", "node")
    if not sizes.isEmpty():
        # At most four times the classes by HOT_GROUP rows.
        whole = grouped.join(sizes, ["turn", "block"], "left_anti").select(*[
            "turn", "block", F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), "turned", "node"])
        parts = grouped.join(sizes, ["turn", "block"], "left_semi").withColumn("mate", F.explode(mates))
        whole = whole.unionAll(parts.select(
            "turn", "block", F.least("part", "mate").alias("lo"), F.greatest("part", "mate").alias("hi"), "turned", "node"))
    keys = ["turn", "block", "lo", "hi"]
    dealt = whole.repartition(*keys).sortWithinPartitions(*keys, "turned")
    return dealt.mapInArrow(lambda batches: _group_links(batches, budget), "a bigint, b bigint")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, budget: int = MAX_BITS, hot: int = HOT_GROUP,
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stage(
        prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("node")), "classes"
    )
    roots = components(fingerprint_links(classes, budget, hot))
    named = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    named = stage(named, "named")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp", "left").select("doc_id", digits, component)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay: of each component the one with the smallest id, and all
    rows without id. Only the ids of dropped documents are joined."""
    found = simhash_components(docs, id_col, text_col, **options)
    gone = stage(found.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = docs.select(as_rows(docs).alias("_row"), F.col(f"`{id_col}`").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
