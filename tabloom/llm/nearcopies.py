"""Near copies by the exact similarity of word shingles: a set-similarity self-join with prefix filter.

Two documents are near copies if the sets of their five-word shingles (lower-cased, as 64-bit hashes) have a Jaccard
similarity of 0.8 or more. No such pair is missed:

1. Classes: documents with equal sets are one class.
2. Prefixes: in any fixed order of all shingles, sets that similar share one of their first ``n // 5 + 1``. The order puts
   shingles last that are frequent in a sample; it decides how much work is done, never what is found.
3. Chains: the classes that share a prefix shingle are compared along two chains, so that a large group of near copies
   becomes one component without comparing all its pairs.
4. The rest: pairs that share a prefix shingle and are in different components still. Those go that share too few prefix
   shingles to reach 0.8; all others are compared.
5. Components: ``components.components`` joins the links.

Defined cases: a null text counts as empty; texts without words are equal to each other; fewer words than a shingle give one
shingle of them all; rows without id are kept and link nothing; rows sharing an id share a component; an empty table gives
an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_rows, forget, frugal, in_slices, per_text, stage, text_of
from tabloom.llm.components import components
from tabloom.llm.simhash import words_in_pieces

SHINGLE = 5
# Similarity SAME / (SAME + APART) = 0.8 in whole numbers.
SAME, APART = 4, 1
# The order of shingles is learned from about so many documents.
SAMPLE_DOCS = 8_000
FREQUENT = 50_000
PAIRS_AT_ONCE = 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, sorted."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in words_in_pieces(data)]
    words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    width = min(size, len(words))
    mixed = np.full(max(1, len(words) - size + 1), width, np.uint64)
    for i in range(width):
        mixed = mixed * _FACTOR + words[i:i + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ mixed >> np.uint64(32))


def class_of(found: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(found.tobytes())
    return value - (1 << 64) if value >> 63 else value


def prefix(found: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The shingles of a set of which any set of similarity 0.8 has one in its own prefix."""
    rank = np.zeros(len(found), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        rank = np.where(frequent[at] == found, place[at], 0)
    return found[np.lexsort((found, rank))[:prefix_size(len(found))]]


def prefix_size(n: int) -> int:
    return n - -(-SAME * n // (SAME + APART)) + 1


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent in a sample and their places in the order, from rare to frequent."""
    step = max(1, rows.count() // SAMPLE_DOCS)

    def make():
        return lambda data: (shingles(data).view(np.int64).tolist(),)

    some = rows.filter(F.pmod(F.xxhash64("_text"), F.lit(step)) == 0).select("_text")
    counts = per_text(some, make, "h array<bigint>").select(F.explode("h").alias("h")).groupBy("h").count().filter("count > 2")
    top = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    hashes = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    places = np.arange(len(top), 0, -1)
    order = np.argsort(hashes)
    return hashes[order], places[order]


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by ``h``, of which a neighbour has the same ``h``."""
    held: pa.RecordBatch | None = None
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        (h,) = _numbers(table, "h")
        same = h[1:] == h[:-1]
        keep = np.concatenate(([h[0] == before if before is not None else False], same)) | np.concatenate((same, [False]))
        yield table.slice(0, len(h) - 1).filter(pa.array(keep[:-1]))
        held, before = table.slice(len(h) - 1), h[-2] if len(h) > 1 else before
    if held is not None and before is not None and _numbers(held, "h")[0][0] == before:
        yield held


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Whole groups of equal ``h``, one after the other, as columns ``names``."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        h, *columns = (table.column(n).to_numpy() for n in ("h", *names))
        ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
        starts = np.concatenate(([0], ends[:-1]))
        for a, b in list(zip(starts, ends))[:None if last else -1]:
            yield [c[a:b] for c in columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        h = _numbers(batch, "h")[0]
        # A group longer than a batch waits for its end.
        if held and h[-1] == _numbers(held[0], "h")[0][0]:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        yield from cut(table, False)
        first = int(np.searchsorted(table.column("h").to_numpy(), h[-1]))
        held = table.slice(first).combine_chunks().to_batches()
    if held:
        yield from cut(pa.Table.from_batches(held), True)


_PAIR = "a bigint, b bigint, na bigint, nb bigint"


def _emitted(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes with their sizes, smaller class first; pairs of too different sizes go."""
    held, rows = [], 0

    def batch():
        a, b, na, nb = (np.concatenate(x) for x in zip(*held))
        turn = a > b
        out = [np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)]
        near = (SAME + APART) * np.minimum(na, nb) >= SAME * np.maximum(na, nb)
        return pa.RecordBatch.from_arrays([pa.array(x[near]) for x in out], names=["a", "b", "na", "nb"])

    for pairs in found:
        held.append(pairs)
        rows += len(pairs[0])
        if rows >= PAIRS_AT_ONCE:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for cls, n in _groups(batches, ["cls", "n"]):
            orders = [np.lexsort((cls, n))]
            if len(cls) > 2:
                orders.append(np.argsort(cls.view(np.uint64) * _FACTOR))
            for o in orders:
                yield cls[o[:-1]], cls[o[1:]], n[o[:-1]], n[o[1:]]

    yield from _emitted(found())


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        for cls, n, root in _groups(batches, ["cls", "n", "root"]):
            if (root == root[0]).all():
                continue
            o = np.argsort(n, kind="stable")
            cls, n, root = cls[o], n[o], root[o]
            ends = np.searchsorted(n, n * (SAME + APART) // SAME, "right")
            for i, end in enumerate(ends.tolist()):
                j = i + 1 + np.flatnonzero(root[i + 1:end] != root[i])
                if len(j):
                    yield np.full(len(j), cls[i]), cls[j], np.full(len(j), n[i]), n[j]

    yield from _emitted(found())


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs that can be similar enough by the number of prefix shingles they share: common shingles lie in both prefixes
    or behind the prefix that ends first."""
    share = F.count("*")
    all_, want = SAME + APART, 2 * SAME + APART
    rest = F.greatest(*[F.floor(F.lit(SAME) * F.col(n) / all_ + F.lit((all_ - 1) / all_)) for n in ("na", "nb")])
    counted = pairs.groupBy("a", "b").agg(share.alias("c"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return counted.filter((F.col("c") + rest) * want >= (F.col("na") + F.col("nb")) * SAME).select("a", "b")


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "sb"):
        a, b = _numbers(batch, "a", "b")
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = both * (2 * SAME + APART) >= SAME * (len(x) + len(y))
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs of similarity 0.8 or more. Only texts of classes that occur in ``pairs`` are read into sets again."""

    def make():
        def sets(data: bytes):
            found = shingles(data)
            return class_of(found), found.tobytes()

        return sets

    classes = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    texts = prints.join(classes, "cls", "left_semi").groupBy("cls").agg(F.min("th").alias("_th")).select("_th").distinct()
    texts = stage(texts, "texts")
    read = rows.select("_text", F.xxhash64("_text").alias("_h")).join(texts, F.col("_h") == F.col("_th"), "left_semi").select("_text")
    sets = stage(per_text(read, make, "cls bigint, s binary").groupBy("cls").agg(F.first("s").alias("s")), "sets")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    return stage(both.mapInArrow(frugal(_similar), "a bigint, b bigint"), "similar")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` per row: the smallest id of the component of near copies."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("_text"))
    frequent, place = _frequent(rows)

    def make():
        forget()

        def marks(data: bytes):
            found = shingles(data)
            return class_of(found), len(found), prefix(found, frequent, place).view(np.int64).tolist()

        return marks

    marked = per_text(rows.select("doc_id", F.xxhash64("_text").alias("th"), "_text"), make, "cls bigint, n bigint, h array<bigint>")
    marked = stage(marked, "prefixes")
    prints = marked.select("doc_id", "th", "cls")
    first = marked.filter("doc_id IS NOT NULL").select("cls", "n", F.explode("h").alias("h"))
    # Equal sets are one row of each group.
    shared = first.repartition("h").sortWithinPartitions("h").mapInArrow(frugal(_shared), "cls bigint, n bigint, h bigint").distinct()
    shared = stage(shared, "shared")
    chained = shared.repartition("h").sortWithinPartitions("h").mapInArrow(frugal(_chains), _PAIR)
    tested = stage(_possible(chained), "chained")
    links = _verified(tested, prints, rows)
    roots = components(links).select(F.col("node").alias("cls"), "root")
    rooted = shared.join(roots, "cls", "left").select("cls", "n", "h", F.coalesce("root", "cls").alias("root"))
    apart = rooted.repartition("h").sortWithinPartitions("h").mapInArrow(frugal(_apart), _PAIR)
    rest = stage(_possible(apart).join(tested, ["a", "b"], "left_anti"), "apart")
    links = links.unionAll(_verified(rest, prints, rows))
    # Classes that share an id.
    owners = prints.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("cls").alias("_lo"), F.max("cls").alias("_hi")).filter("_lo < _hi")
    links = links.unionAll(prints.join(owners, "doc_id").filter("cls > _lo").select(F.col("cls").alias("a"), F.col("_lo").alias("b")))
    roots = components(links).select(F.col("node").alias("cls"), "root")
    ids = prints.filter("doc_id IS NOT NULL").groupBy("cls").agg(F.min(F.col("doc_id").cast("long")).alias("_id"))
    named = stage(ids.join(roots, "cls", "left").select("cls", "_id", F.coalesce("root", "cls").alias("root")), "rooted")
    least = named.groupBy("root").agg(F.min("_id").alias("component_id"))
    named = stage(named.join(least, "root").select("cls", "component_id"), "named")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(named, "cls", "left").select("doc_id", component)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay: of each component the one with the smallest id, and all rows without id."""
    found = near_components(docs, id_col, text_col)
    gone = stage(found.filter("doc_id != component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = docs.select(as_rows(docs).alias("_row"), F.col(f"`{id_col}`").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
