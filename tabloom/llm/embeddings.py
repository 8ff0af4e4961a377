"""Embedding near-deduplication: spherical k-means cells, blocked cosine products inside cells.

1. Equal vectors collapse to one, represented by their smallest id and counted.
2. Spherical k-means is fitted on a bounded sample (``FIT_VECTORS``); every vector is assigned to the
   cell of its nearest centroid, its home.
3. A pair with homes c < d is compared in cell c, which its other vector visits as a guest. Two vectors at an
   angle of at most a (cos a = threshold) can have different homes only if each lies within a of
   the border between the two centroids; so a vector visits exactly those lower cells whose border is that near. No pair over the threshold is
   lost, each is met once, and a vector far from a border visits nobody.
4. A cell is cut into blocks by a hash of the id, pairs of blocks are the tasks, and a task multiplies
   two blocks in tiles. Products in single precision select candidates; the
   decision is made in double precision. A task returns one row per vector with links: how many, and
   to which smaller vector it hangs. No list of pairs is made.
5. Components join what the tasks return.

The cells keep their size as the table grows (``CELL_VECTORS``) up to ``MAX_CELLS``.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing,
nor do vectors of different lengths with each other; rows without id link with nothing and have no component; rows equal in
id and vector count as two vectors; an empty table gives an empty result; other columns are ignored
(``near_components``) or carried along (``near_dedup``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import trie
from tabloom.llm.common import as_rows, stage
from tabloom.llm.components import components
from tabloom.session import local_table

THRESHOLD = 0.9
FIT_VECTORS = 10_000
CELL_SQUARE = 16
MAX_CELLS = 4_096
BLOCK = 8_192
TILE = 512
SLACK = 1e-3
SEED = 7


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, size)


def centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = (sample @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, home, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        found = np.where(length > 1e-9, total / np.maximum(length, 1e-9), found)
    return np.unique(found, axis=0)


def _assign(batches: Iterator[pa.RecordBatch], centers: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each vector in its home cell, and as a guest in the lower cells whose border is near."""
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9 if threshold > 0 else math.inf
    apart = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 1e-18))
    for batch in batches:
        for start in range(0, batch.num_rows, 4_096):
            part = batch.slice(start, 4_096)
            near = unit(_matrix(part.column(2), centers.shape[1])) @ centers.T
            home = near.argmax(axis=1)
            gap = near[np.arange(len(home)), home][:, None] - near
            visits = (gap <= reach * apart[home]) & (np.arange(len(centers)) < home[:, None])
            row, cell = np.nonzero(visits)
            rows, cells = np.concatenate((np.arange(len(home)), row)), np.concatenate((home, cell))
            guest = np.arange(len(rows)) >= len(home)
            taken = part.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(guest), *taken.columns], ["cell", "guest", *taken.schema.names])


def _compare(table: pa.Table, size: int, threshold: float) -> pa.Table:
    """Links inside one block, or between the two sides of a pair of blocks."""
    node, count = table.column("node").to_numpy(), table.column("n").to_numpy()
    whole = unit(_matrix(table.column("embedding").combine_chunks(), size))
    single = whole.astype(np.float32)
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(right) and table.column("a")[0].as_py() == table.column("b")[0].as_py() and not table.column("mixed")[0].as_py()
    right = left if within else right
    links, labels = np.zeros(len(node), np.int64), np.arange(len(node))
    for i in range(0, len(left), TILE):
        for j in range(i if within else 0, len(right), 4 * TILE):
            rows, cols = left[i:i + TILE], right[j:j + 4 * TILE]
            x, y = np.nonzero(single[rows] @ single[cols].T >= threshold - SLACK)
            x, y = rows[x], cols[y]
            if within:
                x, y = x[x < y], y[x < y]
            for at in range(0, len(x), 1 << 16):
                p, q = x[at:at + (1 << 16)], y[at:at + (1 << 16)]
                linked = np.einsum("ij,ij->i", whole[p], whole[q]) >= threshold
                p, q = p[linked], q[linked]
                np.add.at(links, p, count[q])
                np.add.at(links, q, count[p])
                trie.unite(labels, p, q)
    hit = np.flatnonzero(links)
    # Labels are positions; the smallest id of each component stands for it.
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, labels, node)
    return pa.table({"node": node[hit], "other": least[labels[hit]], "links": links[hit]})


def _links(classes: DataFrame, size: int, threshold: float, fit_vectors: int, max_cells: int, block: int) -> DataFrame:
    """``(node, other, links)`` of distinct vectors ``(node, n, embedding)`` of one length."""
    spark = classes.sparkSession
    n = classes.count()
    drawn = classes.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(fit_vectors).toArrow()
    sample = unit(_matrix(drawn.column("embedding").combine_chunks(), size))
    centers = centroids(sample, max(1, min(max_cells, round(math.sqrt(n) / CELL_SQUARE))))
    kind = dict(classes.dtypes)["embedding"]
    placed = stage(classes.select("node", "n", "embedding").mapInArrow(
        lambda b: _assign(b, centers, threshold), f"cell int, guest boolean, node bigint, n bigint, embedding {kind}"), "cells")
    # Two rows per cell at most.
    tally = {(r["cell"], r["guest"]): r["count"] for r in placed.groupBy("cell", "guest").count().collect()}
    blocks = [(c, math.ceil(tally.get((c, False), 0) / block), math.ceil(tally.get((c, True), 0) / block)) for c in range(len(centers))]
    cells = F.broadcast(local_table(spark, blocks, "cell int, homes int, guests int"))
    dealt = placed.join(cells, "cell").withColumn(
        "mine", F.pmod(F.xxhash64("node", F.lit(SEED)), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int"))
    # Home rows meet their own block, the other home blocks, and all guest blocks; guest rows meet home blocks.
    homes, guests = "sequence(0, homes - 1)", "IF(guests > 0, sequence(0, guests - 1), array())"
    tasks = F.expr(f"""IF(guest,
        transform({homes}, h -> named_struct('mixed', true, 'a', h, 'b', mine, 'side', 1)),
        concat(transform({homes}, h -> named_struct('mixed', false, 'a', least(h, mine), 'b', greatest(h, mine), 'side', IF(h < mine, 1, 0))),
               transform({guests}, g -> named_struct('mixed', true, 'a', mine, 'b', g, 'side', 0))))""")
    work = dealt.filter("homes > 0").select("cell", "node", "n", "embedding", F.explode(tasks).alias("t")).select("cell", "t.*", "node", "n", "embedding")
    return work.groupBy("cell", "mixed", "a", "b").applyInArrow(
        lambda table: _compare(table, size, threshold), "node bigint, other bigint, links bigint")


def near_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
    fit_vectors: int = FIT_VECTORS, max_cells: int = MAX_CELLS, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    whole = F.expr(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 "
        "AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x != 0)"
    )
    rows = rows.withColumn("whole", F.coalesce(whole, F.lit(False)))
    usable = rows.filter("whole").select("vec_id", "embedding")
    classes = stage(usable.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "vectors")
    found = None
    for (size,) in classes.select(F.size("embedding")).distinct().collect():
        of_size = classes.filter(F.size("embedding") == size)
        one = _links(of_size, size, threshold, fit_vectors, max_cells, block)
        found = one if found is None else found.unionAll(one)
    if found is None:
        found = classes.select("node", F.col("node").alias("other"), F.col("n").alias("links")).limit(0)
    found = stage(found, "links")
    roots = components(found.select("node", "other"), "node", "other")
    linked = found.groupBy("node").agg(F.sum("links").alias("others"))
    facts = stage(linked.join(roots, "node", "left").select(F.col("node").alias("_node"), "others", "root"), "facts")
    copies = stage(classes.filter("n > 1").select(F.col("embedding").alias("_same"), "node", F.col("n").alias("_n")), "copies")
    met = usable.join(copies, F.col("embedding") == F.col("_same"), "left").select(
        "vec_id", F.coalesce("node", "vec_id").alias("node"), F.coalesce(F.col("_n"), F.lit(1).cast("long")).alias("n"))
    met = met.join(facts, F.col("node") == F.col("_node"), "left").select(
        "vec_id", (F.coalesce("others", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    alone = rows.filter("NOT whole").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return met.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """The rows that stay, with all their columns: one representative per group."""
    found = near_components(vectors, id_col, **options)
    gone = stage(found.filter("NOT kept").select(F.col("vec_id").alias("_gone")).distinct(), "gone")
    rows = vectors.select(as_rows(vectors).alias("_row"), F.col(f"`{id_col}`").alias("_id"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
