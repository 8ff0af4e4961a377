"""Source divergence audit by products of one-hot level matrices.

For each language, how far does the word use of every source lie from that of every other? Within a source a term's probability
depends only on how often it occurs there (its level). So a pair of sources is priced from its joint table: how many terms have level
a in one and level b in the other. For a block of terms, let X have a row per term and an indicator column per (source, level); the product
of the transpose of X with X holds the joint tables of all pairs. Blocks are multiplied by different tasks, in slices of terms of similar frequency so
that few levels meet; the entries are counts below 2^24, exact in single precision. Each table is priced where it is made, in whole
numbers, and the sums over blocks are added up.

Probabilities are whole billionths: ``1 + floor(10^9 * (count + 1) / (N + V))``; a term's share of a divergence is ``floor((p - q)^2 / q)``.
Sums stay inside 64 bits while a language keeps fewer than 2 * 10^9 terms, since the probabilities of a source add up to at most 10^9 + V.

Words are counted per task before anything moves. A term of a language is met once per source in each task at most, and the rows of a block are bounded, so neither a
hot source nor a common word fills a task. The result has a row per ordered pair of sources of a language, and no other pairs are made.

Defined cases: null text, language or source count as empty strings, and are groups like others; bytes that are not UTF-8 become U+FFFD; a group without terms
has every term at level zero; a language without kept terms has pairs of value zero; a language with one source has no pairs;
repeated rows count as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import in_slices, stage, text_of, whole_utf8

LEAST_DOCS = 3
ONE = 1_000_000_000
TOP_TERMS = 200
# Terms counted in a task before they are handed on.
HELD_TERMS = 400_000
# Terms and sources of a block hold at most this many rows, about; slices of a block have this many terms.
BLOCK_ROWS = 1 << 17
SLICE_TERMS = 64
# Columns of one factor of a product: a product takes at most 16 MB.
TILE_COLUMNS = 2_048
# Letters stay, A to Z become lower case, other ASCII separates; bytes of other characters stay.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(LETTERS).split()


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents, counted per task; the same term may come from several
    tasks. A row with a null term stands for the group itself."""
    ready = docs.select(text_of(f"`{lang_col}`").alias("lang"), text_of(f"`{source_col}`").alias("source"), text_of(f"`{text_col}`").cast("binary").alias("_text"))

    def rows(groups: dict) -> pa.RecordBatch:
        out = [(lang, source, None, 0, 0) for lang, source in groups]
        for (lang, source), (times, texts) in groups.items():
            out += [(lang, source, term.decode(), n, texts[term]) for term, n in times.items()]
        columns = list(zip(*out))
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in in_slices(batches, "_text"):
            for lang, source, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, source) not in groups:
                    groups[lang, source] = Counter(), Counter()
                times, texts = groups[lang, source]
                terms = terms_of(whole_utf8(data))
                times.update(terms)
                texts.update(set(terms))
            if sum(len(times) + 1 for times, _ in groups.values()) > HELD_TERMS:
                yield rows(groups)
                groups = {}
        if groups:
            yield rows(groups)

    return ready.mapInArrow(run, COUNTED)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, **columns) -> DataFrame:
    """``lang, source, term, n, total, first``: counts of the terms that occur in ``least_docs`` documents of the language, ``total``
    over its sources, ``first`` on one row of each term. A row with a null term for each group."""
    # One exchange serves the sums and the window: rows of a term in a language, at most one per source and task.
    counted = count_terms(docs, **columns).repartition("lang", "term")
    summed = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rated = summed.select("*", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("_docs"),
                          (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    return rated.filter(F.col("term").isNull() | (F.col("_docs") >= least_docs)).select("lang", "source", "term", "n", "total", "first")


def billionths(count: str, size: str) -> Column:
    """``1 + floor(10^9 * (count + 1) / size)``, exact for any 64-bit count."""
    return F.expr(f"1L + ((cast({count} as decimal(20, 0)) + 1) * {ONE}BD) div cast({size} as decimal(20, 0))")


def group_sizes(kept: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per language and source: ``size`` (N + V), ``lang_size``, ``terms`` (V), and ``blocks`` of the language."""
    mine = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("_n"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("_first"))
    lang = Window.partitionBy("lang")
    sized = mine.select("lang", "source", "_n", F.sum("_first").over(lang).alias("terms"), F.sum("_n").over(lang).alias("_all"),
                        F.count("*").over(lang).alias("_sources"))
    of_block = F.greatest(F.lit(SLICE_TERMS), F.floor(F.lit(block_rows) / F.col("_sources")))
    return sized.select("lang", "source", "terms", (F.col("_n") + F.col("terms")).alias("size"), (F.col("_all") + F.col("terms")).alias("lang_size"),
                        F.ceil(F.col("terms") / of_block).cast("long").alias("blocks"))


def joint_tables(levels: np.ndarray, of_source: range, with_source: range) -> Iterator[tuple]:
    """Joint tables of two ranges of sources, from the matrix of level numbers (terms x sources).

    For each slice of terms: ``(columns, others, product)``, where columns are (source, level) as two arrays and
    the product counts the terms at each pair of columns.
    """
    def one_hot(part: np.ndarray, sources: range) -> tuple:
        keys = part[:, sources.start:sources.stop] + np.arange(sources.start, sources.stop) * span
        columns, place = np.unique(keys, return_inverse=True)
        matrix = np.zeros((len(part), len(columns)), np.float32)
        matrix[np.arange(len(part))[:, None], place.reshape(keys.shape)] = 1
        return (columns // span, columns % span), matrix

    span = int(levels.max()) + 1 if levels.size else 1
    for start in range(0, len(levels), SLICE_TERMS):
        part = levels[start:start + SLICE_TERMS]
        columns, left = one_hot(part, of_source)
        others, right = (columns, left) if of_source == with_source else one_hot(part, with_source)
        yield columns, others, left.T @ right


def price_block(counts: np.ndarray, prices: np.ndarray) -> np.ndarray:
    """Divergence of every source (row) from every other (column) over the terms of a block, given the counts and whole
    probabilities of its terms (terms x sources)."""
    order = np.argsort(counts.sum(axis=1), kind="stable")
    counts, prices = counts[order], prices[order]
    distinct, levels = np.unique(counts, return_inverse=True)
    levels = levels.reshape(counts.shape)
    sources = counts.shape[1]
    # The price of a level, per source: the same for all terms of that level.
    price = np.zeros((sources, max(1, len(distinct))), np.int64)
    price[np.broadcast_to(np.arange(sources), counts.shape), levels] = prices
    total = np.zeros((sources, sources), np.int64)
    width = max(1, TILE_COLUMNS // SLICE_TERMS)
    tiles = [range(i, min(i + width, sources)) for i in range(0, sources, width)]
    for of_source in tiles:
        for with_source in tiles:
            for columns, others, product in joint_tables(levels, of_source, with_source):
                a, b = np.nonzero(product)
                p, q = price[columns[0][a], columns[1][a]], price[others[0][b], others[1][b]]
                np.add.at(total, (columns[0][a], others[0][b]), (p - q) * (p - q) // q * product[a, b].astype(np.int64))
    return total


def _price_table(table: pa.Table) -> pa.Table:
    lang = table.column("lang")[0].as_py()
    empty = table.column("term").is_null().to_numpy()
    source = table.column("source").combine_chunks().dictionary_encode()
    names, place = source.dictionary.to_pylist(), source.indices.to_numpy()
    term = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    n, p = table.column("n").to_numpy(), table.column("p").to_numpy()
    k, terms = len(names), int(term.max(initial=-1)) + 1
    at_zero = np.zeros(k, np.int64)
    at_zero[place[empty]] = p[empty]
    counts, prices = np.zeros((terms, k), np.int64), np.tile(at_zero, (terms, 1))
    counts[term[~empty], place[~empty]] = n[~empty]
    prices[term[~empty], place[~empty]] = p[~empty]
    total = price_block(counts, prices)
    a, b = np.nonzero(total)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array([names[i] for i in a], pa.string()),
                     "item": pa.array([names[i] for i in b], pa.string()), "value": pa.array(total[a, b], pa.int64())})


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: each source against each other source of its language."""
    key = ["lang", "source"]
    known = groups.filter("terms > 0")
    rows = kept.filter("term IS NOT NULL").join(known, key).select(
        *key, "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), billionths("n", "size").alias("p"))
    # What a source has at level zero, for every block of its language.
    zero = known.select(*key, F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), billionths("0", "size").alias("p"))
    priced = rows.unionByName(zero).groupBy("lang", "block").applyInArrow(_price_table, "lang string, source string, item string, value bigint")
    summed = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # The rows of the result: the other sources of each source's language.
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select(*key).join(others, "lang").filter("source != item")
    return pairs.join(summed, ["lang", "source", "item"], "left").select(*key, "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def term_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: terms more frequent in a source than in its language."""
    met = kept.filter("term IS NOT NULL AND n > 0").join(groups, ["lang", "source"])
    priced = met.select("lang", "source", F.col("term").alias("item"), billionths("n", "size").alias("p"), billionths("total", "lang_size").alias("q"))
    return priced.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def source_audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, **columns) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the divergence of every source from each other source of
    its language; part ``term`` the ``top_terms`` terms that set a source apart from its language."""
    kept = stage(kept_terms(docs, least_docs, **columns), "terms")
    groups = stage(group_sizes(kept), "groups")
    # Per-task ranks cut the terms of a source before they move.
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda rows, part: rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = ranked(term_divergences(kept, groups), "term").filter(F.col("rank") <= top_terms)
    return ranked(pair_divergences(kept, groups), "pair").unionByName(terms)
