"""Quality rules on how public vocabularies cut a text, with rejection bands per language.

Three measures of the words of a text, in thousandths: characters per token of a byte-level vocabulary; the share of byte-fallback tokens
of a vocabulary with byte fallback; the entropy in bits of the tokens of the byte-level vocabulary. Each word is cut by itself, so white space has no part in
them, and a word that comes again is not cut again. Text in the language it is
said to be in keeps close to what is usual for that language and length; symbols between words, random letters, tables, and
text in no language leave it.

Bands. What is usual is read off all documents that pass the base rules: counts of each value of a measure per language and
length class (power of two of the number of tokens), from which the quartiles follow exactly. The band is the median, less ``WIDTH``
times the lower and plus ``WIDTH`` times the upper robust deviation (distance of the quartile / 0.6745), at least ``FLOORS``. Equal
measures count once, so that copies of one document do not become what is usual. A class with fewer than ``LEAST_DOCS`` such values
takes the band of its length class over all languages, then that of all documents; without that many at all, nothing is outside.
Counts are aggregated before they move, and a class has a bounded number of values, so the documents of a language never meet in a task.

Base rules: a document fails with fewer than 50 words, or with more than half its words in three-word windows that occur twice or more.

Defined cases: a null or empty text has no words, so it fails; bytes that are not UTF-8 become U+FFFD; a null language is a language of its
own; rows are judged alone, so repeated rows get equal verdicts; an empty table gives an empty result; long texts are read in blocks
of words; other columns are ignored
(``fertility_report``) or carried along whatever their names (``keep_fertile``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.bpe import read_ranks
from tabloom.llm.common import as_rows, held, per_text, stage, text_of, whole_utf8

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
ANY_SPACE = re.compile(b"[" + SPACES + b"]")
# Words are read in blocks of so many bytes; longer words are cut into pieces of so many characters for the vocabularies.
WORD_BLOCK = 1 << 18
PIECE_CHARS = 65_536
# Words remembered in a worker, and the longest of them.
KNOWN_WORDS = 200_000
KNOWN_BYTES = 64
# Words that are cut in one call.
WORDS_AT_ONCE = 512
MEASURES = ("chars_per_token", "fallback_share", "entropy")
WIDTH = 4.5
# Least deviations in thousandths, per measure.
FLOORS = {"chars_per_token": 40, "fallback_share": 20, "entropy": 80}
# Values above are counted as this; no text comes near in entropy (2^17 thousandths are 131 bits) or share.
MOST = 1 << 17
LEAST_DOCS = 100

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
MEASURED = COUNTS + ", n_tokens bigint, chars_per_token bigint, fallback_share bigint, entropy bigint"


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """A word in pieces of at most ``most`` characters."""
    return (text[i:i + most] for i in range(0, len(text), most))


def repeated_words(words: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more, given each word's number."""
    if len(words) < 4:
        return 0
    distinct = int(words.max()) + 1
    _, pairs = np.unique(words[:-2] * distinct + words[1:-1], return_inverse=True)
    _, windows, counts = np.unique(pairs * distinct + words[2:], return_inverse=True, return_counts=True)
    twice = counts[windows] > 1
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift:len(words) - 2 + shift] |= twice
    return int(np.count_nonzero(inside))


def word_blocks(data: bytes, most: int = WORD_BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, in blocks of about ``most`` bytes."""
    start = 0
    while start < len(data):
        border = ANY_SPACE.search(data, min(start + most, len(data)))
        end = border.start() if border else len(data)
        yield data[start:end].split()
        start = end


def line_counts(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measures_of(data: bytes, tools: Vocabularies) -> tuple:
    """The columns ``MEASURED`` of a valid UTF-8 text, its words read once."""
    numbers: dict[bytes, int] = {}
    placed = []

    def blocks() -> Iterator[list[bytes]]:
        for words in word_blocks(data):
            new = [w for w in dict.fromkeys(words) if w not in numbers] if numbers else dict.fromkeys(words)
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new))))
            placed.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            yield words

    chars = len(data.decode()) - (len(data) - len(data.translate(None, SPACES)))
    tokens = tools.measure(blocks(), chars)
    words = np.concatenate(placed) if placed else np.zeros(0, np.int64)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), chars, symbols, line_counts(data), repeated_words(words), *tokens


class Vocabularies:
    """Two public vocabularies and what they make of words, each word by itself with a space before it.

    What a word becomes is remembered, in two generations of at most ``KNOWN_WORDS`` words each; no result depends on that.
    """

    def __init__(self, byte_level: str, pattern: str, with_fallback: str, known_words: int = KNOWN_WORDS):
        self.encoder = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=read_ranks(byte_level), special_tokens={})
        self.processor = sentencepiece.SentencePieceProcessor(model_file=with_fallback)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.bytes = np.array([self.processor.is_byte(i) for i in range(len(names))], np.int64)
        self.begins = np.array([name.startswith("\u2581") for name in names])
        self.most = known_words
        # Of a word: its byte-level tokens, the number of its tokens with fallback, and how many of these are bytes.
        self.known: dict[bytes, tuple[list[int], int, int]] = {}
        self.older: dict[bytes, tuple[list[int], int, int]] = {}

    def _read(self, words: list[bytes]) -> list[tuple[list[int], int, int]]:
        """What the vocabularies make of words. Short ones share calls of the second one: in a line of words each begins with the one
        piece that begins with a space mark, unless a word holds such marks itself, and then they are cut alone."""
        texts = [w.decode() for w in words]
        encode = self.encoder.encode_ordinary
        ids = [encode(" " + t) if len(t) <= PIECE_CHARS else [i for part in pieces(" " + t) for i in encode(part)] for t in texts]
        made: list[tuple[int, int]] = []
        for start in range(0, len(texts), WORDS_AT_ONCE):
            some = texts[start:start + WORDS_AT_ONCE]
            together = sum(map(len, some)) <= PIECE_CHARS
            line = np.asarray(self.processor.encode(" ".join(some)) if together else [], np.int64)
            begins = np.flatnonzero(self.begins[line])
            if len(begins) == len(some):
                made += zip(np.diff(np.append(begins, len(line))).tolist(), np.add.reduceat(self.bytes[line], begins).tolist())
            else:
                alone = [[i for part in pieces(t) for i in self.processor.encode(part)] for t in some]
                made += [(len(other), int(np.count_nonzero(self.bytes[other]))) for other in alone]
        return [(mine, *other) for mine, other in zip(ids, made)]

    def _entries(self, words: list[bytes]) -> list[tuple[list[int], int, int]]:
        """Of each word of a block, in order."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, self.older, new = {}, self.known, set(words)
        met = {w: self.older[w] for w in new if w in self.older}
        unknown = [w for w in new if w not in met]
        met.update(zip(unknown, self._read(unknown)))
        self.known.update(met)
        found = list(map(self.known.__getitem__, words))
        for word in unknown:
            if len(word) > KNOWN_BYTES:
                del self.known[word]
        return found

    def measure(self, blocks: Iterable[list[bytes]], chars: int) -> tuple[int, int | None, int | None, int | None]:
        """Tokens, and the three measures (null without tokens) of a text with ``chars`` characters in words, given in blocks of words."""
        counts: Counter = Counter()
        n = fallback = with_fallback = 0
        for words in blocks:
            if words:
                ids, sizes, byte_sizes = zip(*self._entries(words))
                counts.update(chain.from_iterable(ids))
                with_fallback += sum(sizes)
                fallback += sum(byte_sizes)
        n = counts.total()
        if not n:
            return 0, None, None, None
        times = Counter(counts.values())
        entropy = max(0.0, math.log2(n) - math.fsum(k * c * math.log2(c) for c, k in times.items()) / n)
        return n, min(MOST, 1000 * chars // n), 1000 * fallback // max(1, with_fallback), round(1000 * entropy)


def vocabularies(byte_level: str, pattern: str, with_fallback: str) -> Vocabularies:
    return held(("fertility", byte_level, pattern, with_fallback), lambda: Vocabularies(byte_level, pattern, with_fallback))


def measured(rows: DataFrame, byte_level: str, pattern: str, with_fallback: str) -> DataFrame:
    """The rows with the columns ``MEASURED`` of ``_text`` in its place."""

    def make():
        tools = vocabularies(byte_level, pattern, with_fallback)

        return lambda data: measures_of(whole_utf8(data), tools)

    return per_text(rows, make, MEASURED)


def fails_base(least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED_PERCENT) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def length_class() -> Column:
    return F.floor(F.log2(F.col("n_tokens"))).cast("int")


def bands(rows: DataFrame, width: float = WIDTH, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``(lang, size, measure, low, high)`` from measured rows that pass the base rules. A null ``lang`` or ``size`` with
    ``level`` 1 or 0 is the band over all languages, or over everything; ``level`` 2 is a language and length class."""
    seen = rows.select("lang", length_class().alias("size"), "n_tokens", *MEASURES).distinct()
    values = seen.select("lang", "size", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.least(F.col(m), F.lit(MOST)).alias("value")) for m in MEASURES])).alias("m"))
    counted = values.groupBy("lang", "size", "m.measure", "m.value").agg(F.count("*").alias("n"))
    counted = counted.select("lang", "size", "measure", "value", "n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"))
    where = [F.when(F.col("level") == 2, F.col("lang")).alias("lang"), F.when(F.col("level") >= 1, F.col("size")).alias("size")]
    counted = counted.select(*where, "measure", "level", "value", "n").groupBy("lang", "size", "measure", "level", "value").agg(F.sum("n").alias("n"))
    # At most MOST + 1 values in each of these windows.
    group = Window.partitionBy("lang", "size", "measure", "level")
    run = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.select("*", F.sum("n").over(run).alias("upto"), F.sum("n").over(group).alias("docs")).filter(F.col("docs") >= least_docs)
    quarter = [F.min(F.when(4 * F.col("upto") >= q * F.col("docs"), F.col("value"))).alias(f"q{q}") for q in (1, 2, 3)]
    quartiles = ranked.groupBy("lang", "size", "measure", "level").agg(*quarter)
    least = F.element_at(F.create_map(*[F.lit(x) for pair in FLOORS.items() for x in pair]), F.col("measure"))
    spread = lambda near: F.greatest(near / F.lit(0.6745), least.cast("double")) * F.lit(width)
    return quartiles.select(
        "lang", "size", "measure", "level", (F.col("q2") - spread(F.col("q2") - F.col("q1"))).alias("low"),
        (F.col("q2") + spread(F.col("q3") - F.col("q2"))).alias("high"))


def _band(rows, measure: str) -> Column:
    """The band of a measure for a length class, or over everything, as an expression over ``_size``."""
    pair = lambda r: F.struct(F.lit(r["low"]).alias("low"), F.lit(r["high"]).alias("high"))
    mine = [r for r in rows if r["measure"] == measure]
    found = [F.when(F.col("_size") == r["size"], pair(r)) for r in mine if r["level"] == 1] + [pair(r) for r in mine if r["level"] == 0]
    return F.coalesce(*found, F.lit(None).cast("struct<low: double, high: double>"))


def verdicts(rows: DataFrame, width: float = WIDTH, least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS,
             most_repeated: int = MOST_REPEATED_PERCENT) -> DataFrame:
    """Measured rows with ``base_failed`` and ``kept``."""
    judged = rows.select("*", fails_base(least_words, most_repeated).alias("base_failed"))
    table = stage(bands(judged.filter("NOT base_failed"), width, least_docs), "bands")
    # A row per measure and length class: at most 3 x 65.
    general = table.filter("level < 2").collect()
    own = table.filter("level = 2").select(F.col("lang").alias("_lang"), F.col("size").alias("_own"), "measure", F.struct("low", "high").alias("band"))
    own = own.groupBy("_lang", "_own").agg(F.map_from_entries(F.collect_list(F.struct("measure", "band"))).alias("_bands"))
    met = judged.select("*", length_class().alias("_size"))
    # A row per language and class; Spark broadcasts it only if its written size is small.
    met = met.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("_size") == F.col("_own")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        band = F.coalesce(F.col("_bands")[m], _band(general, m))
        inside = inside & F.coalesce(F.col(m).between(band["low"], band["high"]), F.lit(True))
    return met.select(*judged.columns, (~F.col("base_failed") & inside).alias("kept"))


def fertility_report(docs: DataFrame, byte_level: str, pattern: str, with_fallback: str, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", **rules) -> DataFrame:
    """``doc_id``, counts, measures, ``base_failed`` and ``kept`` of every document."""
    ready = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(f"`{text_col}`").alias("_text"))
    return verdicts(stage(measured(ready, byte_level, pattern, with_fallback), "fertility"), **rules)


def keep_fertile(docs: DataFrame, byte_level: str, pattern: str, with_fallback: str, text_col: str = "text", lang_col: str = "lang", **rules) -> DataFrame:
    """The documents that are kept, with all their columns."""
    ready = docs.select(as_rows(docs).alias("_row"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text_of(f"`{text_col}`").alias("_text"))
    judged = verdicts(stage(measured(ready, byte_level, pattern, with_fallback), "fertility"), **rules)
    return judged.filter("kept").select("_row.*")
