"""Fill-in-the-middle transformation over content-defined chunks with remembered summaries.

A text is cut into prefix, middle and suffix at two code points drawn from the SHA-256 of seed and id. To find the bytes of
a code point, the text is divided into chunks whose borders follow from its content: a Gear hash of the last 32
bytes is rolled over it, and a chunk ends where the hash has its top bits clear. A passage that occurs in many texts
thus falls into the same chunks everywhere. Each worker remembers a summary of each chunk, the number of characters that begin in it;
the memory is looked up by the whole content, so equal hashes of different chunks cannot mix them up. Running sums
of the summaries tell the length of the text and the chunk of each cut; only that chunk is read character by character.
A chunk may begin inside a character, which then counts where it began.

Forms: ``psm`` is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, ``spm`` is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, ``plain`` leaves the text
as it is. A text that is empty or contains one of the marks is always plain, so the text can be rebuilt from output and form.

Defined cases: a null text counts as empty; a null id draws as the empty string; bytes that are not UTF-8 become U+FFFD; rows equal
in id and text give equal rows; a text of one character repeated has chunks of ``MAX_CHUNK`` bytes; a long text is hashed in
blocks; an empty table gives an empty result; other columns are ignored (``fim_report``) or carried along whatever
their names (``fill_in_middle``, which replaces columns of its own two names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabloom.llm.common import as_rows, held, in_slices, text_of, whole_utf8

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
# Of 100 texts, so many keep their form; of 100 others, so many put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
WINDOW = 32
MIN_CHUNK, MAX_CHUNK = 256, 16_384
# Ten clear bits: a border every 1,024 bytes past the least length, on average.
BORDER_BITS = np.uint32(0xFFC00000)
HASH_BLOCK = 1 << 20
CACHE_BYTES = 32 << 20


def _gear() -> np.ndarray:
    """A random-looking number for each byte value."""
    digests = [hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)]
    return np.frombuffer(b"".join(digests), "<u4").astype(np.uint32)


GEAR = _gear()


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """The Gear hash of the ``WINDOW`` bytes that end at each place: sum of GEAR[byte] << age, by doubling the width."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def _candidates(data: np.ndarray) -> np.ndarray:
    found = []
    for start in range(0, len(data), HASH_BLOCK):
        first = max(0, start - WINDOW + 1)
        h = rolling_hash(data[first:start + HASH_BLOCK])[start - first:]
        found.append(np.flatnonzero((h & BORDER_BITS) == 0) + (start + 1))
    return np.concatenate(found)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one its length."""
    if len(data) <= MIN_CHUNK:
        return [len(data)]
    candidates = _candidates(np.frombuffer(data, np.uint8))
    ends, last = [], 0
    while last < len(data):
        i = np.searchsorted(candidates, last + MIN_CHUNK)
        at = int(candidates[i]) if i < len(candidates) else len(data)
        last = min(at, last + MAX_CHUNK, len(data))
        ends.append(last)
    return ends


def _begins(chunk: bytes) -> np.ndarray:
    return (np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80


class Summaries:
    """Characters that begin in a chunk, remembered by content. Two generations of at most half of ``CACHE_BYTES`` each."""

    def __init__(self, most_bytes: int = CACHE_BYTES):
        self.most, self.size, self.met = most_bytes // 2, 0, 0
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def count(self, chunk: bytes) -> int:
        n = self.known.get(chunk)
        if n is not None:
            self.met += 1
            return n
        n = self.older.get(chunk)
        if n is None:
            n = int(np.count_nonzero(_begins(chunk)))
        else:
            self.met += 1
        if self.size + len(chunk) > self.most:
            self.known, self.older, self.size = {}, self.known, 0
        self.known[chunk] = n
        self.size += len(chunk)
        return n


class Chunked:
    """A text as chunks: its number of characters, and the byte at which a character begins."""

    def __init__(self, data: bytes, summaries: Summaries):
        self.data = data
        self.ends = chunk_ends(data)
        starts = [0] + self.ends[:-1]
        self.past = list(accumulate(summaries.count(data[a:b]) for a, b in zip(starts, self.ends)))
        self.n = self.past[-1]

    def byte_of(self, character: int) -> int:
        if character >= self.n:
            return len(self.data)
        i = int(np.searchsorted(self.past, character, side="right"))
        start, before = (self.ends[i - 1], self.past[i - 1]) if i else (0, 0)
        return start + int(np.flatnonzero(_begins(self.data[start:self.ends[i]]))[character - before])


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers for an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transform(
    key: str, data: bytes, summaries: Summaries, seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> tuple[int, str, int | None, int | None, bytes]:
    """``(characters, form, prefix characters, middle characters, output)`` of a valid UTF-8 text."""
    text = Chunked(data, summaries)
    h1, h2, h3, h4 = draws(key, seed)
    if not data or h3 % 100 >= 100 - plain_percent or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return text.n, "plain", None, None, data
    first, second = sorted((h1 % (text.n + 1), h2 % (text.n + 1)))
    a, b = text.byte_of(first), text.byte_of(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm_percent:
        form, output = "spm", b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])
    else:
        form, output = "psm", b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return text.n, form, first, second - first, output


def restore(output: bytes, form: str) -> bytes:
    """The text from output and form. No piece of a text holds a mark, so the first one found is the right one."""
    if form == "plain":
        return output
    lead, inner = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    second = output.index(inner, len(lead))
    third = output.index(MIDDLE, second + len(inner))
    one, two, middle = output[len(lead):second], output[second + len(inner):third], output[third + len(MIDDLE):]
    return two + middle + one if form == "spm" else one + middle + two


def _summaries() -> Summaries:
    return held(("fim",), Summaries)


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim_text", form: str = "fim_form", seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """The documents with two more columns, transformed text and form (replacing columns of those names)."""
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in (out.lower(), form.lower())]

    def outcome(n, form, prefix, middle, output):
        return form, output

    made = _mapped(docs, id_col, text_col, outcome, "_form string, _out binary", (seed, plain_percent, spm_percent), True)
    return made.select(*kept, F.decode("_out", "UTF-8").alias(out), F.col("_form").alias(form))


def restore_texts(docs: DataFrame, out: str = "fim_text", form: str = "fim_form", text: str = "text") -> DataFrame:
    """The text of each row of ``fill_in_middle`` from its output and form alone, as column ``text``."""

    @F.pandas_udf("binary")
    def rebuilt(outputs, forms):
        return outputs.combine(forms, lambda o, f: restore(bytes(o), f))

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != text.lower()]
    return docs.select(*kept, F.decode(rebuilt(F.col(f"`{out}`").cast("binary"), F.col(f"`{form}`")), "UTF-8").alias(text))


REPORT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"


def fim_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the digests of the output and of the text rebuilt from it."""

    def digests(n, form, prefix, middle, output):
        back = restore(output, form)
        return n, form, prefix, middle, hashlib.sha256(output).hexdigest(), hashlib.sha256(back).hexdigest()

    return _mapped(docs, id_col, text_col, digests, REPORT, (seed, PLAIN_PERCENT, SPM_PERCENT), False)


def _mapped(docs, id_col, text_col, result, schema, settings, whole) -> DataFrame:
    """Run ``transform`` over every text: one packed row (``whole``) or the id, and the columns ``schema``."""
    key = F.col(f"`{id_col}`")
    first = as_rows(docs).alias("_row") if whole else key.alias("doc_id")
    ready = docs.select(first, F.coalesce(key.cast("string"), F.lit("")).alias("_key"), text_of(f"`{text_col}`").cast("binary").alias("_text"))
    target = T.StructType([ready.schema[0], *T.StructType.fromDDL(schema)])
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = _summaries()
        for batch in in_slices(batches, "_text"):
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            made = [result(*transform(key, whole_utf8(data), summaries, *settings)) for key, data in rows]
            columns = [batch.column(0)]
            columns += [pa.array(list(values), field.type) for values, field in zip(zip(*made), list(arrow)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return ready.mapInArrow(run, target)
