"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

Encoding. Each match of the pre-token pattern is read byte by byte. The machine that
guesses where tokens end is nondeterministic: a configuration is the chain of tokens
guessed so far and a node of the trie of token bytes for the token being read. A chain
is a BPE encoding exactly if each two neighbours are (two tokens are neighbours if
merging their joined bytes by rank gives these two back), so configurations with a wrong
neighbour are dropped at once, and one chain ends at each position. The set of live
configurations is a state of the deterministic machine; tokens on which all of
them agree are emitted, which bounds the lookahead by the longest token. States and
transitions are made when first met and kept in tables of bounded size; when they are full, those that were not met again since the
last time go. What a piece of text encodes to does not depend on these tables.

Two details follow the ranks: a piece that is a token itself is that token, and tokens
that merging by rank cannot reach are used for nothing else.

Decoding. Token bytes are joined and cut at character borders by a UTF-8 state machine
(``Utf8Stream``) that holds back at most three bytes of an unfinished character.

Defined cases: a null or empty text has no tokens; bytes that are not UTF-8 become U+FFFD, which is what decoding then gives; texts of any
length are read in pieces; repeated rows give equal rows; an empty table gives an empty result; other
columns are ignored or, in ``encode_documents``, carried along whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import marshal
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_rows, held, per_text, text_of, whole_utf8

# What a worker remembers: states of a generation, pieces of both generations (about 300 bytes each), and the longest of these.
MAX_STATES = 240_000
MAX_PIECES = 700_000
MAX_CACHED_CHARS = 64
PIECES_AT_ONCE = 8_192
# Beginnings of pieces whose state is remembered: so many bytes, so many of them.
HEAD_BYTES = 6
MAX_HEADS = 50_000
NO_TOKEN, ANY = -1, -2
# Bytes of the class "continues a character".
CONTINUES = range(0x80, 0xC0)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and number on each line."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            parts = line.split()
            if len(parts) == 2:
                ranks[base64.b64decode(parts[0])] = int(parts[1])
    return ranks


class Transducer:
    """The machine for one vocabulary. Its tables grow as texts are read."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The trie: node and byte to the next node, and for each node its token and whether it goes on.
        self.below: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.goes_on = bytearray(1)
        # The two tokens whose merge makes a token: its left part, its right part.
        self.inner_left: dict[int, int] = {}
        self.inner_right: dict[int, int] = {}
        for token, rank in ranks.items():
            parts = self.merge(token, 2)
            if len(parts) <= 2:
                self._add(token, rank)
                if len(parts) == 2:
                    self.inner_left[rank], self.inner_right[rank] = parts
        self._neighbours: dict[int, bool] = {}
        self._start_anew()

    def _add(self, token: bytes, rank: int) -> None:
        node = 0
        for byte in token:
            self.goes_on[node] = 1
            node = self.below.setdefault(node << 8 | byte, len(self.token_at))
            if node == len(self.token_at):
                self.token_at.append(-1)
                self.goes_on.append(0)
        self.token_at[node] = rank

    def merge(self, data: bytes, stop: int = 1) -> list[int]:
        """Merging by rank, lowest and leftmost first, down to ``stop`` parts. Used on the
        bytes of single tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            joined = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in joined if r is not None), default=None)
            if best is None:
                break
            i = joined.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two.

        Undoes the merges on both sides of the border, latest first (the left token's
        right part, the right token's left part). The two stay apart unless somewhere
        the parts at the border form a token that merges before the part last undone.
        """
        pair = a << 32 | b
        known = self._neighbours.get(pair)
        if known is None:
            if len(self._neighbours) >= self.max_states:
                self._neighbours.clear()
            known = self._neighbours[pair] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        earlier_than = len(self.ranks) + 1
        inner_right, inner_left = self.inner_right, self.inner_left
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < earlier_than:
                return False
            left, right = inner_right.get(a), inner_left.get(b)
            if left is None and right is None:
                return True
            # Of merges of equal rank the left one comes first, so the right one is undone first.
            if right is None or (left is not None and a > b):
                earlier_than, a = a, left
            else:
                earlier_than, b = b + 1, right

    def _start_anew(self) -> None:
        # A state: chains with trie nodes, the newest border first. A chain begins with the
        # token before it: NO_TOKEN at the start, ANY where nothing depends on it any more.
        # States are kept packed; a move is the next state, times two, plus one if it emits.
        first = marshal.dumps((((NO_TOKEN,), 0),), 2)
        self.states: dict[int, bytes] = {0: first}
        self.number: dict[bytes, int] = {first: 0}
        self.moves: dict[int, int] = {}
        self.emits: dict[int, tuple[int, ...]] = {}
        # State and tokens after the first bytes of a piece: many pieces begin alike.
        self.begun: dict[bytes, tuple[int, list[int]]] = {}
        self.made = 1
        self._older: tuple[dict, dict, dict, dict] = ({}, {}, {}, {})

    def _next_generation(self, state: int = 0) -> None:
        """What was not met again since the last time is forgotten. Numbers of states stay what they are."""
        kept = {n: self._packed(n) for n in (0, state)}
        self._older = self.states, self.number, self.moves, self.emits
        self.states, self.number = kept, {packed: n for n, packed in kept.items()}
        self.moves, self.emits, self.begun = {}, {}, {}

    def _packed(self, state: int) -> bytes:
        """The configurations of a state, which from now on belongs to this generation."""
        packed = self.states.get(state)
        if packed is None:
            packed = self.states[state] = self._older[0][state]
            self.number[packed] = state
        return packed

    def _move(self, state: int, byte: int) -> int:
        """The next state and whether tokens become certain, from the generation before or determinised now."""
        key = state << 8 | byte
        known = self._older[2].get(key)
        if known is not None:
            self._packed(known >> 1)
            if known & 1:
                self.emits[key] = self._older[3][key]
            self.moves[key] = known
            return known
        live, border = [], None
        for tokens, node in marshal.loads(self._packed(state)):
            below = self.below.get(node << 8 | byte)
            if below is None:
                continue
            if self.goes_on[below]:
                live.append((tokens, below))
            if border is None:
                token = self.token_at[below]
                if token >= 0 and (tokens[-1] < 0 or self.neighbours(tokens[-1], token)):
                    border = tokens + (token,)
        live.insert(0, (border, 0))
        sure, shortest = 1, min([len(tokens) for tokens, _ in live])
        while sure < shortest and all([tokens[sure] == border[sure] for tokens, _ in live]):
            sure += 1
        out = border[1:sure]
        if out:
            live = [(tokens[sure - 1:], node) for tokens, node in live]
        if shortest > sure:
            live = [((ANY,) + tokens[1:], node) for tokens, node in live]
        # Without references between equal parts, so that equal states have equal bytes.
        target = marshal.dumps(tuple(live), 2)
        found = self.number.get(target)
        if found is None:
            found = self._older[1].get(target)
            if found is None:
                found = self.made
                self.made += 1
            self.number[target] = found
            self.states[found] = target
        if out:
            self.emits[key] = out
        move = self.moves[key] = found << 1 | bool(out)
        return move

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) > self.max_states:
            self._next_generation()
        start = data[:HEAD_BYTES]
        begun = self.begun.get(start)
        if begun is None:
            begun = self._steps(0, start)
            if len(start) == HEAD_BYTES and len(self.begun) < MAX_HEADS:
                self.begun[start] = begun
        state, out = begun
        if len(data) > HEAD_BYTES:
            state, rest = self._steps(state, data[HEAD_BYTES:])
            out = out + rest
        for tokens, node in marshal.loads(self._packed(state)):
            if node == 0:
                return [*out, *tokens[1:]]
        return out

    def _steps(self, state: int, data: bytes) -> tuple[int, list[int]]:
        """The state after some bytes, and the tokens emitted on the way."""
        out: list[int] = []
        moves = self.moves
        for byte in data:
            key = state << 8 | byte
            move = moves.get(key)
            if move is None:
                move = self._move(state, byte)
                if len(self.states) > 2 * self.max_states:
                    # Inside a very long piece.
                    emitted = self.emits.get(key, ())
                    self._next_generation(move >> 1)
                    moves, state = self.moves, move >> 1
                    out += emitted
                    continue
            if move & 1:
                out += self.emits[key]
            state = move >> 1
        return state, out


class Codec:
    """Encoder and decoder for a vocabulary file and a pre-token pattern."""

    def __init__(self, path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES):
        self.machine = Transducer(read_ranks(path), max_states)
        self.max_pieces = max_pieces
        self.find = regex.compile(pattern)
        self.bytes_of = self.machine.bytes_of
        most = max(self.bytes_of, default=0)
        self.kind = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.digits = [str(i) for i in range(most + 1)]
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece, packed."""
        made = self._pieces.get(piece) or self._older.get(piece)
        if made is None:
            made = np.array(self.machine.piece(piece.encode()), self.kind).tobytes()
        if len(piece) <= MAX_CACHED_CHARS:
            # Two generations: what was not met again while one filled up is forgotten.
            if len(self._pieces) >= self.max_pieces // 2:
                self._pieces, self._older = {}, self._pieces
            self._pieces[piece] = made
        return made

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a text, in blocks."""
        pieces = (m.group() for m in self.find.finditer(text)) if len(text) > 1 << 20 else iter(self.find.findall(text))
        while block := list(islice(pieces, PIECES_AT_ONCE)):
            known = self._pieces
            yield np.frombuffer(b"".join([known.get(p) or self._piece(p) for p in block]), self.kind)

    def ids(self, text: str) -> list[int]:
        return [i for block in self.encode(text) for i in block.tolist()]

    def decode(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of a stream of blocks of ids, in whole characters."""
        stream, table = Utf8Stream(), self.bytes_of
        for block in blocks:
            yield stream.feed(b"".join([table[i] for i in block]))
        yield stream.end()


class Utf8Stream:
    """Incremental UTF-8: bytes in, whole characters out.

    The state is the beginning of a character whose rest has not come yet. Bytes that
    cannot be UTF-8 raise ``UnicodeDecodeError`` (or become U+FFFD with ``"replace"``).
    """

    def __init__(self, errors: str = "strict"):
        self.errors, self.open = errors, b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that needs more."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte in CONTINUES:
                continue
            needs = 1 if byte < 0xC2 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF5 else 1
            return back if needs > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.open + data
        held = self.unfinished(data)
        self.open = data[len(data) - held:]
        return data[:len(data) - held].decode("utf-8", self.errors)

    def end(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", self.errors)


def codec(path: str, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> Codec:
    """One codec per worker; its tables serve all tasks that the worker runs."""
    return held(("bpe", path, pattern, max_states, max_pieces), lambda: Codec(path, pattern, max_states, max_pieces))


def _digests(data: bytes, coder: Codec) -> tuple[int, str, str]:
    ids_hash, text_hash, count = hashlib.sha256(), hashlib.sha256(), 0
    stream, token, digits = Utf8Stream(), coder.bytes_of.__getitem__, coder.digits.__getitem__
    for block in coder.encode(whole_utf8(data).decode()):
        ids = block.tolist()
        ids_hash.update((("," if count else "") + ",".join(map(digits, ids))).encode())
        count += len(ids)
        text_hash.update(stream.feed(b"".join(map(token, ids))).encode())
    text_hash.update(stream.end().encode())
    return count, ids_hash.hexdigest(), text_hash.hexdigest()


def roundtrip(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", max_states: int = MAX_STATES,
    max_pieces: int = MAX_PIECES,
) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Smaller tables (``max_states``, ``max_pieces``) take less memory of each worker and more time; the result is the same.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("_text"))

    def make():
        coder = codec(path, pattern, max_states, max_pieces)
        return lambda data: _digests(data, coder)

    return per_text(rows, make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "token_ids") -> DataFrame:
    """The documents with one more column, the token ids (replacing a column of that name)."""
    rows = docs.select(as_rows(docs).alias("_row"), text_of(f"`{text_col}`").alias("_text"))

    def make():
        coder = codec(path, pattern)
        return lambda data: (coder.ids(whole_utf8(data).decode()),)

    kept = [f"_row.`{c}`" for c in docs.columns if c.lower() != ids.lower()]
    return per_text(rows, make, "_ids array<int>").select(*kept, F.col("_ids").alias(ids))


def decode_documents(docs: DataFrame, path: str, pattern: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """The text of each list of ids in column ``ids`` (null: empty), as column ``text``."""

    @F.pandas_udf("string")
    def decoded(column):
        coder = codec(path, pattern)

        def one(row):
            row = [] if row is None else row
            return "".join(coder.decode(row[i:i + PIECES_AT_ONCE] for i in range(0, len(row), PIECES_AT_ONCE)))

        return column.map(one)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != text.lower()]
    return docs.select(*kept, decoded(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))).alias(text))
