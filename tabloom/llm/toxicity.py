"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

Lexicon. Words that occur far oftener in toxic than in clean documents of the labelled
sample, weighed by their log-odds.

Matching. The Levenshtein automata of all words are intersected with the trie of the lexicon
at once: a state is a set of trie nodes with the edits spent to reach them, and is
determinised when first met, so a word costs one step per letter. Terms allow no edit up to 4 letters, one up to 8
and two above; a number of edits at which a term is met more in clean than in toxic documents of the
sample is withdrawn.

Context. Each hit is judged in a window of words around it: inside quotation marks or next to
a verb of reporting it counts as quotation, otherwise as abuse, a little more when the
reader is addressed. The sums of both kinds, exact and misspelled apart, enter
a logistic regression fitted on the sample; quotations without abuse weigh what the labels say, nothing by default.

The sample is bounded by ``FIT_TOXIC`` and ``FIT_CLEAN`` documents of at most ``FIT_BYTES``; every
document is scored over its whole text.

Defined cases: a null text counts as empty and, like any text without hits, gets the score of
no evidence; labels that are null or neither 0 nor 1 are ignored; without toxic labels the lexicon is
empty and all scores are equal; repeated rows get equal scores; an empty table gives
an empty result; other columns are ignored (``score_toxicity``) or carried along (``drop_toxic``).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import labelled
from tabloom.llm.common import as_rows, held, per_text, text_of

FIT_TOXIC, FIT_CLEAN = 3_000, 6_000
FIT_BYTES = 32_768
MAX_TERMS = 1_000
MIN_LOG_ODDS = 2.5
MIN_SHARE = 0.01
MAX_STATES = 50_000
MAX_WORDS = 100_000
WINDOW = 8
PIECE_CHARS = 1 << 20
THRESHOLD = 0.5

WORD = re.compile(r"[^\W_]+")
# Quotation marks, verbs of reporting, and words that address the reader.
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
REPORTING = frozenset(
    "said says called calls quoted quote wrote writes claimed reported sagte sagt nannte schrieb zitierte dit disait "
    "écrit appelait cité dijo dice escribió llamó citó".split()
)
ADDRESSING = frozenset("you your youre du dich dein ihr euch tu toi vous votre tú usted ustedes vosotros".split())


def allowed_edits(term: str) -> int:
    return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2


class Matcher:
    """Words to the lexicon terms they may be meant as: ``[(term, edits), ...]``."""

    def __init__(self, terms: list[str], edits: list[int]):
        self.edits = edits
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.reach = [0]
        for number, term in enumerate(terms):
            node, path = 0, [0]
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.reach.append(0)
                node = self.children[node][letter]
                path.append(node)
            self.term_at[node] = number
            for step in path:
                self.reach[step] = max(self.reach[step], edits[number])
        self._start_anew()
        self._words: dict[str, tuple] = {}

    def _closed(self, spent: dict[int, int]) -> tuple:
        """Add the nodes reached by leaving out letters; a state in canonical form."""
        queue = list(spent)
        for node in queue:
            used = spent[node] + 1
            for below in self.children[node].values():
                if used <= self.reach[below] and used < spent.get(below, 99):
                    spent[below] = used
                    queue.append(below)
        return tuple(sorted(spent.items()))

    def _start_anew(self) -> None:
        self.states = [self._closed({0: 0})]
        self.number = {self.states[0]: 0}
        self.moves: dict[tuple[int, str], int] = {}

    def _move(self, state: int, letter: str) -> int:
        spent: dict[int, int] = {}

        def reach(node: int, used: int) -> None:
            if used <= self.reach[node] and used < spent.get(node, 99):
                spent[node] = used

        for node, used in self.states[state]:
            reach(node, used + 1)
            for other, below in self.children[node].items():
                reach(below, used + (other != letter))
        target = self._closed(spent)
        found = self.number.get(target)
        if found is None:
            found = self.number[target] = len(self.states)
            self.states.append(target)
        self.moves[state, letter] = found
        return found

    def match(self, word: str) -> tuple:
        found = self._words.get(word)
        if found is None:
            if len(self.states) > MAX_STATES:
                self._start_anew()
            if len(self._words) >= MAX_WORDS:
                self._words.clear()
            found = self._words[word] = self._run(word)
        return found

    def _run(self, word: str) -> tuple:
        state = 0
        for letter in word:
            move = self.moves.get((state, letter))
            state = self._move(state, letter) if move is None else move
            if not self.states[state]:
                return ()
        hits = [(self.term_at[n], used) for n, used in self.states[state] if n in self.term_at]
        return tuple((term, used) for term, used in hits if used <= self.edits[term])


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    edits: list[int] = field(default_factory=list)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    intercept: float = 0.0


FEATURES = 6


def pieces(text: str):
    """The text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = min(at + PIECE_CHARS, len(text))
        while end < len(text) and (text[end].isalnum() or text[end - 1].isalnum()):
            end += 1
        yield text[at:end]
        at = end


def _quoted(before: str, after: str) -> bool:
    """Whether a place lies between quotation marks, given the text around it."""
    if before.count('"') % 2 and '"' in after:
        return True
    opened = max(before.rfind(c) for c in OPENING if c != '"')
    closed = max(before.rfind(c) for c in CLOSING if c != '"' and c not in OPENING)
    return opened > closed and any(c in after for c in CLOSING if c != '"')


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.matcher = Matcher(model.terms, model.edits)

    def evidence(self, data: bytes):
        """Hits ``(term, edits, force, quoted)`` of a text, and its number of words."""
        hits, total, match = [], 0, self.matcher.match
        for piece in pieces(data.decode("utf-8", "replace")):
            low = piece.lower()
            words = WORD.findall(low)
            total += len(words)
            wanted = {w for w in set(words) if match(w)}
            if wanted:
                hits += self._hits(low, wanted)
        return hits, total

    def _hits(self, low: str, wanted: set[str]) -> list[tuple[int, int, float, bool]]:
        spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
        found = []
        for i, (start, end) in enumerate(spans):
            word = low[start:end]
            if word not in wanted:
                continue
            first, last = max(0, i - WINDOW), min(len(spans), i + WINDOW + 1)
            near = {low[a:b] for a, b in spans[first:last]}
            quoted = bool(near & REPORTING) or _quoted(low[spans[first][0]:start], low[end:spans[last - 1][1] + 1])
            term, used = min(self.matcher.match(word), key=lambda h: (h[1], -self.model.weights[h[0]]))
            force = self.model.weights[term] * (1.25 if near & ADDRESSING else 1.0) / (1 + used)
            found.append((term, used, force, quoted))
        return found

    def features(self, data: bytes) -> np.ndarray:
        hits, total = self.evidence(data)
        abuse = [h for h in hits if not h[3]]
        exact = [h[2] for h in abuse if h[1] == 0]
        near = [h[2] for h in abuse if h[1]]
        quoted = [h[2] for h in hits if h[3]]
        return np.array([
            math.log1p(sum(exact)), len({h[0] for h in abuse if h[1] == 0}), math.log1p(sum(near)),
            math.log1p(1000 * sum(near) / max(total, 50)), math.log1p(sum(quoted)), math.log1p(1000 * sum(exact) / max(total, 50)),
        ])

    def score(self, data: bytes) -> float:
        m = self.model
        z = (self.features(data) - m.mean) / m.scale @ m.coefficients + m.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def learn_lexicon(sample: DataFrame, most: int = MAX_TERMS) -> list[tuple[str, float]]:
    """Terms and log-odds from ``(_text, label)``. At most ``most`` rows reach the driver."""
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return []
    words = F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}\p{N}]+"))).alias("word")
    counts = sample.select(words, "label").filter("length(word) >= 3").groupBy("word").agg(
        F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
    least = max(3, math.ceil(MIN_SHARE * toxic))
    best = counts.filter(F.col("bad") >= least).select("word", odds.alias("w")).filter(F.col("w") >= MIN_LOG_ODDS)
    return [(r["word"], r["w"]) for r in best.orderBy(F.desc("w"), "word").limit(most).collect()]


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Newton steps."""
    full = np.column_stack((x, np.ones(len(x))))
    beta, weight = np.zeros(full.shape[1]), weight / weight.sum()
    keep = np.full(full.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        gradient = full.T @ (weight * (p - y)) + keep * beta
        curve = (full * (weight * p * (1 - p))[:, None]).T @ full + np.diag(keep)
        step = np.linalg.solve(curve, gradient)
        beta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN, fit_bytes: int = FIT_BYTES) -> Model:
    known = labelled.counts(labels, "toxic")
    total = sum(known.values())
    prior = float(np.clip(known.get(1, 0) / total if total else 0.0, 1e-4, 1 - 1e-4))
    model = Model(intercept=math.log(prior / (1 - prior)))
    if not known.get(1):
        return model
    sample = labelled.sample(docs, labels, "toxic", {0: fit_clean, 1: fit_toxic}, fit_bytes)
    lexicon = learn_lexicon(sample)
    model.terms, model.weights = [t for t, _ in lexicon], [float(w) for _, w in lexicon]
    model.edits = [allowed_edits(t) for t in model.terms]
    if not lexicon:
        return model
    model.edits = _proven_edits(sample, model)

    def make():
        scorer = Scorer(model)
        return lambda data: (scorer.features(data).tolist(),)

    rows = per_text(sample, make, "features array<double>").orderBy("doc_id").collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows], float)
    if y.min() == y.max():
        return model
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    share = {1: prior / y.mean(), 0: (1 - prior) / (1 - y.mean())}
    weight = np.array([share[int(v)] for v in y])
    model.coefficients, model.intercept = _regression((x - model.mean) / model.scale, y, weight)
    return model


def _proven_edits(sample: DataFrame, model: Model) -> list[int]:
    """Edits per term, without those that hit the clean documents of the sample more
    often than the toxic ones (as shares of each)."""

    def make():
        scorer = Scorer(model)
        return lambda data: (sorted({h[0] * 4 + h[1] for h in scorer.evidence(data)[0] if h[1]}),)

    hits = per_text(sample, make, "hits array<int>").select("label", F.explode("hits").alias("hit"))
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    met: dict[int, dict[int, float]] = defaultdict(dict)
    for r in hits.groupBy("hit", "label").agg(F.count("*").alias("n")).collect():
        met[r["hit"]][r["label"]] = r["n"] / size[r["label"]]
    edits = list(model.edits)
    for term in range(len(edits)):
        for used in range(1, edits[term] + 1):
            share = met.get(term * 4 + used, {})
            if share.get(0, 0.0) > share.get(1, 0.0) / 3:
                edits[term] = used - 1
                break
    return edits


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic (1: toxic)."""
    return _scored(docs.select("doc_id", text_of("text").alias("_text")), model or fit(docs, labels)).select(
        "doc_id", labelled.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    key = "toxicity", uuid.uuid4().hex

    def make():
        scorer = held(key, lambda: Scorer(model))
        return lambda data: (scorer.score(data),)

    return per_text(rows, make, "score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns."""
    rows = docs.select(as_rows(docs).alias("_row"), text_of("`text`").alias("_text"))
    return _scored(rows, model or fit(docs, labels)).filter(F.col("score") < threshold).select("_row.*")
