"""Quality classifier: a byte-level convolutional network in numpy.

The bytes of a text are read in overlapping windows that cover all of it. Narrow filters
see 8 bytes every 4 and know the place of each byte; wide filters see 64 bytes every 32
and know only which bytes are there, and the largest share of them that repeats the byte one period (2 to 32 bytes)
before. Filters are tables from byte to a number per filter, so a convolution is a sum of table rows. Each filter's largest value over the whole document is kept, passed through a
rectifier, and combined linearly into one probability.

Fitting is gradient descent in the driver on a bounded sample (``FIT_ROWS`` documents per label, none over
``FIT_BYTES``); only the windows that gave the maxima are changed. The sample is
balanced, so the odds are then shifted to those of all usable labels. Scoring runs in the tasks over whole
texts, a piece at a time with overlap, so memory does not depend on length.

Defined cases: a null text counts as empty; a text shorter than a window is padded with
spaces; labels that are null or neither 0 nor 1 are ignored; without two labels to learn from,
the score is the share of label 1 (0.5 without any label); repeated rows get
equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm import labelled
from tabloom.llm.common import per_text, text_of

FIT_ROWS = 1_500
FIT_BYTES = 32_768
NARROW, NARROW_STEP, NARROW_FILTERS = 8, 4, 16
WIDE, WIDE_STEP, WIDE_FILTERS = 64, 32, 8
PERIODS = range(2, WIDE_STEP + 1)
PIECE_BYTES = 1 << 18
THRESHOLD = 0.3


class Network:
    """Filters, combination and their gradients."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.params = {
            "narrow": rng.normal(0, 0.1, (NARROW, 256, NARROW_FILTERS)).astype(np.float32),
            "wide": rng.normal(0, 0.5, (256, WIDE_FILTERS)).astype(np.float32),
            "repeat": rng.normal(0, 0.5, WIDE_FILTERS).astype(np.float32),
            "lift": np.zeros(NARROW_FILTERS + WIDE_FILTERS, np.float32),
            "weight": rng.normal(0, 0.3, NARROW_FILTERS + WIDE_FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    @staticmethod
    def padded(data: bytes) -> np.ndarray:
        """The bytes, filled up with spaces to a whole number of steps and one window at least."""
        length = max(WIDE, -(-len(data) // WIDE_STEP) * WIDE_STEP)
        return np.frombuffer(data.ljust(length, b" "), np.uint8)

    @staticmethod
    def periodic(seen: np.ndarray, real: int) -> np.ndarray:
        """Per step, and per period, how many of the first ``real`` bytes repeat the byte one period before."""
        steps = len(seen) // WIDE_STEP
        found = np.empty((steps, len(PERIODS)), np.uint8)
        same = np.zeros(len(seen), bool)
        for k, period in enumerate(PERIODS):
            same[:period] = False
            np.equal(seen[period:], seen[:-period], out=same[period:])
            same[real:] = False
            found[:, k] = np.bitwise_count(np.packbits(same).view(np.uint32))
        return found

    def maxima(self, seen: np.ndarray, real: int, before: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest value of each filter over a piece, the byte at which its window starts, and the share of
        repeats in the wide ones. The first ``before`` bytes are only looked back at."""
        repeats = self.periodic(seen, real)[before // WIDE_STEP:].astype(np.float32)
        repeats = (repeats[:-1] + repeats[1:]).max(axis=1) / WIDE
        seen = seen[before:]
        places = (len(seen) - NARROW) // NARROW_STEP + 1
        narrow = self.params["narrow"][0][seen[: places * NARROW_STEP: NARROW_STEP]]
        for j in range(1, NARROW):
            narrow += self.params["narrow"][j][seen[j: j + places * NARROW_STEP: NARROW_STEP][:places]]
        halves = self.params["wide"][seen].reshape(-1, WIDE_STEP, WIDE_FILTERS).sum(axis=1)
        wide = (halves[:-1] + halves[1:]) / WIDE + repeats[:, None] * self.params["repeat"]
        top = wide.argmax(axis=0)
        at = np.concatenate((narrow.argmax(axis=0) * NARROW_STEP, top * WIDE_STEP))
        return np.concatenate((narrow.max(axis=0), wide.max(axis=0))), at, repeats[top]

    def pooled(self, data: bytes) -> np.ndarray:
        """Largest value of each filter over a whole text."""
        seen, best = self.padded(data), None
        # Pieces overlap by half a window; steps stay in phase with the start of the text.
        for at in range(0, max(1, len(seen) - WIDE + 1), PIECE_BYTES):
            first = max(0, at - WIDE_STEP)
            piece = seen[first: at + PIECE_BYTES + WIDE - WIDE_STEP]
            value = self.maxima(piece, max(0, len(data) - first), at - first)[0]
            best = value if best is None else np.maximum(best, value)
        return best

    def logit(self, data: bytes) -> float:
        active = np.maximum(self.pooled(data) + self.params["lift"], 0)
        return float(active @ self.params["weight"] + self.params["bias"][0])

    def gradients(self, data: bytes, label: int, into: dict[str, np.ndarray]) -> None:
        seen = self.padded(data)
        value, at, repeats = self.maxima(seen, len(data))
        active = np.maximum(value + self.params["lift"], 0)
        z = active @ self.params["weight"] + self.params["bias"][0]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        into["bias"] += error
        into["weight"] += error * active
        back = np.where(active > 0, error * self.params["weight"], 0)
        into["lift"] += back
        into["repeat"] += back[NARROW_FILTERS:] * repeats
        filters = np.arange(NARROW_FILTERS)
        for j in range(NARROW):
            np.add.at(into["narrow"][j], (seen[at[:NARROW_FILTERS] + j], filters), back[:NARROW_FILTERS])
        for f in np.flatnonzero(back[NARROW_FILTERS:]):
            start = at[NARROW_FILTERS + f]
            counts = np.bincount(seen[start: start + WIDE], minlength=256)
            into["wide"][:, f] += back[NARROW_FILTERS + f] * counts / WIDE


def fit(texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 32, rate: float = 0.02, seed: int = 0) -> Network:
    """Adam over shuffled batches."""
    net, rng = Network(seed), np.random.default_rng(seed)
    grads = {k: np.zeros(v.shape, np.float64) for k, v in net.params.items()}
    first = {k: np.zeros_like(v) for k, v in net.params.items()}
    second = {k: np.zeros_like(v) for k, v in net.params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), batch):
            rows = order[start: start + batch]
            for g in grads.values():
                g[:] = 0
            for i in rows:
                net.gradients(texts[i], labels[i], grads)
            step += 1
            for k, p in net.params.items():
                g = (grads[k] / len(rows) + 1e-5 * p).astype(np.float32)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def score_quality(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality (1: good)."""
    known = labelled.counts(labels, "quality")
    chosen = []
    if len(known) == 2:
        per_class = {0: fit_rows, 1: fit_rows}
        chosen = labelled.sample(docs, labels, "quality", per_class, fit_bytes).orderBy("doc_id").collect()
    held = [sum(r["label"] == c for r in chosen) for c in (0, 1)]
    if min(held):
        net = fit([r["_text"].encode() for r in chosen], [r["label"] for r in chosen])
        shift = float(np.log(known[1] / known[0]) - np.log(held[1] / held[0]))

        def logit(data: bytes) -> float:
            return net.logit(data) + shift
    else:
        total = sum(known.values())
        prior = float(np.clip(known.get(1, 0) / total if total else 0.5, 1e-6, 1 - 1e-6))

        def logit(data: bytes) -> float:
            return float(np.log(prior / (1 - prior)))

    def make():
        return lambda data: (float(1 / (1 + np.exp(-np.clip(logit(data), -500, 500)))),)

    rows = docs.select("doc_id", text_of("text").alias("_text"))
    scored = per_text(rows, make, "score double")
    return scored.select(
        "doc_id", labelled.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
