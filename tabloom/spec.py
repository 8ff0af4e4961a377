"""Driver-side configuration: what to build from a table, never the data itself."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from math import isfinite

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabloom.session import local_table

EXAMPLE_FIELDS = ("instruction", "input", "output")

EXAMPLE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in EXAMPLE_FIELDS])

# Up to this many entries a mapping is a literal inside the expression, which
# keeps the projection narrow; longer ones become a small joined table.
LITERAL_MAP_LIMIT = 256

# Numbers written with a point or an exponent, whole ones, and those beyond all.
_FRACTION = re.compile(r"[+-]?(\d+(\.\d*([eE][+-]?\d+)?|[eE][+-]?\d+)|\.\d+([eE][+-]?\d+)?)")
_WHOLE = re.compile(r"[+-]?\d+")
_INFINITE = re.compile(r"[+-]?inf(inity)?", re.IGNORECASE)


def _held(value: float, single: bool) -> float:
    """The number as a 32-bit or 64-bit fraction holds it; -0.0 is 0.0."""
    return (struct.unpack("f", struct.pack("f", value))[0] if single else value) + 0.0


class LabelMap:
    """Ordered raw value -> label mapping.

    Order matters: label extraction and the label universe follow it.
    Labels reached from several raw values keep their first position.
    """

    def __init__(self, pairs: Mapping[object, str] | Iterable[tuple[object, str]] = ()):
        items = pairs.items() if isinstance(pairs, Mapping) else pairs
        self._pairs = {str(raw): str(label) for raw, label in items}

    @classmethod
    def identity(cls, labels: Iterable[str]) -> "LabelMap":
        return cls((v, v) for v in labels)

    def __len__(self) -> int:
        return len(self._pairs)

    @property
    def pairs(self) -> list[tuple[str, str]]:
        return list(self._pairs.items())

    @property
    def labels(self) -> list[str]:
        return list(dict.fromkeys(self._pairs.values()))

    def by_number(self, single: bool = False) -> dict[float, str]:
        """The labels of keys that denote a number, by that number; for a target held as fraction (``single``: of 32 bits).

        ``1``, ``1.0`` and ``1e0`` are one number. If several are keyed, the first one spelled as a fraction wins, as the
        target itself is spelled that way. A whole key that no fraction can hold exactly matches nothing.
        """
        plain, spelled = {}, {}
        for raw, label in self._pairs.items():
            if _FRACTION.fullmatch(raw):
                spelled.setdefault(_held(float(raw), single), label)
            elif _WHOLE.fullmatch(raw):
                value = _held(float(raw), single)
                if isfinite(value) and int(value) == int(raw):
                    plain[value] = label
            elif _INFINITE.fullmatch(raw):
                plain[float(raw)] = label
        return {**plain, **spelled}

    def as_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, raw, label) for i, (raw, label) in enumerate(self.pairs)]
        return local_table(spark, rows, "pos int, raw string, label string")


@dataclass(frozen=True)
class PrepSpec:
    """How rows of one table become examples.

    missing         feature name -> "skip" (left out of the text), "literal"
                    (``missing_literal`` is written) or "median"; ``default_missing``
                    covers the rest.
    decimals        digits after the point for fractional features, None for
                    Spark's own rendering.
    medians         fitted medians of the "median" features (see ``fit_medians``).
    keep            key columns carried along with the examples.
    unmapped        what happens to target values outside ``mapping``:
                    "drop", "keep" (raw value becomes the label) or "fail".
    """

    target: str
    features: tuple[str, ...]
    instruction: str
    mapping: LabelMap = field(default_factory=LabelMap)
    missing: Mapping[str, str] = field(default_factory=dict)
    default_missing: str = "skip"
    missing_literal: str = "unknown"
    decimals: int | None = 2
    separator: str = ", "
    key_value: str = ": "
    unmapped: str = "drop"
    keep: tuple[str, ...] = ()
    medians: Mapping[str, float | None] = field(default_factory=dict)

    def __post_init__(self):
        if self.unmapped not in ("drop", "keep", "fail"):
            raise ValueError(f"unmapped must be drop, keep or fail, not {self.unmapped!r}")
        bad = set(self.missing.values()) | {self.default_missing}
        if bad - {"skip", "literal", "median"}:
            raise ValueError(f"unknown missing-value policy in {sorted(bad)}")

    def policy(self, feature: str) -> str:
        return self.missing.get(feature, self.default_missing)
