"""Label extraction from free text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.text import null_if_empty, strip

# Beyond this many labels one pass of an automaton replaces the chain of WHENs.
CHAIN_LIMIT = 32


class LabelFinder:
    """The first label that equals, else starts, else occurs in a lower-cased text, in one pass over the text."""

    def __init__(self, labels: Sequence[str]):
        self.first: dict[str, int] = {}
        for place, label in enumerate(labels):
            self.first.setdefault(label.lower(), place)
        self.labels = list(labels)
        self.empty = self.first.get("")
        self.automaton = ahocorasick.Automaton()
        for low, place in self.first.items():
            if low:
                self.automaton.add_word(low, (place, len(low)))
        self.automaton.make_automaton()

    def find(self, text: str) -> str | None:
        place = self.first.get(text)
        if place is None:
            start = inside = self.empty
            for end, (found, length) in self.automaton.iter(text) if len(self.automaton) else ():
                if end + 1 == length and (start is None or found < start):
                    start = found
                if inside is None or found < inside:
                    inside = found
            place = inside if start is None else start
        return None if place is None else self.labels[place]


@lru_cache(maxsize=4)
def _finder(labels: tuple[str, ...]) -> LabelFinder:
    """One automaton per worker and set of labels."""
    return LabelFinder(labels)


def extract_label(text: Column, labels: Sequence[str]) -> Column:
    """First label that equals, else starts, else occurs in the stripped text.

    Case is ignored and labels are tried in the given order inside each tier.
    Text without any label is returned stripped; blank text gives null. The time per row does not grow with the
    number of labels: many are searched for together.
    """
    clean = strip(F.coalesce(text, F.lit("")))
    low = F.lower(clean)
    raw = null_if_empty(clean)
    if not labels:
        return raw

    if len(labels) > CHAIN_LIMIT:
        return F.coalesce(_found(labels)(low), raw)
    tiers = (
        lambda t, l: t == l,
        lambda t, l: F.startswith(t, l),
        lambda t, l: F.contains(t, l),
    )
    found = [
        F.when(match(low, F.lit(label.lower())), F.lit(label))
        for match in tiers
        for label in labels
    ]
    return F.coalesce(*found, raw)


def _found(labels: Sequence[str]):
    known = tuple(labels)

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_finder(known).find)

    return found
