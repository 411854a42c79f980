"""Query text -> terms. This runs on the driver, once per query, never per row."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .columns import TYPES

#: Fixed values of the ranking.
FIELDS = {"title": 8, "path": 6, "heading": 5, "tag": 7, "type": 3}
LONG_QUERY, COVER, RARE, WEAK_SCORE, RRF_K = 6, 0.3, 0.999, 10, 60
_TERM = re.compile(r'(?:(%s):)?(?:"([^"]+)"|([^\s"]+))' % "|".join(FIELDS))


@dataclass(frozen=True)
class Query:
    """Field constraints and plain terms, in order and without repeats."""

    text: str
    fields: tuple[tuple[str, str], ...]
    plain: tuple[str, ...]

    @property
    def long(self) -> bool:
        return len(self.plain) >= LONG_QUERY


def parse(text: str) -> Query:
    """``field:word``, ``"a phrase"`` or words. Plain terms of one character are dropped; unknown types and empty queries are errors."""
    found = [(m[1], (m[2] or m[3]).lower().strip()) for m in _TERM.finditer(text)]
    found = [x for x in dict.fromkeys(found) if x[1]]
    if not found:
        raise ValueError("empty query")
    for field, term in found:
        if field == "type" and term not in TYPES:
            raise ValueError(f"unknown type: {term} (known: {', '.join(sorted(TYPES))})")
    return Query(text, tuple(x for x in found if x[0]), tuple(t for f, t in found if not f and len(t) > 1))


def variants(term: str) -> list[str]:
    """What counts as the term in a text: itself, its runs of a-z and 0-9, and (unless it is one such run) itself less up to three last characters. Phrases have no variants."""
    if " " in term:
        return [term]
    runs = re.findall("[a-z0-9]{2,}", term)
    shorter = [] if runs == [term] else [term[:-k] for k in (1, 2, 3)]
    return sorted({v for v in (term, *runs, *shorter) if len(v) >= 2})


def least_variants(term: str) -> list[str]:
    """Variants that decide whether the term occurs: those that hold no other variant."""
    every = variants(term)
    return [v for v in every if not any(o != v and o in v for o in every)]
