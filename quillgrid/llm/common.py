"""Helpers shared by the corpus operators: tables in the shared folder, text constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tables import checkpoint_dir, cut, drop  # noqa: F401

#: The white space of every contract: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does just that on pure ASCII and is far cheaper than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable is never inlined by the optimizer)."""
    return F.element_at(F.transform(F.array(value), body), 1)
