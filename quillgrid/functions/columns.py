"""Scalar functions on paths, texts and vectors, as Spark column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File types that are indexed.
MARKDOWN, PDF = (".md",), (".pdf",)
HTML, PLAIN = (".html", ".htm"), (".txt", ".rst", ".org", ".adoc")
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".webp")
PROSE = (*MARKDOWN, *PDF, *HTML, *PLAIN)
INDEXED = (*PROSE, *IMAGES, ".svg")
TYPES = {"md": MARKDOWN, "html": HTML, "pdf": PDF, "image": (*IMAGES, ".svg"), "text": PLAIN}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a lambda variable is never inlined by the optimizer)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix, lower-cased, with its dot; "" if there is none."""
    return F.lower(F.regexp_extract(base(path), r"(?s).(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """The name without its last suffix."""
    return F.regexp_replace(base(path), r"(?s)(?<=.)\.[^.]+$", "")


def folder(path: Column) -> Column:
    """The path of the containing folder; "." at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def stem_words(name: Column) -> Column:
    return F.array_join(F.filter(F.split(name, r"[-_.\s]+"), lambda x: x != ""), " ")


def name_tokens(path: Column) -> Column:
    """The distinct lower-cased parts of a file name, of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(stem(path)), "[-_ .]"), lambda x: F.char_length(x) >= 2))


def link_stem(target: Column) -> Column:
    """What a link names: the last part, lower-cased, without the suffix of an indexed type."""
    ends = "|".join(e[1:] for e in INDEXED)
    return F.regexp_replace(F.lower(base(target)), rf"\.({ends})$", "")


def proximity(a: Column, b: Column) -> Column:
    """same, sibling or far: whether two files share a folder or their folders share one."""
    fa, fb = folder(a), folder(b)
    return F.when(fa == fb, "same").when(folder(fa) == folder(fb), "sibling").otherwise("far")


def tokens(text: Column) -> Column:
    """Lower-cased words that begin with a letter and have two characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([^\W\d_]\w+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """Words between white space of any script."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def line_feeds(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def trim_spaces(text: Column) -> Column:
    """Without spaces of any script at both ends; tabs and line ends stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def first_line(text: Column, width: int) -> Column:
    return F.substr(F.substring_index(text, "\n", 1), F.lit(1), F.lit(width))


def holds_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts), F.lit(False))


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is zero, null if their lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    na, nb = norm(a), norm(b)
    return F.when(F.size(a) == F.size(b), F.when((na == 0) | (nb == 0), 0.0).otherwise(dot / (na * nb)))


def inverse_frequency(total: Column, df: Column) -> Column:
    return F.ln(F.greatest(total, F.lit(1)) / F.when(df > 0, df).otherwise(1))
