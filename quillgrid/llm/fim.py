"""Fill in the middle: documents are cut at unit bounds and their parts put in another order around sentinels.

A text travels as short pieces keyed by document and place in the output. ``repartitionAndSortWithinPartitions`` brings a document's
pieces together in order, so that a task digests or joins them one at a time; sorted anew by their place in the original, they
restore the text. Documents that stay as they are take no part in that shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The parts by their place in the original.
PARTS = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Places of a document's first and last record; pieces stand in between.
HEAD, END = -1, 1 << 62
#: Text of a partition of the sorts, before plain documents are left out.
PARTITION_BYTES = 32 << 20


@dataclass(frozen=True)
class Rules:
    """How documents are cut: the seed of the hashes, percent of documents that are cut at all and, of these, percent that begin with the suffix; the most units and characters of a piece."""

    seed: int = 42
    percent: int = 50
    suffix_first: int = 80
    chunk_units: int = 2048
    chunk_chars: int = 1 << 16

    def plan(self, name: str, text: str) -> tuple[int, str, int, int, list[int]]:
        """(units, form, end of the prefix, end of the middle, ends of all units) of a text; ends are in code points."""
        hexes = hashlib.sha256(f"{self.seed}:{name}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(hexes[k : k + 8], 16) for k in (0, 8, 16, 24))
        ends = [0, *(m.end() for m in UNIT.finditer(text))]
        n = len(ends) - 1
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        if not text or any(s in text for s in PARTS) or h3 % 100 >= self.percent:
            return n, "plain", 0, 0, ends
        return n, "spm" if h4 % 100 < self.suffix_first else "psm", first, second, ends

    def chunks(self, text: str, ends: list[int], first: int, last: int) -> Iterator[str]:
        """The units first to last as pieces of so many units; longer ones are cut by characters."""
        for a in range(first, last, self.chunk_units):
            start, end = ends[a], ends[min(a + self.chunk_units, last)]
            for at in range(start, end, self.chunk_chars):
                yield text[at : min(at + self.chunk_chars, end)]


def _home(key: tuple[bytes, int]) -> int:
    """All pieces of a document have one partition."""
    return int.from_bytes(key[0][:8], "big")


def _emit(documents: DataFrame, rules: Rules, plain) -> RDD:
    """((document, place), value) records: a head (id, units, form, prefix and middle characters, ``plain(text)`` of texts that stay) and the pieces of the output.

    The document is a hash of the row and its partition, so that rows that repeat id and text meet only if they come from one partition."""

    def run(part: int, rows: Iterator) -> Iterator[tuple[tuple[bytes, int], object]]:
        for name, text in rows:
            text = text or ""
            n, form, first, second, ends = rules.plan("" if name is None else str(name), text)
            key = hashlib.blake2b(f"{part}:{name!r}:".encode() + text.encode(), digest_size=16).digest()
            if form == "plain":
                yield (key, HEAD), (name, n, form, None, None, plain(text))
                continue
            yield (key, HEAD), (name, n, form, ends[first], ends[second] - ends[first], None)
            bounds, place = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, n)}, 0
            for sentinel in ORDERS[form]:
                for piece in (sentinel, *rules.chunks(text, ends, *bounds[sentinel])):
                    yield (key, place), piece
                    place += 1

    return documents.rdd.mapPartitionsWithIndex(run)


def _sorted(records: RDD, partitions: int) -> RDD:
    return records.repartitionAndSortWithinPartitions(partitions, _home)


def _once(records: Iterator) -> Iterator[tuple[tuple[bytes, int], object, int]]:
    """Records of sorted pieces, equal keys (repeated rows) as one with their number."""
    last, value, n = None, None, 0
    for key, found in records:
        if key != last:
            if n:
                yield last, value, n
            last, value, n = key, found, 0
        n += 1
    if n:
        yield last, value, n


def _texts(records: Iterator) -> Iterator[tuple]:
    head, parts, copies = (), [], 0
    for (_, place), value, n in _once(records):
        if place == HEAD:
            yield from [(*head, "".join(parts))] * copies
            head, parts, copies = value[:5], [] if value[5] is None else [value[5]], n
        else:
            parts.append(value)
    yield from [(*head, "".join(parts))] * copies


def _read_back(records: Iterator) -> Iterator[tuple[tuple[bytes, int], object]]:
    """Digests each output on its way and deals its pieces to their places in the original, which the sentinels tell; an end record bears the digest."""
    key, seen, digest, part, place = None, 0, None, 0, 0
    for (now, at), value, n in _once(records):
        if at == HEAD:
            if digest is not None:
                yield (key, END), digest.hexdigest()
            key, seen, digest, place = now, n, None if value[2] == "plain" else hashlib.sha256(), 0
            yield (now, HEAD), (value, seen)
            continue
        digest.update(value.encode())
        if value in PARTS:
            part = PARTS[value]
        else:
            yield (now, (part << 40) + place), value
            place += 1
    if digest is not None:
        yield (key, END), digest.hexdigest()


def _digests(records: Iterator) -> Iterator[tuple]:
    head, copies, digest = None, 0, None
    for (_, place), value in records:
        if place == HEAD:
            head, copies = value
            if head[2] == "plain":
                yield from [(*head[:5], head[5], head[5])] * copies
            digest = hashlib.sha256()
        elif place == END:
            yield from [(*head[:5], value, digest.hexdigest())] * copies
        else:
            digest.update(value.encode())


def _schema(documents: DataFrame, id_col: str, *more: str) -> T.StructType:
    texts = [T.StructField(c, T.StringType()) for c in more]
    own = [T.StructField(id_col, documents.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
    return T.StructType([*own, T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), *texts])


def _partitions(documents: DataFrame, text_col: str) -> int:
    """As many that each holds about ``PARTITION_BYTES`` of text, and no fewer than the session's shuffles have; what a sort can't hold it spills."""
    found = documents.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(-(-found // PARTITION_BYTES), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fim_texts(documents: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): every document as it is trained on.

    ``n`` counts units: a word with the blanks before it, or blanks at the end. Form is ``plain`` (the text itself; the two counts are null) for
    texts that are null or empty or hold a sentinel, and for those that the hash of the id leaves; else ``psm`` or ``spm``.
    A null id hashes as an empty one. Rows that repeat an id are documents of their own, each with the id's hashes; rows that also repeat the text
    give as many equal rows. A very long text, or one without any blank, is cut into pieces of bounded length. Other columns are ignored; an empty table gives no rows.
    """
    records = _emit(documents.select(id_col, text_col), rules, lambda text: text)
    rows = _sorted(records, _partitions(documents, text_col)).mapPartitions(_texts)
    return documents.sparkSession.createDataFrame(rows, _schema(documents, id_col, "output"), verifySchema=False)


def fim_digests(documents: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of what ``fim_texts`` gives, without joining a text: outputs
    and restored texts are digested piece by piece. The second sort stays in the partition, as the pieces are dealt alike. Edge cases are those of ``fim_texts``."""
    records = _emit(documents.select(id_col, text_col), rules, lambda text: hashlib.sha256(text.encode()).hexdigest())
    n = _partitions(documents, text_col)
    back = _sorted(records, n).mapPartitions(_read_back, preservesPartitioning=True)
    rows = _sorted(back, n).mapPartitions(_digests)
    return documents.sparkSession.createDataFrame(rows, _schema(documents, id_col, "output_sha256", "restored_sha256"), verifySchema=False)


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second, third = ORDERS[form]
    a, b = output.index(second), output.index(third)
    parts = {first: output[len(first) : a], second: output[a + len(second) : b], third: output[b + len(third) :]}
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]
