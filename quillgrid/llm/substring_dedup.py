"""Substring dedup by sliding sentence spans: runs of sentences that occur again anywhere are removed but for the first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .shingles import chunks, mix, word_hashes

#: A sentence of more words is cut into pieces; a piece without a place to cut at is cut after so many words.
LONG = 16
#: A long sentence is cut after each word whose hash is the least of so many words on either side.
REACH = 3
#: A sentence ends after a word that ends in one of these, at a line's end, and after an ideographic full stop, exclamation or question mark.
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_WIDE = [c.encode() for c in "。！？"]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass
class Pieces:
    """Sentences, long ones in pieces, of texts that lie one after another. A piece takes the white space after it, the first of a text also that before."""

    hashes: np.ndarray  #: of all words
    edge: np.ndarray  #: the first word of each piece, and the number of words
    begin: np.ndarray  #: the first byte of each piece
    head: np.ndarray  #: the first piece of each text, and the number of pieces
    text: np.ndarray  #: the text of each piece


def _cut_long(hashes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The first word of each piece and the number of words: ``opens`` marks the first words of sentences."""
    sentence = np.append(np.flatnonzero(opens), len(hashes))
    length = np.diff(sentence)
    inside = np.flatnonzero(np.repeat(length > LONG, length))
    low, high = (np.repeat(x, length)[inside] for x in (sentence[:-1], sentence[1:]))
    least, own = np.ones(len(inside), bool), hashes[inside]
    for d in range(1, REACH + 1):
        least &= (inside - d < low) | (own < hashes[np.maximum(inside - d, 0)])
        least &= (inside + d >= high) | (own <= hashes[np.minimum(inside + d, len(hashes) - 1)])
    edge = np.union1d(sentence, inside[least] + 1)
    far = np.flatnonzero(np.diff(edge) > 2 * LONG)
    return np.union1d(edge, np.concatenate([np.arange(edge[k] + LONG, edge[k + 1], LONG) for k in far])) if len(far) else edge


def pieces(data: np.ndarray, at: np.ndarray) -> Pieces:
    """The pieces of the texts in ``data``, of which each begins where ``at`` says. Where a text is cut depends on a few words around the place alone."""
    wide = [np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c)) + 3 for a, b, c in _WIDE]
    hashes, starts, ends = word_hashes(data, np.union1d(at, np.concatenate(wide)))
    word = np.searchsorted(starts, at)
    opens = np.zeros(len(starts) + 1, bool)
    opens[word] = True
    lines = np.cumsum(data == 10)
    before, after = ends[:-1], starts[1:]
    opens[1:-1] |= _STOPS[data[before]] | (lines[after] > lines[before]) | (after == before + 1)
    edge = _cut_long(hashes, opens[:-1])
    text = np.searchsorted(word, edge[:-1], "right") - 1
    head = np.searchsorted(edge, word)
    begin = starts[edge[:-1]]
    begin[head[:-1][np.diff(head) > 0]] = at[:-1][np.diff(head) > 0]
    return Pieces(hashes, edge, begin, head, text)


def piece_runs(found: Pieces, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, h1, h2) of the least runs of two pieces or more with ``min_words`` words: one from each piece on, one up to each."""
    edge, n = found.edge, len(found.text)
    each = np.arange(n)
    last = np.maximum(np.searchsorted(edge, edge[:-1] + min_words), each + 2)
    first = np.minimum(np.searchsorted(edge, edge[1:] - min_words, "right"), each) - 1
    ahead, behind = last <= found.head[found.text + 1], first >= found.head[found.text]
    both = np.unique(np.concatenate([each[ahead] * (n + 1) + last[ahead], first[behind] * (n + 1) + each[behind] + 1]))
    start, end = both // (n + 1), both % (n + 1)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(edge[-1], b, np.uint64)])) for b in (_BASE, _INVERSE))

    def run_hash(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down[:-1], dtype=np.uint64)])
        return mix((sums[edge[end]] - sums[edge[start]]) * up[edge[start]])

    text = found.text[start]
    return text, start - found.head[text], end - found.head[text], run_hash(found.hashes), run_hash(mix(found.hashes + np.uint64(_BASE)))


def _spans(docs: DataFrame, min_words: int, *, places: bool = True) -> DataFrame:
    """(id, version, text) -> (h1, h2, id, version, run), or h1 alone; run is start * 2**32 + end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for data, at in chunks(batch.column(2)):
                text, start, end, h1, h2 = piece_runs(pieces(data, at), min_words)
                columns = {"h1": pa.array(h1.view(np.int64))}
                if places:
                    rows = pa.array(text + low)
                    columns |= {"h2": pa.array(h2.view(np.int64)), "id": batch.column(0).take(rows), "version": batch.column(1).take(rows), "run": pa.array((start << 32) + end)}
                low += len(at) - 1
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select("id", "version", "text").mapInArrow(run, "h1 long, h2 long, id long, version long, run long" if places else "h1 long")


def _left(data: bytes, begin: np.ndarray, end: int, lost: np.ndarray) -> str:
    """The text of the pieces that are not lost."""
    stop = np.append(begin[1:], end)
    return b"".join(data[a:b] for a, b in zip(begin[~lost].tolist(), stop[~lost].tolist())).decode()


def _without(docs: DataFrame) -> DataFrame:
    """(id, text, runs) -> (id, text, n_sentences, n_removed): the text without the pieces of ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, old, texts, totals, removed = 0, batch.column(1), [], [], []
            for data, at in chunks(old):
                found, raw = pieces(data, at), data.tobytes()
                totals.append(np.diff(found.head))
                for k in range(len(at) - 1):
                    runs = batch.column(2)[low + k]
                    depth = np.zeros(found.head[k + 1] - found.head[k] + 1, np.int64)
                    if runs.is_valid:
                        runs = runs.values.to_numpy()
                        np.add.at(depth, runs >> 32, 1)
                        np.add.at(depth, runs & 0xFFFFFFFF, -1)
                    lost = np.cumsum(depth)[:-1] > 0
                    removed.append(int(lost.sum()))
                    texts.append(_left(raw, found.begin[found.head[k] : found.head[k + 1]], int(at[k + 1]), lost) if removed[-1] else old[low + k].as_py())
                low += len(at) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *totals])), pa.array(removed, pa.int64())], ["id", "text", "n_sentences", "n_removed"])

    return docs.mapInArrow(run, "id long, text string, n_sentences long, n_removed long")


def drop_repeated_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 30) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed): every document without the runs of sentences that an earlier place holds.

    A sentence of more than 16 words is cut into pieces at words whose hash is the least of those near it, so that the same
    words are cut at the same places whatever stands around them. From every piece on, and up to every piece, the shortest run of
    two consecutive pieces or more with at least ``min_words`` words is hashed (128 bits; words between blanks, A-Z folded). That
    covers the same as hashing every run of so many words. Runs are joined globally; of equal runs the first by (id, place) stays
    and the pieces of all others are removed. So every repeated passage of ``min_words`` words or more is covered but for the parts of pieces (mostly under 16 words, never over 32) at its two ends. ``n_sentences``
    and ``n_removed`` count pieces.

    Null or empty text: empty, nothing removed. A null id comes before all others. Rows that repeat id and text are one
    document, and each gives the same row. Other columns are ignored. Only hashed runs and (once) the texts are shuffled; a passage that very many documents
    hold is counted map-side and its runs are joined with one row.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    again = cut(_spans(docs, min_words, places=False).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
    repeated = cut(cut(_spans(docs, min_words).join(again, "h1")).distinct())  # apart, so that the join can split a hot hash; hashing twice is cheaper than a table of all runs
    first = repeated.groupBy("h1", "h2").agg(F.min(F.struct("id", "version", "run")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = repeated.join(cut(first.select("h1", "h2", "first")), ["h1", "h2"]).where(~F.struct("id", "version", "run").eqNullSafe(F.col("first")))
    lost = cut(later.groupBy("id", "version").agg(F.collect_set("run").alias("runs")))
    there = docs.alias("d").join(lost.alias("x"), F.expr("d.id <=> x.id and d.version = x.version"), "left").select("d.id", "text", "runs")
    return _without(there).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_sentences", "n_removed")
