"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .shingles import mix

#: Code points of the longest n-gram.
ORDER = 4
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19
#: Median absolute deviations (of a normal distribution, 5.4 standard deviations) that a calibrated bound is above the median.
DEVIATIONS = 8
#: Calibration rows a language must have for a bound of its own.
OWN_ROWS = 20
#: Numbers that scoring holds at a time, a number per n-gram and language.
_CELLS = 1 << 22


def prepare(text: str | None) -> str:
    """Lower-cased letters with single blanks between runs of them, and as many blanks in front as a context is long; "" without a letter."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return " " * (ORDER - 1) + letters + " " if any(map(str.isalpha, letters)) else ""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """For each place from ORDER - 1 on, the hash of the ORDER code points that end there."""
    n = max(0, len(codes) - ORDER + 1)
    h = np.full(n, ORDER, np.uint64)
    for k in range(ORDER):
        h = h * _BASE + codes[k : k + n] + np.uint64(1)
    return mix(h)


@dataclass
class Postings:
    """A sorted array of hashes; of each the languages that have it, with a number."""

    keys: np.ndarray
    begin: np.ndarray  #: of each key's postings, and their number
    lang: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, lang: np.ndarray, value: np.ndarray) -> Postings:
        order = np.argsort(keys, kind="stable")
        known, begin = np.unique(keys[order], return_index=True)
        return cls(known, np.append(begin, len(keys)), lang[order].astype(np.uint16), value[order].astype(np.float32))

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``asked``, language, number) of all postings of all keys asked for."""
        row, hit = _find(self.keys, asked)
        place = np.flatnonzero(hit)
        first = self.begin[row[place]]
        n = self.begin[row[place] + 1] - first
        at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        return np.repeat(place, n), self.lang[at], self.value[at]


@dataclass
class Model:
    """Per order the log probabilities of n-grams, and the log back-off weights of the contexts before them; of a language only those that it has, so that the size is linear in the languages."""

    languages: list[str]
    grams: list[Postings]
    contexts: list[Postings]
    floor: np.ndarray  #: log p of a code point that a language doesn't have

    def logs(self, windows: np.ndarray) -> np.ndarray:
        """log p of the last code point of each window (of ORDER) after the others, a column per language."""
        out = np.zeros((len(windows), len(self.languages)))
        missing = np.ones(out.shape, bool)
        rest = np.arange(len(out))
        for order in range(ORDER, 0, -1):
            place, lang, value = self.grams[order - 1].find(_row_hashes(windows[rest, ORDER - order :], order))
            place = rest[place]
            new = missing[place, lang]
            out[place[new], lang[new]] += value[new]
            missing[place, lang] = False
            rest = rest[missing[rest].any(1)]
            if order > 1:
                place, lang, value = self.contexts[order - 1].find(_row_hashes(windows[rest, ORDER - order : -1], order - 1))
                place = rest[place]
                new = missing[place, lang]
                out[place[new], lang[new]] += value[new]
        return out + missing * self.floor


def _row_hashes(rows: np.ndarray, order: int) -> np.ndarray:
    h = np.full(len(rows), order, np.uint64)
    for k in range(rows.shape[1]):
        h = h * _BASE + rows[:, k] + np.uint64(1)
    return mix(h)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.searchsorted(table, keys)
    row[row == len(table)] = 0
    return row, (table[row] == keys) if len(table) else np.zeros(len(keys), bool)


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, gram, n): counts of all ORDER-grams, summed per batch first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.to_pandas()
            for lang, own in texts.groupby("lang")["text"]:
                codes = [_codes(p) for p in map(prepare, own) if p]
                if not codes:
                    continue
                windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in codes])
                _, first, n = np.unique(_row_hashes(windows, ORDER), return_index=True, return_counts=True)
                joined = windows[first].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
                grams = [joined[k : k + ORDER] for k in range(0, len(joined), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(grams), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: pd.DataFrame) -> Model:
    """Kneser-Ney: raw counts at the highest order, counts of distinct left neighbours below it, absolute discounts n1 / (n1 + 2 n2), interpolated down to a uniform distribution."""
    languages = sorted(counts["lang"].unique())
    windows = np.stack([_codes("".join(counts["gram"]))[k::ORDER] for k in range(ORDER)], 1) if len(counts) else np.zeros((0, ORDER), np.uint64)
    which = np.searchsorted(languages, counts["lang"].to_numpy(str)) if len(counts) else np.zeros(0, np.int64)
    alphabet = len(np.unique(windows)) + 1
    size, count = len(languages), counts["n"].to_numpy(float)
    of = lambda hashes, lang: mix(hashes + lang.astype(np.uint64))  # an n-gram or context of one language
    levels = []  # (order, n-grams, language, count), highest order first; each pair of n-gram and language once
    rows, lang = windows, which
    for order in range(ORDER, 0, -1):
        levels.append((order, rows, lang, count))
        if order > 1:
            _, first, count = np.unique(of(_row_hashes(rows[:, 1:], order - 1), lang), return_index=True, return_counts=True)
            rows, lang, count = rows[first, 1:], lang[first], count.astype(float)
    grams, contexts = [None] * ORDER, [None] * ORDER
    known, below, floor = np.zeros(0, np.uint64), np.zeros(0), np.full(size, -np.log(alphabet))
    for order, rows, lang, count in reversed(levels):
        gram, ctx = _row_hashes(rows, order), _row_hashes(rows[:, :-1], order - 1)
        n1, n2 = (np.bincount(lang[count == k], minlength=size).astype(float) for k in (1, 2))
        discount = np.clip(n1 / np.maximum(n1 + 2 * n2, 1), 0.1, 0.9)
        _, first, at = np.unique(of(ctx, lang), return_index=True, return_inverse=True)
        total, kinds = np.bincount(at, count, len(first)), np.bincount(at, minlength=len(first))
        share = discount[lang[first]] * kinds / total
        lower = below[np.searchsorted(known, of(_row_hashes(rows[:, 1:], order - 1), lang))] if order > 1 else 1 / alphabet
        p = np.maximum(count - discount[lang], 0) / total[at] + share[at] * lower
        grams[order - 1], contexts[order - 1] = Postings.of(gram, lang, np.log(p)), Postings.of(ctx[first], lang[first], np.log(share))
        if order == 1:
            floor[lang[first]] += np.log(share)
        own = of(gram, lang)
        known, below = np.sort(own), p[np.argsort(own)]
    return Model(languages, grams, contexts, floor)


def score_texts(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of scored code points and, per language, the cross-entropy (nats a code point)."""
    count, loss = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(model.languages)))
    held, size, most = [], 0, min(_CHUNK, _CELLS // max(len(model.languages), 1))

    def flush() -> None:
        codes = np.concatenate([c for _, c in held])
        lengths = np.array([len(c) for _, c in held])
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        bounds = np.stack([begin, begin + lengths - ORDER + 1], 1).ravel()  # places whose window crosses into the next text are left out
        _, first, at = np.unique(gram_hashes(codes), return_index=True, return_inverse=True)  # each window is looked up once
        logs = model.logs(np.lib.stride_tricks.sliding_window_view(codes, ORDER)[first])
        where = [k for k, _ in held]
        count[where] = lengths - ORDER + 1
        for lang in range(len(model.languages)):
            loss[where, lang] = -np.add.reduceat(np.append(logs[at, lang], np.zeros(ORDER - 1)), bounds[:-1])[::2] / count[where]

    for k, text in enumerate(texts):
        ready = prepare(text)
        if ready:
            held.append((k, _codes(ready)))
            size += len(ready)
        if size > most:
            flush()
            held, size = [], 0
    if held:
        flush()
    return count, loss


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(id, text) -> (id, lang_pred, score, entropy, excess, n)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.contexts, model.floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        names = np.array([*own.languages, "und"])
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                count, loss = score_texts(part.column(1).to_pylist(), own)
                none = (count == 0) | (len(own.languages) == 0)
                best = np.where(none, len(own.languages), loss.argmin(1) if own.languages else 0)
                least = np.where(none, np.nan, loss.min(1, initial=np.inf))
                gaps = np.exp(-(loss - np.where(none, 0, least)[:, None]) * np.minimum(count, 100)[:, None]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best]), pa.array(np.where(none, 0.0, 1 / np.maximum(gaps, 1))), pa.array(np.where(none, 0.0, least)), pa.array(count)],
                    ["id", "lang_pred", "score", "entropy", "n"],
                )

    return docs.mapInArrow(run, "id long, lang_pred string, score double, entropy double, n long")


def _by_language(values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for lang, value in values.items():
        out = F.when(F.col("lang_pred") == lang, value).otherwise(out)
    return out


def _excess(centre: Column) -> tuple[Column, Column]:
    """Excess cross-entropy over the language's median, as such and scaled by the root of the length: comparable between short and long texts."""
    excess = F.col("entropy") - centre
    return excess, excess * F.sqrt(F.least(F.col("n"), F.lit(400)).cast("double"))


def _medians(rows: DataFrame, value: Column, least_rows: int) -> Column:
    """Per predicted language the median of ``value``; that of all rows for a language with fewer than ``least_rows``."""
    found = rows.groupBy("lang_pred").agg(F.count("*").alias("n"), F.median(value).alias("m")).collect()
    pooled = rows.agg(F.median(value)).first()[0]
    return _by_language({r["lang_pred"]: float(r["m"]) for r in found if r["n"] >= least_rows}, float(pooled or 0.0))


def identify_languages(documents: DataFrame, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = 2_000_000, model_chars: int = 64_000_000, slack: float = 1.25, least_excess: float = 0.5) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) for every row of ``documents``; whole texts are scored.

    ``labelled`` (id, text, lang) gives the training rows; rows without a language or letters teach nothing. Of each language
    a hash of the id picks rows of about ``sample_chars`` code points in all (all rows if there are fewer), and of
    all languages together ``model_chars`` at most, each an equal part, which bounds what is fitted and broadcast; four fifths of the picked rows are counted (by Spark) into
    interpolated Kneser-Ney models of 4-grams, one fifth calibrates rejection. The prediction is the
    language of the lowest cross-entropy per code point (ties: the first name); ``score`` is its share in the softmax of the
    negative entropies times the number of code points (100 at most). ``rejected``: no letter, or an excess over the language's median entropy, scaled by the root of the length, of
    over ``slack`` times a bound (and of over ``least_excess`` nats a code point as such). The bound is the median and eight median absolute
    deviations of the language's calibration rows that are predicted as labelled (of all such rows where a language has under 20), so
    a few rows of garbage or with a wrong label do not move it.

    Null text or text without a letter: ``und``, score 0, rejected. Without any labelled row all is ``und``. Null ids and
    repeated rows are scored like any. Other columns are ignored, and the language column of ``documents`` is never read.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    totals = {r["lang"]: float(r["size"]) for r in rows.groupBy("lang").agg(F.sum(F.char_length("text")).alias("size")).collect()}
    share, sample_chars = F.lit(0.0), min(sample_chars, model_chars // max(len(totals), 1))
    for lang, size in totals.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample_chars / max(size, 1.0))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(5))
    sample = rows.where(draw < share)
    model = fit(gram_counts(sample.where(fold > 0)).toPandas())
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    names = F.array(*(F.lit(lang) for lang in sorted(totals))).cast("array<string>")
    asked = sample.where(fold == 0).select((F.array_position(names, F.col("lang")) - 1).alias("id"), "text")  # the label's place instead of an id
    known = cut(_scored(asked, model).where("n > 0").withColumn("right", F.get(names, F.col("id").cast("int")) == F.col("lang_pred")))
    right = known.where("right")
    centre = _medians(right, F.col("entropy"), 1)
    middle = _medians(right, _excess(centre)[1], OWN_ROWS)
    most = middle + DEVIATIONS * _medians(right, F.abs(_excess(centre)[1] - middle), OWN_ROWS)
    drop(known)
    out = _scored(docs, model)
    excess, scaled = _excess(centre)
    rejected = (F.col("n") == 0) | ((scaled > most * slack) & (excess > least_excess))
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "entropy", rejected.alias("rejected"))
