"""Quality rules: counts with fixed limits, and logistic regression on hashed word and character n-grams.

Words are runs of characters other than white space in ASCII's sense, lines are parted by ``\\n``. The
counts of a text are exact but for clashes of 64-bit hashes. The model's features are the shares of trigrams
of code points and of words and word pairs in a text; so its margin is a mean of weights over positions, found
for a whole Arrow batch at once. It is trained on labelled rows by FTRL-proximal and calibrated on rows
kept from training; a text is kept if it passes the base rules and its probability reaches a threshold.

Null and empty texts have no words and fail the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Example, Model, labelled_sample, train
from .words import Words, mix, slices, span_hashes, words_of

__all__ = ["THRESHOLD", "base_counts", "fit_quality", "op5_quality", "score_quality"]

CHAR_BITS, WORD_BITS, THRESHOLD, SCALE = 18, 18, 0.5, 40.0
BITS = CHAR_BITS + 1
MAX_ROWS, MIN_WORDS, MAX_REPEAT = 20_000, 50, 50
_SETTINGS = {"bits": BITS, "alpha": 1.0, "beta": 1.0, "l1": 0.3, "l2": 0.1}
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more; was it found before."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, before = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    before[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, before


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """Counts for each text of a batch: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = len(w.counts)
    inside = np.zeros(len(w.data) + 1, dtype=np.int8)
    np.add.at(inside, w.start, 1)
    np.subtract.at(inside, w.end, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": w.counts.astype(np.int64), "word_chars": _per_doc(inside & ((w.data & 0xC0) != 0x80), w.offsets), "n_symbols": _per_doc(_SYMBOL[w.data], w.offsets)}
    # lines: between line feeds and the bounds of texts
    edges = np.unique(np.concatenate((w.offsets, np.flatnonzero(w.data == 10) + 1)))
    start, end = edges[:-1], edges[1:].copy()
    end -= (w.data[end - 1] == 10) if len(end) else 0
    first = np.searchsorted(w.start, start)
    worded = (first < np.searchsorted(w.start, end)) if len(start) else np.zeros(0, dtype=bool)
    start, end = start[worded], end[worded]
    doc = np.searchsorted(w.offsets, start, "right") - 1
    key = mix(span_hashes(w.data, start, end) ^ mix(doc.astype(np.uint64) + _K1)) if len(start) else np.zeros(0, np.uint64)
    out["n_dup_lines"] = np.bincount(doc[_again(key)[1]], minlength=rows).astype(np.int64)
    covered = np.zeros(len(w.hash), dtype=bool)
    if len(w.hash) > 2:
        with np.errstate(over="ignore"):
            window = mix(mix(w.hash[:-2] * _K1 + w.hash[1:-1]) * _K2 + w.hash[2:] + mix(w.doc[:-2].astype(np.uint64)))
        at = np.flatnonzero(w.doc[:-2] == w.doc[2:])
        at = at[_again(window[at])[0]]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=rows).astype(np.int64)
    return out


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each starts."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    more = (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(more == 0, lead, lead & (np.uint32(0x3F) >> more.astype(np.uint32)))
    for k in range(1, 4):
        some = np.flatnonzero(more >= k)
        if len(some):
            point[some] = (point[some] << np.uint32(6)) | (data[at[some] + k] & np.uint32(0x3F))
    return point, at


def _indices(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, index) of each position: trigrams of code points, then words and word pairs."""
    point, at = _code_points(w.data)
    row = np.repeat(np.arange(len(w.counts), dtype=np.int32), np.diff(np.searchsorted(at, w.offsets)))
    if len(point) > 2:
        same = row[:-2] == row[2:]
        with np.errstate(over="ignore"):
            gram = ((point[:-2] * np.uint32(0x9E3779B1) + point[1:-1]) * np.uint32(0x85EBCA77) + point[2:])[same]
            gram = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield row[:-2][same], (gram >> np.uint32(32 - CHAR_BITS)).astype(np.int64)
    else:
        yield np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        same = w.doc[:-1] == w.doc[1:]
        key = np.concatenate((mix(w.hash), mix((w.hash[:-1] * _K2 + w.hash[1:])[same])))
    yield np.concatenate((w.doc, w.doc[:-1][same])), (key >> np.uint64(64 - WORD_BITS)).astype(np.int64) + (1 << CHAR_BITS)


def _examples(batch: pa.RecordBatch) -> list[Example]:
    out: list[Example] = []
    for part in slices(batch):
        pieces: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(part.num_rows)]
        for row, at in _indices(words_of(part.column("text"))):
            order = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[order], np.arange(part.num_rows + 1))
            for k, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if e > s:
                    i, n = np.unique(at[order[s:e]], return_counts=True)
                    pieces[k].append((i.astype(np.int32), (n * (SCALE / (e - s))).astype(np.float32)))
        for p in pieces:
            out.append((np.concatenate([x[0] for x in p]), np.concatenate([x[1] for x in p])) if p else (np.zeros(0, np.int32), np.zeros(0, np.float32)))
    return out


def _margins(w: Words, model: Model) -> np.ndarray:
    rows = len(w.counts)
    out = np.zeros(rows)
    for row, at in _indices(w):
        n = np.bincount(row, minlength=rows)
        out += SCALE * np.bincount(row, weights=model.weights[at], minlength=rows) / np.maximum(n, 1)
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the base counts and the model's ``probability`` of each row's text; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"))
                counts = base_counts(w)
                probability = shared.value.probability(_margins(w, shared.value))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(counts[c]) for c in _COUNTS), pa.array(probability, pa.float64())], names=[*keep, *_COUNTS, "probability"])

    ddl = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} bigint" for c in _COUNTS), "probability double"])
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, ddl)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = 3) -> Model:
    """A model of ``labels.quality`` from about ``max_rows`` labelled rows at most, a fifth of them for calibration.

    With a single class or no rows, the probability is about the share of that class.
    """
    sample, odds = labelled_sample(docs, labels, "quality", max_rows)
    sample = sample.select("doc_id", "text", "y", "key").cache()
    held = F.pmod(F.shiftright("key", 40), F.lit(5)) == 0
    rows, up = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < up < rows:
        sample.unpersist()
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log((up + 0.5) / (rows - up + 0.5))))
    model = train(sample.filter(~held), _examples, _SETTINGS, epochs, 4_000, int(rows * 0.8))
    scored = score_quality(sample.filter(held), Model(model.weights), ("doc_id", "y")).select("y", "probability").collect()
    sample.unpersist()
    model.calibrate(np.array([r["probability"] for r in scored], dtype=float), np.array([r["y"] for r in scored], dtype=float), odds)
    return model


def op5_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Base counts of each document, whether they fail, and whether it is kept."""
    scored = score_quality(documents, fit_quality(documents, labels))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > MAX_REPEAT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).select(
        "doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & (F.col("probability") >= THRESHOLD)).alias("kept"), "probability"
    )
