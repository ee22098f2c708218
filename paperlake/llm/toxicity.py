"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, of the stems of its words (their first five bytes),
of pairs of neighbouring words and of pairs with one word between, hashed to ``BITS`` bits. Words are lower
case and without ASCII signs. L1 leaves few weights, which are broadcast as one array of fixed size.
Labels alone come from the label table; nothing but the text is a feature.

Null and empty texts, and texts without words, get the score of the bias.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Example, Model, labelled_sample, train
from .words import Words, mix, slices, span_hashes, words_of

__all__ = ["BITS", "THRESHOLD", "fit_toxicity", "op7_toxicity", "score_toxicity"]

BITS, THRESHOLD, STEM = 20, 0.3, 5
MAX_ROWS, PRIOR = 20_000, 30.0
_PAIR, _SKIP, _STEM = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = np.uint64(64 - BITS)
_SETTINGS = {"bits": BITS, "alpha": 1.0, "beta": 1.0, "l1": 3.0, "l2": 1.0}


def _indices(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of all features of a batch, repeats included."""
    h, doc = w.hash, w.doc
    stem = span_hashes(w.data, w.start, np.minimum(w.end, w.start + STEM)) if len(h) else h
    rows, keys = [doc, doc], [mix(h), mix(stem ^ _STEM)]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, _PAIR), (2, _SKIP)):
            same = doc[:-gap] == doc[gap:]
            rows.append(doc[:-gap][same])
            keys.append(mix((h[:-gap] * salt + h[gap:])[same]))
    return np.concatenate(rows), (np.concatenate(keys) >> _SHIFT).astype(np.int64)


def _examples(batch: pa.RecordBatch) -> list[Example]:
    out: list[Example] = []
    for part in slices(batch):
        row, at = _indices(words_of(part.column("text"), lower=True, bare=True))
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(part.num_rows + 1))
        for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out.append((np.unique(at[order[s:e]]).astype(np.int32), None))
    return out


def _margins(part: pa.RecordBatch, model: Model) -> np.ndarray:
    """Sum of weights of the features present; only those that L1 has left need telling apart."""
    row, at = _indices(words_of(part.column("text"), lower=True, bare=True))
    some = model.weights[at] != 0
    key = np.unique((row[some] << BITS) | at[some])
    return np.bincount(key >> BITS, weights=model.weights[key & ((1 << BITS) - 1)], minlength=part.num_rows)


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), column: str = "score") -> DataFrame:
    """Columns ``keep`` and a probability for each row, in Arrow batches; the model is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = shared.value.probability(_margins(part, shared.value))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(score, pa.float64())], names=[*keep, column])

    needed = [*keep, *(["text"] if "text" not in keep else [])]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*needed).mapInArrow(run, f"{ddl}, `{column}` double")


def fit_toxicity(docs: DataFrame, labels: DataFrame, where=None, max_rows: int = MAX_ROWS, epochs: int = 4) -> Model:
    """A model of ``labels.toxic`` from about ``max_rows`` labelled rows at most.

    A fifth of them, by a hash of the id, is kept from training and calibrates the margin, the more the
    more rows they are; if it hasn't both labels, the margin stands as it is. With a single class or no rows, the score is about the share of
    that class.
    """
    sample, odds = labelled_sample(docs, labels, "toxic", max_rows, where)
    sample = sample.select("doc_id", "text", "y", "key").cache()
    held = F.pmod(F.shiftright("key", 40), F.lit(5)) == 0
    rows, up = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < up < rows:
        sample.unpersist()
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log((up + 0.5) / (rows - up + 0.5))))
    model = train(sample.filter(~held), _examples, _SETTINGS, epochs, 16_000, int(rows * 0.8))
    scored = score_toxicity(sample.filter(held), Model(model.weights), ("doc_id", "y")).select("y", "score").collect()
    sample.unpersist()
    model.calibrate(np.array([r["score"] for r in scored], dtype=float), np.array([r["y"] for r in scored], dtype=float), odds, PRIOR)
    return model


def op7_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's toxicity, learnt from labelled rows whose crc32(doc_id) mod 4 isn't 2."""
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 4
    model = fit_toxicity(documents, labels, where=fold(F.col("doc_id")) != 2)
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
