"""Operator 4: language identification by error-correcting output codes.

Each language gets a binary codeword; one linear classifier over hashed byte n-grams learns each
bit. A text is decoded to the codeword with the smallest loss-weighted distance to its bit
margins; a small gap to the second codeword flags it as ambiguous.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; texts too short for an
n-gram are decoded from the bias of the classifiers; rows with a null or repeated id are
predicted like others (a null id counts as an empty one when rows are held out); with no row to
learn from every text is ``und``; one language alone is always predicted; an empty table gives
no row; columns other than id, text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_remainder, prepare, utf8_values
from plumbline.llm.features import bounded_sample, ngram_counts

DIMS = 1024
SAMPLE_PER_LANGUAGE = 1500
AMBIGUOUS_GAP = 0.1


@dataclass
class CodeModel:
    languages: list[str]
    codes: np.ndarray       # one row of -1 / 1 per language
    weights: np.ndarray     # one column per bit, last row the bias
    bit_weights: np.ndarray

    def margins(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights[:-1] + self.weights[-1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and ambiguity of each row of margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.codes[None])
        total = (loss * self.bit_weights).sum(2)
        share = np.exp(-(total - total.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        top = np.sort(share, 1)
        gap = top[:, -1] - top[:, -2] if top.shape[1] > 1 else top[:, -1]
        return best, top[:, -1], gap < AMBIGUOUS_GAP


def codewords(n: int) -> np.ndarray:
    """Codewords of -1 and 1: all column splits for few languages, seeded random ones for many."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        columns = [[1 if i == 0 or mask >> (i - 1) & 1 else -1 for i in range(n)]
                   for mask in range(2 ** (n - 1) - 1)]
        return np.array(columns, float).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, apart = np.random.default_rng(5), None, -1
    for _ in range(200):
        trial = rng.choice([-1.0, 1.0], (n, bits))
        near = (bits - (trial @ trial.T - 2 * bits * np.eye(n)).max()) / 2
        mixed = (np.abs(trial.sum(0)) < n).all()
        if near > apart and mixed:
            best, apart = trial, near
    return best if best is not None else rng.choice([-1.0, 1.0], (n, bits))


def text_features(raw: bytes) -> np.ndarray:
    counts = np.sqrt(ngram_counts(raw, DIMS))
    return counts / max(1e-6, float(np.sqrt((counts * counts).sum())))


def fit_bits(x: np.ndarray, bits: np.ndarray, rounds: int = 300, rate: float = 8.0,
             ridge: float = 1e-5) -> np.ndarray:
    """Logistic regressions for all bits at once, by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    # Each side of a bit counts the same, however many rows it has.
    pos = np.maximum((bits > 0).sum(0), 1)
    neg = np.maximum((bits < 0).sum(0), 1)
    row_weights = np.where(bits > 0, 0.5 / pos, 0.5 / neg)
    w = np.zeros((x1.shape[1], bits.shape[1]))
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        z = np.clip(bits * (x1 @ ahead), -30, 30)
        grad = x1.T @ (-bits * row_weights / (1 + np.exp(z))) + ridge * ahead
        new = ahead - rate * grad
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_features(v).astype(np.float32).tobytes() for v in utf8_values(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)],
                                         ["features", "lang"])


def fit_languages(train: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> CodeModel | None:
    """Learn from doc_id, text, lang. The sample is bounded: ``per_language`` rows of each."""
    prepare(train.sparkSession)
    sample = bounded_sample(train.filter(F.col("lang").isNotNull()), F.col("doc_id"), "lang",
                            per_language)
    rows = sorted(tuple(r) for r in sample.select("text", "lang").mapInArrow(
        _feature_rows, "features binary, lang string").collect())
    if not rows:
        return None
    languages = sorted({r[1] for r in rows})
    x = np.stack([np.frombuffer(r[0], np.float32) for r in rows]).astype(np.float64)
    label = np.array([languages.index(r[1]) for r in rows])
    codes = codewords(len(languages))
    bits = codes[label]
    weights = fit_bits(x, bits)
    right = ((x @ weights[:-1] + weights[-1]) * bits > 0).mean(0)
    bit_weights = np.log(np.clip(right, 0.5, 0.999) / np.clip(1 - right, 0.001, 0.5)) + 1e-3
    return CodeModel(languages, codes, weights, bit_weights / bit_weights.mean())


def predict_languages(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous for rows with doc_id and text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            named = np.array([bool(t) and (t[:64].isalpha() or any(map(str.isalpha, t)))
                              for t in texts], bool)
            langs, scores, unsure = ["und"] * len(texts), np.zeros(len(texts)), named & False
            if model is not None and named.any():
                at = np.flatnonzero(named)
                x = np.stack([text_features(texts[i].encode()) for i in at])
                best, score, gap = model.decode(model.margins(x))
                scores[at], unsure[at] = score, gap
                for i, k in zip(at, best, strict=True):
                    langs[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(unsure)],
                ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """Learn from the rows that are not held out and predict every row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       docs["text"].cast("string").alias("text"),
                       docs["lang"].cast("string").alias("lang"))
    train = rows.filter(id_remainder(F.col("doc_id"), modulus) != held)
    found = predict_languages(rows, fit_languages(train))
    return found.select("doc_id", (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"),
                        "lang_pred", "score", "ambiguous")
