"""Operator 11: toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts (``SAMPLE_PER_LABEL`` of each label) is the set of examples.
Terms are words and beginnings of words (``PREFIXES`` bytes) that stand in toxic examples more
often than chance allows (log-likelihood ratio ``LEAST_RATIO``, at most ``MAX_TERMS`` of them);
tf-idf vectors over these terms are compared by cosine. Examples with equal vectors are one entry
with the weights of both labels, so copies neither fill the neighbours nor break ties.

The entries lie in an inverted index cut into blocks with the largest weight of each term per
block. A query adds these maxima up to a bound for each block and reads blocks from the highest
bound on, until no further block can hold a nearer entry than the ``NEIGHBOURS`` found; the result
is that of comparing all entries. The nearest examples vote by their distance; of an entry with
more examples than are still wanted, all labels count in proportion. A logistic
curve fitted on examples that are not in the index turns votes into probabilities.

Edge cases: null and empty texts, and texts without any word, get the base
share; texts of any length are read whole; rows with a null or repeated id are scored like others
(a null id counts as an empty one when rows are held out); an id with several labels is toxic if
any says so, with several texts the largest one is the example; equal cosines rank by the order of
entries, which is by their terms; without labels every score is 0, with one label its value; an
empty table gives no row; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.coded import slices
from plumbline.llm.common import id_remainder, id_text, prepare, stored, utf8_values
from plumbline.llm.features import bounded_sample

THRESHOLD = 0.5
SAMPLE_PER_LABEL = 4000
CALIBRATION_PART = 4  # one of so many examples stays out of the index
PREFIXES = (4, 5, 6)
LEAST_RATIO = 18.0
MAX_TERMS = 20_000
NEIGHBOURS = 15
OTHER_WORDS = 0.05
BLOCK = 32
_KNOWN_WORDS = 1 << 19
_TERMS = bytes(32 if i < 65 or 91 <= i < 97 or 123 <= i < 128 else
               i + 32 if i < 91 else i for i in range(256))


# Terms

def terms_of_word(word: bytes) -> list[bytes]:
    """The word, and its beginnings with an asterisk."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) >= n)]


def word_counts(raw: bytes) -> Counter:
    found: Counter = Counter()
    for part in slices(raw.translate(_TERMS)):
        found.update(part.split())
    return found


class TermCounter:
    """Counts the chosen terms of a text; remembers which words have any."""

    def __init__(self, terms: Iterable[bytes]):
        self.ids = {t: i for i, t in enumerate(terms)}
        self._known: dict[bytes, tuple[int, ...]] = {}

    def _ids(self, word: bytes) -> tuple[int, ...]:
        if len(self._known) >= _KNOWN_WORDS:
            self._known.clear()
        found = tuple(self.ids[t] for t in terms_of_word(word) if t in self.ids)
        self._known[word] = found
        return found

    def counts(self, raw: bytes) -> tuple[tuple[int, int], ...]:
        """(term, count) in the order of terms; the last is the number of other words.

        A text of other words only is ((last, 1),) whatever their number, one without words ().
        """
        out: Counter = Counter()
        known, other = self._known, 0
        for word, n in word_counts(raw).items():
            ids = known.get(word)
            if ids is None:
                ids = self._ids(word)
            if not ids:
                other += n
            for i in ids:
                out[i] += n
        if other:
            out[len(self.ids)] = other if out else 1
        return tuple(sorted(out.items()))


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a term being in a of n_a and b of n_b texts alike."""
    def part(k, n, share):
        miss = n - k
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.where(k > 0, k * np.log(k / n / share), 0.0)
                    + np.where(miss > 0, miss * np.log(miss / n / (1 - share)), 0.0))

    share = np.clip((a + b) / (n_a + n_b), 1e-12, 1 - 1e-12)
    return 2 * (part(a, n_a, share) + part(b, n_b, share))


# Index

@dataclass
class Neighbour:
    entry: int
    cosine: float


class BlockMaxIndex:
    """Unit vectors in an inverted index with block maxima; finds the k nearest exactly."""

    def __init__(self, vectors: list[dict[int, float]], block: int = BLOCK):
        self.vectors, self.block = vectors, block
        self.n_blocks = -(-len(vectors) // block)
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        maxima: dict[int, list[tuple[int, float]]] = {}
        for b in range(self.n_blocks):
            lists: dict[int, list[tuple[int, float]]] = {}
            for at, vector in enumerate(vectors[b * block:(b + 1) * block]):
                for term, weight in vector.items():
                    lists.setdefault(term, []).append((at, weight))
            self.postings.append({t: (np.array([x[0] for x in v]), np.array([x[1] for x in v]))
                                  for t, v in lists.items()})
            for term, v in lists.items():
                maxima.setdefault(term, []).append((b, max(x[1] for x in v)))
        self.maxima = {t: (np.array([x[0] for x in v]), np.array([x[1] for x in v]))
                       for t, v in maxima.items()}
        self.blocks_read = 0

    def nearest(self, query: dict[int, float], k: int) -> list[Neighbour]:
        """The k entries with the largest positive cosines; equal ones by their number."""
        bound = np.zeros(self.n_blocks)
        for term, weight in query.items():
            if (held := self.maxima.get(term)) is not None:
                bound[held[0]] += weight * held[1]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] * (1 + 1e-9) < -best[-1][0]:
                break
            self.blocks_read += 1
            scores, lists = np.zeros(self.block), self.postings[b]
            for term, weight in query.items():
                if (held := lists.get(term)) is not None:
                    scores[held[0]] += weight * held[1]
            least = -best[-1][0] if len(best) == k else 0.0
            for at in np.flatnonzero((scores > 0) & (scores >= least)).tolist():
                best.append((-round(float(scores[at]), 12), b * self.block + at))
            best = sorted(best)[:k]
        return [Neighbour(entry, -cosine) for cosine, entry in best]


@dataclass
class ToxicModel:
    terms: list[bytes]
    idf: np.ndarray
    index: BlockMaxIndex
    toxic: np.ndarray  # weight of the toxic examples of each entry
    clean: np.ndarray
    size: np.ndarray  # number of examples of each entry
    example: np.ndarray  # the smallest id among them
    base: float  # share of toxic labels
    slope: float = 1.0
    shift: float = 0.0

    def vector(self, counts: tuple[tuple[int, int], ...]) -> dict[int, float]:
        return unit_vector(counts, self.idf)

    def vote(self, near: list[Neighbour]) -> float:
        """The weighted share of toxic ones among the nearest examples, leaning on the base share."""
        if not near:
            return self.base
        entry = np.array([x.entry for x in near])
        size = self.size[entry]
        taken = np.clip(NEIGHBOURS - (np.cumsum(size) - size), 0, size) / size
        weight = taken / (0.02 + np.maximum(0, 1 - np.array([x.cosine for x in near])))
        toxic, clean = weight @ self.toxic[entry], weight @ self.clean[entry]
        return float((toxic + 0.1 * self.base) / (toxic + clean + 0.1))

    def probability(self, vote: float) -> float:
        return 1 / (1 + math.exp(-(self.slope * _logit(vote) + self.shift)))

    def score(self, counts: tuple[tuple[int, int], ...]) -> tuple[float, list[Neighbour]]:
        near = self.index.nearest(self.vector(counts), NEIGHBOURS)
        return self.probability(self.vote(near)), near


def unit_vector(counts: tuple[tuple[int, int], ...], idf: np.ndarray) -> dict[int, float]:
    weights = {t: n * float(idf[t]) for t, n in counts}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return {t: w / norm for t, w in weights.items()} if norm > 0 else {}


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def fit_curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray,
              ridge: float = 1.0) -> tuple[float, float]:
    """Slope and shift of a logistic curve over the logit of votes, drawn towards (1, 0)."""
    x = np.stack([np.array([_logit(v) for v in votes]), np.ones(len(votes))], 1) if len(votes) else \
        np.zeros((0, 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - toxic)) + ridge * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), grad)
        w = w - np.clip(step, -1, 1)
    return max(0.05, float(w[0])), float(w[1])


# Learning

def examples(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic and held (out of the index) of the examples; labelled ids by label."""
    marks = (labels.select(labels["doc_id"].cast("long").alias("doc_id"),
                           labels["toxic"].cast("int").alias("toxic"))
             .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .filter(id_remainder(F.col("doc_id"), modulus) != 0)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    chosen = bounded_sample(marks, F.col("doc_id"), "toxic", SAMPLE_PER_LABEL)
    texts = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(
        F.max(F.coalesce("text", F.lit(""))).alias("text"))
    once = texts.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    held = F.pmod(F.xxhash64("text", F.lit("curve")), F.lit(CALIBRATION_PART)) == 0
    return stored(once.select("doc_id", "text", "toxic", held.alias("held")), "toxic-examples"), counts


def _term_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (Counter(), Counter())
    for batch in batches:
        for raw, toxic in zip(utf8_values(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found[toxic].update({t for w in word_counts(raw) for t in terms_of_word(w)})
    terms = sorted(found[0].keys() | found[1].keys())
    for lo in range(0, len(terms), 1 << 16):
        some = terms[lo:lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.binary()), pa.array([found[1][t] for t in some], pa.int64()),
             pa.array([found[0][t] for t in some], pa.int64())], ["term", "toxic", "clean"])


def choose_terms(rows: DataFrame) -> list[bytes]:
    """The terms that stand in toxic examples more often than chance allows."""
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return []
    leaning = (rows.select("text", "toxic").mapInArrow(
        _term_documents, "term binary, toxic long, clean long").groupBy("term").agg(
            F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") > 1) & (F.col("toxic") * n_clean > 2 * F.col("clean") * n_toxic)))

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.asarray(batch.column(i), np.float64) for i in (1, 2))
            found = likelihood_ratio(a, b, n_toxic, n_clean)
            good = found >= LEAST_RATIO
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), pa.array(found[good])], ["term", "ratio"])

    best = leaning.mapInArrow(ratio, "term binary, ratio double").orderBy(
        F.desc("ratio"), "term").limit(MAX_TERMS)
    return sorted(bytes(r[0]) for r in best.collect())


def learn_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> ToxicModel | None:
    """The model of the labelled rows of ``docs`` that are not held out."""
    prepare(docs.sparkSession)
    rows, labelled = examples(docs, labels, modulus)
    terms = choose_terms(rows.filter(~F.col("held")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(terms)
        for batch in batches:
            found = [counter.counts(v) for v in utf8_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3),
                 pa.array([[t for t, _ in x] for x in found], pa.list_(pa.int32())),
                 pa.array([[n for _, n in x] for x in found], pa.list_(pa.int64()))],
                ["doc_id", "toxic", "held", "terms", "counts"])

    vectors = sorted((r[0], r[1], r[2], tuple(zip(r[3], r[4], strict=True))) for r in rows.mapInArrow(
        count, "doc_id long, toxic int, held boolean, terms array<int>, counts array<long>").collect())
    whole = sum(labelled.values())
    return build_model(terms, vectors, labelled.get(1, 0) / whole) if vectors else None


def build_model(terms: list[bytes], vectors: list[tuple], share_toxic: float) -> ToxicModel:
    """A model from (id, toxic, held, counts) of examples; ``share_toxic`` is that of all labels."""
    inside = [v for v in vectors if not v[2]] or vectors
    n = Counter(v[1] for v in inside)
    if not n[1] or not n[0]:
        share_toxic = float(n[1] > 0)
    weight = {label: share * len(inside) / n[label] if n[label] else 0.0
              for label, share in ((1, share_toxic), (0, 1 - share_toxic))}
    df = np.ones(len(terms) + 1)
    for v in inside:
        for t, _ in v[3]:
            df[t] += 1
    idf = np.log((2 + len(inside)) / df)
    idf[len(terms)] = OTHER_WORDS
    entries: dict[tuple, list] = {}
    for doc_id, toxic, _, counts in inside:
        if counts:
            e = entries.setdefault(counts, [0.0, 0.0, 0, doc_id])
            e[toxic] += weight[toxic]
            e[2] += 1
            e[3] = min(e[3], doc_id)
    # Entries with the same heaviest terms lie in one block, so that its maxima stay telling.
    made = [(unit_vector(c, idf), *e) for c, e in entries.items()]
    made.sort(key=lambda m: (sorted(m[0], key=lambda t: (-m[0][t], t)), sorted(m[0].items())))
    model = ToxicModel(terms, idf, BlockMaxIndex([m[0] for m in made]), np.array([m[2] for m in made]),
                       np.array([m[1] for m in made]), np.array([m[3] for m in made], np.int64),
                       np.array([m[4] for m in made], np.int64), share_toxic)
    out = [v for v in vectors if v[2]]
    if n[1] and n[0] and out:
        votes = np.array([model.vote(model.index.nearest(model.vector(v[3]), NEIGHBOURS)) for v in out])
        toxic = np.array([v[1] for v in out], float)
        model.slope, model.shift = fit_curve(votes, toxic, np.array([weight[v[1]] for v in out]))
    return model


# Scoring

def score_toxicity(docs: DataFrame, model: ToxicModel | None, n_evidence: int = 3) -> DataFrame:
    """doc_id, score and evidence (ids of the nearest examples with their cosines) of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counter = TermCounter(known.terms) if known else None
        seen: dict[tuple, tuple] = {}  # copies of a text are looked up once
        for batch in batches:
            scores, ids, cosines = [], [], []
            for raw in utf8_values(batch.column(1)):
                counts = counter.counts(raw) if known else ()
                if counts not in seen:
                    if len(seen) >= 1 << 14:
                        seen.clear()
                    seen[counts] = known.score(counts) if known else (0.0, [])
                score, near = seen[counts]
                scores.append(score)
                ids.append([int(known.example[x.entry]) for x in near[:n_evidence]])
                cosines.append([x.cosine for x in near[:n_evidence]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())),
                 pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "evidence", "cosines"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, score double, evidence array<long>, cosines array<double>")


def rate_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Learn from the labelled rows that are not held out; score every row."""
    model = learn_toxicity(docs, labels, modulus)
    held = F.coalesce(id_remainder(F.col("doc_id"), modulus) == 0, F.lit(True))
    return score_toxicity(id_text(docs), model).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence", "cosines")
