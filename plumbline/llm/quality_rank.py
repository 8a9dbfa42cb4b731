"""Operator 2: quality by Bradley-Terry pairwise ranking.

Every labelled row that is not held out is paired with rows of the other label in blocks of
bounded size; a linear score is learned by logistic loss on the differences of their features, in
Newton steps whose sums come from one pass over all blocks. The score's exact quantile at the
share of worse documents becomes the threshold, and scores are mapped so that it lies at
``THRESHOLD``. The driver holds sums of the size of the model, never rows of features.

Edge cases: null and empty texts get the features of an empty text and a score like any other;
rows with a null or repeated id are scored like others (a null id counts as an empty one when
rows are held out); an id with several labels counts as better if any says so; without both
labels every score is the threshold, so all documents are predicted 1; an empty table gives no
row; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import id_remainder, id_text, prepare, stored, utf8_values
from plumbline.llm.features import ngram_counts

THRESHOLD = 0.3
BLOCK_ROWS = 512
BLOCK_PARTNERS = 64
RIDGE = 1e-3
DIMS = 256
_SLICES = 1024
_FEW = 4096
_SPACE = b" \t\n\x0b\x0c\r"
_CLASSES = [_SPACE, bytes(range(48, 58)), bytes(range(65, 91)), bytes(range(97, 123)),
            b".,;:", b"!?", b"'\"()[]", b"#*$%&|<>", b"-_/\\+=~^@`{}", bytes(range(128, 256)), b"\n"]


@dataclass
class RankModel:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -6, 6) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.threshold) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def text_features(raw: bytes) -> np.ndarray:
    """Shares of byte classes, word and line shape, repetition, and hashed n-grams."""
    size = max(1, len(raw))
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = max(1, len(words))
    shares = [(len(raw) - len(raw.translate(None, c))) / size for c in _CLASSES]
    shape = [np.log1p(len(words)), sum(map(len, words)) / n / 10, len(set(words)) / n ** 0.9,
             np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
             np.log1p(len(words) / max(1, len(lines)))]
    grams = np.sqrt(ngram_counts(raw, DIMS, (1, 2)) / size)
    return np.concatenate([np.sqrt(shares), shape, grams]).astype(np.float32)


def _scaled(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / spread, -6, 6)


def _moments(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Number of rows, sums and sums of squares; ``n`` says how often a row stands."""
    return np.concatenate([[n.sum()], n @ x, n @ (x * x)])


def _centre_spread(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, (one, two) = sums[0], np.split(sums[1:], 2)
    centre = one / size
    spread = np.sqrt(np.maximum(two / size - centre * centre, 0)) + 1e-3
    # Rounded, so that the order in which tasks were summed does not show.
    return centre.round(9), spread.round(9)


def _pair_sums(z: np.ndarray, good: np.ndarray, n: np.ndarray, lead: int, w: np.ndarray) -> np.ndarray:
    """Weight, loss, gradient and curvature of all pairs of a block.

    Each row of label ``lead`` counts as often as it stands, against the mean over the others.
    """
    up, down = z[good], z[~good]
    n_up, n_down = n[good], n[~good]
    dims = z.shape[1]
    if not len(up) or not len(down):
        return np.zeros(2 + dims + dims * dims)
    pairs = np.outer(n_up, n_down) / (n_down if lead else n_up).sum()
    gap = (up @ w)[:, None] - (down @ w)[None, :]
    miss = np.exp(-np.logaddexp(0, gap))
    pull, bend = pairs * miss, pairs * miss * (1 - miss)
    gradient = pull.sum(0) @ down - pull.sum(1) @ up
    mixed = up.T @ (bend @ down)
    curve = (up.T * bend.sum(1)) @ up + (down.T * bend.sum(0)) @ down - mixed - mixed.T
    return np.concatenate([[pairs.sum(), (pairs * np.logaddexp(0, -gap)).sum()],
                           gradient, curve.ravel()])


def _newton(sums_at: Callable[[np.ndarray], np.ndarray], dims: int, rounds: int = 40) -> np.ndarray:
    """The weights with the least mean loss over all pairs plus ``RIDGE`` / 2 times their square."""
    w, step, last, tried = np.zeros(dims), None, np.inf, 0
    for _ in range(rounds):
        sums = sums_at(w if step is None else w + step)
        if not sums[0]:
            return w
        at = w if step is None else w + step
        loss = sums[1] / sums[0] + RIDGE / 2 * (at @ at)
        if loss > last + 1e-12 and tried < 20:
            step, tried = step / 2, tried + 1
            continue
        w, last, tried = at, loss, 0
        gradient = sums[2:2 + dims] / sums[0] + RIDGE * w
        curve = sums[2 + dims:].reshape(dims, dims) / sums[0] + RIDGE * np.eye(dims)
        step = -np.linalg.solve(curve, gradient)
        if -(gradient @ step) < 1e-10:
            w = w + step
            break
    return w.round(9)


def fit_pairs(x: np.ndarray, better: np.ndarray) -> RankModel:
    """Bradley-Terry weights from all pairs of rows in memory: what one block gives."""
    n = np.ones(len(x))
    centre, spread = _centre_spread(_moments(x, n))
    if better.all() or not better.any():
        return RankModel(centre, spread, np.zeros(x.shape[1]), 0.0, 1.0)
    z, lead = _scaled(x, centre, spread), int(better.sum() * 2 >= len(better))
    return RankModel(centre, spread, _newton(lambda w: _pair_sums(z, better, n, lead, w), x.shape[1]),
                     0.0, 1.0)


def _cut_at(values: list[float], weights: list[float], above: float | None, rest: float) -> float:
    """Halfway from the value where the running weight reaches ``rest`` to the next one.

    ``values`` are distinct and ascending, ``above`` is the next value after them, if any.
    """
    follow = [*values, *([] if above is None else [above])]
    reached = np.flatnonzero(np.cumsum(weights) >= rest - 1e-9)
    at = min(int(reached[0]) if len(reached) else len(follow), max(0, len(follow) - 2))
    return float((follow[at] + follow[min(at + 1, len(follow) - 1)]) / 2)


def set_threshold(model: RankModel, x: np.ndarray, better: np.ndarray, share_bad: float) -> RankModel:
    """Threshold at the quantile of the scores that matches the share of worse documents.

    Rows may hold the labels in other shares than the table of labels, so they are weighted.
    """
    raw = model.raw(x).round(9)
    if better.all() or not better.any():
        return model
    weight = np.where(better, (1 - share_bad) / better.sum(), share_bad / (~better).sum())
    values, place = np.unique(raw, return_inverse=True)
    model.threshold = _cut_at(values.tolist(), np.bincount(place, weight).tolist(), None, share_bad)
    model.slope = float(1 / max(1e-6, raw.std()))
    return model


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, whether better, and how often each stands, of rows of labelled features."""
    found = np.frombuffer(b"".join(batch.column("features").to_pylist()), np.float32)
    return (found.reshape(batch.num_rows, -1).astype(np.float64),
            np.array(batch.column("quality")) == 1, np.array(batch.column("n"), np.float64))


def _summed(rows: DataFrame, sums_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum over all batches of ``rows``; tasks are added up in groups before the driver."""
    groups = max(1, int(rows.rdd.getNumPartitions() ** 0.5))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = sums_of(batch)
                total = found if total is None else total + found
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist(
                [{"place": task % groups, "task": task, "sums": total.tobytes()}])

    def add(table: pa.Table) -> pa.Table:
        found = table.sort_by("task")
        total = sum(np.frombuffer(v, np.float64) for v in found["sums"].to_pylist())
        return pa.table({"place": found["place"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(part, "place long, task long, sums binary")
    if groups > 1:
        parts = parts.groupBy("place").applyInArrow(add, "place long, sums binary")
    found = sorted((r["place"], bytes(r["sums"])) for r in parts.collect())
    return sum(np.frombuffer(v, np.float64) for _, v in found) if found else None


def _quantile(values: DataFrame, share: float) -> float:
    """The cut of ``_cut_at`` for distinct ``raw`` with ``weight``: slices are narrowed until few are left."""
    low, high, size = values.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
    before = 0.0
    while size > _FEW:
        place = F.floor((F.col("raw") - low) / (high - low) * _SLICES)
        slices = sorted(tuple(r) for r in values.filter(F.col("raw").between(low, high)).groupBy(
            place.alias("slice")).agg(F.sum("weight"), F.min("raw"), F.max("raw"), F.count("raw")).collect())
        for _, weight, low, high, size in slices:
            if before + weight >= share - 1e-9:
                break
            before += weight
    rows = sorted(tuple(r) for r in values.filter(F.col("raw").between(low, high))
                  .select("raw", "weight").collect())
    above = values.filter(F.col("raw") > high).agg(F.min("raw")).first()[0]
    if above is None:
        below = values.filter(F.col("raw") < low).agg(F.max("raw")).first()[0]
        rows = [*([] if below is None else [(below, 0.0)]), *rows]
    return _cut_at([r[0] for r in rows], [r[1] for r in rows], above, share - before)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_features(v).tobytes() for v in utf8_values(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())],
                                         ["doc_id", "features"])


def _labelled_features(docs: DataFrame, marks: DataFrame, modulus: int) -> DataFrame:
    """Features, label and number of equal rows of the documents that have a mark.

    Features are taken where the texts are read, so that the join moves them and no text.
    """
    texts = id_text(docs).filter(F.col("doc_id").isNotNull()
                                 & (id_remainder(F.col("doc_id"), modulus) != 0))
    return (texts.mapInArrow(_feature_rows, "doc_id long, features binary").join(marks, "doc_id")
            .groupBy("features", "quality").agg(F.count(F.lit(1)).alias("n")))


def score_quality(docs: DataFrame, model: RankModel | None) -> DataFrame:
    """doc_id and score for rows with doc_id and text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, THRESHOLD)
            if model is not None and batch.num_rows:
                found = model.scores(np.stack([text_features(v)
                                               for v in utf8_values(batch.column(1))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())],
                                             ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: RankModel | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores the threshold or more."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
                continue
            scores = model.scores(np.stack([text_features(v)
                                            for v in utf8_values(batch.column(at))]))
            yield batch.filter(pa.array(scores >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def _blocks(rows: DataFrame, sizes: dict[int, int], lead: int) -> DataFrame:
    """Blocks of about ``BLOCK_ROWS`` rows of label ``lead``, with enough rows of the other one.

    A row of the other label stands in as many blocks as it takes to give each some
    ``BLOCK_PARTNERS`` of them. Rows are distinct, so a hash of their features deals them out.
    """
    blocks = -(-sizes[lead] // BLOCK_ROWS)
    copies = min(blocks, -(-blocks * BLOCK_PARTNERS // sizes[1 - lead]))
    home = F.pmod(F.xxhash64("features"), F.lit(blocks))
    steps = F.array(F.lit(0)) if copies == 1 else F.when(
        F.col("quality") == lead, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(copies - 1)))
    placed = rows.select("*", home.alias("home"), F.explode(steps).alias("copy")).select(
        F.pmod(F.col("home") + F.floor(F.col("copy") * F.lit(blocks) / F.lit(copies)),
               F.lit(blocks)).alias("block"), F.struct("quality", "n", "features").alias("row"))
    return placed.groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows")).select("rows")


def learn_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> RankModel | None:
    """The model of all labelled rows of ``docs`` that are not held out."""
    marks = (labels.select(labels["doc_id"].cast("long").alias("doc_id"),
                           labels["quality"].cast("int").alias("quality"))
             .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .filter(id_remainder(F.col("doc_id"), modulus) != 0)
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    counts = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    prepare(docs.sparkSession)
    # Equal rows become one that says how often it stands; they cannot fill a block or a slice.
    rows = stored(_labelled_features(docs, marks, modulus), "quality-rows")
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("quality").agg(
        F.count(F.lit(1)), F.sum("n")).collect()}
    if not found:
        return None
    centre, spread = _centre_spread(_summed(rows, lambda b: _moments(*_arrays(b)[::2])))
    if len(found) < 2:
        return RankModel(centre, spread, np.zeros(len(centre)), 0.0, 1.0)
    lead = int(found[1][0] >= found[0][0])
    blocks = stored(_blocks(rows, {q: distinct for q, (distinct, _) in found.items()}, lead),
                    "quality-blocks")

    def sums_at(w: np.ndarray) -> np.ndarray:
        def sums_of(batch: pa.RecordBatch) -> np.ndarray:
            total = 0
            for block in batch.column(0):
                x, good, n = _arrays(pa.RecordBatch.from_struct_array(block.values))
                total = total + _pair_sums(_scaled(x, centre, spread), good, n, lead, w)
            return total

        return _summed(blocks, sums_of)

    model = RankModel(centre, spread, _newton(sums_at, len(centre)), 0.0, 1.0)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array(model.raw(_arrays(batch)[0]).round(9)), batch.column("quality"),
                    batch.column("n")], ["raw", "quality", "n"])

    bad = counts.get(0, 0) / max(1, sum(counts.values()))
    weight = F.col("n") * F.when(F.col("quality") == 1, F.lit((1 - bad) / found[1][1])).otherwise(
        F.lit(bad / found[0][1]))
    values = stored(rows.mapInArrow(raws, "raw double, quality int, n long").groupBy("raw").agg(
        F.sum(weight).alias("weight"), F.sum("n").alias("n")), "quality-raw")
    model.threshold = _quantile(values, bad)
    size = found[0][1] + found[1][1]
    mean = values.agg(F.sum(F.col("raw") * F.col("n"))).first()[0] / size
    away = values.agg(F.sum(F.col("n") * (F.col("raw") - mean) * (F.col("raw") - mean))).first()[0]
    model.slope = float(1 / max(1e-6, round((away / size) ** 0.5, 9)))
    return model


def rank_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """Learn from the labelled rows that are not held out; score every row."""
    model = learn_quality(docs, labels, modulus)
    held = F.coalesce(id_remainder(F.col("doc_id"), modulus) == 0, F.lit(True))
    return score_quality(id_text(docs), model).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
