"""Score predictions of one task against the test side of the gold table."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import registry as R
from plumbline.functions import text as T
from plumbline.operators import atomic, classification, cleaning as C, sets, spells
from plumbline.operators.reshape import gold_spell_lists, predicted_spells
from plumbline.operators.scores import GROUP, OVERALL
from plumbline.operators.splits import apply_split, split_sides
from plumbline.sources.sinks import append_details, append_register, detail_table, register_row


@dataclass
class Evaluation:
    """Lazy result tables. ``summary`` has one row; the others may be absent."""

    task: str
    variable: str | None
    summary: DataFrame
    per_case: DataFrame | None = None
    per_class: DataFrame | None = None
    per_country: DataFrame | None = None

    def _sections(self) -> list[tuple[str, DataFrame, str]]:
        """Name, table and key column of the details that are present."""
        sections = [("per_country", self.per_country, "country"),
                    ("per_class", self.per_class, "label")]
        return [s for s in sections if s[1] is not None]

    def details(self) -> DataFrame | None:
        """All countries and classes as rows (section, name, scores…), however many."""
        tables = [detail_table(df, name, key) for name, df, key in self._sections()]
        if not tables:
            return None
        return tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])

    def metrics_json(self, details: bool = True) -> DataFrame:
        """The summary row with all details as one JSON text.

        Countries and classes go in as maps, all of them, which one row has to hold.
        Without ``details`` the text has the summary only; ``details()`` has the rest.
        Cases never go in: their table is kept as it is.
        """
        plain = [c for c in self.summary.columns if c not in ("task", "variable")]
        table = self.summary
        for name, df, key in self._sections() if details else []:
            fields = F.struct(*[F.col(c) for c in df.columns if c != key])
            entries = df.agg(
                F.map_from_entries(F.collect_list(F.struct(F.col(key), fields))))
            table = table.withColumn(name, entries.scalar())
            plain.append(name)
        return table.withColumn("metrics_json", F.to_json(F.struct(*plain)))

    def register_row(self, details: bool = True, **identity) -> DataFrame:
        """The row for the results register; see ``sinks.register_row``."""
        return register_row(self.metrics_json(details), self.task, self.variable,
                            F.col("metrics_json"), **identity)

    def store(self, register: str, details: str, timestamp: str | None = None,
              **identity) -> None:
        """Append the register row, with the summary as its JSON, and the detail rows beside it.

        Details are written first, as rows, so any number of them is kept and a row
        in the register always has them. Both carry the same time, path, model and task.
        """
        stamp = F.lit(timestamp or datetime.now().astimezone().isoformat(timespec="microseconds"))
        rows = self.details()
        if rows is not None:
            append_details(rows, details, self.task, self.variable, timestamp=stamp, **identity)
        append_register(self.register_row(False, timestamp=stamp, **identity), register)


# What can be scored, and at which levels of detail.
_SCORED = {
    ("collection", None): ("fine",),
    **{("extraction", v): ("fine",) for v in (*R.ATOMIC_VARIABLES, *R.COMPOSITE_VARIABLES)},
    **{("annotation", v): ("fine",) for v in R.ANNOTATION_VARIABLES},
    ("annotation", "career_position"): R.GRANULARITIES,
}


def _check_request(task: str, variable: str | None, granularity: str) -> None:
    asked = (task, None if task == "collection" else variable)
    if asked not in _SCORED:
        names = [v for t, v in _SCORED if t == task]
        if not names:
            raise ValueError(f"no task {task!r}; there are {sorted({t for t, _ in _SCORED})}")
        what = "no variable given" if variable is None else f"Unknown {task} variable {variable!r}"
        raise ValueError(f"{what}; {task} scores one of {sorted(names)}")
    if granularity not in _SCORED[asked]:
        raise ValueError(f"no granularity {granularity!r} for {task} {variable or ''}; "
                         f"there is {' and '.join(_SCORED[asked])}")


def _check_predictions(predictions: DataFrame, check_empty: bool) -> None:
    if not isinstance(predictions, DataFrame):
        raise TypeError(f"predictions are a Spark DataFrame, not {type(predictions).__name__}")
    _require(predictions, [R.CASE_ID])
    if check_empty and predictions.isEmpty():
        raise ValueError("predictions are empty")


def _require(df: DataFrame, columns: list[str]) -> None:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"missing required columns of predictions: {absent}; they have {df.columns}")


def _tagged(summary: DataFrame, task: str, variable: str | None, **extra) -> DataFrame:
    return summary.select(
        F.lit(task).alias("task"), F.lit(variable).cast("string").alias("variable"), "*",
        *[F.lit(v).alias(k) for k, v in extra.items()])


def evaluate(predictions: DataFrame, task: str, variable: str | None = None, *,
             gold: DataFrame, silver: DataFrame | None = None, granularity: str = "fine",
             tolerance_years: int | None = None, label_vectors: DataFrame | None = None,
             order: str | None = None, check_empty: bool = True,
             report: C.DropReport | None = None) -> Evaluation:
    """Align predictions to the test side of ``gold`` and score them.

    predictions: (case_id, retrieved_urls), (case_id, <variable>) or
    (case_id, spell_index, predicted_code). ``gold`` and ``silver`` are cleaned
    tables. ``order`` names a column that says which of several predictions for
    one case is the last; without it different predictions for a case stop the job.
    ``report`` counts the predictions that later ones replace and, for annotations,
    those of cases outside the test side. ``label_vectors`` (label, vector) adds the
    mean similarity of predicted and gold labels.
    """
    _check_request(task, variable, granularity)
    _check_predictions(predictions, check_empty)
    if task == "collection":
        return _collection(predictions, apply_split(gold, "test"), order, report)
    if task == "extraction":
        test = apply_split(gold, "test")
        if variable in R.ATOMIC_VARIABLES:
            return _atomic(predictions, test, variable, order, report)
        return _composite(predictions, test, variable, tolerance_years, order, report)
    return _annotation(predictions, gold, silver, variable, granularity, label_vectors, report)


def _collection(predictions: DataFrame, test: DataFrame, order: str | None,
                report: C.DropReport | None) -> Evaluation:
    _require(predictions, [R.URLS_RETRIEVED])
    found = atomic.last_rows(predictions, R.CASE_ID, [R.URLS_RETRIEVED], order, report)
    per_case = sets.score_arrays(found, test)
    return Evaluation("collection", None, _tagged(sets.macro(per_case), "collection", None),
                      per_case=per_case.filter(~F.col("skipped")).drop("skipped"))


def _composite(predictions: DataFrame, test: DataFrame, variable: str,
               tolerance: int | None, order: str | None,
               report: C.DropReport | None) -> Evaluation:
    _require(predictions, [variable])
    years = R.TOLERANCE_YEARS if tolerance is None else tolerance
    found = atomic.last_rows(predictions, R.CASE_ID, [variable], order, report)
    found = found.withColumn("predicted", predicted_spells(found, variable))
    per_case = spells.score_lists(found, gold_spell_lists(test), tolerance=years)
    summary = _tagged(sets.macro(per_case), "extraction", variable, tolerance_years=years)
    return Evaluation("extraction", variable, summary,
                      per_case=per_case.filter(~F.col("skipped")).drop("skipped"))


def atomic_values(variable: str, value: Column) -> Column:
    """What is compared for a variable: degrees by their leading digits."""
    return T.degree_prefix(value) if variable in R.DEGREE_PREFIX_VARIABLES else value


def _atomic(predictions: DataFrame, test: DataFrame, variable: str, order: str | None,
            report: C.DropReport | None) -> Evaluation:
    _require(predictions, [variable])
    aligned = atomic.align(test, predictions, variable, order=order, report=report)
    if R.ATOMIC_VARIABLES[variable] == "int":
        levels = atomic.mean_error(aligned, "slice").withColumn(
            "_aligned", F.col("n_total") + F.col("n_skipped"))
        group_scores = ["accuracy", "mae"]
    else:
        aligned = aligned.withColumns({
            c: atomic_values(variable, F.col(c)) for c in ("gold", "pred")})
        levels = atomic.accuracy(aligned, "slice").withColumns(
            {"n_skipped": F.lit(0), "_aligned": F.col("n_total")})
        if variable in R.SIMILARITY_HEADLINE_VARIABLES:
            levels = atomic.similarity_as_headline(levels)
        group_scores = ["accuracy"]
    overall = levels.filter(F.col("level") == OVERALL)
    summary = overall.withColumn("n_skipped", F.col("n_skipped") + F.col("n_missing")).drop(
        "level", "slice", "_aligned").withColumnRenamed("n_total", "n_evaluated")
    per_country = levels.filter((F.col("level") == GROUP) & (F.col("_aligned") > 0)).select(
        F.col("slice").alias("country"), *group_scores, F.col("n_total").alias("n_evaluated"))
    return Evaluation("extraction", variable, _tagged(summary, "extraction", variable),
                      per_country=per_country)


def _annotation(predictions: DataFrame, gold: DataFrame, silver: DataFrame | None, variable: str,
                granularity: str, label_vectors: DataFrame | None,
                report: C.DropReport | None) -> Evaluation:
    spec = C.annotation_spec(variable)
    indexed = [R.SPELL_INDEX] if spec.indexed else []
    _require(predictions, [*indexed, R.PREDICTED_CODE])
    if silver is None:
        raise ValueError("a silver table is required for task='annotation'.")
    if spec.input_col not in silver.columns:
        raise ValueError(f"column '{spec.input_col}' not found; available: {silver.columns}")
    # The split table already holds the country and restricts both other sides.
    test = split_sides(gold).filter(F.col("split") == "test")
    codes = silver.filter(C.has_text(spec.input_col))
    aligned = classification.align(
        predictions, codes, test, spec.gold_col, spec.indexed, group=R.COUNTRY, report=report)
    collapse = {("career_position", "broad"): T.sector, ("uni_subject", "fine"): T.numeric_prefix}
    if (variable, granularity) in collapse:
        shorten = collapse[variable, granularity]
        aligned = aligned.withColumns({c: shorten(F.col(c)) for c in ("gold", "pred")})
    counts = classification.confusion(aligned, "slice")
    summary = classification.summary(counts).drop("level", "slice").withColumnRenamed(
        "n_total", "n_evaluated")
    summary = summary.withColumn("semantic_similarity", (
        classification.semantic_similarity(counts, label_vectors).scalar()
        if label_vectors is not None else F.lit(None).cast("double")))
    per_country = classification.summary(counts, by_group=True).filter(
        F.col("level") == GROUP
    ).select(F.col("slice").alias("country"), "accuracy", "macro_f1", "weighted_f1",
             F.col("n_total").alias("n_evaluated"))
    return Evaluation(
        "annotation", variable, _tagged(summary, "annotation", variable, granularity=granularity),
        per_class=classification.per_class(counts), per_country=per_country)


def evaluate_many(predictions: DataFrame, gold: DataFrame, variables: list[str],
                  by_country: bool = False, order: str | None = None,
                  report: C.DropReport | None = None) -> DataFrame:
    """All atomic variables in one job: one row per variable (and country).

    Cases meet their last prediction, all variables at once, in one join; then both
    sides become (case, variable, value) rows. ``order`` and ``report`` as for ``evaluate``.
    """
    unknown = sorted(set(variables) - set(R.ATOMIC_VARIABLES))
    if unknown:
        raise ValueError(f"not atomic: {unknown}")
    _require(predictions, [R.CASE_ID, *variables])
    test = apply_split(gold, "test")
    country = F.coalesce(F.nullif(F.col(R.COUNTRY), F.lit("")), F.lit(R.UNKNOWN_COUNTRY))
    found = atomic.last_rows(predictions, R.CASE_ID, variables, order, report).select(
        R.CASE_ID, F.lit(True).alias("has_pred"),
        F.struct(*[F.col(v).cast("string").alias(v) for v in variables]).alias("_pred"))
    cases = test.select(
        F.col(R.CASE_ID).cast("string").alias(R.CASE_ID), country.alias("country"),
        F.struct(*[F.col(v).cast("string").alias(v) for v in variables]).alias("_gold"))
    aligned = cases.join(found, R.CASE_ID, "left").select(
        "country", F.coalesce("has_pred", F.lit(False)).alias("has_pred"),
        F.inline(F.array(*[F.struct(
            F.lit(v).alias("variable"), F.col(f"_gold.{v}").alias("gold"),
            F.col(f"_pred.{v}").alias("pred")) for v in variables])))
    by_degree = F.col("variable").isin(*R.DEGREE_PREFIX_VARIABLES)
    aligned = aligned.withColumns({
        c: F.when(by_degree, T.degree_prefix(F.col(c))).otherwise(F.col(c))
        for c in ("gold", "pred")})
    part = F.concat_ws("\x1f", "variable", "country") if by_country else F.col("variable")
    aligned = aligned.withColumn("slice", part)
    pieces = F.split("slice", "\x1f")
    variable, judged = pieces[0], pieces[0].isin(*R.SIMILARITY_HEADLINE_VARIABLES)
    is_number = variable.isin(*[v for v, kind in R.ATOMIC_VARIABLES.items() if kind == "int"])
    # Numbers and texts come from the same counts of value pairs; only judged ones pay for similarity.
    wanted = judged if set(variables) & set(R.SIMILARITY_HEADLINE_VARIABLES) else False
    scores = atomic.accuracy(aligned, "slice", similarity=wanted, errors=True)
    names = [variable.alias("variable")] + ([pieces[1].alias("country")] if by_country else [])

    def pick(number: str | None, similar: str, other: str) -> Column:
        found = F.when(judged, F.col(similar)).otherwise(F.col(other))
        return F.when(is_number, F.col(number) if number else F.lit(None)).otherwise(found)

    n_total = F.col("n_total") + F.col("n_missing")
    return scores.filter(F.col("level") == GROUP).select(
        *names, pick("exact", "char_similarity", "accuracy").alias("accuracy"),
        pick(None, "char_similarity_when_predicted", "accuracy_when_predicted").alias(
            "accuracy_when_predicted"),
        F.when(is_number, F.col("mae")).alias("mae"),
        F.when(is_number, F.col("n_with_error")).otherwise(F.col("n_total")).alias("n_evaluated"),
        F.when(is_number, n_total - F.col("n_with_error")).otherwise(F.col("n_missing")).alias("n_skipped"))
