"""Register rows to comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as t

from plumbline.functions import text as T

_DETAIL_SCHEMA = {
    "per_country": "map<string,struct<accuracy:double,macro_f1:double,weighted_f1:double,"
                   "mae:double,n_evaluated:long>>",
    "per_class": "map<string,struct<precision:double,recall:double,f1:double,support:long>>",
    "per_case": "map<string,struct<precision:double,recall:double,f1:double,n_predicted:long,"
                "n_gold:long,n_matched:long>>",
}


def runs(register: DataFrame, task: str, variable: str | None = None) -> DataFrame:
    """Rows of one task with the run folder and numeric scores."""
    rows = register.filter(F.col("task") == task)
    if variable is not None:
        rows = rows.filter(F.col("variable") == variable)
    numbers = ("n_evaluated", "n_skipped", "precision", "recall", "f1", "accuracy", "mae",
               "macro_f1", "weighted_f1", "semantic_similarity")
    return rows.withColumns({
        "run": T.experiment_folder(F.col("experiment_path")),
        **{c: T.to_number(F.col(c)) for c in numbers if c in register.columns},
    })


def best_runs(rows: DataFrame, score: str, keys: tuple[str, ...] = ("run",),
              positive: bool = True, order: str = "timestamp") -> DataFrame:
    """Best row per key; equal scores go to the earliest submission.

    Rows without a score, and with ``positive`` also zero scores, are left out.
    An aggregation keeps one row per key before the shuffle.
    """
    usable = F.col(score) > 0 if positive else F.col(score).isNotNull()
    row = F.struct(*[F.col(c) for c in rows.columns])
    rank = F.struct((-F.col(score)).alias("s"), F.col(order).alias("o"),
                    F.xxhash64(*rows.columns).alias("h"))
    picked = rows.filter(usable).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.min_by(row, rank).alias("_row"))
    return picked.select("_row.*")


def board(catalogue: DataFrame, best: DataFrame, scores: list[str],
          families: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Catalogue (family, model, run) with the best scores; null where to be done."""
    found = best.select("run", *[F.round(c, digits).alias(c) for c in scores])
    table = catalogue.join(found, "run", "left").select("family", "model", "run", *scores)
    return ordered(table, families) if families else table


def family_rank(families: list[str]) -> Column:
    """1-based place of the family in the given order; families that are not listed come last."""
    place = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family"))
    return F.when(place > 0, place).otherwise(len(families) + 1)


def ordered(table: DataFrame, families: list[str]) -> DataFrame:
    """Add the family rank and sort by it and the model name."""
    return table.withColumn("family_rank", family_rank(families)).orderBy("family_rank", "model")


def side_by_side(left: DataFrame, right: DataFrame, scores: list[str],
                 names: tuple[str, str] = ("broad", "fine")) -> DataFrame:
    """Two boards joined on the model, scores suffixed."""
    a = left.select("family", "model", *[F.col(c).alias(f"{c}_{names[0]}") for c in scores])
    b = right.select("model", *[F.col(c).alias(f"{c}_{names[1]}") for c in scores])
    return a.join(b, "model")


def detail_rows(register: DataFrame, section: str, keep: list[str]) -> DataFrame:
    """One nested section of ``metrics_json`` as rows: (keep…, name, scores…).

    Malformed JSON gives no rows, and neither does a row stored without details in it:
    its details are read by ``stored_detail_rows``.
    """
    parsed = F.from_json("metrics_json", f"struct<{section}:{_DETAIL_SCHEMA[section]}>")
    return (
        register.select(*keep, F.explode(parsed[section]).alias("name", "_v"))
        .select(*keep, "name", "_v.*")
    )


def stored_detail_rows(details: DataFrame, section: str, keep: list[str]) -> DataFrame:
    """The same rows from the table of details that ``Evaluation.store`` writes.

    ``run`` may be kept beside the columns of the table.
    """
    fields = t.StructType.fromDDL(f"s {_DETAIL_SCHEMA[section]}")["s"].dataType.valueType
    rows = details.filter(F.col("section") == section).withColumn(
        "run", T.experiment_folder(F.col("experiment_path")))
    return rows.select(*keep, "name", *fields.names)


def detail_value(register: DataFrame, field: str) -> Column:
    """One top-level number of ``metrics_json``."""
    return T.to_number(F.get_json_object("metrics_json", f"$.{field}"))


def score_matrix(best: DataFrame, labels: list[str], value: str, variables: list[str]) -> DataFrame:
    """Wide table of ``value`` per run and variable, one column per variable."""
    return best.groupBy(*labels).pivot("variable", variables).agg(F.max(value))
