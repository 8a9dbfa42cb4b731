"""The registered queries against DuckDB on the smallest driver tables."""

from __future__ import annotations

import math
import re
from datetime import date
from difflib import SequenceMatcher
from pathlib import Path

import pytest

from catalog import ORACLES, QUERIES
from catalog.base import BASE_TABLES, derived, gold_of
from plumbline import evaluate_many, registry as R
from plumbline.operators.splits import apply_split

SF = "/root/testdata/sf0.001"
NO_SQL_FORM: set[str] = set()
SAMPLE = [
    "document_quality_scores", "stratified_split", "duplicated_case_drop", "set_scores_from_rows",
    "interval_match_from_rows", "nearest_examples", "resolve_codes_fine", "reconcile_failures",
    "evaluate_annotation_fine", "best_runs", "evaluate_many_fields", "first_case_in_source_order",
]


def test_every_query_has_sql_unless_none_exists():
    assert set(QUERIES) - set(ORACLES) == NO_SQL_FORM
    assert set(ORACLES) <= set(QUERIES)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert got == want


def test_year_without_a_slot_fails(spark, tmp_path):
    orders = "o_custkey long, o_orderdate date, o_orderpriority string, o_orderstatus string"
    rows = [(1, date(1995, 3, 1), "1-URGENT", "F"), (1, date(2001, 3, 1), "2-HIGH", "O")]
    inside, outside = tmp_path / "inside", tmp_path / "outside"
    spark.createDataFrame(rows, orders).write.parquet(f"{inside}/orders.parquet")
    spark.createDataFrame([*rows, (1, date(2003, 3, 1), "2-HIGH", "O")], orders).write.parquet(
        f"{outside}/orders.parquet")
    wide = derived(spark, str(inside), "wide_spells").first()
    assert (wide.s1, wide.s7) == ("1995", "2001")
    with pytest.raises(Exception, match="spell outside the years 1995 to 2001: 2003"):
        derived(spark, str(outside), "wide_spells").collect()


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_pivots_over_all_values(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, t, row, column, width in (
            ("pivot_mean_all_types", "part", "p_brand", "p_type", 1),
            ("pivot_metrics_all_segments", "customer", "c_nationkey", "c_mktsegment", 2)):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        df = QUERIES[name](spark, SF)
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr) == sorted(
            (tuple(map(plain, r)) for r in cursor.fetchall()), key=repr)
        values = [v for v, in con.execute(f"select distinct {column} from {t}").fetchall()]
        assert len(names) == 1 + width * len(values)
        assert df.count() == con.execute(f"select count(distinct {row}) from {t}").fetchone()[0]


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_all_seven_fields_equal_brute_force(spark):
    fields = list(R.ATOMIC_VARIABLES)
    assert len(fields) == 7
    predictions, gold = derived(spark, SF, "field_predictions"), gold_of(spark, SF)
    got = {r.variable: r for r in evaluate_many(predictions, gold, fields).collect()}
    found: dict = {}
    for r in predictions.collect():
        found.setdefault(r.case_id, []).append(r)
    test = apply_split(gold, "test").collect()

    def normal(v):
        v = "" if v is None else str(v).strip().lower()
        return None if v in R.NA_VARIANTS else v

    def bare(v):
        v = re.sub(r"['\-.,/\"]", "", re.sub(r"\(.*?\)", "", str(v).lower()))
        return re.sub(r"\s+", " ", v).strip()

    def alike(a, b):
        a, b = bare(a), bare(b)
        return 1.0 if a == b else SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    def degree(v):
        lead = re.match(r"\s*(\d+)", v or "")
        return lead[1] if lead else v

    def share(part, whole):
        return round(part / whole, 6) if whole else None

    for field in fields:
        pairs = [(g[field], max((p[field] for p in found[g.case_id] if p[field] is not None), default=None))
                 for g in test if g.case_id in found]
        if field == "edu_degree":
            pairs = [(degree(g), degree(p)) for g, p in pairs]
        whole = [(g, p) for g, p in pairs if normal(g) and normal(p)]
        predicted = [p for _, p in pairs if normal(p)]
        if R.ATOMIC_VARIABLES[field] == "int":
            errors = [abs(float(p) - float(g)) for g, p in whole]
            want = (share(errors.count(0), len(errors)), None, share(sum(errors), len(errors)),
                    len(errors), len(test) - len(errors))
        else:
            equal = sum(normal(g) == normal(p) for g, p in pairs)
            hits, of = equal, len(pairs)
            named = sum(normal(g) == normal(p) for g, p in whole)
            if field in R.SIMILARITY_HEADLINE_VARIABLES:
                hits = named = sum(alike(p, g) for g, p in whole)
                of = len(whole)
            want = (share(hits, of), share(named, len(predicted)), None, len(pairs), len(test) - len(pairs))
        r = got[field]
        assert (r.accuracy, r.accuracy_when_predicted, r.mae, r.n_evaluated, r.n_skipped) == pytest.approx(
            want, abs=2e-6), field
