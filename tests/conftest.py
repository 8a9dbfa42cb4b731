from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("plumbline-tests", "local[4]", {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def gold(spark):
    """A synthetic cleaned gold table of 60 cases in four countries and one lone case."""
    from plumbline.sources.tables import clean_gold

    rows, names = [], [
        "case_id", "name_first", "name_last", "job_title", "country_label", "missing_type",
        "cv_links", "cv_local", "cv_english", "birth_year", "birth_place", "birth_country", "sex",
        "edu_start", "edu_end", "edu_degree",
        "career_position_1", "career_start_year_1", "career_end_year_1",
        "career_position_2", "career_start_year_2", "career_end_year_2",
        "uni_subject_1", "uni_name_1", "uni_subject_2", "uni_name_2",
    ]
    for i in range(61):
        country = "LONE" if i == 60 else ("BEL", "DEU", "FRA", "POL")[i % 4]
        rows.append((
            f"p{i:03d}", "First", f"Last{i}", "Minister", country, "",
            f"http://a/{i} | http://b/{i}", f"CV text {i}", f"CV text {i}",
            str(1940 + i), f"Town {i}", "17 = Belgium", "0 = male" if i % 2 else "1 = female",
            str(1960 + i % 20), str(1964 + i % 20), "7 = Master's or equivalent",
            "105 = Minister", str(1990 + i % 10), str(1995 + i % 10),
            "401 = Parliament" if i % 3 else "", "2001" if i % 3 else "", "",
            "03 – Social sciences", "KU", "04 – Law" if i % 2 else "", "",
        ))
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    return clean_gold(df).cache()


@pytest.fixture(scope="session")
def silver(spark, gold):
    """Silver rows made from the gold slots."""
    from pyspark.sql import functions as F

    from plumbline.operators.reshape import career_spells
    from plumbline.sources.tables import clean_silver

    career = career_spells(gold).select(
        "case_id", F.col("spell_index").cast("string"), "career_position",
        F.lower(F.split("career_position", " = ")[1]).alias("job_description_label"),
        F.lit("Office").alias("workplace_label"), F.lit("").alias("uni_subject"),
        F.lit("").alias("subject_label"))
    education = gold.select(F.col("case_id"), F.explode(F.array(
        F.struct(F.lit("1").alias("i"), F.col("uni_subject_1").alias("u")),
        F.struct(F.lit("2").alias("i"), F.col("uni_subject_2").alias("u")))).alias("s")).filter(
            "s.u <> ''").select(
        "case_id", F.col("s.i").alias("spell_index"), F.lit("").alias("career_position"),
        F.lit("").alias("job_description_label"), F.lit("").alias("workplace_label"),
        F.col("s.u").alias("uni_subject"), F.lower("s.u").alias("subject_label"))
    return clean_silver(career.unionByName(education)).cache()


@pytest.fixture(scope="session")
def test_cases(gold):
    from plumbline.operators.splits import apply_split

    return apply_split(gold, "test").cache()
