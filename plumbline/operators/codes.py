"""Free model text to a code of a vocabulary.

Each rule is a chain of equi-joins on the distinct texts. A substring test
needs some key to join on: a text that contains another contains all of its short
substrings. Each text that may be contained is indexed under the one of them
that the fewest containing texts have, so a beginning that all share, such as
"ministry of", brings no rows together; then the full test decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.text import strip

_GRAM = 3


def unquoted(text: Column) -> Column:
    """Trimmed, then freed of quotes around it."""
    return F.btrim(strip(text), F.lit("\"'"))


def _pieces(text: Column, n: int) -> Column:
    """Substrings of ``n`` characters."""
    return F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)),
        lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _grams(text: Column) -> Column:
    """Distinct substrings of 1 to 3 characters."""
    return F.array_distinct(F.concat(*[_pieces(text, n) for n in range(1, _GRAM + 1)]))


def _keys(text: Column) -> Column:
    """Distinct substrings of 3 characters; a shorter text itself."""
    return F.when(F.length(text) < _GRAM, F.array(text)).otherwise(
        F.array_distinct(_pieces(text, _GRAM)))


def containing(holders: DataFrame, holder: str, parts: DataFrame, part: str) -> DataFrame:
    """Pairs of rows whose ``holder`` may contain ``part``: it has the rarest substring of it.

    How many holders have a substring is counted once. A part with a substring that no holder has
    is in none of them and drops out. Neither text may be null or empty; a holder has one row.
    """
    exploded = holders.withColumn("_k", F.explode(_grams(F.col(holder))))
    spread = exploded.groupBy("_k").agg(F.count(F.lit(1)).alias("_df"))
    needed = parts.select(part).distinct().select(
        part, F.size(_keys(F.col(part))).alias("_n"), F.explode(_keys(F.col(part))).alias("_k"))
    rarest = needed.join(spread, "_k").groupBy(part, "_n").agg(
        F.min_by("_k", F.struct("_df", "_k")).alias("_k"), F.count(F.lit(1)).alias("_found"))
    index = rarest.filter(F.col("_n") == F.col("_found")).select(part, "_k")
    return exploded.join(index, "_k").join(parts, part).drop("_k")


def _hit(df: DataFrame, stage: int, rank: Column, code: Column) -> DataFrame:
    return df.select("_t", F.lit(stage).alias("_stage"), rank.alias("_rank"), code.alias("_code"))


def _exact(texts: DataFrame, codes: DataFrame) -> DataFrame:
    return _hit(texts.join(codes, F.col("_t") == F.col("_c")), 1, F.col("_c"), F.col("_c"))


def _by_description(texts: DataFrame, codes: DataFrame, description: Column,
                    stage: int) -> DataFrame:
    """First code whose description contains the text or is contained in it."""
    low = texts.withColumn("_low", F.lower("_t")).filter(F.col("_low") != "")
    described = codes.withColumn("_d", F.lower(description))
    known = described.filter(F.col("_d") != "")
    inside_text = containing(low, "_low", known, "_d").filter(F.col("_low").contains(F.col("_d")))
    inside_description = containing(known.select("_d").distinct(), "_d", low, "_low").filter(
        F.col("_d").contains(F.col("_low"))).join(known, "_d")
    # The empty text is in every description, an empty description in every text.
    first_any = codes.agg(F.min("_c")).scalar()
    first_blank = described.filter(F.col("_d") == "").agg(F.min("_c")).scalar()
    empty_text = texts.filter(F.col("_t") == "").withColumn("_c", first_any)
    any_text = texts.filter(first_blank.isNotNull()).withColumn("_c", first_blank)
    return reduce(DataFrame.unionByName, [
        _hit(part, stage, F.col("_c"), F.col("_c"))
        for part in (inside_text, inside_description, empty_text, any_text)
    ]).filter("_code is not null")


def _tail(code: Column, separator: str) -> Column:
    """What follows the first separator; the whole code without one."""
    parts = F.split(code, separator, 2)
    return F.when(F.size(parts) > 1, parts[1]).otherwise(code)


def _fine(texts: DataFrame, codes: DataFrame) -> DataFrame:
    numbered = codes.filter(F.col("_c").contains(" = ")).withColumn(
        "_num", strip(F.split("_c", " = ", 2)[0]))
    # Codes sharing a number: the number ranks by its first code, and its
    # last code is the answer.
    numbers = numbered.groupBy("_num").agg(F.min("_c").alias("_first"), F.max("_c").alias("_last"))
    words = r"(?U)\w+"
    keyed = numbers.withColumn("_w", F.regexp_extract("_num", words, 0))
    spoken = texts.withColumn(
        "_w", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(words), 0))))
    whole = F.concat(F.lit(r"(?U)\b\Q"), F.col("_num"), F.lit(r"\E\b"))
    by_number = spoken.join(keyed, "_w").filter(F.rlike("_t", whole))
    return reduce(DataFrame.unionByName, [
        _exact(texts, codes),
        _hit(by_number, 2, F.col("_first"), F.col("_last")),
        _by_description(texts, codes, _tail(F.col("_c"), " = "), 3),
    ])


def _sector_prefix(texts: DataFrame, codes: DataFrame) -> DataFrame:
    starts = (
        texts.withColumn("_k", F.substring("_t", 1, 1))
        .join(codes.withColumn("_k", F.substring("_c", 1, 1)), "_k")
        .filter(F.col("_t").startswith(F.col("_c")))
    )
    return _exact(texts, codes).unionByName(_hit(starts, 2, F.col("_c"), F.col("_c")))


def _sector_number(texts: DataFrame, codes: DataFrame) -> DataFrame:
    number = F.regexp_extract("_t", r"(?U)\b(\d+)\b", 1)
    found = texts.withColumn("_n", number).join(codes, F.col("_n") == F.col("_c"))
    return _exact(texts, codes).unionByName(_hit(found, 2, F.col("_c"), F.col("_c")))


def _subject(texts: DataFrame, codes: DataFrame) -> DataFrame:
    def lead(text: str) -> Column:
        return F.regexp_extract(text, r"^(\d+)", 1)

    # Codes sharing their digits: the last one stands for them.
    numbers = codes.withColumn("_num", lead("_c")).filter("_num <> ''").groupBy("_num").agg(
        F.max("_c").alias("_c"))
    by_number = texts.withColumn("_num", lead("_t")).join(numbers, "_num")
    return reduce(DataFrame.unionByName, [
        _exact(texts, codes),
        _hit(by_number, 2, F.col("_c"), F.col("_c")),
        _by_description(texts, codes, _tail(F.col("_c"), "\\s*[–=]\\s*"), 3),
    ])


# rule name: (how the text is cleaned, stages after which the raw text stays)
_RULES = {
    "fine": (unquoted, _fine),
    "sector_prefix": (strip, _sector_prefix),
    "sector_number": (unquoted, _sector_number),
    "subject": (unquoted, _subject),
}


def resolve_codes(df: DataFrame, text: str, vocabulary: DataFrame, rule: str,
                  label: str = "label", name: str = "predicted_code") -> DataFrame:
    """Add ``name``: the code ``text`` stands for, or the cleaned text itself.

    ``vocabulary`` has one code per row in ``label``; where several codes
    fit, the earliest stage and then the first code in text order wins.
    """
    if rule not in _RULES:
        raise ValueError(f"unknown rule '{rule}'; valid: {sorted(_RULES)}")
    clean, stages = _RULES[rule]
    cleaned = df.withColumn("_t", clean(F.coalesce(F.col(text), F.lit(""))))
    texts = cleaned.select("_t").distinct()
    codes = vocabulary.select(F.col(label).alias("_c")).filter("_c is not null").distinct()
    best = stages(texts, codes).groupBy("_t").agg(
        F.min_by("_code", F.struct("_stage", "_rank")).alias("_best"))
    return (
        cleaned.join(best, "_t", "left")
        .withColumn(name, F.coalesce("_best", "_t")).drop("_t", "_best")
    )
