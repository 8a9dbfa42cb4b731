"""Deterministic stratified split and sampling.

No step puts a whole stratum into one task. Rows are in the order of the md5 of
seed and id inside a stratum, and the hash prefix cuts each stratum into slices.
For a split, counts per slice decide all slices but the one in which the test
side ends; only its rows are put in order, to find the last hash of the test
side. Every row is then compared with that of its stratum. Ranks, where they are
wanted, come from the slice offsets and a sort of each slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import registry as R

_SLICE_DIGITS = 3  # 4096 slices per stratum


def seeded_hash(key: Column, seed: int = R.SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _sliced(df: DataFrame, key: str, seed: int) -> DataFrame:
    hashed = df.withColumn("_h", seeded_hash(F.col(key), seed))
    return hashed.withColumn("_slice", F.substring("_h", 1, _SLICE_DIGITS))


def _slice_sizes(sliced: DataFrame, groups: list[str]) -> DataFrame:
    """(groups…, _slice, _n, _before): rows in a slice and in the slices before it.

    At most 4096 slices of a group meet in the window.
    """
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def _ranked(sliced: DataFrame, sizes: DataFrame, groups: list[str], key: str,
            name: str) -> DataFrame:
    local = Window.partitionBy(*groups, "_slice").orderBy("_h", F.col(key))
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .join(sizes.drop("_n"), [*groups, "_slice"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_h", "_slice", "_local", "_before")
    )


def hash_rank(df: DataFrame, groups: list[str], key: str, seed: int = R.SPLIT_SEED,
              name: str = "hash_rank") -> DataFrame:
    """Exact 1-based rank by ``(hash, key)`` inside each group, added as ``name``."""
    sliced = _sliced(df, key, seed)
    return _ranked(sliced, _slice_sizes(sliced, groups), groups, key, name)


def _allocation(strata: DataFrame, test_size: float) -> DataFrame:
    """Test rows per stratum by largest remainder.

    The total test share is rounded up, the rest is the training share, and each
    stratum gets its proportional training part; parts lost to rounding go to
    the largest remainders. Strata of equal size have equal remainders, so
    the remainders are ranked per distinct size. n rows have at most sqrt(2n)
    distinct sizes, which bounds the two windows without a partition.
    """
    sizes = strata.filter("_c > 1").groupBy("_c").agg(F.count(F.lit(1)).alias("_m"))
    everything = Window.partitionBy()
    shares = (
        sizes.withColumn("_total", F.sum(F.col("_c") * F.col("_m")).over(everything))
        .withColumn("_train_total", F.col("_total") - F.ceil(F.col("_total") * F.lit(test_size)))
        # Decimal, as the product of two row counts does not fit a long.
        .withColumn("_scaled", F.expr(
            "cast(_train_total as decimal(19, 0)) * cast(_c as decimal(19, 0))"))
        .withColumn("_base", F.expr("_scaled div cast(_total as decimal(19, 0))"))
        .withColumn("_rest", F.expr("_scaled % cast(_total as decimal(19, 0))"))
    )
    by_rest = Window.orderBy(F.desc("_rest"), F.desc("_c")).rowsBetween(
        Window.unboundedPreceding, -1)
    spare = (
        shares
        .withColumn("_spare",
                    F.col("_train_total") - F.sum(F.col("_base") * F.col("_m")).over(everything))
        .withColumn("_taken", F.coalesce(F.sum("_m").over(by_rest), F.lit(0)))
        .withColumn("_extra", F.greatest(F.lit(0), F.col("_spare") - F.col("_taken")))
    )
    ranked = hash_rank(strata.filter("_c > 1"), ["_c"], "_stratum", name="_rank")
    train = F.col("_base") + F.when(F.col("_rank") <= F.col("_extra"), 1).otherwise(0)
    return (
        ranked.join(spare.select("_c", "_base", "_extra"), "_c")
        .select("_stratum", (F.col("_c") - train).alias("_n_test"))
    )


def _cutoffs(rows: DataFrame, key: str, test_size: float, seed: int) -> DataFrame:
    """(_stratum, _cut): hash and key of the last test row of each stratum that has one.

    One row per stratum. Only the slice in which the test side ends is put in order.
    """
    sliced = _sliced(rows, key, seed)
    sizes = _slice_sizes(sliced, ["_stratum"])
    strata = sizes.groupBy("_stratum").agg(F.sum("_n").alias("_c"))
    last = sizes.join(_allocation(strata, test_size), "_stratum").filter(
        (F.col("_before") < F.col("_n_test")) & (F.col("_before") + F.col("_n") >= F.col("_n_test")))
    local = Window.partitionBy("_stratum", "_slice").orderBy("_h", key)
    return (
        sliced.join(last.select("_stratum", "_slice", (F.col("_n_test") - F.col("_before")).alias("_at")),
                    ["_stratum", "_slice"])
        .withColumn("_local", F.row_number().over(local)).filter(F.col("_local") == F.col("_at"))
        .select("_stratum", F.struct("_h", F.col(key).alias("_key")).alias("_cut")))


def with_split(df: DataFrame, key: str = R.CASE_ID, stratum: str = R.COUNTRY,
               test_size: float = R.SPLIT_TEST_SIZE, seed: int = R.SPLIT_SEED,
               name: str = "split") -> DataFrame:
    """``df`` with the side of each row, 'test' or 'train', in ``name``.

    A stratum with one row goes to the training side. Rows with the same key are on
    the same side. Rows meet a table of one row per stratum and are not shuffled
    while that is small. Rows without a key are left out.
    """
    kept = df.filter(F.col(key).isNotNull())
    text = F.col(key).cast("string")
    of = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    cuts = _cutoffs(kept.select(text.alias(key), of.alias("_stratum")), key, test_size, seed)
    own = F.struct(seeded_hash(text, seed).alias("_h"), text.alias("_key"))
    side = F.when(own <= F.col("_cut"), "test").otherwise("train")
    return kept.join(cuts, of == F.col("_stratum"), "left").select(*df.columns, side.alias(name))


def split_sides(df: DataFrame, key: str = R.CASE_ID, stratum: str = R.COUNTRY,
                test_size: float = R.SPLIT_TEST_SIZE, seed: int = R.SPLIT_SEED) -> DataFrame:
    """(key, stratum, split) for every row of ``df``; split is 'test' or 'train'."""
    rows = df.select(
        F.col(key).cast("string").alias(key),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(stratum))
    return with_split(rows, key, stratum, test_size, seed)


def stratified_split(df: DataFrame, key: str = R.CASE_ID, stratum: str = R.COUNTRY,
                     test_size: float = R.SPLIT_TEST_SIZE,
                     seed: int = R.SPLIT_SEED) -> DataFrame:
    """Key and ``split`` ('test' or 'train') for every row of ``df``."""
    return split_sides(df, key, stratum, test_size, seed).select(key, "split")


def split_ids(df: DataFrame, side: str, key: str = R.CASE_ID, **kwargs) -> DataFrame:
    return stratified_split(df, key, **kwargs).filter(F.col("split") == side).select(key)


def apply_split(df: DataFrame, side: str, key: str = R.CASE_ID, **kwargs) -> DataFrame:
    """The rows of one side of the split."""
    return with_split(df, key, name="_side", **kwargs).filter(F.col("_side") == side).drop("_side")


def single_row_strata(df: DataFrame, key: str = R.CASE_ID, stratum: str = R.COUNTRY) -> DataFrame:
    """(stratum, key) of the rows that are alone in their stratum and so always train."""
    return df.filter(F.col(key).isNotNull()).groupBy(
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(stratum)).agg(
        F.min(F.col(key).cast("string")).alias(key), F.count(F.lit(1)).alias("_n")).filter(
        "_n = 1").drop("_n")


def one_per_group(df: DataFrame, group: str, key: Column, seed: int = R.SPLIT_SEED) -> DataFrame:
    """One seeded-random row per group: the row with the smallest hash of ``key``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(seeded_hash(key, seed), key)
    return df.groupBy(F.col(group).alias("_g")).agg(
        F.min_by(row, order).alias("_row")).select("_row.*")


def few_shot_pool(df: DataFrame, group: str, key: Column, n: int,
                  seed: int = R.SPLIT_SEED) -> DataFrame:
    """Up to ``n`` rows, at most one per group."""
    pool = one_per_group(df, group, key, seed)
    return pool.orderBy(seeded_hash(key, seed), key).limit(n)


def first_n(df: DataFrame, n: int, key: str = R.CASE_ID) -> DataFrame:
    return df.orderBy(key).limit(n)
