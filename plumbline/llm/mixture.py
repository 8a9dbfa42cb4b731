"""Operator 10: mixing sources to target weights, with DataFrame functions only.

Weights sit on a tree of domain, language and source. A token budget is shared among domains,
then languages, then sources, in proportion to weights and up to what a node can supply in
``max_epochs`` passes. What a leaf cannot supply goes to its siblings first; only what a whole
subtree cannot supply goes to the siblings of its root. Each leaf is read in whole epochs and
then in the prefix, within its budget, of one more epoch in the seeded order of that epoch.

Edge cases: null languages and sources form the leaf of the empty name; a null text has no
words; rows that share an id share their place in each order and are taken or left together;
nodes without a weight count 1; documents without words cost nothing and follow their place; an
empty table gives no row. All columns of the input are kept, but for those that begin with
``_mix_`` or have a name that the result adds. Weights are positive integers; weights times tokens
must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
LEAF = ["_mix_domain", "_mix_lang", "_mix_source"]
BROADCAST_LEAVES = 50_000
_SLICE = 3      # hexadecimal digits of a place that name a slice


@dataclass(frozen=True)
class Targets:
    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    budget_percent: int = 80        # of the tokens of one epoch of everything
    max_epochs: int = 2
    seed: str = "mix-1"


def _weight(name: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(known[name], F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each node its share of its parent's ``_mix_budget`` as ``_mix_share``.

    Nodes are ordered by supply over weight. The first ones that can be exhausted are; the rest
    divide what is left by weight. ``nodes`` holds _mix_weight and _mix_cap. One parent's children
    share a window: they are names in a tree, not documents.
    """
    order = Window.partitionBy(*parent).orderBy(
        F.col("_mix_cap").cast("double") / F.col("_mix_weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    rest = F.col("_mix_budget") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0))
    ranked = nodes.withColumns({"_mix_rest": rest, "_mix_left": F.sum("_mix_weight").over(after),
                                "_mix_rank": F.row_number().over(order)})
    full = F.col("_mix_cap") * F.col("_mix_left") <= F.col("_mix_weight") * F.col("_mix_rest")
    ranked = ranked.withColumn("_mix_full", full)
    first = F.min(F.when(~F.col("_mix_full"), F.struct("_mix_rank", "_mix_rest", "_mix_left")))
    ranked = ranked.withColumn("_mix_first", first.over(whole))
    share = F.when(F.col("_mix_full"), F.col("_mix_cap")).otherwise(
        F.expr("_mix_weight * _mix_first._mix_rest div _mix_first._mix_left"))
    return ranked.withColumn("_mix_share", share).drop(
        "_mix_rest", "_mix_left", "_mix_rank", "_mix_full", "_mix_first")


def leaf_budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """Leaves with _mix_supply become leaves with _mix_epochs and _mix_rest (whole and part)."""
    spent = leaves.withColumn("_mix_cap", F.col("_mix_supply") * targets.max_epochs)
    levels = [(LEAF[:1], targets.domains), (LEAF[:2], targets.languages), (LEAF, targets.sources)]
    total = spent.agg(F.sum("_mix_supply").alias("s"), F.sum("_mix_cap").alias("c")).select(
        F.least(F.expr(f"s * {targets.budget_percent} div 100"), "c").alias("_mix_budget"))
    above, parent = total, []
    for path, weights in levels:
        nodes = spent.groupBy(*path).agg(F.sum("_mix_cap").alias("_mix_cap")).withColumn(
            "_mix_weight", _weight(F.col(path[-1]), weights))
        # The root is one row; other levels join on the parent's path.
        joined = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))
        shared = share_out(joined, parent, path[-1])
        above = shared.select(*path, F.col("_mix_share").alias("_mix_budget"))
        parent = path
    supply = F.col("_mix_supply")
    epochs = F.when(supply > 0, F.expr("_mix_budget div _mix_supply")).otherwise(0)
    return leaves.join(above, LEAF).withColumn("_mix_epochs", epochs).withColumn(
        "_mix_rest", F.col("_mix_budget") - F.col("_mix_epochs") * supply)


ADDED = ("mix_domain", "mix_tokens", "mix_epoch")


def _place(seed: str) -> Column:
    """The place of a document in the order of the epoch that its leaf reads in part."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col("_mix_epochs"),
                             F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def prefix_ends(rows: DataFrame, seed: str, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The last place of each leaf that its budget still covers.

    ``near`` broadcasts a table of one row per leaf where leaves are few enough.

    Slices of places are summed with map-side combine; running sums over slices name the slice
    in which the budget ends, and only its rows are ordered one by one.
    """
    placed = rows.withColumn("_mix_place", _place(seed)).withColumn(
        "_mix_slice", F.substring("_mix_place", 1, _SLICE))
    run = Window.partitionBy(*LEAF).orderBy("_mix_slice")
    slices = placed.groupBy(*LEAF, "_mix_slice").agg(
        F.sum("_mix_tokens").alias("_mix_size"), F.first("_mix_rest").alias("_mix_rest"))
    ends = (slices.withColumn("_mix_sum", F.sum("_mix_size").over(run))
            .filter("_mix_sum > _mix_rest")
            .groupBy(*LEAF).agg(F.min(F.struct(
                "_mix_slice", (F.col("_mix_sum") - F.col("_mix_size")).alias("_mix_before")))
                .alias("_mix_end"))
            .select(*LEAF, "_mix_end.*"))
    step = Window.partitionBy(*LEAF).orderBy("_mix_place")
    last = (placed.join(near(ends), [*LEAF, "_mix_slice"])
            .groupBy(*LEAF, "_mix_place").agg(
                F.sum("_mix_tokens").alias("_mix_size"), F.first("_mix_rest").alias("_mix_rest"),
                F.first("_mix_before").alias("_mix_before"))
            .withColumn("_mix_sum", F.col("_mix_before") + F.sum("_mix_size").over(step))
            .filter("_mix_sum <= _mix_rest")
            .groupBy(*LEAF).agg(F.max("_mix_place").alias("_mix_last")))
    # No end: the whole epoch fits. An end without a place: nothing of its slice fits.
    return ends.join(last, LEAF, "left").select(
        *LEAF, F.coalesce("_mix_last", "_mix_slice").alias("_mix_last"))


def mix_sources(docs: DataFrame, domain: Column, targets: Targets = Targets()) -> DataFrame:
    """The rows of ``docs`` that the targets select, once per epoch, with domain, tokens, epoch.

    Columns of ``docs`` that have a name of the result, or begin with ``_mix_``, are left out.
    """
    docs = docs.select(*[docs[c] for c in docs.columns
                         if c not in ADDED and not c.startswith("_mix_")])
    named = docs.withColumns({
        "_mix_domain": F.coalesce(domain, F.lit("")), "_mix_lang": F.coalesce("lang", F.lit("")),
        "_mix_source": F.coalesce("source", F.lit("")),
        "_mix_tokens": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")})
    narrow = stored(named.select("doc_id", *LEAF, "_mix_tokens"), "mix-rows")
    leaves = narrow.groupBy(*LEAF).agg(F.sum("_mix_tokens").alias("_mix_supply"))
    budgets = stored(leaf_budgets(leaves, targets), "mix-leaves")
    small = budgets.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    near = F.broadcast if small else (lambda df: df)
    ends = prefix_ends(narrow.join(near(budgets.select(*LEAF, "_mix_epochs", "_mix_rest")), LEAF),
                       targets.seed, near)
    plan = stored(budgets.select(*LEAF, "_mix_epochs").join(ends, LEAF, "left"), "mix-plan")
    part = F.col("_mix_last").isNull() | (_place(targets.seed) <= F.col("_mix_last"))
    copies = F.col("_mix_epochs") + part.cast("int")
    chosen = (named.join(near(plan), LEAF).withColumn("_mix_copies", copies.cast("int"))
              .filter("_mix_copies > 0")
              .withColumn("_mix_epoch", F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1))))
    return chosen.select(*[chosen[c] for c in docs.columns], F.col("_mix_domain").alias("mix_domain"),
                         F.col("_mix_tokens").alias("mix_tokens"), F.col("_mix_epoch").alias("mix_epoch"))
