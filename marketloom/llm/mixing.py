"""Mixing sources to target weights, in DataFrame operations only.

Leaves of a domain > language > source tree get token budgets top down.  At
each node the budget is split by the children's weights; a child whose subtree
cannot use its share (supply times `max_epochs`) is filled, and its shortage
goes to its siblings by weight.  Only what a whole subtree cannot use reaches
the level above, because capacities are summed over subtrees first.  Budgets
are whole tokens and add up exactly.

A leaf with budget B and supply S takes B div S whole epochs of its documents
and a token prefix of B mod S of one more epoch, whose order is seeded by
(seed, epoch, document).  The cut is found by two histograms over the order's
leading hash digits and an exact running sum inside the one remaining bucket
(1/65,536 of a leaf), so no leaf is ever sorted in one task.  The tree's own
rows (a few numbers for each source) are split in windows over one parent each.

Null labels form a leaf of their own (named '?'); null or empty texts have no
tokens, belong to no prefix and are never copied in part; repeated rows and
null ids are taken row by row; empty input gives empty output.  Only the named columns are
read, so clashing extra columns do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import written

TREE = ("domain", "language", "source_name")
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """Integer weights by node name (others: 1), the budget as a share of all tokens, and limits."""

    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    share_percent: int = 60
    max_epochs: int = 3
    seed: int = 17


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for key, value in sorted(weights.items()):
        out = F.when(F.col(name) == key, F.lit(value)).otherwise(out)
    return out.cast("decimal(10,0)")


def fill(children: DataFrame, parent: list[str], name: str, budget: str, capacity: str, weight: Column, out: str) -> DataFrame:
    """Splits each parent's budget over its children by weight, capped by capacity.

    `children` has a row for each child, with its parent's budget.  A child is
    filled when its fair share of what the children before it (by capacity
    relative to weight) leave is at least its capacity.
    """
    order = Window.partitionBy(*parent).orderBy("_ratio", name)
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    d = lambda c: F.col(c).cast("decimal(18,0)")
    rows = children.withColumn("_w", weight).withColumn("_ratio", F.col(capacity).cast("double") / F.col("_w").cast("double"))
    rows = rows.withColumn("_before", F.coalesce(F.sum(d(capacity)).over(before), F.lit(0)).cast("decimal(18,0)")).withColumn("_rest", F.sum("_w").over(onward).cast("decimal(18,0)"))
    rows = rows.withColumn("_full", (d(budget) - F.col("_before")) * F.col("_w") >= d(capacity) * F.col("_rest"))
    rows = rows.withColumn("_left", (d(budget) - F.coalesce(F.sum(F.when(F.col("_full"), d(capacity))).over(whole), F.lit(0))).cast("decimal(18,0)"))
    loose = F.when(~F.col("_full"), F.col("_w"))
    rows = rows.withColumn("_all", F.sum(loose).over(whole).cast("decimal(18,0)")).withColumn("_until", F.sum(loose).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,0)"))
    share = F.expr("(_left * _until) div _all - (_left * (_until - _w)) div _all")
    return rows.withColumn(out, F.when(F.col("_full"), F.col(capacity)).otherwise(share).cast("bigint")).drop("_w", "_ratio", "_before", "_rest", "_full", "_left", "_all", "_until")


def leaf_budgets(leaves: DataFrame, target: Target) -> DataFrame:
    """Budgets of leaves (domain, language, source_name, supply); the tree's nodes are few."""
    capacity = F.col("supply") * target.max_epochs
    leaves = leaves.withColumn("capacity", capacity.cast("bigint"))
    languages = leaves.groupBy("domain", "language").agg(F.sum("capacity").alias("language_capacity"), F.sum("supply").alias("s"))
    domains = languages.groupBy("domain").agg(F.sum("language_capacity").alias("domain_capacity"), F.sum("s").alias("s")).withColumn("root", F.lit(0))
    tree = Window.partitionBy("root")
    domains = domains.withColumns({"all_s": F.sum("s").over(tree).cast("decimal(18,0)"), "all_c": F.sum("domain_capacity").over(tree)})
    domains = domains.withColumn("total", F.least(F.expr(f"all_s * {target.share_percent} div 100"), F.col("all_c")))
    domains = fill(domains, ["root"], "domain", "total", "domain_capacity", _weight("domain", target.domains), "domain_budget")
    languages = fill(languages.drop("s").join(domains.select("domain", "domain_budget"), "domain"), ["domain"], "language", "domain_budget", "language_capacity", _weight("language", target.languages), "language_budget")
    return fill(leaves.join(languages.select("domain", "language", "language_budget"), ["domain", "language"]), ["domain", "language"], "source_name", "language_budget", "capacity", _weight("source_name", target.sources), "budget").select(*TREE, "supply", "budget")


def _digits(at: int) -> Column:
    return F.substring("order_key", at, 2)


def _cut(rows: DataFrame, digits: Column, left: str, names: tuple[str, str]) -> DataFrame:
    """Per leaf the bucket in which the tokens left run out, and what is left there."""
    sums = rows.groupBy(*TREE, left, digits.alias("d")).agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*TREE).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = sums.withColumn("b", before).where((F.col("b") < F.col(left)) & (F.col("b") + F.col("n") >= F.col(left)))
    return hit.select(*TREE, F.col("d").alias(names[0]), (F.col(left) - F.col("b")).alias(names[1]))


def mix(docs: DataFrame, target: Target, domain: Column, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: columns to keep, leaf, n_tokens, copies (whole epochs) and cut_tokens (its part of the last, partial epoch)."""
    named = [F.coalesce(c.cast("string"), F.lit("?")).alias(n) for c, n in zip((domain, F.col(language), F.col(source)), TREE, strict=True)]
    slim = written(docs.select(F.col(key).alias("doc_id"), *keep, *named, F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens")))
    leaves = slim.groupBy(*TREE).agg(F.sum("n_tokens").alias("supply"))
    plan = leaf_budgets(leaves, target).select(*TREE, F.expr("CASE WHEN supply > 0 THEN budget div supply ELSE 0 END").alias("copies"), F.expr("CASE WHEN supply > 0 THEN budget % supply ELSE 0 END").alias("left0"))
    plan = written(plan)
    ordered = lambda p: slim.join(p, list(TREE)).withColumn("order_key", F.md5(F.concat_ws(":", F.lit(str(target.seed)), F.col("copies").cast("string"), F.col("doc_id").cast("string")).cast("binary")))
    started = ordered(plan.where("left0 > 0"))
    one = written(plan.join(_cut(started, _digits(1), "left0", ("digits1", "left1")), list(TREE), "left"))
    inner = ordered(one.where("left1 IS NOT NULL")).where(_digits(1) == F.col("digits1"))
    two = written(one.join(_cut(inner, _digits(3), "left1", ("digits2", "left2")), list(TREE), "left"))
    rows = ordered(two)
    last = (_digits(1) == F.col("digits1")) & (_digits(3) == F.col("digits2"))
    sure = F.when((_digits(1) < F.col("digits1")) | ((_digits(1) == F.col("digits1")) & (_digits(3) < F.col("digits2"))), F.col("n_tokens")).otherwise(F.lit(0))
    out = ["doc_id", *keep, *TREE, "n_tokens", "copies"]
    run = Window.partitionBy(*TREE).orderBy("order_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(last).withColumn("b", F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    edge = edge.select(*out, F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("left2") - F.col("b"))).cast("bigint").alias("cut_tokens"))
    return rows.where(~F.coalesce(last, F.lit(False))).select(*out, F.coalesce(sure, F.lit(0)).cast("bigint").alias("cut_tokens")).unionByName(edge)
