"""Mixing sources to target weights down a tree of domains, languages and sources.

Weights go down the tree: a node's budget is shared among its children by weight. A child that can't use its share (it
has its tokens times the greatest number of epochs) takes what it has, and its siblings share the rest by weight; only what a
whole family can't use goes to the families beside it. A leaf takes whole epochs as long as its budget lasts, then a prefix of one
more epoch. The order of an epoch is a hash of seed, epoch and doc_id, so the prefix is all rows up to a cut, and one number per leaf
decides of each row where it stands: texts are never moved.

The cut is found without putting a leaf into one task: token sums of ``SLICES`` ranges of the hash lead to the range that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batch_slices, cut, set_aside, table, text_buffer, text_or_empty, words_of

#: Leaves whose budgets are shared out on the driver and sent to the tasks; more are shared out, and joined, as tables.
MAX_LEAVES = 50_000
SLICES = 1024
SEED = 20_24
#: Weights by path; what isn't named weighs 1.
WEIGHTS = {("web0",): 4.0, ("web1",): 3.0, ("web2",): 2.0, ("web3",): 1.0} | {(f"web{d}", lang): w for d in range(4) for lang, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}
LEVELS = ("domain", "lang", "source")
SHARE = 0.8


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("_text")
        out = []
        for lo, hi in batch_slices(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), 1 << 20):
            out.append(np.diff(words_of(*text_buffer(texts.slice(lo, hi - lo)))[2]))
        counts = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())
        keep = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], names=[*keep, "tokens"])


def with_word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``tokens``, the number of words of the text (null: none), in place of the text."""
    rest = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)
    return docs.select(*rest, text_or_empty(text).alias("_text")).mapInArrow(_word_counts, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "tokens long"]))


def share_out(budget: float, weights: Sequence[float], capacities: Sequence[float]) -> list[float]:
    """Shares of a budget by weight, none above its capacity; what one can't take the others share by weight."""
    out, left, open_ = [0.0] * len(weights), float(budget), [i for i, c in enumerate(capacities) if c > 0 and weights[i] > 0]
    while open_ and left > 0:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole >= capacities[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            return out
        for i in full:
            out[i] = float(capacities[i])
        left -= sum(capacities[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def leaf_budgets(tokens: Mapping[tuple, int], weights: Mapping[tuple, float], budget: float, epochs: int) -> dict[tuple, int]:
    """Whole tokens for each leaf (a path of any depth)."""

    def down(prefix: tuple, leaves: list[tuple], amount: float) -> dict[tuple, int]:
        if len(leaves) == 1 and leaves[0] == prefix:
            return {prefix: int(amount + 1e-6)}
        children: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[: len(prefix) + 1], []).append(leaf)
        names = sorted(children, key=lambda p: tuple((x is None, x or "") for x in p))
        shares = share_out(amount, [weights.get(c, 1.0) for c in names], [epochs * sum(tokens[x] for x in children[c]) for c in names])
        return {k: v for c, s in zip(names, shares, strict=True) for k, v in down(c, children[c], s).items()}

    return down((), list(tokens), budget) if tokens else {}


def shared_budgets(totals: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float], budget: float, epochs: int) -> DataFrame:
    """What ``leaf_budgets`` says, for any number of leaves: ``totals(_leaf, *levels, tokens)`` with ``budget``. A level at a time, the children of a
    node are put in the order of capacity over weight; those before the water line are full, and the others share what is left."""
    spark = totals.sparkSession
    mix = totals.select("_leaf", "tokens", *[F.col(c).cast("string").alias(f"_l{k}") for k, c in enumerate(levels)]).withColumn("_amount", F.lit(float(budget)))
    for depth in range(len(levels)):
        path = [f"_l{k}" for k in range(depth + 1)]
        named = [(*p, float(w)) for p, w in weights.items() if len(p) == depth + 1]
        children = mix.groupBy(*path).agg((F.sum("tokens") * epochs).cast("double").alias("_capacity"), F.first("_amount").alias("_whole"))
        known = spark.createDataFrame(named, ", ".join([*(f"_w{k} string" for k in range(depth + 1)), "_weight double"]))
        same = F.lit(True)
        for k in range(depth + 1):
            same = same & F.col(f"_l{k}").eqNullSafe(F.col(f"_w{k}"))
        children = children.join(F.broadcast(known), same, "left").withColumn("_weight", F.coalesce("_weight", F.lit(1.0))).drop(*[f"_w{k}" for k in range(depth + 1)])
        family = Window.partitionBy(*path[:-1]).orderBy((F.col("_capacity") / F.col("_weight")).asc(), *path) if depth else Window.partitionBy(F.lit(0)).orderBy((F.col("_capacity") / F.col("_weight")).asc(), *path)
        open_ = (F.col("_capacity") > 0) & (F.col("_weight") > 0)
        before, after = family.rowsBetween(Window.unboundedPreceding, -1), family.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        children = children.filter(open_).withColumn("_left", F.col("_whole") - F.coalesce(F.sum("_capacity").over(before), F.lit(0.0))).withColumn("_rest", F.sum("_weight").over(after))
        line = F.when(F.col("_left") * F.col("_weight") / F.col("_rest") < F.col("_capacity"), F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_rest"))
        children = children.withColumn("_line", F.first(line, ignorenulls=True).over(family.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        share = F.least(F.col("_capacity"), F.coalesce(F.col("_line") * F.col("_weight"), F.col("_capacity")))
        shares = children.select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(path)], share.alias("_share"))
        same = F.lit(True)
        for k, c in enumerate(path):
            same = same & F.col(c).eqNullSafe(F.col(f"_s{k}"))
        mix = cut(mix.drop("_amount").join(shares, same, "left").withColumn("_amount", F.coalesce("_share", F.lit(0.0))).drop("_share", *[f"_s{k}" for k in range(depth + 1)]))
    return mix.select("_leaf", "tokens", F.floor(F.col("_amount") + 1e-6).cast("long").alias("budget"))


def _leaf(levels: Sequence[str]) -> Column:
    """A text that stands for the path; nulls are children of their own."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(str(i)) for i, c in enumerate(levels)]))


def _place(epoch: Column, key: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), F.coalesce(F.col(key).cast("string"), F.lit("\x00")))


def plan_mix(rows: DataFrame, key: str, levels: Sequence[str], weights: Mapping[tuple, float], share: float, epochs: int, seed: int = SEED, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """A row per leaf: _leaf, budget, _full (whole epochs), _cut_place and _cut_key (the last row of the epoch after them; null: none).

    ``rows`` has the key, the levels and ``tokens``; it is read several times, other columns are not. ``share``: the budget as a part of all tokens.
    No rows: no leaves.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("_id"), "tokens", _leaf(levels).alias("_leaf"), *[F.col(c).cast("string").alias(f"_level{k}") for k, c in enumerate(levels)])
    names = [f"_level{k}" for k in range(len(levels))]
    totals = cut(rows.groupBy("_leaf", *names).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")))
    many, everything = totals.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    if many <= max_leaves:
        paths = {tuple(r[c] for c in names): (r["_leaf"], int(r["tokens"])) for r in totals.collect()}
        budgets = leaf_budgets({p: n for p, (_, n) in paths.items()}, weights, share * (everything or 0), epochs)
        budget = spark.createDataFrame([(*paths[p], b) for p, b in budgets.items()], "_leaf string, tokens long, budget long")
    else:
        budget = shared_budgets(totals, names, weights, share * everything, epochs)
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(epochs))).otherwise(1).cast("int")
    budget = cut(budget.withColumn("_full", full).select("_leaf", "budget", "_full", F.when(F.col("tokens") > 0, F.col("budget") - F.col("_full") * F.col("tokens")).otherwise(0).alias("_rest")))
    few = F.broadcast if many <= max_leaves else lambda df: df
    part = rows.join(few(budget), "_leaf").filter((F.col("_rest") > 0) & (F.col("_full") < epochs))
    part = part.select("_leaf", "_rest", "tokens", F.coalesce(F.col("_id").cast("string"), F.lit("\x00")).alias("_key"), _place(F.col("_full"), "_id", seed).alias("_place"))
    part = part.withColumn("_slice", F.shiftright("_place", 64 - SLICES.bit_length() + 1))
    before = Window.partitionBy("_leaf").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("_leaf", "_slice").agg(F.sum("tokens").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = part.join(sums.select("_leaf", "_slice", "_before"), ["_leaf", "_slice"]).filter("_before <= _rest")
    upto = Window.partitionBy("_leaf", "_slice").orderBy("_place", "_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("_upto", F.col("_before") + F.sum("tokens").over(upto)).filter("_upto <= _rest").groupBy("_leaf").agg(F.max(F.struct("_place", "_key")).alias("_cut"))
    return budget.join(last, "_leaf", "left").select("_leaf", "budget", "_full", F.col("_cut._place").alias("_cut_place"), F.col("_cut._key").alias("_cut_key"))


def take_mix(docs: DataFrame, plan: DataFrame, key: str, levels: Sequence[str], seed: int = SEED, max_leaves: int = MAX_LEAVES) -> DataFrame:
    """``docs`` with ``epoch`` (from 0) and ``budget``: each row once for each epoch that takes it. The plan has a row per leaf at most.

    Columns of ``docs`` may have any name; those called epoch or budget are kept as ``epoch_input`` and ``budget_input``."""
    epoch = F.col("_full")
    rows = set_aside(docs, "epoch", "budget").select(F.struct("*").alias("_row"), _leaf(levels).alias("_leaf"), F.col(key).alias("_id"))
    place, name = _place(epoch, "_id", seed), F.coalesce(F.col("_id").cast("string"), F.lit("\x00"))
    more = F.col("_cut_place").isNotNull() & ((place < F.col("_cut_place")) | ((place == F.col("_cut_place")) & (name <= F.col("_cut_key"))))
    times = epoch + F.coalesce(more.cast("int"), F.lit(0))
    joined = rows.join(F.broadcast(plan) if plan.count() <= max_leaves else plan, "_leaf")
    taken = joined.withColumn("_times", times).filter("_times > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
    return taken.select("_row.*", F.col("_epoch").alias("epoch"), "budget")


def domain_of(source: str = "source") -> Column:
    """Our domains: sources by their number modulo 4."""
    return F.concat(F.lit("web"), F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '([0-9]{{1,9}})$', 1) AS int)") % 4, F.lit(0)).cast("string"))


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for a budget of 0.8 of all words, two epochs at most: doc_id, domain, lang, source, epoch, tokens, budget (of the leaf).

    Null and empty texts and texts of blanks have no words and are taken whenever their leaf's prefix comes by them; repeated rows with one doc_id are
    taken together; rows without a doc_id are one record; null levels are branches of their own; an empty table gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").withColumn("domain", domain_of())
    rows = cut(with_word_counts(docs))
    plan = cut(plan_mix(rows, "doc_id", LEVELS, WEIGHTS, SHARE, epochs=2))
    return take_mix(rows, plan, "doc_id", LEVELS).select("doc_id", *LEVELS, "epoch", "tokens", "budget")
