"""Mixing sources to target weights by pivotal dependent rounding of copy numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)

#: Documents that one bucket rounds, about, and buckets whose residuals one node of the tree combines.
BUCKET_ROWS, FAN_IN = 4_000, 64


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """source, rank, n, source_size and target words of each source; ``sizes`` has source, size and times.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all words by weight. No
    target exceeds ``most`` times its source's words; the excess goes to the others by weight until none exceeds. With
    sources in the order of the level at which each reaches its bound, that ends at the first whose bound is above the
    level left for it and those after it. The table has one row for each source; one task orders it.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    bound = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy("reach", "rank")
    everything = Window.partitionBy(F.lit(1))
    levels = ranked.withColumns({"weight": weight, "bound": bound}).withColumn("reach", F.col("bound") / F.col("weight"))
    levels = levels.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "spent": F.coalesce(F.sum("bound").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("total") - F.col("spent")) / F.col("left"))
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "rank", "level"))).over(everything)["level"]
    target = F.when(first.isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), first * F.col("weight")))
    return levels.select("source", "rank", "n", "source_size", target.alias("target"))


def round_pairwise(part: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractions ``part`` of items of ``size`` to 0 or 1, but for one item at most; its place, or -1.

    Two fractional items at a time exchange mass, size times fraction, until one of them is 0 or 1. The direction is
    drawn so that each fraction keeps its mean, and the sum of size times fraction is kept.
    """
    part, held = part.copy(), -1
    draws = rng.random(len(part))
    for i in range(len(part)):
        if not 0.0 < part[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, sa, sb = part[held], part[i], size[held], size[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        move = up if draws[i] * (up + down) < down else -down
        a, b = a + move / sa, b - move / sb
        part[held] = a = 0.0 if a < 1e-9 else 1.0 if a > 1 - 1e-9 else a
        part[i] = b = 0.0 if b < 1e-9 else 1.0 if b > 1 - 1e-9 else b
        held = held if 0.0 < a < 1.0 else i if 0.0 < b < 1.0 else -1
    return part, held


def settle(part: np.ndarray, size: np.ndarray, held: int) -> np.ndarray:
    """``part`` with the one open item's mass passed on to items that were left out, largest first, which then come in
    whole; what is left is less than any item that is still out, and the least of these takes it if it is nearer."""
    part, mass = part.copy(), part[held] * size[held]
    part[held] = 0.0
    out = np.flatnonzero(part == 0)
    out = out[np.argsort(-size[out], kind="stable")]
    for i in out:
        if size[i] <= mass + 1e-9:
            part[i], mass = 1.0, mass - size[i]
    still = out[part[out] == 0]
    if len(still) and 2 * mass >= size[still[-1]]:
        part[still[-1]] = 1.0
    return part


def _node(rows: pd.DataFrame, level: int, seed: int, bucket_rows: int, fan_in: int) -> pd.DataFrame:
    """One node of the reduction tree. Its rows come in an order that doesn't depend on where they were read."""
    rows = rows.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
    name = f"{seed} {level} {rows['rank'][0]} {rows['node'][0]}"
    size = rows["size"].to_numpy(float)
    part, held = round_pairwise(rows["part"].to_numpy(float), size, np.random.default_rng(xxhash.xxh3_64_intdigest(name)))
    nodes = -(-int(rows["n"][0]) // bucket_rows)
    for _ in range(level):
        nodes = -(-nodes // fan_in)
    if nodes <= 1 and held >= 0:
        part, held = settle(part, size, held), -1
    rows["part"] = part
    rows["open"] = np.arange(len(rows)) == held
    return rows


def _at(level: int, seed: int, bucket_rows: int, fan_in: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def node(rows: pd.DataFrame) -> pd.DataFrame:
        return _node(rows, level, seed, bucket_rows, fan_in)

    return node


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 1) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source, copies.

    size counts words (null text: 0). A document's mean number of copies is target / source_size; the fraction is
    rounded by pairs: in buckets of about BUCKET_ROWS documents of a source by a hash, then among the residual
    documents of FAN_IN buckets, and so on up to one residual for each source, which passes its mass on to smaller
    documents of its last node. So a source's taken words are within half a document of its target, no document is taken
    over ``most`` times, and reruns agree. Rows without words are taken 0 times; repeated rows, with a doc_id or without,
    are rounded one by one and spread over buckets; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    plan = _plan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("text_hash")), weights, share, most, seed)
    return plan.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def _plan(sizes: DataFrame, weights: Sequence[int], share: float, most: int, seed: int) -> DataFrame:
    """The rows of ``sizes`` (doc_id, source, size, any others) with source_size, target, copies and taken."""
    keys = sizes.columns
    sizes = shared.save(sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")), "mix-sizes")
    targets = shared.save(source_targets(sizes, weights, share, most).coalesce(1), "mix-targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(F.col("mean") + F.lit(1e-9))
    rows = sizes.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("mean", wanted).withColumn("whole", whole).withColumn("part", F.greatest(F.col("mean") - whole, F.lit(0.0)))
    # Equal rows go to one bucket after the other, BUCKET_ROWS at most to each.
    shares = F.ceil(F.col("times") / F.lit(BUCKET_ROWS)).cast("long")
    rows = rows.withColumn("shares", shares).withColumn("turn", F.xxhash64(F.lit(seed), *keys)).withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    buckets = F.ceil(F.col("n") / F.lit(BUCKET_ROWS)).cast("long")
    rows = rows.withColumn("node", F.pmod(F.pmod("turn", buckets) + F.col("of"), buckets))
    mine = F.floor(F.col("times") / F.col("shares")) + (F.col("of") < F.col("times") % F.col("shares")).cast("long")
    rows = rows.withColumn("each", F.explode(F.sequence(F.lit(1).cast("long"), mine))).drop("times", "shares", "of", "each")
    rounds = (F.col("size") > 0) & (F.col("part") > 1e-9)

    kept = [f for f in rows.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "open boolean"])

    def rounded(some: DataFrame, level: int) -> DataFrame:
        return shared.save(some.groupBy("rank", "node").applyInPandas(_at(level, seed, BUCKET_ROWS, FAN_IN), schema), "mix-rounded")

    done = rounded(rows.filter(rounds), 0)
    settled, level = [done.filter("NOT open").drop("open")], 0
    nodes = max(1, -(-(targets.agg(F.max("n")).first()[0] or 1) // BUCKET_ROWS))
    while nodes > 1:
        nodes, level = -(-nodes // FAN_IN), level + 1
        done = rounded(done.filter("open").drop("open").withColumn("node", F.floor(F.col("node") / F.lit(FAN_IN)).cast("long")), level)
        settled.append(done.filter("NOT open").drop("open"))
    settled.append(rows.filter(~rounds).withColumn("part", F.lit(0.0)))
    result = reduce(DataFrame.unionByName, settled)
    count = F.when(F.col("size") > 0, F.col("whole") + F.col("part").cast("long")).otherwise(F.lit(0)).cast("long")
    return result.withColumn("copies", count).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as ``copies`` takes it.

    Rows equal in doc_id, source and text share their copies evenly.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.sha2(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.col("source").cast("string"), F.lit("\0")), text), 256)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), row.alias("row"))
    taken = _plan(sizes, weights, share, most, seed).groupBy("row").agg(F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__rows")).filter("__all > 0").withColumnRenamed("row", "__row")
    turn = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    found = docs.withColumn("__row", row).join(taken, "__row").withColumn("__turn", turn)
    mine = F.floor(F.col("__all") / F.col("__rows")) + (F.col("__turn") <= F.col("__all") % F.col("__rows")).cast("long")
    found = found.withColumn("__copies", mine).filter("__copies > 0")
    return found.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
