"""Mixing sources to target weights: subset sums over counts of documents by exact length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmetrics.llm.common import query, table, word_count, written


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes. A target
    above `most` times its source's size stops there; what it leaves is shared again by weight until none is
    above. That ends with target = min(most * size, level * weight) for one level, which is solved in closed
    form over the sources ordered by the level at which each is full.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    arr = F.array(*[F.lit(float(w)) for w in weights])
    ranked = total.withColumn("weight", F.get(arr, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    full = ranked.withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    levels = (
        full.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.sum("source_size").over(every) - F.col("before")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("full_at") >= F.col("level"), F.col("level"))).over(every))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], budget: int, dp_budget: int = 1 << 16) -> list[int]:
    """How many documents of each length to take for a sum near the budget, never above it.

    First the same share of every length, so the mix of lengths stays; next single documents, longest first,
    until dp_budget words or less are open; then bounded-knapsack dynamic programming fills what is open. The
    reachable sums are bits of an integer; a length with count c enters as 1, 2, 4, ... copies.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    take = [c * budget // total if n and total else 0 for n, c in zip(lengths, counts)]
    budget -= sum(n * t for n, t in zip(lengths, take))
    by_length = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in by_length:
        if budget <= dp_budget:
            break
        if lengths[i]:
            more = min(counts[i] - take[i], (budget - dp_budget // 2) // lengths[i])
            take[i] += max(0, more)
            budget -= lengths[i] * max(0, more)
    if budget <= 0:
        return take
    mask, reached, steps = (1 << (budget + 1)) - 1, 1, []
    for i in reversed(by_length):
        left, part = min(counts[i] - take[i], budget // lengths[i] if lengths[i] else 0), 1
        while left > 0 and not reached >> budget & 1:
            k = min(part, left)
            steps.append((i, k, reached))
            reached |= (reached << (k * lengths[i])) & mask
            left, part = left - k, part * 2
    at = reached.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42, salts: int = 1024, dp_budget: int = 1 << 16
) -> DataFrame:
    """docs with size, source_size, target, copies and taken = copies * size.

    Whole copies of a source come first; what its target leaves is a subset sum over the counts of documents by
    exact length, and of each length the documents with the smallest seeded hash are taken. No document is taken
    more than ceil(most) times. Null and empty texts have size 0 and are never taken. Null sources are one
    source. Equal rows are interchangeable. Own columns with the names of the results are replaced.

    A task fits one source from its (length, count) rows: as many as different lengths, not documents. Documents
    are ranked within (source, length, salt), so a source or length with a third of all rows is spread.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    docs = docs.drop(*made)
    # own columns travel in a struct, so that none meets a name of the joins
    base = docs.select(F.struct(*docs.columns).alias("_own"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("_h"))
    base = base.withColumn("_salt", F.pmod(F.shiftright("_h", 8), F.lit(salts)).cast("int"))
    narrow = written(base.groupBy("source", "size", "_salt").agg(F.count("*").alias("n")))
    targets = written(source_targets(narrow.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most).coalesce(1))
    hist = narrow.groupBy("source", "size").agg(F.sum("n").alias("n")).alias("h")
    t = targets.alias("t")
    hist = hist.join(F.broadcast(t) if targets.limit(10_001).count() <= 10_000 else t, F.col("h.source").eqNullSafe(F.col("t.source"))).select("h.*", "source_size", "target")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        whole = int(target // size) if size else 0
        rest = round(target - whole * size)
        take = fit_lengths([int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]], rest, dp_budget)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "source_size": size, "target": target, "whole": whole, "extra": take})

    plan = hist.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, whole long, extra long")
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    w = Window.partitionBy("source", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        narrow.alias("a").join(plan.alias("b"), same)
        .select("a.*", "source_size", "target", "whole", "extra")
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.coalesce(F.sum("n").over(w), F.lit(0)))))
        .select(F.struct("source", "size", "_salt").alias("_key"), "source_size", "target", "whole", "extra")
    )
    ranked = base.withColumn("_key", F.struct("source", "size", "_salt")).join(quota, "_key")
    place = F.row_number().over(Window.partitionBy("_key").orderBy("_h", "doc_id"))
    copies = F.when(F.col("size") > 0, F.col("whole") + (place <= F.col("extra")).cast("long")).otherwise(F.lit(0))
    return (
        ranked.withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("_own.*", *made)
    )


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", "text")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
