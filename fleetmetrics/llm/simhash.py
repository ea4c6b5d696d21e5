"""SimHash near-duplicates: pigeonhole blocks of fingerprints, joined and verified by Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm.common import drop_written, query, sliced, spread, table, written
from fleetmetrics.llm.components import components

BITS = 64
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def text_fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the word shingles of a text, repeats included; no word gives 0.

    bytes.lower and bytes.split have just the rules that are wanted: A-Z, and white space U+0009-U+000D and U+0020.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = [e + i for i, e in enumerate(accumulate(map(len, parts)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words - 1 :] if len(parts) >= words else [len(joined)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + CHUNK], last[i : i + CHUNK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                fp = [text_fingerprint(t.as_py(), words, seed) for t in part.column("text")]
                yield pa.record_batch([part.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_plan(distinct: int, most: int) -> list[list[tuple[int, int]]]:
    """For each key the (first bit, bits) blocks that make it.

    With b blocks and at most `most` differing bits, b - most blocks are equal, so two close fingerprints share
    one of the C(b, most) keys for every b. b is the least whose keys have 2 bits more than the count needs: then
    chance brings few fingerprints together, and pairs grow as the count does.
    """
    need = math.log2(max(2, distinct)) + 2
    for b in range(most + 1, most + 6):
        cuts = [round(i * BITS / b) for i in range(b + 1)]
        blocks = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(b)]
        if (b - most) * (BITS // b) >= need:
            break
    return [list(c) for c in combinations(blocks, b - most)]


def _keys(fp: Column, plan: list[list[tuple[int, int]]]) -> Column:
    """Array of a long per key: the blocks' bits, with the key's number mixed in by a hash-free multiply-add."""
    out = []
    for k, blocks in enumerate(plan):
        mask = 0
        for first, n in blocks:
            mask |= ((1 << n) - 1) << first
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(k).cast("int").alias("k"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*out)


def _near(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def fingerprint_components(fps: DataFrame, most: int = 4, pair_limit: int = 64) -> DataFrame:
    """(fp, component) of distinct fingerprints that have a link, a link being at most `most` differing bits.

    1. Fingerprints meet in buckets of pigeonhole keys. In each bucket all are compared with a few pivots of it
       (least, largest and two by hash), which are aggregates, so a bucket of any size costs its own rows.
    2. Buckets of four or more that these links leave in several components are looked at again: up to
       pair_limit members as pairs of different components, larger ones by midpoints: two fingerprints differ in
       at most `most` bits only if some value is within ceil(most / 2) bits of the one and floor(most / 2) of the other, so joining on
       such values finds every link with rows in proportion to the bucket.
    Nothing is dropped or capped.
    """
    plan = block_plan(fps.count(), most)
    keyed = fps.select("fp", F.inline(_keys(F.col("fp"), plan)))
    h1, h2 = F.xxhash64("fp", F.lit(1)), F.xxhash64("fp", F.lit(2))
    buckets = (
        keyed.groupBy("k", "bits")
        .agg(F.count("*").alias("n"), F.min("fp").alias("p1"), F.max("fp").alias("p2"), F.min_by("fp", h1).alias("p3"), F.min_by("fp", h2).alias("p4"))
        .where("n > 1")
    )
    met = written(keyed.join(spread(buckets), ["k", "bits"]))
    pivots = F.filter(F.array_distinct(F.array("p1", "p2", "p3", "p4")), lambda p: (p != F.col("fp")) & _near(p, F.col("fp"), most))
    edges = met.select(F.col("fp").alias("a"), F.explode(pivots).alias("b"))
    first = written(components(edges))
    open_ = met.where("n > 3").select("k", "bits", "n", "fp").join(spread(first.withColumnRenamed("node", "fp")), "fp", "left")
    open_ = open_.withColumn("component", F.coalesce("component", "fp"))
    mixed = open_.groupBy("k", "bits").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("k", "bits")
    left = written(open_.join(spread(mixed), ["k", "bits"]))
    if left.isEmpty():
        drop_written(met, left)
        return first.withColumnRenamed("node", "fp")
    small = left.where(F.col("n") <= pair_limit)
    a, b = small.alias("a"), spread(small).alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.bits") == F.col("b.bits"))).where(
        (F.col("a.component") < F.col("b.component")) & _near(F.col("a.fp"), F.col("b.fp"), most)
    )
    more = pairs.select(F.col("a.component").alias("a"), F.col("b.component").alias("b")).distinct()
    large = left.where(F.col("n") > pair_limit).select("fp", "component").distinct()
    more = more.unionByName(_by_midpoints(large, most))
    joined = written(components(more))
    out = (
        first.unionByName(joined.select("node", F.col("node").alias("component")).join(spread(first), "node", "left_anti"))
        .join(spread(joined.select(F.col("node").alias("component"), F.col("component").alias("to"))), "component", "left")
        .select(F.col("node").alias("fp"), F.coalesce("to", "component").alias("component"))
    )
    return out


def _flips(fp: Column, most: int) -> Column:
    """Array of all values within `most` bits of fp, itself included."""
    masks = [0]
    for r in range(1, most + 1):
        masks += [sum(1 << i for i in c) for c in combinations(range(BITS), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: fp.bitwiseXOR(m))


def _by_midpoints(large: DataFrame, most: int) -> DataFrame:
    """(a, b) links between components of `large`, each component tied to the least one that shares a midpoint."""
    points = large.select("component", F.explode(_flips(F.col("fp"), most // 2)).alias("mid")).distinct()
    low = points.groupBy("mid").agg(F.min("component").alias("b"), F.max("component").alias("top")).where("b <> top").select("mid", "b")
    if most % 2 == 0:
        return points.join(spread(low), "mid").where("component <> b").select(F.col("component").alias("a"), "b").distinct()
    wide = large.select("component", F.explode(_flips(F.col("fp"), most // 2 + 1)).alias("mid")).distinct()
    near = points.select("mid", F.col("component").alias("c")).groupBy("mid").agg(F.min("c").alias("b"))
    links = wide.join(spread(near), "mid").where("component <> b").select(F.col("component").alias("a"), "b")
    return links.unionByName(points.join(spread(low), "mid").where("component <> b").select(F.col("component").alias("a"), "b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, most: int = 4, pair_limit: int = 64) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of docs.

    Texts whose fingerprints differ in at most `most` bits are linked; component_id is the smallest doc_id that
    links reach. Null, empty and blank texts have fingerprint 0 and are linked like any other. Equal fingerprints
    are one class from the start, so copies are never paired. Null doc_ids keep their row and name no component
    unless nothing else is in it.
    """
    prints = written(fingerprints(docs, words, seed))
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = fingerprint_components(classes.select("fp"), most, pair_limit)
    both = classes.join(spread(linked), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = both.groupBy("component").agg(F.min("low").alias("component_id"))
    found = written(both.join(spread(least), "component").select("fp", "component_id"))
    return prints.join(spread(found), "fp").select("doc_id", "fp", "component_id")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
