"""Near copies by exact shingle similarity: MinHash bands bring candidates together, whole texts decide."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetmetrics.llm.common import drop_written, sliced, spread, written
from fleetmetrics.llm.components import components

#: A pair of similarity s shares a band's key with chance s ** ROWS: at 0.8 all BANDS miss it with chance 1.5e-4, at 0.9 with 2e-12.
BANDS, ROWS = 48, 8
#: Shingles whose values are compared at a time.
CHUNK = 1024

_rng = np.random.default_rng(17)
_TURN = _rng.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = 5) -> list[bytes]:
    """Word shingles of a text, repeats included; fewer words than a shingle has are one, no words none. Word rules are op2's."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [joined]
    ends = [e + i for i, e in enumerate(accumulate(map(len, parts)))]
    return [joined[a:b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends[words - 1 :])]


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard similarity; two texts without words are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def band_keys(parts: list[bytes]) -> np.ndarray:
    """A key for each band; none without shingles."""
    if not parts:
        return np.zeros(0, np.int64)
    h = np.array([xxhash.xxh32_intdigest(s, 42) for s in parts], np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(h), CHUNK):
        np.minimum(low, (h[i : i + CHUNK] * _TURN).min(axis=1), out=low)
    return (low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _node(text: str | None) -> int:
    """Signed 64-bit hash of the words of a text."""
    h = xxhash.xxh64_intdigest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b"", 42)
    return h - (1 << 64) if h >> 63 else h


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with node, n and keys in place of text: node is a 64-bit hash of the words, n the number of different shingles."""
    at, rest = docs.schema.names.index("text"), [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                node, n, keys = [], [], []
                for t in part.column("text"):
                    t = t.as_py()
                    found = shingles(t, words)
                    node.append(_node(t))
                    n.append(len(set(found)))
                    keys.append(band_keys(found))
                ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))
                own = [part.column(i) for i in range(part.num_columns) if i != at]
                yield pa.record_batch([*own, pa.array(node, pa.int64()), pa.array(n, pa.int32()), lists], [*[f.name for f in rest], "node", "n", "keys"])

    return docs.mapInArrow(run, StructType([*rest, *StructType.fromDDL("node long, n int, keys array<long>")]))


def _named(docs: DataFrame) -> DataFrame:
    """(node, doc_id, text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            yield pa.record_batch([pa.array([_node(t.as_py()) for t in text], pa.int64()), batch.column("doc_id"), text], ["node", "doc_id", "text"])

    return docs.mapInArrow(run, "node long, doc_id long, text string")


def verified(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Pairs (a, b) of nodes whose texts have a similarity of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ours = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != last:
                    last, ours = a, set(shingles(ta.as_py(), words))
                keep.append(similarity(ours, set(shingles(tb.as_py(), words))) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.distinct().join(spread(texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))), "b")
    both = both.join(spread(texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _hashed(texts: DataFrame, words: int) -> DataFrame:
    """(node, hs): the different shingles of each text as 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                found = [np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in set(shingles(t.as_py(), words))], np.uint64)).view(np.int64) for t in part.column("text")]
                ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
                yield pa.record_batch([part.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["node", "hs"])

    return texts.select("node", "text").mapInArrow(run, "node long, hs array<long>")


def apart_pairs(texts: DataFrame, members: DataFrame, least: float, words: int) -> DataFrame:
    """Pairs (a, b) of texts in different components of `members` (node, component) that can have a similarity of `least` or more; none that has is missing.

    Two texts of n and m shingles are that similar only if they share k = least / (1 + least) (n + m) of them, all of which
    stand in two components. In one order of those shingles, rarest first, a text's p-th of s can be the first that a pair
    shares only if s - p >= k, that is, if the other text has at most `most` shingles. So texts meet at their rarest shingles
    only, and one with few shingles that another component has meets none, however many texts are like it. At a shingle
    the texts of its most frequent component meet the others, not each other.
    """
    rows = _hashed(texts.join(members.select("node"), "node", "left_semi"), words).join(members, "node")
    rows = written(rows.select("node", "component", F.size("hs").alias("n"), F.explode("hs").alias("h")))
    both = rows.groupBy("h").agg(F.count("*").alias("f"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("h", "f")
    own = Window.partitionBy("node")
    placed = rows.join(spread(both), "h").withColumn("left", F.count("*").over(own) - F.row_number().over(own.orderBy("f", "h")) + 1)
    first = placed.withColumn("most", F.col("left") * ((1 + least) / least) - F.col("n") + 1e-6).where(F.col("most") >= F.col("n") * least - 1e-6)
    first = written(first.select("h", "node", "component", "n", "most"))
    many = first.groupBy("h", "component").agg(F.count("*").alias("k")).groupBy("h").agg(F.max(F.struct("k", "component")).alias("top")).select("h", F.col("top.component").alias("main"))
    x, y = first.join(spread(many), "h").where("component <> main").alias("x"), spread(first).alias("y")
    met = x.join(y, F.col("x.h") == F.col("y.h")).where(
        (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("x.main")) | (F.col("x.node") < F.col("y.node")))
        & (F.col("x.n") <= F.col("y.most")) & (F.col("y.n") <= F.col("x.most"))
    )
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, also: Sequence[str] = (), links: DataFrame | None = None) -> DataFrame:
    """(doc_id, the columns of also, component_id): one row per row of docs with an id; component_id is the smallest doc_id that links reach.

    Texts are linked if the Jaccard similarity of their word shingles is `least` or more. Texts of equal words are one
    class from the start, so copies are never paired.

    1. Classes meet in the buckets of their band keys. Each is compared with the least and the largest of its bucket,
       so a bucket of any size costs its own rows.
    2. Members of buckets that stay in several components are joined at their rarest shingles (apart_pairs), which finds every
       link between components.
    links, pairs (a, b) of doc_ids that something else found, are candidates of the first step too.
    Sizes that rule the similarity out spare a comparison; no bucket is dropped or capped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, F.col("text").cast("string").alias("text")).where("doc_id is not null")
    prints = written(signatures(docs, words))
    classes = written(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("lo"), F.max(F.struct("node", "n")).alias("hi")).where("size > 1")
    met = written(keyed.join(spread(ends), "key"))
    # a class is read as its row with the least id
    named = prints.select("doc_id", "node").distinct()
    told = links.join(named.select(F.col("doc_id").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("doc_id").alias("b"), F.col("node").alias("y")), "b") if links is not None else None
    told = written(told.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()) if told is not None else None
    seen = met.select("node") if told is None else met.select("node").unionByName(told.select(F.inline(F.array(F.struct(F.col("a").alias("node")), F.struct(F.col("b").alias("node"))))))
    one = seen.distinct().join(classes.select("node", F.col("low").alias("doc_id")), "node")
    texts = written(_named(docs.select("doc_id", "text")).join(one, ["node", "doc_id"], "left_semi").dropDuplicates(["node", "doc_id"]).select("node", "text"))
    fits = lambda a, b: F.least(a, b) >= F.greatest(a, b) * (least - 1e-9)
    met_ends = met.select("node", "n", F.inline(F.array("lo", "hi")).alias("end", "m")).where((F.col("node") != F.col("end")) & fits(F.col("n"), F.col("m")))
    pairs = met_ends.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b"))
    pairs = pairs if told is None else pairs.unionByName(told)
    first = written(components(written(verified(pairs, texts, least, words))))
    open_ = met.where("size > 3").select("key", "node", "n").join(spread(first), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = open_.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    left = written(open_.join(spread(mixed), "key", "left_semi").select("node", "component").distinct())
    more = apart_pairs(texts, left, least, words)
    links = written(verified(more, texts, least, words))
    old = first.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    linked = components(links.unionByName(old))
    both = classes.select("node", "low").join(spread(linked), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = both.groupBy("component").agg(F.min("low").alias("component_id"))
    found = written(both.join(spread(lows), "component").select("node", "component_id"))
    drop_written(met, left, texts, classes)
    return prints.select("doc_id", *also, "node").join(spread(found), "node").select("doc_id", *also, "component_id")
