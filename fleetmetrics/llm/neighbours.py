"""Approximate nearest neighbours by cosine: balanced posting lists whose centroids are searched by a graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmetrics.llm.common import drop_written, query, table, written

#: Vectors that a task compares at a time.
ROWS = 2048
#: A list of a level has its parent's number, then its own in so many bits; so three levels can follow the first.
CHILD_BITS, LEVELS = 14, 3
#: Lists that a query reads whatever their distance.
SURE = 8


@dataclass
class ListIndex:
    """Unit centroids, for each its neighbours in the graph, and the entry nodes."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def nearest(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of about the `width` nearest centroids of each unit vector, by beam search, nearest first.

        Every vector keeps a beam of the best nodes seen; a step expands the best node not yet expanded, for all
        vectors at once, until no beam has one.
        """
        n, k = len(x), len(self.centroids)
        width = min(width, k)
        seen = np.zeros((n, k), bool)
        d = 2 - 2 * x @ self.centroids[self.entries].T
        seen[:, self.entries] = True
        beam = np.broadcast_to(self.entries, d.shape).copy()
        done = np.zeros(d.shape, bool)
        every = np.arange(n)[:, None]
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], np.inf, d[live])
            at = open_.argmin(axis=1)
            ok = np.isfinite(open_[np.arange(len(live)), at])
            live, at = live[ok], at[ok]
            if not len(live):
                break
            node = beam[live, at]
            done[live, at] = True
            new = self.links[node]
            fresh = ~seen[live[:, None], new]
            seen[live[:, None], new] = True
            far = np.where(fresh, 2 - 2 * np.einsum("ij,ikj->ik", x[live], self.centroids[new]), np.inf)
            all_d, all_b = np.concatenate([d[live], far], 1), np.concatenate([beam[live], new], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, : max(width, d.shape[1])]
            if d.shape[1] < width and keep.shape[1] > d.shape[1]:
                grow = keep.shape[1] - d.shape[1]
                d = np.concatenate([d, np.full((n, grow), np.inf)], 1)
                beam = np.concatenate([beam, np.zeros((n, grow), beam.dtype)], 1)
                done = np.concatenate([done, np.ones((n, grow), bool)], 1)
            rows = np.arange(len(live))[:, None]
            cols = np.arange(keep.shape[1])
            d[live[:, None], cols], beam[live[:, None], cols], done[live[:, None], cols] = all_d[rows, keep], all_b[rows, keep], all_done[rows, keep]
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        return beam[every, order], np.maximum(d[every, order], 0)


def _split(x: np.ndarray, ids: np.ndarray, most: int, rng: np.random.Generator, fan: int = 8) -> list[np.ndarray]:
    """Groups of at most `most` rows by repeated k-means; a group that k-means can't part is cut by order."""
    if len(ids) <= most:
        return [ids]
    k = min(fan, -(-len(ids) // most))
    own = x[ids]
    c = own[rng.choice(len(own), k, replace=False)]
    for _ in range(8):
        near = (own @ c.T).argmax(axis=1)
        c = np.stack([own[near == i].mean(axis=0) if (near == i).any() else own[rng.integers(len(own))] for i in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    near = (own @ c.T).argmax(axis=1)
    if np.bincount(near, minlength=k).max() == len(ids):
        return [g for part in np.array_split(ids, k) for g in _split(x, part, most, rng, fan)]
    return [g for i in range(k) if (near == i).any() for g in _split(x, ids[near == i], most, rng, fan)]


def build_index(sample: np.ndarray, lists: int, degree: int = 16, seed: int = 42) -> ListIndex:
    """About `lists` balanced centroids of a sample of unit vectors, in a graph of nearest and a few random links."""
    rng = np.random.default_rng(seed)
    groups = _split(sample, np.arange(len(sample)), max(1, len(sample) // max(1, lists)), rng)
    c = np.stack([sample[g].mean(axis=0) for g in groups]).astype(np.float32)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    c = np.where(norm > 1e-6, c / np.maximum(norm, 1e-6), np.stack([sample[g[0]] for g in groups])).astype(np.float32)
    k = len(c)
    near = np.concatenate([np.argsort(-(c[i : i + 512] @ c.T), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, k, 512)])
    links = np.concatenate([near, rng.integers(0, k, (k, max(1, degree // 4)))], 1) if k > 1 else np.zeros((1, 1), np.int64)
    return ListIndex(c, links.astype(np.int64), rng.choice(k, min(k, 16), replace=False))


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return raw, (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


def _chosen(node: np.ndarray, d: np.ndarray, centroids: np.ndarray, most: int, ratio: float, spread: bool) -> np.ndarray:
    """Which lists (nodes, nearest first, at squared distances d) each vector takes: those at up to `ratio` times the nearest's distance, `most` at most.

    spread: a list is passed over if its centroid is nearer to a list already taken than to the vector. Otherwise, for
    queries, the SURE nearest are taken at any distance, since a query may be next to the centroid of a small list.
    """
    take = np.sqrt(d) <= ratio * np.sqrt(d[:, :1]) + 1e-6
    take[:, : 1 if spread else SURE] = True
    if spread:
        for j in range(1, node.shape[1]):
            for earlier in range(j):
                both = take[:, j] & take[:, earlier]
                gap = 2 - 2 * np.einsum("ij,ij->i", centroids[node[:, j]], centroids[node[:, earlier]])
                take[:, j] &= ~(both & (gap < d[:, j]))
    return take & (np.cumsum(take, axis=1) <= most)


def _assigned(df: DataFrame, index, dim: int, width: int, most: int, ratio: float, spread: bool, schema: str) -> DataFrame:
    """Rows of df repeated for the lists that they take, as columns `list` and `d`, the squared distance to its centroid."""
    at, names = df.schema.names.index("vec"), df.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                _, x = _unit(part.column(at), dim)
                node, d = ix.nearest(x, width)
                r, c = np.nonzero(_chosen(node, d, ix.centroids, most, ratio, spread))
                cols = [x.take(pa.array(r)) for x in part.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(node[r, c].astype(np.int64)), pa.array(d[r, c].astype(np.float64))], [*names, "list", "d"])

    return df.mapInArrow(run, schema)


def _sizes(lists: DataFrame, asked: DataFrame, task_rows: int) -> DataFrame:
    """(list, n, cut, q_cut): entries of a list, and the parts that its entries and its queries are cut into."""
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(c), F.lit(0)) / task_rows)).cast("int")
    ask = asked.groupBy("list").agg(F.count("*").alias("m"))
    return lists.groupBy("list").agg(F.count("*").alias("n")).join(ask, "list", "left").select("list", "n", parts("n").alias("cut"), parts("m").alias("q_cut"))


def _part(seed: int, cut: str):
    return F.pmod(F.xxhash64(F.lit(seed), "key"), F.col(cut)).cast("int")


def _divided(lists: DataFrame, asked: DataFrame, sizes: DataFrame, most_rows: int, list_size: int, fan: int, inner: int, replica_ratio: float, probes: int, probe_ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """lists and asked, with each list of over `most_rows` entries divided into up to about `fan` lists of its own.

    Centroids of a list are fitted in one task on about 16 of its entries for each; entries and queries are placed in parts.
    A query keeps, of all its lists, the `probes` nearest within `probe_ratio` of the nearest.
    """
    k = F.least(F.lit(fan), F.ceil(F.col("n") / list_size)).cast("int")
    large = sizes.where(F.col("n") > most_rows).withColumn("k", k)
    share = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) < F.lit(16.0 * (1 << 30)) * F.col("k") / F.col("n")

    def unit(vec: pd.Series) -> np.ndarray:
        x = np.stack(vec).astype(np.float64)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", key=lambda c: c.map(lambda r: (r["a"], r["b"])))
        centroids = build_index(unit(part["vec"]), int(part["k"].iloc[0]), degree=1, seed=seed).centroids
        return pd.DataFrame({"list": part["list"].iloc[:1], "centers": [centroids.ravel()]})

    fitted = lists.join(large.select("list", "n", "k"), "list").where(share).select("list", "k", "key", "vec").groupBy("list").applyInPandas(fit, "list long, centers array<float>")
    centers = written(fitted.join(large.select("list", "cut", "q_cut"), "list"))

    def placed(df: DataFrame, cut: str, most: int, ratio: float, spread: bool) -> DataFrame:
        columns = df.columns
        names = [c for c in columns if c not in ("list", "d")]

        def place(rows: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(of):
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
            x = unit(rows["vec"])
            c = np.asarray(of["centers"].iloc[0], np.float32).reshape(-1, x.shape[1])
            gap = np.maximum(2 - 2 * x @ c.T, 0)
            width = min(len(c), 4 * most if spread else most)
            node = np.argsort(gap, axis=1, kind="stable")[:, :width]
            d = np.take_along_axis(gap, node, axis=1)
            r, j = np.nonzero(_chosen(node, d, c, most, ratio, spread))
            out = rows[names].iloc[r].reset_index(drop=True)
            return out.assign(list=(rows["list"].to_numpy()[r] << CHILD_BITS) + node[r, j], d=d[r, j].astype(np.float64))[columns]

        own = df.join(centers.select("list", cut), "list").withColumn("part", _part(seed + 1, cut)).drop(cut)
        to = centers.select("list", "centers", F.explode(F.sequence(F.lit(0), F.col(cut) - 1)).alias("part"))
        moved = own.groupBy("list", "part").cogroup(to.groupBy("list", "part")).applyInPandas(place, df.schema)
        rest = df.join(centers.select("list"), "list", "left_anti").select(*[c if c != "list" else F.shiftleft("list", CHILD_BITS).alias("list") for c in df.columns])
        return rest.unionByName(moved)

    reach = Window.partitionBy("key")
    near = placed(asked, "q_cut", probes, probe_ratio, False).withColumn("_least", F.min("d").over(reach)).withColumn("_r", F.row_number().over(reach.orderBy("d", "list")))
    near = near.where((F.col("_r") <= SURE) | (F.col("_r") <= probes) & (F.sqrt("d") <= probe_ratio * F.sqrt("_least") + 1e-6)).select(*asked.columns)
    return written(placed(lists, "cut", inner, replica_ratio, True)), written(near)


def nearest_neighbours(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    sample: int = 20_000,
    list_size: int = 150,
    replicas: int = 3,
    replica_ratio: float = 1.15,
    probes: int = 112,
    probe_ratio: float = 1.6,
    task_rows: int = 4096,
    divide_above: int = 8,
    fan: int = 256,
    inner_replicas: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of (vec_id, embedding) whose id is divisible by `every`, the k nearest other rows found.

    Nearness is cosine in double precision; ties go to the smaller vec_id. Null and zero vectors, vectors with null
    or non-finite components, null ids, and vectors that haven't the most frequent length take no part. Repeated
    ids are separate candidates; a query never returns its own id.

    Rows with equal vectors are one entry with its k + 1 smallest ids, which are all that any answer can hold of
    it; so a vector that fills a third of the table is no skew. Centroids come from a sample of at most `sample`
    entries; every entry is put on lists. Lists of over `divide_above` times `list_size` entries get centroids of their own
    (`fan` at most, from about 16 of their entries each), where an entry is put on up to `inner_replicas` lists, and so
    on for LEVELS levels; a query goes down all lists that it has and keeps the `probes` nearest. Lists, and the
    queries of a list, are cut into parts of `task_rows` at most, so no task holds more whatever the balance.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    base = base.where(finite & F.exists("vec", lambda v: v != 0)).withColumn("dim", F.size("vec"))
    dims = base.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = dims["dim"]
    key = F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(seed), "vec").alias("b"))
    base = base.where(F.col("dim") == dim).select("vec_id", "vec", key.alias("key"))
    first = base.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    entries = written(first.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = written(base.where(F.col("vec_id") % every == 0).select("vec_id", "key"))
    n = entries.count()
    # keys are hashes, so the smallest are a fair sample; only keys are sorted
    last = entries.select("key.a").orderBy("a").limit(sample).agg(F.max("a")).first()[0]
    rows = np.array(entries.where(F.col("key.a") <= last).select("key", "vec").toPandas().sort_values("key", key=lambda k: k.map(tuple))["vec"].tolist(), float)
    unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)
    index = build_index(unit, max(1, min(len(unit) // 8 or 1, n // list_size)), seed=seed)
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    key_ddl = "key struct<a: long, b: long>"
    lists = written(_assigned(entries, shared, dim, 4 * replicas, replicas, replica_ratio, True, f"{key_ddl}, vec array<double>, ids array<long>, list long, d double"))
    asked = queries.select("key").distinct().join(entries.select("key", "vec"), "key")
    asked = written(_assigned(asked, shared, dim, probes, probes, probe_ratio, False, f"{key_ddl}, vec array<double>, list long, d double"))
    sizes = written(_sizes(lists, asked, task_rows))
    for level in range(LEVELS):
        if sizes.where(F.col("n") > divide_above * list_size).isEmpty():
            break
        old = lists, asked, sizes
        lists, asked = _divided(lists, asked, sizes, divide_above * list_size, list_size, fan, inner_replicas, replica_ratio, probes, probe_ratio, seed + 10 * (level + 1))
        sizes = written(_sizes(lists, asked, task_rows))
        drop_written(*old)
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sizes = sizes.select("list", "cut", "q_cut")
    left = lists.join(sizes, "list").withColumn("part", _part(1, "cut")).withColumn("q_part", upto("q_cut"))
    right = asked.join(sizes, "list").withColumn("q_part", _part(2, "q_cut")).withColumn("part", upto("cut"))
    by = ["list", "part", "q_part"]

    def compare(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = {"key": [], "vec_id": [], "score": []}
        if len(have) and len(ask):
            a, q = np.stack(have["vec"]), np.stack(ask["vec"])
            na, nq = np.linalg.norm(a, axis=1), np.linalg.norm(q, axis=1)
            ids, keys = have["ids"].tolist(), ask["key"].tolist()
            low = np.array([i[0] for i in ids])
            for i in range(0, len(q), 256):
                s = (q[i : i + 256] @ a.T) / (nq[i : i + 256, None] * na)
                m = min(k + 1, s.shape[1])
                floor = -np.sort(np.partition(-s, m - 1, axis=1)[:, :m], axis=1)[:, -1]
                for r in range(len(s)):
                    good = np.flatnonzero(s[r] >= floor[r])
                    good = good[np.lexsort((low[good], -s[r][good]))]
                    for c in good:
                        out["key"] += [keys[i + r]] * len(ids[c])
                        out["vec_id"] += list(ids[c])
                        out["score"] += [s[r, c]] * len(ids[c])
        return pd.DataFrame(out).astype({"key": object})  # without rows pandas takes it for a number

    found = left.select(*by, "vec", "ids").groupBy(*by).cogroup(right.select(*by, "key", "vec").groupBy(*by)).applyInPandas(compare, f"{key_ddl}, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    top = once.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    top = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("hits"))
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    answers = queries.select(F.col("vec_id").alias("query_id"), "key").join(top, "key").select("query_id", F.posexplode(others).alias("rank", "hit"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.s")).alias("score"))


@query
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
