"""Repeated lines: levelled sorted runs of line hashes, merged by anti join and compaction. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm.common import SPACES, drop_written, lower_ascii, query, table, written

KEY = ["h1", "h2"]


def line_keys(lines: Column, min_chars: int) -> Column:
    """Array of (pos, h1, h2) of the lines whose key has at least min_chars code points.

    A key is the line without white space at both ends and with A-Z in lower case. Two independent 64-bit
    hashes stand for it, so that hundreds of billions of lines have no collision to be expected.
    """
    keyed = F.transform(lines, lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(SPACES)).alias("key")))
    long = F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)
    low = F.transform(long, lambda x: F.struct(x["pos"].alias("pos"), lower_ascii(x["key"]).alias("key")))
    return F.transform(low, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")))


class LineRuns:
    """Sorted runs of (h1, h2, n, keeper) in levels, as an append-only index of line keys.

    n counts documents that hold the key, keeper is the document in which the key was met first. A run never
    changes. When a level has `fanout` runs, they are merged into one run of the next level, so a key is
    rewritten a logarithmic number of times.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch of (h1, h2, doc_id); returns its run, where fresh keys carry their keeper.

        A key met before adds to n only: its keeper is in an older run. Batches must come in descending order
        of doc_id for the keeper to be the largest id.
        """
        found = keys.groupBy(*KEY).agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("first"))
        known = self.runs()
        if known:
            seen = known[0].select(*KEY)
            for r in known[1:]:
                seen = seen.unionByName(r.select(*KEY))
            fresh = found.join(seen, KEY, "left_anti").withColumn("keeper", F.col("first"))
            again = found.join(seen, KEY, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
            found = fresh.unionByName(again)
        else:
            found = found.withColumn("keeper", F.col("first"))
        run = written(found.select(*KEY, "n", "keeper").sortWithinPartitions(*KEY))
        self._put(0, run)
        return run

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged, old = self._merged(self.levels[level]), self.levels[level]
            self.levels[level] = []
            self._put(level + 1, merged)
            drop_written(*old)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return written(_summed(runs).sortWithinPartitions(*KEY))

    def table(self) -> DataFrame:
        """One row per key over all runs: n and keeper."""
        return _summed(self.runs())


def _summed(runs: list[DataFrame]) -> DataFrame:
    all_runs = runs[0]
    for r in runs[1:]:
        all_runs = all_runs.unionByName(r)
    return all_runs.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with `text` freed of repeated lines, and `n_lines`, `n_dropped` (longs).

    Lines whose key has at least min_chars code points and is in at least min_docs documents stay only in the
    largest doc_id that holds the key, there with all their copies. Other lines stay. A null or empty text has
    one empty line and comes back as ''. Rows with a null doc_id keep all lines and count for none. Rows that
    repeat a doc_id count once for a key. Own columns named as the results are replaced; others stay.

    Batches of documents by descending id feed the runs; only hashes are shuffled until the last join.
    """
    out_cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # own columns travel in a struct, so that none meets a name of the joins
    keep = docs.select(F.struct(*out_cols).alias("_own"), "doc_id", "text")
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    cuts = [c for c in docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []]
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col("doc_id") <= F.lit(cut)).cast("int")
    lines = written(
        keep.where("doc_id is not null")
        .select("doc_id", F.xxhash64("text").alias("row_hash"), F.inline(line_keys(split, min_chars)))
        .withColumn("batch", part),
        ["batch"],
    )
    index = LineRuns(docs.sparkSession, fanout)
    for b in range(len(cuts) + 1):
        index.add(lines.where(F.col("batch") == b).select(*KEY, "doc_id"))
    # written, so that the join below shuffles both sides and a line of very many documents is split
    repeated = written(index.table().where(F.col("n") >= min_docs).select(*KEY, "keeper"))
    gone = (
        lines.join(repeated, KEY)
        .where("doc_id <> keeper")
        .groupBy("doc_id", "row_hash")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
        .withColumnRenamed("doc_id", "gone_id")
    )
    joined = keep.withColumn("row_hash", F.xxhash64("text")).join(
        gone.withColumnRenamed("row_hash", "gone_hash"),
        (F.col("doc_id") == F.col("gone_id")) & (F.col("row_hash") == F.col("gone_hash")),
        "left",
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.coalesce(F.col("gone"), F.array().cast("array<int>")))
    return (
        joined.withColumn("_lines", split)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("gone").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda p: F.get(F.col("_lines"), p)), "\n")))
        .select(*[F.col("text") if c == "text" else F.col("_own")[c].alias(c) for c in out_cols], "n_lines", "n_dropped")
    )


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
  FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
