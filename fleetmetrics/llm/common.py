"""Helpers shared by the operators: word rules, shared work tables and Arrow batching."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of every word rule: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python task works on at a time.
SLICE_BYTES = 6_000_000
#: Bytes that a reader holds at a time of a table with large rows, or one row.
GROUP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of a text as long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir.

    Only a session in one process may do without the setting, as in tests: it gets a temporary folder. Elsewhere that
    raises, since executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share; master is {master}")
        root = f"file://{tempfile.gettempdir()}/spark-shared"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Open scopes of scratch(), innermost last; the first holds what no scope does, until the interpreter ends.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _scopes[0]:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those of kept()."""
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def written(df: DataFrame, partition_by: list[str] | None = None, _scope: int = -1, large_rows: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the plan above it is cut and lost executors cost no recomputation.

    large_rows: rows have megabytes each. Files then have row groups of about GROUP_BYTES, or of one row, and no
    dictionaries. Otherwise a writer looks at its memory every 100 rows only, and a reader decodes all rows of such a group, up
    to 4,096, at once.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    _scopes[_scope].append((spark, path))
    writer = df.write.option("compression", "zstd")
    if large_rows:
        writer = writer.options(**{"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"})
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: the join shuffles and sorts, whatever size Spark takes its sides for.

    Spark sizes a stored table by its compressed files, and what is exploded from it hardly larger, so millions of rows can
    count as small and would be broadcast through the driver.
    """
    return df.hint("merge")


def kept(df: DataFrame) -> DataFrame:
    """As written(), to outlive the scratch() that it is called in: a result. It goes with the next outer scope."""
    return written(df, _scope=-2 if len(_scopes) > 1 else -1)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that leaves its result in the shared folder and nothing else; the result goes when the interpreter ends."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch():
            return kept(f(spark, sf_dir))

    return run


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads, before their scope ends."""
    for df in tables:
        path = getattr(df, "shared_path", None)
        if path:
            _delete(df.sparkSession, path)
            for scope in _scopes:
                scope[:] = [x for x in scope if x[1] != path]


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of an Arrow batch whose texts have about limit bytes each; a longer text is a part of its own."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
