"""URL filters: a trie over reversed host labels and path segments, the longest rule decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetmetrics.llm.common import lower_ascii, query, table

#: The rules of op13, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules up to which the trie is broadcast, some 60 MB; more are joined.
MOST_RULES = 200_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): what follows the first ://, up to / ? # or the end, with A-Z lower-cased, and then up to ? # or the end.

    Both are empty for null and for a url without ://. A port or a user name belongs to the host.
    """
    of = lambda i: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(of(1)), of(2)


class _Path:
    """Rules below a host: by whole segments, then by the start of the segment that follows."""

    __slots__ = ("below", "starts")

    def __init__(self) -> None:
        self.below: dict[str, _Path] = {}
        self.starts: dict[str, tuple[str, str]] = {}


class _Host:
    __slots__ = ("below", "path", "anywhere")

    def __init__(self) -> None:
        self.below: dict[str, _Host] = {}
        self.path: _Path | None = None
        self.anywhere: tuple[str, str] | None = None


class UrlTrie:
    """Rules (verdict, host, path) by host labels from the right, then path segments from the left."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Host()
        for verdict, host, path in sorted(rules):  # of equal host and path, block comes last and stays
            self._add(verdict, host, path)

    def _add(self, verdict: str, host: str, path: str) -> None:
        at = self.root
        for label in reversed(host.split(".")):
            at = at.below.setdefault(label, _Host())
        told = (host + path, verdict)
        if not path:
            at.anywhere = told
            return
        at.path = node = at.path or _Path()
        *whole, start = path.split("/")
        for segment in whole:
            node = node.below.setdefault(segment, _Path())
        node.starts[start] = told

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits: the one with the most host labels, then with the longest path."""
        at, best = self.root, None
        for label in reversed(host.split(".")):
            at = at.below.get(label)
            if at is None:
                break
            best = self._below(at, path) or best
        return best

    @staticmethod
    def _below(host: _Host, path: str) -> tuple[str, str] | None:
        node, best, pos = host.path, host.anywhere, 0
        while node is not None:
            end = path.find("/", pos)
            segment = path[pos:] if end < 0 else path[pos:end]
            fits = [s for s in node.starts if segment.startswith(s)] if len(node.starts) < len(segment) else [segment[:n] for n in range(len(segment) + 1) if segment[:n] in node.starts]
            if fits:
                best = node.starts[max(fits, key=len)]
            if end < 0:
                break
            node, pos = node.below.get(segment), end + 1
        return best


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", most_rules: int = MOST_RULES) -> DataFrame:
    """pages with host, path, rule and verdict; own columns of these names are replaced.

    rules has verdict (allow or block), host and path. A rule fits its host and all hosts below it, if the url's path
    starts with the rule's; an empty path fits every path. Of the rules that fit, most host labels win, then the
    longest path; of equal rules that say both, block. rule is host and path as one text, null where none fits; there
    the verdict is `default`. Rules with a null or an empty host are left out. Repeated rows are judged alike, and
    null urls have an empty host, which no rule fits.

    Up to most_rules rules are counted and broadcast as a trie; more are joined to the urls' own host suffixes and path starts.
    """
    host, path = url_parts(F.col(url).cast("string"))
    rows = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], host.alias("host"), path.alias("path"))
    rules = rules.select("verdict", lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("verdict in ('allow', 'block') and host <> ''")
    if rules.limit(most_rules + 1).count() > most_rules:
        found = _by_join(rows.select("host", "path").distinct(), rules)
        out = rows.join(found, ["host", "path"], "left")
    else:
        out = _by_trie(rows, UrlTrie(tuple(r) for r in rules.distinct().collect()))
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*rows.columns, "rule", "verdict")


def _by_trie(rows: DataFrame, trie: UrlTrie) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(trie)
    names = rows.schema.names
    host, path = names.index("host"), names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = shared.value.match
        for batch in batches:
            found = [match(h, p) or (None, None) for h, p in zip(batch.column(host).to_pylist(), batch.column(path).to_pylist())]
            own = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "rule", "verdict"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("rule string, verdict string").fields]))


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of different urls: one equi-join with every host suffix and path start that is as long as some rule's.

    The different numbers of labels and lengths of paths in the rules are few, and come to the driver. Rules are
    different, so a host that most urls share is split by adaptive execution on the urls' side.
    """
    labels = lambda c: F.size(F.split(c, r"\."))
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    counts, lengths = one.agg(F.collect_set(labels("host")), F.collect_set(F.length("path"))).first()
    upto = lambda values, most: F.explode(F.filter(F.array(*map(F.lit, values)), lambda x: x <= most))
    rows = urls.select("host", "path", upto(counts, labels("host")).alias("n"))
    rows = rows.select("host", "path", "n", upto(lengths, F.length("path")).alias("k"))
    keyed = rows.select("host", "path", "n", "k", F.array_join(F.slice(F.split("host", r"\."), -F.col("n"), F.col("n")), ".").alias("r_host"), F.substring("path", F.lit(1), F.col("k")).alias("r_path"))
    hit = keyed.join(one.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict"), ["r_host", "r_path"])
    best = hit.groupBy("host", "path").agg(F.max(F.struct("n", "k", F.concat("r_host", "r_path").alias("rule"), "verdict")).alias("b"))
    return best.select("host", "path", "b.rule", "b.verdict")


@query
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP13_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, r_host, r_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT host, path, arg_max(r_host || r_path, length(r_host) * 10000 + length(r_path)) AS rule, arg_max(verdict, length(r_host) * 10000 + length(r_path)) AS verdict
 FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
