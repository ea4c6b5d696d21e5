"""A corpus pipeline: toxic documents out, repeated lines out, one document of each group of near copies, sources mixed, pieces encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm import line_dedup, mixing, near_copies, pieces, simhash, toxicity
from fleetmetrics.llm.common import kept, query, scratch, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (predicted 1), unchanged; repeated rows share their fate.

    A null or empty text is scored as one without words, like any other. An empty table gives an empty one.
    """
    return toxicity.score(docs.select(*COLUMNS), toxicity.trained(spark, sf_dir)).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that many documents repeat; n_chars follows the text. Texts without a dropped line stay as they are."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS, F.col("text").alias("_before")))
    text = F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("_before"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their 5-word shingles or more) the document with the smallest id.

    Links of the fingerprints of these shingles (four differing bits at most) are candidates; as most pairs at 0.8 differ in more
    bits, MinHash keys add theirs, and the whole texts decide. Documents without an id stay. A row is known by its id
    and text: of equal rows one stays, and rows of one id and different texts are judged apart.
    """
    named = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    with scratch():  # only who goes outlives the search
        prints = simhash.near_duplicates(docs.select("doc_id", "text"), words=5)
        links = written(prints.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct())
        found = near_copies.near_copies(named.select("doc_id", "text", "_h"), also=["_h"], links=links)
        gone = kept(found.where("doc_id <> component_id").select("doc_id", "_h").distinct())
    kept_rows = named.join(gone, (named.doc_id == gone.doc_id) & named["_h"].eqNullSafe(gone["_h"]), "left_anti")
    again = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept_rows.select(*COLUMNS)
    once = kept_rows.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "_h"]).select(*COLUMNS)
    return kept_rows.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice; one that isn't taken goes.

    Sources are weighed in the order of their names, null last. A null or empty text has no words and is not taken, as the mix counts words. Repeated
    rows are documents of their own. An empty table gives an empty one.
    """
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_ids): the pieces of each whole text, a row for each row; a null or empty text is the marker alone."""
    out = pieces.encode_pieces(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("pieces", encode),
]

#: A trained model decides in the first stage, so SQL has no equal of run().
ORACLE_SQL = None


@query
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch():
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
