"""The queries of the operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetmetrics.llm import alignment, collocations, langid, line_dedup, lm_scoring, media, mixing, neighbours, pieces, pii, pipeline, simhash, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": media.op1_media,
    "op2_simhash": simhash.op2_simhash,
    "op3_langid": langid.op3_langid,
    "op4_pii": pii.op4_pii,
    "op5_mixing": mixing.op5_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_pieces": pieces.op8_pieces,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op11_alignment": alignment.op11_alignment,
    "op12_collocations": collocations.op12_collocations,
    "op13_url_filters": url_filters.op13_url_filters,
    "pipeline": pipeline.run,
}
ORACLES: dict[str, str] = {"op7_line_dedup": line_dedup.OP7_SQL, "op12_collocations": collocations.OP12_SQL, "op13_url_filters": url_filters.OP13_SQL}
