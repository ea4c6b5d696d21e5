"""Rule texts to rows of operators: read in tasks, once for each different text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetmetrics.plans.rule_language import RANGE_FUNCTIONS, Call, Number, RuleError, Selector, parse_condition

# The texts of evaluation errors.
BARE_RANGE = "a range selector must be wrapped in rate() or increase()"
RANGE_IN_AGGREGATE = "{0}() cannot aggregate a range selector directly — wrap it in rate() first"

_MATCHER = pa.struct([("label", pa.string()), ("op", pa.string()), ("value", pa.string())])
_LEAF = pa.struct([("metric", pa.string()), ("range_ms", pa.int64()), ("per_s", pa.bool_()), ("matchers", pa.list_(_MATCHER))])
_NODE = pa.struct([("op", pa.string()), ("left", pa.int32()), ("right", pa.int32()), ("number", pa.float64()), ("leaf", pa.int32()), ("text", pa.string())])
_PROGRAM = pa.schema([("expression", pa.string()), ("problem", pa.string()), ("warning", pa.string()), ("leaves", pa.list_(_LEAF)), ("nodes", pa.list_(_NODE))])


def _is_vector(node) -> bool:
    return isinstance(node, Selector) and node.range_ms is None or isinstance(node, Call) and node.name in RANGE_FUNCTIONS


def program(text: str) -> tuple[list[dict], list[dict], str | None]:
    """(leaves, operators, what will fail when it is evaluated) of a rule; raises RuleError if it isn't one.

    Leaves are its vectors. An operator names the operators that it reads, which stand before it; the last one is the
    comparison. `one` takes the only value of a leaf, an aggregate's name all of its values; `same` passes a single value on
    and `unit` counts it; `fails` has a text for an error.
    """
    tree, leaves, out, warning = parse_condition(text), [], [], None

    def emit(op: str, left: int | None = None, right: int | None = None, number: float | None = None, leaf: int | None = None, text: str | None = None) -> int:
        out.append({"op": op, "left": left, "right": right, "number": number, "leaf": leaf, "text": text})
        return len(out) - 1

    def leaf_of(node) -> int:
        s = node if isinstance(node, Selector) else node.arg
        matchers = [{"label": a, "op": op, "value": f"\\A(?:{v})\\z" if "~" in op else v} for a, op, v in s.matchers]
        leaves.append({"metric": s.metric, "range_ms": s.range_ms, "per_s": isinstance(node, Call) and node.name == "rate", "matchers": matchers})
        return len(leaves) - 1

    def value(node) -> int:
        nonlocal warning
        if isinstance(node, Number):
            return emit("number", number=float(node.value))
        if _is_vector(node):
            return emit("one", leaf=leaf_of(node))
        if isinstance(node, Selector):
            warning = warning or BARE_RANGE
            return emit("fails", text=BARE_RANGE)
        if isinstance(node, Call):
            if _is_vector(node.arg):
                return emit(node.name, leaf=leaf_of(node.arg))
            if isinstance(node.arg, Selector):
                told = RANGE_IN_AGGREGATE.format(node.name)
                warning = warning or told
                return emit("fails", text=told)
            inner = value(node.arg)
            return emit("unit" if node.name == "count" else "same", inner)
        left = value(node.left)
        return emit(node.op, left, value(node.right))

    value(tree)
    return leaves, out, warning


def programs(rules: DataFrame) -> DataFrame:
    """(expression, problem, warning, leaves, nodes) of each different expression of rules; problem is set where it is no rule, and then there are no nodes.

    warning is what a rule that can be read will still fail with. A pattern is tried by the engine that will run it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("expression").to_pylist():
                row = dict.fromkeys(_PROGRAM.names) | {"expression": text, "leaves": [], "nodes": []}
                try:
                    leaves, nodes, warning = program(text or "")
                    row |= {"leaves": leaves, "nodes": nodes, "warning": warning}
                except RuleError as e:
                    row["problem"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=_PROGRAM)

    from pyspark.sql.pandas.types import from_arrow_schema

    read = rules.select("expression").distinct().mapInArrow(run, from_arrow_schema(_PROGRAM))
    patterns = F.flatten(F.transform("leaves", lambda leaf: F.filter(leaf["matchers"], lambda m: m["op"].contains("~"))))
    compiled = lambda p: F.call_function("try_reflect", F.lit("java.util.regex.Pattern"), F.lit("compile"), p)
    bad = F.get(F.filter(F.transform(patterns, lambda m: m["value"]), lambda p: compiled(p).isNull()), F.lit(0))
    told = F.concat(F.lit("invalid regex '"), F.substring(bad, F.lit(6), F.length(bad) - 8), F.lit("'"))
    whole = F.lit("a fractional duration is cut to a whole amount")
    cut = F.coalesce(F.col("expression"), F.lit("")).rlike(r"\[\s*\d*\.\d*[1-9]\d*(ms|[smhdw])\s*\]")
    return read.select("expression", "problem", F.when(bad.isNotNull(), told).alias("regex"), F.coalesce("warning", told, F.when(F.col("problem").isNull() & cut, whole)).alias("warning"), "leaves", "nodes")
