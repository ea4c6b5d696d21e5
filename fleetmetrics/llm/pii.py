"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

The trees are fitted by Spark's own gradient boosting on values planted into every text and become one SQL expression, which
scores the candidate spans inside their row: nothing is exploded or shuffled to find personal data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.functions.folds import let, running
from fleetmetrics.llm.common import query, table, written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. A look-behind or the end of the last match keeps long runs linear; it changes no match, as a
#: match that starts inside a run of the first class starts at the run's begin as well. The card pattern asks
#: for 16 digits at once, since shorter runs are dropped anyway.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators, several a kind, that miss little and find too much. What they propose overlaps; the trees weigh it.
WIDE = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|[\[(](?:at|AT)[\])])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{2,63}+)++",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20(?:at|AT)\x20[A-Za-z0-9-]{1,63}+(?:\x20(?:dot|DOT)\x20[A-Za-z0-9-]{2,63}+)++",
    ),
    "ip": (
        r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9])",
        r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\.)\x20?[0-9]{1,3}+){3}(?![0-9])",
    ),
    "card": (
        r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
        r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
        r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    ),
    "phone": (
        r"(?<![0-9+])\+?[0-9]{1,3}[\x20.-](?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
        r"(?<![0-9+])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    ),
}
FEATURES = ("kind", "chars", "digits", "luhn", "separators", "plus", "before", "after", "assigned", "named", "kinds_of_digits", "group", "parts_ok", "longest", "shortest", "dots", "near_digits")
NAMED = r"(?i)(mail|tel|phone|call|fon|card|visa|carte|karte|tarjeta|host|addr|ip)[^\n]{0,8}$"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the leftmost matches that don't overlap; code points, end exclusive.

    Spark gives the matches and, by split, what lies between them; lengths then give the places.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["between"])
        end = begin + F.length(pair["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), pair["found"].alias("text")))).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"))
    return F.aggregate(pairs, start, step)["out"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    backwards = F.reverse(F.split(digits, ""))
    value = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.try_cast("int") + 1)))
    return F.aggregate(value, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _parts_ok(text: Column) -> Column:
    short = lambda p: F.ltrim(p, F.lit("0"))
    fits = lambda p: (F.length(short(p)) <= 3) & (F.concat(F.lit("0"), F.substring(short(p), 1, 3)).try_cast("int") <= 255)
    return F.coalesce(F.forall(F.split(F.regexp_replace(text, r"[\[\]()\x20]", ""), r"\."), fits), F.lit(False))


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return _parts_ok(text)
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(text))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _trigger(kind: str, text: Column, wide: bool) -> Column:
    """Cheap test that a text without it has no match, so that most texts are spared the pattern."""
    if kind == "email":
        return text.contains("@") | (F.lit(wide) & text.rlike(r"[\[(](?:at|AT)[\])]|\x20(?:dot|DOT)\x20"))
    if kind == "phone":
        return text.rlike(r"[0-9]{2}[\x20.)-]\x20?[0-9]{3}" if wide else r"\+[0-9]")
    if kind == "card":
        return text.rlike(r"[0-9](?:[\x20.-]?[0-9]){12}" if wide else r"[0-9](?:[\x20-]?[0-9]){15}")
    return text.rlike(r"[0-9]\x20?[\[(]?\.[\])]?\x20?[0-9]" if wide else r"[0-9]\.[0-9]")


NONE = "array<struct<start:int,end:int,text:string>>"


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda m: _valid(kind, m["text"]))
    return F.when(_trigger(kind, text, False), found).otherwise(F.array().cast(NONE))


def _class_of(char: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 other."""
    return F.when(char == "", 0).when(char.rlike(r"^\s$"), 1).when(char.rlike(r"^\p{L}$"), 2).when(char.rlike("^[0-9]$"), 3).otherwise(4)


def wide_spans(text: Column, kind: str) -> Column:
    """Candidates of all generators of a kind: (start, end, text, x), x the array of FEATURES. A span found twice is one."""
    near = lambda c: c.cast("double")

    def described(m: Column) -> Column:
        t, n = m["text"], F.length(m["text"])
        digits = _digits(t)
        left = F.substr(text, F.greatest(F.lit(1), m["start"] - 23), F.least(m["start"], F.lit(24)))
        right = F.substr(text, m["end"] + 1, F.lit(8))
        groups = F.transform(F.regexp_extract_all(t, F.lit("[0-9]+"), 0), F.length)
        x = F.array(
            F.lit(float(KINDS.index(kind))), near(n), near(F.length(digits)), near(luhn(digits)), near(F.length(F.regexp_replace(t, r"[^\x20.()-]", ""))), near(t.startswith("+")),
            near(_class_of(F.substr(text, m["start"], F.when(m["start"] > 0, 1).otherwise(0)))), near(_class_of(F.substr(text, m["end"] + 1, F.lit(1)))),
            near(left.rlike("[=:][\\x20\"']*$")), near(left.rlike(NAMED)), near(F.size(F.array_distinct(F.split(digits, "")))),
            near(F.length(F.regexp_extract(t, "([0-9]+)$", 1))), near(_parts_ok(t)),
            near(F.coalesce(F.array_max(groups), F.lit(0))), near(F.coalesce(F.array_min(groups), F.lit(0))), near(F.length(F.regexp_replace(t, "[^.]", ""))),
            near(left.rlike("[0-9][\\x20.,-]?$")) + near(right.rlike("^[\\x20.,-]?[0-9]")),
        )
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), t.alias("text"), x.alias("x"))

    empty = F.array().cast("array<struct<start:int,end:int,text:string,x:array<double>>>")
    # empty pieces without a trigger, so that the patterns and features run on few texts
    seen = F.when(_trigger(kind, text, True), text).otherwise(F.lit(""))
    found = F.array_distinct(F.concat(*[matches(seen, p) for p in WIDE[kind]]))
    return F.when(_trigger(kind, text, True), F.transform(found, described)).otherwise(empty)


@dataclass
class SpanModel:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values, their weights, and the least margin by kind."""

    trees: list = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    threshold: dict[str, float] = field(default_factory=dict)

    def margin(self, x: Column) -> Column:
        def node(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            at, cut, left, right = t
            return F.when(F.get(x, F.lit(at)) <= cut, node(left)).otherwise(node(right))

        total = F.lit(0.0)
        for w, t in zip(self.weights, self.trees):
            total = total + F.lit(float(w)) * node(t)
        return total


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return node.prediction()
    s = node.split()
    return (s.featureIndex(), s.threshold(), _tree(node.leftChild()), _tree(node.rightChild()))


#: Values that training plants into texts: (kind, form). In a form # is a digit, w a word of letters, @ is itself, and p a part up to
#: 255; {good} and {bad} are 16 digits with a valid and with a wrong check digit, also in groups as {good4}, {bad4}. Forms of
#: the kind None look alike and are none: all that is proposed over them is a mistake.
PLANTED = (
    ("email", "w.## (at) w.w.com"), ("email", "w[at]w[dot]com"), ("email", "w at w dot org"), ("email", "w_w@w .com"), ("email", "w (AT) w (DOT) net"),
    ("ip", "p[.]p[.]p[.]p"), ("ip", "p . p . p . p"), ("ip", "p(.)p(.)p(.)p"),
    ("card", "{good}| #######"), ("card", "{good}| ####-##"), ("card", "### |{good}"), ("card", "{good4.}"), ("card", "{good4.}| ####"),
    ("phone", "(###) 555-####"), ("phone", "###-555-####"), ("phone", "001 ### 555 ####"), ("phone", "0## ### ####"), ("phone", "(0##) ###-####"), ("phone", "1.###.555.####"),
    (None, "w (at) ##"), (None, "w at w and w dot"), (None, "w at ## dot w"), (None, "9##.p.p.p"), (None, "9## . p . p . p"), (None, "p . p . p"), (None, "p[.]p[.]9##[.]p"), (None, "p.p.p.p.p"),
    (None, "{bad}| #######"), (None, "{bad} {bad}"), (None, "{bad}"), (None, "{bad4.}"), (None, "#############"), (None, "####-##-##"), (None, "####-##-## ##:##"), (None, "###-##-####"),
    (None, "## ##### ###"), (None, "#### #### ##"), (None, "###.###.###"), (None, "######-####"), (None, "#### 20##-20##"), (None, "## ### ###"), (None, "#.### ####"),
)


def _planted_value(form: str, h: Column) -> Column:
    """A form with its letters filled by hash. A bar parts what is personal data from what only stands beside it, and stays in."""
    number = lambda i, n: F.lpad(F.pmod(F.xxhash64(h, F.lit(i)), F.lit(10**n)).cast("string"), n, "0")
    out, i, n = [], 0, 0
    while i < len(form):
        n += 1
        if form[i] == "{":
            end = form.index("}", i)
            name, front = form[i + 1 : end], F.concat(F.lit("4"), number(n, 14))
            fit = F.element_at(F.filter(F.array(*[F.lit(str(x)) for x in range(10)]), lambda x: luhn(F.concat(front, x))), 1)
            if name.startswith("bad"):
                fit = ((fit.cast("int") + 1 + F.pmod(F.xxhash64(h, F.lit(-n)), F.lit(8)).cast("int")) % 10).cast("string")
            whole = F.concat(front, fit)
            out.append(F.concat_ws(name[-1], *[F.substring(whole, k, 4) for k in (1, 5, 9, 13)]) if name[-1] == "." else whole)
            i = end + 1
        elif form[i] == "#":
            run = len(form[i:]) - len(form[i:].lstrip("#"))
            out.append(number(n, run))
            i += run
        elif form[i] == "p":
            out.append(F.pmod(F.xxhash64(h, F.lit(n)), F.lit(256)).cast("string"))
            i += 1
        elif form[i] == "w" and not form[i + 1 : i + 2].isalpha():
            out.append(F.translate(F.substring(F.hex(F.xxhash64(h, F.lit(n))), 1, 7), "0123456789ABCDEF", "aeioutnrslmdpkvb"))
            i += 1
        else:
            out.append(F.lit(form[i]))
            i += 1
    return F.concat(*out)


def planted_texts(docs: DataFrame, full: int = 1000, seed: int = 42) -> DataFrame:
    """(_h, text, kind, start, end): windows of every different text into which some of PLANTED are put, at the span given; kind is null for look-alikes.

    Up to `full` texts get all the forms. Of more texts each gets fewer, chosen by its hash, and at least one, so every text has its
    part whatever their number. Copies count once. A window is what stands around a hashed word break.
    """
    hashed = docs.where("text is not null").select("text", F.xxhash64(F.lit(seed), "text").alias("_d"))
    n = len(PLANTED)
    each = min(n, -(-n * full // max(1, hashed.count())))
    own = F.pmod(F.pmod("_d", F.lit(n)) + F.col("_j"), F.lit(n)).cast("int").alias("i")
    rows = hashed.select("text", "_d", F.explode(F.array(*[F.lit(j) for j in range(each)])).alias("_j")).select("text", "_d", own)
    rows = rows.withColumn("_h", F.xxhash64("_d", "i"))
    near = F.substr(F.col("text"), F.pmod("_h", F.greatest(F.lit(1), F.length("text"))).cast("int") + 1, F.lit(160))
    rows = rows.select("_d", "i", "_h", near.alias("near")).groupBy("_d", "i", "_h").agg(F.any_value("near").alias("near"))
    value = F.coalesce(*[F.when(F.col("i") == i, _planted_value(f, F.xxhash64("_d", F.lit(i)))) for i, (_, f) in enumerate(PLANTED)])
    rows = rows.select("_h", "near", F.get(F.array(*[F.lit(k).cast("string") for k, _ in PLANTED]), F.col("i")).alias("kind"), value.alias("value"))
    head = F.regexp_replace(F.substring("near", 1, 80), r"\S*$", "")
    tail = F.regexp_replace(F.substring("near", 81, 80), r"^\S*", "")
    parts = F.split("value", r"\|")
    # of the parts beside a bar the one of 16 digits is meant; without a bar the whole
    first = F.length(F.regexp_replace(F.get(parts, F.lit(0)), "[^0-9]", "")) >= 13
    lead = F.when((F.size(parts) == 1) | first, 0).otherwise(F.length(F.get(parts, F.lit(0))))
    own = F.when((F.size(parts) == 1) | first, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(1)))
    start = (F.length(head) + lead).cast("int")
    return rows.select("_h", F.concat(head, F.array_join(parts, ""), tail).alias("text"), "kind", start.alias("start"), (start + F.length(own)).cast("int").alias("end"))


def train(docs: DataFrame, full: int = 1000, trees: int = 12, depth: int = 4, precision: float = 0.97, seed: int = 42) -> SpanModel:
    """Fits on what the generators propose in planted_texts(), so on windows of every text.

    A candidate is a case if it is just the planted span of its kind, or a base span of the window; all others, among them
    those that cover a part of a case or more than it, are none. A fifth of the windows is kept out of the fit; on
    them the least margin is set for each kind from which on proposals are right with the given precision. A kind
    without one adds nothing. Without cases of both sorts the model is empty.
    """
    rows = planted_texts(docs, full, seed)
    base = F.concat(*[_of_kind(base_spans(F.col("text"), k), k, "start", "end") for k in KINDS])
    wide = F.concat(*[_of_kind(wide_spans(F.col("text"), k), k, "start", "end", "x") for k in KINDS])
    cases = rows.select("_h", F.col("kind").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"), base.alias("_base"), F.explode(wide).alias("m"))
    sure = F.exists("_base", lambda b: (b["kind"] == F.col("m.kind")) & (b["start"] == F.col("m.start")) & (b["end"] == F.col("m.end")))
    meant = (F.col("_k").eqNullSafe(F.col("m.kind"))) & (F.col("m.start") == F.col("_s")) & (F.col("m.end") == F.col("_e"))
    cases = cases.select("m.kind", "m.x", (sure | meant).cast("double").alias("label"), (~sure & ~F.exists("_base", lambda b: (b["start"] < F.col("m.end")) & (F.col("m.start") < b["end"]))).alias("open"), (F.pmod("_h", F.lit(5)) == 4).alias("held"))
    cases = written(cases)
    fit = cases.where("not held")
    if fit.agg(F.count_distinct("label")).first()[0] < 2:
        return SpanModel()
    booster = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, minInstancesPerNode=5)
    fitted = booster.fit(fit.select("label", array_to_vector("x").alias("v")))
    model = SpanModel([_tree(t._java_obj.rootNode()) for t in fitted.trees], list(fitted.treeWeights))
    # what overlaps a base span is never added, so it has no say in the threshold
    scored = cases.where("held and open").select("kind", "label", F.round(model.margin(F.col("x")), 2).alias("m"))
    table = scored.groupBy("kind", "m").agg(F.sum("label").alias("hits"), F.count("*").alias("n")).collect()
    for kind in KINDS:
        hits = total = 0
        for r in sorted((r for r in table if r["kind"] == kind), key=lambda r: -r["m"]):
            hits, total = hits + r["hits"], total + r["n"]
            if hits >= precision * total:
                model.threshold[kind] = r["m"] - 0.005
    return model


def _of_kind(spans: Column, kind: str, *fields: str) -> Column:
    return F.transform(spans, lambda m: F.struct(F.lit(kind).alias("kind"), *[m[f].alias(f) for f in fields]))


def heaviest(spans: Column) -> Column:
    """Of spans (start, end, no, weight) those of the largest total weight that don't overlap, by weighted interval choice.

    Spans are met by their end; the best choice up to a span is that before its start with it, or that of the span before. A
    choice keeps its sum and the choice that it goes on from; the spans are read back from the last one.
    """
    pick, best = "array<struct<start:int,end:int,no:int,weight:double>>", "struct<end:int,sum:double,take:int,prev:int>"
    by_end = F.array_sort(spans, lambda a, b: F.when(a["end"] != b["end"], a["end"] - b["end"]).otherwise(a["start"] - b["start"]))
    entry = lambda *v: F.struct(*[x.alias(n) for n, x in zip(("end", "sum", "take", "prev"), v)]).cast(best)
    none = F.lit(-1)

    def step(done: Column, s: Column) -> Column:
        n, last = F.size(done), F.element_at(done, -1)

        def choose(k: Column) -> Column:
            total = F.get(done, k)["sum"] + s["weight"]
            return F.concat(done, F.array(F.when(total > last["sum"], entry(s["end"], total, n - 1, k)).otherwise(entry(s["end"], last["sum"], none, n - 1))))

        return let(F.size(F.filter(done, lambda b: b["end"] <= s["start"])) - 1, choose)

    def read_back(ordered: Column, done: Column) -> Column:
        def back(acc: Column, _: Column) -> Column:
            return let(F.get(done, acc["at"]), lambda e: F.struct(F.coalesce(e["prev"], none).alias("at"), F.when(e["take"] >= 0, F.concat(F.array(F.get(ordered, e["take"])), acc["picks"])).otherwise(acc["picks"]).alias("picks")).cast(f"struct<at:int,picks:{pick}>"))

        start = F.struct((F.size(done) - 1).alias("at"), F.array().cast(pick).alias("picks")).cast(f"struct<at:int,picks:{pick}>")
        return F.aggregate(done, start, back)["picks"]

    return let(by_end, lambda ordered: let(F.aggregate(ordered, F.array(entry(none, F.lit(0.0), none, none)), step), lambda done: read_back(ordered, done)))


def find_personal_data(docs: DataFrame, model: SpanModel) -> DataFrame:
    """docs with `base` and `spans`, arrays of (kind, start, end) by kind in the order of KINDS, then start, then end.

    spans holds the base spans, and of the proposals that overlap none of them and that the trees accept the heaviest
    choice without overlaps, of whatever kinds, a proposal's weight being its margin over the threshold of its kind. Null and
    empty texts have none. Own columns named base and spans are replaced, all others stay.
    """
    docs = docs.drop("base", "spans")
    # names that no own column has
    used = {c.lower() for c in docs.columns}
    name = next(p for p in ("_pii", *(f"_pii{i}" for i in range(len(used) + 1))) if not any(c.startswith(p) for c in used))
    text, base = F.col(f"{name}_t"), F.col(f"{name}_b")
    out = docs.withColumn(f"{name}_t", F.coalesce(F.col("text"), F.lit("")))
    numbered = lambda i, k: F.transform(base_spans(text, k), lambda m: F.struct(F.lit(i).alias("no"), m["start"].alias("start"), m["end"].alias("end")))
    out = out.withColumn(f"{name}_b", F.concat(*[numbered(i, k) for i, k in enumerate(KINDS)]))

    # base spans and proposals by their start, in runs of overlapping ones, each of which is looked at alone
    item = "start int, end int, no int, x array<double>"
    spans_of = lambda c, no, x: F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), (m["no"] if no is None else F.lit(no)).alias("no"), (m["x"] if x else F.lit(None)).cast("array<double>").alias("x")))
    wide = [spans_of(wide_spans(text, k), i, True) for i, k in enumerate(KINDS) if k in model.threshold]
    out = out.withColumn(f"{name}_w", F.concat(*wide) if wide else F.array().cast(f"array<struct<{item}>>"))
    both = F.array_sort(F.concat(spans_of(base, None, False), F.col(f"{name}_w")))
    reach = lambda m, s: F.struct(F.when(s["start"] >= m["reach"], s["end"]).otherwise(F.greatest(m["reach"], s["end"])).alias("reach"), (m["run"] + (s["start"] >= m["reach"]).cast("int")).alias("run"), *[s[c].alias(c) for c in ("start", "end", "no", "x")])
    begin = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("run"))
    numbered = running(both, begin, lambda m, s: (reach(m, s), lambda r: F.struct(r["reach"], r["run"])), "reach int, run int", f"reach int, run int, {item}")
    out = out.withColumn(f"{name}_r", F.when(F.size(f"{name}_w") > 0, numbered).otherwise(F.array().cast(f"array<struct<reach int, run int, {item}>>")))
    row = F.col(f"{name}_r")
    first = F.filter(F.transform(row, lambda s, i: F.when((i == 0) | (F.get(row, i - 1)["run"] != s["run"]), i)), lambda i: i.isNotNull())
    out = out.withColumn(f"{name}_f", first)
    at = F.col(f"{name}_f")
    least = F.array(*[F.lit(model.threshold.get(k, 0.0)) for k in KINDS])

    def choose(run: Column) -> Column:
        fixed = F.filter(run, lambda s: s["x"].isNull())
        free = F.filter(run, lambda m: m["x"].isNotNull() & ~F.exists(fixed, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        over = F.transform(free, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["no"].alias("no"), (model.margin(m["x"]) - F.get(least, m["no"])).alias("weight")))
        return let(F.filter(over, lambda m: m["weight"] > 0), lambda c: F.when(F.size(c) > 1, heaviest(c)).otherwise(c))

    runs = F.transform(at, lambda i, j: F.slice(row, i + 1, F.coalesce(F.get(at, j + 1), F.size(row)) - i))
    out = out.withColumn(f"{name}_m", F.flatten(F.transform(runs, choose)) if wide else F.array().cast("array<struct<start:int,end:int,no:int,weight:double>>"))
    chosen = F.transform(F.col(f"{name}_m"), lambda m: F.struct(m["no"].alias("no"), m["start"].alias("start"), m["end"].alias("end")))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    plain = lambda c: F.transform(c, lambda m: F.struct(F.get(kinds, m["no"]).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return out.select(*docs.columns, plain(base).alias("base"), plain(F.array_sort(F.concat(base, chosen))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with `redacted`: each run of overlapping spans replaced by [KIND] of its first span."""
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        fresh = s["start"] >= acc["at"]
        mark = F.when(fresh, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], between, mark).alias("out"))

    done = F.aggregate(by_place, start, step)
    return docs.withColumn("redacted", F.concat(done["out"], F.substr(F.col("text"), done["at"] + 1, F.length("text"))))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train(docs))
    said = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
