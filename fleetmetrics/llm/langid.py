"""Language ID: interpolated Kneser-Ney character models per language in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetmetrics.llm.common import fold, query, sliced, table

UNDECIDED = "und"
NOT_LETTERS = r"[^\p{L}]+"
MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xD6E8FEB86659FD93)

#: A text is rejected if its cross-entropy is so many times that of the worst text of its language outside the fit.
SLACK = 1.25


@dataclass
class LanguageModel:
    """For each order 1 to `order`: sorted n-gram hashes, per language the discounted share `alpha` of an n-gram
    after its context, and the weight `rest` that the n-gram, as a context, leaves to the shorter one."""

    languages: list[str]
    order: int
    hashes: list[np.ndarray]
    alpha: list[np.ndarray]
    rest: list[np.ndarray]
    floor: float
    unseen: np.ndarray | None = None
    slope: float = 1.0
    limit: np.ndarray | None = None  # the cross-entropy by language above which a text is rejected


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of letters in lower case of all texts in turn, end of each text in them)."""
    low = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.string()).fill_null("")), NOT_LETTERS, " ")
    lists = pc.split_pattern(pc.utf8_trim(low, " "), " ")
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    return pc.list_flatten(lists), ends


def _grams(words: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams of 1 to `order` characters that end at each character of " word ", the first space
    apart; then the word of each character, and how many characters of its word stand before it."""
    parts = pc.binary_join_element_wise(" ", words, " ", "").to_pylist()
    size = np.array([len(w) for w in parts], np.int64)
    code = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    hashes, h = [], np.zeros(len(code), np.uint64)
    for n in range(1, order + 1):
        back = np.concatenate([np.zeros(n - 1, np.uint64), code])[: len(code)]
        # the character n - 1 places before joins the hash, its place with it
        h = np.where(place >= n - 1, h ^ ((back * MIX + np.uint64(n)) * MIX2), h) if n > 1 else code * MIX * MIX2
        hashes.append(_spread(h))
    return hashes, word, place


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def find(sorted_hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted array, -1 where it isn't there."""
    if not len(sorted_hashes):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, at, -1)


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(lang, n, gram, context, shorter, c): counts of the character n-grams of whole texts, with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                lang = np.array(part.column("lang").to_pylist(), object)
                for name in set(lang):
                    words, _ = _words(pc.filter(part.column("text"), pa.array(lang == name)))
                    coded = words.dictionary_encode()
                    times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                    hashes, word, place = _grams(coded.dictionary, order)
                    for n in range(1, order + 1):
                        at = np.flatnonzero(place >= max(1, n - 1))
                        gram, first, where = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
                        c = np.bincount(where, times[word[at]]).astype(np.int64)
                        context = hashes[n - 2][at - 1][first] if n > 1 else np.zeros(len(gram), np.uint64)
                        shorter = hashes[n - 2][at][first] if n > 1 else np.zeros(len(gram), np.uint64)
                        cols = [pa.array([name] * len(gram)), pa.array(np.full(len(gram), n, np.int32))]
                        cols += [pa.array(x.view(np.int64)) for x in (gram, context, shorter)]
                        yield pa.record_batch([*cols, pa.array(c)], ["lang", "n", "gram", "context", "shorter", "c"])

    counted = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, n int, gram long, context long, shorter long, c long")
    return counted.groupBy("lang", "n", "gram", "context", "shorter").agg(F.sum("c").alias("c"))


def train(docs: DataFrame, order: int = 4, sample: int = 1500, seed: int = 42, held: int = 10) -> LanguageModel | None:
    """Fits on at most `sample` documents of each language, those with the smallest seeded hash; None without any.

    docs has doc_id, text, lang. Rows with a null text or lang are left out. The n-grams of the sample are counted
    by Spark; their number depends on the sample, which bounds the arrays that are broadcast. Below the highest
    order counts are of different predecessors (Kneser-Ney); discounts come from counts of one and two.

    Every held-th document of a language's sample is kept out of the counts. On these the slope of the scores is fitted and
    the cross-entropy above which a text is rejected: SLACK times that of the worst of them, by language.
    """
    use = docs.where("text is not null and lang is not null").withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    per = use.groupBy("lang").count().toPandas()
    if not len(per):
        return None
    # a share of the hash range that holds half more than the sample, then the smallest hashes of each language
    share = {r["lang"]: min(1.0, (1.5 * sample + 50) / r["count"]) for _, r in per.iterrows()}
    cut = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(-(2**63) + v * (2**64 - 1)) if v < 1 else 2**63 - 1)])
    near = use.where(F.col("_h") <= cut[F.col("lang")])
    from pyspark.sql import Window

    rank = near.select("lang", "doc_id", "_h").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_r") <= sample)
    aside = F.col("_r") % held == 0
    picked = near.join(F.broadcast(rank.select("lang", "doc_id", aside.alias("_aside"))), ["lang", "doc_id"])
    grams = count_grams(picked.where("not _aside"), order).toPandas()
    model = _fit(grams, order)
    texts = picked.where("_aside").orderBy("_h", "doc_id").select("text", "lang").toPandas()
    model.slope, model.limit = _calibrated(model, texts)
    return model


def _fit(grams: pd.DataFrame, order: int) -> LanguageModel:
    langs = sorted(grams["lang"].unique())
    number = {x: i for i, x in enumerate(langs)}
    grams = grams.assign(l=grams["lang"].map(number))
    chars = max(1, grams[grams["n"] == 1]["gram"].nunique())
    hashes, alpha, rest = [], [], []
    kinds = {n: grams[grams["n"] == n] for n in range(1, order + 1)}
    for n in range(1, order + 1):
        g = kinds[n]
        if n < order:
            up = kinds[n + 1].groupby(["l", "shorter"]).size()
            c = up.reindex(pd.MultiIndex.from_arrays([g["l"], g["gram"]])).fillna(0).to_numpy()
            c = np.where(c > 0, c, g["c"].to_numpy())  # an n-gram at the start of a word has no predecessor
        else:
            c = g["c"].to_numpy()
        l, context = g["l"].to_numpy(), g["context"].to_numpy().view(np.uint64) if n > 1 else np.zeros(len(g), np.uint64)
        d = np.array([_discount(c[l == i]) for i in range(len(langs))])[l]
        key = pd.MultiIndex.from_arrays([l, context])
        per = pd.DataFrame({"c": c, "d": d}, index=key).groupby(level=[0, 1]).sum()
        total = per["c"].reindex(key).to_numpy()
        keys, where = np.unique(g["gram"].to_numpy().view(np.uint64), return_inverse=True)
        a = np.zeros((len(keys), len(langs)), np.float32)
        a[where, l] = np.maximum(c - d, 0) / total
        hashes.append(keys)
        alpha.append(a)
        rest.append(np.ones((len(keys), len(langs)), np.float32))
        share = (per["d"] / per["c"]).to_numpy()
        pl, pctx = per.index.get_level_values(0).to_numpy(), per.index.get_level_values(1).to_numpy().astype(np.uint64)
        if n == 1:
            start = np.zeros(len(langs))
            start[pl] = share
            first = start
        else:
            at = find(hashes[n - 2], pctx)
            rest[n - 2][at[at >= 0], pl[at >= 0]] = share[at >= 0]
    model = LanguageModel(langs, order, hashes, alpha, rest, 1 / (chars + 1))
    model.alpha[0] = model.alpha[0] + (first * model.floor).astype(np.float32)
    model.unseen = (first * model.floor).astype(np.float32)
    return model


def _discount(c: np.ndarray) -> float:
    ones, twos = float((c == 1).sum()), float((c == 2).sum())
    return float(np.clip(ones / (ones + 2 * twos), 0.1, 0.95)) if ones + twos else 0.5


def char_probabilities(m: LanguageModel, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interpolated probability of each character of " word " by language, its word, its place in it)."""
    hashes, word, place = _grams(words, m.order)
    at = find(m.hashes[0], hashes[0])
    p = np.where((at >= 0)[:, None], m.alpha[0][at], m.unseen)
    for n in range(2, m.order + 1):
        context = np.concatenate([[-1], at[:-1]])
        here = find(m.hashes[n - 1], hashes[n - 1])
        full = place >= n - 1
        rest = np.where((context >= 0)[:, None], m.rest[n - 2][context], 1)
        longer = np.where((here >= 0)[:, None], m.alpha[n - 1][here], 0) + rest * p
        p = np.where(full[:, None], longer, p)
        at = np.where(full, here, -1)
    p[place == 0] = 1  # the space before a word is given
    return p, word, place


def word_costs(m: LanguageModel, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(negative log probability of each word by language, characters of each word with its end)."""
    p, word, place = char_probabilities(m, words)
    cost = np.stack([np.bincount(word, -np.log(p[:, i]), len(words)) for i in range(p.shape[1])], axis=1)
    return cost, np.bincount(word, place > 0, len(words))


def text_costs(m: LanguageModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per character of each text by language, whether it has a letter); equal words are scored once."""
    words, ends = _words(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    coded = words.dictionary_encode()
    cost, chars = word_costs(m, coded.dictionary)
    index = coded.indices.to_numpy()
    chars = np.where(pc.binary_length(coded.dictionary).to_numpy() > 0, chars, 0)
    n = np.add.reduceat(chars[index], starts)
    total = np.stack([np.add.reduceat(np.where(chars > 0, cost[:, i], 0)[index], starts) for i in range(cost.shape[1])], axis=1)
    return total / np.maximum(n, 1)[:, None], n > 0


def _posterior(m: LanguageModel, cost: np.ndarray) -> np.ndarray:
    z = -m.slope * (cost - cost.min(axis=1, keepdims=True))
    e = np.exp(np.clip(z, -700, 0))
    return e / e.sum(axis=1, keepdims=True)


def _calibrated(m: LanguageModel, texts: pd.DataFrame) -> tuple[float, np.ndarray]:
    """(slope of the softmax over -cost with the best log loss, largest cost by language) on labelled texts outside the fit; no limit without any."""
    limit = np.full(len(m.languages), np.inf)
    if not len(texts):
        return 1.0, limit
    cost, ok = text_costs(m, pa.array(texts["text"], pa.string()))
    y = np.array([m.languages.index(x) for x in texts["lang"]])
    best = (np.inf, 1.0)
    for slope in 2.0 ** np.arange(-2, 7):
        m.slope = slope
        loss = -np.log(np.maximum(_posterior(m, cost[ok])[np.arange(ok.sum()), y[ok]], 1e-9)).mean()
        best = min(best, (loss, slope))
    for i in range(len(limit)):
        own = cost[ok & (y == i) & (cost.argmin(axis=1) == i), i]
        limit[i] = SLACK * own.max() if len(own) else np.inf
    return float(best[1]), limit


def identify(docs: DataFrame, model: LanguageModel | None, reject: bool = True) -> DataFrame:
    """docs with lang_pred, score, the calibrated probability of the language with the least cross-entropy, and rejected.

    Null texts, texts without a letter, and all texts without a model are `und` with score 0 and rejected. So are texts whose
    cross-entropy is above the limit of their language: with reject they are `und`, otherwise rejected only says so. Ties go to the first language by name. Own columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    at = docs.schema.names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in sliced(batch, "text"):
                names, score, out = np.full(part.num_rows, UNDECIDED, object), np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                if m is not None and part.num_rows:
                    cost, ok = text_costs(m, part.column(at))
                    p, best = _posterior(m, cost), cost.argmin(axis=1)
                    score = np.where(ok, p[np.arange(len(best)), best], 0.0)
                    out = ~ok | (cost[np.arange(len(best)), best] > (m.limit[best] if m.limit is not None else np.inf))
                    sure = ~out if reject else ok
                    names[sure] = np.array(m.languages, object)[best[sure]]
                    score = np.where(sure, score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score), pa.array(out)], [*part.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields) + list(StructType.fromDDL("lang_pred string, score double, rejected boolean").fields)))


@query
def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(learn), reject=False)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
