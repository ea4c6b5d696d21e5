"""Phrase collocations: suffix pointers routed by their leading words, counted by multikey three-way quicksort."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetmetrics.llm.common import query, sliced, table, written

#: Text bytes whose windows a task counts at a time before they are sent.
BLOCK_BYTES = 10_000_000
#: Words a bucket gets on average.
BUCKET_WORDS = 2_000_000
#: Pairs that are routed by three words are at most this many: each has so large a share of all words, and a bucket's eighth.
MOST_HOT = 65_536

# What ends a piece, and what ends a word inside one.
PIECE_ENDS, WORD_ENDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(WORD_ENDS)], _KIND[list(PIECE_ENDS)] = 1, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Windows:
    """Different windows of up to `most` words of some texts: words (binary), ids (a column for each place, 0 past the piece's end, else word + 1), and how often each occurs."""

    def __init__(self, texts: list[bytes], most: int):
        data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        kind = _KIND[data]
        word = np.concatenate([[False], kind == 0, [False]])
        start, end = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
        piece = np.cumsum(kind == 2, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[word[1:-1]])]).dictionary_encode()
        self.words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.total, base = len(ids), len(self.words) + 1
        self.word_counts = np.bincount(ids, minlength=base - 1)
        columns = [ids + 1]
        for k in range(1, most):
            nxt = np.zeros(self.total, np.int64)
            same = piece[k:] == piece[:-k] if k < self.total else np.zeros(0, bool)
            nxt[: len(same)][same] = ids[k:][same] + 1
            columns.append(nxt)
        if base**most < 1 << 62:
            key = columns[0]
            for c in columns[1:]:
                key = key * base + c
            key.sort()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if self.total else np.zeros(0, np.int64)
            key, self.ids = key[first], []
            for _ in range(most):
                self.ids.insert(0, (key % base).astype(np.int32))
                key //= base
            self.counts = np.diff(np.append(first, self.total))
        else:
            code = columns[0]
            for c in columns[1:]:
                _, at, code, self.counts = np.unique(code * base + c, return_index=True, return_inverse=True, return_counts=True)
            self.ids = [c[at].astype(np.int32) for c in columns]


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of about `limit` bytes; longer texts are cut where a piece ends."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for part in sliced(batch, "text"):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary())):
                text = text.as_py()
                while text:
                    cut = len(text)
                    if cut > limit:
                        ends = [text.find(bytes([c]), limit) for c in PIECE_ENDS]
                        cut = min([e + 1 for e in ends if e >= 0], default=cut)
                    held.setdefault(lang, []).append(text[:cut])
                    size[lang] = size.get(lang, 0) + min(cut, len(text))
                    text = text[cut:]
                    if size[lang] >= limit:
                        yield lang, held.pop(lang)
                        del size[lang]
            if sum(size.values()) >= 2 * limit:
                lang = max(size, key=size.get)
                yield lang, held.pop(lang)
                del size[lang]
    yield from held.items()


def _hashes(words: pa.Array, seed: int) -> np.ndarray:
    """A hash of each word, and before them 0 for none."""
    return np.array([0, *[xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()]], np.uint64)


def _pack(words: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Windows with just the words that they use."""
    used = np.unique(np.concatenate(columns))
    used = used[used > 0]
    own = words.take(pa.array(used - 1, pa.int32())).to_pylist()
    wide = np.uint16 if len(used) < 1 << 16 else np.uint32
    ids = [np.where(c > 0, np.searchsorted(used, c) + 1, 0).astype(wide) for c in columns]
    text = b"".join(own)
    head = struct.pack("<qqqq", len(own), len(text), len(counts), np.dtype(wide).itemsize)
    return head + np.array([len(w) for w in own], np.uint32).tobytes() + text + b"".join(c.tobytes() for c in ids) + counts.astype("<i8").tobytes()


def _unpack(raw: bytes, places: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    n_words, n_text, n, wide = struct.unpack_from("<qqqq", raw)
    at = 32
    size = np.frombuffer(raw, np.uint32, n_words, at)
    at += 4 * n_words
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), n_words, [None, pa.py_buffer(offsets), pa.py_buffer(raw[at : at + n_text])])
    at += n_text
    columns = []
    for _ in range(places):
        columns.append(np.frombuffer(raw, np.uint16 if wide == 2 else np.uint32, n, at).astype(np.int32))
        at += wide * n
    return words, columns, np.frombuffer(raw, "<i8", n, at)


def equal_partitions(columns: list[np.ndarray], weights: np.ndarray, least: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, pointers, counts): of each different start of k words one window that has it, and the weight of all that do, where that is least[k - 1] or more.

    Multikey quicksort of the windows by their words, to the last place: a partition is split by the word at its depth
    into less, equal and greater; the equal part has k = depth + 1 words in common, so its weight is their count, and
    is split by the next word. A partition that weighs less than least[depth] holds no frequent start and is abandoned.
    All partitions of a round are split at once. The first word splits by a sort, as routing has dealt by it.
    """
    flat, n = np.concatenate(columns), len(weights)
    if not n:
        return
    ptr = np.argsort(columns[0], kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(columns[0][ptr]) != 0]))
    size, depth = np.diff(np.append(cut, n)), np.ones(len(cut), np.int64)
    total = np.add.reduceat(weights[ptr], cut)
    enough = total >= least[0]
    yield 1, ptr[cut[enough]], total[enough]
    while True:
        # what is left: enough weight, and a place to split by
        keep = (depth < len(columns)) & (total >= np.array([*least, 1])[depth])
        ptr, size, depth = ptr[np.repeat(keep, size)], size[keep], depth[keep]
        if not len(size):
            return
        end = np.cumsum(size)
        start = end - size
        at = depth * n
        probe = np.sort([flat[at + ptr[start]], flat[at + ptr[start + size // 2]], flat[at + ptr[end - 1]]], axis=0)[1]
        part = np.repeat(np.arange(len(size)), size)
        key, pivot = flat[at[part] + ptr], probe[part]
        parts = []
        for hit, deeper in ((key < pivot, 0), (key == pivot, 1), (key > pivot, 0)):
            own = ptr[hit]
            count = np.bincount(part[hit], minlength=len(size))
            some = np.flatnonzero(count)
            if not len(some):
                continue
            count = count[some]
            first = np.cumsum(count) - count
            weight = np.add.reduceat(weights[own], first)
            d = depth[some] + deeper
            if deeper:
                real = probe[some] > 0
                for k in range(2, len(columns) + 1):
                    told = real & (d == k) & (weight >= least[k - 1])
                    if told.any():
                        yield k, own[first[told]], weight[told]
                own, count, weight, d = own[np.repeat(real, count)], count[real], weight[real], d[real]
            parts.append((own, count, d, weight))
        ptr, size, depth, total = (np.concatenate([p[i] for p in parts]) for i in range(4))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _census(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(lang, pair, n): words of each language with a null pair, and pairs of words that have a large share of some block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blocks(batches, block_bytes):
            w = Windows(texts, 2)
            many = (w.counts >= max(16, w.total // (2 * MOST_HOT))) & (w.ids[1] > 0)
            pairs = [f"{w.words[int(a) - 1].as_py().decode()} {w.words[int(b) - 1].as_py().decode()}" for a, b in zip(w.ids[0][many], w.ids[1][many])]
            n = [w.total, *w.counts[many].tolist()]
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array([None, *pairs], pa.string()), pa.array(n, pa.int64())], ["lang", "pair", "n"])

    return rows.mapInArrow(run, "lang string, pair string, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, most: int = 3, least: int = 10, block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS, hot_pair: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, n), (lang, n)): phrases of 1 to `most` words with n >= least occurrences inside pieces, and all words of each language.

    A null text is empty and a null lang is `und`; without words there are no rows. Other columns are not read.

    1. A census finds the number of words, and pairs of words that are hot (in `hot_pair` windows or more, an eighth of
       a bucket; at most MOST_HOT by their share).
    2. Tasks count the windows of some 10 MB of text, so that repeats are sent once, and route them by two leading words,
       those of hot pairs by three. Buckets are as many as the words ask for.
    3. Each bucket sorts its windows by multikey quicksort; equal partitions are counts. Counts of single words and of hot
       pairs come in parts and are summed.
    """
    rows = _rows(docs)
    census = written(_census(rows, block_bytes))
    totals = census.where("pair is null").select("lang", "n")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_from = max(hot_pair or bucket_words // 8, words // MOST_HOT)
    hot = {(r.lang, *r.pair.encode().split(b" ")) for r in census.where("pair is not null").where(F.col("n") >= hot_from).collect()}  # words / hot_from rows at most
    buckets = max(1, -(-words // bucket_words))
    places = max(most, 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _blocks(batches, block_bytes):
            w = Windows(texts, places)
            seed = xxhash.xxh32_intdigest(lang.encode(), 1)
            h = _hashes(w.words, seed)
            turn = [np.uint64(2 * x + 1) for x in (0x4F1B_BCDC_BFA5_3E0B, 0x1F3D_5B79_9D7F_0A51, 0x2545_F491_4F6C_DD1D)]
            bucket_of = lambda v: ((v ^ (v >> np.uint64(29))) % np.uint64(buckets)).astype(np.int64)
            sets = [(1, [np.arange(1, len(w.words) + 1, dtype=np.int32)], w.word_counts, bucket_of(h[1:] * turn[0]))]
            if places > 1:
                lead = h[w.ids[0]] * turn[0] + h[w.ids[1]] * turn[1]
                is_hot = np.zeros(len(w.counts), bool)
                if hot and places > 2:
                    known = {x: i + 1 for i, x in enumerate(w.words.to_pylist())} if any(k[0] == lang for k in hot) else {}
                    pairs = [known[a] * (len(w.words) + 1) + known[b] for l, a, b in hot if l == lang and a in known and b in known]
                    is_hot = np.isin(w.ids[0].astype(np.int64) * (len(w.words) + 1) + w.ids[1], pairs)
                    lead = np.where(is_hot, lead + h[w.ids[2]] * turn[2], lead)
                two = w.ids[1] > 0
                at = bucket_of(lead)
                sets += [(k, [c[m] for c in w.ids], w.counts[m], at[m]) for k, m in ((2, two & ~is_hot), (3, two & is_hot))]
            for kind, columns, counts, at in sets:
                order = np.argsort(at, kind="stable")
                edge = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0, [True]])) if len(order) else []
                for i in range(0, len(edge) - 1, 64):
                    out = []
                    for a, b in zip(edge[i : i + 64], edge[i + 1 : i + 65]):
                        mine = order[a:b]
                        raw = _pack(w.words, [c[mine] for c in columns], counts[mine])
                        out.append((int(at[mine[0]]), lang, kind, len(raw), pa.compress(raw, "zstd", asbytes=True)))
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], ["bucket", "lang", "kind", "size", "windows"])

    def count(group: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for lang in pc.unique(group["lang"]).to_pylist():
            for kind in (1, 2, 3):
                mine = group.filter(pc.and_(pc.equal(group["lang"], lang), pc.equal(group["kind"], kind)))
                if not mine.num_rows:
                    continue
                parts = [_unpack(pa.decompress(b, s, "zstd", asbytes=True), 1 if kind == 1 else places) for b, s in zip(mine["windows"].to_pylist(), mine["size"].to_pylist())]
                coded = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
                index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
                shift = np.cumsum([0, *[len(p[0]) for p in parts]])
                columns = [np.concatenate([np.where(p[1][k] > 0, np.append(index, 0)[p[1][k] - 1 + shift[i]], 0) for i, p in enumerate(parts)]) for k in range(len(parts[0][1]))]
                weights = np.concatenate([p[2] for p in parts])
                need = {1: [1], 2: [least] * places, 3: [1, 1, *[least] * (places - 2)]}[kind]
                for k, ptr, n in equal_partitions(columns, weights, need):
                    if kind == 1 or k > 1:
                        words = [coded.dictionary.take(pa.array(columns[j][ptr] - 1, pa.int32())) for j in range(k)]
                        phrase = pc.binary_join_element_wise(*words, b" ") if k > 1 else words[0]
                        found.append((pa.array([lang] * len(n), pa.string()), pa.array([k] * len(n), pa.int32()), phrase.cast(pa.string()), pa.array(n, pa.int64())))
        schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
        return pa.concat_tables([pa.Table.from_arrays(list(f), schema=schema) for f in found]) if found else schema.empty_table()

    routed = rows.mapInArrow(route, "bucket long, lang string, kind int, size long, windows binary")
    parts = routed.groupBy("bucket").applyInArrow(count, "lang string, words int, phrase string, n long")
    return parts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least), totals


def collocations(docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, inside: int = 50, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of 2 to `most` words of each language, by score, a and phrase.

    a, l and r are the counts of the phrase and of the two parts of the cut with the lowest floor(10^6 a a / (l r)), the
    score; of equal cuts the one with the shorter first part. Phrases inside a longer one with `inside` percent of their
    occurrences or more are left out. n is the number of words of the language. Arithmetic is exact while counts are
    below 10^15. phrase_counts says what odd rows give.
    """
    found, totals = phrase_counts(docs, most, least, **how)
    counts = written(found)
    many = counts.where("words > 1")
    part = lambda a, n: F.array_join(F.slice(F.split("phrase", " "), a, n), " ")
    cuts = many.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "alr"}
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']})")
    best = cuts.select("lang", "phrase", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("c")).groupBy("lang", "phrase", "words", "a").agg(F.min("c").alias("c"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: part(i, n))))
    held = many.where("words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    rows = best.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    long = lambda c: F.col(c).cast("long")
    return first.join(totals, "lang").select("lang", long("rank").alias("rank"), "phrase", long("a").alias("a"), long("c.l").alias("l"), long("c.r").alias("r"), long("n").alias("n"), long("c.score").alias("score"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, unnest(string_split_regex(s, '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS x FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, cut, array_to_string(x[1:cut], ' ') AS lp, array_to_string(x[cut + 1:k], ' ') AS rp FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
 FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = lp JOIN f r ON r.lang = cuts.lang AND r.phrase = rp),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
 FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM kept JOIN n USING (lang) WHERE rank <= 2000
"""
