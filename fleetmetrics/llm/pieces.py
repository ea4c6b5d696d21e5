"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetmetrics.llm.common import SLICE_BYTES, query, sliced, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Chunks of more bytes are segmented one by one.
LONG = 96
#: Text bytes that a task of encode_pieces() works on at a time: ids and their places are some twenty times that.
ENCODE_BYTES = 1_500_000


@dataclass
class Pieces:
    """A vocabulary: bytes of each id with the marker as a space, log scores, the byte ids, and the trie."""

    surface: list[bytes]
    score: np.ndarray
    byte_id: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    fallback: float
    newline_alone: bool

    @property
    def longest(self) -> int:
        return max(map(len, self.surface))


def double_array(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie of (key, value): the child of s by byte c is base[s] + c + 1 where check has s."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, v in keys:
        at = 0
        for c in key:
            nxt = children[at].get(c)
            if nxt is None:
                nxt = children[at][c] = len(children)
                children.append({})
                values.append(-1)
            at = nxt
        values[at] = v
    size = 1 << (2 * len(children) + 1024).bit_length()
    base, check, value, free = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), bytearray(b"\1") * size
    free[0], check[0] = 0, 0
    place, first, todo = [0] * len(children), 1, [0]
    for node in todo:
        kids = children[node]
        value[place[node]] = values[node]
        if not kids:
            continue
        codes = sorted(kids)
        first = free.find(1, first)
        at = max(first, codes[0] + 1)
        while True:
            at = free.find(1, at)
            b = at - codes[0] - 1
            if all(free[b + c + 1] for c in codes):
                break
            at += 1
        base[place[node]] = b
        for c in codes:
            free[b + c + 1], check[b + c + 1], place[kids[c]] = 0, place[node], b + c + 1
            todo.append(kids[c])
    end = int(np.flatnonzero(check >= 0).max()) + 258
    return base[:end].copy(), check[:end].copy(), value[:end].copy()


def load_pieces(path: str = MODEL, rank_scores: bool = True) -> Pieces:
    """Reads a SentencePiece model file on the driver.

    rank_scores: the file holds merge ranks, not log probabilities (a BPE vocabulary); the score of the piece of
    rank r is then the log of Zipf's law, ln(1 / (r + 1)) less the log of its sum. A unigram file's own scores are
    used as they are otherwise. A character without a piece costs the lowest score less 10, as bytes. Scores are
    rounded to 2 ** -20, so that sums are exact and equal paths tie wherever they stand in a text.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no byte pieces")
    surface = [b"" if special[i] else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    for b, i in byte_ids.items():
        surface[i] = bytes([b])
    score = np.array([sp.get_score(i) for i in range(n)], float)
    normal = [i for i in range(n) if not special[i] and not sp.is_byte(i) and surface[i]]
    if any(b" " in surface[i].lstrip(b" ") for i in normal):
        raise ValueError("a piece has a marker after other characters")
    if rank_scores:
        rank = np.argsort(np.argsort(-score[normal], kind="stable"))
        score[normal] = -np.log(rank + 1.0) - np.log(np.sum(1 / (1 + np.arange(len(normal)))))
    score = np.round(score * 2**20) / 2**20
    base, check, value = double_array([(surface[i], i) for i in normal])
    ids = np.array([byte_ids[b] for b in range(256)], np.int32)
    return Pieces(surface, score, ids, base, check, value, float(score[normal].min()) - 10, not any(b"\n" in surface[i] for i in normal))


def _char_length(byte: np.ndarray) -> np.ndarray:
    return np.where(byte < 0x80, 1, np.where(byte < 0xE0, 2, np.where(byte < 0xF0, 3, 4)))


def viterbi_one(p: Pieces, data: bytes) -> list[int]:
    """Best segmentation of one chunk; of equal scores the one whose last piece is longest, and so on from the end."""
    n = len(data)
    best, back, ids = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0], base, check, value, score = 0.0, p.base, p.check, p.value, p.score
    for s in range(n):
        if best[s] == -1e300:
            continue
        width, node, alone = int(_char_length(np.array(data[s]))), 0, False
        for e in range(s, n):
            nxt = int(base[node]) + data[e] + 1
            if nxt >= len(check) or check[nxt] != node:
                break
            node = nxt
            v = int(value[node])
            if v >= 0:
                alone = alone or e + 1 - s == width
                if best[s] + score[v] > best[e + 1]:
                    best[e + 1], back[e + 1], ids[e + 1] = best[s] + score[v], s, v
        e = min(n, s + width)
        if not alone and best[s] + p.fallback > best[e]:
            best[e], back[e], ids[e] = best[s] + p.fallback, s, -1
    out, at = [], n
    while at > 0:
        s = back[at]
        out += [ids[at]] if ids[at] >= 0 else [int(p.byte_id[b]) for b in reversed(data[s:at])]
        at = s
    return out[::-1]


def viterbi_many(p: Pieces, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, count per chunk) of many chunks of at most LONG bytes, all segmented at once, byte by byte."""
    n, longest = len(start), int(size.max(initial=0))
    best = np.full((longest + 1, n), -np.inf)
    back, ids = np.zeros((longest + 1, n), np.int16), np.full((longest + 1, n), -1, np.int32)
    best[0] = 0
    for s in range(longest):
        row = np.flatnonzero((size > s) & (best[s] > -np.inf))
        from_, width = best[s, row], _char_length(data[start[row] + s])
        alone, live, node = np.zeros(len(row), bool), np.arange(len(row)), np.zeros(len(row), np.int32)
        e = s
        while len(live):
            live_row = row[live]
            nxt = p.base[node] + data[start[live_row] + e] + 1
            ok = p.check[nxt] == node
            live, node = live[ok], nxt[ok]
            e += 1
            v = p.value[node]
            hit = v >= 0
            at, pos, got = row[live[hit]], live[hit], v[hit]
            alone[pos[e - s == width[pos]]] = True
            total = from_[pos] + p.score[got]
            up = total > best[e, at]
            best[e, at[up]], back[e, at[up]], ids[e, at[up]] = total[up], s, got[up]
            more = size[row[live]] > e
            live, node = live[more], node[more]
        lone = np.flatnonzero(~alone)
        r, to = row[lone], np.minimum(s + width[lone], size[row[lone]])
        total = from_[lone] + p.fallback
        up = total > best[to, r]
        best[to[up], r[up]], back[to[up], r[up]], ids[to[up], r[up]] = total[up], s, -1
    # from the ends back: the piece, or the bytes, that end at each position of the path
    out = np.full((longest, n), -1, np.int32)
    at, every = size.astype(np.int64).copy(), np.arange(n)
    live = every[at > 0]
    while len(live):
        end = at[live]
        prev, piece = back[end, live].astype(np.int64), ids[end, live]
        whole = piece >= 0
        out[end[whole] - 1, live[whole]] = piece[whole]
        for k in range(4):
            b = live[~whole][end[~whole] - k > prev[~whole]]
            q = at[b] - k - 1
            out[q, b] = p.byte_id[data[start[b] + q]]
        at[live] = prev
        live = live[prev > 0]
    flat = out.T
    used = flat >= 0
    return flat[used], used.sum(axis=1)


class Codec:
    """Encodes and decodes Arrow arrays of texts; made once in a task."""

    def __init__(self, p: Pieces):
        self.p = p
        self.bytes = pa.array(p.surface, pa.binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, end of each text in them). A null text is like an empty one.

        A text is a space, the marker of its first word, and the text. No piece has a space after another
        character, and (where that holds) none has a newline, so the best segmentation is that of its chunks,
        each a run of spaces with what follows it; equal chunks are segmented once.
        """
        p = self.p
        joined = pc.binary_join_element_wise("", texts.cast(pa.string()).fill_null(""), " ")
        sizes = pc.binary_length(joined).to_numpy()
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(joined.cast(pa.binary()).to_pylist()), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[np.concatenate([[0], ends[:-1]])] = True
        if p.newline_alone:
            line = data == 10
            cut |= line
            cut[1:] |= line[:-1]
        start = np.flatnonzero(cut)
        offsets = np.append(start, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        flat = np.frombuffer(words.buffers()[2], np.uint8)[np.frombuffer(words.buffers()[1], np.int32)[words.offset] :]
        counts, parts = np.zeros(len(words), np.int64), []
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= LONG]
        for block in np.split(short, np.flatnonzero(np.diff(size[short] // 8)) + 1) if len(short) else []:
            for i in range(0, len(block), 20_000):
                part = block[i : i + 20_000]
                got, n = viterbi_many(p, flat, at[part], size[part])
                counts[part] = n
                parts.append((part, got))
        for i in order[len(short) :]:
            got = viterbi_one(p, flat[at[i] : at[i] + size[i]].tobytes())
            counts[i] = len(got)
            parts.append((np.array([i]), np.array(got, np.int32)))
        where = np.concatenate([[0], np.cumsum(np.concatenate([counts[q] for q, _ in parts]))])[:-1]
        first = np.empty(len(words), np.int64)
        first[np.concatenate([q for q, _ in parts])] = where
        pool = np.concatenate([got for _, got in parts])
        lens = counts[index]
        stop = np.cumsum(lens)
        ids = pool[np.repeat(first[index] - (stop - lens), lens) + np.arange(int(stop[-1]))]
        last_chunk = np.searchsorted(start, ends, "left") - 1
        return ids, stop[last_chunk]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the id runs: pieces joined, markers as spaces, the first space off; bad UTF-8 gives U+FFFD."""
        taken = self.bytes.take(pa.array(ids, pa.int32()))
        size = np.cumsum(pc.binary_length(taken).to_numpy()) if len(ids) else np.zeros(0, np.int64)
        data = taken.buffers()[2].to_pybytes() if len(ids) else b""
        bounds = np.concatenate([[0], size])[np.concatenate([[0], ends]).astype(np.int64)]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def encode_pieces(docs: DataFrame, path: str = MODEL, rank_scores: bool = True) -> DataFrame:
    """docs with `ids` (array of int), the pieces of the whole text; a null or empty text is the marker alone.

    Own columns named ids are replaced. The vocabulary (some 2 MB, fixed by its file) is broadcast. White space,
    literal markers and characters without a piece all survive: the latter two as bytes.
    """
    return _mapped(docs.drop("ids"), "ids array<int>", load_pieces(path, rank_scores), _ids, ENCODE_BYTES)


def decode_pieces(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows with `decoded`, the text of their `ids`; null and empty ids give ''. Null ids in the array are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(load_pieces(path))
    rows = rows.drop("decoded")
    at = rows.schema.names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                lists = [[x for x in (v or []) if x is not None] for v in part.column(at).to_pylist()]
                ends = np.cumsum([len(x) for x in lists])
                ids = np.array([x for v in lists for x in v], np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codec.decode(ids, ends), pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, _schema(rows, "decoded string"))


def _ids(codec: Codec, texts: pa.Array) -> list[pa.Array]:
    ids, ends = codec.encode(texts)
    return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))]


def _digest(codec: Codec, texts: pa.Array) -> list[pa.Array]:
    """Of each text: pieces, byte pieces, SHA-256 of the ids as little-endian 32-bit numbers, and of the decoded text."""
    import hashlib

    ids, ends = codec.encode(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    is_byte = np.zeros(len(codec.p.surface), np.int64)
    is_byte[codec.p.byte_id] = 1
    run = np.concatenate([[0], np.cumsum(is_byte[ids])])
    little = ids.astype("<i4")
    sha = [hashlib.sha256(little[a:b].tobytes()).hexdigest() for a, b in zip(starts, ends)]
    back = [hashlib.sha256(t.encode()).hexdigest() for t in codec.decode(ids, ends)]
    return [pa.array(ends - starts, pa.int64()), pa.array(run[ends] - run[starts], pa.int64()), pa.array(sha), pa.array(back)]


def _schema(df: DataFrame, more: str) -> StructType:
    return StructType(list(df.schema.fields) + list(StructType.fromDDL(more).fields))


def _mapped(docs: DataFrame, more: str, pieces: Pieces, make, at_once: int = SLICE_BYTES) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    at, names = docs.schema.names.index("text"), StructType.fromDDL(more).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for part in sliced(batch, "text", at_once):
                yield pa.RecordBatch.from_arrays([*part.columns, *make(codec, part.column(at))], [*part.schema.names, *names])

    return docs.mapInArrow(run, _schema(docs, more))


@query
def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = _mapped(docs, "n_ids long, n_bytes long, ids_sha256 string, decoded_sha256 string", load_pieces(), _digest)
    round_trip = F.col("decoded_sha256") == F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return out.select("doc_id", "n_ids", "n_bytes", "ids_sha256", "decoded_sha256", round_trip.alias("round_trip"))
