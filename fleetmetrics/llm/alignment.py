"""Cross-tokenizer alignment: token-byte incidence matrices in CSR, whose products are the links between two tokenizers' tokens."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetmetrics.llm.common import query, sliced, table, written

A_PATH, B_PATH = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Text bytes whose chunks are aligned together.
BLOCK_BYTES = 5_000_000


@dataclass
class Csr:
    """A sparse matrix by rows: row i has value[start[i]:start[i + 1]] in the columns index[start[i]:start[i + 1]]."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.start) - 1

    def row_of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(self.rows), np.diff(self.start))

    def transposed(self) -> Csr:
        order = np.argsort(self.index, kind="stable")
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.index, minlength=self.columns))]), self.row_of()[order], self.value[order], self.rows)


def incidence(ends: np.ndarray, columns: int) -> Csr:
    """Tokens by bytes: token i has the bytes from the end of the token before it to ends[i]."""
    start = np.concatenate([[0], ends]).astype(np.int64)
    n = int(start[-1])
    return Csr(start, np.arange(n), np.ones(n, np.int64), columns)


def membership(group: np.ndarray, groups: int) -> Csr:
    """Tokens by groups: one entry a token."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def product(a: Csr, b: Csr) -> Csr:
    """a times b by Gustavson's rule: row i is the sum of the rows of b that row i of a names, each times its value.

    All rows are expanded at once; entries of one row and column are then added. Rows of banded matrices come out in
    order, others are sorted.
    """
    width = np.diff(b.start)[a.index]
    upto = np.cumsum(width)
    at = np.repeat(b.start[a.index] - (upto - width), width) + np.arange(int(upto[-1]) if len(upto) else 0)
    key, value = np.repeat(a.row_of(), width) * b.columns + b.index[at], np.repeat(a.value, width) * b.value[at]
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    own = key[first]
    start = np.concatenate([[0], np.cumsum(np.bincount(own // max(b.columns, 1), minlength=a.rows))])
    return Csr(start.astype(np.int64), own % max(b.columns, 1), np.add.reduceat(value, first) if len(first) else value, b.columns)


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, other bytes for U+0100 and up in turn."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, with the bytes of each of their ids. Made once in a task, from the bytes of their files."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        byte, size = _byte_of(), self.a.get_vocab_size()
        added = {t["id"]: t["content"].encode() for t in json.loads(a).get("added_tokens", [])}
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        a_bytes = [added[i] if i in added else bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for i, t in enumerate(names)]
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.b.get_piece_size())]
        self.bytes = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.size = [np.array([len(t) for t in x], np.int64) for x in (a_bytes, b_bytes)]
        self.breaks, self.newline = self.breaks_before(), self.newline_alone()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B of texts that begin with a space, which B adds by itself."""
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([x[1:] for x in texts], num_threads=1)

    def encode_one(self, text: str) -> tuple[list[int], list[int]]:
        """The same of any chunk: one without a space before it is read by B after a newline, which is a piece of its own."""
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]) if text[0] == " " else self.b.encode("\n" + text)[2:]

    def breaks_before(self) -> bytes:
        """The punctuation that ends a chunk after a letter: A's words end there, and B's, if none of its pieces goes on over it."""
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        return bytes(c for c in b".,;:!?" if not any(re.search(rf"[A-Za-z]\{chr(c)}", x) for x in names))

    def newline_alone(self) -> bool:
        return not any("\n" in self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))


#: Bytes of joined chunks that are encoded at a time.
JOINED = 4096
#: Stands before a chunk that begins with no space where chunks are joined.
CARRIER = b" a"


def encode_chunks(t: Tokenizers, chunks: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(good, (ids, how many of each chunk) by A and by B) of different chunks; a chunk that a tokenizer doesn't give back isn't good and has no tokens.

    Chunks are joined and encoded together, which is several times faster; one that ends in white space, and those of a
    joined text whose tokens don't end where chunks do, are encoded alone.
    """
    n = len(chunks)
    offsets, data = _buffers(chunks)
    last = offsets[1:] - 1
    order = np.flatnonzero(_no_space(data)[last])
    lead = np.where(data[offsets[:-1][order]] == 32, 0, len(CARRIER))
    carrier = pa.array([b"", CARRIER], pa.binary()).take(pa.array((lead > 0).astype(np.int32)))
    at, joined = _buffers(pc.binary_join_element_wise(carrier, chunks.take(pa.array(order)), b""))
    first = np.flatnonzero(np.concatenate([[True], np.diff(at[:-1] // JOINED) > 0])) if len(order) else np.zeros(0, np.int64)
    bounds = np.append(first, len(order))
    texts = [joined[at[a] : at[b]].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
    alone = [np.setdiff1d(np.arange(n), order)]
    whose: list[list[np.ndarray]] = [[], []]
    found: list[list[np.ndarray]] = [[], []]
    for i in range(0, len(texts), 16):
        for k, pair in enumerate(zip(*t.encode(texts[i : i + 16])), i):
            a, b = bounds[k], bounds[k + 1]
            ends, drop = at[a + 1 : b + 1] - at[a], at[a:b] - at[a] + lead[a:b]
            need, own = np.union1d(ends, drop[lead[a:b] > 0]), []
            for ids, of, size in zip(pair, t.bytes, t.size):
                ids = np.array(ids, np.int64)
                stop = np.cumsum(size[ids])
                hit = np.searchsorted(stop, need)
                if stop[-1] != len(joined[at[a] : at[b]]) or (stop[np.minimum(hit, len(stop) - 1)] != need).any() or not np.array_equal(_buffers(of.take(pa.array(ids)))[1], joined[at[a] : at[b]]):
                    break
                chunk = np.searchsorted(ends, stop)
                keep = stop > drop[chunk]
                own.append((order[a + chunk[keep]], ids[keep]))
            if len(own) < 2:
                alone.append(order[a:b])
                continue
            for side, (c, ids) in enumerate(own):
                whose[side].append(c)
                found[side].append(ids)
    good = np.ones(n, bool)
    for i in np.concatenate(alone):
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        pair = t.encode_one(raw.decode())
        good[i] = all(b"".join(of[x].as_py() for x in ids) == raw for ids, of in zip(pair, t.bytes))
        for side, ids in enumerate(pair if good[i] else ()):
            whose[side].append(np.full(len(ids), i))
            found[side].append(np.array(ids, np.int64))
    out = []
    for side in (0, 1):
        c, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (whose[side], found[side]))
        out.append((ids[np.argsort(c, kind="stable")], np.bincount(c, minlength=n)))
    return good, out


def _buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary array."""
    if not len(a):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


@dataclass
class Aligned:
    """Some texts, one after another, as one block-diagonal problem. n_*: of each text. ids: of all tokens of the texts in turn."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    groups: int
    links: Csr  # A tokens by B tokens, bytes in common
    good: np.ndarray

    def shared_groups(self) -> Csr:
        """A tokens by B tokens: those of one group."""
        return product(membership(self.a_group, self.groups), membership(self.b_group, self.groups).transposed())

    def link_ids(self) -> np.ndarray:
        """The id pair of each link as one number: A's id times 2 ** 32 and B's."""
        return (self.a[self.links.row_of()] << 32) | self.b[self.links.index]

    def group_texts(self) -> pa.Array:
        """a1,a2|b1;a3|b2,b3 of each text."""
        sides = []
        for ids, group in ((self.a, self.a_group), (self.b, self.b_group)):
            ends = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=self.groups))]).astype(np.int32)
            sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids).cast(pa.string())), ","))
        ends = np.concatenate([[0], np.cumsum(self.n_groups)]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.binary_join_element_wise(*sides, "|")), ";")


def align(t: Tokenizers, chunks: pa.Array) -> Aligned:
    """Aligns whole texts that begin with a space, or chunks of them (binary, none empty)."""
    good, sides = encode_chunks(t, chunks)
    size = np.where(good, np.diff(_buffers(chunks)[0]), 0)
    total, text_ends = int(size.sum()), np.cumsum(size)
    flat, counts = [x[0] for x in sides], [x[1] for x in sides]
    ends = [np.cumsum(width[ids]) for ids, width in zip(flat, t.size)]
    common = np.intersect1d(*ends, assume_unique=True)  # no token is empty, so ends differ
    n_groups = np.diff(np.concatenate([[0], np.searchsorted(common, text_ends, "right")]))
    links = product(incidence(ends[0], total), incidence(ends[1], total).transposed())
    return Aligned(*counts, n_groups, *flat, *[np.searchsorted(common, e) for e in ends], len(common), links, good)


def align_by_parts(t: Tokenizers, chunks: pa.Array, part_bytes: int = 1 << 19) -> Aligned:
    """align(), some chunks at a time, whose matrices are blocks of the whole."""
    offsets = _buffers(chunks)[0]
    cuts = np.flatnonzero(np.diff(offsets[:-1] // part_bytes, prepend=-1) > 0) if len(chunks) else np.zeros(0, np.int64)
    parts = [align(t, chunks.slice(a, b - a)) for a, b in zip(cuts, np.append(cuts[1:], len(chunks)))] or [align(t, chunks)]
    joined = {n: np.concatenate([getattr(p, n) for p in parts]) for n in ("n_a", "n_b", "n_groups", "a", "b", "good")}
    before = np.cumsum([[0, 0, 0], *[[p.groups, len(p.b), p.links.start[-1]] for p in parts]], axis=0)
    group = {n: np.concatenate([getattr(p, n) + g for p, (g, _, _) in zip(parts, before)]) for n in ("a_group", "b_group")}
    start = np.concatenate([[0], *[p.links.start[1:] + k for p, (_, _, k) in zip(parts, before)]])
    links = Csr(start, np.concatenate([p.links.index + k for p, (_, k, _) in zip(parts, before)]), np.concatenate([p.links.value for p in parts]), int(before[-1][1]))
    return Aligned(**joined, **group, groups=int(before[-1][0]), links=links)


_MAYBE_SPACE = np.zeros(256, bool)
_MAYBE_SPACE[[*range(0x21), 0x7F, *range(0x80, 0x8F), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _no_space(data: np.ndarray) -> np.ndarray:
    """Where a byte is surely not the last one of a white-space character, of Unicode's too."""
    sure = ~_MAYBE_SPACE[data]
    sure[1:] |= data[:-1] == 0xC3  # Latin letters, whose last bytes may look like those
    return sure


def chunks_of(data: np.ndarray, text_start: np.ndarray, breaks: bytes = b"", newline: bool = False) -> np.ndarray:
    """Where chunks start in texts that lie one after another, each with a space before it.

    A chunk starts where a text does; at a space (or, if `newline`, a newline) after a character that is surely no white space; and at one
    of `breaks` after an ASCII letter. No chunk is the last byte of a text alone.

    Neither tokenizer has a token over such a place, and what it makes of a chunk depends on that chunk only: A's words take one
    space before them at most and end at punctuation, and white space before a place would be the last thing that could look
    ahead; B's pieces have spaces at their start only, and none has a newline or goes on over a break.
    """
    here = data == 32
    if newline:
        here |= data == 10
    cut = np.zeros(len(data), bool)
    cut[1:] = here[1:] & _no_space(data)[:-1]
    if breaks:
        is_break = np.zeros(256, bool)
        is_break[list(breaks)] = True
        cut[1:] |= is_break[data[1:]] & _LETTER[data[:-1]]
    cut[np.append(text_start[1:], len(data)) - 1] = False
    cut[text_start] = True
    return np.flatnonzero(cut)


def _files(spark: SparkSession, a_path: str, b_path: str):
    """Both vocabularies (some 2.6 MB, fixed by their files), broadcast."""
    return spark.sparkContext.broadcast((Path(a_path).read_bytes(), Path(b_path).read_bytes()))


def _text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def aligned_tokens(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH) -> DataFrame:
    """docs with a_ids and b_ids, links (array of a, b, bytes: places in a_ids and b_ids whose byte ranges overlap, and by how much),
    group_links (array of a, b: places in one group) and groups (array of a_end, b_end: places before which each group ends).

    Both tokenizers read a space and the text, as the second one adds it. Null and empty texts, and texts that a tokenizer
    doesn't give back byte for byte, have empty arrays. Own columns of these names are replaced. A group has few tokens in
    usual texts; where the tokenizers never agree inside a long run, its shared-group links are as many as the product
    of its tokens, while links are fewer than the tokens.
    """
    more = "a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int, bytes: int>>, group_links array<struct<a: int, b: int>>, groups array<struct<a_end: int, b_end: int>>"
    out = StructType.fromDDL(more)
    docs = docs.drop(*out.names)
    files, at = _files(docs.sparkSession, a_path, b_path), docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(*files.value)
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                cells: list[list] = [[] for _ in out.names]
                for text in part.column(at).to_pylist():
                    x = align(t, pa.array([b" " + text.encode()] if text else [], pa.binary()))
                    g = x.shared_groups()
                    cells[0].append(x.a.tolist())
                    cells[1].append(x.b.tolist())
                    cells[2].append([{"a": a, "b": b, "bytes": n} for a, b, n in zip(x.links.row_of().tolist(), x.links.index.tolist(), x.links.value.tolist())])
                    cells[3].append([{"a": a, "b": b} for a, b in zip(g.row_of().tolist(), g.index.tolist())])
                    ends = [np.cumsum(np.bincount(v, minlength=x.groups)).tolist() for v in (x.a_group, x.b_group)]
                    cells[4].append([{"a_end": a, "b_end": b} for a, b in zip(*ends)])
                types = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.int32())])), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.struct([("a_end", pa.int32()), ("b_end", pa.int32())]))]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, ty) for c, ty in zip(cells, types)]], [*part.schema.names, *out.names])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, StructType([*docs.withColumn("text", F.col("text").cast("string")).schema.fields, *out.fields]))


class _Block:
    """Some documents, whose different chunks are aligned once."""

    def __init__(self, t: Tokenizers, texts: list[bytes]):
        size = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
        data = np.frombuffer(b"".join(b" " + x for x in texts if x), np.uint8)
        stop = np.cumsum(size)
        start = (stop - size)[size > 0]
        at = chunks_of(data, start, t.breaks, t.newline) if len(data) else np.zeros(0, np.int64)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        self.chunk = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        #: Chunks before the end of each document.
        self.ends = np.searchsorted(at, stop, "left")
        self.x = align_by_parts(t, chunks.dictionary)
        bad = np.concatenate([[0], np.cumsum(~self.x.good[self.chunk])])
        self.good = bad[self.ends] == bad[np.concatenate([[0], self.ends[:-1]])]

    def sums(self, of_chunk: np.ndarray) -> np.ndarray:
        """The values of a document's chunks, summed; 0 for documents that aren't good."""
        upto = np.concatenate([[0], np.cumsum(of_chunk[self.chunk])])
        return np.where(self.good, upto[self.ends] - upto[np.concatenate([[0], self.ends[:-1]])], 0)

    def chunk_links(self) -> np.ndarray:
        """Links before the end of each different chunk."""
        return self.x.links.start[np.cumsum(self.x.n_a)]

    def group_digests(self) -> list[str]:
        texts = pc.binary_join_element_wise(self.x.group_texts().cast(pa.binary()), b"", b";")
        out, begin = [], 0
        for end, good in zip(self.ends.tolist(), self.good.tolist()):
            h = hashlib.sha256()
            for i in range(begin, end, 100_000) if good else ():
                part = _buffers(texts.take(pa.array(self.chunk[i : min(end, i + 100_000)])))[1]
                h.update(part if end > i + 100_000 else part[:-1])
            out.append(h.hexdigest() if good and end > begin else "")
            begin = end
        return out


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for part in sliced(batch, "text"):
            for i, x in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                if texts and size + len(x) > limit:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(x)
                size += len(x)
    if texts:
        yield ids, texts


_PARTS = "kind string, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, at int, n long, size long, packed binary"


def _parts(docs: DataFrame, a_path: str, b_path: str, block_bytes: int) -> DataFrame:
    """Three kinds of rows of each block of documents: doc (counts and digest), pair (an id pair, its place in the block and its links there), packed (the chunks of each document, and each chunk's links as such places)."""
    files = _files(docs.sparkSession, a_path, b_path)
    schema = StructType.fromDDL(_PARTS)

    def rows(length: int, **cells) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(cells[f.name], f.type) if f.name in cells else pa.nulls(length, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task = Tokenizers(*files.value), TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(_blocks(batches, block_bytes)):
            b, block, n = _Block(t, texts), (task << 24) + k, len(ids)
            link_end = b.chunk_links()
            n_links = np.diff(np.concatenate([[0], link_end]))
            yield rows(n, kind=["doc"] * n, block=[block] * n, doc_id=ids, n_a=b.sums(b.x.n_a), n_b=b.sums(b.x.n_b), n_groups=b.sums(b.x.n_groups), n_links=b.sums(n_links), groups_sha256=b.group_digests(), at=np.arange(n, dtype=np.int32))
            pair, place = np.unique(b.x.link_ids(), return_inverse=True)
            used = np.bincount(b.chunk[np.repeat(b.good, np.diff(np.concatenate([[0], b.ends])))], minlength=len(b.x.good))
            count = np.bincount(place, weights=np.repeat(used, n_links), minlength=len(pair)).astype(np.int64)
            for i in range(0, len(pair), 10_000):
                m = len(pair[i : i + 10_000])
                yield rows(m, kind=["pair"] * m, block=[block] * m, pair=pair[i : i + m], at=np.arange(i, i + m, dtype=np.int32), n=count[i : i + m])
            raw = b"".join(x.astype("<i4").tobytes() for x in (np.array([n, len(b.chunk), len(link_end), len(place)]), np.where(b.good, 1, 0), b.ends, b.chunk, link_end, place))
            yield rows(1, kind=["packed"], block=[block], size=[len(raw)], packed=[pa.compress(raw, "zstd", asbytes=True)])

    return _text(docs.select("doc_id", "text")).mapInArrow(run, schema)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(pair, count, best): the links of each id pair over all documents, and whether none of its B id's pairs has more."""
    counts = written(parts.where("kind = 'pair' and n > 0").groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    # one row for each id of B: bounded by its vocabulary
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, a_path: str = A_PATH, b_path: str = B_PATH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row; aligned_tokens() gives the links themselves.

    An id pair's count is its links in all documents; n_best counts a document's links whose count is the highest of their
    B id, and count_sum adds the counts of its links. groups_sha256 is of a1,a2|b1;a3|b2,b3 with ids in order, '' without
    tokens (null and empty texts, and those that a tokenizer doesn't give back). Repeated rows count each.

    Texts are aligned in blocks of some 5 MB, a longer text alone, and different chunks of a block once, since both
    tokenizers and so the matrices fall apart at chunks. A block asks for the counts of its own pairs only, and gets them back
    beside its packed chunks; so neither the pairs nor the texts meet in one place.
    """
    parts = written(_parts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), a_path, b_path, block_bytes), ["kind"])
    asked = parts.where("kind = 'pair'").select(F.col("block").alias("of"), "pair", F.col("at").alias("place"))
    answers = asked.join(pair_counts(parts), "pair", "left").select("of", "place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(False)).alias("best"))
    own = parts.where("kind in ('doc', 'packed')").select("kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "size", "packed")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def meet(block: pa.Table, told: pa.Table) -> pa.Table:
        docs = block.filter(pc.equal(block["kind"], "doc")).sort_by("at")
        packed = block.filter(pc.equal(block["kind"], "packed"))
        data = np.frombuffer(pa.decompress(packed["packed"][0].as_py(), packed["size"][0].as_py(), "zstd", asbytes=True), "<i4")
        cuts = np.cumsum([4, data[0], data[0], *data[1:3]])
        good, ends, chunk, link_end, place = np.split(data[4:], cuts[1:] - 4)
        at = told["place"].to_numpy()
        begin = np.concatenate([[0], ends[:-1]])
        out = []
        for name in ("best", "count"):
            of_pair = np.zeros(len(at), np.int64)
            of_pair[at] = told[name].cast(pa.int64()).to_numpy()
            upto = np.concatenate([[0], np.cumsum(of_pair[place])])
            of_chunk = upto[link_end] - upto[np.concatenate([[0], link_end[:-1]]).astype(np.int64)]
            total = np.concatenate([[0], np.cumsum(of_chunk[chunk])])
            out.append(np.where(good == 1, total[ends] - total[begin], 0))
        cells = [docs["doc_id"], *[docs[c] for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(out[0]), pa.array(out[1]), docs["groups_sha256"]]
        return pa.Table.from_arrays(cells, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return own.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(meet, schema)


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"))
