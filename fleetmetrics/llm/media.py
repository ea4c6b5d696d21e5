"""Copies among images: multiscale corners, orientation-normalised binary tests, Hamming tables and geometric consensus."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm.common import query, table, written
from fleetmetrics.llm.components import components

WORDS = 4  # 64-bit words of a descriptor
PATCH, TURNS, PAD = 9, 36, 14
POINT_BITS = 6  # a point id is the image id and the number of the point
#: A point as it is stored: place, angle, scale of the corner and the words of its descriptor.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f2"), ("scale", "<f2"), ("d", "<u8", (WORDS,))])
#: Images of 64 by 64 pixels, or as many pixels, that a task describes at a time.
IMAGES_AT_ONCE = 16
#: Rows of vectors or images that a task turns into Python objects at a time.
ROWS_AT_ONCE = 256
#: Image pairs that a task holds against each other at a time.
PAIRS_AT_ONCE = 256
#: Points of a bucket that one task holds against each other; a larger bucket is dealt out to several.
BUCKET_AT_ONCE = 1 << 15
#: Point pairs that a task compares at a time.
POINTS_AT_ONCE = 1 << 16


def _pattern(seed: int = 7) -> np.ndarray:
    """(turns, tests, 2 ends, 2 axes) places of the binary tests, turned in steps of a full turn / TURNS."""
    rng = np.random.default_rng(seed)
    ends = np.clip(rng.normal(0, PATCH / 2.2, (64 * WORDS, 2, 2)), -PATCH, PATCH)
    a = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(a), -np.sin(a)], 1), np.stack([np.sin(a), np.cos(a)], 1)], 1)
    return np.rint(np.einsum("aij,tej->atei", turn, ends)).astype(np.int32)


def _blur(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of 2r + 1 pixels, edges repeated; x is (images, height, width)."""
    for axis in (1, 2):
        p = np.pad(x, [(r + 1, r) if i == axis else (0, 0) for i in range(3)], mode="edge").cumsum(axis=axis, dtype=np.float64)
        n = x.shape[axis]
        x = (np.take(p, range(2 * r + 1, n + 2 * r + 1), axis) - np.take(p, range(n), axis)) / (2 * r + 1)
    return x.astype(np.float32)


def _around(x: np.ndarray, r: int) -> np.ndarray:
    """The largest other value in a square of 2r + 1 pixels, -1 beyond the edges; x is (images, height, width)."""
    h, w = x.shape[1:]
    wide = np.pad(x, ((0, 0), (r, r), (r, r)), constant_values=-1)
    row = np.maximum.reduce([wide[:, :, i : i + w] for i in range(2 * r + 1) if i != r])  # without the pixel itself
    whole = np.maximum(row, wide[:, :, r : r + w])
    return np.maximum.reduce([row[:, r : r + h], *(whole[:, i : i + h] for i in range(2 * r + 1) if i != r)])


def _shrink(x: np.ndarray, factor: float) -> np.ndarray:
    h, w = int(x.shape[1] / factor), int(x.shape[2] / factor)
    at = lambda n, m: np.minimum(((np.arange(n) + 0.5) * factor - 0.5), m - 1.001).clip(0)
    r, c = at(h, x.shape[1]), at(w, x.shape[2])
    r0, c0 = r.astype(int), c.astype(int)
    fr, fc = (r - r0)[None, :, None].astype(np.float32), (c - c0)[None, None, :].astype(np.float32)
    top = x[:, r0][:, :, c0] * (1 - fc) + x[:, r0][:, :, c0 + 1] * fc
    low = x[:, r0 + 1][:, :, c0] * (1 - fc) + x[:, r0 + 1][:, :, c0 + 1] * fc
    return top * (1 - fr) + low * fr


def describe(x: np.ndarray, most: int = 48, scales: tuple[float, ...] = (1.0, 1.5)) -> list[np.ndarray]:
    """(image, x, y, angle, scale, descriptor words) of the strongest corners of equally large images.

    Corners are maxima of the smaller eigenvalue of the blurred structure tensor, `most` an image over all scales
    at the strongest. The angle points from the corner to the centroid of its patch, and the tests are turned by it.
    """
    pattern, found = _pattern(), []
    for s in scales:
        im = x if s == 1 else _shrink(_blur(x, 1), s)
        if min(im.shape[1:]) < 8:
            continue
        gy, gx = np.gradient(im, axis=(1, 2))
        a, b, c = _blur(gx * gx, 2), _blur(gx * gy, 2), _blur(gy * gy, 2)
        corner = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
        peak = (corner > _around(corner, 3)) & (corner > 1.0)
        i, r, q = np.nonzero(peak)
        soft = np.pad(_blur(im, 1), ((0, 0), (PAD, PAD), (PAD, PAD)), mode="reflect" if min(im.shape[1:]) > PAD else "edge")
        yy, xx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
        disc = (yy**2 + xx**2 <= PATCH**2).astype(np.float32)
        patch = soft[i[:, None, None], r[:, None, None] + PAD + yy, q[:, None, None] + PAD + xx] * disc
        angle = np.arctan2((patch * yy).sum((1, 2)), (patch * xx).sum((1, 2)))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        p = pattern[turn]
        v = soft[i[:, None, None], np.clip(r[:, None, None] + PAD + p[..., 1], 0, soft.shape[1] - 1), np.clip(q[:, None, None] + PAD + p[..., 0], 0, soft.shape[2] - 1)]
        bits = np.packbits(v[..., 0] < v[..., 1], axis=1).view(">i8").astype(np.int64)
        found.append([i, (q + 0.5) * s, (r + 0.5) * s, angle, np.full(len(i), s), bits, corner[i, r, q]])
    if not found:
        return [np.zeros(0)] * 5 + [np.zeros((0, WORDS), np.int64)]
    cols = [np.concatenate(z) for z in zip(*found)]
    order = np.lexsort((-cols[6], cols[0]))
    first = np.searchsorted(cols[0][order], cols[0][order])
    keep = order[np.arange(len(order)) - first < most]
    return [z[keep] for z in cols[:6]]


Batches = Iterator[pa.RecordBatch]


def _few(batches: Batches) -> Batches:
    """The batches in parts of ROWS_AT_ONCE rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(i, ROWS_AT_ONCE)


def described(images: DataFrame, most: int = 48, draw: Callable[[Batches], Batches] | None = None) -> DataFrame:
    """(img, same, n_points, points) of images (img, height, width, pixels: 8-bit grey, row by row), one row each.

    same is equal for equal images, points are the bytes of POINT records. Null pixels, sizes that don't fit the
    pixels, and images under 8 pixels a side have no points. Pixels are read once and go no further. With `draw` the rows
    are what it makes images of, in the task that describes them, so that pixels don't leave it; null ids are left out.
    """

    def run(batches: Batches) -> Batches:
        for batch in _few(draw(batches) if draw else batches):
            batch = batch.select(["img", "height", "width", "pixels"])
            if draw:
                batch = batch.filter(batch.column(0).is_valid())
            img, high, wide, pixels = (batch.column(k).to_pylist() for k in range(4))
            fits = [p is not None and h and w and min(h, w) >= 8 and len(p) == h * w for h, w, p in zip(high, wide, pixels)]
            todo = sorted((i for i, ok in enumerate(fits) if ok), key=lambda i: (high[i], wide[i]))
            points, at = [b""] * batch.num_rows, 0
            while at < len(todo):
                h, w = high[todo[at]], wide[todo[at]]
                end = at
                while end < len(todo) and end - at < max(1, IMAGES_AT_ONCE * 4096 // (h * w)) and (high[todo[end]], wide[todo[end]]) == (h, w):
                    end += 1
                part, at = todo[at:end], end
                x = np.stack([np.frombuffer(pixels[i], np.uint8).reshape(h, w) for i in part]).astype(np.float32)
                own, *cols = describe(x, most)
                made = np.zeros(len(own), POINT)
                for name, col in zip(POINT.names, cols):
                    made[name] = col if name != "d" else col.view(np.uint64)
                cuts = np.searchsorted(own, np.arange(len(part) + 1))
                for k, i in enumerate(part):
                    points[i] = made[cuts[k] : cuts[k + 1]].tobytes()
            same = [f"{h}x{w}:" + (hashlib.sha256(p).hexdigest() if p is not None else "none") for h, w, p in zip(high, wide, pixels)]
            counts = np.array([len(p) // POINT.itemsize for p in points], np.int64)
            yield pa.record_batch([pa.array(img, pa.int64()), pa.array(same), pa.array(counts), pa.array(points, pa.binary())], ["img", "same", "n_points", "points"])

    rows = images if draw else images.where("img is not null").select("img", "height", "width", "pixels")
    return rows.mapInArrow(run, "img long, same string, n_points long, points binary")


def _read(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All points of a column of images, and the row of each."""
    parts = [np.frombuffer(b.as_py(), POINT) for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, POINT), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


class KeyPlan:
    """Which descriptor bits make the keys of each Hamming table.

    Bits are drawn from the half of the tests that a sample finds most balanced. A key has as many bits as bring a
    point together with about one other by chance, by the rate of meetings that keys of 16 bits have in the sample, and
    more, up to `long`, if longer keys meet more often there than that rate lets expect; and there are as many tables as let
    points that differ in `apart` of 256 bits meet with chance `meet`, however many bits the keys have.
    """

    def __init__(self, sample: np.ndarray, points: int, apart: int = 6, meet: float = 0.85, long: int = 48, seed: int = 11):
        rng = np.random.default_rng(seed)
        bits = np.unpackbits(np.ascontiguousarray(sample).view(np.uint8), axis=1, bitorder="little") if len(sample) else np.zeros((0, 64 * WORDS), np.uint8)
        lean = np.abs(bits.mean(axis=0) - 0.5) if len(bits) else np.zeros(64 * WORDS)
        self.pool = np.sort(np.argsort(lean, kind="stable")[: 32 * WORDS])
        gain, n, need = 0.5, len(bits), math.log2(max(2, points))

        def rarity(k: int) -> float:
            """Of two points of the sample that keys of k bits bring together, minus the log of the chance."""
            keys = [np.ascontiguousarray(np.packbits(bits[:, rng.choice(self.pool, k, replace=False)], axis=1)) for _ in range(8)]
            met = [np.unique(x.view(f"V{x.shape[1]}"), return_counts=True)[1] for x in keys]
            return -math.log2(max(np.mean([(c * (c - 1.0)).sum() for c in met]) / (n * (n - 1.0)), 1e-9))

        if n > 1000:
            gain = max(0.2, rarity(16) / 16)
        self.bits = min(len(self.pool), max(12, math.ceil(need / gain)))
        while n > 1000 and self.bits < long and rarity(self.bits) < min(need, 2 * math.log2(n) - 5):
            self.bits += 4
        alike = (1 - apart / (64 * WORDS)) ** self.bits
        self.tables = max(2, math.ceil(math.log(1 - meet) / math.log(1 - alike)))
        self.masks = np.zeros((self.tables, WORDS), np.uint64)
        for t in range(self.tables):
            for b in rng.choice(self.pool, self.bits, replace=False):
                self.masks[t, b // 64] |= np.uint64(1) << np.uint64(b % 64)
        self.turns = rng.integers(1, 1 << 63, (self.tables, WORDS), np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, d: np.ndarray) -> np.ndarray:
        """(tables, points) keys of descriptors, mixed to 64 bits."""
        out = np.zeros((self.tables, len(d)), np.uint64)
        for t in range(self.tables):
            for w in range(WORDS):
                h = (d[:, w] & self.masks[t, w]) * self.turns[t, w]
                out[t] = (out[t] ^ h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
        return out.view(np.int64)


def point_keys(images: DataFrame, plan: KeyPlan, tables: int | None = None) -> DataFrame:
    """(key, id) of every point of (img, points) in the first `tables` tables, in all without that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            img = batch.column(0).to_numpy()
            for i in range(0, batch.num_rows, 512):
                pts, row = _read(batch.column(1).slice(i, 512))
                number = np.arange(len(row)) - np.searchsorted(row, row)
                ids = (img[i : i + 512][row] << POINT_BITS) | number
                for keys in plan.keys(pts["d"])[:tables]:
                    yield pa.record_batch([pa.array(keys), pa.array(ids)], ["key", "id"])

    return images.select("img", "points").mapInArrow(run, "key long, id long")


def _scrambled(img: np.ndarray, turn: int) -> np.ndarray:
    h = img.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def meetings(keyed: DataFrame, near: int = 3, orders: int = 2) -> DataFrame:
    """(a, b, of_a, of_b): pairs of images, a < b, that meet in buckets; of_* has a bit for each of their points that does.

    A quick look that large buckets don't square: it finds most members of a group of copies, so that all_meetings()
    needs only what is left between groups. Buckets are runs of sorted rows and stream by, so one of any size costs its own rows and no memory. Each point meets
    the bucket's first and the `near` before it, which are all pairs of up to five points; in larger buckets also its
    neighbours in `orders` scrambled orders of the images. The orders are the same in all buckets, so what two copies share
    gathers on the same pairs of images.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, first = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # the last rows of the batch before, and the first id of its last bucket
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(key)
            key, ids = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([ids, batch.column(1).to_numpy()])
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            lo = ids[start]
            if first is not None:
                lo = np.where(start == 0, first, lo)
            a, b = [lo[old:]], [ids[old:]]
            for s in range(1, near + 1):
                at = np.arange(max(s, old), len(key))
                at = at[key[at] == key[at - s]]
                a.append(ids[at - s])
                b.append(ids[at])
            size = np.bincount(start, minlength=len(key))[start]
            large = np.flatnonzero(size > near + 2)
            for turn in range(orders):
                order = large[np.lexsort((_scrambled(ids[large] >> POINT_BITS, turn), start[large]))]
                same = start[order[1:]] == start[order[:-1]]
                a.append(ids[order[:-1][same]])
                b.append(ids[order[1:][same]])
            first = lo[-1]
            tail = max(0, len(key) - near)
            tail = max(tail, int(start[-1]))
            key, ids = key[tail:], ids[tail:]
            a, b = np.concatenate(a), np.concatenate(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = (low >> POINT_BITS) != (high >> POINT_BITS)
            low, high = low[apart], high[apart]
            bit = lambda p: np.left_shift(np.int64(1), p & ((1 << POINT_BITS) - 1))
            yield pa.record_batch([pa.array(low >> POINT_BITS), pa.array(high >> POINT_BITS), pa.array(bit(low)), pa.array(bit(high))], ["a", "b", "of_a", "of_b"])

    met = keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long, of_a long, of_b long")
    return met.groupBy("a", "b").agg(F.bit_or("of_a").alias("of_a"), F.bit_or("of_b").alias("of_b"))


KEYED = "key long, id long, comp long, " + ", ".join(f"d{w} long" for w in range(WORDS))


def described_keys(images: DataFrame, plan: KeyPlan) -> DataFrame:
    """KEYED rows of every point of (img, comp, points) in every table, descriptors with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            img, comp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(0, batch.num_rows, 512):
                pts, row = _read(batch.column(2).slice(i, 512))
                ids = (img[i : i + 512][row] << POINT_BITS) | (np.arange(len(row)) - np.searchsorted(row, row))
                words = [pa.array(np.ascontiguousarray(pts["d"][:, w]).view(np.int64)) for w in range(WORDS)]
                for keys in plan.keys(pts["d"]):
                    yield pa.record_batch([pa.array(keys), pa.array(ids), pa.array(comp[i : i + 512][row]), *words], ["key", "id", "comp", *(f"d{w}" for w in range(WORDS))])

    return images.select("img", "comp", "points").mapInArrow(run, KEYED)


def _bucket_pairs(key: np.ndarray, comp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows, in parts, that have the same key and different comps; rows are sorted by both, and pairs within a comp cost nothing."""
    if not len(key):
        return
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(begin[1:], len(key))
    open_ = comp[begin] != comp[end - 1]
    begin, end = begin[open_], end[open_]
    few = end - begin <= 64
    for s in range(1, int((end - begin)[few].max(initial=0))):
        wide = few & (end - begin > s)
        n = (end - begin)[wide] - s
        i = np.repeat(begin[wide], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield i, i + s
    for b, e in zip(begin[~few], end[~few]):
        runs = b + np.flatnonzero(np.concatenate([[False], comp[b + 1 : e] != comp[b : e - 1]]))
        for s, t in zip(runs, np.append(runs[1:], e)):
            at_once = max(1, POINTS_AT_ONCE // (s - b))
            for k in range(s, t, at_once):
                yield np.tile(np.arange(b, s), min(t, k + at_once) - k), np.repeat(np.arange(k, min(t, k + at_once)), s - b)


def _met(keyed: DataFrame, far: int, limit: int | None) -> DataFrame:
    """Rows (a, b, of_a, of_b) of what meets in buckets of up to `limit` rows; of a larger bucket only its key, as b, with null a."""
    width, names = 3 + WORDS, ["a", "b", "of_a", "of_b"]

    def late(key: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], pa.int64()) for x in (None, key, 0, 0)], names)

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, d, held = rows[1], np.ascontiguousarray(rows[3:].T).view(np.uint64), []

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            low, high = np.minimum(a, b), np.maximum(a, b)
            bit = lambda p: np.left_shift(np.int64(1), p & ((1 << POINT_BITS) - 1))
            return pa.record_batch([pa.array(x) for x in (low >> POINT_BITS, high >> POINT_BITS, bit(low), bit(high))], names)

        for i, j in _bucket_pairs(rows[0], rows[2]):
            apart = rows[2][i] != rows[2][j]
            i, j = i[apart], j[apart]
            bits = np.zeros(len(i), np.int16)
            for w in range(WORDS):
                bits += np.bitwise_count(d[i, w] ^ d[j, w])
            near = bits <= far
            if near.any():
                held.append((ids[i[near]], ids[j[near]]))
                if sum(len(x) for x, _ in held) > POINTS_AT_ONCE:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if limit is not None and rows.shape[1] > limit:
            begin = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
            size = np.diff(np.append(begin, rows.shape[1]))
            yield from (late(int(k)) for k in rows[0, begin[size > limit]])
            rows = rows[:, np.repeat(size <= limit, size)]
        yield from pairs(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, passing = np.zeros((width, 0), np.int64), None  # the last bucket so far; the key of one that has grown too large to hold
        for batch in batches:
            rows = np.concatenate([rows, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            if passing is not None:
                rows = rows[:, int(np.searchsorted(rows[0], passing, "right")) :]
            if not rows.shape[1]:
                continue
            passing, cut = None, int(np.searchsorted(rows[0], rows[0, -1], "left"))
            yield from whole(rows[:, :cut])
            rows = rows[:, cut:].copy()
            if limit is not None and rows.shape[1] > limit:
                passing = int(rows[0, 0])
                yield late(passing)
                rows = rows[:, :0]
        yield from whole(rows)

    return keyed.repartition("key").sortWithinPartitions("key", "comp", "id").mapInArrow(run, "a long, b long, of_a long, of_b long")


def all_meetings(keyed: DataFrame, shared: int = 2, far: int = 44, limit: int = BUCKET_AT_ONCE) -> DataFrame:
    """(a, b, shared): images a < b of different comps that share as many points: pairs of points in one bucket that differ in at most `far` bits.

    All pairs of a bucket are looked at. A bucket of more than `limit` points is dealt into parts by hash, and each two
    parts meet in a task of their own.
    """
    least = F.least(F.bit_count(F.bit_or("of_a")), F.bit_count(F.bit_or("of_b"))).cast("int").alias("shared")
    counted = lambda met: written(met.groupBy("a", "b").agg(least).where((F.col("shared") >= shared) | F.col("a").isNull()))
    met = _met(keyed, far, limit)
    found = counted(met)
    large = found.where("a is null").select(F.col("b").alias("key"))
    if large.isEmpty():
        return found
    rows = keyed.join(F.broadcast(large), "key")
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(limit)).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "key").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    cells = dealt.select(cell.alias("key"), *[f.name for f in keyed.schema.fields[1:]])
    return counted(met.where("a is not null").unionByName(_met(cells, far, None)))


def agreeing(a: np.ndarray, b: np.ndarray, far: int = 44, slack: float = 3.0, spread: float = 0.12, turn: float = 0.35) -> np.ndarray:
    """How many points agree on one move, for each row of points a and b, (pairs, points) records padded by scale 0.

    A match is a pair of points of which each is the other's nearest and whose descriptors differ in at most `far` bits, so a
    point has one match at most. Each match proposes the turn, scale and shift that take its one point to the other; the
    answer is the largest number of matches that a proposal takes to their place, within `slack` pixels and the share
    `spread` of the distance from the proposing point, with about the same turn.
    """
    bits = np.bitwise_count(a["d"][:, :, None, 0] ^ b["d"][:, None, :, 0]).astype(np.int16)
    for w in range(1, WORDS):
        bits += np.bitwise_count(a["d"][:, :, None, w] ^ b["d"][:, None, :, w])
    bits[(a["scale"] == 0)[:, :, None] | (b["scale"] == 0)[:, None, :]] = 64 * WORDS + 1
    best, back = bits.argmin(axis=2), bits.argmin(axis=1)
    p, i = np.nonzero((np.take_along_axis(bits, best[:, :, None], 2)[:, :, 0] <= far) & (np.take_along_axis(back, best, 1) == np.arange(a.shape[1])))
    out = np.zeros(len(a), np.int64)
    if not len(p):
        return out
    # matches of a pair side by side, padded
    place = np.arange(len(p)) - np.searchsorted(p, p)
    f, t = np.full((2, len(a), int(place.max()) + 1, 4), np.nan, np.float32)
    for k, name in enumerate(("x", "y", "angle", "scale")):
        f[p, place, k] = a[name][p, i]
        t[p, place, k] = b[name][p, best[p, i]]
    d, r = t[..., 2] - f[..., 2], t[..., 3] / f[..., 3]
    c, s = (r * np.cos(d))[:, :, None], (r * np.sin(d))[:, :, None]
    gx, gy = f[:, None, :, 0] - f[:, :, None, 0], f[:, None, :, 1] - f[:, :, None, 1]
    off = np.hypot(c * gx - s * gy - (t[:, None, :, 0] - t[:, :, None, 0]), s * gx + c * gy - (t[:, None, :, 1] - t[:, :, None, 1]))
    turned = np.abs((d[:, None, :] - d[:, :, None] + np.pi) % (2 * np.pi) - np.pi)
    with np.errstate(invalid="ignore"):
        good = (off <= r[:, :, None] * (slack + spread * np.hypot(gx, gy))) & (turned <= turn)
    return good.sum(axis=2).max(axis=1)


def _padded(blobs: pa.Array) -> np.ndarray:
    parts = [np.frombuffer(x.as_py(), POINT) for x in blobs]
    out = np.zeros((len(parts), max(1, max(map(len, parts), default=1))), POINT)
    for k, x in enumerate(parts):
        out[k, : len(x)] = x
    return out


def consensus(pairs: DataFrame, images: DataFrame, votes: int = 4, far: int = 44) -> DataFrame:
    """(a, b, votes) of those pairs (a, b) of images of which at least `votes` points agree on a move, by all points of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(i, PAIRS_AT_ONCE)
                n = agreeing(_padded(part.column("of_a")), _padded(part.column("of_b")), far)
                yield pa.record_batch([part.column("a"), part.column("b"), pa.array(n)], ["a", "b", "votes"]).filter(pa.array(n >= votes))

    side = lambda s: images.select(F.col("img").alias(s), F.col("points").alias(f"of_{s}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, votes long")


def copy_links(images: DataFrame, votes: int = 4, far: int = 44, shared: int = 2, sample: int = 20_000) -> DataFrame:
    """(node, component) of images (img, points) that are copies of each other, reached by links.

    1. A quick look at the first Hamming table (`meetings`): of each image the candidate with which it shares most is held
       against it with all points of both (`consensus`). This ties most of each group of copies together.
    2. Images of different components that share `shared` points or more in the buckets of all tables, at most `far` bits apart,
       are candidates (`all_meetings`), without a limit to partners. A pair within a component can't change it, so none is
       lost by sparing it.
    3. Of each image the best candidate is held against it, then all candidates that these links leave in different components.
    The key bits are fitted on at most about `sample` points; every point of every image is in every table.
    """
    size = images.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_points"), F.lit(0)).alias("points")).first()
    some = images.orderBy(F.xxhash64("img")).limit(max(1, sample // 48)).select("points").toPandas()["points"]
    seen = [np.frombuffer(x, POINT)["d"] for x in some]
    plan = KeyPlan(np.concatenate(seen) if seen else np.zeros((0, WORDS), np.uint64), int(size["points"]))
    least = F.least(F.bit_count("of_a"), F.bit_count("of_b"))
    sharing = lambda met: written(met.select("a", "b", least.cast("int").alias("shared")).where(F.col("shared") >= shared))
    best_of = lambda found: found.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
    links_of = lambda comps: comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    quick = written(consensus(best_of(sharing(meetings(point_keys(images, plan, 1)))), images, votes, far))
    first = written(components(quick))
    known = images.join(first, images.img == first.node, "left").select("img", F.coalesce("component", "img").alias("comp"), "points")
    found = all_meetings(described_keys(known, plan), shared, far)
    best = best_of(found)
    second = written(components(written(consensus(best, images, votes, far).select("a", "b").unionByName(links_of(first)))))
    of = lambda c: second.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = found.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    rest = written(rest.select("a", "b").join(best, ["a", "b"], "left_anti"))
    more = consensus(rest, images, votes, far).select("a", "b")
    return components(more.unionByName(links_of(second)))


def copy_groups(images: DataFrame, most: int = 48, draw: Callable[[Batches], Batches] | None = None, **how) -> DataFrame:
    """(img, n_points, group): group is the smallest img among those that copies, crops and edits tie together.

    Images with equal pixels are one class from the start; one of them stands for all when points are matched. Images
    without points are tied to equal ones only. Null ids take no part; rows that share an id are one image. most is at
    most 64, ids are below 2 ** 57. described has `draw`, copy_links the other parameters.
    """
    rows = written(described(images, most, draw))
    brief = rows.select("img", "same", "n_points")
    classes = written(brief.groupBy("same").agg(F.min("img").alias("rep")))
    alone = rows.join(classes.select("same", F.col("rep").alias("img")), ["same", "img"], "left_semi").where("n_points > 0")
    alone = written(alone.select("img", "n_points", "points").dropDuplicates(["img"]))
    tied = copy_links(alone, **how)
    reps = classes.join(tied, classes.rep == tied.node, "left").select("same", F.coalesce("component", "rep").alias("group"))
    return brief.join(reps, "same").select("img", "n_points", "group")


IMAGE = pa.schema([("img", pa.int64()), ("vec_id", pa.int64()), ("edited", pa.bool_()), ("height", pa.int32()), ("width", pa.int32()), ("pixels", pa.binary())])


def vector_rows(vectors: DataFrame) -> DataFrame:
    """The rows that drawn() makes images of."""
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))


def drawn(side: int = 64, edit_every: int = 5, seed: int = 3) -> Callable[[Batches], Batches]:
    """What makes IMAGE batches of batches of vector_rows(); see vector_images()."""

    def run(batches: Batches) -> Batches:
        textures: dict[int, np.ndarray] = {}
        for batch in _few(batches):
            out = {k: [] for k in IMAGE.names}
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ok = vec_id is not None and v and not any(c is None or not np.isfinite(c) for c in v)
                x = None
                if ok:
                    if len(v) not in textures:
                        noise = np.random.default_rng(seed).normal(size=(len(v), side, side)).astype(np.float32)
                        textures[len(v)] = (_blur(_blur(noise, 2), 1)).reshape(len(v), -1)
                    x = np.array(v, np.float32) @ textures[len(v)]
                    x = np.clip(128 + 52 * (x - x.mean()) / max(float(x.std()), 1e-9), 0, 255).astype(np.uint8).reshape(side, side)
                made = [(0, x)]
                if ok and vec_id % edit_every == 0:
                    rng = np.random.default_rng(vec_id)
                    r, c = rng.integers(0, side // 8, 2)
                    y = x[r : r + side * 7 // 8, c : c + side * 7 // 8].astype(np.float32)
                    y = np.clip(0.85 * y + 24 + rng.normal(0, 2.5, y.shape), 0, 255).astype(np.uint8)
                    made.append((1, np.ascontiguousarray(np.rot90(y)) if vec_id // edit_every % 2 else y))
                for e, im in made:
                    out["img"].append(None if vec_id is None else 2 * vec_id + e)
                    out["vec_id"].append(vec_id)
                    out["edited"].append(bool(e))
                    out["height"].append(None if im is None else im.shape[0])
                    out["width"].append(None if im is None else im.shape[1])
                    out["pixels"].append(None if im is None else im.tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=IMAGE)

    return run


def vector_images(vectors: DataFrame, side: int = 64, edit_every: int = 5, seed: int = 3) -> DataFrame:
    """Images (img, vec_id, edited, height, width, pixels) that a table of vectors stands for.

    Each component weighs one of as many fixed smooth random textures, so equal vectors give equal images and far
    ones unlike images: img = 2 * vec_id. Every edit_every-th vector gives a second image, img = 2 * vec_id + 1: a crop of the
    first with other brightness and contrast, noise, and for every other one a quarter turn. Vectors that are null,
    empty, or hold null or non-finite components have null pixels.
    """
    return vector_rows(vectors).mapInArrow(drawn(side, edit_every, seed), "img long, vec_id long, edited boolean, height int, width int, pixels binary")


@query
def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an image is much larger than its vector and takes long to describe, so vectors are spread over all tasks
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    groups = copy_groups(vector_rows(table(spark, sf_dir, "embeddings").repartition(tasks, "vec_id")), draw=drawn())
    edited = F.col("img") % 2 == 1
    return groups.select(F.col("img").alias("image_id"), ((F.col("img") - edited.cast("int")) / 2).cast("long").alias("vec_id"), edited.alias("edited"), "n_points", F.col("group").alias("group_id"))
