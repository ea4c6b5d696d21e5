"""Images, neighbours and the pipeline."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetmetrics.llm import media, neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and not any(c is None or not np.isfinite(c) for c in v) and any(v)]
    a = np.stack([v for _, v in good])
    n = np.linalg.norm(a, axis=1)
    out = {}
    for j, (i, v) in enumerate(good):
        if i % every == 0:
            s = (a @ v) / (n * n[j])
            order = sorted((-s[m], good[m][0]) for m in range(len(good)) if good[m][0] != i)[:k]
            out[i] = [x for _, x in order]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(600)]
    hot = [float(np.float32(x)) for x in rng.normal(size=16)]
    rows += [(i, hot) for i in range(600, 900)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [float("inf")] + [1.0] * 15), (1200, [None] * 16), (None, hot), (1250, [1.0, 2.0])]
    df = vectors(spark, rows).withColumn("key", F.lit("own")).withColumn("score", F.lit(1))
    got = {}
    for r in neighbours.nearest_neighbours(df, list_size=20, task_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute([r for r in rows if r[1] and len(r[1]) == 16], 50, 5)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert got[700] == want[700] == [600, 601, 602, 603, 604]


def test_neighbours_odd(spark):
    assert neighbours.nearest_neighbours(vectors(spark, [])).count() == 0
    assert neighbours.nearest_neighbours(vectors(spark, [(50, [1.0, 0.0])])).count() == 0
    two = neighbours.nearest_neighbours(vectors(spark, [(50, [1.0, 0.0]), (1, [1.0, 1.0])])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(50, 1, 1)] and abs(two[0].score - 2**-0.5) < 1e-12


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(60)] + [(90, None), (91, [float("nan")])]
    rows += [(70, rows[7][1]), (71, rows[7][1])]
    images = media.vector_images(vectors(spark, rows), edit_every=3)
    got = {r.img: r for r in media.copy_groups(images).collect()}
    assert len(got) == images.count()
    edits = [r.img for r in images.where("edited").collect()]
    assert sum(got[i].group == got[i - 1].group for i in edits) >= 0.9 * len(edits)
    assert got[140].group == got[142].group == 14
    whole = [r.img for r in images.where("not edited and vec_id < 60").collect()]
    assert all(got[i].group == i for i in whole)


def test_describing_takes_little_memory(spark):
    """As many images as a task describes at a time, and no pixels between tasks when they are drawn where they are described."""
    x = np.random.default_rng(8).integers(0, 256, (media.IMAGES_AT_ONCE, 64, 64)).astype(np.float32)
    tracemalloc.start()
    found = media.describe(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 48 * len(x) and most < 100e6
    rng = np.random.default_rng(9)
    df = vectors(spark, [(i, [float(v) for v in rng.normal(size=16)]) for i in range(12)] + [(20, None), (None, [1.0] * 16), (21, [])])
    drawn = media.described(media.vector_rows(df), draw=media.drawn())
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, media.described(media.vector_images(df)).collect()))


def test_images_odd(spark):
    rows = [(1, 4, 4, bytes(16)), (2, 10, 10, bytes(100)), (3, 10, 10, bytes(99)), (4, None, 10, bytes(10)), (5, 10, 10, None), (None, 10, 10, bytes(100)), (6, 10, 10, bytes(100)), (6, 10, 10, bytes(100))]
    df = spark.createDataFrame(rows, "img long, height int, width int, pixels binary")
    got = sorted((r.img, r.n_points, r.group) for r in media.copy_groups(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 2), (6, 0, 2)]
    assert media.copy_groups(df.where("false")).count() == 0


def test_groups_equal_all_pairs(spark):
    """Groups are those of all pairs of images held against each other by all points, hot group included."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(90)]
    seed = rng.normal(size=24)
    rows += [(200 + i, [float(x) for x in seed + rng.normal(size=24) * 0.02]) for i in range(60)]  # a third are near copies of one
    images = media.vector_images(vectors(spark, rows), edit_every=4)
    points = {r.img: np.frombuffer(r.points, media.POINT) for r in media.described(images).collect()}
    ids = sorted(points)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, i in enumerate(ids):
        rest = ids[n + 1 :]
        if rest:
            n_of = media.agreeing(media._padded(pa.array([points[i].tobytes()] * len(rest))), media._padded(pa.array([points[j].tobytes() for j in rest])))
            for j in np.array(rest)[n_of >= 4]:
                a, b = sorted((find(i), find(int(j))))
                up[b] = a
    want = {i: find(i) for i in ids}
    got = {r.img: r.group for r in media.copy_groups(images).collect()}
    assert len(got) > 180 and sum(got[i] != want[i] for i in ids) <= 0.02 * len(ids)
    assert all(want[i] == want[g] for i, g in got.items())  # no link that all pairs don't have


def test_no_pair_of_a_bucket_is_lost(spark):
    """80 images share eight descriptors; two by two they have them at the same places, and only those two are copies."""
    rng = np.random.default_rng(6)
    hot = rng.integers(0, 1 << 63, (8, media.WORDS), np.uint64)
    rows, images = [], 80
    for i in range(images // 2):
        own = np.zeros(48, media.POINT)
        own["x"], own["y"], own["angle"], own["scale"] = *rng.uniform(0, 60, (2, 48)), rng.uniform(-3, 3, 48), 1
        for img in (i, i + images // 2):
            own["d"] = rng.integers(0, 1 << 63, (48, media.WORDS), np.uint64)
            own["d"][:8] = hot
            rows.append((img, 48, own.tobytes()))
    df = spark.createDataFrame(rows, "img long, n_points long, points binary")
    got = {r.node: r.component for r in media.copy_links(df).collect()}
    assert [got.get(i + images // 2) for i in range(images // 2)] == list(range(images // 2))
    # large buckets are dealt out: what meets is what meets whole, and all that does
    plan = media.KeyPlan(hot, 4000)
    keyed = media.described_keys(df.withColumn("comp", F.floor(F.col("img") / 3)), plan)
    brief = lambda limit: sorted(map(tuple, media.all_meetings(keyed, limit=limit).collect()))
    whole = brief(1 << 15)
    assert {(a, b) for a, b, _ in whole} == {(a, b) for a in range(images) for b in range(a + 1, images) if a // 3 != b // 3}
    assert all(n >= 8 for _, _, n in whole) and brief(20) == whole


def test_key_plans_keep_their_chance():
    for points in (10, 10**4, 10**6, 10**9, 10**12):
        plan = media.KeyPlan(np.random.default_rng(1).integers(0, 1 << 63, (3000, 4), np.uint64), points)
        assert 1 - (1 - (1 - 6 / 256) ** plan.bits) ** plan.tables >= 0.85


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.count() > 0
            docs = out
        else:
            assert out.count() == docs.count() and out.where("n_ids < 1").count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, sf_dir, stage):
    rows = [(i, t, None, None if i % 2 else "s", None) for i, t in enumerate([None, "", "a b", "a b", "x " * 50])] + [(None, "no id", "en", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1))
    corpus_pipeline.STAGES[stage][1](spark, df, sf_dir).collect()
    assert corpus_pipeline.STAGES[stage][1](spark, df.where("false"), sf_dir).count() == 0


def test_neighbours_of_divided_lists(spark):
    """Lists that are divided, many of them without a query, on clustered vectors: scores are exact and few neighbours are missed."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(df, sample=60, list_size=20, divide_above=3, fan=4, probes=24, task_rows=64).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = np.arange(0, 3000, 50)
    s = u[asked] @ u.T
    s[np.arange(60), asked] = -9
    assert len(got) == 300 and got.groupby("query_id")["rank"].apply(list).map(lambda r: r == [1, 2, 3, 4, 5]).all()
    assert np.allclose(got["score"], [s[q // 50, v] for q, v in zip(got["query_id"], got["vec_id"])], atol=1e-12)
    want = {(q, v) for q, row in zip(asked, np.argsort(-s, axis=1)[:, :5]) for v in row}
    assert len(want & set(zip(got["query_id"], got["vec_id"]))) >= 0.9 * len(want)
