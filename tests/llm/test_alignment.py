"""Token alignment against whole texts, token by token."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from fleetmetrics.llm import alignment as L


@pytest.fixture(scope="module")
def tools():
    return L.Tokenizers(Path(L.A_PATH).read_bytes(), Path(L.B_PATH).read_bytes())


def plain(t, text):
    """(A ids, B ids, links, groups) of a text, from its whole encodings and plain loops."""
    text = text or ""
    want = (" " + text).encode()
    a, b = (t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
    if not text or any(b"".join(of[i].as_py() for i in ids) != want for ids, of in zip((a, b), t.bytes)):
        return [], [], [], []
    spans = []
    for ids, of in zip((a, b), t.bytes):
        at, own = 0, []
        for i in ids:
            n = len(of[i].as_py())
            own.append((at, at + n))
            at += n
        spans.append(own)
    links = [(i, j, min(p[1], q[1]) - max(p[0], q[0])) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if p[0] < q[1] and q[0] < p[1]]
    ends = sorted({p[1] for p in spans[0]} & {q[1] for q in spans[1]})
    groups = [tuple([[x for x, p in zip(ids, own) if lo < p[1] <= hi] for ids, own in zip((a, b), spans)]) for lo, hi in zip([0, *ends], ends)]
    return a, b, links, groups


def odd_texts():
    rng = random.Random(7)
    bits = ["hello", " ", "  ", "\n", "\t", "don't", "é ", "Ü", "日本語", " ", " ", " ", "　", "\x1c", "\x85", "\x00", "😀", "<s>", "</s>", "<0x41>", "<|endoftext|>", "123", "...", "ſ", "â", " ", "Straße", "\x7f", "​"]
    made = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(400)]
    return [None, "", " ", "  ", "a", "a ", " a ", "▁a", "x▁ y", "<unk>", "hello world hello world", "w" * 300, "word " * 200, *made]


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else ""


def test_links_equal_plain_loops(spark, tools, docs):
    texts = odd_texts()[:150]
    frame = docs(texts).selectExpr("*", "1 as links", "'x' as a_ids", "0 as pair")
    rows = {r.doc_id: r for r in L.aligned_tokens(frame).collect()}
    for i, text in enumerate(texts):
        a, b, links, groups = plain(tools, text)
        r = rows[i]
        assert (r.a_ids, r.b_ids) == (a, b), text
        assert [tuple(x) for x in r.links] == links
        ends = np.cumsum([[len(g[0]), len(g[1])] for g in groups], axis=0).tolist() if groups else []
        assert [list(x) for x in r.groups] == ends
        both = [(x, y) for (p, q), (s, e) in zip(zip([0, *[x[0] for x in ends]], [0, *[x[1] for x in ends]]), ends) for x in range(p, s) for y in range(q, e)]
        assert [tuple(x) for x in r.group_links] == both


@pytest.mark.parametrize("block_bytes", [L.BLOCK_BYTES, 700])
def test_counts_equal_plain_loops(spark, tools, docs, block_bytes):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "word word"), (5, "word word")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as kind", "2 as n_a").repartition(3)
    got = sorted((tuple(r) for r in L.alignment(frame, block_bytes=block_bytes).collect()), key=str)
    found = [(i, *plain(tools, t)) for i, t in rows]
    count = Counter((a[x], b[y]) for _, a, b, links, _ in found for x, y, _ in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    want = []
    for i, a, b, links, groups in found:
        pairs = [(a[x], b[y]) for x, y, _ in links]
        want.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == top[p[1]] for p in pairs), sum(count[p] for p in pairs), digest(groups)))
    assert got == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 300 and sum(w[1] == 0 for w in want) > 3


def test_very_long_text(spark, tools, docs):
    text = "the cat, the hat é\n" * 60_000 + "z" * 20_000
    r = L.alignment(docs([text])).first()
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    assert (r.n_a, r.n_b) == (len(a), len(b)) and r.n_links == r.n_a + r.n_b - r.n_groups


def test_product_equals_dense():
    rng = np.random.default_rng(2)
    for n, m, k in ((0, 3, 2), (4, 5, 6), (30, 20, 25)):
        x, y = rng.integers(0, 3, (n, m)) * rng.integers(0, 2, (n, m)), rng.integers(0, 3, (m, k)) * rng.integers(0, 2, (m, k))
        of = lambda d: L.Csr(np.concatenate([[0], np.cumsum((d > 0).sum(axis=1))]).astype(np.int64), np.nonzero(d)[1], d[d > 0], d.shape[1])
        for p, q, want in ((of(x), of(y), x @ y), (of(y).transposed(), of(x).transposed(), (x @ y).T)):
            got = np.zeros(want.shape, int)
            r = L.product(p, q)
            got[r.row_of(), r.index] = r.value
            assert (got == want).all()


def test_empty_table(spark):
    assert L.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
