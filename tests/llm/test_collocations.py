"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from fleetmetrics.llm import collocations as C


def plain_counts(rows, most):
    out, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            out.update((lang, " ".join(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    return out, {k: n for k, n in totals.items() if n}


def plain_collocations(rows, most, least, top, inside):
    f, totals = plain_counts(rows, most)
    cand = {k: n for k, n in f.items() if n >= least and " " in k[1]}
    by = defaultdict(list)
    for (lang, p), a in cand.items():
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((int(Fraction(1_000_000 * a * a, l * r) // 1), k, l, r))
        score, _, l, r = min(cuts)
        inner = any(g == lang and f" {p} " in f" {q} " and len(q.split(" ")) > len(w) and 100 * n >= inside * a for (g, q), n in cand.items())
        if not inner:
            by[lang].append((-score, -a, p.encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, v in by.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top])}


def made(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "of", "a", "ÄB", "äb", "x-y", "\U0001f600", "zz", "q"]
    sep = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", "\x0b", "\x0c", "\r\n", "\xa0"]
    text = lambda: "".join(rng.choices(words, range(10, 0, -1))[0] + rng.choice(sep) for _ in range(rng.randrange(0, 60)))
    return [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(n)] + [("en", None), ("fr", ""), (None, " .\t"), ("en", "the of a " * 3000), ("de", "w" * 50_000), ("de", "tie tie tie tie")]


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300, "bucket_words": 50}, {"block_bytes": 2000, "bucket_words": 500, "hot_pair": 20}])
def test_equals_plain_counts(spark, how):
    rows = made(3)
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "lang string, text string, phrase int, n string").repartition(5)
    for most, least in ((3, 2), (1, 1), (2, 3), (4, 5)):
        found, totals = C.phrase_counts(docs, most, least, **how)
        got = {(r.lang, r.phrase): (r.n, r.words) for r in found.collect()}
        want, n = plain_counts(rows, most)
        assert got == {k: (v, k[1].count(" ") + 1) for k, v in want.items() if v >= least}
        assert {r.lang: r.n for r in totals.collect() if r.n} == n


@pytest.mark.parametrize("most,least,top,inside", [(3, 2, 1000, 50), (4, 3, 7, 80), (2, 10, 5, 50)])
def test_equals_plain_collocations(spark, most, least, top, inside):
    rows = made(5)
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = {tuple(r) for r in C.collocations(docs, most, least, top, inside, bucket_words=2000, block_bytes=5000).collect()}
    assert got == plain_collocations(rows, most, least, top, inside) and got


def test_quicksort_equals_counting():
    rng = np.random.default_rng(1)
    for n, v, places in ((0, 3, 3), (1, 1, 2), (500, 4, 3), (5000, 40, 4), (300, 1, 1)):
        columns = [rng.integers(1, v + 1, n), *[rng.integers(0, v + 1, n) for _ in range(places - 1)]]
        for a, b in zip(columns[1:], columns[2:]):
            b[a == 0] = 0
        weights = rng.integers(1, 5, n)
        want = Counter()
        for row, w in zip(zip(*columns), weights):
            for k in range(1, places + 1):
                if row[k - 1]:
                    want[tuple(map(int, row[:k]))] += int(w)
        for least in (1, 7):
            got = {}
            for k, ptr, count in C.equal_partitions([c.astype(np.int32) for c in columns], weights, [least] * places):
                for p, c in zip(ptr, count):
                    key = tuple(int(columns[j][p]) for j in range(k))
                    assert key not in got
                    got[key] = int(c)
            assert got == {k: c for k, c in want.items() if c >= least}


def test_products_beyond_64_bits(spark):
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "alr"}
    a, l, r = 10**13 + 7, 10**14 + 1, 3 * 10**14
    got = spark.sql(f"select (cast(1000000 as decimal(7, 0)) * {wide['a']} * {wide['a']}) div ({wide['l']} * {wide['r']}) as s from (select {a}L a, {l}L l, {r}L r)").first()[0]
    assert got == 1_000_000 * a * a // (l * r)


def test_empty_table(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(none).count() == 0


def test_query_equals_sql(spark, sf_dir):
    got = {tuple(r) for r in C.op12_collocations(spark, sf_dir).collect()}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == set(c.sql(C.OP12_SQL).fetchall()) and got
