"""Stages of the pipeline against plain Python on planted copies."""

import random

from fleetmetrics.llm import near_copies, pipeline

from test_text_operators import brute_components, brute_lines, words


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**9)}"
    return w


def planted(rng, n=60):
    """Originals of 40 to 400 words, each with copies of falling similarity, and a large group around one text."""
    texts = []
    for _ in range(n):
        w = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        texts += [" ".join(w), "\n".join(w).upper()] + [" ".join(edited(rng, w, max(1, int(len(w) * f)))) for f in (0.004, 0.012, 0.02, 0.025, 0.05)]
    w = [f"h{rng.randrange(5000)}" for _ in range(200)]
    texts += [" ".join(edited(rng, w, rng.randrange(1, 8))) for _ in range(120)]
    texts += [None, "", "  ", "a b", "A  b", "a b c"]
    rng.shuffle(texts)
    return texts


def shingle_set(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_links(texts, least=0.8):
    sets = [shingle_set(t) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b) if a and b else 0
            if not a and not b or both and both >= least * (len(a) + len(b) - both):
                yield j, i


def test_near_duplicates_match_brute_force(spark):
    texts = planted(random.Random(21))
    want = brute_components(list(brute_links(texts)))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert got == {i: want.get(i, i) for i in range(len(texts))}
    docs = df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in range(len(texts)) if want.get(i, i) == i} | {None}


def test_candidates_reach_the_bound():
    """Pairs right above 0.8 share a key."""
    rng, found, n = random.Random(22), 0, 300
    for _ in range(n):
        w = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        v, s = list(w), 1.0
        at = iter(rng.sample(range(0, 500, 5), 100))
        while True:
            u = list(v)
            u[next(at)] = "x" + str(rng.random())
            t = near_copies.similarity(set(near_copies.shingles(" ".join(w))), set(near_copies.shingles(" ".join(u))))
            if t < 0.8:
                break
            v, s = u, t
        a, b = (near_copies.band_keys(near_copies.shingles(" ".join(z))) for z in (w, v))
        assert 0.8 <= s < 0.82
        found += bool(set(a.tolist()) & set(b.tolist()))
    assert found >= 0.99 * n


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(23)
    pool = [f"this common line has the number {i}" for i in range(5)] + [f"a line of its own, number {i} of all" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 8)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {i: (t, len(t)) for i, _, _, t in brute_lines(rows)}


def test_apart_pairs_miss_no_link(spark):
    """Around common texts of several lengths, with components of one, of some and of most texts: every link between components is a candidate."""
    import random

    from fleetmetrics.llm import near_copies as N

    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for n in (6, 40, 150, 150):
        base = rng.choices(vocabulary, k=n)
        for _ in range(45):
            own = [w if rng.random() > rng.choice([0.0, 0.01, 0.03, 0.06]) else rng.choice(vocabulary) for w in base]
            cut = rng.randrange(0, max(1, n // 8))
            texts.append(" ".join(own[cut:] if rng.random() < 0.3 else own))
    texts = sorted(set(texts)) + ["", "one two"]
    sets = [set(N.shingles(t)) for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for most in (1, 0.5, 0.05):
        component = [i if rng.random() < most else -1 for i in range(len(texts))]
        members = spark.createDataFrame(list(enumerate(component)), "node long, component long")
        for least in (0.8, 0.6):
            got = {tuple(r) for r in N.apart_pairs(frame, members, least, 5).collect()}
            want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and component[i] != component[j] and N.similarity(sets[i], sets[j]) >= least}
            assert want <= got and want and all(component[a] != component[b] for a, b in got)
