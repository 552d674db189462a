"""Near-duplicates, components and repeated lines against brute force."""

import random

import numpy as np
import pytest

from winnower.llm import common, embdedup, linededup, minhash, shingles


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def variants(rng, n_groups=25, words=60):
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, k = [], 0
    for g in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, words, 3 * words]))]
        for _ in range(rng.choice([1, 2, 6, 40 if g == 0 else 3])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((k, rng.choice(["  ", " ", "\n", "\t"]).join(copy)))
            k += 1
    return docs


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_brute_force(spark, percent):
    docs = variants(random.Random(percent))
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = brute_components(ids, links)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent / 100).collect()}
    assert got == {i: (want[i], len(sets[i])) for i in ids}


def test_template_family_equals_brute_force(spark):
    """Copies that link with each other alone, in buckets of the whole family."""
    rng = random.Random(5)
    template = [f"t{k}" for k in range(300)]

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"e{rng.random()}"
        return out

    docs = []
    for _ in range(300):
        base = edited(template, 2)
        docs += [edited(base, 2), edited(base, 2)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in docs]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) > 200
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame, 0.85).collect()}
    assert got == brute_components(range(len(docs)), links)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    same = []
    for _ in range(200):
        a = rng.integers(0, 2**63, 40, dtype=np.uint64)
        b = a.copy()
        b[:4] = rng.integers(0, 2**63, 4, dtype=np.uint64)
        same.append((minhash.sketch(np.unique(a)) == minhash.sketch(np.unique(b))).mean())
    assert abs(np.mean(same) - 36 / 44) < 0.03
    assert len(set(minhash.sketch(np.array([7], dtype=np.uint64)).tolist())) == 1


def test_words_do_not_cross_texts_or_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["ab", "c d", "", "ab c", None, "x" * 50 + " ab"] * 3
    whole = [list(minhash._batches(pa.array(texts), 1))][0]
    monkeypatch.setattr(shingles, "PIECE", 8)
    cut = list(minhash._batches(pa.array(texts), 1))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, cut, strict=True))
    assert whole[0][0] in whole[3] and len(whole[2]) == len(whole[4]) == 0


@pytest.mark.parametrize("shape", ["path", "star", "cliques", "random"])
def test_connected_components(spark, shape):
    rng = random.Random(4)
    if shape == "path":
        ids = list(range(60))
        rng.shuffle(ids)
        edges = list(zip(ids, ids[1:], strict=False))
    elif shape == "star":
        edges = [(1000, k) for k in range(80)]
    elif shape == "cliques":
        edges = [(10 * c + i, 10 * c + j) for c in range(6) for i in range(5) for j in range(5)]
    else:
        edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(70)] + [(None, 3)]
    nodes = {x for e in edges for x in e if None not in e and e[0] != e[1]}
    want = brute_components(sorted(nodes), [e for e in edges if None not in e])
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if n != c}


def test_no_edges(spark):
    assert common.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [1 << 10, 1 << 22])
def test_lines_equal_brute_force_at_any_filter_size(spark, bits):
    rng = random.Random(9)
    pool = [f"  Shared Line number {i} \t" for i in range(30)] + ["short", "ABCDEFGHI", "éééééééééé", "éèàùçéèàù", ""]
    docs = [(i, "\n".join(rng.choice([*pool, f"own line of document {i} {k}"]) for k in range(rng.randrange(1, 12)))) for i in range(150)]
    keys = lambda t: [line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for line in t.split("\n")]
    where = {}
    for i, t in docs:
        for k in keys(t):
            if len(k) >= 10:
                where.setdefault(k, set()).add(i)
    want = {}
    for i, t in docs:
        lines = t.split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if not (len(k) >= 10 and len(where[k]) > 1 and min(where[k]) != i)]
        want[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), bits=bits).collect()}
    assert got == want


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = [(int(i), (base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.05, 0.08])).tolist(), int(i % 40 % 3)) for i in range(600)]
    x = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = brute_components(range(600), list(zip(*np.nonzero(np.triu(near)), strict=True)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = sum(n for n, _ in got.values())
    assert found / near.sum() >= 0.99 and all(got[i][0] <= near[i].sum() for i in range(600))
    if found == near.sum():
        assert {i: c for i, (_, c) in got.items()} == want


def test_traversal_visits_nearest_first_and_ends():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embdedup.fit(x, np.zeros(500), 500, 1, 0.9)
    home, cells = index.visits(x)
    assert all(c[0] == h or h in c for h, c in zip(home, cells, strict=True))
    assert index.reach <= np.sqrt(2 - 2 * 0.9) + 1e-5
    near = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    if index.reach >= np.sqrt(2 - 2 * 0.9):  # at the exact bound nothing is missed
        assert all(home[j] in cells[i] for i, j in near)
