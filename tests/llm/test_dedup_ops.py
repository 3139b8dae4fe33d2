"""Operators 2, 4 and 8 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import buckets, embeddings, simhash, substrings
from millrace.llm.common import components
from tests.llm.fixtures import documents, prose, texts


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_substrings_against_brute_force(spark):
    long = prose(99, 70)
    rows = [*texts(), (50, f"{long} {prose(50, 20)} {long}"), (51, " ".join(long.split()[:49])), (52, " ".join(long.split()[3:53]))]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k:k + 50])] = min(i, first.get(tuple(w[k:k + 50]), i))
    want = []
    for i, t in rows:
        w, hit = words(t), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k:k + 50])] < i:
                hit |= set(range(k, k + 50))
        want.append((str(i), len(w), len(hit), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in hit).encode()).hexdigest()))
    docs = documents(spark, rows)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_duplicates(docs, digest=True).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    assert substrings.remove_duplicates(docs.limit(0), digest=True).count() == 0


def test_substrings_of_other_widths(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(25)]
    for window in (5, 12):
        first = {}
        for i, t in rows:
            w = t.split()
            for k in range(len(w) - window + 1):
                first.setdefault(tuple(w[k:k + window]), i)
        got = {r.doc_id: r.kept for r in substrings.remove_duplicates(documents(spark, rows), window=window).collect()}
        for i, t in rows:
            w, hit = t.split(), set()
            for k in range(len(w) - window + 1):
                if first[tuple(w[k:k + window])] < i:
                    hit |= set(range(k, k + window))
            assert got[i] == " ".join(x for k, x in enumerate(w) if k not in hit)


def test_factors_stand_at_their_sources(spark):
    long = prose(98, 300).split()
    rows = [*texts(), (50, " ".join([*prose(50, 20).split(), *long, *prose(51, 9).split()])), (51, " ".join(long[30:])), (52, " ".join(long[:200] + long[240:]))]
    words = {i: (t or "").split() for i, t in rows if i is not None}
    got = {r.doc_id: r.factors for r in substrings.parse(documents(spark, rows)).collect()}
    assert all(f.source < i and f.end - f.start >= 50 and words[i][f.start:f.end] == words[f.source][f.source_start:f.source_start + f.end - f.start]
               for i, x in got.items() for f in x)
    assert [tuple(f) for f in got[51]] == [(0, 270, 50, 50)] and [tuple(f) for f in got[52]] == [(0, 200, 50, 20), (200, 260, 50, 260)]
    assert substrings.factors([(0, 50, 1, 7), (1, 51, 1, 8), (2, 52, 2, 0), (3, 53, 1, 10)]) == [(0, 51, 1, 7), (2, 52, 2, 0), (3, 53, 1, 10)]


def test_simhash_against_brute_force(spark):
    rows = texts()
    near = prose(200, 300).split()
    for k in range(12):
        rows.append((100 + k, " ".join(near[:-k or None])))
    prints = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
        prints.setdefault(i, sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    ids = [i for i in prints if i is not None]
    want = roots(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(r.fp % 2**64 == prints[r.doc_id] for r in found)
    assert all(r.component_id == want[r.doc_id] for r in found if r.doc_id is not None)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 8])
@pytest.mark.parametrize("hot", [8192, 40])
def test_gray_index_finds_every_link(spark, monkeypatch, blocks, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(blocks)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(60)})
    want = roots(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {x.node: x.root for x in simhash.group_fingerprints(df, 4, blocks).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(got.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_upper_nodes_are_pruned(spark):
    """The index over all fingerprints of a table finds every link, and drops most of what it meets on the way."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    fps = np.unique(np.array([r.fp for r in simhash.fingerprints(rows).select("fp").distinct().collect()], np.int64).view(np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    index = simhash.GrayIndex(fps, np.array([0, len(fps)]))
    got = {(int(i), int(j)) for a, b in index.links(4) for i, j in zip(a, b)}
    want = set()
    for k in range(len(fps) - 1):
        want |= {(k, int(j)) for j in k + 1 + np.flatnonzero(np.bitwise_count(fps[k + 1:] ^ fps[k]) <= 4)}
    assert got == want and len(want) > 10
    upper = sum(index.dropped[1:])
    assert len(index.levels) == 7 and upper > 5000 and index.dropped[0] > 150_000 and index.compared < 0.6 * len(fps) ** 2 / 2
    assert simhash.plan(len(fps), 4) == (5, 2) and simhash.plan(13_000_000, 4)[0] == 5 and simhash.plan(10**9, 4)[0] == 6


@pytest.mark.parametrize("hot", [16384, 24])
def test_near_copies_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(6)
    rows = [(k, t) for k, (_, t) in enumerate(texts())]
    for c in range(6):
        base = prose(300 + c, 120).split()
        for k in range(15):
            w = base[:]
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"other{k}"
            rows.append((len(rows), " ".join(w)))
    sets = {}
    for i, t in rows:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = roots(list(sets), like)
    got = {x.doc_id: x.group_id for x in simhash.near_copies(documents(spark, rows), "doc_id").collect()}
    assert got == want and sum(want[i] != i for i in want) > 60
    assert simhash.near_copies(documents(spark, rows).limit(0), "doc_id").count() == 0


def test_ids_that_are_not_numbers(spark):
    rows = spark.createDataFrame([("b", prose(1, 60)), ("a", prose(1, 60)), (None, prose(2, 60)), ("x9", None)], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()} == {"b": "a", "a": "a", None: None, "x9": "x9"}


def test_components_of_chains(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 300), (300, 250)] + [(500, 501 + k) for k in range(50)]
    r.shuffle(edges)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == got[250] == 200 and 100 not in got and got[530] == 500
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_hot_buckets_still_meet(spark):
    df = spark.range(50).selectExpr("1 as k", "id")
    cells = buckets.split_hot(df, ["k"], "id", 12).collect()
    met = {(a.id, b.id) for a in cells for b in cells if a.id < b.id and (a.ci, a.cj) == (b.ci, b.cj)}
    assert len(met) == 50 * 49 // 2


@pytest.mark.parametrize("hot", [4096, 30])
def test_embeddings_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(embeddings, "HOT", hot)
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 64))
    vectors = [c + r.normal(size=64) * s * np.linalg.norm(c) / 8 for c in centres for s in (0.0, 0.0, 0.05, 0.1, 0.15, 0.2, 0.25) for _ in range(4)] + list(r.normal(size=(60, 64)))
    rows = [(i, [float(np.float32(x)) for x in v], 0, "clash") for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, None]), (904, []), (905, [float("inf")] * 64), (None, rows[0][1]), (906, [1.0, 0.0]), (907, [2.0, 0.0])]
    df = spark.createDataFrame(rows + [(i, v, 1, "clash") for i, v in odd], "vec_id long, embedding array<float>, label int, rep string")
    x = np.array([v for _, v, *_ in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.95
    found = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(found) == len(rows) + len(odd)
    true = link.sum(axis=1) - 1
    got = np.array([found[i].n_links for i in range(len(rows))])
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum()
    want = roots(range(len(rows)), lambda a, b: link[a, b])
    same = [found[i].component_id == want[i] for i in range(len(rows))]
    assert np.mean(same) > 0.95 and all(link[i].any() for i in range(len(rows)))
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (900, 901, 902, 903, 904, 905))
    assert found[None].component_id is None and found[906].n_links == found[907].n_links == 1 and found[907].component_id == 906
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_e8_decoding_is_nearest():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 8)) * 2
    own = embeddings.nearest_e8(x)
    d = ((x - own) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # the covering radius
    assert all((((x - own - v) ** 2).sum(axis=1) >= d - 1e-9).all() for v in embeddings.MINIMAL)
