from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import nearcopies, simhash
from tessera.llm.components import components


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else []))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_follow_the_definition(prose):
    for text in [None, "", " \n\t ", "One", "one two", "One two THREE", "É é one two", *(prose(k, 5 + 40 * k) for k in range(6)), prose(9, 70_000)]:
        assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def brute(fps):
    """The smallest fingerprint index reachable from each, over links of two bits."""
    group = list(range(len(fps)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def near_family(rng, n, bits=2):
    center, out = rng.getrandbits(64), set()
    while len(out) < n:
        x = center
        for _ in range(rng.randint(0, bits)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return list(out)


def test_links_join_exactly_what_is_linked(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1, 1 << 63, 3, *(rng.getrandbits(64) for _ in range(200))}
    fps |= set(near_family(rng, 150, 3)) | set(near_family(rng, 5)) | set(near_family(rng, 2, 4))
    fps = sorted(fps)
    prints = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    want = brute(fps)
    for crowded, groups in ((24, None), (0, 4), (10**6, 6)):
        found = {r.node: r.root for r in components(simhash.links(prints, crowded, groups)).collect()}
        mark = [found.get(simhash._signed(x), simhash._signed(x)) for x in fps]
        for i in range(len(fps)):
            for j in range(i):
                assert (mark[i] == mark[j]) == (want[i] == want[j])


def test_manhattan_is_a_lower_bound(spark):
    rng = random.Random(4)
    pairs = [(simhash._signed(a), simhash._signed(a ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64))) for a in (rng.getrandbits(64) for _ in range(300))]
    df = spark.createDataFrame(pairs, "u long, v long")
    from pyspark.sql import functions as F

    for r in df.select("u", "v", F.bit_count(simhash.embedding(F.col("u")).bitwiseXOR(simhash.embedding(F.col("v")))).alias("m")).collect():
        counts = lambda x: [(x % (1 << 64) >> 2 * k & 3).bit_count() for k in range(32)]
        assert r.m == sum(abs(a - b) for a, b in zip(counts(r.u), counts(r.v))) <= ((r.u ^ r.v) % (1 << 64)).bit_count()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(200, 200), (300, 301), (301, 300), (-5, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}, 300: -5, 301: -5, -5: -5}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query_against_brute_force(spark, make_docs, sf_dir, prose):
    texts = [prose(k, 60) for k in range(12)]
    listed = [(k, t) for k, t in enumerate(texts)] + [(20 + k, texts[3]) for k in range(30)] + [(60, texts[4] + " end"), (61, None), (62, ""), (63, "  "), (7, texts[7]), (None, texts[3])]
    got = simhash.op4_simhash(spark, sf_dir(documents=make_docs(listed))).collect()
    assert len(got) == len(listed)
    fps = sorted({plain(t) for _, t in listed})
    group = dict(zip(fps, brute(fps)))
    least = {}
    for i, t in listed:
        if i is not None:
            least[group[plain(t)]] = min(least.get(group[plain(t)], i), i)
    want = sorted((i, f"{plain(t):016x}", least[group[plain(t)]]) for i, t in listed if i is not None)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert [r.component_id for r in got if r.doc_id is None] == [3]


def test_keep_one(spark, make_docs, prose):
    a, b = prose(1, 50), prose(2, 50)
    docs = make_docs([(5, a), (2, a), (9, b), (9, b), (None, b), (4, None), (6, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 2, 4, 9]
    assert simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [None, 3])
def test_keep_one_drops_near_copies_and_keeps_others(spark, make_docs, prose, monkeypatch, most):
    """Planted pairs on both sides of 0.8, and a chain, against brute force; with cells of any size in shares and by pivots too."""
    if most:
        monkeypatch.setattr(nearcopies, "MOST", most)
        monkeypatch.setattr(nearcopies, "PIVOTS", 2)
    listed, want = [], []
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for k in range(60):
        w = prose(k, 200).split()
        changed = list(w)
        for at in range(1 + k % 8):
            changed[10 + 20 * at] = "zzz"
        a, b = " ".join(w), " ".join(changed)
        listed += [(2 * k, a), (2 * k + 1, b)]
        both = len(sets(a) & sets(b))
        want += [2 * k] if 5 * both >= 4 * len(sets(a) | sets(b)) else [2 * k, 2 * k + 1]
    chain = prose(900, 200).split()
    for k in range(40):  # more than a cell compares pair by pair elsewhere; the ends are unlike
        listed.append((1000 + k, " ".join(chain[3 * k :] + prose(901, 120).split()[: 3 * k])))
    assert len(want) not in (60, 120)
    assert sorted(r.doc_id for r in simhash.keep_one(make_docs(listed)).collect()) == sorted([*want, 1000])


def test_links_between_components_of_a_large_cell_are_found(spark, make_docs, prose, monkeypatch):
    """Two near-copy groups that only a pair of late members joins: both ways give the components of all pairs."""
    base = prose(50, 300).split()
    listed = []
    for k in range(24):
        w = list(base)
        for at in range(5):  # each is alike to the base, few to one another
            w[(11 * k + 59 * at) % 300] = f"x{k}y{at}"
        listed.append((k, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for _, t in listed]
    alike = {(a, b) for a in range(24) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    label = list(range(24))
    for a, b in sorted(alike) * 24:
        label[a] = label[b] = min(label[a], label[b])
    want = sorted({label[k] for k in range(24)})
    assert alike and len(alike) < 24 * 23 // 2
    for most in (512, 2):
        monkeypatch.setattr(nearcopies, "MOST", most)
        monkeypatch.setattr(nearcopies, "PIVOTS", 1)
        assert sorted(r.doc_id for r in simhash.keep_one(make_docs(listed)).collect()) == want


def test_keep_one_picks_rows(spark, make_docs, prose):
    a, b = prose(1, 50), prose(2, 50)
    twice = simhash.keep_one(make_docs([(5, a), (5, b), (6, a), (7, b)])).collect()
    assert sorted((r.doc_id, r.text) for r in twice) == sorted([(5, a), (5, b)])
    blank = simhash.keep_one(make_docs([(4, None), (4, None)])).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in blank] == [(4, None, 0)]
    unnamed = simhash.keep_one(make_docs([(None, a), (None, a), (None, b)])).collect()
    assert sorted(r.text for r in unnamed) == sorted([a, b])


def test_grids_join_near_copies_by_segment_counts():
    """Pairs at 0.8, small ones too, share a cell and are within the range; unlike ones are not, and no distance exceeds Hamming's."""
    grid, rng = nearcopies.grids(1000), np.random.default_rng(5)
    for common, more in ((4, 1), (16, 4), (160, 40)):
        sets = rng.integers(0, 1 << 63, (150, common + more), dtype=np.uint64)
        a, b = (np.stack([nearcopies.majorities(nearcopies.bit_counts(x[:n], grid.words), n) for x in sets]) for n in (common + more, common))
        u, v = nearcopies.embedded(a), nearcopies.embedded(b)
        apart = np.bitwise_count(u ^ v).sum(axis=1)
        assert (apart <= ((a >= 0) != (b >= 0)).sum(axis=1)).all()
        counts = [(x >= 0).reshape(len(x), -1, 2).sum(axis=2) for x in (a, b)]
        assert (apart == np.abs(counts[0] - counts[1]).sum(axis=1)).all()
        near, probes = nearcopies.reach(grid.words, 0.8, 4.5), 16
        if common < nearcopies.TINY:
            near, probes = near * nearcopies.STRETCH, 256
        met = np.zeros(len(sets), bool)
        for g in range(grid.count):
            met |= (grid.cells(a, g, probes)[:, :, None] == grid.cells(b, g, probes)[:, None, :]).any(axis=(1, 2))
        assert met.all() and (apart <= near).all()
        if common > 100:
            assert (np.bitwise_count(u ^ np.roll(v, 1, axis=0)).sum(axis=1) > near).mean() > 0.99


def test_near_copies_are_found_by_the_grids(spark, make_docs, prose, monkeypatch):
    """The pipeline's stage has no other way to a candidate: without the grids it links copies only."""
    text = prose(1, 200)
    docs = make_docs([(1, text), (2, text + " end"), (3, text), (4, prose(2, 200))])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 4]
    monkeypatch.setattr(nearcopies.Grids, "cells", lambda self, majority, grid, probes: np.arange(len(majority) * probes).reshape(-1, probes))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 2, 4]


def test_a_group_just_under_the_threshold_makes_no_row_a_pair(spark, make_docs, prose):
    """Texts in range of each other of which few are alike: the rows grow with texts and blocks, and the links are those of all pairs."""
    base, n = prose(70, 150).split(), 150
    rng, listed = random.Random(8), []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(150), 1 + k % 5):
            w[at] = f"x{k}y{at}"
        listed.append((k, " ".join(w)))
    docs = make_docs(listed).selectExpr("doc_id", "text", "xxhash64(text) AS key")
    grid = nearcopies.grids(n)
    rows = nearcopies.hashed(docs, "text", "key", 5, grid.words).selectExpr("node", "doc_id AS n_id", "key AS n_key", "size", "majority", "embedding")
    placed = nearcopies.materialize(nearcopies.places(rows.selectExpr("*", "node AS root", "1L AS group")))
    at = {r.node: r.place >> 16 for r in placed.collect()}
    near = nearcopies.contested(placed, grid, nearcopies.PROBES, 0.8)
    assert len(at) == n and n // 2 < near.count() <= n * len(set(at.values()))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in listed]
    alike = [(a, b) for a in range(n) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    label = list(range(n))
    while (now := [min([label[k], *(label[a + b - k] for a, b in alike if k in (a, b))]) for k in range(n)]) != label:
        label = now
    edges = nearcopies.decided_by_blocks(near, placed, docs, "text", "key", 5, 0.8)
    assert edges.count() < n < len(alike) < n * (n - 1) // 2
    names = {r.node: r.n_id for r in rows.collect()}
    mark = {names[r.node]: names[r.root] for r in components(edges).collect()}
    groups = lambda f: sorted(sorted(k for k in range(n) if f(k) == m) for m in {f(k) for k in range(n)})
    assert groups(lambda k: mark.get(k, k)) == groups(lambda k: label[k])


def test_packed_rows_do_not_multiply_with_buckets(spark):
    """A task's rows follow its members, also where batches are many and buckets more."""
    grid, rng, n = nearcopies.grids(3000), np.random.default_rng(2), 3000
    majority = rng.integers(-128, 128, (n, 64 * grid.words)).astype(np.int8)
    embedding = nearcopies.embedded(majority)
    rows = [(k, k, 100, bytearray(majority[k].tobytes()), bytearray(embedding[k].tobytes())) for k in range(n)]
    nodes = spark.createDataFrame(rows, "node long, root long, size int, majority binary, embedding binary").coalesce(1)
    got = nearcopies.members(nodes, grid, 16, range(4), 500).collect()
    assert sum(len(r.packed) for r in got) == n * 16 * 4 * nearcopies._MEMBER.itemsize
    assert len(got) <= n * 16 * 4 // nearcopies.PACKED


def test_common_counts_shared_hashes():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, most, 60, dtype=np.uint64)) for most in [70] * 14 + [4000] * 10] + [np.empty(0, np.uint64)]
    both = nearcopies.common(sets)
    assert all(both[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in range(25) if i != j)
