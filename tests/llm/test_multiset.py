from __future__ import annotations

import hashlib
import random
import time
import tracemalloc

import numpy as np

from tessera.llm import multiset


def test_homomorphism(prose):
    lines = [prose(k, 3 * k) for k in range(9)] + ["", "  ", "one", "one two"]
    fp = multiset.fingerprint("\n".join(lines))
    random.Random(1).shuffle(lines)
    assert np.array_equal(fp, multiset.fingerprint("\n".join(lines)))
    more = multiset.insert(fp, "another paragraph here")
    assert np.array_equal(more, multiset.fingerprint("\n".join([*lines, "another paragraph here"])))
    assert np.array_equal(multiset.delete(more, "another paragraph here"), fp)
    assert not np.array_equal(fp, multiset.fingerprint("\n".join(lines[1:])))
    assert not np.array_equal(multiset.fingerprint("a\na"), multiset.fingerprint("a"))
    assert not multiset.fingerprint(None).any() and not multiset.fingerprint(" \n ").any()


def test_likeness_estimates_the_share_of_shingles(prose):
    parts = [prose(k, 40) for k in range(20)]
    a = multiset.fingerprint("\n".join(parts))
    for kept in (0, 5, 10, 15, 20):
        b = multiset.fingerprint("\n".join(parts[:kept] + [prose(100 + k, 40) for k in range(20 - kept)]))
        assert abs(multiset.likeness(a, b) - kept / 20) < 0.25
    zero = multiset.fingerprint("")
    assert multiset.likeness(zero, zero) == 1.0 and multiset.likeness(a, zero) == 0.0


def test_long_lines_are_summed_in_pieces(prose, monkeypatch):
    text = prose(3, 500) + "\n" + prose(4, 30)
    want = multiset.fingerprint(text)
    monkeypatch.setattr(multiset, "_PIECE", 16)
    assert np.array_equal(multiset.fingerprint(text), want)


def test_query_against_brute_force(spark, make_docs, sf_dir, prose):
    rng = random.Random(2)
    listed = [(k * 3 - 40, "\n".join(prose(k * 10 + j, rng.randint(0, 12)) for j in range(rng.randint(0, 9)))) for k in range(60)]
    listed += [(2**62 + 1, "é😀\n\nx"), (2**62, None), (500, ""), (501, "\n"), (502, prose(1, 5000)), (503, "a b c"), (503, "a b d"), (None, "null id"), (None, "null id two")]
    got = multiset.op6_fingerprints(spark, sf_dir(documents=make_docs(listed))).collect()
    order = sorted(((i, t or "") for i, t in listed), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        f, g, h = map(multiset.fingerprint, (t, new, following))
        want.append((str(i), len(t), hashlib.sha256(new.encode()).hexdigest(), multiset._shown(f), multiset._shown(g), multiset.likeness(f, g), multiset.likeness(f, h)))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_small_tables(spark, make_docs):
    for listed in ([(1, "only one\ntwo")], [(None, "a b"), (None, "c d")], [(4, "x"), (4, "x")]):
        got = multiset.compared(make_docs(listed)).collect()
        assert len(got) == len(listed)
        if len({t for _, t in listed}) == 1:
            assert {r.near_next for r in got} == {1.0}
    assert multiset.compared(make_docs([(1, "x")]).limit(0)).count() == 0


def test_a_million_lines_take_little_memory():
    rng = random.Random(1)
    lines = [rng.choice("abcdefghij") for _ in range(1_000_000)]
    tracemalloc.start()
    began = time.process_time()
    got = multiset.Hashed("\n".join(lines), 500_000)
    assert time.process_time() - began < 20 and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    each = {x: multiset.paragraph_vectors([x])[0].astype(np.uint64) for x in set(lines)}
    want = sum(v * np.uint64(lines.count(x)) for x, v in each.items()).astype(np.uint32)
    assert np.array_equal(got.fp, multiset.reduced(want))


def test_lanes_do_not_wrap():
    a, b = multiset.fingerprint("one two three four\n" * 60_000), multiset.fingerprint("one two three four\n" * 30_000)
    assert abs(multiset.likeness(a, b) - 0.8) < 0.01  # 1 - 30,000^2 / (60,000^2 + 30,000^2)


def test_ranges_are_small_and_in_order(spark, make_docs, prose):
    docs = make_docs([(k * 7 % 501, prose(k, 20)) for k in range(501)])
    got = multiset.in_order(docs, range_bytes=2000)
    rows = [(r.range, r.ahead, r.doc_id) for r in got.collect()]
    own = [r for r in rows if not r[1]]
    assert [i for _, _, i in sorted(own, key=lambda r: (r[0], -r[2]))] == list(range(500, -1, -1))
    n = max(r for r, _, _ in rows) + 1
    assert n > 10 and got.rdd.getNumPartitions() == n
    for k in range(n):
        following = [i for r, ahead, i in rows if r == k and ahead]
        assert following == [max(i for r, _, i in own if r == (k + 1) % n)]
