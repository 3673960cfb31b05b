from __future__ import annotations

import random
import time

from tessera.llm import decontamination as dc


def tiled(a, b, least):
    """Greedy string tiling, word by word."""
    free_a, free_b, out = [x >= 0 for x in a], [x >= 0 for x in b], []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append(best)
        for x in range(k):
            free_a[i + x] = free_b[j + x] = False


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for case in range(300):
        a = [rng.randrange(3 + case % 9) for _ in range(rng.randrange(40))]
        b = []
        for _ in range(rng.randrange(6)):
            at, n = rng.randrange(len(a) + 1), rng.randrange(15)
            b += a[at : at + n] if rng.random() < 0.7 else [rng.randrange(12) for _ in range(n)]
            b += [-1] * (rng.random() < 0.3)
        got, want = dc.tiles(a, b, 3), tiled(a, b, 3)
        for k, i, j in got:
            assert a[i : i + k] == b[j : j + k] and -1 not in b[j : j + k]
        assert len({i + x for k, i, _ in got for x in range(k)}) == sum(k for k, _, _ in got) == len({j + x for k, _, j in got for x in range(k)})
        assert sorted(got) == sorted(want)


def test_very_repetitive_texts_end():
    assert sum(k for k, _, _ in dc.tiles([1] * 60, [1] * 3000)) == 60
    assert dc.tiles([], [1] * 9) == dc.tiles([1] * 4, [1] * 9) == []


def test_repetitive_texts_are_fast():
    rng = random.Random(4)
    item, text = [k % 3 for k in range(300)], [rng.choice([0, 1, 2, 2, k % 3]) for k in range(4000)]
    began = time.process_time()
    for a, b in (([1] * 300, [1] * 4000), (item, text), ([1, 2] * 150, ([1, 2] * 40 + [-1]) * 50), (item, item * 14)):
        found = dc.tiles(a, b)
        assert sum(k for k, _, _ in found) <= len(a)
    assert time.process_time() - began < 8


def test_repeated_benchmark_rows_and_null_ids(spark, make_docs, prose):
    item = prose(77, 40)
    bench = spark.createDataFrame([(1, item)] * 40 + [(2, item), (None, item), (None, prose(78, 30)), (None, None)], "item_id long, text string")
    blocks = list(dc.blocks(bench, most=100))
    assert len(blocks) > 1 and sum(len(b.items) for b in blocks) == 4
    got = [(r.doc_id, r.item_id) for r in dc.contaminations(make_docs([(5, "x " + item), (6, None)]), bench).collect()]
    assert sorted(got, key=str) == [(5, 1), (5, 2), (5, None)]
    assert [r.doc_id for r in dc.decontaminate(make_docs([(5, item), (6, None)]), bench).collect()] == [6]


def passages(prose):
    items = [prose(1000 + k, 40) for k in range(6)]
    w = items[0].split()
    swapped = " ".join(w[20:] + ["between"] + w[:20])
    docs = [
        (1, prose(1, 200) + " " + items[0] + " " + prose(2, 100)),
        (2, "Start: " + swapped.upper().replace(".", "!")),
        (3, prose(3, 300)),
        (4, " ".join(items[1].split()[:15]) + prose(4, 60)),  # too little of it
        (5, items[2] + "\n" + items[3]),
        (5, items[2]),
        (6, None),
        (7, ""),
        (8, prose(5, 20_000) + " " + " ".join(items[4].split()[:35])),
        (None, items[5]),
    ]
    return items, docs


def test_query_finds_passages_in_any_order(spark, make_docs, sf_dir, prose):
    items, docs = passages(prose)
    bench = spark.createDataFrame([*enumerate(items), (90, "too short here"), (91, None), (92, "")], "item_id long, text string")
    path = sf_dir(documents=make_docs(docs), benchmark=bench)
    got = sorted(((r.doc_id, r.item_id) for r in dc.op1_decontamination(spark, path).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (5, 2), (5, 3), (5, 2), (8, 4), (None, 5)], key=str)
    kept = dc.decontaminate(make_docs(docs), bench)
    assert kept.columns == make_docs(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 7]


def test_blocks_find_the_same(spark, make_docs, prose, monkeypatch):
    items, docs = passages(prose)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = list(dc.blocks(bench, most=300))
    assert len(found) > 1 and sorted(i for b in found for i, _ in b.items) == list(range(6))
    want = sorted(map(str, dc.contaminations(make_docs(docs), bench).collect()))
    monkeypatch.setattr(dc.blocks, "__defaults__", (dc.LEAST, 300))
    assert sorted(map(str, dc.contaminations(make_docs(docs), bench).collect())) == want


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminations(make_docs([(1, "a b c d e f")]), none).count() == 0
    assert dc.decontaminate(make_docs([(1, "a b c d e f")]), none).count() == 1
    assert dc.contaminations(make_docs([(1, "a")]).limit(0), none).count() == 0
