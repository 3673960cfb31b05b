"""Quality, toxicity and the language model: held-out accuracy and brute force."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import plain_models
import pytest

from tessera.llm import language_model, quality, toxicity
from tessera.llm.regression import fit_logistic, sigmoid

ODD = [(None, 1), ("", 0), (" \n", 1), ("x", 0)]


@pytest.fixture(scope="module")
def labelled(spark, make_docs, prose):
    """Documents of which some are junk and some are toxic, and their labels."""
    rng, listed, labels = random.Random(8), [], []
    for k in range(900):
        text, good, bad = prose(k, rng.randint(30, 120)), k % 6 != 0, k % 7 == 0
        if bad:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgling", "zorgface", "blarg"]))
            text = " ".join(w)
        if not good:
            text = " ".join(x + rng.choice(["***", "%%%"]) for x in text.split()) if k % 12 else " ".join(x for x in text.split()[:9] for _ in range(7))
        listed.append((k, text))
        if k < 700:
            labels.append((k, int(good), int(bad)))
    listed += [(2000 + k, t) for k, (t, _) in enumerate(ODD)] + [(3000, prose(1, 20_000)), (5, listed[5][1]), (None, prose(2, 30))]
    return make_docs(listed), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")


def test_logistic_regression():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3)) * [1, 10, 0.1] + [0, 5, 0]
    w = np.array([1.0, -0.2, 8.0, 0.5])
    y = (rng.random(4000) < sigmoid(x @ w[:3] + w[3])).astype(float)
    assert np.allclose(fit_logistic(x, y), w, rtol=0.25, atol=0.25)
    assert fit_logistic(x[:0], y[:0])[-1] == 0 and sigmoid(fit_logistic(x[:9], np.ones(9))[-1]) > 0.9


def test_quality_keeps_good_documents(spark, labelled):
    docs, labels = labelled
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    held = range(700, 900)
    assert sum(k in ids for k in held if k % 6) >= 0.97 * sum(1 for k in held if k % 6)
    assert sum(k in ids for k in held if k % 6 == 0) <= 0.1 * sum(1 for k in held if k % 6 == 0)
    assert 3000 in ids and None in ids


def test_quality_query_against_brute_force(spark, labelled, sf_dir):
    docs, labels = labelled
    got = quality.op7_quality(spark, sf_dir(documents=docs, labels=labels)).collect()
    listed = [(r.doc_id, r.text) for r in docs.collect()]
    marks = {(r.doc_id, r.quality) for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    want = sorted((str(i), round(w, 4), round(key, 4)) for i, _, w, key in plain_models.resampled(listed, marks))
    assert sorted((str(r.doc_id), round(r.log_weight, 4), round(r.gumbel_key, 4)) for r in got) == want
    assert 0 < len(want) < len(listed)


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice([1.0, 2.0, rng.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 700, 1500, 2999, 3000, 4000):
        assert quality.kth_largest(df, "key", k, 8, 20) == sorted(values, reverse=True)[min(k, 3000) - 1]
    equal = [0.5] * 3000 + [1 + k / 64 for k in range(40)]  # nearly all alike, and others above
    many = spark.createDataFrame([(v,) for v in equal], "key double")
    for k in (1, 7, 40, 41, 3040):
        assert quality.kth_largest(many, "key", k, 8, 5) == sorted(equal, reverse=True)[k - 1]
    assert quality.kth_largest(df, "key", 0) is None and quality.kth_largest(df.limit(0), "key", 3) is None


def test_quality_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    assert quality.keep_good(docs, labels.where("quality = 1")).count() == docs.count()
    assert quality.keep_good(docs.limit(0), labels).count() == 0


def test_grams_see_repeats():
    g = quality.grams("aa bb aa bb bb cc")
    assert Counter((g[g >= quality.GRAMS] - quality.GRAMS).tolist()) == {0: 3, 2: 2, 1: 1}
    assert len(quality.grams(None)) == 0 and len(quality.grams("é")) > 0


def test_toxicity_on_held_out_rows(spark, labelled, sf_dir):
    docs, labels = labelled
    got = toxicity.op8_toxicity(spark, sf_dir(documents=docs, labels=labels)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 7 == 0) for r in held)
    assert right >= 0.95 * len(held)


def test_patterns():
    lex = toxicity.Lexicon({"zorg": 3.0, "blorf": 2.0}, {"blarg": 2.0})
    names = lambda s: toxicity.names(s, lex)
    for lone in ("a zorg thing", "zorg", "blargling", "kill time", "not kill", "she said so. a b c d e f g h i zorg", ""):
        assert names(lone) == [] and (toxicity.features(lone, lex)[:-1] == 0).all()
    assert names("you zorg") == names("zorg of a you") == [("attack", 3.0)] and names("zorg a b c d you") == []
    assert names("not a zorg") == [("denied", 3.0)] and names("x said it was zorg") == [("quoted", 3.0)]
    assert names("kill you") == [("menace", 1.0)] and names("not kill you") == [("denied", 1.0)] and names("x said kill you") == [("quoted", 1.0)]
    assert names("a zorg and blorf") == [("chain", 2.0)] and names("blargs a blarging") == [("cluster", 2.0)]
    assert names("zorg. you") == [] and names("a zorg. the blorf! so\nzorg") == [("again", 2.0), ("again", 3.0)]
    assert names("blarga. blargb") == [("stray again", 2.0)] and names("you zorg. a blorf") == [("attack", 3.0), ("again", 2.0)]


def every_path(machines, letters):
    """All that the machines can write, one after the other, with the weight of each way."""
    tapes = [([x for x, _ in letters], 0.0)]
    for m in machines:
        out = []
        for tape, weight in tapes:
            rows = [((), weight, m.start)]
            for x, (_, strength) in zip(tape, letters):
                rows = [((*o, y), w + v * strength, after) for o, w, state in rows for y, v, after in m.step(state, x)]
            out += [(list(o), w) for o, w, state in rows if m.final(state)]
        tapes = out
    return tapes


def test_composed_machine_against_all_paths():
    rng = random.Random(6)
    parts = [toxicity.negating(), toxicity.reporting(), toxicity.aiming(), toxicity.matching()]
    for _ in range(400):
        letters = [(x, 0.0 if x in ".ynq" else rng.choice([1.0, 2.5, 4.0])) for x in rng.choices(".istynq", [6, 3, 1, 1, 2, 1, 1], k=rng.randint(1, 11))]
        weight, out = toxicity.CLAUSE.best(letters)
        ways = every_path(parts, letters)
        assert abs(weight - max(w for _, w in ways)) < 1e-9
        strengths = [v for _, v in letters]
        written = [[(name, v) for name, v in zip(o, strengths) if name != toxicity.FILLER] for o, w in ways if abs(w - weight) < 1e-9]
        assert out in written


def test_score_against_the_formula(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {(r.doc_id, round(r.score, 9)) for r in toxicity.scored(docs, model).collect()}
    for r in docs.collect():
        x = dict.fromkeys(toxicity.NAMES, 0.0)
        found = toxicity.names(r.text, model.lexicon)
        for name, v in found:
            x[name] += v
        every = [math.log1p(v) for v in (*x.values(), max((v for _, v in found), default=0), len(found), len(r.text or ""))]
        z = sum(a * b for a, b in zip(every, model.curve)) + model.curve[-1]
        assert (r.doc_id, round(1 / (1 + math.exp(-z)), 9)) in got


def test_long_clauses_are_cut_at_spaces(monkeypatch):
    lex = toxicity.Lexicon({"zorg": 3.0}, {})
    text = "some words, you zorg. " * 50 + "x" * 90 + " " + "a b " * 60 + "you zorg"
    want = toxicity.names(text, lex)
    monkeypatch.setattr(toxicity, "CUT", 40)
    assert "".join(toxicity._parts(text)) == text and toxicity.names(text, lex) == want and len(want) == 51


def test_toxicity_never_reads_other_columns_or_held_out_labels(spark, labelled):
    docs, labels = labelled
    from pyspark.sql import functions as F

    first = toxicity.fit(docs, labels)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    second = toxicity.fit(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), turned)
    assert first.lexicon.words == second.lexicon.words and np.array_equal(first.curve, second.curve)
    assert toxicity.scored(docs.limit(0), first).count() == 0


def test_toxicity_without_labels(spark, make_docs):
    model = toxicity.fit(make_docs([(1, "x y"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [round(r.score, 6) for r in toxicity.scored(make_docs([(1, "x"), (2, None)]), model).collect()] == [0.05, 0.05]


def tokens(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_language_model_base_against_brute_force(spark, labelled, sf_dir, monkeypatch):
    docs, _ = labelled
    monkeypatch.setattr(language_model, "_BLOCK_TOKENS", 4000)
    got = language_model.op5_language_model(spark, sf_dir(documents=docs)).collect()
    listed = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    seen = Counter(w for i, t in listed if not held(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)

    def key(i, n_tokens, known, base):
        return str(i), n_tokens, known, round(base, 6)

    want = sorted(key(i, len(tokens(t)), sum(w in seen for w in tokens(t)), sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in listed)
    assert sorted(key(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.held_out == held(r.doc_id) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than single words on texts never seen


def plain_scores(model, listed, held):
    """The model's log10 chance of each text, token by token, from its weights."""
    lm, mask = language_model, (1 << 64) - 1
    code = lambda w: lm.xxhash.xxh64_intdigest(w, 42)
    word = lambda w: lm._END_WORD if w is None else w.encode()
    seen = Counter(word(w) for i, t in listed if not held(i) for w in tokens(t))
    slots = dict(zip(model.heads.hashes.tolist(), model.heads.slots.tolist()))

    def row(f, key):
        salt = int(lm._SALTS[f])
        x = (key + 1) * salt & mask
        x ^= x >> 29
        return (x * salt & mask) >> (64 - lm.BITS)

    def chances(rows):
        z = model.weights[rows].astype(float).sum(axis=0)
        e = np.exp(z - z.max())
        return e / e.sum()

    out = []
    share = (model.totals[:, 0] + 0.5) / (model.totals[:, 0] + 0.5).sum()
    for _, text in listed:
        ws, total = [word(w) for w in tokens(text)], 0.0
        for k, w in enumerate(ws):
            h = [(code(ws[k - j]) >> 32) + 1 if k >= j else 0 for j in (1, 2)]
            c = [lm.class_of(ws[k - j]) if k >= j else lm.CLASSES for j in (1, 2, 3)]
            own, n = lm.class_of(w), lm.CLASSES + 1
            p = chances([row(f, x) for f, x in enumerate((0, h[0], h[1], c[0], c[0] * n + c[1], c[1] * n + c[2], (c[0] * n + c[1]) * n + c[2]))])
            q = chances([lm.TABLE + row(lm.FEATURES + f, x) for f, x in enumerate((h[0] * n + own, h[1] * n + own, (c[0] * n + c[1]) * n + own))] + [2 * lm.TABLE + own])
            slot = slots.get(code(w), 0)
            inside = q[slot] if slot else q[0] * (seen[w] + 0.5) / (model.rest[own][0] + 0.5 * (model.rest[own][1] + 1))
            total += math.log10((p[own] + (p[lm.REPEAT] * share[own] if k == 0 else 0)) * inside + (p[lm.REPEAT] if k and ws[k - 1] == w else 0))
        out.append(total)
    return out


def test_language_model_score_against_brute_force(spark, labelled, monkeypatch):
    docs, _ = labelled
    docs = docs.where("doc_id IS NULL OR doc_id < 200 OR doc_id > 1000")
    monkeypatch.setattr(language_model, "_BLOCK_TOKENS", 3000)
    monkeypatch.setattr(language_model, "_SLICE", 700)
    model, *rest = language_model.fit(docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    every = [(r.doc_id, r.text) for r in docs.collect()]
    got = {}
    for r in language_model.score(rest[0], rest[1], model, *rest[2:]).collect():
        got.setdefault(str(r.doc_id), []).append(round(r.score, 3))
    want = plain_scores(model, every, held)
    for (i, t), x in zip(every, want):
        assert any(abs(x - y) < 0.002 * max(1, len(t or "") / 100) for y in got[str(i)])


def test_language_model_probabilities_add_up(spark, labelled):
    """In any context the chances of all known words and of the unknown ones add up to one."""
    lm, (docs, _) = language_model, labelled
    docs = docs.where("doc_id < 60")
    model, *_ = lm.fit(docs)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    seen = Counter(lm._END_WORD if w is None else w.encode() for r in docs.collect() if not held(r.doc_id) for w in tokens(r.text))
    words = sorted(seen)
    hashes = np.array([lm.xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
    classes = np.array([lm.class_of(w) for w in words])
    slots = model.heads.of(hashes)
    assert (slots > 0).sum() == len(model.heads.hashes) and model.totals[:, 1].sum() == len(words)
    block = lm.Block.__new__(lm.Block)
    block.codes, block.classes, block.hashes = (hashes >> np.uint64(32)).astype(np.uint32), classes, hashes
    n = len(words)
    block.tokens = np.array([[3, 5, w] for w in range(n)]).ravel()
    block.sizes = np.full(n, 3)
    counts = np.array([seen[w] for w in words], float)
    total = (10 ** model.scores(block, counts)).reshape(n, 3)[:, 2].sum()
    text = np.array([3, 5, 7])
    by_class, by_place = lm._context(block.codes[text], classes[text], np.arange(3))
    p = lm._chances(model.weights, by_class)[2]
    for c in range(lm.CLASSES):
        if c != lm.REPEAT:  # the share of the class that no known word has
            x = np.array([3, 5, int(np.flatnonzero(classes == c)[0])]) if (classes == c).any() else None
            q = lm._chances(model.weights, lm._context(block.codes[x], classes[x], np.arange(3))[1])[2] if x is not None else [1.0]
            total += p[c] * q[0] * 0.5 / (model.rest[c, 0] + 0.5 * (model.rest[c, 1] + 1))
    assert abs(total - 1) < 1e-4


def test_language_model_of_nothing(spark, make_docs):
    assert language_model.scores(make_docs([(1, "x")]).limit(0)).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = language_model.scores(make_docs([(only_held, None)])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (1, 0, 0, 0.0)
