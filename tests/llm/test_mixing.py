from __future__ import annotations

import random
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import functions as F

from tessera.llm import mixing


def filled(budget, children):
    """What water-filling gives ``children`` (name, cap, weight), by raising one level until it is spent."""
    out = {n: Fraction(0) for n, _, _ in children}
    live = [(n, c, w) for n, c, w in children if w > 0 and c > 0]
    left = Fraction(budget)
    while live and left > 0:
        level = min([left / sum(w for _, _, w in live), *((c - out[n]) / w for n, c, w in live)])
        for n, _, w in live:
            out[n] += level * w
        left -= level * sum(w for _, _, w in live)
        live = [(n, c, w) for n, c, w in live if out[n] < c]
    return {n: int(x) for n, x in out.items()}


def test_shares_equal_water_filling(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for g in range(40):
        children = [(f"n{k}", rng.choice([0, 1, 5, rng.randint(0, 500)]), rng.choice([0, 1, 1, 3, 7])) for k in range(rng.randint(1, 7))]
        budget = rng.randint(0, 900)
        rows += [(g, budget, *c) for c in children]
        want |= {(g, n): x for n, x in filled(budget, children).items()}
    df = spark.createDataFrame(rows, "g int, budget long, name string, cap long, weight long")
    got = {(r.g, r["name"]): r.target for r in mixing.share(df, ["g"], "name").collect()}
    assert {k: v or 0 for k, v in got.items()} == want


def documents(make_docs, prose):
    rng = random.Random(6)
    listed = [(k, prose(k, rng.randint(0, 60))) for k in range(150)]
    return make_docs([*listed, (150, None), (151, ""), (152, prose(1, 20_000)), (30, prose(7, 9)), (30, prose(8, 9)), (None, prose(9, 9))])


def test_query_equals_its_sql(spark, make_docs, sf_dir, duck, rows, prose):
    docs = documents(make_docs, prose).withColumn("lang", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(F.col("source"), (F.col("doc_id") % 3).cast("string"))))
    path = sf_dir(documents=docs)
    assert rows(mixing.op10_mixing(spark, path)) == duck(path, mixing.ORACLE_SQL)
    for mix in (replace(mixing.PRODUCTION, percent=250), replace(mixing.PRODUCTION, percent=1000, sources={"src1": 9, "src10": 0}), replace(mixing.PRODUCTION, percent=0), replace(mixing.PRODUCTION, percent=20, seed=3)):
        got = rows(mixing.mixed(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang", "source"), mix).drop("text"))
        assert got == duck(path, mixing._oracle(mix))


def test_prefixes_fit_and_are_as_long_as_they_can(make_docs, prose):
    mix = replace(mixing.PRODUCTION, percent=60)
    docs = documents(make_docs, prose)
    leaves = {tuple(r[c] for c in mixing.LEAF): r for r in mixing.plan(docs, mix).collect()}
    used = mixing.mixed(docs, mix)
    assert used.columns == [c for c in docs.columns if c not in ("domain", "epochs")] + ["domain", "n_tokens", "epochs"]
    spent = {(r.domain, r.lang or "", r.source or ""): r.n for r in used.groupBy("domain", "lang", "source").agg(F.sum(F.col("n_tokens") * F.col("epochs")).alias("n")).collect()}
    for leaf, r in leaves.items():
        assert spent.get(leaf, 0) <= r.target
    total = docs.select(F.sum(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))).first()[0]
    assert sum(r.target for r in leaves.values()) <= total * 60 // 100


def test_other_paths_give_the_same(spark, make_docs, prose, rows, monkeypatch):
    docs = documents(make_docs, prose)
    want = rows(mixing.mixed(docs).select("doc_id", "n_tokens", "epochs"))
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert rows(mixing.mixed(docs).select("doc_id", "n_tokens", "epochs")) == want
    assert mixing.mixed(docs.limit(0)).count() == 0
