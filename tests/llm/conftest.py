from __future__ import annotations

import os
import random

import duckdb
import pytest

#: Columns that clash with names the operators use inside; they must come through or be ignored.
EXTRA = "spans string, fp long, key string, domain string, epochs int, __found string, __log_weight double, whole int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with languages, sources and clashing further columns."""

    def make(rows, extra: bool = True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {EXTRA}" if extra else "")
        more = ("s", 1, "k", "d", 2, "f", 0.5, 3) if extra else ()
        return spark.createDataFrame([(i, t, *(("en", "src1") if i is None else (["en", "de"][i % 2], f"src{i % 3}")), len(t or ""), *more) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def prose():
    """Deterministic texts: ``prose(seed, n)`` has n words."""
    stems = [a + b + c for a in ("th", "er", "on", "an", "re", "in") for b in ("ea", "ou", "i", "a") for c in ("nd", "st", "", "ng", "r")]

    def text(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(stems) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    return text


@pytest.fixture
def sf_dir(tmp_path, spark):
    """Write frames as tables of a data folder."""

    def write(**tables):
        for name, df in tables.items():
            df.coalesce(2).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def duck():
    """Rows of SQL over a data folder."""

    def query(path: str, sql: str):
        con = duckdb.connect()
        for name in os.listdir(path):
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}/{name}/*.parquet'")
        df = con.execute(sql).df()
        return sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist()), key=repr)

    return query


@pytest.fixture
def rows():
    def collect(df):
        names = sorted(df.columns)
        return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)

    return collect
