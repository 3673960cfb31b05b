"""Files of every format, journals and counters, the command line, streams of rows, and the registered queries."""

from __future__ import annotations

import io
import os
import sys

import pytest

import __spark_entry__
from tessera import cli, queries, tablegen
from tessera.console import write_result
from tessera.errors import SqlError
from tessera.plans.nodes import Relation
from tessera.session import Session
from tessera.sources import formats
from tessera.sources.base import Column
from tessera.sources.files import FileStore
from tessera.streaming.rows import drive

FORMATS = ["csv", "json", "toml", "yaml", "xml"]


@pytest.fixture
def open_db(spark, tmp_path):
    def make(extension="csv"):
        session = Session(spark, FileStore(spark, str(tmp_path), default=extension))

        def run(*texts):
            for text in texts:
                result = session.sql(text)
                if not result.success:
                    raise SqlError(result.error)
            return [tuple(r) for r in result.rows] if result.df is not None else result.message

        run.session = session
        return run

    return make


@pytest.mark.parametrize("extension", FORMATS)
def test_formats_keep_every_value(open_db, tmp_path, extension):
    db = open_db(extension)
    db("CREATE TABLE t (id AUTO_INCREMENT, a = 'x' + '\"', b)")
    values = ["'plain'", "''", "NULL", "'  blanks  '", "'q\"u,o''te'", "'<a> & [b] {c} # - d'", "'é😀\\n'", "'1.50'"]
    for v in values:
        db(f"INSERT INTO t (b) VALUES ({v})")
    want = [(str(k + 1), 'x"', v.strip("'").replace("''", "'") if v != "''" else "") for k, v in enumerate(values)]
    assert db("SELECT * FROM t") == want
    assert os.path.exists(tmp_path / f"t.{extension}.append")
    db("UPDATE t SET a = a WHERE id > 0")  # the file is written anew and the journal goes
    assert not os.path.exists(tmp_path / f"t.{extension}.append")
    assert db("SELECT * FROM t") == want and db("SELECT COUNT(*) FROM t WHERE b IS NULL") == [("1",)]
    db("INSERT INTO t (b) VALUES (more)")
    assert db("SELECT id FROM t ORDER BY id DESC LIMIT 1") == [("9",)]
    assert db(f"SELECT b FROM t.{extension} WHERE id = 9") == db(f"SELECT b FROM '{tmp_path}/t.{extension}' x WHERE x.id = 9") == [("more",)]
    assert [c.stored for c in db.session.store.describe(Relation("t"))] == ["id AUTO_INCREMENT", "a DEFAULT(('x' + '\"'))", "b"]
    db("DELETE FROM t WHERE id >= 1")
    assert db("SELECT * FROM t") == []
    db("DROP TABLE t")
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("extension", ["json", "toml", "yaml", "xml"])
def test_line_breaks_in_values(open_db, extension):
    db = open_db(extension)
    db("CREATE TABLE t (a)", "INSERT INTO t VALUES ('one\ntwo\r\n')", "INSERT INTO t VALUES ('a\tb')", "UPDATE t SET a = a")
    assert db("SELECT a FROM t") == [("one\ntwo\r\n",), ("a\tb",)]


def test_csv_has_no_line_breaks(open_db):
    db = open_db()
    db("CREATE TABLE t (a)", "INSERT INTO t VALUES ('one\ntwo')")
    assert db("SELECT a FROM t") == [("one\ntwo",)]  # the journal can hold it, the file cannot
    with pytest.raises(SqlError, match="line breaks"):
        db("UPDATE t SET a = a")
    assert db("SELECT a FROM t") == [("one\ntwo",)]


def test_files_written_by_hand(open_db, tmp_path):
    (tmp_path / "c.csv").write_text('id,"the, name"\n1,"a ""b"""\n2, spaced \n')
    (tmp_path / "j.json").write_text('{"columns": ["a", "b"], "rows": [["1", "x"], ["2", "y"]]}')
    (tmp_path / "t.toml").write_text('# made by hand\ncolumns = ["a"]\nrows = [\n  ["1"],\n  # none\n  ["2"]\n]\n')
    (tmp_path / "y.yml").write_text('columns:\n  - "a"\nrows:\n  - ["1"]\n')
    (tmp_path / "x.xml").write_text("<table>\n<columns>\n<column>a</column>\n</columns>\n<rows>\n<row><value>1 &lt; 2</value></row>\n</rows>\n</table>\n")
    db = open_db()
    assert db("SELECT * FROM c") == [("1", 'a "b"'), ("2", " spaced ")]
    assert db("SELECT b FROM j WHERE a = 2") == [("y",)] and db("SELECT * FROM t") == [("1",), ("2",)]
    assert db("SELECT * FROM y") == [("1",)] and db("SELECT * FROM x") == [("1 < 2",)]
    (tmp_path / "c.json").write_text('{"columns": ["a"], "rows": []}')
    with pytest.raises(SqlError, match="Ambiguous"):
        db("SELECT * FROM c")
    assert db("SELECT * FROM c.json") == []
    (tmp_path / "bad.json").write_text('{"columns": ["a", "b"],\n"rows": [\n["1"]\n]}\n')
    with pytest.raises(Exception, match="mismatch"):
        db("SELECT * FROM bad")


def test_quotes_in_csv_fields(open_db, tmp_path):
    (tmp_path / "q.csv").write_text('a"b"c,"x, y"\na"b"c,plain\n"","q""q"\npre"in,side"post,"""lone"""\n\n"a""b""c",""\n')
    db = open_db()
    assert db.session.table("SELECT * FROM q").columns == ["abc", "x, y"]
    assert db("SELECT * FROM q") == [("abc", "plain"), ("", 'q"q'), ("prein,sidepost", '"lone"'), ('a"b"c', "")]
    for bad, why in (('a,b\n1,"open\n', "Unterminated"), ("a,b\n1\n", "mismatch")):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception, match=why):
            db("SELECT * FROM bad")


def test_headers_of_any_length(open_db, tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "_READ", 7)
    names = [f"column_{k}" for k in range(30)]
    for extension in ("csv", "json", "toml", "yaml", "xml"):
        db = open_db()
        db(f"CREATE TABLE 'w{extension}.{extension}' ({', '.join(names)})", f"INSERT INTO w{extension} VALUES ({', '.join(map(str, range(30)))})", f"UPDATE w{extension} SET column_0 = x")
        assert db(f"SELECT * FROM w{extension}") == [("x", *map(str, range(1, 30)))]
    (tmp_path / "late.json").write_text('{"rows": [["1", "2"], ["3", "4"]], "columns": ["a", "b"]}')
    assert open_db()("SELECT b FROM late") == [("2",), ("4",)]


def test_parquet_files_are_typed(open_db, spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 0.5 AS h").write.parquet(str(tmp_path / "p.parquet"))
    db = open_db()
    assert db("SELECT COUNT(*), SUM(h) FROM p WHERE id > 2") == [("2", "3.5")]
    assert db("SELECT COUNT(*) FROM 'p.parquet' q WHERE q.id = 1") == [("1",)]
    with pytest.raises(SqlError, match="read-only"):
        db("INSERT INTO p VALUES (1, 2)")


def test_views_are_files(open_db, tmp_path):
    db = open_db()
    db("CREATE TABLE t (a)", "INSERT INTO t VALUES (5)", "CREATE VIEW v AS SELECT a FROM t WHERE a > '4'")
    assert (tmp_path / "v.view.sql").read_text() == "SELECT a FROM t WHERE (a > '4')"
    assert open_db()("SELECT v.a FROM v") == [("5",)] and db(f"SELECT v.a FROM '{tmp_path}/v.view.sql'") == [("5",)]
    db("DROP VIEW v")
    assert not (tmp_path / "v.view.sql").exists()


def test_stored_names():
    for c in (Column("a"), Column("a b", True), Column("x", False, "(1 + f(2))"), Column("y", True, "'DEFAULT(z)'")):
        assert Column.parse(c.stored) == c
    with pytest.raises(SqlError):
        formats.register("csv", formats.Csv)


def test_an_interrupted_write_leaves_the_table(open_db, tmp_path):
    db = open_db()
    db("CREATE TABLE t (a)", "INSERT INTO t VALUES (1)")
    with pytest.raises(SqlError):
        db("UPDATE t SET a = 'x' * 2")
    assert db("SELECT a FROM t") == [("1",)] and not [x for x in os.listdir(tmp_path) if x.endswith(".new")]


def test_console(open_db):
    db = open_db()
    db("CREATE TABLE t (name, n)", "INSERT INTO t VALUES (abc, 1.5)", "INSERT INTO t VALUES (x, NULL)")
    out = io.StringIO()
    write_result(out, db.session.sql("SELECT name, n / 2 AS half FROM t"))
    assert out.getvalue() == "+------+------+\n| name | half |\n+------+------+\n| abc  | 0.75 |\n| x    | NULL |\n+------+------+\n2 row(s) selected\n"
    for text, said in (("DELETE FROM t", "Deleted 2 row(s) from 't'\n"), ("SELECT q FROM t", "")):
        out = io.StringIO()
        write_result(out, db.session.sql(text))
        assert out.getvalue() == said


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["TABLE", "t", "(a)"], "CREATE", spark) == 0
    assert cli.main(["INTO t VALUES (5)"], "INSERT", spark) == 0
    assert cli.main(["SELECT", "a", "FROM", "t"], spark=spark) == 0
    assert "1 row(s) selected" in capsys.readouterr().out
    assert cli.main(["SELECT q FROM t"], spark=spark) == 1 and cli.main(["SELEC"], spark=spark) == 1
    assert "Unknown column" in capsys.readouterr().err
    monkeypatch.setattr("sys.stdin", io.StringIO("SELECT COUNT(*) FROM t;"))
    assert cli.main([], spark=spark) == 0
    for args in (["--help"], ["--help", "select"], ["help", "alter"]):
        assert cli.main(args) == 0
    assert "ORDER BY" in capsys.readouterr().out


def test_results(open_db):
    db = open_db()
    db("CREATE TABLE t (a)", *[f"INSERT INTO t VALUES ({k})" for k in range(5)])
    result = db.session.sql("SELECT a FROM t")
    assert result.success and result.kind == "Select" and result.affected_rows == 5 and result.message == "5 row(s) selected"
    assert list(result.rows) == list(result.rows)  # it can be opened again
    seen = []
    assert drive(iter(result.rows), lambda r: seen.append(r[0]) or len(seen) < 3) == 3 and seen == ["0", "1", "2"]
    failed = db.session.sql("SELECT a FROM nowhere")
    assert not failed.success and "does not exist" in failed.error
    with pytest.raises(SqlError):
        db.session.table("DELETE FROM nowhere")


def test_generated_table(spark, tmp_path):
    store = FileStore(spark, str(tmp_path))
    store.save(Relation("gen"), [Column("id", True), Column("name"), Column("city"), Column("country")], tablegen.people(spark, 50))
    session = Session(spark, store)
    assert session.sql("SELECT COUNT(*) AS n FROM gen WHERE name != '' AND city != ''").df.first().n == "50"
    assert store.next_number(Relation("gen")) == 51
    assert tablegen.people(spark, 50).collect() == tablegen.people(spark, 50).collect()


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries(spark, name):
    import duckdb

    df = queries.QUERIES[name](spark, DATA)
    if name not in queries.ORACLES:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for table in queries.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name]).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(frame):
        cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
        return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)

    assert rows(got) == rows(want)


def test_entry_points():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names) and set(queries.QUERIES) <= set(names)


def test_entry_without_the_training_data_operators(monkeypatch):
    """A missing package, or subpackage, leaves the other queries."""
    for name in list(sys.modules):
        if name == "corpus_pipeline" or name.startswith("tessera.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert set(__spark_entry__.queries()) == set(queries.QUERIES) and set(__spark_entry__.oracle_sql()) == set(queries.ORACLES)
    for name in list(sys.modules):
        if name.startswith("tessera.llm"):
            monkeypatch.delitem(sys.modules, name)
