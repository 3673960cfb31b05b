"""Queries for every operator of the dialect, each with SQL that another engine runs.

A query goes through a session as a statement.  Sums of doubles depend on the
order of addition, so both sides round them, outside the dialect.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import cli
from tessera.console import write_result
from tessera.errors import SqlError
from tessera.plans.nodes import Relation
from tessera.session import Session
from tessera.sources.base import ORDER, Column
from tessera.sources.files import FileStore
from tessera.sources.memory import MemoryStore
from tessera.streaming.rows import drive
from tessera.tablegen import NAMES, PLACES, people

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]


def session_over(spark: SparkSession, sf_dir: str) -> Session:
    """A session in which the Parquet tables of a folder have their names."""
    store = LazyTables(spark, sf_dir)
    return Session(spark, store)


class LazyTables(MemoryStore):
    """Tables of a folder that are opened when a statement names them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir

    def has_table(self, table: Relation) -> bool:
        self._open(table.name)
        return super().has_table(table)

    def describe(self, table: Relation):
        self._open(table.name)
        return super().describe(table)

    def read(self, table: Relation):
        self._open(table.name)
        return super().read(table)

    def _open(self, name: str) -> None:
        if name in TABLES and name not in self.typed and name not in self.tables:
            self.register(name, self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))


@dataclass(frozen=True)
class Case:
    """A statement, what may come before it, and the SQL that gives the same rows."""

    statement: str
    sql: str | None
    before: Sequence[str] = ()
    rounded: Sequence[str] = ()
    copied: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        session = session_over(spark, sf_dir)
        if self.copied:
            copy_as_text(session, self.copied)
        for text in self.before:
            result = session.sql(text)
            if not result.success:
                raise RuntimeError(f"{text}: {result.error}")
        df = session.table(self.statement)
        return df.withColumns({c: F.round(c, 2) for c in self.rounded}) if self.rounded else df


def copy_as_text(session: Session, name: str) -> None:
    """Make ``<name>_copy``, a table of text that statements can change."""
    df = session.store.read(Relation(name)).df
    columns = session.store.describe(Relation(name))
    plain = {"double": lambda c: F.round(c).cast("long"), "timestamp": F.to_date, "timestamp_ntz": F.to_date}  # of which both engines write the same text
    texts = df.select(*[plain.get(kind, lambda x: x)(F.col(c)).cast("string").alias(c) for c, kind in df.dtypes], F.col("c0").cast("long").alias(ORDER))
    session.store.save(Relation(f"{name}_copy"), [Column(c.name) for c in columns], texts)


NATION_TEXT = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"

ORDERS_STATUS = "CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderstatus || '/' || o_orderpriority ELSE o_orderstatus END AS o_orderstatus"
ORDERS_TEXT = f"SELECT * FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, {ORDERS_STATUS}, CAST(round(o_totalprice) AS BIGINT)::VARCHAR AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders)"

CASES: dict[str, Case] = {
    # Projection and scalar operators.
    "q_scan_all": Case("SELECT * FROM nation", "SELECT * FROM nation"),
    "q_project_arith": Case("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "q_project_divide": Case("SELECT o_orderkey, o_totalprice / 7 AS d, o_totalprice / 0 AS e FROM orders", "SELECT o_orderkey, o_totalprice / 7 AS d, CASE WHEN o_totalprice > 0 THEN 'inf'::DOUBLE WHEN o_totalprice < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS e FROM orders"),
    "q_project_modulo": Case("SELECT p_partkey, p_partkey % 7 AS m FROM part", "SELECT p_partkey, p_partkey % 7 AS m FROM part"),
    "q_project_unary": Case("SELECT c_custkey, - c_acctbal AS n, + c_acctbal AS p, ~ c_custkey AS b FROM customer", "SELECT c_custkey, - c_acctbal AS n, c_acctbal AS p, ~c_custkey AS b FROM customer"),
    "q_concat_plus": Case("SELECT n_nationkey, n_name + '-x' AS n, n_name + n_regionkey AS k FROM nation", "SELECT n_nationkey, n_name || '-x' AS n, n_name || n_regionkey AS k FROM nation"),
    "q_project_logic": Case("SELECT n_nationkey, n_regionkey = 1 AS e, n_regionkey < 2 || n_name LIKE 'N%' AS o, ! (n_regionkey) AS z FROM nation", "SELECT n_nationkey, (n_regionkey = 1)::INT AS e, (n_regionkey < 2 OR n_name LIKE 'N%')::INT AS o, (n_regionkey = 0)::INT AS z FROM nation"),
    "q_project_names": Case("SELECT n_nationkey, n_regionkey + 1, n_name AS 'the name' FROM nation", 'SELECT n_nationkey, n_regionkey + 1.0::DOUBLE AS "(n_regionkey + 1)", n_name AS "the name" FROM nation'),
    # Filters.
    "q_filter_compare": Case("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount != 0.05", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount <> 0.05"),
    "q_filter_like": Case("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'"),
    "q_filter_regexp": Case("SELECT c_custkey, c_name FROM customer WHERE c_name REGEXP '[05]$'", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[05]$')"),
    "q_filter_between": Case("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000"),
    "q_filter_in": Case("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', NULL)", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "q_filter_not_in": Case("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3, NULL)", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)"),
    "q_filter_bitwise": Case("SELECT p_partkey FROM part WHERE (p_size & 6) = 2 OR (p_size ^ 1) = 8 OR (p_size | 16) = 31", "SELECT p_partkey FROM part WHERE (p_size & 6) = 2 OR xor(p_size, 1) = 8 OR (p_size | 16) = 31"),
    "q_filter_bit_precedence": Case("SELECT p_partkey FROM part WHERE p_size & 2 = 2", "SELECT p_partkey FROM part WHERE (p_size & 1) <> 0"),
    "q_filter_not": Case("SELECT n_nationkey FROM nation WHERE NOT (n_regionkey = 1) AND ! (n_name LIKE 'A%')", "SELECT n_nationkey FROM nation WHERE NOT n_regionkey = 1 AND NOT n_name LIKE 'A%'"),
    "q_filter_is_null": Case("SELECT n_nationkey FROM nation WHERE n_name IS NOT NULL AND NOT (n_regionkey IS NULL)", "SELECT n_nationkey FROM nation WHERE n_name IS NOT NULL AND n_regionkey IS NOT NULL"),
    "q_filter_null_logic": Case("SELECT n_nationkey FROM nation WHERE NOT (n_regionkey = NULL)", "SELECT n_nationkey FROM nation"),
    "q_filter_time": Case("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    "q_filter_bare_word": Case("SELECT r_regionkey FROM region WHERE r_name = ASIA", "SELECT r_regionkey FROM region WHERE r_name = 'ASIA'"),
    # Aggregates.
    "q_agg_global": Case("SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_extendedprice) AS a, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 2) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem", rounded=("s", "a")),
    "q_agg_count_expr": Case("SELECT COUNT(p_name) AS n, COUNT(p_size) AS m FROM part", "SELECT count(nullif(p_name, '')) AS n, count(p_size) AS m FROM part"),
    "q_agg_min_max": Case("SELECT MIN(c_name) AS a, MAX(c_name) AS b, MIN(c_acctbal) AS c, MAX(c_nationkey) AS d FROM customer", "SELECT min(c_name) AS a, max(c_name) AS b, min(c_acctbal) AS c, max(c_nationkey) AS d FROM customer"),
    "q_agg_group": Case("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, AVG(l_discount) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 2) AS d FROM lineitem GROUP BY ALL", rounded=("q", "d")),
    "q_agg_having": Case("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000"),
    "q_agg_expr": Case("SELECT n_regionkey, SUM(n_nationkey) / COUNT(*) AS a, n_regionkey + 10 AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, sum(n_nationkey)::DOUBLE / count(*) AS a, n_regionkey + 10.0::DOUBLE AS k FROM nation GROUP BY n_regionkey"),
    "q_agg_order": Case("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY COUNT(*) DESC, c_mktsegment LIMIT 3", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 3"),
    "q_agg_join": Case("SELECT n.n_name, SUM(c.c_acctbal) AS s FROM nation n, customer c WHERE n.n_nationkey = c.c_nationkey GROUP BY n.n_name", "SELECT n_name AS \"n.n_name\", round(sum(c_acctbal), 2) AS s FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name", rounded=("s",)),
    "q_agg_shaped": Case("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 5", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 5)", rounded=("s",)),
    "q_agg_shaped_distinct": Case("SELECT DISTINCT COUNT(*) AS n, SUM(k) AS s FROM (SELECT c_nationkey AS k FROM customer) d", "SELECT count(*) AS n, sum(c_nationkey)::DOUBLE AS s FROM (SELECT DISTINCT c_nationkey FROM customer)"),
    "q_agg_empty": Case("SELECT SUM(l_quantity) AS s, AVG(l_quantity) AS a, COUNT(*) AS n, MIN(l_quantity) AS m FROM lineitem WHERE l_quantity < 0", "SELECT 0.0::DOUBLE AS s, 0.0::DOUBLE AS a, count(*) AS n, min(l_quantity) AS m FROM lineitem WHERE l_quantity < 0"),
    # Sources and joins.
    "q_join_two": Case("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND c_acctbal > 5000", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000"),
    "q_join_three": Case("SELECT c_custkey, n_name, r_name FROM customer, nation AS n, region r WHERE c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "q_join_theta": Case("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey BETWEEN 3 AND 9", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey BETWEEN 3 AND 9"),
    "q_join_self": Case("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey != b.s_suppkey", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey"),
    "q_join_product": Case("SELECT * FROM region, nation", 'SELECT r_regionkey AS "region.r_regionkey", r_name AS "region.r_name", n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey" FROM region, nation'),
    "q_join_derived": Case("SELECT d.k, d.n, n_name FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey) d, nation WHERE d.k = n_nationkey", 'SELECT k AS "d.k", n AS "d.n", n_name FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL) JOIN nation ON k = n_nationkey'),
    "q_source_alias": Case("SELECT r_name FROM region r WHERE r.r_regionkey > 1", "SELECT r_name FROM region WHERE r_regionkey > 1"),
    # Subqueries.
    "q_sub_scalar": Case("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "q_sub_projection": Case("SELECT r_name, (SELECT COUNT(*) FROM nation) AS n, EXISTS (SELECT * FROM nation WHERE n_nationkey > 99) AS e FROM region", "SELECT r_name, (SELECT count(*) FROM nation) AS n, 0 AS e FROM region"),
    "q_sub_exists": Case("SELECT r_name FROM region WHERE EXISTS (SELECT n_name FROM nation WHERE n_regionkey = 3)", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 3)"),
    "q_sub_in": Case("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"),
    "q_sub_not_in": Case("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "q_sub_in_nested": Case("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer WHERE c_nationkey = 1 OR c_custkey NOT IN (SELECT o_custkey FROM orders)", "SELECT c_custkey, (c_custkey IN (SELECT o_custkey FROM orders))::INT AS has FROM customer WHERE c_nationkey = 1 OR c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "q_sub_any": Case("SELECT p_partkey FROM part WHERE p_size > ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) AND p_size = ANY (SELECT n_nationkey FROM nation) AND p_size != ANY (SELECT n_nationkey FROM nation WHERE n_nationkey = 8)", "SELECT p_partkey FROM part WHERE p_size > (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 4) AND p_size IN (SELECT n_nationkey FROM nation) AND p_size <> 8"),
    "q_sub_all": Case("SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT n_nationkey FROM nation) AND p_size != ALL (SELECT n_nationkey + 10 FROM nation)", "SELECT p_partkey FROM part WHERE p_size >= (SELECT max(n_nationkey) FROM nation) AND p_size NOT IN (SELECT n_nationkey + 10 FROM nation)"),
    "q_sub_having": Case("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) FROM region) + 5", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5 + (SELECT count(*) FROM region)"),
    "q_sub_between": Case("SELECT p_partkey FROM part WHERE p_size BETWEEN (SELECT MAX(n_regionkey) FROM nation) AND (SELECT MAX(n_nationkey) FROM nation)", "SELECT p_partkey FROM part WHERE p_size BETWEEN (SELECT max(n_regionkey) FROM nation) AND (SELECT max(n_nationkey) FROM nation)"),
    "q_sub_all_empty": Case("SELECT r_name FROM region WHERE r_regionkey < ALL (SELECT n_nationkey FROM nation WHERE n_name = 'none') AND NOT (r_regionkey < ANY (SELECT n_nationkey FROM nation WHERE n_name = 'none'))", "SELECT r_name FROM region"),
    # Shape of results.
    "q_shape_distinct": Case("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer"),
    "q_shape_unique": Case("SELECT UNIQUE l_shipdate FROM lineitem", "SELECT DISTINCT l_shipdate FROM lineitem"),
    "q_shape_distinct_hidden_order": Case("SELECT DISTINCT c_nationkey FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 5", "SELECT c_nationkey FROM customer GROUP BY c_nationkey ORDER BY max((c_acctbal, c_custkey)) DESC LIMIT 5"),
    "q_shape_limit_offset": Case("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 20"),
    "q_shape_top_k": Case("SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25", "SELECT l_orderkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25"),
    "q_shape_order_expr": Case("SELECT n_name FROM nation ORDER BY n_regionkey * 2 - n_nationkey DESC, n_name LIMIT 7", "SELECT n_name FROM nation ORDER BY n_regionkey * 2 - n_nationkey DESC, n_name LIMIT 7"),
    # Views.
    "q_view": Case("SELECT * FROM big WHERE o_orderstatus != 'F'", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F'", ["CREATE VIEW big AS SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000"]),
    "q_view_nested": Case("SELECT k, COUNT(*) AS n FROM w GROUP BY k", "SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_mktsegment <> 'BUILDING' GROUP BY ALL", ["CREATE VIEW v AS SELECT c_mktsegment, c_nationkey AS k FROM customer WHERE c_acctbal > 0", "CREATE VIEW w AS SELECT k FROM v", "ALTER VIEW w AS SELECT k FROM v WHERE c_mktsegment != 'BUILDING'"]),
    # Changes, over a copy of nation as text.
    "q_dml_insert": Case("SELECT * FROM nation_copy", f"{NATION_TEXT} UNION ALL VALUES ('90', 'NEW', '1'), ('91', 'ONLY', '')", ["INSERT INTO nation_copy VALUES (90, 'NEW', 1)", "INSERT INTO nation_copy (n_name, n_nationkey) VALUES (ONLY, 90 + 1)"], copied="nation"),
    "q_dml_update": Case("SELECT * FROM nation_copy", "SELECT CAST(CASE WHEN n_regionkey = 1 THEN n_nationkey + 100 ELSE n_nationkey END AS VARCHAR) AS n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name || '!' || (n_nationkey + 100) ELSE n_name END AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation", ["UPDATE nation_copy SET n_nationkey = n_nationkey + 100, n_name = n_name + '!' + n_nationkey WHERE n_regionkey = 1"], copied="nation"),
    "q_dml_delete": Case("SELECT * FROM nation_copy", f"SELECT * FROM ({NATION_TEXT}) WHERE n_nationkey NOT IN ('3', '4') AND n_regionkey <> '2'", ["DELETE FROM nation_copy WHERE n_nationkey IN (3, 4) OR n_regionkey = (SELECT MAX(r_regionkey) FROM region WHERE r_regionkey < 3)"], copied="nation"),
    "q_dml_orders": Case("SELECT * FROM orders_copy", f"{ORDERS_TEXT} WHERE o_orderpriority <> '1-URGENT' UNION ALL VALUES ('0', '', 'N', '1.5', '', '')", ["UPDATE orders_copy SET o_orderstatus = o_orderstatus + '/' + o_orderpriority WHERE o_orderstatus IN (F, P)", "DELETE FROM orders_copy WHERE o_orderpriority = '1-URGENT'", "INSERT INTO orders_copy (o_orderkey, o_orderstatus, o_totalprice) VALUES (0, N, 3 / 2)"], copied="orders"),
    "q_dml_subquery": Case("SELECT * FROM t", "SELECT '25' AS n, '4' AS m", ["CREATE TABLE t (n = (SELECT COUNT(*) FROM nation), m)", "INSERT INTO t (m) VALUES ((SELECT MAX(r_regionkey) FROM region))"]),
    "q_ddl_defaults": Case("SELECT id, a, b FROM t", "SELECT * FROM (VALUES ('1', 'x', '3'), ('2', 'y', '3'), ('9', 'z', ''), ('10', 'd', '3')) t(id, a, b)", ["CREATE TABLE t (id AUTO_INCREMENT, a = 'd', b = 1 + 2)", "INSERT INTO t (a) VALUES ('x')", "INSERT INTO t (a) VALUES ('y')", "INSERT INTO t VALUES (9, 'z', '')", "INSERT INTO t VALUES ()"]),
    "q_ddl_alter": Case("SELECT * FROM nation_copy", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name AS title, CAST(n_nationkey * 2 AS VARCHAR) AS twice, CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) AS id FROM nation", ["ALTER TABLE nation_copy DROP COLUMN n_regionkey", "ALTER TABLE nation_copy RENAME COLUMN n_name TO title", "ALTER TABLE nation_copy ADD COLUMN twice = n_nationkey * 2", "ALTER TABLE nation_copy ADD COLUMN id AUTO_INCREMENT"], copied="nation"),
    "q_ddl_set_default": Case("SELECT n_name, n_regionkey FROM nation_copy WHERE n_nationkey >= 90", "SELECT * FROM (VALUES ('none', '7')) t(n_name, n_regionkey)", ["ALTER TABLE nation_copy ALTER COLUMN n_name SET DEFAULT 'no' + 'ne'", "INSERT INTO nation_copy (n_nationkey, n_regionkey) VALUES (90, 3 + 4)"], copied="nation"),
    "q_ddl_drop_default": Case("SELECT a, b FROM t", "SELECT * FROM (VALUES ('1', 'd'), ('2', '')) t(a, b)", ["CREATE TABLE t (a, b = 'd')", "INSERT INTO t (a) VALUES (1)", "ALTER TABLE t ALTER COLUMN b DROP DEFAULT", "INSERT INTO t (a) VALUES (2)"]),
    "q_ddl_set_auto": Case("SELECT * FROM nation_copy", f"{NATION_TEXT} UNION ALL VALUES ('99', 'NEXT', '5')", ["INSERT INTO nation_copy VALUES (98, 'LAST', 4)", "ALTER TABLE nation_copy ALTER COLUMN n_nationkey SET AUTO_INCREMENT", "INSERT INTO nation_copy (n_name, n_regionkey) VALUES (NEXT, 5)", "DELETE FROM nation_copy WHERE n_nationkey = 98"], copied="nation"),
    "q_ddl_drop_auto": Case("SELECT id, a FROM t", "SELECT * FROM (VALUES ('1', 'x'), ('', 'y')) t(id, a)", ["CREATE TABLE t (id AUTO_INCREMENT, a)", "INSERT INTO t (a) VALUES (x)", "ALTER TABLE t ALTER COLUMN id DROP AUTO_INCREMENT", "INSERT INTO t (a) VALUES (y)"]),
    "q_ddl_drop_table": Case("SELECT * FROM t", "SELECT '5' AS z", ["CREATE TABLE t (a, b)", "INSERT INTO t VALUES (1, 2)", "DROP TABLE t", "CREATE TABLE t (z)", "INSERT INTO t VALUES (5)"]),
    "q_ddl_drop_view": Case("SELECT r_name FROM v", "SELECT r_name FROM region WHERE r_regionkey <> 2", ["CREATE VIEW v AS SELECT r_regionkey FROM region", "DROP VIEW v", "CREATE VIEW v AS SELECT r_name FROM region WHERE r_regionkey != 2"]),
    "q_ddl_renumber": Case("SELECT * FROM orders_copy", f"SELECT *, CAST(row_number() OVER (ORDER BY CAST(o_orderkey AS BIGINT)) AS VARCHAR) AS id FROM ({ORDERS_TEXT.replace(ORDERS_STATUS, 'o_orderstatus')})", ["ALTER TABLE orders_copy ADD COLUMN id AUTO_INCREMENT"], copied="orders"),
    "q_text_dynamic": Case("SELECT n_name, n_nationkey / 4 AS q, n_nationkey > '9' AS big FROM nation_copy WHERE n_nationkey > 5 ORDER BY n_nationkey DESC LIMIT 12", "SELECT n_name, CASE WHEN n_nationkey % 4 = 0 THEN CAST(n_nationkey // 4 AS VARCHAR) ELSE rtrim(printf('%.2f', n_nationkey / 4.0), '0') END AS q, CAST((n_nationkey > 9)::INT AS VARCHAR) AS big FROM nation WHERE n_nationkey > 5 ORDER BY n_nationkey DESC LIMIT 12", copied="nation"),
    "q_text_group": Case("SELECT n_regionkey, COUNT(*) AS n, MIN(n_nationkey) AS lo, MAX(n_name) AS hi, SUM(n_nationkey) AS s FROM nation_copy GROUP BY n_regionkey HAVING COUNT(*) > 2 LIMIT 4", "SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(count(*) AS VARCHAR) AS n, CAST(min(n_nationkey) AS VARCHAR) AS lo, max(n_name) AS hi, CAST(sum(n_nationkey) AS VARCHAR) AS s FROM nation GROUP BY nation.n_regionkey HAVING count(*) > 2 ORDER BY min(n_nationkey) LIMIT 4", copied="nation"),
    "q_text_join": Case("SELECT a.n_name AS x, r_name AS y FROM nation_copy a, region WHERE a.n_regionkey = r_regionkey AND a.n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)", "SELECT n_name AS x, r_name AS y FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey < 3", copied="nation"),
    "q_now": Case("SELECT r_name, NOW() AS t FROM region", None),
    "q_now_compared": Case("SELECT r_name, NOW() > '2000-01-01 00:00:00' AS later, NOW() REGEXP '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$' AS shape FROM region", "SELECT r_name, 1 AS later, 1 AS shape FROM region"),
}


def _folder(spark: SparkSession) -> str:
    """A new folder for tables of files, in the shared folder where that is a mounted one."""
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "").removeprefix("file://").removeprefix("file:")
    folder = tempfile.mkdtemp(prefix="tessera-", dir=root if os.path.isdir(root) else None)
    atexit.register(shutil.rmtree, folder, True)
    return folder


def _done(session: Session, *texts: str) -> Session:
    for text in texts:
        result = session.sql(text)
        if not result.success:
            raise RuntimeError(f"{text}: {result.error}")
    return session


def _as_files(spark: SparkSession, sf_dir: str, name: str, extension: str) -> Session:
    """A session over a folder with a table written as a file of the format."""
    with_tables = session_over(spark, sf_dir)
    copy_as_text(with_tables, name)
    store = FileStore(spark, _folder(spark), default=extension)
    held = with_tables.store.read(Relation(f"{name}_copy"))
    store.save(Relation(name), held.columns, held.df)
    return Session(spark, store)


def _format_query(extension: str) -> Query:
    """Write a table as a file of the format, change it, and read it back by name and by path."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _as_files(spark, sf_dir, "region", extension)
        _done(session, "INSERT INTO region VALUES (77, 'a \"quoted\", <b> & it''s')", "INSERT INTO region VALUES (78, NULL)", "UPDATE region SET r_name = r_name + '!' WHERE r_regionkey = 2", f"INSERT INTO 'region.{extension}' VALUES (79, '')")
        return session.table("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey")

    return run


def _format_orders(extension: str) -> Query:
    """A larger table through a file of the format: written, changed and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = _as_files(spark, sf_dir, "orders", extension)
        _done(session, "UPDATE orders SET o_orderstatus = o_orderstatus + '/' + o_orderpriority WHERE o_orderstatus IN (F, P)", "DELETE FROM orders WHERE o_orderpriority = '1-URGENT'")
        return session.table("SELECT * FROM orders")

    return run


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path in quotes, a bare name with an extension, and a Parquet file by its path, in one statement."""
    session = _as_files(spark, sf_dir, "region", "json")
    return session.table(f"SELECT a.r_name AS x, region.r_name AS y, n_name FROM '{session.store.root}/region.json' a, region.json, '{sf_dir}/nation.parquet' n WHERE a.r_regionkey = region.r_regionkey AND n.n_regionkey = a.r_regionkey")


def _sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers go on from the counter beside the file, though the row of the greatest is gone."""
    session = _done(Session(spark, FileStore(spark, _folder(spark))), "CREATE TABLE t (id AUTO_INCREMENT, a)", "INSERT INTO t (a) VALUES (x)", "INSERT INTO t VALUES (7, y)", "INSERT INTO t (a) VALUES (z)")
    again = Session(spark, FileStore(spark, session.store.root))  # nothing but the files is left
    return _done(again, "INSERT INTO t (a) VALUES (w)").table("SELECT id, a FROM t")


def _file_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views kept beside files, changed, dropped and read by another session; a dropped table frees its name."""
    session = _done(_as_files(spark, sf_dir, "nation", "csv"), "CREATE VIEW v AS SELECT n_name AS n, n_regionkey AS r FROM nation", "ALTER VIEW v AS SELECT n_name AS n, n_regionkey AS r FROM nation WHERE n_regionkey > 1", "CREATE VIEW gone AS SELECT n FROM v", "DROP VIEW gone")
    _done(session, "CREATE TABLE gone (a)", "DROP TABLE gone", "CREATE TABLE gone (k)", "INSERT INTO gone VALUES (2)")
    return Session(spark, FileStore(spark, session.store.root)).table("SELECT n FROM v, gone WHERE r = k")


def _lines(spark: SparkSession, lines: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, line string")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements say they did."""
    session = session_over(spark, sf_dir)
    copy_as_text(session, "nation")
    return _lines(spark, [session.sql(text).message for text in _SAID])


_SAID = {
    "CREATE TABLE t (id AUTO_INCREMENT, a = 1)": "Created table 't'",
    "INSERT INTO t (a) VALUES (2)": "Inserted 1 row into 't'",
    "UPDATE nation_copy SET n_name = x WHERE n_regionkey = 1": "Updated 5 row(s) in 'nation_copy'",
    "DELETE FROM nation_copy WHERE n_regionkey = 1": "Deleted 5 row(s) from 'nation_copy'",
    "DELETE FROM nation_copy WHERE n_regionkey = 1 ": "Deleted 0 row(s) from 'nation_copy'",
    "CREATE VIEW v AS SELECT a FROM t": "Created view 'v'",
    "ALTER VIEW v AS SELECT id FROM t": "Altered view 'v'",
    "DROP VIEW v": "Dropped view 'v'",
    "ALTER TABLE t DROP COLUMN a": "Altered table 't'",
    "DROP TABLE t": "Dropped table 't'",
    "SELECT n_name FROM nation_copy WHERE n_regionkey = 2": "5 row(s) selected",
}

#: Statements that must be refused: names that do not resolve, columns outside groups, aliases and places in ORDER BY, broken texts.
_REFUSED = (
    "SELECT nothing FROM nation",
    "SELECT N_NAME FROM nation",
    "SELECT n_name FROM nation ORDER BY nothing",
    "SELECT n_name AS x FROM nation ORDER BY x",
    "SELECT n_regionkey, COUNT(*) FROM nation",
    "SELECT n_name FROM nation GROUP BY n_regionkey",
    "SELECT COUNT(*) FROM nation GROUP BY n_regionkey + 1",
    "SELECT n_name FROM nation HAVING COUNT(*) > 1",
    "SELECT n_name FROM nation WHERE COUNT(*) > 1",
    "SELECT n_name FROM nation, customer WHERE c_nationkey = nation.nothing",
    "SELECT n_name FROM nowhere",
    "SELECT n_name FROM",
    "SELECT n_name FROM nation LIMIT -1",
    "DROP VIEW nation_copy",
    "DROP TABLE nothing",
)


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = session_over(spark, sf_dir)
    copy_as_text(session, "nation")

    def holds(text: str) -> str:
        try:
            return "done" if session.sql(text).success else "refused"
        except SqlError:
            return "refused"

    return _lines(spark, [holds(text) for text in _REFUSED])


def _pulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows pulled from a result one by one until the consumer has enough, then again from the start; NULL is shown."""
    session = session_over(spark, sf_dir)
    copy_as_text(session, "nation")
    _done(session, "UPDATE nation_copy SET n_regionkey = NULL WHERE n_nationkey = 3")
    rows, out = session.sql("SELECT n_nationkey, n_regionkey FROM nation_copy LIMIT 8 OFFSET 1").rows, []
    n = drive(iter(rows), lambda row: out.append(f"{row[0]}:{row[1]}") or len(out) < 5)
    return _lines(spark, [*out, f"{n} pulled", f"{sum(1 for _ in rows)} in all"])


def _console(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = io.StringIO()
    session = _done(Session(spark), "CREATE TABLE t (name, n)", "INSERT INTO t VALUES (abc, 3)", "INSERT INTO t VALUES (x, NULL)")
    for text in ("SELECT name, n / 2 AS half FROM t", "DELETE FROM t WHERE n = 3"):
        write_result(out, session.sql(text))
    return _lines(spark, out.getvalue().splitlines())


_CONSOLE = ["+------+------+", "| name | half |", "+------+------+", "| abc  | 1.5  |", "| x    | NULL |", "+------+------+", "2 row(s) selected", "Deleted 1 row(s) from 't'"]


def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements as arguments and with their keyword in front, and the help texts."""
    out, folder = io.StringIO(), _folder(spark)
    with contextlib.redirect_stdout(out):
        for words, keyword in ((["TABLE", "t", "(a)"], "CREATE"), (["INTO", "t", "VALUES", "(5)"], "INSERT"), (["SELECT", "a", "FROM", "t"], ""), (["--help", "insert"], ""), (["help"], "DELETE")):
            cli.main(words, keyword, spark, folder)
    return _lines(spark, out.getvalue().splitlines())


_COMMAND_LINE = ["Created table 't'", "Inserted 1 row into 't'", "+---+", "| a |", "+---+", "| 5 |", "+---+", "1 row(s) selected", "INSERT INTO table [(column, ...)] VALUES (expr, ...)", "DELETE FROM table [WHERE expr]"]


def _lines_sql(lines: Sequence[str]) -> str:
    quoted = [x.replace("'", "''") for x in lines]
    return "SELECT CAST(k AS INT) AS k, line FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(quoted)) + ") t(k, line)"


_FORMAT_SQL = """SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, CASE WHEN r_regionkey = 2 THEN r_name || '!' ELSE r_name END AS r_name FROM region
UNION ALL VALUES ('77', 'a "quoted", <b> & it''s'), ('78', NULL), ('79', '')"""
_FORMATS = ("csv", "json", "toml", "yaml", "xml")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, 1000).select(F.col("c0").alias("id"), F.col("c1").alias("name"), F.col("c2").alias("city"), F.col("c3").alias("country"))


#: The heavier queries, for the benchmark.
FLAGSHIP = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS q, SUM(l_extendedprice) AS b, SUM(l_extendedprice * (1 - l_discount)) AS d, SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS c, AVG(l_quantity) AS aq, AVG(l_discount) AS ad, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    "order_revenue": "SELECT o_orderkey, o_orderdate, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < '1997-03-15' GROUP BY o_orderkey, o_orderdate ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC, o_orderkey LIMIT 10",
    "nation_volume": "SELECT n_name, SUM(l_extendedprice * (1 - l_discount)) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name ORDER BY SUM(l_extendedprice * (1 - l_discount)) DESC",
    "forecast": "SELECT SUM(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= '1994-01-01' AND l_shipdate < '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
}
_FLAGSHIP_SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS b, round(sum(l_extendedprice * (1 - l_discount)), 2) AS d, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS c, round(avg(l_quantity), 2) AS aq, round(avg(l_discount), 2) AS ad, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "order_revenue": "SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "nation_volume": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "forecast": "SELECT round(coalesce(sum(l_extendedprice * l_discount), 0), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
}
_ROUNDED = {"pricing_summary": ("q", "b", "d", "c", "aq", "ad"), "order_revenue": ("revenue",), "nation_volume": ("revenue",), "forecast": ("revenue",)}
CASES |= {f"q_{name}": Case(text, _FLAGSHIP_SQL[name], rounded=_ROUNDED[name]) for name, text in FLAGSHIP.items()}

QUERIES: dict[str, Query] = {name: case.run for name, case in CASES.items()}
QUERIES |= {f"q_format_{x}": _format_query(x) for x in _FORMATS}
QUERIES |= {f"q_format_orders_{x}": _format_orders(x) for x in _FORMATS}
QUERIES |= {"q_table_generator": _generated, "q_path_source": _paths, "q_auto_sidecar": _sidecar, "q_file_views": _file_views, "q_messages": _messages, "q_refused": _refused, "q_rows_pulled": _pulled, "q_console": _console, "q_command_line": _command_line}

ORACLES: dict[str, str] = {name: case.sql for name, case in CASES.items() if case.sql} | {f"q_format_{x}": _FORMAT_SQL for x in _FORMATS}
ORACLES |= {f"q_format_orders_{x}": f"{ORDERS_TEXT} WHERE o_orderpriority <> '1-URGENT'" for x in _FORMATS}
_DRAWN = "('0x' || substr(md5('42:{}:' || id), 1, 8))::BIGINT"
ORACLES |= {
    "q_table_generator": f"SELECT id::VARCHAR AS id, {NAMES}[{_DRAWN.format(1)} % {len(NAMES)} + 1] AS name, {[p[0] for p in PLACES]}[{_DRAWN.format(2)} % {len(PLACES)} + 1] AS city, {[p[1] for p in PLACES]}[{_DRAWN.format(2)} % {len(PLACES)} + 1] AS country FROM range(1, 1001) t(id)",
    "q_path_source": "SELECT r_name AS x, r_name AS y, n_name FROM region JOIN nation ON n_regionkey = r_regionkey",
    "q_auto_sidecar": "SELECT * FROM (VALUES ('1', 'x'), ('7', 'y'), ('8', 'z'), ('9', 'w')) t(id, a)",
    "q_file_views": "SELECT n_name AS n FROM nation WHERE n_regionkey = 2",
    "q_messages": _lines_sql(list(_SAID.values())),
    "q_refused": _lines_sql(["refused"] * len(_REFUSED)),
    "q_rows_pulled": _lines_sql(["1:1", "2:2", "3:NULL", "4:4", "5:0", "5 pulled", "8 in all"]),
    "q_console": _lines_sql(_CONSOLE),
    "q_command_line": _lines_sql(_COMMAND_LINE),
}
