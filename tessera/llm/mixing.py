"""Mixing sources to target weights by hierarchical budgeting.

Weights form a tree of domain, language and source.  A token budget flows from
the root: each node splits what it gets among its children by weight, and a
child that cannot use its part returns it to its siblings first; only what a
whole subtree cannot use goes up to the siblings of an ancestor.  A leaf can
use its tokens ``max_epochs`` times.  It takes whole epochs, and from the next
epoch's order, seeded by that epoch, the prefix that fits the rest.

Every step is a DataFrame function.  Documents of a leaf are summed by the
first digits of their seeded key before anything is ordered; the slice that
the prefix ends in is summed by the next digits, and so on, so a leaf with a
third of all rows costs 256 sums at each of ``LEVELS`` levels, and only a
slice of one in 16 million is sorted.  All arithmetic is in whole numbers.

Nulls: a null language, source or text is the empty string, a null id the
empty key.  Rows with equal ids in a leaf have equal keys and are taken
together.  Tokens are words between white space; a leaf without tokens takes
nothing.  An empty table gives an empty mix.  Further columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table

LEAF = ["domain", "language", "origin"]
#: Leaves up to this number travel to every task; more are joined by shuffle.
BROADCAST_LEAVES = 20_000
#: Hexadecimal digits of the key at each level, and levels before the rest is ordered.
SLICE_DIGITS, LEVELS = 2, 3


@dataclass(frozen=True)
class Mix:
    """Weights of the tree and the size of the mix.

    ``domains`` has (name, weight, pattern of sources), the first that matches
    counts; what is not listed has weight 1.
    """

    domains: Sequence[tuple[str, int, str]] = (("web", 50, "^src[0-9]$"), ("books", 30, "^src1[0-4]$"), ("code", 20, "^src1[5-9]$"))
    languages: dict[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 2})
    sources: dict[str, int] = field(default_factory=dict)
    #: Tokens of the mix for each hundred tokens of the input.
    percent: int = 70
    max_epochs: int = 3
    seed: int = 17


PRODUCTION = Mix()


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for key, w in weights.items():
        out = F.when(name == key, F.lit(w).cast("long")).otherwise(out)
    return out


def _domain(source: Column, mix: Mix) -> Column:
    out = F.lit("other")
    for name, _, pattern in reversed(list(mix.domains)):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


def _leaf_columns(docs: DataFrame, mix: Mix, text: str) -> DataFrame:
    origin = F.coalesce("source", F.lit(""))
    tokens = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return docs.withColumns({"domain": _domain(origin, mix), "language": F.coalesce("lang", F.lit("")), "origin": origin, "n_tokens": tokens})


def _key(epoch: Column, seed: int) -> Column:
    """The document's place in an epoch: a hash of seed, epoch and id, then the id."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc).cast("binary")), F.lpad(doc, 20, "0"))


def share(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Add ``target`` to siblings with ``budget``, ``cap`` and ``weight``.

    Siblings are taken by rising capacity for their weight; as long as one's
    capacity is within its part of what is left, it is filled and leaves.
    """
    nodes = nodes.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    group = W.partitionBy(*parent)
    # Whole part, then the fraction: as doubles, fractions of weights under 2^26 differ wherever they are unequal.
    order = group.orderBy(F.expr("if(weight > 0, cap div weight, 0)"), F.expr("if(weight > 0, cap % weight / weight, 0)"), name)
    before, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    prior = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    out = nodes.withColumns({"__all": F.sum("weight").over(group), "__w": prior("weight"), "__c": prior("cap")})
    out = out.withColumn("__fits", F.col("cap") * (F.col("__all") - F.col("__w")) <= (F.col("budget") - F.col("__c")) * F.col("weight"))
    out = out.withColumn("__full", F.min("__fits").over(upto))
    filled = lambda c: F.coalesce(F.sum(F.when(F.col("__full"), F.col(c))).over(group), F.lit(0))
    out = out.withColumns({"__cs": filled("cap"), "__ws": filled("weight")})
    part = F.expr("(budget - __cs) * weight div nullif(__all - __ws, 0)")
    return out.withColumn("target", F.when(F.col("__full"), F.col("cap")).otherwise(part)).drop("__all", "__w", "__c", "__fits", "__full", "__cs", "__ws")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """The ``target`` of every leaf of ``leaves(domain, language, origin, tokens)``."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    domain_weights = {name: w for name, w, _ in mix.domains}
    top = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", _weight(F.col("domain"), domain_weights))
    top = top.withColumns({"budget": F.expr(f"sum(tokens) over () * {mix.percent} div 100"), "root": F.lit(0)})
    top = share(top, ["root"], "domain").select("domain", F.col("target").alias("budget"))
    mid = leaves.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("language"), mix.languages))
    mid = share(mid.join(top, "domain"), ["domain"], "language").select("domain", "language", F.col("target").alias("budget"))
    low = leaves.withColumn("weight", _weight(F.col("origin"), mix.sources)).join(mid, ["domain", "language"])
    return share(low, ["domain", "language"], "origin").select(*LEAF, "tokens", "target")


def plan(docs: DataFrame, mix: Mix, text: str = "text") -> DataFrame:
    """For each leaf its whole epochs and the last key of the partial one.

    Returns ``(domain, language, origin, tokens, target, whole, last)``; a null
    ``last`` takes nothing of the partial epoch.
    """
    light = materialize(_leaf_columns(docs, mix, text).select("doc_id", *LEAF, "n_tokens"))
    leaves = materialize(budgets(light.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), mix))
    leaves = leaves.withColumn("whole", F.expr("coalesce(target div nullif(tokens, 0), 0)"))
    leaves = leaves.withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens"))
    few = _is_small(leaves)
    # Of each leaf: the digits of the slice that its prefix ends in, and the tokens left there.
    state = leaves.where("rest > 0").select(*LEAF, "whole", F.lit("").alias("digits"), F.col("rest").alias("room"))
    ended = []
    for level in range(1, LEVELS + 1):
        keyed = _inside(light, state, few, mix).withColumn("slice", F.substring("key", 1, SLICE_DIGITS * level))
        slices = keyed.groupBy(*LEAF, "whole", "room", "slice").agg(F.sum("n_tokens").alias("n"), F.max("key").alias("top"))
        slices = materialize(slices.withColumn("upto", F.sum("n").over(W.partitionBy(*LEAF).orderBy("slice").rowsBetween(W.unboundedPreceding, 0))))
        ended.append(slices.where("upto <= room").select(*LEAF, F.col("top").alias("last")))
        cut = slices.where("upto > room AND upto - n <= room")
        state = cut.select(*LEAF, "whole", F.col("slice").alias("digits"), (F.col("room") - F.col("upto") + F.col("n")).alias("room"))
    inside = _inside(light, state, few, mix).withColumn("sum", F.sum("n_tokens").over(W.partitionBy(*LEAF).orderBy("key")))
    ended.append(inside.where("sum <= room").select(*LEAF, F.col("key").alias("last")))
    last = reduce(DataFrame.union, ended).groupBy(*LEAF).agg(F.max("last").alias("last"))
    return leaves.join(last, LEAF, "left").select(*LEAF, "tokens", "target", "whole", "last")


def _inside(light: DataFrame, state: DataFrame, few: bool, mix: Mix) -> DataFrame:
    """Documents, with their keys, of the slices in ``state``."""
    keyed = light.join(F.broadcast(state) if few else state, LEAF).withColumn("key", _key(F.col("whole"), mix.seed))
    return keyed.where(F.startswith("key", "digits"))


def _is_small(leaves: DataFrame) -> bool:
    return leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES


def mixed(docs: DataFrame, mix: Mix = PRODUCTION, text: str = "text") -> DataFrame:
    """The rows of the mix with ``domain``, ``n_tokens`` and ``epochs``, the times each is used.

    Columns of these names in ``docs`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("domain", "n_tokens", "epochs")]
    packed = docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.struct(*kept).alias("row"))
    leaves = materialize(plan(packed, mix, "text"))
    cut = leaves.select(*LEAF, "whole", "last")
    out = _leaf_columns(packed, mix, "text").join(F.broadcast(cut) if _is_small(cut) else cut, LEAF)
    used = F.col("whole") + F.coalesce((_key(F.col("whole"), mix.seed) <= F.col("last")).cast("long"), F.lit(0))
    return out.withColumn("epochs", used).where("epochs > 0").select("row.*", "domain", "n_tokens", "epochs")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production mix of all documents, one row for each document used."""
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")


def _oracle(mix: Mix) -> str:
    case = lambda col, pairs: f"CASE {' '.join(f'WHEN {col} = {k!r} THEN {w}' for k, w in pairs)} ELSE 1 END" if pairs else "1"
    domain = f"CASE {' '.join(f'WHEN regexp_matches(o, {p!r}) THEN {n!r}' for n, _, p in mix.domains)} ELSE 'other' END"

    def level(name: str, src: str, parent: str, key: str) -> str:
        return f"""{name}_a AS (SELECT *, (CASE WHEN weight > 0 THEN cap ELSE 0 END)::BIGINT AS c FROM {src}),
{name}_b AS (SELECT *, sum(weight) OVER (PARTITION BY {parent}) AS wall, coalesce(sum(weight) OVER o, 0) AS wb, coalesce(sum(c) OVER o, 0) AS cb FROM {name}_a
  WINDOW o AS (PARTITION BY {parent} ORDER BY CASE WHEN weight > 0 THEN c / weight ELSE 0 END, {key} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_c AS (SELECT *, c * (wall - wb) <= (budget - cb) * weight AS fits FROM {name}_b),
{name}_d AS (SELECT *, bool_and(fits) OVER (PARTITION BY {parent} ORDER BY CASE WHEN weight > 0 THEN c / weight ELSE 0 END, {key} ROWS UNBOUNDED PRECEDING) AS filled FROM {name}_c),
{name} AS (SELECT *, (CASE WHEN filled THEN c ELSE (budget - coalesce(sum(c) FILTER (WHERE filled) OVER (PARTITION BY {parent}), 0)) * weight
  // nullif(wall - coalesce(sum(weight) FILTER (WHERE filled) OVER (PARTITION BY {parent}), 0), 0) END)::BIGINT AS target FROM {name}_d)"""

    return f"""WITH d0 AS (SELECT doc_id, lang, source, coalesce(lang, '') AS l, coalesce(source, '') AS o, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
d AS (SELECT *, {domain} AS dom FROM d0),
leaf AS (SELECT dom, l, o, sum(n)::BIGINT AS tokens, (sum(n) * {mix.max_epochs})::BIGINT AS cap FROM d GROUP BY ALL),
t0 AS (SELECT 0 AS root, dom, sum(cap)::BIGINT AS cap, {case('dom', [(n, w) for n, w, _ in mix.domains])} AS weight, (SELECT sum(tokens) * {mix.percent} // 100 FROM leaf)::BIGINT AS budget FROM leaf GROUP BY dom),
{level('t', 't0', 'root', 'dom')},
m0 AS (SELECT leaf.dom, l, sum(leaf.cap)::BIGINT AS cap, {case('l', mix.languages.items())} AS weight, any_value(t.target) AS budget FROM leaf JOIN t USING (dom) GROUP BY leaf.dom, l),
{level('m', 'm0', 'dom', 'l')},
s0 AS (SELECT leaf.dom, leaf.l, o, tokens, leaf.cap, {case('o', mix.sources.items())} AS weight, m.target AS budget FROM leaf JOIN m USING (dom, l)),
{level('s', 's0', 'dom, l', 'o')},
p AS (SELECT d.*, coalesce(target // nullif(tokens, 0), 0) AS whole, target - coalesce(target // nullif(tokens, 0), 0) * tokens AS rest FROM d JOIN s USING (dom, l, o)),
k AS (SELECT *, sum(n) OVER (PARTITION BY dom, l, o ORDER BY md5('{mix.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) || lpad(coalesce(doc_id::VARCHAR, ''), 20, '0')) AS upto FROM p)
SELECT doc_id, lang, source, dom AS domain, n::BIGINT AS n_tokens, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS epochs FROM k WHERE whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0"""  # fmt: skip


ORACLE_SQL = _oracle(PRODUCTION)
