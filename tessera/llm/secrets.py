"""Secrets: fixed formats, and strings that look random to two Markov models.

Two first-order character models are trained from labelled samples, one of
random strings and one of ordinary identifiers.  The log-likelihood ratio of a
candidate is a sum of table entries over its neighbouring characters; entries
are whole thousandths of a nat, so every engine sums them exactly.

The samples are bounded (``SAMPLES`` of each label) and the models are a
constant of the plan; scanning is DataFrame functions only and moves no row.
Every text is read whole; a null text counts as empty and has no spans.
Repeated ids and further columns pass through; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table
from tessera.llm.spans import Kind, digest, redacted, with_spans

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Labelled samples drawn for each label.
SAMPLES = 4000
#: Least ratio of a candidate, in thousandths of a nat: in all, and for each character.
LEAST_TOTAL, LEAST_EACH = 9000, 350
#: Least ratio for each character of a candidate without a digit.
LETTERS_EACH = 600

_STEMS = (
    "get set user name value index count total list map table row column page file path config option default test case build "
    "version release source target input output data model layer batch size epoch train eval score label token text word line "
    "block chunk cache queue worker task job stage plan query filter join group order limit offset field record schema type "
    "string number integer float boolean date time month year hour minute second start end first last next prev left right top "
    "bottom width height color image button panel window menu dialog client server request response header body status error "
    "message event handler listener service manager factory builder provider context session account address email phone "
    "country region city street product price discount tax invoice payment customer supplier shipment license apache example"
).split()


def ordinary_samples(n: int = SAMPLES) -> list[str]:
    """Identifiers as programs name things: stems in snake, camel, kebab and path style, some numbered."""
    out = []
    for i in range(n):
        h = hashlib.sha256(f"ordinary {i}".encode()).digest()
        parts = [_STEMS[(h[2 * k] * 256 + h[2 * k + 1]) % len(_STEMS)] for k in range(2 + h[20] % 4)]
        style = h[21] % 6
        name = ["_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(p.title() for p in parts[1:]), "".join(parts), "_".join(parts).upper()][style]
        out.append(name + ["", "", str(h[22] % 10), f"_{h[22] % 100}", f"-{2000 + h[22] % 30}-{1 + h[23] % 12:02d}"][h[24] % 5])
    return out


def random_samples(n: int = SAMPLES) -> list[str]:
    """Keys as generators print them: hexadecimal, Base64 and alphanumeric of 16 to 48 characters."""
    out = []
    for i in range(n):
        h = hashlib.sha512(f"random {i}".encode()).digest()
        length = 16 + h[63] % 33
        alnum = "".join(ALPHABET[b % 62] for b in h)
        out.append([h.hex(), base64.b64encode(h).decode(), base64.urlsafe_b64encode(h).decode(), alnum][i % 4][:length].rstrip("="))
    return out


def train(random: Iterable[str], ordinary: Iterable[str], smoothing: float = 0.5) -> list[int]:
    """The table of log ratios: entry ``a * n + b`` is for character ``b`` after ``a``."""
    n, tables = len(ALPHABET), []
    for sample in (random, ordinary):
        seen = [[smoothing] * n for _ in range(n)]
        for s in sample:
            known = [ALPHABET.index(c) for c in s if c in ALPHABET]
            for a, b in zip(known, known[1:]):
                seen[a][b] += 1
        tables.append([[math.log(x / sum(row)) for x in row] for row in seen])
    return [round(1000 * (tables[0][a][b] - tables[1][a][b])) for a in range(n) for b in range(n)]


@lru_cache
def model() -> tuple[int, ...]:
    return tuple(train(random_samples(), ordinary_samples()))


def ratio(hit: Column, weights: tuple[int, ...]) -> Column:
    """The log-likelihood ratio of a text in the alphabet, in thousandths of a nat."""
    entries = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(hit, i, F.lit(1))) - 1
    step = lambda acc, i: acc + F.get(entries, at(i) * len(ALPHABET) + at(i + 1))
    return F.when(F.length(hit) < 2, 0).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(hit) - 1), F.lit(0), step))


_WORD = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _WORD + "[\"']? *[:=] *[\"']?"
_CANDIDATE = "[A-Za-z0-9+/_-]{16,}"


def kinds(weights: tuple[int, ...]) -> list[Kind]:
    """Base kinds, and ``random`` for strings the models call random.

    Such a string has a letter; one without a digit needs a higher ratio.

    Guards make long runs linear and change no match: a run of the class is
    matched from its first character or not at all.
    """

    def percent(hit, before, after):
        return F.least(F.lit(99), F.greatest(F.lit(0), F.floor(ratio(hit, weights) / F.lit(1000)) + 50))

    def random(hit):
        able = hit.rlike("[A-Za-z]")
        each = F.when(hit.rlike("[0-9]"), LEAST_EACH).otherwise(LETTERS_EACH)
        return able & F.when(able, (ratio(hit, weights) >= LEAST_TOTAL) & (ratio(hit, weights) >= F.length(hit) * each)).otherwise(False)

    sure = lambda n: lambda hit, before, after: F.lit(n)
    return [
        Kind("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+", lambda t: t.contains("=") | t.contains(":"), lambda h: F.length(F.regexp_replace(h, "^" + _ASSIGN, "")) >= 6, sure(90)),
        Kind("access", "AKIA[A-Z0-9]{16,}", lambda t: t.contains("AKIA"), lambda h: F.lit(True), sure(99)),
        Kind("hex", "(?<![0-9a-f])[0-9a-f]{24,}+", lambda t: t.rlike("[0-9]|[0-9a-f]{24}"), lambda h: F.lit(True), sure(80)),
        Kind("random", "(?<![A-Za-z0-9+/_-])" + _CANDIDATE + "+", lambda t: t.rlike(_CANDIDATE), random, percent, base=False),
    ]


def find_secrets(docs: DataFrame, text: str = "text", into: str = "spans", weights: tuple[int, ...] | None = None) -> DataFrame:
    """``docs`` with the sorted spans of secrets in each text."""
    return with_spans(docs, text, kinds(weights or model()), into, width=0)


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``<secret>``; a null text stays null."""
    into = fresh(docs, "__found")
    found = find_secrets(docs, text, into)
    return found.withColumn(text, redacted(F.col(text), F.col(into), lambda s: F.lit("<secret>"))).drop(into)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")), kinds(model()))


def _oracle() -> str:
    n, weights = len(ALPHABET), ",".join(map(str, model()))
    at = "coalesce(list_sum(list_transform(gaps[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0)"
    assign = _ASSIGN.replace("'", "''")
    llr = f"list_sum(list_transform(range(1, length(h)), lambda i: w[(strpos('{ALPHABET}', substr(h, i, 1)) - 1) * {n} + strpos('{ALPHABET}', substr(h, i + 1, 1))]))"
    rules = [
        ("assign", assign + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(h, '^{assign}', '')) >= 6", "90"),
        ("access", "AKIA[A-Z0-9]+", "length(h) >= 20", "99"),
        ("hex", "[0-9a-f]+", "length(h) >= 24", "80"),
        ("random", _CANDIDATE, f"regexp_matches(h, '[A-Za-z]') AND {llr} >= greatest({LEAST_TOTAL}, length(h) * CASE WHEN regexp_matches(h, '[0-9]') THEN {LEAST_EACH} ELSE {LETTERS_EACH} END)", f"least(99, greatest(0, floor({llr} / 1000.0)::INT + 50))"),
    ]
    parts = []
    for rank, (name, pattern, valid, score) in enumerate(rules):
        parts.append(f"""SELECT k, {rank} AS rank, '{name}' AS kind, {rank < 3} AS base, a, a + length(h) AS b, {score} AS score FROM (
    SELECT k, hits[i] AS h, ({at})::INT AS a FROM (SELECT k, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT k, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d)))
  {', m' if rank == 3 else ''} WHERE {valid}""")  # fmt: skip
    shown = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT string_split('{weights}', ',')::INT[] AS w),
s AS MATERIALIZED ({' UNION ALL '.join(parts)}),
f AS (SELECT * FROM s WHERE base UNION ALL SELECT * FROM s x WHERE NOT base AND score >= 50 AND NOT EXISTS (SELECT 1 FROM s y WHERE y.base AND y.k = x.k AND y.a < x.b AND x.a < y.b))
SELECT d.doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{x[0]}') AS n_{x[0]}" for x in rules[:3])},
  sha256(coalesce({shown} FILTER (WHERE base), '')) AS base_sha256, coalesce({shown}, '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY a, rank), '') AS scores
FROM d LEFT JOIN f USING (k) GROUP BY d.k, d.doc_id"""  # fmt: skip


ORACLE_SQL = _oracle()
