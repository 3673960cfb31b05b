"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Every text is read whole; a null text counts as empty, so it has no spans.
Kinds of the base contract are kept whatever their score.  The method adds
``iban`` (confirmed by the mod-97 checksum), ``ssn`` (only with digits that
are ever issued) and ``local_phone`` (only where nearby words speak of a call).
Rows, repeated ids and further columns pass through; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table
from tessera.llm.spans import Kind, digest, redacted, with_spans

_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: Words near a span that speak for its kind.
CONTEXT = {
    "email": "mail|contact|write|address|correo|adresse",
    "ip": "ip|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|tarjeta|karte|carte",
    "phone": "phone|call|tel|mobile|fax|anruf|appel",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social|security|tax",
    "local_phone": "phone|call|tel|mobile|fax|anruf|appel",
}
#: Percent without and with such a word.
SCORES = {"email": (80, 95), "ip": (60, 85), "card": (75, 95), "phone": (65, 90), "iban": (80, 95), "ssn": (55, 85), "local_phone": (30, 70)}


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""

    def add(acc, i):
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number leaves 1 modulo 97 after its first four characters move to the end."""
    bare = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def add(acc, i):
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _scored(name: str):
    alone, near = SCORES[name]
    return lambda hit, before, after: F.when(before.rlike(CONTEXT[name]) | after.rlike(CONTEXT[name]), near).otherwise(alone)


def _some_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


#: The patterns hold no trailing context, so possessive repeats and the guard
#: (a match starts at the start of its run, or where the last match ended)
#: change no match; they keep long runs linear and off the stack.
KINDS = [
    Kind("email", "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:[.][A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda h: F.lit(True), _scored("email")),
    Kind("ip", "(?<![0-9])[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++", _some_digit, lambda h: h.rlike(f"^{_PART}[.]{_PART}[.]{_PART}[.]{_PART}$"), _scored("ip")),
    Kind("card", "[0-9](?:[ -]?[0-9])++", _some_digit, lambda h: F.length(digits(h)).between(12, 19) & luhn(digits(h)), _scored("card")),
    Kind("phone", "[+][0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), lambda h: F.length(digits(h)).between(9, 15), _scored("phone")),
    Kind("iban", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), mod97, _scored("iban"), base=False, edge="[A-Za-z0-9]"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda t: t.rlike("[0-9]-[0-9]"), lambda h: ~h.rlike("^(000|666|9)|-00-|-0000$"), _scored("ssn"), base=False, edge="[A-Za-z0-9-]"),
    Kind("local_phone", "[(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}", _some_digit, lambda h: F.lit(True), _scored("local_phone"), base=False, edge="[A-Za-z0-9.-]"),
]


def find_pii(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with the sorted spans of personal data in each text."""
    return with_spans(docs, text, KINDS, into)


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in angle brackets."""
    into = fresh(docs, "__found")
    found = find_pii(docs, text, into)
    return found.withColumn(text, redacted(F.col(text), F.col(into), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")))).drop(into)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")), KINDS)


def _oracle() -> str:
    at = "coalesce(list_sum(list_transform(gaps[:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[:i - 1], lambda g: length(g))), 0)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    dig = "regexp_replace(h, '[^0-9]', '', 'g')"
    bare = "replace(h, ' ', '')"
    luhn_sql = f"list_sum(list_transform(range(1, length({dig}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {dig}[length({dig}) - i + 1]::INT WHEN {dig}[length({dig}) - i + 1]::INT > 4 THEN {dig}[length({dig}) - i + 1]::INT * 2 - 9 ELSE {dig}[length({dig}) - i + 1]::INT * 2 END)) % 10 = 0"
    value = "(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)"
    mod_sql = f"list_reduce(list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''), lambda c: {value}::BIGINT), lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97, 0::BIGINT) = 1"
    rules = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "true"),
        "ip": ("[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", f"regexp_full_match(h, '{_PART}[.]{_PART}[.]{_PART}[.]{_PART}')"),
        "card": ("[0-9]([ -]?[0-9])+", f"length({dig}) BETWEEN 12 AND 19 AND {luhn_sql}"),
        "phone": ("[+][0-9][ ().0-9-]+[0-9]", f"length({dig}) BETWEEN 9 AND 15"),
        "iban": (KINDS[4].pattern, mod_sql),
        "ssn": (KINDS[5].pattern, "NOT regexp_matches(h, '^(000|666|9)|-00-|-0000$')"),
        "local_phone": (KINDS[6].pattern, "true"),
    }
    parts = []
    for rank, kind in enumerate(KINDS):
        pattern, valid = rules[kind.name]
        edge = f"AND NOT regexp_matches(CASE WHEN a > 0 THEN substr(t, a, 1) ELSE '' END, '{kind.edge}') AND NOT regexp_matches(substr(t, b + 1, 1), '{kind.edge}')" if kind.edge else ""
        alone, near = SCORES[kind.name]
        around = "translate(substr(t, greatest(0, a - 40) + 1, a - greatest(0, a - 40)), '{u}', '{l}')", "translate(substr(t, b + 1, 40), '{u}', '{l}')"
        near_sql = " OR ".join(f"regexp_matches({x.format(u=upper, l=lower)}, '{CONTEXT[kind.name]}')" for x in around)
        parts.append(f"""SELECT k, t, {rank} AS rank, '{kind.name}' AS kind, {kind.base} AS base, a, b, CASE WHEN {near_sql} THEN {near} ELSE {alone} END AS score FROM (
  SELECT k, t, h, a, a + length(h) AS b FROM (
    SELECT k, t, hits[i] AS h, ({at})::INT AS a FROM (SELECT k, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT k, t, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM d)))
) WHERE ({valid}) {edge}""")  # fmt: skip
    free = "SELECT * FROM {src} x WHERE score >= 50 AND rank = {rank} AND NOT EXISTS (SELECT 1 FROM {taken} y WHERE y.k = x.k AND y.a < x.b AND x.a < y.b)"
    ctes, taken = ["s AS (" + " UNION ALL ".join(parts) + ")", "s3 AS (SELECT * FROM s WHERE base)"], "s3"
    for rank in (4, 5, 6):
        ctes.append(f"s{rank} AS (SELECT * FROM {taken} UNION ALL " + free.format(src="s", rank=rank, taken=taken) + ")")
        taken = f"s{rank}"
    shown = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank)"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), {', '.join(ctes)}
SELECT d.doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{x.name}') AS n_{x.name}" for x in KINDS if x.base)},
  sha256(coalesce({shown} FILTER (WHERE base), '')) AS base_sha256, coalesce({shown}, '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY a, rank), '') AS scores
FROM d LEFT JOIN {taken} USING (k) GROUP BY d.k, d.doc_id"""  # fmt: skip


ORACLE_SQL = _oracle()
