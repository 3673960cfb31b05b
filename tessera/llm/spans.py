"""Pattern matches with code-point positions, as DataFrame expressions.

Spark has no function that returns where a pattern matches.  Splitting a text
by the pattern gives the gaps, extracting gives the matches, and the running
sum of both lengths gives every position, all inside the JVM.  The second pass
runs only where the first found something.  Work grows with a text and its
matches, and with the root of their number beyond that.

Spans are structs ``(start, rank, kind, stop, hit, score)``: code points, end
exclusive, sorting by start and then by the kind's place in its list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

SPAN = "struct<start:int,rank:int,kind:string,stop:int,hit:string,score:int>"
SPANS = f"array<{SPAN}>"
_MATCH = "array<struct<start:int,stop:int,hit:string,place:int>>"


@dataclass(frozen=True)
class Kind:
    """One kind of span.

    ``gate`` is a cheap test that every text with a match passes; ``valid``
    confirms a match; ``score`` (percent) takes the match and the text around
    it, and spans of kinds that are not ``base`` need ``least`` and must not
    overlap a base span.
    """

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    score: Callable[[Column, Column, Column], Column]
    base: bool = True
    least: int = 50
    edge: str = ""


#: Arrays are built in parts of so many entries, each part anew, and the parts joined:
#: an array that grows by one entry at a time is copied at every step.
PART = 256


def _parts(n: Column) -> Column:
    """The numbers of the parts of an array of ``n`` entries, one at least."""
    return F.sequence(F.lit(0), F.floor((n - 1) / PART).cast("int"))


def _positions(gaps: Column, hits: Column) -> Column:
    """``(start, stop, hit, place)`` of every match."""
    part = lambda items, c: F.slice(items, c * PART + 1, F.lit(PART))

    def width(c):
        return F.aggregate(part(gaps, c), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(part(hits, c), F.lit(0), lambda n, x: n + F.length(x))

    def step(acc, i):
        start = acc["at"] + F.length(gaps[i])
        stop = start + F.length(hits[i])
        one = F.struct(start.alias("start"), stop.alias("stop"), hits[i].alias("hit"), i.alias("place"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def of_part(c, at):
        places = F.sequence(c * PART, F.least(F.size(hits), (c + 1) * PART) - 1)
        return F.aggregate(places, F.struct(at.alias("at"), F.array().cast(_MATCH).alias("out")), step, lambda acc: acc["out"])

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(_parts(F.size(hits)), zero, lambda acc, c: F.struct((acc["at"] + width(c)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    found = F.flatten(F.zip_with(_parts(F.size(hits)), starts, of_part))
    return F.when(F.size(hits) == 0, F.array().cast(_MATCH)).otherwise(found)


def _around(gaps: Column, hits: Column, place: Column, width: int) -> tuple[Column, Column]:
    """Up to ``width`` code points before and after a match, from the gaps and matches beside it.

    Matches are not empty, so no more than ``width`` of them reach in.
    """
    first, last = (lambda x: F.substring(x, 1, width)), (lambda x: F.substring(x, -width, width))
    low, high = F.greatest(F.lit(0), place - width), F.least(F.size(hits) - 1, place + width)
    earlier = F.when(place > 0, F.array_join(F.transform(F.sequence(low, place - 1), lambda j: F.concat(last(gaps[j]), last(hits[j]))), "")).otherwise("")
    later = F.when(place < high, F.array_join(F.transform(F.sequence(place + 1, high), lambda j: F.concat(first(hits[j]), first(gaps[j + 1]))), "")).otherwise("")
    before = F.when(F.length(gaps[place]) >= width, last(gaps[place])).otherwise(last(F.concat(earlier, gaps[place])))
    after = F.when(F.length(gaps[place + 1]) >= width, first(gaps[place + 1])).otherwise(first(F.concat(gaps[place + 1], later)))
    return before, after


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _free(spans: Column, taken: Column, least: int) -> Column:
    """Spans of enough score that overlap none of those taken; parts of them that lie elsewhere are passed over whole."""
    in_order = F.array_sort(taken)
    cut = F.transform(_parts(F.size(taken)), lambda c: F.slice(in_order, c * PART + 1, F.lit(PART)))
    boxes = F.transform(cut, lambda x: F.struct(x.alias("items"), x[0]["start"].alias("low"), F.array_max(F.transform(x, lambda t: t["stop"])).alias("high")))
    meets = lambda s, b: (b["low"] < s["stop"]) & (s["start"] < b["high"]) & F.exists(b["items"], lambda t: (t["start"] < s["stop"]) & (s["start"] < t["stop"]))
    able = F.filter(spans, lambda s: s["score"] >= least)
    both = F.array(F.struct(able.alias("s"), boxes.alias("b")))  # so that the boxes are made once
    apart = F.flatten(F.transform(both, lambda x: F.filter(x["s"], lambda s: ~F.exists(x["b"], lambda b: meets(s, b)))))
    return F.when(F.size(taken) == 0, able).otherwise(apart)


def with_spans(docs: DataFrame, text: str, kinds: Sequence[Kind], into: str = "spans", width: int = 40) -> DataFrame:
    """Add ``into``: the sorted spans of all kinds in column ``text``.

    A null text counts as empty; a column of that name is replaced.  The rows
    stay where they are: no shuffle.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    p = fresh(docs, "__")
    own = [f"{p}{part}_{k}" for k in range(len(kinds)) for part in ("hits", "gaps", "spans")]
    out = docs.withColumns({
        f"{p}hits_{k}": F.when(kind.gate(whole), F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        for k, kind in enumerate(kinds)
    })
    out = out.withColumns({
        f"{p}gaps_{k}": F.when(F.size(f"{p}hits_{k}") > 0, F.split(whole, kind.pattern, -1)).otherwise(F.array().cast("array<string>"))
        for k, kind in enumerate(kinds)
    })

    def spans_of(k: int, kind: Kind) -> Column:
        gaps, hits = F.col(f"{p}gaps_{k}"), F.col(f"{p}hits_{k}")

        def edges_free(m):
            if not kind.edge:
                return F.lit(True)
            before, after = _around(gaps, hits, m["place"], 1)
            return ~before.rlike(kind.edge) & ~after.rlike(kind.edge)

        def span(m):
            before, after = map(_lower, _around(gaps, hits, m["place"], width)) if width else (F.lit(""), F.lit(""))
            return F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), F.lit(kind.name).alias("kind"), m["stop"].alias("stop"), m["hit"].alias("hit"), kind.score(m["hit"], before, after).cast("int").alias("score"))

        there = F.filter(_positions(gaps, hits), lambda m: kind.valid(m["hit"]) & edges_free(m))
        return F.when(F.size(hits) > 0, F.transform(there, span)).otherwise(F.array().cast(SPANS))

    base = [k for k, kind in enumerate(kinds) if kind.base]
    added = [k for k, kind in enumerate(kinds) if not kind.base]
    out = out.withColumns({f"{p}spans_{k}": spans_of(k, kind) for k, kind in enumerate(kinds)})
    sure = F.concat(*[F.col(f"{p}spans_{k}") for k in base])
    taken = sure
    for k in added:  # an added span gives way to base spans and to kinds listed before its own
        free = _free(F.col(f"{p}spans_{k}"), taken, kinds[k].least)
        taken = F.concat(taken, F.when(F.size(f"{p}spans_{k}") > 0, free).otherwise(F.array().cast(SPANS)))
    return out.withColumn(into, F.array_sort(taken)).drop(*own)


def rendered(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kinds(spans: Column, names: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*names))


def digest(docs: DataFrame, kinds: Sequence[Kind], spans: str = "spans") -> DataFrame:
    """The contract's columns: counts and digest of base spans, all spans, their scores."""
    base = [k.name for k in kinds if k.base]
    col = F.col(spans)
    return docs.select(
        "doc_id",
        *[F.size(of_kinds(col, [n])).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(rendered(of_kinds(col, base)), 256).alias("base_sha256"),
        rendered(col).alias("spans"),
        F.array_join(F.transform(col, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redacted(text: Column, spans: Column, mask: Callable[[Column], Column]) -> Column:
    """The text with every span replaced by ``mask(span)``; of overlapping spans the union goes once.

    Each part of the spans is worked on in its own piece of the text.
    """
    cut = F.transform(_parts(F.size(spans)), lambda c: F.slice(spans, c * PART + 1, F.lit(PART)))

    def reach(acc, part):
        upto = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["stop"])))
        one = F.struct(acc["at"].alias("low"), upto.alias("high"), part.alias("items"))
        return F.struct(upto.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<low:int,high:int,items:{SPANS}>>").alias("out"))

    def piece(x):
        own = F.substring(text, x["low"] + 1, x["high"] - x["low"])

        def step(acc, s):
            fresh = s["start"] >= acc["at"]
            gap = F.when(fresh, F.substring(acc["own"], acc["at"] - x["low"] + 1, s["start"] - acc["at"])).otherwise(F.lit(""))
            new = F.when(fresh, mask(s)).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["own"].alias("own"), F.concat(acc["out"], gap, new).alias("out"))

        return F.aggregate(x["items"], F.struct(x["low"].alias("at"), own.alias("own"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    built = F.aggregate(cut, zero, reach, lambda acc: F.concat(F.array_join(F.transform(acc["out"], piece), ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, built).otherwise(text)
