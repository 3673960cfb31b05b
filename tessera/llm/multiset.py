"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line that is not blank) hashes to a wide vector, and a
document's fingerprint is the sum of its paragraphs' vectors modulo powers of
two.  Sums do not depend on order; inserting or deleting a paragraph adds or
subtracts its vector.  ``EXACT`` lanes, modulo 2^16, hash the paragraph as a
whole and tell unequal multisets apart.  ``LIKE`` lanes, modulo 2^32, are sums
of +1/-1 vectors of the paragraph's three-word shingles; the squared length of
a difference of two fingerprints there estimates how many shingles differ,
which gives a likeness.

An edited text shares most paragraphs with texts already hashed, so its
fingerprint is made from theirs: the sum of the kept ones, the sum of those
taken from the next document, and two new vectors at the seams.  Sums are run
over lists of lines of bounded size and kept at the few places that are asked for.

Documents are dealt to ranges of ids whose bounds are quantiles, as many as
keep a range near ``RANGE_BYTES`` of text; the first document of each range
also goes to the range before, so that every document meets its successor in
one shuffle, in the order of the ids.

A null text is empty; a text without paragraphs has the zero fingerprint, like
1.0 to another such and 0.0 to any other.  Null ids come last, rows of equal
ids in the order of their texts.  The successor of the last row is the first,
which may be the row itself.  An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, shingled, table

EXACT, LIKE, SHINGLE = 32, 128, 3
LANES = EXACT + LIKE
RANGE_BYTES = 128 << 20
_PIECE = 1 << 15
#: Characters of a list of lines.
_LINES = 1 << 16
_MODULO = np.r_[np.full(EXACT, 0xFFFF, np.uint32), np.full(LIKE, 0xFFFFFFFF, np.uint32)]


def paragraph_vectors(lines: list[str]) -> np.ndarray:
    """A row of lanes for each line; blank lines are zero."""
    out = np.zeros((len(lines), LANES), np.uint32)
    digest, raw, owner = xxhash.xxh3_128_digest, [], []

    def flush() -> None:
        if raw:
            who = np.repeat(*map(np.array, zip(*owner)))
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, LIKE // 8), axis=1)
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            n = np.diff(np.r_[first, len(who)])[:, None]
            out[who[first], EXACT:] += (2 * ones - n).astype(np.uint32)
            raw.clear()
            owner.clear()

    for k, line in enumerate(lines):
        some = False
        for rows in shingled(line, SHINGLE, lower=False):
            some = True
            for at in range(0, len(rows), _PIECE):
                part = [digest(s) for s in rows[at : at + _PIECE]]
                raw.extend(part)
                owner.append((k, len(part)))
                if len(raw) >= _PIECE:
                    flush()
        if some:
            out[k, :EXACT] = np.frombuffer(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=2 * EXACT).digest(), "<u2")
    flush()
    return out


def line_lists(text: str) -> Iterator[list[str]]:
    """The lines of a whole text, list after list."""
    at = 0
    while True:
        cut = text.find("\n", at + _LINES)
        if cut < 0:
            yield text[at:].split("\n")
            return
        yield text[at:cut].split("\n")
        at = cut + 1


def summed(lines: list[str]) -> np.ndarray:
    """The sum of the lines' vectors; a line that repeats is hashed once."""
    seen = Counter(lines)
    return (paragraph_vectors(list(seen)) * np.array(list(seen.values()), np.uint32)[:, None]).sum(axis=0, dtype=np.uint32)


def sums_at(text: str, places: Iterable[int]) -> dict[int | None, np.ndarray]:
    """The sums of the first ``k`` lines for each ``k`` in ``places``; at None that of all."""
    total, seen, out = np.zeros(LANES, np.uint32), 0, {0: np.zeros(LANES, np.uint32)}
    left = sorted(k for k in set(places) if k > 0)
    for lines in line_lists(text):
        at = 0
        while left and left[0] <= seen + len(lines):
            upto = left.pop(0) - seen
            total = total + summed(lines[at:upto])
            out[seen + upto], at = total, upto
        total = total + summed(lines[at:])
        seen += len(lines)
    return out | {None: total}


def reduced(fp: np.ndarray) -> np.ndarray:
    """Every lane modulo its power."""
    return fp & _MODULO


def fingerprint(text: str | None) -> np.ndarray:
    return reduced(sums_at(text or "", ())[None])


def insert(fp: np.ndarray, paragraph: str) -> np.ndarray:
    return reduced(fp + paragraph_vectors([paragraph])[0])


def delete(fp: np.ndarray, paragraph: str) -> np.ndarray:
    return reduced(fp - paragraph_vectors([paragraph])[0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common shingles, 0 to 1; 1 for equal fingerprints."""
    if np.array_equal(a, b):
        return 1.0
    size = lambda x: float(np.square(x[EXACT:].view(np.int32).astype(np.float64)).sum())
    whole = size(a) + size(b)
    return min(1.0, max(0.0, 1.0 - size(a - b) / whole)) if whole else 0.0


def _shown(fp: np.ndarray) -> str:
    return fp[:EXACT].astype("<u2").tobytes().hex() + fp[EXACT:].astype("<u4").tobytes().hex()


class Hashed:
    """A text with the sums that its edited text, and that of a document before it (which takes ``taken`` characters), are made from."""

    def __init__(self, text: str | None, taken: int = 0):
        self.text = text or ""
        self.kept = len(self.text) - len(self.text) // 2
        self.whole = self.text.count("\n", 0, self.kept)
        self.rest = self.text.count("\n", 0, taken)
        self.sums = sums_at(self.text, (1, self.whole, self.rest))

    @property
    def fp(self) -> np.ndarray:
        return reduced(self.sums[None])


def _sha256(*texts: str) -> str:
    out = hashlib.sha256()
    for text in texts:
        for at in range(0, len(text), 1 << 20):
            out.update(text[at : at + (1 << 20)].encode("utf-8", "surrogatepass"))
    return out.hexdigest()


def edited(one: Hashed, following: Hashed) -> tuple[str, np.ndarray]:
    """The digest of the edited text, and its fingerprint from the sums of both texts."""
    kept, new = one.text[: one.kept], following.text[: len(one.text) - one.kept]
    start, cut, last = kept.rfind("\n") + 1, new.find("\n"), new.rfind("\n")
    seam = kept[start:] + (new if cut < 0 else new[:cut])
    fp = one.sums[one.whole] + paragraph_vectors([seam])[0]
    if cut >= 0:
        fp = fp + following.sums[following.rest] - following.sums[1] + paragraph_vectors([new[last + 1 :]])[0]
    return _sha256(kept, new), reduced(fp)


def in_order(docs: DataFrame, text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``docs`` dealt by descending id to ranges, a partition each, sorted, each range followed by its successor.

    Columns ``(range, ahead, doc_id, text)``; rows with ``ahead`` only follow.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")).alias("text"))
    size, top = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.max("doc_id")).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    found = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0]
    bounds = sorted(set(found or ()))
    last, step = len(bounds), max(1, math.isqrt(len(bounds)))
    literal = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>") if x else F.array().cast("array<long>")
    # How many bounds lie below an id: whole steps first, then the bounds of one step.
    steps = F.size(F.filter(literal(bounds[step - 1 :: step]), lambda b: b < F.col("doc_id"))) * step
    near = F.slice(literal(bounds), steps + 1, F.lit(step))
    own = F.lit(last) - F.coalesce(F.when(F.col("doc_id").isNotNull(), steps + F.size(F.filter(near, lambda b: b < F.col("doc_id")))), F.lit(0))
    there = rows.withColumn("own", own).withColumn("ahead", F.array_compact(F.array(F.when(F.array_contains(near, F.col("doc_id")), F.col("own") - 1), F.when(F.col("doc_id") == top, F.lit(last)))))
    to = F.concat(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("ahead"))), F.transform("ahead", lambda r: F.struct(r.alias("range"), F.lit(True).alias("ahead"))))
    dealt = there.select(F.explode(to).alias("to"), "doc_id", "text").select("to.range", "to.ahead", "doc_id", "text")
    return dealt.repartitionById(last + 1, F.col("range")).sortWithinPartitions("range", "ahead", F.desc_nulls_last("doc_id"), "text")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of its successor."""

    def results(rows: Iterator[tuple]) -> Iterator[tuple]:
        group, pending, first = None, None, None
        for at, ahead, doc_id, text_ in rows:
            if at != group:
                if pending:  # nothing follows the range: the only one, so its first row does
                    yield row(*pending, first)
                group, pending, first = at, None, None
            if ahead and not pending:
                continue
            following = Hashed(text_, len(pending[1].text) // 2 if pending else 0)
            if pending:
                yield row(*pending, following)
            first = text_ if first is None else first
            pending = None if ahead else (doc_id, following)
        if pending:
            yield row(*pending, first)

    def row(doc_id, one: Hashed, following: Hashed | str) -> tuple:
        if isinstance(following, str):
            following = Hashed(following, len(one.text) // 2)
        digest, fp = edited(one, following)
        return doc_id, len(one.text), digest, _shown(one.fp), _shown(fp), likeness(one.fp, fp), likeness(one.fp, following.fp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _OUT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        flat = (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns]))
        out = []
        for made in results(flat):
            out.append(made)
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return in_arrow(in_order(docs, text), run, _OUT)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    return compared(table(spark, sf_dir, "documents"))
