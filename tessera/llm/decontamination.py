"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared seeds, runs of ``LEAST`` equal
words.  A pair that shares a seed is tiled: the longest runs of words common
to both and not yet marked are marked first, found by Karp-Rabin hashing of
every unmarked window, until no run of ``LEAST`` words is left.  Tiles may lie
in any order, so a passage whose sentences were reordered is still covered.
A document holds an item if its tiles cover ``THRESHOLD`` of the item's words.

The benchmark is read in blocks of at most about ``BLOCK_CHARS`` characters,
each sent to every task and run against all documents; a larger benchmark
means more blocks, not larger ones.  Documents are never shuffled, and each is
read whole, once for each block: a benchmark of ``n`` blocks costs ``n`` scans.

Words are Unicode letters, digits and underscores, lower-cased; punctuation
and spacing do not count.  A null or short text holds nothing, an item of
fewer than ``LEAST`` words is too short to be evidence and is never found.
An item may have a null id.  Items of one text and different ids are found
each; a repeated row of the benchmark counts once, a repeated row of documents
repeats its results.  Empty tables give none.  Extra columns are ignored by
``contaminations`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, table

LEAST, THRESHOLD = 5, 0.6
BLOCK_CHARS = 8_000_000
_BASE, _ALL = 1_000_003, (1 << 64) - 1
#: Pairs of equal windows that are looked at together.
_PAIRS = 1 << 18
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _runs(free: np.ndarray, s: int) -> np.ndarray:
    """Where ``s`` unmarked words begin."""
    if len(free) < s:
        return np.zeros(0, np.int64)
    n = np.concatenate(([0], np.cumsum(free)))
    return np.flatnonzero(n[s:] - n[:-s] == s)


def _prefix(seq: np.ndarray) -> list[int]:
    at, out = 0, [0]
    for x in seq.tolist():
        at = (at * _BASE + x + 1) & _ALL
        out.append(at)
    return out


def _openings(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, sums: tuple[np.ndarray, np.ndarray], s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places where equal hashes of ``s`` words begin a common run, a bounded number at once.

    A pair that the pair before it extends to the left begins no run of its own:
    repetitive texts have many equal windows and few such beginnings.
    """
    power = np.uint64(pow(_BASE, s, 1 << 64))
    at_a, at_b = _runs(free_a, s), _runs(free_b, s)
    ha, hb = (h[at + s] - h[at] * power for h, at in zip(sums, (at_a, at_b)))
    order = np.argsort(ha, kind="stable")
    at_a, ha = at_a[order], ha[order]
    first, last = np.searchsorted(ha, hb), np.searchsorted(ha, hb, "right")
    met = np.flatnonzero(last > first)
    at_b, first, n = at_b[met], first[met], (last - first)[met]
    upto = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + _PAIRS, "right")))
        k = n[start:stop]
        within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        i, j = at_a[np.repeat(first[start:stop], k) + within], np.repeat(at_b[start:stop], k)
        more = (i > 0) & (j > 0)
        more[more] = free_a[i[more] - 1] & free_b[j[more] - 1] & (a[i[more] - 1] == b[j[more] - 1])
        yield i[~more], j[~more]
        start = stop


def tiles(a: list[int], b: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles ``(length, place in a, place in b)`` of greedy string tiling; negative words match nothing.

    Of equally long matches that of the first place in ``a``, then in ``b``, is
    marked.  A match that a longer tile cuts goes back in parts.
    """
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    free_a, free_b = a >= 0, b >= 0
    sums = tuple(np.array(_prefix(x), np.uint64) for x in (a, b))
    out, s = [], max(least, min(len(a), len(b), 32))
    list_a, list_b = a.tolist(), b.tolist()
    while True:
        heap, most = [], 0
        open_a, open_b = free_a.tolist(), free_b.tolist()
        for at_a, at_b in _openings(a, b, free_a, free_b, sums, s):
            for i, j in zip(at_a.tolist(), at_b.tolist()):
                k, end = 0, min(len(list_a) - i, len(list_b) - j)
                while k < end and open_a[i + k] and open_b[j + k] and list_a[i + k] == list_b[j + k]:
                    k += 1
                most = max(most, k)
                if k >= s:
                    heap.append((-k, i, j))
        if most > 2 * s:  # long matches first, by windows of their own length
            s = most
            continue
        heapq.heapify(heap)
        while heap:
            k, i, j = heapq.heappop(heap)
            both = free_a[i : i - k] & free_b[j : j - k]
            if both.all():
                free_a[i : i - k] = free_b[j : j - k] = False
                out.append((-k, i, j))
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, both, False].astype(np.int8)))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if y - x >= s:
                    heapq.heappush(heap, (x - y, i + x, j + x))
        if s == least:
            return out
        s = max(least, s // 2)


class Index:
    """Seeds of one block of items."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.least, self.vocabulary, self.items = least, {}, []
        hashes, owners = [], []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if len(ids) >= least:
                h = np.unique(self.seeds(np.array(ids, np.int64)))
                hashes.append(h)
                owners.append(np.full(len(h), len(self.items)))
                self.items.append((item_id, ids))
        h, o = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owners, np.int64)))
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order]

    def state(self) -> tuple:
        """What a broadcast carries: plain data, which executors read without this library."""
        return self.least, self.vocabulary, self.items, self.hashes, self.owners

    @classmethod
    def restored(cls, state: tuple) -> Index:
        out = cls.__new__(cls)
        out.least, out.vocabulary, out.items, out.hashes, out.owners = state
        return out

    def seeds(self, ids: np.ndarray) -> np.ndarray:
        """Rolling hashes of the windows of ``least`` words."""
        n, out = len(ids) - self.least + 1, None
        for k in range(self.least):
            part = ids[k : k + n].astype(np.uint64) + np.uint64(1)
            out = part if out is None else out * _STEP + part
        return out

    def held(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int, int]]:
        """``(item_id, tiles, covered, words, longest)`` of the items that a text holds."""
        get = self.vocabulary.get
        doc = np.array([get(w, -1) for w in words_of(text)], np.int64)
        if len(doc) < self.least or not len(self.hashes):
            return []
        known = np.concatenate(([0], np.cumsum(doc >= 0)))
        starts = np.flatnonzero(known[self.least :] - known[: -self.least] == self.least)
        if not len(starts):
            return []
        h = self.seeds(doc)[starts]
        left, right = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        meets: dict[int, list[int]] = defaultdict(list)
        for at in np.flatnonzero(right > left):
            for owner in self.owners[left[at] : right[at]]:
                meets[int(owner)].append(int(starts[at]))
        out = []
        for owner in sorted(meets):
            item_id, ids = self.items[owner]
            if self.least * len(meets[owner]) < threshold * len(ids) and self._reach(meets[owner]) < threshold * len(ids):
                continue  # no tile lies outside these windows
            text_words, last = [], -1
            for at in meets[owner]:  # only what lies in a shared window can be in a tile
                if at > last:
                    text_words.append(-1)
                    last = at
                text_words.extend(doc[last : at + self.least].tolist())
                last = at + self.least
            found = tiles(ids, text_words, self.least)
            covered = sum(k for k, _, _ in found)
            if covered >= threshold * len(ids):
                out.append((item_id, len(found), covered, len(ids), max(k for k, _, _ in found)))
        return out

    def _reach(self, starts: list[int]) -> int:
        total, last = 0, -1
        for at in starts:
            total += at + self.least - max(last, at)
            last = at + self.least
        return total


def blocks(benchmark: DataFrame, least: int = LEAST, most: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes of the benchmark's distinct items, in blocks whose size is checked before they are collected.

    Items are dealt by a hash of id and text, and distinct, so that more blocks always part them.
    """
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    total, largest = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.coalesce(F.max(F.length("text")), F.lit(0))).first()
    n = max(1, -(-total // most))
    while n > 1:
        sizes = items.groupBy(F.expr(f"pmod(xxhash64(item_id, text), {n})")).agg(F.sum(F.length("text")))
        if sizes.agg(F.max("sum(length(text))")).first()[0] <= 2 * max(most, largest):
            break
        n *= 2
    for k in range(n):
        rows = items.where(F.expr(f"pmod(xxhash64(item_id, text), {n}) = {k}")).collect()
        yield Index(sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1])), least)


_FOUND = "doc_id long, item_id long, tiles int, covered int, item_words int, coverage double, longest int"


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    spark, out = docs.sparkSession, None
    for index in blocks(benchmark, least):
        sent = spark.sparkContext.broadcast(index.state())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index.restored(sent.value)
            for batch in batches:
                rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in index.held(t, threshold)]
                cols = list(zip(*rows)) if rows else [()] * 6
                cover = [c / n for c, n in zip(cols[3], cols[4])]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols[:5], cover, cols[5]], kinds)], names=["doc_id", "item_id", "tiles", "covered", "item_words", "coverage", "longest"])

        part = in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, _FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    place = docs.columns.index("text")
    for index in blocks(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(index.state())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index.restored(sent.value)
            for batch in batches:
                clean = [not index.held(t, threshold) for t in batch.column(place).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = in_arrow(docs, run, docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` that holds an item of ``benchmark``, with the item."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
