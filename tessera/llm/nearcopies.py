"""Near copies: SimHash fingerprints linked by a grid range-join, checked exactly.

The steps are those of ``op4_simhash``, with a wide fingerprint where that one
has 64 bits, as texts that share 0.8 of their shingles differ in 15 % of the
bits, too many for a search at two of 64.  A bit is 1 if set in over half of the
hashes of a text's distinct shingles.  The embedding has the bit count of every
two-bit segment, so the Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints; in unary it is the bit count of an XOR.

The range-join: a grid takes some coordinates of the embedding, and a cell has
equal ones.  A text goes to its own cell of each grid and to the ``PROBES - 1``
nearest others, those that it would be in if the bits with the closest majority
were different, as near copies differ in such bits first.  Texts that meet in a cell are
candidates if the Manhattan distance of their embeddings is within the range,
``DEVIATIONS`` above what texts of ``LEAST`` = 0.8 have: first by three words
that the cell does not use, then by the whole.  ``grids`` takes as many grids as
miss a pair at ``LEAST`` with a chance of ``MISSED``, more alike ones with less.  More
texts get more coordinates a cell, so that few unlike texts meet.

Every candidate is decided by the exact Jaccard index of its shingles, unless
its texts are linked by others.  Two rounds, over few and over all cells of a text,
compare the members of a cell with the ``PIVOTS`` first ones only, and of each the
nearest and the smallest that it met, which joins the bulk of a group of near copies.

The last round compares all members of different components, of which a large group
has as many pairs as the square of its size where its texts are just under ``LEAST``.
So pairs are never rows.  Texts stand in one order, in which those that candidates of
the first rounds join are neighbours, and ``BLOCK`` neighbours at most are a block.  A
cell names a text once for each block that it has a candidate in; all texts named for
two blocks meet once, are compared by the range and then exactly, in one product of
their shingles, and give the edges of a forest.

A text of fewer words than a shingle is one shingle; null and wordless texts
are copies of each other.  Texts, and shingles, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import brief_shuffles, discard, in_arrow, materialize, pieces, shingled, split_join, word_lists
from tessera.llm.components import components

WIDTH, LEAST = 5, 0.8
#: Chance that the grids part two texts as alike as ``LEAST``.
MISSED = 0.0003
#: Cells of a text in a grid, in the first round and in the others, and bits with the closest majority that they differ in.
FIRST, PROBES, WEAK = 4, 16, 8
#: A text of fewer shingles goes to all cells that differ in ``WEAK`` bits; its majorities tell little.
TINY = 16
#: Members of a cell that are compared as one square, and members that all others are compared with in the first rounds.
MOST, PIVOTS = 512, 1
#: Words of an embedding that travel with a cell's member; deviations of the range over them and over the whole; its stretch for tiny texts.
CHECKED, DEVIATIONS, STRETCH = 3, (4.0, 4.5), 1.3
#: Members a node that are shuffled at once; a cell's members are in one of the buckets of about ``_ROWS``.
SHUFFLED = 64
#: Texts of a block, and the shingles that they have in all; a longer text is a block with those before it.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Members a bucket that a task packs at once, if that many fit into ``_HELD``, and texts that share a shingle counted pair by pair.
PACKED, RARE = 64, 8
_PIECE, _ROWS, _HELD = 4096, 1 << 17, 1 << 20
_LOW = np.uint64(0x5555555555555555)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a whole text."""
    digest, out = xxhash.xxh64_digest, np.empty(0, np.uint64)
    for rows in shingled(text, width):
        out = np.union1d(out, np.frombuffer(b"".join([digest(s, 42) for s in rows]), np.uint64))
    return out


def node_of(text: str) -> int:
    """The hash of a text's words, the same for texts of the same words."""
    state, first = xxhash.xxh64(seed=42), True
    for w in word_lists(text):
        if w:
            state.update((b"" if first else b" ") + b" ".join(w))
            first = False
    return state.intdigest()


def _mixed(found: np.ndarray, words: int) -> np.ndarray:
    """Each hash as so many words, of which the first is the hash."""
    x = found[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    x[:, 0] = found
    return x


def bit_counts(found: np.ndarray, words: int) -> np.ndarray:
    """How many of the hashes have each bit set."""
    out = np.zeros(64 * words, np.int64)
    for at in range(0, len(found), _PIECE):
        x, weight = _mixed(found[at : at + _PIECE], words), 1
        while len(x):
            carries = [x[:0]]
            while len(x) > 256:  # three rows of a weight are one of it and one of twice as much
                n = len(x) // 3
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                odd = a ^ b
                carries.append(a & b | c & odd)
                x = np.concatenate([odd ^ c, x[3 * n :]])
            out += weight * np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            x, weight = np.concatenate(carries), 2 * weight
    return out


def majorities(counts: np.ndarray, n: int) -> np.ndarray:
    """How far each bit is from half of ``n``, in 40ths of the square root, as a byte: 0 or more where the fingerprint's bit is 1."""
    return np.clip(np.ceil(40 * (2 * counts - n) / math.sqrt(max(n, 1))) - 1, -128, 127).astype(np.int8)


def embedded(majority: np.ndarray) -> np.ndarray:
    """The segment counts of fingerprints, a row each, in unary: words whose XOR has the Manhattan distance as bit count."""
    fp = np.packbits(majority >= 0, axis=1, bitorder="little").view(np.uint64)
    either, both = (fp | fp >> np.uint64(1)) & _LOW, fp & fp >> np.uint64(1) & _LOW
    return either | both << np.uint64(1)


@dataclass(frozen=True)
class Grids:
    """``count`` grids of ``coordinates`` each over fingerprints of ``words`` words."""

    coordinates: int
    count: int
    words: int

    def checked(self, grid: int) -> list[int]:
        """The words that members of a cell are compared by, none that the cell depends on."""
        last = (2 * self.coordinates * (grid + 1) - 1) // 64
        return [(last + 1 + k) % self.words for k in range(CHECKED)]

    def cells(self, majority: np.ndarray, grid: int, probes: int) -> np.ndarray:
        """The nearest cells of texts, a row each, in one grid; the first is their own if ``probes`` is 1."""
        k = 2 * self.coordinates
        q = majority[:, grid * k : (grid + 1) * k].astype(np.int64)
        ones = q >= 0
        far = np.where(ones, q, -1 - q)
        weight = np.random.default_rng([grid, k]).integers(1, 1 << 63, self.coordinates, np.uint64)[np.arange(k) // 2]
        cell = (ones * weight).sum(axis=1, dtype=np.uint64)[:, None] + np.uint64(grid)
        if probes == 1:
            return cell.view(np.int64)
        cost = np.zeros((len(q), 1))
        weak = np.argsort(far * k + np.arange(k), axis=1)[:, :WEAK]
        for b in weak.T:
            at = np.arange(len(q)), b
            step = np.where(ones[at], np.uint64(0) - weight[b], weight[b])[:, None]
            cell, cost = np.hstack([cell, cell + step]), np.hstack([cost, cost + far[at][:, None] + 0.5])
        if probes < cell.shape[1]:
            cell = np.take_along_axis(cell, np.argpartition(cost, probes - 1, axis=1)[:, :probes], axis=1)
        return cell.view(np.int64)


def flips(least: float) -> float:
    """The share of bits in which texts as alike as ``least`` differ."""
    return math.acos(min(1.0, 2 * least / (1 + least))) / math.pi


def reach(words: int, least: float, deviations: float) -> int:
    """The range: the Manhattan distance of the embeddings of texts as alike as ``least``, and so many deviations more."""
    p = flips(least)
    mean, square = 2 * p * (1 - p) + p * p, 2 * p * (1 - p) + 2 * p * p  # of a segment's difference
    return int(32 * words * mean + deviations * math.sqrt(32 * words * (square - mean * mean)))


@lru_cache
def grids(n: int, least: float = LEAST) -> Grids:
    """The grids for ``n`` texts.  How often one joins two texts at ``least`` is counted on drawn pairs; 15 % more grids make up for small texts."""
    coordinates = next((c for c, most in ((10, 1 << 14), (12, 1 << 18), (14, 1 << 21), (16, 1 << 24)) if n <= most), 18)
    rng, one, cos = np.random.default_rng(11), Grids(coordinates, 1, 1), math.cos(math.pi * flips(least))
    x, other = rng.standard_normal((2, 4000, 2 * coordinates))
    a, b = (one.cells(np.clip(np.ceil(40 * z) - 1, -128, 127), 0, PROBES) for z in (x, cos * x + math.sqrt(1 - cos * cos) * other))
    joined = min((a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean(), 0.999)
    count = math.ceil(1.15 * math.log(MISSED) / math.log(1 - joined))
    return Grids(coordinates, count, max(-(-2 * coordinates * count // 64), CHECKED + 2))


def hashed(docs: DataFrame, text: str, key: str, width: int, words: int) -> DataFrame:
    """``(doc_id, key, node, size, majority, embedding)`` of every row; rows of one node have the same words, ``size`` distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            nodes, sizes, found = np.array([node_of(t) for t in texts], np.uint64).view(np.int64), [], []
            for t in texts:
                own = shingles(t, width)
                sizes.append(len(own))
                found.append(majorities(bit_counts(own, words), len(own)))
            columns = [pa.array(nodes), pa.array(sizes, pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in (found, embedded(np.stack(found))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "key", "node", "size", "majority", "embedding"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col(key), text), run, "doc_id long, key long, node long, size int, majority binary, embedding binary")


#: A member of a cell, as packed in a bucket.
_MEMBER = np.dtype([("cell", "i8"), ("node", "i8"), ("root", "i8"), ("size", "i4"), ("words", "u8", (CHECKED,))])


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    """Binary values of one length, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def members(nodes: DataFrame, grid: Grids, probes: int, some: range, buckets: int) -> DataFrame:
    """``(bucket, packed)``: the members of all cells of some of the grids; ``nodes(node, root, size, majority, embedding)``.

    A task packs members of many texts at once, so that a row has ``PACKED`` of them or more, however many buckets there are.
    """

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = np.concatenate(held)
        held.clear()
        bucket = (out["cell"].view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        names, start = np.unique(bucket[order], return_index=True)
        packed, n = np.split(out[order], start[1:]), max(1, len(names) * _ROWS // len(out))
        for at in range(0, len(names), n):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + n].astype(np.int64)), pa.array([x.tobytes() for x in packed[at : at + n]], pa.binary())], names=["bucket", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, full = [], min(max(_ROWS, PACKED * buckets), _HELD)
        for batch in batches:
            majority, words = _rows(batch.column(3), np.int8), _rows(batch.column(4), np.uint64)
            node, root, size = (batch.column(c).to_numpy() for c in range(3))
            for rows, n in ((np.flatnonzero(size >= TINY), probes), (np.flatnonzero(size < TINY), 1 << WEAK)):
                for g in some if len(rows) else ():
                    cell = grid.cells(majority[rows], g, n)
                    each = np.repeat(rows, cell.shape[1])
                    out = np.empty(len(each), _MEMBER)
                    out["cell"], out["node"], out["root"], out["size"], out["words"] = cell.ravel(), node[each], root[each], size[each], words[each][:, grid.checked(g)]
                    held.append(out)
                    if sum(map(len, held)) >= full:
                        yield from flush(held)
        if held:
            yield from flush(held)

    return in_arrow(nodes.select("node", "root", "size", "majority", "embedding"), run, "bucket long, packed binary")


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]] if len(rows) else rows


def _block(place: np.ndarray) -> np.ndarray:
    return place >> 16


def _named(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows ``a, b, place`` of pairs of places: either text is named for the two blocks."""
    a, b = np.minimum(_block(u), _block(v)), np.maximum(_block(u), _block(v))
    return _distinct(np.concatenate([np.stack([a, b, x], axis=1) for x in (u, v)]))


def _met(rows: np.ndarray, least: float, pivots: int | None) -> np.ndarray:
    """Candidates among members sorted by cell: with ``pivots`` rows ``u, v, apart``, pairs with a cell's first members; without those of ``_named``, of all of different roots."""
    cell, node, root, size, words = (np.ascontiguousarray(rows[c]) for c in rows.dtype.names)
    start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    length = np.diff(np.r_[start, len(cell)])
    near, out = reach(CHECKED, least, DEVIATIONS[0]), [np.empty((0, 3), np.int64)]

    def check(a: np.ndarray, b: np.ndarray) -> None:
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        fit = (root[a] != root[b]) & (low >= least * high - 1e-9)
        a, b, low = a[fit], b[fit], low[fit]
        apart = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        fit = apart <= np.where(low < TINY, STRETCH * near, near)
        u, v = node[a[fit]], node[b[fit]]
        out.append(np.stack([np.maximum(u, v), np.minimum(u, v), apart[fit]], axis=1) if pivots else _named(u, v))
        if sum(map(len, out[1:])) > _HELD:
            out[:] = [_distinct(np.concatenate(out)), out[0][:0]]

    if pivots:
        first, within = np.repeat(start, length), np.arange(len(cell)) - np.repeat(start, length)
        for k in range(pivots):
            at = np.flatnonzero(within > k)
            check(at, first[at] + k)
    else:
        mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        left = np.flatnonzero(np.repeat(mixed & (length <= MOST), length))
        end, step = np.repeat(start + length, length), 1
        while len(left := left[left + step < end[left]]):
            check(left, left + step)
            step += 1
        large = mixed & (length > MOST)
        for s, n in zip(start[large], length[large]):
            # Of two members of different roots one is not of the most frequent root.
            names, which, count = np.unique(root[s : s + n], return_inverse=True, return_counts=True)
            every = np.arange(s, s + n)
            for a in every[which != count.argmax()]:
                check(np.full(n, a), every)
    return _distinct(np.concatenate(out))


def _cells(nodes: DataFrame, grid: Grids, probes: int, met: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> Iterator[DataFrame]:
    """What ``met`` makes of the members of each bucket, sorted by cell, as many grids at a time as have ``SHUFFLED`` members a node."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
            rows = np.frombuffer(b"".join(packed), _MEMBER)
            packed.clear()
            yield from met(rows[np.lexsort((rows["node"], rows["cell"]))])

        held: list[bytes] = []
        last = None
        for batch in pieces(batches):
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != last and held:
                    yield from flush(held)
                last = bucket
                held.append(packed)
        if held:
            yield from flush(held)

    step = max(1, SHUFFLED // probes)
    buckets = nodes.count() * probes * min(step, grid.count) // _ROWS + 1
    for g in range(0, grid.count, step):
        cells = members(nodes, grid, probes, range(g, min(g + step, grid.count)), buckets).repartition("bucket").sortWithinPartitions("bucket")
        yield cells.mapInArrow(meet, schema)


def candidates(nodes: DataFrame, grid: Grids, probes: int, least: float, pivots: int) -> DataFrame:
    """Pairs ``(u, v)`` of ``nodes(node, root, size, majority, embedding)`` with ``u > v`` within the range, two a node at most.

    Members meet the first ones of their cells only, and of each the nearest and the smallest that it met remain.
    """

    def met(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = _met(rows, least, pivots)
        for at in range(0, len(found), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[at : at + _ROWS].T], names=["u", "v", "apart"])

    of_each = lambda df: df.groupBy("u").agg(F.min(F.struct("apart", "v")).alias("near"), F.min("v").alias("least"))
    found = [materialize(of_each(df)) for df in _cells(nodes, grid, probes, met, "u long, v long, apart long")]
    pairs = reduce(DataFrame.union, found).groupBy("u").agg(F.min("near").alias("near"), F.min("least").alias("least"))
    pairs = pairs.select("u", F.explode(F.array("near.v", "least")).alias("v")).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = reach(grid.words, least, DEVIATIONS[1])
        for batch in batches:
            a, b = (_rows(batch.column(c), np.uint64) for c in (2, 3))
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            low = np.minimum(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            fit = pa.array(apart <= np.where(low < TINY, STRETCH * near, near))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fit), batch.column(1).filter(fit)], names=["u", "v"])

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("embedding").alias(f"{c}_m"), F.col("size").alias(f"{c}_n"))
    both = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_m", "v_m", "u_n", "v_n")
    near = materialize(in_arrow(both, whole, "u long, v long"))
    discard(*found)
    return near


def places(nodes: DataFrame) -> DataFrame:
    """``nodes(node, group, root, size, ...)`` in one order, by group and root, with their ``place``, of which the upper bits are the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, shingled_, part = 0, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for size in batch.column(batch.schema.get_field_index("size")).to_pylist():
                if n == BLOCK or n and shingled_ + size > BLOCK_SHINGLES:
                    block, n, shingled_ = block + 1, 0, 0
                out.append((part << 24 | block) << 16 | n)
                n, shingled_ = n + 1, shingled_ + size
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *batch.columns], names=["place", *batch.schema.names])

    order = ["group", "root", "node"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return in_arrow(nodes.repartitionByRange(*order).sortWithinPartitions(*order), run, f"place long, {kinds}")


def by_blocks(rows: DataFrame, run: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``run`` makes of all rows of each two blocks; ``rows(a, b, ...)``."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in pieces(batches):
            a, b = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
            for at, end in zip(cuts, cuts[1:]):
                if held and last != (a[at], b[at]):
                    yield run(pa.Table.from_batches(held))
                    held.clear()
                last = a[at], b[at]
                held.append(batch.slice(at, end - at))
        if held:
            yield run(pa.Table.from_batches(held))

    return rows.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(grouped, schema)


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy()


def _apart(rows: pa.Table) -> np.ndarray:
    """Which two of the texts named for two blocks have different roots and are one of each block."""
    root, block = _column(rows, "root"), _block(_column(rows, "place"))
    fit = root[:, None] != root
    return fit if rows["a"][0] == rows["b"][0] else fit & (block[:, None] != block)


def contested(placed: DataFrame, grid: Grids, probes: int, least: float) -> DataFrame:
    """``(a, b, place)``: the texts of blocks ``a`` and ``b`` that meet one of another root in a cell and have one of the other block within the range."""

    def met(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = _met(rows, least, None)
        if len(found):
            start = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)])
            packed = pa.array([x.tobytes() for x in np.split(np.ascontiguousarray(found[:, 2]), start[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found[start, :2].T), packed], names=["a", "b", "packed"])

    def union(rows: pa.Table) -> pa.RecordBatch:
        place = np.unique(np.frombuffer(b"".join(rows["packed"].to_pylist()), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(place), rows[c][0].as_py())) for c in "ab"] + [pa.array(place)], names=["a", "b", "place"])

    def within(rows: pa.Table) -> pa.RecordBatch:
        near, size, m, fit = reach(grid.words, least, DEVIATIONS[1]), _column(rows, "size"), _rows(rows["embedding"], np.uint64), _apart(rows)
        for at in range(0, len(m), 64):
            some = slice(at, at + 64)
            low, high = np.minimum(size[some, None], size), np.maximum(size[some, None], size)
            apart = np.bitwise_count(m[some, None] ^ m).sum(axis=2, dtype=np.int64)
            fit[some] &= (apart <= np.where(low < TINY, STRETCH * near, near)) & (low >= least * high - 1e-9)
        return rows.select(["a", "b", "place"]).filter(pa.array(fit.any(axis=1))).combine_chunks().to_batches(max_chunksize=None)[0] if fit.any() else pa.RecordBatch.from_pylist([], rows.select(["a", "b", "place"]).schema)

    nodes, key = placed.select(F.col("place").alias("node"), "root", "size", "majority", "embedding"), "a long, b long, place long"
    found = [materialize(df) for df in _cells(nodes, grid, probes, met, "a long, b long, packed binary")]
    named = materialize(by_blocks(reduce(DataFrame.union, found), union, key))
    rows = named.join(placed.select("place", "root", "size", "embedding"), "place").select("a", "b", "place", "root", "size", "embedding")
    near = materialize(by_blocks(rows, within, key))
    discard(*found, named)
    return near


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share, for all two different ones."""
    n, found = len(sets), np.concatenate(sets)
    order = np.argsort(found, kind="stable")
    found, which = found[order], np.repeat(np.arange(n), [len(x) for x in sets])[order]
    start = np.flatnonzero(np.r_[True, found[1:] != found[:-1]][: len(found)])
    held, out = np.diff(np.r_[start, len(found)]), np.zeros((n, n), np.int64)
    for k in range(2, RARE + 1):
        rows = which[start[held == k][:, None] + np.arange(k)]
        for j in range(k if len(rows) else 0):
            for i in range(j):
                out += np.bincount(rows[:, i] * n + rows[:, j], minlength=n * n).reshape(n, n)
    out += out.T
    frequent = np.flatnonzero(held > RARE)
    for at in range(0, len(frequent), _PIECE):
        some = frequent[at : at + _PIECE]
        has = np.zeros((n, len(some)), np.float32)
        for k, c in enumerate(some):
            has[which[start[c] : start[c] + held[c]], k] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def forest(fit: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs of ``fit`` as many as join the roots, no more."""
    names, which = np.unique(root, return_inverse=True)
    u, v = np.nonzero(np.triu(fit | fit.T, 1))
    _, first = np.unique(np.minimum(which[u], which[v]) * len(names) + np.maximum(which[u], which[v]), return_index=True)
    above, out = list(range(len(names))), []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for a, b in zip(u[first].tolist(), v[first].tolist()):
        x, y = top(which[a]), top(which[b])
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def shingle_sets(needed: DataFrame, docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """``(node, shingles)`` of ``needed(node, n_id, n_key)``, which name a row each."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or "", width).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    same = (F.col("key") == F.col("n_key")) & F.col("id").eqNullSafe(F.col("n_id"))  # copies under other ids need not meet
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(key).alias("key"), F.col(text).alias("text")).join(needed.hint("merge"), same).dropDuplicates(["node"])
    return materialize(in_arrow(texts.select("node", "text"), hashes, "node long, shingles binary"))


def decided(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text: str, key: str, width: int, least: float) -> DataFrame:
    """The pairs ``(u, v)`` whose texts are alike by their shingles.  ``nodes(node, n_id, n_key)`` name a row each."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in (2, 3))
            fit = pa.array([alike(x, y, least) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fit), batch.column(1).filter(fit)], names=["u", "v"])

    needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.select("node", "n_id", "n_key"), "node")
    sets = shingle_sets(needed, docs, text, key, width)
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_s"))
    both = pairs.join(of("v").hint("merge"), "v").join(of("u").hint("merge"), "u").select("u", "v", "u_s", "v_s")
    edges = materialize(in_arrow(both, compare, "u long, v long"))
    discard(sets)
    return edges


def decided_by_blocks(near: DataFrame, placed: DataFrame, docs: DataFrame, text: str, key: str, width: int, least: float) -> DataFrame:
    """Pairs ``(u, v)`` alike by their shingles that join all roots which pairs of ``near(a, b, place)`` do."""

    def compare(rows: pa.Table) -> pa.RecordBatch:
        sets, node = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()], _column(rows, "node")
        both, n = common(sets), np.array([len(x) for x in sets])
        edges = forest(_apart(rows) & (both >= least * (n[:, None] + n - both) - 1e-9), _column(rows, "root"))
        return pa.RecordBatch.from_arrays([pa.array([int(node[e[c]]) for e in edges], pa.int64()) for c in (0, 1)], names=["u", "v"])

    needed = near.select("place").distinct().join(placed.select("place", "node", "n_id", "n_key"), "place").drop("place")
    sets = shingle_sets(needed, docs, text, key, width)
    named = near.join(placed.select("place", "node", "root"), "place").join(sets.hint("merge"), "node")
    edges = materialize(by_blocks(named.select("a", "b", "place", "node", "root", "shingles"), compare, "u long, v long"))
    discard(sets)
    return edges


def linked_components(docs: DataFrame, nodes: DataFrame, text: str, key: str, grid: Grids, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``(node, root)`` of every node that is alike to another.  ``nodes(node, n_id, n_key, size, majority, embedding)`` are distinct and name a row each."""
    edges, used, met, named = [], [], [], nodes.withColumn("root", F.col("node"))
    for probes in (FIRST, PROBES):
        met.append(candidates(named, grid, probes, least, PIVOTS))
        edges.append(decided(met[-1], docs, nodes, text, key, width, least))
        roots = components(reduce(DataFrame.union, edges))
        named = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        used += [roots, named]
    groups = components(reduce(DataFrame.union, met))
    grouped = named.join(groups.withColumnRenamed("root", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    placed = materialize(places(grouped))
    discard(groups, *used)
    near = contested(placed, grid, PROBES, least)
    edges.append(decided_by_blocks(near, placed, docs, text, key, width, least))
    roots = components(reduce(DataFrame.union, edges))
    discard(*edges, *met, near, placed)
    return roots


def near_copies(docs: DataFrame, text: str, key: str, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """``(doc_id, key, root)`` of every row; rows linked as near copies have the same root.  ``key`` is a hash of the text."""
    with brief_shuffles(docs.sparkSession):
        grid = grids(docs.count(), least)
        rows = materialize(hashed(docs, text, key, width, grid.words))
        one, same = F.min(F.struct("doc_id", "key")).alias("one"), [F.min(c).alias(c) for c in ("size", "majority", "embedding")]
        nodes = rows.groupBy("node").agg(one, *same, F.count("*").alias("n_rows"))
        nodes = materialize(nodes.select("node", F.col("one.doc_id").alias("n_id"), F.col("one.key").alias("n_key"), "size", "majority", "embedding", "n_rows"))
        roots = linked_components(docs, nodes.drop("n_rows"), text, key, grid, width, least)
        named = nodes.select("node", "n_rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return split_join(rows.select("doc_id", "key", "node"), named, ["node"], "n_rows", rows.count()).select("doc_id", "key", "root")
