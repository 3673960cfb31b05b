"""Language-model scores from a hashed maximum-entropy model.

The next word is predicted in two factors, each a softmax over hashed features
of the context: first its class, from the last word, a skip over it, the
classes of the last three words and pairs of them; then its place in the class,
from the class with the last word, with a skip over it, and with the last two
classes.  A class has ``SLOTS`` places: one for each of its most frequent words
and one for all its others, which share it by add-half counts.  Classes are
hashed two-byte endings, one class for the end of a text, and one that repeats
the last word; a repeated word may come by either way and both chances count,
so probabilities add up to one.

Three steps, none of which brings a vocabulary to one place:

1. Each task writes its texts as blocks: compressed local word numbers, and the
   hash, class and training count of each local word.  Texts are split into
   words once, and a frequent word is one entry a block however often it occurs.
2. Blocks send their entries, packed by range of the hash, to as many shards
   as keep a shard near ``_SHARD`` entries.  A shard adds its counts and sends
   each block its totals back, in the block's own order, and names the most
   frequent words of each class.
3. Both factors are trained by diagonally scaled gradient steps, observed less
   drawn counts summed over another share of the texts until every training text was used once,
   and blocks are scored in numpy batches.

Tasks add gradients in chunks of fixed size, so what a reducer and the driver
hold depends on the model's size and not on the corpus.

Held-out rows (``crc32(doc_id) mod 5 = 1``) train nothing; a row with a null id
trains.  A null text is empty and has one token, its end.  Repeated rows count
as often as they occur; further columns are ignored; an empty table gives an
empty result.  Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, in_arrow, materialize, table, words

CLASSES, FEATURES, BITS = 32, 7, 14
#: Places in a class, as many as classes, so that one matrix holds the weights of both factors.
SLOTS, WORD_FEATURES = CLASSES, 3
TABLE = 1 << BITS
#: Rows of the matrix: features of classes, features of places, and a row for each class.
ROWS = 2 * TABLE + CLASSES
ROUNDS, RATE, PRIOR = 4, 0.2, 3.0
END, REPEAT = 0, 1
_END_WORD = b" "
#: A block ends after so many words, distinct words or texts.
_BLOCK_TOKENS, _BLOCK_WORDS, _BLOCK_DOCS = 2_000_000, 150_000, 10_000
#: Tokens whose features stand in memory at once, and those of one matrix of chances.
_SLICE, _BATCH, _SHARD = 1 << 17, 1 << 14, 1_000_000
#: Rows of the matrix in a chunk, and blocks that a task adds up before it sends chunks.
_CHUNK, _BLOCKS_A_TASK = 32, 8
_SALTS = np.random.default_rng(5).integers(1, 1 << 62, FEATURES + WORD_FEATURES, np.uint64) | np.uint64(1)

_BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, n long, tokens binary, classes binary, hashes binary, trained binary"


def class_of(word: bytes) -> int:
    return END if word == _END_WORD else 2 + xxhash.xxh64_intdigest(word[-2:], 7) % (CLASSES - 2)


def _packed(x: np.ndarray) -> bytes:
    """Compressed, byte plane by byte plane."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of ``docs``.  Local words are numbered by falling frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        local: defaultdict[bytes, int] = defaultdict()
        local.default_factory = local.__len__
        ids, held, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(texts)
            order = np.argsort(-np.bincount(tokens, minlength=len(local)), kind="stable")
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order), dtype=np.int32)
            tokens = number[tokens]
            train = np.repeat(~np.array(held, bool), [len(t) for t in texts])
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in local], np.uint64)[order]
            classes = np.array([class_of(w) for w in local], np.uint8)[order]
            trained = np.bincount(tokens[train], minlength=len(local)).astype(np.int32)
            lists = [[(part << 32) + done], [ids], [held], [[len(t) for t in texts]], [len(local)]]
            lists += [[_packed(x)] for x in (tokens, classes, hashes, trained)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(lists, kinds)], names=[f.split()[0] for f in _BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, out, text in zip(*[c.to_pylist() for c in batch.columns]):
                w = words(text or "")
                w.append(_END_WORD)
                texts.append(np.array([local[x] for x in w], np.int32))
                ids.append(doc_id)
                held.append(out)
                size += len(w)
                if size >= _BLOCK_TOKENS or len(local) >= _BLOCK_WORDS or len(ids) >= _BLOCK_DOCS:
                    yield block()
                    done += 1
                    local.clear()
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield block()

    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 1, F.lit(False))
    return in_arrow(docs.select(F.col("doc_id").cast("long"), held_out.alias("held"), text), run, _BLOCKS)


class Block:
    """What a row of ``encode`` says, as arrays."""

    def __init__(self, row: dict):
        self.ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.tokens = _unpacked(row["tokens"], int(self.sizes.sum()), np.int32)
        self.classes = _unpacked(row["classes"], row["n"], np.uint8).astype(np.int64)
        self.hashes = _unpacked(row["hashes"], row["n"], np.uint64)
        self.codes = (self.hashes >> np.uint64(32)).astype(np.uint32)


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _places_in_text(sizes: np.ndarray) -> np.ndarray:
    """For every token of concatenated texts how many come before it in its text."""
    return np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(_starts(sizes).astype(np.int32), sizes)


def _slices(tokens: np.ndarray, place: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, int]]:
    """Parts of concatenated texts, each after the tokens (their number comes last) that its context reaches back to."""
    for at in range(0, len(tokens), _SLICE):
        back = min(at, 3)
        own = slice(at - back, at + _SLICE)
        yield slice(at, at + _SLICE), tokens[own], place[own], back


def _hashed(key: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (key + np.uint64(1)) * salt
    x ^= x >> np.uint64(29)
    return (x * salt) >> np.uint64(64 - BITS)


def _context(codes: np.ndarray, classes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the matrix that say a token's class, and those that say its place in that class.

    ``place`` is each token's in its text.
    """
    n = len(codes)
    h, c = [], []
    for lag in (1, 2, 3):
        there = place >= lag
        before = np.maximum(np.arange(n) - lag, 0)
        h.append(np.where(there, codes[before].astype(np.uint64) + np.uint64(1), np.uint64(0)))
        c.append(np.where(there, classes[before], CLASSES).astype(np.uint64))
    k, own = np.uint64(CLASSES + 1), classes.astype(np.uint64)
    keys = (np.zeros(n, np.uint64), h[0], h[1], c[0], c[0] * k + c[1], c[1] * k + c[2], (c[0] * k + c[1]) * k + c[2])
    word_keys = (h[0] * k + own, h[1] * k + own, (c[0] * k + c[1]) * k + own)
    by_class, by_place = np.empty((n, FEATURES), np.uint16), np.empty((n, WORD_FEATURES + 1), np.uint16)
    for f, key in enumerate(keys):
        by_class[:, f] = _hashed(key, _SALTS[f])
    for f, key in enumerate(word_keys):
        by_place[:, f] = TABLE + _hashed(key, _SALTS[FEATURES + f])
    by_place[:, WORD_FEATURES] = 2 * TABLE + classes
    return by_class, by_place


_ONES, _UPTO = np.ones(CLASSES, np.float32), np.triu(np.ones((CLASSES, CLASSES), np.float32))


def _chances(weights: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Chances of each class, or of each place in a class, for every token.

    Weights are steps of at most three times ``RATE`` from logarithms of shares, so no exponential overflows.
    """
    z = np.take(weights, places[:, 0], axis=0)
    row = np.empty_like(z)
    for f in range(1, places.shape[1]):
        np.take(weights, places[:, f], axis=0, out=row, mode="clip")
        z += row
    np.exp(z, out=z)
    z /= (z @ _ONES)[:, None]
    return z


def _drawn(weights: np.ndarray, places: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One draw for each token from the model's chances."""
    out = np.empty(len(places), np.int64)
    for at in range(0, len(places), _BATCH):
        p = _chances(weights, places[at : at + _BATCH])
        out[at : at + len(p)] = ((p @ _UPTO) < rng.random(len(p), np.float32)[:, None]) @ _ONES
    return np.minimum(out, CLASSES - 1)


def _repeats(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a token is that before it in its text."""
    return np.r_[False, tokens[1:] == tokens[:-1]] & (place > 0)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


def _add(counts: np.ndarray, places: np.ndarray, target: np.ndarray) -> None:
    """Count each feature of some tokens with their targets."""
    for f in range(places.shape[1] if len(places) else 0):
        base = int(places[:, f].min())
        n = np.bincount((places[:, f].astype(np.int64) - base) * CLASSES + target)
        counts.reshape(-1)[base * CLASSES : base * CLASSES + len(n)] += n


@dataclass(frozen=True)
class Heads:
    """The words that have a place of their own, by hash."""

    hashes: np.ndarray
    slots: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in its class; 0 is that of all without one."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.slots[at], 0)


def gradient(blocks: DataFrame, weights: np.ndarray, heads: Heads, turn: int, rounds: int, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Observed counts of each feature, by class or place, over the training texts whose turn it is, and counts that the model draws.

    A draw for each token stands for the model's chances, whose sum it is in
    expectation: the gradient is unbiased, and costs a count instead of a row
    of chances for every feature.  Draws are seeded by block and turn, so a
    task that runs again sends the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, meant = np.zeros((ROWS, CLASSES), np.int64), np.zeros((ROWS, CLASSES), np.int64)
        for row in (r for batch in batches for r in batch.to_pylist()):
            b, rng = Block(row), np.random.default_rng((row["block"], turn))
            slots = heads.of(b.hashes)
            use = ~b.held & (np.arange(len(b.held)) % rounds == turn)
            all_tokens, place = b.tokens[np.repeat(use, b.sizes)], _places_in_text(b.sizes[use])
            for _, tokens, at_place, back in _slices(all_tokens, place):
                classes, again = b.classes[tokens], _repeats(tokens, at_place)[back:]
                by_class, by_place = (x[back:] for x in _context(b.codes[tokens], classes, at_place))
                _add(seen, by_class, np.where(again, REPEAT, classes[back:]))
                _add(meant, by_class, _drawn(weights, by_class, rng))
                by_place = by_place[~again]
                _add(seen, by_place, slots[tokens[back:]][~again])
                _add(meant, by_place, _drawn(weights, by_place, rng))
        part = TaskContext.get().partitionId()
        for k in range(ROWS // _CHUNK):
            own = [x[k * _CHUNK : (k + 1) * _CHUNK] for x in (seen, meant)]
            if own[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.int32()), *(pa.array([_packed(x.ravel())], pa.binary()) for x in own)], names=["chunk", "part", "seen", "meant"])

    def add(group: pa.Table) -> pa.Table:
        total = [sum(_unpacked(x, _CHUNK * CLASSES, np.int64) for x in group.column(c).to_pylist()) for c in ("seen", "meant")]
        return pa.table({"chunk": group.column("chunk")[:1], **{c: pa.array([_packed(x)], pa.binary()) for c, x in zip(("seen", "meant"), total)}})

    light = blocks.select("block", "doc_ids", "held", "sizes", "n", "tokens", "classes", "hashes")
    parts = in_arrow(light.coalesce(tasks), run, "chunk int, part int, seen binary, meant binary")
    out = np.zeros((2, ROWS, CLASSES))
    for r in parts.groupBy("chunk").applyInArrow(add, "chunk int, seen binary, meant binary").collect():
        out[:, r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = [_unpacked(x, _CHUNK * CLASSES, np.int64).reshape(_CHUNK, CLASSES) for x in (r.seen, r.meant)]
    return out[0], out[1]


def start(totals: np.ndarray, head_counts: np.ndarray) -> np.ndarray:
    """Weights that give classes, and places in them, their shares of the training tokens.

    ``totals`` by class are (tokens, words); ``head_counts[class, slot]`` are those of words with a place.
    """
    weights = np.zeros((ROWS, CLASSES), np.float32)
    always = _context(np.zeros(1, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int32))[0][0, 0]
    shares = totals[:, 0] + 1e-6
    weights[always] = np.log(shares / shares.sum())
    weights[always, REPEAT] = np.log(0.01)
    own = head_counts.astype(float)
    own[:, 0] = totals[:, 0] - own[:, 1:].sum(axis=1) + 0.5
    with np.errstate(divide="ignore"):
        weights[2 * TABLE :] = np.maximum(np.log(own / own.sum(axis=1, keepdims=True)), -40)
    return weights


def train(blocks: DataFrame, weights: np.ndarray, heads: Heads, tasks: int, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after one pass over the training texts, in ``rounds`` parts.

    A step follows the gradient, observed less drawn count, on the scale of a log ratio.
    """
    for k in range(rounds):
        seen, meant = gradient(blocks, weights, heads, k, rounds, tasks)
        step = np.log((seen + PRIOR) / (meant + PRIOR))
        weights = weights + (RATE * np.clip(step, -3, 3)).astype(np.float32)
    return weights


def counted(blocks: DataFrame, shards: int) -> DataFrame:
    """``(block, shard, known, tokens, words, heads)``: for each block and shard the training counts of the block's words there.

    Rows with a null block have a shard's tokens and words by class instead, and the most frequent words of each class.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            hashes, trained, classes = (_unpacked(row[c], row["n"], k) for c, k in (("hashes", np.uint64), ("trained", np.int32), ("classes", np.uint8)))
            shard = _shard_of(hashes >> np.uint64(32), shards)
            order = np.argsort(shard, kind="stable")
            ordered = shard[order]
            ends = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
            for first, last in zip(ends, ends[1:]):
                own, k = order[first:last], int(ordered[first])
                packed = [pa.array([x[own].tobytes()], pa.binary()) for x in (hashes, trained, classes)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([row["block"]], pa.int64()), *packed], names=["shard", "block", "hashes", "trained", "classes"])

    def add(group: pa.Table) -> pa.Table:
        hashes, trained, classes = ([np.frombuffer(x, k) for x in group.column(c).to_pylist()] for c, k in (("hashes", np.uint64), ("trained", np.int32), ("classes", np.uint8)))
        every, first, back = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(trained), minlength=len(every)).astype(np.int64)
        kind = np.concatenate(classes)[first]
        tokens = np.bincount(kind, weights=n, minlength=CLASSES).astype(np.int64)
        known = np.bincount(kind, weights=n > 0, minlength=CLASSES).astype(np.int64)
        order = np.lexsort((every, -n, kind))
        rank = np.arange(len(order)) - np.searchsorted(kind[order], kind[order])
        top = order[(rank < SLOTS - 1) & (n[order] > 0)]
        heads = [{"class": int(kind[i]), "n": int(n[i]), "hash": int(every[i : i + 1].view(np.int64)[0])} for i in top]
        ends = np.cumsum([len(h) for h in hashes])[:-1]
        out = [_packed(x) for x in np.split(n[back], ends)]
        shard, blocks = group.column("shard")[0].as_py(), group.column("block").to_pylist()
        return pa.table({
            "block": pa.array([*blocks, None], pa.int64()), "shard": pa.array([shard] * (len(out) + 1), pa.int32()), "known": pa.array([*out, None], pa.binary()),
            "tokens": pa.array([*[None] * len(out), tokens.tolist()], pa.list_(pa.int64())), "words": pa.array([*[None] * len(out), known.tolist()], pa.list_(pa.int64())),
            "heads": pa.array([*[None] * len(out), heads], pa.list_(pa.struct([("class", pa.int32()), ("n", pa.int64()), ("hash", pa.int64())]))),
        })

    sent = in_arrow(blocks.select("block", "n", "hashes", "trained", "classes"), send, "shard int, block long, hashes binary, trained binary, classes binary")
    return sent.groupBy("shard").applyInArrow(add, "block long, shard int, known binary, tokens array<long>, words array<long>, heads array<struct<class:int,n:long,hash:long>>")


@dataclass(frozen=True)
class Model:
    """The weights of both factors, the words with a place, and the counts that the other words share by."""

    weights: np.ndarray
    heads: Heads
    totals: np.ndarray
    rest: np.ndarray

    def scores(self, b: Block, counts: np.ndarray) -> np.ndarray:
        """The log10 chance of every token of a block; ``counts`` are the training counts of its words."""
        by_share = (self.totals[:, 0] + 0.5) / (self.totals[:, 0] + 0.5).sum()
        slots = self.heads.of(b.hashes)
        shared = np.where(slots > 0, 1.0, (counts + 0.5) / (self.rest[b.classes, 0] + 0.5 * (self.rest[b.classes, 1] + 1)))
        out = np.empty(len(b.tokens))
        for part, tokens, place, back in _slices(b.tokens, _places_in_text(b.sizes)):
            classes = b.classes[tokens]
            by_class, by_place = (x[back:] for x in _context(b.codes[tokens], classes, place))
            again, tokens, classes, place = _repeats(tokens, place)[back:], tokens[back:], classes[back:], place[back:]
            for k in range(0, len(tokens), _BATCH):
                own = slice(k, k + _BATCH)
                p, rows = _chances(self.weights, by_class[own]), np.arange(len(tokens[own]))
                # Where a text begins there is nothing to repeat: that chance goes to the words by class.
                chance = p[rows, classes[own]] + np.where(place[own] == 0, p[:, REPEAT] * by_share[classes[own]], 0)
                chance *= _chances(self.weights, by_place[own])[rows, slots[tokens[own]]] * shared[tokens[own]]
                out[part][own] = np.log10(chance + np.where(again[own], p[:, REPEAT], 0))
        return out


def score(blocks: DataFrame, replies: DataFrame, model: Model, shards: int, tasks: int) -> DataFrame:
    """Scores of every text.  ``replies`` are those of ``counted``; blocks meet them in ``tasks`` tasks."""
    n_train, n_words = (int(x) for x in model.totals.sum(axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            b = Block(row)
            shard = _shard_of(b.codes, shards)
            order = np.argsort(shard, kind="stable")
            c, ordered = np.zeros(row["n"]), shard[order]
            for reply in row["replies"]:
                own = order[np.searchsorted(ordered, reply["shard"]) : np.searchsorted(ordered, reply["shard"], "right")]
                c[own] = _unpacked(reply["known"], len(own), np.int64)
            base = np.log10((c + 0.5) / (n_train + 0.5 * (n_words + 1)))
            starts, tokens = _starts(b.sizes), b.tokens
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.sizes), pa.array(add((c > 0)[tokens].astype(np.int64))), pa.array(np.full(len(b.ids), n_train)), pa.array(add(base[tokens])), pa.array(add(model.scores(b, c)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    light = blocks.select("block", "doc_ids", "held", "sizes", "n", "tokens", "classes", "hashes").repartition(tasks, "block")
    own = replies.where("block IS NOT NULL").repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("shard", "known")).alias("replies"))
    return in_arrow(light.join(own, "block"), run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame, DataFrame, int, int]:
    """The model, and for ``score`` the blocks, replies, number of shards and of tasks."""
    blocks = materialize(encode(docs, text))
    n, entries = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-entries // _SHARD))
    replies = materialize(counted(blocks, shards))
    summed = replies.where("block IS NULL")
    totals = np.zeros((CLASSES, 2))
    by_class = summed.select(F.posexplode(F.arrays_zip("tokens", "words")).alias("class", "x"))
    for r in by_class.groupBy("class").agg(F.sum("x.tokens").alias("tokens"), F.sum("x.words").alias("words")).collect():
        totals[r["class"]] = r.tokens, r.words
    ranked = summed.select(F.explode("heads").alias("x")).select("x.*").withColumn("slot", F.row_number().over(W.partitionBy("class").orderBy(F.desc("n"), "hash")))
    found = sorted(((r.hash % (1 << 64), r["class"], r.slot, r.n) for r in ranked.where(F.col("slot") < SLOTS).collect()))
    hashes, kinds, slots, counts = (np.array(x, t) for x, t in zip(zip(*found) if found else [()] * 4, (np.uint64, np.int64, np.int64, np.int64)))
    own = np.zeros((CLASSES, SLOTS), np.int64)
    own[kinds, slots] = counts
    rest = totals - np.c_[own.sum(axis=1), (own > 0).sum(axis=1)]
    heads = Heads(hashes, slots)
    weights = train(blocks, start(totals, own), heads, max(1, -(-n // _BLOCKS_A_TASK)))
    return Model(weights, heads, totals, rest), blocks, replies, shards, max(1, -(-n // 4))


def scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""
    model, *rest = fit(docs, text)
    return score(*rest[:2], model, *rest[2:])


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those that are not held out."""
    return scores(table(spark, sf_dir, "documents"))
