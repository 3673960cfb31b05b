"""Toxicity by a weighted finite-state pattern grammar.

Six transducers work one behind the other.  ``Lexicon`` writes a letter and a
strength for each word: insult, stem, threat, target, negation, report.  Four
more are composed into one machine over the letters of a clause:

* ``negating`` marks insults and threats within ``REACH`` words after a negation;
* ``reporting`` marks those within twice that after a verb of saying;
* ``aiming`` marks those with a target at most ``REACH`` words before or after
  them.  A target that follows is promised first and must then come, so the
  machine is nondeterministic;
* ``matching`` accepts the patterns of ``PATTERNS`` and writes their names.

An arc's weight times the strength of its word adds to a path, and a clause is
read by its heaviest path.  The last transducer, ``repeating``, reads the names
that a text's clauses write, and lets an insult or stem that no pattern holds
count only if another came before it.  So no word is scored by itself: a lone
insult, without target, negation, report or a second one, changes no score.
A score is a logistic function of the totals of each name and the length.

The lexicon is learned: words, and stems of ``STEM`` or more letters with any
ending, whose log odds between toxic and other labelled texts are at least
``LEAST_ODDS``.  Lexicon and curve are fitted on at most ``SAMPLE`` labelled
rows of each part, those of smallest id hash, and never on held-out rows
(``crc32(doc_id) mod 4 = 2``): parts 0 and 1 teach the lexicon, part 3 the
curve.  Scoring reads every text whole and only its text.  A clause of over
``CUT`` characters is cut at a space.

A null or empty text gets the score of a text without matches.  A row with a
null id is scored and not held out.  Repeated rows repeat results, further
columns are ignored, an empty table gives none, and without labels every score
is ``UNTAUGHT``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, discard, in_arrow, materialize, table
from tessera.llm.quality import labelled_sample
from tessera.llm.regression import fit_logistic, sigmoid

SAMPLE = 20_000
STEM, LONGEST_STEM = 5, 10
LEAST_SEEN, LEAST_ODDS = 3, 1.5
THRESHOLD, UNTAUGHT = 0.3, 0.05
#: Words that a negation or target reaches, and those between two insults or stems that belong together.
REACH, CHAIN = 4, 8
CUT = 1 << 20

_PIECE = re.compile(r"\w+|[.!?;:\n]")
_GAP = re.compile(r"\s")

# What the lexicon writes.
FILLER, END, INSULT, STEMMED, THREAT, TARGET, NEGATION, REPORT = ". / i s t y n q".split()
WORDS = {
    THREAT: "kill hurt beat destroy burn shoot stab töte tötet schlage zerstöre tuer frapper détruire matar matarte golpear destruir",
    TARGET: "you your yours he she they them him her du dich dir ihr euch sie er tu te toi vous il elle ils tú usted ustedes él ella ellos ellas",
    NEGATION: "not no never none nicht kein keine nie pas ne jamais aucun nunca ni ningún",
    REPORT: "said says say quoted called wrote sagte sagt nannte schrieb dit disait appelle écrit dijo dice llamó escribió",
}
#: Names of patterns and the weights of their arcs; a word's strength multiplies them.
PATTERNS = {"attack": 4.0, "menace": 4.0, "chain": 3.0, "quoted": 1.0, "denied": 0.5, "cluster": 1.0}
#: Names for what no pattern holds, and for that beside another.
LONE, STRAY = "lone", "stray"
AGAIN = {LONE: "again", STRAY: "stray again"}
NAMES = [*PATTERNS, *AGAIN.values()]

Arcs = tuple[tuple[str, float, object], ...]


class Machine:
    """A weighted letter transducer, its arcs computed as they are asked for and kept.

    ``step(state, letter)`` has arcs ``(letter out, weight, next state)``.  States are finite, and so is what is kept.
    """

    def __init__(self, start, step: Callable[[object, str], Iterable], final: Callable[[object], bool] = lambda state: True):
        self.start, self.step, self.final, self.kept = start, step, final, {}

    def arcs(self, state, letter: str) -> Arcs:
        at = state, letter
        if at not in self.kept:
            self.kept[at] = tuple(self.step(state, letter))
        return self.kept[at]

    def then(self, other: Machine) -> Machine:
        """The composition: ``other`` reads what this one writes."""

        def step(state, letter):
            for mid, w, p in self.arcs(state[0], letter):
                for out, v, q in other.arcs(state[1], mid):
                    yield out, w + v, (p, q)

        return Machine((self.start, other.start), step, lambda state: self.final(state[0]) and other.final(state[1]))

    def best(self, letters: Iterable[tuple[str, float]]) -> tuple[float, list[tuple[str, float]]]:
        """The heaviest path over ``(letter, strength)``: its weight, and what it writes."""
        now = {self.start: (0.0, None)}
        for letter, strength in letters:
            new: dict = {}
            for state, (weight, path) in now.items():
                for out, arc, after in self.arcs(state, letter):
                    total = weight + arc * strength
                    if after not in new or total > new[after][0]:
                        new[after] = total, path if out == FILLER else (path, out, strength)
            now = new
        weight, path = max((x for state, x in now.items() if self.final(state)), key=lambda x: x[0])
        out = []
        while path:
            path, name, strength = path
            out.append((name, strength))
        return weight, out[::-1]


def negating() -> Machine:
    """The state counts the words that a negation still reaches."""

    def step(left, x):
        if x == NEGATION:
            return ((FILLER, 0.0, REACH),)
        return ((x.upper() if left and x in (INSULT, THREAT) else x, 0.0, max(0, left - 1)),)

    return Machine(0, step)


def reporting() -> Machine:
    def step(left, x):
        if x == REPORT:
            return ((FILLER, 0.0, 2 * REACH),)
        return (("r" + x if left and x in (INSULT, THREAT) else x, 0.0, max(0, left - 1)),)

    return Machine(0, step)


def aiming() -> Machine:
    """State ``k`` > 0: a target came and reaches ``k`` words on.  State ``-k``: one is promised within ``k`` words."""

    def step(left, x):
        if x == TARGET:
            return ((FILLER, 0.0, REACH),)
        after = left - 1 if left > 0 else left + 1 if left < 0 else 0
        if left < 0 and after == 0:
            return ()  # the promise is broken
        if x[-1].lower() not in (INSULT, THREAT):
            return ((x, 0.0, after),)
        if left:
            return ((x + ">", 0.0, after),)
        return ((x, 0.0, 0), (x + ">", 0.0, -REACH))

    return Machine(0, step, lambda left: left >= 0)


def matching() -> Machine:
    """The state counts the words that an insult, and a stem, still reaches."""

    def step(state, x):
        insult, stem = (max(0, k - 1) for k in state)
        aimed, x = x.endswith(">"), x.removesuffix(">")
        after = (CHAIN if x[-1].lower() == INSULT else insult, CHAIN if x == STEMMED else stem)
        if x == STEMMED:
            name = "cluster" if any(state) else STRAY
        elif x == INSULT:
            name = "attack" if aimed else "chain" if state[0] else LONE
        elif x == THREAT:
            name = "menace" if aimed else FILLER
        elif x in ("r" + INSULT, "r" + THREAT):
            name = "quoted" if aimed or x[1] == INSULT else FILLER
        elif x in (INSULT.upper(), THREAT.upper()):
            name = "denied" if aimed or x == INSULT.upper() else FILLER
        else:
            name = FILLER
        return ((name, PATTERNS.get(name, 0.0), after),)

    return Machine((0, 0), step)


def repeating() -> Machine:
    """Over the names of a whole text; the state says whether an insult, and a stem, has been."""

    def step(state, name):
        insult, stem = state
        if name == LONE:
            return ((AGAIN[LONE] if insult else FILLER, 0.0, (True, stem)),)
        if name == STRAY:
            return ((AGAIN[STRAY] if stem else FILLER, 0.0, (insult, True)),)
        return ((name, 0.0, (insult or name != "cluster", stem or name == "cluster")),)

    return Machine((False, False), step)


CLAUSE = negating().then(reporting()).then(aiming()).then(matching())
TEXT = repeating()


class Lexicon(dict):
    """The first transducer, of one state: a word's letter and strength.  Words it has looked up it keeps, up to a bound."""

    MOST = 400_000
    FIXED = {w: (letter, 1.0) for letter, words in WORDS.items() for w in words.split()} | {x: (END, 0.0) for x in ".!?;:\n"}

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)

    def __missing__(self, word: str) -> tuple[str, float] | None:
        if len(self) > self.MOST:
            self.clear()
        if word in self.words:
            out = INSULT, self.words[word]
        elif word in self.FIXED:
            out = self.FIXED[word]
        else:
            best = max((self.stems.get(word[:k], 0.0) for k in range(STEM, min(len(word), LONGEST_STEM) + 1)), default=0.0)
            out = (STEMMED, best) if best else None
        self[word] = out
        return out


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about ``CUT`` characters that end where a clause ends, or at a space if none does for as long."""
    at = 0
    while at < len(text):
        end = at + CUT
        if end < len(text):
            near = max(text.rfind(x, at + 1, end) for x in ".!?;:\n")
            gap = None if near > 0 else _GAP.search(text, end)
            end = near if near > 0 else gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def clauses(text: str, lexicon: Lexicon) -> Iterator[list[tuple[str, float]]]:
    """The letters of each clause with an insult, stem or threat, without outer fillers.

    Longer gaps than every reach are as good as endless and are kept at that length.
    """
    longest = max(2 * REACH, CHAIN) + 1
    for part in _parts(text):
        found = [lexicon[w] for w in _PIECE.findall(part.lower())]
        out, last, hit = [], 0, False
        for k in [k for k, x in enumerate(found) if x is not None]:
            letter, strength = found[k]
            if letter == END:
                if hit:
                    yield out
                out, hit = [], False
                continue
            if out:
                out += [(FILLER, 0.0)] * min(longest, k - last - 1)
            out.append((letter, strength))
            last, hit = k, hit or letter in (INSULT, STEMMED, THREAT)
        if hit:
            yield out


def names(text: str | None, lexicon: Lexicon) -> list[tuple[str, float]]:
    """The names that a whole text's clauses write, repeated insults and stems among them, with their strengths."""
    out, state = [], TEXT.start
    for clause in clauses(text or "", lexicon):
        for name, strength in CLAUSE.best(clause)[1]:
            ((name, _, state),) = TEXT.arcs(state, name)
            if name != FILLER:
                out.append((name, strength))
    return out


FEATURES = len(NAMES) + 3
_PLACES = {name: k for k, name in enumerate(NAMES)}


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Totals of each name over a whole text, the strongest, their number, softened; and the length."""
    out = np.zeros(FEATURES)
    for name, strength in names(text, lexicon):
        out[_PLACES[name]] += strength
        out[-3] = max(out[-3], strength)
        out[-2] += 1
    out[-1] = len(text or "")
    return np.log1p(out)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    curve: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, FEATURES)
        return sigmoid(x @ self.curve[:-1] + self.curve[-1])


def _entries(text: str | None) -> set[str]:
    """The words of a text, and its stems marked by an asterisk."""
    found = {w for part in _parts(text or "") for w in _PIECE.findall(part.lower()) if len(w) > 2}
    return found | {w[:k] + "*" for w in found for k in range(STEM, min(len(w), LONGEST_STEM) + 1)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic, and other, texts of a task have each entry, in parts of bounded size."""
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

    def sums() -> pa.RecordBatch:
        every = list(seen[0].keys() | seen[1].keys())
        counts = [pa.array([c[e] for e in every], pa.int64()) for c in (seen[1], seen[0])]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *counts], names=["entry", "toxic", "other"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[label == 1].update(_entries(text))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield sums()
    yield sums()


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that tell toxic texts of ``sample(label, text)`` from others.

    What a few chance texts would show is not evidence: a count must also beat its expectation clearly.
    """
    total = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    entries = in_arrow(sample.select("label", "text"), _counted, "entry string, toxic long, other long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("b") + 0.5) / (good + 1))
    clear = F.col("a") - (F.col("b") + 0.5) * (bad / (good + 1)) > 2 * F.sqrt("a")
    sure = {r.entry: r.odds for r in entries.withColumn("odds", odds).where((F.col("a") >= LEAST_SEEN) & (F.col("odds") >= LEAST_ODDS) & clear).select("entry", "odds").collect()}
    return Lexicon({e: w for e, w in sure.items() if not e.endswith("*")}, {e[:-1]: w for e, w in sure.items() if e.endswith("*")})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    part = bucket_of(F.col("doc_id"), 4)
    first = materialize(labelled_sample(docs, labels, "toxic", sample, part < 2).select("label", "text"))
    lexicon, cols = learn_lexicon(first), [f"x{k}" for k in range(FEATURES)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(FEATURES))], names=["label", *cols])

    second = materialize(labelled_sample(docs, labels, "toxic", sample, part == 3).select("label", "text"))
    seen = in_arrow(second, measure, "label int, " + ", ".join(f"{n} double" for n in cols)).toPandas().sort_values([*cols, "label"])
    discard(first, second)
    curve = fit_logistic(seen[cols].to_numpy(), (seen["label"] == 1).to_numpy(float))
    if seen.empty:
        curve[-1] = np.log(UNTAUGHT / (1 - UNTAUGHT))
    return Model(lexicon, curve)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
