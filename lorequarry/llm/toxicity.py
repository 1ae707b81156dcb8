"""Toxicity by a weighted finite-state pattern grammar.

The lexicon is a transducer from words to symbols: a trie of insult stems whose weights are log-odds
learned from labelled rows, and short lists of threat verbs, announcing verbs, targets, negators and
verbs of reported speech. Four small transducers work on these symbols and are composed into one:
``reported`` marks insults and threats after a verb of speech or inside quotation marks, ``negation``
those shortly after a negator, ``threat`` turns announcement, violence and target into one event, and
``target`` raises an insult next to a person. The composed machine runs over each clause that has an
insult or a threat. A matched clause is of one kind, its pattern (insult, targeted insult, threat) and
its polarity (plain, reported, negated), and as strong as its events of that polarity. A document's
score is a logistic function of what its clauses of each kind weigh. Weights have signs: a clause of a
kind that clean documents have lowers the score.

The grammar also decides what is learned: stems are counted where they are neither negated nor reported.
A stem counts as an insult only if its log-odds are high at the cautious end of what its counts allow.

Learning uses at most TOXIC_ROWS and CLEAN_ROWS labelled rows outside the held-out fold, those with the
smallest digests of their ids; this is the documented bound of the fit. Scoring reads every whole text,
and nothing but the text.

Defined results: a null or empty text has the base score; a very long text is scored whole; a row without
label is scored like any other; several labels of one document count as the highest; of several texts of
one id the one with the least digest is learned from, and all are scored; repeated rows are scored each;
without any label of one class the fixed priors are used; a score of one half is predicted as toxic; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorequarry.llm.common import Scratch, fold_remainder, give_back, keyed_texts, spread, text_batches

FOLDS, HELD_OUT = 5, 0
TOXIC_ROWS, CLEAN_ROWS = 2000, 6000
STEM = range(3, 9)
LEAST_SUPPORT = 3
LEAST_WORTH = 2.5  # log-odds of a stem at the cautious end of its counts
MEMO_WORDS = 100_000
MOST_CLEAN = 0.005  # share of clean rows that an event may occur in

SCHEMA = "doc_id long, score double, predicted int"

# Closed word lists of the grammar, in English, German, French and Spanish.
WORDS = {
    "V": "kill hurt destroy murder beat stab shoot burn strangle töten umbringen schlagen tuer tuerai frapper matar mataré golpear",
    "W": "will shall gonna going werde wirst wollen vais va allons voy vamos",
    "Y": "you your yours yourself u he she they them him her du dich dir ihr euch tu toi te vous votre tú ti usted ustedes vosotros",
    "N": "not never no nor without isn aren wasn weren don doesn didn won nicht kein keine nie niemals pas jamais sans nunca jamás sin",
    "R": "said says say wrote writes called calls quoted reported told claims sagte schrieb nannte dit disait écrit dijo dice escribió llamó",
}
PATTERNS, POLARITIES = ("insult", "targeted", "threat"), ("plain", "reported", "negated")
KINDS = [(p, q) for p in PATTERNS for q in POLARITIES]
THREAT = 5.0  # what a threat weighs beside the learned weights of insults
# of clauses by kind, and the last of the length, against chance events in long texts
PRIOR = np.array([{"plain": {"insult": 2.0, "targeted": 2.4, "threat": 3.0}[p], "reported": -0.3, "negated": -0.5}[q] for p, q in KINDS] + [-0.5])
BASE = -3.0

TOKEN = re.compile(r"[^\W\d_]+")
PIECE = re.compile(r"[^\W\d_]+|[.!?;:|\n]|[\"“”„«»]")
CLAUSE = ".!?;:|\n"
QUOTE = "\"“”„«»"


# ---- transducers --------------------------------------------------------------------------


@dataclass
class Transducer:
    """A deterministic machine: step(state, symbol) gives the next state and the symbol passed on."""

    start: object
    step: Callable[[object, str], tuple[object, str]]
    arcs: dict = field(default_factory=dict)

    def __call__(self, state, symbol: str):
        key = state, symbol
        if key not in self.arcs:
            self.arcs[key] = self.step(state, symbol)
        return self.arcs[key]

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: what this machine passes on is read by the other one."""

        def step(state, symbol):
            mine, passed = self(state[0], symbol)
            theirs, out = other(state[1], passed)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, passed = self(state, s)
            out.append(passed)
        return out


def reported() -> Transducer:
    """State: a verb of speech was seen, inside quotation marks. Marks I and V with r."""

    def step(state, s):
        said, inside = state
        if s == "R":
            return (True, inside), s
        if s == "Q":
            return (said, not inside), s
        return state, s + "r" if s in "IV" and (said or inside) else s

    return Transducer((False, False), step)


def negation(reach: int = 3) -> Transducer:
    """State: words left that a negator reaches. Marks I and V with n."""

    def step(left, s):
        if s == "N":
            return reach, s
        return max(0, left - 1), s + "n" if s[0] in "IV" and left else s

    return Transducer(0, step)


def threat(reach: int = 4) -> Transducer:
    """State: words left after an announcement, and the mark of a violent verb that waits for its target."""

    def step(state, s):
        left, verb = state
        if s == "W":
            return (reach, ""), s
        if s[0] == "V" and left:
            return (reach, s), "O"
        if s == "Y" and verb and left:
            return (0, ""), "T" + verb[1:]
        return (max(0, left - 1), verb if left > 1 else ""), s

    return Transducer((0, ""), step)


def target(reach: int = 2) -> Transducer:
    """State: words since a person. Marks an insult with y if a person is near before it."""

    def step(left, s):
        if s == "Y":
            return reach + 1, s
        return max(0, left - 1), s + "y" if s[0] == "I" and left else s

    return Transducer(0, step)


def grammar() -> Transducer:
    return reduce(Transducer.__rshift__, (reported(), negation(), threat(), target()))


def event(symbol: str) -> tuple[str, str] | None:
    """Pattern and polarity of a symbol that left the grammar, if it is an event."""
    if symbol[0] not in "IT":
        return None
    pattern = "threat" if symbol[0] == "T" else "targeted" if "y" in symbol else "insult"
    return pattern, "negated" if "n" in symbol else "reported" if "r" in symbol else "plain"


def clause_kind(events: list[tuple[tuple[str, str], float]]) -> tuple[int, float] | None:
    """The kind of a clause by its events, what is meant before what is reported or denied and the gravest pattern
    first, and how much its events of that polarity weigh."""
    if not events:
        return None
    polarity = min((q for (_, q), _ in events), key=POLARITIES.index)
    own = [(p, w) for (p, q), w in events if q == polarity]
    pattern = max((p for p, _ in own), key=PATTERNS.index)
    return KINDS.index((pattern, polarity)), sum(w for _, w in own)


def clauses_of(low: str, look: Callable[[str], tuple[str, float]]) -> Iterator[list[tuple[str, str, float]]]:
    """Word, symbol and weight of all pieces of a text in lower case, clause by clause."""
    clause: list[tuple[str, str, float]] = []
    for m in PIECE.finditer(low):
        piece = m[0]
        if piece in CLAUSE:
            yield clause
            clause = []
        else:
            clause.append((piece, *(("Q", 0.0) if piece in QUOTE else look(piece))))
    yield clause


# ---- lexicon ------------------------------------------------------------------------------


class Lexicon:
    """Words to symbols; of an insult also its weight. A stem accepts any continuation."""

    def __init__(self, stems: dict[str, float]):
        self.trie: dict = {}
        for stem, weight in stems.items():
            node = self.trie
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = weight
        # one pair for all words of a symbol, so that the memo holds little more than the words
        self.other = ("O", 0.0)
        self.closed = {w: (s, 0.0) for s, words in WORDS.items() for w in words.split()}
        self.memo: dict[str, tuple[str, float]] = {}

    def insult(self, word: str) -> float:
        node, best = self.trie, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                break
            best = max(best, node.get("", 0.0))
        return best

    def __getitem__(self, word: str) -> tuple[str, float]:
        got = self.memo.get(word)
        if got is None:
            weight = self.insult(word)
            got = ("I", weight) if weight else self.closed.get(word, self.other)
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = got
        return got


def stem_events(words: dict[str, int]) -> set[tuple[str, int]]:
    """(stem, 1) for each stem of a text's words, and (stem, 2) for those that occur at least twice."""
    times: Counter[str] = Counter()
    for w, n in words.items():
        for k in STEM:
            if len(w) < k:
                break
            times[w[:k]] += n
    return {(s, 1) for s in times} | {(s, 2) for s, n in times.items() if n > 1}


def worth(n: int, against: int, toxic: int, clean: int) -> float:
    """Log-odds of an event that n toxic and some clean rows have, two deviations to the cautious side of both counts."""
    few, many = max(0.0, n - 2 * np.sqrt(n)), against + 2 * np.sqrt(against) + 1
    return float(np.log((few + 0.5) / (toxic + 1)) - np.log((many + 0.5) / (clean + 1)))


def cover(events: list[tuple[str, int]], weights: list[float], against: list[int], rows: list[list[int]]) -> dict[str, float]:
    """Greedy cover of the toxic rows by stems whose presence, or whose repetition, is rare in clean rows.
    rows: which events each toxic row has. Weights are shared among the occurrences that an event asks for."""
    seen = Counter(e for r in rows for e in r)
    found: dict[str, float] = {}
    waiting = rows
    while waiting:
        now = Counter(e for r in waiting for e in r)
        best = max(now, key=lambda e: (now[e] * weights[e], -events[e][1], len(events[e][0]), events[e]), default=None)
        if best is None or now[best] < max(LEAST_SUPPORT, 0.02 * len(rows)):  # fewer may share it by chance, as copies or wrong labels
            break
        stem, times = events[best]
        found[stem] = max(found.get(stem, 0.0), weights[best] / times)
        waiting = [r for r in waiting if best not in r]
    # further stems, as sure as any and never seen in a clean row
    sure = max(LEAST_SUPPORT + 2, 0.02 * len(rows))
    for e in sorted(seen, key=lambda e: (-seen[e], -len(events[e][0]), events[e])):
        stem, times = events[e]
        if times == 1 and seen[e] >= sure and not against[e] and not any(stem.startswith(f) or f.startswith(stem) for f in found):
            found[stem] = weights[e]
    return found


def plain_words(text: str, closed: dict[str, tuple[str, float]], machine: Transducer) -> Counter[str]:
    """Words of no list that the grammar would leave plain if they were insults."""
    found: Counter[str] = Counter()
    for clause in clauses_of(text.lower(), lambda w: closed.get(w, ("I", 0.0))):
        for (word, symbol, _), passed in zip(clause, machine.run([s for _, s, _ in clause]), strict=True):
            if symbol == "I" and event(passed)[1] == "plain":
                found[word] += 1
    return found


def _event_reader() -> Callable[[str | None], set[tuple[str, int]]]:
    closed, machine = Lexicon({}).closed, grammar()
    return lambda text: stem_events(plain_words(text or "", closed, machine))


def learn_stems(sample: DataFrame, scratch: Scratch) -> dict[str, float]:
    """sample: text, toxic. The executors count; the driver sees counts of events with enough support, and of each
    toxic row only the events that clean rows hardly have."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        return {}

    def support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int]] = Counter()
        events_of = _event_reader()
        for batch in batches:
            for text in batch.column(0):
                counts.update(events_of(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["stem", "times", "n"])

    shape = "stem string, times int, n long"
    counted = sample.where("toxic = 1").select("text").mapInArrow(support, shape).groupBy("stem", "times").agg(F.sum("n").alias("n"))
    known = counted.where(F.col("n") >= LEAST_SUPPORT).collect()  # at most what TOXIC_ROWS texts have in common
    numbers = {(r["stem"], r["times"]): i for i, r in enumerate(known)}
    shared = sample.sparkSession.sparkContext.broadcast(numbers)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events_of = _event_reader()
        for batch in batches:
            ids = [[i for e in events_of(t.as_py()) if (i := shared.value.get(e)) is not None] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column(1)], ["ids", "toxic"])

    numbered = scratch.written(sample.select("text", "toxic").mapInArrow(number, "ids array<int>, toxic int"), "events")
    against = [0] * len(known)
    for r in numbered.where("toxic <> 1").select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect():
        against[r["id"]] = r["n"]
    weights = [worth(r["n"], a, toxic, clean) for r, a in zip(known, against, strict=True)]
    good = [i for i, w in enumerate(weights) if w >= LEAST_WORTH and against[i] <= MOST_CLEAN * clean]
    kept = sample.sparkSession.sparkContext.broadcast(set(good))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[i for i in r if i in kept.value] for r in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["ids"])

    rows = [r["ids"] for r in numbered.where("toxic = 1").select("ids").mapInArrow(thin, "ids array<int>").collect()]
    return cover([(r["stem"], r["times"]) for r in known], weights, against, rows)


@dataclass
class Model:
    stems: dict[str, float]
    weights: np.ndarray
    base: float

    def __post_init__(self):
        self.lexicon, self.machine = Lexicon(self.stems), grammar()

    def features(self, text: str) -> np.ndarray | None:
        """What the matched clauses of each kind weigh, and the length; None without a clause that could match."""
        low = text.lower()
        look = self.lexicon.__getitem__
        kinds = {look(w)[0] for w in set(TOKEN.findall(low))}
        if "I" not in kinds and "V" not in kinds:
            return None
        out = np.zeros(len(PRIOR))
        for clause in clauses_of(low, look):
            symbols = [s for _, s, _ in clause]
            if "I" in symbols or "V" in symbols:
                passed = self.machine.run(symbols)
                events = [(e, w if p[0] == "I" else THREAT) for (_, _, w), p in zip(clause, passed, strict=True) if (e := event(p))]
                if kind := clause_kind(events):
                    out[kind[0]] += kind[1]
        out[-1] = max(1, low.count(" ") / 100) - 1 if out.any() else 0
        return out

    def score(self, text: str) -> float:
        f = self.features(text)
        z = self.base + (float(self.weights @ np.log1p(f)) if f is not None else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def calibrate(features: list[np.ndarray | None], labels: list[bool]) -> tuple[np.ndarray, float]:
    """Logistic weights of clauses by kind and of the length, drawn towards PRIOR, and the base; length never raises a score."""
    x = np.array([np.log1p(f) if f is not None else np.zeros(len(PRIOR)) for f in features]).reshape(-1, len(PRIOR))
    y = np.array(labels, float)
    w, b = PRIOR.copy(), BASE
    if len(y) == 0:
        return w, b
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        w = w - 0.5 * (x.T @ (p - y) / len(y) + 0.0005 * (w - PRIOR))
        w[-1] = min(0, w[-1])
        b -= 0.5 * (float((p - y).mean()) + 0.0005 * (b - BASE))
    return w, min(b, -1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows outside the held-out fold are read."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .where(fold_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    by = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.where("toxic = 1").orderBy(*by).limit(TOXIC_ROWS).unionByName(known.where("toxic = 0").orderBy(*by).limit(CLEAN_ROWS))
    # at most TOXIC_ROWS + CLEAN_ROWS ids
    least = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    found = keyed_texts(docs).join(F.broadcast(chosen), "doc_id").withColumn("n", F.row_number().over(least)).where("n = 1").drop("n")
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        return _fitted(scratch.written(found, "sample"), scratch)


def _fitted(sample: DataFrame, scratch: Scratch) -> Model:
    model = Model(learn_stems(sample, scratch), PRIOR, BASE)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [model.features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() if x is not None else None for x in f], pa.list_(pa.float64())), batch.column(1)], ["f", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(measured, "f array<double>, toxic int").collect()
    weights, base = calibrate([np.array(r["f"]) if r["f"] is not None else None for r in got], [r["toxic"] == 1 for r in got])
    return Model(model.stems, weights, base)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""
    stems, weights, base = model.stems, model.weights, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(stems, weights, base)
        for keys, texts in text_batches(batches):
            scores = [own.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return spread(keyed_texts(docs)).mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    stems, weights, base = model.stems, model.weights, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(stems, weights, base)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([own.score(t.as_py() or "") < 0.5 for t in texts], pa.bool_()))
        own.lexicon.memo.clear()
        give_back()

    return spread(docs).mapInArrow(run, docs.schema)
