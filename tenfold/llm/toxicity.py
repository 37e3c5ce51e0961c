"""Toxicity by a weighted finite-state pattern grammar.

Words enter as symbols: insult, threat, target, negation, report or other.  Letter-to-letter
transducers mark insults and threats in turn: those that follow a negation closely, those that follow
reported speech or a mention ("the word ...") in their clause, those that follow a target, and, read
from the clause's end, those that stand closely before one.  The first three are composed into one
deterministic machine; with the last, a clause puts out matched symbols such as "insult, targeted, not
negated, not reported".  A text's score is logistic in the weighted matches of its clauses.  An insult
in a clause without a target is a match of its own kind, by itself too weak for a verdict; only
labelled rows can give it more weight.

The insult lexicon beyond a few fixed words, and all weights, are learnt from a bounded sample of
labelled rows.  Lexicon entries are whole words or beginnings of words, so inflected forms that were
never labelled match too.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenfold.llm import common

#: At most so many labelled rows, those of smallest hash, fit the model.
SAMPLE = 20_000
#: A row is toxic from this score on.
THRESHOLD = 0.3
#: Letters of learnt beginnings of words, texts that must hold one, and its least log odds.
SHORTEST, LONGEST, LEAST_TEXTS, LEAST_ODDS = 3, 10, 3, 3.0
#: A longer word can't be an entry as a whole; its beginnings can.
WHOLE = 64
#: Bytes of text that are Python strings at once, but for a longer single text.
AT_ONCE = 1 << 20

WORD = re.compile(r"\w+(?:['’]\w+)*")
CLAUSE = re.compile(r"[^.!?;\n]+")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
FIXED = {
    INSULT: "idiot idiots moron morons imbecile loser scum trash worthless stupid disgusting pathetic vermin dummkopf abschaum widerlich connard abruti ordure basura escoria imbécil".split(),
    THREAT: "kill hurt destroy murder strangle töten umbringen vernichten tuer détruire matar destruir".split(),
    TARGET: "you your you're ur he she they them dich dein ihr euch tu toi vous ton tú vosotros usted ustedes".split(),
    NEGATION: "not never no isn't aren't don't won't nicht kein keine nie pas jamais nunca jamás".split(),
    REPORT: "said says wrote writes called claimed quoted reported word term sagte schrieb wort dit écrit mot dijo escribió palabra".split(),
}


class Transducer(NamedTuple):
    """A letter-to-letter machine: (state, symbol) to (state, symbol); a symbol without an arc passes and `step` moves the state."""

    start: object
    step: object

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this puts out, `other` reads."""

        def step(state, symbol):
            a, seen = self.step(state[0], symbol)
            b, out = other.step(state[1], seen)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def compiled(self, symbols: list) -> tuple[list[dict], list]:
        """Arcs of all states that can be reached, state 0 first: symbol to (state, symbol put out)."""
        names, arcs, outs, todo = {self.start: 0}, [], [], [self.start]
        while todo:
            state, own = todo.pop(0), {}
            for s in symbols:
                to, out = self.step(state, s)
                if to not in names:
                    names[to] = len(names)
                    todo.append(to)
                own[s] = (names[to], out)
                outs.append(out)
            arcs.append(own)
        return arcs, sorted(set(outs))


def _marker(trigger: str, mark: str, reach: int | None) -> Transducer:
    """Marks insults and threats after `trigger`: within so many words, or to the clause's end."""

    def step(left, symbol):
        kind = symbol[0]
        if kind in (INSULT, THREAT) and left and mark not in symbol:
            symbol = (*symbol, mark)
        left = reach or 1 if kind == trigger else max(0, left - 1) if reach else left
        return left, symbol

    return Transducer(0, step)


SYMBOLS = [(k,) for k in (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER)]
ARCS, _MARKED = _marker(NEGATION, "negated", 3).then(_marker(REPORT, "reported", None)).then(_marker(TARGET, "targeted", None)).compiled(SYMBOLS)
#: Reads what the first machine puts out, from a clause's end to its start.
BACK, _BOTH = _marker(TARGET, "targeted", 3).compiled(_MARKED)
MATCHES = [m for m in _BOTH if m[0] in (INSULT, THREAT)]
_INDEX = {m: i for i, m in enumerate(MATCHES)}


class Lexicon:
    """Finds words by whole words and beginnings of words, and the matches of their clauses."""

    def __init__(self, entries: dict[str, float]):
        """`entries`: weight of each insult; one that ends in "$" is a whole word."""
        self.entries = entries
        self.function = {w: (k,) for k in (TARGET, NEGATION, REPORT) for w in FIXED[k]}
        self.found = ahocorasick.Automaton()
        own = {w + "$": ((k,), 1.0) for k in (INSULT, THREAT) for w in FIXED[k]}
        own |= {w: ((INSULT,), x) for w, x in entries.items()}
        same: dict[str, list[tuple]] = defaultdict(list)  # a whole word and a beginning may have the same letters
        for w, (symbol, weight) in own.items():
            same[w.rstrip("$")].append((w[-1] == "$", symbol, weight))
        for letters, several in same.items():
            self.found.add_word(letters, (len(letters), several))
        self.found.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.entries,)

    def hits(self, text: str) -> dict[int, tuple]:
        """Start of each insult or threat in a lower-case text, and its symbol and weight."""
        out = {}
        for last, (n, several) in self.found.iter(text):
            start = last + 1 - n
            if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
                continue
            for whole, symbol, weight in several:
                if not (whole and text[last + 1 : last + 2].isalnum()) and (start not in out or out[start][1] < weight):
                    out[start] = (symbol, weight)
        return out

    def matches(self, text: str) -> np.ndarray:
        """Weighted matches of all clauses by kind."""
        text = text.lower()
        out, hits = np.zeros(len(MATCHES)), self.hits(text)
        if not hits:
            return out
        ends = -1
        for at in sorted(hits):
            if at < ends:
                continue
            begin = max(text.rfind(c, 0, at) for c in ".!?;\n") + 1
            ends = CLAUSE.search(text, at).end()
            state, marked = 0, []
            for w in WORD.finditer(text, begin, ends):
                # after an apostrophe a word may have more hits
                own = [hits[i] for i in range(w.start(), w.end()) if i in hits] or [(self.function.get(w[0].replace("’", "'"), (OTHER,)), 0.0)]
                for symbol, weight in own:
                    state, put = ARCS[state][symbol]
                    marked.append((put, weight))
            state = 0
            for symbol, weight in reversed(marked):
                state, put = BACK[state][symbol]
                if weight and put in _INDEX:
                    out[_INDEX[put]] += weight
        return out


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return _logistic(self.bias + float(np.log1p(self.lexicon.matches(text or "")) @ self.weights))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
        if len(w) <= WHOLE:
            out.add(w + "$")
    return out


def _strings(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts (null: empty) of runs of rows of bounded bytes."""
    for a, b in common.slices(common.utf8(column)[1], AT_ONCE):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def _counted(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """gram and the texts that hold it, each partition's counted first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for _, texts_ in _strings(batch.column(0)):
                for t in texts_:
                    n.update(g for g in _grams(t) if wanted is None or g in wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "n"])

    return texts.select("text").mapInArrow(rows, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _good(toxic: dict[str, int], other: dict[str, int], n_toxic: int, n_other: int) -> dict[str, float]:
    """Grams of high odds."""
    odds = {g: math.log((t + 0.5) / (n_toxic + 1)) - math.log((other.get(g, 0) + 0.5) / (n_other + 1)) for g, t in toxic.items()}
    return {g: x for g, x in odds.items() if x >= LEAST_ODDS}


def _entries(texts: list[set[str]], odds: dict[str, float]) -> dict[str, float]:
    """Entries that between them explain the toxic texts, most first; a text once explained (a copy's, say) speaks for no other entry.

    Of a whole word and its beginnings that explain as much at the same odds, the longest beginning is the entry.
    """
    gain = Counter(g for t in texts for g in t)
    holders: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        for g in t:
            holders[g].append(i)
    left, out = set(range(len(texts))), {}
    ranked = sorted(gain, key=lambda g: (len(g), g), reverse=True)
    todo = [(-gain[g], i) for i, g in enumerate(ranked)]  # gains only fall, so an entry of the heap is at best what it says
    heapq.heapify(todo)
    while todo:
        was, i = heapq.heappop(todo)
        g = ranked[i]
        if gain[g] != -was:
            heapq.heappush(todo, (-gain[g], i))
            continue
        if gain[g] < max(2, len(texts) // 500):
            break
        if g[-1] == "$":
            begins = (g[:n] for n in range(min(LONGEST, len(g) - 1), SHORTEST - 1, -1))
            g = next((b for b in begins if gain[b] == gain[g] and odds[b] == odds[g]), g)
        out[g] = min(4.0, odds[g] / LEAST_ODDS)
        for i in [i for i in holders[g] if i in left]:
            left.discard(i)
            gain.subtract(texts[i])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of labels.toxic from the labelled rows outside the held-out quarter, at most `sample` of them.

    A doc_id labelled twice counts as toxic if either label does; null labels do not count.  Without
    any toxic sample the fixed words alone are the lexicon, with weights of their own.
    """
    spark = docs.sparkSession
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out("doc_id"))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = common.written(common.text_of(docs).join(F.broadcast(rows), "doc_id").select("text", "toxic"), "toxicity-sample")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_TEXTS, n_toxic // 400)
    seen = _counted(texts.filter("toxic = 1"), None).filter(F.col("n") >= least)
    toxic = {r.gram: r.n for r in seen.collect()}
    wanted = set(toxic)
    other = {r.gram: r.n for r in _counted(texts.filter("toxic = 0"), wanted).collect()} if toxic else {}
    odds = _good(toxic, other, n_toxic, n_other)
    good = set(odds)

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sorted(_grams(t) & good) for _, texts_ in _strings(batch.column(0)) for t in texts_]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.string()))], names=["grams"])

    explained = texts.filter("toxic = 1").select("text").distinct().mapInArrow(holds, "grams array<string>")
    lexicon = Lexicon(_entries([set(r.grams) for r in explained.collect()] if odds else [], odds))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [lexicon.matches(t).tolist() for _, texts_ in _strings(batch.column(0)) for t in texts_]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    found = texts.select("text", F.col("toxic").cast("int")).mapInArrow(features, "y int, x array<double>")
    grouped = found.groupBy("y", "x").count().collect()
    return Model(lexicon, *_regression(grouped))


def _regression(rows: list) -> tuple[np.ndarray, float]:
    """Logistic weights, kept from falling below a small positive one so that no match lowers a score."""
    k = len(MATCHES)
    prior = np.array([0.4 if {"negated", "reported"} & set(m) else 2.5 if "targeted" in m else 1.0 for m in MATCHES])
    w, bias = prior.copy(), -2.5
    if rows:
        y = np.array([float(r.y) for r in rows])
        n = np.array([float(r["count"]) for r in rows])
        x = np.log1p(np.array([list(r.x) for r in rows]))
        x = np.column_stack([x, np.ones(len(x))])
        theta, mean, loose = np.append(w, bias), np.append(prior, -2.5), np.append(np.full(k, 0.05), 0.01)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            gradient = x.T @ (n * (p - y)) + loose * (theta - mean)
            curve = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(loose)
            step = np.linalg.solve(curve, gradient)
            theta = theta - np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        w, bias = np.maximum(theta[:k], 0.05), float(theta[k])
    return w, bias


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.3) of every whole text; null and empty texts match nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.score(t) for _, texts in _strings(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64()), pa.array([int(s >= THRESHOLD) for s in x], pa.int32())], names=["doc_id", "score", "predicted"])

    return common.text_of(docs).mapInArrow(rows, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns as they are; null and empty texts match nothing, so all or none of them stay."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            for a, texts in _strings(text):
                yield batch.slice(a, len(texts)).filter(pa.array([model.score(t) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", _held_out("doc_id").alias("held_out"), "score", "predicted")
