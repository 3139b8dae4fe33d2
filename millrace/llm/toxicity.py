"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Each clause (text between `.!?;:,` and line ends) that holds an insult or threat word is tagged word
by word and run through one transducer, composed of five. The insult transducer emits the weight of
an insult, more for one that follows another closely; the threat transducer emits a threat verb's
weight, little unless a modal or first person comes before it; the target transducer raises what is
aimed at a person or at "this ...", and adds to an insult when its target follows; the negation
transducer lowers what stands within its scope; the reported-speech transducer lowers what stands
behind a verb of speech or in quotes, to the end of the clause. A clause's score is the weight of its
path: the sum of what is emitted. A document's score is logistic in the strongest clause and in the
sum over clauses, both by logarithm.

Word weights are log odds from labelled rows: fixed seed words start with a prior; further words and
word beginnings are induced where they mark toxic rows, and hardly any others, in several different
contexts. Some mark a row only when they occur twice or three times; each occurrence then weighs its
part, so that it is the paths' sum that decides.

Learning takes labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_rows`` of
them and ``max_bytes`` of text, in order of a hash of the id. Scores depend on the text alone.

Defined cases: null counts as empty; texts without a matched clause get the score of the bias
alone; several labels of one document count by their largest; null labels are left out; without
labelled rows of both classes the priors stand; repeated rows stay repeated; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, drop_staged, hash_sample, held_out, sliced, stage, table

INSULTS = "idiot moron loser scum trash stupid pathetic worthless disgusting clown dumb jerk fool imbecile bastard".split()
THREATS = "kill hurt destroy shoot stab burn beat smash strangle murder".split()
MODALS = frozenset("i we will gonna shall must should going ll".split())
TARGETS = frozenset("you your youre u he she they him her them his their this these such".split())
NEGATIONS = frozenset("not no never nobody isnt arent wasnt dont doesnt without nicht kein keine pas jamais nunca".split())
REPORTS = frozenset("said says say wrote writes claimed claims called reported quoted alleged sagte dit dijo".split())
WORD = re.compile(r"[^\W\d_]+|[\"“”«»]")
BREAK = re.compile(r"[.!?;:,\n]")
SEED = 4.0  # log odds of a seed word before any label is seen
STEM = range(4, 10)  # letters of an induced word beginning
CONTEXTS = 6  # different words before it, among toxic rows, that an induced entry needs
RATIO = 30  # times as common among toxic rows as among others, at least
PURE, BROAD = 300, 0.05  # the same for entries that are taken whatever rows others cover, and their least share of toxic rows
COST, LEAST = 3, 3  # toxic rows that one other row outweighs; toxic rows that an entry must add
TIMES = 3  # an entry may ask for so many occurrences at most


class Transducer:
    """States from 0; ``step[state, symbol]`` is (next state, factor, bonus), else stay with factor 1 and no bonus.

    A symbol's weight is emitted times the factor; a bonus is the part of the last weight emitted that is added.
    """

    def __init__(self, step: dict[tuple, tuple]) -> None:
        self.step = step

    def go(self, state, symbol: str) -> tuple:
        return self.step.get((state, symbol), (state, 1.0, 0.0))


class Composed(Transducer):
    """Transducers composed over one tape: factors multiply, bonuses add. Steps are built when first taken."""

    def __init__(self, *parts: Transducer) -> None:
        super().__init__({})
        self.parts = parts
        self.start = (0,) * len(parts)

    def go(self, state, symbol: str) -> tuple:
        known = self.step.get((state, symbol))
        if known is None:
            steps = [p.go(s, symbol) for p, s in zip(self.parts, state)]
            known = self.step[state, symbol] = (tuple(s for s, _, _ in steps), math.prod(f for _, f, _ in steps), sum(b for _, _, b in steps))
        return known

    def weight(self, tape: Iterable[tuple[str, float]]) -> float:
        """What the path over (symbol, weight) emits."""
        state, total, last = self.start, 0.0, 0.0
        for symbol, weight in tape:
            state, factor, bonus = self.go(state, symbol)
            total += bonus * last
            if weight:
                last = weight * factor
                total += last
        return total


EVERY = "ITMYNRQO"  # insult, threat, modal, target, negation, report, quote, other


def countdown(openers: str, length: int, inside: dict[str, tuple[float, float]], outside: dict[str, float] | None = None) -> Transducer:
    """From an opener on, for ``length`` words, the symbols in ``inside`` get their factor and bonus; those in ``outside`` a factor elsewhere."""
    step = {}
    for s in range(length + 1):
        for symbol in EVERY:
            factor, bonus = inside.get(symbol, (1.0, 0.0)) if s else ((outside or {}).get(symbol, 1.0), 0.0)
            step[s, symbol] = (length if symbol in openers else max(0, s - 1), factor, bonus)
    return Transducer(step)


def grammar() -> Composed:
    insult = countdown("I", 4, {"I": (1.25, 0.0)})  # "you stupid idiot"
    threat = countdown("M", 4, {}, {"T": 0.1})
    aimed = countdown("Y", 5, {"I": (1.3, 0.0), "T": (1.3, 0.0)})
    told = countdown("IT", 3, {"Y": (1.0, 0.3)})  # "idiot, that is what you are" has its target behind it
    negation = countdown("N", 3, {"I": (0.35, 0.0), "T": (0.35, 0.0)})
    half = (1, 0.5, 0.0)
    report = Transducer({(0, "R"): (1, 1.0, 0.0), (0, "Q"): (2, 1.0, 0.0), (2, "Q"): (0, 1.0, 0.0), (1, "I"): half, (1, "T"): half, (2, "I"): (2, 0.5, 0.0), (2, "T"): (2, 0.5, 0.0)})
    return Composed(insult, threat, aimed, told, negation, report)


class Model:
    """Lexicon, grammar and the logistic weights of (1, log of the strongest clause, log of the sum)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: Iterable[float] = (-7.0, 3.0, 2.0)) -> None:
        self.words, self.stems = words, stems
        self.weights = tuple(float(w) for w in weights)

    def ready(self) -> Model:
        if not hasattr(self, "grammar"):
            self.grammar = grammar()
            self.triggers = ahocorasick.Automaton()
            for w in {*self.words, *self.stems, *THREATS}:
                self.triggers.add_word(w, len(w))
            self.triggers.make_automaton()
        return self

    def __getstate__(self) -> tuple:
        return self.words, self.stems, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.words, self.stems, self.weights = state

    def tag(self, word: str) -> tuple[str, float]:
        w = self.words.get(word, 0.0)
        for n in STEM:
            w = max(w, self.stems.get(word[:n], 0.0))
        if w > 0:
            return "I", w
        if word in THREATS:
            return "T", SEED
        for symbol, held in (("M", MODALS), ("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
            if word in held:
                return symbol, 0.0
        return ("Q" if word in '"“”«»' else "O"), 0.0

    def clause(self, clause: str) -> float:
        """The weight of the path over the words of a clause."""
        return self.grammar.weight([self.tag(w) for w in WORD.findall(clause)])

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses, in lower case, that hold an insult or threat word; each is read once, whatever its length."""
        low = text.lower()
        done, breaks, stop = 0, BREAK.finditer(low), -1
        for end, size in self.triggers.iter(low):
            at = end - size + 1
            if at < done or at and low[at - 1].isalpha():
                continue
            while stop < at:  # the break behind the word; the one before it begins the clause
                done = stop + 1
                m = next(breaks, None)
                stop = m.start() if m else len(low)
            yield low[done:stop]
            done = stop

    def features(self, text: str) -> tuple[float, float]:
        """Logarithms of the strongest clause and of the sum over matched clauses."""
        scores = [self.clause(c) for c in self.clauses(text)]
        return math.log1p(max(scores, default=0.0)), math.log1p(sum(scores))

    def score(self, text: str) -> float:
        top, total = self.features(text)
        b, v, u = self.weights
        z = b + v * top + u * total
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _keys(word: str) -> Iterator[str]:
    """The word with a ``$``, and its beginnings."""
    if len(word) >= STEM[0]:
        yield f"{word}$"
        for k in STEM:
            if k <= len(word):
                yield word[:k]


def _induce(texts: list[str], toxic: list[int]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with their log odds, for each occurrence.

    An entry is a key and a least number of occurrences. First come all that are ``PURE`` times as common
    among toxic rows and hold ``BROAD`` of these, the shortest beginning of each; then greedily what covers the most toxic rows that
    none covers yet, less ``COST`` for each other row.
    """
    n = [max(1, len(toxic) - sum(toxic)), max(1, sum(toxic))]
    often: Counter[str] = Counter()  # toxic rows of each key; only keys of several rows are looked at more closely
    for text, y in zip(texts, toxic):
        if y:
            often.update({k for w in set(WORD.findall(text.lower())) for k in _keys(w)})
    several = {k for k, v in often.items() if v >= CONTEXTS}
    del often
    of_word: dict[str, tuple[str, ...]] = {}  # of a word, its keys among these
    others: Counter[tuple[str, int]] = Counter()
    rows: dict[tuple[str, int], set[int]] = defaultdict(set)
    contexts: dict[str, set[str]] = defaultdict(set)
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        found: Counter[str] = Counter()
        for w, many in Counter(words).items():
            keys = of_word.get(w)
            if keys is None:
                keys = of_word[w] = tuple(k for k in _keys(w) if k in several)
            for k in keys:
                found[k] += many
        for key, many in found.items():
            for m in range(1, min(TIMES, many) + 1):
                if toxic[i]:
                    rows[key, m].add(i)
                else:
                    others[key, m] += 1
        if toxic[i]:
            for prev, w in zip(["", *words], words):
                for k in of_word[w]:
                    contexts[k].add(prev)
    rows = {k: v for k, v in rows.items() if len(contexts[k[0]]) >= CONTEXTS and len(v) * n[0] >= RATIO * others[k] * n[1]}
    odds = {k: math.log((len(v) + 0.2) / n[1]) - math.log((others[k] + 0.2) / n[0]) for k, v in rows.items()}
    chosen: list[tuple[str, int]] = []
    for key, m in sorted(rows, key=lambda k: (k[1], k[0][-1] == "$", len(k[0]), k[0])):
        if m == 1 and len(rows[key, m]) >= max(CONTEXTS, BROAD * n[1]) and len(rows[key, m]) * n[0] >= PURE * others[key, m] * n[1] and not any((key[:k], 1) in chosen for k in STEM):
            chosen.append((key, m))
    covered = set().union(*(rows.pop(k) for k in chosen))
    while rows:
        gain, _, _, entry = max((len(v - covered) - COST * others[k], -k[1], -len(k[0]), k) for k, v in rows.items())
        if gain < LEAST:
            break
        covered |= rows.pop(entry)
        chosen.append(entry)
    each: dict[str, float] = {}
    for key, m in chosen:
        each[key] = max(each.get(key, 0.0), odds[key, m] / m)
    words = {w: SEED for w in INSULTS} | {k[:-1]: v for k, v in each.items() if k[-1] == "$"}
    return words, {k: v for k, v in each.items() if k[-1] != "$"}


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Newton steps for logistic regression with a Gaussian prior around ``prior``."""
    w = prior.astype(float).copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text",
             max_bytes: int = 64_000_000) -> tuple[list[str], list[int]]:
    """Training rows in order of a hash of their id, at most ``max_rows`` and ``max_bytes`` of text: texts and labels 0 or 1."""
    d = F.col(id_col)
    own = (labels.where(d.isNotNull() & F.col(label).isNotNull() & ~held_out(d, 5, 0)).groupBy(d.alias("_id"))
           .agg((F.max(label) > 0).cast("int").alias("_y")))
    h, size = F.xxhash64("_id"), F.coalesce(F.octet_length("text"), F.lit(0))
    rows = stage(docs.select(d.alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(hash_sample(own, "_id", max_rows), F.col("doc_id") == F.col("_id"))
                 .select("text", "_y", h.alias("h"), size.alias("size"), F.xxhash64("text").alias("th")), "labelled")
    order = ["h", "th", "size", "_y"]
    sizes = [r.size for r in rows.orderBy(*order).limit(max_rows).select("size").collect()]
    n = int(np.searchsorted(np.cumsum(sizes), max_bytes, "right"))
    out = rows.orderBy(*order).limit(n).select("text", "_y").collect()
    drop_staged(rows)
    return [r.text or "" for r in out], [r._y for r in out]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, label: str = "toxic") -> Model:
    texts, y = labelled(docs, labels, label, max_rows)
    if len(set(y)) < 2:
        return Model({w: SEED for w in INSULTS}, {})
    model = Model(*_induce(texts, y)).ready()
    x = np.array([(1.0, *model.features(t)) for t in texts])
    model.weights = tuple(float(w) for w in logistic(x, np.array(y, float), np.array(model.weights), 0.1))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row; the model has a bounded size and is broadcast."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def one(b: pa.RecordBatch) -> dict:
        m = held.value.ready()
        return {"doc_id": b.column(0), "score": pa.array([m.score(t) for t in b.column(1).fill_null("").to_pylist()], pa.float64())}

    return arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double", ["doc_id", "text"])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; the model is learnt as for the query."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        m = held.value.ready()
        for b in sliced(batches):
            keep = pa.array([m.score(t) < 0.5 for t in b.column(at).fill_null("").to_pylist()], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, schema)
