"""Language-model scores by online logistic context mixing (operator 3).

A text is its UTF-8 bytes and one end symbol. Symbols are spelled as the binary decisions of a
Huffman code that goes by the symbol before, and each decision is predicted from several contexts
(the last symbols, and what the word has so far), hashed together with the place in the code into
tables of bit counts from the training texts. The predictors' log odds are combined by weights that
a gate selects (place in the code, and whether the two longest contexts are unseen, unsure or sure).
A final adaptive stage corrects the mixed log odds by what decisions of that height turned out to be.
Weights and corrections are refined online within each text, from its first symbols on: after 32, 96,
224 ... symbols, then every 2,048, they take a step along the coding error, from the same start for
every text. A step's symbols are coded with weights that only earlier ones have touched, so the
probabilities are those of a model. Texts of like length are coded side by side, step by step.

A further predictor grows with the corpus: texts are cut by content (after each four words whose hash
has ``CUT`` zero bits) into chunks, and each chunk is looked up behind the four words before it among
the chunks of all training texts, in a table that is never on one machine. What the table has seen c
times of n costs -log2 of (1 - e) c / n, mixed with e times the bits' probability; the chance e of
something new is learnt by the size of n. A training row's own chunks are left out of its counts.

Counting: each task adds up tables over its texts, where symbols that are spelled alike behind the same
slots are counted first and then spelled once, and sends them as compressed blocks; blocks are
summed in two rounds, so no task gets more than about the square root of their number. What is
broadcast has the fixed size of the bit tables; the chunk table has one row for each different chunk.
All training texts shape the code and are counted; a share of the rows, by a hash of id and text, is
counted only after the starting weights have been learnt on it, so that the weights see unseen text.

Base scores: words are the runs `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and an end token; counts are
summed by word hash. The most frequent words, ``frequent`` at most, are broadcast, the
others are joined.

Training texts are those whose crc32(doc_id as text) mod 7 is not 2.

Defined cases: null counts as empty; without training texts all decisions are even and base
scores are zero; repeated rows stay repeated (and count); other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, SPACE, Poly, arrow_map, drop_staged, groups_of, held_out, joined, mix64, stage, symbols, table, text_bytes, word_bounds

END = 256
ORDERS = (3, 5, 0)  # 0: back to where the word began
TABLE_BITS = (20, 21, 21)  # slots of each context's table, as powers of two
BASE = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS]))).astype(np.int64)
SHIFTS = [np.uint64(sum(TABLE_BITS[:k])) for k in range(len(TABLE_BITS))]  # where a slot stands among packed ones
BIT = np.uint64(63)  # the outcome's place among them
BLOCK = 1 << 16  # slots of a block that is sent
COUNTED = 1_000_000  # bytes whose outcomes are counted at once
SPELLED = 1 << 17  # more than there are spellings: 257 symbols in 258 codes
GROUP = 120_000  # bytes handled at once
LEARN = 60_000  # bytes after which the starting weights move on while they are learnt
EARLY = np.array([32 * (2**k - 1) for k in range(1, 8)])  # symbols after which the first refinements come
STEP = 2048  # symbols between later ones
DEPTHS, SURE = 3, 30  # sure: log odds of two and more
UNIT = 15  # stored steps of one in log odds
GATES = 9 * DEPTHS
HEIGHTS = 33  # classes of the mixed log odds, half a unit each, in the final stage
ROW = max(GATES, HEIGHTS)  # what a text has in the arrays of weights and of corrections
RATE, RATE_FINAL, LEAST_MISS = 0.3, 0.5, 0.05
CUT = 5  # zero bits of a hash of four words behind which a chunk ends: 32 words on average
AHEAD = 4  # words that a chunk is looked up by
MERGED = 1 << 20  # different words that a task holds while it counts
START = 0  # what stands before a text's first chunk


def _packed(hashes) -> np.ndarray:
    """The top bits of one hash for each context, as many as its table has, side by side."""
    out = np.uint64(0)
    for h, bits, shift in zip(hashes, TABLE_BITS, SHIFTS):
        out = out | (h >> np.uint64(64 - bits)) << shift
    return out


def _slots(packed: np.ndarray, k: int) -> np.ndarray:
    """What ``_packed`` holds for context k; of hashes combined by exclusive or, the slots are those of the packed ones combined."""
    out = packed >> SHIFTS[k]
    out &= np.uint64((1 << TABLE_BITS[k]) - 1)
    return out.view(np.int64)


def _paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """The decisions (node, outcome) that spell each symbol in a Huffman code for these counts."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    fresh, up = 257, {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[2]], up[b[2]] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    out = []
    for s in range(257):
        path = []
        while s in up:
            s, bit = up[s]
            path.append((s, bit))
        out.append(path[::-1])
    return out


class Code:
    """Huffman codes over bytes and the end symbol, one for each frequent symbol before and one for all others.

    ``counts[a, b]``: how often b follows a, the end symbol standing before a text's first. The decisions of
    all codes are flat arrays; those of code k and symbol s begin at ``start[257 * k + s]``.
    """

    def __init__(self, counts: np.ndarray, least: int = 200) -> None:
        own = np.flatnonzero(counts.sum(axis=1) >= least)
        self.which = np.zeros(257, np.int32)
        self.which[own] = np.arange(1, len(own) + 1)
        nodes, bits, size = [], [], []
        for k, c in enumerate([counts.sum(axis=0), *counts[own]]):
            for path in _paths(c):
                size.append(len(path))
                nodes += [1024 * k + n for n, _ in path]
                bits += [b for _, b in path]
        self.size = np.array(size, np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.spelling = 257 * self.which.astype(np.int64)
        self.nodes, self.bits = mix64(np.array(nodes, np.uint64)), np.array(bits, np.int8)
        self.packed = _packed(self.nodes for _ in ORDERS) | self.bits.astype(np.uint64) << BIT


def pair_counts(texts: list[bytes]) -> np.ndarray:
    """How often each symbol follows each other one, or a text's beginning."""
    total = np.zeros(257 * 257, np.int64)
    for lo, hi in groups_of(texts):
        s, _ = _symbols(texts[lo:hi])
        total += np.bincount(np.concatenate(([END], s[:-1])) * 257 + s, minlength=257 * 257)
    return total.reshape(257, 257)


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols one after the other, and where each text starts (one more at the end)."""
    data, starts = joined(texts)
    out = data.astype(np.int64)
    out[starts[1:] - 1] = END
    return out, starts


_FIRST_STEPS = np.searchsorted(EARLY, np.arange(EARLY[-1] + 1), "right").astype(np.uint16)


def steps_of(place: np.ndarray) -> np.ndarray:
    """How many refinements come before each place of a text."""
    out = _FIRST_STEPS.take(place, mode="clip")
    out += np.maximum((place - EARLY[-1]) // STEP, 0).astype(np.uint16)
    return out


def _length(step: int) -> int:
    """How many symbols a step has of a text that goes on after it."""
    return int(EARLY[step] - (EARLY[step - 1] if step else 0)) if step < len(EARLY) else STEP


class Contexts:
    """Symbols of some texts in order: what stands before each of them (hashes, packed), and how it is spelled."""

    def __init__(self, texts: list[bytes], code: Code) -> None:
        self.s, self.starts = s, starts = _symbols(texts)
        before = np.empty_like(s)
        before[:1], before[1:] = END, s[:-1]  # the end of the text before counts as the symbol before
        self.spelled = code.spelling.take(before)
        self.spelled += s
        self.poly = Poly(symbols(s))
        self.packed = _packed(self._before(order) for order in ORDERS)

    def _before(self, order: int) -> np.ndarray:
        """Hash of the ``order`` symbols before each one, or of those that its text has."""
        n, starts = len(self.s), self.starts[:-1]
        if order:
            out = np.empty(n, np.uint64)
            out[order:] = self.poly.runs(order)
            near = np.minimum(starts[:, None] + np.arange(order), n - 1)
            first = np.repeat(starts, order)
            near = near.ravel()
            own = near < np.repeat(self.starts[1:], order)
            near, first = near[own], first[own]
            out[near] = self.poly.slices(first, near)
            return out
        word = np.zeros(n, np.int64)
        after = np.flatnonzero(SPACE.take(self.s[:-1])) + 1
        word[after] = after
        word[starts] = starts
        return self.poly.slices(np.maximum.accumulate(word, out=word))


def _spelling(spelled: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each symbol's decisions begin (one more at the end), the symbol of each decision, its place in the code."""
    at = np.concatenate(([0], np.cumsum(code.size.take(spelled))))
    start = code.start.take(spelled)
    owner, flat = np.zeros(at[-1], np.int64), np.ones(at[-1], np.int64)
    if len(spelled):
        owner[at[1:-1]] = 1  # each symbol has a decision at least
        flat[0] = start[0]
        flat[at[1:-1]] = start[1:] - start[:-1] - np.diff(at)[:-1] + 1
    return at, np.cumsum(owner, out=owner), np.cumsum(flat, out=flat)


class Decisions(Contexts):
    """All decisions of some texts: slots by context, outcomes, places.

    Symbols are taken step by step, and text by text within a step: those of step k are
    ``order[cuts[k]:cuts[k + 1]]``, symbol ``order[i]`` has the decisions ``at[i]`` to ``at[i + 1]``, and
    decision j belongs to symbol ``order[owner[j]]``. Without steps all symbols are taken in their order.
    """

    def __init__(self, texts: list[bytes], code: Code, stepwise: bool = True) -> None:
        super().__init__(texts, code)
        spelled, packed = self.spelled, self.packed
        if stepwise:
            self.doc = np.repeat(np.arange(len(texts)), np.diff(self.starts))
            self.step = steps_of(np.arange(len(self.s)) - np.repeat(self.starts[:-1], np.diff(self.starts)))
            self.order = np.argsort(self.step, kind="stable")
            self.cuts = np.concatenate(([0], np.cumsum(np.bincount(self.step))))
            spelled, packed = spelled.take(self.order), packed.take(self.order)
        self.at, self.owner, flat = _spelling(spelled, code)
        self.coded = packed.take(self.owner, mode="wrap")  # slots side by side, and the outcome
        self.coded ^= code.packed.take(flat, mode="wrap")

    @property
    def slots(self) -> list[np.ndarray]:
        return [_slots(self.coded, k) for k in range(len(ORDERS))]

    @property
    def bit(self) -> np.ndarray:
        return (self.coded.view(np.int64) < 0).view(np.int8)

    @property
    def depth(self) -> np.ndarray:
        """Each decision's rank in its symbol, the last class standing for all further ones."""
        out = np.full(len(self.owner) + DEPTHS, DEPTHS - 1, np.int8)
        for k in range(DEPTHS - 2, -1, -1):
            out[self.at[:-1] + k] = k  # what belongs to the next symbol is set again by a lower k
        return out[:len(self.owner)]


def gates(depth: np.ndarray, long: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Place in the code, and whether the two longest contexts are unseen, unsure or sure."""
    out = depth * np.int8(9)
    for x, n in ((long, np.int8(3)), (word, np.int8(1))):
        a = np.abs(x)
        out += ((a > 0).view(np.int8) + (a > SURE).view(np.int8)) * n
    return out


def add_counts(texts: list[bytes], code: Code, totals: np.ndarray) -> None:
    """Add the texts' outcomes to ``totals`` (two counts for each slot).

    What follows the same slot of a context and is spelled alike takes the same decisions: it is
    counted first, and its decisions are added at once.
    """
    keys, n = np.empty((len(ORDERS), min(COUNTED, sum(map(len, texts)) + len(texts))), np.int64), 0
    for lo, hi in groups_of(texts, GROUP):
        c = Contexts(texts[lo:hi], code)
        if n and n + len(c.s) > keys.shape[1]:
            _add_alike(keys[:, :n], code, totals)
            n = 0
        if len(c.s) > keys.shape[1]:
            keys = np.empty((len(ORDERS), len(c.s)), np.int64)
        for k, own in enumerate(keys[:, n:n + len(c.s)]):
            np.multiply(_slots(c.packed, k), SPELLED, out=own)
            own += c.spelled
        n += len(c.s)
    if n:
        _add_alike(keys[:, :n], code, totals)


def _add_alike(keys: np.ndarray, code: Code, totals: np.ndarray) -> None:
    """Add the outcomes of symbols, given for each context as slot times ``SPELLED`` and spelling; sorts ``keys``."""
    for k, key in enumerate(keys):
        key.sort()
        ends = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
        key, times = key[ends], np.diff(ends, prepend=-1).astype(totals.dtype)
        _, owner, flat = _spelling(key & SPELLED - 1, code)
        node = code.packed.take(flat, mode="wrap")
        at = (key // SPELLED).take(owner, mode="wrap")
        at ^= _slots(node, k)
        at <<= 1
        at += node.view(np.int64) < 0
        np.add.at(totals[2 * BASE[k]:2 * BASE[k + 1]], at, times.take(owner, mode="wrap"))


def odds_of(totals: np.ndarray) -> np.ndarray:
    """Log odds of each slot in steps of 1 / UNIT; those never seen say nothing."""
    n = totals.reshape(-1, 2).astype(np.float32) + np.float32(0.15)
    return np.clip(np.rint(np.log(n[:, 1] / n[:, 0]) * UNIT), -127, 127).astype(np.int8)


def chunks_of(d: Decisions) -> tuple[np.ndarray, ...]:
    """(doc, first symbol, context, content) of the chunks, in order."""
    data = np.where(d.s == END, 32, d.s).astype(np.uint8)
    lo, hi = word_bounds(data)
    starts = d.starts[:-1]
    cut, context = starts, np.full(len(starts), START, np.uint64)
    if len(lo) >= AHEAD:
        words = Poly(d.poly.slices(lo, hi), 0x9FB21C651E98DF25)
        i = np.arange(len(lo) - AHEAD + 1)
        h = words.slices(i, i + AHEAD)
        ends = (h >> np.uint64(64 - CUT) == 0) & (d.doc[lo[i]] == d.doc[lo[i + AHEAD - 1]])
        cut = np.concatenate((cut, hi[i + AHEAD - 1][ends]))
        context = np.concatenate((context, h[ends] | np.uint64(1)))
        by = np.argsort(cut, kind="stable")
        cut, context = cut[by], context[by]
    return d.doc[cut], cut, context, d.poly.slices(cut, np.append(cut[1:], len(d.s)))


class Mixer:
    """Tables of log odds, and what every text starts with: the gates' weights and the final corrections."""

    def __init__(self, code: Code, odds: np.ndarray, weights: np.ndarray | None = None, final: np.ndarray | None = None) -> None:
        self.code, self.odds = code, odds
        self.weights = np.full((len(ORDERS), GATES), 0.4 / UNIT, np.float32) if weights is None else weights
        self.final = np.zeros(HEIGHTS, np.float32) if final is None else final

    def costs(self, d: Decisions, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural logarithm of each decision's probability; the texts' weights and corrections after their last symbol.

        Without ``ends`` the refinements after each text's last step, which no symbol is coded with, are left out;
        the texts come by falling length then, so those that go on after a step are its first ones.
        """
        n = len(d.starts) - 1
        w, final = np.zeros((len(ORDERS), n, ROW), np.float32), np.zeros((n, ROW), np.float32)
        w[:, :, :GATES], final[:, :HEIGHTS] = self.weights[:, None], self.final
        w, final = w.reshape(len(ORDERS), -1), final.ravel()
        odds = [self.odds[lo:hi].take(x, mode="wrap") for x, lo, hi in zip(d.slots, BASE, BASE[1:])]
        doc = (d.doc * ROW).take(d.order).take(d.owner, mode="wrap")
        gate = gates(d.depth, odds[-2], odds[-1]) + doc
        odds = [x.astype(np.float32) for x in odds]
        sign = d.bit.astype(np.float32)
        sign += sign
        sign -= 1
        out = np.empty(len(sign), np.float32)
        steps = d.step[d.starts[1:] - 1]
        for k in range(len(d.cuts) - 1):
            i, j = d.at[d.cuts[k]], d.at[d.cuts[k + 1]]
            g, own, sg = gate[i:j], [x[i:j] for x in odds], sign[i:j]
            x = w[0].take(g, mode="wrap")
            x *= own[0]
            for c in range(1, len(own)):
                part = w[c].take(g, mode="wrap")
                part *= own[c]
                x += part
            np.clip(x, -8, 8, out=x)
            np.multiply(x, 2, out=part)
            part += 16.5
            cell = part.astype(np.int64)
            cell += doc[i:j]
            x += final.take(cell, mode="wrap", out=part)
            x *= sg
            p = np.negative(x, out=x)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            np.log(p, out=out[i:j])
            on = n if ends else int(np.count_nonzero(steps > k))  # texts that are refined
            if not on or k == len(d.cuts) - 2 and n == 1:
                break
            e = j - i if ends else d.at[d.cuts[k] + on * _length(k)] - i
            miss = np.subtract(1, p[:e], out=part[:e])
            big = np.flatnonzero(miss > LEAST_MISS)
            if not len(big):
                continue
            miss = miss.take(big, mode="wrap")
            miss *= sg.take(big, mode="wrap")
            gb, cb, m = g.take(big, mode="wrap"), cell.take(big, mode="wrap"), on * ROW
            many = np.bincount(gb, minlength=m) + 10.0
            for c in range(len(own)):
                w[c, :m] += (RATE / UNIT**2 * np.bincount(gb, miss * own[c].take(big, mode="wrap"), m) / many).astype(np.float32)
            final[:m] += (RATE_FINAL * np.bincount(cb, miss, m) / (np.bincount(cb, minlength=m) + 15.0)).astype(np.float32)
        return out, w.reshape(len(ORDERS), n, ROW)[:, :, :GATES], final.reshape(n, ROW)[:, :HEIGHTS]

    def run(self, texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """log10 probability of each text; (doc, context, content, log10 probability) of all chunks, text by text."""
        out, chunks = np.zeros(len(texts)), []
        by = np.argsort([-len(t) for t in texts], kind="stable")  # texts of like length have like steps
        for lo, hi in groups_of(ranked := [texts[k] for k in by], GROUP):
            d = Decisions(ranked[lo:hi], self.code)
            cost = np.empty(len(d.s))
            cost[d.order] = np.bincount(d.owner, self.costs(d, ends=False)[0], len(d.s))
            cost /= math.log(10)
            out[by[lo:hi]] = np.add.reduceat(cost, d.starts[:-1])
            doc, cut, context, content = chunks_of(d)
            chunks.append((by[lo:hi][doc], context, content, np.add.reduceat(cost, cut)))
        doc, *rest = (np.concatenate(x) for x in zip(*chunks))
        back = np.argsort(doc, kind="stable")
        return out, (doc[back], *(x[back] for x in rest))

    def learn(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Starting weights and corrections after some texts: group by group, the mean of what its texts end with."""
        m = Mixer(self.code, self.odds, self.weights.copy(), self.final.copy())
        for lo, hi in groups_of(texts, LEARN):
            d = Decisions(texts[lo:hi], self.code)
            _, w, final = m.costs(d)
            share = np.diff(d.starts) / len(d.s)
            m.weights = (w * share[None, :, None]).sum(axis=1).astype(np.float32)
            m.final = (final * share[:, None]).sum(axis=0).astype(np.float32)
        return m.weights, m.final


def _all_pairs(train: DataFrame) -> np.ndarray:
    """``pair_counts`` of all texts of (doc_id, text); what reaches the driver is bounded by the alphabet."""

    def count(batches):
        total = np.zeros((257, 257), np.int64)
        for b in batches:
            total += pair_counts(text_bytes(b.column(1)))
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total.ravel()[pair])], names=["pair", "n"])

    out = np.zeros(257 * 257, np.int64)
    for r in train.mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(257, 257)


def _learn(held: DataFrame, mixer: Mixer, groups: int) -> Mixer:
    """The mixer with the starting weights and corrections after each of ``groups`` groups of the texts, averaged by their symbols."""
    model, unit = held.sparkSession.sparkContext.broadcast(mixer), float(1 << 24)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = sorted((t or "").encode() for t in pdf["text"])
        texts = [texts[k] for k in np.random.default_rng(0).permutation(len(texts))]
        n = sum(len(t) + 1 for t in texts)
        w = np.concatenate([x.ravel() for x in model.value.learn(texts)])
        return pd.DataFrame({"i": np.arange(len(w), dtype=np.int32), "s": np.rint(w * unit).astype(np.int64) * n, "n": np.int64(n)})

    group = F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(groups))
    got = held.groupBy(group).applyInPandas(learn, "i int, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    model.unpersist()
    out = np.concatenate((mixer.weights.ravel(), mixer.final))
    for r in got:
        out[r.i] = r.s / r.n / unit
    return Mixer(mixer.code, mixer.odds, out[:-HEIGHTS].reshape(mixer.weights.shape), out[-HEIGHTS:])


def _pack(counts: np.ndarray) -> bytes:
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 16 * BLOCK, codec="zstd"), np.int64)


def fit(train: DataFrame, mixer_rows: int = 300) -> Mixer:
    """Code and counts over all of ``train`` (doc_id, text), starting weights by a share of it.

    One row of 64 (of fewer, for ``mixer_rows`` of them, but two at least), by a hash of id and text, is held
    back until the weights have been learnt on it in groups of about ``mixer_rows``, and counted then.
    """
    spark = train.sparkSession
    code = Code(_all_pairs(train))
    n = train.count()
    share = max(2, min(64, n // max(1, mixer_rows)))
    back = F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0
    held = spark.sparkContext.broadcast(code)

    def count(batches):
        totals = np.zeros(2 * BASE[-1], np.int32)
        any_ = False
        for b in batches:
            texts = text_bytes(b.column(1))
            any_ = any_ or bool(texts)
            add_counts(texts, held.value, totals)
        if any_:
            task = TaskContext.get().partitionId()
            for k in range(0, len(totals), 2 * BLOCK):
                part = totals[k:k + 2 * BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"block": [k // (2 * BLOCK)], "task": [task], "data": [_pack(part.astype(np.int64))]},
                                                     schema=pa.schema([("block", pa.int32()), ("task", pa.int32()), ("data", pa.binary())]))

    def total_of(parts) -> np.ndarray:
        total = np.zeros(2 * BLOCK, np.int64)
        for x in parts:
            total += _unpack(x)
        return total

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "task": pdf["task"].iloc[:1], "data": [_pack(total_of(pdf["data"]))]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "data": [odds_of(total_of(pdf["data"])).tobytes()]})

    def summed(rows: DataFrame) -> DataFrame:
        sent = rows.mapInArrow(count, "block int, task int, data binary")
        fan = max(1, math.isqrt(sent.rdd.getNumPartitions()))
        return sent.groupBy("block", F.pmod("task", F.lit(fan)).alias("salt")).applyInPandas(add, "block int, task int, data binary")

    def odds(sums: DataFrame) -> np.ndarray:
        out = np.zeros(BASE[-1], np.int8)
        for r in sums.groupBy("block").applyInPandas(finish, "block int, data binary").collect():  # the fixed size of the tables
            out[r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.data, np.int8)
        return out

    most = stage(summed(train.where(~back)), "counts")
    later = stage(train.where(back), "held")
    learnt = _learn(later, Mixer(code, odds(most)), max(1, n // share // max(1, mixer_rows)))
    out = Mixer(code, odds(most.union(summed(later))), learnt.weights, learnt.final)
    held.unpersist()
    drop_staged(most)
    drop_staged(later)
    return out


def _words(texts: list[bytes]):
    """Hash of each lower-cased word, and the text it stands in."""
    for lo, hi in groups_of(texts):
        data, starts = joined(texts[lo:hi])
        a, b = word_bounds(data)
        h = Poly(symbols(LOWER[data])).slices(a, b).view(np.int64)
        yield lo, hi, np.searchsorted(starts, a, "right") - 1, h


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): count of each word of (doc_id, text)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(n, first) if len(h) else n

    def sent(parts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], names=["h", "n"])

    def count(batches):
        parts = []
        for b in batches:
            for _, _, _, h in _words(text_bytes(b.column(1))):
                parts.append(np.unique(h, return_counts=True))
                if sum(len(u) for u, _ in parts) > MERGED:
                    parts = [merged(parts)]
                    if len(parts[0][0]) > MERGED // 2:
                        yield sent(parts.pop())
        if parts:
            yield sent(merged(parts))

    return train.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


class Known:
    """Counts of some words by hash: sorted hashes, and where those of each value of the top bits begin."""

    def __init__(self, h: np.ndarray, c: np.ndarray) -> None:
        order = np.argsort(self._rank(h), kind="stable")
        self.h, self.c = h[order], c[order]
        self.shift = np.uint64(64 - max(1, len(h).bit_length()))
        top = self._rank(self.h) >> self.shift
        self.first = np.searchsorted(top, np.arange((1 << 64 - int(self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def _rank(h: np.ndarray) -> np.ndarray:
        return mix64(h.view(np.uint64))

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Of each word; 0 for those not held."""
        out = np.zeros(len(h), np.int64)
        top = (self._rank(h) >> self.shift).view(np.int64)
        at, end = self.first.take(top), self.first.take(top + 1)
        open_ = np.flatnonzero(at < end)
        at, end, h = at[open_], end[open_], h[open_]
        while len(open_):
            same = self.h.take(at) == h
            hit = np.flatnonzero(same)
            out[open_[hit]] = self.c.take(at[hit])
            at += 1
            left = np.flatnonzero(~same & (at < end))
            open_, at, end, h = open_[left], at[left], end[left], h[left]
        return out


def _most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The words above the least step of the logarithm of the count that ``limit`` words at most lie above."""
    step = F.floor(F.log2("c") * 16)
    total, cut = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r.s):  # some hundred steps
        total += r["count"]
        if total > limit:
            break
        cut = r.s
    return counts.where(F.lit(False) if cut is None else step >= cut)


def _repeats(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """How often each row's keys occur in its document."""
    h = doc.astype(np.uint64)
    for k in keys:
        h = mix64(h ^ k)
    _, at, n = np.unique(h, return_inverse=True, return_counts=True)
    return n[at]


def _with_chunks(rows: DataFrame, n_texts: int) -> DataFrame:
    """(row, chunk_score): log10 probabilities of the staged rows' chunks, bits mixed with the corpus's chunk table.

    ``rows`` has row, held_out and chunks array<struct<context, content, cost, own_c, own_n>>.
    """
    chunks = rows.select("row", "held_out", F.inline("chunks"))
    seen = stage(chunks.where("not held_out").groupBy("context", "content").agg(F.count(F.lit(1)).alias("c")), "seen")
    total = seen.where(F.col("context") != START).groupBy(F.col("context").alias("_x")).agg(F.sum("c").alias("n"))
    known = seen.select(F.col("context").alias("_context"), F.col("content").alias("_content"), "c")
    found = chunks.join(known, (F.col("context") == F.col("_context")) & (F.col("content") == F.col("_content")), "left")
    # every text has a first chunk: their number is known, and no join meets on it
    first = found.where(F.col("context") == START).withColumn("n", F.lit(n_texts).cast("long"))
    later = found.where(F.col("context") != START).join(total, F.col("context") == F.col("_x"), "left").drop("_x")

    def less(total: str, own: str):
        return (F.coalesce(total, F.lit(0)) - F.when(F.col("held_out"), 0).otherwise(F.col(own))).cast("double")

    both = first.unionByName(later)
    pairs = stage(both.select("row", "cost", less("c", "own_c").alias("c"), less("n", "own_n").alias("n")), "chunks")
    size = F.least(F.floor(F.log2("n")), F.lit(9)).cast("int")
    fresh = {r.size: (r.t - r.h + 0.5) / (r.t + 1) for r in pairs.where("n > 0").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("c") > 0).alias("h")).collect()}
    e = F.element_at(F.create_map(*[F.lit(x) for k in range(10) for x in (k, float(fresh.get(k, 0.5)))]), size)
    score = (F.when(F.col("n") <= 0, F.col("cost")).when(F.col("c") <= 0, F.log10(e) + F.col("cost"))
             .otherwise(F.log10((1 - e) * F.col("c") / F.col("n") + e * F.pow(F.lit(10.0), "cost"))))
    return pairs.groupBy("row").agg(F.sum(score).alias("chunk_score"))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2,
           mixer_rows: int = 300, frequent: int = 1 << 19) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, bit_score) of each row.

    ``bit_score`` is what the bit predictors alone give, ``score`` has the chunk table mixed in.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    train = own.where("not held_out").select("doc_id", "text")
    mixer = spark.sparkContext.broadcast(fit(train, mixer_rows))
    counts = stage(word_counts(train), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = train.count()
    n_all, n_kinds = total.n + ends, total.v + (ends > 0)
    top = _most_frequent(counts, frequent).toPandas()
    known = spark.sparkContext.broadcast(Known(top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)))
    chunk = pa.struct([("context", pa.int64()), ("content", pa.int64()), ("cost", pa.float64()), ("own_c", pa.int32()), ("own_n", pa.int32())])

    def one(b: pa.RecordBatch) -> dict:
        texts = text_bytes(b.column(1))
        score, (doc, context, content, cost) = mixer.value.run(texts)
        parts = pa.StructArray.from_arrays([pa.array(context.view(np.int64)), pa.array(content.view(np.int64)), pa.array(cost),
                                            pa.array(_repeats(doc, context, content).astype(np.int32)), pa.array(_repeats(doc, context).astype(np.int32))], fields=list(chunk))
        chunks = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)), parts)
        n = np.zeros(len(texts), np.int64)
        sums, hits, rare = np.zeros(len(texts)), np.zeros(len(texts), np.int64), []
        for lo, hi, owner, h in _words(texts):
            n[lo:hi] = np.bincount(owner, minlength=hi - lo)
            c = known.value.counts(h)
            found = c > 0
            sums[lo:hi] = np.bincount(owner[found], np.log10(c[found] + 1.0), hi - lo)
            hits[lo:hi] = np.bincount(owner[found], minlength=hi - lo)
            left, d = h[~found], owner[~found]
            rare += np.split(left, np.searchsorted(d, np.arange(1, hi - lo)))
        return {"doc_id": b.column(0), "held_out": b.column(2), "n": pa.array(n), "score": pa.array(score), "bytes": pa.array([len(t) for t in texts], pa.int64()),
                "sums": pa.array(sums), "hits": pa.array(hits), "rare": pa.array(rare, pa.list_(pa.int64())), "chunks": chunks}

    schema = (f"doc_id {own.schema['doc_id'].dataType.simpleString()}, held_out boolean, n long, score double, bytes long, sums double, hits long, rare array<long>, "
              "chunks array<struct<context:long,content:long,cost:double,own_c:int,own_n:int>>")
    rows = stage(arrow_map(own, one, schema, ["doc_id", "text", "held_out"]).withColumn("row", F.monotonically_increasing_id()), "scored")
    mixer.unpersist()
    known.unpersist()
    rest = (rows.select("row", F.explode("rare").alias("h")).join(counts, "h")
            .select("row", F.log10(F.col("c") + 1).alias("more"), F.lit(1).alias("n_more"), F.lit(0.0).alias("chunk_score")))
    more = (_with_chunks(rows, ends).select("row", F.lit(0.0).alias("more"), F.lit(0).alias("n_more"), "chunk_score").union(rest.select("row", "more", "n_more", "chunk_score"))
            .groupBy(F.col("row").alias("_row")).agg(F.sum("more").alias("more"), F.sum("n_more").alias("n_more"), F.sum("chunk_score").alias("chunk_score")))
    both = rows.drop("rare", "chunks").join(more, F.col("row") == F.col("_row"), "left")
    tokens = F.col("n") + 1
    base = F.col("sums") + F.coalesce("more", F.lit(0.0)) + math.log10(ends + 1) - tokens * math.log10(n_all + n_kinds + 1)
    return both.select("doc_id", "held_out", tokens.alias("n_tokens"),
                       (F.col("hits") + F.coalesce("n_more", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
                       base.alias("base_score"), F.col("chunk_score").alias("score"),
                       (-F.col("chunk_score") / math.log10(2) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"), F.col("score").alias("bit_score"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
