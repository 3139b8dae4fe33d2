"""Benchmark decontamination with a generalised suffix automaton (operator 5).

Words are the runs `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
A document word inside any occurrence of a window is hit. The automaton holds every item;
document words are streamed through it and the longest matching length is tracked: where it
is at least ``window``, the last ``window`` words are an occurrence, and a state also knows the
short items that end there. Words that no item has break the stream, so only runs of item
words of the least window's length are streamed at all.

The automaton of at most about ``shard_words`` item words is broadcast (its states are at most twice
that number). A larger benchmark is dealt into shards, a longer item into pieces that overlap by a
window less a word. Shards are built and sent one at a time, each takes its own pass over the
documents, and hits are merged by document.

Defined cases: null or empty texts have no words; items without words never occur; equal
item_ids are one item; a null item_id reads as the empty text; repeated document rows stay
repeated; an empty benchmark hits nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, drop_staged, keyed, sliced, stage, table, text_bytes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class SuffixAutomaton:
    """Generalised suffix automaton over the words of all items."""

    def __init__(self, items: dict[str, list[list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[str]] = [set()]
        shorts: list[tuple[int, str, list[int]]] = []
        self.shortest = window
        for item, texts in sorted(items.items()):
            for words in texts:
                if not words:
                    continue
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                last = 0
                for w in ids:
                    last = self._extend(last, w)
                    while len(ends) < len(self.next):
                        ends.append(set())
                    ends[last].add(item)
                if len(ids) < window:
                    shorts.append((len(ids), item, ids))
                    self.shortest = min(self.shortest, len(ids))
        # the items of a state are those of all states whose suffix link leads to it
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        #: for a state: the state of its suffix of ``window`` words
        self.cut = [0] * len(self.next)
        whole: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for n, item, ids in shorts:
            s = 0
            for w in ids:
                s = self.next[s][w]
            whole[s].append((n, item))
        #: for a state: the short items that end there, with their lengths
        self.whole: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            up = self.link[s]
            self.whole[s] = tuple(dict.fromkeys([*whole[s], *(self.whole[up] if up > 0 else ())]))
            if self.length[s] >= window:
                self.cut[s] = s if self.length[up] < window else self.cut[up]
        self.items = {s: frozenset(ends[s]) for s in set(self.cut) if s}

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(step)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        """A state for the shorter strings of q, taking over the steps by w from p upwards."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of hit words, and the items with occurring windows."""
        if len(words) < self.shortest or not self.vocab:
            return [], set()
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).view(np.int8)))
        lo, hi = edge[0::2], edge[1::2]
        long = hi - lo >= self.shortest
        out: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in zip(lo[long].tolist(), hi[long].tolist()):
            s = n = 0
            for i, w in enumerate(ids[a:b].tolist(), a + 1):
                while s and w not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
                if w in self.next[s]:
                    s = self.next[s][w]
                    n += 1
                size = 0
                if n >= self.window:
                    size = self.window
                    found |= self.items[self.cut[s]]
                for k, item in self.whole[s]:
                    if k <= n:
                        size = max(size, k)
                        found.add(item)
                if size:
                    at = i - size
                    while out and out[-1][1] >= at:
                        at = min(at, out.pop()[0])
                    out.append((at, i))
        return out, found


def _pieces(items: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> DataFrame:
    """(i, piece, words) of each item: pieces of at most ``shard_words`` words, which overlap by ``window`` - 1."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    step = max(1, shard_words - window + 1)

    def one(b: pa.RecordBatch) -> dict:
        ids, piece, words = [], [], []
        for i, t in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
            w = words_of(t)
            for k in range(0, max(1, len(w) - window + 1) if w else 0, step):
                ids.append(i)
                piece.append(k)
                words.append(b" ".join(w[k:k + max(step + window - 1, window)]))
        return {"i": pa.array(ids, pa.string()), "piece": pa.array(piece, pa.int64()), "words": pa.array(words, pa.binary())}

    return arrow_map(own, one, "i string, piece long, words binary", ["i", "t"])


def _shards(items: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> tuple[int, Iterator[SuffixAutomaton]]:
    """The number of shards, and their automata, built one at a time."""
    own = stage(_pieces(items, id_col, text_col, window, shard_words), "items")
    size = own.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, -(-size // (2 * shard_words)))  # a word takes two bytes at least

    def build() -> Iterator[SuffixAutomaton]:
        for k in range(n):
            held: dict[str, list[list[bytes]]] = {}
            for r in own.where(F.pmod(F.xxhash64("i", "piece"), F.lit(n)) == k).toLocalIterator():
                held.setdefault(r.i, []).append(r.words.split(b" "))
            yield SuffixAutomaton(held, window)
        drop_staged(own)

    return n, build()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 13, shard_words: int = 200_000) -> DataFrame:
    """(doc_id, n_words, spans array<struct<start,end>> of hit words, items array<string>) of each row."""
    spark = docs.sparkSession
    n, automata = _shards(items, item_id, item_text, window, shard_words)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema, extra = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, s array<long>, e array<long>, items array<string>", []
    if n > 1:
        src = stage(src.withColumn("row", F.monotonically_increasing_id()), "rows")
        schema, extra = schema + ", row long", ["row"]
    parts = None
    for automaton in automata:
        held = spark.sparkContext.broadcast(automaton)

        def one(b: pa.RecordBatch, held=held) -> dict:
            got = []
            for t in text_bytes(b.column(1)):
                w = words_of(t)
                spans, found = held.value.spans(w)
                got.append((len(w), [x[0] for x in spans], [x[1] for x in spans], sorted(found)))
            cols = list(zip(*got))
            out = {"doc_id": b.column(0), "n_words": pa.array(cols[0], pa.int64()), "s": pa.array(cols[1], pa.list_(pa.int64())),
                   "e": pa.array(cols[2], pa.list_(pa.int64())), "items": pa.array(cols[3], pa.list_(pa.string()))}
            return out | ({"row": b.column(2)} if extra else {})

        part = arrow_map(src, one, schema, ["doc_id", "text", *extra])
        if extra:  # one shard in memory at a time
            part = stage(part, "shard")
            held.destroy()
        parts = part if parts is None else parts.union(part)
    if extra:
        parts = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("s")).alias("s"),
                                         F.flatten(F.collect_list("e")).alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    pairs = F.arrays_zip(F.col("s").alias("start"), F.col("e").alias("end"))
    return parts.select("doc_id", "n_words", (F.array_sort(pairs) if extra else pairs).alias("spans"), "items")


#: Words that the spans cover: spans are sorted by start and may overlap where shards were merged.
N_HIT = """aggregate(spans, struct(0L as n, 0L as upto),
  (a, x) -> struct(a.n + greatest(0L, x.end - greatest(x.start, a.upto)) as n, greatest(a.upto, x.end) as upto), a -> a.n)"""


def judged(docs: DataFrame, items: DataFrame, share: int = 20, **columns) -> DataFrame:
    """``contamination`` with n_hit and contaminated: at least one word of ``share`` is hit."""
    found = contamination(docs, items, **columns).withColumn("n_hit", F.expr(N_HIT))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without its words start to end of each span, and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, upto = [], 0
    for s, e in sorted(spans):
        out.append(raw[upto:max(upto, at[s][0])])
        upto = max(upto, at[e - 1][1])
    return b"".join([*out, raw[upto:]]).decode()


def cleaned(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20, **columns) -> DataFrame:
    """(doc_id, text) of each row: contaminated texts lose their hit words, all others stay as they are."""
    rows, key = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    spans = judged(rows, items, share, id_col=key, **columns).where("contaminated").select(F.col("doc_id").alias("_row"), "spans")

    def one(b: pa.RecordBatch) -> dict:
        texts = [remove_spans(t, [(y["start"], y["end"]) for y in x or ()]) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        return {"doc_id": b.column(0), "text": pa.array(texts, pa.string())}

    both = rows.join(spans, rows[key] == spans["_row"], "left")
    return arrow_map(both, one, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string", ["doc_id", "text", "spans"])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, shard_words: int = 200_000) -> DataFrame:
    """Pipeline stage: contaminated rows go, all others stay as they are, whatever ids they share.

    A benchmark of one shard is judged row by row in one pass; hits of several are brought together by row.
    """
    items = table(spark, sf_dir, "benchmark")
    n, automata = _shards(items, "item_id", "text", 13, shard_words)
    if n > 1:
        rows, key = keyed(docs)
        bad = judged(rows, items, id_col=key, shard_words=shard_words).where("contaminated").select(F.col("doc_id").alias("_bad"))
        return rows.join(bad, rows[key] == bad["_bad"], "left_anti").drop(key)
    held = spark.sparkContext.broadcast(next(automata))
    next(automata, None)
    at = docs.columns.index("text")

    def clean(text: bytes) -> bool:
        words = words_of(text)
        hit = sum(e - s for s, e in held.value.spans(words)[0])
        return not hit or 20 * hit < len(words)

    def run(batches):
        for b in sliced(batches):
            yield b.filter(pa.array([clean(t) for t in text_bytes(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
