"""Substring de-duplication by relative Lempel-Ziv parsing (operator 2).

Words are the runs `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of ``window`` words that
covers it has a word sequence that also starts in a document with a smaller id; windows are
judged on the input.

The reference is the whole table, cut into blocks by content: each window has an anchor, the
least hash among its shingles of ``SHINGLE`` words, and consecutive windows with one anchor are a
block. Equal windows have equal anchors, so only blocks whose anchor occurs under two ids are
parsed at all. A document is factored against the index from left to right; a factor is (start, end,
source id, source start):

1. A whole block that the index has from a smaller id begins a factor there, or carries the last one
   on if that leads to the same place of the same source.
2. Where a block is not in the index (a copied passage begins or ends inside it, or the block is the
   first of its kind), the boundary is checked window by window against the windows of all other
   such blocks: factors grow to their first and last word. A block that is in the index need not be
   indexed again: its windows stand in the smaller document that it was copied from.

Of several sources a block has the least id, so a factor is the longest match in that source, not the
longest in any; which words go is the same. Both indexes are aggregations by hash, so a passage of a
third of all documents is reduced before the shuffle; they are written before rows are joined to them,
and these are plain joins that Spark splits where skewed. Keys are 128 bits (anchor and block, or
anchor and window).

Defined cases: null counts as no words; a null id is never a reference and keeps all its words;
rows of one id are not references of each other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.buckets import segment_starts, spread
from millrace.llm.common import Poly, arrow_map, drop_staged, groups_of, joined, stage, symbols, table, text_bytes, word_bounds

SHINGLE = 8


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, p = len(x) - width + 1, 1
    while 2 * p <= width:
        x = np.minimum(x[:-p], x[p:])
        p *= 2
    return np.minimum(x[:n], x[width - p:width - p + n])


class Windows:
    """Hashes of the windows of several texts; rows are the windows that lie within one text."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.window = window
        data, starts = joined(texts)
        lo, hi = word_bounds(data) if len(data) else (np.zeros(0, np.int64),) * 2
        doc = np.searchsorted(starts, lo, "right") - 1
        self.n_words = np.bincount(doc, minlength=len(texts))
        self.first_word = np.cumsum(self.n_words) - self.n_words
        shingle = min(SHINGLE, window)
        if len(lo) < window:
            self.at = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        self.words = Poly(Poly(symbols(data)).slices(lo, hi), 0x9FB21C651E98DF25)
        i = np.arange(len(lo) - shingle + 1)
        least = sliding_min(self.words.slices(i, i + shingle), window - shingle + 1)
        self.at = np.flatnonzero(doc[:len(least)] == doc[window - 1:])
        self.doc, self.anchor = doc[self.at], least[self.at]

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, anchor, hash, first window within the doc, windows) of each block."""
        if not len(self.at):
            return (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 2)
        cut = segment_starts([self.doc, self.anchor])
        first, n = cut[:-1], np.diff(cut)
        start = self.at[first]
        return self.doc[first], self.anchor[first], self.words.slices(start, start + n + self.window - 1), start - self.first_word[self.doc[first]], n


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def _blocks(src: DataFrame, window: int) -> DataFrame:
    def one(b: pa.RecordBatch) -> dict | None:
        texts, out = text_bytes(b.column(2)), []
        for lo, hi in groups_of(texts):
            doc, anchor, block, first, n = Windows(texts[lo:hi], window).blocks()
            out.append((doc + lo, anchor, block, first, n))
        doc, anchor, block, first, n = (np.concatenate(x) for x in zip(*out))
        take = pa.array(doc)
        return {"doc_id": b.column(0).take(take), "th": b.column(1).take(take), "anchor": anchor.view(np.int64), "block": block.view(np.int64),
                "first": first.astype(np.int32), "n": n.astype(np.int32)}

    return arrow_map(src, one, f"doc_id {_kind(src)}, th long, anchor long, block long, first int, n int", ["doc_id", "th", "text"])


def _windows(src: DataFrame, window: int) -> DataFrame:
    """One row for each window of the blocks listed in ``at`` (first, n)."""

    def one(b: pa.RecordBatch) -> dict | None:
        texts, lists, out = text_bytes(b.column(2)), b.column(3).to_pylist(), []
        for lo, hi in groups_of(texts):
            w = Windows(texts[lo:hi], window)
            first = np.array([x["first"] for k in range(lo, hi) for x in lists[k]], np.int64)
            n = np.array([x["n"] for k in range(lo, hi) for x in lists[k]], np.int64)
            doc = np.repeat(np.arange(hi - lo), [len(lists[k]) for k in range(lo, hi)])
            owner, rank = spread(n)
            pos = first[owner] + rank
            at = w.first_word[doc[owner]] + pos
            anchor = w.anchor[np.searchsorted(w.at, at)]
            out.append((doc[owner] + lo, anchor, w.words.slices(at, at + window), pos))
        doc, anchor, h, pos = (np.concatenate(x) for x in zip(*out))
        take = pa.array(doc)
        return {"doc_id": b.column(0).take(take), "th": b.column(1).take(take), "anchor": anchor.view(np.int64), "w": h.view(np.int64), "pos": pos.astype(np.int32)}

    return arrow_map(src, one, f"doc_id {_kind(src)}, th long, anchor long, w long, pos int", ["doc_id", "th", "text", "at"])


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, th, spans array<struct<s,e,source,at>>): word ranges to remove, and where the same words stand; th is xxhash64 of the text."""
    src = _source(docs, id_col, text_col).where("doc_id is not null and text is not null")
    blocks = _blocks(src, window)
    several = blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select(F.col("anchor").alias("_a"))
    shared = stage(blocks.join(several, F.col("anchor") == F.col("_a"), "left_semi"), "blocks")
    least = stage(shared.groupBy(F.col("anchor").alias("_a"), F.col("block").alias("_b")).agg(F.min("doc_id").alias("low"), F.min_by("first", "doc_id").alias("at")), "index")
    parsed = stage(shared.join(least, (F.col("anchor") == F.col("_a")) & (F.col("block") == F.col("_b")))
                   .select("doc_id", "th", "first", "n", "low", "at", (F.col("low") < F.col("doc_id")).alias("factor")), "parsed")
    drop_staged(shared)
    drop_staged(least)
    edges = parsed.where("not factor").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.collect_set(F.struct("first", "n")).alias("at"))
    rows = src.join(edges, (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_t"))).dropDuplicates(["doc_id", "th"])
    checked = stage(_windows(rows, window), "windows")
    low = stage(checked.groupBy(F.col("anchor").alias("_a"), F.col("w").alias("_w"))
                .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min_by("pos", "doc_id").alias("at")).where("low < high").drop("high"), "index")
    single = (checked.join(low, (F.col("anchor") == F.col("_a")) & (F.col("w") == F.col("_w"))).where("low < doc_id")
              .select("doc_id", "th", F.col("pos").alias("s"), (F.col("pos") + window).alias("e"), F.col("low").alias("source"), "at"))
    whole = parsed.where("factor").select("doc_id", "th", F.col("first").alias("s"), (F.col("first") + F.col("n") + (window - 1)).alias("e"), F.col("low").alias("source"), "at")
    return whole.union(single).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e", "source", "at")).alias("spans"))


def factors(spans: list[tuple]) -> list[tuple]:
    """(start, end, source, source start) of the parse, from spans of the same form: each goes on while its source does."""
    out: list[tuple] = []
    for s, e, source, at in sorted(spans):
        if out:
            ps, pe, p_source, p_at = out[-1]
            if source == p_source and s - ps == at - p_at and s <= pe:
                out[-1] = (ps, max(pe, e), source, p_at)
                continue
            if e <= pe:
                continue
        out.append((s, e, source, at))
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def kept_words(text: bytes, spans: list[tuple]) -> tuple[int, list[bytes]]:
    """The number of words, and those outside the spans."""
    words = text.split()
    out, upto = [], 0
    for s, e, *_ in sorted(spans):
        if s > upto:
            out += words[upto:s]
        upto = max(upto, e)
    return len(words), out + words[upto:]


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row; ``digest`` gives kept_sha256 in place of the kept text."""
    spans = duplicate_spans(docs, id_col, text_col, window).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "spans")
    rows = _source(docs, id_col, text_col).join(spans, (F.col("doc_id") == F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    name = "kept_sha256" if digest else "kept"

    def one(b: pa.RecordBatch) -> dict:
        n, removed, kept = [], [], []
        for t, x in zip(text_bytes(b.column(1)), b.column(2)):  # one row's spans at a time: there may be one for each window
            k, words = kept_words(t, factors([(y["s"], y["e"], y["source"], y["at"]) for y in x.as_py() or ()]))
            n.append(k)
            removed.append(k - len(words))
            line = b" ".join(words)
            kept.append(hashlib.sha256(line).hexdigest() if digest else line.decode())
        return {"doc_id": b.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), name: pa.array(kept, pa.string())}

    return arrow_map(rows, one, f"doc_id {_kind(rows)}, n_words long, n_removed long, {name} string", ["doc_id", "text", "spans"])


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(doc_id, factors array<struct<start,end,source,source_start>>) of each different id and text that has factors, in words."""
    spans = duplicate_spans(docs, id_col, text_col, window)
    kind = _kind(spans)

    def one(b: pa.RecordBatch) -> dict:
        own = [factors([tuple(y[k] for k in ("s", "e", "source", "at")) for y in x.as_py()]) for x in b.column(1)]
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", b.schema.field("doc_id").type), ("source_start", pa.int32())]))
        return {"doc_id": b.column(0), "factors": pa.array([[dict(zip(("start", "end", "source", "source_start"), f)) for f in x] for x in own], kinds)}

    return arrow_map(spans, one, f"doc_id {kind}, factors array<struct<start:int,end:int,source:{kind},source_start:int>>", ["doc_id", "spans"])


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_duplicates(table(spark, sf_dir, "documents"), digest=True)
