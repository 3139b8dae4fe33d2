"""SimHash near-duplicate groups over a Gray-order hierarchical index (operator 8).

Fingerprints: words are the runs `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; each
shingle of ``width`` words (repeats included) is hashed by XXH64 with seed 42; a bit is set
if over half the hashes have it. Fewer words than ``width``: the whole sequence is the one
shingle. No words (empty or null text): fingerprint zero, linked like any other.

Links: fingerprints that differ in at most ``radius`` bits. Only distinct fingerprints are
compared. The index is dealt over the cluster in a few coarse buckets of some thousands: 64 bits
are cut into blocks, ``radius`` differing bits touch at most ``radius`` of them, so two linked
fingerprints agree on some choice of the other blocks, and meet by a few bits of these. Within a
bucket rows are put in Gray order, neighbours are factored into nodes that hold the bits all of
them share (mask and pattern), and nodes into upper nodes; pairs of nodes are taken apart from the
top, and a pair whose shared bits already differ in more than ``radius`` places is dropped with all
below it. The number of bits that deal the buckets follows the number of fingerprints, so that a
bucket's size stays and the work grows in proportion; the links are the same at any number.

Near copies (``near_copies``, the pipeline's stage): documents whose sets of five-word shingles have
a Jaccard similarity of at least 0.8. No radius on 64 bits is sure to find these, so rows are dealt
by eight pairs of minimum hashes of their shingles (a pair of similarity 0.8 meets in one with
probability 0.9997), the Gray index leaves what differs in at most 22 bits, and the sets themselves
are compared. Links are verified until they connect what they can, not for all pairs.

Defined cases: a null doc_id is a document like others (its component is the least non-null
doc_id of its group, or null if there is none); ids that are not numbers are taken as they are and
compared as strings; repeated rows stay repeated; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.buckets import local_roots, map_buckets, segment_starts, split_hot, spread
from millrace.llm.common import arrow_map, components, drop_since, drop_staged, keyed, mix64, stage, staged_so_far, table, text_bytes

LEAF = 8  # fingerprints in a lowest node
FAN = 4  # nodes in an upper node
BUCKET = 4096  # fingerprints that a bucket is planned for
HOT = 16384  # rows of one bucket that are compared in one task
PAIRS = 1 << 20  # pairs held at once
BANDS = 8  # of two minimum hashes each
_digest = xxhash.xxh64_intdigest


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of each shingle of a text's words, repeats included; none of a text without words."""
    words = text.lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [_digest(line, 42)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-width]]]
    return [_digest(line[s:e], 42) for s, e in zip(starts, ends[width - 1:])]


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half the hashes have; zero for none."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    raw = hashes.astype(">u8").view(np.uint8).reshape(n, 8)
    for i in range(0, n, 4096):
        counts += np.unpackbits(raw[i:i + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    return majority(np.array(shingle_hashes(text, width), np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) of each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(b: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, width) for t in text_bytes(b.column(1))], np.uint64)
        return {"doc_id": b.column(0), "fp": fps.view(np.int64)}

    return arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long", ["doc_id", "text"])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Nodes over fingerprints in Gray order; ``starts`` cuts them into buckets, the topmost nodes."""

    def __init__(self, fps: np.ndarray, starts: np.ndarray) -> None:
        self.fps = fps
        sizes = np.diff(starts)
        owner, rank = spread(-(-sizes // LEAF))
        first = starts[:-1][owner] + rank * LEAF
        count = np.minimum(LEAF, starts[1:][owner] - first)
        both, any_ = np.bitwise_and.reduceat(fps, first), np.bitwise_or.reduceat(fps, first)
        self.levels = [(first, count, both, any_)]
        per = np.bincount(owner, minlength=len(sizes))
        while per.max(initial=1) > 1:
            at = np.cumsum(per) - per
            owner, rank = spread(-(-per // FAN))
            first = at[owner] + rank * FAN
            count = np.minimum(FAN, (at + per)[owner] - first)
            both, any_ = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(any_, first)
            self.levels.append((first, count, both, any_))
            per = np.bincount(owner, minlength=len(sizes))
        #: pairs of nodes met and dropped at each level
        self.met, self.dropped = [0] * len(self.levels), [0] * len(self.levels)
        self.compared = 0

    def links(self, radius: int):
        """Arrays (i, j) of places, i < j, of the fingerprints that differ in at most ``radius`` bits."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        todo = [(top, roots[i:i + PAIRS // 64], roots[i:i + PAIRS // 64]) for i in range(0, len(roots), PAIRS // 64)]
        inside = np.arange(LEAF)
        while todo:
            level, a, b = todo.pop()
            first, count, both, any_ = self.levels[level]
            if len(a) > PAIRS // 64:
                half = len(a) // 2
                todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            # accumulated differences: what all below a and all below b share, and where these differ
            apart = both[a] ^ both[b]
            apart &= ~(both[a] ^ any_[a])
            apart &= ~(both[b] ^ any_[b])
            near = np.bitwise_count(apart) <= radius
            self.met[level] += len(a)
            a, b = a[near], b[near]
            self.dropped[level] += len(near) - len(a)
            if level:
                owner, rank = spread(count[a] * count[b])
                each = count[b][owner]
                i, j = first[a][owner] + rank // each, first[b][owner] + rank % each
                keep = i <= j
                todo.append((level - 1, i[keep], j[keep]))
                continue
            for k in range(0, len(a), PAIRS // LEAF**2):
                x, y = a[k:k + PAIRS // LEAF**2], b[k:k + PAIRS // LEAF**2]
                i, j = first[x][:, None] + inside, first[y][:, None] + inside
                fx, fy = self.fps.take(i, mode="clip"), self.fps.take(j, mode="clip")
                self.compared += len(x) * LEAF**2
                pair, p, q = np.nonzero(np.bitwise_count(fx[:, :, None] ^ fy[:, None, :]) <= radius)
                own = (p < count[x][pair]) & (q < count[y][pair])
                i, j = i[pair[own], p[own]], j[pair[own], q[own]]
                keep = i < j
                if keep.any():
                    yield i[keep], j[keep]


def masks(blocks: int, radius: int, bits: int = 64) -> list[int]:
    """A mask for each choice of ``blocks - radius`` of the blocks that the 64 bits are cut into, of at most ``bits`` of their bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for c in combinations(range(blocks), blocks - radius):
        held = [x for part in zip(*[range(edges[k], edges[k] + 64 // blocks) for k in c]) for x in part][:bits]  # in turn from each block
        m = sum(1 << x for x in held)
        out.append(m - (1 << 64) if m >> 63 else m)
    return sorted(set(out))


def plan(n: int, radius: int) -> tuple[int, int]:
    """Blocks and bits that deal ``n`` fingerprints into buckets of about ``BUCKET``."""
    bits, blocks = max(0, (n // BUCKET).bit_length()), radius + 1
    while bits > (blocks - radius) * (64 // blocks) and blocks < 2 * radius + 2:
        blocks += 1
    return blocks, bits


def _bucket_links(radius: int):
    def per_rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        starts = segment_starts(keys)
        fps = b.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        size = np.repeat(np.diff(starts), np.diff(starts))
        fps, seg = fps[size > 1], np.repeat(np.arange(len(starts) - 1), np.diff(starts))[size > 1]
        if not len(fps):
            return None
        order = np.lexsort((gray_rank(fps), seg))
        fps = fps[order]
        index = GrayIndex(fps, segment_starts([seg[order]]))
        label = np.arange(len(fps))
        for i, j in index.links(radius):
            fresh = label[i] != label[j]
            label = local_roots(len(fps), i[fresh], j[fresh], label)
        out = label != np.arange(len(fps))
        if not out.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(fps[out].view(np.int64)), pa.array(fps[label[out]].view(np.int64))], names=["a", "b"])

    return per_rows


def group_fingerprints(fps: DataFrame, radius: int = 4, blocks: int | None = None, bits: int | None = None) -> DataFrame:
    """Distinct fingerprints (fp) to (node, root) of those that have links.

    ``blocks`` must exceed ``radius``; both numbers follow the number of fingerprints unless given. Every
    value gives the same result.
    """
    planned = plan(fps.count(), radius)
    blocks, bits = blocks or planned[0], planned[1] if bits is None else bits
    table_keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                     for t, m in enumerate(masks(blocks, radius, bits))]))
    rows = fps.select("fp", table_keys.alias("k")).select(F.col("k.t").alias("t"), F.col("k.key").alias("key"), "fp")
    cells = split_hot(rows, ["t", "key"], "fp", HOT).select("t", "key", "ci", "cj", "fp")
    edges = map_buckets(cells, ["t", "key", "ci", "cj"], [], _bucket_links(radius), "a long, b long")
    return components(stage(edges.distinct(), "links"), "a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id is the least id of the group."""
    own = stage(fingerprints(docs, id_col, text_col, width), "fps")
    distinct = stage(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    groups = group_fingerprints(distinct.select("fp"), radius, blocks)
    member = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    final = member.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return own.join(final, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_SEEDS = mix64(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` keys, each of two minimum hashes of a set of shingle hashes."""
    if not len(shingles):
        return np.zeros(BANDS, np.uint64)
    least = np.empty(2 * BANDS, np.uint64)
    for k in range(0, len(shingles), 1 << 14):
        low = mix64(shingles[k:k + (1 << 14), None] ^ _SEEDS).min(axis=0)
        least = np.minimum(least, low) if k else low
    return mix64(mix64(least[::2]) ^ least[1::2])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def _met_first(sig: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this band is the first that the rows i and j share; ``sig`` has the low halves of all bands' keys."""
    same = sig[i] == sig[j]
    return np.argmax(same, axis=1) == band[i]


def _bucket(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, GrayIndex] | None:
    """Buckets of several rows in Gray order, their places' bands and signatures, and the index over them."""
    starts = segment_starts([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
    seg = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    fps = b.column(5).to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.lexsort((gray_rank(fps), seg))
    order = order[np.diff(starts)[seg[order]] > 1]
    if not len(order):
        return None
    b = b.take(pa.array(order))
    sig = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(6, 6 + BANDS // 2)], axis=1).astype(np.int64).view(np.uint32)
    return b, b.column(0).to_numpy(zero_copy_only=False), sig, GrayIndex(fps[order], segment_starts([seg[order]]))


def _with_company(radius: int):
    def per_rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _bucket(b)
        if found is None:
            return None
        rows, band, sig, index = found
        has = np.zeros(rows.num_rows, bool)
        for i, j in index.links(radius):
            own = _met_first(sig, band, i, j)
            has[i[own]] = has[j[own]] = True
        return rows.filter(pa.array(has)) if has.any() else None

    return per_rows


def _verified(radius: int, similarity: float):
    def per_rows(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _bucket(b)
        if found is None:
            return None
        rows, band, sig, index = found
        ids = rows.column(4).to_numpy(zero_copy_only=False)
        lists = rows.column(rows.num_columns - 1)
        sets: dict[int, np.ndarray] = {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = lists[k].values.to_numpy(zero_copy_only=False)
            return sets[k]

        label, out = np.arange(len(ids)), []
        for i, j in index.links(radius):
            own = _met_first(sig, band, i, j)
            i, j = i[own], j[own]
            while len(i):
                open_ = label[i] != label[j]
                i, j = i[open_], j[open_]
                _, take = np.unique(j, return_index=True)  # for each row one pair at a time: a verified one may settle the others
                good = np.array([jaccard(shingles(x), shingles(y)) >= similarity for x, y in zip(i[take].tolist(), j[take].tolist())], bool)
                x, y = i[take][good], j[take][good]
                out.append((ids[x], ids[y]))
                label = local_roots(len(label), x, y, label)
                i, j = np.delete(i, take), np.delete(j, take)
        a, b_ = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_)], names=["a", "b"]) if len(a) else None

    return per_rows


def near_copies(docs: DataFrame, id_col: str, text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 22) -> DataFrame:
    """(doc_id, group_id) of each row: groups connected by sets of shingles of at least this Jaccard similarity.

    ``id_col`` holds a different long for each row. Rows of equal sets of shingles are one for the comparison;
    shingles are compared by 64 bits for this, and by 32 in the verification.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [f"k{t}" for t in range(BANDS)]

    def one(b: pa.RecordBatch) -> dict:
        sets = [np.unique(np.array(shingle_hashes(t, width), np.uint64)) for t in text_bytes(b.column(1))]
        keys = np.stack([sketch(x) for x in sets])
        same = np.array([_digest(x.tobytes(), 42) if len(x) else 0 for x in sets], np.uint64)
        fps = np.array([majority(x) for x in sets], np.uint64)
        short = [np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in sets]
        short = [np.sort(x) for x in short]
        out = {"doc_id": b.column(0), "same": same.view(np.int64), "fp": fps.view(np.int64)}
        return out | {n: np.ascontiguousarray(keys[:, t]).view(np.int64) for t, n in enumerate(names)} | {"shingles": pa.array(short, pa.list_(pa.int32()))}

    schema = "doc_id long, same long, fp long, " + ", ".join(f"{n} long" for n in names) + ", shingles array<int>"
    own = stage(arrow_map(src, one, schema, ["doc_id", "text"]), "sketches")
    reps = stage(own.groupBy("same").agg(F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in ("fp", *names)]), "sets")
    low = F.lit(0xFFFFFFFF)
    sig = [F.shiftleft(F.col(names[k + 1]), 32).bitwiseOR(F.col(names[k]).bitwiseAND(low)).alias(f"s{k // 2}") for k in range(0, BANDS, 2)]
    sigs = [f"s{k}" for k in range(BANDS // 2)]
    bands = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(n).alias("key")) for t, n in enumerate(names)]))
    rows = reps.where("same != 0").select("id", "fp", *sig, bands.alias("k")).select(F.col("k.t").alias("t"), F.col("k.key").alias("key"), "id", "fp", *sigs)
    cell = ["t", "key", "ci", "cj"]
    cells = split_hot(rows, ["t", "key"], "id", HOT // 4).select(*cell, "id", "fp", *sigs)
    schema = "t int, key long, ci int, cj int, id long, fp long, " + ", ".join(f"{x} long" for x in sigs)
    some = stage(map_buckets(cells, cell, [], _with_company(radius), schema), "company")
    wanted = some.select(F.col("id").alias("_id")).distinct()
    # one plan at every size: what has company grows with the rows and is not broadcast
    sets = own.select("doc_id", "shingles").join(wanted.hint("merge"), F.col("doc_id") == F.col("_id")).select("_id", "shingles")
    full = some.join(sets, F.col("id") == F.col("_id")).select(*cell, "id", "fp", *sigs, "shingles")
    edges = stage(map_buckets(full, cell, [], _verified(radius, similarity), "a long, b long"), "copies")
    groups = components(edges, "a", "b")
    drop_staged(some)
    member = reps.join(groups, F.col("id") == F.col("node"), "left").select(F.col("same").alias("_same"), F.coalesce("root", "id").alias("group_id"))
    return own.join(member, F.col("same") == F.col("_same")).select("doc_id", "group_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies one row stays, that of the least doc_id; a null one comes last."""
    mark = staged_so_far()
    rows, key = keyed(docs)
    group = near_copies(rows, key).select(F.col("doc_id").alias("_member"), F.col("group_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_member").alias("_member"))
    ids = rows.select(F.col(key).alias("_key"), F.col("doc_id"))
    kept = stage(ids.join(group, F.col("_key") == F.col("_member")).groupBy("_group").agg(F.min(order).alias("o")).select(F.col("o._member").alias("_kept")), "kept")
    drop_since(mark, rows, kept)
    # what stays grows with the rows and is not broadcast either
    return rows.join(kept.hint("merge"), rows[key] == kept["_kept"], "left_semi").drop(key)
