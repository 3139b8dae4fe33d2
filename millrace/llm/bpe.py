"""Byte-level BPE encoding and decoding (operator 9).

Texts are split by the tokenizer's pattern and each match is encoded by itself, without
special tokens. One pass of an Aho-Corasick automaton over a match's bytes, from the last to the
first, notes the longest token that starts at each byte. From the left the longest
token is taken whose pair with the token before it is compatible (merging the two tokens'
bytes by rank gives back just these two); else the next shorter token that starts there; where
none fits, the position is dead and the token before it gives way. Compatible neighbours all
along are what merging by rank yields, and the valid encoding of a prefix is unique, so each
position is left at most once: linear time. Two tokens are tested by taking back their last merges
by turns, the later first: at no stage may the two at the boundary merge before what is taken back.
Compatibility is memoised by pair.

Where the pattern allows it, text between two single spaces is encoded by itself (a match of the
public pattern never spans "non-space, space, non-space" other than from that space on); any other
pattern runs over whole texts. Results of matches and such texts are memoised too. Both memos hold a
fixed number of entries and are dropped at the end of each partition. Decoding joins the bytes of the ids.

The vocabulary is read by each worker: a path, or None for the public one wherever it is installed.

Defined cases: null counts as empty and has no ids; invalid ids raise in ``decode``; null ids
decode to null; repeated rows stay repeated; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, table

MEMO = 100_000  # matches in one of the two generations, of at most SHORT characters each
SHORT = 24
PAIRS = 1 << 17  # pairs of tokens whose compatibility is held
STEPS = 170_000  # steps of the automaton that are held; those over falls to shorter states are added as texts need them
#: white space other than the space, by either reading of \\s
GAPS = frozenset(c for c in map(chr, range(0x3001)) if c != " " and (c.isspace() or regex.match(r"\s", c)))
Encoded = tuple[int, ...]
_coders: dict[tuple[str | None, str | None], Coder] = {}


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of the public byte-level vocabulary of 50,256 ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def coder(path: str | None = None, pattern: str | None = None) -> Coder:
    """One coder a process for each vocabulary; None stands for the public path or pattern of this machine."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(*(x or y for x, y in zip((path, pattern), default_tokenizer() if not (path and pattern) else ("", ""))))
    return _coders[path, pattern]


def release() -> None:
    """Drop what the coders of this process have memoised."""
    for c in _coders.values():
        c.forget()


class Coder:
    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.by_spaces = pattern == default_tokenizer()[1]
        self.automaton()
        self.size = [len(self.bytes.get(i, b"")) for i in range(max(self.bytes) + 1)]
        #: the longest token that is a proper prefix of a token, -1 if there is none
        self.shorter = [-1] * len(self.size)
        for t, i in self.ranks.items():
            for n in range(len(t) - 1, 0, -1):
                if (s := self.ranks.get(t[:n])) is not None:
                    self.shorter[i] = s
                    break
        self.splits()
        self.text = [str(i) for i in range(len(self.size))]
        self.forget()

    def forget(self) -> None:
        #: whether the pair (a, b) is compatible, at a << 32 | b
        self.pairs: dict[int, bool] = {}
        #: what matches and pieces encode to, in two generations
        self.memo: dict[str, Encoded] = {}
        self.older: dict[str, Encoded] = {}

    def automaton(self) -> None:
        """Aho-Corasick over the tokens read backwards: a text's bytes taken from the last to the first lead to states that
        know the longest token starting at the byte. The step from a state by a byte is at ``state << 8 | byte``."""
        self.steps: dict[int, int] = {}
        self.starts, depth = [-1], [0]
        for t, i in self.ranks.items():
            state = 0
            for x in reversed(t):
                to = self.steps.get(state << 8 | x)
                if to is None:
                    to = self.steps[state << 8 | x] = len(self.starts)
                    self.starts.append(-1)
                    depth.append(depth[state] + 1)
                state = to
            self.starts[state] = i
        self.fails = [0] * len(depth)
        for key, to in sorted(self.steps.items(), key=lambda k: depth[k[0] >> 8]):
            if key >> 8:
                self.fails[to] = self._fall(self.fails[key >> 8], key & 255)
            if self.starts[to] < 0:
                self.starts[to] = self.starts[self.fails[to]]

    def _fall(self, state: int, x: int) -> int:
        """The step from a state by a byte, or from the longest of its shorter states that has one."""
        at = state
        while (to := self.steps.get(at << 8 | x)) is None and at:
            at = self.fails[at]
        if to is None:
            to = 0
        if len(self.steps) < STEPS:
            self.steps[state << 8 | x] = to
        return to

    def splits(self) -> None:
        """The two tokens that each token is last merged from; those of single bytes are the token itself.

        Where each longer token has such two, both of lower rank, merges come in the order of their ranks, and
        ``compatible`` takes them back one by one; any other vocabulary is merged step by step.
        """
        self.left, self.right = list(range(len(self.size))), list(range(len(self.size)))
        self.whole: dict[int, int] | None = {}
        for i in sorted(self.bytes):
            data = self.bytes[i]
            a = self.shorter[i]
            while a >= 0:
                b = self.ranks.get(data[self.size[a]:], i)
                if a < i and b < i and self.apart(a, b):
                    self.whole[a << 32 | b] = i
                    self.left[i], self.right[i] = a, b
                    break
                a = self.shorter[a]
            else:
                if len(data) != 1:
                    self.whole = None
                    return

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b while both are merged: the last merge of either is taken back, by turns."""
        whole, left, right, before = self.whole.get, self.left, self.right, len(self.size)
        while whole(a << 32 | b, before) >= before:
            if a > b:
                before, a = a, right[a]
                if a == before:
                    before, b = b + 1, left[b]
                    if b + 1 == before:
                        return True
            else:
                before, b = b + 1, left[b]
                if b + 1 == before:
                    before, a = a, right[a]
                    if a == before:
                        return True
        return False

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank, step by step: the definition that compatibility rests on."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may stand behind token a; behind -1, whether merging makes it at all."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        if self.whole is None:
            fits = self.merged(self.bytes.get(a, b"") + self.bytes[b]) == [x for x in (a, b) if x >= 0]
        else:
            fits = self.apart(a, b)
        self.pairs[a << 32 | b] = fits
        return fits

    def encode_match(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, size, shorter, compatible, known = len(data), self.size, self.shorter, self.compatible, self.pairs.get
        longest, step, starts, state = [-1], self.steps.get, self.starts, 0
        for x in reversed(data):
            to = step(state << 8 | x)
            state = self._fall(state, x) if to is None else to
            longest.append(starts[state])
        longest.reverse()
        dead, made = bytearray(n + 1), self.whole is not None
        out: list[int] = []
        at, t, before = 0, longest[0], -1
        while at < n:
            while t >= 0:
                if not dead[at + size[t]]:
                    if before < 0 and made:
                        break
                    fits = known(before << 32 | t)
                    if compatible(before, t) if fits is None else fits:
                        break
                t = shorter[t]
            if t < 0:
                dead[at] = 1
                t = out.pop()
                before = out[-1] if out else -1
                at -= size[t]
                t = shorter[t]
            else:
                out.append(t)
                before = t
                at += size[t]
                t = longest[at]
        return out

    def _match(self, m: str) -> Encoded:
        got = self.memo.get(m)
        return self._keep(m, self.older.pop(m, None) or tuple(self.encode_match(m.encode()))) if got is None else got

    def _piece(self, p: str) -> Encoded:
        """The ids of what stands between two single spaces; a match by itself is such a piece, so they share the memo."""
        if p[0] == " ":
            if p[1:].isalpha():  # a word, which is one match
                return self._match(p)
            if p[-1] in ",." and p[1:-1].isalpha():  # a word and the mark after it
                return self._match(p[:-1]) + self._match(p[-1])
        got = self.memo.get(p) or self.older.pop(p, None)
        return self._keep(p, got or tuple(chain.from_iterable(map(self._match, self.pattern.findall(p)))))

    def _keep(self, m: str, got: Encoded) -> Encoded:
        if len(m) <= SHORT:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[m] = got
        return got

    def pieces_of(self, text: str) -> list[str]:
        """The text cut before each single space that stands between two characters other than white space."""
        if not text:
            return []
        if not (text[0] in GAPS or text[-1] in GAPS or "  " in text or any(c + " " in text or " " + c in text for c in GAPS if c in text)):
            first, *rest = text.split(" ")
            return [*([first] if first else []), *[" " + p for p in rest]]
        return [p for p in regex.split(r"(?<=\S)(?= \S)", text, flags=regex.V1) if p]

    def encode(self, text: str) -> list[int]:
        """The ids of the pattern's matches, one after the other."""
        if not self.by_spaces:
            return list(chain.from_iterable(map(self._match, self.pattern.findall(text))))
        pieces = self.pieces_of(text)
        got = list(map(self.memo.get, pieces))
        for k, ids in enumerate(got):
            if ids is None:
                got[k] = self._piece(pieces[k])
        return list(chain.from_iterable(got))

    def text_of(self, ids: list[int]) -> str:
        return " ".join(map(self.text.__getitem__, ids))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _texts(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(b: pa.RecordBatch) -> dict:
        c = coder(path, pattern)
        ids = [np.array(c.encode(t), np.int32) for t in _texts(b.column(1))]
        return {"doc_id": b.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>", ["doc_id", "text"], release)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, data binary) of each row: the bytes that the ids stand for."""
    src = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def one(b: pa.RecordBatch) -> dict:
        c = coder(path, pattern)
        return {"doc_id": b.column(0), "data": pa.array([None if x is None else c.decode(x) for x in b.column(1).to_pylist()], pa.binary())}

    return arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, data binary", ["doc_id", "ids"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode`` and ``decode`` without moving the ids."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(b: pa.RecordBatch) -> dict:
        c = coder(path, pattern)
        n, ids, data = [], [], []
        for t in _texts(b.column(1)):
            own = c.encode(t)
            n.append(len(own))
            ids.append(hashlib.sha256(c.text_of(own).encode()).hexdigest())
            data.append(hashlib.sha256(c.decode(own)).hexdigest())
        return {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(data, pa.string())}

    return arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id", "text"], release)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: (doc_id, n_tokens, ids) of each document; ids decode to its text."""
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
