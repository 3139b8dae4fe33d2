"""Secret scans with structural confirmation (operator 7).

Base kinds are patterns over the whole text, leftmost and non-overlapping for each kind; a
match that fails its length is dropped and the scan goes on behind it:

- assign: `(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)`,
  its letters in either case, with a value of 8 or more characters;
- access: `AKIA[A-Z0-9]+` of 16 or more characters;
- hex: `[0-9a-f]+` of 32 or more characters.

Confirmed kinds come from decoding: long base64 (either alphabet; also over several lines) or hex
runs, armoured blocks and dotted triples are decoded, and reported only if the bytes parse as what they would have to be:

- der: nested definite lengths that fill their parents exactly, in the shape of an RSA, EC or
  PKCS#8 private key;
- sshkey: an `openssh-key-v1` blob whose length-prefixed fields lie inside it;
- pem: an armoured private key whose body is one of these two; or an encrypted one: PKCS#8 by its
  nested lengths, or the older form by its headers (cipher and initial vector) and whole blocks;
- jwt: two dotted segments that decode to JSON objects, the first with an `alg`, and a signature.

Defined cases: null counts as empty; repeated rows stay repeated; other columns are ignored,
whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, table

KINDS = ("assign", "access", "hex", "der", "sshkey", "pem", "jwt")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}(?![0-9A-Fa-f])")
LONG_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{48,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+(?:\r?\n[A-Za-z0-9+/]{40,}+)*+(?:\r?\n[A-Za-z0-9+/]{2,}+={0,2})?")
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,}+)\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9_-])")
MARK = re.compile(r"-----(BEGIN|END) ([A-Z ]{0,30}?)PRIVATE KEY-----")
CIPHER = re.compile(r"[A-Z0-9-]{3,30},([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")


def from_base64(text: str) -> bytes | None:
    """Decoded bytes by the standard or the URL alphabet; None if the text is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly, else None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size = int.from_bytes(data[at:at + n], "big")
            at += n
            if size < 128:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """An RSA, EC or PKCS#8 private key by its nested tags and lengths."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(data, top[0][1], top[0][2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02:
        return False
    version, tags = data[parts[0][1]:parts[0][2]], [p[0] for p in parts]
    if version in (b"\0", b"\1") and len(parts) >= 9 and tags[:9] == [0x02] * 9:
        return all(s < e for _, s, e in parts[:9])
    if version == b"\1" and tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16:
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if version in (b"\0", b"\1") and len(parts) >= 3 and tags[1:3] == [0x30, 0x04]:
        algorithm = der_items(data, parts[1][1], parts[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06 and parts[2][1] < parts[2][2]
    return False


def is_private_ssh(data: bytes) -> bool:
    """An openssh-key-v1 blob: cipher, KDF, options, number of keys, public and private parts."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields = len(magic), []
    for k in range(6):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if k == 3:
            if not 1 <= n <= 64:
                return False
            continue
        if at + n > len(data):
            return False
        fields.append(data[at:at + n])
        at += n
    return bool(fields[0]) and len(fields[4]) >= 16


def is_encrypted_der(data: bytes) -> bool:
    """An encrypted PKCS#8 key: an algorithm with its parameters, and whole blocks of data."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(data, top[0][1], top[0][2])
    if not parts or [p[0] for p in parts] != [0x30, 0x04] or parts[1][2] - parts[1][1] < 16:
        return False
    algorithm = der_items(data, parts[0][1], parts[0][2])
    return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 0x06 and algorithm[1][0] == 0x30 and bool(der_items(data, algorithm[1][1], algorithm[1][2]))


def is_armoured_key(label: str, body: str) -> bool:
    """What stands between the marks decodes to a private key."""
    lines = [x.strip() for x in body.strip().splitlines()]
    headers = {}
    while lines and ":" in lines[0]:
        name, _, value = lines.pop(0).partition(":")
        headers[name.strip()] = value.strip()
    raw = from_base64("".join("".join(lines).split()))
    if not raw:
        return False
    if "DEK-Info" in headers:
        m = CIPHER.fullmatch(headers["DEK-Info"])
        return bool(m) and headers.get("Proc-Type", "").replace(" ", "") == "4,ENCRYPTED" and len(raw) >= 32 and len(raw) % (len(m[1]) // 2) == 0
    return is_encrypted_der(raw) if label.startswith("ENCRYPTED") else is_private_der(raw) or is_private_ssh(raw)


def armoured_spans(text: str) -> list[tuple[int, int]]:
    """Spans from each mark of a beginning to the end mark of its label, where no other mark stands between."""
    out, begun = [], None
    for m in MARK.finditer(text):
        if m[1] == "END" and begun and begun[2] == m[2] and is_armoured_key(m[2], text[begun.end():m.start()]):
            out.append((begun.start(), m.end()))
        begun = m if m[1] == "BEGIN" else None
    return out


def is_signed_token(head: str, body: str) -> bool:
    """Header and payload decode to JSON objects, the header with its algorithm."""
    parsed = []
    for part in (head, body):
        raw = from_base64(part)
        if raw is None or raw[:1] != b"{":
            return False
        try:
            parsed.append(json.loads(raw))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in parsed) and isinstance(parsed[0].get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if max(map(len, text.split()), default=0) >= 32:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of what decodes to a key or a signed token."""
    out = []
    if "-----BEGIN " in text:
        out += [(s, 5, e) for s, e in armoured_spans(text)]
    if max(map(len, text.split()), default=0) >= 32:
        for m in DOTTED.finditer(text):
            if is_signed_token(m[1], m[2]) and from_base64(m[3]) is not None:
                out.append((m.start(), 6, m.end()))
        for m in LONG_BASE64.finditer(text):
            raw = from_base64(m[0])
            if raw:
                kind = 3 if raw[0] == 0x30 and is_private_der(raw) else 4 if is_private_ssh(raw) else 0
                if kind:
                    out.append((m.start(), kind, m.end()))
        for m in WRAPPED.finditer(text):
            for end in {m.end(), m.start() + m[0].rfind("\n")} if "\n" in m[0] else ():
                raw = from_base64("".join(text[m.start():end].split()))
                if raw and (kind := 3 if is_private_der(raw) else 4 if is_private_ssh(raw) else 0):
                    out.append((m.start(), kind, len(text[:end].rstrip()) if end < m.end() else end))
        for m in LONG_HEX.finditer(text):
            if len(m[0]) % 2 == 0:
                raw = bytes.fromhex(m[0])
                kind = 3 if raw[0] == 0x30 and is_private_der(raw) else 4 if is_private_ssh(raw) else 0
                if kind:
                    out.append((m.start(), kind, m.end()))
    return sorted(set(out))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kinds array<string>, starts array<long>, ends array<long>) of each row, by start and kind."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(b: pa.RecordBatch) -> dict:
        found = [sorted(base_spans(t) + confirmed_spans(t)) for t in b.column(1).fill_null("").to_pylist()]
        return {"doc_id": b.column(0), "kinds": pa.array([[KINDS[k] for _, k, _ in x] for x in found], pa.list_(pa.string())),
                "starts": pa.array([[s for s, _, _ in x] for x in found], pa.list_(pa.int64())),
                "ends": pa.array([[e for _, _, e in x] for x in found], pa.list_(pa.int64()))}

    return arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, kinds array<string>, starts array<long>, ends array<long>", ["doc_id", "text"])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = "transform(arrays_zip(kinds, starts, ends), x -> concat_ws(':', x.kinds, x.starts, x.ends))"
    base = "filter(arrays_zip(kinds, starts, ends), x -> x.kinds in ('assign', 'access', 'hex'))"
    count = [F.expr(f"size(filter(kinds, k -> k = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *count,
        F.sha2(F.expr(f"array_join(transform({base}, x -> concat_ws(':', x.kinds, x.starts, x.ends)), ',')"), 256).alias("base_sha256"),
        F.expr(f"array_join({spans}, ',')").alias("spans"))
