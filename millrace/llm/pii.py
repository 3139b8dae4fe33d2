"""Personal data by weak supervision (operator 10).

Base kinds are patterns over the whole text, leftmost and non-overlapping for each kind; matches
that fail their test are dropped without another try inside them:

- email: `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`;
- ip: four dotted numbers of at most 255;
- card: `[0-9]([\\x20-]?[0-9])+` of 13 to 19 digits that pass the Luhn test;
- phone: `\\+[0-9][\\x20().0-9-]+[0-9]` of 9 to 15 digits.

Further spans (phone numbers without a country or run into the next number, spelled-out addresses,
account and social numbers, titled names, unchecked cards) are proposed by looser patterns. Labelers vote for, against or not at all
on every candidate, base ones included: other personal data close by, a checksum or the rules of
the number, gazetteers (mail providers and top-level domains, calling codes, given names, country
codes), words for and against in the context, and the way the span stands in its line. Expectation-maximisation over the counts of vote patterns of
*all* documents estimates each labeler's reliability and each pattern's probability; a logistic
span classifier over kind, votes and shape is then fitted to these probabilities, weighted by the
counts, and decides on the further spans. Base spans always stay.

One pass over the texts leaves a small table of candidates; counts and decisions run over that.
Patterns are finite, so what reaches the driver does not grow with the documents.

Defined cases: null counts as empty; repeated rows stay repeated; without candidates nothing is
fitted; other columns are ignored, whatever their names. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import arrow_map, drop_staged, sliced, stage, table

KINDS = ("email", "ip", "card", "phone", "email_spelled", "phone_local", "account", "social", "name", "card_unchecked")
BASE = 4  # the first so many kinds are base kinds
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{2,63}\x20?[\[({]\x20?dot\x20?[\])}]\x20?[A-Za-z]{2,24}\b", re.I)
PHONE_LOCAL = re.compile(r"(?<![0-9+.\w-])(?:\+?1[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9\w-])")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\b\.?\x20(?:[A-Z][^\W\d_]{1,20}\x20?){1,3}")
DIGIT = re.compile(r"[0-9]")
PROVIDERS = frozenset("gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com ymail.com icloud.com me.com aol.com proton.me protonmail.com "
                      "fastmail.com zoho.com mail.com web.de gmx.de gmx.net t-online.de freenet.de orange.fr free.fr laposte.net sfr.fr wanadoo.fr libero.it "
                      "terra.es yahoo.es yahoo.fr yahoo.de hotmail.es hotmail.fr comcast.net verizon.net btinternet.com qq.com 163.com yandex.ru mail.ru".split())
TOP = frozenset("com org net edu gov mil int io de at ch fr be lu nl es pt it uk ie dk se no fi pl cz eu us ca mx br ar jp cn in au nz ru".split())
#: country calling codes of one and two digits; those that begin with the other pairs have three
CALLING_1, CALLING_2 = "17", frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
GIVEN = frozenset(
    "james mary john robert patricia jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah karen charles lisa daniel nancy "
    "matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle kenneth carol kevin amanda brian dorothy george "
    "hans peter wolfgang klaus jürgen uwe dieter günther stefan andreas greta anna petra monika sabine ursula renate karin brigitte heike lukas jonas lena "
    "pierre jean jacques michel philippe alain bernard marie jeanne françoise monique catherine nathalie isabelle sylvie camille louis hugo "
    "josé antonio manuel francisco juan luis carlos jesús javier miguel carmen maría josefa isabel dolores pilar teresa lucía ana laura".split())
COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split())
FOR = re.compile(r"\b(?:e-?mail|mail|phone|tel|telephone|mobile|call|fax|contact|card|visa|iban|account|konto|ssn|social|address|ip|host|name|born|patient|customer)\b", re.I)
AGAINST = re.compile(r"\b(?:version|release|isbn|issn|order|invoice|ticket|serial|part|section|figure|page|example|sample|test|sku)\b", re.I)
CONTEXT = 40  # characters to either side that context labelers read
BESIDE = 30  # characters to either side within which other personal data speak for a span
LABELERS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the characters before each `@` back to the last match, a domain behind it."""
    out, upto = [], 0
    at = text.find("@")
    while at >= 0:
        s = at
        while s > upto and LOCAL.match(text, s - 1):
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            upto = m.end()
        else:
            upto = max(upto, at + 1)
        at = text.find("@", max(upto, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def further_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that do not touch a base span."""
    found = []
    if any(c in text for c in "[({"):
        low = text.lower()
        if "at" in low and "dot" in low:
            found += [(4, *m.span()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        found += [(5, *m.span()) for m in PHONE_LOCAL.finditer(text)]
        found += [(6, *m.span()) for m in ACCOUNT.finditer(text)]
        found += [(7, *m.span()) for m in SOCIAL.finditer(text)]
        found += [(9, *m.span()) for m in CARD.finditer(text) if 13 <= len(digits_of(m[0])) <= 19]
    found += [(8, m.start(), m.start() + len(m[0].rstrip())) for m in NAME.finditer(text)]
    starts, ends = _merged([(s, e) for _, s, e in base])
    return [x for x in found if (k := bisect_left(ends, x[1] + 1)) == len(ends) or starts[k] >= x[2]]


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def calling_code(d: str) -> bool:
    return d[:1] in CALLING_1 or d[:2] in CALLING_2 or d[:2] in ("21", "22", "23", "24", "25", "26", "29", "35", "37", "38", "42", "50", "59", "67", "68", "69", "80", "85", "88", "96", "97", "99")


def votes(text: str, kind: int, s: int, e: int, beside: bool = False) -> tuple[int, ...]:
    """Each labeler's vote: 2 for, 1 against, 0 none. ``beside``: other personal data stand close by."""
    span = text[s:e]
    d = digits_of(span)
    company = 2 if beside else 0
    if kind in (2, 9):
        check = 2 if luhn(d) and len(set(d)) > 2 else 1
    elif kind == 6:
        check = 2 if iban_ok(span) else 1
    elif kind == 7:
        check = 1 if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000" else 2
    elif kind in (3, 5):
        check = 1 if len(set(d)) <= 2 else 0
    elif kind == 1:
        check = 1 if any(p != "0" and p.startswith("0") for p in span.split(".")) else 2
    elif kind in (0, 4):
        check = 2 if len(span) <= 254 and ".." not in span else 1
    else:
        check = 0
    if kind == 0:
        domain = span.rpartition("@")[2].lower()
        known = 2 if domain in PROVIDERS or domain.rpartition(".")[2] in TOP else 0
    elif kind == 3:
        known = 2 if calling_code(d) else 1
    elif kind == 5:  # areas and exchanges begin with 2 to 9, but not in the fictional numbers of some examples
        known = 2 if span[0] == "+" or d[-7] > "1" and d[-10] > "1" else 1
    elif kind == 4:
        known = 2 if re.split(r"[^A-Za-z]+", span)[-1].lower() in TOP else 0
    elif kind == 6:
        known = 2 if span[:2] in COUNTRIES else 0
    elif kind == 8:
        known = 2 if any(w.lower() in GIVEN for w in span.split()) else 0
    elif kind == 1:
        known = 1 if span.startswith(("0.", "127.", "255.")) else 0
    else:
        known = 0
    near = text[max(0, s - CONTEXT):s] + " " + text[e:e + CONTEXT]
    before, after = text[s - 1:s], text[e:e + 1]
    alone = 2 if (not before or not (before.isalnum() or before in "._-/#")) and (not after or not (after.isalnum() or after in "_-/#@")) else 1
    return company, check, known, 2 if FOR.search(near) else 0, 1 if AGAINST.search(near) else 0, alone


def shape(text: str, s: int, e: int) -> int:
    """Length class of a span: up to 10, 16, 24 characters, or more."""
    return sum(e - s > n for n in (10, 16, 24))


def code_of(kind: int, v: tuple[int, ...], form: int) -> int:
    code = kind
    for x in v:
        code = code * 3 + x
    return code * 4 + form


def decode_code(code: int) -> tuple[int, tuple[int, ...], int]:
    code, form = divmod(code, 4)
    v = []
    for _ in range(LABELERS):
        code, x = divmod(code, 3)
        v.append(x)
    return code, tuple(reversed(v)), form


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, pattern code) of base and further spans."""
    base = base_spans(text)
    both = base + further_spans(text, base)
    if not both:
        return []
    starts, ends = _merged([(s, e) for _, s, e in base])

    def beside(s: int, e: int) -> bool:
        k = bisect_left(ends, max(0, s - BESIDE))  # the first that ends no further before
        while k < len(starts) and starts[k] < e + BESIDE:
            if ends[k] <= s or starts[k] >= e:
                return True
            k += 1
        return False

    return [(k, s, e, code_of(k, votes(text, k, s, e, beside(s, e)), shape(text, s, e))) for k, s, e in both]


def expectation(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Probability of each pattern that its spans are personal data, by EM over labelers' reliabilities.

    A labeler's reliability is how it votes on true and on false spans, with a weak prior that
    voting for is likelier on true ones; kinds share reliabilities and have their own prior.
    """
    codes = sorted(counts)
    parsed = [decode_code(c) for c in codes]
    kind = np.array([p[0] for p in parsed])
    v = np.array([p[1] for p in parsed])
    n = np.array([counts[c] for c in codes], float)
    truth = np.where(kind < BASE, 0.9, 0.5)
    onehot = (v[:, :, None] == np.arange(3)).astype(float)
    prior = np.array([[2.0, 2.0, 1.0], [2.0, 1.0, 2.0]])  # false: votes (none, against, for); true
    for _ in range(rounds):
        before = truth
        rely = []
        for y, p in ((0, 1 - truth), (1, truth)):
            mass = ((n * p)[:, None, None] * onehot).sum(axis=0) + 5 * prior[y]
            rely.append(np.log(mass / mass.sum(axis=1, keepdims=True)))
        share = np.array([((n * truth)[kind == k].sum() + (45 if k < BASE else 5)) / (n[kind == k].sum() + (50 if k < BASE else 10)) for k in range(len(KINDS))])
        odds = np.log(share / (1 - share))[kind] + (onehot * (rely[1] - rely[0])).sum(axis=(1, 2))
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(truth - before).max() < 1e-9:
            break
    return dict(zip(codes, truth.tolist()))


def _features(code: int) -> np.ndarray:
    kind, v, form = decode_code(code)
    x = np.zeros(1 + len(KINDS) + 2 * LABELERS + 4)
    x[0] = 1
    x[1 + kind] = 1
    for i, vote in enumerate(v):
        if vote:
            x[1 + len(KINDS) + 2 * i + vote - 1] = 1
    x[1 + len(KINDS) + 2 * LABELERS + form] = 1
    return x


def classify(counts: dict[int, int]) -> dict[int, float]:
    """The span classifier's probability for each pattern, fitted to EM's, weighted by counts."""
    if not counts:
        return {}
    soft = expectation(counts)
    codes = sorted(counts)
    x = np.array([_features(c) for c in codes])
    n = np.array([counts[c] for c in codes], float)
    t = np.array([soft[c] for c in codes])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - t)) + 0.1 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def _columns(found: list[list[tuple[int, int, int, int]]]) -> dict[str, pa.Array]:
    kind = {"kind": (0, pa.int32()), "s": (1, pa.int64()), "e": (2, pa.int64()), "code": (3, pa.int32())}
    return {name: pa.array([[y[i] for y in x] for x in found], pa.list_(t)) for name, (i, t) in kind.items()}


def spotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, c array<struct<kind,s,e,code>>) of each row, staged: one pass over the texts."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def one(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column(0)} | _columns([candidates(t) for t in b.column(1).fill_null("").to_pylist()])

    rows = arrow_map(src, one, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, kind array<int>, s array<long>, e array<long>, code array<int>", ["doc_id", "text"])
    return stage(rows.select("doc_id", F.arrays_zip("kind", "s", "e", "code").alias("c")), "spans")


def accepted(rows: DataFrame) -> list[int]:
    """The patterns of further spans that the classifier takes, learnt from all candidates."""
    counted = rows.select(F.explode("c").alias("c")).groupBy("c.code").count().collect()  # finite: kinds, votes, shapes
    p = classify({r.code: r["count"] for r in counted})
    return sorted(c for c, x in p.items() if x >= 0.5 and decode_code(c)[0] >= BASE)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,s,e,code>>) of each row: base spans and accepted further ones."""
    rows = spotted(docs, id_col, text_col)
    take = F.array(*[F.lit(c) for c in accepted(rows)]).cast("array<int>")
    return rows.select("doc_id", F.filter("c", lambda x: (x["kind"] < BASE) | F.array_contains(take, x["code"])).alias("spans"))


def _digest(spans, kinds: int):
    name = F.array(*[F.lit(k) for k in KINDS])
    own = F.array_sort(F.transform(F.filter(spans, lambda x: x["kind"] < kinds), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["s"], x["e"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = [F.expr(f"size(filter(spans, x -> x.kind = {k}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *count, F.sha2(_digest("spans", BASE), 256).alias("base_sha256"), _digest("spans", len(KINDS)).alias("spans"))


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each stretch that spans cover becomes the name of the first of them, in angle brackets."""
    out, upto = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= upto:
            out += [text[upto:s], f"<{KINDS[k].upper()}>"]
        upto = max(upto, e)
    return "".join([*out, text[upto:]])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data gives way to the name of its kind; n_chars follows the text."""
    found = spotted(docs)
    take = frozenset(accepted(found))
    drop_staged(found)
    schema, at = docs.schema, docs.columns.index("text")
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches):
        for b in sliced(batches):
            texts = [None if t is None else redact_text(t, [(k, s, e) for k, s, e, c in candidates(t) if k < BASE or c in take]) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if n_at >= 0:
                cols[n_at] = pa.array([None if t is None and n is None else len(t or "") for t, n in zip(texts, b.column(n_at).to_pylist())], b.schema.field(n_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
