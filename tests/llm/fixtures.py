"""Small documents with the awkward cases: nulls, empties, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, th string, fp string, row string, spans string, score string, _kept string, _bad string, _d string, component_id string")


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = "an er ing the of to re st ha on le ti ou en".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    base = [prose(i, 40 + 17 * i) for i in range(12)]
    passage = prose(99, 70)
    out: list[tuple[int | None, str | None]] = list(enumerate(base))
    out += [(20, base[3]), (21, base[3]), (22, base[5] + " more"), (23, None), (24, ""), (25, "   \n\t "), (None, base[4]), (27, "é漢字 🙂 " * 30), (28, "one two"), (28, "one two"),
            (30, f"{base[6]} {passage} {base[7]}"), (31, f"{passage} {base[8]}"), (32, f"{base[9]}\n{passage}"), (33, "x" * 5000), (34, prose(7, 6000)), (35, "a " * 400)]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *["clash"] * 9) for i, t in rows], SCHEMA)
