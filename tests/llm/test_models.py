"""Operators 1, 3 and 6: exact parts against definitions, models by held-out accuracy and as probabilities."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lm, quality, toxicity
from millrace.llm.common import table
from tests.llm.fixtures import documents, texts

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, label, cut, least", [(toxicity.op1_toxicity, "toxic", 0.5, 0.93), (quality.op6_quality, "quality", 0.3, 0.95)])
def test_held_out_accuracy(spark, query, label, cut, least):
    labels = table(spark, DATA, "labels").select("doc_id", label)
    rows = query(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_edge_cases(spark, module, label):
    docs = documents(spark)
    for labels in ([], [(1, None), (2, 1)], [(1, 0), (1, 1), (2, 0), (3, 1), (6, 0), (None, 1), (999, 1)]):
        own = spark.createDataFrame(labels, f"doc_id long, {label} int")
        got = module.score(docs, module.fit(docs, own)).collect()
        assert len(got) == len(texts()) and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), module.fit(docs, own)).count() == 0


def test_grammar_weighs_clauses():
    m = toxicity.Model({w: toxicity.SEED for w in toxicity.INSULTS}, {}).ready()
    s = lambda t: m.features(t)[0]
    assert s("You are an idiot.") > s("An idiot.") > s("Not an idiot.") > 0
    assert s("She said an idiot.") < s("An idiot.") and s('The "idiot" part.') < s("An idiot.")
    assert s("I will kill you.") > s("Kill the lights.") and s("nothing here") == 0
    assert s("idiotic") == m.features("Idiotic")[0] and m.features("")[0] == 0


def test_composition_equals_running_all_parts():
    g = toxicity.grammar()
    states, state = [0] * len(g.parts), g.start
    for symbol in "YOOINOOIRITMOOTQIQIYIIY":
        steps = [p.go(s, symbol) for p, s in zip(g.parts, states)]
        states = [s for s, _, _ in steps]
        state, factor, bonus = g.go(state, symbol)
        assert list(state) == states and factor == pytest.approx(math.prod(f for _, f, _ in steps)) and bonus == pytest.approx(sum(b for _, _, b in steps))


def test_each_transducer_counts():
    w = lambda tape: toxicity.grammar().weight([(c, 1.0 if c in "IT" else 0.0) for c in tape])
    assert w("I") == 1 and w("II") == pytest.approx(2.25) and w("YI") == pytest.approx(1.3) and w("IOY") == pytest.approx(1.3) and w("IOOOY") == 1
    assert w("NI") == pytest.approx(0.35) and w("NOOOI") == 1 and w("RI") == 0.5 and w("QIQ") == 0.5 and w("QOQI") == 1 and w("T") == pytest.approx(0.1) and w("MT") == 1


def test_clauses_are_read_whole():
    m = toxicity.Model({w: toxicity.SEED for w in toxicity.INSULTS}, {}).ready()
    far = "she said " + "word " * 1000 + "idiot"
    assert m.clause(far) == 0.5 * toxicity.SEED and list(m.clauses(far + ". Fine. An idiot, no?")) == [far, " an idiot"]
    assert list(m.clauses("idiot. idiot")) == ["idiot", " idiot"] and list(m.clauses("anidiot")) == [] and len(list(m.clauses("idiot, " * 20_000))) == 20_000


def test_paths_decide_where_words_do_not():
    """Toxic texts hold a word three times, others once: sums over paths tell them apart, the strongest word does not."""
    r = np.random.default_rng(5)
    common = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    own = lambda n: " ".join(r.permutation([*r.choice(common, 60), *["zorgle"] * n]))
    texts_, y = [own(4) for _ in range(60)] + [own(k % 2) for k in range(400)], [1] * 60 + [0] * 400
    words, stems = toxicity._induce(texts_, y)
    m = toxicity.Model(words, stems).ready()
    x = np.array([(1.0, *m.features(t)) for t in texts_])
    m.weights = tuple(toxicity.logistic(x, np.array(y, float), np.array(m.weights), 0.1))
    assert all((m.score(own(4)) >= 0.5) and (m.score(own(1)) < 0.5) and m.score(own(0)) < 0.5 for _ in range(20))


def test_gradients_by_finite_differences():
    r = np.random.default_rng(0)
    t = [b"some words here and there " * 30, b"", b"A!! B!! C!!", b"x"]
    x, bag = quality.passages(t)
    assert len(bag) == 5 and (np.diff(bag) >= 1).all() and x[bag[1]].sum() == 0
    p = {k: r.normal(0, 0.5, s) for k, s in {"W": (quality.N_FEATURES, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "o": (4,), "c": (1,)}.items()}
    m, y = quality.Model(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES), p), np.array([1.0, 0, 1, 0])
    loss = lambda: np.mean(np.logaddexp(0, m.forward(x, bag)["logit"]) - y * m.forward(x, bag)["logit"])
    g = m.gradients(x, bag, y)
    for k, q in p.items():
        i = tuple(r.integers(0, n) for n in q.shape)
        q[i] += 1e-5
        up = loss()
        q[i] -= 2e-5
        down = loss()
        q[i] += 1e-5
        assert g[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_passages_do_not_depend_on_neighbours():
    t = [(x or "").encode() for _, x in texts()]
    x, bag = quality.passages(t)
    for k, one in enumerate(t):
        own, b = quality.passages([one])
        assert np.allclose(own, x[bag[k]:bag[k + 1]]) and b[-1] == bag[k + 1] - bag[k]


def tokens(t):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]


@pytest.mark.parametrize("frequent", [1 << 17, 5, 0])
def test_base_scores(spark, frequent):
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 9000]
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n,
                   round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    got = lm.scores(documents(spark, rows), mixer_rows=3, frequent=frequent).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.bits_per_byte) for r in got)


def test_no_training_texts(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    got = lm.scores(documents(spark, [(i, "some words") for i in ids])).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in got)
    assert lm.scores(documents(spark, [])).count() == 0


def mixer(sample):
    code = lm.Code(lm.pair_counts(sample))
    totals = np.zeros(2 * lm.BASE[-1], np.int32)
    lm.add_counts(sample, code, totals)
    return lm.Mixer(code, lm.odds_of(totals))


def test_what_may_come_next_sums_to_one():
    """Over the end and every next byte, with the weights that stand at that place."""
    m = mixer([(t or "").encode() for _, t in texts()[:6]])
    m.final = np.linspace(-0.3, 0.5, lm.HEIGHTS).astype(np.float32)

    def chance(text, place):
        d = lm.Decisions([text], m.code)
        i, j = d.at[place], d.at[place + 1]
        s = np.stack([m.odds[base:].take(x[i:j]) for x, base in zip(d.slots, lm.BASE)])
        x = (m.weights[:, lm.gates(d.depth[i:j], s[-2], s[-1])] * s).sum(axis=0).clip(-8, 8)
        x = (x + m.final[(x * 2 + 16.5).astype(int)]) * (2 * d.bit[i:j] - 1)
        return np.prod(1 / (1 + np.exp(-x.astype(float))))

    for head in (b"", b"an er", b"the ", b"\xc3"):
        total = chance(head, len(head)) + sum(chance(head + bytes([c]), len(head)) for c in range(256))
        assert total == pytest.approx(1, abs=1e-5)
    text = b"an er the"
    assert m.run([text])[0][0] == pytest.approx(sum(math.log10(chance(text, k)) for k in range(len(text) + 1)), rel=1e-4)


def test_online_weights_see_only_the_past():
    m = mixer([(t or "").encode() for _, t in texts()[:8]])
    a = (texts()[3][1] * 20).encode()
    whole = m.run([a, b"other", a])[0]
    assert whole[0] == pytest.approx(whole[2]) and m.run([a])[0][0] == pytest.approx(whole[0])
    cost = lambda t: m.costs(d := lm.Decisions([t], m.code))[0][:d.at[np.searchsorted(lm.steps_of(np.arange(len(t) + 1)), 2)]]
    assert (cost(a) == cost(a[:200] + b"quite another end" * 40)).all()


def test_short_texts_are_refined(monkeypatch):
    """Texts of some hundred bytes: weights that move after 32 symbols cost fewer bits than fixed ones."""
    sample = [(t or "").encode() for _, t in texts()[:12]]
    m, short = mixer(sample), [t[:600] for t in sample[6:]]
    moved = m.run(short)[0].sum()
    monkeypatch.setattr(lm, "RATE", 0.0)
    monkeypatch.setattr(lm, "RATE_FINAL", 0.0)
    assert moved > m.run(short)[0].sum()


def test_counts_help(spark):
    rows = table(spark, DATA, "documents").where(F.length("text") < 5000).select("doc_id", "text").limit(300).collect()
    train, test = [r.text.encode() for r in rows[:250]], [r.text.encode() for r in rows[250:]]
    m = mixer(train)
    blank = lm.Mixer(m.code, np.zeros_like(m.odds))
    assert m.run(test)[0].sum() > 0.7 * blank.run(test)[0].sum()


def chunked(text):
    """Chunks as the docstring has them: (four words before or None, content with the end)."""
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    cuts, ahead = [0], [None]
    for k in range(3, len(words)):
        poly = lm.Poly(lm.Poly(lm.symbols(np.frombuffer(text, np.uint8))).slices(*map(np.array, zip(*words[k - 3:k + 1]))), 0x9FB21C651E98DF25)
        if int(poly.slices(np.array([0]), np.array([4]))[0]) >> (64 - lm.CUT) == 0:
            cuts.append(words[k][1])
            ahead.append(tuple(text[a:b] for a, b in words[k - 3:k + 1]))
    return list(zip(ahead, [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])], [False] * (len(cuts) - 1) + [True]))


def test_chunk_table_against_brute_force(spark):
    rows = [(i, t) for i, t in texts() if t is None or len(t) < 9000]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    own = [chunked((t or "").encode()) for _, t in rows]
    c = Counter(x for x, h in zip(own, out) if not h for x in x)
    n = Counter(x[0] for x, h in zip(own, out) if not h for x in x)
    got = {(r.doc_id, r.bytes): r for r in lm.scores(documents(spark, rows), mixer_rows=3).withColumn("bytes", F.round(F.col("bit_score"), 6)).collect()}
    assert len({k[0] for k in got}) > 20 and sum(len(x) > 1 for x in own) > 5
    seen = 0
    for (i, _), x, h in zip(rows, own, out):
        mine, ctx = Counter(x), Counter(y[0] for y in x)
        hit = [c[y] - (0 if h else mine[y]) > 0 for y in x]
        r = next(v for k, v in got.items() if k[0] == i)
        if all(n[y[0]] - (0 if h else ctx[y[0]]) <= 0 for y in x):
            assert r.score == pytest.approx(r.bit_score)
        if all(hit):
            seen += 1
            assert r.score > 0.5 * r.bit_score or r.score > -3
    assert seen >= 2  # the copies


def test_all_training_rows_are_counted(spark):
    """Repeated and null ids included, whatever rows the weights were learnt on."""
    rows = [(1, t) for _, t in texts()[:8]] + [(None, t) for _, t in texts()[8:14]]
    every = [(t or "").encode() for _, t in rows]
    m, want = lm.fit(documents(spark, rows).select("doc_id", "text"), mixer_rows=3), mixer(every)
    assert (m.code.nodes == want.code.nodes).all() and (m.odds == want.odds).all()
    assert (m.weights != want.weights).any() and np.isfinite(m.weights).all()


def test_known_words_against_a_dictionary():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(-2**63, 2**63 - 1, 5000))
    c = rng.integers(1, 100, len(h))
    asked = np.concatenate((rng.choice(h, 3000), rng.integers(-2**63, 2**63 - 1, 3000), np.array([0, -1, 2**63 - 1, -2**63])))
    for n in (0, 1, len(h)):
        want = dict(zip(h[:n].tolist(), c[:n].tolist()))
        assert lm.Known(h[:n], c[:n]).counts(asked).tolist() == [want.get(x, 0) for x in asked.tolist()]
    assert not len(lm.Known(h, c).counts(h[:0]))


def test_lm_counts_the_decisions_that_it_codes_without_ordering_them():
    texts = [b"", b"one", b"the rain " * 40, "größer é".encode() * 700]
    code = lm.Code(lm.pair_counts(texts))
    coded, counted = lm.Decisions(texts, code), lm.Decisions(texts, code, stepwise=False)
    assert len(coded.cuts) > 3 and not hasattr(counted, "order")
    back = np.argsort(coded.order[coded.owner], kind="stable")
    assert all((a[back] == b).all() for a, b in zip([*coded.slots, coded.bit], [*counted.slots, counted.bit]))


def odd_bytes():
    return [b"", b"one", b"", b"the rain " * 40, "größer é".encode() * 700, b" ", b"ab", b"abcd e", b"\xff\x00", *[(t or "").encode() for _, t in texts()[:10]]]


def test_lm_contexts_against_slices():
    sample = odd_bytes()
    c = lm.Contexts(sample, lm.Code(lm.pair_counts(sample)))
    for k, (order, bits) in enumerate(zip(lm.ORDERS, lm.TABLE_BITS)):
        at, start = 0, []
        for t in sample:
            for i in range(len(t) + 1):
                start.append(at + (max(0, i - order) if order else max((j + 1 for j in range(i - 1, max(-1, i - 60), -1) if lm.SPACE[t[j]]), default=0)))
            at += len(t) + 1
        if not order:  # words of some dozen bytes only
            assert max(len(w) for t in sample for w in re.split(rb"[ \t-\r]", t) if len(t) < 5000) < 60
        want = c.poly.slices(np.array(start), np.arange(at)) >> np.uint64(64 - bits)
        assert (lm._slots(c.packed, k) == want.view(np.int64)).all()


@pytest.mark.parametrize("counted", [1, 3000, 1 << 20])
def test_lm_counts_alike_symbols_at_once(monkeypatch, counted):
    """The same tables as decision by decision, and copies are spelled out once for each buffer."""
    monkeypatch.setattr(lm, "COUNTED", counted)
    monkeypatch.setattr(lm, "GROUP", 1000)
    sample = odd_bytes()
    code = lm.Code(lm.pair_counts(sample))
    want, got = np.zeros(2 * lm.BASE[-1], np.int32), np.zeros(2 * lm.BASE[-1], np.int32)
    d = lm.Decisions(sample, code, stepwise=False)
    for slots, base in zip(d.slots, lm.BASE):
        np.add.at(want, 2 * (base + slots) + d.bit, 1)
    lm.add_counts(sample, code, got)
    assert (got == want).all()
    lm.add_counts([], code, got)
    spelled, plain = [], lm._spelling
    monkeypatch.setattr(lm, "_spelling", lambda s, code: (spelled.append(len(s)), plain(s, code))[1])
    lm.add_counts(sample * 20, code, got)
    assert (got == 21 * want).all() and (counted < 1 << 20 or sum(spelled) <= len(lm.ORDERS) * len(d.s))


def test_lm_scores_do_not_depend_on_company(monkeypatch):
    """Texts are coded by falling length; scores and chunks come back in the order of the texts."""
    monkeypatch.setattr(lm, "GROUP", 9000)
    sample = odd_bytes() + [b"the rain " * n for n in (3, 4, 11, 25, 60, 240, 480)]
    m = mixer(sample)
    score, (doc, context, content, cost) = m.run(sample)
    assert (np.diff(doc) >= 0).all() and set(doc) == set(range(len(sample)))
    for k, t in enumerate(sample):
        one, (_, *own) = m.run([t])
        assert score[k] == one[0] and all((a == b[doc == k]).all() for a, b in zip(own, (context, content, cost)))
