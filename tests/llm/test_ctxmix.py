import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import ctxmix


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["the", "on", "er", "tion", "re", "né", "ßa", "qu"]
    words = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(200)]
    return [rng.choice((" ", "\n", " \t")).join(rng.choices(words, k=rng.randrange(0, 80))) for _ in range(n)]


def learned(spark, train, bits=13, parts=3):
    """The model of some texts, as score() makes it."""
    t = ctxmix.Tokens([ctxmix.normalise(x.encode()) for x in train])
    letters = np.bincount(t.raw, minlength=256)
    letters[32] += letters[10]
    letters[10] = 0
    layout = ctxmix.Layout(np.bincount(t.pair, minlength=1 << 16), letters, bits)
    keys, first, n = np.unique(t.key[t.words], return_index=True, return_counts=True)
    cls, often = layout.codes[0].symbol, n > 1
    known = np.bincount(cls[t.pair[t.words][first[often]]], n[often], minlength=64)
    spelled = np.bincount(cls[t.pair[t.words][first[~often]]], n[~often], minlength=64)
    df = spark.createDataFrame([(x,) for x in train], "text string").repartition(parts)
    return ctxmix.learn(df, layout, ctxmix.Words(keys[often], n[often]), spelled, known)


def plain_symbols(mixer, text):
    """(code, symbol, slots, token) of a text, one after the other, from the text alone."""
    classes, letters = mixer.layout.codes
    bits, hashed = mixer.layout.bits, lambda x, b: ((x & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - b
    words = text.split()
    keys = [ctxmix.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) for w in words]
    pairs = [(b" " + w)[-2:] if len(w) == 1 else w[-2:] for w in words] + [b"\n\n"]
    cls = [int(classes.symbol[p[0] << 8 | p[1]]) for p in pairs]
    for i, c in enumerate(cls):
        one, two, three = (cls[i - k] if i >= k else classes.always for k in (1, 2, 3))
        word = int(keys[i - 1][0]) >> 64 - (bits - 1) if i else 0
        yield 0, c, [one | two << 6, hashed((one | two << 6 | three << 12) + 1, bits - 1), word], i
    for i, w in enumerate(words):
        if mixer.lexicon.find(keys[i].view(np.int64))[0]:
            continue
        stem = (w if cls[i] == classes.escape else w[:-2]) + b" "
        for j, byte in enumerate(stem):
            one, two, three, four = (stem[j - k] if j >= k else 32 for k in (1, 2, 3, 4))
            near = one | two << 8
            slots = [hashed(near + 1, 14), hashed((near | three << 16 | four << 24) + 1, bits), hashed(near << 6 | cls[i], 16)]
            yield 1, int(letters.symbol[byte]), slots, i


def plain_bits(mixer, text, own):
    """Bits of each token, one decision after the other, by the rules."""
    out = [0.0] * (len(text.split()) + 1)
    lanes = {0: [[0.0] * 3, [0.0] * 3, 0], 1: [[0.0] * 3, [0.0] * 3, 0]}
    for k, s, slots, token in plain_symbols(mixer, text):
        code, lane = mixer.layout.codes[k], lanes[k]
        out[token] += 8 * (k == 1 and s == code.escape)
        for d in range(int(code.length[s])):
            node, turn = int(code.node[s, d]), int(code.turn[s, d])
            q = [int(mixer.tables[own * (1 + turn), o + slot * 64 + node]) for o, slot in zip(mixer.layout.offsets[3 * k :], slots)]
            w = mixer.weights[ctxmix.GATES * k + 16 * min(d, 5) + 4 * (q[1] & 3) + (q[2] & 3)]
            x = [(v >> 2) / 4 for v in q]
            sign = 1 if turn else -1
            out[token] += math.log2(1 + math.exp(-sign * (w[3] + sum((w[i] + lane[0][i]) * x[i] for i in range(3)))))
            wrong = sign / (1 + math.exp(sign * (w[3] + sum((w[i] + lane[0][i]) * x[i] for i in range(3)))))
            lane[1], lane[2] = [p + wrong * z for p, z in zip(lane[1], x)], lane[2] + 1
            if lane[2] % ctxmix.STEP == 0:
                lane[0], lane[1] = [o + ctxmix.RATE * p for o, p in zip(lane[0], lane[1])], [0.0] * 3
    for i, w in enumerate(text.split()):
        key = ctxmix.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])).view(np.int64)
        count, pair = int(mixer.lexicon.find(key)[0]), (b" " + w)[-2:]
        c = int(mixer.layout.codes[0].symbol[pair[0] << 8 | pair[1]])
        out[i] += mixer.in_bits[c] - math.log2((count - own) / (mixer.known[c] - own)) if count else mixer.out_bits[c]
    return out


@pytest.mark.parametrize("own", [False, True])
def test_mixing_is_the_stated_rule(spark, monkeypatch, own):
    monkeypatch.setattr(ctxmix, "STEP", 16)
    train = texts(300)
    mixer = learned(spark, train)
    some = train[:8] if own else [*texts(6, 3), "", "日本 xyz", "the " * 300, "a"]
    some = [ctxmix.normalise(t.encode()) for t in some]
    got = mixer.bits(ctxmix.Tokens(some), np.full(len(some), own))
    want = [x for t in some for x in plain_bits(mixer, t, own)]
    assert got.tolist() == pytest.approx(want, rel=1e-4, abs=1e-4)
    alone = [x for t in some for x in mixer.bits(ctxmix.Tokens([t]), np.array([own])).tolist()]
    assert alone == pytest.approx(got.tolist(), rel=1e-4, abs=1e-4)


def test_words_that_share_a_place_are_found_without_a_search(monkeypatch):
    rng = np.random.default_rng(5)
    near = np.array([(7 << 44) + k for k in range(1, 6)] + [-(3 << 44) + k for k in range(4)], np.int64)
    keys = np.unique(np.concatenate([near, rng.integers(-(2**63), 2**63 - 1, 30_000)]))
    counts = np.arange(1, len(keys) + 1)
    want = dict(zip(keys.tolist(), counts.tolist()))
    asked = np.concatenate([keys, near + 9, rng.integers(-(2**63), 2**63 - 1, 30_000), [0, 7 << 44]])

    def search(*_):
        raise AssertionError("a binary search a word")

    with monkeypatch.context() as patch:
        patch.setattr(np, "searchsorted", search)
        mixed = rng.permutation(len(keys))
        got = ctxmix.Words(keys[mixed], counts[mixed]).find(asked)
        none = ctxmix.Words(keys[:0], counts[:0]).find(asked)
    assert got.tolist() == [want.get(k, 0) for k in asked.tolist()] and not none.any()


def test_tables_count_all_training_text(spark):
    train = [*texts(60, 7), "rare " + "words beyond a prefix " * 120]
    mixer = learned(spark, train)
    counts = Counter((k, j, slot, s) for t in train for k, s, slots, _ in plain_symbols(mixer, ctxmix.normalise(t.encode())) for j, slot in enumerate(slots))
    for k, code in enumerate(mixer.layout.codes):
        for j in range(3):
            seen = sorted({slot for a, b, slot, _ in counts if (a, b) == (k, j)})
            table = np.array([[counts[k, j, slot, s] for s in range(64)] for slot in seen], np.float64)
            at = int(mixer.layout.offsets[3 * k + j]) + np.array(seen)[:, None] * 64 + np.arange(64)
            assert (mixer.tables[:, at] == code.logits(table)).all()


def test_gates_are_fitted_on_all_decisions(spark):
    train = texts(60, 7)
    mixer = learned(spark, train)
    x, y, gates = [], [], []
    for t in train:
        for k, s, slots, _ in plain_symbols(mixer, ctxmix.normalise(t.encode())):
            code = mixer.layout.codes[k]
            for d in range(int(code.length[s])):
                node, turn = int(code.node[s, d]), int(code.turn[s, d])
                q = [int(mixer.tables[1 + turn, o + slot * 64 + node]) for o, slot in zip(mixer.layout.offsets[3 * k :], slots)]
                x.append([*((v >> 3) / 2 + 0.125 for v in q), 1.0])
                y.append(turn)
                gates.append(ctxmix.GATES * k + 16 * min(d, 5) + 4 * (q[1] & 3) + (q[2] & 3))
    x, y, gates = np.array(x), np.array(y), np.array(gates)
    start = np.array([0.2, 0.4, 0.5, 0.0])
    for g in range(2 * ctxmix.GATES):
        z, t, w = x[gates == g], y[gates == g], start.copy()
        for _ in range(5):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 5 * np.eye(4), z.T @ (t - p) - 5 * (w - start))
        assert mixer.weights[g] == pytest.approx(np.clip(w, -2, 2), abs=1e-4)
    assert len(set(gates)) > 50 and not np.allclose(mixer.weights, start)


def test_tokens_of_a_column_are_those_of_normal_texts():
    rng = random.Random(6)
    odd = ["", None, " ", "A", "\tÀB  c\r\n", "x\x0b\x0cY\x08z\x0e ", "@[`{ AZaz"]
    odd += ["".join(rng.choices("aBZé日 \t\n\x00", k=rng.randrange(30))) for _ in range(500)]
    column = pa.array(["cut off", *odd])[1:]
    plain = [ctxmix.normalise((x or "").encode()) for x in odd]
    got, want = ctxmix.Tokens(column), ctxmix.Tokens(plain)
    for name in ("n", "ends", "words", "text", "place", "key", "pair"):
        assert getattr(got, name).tolist() == getattr(want, name).tolist()
    assert [bytes(got.raw[a:b]) for a, b in zip(got.starts, got.stops)] == [w for t in plain for w in t.split()]
    counted = [r for b in ctxmix._count_words(iter([pa.RecordBatch.from_arrays([column], names=["text"])])) for r in b.to_pylist()]
    assert {r["key"]: r["n"] for r in counted if r["kind"] == 2} == Counter(b"".join(plain))


def test_a_task_tallies_each_key_once(spark, monkeypatch):
    train = texts(60, 7)
    mixer, batch = learned(spark, train), pa.RecordBatch.from_arrays([pa.array(train)], names=["text"])
    want = Counter()
    for t in train:
        for k, s, slots, _ in plain_symbols(mixer, ctxmix.normalise(t.encode())):
            code = mixer.layout.codes[k]
            for d in range(int(code.length[s])):
                node, turn = int(code.node[s, d]), int(code.turn[s, d])
                q = [int(mixer.tables[1 + turn, o + slot * 64 + node]) for o, slot in zip(mixer.layout.offsets[3 * k :], slots)]
                key = ctxmix.GATES * k + 16 * min(d, 5) + 4 * (q[1] & 3) + (q[2] & 3)
                for v in q:
                    key = key << 5 | (v & 255) >> 3
                want[key << 1 | turn] += 1
    monkeypatch.setattr(ctxmix, "SLICE_BYTES", 4_000)  # several slices
    got = [(r["key"], r["n"]) for b in ctxmix._tally(iter([batch, batch]), mixer) for r in b.to_pylist()]
    assert got == sorted((k, 2 * n) for k, n in want.items())


def test_base_of_frequent_and_of_rare_words(spark, monkeypatch):
    rows = [*enumerate(texts(40)), (50, "rare " * 7 + "odd"), (51, "odd odd rare"), (20, "unheard unheard")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = lambda: sorted((r.doc_id, r.n_known, r.base_score) for r in ctxmix.score(df).collect())
    want = known()
    monkeypatch.setattr(ctxmix, "TERMS", 3)  # most counts are beyond the table
    monkeypatch.setattr(ctxmix, "HEAD", 4)  # and most words are joined
    for a, b in zip(known(), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])


def test_passages_depend_on_their_words_only():
    rng = random.Random(5)
    words = [f"w{rng.randrange(500)}" for _ in range(600)]
    t = ctxmix.Tokens([ctxmix.normalise(" ".join(x).encode()) for x in (words, ["odd", *words[50:]], words[:3], [])])
    first, key = t.passages()
    by_text = [[int(k) for f, k in zip(first, key) if t.text[f] == i] for i in range(4)]
    assert [first[0], sum(map(len, by_text))] == [0, len(first)] and all(by_text)
    assert len(by_text[0]) > 10 and by_text[0][-1] == by_text[1][-1] and len(set(by_text[0]) & set(by_text[1])) > 10
    assert {int(t.place[f]) for f in first if t.place[f] == 0} == {0} and by_text[2] != by_text[3]


def test_what_followed_saves_bits(spark, monkeypatch):
    monkeypatch.setattr(ctxmix, "MOST", 3)
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.2, [(rng.randrange(4), rng.randrange(3), 30.0 + rng.randrange(9)) for _ in range(rng.randrange(6))]) for i in range(60)]
    df = spark.createDataFrame([(i, out, *([x[j] for x in p] for j in range(3))) for i, out, p in rows], "row long, held_out boolean, before array<long>, after array<long>, cost array<float>")
    pairs = Counter((a, b) for _, out, p in rows if not out for a, b, _ in p)
    best = {a: max((n, b) for (x, b), n in pairs.items() if x == a) for a, _ in pairs}
    total = Counter()
    for (a, _), n in pairs.items():
        total[a] += n

    def state(out, a, b):
        hit = b == best[a][1]
        n, m = best[a][0] - (hit and not out), total[a] - (not out)
        return hit, m, (min(n, 3), min(m - n, 3))

    tally = Counter((state(False, a, b)[2], state(False, a, b)[0]) for _, out, p in rows if not out for a, b, _ in p if state(False, a, b)[1] > 0)
    want = {}
    for i, out, p in rows:
        for a, b, cost in p:
            if a in best and state(out, a, b)[1] > 0:
                hit, _, (n, other) = state(out, a, b)
                h, miss = tally[(n, other), True], tally[(n, other), False]
                chance = (h + 2 * (n + 0.4) / (n + other + 0.8)) / (h + miss + 2)
                want[i] = want.get(i, 0) + (cost + math.log2(chance) if hit else math.log2(1 - chance))
    got = {r.row: r.saved for r in ctxmix._savings(df).collect()}
    assert got == pytest.approx(want)


def test_repeated_texts_score_apart(spark):
    rng = random.Random(4)
    docs = [" ".join(f"w{rng.randrange(300)}" for _ in range(300)) for _ in range(60)]
    rows = [*enumerate(docs), (100, docs[1]), (101, docs[2])]
    got = {r.doc_id: r.score / r.n_tokens for r in ctxmix.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    twice = [got[i] for i in (1, 2, 100, 101)]
    assert min(twice) > 0.5 * max(v for i, v in got.items() if i not in (1, 2, 100, 101))


@pytest.mark.parametrize("head", [4, 1 << 17])
def test_query(spark, monkeypatch, head):
    monkeypatch.setattr(ctxmix, "HEAD", head)
    rows = [(i, t) for i, t in enumerate(texts(700))] + [(800, None), (801, ""), (None, "the THE éÉ"), (5, "again the"), (5, "again the"), (802, "unheard " * 9), (803, "onre " * 30_000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, key string").repartition(3)
    got = ctxmix.score(df).collect()
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {(d, t): [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for d, t in rows}
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(w for d, t in rows if not out(d) for w in tokens[d, t])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), out(d), len(x), sum(counts[w] > 0 for w in x), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 4))
        for d, t in rows for x in [tokens[d, t]]
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    size = {str(d): len(ctxmix.normalise((t or "").encode())) for d, t in rows}
    held = [r for r in got if r.held_out and (r.doc_id or 0) < 700]
    rate = sum(-r.score for r in held) / math.log10(2) / sum(size[str(r.doc_id)] for r in held)
    assert rate < 3 and sum(r.score for r in held) > sum(r.base_score for r in held)
    again = ctxmix.score(df.repartition(5)).collect()
    assert sorted(round(r.score, 2) for r in again) == sorted(round(r.score, 2) for r in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ctxmix.score(df).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = ctxmix.score(spark.createDataFrame([(alone, "some text")], df.schema)).collect()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0 and math.isfinite(row.base_score) and math.isfinite(row.score)
