import random

import numpy as np
import pytest

from plumbline.llm import decontam

VOCAB = [a + b for a in "abcdefghij" for b in ("x", "yé", "zzz", "q", "w,")]


def prose(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


def brute(docs, items, threshold=0.8):
    out = []
    for d, text in docs:
        words = decontam._words(text)
        for i, item in items:
            target = decontam._words(item)
            if len(target) < 5:
                continue
            size, best = min(len(target), len(words)), None
            for at in range(len(words) - size + 1):
                s = decontam.weighted_jaccard(words[at : at + size], target)
                if size >= 5 and s >= threshold and (best is None or s > best[0]):
                    best = (s, at, size)
            if best:
                out.append((d, i, *best))
    return sorted(out, key=str)


def make(seed=3):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.randrange(12, 60))) for i in range(12)]
    items[3] = (3, ["same", "again"] * 15)
    items[4] = (4, items[5][1][: len(items[5][1])])
    docs = []
    for d in range(90):
        words = prose(rng, rng.randrange(0, 160))
        if d % 3 == 0:
            _, leak = rng.choice(items)
            leak = list(leak)
            if d % 2:
                leak[rng.choice((0, 1, len(leak) - 1))] = "other"
            if d % 9 == 0:
                leak = leak[:-1]
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if d % 5 == 0 and w.isascii() else w for w in leak]
        docs.append((d, rng.choice((" ", "\n", "  \t")).join(words)))
    docs += [(200, " ".join(items[0][1])), (201, " ".join(items[1][1][:-1])), (202, " ".join(items[3][1] * 50)), (203, None), (204, ""), (None, " ".join(items[2][1])), (200, docs[0][1])]
    return docs, [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (52, "too few words here"), (None, "an item without an id of its own")]


@pytest.mark.parametrize("pass_words", [40, 10**6])
def test_matches_brute_force(spark, pass_words):
    docs, items = make()
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, item_id double")
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, similarity int")
    got = decontam.contaminated(df, bench, pass_words=pass_words).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    bad = {t for d, t in docs if any(d == x[0] for x in got) and brute([(d, t)], items)}
    left = [tuple(r) for r in decontam.decontaminate(df, bench, pass_words=pass_words).collect()]
    assert sorted(left, key=str) == sorted([(d, t, 1.0) for d, t in docs if t not in bad], key=str)


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    screen = decontam.Screen([(i, " ".join(prose(random.Random(i), 20))) for i in range(50)])
    prints = screen.prints[rng.integers(0, 50, 300)]
    for k in range(24):
        prints = np.where(rng.random(300) < 0.8, prints ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), prints)
    got = set(zip(*(x.tolist() for x in screen.candidates(prints, 20))))
    want = {(w, i) for w in range(300) for i in range(50) if int(prints[w] ^ screen.prints[i]).bit_count() <= decontam.RADIUS}
    assert got == want and len(want) > 50


def test_long_text_and_empty_tables(spark):
    docs, items = make()
    long = " ".join(prose(random.Random(9), 50_000)) + " " + items[0][1]
    df = spark.createDataFrame([(1, long)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(df, bench).collect()] == [(1, 0, 1.0)]
    assert decontam.contaminated(df.limit(0), bench).collect() == []
    assert decontam.contaminated(df, bench.limit(0)).collect() == []
    assert decontam.decontaminate(df, bench.limit(0)).count() == 1
