import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def brute(rows):
    fps = [(d, simhash.fingerprint(t)) for d, t in rows]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for (d, _), x in zip(fps, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d, f, least.get(x)) for (d, f), x in zip(fps, label)), key=str)


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts(n, seed=5):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgÉ", k=4)) for _ in range(300)]
    out = []
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice((2, 40, 150)))
        for _ in range(rng.choice((1, 1, 6))):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append(" ".join(copy))
    return out


def test_fingerprint_is_the_stated_one():
    for t in [*texts(30), "", "One", "one TWO", "a\tB\nc d", "É é x y"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_golay_code_is_perfect():
    near = simhash._decoder()
    assert (near >= 0).all() and (np.bincount(near) == 2048).all()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    sets = []
    for z in (x, y):
        row, key = simhash.link_keys(z.view(np.int64))
        assert np.bincount(row).max() <= 60
        got = [set() for _ in z]
        for r, k in zip(row.tolist(), key.tolist()):
            got[r].add(k)
        sets.append(got)
    assert all(a & b for a, b in zip(*sets))


def test_groups_match_brute_force(spark):
    rows = list(enumerate(texts(60)))
    rows += [(500, rows[0][1]), (500, rows[0][1]), (501, None), (502, ""), (503, " \n"), (None, rows[3][1]), (None, "lonely words here"), (504, "x " * 30000)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("small", [2, 6])
def test_dense_group_is_one_component(spark, small):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(10, 2, replace=False)) for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from plumbline.llm.components import components

    roots = components(simhash.near_links(df)).collect()
    assert {r.root for r in roots} == {fps[0]} and {r.node for r in roots} == set(fps)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
