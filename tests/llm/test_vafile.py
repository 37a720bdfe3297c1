import math
import random

import pytest

from plumbline.llm import vafile

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    whole = lambda v: tuple(math.floor(256 * x) for x in v)
    ok = [(i, whole(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in {x for x in ok if x[0] in queries}:
        cap = lambda s: max(-(2**63), min(2**63 - 1, s))
        scores = sorted((-cap(sum(a * b for a, b in zip(q, v))), j) for j, v in ok if j != i and len(v) == len(q))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def f32(x):
    import numpy as np

    return float(np.float32(x))


@pytest.mark.parametrize(("block_rows", "slice_bytes", "bits"), [(8192, 1 << 20, 6), (7, 200, 2), (64, 1 << 20, 4)])
def test_matches_brute_force(spark, block_rows, slice_bytes, bits):
    rng = random.Random(6)
    rows = [(i, [f32(rng.gauss(0, 0.3)) for _ in range(8)], "x") for i in range(240)]
    rows += [(300 + i, rows[3][1], "x") for i in range(40)]  # one common vector
    rows += [(400, None, ""), (401, [None] * 8, ""), (450, [math.nan] * 8, ""), (403, [math.inf] + [0.0] * 7, ""), (None, rows[1][1], "")]
    rows += [(500, [0.5, -0.5], ""), (501, [0.25, 0.25], ""), (550, [], ""), (551, [], ""), rows[50], (100, rows[7][1], "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vafile.search(vafile.build_index(df, block_rows=block_rows, bits=bits), df.where("vec_id % 50 = 0"), 5, slice_bytes=slice_bytes)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, {i for i, *_ in rows if i is not None and i % 50 == 0}, 5)


def test_huge_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [f32(rng.choice((-1, 1)) * 10.0 ** rng.randrange(-2, 12)) for _ in range(3)], "") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = vafile.search(vafile.build_index(df), df.where("vec_id % 50 = 0"), 5)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, {0, 50}, 5)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vafile.search(vafile.build_index(df), df, 5).collect() == []
