import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.llm.queries import op10_mixed_sources


def refill(sizes, weights):
    """The rule as stated: cap, and share the excess again until no target is above."""
    targets = [sum(sizes) * w / sum(weights) for w in weights]
    for _ in range(100):
        over = sum(max(0, t - 3 * s) for t, s in zip(targets, sizes))
        targets = [min(t, 3 * s) for t, s in zip(targets, sizes)]
        free = [i for i, (t, s) in enumerate(zip(targets, sizes)) if t < 3 * s]
        if over < 1e-9 or not free:
            break
        for i in free:
            targets[i] += over * weights[i] / sum(weights[j] for j in free)
    return targets


def test_water_fill_is_the_stated_rule():
    rng = random.Random(1)
    for n in range(1, 12):
        sizes = [rng.choice((0, 1, 5, 1000, rng.randrange(10000))) for _ in range(n)]
        weights = [(5, 2, 1)[i % 3] for i in range(n)]
        assert mixing.water_fill(sizes, weights) == pytest.approx(refill(sizes, weights))


def test_route_has_the_least_cost():
    members, capacity = [[0], [0, 1], [1, 2], [2]], [2, 1, 2, 1]
    for quota in itertools.product(range(4), repeat=3):
        flow = mixing.route(capacity, members, quota, repeats=2)
        used = [sum(f.values()) for f in flow]
        cost = sum(max(0, u - c) for u, c in zip(used, capacity))
        best = None
        # brute force over all integer flows
        options = [[(x,) for x in range(5)], [(x, y) for x in range(3) for y in range(3 - x)], [(x, y) for x in range(5) for y in range(5 - x)], [(x,) for x in range(3)]]
        for choice in itertools.product(*options):
            got = [0, 0, 0]
            for m, x in zip(members, choice):
                for s, v in zip(m, x):
                    got[s] += v
            if any(g > q for g, q in zip(got, quota)):
                continue
            key = (-sum(got), sum(max(0, sum(x) - c) for x, c in zip(choice, capacity)))
            best = key if best is None or key < best else best
        assert (-round(sum(used), 6), round(cost, 6)) == best
        assert all(sum(f.get(s, 0) for f in flow) <= q + 1e-6 for s, q in enumerate(quota))


def rows(n=800, seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "Z", "é", "𝒳", "￮", None, "tiny" if i % 40 == 0 else "c"])
        out.append((i, " ".join(["w"] * rng.randrange(1, 60)), "en", source, 3))
    return out + [(5, "same id", "en", "a", 0), (5, "same id", "en", "a", 0), (None, "no id\tx", None, "a", 0), (900, None, None, "a", 0), (901, "", None, "void", 0), (902, "y " * 20000, None, "b", None)]


def test_query(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_mixed_sources(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op10_mixed_sources(spark, str(tmp_path)).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({r[3] for r in data}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(r[1]) for r in data if r[3] == s) for s in names]
    targets = dict(zip(names, refill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert len(got) == len(data)
    source = {(r[0], size(r[1])): r[3] for r in data}
    largest, taken = {}, dict.fromkeys(names, 0)
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[names.index(s)] and r.target == pytest.approx(targets[s])
        assert r.taken in [k * r["size"] for k in range(4)]
        taken[s] += r.taken
        largest[s] = max(largest.get(s, 0), r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6 for s in names)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).withColumn("size", mixing.word_count("text")).withColumn("m", F.array("source"))
    assert mixing.mix(empty, "doc_id", "size", "m").collect() == []


def test_overlapping_sources_use_each_word_where_it_is_needed(spark):
    data = [(i, 10, ["a"]) for i in range(50)] + [(100 + i, 10, ["a", "b"]) for i in range(50)] + [(300, 5, []), (301, None, ["a"])]
    got = mixing.mix(spark.createDataFrame(data, "id long, size int, m array<string>"), "id", "size", "m", weights=(1, 1)).collect()
    to = {"a": 0, "b": 0}
    for r in got:
        assert r.copies <= 1 and sum(r.routed) == r.copies
        for s, n in zip(r.members, r.routed):
            to[s] += n * r["size"]
    assert to == {"a": 500, "b": 500}


@pytest.mark.parametrize("share", [0.45, 0.55])
def test_a_long_document_leaves_no_gap(spark, share):
    """The long one lies across the cut, at this share of the others' line: taken it is too much, left out too little."""
    place = F.xxhash64(F.lit(42), "id", F.lit(200_000).cast("long"))
    long_id = spark.range(5000, 9000).orderBy(F.abs(place / 2.0**64 + 0.5 - share)).first().id
    data = [(i, 300, ["a"]) for i in range(2000)] + [(long_id, 200_000, ["a"]), (1_000_000, 400_000, ["b"])]
    df = spark.createDataFrame(data, "id long, size int, m array<string>")
    got = mixing.mix(df, "id", "size", "m", weights=(1, 2)).collect()
    (target,) = {r.target[0] for r in got if r.members == ["a"]}
    assert abs(sum(r.copies * r["size"] for r in got if r.members == ["a"]) - target) <= 150
    again = mixing.mix_documents(df, "id", F.col("size").cast("long"), F.col("m"), weights=(1, 2)).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in again} == {r.doc_id: r.copies for r in got if r.copies}


def test_many_sources_take_one_path_each():
    n = 150_000
    flow = mixing.route([2.0] * n + [5.0, 1.0], [[i] for i in range(n)] + [[n, n + 1], [n + 1]], [i % 9 for i in range(n)] + [3.0, 3.0])
    assert [flow[i][i] for i in range(n)] == [min(i % 9, 6.0) for i in range(n)]
    assert flow[n][n] == 3 and flow[n][n + 1] + flow[n + 1][n + 1] == pytest.approx(3)


def test_documents_of_an_empty_table_and_of_many_sources(spark, monkeypatch):
    kind = "doc_id long, text string, source string, size int"
    rows = [(i, "a b c", f"s{i % 30}", 7) for i in range(90)] + [(90, None, None, 1)]
    df = spark.createDataFrame(rows, kind)
    run = lambda d: mixing.mix_documents(d, "doc_id", mixing.word_count("text"), F.array("source"))
    assert run(df.limit(0)).collect() == []
    few = sorted(map(str, run(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 5)
    assert sorted(map(str, run(df).collect())) == few and run(df).columns == df.columns
