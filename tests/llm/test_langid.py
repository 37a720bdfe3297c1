import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid

SAMPLES = {"aa": b"the cat and the hat that sat", "bb": "le chat et l'été à la mer".encode(), "cc": b"x"}


def plain_cost(sample, text):
    """Code length by the rule, byte for byte."""
    counts = {}
    for k in range(langid.ORDER + 1):
        for i in range(len(sample) - k):
            counts.setdefault(sample[i : i + k], {}).setdefault(sample[i + k], 0)
            counts[sample[i : i + k]][sample[i + k]] += 1
    total = 0.0
    for i, byte in enumerate(text):
        for k in range(min(langid.ORDER, i), -1, -1):
            got = counts.get(text[i - k : i], {})
            n, u = sum(got.values()), len(got)
            if byte in got:
                total -= math.log2(got[byte] / (n + u))
                break
            if got:
                total -= math.log2(u / (n + u))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    trees = langid.ContextTrees(SAMPLES)
    rng = random.Random(2)
    texts = ["the hat", "été", "", None, "zzz the", "日本"] + ["".join(rng.choices("the caàt xq", k=rng.randrange(40))) for _ in range(40)]
    got = trees.code_lengths(pa.array(texts))
    for row, t in zip(got, texts):
        assert row.tolist() == pytest.approx([plain_cost(SAMPLES[x], (t or "").encode()) for x in trees.languages], rel=1e-5)


def test_long_texts_are_summed_whole():
    trees = langid.ContextTrees(SAMPLES)
    long = "the cat é " * 150_000
    got = trees.code_lengths(pa.array(["x", long, "the"]))
    unit = trees.code_lengths(pa.array(["the cat é " * 1000, "the cat é " * 2000]))
    assert got[1] == pytest.approx(unit[0] + 149 * (unit[1] - unit[0]), rel=1e-5)
    assert got[2].tolist() == pytest.approx(trees.code_lengths(pa.array(["the"]))[0].tolist())


def test_query(spark):
    words = {"en": "the of and with that from this thing", "fr": "le la une été avec pour ment que", "de": "der die und für straße mit ung keit"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[x].split(), k=rng.randrange(3, 30))), x, "lang_pred") for i in range(300) for x in [rng.choice(list(words))]]
    rows += [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "12 34 !", "de", ""), (None, "the of and", None, ""), (1003, "und für " * 400_000, None, ""), (5, rows[5][1], rows[5][2], "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    trees = langid.learn(df.where(~langid.held_out("doc_id")), "text", "lang", sample_bytes=5000)
    got = langid.identify(df, trees).collect()
    assert len(got) == len(rows) and trees.languages == ["de", "en", "fr"]
    pred = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert all(pred[i].lang_pred == x and 0 < pred[i].score <= 1 for i, _, x, _ in rows[:300])
    assert [pred[i].lang_pred for i in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "en", "de"]
    assert pred[1002].score == 0
    kept = {r.doc_id for r in langid.keep_identified(df, trees).collect()}
    assert kept == set(pred) - {1000, 1001, 1002}
    assert trees.code_lengths(pa.array(["the été"])).tolist() == langid.learn(df.where(~langid.held_out("doc_id")).repartition(7), "text", "lang", 5000).code_lengths(pa.array(["the été"])).tolist()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    trees = langid.learn(df, "text", "lang")
    assert [r.lang_pred for r in langid.identify(df, trees).collect()] == ["und"]
    assert langid.identify(df.limit(0), trees).collect() == [] and langid.learn(df.limit(0), "text", "lang").languages == []
    assert np.isfinite(trees.code_lengths(pa.array(["a"]))).all()
    assert df.where(F.lit(True)).count() == 1


def test_any_part_of_a_text_can_be_learned_from(spark):
    tail = {"aa": "qwxz " * 9_000, "bb": "jkvy " * 9_000}
    rows = [(lang, "same words at first " * 3_000 + end) for lang, end in tail.items()] + [(None, "x"), ("cc", None), ("dd", "")]
    trees = langid.learn(spark.createDataFrame(rows, "lang string, text string"), "text", "lang")
    assert trees.languages == ["aa", "bb"]
    assert trees.predict(pa.array(["qwxz qwxz", "jkvy"]))[0] == ["aa", "bb"]
    many = spark.createDataFrame([(f"l{i:03}", f"t{i} " * 3_000) for i in range(60)], "lang string, text string")
    assert len(langid.learn(many, "text", "lang", total_bytes=60_000).languages) == 60
