import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import decontam, langid, mixing, simhash
from test_decontam import brute as brute_contaminated
from test_langid import plain_cost

WORDS = {"en": "the of and with that from this thing by to in is was for are as", "fr": "le la une été avec pour ment que dans sur des au les par"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, path = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    prose = lambda x, n: [rng.choice(WORDS[x].split()) + rng.choice(["", "", "a", "er", "on"]) for _ in range(n)]
    items = [(i, " ".join(prose("en", 30))) for i in range(4)]
    docs = []
    for d in range(160):
        lang = "fr" if d % 4 == 0 else "en"
        words = prose(lang, rng.randrange(20, 120))
        if d % 10 == 3:
            words[5:5] = items[d % 4][1].split()
        docs.append((d, " ".join(words), lang, rng.choice(["a", "b", "c", None])))
        if d % 8 == 1:
            docs.append((1000 + d, docs[-1][1].upper() if d % 16 == 1 else docs[-1][1], lang, "b"))
    docs += [(2000, None, "en", "a"), (2001, "12 34", "en", "b"), (2002, "", None, "c"), (3, docs[3][1], "en", "a")]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in docs], "doc_id long, text string, lang string, source string, n_chars long, k1 string")
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_each_stage_against_brute_force(spark, tables):
    path, docs, items = tables
    frame = spark.read.parquet(f"{path}/documents.parquet")
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)

    one = stages["language_id"](spark, frame, path)
    trees = langid.learn(frame.where(~langid.held_out("doc_id")), "text", "lang")
    assert one.columns == frame.columns
    assert sorted(rows(one), key=str) == sorted([r for r in docs if r[1] and any(c.isalpha() for c in r[1])], key=str)
    assert trees.languages == ["en", "fr"] and plain_cost(b"ab", b"ab") > 0

    two = stages["near_dedup"](spark, one, path)
    left, groups = rows(one), []
    for r in left:
        fp = simhash.fingerprint(r[1])
        near = [g for g in groups if any((fp ^ f).bit_count() <= 3 for f, _ in g)]
        groups = [g for g in groups if g not in near] + [[x for g in near for x in g] + [(fp, r[0])]]
    assert two.columns == frame.columns
    assert sorted(r.doc_id for r in two.collect()) == sorted(min(d for _, d in g) for g in groups)

    three = stages["decontaminate"](spark, two, path)
    bad = {r[0] for r in rows(two) if brute_contaminated([(r[0], r[1])], items)}
    assert bad and sorted(rows(three)) == sorted(r for r in rows(two) if r[0] not in bad)

    four = stages["mix_sources"](spark, three, path)
    mixed = mixing.mix(three.select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("m")), "doc_id", "size", "m").collect()
    assert four.columns == frame.columns
    assert Counter(r[0] for r in rows(four)) == Counter({r.doc_id: r.copies for r in mixed if r.copies})
    taken, target = defaultdict(int), {}
    for r in mixed:
        taken[r.members[0]] += r.copies * r["size"]
        target[r.members[0]] = r.target[0]
    assert all(abs(taken[s] - t) <= 80 for s, t in target.items())

    five = stages["token_files"](spark, four, path).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r, d in zip(sorted(five, key=lambda r: r.start), sorted(rows(four))):
        ids = [*library.encode(d[1], add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (d[0], at, len(ids))
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        at += len(ids)
    assert len(five) == four.count()
    run = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, five))
    assert decontam.WORDS == 5
