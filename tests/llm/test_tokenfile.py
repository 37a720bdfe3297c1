import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import _common, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
ODD = [
    "The  cat's mat, it'll DO 42 x2!\tnew\nline", "", "   ", "É ÈRE straße ŒUVRE ſ İstanbul ŉ ΣΑΣ é ́a", "<|endoftext|> a<|startoftext|>b",
    "nb sp  wide \x1c\x1d ctl\x00z", "日本語テスト 한국어 ﬁ ½ ²", "don't 'tis 's 't I'd've", "a" * 5000, "🙂 emoji👩‍👩‍👧 !!?? ...", "ª º µ × ÷ ÿ Ÿ Ĳ ĳ", "퟿ x",
]


def test_word_path_gives_the_library_ids():
    library, enc = Tokenizer.from_str(SPEC), tokenfile.WordEncoder(SPEC, cache_words=50)
    assert enc.by_word
    rng = random.Random(3)
    alphabet = "abtheSR'sdl0 9.,!\n\t<|>éÉßñüœŸÀ×µªé Σσ日"
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    for a in range(0, len(texts), 9):
        got = enc.encode_all([t.encode() for t in texts[a : a + 9]])
        assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts[a : a + 9]]
    assert enc.encode_all([]) == []


@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.9, 1.0])
def test_round_trip(percentile):
    rng = np.random.default_rng(0)
    docs = [(7, rng.integers(0, 50000, 1000)), (None, np.array([1])), (8, rng.integers(0, 3, 300)), (9, np.array([0, 2**32 - 1] * 70))]
    docs += [(i, np.where(rng.random(n) < 0.05, 2**31, rng.integers(5, 9, n))) for i, n in enumerate((0, 127, 128, 129))]
    docs = [(d, x.astype(np.uint32)) for d, x in docs]
    data = tokenfile.encode_file(docs, percentile)
    table, ids = tokenfile.decode_file(data)
    want = np.concatenate([x for _, x in docs])
    assert ids.tolist() == want.tolist()
    assert [(int(r["doc_id"]) if r["has_id"] else None, int(r["n"])) for r in table] == [(d, len(x)) for d, x in docs]
    for k in (0, 5, (len(want) - 1) // 128):
        assert tokenfile.read_block(data, k).tolist() == want[128 * k : 128 * k + 128].tolist()
    assert tokenfile.decode_file(tokenfile.encode_file([]))[1].tolist() == []


def test_outliers_do_not_widen_a_block():
    ids = np.full(128, 4, np.uint32)
    ids[5] = 40_000
    assert len(tokenfile.encode_file([(1, ids)])) < 100


def test_query_matches_brute_force(spark):
    library = Tokenizer.from_str(SPEC)
    rows = [(50 - i, t) for i, t in enumerate(ODD)] + [(100, None), (3, "same id"), (3, "same id"), (3, "also"), (None, "no id"), (7, "word " * 40000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, file string")
    files = tokenfile.write_token_files(df, SPEC, file_ids=64)
    got = [tuple(r) for r in tokenfile.read_token_files(files).collect()]
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode("utf-8"))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    empty = tokenfile.write_token_files(df.limit(0), SPEC)
    assert tokenfile.read_token_files(empty).collect() == []


def test_other_stages_drop_the_encoder(spark):
    class Here:  # runs a stage in this process, as a worker does
        sparkSession = spark  # noqa: N815

        def mapInArrow(self, work, schema):  # noqa: N802
            return list(work(iter(())))

    def left(**keep):
        tokenfile.encoder(SPEC)
        _common.map_arrow(Here(), lambda batches: batches, "x long", **keep)
        return len(tokenfile._ENCODERS)

    assert left() == 0 and left(keep="encoders") == 1
