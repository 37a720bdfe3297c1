import random

import public_tokenizers
import pytest

from plumbline.llm import tokencount

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


def greedy(word, pieces, longest):
    symbols, n = (*word, 256), 0
    while symbols:
        for k in range(min(longest, len(symbols)), 0, -1):
            if symbols[:k] in pieces:
                symbols, n = symbols[k:], n + 1
                break
        else:
            return n if symbols == (256,) else -1
    return n


def brute(text, pieces):
    table = {(*b, 256) if ends else tuple(b) for b, ends in pieces}
    longest = max(map(len, table))
    words = (text or "").encode().lower().split()
    counts = [greedy(w, table, longest) for w in words]
    return len(words), sum(abs(c) for c in counts), sum(c < 0 for c in counts)


@pytest.mark.parametrize("long_word", [512, 2])
def test_small_vocabularies(monkeypatch, long_word):
    import numpy as np

    monkeypatch.setattr(tokencount, "LONG_WORD", long_word)
    rng = random.Random(1)
    for _ in range(40):
        pieces = [("".join(rng.choices("abc", k=rng.randrange(1, 5))).encode(), rng.random() < 0.4) for _ in range(rng.randrange(1, 14))]
        words = ["".join(rng.choices("abc", k=rng.randrange(1, 12))).encode() for _ in range(60)]
        raw = np.frombuffer(b" ".join(words), np.uint8)
        stops = np.cumsum([len(w) + 1 for w in words]) - 1
        table = {(*b, 256) if ends else tuple(b) for b, ends in pieces}
        got = tokencount.Automaton(pieces).count(raw, stops - [len(w) for w in words], stops)
        assert got.tolist() == [greedy(w, table, 6) for w in words]


def test_no_word_is_unknown_whose_bytes_are_entries():
    import numpy as np

    pieces = tokencount.byte_level_pieces(SPEC)
    words = [w.encode() for w in ("thre", "für", "ç", "the", "日本", "x")]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    got = tokencount.Automaton(pieces).count(raw, stops - [len(w) for w in words], stops).tolist()
    assert min(got) > 0 and got[3] == got[5] == 1


def test_query(spark):
    pieces = tokencount.byte_level_pieces(SPEC)
    assert len(pieces) > 49_000
    rng = random.Random(2)
    texts = ["".join(rng.choices(["the", "ation", "Er", "é", " ", "\n", ",", "日", "x1", "zz"], k=rng.randrange(80))) for _ in range(150)]
    rows = [*enumerate(texts), (300, None), (301, ""), (302, " \t"), (None, "no id"), (5, texts[5]), (303, "ab" * 4000 + " " + "word " * 20_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_words int")
    got = sorted(((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in tokencount.count_tokens(df, pieces).collect()), key=str)
    assert got == sorted(((d, *brute(t, pieces)) for d, t in rows), key=str)
    few = [(b"the", False), (b"", False), (b"er", True)]
    got = sorted(((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in tokencount.count_tokens(df, few).collect()), key=str)
    assert got == sorted(((d, *brute(t, few[:1] + few[2:])) for d, t in rows), key=str)
    assert tokencount.count_tokens(df.limit(0), few).collect() == []
