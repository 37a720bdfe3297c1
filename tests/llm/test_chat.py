import hashlib
import random

import pytest

from plumbline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, parent string"
PIECES = [*chat.CONTROLS, "\\", "\\\\", " ", "\n", "ok", "é", "<", "[INST", "/s>", "<<", '"']


def brute(rows):
    by_conv = {}
    for c, t, r, x in rows:
        by_conv.setdefault(c, []).append((t, r, x or ""))
    out = []
    for c, turns in by_conv.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, (t[1] or "").encode(), t[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        said = "".join(f"{r or ''}\n{x}\n" for _, r, x in turns)
        formatted = "".join(chat.format_turn(r, x)[0] for _, r, x in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
    return sorted(out, key=str)


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", None, "<s>", '"', "a\nb"]), "".join(rng.choices(PIECES, k=rng.randrange(8)))) for _ in range(rng.randrange(4))]
        assert chat.parse("".join(chat.format_turn(*t)[0] for t in turns)) == turns
        for _, text in turns:
            assert chat.unescape(chat.escape(text)) == text


def rows():
    rng = random.Random(2)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randrange(9)))
    firsts = [text() for _ in range(5)]
    out = []
    for c in range(200):
        out.append((c, 0, "user", "very common" if c % 3 == 0 else rng.choice(firsts)))
        for t in range(1, rng.randrange(1, 6)):
            out.append((c, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["yes", "no", text()])))
    out += [(1000 + c, t, r, x) for c in range(60) for t, r, x in ((0, "user", "same"), (1, "assistant", "same"))]
    return out + [(900, 0, "user", None), (901, None, None, "x"), (901, 3, "user", "dup"), (901, 3, "user", "dup"), (None, 0, "assistant", "no id"), (902, 0, "assistant", "long " * 100_000)]


@pytest.mark.parametrize(("chars", "conversations"), [(1 << 16, 4096), (200, 4096), (1 << 16, 7)])
def test_matches_brute_force(spark, chars, conversations):
    df = spark.createDataFrame([(*r, "clash") for r in rows()], SCHEMA)
    packs = chat.pack(df, chars, conversations)
    assert sorted(map(tuple, chat.read_packs(packs).collect()), key=str) == brute(rows())
    whole = sum(r[-1] for r in brute(rows()))
    assert sum(len(p.text) for p in packs.collect()) < whole  # shared turns are there once a pack
    for p in packs.collect():
        for k, parent in enumerate(p.parent):
            line, at = [], parent
            while at >= 0:
                line, at = [*range(p.start[at], p.start[at] + p.length[at]), *line], p.parent[at]
            seen = [i for a, b in zip(p.attends[k][::2], p.attends[k][1::2]) for i in range(a, b)] if len(line) < 5000 else line
            assert seen == line and p.position[k] == len(line) and parent < k


def test_empty(spark):
    packs = chat.pack(spark.createDataFrame([], SCHEMA))
    assert packs.collect() == [] and chat.read_packs(packs).collect() == []
