r"""Chat formatting into packed prefix trees.

Template, one string a turn (a token is a code point here; any tokenizer can be applied to the strings of a node):

    user         "[INST] " text " [/INST]"
    assistant    "<s> " text " </s>"              the text is under the loss mask
    any other    "<<SYS>> " role as JSON " " text " <</SYS>>"

Control strings inside a text are escaped: a run of n backslashes before one becomes 2n + 1 backslashes. Real ones
follow a space or begin a turn, so a control string is real just where no backslash stands before it.

Conversations that begin with the same turns share the nodes of these turns. They are sorted by their path (a hash for
each turn, chained), which is depth-first order; a pack is a stretch of that order with its nodes' strings emitted once,
parents before children. A node has its start in the pack, its position id (the code points of its ancestors) and the
intervals of its ancestors, merged where they touch: its tokens attend to those and to the node itself up to their own
place. A pack ends after about `pack_chars` code points or `pack_conversations`; the next one emits the path of its
first conversation again. So one first turn that many conversations share is no bound on the parallelism.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import map_arrow, materialize

#: Control strings of the template: fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(r"(\\*)(" + "|".join(map(re.escape, CONTROLS)) + ")")
_TURNS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
_OTHER = ("<<SYS>> ", " <</SYS>>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[1] + "\\" + m[2], text)


def unescape(text: str) -> str:
    """The inverse of escape."""
    return _CONTROL.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(string, start and length of the part under the loss mask)."""
    text = text or ""
    if role in _TURNS:
        head, tail = _TURNS[role]
        body = escape(text)
        return head + body + tail, len(head), len(body) if role == "assistant" else 0
    return _OTHER[0] + escape(f"{json.dumps(role)} {text}") + _OTHER[1], 0, 0


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out: list[tuple[str | None, str]] = []
    at = 0
    while at < len(formatted):
        for role, (head, tail) in (*_TURNS.items(), (None, _OTHER)):
            if formatted.startswith(head, at):
                break
        else:
            raise ValueError(f"no turn begins at {at}")
        end = formatted.index(tail, at + len(head))
        body = unescape(formatted[at + len(head) : end])
        if role is None:
            role, used = json.JSONDecoder().raw_decode(body)
            body = body[used + 1 :]
        out.append((role, body))
        at = end + len(tail)
    return out


_PACK = pa.schema(
    [
        ("text", pa.string()),
        ("parent", pa.list_(pa.int32())),
        ("start", pa.list_(pa.int64())),
        ("length", pa.list_(pa.int64())),
        ("position", pa.list_(pa.int64())),
        ("attends", pa.list_(pa.list_(pa.int64()))),
        ("loss_start", pa.list_(pa.int64())),
        ("loss_length", pa.list_(pa.int64())),
        ("conv_id", pa.list_(pa.int64())),
        ("leaf", pa.list_(pa.int32())),
    ]
)
_PACK_DDL = (
    "text string, parent array<int>, start array<long>, length array<long>, position array<long>, attends array<array<long>>, "
    "loss_start array<long>, loss_length array<long>, conv_id array<long>, leaf array<int>"
)


class _Pack:
    def __init__(self):
        self.parts: list[str] = []
        self.chars = 0
        self.columns: dict[str, list] = {name: [] for name in _PACK.names[1:]}
        self.path: list[tuple[tuple, int]] = []  # turns of the last conversation and their nodes

    def add(self, conv_id: int | None, turns: list[tuple]) -> None:
        c, shared = self.columns, 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        del self.path[shared:]
        for turn in turns[shared:]:
            text, loss_at, loss = format_turn(*turn)
            parent = self.path[-1][1] if self.path else -1
            attends: list[int] = []
            if parent >= 0:
                attends = list(c["attends"][parent])
                begin, end = c["start"][parent], c["start"][parent] + c["length"][parent]
                if attends and attends[-1] == begin:
                    attends[-1] = end
                else:
                    attends += [begin, end]
            self.path.append((turn, len(c["parent"])))
            c["parent"].append(parent)
            c["start"].append(self.chars)
            c["length"].append(len(text))
            c["position"].append(c["position"][parent] + c["length"][parent] if parent >= 0 else 0)
            c["attends"].append(attends)
            c["loss_start"].append(self.chars + loss_at)
            c["loss_length"].append(loss)
            self.parts.append(text)
            self.chars += len(text)
        c["conv_id"].append(conv_id)
        c["leaf"].append(self.path[-1][1] if self.path else -1)

    def batch(self) -> pa.RecordBatch:
        values = {"text": "".join(self.parts), **self.columns}
        return pa.RecordBatch.from_arrays([pa.array([values[f.name]], f.type) for f in _PACK], schema=_PACK)


def pack(turns: DataFrame, pack_chars: int = 1 << 16, pack_conversations: int = 4096) -> DataFrame:
    """The written packs of a table (conv_id, turn, role, text), a row for each.

    Turns are ordered by turn (null first), equal ones by role and text; repeated rows are turns of their own. Null
    texts are empty, a null role is kept. Rows without conv_id are one conversation. Extra columns are ignored. An
    empty table gives no pack. A conversation is a row and has to fit one, as any row has.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Pack()
        for batch in batches:
            for conv_id, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now.add(conv_id, [(t["role"], t["text"]) for t in found])
                if now.chars >= pack_chars or len(now.columns["conv_id"]) >= pack_conversations:
                    yield now.batch()
                    now = _Pack()
        if now.columns["conv_id"]:
            yield now.batch()

    rows = turns.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chain = F.aggregate(
        "turns",
        F.array().cast("array<long>"),
        lambda path, t: F.concat(path, F.array(F.xxhash64(F.try_element_at(path, F.lit(-1)), t["role"], t["role"].isNull(), t["text"]))),
    )
    dealt = whole.withColumn("path", chain).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return materialize(map_arrow(dealt.select("conv_id", "turns"), work, _PACK_DDL))


def read_packs(packs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each packed conversation.

    A conversation is put together again from the intervals that its last node attends to, and parsed. The loss digest
    is over the unescaped text under the loss mask of its nodes.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digest(p: dict, leaf: int) -> tuple:
        text, spans, nodes, at = p["text"], [], [], leaf
        if leaf >= 0:
            spans = [*p["attends"][leaf], p["start"][leaf], p["start"][leaf] + p["length"][leaf]]
        while at >= 0:
            nodes.append(at)
            at = p["parent"][at]
        formatted = "".join(text[a:b] for a, b in zip(spans[::2], spans[1::2]))
        if leaf >= 0 and len(formatted) != p["position"][leaf] + p["length"][leaf]:
            raise ValueError("position ids and intervals disagree")
        turns = parse(formatted)
        said = "".join(f"{role or ''}\n{t}\n" for role, t in turns)
        loss = "".join(unescape(text[p["loss_start"][k] : p["loss_start"][k] + p["loss_length"][k]]) for k in reversed(nodes))
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha(said), len(loss), sha(loss), len(formatted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (p,) = batch.slice(k, 1).to_pylist()
                known: dict[int, tuple] = {}
                out = []
                for conv_id, leaf in zip(p["conv_id"], p["leaf"]):
                    if leaf not in known:
                        known[leaf] = digest(p, leaf)
                    out.append((conv_id, *known[leaf]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return map_arrow(packs, work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
