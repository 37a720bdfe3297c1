"""Greedy word-piece counts by a longest-match automaton that never builds a piece.

The vocabulary is a trie. Where a word leaves the trie, the failure link of the node leads to the node of what is left
after the longest match is popped, and the number of tokens popped on the way is stored with the link. So a word costs
a number of steps linear in its length, and its count is the sum of the popped numbers. All words of a slice of text
go through the automaton side by side, one byte a step.

A word `[^\\x20\\x09-\\x0D]+`, A-Z in lower case, is matched from the left; at each place the longest vocabulary entry
wins. Its end is a symbol of its own, which entries for word ends contain; where the last entry found holds no end, the
end is left over and counts nothing. So a word whose bytes are all entries is always covered. A word that can't be
covered counts as one unknown token, as in word-piece tokenizers.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import LOWER, SLICE_BYTES, map_arrow, record_batch, slices, text_buffer, word_spans

END = 256
#: Words over this many bytes go through the automaton one by one.
LONG_WORD = 512


def byte_level_pieces(spec: str, suffix: str = "</w>") -> list[tuple[bytes, bool]]:
    """(bytes, whether it ends a word) for the vocabulary of a byte-level tokenizers file."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    byte_of = {chr(b if b in shown else next(hidden)): b for b in range(256)}
    out = []
    for token in json.loads(spec)["model"]["vocab"]:
        ends = token.endswith(suffix)
        body = token[: -len(suffix)] if ends else token
        if body and all(c in byte_of for c in body):
            out.append((bytes(byte_of[c] for c in body), ends))
    return out


class Automaton:
    """`cells[base[node] + symbol]` holds node << 32 | child; `fail` and `popped` hold the failure links."""

    def __init__(self, pieces: Iterable[tuple[bytes, bool]]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for body, ends in sorted(set(pieces)):
            at = 0
            for symbol in (*body, END) if ends else body:
                if symbol not in children[at]:
                    children[at][symbol] = len(children)
                    children.append({})
                    is_piece.append(False)
                at = children[at][symbol]
            is_piece[at] = at > 0
        alone = children[0].setdefault(END, len(children))  # an end that no entry took
        if alone == len(children):
            children.append({})
            is_piece.append(True)
        n = len(children)
        fail, popped = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for symbol, child in children[node].items():
                todo.append(child)
                if is_piece[child]:
                    fail[child], popped[child] = 0, int(child != alone)
                    continue
                back, count = fail[node], popped[node]
                while back >= 0 and symbol not in children[back]:
                    back, count = fail[back], count + popped[back]
                if back >= 0:
                    fail[child], popped[child] = children[back][symbol], count
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int64)
        self.base = np.zeros(n, np.int32)
        size = 1 << max(12, (4 * n + 600).bit_length())
        self.cells = np.full(size + END + 1, -1, np.int64)
        taken = bytearray(size + END + 1)
        spot = 1
        for node in sorted(range(n), key=lambda x: -len(children[x])):
            symbols = list(children[node])
            if not symbols:
                continue
            while any(taken[spot + s] for s in symbols):
                spot = (spot * 1_103_515_245 + 12_345) % size
            self.base[node] = spot
            for s in symbols:
                taken[spot + s] = 1
                self.cells[spot + s] = node << 32 | children[node][s]
            spot = (spot * 1_103_515_245 + 12_345) % size

    def count(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Pieces of each word raw[start:stop]; -1 for a word that can't be covered."""
        length = stops - starts
        out = np.zeros(len(starts), np.int64)
        for k in np.flatnonzero(length > LONG_WORD).tolist():
            out[k] = self._one(raw[starts[k] : stops[k]].tobytes())
        short = np.flatnonzero(length <= LONG_WORD)
        order = short[np.argsort(-length[short], kind="stable")]
        begin, size = starts[order], length[order]
        state, popped = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        for t in range(int(size.max(initial=-1)) + 1):
            live = int(np.searchsorted(-size, -t, side="right"))
            symbol = np.full(live, END, np.int64)
            inner = int(np.searchsorted(-size, -t, side="left"))
            symbol[:inner] = raw[begin[:inner] + t]
            self._step(state[:live], popped[:live], symbol)
        # after the end symbol: pop what is left
        rest = np.flatnonzero(state > 0)
        while len(rest):
            popped[rest] += self.popped[state[rest]]
            state[rest] = self.fail[state[rest]]
            rest = rest[state[rest] > 0]
        popped[state < 0] = -1
        out[order] = popped
        return out

    def _step(self, state: np.ndarray, popped: np.ndarray, symbol: np.ndarray) -> None:
        at = np.maximum(state, 0)
        cell = self.cells[self.base[at] + symbol]
        hit = (cell >> 32) == state
        moved = np.where(hit, cell & 0xFFFFFFFF, state).astype(np.int32)
        left = np.flatnonzero(~hit & (state >= 0))
        while len(left):
            now = moved[left]
            popped[left] += self.popped[now]
            now = moved[left] = self.fail[now]
            left, now = left[now >= 0], now[now >= 0]
            cell = self.cells[self.base[now] + symbol[left]]
            hit = (cell >> 32) == now
            moved[left[hit]] = (cell[hit] & 0xFFFFFFFF).astype(np.int32)
            left = left[~hit]
        state[:] = moved

    def _one(self, word: bytes) -> int:
        state, total = 0, 0
        cells, base, fail, popped = self.cells, self.base, self.fail, self.popped
        for symbol in (*word, END):
            while state >= 0:
                cell = int(cells[base[state] + symbol])
                if cell >> 32 == state:
                    state = cell & 0xFFFFFFFF
                    break
                total += int(popped[state])
                state = int(fail[state])
            if state < 0:
                return -1
        while state > 0:
            total += int(popped[state])
            state = int(fail[state])
        return total if state == 0 else -1


def count_tokens(docs: DataFrame, pieces: Iterable[tuple[bytes, bool]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for each row of docs; no shuffle.

    n_tokens counts an unknown word as one token. Null and empty texts have none. Repeated rows each keep a row; extra
    columns are ignored. The automaton travels with the tasks; its size follows the vocabulary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                raw, ends = text_buffer(part.column(1))
                raw = LOWER[raw]
                starts, stops, rows = word_spans(raw, ends)
                n = shared.value.count(raw, starts, stops)
                total = lambda values=None: np.bincount(rows, values, minlength=part.num_rows).astype(np.int64)  # noqa: B023, E731
                yield record_batch(schema, doc_id=part.column(0), n_words=total(), n_tokens=total(np.where(n < 0, 1, n)), n_unknown=total(n < 0))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, work, "doc_id long, n_words long, n_tokens long, n_unknown long")
