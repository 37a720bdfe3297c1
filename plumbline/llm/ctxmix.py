"""Language-model scores by online logistic mixing of hashed-context bit predictors, and an add-0.1 unigram base.

Text is read as its words in lower case (A-Z only) and an end: the tokens of the base model. A token is coded in three
parts, each given the ones before:

* its class: the last two bytes of the word, one of the 62 most frequent pairs, the end, or any other pair. A class is a
  path in a Huffman tree; each step on it is a binary decision.
* whether the word is in the lexicon (the most frequent words that training text holds twice or more), and then which:
  plain shares of the training counts within the class.
* if it is not, the letters of its stem (the whole word in the class of other pairs) and an end, again as decisions on
  the path in a Huffman tree, over bytes.

Predictors. A decision on a class sees three hashed contexts: the last two classes, the last three, and the last word.
One on a letter sees the last two bytes, the last four, and the last two with the class. Each context's slot holds for
every tree node the logit of its frozen training counts and how many there were. Tables grow with the number of
distinct words up to `TABLE_BITS`, what a worker can hold.

Mixing. A decision's logit is the sum of the predictors' logits times weights. The weights are the sum of a frozen set
that a gate selects (depth in the tree, how often the two longer contexts were seen), fitted by logistic regression on
all decisions of the training text, and an offset of the text's own, which follows the gradient of the code length
after every 128 decisions.

Passages. Texts are cut where the hash of two adjoining words says so, every 24 words or so. A passage's hash is the
context for one more decision: whether the passage follows that followed it most often in the training text. If so, it
costs that decision only; else the decision and its words. Shares of hits come from all training text, by how often the
passage was followed by that one and by others. This table has a row for every distinct passage of the training text:
it grows with the corpus, and texts meet it by a shuffle join.

A decision on training text is always made with its own occurrence taken out of the counts, so that texts learned from
and others are scored alike, and a text that occurs twice is told by its likeness to the other one.

Base. Words are told apart by a 64-bit hash. Counts of the `HEAD` most frequent words, whatever the corpus, travel with
the tasks; all other words are joined with the table of counts by shuffle.
"""

from __future__ import annotations

import heapq
import math
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import SLICE_BYTES, _powers, join_unique, map_arrow, materialize, mix64, slices, span_hashes, text_buffer, word_spans

SYMBOLS = 64
END = 0x0A
SPACE = 0x20
#: The pair of bytes that stands for the end of a text.
END_PAIR = END << 8 | END
#: log2 of the slots of the hashed contexts at most: what a worker holds.
TABLE_BITS = 16
CHUNK = 1 << 14
#: The most frequent words, whose counts travel with the tasks: 16 bytes each.
HEAD = 1 << 17
#: Counts below this have their terms of the base in a table.
TERMS = 1 << 16
#: Words of a passage on average.
PASSAGE = 24
STEP, RATE = 128, 0.01
#: Counts of a passage's followers are told apart up to this.
MOST = 15
_LOG10_2 = math.log10(2)


def normalise(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


class Code:
    """A Huffman tree over the most frequent ids and an escape: for each symbol its nodes and turns."""

    def __init__(self, histogram: np.ndarray, always: int):
        seen = np.flatnonzero(histogram)
        order = seen[np.argsort(-histogram[seen], kind="stable")]
        kept = sorted([always, *order[order != always][: SYMBOLS - 2].tolist()])
        self.symbol = np.full(len(histogram), len(kept), np.uint8)  # the escape
        self.symbol[kept] = np.arange(len(kept))
        self.escape, self.always = len(kept), int(self.symbol[always])
        weight = [max(1, int(histogram[b])) for b in kept] + [max(1, int(histogram.sum() - histogram[kept].sum()))]
        heap = [(w, i, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        children: list[tuple[int, int]] = []
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            children.append((x, y))
            heapq.heappush(heap, (a + b, SYMBOLS + len(children), -len(children)))
        paths: list[list[tuple[int, int]]] = [[] for _ in weight]
        todo = [(-len(children), [])]
        while todo:
            at, path = todo.pop()
            if at >= 0:
                paths[at] = path
            else:
                todo += [(child, [*path, (-at - 1, turn)]) for turn, child in enumerate(children[-at - 1])]
        deepest = max(map(len, paths))
        self.length = np.zeros(SYMBOLS, np.int64)
        self.node = np.zeros((SYMBOLS, deepest), np.uint8)
        self.turn = np.zeros((SYMBOLS, deepest), np.uint8)
        self.through = np.zeros((SYMBOLS, SYMBOLS))  # symbol x node: passes the node
        self.right = np.zeros((SYMBOLS, SYMBOLS))  # symbol x node: turns to the second child
        for s, path in enumerate(paths):
            self.length[s] = len(path)
            for d, (node, turn) in enumerate(path):
                self.node[s, d], self.turn[s, d] = node, turn
                self.through[s, node] = 1
                self.right[s, node] = turn
        # node, turn and 16 times the depth of each step in one number: 6 bits, 1 bit, the rest
        depth = np.minimum(np.arange(deepest), 5) * 16
        self.packed = self.node.astype(np.int32) | self.turn.astype(np.int32) << 6 | depth.astype(np.int32) << 7

    def logits(self, counts: np.ndarray) -> np.ndarray:
        """Three bytes for each of the tree's nodes and row of symbol counts: from all counts, from those without one
        turn to the first child, without one to the second. A byte is the logit in steps of 1/4 and, in the last two
        bits, how often the node was passed (never, up to 2, up to 15, more often)."""
        total, second = counts @ self.through, counts @ self.right
        first = total - second
        return np.stack([self._quantised(first, second), self._quantised(np.maximum(first - 1, 0), second), self._quantised(first, np.maximum(second - 1, 0))])

    @staticmethod
    def _quantised(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        total = first + second
        logit = np.log((second + 0.4) / (first + 0.4))
        often = (total > 0).astype(np.int8) + (total > 2) + (total > 15)
        return np.clip(np.rint(4 * logit), -32, 31).astype(np.int8) * np.int8(4) + often.astype(np.int8)


class Words:
    """Counts of the most frequent words by hash, looked up in a table of 2^20 places; keys that share a place are
    tried one after the other."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys.view(np.uint64))
        # the last row is nobody's: a word that is nowhere has no count
        self.keys, self.counts = np.append(keys[order], 0), np.append(counts[order], 0)
        at = self._at(self.keys[:-1])
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
        self.place = np.full(1 << 20, len(keys), np.int32)
        self.place[at[first]] = first
        #: keys of the fullest place
        self.most = int(np.diff(np.append(first, len(at))).max(initial=0))

    @staticmethod
    def _at(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(44)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key; 0 if it is not among them."""
        at = self.place[self._at(keys)]
        none = len(self.keys) - 1
        rest = np.flatnonzero((self.keys[at] != keys) & (at < none))
        for _ in range(1, self.most):
            at[rest] += 1
            rest = rest[(self.keys[at[rest]] != keys[rest]) & (at[rest] < none)]
        at[rest] = none
        return self.counts[at]


class Tokens:
    """The tokens of some texts: for each its text, place there, hash and pair of bytes; words have `starts`, `stops`."""

    def __init__(self, texts: list[bytes] | pa.Array):
        if isinstance(texts, pa.Array):  # whole texts as they are; null is an empty text
            raw, bounds = text_buffer(texts)
            self.raw = raw + ((raw - np.uint8(0x41) < np.uint8(26)).view(np.uint8) << np.uint8(5))  # A-Z in lower case
        else:
            self.raw = np.frombuffer(b"".join(texts), np.uint8)
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        self.starts, self.stops, rows = word_spans(self.raw, bounds)
        self.n = np.bincount(rows, minlength=len(texts)) + 1
        self.ends = np.cumsum(self.n) - 1  # the end of each text
        self.words = np.arange(len(rows)) + rows  # the token number of each word
        self.text = np.repeat(np.arange(len(texts)), self.n)
        self.place = np.arange(len(self.text)) - np.repeat(self.ends - self.n + 1, self.n)
        self.key = np.zeros(len(self.text), np.int64)
        self.key[self.words] = span_hashes(self.raw, self.starts, self.stops).view(np.int64)
        self.pair = np.full(len(self.text), END_PAIR, np.int32)
        if len(rows):
            before = np.where(self.stops - self.starts > 1, self.raw[self.stops - 2], SPACE).astype(np.int32)
            self.pair[self.words] = before << 8 | self.raw[self.stops - 1]

    def passages(self) -> tuple[np.ndarray, np.ndarray]:
        """(first token, hash) of each passage; a text's end is its last passage's."""
        key = self.key.view(np.uint64)
        both = mix64(key + np.uint64(3) * np.concatenate([key[:1], key[:-1]]))
        last = (self.place > 0) & (both % np.uint64(PASSAGE) == 0)
        last[self.ends] = True
        stops = np.flatnonzero(last) + 1
        first = np.concatenate([[0], stops[:-1]])
        up, down = _powers(len(key) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((key | np.uint64(1)) * up[: len(key)])])
        return first, mix64((total[stops] - total[first]) * down[first] + (stops - first).astype(np.uint64)).view(np.int64)


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below 2^32 to slots."""
    return (x.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int32)


def _before(x: np.ndarray, place: np.ndarray, back: int, fill: int) -> np.ndarray:
    """The values `back` places earlier in the same text or word."""
    out = np.empty_like(x)
    out[:back], out[back:] = fill, x[: max(0, len(x) - back)]
    out[place < back] = fill
    return out


class Layout:
    """What symbols and contexts are: two codes and the slots of six contexts."""

    def __init__(self, pairs: np.ndarray, letters: np.ndarray, bits: int = TABLE_BITS):
        self.codes = [Code(pairs, END_PAIR), Code(letters, SPACE)]
        self.bits = bits
        #: log2 of the slots of the contexts of either code
        self.widths = [(12, bits - 1, bits - 1), (14, bits, 16)]
        cells = [(1 << w) * SYMBOLS for of_code in self.widths for w in of_code]
        self.offsets = np.concatenate([[0], np.cumsum(cells)])

    def classes(self, t: Tokens) -> tuple[np.ndarray, list[np.ndarray]]:
        """(symbol, slot in each context) of each token."""
        code, bits = self.codes[0], self.bits - 1
        symbol = code.symbol[t.pair].astype(np.int32)
        one, two, three = (_before(symbol, t.place, k, code.always) for k in (1, 2, 3))
        word = _before(t.key, t.place, 1, 0).view(np.uint64) >> np.uint64(64 - bits)
        return symbol, [one | two << 6, _hashed((one | two << 6 | three << 12) + 1, bits), word.astype(np.int32)]

    def letters(self, t: Tokens, symbol: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(symbol, token, slot in each context) of each letter of the words whose numbers are in `spelled`."""
        start, token = t.starts[spelled], t.words[spelled]
        cls = symbol[token]
        stop = np.where(cls == self.codes[0].escape, t.stops[spelled], np.maximum(start, t.stops[spelled] - 2))
        size = stop - start + 1
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        byte = t.raw[np.minimum(np.repeat(start, size) + place, max(0, len(t.raw) - 1))].astype(np.uint32)
        byte[ends - 1] = SPACE
        own = np.repeat(cls, size).astype(np.uint32)
        one, two, three, four = (_before(byte, place, k, SPACE) for k in (1, 2, 3, 4))
        near = one | two << np.uint32(8)
        far = near | three << np.uint32(16) | four << np.uint32(24)
        slots = [_hashed(near + np.uint32(1), 14), _hashed(far + np.uint32(1), self.bits), _hashed(near << np.uint32(6) | own, 16)]
        return self.codes[1].symbol[byte].astype(np.int32), np.repeat(token, size), slots


def _merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows (key, n, extra...) put together by key; extras go with the key."""
    keys, *rest = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    total = np.add.reduceat(rest[0][order], heads).astype(np.int64) if len(keys) else np.empty(0, np.int64)
    return keys[heads], total, *(c[order[heads]] for c in rest[1:])


def _count_words(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(kind, key, pair, n): counts of word hashes with their last bytes (kind 0), pairs of last bytes (kind 1) and bytes
    (kind 2), put together for up to `most` words."""
    pairs, letters = np.zeros(1 << 16, np.int64), np.zeros(256, np.int64)
    held: list[tuple[np.ndarray, ...]] = []

    def out(kind: int, keys: np.ndarray, n: np.ndarray, pair: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(pair.astype(np.int32)), pa.array(n)], names=["kind", "key", "pair", "n"])

    for batch in batches:
        for part in slices(batch, "text"):
            t = Tokens(part.column(0))
            held.append(_merged([(t.key[t.words], np.ones(len(t.words), np.int64), t.pair[t.words])]))
            pairs += np.bincount(t.pair, minlength=1 << 16)
            found = np.bincount(t.raw, minlength=256)
            found[0x09:0x0E] = 0
            found[SPACE], found[END] = len(t.words) - np.count_nonzero(t.n > 1), len(t.n)  # as normalise() has them
            letters += found
            if sum(len(x[0]) for x in held) > most:
                held = [_merged(held)]
                if len(held[0][0]) > most // 2:
                    yield out(0, *held.pop())
    if held:
        yield out(0, *_merged(held))
    for kind, found in ((1, pairs), (2, letters)):
        used = np.flatnonzero(found)
        yield out(kind, used, found[used], used)


def _count_contexts(batches: Iterator[pa.RecordBatch], layout: Layout, lexicon: Words) -> Iterator[pa.RecordBatch]:
    """(chunk, cells): a task's counts of (context slot, symbol), as sparse stretches of the tables of all contexts."""
    total = np.zeros(int(layout.offsets[-1]), np.uint32)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES // 4):
            t = Tokens(part.column(0))
            symbol, slots = layout.classes(t)
            letter, _, more = layout.letters(t, symbol, np.flatnonzero(lexicon.find(t.key[t.words]) == 0))
            for offset, slot, s in zip(layout.offsets, [*slots, *more], [symbol] * 3 + [letter] * 3):
                np.add.at(total, offset + slot.astype(np.int64) * SYMBOLS + s, np.uint32(1))
    chunks, cells = [], []
    for a in range(0, len(total), CHUNK):
        used = np.flatnonzero(total[a : a + CHUNK])
        if len(used):
            chunks.append(a // CHUNK)
            cells.append(struct.pack("<I", len(used)) + used.astype("<u2").tobytes() + total[a : a + CHUNK][used].astype("<u4").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(cells, pa.binary())], names=["chunk", "cells"])


def _add_up(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """(chunk, logits) from rows sorted by chunk; all logits, those less a first turn, those less a second."""
    held, total = None, np.zeros(CHUNK, np.int64)

    def out() -> pa.RecordBatch:
        code = layout.codes[int(held * CHUNK >= layout.offsets[3])]
        logits = code.logits(total.reshape(-1, SYMBOLS).astype(np.float64))
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([logits.tobytes()], pa.binary())], names=["chunk", "logits"])

    for batch in batches:
        for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held is not None and chunk != held:
                yield out()
                total[:] = 0
            held = chunk
            (n,) = struct.unpack_from("<I", cells)
            total[np.frombuffer(cells, "<u2", n, 4)] += np.frombuffer(cells, "<u4", n, 4 + 2 * n)
    if held is not None:
        yield out()


#: Gates of a code, and of both.
GATES = 6 * 4 * 4
#: The logit of each byte of a table, in the order of the bytes as unsigned numbers.
_LOGIT = (np.arange(256, dtype=np.uint8).view(np.int8) >> 2).astype(np.float32) / 4


class Mixer:
    """The frozen model: layout, logit tables (three rows, as of Code.logits), lexicon and its shares, gate weights."""

    def __init__(self, layout: Layout, tables: np.ndarray, lexicon: Words, spelled: np.ndarray, known: np.ndarray):
        self.layout, self.tables, self.lexicon = layout, tables, lexicon
        #: by class: bits for a word that is not in the lexicon, and for one that is; words of the lexicon
        share = (spelled + 0.5) / (spelled + known + 1)
        self.out_bits, self.in_bits, self.known = -np.log2(share), -np.log2(1 - share), known
        self.weights = np.tile(np.array([0.2, 0.4, 0.5, 0.0], np.float32), (2 * GATES, 1))

    def decisions(self, k: int, symbol: np.ndarray, slots: list[np.ndarray], own: np.ndarray) -> dict[str, np.ndarray]:
        """The decisions of code k: quantised logits of each context, turn, gate; and the steps of each symbol. `own`
        says which symbols are training text: these are left out of their own counts."""
        code = self.layout.codes[k]
        steps = code.length[symbol]
        run = np.cumsum(steps)
        total = int(run[-1]) if len(run) else 0
        # places are kept as numpy's own index type, which it needs for looking up
        path = np.repeat(symbol * code.node.shape[1] - (run - steps), steps)
        path += np.arange(total)
        packed = code.packed.ravel()[path]
        turn = packed >> 6 & 1
        cell = packed & 63
        if own.any():  # the rows of the tables: all counts, less a first turn, less a second
            row = (turn + np.int32(1)) * np.int32(self.tables.shape[1])
            cell += row if own.all() else np.where(np.repeat(own, steps), row, 0)
        flat, logits = self.tables.ravel(), []
        cell = cell.astype(np.int64)
        for offset, slot in zip(self.layout.offsets[3 * k :].tolist(), slots):
            at = np.repeat(slot.astype(np.int64) * SYMBOLS + offset, steps)
            at += cell
            logits.append(flat[at])
        gate = (packed >> 7).astype(np.uint8)
        gate |= (logits[1] & np.int8(3)).view(np.uint8) << 2
        gate |= (logits[2] & np.int8(3)).view(np.uint8)
        gate += np.uint8(GATES * k)
        return {"logits": logits, "turn": turn.astype(np.int8), "gate": gate, "steps": steps}

    def _both(self, t: Tokens, own: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, dict]]:
        """(code, symbol, token, decisions) of classes and of letters; own: which texts are training text; count: the
        lexicon's of each word."""
        symbol, slots = self.layout.classes(t)
        mine = own[t.text]
        yield 0, symbol, np.arange(len(symbol)), self.decisions(0, symbol, slots, mine)
        letter, token, slots = self.layout.letters(t, symbol, np.flatnonzero(count == 0))
        yield 1, letter, token, self.decisions(1, letter, slots, mine[token])

    def tally(self, t: Tokens, total: np.ndarray) -> None:
        """Add decisions of training text to the counts by what the regression knows of them: gate, three logits in steps
        of 1/2, turn."""
        for _, _, _, got in self._both(t, np.ones(len(t.n), bool), self.lexicon.find(t.key[t.words])):
            key = got["gate"].astype(np.int64)
            for q in got["logits"]:
                key <<= 5
                key |= q.view(np.uint8) >> 3
            key <<= 1
            key |= got["turn"]
            np.add.at(total, key, np.uint32(1))

    @staticmethod
    def pulls(keys: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Gradient and, row by row, curvature of the log likelihood for each gate, from a tally."""
        gate, y = keys >> 16, keys & 1
        x = [*(_LOGIT[(keys >> shift & 31) << 3] + 0.125 for shift in (11, 6, 1)), np.ones(len(keys))]
        p = 1 / (1 + np.exp(-np.clip(sum(z * weights[gate, k] for k, z in enumerate(x)), -30, 30)))
        miss, bend = n * (y - p), n * p * (1 - p)
        terms = [miss * z for z in x] + [bend * a * b for a in x for b in x]
        return np.stack([np.bincount(gate, t, minlength=2 * GATES) for t in terms], axis=1)

    def newton(self, pulls, rounds: int = 5) -> None:
        """Gate weights by regularised logistic regression; pulls(weights) sums up a tally."""
        start = self.weights.astype(np.float64)
        w = start.copy()
        for _ in range(rounds):
            got = pulls(w)
            pull, bend = got[:, :4] - 5 * (w - start), got[:, 4:].reshape(-1, 4, 4) + 5 * np.eye(4)
            w = w + np.linalg.solve(bend, pull[:, :, None])[:, :, 0]
        self.weights = np.clip(w, -2, 2).astype(np.float32)

    def bits(self, t: Tokens, own: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
        """Bits of each token. count: the lexicon's of each word, where it is known."""
        count = self.lexicon.find(t.key[t.words]) if count is None else count
        (_, symbol, _, first), (_, letter, token, second) = self._both(t, own, count)
        both = {k: np.concatenate([first[k], second[k]]) for k in ("turn", "gate", "steps")}
        both["logits"] = [np.concatenate(q) for q in zip(first["logits"], second["logits"])]
        cost = self._mixed(both, np.concatenate([t.n, np.bincount(t.text[token], minlength=len(t.n))]))
        out, spelling = cost[: len(symbol)], cost[len(symbol) :] + 8 * (letter == self.layout.codes[1].escape)
        out += np.bincount(token, spelling, minlength=len(out))
        cls, mine = symbol[t.words], own[t.text[t.words]]
        share = np.maximum(count - mine, 1) / np.maximum(self.known[cls] - mine, 1)
        out[t.words] += np.where(count > 0, self.in_bits[cls] - np.log2(share), self.out_bits[cls])
        return out

    def _mixed(self, got: dict[str, np.ndarray], size: np.ndarray) -> np.ndarray:
        """Bits of each symbol. A lane is a text's classes or its letters; size: symbols of each lane, in order. Each has
        an offset of the weights of its own."""
        # weight times logit, for every gate and quantised logit; the last column of the weights is a constant
        gate = got["gate"].astype(np.int64) << 8
        fixed = np.zeros(len(gate), np.float32)
        for k, q in enumerate(got["logits"]):
            products = self.weights[:, k, None] * _LOGIT + (self.weights[:, 3, None] if k == 0 else 0)
            fixed += products.astype(np.float32).ravel()[gate + q.view(np.uint8)]
        # a lane goes on by STEP decisions a step, padded at its end
        run = np.concatenate([[0], np.cumsum(got["steps"])])
        begin = run[np.concatenate([[0], np.cumsum(size)])]
        count = np.diff(begin)
        chunks = -(-count // STEP)
        # all lanes' first chunks, then all second ones: the longest lanes first, so that a step is one stretch of rows
        order = np.argsort(-chunks, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        active = np.searchsorted(-chunks[order], -np.arange(int(chunks.max(initial=0))), side="left")
        row = np.concatenate([[0], np.cumsum(active)])
        lane = np.repeat(np.arange(len(chunks)), chunks)
        step = np.arange(len(lane)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        inside = np.minimum(count[lane] - step * STEP, STEP)  # decisions of a chunk
        at = row[step] + rank[lane]  # the row of each chunk
        source = np.empty_like(at)
        source[at] = begin[lane] + step * STEP
        filled = np.arange(STEP) < inside[:, None]

        def spread(values: np.ndarray) -> np.ndarray:  # a row goes on into the next lane where its own is over
            return np.lib.stride_tricks.sliding_window_view(np.append(values, np.zeros(STEP, values.dtype)), STEP)[source]

        side = spread(got["turn"] * np.int8(2) - np.int8(1))
        side[at] *= filled  # 0 where padded
        mixed = spread(fixed)
        inputs = np.stack([spread(q >> 2) for q in got["logits"]])  # in steps of 1/4
        offset = np.zeros((len(inputs), len(order), 1), np.float32)
        with np.errstate(over="ignore"):
            for s, live in enumerate(active.tolist()):
                rows = slice(row[s], row[s + 1])
                logit, own = mixed[rows], offset[:, :live]
                x = inputs[:, rows].astype(np.float32)
                if s:  # the offset is zero until then
                    for z in x * own:
                        logit += z
                # odds of the other turn
                logit *= -side[rows]
                np.exp(logit, out=logit)
                logit += 1
                if s + 1 < len(active):
                    wrong = side[rows] - side[rows] / logit  # 0 where padded
                    own[:, :, 0] += np.float32(RATE / 16) * np.einsum("kij,ij->ki", x, wrong)
            cost = np.log(mixed, out=mixed)[at][filled]
        total = np.concatenate([[0.0], np.cumsum(cost, dtype=np.float64)])
        return np.diff(total[run]) / math.log(2)


def held_out(id_col: str, parts: int = 10) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 0


def _tally(batches: Iterator[pa.RecordBatch], mixer: Mixer) -> Iterator[pa.RecordBatch]:
    """(key, n): a task's decisions on training text, each key once."""
    total = np.zeros(2 * GATES << 16, np.uint32)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES // 4):
            mixer.tally(Tokens(part.column(0)), total)
    for a in range(0, len(total), 1 << 20):
        used = np.flatnonzero(total[a : a + (1 << 20)])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array((used + a).astype(np.int32)), pa.array(total[a + used].astype(np.int64))], names=["key", "n"])


def _pulls(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2 * GATES, 20))
    for batch in batches:
        total += Mixer.pulls(batch.column(0).to_numpy(), batch.column(1).to_numpy(), weights)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def learn(train: DataFrame, layout: Layout, lexicon: Words, spelled: np.ndarray, known: np.ndarray) -> Mixer:
    """Tables from all texts of train, and gates from all their decisions, each left out of its own counts."""
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((layout, lexicon))
    sparse = map_arrow(train, lambda it: _count_contexts(it, *shared.value), "chunk long, cells binary")
    summed = map_arrow(sparse.repartition("chunk").sortWithinPartitions("chunk"), lambda it: _add_up(it, shared.value[0]), "chunk long, logits binary")
    nothing = np.array([layout.codes[0].logits(np.zeros((1, SYMBOLS)))[0, 0, 0]], np.int8)
    tables = np.full((3, int(layout.offsets[-1])), nothing[0], np.int8)
    for r in summed.toLocalIterator():  # at most 13 MB three times, by TABLE_BITS
        tables[:, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.logits, np.int8).reshape(3, CHUNK)
    mixer = Mixer(layout, tables, lexicon, spelled, known)
    frozen = spark.sparkContext.broadcast(mixer)
    tally = materialize(map_arrow(train, lambda it: _tally(it, frozen.value), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")))
    frozen.destroy()  # the driver keeps a copy of a broadcast until then
    shared.destroy()

    def pulls(weights: np.ndarray) -> np.ndarray:
        rows = map_arrow(tally, lambda it: _pulls(it, weights), "sums binary").collect()  # a row a task
        return sum((np.frombuffer(r.sums).reshape(2 * GATES, 20) for r in rows), np.zeros((2 * GATES, 20)))

    mixer.newton(pulls)
    return mixer


def _savings(scored: DataFrame) -> DataFrame:
    """(row, saved): bits that the decisions on following passages save, for rows where there are any."""
    follows = scored.select("row", F.col("held_out").alias("out"), F.explode(F.arrays_zip("before", "after", "cost")).alias("p")).select("row", "out", "p.before", "p.after", "p.cost")
    pairs = follows.where(~F.col("out")).groupBy("before", "after").agg(F.count("*").alias("n"))
    best = pairs.groupBy("before").agg(F.sum("n").alias("m"), F.max(F.struct("n", "after")).alias("best"))
    table = materialize(best.select("before", "m", F.col("best.n").alias("n"), F.col("best.after").alias("next")))
    passages = table.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    own = (~F.col("out")).cast("int")
    hit = F.col("after") == F.col("next")
    n, m = F.col("n") - own * hit.cast("int"), F.col("m") - own
    met = join_unique(follows, table, "before", "m", passages).where(m > 0)
    met = materialize(met.select("row", "out", "cost", hit.alias("hit"), n.cast("int").alias("n"), m.cast("int").alias("m")))
    state = F.least("n", F.lit(MOST)) * (MOST + 1) + F.least(F.col("m") - F.col("n"), F.lit(MOST))
    share = {(a, b): 2 * (a + 0.4) / (a + b + 0.8) for a in range(MOST + 1) for b in range(MOST + 1)}
    seen = dict.fromkeys(share, 2.0)
    # by state, of which there are 256
    for r in met.where(~F.col("out")).groupBy(state.alias("state")).agg(F.count("*").alias("all"), F.count(F.when(F.col("hit"), 1)).alias("hits")).collect():
        share[divmod(r.state, MOST + 1)] += r.hits
        seen[divmod(r.state, MOST + 1)] += r["all"]
    chance = F.element_at(F.array(*(F.lit(share[x] / seen[x]) for x in sorted(share))), state + 1)
    saved = F.when(F.col("hit"), F.col("cost") + F.log2(chance)).otherwise(F.log2(1 - chance))
    return met.groupBy("row").agg(F.sum(saved).alias("saved"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bits: int = TABLE_BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    score and base_score are log10 probabilities of the whole text; score / (log10(2) * -bytes) gives bits a byte.
    Null texts are empty: one token, the end. Repeated rows each keep a row. Without training documents every count is
    zero and all predictors are even. Extra columns are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    train = docs.where(~held_out(id_col)).select(text.alias("text"))

    counts = materialize(map_arrow(train, _count_words, "kind int, key long, pair int, n long").groupBy("kind", "key", "pair").agg(F.sum("n").alias("n")))
    pairs, letters = np.zeros(1 << 16, np.int64), np.zeros(256, np.int64)
    for r in counts.where("kind > 0").collect():  # 2^16 + 256 rows at most
        (pairs if r.kind == 1 else letters)[r.key] = r.n
    words = counts.where("kind = 0").select("key", "pair", "n")
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = int(pairs[END_PAIR])
    tokens, distinct = n_words + texts, distinct + (texts > 0)
    # by the logarithm of its count, a word belongs to the head if all words as frequent fit in; HEAD rows at most come here
    level = F.floor(8 * F.log2("n")).cast("int")
    room, least = HEAD, 1 << 20
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True):  # some 500 levels at most
        room -= r["count"]
        if room < 0:
            break
        least = r.level
    head_rows = words.where(level >= least).toPandas()
    key, n = head_rows["key"].to_numpy(np.int64), head_rows["n"].to_numpy(np.int64)
    head, often = Words(key, n), n > 1
    letters[SPACE] += texts
    letters[END] = 0
    layout = Layout(pairs, letters, min(table_bits, max(12, distinct.bit_length())))
    cls = layout.codes[0].symbol
    known = np.bincount(cls[head_rows["pair"].to_numpy(np.int64)[often]], n[often], minlength=SYMBOLS)
    spelled = np.bincount(cls, pairs, minlength=SYMBOLS) - known
    spelled[layout.codes[0].always] = 0
    mixer = learn(train, layout, Words(key[often], n[often]), spelled, known)
    shared = spark.sparkContext.broadcast((mixer, head))

    kind = "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, bits double, tail array<long>, times array<int>, before array<long>, after array<long>, cost array<float>"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64())]
        + [("tail", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())), ("cost", pa.list_(pa.float32()))]
    )
    scale = tokens + 0.1 * (distinct + 1)
    small = np.log10((np.arange(TERMS) + 0.1) / scale)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, head = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                t = Tokens(part.column(3))
                keys, rows = t.key[t.words], t.text[t.words]
                count = head.find(keys)
                found = count > 0
                term = small[np.minimum(count, len(small) - 1)]
                high = np.flatnonzero(count >= len(small))
                term[high] = np.log10((count[high] + 0.1) / scale)
                base = np.bincount(rows[found], term[found], minlength=len(t.n))
                base = base + math.log10((texts + 0.1) / scale)
                known = np.bincount(rows[found], minlength=len(t.n)) + (texts > 0)
                # the other words, each once a text
                tail_rows, tail_keys = rows[~found], keys[~found]
                order = np.lexsort((tail_keys, tail_rows))
                tail_rows, tail_keys = tail_rows[order], tail_keys[order]
                heads = np.flatnonzero(np.concatenate([[True], (tail_rows[1:] != tail_rows[:-1]) | (tail_keys[1:] != tail_keys[:-1])])[: len(order)])
                times = np.diff(np.append(heads, len(order))).astype(np.int32)
                # the lexicon is the words of the head that training text holds twice or more
                bits = mixer.bits(t, ~part.column(1).to_numpy(zero_copy_only=False), np.where(count > 1, count, 0))
                first, passage = t.passages()
                cost = np.add.reduceat(bits, first) if len(first) else bits
                after = np.flatnonzero(t.place[first] > 0)  # passages with one before them in their text

                def listed(of: np.ndarray, values: np.ndarray, n: int = len(t.n)) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)), pa.array(values))

                of = t.text[first][after]
                columns = [*part.columns[:3], pa.array(t.n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.bincount(t.text, bits, minlength=len(t.n)))]
                columns += [listed(tail_rows[heads], tail_keys[heads]), listed(tail_rows[heads], times), listed(of, passage[after - 1]), listed(of, passage[after]), listed(of, cost[after].astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    scored = materialize(map_arrow(source, work, kind))
    shared.destroy()
    # words that are not among the most frequent: no word is hot here
    tail = scored.select("row", F.explode(F.arrays_zip(F.col("tail").alias("key"), "times")).alias("w")).select("row", "w.key", "w.times")
    joined = tail.join(words.select("key", "n"), "key", "left")
    term = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(scale))
    terms = joined.groupBy("row").agg(F.sum(F.col("times") * term).alias("tail_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    rows = scored.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "bits")
    return reduce(lambda a, b: a.join(b, "row", "left"), [terms, _savings(scored)], rows).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
        ((F.coalesce("saved", F.lit(0.0)) - F.col("bits")) * _LOG10_2).alias("score"),
    )
