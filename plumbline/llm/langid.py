"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to 3, built from a bounded sample of labelled text and then frozen. In a
context seen N times with U distinct successors, a successor seen n times has probability n / (N + U) and an escape to
the next shorter context has U / (N + U); below order 0 all 256 bytes are equal. A context that a language has never
seen costs nothing and passes on. The code length of a text under a language is the exact sum over its bytes; the
language with the shortest one is predicted.

The trees of all languages are compiled into shared tables. A sequence of up to three bytes that any language has seen
gets a number; a row of code lengths (one for each language) is stored for every seen byte after its context and a
row of escape costs for every context, both with all shorter orders folded in. A byte then costs two table reads,
whatever the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import SLICE_BYTES, map_arrow, materialize, slices, text_buffer

ORDER = 3
#: Bytes of labelled text that a language is learned from at most, and all languages: the bounds of the sample.
SAMPLE_BYTES = 1_000_000
TOTAL_BYTES = 64_000_000
#: Characters of the passages that texts are cut into for the sample.
PASSAGE_CHARS = 2_000
UNDETERMINED = "und"


class ContextTrees:
    """Frozen trees of several languages. `samples` maps each language to its text."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        wide = len(self.languages)
        grams = [[self._count(samples[x], k) for x in self.languages] for k in range(1, ORDER + 2)]
        # per order k: the sequences of k+1 bytes that any language has seen, and counts for each language
        cost = np.full((256, wide), 8.0)
        previous = (np.arange(256, dtype=np.int64), cost)
        self.keys, self.costs, self.escape_keys, self.escapes = [], [], [], []
        for k in range(ORDER + 1):
            every = np.unique(np.concatenate([g for g, _ in grams[k]])) if wide else np.empty(0, np.int64)
            n = np.zeros((len(every), wide))
            for i, (g, c) in enumerate(grams[k]):
                n[np.searchsorted(every, g), i] = c
            contexts, inverse = np.unique(every >> 8, return_inverse=True)
            total = np.zeros((len(contexts), wide))
            distinct = np.zeros((len(contexts), wide))
            np.add.at(total, inverse, n)
            np.add.at(distinct, inverse, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(n / (total + distinct)[inverse])
            lower = self._lookup(*previous, every & ((1 << 8 * max(k, 1)) - 1)) if k else cost[every & 255]
            cost_k = np.where(n > 0, seen, escape[inverse] + lower)
            self.escape_keys.append(contexts)
            self.escapes.append(escape)
            self.keys.append(every)
            self.costs.append(cost_k)
            previous = (every, cost_k)
        self._compile()

    @staticmethod
    def _count(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(text, np.uint8).astype(np.int64)
        if len(raw) < length:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.zeros(len(raw) - length + 1, np.int64)
        for j in range(length):
            codes = codes << 8 | raw[j : len(raw) - length + 1 + j]
        return np.unique(codes, return_counts=True)

    @staticmethod
    def _lookup(keys: np.ndarray, costs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Rows of keys that are known to be there: each suffix of a seen sequence has been seen."""
        return costs[np.searchsorted(keys, wanted)]

    def _compile(self) -> None:
        """Full rows for every order: what a byte costs after any context, found from its longest seen sequence."""
        wide = len(self.languages)
        self.base = np.empty((256, wide), np.float32)  # order 0
        self.base[:] = 8.0 + (self.escapes[0][0] if len(self.escapes[0]) else 0.0)
        self.base[self.keys[0]] = self.costs[0]
        self.tables = [(k, c.astype(np.float32)) for k, c in zip(self.keys[1:], self.costs[1:])]
        self.gaps = [(k, e.astype(np.float32)) for k, e in zip(self.escape_keys[1:], self.escapes[1:])]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("languages", "base", "tables", "gaps")}

    def _direct(self) -> list:
        """Direct-addressed numbers: 256^2 and 256^3 entries, and one page of 256 for each seen three-byte context.

        Untouched pages of a zeroed array take no memory, so only what the languages use is held.
        """
        if not hasattr(self, "_maps"):
            maps = []
            for order in range(1, ORDER):
                keys, gap_keys = self.tables[order - 1][0], self.gaps[order - 1][0]
                to = np.zeros(1 << 8 * (order + 1), np.int32)
                to[keys] = np.arange(1, len(keys) + 1)
                gap = np.zeros(1 << 8 * order, np.int32)
                gap[gap_keys] = np.arange(1, len(gap_keys) + 1)
                maps.append((gap, to))
            keys, gap_keys = self.tables[-1][0], self.gaps[-1][0]
            gap = np.zeros(1 << 24, np.int32)
            gap[gap_keys] = np.arange(1, len(gap_keys) + 1)
            page = np.zeros((len(gap_keys) + 1) * 256, np.int32)
            page[gap[keys >> 8].astype(np.int64) * 256 + (keys & 255)] = np.arange(1, len(keys) + 1)
            maps.append((gap, page))
            self._maps = maps
        return self._maps

    def byte_costs(self, raw: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """(bytes, languages) code lengths in bits. firsts: where texts begin; contexts don't cross these."""
        out = self.base[raw]
        if not len(raw) or not self.languages:
            return out
        at = np.zeros(len(raw), np.int64)
        at[firsts[firsts < len(raw)]] = 1
        start = np.maximum.accumulate(np.where(at, np.arange(len(raw)), 0))
        depth = np.arange(len(raw)) - start
        code = np.zeros(len(raw), np.int64)
        for order, (gap, to) in enumerate(self._direct(), 1):
            context = code[:-1] << 8 | raw[:-1] if order > 1 else raw[:-1].astype(np.int64)
            context = context & ((1 << 8 * order) - 1)
            code = np.concatenate([[0], context])
            ok = depth >= order
            number = np.where(ok, gap[code], 0)
            seen = np.flatnonzero(number)
            row = to[number[seen].astype(np.int64) * 256 + raw[seen]] if order == ORDER else to[code[seen] << 8 | raw[seen]]
            costs, escapes = self.tables[order - 1][1], self.gaps[order - 1][1]
            hit = row > 0
            out[seen[hit]] = costs[row[hit] - 1]
            miss = seen[~hit]
            out[miss] += escapes[number[miss] - 1]
        return out

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """(texts, languages): exact bits of each whole text."""
        raw, ends = text_buffer(column)
        total = np.zeros((len(column), len(self.languages)))
        for a in range(0, len(raw), 1 << 20):  # a long text is summed over stretches, each with its context
            b = min(len(raw), a + (1 << 20))
            back = max(0, a - ORDER)
            firsts = ends[(ends >= back) & (ends < b)] - back
            if not len(firsts) or firsts[0] > 0:
                firsts = np.concatenate([[0], firsts])  # begins inside a text, whose last bytes serve as context
            costs = self.byte_costs(raw[back:b], firsts)[a - back :]
            rows = np.searchsorted(ends, np.arange(a, b), side="right") - 1
            heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            total[rows[heads]] += np.add.reduceat(costs, heads, axis=0, dtype=np.float64)
        return total

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, bits a byte) of each text.

        The score is the posterior probability of the predicted language with equal priors, 0 for `und`.
        """
        bits = self.code_lengths(column)
        _, ends = text_buffer(column)
        letter = np.array([any(map(str.isalpha, t or "")) for t in column.to_pylist()], bool)
        if not self.languages:
            letter[:] = False
            return [UNDETERMINED] * len(column), np.zeros(len(column)), np.zeros(len(column))
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score = 1 / np.exp2(np.minimum(0, least[:, None] - bits)).sum(axis=1)
        names = [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), letter.tolist())]
        return names, np.where(letter, score, 0.0), least / np.maximum(1, np.diff(ends))


def held_out(id_col: str, parts: int = 5) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts == 0


def learn(docs: DataFrame, text_col: str, lang_col: str, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> ContextTrees:
    """Trees from a bounded sample: for each language, passages in the order of a hash, up to sample_bytes.

    Whole texts are cut into passages, so that any part of a text is as likely to be learned from; equal passages count
    once. With many languages each has an equal part of total_bytes. The sample is the same for any partitioning of the
    rows, and the driver never holds more than these bounds. Null and empty texts and null languages teach nothing; an
    empty table gives trees of no language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null and text != ''")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return ContextTrees({})
    most = min(sample_bytes, total_bytes // len(sizes))
    # by the hash, about twice the share that is needed is written, and read back in order
    shares = {lang: min(1.0, (2 * most + 40 * PASSAGE_CHARS) / n) for lang, n in sizes.items()}
    bounds = [x for lang, share in shares.items() for x in (F.lit(lang), F.lit(min((1 << 63) - 1, int((share * 2 - 1) * 2**63))))]
    passages = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE_CHARS}}}"), F.lit(0))).alias("text"))
    placed = passages.select("lang", F.xxhash64("text").alias("place"), "text")
    chosen = materialize(placed.where(F.col("place") <= F.create_map(*bounds)[F.col("lang")]).distinct())
    samples = {lang: bytearray() for lang in sizes}
    for r in chosen.orderBy("lang", "place", "text").toLocalIterator():
        if len(samples[r.lang]) < most:
            samples[r.lang] += r.text.encode("utf-8", "surrogatepass") + b"\n"
    return ContextTrees({lang: bytes(x[:most]) for lang, x in samples.items() if x})


def identify(docs: DataFrame, trees: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for each row; no shuffle.

    Null, empty and letterless texts are `und` with score 0; so is everything if nothing was learned. Ties go to the
    language that sorts first. Repeated rows each keep a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by languages and SAMPLE_BYTES
    names = ["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES // 4):
                lang, score, rate = shared.value.predict(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, work, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, trees: ContextTrees, text_col: str = "text", most_bits: float = 6.0) -> DataFrame:
    """The rows whose language is determined and whose text takes at most most_bits a byte in it, all columns kept.

    Null, empty and letterless texts go, as all do if nothing was learned. Repeated rows each keep a row; an empty table
    gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE_BYTES // 4):
                lang, _, rate = shared.value.predict(part.column(at))
                yield part.filter(pa.array([x != UNDETERMINED and r <= most_bits for x, r in zip(lang, rate.tolist())], pa.bool_()))

    return map_arrow(docs, work, docs.schema)
