"""Token ids in patched frame-of-reference files.

File format (all numbers little-endian):

    header   4s magic "PFR1", u32 block length, u64 ids, u32 blocks, u32 documents
    documents  per document: i64 doc_id, u8 has_id, u64 first id (within the file), u64 ids
    index      per block: u64 byte start within the block area
    blocks     per block: u32 minimum, u8 width, u8 exceptions, u16 ids; packed ids; u8 positions; u32 values

A block holds 128 ids. The block's minimum is subtracted; `width` is the bit width that a chosen percentile of the
differences needs (0.9 unless told otherwise). Differences that need more bits are stored whole in the exception lists
and as zero in the packed part. Value i of a block occupies bits i*width to (i+1)*width of a little-endian bit string.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import HELD, map_arrow, materialize, slices

BLOCK = 128
_HEADER = struct.Struct("<4sIQII")
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("start", "<u8"), ("n", "<u8")])
_BLOCK = np.dtype([("base", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("n", "<u2")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(128, k) values under 2^width to (k, 2*width) 64-bit words."""
    words = np.zeros((2 * width, values.shape[1]), np.uint64)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        words[at] |= values[i] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= values[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of _pack."""
    words = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, words.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        at, shift = divmod(i * width, 64)
        x = words[at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[at + 1] << np.uint64(64 - shift)
        out[i] = x & mask
    return out


def encode_file(docs: list[tuple[int | None, np.ndarray]], percentile: float = 0.9) -> bytes:
    """The bytes of one file with the ids (unsigned 32-bit) of the documents, in the given order."""
    lengths = np.array([len(x) for _, x in docs], np.int64)
    ids = np.concatenate([x for _, x in docs]).astype(np.uint32) if len(docs) else np.empty(0, np.uint32)
    table = np.zeros(len(docs), _DOC)
    table["doc_id"] = [0 if d is None else d for d, _ in docs]
    table["has_id"] = [d is not None for d, _ in docs]
    table["n"] = lengths
    table["start"] = np.cumsum(lengths) - lengths
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.full(n_blocks * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    padded[: len(ids)] = ids
    blocks = padded.reshape(n_blocks, BLOCK)
    heads = np.zeros(n_blocks, _BLOCK)
    heads["base"] = blocks.min(axis=1) if n_blocks else 0
    heads["n"] = BLOCK
    if n_blocks and len(ids) % BLOCK:
        heads["n"][-1] = len(ids) % BLOCK
    rest = blocks - heads["base"][:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    typical = np.partition(rest, at, axis=1)[:, at] if n_blocks else np.empty(0, np.uint32)
    heads["width"] = np.frexp(typical.astype(np.float64))[1]  # bits of a whole number
    odd = rest.astype(np.uint64) >> heads["width"].astype(np.uint64)[:, None] > 0
    heads["exceptions"] = odd.sum(axis=1)
    packed: list[bytes] = [b""] * n_blocks
    for width in set(heads["width"].tolist()) - {0}:
        rows = np.flatnonzero(heads["width"] == width)
        words = _pack(np.ascontiguousarray(np.where(odd[rows], 0, rest[rows]).T.astype(np.uint64)), width)
        raw = words.astype("<u8").tobytes()
        step = 16 * width
        for k, row in enumerate(rows.tolist()):
            packed[row] = raw[k * step : (k + 1) * step]
    row, position = np.nonzero(odd)
    cuts = np.searchsorted(row, np.arange(n_blocks + 1))
    positions, values = position.astype(np.uint8), rest[odd].astype("<u4")
    raw = heads.tobytes()
    parts = [raw[k * _BLOCK.itemsize : (k + 1) * _BLOCK.itemsize] + packed[k] for k in range(n_blocks)]
    for k in np.flatnonzero(heads["exceptions"]).tolist():
        a, b = cuts[k], cuts[k + 1]
        parts[k] += positions[a:b].tobytes() + values[a:b].tobytes()
    sizes = np.fromiter(map(len, parts), np.int64, n_blocks)
    index = (np.cumsum(sizes) - sizes).astype("<u8")
    return b"".join([_HEADER.pack(b"PFR1", BLOCK, len(ids), n_blocks, len(docs)), table.tobytes(), index.tobytes(), *parts])


def decode_file(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document table, ids) of a file."""
    magic, block, n_ids, n_blocks, n_docs = _HEADER.unpack_from(data)
    if magic != b"PFR1" or block != BLOCK:
        raise ValueError("not a token file")
    at = _HEADER.size
    table = np.frombuffer(data, _DOC, n_docs, at)
    at += n_docs * _DOC.itemsize
    index = np.frombuffer(data, "<u8", n_blocks, at).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at + 8 * n_blocks :]
    if not n_blocks:
        return table, np.empty(0, np.uint32)
    heads = raw[index[:, None] + np.arange(_BLOCK.itemsize)].copy().view(_BLOCK)[:, 0]
    out = np.empty((n_blocks, BLOCK), np.uint64)
    for width in np.unique(heads["width"]).tolist():
        rows = np.flatnonzero(heads["width"] == width)
        if not width:
            out[rows] = 0
            continue
        body = raw[(index[rows] + _BLOCK.itemsize)[:, None] + np.arange(16 * width)]
        out[rows] = _unpack(np.ascontiguousarray(body).view("<u8"), width).T
    for k in np.flatnonzero(heads["exceptions"]).tolist():
        count = int(heads["exceptions"][k])
        start = int(index[k]) + _BLOCK.itemsize + 16 * int(heads["width"][k])
        values = raw[start + count : start + 5 * count].copy().view("<u4")
        out[k, raw[start : start + count]] = values
    out += heads["base"].astype(np.uint64)[:, None]
    return table, out.reshape(-1)[:n_ids].astype(np.uint32)


def read_block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k alone, found through the index of block starts."""
    _, _, _, n_blocks, n_docs = _HEADER.unpack_from(data)
    at = _HEADER.size + n_docs * _DOC.itemsize
    start = at + 8 * n_blocks + int(np.frombuffer(data, "<u8", 1, at + 8 * k)[0])
    head = np.frombuffer(data, _BLOCK, 1, start)[0]
    width, count = int(head["width"]), int(head["exceptions"])
    start += _BLOCK.itemsize
    words = np.frombuffer(data, "<u8", 2 * width, start)[None]
    out = _unpack(words, width)[:, 0] if width else np.zeros(BLOCK, np.uint64)
    start += 16 * width
    out[np.frombuffer(data, np.uint8, count, start)] = np.frombuffer(data, "<u4", count, start + count)
    return (out + np.uint64(head["base"]))[: int(head["n"])].astype(np.uint32)


class _Words(dict):
    """word -> number; a word that is not there yet gets the next number and waits to be encoded."""

    def __init__(self, known=()):
        super().__init__(known)
        self.waiting: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.waiting.append(word)
        return number


class _Pieces(dict):
    """piece of a word -> its ids as bytes, from the library's model; a space stands between words."""

    GAP = 2**32 - 1

    def __init__(self, model):
        super().__init__({" ": self.GAP.to_bytes(4, "little")})
        self.model = model
        # the byte-level alphabet: bytes that show stand for themselves, the others for 256, 257, ...
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = iter(range(256, 512))
        self.letters = [chr(b if b in shown else next(hidden)) for b in range(256)]

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        out = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        return out


class WordEncoder:
    """Exact ids of whole texts through a tokenizers file, with a bounded cache of words.

    Words between ASCII white space are encoded apart where that provably gives the ids of the whole text: the file's
    normaliser works on each character or on runs without white space, its pre-tokeniser never matches across white
    space, and its model is called for each piece. Of the words not met before, those of printable ASCII and the
    letters U+00C0 to U+017F are cut into pieces here, and pieces not met before go to the library's model; every other
    word goes through the library whole. A file built otherwise is used on whole texts only.

    A slice of texts is cut into words and each different word looked up once. When there are more words than
    `cache_words`, those met once since the last time are forgotten, and the least used ones beyond half of the room.
    """

    #: The only structure that the word path is proved for: fixed values.
    _REPLACE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    _PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, spec: str, cache_words: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.cache_words = cache_words
        tree = json.loads(spec)
        steps = (tree.get("normalizer") or {}).get("normalizers", [])
        split, *byte_level = (tree.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.by_word = (
            steps == [{"type": "NFC"}, self._REPLACE, {"type": "Lowercase"}]
            and (split.get("pattern") or {}).get("Regex") == self._PATTERN
            and split.get("behavior") == "Removed"
            and split.get("invert") is True
            and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in byte_level] == [("ByteLevel", False, False)]
            and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] for x in tree["added_tokens"])
            and tree["post_processor"] is None
            and tree["model"].get("end_of_word_suffix") == "</w>"
        )
        self.special = [x["content"] for x in tree["added_tokens"]]
        letters = "a-zß-öø-ıĳ-ňŊ-ſ"
        self._plain_words = re.compile(r"[ -~À-ÖØ-öø-įıĳ-ňŊ-ſ]+")
        self._pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^ 0-9{letters}]+| ")
        self.pieces = _Pieces(self.library.model)
        self.words = _Words({b"": 0})
        self.first, self.count, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _forget(self) -> None:
        """Keep the words met twice or more, at most half as many as there is room for, by how often they were met."""
        kept = np.argsort(-self.used, kind="stable")[: self.cache_words // 2]
        kept = np.sort(kept[self.used[kept] > 1])
        kept = np.concatenate([[0], kept[kept > 0]])
        names, first, count, used, ids = list(self.words), self.first[kept], self.count[kept], self.used[kept], self.ids
        self.words = _Words(zip([names[i] for i in kept.tolist()], range(len(kept))))
        run = np.cumsum(count)
        self.first, self.count, self.used = run - count, count, used // 2
        self.ids = ids[np.repeat(first - run + count, count) + np.arange(run[-1])]

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.library.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, np.uint32)

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word) for words not met before."""
        plain: list[bool] = []
        known: list[str] = []
        for a in range(0, len(words), 500):
            text = b" ".join(words[a : a + 500]).decode("utf-8", "surrogatepass")
            if self._plain_words.fullmatch(text) and not any(s in text for s in self.special):
                plain += [True] * min(500, len(words) - a)
                known.append(text)
                continue
            for t in text.split(" "):
                plain.append(bool(self._plain_words.fullmatch(t)) and not any(s in t for s in self.special))
                if plain[-1]:
                    known.append(t)
        if len(self.pieces) > 2 * self.cache_words:
            self.pieces = _Pieces(self.library.model)
        found = self._pieces.findall(" ".join([*known, ""]).lower())
        got = np.frombuffer(b"".join(map(self.pieces.__getitem__, found)), "<u4")
        gaps = np.flatnonzero(got == self.pieces.GAP)
        bounds = np.concatenate([[0], gaps - np.arange(len(gaps))])
        got = got[got != self.pieces.GAP]
        if len(gaps) != sum(plain):
            plain, got, bounds = [False] * len(words), got[:0], bounds[:1]
        if all(plain):
            return got, np.diff(bounds)
        known = iter(np.split(got, bounds[1:-1]) if len(bounds) > 1 else ())
        each = [next(known) if ok else self._whole(w) for w, ok in zip(words, plain)]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def encode_all(self, texts: list[bytes] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, unsigned 32-bit; null is an empty text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()).cast(pa.string())
        if not self.by_word:
            return [self._whole(t or b"") for t in column.cast(pa.binary()).to_pylist()]
        if len(self.words) > self.cache_words:
            self._forget()
        split = pc.ascii_split_whitespace(column.fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.waiting:
            ids, count = self._learn(self.words.waiting)
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.used = np.concatenate([self.used, np.zeros(len(count), np.int64)])
            self.ids = np.concatenate([self.ids, ids])
            self.words.waiting = []
        numbers = numbers[coded.indices.to_numpy()]
        self.used += np.bincount(numbers, minlength=len(self.used))
        count = self.count[numbers]
        run = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[numbers] - run + count, count) + np.arange(run[-1] if len(run) else 0)]
        ends = np.concatenate([[0], run])[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()] if len(column) else run
        return np.split(ids, ends[:-1]) if len(column) else []


_ENCODERS: dict[int, WordEncoder] = HELD.setdefault("encoders", {})


def encoder(spec: str) -> WordEncoder:
    """One encoder a worker process and file."""
    key = zlib.crc32(spec.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def write_token_files(
    docs: DataFrame, spec: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text",
    percentile: float = 0.9, file_ids: int = 1 << 19,
) -> DataFrame:
    """Encode every whole text and write token files in ascending id order; returns the written table.

    Rows: part (ordinal of the range of ids), first (ids of the part before this file), n_ids, file (as above). Files
    hold whole documents, about `file_ids` ids each, so a document is never split. The table is Parquet in the shared
    folder, so that any store works. `spec` is the text of a tokenizers file. Null texts are empty; rows with a null id
    come first; equal ids are ordered by their text. Extra columns are ignored.
    """
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("file", pa.binary())])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)  # a vocabulary file: fixed size, a few MB
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, first, held, count = encoder(shared.value), 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([count], pa.int64()), pa.array([encode_file(held, percentile)], pa.binary())],
                schema=schema,
            )

        part = 0
        for batch in batches:
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            for piece in slices(batch, "text"):
                for doc, ids in zip(piece.column(0).to_pylist(), enc.encode_all(piece.column(1))):
                    ids = np.concatenate([ids, tail])
                    held.append((doc, ids))
                    count += len(ids)
                    if count >= file_ids:
                        yield out()
                        first, held, count = first + count, [], 0
        if held:
            yield out()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows that share an id, or have none, are split by how their text begins
    ranges = source.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    files = map_arrow(ranges.withColumn("part", F.spark_partition_id()), work, "part int, first long, n_ids long, file binary", keep="encoders")
    return materialize(files)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files alone.

    start counts the ids of all documents before it: those of the earlier parts (one number a part comes to the
    driver; a part is a shuffle partition), of the part's earlier files, and of the file's earlier documents.
    """
    starts, total = {}, 0
    for row in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        starts[row.part] = total
        total += row.n
    shared = files.sparkSession.sparkContext.broadcast(starts)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                table, ids = decode_file(data)
                raw, base = memoryview(ids.astype("<u4").tobytes()), shared.value[part] + first
                ends = (table["start"] + table["n"]).tolist()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(table["start"].tolist(), ends)]
                doc_ids = pa.array(table["doc_id"], pa.int64(), mask=table["has_id"] == 0)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, pa.array(table["start"].astype(np.int64) + base), pa.array(table["n"].astype(np.int64)), pa.array(crcs, pa.int64())],
                    schema=schema,
                )

    columns = files.select("part", "first", "file")
    return map_arrow(columns, work, "doc_id long, start long, n_tokens long, ids_crc32 long")
