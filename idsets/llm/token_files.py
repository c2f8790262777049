"""Token ids of documents as ORC files, in ascending doc_id order.

Each row is a document: its ids as integers (run-length encoded by ORC), their number, and where they start among all
ids of its part. Stripes are read in parallel; row indexes and Bloom filters on doc_id let a lookup of some documents
skip stripes and row groups by metadata alone. The parts are ranges of doc_id; a table of the parts' totals, with a
row for each file, gives the ids before each part.

The tokenizer works once on each different chunk of a worker's texts. Chunks end at white space and between ASCII
letters (or Latin-1 ones) and ASCII punctuation but the apostrophe, where its own splitting always cuts; texts that
hold a special token's string split at white space alone.

Null and empty texts give the end id alone; repeated rows and rows of one doc_id each keep their place (by the text's hash, then the text); a null
doc_id comes first; a row has all ids of its text, so a text may have up to 2 ** 31 of them; a table without rows gives files without rows; other columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import FlatCache, coded, ragged
from .common import scratch, slices, text_bytes, worker_state

#: Entries a worker keeps; see FlatCache.
CACHE = 2_000_000
#: Bytes of text that a step handles at once.
STEP = 8 << 20
#: Chunks that the tokenizer gets as one text, with SEPARATOR between them.
JOINED = 1000
SEPARATOR = "\x00"

_SPACE, _LETTER, _PUNCT = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = _PUNCT


# The pipeline for which a chunk of ASCII and Latin-1 letters goes to the merges as it is, in lower case, and the characters that stand for bytes there.
_PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {chr(b): chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN) if b >= 128}
_LETTERS = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def chunk_bounds(at: np.ndarray, data: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the chunks of texts at offsets `at`."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    solid = kind != _SPACE
    if len(data) > 1:
        a, b = kind[:-1], kind[1:]
        edge[1:-1] |= solid[1:] != solid[:-1]
        if not special:
            # C3 80 .. C3 BF are letters but for C3 97 and C3 B7
            latin = (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[:-1] == 0xC3)
            left = a == _LETTER
            left[1:] |= latin[:-1]
            right = b == _LETTER
            edge[1:-1] |= left & (b == _PUNCT) | (a == _PUNCT) & right
    cuts = np.flatnonzero(edge[:-1] if len(data) else edge[:0])
    ends = np.append(cuts[1:], len(data))
    keep = solid[cuts] if len(cuts) else np.zeros(0, bool)
    return cuts[keep], ends[keep]


class WordEncoder:
    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        pipeline = json.loads(tokenizer_json)
        self.direct, self.model = all(pipeline[k] == v for k, v in _PIPELINE.items()), self.tokenizer.model
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = FlatCache(self.encode, CACHE)

    def encode(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each chunk, all ids)."""
        plain = pc.match_substring_regex(chunks.cast(pa.string()), _LETTERS).to_numpy(zero_copy_only=False) & self.direct
        lists: list = [None] * len(chunks)
        letters, rest = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        if len(letters):
            shown = b"\n".join(chunks.take(pa.array(letters)).to_pylist()).decode().lower().encode().decode("latin-1")
            for b, c in _BYTE_LEVEL.items():
                shown = shown.replace(b, c)
            tokenize = self.model.tokenize
            for k, w in zip(letters.tolist(), shown.split("\n"), strict=True):
                lists[k] = [t.id for t in tokenize(w)]
        chunks = chunks.take(pa.array(rest, pa.int64())).to_pylist()
        alone = len(self.separator) != 1
        for i in range(0, len(rest), JOINED):
            own = rest[i : i + JOINED]
            texts = [c.decode() for c in chunks[i : i + JOINED]]
            joined = f" {SEPARATOR} ".join(texts)
            if alone or joined.count(SEPARATOR) != len(own) - 1:  # a chunk holds the separator itself
                found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            else:
                ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
                cuts = [k for k, x in enumerate(ids) if x == self.separator[0]]
                found = [ids[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(ids)])]
            for k, x in zip(own, found, strict=True):
                lists[k] = x
        return np.array([len(x) for x in lists], np.int64), np.array(list(chain.from_iterable(lists)), np.int32)

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts."""
        at, data = text_bytes(column)
        raw = memoryview(data)
        starts, ends = chunk_bounds(at, data, any(_has(raw, s) for s in self.special))
        codes, chunks = coded(data, starts, ends)
        begin, sizes, values = self.cache.lists_of(chunks)
        ids, firsts = ragged(values, begin[codes], sizes[codes])
        return firsts[np.searchsorted(starts, at)], ids


def _has(raw: memoryview, part: bytes) -> bool:
    return re.search(re.escape(part), raw) is not None


def _worker(tokenizer) -> WordEncoder:
    return worker_state(("words", hash(tokenizer.value)), lambda: WordEncoder(tokenizer.value))


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2) -> None:
    """The ids of each whole text of docs, with end_id after each document, as ORC files below path."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = docs.sparkSession.sparkContext.broadcast(f.read())  # the size of the vocabulary file

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        encoder = _worker(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                at, ids = encoder.flat(batch.column("text"))
                ends = np.append(0, at[1:] + np.arange(1, len(at)))
                ids = np.insert(ids, at[1:], end_id).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column("doc_id"), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], ["part", "doc_id", "part_start", "n_tokens", "ids"])
                start += int(ends[-1])

    rows = docs.select("doc_id", "text")
    # the hash deals out the rows of a doc_id that many rows share
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    (
        ordered.mapInArrow(apply, f"part int, doc_id {dict(docs.dtypes)['doc_id']}, part_start bigint, n_tokens bigint, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.compress", "zstd")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    # a row for each file
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """doc_id, n_tokens and ids of some documents: the filter reaches the ORC reader, which skips stripes by their Bloom filters and row groups by their indexes."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """tokens without the ids, but with ids_crc32 of them as little-endian unsigned 32-bit integers."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy() * 4
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(apply, f"doc_id {dict(tokens.dtypes)['doc_id']}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes docs' ids to a new place in the shared folder and gives the digest of each document, from the files."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id)
    return with_crc32(read_tokens(docs.sparkSession, path))
