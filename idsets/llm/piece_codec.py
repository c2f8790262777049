"""Encoding to and decoding from the ids of a merge-type piece model, by a prefix table.

For each prefix of a chunk the table holds the one last token of the prefix's own encoding. An automaton over the
vocabulary finds the tokens that end at each place; the one that fits is the longest whose left neighbour, the last token
of the prefix before it, is compatible: merging the texts of the two gives the two again. The ids follow
backwards from the last entry. Chunks split between characters that stand side by side in no piece. Runs of two or more marks are pieces of one same score, for which the table's
uniqueness does not hold; a chunk that begins with such a run goes through plain merging.

Null and empty texts have no ids and decode to the empty text; of equal scores the leftmost pair merges first; a text of any length goes chunk by chunk; repeated rows each get their result; a table without
rows gives none; columns beside doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkCache, numbered
from .common import slices, text_bytes, worker_state

MARK = "▁"
#: Entries a worker keeps; see ChunkCache.
CACHE = 400_000


def load_pieces(path: str) -> dict:
    """What the workers need of a model file: the pieces that texts can give, their ids and scores, and the byte ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = {i: int(model.id_to_piece(i)[3:-1], 16) for i in range(n) if model.is_byte(i)}
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {
        "pieces": {model.id_to_piece(i): (i, model.get_score(i)) for i in plain},
        "bytes": [i for i, _ in sorted(byte_ids.items(), key=lambda x: x[1])],
    }


class PieceCodec:
    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.pieces, self.bytes = vocabulary["pieces"], vocabulary["bytes"]
        self.text = {i: p for p, (i, _) in self.pieces.items()}
        self.raw = {i: p.replace(MARK, " ").encode() for i, p in self.text.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.found = ahocorasick.Automaton()
        for p, (i, _) in self.pieces.items():
            self.found.add_word(p, (len(p), i))
        self.found.make_automaton()
        self.pair: dict[tuple[int, int], bool] = {}
        self.cross = np.zeros((256, 256), bool)  # pairs of neighbouring bytes within pieces
        for p in self.pieces:
            raw = np.frombuffer(p.replace(MARK, " ").encode(), np.uint8)
            self.cross[raw[:-1], raw[1:]] = True

    def merged(self, text: str) -> list[int]:
        """Merging by score, the leftmost of equals first; characters outside the vocabulary become bytes."""
        part, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part) and (hit := self.pieces.get(both := part[a] + part[b])):
                heapq.heappush(heap, (-hit[1], a, b, both))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not part[a] or not part[b] or part[a] + part[b] != both or right[a] != b:
                continue
            part[a], part[b], right[a] = both, "", right[b]
            if right[a] < len(part):
                left[right[a]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[int] = []
        for p in filter(None, part):
            hit = self.pieces.get(p)
            out += [hit[0]] if hit else [self.bytes[x] for x in p.encode()]
        return out

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pair.get((a, b))) is None:
            if len(self.pair) > 2_000_000:
                self.pair.clear()
            known = self.pair[a, b] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return known

    def chunk(self, text: str) -> list[int]:
        """The ids of a chunk, by its prefix table."""
        if text.startswith(MARK * 2):
            return self.merged(text)
        n, pair = len(text), self.pair
        last: list = [None] * n  # None: a character outside the vocabulary, with which nothing merges
        size = [1] * n
        for end, (length, token) in self.found.iter(text):  # at each end, the longest first
            if last[end] is None:
                start = end - length
                if start < 0 or (before := last[start]) is None or ((fits := pair.get((before, token))) is None and self.compatible(before, token)) or fits:
                    last[end], size[end] = token, length
        out: list[int] = []
        at = n - 1
        while at >= 0:
            if last[at] is not None:
                out.append(last[at])
            elif text[at] in self.pieces:
                return self.merged(text)
            else:
                out += [self.bytes[x] for x in text[at].encode()[::-1]]
            at -= size[at]
        return out[::-1]

    def entry(self, raw: bytes) -> tuple[int, bytes, bytes]:
        """Of a chunk: the number of ids, the ids as text, and what they decode to."""
        ids = self.chunk(raw.decode("utf-8", "replace").replace(" ", MARK))
        return len(ids), (",".join(map(str, ids)) + ",").encode(), b"".join([self.raw[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        at, data = marked(pa.array([text]))
        codes, chunks = numbered(data, starts_of(at, data, self.cross))
        return [i for c in codes for i in self.chunk(chunks[c].decode().replace(" ", MARK))]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.raw[i] for i in ids]).decode("utf-8", "replace")[1:] if ids else ""


def marked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) with a space before each text that is not empty, and a space for each mark."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if pc.any(pc.match_substring(column, MARK)).as_py():
        column = pc.replace_substring(column, MARK, " ")
    return text_bytes(pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(""), column, " ")))


def starts_of(at: np.ndarray, data: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Where chunks begin: at texts, and at characters before which no piece goes on."""
    first = np.zeros(len(data), bool)
    first[1:] = ~cross[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
    first[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(first)


def _worker(vocabulary) -> tuple[PieceCodec, ChunkCache]:
    """A worker's codec and cache, kept from task to task while the vocabulary is the same."""
    pieces = vocabulary.value

    def make() -> tuple[PieceCodec, ChunkCache]:
        codec = PieceCodec(pieces)
        return codec, ChunkCache(lambda chunks: [codec.entry(c) for c in chunks], CACHE)

    return worker_state(("pieces", hash(tuple(pieces["pieces"].items()))), make)


def encode_decode(docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns` of each row of docs, with n_tokens, ids_sha256 and decoded_sha256 of its whole text; see the module."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_pieces(model_path))  # the size of the model file, whatever the corpus
    kinds = dict(docs.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cache = _worker(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                at, data = marked(batch.column("text"))
                starts = starts_of(at, data, codec.cross)
                codes, chunks = numbered(data, starts)
                sizes, ids, raws = zip(*cache.entries_of(chunks)) if chunks else ((), (), ())
                firsts = np.searchsorted(starts, at).tolist()
                counts = np.append(0, np.cumsum(np.array(sizes, np.int64)[codes])) if chunks else np.zeros(1, np.int64)
                codes, idsha, rawsha = codes.tolist(), [], []
                for a, b in zip(firsts, firsts[1:]):
                    own = codes[a:b]
                    idsha.append(hashlib.sha256(b"".join([ids[c] for c in own])[:-1]).hexdigest())
                    rawsha.append(hashlib.sha256(b"".join([raws[c] for c in own])[1:]).hexdigest())
                n = counts[firsts[1:]] - counts[firsts[:-1]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n), pa.array(idsha, pa.string()), pa.array(rawsha, pa.string())], [*columns, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])
    return docs.select(*columns, "text").mapInArrow(apply, schema)
