"""Occurrences of benchmark passages in documents: a prefix-filtered set join, then exact checks.

Texts are words after A-Z are lower-cased. A window is `size` consecutive words of an item; an item with fewer words, but
some, is one window. A window's tokens are its shingles of three words (windows of one or two words: its words). For a
window to be contained in a document's window of the same length all of its tokens must be there, so a prefix of one
token, the rarest, is enough to find it: document frequencies of all tokens are counted over all documents, and each window is
looked up by its rarest token only. The token's place in the window gives the one place where the window can
start; length and position bounds drop starts before the first and ends after the last word; then the words are compared exactly.

A benchmark of up to BLOCK_BYTES of text is broadcast, with its windows. A larger one stays in tables: the windows are made by executors, join the tokens' frequencies for their
prefixes, and meet the documents' windows around prefix tokens by a shuffled join on the window's hash and words. Only a table of bits of bounded size is broadcast then, which lets the documents leave out most other tokens.

Null and empty texts have no words and no hits; an item without words matches nothing; repeated rows each get their
result; items of one id, or of a null one (which has the empty id), count once in `items`; an empty table of documents gives no rows, an empty
benchmark no hits; of equally rare tokens the least by hash counts, which changes no result; a long text is one step, with some 40 bytes for each of its own; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idsets.operators import bitmaps

from .common import aside, discard, powers, slices, text_bytes, written

#: Characters of item texts that may be broadcast.
BLOCK_BYTES = 2 << 20
#: The bits that tell most tokens which aren't wanted, as a power of two.
FILTER = 26
SHINGLE = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


class Words:
    """The words of texts: their bytes, bounds, hashes, and firsts: for each text the number of its first word, with the end."""

    def __init__(self, at: np.ndarray, data: np.ndarray, letters: np.ndarray = _WORD):
        """letters: for each byte whether words hold it."""
        data = _LOWER[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        word = letters[data]
        if len(data):
            edge[1:-1] |= word[1:] != word[:-1]
        cuts = np.flatnonzero(edge)
        keep = word[cuts[:-1]] if len(data) else np.zeros(0, bool)
        self.starts, self.ends = cuts[:-1][keep], cuts[1:][keep]
        self.raw = data.tobytes()
        self.firsts = np.searchsorted(self.starts, at)
        sizes = self.ends - self.starts
        begin = np.append(0, np.cumsum(sizes))
        if len(sizes):
            offset = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
            power = powers(0x9E3779B97F4A7C15, int(sizes.max()))
            self.hashes = mix(np.add.reduceat((data[word].astype(np.uint64) + np.uint64(1)) * power[offset], begin[:-1]))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def shingles(self, size: int) -> np.ndarray:
        """The hash of `size` words from each word on; past a text's end the value means nothing."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[k : k + n])
        return out

    def joined(self, first: int, n: int) -> bytes:
        return b" ".join([self.raw[a:b] for a, b in zip(self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist())])


class Lookup:
    """Membership of many hashes in a sorted table, most of them turned away by a bit table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in hashes, places in keys) of what is found."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(44)).astype(np.int64)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[key] == hashes[at]
        return at[hit], key[hit]


def windows_of(items: list[tuple[str, str]], size: int) -> dict:
    """The windows of a block of (id, text): ids, words and lengths, the token hashes and, for each window, where its tokens are."""
    words = Words(*text_bytes(pa.array([t for _, t in items], pa.string())))
    firsts, lengths, owners = [], [], []
    for k, (a, b) in enumerate(zip(words.firsts.tolist(), words.firsts[1:].tolist())):
        n = min(size, b - a)
        own = range(a, b - n + 1) if n else range(0)
        firsts += own
        lengths += [n] * len(own)
        owners += [k] * len(own)
    long, single = words.shingles(SHINGLE), words.shingles(1)
    tokens = [long[f : f + n - SHINGLE + 1] if n >= SHINGLE else single[f : f + n] for f, n in zip(firsts, lengths)]
    return {"text": [words.joined(f, n) for f, n in zip(firsts, lengths)], "length": np.array(lengths, np.int64), "item": np.array(owners, np.int64), "tokens": tokens, "keys": np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)}


def rare_first(block: dict, counts: np.ndarray) -> dict:
    """What the documents are probed with: sorted prefix tokens and, for each, its windows and the token's place in them."""
    prefix, place = [], []
    for t in block["tokens"]:
        k = int(np.lexsort((t, counts[np.searchsorted(block["keys"], t)]))[0])
        prefix.append(t[k])
        place.append(k)
    prefix = np.array(prefix, np.uint64)
    order = np.argsort(prefix, kind="stable")
    keys, begin = np.unique(prefix[order], return_index=True)
    return {"keys": keys, "begin": np.append(begin, len(order)), "window": order, "place": np.array(place, np.int64), "length": block["length"], "item": block["item"], "text": block["text"]}


def _counts(docs: DataFrame, keys: np.ndarray) -> np.ndarray:
    """For each token the number of documents that hold it, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(shared.value)
        total = np.zeros(len(table.keys), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*text_bytes(batch.column("text")))
                text, ends = words.text_of(), words.firsts[1:]
                for size in (SHINGLE, 1):
                    at, key = table.find(words.shingles(size))
                    inside = at + size <= ends[text[at]]
                    pairs = np.unique(text[at[inside]] * len(total) + key[inside])
                    total += np.bincount(pairs % len(total), minlength=len(total)) if len(pairs) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    out = np.zeros(len(keys), np.int64)
    if len(keys):
        found = docs.select("text").mapInArrow(apply, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()  # a row for each token of the block at most
        out[found.column("token").to_numpy()] = found.column("n").to_numpy()
    return out


def _probe(docs: DataFrame, block: dict, ids: list[str]) -> DataFrame:
    """docs with the block's hits added to n_words, spans and items."""
    shared = docs.sparkSession.sparkContext.broadcast((block, ids))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids = shared.value
        table = Lookup(block["keys"])
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*text_bytes(batch.column("text")))
                text, ends = words.text_of(), words.firsts
                items = [set(x) for x in batch.column("items").to_pylist()]
                spans = [[(s["first"], s["end"]) for s in x] for x in batch.column("spans").to_pylist()]
                for size in (SHINGLE, 1):
                    at, key = table.find(words.shingles(size))
                    n = (block["begin"][1:] - block["begin"][:-1])[key]
                    slot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block["begin"][key], n)
                    window, at = block["window"][slot], np.repeat(at, n)
                    length, start, own = block["length"][window], at - block["place"][window], text[at]
                    bound = (start >= ends[own]) & (start + length <= ends[own + 1]) & ((length >= SHINGLE) == (size == SHINGLE))
                    for w, a, k, d in zip(window[bound].tolist(), start[bound].tolist(), length[bound].tolist(), own[bound].tolist()):
                        if words.joined(a, k) == block["text"][w]:
                            items[d].add(ids[block["item"][w]])
                            spans[d].append((a - int(ends[d]), a - int(ends[d]) + k))
                merged = [[{"first": a, "end": b} for a, b in union(s)] for s in spans]
                columns = {c: batch.column(c) for c in batch.schema.names}
                columns |= {"n_words": pa.array(np.diff(ends), pa.int64()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "spans": pa.array(merged, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(apply, docs.schema)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans as the fewest (first, end) in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


class Bits:
    """Membership of hashes in a table of 2 ** FILTER bits: no wanted hash is missed, and few others pass."""

    def __init__(self, tokens: DataFrame):
        """tokens: (token). At most 2 ** FILTER bits come to the driver."""
        place = (F.shiftrightunsigned("token", 64 - FILTER) + 1).alias("id")
        self.bits = np.zeros(1 << FILTER >> 3, np.uint8)
        for r in bitmaps.construct(tokens.select(place)).collect():
            at = (r.bucket - 1) * bitmaps.SPAN >> 3
            self.bits[at : at + len(r.bits)] = np.frombuffer(r.bits, np.uint8)[: len(self.bits) - at]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - FILTER)).astype(np.int64)
        return np.flatnonzero(self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def _window_rows(size: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 18):
                found = windows_of(list(zip(batch.column("item").to_pylist(), batch.column("text").to_pylist())), size)
                names = batch.column("item").take(pa.array(found["item"]))
                yield pa.RecordBatch.from_arrays([names, pa.array(found["text"], pa.binary()), pa.array(found["length"]), pa.array([t.view(np.int64) for t in found["tokens"]], pa.list_(pa.int64()))], ["item", "words", "length", "tokens"])

    return apply


def _by_join(rows: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """rows (with text, spans and items) with the hits of any number of items."""
    windows = written(items.mapInArrow(_window_rows(size), "item string, words binary, length bigint, tokens array<bigint>"), "windows")
    different = written(windows.groupBy("words", "length").agg(F.min("tokens").alias("tokens")), "different_windows")
    tokens = written(different.select(F.explode("tokens").alias("token")).distinct(), "window_tokens")
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(Bits(tokens))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*text_bytes(batch.column("text")))
                text, ends, found = words.text_of(), words.firsts[1:], []
                for n in (SHINGLE, 1):
                    hashes = words.shingles(n)
                    at = known.value.places(hashes)
                    at = at[at + n <= ends[text[at]]]
                    order = np.lexsort((hashes[at], text[at]))
                    at = at[order]
                    new = np.append(True, (text[at][1:] != text[at][:-1]) | (hashes[at][1:] != hashes[at][:-1]))[: len(at)]
                    found.append(hashes[at[new]])
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    frequency = rows.select("text").mapInArrow(counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).join(tokens, "token", "left_semi")
    each = different.select("words", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    prefix = each.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("p")).select("p.token").distinct()
    rare = spark.sparkContext.broadcast(Bits(prefix))
    lengths = sorted(r.length for r in different.select("length").distinct().collect())  # at most `size` rows

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*text_bytes(batch.column("text")))
                text, ends = words.text_of(), words.firsts
                for n in lengths:
                    token = SHINGLE if n >= SHINGLE else 1
                    at = rare.value.places(words.shingles(token))
                    start = np.unique((at[:, None] - np.arange(n - token + 1)).ravel())
                    start = start[(start >= 0) & (start + n <= len(text))]
                    start = start[start + n <= ends[1:][text[start]]]
                    own = pa.array(text[start])
                    first = start - ends[:-1][text[start]]
                    yield pa.RecordBatch.from_arrays([batch.column("k1").take(own), batch.column("k2").take(own), pa.array([words.joined(k, n) for k in start.tolist()], pa.binary()), pa.array(first), pa.array(first + n)], ["k1", "k2", "words", "first", "end"])

    keyed = rows.select(*(c for c in rows.columns if c not in ("n_words", "spans", "items")), *(F.xxhash64(F.lit(k), F.coalesce("text", F.lit(""))).alias(f"k{k}") for k in (1, 2)))
    candidates = keyed.select("k1", "k2", "text").mapInArrow(around, "k1 bigint, k2 bigint, words binary, first bigint, end bigint")
    hits = written(candidates.distinct().join(different.select("words"), "words", "left_semi"), "window_hits")
    spans = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    held = hits.select("k1", "k2", "words").distinct().join(windows.select("words", "item").distinct(), "words").groupBy("k1", "k2").agg(F.collect_set("item").alias("items"))
    found = written(spans.join(held, ["k1", "k2"]), "contamination")
    discard(windows, different, tokens, hits)
    out = keyed.join(found, ["k1", "k2"], "left").drop("k1", "k2")
    names = rows.columns

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n = np.diff(Words(*text_bytes(batch.column("text"))).firsts)
                columns = {c: batch.column(c) for c in names if c != "n_words"}
                own = [[{"first": a, "end": b} for a, b in union([(s["first"], s["end"]) for s in x or ()])] for x in batch.column("spans").to_pylist()]
                columns |= {"n_words": pa.array(n, pa.int64()), "spans": pa.array(own, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "items": pa.array([sorted(x or ()) for x in batch.column("items").to_pylist()], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return out.select(*(c for c in names if c != "n_words")).mapInArrow(merged, rows.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, columns: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`columns` of each row, with n_words, spans (of hit words: first and end) and items (ids with occurring windows)."""
    names = {c: "text" if c == "text" else f"c{k}" for k, c in enumerate(columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items() if c != "text"), "text", F.lit(0).cast("bigint").alias("n_words"), F.expr("CAST(array() AS array<struct<first:bigint,end:bigint>>)").alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").filter("text IS NOT NULL")
    length, count = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.count("*")).first()
    if length + 16 * count > block_bytes:
        out = _by_join(rows, items, size)
    else:
        own = [(r.item, r.text) for r in items.collect()]  # as checked, at most block_bytes
        block = windows_of(own, size)
        out = _probe(rows, rare_first(block, _counts(docs, block["keys"])), [i for i, _ in own])
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "n_words", "spans", "items")


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The numbers of words, hit words and items of each document, and a digest of its items."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    found = contamination(docs, benchmark)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit."""
    moved, back = aside(docs, "text")
    return back(contamination(moved, benchmark, columns=tuple(moved.columns)).filter(F.size("spans") == 0))
