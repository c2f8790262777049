"""SimHash fingerprints, their links by a binary trie self-join, and the connected components of the links.

Exact copies share a fingerprint, so the join works on the different fingerprints alone. By the pigeonhole principle two
fingerprints with at most `budget` differing bits agree on all of b - budget of b blocks; for each choice of those, the
fingerprints with these blocks in front form a trie, whose nodes below the common prefix are dealt out as groups. Within a group node
pairs descend together, bit by bit; a pair's count of differing bits rises when it takes different sides, and a pair over the
budget goes. Nodes are ranges of the sorted fingerprints. Nodes of over `hot` fingerprints are dealt out again by blocks of the bits that are still
free, so no task gets an unbounded group. A group gives a forest of its links, not all pairs: fewer rows than it has fingerprints.

Null and empty texts and texts of white space have the fingerprint zero and link like any other; repeated rows and rows of one
doc_id each get their result; a component whose rows have no doc_id has a null component_id; equal texts tie in everything but their ids; very long texts are
hashed by pieces of PIECE bytes; a table without rows gives none; other columns play no part.

The stage of the pipeline (one_of_each) links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which 64 bits don't tell. It
runs the same trie join on fingerprints of 1,024 bits: a similarity of 0.8 is a cosine of 0.889, an angle of 0.152 of a half turn, so 155 differing bits in the mean, with a deviation of 11.5. The fingerprints are
dealt out by bands of minima of the shingles' hashes. Links of up to BUDGETS[0] bits count as they are (3 deviations: no pair under 0.8 is to be expected). Bands and bits can miss a pair, above all of short texts: 9 words and their first 8 differ in 192 bits in the mean, a fifth of such pairs in over 201.
So what is alike but not near is found by bounds that miss none: in any one order of all shingles, two sets alike to 0.8 have a shingle of their prefixes (a fifth of each and one more) in common; their sizes, the places of that shingle, and
sketches of parities, which differ in no more bits than the sets in shingles, leave few pairs. A forest of these gives the sets outside of which no text has a
link; in each such set of several components the trie join runs again, and every pair of two components is checked with the shingles themselves, in the order of the budgets up to all bits, until those that are alike are joined: a failed check hides no other pair.
Texts of the same words are one node, by a hash of 64 bits. Bands, prefixes and sets too large for one task meet as pairs of chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, discard, release, slices, text_bytes, written
from .decontaminate import Lookup, Words, mix

BITS = 64
#: Node pairs that a step of the traversal handles at once.
STEP = 1 << 18
#: Rows of whole groups that one traversal takes together.
TOGETHER = 1 << 17
#: Bytes of a text that are hashed together.
PIECE = 1 << 20
#: The stage's shingles and least similarity; its bands, and the minima of each. What shares no band is found by its prefix.
STAGE_WORDS, STAGE_LEAST = 5, 0.8
BANDS, ROWS = 25, 5
#: Words of the stage's fingerprints; the differing bits up to which links count without a check, and those by which pairs come to be checked, up to all bits.
WIDE, BUDGETS = 16, (120, 128, 136, 144, 150, 156, 162, 168, 176, 184, 201, BITS * 16)
#: The most frequent shingles, which come last in the order by which prefixes are taken, and shingles that are counted together for that.
FREQUENT, COUNTED = 1 << 16, 1 << 22
#: Texts that share a band, and bytes of the shingles of texts to be checked with each other, beyond which they meet as pairs of chunks.
HOT_BAND, HOT_SET = 8192, 8 << 20
#: Pairs that are checked before those that they join are left out, and shingles that are looked up at once.
CHECK, LOOKUP = 1 << 12, 1 << 20
_RANDOM = np.random.default_rng(7)
_SEEDS = _RANDOM.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_WIDE = _RANDOM.integers(0, 1 << 64, (2, 1, WIDE), np.uint64)
#: For each byte a word whose bytes are its bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_SOLID = np.ones(256, bool)
_SOLID[[*range(9, 14), 32]] = False
_WHITE = re.compile(rb"[ \t-\r]")


def _blocks(raw: bytes, words: int) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """A text in lower case by pieces of about PIECE bytes that end at white space: its words joined by spaces, and the starts and ends of its shingles there. A text of under `words` words is one shingle; without words there is none."""
    raw = raw.lower()  # on ASCII alone, as the split
    begin, carry, some = 0, [], False
    while begin < len(raw):
        end = len(raw)
        if begin + PIECE < end and (m := _WHITE.search(raw, begin + PIECE)):
            end = m.start()
        tokens = carry + raw[begin:end].split()
        begin = end
        if len(tokens) < words and (begin < len(raw) or some):
            carry = tokens
            continue
        if tokens:
            whole = b" ".join(tokens)
            ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
            starts = [0, *(e + 1 for e in ends[:-1])]
            yield whole, starts[: max(1, len(tokens) - words + 1)], ends[words - 1 :] or ends[-1:]
            some = True
        carry = tokens[len(tokens) - words + 1 :] if words > 1 else []
    if carry and not some:
        whole = b" ".join(carry)
        yield whole, [0], [len(whole)]


def hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, repeats included, by pieces of the text."""
    from xxhash import xxh64_intdigest

    for whole, starts, ends in _blocks((text or "").encode("utf-8", "surrogatepass"), words):
        yield np.array([xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends)], np.uint64)


def majority(parts: Iterator[np.ndarray], size: int) -> np.ndarray:
    """The words of a fingerprint: a bit is 1 if set in over half of the rows (hashes of `size` words)."""
    ones, n = np.zeros(BITS * size, np.int64), 0
    for rows in parts:
        for k in range(0, len(rows), 4096):
            ones += np.unpackbits(rows[k : k + 4096].view(np.uint8).reshape(-1, 8 * size), axis=1, bitorder="little").sum(0, dtype=np.int32)
        n += len(rows)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    return int(majority((h.reshape(-1, 1) for h in hashes(text, words, 42)), 1)[0])


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), words: int = 3) -> DataFrame:
    """`columns` and fp, the fingerprint as a bit pattern, of each row."""
    kinds = dict(docs.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fp = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(fp)], [*columns, "fp"])

    return docs.select(*columns, "text").mapInArrow(apply, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "fp bigint"]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Links rows a and b: label becomes that of the united sets, and pairs of a forest that unites them come out."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])] if len(order) else order
        label[high[first]] = low[first]  # each root goes below one smaller root, by one link
        yield np.stack([a[first], b[first]], 1)
        while (label[label] != label).any():
            label[:] = label[label]


def linked(keys: np.ndarray, spans: np.ndarray, depth: int, budget: int, label: np.ndarray | None = None, over: int = -1, alike: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label, links): the least number of a key in the linked set of each key, and the pairs (rows) of a forest that links them.

    keys: a row of 64-bit words each. spans: rows (a, a_end, b, b_end) of node pairs to start at, at `depth` bits; keys are sorted within each span. label: sets to go on from.
    over: only pairs of more differing bits. alike: tells which pairs are links indeed; each pair of two sets is asked for, until a link joins these.
    """
    label = np.arange(len(keys)) if label is None else label
    zeros: dict[int, np.ndarray] = {}
    own = [(depth, spans, np.zeros(len(spans), np.int16))]
    found = [np.zeros((0, 2), np.int64)]

    def join(a: np.ndarray, b: np.ndarray) -> None:
        found.extend(unite(label, a, b))

    while own:
        d, s, diff = own.pop()
        if len(s) > STEP:  # the rest waits: memory stays bounded
            own.append((d, s[STEP:], diff[STEP:]))
            s, diff = s[:STEP], diff[:STEP]
        single = (s[:, 1] - s[:, 0] == 1) & (s[:, 3] - s[:, 2] == 1)
        if d == BITS * keys.shape[1] or single.any():
            leaf = single if d < BITS * keys.shape[1] else np.ones(len(s), bool)
            a, b = s[leaf, 0], s[leaf, 2]
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            bits = np.bitwise_count(keys[a] ^ keys[b]).sum(1, dtype=np.int32)
            near = (bits <= budget) & (bits > over)
            a, b = a[near], b[near]
            if alike is None:
                join(a, b)
            else:
                for k in range(0, len(a), CHECK):
                    x, y = a[k : k + CHECK], b[k : k + CHECK]
                    apart = label[x] != label[y]
                    x, y = x[apart], y[apart]
                    good = alike(x, y)
                    join(x[good], y[good])
            s, diff = s[~leaf], diff[~leaf]
        if not len(s):
            continue
        if d not in zeros:
            if len(zeros) >= BITS:
                zeros.clear()
            zeros[d] = np.append(0, np.cumsum((keys[:, d // BITS] >> np.uint64(BITS - 1 - d % BITS)) & np.uint64(1) ^ np.uint64(1))).astype(np.int64)
        z = zeros[d]
        a, ae, b, be = s.T
        am, bm = a + z[ae] - z[a], b + z[be] - z[b]
        same = (a == b) & (ae == be)
        parts = [(a, am, b, bm, diff, None), (am, ae, bm, be, diff, None), (a, am, bm, be, diff + 1, None), (am, ae, b, bm, diff + 1, ~same)]
        out, outdiff = [], []
        for p, pe, q, qe, n, only in parts:
            keep = (pe > p) & (qe > q) & (n <= budget) & ~((p == q) & (pe == qe) & (pe - p == 1))
            keep = keep if only is None else keep & only
            out.append(np.stack([p[keep], pe[keep], q[keep], qe[keep]], 1))
            outdiff.append(n[keep])
        s, diff = np.concatenate(out), np.concatenate(outdiff)
        if len(s):
            own.append((d + 1, s, diff))
    return label, np.concatenate(found)


def _grouped(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], together: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of `by`, as batches of whole groups with at least `together` rows, but for the last."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= together:
            rows = pa.concat_batches(kept)
            group = np.stack([rows.column(c).to_numpy() for c in by], 1)
            end = len(group) - int(np.argmax((group[::-1] != group[-1]).any(1))) if (group != group[-1]).any() else 0
            if end:
                yield rows.slice(0, end)
            kept, size = [rows.slice(end)], len(group) - end
    if size:
        yield pa.concat_batches(kept)


def _group_starts(rows: pa.RecordBatch, by: tuple[str, ...]) -> np.ndarray:
    """Where the groups begin, with the end."""
    group = np.stack([rows.column(c).to_numpy() for c in by], 1)
    return np.append(np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1))), len(group))


def _front(key: Column, choice: tuple[int, ...], edges: list[int]) -> Column:
    """key with the chosen blocks of the bits from edges[0] on moved to the front of those."""
    order = [*choice, *(k for k in range(len(edges) - 1) if k not in choice)]
    out, used = F.shiftleft(F.shiftrightunsigned(key, BITS - edges[0]), BITS - edges[0]) if edges[0] else F.lit(0).cast("bigint"), edges[0]
    for k in order:
        width = edges[k + 1] - edges[k]
        block = F.shiftrightunsigned(key, BITS - edges[k + 1]).bitwiseAND(F.lit((1 << width) - 1))
        used += width
        out = out.bitwiseOR(F.shiftleft(block, BITS - used))
    return out


def dealt(rows: DataFrame, depth: int, blocks: int, budget: int) -> tuple[DataFrame, int]:
    """rows (fp, key, path) whose keys of one path agree on `depth` bits, each once for every choice of blocks - budget of the blocks of the other bits, with those in front; and how many bits the keys of one path agree on then.

    A pair within the budget differs in at most that many blocks, so some choice gives both the same path.
    """
    edges = [depth + round(k * (BITS - depth) / blocks) for k in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - budget))
    agreed = depth + min(sum(edges[k + 1] - edges[k] for k in c) for c in choices)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _front(F.col("key"), c, edges).alias("key")) for i, c in enumerate(choices))))
    out = rows.select("fp", "path", each.alias("x")).select("fp", F.col("x.key").alias("key"), F.xxhash64("path", "x.i", F.shiftrightunsigned("x.key", BITS - agreed)).alias("path"))
    return out, agreed


def links(classes: DataFrame, count: int, budget: int = 3, hot: int = 4096) -> DataFrame:
    """(a, b): pairs that connect what links within the budget connect, in each node all with the first of a linked set; classes has each fp once, count of them.

    A node of over `hot` fingerprints is dealt out anew by more bits, until few are left; a node whose free bits can't hold more than that is never too large.
    """
    rows, depth = classes.select("fp", F.col("fp").alias("key"), F.lit(0).cast("bigint").alias("path")), 0
    blocks, ready, used = budget + 1 + (count > 1 << 24) + (count > 1 << 34), [], []
    while True:
        rows, depth = dealt(rows, depth, blocks, budget)
        blocks = budget + 2
        sizes = rows.groupBy("path").count().filter("count > 1")
        if 1 << (BITS - depth) > max(hot, 1 << 8) and not (large := sizes.filter(F.col("count") > hot)).isEmpty():
            rows, large = written(rows, "nodes"), written(large.select("path"), "large_nodes")
            used += [rows, large]
            ready.append(rows.join(sizes.filter(F.col("count") <= hot).select("path"), "path", "left_semi"))
            rows = rows.join(large, "path", "left_semi")
        else:
            ready.append(rows.join(sizes.select("path"), "path", "left_semi"))
            break

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _grouped(batches, ("path",), TOGETHER):
            starts = _group_starts(rows, ("path",))
            spans = np.stack([starts[:-1], starts[1:], starts[:-1], starts[1:]], 1)
            fp = rows.column("fp").to_numpy()
            label, _ = linked(rows.column("key").to_numpy().view(np.uint64).reshape(-1, 1), spans, 0, budget)
            own = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[own]), pa.array(fp[label[own]])], ["a", "b"])

    nodes = reduce(DataFrame.unionByName, (r.select("path", "key", "fp") for r in ready))
    out = nodes.repartition("path").sortWithinPartitions("path", F.col("key").bitwiseXOR(F.lit(-(1 << 63)))).mapInArrow(apply, "a bigint, b bigint")
    if used:
        out = written(out, "node_links")
        discard(*used)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for each node of pairs (a, b): root is the least node of its component. Stars are made larger and smaller in turn until nothing changes."""
    edges = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while total[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        edges, before = written(small, "links"), edges
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == total:
            break
        total = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_components(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), words: int = 3, budget: int = 3) -> DataFrame:
    """`columns`, fp and component_id (the least doc_id of its component) of each row of docs."""
    names = tuple(dict.fromkeys((*columns, "doc_id")))
    marked = written(fingerprints(docs, names, words), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint_classes")
    roots = components(links(classes, classes.count(), budget))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = named.join(ids, "root").select(F.col("fp").alias("own_fp"), "component_id")
    return marked.join(owner, F.col("fp") == F.col("own_fp"), "left").select(*columns, "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id of each row."""
    return near_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(at: np.ndarray, data: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different shingles of texts at offsets `at`, one text after another; where each text's begin, with the end). A text without words has the hash 0 alone."""
    own = Words(at, data, _SOLID)
    count, text = np.diff(own.firsts), own.text_of()
    full = own.shingles(words)
    inside = np.flatnonzero(np.arange(len(full)) + words <= own.firsts[1:][text[: len(full)]])
    owners, found = [text[inside]], [full[inside]]
    for n in range(words):
        few = np.flatnonzero(count == n)
        if len(few):
            owners.append(few)
            found.append(own.shingles(n)[own.firsts[few]] if n else np.zeros(len(few), np.uint64))
    owner, found = np.concatenate(owners), np.concatenate(found)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]))[: len(found)]
    return found[new], np.searchsorted(owner[new], np.arange(len(at)))


def sets_of(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_sets of a slice of texts; a text beyond PIECE, alone in its slice, is hashed by pieces."""
    at, data = text_bytes(column)
    if len(column) != 1 or len(data) <= PIECE:
        return shingle_sets(at, data, words)
    parts = [shingle_sets(np.array([0, len(whole)]), np.frombuffer(whole, np.uint8), words)[0] for whole, _, _ in _blocks(data.tobytes(), words)]
    own = np.unique(np.concatenate(parts)) if parts else np.zeros(1, np.uint64)
    return own, np.array([0, len(own)])


def bands(own: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each set a hash of each band of minima of the hashes."""
    out = np.full((len(begin) - 1, BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BANDS * ROWS):
        least = np.minimum.reduceat((own ^ _SEEDS[0, j]) * (_SEEDS[1, j] | np.uint64(1)), begin[:-1])
        out[:, j // ROWS] = mix(out[:, j // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out


def wide_fingerprints(own: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The SimHash of WIDE words of each set. Bits are counted in the bytes of 64-bit words, of up to 255 rows at once."""
    sizes = np.diff(begin)
    blocks = -(-sizes // 255)
    first = np.repeat(begin[:-1], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    ends = np.append(first[1:], begin[-1])
    counts = np.zeros((len(first), BITS * WIDE), np.uint8)
    for k in range(0, len(first), 32):
        a, b = int(first[k]), int(ends[min(k + 31, len(first) - 1)])
        x = (own[a:b, None] ^ _WIDE[0]) * (_WIDE[1] | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        lanes = _LANES[(x ^ (x >> np.uint64(29))).view(np.uint8)]
        counts[k : k + 32] = np.add.reduceat(lanes, first[k : k + 32] - a, axis=0).view(np.uint8)
    ones = np.add.reduceat(counts, np.cumsum(blocks) - blocks, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64)


def frequent_shingles(docs: DataFrame, words: int, most: int = FREQUENT) -> np.ndarray:
    """Shingles that very many texts have, the more frequent ones later. It is no more than an order: what it says of a shingle, and whether it has it, changes no result."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            shingle, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(shingle[n > 2].view(np.int64)), pa.array(n[n > 2])], ["shingle", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                held.append(sets_of(batch.column("text"), words)[0])
                size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    counts = docs.select("text").mapInArrow(apply, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return np.array([r.shingle for r in counts.orderBy(F.desc("n"), "shingle").limit(most).collect()][::-1], np.int64).view(np.uint64)


def prefixes(own: np.ndarray, begin: np.ndarray, frequent: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, how many of each set, how many of these aren't frequent): the first shingles of each set in an order of all shingles, frequent ones last, so many that two sets alike to `least` have one of them in common."""
    sizes = np.diff(begin)
    rank, by = np.zeros(len(own), np.int64), np.argsort(frequent)
    at, found = Lookup(frequent[by]).find(own)
    rank[at] = by[found] + 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(owner << 32 | rank, kind="stable")  # own is in order within each set
    count = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    keep = np.arange(len(own)) - np.repeat(begin[:-1], sizes) < np.repeat(count, sizes)
    kept = order[keep]
    return own[kept], count, np.bincount(owner[kept][rank[kept] == 0], minlength=len(sizes))


def sketch_of(own: np.ndarray) -> bytes:
    """Of each of about as many buckets as there are hashes (64 at least, a power of two), whether an odd number of them fall there. Halves of a sketch, one upon the other, are the sketch of half as many buckets. Two sketches differ in no more bits than the sets in hashes."""
    buckets = max(64, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(20)).astype(np.int64) & (buckets - 1), minlength=buckets) & 1, bitorder="little").tobytes()


def node_of(text: str | None) -> int:
    """A hash of the text's words, in lower case and without what parts them."""
    from xxhash import xxh64

    h, first, raw = xxh64(), True, (text or "").encode("utf-8", "surrogatepass")
    if len(raw) <= PIECE:
        return xxh64(b" ".join(raw.lower().split())).intdigest()
    for whole, _, _ in _blocks(raw, 1):
        h.update(whole if first else b" " + whole)
        first = False
    return h.intdigest()


def _marks(docs: DataFrame, words: int, least: float = STAGE_LEAST) -> DataFrame:
    """doc_id, node, wide fingerprint (big-endian words), bands and number of different shingles of each row, the prefix of its shingles, how many of that aren't frequent, and their sketch."""
    frequent = frequent_shingles(docs, words)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in slices(whole, "text"):
                node = np.array([node_of(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
                own, begin = sets_of(batch.column("text"), words)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(bands(own, begin).view(np.int64).ravel()))
                wide = pa.array([x.tobytes() for x in wide_fingerprints(own, begin).astype(">u8")], pa.binary())
                first, count, rare = prefixes(own, begin, frequent, least)
                prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(first.view(np.int64)))
                sketch = pa.array([sketch_of(own[a:b]) for a, b in zip(begin[:-1], begin[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node), wide, listed, pa.array(np.diff(begin)), prefix, pa.array(rare), sketch], ["doc_id", "node", "wide", "bands", "shingles", "prefix", "rare", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {dict(docs.dtypes)['doc_id']}, node bigint, wide binary, bands array<bigint>, shingles bigint, prefix array<bigint>, rare bigint, sketch binary")


def _with_node(docs: DataFrame, least: bool = False) -> DataFrame:
    """docs with each row's node. least: of a batch's rows of one node, only that with the least doc_id (nulls last), then text."""
    kinds = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField("node", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            node = [node_of(t) for t in texts]
            if least:
                ids, first = batch.column("doc_id").to_pylist(), {}
                for k in sorted(range(len(node)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0, texts[k] or "")):
                    first.setdefault(node[k], k)
                rows = sorted(first.values())
                batch, node = batch.take(pa.array(rows, pa.int64())), [node[k] for k in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(node, np.uint64).view(np.int64))], [*batch.schema.names, "node"])

    return docs.mapInArrow(apply, kinds)


class Sets:
    """The shingles of texts as numbers, to compare texts by."""

    def __init__(self, found: np.ndarray, begin: np.ndarray, least: float):
        different, self.ids = np.unique(found, return_inverse=True)
        self.begin, self.size, self.least = begin[:-1], np.diff(begin), least
        self.held = np.zeros(len(different), bool)

    def alike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the texts a and b have a Jaccard similarity of `least`."""
        x, y = self.size[a], self.size[b]
        out = np.minimum(x, y) >= self.least * np.maximum(x, y)  # no other pair can be
        own = np.flatnonzero(out)
        own = own[np.argsort(a[own], kind="stable")]
        for run in np.split(own, np.flatnonzero(np.diff(a[own])) + 1) if len(own) else ():
            first = a[run[0]]
            mine = self.ids[self.begin[first] : self.begin[first] + self.size[first]]
            self.held[mine] = True
            some = max(1, LOOKUP // int(self.size[b[run]].max()))
            for k in range(0, len(run), some):
                part = run[k : k + some]
                size = self.size[b[part]]
                starts = np.cumsum(size) - size
                both = np.add.reduceat(self.held[self.ids[np.arange(size.sum()) + np.repeat(self.begin[b[part]] - starts, size)]], starts, dtype=np.int64)
                out[part] = both / (self.size[first] + size - both) >= self.least
            self.held[mine] = False
        return out


def _spans(rows: pa.RecordBatch, by: tuple[str, ...]) -> np.ndarray:
    """Node pairs to start at: of each group `by`, whose last columns are two chunks, the group with itself or, where the chunks differ, its sides."""
    starts = _group_starts(rows, by)
    half = starts[:-1] + np.add.reduceat(rows.column("side").to_numpy() == 0, starts[:-1])
    one = (rows.column("c0").to_numpy() == rows.column("c1").to_numpy())[starts[:-1]]
    spans = np.stack([starts[:-1], np.where(one, starts[1:], half), np.where(one, starts[:-1], half), starts[1:]], 1)
    return spans[(spans[:, 1] > spans[:, 0]) & (spans[:, 3] > spans[:, 2])]


def _wide_keys(rows: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("wide").to_pylist()), ">u8").astype(np.uint64).reshape(-1, WIDE)


def _met(rows: DataFrame) -> DataFrame:
    """rows with a chunk c and the chunks d to meet, as pairs of chunks c0 and c1 and the side there."""
    return rows.withColumn("c0", F.least("c", "d")).withColumn("c1", F.greatest("c", "d")).withColumn("side", (F.col("c") > F.col("d")).cast("int")).drop("c", "d")


def candidates(marked: DataFrame, hot: int = HOT_BAND) -> DataFrame:
    """(a, b): near links between nodes that share a band: of each group, all with the first of a set linked by such."""
    nodes = written(marked.groupBy("node").agg(F.min("wide").alias("wide"), F.min("bands").alias("bands")), "nodes")
    banded = written(nodes.select("node", F.explode("bands").alias("band")), "bands")
    sizes = written(banded.groupBy("band").count().filter("count > 1"), "band_sizes")
    # fingerprints go along only with bands that are shared; what shares a band with too many others meets them in pairs of chunks
    rows = banded.join(sizes, "band").join(nodes.select("node", "wide"), "node").withColumn("chunks", F.ceil(F.col("count") / hot).cast("int"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = ("band", "c0", "c1")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _grouped(batches, by, TOGETHER // WIDE):
            spans, keys, node = _spans(rows, by), _wide_keys(rows), rows.column("node").to_numpy()
            label, _ = linked(keys, spans, 0, BUDGETS[0])
            own = np.flatnonzero(label != np.arange(len(label)))  # each goes to the first of its set
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[label[own]])], ["a", "b"])

    found = _met(rows).select(*by, "side", "node", "wide").repartition(*by).sortWithinPartitions(*by, "side", "wide").mapInArrow(apply, "a bigint, b bigint")
    out = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    discard(nodes, banded, sizes)
    return out


def _pairs_of(rows: pa.RecordBatch, by: tuple[str, ...], least: float, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows) of different labels in one group `by` that their sizes, and the places where they have the group's shingle, allow to be alike to `least`; label may go on meanwhile."""
    starts = _group_starts(rows, by)
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    mixed = np.minimum.reduceat(label, starts[:-1]) != np.maximum.reduceat(label, starts[:-1])
    size, side, place, c0, c1 = (rows.column(c).to_numpy().astype(np.int64) for c in ("shingles", "side", "place", "c0", "c1"))
    own = np.flatnonzero(mixed[group])
    own = own[np.argsort((2 * group + side)[own] << 32 | size[own], kind="stable")]
    group, size, side, place, one = group[own], size[own], side[own], place[own], (c0 == c1)[own]
    key, other = (2 * group + side) << 32 | size, (2 * group + ~one) << 32
    first = np.where(one, np.arange(len(own)) + 1, np.searchsorted(key, other | np.ceil(least * size - 1e-9).astype(np.int64)))
    n = np.maximum(0, np.searchsorted(key, other | np.floor(size / least + 1e-9).astype(np.int64), "right") - first) * (one | (side == 0))
    total, begin = np.append(0, np.cumsum(n)), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + STEP, "right")) - 1)
        a = np.repeat(np.arange(begin, end), n[begin:end])
        b = np.arange(len(a)) - np.repeat(total[begin:end] - total[begin] - first[begin:end], n[begin:end])
        # what comes before the first shingle that both have is in one of them alone
        fit = np.minimum(size[a] - place[a], size[b] - place[b]) >= np.ceil(least / (1 + least) * (size[a] + size[b]) - 1e-6)
        a, b = own[a[fit]], own[b[fit]]
        apart = label[a] != label[b]
        yield a[apart], b[apart]
        begin = end


class Sketches:
    """The sketches (sketch_of) of sets, to tell which may be alike to `least`."""

    def __init__(self, column: pa.Array, sizes: np.ndarray, least: float):
        at, self.data = text_bytes(column)
        self.begin, self.words, self.sizes, self.least = at[:-1] // 8, np.diff(at) // 8, sizes.astype(np.int64), least
        self.data = np.frombuffer(self.data.tobytes(), np.uint64)

    def _folded(self, rows: np.ndarray, words: int) -> np.ndarray:
        """The sketches of rows as if of `words` words."""
        out = np.zeros((len(rows), words), np.uint64)
        for n in np.unique(self.words[rows]):
            same = np.flatnonzero(self.words[rows] == n)
            out[same] = np.bitwise_xor.reduce(self.data[self.begin[rows[same], None] + np.arange(n)].reshape(len(same), n // words, words), axis=1)
        return out

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets a and b differ in so few bits that they can be alike: (1 - least) / (1 + least) of their sizes."""
        most = np.floor((1 - self.least) / (1 + self.least) * (self.sizes[a] + self.sizes[b]) + 1e-6)
        words, out = np.minimum(self.words[a], self.words[b]), np.zeros(len(a), bool)
        for n in np.unique(words):
            own = np.flatnonzero(words == n)
            for k in range(0, len(own), some := max(1, LOOKUP // int(n))):
                x = own[k : k + some]
                out[x] = np.bitwise_count(self._folded(a[x], n) ^ self._folded(b[x], n)).sum(1, dtype=np.int64) <= most[x]
        return out


def rest_of(nodes: DataFrame, least: float, hot: int = HOT_BAND) -> DataFrame:
    """(a, b): pairs of roots that connect what may be alike to `least`, none left out; nodes has (node, root, shingles, prefix, rare, sketch). Nodes that are alike have a shingle of their prefixes in common."""
    every = nodes.select("node", "root", "shingles", "rare", F.posexplode("prefix").alias("place", "shingle"))
    # only shingles known as frequent are in very many prefixes: what shares one with too many others meets them in pairs of chunks
    large = every.filter("place >= rare").groupBy("shingle").count().filter(F.col("count") > hot).select("shingle", F.ceil(F.col("count") / hot).cast("int").alias("chunks"))
    rows = every.join(F.broadcast(large), "shingle", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    by = ("shingle", "c0", "c1")
    columns = (*by, "side", "node", "root", "shingles", "place")
    kinds = "shingle bigint, c0 int, c1 int, side int, node bigint, root bigint, shingles bigint, place int"

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that a pair needs."""
        release()
        for rows in _grouped(batches, by, TOGETHER):
            needed = np.zeros(rows.num_rows, bool)
            for a, b in _pairs_of(rows, by, least, rows.column("root").to_numpy()):
                needed[a] = needed[b] = True
            yield rows.filter(pa.array(needed))

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _grouped((x for batch in batches for x in slices(batch, "sketch")), by, TOGETHER // WIDE):
            root = rows.column("root").to_numpy()
            sketches = Sketches(rows.column("sketch"), rows.column("shingles").to_numpy(), least)
            _, first, inverse = np.unique(root, return_index=True, return_inverse=True)
            label = first[inverse]
            for a, b in _pairs_of(rows, by, least, label):
                for k in range(0, len(a), CHECK):
                    x, y = a[k : k + CHECK], b[k : k + CHECK]
                    apart = label[x] != label[y]
                    x, y = x[apart], y[apart]
                    good = sketches.possible(x, y)
                    for links in unite(label, x[good], y[good]):
                        yield pa.RecordBatch.from_arrays([pa.array(root[links[:, 0]]), pa.array(root[links[:, 1]])], ["a", "b"])

    met = _met(rows).select(*columns).repartition(*by).sortWithinPartitions(*by).mapInArrow(some, kinds)
    needed = written(met, "rest_rows")
    out = needed.join(nodes.select("node", "sketch"), "node").repartition(*by).sortWithinPartitions(*by).mapInArrow(forest, "a bigint, b bigint")
    out = written(out, "rest_links")
    discard(needed)
    return out


def placed(members: DataFrame, hot: int = HOT_SET) -> DataFrame:
    """(node, root, top, c0, c1, side): where the nodes of one top meet those of its other roots; members has (node, root, top, shingles). The nodes of a root of over `hot` bytes have chunks of their own, which don't meet each other."""
    roots = members.groupBy("top", "root").agg((F.sum("shingles") * 8).alias("bytes"))
    large = roots.filter(F.col("bytes") > hot).withColumn("own", F.ceil(F.col("bytes") / hot).cast("int"))
    large = large.withColumn("end", F.sum("own").over(Window.partitionBy("top").orderBy("root")).cast("int")).select("top", "root", "own", "end")
    small = roots.groupBy("top").agg(F.ceil(F.coalesce(F.sum(F.when(F.col("bytes") <= hot, F.col("bytes"))), F.lit(0)) / hot).cast("int").alias("small"))
    counts = small.join(large.groupBy("top").agg(F.max("end").alias("large")), "top", "left").select("top", "small", (F.col("small") + F.coalesce("large", F.lit(0))).alias("chunks"))
    rows = members.join(counts, "top").join(large, ["top", "root"], "left")
    first = F.when(F.col("own").isNull(), F.lit(0)).otherwise(F.col("small") + F.col("end") - F.col("own"))
    rows = rows.withColumn("first", first).withColumn("c", F.col("first") + F.pmod(F.xxhash64("node"), F.coalesce("own", "small")).cast("int"))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("own IS NULL OR d < first OR d >= first + own")
    return _met(rows).select("node", "root", "top", "c0", "c1", "side")


def _joined(members: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """(a, b): pairs of roots that texts of theirs join, among the roots of each top; members has (node, root, top, shingles)."""
    places = placed(members).groupBy("node").agg(F.first("root").alias("root"), F.collect_list(F.struct("top", "c0", "c1", "side")).alias("places"))
    places = written(places, "places")
    texts = _with_node(docs.select("text")).join(places.select("node"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))
    by = ("top", "c0", "c1")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in slices(whole, "text"):
                own, begin = sets_of(batch.column("text"), words)
                wide = pa.array([x.tobytes() for x in wide_fingerprints(own, begin).astype(">u8")], pa.binary())
                held = pa.array([own[x:y].tobytes() for x, y in zip(begin[:-1], begin[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("places"), wide, held], ["root", "places", "wide", "held"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _grouped((x for batch in batches for x in slices(batch, "held", HOT_SET)), by, 1):
            at, data = text_bytes(rows.column("held"))
            own = Sets(np.frombuffer(data.tobytes(), np.uint64), at // 8, least)
            spans, keys, root = _spans(rows, by), _wide_keys(rows), rows.column("root").to_numpy()
            _, first, inverse = np.unique(root, return_index=True, return_inverse=True)
            label, over = first[inverse], -1
            for budget in BUDGETS:
                label, found = linked(keys, spans, 0, budget, label, over, own.alike)
                over = budget
                yield pa.RecordBatch.from_arrays([pa.array(root[found[:, 0]]), pa.array(root[found[:, 1]])], ["a", "b"])

    kinds = dict(places.dtypes)
    rows = texts.join(places, "node").select("text", "root", "places").mapInArrow(sets, f"root bigint, places {kinds['places']}, wide binary, held binary")
    rows = rows.select("root", F.explode("places").alias("p"), "wide", "held").select("p.*", "root", "wide", "held")
    out = written(rows.repartition(*by).sortWithinPartitions(*by, "side", "wide").mapInArrow(apply, "a bigint, b bigint"), "joined")
    discard(places)
    return out


def _roots(docs: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, node and root of each row: the least node of the node's component."""
    marked = written(_marks(docs, words, least), "marks")
    found = candidates(marked)
    roots = components(found)
    nodes = marked.groupBy("node").agg(*(F.first(c).alias(c) for c in ("shingles", "prefix", "rare", "sketch"))).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = written(nodes, "rest_nodes")
    rest = rest_of(nodes, least)
    reach = components(rest).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # components leaves no root without a link, and each top is its own
    reach = written(reach.unionByName(reach.select(F.col("top").alias("root"), "top")).distinct(), "reach")
    own = marked.select("doc_id", "node", "shingles").join(roots, "node", "left").select("doc_id", "node", "shingles", F.coalesce("root", "node").alias("root"))
    members = written(own.join(reach, "root").groupBy("node").agg(F.first("root").alias("root"), F.first("top").alias("top"), F.max("shingles").alias("shingles")), "members")
    joined = _joined(members, docs, words, least)
    tops = components(joined).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    out = written(own.join(tops, "root", "left").select("doc_id", "node", F.coalesce("whole", "root").alias("root")), "roots")
    discard(marked, found, nodes, rest, reach, members, joined)
    return out


def alike_components(docs: DataFrame, words: int = STAGE_WORDS, least: float = STAGE_LEAST) -> DataFrame:
    """(doc_id, component_id) of each row: components of texts whose shingles are alike to `least`."""
    own = _roots(docs, words, least)
    return own.join(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = STAGE_WORDS, least: float = STAGE_LEAST) -> DataFrame:
    """The rows of docs, but of each component one: that with the least doc_id (rows without one last), then text."""
    moved, back = aside(docs, "doc_id", "text")
    own = _roots(docs, words, least)
    kept = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("r")).select("r.node")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.col("doc_id").asc_nulls_last(), "text"))
    rows = _with_node(moved, least=True).join(kept, "node", "left_semi")
    return back(rows.withColumn("rank", rank).filter("rank = 1"))
