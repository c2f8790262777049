"""Removal of every byte that lies in a string of `length` bytes which also starts elsewhere.

Windows (strings of `length` bytes within one text) are dealt out by content: a window belongs to the leftmost least hash of its
`gram`-byte strings, its anchor. Equal windows have the same anchor at the same place, so it is enough to
compare windows of one anchor. Neighbouring windows with one anchor are a run, and the bytes of a run a context.

Contexts that occur twice repeat as a whole. An anchor with one occurrence repeats nowhere. What is left, anchors
with several contexts, goes to the Burrows-Wheeler transform of a batch of whole anchors: intervals of equal prefixes are
extended backwards, breadth first, and each boundary of the suffix order gets its common prefix the first time an interval ends
at it, so values come in increasing order. The expansion stops at `length`: the boundaries still without a value part suffixes that share as much, and
only these are repeats. Contexts of an anchor that are too many for a batch are cut into parts by where the anchor stands in a window: the windows of a part all hold the bytes around the
anchor that make its key, and parts of one key are contexts of that key, to be counted, transformed or cut finer. Parts of single windows end this, as counts settle them.

Texts are UTF-8 bytes; null counts as empty. A text shorter than `length` loses nothing; repeated rows are copies of each other and lose all that such a
window covers, as no copy counts as the first; overlapping copies within one text count too; rows without a doc_id take part as any other; a long text is looked at by pieces of PIECE bytes; a table without rows
gives none; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, release, slices, text_bytes, written

GRAM = 32
#: Bytes of a batch for the transform; ranks and places of up to 2 ** 21 fit 21 bits each.
BATCH = 1 << 20
#: Bytes of an anchor's contexts beyond which they are cut finer, and the widths of the cuts.
HOT = 1 << 20
WIDTHS = (48, 6, 1)
#: Bytes of a repeated string in the pipeline's stage.
STAGE_LENGTH = 256
#: Bytes of a text that are looked at together, and contexts that are cut out together.
PIECE, CUT = 1 << 20, 1 << 13
_UNSET = np.uint16(0xFFFF)
_NO_ID = -(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def runs_of(at: np.ndarray, data: np.ndarray, length: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The runs of texts at offsets `at`: the text's number, the first window's start in the text, the number of windows, the anchor's place from the first start, and its hash."""
    n, width = len(data), length - gram + 1
    if n < length:
        return {c: np.zeros(0, t) for c, t in (("text", np.int64), ("first", np.int64), ("n", np.int64), ("place", np.int64), ("anchor", np.uint64))}
    h, power, size = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
        h = _mix(h)
    m = len(h)
    # least of each window: the least of a block's end and of the next block's start
    key = np.full(-(-m // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:m] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    ahead = np.minimum.accumulate(key.reshape(-1, width), axis=1).ravel()
    behind = np.minimum.accumulate(key.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    best = (np.minimum(behind[: n - length + 1], ahead[width - 1 : width + n - length]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(at)
    own = np.flatnonzero(sizes >= length)
    starts = at[:-1][own]
    count = sizes[own] - length + 1
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    text = np.repeat(own, count)
    anchor = best[place]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) if len(anchor) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return {"text": text[first], "first": place[first] - at[text[first]], "n": np.diff(np.append(first, len(anchor))), "place": anchor[first] - place[first], "anchor": h[anchor[first]]}


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in order of at least their first `depth` symbols (below 512), by doubling."""
    n = len(symbols)
    shift = np.uint64(21)
    place = np.arange(n, dtype=np.uint64)
    wide = np.append(symbols, np.zeros(4, symbols.dtype)).astype(np.uint64)
    key = ((wide[:n] << np.uint64(27)) | (wide[1 : n + 1] << np.uint64(18)) | (wide[2 : n + 2] << np.uint64(9)) | wide[3 : n + 3]) << shift | place
    size = 4
    while True:
        key.sort()
        order = (key & np.uint64((1 << 21) - 1)).astype(np.int64)
        head = key >> shift
        rank = np.empty(n, np.uint64)
        step = np.append(0, np.cumsum(head[1:] != head[:-1])).astype(np.uint64)
        if size >= depth or int(step[-1]) == n - 1:
            return order
        rank[order] = step
        ahead = np.zeros(n, np.uint64)
        ahead[: n - size] = rank[size:] + np.uint64(1) if size < n else 0
        key = ((rank << shift) | ahead) << shift | place
        size *= 2


def repeated(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each place whether the `length` symbols from there also begin elsewhere; symbol 0 ends a context and matches nothing."""
    n = len(symbols)
    order = suffix_order(symbols, length)
    before = symbols[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)  # where a suffix stands when it is extended by the symbol before it
    value = np.full(n + 1, _UNSET, np.uint16)
    value[0] = value[n] = 0
    a, b = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for step in range(length):
        size = b - a
        one = size == 1
        single = a[one]
        if step:
            single = single[before[single] != 0]
        na, nb = [back[single]], [back[single] + 1]
        if not one.all():
            a, size = a[~one], size[~one]
            owner = np.repeat(np.arange(len(a)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size - a, size)
            symbol = before[place]
            if step:
                keep = symbol != 0
                owner, place, symbol = owner[keep], place[keep], symbol[keep]
            if len(place):
                packed = (back[place] << 21) | np.arange(len(place))
                packed.sort()
                to, by = packed >> 21, packed & ((1 << 21) - 1)
                owner, symbol = owner[by], symbol[by]
                cut = np.flatnonzero((to[1:] != to[:-1] + 1) | (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])) + 1
                na.append(to[np.append(0, cut)])
                nb.append(to[np.append(cut - 1, len(to) - 1)] + 1)
        a, b = np.concatenate(na), np.concatenate(nb)
        new = value[b] == _UNSET
        a, b = a[new], b[new]
        value[b] = step
        if not len(a):
            break
    out = np.zeros(n, bool)
    out[order] = (value[:-1] == _UNSET) | (value[1:] == _UNSET)
    return out


def _ranges(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2])]


def _by_transform(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts in order of anchor and context -> the ranges of their windows that repeat within the anchor."""
    release()

    def run(rows: list[tuple]) -> pa.RecordBatch:
        joined = np.frombuffer(b"\0".join([r[3] for r in rows]) + b"\0", np.uint8)
        sizes = np.array([len(r[3]) + 1 for r in rows])
        ends = np.cumsum(sizes)
        symbols = joined.astype(np.uint16) + np.uint16(1)
        symbols[ends - 1] = 0
        hit = repeated(symbols, length)
        found = [_ranges(hit[e - s : e - s + r[2]]) for r, s, e in zip(rows, sizes.tolist(), ends.tolist())]
        some = [k for k, x in enumerate(found) if x]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in some], pa.int64()), pa.array([rows[k][1] for k in some], pa.int64()), pa.array([found[k] for k in some], pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())])))], ["anchor", "context", "ranges"])

    own: list[tuple] = []
    size = begin = 0  # of own's bytes; where the last anchor begins in own
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "n", "bytes"))):
            if own and own[-1][:2] == r[:2]:
                continue  # a repeated row
            if own and own[-1][0] != r[0]:
                begin = len(own)
            if size + len(r[3]) + 1 > BATCH and begin:
                yield run(own[:begin])
                own, begin = own[begin:], 0
                size = sum(len(x[3]) + 1 for x in own)
            own.append(r)
            size += len(r[3]) + 1
    if own:
        yield run(own)


def _finer(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Contexts cut by where the anchor stands in their windows: each part has windows whose anchor's place is in one range of `width`, so that all hold the same bytes around the anchor, which make the part's key."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for whole in batches:
        for batch in slices(whole, "bytes", 1 << 19):
            out: dict[str, list] = {c: [] for c in FINER}
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "context", "n", "place", "bytes"))):
                anchor, context, n, place, raw = r
                for part in range((place - n + 1) // width, place // width + 1):
                    first, last = max(0, place - (part + 1) * width + 1), min(n - 1, place - part * width)
                    core = raw[place - part * width : place - (part + 1) * width + 1 + length]
                    own = raw[first : last + length]
                    key = xxh3_64_intdigest(core, (anchor + part) % (1 << 64))
                    for c, v in zip(FINER, (anchor, context, signed(key), signed(xxh64_intdigest(own)), first, last - first + 1, place - first, own)):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in FINER[:-1]), pa.array(out["bytes"], pa.binary())], list(FINER))


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of slices in order of slice, with their places and the ranges that repeat -> for each text of a slice, the ranges of its windows that repeat, those that touch as one."""
    release()

    def turned(rows: pa.Table) -> pa.RecordBatch:
        places, ranges = (rows.column(c).combine_chunks() for c in ("places", "ranges"))
        sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (places, ranges)]
        k1, k2, at = (places.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k1", "k2", "first"))
        first, n = (ranges.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
        # each place with each range of its context
        owner = np.repeat(np.arange(rows.num_rows), sizes[0])
        count = sizes[1][owner]
        place = np.repeat(np.arange(len(owner)), count)
        own = np.arange(len(place)) - np.repeat(np.cumsum(count) - count - (np.cumsum(sizes[1]) - sizes[1])[owner], count)
        order = np.lexsort((k2, k1))
        new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))[: len(order)]
        text = np.empty(len(order), np.int64)
        text[order] = np.cumsum(new) - 1
        texts = order[new]
        begin = (text[place] << 32) + at[place] + first[own]
        order = np.argsort(begin)
        begin, end = begin[order], np.maximum.accumulate((begin + n[own])[order])
        some = np.flatnonzero(np.append(True, begin[1:] > end[:-1])[: len(begin)])
        begin, end = begin[some], end[np.append(some[1:], len(end))[: len(some)] - 1]
        spans = pa.StructArray.from_arrays([pa.array(begin & ((1 << 32) - 1)), pa.array(end - begin)], ["first", "n"])
        return pa.RecordBatch.from_arrays([pa.array(k1[texts]), pa.array(k2[texts]), pa.ListArray.from_arrays(pa.array(np.searchsorted(begin >> 32, np.arange(len(texts) + 1)).astype(np.int32)), spans)], ["k1", "k2", "spans"])

    own: list[pa.RecordBatch] = []
    for batch in batches:
        of = batch.column("slice").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
            if own and own[-1].column("slice")[0].as_py() != of[a]:
                yield turned(pa.Table.from_batches(own))
                own = []
            own += [batch.slice(a, b - a)] * (b > a)
    if own:
        yield turned(pa.Table.from_batches(own))


FINER = ("anchor", "context", "key", "part", "first", "n", "place", "bytes")
RANGES = "array<struct<first:bigint,n:bigint>>"


def _all() -> Column:
    """All windows of a context of n."""
    return F.expr(f"CAST(array(named_struct('first', 0L, 'n', n)) AS {RANGES})").alias("ranges")


def _united(parts: list[DataFrame]) -> DataFrame:
    """A row for each (anchor, context), with all of its ranges."""
    return reduce(DataFrame.unionByName, parts).groupBy("anchor", "context").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _transformed(contexts: DataFrame, length: int) -> DataFrame:
    rows = contexts.select("anchor", "context", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor", "context")
    return rows.mapInArrow(partial(_by_transform, length=length), f"anchor bigint, context bigint, ranges {RANGES}")


def _of_hot(contexts: DataFrame, length: int, hot: int, widths: tuple[int, ...]) -> DataFrame:
    """(anchor, context, ranges) of contexts of anchors that are too many for a batch: in parts by `widths[0]`, parts of one key with too many contexts again by the next. Parts of width 1 are single windows, which counts settle."""
    cut = contexts.mapInArrow(partial(_finer, length=length, width=widths[0]), "anchor bigint, context bigint, key bigint, part bigint, first bigint, n bigint, place bigint, bytes binary")
    parts = written(cut, "context_parts")
    classes = parts.groupBy("key", "part").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.min("place").alias("place"), F.min("bytes").alias("bytes"))
    classes = written(classes.select(F.col("key").alias("anchor"), F.col("part").alias("context"), "copies", "n", "place", "bytes"), "part_classes")
    sizes = classes.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum(F.length("bytes")).alias("size")).filter("contexts > 1").select("anchor", (F.col("size") > hot).alias("hot"))
    mixed = classes.join(sizes, "anchor")
    found = [classes.filter("copies > 1").select("anchor", "context", _all()), _transformed(mixed.filter("NOT hot"), length)]
    if len(widths) > 1 and not sizes.filter("hot").isEmpty():
        found.append(_of_hot(mixed.filter("hot"), length, hot, widths[1:]))
    known = _united(found).select(F.col("anchor").alias("key"), F.col("context").alias("part"), "ranges")
    shifted = F.transform("ranges", lambda r: F.struct((r["first"] + F.col("first")).alias("first"), r["n"].alias("n")))
    out = written(parts.drop("bytes").join(known, ["key", "part"]).select("anchor", "context", shifted.alias("ranges")), "part_ranges")
    discard(parts, classes, *found)
    return out


def repeats(docs: DataFrame, length: int = 400, hot: int = HOT) -> DataFrame:
    """(k1, k2, spans): for the texts with repeated windows, by their hashes, the ranges of such windows' starts."""
    from xxhash import xxh64_intdigest

    texts = docs.select("text", *hashes_of("text"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                every_at, all_data = text_bytes(batch.column("text"))
                # a text beyond PIECE, alone in its slice, goes in pieces that overlap by all but one byte of a window
                for skip in range(0, max(1, len(all_data) - length + 1), PIECE) if batch.num_rows == 1 else (0,):
                    at, data = (np.array([0, min(len(all_data) - skip, PIECE + length - 1)]), all_data[skip : skip + PIECE + length - 1]) if batch.num_rows == 1 else (every_at, all_data)
                    r = runs_of(at, data, length)
                    raw = data.tobytes()
                    start = at[r["text"]] + r["first"]
                    context = np.array([xxh64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + r["n"] + length - 1).tolist())], np.uint64)
                    # a row for each context, with all places where the slice has it
                    order = np.lexsort((context, r["anchor"]))
                    new = np.append(True, (context[order][1:] != context[order][:-1]) | (r["anchor"][order][1:] != r["anchor"][order][:-1]))[: len(order)]
                    own, some = pa.array(r["text"][order]), order[new]
                    at_fields = [*(batch.column(c).take(own) for c in ("k1", "k2")), pa.array((r["first"] + skip)[order].astype(np.int32))]
                    places = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(order)).astype(np.int32)), pa.StructArray.from_arrays(at_fields, ["k1", "k2", "first"]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(r["anchor"][some].view(np.int64)), pa.array(context[some].view(np.int64)), pa.array(r["n"][some].astype(np.int16)), pa.array(r["place"][some].astype(np.int16)), batch.column("id").take(pa.array(r["text"][some])), places], ["slice", "anchor", "context", "n", "place", "id", "places"])
                    number += 1

    every = written(texts.mapInArrow(runs, "slice bigint, anchor bigint, context bigint, n smallint, place smallint, id bigint, places array<struct<k1:bigint,k2:bigint,first:int>>"), "runs")
    one = F.col("places")[0]
    classes = every.groupBy("anchor", "context").agg(F.sum(F.size("places")).alias("copies"), F.min(F.struct(one["k1"].alias("k1"), one["k2"].alias("k2"), "id", one["first"].alias("first"), "n", "place")).alias("at"))
    classes = written(classes, "contexts")
    several = classes.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum(F.col("at.n") + F.lit(length)).alias("bytes")).filter("contexts > 1")
    mixed = classes.join(several, "anchor").select("anchor", "context", "at.*", "bytes")
    wanted = mixed.groupBy("k1", "k2", "id").agg(F.collect_list(F.struct("anchor", "context", "first", "n", "place", (F.col("bytes") > hot).alias("hot"))).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for whole in batches:
            for batch in slices(whole, "text", PIECE):
                at, data = text_bytes(batch.column("text"))
                raw = data.tobytes()
                column = batch.column("wanted")
                flat = column.flatten()
                base = np.repeat(at[:-1], column.value_lengths().to_numpy(zero_copy_only=False))
                first, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "n"))
                begin = base + first
                for k in range(0, len(begin), CUT):  # of a long text, some at a time
                    own, rows = slice(k, k + CUT), flat.slice(k, CUT)
                    parts = [raw[a:b] for a, b in zip(begin[own].tolist(), (begin + n + length - 1)[own].tolist())]
                    yield pa.RecordBatch.from_arrays([rows.field("anchor"), rows.field("context"), rows.field("n"), rows.field("place"), rows.field("hot"), pa.array(parts, pa.binary())], ["anchor", "context", "n", "place", "hot", "bytes"])

    contexts = texts.join(wanted, ["k1", "k2", "id"]).select("text", "wanted").mapInArrow(cut, "anchor bigint, context bigint, n smallint, place smallint, hot boolean, bytes binary")
    contexts = written(contexts, "context_bytes")
    whole = classes.filter("copies > 1").select("anchor", "context", F.col("at.n").cast("bigint").alias("n")).select("anchor", "context", _all())
    found = [whole, _transformed(contexts.filter("NOT hot"), length)]
    if not (deep := contexts.filter("hot")).isEmpty():
        found.append(_of_hot(deep.dropDuplicates(["anchor", "context"]), length, hot, WIDTHS))
    # one row for each context, so that a context of a slice meets one row at most, whatever its copies; a slice's contexts meet again and become its texts, so no place is a row
    ranges = written(_united(found), "context_ranges")  # a table, so that the join can split a context that very many runs have
    met = every.join(ranges, ["anchor", "context"]).select("slice", "places", "ranges").repartition("slice").sortWithinPartitions("slice")
    spans = met.mapInArrow(_by_text, f"k1 bigint, k2 bigint, spans {RANGES}")
    out = written(spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans")), "repeats")
    discard(every, classes, contexts, ranges, *found)
    return out


def hashes_of(text: str) -> list:
    """Two hashes of a text that stand for it; null is as the empty text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(F.lit(1), whole).alias("k1"), F.xxhash64(F.lit(2), whole).alias("k2")]


def removed_bytes(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs (start, end) of bytes that the windows cover."""
    out: list[list[int]] = []
    for a, n in sorted((s["first"], s["n"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - 1 + length)
        else:
            out.append([a, a + n - 1 + length])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = 400, columns: tuple[str, ...] = ("doc_id",), hot: int = HOT, texts: bool = True) -> DataFrame:
    """`columns` of each row, with n_bytes, n_removed, n_spans and kept_sha256 of its text and, if texts, what is kept of it.

    Removal may cut within a character; the digest is of all bytes that are left, the text lacks those of such characters.
    """
    kinds = dict(docs.dtypes)
    names = {c: f"c{k}" for k, c in enumerate(columns)}
    rows = docs.select(*(F.col(c).alias(n) for c, n in names.items()), F.coalesce("text", F.lit("")).alias("text"), *hashes_of("text"))
    found = repeats(docs, length, hot)
    schema = ", ".join([*(f"{n} {kinds[c]}" for c, n in names.items()), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", *["kept string"] * texts])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                out: list[list] = [[], [], [], [], []]
                at, data = text_bytes(batch.column("text"))
                raw = data.tobytes()
                for a, b, spans in zip(at.tolist(), at[1:].tolist(), batch.column("spans").to_pylist()):
                    gone = removed_bytes(spans, length)
                    own = raw[a:b]
                    kept = b"".join([own[x:y] for x, y in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), b - a])]) if gone else own
                    for c, v in zip(out, (b - a, b - a - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode('utf-8', 'ignore'))):
                        c.append(v)
                kept_columns = [pa.array(c, t) for c, t in zip(out[: 4 + texts], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names.values()), *kept_columns], [*names.values(), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts])

    out = rows.join(found, ["k1", "k2"], "left").drop("k1", "k2").mapInArrow(apply, schema)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts)


def without_repeats(docs: DataFrame, length: int = STAGE_LENGTH, chars: str = "n_chars") -> DataFrame:
    """docs with what is kept of their texts, and the column `chars`, if there is one, as long as a changed text. All rows stay; null texts stay null."""
    moved, back = aside(docs, "doc_id", "text", chars)
    moved = moved.withColumn("__null", F.col("text").isNull())
    kept = dedup(moved, length, tuple(c for c in moved.columns if c != "text"))
    if chars in moved.columns:
        kept = kept.withColumn(chars, F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col(chars)).cast(moved.schema[chars].dataType))
    return back(kept.withColumn("text", F.when(~F.col("__null"), F.col("kept"))))


def digests(docs: DataFrame) -> DataFrame:
    """The bytes, removed bytes, removed runs and a digest of what is kept of each document."""
    return dedup(docs, texts=False)
