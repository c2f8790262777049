"""Language identification by interpolated Kneser-Ney character models, one for each language.

A text is its words: runs of letters, in lower case, each between a start and an end mark. A model gives each character
of a word, the end mark included, a probability after up to four characters before it: discounted counts of the longest history,
interpolated with those of the shorter ones, where counts below the longest are of different characters in front.
The tables are sorted arrays of n-gram hashes with a row of values for all languages. A text's language is that with
the lowest cross-entropy for a character; the score is its posterior probability at a temperature that is fitted on
documents kept out of the counts, and `rejected` says that the cross-entropy is beyond what at most REJECT of texts like those reach.

Models come from a bounded sample of the labelled rows: about `sample` documents of a language, chosen by hash, and all of a language with fewer; that is the
parameter of the fit. Every lang of a labelled row with a letter has a model, however rare it is. All rows are scored over whole texts, each different word of a worker's texts once.

Null texts and texts without a letter are `und` with score 0; equal cross-entropies go to the first language by name;
a null lang teaches nothing; without a labelled row all texts are `und`; a text of any length is summed word by word; repeated rows each get their result; columns beside doc_id and
text (lang where it learns) play no part.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import RowCache, coded, numbered
from .common import slices, split_of, text_bytes, worker_state

ORDER = 5
#: Documents of a language in the fit, about.
SAMPLE = 600
#: The share of texts in a known language that may be rejected.
REJECT = 0.01
START, END = "\x02", "\x03"
#: Entries a worker keeps; see RowCache.
CACHE = 1_000_000
NONE = "und"

_P = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def words_of(chunk: bytes) -> list[str]:
    """The words in a run of ASCII letters and bytes beyond ASCII."""
    text = chunk.decode("utf-8", "replace").lower()
    return [text] if text.isalpha() else ["".join(g) for letters, g in groupby(text, str.isalpha) if letters]


def chunks_of(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of such runs."""
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    letter = _LETTER[data]
    if len(data):
        edge[1:-1] |= letter[1:] != letter[:-1]
    cuts = np.flatnonzero(edge)
    keep = letter[cuts[:-1]] if len(data) else np.zeros(0, bool)
    return cuts[:-1][keep], cuts[1:][keep]


def grams(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For n = 1 .. ORDER (places of n-grams among all characters, their hashes, their histories' hashes); the words' ends among the characters, which lack the start marks."""
    points = np.frombuffer("".join([START + w + END for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        code = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(31)
        code *= np.uint64(0x94D049BB133111EB)
        sizes = np.array([len(w) + 2 for w in words])
        ends = np.cumsum(sizes)
        place = np.arange(len(points)) - np.repeat(ends - sizes, sizes)  # in the word; 0 is the start mark
        at = np.flatnonzero(place)
        row = np.arange(len(at))
        out, gram, history, power = [], code[at], np.zeros(len(at), np.uint64), np.uint64(1)
        for n in range(1, ORDER + 1):
            if n > 1:
                inside = place[at] >= n - 1
                at, row, gram, history = at[inside], row[inside], gram[inside], history[inside]
                before = code[at - n + 1]
                history = history + before * power
                power = power * _P
                gram = gram + before * power
            out.append((row, gram + np.uint64(n), history + np.uint64(n)))
    return out, ends - np.arange(1, len(words) + 1)


class KneserNey:
    """Sorted hash arrays of all languages' models."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs, self.key = sorted(counts), uuid.uuid4().hex
        size = len(self.langs)
        alphabet = {c for words in counts.values() for w in words for c in w}
        self.base = 1.0 / (len(alphabet) + 2)  # the end mark, and one for all others
        tables: list[list[dict]] = [[] for _ in range(ORDER)]
        for lang in self.langs:
            for n, t in enumerate(self._counted(counts[lang])):
                tables[n].append(t)
        self.gram, self.rest = [], []
        for n in range(ORDER):
            keys = np.unique(np.concatenate([t["gram"] for t in tables[n]]))
            contexts = np.unique(np.concatenate([t["context"] for t in tables[n]]))
            value, left = np.zeros((len(keys), size), np.float32), np.ones((len(contexts), size), np.float32)
            for k, t in enumerate(tables[n]):
                value[np.searchsorted(keys, t["gram"]), k] = t["value"]
                left[np.searchsorted(contexts, t["context"]), k] = t["left"]
            self.gram.append((keys, value))
            self.rest.append((contexts, left))

    @staticmethod
    def _counted(words: Counter) -> list[dict]:
        """Of each order: the n-grams with their discounted probabilities, the histories with the mass left to shorter ones."""
        names = list(words)
        weight = np.array([words[w] for w in names], np.float64)
        orders, ends = grams(names)
        weights = np.repeat(weight, np.diff(np.append(0, ends)))
        tables, longer = [], None
        for n in range(ORDER, 0, -1):
            row, gram, history = orders[n - 1]
            keys, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights[row], len(keys))
            if longer is not None:  # of those with characters in front: how many different ones
                inside = np.searchsorted(row, longer[0])
                kinds = np.bincount(inverse[inside[longer[1]]], minlength=len(keys))
                count = np.where(kinds > 0, kinds, count)
            contexts, owner = np.unique(history[first], return_inverse=True)
            total, kinds = np.bincount(owner, count), np.bincount(owner)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones and twos else 0.5
            discount = min(max(discount, 0.1), 0.9)
            tables.append({"gram": keys, "value": np.maximum(count - discount, 0) / total[owner], "context": contexts, "left": np.minimum(discount * kinds / total, 1.0)})
            longer = row, first
        return tables[::-1]

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each word in each language, its number of characters)."""
        orders, ends = grams(words)
        p = np.full((len(orders[0][0]), len(self.langs)), self.base)
        for (row, gram, history), (keys, value), (contexts, left) in zip(orders, self.gram, self.rest):
            own = p[row] * _rows(contexts, left, history, 1.0)
            p[row] = own + _rows(keys, value, gram, 0.0)
        begin = np.append(0, ends[:-1])
        return np.add.reduceat(np.log(p), begin, axis=0), ends - begin


def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], missing)


def _entropies(docs: DataFrame, model: KneserNey, columns: tuple[str, ...]) -> DataFrame:
    """`columns`, chars and entropy: the cross-entropy for a character in each language, in order of the model's languages."""
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's
    size = len(model.langs)

    def encode(chunks: list[bytes]) -> np.ndarray:
        model = shared.value
        words = [words_of(c) for c in chunks]
        flat = [w for ws in words for w in ws]
        out = np.zeros((len(chunks), size + 1))
        for k in range(0, len(flat), 20_000):
            part = flat[k : k + 20_000]
            logs, chars = model.scores(part)
            owner = np.repeat(np.arange(len(words)), [len(ws) for ws in words])[k : k + 20_000]
            np.add.at(out, owner, np.column_stack([logs, chars]))
        return out

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_state(("languages", shared.value.key), lambda: RowCache(encode, CACHE, size + 1))
        for whole in batches:
            for batch in slices(whole, "text"):
                at, data = text_bytes(batch.column("text"))
                starts, ends = chunks_of(at, data)
                codes, chunks = coded(data, starts, ends)
                rows = cache.rows_of(chunks)
                total = np.concatenate([np.zeros((1, size + 1)), np.cumsum(rows[codes], axis=0)])
                firsts = np.searchsorted(starts, at)
                sums = total[firsts[1:]] - total[firsts[:-1]]
                chars = np.rint(sums[:, -1]).astype(np.int64)
                entropy = np.round(-sums[:, :-1] / np.maximum(chars, 1)[:, None], 9)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(chars), pa.ListArray.from_arrays(pa.array(np.arange(len(entropy) + 1, dtype=np.int32) * size), pa.array(entropy.ravel()))], [*columns, "chars", "entropy"])

    return docs.select(*columns, "text").mapInArrow(apply, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "chars bigint", "entropy array<double>"]))


def fit(docs: DataFrame, learn: F.Column, sample: int = SAMPLE) -> tuple[KneserNey, float, list[float]] | None:
    """The model, its temperature and each language's largest usual cross-entropy, from the rows of docs for which learn holds and lang isn't null."""
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, sample / n)) for lang, n in sorted(sizes.items())], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    drawn = labelled.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("doc_id", "text", "lang", (F.pmod(F.xxhash64("text"), F.lit(8)) == 0).alias("apart"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found: Counter = Counter()
                at, data = text_bytes(batch.column("text"))
                starts, ends = chunks_of(at, data)
                codes, chunks = numbered(data, starts, ends)
                words = [words_of(c) for c in chunks]
                firsts = np.searchsorted(starts, at).tolist()
                codes = codes.tolist()
                for lang, a, b in zip(batch.column("lang").to_pylist(), firsts, firsts[1:]):
                    for c in codes[a:b]:
                        for w in words[c]:
                            found[lang, w] += 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, Counter] = {}
    parts = drawn.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("apart").alias("apart")).collect()
    # a language whose rows are all kept apart learns from them too
    taught = ~F.col("apart") | F.col("lang").isin([r.lang for r in parts if r.n == r.apart])
    for r in drawn.filter(taught).mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():  # the words of the sample
        counts.setdefault(r.lang, Counter())[r.word] = r.n
    if not counts:
        return None
    model = KneserNey(counts)
    checked = [r for r in _entropies(drawn.filter("apart"), model, ("lang",)).collect() if r.chars and r.lang in counts]
    temperature, usual = 1.0, [float("inf")] * len(model.langs)
    if checked:
        entropy, chars = np.array([r.entropy for r in checked]), np.array([r.chars for r in checked])
        truth = np.array([model.langs.index(r.lang) for r in checked])
        losses = {}
        for t in np.geomspace(1, 1000, 25):  # a character's evidence counts for less than a whole one: neighbours depend on each other
            z = -entropy * chars[:, None] / t
            z -= z.max(1, keepdims=True)
            losses[float(t)] = float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())
        temperature = min(losses, key=lambda t: (losses[t], -t))
        usual = limits(entropy[np.arange(len(truth)), truth], truth, len(model.langs))
    return model, temperature, usual


def limits(entropy: np.ndarray, truth: np.ndarray, size: int) -> list[float]:
    """For each language the cross-entropy that at most REJECT of its texts exceed: its mean, and over all languages the rank of what is beyond the means that promises this for one more text. Too few texts promise nothing, and the limits are infinite."""
    mean = [float(entropy[truth == k].mean()) if (truth == k).any() else float(entropy.mean()) for k in range(size)]
    beyond = np.sort(entropy - np.array(mean)[truth])
    rank = int(np.ceil((len(beyond) + 1) * (1 - REJECT)))
    return [m + float(beyond[rank - 1]) for m in mean] if rank <= len(beyond) else [float("inf")] * size


def identify(docs: DataFrame, fitted: tuple[KneserNey, float, list[float]] | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns`, lang_pred, score and rejected of each row."""
    if fitted is None:
        return docs.select(*columns, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    model, temperature, usual = fitted
    scored = _entropies(docs, model, columns)
    best = F.array_min("entropy")
    at = F.array_position("entropy", best).cast("int")
    odds = F.aggregate("entropy", F.lit(0.0), lambda s, e: s + F.exp((best - e) * F.col("chars") / F.lit(temperature)))
    some = F.col("chars") > 0
    limits = F.array(*(F.lit(u) for u in usual))
    return scored.select(
        *columns,
        F.when(some, F.element_at(F.array(*(F.lit(x) for x in model.langs)), at)).otherwise(NONE).alias("lang_pred"),
        F.when(some, 1 / odds).otherwise(0.0).alias("score"),
        F.when(some, best > F.element_at(limits, at)).otherwise(True).alias("rejected"),
    )


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row; a third of the ids teaches nothing."""
    held_out = split_of(F.col("doc_id"), 3) == 1
    fitted = fit(docs, ~held_out)
    return identify(docs, fitted).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
