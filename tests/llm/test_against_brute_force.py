"""Results against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from xxhash import xxh64_intdigest

from idsets.llm import decontaminate, piece_codec, quality_rules, simhash, suffix_dedup, token_files

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, benchmark_items):
    """Texts with near copies, shared passages, benchmark passages and repeated lines."""
    r = random.Random(1)
    texts = [prose(r, r.randint(1, 150)) for _ in range(40)]
    for k in range(10):
        words = texts[k].split(" ")
        words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    passage = prose(r, 70)
    texts += [f"{prose(r, 20)} {passage} {prose(r, 20)}" for _ in range(5)]
    items = [x.text for x in benchmark_items.collect() if x.text]
    texts += [f"{prose(r, 10)} {i.upper() if k % 2 else i} {prose(r, 10)}" for k, i in enumerate(items)]
    texts += ["\n".join([passage[:90]] * 6), "", None, "x"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).cache()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def texts_of(corpus):
    return sorted((r.doc_id, r.text or "") for r in corpus.collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_decontaminate(corpus, benchmark_items, block_bytes):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows: dict[tuple, set] = {}
    for i in benchmark_items.collect():
        w = words(i.text or "")
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i.item_id is None else str(i.item_id))
    got = by_id(decontaminate.contamination(corpus, benchmark_items, block_bytes=block_bytes))
    some = 0
    for doc_id, text in texts_of(corpus):
        w, hit, items = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        spans = [k for s in got[doc_id].spans for k in range(s.first, s.end)]
        assert (got[doc_id].n_words, spans, got[doc_id]["items"]) == (len(w), sorted(hit), sorted(items))
        some += bool(hit)
    assert some >= 5


def test_quality_rules(corpus):
    got = by_id(quality_rules.verdicts(corpus))
    for doc_id, text in texts_of(corpus):
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert not (r.kept and r.base_failed)


def plain_em(votes: np.ndarray) -> np.ndarray:
    """Posteriors of rows of votes, row by row and without patterns, after many rounds."""
    p = np.where(votes.sum(1) < 0, 0.05, np.where((votes < 0).any(1), 0.5, 0.95))
    for _ in range(400):
        odds = np.log((p.sum() + 8) / ((1 - p).sum() + 2)) * np.ones(len(p))
        for column in votes.T:
            good = np.array([p[column == v].sum() for v in (-1, 0, 1)]) + (0.5, 1.5, 8)
            bad = np.array([(1 - p)[column == v].sum() for v in (-1, 0, 1)]) + (4, 2, 4)
            odds += (np.log(good / good.sum()) - np.log(bad / bad.sum()))[column + 1]
        p = 1 / (1 + np.exp(-odds))
    return p


def test_quality_rules_posterior(spark):
    """Against plain expectation-maximisation, and: it isn't all-must-pass."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules.judged(docs).toPandas().sort_values("doc_id")
    rows = quality_rules.base_columns(docs, ("doc_id",)).select("doc_id", *(v.alias(f"v{k}") for k, v in enumerate(quality_rules.votes()))).toPandas().sort_values("doc_id")
    votes = rows[[c for c in rows if c != "doc_id"]].to_numpy(int)
    assert np.allclose(got.posterior, plain_em(votes), atol=1e-6)
    assert (got.kept == (~got.base_failed & (got.posterior >= 0.5))).all()
    passed = ~got.base_failed.to_numpy() & (votes >= 0).all(1)
    assert (passed != got.kept.to_numpy()).any()


def test_quality_rules_outvoted():
    """A rule that calls a third of the good texts bad, and one that is right: the first decides nothing alone."""
    n = len(quality_rules.RULES)
    good, noisy, bad = (1,) * n, (-1, *(1,) * (n - 1)), (-1, -1, -1, *(0,) * (n - 3))
    start, rules = quality_rules.estimate([(good, 600), (noisy, 300), (bad, 100)])
    assert quality_rules.posterior(noisy, start, rules) > 0.5 > quality_rules.posterior(bad, start, rules)
    only = quality_rules.estimate([(good, 900), ((0, *(1,) * (n - 1)), 100)])
    assert quality_rules.posterior((0, *(1,) * (n - 1)), *only) > 0.5
    quality_rules.estimate([])


def brute_roots(near: np.ndarray) -> np.ndarray:
    label = np.arange(len(near))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_trie_join():
    r = np.random.default_rng(3)
    keys = r.integers(0, 2**63, 200, dtype=np.uint64)
    keys = np.unique(np.concatenate([keys, keys[:60] ^ np.uint64(1 << 40), keys[:60] ^ np.uint64(0b111), keys[:30] ^ np.uint64(0b1111 << 50)]))
    label, links = simhash.linked(keys.reshape(-1, 1), np.array([[0, len(keys), 0, len(keys)]]), 0, 3)
    assert (label == brute_roots(np.bitwise_count(keys[:, None] ^ keys) <= 3)).all()
    assert (np.bitwise_count(keys[links[:, 0]] ^ keys[links[:, 1]]) <= 3).all()
    assert len(links) == len(keys) - len(set(label.tolist()))


def test_nodes_that_many_fingerprints_share(spark):
    """800 fingerprints that agree on their first 48 bits: what is dealt out stays far below a pair for each two."""
    r = random.Random(6)
    keys = [(0xABCDEF << 40) | (k << 16) | r.getrandbits(16) for k in range(1)] + [(0xABCDEF012345 << 16) | k for k in r.sample(range(1 << 16), 800)]
    classes = spark.createDataFrame([(k if k < 1 << 63 else k - (1 << 64),) for k in keys], "fp bigint")
    got = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(classes, len(keys), hot=256).collect()]
    own = np.array(keys, np.uint64)
    roots = brute_roots(np.bitwise_count(own[:, None] ^ own) <= 3)
    label = {k: k for k in keys}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in got:
        label[max(top(a), top(b))] = min(top(a), top(b))
    at = {int(k): int(x) for k, x in zip(own, roots)}
    assert len({top(k) for k in keys}) == len(set(roots.tolist())) and all(at[a] == at[b] for a, b in got)


@pytest.mark.parametrize("hot", [4096, 2])
def test_simhash(corpus, hot, monkeypatch):
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda c, n, budget: links(c, n, budget, hot))
    rows = texts_of(corpus)
    expected = []
    for _, text in rows:
        w = text.encode().lower().split()
        shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        ones = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        expected.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)))
    own = np.array(expected, np.uint64)
    roots = brute_roots(np.bitwise_count(own[:, None] ^ own) <= 3)
    got = by_id(simhash.digests(corpus))
    for k, (doc_id, _) in enumerate(rows):
        assert (got[doc_id].fingerprint, got[doc_id].component_id) == (f"{expected[k]:016x}", rows[roots[k]][0])


@pytest.mark.parametrize("hot", [4096, 3])
def test_one_of_each_finds_edited_copies(spark, hot, monkeypatch):
    """Edits of one text in places spread over it, alike to 0.7 to 0.95 by five-word shingles, against all pairs. With a small limit, bands are hot and so are pairs of bands."""
    every = simhash.candidates
    monkeypatch.setattr(simhash, "candidates", lambda marked: every(marked, hot))
    r = random.Random(12)
    texts = []
    for k in range(25):
        words = prose(r, 200).split(" ")
        texts.append(" ".join(words))
        for m in range(4):
            edited = list(words)
            for at in r.sample(range(len(words)), 1 + (k + m) % 7):
                edited[at] = f"edit{k}x{m}x{at}"
            texts.append(" ".join(edited))
    texts += [texts[3].upper(), "", " ", "Two words", "two  words", "two other words"]

    def of(text):
        w = text.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    sets = [of(t) for t in texts]
    near = np.array([[len(x & y) / len(x | y) >= 0.8 for y in sets] for x in sets])
    roots = brute_roots(near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.alike_components(docs).collect()} == dict(enumerate(roots.tolist()))
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(set(roots.tolist()))


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in simhash.components(pairs).collect()} == {(k, 0) for k in range(1, 41)} | {(100, 90)}


@pytest.mark.parametrize(("hot", "widths", "piece"), [(1 << 20, (48, 6, 1), 1 << 20), (200, (48, 6, 1), 150), (1, (7, 1), 1 << 20), (200, (1,), 70)])
def test_suffix_dedup(corpus, hot, widths, piece, monkeypatch):
    length = 60
    monkeypatch.setattr(suffix_dedup, "WIDTHS", widths)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    rows = [(i, t.encode()) for i, t in texts_of(corpus)]
    seen = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    got = by_id(suffix_dedup.dedup(corpus, length, hot=hot))
    some = 0
    for doc_id, t in rows:
        gone = {j for k in range(len(t) - length + 1) if seen[t[k : k + length]] > 1 for j in range(k, k + length)}
        spans = sum(1 for j in gone if j - 1 not in gone)
        kept = bytes(b for j, b in enumerate(t) if j not in gone)
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept) == (len(t), len(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode())
        some += bool(gone)
    assert some > 10


def test_transform():
    r = random.Random(5)
    for _ in range(60):
        length, letters = r.choice([5, 40]), r.choice([b"ab", b"abcdefgh"])
        contexts = [bytes(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 6))]
        contexts += [r.choice(contexts)[r.randint(0, 4) :] + b"b" for _ in range(3)]
        raw = b"\0".join(contexts) + b"\0"
        symbols = np.frombuffer(raw, np.uint8).astype(np.uint16) + np.uint16(1)
        symbols[symbols == 1] = 0
        hit = suffix_dedup.repeated(symbols, length)
        seen = Counter(raw[k : k + length] for k in range(len(raw) - length + 1))
        for k in range(len(raw) - length + 1):
            if b"\0" not in raw[k : k + length]:
                assert hit[k] == (seen[raw[k : k + length]] > 1)


def strange_texts(n: int) -> list[str]:
    r = random.Random(8)
    parts = list(" \n\tab▁  CdÉ×÷ñ日本\x00\x85\xa0́\U0001f600<>'.,ﬁ0129ΣΑİ/") + ["<|endoftext|>", "'s", "'ll", " the", "<s>", "   "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_token_files(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    docs = corpus.union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(strange_texts(300))], "doc_id bigint, text string"))
    token_files.write_tokens(docs, path("word_bpe_49k.json"), str(tmp_path / "ids"))
    read = token_files.read_tokens(spark, str(tmp_path / "ids"))
    rows, crc, start = by_id(read), by_id(token_files.with_crc32(read)), 0
    for doc_id, text in texts_of(docs):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        assert (rows[doc_id].start, rows[doc_id].n_tokens, list(rows[doc_id].ids)) == (start, len(ids), ids)
        assert crc[doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_piece_codec(spark, corpus):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    docs = corpus.union(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(strange_texts(300) + [" " * 37 + "x", "▁"])], "doc_id bigint, text string"))
    got = by_id(piece_codec.encode_decode(docs, path("piece_bpe_32k.model")))
    for doc_id, text in texts_of(docs):
        ids = library.encode(text)
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_one_of_each_loses_no_short_text(spark):
    """Texts of 8 words and the same with a ninth, alike to exactly 0.8 by 4 of 5 shingles, differ in 192 of 1,024 bits in the mean: a fifth in over 201."""
    r = random.Random(31)
    texts = []
    for _ in range(60):
        words = [f"w{r.getrandbits(40):x}" for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in simhash.alike_components(docs).collect()} == {k: k - k % 2 for k in range(len(texts))}


@pytest.mark.parametrize("hot", [8192, 2])
def test_rest_of_misses_no_pair(spark, hot):
    """Every pair alike to 0.8, with no band and no near link to help: random sets around the limit, of 1 to 300 shingles, that share frequent ones."""
    r = np.random.default_rng(17)
    common, sets = r.integers(0, 2**63, 30, dtype=np.uint64), []
    for k in range(60):
        whole = r.integers(0, 2**63, int(r.integers(1, 300)), dtype=np.uint64)
        whole = np.unique(np.concatenate([whole, common[: k % 31]]))
        for _ in range(3):
            gone = int(round(len(whole) * r.uniform(0, 0.25)))
            sets.append(np.unique(r.permutation(whole)[gone:]))
    own, begin = np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets]))
    first, count, rare = simhash.prefixes(own, begin, common, 0.8)
    at = np.append(0, np.cumsum(count))
    rows = [(k, k, len(x), first[at[k] : at[k + 1]].view(np.int64).tolist(), int(rare[k]), simhash.sketch_of(x)) for k, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node bigint, root bigint, shingles bigint, prefix array<bigint>, rare bigint, sketch binary")
    label = np.arange(len(sets))
    found = np.array([tuple(x) for x in simhash.rest_of(nodes, 0.8, hot).collect()])
    list(simhash.unite(label, found[:, 0], found[:, 1]))
    whole = [set(x.tolist()) for x in sets]
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if len(whole[a] & whole[b]) >= 0.8 * len(whole[a] | whole[b])]
    assert len(alike) > 40 and all(label[a] == label[b] for a, b in alike)


def test_a_passage_in_all_texts_joins_few_rows(spark, monkeypatch):
    """A passage that 1,200 texts have: the table of runs, which the repeated ranges are joined to, has a row for each context of a slice, not for each of its places."""
    r = random.Random(41)
    passage = prose(r, 120)
    docs = spark.createDataFrame([(k, f"{prose(r, 5)} {passage} {prose(r, 5)}") for k in range(1200)], "doc_id bigint, text string").repartition(3)
    rows, keep = {}, suffix_dedup.written

    def written(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "written", written)
    got = suffix_dedup.dedup(docs, 100)
    assert all(x.n_spans >= 1 and x.n_removed >= len(passage.encode()) - 2 for x in got.collect())
    assert rows["repeats"] == 1200
    assert rows["runs"] < 1200 * 6


def rows_made(plan) -> list[int]:
    """Rows that each node of a plan that has run gave out."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return rows_made(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return rows_made(plan.plan())
    metrics, children = plan.metrics(), plan.children()
    own = [metrics.get(k).get().value() for k in ("numOutputRows", "pythonNumRowsReceived") if metrics.contains(k)]
    return own + [x for k in range(children.size()) for x in rows_made(children.apply(k))]


def test_places_are_no_rows(spark, monkeypatch):
    """1,200 texts with one passage of many runs: what becomes of the repeated ranges has a row for each context of a slice or for each text, never for each place. Copies and a text's own repeats are places too."""
    r = random.Random(42)
    passage, length = prose(r, 300), 60
    texts = [f"{prose(r, 5)} {passage} {prose(r, 5)}" for _ in range(1190)]
    texts += [texts[0]] * 8 + [f"{passage} {passage}"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    made, keep = [], suffix_dedup.written

    def written(df, name):
        if name == "repeats":
            df.collect()
            made.extend(rows_made(df._jdf.queryExecution().executedPlan()))
        return keep(df, name)

    monkeypatch.setattr(suffix_dedup, "written", written)
    got = suffix_dedup.dedup(docs, length)
    assert all(x.n_spans >= 1 and x.n_removed >= len(passage.encode()) - 2 for x in got.collect())
    runs = suffix_dedup.runs_of(np.array([0, len(passage.encode())]), np.frombuffer(passage.encode(), np.uint8), length)
    places = len(texts) * (len(runs["n"]) - 2)
    assert places > 20 * len(texts) and 1192 <= max(made) < places / 5
