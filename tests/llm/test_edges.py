"""Every operator and stage on odd rows and on tables without rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from xxhash import xxh64_intdigest

from idsets.llm import decontaminate, html_text, language_id, license_scan, piece_codec, quality_classifier, quality_rules, simhash, suffix_dedup, token_files

OPERATORS = {
    "quality_classifier": lambda d, b, n: quality_classifier.predictions(d, n),
    "decontaminate": lambda d, b, n: decontaminate.digests(d, b),
    "html_text": lambda d, b, n: html_text.extract(d.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "kept", "score AS text"), model=html_text.fit(60)),
    "quality_rules": lambda d, b, n: quality_rules.verdicts(d),
    "language_id": lambda d, b, n: language_id.predictions(d),
    "license_scan": lambda d, b, n: license_scan.document_licences(d),
    "simhash": lambda d, b, n: simhash.digests(d),
    "token_files": lambda d, b, n: token_files.token_digests(d, path("word_bpe_49k.json")),
    "piece_codec": lambda d, b, n: piece_codec.encode_decode(d, path("piece_bpe_32k.model")),
    "suffix_dedup": lambda d, b, n: suffix_dedup.digests(d),
}
STAGES = {
    "accepted": lambda d, b, n: quality_classifier.accepted(d, n),
    "one_of_each": lambda d, b, n: simhash.one_of_each(d),
    "without_repeats": lambda d, b, n: suffix_dedup.without_repeats(d),
    "clean": lambda d, b, n: decontaminate.clean(d, b),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, odd, benchmark_items, label_rows):
    got = OPERATORS[name](odd, benchmark_items, label_rows).collect()
    assert len(got) == odd.count()
    key = "page_id" if name == "html_text" else "doc_id"
    assert sorted(str(r[key]) for r in got) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    same = [tuple(r)[1:] for r in got if r[key] == 3 and name != "token_files"]
    assert len(set(map(str, same))) <= 1


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, odd, benchmark_items, label_rows):
    assert OPERATORS[name](odd.limit(0), benchmark_items.limit(0), label_rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(name, odd, benchmark_items, label_rows):
    got = STAGES[name](odd, benchmark_items, label_rows)
    assert got.columns == odd.columns
    kept = {r.doc_id for r in got.collect()}
    assert kept <= {r.doc_id for r in odd.collect()}
    assert STAGES[name](odd.limit(0), benchmark_items.limit(0), label_rows.limit(0)).count() == 0


def test_values_on_odd_rows(odd, benchmark_items, label_rows):
    """What the docstrings say of null, empty and blank texts."""
    rows = {name: OPERATORS[name](odd, benchmark_items, label_rows).collect() for name in ("decontaminate", "quality_rules", "language_id", "license_scan", "simhash", "token_files", "piece_codec", "suffix_dedup", "quality_classifier")}
    of = {name: {r.doc_id: r for r in got if r.doc_id is not None} for name, got in rows.items()}
    ids = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    for k, text in ids.items():
        if text and text.strip():
            continue
        nothing = hashlib.sha256(b"").hexdigest()
        r = of["decontaminate"][k]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (0, 0, 0, nothing, False)
        r = of["quality_rules"][k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, 0, 0, True, False)
        assert (of["language_id"][k].lang_pred, of["language_id"][k].score) == ("und", 0)
        assert of["license_scan"][k].licence is None
        assert of["simhash"][k].fingerprint == "0" * 16
        assert of["token_files"][k].n_tokens == 1 and of["token_files"][k].ids_crc32 == zlib.crc32(np.array([2], "<u4").tobytes())
        if not text:
            assert of["piece_codec"][k].n_tokens == 0 and of["piece_codec"][k].decoded_sha256 == nothing
            assert (of["suffix_dedup"][k].n_bytes, of["suffix_dedup"][k].n_removed, of["suffix_dedup"][k].kept_sha256) == (0, 0, nothing)
    assert len({r.score for k, r in of["quality_classifier"].items() if not (ids[k] or "").strip("")}) == 1
    empty = [r.component_id for r in rows["simhash"] if r.fingerprint == "0" * 16]
    assert len(set(empty)) == 1 and empty[0] == min(k for k, t in ids.items() if not (t or "").strip())


def test_one_row_of_each_text_stays(spark):
    """Ids that several texts share, and rows without an id."""
    from .conftest import prose

    r = random.Random(3)
    a, b, c = (prose(r, 60) for _ in range(3))
    rows = [(2, b), (5, a), (5, b), (None, c), (None, c), (None, a), (7, c), (None, "alone"), (None, None), (9, "")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(2, b), (5, a), (7, c), (None, "alone"), (9, "")]))


def test_null_texts_stay_null(spark):
    got = suffix_dedup.without_repeats(spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x" * 300 + "y" * 10, 310)], "doc_id bigint, text string, n_chars int")).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got if r.text is not None) == [(2, "", 0), (3, "y" * 10, 10)] and len(got) == 3


def test_a_long_text(spark, benchmark_items, label_rows):
    """1.5 MB, beyond the pieces in which operators look at texts, with a repeat far away."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from .conftest import prose

    r = random.Random(5)
    passage = prose(r, 90)
    text = f"{prose(r, 1000)} {passage} " + " ".join(f"{prose(r, 500)} n{k}" for k in range(440)) + f" {passage} end"
    text = text.replace("end", benchmark_items.filter("item_id = 0").first().text)
    assert len(text) > 1_200_000
    docs = spark.createDataFrame([(1, text, "en"), (2, "short", "en")], "doc_id bigint, text string, lang string")
    words, raw = text.split(), text.encode()
    one = lambda df: df.filter("doc_id = 1").first()
    shingles = [b" ".join(x) for x in zip(*([w.encode().lower() for w in words[k:]] for k in range(3)))]
    hashes = np.array([xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    assert one(simhash.digests(docs)).fingerprint == f"{sum(1 << k for k in range(64) if 2 * ones[k] > len(hashes)):016x}"
    assert one(simhash.alike_components(docs)).component_id == 1
    got = one(suffix_dedup.digests(docs))
    seen, gone = {}, np.zeros(len(raw), bool)
    for k in range(len(raw) - 399):
        h = hash(raw[k : k + 400])
        if h in seen:
            gone[k : k + 400] = gone[seen[h] : seen[h] + 400] = True
        seen.setdefault(h, k)
    assert gone.any() and (got.n_bytes, got.n_removed) == (len(raw), int(gone.sum()))
    assert got.kept_sha256 == hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    assert one(token_files.token_digests(docs, path("word_bpe_49k.json"))).n_tokens == len(library.encode(text, add_special_tokens=False).ids) + 1
    assert one(piece_codec.encode_decode(docs, path("piece_bpe_32k.model"))).n_tokens == len(SentencePieceProcessor(model_file=path("piece_bpe_32k.model")).encode(text))
    assert one(quality_rules.verdicts(docs)).n_words == len(words)
    assert one(decontaminate.digests(docs, benchmark_items)).contaminated
    assert one(language_id.predictions(docs)).lang_pred == "en"
    assert one(license_scan.document_licences(docs)).licence is None
    assert 0 <= one(quality_classifier.predictions(docs, label_rows)).score <= 1


def test_a_long_page():
    """Time in proportion to the length: end tags that match nothing, deep and wide trees."""
    import time

    model = html_text.fit(60)
    start = time.process_time()
    html_text.main_text("<b>x" * 30_000 + "</i>y" * 30_000, model)
    html_text.main_text("<article>" + "<div><p>hello world, this is some text. <b>x</b></div>" * 10_000 + "</article>", model)
    html_text.main_text("<div>" * 10_000 + "text" + "</i>" * 10_000, model)
    assert time.process_time() - start < 60


def test_a_lookup_reads_few_rows(spark, tmp_path):
    where = str(tmp_path / "ids")
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('number ', id) AS text").coalesce(1)
    token_files.write_tokens(docs, path("word_bpe_49k.json"), where)
    found = token_files.lookup(spark, where, [1234, 17_000])
    assert sorted(r.doc_id for r in found.collect()) == [1234, 17_000]
    scans = found._jdf.queryExecution().executedPlan().collectLeaves()
    assert scans.head().metrics().get("numOutputRows").get().value() <= 4_000


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one"), (None, None)], "doc_id string, text string")
    got = token_files.token_digests(docs, path("word_bpe_49k.json")).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, "a", "b"]
