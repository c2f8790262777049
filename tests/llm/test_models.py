"""Models: accuracy on held-out rows, and what they promise."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from idsets.llm import html_text, language_id, license_scan, quality_classifier, queries

SF = "/root/testdata/sf0.001"


def test_quality_classifier(spark):
    """Accuracy on rows that taught nothing, and scores against the rules over statistics in plain Python."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = quality_classifier.predictions(docs, labels)
    held_out = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(held_out) >= 50 and sum(r.predicted == r.quality for r in held_out) >= 0.95 * len(held_out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held_out)
    model = quality_classifier.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    x = np.array([plain_statistics(texts[k] or "") for k in sorted(texts)])
    assert np.allclose([r.score for r in got.orderBy("doc_id").collect()], model.score(x), atol=1e-9)


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    n, chars, rows = max(len(words), 1), max(len(text), 1), max(len(lines), 1)
    among = lambda letters: sum(text.count(c) for c in letters)
    return [
        len(words), chars / n, among("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, text.count("!") / n, among("#*$%&|<>") / n, text.count("|") / n, text.count(".") / n, text.count(",") / n,
        among("0123456789") / chars, len(set(words)) / n, (len(lines) - len(set(lines))) / rows, len(words) / rows,
    ]


def test_rules_compile_to_the_same_score(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality_classifier.fit(docs, labels)
    rows = quality_classifier.with_statistics(docs, ("doc_id",)).withColumn("score", model.column()).toPandas()
    x = rows[[f"__{n}" for n in quality_classifier.NAMES]].to_numpy(float)
    assert np.allclose(model.score(x), rows.score)
    assert len(model.rules) <= 60
    assert list(quality_classifier.statistics()) == list(quality_classifier.NAMES)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def plain_kneser_ney(counts, base):
    """Log probabilities of words, from the definitions and dictionaries alone."""
    from collections import defaultdict

    seen = defaultdict(float)
    for w, n in counts.items():
        s = language_id.START + w + language_id.END
        for end in range(1, len(s)):
            seen[s[max(0, end - 4) : end + 1] if end >= 4 else s[: end + 1]] += 0
            for size in range(1, 6):
                if end - size + 1 >= 0:
                    seen[s[end - size + 1 : end + 1]] += n
    tables = {}
    for size in range(5, 0, -1):
        own = {g: c for g, c in seen.items() if len(g) == size}
        if size < 5:
            fronts = defaultdict(set)
            for g in seen:
                if len(g) == size + 1:
                    fronts[g[1:]].add(g[0])
            own = {g: float(len(fronts[g])) if fronts.get(g) else c for g, c in own.items()}
        ones, twos = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = min(max(ones / (ones + 2 * twos) if ones and twos else 0.5, 0.1), 0.9)
        total, kinds = defaultdict(float), defaultdict(int)
        for g, c in own.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        tables[size] = own, d, total, kinds

    def probability(history, c, size):
        if size == 0:
            return base
        history = history[-(size - 1) :] if size > 1 else ""
        if len(history) < size - 1:
            return probability(history, c, len(history) + 1)
        own, d, total, kinds = tables[size]
        lower = probability(history, c, size - 1)
        if history not in total:
            return lower
        return max(own.get(history + c, 0) - d, 0) / total[history] + min(d * kinds[history] / total[history], 1.0) * lower if history + c in own else min(d * kinds[history] / total[history], 1.0) * lower

    def word(w):
        s = language_id.START + w + language_id.END
        return sum(np.log(probability(s[:end], s[end], 5)) for end in range(1, len(s)))

    return word


def test_language_model_against_definition():
    import random
    from collections import Counter

    r = random.Random(2)
    words = lambda letters, n: Counter("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))
    counts = {"a": words("abcé", 300), "b": words("bcd", 200)}
    model = language_id.KneserNey(counts)
    probes = [*list(counts["a"])[:20], "abba", "dddd", "zz", "é", "bcdbcdbcdbcd"]
    got, chars = model.scores(probes)
    for k, lang in enumerate(model.langs):
        plain = plain_kneser_ney(counts[lang], model.base)
        assert np.allclose(got[:, k], [plain(w) for w in probes], rtol=1e-5)
    assert chars.tolist() == [len(w) + 1 for w in probes]


def test_rejection_is_calibrated(spark):
    r = np.random.default_rng(1)
    entropy, truth = r.normal(2, 0.1, 20_000), r.integers(0, 3, 20_000)
    limits = np.array(language_id.limits(entropy[:10_000], truth[:10_000], 3))
    assert 0.005 < (entropy[10_000:] > limits[truth[10_000:]]).mean() < 0.015
    assert language_id.limits(entropy[:20], truth[:20], 3) == [float("inf")] * 3
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = language_id.fit(docs, F.lit(True))
    strange = spark.createDataFrame([(1, "zzxq kjwqv wwzzk xqjvq pzkwx " * 9), (2, "Жизнь прекрасна и удивительна")], "doc_id bigint, text string")
    assert all(x.rejected for x in language_id.identify(strange, fitted).collect())
    assert language_id.identify(docs, fitted).filter("rejected AND lang_pred <> 'und'").count() <= 0.05 * docs.count()


def test_rare_languages_are_learned(spark):
    """Languages of one row in 20,000; the texts of some are kept apart by their hash."""
    alphabets = {f"x{k}": "".join(chr(0x1000 + 100 * k + c) for c in range(20)) for k in range(16)}
    alphabets = {lang: "".join(c for c in a if c.isalpha()) for lang, a in alphabets.items()}
    alphabets = {lang: a for lang, a in alphabets.items() if len(a) >= 10}
    rows = [(k, f"plain words number {k % 97} again", "en") for k in range(20_000)]
    rows += [(20_000 + k, f"{a} {a[::-1]} {a[::2]}", lang) for k, (lang, a) in enumerate(alphabets.items())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    fitted = language_id.fit(docs, F.lit(True))
    assert len(alphabets) >= 8 and fitted[0].langs == sorted(["en", *alphabets])
    got = language_id.identify(docs.filter("lang <> 'en'"), fitted, ("lang",)).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_language_probabilities_sum_to_one():
    from collections import Counter

    model = language_id.KneserNey({"a": Counter({"aba": 3, "ab": 2, "ba": 1}), "b": Counter({"bbb": 4, "cab": 1})})
    for prefix in ("", "a", "ab", "zz"):
        before = model.scores([prefix])[0][0] if prefix else 0
        ends = np.exp(model.scores([prefix])[0][0]) if prefix else np.zeros(2)
        assert (ends >= 0).all() and np.isfinite(before).all()
    words = model.scores(["a", "b", "c"])[0]
    assert np.isfinite(words).all() and words[1, 1] < 0


def main_of(source: str) -> str:
    inner = source.split("<article>", 1)[1].split("</article>")[0]
    inner = re.sub(r"</?(h1|p)>", "\x02", inner)
    inner = re.sub(r"<[^>]*>", "", inner.replace("<br>", " "))
    return " ".join(b for b in (" ".join(html.unescape(x).split()) for x in inner.split("\x02")) if b)


def test_html_text(spark):
    got = queries.op3_html_text(spark, SF).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in got:
        assert r.text == main_of(source[r.page_id])
        assert r.n_chars == len(r.text)


def test_html_of_other_layouts():
    model = html_text.fit()
    right = total = 0
    for source in html_text.sample_pages(80, seed=77):
        page = html_text.Page(source)
        marked = {b for _, t, b in page.pieces if html_text.MARKED in t}
        want = [" ".join("".join(t for _, t, x in page.pieces if x == b).replace(html_text.MARKED, "").split()) for b in sorted(marked)]
        right += html_text.main_text(source.replace(html_text.MARKED, ""), model) == " ".join(want)
        total += 1
    assert right >= 0.85 * total


def test_labels_do_not_contradict():
    page = html_text.Page("<body><div><p>a a a<p>b b b</div><nav><ul><li>c</ul></nav></body>")
    x = html_text.features(page)
    for seed in range(30):
        p = np.random.default_rng(seed).random(len(page.tag))
        keep = html_text.decode(page, x[:, html_text.FEATURES.index("length")], p)
        assert len(keep) == len(page.tag)
    assert html_text.decode(page, np.ones(len(page.tag)), np.full(len(page.tag), 0.99)).all()
    assert not html_text.decode(page, np.ones(len(page.tag)), np.full(len(page.tag), 0.01)).any()


def test_page_parser():
    page = html_text.Page("<p><b>One &amp; two<br>three<p>four<script>x < y</script><!-- no --><ul><li>five<li>six &nbsp; seven</ul>a < b")
    assert page.blocks(np.ones(len(page.tag), bool)) == ["One & two three", "four", "five", "six seven", "a < b"]
    assert html_text.Page("").blocks(np.ones(1, bool)) == []


def test_license_scan(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c.py", "x"), ("a/b/COPYING", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("a/b/d/e.py", "print"),
        ("f.py", "# SPDX-License-Identifier: MPL-2.0\ncode"), (None, "x"), ("q", None), ("z/y/x.py", ""), ("a/b/c.py", "x"),
    ]
    got = {r.path: (r.own_licence, r.licence, r.licence_from) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "MIT", None), "a/b/c.py": (None, "GPL-3.0", "a/b"), "a/b/COPYING": ("GPL-3.0", "GPL-3.0", None), "a/b/d/e.py": (None, "GPL-3.0", "a/b"),
        "f.py": ("MPL-2.0", "MPL-2.0", None), None: (None, None, None), "q": (None, None, None), "z/y/x.py": (None, None, None),
    }


def plain_licences(texts):
    """The best licence of every text, over all of its lines, runs of lines and paragraphs, without any gate."""
    import math
    from collections import Counter

    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    holds = [set(words(t or "")) for t in texts]
    weight = lambda t: math.log1p((len(texts) + 1) / (sum(t in h for h in holds) + 1)) if t in known else math.log1p(len(texts) + 1)
    vectors = [(name, Counter(words(t))) for name, ts in license_scan.TEMPLATES.items() for t in ts]
    known = {t for _, c in vectors for t in c}
    weights = {t: weight(t) for t in known}
    rest = math.log1p(len(texts) + 1)
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        pieces = {" ".join(lines[k : k + n]) for k in range(len(lines)) for n in (1, 2, 3)} | set(re.split(r"\n[ \t\r]*\n", text or ""))
        best = (0.0, None)
        for p in pieces:
            c = {t: n * weights.get(t, rest) for t, n in Counter(words(p)).items()}
            size = math.sqrt(sum(v * v for v in c.values()))
            for name, own in vectors:
                v = {t: n * weights[t] for t, n in own.items()}
                dot = sum(v[t] * c.get(t, 0) for t in v)
                if dot and (x := round(dot / size / math.sqrt(sum(y * y for y in v.values())), 9)) >= license_scan.LEAST:
                    best = min(best, (-x, name), key=lambda z: (z[0], z[1] or ""))
        out.append(best[1])
    return out


def test_license_scan_against_plain_cosine(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    texts += [t for ts in license_scan.TEMPLATES.values() for t in ts]
    texts += ["code\n# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0\nmore code", "x = 1\n" * 40 + "Unauthorized copying of this file is strictly\nprohibited, proprietary and confidential", "the of and this is", None, ""]
    got = license_scan.document_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    want = plain_licences(texts)
    assert [r.licence for r in got] == want
    assert want[-5:] == ["MPL-2.0", "Proprietary", None, None, None]
    assert all(r.licence_from is None for r in got)


def test_html_by_hand():
    """Layouts that no generator wrote: what is main text is known from reading them."""
    model = html_text.fit()
    long = "This sentence belongs to the story, and it goes on for a while so that it reads as prose. "
    pages = {
        f'<html><body><div class="nav"><a href="/">Home</a> <a href="/a">About</a></div><div id="content"><h1>Title</h1><p>{long}{long}</p><p>{long}</p></div><div class="footer">&copy; 2020 Someone</div></body></html>': f"Title {long}{long}".strip() + " " + long.strip(),
        f'<body><header><h2>Site</h2><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav></header><main><p>{long}</p><aside class="ad">Buy now</aside><p>{long}</p></main><section class="comments"><p>First! Great read.</p></section>': f"{long.strip()} {long.strip()}",
        f'<table><tr><td class="menu"><a href=1>a</a><a href=2>b</a></td><td><article><p>{long}<script>var x = "<p>no</p>";</script></p></article></td></tr></table>': long.strip(),
        "": "",
        "<script>only()</script>": "",
    }
    for source, want in pages.items():
        assert html_text.main_text(source, model) == want


def test_inheritance_only_where_there_are_paths(spark):
    """Without paths no stage looks for directories; with them, a document has the licence of the one above."""
    docs = spark.createDataFrame([(1, "Released under the MIT License", "a/LICENSE"), (2, "plain words", "a/b/c.txt")], "doc_id bigint, text string, place string")
    without, along = license_scan.document_licences(docs), license_scan.document_licences(docs, docs.place)
    assert "regexp_extract" not in without._jdf.queryExecution().toString()
    assert without.dtypes == along.dtypes
    assert sorted((r.doc_id, r.licence, r.licence_from) for r in without.collect()) == [(1, "MIT", None), (2, None, None)]
    assert sorted((r.doc_id, r.licence, r.licence_from) for r in along.collect()) == [(1, "MIT", None), (2, "MIT", "a")]
