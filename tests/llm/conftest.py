import random

import pytest

WORDS = [a + b for a in "br cl d f gr h k l m n p s t v w".split() for b in ("a", "en", "ion", "or", "ull")]


def prose(r: random.Random, n: int) -> str:
    out = [r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else "") for _ in range(n)]
    return " ".join(w.capitalize() if k % 9 == 0 else w + "." * (k % 9 == 8) for k, w in enumerate(out))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty and long texts, repeated rows, one id for two texts, and columns with clashing names."""
    r = random.Random(4)
    texts = [prose(r, r.randint(1, 120)) for _ in range(12)]
    texts += [texts[0], texts[1] + " more", "", " \n\t ", None, prose(r, 6000), "ÀÉ straße 日本 \x00 ▁▁ <|endoftext|> \U0001f600", "\n".join([texts[2]] * 4)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (5, texts[6], "fr", "s", 1), (None, texts[7], None, None, None), (None, None, None, None, None)]
    rows = [(*row, 1.5, "x", 7, [1], "y", 3, b"z", 2) for row in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, predicted string, fp bigint, spans array<int>, kept string, n_removed bigint, k1 binary, __c0 int")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    r = random.Random(9)
    rows = [(k, prose(r, 25)) for k in range(4)] + [(4, "Short Item"), (5, ""), (6, None), (None, prose(r, 14)), (7, "one")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="session")
def label_rows(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
