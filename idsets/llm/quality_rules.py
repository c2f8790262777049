"""Quality rules by weak supervision: rules vote or abstain, and a posterior takes the place of all-must-pass.

Each rule looks at one statistic of a text and votes for good or bad, or abstains. Expectation-maximisation estimates the share of good texts and,
for each rule, how often it votes either way or abstains on good and on bad texts, from the votes of all documents, which are counted by pattern: at most 3 ** rules rows. A
document is kept if its posterior probability of being good is at least one half and the base rules hold; single bad votes can be outvoted, and abstentions of
several rules can speak against a text. All work on texts is in DataFrame functions.

Base statistics, over words (runs of anything but ASCII white space): word_chars, n_symbols, n_dup_lines and n_repeat_words; see
`base_columns`. base_failed is for texts of under 20 words or with over 30 % of the words in repeated windows.

Null and empty texts have zero statistics and fail; repeated rows each get their result and count each in the
estimate; a posterior of exactly one half keeps; a text's words and windows are arrays in one row, some 100 bytes for each word of the longest text of a task; a table without rows gives none; columns beside doc_id and text play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .text_stats import SYMBOLS, UPPER, count_of, with_words

WINDOW = 8
KEEP = 0.5
#: By statistic: the rule votes good up to the first limit and bad over the second; between, or where the statistic is null, it abstains.
RULES: dict[str, tuple[float, float]] = {
    "symbols": (0.02, 0.2),
    "shouts": (0.02, 0.3),
    "upper": (0.04, 0.2),
    "bars": (0.02, 0.08),
    "repeated_lines": (0.05, 0.3),
    "repeat_words": (0.05, 0.25),
    "same_words": (0.3, 0.5),
    "word_length": (6.5, 9.0),
    "open_lines": (0.15, 0.5),
}
VOTES = (-1, 0, 1)
#: What the estimate adds to the counts of bad votes, abstentions and good votes, by class: as many texts of a usual kind. It decides only where there are few documents.
PRIOR = {True: (0.5, 1.5, 8.0), False: (4.0, 2.0, 4.0)}
PRIOR_TEXTS = {True: 8.0, False: 2.0}
#: The first guess of a text's probability: with bad votes in the majority, with some, with none.
GUESS = (0.05, 0.5, 0.95)
ROUNDS, ENOUGH = 200, 1e-9


def base_columns(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """`columns` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the counts that the rules need."""
    rows = with_words(docs, columns)
    words, n = F.col("__words"), F.size("__words")
    counts = {
        "n_words": n.cast("bigint"),
        "word_chars": (F.char_length("__text") - count_of(F.col("__text"), " \t\n\x0b\f\r")).cast("bigint"),
        "n_symbols": count_of(F.col("__text"), SYMBOLS).cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__n_lines": F.size("__lines"),
        "__n_upper": count_of(F.col("__text"), UPPER),
        "__n_shouts": count_of(F.col("__text"), "!"),
        "__n_bars": count_of(F.col("__text"), "|"),
        "__n_different": F.size(F.array_distinct(words)),
        "__n_open": F.size(F.filter("__lines", lambda x: ~F.substring(F.rtrim(x), -1, 1).isin(".", "?"))),
    }
    # hashes of 64 bits stand for words and for windows
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    rows = rows.select(*columns, *(c.alias(k) for k, c in counts.items()), F.when(n >= WINDOW, hashed).alias("__h"))
    windows = F.transform(F.sequence(F.lit(1), F.size("__h") - (WINDOW - 1)), lambda i: F.xxhash64(*(F.get("__h", i + (k - 1)) for k in range(WINDOW))))
    kept = [c for c in rows.columns if c != "__h"]
    rows = rows.select(*kept, F.when(F.col("__h").isNotNull(), windows).alias("__w"))
    twice = F.size(F.array_distinct("__w")) < F.size("__w")
    placed = F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*kept, F.when(twice, placed).alias("__s"))
    last = F.size("__s") - 1
    same = F.transform("__s", lambda x, k: F.when(((k > 0) & (F.get("__s", k - 1)["h"] == x["h"])) | ((k < last) & (F.get("__s", k + 1)["h"] == x["h"])), x["i"]))
    rows = rows.select(*kept, F.sort_array(F.filter(same, lambda i: i.isNotNull())).alias("__at"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("__at", start, lambda s, i: F.struct((s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n"), (i + WINDOW).alias("end")), lambda s: s["n"])
    return rows.select(*kept, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _values() -> dict[str, Column]:
    n, chars = F.col("n_words"), F.col("word_chars")
    share = lambda a, b: F.when(b > 0, a / b)
    return {
        "symbols": share(F.col("n_symbols"), n),
        "shouts": share(F.col("__n_shouts"), n),
        "upper": share(F.col("__n_upper"), chars),
        "bars": share(F.col("__n_bars"), n),
        "repeated_lines": share(F.col("n_dup_lines"), F.col("__n_lines")),
        "repeat_words": share(F.col("n_repeat_words"), n),
        # longer texts repeat more of their words: about half of a power of the length is usual
        "same_words": share(1 - F.col("__n_different") / F.greatest(n, F.lit(1)), F.log10(n + 10) / 2),
        "word_length": share(chars, n),
        "open_lines": share(F.col("__n_open"), F.col("__n_lines")),
    }


def votes() -> list[Column]:
    """1 for good, -1 for bad, 0 for an abstention, by rule."""
    values = _values()
    return [F.when(values[k] <= good, 1).when(values[k] > bad, -1).otherwise(0) for k, (good, bad) in RULES.items()]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """(log odds of good before any vote, for each rule what each of its votes adds) from vote patterns and how many documents have each.

    Expectation: a text's probability of being good from the share of good texts and each rule's rates of votes by class. Maximisation: the share and
    the rates from those probabilities. No rate has a floor, and a bad vote of a rule that is often wrong about good texts counts for little.
    """
    guess = [GUESS[0] if sum(pattern) < 0 else GUESS[1] if -1 in pattern else GUESS[2] for pattern, _ in patterns]
    for _ in range(rounds):
        weight = {True: [n * p for (_, n), p in zip(patterns, guess)], False: [n * (1 - p) for (_, n), p in zip(patterns, guess)]}
        texts = {c: sum(w) + PRIOR_TEXTS[c] for c, w in weight.items()}
        start, rules = math.log(texts[True] / texts[False]), []
        for k in range(len(RULES)):
            counts = {c: dict(zip(VOTES, PRIOR[c])) for c in weight}
            for c, own in weight.items():
                for (pattern, _), w in zip(patterns, own):
                    counts[c][pattern[k]] += w
            total = {c: sum(x.values()) for c, x in counts.items()}
            rules.append({v: math.log(counts[True][v] / total[True]) - math.log(counts[False][v] / total[False]) for v in VOTES})
        before, guess = guess, [posterior(pattern, start, rules) for pattern, _ in patterns]
        if all(abs(a - b) < ENOUGH for a, b in zip(before, guess)):
            break
    return start, rules


def posterior(pattern: tuple[int, ...], start: float, rules: list[dict[int, float]]) -> float:
    x = start + sum(r[v] for v, r in zip(pattern, rules))
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def posterior_column(names: list[str], start: float, rules: list[dict[int, float]]) -> Column:
    x = F.lit(start)
    for n, r in zip(names, rules):
        x = x + F.when(F.col(n) > 0, F.lit(r[1])).when(F.col(n) < 0, F.lit(r[-1])).otherwise(F.lit(r[0]))
    return 1 / (1 + F.exp(-x))


def judged(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`columns`, the base statistics, base_failed, posterior and kept of each row."""
    names = {c: f"c{k}" for k, c in enumerate(columns)}
    rows = base_columns(docs.select(*(F.col(c).alias(n) for c, n in names.items()), "text"), tuple(names.values()))
    own = [f"__v{k}" for k in range(len(RULES))]
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    voted = written(rows.select(*names.values(), *base, *(v.alias(o) for v, o in zip(votes(), own))), "votes")
    counted = voted.groupBy(*own).count().collect()  # at most 3 ** rules rows
    good = posterior_column(own, *estimate(sorted((tuple(r)[:-1], r["count"]) for r in counted)))
    return voted.select(*(F.col(n).alias(c) for c, n in names.items()), *base, base_failed().alias("base_failed"), good.alias("posterior"), (~base_failed() & (good >= KEEP)).alias("kept"))


def verdicts(docs: DataFrame) -> DataFrame:
    return judged(docs)
