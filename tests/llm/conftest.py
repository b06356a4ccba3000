"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

import re
from collections import Counter
from math import log1p

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def passage(k: int, n: int) -> str:
    return " ".join(WORDS[(k * 7 + i * i + i * k) % len(WORDS)] + str((k + i) % 5) for i in range(n))


def _shingles(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else Counter([tuple(words)] if words else [])


def best_windows(text, items, least=0.8):
    """{item: (similarity, first word)} by brute force over all windows of an item's size; items of fewer than five words must be there word for word."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    own = [(i, low(t)) for i, t in items if low(t)]
    df = Counter(g for _, v in own for g in _shingles(v))
    weight = lambda g: log1p(len(own) / max(df[g], 1))
    words, out = low(text), {}
    for i, v in own:
        n, b = min(len(v), len(words)), _shingles(v)
        if not n or (len(v) < 5 and len(words) < len(v)):
            continue
        best = (0.0, 0)
        for start in range(len(words) - n + 1):
            a = _shingles(words[start : start + n])
            both = set(a) | set(b)
            score = sum(weight(g) * min(a[g], b[g]) for g in both) / sum(weight(g) * max(a[g], b[g]) for g in both)
            if score > best[0] + 1e-12:
                best = (score, start)
        if best[0] >= least:
            out[i] = max(out.get(i, (0.0, 0)), best, key=lambda x: (x[0], -x[1]))
    return out


def thue_morse(n, a="a", b="b"):
    """A word of 2**n letters; with a and b swapped it collides under any polynomial modulo 2**64 from n = 10 on."""
    word = a
    for _ in range(n):
        word += word.translate(str.maketrans(a + b, b + a))
    return word


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = " ".join(passage(k, 60) for k in range(200))
    rows = [
        (1, passage(1, 40)),
        (2, passage(1, 40)),
        (2, passage(1, 40)),
        (3, passage(2, 80) + " " + passage(1, 40)),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "one"),
        (8, "é ü 漢字 😀 x"),
        (9, long),
        (10, long + " tail"),
        (None, passage(3, 30)),
        (None, passage(3, 30)),
        (11, passage(1, 39) + " other"),
        (12, passage(2, 80)),
    ]
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd_docs):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    out = odd_docs
    for c in ("start", "key", "id", "block", "n", "gram", "found", "token_ids", "decoded", "p_toxic", "component", "a", "b", "_row", "_spans", "text_key"):
        out = out.withColumn(c, F.lit("x"))
    return out
