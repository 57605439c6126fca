"""Periodic runs against a search of every lag, and the query against the contract written out."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerline.llm.queries import op11_periodic_runs
from ledgerline.llm.runs import RunRule, find_runs, periodic_runs


def every_lag(words, min_length=24, min_repeats=3):
    """All maximal stretches of every lag; the smallest period of those with the same ends."""
    found = {}
    for q in range(1, len(words) // min_repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng, n):
    words = [rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        at, p = rng.randrange(n), rng.randint(1, 70)
        for i in range(at + p, min(n, at + rng.randint(p, 6 * p))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("rule", [RunRule(), RunRule(10, 4), RunRule(1, 3), RunRule(60, 3)])
def test_runs_equal_a_search_of_every_lag(rule):
    rng = random.Random(4)
    for _ in range(400):
        words = random_words(rng, rng.randint(1, 260))
        assert find_runs(np.array(words, np.int64), rule) == every_lag(words, rule.min_length, rule.min_repeats)


def test_nested_periods_and_long_texts():
    inner = [0] * 30 + list(range(1, 40))
    assert find_runs(np.array(inner * 4, np.int64)) == every_lag(inner * 4)
    assert find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert find_runs(np.tile(np.arange(7_001), 40)) == [(0, 280_040, 7_001)]
    with pytest.raises(ValueError):
        RunRule(10, 2)


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = every_lag(words)
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_matches_the_contract(spark, tmp_path):
    rng = random.Random(9)
    texts = [" ".join(f"w{x}" for x in random_words(rng, rng.randint(1, 220))) for _ in range(120)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(500, None, "en", "s", 0), (501, "", None, None, 0), (502, " \t\n", "en", "s", 0), (None, "a b c " * 40, "en", "s", 0),
             (503, "é\x0bß\x85x " * 60, "en", "s", 0), (7, texts[7], "en", "s", 0), (504, "a " * 20_000, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = op11_periodic_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(
        [contract(r[0], r[1]) for r in rows if r[0] != 504] + [long_row()], key=key)


def long_row():
    """Document 504: 20,000 equal words, one run; every word after the first goes."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (504, 1, 0, 20_000, 1, 20_000_000, sha("0,20000,1\n"), sha("a"))


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, runs string, collapsed string, _row string, _r int"
    assert periodic_runs(spark.createDataFrame([], schema), ["doc_id", "runs"]).count() == 0
    docs = spark.createDataFrame([(1, "x y " * 20, "mine", "too", "r", 3)], schema)
    row = periodic_runs(docs, docs.columns).first()
    assert row["_row"]["runs"] == "mine" and row["_row"]["_r"] == 3
    assert [tuple(r) for r in row["runs"]] == [(0, 40, 2)] and row["collapsed"] == "x y"
