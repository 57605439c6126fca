"""Base rules against plain patterns, message passing against enumeration, and what the field adds."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from ledgerline.llm import skip_chain
from ledgerline.llm.queries import op12_skip_chain_pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def contract(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                  12 <= len(digits) <= 19 and checksum(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "x@y.de", "1", "22", "255", "256", ".", "-", " ", "+", "+1 (509) 555-6973", "4539578763621486", "é", "(", ")", "_", "%", "\n",
             "4539 5787 6362 1486", "10.20.30.40", "007"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert skip_chain.base_spans(text) == contract(text), text


def test_base_rules_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "a@" * 200_000, "+1 " * 100_000, "1." * 200_000, "+" * 400_000):
        began = time.process_time()
        skip_chain.base_spans(text)
        assert time.process_time() - began < 5


def test_beliefs_equal_enumeration_on_trees():
    rng = np.random.default_rng(3)
    n = 5
    edges = np.array([(0, 1, 0), (1, 2, 0), (0, 3, 1), (3, 4, 2)])
    weights = skip_chain.Weights(rng.normal(size=(skip_chain.FEATURES + 1, 5)), rng.normal(size=(3, 5, 5)))
    field = skip_chain.Field(np.zeros((n, 2), int), np.arange(n), rng.integers(0, skip_chain.FEATURES, (n, 4)), np.array([0, 0, 3, 0, 0]), edges)
    held = field.label > 0
    own, pair = weights.node[field.features].sum(axis=1), weights.potentials()
    exact = np.zeros((n, 5))
    for labels in itertools.product(range(5), repeat=n):
        if labels[2] == 3:
            p = np.exp(sum(own[i, y] for i, y in enumerate(labels)) + sum(pair[k, labels[a], labels[b]] for a, b, k in edges))
            exact[np.arange(n), labels] += p
    exact /= exact.sum(axis=1, keepdims=True)
    assert np.abs(skip_chain.beliefs(field, weights, held, 60) - exact).max() < 1e-2


def number(rng):
    while True:
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        if checksum(digits):
            return digits


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(300):
        some = [f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}", number(rng), f"{word()}.{word()}@{word()}.org",
                ".".join(str(rng.randint(0, 255)) for _ in range(4)), f"{rng.randint(1, 9)}.0", f"{rng.randint(1900, 2030)}", number(rng)[::-1] + "7"]
        body = [word() for _ in range(40)]
        for x in rng.sample(some, 3):
            for _ in range(rng.randint(1, 2)):
                body.insert(rng.randrange(len(body)), x)
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, skip_chain.train(docs)


def test_nodes_are_labelled_like_the_rules_without_them(training):
    """Held-out texts, nothing held: the field alone finds what the rules find."""
    rows, weights = training
    hits = total = 0
    for _, text in rows[::3]:
        field = skip_chain.field_of(text, skip_chain.base_spans(text))
        p = skip_chain.beliefs(field, weights, np.zeros(len(field.label), bool), 20)
        hits += int((p.argmax(axis=1) == field.label).sum())
        total += len(field.label)
    assert hits / total > 0.95


def shown(text, weights):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in skip_chain.spans_of([text], weights)[0] if not s["base"]]


def test_repeats_of_an_entity_are_added_and_nothing_else(training):
    _, weights = training
    assert shown("call +1 (509) 555-6973 now, or ask (509) 555-6973 later", weights) == [("phone", "(509) 555-6973")]
    assert shown("call +1 (509) 555-6973 now in 2024 at 3.0 or (999) 555-1111 later", weights) == []
    assert shown("only (509) 555-6973 and (509) 555-6973", weights) == []  # no base span to resemble
    one, two = number(random.Random(1)), number(random.Random(2))
    assert shown(f"card {one} and {two} , then {one} {two} at once", weights) == [("card", one), ("card", two)]
    many = " ".join(["x +1 (509) 555-6973", *["y (509) 555-6973"] * 300])
    assert len(shown(many, weights)) == 300


def test_query_and_odd_rows(spark, tmp_path, training):
    texts = [t for _, t in training[0][:60]] + [None, "", " \n", "é +1 (509) 555-6973 日本 x@y.de", "plain words only", "1" * 5000 + "@" + "a" * 5000 + ".b",
                                              "0007.1.2.3 " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_skip_chain_pii(spark, str(tmp_path)).collect()
    kinds = skip_chain.KINDS
    want = sorted(((d, *[sum(k == j for _, k, _ in contract(t)) for j in range(4)],
                    hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in contract(t)).encode()).hexdigest()) for d, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        if r.doc_id is not None:
            assert {f"{kinds[k]}:{s}:{e}" for s, k, e in contract(texts[r.doc_id])} <= set(r.spans.split(","))


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id long, text string, spans string, _row string"
    empty = spark.createDataFrame([], schema)
    weights = skip_chain.train(empty)
    assert not weights.node.any() and skip_chain.personal_data(empty, weights, ["doc_id"]).count() == 0
    row = skip_chain.personal_data(spark.createDataFrame([(1, "a@b.c", "mine", "r")], schema), weights, ["spans", "_row"]).first()
    assert row["_row"]["spans"] == "mine" and [(s.kind, s.start, s.end, s.base) for s in row.spans] == [("email", 0, 5, True)]
