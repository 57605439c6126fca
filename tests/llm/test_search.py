"""Ranked search against the score written out for every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm.bitslices import SignatureParams, build_block, search, terms_of, upper_bounds
from ledgerline.llm import bitslices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    split = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(1 for _, t in split if t), sum(len(t) for _, t in split)
    df = Counter(x for _, t in split for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for d, t in split:
            tf, score = Counter(t), 0
            for x in terms(text):
                if tf[x]:
                    m = 100 - 25 + (25 * len(t) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d, score))
        out += [(item, r + 1, x[3], x[4]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def random_text(rng, n):
    return " ".join(rng.choice("abcdefgh") + str(int(rng.paretovariate(0.7)) % 400) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    docs = [(i, random_text(rng, rng.choice([3, 20, 80, 300]))) for i in range(400)]
    docs += [(i, docs[5][1]) for i in (900, 901, 902)] + [docs[7], (None, docs[5][1]), (None, docs[9][1])]
    docs += [(950, None), (951, ""), (952, " ;\n-"), (953, "É é É日本 A_b"), (954, docs[5][1] * 60)]
    items = [(i, random_text(rng, rng.choice([1, 5, 30]))) for i in range(12)]
    items += [(50, docs[5][1]), (51, None), (52, "?"), (53, "zzz unknown"), (54, "É日本 é"), (0, docs[9][1])]
    return docs, items


def ask(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    i = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, rank int")
    return sorted(map(tuple, search(d, i, **kw).collect()), key=lambda r: (r[0], r[1], r[3]))


@pytest.mark.parametrize("params", [SignatureParams(block_rows=64), SignatureParams(block_rows=32, hashes=1, broadcast_rows=0),
                                    SignatureParams(item_bytes=300)])
def test_ranks_equal_the_scores_of_all_documents(spark, corpus, params):
    docs, items = corpus
    assert ask(spark, docs, items, k=20, params=params) == sorted(brute(docs, items, 20), key=lambda r: (r[0], r[1], r[3]))


def test_ties_beyond_k_and_few_documents(spark):
    docs = [(i, "same words here") for i in range(30)] + [(99, "other text")]
    assert ask(spark, docs, [(1, "same"), (2, "words other")], k=20) == brute(docs, [(1, "same"), (2, "words other")], 20)
    assert [r[2] for r in ask(spark, docs + [(200 + i, "more") for i in range(90)], [(1, "Same")], k=20)] == list(range(20))
    assert [r[1:3] for r in ask(spark, docs, [(1, "other")], k=20)] == [(1, 99)]


def test_without_documents_or_items(spark, corpus):
    docs, items = corpus
    assert ask(spark, [], items) == [] and ask(spark, docs, []) == []


def test_terms():
    for t in ("A_b-C9 é\x7fÉ{}x", "日本　語 ½a\x00b", "", None):
        assert [x.decode() for x in terms_of(t)] == terms(t)


def test_bounds_are_never_below_the_score_and_levels_tighten_them():
    rng = random.Random(8)
    texts = [random_text(rng, rng.choice([10, 100, 400])) for _ in range(200)]
    split = [terms_of(t) for t in texts]
    n_terms, df = sum(map(len, split)), Counter(x for t in split for x in set(t))
    asked = bitslices._queries([random_text(rng, 20) for _ in range(10)], len(texts), n_terms, df)
    exact = {1: 0, 8: 0}
    for hashes in exact:
        params = SignatureParams(hashes=hashes)
        rows, lengths, bits = build_block(texts, params)
        for (of, weights), bound in zip(asked.items, upper_bounds(asked, rows, lengths, bits, hashes)):
            names = [asked.terms[j] for j in of]
            m = bitslices.length_norm(lengths, len(texts), n_terms)
            score = np.array([sum(int(w) * int(bitslices._gain(Counter(t)[x], m[d])) for x, w in zip(names, weights)) for d, t in enumerate(split)])
            assert (bound >= score).all()
            exact[hashes] += int(bound.sum() - score.sum())
    assert exact[8] < exact[1]
