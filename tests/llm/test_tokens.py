"""Token counts and packing against the tokenizer library and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import packing, token_counts
from ledgerline.llm.bpe import CHUNK_CHARS, load
from ledgerline.llm.queries import op1_sum_of_squares_packing, op4_prefix_token_counts, vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_strings(n):
    rng = random.Random(4)
    letters = list("ab 'strevlmd\n\t\xa0é1२!#　日🎉") + ["<|endoftext|>", "'re", "  "]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_every_prefix_equal_the_library(library):
    bpe = load(vocabulary())
    strings = odd_strings(800)
    assert [list(x) for x in bpe.encode(strings)] == [ids_of(library, s) for s in strings]
    for s, counts in zip(strings[:300], bpe.counts(strings[:300])):
        assert list(counts) == [len(ids_of(library, s[: i + 1])) for i in range(len(s))], s


def test_long_texts_are_cut_into_chunks_without_a_change(library):
    rng = random.Random(1)
    text = "".join(rng.choice(["the ", "a  b", "\n", "don't "]) for _ in range(CHUNK_CHARS // 2))
    bpe = load(vocabulary())
    assert len(list(bpe.pieces(text))) > 1
    assert list(bpe.encode([text])[0]) == ids_of(library, text)
    assert int(bpe.counts([text])[0][-1]) == len(ids_of(library, text))


def test_counts_query_over_documents(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_prefix_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids_of(library, texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), len(want), len(want) > 512)
        assert len(ids_of(library, (texts[r.doc_id] or "")[: r.fits_512])) <= 512


def test_counts_of_odd_rows(odd_docs, no_docs, library):
    got = token_counts.token_counts(odd_docs, vocabulary(), [3], with_prefixes=True).collect()
    assert len(got) == odd_docs.count()
    texts = Counter((r.doc_id, len(ids_of(library, r.text))) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in got) == texts
    assert all((r.prefix_counts or [0])[-1] == r.n_tokens for r in got)
    assert token_counts.token_counts(no_docs, vocabulary(), [3]).collect() == []


def check_packing(pieces, texts, library):
    """Every row's ids lie in exactly one piece each; sequences are gapless and within capacity."""
    want = Counter()
    for key, text in texts:
        ids = ids_of(library, text) + [0]
        for at in range(0, len(ids), 1024):
            raw = np.array(ids[at : at + 1024], "<u4").tobytes()
            want[key, at, len(raw) // 4, zlib.crc32(raw), len(ids)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_packing_query_over_documents(spark, sf_dir, library):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(op1_sum_of_squares_packing(spark, sf_dir).collect(), texts, library)


def test_packing_of_odd_rows_and_its_ids(odd_docs, no_docs, library):
    pieces = packing.pack(odd_docs, vocabulary(), with_ids=True).collect()
    check_packing(pieces, [(r.doc_id, r.text) for r in odd_docs.collect()], library)
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)
    assert packing.pack(no_docs, vocabulary()).collect() == []


def test_a_piece_goes_where_the_sum_of_squares_is_least():
    rng = np.random.default_rng(2)
    levels = packing.LevelArray(9)
    for size in rng.integers(1, 10, 2000).tolist():
        n = levels.count[:9].copy()
        best = []
        for h in [0] + [h for h in range(1, 9) if n[h]]:
            if h + size <= 9:
                m = n.copy()
                m[h] -= h > 0
                if 0 < h + size < 9:
                    m[h + size] += 1
                best.append(int((m[1:] ** 2).sum()))
        levels.place(size)
        assert int((levels.count[1:9] ** 2).sum()) == min(best)
