"""Host rules, shards, near-duplicates, mixing and quality scores against brute force."""

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import hilbert, host_rules, mixing, nbsvm, simhash
from ledgerline.llm.queries import (
    WEIGHTS,
    op3_host_rules,
    op5_hilbert_shards,
    op6_simhash_tiles,
    op8_min_cost_mix,
    op10_nbsvm_quality,
    quality_model,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_base_counts_and_verdicts(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents}
    rows = op3_host_rules(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept <= (not r.base_failed)


def test_base_counts_of_odd_rows(odd_docs, no_docs):
    rows = host_rules.host_rules(odd_docs, odd_docs.columns).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r["_row"].text)
    assert host_rules.host_rules(no_docs, ["doc_id"]).collect() == []


def test_a_bad_host_takes_its_documents_along_and_a_small_one_is_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [("good", good)] * 200 + [("bad", "few")] * 90 + [("bad", good)] * 10 + [("tiny", "few"), ("tiny", good)]
    docs = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = host_rules.host_rules(docs, ["source"]).groupBy("_row.source").agg({"kept": "max", "host_rate": "max"}).collect()
    kept = {r[0]: r["max(kept)"] for r in got}
    assert kept == {"good": True, "bad": False, "tiny": True}


def spread_of_hosts(rng, hosts, size, a, b):
    rates = rng.beta(a, b, hosts) if a else np.full(hosts, b)
    n = np.maximum(1, rng.poisson(size, hosts))
    return n, rng.binomial(n, rates)


def strength_of(n, k, rules=host_rules.HostRules()):
    n, k = n.astype(float), k.astype(float)
    return host_rules.prior_strength(len(n), n.sum(), k.sum(), (n * n).sum(), (k * k / n).sum(), rules)


def test_the_prior_finds_the_strength_that_the_hosts_were_drawn_with():
    rng = np.random.default_rng(7)
    for a, b in ((2.0, 8.0), (6.0, 24.0), (20.0, 80.0)):
        found = [strength_of(*spread_of_hosts(rng, 3000, size, a, b)) for size in (5, 40)]
        assert all(0.7 * (a + b) < s < 1.4 * (a + b) for s in found)


def test_hosts_that_only_differ_by_chance_tell_no_prior():
    rng, default = np.random.default_rng(3), host_rules.HostRules().default_strength
    n, k = spread_of_hosts(rng, 2000, 0, 0, 0.2)  # one document each
    assert (n == 1).all() and strength_of(n, k) == default
    alike = strength_of(*spread_of_hosts(rng, 2000, 30, 0, 0.2))
    assert alike == default or alike > 500
    assert strength_of(np.array([10]), np.array([3])) == default and strength_of(np.array([5, 5]), np.array([0, 0])) == default
    assert strength_of(np.array([50, 50]), np.array([50, 0])) == 1.0


def test_hilbert_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=dims)))
        order = cells[np.argsort(hilbert.hilbert_index(cells, bits))]
        assert sorted(hilbert.hilbert_index(cells, bits)) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, texts):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(16)]
    assert max(counts) - min(counts) <= 1


def test_shards(spark, sf_dir, documents, odd_docs, no_docs):
    check_shards(op5_hilbert_shards(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents])
    odd = hilbert.hilbert_shards(odd_docs, ["lang", "source", "size"]).collect()
    check_shards(odd, [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert hilbert.hilbert_shards(no_docs, ["lang", "size"]).collect() == []


def test_an_outlying_string_does_not_merge_the_others(spark):
    rows = [(i, f"www.example{i % 640:04d}.com") for i in range(3200)] + [(9000, "a.com"), (9001, None)]
    docs = spark.createDataFrame([(i, "t", s) for i, s in rows], "doc_id long, text string, source string")
    got = hilbert.hilbert_shards(docs, ["source"]).collect()
    assert len(got) == len(rows) and len({r.curve for r in got}) >= 48
    spans = {}
    for r in got:
        spans.setdefault(r.shard, set()).add(r.source or "")
    assert all(len(s) <= 80 for s in spans.values())  # 16 shards over 640 hosts, in cells of ten


def test_a_row_repeated_thousands_of_times_is_cut_like_any_run(spark):
    docs = spark.createDataFrame([(7, "same", "s")] * 4000 + [(i, f"t{i}", "o") for i in range(500)], "doc_id long, text string, source string")
    got = hilbert.hilbert_shards(docs.repartition(4), ["source", "size"])
    check_shards(got.collect(), [(7, "same")] * 4000 + [(i, f"t{i}") for i in range(500)])


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable over links of 4 bits or fewer; ids may be None."""
    values = np.array([p for _, p in prints], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(prints))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            break
        label = new
    least = {}
    for (key, _), c in zip(prints, label.tolist()):
        if key is not None:
            least[c] = min(least.get(c, key), key)
    return [(key, least.get(c)) for (key, _), c in zip(prints, label.tolist())]


def test_fingerprints_and_components(spark, sf_dir, documents, odd_docs, no_docs):
    rows = op6_simhash_tiles(spark, sf_dir).collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in documents]
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == dict(prints)
    assert {r.doc_id: r.component_id for r in rows} == dict(brute_components(prints))

    odd = simhash.near_duplicates(odd_docs, ["doc_id"]).collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in odd_docs.collect()]
    assert Counter((r["_id"], r.component_id) for r in odd) == Counter(brute_components(prints))
    assert simhash.near_duplicates(no_docs, ["doc_id"]).collect() == []


def test_one_document_of_each_component_stays(odd_docs):
    found = simhash.near_duplicates(odd_docs, ["doc_id"])
    kept = simhash.keep_one(odd_docs, odd_docs.columns)
    assert kept.columns == odd_docs.columns
    assert kept.count() == found.select("root").distinct().count()


def test_tiles_lose_no_link_in_dense_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(120):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            values.add(c ^ sum(1 << int(b) for b in flips))
    values |= set(rng.integers(0, 1 << 63, 800, dtype=np.uint64).tolist())
    prints = sorted(values)
    monkeypatch.setattr(simhash, "TILE_ROWS", 50)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(frame, 4)
    assert edges.count() < 42 * len(prints)
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in edges.collect())
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    by_position = brute_components(list(enumerate(prints)))
    groups, want = {}, {}
    for i, c in by_position:
        groups.setdefault(got.get(signed[i], signed[i]), set()).add(i)
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_chains_become_one_component(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0] and 5 in got


def test_targets_reshare_what_exceeds_a_cap():
    got = mixing.targets([10, 100, 1000, 0], [5, 2, 1, 5], 1110, 3)
    assert got[0] == 30 and got[1] == 300 and got[3] == 0 and abs(sum(got) - 1110) < 1e-9


def test_flow_spreads_repeats_before_repeating_more():
    quota = {"a": 150, "b": 100}
    taken = mixing.route([(("a",), 40), (("a", "b"), 100), (("b",), 60)], quota, 3)
    assert sum(taken) == 250
    best = min((c for c in product(range(0, 121, 10), range(0, 301, 10), range(0, 181, 10))
                if sum(c) == 250 and c[0] <= 150 and c[2] <= 100),
               key=lambda c: sum(cost(x, n) for x, n in zip(c, (40, 100, 60))))
    assert sum(cost(x, n) for x, n in zip(taken, (40, 100, 60))) <= sum(cost(x, n) for x, n in zip(best, (40, 100, 60)))


def cost(taken, size):
    return sum(r * r * min(size, max(0, taken - (r - 1) * size)) for r in (1, 2, 3))


def levelled(sizes, weights, total, cap):
    """Targets by another way: the level at which all sources, each filled to its weight times the level or its cap, hold the total."""
    low, high = 0.0, 2 * total
    for _ in range(200):
        level = (low + high) / 2
        held = sum(min(cap * n, level * w) for n, w in zip(sizes, weights))
        low, high = (level, high) if held < total else (low, level)
    return [min(cap * n, high * w) for n, w in zip(sizes, weights)]


def test_targets_equal_a_common_level():
    rng = np.random.default_rng(2)
    for _ in range(300):
        sizes = [int(n) for n in rng.integers(0, 2000, rng.integers(1, 9))]
        weights = [WEIGHTS[i % 3] for i in range(len(sizes))]
        total = float(sum(sizes)) * rng.choice([0.2, 1.0, 2.0])
        assert np.allclose(mixing.targets(sizes, weights, total, 3), levelled(sizes, weights, total, 3), atol=1e-6)


def test_mix_meets_its_targets_and_agrees_with_a_rerun(spark):
    sf_dir = "/root/testdata/sf0.01"  # fifty documents a source: whole documents come near a target
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = op8_min_cost_mix(spark, sf_dir).collect()
    sizes = {r.doc_id: len(WORDS.findall(r.text or "")) for r in documents}
    source = {r.doc_id: r.source for r in documents}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    totals = Counter()
    for k, s in source.items():
        totals[s] += sizes[k]
    want = dict(zip(names, levelled([totals[s] for s in names], [WEIGHTS[i % 3] for i in range(len(names))], sum(totals.values()), 3)))
    taken = Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == totals[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in names)
    again = {r.doc_id: r.taken for r in op8_min_cost_mix(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_of_odd_rows_and_of_overlapping_sources(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs, odd_docs.columns, WEIGHTS).collect()
    assert len(rows) == odd_docs.count() and all(r.taken == r.epochs * r["size"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(no_docs, ["doc_id"], WEIGHTS).collect() == []
    both = [(i, ["a"] if i % 3 == 0 else ["b", "a"] if i % 3 == 1 else ["b"], "w " * 20) for i in range(90)]
    docs = spark.createDataFrame(both, "doc_id long, source array<string>, text string")
    got = mixing.mix(docs, ["doc_id", "source"], [2.0, 1.0]).collect()
    assert abs(sum(r.taken for r in got) - 1800) <= 60
    only_b = sum(r.taken for r in got if r["_row"].source == ["b"])
    assert only_b <= 600 + 20  # source b's quota is 600 words


def test_mix_fills_the_gap_before_a_document_of_a_third_or_more_of_its_source(spark):
    rows = [(1000 * s + i, f"s{s:02d}", "w " * (4500 if i == 0 and s % 2 else 2400 if i == 0 else 30)) for s in range(24) for i in range(151)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = mixing.mix(docs, ["doc_id", "source"], [1.0], total_share=0.5).collect()
    taken, target, smallest = Counter(), {}, {}
    for r in got:
        s = r["_row"].source
        taken[s], target[s] = taken[s] + r.taken, r.target
        assert r.epochs in (0, 1, 2, 3) and r.taken == r.epochs * r["size"]
    for r in got:
        if not r.epochs:
            smallest[r["_row"].source] = min(smallest.get(r["_row"].source, r["size"]), r["size"])
    assert len(got) == len(rows) and len(target) == 24
    assert all(0 <= round(target[s]) - taken[s] < smallest.get(s, 30) for s in target)
    assert sum(taken.values()) >= 0.99 * sum(target.values())


def test_mix_passes_go_on_until_no_row_fits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FILL_ROWS", 1)
    rows = [(i, "s", "w " * (1 + i * i % 97)) for i in range(300)] + [(300, "s", "w " * 9000)] + [(301, "s", "w w w")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = mixing.mix(docs, ["doc_id"], [1.0], total_share=0.4).collect()
    left = round(got[0].target) - sum(r.taken for r in got)
    assert len(got) == len(rows) and 0 <= left < min(r["size"] for r in got if not r.epochs)


def test_quality_scores(spark, sf_dir, documents, odd_docs, no_docs):
    rows = op10_nbsvm_quality(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in documents} and len(rows) == len(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)

    model = quality_model(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    odd = nbsvm.score(odd_docs, model, odd_docs.columns).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert nbsvm.score(no_docs, model, ["doc_id"]).collect() == []


def test_a_fit_without_both_classes_scores_one_half(spark, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = nbsvm.train(no_docs, none, "quality")
    assert model.score(nbsvm.Features().ids("some text")) == 0.5


def test_the_fit_equals_one_by_another_solver():
    """Dense vectors, the ratio of the two class profiles, and the dual problem by projected gradients."""
    rng = np.random.default_rng(4)
    grams, rows, y = 30, [], []
    for i in range(40):
        good = i % 2
        p = np.where(np.arange(grams) % 2 == good, 0.35, 0.25)
        rows.append(np.flatnonzero(rng.random(grams) < p))
        y.append(good)
    params = nbsvm.NbSvmParams(epochs=4000)
    model = nbsvm.fit(rows, y, params)

    sign = np.where(np.array(y) == 1, 1.0, -1.0)
    has = np.zeros((40, grams))
    for i, ids in enumerate(rows):
        has[i, ids] = 1
    whole = nbsvm.DIM * params.alpha  # every feature is smoothed, also those that no row has
    profile = [(params.alpha + has[sign == s].sum(0)) / (whole + has[sign == s].sum()) for s in (1.0, -1.0)]
    x = has * np.log(profile[0] / profile[1])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    x = np.hstack([x, np.ones((40, 1))])
    gram = (x * sign[:, None]) @ (x * sign[:, None]).T
    dual, step = np.zeros(40), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60_000):
        dual = np.clip(dual - step * (gram @ dual - 1), 0, params.cost)
    margins = x @ (x.T @ (dual * sign))
    found = [np.log(s / (1 - s)) / params.slope for s in map(model.score, rows)]
    assert np.abs(margins - found).max() < 1e-3


def test_of_several_texts_of_an_id_one_is_always_taken(spark):
    rows = [(i, f"good words number {i}" if i % 2 else f"BAD $$$ {i}") for i in range(40)] + [(i, f"other text {j} of {i}") for i in range(10) for j in range(3)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, again = (nbsvm.train(d, marks, "quality") for d in (docs.repartition(3), docs.orderBy(F.desc("text")).repartition(5)))
    assert np.array_equal(first.weight, again.weight) and first.bias == again.bias


def test_dual_coordinate_descent_separates_a_separable_set():
    rows = [np.array([1, 2, 3]), np.array([1, 2, 4]), np.array([5, 6, 3]), np.array([5, 7, 4])] * 5
    model = nbsvm.fit(rows, [1, 1, 0, 0] * 5, nbsvm.NbSvmParams())
    assert [model.score(r) > 0.5 for r in rows[:4]] == [True, True, False, False]
