"""Operator 3: host-level quality rules, in DataFrame functions only.

Every document gets base rules over its words and lines. Failures are counted by
host; a host's failure rate is shrunk towards the corpus rate with a beta prior
fitted to the hosts, and hosts above the limit are rejected together with all their
documents.

The prior comes from beta-binomial moments. Host rates weighted by documents spread
about the corpus rate m even if all hosts are alike, by m (1 - m) (hosts - 1) in the
sum of squares; only what is left beyond that sampling spread tells of differences
between hosts. Its share is the correlation r of two documents of one host, and the
prior counts as many documents as 1 / r - 1. Where nothing is left (or no host has
two documents) the hosts tell no prior and ``default_strength`` is used.

Null and blank texts have no words and fail the base rules. A null host is a host
of its own. Repeated rows count each. Texts of any length are read whole. An empty
table gives no rows. Kept columns come as struct ``_row``, so no name in them can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import GAP, WORD, let, stage, words_of

SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class HostRules:
    """Limits of the base rules and of the shrunk host rate."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_host_rate: float = 0.5
    # Documents that the prior counts for where the hosts do not tell, and its bounds where they do.
    default_strength: float = 20.0
    min_strength: float = 1.0
    max_strength: float = 1e6


def repeat_words(words: Column) -> Column:
    """Words lying in three-word windows that occur twice or more in the text.

    Windows are sorted by (hash, position); equal neighbours are confirmed word by
    word. A repeated window at p covers p..p+2, so each one adds what its predecessor
    has not covered.
    """

    def in_text(w: Column) -> Column:
        window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))
        windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))

        def covered(s: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                words_equal = [F.get(w, a["p"] + k) == F.get(w, b["p"] + k) for k in range(3)]
                return F.coalesce((a["h"] == b["h"]) & words_equal[0] & words_equal[1] & words_equal[2], F.lit(False))

            twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
            at = F.sort_array(F.transform(twice, lambda x: x["p"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
            add = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
            return F.aggregate(at, start, add, lambda acc: acc["n"])

        return F.when(F.size(w) >= 3, let(windows, covered)).otherwise(F.lit(0))

    return let(words, in_text).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    """The counts that the base rules read, each over the whole text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, f"{GAP}+", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words_of(text)),
    }


def base_failed(rules: HostRules) -> Column:
    few = F.col("n_words") < rules.min_words
    return few | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def prior_strength(hosts: int, documents: float, failures: float, squares: float, weighted: float, rules: HostRules) -> float:
    """Documents that the prior counts for, from sums over the hosts: of n, k, n squared, and k squared / n."""
    if hosts < 2 or not 0 < failures < documents:
        return rules.default_strength
    m = failures / documents
    spread = (weighted - documents * m * m) / (m * (1 - m))  # sum of n (k / n - m)^2, in units of m (1 - m)
    pairs = documents - squares / documents - (hosts - 1)  # what full correlation would add to the sampling spread
    r = (spread - (hosts - 1)) / pairs if pairs > 1e-9 else 0.0
    if r <= 1e-9:
        return rules.default_strength
    return min(max(1 / r - 1, rules.min_strength), rules.max_strength)


def host_verdicts(flagged: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """``host``, n, failures, shrunk_rate and rejected, one row per host."""
    hosts = stage(flagged.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures")), "hosts")
    n, k = F.col("n").cast("double"), F.col("failures").cast("double")
    fit = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failures").alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")).first()
    m = fit["k"] / fit["n"] if fit["n"] else 0.0
    strength = prior_strength(fit["hosts"], fit["n"] or 0, fit["k"] or 0, fit["nn"] or 0.0, fit["kk"] or 0.0, rules)
    shrunk = (k + m * strength) / (n + strength)
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("rejected", shrunk > rules.max_host_rate)


def host_rules(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text",
               rules: HostRules = HostRules()) -> DataFrame:
    """``keep`` columns of every row with the base counts, ``base_failed``, ``kept``, and the host's
    ``host_n``, ``host_failures`` and shrunk ``host_rate``.

    The counts are staged once; host statistics and the join read the staged rows.
    The host table's size is measured when it is written, so the planner broadcasts
    it only below its threshold and otherwise sort-merges, splitting hot hosts.
    Columns of ``docs`` that are not in ``keep`` are not carried.
    """
    counts = base_counts(F.col(text))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(host).alias("_host"),
                       *[c.alias(n) for n, c in counts.items()])
    flagged = stage(rows.withColumn("base_failed", base_failed(rules)), "rules")
    verdicts = host_verdicts(flagged, "_host", rules)
    verdicts = verdicts.select(F.col("_host").alias("_vhost"), F.col("n").alias("host_n"), F.col("failures").alias("host_failures"),
                               F.col("shrunk_rate").alias("host_rate"), "rejected")
    joined = flagged.join(verdicts, F.col("_host").eqNullSafe(F.col("_vhost")), "left")
    return joined.select("_row", *counts, "base_failed", "host_n", "host_failures", "host_rate", (~F.col("base_failed") & ~F.col("rejected")).alias("kept"))
