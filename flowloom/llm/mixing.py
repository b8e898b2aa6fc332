"""Soft-membership mixing of documents to target domain weights.

A naive Bayes classifier on the presence of words, learned from labelled
documents, gives each document posteriors over the domains. Nonnegative document rates are then fitted so that
the expected tokens of each domain, summed over rate * tokens * posterior, match
the targets in the (weighted) least-squares sense: accelerated projected gradient
steps in the metric weighted by tokens, starting from rate 1. A step needs one sum per
domain over all documents and updates each document on its own.

All of it is DataFrame operations. The classifier is fitted on all labelled
rows and uses every word that stands out, the rates are fitted on all documents.

Edge cases: rows of one key are one document, their tokens add up; a null key
takes no part; a text without words has 0 tokens; labels whose
domain is null or unknown are not used, of several labels of a key the smallest
domain counts; without labels all posteriors are equal. A target for a
domain that no document has is missed, the others are still matched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored

#: Most words of the classifier: all that stand out.
WORDS = None
#: Tables of labels and of words up to this size are sent to all tasks; larger ones are joined by a shuffle.
SMALL_ROWS = 500_000
SMOOTH = 1.0
LEAST_Z = 3.0
STEPS, UNROLLED = 60, 6
TOLERANCE = 1e-3
#: Exclamation marks are words of their own.
BETWEEN = r"[\s.,;:?()\"']+|(?<=[^!])(?=!)"


def words_of(text: str) -> Column:
    lowered = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def small(table: DataFrame) -> DataFrame:
    """The stored table, broadcast if it has few rows; the rows of a join are the same either way."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table


def learn_words(
    docs: DataFrame, labels: DataFrame, domains: list[str], key: str, text: str, domain: str
) -> tuple[DataFrame, list[float]]:
    """What each word adds to a domain's log odds, and the logs of a document without any."""
    known = (
        labels.filter(F.col(domain).isin(*domains) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(F.min(domain).alias("domain"))
    )
    # Words are split behind the join, of labelled rows only.
    known = small(stored(known, "labels"))
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(known, "k")
    each = labelled.select("domain", F.explode(F.array_distinct(words_of("text"))).alias("word"))
    n = range(len(domains))
    counts = each.groupBy("word").agg(
        *[F.sum((F.col("domain") == d).cast("bigint")).alias(f"c{i}") for i, d in enumerate(domains)]
    )
    rows = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    size = [float(rows.get(d, 0)) for d in domains]
    seen = sum(size)
    share = sum(F.col(f"c{i}") for i in n) / F.lit(max(1.0, seen))
    lifts, logs, without = [], [], []
    for i in n:
        expected = share * F.lit(size[i])
        lifts.append(F.abs(F.col(f"c{i}") - expected) / F.sqrt(expected + F.lit(1.0)))
        held = (F.col(f"c{i}") + F.lit(SMOOTH) * share) / F.lit(size[i] + SMOOTH)
        held = F.least(held, F.lit(1.0 - 1e-6))
        logs.append((F.ln(held) - F.ln(1.0 - held)).alias(f"w{i}"))
        without.append(F.ln(1.0 - held).alias(f"a{i}"))
    # Words that stand out in no domain would only add noise.
    lift = F.greatest(*lifts) if len(lifts) > 1 else lifts[0]
    table = stored(counts.filter(lift >= LEAST_Z).select("word", *logs, *without), "weights")
    absent = table.agg(*[F.coalesce(F.sum(f"a{i}"), F.lit(0.0)) for i in n]).first()
    starts = [math.log((s + 1) / (seen + len(domains))) + float(a) for s, a in zip(size, absent, strict=True)]
    return table.select("word", *[f"w{i}" for i in n]), starts


def posteriors(
    docs: DataFrame, weights: DataFrame, starts: list[float], key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (k, tokens, p0, p1, ...): tokens and domain posteriors of each document."""
    words = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), words_of(text).alias("words"))
    each = words.select(
        "k", F.size("words").alias("size"), F.posexplode_outer(F.array_distinct("words")).alias("at", "word")
    )
    n = range(len(starts))
    logs = (
        each.join(small(weights), "word", "left")
        .groupBy("k")
        .agg(
            F.coalesce(F.sum(F.when(F.col("at") == 0, F.col("size"))), F.lit(0)).alias("tokens"),
            *[F.sum(f"w{i}").alias(f"l{i}") for i in n],
        )
        .select("k", "tokens", *[(F.coalesce(f"l{i}", F.lit(0.0)) + F.lit(starts[i])).alias(f"l{i}") for i in n])
    )
    top = F.greatest(*[F.col(f"l{i}") for i in n]) if len(starts) > 1 else F.col("l0")
    raised = logs.withColumn("top", top).select(
        "k", "tokens", *[F.exp(F.col(f"l{i}") - F.col("top")).alias(f"e{i}") for i in n]
    )
    total = sum(F.col(f"e{i}") for i in n)
    return raised.select("k", "tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in n])


def _sums(table: DataFrame, rate: Column, n: int) -> list[float]:
    row = table.agg(
        *[F.coalesce(F.sum(F.col("tokens") * F.col(f"p{i}") * rate), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    ).first()
    return [float(x) for x in row]


def fit_rates(table: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """Add the column rate to a table of tokens and posteriors.

    ``targets`` are tokens per domain. Gaps are weighted by the inverse of the
    matrix of token-weighted posterior products, one number per pair of domains,
    so that small domains close as fast as large ones and a step of 1 is safe.
    Stops when all sums are within ``TOLERANCE`` of the total, or no longer move.
    """
    n = len(targets)
    gram = table.agg(
        *[
            F.coalesce(F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)).alias(f"g{i}_{j}")
            for i in range(n)
            for j in range(n)
        ]
    ).first()
    weight = np.linalg.pinv(np.array(gram, dtype=float).reshape(n, n), rcond=1e-9, hermitian=True)
    scale = max(1.0, sum(targets))
    now = table.withColumns({"rate": F.lit(1.0), "last": F.lit(1.0)})
    momentum, before, still = 1.0, math.inf, 0
    for step in range(steps):
        following = (1.0 + math.sqrt(1.0 + 4.0 * momentum * momentum)) / 2.0
        ahead = F.col("rate") + F.lit((momentum - 1.0) / following) * (F.col("rate") - F.col("last"))
        now = now.withColumn("ahead", ahead)
        gaps = np.array(_sums(now, F.col("ahead"), n)) - np.array(targets)
        descent = weight @ gaps
        loss = float(gaps @ descent)
        if np.abs(gaps).max() < TOLERANCE * scale:
            now = now.withColumn("rate", F.greatest(F.lit(0.0), F.col("ahead")))
            break
        moved = F.col("ahead") - sum(F.col(f"p{i}") * F.lit(float(d)) for i, d in enumerate(descent))
        now = now.withColumn("last", F.col("rate")).withColumn("rate", F.greatest(F.lit(0.0), moved))
        if (step + 1) % UNROLLED == 0:
            now = stored(now.drop("ahead"), "rates")
        # The momentum starts anew where it overshoots.
        momentum = following if loss <= before else 1.0
        still = still + 1 if abs(before - loss) <= 1e-6 * loss else 0
        before = loss
        if still >= 4:
            break
    return now.drop("ahead", "last")


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    key: str = "doc_id",
    text: str = "text",
    domain: str = "domain",
    row: str | None = None,
) -> DataFrame:
    """Rows (key, tokens, p_<domain>..., rate) for every document with a key.

    ``row`` names a column that tells rows apart where keys may be null or repeat;
    it takes the key's place in the result, and labels still go by the key.

    ``targets`` are the wanted shares of the tokens of all documents; they are
    scaled to a sum of 1.
    """
    domains = list(targets)
    weights, starts = learn_words(docs, labels, domains, key, text, domain)
    table = stored(posteriors(docs, weights, starts, row or key, text), "posteriors")
    total = table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    whole = sum(targets.values())
    rated = fit_rates(table, [float(total) * t / whole for t in targets.values()])
    names = [F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)]
    return rated.select(F.col("k").alias(row or key), "tokens", *names, "rate")
