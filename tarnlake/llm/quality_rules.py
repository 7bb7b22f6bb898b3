"""Quality rules that vote or abstain, their accuracies by expectation-maximisation; DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import words
from tarnlake.session import reliable_checkpoint

#: Name, measure, and its bounds: (good from, good to), (bad below, bad above); between them a rule abstains.
RULES = (
    ("word_length", "word_chars / n_words", (3.0, 9.0), (1.5, 15.0)),
    ("symbols", "n_symbols / n_words", (None, 0.05), (None, 0.30)),
    ("repeated_words", "n_repeat_words / n_words", (None, 0.20), (None, 0.50)),
    ("repeated_lines", "n_dup_lines / n_lines", (None, 0.10), (None, 0.40)),
    ("capitals", "n_capitals / word_chars", (None, 0.10), (None, 0.50)),
    ("sentences", "n_ends / n_words", (0.02, 0.60), (0.002, None)),
    ("length", "n_words", (100.0, None), (50.0, None)),
)
#: What is believed before any document is seen: most are good, rules mostly right. Counted as so many rows.
PRIOR_GOOD, PRIOR_RIGHT, PRIOR_ROWS = 0.85, 0.85, 100.0
ROUNDS = 25
SETTLED = 1e-6


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules look at, in one pass over each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("_t"), words(text).alias("_w"))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    three = F.when(
        F.col("n_words") >= 3,
        F.transform(
            F.sequence(F.lit(1), F.col("n_words").cast("int") - 2),
            lambda i: F.xxhash64(F.element_at("_w", i), F.element_at("_w", i + 1), F.element_at("_w", i + 2)),
        ),
    )
    df = df.withColumn("_h", three)
    # Most texts repeat no window, which a set of the hashes tells. Only the others sort them.
    twice = F.coalesce(F.size(F.array_distinct("_h")) < F.size("_h"), F.lit(False))
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(twice, placed))
    starts = F.expr(
        "transform(filter(_s, (x, k) -> (k > 0 and _s[k - 1].h = x.h) or (k < size(_s) - 1 and _s[k + 1].h = x.h)), x -> x.i)"
    )
    # A window covers three words; a word counts with the first repeated window that covers it.
    df = df.withColumn("_r", F.when(F.col("_s").isNotNull(), F.sort_array(starts)))
    covered = F.expr("aggregate(_r, struct(0L as n, -3 as last), (a, i) -> struct(a.n + least(3, i - a.last) as n, i as last), a -> a.n)")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("long")
    return df.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        count(r"\p{Lu}").alias("n_capitals"),
        count(r"[.?!](?=[\x20\x09-\x0D]|$)").alias("n_ends"),
    )


def _vote(measure: str, good: tuple, bad: tuple) -> Column:
    """1 good, -1 bad, 0 abstains; a measure that cannot be taken (no words) abstains."""
    value = F.expr(f"cast({measure.split(' / ')[0]} as double)" + (f" / nullif({measure.split(' / ')[1]}, 0)" if "/" in measure else ""))
    always = F.lit(True)
    fine = reduce(lambda a, b: a & b, [value >= good[0] if good[0] is not None else always, value <= good[1] if good[1] is not None else always])
    never = F.lit(False)
    poor = reduce(lambda a, b: a | b, [value < bad[0] if bad[0] is not None else never, value > bad[1] if bad[1] is not None else never])
    return F.when(poor, -1).when(fine, 1).otherwise(0)


def _log_odds(rules, good: float, rates: dict) -> Column:
    """Log odds of a good document given its votes."""
    total = F.lit(math.log(good / (1 - good)))
    for name, *_ in rules:
        column = F.col(f"v_{name}")
        for vote in (1, -1, 0):
            p, q = rates[name, vote]
            total = total + F.when(column == vote, math.log(p / q)).otherwise(0.0)
    return total


def learn(patterns: DataFrame, rules=RULES) -> tuple[float, dict]:
    """Share of good documents, and each rule's chance of each vote on good and on bad ones.

    ``patterns`` has a row per distinct combination of votes, with ``n``: at most 3 ** len(rules) rows.
    Each round weighs the patterns by the posterior and counts votes anew, in one aggregate.
    """
    names = [r[0] for r in rules]
    good = PRIOR_GOOD
    right, wrong = PRIOR_RIGHT * 0.8, (1 - PRIOR_RIGHT) * 0.8
    start = {(n, v): {1: (right, wrong), -1: (wrong, right), 0: (0.2, 0.2)}[v] for n in names for v in (1, -1, 0)}
    rates = dict(start)
    for _ in range(ROUNDS):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(rules, good, rates)))
        weighed = patterns.withColumn("_g", p * F.col("n")).withColumn("_b", (F.lit(1.0) - p) * F.col("n"))
        sums = [F.coalesce(F.sum(c), F.lit(0.0)) for c in ("_g", "_b")]
        for n in names:
            for v in (1, -1, 0):
                hit = F.col(f"v_{n}") == v
                sums += [F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0.0)) for c in ("_g", "_b")]
        g, b, *votes = weighed.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)]).first()
        last, good = good, (g + PRIOR_GOOD * PRIOR_ROWS) / (g + b + PRIOR_ROWS)
        for k, key in enumerate(start):
            p0, q0 = start[key]
            rates[key] = (
                (votes[2 * k] + p0 * PRIOR_ROWS) / (g + PRIOR_ROWS), (votes[2 * k + 1] + q0 * PRIOR_ROWS) / (b + PRIOR_ROWS)
            )
        if abs(last - good) < SETTLED:
            break
    return good, rates


def judge(docs: DataFrame, rules=RULES, at_least: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, posterior (that the document is good) and kept.

    A null or empty text has no words: its measures are 0, base_failed is true. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    df = measures(docs)
    for name, measure, good, bad in rules:
        df = df.withColumn(f"v_{name}", _vote(measure, good, bad))
    df = reliable_checkpoint(df)  # a few numbers per document; the texts are read once
    votes = [f"v_{r[0]}" for r in rules]
    patterns = reliable_checkpoint(df.groupBy(*votes).agg(F.count("*").alias("n")))
    good, rates = learn(patterns, rules)
    posterior = F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(rules, good, rates)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed).withColumn("posterior", posterior)
    return df.withColumn("kept", ~failed & (F.col("posterior") >= at_least)).drop(*votes)
