"""License scan: places of short phrases, and an exact set-similarity join of text blocks with notice templates.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import saved

# Phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# The notices that public licenses ask for.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
)

#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Words in a block and from one block to the next; a notice of up to half a block lies whole in some block.
BLOCK, STRIDE = 128, 64

# A word's characters before and after lower-casing A-Z are the same set.
_CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _phrase_pattern(phrases) -> str:
    """Any phrase as whole words, A-Z in either case (Java folds ASCII only)."""
    forms = "|".join(_GAP.join(re.escape(w) for w in p.split()) for p in phrases)
    return f"(?<!{_CHAR})(?:{forms})(?!{_CHAR})"


def _template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", text.lower())))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``n_base`` counts the places of all phrases, whose words no two places share. ``labels`` adds to the
    phrases' labels those of every template of which some block of the text holds at least ``containment``
    of the distinct words. ``score`` is 1 with a phrase, else the largest containment found, else 0.

    A null text is empty: counts 0, places null, labels "". Repeated rows are scanned alike; rows alike in
    doc_id and text share their result. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select("doc_id", text.alias("_t"))
    # A-Z only: other capitals, and signs such as U+212A that fold to letters, stay as they are.
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.octet_length("_t") == F.length("_t")
    lowered = F.when(ascii_only, F.lower("_t")).otherwise(F.translate("_t", upper, upper.lower()))
    spoken = F.regexp_extract_all(lowered, F.lit(f"{_CHAR}+"), F.lit(0))

    sets = {(k, label): _template_words(body) for k, (label, body) in enumerate(templates)}
    vocabulary = sorted({w for body in sets.values() for w in body})  # bounded by the templates
    counted = source.select(F.explode(spoken).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in counted.collect()}
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))  # rare words first
    rank = {w: k for k, w in enumerate(ordered)}
    rows, needs = [], {}
    for (k, label), body in sets.items():
        body = sorted(body, key=rank.get)
        needs[k] = math.ceil(containment * len(body) - 1e-9)
        for place, word in enumerate(body[: len(body) - needs[k] + 1]):
            rows.append((k, label, word, place, len(body), needs[k], body))
    index = F.broadcast(spark.createDataFrame(
        rows, "template int, label string, word string, t_place int, t_size int, need int, body array<string>"
    ))  # a row per template and prefix word
    fewest = min(needs.values())
    prefix_words = sorted({r[2] for r in rows})

    pattern = f"(?i){_phrase_pattern([p for p, _ in phrases])}"
    n_base = F.regexp_count("_t", F.lit(pattern)).cast("long")
    many = lambda c: F.regexp_count(c, F.lit(f"{_CHAR}+")).cast("long")
    before = lambda star: many(F.regexp_extract("_t", f"(?is)^({star}){_phrase_pattern([p for p, _ in phrases])}", 1))
    base = [F.when(F.col("_t").rlike(f"(?i){_phrase_pattern([p])}"), F.lit(label)) for p, label in phrases]
    distinct = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")

    literal = lambda values: F.array(*[F.lit(v) for v in values])
    # A block that meets a template holds one of its prefix words: texts without any need no blocks.
    named = F.when(F.arrays_overlap("_w", literal(prefix_words)), F.col("_w"))
    first = (
        source.withColumn("_w", spoken).withColumn("_p", named)
        .select(
            "doc_id", F.xxhash64("_t").alias("_h"), F.size("_w").cast("long").alias("n_words"), n_base.alias("n_base"), "_t", "_p"
        )
    )
    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_p") - (BLOCK - STRIDE)), F.lit(STRIDE)),
        # Words of the template vocabulary, in the global order.
        lambda s: F.array_intersect(literal(ordered), F.slice("_p", s, BLOCK)),
    )
    rows_ = saved(
        first.select(
            "doc_id", "_h", "n_words", "n_base",
            F.when(F.col("n_base") > 0, before(".*?")).alias("first_word"),
            F.when(F.col("n_base") > 0, before(".*")).alias("last_word"),
            F.when(F.col("n_base") > 0, F.array_compact(F.array(*base))).otherwise(F.array().cast("array<string>")).alias("_base"),
            F.filter(F.when(F.col("_p").isNotNull(), blocks), lambda b: F.size(b) >= fewest).alias("_blocks"),
        ),
        "licenses",
    )
    block = rows_.where("size(_blocks) > 0").select("doc_id", "_h", F.explode(F.array_distinct("_blocks")).alias("_b"))
    size = F.size("_b")
    placed = block.select("*", F.posexplode("_b").alias("_place", "word")).where(F.col("_place") <= size - fewest)
    most = (
        F.lit(1) + F.least(F.col("_place"), F.col("t_place"))
        + F.least(size - F.col("_place"), F.col("t_size") - F.col("t_place")) - 1
    )  # words both can still share
    candidates = placed.join(index, "word").where((size >= F.col("need")) & (most >= F.col("need")))
    common = F.size(F.array_intersect("_b", "body"))
    found = (
        candidates.withColumn("_common", common).where("_common >= need")
        .groupBy("doc_id", "_h")
        .agg(F.collect_set("label").alias("_found"), F.max(F.col("_common") / F.col("t_size")).alias("_score"))
        .select(F.col("doc_id").alias("_id"), F.col("_h").alias("_hh"), "_found", "_score")
    )
    joined = rows_.drop("_blocks").join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh")), "left")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        distinct(F.col("_base")).alias("base_labels"),
        distinct(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
