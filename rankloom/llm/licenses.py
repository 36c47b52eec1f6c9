"""License scan: exact set-similarity join of text blocks with license templates, in DataFrame operations alone.

A block is a line of a text, or as many consecutive words of it, across lines, as a template has by `threshold` (so a
notice may be wrapped, indented or behind comment signs, and a few words may stand between). Blocks and templates are
sets of words. A block matches a template when it contains at least `threshold` of the template's words. Tokens are ordered by the number of documents of the whole corpus that have
them, rarest first. Three filters, none of which loses a match, go before the exact overlap:
prefix (a match shares one of the rarest |template| - needed + 1 words of the template, and one as rare of the block),
length (a block with fewer template words than needed can't match) and position (what follows the first common word on
both sides must suffice). Windows of words start at every word that lies near enough to a word of a template's prefix
for a window to hold it, so none that could match is left out. Templates are a parameter of fixed size; their index is
broadcast.

Besides, phrases that name a license are found wherever their words stand consecutively.

A null or empty text has no words, no places and no labels. Repeated rows are scanned each for itself. A text without
line feeds is one block, however long it is, besides its windows. A block that contains the words of two notices gets both labels, so a
non-commercial notice that spells out all words of a plain one has both.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, ascii_lower, cut

#: Phrases that name a license, and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences of public license notices, by label.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
THRESHOLD = 0.85


def spelt(text: str) -> list[str]:
    """Words of a template, repeats included."""
    return "".join(c if c.isdigit() or c.isalpha() or ord(c) > 127 else " " for c in text).lower().split()


def tokens_of(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys(spelt(text)))


def _words(lowered):
    return F.filter(F.split(lowered, GAP), lambda x: x != "")


def scan(documents: DataFrame, threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 where a phrase occurs, else the best containment of a match, else 0)."""
    spark = documents.sparkSession
    rows = [(label, tokens_of(t), math.ceil(len(spelt(t)) / threshold - 1e-9)) for label, texts in templates.items() for t in texts]
    vocabulary = sorted({t for _, ts, _ in rows for t in ts})
    lowered = documents.select(F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("low"))

    # how many documents have each template word: one number for each, whatever the corpus
    known = F.array(*map(F.lit, vocabulary))
    counted = lowered.select(F.explode(F.array_intersect(F.split("low", GAP), known)).alias("token")).groupBy("token").count().collect()
    often = {r["token"]: r["count"] for r in counted}
    order = sorted(vocabulary, key=lambda t: (often.get(t, 0), t))
    rank = {t: i + 1 for i, t in enumerate(order)}
    index = []
    for k, (label, ts, width) in enumerate(rows):
        ranks, need = sorted(rank[t] for t in ts), math.ceil(threshold * len(ts) - 1e-9)
        index += [(k, label, ranks, need, j, ranks[j], width) for j in range(len(ranks) - need + 1)]
    rare = F.array(*[F.lit(order[r - 1]) for r in sorted({x[5] for x in index})])
    least, widest = min(x[3] for x in index), max(x[6] for x in index)
    ordered = F.array(*map(F.lit, order))

    def block(line):
        return F.array_sort(F.filter(F.transform(F.array_distinct(F.split(line, GAP)), lambda t: F.array_position(ordered, t)), lambda p: p > 0))

    words = F.col("words")
    none = F.array().cast("array<array<bigint>>")

    def around(i):
        """Codes of the words, 0 for those of no template, that a window with word i can reach; word i's own comes first."""
        start = F.greatest(i - widest + 1, F.lit(0))
        code = lambda t: F.array_position(ordered, t)
        return F.concat(F.array(code(F.get(words, i))), F.transform(F.slice(words, start + 1, i + widest - start), code))

    at = F.filter(F.transform(words, lambda t, i: F.when(F.array_contains(rare, t), i)), lambda i: i.isNotNull())
    near = F.filter(F.transform(at, around), lambda b: F.size(F.array_distinct(F.filter(b, lambda p: p > 0))) >= least)
    places = []

    def stands(parts):
        def here(i):
            ok = F.get(words, i) == parts[0]
            for j, p in enumerate(parts[1:], 1):
                ok = ok & F.coalesce(F.get(words, i + j) == p, F.lit(False))
            return ok

        return here

    for phrase in phrases:
        parts = phrase.split()
        found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands(parts))
        places.append(F.when(F.arrays_overlap(words, F.array(F.lit(parts[0]))) & F.arrays_overlap(words, F.array(F.lit(parts[-1]))), found).otherwise(F.array().cast("array<int>")))
    lines = F.filter(F.transform(F.split("low", "\n"), block), lambda b: F.size(b) >= least)
    scanned = lowered.select("doc_id", "low", _words(F.col("low")).alias("words")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.array(*places).alias("places"),
        F.when(F.arrays_overlap("words", rare), lines).otherwise(none).alias("blocks"), F.when(F.arrays_overlap("words", rare), near).otherwise(none).alias("near"),
    )
    scanned = cut(scanned)

    of = spark.createDataFrame(index, "template int, label string, ranks array<long>, need int, j int, token long, width int")
    blocks = scanned.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("block"))
    tokens = blocks.select("row", "block", F.posexplode("block").alias("i", "token"))
    nb, nt = F.size("block"), F.size("ranks")
    met = tokens.join(F.broadcast(of), "token").where((F.col("i") <= nb - F.col("need")) & (1 + F.least(nb - 1 - F.col("i"), nt - 1 - F.col("j")) >= F.col("need")))
    overlap = F.size(F.array_intersect("block", "ranks"))
    whole = met.where(overlap >= F.col("need")).select("row", "label", (overlap / nt).alias("part"))

    surroundings = scanned.where(F.size("near") > 0).select("row", F.explode("near").alias("near")).select("row", F.col("near")[0].alias("token"), F.expr("slice(near, 2, size(near))").alias("near"))
    close = surroundings.join(F.broadcast(of), "token").where(F.size(F.array_intersect("near", "ranks")) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - F.col("width") + 1, F.lit(1)))
    most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("near", i, F.col("width")), F.col("ranks")))))
    wrapped = close.withColumn("most", most).where("most >= need").select("row", "label", (F.col("most") / nt).alias("part"))
    matched = whole.unionByName(wrapped).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("part").alias("best"))

    every = F.flatten("places")
    base = F.array_compact(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    out = scanned.join(matched, "row", "left").withColumn("base", base)
    return out.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), join(F.col("base")).alias("base_labels"),
        join(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
