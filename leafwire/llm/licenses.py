"""Licence scans: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over sparse word n-grams is trained from noisy copies of the
templates and from prose that only sounds alike, which is the class ``unknown``. A
temperature fitted on copies of its own kind that it was not trained on calibrates its
probabilities. A piece of text is a licence's if the model says so and enough of the
n-grams of one of that family's templates stand in it. Scoring is DataFrame
expressions alone: n-grams are exploded, joined with the weights (whose number the
templates bound) and summed by piece.

A template is only confirmed by a share of its n-grams, so that some of its marker words must be in it. Pieces
are the lines with a marker word and, for notices that are wrapped, the stretches of a paragraph's lines that
stand no further than two lines from one; a paragraph ends at a blank line. Where no line of a stretch is
a licence by itself the stretch as a whole may be one. Comment marks are no words and so play no part.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence families and notices that name or open them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib"],
    "Artistic-2.0": ["This work is licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "proprietary": ["All rights reserved.", "Copyright the authors. All rights reserved.", "This document is confidential and proprietary. All rights reserved."],
}
UNKNOWN = "unknown"
#: Prose that shares words with licences but grants nothing.
PROSE = [
    "the driver lost his license after the third offence",
    "a fishing license can be bought at the town hall",
    "version 2.0 of the game was released under a new name last year",
    "the general public was free to use the library",
    "he asked for permission to copy the source of the letter",
    "public interest in software grew and so did the work of the foundation",
    "the license plate of the car was from another state",
    "she works under the terms of a contract with the university",
    "copyright law is taught in the second year",
    "this work was done in the summer and released in the spring",
    "all rights and duties of members are listed in the book",
    "the software comes with documentation files and a binary",
    "conditions are met only in the north of the country",
    "a license is a permission and its terms are conditions",
    "most software licenses are long and few people read them",
]
SIZES = (1, 2)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]", text.lower())


def grams_of(text: str) -> list[str]:
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in SIZES for i in range(len(w) - n + 1)]


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]  # the last is unknown
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float


def examples(copies: int, seed: int) -> list[tuple[str, str]]:
    """Noisy copies of templates, and unknown paragraphs."""
    r = random.Random(seed)
    plain = words_of(" ".join(PROSE))
    out = []

    def noise(n: int) -> str:
        return " ".join(r.choice(plain) for _ in range(n))

    for family, texts in TEMPLATES.items():
        for text in texts:
            for k in range(copies):
                words = [w for w in text.split() if not k or r.random() > 0.04]
                out.append((family, " ".join([noise(r.randrange(6 if k % 4 else 25)) if k % 2 else "", *words, noise(r.randrange(8 if k % 5 else 25)) if k % 3 else ""])))
    for k in range(copies * 14):
        words = r.choice(PROSE).split()
        some = r.choice(r.choice(list(TEMPLATES.values()))).split()
        at = r.randrange(len(some))
        piece = some[at : at + r.randrange(1, 3)] if k % 3 == 0 else []
        out.append((UNKNOWN, " ".join([noise(r.randrange(8 if k % 5 else 50)), *words[: r.randrange(2, len(words) + 1)], *piece])))
    return out


@lru_cache(maxsize=1)
def train(copies: int = 10, rounds: int = 250, rate: float = 0.5, decay: float = 1e-4) -> Classifier:
    families = (*TEMPLATES, UNKNOWN)
    known = sorted({g for t in TEMPLATES.values() for x in t for g in grams_of(x)})
    place = {g: i for i, g in enumerate(known)}

    def matrix(rows: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(known)), np.float32)
        for i, (_, text) in enumerate(rows):
            x[i, [place[g] for g in set(grams_of(text)) if g in place]] = 1
        return x, np.array([families.index(f) for f, _ in rows])

    def chances(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(examples(copies, 1))
    w, b = np.zeros((len(known), len(families)), np.float32), np.zeros(len(families), np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    goal = np.eye(len(families), dtype=np.float32)[y]
    for _ in range(rounds):
        d = (chances(x @ w + b) - goal) / len(x)
        speed_w = 0.9 * speed_w + x.T @ d + decay * w
        speed_b = 0.9 * speed_b + d.sum(0)
        w -= rate * speed_w
        b -= rate * speed_b
    x, y = matrix(examples(2, 2))
    z = x @ w + b
    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(chances(z / t)[np.arange(len(y)), y] + 1e-9).mean())
    return Classifier(families, {g: tuple(float(v) for v in w[i]) for g, i in place.items()}, tuple(float(v) for v in b), temperature)


@lru_cache(maxsize=1)
def common() -> set[str]:
    """Words of ordinary prose, which mark nothing."""
    return set(words_of(" ".join(PROSE))) - {"license", "licenses", "copyright", "permission", "rights"}


def markers(least: float) -> list[str]:
    """Words of which a line must have one to hold ``least`` of any template's n-grams."""
    out: set[str] = set()
    for texts in TEMPLATES.values():
        for text in texts:
            grams = set(grams_of(text))
            own = sorted(set(words_of(text)), key=lambda w: (w in common(), w not in out, -len(w), w))
            for i in range(1, len(own) + 1):
                chosen = set(own[:i])
                if sum(not chosen.isdisjoint(g.split()) for g in grams) > (1 - least) * len(grams):
                    out |= chosen
                    break
            else:
                out |= set(own)
    return sorted(out)


def word_array(text: Column) -> Column:
    """The same words as :func:`words_of`."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9.]*[a-z0-9]|[a-z0-9]"), F.lit(0))


#: Lines on either side of one with a marker word that belong to its stretch.
REACH = 2


def marker_regex(least: float) -> str:
    """Any marker at the start of a word, sorted by first letters so that most places fail at once."""
    heads: dict[str, list[str]] = {}
    for m in markers(least):
        heads.setdefault(m[0], []).append(re.escape(m[1:]).replace(r"\-", "-"))
    return "(?<![a-z0-9])(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in sorted(heads.items())) + ")"


def pieces(docs: DataFrame, least: float) -> DataFrame:
    """kid, kh, first, last (line numbers), text of the lines that have a marker word and of the stretches of more than one line."""
    lines = docs.select(F.col("doc_id").alias("kid"), F.xxhash64("text").alias("kh"), F.split("text", "\n", -1).alias("lines"))
    marked = F.transform("lines", lambda x: F.lower(x).rlike(marker_regex(least)))
    lines = lines.withColumn("marked", marked).where(F.exists("marked", lambda x: x)).distinct()
    near = F.transform("lines", lambda x, i: x.rlike(r"\S") & F.exists(F.slice("marked", F.greatest(i - REACH + 1, F.lit(1)), REACH + F.least(i, F.lit(REACH)) + 1), lambda y: y))
    each = lines.select("kid", "kh", F.posexplode(F.arrays_zip(F.col("lines").alias("text"), F.col("marked").alias("marked"), near.alias("near"))).alias("line", "x"))
    each = each.where("x.near").select("kid", "kh", "line", "x.text", "x.marked")
    island = F.col("line") - F.expr("row_number() over (partition by kid, kh order by line)")
    joined = each.withColumn("island", island).groupBy("kid", "kh", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("all"))
    whole = joined.where("last > first").select("kid", "kh", "first", "last", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("text"))
    return whole.unionByName(each.where("marked").select("kid", "kh", F.col("line").alias("first"), F.col("line").alias("last"), "text"))


def classify(docs: DataFrame, least: float = 0.75, sure: float = 0.5) -> DataFrame:
    """kid, kh, first, last, family, chance, similarity of every licence piece; a stretch only where none of its lines is one.

    ``sure``: least calibrated probability of the family; ``least``: least share of a
    template's n-grams that stand in the piece.
    """
    spark = docs.sparkSession
    model = train()
    k = len(model.families)
    rows = pieces(docs, least).withColumn("words", word_array(F.col("text")))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("grams", F.array_distinct(F.concat("words", F.coalesce(pairs, empty)))).select("kid", "kh", "first", "last", F.explode("grams").alias("gram"))
    table = [{"gram": g, "w": w, "held": [i for i, t in enumerate(all_templates()) if g in t[2]]} for g, w in model.weights.items()]
    weights = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(table)), "array<struct<gram:string,w:array<double>,held:array<int>>>")))
    scored = rows.join(F.broadcast(weights), "gram")
    templates = all_templates()
    sums = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)]
    hits = [F.count_if(F.array_contains("held", i)).alias(f"t{i}") for i in range(len(templates))]
    scored = scored.groupBy("kid", "kh", "first", "last").agg(*sums, *hits)
    z = F.array(*[(F.col(f"z{i}") + model.bias[i]) / model.temperature for i in range(k)])
    scored = scored.withColumn("z", z).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("chance", 1 / F.aggregate(F.transform("z", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x))
    best = F.array_position("z", F.col("top")).cast("int")
    family = F.element_at(F.array(*[F.lit(f) for f in model.families]), best)
    share = F.array(*[F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"t{i}") / len(t[2]) for i, t in enumerate(templates) if t[0] == f]) for f in model.families])
    scored = scored.withColumn("family", family).withColumn("similarity", F.element_at(share, best))
    found = scored.where((F.col("family") != UNKNOWN) & (F.col("chance") >= sure) & (F.col("similarity") >= least)).select("kid", "kh", "first", "last", "family", "chance", "similarity")
    # the document's lines that are licences by themselves; a stretch counts where none is in it
    held = found.withColumn("lines", F.expr("collect_set(case when first = last then first end) over (partition by kid, kh)"))
    alone = (F.col("first") == F.col("last")) | ~F.exists("lines", lambda x: (x >= F.col("first")) & (x <= F.col("last")))
    return held.where(alone).drop("lines")


@lru_cache(maxsize=1)
def all_templates() -> list[tuple[str, str, frozenset[str]]]:
    return [(f, x, frozenset(grams_of(x))) for f, texts in TEMPLATES.items() for x in texts]


def license_report(docs: DataFrame, least: float = 0.75, sure: float = 0.5) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, comma-joined), spans (first-last:family, by lines from 0) of every row of ``docs``.

    Paragraphs are runs of lines that are not blank; null and blank texts have none. Rows that share a doc_id are judged
    one by one; other columns are ignored. A piece is counted once, with its likeliest family.
    """
    docs = docs.select("doc_id", "text")
    found = classify(docs, least, sure).groupBy("kid", "kh").agg(
        F.count("*").alias("n_licensed"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "last", "family"))), lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["last"].cast("string"), F.lit(":"), x["family"])), ",").alias("spans"),
    )
    n = F.size(F.filter(F.split("text", r"\n\s*\n", -1), lambda x: x.rlike(r"\S")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_paragraphs"))
    joined = rows.join(found, [F.col("doc_id").eqNullSafe(F.col("kid")), F.col("h") == F.col("kh")], "left")
    return joined.select("doc_id", "n_paragraphs", F.coalesce("n_licensed", F.lit(0).cast("long")).alias("n_licensed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("spans", F.lit("")).alias("spans"))
