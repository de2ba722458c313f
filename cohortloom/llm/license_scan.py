"""License scans: a trained paragraph classifier with an unknown class, confirmed against templates.

A paragraph is a line. Multinomial logistic regression over word unigrams and bigrams knows each licence family and
an unknown class; it is trained here, on variations of the templates below and on other sentences, and its
confidence is calibrated by a temperature on variations it has not seen. A prediction is confirmed when
the paragraph shares enough word trigrams with a template of the family, in proportion to the shorter of the two.

Each feature has a weight that no family gains more by over unknown. A paragraph where these add up to less than a
sure prediction takes is unknown whatever its family, and is passed over while the texts are read, without
moving it, unless it shares a trigram with a template. Features and trigrams are bounded by the templates. The rest
is sums over the few paragraphs left. The scan is all DataFrame functions.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.shared import store, text_of

UNKNOWN = "unknown"
#: Below this calibrated probability a paragraph counts as unknown.
LEAST_PROBABILITY = 0.6
#: Share of the shorter one's trigrams that paragraph and template have in common.
LEAST_SIMILARITY = 0.5

#: Fixed: customary notices of licence families.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "All rights reserved. No part of this work may be reproduced without prior written permission.",
        "This software is proprietary and confidential. Unauthorized copying is strictly prohibited.",
    ],
}
#: Sentences of other kinds, among them some that speak of licences.
OTHERS = [
    "You need a driving license to rent a car in this city.",
    "The license fee is due at the end of the month.",
    "The Apache are a group of culturally related tribes in the southwest.",
    "She studied at MIT before joining the public school board.",
    "The version of the story that he told was free of charge.",
    "A copy of this report was distributed to every person in the room.",
    "The commons were open to the public under the old law.",
    "He released the new version under his own name.",
    "Their work is subject to the terms of the contract.",
    "This is the general idea, and you can use it in any form.",
    "Copyright law protects the work of authors.",
    "The software was developed by a small team over two years.",
    "All conditions must be met before the permission is granted.",
    "The international community reserved judgement.",
    "We may change these terms without prior notice.",
]
VARIATIONS = 20
TOKEN = r"[a-z0-9]+"


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def variations(rng: random.Random) -> list[tuple[list[str], str]]:
    """Training paragraphs: whole and partial sentences, with words lost, added and, for unknown, mixed."""
    filler = [w for s in OTHERS for w in tokens(s)]
    legal = [w for ts in TEMPLATES.values() for t in ts for w in tokens(t)]
    out = []

    def vary(words: list[str]) -> list[str]:
        kept = [w for w in words if rng.random() > 0.08] or words
        return rng.choices(filler, k=rng.randint(0, 4)) + kept + rng.choices(filler, k=rng.randint(0, 4))

    for family, templates in TEMPLATES.items():
        for template in templates:
            words = tokens(template)
            out.append((words, family))
            for _ in range(VARIATIONS):
                out.append((vary(words), family))
    for _ in range(len(out) // 3):
        out.append((vary(tokens(rng.choice(OTHERS))), UNKNOWN))
        out.append((rng.choices(filler + legal, k=rng.randint(3, 30)), UNKNOWN))
        out.append((rng.choices(filler, k=rng.randint(1, 30)), UNKNOWN))
    rng.shuffle(out)
    return out


def grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


@lru_cache(maxsize=1)
def trained() -> tuple[list[str], dict[str, np.ndarray], np.ndarray]:
    """Families, calibrated weights of each feature, and biases. The same on every call."""
    rng = random.Random(11)
    data = variations(rng)
    families = [*TEMPLATES, UNKNOWN]
    cut = len(data) * 3 // 4
    names = sorted({g for words, _ in data[:cut] for g in grams(words)})
    index = {g: i for i, g in enumerate(names)}

    def matrix(rows):
        x = np.zeros((len(rows), len(names) + 1), np.float32)
        for i, (words, _) in enumerate(rows):
            x[i, [index[g] for g in grams(words) if g in index]] = 1
        x[:, -1] = 1
        y = np.zeros((len(rows), len(families)), np.float32)
        y[np.arange(len(rows)), [families.index(f) for _, f in rows]] = 1
        return x, y

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(data[:cut])
    w = np.zeros((x.shape[1], len(families)), np.float32)
    speed = np.zeros_like(w)
    for _ in range(200):
        speed = 0.9 * speed - 0.02 * (x.T @ (softmax(x @ w) - y) / len(x) * 10 + 0.002 * w)
        w += speed
    x, y = matrix(data[cut:])
    z = x @ w
    heats = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    heat = min(heats, key=lambda t: -np.log(np.maximum((softmax(z / t) * y).sum(axis=1), 1e-12)).mean())
    w = w / heat
    return families, {g: w[i] for g, i in index.items()}, w[-1]


def template_trigrams() -> dict[str, list[set[tuple[str, ...]]]]:
    return {f: [set(zip(t, t[1:], t[2:])) for t in map(tokens, ts)] for f, ts in TEMPLATES.items()}


def hashed(words: Column) -> Column:
    """Hashes of the word trigrams of an array, distinct."""
    each = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.array_distinct(F.slice(each, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def featured(words: Column) -> Column:
    """Unigrams and bigrams of an array of words."""
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.concat(words, F.filter(pairs, lambda g: g.isNotNull()))


def gains() -> tuple[dict[str, int], int]:
    """What each feature adds over unknown for the family that it favours most, in tenths rounded up, and the sum from
    which a family can reach ``LEAST_PROBABILITY``."""
    families, weights, bias = trained()
    unknown = families.index(UNKNOWN)

    def most(w: np.ndarray) -> float:
        return float(np.delete(w, unknown).max()) - float(w[unknown])

    # surely below the exact sum
    least = math.floor(10 * (math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY)) - most(bias) - 1e-3))
    return {g: math.ceil(10 * most(w)) for g, w in weights.items()}, least


def listed(features: list[str]) -> str:
    return ", ".join(f"'{g}'" for g in sorted(features))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each paragraph of a sure family, and for each that shares a trigram with a template.

    ``doc_id, paragraph`` (from 0), ``family`` (``unknown`` if not sure), ``probability, similarity, confirmed``.
    Null, empty and blank texts have no paragraphs; repeated rows are scanned each; a null doc_id stays null.
    Other columns are ignored. Paragraphs without a row are unknown. Those of fewer than three words share no trigram.
    """
    spark = docs.sparkSession
    families, weights, bias = trained()
    by_family = template_trigrams()
    rows = [(f, i, *gram) for f, sets in by_family.items() for i, s in enumerate(sets) for gram in sorted(s)]
    known = spark.createDataFrame(rows, "family string, template int, a string, b string, c string")
    known = known.select("family", "template", F.xxhash64("a", "b", "c").alias("gram"))
    hashes = [r.gram for r in known.select("gram").distinct().collect()]

    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(text_of(text), "\n")).alias("paragraph", "line"))
    lines = lines.withColumn("words", F.filter(F.split(F.lower("line"), "[^a-z0-9]+"), lambda w: w != ""))
    lines = lines.withColumn("grams", hashed(F.col("words")))
    gain, least = gains()
    lines = lines.withColumn("pairs", featured(F.col("words")))
    lines = lines.withColumn("known", F.expr(f"array_distinct(filter(pairs, g -> g in ({listed(list(gain))})))"))
    cases = " ".join(f"when g in ({listed([g for g, n in gain.items() if n == step])}) then {step}" for step in sorted(set(gain.values())))
    lines = lines.withColumn("gain", F.expr(f"aggregate(known, 0, (a, g) -> a + case {cases} else 0 end)"))
    # not a filter: the optimizer would move that down and evaluate the trigrams again for each of them
    kept = F.struct("doc_id", "paragraph", "grams", "known")
    found = F.when((F.col("gain") >= least) | F.exists("grams", lambda g: g.isin(hashes)), F.array(kept))
    found = lines.select(F.inline(found)).withColumn("row", F.monotonically_increasing_id())
    found = store(found, "paragraphs")  # few, and read several times

    columns = [f"w{i}" for i in range(len(families))]
    table = spark.createDataFrame([(g, *map(float, v)) for g, v in weights.items()], "feature string, " + ", ".join(f"{c} double" for c in columns))
    each = found.select("row", F.explode("known").alias("feature")).join(F.broadcast(table), "feature")
    scores = each.groupBy("row").agg(*[(F.sum(c) + float(bias[i])).alias(c) for i, c in enumerate(columns)])
    top = F.greatest(*columns)
    total = sum((F.exp(F.col(c) - top) for c in columns), F.lit(0.0))
    best = F.coalesce(*[F.when(F.col(c) == top, f) for c, f in zip(columns, families)])
    scores = scores.select("row", best.alias("best"), (1 / total).alias("probability"))

    sizes = known.groupBy("family", "template").agg(F.countDistinct("gram").alias("size"))
    shared = found.select("row", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(known.distinct()), "gram")
    shared = shared.groupBy("row", "n", "family", "template").agg(F.count("*").alias("common")).join(F.broadcast(sizes), ["family", "template"])
    similar = shared.groupBy("row", F.col("family").alias("best")).agg(F.max(F.col("common") / F.least("n", "size")).alias("similarity"))

    out = found.select("row", "doc_id", "paragraph", "grams").join(scores, "row").join(similar, ["row", "best"], "left")
    sure = (F.col("best") != UNKNOWN) & (F.col("probability") >= LEAST_PROBABILITY)
    similarity = F.round(F.coalesce("similarity", F.lit(0.0)), 6)
    shared = F.exists("grams", lambda g: g.isin(hashes))
    return out.where(sure | shared).select(
        "doc_id",
        "paragraph",
        F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 6).alias("probability"),
        similarity.alias("similarity"),
        (sure & (similarity >= LEAST_SIMILARITY)).alias("confirmed"),
    )
