"""Licences of files: TF-IDF cosine of their notices to templates, then inheritance from the nearest ancestor directory.

Built-in functions only. Units are the lines of every file and the whole text of files named like licence files. A unit
whose cosine to a template reaches the threshold holds one of the template's anchors: words are left out of the anchors
only while their share of the template's squared norm stays under the squared threshold. So only lines with an anchor are
scored, and none is lost. The file counts of the given templates' own words are the only data
gathered; the frequencies of all words, over all files, are a written table that the words of the scored units join.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainweave.session import cut_lineage

THRESHOLD = 0.6
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"

# fixed values: short public notices
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _frequencies(files: DataFrame) -> DataFrame:
    """word, files: in how many files each word is; the word '' counts all files."""
    return cut_lineage(files.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(words(F.col("text"))))).alias("word"))
                       .groupBy("word").agg(F.count("*").alias("files")))


def _anchors(weights: dict[str, float], threshold: float) -> list[str]:
    total, left = sum(w * w for w in weights.values()), 0.0
    out = []
    for word in sorted(weights, key=lambda w: (weights[w], w)):
        left += weights[word] ** 2
        if left >= threshold * threshold * total * (1 - 1e-9):
            out.append(word)
    return out


def own_licences(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file_id, license, score for the files (file_id, path, text) with a unit of cosine >= threshold to a template.

    The best unit and template count; ties go to the licence first in the alphabet. Weights are term count times
    ln((1 + files) / (1 + files with the word)) + 1, for words of no template too. Null or empty texts have no licence; of rows repeating a file_id the best counts.
    """
    files = files.where(F.col("file_id").isNotNull() & F.col("text").isNotNull())
    counted = [(name, Counter(w for w in _split(text))) for name, text in templates]
    vocabulary = sorted({w for _, c in counted for w in c})
    frequencies = _frequencies(files)
    seen = {r["word"]: r["files"] for r in frequencies.where(F.col("word").isin("", *vocabulary)).collect()}  # at most one row a word of the vocabulary
    n = seen.pop("", 0)
    idf = {w: math.log((1 + n) / (1 + seen.get(w, 0))) + 1 for w in vocabulary}
    rows, anchors = [], set()
    for k, (name, count) in enumerate(counted):
        weights = {w: c * idf[w] for w, c in count.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        anchors.update(_anchors(weights, threshold))
        rows += [(w, idf[w], k, name, x / norm) for w, x in weights.items()]
    spark = files.sparkSession
    matrix = spark.createDataFrame(rows, "word string, idf double, template int, license string, share double")
    scale = matrix.select("word", "idf").distinct()

    lines = files.select("file_id", F.posexplode(F.split("text", "\n")).alias("unit", "body"))
    whole = files.where(F.col("path").rlike(LICENCE_NAME)).select("file_id", F.lit(-1).alias("unit"), F.col("text").alias("body"))
    pattern = "(?<![a-z0-9])(?:" + "|".join(sorted(anchors)) + ")(?![a-z0-9])"
    units = lines.unionByName(whole).where(F.lower("body").rlike(pattern))
    # written, so that the join with the frequencies meets two plain exchanges and a common word can be split between tasks
    counts = cut_lineage(units.select("file_id", "unit", F.explode(words(F.col("body"))).alias("word")).groupBy("file_id", "unit", "word").agg(F.count("*").alias("tf")))
    known = counts.join(scale, "word")
    others = counts.join(scale, "word", "left_anti").join(
        frequencies.select("word", (F.log((1 + n) / (1 + F.col("files"))) + 1).alias("idf")), "word")
    weighed = known.unionByName(others).withColumn("w", F.col("tf") * F.col("idf")).drop("idf")
    norms = weighed.groupBy("file_id", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (counts.join(matrix, "word").withColumn("w", F.col("tf") * F.col("idf")).groupBy("file_id", "unit", "template", "license")
            .agg(F.sum(F.col("w") * F.col("share")).alias("dot")))
    scored = dots.join(norms, ["file_id", "unit"]).select("file_id", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = scored.where(F.col("score") >= threshold).groupBy("file_id", "license").agg(F.max("score").alias("score"))
    return best.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("least"), "license")).alias("b")).select(
        "file_id", "b.license", (-F.col("b.least")).alias("score"))


def _split(text: str) -> list[str]:
    return "".join(c if c.isascii() and (c.isalnum()) else " " for c in text.lower()).split()


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """file_id, path, license, score, inherited_from: one row per row of files (file_id, path, text).

    A file without a licence of its own takes that of the nearest ancestor directory (its own first) that holds a licence
    file with one; there the best score counts, then the smallest path. inherited_from is that directory, null for a
    licence of one's own or none. Directories, not files, meet their ancestors. A null path inherits nothing.
    """
    files = files.select("file_id", "path", "text")
    own = own_licences(files, templates, threshold)
    held = files.select("file_id", "path").join(own, "file_id", "left").withColumn("dir", _parent(F.col("path")))
    named = (held.where(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_NAME)).groupBy("dir")
             .agg(F.min(F.struct((-F.col("score")).alias("least"), "path", "license")).alias("b"))
             .select(F.col("dir").alias("ancestor"), F.col("b.license").alias("given")))
    dirs = held.where("dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.struct(
        k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("ancestor")))).alias("a")).select("dir", "a.depth", "a.ancestor")
    nearest = up.join(named, "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "given")).alias("n")).select("dir", "n.ancestor", "n.given")
    return held.join(nearest, "dir", "left").select(
        "file_id", "path", F.coalesce("license", "given").alias("license"), "score",
        F.when(F.col("license").isNull(), F.col("ancestor")).alias("inherited_from"))
