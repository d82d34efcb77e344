"""License scans: sparse TF-IDF cosine to templates, then inheritance by directory.

Every document is a file of a repository tree.  Each line of its whole text is a
header candidate: the line's words are weighted by TF-IDF (document frequencies
of the template words over the whole corpus) and compared by cosine with the
licence templates.  A file's best line at or over the threshold is its own
licence; a file of which matched lines make up a third of the words is a licence
file, and its licence holds for its directory.  Files without an own licence
inherit that of the nearest ancestor directory that has one, found by joining
the directories with their path prefixes.

Exactness of the line filter: by Cauchy-Schwarz, words whose joint share of a
template's norm is below the threshold cannot reach it alone.  So each template
needs only its heaviest words, down to that share, as *signals*, and lines
without a signal word of any template are never compared.

Only DataFrame functions are used.  Bounds: templates and their vocabulary are a
parameter of the job and small; directories are resolved once each, not once per
file, and licence-bearing directories are one row each before any join.

Defined cases: a null or empty text has no line and can only inherit; null source or
lang is the path part ``none``; of equal cosines the licence that sorts first
wins; of several licence files in a directory the best cosine wins, then the
smallest doc_id; rows that repeat a doc_id are files of one path and get one row
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C

# The usual one-line notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.6
FILE_SHARE = 1 / 3
SPLIT = r"[^a-z0-9]+"


def line_words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), SPLIT), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    import re

    return [w for w in re.split(SPLIT, text.lower()) if w]


def file_path() -> Column:
    """source/lang/a directory per 64 ids/file: the tree in which documents stand."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return F.concat_ws("/", part("source"), part("lang"), F.concat(F.lit("d"), F.floor(F.col("doc_id") / 64).cast("string")),
                       F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def _signals(weights: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """For each template the heaviest words, until the rest cannot reach the threshold."""
    out: set[str] = set()
    for w in weights.values():
        norm = sum(x * x for x in w.values())
        rest = norm
        for word in sorted(w, key=lambda k: (-w[k], k)):
            if math.sqrt(max(rest, 0.0) / norm) < threshold - 1e-9:
                break
            out.add(word)
            rest -= w[word] ** 2
    return sorted(out)


def _holds(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, as words."""
    return F.lower(text).rlike(r"(?<![a-z0-9])(?:" + "|".join(words) + r")(?![a-z0-9])")


def idf(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """log((1 + documents) / (1 + df)) of each template word, over all whole texts; 0.01 at least."""
    words = F.array_intersect(F.split(F.lower(F.coalesce("text", F.lit(""))), SPLIT), F.array(*[F.lit(w) for w in vocabulary]))
    # the empty word counts the documents
    counts = docs.select(F.explode(F.concat(words, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in counts.collect()}  # a row per template word at most
    return {w: max(0.01, math.log((1 + n.get("", 0)) / (1 + n.get(w, 0)))) for w in vocabulary}


def _cosines(line: Column, weight: dict[str, float], tfidf: dict[str, dict[str, float]], names: list[str]) -> Column:
    """Structs (s cosine, k minus the template's place, n words) of an array of words to every template.

    A word outside all templates is a dimension of its own with the largest idf."""
    vocabulary = sorted(weight)
    norms = {n: math.sqrt(sum(x * x for x in tfidf[n].values())) for n in names}
    table = F.create_map(*[x for w in vocabulary for x in (F.lit(w), F.array(
        F.lit(weight[w]), *[F.lit(tfidf[n].get(w, 0.0) / norms[n]) for n in names]))])
    known = F.transform(F.array_intersect(line, F.array(*[F.lit(w) for w in vocabulary])), lambda w: F.struct(
        F.size(F.filter(line, lambda x: x == w)).cast("double").alias("tf"), F.element_at(table, w).alias("v")))
    summed = F.aggregate(known, F.array_repeat(F.lit(0.0), len(names) + 2), lambda a, x: F.zip_with(a, F.concat(
        # tf, squared weight, and the products with every template
        F.array(x["tf"], F.pow(x["tf"] * x["v"][0], F.lit(2.0))),
        F.transform(F.slice(x["v"], 2, len(names)), lambda t: x["tf"] * x["v"][0] * t)), lambda p, q: p + q))
    parts = F.struct(F.size(line).alias("n"), summed.alias("d"))
    most = max(weight.values())

    def scored(x: Column) -> Column:
        norm = F.sqrt(x["d"][1] + (x["n"] - x["d"][0]) * F.lit(most * most))
        return F.transform(F.slice(x["d"], 3, len(names)), lambda d, k: F.struct(
            F.round(d / norm, 9).alias("s"), (-k).alias("k"), x["n"].alias("n")))

    return F.element_at(F.transform(F.array(parts), scored), 1)


def own_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, score, is_license_file for every row of ``docs``; no shuffle after the idf."""
    terms = {name: _template_words(text) for name, text in templates.items()}
    weight = idf(docs, sorted({w for t in terms.values() for w in t}))
    tfidf = {name: {w: t.count(w) * weight[w] for w in set(t)} for name, t in terms.items()}
    signals = _signals(tfidf, threshold)
    names = sorted(templates)

    text = F.coalesce("text", F.lit(""))
    near = F.filter(F.split(text, "\n"), lambda line: _holds(line, signals))
    out = docs.select("doc_id", file_path().alias("path"), text.alias("text")).select(
        "doc_id", "path", F.when(_holds(F.col("text"), signals), near).alias("lines"),
        F.when(_holds(F.col("text"), signals), F.size(line_words(F.col("text")))).alias("all"))
    lines = F.transform("lines", lambda line: F.array_max(_cosines(line_words(line), weight, tfidf, names)))
    out = out.select("doc_id", "path", "all", F.filter(lines, lambda x: x["s"] >= threshold).alias("lines")).select(
        "doc_id", "path", "all", F.array_max("lines").alias("best"), F.aggregate("lines", F.lit(0), lambda a, x: a + x["n"]).alias("n"))
    found = F.col("best").isNotNull()
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce(F.lit(1) - F.col("best.k"), F.lit(1)))
    return out.select("doc_id", "path", F.when(found, name).alias("own_license"), F.when(found, F.col("best.s")).otherwise(0.0).alias("score"),
                      (found & (F.col("n") >= F.col("all") * F.lit(FILE_SHARE))).alias("is_license_file"))


def directory(path: Column) -> Column:
    """Everything before the last slash; the root is the empty path."""
    return F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"/*[^/]*$", "")


def ancestors(path: Column) -> Column:
    """The directory itself and all directories above it, with their depth: array of structs."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, score, is_license_file, license (own, else
    inherited), origin (own, inherited, none) and license_dir (where it is inherited from)."""
    C.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang", "source")
    own = C.written(own_licenses(docs, templates, threshold).withColumn("dir", directory(F.col("path"))), "licenses")
    best = F.max(F.struct("score", (-F.col("doc_id")).alias("tie"), "own_license"))
    holders = own.where("is_license_file and own_license is not null").groupBy(F.col("dir").alias("holder")).agg(best["own_license"].alias("inherited"))
    dirs = own.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.depth", F.col("a.dir").alias("holder"))
    nearest = dirs.join(holders, "holder").groupBy("dir").agg(F.max(F.struct("depth", "holder", "inherited")).alias("x")).select(
        "dir", F.col("x.holder").alias("license_dir"), F.col("x.inherited").alias("inherited"))
    out = own.join(nearest, "dir", "left")
    inherits = F.col("own_license").isNull() & F.col("inherited").isNotNull()
    return out.select("doc_id", "path", "own_license", "score", "is_license_file", F.coalesce("own_license", "inherited").alias("license"),
                      F.when(F.col("own_license").isNotNull(), "own").when(inherits, "inherited").otherwise("none").alias("origin"),
                      F.when(inherits, F.col("license_dir")).alias("license_dir"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``."""
    return scan(C.table(spark, sf_dir, "documents"))
