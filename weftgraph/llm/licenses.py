"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them. DataFrame functions only.

A template of n shingles is looked for in windows of 2 w shingles, one every w, where w is the power of two that is n or next above it: each occurrence lies whole in one of them. Only shingles that some template
has count in a window. What else is in the window lowers its Jaccard similarity with the template, which is over 1/4 for an exact occurrence among other templates' text, and 1 for one that stands alone. With BANDS
bands of one hash a window of similarity 1/4 collides with probability over 0.9999, one of 0.8 / 4 (a fifth of the template differs) with 0.9992.

Templates are a table, of any number and length. Which shingles are some template's is asked first of a table of flags, a literal of bounded size that lets few others pass, then of the templates by a join; a window
goes on only if it holds as many as the least containment of the smallest template of its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import materialize, scratch
from weftgraph.llm.license_texts import TEXTS

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
#: Flags at most (1 MB), and those that Spark's bitmap functions put into one row.
MOST_FLAGS, ROW_FLAGS = 1 << 20, 1 << 15

# Short statements of well-known licenses, as they stand in texts.
TEMPLATES = [
    ("mit-short", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-notice", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl3-short", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-notice", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd-grant", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-short", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl2-notice", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "proprietary", "All rights reserved."),
]


def plain(text: Column) -> Column:
    """The text in lower case without punctuation; empty for null."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ".,;:!?\"'()[]{}<>`*_", "")


def words(text: Column) -> Column:
    """The words of a plain text."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D\x{A0}]+"), lambda w: w != "")


def longer(shorter: Column, hashes: Column, k: int) -> Column:
    """Hashes of each run of k words, from those of k - 1 words and of words."""
    n = F.greatest(F.size(hashes) - k + 1, F.lit(0))
    return F.zip_with(F.slice(shorter, F.lit(1), n), F.slice(hashes, F.lit(k), n), lambda a, b: F.xxhash64(a, b))


def runs(hashes: Column, k: int) -> Column:
    """Hashes of each run of k words, from the hashes of words."""
    return hashes if k == 1 else longer(runs(hashes, k - 1), hashes, k)


def templates_in(spark: SparkSession, folder: str) -> DataFrame:
    """template_id, family, template of the text files of a folder, one a template: family is the file's name, without its ending."""
    files = spark.read.text(folder, wholetext=True).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"))
    return files.select(F.col("name").alias("template_id"), F.regexp_replace("name", r"\.[^.]*$", "").alias("family"), F.col("value").alias("template"))


def template_frame(spark: SparkSession, templates: list[tuple[str, str, str]] | DataFrame | None = None) -> DataFrame:
    """template_id, family, k (words of its shingles: SHINGLE, or all if it has fewer), n, w (half a window) and shingles of templates (template_id, family, template): if none are given, short statements and whole licenses. Templates without words are left out."""
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(TEMPLATES + TEXTS if templates is None else templates, "template_id string, family string, template string")
    hashed = rows.withColumn("h", F.transform(words(plain(F.col("template"))), lambda w: F.xxhash64(w))).withColumn("k", F.least(F.size("h"), F.lit(SHINGLE)))
    shingles = F.col("h")
    for k in range(2, SHINGLE + 1):
        shingles = F.when(F.col("k") == k, runs(F.col("h"), k)).otherwise(shingles)
    made = hashed.filter("k > 0").withColumn("all", shingles).withColumn("shingles", F.array_distinct("all"))
    w = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("all").cast("double")) - 1e-9)).cast("int")
    return made.select("template_id", "family", "k", F.size("shingles").alias("n"), w.alias("w"), "shingles")


def bands(shingles: Column) -> Column:
    """The band keys of a set of shingles: (band, least hash)."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))).alias("key")))


def _flags(known: DataFrame) -> bytes:
    """A byte for each value that a hash of a shingle may have: "1" where a template's shingle has it. 16 flags for each shingle, so a sixteenth of others pass; with more shingles than 65,536 more do, and none is lost."""
    n = min(MOST_FLAGS, ROW_FLAGS * (1 + 16 * known.count() // ROW_FLAGS))
    place = known.select((F.pmod("x", F.lit(n)) + 1).alias("at"))  # Spark counts from 1 on
    rows = place.groupBy(F.bitmap_bucket_number("at").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # at most MOST_FLAGS / ROW_FLAGS
    spread = [bytes(49 if x >> i & 1 else 48 for i in range(8)) for x in range(256)]
    held = {r["row"]: b"".join([spread[x] for x in r["bits"]]) for r in rows}
    return b"".join(held.get(i + 1, b"0" * ROW_FLAGS) for i in range(n // ROW_FLAGS))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (families, sorted), n_matches (templates) and matches (template_id, the largest containment, the first word of a window with it) for each row of docs.

    A template (of template_frame()) matches if a window holds at least CONTAINMENT of its shingles of SHINGLE words (all its words, if it has fewer). Texts stay where they are: what moves are their shingles that a
    template has, and the few others that the bit table lets pass.

    Null, empty and blank texts have no matches. Rows that repeat id and text are one document and get the same result; null ids are kept.
    Other columns of docs are not returned. Without templates nothing matches.
    """
    spark = docs.sparkSession
    with scratch(spark):
        best = _matches(docs, templates if templates is not None else template_frame(spark), id_col, text_col)
    match = F.struct("template_id", F.col("m.containment").alias("containment"), (-F.col("m.low")).cast("int").alias("at"))
    grouped = best.groupBy("doc_id", "print").agg(F.array_sort(F.collect_set("family")).alias("licenses"), F.array_sort(F.collect_list(match)).alias("matches"))
    grouped = grouped.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), "licenses", "matches")
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"))
    done = ids.join(grouped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("print") == F.col("__print")), "left")
    return done.select("doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce(F.size("matches"), F.lit(0)).alias("n_matches"), "matches")


def _matches(docs: DataFrame, templates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, print, template_id, family and m (containment, minus the first word of the window) of the best window for each template that a text matches."""
    spark = docs.sparkSession
    templates = materialize(templates, "templates")
    known = materialize(templates.select("k", F.explode("shingles").alias("x")).distinct(), "template-shingles")
    shapes = templates.groupBy("k", "w").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("c")).collect()  # at most SHINGLE + 32 rows
    ks = sorted({r["k"] for r in shapes})
    flags = _flags(known)
    table, size, yes = F.lit(flags), F.lit(len(flags)), F.lit(b"1")

    def known_at(k: int) -> Column:
        """The runs of k words that have a flag, with their places."""
        told = lambda x, i: F.when(F.substring(table, (F.pmod(x, size) + 1).cast("int"), F.lit(1)) == yes, F.struct(F.lit(k).alias("k"), i.alias("at"), x.alias("x")))
        return F.array_compact(F.transform(f"r{k}", told))

    hits_type = "array<struct<k:int,at:int,x:bigint>>"
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("print"), F.transform(words(plain(F.col(text_col))), lambda w: F.xxhash64(w)).alias("r1"))
    for k in range(2, max(ks, default=1) + 1):
        read = read.withColumn(f"r{k}", longer(F.col(f"r{k - 1}"), F.col("r1"), k))
    hits = F.concat(*[known_at(k).cast(hits_type) for k in ks]) if ks else F.array().cast(hits_type)
    rows = read.select("doc_id", "print", F.inline(hits)).join(known, ["k", "x"], "left_semi")
    # two windows of each size hold a shingle, one where it is near the text's beginning
    sizes = F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.lit(r["w"]).alias("w"), F.lit(r["least"]).alias("least")) for r in shapes]) if shapes else F.array().cast("array<struct<k:int,w:int,least:int>>")
    of_k = F.filter(sizes, lambda s: s["k"] == F.col("k"))
    shaped = rows.select("doc_id", "print", "at", "x", F.inline(of_k))
    first = F.floor(F.col("at") / F.col("w")).cast("int")
    windows = shaped.withColumn("start", F.explode(F.filter(F.array(first - 1, first), lambda s: s >= F.when(first == 0, 0).otherwise(first - 1))))
    held = windows.groupBy("doc_id", "print", "k", "w", "start").agg(F.collect_set("x").alias("window"), F.min("least").alias("least")).filter(F.size("window") >= CONTAINMENT * F.col("least"))
    keyed = held.select("doc_id", "print", "k", "w", "start", "window", F.explode(bands(F.col("window"))).alias("b"))
    wanted = templates.select("template_id", F.col("k").alias("tk"), F.col("w").alias("tw"), F.explode(bands(F.col("shingles"))).alias("tb"))
    near = keyed.join(wanted, (F.col("b") == F.col("tb")) & (F.col("k") == F.col("tk")) & (F.col("w") == F.col("tw")))
    once = near.groupBy("doc_id", "print", "k", "w", "start", "template_id").agg(F.any_value("window").alias("window"))
    contained = F.size(F.array_intersect("window", "shingles")) / F.col("n")
    found = once.join(templates.select("template_id", "family", "shingles", "n"), "template_id").withColumn("containment", contained).filter(F.col("containment") >= CONTAINMENT)
    best = found.groupBy("doc_id", "print", "template_id", "family").agg(F.max(F.struct(F.col("containment"), (-F.col("start") * F.col("w")).alias("low"))).alias("m"))
    return materialize(best, "license-matches", keep=True)
