"""Operator 7: license scan by diagonal voting.

All rolling word pairs of a text are hashed and joined with the positions of
the templates' word pairs.  A hit at word p of the text and q of a template
votes for the diagonal p - q.  Votes are aggregated by text, template and
diagonal.  A base phrase stands where one diagonal has all its pairs.  For the
longer templates, neighbouring diagonals (a word left out or put in moves the
rest by one) are merged, and a span is verified: at least ``COVERAGE`` of the
template's pairs, in a span of at most ``STRETCH`` times its length.

DataFrame operations only.  Texts aren't shuffled, only hits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinicledger.llm.common import ascii_lower, stored

#: what lies between two words
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COVERAGE, STRETCH, SLACK = 0.6, 1.5, 3

#: fixed values: phrases and labels of the base scan
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: opening or grant sentences of public licenses and the labels they add
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
     "public license as published by the free software foundation", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license as published by "
     "the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def rolling_pairs(rows: DataFrame, w: Column, position: str, *keep: str, size: str = "") -> DataFrame:
    """``keep``, ``position`` and ``h``, the hash of each word with the next
    one (of the last alone, which no pair has); with ``size`` also the number
    of words under that name."""
    following = F.slice(F.col("__w"), F.lit(2), F.greatest(F.size("__w"), F.lit(1)))
    split = rows.select(*keep, w.alias("__w"))
    if size:
        split, keep = split.withColumn(size, F.size("__w").cast("long")), (*keep, size)
    pairs = split.select(
        *keep, F.posexplode(F.arrays_zip(F.col("__w").alias("a"), following.alias("b"))).alias(position, "__s")
    )
    return pairs.select(*keep, position, F.xxhash64("__s.a", "__s.b").alias("h"))


def template_table(spark: SparkSession) -> DataFrame:
    """``h``, ``tid``, ``q``: a few hundred rows, fixed by this module."""
    rows = [(k, text, base, label) for k, (text, label, base) in enumerate(
        [(t, name, True) for t, name in BASE] + [(t, name, False) for t, name in TEMPLATES]
    )]
    t = spark.createDataFrame(rows, "tid int, phrase string, base boolean, label string")
    return t.withColumn("w", F.split("phrase", " ")).withColumn("n", F.size("w") - 1)


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: ``doc_id``, ``n_words``, ``n_base`` (places
    of base phrases), ``first_word`` and ``last_word`` (smallest and largest
    start), ``base_labels``, ``labels`` (base and verified templates),
    ``score`` (largest coverage of a found template, 1 for a base phrase, 0
    without labels).

    Null and empty texts have 0 words.  Rows are told apart by doc_id and
    text; repeated rows get equal results.  Null doc_ids stay.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    templates = template_table(spark)
    positions = rolling_pairs(templates, F.col("w"), "q", "tid", "n").filter("q < n").drop("n")
    key = ["doc_id", "th"]
    # the one pass over the words: a text's hits, and its first pair with the
    # number of words. Few rows, written because three steps below read them
    rolling = rolling_pairs(source.filter("text is not null"), words(F.col("text")), "p", *key, size="n_words")
    marks = stored(
        rolling.join(F.broadcast(positions), "h", "left").filter("tid is not null or p = 0")
        .select(*key, "n_words", "tid", "p", "q"),
        "license-marks",
    )
    hits = marks.filter("tid is not null").select(*key, "tid", "p", "q").distinct()

    facts = F.broadcast(templates.select("tid", "n", "base", "label"))
    diagonals = hits.groupBy(*key, "tid", (F.col("p") - F.col("q")).alias("d")).agg(
        F.collect_set("q").alias("qs"), F.min("p").alias("lo"), F.max("p").alias("hi")  # at most a template's pairs
    ).join(facts, "tid")
    base = diagonals.filter("base and size(qs) = n").select(
        *key, "label", F.lit(True).alias("base"), F.col("d").alias("place"), F.lit(1.0).alias("share")
    )
    along = Window.partitionBy(*key, "tid").orderBy("d")
    runs = (
        diagonals.filter("not base")
        .withColumn("new", F.coalesce((F.col("d") - F.lag("d").over(along) > SLACK).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(along))
    )
    spans = runs.groupBy(*key, "tid", "n", "label", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("seen"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    found = spans.withColumn("share", F.col("seen") / F.col("n")).filter(
        (F.col("share") >= COVERAGE) & (F.col("hi") - F.col("lo") + 2 <= STRETCH * (F.col("n") + 1) + SLACK)
    ).select(*key, "label", F.lit(False).alias("base"), F.lit(None).cast("int").alias("place"), "share")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    sizes = marks.filter("p = 0").select(
        *key, F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("base"),
        F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("share"), "n_words",
    )
    result = base.unionByName(found).unionByName(sizes, allowMissingColumns=True).groupBy(*key).agg(
        F.max("n_words").alias("n_words"),
        F.count("place").alias("n_base"), F.min("place").cast("long").alias("first_word"),
        F.max("place").cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    )
    texts = source.select(*key)
    same = texts["doc_id"].eqNullSafe(result["doc_id"]) & (texts["th"] == result["th"])
    return texts.join(result, same, "left").select(
        texts["doc_id"], F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
