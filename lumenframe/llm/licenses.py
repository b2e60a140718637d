"""License scans by a positional index of rare licence words (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import ascii_lower, cut, documents

#: What separates words once A-Z is lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that give a label by themselves.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label -> (notice, its mandatory key phrases); words of the licences' own notices.
TEMPLATES = {
    "mit-notice": ("released under the mit license", ["mit license"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "apache-header": ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "except in compliance with the license"]),
    "gpl-notice": ("this work is licensed under the gnu general public license version", ["gnu general public license"]),
    "gpl-header": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["under the terms of the gnu general public license", "free software foundation"]),
    "lgpl-header": ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions are met"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["copy modify and or distribute this software for any purpose", "with or without fee"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "cc-by-nc": ("licensed under cc by nc", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa", ["cc by sa"]),
}


def postings() -> list[tuple[str, str, bool, int, int]]:
    """(word, entry, is a notice, position, words of the entry): notices are keyed by label, phrases by themselves."""
    phrases = {*BASE, *(p for _, keys in TEMPLATES.values() for p in keys)}
    entries = [(label, True, notice.split()) for label, (notice, _) in TEMPLATES.items()] + [(p, False, p.split()) for p in sorted(phrases)]
    return [(w, entry, notice, at, len(words)) for entry, notice, words in entries for at, w in enumerate(words)]


def words_of(text: str) -> F.Column:
    """Words of the lower-cased column; a text that begins or ends with a break has an empty first or last part."""
    return F.filter(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), BREAK), lambda w: w != "")


def scan_licenses(docs: DataFrame, anchors: int = 12, slack: int = 8, least: float = 0.5) -> DataFrame:
    """Find licence phrases and notices in whole texts.

    The index has a posting (entry, position) for every word of the phrases and notices, a fixed few hundred rows.
    Document frequencies of its words over all documents give their IDF. A document that holds the highest-IDF
    word of some phrase, which no match can do without, is looked up: for each notice, the document's `anchors` highest-IDF words, and for a
    phrase all its words, meet the entry's postings, and places that agree on word position - posting position vote for a start. A phrase
    stands where all its words vote. A notice is a candidate where at least `least` of its anchors in the document vote
    (no fewer than 3, or all), and gives its label if each of its mandatory phrases stands within it, give or take `slack` words.

    Returns doc_id, n_words, n_base, first_word, last_word (of base phrases), base_labels, labels, score: 0 without a
    finding, 0.6 for base phrases, and 0.6 + 0.4 * (voting share of the anchors) for the best notice. Null texts are
    empty. Null doc_ids and repeated rows are scanned as rows of their own; an empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    index = postings()
    vocabulary = sorted({p[0] for p in index})
    every = F.array(*map(F.lit, vocabulary))
    frequency = docs.select(F.explode(F.array_intersect(words_of("text"), every)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # As many rows as the index has words.
    df = {r["word"]: r["df"] for r in frequency.collect()}
    n = docs.count()
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    # All words of a phrase are needed, and a notice needs its phrases: so a text needs the rarest word of some phrase.
    phrases_only = {entry: entry.split() for _, entry, notice, *_ in index if not notice}
    rarest = sorted({min(ws, key=lambda w: (-idf[w], w)) for ws in phrases_only.values()})
    table = spark.createDataFrame([(*p, idf[p[0]]) for p in index], "word string, entry string, notice boolean, at int, size int, idf double")

    held = docs.select("doc_id", words_of("text").alias("words"))
    hit = F.arrays_overlap("words", F.array(*map(F.lit, rarest)))
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x["word"].isin(vocabulary))
    rows = held.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(hit, places).alias("hits"))
    rows = cut(rows, "words")  # fixes the row numbers
    hits = rows.where("hits is not null").select("row", F.explode("hits").alias("hit")).select("row", "hit.pos", "hit.word")

    # A group (row, entry) has no more rows than the entry has words.
    known = hits.select("row", "word").distinct().join(F.broadcast(table.select("word", "entry", "notice", "idf").distinct()), "word")
    best = Window.partitionBy("row", "entry").orderBy(F.desc("idf"), "word")
    chosen = known.withColumn("k", F.row_number().over(best)).where((F.col("k") <= anchors) | ~F.col("notice")).select("row", "entry", "word")
    votes = hits.join(chosen, ["row", "word"]).join(F.broadcast(table), ["entry", "word"])
    starts = votes.groupBy("row", "entry", "notice", "size", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("votes"))
    most = table.groupBy("entry").agg(F.count("*").alias("postings"))
    starts = cut(starts.join(F.broadcast(most), "entry"), "starts")

    phrases = starts.where("not notice and votes = size").select("row", F.col("entry").alias("phrase"), "start")
    needed = spark.createDataFrame([(label, p, len(p.split()), len(ks)) for label, (_, ks) in TEMPLATES.items() for p in ks], "entry string, phrase string, words int, needed int")
    held_anchors = chosen.join(F.broadcast(table.where("notice")), ["entry", "word"]).groupBy("row", "entry").agg(F.count("*").alias("possible"))
    near = starts.where("notice").join(held_anchors, ["row", "entry"]).where((F.col("votes") >= F.ceil(least * F.col("possible"))) & (F.col("votes") >= F.least(F.lit(3), "size")))
    checked = near.withColumnRenamed("start", "from").join(F.broadcast(needed), "entry").join(phrases, ["row", "phrase"])
    checked = checked.where((F.col("start") >= F.col("from") - slack) & (F.col("start") + F.col("words") <= F.col("from") + F.col("size") + slack))
    notices = checked.groupBy("row", "entry", "from").agg(F.countDistinct("phrase").alias("n"), F.max("needed").alias("needed"), F.max(F.col("votes") / F.col("possible")).alias("share")).where("n = needed")
    notices = notices.groupBy("row").agg(F.collect_set("entry").alias("notices"), F.max(F.least(F.lit(1.0), "share")).alias("share"))

    label = F.element_at(F.create_map(*[F.lit(x) for pair in BASE.items() for x in pair]), F.col("phrase"))
    base = phrases.where(F.col("phrase").isin(list(BASE))).groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("start").cast("long").alias("first_word"), F.max("start").cast("long").alias("last_word"), F.collect_set(label).alias("base")
    )
    none = F.array().cast("array<string>")
    result = rows.select("row", "doc_id", "n_words").join(base, "row", "left").join(notices, "row", "left")
    score = F.when(F.col("share").isNotNull(), 0.6 + 0.4 * F.col("share")).when(F.col("n_base") > 0, 0.6).otherwise(0.0)
    return result.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("notices", none))), ",").alias("labels"),
        F.round(score, 4).alias("score"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
