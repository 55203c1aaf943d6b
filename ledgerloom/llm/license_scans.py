"""Licence scans through a positional index of rare words, in DataFrame functions only.

Templates are licence notices as word sequences; of each, the words of highest IDF (document frequencies
over the whole corpus) are indexed with template and position. All of a file's words in the index
are looked up, however many notices it holds. Each posting gives an offset, file position minus template
position; words of one notice agree on it. The share of the template's indexed IDF weight that agrees on
the best offset is the match, and a label also needs the template's mandatory phrases in the file.

Beside that stands the base: places where a label's phrase stands word by word.

Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z. Only files
holding a licence word get past the first filter, and only their licence words' positions are
exploded; they are grouped by file, template and offset, with partial aggregation, so that
many notices in one file or many files with one notice spread alike. Frequencies
gathered on the driver number at most the templates' words.

Defined cases: NULL and empty texts have no words, no place, empty labels and score 0; ties between
offsets go to the smaller offset; repeated rows and repeated doc_ids are judged row by row through
a key made of id and text (identical rows get identical results); an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import base

# Base phrases with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, notice words, mandatory phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ("general public license version 3",)),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation either version 3",
     ("free software foundation either version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ("copy modify and or distribute this software",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
    ("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license",
     ("creative commons attribution sharealike",)),
)
# Words of notices that are common in any prose.
COMMON = ("a an and any are as by can for from in into is it of on or that the this to under use with without work "
          "you free met person version 0 2 3 v").split()

#: Runs of anything but the words' characters, before lower-casing A-Z.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    """Production parameters."""

    #: Distinct words of a template that are indexed.
    rarest: int = 12
    #: Share of the template's indexed weight that must agree on one offset.
    least_match: float = 0.6


LICENCE_WORDS = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()} - set(COMMON))


def spaced(text: Column) -> Column:
    """The lower-cased words with one space around each; a single space if there is none."""
    return F.concat(F.lit(" "), F.btrim(F.translate(F.regexp_replace(text, GAPS, " "), UPPER, LOWER)), F.lit(" "))


def _word_count(line: Column) -> Column:
    inner = F.btrim(line)
    return F.when(inner == "", F.lit(0)).otherwise(
        F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit(""))) + 1
    ).cast("long")


def _places(line: Column, phrase: str) -> Column:
    """Word numbers at which the phrase starts, as the words before each place."""
    # Split on the phrase with its leading space; the next word's space stays for the next place.
    pieces = F.split(line, f" {phrase}(?= )")
    length = len(phrase.split())
    # (words seen before the end of this piece and the phrase after it, places)
    ends = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).cast("long").alias("seen"), F.array().cast("array<bigint>").alias("at")),
        lambda a, piece: F.struct(
            (a["seen"] + _word_count(piece) + length).alias("seen"),
            F.concat(a["at"], F.array(a["seen"] + _word_count(piece))).alias("at"),
        ),
        lambda a: a["at"],
    )
    return F.when(F.contains(line, F.lit(f" {phrase} ")), ends).otherwise(F.array().cast("array<bigint>"))


def base_places(documents: DataFrame) -> DataFrame:
    """One row per document: n_words, the sorted places of base phrases and their labels."""
    text = F.col("text")
    # Every base phrase ends in this word; other texts need no further look.
    line = F.when(F.rlike(text, F.lit("(?i)license")), spaced(text)).otherwise(" ")
    found = documents.select("doc_id", base.text_of().alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), line.alias("line"),
        F.size(_raw_words(text)).cast("long").alias("n_words"),
    )
    for phrase, label in BASE:
        found = found.withColumn(f"at_{label}", _places(F.col("line"), phrase))
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for _, label in BASE]))
    return found.select(
        "doc_id", "row_key", "n_words", labels.alias("base_list"),
        F.concat(*[F.col(f"at_{label}") for _, label in BASE]).alias("places"),
    )


def _raw_words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def licence_words(documents: DataFrame) -> DataFrame:
    """Files with a licence word: row_key, their licence words with positions, and the text line."""
    return (
        documents.select("doc_id", base.text_of().alias("text"))
        .withColumn("words", _raw_words(F.col("text")))
        .withColumn(
            "found",
            F.filter(
                F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                lambda x: F.lower(x["w"]).isin(LICENCE_WORDS),
            ),
        )
        .where(F.size("found") > 0)
        .select(
            F.xxhash64("doc_id", "text").alias("row_key"), spaced(F.col("text")).alias("line"),
            F.transform(
                "found", lambda x: F.struct(F.translate(x["w"], UPPER, LOWER).alias("w"), x["i"].alias("i"))
            ).alias("found"),
        )
    )


def inverse_frequencies(documents: DataFrame, files: DataFrame) -> dict[str, float]:
    """IDF of each licence word over all documents; at most as many values as the templates have words."""
    total = documents.count()
    seen = dict(
        files.select(F.explode(F.array_distinct(F.col("found.w"))).alias("w")).groupBy("w").count().collect()
    )
    return {w: math.log(1 + (total + 1) / (seen.get(w, 0) + 1)) for w in LICENCE_WORDS}


def _phrase_holds() -> Column:
    """Whether the template's mandatory phrases all stand in the line."""
    out = F.lit(False)
    for number, (_, _, phrases) in enumerate(TEMPLATES):
        all_in = F.lit(True)
        for phrase in phrases:
            all_in &= F.contains(F.col("line"), F.lit(f" {phrase} "))
        out = F.when(F.col("template") == number, all_in).otherwise(out)
    return out


def template_matches(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """row_key, template, label, offset and match of every template that a file fits."""
    spark = documents.sparkSession
    files = base.stored(licence_words(documents), "licence-words")
    idf = inverse_frequencies(documents, files)
    rows = []
    for number, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        rarest = sorted(idf.keys() & set(words), key=lambda w: (-idf[w], w))[: settings.rarest]
        rows += [(w, number, i, idf[w]) for i, w in enumerate(words) if w in rarest]
    postings = spark.createDataFrame(rows, "w string, template int, template_at int, weight double")
    looked_up = (
        files.select("row_key", F.explode("found").alias("x"))
        .select("row_key", F.col("x.w").alias("w"), F.col("x.i").alias("i"))
        .distinct()
    )
    full = postings.groupBy("template").agg(F.sum("weight").alias("full"))
    aligned = (
        looked_up.join(F.broadcast(postings), "w")
        .groupBy("row_key", "template", (F.col("i") - F.col("template_at")).alias("offset"))
        .agg(F.sum("weight").alias("agreed"))
        .groupBy("row_key", "template")
        .agg(F.max(F.struct("agreed", (-F.col("offset")).alias("back"))).alias("best"))
        .join(F.broadcast(full), "template")
        .select("row_key", "template", (-F.col("best.back")).alias("offset"),
                (F.col("best.agreed") / F.col("full")).alias("match"))
        .where(F.col("match") >= settings.least_match)
    )
    label = F.element_at(F.array(*[F.lit(t[0]) for t in TEMPLATES]), F.col("template") + 1)
    return (
        aligned.join(files.select("row_key", "line").dropDuplicates(["row_key"]), "row_key")
        .where(_phrase_holds())
        .select("row_key", "template", label.alias("label"), "offset", F.round(F.least("match", F.lit(1.0)), 6).alias("match"))
    )


def scan(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every document with the base figures, all labels and the best match."""
    matches = (
        template_matches(documents, settings)
        .groupBy("row_key")
        .agg(F.collect_set("label").alias("found"), F.max("match").alias("match"))
    )
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_list", F.coalesce("found", none)))
    return (
        base_places(documents)
        .join(matches, "row_key", "left")
        .select(
            "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
            F.array_min("places").alias("first_word"), F.array_max("places").alias("last_word"),
            F.array_join(F.array_sort("base_list"), ",").alias("base_labels"),
            F.array_join(labels, ",").alias("labels"),
            F.coalesce("match", F.when(F.size("base_list") > 0, 0.5).otherwise(0.0)).alias("score"),
        )
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(base.table(spark, sf_dir, "documents"))
