"""Licence scans with a positional rare-token index over words.

A template is a sequence of words with a label. The index files it under the rarest word of its key phrase, by document
frequency over all texts, with that word's place in it. The key phrase must stand in full, so every place that counts
has that word, and no other word needs an entry. Every text is cut into words once; where a filed word stands, the template's
other words are compared at their relative places. A licence phrase counts if all words are there. Other templates
count if enough of their words are at their place and the mandatory key phrase stands there in full.

Templates are given by the caller as a list, so the index is part of the plan. All work is DataFrame expressions in the
scan of the texts: nothing is shuffled but the frequency of some hundred words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is between words when letters are not lowered yet: ASCII but digits and letters.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ENOUGH = 0.75


@dataclass(frozen=True)
class Template:
    """label, lower-case words, and the key phrase that must stand in full (all words, if none is given)."""

    label: str
    text: str
    key: str = ""

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> tuple[int, int]:
        """First and last place, exclusive, of the key phrase in the template."""
        words, key = self.words, (self.key or self.text).split()
        return next((i, i + len(key)) for i in range(len(words)) if words[i : i + len(key)] == key)


BASE = (
    Template("mit", "under the mit license"),
    Template("apache-2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc"),
)
MORE = (
    Template("gpl", "licensed under the gnu general public license", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by", "creative commons attribution"),
    Template("cc0", "cc0 1 0 universal"),
    Template("all-rights-reserved", "all rights reserved"),
)


def words_of(text: Column) -> Column:
    """Words in their own case; the empty string splits off nothing."""
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), lambda w: w != "")


def rarity(documents: DataFrame, words: list[str]) -> dict[str, int]:
    """Documents that hold each of the given words."""
    found = documents.select(F.array_distinct(words_of(F.col("text"))).alias("words")).select(F.explode("words").alias("word"))
    low = found.where(F.lower("word").isin(words)).select(F.translate("word", UPPER, LOWER).alias("word"))
    return {row["word"]: row["n"] for row in low.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _entry(template: Template, count: dict[str, int]) -> int:
    """Place of the word under which the template is filed: the key phrase's rarest, the first of equally rare ones."""
    return min(range(*template.key_at), key=lambda i: (count.get(template.words[i], 0), i))


def _at(words: Column, place: Column, template: Template, entry: int) -> Column:
    """The words of the text where the template would stand, if its word `entry` is at `place`, lowered; shorter at the ends."""
    start = place - entry
    size = F.lit(len(template.words)) + F.least(start, F.lit(0))
    return F.transform(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.greatest(size, F.lit(0))), lambda w: F.translate(w, UPPER, LOWER))


def scanned(
    documents: DataFrame, base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE, enough: float = ENOUGH
) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of documents.

    n_base counts the places of all base templates, first_word and last_word are the least and greatest of them (words
    from 0; null without any). labels adds those of the other templates; both lists are sorted, distinct and joined by
    commas. score is the largest share of a template's words found at their places, of templates whose key phrase is
    there; 0 if none. Null and empty texts have no words; rows without doc_id and repeated rows are scanned like
    others; an empty table gives an empty result; other columns are ignored.
    """
    vocabulary = sorted({w for t in (*base, *more) for w in t.words[slice(*t.key_at)]})
    count = rarity(documents, vocabulary)
    filed = [(i, t, _entry(t, count)) for i, t in enumerate((*base, *more))]
    entries = sorted({t.words[e] for _, t, e in filed})
    rows = documents.select(F.col("doc_id").cast("long"), words_of(F.col("text")).alias("words"))
    marked = F.transform("words", lambda w, i: F.when(F.lower(w).isin(entries), i))
    rows = rows.withColumn("places", F.filter(marked, lambda i: i.isNotNull()))

    def hits(i: int, template: Template, entry: int) -> Column:
        """struct(template, start, share) where the template stands well enough."""
        words = F.col("words")
        first, last = template.key_at
        here = lambda p: F.translate(F.get(words, p), UPPER, LOWER) == template.words[entry]

        def found(place: Column) -> Column:
            context = _at(words, place, template, entry)
            own = F.array(*map(F.lit, template.words))
            # at the start of a text the template's first words are missing: the context is compared with its end
            own = F.slice(own, F.greatest(F.lit(entry) - place, F.lit(0)) + 1, len(template.words))
            same = F.aggregate(F.zip_with(context, own, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
            key = F.array(*map(F.lit, template.words[first:last]))
            stands = F.slice(context, F.greatest(F.lit(first + 1) - F.greatest(F.lit(entry) - place, F.lit(0)), F.lit(1)), last - first) == key
            return F.struct(F.lit(i).alias("template"), (place - entry).alias("start"), F.when(stands, same / len(template.words)).otherwise(0.0).alias("share"))

        least = 1.0 if i < len(base) else enough
        return F.filter(F.transform(F.filter("places", here), found), lambda h: h["share"] >= least)

    every = F.array_distinct(F.concat(*(hits(i, t, e) for i, t, e in filed)))
    rows = rows.select("doc_id", F.size("words").alias("n_words"), F.when(F.size("places") > 0, every).alias("hits"))
    rows = rows.withColumn("hits", F.coalesce("hits", F.expr("array()").cast("array<struct<template:int,start:int,share:double>>")))
    names = F.array(*(F.lit(t.label) for t in (*base, *more)))
    label = lambda h: F.get(names, h["template"])
    places = F.filter("hits", lambda h: h["template"] < len(base))
    joined = lambda found: F.array_join(F.sort_array(F.array_distinct(F.transform(found, label))), ",")
    starts = F.transform(places, lambda h: h["start"].cast("long"))
    return rows.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(places).alias("base_labels"),
        joined(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"),
    )
