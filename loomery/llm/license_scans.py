"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are laid out in blocks of twice a template class's length, one class
length apart, so that any run of a class's words lies in a block whole. A template
matches a block that holds at least its threshold of the template's distinct words.
Words are ordered by their frequency over all texts, rarest first. With n distinct
template words and a = ceil(threshold * n), a matching pair shares one of the first
n - a + 1 template words (prefix filter), which only blocks around such a word can
do, so only those are built; they need a template words (length filter), and the
words from the first shared one on must suffice on both sides (position filter).
The first shared word alone emits a pair, so none comes twice. The overlap decides.

Templates are a small table given to the driver, and words outside them can't add to
an overlap: only theirs are counted and ordered, at most the templates' words.

An exact look follows: a template may name words that have to stand together in the
block, which tells versions of one license apart; a phrase (threshold 1) counts the
places where its words stand consecutively, each in the one block in whose first half
it begins.

Defined cases: null and empty texts have no words and no labels; texts of any length
are read whole; repeated rows are scanned alike, each for itself; an empty table gives
an empty result; extra columns pass through, those named like a result column are
replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.columns import fresh, named
from loomery.session import durable

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Template classes by length in words; longer ones double on.
LEAST_CLASS = 16
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def split_words(text: str) -> list[str]:
    """A template's words, by the rule that texts are split by."""
    return [w for w in re.split(_BREAK, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


@dataclass(frozen=True)
class Template:
    """A license's notice; ``needs`` has to stand in the block word by word. A phrase is its own need and counts its places."""

    label: str
    text: str
    needs: str = ""
    threshold: float = 0.8
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return split_words(self.text)

    @property
    def least(self) -> int:
        """Distinct words that a matching block shares at least."""
        return max(1, math.ceil(round(self.threshold * len(set(self.words)), 9)))

    @property
    def size(self) -> int:
        """The class length: no block loses a run of so many words."""
        size = LEAST_CLASS
        while size < len(self.words):
            size *= 2
        return size


#: The phrases that the base labels are defined by.
PHRASES = (
    Template("mit", "under the mit license", threshold=1.0, phrase=True),
    Template("apache-2", "apache license version 2", threshold=1.0, phrase=True),
    Template("cc-by-nc", "cc by nc", threshold=1.0, phrase=True),
)

#: Public notices of common licenses, with the words that tell them apart.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "granted free of charge to any person"),
    Template("mit", "Licensed under the terms of the MIT License", "mit license"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license"),
    Template("apache-2", "Released under the Apache License 2.0", "apache license 2 0"),
    Template("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "either version 2 of the license"),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", "gnu general public license version 2"),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "either version 3 of the license"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", "gnu general public license version 3"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    Template("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", "eclipse public license"),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", "boost software license"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    Template("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("cc0", "released into the public domain under the terms of CC0 1.0 Universal", "cc0 1 0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "attribution noncommercial 4 0"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "attribution sharealike 4 0"),
    Template("cc-by-nd", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "attribution noderivatives 4 0"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", "commons attribution 4 0"),
    Template("cc-by-sa", "Text is available under CC BY-SA 4.0", "cc by sa"),
)


def _words(text: str) -> Column:
    lower = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _BREAK), "")


def word_order(docs: DataFrame, templates: Sequence[Template], text: str = "text") -> list[str]:
    """The templates' words by their frequency over all texts, rarest first, ties by the word; no more rows than templates have words."""
    known = sorted({w for t in templates for w in t.words})
    hits = docs.select(F.explode(F.filter(_words(text), lambda w: w.isin(known))).alias("word"))
    counts = {r["word"]: r["n"] for r in hits.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def _prefixes(templates: Sequence[Template], order: list[str]) -> list[tuple]:
    """(size, word, place, template, label, needs, phrase, n, least, words): each template under its rarest words."""
    rank, out = {w: n for n, w in enumerate(order)}, []
    for number, t in enumerate(templates):
        words = sorted(set(t.words), key=rank.__getitem__)
        for place, word in enumerate(words[: len(words) - t.least + 1]):
            out.append((t.size, word, place, number, t.label, " ".join(split_words(t.needs)), t.words if t.phrase else None, len(words), t.least, words))
    return out


def _blocks_of(words: Column, size: int, rare: list[str]) -> Column:
    """Blocks of one class around its prefix words: (size, block number, words)."""
    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(rare))
    numbers = F.flatten(F.transform(hits, lambda i: F.array(F.floor(i / size), F.floor(i / size) - 1)))
    numbers = F.filter(F.array_distinct(numbers), lambda b: b >= 0)
    return F.transform(numbers, lambda b: F.struct(F.lit(size).alias("size"), b.alias("block"), F.slice(words, (b * size + 1).cast("int"), F.lit(2 * size)).alias("words")))


def _empty_blocks() -> Column:
    return F.array().cast("array<struct<size:int,block:bigint,words:array<string>>>")


def lay_blocks(docs: DataFrame, templates: Sequence[Template], order: list[str], text: str = "text") -> DataFrame:
    """Rows of ``docs`` without their text, with a number ``row``, ``n_words`` and the ``blocks`` that may match a template; kept in the cluster's folder."""
    sizes: dict[int, list[str]] = {}
    for size, word, *_ in _prefixes(templates, order):
        if word not in sizes.setdefault(size, []):
            sizes[size].append(word)
    rare = sorted({w for ws in sizes.values() for w in ws})
    keep = [c for c in docs.columns if not named(c, text, "row", "blocks", *RESULTS)]
    (at,) = fresh([*keep, "row", "blocks", *RESULTS], "words")
    split = docs.select(*[F.col(f"`{c}`") for c in keep], _words(text).alias(at))
    blocks = F.when(F.exists(at, lambda w: w.isin(rare)), F.concat(*[_blocks_of(F.col(at), n, ws) for n, ws in sizes.items()])).otherwise(_empty_blocks())
    return durable(split.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias("row"), F.size(at).cast("long").alias("n_words"), blocks.alias("blocks")))


def matching_blocks(laid: DataFrame, templates: Sequence[Template], order: list[str]) -> DataFrame:
    """(row, start, template, label, containment, places): every block, by its first word, that a template matches; places of phrases from their first word."""
    kind = "size int, word string, place int, template int, label string, needs string, phrase array<string>, n int, least int, own array<string>"
    index = laid.sparkSession.createDataFrame(_prefixes(templates, order), kind)
    each = laid.select("row", F.explode("blocks").alias("b")).select("row", "b.size", "b.block", "b.words")
    # The order of the first array stays, so a block's template words come rarest first.
    ranked = each.withColumn("held", F.array_intersect(F.array(*map(F.lit, order)), F.col("words")))
    fewest = {t.size: min(x.least for x in templates if x.size == t.size) for t in templates}
    least = F.coalesce(*[F.when(F.col("size") == s, F.lit(k)) for s, k in fewest.items()])
    prefix = F.slice("held", 1, F.greatest(F.size("held") - least + 1, F.lit(0)))
    probes = ranked.select("row", "size", "block", "words", "held", F.posexplode(prefix).alias("at", "word"))
    met = probes.join(F.broadcast(index), ["size", "word"])
    met = met.where((F.size("held") >= F.col("least")) & (F.least(F.col("n") - F.col("place"), F.size("held") - F.col("at")) >= F.col("least")))
    met = met.withColumn("common", F.array_intersect("own", "held"))
    met = met.where((F.get("common", F.lit(0)) == F.col("word")) & (F.size("common") >= F.col("least")))
    spaced = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    met = met.where((F.col("needs") == "") | spaced.contains(F.concat(F.lit(" "), "needs", F.lit(" "))))
    first_half = F.sequence(F.lit(0), F.least(F.size("words"), F.col("size")) - 1)
    places = F.filter(first_half, lambda p: F.slice("words", p + 1, F.size("phrase")) == F.col("phrase"))
    start = F.col("block") * F.col("size")
    places = F.when(F.col("phrase").isNotNull(), F.transform(places, lambda p: (start + p).cast("long")))
    return met.select("row", start.alias("start"), "template", "label", (F.size("common") / F.col("n")).alias("containment"), places.alias("places"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = PHRASES + NOTICES, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score`` to ``docs``; the text is dropped.

    ``score`` is the highest containment of a template that gives a label, 0 without labels.
    """
    order = word_order(docs, templates, text)
    laid = lay_blocks(docs, templates, order, text)
    found = matching_blocks(laid, templates, order).where("places IS NULL OR size(places) > 0")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    summed = found.groupBy("row").agg(
        F.sum(F.when(F.col("places").isNotNull(), F.size("places"))).cast("long").alias("n_base"),
        F.min(F.get("places", F.lit(0))).alias("first_word"),
        F.max(F.element_at("places", -1)).alias("last_word"),
        joined(F.when(F.col("places").isNotNull(), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("containment").alias("score"),
    )
    keep = [c for c in laid.columns if c not in ("row", "blocks", "n_words")]
    out = laid.drop("blocks").alias("d").join(summed.alias("s"), F.col("d.row") == F.col("s.row"), "left")
    zeros = {"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}
    results = [F.coalesce(f"s.{c}", F.lit(zeros[c])).alias(c) if c in zeros else F.col(f"s.{c}").alias(c) for c in RESULTS[1:]]
    return out.select(*[F.col(f"d.`{c}`") for c in keep], "d.n_words", *results)
