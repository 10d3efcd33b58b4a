"""License scan by a positional index of rare words, in DataFrame functions only.

Templates are short licence notices. A word's IDF is counted over all documents; the index holds, for each
template, the places of its ANCHORS highest-IDF words, so it is a table of a few rows a template that is sent to
all tasks, whatever the documents and however many templates. Of each file the index's words are exploded with
their places, once, and looked up in it by word; a place in the file minus the posting's place is a relative
position, and postings of a template that agree on it are an alignment. An alignment that holds LEAST_SHARE of
the template's anchor IDF, in LEAST_WORDS different words, is a candidate; it is reported if the template's
mandatory key phrases all stand in the file from the aligned start on, within the template's length and some
slack. The score is the share of the template's anchor IDF that is aligned.

The base labels are places where a fixed phrase stands word by word.

Only files with LEAST_WORDS different words of the index are exploded, and only those words of them.
Alignments are summed before the shuffle and dropped right after it. Defined results: a null text
counts as the empty text, with no words and no labels; repeated rows give repeated results; a null id is
kept; ties of IDF go by the word; a very long text is scanned whole; other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

#: Highest-IDF words of a template that are indexed; IDF share of them, and different ones, that an alignment needs.
ANCHORS, LEAST_SHARE, LEAST_WORDS = 8, 0.6, 4
#: Words of slack between an aligned template and the file.
SLACK = 12

#: Fixed value: what separates words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and labels, where a caller names no others.
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening words of public licence notices, with the phrases that must stand in a file: label, notice, key phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("permission is hereby granted free of charge", "without restriction")),
    ("mit", "released under the mit license see the license file for details", ("mit license",)),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain",)),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license",)),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license you may not use this file except in compliance with the license", ("common development and distribution license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose", ("permission is granted to anyone to use this software",)),
    ("boost", "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at", ("boost software license",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed do what the fuck you want to public license", ("what the fuck you want",)),
    ("artistic-2", "this program is free software you can redistribute it and or modify it under the terms of the artistic license version 2 0", ("artistic license",)),
    ("ofl", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at", ("open font license",)),
    ("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", ("licensed under the eupl",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("noncommercial sharealike",)),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ("noncommercial noderivatives",)),
    ("bsl-1-1", "use of this software is governed by the business source license included in the file license as of the change date specified in that file", ("business source license",)),
    ("sspl", "this program is free software you can redistribute it and or modify it under the terms of the server side public license version 1 as published by mongodb inc", ("server side public license",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means", ("all rights reserved", "may be reproduced")),
)


@cache
def vocabulary() -> tuple[str, ...]:
    return tuple(sorted({w for _, notice, _ in TEMPLATES for w in notice.split()}))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _array(values) -> Column:
    return F.array(*map(F.lit, values))


def idf(texts: DataFrame) -> dict[str, float]:
    """The IDF of each licence word over all documents; one number for each word of the templates comes to the driver."""
    # The empty word stands for the document itself.
    held = F.concat(F.array(F.lit("")), F.array_intersect(_array(vocabulary()), F.col("words")))
    counts = {r["w"]: r["n"] for r in texts.select(F.explode(held).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counts.get("", 0)
    return {w: max(1e-9, math.log((1 + n) / (1 + counts.get(w, 0)))) for w in vocabulary()}


def postings(weights: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """(word, template, place, share of the template's anchor IDF) of the anchors of every template."""
    out = []
    for k, (_, notice, _) in enumerate(TEMPLATES):
        words = notice.split()
        rare = sorted(set(words), key=lambda w: (-weights[w], w))[:ANCHORS]
        whole = sum(weights[w] for w in words if w in rare)
        out += [(w, k, place, weights[w] / whole) for place, w in enumerate(words) if w in rare]
    return out


def _aligned(texts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Columns id, hash, found, share: the labels of verified alignments."""
    index = postings(weights)
    rare = sorted({w for w, *_ in index})
    # Files that hold enough words of the index, with their words: few, and read again by the last step.
    files = cut(texts.where(F.size(F.array_intersect(_array(rare), F.col("words"))) >= LEAST_WORDS).dropDuplicates(["id", "hash"]))
    session = texts.sparkSession
    index = F.broadcast(session.createDataFrame(index, "word string, template int, place int, weight double"))  # ANCHORS rows a template and repeats
    kinds = [(k, label, len(notice.split()), list(keys)) for k, (label, notice, keys) in enumerate(TEMPLATES)]
    kinds = F.broadcast(session.createDataFrame(kinds, "template int, label string, size int, keys array<string>"))  # a row a template
    known = F.transform(F.col("words"), lambda w, at: F.when(w.isin(rare), F.struct(w.alias("word"), at.alias("at"))))
    places = files.select("id", "hash", F.explode(F.array_compact(known)).alias("w")).select("id", "hash", "w.word", "w.at")
    hits = places.join(index, "word").groupBy("id", "hash", "template", (F.col("at") - F.col("place")).alias("start"))
    near = hits.agg(F.least(F.lit(1.0), F.sum("weight")).alias("share"), F.collect_set("word").alias("met"))
    near = near.where((F.col("share") >= LEAST_SHARE) & (F.size("met") >= LEAST_WORDS)).drop("met").join(kinds, "template")
    near = near.alias("n").join(files.alias("f"), F.col("n.id").eqNullSafe(F.col("f.id")) & (F.col("n.hash") == F.col("f.hash")))
    stretch = F.concat(F.lit(" "), F.array_join(F.slice("words", F.greatest(F.col("start") - SLACK, F.lit(0)) + 1, F.col("size") + 2 * SLACK), " "), F.lit(" "))
    near = near.where(F.forall("keys", lambda phrase: stretch.contains(F.concat(F.lit(" "), phrase, F.lit(" ")))))
    return near.groupBy("n.id", "n.hash").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Of every row: `key`, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score.

    `phrases` has the base phrases (words joined by one space) and their labels.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    texts = docs.select(docs[key].alias("id"), F.xxhash64(whole).alias("hash"), words_of(whole).alias("words"))
    aligned = _aligned(texts, idf(texts))

    # Base: a piece of the line between two places of a phrase holds as many blanks as words.
    places = []
    for phrase, label in phrases.items():
        size = len(phrase.split())
        words = F.transform(F.split("line", f" {phrase}(?= )", -1), lambda g: F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit(""))))
        last = F.aggregate(F.slice(words, 1, F.size(words) - 1), F.lit(0), lambda a, b: a + b) + size * (F.size(words) - 2)
        place = F.struct(F.lit(label).alias("label"), (F.size(words) - 1).alias("n"), F.element_at(words, 1).alias("first"), last.alias("last"))
        places.append(F.when(F.col("line").contains(f" {phrase} "), place))
    rows = texts.select("id", "hash", F.size("words").cast("bigint").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))
    rows = rows.select("id", "hash", "n_words", F.array_compact(F.array(*places)).alias("base"))
    out = rows.alias("r").join(aligned.alias("m"), F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.hash") == F.col("m.hash")), "left")
    labels = F.transform("base", lambda b: b["label"])
    return out.select(
        F.col("r.id").alias(key),
        "n_words",
        F.aggregate("base", F.lit(0).cast("bigint"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(labels, F.coalesce("found", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
