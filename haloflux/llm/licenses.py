"""Licence scans: TF-IDF cosine of passages to licence templates, then inheritance along paths.

Each line of a file, the file as a whole, and each window of as many words as a template has (a sixteenth of
that apart, or one word if that is more), which needs no regard to lines, is a passage.  Passages and templates are sparse vectors of
word counts times the words' inverse document frequency over all files (words that no template has
count as occurring nowhere else), and meet in a join on words.  A passage whose cosine to a template
reaches ``STATES`` states that licence for its file.  A file is a licence file, which holds for its
directory, if it does so as a whole, in passages with ``LICENSE_SHARE`` of its words (windows count from their
first to their last word of the template), or in any passage and is named like one.  A file that states none inherits from its nearest ancestor directory with a licence
file, found by joining ancestor paths.

Before vectors are built, files and lines are dropped that lack every word without which no cosine
can reach the threshold: a template's remaining words alone have a smaller norm.  Windows are built for the
templates of whose words a file has enough for that, and get a norm if their words of the template alone don't
rule the threshold out.  Nothing else is skipped, and no passage, file or directory has a cap.

Of several licences the one with the highest cosine counts (ties: that with the highest cosine to a whole
licence text, then alphabetical); in a directory, files
with a licence file's name go first.  Null and empty texts
state none but may inherit; rows with a null path are treated as files at the root without a name; rows that repeat a path
count as one file, which states what any of the rows states; extra columns are ignored; an empty table gives no rows.  DataFrame functions only.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloflux.llm.scratch import written

STATES = 0.75
#: Share of a file's words in lines that state a licence from which it is a licence file.
LICENSE_SHARE = 0.25
_WORD = r"([a-z0-9]+(?:[.-][a-z0-9]+)*)"

#: Words from which a template is a whole licence text.
WHOLE = 90
#: Windows begin this part of their length apart.
STRIDES = 16

# Notices, titles and whole texts of common licences (fixed values: public texts).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    *((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
]
_FILE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.-].*)?$"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD))


def template_weights(templates: list[tuple[str, str]], frequency: dict[str, int], files: int) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float]:
    """(template, licence, word, unit weight) rows, inverse frequencies of template words, and that of any other word."""
    import re

    def idf(word: str) -> float:
        return math.log((1 + files) / (1 + frequency.get(word, 0))) + 1

    rows, known = [], {}
    for k, (licence, text) in enumerate(templates):
        counts: dict[str, int] = {}
        for w in re.findall(_WORD, text.lower()):
            counts[w] = counts.get(w, 0) + 1
        known |= {w: idf(w) for w in counts}
        norm = math.sqrt(sum((n * known[w]) ** 2 for w, n in counts.items()))
        rows += [(k, licence, w, n * known[w] / norm) for w, n in sorted(counts.items())]
    return rows, known, math.log(1 + files) + 1


def needed_words(rows: list[tuple[int, str, str, float]], known: dict[str, float], threshold: float) -> list[str]:
    """Words, the rarest that do, of which a passage must have one to reach the threshold against any template."""
    needed: set[str] = set()
    for k in {r[0] for r in rows}:
        own = sorted((known[word], w, word) for t, _, word, w in rows if t == k)
        while own and sum(w * w for _, w, _ in own) >= threshold**2 * 0.999:
            needed.add(own.pop()[2])
    return sorted(needed)


def words(of: list[str]) -> Column:
    return F.split(F.lit(" ".join(of)), " ")


def document_frequency(files: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of files having each of the words; one row per word reaches the driver."""
    own = F.array_intersect(words_of(F.col("text")), words(vocabulary))
    return {r["word"]: r["n"] for r in files.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def window_cosines(kept: DataFrame, weights: DataFrame, inverse: DataFrame, other: float, vocabulary: list[str]) -> DataFrame:
    """(row, template, licence, whole, cosine, start, end) of windows that reach the threshold; start and end are their first and last word of the template."""
    enough = STATES**2 * 0.999
    had = kept.select("row", F.explode(F.array_intersect(words_of(F.col("text")), words(vocabulary))).alias("word")).join(weights, "word")
    fits = had.groupBy("row", "template").agg(F.sum(F.col("weight") * F.col("weight")).alias("mass")).where(F.col("mass") >= enough).select("row", "template")
    placed = kept.select("row", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    hits = placed.join(weights, "word").join(fits, ["row", "template"])
    stride = F.col("stride")
    first = F.greatest(F.floor((F.col("pos") - F.col("length") + stride) / stride), F.lit(0))
    hits = hits.withColumn("window", F.explode(F.sequence(first, F.floor(F.col("pos") / stride))))
    counted = hits.groupBy("row", "template", "window", "word").agg(F.count("*").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).join(weights, ["word", "template"])
    value = F.col("n") * F.col("inverse")
    keys = ["row", "template", "licence", "whole", "length", "stride", "window"]
    dots = counted.groupBy(*keys).agg(F.sum(value * F.col("weight")).alias("dot"), F.sum(value * value).alias("part"), F.min("lo").alias("start"), F.max("hi").alias("end"))
    able = written(dots.where(F.col("dot") * F.col("dot") >= enough * F.col("part")))  # read twice below
    cut = F.slice(words_of(F.col("text")), (F.col("window") * stride + 1).cast("int"), F.col("length"))
    spans = able.select("row", "window", "length", "stride").distinct().join(kept.select("row", "text"), "row")
    each = spans.select("row", "window", "length", F.explode(cut).alias("word")).groupBy("row", "window", "length", "word").agg(F.count("*").alias("n"))
    valued = each.join(inverse, "word", "left").withColumn("value", F.col("n") * F.coalesce(F.col("inverse"), F.lit(other)))
    norms = valued.groupBy("row", "window", "length").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    found = able.join(norms, ["row", "window", "length"]).withColumn("cosine", F.col("dot") / F.col("norm"))
    return found.where(F.col("cosine") >= STATES).select("row", "licence", "whole", "cosine", F.col("start").cast("long"), (F.col("end") + 1).cast("long").alias("end"))


def stated(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(path, licence, cosine, whole, file): licences stated by each file of (path, text), with the cosines to any template and to whole texts, and whether it is a licence file by its words."""
    import re

    spark = files.sparkSession
    sizes = [len(re.findall(_WORD, t.lower())) for _, t in templates]
    vocabulary = sorted({w for _, t in templates for w in re.findall(_WORD, t.lower())})
    size = files.count()
    rows, known, other = template_weights(templates, document_frequency(files, vocabulary), size)
    full = [(k, licence, w, v, known[w], sizes[k], max(1, sizes[k] // STRIDES), sizes[k] >= WHOLE) for k, licence, w, v in rows]
    weights = F.broadcast(spark.createDataFrame(full, "template int, licence string, word string, weight double, inverse double, length int, stride int, whole boolean"))  # the templates' words
    inverse = F.broadcast(spark.createDataFrame(sorted(known.items()), "word string, inverse double"))

    needed = words(needed_words(rows, known, STATES))

    def able(text: Column) -> Column:
        return F.coalesce(F.arrays_overlap(words_of(text), needed), F.lit(False))

    kept = written(files.where(able(F.col("text"))).select(F.monotonically_increasing_id().alias("row"), "path", "text"))  # few files, read several times below
    lines = kept.select("row", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("words", F.size(words_of(F.col("line"))))
    before = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).where(able(F.col("line")))
    totals = kept.select("row", F.lit(-1).alias("at"), F.col("text").alias("line"), F.size(words_of(F.col("text"))).alias("words"), F.lit(0).cast("long").alias("start"))
    passages = lines.unionByName(totals)
    counted = passages.select("row", "at", "words", "start", F.explode(words_of(F.col("line"))).alias("word")).groupBy("row", "at", "words", "start", "word").agg(F.count("*").alias("n"))
    valued = counted.join(inverse, "word", "left").withColumn("value", F.col("n") * F.coalesce(F.col("inverse"), F.lit(other))).drop("inverse")
    norms = valued.groupBy("row", "at").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = valued.join(weights, "word").groupBy("row", "at", "words", "start", "template", "licence", "whole").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    cosines = dots.join(norms, ["row", "at"]).withColumn("cosine", F.col("dot") / F.col("norm")).where(F.col("cosine") >= STATES)
    cosines = cosines.select("row", "licence", "whole", "cosine", "start", (F.col("start") + F.col("words")).alias("end"))
    found = written(cosines.unionByName(window_cosines(kept, weights, inverse, other, vocabulary)))  # read twice below

    paths = kept.select("row", "path", F.size(words_of(F.col("text"))).alias("words"))
    best = found.join(paths, "row").groupBy("path", "licence").agg(F.max("cosine").alias("cosine"), F.coalesce(F.max(F.when(F.col("whole"), F.col("cosine"))), F.lit(0.0)).alias("whole"))
    ahead = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("row", "start", "end").distinct().withColumn("until", F.coalesce(F.max("end").over(ahead), F.lit(0)))
    said = spans.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "until"), F.lit(0))).alias("said"))
    marked = said.join(paths, "row").groupBy("path").agg(F.max(F.col("said") >= LICENSE_SHARE * F.col("words")).alias("file"))
    return best.join(marked, "path").select("path", "licence", "cosine", "whole", "file")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per path: licence, origin (stated, inherited or none), cosine, and the directory it comes from."""
    files = files.select(F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(text_col).alias("text"))
    found = stated(files, templates)
    first = F.min_by(F.struct("licence", "cosine", "file"), F.struct(-F.round("cosine", 9), -F.round("whole", 9), F.col("licence")))
    own = found.groupBy("path").agg(first.alias("_own")).select("path", "_own.*")
    named = F.regexp_extract("path", r"([^/]*)$", 1).rlike(_FILE_NAME)
    holders = own.where(F.col("file") | named).withColumn("unnamed", ~named)
    held = holders.groupBy(parent(F.col("path")).alias("ancestor")).agg(F.min_by("licence", F.struct("unnamed", -F.col("cosine"), F.col("licence"))).alias("held"))

    paths = files.select("path").distinct().withColumn("directory", parent(F.col("path")))
    directories = paths.select("directory").distinct()
    steps = F.split("directory", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    climbed = directories.select("directory", F.posexplode(F.array_distinct(ups)).alias("depth", "ancestor")).join(held, "ancestor")
    nearest = climbed.groupBy("directory").agg(F.max_by(F.struct("ancestor", "held"), "depth").alias("_near")).select("directory", "_near.*")

    joined = paths.join(own.drop("file"), "path", "left").join(nearest, "directory", "left")
    origin = F.when(F.col("licence").isNotNull(), "stated").when(F.col("held").isNotNull(), "inherited").otherwise("none")
    inherited = (F.col("licence").isNull()) & F.col("held").isNotNull()
    return joined.select("path", F.coalesce("licence", "held").alias("licence"), origin.alias("origin"), "cosine", F.when(inherited, F.col("ancestor")).alias("inherited_from"))
