"""Licences of files: statements and licence files against templates, and inheritance down the directories.

A unit is a line of a file, a run of up to four neighbouring lines, a paragraph, a block of comment lines, or the
whole text of a licence file, so that a header is seen however it is wrapped. Units and templates are sparse
TF-IDF vectors; a file declares the licence of its best unit by cosine. A file that declares none takes the
licence of the nearest directory at or above it that has a licence file. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.staging import staged

# Usual statements and opening words by licence. Fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("ISC", "Released under the ISC License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal, public domain dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of "
                 "the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                 "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
                 "License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met: 1. Redistributions of source code must retain "
                     "the above copyright notice, this list of conditions and the following disclaimer. "
                     "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
                     "conditions and the following disclaimer in the documentation and/or other materials provided "
                     "with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission."),
)
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
_SIGNS = r"[^\p{L}\p{N}]+"
_PARAGRAPH = r"\n[^\p{L}\p{N}]*\n"
_NO_COMMENT = r"(?m)^(?![ \t]*(?:#|//|/\*|\*|--|;|%|<!--)).*$"
RUN_LINES = 4
BROADCAST_DIRECTORIES = 100_000
BROADCAST_WORDS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), _SIGNS, " "), " "), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _idf(documents: int, often: int) -> float:
    return math.log((1 + documents) / (1 + often)) + 1


def _constants(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, sorted(words))).cast("array<string>")


def telling_words(weights: dict[str, float], threshold: float, often: dict[str, int]) -> set[str]:
    """Words of a template of which any unit of a cosine of ``threshold`` has one.

    The most frequent words that together stay below ``threshold`` of the template's length can't do alone.
    """
    length = math.sqrt(sum(w * w for w in weights.values()))
    common, square = set(), 0.0
    for word, weight in sorted(weights.items(), key=lambda x: (-often.get(x[0], 0), x[1], x[0])):
        square += weight * weight
        if math.sqrt(square) >= threshold * length * (1 - 1e-9):
            break
        common.add(word)
    return set(weights) - common


def least_shared(weights: dict[str, float], threshold: float) -> int:
    """How many distinct words of a template any unit of a cosine of ``threshold`` has at least.

    The cosine is at most the part of the template's length that its shared words make up.
    """
    length = math.sqrt(sum(w * w for w in weights.values()))
    square = 0.0
    for k, weight in enumerate(sorted(weights.values(), reverse=True), 1):
        square += weight * weight
        if math.sqrt(square) >= threshold * length * (1 - 1e-9):
            return k
    return len(weights)


def _units(files: DataFrame, pattern: str) -> DataFrame:
    """``path, unit`` of every unit that ``pattern`` finds a word in; a run begins and ends with such a line."""
    rows = files.where(F.col("text").rlike(pattern)).withColumn("lines", F.split("text", "\n", -1))
    rows = rows.withColumn("telling", F.transform("lines", lambda line: line.rlike(pattern)))
    last = F.size("lines") - 1

    def runs(first: Column) -> Column:
        ends = F.sequence(first, F.least(first + F.lit(RUN_LINES - 1), last))
        ends = F.filter(ends, lambda k: F.get("telling", k))
        return F.transform(ends, lambda k: F.array_join(F.slice("lines", first + 1, k - first + 1), "\n"))

    starts = F.filter(F.sequence(F.lit(0), last), lambda k: F.get("telling", k))
    none = F.array().cast("array<string>")
    longer = F.concat(
        F.split("text", _PARAGRAPH, -1), F.split(F.regexp_replace("text", _NO_COMMENT, "\u0000"), "\u0000", -1))
    longer = F.when(last > 0, F.filter(longer, lambda unit: unit.rlike(pattern))).otherwise(none)
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array("text")).otherwise(none)
    units = F.concat(F.flatten(F.transform(starts, runs)), longer, whole)
    return rows.select("path", F.explode(F.array_distinct(F.transform(units, lambda u: F.trim(u)))).alias("unit"))


def declared(
    df: DataFrame, path_col: str, text_col: str, templates=TEMPLATES, threshold: float = 0.8,
) -> DataFrame:
    """``path, license, score`` of files with a unit of a cosine of ``threshold`` or more; see ``license_scan``."""
    spark = df.sparkSession
    files = df.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    files = files.where("path is not null and text is not null")
    counts = [(name, Counter(template_words(text))) for name, text in templates]
    vocabulary = sorted({w for _, words in counts for w in words})
    facts = files.count()
    often = staged(files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word")).groupBy("word").agg(
        F.count("*").alias("n")))
    frequent = {r.word: r.n for r in often.where(F.col("word").isin(vocabulary)).collect()}
    idf = {w: _idf(facts, frequent.get(w, 0)) for w in vocabulary}
    vectors = [(name, {w: k * idf[w] for w, k in words.items()}) for name, words in counts]
    # Words that no file has find nothing.
    telling = sorted(set().union(*(telling_words(v, threshold, frequent) for _, v in vectors)) & set(frequent))
    pattern = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, telling)) + r")(?![\p{L}\p{N}])" if telling else "(?!)"
    units = _units(files, pattern).withColumn("hits", F.array_intersect(_words(F.col("unit")), _constants(frequent)))
    enough = [F.size(F.array_intersect("hits", _constants(v))) >= least_shared(v, threshold) for _, v in vectors]
    units = units.where(reduce(or_, enough)).select("path", "unit").distinct()
    units = staged(units.withColumn("number", F.monotonically_increasing_id()))
    rows = [(k, name, w, x / math.sqrt(sum(y * y for y in v.values())))
            for k, (name, v) in enumerate(vectors) for w, x in v.items()]
    of_templates = spark.createDataFrame(rows, "template int, license string, word string, weight double")
    spelled = units.select("number", F.explode(_words(F.col("unit"))).alias("word"))
    terms = spelled.groupBy("number", "word").agg(F.count("*").alias("times"))
    # Every word of a unit is a word of a file.
    weights = staged(often.join(spelled.select("word").distinct(), "word").select(
        "word", (F.log(F.lit(1.0 + facts) / (1 + F.col("n"))) + 1).alias("idf")))
    if weights.count() <= BROADCAST_WORDS:
        weights = F.broadcast(weights)
    terms = terms.join(weights, "word").withColumn("weight_here", F.col("times") * F.col("idf"))
    norms = terms.groupBy("number").agg(F.sqrt(F.sum(F.col("weight_here") * F.col("weight_here"))).alias("norm"))
    products = terms.join(F.broadcast(of_templates), "word").groupBy("number", "template", "license").agg(
        F.sum(F.col("weight_here") * F.col("weight")).alias("product"))
    scores = products.join(norms, "number").select(
        "number", "license", F.least(F.lit(1.0), F.round(F.col("product") / F.col("norm"), 9)).alias("score"))
    best = scores.where(F.col("score") >= threshold).groupBy("number").agg(
        F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"))
    return units.join(best, "number").groupBy("path").agg(F.min("best").alias("best")).select(
        "path", "best.license", (-F.col("best.less")).alias("score"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(
    df: DataFrame, path_col: str = "path", text_col: str = "text", templates=TEMPLATES, threshold: float = 0.8,
) -> DataFrame:
    """``path, license, basis, score`` of each distinct path.

    ``basis`` is ``declared`` for a licence of the file's own, ``inherited`` for that of the nearest directory
    upwards with a licence file that declares one (``score`` is that file's), or null. Of several the higher score
    wins, then the name of the licence. Document frequencies count all rows with a path and a text, for
    every word of a unit. Rows without a path are left out; a null text declares nothing; texts of a repeated
    path belong to one file, each with units of its own. An empty table gives an empty result.
    """
    paths = df.select(F.col(path_col).cast("string").alias("path")).where("path is not null").distinct()
    own = staged(declared(df, path_col, text_col, templates, threshold))
    given = own.where(F.col("path").rlike(LICENSE_FILE)).groupBy(_directory(F.col("path")).alias("above")).agg(
        F.min(F.struct((-F.col("score")).alias("less"), "license")).alias("best"))
    directories = paths.select(_directory(F.col("path")).alias("directory")).distinct()
    steps = F.split("directory", "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    ancestors = directories.select(
        "directory", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("above"))
    nearest = ancestors.join(given, "above").groupBy("directory").agg(
        F.max_by("best", F.length("above")).alias("from_above"))
    nearest = staged(nearest)
    if nearest.count() <= BROADCAST_DIRECTORIES:
        nearest = F.broadcast(nearest)
    rows = paths.join(own, "path", "left").withColumn("directory", _directory(F.col("path"))).join(
        nearest, "directory", "left")
    return rows.select(
        "path", F.coalesce("license", "from_above.license").alias("license"),
        F.when(F.col("license").isNotNull(), "declared").when(F.col("from_above").isNotNull(), "inherited").alias("basis"),
        F.coalesce("score", -F.col("from_above.less")).alias("score"))
