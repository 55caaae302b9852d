"""Licence notices in texts: MinHash bands over windows retrieve templates, containment verifies them.

Texts and templates are lower-case runs of letters and digits. Templates fall in classes by length L,
doubling from 8 words; in each class texts are cut into windows of 2 L words, one every L, so an
occurrence of any template of the class lies inside one window. A window and a template are held
together where one MinHash value of their five-word shingles is equal (bands of one row); a class
has so many bands that a pair at the least accepted containment collides with a probability
of 0.9999 or more. A pair is reported if the window holds 0.8 of the template's shingles.

Windows without a cue word can't be matches and are not formed: the cues are chosen from the
templates such that more than a fifth of each template's shingles hold one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 5
LEAST = 0.8
MISS = 1e-4
FIRST_CLASS = 8
_WORD = "[\\p{L}\\p{N}]+"

# Notices of public licences.
TEMPLATES = {
    "mit-short": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def words_of(text: str) -> list[str]:
    """Lower-case words of a template."""
    return re.findall(r"[^\W_]+", text.lower())


def shingle_list(words: list[str]) -> list[str]:
    """Distinct five-word shingles, in order."""
    return list(dict.fromkeys(" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)))


def class_of(n: int) -> int:
    """Length class of a template of ``n`` words."""
    return max(FIRST_CLASS, 1 << (n - 1).bit_length())


def bands_of(length: int) -> int:
    """Bands for a class: the shortest template at the least containment is missed once in 1/MISS."""
    shortest = (WORDS if length == FIRST_CLASS else length // 2 + 1) - WORDS + 1
    shared, window = math.ceil(LEAST * shortest), 2 * length - WORDS + 1
    return math.ceil(math.log(MISS) / math.log(1 - shared / (shortest + window - shared)))


def cue_words(templates: dict[str, str]) -> list[str]:
    """Few words of which one stands in more than a fifth of each template's shingles.

    Words of seven letters or more, which general text seldom holds, where they suffice.
    """
    shingles = {k: [set(s.split()) for s in shingle_list(words_of(t))] for k, t in templates.items()}
    cues: set[str] = set()

    def lacking() -> list[str]:
        return [k for k, some in shingles.items() if sum(bool(s & cues) for s in some) <= (1 - LEAST) * len(some)]

    while left := lacking():
        share: dict[str, float] = {}
        for k in left:
            words = set().union(*shingles[k])
            for w in [w for w in words if len(w) >= 7 and w not in cues] or words:
                share[w] = share.get(w, 0) + sum(w in s and not s & cues for s in shingles[k]) / len(shingles[k])
        cues.add(max(sorted(share), key=lambda w: share[w]))
    return sorted(cues)


def scan(df: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, license, containment, n_windows, first_word``: a row for each template in a document.

    ``containment`` is the best window's, to six places; ``n_windows`` the windows that hold the
    template, ``first_word`` where the first of them starts. Whole texts are scanned; null and
    empty ones hold nothing. Rows that share a key are one document, null keys too. Templates
    need five words at least.
    """
    templates = TEMPLATES if templates is None else templates
    spark = df.sparkSession
    rows, lengths = [], sorted({class_of(len(words_of(t))) for t in templates.values()})
    for name, t in sorted(templates.items()):
        rows.append((name, class_of(len(words_of(t))), shingle_list(words_of(t))))
    bands = {length: bands_of(length) for length in lengths}
    most = max(bands.values())
    cues = cue_words(templates)
    grams = F.array_sort(F.array_distinct(F.transform("shingle", lambda s: F.xxhash64(s))))

    def signature(h: str, length: str):
        """MinHash values by band; bands beyond the class's number are left out."""
        count = F.element_at(F.create_map(*[F.lit(x) for pair in bands.items() for x in pair]), F.col(length))
        return F.transform(F.sequence(F.lit(1), count), lambda k: F.array_min(F.transform(h, lambda x: F.xxhash64(x, k))))

    known = spark.createDataFrame(rows, "license string, length int, shingle array<string>").withColumn("th", grams)
    # templates by bands, a fixed number of rows
    known = known.select("license", "length", "th", F.posexplode(signature("th", "length")).alias("band", "value"))

    has_cue = F.lit(False)
    for cue in cues:
        has_cue = has_cue | F.contains(F.lower(text), F.lit(cue))
    docs = df.where(has_cue).select(F.col(key).alias("id"), F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(cues))
    docs = docs.where(F.size("w") >= WORDS).withColumn("cue", at)
    starts = F.array_distinct(F.flatten(F.transform("cue", lambda c: F.array((c / F.col("length")).cast("int"), (c / F.col("length")).cast("int") - 1))))
    windows = (
        docs.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
        .withColumn("start", F.explode(F.filter(starts, lambda s: s >= 0)))
        .withColumn("first", F.col("start") * F.col("length"))
        .select("id", "length", "first", F.slice("w", F.col("first") + 1, 2 * F.col("length")).alias("part"))
        .where(F.size("part") >= WORDS)
        .withColumn("shingle", F.transform(F.sequence(F.lit(1), F.size("part") - WORDS + 1), lambda i: F.array_join(F.slice("part", i, WORDS), " ")))
        .select("id", "length", "first", grams.alias("h"))
    )
    pairs = windows.select("*", F.posexplode(signature("h", "length")).alias("band", "value")).join(F.broadcast(known), ["length", "band", "value"])
    share = F.size(F.array_intersect("h", "th")) / F.size("th")
    found = pairs.withColumn("share", share).where(F.col("share") >= LEAST).groupBy("id", "license", "first").agg(F.max("share").alias("share"))
    return found.groupBy(F.col("id").alias(key), "license").agg(
        F.round(F.max("share"), 6).alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("first").alias("first_word")
    )


def sql(templates: dict[str, str] | None = None) -> str:
    """The same over ``documents`` in DuckDB, every window held against every template."""
    templates = TEMPLATES if templates is None else templates
    values = ", ".join(f"('{k}', {class_of(len(words_of(t)))}, {shingle_list(words_of(t))!r})" for k, t in sorted(templates.items()))
    return f"""
WITH known(license, length, th) AS (VALUES {values}),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
windows AS (SELECT doc_id, length, unnest(generate_series(0, len(w) - 1, length)) AS first, w
  FROM docs, (SELECT DISTINCT length FROM known) WHERE len(w) >= {WORDS}),
cut AS (SELECT doc_id, length, first, list_slice(w, first + 1, first + 2 * length) AS part FROM windows),
grams AS (SELECT DISTINCT doc_id, length, first, unnest(list_transform(generate_series(1, len(part) - {WORDS} + 1), lambda i: array_to_string(list_slice(part, i, i + {WORDS} - 1), ' '))) AS g
  FROM cut WHERE len(part) >= {WORDS}),
wanted AS (SELECT license, length, len(th) AS n, unnest(th) AS g FROM known),
found AS (SELECT doc_id, license, first, count(*) / max(n) AS share FROM grams JOIN wanted USING (length, g) GROUP BY ALL HAVING count(*) / max(n) >= {LEAST})
SELECT doc_id, license, round(max(share), 6) AS containment, count(*) AS n_windows, CAST(min(first) AS INTEGER) AS first_word FROM found GROUP BY doc_id, license
"""
