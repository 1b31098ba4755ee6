"""License scans: TF-IDF cosine of statements to templates, then the nearest ancestor directory.

Column expressions only: no Python runs on the executors.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import saved, sized, table

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} License "
        "as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted"

#: fixed values: license identifiers, and what grants them: statements, the paragraphs of standard
#: headers and of licence texts, titles. SPDX tags are added by rule.
GRANTS = {
    "AGPL-3.0": (_GNU.format("Affero General Public", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
                 "This work is licensed under the GNU Affero General Public License, version 3."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": (_BSD + ".", _BSD + " provided that the following conditions are met:", "BSD 3-Clause License",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
                     "software without specific prior written permission."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
                  "Creative Commons Attribution 4.0 International"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                     "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                     "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC0-1.0": ("Creative Commons CC0 1.0 Universal", "Released under CC0 1.0."),
    "GPL-2.0": (_GNU.format("General Public", 2).replace("program is free software: you", "program is free software; you"),
                "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2."),
    "GPL-3.0": (_GNU.format("General Public", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                "This work is licensed under the GNU General Public License, version 3."),
    "ISC": ("ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
            "the above copyright notice and this permission notice appear in all copies."),
    "LGPL-3.0": (_GNU.format("Lesser General Public", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
                 "This work is licensed under the GNU Lesser General Public License, version 3."),
    "MIT": ("Released under the MIT License.", "The MIT License (MIT)", "MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
            "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0",
                "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
}

#: template name (license#number) to its words; several templates of a license compete with those of all others
TEMPLATES = {f"{name}#{k}": text for name, texts in GRANTS.items() for k, text in enumerate((*texts, f"SPDX-License-Identifier: {name}"))}

#: a statement of this cosine or more has the template's license
LEAST = 0.75
#: a text is a licence file if this share of its words or more is in such statements
FILE_SHARE = 0.5


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def statements(text: Column) -> Column:
    """A text's lines, cut behind sentence marks; and the sentences and blocks of wrapped headers
    and licence texts: those of several lines, as one, without the marks that begin comment lines."""
    lines = F.split(F.regexp_replace(text, r"([.!?;])[ \t]+", "$1\n"), "\n")
    bare = F.regexp_replace(text, r"(?m)^[ \t]*(?:[#*;%]+|//+|/\*+|--+)[ \t]?", "")
    blocks = F.split(F.regexp_replace(bare, r"([.!?;])[ \t\n]+|\n[ \t]*\n[ \t\n]*", "$1\u0001"), "\u0001")
    wrapped = F.filter(blocks, lambda b: F.btrim(b, F.lit(" \t\n")).contains("\n"))
    return F.concat(lines, F.transform(wrapped, lambda b: F.replace(b, F.lit("\n"), F.lit(" "))))


def license_of(template: Column) -> Column:
    return F.substring_index(template, "#", 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def document_counts(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many texts there are, and how many have each word of the templates: as many rows as those have words."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    one = texts.select(F.array_intersect(_words(F.coalesce("text", F.lit(""))), known).alias("ws"))
    rows = one.select(F.explode(F.concat("ws", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    found = {r.w: r.n for r in rows}
    return found.pop("", 0), found


class Weights:
    """Inverse document frequencies of the templates' words, and the templates as vectors of length 1."""

    def __init__(self, texts: DataFrame, templates: dict[str, str]) -> None:
        self.vocabulary = sorted({w for t in templates.values() for w in words_of(t)})
        n, have = document_counts(texts, self.vocabulary)
        self.idf = {w: 1 + math.log((n + 1) / (have.get(w, 0) + 1)) for w in self.vocabulary}
        # other words weigh like words that no text has
        self.other = 1 + math.log(n + 1)
        self.vectors = {}
        for name, text in templates.items():
            v: dict[str, float] = {}
            for w in words_of(text):
                v[w] = v.get(w, 0) + self.idf[w]
            norm = math.sqrt(sum(x * x for x in v.values()))
            self.vectors[name] = {w: x / norm for w, x in v.items()}

    def anchors(self, least: float) -> list[str]:
        """Words of which a statement must have one to reach ``least``.

        The cosine is at most the length of the template's part that is shared,
        so the heaviest words are anchors until the rest is shorter than that.
        """
        out = set()
        for v in self.vectors.values():
            rest = 1.0
            for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
                if rest < least * least - 1e-9:
                    break
                out.add(w)
                rest -= x * x
        return sorted(out)


def own_licenses(files: DataFrame, weights: Weights, least: float) -> DataFrame:
    """``path, license, score, share`` of the files that state a license: the best statement's."""
    has = "(?i)(?<![a-z0-9])(?:" + "|".join(weights.anchors(least)) + ")(?![a-z0-9])"
    some = files.filter(F.col("text").rlike(has)).withColumn("file", F.xxhash64("path", "text"))
    cut = some.select("path", "file", F.posexplode(statements(F.col("text"))).alias("no", "line"))
    cut = cut.select("path", "file", "no", F.when(F.col("line").rlike(has), F.col("line")).alias("line"), F.size(_words(F.col("line"))).alias("n"))
    size = cut.groupBy("path", "file").agg(F.sum("n").alias("words"))
    key = ["path", "file", "no"]
    lines = cut.filter("line IS NOT NULL").dropDuplicates(key)
    counted = lines.select(*key, "n", F.explode(_words(F.col("line"))).alias("w")).groupBy(*key, "n", "w").agg(F.count("*").alias("tf"))
    pairs = lambda d: F.create_map(*[F.lit(x) for p in sorted(d.items()) for x in p])
    weight = F.col("tf") * F.coalesce(pairs(weights.idf)[F.col("w")], F.lit(weights.other))
    names = sorted(weights.vectors)
    dots = [F.sum(F.col("x") * F.coalesce(pairs(weights.vectors[m])[F.col("w")], F.lit(0.0))).alias(f"d{k}") for k, m in enumerate(names)]
    sums = counted.withColumn("x", weight).groupBy(*key, "n").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    # rounded, so that equal statements tie whatever the order of sums
    best = F.greatest(*[F.struct(F.round(F.col(f"d{k}") / F.col("norm"), 9).alias("score"), F.lit(-k).alias("k")) for k in range(len(names))])
    met = sums.withColumn("best", best).filter(F.col("best.score") >= least)
    by_file = met.groupBy("path", "file").agg(F.max("best").alias("best"), F.sum("n").alias("stated"))
    by_file = by_file.join(size, ["path", "file"]).withColumn("share", F.col("stated") / F.col("words"))
    # rows that repeat a path are one file: the best of them speaks
    one = by_file.groupBy("path").agg(F.max(F.struct("best", "share")).alias("b"))
    named = license_of(F.element_at(F.array(*[F.lit(m) for m in names]), (1 - F.col("b.best.k")).cast("int")))
    return one.select("path", named.alias("license"), F.col("b.best.score").alias("score"), F.col("b.share").alias("share"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


#: parts that the files of a directory are dealt into
PARTS = 32


def with_nearest(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Rows with what is near their directory. A few directories are copied to all tasks; of many,
    each is there once per part, so that one with a third of all files is no task of its own."""
    copied = sized(near)
    if copied is not near:
        return rows.join(copied, "dir", "left")
    part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")
    parts = near.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", part).join(parts, ["dir", "_part"], "left").drop("_part")


def scan_licenses(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``path, own, score, license, inherited_from`` of every row of ``files(path, text)``.

    A statement (a line, or part of one up to a sentence mark) is compared with
    the templates by the cosine of TF-IDF vectors, with document frequencies
    over all texts; the best one from ``least`` up is the file's ``own``
    license. Ties go to the first template by name. A file mostly made of such
    statements is a licence file: it sets the license of its directory (the best
    one, then the smallest path). A file without own license inherits from the
    nearest directory at or above its own that has one, ``inherited_from``
    (``""`` is the top).

    Null and empty texts state nothing, and may inherit; a null path has no
    directory and comes back with null columns. Rows that repeat a path are one
    file and are returned as often. An empty table gives no rows. Other columns
    are not looked at.
    """
    files = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    weights = Weights(files, templates or TEMPLATES)
    own = saved(own_licenses(files.filter("path IS NOT NULL"), weights, least), "own")
    granted = own.filter(F.col("share") >= FILE_SHARE).groupBy(directory(F.col("path")).alias("dir")).agg(
        F.min_by("license", F.struct(-F.col("score"), F.col("path"))).alias("license"))
    # one row per directory, then its ancestors: itself, and every shorter path
    dirs = files.filter("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    names = F.split("dir", "/")
    up = dirs.withColumn("depth", F.explode(F.expr("if(dir = '', array(0), sequence(0, size(split(dir, '/'))))"))).withColumn(
        "up", F.array_join(F.slice(names, F.lit(1), F.col("depth")), "/"))
    near = up.join(granted.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(
        F.max_by(F.struct("license", "up"), "depth").alias("near"))
    rows = files.select("path", directory(F.col("path")).alias("dir"))
    out = with_nearest(rows.join(own.select("path", F.col("license").alias("own"), "score"), "path", "left"), saved(near, "near"))
    return out.select("path", "own", "score", F.coalesce("own", "near.license").alias("license"),
                      F.when(F.col("own").isNull(), F.col("near.up")).alias("inherited_from"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree ``source/lang/doc_id``."""
    part = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), "/", "_"), F.lit("_"))
    return docs.select(F.concat_ws("/", part("source"), part("lang"), part("doc_id")).alias("path"), "text")


def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, as files of a tree by source and language."""
    out = scan_licenses(as_files(table(spark, sf, "documents")))
    return out.withColumn("doc_id", F.expr("try_cast(element_at(split(path, '/'), -1) as bigint)")).withColumn("score", F.round("score", 6))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP5_SQL = f"""
WITH files AS (
  SELECT coalesce(replace(source, '/', '_'), '_') || '/' || coalesce(replace(lang, '/', '_'), '_') || '/' || coalesce(CAST(doc_id AS VARCHAR), '_') AS path, text
  FROM documents),
templates(license, said) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(TEMPLATES.items()))}),
said AS (SELECT license, unnest(list_filter(regexp_split_to_array(lower(said), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM templates),
tf AS (SELECT license, w, count(*) AS tf FROM said GROUP BY ALL),
total AS (SELECT count(*) AS n FROM files),
have AS (
  SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '[^a-z0-9]+'))) AS w FROM files)
  WHERE w IN (SELECT w FROM tf) GROUP BY w),
idf AS (SELECT DISTINCT tf.w, 1 + ln(((SELECT n FROM total) + 1)::DOUBLE / (coalesce(have.n, 0) + 1)) AS idf FROM tf LEFT JOIN have USING (w)),
vec AS (SELECT license, w, tf * idf AS x FROM tf JOIN idf USING (w)),
unit AS (SELECT license, w, x / sqrt(sum(x * x) OVER (PARTITION BY license)) AS x FROM vec),
lines AS (
  SELECT path, no, list_filter(regexp_split_to_array(lower(line), '[^a-z0-9]+'), lambda w: w <> '') AS ws
  FROM (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (
    SELECT path, string_split(regexp_replace(text, '([.!?;])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)) || list_transform(list_filter(string_split(
      regexp_replace(regexp_replace(text, '(?m)^[ \\t]*(?:[#*;%]+|//+|/\\*+|--+)[ \\t]?', '', 'g'), '([.!?;])[ \\t\\n]+|\\n[ \\t]*\\n[ \\t\\n]*', '\\1' || chr(1), 'g'), chr(1)),
      lambda b: contains(trim(b, ' ' || chr(9) || chr(10)), chr(10))), lambda b: replace(b, chr(10), ' ')) AS ls FROM files))),
wordy AS (SELECT path, no, len(ws) AS n, unnest(ws) AS w FROM lines),
weighed AS (
  SELECT path, no, n, w, count(*) * coalesce(any_value(idf), 1 + ln((SELECT n FROM total) + 1)) AS x FROM wordy LEFT JOIN idf USING (w) GROUP BY path, no, n, w),
norms AS (SELECT path, no, n, sqrt(sum(x * x)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT path, no, license, sum(a.x * u.x) AS dot FROM weighed a JOIN unit u USING (w) GROUP BY ALL),
met AS (
  SELECT path, no, any_value(n) AS n, max(round(dot / norm, 9)) AS score, arg_min(license, (-round(dot / norm, 9), license)) AS license
  FROM dots JOIN norms USING (path, no) GROUP BY path, no HAVING max(round(dot / norm, 9)) >= {LEAST}),
own AS (
  SELECT path, max(score) AS score, split_part(arg_min(license, (-score, license)), '#', 1) AS license,
    sum(n) / (SELECT sum(len(ws)) FROM lines l WHERE l.path = m.path) AS share FROM met m GROUP BY path),
granted AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, arg_min(license, (-score, path)) AS license FROM own WHERE share >= {FILE_SHARE} GROUP BY 1),
placed AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(path, '/.*$', '') AS top FROM files)
SELECT p.path, try_cast(regexp_extract(p.path, '[^/]*$') AS BIGINT) AS doc_id, o.license AS own, round(o.score, 6) AS score,
  coalesce(o.license, g.license, t.license, r.license) AS license,
  CASE WHEN o.license IS NULL THEN CASE WHEN g.license IS NOT NULL THEN p.dir WHEN t.license IS NOT NULL THEN p.top WHEN r.license IS NOT NULL THEN '' END END AS inherited_from
FROM placed p LEFT JOIN own o ON o.path = p.path LEFT JOIN granted g ON g.dir = p.dir LEFT JOIN granted t ON t.dir = p.top LEFT JOIN granted r ON r.dir = ''
"""
