r"""License scans in DataFrame operations alone: sparse TF-IDF cosine to templates, then inheritance by directory.

A file's headers are its lines with a word of licensing. Comments of several lines with such a word, and files named like
a licence (LICENSE, COPYING, NOTICE), are compared as a whole with the full texts and standard headers in `licences`, by
TF-IDF of these texts with dampened term counts; what is found so comes before what single lines say. Words are `[a-z0-9.+-]+` of the lower-cased line. Inverse document frequencies come from all
headers of the corpus and the templates. A header belongs to the template of the highest cosine, if that is LEAST or
more. A directory has the license of its licence file: one named so, or one whose headers make up most of its words.
Files without a license of their own take that of the nearest directory above them that has one; directories are
looked up once each, however many files they hold.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, fresh

LEAST = 0.6
#: Bytes of folders and what they hand down that are broadcast at most.
BROADCAST_BYTES = 16 << 20
CUE = r"(?i)licen[cs]e|copyright|spdx|permission is hereby granted|redistribution and use"
NAMED = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: What begins a line of a comment; a mark in place of the lines between comments.
COMMENT, _GAP = r"^\s*(#+|//+|/?\*+/?|--+|;+|%+)", "\x01"
_WORD, _EDGE = r"[a-z0-9.+-]+", ".-"

#: License names and the sentences by which texts name them; several for one license.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)


@cache
def texts() -> list[tuple[str, str]]:
    """(license, text) of the licences and standard headers that come with the package."""
    files = sorted(Path(__file__).with_name("licences").glob("*.txt"))
    return [(f.name.rsplit(".", 2)[0], f.read_text(encoding="utf-8")) for f in files]


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), lambda w: F.btrim(w, F.lit(_EDGE))), lambda w: w != "")


def _terms(units: DataFrame, *keys: str) -> DataFrame:
    """(keys, term, tf)."""
    return units.select(*keys, F.explode(_words(F.col("unit"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def headers(files: DataFrame) -> DataFrame:
    """(fid, at, unit) of files (fid, path, text): lines with a cue, numbered from 1."""
    some = files.where(F.col("text").rlike(CUE))
    return some.select("fid", F.posexplode(F.split("text", "\n")).alias("at", "unit")).where(F.col("unit").rlike(CUE)).withColumn("at", F.col("at") + 1)


def passages(files: DataFrame) -> DataFrame:
    """(fid, at, unit) of files (fid, path, text): files named like a licence as 0, comments of several lines with a cue as 1, 2, ..."""
    some = files.where(F.col("text").rlike(CUE))
    lines = F.transform(F.split("text", "\n"), lambda x: F.when(x.rlike(COMMENT), F.regexp_replace(x, COMMENT, "")).otherwise(_GAP))
    marked = F.split(F.array_join(lines, "\n"), _GAP)
    starred = F.regexp_extract_all("text", F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1))
    blocks = F.filter(F.concat(marked, starred), lambda x: F.btrim(x, F.lit(" \t\r\n")).contains("\n") & x.rlike(CUE))
    blocks = some.select("fid", F.posexplode(blocks).alias("at", "unit")).withColumn("at", F.col("at") + 1)
    return blocks.unionByName(files.where(F.col("path").rlike(NAMED) & F.col("text").isNotNull()).select("fid", F.lit(0).alias("at"), F.col("text").alias("unit")))


def matched(spark: SparkSession, units: DataFrame) -> DataFrame:
    """(fid, license, score): the nearest of texts() to any passage of a file, if its cosine is LEAST or more."""
    weight = (1 + F.log("tf")) * F.col("idf")
    model = _terms(spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts())], "tid int, license string, unit string"), "tid", "license")
    rare = F.log(F.lit(1.0 + len(texts())))
    idf = model.groupBy("term").agg((rare - F.log(1.0 + F.count(F.lit(1))) + 1).alias("idf"))
    weights = model.join(idf, "term").select("tid", "license", "term", weight.alias("wt"))
    norms = weights.groupBy("tid").agg(F.sqrt(F.sum(F.col("wt") ** 2)).alias("nt"))
    own = _terms(units, "fid", "at").join(F.broadcast(idf), "term", "left").withColumn("idf", F.coalesce("idf", rare + 1)).select("fid", "at", "term", weight.alias("w"))
    own = cut(own)
    norm = own.groupBy("fid", "at").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("n"))
    dots = own.join(F.broadcast(weights.join(F.broadcast(norms), "tid")), "term").groupBy("fid", "at", "tid", "license", "nt").agg(F.sum(F.col("w") * F.col("wt")).alias("dot"))
    cosine = dots.join(norm, ["fid", "at"]).select("fid", "license", F.round(F.col("dot") / (F.col("n") * F.col("nt")), 6).alias("score")).where(F.col("score") >= LEAST)
    return cosine.groupBy("fid").agg(F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("fid", "b.license", "b.score")


def scored(spark: SparkSession, units: DataFrame) -> DataFrame:
    """(fid, at, license, score): the nearest template of each header, if its cosine is LEAST or more."""
    templates = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "tid int, license string, unit string")
    own, model = cut(_terms(units, "fid", "at")), _terms(templates, "tid", "license")
    every = own.groupBy("term").agg(F.count(F.lit(1)).alias("n")).unionByName(model.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    total = units.count() + len(TEMPLATES)
    idf = cut(every.groupBy("term").agg(F.sum("n").alias("df")).withColumn("idf", F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1))
    # The templates are a fixed list, so is their side of the join.
    weights = model.join(idf, "term").select("tid", "license", "term", (F.col("tf") * F.col("idf")).alias("wt"))
    norms = weights.groupBy("tid").agg(F.sqrt(F.sum(F.col("wt") ** 2)).alias("nt"))
    weights = F.broadcast(weights.join(F.broadcast(norms), "tid"))
    heavy = own.join(idf.select("term", "idf"), "term").select("fid", "at", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = heavy.groupBy("fid", "at").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("n"))
    dots = heavy.join(weights, "term").groupBy("fid", "at", "tid", "license", "nt").agg(F.sum(F.col("w") * F.col("wt")).alias("dot"))
    cosine = dots.join(norm, ["fid", "at"]).select("fid", "at", "license", F.round(F.col("dot") / (F.col("n") * F.col("nt")), 6).alias("score"))
    best = cosine.groupBy("fid", "at").agg(F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("fid", "at", "b.license", "b.score").where(F.col("score") >= LEAST)


def ancestors(folder: Column) -> Column:
    """All directories above and including folder, nearest last; the root is the empty string."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame) -> DataFrame:
    """(fid, path, license, score, origin, folder) for every row of files (fid, path, text).

    origin is 'own' with the score of the file's best passage, or else header, 'inherited' with the folder it comes from, or null.
    Null texts have no header, rows with a null path inherit nothing; rows of one fid share what they have. Several
    licence files in one folder: those named so come first, then the best score, then the smaller name. An empty table gives an empty result.
    """
    spark, files = files.sparkSession, files.select("fid", "path", "text")
    units = cut(headers(files.where("fid is not null")).distinct())
    found = scored(spark, units)
    best = found.groupBy("fid").agg(F.min_by(F.struct("license", "score"), F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("fid", "b.license", "b.score")
    whole = cut(passages(files.where("fid is not null")).distinct())
    if not whole.isEmpty():
        whole = matched(spark, whole)
        best = best.join(whole, "fid", "left_anti").unionByName(whole)
    best = cut(best)
    # Licence files: named so, or of headers for the most part.
    sizes = units.groupBy("fid").agg(F.sum(F.size(_words(F.col("unit")))).alias("in_headers"))
    marked = files.join(best.join(sizes, "fid", "left"), "fid").where("path is not null")
    named = F.col("path").rlike(NAMED)
    lead = named | (2 * F.col("in_headers") > F.size(_words(F.col("text"))))
    holders = marked.where(lead).select(_folder(F.col("path")).alias("folder"), "license", "score", (~named).alias("unnamed"))
    holders = holders.groupBy("folder").agg(F.min_by("license", F.struct("unnamed", (-F.col("score")).alias("s"), "license")).alias("given"))
    folders = files.where("path is not null").select(_folder(F.col("path")).alias("own")).distinct()
    up = folders.select("own", F.posexplode(ancestors(F.col("own"))).alias("depth", "folder")).where("depth > 0 or folder = own or folder = ''")
    near = up.join(holders, "folder").groupBy("own").agg(F.max_by(F.struct("given", "folder"), "depth").alias("g")).select(F.xxhash64("own").alias("k"), "own", "g.given", "g.folder")
    near = cut(near)
    few = (near.agg(F.sum(F.octet_length("own") + F.octet_length("folder") + 96)).first()[0] or 0) <= BROADCAST_BYTES
    light = files.select("fid", "path", _folder(F.col("path")).alias("own")).withColumn("k", F.xxhash64("own"))
    out = light.join(best, "fid", "left").join(F.broadcast(near) if few else fresh(near, "k"), ["k", "own"], "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited")
    return out.select("fid", "path", F.coalesce("license", "given").alias("license"), "score", origin.alias("origin"), F.when(origin == "inherited", F.col("folder")).alias("folder"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """scan() with a document's source as its directory and its doc_id as its name."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string"))
    files = docs.select(F.col("doc_id").alias("fid"), F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")
    return scan(files).withColumnRenamed("fid", "doc_id")


_LIST = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))
_SPLIT = "list_filter(list_transform(regexp_extract_all(lower({0}), '[a-z0-9.+-]+'), lambda w: trim(w, '.-')), lambda w: w <> '')"
SQL = f"""
WITH t(tid, license, unit) AS (VALUES {_LIST}),
f AS (SELECT doc_id AS fid, coalesce(source, '') || '/' || CAST(doc_id AS VARCHAR) AS path, coalesce(source, '') AS own, text FROM documents),
l AS (SELECT fid, unnest(string_split(text, chr(10))) AS unit, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM f),
u AS (SELECT DISTINCT fid, pos, unit FROM l WHERE regexp_matches(unit, '{CUE}')),
ow AS (SELECT fid, pos, term, count(*) AS tf FROM (SELECT fid, pos, unnest({_SPLIT.format("unit")}) AS term FROM u) GROUP BY ALL),
tw AS (SELECT tid, license, term, count(*) AS tf FROM (SELECT tid, license, unnest({_SPLIT.format("unit")}) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM (SELECT term FROM ow UNION ALL SELECT term FROM tw) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM u) + (SELECT count(*) FROM t)) / (1 + df)) + 1 AS idf FROM df),
wt AS (SELECT tid, license, term, tf * idf AS wt FROM tw JOIN idf USING (term)),
nt AS (SELECT tid, sqrt(sum(wt * wt)) AS nt FROM wt GROUP BY tid),
wo AS (SELECT fid, pos, term, tf * idf AS w FROM ow JOIN idf USING (term)),
no AS (SELECT fid, pos, sqrt(sum(w * w)) AS n FROM wo GROUP BY fid, pos),
c AS (SELECT fid, pos, license, round(sum(w * wt) / (any_value(n) * any_value(nt)), 6) AS score FROM wo JOIN wt USING (term) JOIN nt USING (tid) JOIN no USING (fid, pos) GROUP BY fid, pos, tid, license),
best AS (SELECT fid, license, score FROM c WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY fid ORDER BY score DESC, license) = 1),
hw AS (SELECT fid, sum(len({_SPLIT.format("unit")})) AS in_headers FROM u GROUP BY fid),
h AS (SELECT own, license, score FROM f JOIN best USING (fid) JOIN hw USING (fid) WHERE 2 * in_headers > len({_SPLIT.format("text")})),
g AS (SELECT own, license AS given FROM h QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, license) = 1)
SELECT f.fid AS doc_id, f.path, coalesce(best.license, g.given) AS license, best.score,
CASE WHEN best.license IS NOT NULL THEN 'own' WHEN g.given IS NOT NULL THEN 'inherited' END AS origin,
CASE WHEN best.license IS NULL AND g.given IS NOT NULL THEN g.own END AS folder
FROM f LEFT JOIN best USING (fid) LEFT JOIN g ON f.own = g.own
"""
