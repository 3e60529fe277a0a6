"""Licence scans by TF-IDF cosine to templates, and inheritance from the nearest directory, with DataFrame functions only.

A file's whole text is cut into lines; those that speak of licences are its headers; the whole text
is one more if the file's name is that of a licence file. Their terms are weighted by TF-IDF, with document frequencies over all such lines and the
templates, and the template of the largest cosine names the licence if that reaches a threshold. Such frequencies grow
with the table, and one rare word then outweighs a notice. A file without a licence by them is therefore weighed once
more with frequencies over the templates alone, which are alike at every size. A licence found in a licence file holds for its directory; a file without one takes that of the nearest directory above it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut

THRESHOLD = 0.5
"""Least cosine."""
MAX_DEPTH = 32
"""Directories above a file that the SQL looks at; the query looks at all."""
OUTSIDE = 0.5
"""Weight of a word that is in no template, where frequencies are those of the templates."""
# Notices by which licences are commonly stated.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause Simplified License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.0"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
]
_SPEAKS = r"licen[sc]e|copyright|redistribut|permission is hereby|all rights reserved|spdx"
_LICENCE_FILE = r"(^|/)(licen[sc]e|copying|notice)[^/]*$"


def _terms(text: F.Column) -> F.Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(TEMPLATES)], "template int, licence string, text string")


def _fixed_model(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """``(term, fixed)`` and ``(template, licence, term, mw, n_terms)``: weights with document frequencies over the templates alone."""
    bags = [[w for w in re.split("[^a-z0-9]+", text.lower()) if w] for _, text in TEMPLATES]
    terms = sorted({w for bag in bags for w in bag})
    idf = {w: math.log((1 + len(bags)) / (1 + sum(w in bag for bag in bags))) + 1 for w in terms}
    rows = []
    for i, bag in enumerate(bags):
        own = {w: bag.count(w) * idf[w] for w in bag}
        norm = math.sqrt(sum(x * x for x in own.values()))
        rows += [(i, TEMPLATES[i][0], w, x / norm, len(own)) for w, x in own.items()]
    return spark.createDataFrame(list(idf.items()), "term string, fixed double"), spark.createDataFrame(rows, "template int, licence string, term string, mw double, n_terms int")


def _by_templates(counts: DataFrame, threshold: float) -> DataFrame:
    """``(header, licence, score)`` of ``counts(header, term, tf)``, alike at every size of the table.

    A header must also hold half of the template's distinct words: one rare name (MIT as a university) is no notice.
    """
    fixed, model = (F.broadcast(x) for x in _fixed_model(counts.sparkSession))
    own = counts.join(fixed, "term", "left").select("header", "term", "fixed", (F.col("tf") * F.coalesce("fixed", F.lit(OUTSIDE))).alias("w"))
    norm = own.groupBy("header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own_norm"))
    dots = own.where("fixed is not null").join(model, "term").groupBy("header", "template", "licence", "n_terms").agg(F.sum(F.col("w") * F.col("mw")).alias("dot"), F.count("*").alias("held"))
    scores = dots.where(F.col("held") * 2 >= F.col("n_terms")).join(norm, "header").select("header", "licence", F.round(F.col("dot") / F.col("own_norm"), 6).alias("score"))
    return _best(scores, "header", threshold)


def _best(scores: DataFrame, key: str, threshold: float) -> DataFrame:
    """The licence of the best score of each key, if it reaches the threshold; equal scores go to the first by name."""
    best = scores.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select(key, F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")).where(F.col("score") >= threshold)


def header_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(path, licence, score)``: the licence that a file of ``files(path, text)`` states itself; files without one are left out.

    The best line decides, by frequencies of the table, or if none reaches the threshold by those of the templates;
    equal scores go to the first licence by name. Repeated paths are one file.
    """
    spark = files.sparkSession
    named = F.lower("path").rlike(_LICENCE_FILE)
    lines = files.where("path is not null and text is not null").where(F.lower("text").rlike(_SPEAKS) | named)
    spoken = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(_SPEAKS))
    lines = lines.select("path", F.explode(F.concat(spoken, F.when(named, F.array("text")).otherwise(F.array().cast("array<string>")))).alias("line"))
    # all texts are read once; what follows works on the few lines that speak of licences
    lines = lines.select("path", F.array_join(_terms(F.col("line")), " ").alias("text")).where("text <> ''")
    # a header goes by its digest: its text, which may be long, must not be repeated for each of its terms
    lines = cut(lines.select("path", F.sha2("text", 256).alias("header"), "text"))
    # equal lines are one header: of the many files that carry a notice only the distinct text of it is weighed
    headers = cut(lines.groupBy("header", "text").agg(F.count("*").alias("n_lines")))
    templates = _templates(spark).select("template", "licence", F.array_join(_terms(F.col("text")), " ").alias("text")).withColumn("header", F.sha2("text", 256))
    counted = lambda df, *keys: df.select(*keys, "header", F.explode(F.split("text", " ")).alias("term")).groupBy(*keys, "header", "term").agg(F.count("*").alias("tf"))
    own, model = counted(headers, "n_lines"), counted(templates, "template", "licence")
    # document frequencies: lines by number, and each template once; only terms of templates have weight beyond norms
    df = own.select("term", F.col("n_lines").alias("n")).unionByName(model.select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    total = (headers.agg(F.sum("n_lines")).first()[0] or 0) + len(TEMPLATES)  # one number
    idf = cut(df.select("term", (F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1).alias("idf")))
    weigh = lambda x, *keys: x.join(idf, "term").select(*keys, "header", "term", (F.col("tf") * F.col("idf")).alias("w"))
    counts = own
    own, model = weigh(own), weigh(model, "template", "licence")
    own_norm = own.groupBy("header").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("own_norm"))
    model_norm = model.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("model_norm"))
    model = model.join(model_norm, "template").select("template", "licence", "term", (F.col("w") / F.col("model_norm")).alias("mw"))
    # templates are fixed, so their few terms are broadcast
    dots = own.join(F.broadcast(model), "term").groupBy("header", "template", "licence").agg(F.sum(F.col("w") * F.col("mw")).alias("dot")).join(own_norm, "header")
    scores = dots.select("header", "licence", F.round(F.col("dot") / F.col("own_norm"), 6).alias("score"))
    best = _best(scores, "header", threshold).withColumn("again", F.lit(0)).unionByName(_by_templates(counts, threshold).withColumn("again", F.lit(1)))
    stated = lines.select("path", "header").distinct().join(cut(best), "header").groupBy("path").agg(F.min(F.struct("again", (-F.col("score")).alias("s"), "licence")).alias("b"))
    return stated.select("path", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score"))


def _above(directory: F.Column) -> F.Column:
    """A directory and those above it, the nearest first, with their distance; the root is the empty name."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    steps = F.sequence(F.lit(0), F.size(parts))
    return F.transform(steps, lambda i: F.struct(i.alias("distance"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/").alias("above")))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(path, licence, score, origin, licence_dir)`` of each distinct path: origin is header, file (a licence file), inherited or none.

    ``licence_dir`` is the directory from which an inherited licence comes. In a directory with several licence files
    the best score counts, then the first licence by name. Rows with null path are left out; null or empty text states
    nothing. Directories are resolved once each, so a directory of any number of files is one row in the path join.
    """
    own = cut(header_licences(files, threshold))
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    paths = files.where("path is not null").select("path").distinct().withColumn("dir", directory)
    paths = cut(paths)
    governing = own.where(F.lower("path").rlike(_LICENCE_FILE)).groupBy(directory.alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("above", F.col("b.licence").alias("dir_licence"), (-F.col("b.s")).alias("dir_score"))
    ancestors = paths.select("dir").distinct().select("dir", F.explode(_above(F.col("dir"))).alias("a")).select("dir", "a.*")
    inherited = ancestors.join(governing, "above").groupBy("dir").agg(F.min_by(F.struct("dir_licence", "dir_score", "above"), "distance").alias("i")).select("dir", "i.*")
    joined = paths.join(own, "path", "left").join(inherited, "dir", "left")
    origin = F.when(F.col("licence").isNotNull() & F.lower("path").rlike(_LICENCE_FILE), "file").when(F.col("licence").isNotNull(), "header").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none")
    return joined.select(
        "path",
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.coalesce("score", "dir_score").alias("score"),
        origin.alias("origin"),
        F.when(origin == "inherited", F.col("above")).alias("licence_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """``(doc_id, path, text)``: documents as files in a tree by source and id; one whose last line speaks of a licence is its directory's licence file."""
    closes = F.lower(F.element_at(F.split(F.rtrim("text"), "\n"), -1)).rlike("licen[sc]e")
    name = F.when(closes, F.lit("LICENSE-")).otherwise(F.lit("doc-"))
    folder = F.format_string("%s/%d/%d/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 4096), F.floor(F.col("doc_id") / 256))
    return docs.where("doc_id is not null").select("doc_id", F.concat(folder, name, F.col("doc_id").cast("string")).alias("path"), "text")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence of every document, stated or inherited."""
    files = document_paths(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scan(files)
    return files.select("doc_id", "path").distinct().join(found, "path").select("doc_id", "path", "licence", "score", "origin", "licence_dir")


def oracle(threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(TEMPLATES))
    terms = lambda x: f"array_to_string([w for w in string_split_regex(lower({x}), '[^a-z0-9]+') if w <> ''], ' ')"
    return f"""
WITH f AS (
  SELECT DISTINCT doc_id, text, concat(coalesce(source, 'none'), '/', doc_id // 4096, '/', doc_id // 256, '/',
    CASE WHEN regexp_matches(lower(string_split(rtrim(text, ' '), chr(10))[-1]), 'licen[sc]e') THEN 'LICENSE-' ELSE 'doc-' END, doc_id) AS path
  FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT path, text, regexp_matches(lower(path), {quoted(_LICENCE_FILE)}) AS named FROM f WHERE text IS NOT NULL),
l AS (
  SELECT path, unnest([x for x in string_split(text, chr(10)) if regexp_matches(lower(x), {quoted(_SPEAKS)})]) AS line FROM n
  UNION ALL SELECT path, text FROM n WHERE named),
t AS (SELECT path, md5(header) AS header, header AS body FROM (SELECT path, {terms("line")} AS header FROM l) WHERE header <> ''),
h AS (SELECT header, any_value(body) AS body, count(*) AS n_lines FROM t GROUP BY header),
m AS (SELECT template, licence, {terms("words")} AS body FROM (VALUES {values}) v(template, licence, words)),
own AS (SELECT header, n_lines, term, count(*) AS tf FROM (SELECT header, n_lines, unnest(string_split(body, ' ')) AS term FROM h) GROUP BY ALL),
model AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(string_split(body, ' ')) AS term FROM m) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM (SELECT term, n_lines AS n FROM own UNION ALL SELECT term, 1 FROM model) GROUP BY term),
idf AS (SELECT term, ln((1 + total) / (1.0::DOUBLE + df)) + 1 AS idf FROM df, (SELECT coalesce(sum(n_lines), 0)::DOUBLE + {len(TEMPLATES)} AS total FROM h)),
own_w AS (SELECT header, term, tf * idf AS w FROM own JOIN idf USING (term)),
model_w AS (SELECT template, licence, term, tf * idf AS w FROM model JOIN idf USING (term)),
own_n AS (SELECT header, sqrt(sum(w * w)) AS norm FROM own_w GROUP BY header),
model_n AS (SELECT template, sqrt(sum(w * w)) AS norm FROM model_w GROUP BY template),
dots AS (SELECT o.header, k.template, k.licence, sum(o.w * k.w) AS dot FROM own_w o JOIN model_w k USING (term) GROUP BY ALL),
scores AS (SELECT header, licence, round(dot / model_n.norm / own_n.norm, 6) AS score FROM dots JOIN own_n USING (header) JOIN model_n USING (template)),
stated AS (SELECT path, licence, score FROM t JOIN scores USING (header) WHERE score >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, licence) = 1),
d AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f),
g AS (SELECT dir AS above, licence AS dir_licence, score AS dir_score FROM stated JOIN d USING (path) WHERE regexp_matches(lower(path), {quoted(_LICENCE_FILE)})
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1),
up AS (SELECT dir, i AS distance, array_to_string(string_split(dir, '/')[1 : len(string_split(dir, '/')) - i], '/') AS above
  FROM (SELECT dir, unnest(range(0, least(len(string_split(dir, '/')), {MAX_DEPTH}) + 1)) AS i FROM (SELECT DISTINCT dir FROM d))),
near AS (SELECT dir, above, dir_licence, dir_score FROM up JOIN g USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY distance) = 1)
SELECT f.doc_id, f.path, coalesce(s.licence, dir_licence) AS licence, coalesce(s.score, dir_score) AS score,
  CASE WHEN s.licence IS NOT NULL AND regexp_matches(lower(f.path), {quoted(_LICENCE_FILE)}) THEN 'file' WHEN s.licence IS NOT NULL THEN 'header'
    WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN s.licence IS NULL AND dir_licence IS NOT NULL THEN above END AS licence_dir
FROM (SELECT DISTINCT doc_id, path FROM f) f JOIN d USING (path) LEFT JOIN stated s ON s.path = f.path LEFT JOIN near USING (dir)
"""
