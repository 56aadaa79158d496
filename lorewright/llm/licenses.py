"""License scans.

Lines of a file, their sentences, and the sentences of its paragraphs (headers are often
wrapped over several lines and set in comment marks) that speak of licensing are compared with license
templates by the cosine of their sparse TF-IDF vectors; the best template above a
threshold is the file's own license. A licence file (by name, or because at least half
its sentences are license text) also speaks for its directory, and a file without a
license of its own inherits from its nearest ancestor directory that has one.

Only DataFrame functions: equal sentences are folded before they become terms, the
templates are a constant list, and inheritance joins distinct directories, not files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: License notices by identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("GPL-3.0", "Licensed under the GNU General Public License, Version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, Version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, Version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Licensed under the ISC License."),
    *(
        (f"CC-{short}-4.0", notice)
        for short, long in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for notice in (f"This work is licensed under a Creative Commons {long} 4.0 International License.", f"Licensed under CC {short} 4.0.")
    ),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
)
#: Words one of which a sentence needs to be looked at.
MENTION = r"licen[cs]e|copyright|rights reserved|public domain|permission is hereby|free software|redistribut"
#: Names of licence files.
NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
COSINE = 0.6


def sentences(text: Column) -> Column:
    """Lines, cut further after a full stop, question or exclamation mark."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n"), lambda s: F.trim(s)), lambda s: s != "")


#: Fixed value: what stands before a line in a comment.
COMMENT = r"\n[ \t]*(#+|//+|/?\*+|--+|;+|%+|>+)?[ \t]*"


def wrapped(text: Column) -> Column:
    """Sentences of paragraphs of several lines, the lines joined and without comment marks."""
    plain = F.regexp_replace(F.concat(F.lit("\n"), text), COMMENT, "\n")
    joined = F.transform(F.filter(F.split(plain, "\n\n+"), lambda p: F.contains(F.trim(p, F.lit("\n")), F.lit("\n"))), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    return F.filter(F.transform(F.flatten(F.transform(joined, lambda p: F.split(F.regexp_replace(p, r"([.!?])\s+", "$1\n"), "\n"))), lambda s: F.trim(s)), lambda s: s != "")


def terms(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit("[a-z0-9]+"), F.lit(0))


def weights(sentence_terms: DataFrame, idf: DataFrame, by: str) -> DataFrame:
    """(by, term, weight) with tf * idf over the Euclidean norm; terms the corpus lacks carry the largest idf."""
    tf = sentence_terms.groupBy(by, "term").agg(F.count("*").alias("tf")).join(idf, "term")
    norm = tf.groupBy(by).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    return tf.join(norm, by).select(by, "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def license_scan(files: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """(file_id, path, text) -> file_id, license, score, origin, directory.

    origin is 'own' (license and score of the file's best sentence) or 'inherited' (from the
    licence file of the nearest ancestor directory, named in `directory`, the file's own
    included); license is null where neither applies. Scores are rounded to six digits;
    ties go to the first license in code point order.

    A null text has no sentences; a null path no directory and so nothing to inherit; a null
    file_id and repeated rows are files like any other. An empty table gives no rows; extra
    columns are ignored.
    """
    spark = files.sparkSession
    ensure_checkpoint_dir(spark)
    text = F.coalesce("text", F.lit(""))
    mention = lambda s: F.lower(s).rlike(MENTION)
    f = files.select("file_id", "path", sentences(text).alias("all"), F.filter(wrapped(text), mention).alias("more")).select(
        "file_id", "path", F.xxhash64("file_id", "path", "all").alias("key"), F.size("all").alias("n"), F.size(F.filter("all", mention)).alias("n_own"), F.concat(F.filter("all", mention), F.array_except("more", "all")).alias("said")
    )
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", "")))
    f = f.checkpoint()  # without texts; they are scanned once, though the rows are used several times
    # equal sentences are one row with a count
    mentioned = f.where(F.size("said") > 0).select("key", "n", "n_own", F.posexplode("said").alias("nth", "sentence"))
    distinct = mentioned.groupBy("sentence").agg(F.count("*").alias("times"))
    listed = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, license string, sentence string")
    t_terms = listed.select("template", F.explode(terms(F.col("sentence"))).alias("term"))
    s_terms = distinct.select("sentence", "times", F.explode(terms(F.col("sentence"))).alias("term"))
    total = distinct.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("total"))
    df = s_terms.select("sentence", "times", "term").distinct().groupBy("term").agg(F.sum("times").alias("df"))
    df = df.join(t_terms.select("term").distinct(), "term", "full").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    idf = df.join(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf"))  # the total is one row
    near = weights(s_terms, idf, "sentence").join(F.broadcast(weights(t_terms, idf, "template").withColumnRenamed("weight", "w")), "term")
    scored = near.groupBy("sentence", "template").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score")).where(F.col("score") >= cosine).join(F.broadcast(listed.select("template", "license")), "template")
    best = scored.groupBy("sentence").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b")).select("sentence", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))
    hit = mentioned.join(best, "sentence")
    own = hit.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"), F.countDistinct(F.when(F.col("nth") < F.col("n_own"), F.col("nth"))).alias("hits")).select("key", F.col("b.license").alias("own"), (-F.col("b.s")).alias("own_score"), "hits")
    f = f.select("file_id", "path", "key", "n", "name", "dir").join(own, "key", "left")
    speaks = f.where(F.col("own").isNotNull() & F.col("dir").isNotNull() & (F.col("name").rlike(NAMES) | (2 * F.col("hits") >= F.col("n"))))
    by_dir = speaks.groupBy("dir").agg(F.min(F.struct((~F.col("name").rlike(NAMES)).alias("c"), (-F.col("own_score")).alias("s"), F.col("own").alias("license"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("from_dir"), (-F.col("b.s")).alias("dir_score"))
    # every distinct directory meets its ancestors, the root ('') included
    parts = F.split("dir", "/")
    up = f.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("above")).distinct()
    near_dir = up.join(by_dir, "above").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_score", "above"), F.length("above")).alias("d")).select(F.col("dir").alias("d_dir"), "d")
    out = f.join(near_dir, F.col("dir") == F.col("d_dir"), "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "file_id", F.coalesce("own", "d.from_dir").alias("license"), F.when(mine, F.col("own_score")).otherwise(F.col("d.dir_score")).alias("score"),
        F.when(mine, "own").when(F.col("d").isNotNull(), "inherited").alias("origin"), F.when(~mine, F.col("d.above")).alias("directory"),
    )
