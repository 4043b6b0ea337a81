"""Licence scan by Dice coefficient over word bigrams (operator 3).

Lines, and runs of neighbouring lines that each hold a bigram of some template, are normalised to
lower-cased ASCII words and compared with licence templates: twice the common distinct bigrams by the sum of
both numbers. A block can reach the limit t only with a template whose number of bigrams is within the
factor (2 - t) / t of its own, so others are pruned before bigrams are compared. Templates are a
parameter; all work is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import bind, staged, table, text_key

LIMIT = 0.8

# Notices and texts of public licences.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain.",
    "All rights reserved": "All rights reserved.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
                    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
                    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                    "other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                  "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                  "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                  "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _bigrams(words: Column) -> Column:
    """Distinct neighbouring pairs of words."""
    n = F.size(words)
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
                                       lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, limit: float = LIMIT) -> DataFrame:
    """Licences in `docs` (doc_id, text; other columns are ignored).

    Returns doc_id, first_line, last_line (from 0, lines end at a line feed), license and dice: for each line, and each
    run of lines that all hold a template's bigram, the template with the highest coefficient >= `limit`, of equal
    ones the first by name. Null and empty texts have no row, equal rows are reported once, templates of
    fewer than two words match nothing, and an empty table or set of templates gives no rows.
    """
    spark = docs.sparkSession
    named = spark.createDataFrame(sorted((templates if templates is not None else TEMPLATES).items()), "license string, body string")
    named = staged(named.select("license", _bigrams(_words(F.col("body"))).alias("tb")).filter(F.size("tb") > 0))
    sets = [r.tb for r in named.collect()]  # the given templates
    vocabulary = F.split(F.lit("\n".join(sorted({g for tb in sets for g in tb}))), "\n")
    least, most = (f(map(len, sets), default=0) for f in (min, max))

    def of(line, i):
        # A line above the size bound fits no template, and no run with it does; it is listed without its words.
        return bind(_words(line), lambda w: bind(_bigrams(w), lambda g: F.struct(
            i.alias("line"), F.when(F.size(g) * limit <= most * (2 - limit) + 1e-9, w).alias("words"),
            F.arrays_overlap(g, vocabulary).alias("held"))))

    lines = F.explode(F.filter(F.transform(F.split("text", "\n"), of), lambda x: x["held"]))
    # Rows with the same id and text are one.
    held = staged(docs.select("doc_id", text_key(F.col("text")).alias("key"), lines.alias("x"))
                  .select("doc_id", "key", "x.line", "x.words").distinct())
    # Runs of neighbouring lines; the window's group is one text.
    order = Window.partitionBy("doc_id", "key").orderBy("line")
    runs = (held.withColumn("run", F.col("line") - F.row_number().over(order)).groupBy("doc_id", "key", "run")
            .agg(F.sort_array(F.collect_list(F.struct("line", "words"))).alias("ls"))
            .filter((F.size("ls") > 1) & ~F.exists("ls", lambda x: x["words"].isNull()))
            .select("doc_id", "key", F.col("ls")[0]["line"].alias("first_line"), F.element_at("ls", -1)["line"].alias("last_line"),
                    F.flatten(F.transform("ls", lambda x: x["words"])).alias("words")))
    single = held.filter("words IS NOT NULL").select(
        "doc_id", "key", F.col("line").alias("first_line"), F.col("line").alias("last_line"), "words")

    def near(g):
        """The bigrams, if so many are known that some template may reach the limit."""
        return F.when(2 * F.size(F.array_intersect(g, vocabulary)) >= (F.size(g) + least) * limit - 1e-9, g)

    blocks = single.unionByName(runs).select("doc_id", "key", "first_line", "last_line", bind(_bigrams(F.col("words")), near).alias("bg"))
    a, b = F.size("bg"), F.size("tb")
    fits = (a * (2 - limit) >= b * limit - 1e-9) & (b * (2 - limit) >= a * limit - 1e-9)
    # Templates that share a bigram, within the size bounds.
    shared = (blocks.select("*", F.explode("bg").alias("g")).join(F.broadcast(named.select("license", "tb", F.explode("tb").alias("tg"))), F.col("g") == F.col("tg"))
              .filter(fits).groupBy("doc_id", "key", "first_line", "last_line", "license", a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("both")))
    dice = F.lit(2.0) * F.col("both") / (F.col("a") + F.col("b"))
    return (shared.withColumn("dice", dice).filter(F.col("dice") >= limit).groupBy("doc_id", "key", "first_line", "last_line")
            .agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"))
            .select("doc_id", "first_line", "last_line", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts in all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GRAMS = ("list_distinct(list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))")

OP3_SQL = f"""
WITH t0 AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}) AS v(license, body)),
t1 AS (SELECT license, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM t0),
t AS (SELECT license, {_GRAMS.format(w="w")} AS tb FROM t1),
vocabulary AS (SELECT DISTINCT unnest(tb) AS g FROM t),
d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l0 AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
l1 AS (SELECT doc_id, text, line, regexp_extract_all(lower(body), '[a-z0-9]+') AS w FROM l0),
l2 AS (SELECT *, {_GRAMS.format(w="w")} AS bg FROM l1),
l AS (SELECT * FROM l2 WHERE list_has_any(bg, (SELECT list(g) FROM vocabulary))),
r0 AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id, text ORDER BY line) AS run FROM l),
r1 AS (SELECT doc_id, text, min(line) AS first_line, max(line) AS last_line, flatten(list(w ORDER BY line)) AS w FROM r0 GROUP BY doc_id, text, run),
b0 AS (SELECT doc_id, text, line AS first_line, line AS last_line, bg FROM l
       UNION ALL SELECT doc_id, text, first_line, last_line, {_GRAMS.format(w="w")} FROM r1 WHERE first_line < last_line),
x AS (SELECT doc_id, text, first_line, last_line, license, 2.0::DOUBLE * len(list_intersect(bg, tb)) / (len(bg) + len(tb)) AS dice FROM b0, t),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, first_line, last_line ORDER BY dice DESC, license) AS n FROM x WHERE dice >= {LIMIT})
SELECT doc_id, first_line::INTEGER AS first_line, last_line::INTEGER AS last_line, license, dice FROM y WHERE n = 1
"""
