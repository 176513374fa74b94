"""License scans in DataFrame operations only: MinHash bands, then exact containment.

A text is cut into overlapping windows of ``window`` words that start at every word.  A window's
shingles give one minhash for each band, and a window that shares a band's value with a window of
a template retrieves that template.  A window that lies unchanged within a license text has the
same shingles as one of the template's, and so is retrieved with certainty; one of Jaccard
similarity j is with probability 1 - (1 - j)^bands.  A license of n words that went through e
edits keeps an unchanged window whenever n >= (e + 1) * window + e.

Templates are a table; windows are joined with the templates' windows on (band, value), which is a
broadcast join while the templates are few and a shuffled one beyond.  A retrieved template is
accepted if at least ``percent`` of its distinct shingles are in the text.  Licenses of a family
share much of their wording, so of a family's accepted templates only those of the highest
containment count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rivulet.llm.runtime import checkpointed, columns, few

# Wordings of license notices.
NOTICES = (
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "cc", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "gnu", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("AGPL-3.0", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "gnu", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)


@dataclass(frozen=True)
class Scan:
    """Production parameters: words of a shingle and of a window, bands, least containment."""

    shingle: int = 3
    window: int = 5
    bands: int = 2
    percent: int = 80
    #: Rows of a table of templates, or of texts with candidates, that may be broadcast.
    broadcast_rows: int = 50_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column, k: int) -> Column:
    """A 64-bit hash of each k successive words; the whole sequence if there are fewer, none for none."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(*(F.element_at(words, i + j) for j in range(k))))
    return F.when(n >= k, each).when(n > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column, scan: Scan) -> list[Column]:
    """For each band the minhash of each window; a shorter text is one window."""
    k = scan.window - scan.shingle + 1
    n = F.size(shingles)

    def band(b: int) -> Column:
        def value(h: Column) -> Column:
            return h if b == 0 else F.xxhash64(h, F.lit(b))

        def least(i: Column) -> Column:
            members = [value(F.element_at(shingles, i + j)) for j in range(k)]
            return F.least(*members) if k > 1 else members[0]

        each = F.transform(F.sequence(F.lit(1), n - (k - 1)), least)
        return F.when(n >= k, each).when(n > 0, F.array(F.array_min(F.transform(shingles, value)))).otherwise(F.array().cast("array<bigint>"))

    return [band(b) for b in range(scan.bands)]


def templates(spark: SparkSession) -> DataFrame:
    """(license, family, text): the notices that this module knows."""
    return spark.createDataFrame(list(NOTICES), "license string, family string, text string")


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _windows(shingles: Column, scan: Scan) -> Column:
    """(band, value) of all windows."""

    def tagged(b: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(b).alias("band"), v.alias("value")))

    return F.concat(*(tagged(b, x) for b, x in enumerate(_bands(shingles, scan))))


def _shingled(rows: DataFrame, scan: Scan) -> DataFrame:
    """(k1, k2, h) of a table (k1, k2, text).  Words are a column of their own, as an expression
    within the shingles' function would be evaluated for each of them."""
    return rows.select("k1", "k2", _words(F.col("text")).alias("w")).select("k1", "k2", _shingles(F.col("w"), scan.shingle).alias("h"))


def _accepted(rows: DataFrame, known: DataFrame, scan: Scan, nested: bool) -> DataFrame:
    """(k1, k2, license, percent) of the accepted templates of each text of rows (k1, k2, text)."""
    held = known.select(F.xxhash64("license", "family", "text").alias("t"), "license", "family", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    held = held.select("t", "license", "family", _shingles(F.col("w"), scan.shingle).alias("h")).dropDuplicates(["t"])
    held = checkpointed(held.select("t", "license", "family", F.array_distinct("h").alias("d"), "h"))
    theirs = held.select("t", F.explode(_windows(F.col("h"), scan)).alias("x")).select("t", "x.*").distinct()
    own = _shingled(rows, scan).select("k1", "k2", F.explode(_windows(F.col("h"), scan)).alias("x")).select("k1", "k2", "x.*")
    found = checkpointed(own.join(few(theirs, scan.broadcast_rows), ["band", "value"]).select("k1", "k2", "t").distinct())
    texts = rows.join(few(found.select("k1", "k2").distinct(), scan.broadcast_rows), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    both = found.join(_shingled(texts, scan), ["k1", "k2"]).join(few(held.select("t", "license", "family", "d"), scan.broadcast_rows), "t")
    both = both.select("k1", "k2", "t", "license", "family", F.size("d").alias("n"), F.size(F.array_intersect("d", "h")).alias("common")).filter(F.col("common") * 100 >= F.col("n") * scan.percent)
    share = F.col("common") / F.col("n")
    best = both.withColumn("share", share).withColumn("best", F.max("share").over(Window.partitionBy("k1", "k2", "family"))).filter("share = best")
    if not nested:
        best = checkpointed(best)
        narrow, wide = (held.select(F.col("t").alias(t), "family", F.col("d").alias(d)) for t, d in (("t", "d"), ("wider", "more")))
        within = narrow.join(wide, "family").filter((F.size("d") < F.size("more")) & (F.size(F.array_except("d", "more")) == 0)).select("t", "wider")
        covered = best.select("k1", "k2", "t").join(few(within, scan.broadcast_rows), "t").join(best.select("k1", "k2", F.col("t").alias("wider")), ["k1", "k2", "wider"])
        best = best.join(covered.select("k1", "k2", "t").distinct(), ["k1", "k2", "t"], "left_anti")
    return best.select("k1", "k2", "license", F.floor(F.lit(100) * F.col("common") / F.col("n")).cast("long").alias("percent"))


def licenses(docs: DataFrame, scan: Scan = Scan(), known: DataFrame | None = None, nested: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_licenses, licenses (sorted, comma-joined) and
    containment (the best accepted template's percent of shingles found, 0 if none).

    known: templates (license, family, text), by default those of this module.  nested: whether a
    template also counts if all its shingles are in another of its family that is found no less, as
    BSD-2-Clause's are in BSD-3-Clause (the query's SQL counts it).  Words are runs of
    a-z and 0-9 after lower-casing.  Null and empty texts have no license; long texts are scanned
    whole; rows of equal text get equal results; other templates of a family that tie all count; without
    templates or rows nothing is found.  Extra columns are ignored, whatever their names.
    """
    rows = columns(docs, "doc_id", "text").select("doc_id", "text", *_digest(F.col("text")))
    found = _accepted(rows.select("k1", "k2", "text"), templates(docs.sparkSession) if known is None else columns(known, "license", "family", "text"), scan, nested)
    found = checkpointed(found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("license")).alias("names"), F.max("percent").alias("containment")))
    out = rows.select("doc_id", "k1", "k2", F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+")).cast("long").alias("n_words")).join(few(found, scan.broadcast_rows), ["k1", "k2"], "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce("containment", F.lit(0)).cast("long").alias("containment"))


def oracle() -> str:
    """Containment of every template in every text, without retrieval, in DuckDB SQL."""
    values = ", ".join("({}, '{}', '{}', '{}')".format(i, name, family, text.replace("'", "''")) for i, (name, family, text) in enumerate(NOTICES))
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "[array_to_string(w[i : i + 2], ' ') FOR i IN range(1, greatest(len(w) - 1, 2))]"
    return f"""
WITH t AS (SELECT i, name, family, {words.format("text")} AS w FROM (VALUES {values}) v(i, name, family, text)),
tg AS (SELECT DISTINCT i, name, family, unnest({grams}) AS g FROM t),
tn AS (SELECT i, count(*) AS total FROM tg GROUP BY i),
d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
dg AS (SELECT DISTINCT r, unnest({grams}) AS g FROM d WHERE len(w) > 0),
m AS (SELECT r, i, name, family, count(*) AS n, any_value(total) AS total FROM dg JOIN tg USING (g) JOIN tn USING (i) GROUP BY r, i, name, family),
f AS (SELECT * FROM m WHERE 100 * n >= {Scan().percent} * total QUALIFY n / total = max(n / total) OVER (PARTITION BY r, family)),
k AS (SELECT r, count(DISTINCT name) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(100 * n // total) AS best FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, coalesce(best, 0)::BIGINT AS containment
FROM d LEFT JOIN k USING (r)
"""
