"""License scans, with DataFrame functions only.

What may state a licence is compared with licence texts by the cosine of sparse TF-IDF vectors: each line, each
paragraph (lines up to a blank one, comment marks aside, so a wrapped header is one) and the whole text. Those
without any word of ``STATES``, in either case, are left out; every template has one. Document frequencies are counted over all that
are compared. Equal ones are scored once. A file's own licence is that of its best one, where the cosine reaches
``LEAST_COSINE``. A file is a licence file where its whole text reaches ``FILE_COSINE``. Files without a licence of their own
take that of the nearest directory above them that holds a licence file.

Defined cases: a null text is empty and states nothing; texts of any length are compared whole; a null path has no
directories above it and inherits nothing; ties of cosine go to the licence first in code point order, ties of licence
files in one directory to the first path; repeated rows are scanned alike; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import small, table
from kgspark.sources.scratch import write_out

#: Least cosine of what states a licence, and of the whole text of a licence file.
LEAST_COSINE, FILE_COSINE = 0.5, 0.9
#: Between paragraphs: blank lines, also ones with comment marks only.
PARAGRAPH = r"\n[ \t\r]*(?:(?:#|//|\*|;|--)[ \t\r]*)?\n"

#: Public licence texts, or their usual notices where the text is long, and short statements of them.
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work and dedicated it to the public domain."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", f"Copyright (c) All rights reserved. {BSD_START} {BSD_END}"),
    ("BSD-3-Clause", f"Copyright (c) All rights reserved. {BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_END}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", "Copyright Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without written permission of the copyright holder."),
]
#: Words of which every template has one, in either case and however blank space falls.
STATES = r"(?i)licen[cs]|copyright|cc[\s-]+by|permission|redistribution|public\s+domain|rights\s+reserved"


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.translate(line, string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9]+"), F.lit(0))


def score_lines(lines: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(h, line, n) distinct lines with their 64-bit hash and how often they come -> (h, license, cosine) of those that state a licence."""
    spark = lines.sparkSession
    texts = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(TEMPLATES)], "k int, license string, text string")
    terms = lines.select("h", "n", F.explode(_tokens(F.col("line"))).alias("token")).groupBy("h", "n", "token").agg(F.count("*").alias("tf"))
    terms = write_out(terms, "terms")
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    seen = terms.groupBy("token").agg(F.sum("n").alias("df"))
    idf = F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    weighted = terms.join(seen, "token").crossJoin(F.broadcast(total)).select("h", "token", (F.col("tf") * idf).alias("w"))  # total is one row
    known = texts.select("k", "license", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("k", "license", "token").agg(F.count("*").alias("tf"))
    known = known.join(seen, "token", "left").crossJoin(F.broadcast(total)).select("k", "license", "token", (F.col("tf") * idf).alias("v"))
    known = known.withColumn("v", F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("k"))))
    norms = weighted.groupBy("h").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(known), "token").groupBy("h", "k", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))  # the templates' words
    best = (
        dots.groupBy("h", "license").agg(F.max("dot").alias("dot")).join(norms, "h")
        .select("h", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    )
    return best.groupBy("h").agg(F.max(F.struct(F.col("cosine"), F.col("license"))).alias("top"), F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("first")).select(
        "h", F.col("first.license").alias("license"), F.col("top.cosine").alias("cosine")
    ).filter(F.col("cosine") >= least)


def own_licenses(files: DataFrame, key: str = "path", text_col: str = "text") -> DataFrame:
    """(key, own_license, cosine, is_license_file) of the files that state a licence."""
    text = F.coalesce(text_col, F.lit(""))
    whole = F.trim(text, F.lit(" \t\r\n"))
    pieces = F.array_distinct(F.concat(F.array(whole), F.transform(F.split(text, PARAGRAPH), lambda v: F.trim(v, F.lit(" \t\r\n"))), F.transform(F.split(text, "\n"), lambda v: F.trim(v, F.lit(" \t\r\n")))))
    stated = files.filter(F.col(text_col).rlike(STATES)).select(
        F.col(key).alias("key"), F.posexplode(F.filter(pieces, lambda v: v.rlike(STATES))).alias("pos", "line")
    )
    stated = write_out(stated.select("key", (F.col("pos") == 0).alias("whole"), F.xxhash64("line").alias("h"), "line"), "stated")
    distinct = write_out(stated.groupBy("h").agg(F.first("line").alias("line"), F.count("*").alias("n")), "distinct")
    found = stated.select("key", "whole", "h").join(score_lines(distinct), "h")
    return found.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"), F.max(F.col("whole") & (F.col("cosine") >= FILE_COSINE)).alias("whole")).select(
        F.col("key").alias(key), F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("cosine"), F.col("whole").alias("is_license_file")
    )


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def inherit(files: DataFrame) -> DataFrame:
    """(path, own_license, is_license_file) -> adds license and inherited_from (a directory, null where the licence is the file's own)."""
    files = files.withColumn("_dir", folder(F.col("path")))
    holders = files.filter(F.col("is_license_file") & F.col("own_license").isNotNull()).groupBy(F.col("_dir").alias("above")).agg(F.min(F.struct("path", "own_license")).alias("holder"))
    holders = small(holders.select("above", F.col("holder.own_license").alias("from_above")), "holders")
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = files.filter("own_license IS NULL AND _dir IS NOT NULL").select("_dir").distinct().select("_dir", F.posexplode(ups).alias("depth", "above"))
    nearest = dirs.join(holders, "above").groupBy("_dir").agg(F.max(F.struct("depth", "above", "from_above")).alias("near"))
    nearest = small(nearest.select("_dir", F.col("near.above").alias("near_dir"), F.col("near.from_above").alias("near_license")), "nearest")
    own = F.col("own_license").isNotNull()
    return (
        files.join(nearest, "_dir", "left")
        .withColumn("license", F.coalesce("own_license", "near_license"))
        .withColumn("inherited_from", F.when(~own, F.col("near_dir")))
        .drop("_dir", "near_dir", "near_license")
    )


def op5_license_scans(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents. They have no paths; they are laid out as source/id div 400/id div 20/id."""
    docs = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(doc_id / 400).cast("string"), F.floor(doc_id / 20).cast("string"), doc_id.cast("string"))
    own = own_licenses(docs.select("doc_id", "text"), "doc_id")
    files = docs.select("doc_id", path.alias("path")).join(own, "doc_id", "left")
    files = files.withColumn("is_license_file", F.coalesce("is_license_file", F.lit(False)))
    return inherit(files).select("doc_id", "path", "own_license", "cosine", "is_license_file", "license", "inherited_from")


_TEMPLATE_ROWS = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
_TOKENS = "unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))"
_IDF = "(ln((total + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1)"
_TRIM = "trim({}, ' ' || chr(9) || chr(13) || chr(10))"
SQL = f"""
WITH d0 AS (SELECT doc_id, text, {_TRIM.format('text')} AS body FROM documents WHERE regexp_matches(text, '{STATES}')),
x AS (SELECT doc_id, body AS line, true AS whole FROM d0
  UNION SELECT doc_id, line, false FROM (SELECT doc_id, body, {_TRIM.format("unnest(string_split_regex(text, '" + PARAGRAPH + "'))")} AS line FROM d0) WHERE line <> body
  UNION SELECT doc_id, line, false FROM (SELECT doc_id, body, {_TRIM.format("unnest(string_split(text, chr(10)))")} AS line FROM d0) WHERE line <> body),
st AS (SELECT * FROM x WHERE regexp_matches(line, '{STATES}')),
ln AS (SELECT line, count(*) AS n FROM st GROUP BY line),
tt AS (SELECT sum(n) AS total FROM ln),
tm AS (SELECT line, n, token, count(*) AS tf FROM (SELECT line, n, {_TOKENS.format('line')} AS token FROM ln) GROUP BY ALL),
sn AS (SELECT token, sum(n) AS df FROM tm GROUP BY token),
w AS (SELECT line, token, tf * {_IDF} AS w FROM tm JOIN sn USING (token), tt),
kt AS (SELECT k, license, token, count(*) AS tf FROM (SELECT k, license, {_TOKENS.format('body')} AS token FROM (VALUES {_TEMPLATE_ROWS}) AS v(k, license, body)) GROUP BY ALL),
kw AS (SELECT k, license, token, tf * {_IDF} AS v FROM kt LEFT JOIN sn USING (token), tt),
kn AS (SELECT k, license, token, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS v FROM kw),
nm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM w GROUP BY line),
dt AS (SELECT line, k, license, sum(w * v) AS dot FROM w JOIN kn USING (token) GROUP BY ALL),
bs AS (SELECT line, license, round(max(dot) / any_value(norm), 6) AS cosine FROM dt JOIN nm USING (line) GROUP BY line, license),
sc AS (SELECT line, license, cosine FROM bs QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, license) = 1),
own AS (SELECT doc_id, license AS own_license, cosine, bool_or(whole AND cosine >= {FILE_COSINE}) OVER (PARTITION BY doc_id) AS is_file FROM st JOIN sc USING (line) WHERE cosine >= {LEAST_COSINE}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
f AS (SELECT d.doc_id, concat_ws('/', coalesce(source, ''), (d.doc_id // 400)::VARCHAR, (d.doc_id // 20)::VARCHAR, d.doc_id::VARCHAR) AS path,
  concat_ws('/', coalesce(source, ''), (d.doc_id // 400)::VARCHAR, (d.doc_id // 20)::VARCHAR) AS d2, concat_ws('/', coalesce(source, ''), (d.doc_id // 400)::VARCHAR) AS d1, coalesce(source, '') AS d0,
  own_license, cosine, coalesce(is_file, false) AS is_license_file FROM documents d LEFT JOIN own ON d.doc_id = own.doc_id),
h AS (SELECT d2 AS above, arg_min(own_license, path) AS from_above FROM f WHERE is_license_file AND own_license IS NOT NULL GROUP BY d2)
SELECT doc_id, path, own_license, cosine, is_license_file, coalesce(own_license, a.from_above, b.from_above, c.from_above) AS license,
  CASE WHEN own_license IS NULL THEN coalesce(a.above, b.above, c.above) END AS inherited_from
FROM f LEFT JOIN h a ON f.d2 = a.above LEFT JOIN h b ON f.d1 = b.above LEFT JOIN h c ON f.d0 = c.above
"""
