"""License scans, in DataFrame functions only.

Units of a file are compared with license templates (statements, headers, whole licence texts) by the cosine of
sparse TF-IDF vectors: every line, every block of lines between blank ones (a notice that is wrapped over several
lines), and the whole file. Document frequencies of all words are counted over all files. A line or block at
``LINE`` or more gives its file that license; a file whose whole text is at ``FILE`` or more, or that has a license
file's name and a licensed line or block, is a license file and licenses its directory. Other files inherit from
the license file in the nearest ancestor directory, by joins on directory paths.

A text's cosine with a template is no more than the length of what they share of the template's vector, whatever
else the text has. Each word has the most that it is of any template's squared length; units and files whose distinct
words sum up to less than a threshold's square are put aside where they are read, before any vector is made.

Defined results: null texts are empty and have no license of their own; empty paths lie in the root; rows
of one path are one file with all their units; the best license is the one with the highest cosine, then
the first by name; very long texts are taken whole; an empty table gives an empty result. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: License names and the statements that announce them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is free software licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    # Headers.
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    # Tags.
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    # Whole licence texts.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
LINE, FILE = 0.8, 0.6
#: What is between blocks of lines.
BLANK = r"\n[ \t\r]*\n"
#: Paths of files that may reach a threshold up to this many are broadcast; more are shuffled.
BROADCAST_PATHS = 1_000_000
NAMES = r"(?i)(^|/)(licen[sc]e|copying)(\.[a-z]+)?$"
WORD = "[a-z0-9]+"


def split_words(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.lower())


class Weights:
    """Template vectors for word counts ``df`` among ``n`` files; their size is that of the template list."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], n: int):
        self.idf = {w: round(math.log((1 + n) / (1 + df.get(w, 0))) + 1, 9) for w in vocabulary(templates)}
        self.rows, self.shares = [], dict.fromkeys(self.idf, 0.0)
        for no, (name, text) in enumerate(templates):
            own = split_words(text)
            vector = {w: own.count(w) * self.idf[w] for w in own}
            whole = sum(x * x for x in vector.values())
            self.rows += [(no, name, w, x, math.sqrt(whole)) for w, x in sorted(vector.items())]
            for w, x in vector.items():
                self.shares[w] = max(self.shares[w], x * x / whole)

    def known(self, w: Column) -> Column:
        """The distinct words that any template has."""
        return F.array_distinct(F.filter(w, lambda x: x.isin(list(self.shares))))

    def may_reach(self, known: Column, threshold: float) -> Column:
        """Whether a text with these known words can have a cosine of ``threshold``, rounded to six digits."""
        share = F.create_map(*[F.lit(x) for pair in self.shares.items() for x in pair])
        return F.aggregate(known, F.lit(0.0), lambda total, x: total + F.element_at(share, x)) >= (threshold - 1e-6) ** 2 - 1e-9


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, t in templates for w in split_words(t)})


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, df): how many of the rows with a ``text`` have each word."""
    met = rows.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    return materialize(met.groupBy("word").agg(F.count("*").alias("df")))


def word_weights(counts: DataFrame, n: int, units: DataFrame) -> DataFrame:
    """(word, idf) of all words of the units, rows of words ``w``, by their counts over ``n`` rows."""
    known = units.select(F.explode("w").alias("word")).distinct()
    met = counts.join(known, "word", "left_semi")
    return materialize(met.select("word", F.round(F.log((1 + n) / (1 + F.col("df"))) + 1, 9).alias("idf")))


def cosines(units: DataFrame, by: list[str], weights: Weights, idf: DataFrame) -> DataFrame:
    """(by, license, score) of the best template for each unit, a row of words ``w`` each; ``idf`` has all their words."""
    spark = units.sparkSession
    terms = units.select(*by, F.explode("w").alias("word")).groupBy(*by, "word").agg(F.count("*").alias("tf"))
    sized = terms.join(idf, "word").withColumn("x", F.col("tf") * F.col("idf"))
    vectors = F.broadcast(spark.createDataFrame(weights.rows, "template int, license string, word string, y double, norm double"))
    length = sized.groupBy(*by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dots = sized.join(vectors, "word").groupBy(*by, "template", "license", "norm").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(length, by).select(*by, "license", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("minus"), F.col("license").alias("license"))).alias("best")
    return scored.groupBy(*by).agg(best).select(*by, F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, license, score, effective, origin, inherited_from) of every distinct path."""
    templates = templates or TEMPLATES
    rows = files.select(F.coalesce(F.col(path), F.lit("")).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts, n = word_counts(rows), files.count()
    df = counts.where(F.col("word").isin(vocabulary(templates))).collect()  # the templates' words
    weights = Weights(templates, {r["word"]: r["df"] for r in df}, n)
    found = F.explode(F.concat(F.split("text", "\n"), F.split("text", BLANK)))
    lines = rows.select("path", found.alias("line")).select("path", words(F.col("line")).alias("w"))
    # Equal units of a path are one, whatever row they are from, as are a line and a block of that line.
    lines = materialize(lines.where(weights.may_reach(weights.known(F.col("w")), LINE)).distinct())
    known = rows.select("path", weights.known(words(F.col("text"))).alias("known")).where(F.size("known") > 0)
    known = known.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"))
    met = materialize(known.where(weights.may_reach(F.col("known"), FILE)).select("path"))
    met = F.broadcast(met) if met.count() <= BROADCAST_PATHS else met
    suspects = materialize(rows.join(met, "path", "left_semi").select("path", words(F.col("text")).alias("w")))
    idf = word_weights(counts, n, lines.select("w").unionByName(suspects.select("w")))
    own = cosines(lines.withColumn("unit", F.xxhash64("w")), ["path", "unit"], weights, idf).where(F.col("score") >= LINE)
    best = F.min(F.struct((-F.col("score")).alias("minus"), F.col("license").alias("license"))).alias("best")
    own = materialize(own.groupBy("path").agg(best).select("path", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score")))
    whole = cosines(suspects, ["path"], weights, idf).where(F.col("score") >= FILE).select("path", "license", "score")
    named = own.where(F.col("path").rlike(NAMES))
    holders = whole.unionByName(named).select(parent(F.col("path")).alias("dir"), "license", "score", "path")
    first = F.min(F.struct((-F.col("score")).alias("minus"), F.col("license").alias("license"), F.col("path").alias("path"))).alias("best")
    licensed = materialize(holders.groupBy("dir").agg(first).select("dir", F.col("best.license").alias("dir_license")))
    names = rows.select("path").distinct().withColumn("dir", parent(F.col("path")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = names.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = F.max(F.struct(F.length("up").alias("depth"), F.col("up").alias("up"), F.col("dir_license").alias("dir_license"))).alias("near")
    inherited = up.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(nearest).select("dir", F.col("near.up").alias("from_dir"), F.col("near.dir_license").alias("dir_license"))
    out = names.join(own, "path", "left").join(inherited, "dir", "left")
    has = F.col("license").isNotNull()
    return out.select(
        "path", "license", "score", F.coalesce("license", "dir_license").alias("effective"),
        F.when(has, "own").when(F.col("dir_license").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(~has, F.col("from_dir")).alias("inherited_from"),
    )


#: Documents that share a leaf directory.
PER_DIRECTORY = 64


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, run of ids, id."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    run = F.coalesce(F.floor(F.col("doc_id") / PER_DIRECTORY).cast("string"), F.lit("unknown"))
    return docs.select(F.concat_ws("/", name("source"), name("lang"), run, name("doc_id")).alias("path"), "text", "doc_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of all documents, their own or their directory's."""
    return scan(as_files(table(spark, sf_dir, "documents")))


def sql(templates: list[tuple[str, str]] | None = None) -> str:
    """The same in DuckDB SQL, without anchors."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    counted = [(no, name, w, split_words(t).count(w)) for no, (name, t) in enumerate(templates or TEMPLATES) for w in sorted(set(split_words(t)))]
    vectors = ", ".join(f"({n}, {text(name)}, {text(w)}, {tf})" for n, name, w, tf in counted)
    part = f"'{WORD}'"

    def cosine(units: str, by: str) -> str:
        keys = ", ".join(f"d.{k}" for k in by.split(", "))
        on = " AND ".join(f"d.{k} = s.{k}" for k in by.split(", "))
        return f"""(WITH t AS (SELECT {by}, word, count(*) AS tf FROM (SELECT {by}, unnest(w) AS word FROM {units}) GROUP BY {by}, word),
  x AS (SELECT t.*, tf * round(ln((1 + n) / (1 + df)) + 1, 9) AS x FROM t JOIN seen ON t.word = seen.word, total),
  s AS (SELECT {by}, sqrt(sum(x * x)) AS length FROM x GROUP BY {by}),
  d AS (SELECT {by}, template, license, norm, sum(x * y) AS dot FROM x JOIN vec ON x.word = vec.word GROUP BY {by}, template, license, norm)
  SELECT {keys}, license, round(dot / (norm * length), 6) AS score FROM d JOIN s ON {on})"""

    return f"""
WITH raw(template, license, word, tf) AS (VALUES {vectors}), total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
seen AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {part})) AS word FROM documents)) GROUP BY word),
idf AS (SELECT r.word AS word, round(ln((1 + n) / (1 + coalesce(df, 0))) + 1, 9) AS idf FROM (SELECT DISTINCT word FROM raw) r LEFT JOIN seen ON r.word = seen.word, total),
vec AS (SELECT template, license, raw.word AS word, tf * idf AS y, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM raw JOIN idf ON raw.word = idf.word),
f AS (SELECT coalesce(CAST(source AS VARCHAR), 'unknown') || '/' || coalesce(CAST(lang AS VARCHAR), 'unknown') || '/' ||
  coalesce(CAST(CAST(floor(doc_id / {PER_DIRECTORY}) AS BIGINT) AS VARCHAR), 'unknown') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'unknown') AS path, coalesce(text, '') AS text FROM documents),
l AS (SELECT DISTINCT path, regexp_extract_all(lower(line), {part}) AS w FROM (SELECT path, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '{BLANK}'))) AS line FROM f)),
lu AS (SELECT path, w, row_number() OVER () AS unit FROM l WHERE len(w) > 0),
wu AS (SELECT path, regexp_extract_all(lower(text), {part}) AS w FROM f),
ls AS {cosine("lu", "path, unit")},
own AS (SELECT path, license, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS r FROM ls WHERE score >= {LINE}) WHERE r = 1),
ws AS {cosine("wu", "path")},
whole AS (SELECT path, license, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, license) AS r FROM ws) WHERE r = 1 AND score >= {FILE}),
holders AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, license, score, path FROM (SELECT * FROM whole UNION ALL SELECT * FROM own WHERE regexp_matches(path, '{NAMES}'))),
licensed AS (SELECT dir, license AS dir_license FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, path) AS r FROM holders) WHERE r = 1),
names AS (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM f),
near AS (SELECT n.path, l.dir AS from_dir, l.dir_license, row_number() OVER (PARTITION BY n.path ORDER BY length(l.dir) DESC) AS r
  FROM names n JOIN licensed l ON n.dir = l.dir OR starts_with(n.dir, l.dir || '/') OR l.dir = '')
SELECT n.path AS path, own.license AS license, own.score AS score, coalesce(own.license, dir_license) AS effective,
  CASE WHEN own.license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN own.license IS NULL THEN from_dir END AS inherited_from
FROM names n LEFT JOIN own ON n.path = own.path LEFT JOIN near ON n.path = near.path AND near.r = 1
"""
