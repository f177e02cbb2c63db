"""License scans (7): TF-IDF cosine of headers and licence files to templates, then the nearest licensed directory above.

Templates are one-line notices, headers of several lines and whole licence texts. A file is a sequence of words, line
breaks or not; windows as long as a template slide over it wherever it holds a word that every template has one of
(licence, copyright, permission, ..), and are compared with the templates of that length. Words weigh by how few of the
files that hold such a word have them; a word counts once in a window. A file of which matching windows are at least
half, or one that is named like a licence file, licenses its directory; files without a licence of their own take
that of the nearest directory above. DataFrame functions only. The broadcast tables hold the templates' words, a
fixed number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridspark.llm.store import Scratch

# Notices as licences and their stewards word them.
NOTICES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_WARRANTY = ("THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
             "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
             "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_CONDITIONS = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
               "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
               "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
               "and/or other materials provided with the distribution. ")
_DISCLAIMER = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
               "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
               "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
               "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
               "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu(name: str, what: str, version: int) -> str:
    return (f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either "
            f"version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
            f"even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} "
            "along with this program. If not, see <https://www.gnu.org/licenses/>.")


# Headers and whole licences, and how the longest ones begin.
TEXTS = [
    ("AGPL-3.0", _gnu("Affero General Public License", "program", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
                   "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. License shall mean the "
                   "terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("BSD-2-Clause", _CONDITIONS + _DISCLAIMER),
    ("BSD-3-Clause", _CONDITIONS + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
                     "specific prior written permission. " + _DISCLAIMER),
    ("GPL-2.0", _gnu("General Public License", "program", 2)),
    ("GPL-3.0", _gnu("General Public License", "program", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim "
                "copies of this license document, but changing it is not allowed."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
            "notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
            "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
            "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", _gnu("Lesser General Public License", "library", 3)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
            "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software. " + _WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
                "https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
                  "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TEMPLATES = [*NOTICES, *TEXTS]
# Words that weigh nothing, words of which every template has one, and names of licence files.
COMMON = ["a", "and", "any", "are", "for", "in", "into", "is", "it", "of", "on", "or", "the", "this", "to", "with"]
ANCHORS = ["copyright", "licence", "licences", "license", "licensed", "licenses", "permission", "redistribution", "unencumbered"]
ANCHOR_LIKE = "(?i)copyright|licen[cs]e|permission|redistribution|unencumbered"
LICENSE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying)[^/]*$"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD, SHARE = 0.7, 0.5
#: Stands for a null path inside; no file is called that.
NO_PATH = "\0"
#: A term of one digit or letter counts too: versions differ in nothing else.
TERM = "[a-z0-9]+"


def _content(text: Column) -> Column:
    found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda t: ~F.array_contains(F.array(*map(F.lit, COMMON)), t))


def templates(spark: SparkSession) -> DataFrame:
    """(width, slot, license, terms) of every template: its words, and its number among the templates of as many words."""
    rows = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(TEMPLATES)))
    read = spark.range(1).select(F.explode(rows).alias("t")).select("t.at", "t.license", _content(F.col("t.text")).alias("words"))
    # a row per template
    slot = F.row_number().over(Window.partitionBy(F.size("words")).orderBy("at")) - 1
    return read.select(F.size("words").alias("width"), slot.alias("slot"), "license", F.array_distinct("words").alias("terms"))


def micro(x: Column) -> Column:
    """Millionths, so that the order of a sum cannot be seen."""
    return F.floor(x * 1e6 + 0.5001).cast("long")


def _windows(width: int) -> Column:
    """The windows of a width, (width, start), that hold one of `anchors`: at every word if short, else an eighth of the width apart."""
    step = max(1, width // 8)
    reach = lambda p: F.sequence(F.greatest(F.lit(0), F.floor((p - width) / step).cast("int") + 1), F.floor(p / step).cast("int"))
    return F.transform(F.array_distinct(F.flatten(F.transform("anchors", reach))), lambda k: F.struct(F.lit(width).alias("width"), (k * step).alias("start")))


def scan(files: DataFrame, threshold: float = THRESHOLD, share: float = SHARE) -> DataFrame:
    """One row per file of (path, text): path, license, origin, score_micro.

    `origin` is 'own' for a licence in the file (the best window's; of equal ones the first licence by name), else the
    directory that the licence is taken from ('' is the root), else null like `license`. `score_micro` is the cosine of the
    best window in millionths, 0 without any. Null and empty texts, and texts without any of the words that every
    template has one of, have no licence and can only inherit. A null path is in no directory. A text is read whole,
    however long it is. Rows repeated are files of their own with equal results. Other columns are not read.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    known = scratch.keep(templates(spark).coalesce(1), "templates")
    # a file is known by its path and its text; equal ones are told apart nowhere
    rows = files.select(F.coalesce("path", F.lit(NO_PATH)).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    some = F.array(*map(F.lit, ANCHORS))
    read = rows.filter(F.col("text").rlike(ANCHOR_LIKE)).select("row", "path", _content(F.col("text")).alias("words")).filter(F.arrays_overlap("words", some)).distinct()
    read = scratch.keep(read.withColumn("n_words", F.size("words")), "read")

    total = read.count()
    used = known.select(F.explode("terms").alias("term")).distinct()
    held = read.select(F.explode(F.array_distinct("words")).alias("term")).join(F.broadcast(used), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    new = math.log(1 + total) + 1
    weights = used.join(held, "term", "left").select("term", F.pow(F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(0)))) + 1, 2).alias("weight"))
    weights = scratch.keep(weights.coalesce(1), "weights")
    by_term = known.select("width", "slot", F.explode("terms").alias("term")).join(F.broadcast(weights), "term")
    slots = scratch.keep(by_term.groupBy("width", "term", "weight").agg(F.collect_set("slot").alias("slots")).coalesce(1), "slots")
    sizes = by_term.groupBy("width", "slot").agg(F.sqrt(F.sum("weight")).alias("length"))
    named = known.join(sizes, ["width", "slot"]).groupBy("width").agg(F.array_sort(F.collect_list(F.struct("slot", "license", "length"))).alias("templates"))
    named = scratch.keep(named.coalesce(1), "named")
    widths = sorted(r["width"] for r in named.select("width").collect())

    anchors = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(some, w), i)), lambda i: i.isNotNull())
    windows = F.concat(*(_windows(n) for n in widths))
    window = read.withColumn("anchors", anchors).select("row", "path", "n_words", "words", F.explode(windows).alias("w"))
    spread = window.select("row", "path", "n_words", "w.width", "w.start", F.explode(F.array_distinct(F.slice("words", F.col("w.start") + 1, F.col("w.width")))).alias("term"))
    # a word weighs the same in all templates; of a window's words the templates of its width have some
    weighed = spread.join(F.broadcast(weights), "term", "left").join(F.broadcast(slots.select("width", "term", "slots")), ["width", "term"], "left")
    weight = F.coalesce("weight", F.lit(new * new))
    most = known.agg(F.max("slot")).first()[0] + 1
    sums = weighed.groupBy("row", "path", "n_words", "width", "start").agg(
        F.sqrt(F.sum(weight)).alias("own"), F.array(*(F.sum(F.when(F.array_contains("slots", k), weight).otherwise(0.0)) for k in range(most))).alias("dots"))
    scored = F.transform("templates", lambda t: F.struct((-micro(F.get(F.col("dots"), t["slot"]) / (F.col("own") * t["length"]))).alias("minus"), t["license"].alias("license")))
    best = sums.join(F.broadcast(named), "width").select("row", "path", "n_words", "width", "start", F.array_min(scored).alias("best"))
    matched = scratch.keep(best, "matched")

    found = matched.groupBy("row", "path", "n_words").agg(F.min("best").alias("best")).select("row", "path", "n_words", (-F.col("best.minus")).alias("score_micro"), F.col("best.license").alias("best"))
    covered = (matched.filter(-F.col("best.minus") >= micro(F.lit(threshold)))
               .select("row", "path", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + F.col("width"), F.col("n_words")) - 1)).alias("place")).distinct()
               .groupBy("row", "path").agg(F.count(F.lit(1)).alias("n_covered")))
    found = scratch.keep(found.join(covered, ["row", "path"], "left"), "found")
    licensed = found.filter((F.col("score_micro") >= micro(F.lit(threshold))) & (F.col("path") != NO_PATH)
                            & ((F.col("n_covered") >= share * F.col("n_words")) | F.col("path").rlike(LICENSE_FILE)))
    directories = scratch.keep(licensed.groupBy(directory(F.col("path")).alias("above")).agg(
        F.min_by("best", F.struct(-F.col("score_micro"), "path")).alias("inherited")), "directories")

    every = rows.select("row", "path").withColumn("directory", F.when(F.col("path") != NO_PATH, directory(F.col("path"))))
    parts = F.split("directory", "/")
    nearest = (every.select("directory").distinct().filter("directory is not null")
               .select("directory", F.explode(F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("above"))
               .join(directories.hint("merge"), "above").groupBy("directory")
               .agg(F.max_by(F.struct("above", "inherited"), F.length("above")).alias("from")))
    nearest = scratch.keep(nearest.select("directory", "from.above", "from.inherited"), "nearest")
    joined = every.join(found.select("row", "path", "score_micro", "best").hint("merge"), ["row", "path"], "left").join(nearest.hint("merge"), "directory", "left")
    has = F.coalesce(F.col("score_micro") >= micro(F.lit(threshold)), F.lit(False))
    return joined.select(F.nullif(F.col("path"), F.lit(NO_PATH)).alias("path"), F.when(has, F.col("best")).otherwise(F.col("inherited")).alias("license"),
                         F.when(has, F.lit("own")).otherwise(F.col("above")).alias("origin"), F.coalesce("score_micro", F.lit(0)).cast("long").alias("score_micro"))


def directory(path: Column) -> Column:
    """What stands before the last slash; '' at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def quoted(texts: list[str]) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


def _content_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TERM}'), lambda t: NOT list_contains([{quoted(COMMON)}], t))"


#: The same over `documents`, each as a file source/lang/doc_id.
DOCUMENTS_SQL = f"""
WITH files AS (SELECT source || '/' || lang || '/' || doc_id AS path, source || '/' || lang AS directory, coalesce(text, '') AS text FROM documents),
worded AS (SELECT path, {_content_sql("text")} AS words FROM files WHERE regexp_matches(text, '{ANCHOR_LIKE}')),
read AS (SELECT DISTINCT path, words, len(words) AS n_words FROM worded WHERE list_has_any(words, [{quoted(ANCHORS)}])),
template_rows AS (SELECT unnest(generate_series(1, {len(TEMPLATES)})) AS tpl, unnest([{quoted([n for n, _ in TEMPLATES])}]) AS license, unnest([{quoted([t for _, t in TEMPLATES])}]) AS text),
template_words AS (SELECT tpl, license, {_content_sql("text")} AS words FROM template_rows),
template_terms AS (SELECT DISTINCT tpl, license, len(words) AS width, unnest(words) AS term FROM template_words),
total AS (SELECT count(*) AS files FROM read),
held AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT path, unnest(words) AS term FROM read) GROUP BY term),
weights AS (SELECT term, pow(ln((1.0::DOUBLE + files) / (1 + coalesce(df, 0))) + 1, 2) AS weight FROM (SELECT DISTINCT term FROM template_terms) t LEFT JOIN held USING (term), total),
lengths AS (SELECT tpl, license, width, sqrt(sum(weight)) AS length FROM template_terms JOIN weights USING (term) GROUP BY ALL),
widths AS (SELECT DISTINCT width, greatest(1, width // 8) AS step FROM lengths),
anchors AS (SELECT path, n_words, words, p FROM (SELECT path, n_words, words, unnest(range(0, n_words)) AS p FROM read) WHERE list_contains([{quoted(ANCHORS)}], words[p + 1])),
windows AS (SELECT DISTINCT path, n_words, words, width, k * step AS start FROM (
    SELECT path, n_words, words, width, step, unnest(range(greatest(0, floor((p - width)::DOUBLE / step)::BIGINT + 1), p // step + 1)) AS k FROM anchors, widths)),
spread AS (SELECT DISTINCT path, width, start, unnest(words[start + 1:start + width]) AS term FROM windows),
weighed AS (SELECT path, width, start, term, coalesce(weight, pow(ln(1.0::DOUBLE + files) + 1, 2)) AS weight FROM spread LEFT JOIN weights USING (term), total),
own AS (SELECT path, width, start, sqrt(sum(weight)) AS own FROM weighed GROUP BY ALL),
dots AS (SELECT path, w.width, start, tpl, sum(weight) AS dot FROM weighed w JOIN template_terms t ON t.width = w.width AND t.term = w.term GROUP BY ALL),
scored AS (SELECT path, d.width, start, license, floor(dot / (own * length) * 1e6::DOUBLE + 0.5001::DOUBLE)::BIGINT AS score FROM dots d JOIN own USING (path, width, start) JOIN lengths l ON l.tpl = d.tpl),
found AS (SELECT path, max(score) AS score_micro, arg_min(license, (-score, license)) AS best FROM scored GROUP BY path),
covered AS (SELECT path, count(DISTINCT place) AS n_covered FROM (
    SELECT path, unnest(range(start, least(start + width, n_words))) AS place FROM (SELECT DISTINCT path, width, start FROM scored WHERE score >= 700000) JOIN read USING (path)) GROUP BY path),
directories AS (SELECT regexp_replace(path, '/[^/]*$', '') AS above, arg_min(best, (-score_micro, path)) AS inherited FROM found JOIN read USING (path) LEFT JOIN covered USING (path)
    WHERE score_micro >= 700000 AND (n_covered >= 0.5 * n_words OR regexp_matches(path, '{LICENSE_FILE}')) GROUP BY ALL),
ancestors AS (SELECT DISTINCT directory, above FROM (SELECT directory, unnest([split_part(directory, '/', 1), directory]) AS above FROM files)),
nearest AS (SELECT directory, arg_max(above, length(above)) AS above, arg_max(inherited, length(above)) AS inherited FROM ancestors JOIN directories USING (above) GROUP BY directory)
SELECT f.path, CASE WHEN coalesce(score_micro, 0) >= 700000 THEN best ELSE inherited END AS license,
    CASE WHEN coalesce(score_micro, 0) >= 700000 THEN 'own' ELSE above END AS origin, coalesce(score_micro, 0)::BIGINT AS score_micro
FROM files f LEFT JOIN found USING (path) LEFT JOIN nearest USING (directory)
"""
