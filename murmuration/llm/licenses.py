"""Licence scan: texts against licence templates by the Dice coefficient of their sets of word bigrams. DataFrame functions only, no shuffle.

Units compared are every line, every block between blank lines that has several lines, the whole text if it has several
blocks, and every window of as many words as a template has, wherever it begins and however it is wrapped; of windows of
one template that lie close together the best is told. With threshold t, Dice of sets of sizes a and b can reach t only if
a / b lies between t / (2 - t) and (2 - t) / t, so that a unit meets the templates of fitting size alone. It also follows
that a unit which reaches t lacks at most (2 - 2t) / (2 - t) of a template's g bigrams: so of any more than that many one
at least is in it. These, the ones with the longest words, are sought first, and all else is done round their hits.
"""

from __future__ import annotations

import json
import math
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least Dice coefficient.
THRESHOLD = 0.8

_NO_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_END = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD_START = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

# Public licence texts and notices, normalised (lower case, words only). Several templates may name one licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _NO_WARRANTY),
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}"),
    ("BSD", "licensed under the bsd license"),
    ("Zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"),
    ("Unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("Apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("Apache-2.0", "licensed under the apache license version 2 0"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4 0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4 0"),
    ("CC-BY-4.0", "licensed under cc by 4 0"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("All rights reserved", "all rights reserved"),
)


def bigrams(words: str) -> list[str]:
    w = words.split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def rare(words: str, threshold: float) -> list[str]:
    """Bigrams of a template of which every unit that reaches the threshold has one at least: those with the longest words."""
    grams = bigrams(words)
    spared = math.floor(len(grams) * (2 - 2 * threshold) / (2 - threshold) + 1e-9)
    return sorted(grams, key=lambda b: (-max(map(len, b.split())), b))[: spared + 1]


def _normal(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def read_templates(spark: SparkSession, folder: str) -> tuple[tuple[str, str], ...]:
    """Templates from whole licence texts, a file each, named by the file without its suffix: for long licences, whose texts are not part of this module.

    The texts come to the driver: a folder of licences, not of documents.
    """
    texts = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)?$", 1).alias("name"), _normal(F.col("value")).alias("text"))
    return tuple((unquote(r["name"]), r["text"]) for r in texts.where("contains(text, ' ')").orderBy("name", "text").collect())


def _pairs(words: str) -> Column:
    return F.transform(F.slice(words, 2, F.size(words)), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))


def _windows(rows: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """(id, unit, unit_no, best) of the windows of rows (id, words); unit_no is the number of a window's first word.

    A window that begins less than half a template's words after another of that template belongs with it; of each
    template's length of starts that belong together, counted from the first, the best is told, of equally good ones the
    first. So copies that follow each other are told each.
    """
    listed = [{"name": n, "size": len(t.split()), "grams": (g := bigrams(t)), "rare": rare(t, threshold), "least": math.ceil(len(g) * threshold / (2 - threshold) - 1e-9)} for n, t in templates]
    known = F.from_json(F.lit(json.dumps(listed)), "array<struct<name string, size int, grams array<string>, rare array<string>, least int>>")
    able = F.filter(known, lambda t: (F.size("pairs") >= t["size"] - 1) & F.arrays_overlap("pairs", t["rare"]) & (F.size(F.array_intersect("pairs", t["grams"])) >= t["least"]))
    rows = rows.select("id", F.explode(F.array(_pairs("words"))).alias("pairs")).where(F.size("pairs") > 0).select("id", "pairs", F.explode(able).alias("t"))
    size, last = F.col("t.size"), F.size("pairs") + 1 - F.col("t.size")
    hits = F.filter(F.sequence(F.lit(0), F.size("pairs") - 1), lambda p: F.array_contains(F.col("t.rare"), F.get("pairs", p)))
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(F.greatest(F.lit(0), p - size + 2), F.least(p, last))))))
    dice = lambda s: F.transform(F.array(F.array_distinct(F.slice("pairs", s + 1, size - 1))), lambda p: F.lit(2.0) * F.size(F.array_intersect(p, F.col("t.grams"))) / (F.size(p) + F.size("t.grams")))[0]
    scored = F.filter(F.transform(starts, lambda s: F.struct(s.alias("at"), dice(s).alias("dice"))), lambda x: x["dice"] >= threshold)
    rows = rows.select("id", "t.name", "t.size", F.explode(F.array(scored)).alias("w")).where(F.size("w") > 0)

    def split(rows: DataFrame, new) -> DataFrame:
        """A row of `w` into one for each part; new(i): whether one begins there."""
        begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | new(i))
        rows = rows.select("id", "name", "size", "w", F.explode(F.array(begins)).alias("b"))
        parts = F.transform("b", lambda b, i: F.slice("w", b + 1, F.coalesce(F.get("b", i + 1), F.size("w")) - b))
        return rows.select("id", "name", "size", F.explode(parts).alias("w"))

    at = lambda i: F.get("w", i)["at"]
    rows = split(rows, lambda i: 2 * (at(i) - at(i - 1)) >= F.col("size"))
    cell = lambda i: F.floor((at(i) - at(F.lit(0))) / F.col("size"))
    rows = split(rows, lambda i: cell(i) != cell(i - 1))
    rows = rows.select("id", "name", F.array_min(F.transform("w", lambda x: F.struct((-x["dice"]).alias("dice"), x["at"].alias("at")))).alias("x"))
    return rows.select("id", F.lit("window").alias("unit"), F.col("x.at").cast("int").alias("unit_no"), F.struct("x.dice", "name").alias("best"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(id, unit, unit_no, license, dice) of every unit whose best template reaches the threshold; dice rounded to 6 places.

    unit is line, block, text or window, unit_no counts from 0 (a window's is the number of its first word). Of templates
    that are equally good for a line, block or text the first by name is named; every template has windows of its own. Null, empty and one-word texts match nothing; null and repeated ids are kept,
    each row by itself. Whole texts, however long. Other columns are not read. Empty table: empty result.
    """
    templates = tuple((n, t) for n, t in templates if bigrams(t))
    if not templates:
        return docs.where("false").select(F.col(id_col).alias("id"), F.lit("").alias("unit"), F.lit(0).alias("unit_no"), F.lit("").alias("license"), F.lit(0.0).alias("dice"))
    known = F.from_json(F.lit(json.dumps([{"name": name, "grams": bigrams(t)} for name, t in templates])), "array<struct<name string, grams array<string>>>")
    sizes = [len(bigrams(t)) for _, t in templates]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    unit = lambda kind: lambda t, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("unit_no"), t.alias("text"))
    lines, blocks = F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n")
    units = F.concat(F.transform(lines, unit("line")), F.filter(F.transform(blocks, unit("block")), lambda u: F.contains(u["text"], F.lit("\n"))), F.when(F.size(blocks) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), F.col("text").alias("text")))).otherwise(F.array()))
    # explode(array(x)) computes x once a row; in a plain projection every later use would compute it again
    words = F.explode(F.array(F.split(_normal(F.col("text")), " "))).alias("words")
    sought = F.array(*[F.lit(w) for w in sorted({max(b.split(), key=len) for _, t in templates for b in rare(t, threshold)})])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").select("id", "text", words).where(F.arrays_overlap("words", sought))
    rows = texts.select("id", F.explode(units).alias("u"))
    rows = rows.select("id", "u.unit", "u.unit_no", F.explode(F.array(F.split(_normal(F.col("u.text")), " "))).alias("words")).where(F.size("words") > max(1, int(low * min(sizes))))
    rows = rows.select("id", "unit", "unit_no", F.explode(F.array(F.array_distinct(_pairs("words")))).alias("pairs"))
    size = F.size("pairs")
    near = F.filter(known, lambda t: size.between(F.size(t["grams"]) * low - 1e-9, F.size(t["grams"]) * high + 1e-9))
    scored = F.transform(near, lambda t: F.struct((F.lit(-2.0) * F.size(F.array_intersect("pairs", t["grams"])) / (size + F.size(t["grams"]))).alias("dice"), t["name"].alias("name")))
    best = rows.where(size <= max(sizes) * high).select("id", "unit", "unit_no", F.explode(F.array(F.array_min(scored))).alias("best"))
    best = best.unionByName(_windows(texts.select("id", "words"), templates, threshold))
    return best.where(F.col("best.dice") <= -threshold).select("id", "unit", "unit_no", F.col("best.name").alias("license"), F.round(-F.col("best.dice"), 6).alias("dice"))


def scan_sql(threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """The same over `documents`, in DuckDB's SQL: windows from every word of every text that has enough of a template's bigrams."""
    values = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(templates))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    normal = "string_split(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
WITH k AS (SELECT k, name, len(w) AS m, {grams} AS g FROM (SELECT k, name, string_split(t, ' ') AS w FROM (VALUES {values}) v(k, name, t))),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS b FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS unit_no, unnest(l) AS t FROM d
      UNION ALL SELECT * FROM (SELECT doc_id, 'block' AS unit, unnest(range(len(b))) AS unit_no, unnest(b) AS t FROM d) WHERE contains(t, chr(10))
      UNION ALL SELECT doc_id, 'text', 0, text FROM d WHERE len(b) > 1),
n AS (SELECT doc_id, unit, unit_no, {normal.format("t")} AS w FROM u),
p AS (SELECT doc_id, unit, unit_no, {grams} AS p FROM n WHERE len(w) > 1),
s AS (SELECT doc_id, unit, unit_no, name, 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) AS dice
      FROM p JOIN k ON len(p) BETWEEN len(g) * {low} - 1e-9 AND len(g) * {high} + 1e-9),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, name) AS best FROM s WHERE dice >= {threshold}),
a AS (SELECT row_number() OVER () AS n, doc_id, w, {grams} AS p FROM (SELECT doc_id, {normal.format("text")} AS w FROM d)),
c AS (SELECT n, doc_id, w, k, name, m, g FROM a JOIN k ON len(w) >= m AND len(list_intersect(p, g)) >= {low} * len(g) - 1e-9),
q AS (SELECT n, doc_id, k, name, m, g, pos, w[pos + 1:pos + m] AS w FROM (SELECT *, unnest(range(len(w) - m + 1)) AS pos FROM c)),
x AS (SELECT n, doc_id, k, name, m, pos, 2.0::DOUBLE * len(list_intersect({grams}, g)) / (len({grams}) + len(g)) AS dice FROM q),
y AS (SELECT *, CASE WHEN 2 * (pos - lag(pos) OVER (PARTITION BY n, k ORDER BY pos)) < m THEN 0 ELSE 1 END AS begins FROM x WHERE dice >= {threshold}),
z AS (SELECT *, sum(begins) OVER (PARTITION BY n, k ORDER BY pos) AS part FROM y),
h AS (SELECT *, (pos - min(pos) OVER (PARTITION BY n, k, part)) // m AS cell FROM z),
o AS (SELECT *, row_number() OVER (PARTITION BY n, k, part, cell ORDER BY dice DESC, pos) AS best FROM h)
SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, name AS license, round(dice, 6) AS dice FROM r WHERE best = 1
UNION ALL SELECT doc_id, 'window', CAST(pos AS INTEGER), name, round(dice, 6) FROM o WHERE best = 1
"""
