"""Licence notices in texts: Dice coefficient of word bigrams against templates.

A text is looked at as a whole, by paragraph (blank lines between) and by line. Each such unit is brought to
lower-case words; its set of bigrams is compared with those templates only whose size allows the threshold:
2 min / (a + b) bounds the coefficient. With ``inside``, lines that belong to no hit are also searched for notices within
longer texts and across lines: windows as long as a template, from each place where one of its bigrams stands. Before that, a text must contain one of a few words: for each template enough words are
chosen that a unit without all of them has lost too many bigrams to reach the threshold. Both bounds are exact.
Everything runs in DataFrame operations, row by row, without a shuffle.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.functions.fence import compute_once

from .spotsigs import ANCHORS

# Notices and licence texts as their publishers give them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
THRESHOLD = 0.8
SIGNS = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    """Words of a template; they are of letters and digits without accents."""
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def needed_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which a text with a unit at the threshold has at least one.

    A unit that shares s of a template's n bigrams has at least s itself, so its coefficient is 2 s / (n + s) at most:
    it may miss n - s bigrams only, where s is the least with 2 s / (n + s) >= threshold. Longest and uncommon words
    first, words are taken until they are in more bigrams than that.
    """
    out: set[str] = set()
    for text in templates.values():
        left = set(bigrams_of(text))
        n = len(left)
        missed = n - math.ceil(threshold * n / (2 - threshold) - 1e-9)
        gone = 0
        for word in sorted({w for b in left for w in b.split()}, key=lambda w: (w in ANCHORS, w not in out, -len(w), w)):
            if gone > missed:
                break
            mine = {b for b in left if word in b.split()}
            if mine:
                out.add(word)
                gone, left = gone + len(mine), left - mine
    return sorted(out)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), SIGNS, " "))


def _with_windows(rows: DataFrame, known: Column, low: float, threshold: float) -> DataFrame:
    """``_h`` with one more unit for each different window of the lines outside the units ``_hit``."""
    # A sign that is no word stands for the lines left out, so that nothing matches across them.
    lines = F.transform(F.split("_l", "\n"), _normal)
    covered = lambda line: F.exists("_hit", lambda u: F.contains(F.concat(F.lit(" "), u, F.lit(" ")), F.concat(F.lit(" "), line, F.lit(" "))))
    rest = F.filter(F.transform(lines, lambda x: F.when((x != "") & covered(x), F.lit("|")).otherwise(x)), lambda x: x != "")
    rows = compute_once(rows, F.split(F.array_join(rest, " "), " ").alias("_r")).drop("_l", "_hit")
    n = F.size("_r") - 1
    rows = compute_once(rows, F.when(n > 0, F.zip_with(F.slice("_r", F.lit(1), n), F.slice("_r", F.lit(2), n), lambda a, b: F.concat_ws(
        " ", a, b))).alias("_g")).drop("_r")
    rows = compute_once(rows, F.filter(known, lambda k: F.size(F.array_intersect("_g", k["b"])) >= k["n"] * low - 1e-9).alias("_k"))

    def window(k: Column, p: Column) -> Column:
        unit = F.array_distinct(F.slice("_g", p + 1, k["w"]))
        dice = F.size(F.array_intersect(unit, k["b"])) * F.lit(-2.0) / (k["n"] + F.size(unit))
        return F.struct(dice.alias("minus"), k["name"].alias("name"), p.alias("p"), k["w"].alias("n"))

    places = lambda k: F.filter(F.sequence(F.lit(0), F.size("_g") - 1), lambda i: F.array_contains(k["b"], F.get("_g", i)))
    near = F.transform("_k", lambda k: F.filter(F.transform(places(k), lambda p: window(k, p)), lambda w: w["minus"] <= -threshold))
    rows = compute_once(rows, F.flatten(near).alias("_w")).drop("_k")
    order = lambda w: F.struct(-w["n"], w["minus"], w["p"], w["name"])
    overlap = lambda v, w: (v["p"] < w["p"] + w["n"]) & (w["p"] < v["p"] + v["n"])
    best = F.filter("_w", lambda w: ~F.exists("_w", lambda v: overlap(v, w) & (order(v) < order(w))))
    one = lambda w: F.struct(w["minus"].alias("minus"), w["name"].alias("name"), F.array_join(
        F.slice("_g", w["p"] + 1, w["n"]), ",").alias("unit"))
    rows = compute_once(rows, F.array_distinct(F.transform(best, one)).alias("_v")).drop("_w", "_g")
    more = F.transform("_v", lambda w: F.array(F.struct(w["minus"].alias("minus"), w["name"].alias("name"))))
    return rows.withColumn("_h", F.when(F.col("_v").isNull(), F.col("_h")).otherwise(F.concat("_h", more))).drop("_v")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, doc_id: str = "doc_id",
         text: str = "text", inside: bool = False) -> DataFrame:
    """doc_id, license, dice, units and licenses of each row.

    ``license`` is the template with the highest coefficient of any unit (ties: the first by name), ``dice`` that
    coefficient, ``licenses`` all templates that a unit reaches the threshold with, by name, and ``units`` the
    number of different units that do. With ``inside``, windows of words outside of those units count as units; of
    windows that overlap, the longest template stays, then the highest coefficient, then the first. Without any, license is null, dice 0 and the others empty. Null, empty and very short
    texts have none. Repeated rows stay repeated, other columns are not read, an empty table gives an empty result.
    """
    templates = TEMPLATES if templates is None else templates
    listed = sorted((name, bigrams_of(t)) for name, t in templates.items())
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), F.split(F.lit("|".join(b)), r"\|").alias("b"),
                               F.lit(len(words_of(templates[name])) - 1).alias("w")) for name, b in listed))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    fewest = math.ceil(low * min(len(b) for _, b in listed) - 1e-9)
    needed = r"(?<![\p{L}\p{N}])(?:" + "|".join(needed_words(templates, threshold)) + r")(?![\p{L}\p{N}])"

    def bigrams(unit: Column) -> Column:
        words = F.split(unit, " ")
        n = F.size(words) - 1
        return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))

    def hits(unit: Column) -> Column:
        n = F.size(unit)
        sized = F.filter(known, lambda k: (n >= k["n"] * low - 1e-9) & (n <= k["n"] * high + 1e-9))
        scored = F.transform(sized, lambda k: F.struct(
            (F.size(F.array_intersect(unit, k["b"])) * F.lit(-2.0) / (n + k["n"])).alias("minus"), k["name"].alias("name")))
        return F.filter(scored, lambda h: h["minus"] <= -threshold)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"))
    rows = compute_once(rows, F.when(F.lower("_t").rlike(needed), F.col("_t")).alias("_l")).drop("_t")
    rows = compute_once(rows, F.when(F.col("_l").isNotNull(), F.array_distinct(F.transform(F.concat(
        F.array("_l"), F.split("_l", r"\n[ \t]*\n"), F.split("_l", "\n")), _normal))).alias("_u"))
    long = F.filter("_u", lambda u: F.length(F.translate(u, " ", "")) <= F.length(u) - fewest)
    rows = compute_once(rows.withColumn("_u", long), F.transform(long, bigrams).alias("_b"))
    rows = compute_once(rows, F.transform("_b", hits).alias("_all")).drop("_b")
    rows = compute_once(rows, F.filter("_all", lambda h: F.size(h) > 0).alias("_h"), F.filter(
        "_u", lambda u, i: F.size(F.get("_all", i)) > 0).alias("_hit")).drop("_all", "_u")
    if inside:
        rows = _with_windows(rows, known, low, threshold)
    best, names = F.array_min(F.flatten("_h")), F.transform(F.flatten("_h"), lambda h: h["name"])
    return rows.select(
        "doc_id", best["name"].alias("license"), F.coalesce(-best["minus"], F.lit(0.0)).alias("dice"),
        F.greatest(F.coalesce(F.size("_h"), F.lit(0)), F.lit(0)).cast("long").alias("units"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), ","), F.lit("")).alias("licenses"))


def oracle(threshold: float = THRESHOLD) -> str:
    """The same as DuckDB SQL: every unit against every template, without any bound."""
    values = ",\n".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    cut = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    pairs = ("list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))")
    return f"""
    WITH templates(name, t) AS (VALUES {values}),
    known AS (SELECT name, {pairs.format(w="w")} AS b FROM (SELECT name, string_split({cut.format("t")}, ' ') AS w FROM templates)),
    each_unit AS (
        SELECT DISTINCT r, {cut.format("u")} AS u FROM (
            SELECT r, unnest(list_concat([text], regexp_split_to_array(text, '\\n[ \\t]*\\n'), string_split(text, chr(10)))) AS u
            FROM (SELECT row_number() OVER () AS r, coalesce(text, '') AS text FROM documents))),
    cut_units AS (SELECT r, u, {pairs.format(w="w")} AS b FROM (SELECT *, string_split(u, ' ') AS w FROM each_unit)),
    scored AS (
        SELECT r, u, name, 2.0::DOUBLE * len(list_intersect(k.b, c.b)) / (len(k.b) + len(c.b)) AS dice
        FROM cut_units c, known k WHERE len(c.b) > 0),
    hits AS (
        SELECT r, min({{'d': -dice, 'n': name}}) AS best, count(DISTINCT u) AS units,
               string_agg(DISTINCT name, ',' ORDER BY name) AS licenses
        FROM scored WHERE dice >= {threshold} GROUP BY r)
    SELECT doc_id, best.n AS license, coalesce(-best.d, 0.0)::DOUBLE AS dice, coalesce(units, 0)::BIGINT AS units,
           coalesce(licenses, '') AS licenses
    FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN hits USING (r)"""
