"""License scans: Dice coefficient over word bigrams, with built-in functions only."""

from __future__ import annotations

import json
import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIMILARITY = 0.8

#: Notices, texts and paragraphs of well-known public licences. Paragraphs that both BSD licences have stand for the shorter one.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License v3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License v3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}


def _bigrams(text: str) -> list[str]:
    words = re.sub(r"[.!?]", "", re.sub(r"[^\w\n.!?]+|_", " ", text.lower())).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def sizes(bigrams: int, similarity: float = SIMILARITY) -> range:
    """Numbers of bigrams that a unit may have for the coefficient to reach ``similarity``."""
    least, most = similarity / (2 - similarity) * bigrams, (2 - similarity) / similarity * bigrams
    return range(max(1, ceil(least - 1e-9)), int(most + 1e-9) + 1)


def templates(similarity: float = SIMILARITY) -> list[tuple[int, str, list[str]]]:
    """(admissible number of bigrams, licence, bigrams) of every template and admissible number."""
    return [(m, name, b) for name, texts in TEMPLATES.items() for b in map(_bigrams, texts) for m in sizes(len(b), similarity)]


def marks(similarity: float = SIMILARITY) -> list[str]:
    """Words of which a unit must have one to be ``similarity`` like any template.

    Such a unit has at least similarity / (2 - similarity) of a template's
    bigrams. Long words are taken until the bigrams with one of them are more
    than those that may be missing.
    """
    found = set()
    for texts in TEMPLATES.values():
        for grams in map(_bigrams, texts):
            missing, left = int((1 - similarity / (2 - similarity)) * len(grams) + 1e-9), list(grams)
            words = sorted({w for g in grams for w in g.split()}, key=lambda w: (w not in found, -len(w), w))
            while len(grams) - len(left) <= missing:
                found.add(words[0])
                left = [g for g in left if words[0] not in g.split()]
                words.pop(0)
    return sorted(found)


def _pieces(flat: Column) -> Column:
    """A normalised text, its paragraphs, lines and sentences."""
    cuts = [F.split(flat, p) for p in (r"\n ?\n", r"\n", r"\n|[.!?]+ ")]
    return F.array_distinct(F.concat(F.array(flat), *cuts))


def scan(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Licences found: doc_id, licence, dice (the best), n_units (different pieces of text that match).

    A unit is a whole text, paragraph, line or sentence, compared by its set of
    word bigrams, lower-cased and without punctuation, and counts for the licence
    it is most like (of equal ones the last by name). Only templates whose
    number of bigrams admits the similarity meet a unit: the size bounds are
    the key of the join with the template table, which is fixed and small.
    Texts and units without any of the words that a match must have are left out
    before.
    Null, empty and one-word texts match nothing, very long ones are read whole;
    equal rows, and rows with one doc_id, count as one document; an empty table
    gives no rows; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    fixed = F.broadcast(spark.createDataFrame(templates(similarity), "m int, licence string, template array<string>"))
    marked = F.array(*map(F.lit, marks(similarity)))
    # first whole texts by their words, so that few are cut into units
    some = docs.where(F.arrays_overlap(F.split(F.translate(F.lower("text"), ".!?", ""), r"[^\p{L}\p{N}]+"), marked))
    flat = some.select("doc_id", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n.!?]+", " ").alias("flat"))
    units = flat.select("doc_id", F.explode(_pieces(F.col("flat"))).alias("unit")).select("doc_id", F.regexp_replace("unit", r"[.!?]", "").alias("bare"), "unit")
    # a unit's different words are at most one more than its different bigrams, repeats or not
    most = 1 + max(m for m, _, _ in templates(similarity))
    words = F.filter(F.split("bare", r"[ \n]+"), lambda w: w != "")
    units = units.select("doc_id", "unit", words.alias("w")).where((F.size("w") >= 2) & F.arrays_overlap("w", marked) & (F.size(F.array_distinct("w")) <= most))
    units = units.select("doc_id", F.md5(F.col("unit").cast("binary")).alias("unit"), "w")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))))
    units = units.select("doc_id", "unit", grams.alias("grams")).withColumn("m", F.size("grams"))
    dice = 2 * F.size(F.array_intersect("grams", "template")) / (F.col("m") + F.size("template"))
    hits = units.join(fixed, "m").withColumn("dice", dice).where(F.col("dice") >= similarity)
    best = hits.groupBy("doc_id", "unit").agg(F.max(F.struct("dice", "licence")).alias("best"))
    return best.groupBy("doc_id", F.col("best.licence").alias("licence")).agg(F.round(F.max("best.dice"), 6).alias("dice"), F.count("*").alias("n_units"))


def scan_sql(similarity: float = SIMILARITY) -> str:
    rows = ", ".join(f"({m}, '{name}', {json.dumps(b)!r}::JSON::VARCHAR[])".replace('\\"', '"') for m, name, b in templates(similarity))
    return rf"""
WITH t(m, licence, template) AS (VALUES {rows}),
f AS (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n.!?]+', ' ', 'g') AS flat FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_distinct([flat] || regexp_split_to_array(flat, '\n ?\n') || regexp_split_to_array(flat, '\n') || regexp_split_to_array(flat, '\n|[.!?]+ '))) AS unit FROM f),
w AS (SELECT doc_id, unit, list_filter(regexp_split_to_array(regexp_replace(unit, '[.!?]', '', 'g'), '[ \n]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) >= 2),
d AS (SELECT doc_id, unit, licence, 2 * len(list_intersect(grams, template))::DOUBLE / (m + len(template)) AS dice FROM g JOIN t ON len(grams) = m),
b AS (SELECT doc_id, unit, max({{'dice': dice, 'licence': licence}}) AS b FROM d WHERE dice >= {similarity} GROUP BY doc_id, unit)
SELECT doc_id, b.licence AS licence, round(max(b.dice), 6) AS dice, count(*) AS n_units FROM b GROUP BY ALL
"""
