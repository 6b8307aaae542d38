"""License scan in DataFrame operations only: Dice over word bigrams against templates.

A text is one sequence of words, whatever its line breaks. Its candidates for a template are the stretches that begin and end
with a bigram of the template and whose size can reach the threshold (Dice >= t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t),
so notices are found in the middle of a paragraph and over wrapped lines. Each template names trigger words of which any
stretch at the threshold holds one; texts without a trigger leave the scan before they are split.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import ascii_lower, table

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or"
    " (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or"
    " FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY"
    " EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT"
    " HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
    " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)"
    " ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (licence, text): short notices, standard file headers and the bodies of short licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
        " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION"
        " OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD.format("")),
    (
        "BSD-3-Clause",
        _BSD.format("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
    ),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or"
        " as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
THRESHOLD = 0.8


class Template:
    """A template's bigrams with their numbers, and the sizes and shared counts that the threshold admits."""

    def __init__(self, number: int, licence: str, text: str, threshold: float):
        words = re.findall("[a-z0-9]+", text.translate({c: c + 32 for c in range(65, 91)}))
        grams = list(zip(words, words[1:], strict=False))
        if not grams:
            raise ValueError(f"a template of {licence} has fewer than two words")
        self.number, self.licence, self.size = number, licence, len(grams)
        self.bigrams = Counter(" ".join(g) for g in grams)
        #: A stretch at the threshold shares so many bigrams at least, and has so many at most.
        self.shared = max(1, math.ceil(threshold * self.size / (2 - threshold) - 1e-9))
        self.most = math.floor((2 - threshold) / threshold * self.size + 1e-9)
        # More bigrams are or hold a trigger than such a stretch can do without. Long words are rare ones; where they do not
        # suffice, whole bigrams are added.
        self.triggers: set[str] = set()
        left = self.size - self.shared
        for trigger in sorted((w for w in set(words) if len(w) > 5), key=lambda w: (-len(w), w)) + sorted(self.bigrams, key=lambda g: (-len(g), g)):
            if self.covered() > left:
                break
            self.triggers.add(trigger)

    def covered(self) -> int:
        return sum(n for g, n in self.bigrams.items() if self.triggers & {g, *g.split()})


def holds_trigger(low: Column, templates: Sequence[Template]) -> Column:
    """Whether lower-cased text holds a trigger of any template (words perhaps inside other words)."""
    every = set().union(*(t.triggers for t in templates))
    words = {w for w in every if " " not in w}
    seen = F.lit(False)
    for word in sorted(w for w in words if not any(v != w and v in w for v in words)):
        seen = seen | F.contains(low, F.lit(word))
    for pair in sorted(every - words):
        first, second = pair.split()
        if not any(w in first or w in second for w in words):
            rare, other = sorted((first, second), key=len, reverse=True)
            seen = seen | (F.contains(low, F.lit(rare)) & F.contains(low, F.lit(other)) & low.rlike(f"{first}[^a-z0-9]+{second}"))
    return seen


def stretches(hits: Column, shared: Column, most: Column, size: Column) -> Column:
    """For each hit (ordered structs of pos, gram and cap) that can begin a stretch: the best one that begins there, as
    (dice, start, n); of equal ones the shortest. Shared bigrams count as often as both sides have them."""
    n_hits = F.size(hits)
    far = lambda i: F.get(hits, i + shared - 1)["pos"] - F.get(hits, i)["pos"] + 1 <= most
    starts = F.when(n_hits >= shared, F.filter(F.sequence(F.lit(0), F.greatest(n_hits - shared, F.lit(0))), far)).otherwise(F.array().cast("array<int>"))

    def best(i: Column) -> Column:
        first = F.get(hits, i)["pos"]
        part = F.filter(F.slice(hits, i + 1, most), lambda x: x["pos"] - first + 1 <= most)
        # A bigram counts up to the number of times that the template has it.
        counts = F.transform(part, lambda x, k: F.struct(x["pos"].alias("pos"), (F.size(F.filter(F.slice(part, 1, k + 1), lambda y: y["gram"] == x["gram"])) <= x["cap"]).cast("int").alias("new")))
        zero = F.struct(F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), F.lit(0).alias("n"))

        def step(acc: Column, x: Column) -> Column:
            now = acc["shared"] + x["new"]
            n = x["pos"] - first + 1
            dice = F.lit(2.0) * now / (n + size)
            more = dice > acc["dice"]
            return F.struct(now.alias("shared"), F.when(more, dice).otherwise(acc["dice"]).alias("dice"), F.when(more, n).otherwise(acc["n"]).alias("n"))

        return F.aggregate(counts, zero, step, lambda acc: F.struct(acc["dice"].alias("dice"), first.alias("start"), acc["n"].alias("n")))

    return F.transform(starts, best)


def scan_licences(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and matched licence: ``doc_id, licence, dice, first_word, n_words``.

    Words are ``[a-z0-9]+`` after lower-casing A-Z, counted from 0. ``dice`` (of bigrams with their counts, rounded to 6 digits)
    is the best over the text's stretches; of equal ones the first, then the shortest is named. A licence whose best stretch overlaps a better
    one of another licence (of equal ones the alphabetically first) is left out, so a notice counts for the closest version
    alone. Null, empty and wordless texts match nothing; texts of any length are scanned whole; of rows that repeat an id the
    best stretch is named. An empty table gives an empty result. Other columns are not read. ``templates`` are a bounded
    argument (they travel inside the plan), not data.
    """
    spark = docs.sparkSession
    known = [Template(i, name, text, threshold) for i, (name, text) in enumerate(templates)]
    grams = sorted(set().union(*(t.bigrams for t in known)))
    number = {g: i for i, g in enumerate(grams)}
    rows = [(g, number[g], t.number, t.licence, n, t.size, t.shared, t.most) for t in known for g, n in sorted(t.bigrams.items())]
    # One row per bigram of a template: bounded by the argument, so it is broadcast.
    index = F.broadcast(spark.createDataFrame(rows, "pair string, gram int, tmpl int, licence string, cap int, size int, shared int, most int"))
    text = F.col(text_col).cast("string")
    told = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.lower(text).alias("low")).where(holds_trigger(F.col("low"), known))
    words = F.filter(F.split(F.regexp_replace(ascii_lower(F.col("text")), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    # Copies under one id are scanned once; a text is known by id and digest from here on.
    texts = told.select("doc_id", F.sha2("text", 256).alias("key"), F.array(words).alias("_w")).select("doc_id", "key", F.explode("_w").alias("words")).where(F.size("words") > 1)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    found = texts.select("doc_id", "key", F.posexplode(pairs).alias("pos", "pair")).join(index, "pair")
    by = ["doc_id", "key", "tmpl", "licence", "size", "shared", "most"]
    # Equal rows (one id, one text) give equal hits, so a set of them holds each once.
    hits = found.groupBy(*by).agg(F.sort_array(F.collect_set(F.struct("pos", "gram", "cap"))).alias("hits"))
    each = hits.select("doc_id", "key", "licence", F.explode(stretches(F.col("hits"), F.col("shared"), F.col("most"), F.col("size"))).alias("s")).where(F.col("s.dice") >= threshold)
    best = each.groupBy("doc_id", "key", "licence").agg(F.min(F.struct((-F.col("s.dice")).alias("d"), F.col("s.start").alias("start"), F.col("s.n").alias("n"))).alias("b"))
    rivals = best.groupBy("doc_id", "key").agg(F.collect_list(F.struct("licence", "b")).alias("all"))  # at most one entry for each licence
    better = lambda y, x: (y["b"]["d"] < x["b"]["d"]) | ((y["b"]["d"] == x["b"]["d"]) & (y["licence"] < x["licence"]))
    # A stretch of n bigrams has n + 1 words.
    meets = lambda y, x: (y["b"]["start"] <= x["b"]["start"] + x["b"]["n"]) & (x["b"]["start"] <= y["b"]["start"] + y["b"]["n"])
    kept = rivals.select("doc_id", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: better(y, x) & meets(y, x)))).alias("x"))
    out = kept.groupBy("doc_id", F.col("x.licence").alias("licence")).agg(F.min("x.b").alias("b"))
    return out.select("doc_id", "licence", F.round(-F.col("b.d"), 6).alias("dice"), F.col("b.start").cast("bigint").alias("first_word"), (F.col("b.n") + 1).cast("bigint").alias("n_words"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB SQL over all stretches, without triggers."""
    sizes = [Template(i, name, text, threshold) for i, (name, text) in enumerate(templates)]
    values = ", ".join(f"({t.number}, '{t.licence}', '{text.replace(chr(39), chr(39) * 2)}', {t.shared}, {t.most})" for t, (_, text) in zip(sizes, templates, strict=True))
    split = "list_filter(string_split(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"""
WITH tmpl AS (
  SELECT k, licence, {split.format("notice")} AS ws, shared, most FROM (VALUES {values}) t(k, licence, notice, shared, most)
), tpair AS (
  SELECT k, licence, shared, most, len(ws) - 1 AS size, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair FROM tmpl
), tgram AS (
  SELECT k, licence, shared, most, size, pair, count(*) AS cap FROM tpair GROUP BY ALL
), texts AS (
  SELECT row_number() OVER () AS d, doc_id, {split.format("text")} AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), words AS (
  SELECT d, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM texts
), pairs AS (
  SELECT a.d, a.doc_id, a.pos, a.w || ' ' || b.w AS pair FROM words a JOIN words b ON a.d = b.d AND b.pos = a.pos + 1
), hit AS (
  SELECT d, doc_id, k, licence, shared, most, size, cap, pair, pos, row_number() OVER (PARTITION BY d, k ORDER BY pos) AS i FROM pairs JOIN tgram USING (pair)
), span AS (
  SELECT s.d, s.doc_id, s.k, s.licence, s.size, s.pos AS p, e.pos AS q
  FROM hit s JOIN hit e ON s.d = e.d AND s.k = e.k AND e.i >= s.i + s.shared - 1 AND e.pos - s.pos + 1 <= s.most
), counted AS (
  SELECT span.d, span.doc_id, span.k, span.licence, span.size, p, q, h.pair, least(count(*), any_value(h.cap)) AS n
  FROM span JOIN hit h ON h.d = span.d AND h.k = span.k AND h.pos BETWEEN p AND q GROUP BY ALL
), score AS (
  SELECT d, doc_id, licence, p, q, 2.0::DOUBLE * sum(n) / (q - p + 1 + size) AS dice FROM counted GROUP BY d, doc_id, k, licence, size, p, q
), best AS (
  SELECT d, doc_id, licence, p, q, dice FROM score WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY d, licence ORDER BY dice DESC, p, q) = 1
), kept AS (
  SELECT * FROM best x WHERE NOT EXISTS (
    SELECT 1 FROM best y WHERE y.d = x.d AND (y.dice > x.dice OR (y.dice = x.dice AND y.licence < x.licence)) AND y.p <= x.q + 1 AND x.p <= y.q + 1
  )
)
SELECT doc_id, licence, round(dice, 6) AS dice, p AS first_word, q - p + 2 AS n_words
FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY dice DESC, p, q) = 1
"""


ORACLE = oracle()
