"""Operator 7: licence scans, with DataFrame functions only.

Every line of a text, and the whole text if it has several lines, is a unit.
So is every window of a template's length in words that starts at one of its
bigrams: licences wrapped over lines inside a longer text, or with other
prose on their line, are found by those. A unit is normalised (lower case, everything but letters and digits becomes
one space) and its set of word bigrams is compared with those of the licence
templates by the Dice coefficient 2|A and B| / (|A| + |B|). The coefficient
cannot pass 2 min / (|A| + |B|), so templates whose size rules out the
threshold are never intersected. A unit of one word has that word as its
only bigram.

A line or text counts for its best template (on ties the one listed first).
Windows of one template that start within half its length of each other are
one place, the best of them; of places of several templates that share half
of the shorter one the best stays. The best is the one with more shared
bigrams, then the greater coefficient, the template listed first, the place
further ahead.

A window of threshold t shares at least t / (2 - t) of the template's
bigrams, so fewer hits than that in a window rule it out without a look at
its words, and a text that has none of the words which touch more than the
rest of them is not cut into words for windows at all. Both lose nothing.

Edge cases: null or empty texts and units without letters or digits match
nothing; rows are handled by doc_id, so repeated rows add up; a null doc_id is a group of its
own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import documents

THRESHOLD = 0.8

# Published wording, in parts.
MIT_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    'LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO '
    'EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN'
    ' AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE '
    'USE OR OTHER DEALINGS IN THE SOFTWARE.')
ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    'INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR '
    'ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF '
    'USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF '
    'OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.')
BSD_CONDITIONS = (
    'Redistribution and use in source and binary forms, with or without modification, are permitted provided that'
    ' the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,'
    ' this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the '
    'above copyright notice, this list of conditions and the following disclaimer in the documentation and/or '
    'other materials provided with the distribution.')
BSD_NAMES = (
    ' 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or '
    'promote products derived from this software without specific prior written permission.')
BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    'WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    'PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY '
    'DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, '
    'PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) '
    'HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING '
    'NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE '
    'POSSIBILITY OF SUCH DAMAGE.')
GPL_2_NOTICE = (
    'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General '
    'Public License as published by the Free Software Foundation; either version 2 of the License, or (at your '
    'option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY '
    'WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the '
    'GNU General Public License for more details. You should have received a copy of the GNU General Public '
    'License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, '
    'Fifth Floor, Boston, MA 02110-1301 USA.')
GPL_3_NOTICE = (
    'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General '
    'Public License as published by the Free Software Foundation; either version 3 of the License, or (at your '
    'option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY '
    'WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the '
    'GNU General Public License for more details. You should have received a copy of the GNU General Public '
    'License along with this program. If not, see <https://www.gnu.org/licenses/>.')

# Notices and short licence texts in their published wording.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}
TEMPLATES |= {
    "MIT-full": TEMPLATES["MIT-text"] + MIT_END,
    "ISC-full": TEMPLATES["ISC-text"] + ISC_END,
    "BSD-2-Clause-full": BSD_CONDITIONS + BSD_END,
    "BSD-3-Clause-full": BSD_CONDITIONS + BSD_NAMES + BSD_END,
    "GPL-2.0-notice": GPL_2_NOTICE,
    "GPL-3.0-notice": GPL_3_NOTICE,
}
NOISE = r"[^\p{L}\p{N}]+"
LONG_WORD = 5  # characters; longer words count as equally telling


def template_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).strip().split(" ")


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return list(dict.fromkeys(pairs))


def least_shared(n_bigrams: int, threshold: float) -> int:
    """The fewest shared bigrams at which a unit can reach the threshold."""
    return max(1, math.ceil(threshold * n_bigrams / (2 - threshold) - 1e-9))


def telling_words(sets: dict[str, list[str]], threshold: float) -> list[str]:
    """Words, short ones last, without which no text shares enough bigrams with any template."""
    left = {name: (set(b), len(b) - least_shared(len(b), threshold) + 1) for name, b in sets.items()}
    chosen = []
    while any(lack > 0 for _, lack in left.values()):
        gain = {}
        for b, lack in left.values():
            touched = {}
            for pair in b if lack > 0 else ():
                for word in set(pair.split(" ")):
                    touched[word] = touched.get(word, 0) + 1
            for word, n in touched.items():
                gain[word] = gain.get(word, 0) + min(n, lack)
        word = max(gain, key=lambda x: (min(len(x), LONG_WORD), gain[x], x))
        chosen.append(word)
        for name, (b, lack) in left.items():
            gone = {pair for pair in b if word in pair.split(" ")}
            left[name] = b - gone, lack - len(gone)
    return chosen


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, license, n_units (lines or whole texts that match), n_windows (places inside the text that match),
    best (highest coefficient, 6 decimals)."""
    docs = documents(df, id_col, text_col)
    found = (units(docs, templates, threshold).withColumn("whole", F.lit(1))
             .unionByName(places(docs, templates, threshold).withColumn("whole", F.lit(0))))
    return (found.groupBy("doc_id", "license")
            .agg(F.sum("whole").alias("n_units"), F.sum(1 - F.col("whole")).alias("n_windows"),
                 F.round(F.max("dice"), 6).alias("best")))


def units(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """doc_id, license and dice of every line and whole text that matches."""
    # every line is cut into words once; the whole text is their concatenation
    cut = docs.select("doc_id", F.expr(
        f"transform(split(text, '\n'), l -> array_remove(split(lower(l), r'{NOISE}'), ''))").alias("by_line"))
    words = cut.select("doc_id", F.explode(F.expr(
        "if(size(by_line) > 1, concat(by_line, array(flatten(by_line))), by_line)")).alias("w")).where("size(w) > 0")
    sets = {name: template_bigrams(text) for name, text in templates.items()}
    # sizes: a unit has at most words - 1 bigrams, and at least different words - 1
    least = min(len(b) for b in sets.values()) * threshold / (2 - threshold)
    most = max(len(b) for b in sets.values()) * (2 - threshold) / threshold
    # explode(array(x)) computes x once: filters on it are not pushed below and worked out again there
    bigrams = (words.where(f"size(w) - 1 >= {least} or size(w) <= 2").where(f"size(w) - 1 <= {most} or size(array_distinct(w)) - 1 <= {most}")
               .select("doc_id", F.explode(F.expr(
                   "array(if(size(w) = 1, w, array_distinct(transform(sequence(0, size(w) - 2), i -> concat(w[i], ' ', w[i + 1])))))")).alias("a")))
    known = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("b"))
                      for i, (name, b) in enumerate(sets.items())])
    able = bigrams.select("doc_id", "a", F.explode(F.array(known)).alias("known")).select("doc_id", "a", F.explode(F.expr(
        f"array(filter(known, t -> 2.0D * least(size(a), size(t.b)) >= {threshold}D * (size(a) + size(t.b))))")).alias("able"))
    best = able.where("size(able) > 0").select("doc_id", F.explode(F.expr(
        "array(array_max(transform(able, t -> struct(2.0D * size(array_intersect(a, t.b)) / (size(a) + size(t.b)) as dice, "
        "t.place as place, t.license as license))))")).alias("m"))
    return (best.where(F.col("m.dice") >= threshold)
            .select("doc_id", F.col("m.license").alias("license"), F.col("m.dice").alias("dice")))


def places(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """doc_id, license and dice of every place where a window of a template's length matches it."""
    sets = {name: template_bigrams(text) for name, text in templates.items()}
    spans = [max(1, len(template_words(text)) - 1) for text in templates.values()]  # bigrams with repeats
    needs = [least_shared(len(b), threshold) for b in sets.values()]
    owners: dict[str, list[int]] = {}
    for t, b in enumerate(sets.values()):
        for pair in b:
            owners.setdefault(pair, []).append(t)
    # explode(array(x)) computes x once, as in units()
    low = docs.select("doc_id", F.explode(F.array(F.lower("text"))).alias("low"))
    telling = reduce(or_, (F.col("low").contains(word) for word in telling_words(sets, threshold)))
    words = (low.where(telling).withColumn("row", F.monotonically_increasing_id())
             .select("doc_id", "row", F.explode(F.array(F.expr(f"array_remove(split(low, r'{NOISE}'), '')"))).alias("w"))
             .where("size(w) > 1"))
    own = F.array(*[F.array(*map(F.lit, ts)) for ts in owners.values()])
    vocabulary = F.array(*map(F.lit, owners))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(
        i.alias("at"), F.concat(F.col("w")[i], F.lit(" "), F.col("w")[i + 1]).alias("pair")))
    hits = words.select("doc_id", "row", "w", F.explode(F.array(F.transform(
        F.filter(pairs, lambda x: x["pair"].isin(*owners)),
        lambda x: F.struct(x["at"].alias("at"), own[F.array_position(vocabulary, x["pair"]).cast("int") - 1].alias("of"))))).alias("hits"))
    known = F.array(*[F.struct(F.lit(t).alias("place"), F.lit(name).alias("license"), F.lit(spans[t]).alias("span"),
                               F.lit(needs[t]).alias("need"), F.array(*map(F.lit, b)).alias("b"))
                      for t, (name, b) in enumerate(sets.items())])
    # the places of each template's hits, if it has enough of them
    by_template = (hits.where(F.size("hits") >= min(needs)).select("doc_id", "row", "w", F.explode(F.filter(
        F.transform(known, lambda t: F.struct(t.alias("t"), F.transform(
            F.filter("hits", lambda h: F.array_contains(h["of"], t["place"])), lambda h: h["at"]).alias("at"))),
        lambda x: F.size(x["at"]) >= x["t"]["need"])).alias("x"))
        .select("doc_id", "row", "w", "x.t.place", "x.t.license", "x.t.span", "x.t.need", "x.t.b", "x.at"))
    starts = by_template.select("doc_id", "row", "w", "place", "license", "span", "b", F.explode(F.array(F.expr(
        "filter(at, (p, k) -> k + need <= size(at) and at[least(k + need, size(at)) - 1] - p < span)"))).alias("starts")).where("size(starts) > 0")
    # transform(array(x), ...)[0] names x, the window's own bigrams, and keeps only the counts of each window
    windows = starts.select("doc_id", "row", "place", "license", "span", F.explode(F.array(F.expr(
        "filter(transform(starts, p -> transform(array(array_distinct(transform(sequence(p, least(p + span, size(w) - 1) - 1), "
        "i -> concat(w[i], ' ', w[i + 1])))), a -> named_struct('shared', size(array_intersect(a, b)), "
        "'dice', 2.0D * size(array_intersect(a, b)) / (size(a) + size(b)), 'place', -place, 'at', -p))[0]), "
        f"x -> x.dice >= {threshold}D)"))).alias("v")).where("size(v) > 0")
    # at most span / 2 starts lie on either side within half a template
    peaks = windows.select("doc_id", "row", "license", "span", F.explode(F.expr(
        "filter(v, (x, k) -> not exists(slice(v, greatest(1, k + 1 - int(span / 2)), 2 * int(span / 2) + 1), "
        "y -> 2 * abs(y.at - x.at) <= span and y > x))")).alias("x"))
    # peaks of one template are more than half of it apart, so only so many can overlap another
    near = sum(4 * max(spans) // span + 2 for span in spans)
    by_row = (peaks.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct(
        (-F.col("x.at")).alias("at"), "span", "x", "license"))).alias("v")))
    return by_row.select("doc_id", F.explode(F.expr(
        f"filter(v, (x, k) -> not exists(slice(v, greatest(1, k + 1 - {near}), {2 * near} + 1), y -> y.x > x.x and "
        "2 * (least(y.at + y.span, x.at + x.span) - greatest(y.at, x.at)) >= least(x.span, y.span)))")).alias("m")).select(
        "doc_id", "m.license", "m.x.dice")


def scan_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same result as DuckDB SQL over ``documents``."""
    known = ", ".join("({}, '{}', {}, {}, [{}])".format(
        i, name, max(1, len(template_words(text)) - 1), least_shared(len(template_bigrams(text)), threshold),
        ", ".join(f"'{b}'" for b in template_bigrams(text))) for i, (name, text) in enumerate(templates.items()))
    return f"""
WITH known(place, license, span, need, b) AS (VALUES {known}),
units AS (
  SELECT doc_id, unnest(CASE WHEN len(l) > 1 THEN list_append(l, text) ELSE l END) AS u
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
), words AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units
), sets AS (
  SELECT doc_id, row_number() OVER () AS unit, CASE WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS a
  FROM words WHERE w[1] <> ''
), dice AS (
  SELECT doc_id, unit, license, place, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS d FROM sets, known
  WHERE 2.0 * least(len(a), len(b)) >= {threshold} * (len(a) + len(b))
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY d DESC, place) AS r FROM dice WHERE d >= {threshold}
), texts AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents
), numbered AS (
  SELECT row_no, w, unnest(range(1, len(w))) AS p FROM texts
), pairs AS MATERIALIZED (
  SELECT row_no, p, w[p] || ' ' || w[p + 1] AS g FROM numbered
), own AS (
  SELECT place, span, need, len(b) AS size, unnest(b) AS g FROM known
), hits AS MATERIALIZED (
  SELECT row_no, p, place, span, need, size, row_number() OVER (PARTITION BY row_no, place ORDER BY p) AS k
  FROM pairs JOIN own USING (g)
), starts AS (
  SELECT x.* FROM hits x JOIN hits y ON x.row_no = y.row_no AND x.place = y.place AND y.k = x.k + x.need - 1
  WHERE y.p - x.p < x.span
), inside AS (
  SELECT DISTINCT s.row_no, s.place, s.span, s.size, s.p, pairs.g FROM starts s
  JOIN pairs ON pairs.row_no = s.row_no AND pairs.p >= s.p AND pairs.p < s.p + s.span
), windows AS MATERIALIZED (
  SELECT row_no, place, span, p, shared, 2.0 * shared / (n + size) AS d FROM (
    SELECT row_no, i.place, i.span, i.size, i.p, count(*) AS n, count(own.g) AS shared
    FROM inside i LEFT JOIN own ON own.place = i.place AND own.g = i.g GROUP BY ALL)
  WHERE 2.0 * shared / (n + size) >= {threshold}
), peaks AS MATERIALIZED (
  SELECT * FROM windows x WHERE NOT EXISTS (
    SELECT 1 FROM windows y WHERE y.row_no = x.row_no AND y.place = x.place AND 2 * abs(y.p - x.p) <= x.span
      AND (y.shared > x.shared OR y.shared = x.shared AND (y.d > x.d OR y.d = x.d AND y.p < x.p)))
), places AS (
  SELECT * FROM peaks x WHERE NOT EXISTS (
    SELECT 1 FROM peaks y WHERE y.row_no = x.row_no
      AND 2 * (least(y.p + y.span, x.p + x.span) - greatest(y.p, x.p)) >= least(x.span, y.span)
      AND (y.shared > x.shared OR y.shared = x.shared AND (y.d > x.d OR y.d = x.d
        AND (y.place < x.place OR y.place = x.place AND y.p < x.p))))
), found AS (
  SELECT doc_id, license, 1 AS whole, d FROM ranked WHERE r = 1
  UNION ALL
  SELECT doc_id, license, 0, d FROM places JOIN texts USING (row_no) JOIN known USING (place)
)
SELECT doc_id, license, CAST(sum(whole) AS BIGINT) AS n_units, CAST(sum(1 - whole) AS BIGINT) AS n_windows, round(max(d), 6) AS best
FROM found GROUP BY doc_id, license"""
