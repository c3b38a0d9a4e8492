"""License scans: word-bigram Dice coefficients against licence templates.

DataFrame functions only. A text is normalised to lower-case ASCII words. The
coefficient is taken over bags of word bigrams: 2 * common / (a + b), where a
segment of n words has n - 1. Segments are each line, the whole text, and
every window of a template's own size, cut at the ends of the text.

A window's common bigrams are a sum over the places where a template's bigrams
are: a place counts for all windows that hold it, but not the b places before it
of the same bigram, of which the template has b. These windows are one after the
other, so that a running sum over their ends gives every window at the price of
a sort. Size bounds prune the templates (a coefficient of d needs d/(2-d) <= a/b
<= (2-d)/d). By the same bound a text must hold so many of a template's bigrams
that some words can't all be missing; texts without any of these aren't cut up.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.llm.shared import written

MIN_DICE = 0.8
#: Parts of words that a text is asked for first, and words that it isn't asked for unless nothing else is left. No result depends on either.
STEMS = ("licen", "copyright", "warrant", "permission", "reserved")
FREQUENT = frozenset("also been each from have into more must only other some such that their them then these they this those under used what when where which will with without work would your".split())
#: Full texts, a file each.
TEXTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "texts")
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic-1.0": "Artistic"}

#: Public licence texts and notices, without names and years. What follows # in a name tells wordings of one licence apart.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice#2": "Licensed under the MIT License.",
    "MIT-notice#3": "This project is licensed under the MIT License, see the LICENSE file for details.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice#2": "This project is licensed under the Apache License 2.0.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice#2": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice#2": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-notice#2": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
}


def templates_of(given: dict[str, str] | None = None) -> dict[str, list[str]]:
    """The words of the templates: those given, or TEMPLATES and the full texts of FILES."""
    found = dict(given) if given is not None else dict(TEMPLATES)
    if given is None:
        for name, file in FILES.items():
            with open(os.path.join(TEXTS, f"{file}.txt"), encoding="utf-8") as f:
                found[name] = f.read()
    words = {k: normal_words(v) for k, v in found.items()}
    if short := [k for k, w in words.items() if len(w) < 2]:
        raise ValueError(f"templates without a bigram: {short}")
    return dict(sorted(words.items()))


def normal_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bounds(m: int, least: float) -> tuple[int, int]:
    """The numbers of bigrams that a segment can have if its coefficient with m of them reaches least."""
    return math.ceil(m * least / (2 - least) - 1e-9), math.floor(m * (2 - least) / least + 1e-9)


def needed_parts(templates: list[list[str]], least: float) -> list[list[str]]:
    """Parts of words for each template, one of which a segment must hold if its coefficient reaches least: the bigrams that have one are more than can be missing. Few parts serve all templates."""
    both = [list(zip(w, w[1:], strict=False)) for w in templates]
    spare = [len(x) - bounds(len(x), least)[0] for x in both]
    weight: Counter = Counter()
    for x in templates:
        for w in x:
            weight[w] += 1 / len(x)
    words = sorted(weight, key=lambda w: (-weight[w], w))
    found: list[list[str]] = [[] for _ in templates]
    covered: list[set[int]] = [set() for _ in templates]
    for some in (STEMS, [w for w in words if len(w) > 4 and w not in FREQUENT][:150], words):
        left = {w for x, c, s in zip(templates, covered, spare, strict=True) if len(c) <= s for w in x}
        holds = {}
        for x in sorted(x for x in some if x in left or x in STEMS):
            have = {w for w in words if x in w}
            holds[x] = {k: got for k, grams in enumerate(both) if (got := {j for j, g in enumerate(grams) if not have.isdisjoint(g)})}
        while open_ := [k for k in range(len(templates)) if len(covered[k]) <= spare[k]]:
            gain = {x: sum(min(len(at.get(k, set()) - covered[k]) / (spare[k] + 1 - len(covered[k])), 1) for k in open_) for x, at in holds.items()}
            best = max(gain, key=lambda x: (gain[x], len(x), x), default=None)
            if best is None or not gain[best]:
                break
            for k in open_:
                if new := holds[best].get(k, set()) - covered[k]:
                    covered[k] |= new
                    found[k].append(best)
    return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = MIN_DICE) -> DataFrame:
    """(doc_id, license, dice) of docs (doc_id, text): the best coefficient of each licence that reaches least in a segment.

    Null texts and ids match nothing, nor do empty texts; repeated rows give their
    matches once, and texts of one id add up. Long texts take a row for each bigram that a template holds, and no more.
    Templates of a single word have no bigram and aren't accepted. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    words = templates_of(templates)
    table, names = [], list(words)
    grams: dict[tuple[str, str], int] = {}
    asked: dict[str, int] = {}  # the fewest characters of a text in which the part tells anything
    held: set[str] = set()
    for k, (w, parts) in enumerate(zip(words.values(), needed_parts(list(words.values()), least), strict=True)):
        both = list(zip(w, w[1:], strict=False))
        low, high = bounds(len(both), least)
        table += [(" ".join(g), grams.setdefault(g, len(grams)), k, b, len(both), low, high) for g, b in Counter(both).items()]
        held |= {x for x in w if any(y in x for y in parts)}
        for x in parts:
            asked[x] = min(asked.get(x, 1 << 30), 2 * low + 1)
    known = F.broadcast(spark.createDataFrame(table, "gram string, id int, k int, b int, m int, low int, high int"))  # as many rows as the templates have bigrams

    # explode keeps what it makes: without it, the optimizer would repeat an expression in each of its uses
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.array(F.lower("text"))).alias("t"))
    by_size: dict[int, list[str]] = {}
    for x, size in sorted(asked.items()):
        if not any(y != x and y in x and asked[y] <= size for y in asked):  # else y tells as much
            by_size.setdefault(size, []).append(x)
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    rows = rows.where(any_of((F.length("t") >= size) & any_of(F.col("t").contains(x) for x in some) for size, some in by_size.items()))
    lines = F.transform(F.split("t", "\n"), lambda x: F.filter(F.split(F.regexp_replace(x, "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    rows = rows.select("doc_id", "row", F.explode(F.array(lines)).alias("l"))
    rows = rows.select("doc_id", "row", F.explode(F.array(F.struct(F.flatten("l").alias("w"), F.flatten(F.transform("l", lambda x, i: F.array_repeat(F.struct(i.alias("i"), F.size(x).alias("n")), F.size(x)))).alias("at")))).alias("y"))
    rows = rows.where((F.size("y.w") > 1) & F.arrays_overlap("y.w", F.array(*(F.lit(x) for x in sorted(held)))))
    gram = F.transform(F.sequence(F.lit(0), F.size("y.w") - 2), lambda p: F.struct(p.alias("p"), F.concat_ws(" ", F.get("y.w", p), F.get("y.w", p + 1)).alias("gram"), F.when(F.get("y.at", p)["i"] == F.get("y.at", p + 1)["i"], F.get("y.at", p)).alias("line")))
    rows = rows.select("doc_id", "row", (F.size("y.w") - 1).alias("n"), gram.alias("g")).select("doc_id", "row", "n", F.explode("g").alias("g"))
    hits = rows.select("doc_id", "row", "n", "g.p", "g.gram", F.col("g.line.i").alias("line"), (F.col("g.line.n") - 1).alias("line_n")).join(known, "gram").drop("gram")

    key = ["doc_id", "row", "k", "m", "n", "low", "high"]
    dice = lambda common, size: 2 * common / (size + F.col("m"))
    reached = lambda found: found.where(F.col("dice") >= least).select("doc_id", "k", "dice")

    bags = written(hits.groupBy(*key, "id", "b").agg(F.array_sort(F.collect_list(F.struct("p", "line", "line_n"))).alias("at")), "bigrams")
    enough = bags.groupBy(*key).agg(F.sum(F.least(F.size("at"), "b")).alias("common")).where("common >= low")  # no segment has more than the text
    whole = reached(enough.where("n between low and high").withColumn("dice", dice(F.col("common"), F.col("n"))))
    bags = written(bags.join(enough.select("row", "k"), ["row", "k"], "left_semi"), "enough")

    in_line = bags.select(*key, "id", "b", F.explode("at").alias("h")).where("h.line is not null and h.line_n between low and high")
    in_line = in_line.groupBy(*key, "id", "b", "h.line", "h.line_n").agg(F.count("*").alias("a")).groupBy(*key, "line", "line_n").agg(F.sum(F.least("a", "b")).alias("common"))
    by_line = reached(in_line.withColumn("dice", dice(F.col("common"), F.col("line_n"))))

    def ends(x: Column, i: Column) -> Column:
        """The first start of a window for which this place counts, and the first past the last."""
        free = F.greatest(x["p"] - F.col("m"), F.when(i >= F.col("b"), F.get("at", i - F.col("b"))["p"]))
        return F.array(F.struct((free + 1).alias("start"), F.lit(1).alias("d")), F.struct((x["p"] + 1).alias("start"), F.lit(-1).alias("d")))

    steps = bags.select(*key, F.explode(F.flatten(F.transform("at", ends))).alias("e")).groupBy(*key, "e.start").agg(F.sum("e.d").alias("d"))
    order = Window.partitionBy(*key).orderBy("start")
    steps = steps.select("doc_id", "k", "m", "n", "low", "start", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("common"), (F.lead("start").over(order) - 1).alias("last")).where("common >= low")
    size = lambda start: F.least(start + F.col("m"), F.col("n")) - F.greatest(start, F.lit(0))
    windows = reached(steps.withColumn("dice", dice(F.col("common"), F.least(size(F.col("start")), size(F.col("last"))))))  # sizes rise, then fall: the least is at an end

    found = whole.unionByName(by_line).unionByName(windows)
    label = F.element_at(F.array(*(F.lit(n.split("#")[0]) for n in names)), F.col("k") + 1)
    return found.select("doc_id", label.alias("license"), "dice").groupBy("doc_id", "license").agg(F.max("dice").alias("dice"))


def documents(docs: DataFrame, templates: dict[str, str] | None = None, least: float = MIN_DICE) -> DataFrame:
    """doc_id, license (that of the highest coefficient, then the first by name), dice (six decimals), licenses (all, sorted), n_licenses of every row of docs; null, null, empty and 0 without a match."""
    found = scan(docs, templates, least).withColumn("dice", F.round("dice", 6) + F.lit(0.0))
    best = F.min(F.struct((-F.col("dice")).alias("d"), "license"))
    per = found.groupBy("doc_id").agg(best.alias("best"), F.concat_ws(",", F.array_sort(F.collect_set("license"))).alias("licenses"), F.count("*").alias("n_licenses"))
    rows = docs.select("doc_id").join(per, "doc_id", "left")
    return rows.select("doc_id", F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"))


def sql(templates: dict[str, str] | None = None, least: float = MIN_DICE) -> str:
    """The same over whole tables, without the size bounds."""
    values = ", ".join(f"('{k}', '{' '.join(w)}')" for k, w in templates_of(templates).items())
    return f"""
WITH templates(k, norm) AS (VALUES {values}),
tw AS (SELECT k, string_split(norm, ' ') AS w FROM templates),
tp AS (SELECT k, len(w) - 1 AS m, unnest(range(1, len(w))) AS j, w FROM tw),
tg AS (SELECT k, m, w[j] || ' ' || w[j + 1] AS gram FROM tp),
tc AS (SELECT k, m, gram, count(*) AS b FROM tg GROUP BY ALL),
docs AS (SELECT doc_id, row_number() OVER () AS r, list_transform(string_split(lower(text), chr(10)), lambda l: list_filter(string_split(regexp_replace(l, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
flat AS (SELECT doc_id, r, flatten(l) AS w, flatten(list_transform(l, lambda x, i: list_transform(x, lambda y: i))) AS nth, list_transform(l, lambda x: len(x)) AS sizes FROM docs),
places AS (SELECT doc_id, r, w, nth, sizes, len(w) - 1 AS n, unnest(range(1, len(w))) AS p FROM flat),
dg AS (SELECT doc_id, r, n, p - 1 AS p, w[p] || ' ' || w[p + 1] AS gram, CASE WHEN nth[p] = nth[p + 1] THEN nth[p] END AS line, sizes[nth[p]] - 1 AS line_n FROM places),
hits AS (SELECT *, row_number() OVER (PARTITION BY r, k, gram ORDER BY p) AS o FROM dg JOIN tc USING (gram)),
bags AS (
  SELECT doc_id, r, k, m, n AS size, 0 AS line, gram, b, count(*) AS a FROM hits GROUP BY ALL
  UNION ALL SELECT doc_id, r, k, m, line_n, line, gram, b, count(*) FROM hits WHERE line IS NOT NULL GROUP BY ALL),
counts AS (SELECT h.*, greatest(h.p - h.m, coalesce(g.p, h.p - h.m)) + 1 AS first FROM hits h LEFT JOIN hits g ON g.r = h.r AND g.k = h.k AND g.gram = h.gram AND g.o = h.o - h.b),
ends AS (
  SELECT doc_id, r, k, m, n, start, sum(d) AS d FROM (
    SELECT doc_id, r, k, m, n, first AS start, 1 AS d FROM counts UNION ALL SELECT doc_id, r, k, m, n, p + 1, -1 FROM counts) GROUP BY ALL),
steps AS (SELECT doc_id, k, m, n, start, sum(d) OVER w AS common, lead(start) OVER w - 1 AS last FROM ends WINDOW w AS (PARTITION BY r, k ORDER BY start)),
windows AS (SELECT doc_id, k, m, n, common, unnest([start, last]) AS start FROM steps WHERE common > 0),
dice AS (
  SELECT doc_id, string_split(k, '#')[1] AS license, 2.0::DOUBLE * sum(least(a, b)) / (size + m) AS dice FROM bags GROUP BY doc_id, r, k, m, size, line
  UNION ALL SELECT doc_id, string_split(k, '#')[1], 2.0::DOUBLE * common / (least(start + m, n) - greatest(start, 0) + m) FROM windows),
found AS (SELECT doc_id, license, round(max(dice), 6) AS dice FROM dice WHERE dice >= {least!r} GROUP BY doc_id, license),
per AS (SELECT doc_id, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS n_licenses FROM found GROUP BY doc_id)
SELECT d.doc_id, p.license, p.dice, coalesce(p.licenses, '') AS licenses, CAST(coalesce(p.n_licenses, 0) AS BIGINT) AS n_licenses
FROM documents d LEFT JOIN per p USING (doc_id)
"""
