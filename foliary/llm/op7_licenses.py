"""License scan by Dice coefficients over word bigrams, in DataFrame operations only.

A text is lower-cased, everything but a-z and 0-9 becomes a space, and runs of its words are compared with each template
by their distinct word bigrams: 2 |A & B| / (|A| + |B|). Runs begin and end with a bigram of the template, for others only
have more that it lacks: from each such bigram the longest run of at most as many bigrams as the template has, and the
longest of at most as many as a coefficient of THRESHOLD allows; the better one counts. A notice is thus found on a line
of its own, among other words, or wrapped over any number of lines. Of runs that share words only one that no better one
overlaps is reported.

Size bounds prune: a coefficient of THRESHOLD needs a number of the template's bigrams, and these a number of its words,
so a template is compared only with texts that have as many of its words, and only in runs with as many of its bigrams. A
document stays one row from scan to result, whatever its size; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm.common import table

THRESHOLD = 0.8

#: Public licence notices and texts, by SPDX identifier. A name may have several templates. Longer licences
#: (Apache, GNU, Mozilla) hold their notices, by which their full texts are found.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
]


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> set[str]:
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def prepared(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """Templates with their bigrams and words, and bounds: a run has `need` of the bigrams and `most` bigrams in all, a
    text with such a run `words_needed` of the words (a missing word takes away each bigram that it is in)."""
    out = []
    for n, (name, text) in enumerate(templates):
        g = sorted(bigrams_of(text))
        least = next(a for a in range(1, len(g) + 1) if 2 * a / (a + len(g)) >= threshold)
        most = next(a for a in range(len(g), 10**6) if 2 * len(g) / (a + 1 + len(g)) < threshold)
        need = next(i for i in range(1, len(g) + 1) if 2 * i / (least + len(g)) >= threshold)
        in_bigrams = Counter(w for x in g for w in set(x.split()))
        spare, missing = 2 * (len(g) - need), 0
        for k in sorted(in_bigrams.values()):
            spare -= k
            if spare < 0:
                break
            missing += 1
        out.append({"n": n, "name": name, "size": len(g), "need": need, "most": most, "words_needed": len(in_bigrams) - missing, "words": sorted(in_bigrams), "grams": g})
    return out


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


SCHEMA = "array<struct<n:int,name:string,size:int,need:int,most:int,words_needed:int,words:array<string>,grams:array<string>>>"


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, found): found holds, per match in the order of the text, (name, dice, start, words): the licence, its
    coefficient, the number of words before the run and in it. Better is the higher coefficient, then the earlier template
    of the list, then the earlier run. Null and blank texts match none; every row of docs gives one row, repeated rows
    equal ones; texts of any length are read as a whole; an empty table gives an empty result; other columns are not read.
    """
    known = prepared(templates, threshold)
    t = F.from_json(F.lit(json.dumps(known)), SCHEMA)
    every = F.from_json(F.lit(json.dumps(sorted({w for k in known for w in k["words"]}))), "array<string>")
    near = max(k["most"] for k in known) * len(known)  # so many runs at most begin within reach of another one

    rows = docs.select(F.col(id_col).alias("doc_id"), F.split(F.btrim(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9]+", F.lit(" "))), " ").alias("w"))
    rows = rows.select("doc_id", "w", F.array_intersect("w", every).alias("has"))
    fit = F.filter(t, lambda k: F.size(F.array_intersect(F.col("has"), k["words"])) >= k["words_needed"])
    rows = rows.select("doc_id", "w", F.when(F.size("has") > 1, fit).alias("fit"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))
    rows = rows.select("doc_id", F.when((F.size("fit") > 0) & (F.size("w") > 1), pairs).alias("g"), "fit")

    hits = lambda k: F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: F.array_contains(k["grams"], F.get("g", i)))
    fields = ("n", "name", "size", "need", "most", "grams")
    rows = rows.select("doc_id", "g", F.when(F.col("g").isNotNull(), F.transform("fit", lambda k: F.struct(*[k[c].alias(c) for c in fields], hits(k).alias("hits")))).alias("fit"))
    rows = rows.withColumn("fit", F.filter("fit", lambda k: F.size(k["hits"]) >= k["need"]))

    def run(k: Column, i: Column, cap: Column) -> Column:
        """From the i-th hit the longest run of at most cap bigrams that ends with a hit."""
        start = F.get(k["hits"], i)

        def size(own: Column) -> Column:
            return F.struct(F.size(own).alias("hits"), (F.element_at(own, -1) - start + 1).alias("size"))

        def dice(x: Column) -> Column:
            a = F.when(x["hits"] >= k["need"], F.array_distinct(F.slice(F.col("g"), start + 1, x["size"]))).otherwise(F.array().cast("array<string>"))
            return _let(a, lambda a: F.struct((2.0 * F.size(F.array_intersect(a, k["grams"])) / (F.size(a) + k["size"])).alias("dice"), (-x["size"]).alias("less")))

        return _let(_let(F.filter(F.slice(k["hits"], i + 1, cap), lambda h: h < start + cap), size), dice)

    def runs(k: Column) -> Column:
        def best(hit: Column, i: Column) -> Column:
            better = F.array_max(F.array(run(k, i, k["size"]), run(k, i, k["most"])))
            return _let(better, lambda x: F.struct(hit.alias("start"), (-x["less"]).alias("size"), F.struct(x["dice"].alias("dice"), (-k["n"]).alias("m"), (-hit).alias("s")).alias("rank"), k["name"].alias("name")))

        return F.filter(F.transform(k["hits"], best), lambda x: x["rank"]["dice"] >= threshold)

    rows = rows.select("doc_id", F.when(F.size("fit") > 0, F.array_sort(F.flatten(F.transform("fit", runs)))).alias("c"))

    def alone(x: Column, i: Column) -> Column:
        others = F.slice(F.col("c"), F.greatest(i + 1 - near, F.lit(1)), F.lit(2 * near))
        return ~F.exists(others, lambda y: (y["start"] <= x["start"] + x["size"]) & (x["start"] <= y["start"] + y["size"]) & (y["rank"] > x["rank"]))

    found = F.transform(F.filter("c", alone), lambda x: F.struct(x["name"].alias("name"), x["rank"]["dice"].alias("dice"), x["start"].alias("start"), (x["size"] + 1).alias("words")))
    return rows.select("doc_id", F.coalesce(found, F.array().cast("array<struct<name:string,dice:double,start:int,words:int>>")).alias("found"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_matches, licenses, best_dice): the names found, sorted and joined by commas; null without a match."""
    out = license_matches(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda u: u["name"])))
    return out.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.nullif(F.array_join(names, ","), F.lit("")).alias("licenses"), F.array_max(F.transform("found", lambda u: u["dice"])).alias("best_dice"))


def _sql(x) -> str:
    if isinstance(x, list):
        return "[" + ", ".join(map(_sql, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


ORACLE = f"""
WITH t(n, name, size, need, most, grams) AS (VALUES {", ".join("(" + ", ".join(_sql(k[c]) for c in ("n", "name", "size", "need", "most", "grams")) + ")" for k in prepared())}),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM d WHERE len(w) > 1),
p AS (SELECT r, unnest(g) AS gram, generate_subscripts(g, 1) AS pos FROM g),
k AS (SELECT n, unnest(grams) AS gram FROM t),
h AS (SELECT r, n, pos FROM p JOIN k ON p.gram = k.gram),
f AS (SELECT r, n FROM h GROUP BY r, n HAVING count(*) >= (SELECT min(need) FROM t)),
s AS (SELECT h.* FROM h JOIN f ON h.r = f.r AND h.n = f.n),
c AS (SELECT s.r, s.n, s.pos, t.need, unnest([t.size, t.most]) AS cap FROM s JOIN t ON s.n = t.n),
x AS (SELECT c.r, c.n, c.pos, c.cap, max(o.pos) AS last FROM c JOIN s o ON o.r = c.r AND o.n = c.n AND o.pos BETWEEN c.pos AND c.pos + c.cap - 1 GROUP BY c.r, c.n, c.pos, c.cap, c.need HAVING count(*) >= c.need),
y AS (SELECT x.r, x.n, x.pos, x.last, list_distinct(g.g[x.pos:x.last]) AS a FROM x JOIN g ON x.r = g.r),
z AS (SELECT r, y.n, pos, last, 2.0::DOUBLE * len(list_intersect(a, grams)) / (len(a) + size) AS dice FROM y JOIN t ON y.n = t.n),
b AS (SELECT r, n, pos, max(dice) AS dice, arg_min(last, struct_pack(a := -dice, b := last)) AS last FROM z WHERE dice >= {THRESHOLD} GROUP BY r, n, pos),
m AS (
  SELECT b.r, t.name, b.dice FROM b JOIN t ON b.n = t.n WHERE NOT EXISTS (
    SELECT 1 FROM b o WHERE o.r = b.r AND o.pos <= b.last + 1 AND b.pos <= o.last + 1 AND (o.dice > b.dice OR o.dice = b.dice AND (o.n < b.n OR o.n = b.n AND o.pos < b.pos)))
), a AS (SELECT r, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names, max(dice) AS dice FROM m GROUP BY r)
SELECT d.doc_id, coalesce(a.n, 0) AS n_matches, a.names AS licenses, a.dice AS best_dice FROM d LEFT JOIN a ON d.r = a.r
"""
