"""License scans in column expressions alone: Dice coefficient of word bigrams against licence templates.

Words are lower-cased runs of letters and digits, cut once a line; lines end at LF or CRLF. A window is a run of whole
lines, blank ones included; its bigrams are the distinct pairs of neighbouring words, across line ends too. A template
matches a window where Dice = 2 |A & B| / (|A| + |B|) is at least `least`. Three bounds prune what is compared. A template's
words: one of a few of them must occur in the text, or too many of its bigrams are missing. Edges: windows begin and end at
lines that share a bigram with the template. Size: the window's words must
be between least / (2 - least) and, with SLACK for words said again, (2 - least) / least times the template's bigrams.
Of overlapping windows of one template the best stays, the first of equals.

Defined results: null and empty texts match nothing; repeated rows and null doc_ids each give their rows; an empty table
gives none; a window that several templates match gives a row for each. A licence that shares a line with much other text,
or whose every bigram is broken by a line end, isn't found. A text of any length is read whole. Only doc_id and text are
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, SLACK = 0.8, 1.35

#: Notices and licence texts as their publishers word them, without names and years.
_WARRANTY_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-name": "Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-project": "This project is licensed under the MIT License",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause-text": f"{_BSD_2} {_WARRANTY_BSD}",
    "bsd-3-clause-text": f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_WARRANTY_BSD}",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
def bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, in order."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def telling_words(known: dict[str, list[str]], least: float) -> dict[str, list[str]]:
    """For each template a few words without any of which a text lacks so many of its bigrams that no window can match.

    A match needs at least least / (2 - least) of the bigrams. Words are taken, long ones first and those of other templates
    before others, by how many more bigrams they cover, until fewer are left uncovered.
    """
    used: set[str] = set()
    out = {}
    for name, grams in known.items():
        left, chosen = list(grams), []
        while len(left) >= least / (2 - least) * len(grams):
            found = Counter(w for g in left for w in set(g.split(" ")))
            best = min(found, key=lambda w: (len(w) < 7, w not in used, -found[w], w))
            chosen.append(best)
            left = [g for g in left if best not in g.split(" ")]
        used.update(chosen)
        out[name] = chosen
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _any_in(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"([\p{L}\p{N}]+)"), 1)


def _bigrams(words: Column) -> Column:
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, pairs), F.slice(words, 2, pairs), lambda a, b: F.concat_ws(" ", a, b)))


_WINDOWS = "array<struct<first:int,last:int,license:string,dice:double>>"


def _windows(name: str, grams: list[str], least: float) -> Column:
    """The windows over columns `words` (by line), `pairs` (bigrams by line) and `total` (words before each line) that match."""
    own, n = F.array(*map(F.lit, grams)), len(grams)
    low, high = least / (2 - least) * n, (2 - least) / least * n * SLACK + 1
    edges = F.filter(F.transform("pairs", lambda p, i: F.when(F.arrays_overlap(p, own), i)), lambda i: i.isNotNull())

    def fits(i: Column, j: Column) -> Column:
        between = F.get(F.col("total"), j + 1) - F.get(F.col("total"), i)
        return (j >= i) & (between - 1 >= low) & (between - 1 <= high)

    def window(i: Column, j: Column) -> Column:
        grams_in = _bigrams(F.flatten(F.slice(F.col("words"), i + 1, j - i + 1)))
        dice = _once(grams_in, lambda g: 2.0 * F.size(F.array_intersect(g, own)) / (F.size(g) + n))
        return F.struct(i.alias("first"), j.alias("last"), F.lit(name).alias("license"), dice.alias("dice"))

    # A line that shares a bigram has two words at least, so few edges can follow within a window.
    near = lambda all_, k: F.slice(all_, k + 1, int(high) // 2 + 2)
    each = _once(edges, lambda all_: F.transform(all_, lambda i, k: F.transform(F.filter(near(all_, k), lambda j: fits(i, j)), lambda j: window(i, j))))
    return F.filter(F.flatten(each), lambda x: x["dice"] >= least)


def _best(found: Column) -> Column:
    """Windows of one template, best first, ties by first and then last line, without those that overlap one kept before them."""
    in_order = F.array_sort(F.transform(found, lambda x: F.struct((-x["dice"]).alias("worse"), x["first"].alias("first"), x["last"].alias("last"), x["license"].alias("license"), x["dice"].alias("dice"))))
    overlaps = lambda kept, x: F.exists(kept, lambda y: (y["first"] <= x["last"]) & (y["last"] >= x["first"]))
    window = lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), x["license"].alias("license"), x["dice"].alias("dice"))
    return F.aggregate(in_order, F.array().cast(_WINDOWS), lambda kept, x: F.when(overlaps(kept, x), kept).otherwise(F.concat(kept, F.array(window(x)))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Columns (doc_id, first_line, last_line, license, dice) of every window, lines counted from 0. No shuffle; the templates
    are literals of the plan."""
    known = {name: grams for name, body in (TEMPLATES if templates is None else templates).items() if (grams := bigrams(body))}
    has = telling_words(known, least)
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.where(_once(low, lambda text: _any_in(text, sorted({w for words in has.values() for w in words}))))
    # Each of these columns is read several times, so Spark keeps them in steps of their own.
    rows = rows.select(F.col("doc_id").cast("long"), low.alias("text"))
    rows = rows.withColumn("words", F.transform(F.split("text", "\r?\n"), _words))
    rows = rows.withColumn("pairs", F.transform("words", _bigrams))
    rows = rows.withColumn("total", F.aggregate("words", F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.size(w)))))
    none = F.array().cast(_WINDOWS)
    found = none
    for name, grams in known.items():
        found = F.concat(found, F.when(_any_in(F.col("text"), has[name]), _windows(name, grams, least).cast(_WINDOWS)).otherwise(none))
    rows = rows.select("doc_id", found.alias("found"))
    of = lambda name: F.filter("found", lambda x: x["license"] == name)
    kept = F.flatten(F.array(*[_best(of(name)) for name in known])) if known else none
    return rows.select("doc_id", F.explode(kept).alias("m")).select("doc_id", F.col("m.first").cast("long").alias("first_line"), F.col("m.last").cast("long").alias("last_line"), "m.license", "m.dice")


def sql(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """The same scan as DuckDB SQL, without the pruning by words and edges: any window of lines that fits in size, of which the
    best are then the same."""
    values = ", ".join(f"('{k}', [{', '.join(repr(g) for g in bigrams(v))}])" for k, v in templates.items() if bigrams(v))
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    low, high = least / (2 - least), (2 - least) / least * SLACK
    return f"""
        WITH t AS (SELECT license, grams, len(grams) AS n FROM (VALUES {values}) v(license, grams)),
        d AS (SELECT row_number() OVER () AS row_no, doc_id, list_transform(string_split_regex(lower(text), '\\r?\\n'), lambda l: regexp_extract_all(l, '[\\p{{L}}\\p{{N}}]+')) AS words FROM documents WHERE text IS NOT NULL),
        l AS (SELECT row_no, unnest(words) AS words, generate_subscripts(words, 1) - 1 AS line_no FROM d),
        hit AS (SELECT row_no, line_no, license FROM (SELECT row_no, line_no, {grams("words")} AS g FROM l) JOIN t ON list_has_any(g, t.grams)),
        w AS (SELECT a.row_no, a.license, a.line_no AS first, b.line_no AS last, flatten(d.words[a.line_no + 1:b.line_no + 1]) AS words
              FROM hit a JOIN hit b ON a.row_no = b.row_no AND a.license = b.license AND a.line_no <= b.line_no JOIN d ON d.row_no = a.row_no),
        g AS (SELECT row_no, w.license, first, last, t.grams, t.n, {grams("w.words")} AS g FROM w JOIN t USING (license) WHERE len(words) - 1 BETWEEN {low!r} * n AND {high!r} * n + 1),
        m AS (SELECT row_no, license, first, last, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + n) AS dice FROM g),
        f AS (SELECT row_no, license, list([{{'first': first, 'last': last, 'dice': dice}}] ORDER BY dice DESC, first, last) AS found FROM m WHERE dice >= {least}::DOUBLE GROUP BY ALL),
        k AS (SELECT row_no, license, unnest(list_reduce(found, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.first <= x[1].last AND y.last >= x[1].first)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS x FROM f)
        SELECT doc_id, CAST(x.first AS BIGINT) AS first_line, CAST(x.last AS BIGINT) AS last_line, license, CAST(x.dice AS DOUBLE) AS dice FROM k JOIN d USING (row_no)"""
