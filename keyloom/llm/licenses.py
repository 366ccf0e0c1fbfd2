"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of a-z and 0-9 after lower-casing; a shingle is five words, or all words of a template that has fewer.
Texts none of whose shingles is in any template hold none, and end here. Of the others every window of WINDOW shingles
gives BANDS values, the least of seeded hashes of its shingles, and meets the templates that have a window with one of
these values. Windows begin at every shingle, in texts and templates.

What the settings guarantee: two windows that share a part s of their different shingles meet with a probability of
1 - (1 - s)**BANDS, as the seeded hashes are independent; equal windows meet in every band. A text that holds 0.8 of a
template's n shingles has lost n/5 of them. A changed word costs up to five shingles in a row, an added or lacking one
four, so there are n/20 breaks at most, and some run of held shingles is at least 0.8 n / (n/20 + 1) long: 8 or more
for every n from 20 on, and for n below 20 (at most three lost, so no break inside) from n = 10 on. Such a template is
always retrieved. Templates of fewer shingles than a window are indexed by their shingles, and a shared one always
meets. Only texts in which the lost shingles lie scattered in other ways depend on the probability above.

What is retrieved is verified exactly: the share of the template's shingles in the text. All of it is array functions
inside a row: no join, no shuffle, no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 8  # shingles
BANDS = 8
LEAST = 0.8

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."

# Wordings of public license notices and texts, by name.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "public-domain-notice": "This work is in the public domain.",
    "mit-notice": "Released under the MIT License.",
    "bsd-notice": "Licensed under the BSD License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": _BSD_HEAD + " " + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL,
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. " + _AS_IS + ", TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": _GPL.format("program", "General Public License"),
    "lgpl-3.0": _GPL.format("library", "Lesser General Public License"),
    "agpl-3.0": _GPL.format("program", "Affero General Public License"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}


def _shingles(length: int) -> Column:
    """Hashes of the runs of `length` words, in order; of fewer words, none."""
    one = lambda i: F.xxhash64(*(F.element_at("ws", i + k) for k in range(length)))
    return F.when(F.size("ws") >= length, F.transform(F.sequence(F.lit(1), F.size("ws") - (length - 1)), one)).otherwise(F.array().cast("array<bigint>"))


def _fenced(df: DataFrame) -> DataFrame:
    """`df` with a column that is not deterministic: it keeps filters above, which would else evaluate arrays again."""
    return df.withColumn("part", F.spark_partition_id())


def _with_shingles(df: DataFrame, text: Column, lengths: list[int], *keep: Column) -> DataFrame:
    """`keep`, and for each length the shingle hashes h<length> in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")
    hashed = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("ws"))
    return _fenced(hashed.select(*(c for c in hashed.columns if c != "ws"), F.size("ws").alias("words"), *(_shingles(n).alias(f"h{n}") for n in lengths)))


def _bands(hs: str) -> Column:
    """Per band and window the least seeded hash of the window's shingles, told apart by band."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size(hs) - (WINDOW - 1), F.lit(1))), lambda i: F.slice(hs, i, WINDOW))
    least = lambda j: lambda w: F.xxhash64(F.lit(j), F.array_min(F.transform(w, lambda x: F.xxhash64(F.lit(j), x))))
    return F.flatten(F.transform(windows, lambda w: F.array(*(least(j)(w) for j in range(BANDS)))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, int, list[int], list[int]]]:
    """(name, words in a shingle, distinct shingles, index values) of each template."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    made = _with_shingles(rows, F.col("text"), list(range(1, SHINGLE + 1)), F.col("name")).withColumn("bands", _bands(f"h{SHINGLE}"))
    out = []
    for r in made.collect():  # the given templates
        if n := min(r["words"], SHINGLE):
            hs = r[f"h{n}"]
            out.append((r["name"], n, sorted(set(hs)), sorted(set(hs if len(hs) < WINDOW else r["bands"]))))
    return out


def _longs(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, template, containment, first_word, last_word: one row per row and template that its text holds.

    Words count from 1. Null and empty texts hold none; a text of fewer than five words can hold only templates of as
    few. Null ids and repeated rows are rows like others; a very long text is one row's arrays; an empty table gives an
    empty result; other columns are ignored. Rows come in no order; a text may hold several templates.
    """
    known = template_table(docs.sparkSession, templates)
    lengths = sorted({n for _, n, _, _ in known})
    made = _with_shingles(docs, F.col(text_col), lengths, F.col(id_col).alias("id"))
    some = F.lit(False)
    for n in lengths:
        listed = sorted({h for _, m, hs, _ in known if m == n for h in hs})
        some = some | F.exists(f"h{n}", lambda x: x.isin(listed))  # noqa: B023
    near = _fenced(made.filter((F.col("part") >= 0) & some))
    # of the few texts that share a shingle with a template: which, by bands, and how much of it they hold
    index = sorted({v for _, _, _, vs in known for v in vs})
    values = F.concat(*(f"h{n}" for n in lengths), _bands(f"h{SHINGLE}") if SHINGLE in lengths else F.array().cast("array<bigint>"))
    met = _fenced(near.filter(F.col("part") >= 0).select("id", *(f"h{n}" for n in lengths), F.array_intersect(values, _longs(index)).alias("met"))).filter((F.size("met") > 0) & (F.col("part") >= 0))
    entries = F.array(*(F.struct(F.lit(name).alias("template"), F.lit(n).alias("length"), _longs(hs).alias("shingles"), _longs(vs).alias("index")) for name, n, hs, vs in known))
    have = F.coalesce(*(F.when(F.col("t.length") == n, F.col(f"h{n}")) for n in lengths))
    each = met.select("*", F.explode(entries).alias("t")).filter(F.arrays_overlap("met", "t.index")).select("id", "t", have.alias("hs"))
    shared = each.select("id", "hs", "t.template", "t.length", F.size("t.shingles").alias("n"), F.array_intersect("t.shingles", "hs").alias("shared"))
    held = shared.filter(F.size("shared") >= F.lit(least) * F.col("n"))
    places = held.select("id", "template", "length", (F.size("shared") / F.col("n")).alias("containment"), F.transform("shared", lambda x: F.array_position("hs", x)).alias("at"))
    return places.select(F.col("id").alias(id_col), "template", "containment", F.array_min("at").cast("long").alias("first_word"), (F.array_max("at") + F.col("length") - 1).cast("long").alias("last_word"))
