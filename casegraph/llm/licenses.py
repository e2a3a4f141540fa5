"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased; shingles are `SHINGLE` words. Templates are a
table (license, template). A template is cut into overlapping windows of at most `WINDOW` shingles; a text has a window of
the same size at every place. Windows carry MinHash signatures of BANDS * ROWS values; a text's window that agrees with a
template's in all ROWS values of a band retrieves that template. At a Jaccard similarity of 0.8 that happens with
probability 1 - (1 - 0.8**ROWS)**BANDS, over 0.9997 with 2 rows and 8 bands. The stretch where the template
would lie, and a margin, is verified by its exact shingles: at least `CONTAINMENT` of the template's distinct shingles.
Templates shorter than a shingle are found verbatim. Where licenses overlap in a text, the one of greater
containment stays, then the longer, then the later by name: a BSD-3-Clause text holds most of BSD-2-Clause, too.

Signatures are only made of windows that hold a shingle of a template, found by a join: a MinHash value is the hash of one of the
window's shingles, so others can't agree with a template. Rows of bands carry keys of 128 bits, not texts; the texts of the
rows concerned are joined again. Which side is broadcast is left to Spark's sizes. DataFrame functions only.

Defined cases: a null or wordless text has no license; rows of equal id and text give one row per license; ties in
containment go to the first place; null ids are allowed; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE, WINDOW, STRIDE, BANDS, ROWS, CONTAINMENT = 5, 8, 4, 8, 2, 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Public license notices, headers and texts by SPDX id.
TEMPLATES = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License "
        "for more details. You should have received a copy of the GNU Affero General Public License along with this program. If "
        "not, see <https://www.gnu.org/licenses/>."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY "
        "THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or "
        "derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this "
        "work to the public domain worldwide. This work is distributed without any warranty."
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
        "is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program; if not, write to "
        "the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public "
        "License for more details. You should have received a copy of the GNU Lesser General Public License along with this "
        "library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 "
        "USA"
    ),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License "
        "for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If "
        "not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to "
        "be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "WTFPL": (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
        "allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, "
        "DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."
    ),
    "all-rights-reserved": "All rights reserved.",
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda w: F.length(w) > 0)


def _shingles(words: Column, make) -> Column:
    """make(word, ...) at every place that has SHINGLE words from there on."""
    steps = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    return F.when(F.size(words) >= SHINGLE, F.transform(steps, lambda i: make(*(F.get(words, i + k) for k in range(SHINGLE))))).otherwise(F.array())


def _hashes(text: Column) -> Column:
    """The text's shingles in order, as hashes."""
    hashed = _let(_words(text), lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    return _let(hashed, lambda w: _shingles(w, lambda *x: F.xxhash64(*x)))


def _bands(window: Column) -> Column:
    """Per band a hash of its number and ROWS MinHash values."""
    least = lambda k: F.array_min(F.transform(window, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*(F.xxhash64(F.lit(b), *(least(b * ROWS + r) for r in range(ROWS))) for b in range(BANDS)))


def _template_rows(spark: SparkSession, templates: DataFrame | None) -> DataFrame:
    if templates is None:
        return spark.createDataFrame(list(TEMPLATES.items()), "license string, template string")
    return templates.select(F.col("license").cast("string"), F.col("template").cast("string"))


def template_windows(templates: DataFrame) -> DataFrame:
    """(license, size, offset, band): a row per band of each window of templates with a shingle."""
    shingled = templates.select("license", _hashes(F.col("template")).alias("h")).where("size(h) > 0")
    size = F.least(F.size("h"), F.lit(WINDOW))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.size("h") - size, F.lit(STRIDE)), F.array(F.size("h") - size)))
    return shingled.select("license", size.alias("size"), "h", F.explode(starts).alias("offset")).select("license", "size", "offset", F.explode(_bands(F.slice("h", F.col("offset") + 1, F.col("size")))).alias("band"))


def _strings(text: Column) -> Column:
    return _let(_words(text), lambda w: _shingles(w, lambda *x: F.concat_ws(" ", *x)))


def _row_keys() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(F.lit(1), "text").alias("text_key")]


def _verbatim(rows: DataFrame, templates: DataFrame) -> DataFrame | None:
    """Templates of fewer words than a shingle; the list of these is short, as such texts are."""
    found = []
    for license_, template in templates.where(F.size(_words(F.col("template"))) < SHINGLE).collect():
        words = [w for w in re.split(SEPARATORS, template.lower()) if w]
        if words:
            pattern = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])" + SEPARATORS.join(map(re.escape, words)) + r"(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
            at = F.regexp_instr(F.lower("text"), F.lit(pattern))
            before = F.size(_words(F.substring(F.col("text"), F.lit(1), at - 1)))
            end = before + len(words) - 1
            match = F.struct(F.lit(license_).alias("license"), F.lit(1.0).cast("double").alias("containment"), before.alias("word"), end.alias("last"), F.lit(1).alias("n"))
            found.append(F.when(F.lower("text").contains(words[-1]) & (at > 0), match))
    if not found:
        return None
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return rows.select("doc_id", *_row_keys(), F.explode(hits).alias("f")).distinct().select("doc_id", "row_key", "text_key", "f.*")


def _contained(rows: DataFrame, templates: DataFrame, containment: float) -> DataFrame:
    """Templates with shingles: (doc_id, row_key, text_key, license, containment, word, last, n)."""
    keyed = rows.select("doc_id", "text", *_row_keys())
    # Written tables have a known size, so Spark broadcasts them where they are small (all of SPDX is some 7 MB of hashes).
    known = written(templates.select(F.explode(_hashes(F.col("template"))).alias("h")).distinct())
    bands = written(template_windows(templates))
    sizes = sorted(r["size"] for r in bands.select("size").distinct().collect()) or [WINDOW]  # 1 to WINDOW
    # A window's MinHash values are hashes of its shingles: only windows with a shingle of a template can share a value with one.
    places = keyed.select("row_key", "text_key", F.posexplode(_hashes(F.col("text"))).alias("place", "h")).join(known, "h")
    places = written(places.groupBy("row_key", "text_key").agg(F.collect_set("place").alias("places")))

    def around(p: Column, size: int) -> Column:
        """The windows of this size that hold place p."""
        return F.transform(F.sequence(F.greatest(p - size + 1, F.lit(0)), p), lambda q: F.struct(F.lit(size).alias("size"), q.alias("start")))

    starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.flatten(F.array(*(around(p, size) for size in sizes))))))
    cut = F.transform(F.filter("starts", lambda w: w["start"] + w["size"] <= F.size("h")), lambda w: F.struct(w["size"].alias("size"), w["start"].alias("start"), F.slice("h", w["start"] + 1, w["size"]).alias("window")))
    windows = keyed.join(places, ["row_key", "text_key"]).select("row_key", "text_key", _hashes(F.col("text")).alias("h"), starts.alias("starts")).select("row_key", "text_key", F.explode(cut).alias("w"))
    signed = windows.select("row_key", "text_key", "w.size", "w.start", F.explode(_bands(F.col("w.window"))).alias("band")).distinct()
    met = signed.join(bands, ["size", "band"]).select("row_key", "text_key", "license", (F.col("start") - F.col("offset")).alias("begin")).distinct()
    whole = written(templates.select("license", F.size(_hashes(F.col("template"))).alias("n"), F.array_distinct(_strings(F.col("template"))).alias("shingles")))
    candidates = written(met.join(whole.select("license", "n"), "license").groupBy("row_key", "text_key").agg(F.collect_list(F.struct("license", "n", "begin")).alias("c")))

    def region(c: Column) -> Column:
        """Where the whole template would lie, and a quarter of it on both sides."""
        margin = F.ceil(c["n"] / 4).cast("int")
        first = F.greatest(c["begin"] - margin, F.lit(0))
        return F.struct(c["license"].alias("license"), c["n"].alias("n"), first.alias("first"), F.slice("all", first + 1, c["n"] + 2 * margin).alias("region"))

    regions = keyed.join(candidates, ["row_key", "text_key"]).select("doc_id", "row_key", "text_key", "c", _strings(F.col("text")).alias("all")).select("doc_id", "row_key", "text_key", F.explode(F.transform("c", region)).alias("r")).select("doc_id", "row_key", "text_key", "r.*")
    at = F.filter(F.sequence(F.lit(0), F.size("region") - 1), lambda i: F.array_contains("shingles", F.get("region", i)))
    verified = (
        regions.join(whole.select("license", "shingles"), "license")
        .withColumn("containment", F.size(F.array_intersect("region", "shingles")) / F.size("shingles"))
        .where(F.col("containment") >= containment)
        .select("doc_id", "row_key", "text_key", "license", "containment", "n", "first", at.alias("at"))
        .select("doc_id", "row_key", "text_key", "license", "containment", "n", (F.col("first") + F.array_min("at")).alias("word"), (F.col("first") + F.array_max("at") + SHINGLE - 1).alias("last"))
    )
    best = verified.groupBy("doc_id", "row_key", "text_key", "license").agg(F.max(F.struct("containment", (-F.col("word")).alias("word"), "last", "n")).alias("b"))
    return best.select("doc_id", "row_key", "text_key", "license", "b.containment", (-F.col("b.word")).alias("word"), "b.last", "b.n")


def scanned(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, word): the licenses of each text, and the word (from 0) at which the first shingle of each begins.

    templates: a table (license, template); None stands for TEMPLATES.
    """
    templates = _template_rows(docs.sparkSession, templates)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    columns = ["doc_id", "row_key", "text_key", "license", "containment", "word", "last", "n"]
    found = _contained(rows, templates, containment).select(*columns)
    short = _verbatim(rows, templates)
    found = found if short is None else found.union(short.select(*columns))
    # A text has a row for each license at most, so its list has a bound.
    rank = lambda x: F.struct(x["containment"], x["n"], x["license"])
    beaten = lambda x: F.exists("m", lambda y: (y["word"] <= x["last"]) & (y["last"] >= x["word"]) & (rank(y) > rank(x)))
    by_row = found.groupBy("doc_id", "row_key", "text_key").agg(F.collect_list(F.struct("license", "containment", "word", "last", "n")).alias("m"))
    return by_row.select("doc_id", F.explode(F.filter("m", lambda x: ~beaten(x))).alias("x")).select("doc_id", "x.license", "x.containment", "x.word")
