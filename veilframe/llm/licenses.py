"""License texts in documents by MinHash bands over overlapping windows (operator 6), in DataFrame functions only.

Texts and templates are words of letters and digits, lower case, and shingles of five of them. Windows of SIZES shingles start at every
shingle of texts and of templates; a band of a window is the smallest of its shingle hashes under a mask, and a template is indexed
by the largest windows that it has twice over, so short notices by short ones. Masks are exclusive ors with constants, under which each of a set of
random hashes is as likely the smallest.

Equal windows collide in every band. A changed word breaks five shingles, an inserted one four, and a match keeps CONTAINED of a
template's shingles; so of n shingles, for n of 16 and more, some unbroken run has at least 12 n / (n + 16) >= 6, and for
fewer only the ends can be broken, which leaves runs of 6 of 8 and of 3 of 4. Each of SIZES fits in the run, so a match has an equal window and its bands collide with
certainty. What breaks shingles singly, of which no run is left, still collides in a window with one shingle changed in one of two bands with
1 - (2 / 7) ** 2 = 0.92 (5 of 7 shingles are shared), and has several such windows.

Bands retrieve (text, template) candidates; what counts is the exact containment of the template's shingles, as strings, in a stretch of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
#: Shingles of windows, and the masks of their bands. Of one and of three shingles only equal windows matter.
SIZES = {1: (0,), 3: (0,), 6: (0, 0x2545F4914F6CDD1D)}
CONTAINED = 0.75
CELL = 32  # candidates of one template within so many words are one

# Notices and paragraphs of public licenses, in the wording their stewards publish or that projects commonly use for one line.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source "
    "code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSD-binary-form": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN "
    "IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
    "notice appear in all copies.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
    "version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def license_words(text: Column) -> Column:
    """Words of letters and digits, lower case; none for null and for texts without."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _shingle_hashes(words: Column) -> Column:
    """Hashes of the runs of five words; none for fewer words."""
    n = F.greatest(F.size(words) - (WORDS - 1), F.lit(0))
    part = lambda k: F.slice(words, k + 1, n)
    out = F.transform(part(0), lambda w: F.xxhash64(w))
    for k in range(1, WORDS):
        out = F.zip_with(out, part(k), lambda h, w: F.xxhash64(h, w))
    return out


def _bands(hashes: Column, size: int, mask: int) -> Column:
    """The band of the window at each shingle: the least of ``size`` hashes under a mask. Texts with fewer shingles have no window."""
    least = hashes if not mask else F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(mask)))
    reach = 1
    while reach < size:
        step = min(reach, size - reach)
        # Windows of ``reach`` at two places, at most that far apart, cover one of reach + step.
        least = _bound(least, lambda m, step=step: F.zip_with(F.slice(m, 1, F.greatest(F.size(m) - step, F.lit(0))), F.slice(m, step + 1, F.size(m)), lambda x, y: F.least(x, y)))
        reach += step
    return least


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though ``body`` reads it more than once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def size_of(n_shingles: int) -> int:
    """Shingles of the windows by which a template is indexed."""
    return 6 if n_shingles >= 8 else 3 if n_shingles >= 3 else 1


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, its words, its shingles as strings and their hashes."""
    rows = spark.createDataFrame(list(templates.items()), "license string, notice string").select("license", license_words(F.col("notice")).alias("words"))
    strings = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (WORDS - 1), F.lit(1))), lambda i: F.array_join(F.slice("words", i, WORDS), " "))
    return rows.select("license", "words", F.array_distinct(strings).alias("shingles"), _shingle_hashes(F.col("words")).alias("hashes"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """id, license, first_word (from 0), n_shared, n_shingles, containment: one row per text and license found in it.

    A license is found if the share of its shingles in some stretch, of its length to both sides of windows that collided, reaches
    ``contained``; the best stretch is reported, the first of equal ones. Texts without licenses have no row, nor have null and empty
    ones; repeated rows have one each. Texts are read whole: of a long one only stretches around collisions are copied. Templates need at least
    five words. What is looked up is the table of templates, whose size is fixed before the query runs.
    """
    spark = docs.sparkSession
    bands = [(size, mask) for size, masks in SIZES.items() for mask in masks]
    table = template_table(spark, templates).select("license", "shingles", F.size("words").alias("length"), F.size("hashes").alias("n"), *[_bands(F.col("hashes"), *b).alias(f"b{k}") for k, b in enumerate(bands)]).orderBy("license").collect()
    owners: list[dict[int, list[int]]] = [{} for _ in bands]
    for place, r in enumerate(table):
        for k, (size, _) in enumerate(bands):
            if size == size_of(r["n"]):
                for key in dict.fromkeys(r[f"b{k}"]):
                    owners[k].setdefault(key, []).append(place)
    used = [k for k in range(len(bands)) if owners[k]]
    if not used:
        return docs.select(F.col(id_col)).limit(0).selectExpr(id_col, "'' AS license", "0 AS first_word", "0 AS n_shared", "0 AS n_shingles", "0D AS containment")

    known = {k: F.array(*[F.lit(key) for key in sorted(owners[k])]) for k in used}
    base = docs.select(F.col(id_col), license_words(F.col(text_col)).alias("words"))
    base = base.select(id_col, "words", _shingle_hashes(F.col("words")).alias("h"))
    # The row number also keeps the filter below from being evaluated under this projection, which would band every text twice.
    base = base.select(F.monotonically_increasing_id().alias("_row"), id_col, "words", *[_bands(F.col("h"), *bands[k]).alias(f"b{k}") for k in used])
    overlap = F.lit(False)
    for k in used:
        overlap = overlap | F.arrays_overlap(f"b{k}", known[k])
    hit = base.filter(overlap)

    def candidates(k: int) -> Column:
        """(template, cell) of the windows that collided in a band."""
        places = F.create_map(*[F.lit(x) if i % 2 == 0 else F.array(*map(F.lit, x)) for key in sorted(owners[k]) for i, x in enumerate((key, owners[k][key]))])
        windows = F.filter(F.transform(f"b{k}", lambda key, i: F.struct(F.floor(i / CELL).cast("int").alias("cell"), key.alias("key"))), lambda x: F.array_contains(known[k], x["key"]))
        return F.flatten(F.transform(windows, lambda x: F.transform(places[x["key"]], lambda t: F.struct(t.alias("place"), x["cell"].alias("cell")))))

    # Stretches are cut out before the rows multiply, so no row but the text's own holds all of its words.
    length = F.array(*[F.lit(r["length"]) for r in table])
    found = F.array_distinct(F.concat(*[candidates(k) for k in used]))

    def stretch(x: Column) -> Column:
        n = F.element_at(length, x["place"] + 1)
        start = F.greatest(x["cell"] * CELL - n + WORDS, F.lit(0))
        return F.struct(x["place"].alias("place"), start.alias("start"), F.slice("words", start + 1, x["cell"] * CELL + CELL + n + WORDS - start).alias("near"))

    near = hit.select("_row", id_col, F.explode(F.transform(found, stretch)).alias("x")).select("_row", id_col, "x.*")
    texts = spark.createDataFrame([(place, r["license"], r["shingles"]) for place, r in enumerate(table)], "place int, license string, shingles array<string>")
    strings = F.transform(F.sequence(F.lit(1), F.greatest(F.size("near") - (WORDS - 1), F.lit(1))), lambda i: F.array_join(F.slice("near", i, WORDS), " "))
    shared = F.array_intersect(F.col("shingles"), F.col("strings"))
    checked = near.join(F.broadcast(texts), "place").withColumn("strings", strings).withColumn("shared", shared)
    first = F.array_min(F.transform("shared", lambda g: F.array_position(F.col("strings"), g)))
    checked = checked.select("_row", id_col, "license", (F.col("start") + first - 1).cast("int").alias("first_word"), F.size("shared").alias("n_shared"), F.size("shingles").alias("n_shingles"))
    best = checked.groupBy("_row", id_col, "license").agg(F.max_by(F.struct("first_word", "n_shared", "n_shingles"), F.struct("n_shared", -F.col("first_word"))).alias("b"))
    out = best.select(id_col, "license", "b.*").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
    return out.filter(F.col("containment") >= contained)
