"""License scans with DataFrame operations only: MinHash bands over overlapping windows, exact containment.

Words are runs of letters and digits, lower-cased; shingles are ``WORDS`` words. A license is found in a
document if the document holds at least ``THRESHOLD`` of the distinct shingles of one of its templates
(license_id, text). Each template is judged by itself; of several under one license_id the best
contained is reported.

Retrieval. A template of n distinct shingles has windows of its own over the documents: ``SLACK`` n shingles and
half as many again, every half of ``SLACK`` n, so every run of ``SLACK`` n shingles lies whole in one window. A window and a template
are compared by ``BANDS`` MinHash bands of one row; the template is a candidate if any window agrees with it in any
band. A run that holds the share 0.8 of the template's shingles has a Jaccard similarity of at least
0.8 / (1.5 * 1.25 + 0.2) = 0.385 to it, so it is missed with a probability below (1 - 0.385) ^ 32 < 2e-7; exact
copies (0.53) with less than 4e-11. Shingles scattered over more than ``SLACK`` n are outside that
guarantee, though any window may still retrieve them.

A band can only agree where the document holds the template's minimal shingle of that band. So a document is first
intersected with the minimal shingles of all bands, and the minima of windows are computed only around those, until one agrees.

Verification. A candidate's whole text is judged: the template's distinct shingles, as strings, that occur
anywhere in it. Everything happens in the row of the document; only found licenses are shuffled. Templates go to the tasks
in sets of at most ``MAX_TEMPLATES`` and about ``MAX_CHARS`` characters (a longer template is a set by itself), one pass over the documents each, so
what the driver holds and sends stays bounded for a list of any length.

Texts that differ in a few words (GPL-2.0-header and GPL-3.0-header) are both found where one stands; the
containment tells them apart.

Defined cases: a null or empty text and a text of fewer than five words match nothing, a template of fewer
than five words is never found; repeated templates are one; rows that repeat a doc_id are judged each by
itself and reported once, by the best; empty tables give an empty result.
"""

from __future__ import annotations

import json
import math
import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloss.llm.common import cut, texts

WORDS = 5
THRESHOLD = 0.8
BANDS = 32
SLACK = 1.25                # longest run, in parts of the template, that a window must hold whole
MAX_TEMPLATES = 128
MAX_CHARS = 8 << 20

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
    "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
    "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE.")

# Notices and texts of common licenses, in their published wording.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0-header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("GPL-3.0-header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("MIT-grant",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:"),
    ("MPL-2.0-header",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
     "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-header",
     "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation; either version 2 of the License, or "
     "(at your option) any later version."),
    ("LGPL-2.1-header",
     "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
     "(at your option) any later version."),
    ("LGPL-3.0-header",
     "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("AGPL-3.0-header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
     "(at your option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0-notice",
     "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0-notice",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT-text",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
     "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
     "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC-text",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
     "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
     "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
     "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause-text", _BSD.format("")),
    ("BSD-3-Clause-text", _BSD.format(
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. ")),
]
TEMPLATES += [(f"{name}-text", pkgutil.get_data("opsloss.llm", f"license_texts/{name}.txt").decode()) for name in (
    "Apache-2.0", "CC0-1.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0")]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license_id string, text string")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(words: str) -> Column:
    """0 .. number of shingles - 1."""
    n = F.size(words) - (WORDS - 1)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def shingles(words: str) -> Column:
    """The shingles of a column of words, as strings, in order."""
    return F.transform(_places(words), lambda i: F.array_join(F.slice(words, i + 1, WORDS), " "))


def shingle_hashes(hashed: str) -> Column:
    """Hashes of the shingles of a column of word hashes, in order."""
    return F.transform(_places(hashed), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WORDS)]))


def with_hashes(df: DataFrame) -> DataFrame:
    """``df`` with the shingle hashes ``h`` of its text."""
    df = df.withColumn("w", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
    return df.withColumn("h", shingle_hashes("w")).drop("w")


def sketches(found: DataFrame) -> DataFrame:
    """template (its number), license_id, text, n, bands of each template with a shingle; a band is (i, m, v): the
    minimal shingle m under the band's hash function i, and the hash v that it has there."""
    t = found.select("license_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    h = (with_hashes(t).select("license_id", "text", F.array_distinct("h").alias("h"))
         .select("license_id", "text", F.size("h").alias("n"), F.explode_outer("h").alias("m"))
         .filter(F.col("m").isNotNull()))
    mins = [F.min(F.struct(F.xxhash64("m", F.lit(i)).alias("v"), F.col("m").alias("m"))).alias(f"b{i}") for i in range(BANDS)]
    bands = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"b{i}.m").alias("m"), F.col(f"b{i}.v").alias("v")) for i in range(BANDS)])
    return (h.groupBy("license_id", "text", "n").agg(*mins)
            .select("license_id", "text", "n", bands.alias("bands"), F.xxhash64("license_id", "text").alias("template")))


def template_sets(found: DataFrame, most: int):
    """Rows of ``sketches``, some templates at a time."""
    own = cut(sketches(found), "licenses")
    total, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()
    parts = max(1, -(-total // most), -(-chars // MAX_CHARS))
    if parts > 1:
        # by rank of the hash, so that no set has more than its share; the list is one of templates, not of documents
        places = own.select("template", F.char_length("text").alias("c")).orderBy("template").collect()
        cuts, held, size = [], 0, 0
        for r in places:
            if held and (held >= most or size + r.c > MAX_CHARS):
                cuts.append(r.template)
                held = size = 0
            held, size = held + 1, size + r.c
        edges = [None, *cuts, None]
        for lo, hi in zip(edges, edges[1:]):
            part = own if lo is None else own.filter(F.col("template") >= lo)
            yield part if hi is None else part.filter(F.col("template") < hi)
        return
    yield own


def _literal(rows: list, kind: str) -> Column:
    """A constant of a nested type; the optimiser folds it once."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


SKETCH = "array<struct<t:bigint,stride:int,length:int,bands:array<struct<i:int,m:bigint,v:bigint>>>>"


def candidates(h: str, own: list) -> tuple[Column, Column]:
    """Columns: ``hit``, the minimal shingles that occur in ``h``, and (over a column ``hit``) the numbers of the
    templates that some window of ``h`` agrees with in some band."""
    table = []
    for r in own:
        run = max(2, math.ceil(SLACK * r.n))
        stride = max(1, run // 2)
        table.append({"t": r.template, "stride": stride, "length": run + stride,
                      "bands": [{"i": b.i, "m": b.m, "v": b.v} for b in r.bands]})
    minimal = _literal(sorted({b["m"] for x in table for b in x["bands"]}), "array<bigint>")

    def agrees(t: Column, band: Column) -> Column:
        def window(k: Column) -> Column:
            held = F.slice(h, k * t["stride"] + 1, t["length"])
            return F.array_min(F.transform(held, lambda x: F.xxhash64(x, band["i"]))) == band["v"]

        def around(p: Column) -> Column:       # the windows that hold place p
            first = F.greatest(F.lit(0), F.ceil((p - t["length"] + 1) / t["stride"]).cast("int"))
            return F.exists(F.sequence(first, F.floor(p / t["stride"]).cast("int")), window)

        at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda p: F.get(h, p) == band["m"])
        return F.exists(at, around)

    # only documents with a minimal shingle get here; array_intersect is one hash lookup per shingle
    hit = F.array_intersect(h, minimal)
    found = F.filter(_literal(table, SKETCH), lambda t: F.exists(
        t["bands"], lambda band: F.when(F.array_contains(F.col("hit"), band["m"]), agrees(t, band)).otherwise(F.lit(False))))
    return hit, F.when(F.size("hit") > 0, F.transform(found, lambda t: t["t"])).otherwise(F.array().cast("array<bigint>"))


def retrieve(docs: DataFrame, own: list) -> DataFrame:
    """(doc_id, text, template) of every text and candidate template of the set ``own``."""
    base = with_hashes(texts(docs)).select("doc_id", "text", "h")
    hit, found = candidates("h", own)
    base = base.withColumn("hit", hit).withColumn("found", found)
    # explode_outer: the filter that explode implies would be pushed below the projections that compute the arrays
    return base.select("doc_id", "text", F.explode_outer("found").alias("template")).filter(F.col("template").isNotNull())


def scan(docs: DataFrame, found: DataFrame, most: int = MAX_TEMPLATES) -> DataFrame:
    """doc_id, license_id, n_shared, n_shingles, containment of each license found in a document."""
    out = None
    for part in template_sets(found, most):
        own = part.collect()                    # bounded: MAX_TEMPLATES and MAX_CHARS
        want = part.withColumn("w", words_of(F.col("text"))).select(
            "template", "license_id", F.array_distinct(shingles("w")).alias("want"))
        held = retrieve(docs, own).withColumn("w", words_of(F.col("text"))).select("doc_id", "template", shingles("w").alias("held"))
        judged = held.join(F.broadcast(want), "template").select(
            "doc_id", "license_id", F.size(F.array_intersect("want", "held")).cast("long").alias("n_shared"),
            F.size("want").cast("long").alias("n_shingles"))
        out = judged if out is None else out.unionByName(judged)
    containment = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    good = out.filter(F.col("n_shared") >= THRESHOLD * F.col("n_shingles"))
    best = F.max(F.struct(containment, "n_shared", "n_shingles")).alias("b")
    return good.groupBy("doc_id", "license_id").agg(best).select(
        "doc_id", "license_id", "b.n_shared", "b.n_shingles", "b.containment")
