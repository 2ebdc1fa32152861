"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies (DataFrame
functions only).

Words are runs of letters, digits and characters beyond ASCII, in lower case; shingles are five consecutive words, hashed to
64 bits. A template of n shingles belongs to the window class whose length is the least power of two at or above 2.5 n.
Windows of a class overlap by half, so an occurrence (0.8 of a template's shingles within 1.25 n words) lies within one
window, and its Jaccard coefficient with that window is at least 0.8 / 5.2 = 0.15. With 64 bands of one MinHash value the
window retrieves the template with a probability above 0.9999. A retrieved template is found if the window contains at
least 0.8 of its shingles, counted exactly.

A band can only match where the least shingle of a window is a shingle of some template; so windows without any shingle of
the templates, almost all, are dropped unhashed, which changes no result. Distinct texts are scanned once.

Templates are a table (license_id, text), by default the notices and short licenses below. Their shingles (a bounded table: a few
thousand values) are literals of the plan up to ``MAX_LITERALS``; with more, a join finds the texts that share one.

Defined results: null, empty and short texts have no shingles and no licenses; templates of fewer than five words are
refused. Copies get the same findings. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 64
MAX_LITERALS = 20_000
#: The findings of so many texts (about 100 bytes each) are broadcast to the documents; beyond, they are joined by a shuffle,
#: with each text's copies dealt over so many tasks.
BROADCAST_ROWS, SALTS = 100_000, 32

# Public license notices and the running text of short licenses. A longer license is found by its notice; its full
# text can be given as a template.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-full": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "license_id string, text string")


def shingles(text: Column) -> tuple[Column, Column]:
    """The words of a text, and (from a column __w of such words) their shingles in order, one for each start."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")
    at = lambda i: [F.get("__w", i + k) for k in range(SHINGLE)]
    n = F.size("__w") - SHINGLE
    return words, F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*at(i)))).otherwise(F.array().cast("array<long>"))


def shingled(df: DataFrame, keep: list[str]) -> DataFrame:
    words, hashes = shingles(df["text"])
    rows = df.select(*keep, words.alias("__w")).select(*keep, hashes.alias("h"))
    # The id keeps filters on h from being pushed below, where the words would be made again for each shingle.
    return rows.withColumn("__id", F.monotonically_increasing_id()).where("__id >= 0").drop("__id")


def band_values(h: Column) -> Column:
    """The MinHash value of each band, for an array of shingles."""
    seeds = F.sequence(F.lit(1), F.lit(BANDS))
    return F.transform(seeds, lambda b: F.array_min(F.transform(h, lambda x: F.xxhash64(x, b))))


def prepared(notices: DataFrame) -> DataFrame:
    """license_id, t (distinct shingles), length (of the windows of its class), bands."""
    t = shingled(notices.where("license_id is not null"), ["license_id"]).select("license_id", F.array_distinct("h").alias("t"))
    t = t.where(F.when(F.size("t") > 0, True).otherwise(F.raise_error(F.concat(F.lit("fewer than five words: "), "license_id")).cast("boolean")))
    t = t.withColumn("length", F.pow(F.lit(2.0), F.ceil(F.log2(F.size("t") * 2.5))).cast("int"))
    return t.withColumn("bands", band_values(F.col("t")))


def windows(rows: DataFrame, wanted: list[int] | None, pool: DataFrame, lengths: list[int]) -> DataFrame:
    """key, length, w, s: the windows of each text that have a shingle of the pool; window w starts at shingle w * length / 2."""
    if wanted is not None:
        rows = rows.where(F.arrays_overlap("h", F.array(*[F.lit(x) for x in wanted]).cast("array<long>"))).groupBy("key").agg(F.any_value("h").alias("h"))
        # A set lookup for each shingle.
        rows = rows.withColumn("at", F.filter(F.transform("h", lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull()))
    else:
        hit = rows.select("key", F.posexplode("h").alias("i", "x")).join(pool, "x").groupBy("key").agg(F.array_sort(F.collect_set("i")).alias("at"))
        rows = rows.join(hit.select(F.col("key").alias("__k"), "at"), F.col("key") == F.col("__k")).groupBy("key").agg(F.any_value("h").alias("h"), F.any_value("at").alias("at"))
    classes = F.array(*[F.lit(n) for n in lengths])

    def of(n: Column) -> Column:
        half = F.floor(n / 2).cast("int")
        last = F.greatest(F.ceil((F.size("h") - n) / half).cast("int"), F.lit(0))
        # A place is in the window that starts in its own half and in the one before.
        both = F.flatten(F.transform("at", lambda i: F.array(F.floor(i / half).cast("int"), F.floor(i / half).cast("int") - 1)))
        return F.transform(F.array_distinct(F.filter(F.transform(both, lambda w: F.least(w, last)), lambda w: w >= 0)), lambda w: F.struct(n.alias("length"), w.alias("w")))

    x = rows.select("key", "h", F.explode(F.flatten(F.transform(classes, of))).alias("p"))
    half = F.floor(F.col("p.length") / 2).cast("int")
    return x.select("key", "p.length", "p.w", F.array_distinct(F.slice("h", F.col("p.w") * half + 1, F.col("p.length"))).alias("s"))


def scan(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """key (two hashes of the text), license_id, n_hit, n_shingles, first, last: for each distinct text and license in it, the
    shingles found in the window that holds most of them (the first of those), and the window's place in words."""
    notices = templates(docs.sparkSession) if notices is None else notices
    known = prepared(notices)
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # powers of two: a few
    pool = known.select(F.explode("t").alias("x")).distinct()
    few = sorted(r.x for r in pool.limit(MAX_LITERALS + 1).collect())
    wanted = None if len(few) > MAX_LITERALS else few
    rows = shingled(docs.where("text is not null").withColumn("key", text_key()), ["key"])
    if not lengths:
        rows, lengths = rows.limit(0), [4]
    # Read twice: the bands, and the shingles of the windows that were retrieved.
    win = cut(windows(rows, wanted, pool, lengths), "windows")
    banded = win.select("key", "length", "w", F.posexplode(band_values(F.col("s"))).alias("band", "value"))
    keys = known.select("license_id", "length", F.posexplode("bands").alias("band", "value"))
    got = banded.join(keys, ["length", "band", "value"]).select("key", "license_id", "length", "w").distinct()
    got = got.join(win, ["key", "length", "w"]).join(known.select("license_id", "t"), "license_id")
    got = got.select("key", "license_id", "length", "w", F.size(F.array_intersect("s", "t")).alias("n_hit"), F.size("t").alias("n_shingles"))
    got = got.where(F.col("n_hit") * 10 >= F.col("n_shingles") * round(CONTAINMENT * 10))
    best = F.max(F.struct("n_hit", (-F.col("w")).alias("w"), "n_shingles", "length")).alias("m")
    got = got.groupBy("key", "license_id").agg(best)
    first = (-F.col("m.w") * F.floor(F.col("m.length") / 2)).cast("long")
    return got.select("key", "license_id", "m.n_hit", "m.n_shingles", first.alias("first"), (first + F.col("m.length") + SHINGLE - 1).alias("last"))


def text_key() -> Column:
    return F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"))


def licenses(docs: DataFrame, notices: DataFrame | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (ids in order, joined by commas), places (first-last word of the window of each) of every document."""
    per = scan(docs, notices).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("license_id", F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")).alias("place")))).alias("l"))
    per = cut(per, "licenses")
    rows = docs.where("text is not null").select("doc_id", text_key().alias("key"))
    if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = rows.join(F.broadcast(per), "key", "left")
    else:
        # Copies of one text are dealt over SALTS tasks.
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
        out = rows.join(per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left")
    out = out.select("doc_id", "l").union(docs.where("text is null").select("doc_id", F.lit(None).cast(per.schema["l"].dataType)))
    names = lambda f: F.coalesce(F.array_join(F.transform("l", lambda x: x[f]), ","), F.lit(""))
    return out.select("doc_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licenses"), names("license_id").alias("licenses"), names("place").alias("places"))
