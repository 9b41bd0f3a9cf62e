"""Licence notices in documents: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

A shingle is five words. Templates of 24 shingles or more are cut into windows of 16 shingles at every offset, documents at
every eighth; a window's minimum and maximum under two permutations are four bands of one value each. A document's window
and the template's window at the same place, with similarity j, share no band with probability (1 - j) ** 4. Where single
words are replaced evenly until three quarters of the shingles are left, every fifteen to twenty words, a window keeps 11 of
16 shingles or more, so j is 0.52 or more and a window misses with probability 0.05 at most; a template of 24 shingles has
two such windows (0.003), one of 60 has five. Shorter templates have windows of one shingle, whose only band is the shingle
itself: they are always retrieved. A retrieved pair of document and template is verified on whole texts.
All in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise, maybe_broadcast
from .words import item_words, run_hash, word_hashes

SHINGLE = 5
CONTAINMENT_PERCENT = 75
#: Templates with at least this many shingles have windows of WINDOW, which begin at every STRIDE-th shingle of a document.
LONG, WINDOW, STRIDE = 24, 16, 8
PERMUTATIONS = 2
#: Public licence notices as they are found in files and pages.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-line": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
    "unlicense-text": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause-line": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


#: Templates by name, or a table of them (license_id, text): notices and whole licences alike.
Templates = dict[str, str] | DataFrame


def templates(spark: SparkSession, texts: Templates = TEMPLATES) -> DataFrame:
    if isinstance(texts, DataFrame):
        return texts.select("license_id", "text").where("license_id IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in texts.items()])
    return spark.range(1).select(F.inline(rows))


def none() -> Column:
    return F.array().cast("array<bigint>")


def with_shingles(df: DataFrame) -> DataFrame:
    """Column sh, the hashes of all runs of five words of column text in order, instead of it; fewer words have none."""
    words = df.withColumn("_w", item_words(F.col("text"))).drop("text")
    hashed = words.withColumn("_h", word_hashes(F.col("_w"))).withColumn("_n", F.size("_w") - SHINGLE).drop("_w")
    runs = F.transform(F.sequence(F.lit(0), F.col("_n")), lambda i: run_hash(F.col("_h"), i, SHINGLE))
    return hashed.withColumn("sh", F.when(F.col("_n") >= 0, runs).otherwise(none())).drop("_h", "_n")


def bands(df: DataFrame, stride: int) -> DataFrame:
    """df with column bands: the keys of the windows of column sh that begin at every stride-th shingle, cut at the end."""
    names = [f"_p{p}" for p in range(PERMUTATIONS)]
    for p, name in enumerate(names):
        df = df.withColumn(name, F.transform("sh", lambda x: F.xxhash64(x, F.lit(p))) if p else F.col("sh"))  # noqa: B023
    starts = F.sequence(F.lit(1), F.greatest(F.size("sh"), F.lit(1)), F.lit(stride))

    def keys(start: Column) -> Column:
        cut = [F.slice(F.col(name), start, F.lit(WINDOW)) for name in names]
        return F.array(*[F.xxhash64(F.lit(2 * p + side), end(c)) for p, c in enumerate(cut) for side, end in enumerate((F.array_min, F.array_max))])

    found = F.when(F.size("sh") > 0, F.flatten(F.transform(starts, keys))).otherwise(none())
    return df.withColumn("bands", found).drop(*names)


def shingle_index(spark: SparkSession, texts: Templates = TEMPLATES) -> DataFrame:
    """license_id, m (its distinct shingles), key and idx, the shingle's number."""
    t = with_shingles(templates(spark, texts)).withColumn("sh", F.array_distinct("sh")).withColumn("m", F.size("sh"))
    return t.select("license_id", "m", F.posexplode("sh").alias("idx", "key"))


def band_index(spark: SparkSession, texts: Templates = TEMPLATES) -> DataFrame:
    """key and license_id of all windows of the templates: bands of the long ones, shingles of the short ones."""
    t = bands(with_shingles(templates(spark, texts)), 1)
    return t.select("license_id", F.explode(F.when(F.size("sh") >= LONG, F.col("bands")).otherwise(F.col("sh"))).alias("key")).distinct()


def candidates(docs: DataFrame, texts: Templates = TEMPLATES) -> DataFrame:
    """_d, _t and ids: the templates that share a band with a document of this doc_id and hash of its text."""
    spark = docs.sparkSession
    base = bands(with_shingles(docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")), STRIDE)
    rows = base.select("doc_id", "_text", F.explode(F.concat("sh", "bands")).alias("key"))
    found = rows.join(maybe_broadcast(materialise(band_index(spark, texts), "bands")), "key")
    return found.groupBy(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).agg(F.collect_set("license_id").alias("ids"))


def scan_licenses(docs: DataFrame, texts: Templates = TEMPLATES) -> DataFrame:
    """A row for each document and template of which at least three quarters of the shingles occur in the document.

    Null, empty and shorter texts have no shingles and no rows. Repeated rows give rows each; a null doc_id is kept.
    first_word is the position of the first word that belongs to the template. Further columns are ignored. A table of
    templates may hold whole licences; its license_id is unique, and its index is broadcast only if it is small.
    """
    known = maybe_broadcast(materialise(candidates(docs, texts), "candidates"))
    here = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text")
    here = here.join(known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t"))).drop("_d", "_t")
    # a first row without a shingle for each row of docs, then its shingles
    keys = F.concat(F.array(F.lit(None).cast("long")), F.col("sh"))
    rows = with_shingles(here).select("doc_id", "_text", "ids", F.posexplode(keys).alias("at", "key"))
    index = maybe_broadcast(shingle_index(docs.sparkSession, texts).withColumnRenamed("key", "_key"))
    found = rows.join(index, F.col("key") == F.col("_key"), "left").where((F.col("at") == 0) | F.array_contains("ids", F.col("license_id")))
    each = F.when(F.col("at") == 0, F.col("ids")).otherwise(F.array("license_id"))
    found = found.select("doc_id", "_text", "at", "idx", "m", F.explode(each).alias("license_id"))
    by = found.groupBy("doc_id", "_text", "license_id").agg(
        F.count_if(F.col("at") == 0).alias("copies"),
        F.max("m").cast("long").alias("n_shingles"),
        F.size(F.collect_set("idx")).cast("long").alias("n_found"),
        F.min(F.when(F.col("at") > 0, F.col("at") - 1)).cast("long").alias("first_word"),
    )
    by = by.where(100 * F.col("n_found") >= CONTAINMENT_PERCENT * F.col("n_shingles"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    return by.select("doc_id", "license_id", "n_shingles", "n_found", "first_word", each).drop("_copy")
