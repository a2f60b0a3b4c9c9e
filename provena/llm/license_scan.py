"""License scan by diagonal voting.

One pass over the texts emits the hash of every rolling k-gram of words with its place. Spark joins them to the places
of the same k-grams in the templates; each hit votes for the diagonal ``place - template place``. Votes are counted by
document, template and diagonal; neighbouring diagonals (a word or two inserted or dropped) are merged into one span,
and a span is verified by the share of the template's words that its hits cover. Phrases need all their words in
place, that is one diagonal that all their k-grams vote for.

Notices are a table (label, text) of any length, whole licence texts among them; NOTICES is the default. They are
broadcast only if their counted k-grams are few, else the hits are joined by shuffles. A notice of fewer than k words
is never found. Null text is empty text: no words, no labels, score 0. Rows are told apart by position, so repeated
rows and null ids keep a result each. Empty tables give empty results, no notices only phrases; notices with null or
empty text are left out, and of a null label the label is empty. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm import kernels
from provena.llm.common import small, written

K = 3
# Phrases and the labels they stand for.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices, whole texts of short licences among them, and the labels they stand for.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_SOURCE_BINARY = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
NOTICES = [
    ("mit", "released under the MIT License"),
    ("mit", _GRANT),
    ("mit", _GRANT + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", _REDISTRIBUTION),
    ("bsd-2", f"{_REDISTRIBUTION}: {_SOURCE_BINARY} {_AS_IS}"),
    ("bsd-3", f"{_REDISTRIBUTION}: {_SOURCE_BINARY} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "this work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]
#: Diagonals this near belong to one span; the share of a template's words that a verified span covers.
NEAR, COVER = 2, 0.75

_OUT = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("pos", pa.int32()), ("h", pa.int64())])


def _grams(k: int):
    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, texts in kernels.blocks(batch.column("text")):
                w = kernels.Words(texts, kernels.ALNUM)
                counts = np.diff(w.first)
                rids = rid + np.arange(b - a)
                rid += b - a
                nulls = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rids), ids.slice(a, b - a), pa.array(counts), nulls.cast(pa.int32()), nulls], schema=_OUT)
                grams = w.windows(k)
                owner = np.repeat(np.arange(b - a), counts)[: len(grams)]
                pos = np.arange(len(grams)) - w.first[owner]
                whole = pos + k <= counts[owner]
                n = int(whole.sum())
                nulls = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rids[owner[whole]]), nulls, nulls, pa.array(pos[whole].astype(np.int32)), pa.array(grams[whole].view(np.int64))], schema=_OUT)

    return kernels.frugal(run)


def _notices(k: int):
    def run(batches):
        for batch in batches:
            for a, b, texts in kernels.blocks(batch.column("text")):
                w = kernels.Words(texts, kernels.ALNUM)
                grams, counts = w.windows(k), np.diff(w.first)
                owner = np.repeat(np.arange(b - a), counts)[: len(grams)]
                pos = np.arange(len(grams)) - w.first[owner]
                whole = pos + k <= counts[owner]
                owner = owner[whole]
                columns = (batch.column(c).slice(a, b - a).take(pa.array(owner)) for c in ("t", "label", "phrase"))
                yield pa.RecordBatch.from_arrays([pa.array(grams[whole].view(np.int64)), *columns, pa.array(pos[whole].astype(np.int32)), pa.array((counts[owner] - k + 1).astype(np.int32))], names=["h", "t", "label", "phrase", "tpos", "grams"])

    return kernels.frugal(run)


def templates(spark: SparkSession, notices: DataFrame | None = None, k: int = K) -> DataFrame:
    """(h, t, label, phrase, tpos, grams): the k-grams of phrases and of the notices (label, text)."""
    fixed = spark.createDataFrame([(label, words, True) for words, label in PHRASES.items()], "label string, text string, phrase boolean")
    more = notices.select("label", "text") if notices is not None else spark.createDataFrame(NOTICES, "label string, text string")
    both = fixed.unionByName(more.select(F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), F.col("text").cast("string"), F.lit(False).alias("phrase")).distinct())
    both = written(both.select(F.monotonically_increasing_id().alias("t"), "label", "text", "phrase"), "notices")
    return written(both.mapInArrow(_notices(k), "h long, t long, label string, phrase boolean, tpos int, grams int"), "templates")


def scan(docs: DataFrame, notices: DataFrame | None = None, k: int = K, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """Per document doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best span's cover; 1 for a phrase)."""
    spark = docs.sparkSession
    known = templates(spark, notices, k)
    known = F.broadcast(known) if small(known, 64) else known
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    hits = docs.mapInArrow(_grams(k), "rid long, doc_id long, n_words long, pos int, h long").join(known, "h", "left")
    table = written(hits.where("n_words is not null or t is not null"), "hits")
    votes = table.where("t is not null").groupBy("rid", "t", "label", "phrase", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("at"))

    places = votes.where(F.col("phrase") & (F.size("at") == F.col("grams"))).groupBy("rid").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base"))

    by = Window.partitionBy("rid", "t").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > near, F.lit(True))
    merged = votes.where(~F.col("phrase")).withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(by))
    merged = merged.groupBy("rid", "t", "label", "grams", "span").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + k - 1)))))
    found = merged.withColumn("cover", covered / (F.col("grams") + k - 1)).where(F.col("cover") >= cover)
    found = found.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))

    none = F.array().cast("array<string>")
    base = F.coalesce("base", none)
    out = table.where("n_words is not null").select("rid", "doc_id", "n_words").join(places, "rid", "left").join(found, "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", none))), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"))
