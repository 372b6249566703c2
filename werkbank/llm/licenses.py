"""License scans: exact phrases, and notices found by votes on offset diagonals."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from werkbank.llm.common import id_or_last, stored, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The phrases that make a base label, and wordings of public licence notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
               "in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
# The parts of whole public licences.
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
          "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
            "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
            "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
            "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
NOTICES += [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
            "notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("bsd", _BSD + _BSD_END),
    ("bsd", _BSD + _BSD_NAME + _BSD_END),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
            "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
            "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
            "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
            "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
             "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated "
             "but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
             "the original software. This notice may not be removed or altered from any source distribution."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
                  "purpose, commercial or non-commercial, and by any means."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
               "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
               "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
               "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
               "governing permissions and limitations under the License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
            "You should have received a copy of the GNU General Public License along with this program."),
]
#: Words of a hashed run, diagonals that are one, and the share of a notice and of a span that must agree.
RUN, SLACK, SHARE = 3, 3, 0.8
#: A-Z become small; what is no digit, a-z or beyond ASCII becomes a space.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(KEPT).split()


def run_hashes(numbers: np.ndarray, size: int, base: int) -> np.ndarray:
    """A rolling hash of each run of ``size`` word numbers below ``base``: the run written in that base. As it fits in 64
    bits, equal hashes are equal words, so a hit of a run is verified word by word."""
    if base ** size >= 2 ** 63:
        raise ValueError("the notices have too many different words")
    n = max(0, len(numbers) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(base) + numbers[i:i + n]
    return out.view(np.int64)


def numbering(phrases: dict[str, str], notices: list[tuple[str, str]]) -> dict[bytes, int]:
    """A number from 1 for each word of the phrases and notices."""
    known = {w for text in [*phrases, *(t for _, t in notices)] for w in words(text.encode())}
    return {w: i + 1 for i, w in enumerate(sorted(known))}


def coded(text: str, number: dict[bytes, int]) -> np.ndarray:
    return np.array([number[w] for w in words(text.encode())], np.uint64)


def scan_words(docs: DataFrame, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """Per row: its key, ``n_words``, ``bases`` (label and word of each phrase found) and ``hits`` (word and
    hash of each run of words that occurs in a notice)."""
    number = numbering(phrases, notices)
    runs = np.unique(np.concatenate([np.empty(0, np.int64), *(run_hashes(coded(t, number), RUN, len(number) + 1) for _, t in notices)]))
    exact = [(coded(p, number), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bases, hits = [], [], []
            for text in batch.column(2):
                found = words(text.as_py())
                codes = np.fromiter((number.get(w, 0) for w in found), np.uint64, len(found))
                places = []
                for phrase, label in exact:
                    at = np.flatnonzero(codes == phrase[0])
                    at = at[at <= len(codes) - len(phrase)]
                    for i in range(1, len(phrase)):
                        at = at[codes[at + i] == phrase[i]]
                    places += [{"label": label, "word": w} for w in at.tolist()]
                hashes = run_hashes(codes, RUN, len(number) + 1)
                known = np.flatnonzero(codes != 0)
                known = known[known < len(hashes)]  # a run of a notice begins with a word of a notice
                at = known[np.isin(hashes[known], runs)]
                sizes.append(len(found))
                bases.append(places)
                hits.append([{"word": w, "run": h} for w, h in zip(at.tolist(), hashes[at].tolist())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()),
                 pa.array(bases, schema.field("bases").type), pa.array(hits, schema.field("hits").type)], schema=schema)

    schema = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("bases", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                        ("hits", pa.list_(pa.struct([("word", pa.int64()), ("run", pa.int64())])))])
    rows = docs.select(id_or_last().alias("doc"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"),
                       F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "doc long, mark long, doc_id long, n_words long, bases array<struct<label string, word long>>, "
                                "hits array<struct<word long, run long>>")


def notice_spans(scanned: DataFrame, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """``doc``, ``mark``, ``label``, ``first``, ``last`` and ``agreed`` of every verified span.

    Each hit votes for the diagonal (its word less the notice's word) of every notice that has its run, and votes are
    summed by diagonal. A span is a diagonal, a diagonal with its neighbours (words left out or put in move the rest
    by a few), or a whole chain of diagonals at most ``SLACK`` apart; it holds if the words agreed on make ``SHARE`` of
    the notice and of the span. So a phrase that is repeated beside a notice makes a chain that fails, and the notice is found
    by its own diagonal. Of spans of a notice that overlap, the one that agrees most stays."""
    spark, number, rows = scanned.sparkSession, numbering(phrases, notices), []
    for i, (label, text) in enumerate(notices):
        codes = coded(text, number)
        rows += [(h, i, label, place, len(codes)) for place, h in enumerate(run_hashes(codes, RUN, len(number) + 1).tolist())]
    places = spark.createDataFrame(rows, "run long, notice int, label string, place int, size int")
    hits = scanned.select("doc", "mark", F.inline("hits")).distinct()
    votes = (hits.join(F.broadcast(places), "run")  # the words of the notices, a fixed list
             .groupBy("doc", "mark", "notice", "label", "size", (F.col("word") - F.col("place")).alias("diagonal"))
             .agg(F.min("word").alias("first"), (F.max("word") + RUN - 1).alias("last"), F.collect_set("place").alias("places")))
    per_notice = Window.partitionBy("doc", "mark", "notice").orderBy("diagonal")
    near = per_notice.rangeBetween(-SLACK, SLACK)
    apart = F.col("diagonal") - F.lag("diagonal").over(per_notice) > SLACK
    votes = votes.withColumns({
        "chain": F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(per_notice),
        "near": F.struct(F.min("first").over(near).alias("first"), F.max("last").over(near).alias("last"), F.array_distinct(
            F.flatten(F.collect_list("places").over(near))).alias("places"))})
    named = ["doc", "mark", "notice", "label", "size"]
    chains = votes.groupBy(*named, "chain").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_distinct(
        F.flatten(F.collect_list("places"))).alias("places")).drop("chain")
    own = votes.select(*named, F.explode(F.array(F.struct("first", "last", "places"), F.col("near"))).alias("s")).select(*named, "s.*")
    agreed = F.size(F.array_distinct(F.flatten(F.transform("places", lambda x: F.sequence(x, x + RUN - 1)))))
    spans = own.unionByName(chains).withColumn("agreed", agreed / F.greatest("size", F.col("last") - F.col("first") + 1))
    spans = spans.where(F.col("agreed") >= SHARE).select(*named, "first", "last", "agreed").distinct()
    by_place = Window.partitionBy("doc", "mark", "notice").orderBy("first", "last")
    clear = F.col("first") > F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("part", F.sum(F.coalesce(clear, F.lit(False)).cast("int")).over(by_place))
    best = F.max_by(F.struct("first", "last", "agreed"), F.struct("agreed", F.col("last") - F.col("first"), -F.col("first")))
    return spans.groupBy("doc", "mark", "notice", "label", "part").agg(best.alias("s")).select("doc", "mark", "label", "s.*")


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None,
                 notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``bases`` (label and first word of each place of a phrase, words from 0),
    ``spans`` (label, first and last word, share agreed on, of each notice found) and ``labels`` (of both).

    Null and empty texts have no words and no labels. Repeated rows get equal results, rows without an id
    too. Very long texts are scanned whole, spans that agree equally are settled by length and place. Other columns are
    ignored; an empty table gives an empty result."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    scanned = stored(scan_words(docs, phrases, notices), "licenses")
    spans = notice_spans(scanned.where(F.size("hits") > 0), phrases, notices).groupBy("doc", "mark").agg(F.sort_array(
        F.collect_list(F.struct("first", "last", "label", "agreed"))).alias("spans"))
    none = F.array().cast("array<struct<first:long,last:long,label:string,agreed:double>>")
    rows = scanned.join(spans, ["doc", "mark"], "left").withColumn("spans", F.coalesce("spans", none))
    return rows.select("doc_id", "n_words", "bases", "spans", F.array_sort(F.array_distinct(F.concat(
        F.col("bases.label"), F.col("spans.label")))).alias("labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("bases").cast("long").alias("n_base"),
        F.array_min("bases.word").alias("first_word"), F.array_max("bases.word").alias("last_word"),
        joined(F.col("bases.label")).alias("base_labels"), joined(F.col("labels")).alias("labels"),
        F.coalesce(F.array_max("spans.agreed"), F.lit(0.0)).alias("score"))
