"""License scans by diagonal voting, in DataFrame functions.

Every rolling word k-gram of every text is joined by its hash with the k-grams of known
templates (and compared word by word, so a hash never decides alone). A hit at word p of
the text and word q of the template lies on diagonal p - q; hits are counted by diagonal.

* Phrases (``PHRASES``, k = 2): a diagonal that has all of a phrase's k-grams is a place where
  its words stand consecutively.
* Notices and license paragraphs (``NOTICES``, ``BODIES``, k = 4): words put in or left out shift the
  diagonal, so diagonals of one template at most ``NEIGHBOUR`` apart are merged; the merged span
  is verified by the share of the template's k-grams it holds, at least ``COVERAGE``. A template may be of any length.

The templates' k-grams are a table of fixed size (some 1,300 rows), which is broadcast; the texts' k-grams
are never shuffled, only the counts by (text, template, diagonal), and those rows are few.

Words: A-Z lower-cased, then maximal runs of digits, a-z and characters beyond ASCII.

Defined results: null and empty texts have no word and no label; equal rows get equal
results (hits are keyed by id and text); a null id is a key like any other.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskflow.llm import common

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The opening or core sentence of well-known public license notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under the gnu general public license version 3": "gpl",
}

# Paragraphs of the whole license texts, in their order, with their labels.
BODIES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.": "mit",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.": "isc",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.": "apache",
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl",
    "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.": "gpl",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.": "gpl",
    "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program, to make sure it remains free software for all its users.": "gpl",
    "You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.": "lgpl",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.": "unlicense",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.": "zlib",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.": "zlib",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": "zlib",
}
TEMPLATES = {**NOTICES, **BODIES}

NEIGHBOUR = 3
COVERAGE = 0.6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text. ``lower`` is the quick way where no other capital turns into a-z."""
    odd = text.contains("K") | text.contains("İ")
    lowered = F.when(odd, common.ascii_lower(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, NOT_WORD, -1), "")


def template_table(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per template k-gram: as many as the templates have words, whatever the corpus."""
    rows = []
    for number, (text, label, k) in enumerate([(t, lab, 2) for t, lab in phrases.items()]
                                              + [(t, lab, 4) for t, lab in notices.items()]):
        parts = [w for w in re.split(NOT_WORD, text.lower()) if w]
        n = len(parts) - k + 1
        if n < 1:
            raise ValueError(f"a template of fewer than {k} words: {text!r}")
        for q in range(n):
            rows.append((number, label, k, n, q, *parts[q:q + 4], *[None] * (4 - len(parts[q:q + 4]))))
    schema = "template int, label string, k int, n int, q int, t0 string, t1 string, t2 string, t3 string"
    return spark.createDataFrame(rows, schema).withColumn("h", F.xxhash64("t0", "t1"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = TEMPLATES) -> DataFrame:
    """Verified spans in (key, text): key, label, base (a whole phrase), first, last word, score."""
    spark = docs.sparkSession
    w = docs.select("key", words(F.col("text")).alias("w"))
    shifted = lambda i: F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0)))
    grams = (w.select("key", F.posexplode(F.arrays_zip(F.col("w").alias("a"), shifted(1).alias("b"), shifted(2).alias("c"),
                                                       shifted(3).alias("d"))).alias("p", "g"))
             .select("key", "p", "g.a", "g.b", "g.c", "g.d").withColumn("h", F.xxhash64("a", "b")))
    t = F.broadcast(template_table(spark, phrases, notices))
    same = ((grams["h"] == t["h"]) & (grams["a"] == t["t0"]) & (grams["b"] == t["t1"])
            & ((t["k"] == 2) | ((grams["c"] == t["t2"]) & (grams["d"] == t["t3"]))))
    votes = (grams.join(t, same).groupBy("key", "template", "label", "k", "n", (F.col("p") - F.col("q")).alias("diagonal"))
             .agg(F.collect_set("q").alias("at")))
    # Neighbouring diagonals of a notice are one occurrence; a phrase has its own diagonal.
    line = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("k") == 2, 0).otherwise(NEIGHBOUR), F.lit(True))
    span = ["key", "template", "label", "k", "n", "place"]
    hits = (votes.withColumn("new", apart.cast("int"))
            .withColumn("place", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
            .select(*span, "diagonal", F.explode("at").alias("q")))
    # One row per template position that the span holds, however many diagonals hold it.
    held = hits.groupBy(*span, "q").agg(F.min("diagonal").alias("d0"), F.max("diagonal").alias("d1"))
    merged = held.groupBy(*span).agg((F.count("*") / F.col("n")).alias("score"), F.min(F.col("d0") + F.col("q")).alias("first"),
                                     F.max(F.col("d1") + F.col("q")).alias("end"))
    return (merged.filter(F.when(F.col("k") == 2, F.col("score") == 1).otherwise(F.col("score") >= COVERAGE))
            .select("key", "label", (F.col("k") == 2).alias("base"), F.col("first").cast("long").alias("first"),
                    (F.col("end") + F.col("k") - 1).cast("long").alias("last"), "score"))


def label_documents(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per (doc_id, text): counts, places and labels."""
    keyed = common.id_and_text(docs).withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256)))
    base = F.col("base")
    found = (scan(keyed, phrases, notices).distinct().groupBy("key").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("score").alias("score")))
    sized = keyed.select("doc_id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return (sized.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score")))


def op6_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``; one row per document."""
    return label_documents(common.id_and_text(common.table(spark, sf_dir, "documents")))
