"""Licence scans: TF-IDF cosine of notices and licence files to templates, then inheritance along
directories.

A notice is compared at several widths, since it may be one line of a text or wrapped over many:
each line with a word of licensing, the lines around such lines within their paragraph, and
neighbouring paragraphs with such words as one. A text that is mostly notices, or whose path names
a licence file, is also compared whole. Each of these is a sparse term vector joined with those of
the templates. A document without a notice of its own takes the licence of the nearest directory
above it that has a licence file. All of it is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import cut, let, word_count
from chronoloom.operators.lookup import lookup_join

# Public notices of common licences.
_GNU = (
    "{0}: you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
    "the Free Software Foundation, either version {2} of the License, or (at your option) any "
    "later version."
)
_GNU_FILE = (
    "GNU {0} Version {1}, {2} Copyright (C) {3} Free Software Foundation, Inc. Everyone is "
    "permitted to copy and distribute verbatim copies of this license document, but changing it "
    "is not allowed."
)
_GPL, _LGPL = "General Public License", "Lesser General Public License"
_AGPL = "Affero General Public License"
_BSD_CONDITIONS = (
    "Copyright. All rights reserved. Redistribution and use in source and binary forms, with or "
    "without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS '
    "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
    "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
    'software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
    "to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
    "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    (
        "Apache-2.0",
        _APACHE + "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under "
        "the License.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND "
        "CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT_GRANT),
    ("MIT", "MIT License Copyright (c) " + _MIT_GRANT + _MIT_REST),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("This program is free software", _GPL, "2")),
    ("GPL-2.0", _GNU_FILE.format("GENERAL PUBLIC LICENSE", "2", "June 1991", "1989, 1991")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("This program is free software", _GPL, "3")),
    ("GPL-3.0", _GNU_FILE.format("GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007")),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format("This library is free software", _LGPL, "2.1")),
    ("LGPL-2.1", _GNU.format("This program is free software", _LGPL, "2.1")),
    (
        "LGPL-2.1",
        _GNU_FILE.format("LESSER GENERAL PUBLIC LICENSE", "2.1", "February 1999", "1991, 1999"),
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("This library is free software", _LGPL, "3")),
    ("LGPL-3.0", _GNU.format("This program is free software", _LGPL, "3")),
    ("LGPL-3.0", _GNU_FILE.format("LESSER GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007")),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("This program is free software", _AGPL, "3")),
    (
        "AGPL-3.0",
        _GNU_FILE.format("AFFERO GENERAL PUBLIC LICENSE", "3", "19 November 2007", "2007"),
    ),
    ("MPL-2.0", _MPL),
    (
        "MPL-2.0",
        _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("proprietary", "Copyright. All rights reserved."),
)
NOTICE = r"(?i)licen[sc]|copyright|spdx|all rights reserved|permission|redistribut|public domain"
BLANK = r"(?md)^[^\p{L}\p{N}\n]*+$"
LONG_LINE = r"(?md)^.{201,}+$"
TERM = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"
LEAST_COSINE = 0.6
# The best licence must lead any other by this much, or the notice names none.
LEAST_LEAD = 0.005
# Lines of a paragraph that go with a line of licensing, before and after it.
REACH = 3
# A text is compared whole if paragraphs of licensing are this share of its characters, or by name.
WHOLE_SHARE = 0.5
# A document is its directory's licence file when notices that name a licence are this share of its
# words, or by name.
FILE_SHARE = 0.2
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _ancestors(directory: Column) -> Column:
    """The directory and all above it, up to the empty root."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")
    )


def _around(parts: Column, reach: int, mark: str) -> Column:
    """The parts with a word of licensing and ``reach`` parts around them, as texts: those that
    touch are one text, joined by ``mark``; parts alone are left out."""

    def joined(all_parts: Column, marked: Column) -> Column:
        apart = 2 * reach + 1
        firsts = F.filter(
            marked, lambda m, n: (n == 0) | (m - F.get(marked, n - 1) > apart)
        )
        lasts = F.filter(
            marked, lambda m, n: (n == F.size(marked) - 1) | (F.get(marked, n + 1) - m > apart)
        )

        def text(first: Column, last: Column) -> Column:
            start = F.greatest(first - reach, F.lit(1))
            end = F.least(last + reach, F.size(all_parts))
            return F.array_join(F.slice(all_parts, start, end - start + 1), mark)

        return F.filter(F.zip_with(firsts, lasts, text), lambda x: x.contains(mark))

    return let(
        parts,
        lambda p: let(
            F.filter(
                F.sequence(F.lit(1), F.size(p)), lambda n: F.element_at(p, n).rlike(NOTICE)
            ),
            lambda marked: joined(p, marked),
        ),
    )


def _units(body: Column, path: Column) -> Column:
    """Array of (width, text): what of a text is compared."""
    # A line without a letter or a digit, as between comment marks, parts paragraphs; a line too
    # long to be a wrapped one is a paragraph.
    spaced = F.regexp_replace(F.regexp_replace(body, BLANK, ""), LONG_LINE, "\n$0\n")
    paragraphs = F.split(spaced, "\n{2,}")

    def labelled(width: str, texts: Column) -> Column:
        return F.transform(texts, lambda x: F.struct(F.lit(width).alias("width"), x.alias("text")))

    def parts(every: Column) -> Column:
        marked = F.filter(every, lambda x: x.rlike(NOTICE))
        lines = F.filter(
            F.flatten(F.transform(marked, lambda x: F.split(x, "\n"))), lambda x: x.rlike(NOTICE)
        )
        runs = F.flatten(F.transform(marked, lambda x: _around(F.split(x, "\n"), REACH, "\n")))
        size = F.aggregate(marked, F.lit(0), lambda total, x: total + F.length(x))
        whole = F.when(
            path.rlike(FILE_NAME) | (size >= WHOLE_SHARE * F.length(body)), F.array(body)
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(
            labelled("line", lines),
            labelled("run", runs),
            labelled("stretch", _around(every, 0, "\n\n")),
            labelled("whole", whole),
        )

    return let(paragraphs, parts)


def _matched(units: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(row, width, licence, score, words): the licence that each unit names, for units (row, unit,
    width, text). A unit names the licence of its best template, if that reaches LEAST_COSINE and
    leads those of other licences by LEAST_LEAD."""
    spark = units.sparkSession
    counted = cut(
        units.select("row", "unit", "width", F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("row", "unit", "width", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    known = counted.groupBy(F.col("term").alias("df_term")).agg(F.count(F.lit(1)).alias("df"))
    n_units = units.count()

    def weighted(rows: DataFrame) -> DataFrame:
        idf = F.log((1.0 + F.lit(n_units)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
        return lookup_join(rows, known, {"term": "df_term"}).withColumn(
            "weight", (1.0 + F.log("tf")) * idf
        )

    own = weighted(counted).select("row", "unit", "width", "term", "tf", "weight")
    given = spark.createDataFrame(
        [(n, name, text) for n, (name, text) in enumerate(templates)],
        "template int, licence string, text string",
    )
    wanted = weighted(
        given.select("template", "licence", F.explode(_terms(F.col("text"))).alias("term"))
        .groupBy("template", "licence", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("template")))
    unit = wanted.select(
        "template", "licence", F.col("term").alias("same"), (F.col("weight") / length).alias("share")
    )
    lengths = own.groupBy("row", "unit", "width").agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"), F.sum("tf").alias("words")
    )
    # The templates are a constant of this module, so their few hundred terms may be sent around.
    dots = (
        own.join(F.broadcast(unit), F.col("term") == F.col("same"))
        .groupBy("row", "unit", "template", "licence")
        .agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
        .groupBy("row", "unit", "licence")
        .agg(F.max("dot").alias("dot"))
    )
    # At most one entry per licence of the templates.
    ranked = dots.groupBy("row", "unit").agg(
        F.sort_array(F.collect_list(F.struct("dot", "licence")), asc=False).alias("ranked")
    )
    score, second = (
        F.round(F.get("ranked", F.lit(n))["dot"] / F.col("length"), 9) for n in (0, 1)
    )
    return (
        ranked.join(lengths, ["row", "unit"])
        .filter((score >= LEAST_COSINE) & (score - F.coalesce(second, F.lit(0.0)) >= LEAST_LEAD))
        .select("row", "width", F.get("ranked", F.lit(0))["licence"].alias("licence"), score.alias("score"), "words")
    )


def scanned(
    docs: DataFrame,
    path: Column,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per document: doc_id, path, own_licence, score, inherited_licence, inherited_from,
    licence.

    ``path`` gives each document's slash-separated place. ``own_licence`` is the best match over
    all notices of the whole text at all widths, ties by name; ``licence`` is that or the inherited
    one. A notice that fits two licences alike names none. Where a directory has several licence
    files the most frequent licence counts, ties by name. Defined cases: a null text has no notice;
    comment marks and the places of line breaks do not count; a null path is the root's; repeated
    rows and equal ids are documents of their own; other columns are ignored; an empty table gives
    an empty table.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.coalesce(path, F.lit("")).alias("path"),
            F.when(body.rlike(NOTICE), _units(body, F.coalesce(path, F.lit("")))).alias("units"),
            F.when(body.rlike(NOTICE), word_count(body)).alias("n_words"),
        )
    )
    units = base.select("row", F.posexplode("units").alias("unit", "of")).select(
        "row", "unit", "of.width", "of.text"
    )
    first = F.max_by(F.struct("licence", "score"), F.struct(F.col("score"), F.col("licence")))
    own = (
        _matched(units, templates)
        .groupBy("row", "width")
        .agg(first.alias("best"), F.sum("words").alias("words"))
        # Widths overlap, so the words of the widest reading count.
        .groupBy("row")
        .agg(F.max_by("best", F.struct("best.score", "best.licence")).alias("best"), F.max("words").alias("words"))
        .select(F.col("row").alias("of_row"), F.col("best.licence").alias("own_licence"), "best.score", "words")
    )
    judged = cut(
        base.drop("units").join(own, F.col("row") == F.col("of_row"), "left").withColumn(
            "directory", _directory(F.col("path"))
        )
    )
    is_file = F.col("own_licence").isNotNull() & (
        (F.col("words") >= FILE_SHARE * F.col("n_words")) | F.col("path").rlike(FILE_NAME)
    )
    per_directory = (
        judged.filter(is_file)
        .groupBy("directory", "own_licence")
        .agg(F.count(F.lit(1)).alias("files"))
        .groupBy(F.col("directory").alias("owner"))
        .agg(
            F.min_by("own_licence", F.struct(-F.col("files"), F.col("own_licence"))).alias("licence")
        )
    )
    above = judged.select("directory").distinct().select(
        F.col("directory").alias("place"), F.posexplode(_ancestors(F.col("directory"))).alias("depth", "up")
    )
    inherited = (
        above.join(per_directory, F.col("up") == F.col("owner"))
        .groupBy("place")
        .agg(F.max_by(F.struct("licence", "up"), "depth").alias("from"))
        .select(
            "place",
            F.col("from.licence").alias("inherited_licence"),
            F.col("from.up").alias("inherited_from"),
        )
    )
    return lookup_join(judged, inherited, {"directory": "place"}).select(
        "doc_id",
        "path",
        "own_licence",
        "score",
        "inherited_licence",
        "inherited_from",
        F.coalesce("own_licence", "inherited_licence").alias("licence"),
    )
