"""Licence scans with a positional rare-token index, in DataFrame expressions only.

The index holds the positions of every template's words. IDF is counted over all documents. A document that holds a
template's mandatory key phrases looks up its own licence words of highest IDF, at most RARE of a template's; places in
the document and in the template that agree on their relative position gather, and a relative position at which LEAST
of the looked-up words meet is compared word for word. The share of the template's words that stand there is its score,
and a label needs LEAST of them. Exact places of the base phrases are counted beside it; their labels always stay.

The score of a document is that of its best template, 0 if none is found, whether or not it holds base phrases. The
index has a row for each word of the templates. Texts are cut to words once for the counts and once for the scan, whose
result is stored, so that a row keeps its number in both joins after it. Null text: empty. Every row is scanned by
itself, repeated ids and null ids too. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import words as W

RARE, LEAST = 8, 0.6
#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The wording of the licences and of their usual notices, as label, mandatory key phrases, text.
TEMPLATES = [
    ("mit", ["mit license"], "Released under the MIT License"),
    ("mit", ["permission is hereby granted", "without restriction"], """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", ["apache license"], "Licensed under the Apache License, Version 2.0"),
    ("apache", ["apache license", "limitations under the license"], """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", ["general public license"], "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", ["free software", "gnu general public license"], """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("lgpl", ["lesser general public license"], """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
        either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("agpl", ["affero general public license"], """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version."""),
    ("cc-by-nc", ["cc by nc"], "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", ["attribution noncommercial"], "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", ["attribution sharealike"], "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", ["redistribution and use in source and binary forms"], """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", ["permission to use copy modify and or distribute this software"], """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS."""),
    ("zlib", ["altered source versions"], """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""),
    ("mpl", ["mozilla public license"], """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    ("unlicense", ["released into the public domain"], """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("bsl", ["boost software license"], "Distributed under the Boost Software License, Version 1.0"),
]


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def places(w: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.greatest(F.size(w) - len(parts), F.lit(0)))
    return F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(w, i + j) == p, F.lit(False)) for j, p in enumerate(parts)]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, list[str], str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), W.words(F.col(text_col)).alias("w"))
    wording = [template_words(text) for _, _, text in templates]
    vocabulary = sorted({x for parts in wording for x in parts})
    of_licences = F.array_intersect(F.col("w"), strings(vocabulary))
    counts = texts.select(F.explode(of_licences).alias("word")).groupBy("word").count().collect()  # at most a row for each word of the templates
    df = {r["word"]: r["count"] for r in counts}
    rarest = lambda parts: sorted(set(parts), key=lambda x: (df.get(x, 0), x))
    index = [(k, x, p) for k, parts in enumerate(wording) for p, x in enumerate(parts)]
    index = F.broadcast(spark.createDataFrame(index, "template int, word string, at int"))

    nothing = F.array().cast("array<int>")
    licence_like = F.exists("w", lambda x: x == "license")
    starts = F.when(licence_like, F.struct(*[places(F.col("w"), p).alias(label) for p, label in BASE.items()])).otherwise(F.struct(*[nothing.alias(label) for label in BASE.values()]))
    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    texts = texts.withColumn("base", starts).withColumn("line", line)
    holds = [reduce(lambda a, b: a & b, [F.col("line").contains(f" {phrase} ") for phrase in phrases]) for _, phrases, _ in templates]
    # of each template whose key phrases are there: the document's own words of it, rarest first
    looked = F.array_compact(
        F.array(*[F.when(h, F.struct(F.lit(k).alias("template"), F.slice(F.array_intersect(strings(rarest(parts)), F.col("w")), 1, RARE).alias("rare"))) for k, (h, parts) in enumerate(zip(holds, wording, strict=True))])
    )
    texts = texts.withColumn("looked", looked)
    all_places = F.concat(*[F.col(f"base.{label}") for label in BASE.values()])
    texts = cut(
        texts.select(
            "row", "doc_id", F.size("w").cast("long").alias("n_words"), "looked", F.when(F.size("looked") > 0, F.col("w")).alias("w"), F.size(all_places).cast("long").alias("n_base"),
            F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
            F.array_compact(F.array(*[F.when(F.size(f"base.{label}") > 0, F.lit(label)) for label in BASE.values()])).alias("base_labels"),
        )
    )
    found = texts.where("size(looked) > 0").select("row", "w", F.explode("looked").alias("x")).select("row", "w", "x.template", "x.rare")
    hits = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("p"), x.alias("word"))), lambda s: F.array_contains("rare", s["word"]))
    rows = found.select("row", "template", F.size("rare").alias("of"), F.explode(hits).alias("x")).select("row", "template", "of", "x.p", "x.word")
    met = rows.join(index, ["template", "word"]).groupBy("row", "template", "of", (F.col("p") - F.col("at")).alias("shift")).agg(F.count_distinct("word").alias("many"))
    met = met.where(F.col("many") >= LEAST * F.col("of")).select("row", "template", "shift")
    text_of = reduce(lambda a, k: a.when(F.col("template") == k, strings(wording[k])), range(1, len(wording)), F.when(F.col("template") == 0, strings(wording[0])))
    compared = met.join(found.select("row", "template", "w"), ["row", "template"]).withColumn("t", text_of)
    same = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda j: F.coalesce(F.when(F.col("shift") + j >= 0, F.get("w", F.col("shift") + j)) == F.get("t", j), F.lit(False)))
    scored = compared.select("row", "template", (F.size(same) / F.size("t")).alias("share")).where(F.col("share") >= LEAST)
    names = strings([label for label, _, _ in templates])
    best = scored.groupBy("row").agg(F.max("share").alias("share"), F.collect_set(F.get(names, F.col("template"))).alias("found"))
    out = texts.drop("looked", "w").join(best, "row", "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"),
    )
