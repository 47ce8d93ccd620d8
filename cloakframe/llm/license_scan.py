"""Licence scan: sparse TF-IDF cosine of headers and licence files to licence templates, then inheritance from the nearest directory.

Units of a whole text are compared: every line, every block (lines up to a blank one, joined, so that wrapped notices are whole), and
of a licence file all of it. Marks of comments before and behind a line don't count. Weights are tf * idf, idf from the number of texts
that hold a term: those of the templates are collected, the others of the units to score are joined. A unit's cosine to a template is
at most the norm of the part of the template whose terms it holds. So only units whose terms can make up such a part are scored, and
only texts that hold such terms are cut into units: the rest can't match.

A directory has the licence of its best licence file. A file without its own takes that of the nearest ancestor that has one,
found by joining its ancestors' paths with the directories.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import finished, stored

THRESHOLD = 0.7
TERM = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"
#: Bytes up to which the lines' other terms are broadcast; beyond, they are joined by a shuffle.
BROADCAST = 32 << 20
LICENCE_FILE = r"^(LICEN[CS]E|COPYING|NOTICE)(\..*)?$"
#: Marks of comments at a line's begin and end.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_AS_IS = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by "
    "the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
)
_GNU_REST = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details. You should have received a copy "
    "of the GNU {0} Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU_KINDS = (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
#: Notices, headers and whole texts by SPDX identifier; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", f"{_APACHE} {_APACHE_AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT),
    ("MIT", f"MIT License {_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    *((i, _GNU.format(kind, version)) for i, kind, version in _GNU_KINDS),
    *((i, f"{_GNU} {_GNU_REST}".format(kind, version)) for i, kind, version in _GNU_KINDS),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAME}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAME} {_BSD_AS_IS}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}"),
    ("ISC", _ISC),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def _python_terms(text: str) -> list[str]:
    import re

    return re.findall(TERM, text.lower())


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({t for _, text in templates for t in _python_terms(text)})


def idf(files: DataFrame, templates=TEMPLATES) -> tuple[dict[str, float], int]:
    """Of the templates' terms over all texts, and the number of texts. The templates bound what is collected."""
    words = vocabulary(templates)
    known = F.array(*[F.lit(w) for w in words])
    held = files.select(F.explode(F.array_intersect(terms(F.col("text")), known)).alias("term"))
    df = {x["term"]: x["n"] for x in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n = files.count()
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in words}, n


def other_weights(files: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """(term, other): idf over all n texts of the terms in found (term)."""
    held = files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    if found.count() * 64 <= BROADCAST:
        held = held.join(F.broadcast(found), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    else:
        held = held.groupBy("term").agg(F.count("*").alias("n")).join(found, "term", "left_semi")
    return held.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1).alias("other"))


def template_vectors(weights: dict[str, float], templates=TEMPLATES) -> list[dict[str, float]]:
    """Unit vectors."""
    out = []
    for _, text in templates:
        found = _python_terms(text)
        v = {t: found.count(t) * weights[t] for t in found}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({t: x / norm for t, x in v.items()})
    return out


def covered(terms: Column, vectors: list[dict[str, float]]) -> Column:
    """At least the largest share of a template's squared norm that lies in terms: each counts by its largest share in any template."""
    most = {t: max(v.get(t, 0.0) ** 2 for v in vectors) for t in sorted({t for v in vectors for t in v})}
    share = F.create_map(*[F.lit(x) for p in most.items() for x in p])
    return F.aggregate(F.array_intersect(terms, F.array(*map(F.lit, most))), F.lit(0.0), lambda sum_, t: sum_ + F.element_at(share, t))


def units(path: Column, text: Column) -> Column:
    """An array of what is compared with the templates: lines, blocks of several lines and, of a licence file, all."""
    bare = F.regexp_replace(text, COMMENT, "")
    blocks = F.filter(F.split(bare, r"\n\n+"), lambda b: F.contains(b, F.lit("\n")))
    whole = F.when(F.element_at(F.split(path, "/"), -1).rlike(LICENCE_FILE), F.array(bare)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.split(bare, r"\n+"), blocks, whole)


def declared(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(path, own, score): the best template of each file's units, where it reaches the threshold. Ties: the first identifier."""
    spark = files.sparkSession
    weights, n = idf(files, templates)
    vectors = template_vectors(weights, templates)
    # Less than the square by more than the scores are rounded.
    least = threshold * threshold - 1e-6
    # A text's terms are all that its units can hold: one with too few isn't cut.
    some = files.where(covered(terms(F.col("text")), vectors) >= least)
    lines = some.select("path", F.posexplode(units(F.col("path"), F.col("text"))).alias("line_no", "line")).withColumn("terms", terms(F.col("line")))
    lines = lines.where(covered(F.col("terms"), vectors) >= least).select("path", "line_no", F.explode("terms").alias("term"))
    tf = lines.groupBy("path", "line_no", "term").agg(F.count("*").alias("tf"))
    # A row for each term of each template: as many as the templates have words.
    rows = [(t, weights[t], i, k, v[t]) for k, ((i, _), v) in enumerate(zip(templates, vectors)) for t in v]
    template = spark.createDataFrame(rows, "term string, weight double, id string, template int, part double")
    weight = F.broadcast(template.select("term", "weight").distinct())
    tf = stored(tf.join(weight, "term", "left"), "terms")
    found = stored(tf.where("weight is null").select("term").distinct(), "other-terms")
    other = stored(other_weights(files, found, n), "other-weights")
    tf = tf.join(other, "term", "left").withColumn("w", F.col("tf") * F.coalesce("weight", "other")).drop("weight", "other")
    tf = stored(tf, "weighted")
    norm = tf.groupBy("path", "line_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tf.join(F.broadcast(template), "term").groupBy("path", "line_no", "template", "id").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    scored = dot.join(norm, ["path", "line_no"]).select("path", "id", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("path", "id").agg(F.max("score").alias("score"))
    return best.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("x")).select("path", F.col("x.id").alias("own"), (-F.col("x.s")).alias("score"))


def ancestors(path: Column) -> Column:
    """The directories above a path, the nearest first; the top one is the empty path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


@finished
def scan(files: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own, score, licence, inherited_from) for each row of files (doc_id, path, text; others are ignored).

    own and score: the file's best notice. licence: own, or the nearest ancestor directory's, which inherited_from names.
    Null and empty texts have no notice but inherit. A null path inherits nothing and its notices are not read. Rows that repeat a
    path share its best notice. Ties fall to the first identifier, of a directory's licence files to the best score. An empty
    table gives an empty result.
    """
    files = files.select("doc_id", "path", "text")
    own = stored(declared(files.where("path is not null").select("path", "text"), templates, threshold), "declared")
    name, folder = F.element_at(F.split("path", "/"), -1), F.element_at(ancestors(F.col("path")), 1)
    folders = own.where(name.rlike(LICENCE_FILE)).select(folder.alias("folder"), "own", "score")
    folders = folders.groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("s"), "own")).alias("x")).select("folder", F.col("x.own").alias("licence"))
    mine = own.select(F.col("path").alias("_path"), "own", "score")
    rows = files.select("doc_id", "path").join(mine, F.col("path") == F.col("_path"), "left").drop("_path")
    bare = rows.where("own is null and path is not null").select("path").distinct()
    above = bare.select("path", F.posexplode(ancestors(F.col("path"))).alias("steps", "folder")).join(stored(folders, "folders"), "folder")
    near = above.groupBy("path").agg(F.min(F.struct("steps", "folder", "licence")).alias("x")).select(F.col("path").alias("_path"), F.col("x.licence").alias("_licence"), F.col("x.folder").alias("_folder"))
    rows = rows.join(near, F.col("path") == F.col("_path"), "left")
    return rows.select("doc_id", "path", "own", "score", F.coalesce("own", "_licence").alias("licence"), F.when(F.col("own").isNull(), F.col("_folder")).alias("inherited_from"))


def path_of() -> Column:
    """A tree for documents: a folder for each source, 4096 and 64 ids; the first of each 64 is its folder's licence file."""
    i = F.col("doc_id")
    name = F.when(i % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), i, F.lit(".txt")))
    return F.concat_ws("/", F.coalesce("source", F.lit("-")), F.floor(i / 4096).cast("string"), F.floor(i / 64).cast("string"), name)


