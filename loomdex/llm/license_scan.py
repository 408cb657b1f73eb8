"""License scan in DataFrame functions alone.

Three kinds of unit are compared with the templates: lines that speak of a licence and blocks of comment lines that do (a file's
headers), and of files named as licences the whole text and each of its paragraphs.  Units and templates are
sparse TF-IDF vectors, whose document frequencies are counted over all units of the corpus and all templates; the template of the best cosine
over ``at_least`` is the unit's, and the best unit's is the file's own licence.  A file named as a licence, or of whose characters matched
lines make up at least ``share``, is a licence file and rules its directory.  A file without a licence of its own inherits
from the nearest ancestor directory that has one, by equi-joins on the path's ancestors.

Main path: no Python on the executors.  The text is parsed once; its units, short next to it, are written and read from then on.  Equal
units are compared once, by the md5 of their text.  Terms are counted by (unit, term) and joined with the template terms (a fixed table).

Defined cases: null text has no units; a null path has no directory, inherits nothing and isn't named as a licence; equal scores
take the template that comes first by name; several licence files of a directory count by their best score,
then name; a very long line or text is one unit, whose terms are counted in many tasks; repeated rows give repeated rows; an empty table
gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.plans.lineage import cut

#: Licence names and the words that headers and licence files state them with.
STATEMENTS = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Whole licence texts and headers of several lines.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU_NAMES = (
    ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
    ("GPL-2.0", "General Public License", "2", "June 1991"),
    ("GPL-3.0", "General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"),
)
TEXTS = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
)
#: Every template: statements, texts, the GNU licences' headers and titles, and an SPDX line for each name.
TEMPLATES = (
    *STATEMENTS,
    *TEXTS,
    *((spdx, _GNU.format(name=name, version=version)) for spdx, name, version, _ in _GNU_NAMES),
    *((spdx, f"GNU {name} Version {version}, {date}") for spdx, name, version, date in _GNU_NAMES),
    *((name, f"SPDX-License-Identifier: {name}{way}") for name in sorted({n for n, _ in STATEMENTS} | {n for n, *_ in _GNU_NAMES}) for way in (("", "-only", "-or-later") if "GPL" in name else ("",))),
)
NAMED = r"(?i)(^|/)(licen[sc]e|unlicense|copying|notice)([.-][a-z0-9.-]+)?$"
SPEAKS = r"(?i)licen[sc]e|copyright|public domain|permission is hereby|SPDX"
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--)"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Stands between blocks of comment lines while they are told apart.
MARK = "\x01"
SALTS = 16


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _counted(units: DataFrame, *keys: str) -> DataFrame:
    """``(keys, term, tf)`` of ``units(keys, unit)``."""
    return units.select(*keys, F.explode(terms_of(F.col("unit"))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def units_of(path: Column, text: Column) -> Column:
    """Array of ``(kind, unit)``: 0 for lines that speak of a licence, 1 for comment blocks, whole licence files and their paragraphs."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    mine = F.filter(lines, lambda x: x.rlike(SPEAKS))
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(COMMENT), x).otherwise(F.lit(MARK))), "\n")
    several = F.filter(F.split(marked, MARK), lambda b: b.rlike(SPEAKS) & F.contains(F.btrim(b, F.lit("\n")), F.lit("\n")))
    none = F.array().cast("array<string>")
    blocks = F.when(F.exists(mine, lambda x: x.rlike(COMMENT)), several).otherwise(none)
    whole = F.when(path.rlike(NAMED) & text.isNotNull(), F.concat(F.array(text), F.split(text, r"\n\s*\n"))).otherwise(none)

    def kind(k: int, units: Column) -> Column:
        return F.transform(units, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("unit")))

    return F.concat(kind(0, mine), kind(1, blocks), kind(1, F.coalesce(whole, none)))


def matches(units: DataFrame, spark: SparkSession, at_least: float) -> DataFrame:
    """``(id, license, score)`` of the distinct ``units(id, unit, uses)`` whose best cosine reaches ``at_least``."""
    made = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, unit string")
    in_units, in_templates = cut(_counted(units, "id", "uses")), _counted(made, "template", "license")
    total = (units.agg(F.sum("uses")).head()[0] or 0) + len(TEMPLATES)  # one number
    df = in_units.select("term", "uses").union(in_templates.select("term", F.lit(1))).groupBy("term").agg(F.sum("uses").alias("df"))
    idf = df.select("term", F.ln(1 + F.lit(total) / F.col("df")).alias("idf"))
    weigh = F.col("tf") * F.col("idf")
    a = in_units.join(idf, "term").select("id", "term", weigh.alias("w"))
    b = in_templates.join(idf, "term").select("template", "license", "term", weigh.alias("v"))
    long_a = a.groupBy("id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    long_b = b.groupBy("template").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("length"))
    dots = a.join(F.broadcast(b), "term").groupBy("id", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dots.join(long_a, "id").join(F.broadcast(long_b), "template").select("id", "license", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9).alias("score"))
    best = cosine.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    return best.select("id", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score")).filter(F.col("score") >= at_least)


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, the root ("") last; null for a null path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(files: DataFrame, at_least: float = 0.6, share: float = 0.8) -> DataFrame:
    """``(doc_id, path, license, score, origin, directory)`` of ``files(doc_id, path, text)``.

    ``origin`` is "own", "inherited" or null; ``directory`` the one inherited from.
    """
    spark = files.sparkSession
    text = F.col("text").cast("string")
    base = cut(files.select("doc_id", "path", F.coalesce(F.length(text), F.lit(0)).alias("size"), units_of(F.col("path"), text).alias("units")))
    speaking = base.filter(F.size("units") > 0)
    distinct = speaking.select(F.explode("units.unit").alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("uses"))
    known = matches(cut(distinct.withColumn("id", F.md5("unit"))), spark, at_least)
    # what a file's units make of it depends on its path, size and units alone; ids may repeat
    keyed = speaking.withColumn("key", F.struct("path", "size", F.md5(F.array_join(F.transform("units", lambda u: F.md5(u["unit"])), "")).alias("of_units")))
    each = keyed.select("key", "units").dropDuplicates(["key"]).select("key", F.explode("units").alias("u")).select("key", "u.kind", F.length("u.unit").alias("long"), F.md5("u.unit").alias("id"))
    spoken = each.join(known, "id")
    own = spoken.groupBy("key").agg(F.sum(F.when(F.col("kind") == 0, F.col("long")).otherwise(0)).alias("stated"), F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b"))
    own = cut(own.select("key", "stated", F.col("b.license").alias("own"), (-F.col("b.minus")).alias("own_score")))
    ruling = (
        own.filter((F.col("key.path").rlike(NAMED) | (F.col("stated") >= share * F.col("key.size"))) & F.col("key.path").isNotNull())
        .groupBy(F.element_at(ancestors(F.col("key.path")), 1).alias("directory"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("minus"), F.col("own").alias("license"))).alias("b"))
        .select("directory", F.col("b.license").alias("dir_license"), (-F.col("b.minus")).alias("dir_score"))
    )
    # directories, not files, look their ancestors up
    here = F.element_at(ancestors(F.col("path")), 1)
    above = base.filter("path IS NOT NULL").select(here.alias("at"), ancestors(F.col("path")).alias("up")).distinct()
    found = above.select("at", F.posexplode("up").alias("steps", "directory")).join(ruling, "directory")
    nearest = found.groupBy("at").agg(F.min(F.struct("steps", "directory", "dir_license", "dir_score")).alias("n")).select("at", "n.*")
    # files without units need no look-up of their own licence; a directory may hold a third of all files, so its row is
    # there ``SALTS`` times and its files are dealt over them
    silent = base.filter(F.size("units") == 0).select("doc_id", "path", F.lit(None).cast("string").alias("own"), F.lit(None).cast("double").alias("own_score"))
    judged = keyed.join(own, "key", "left").select("doc_id", "path", "own", "own_score").union(silent)
    dealt = judged.withColumns({"at": here, "_salt": F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int")})
    nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(nearest, ["at", "_salt"], "left").select(
        "doc_id",
        "path",
        F.coalesce("own", "dir_license").alias("license"),
        F.coalesce("own_score", "dir_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("own").isNull(), F.col("directory")).alias("directory"),
    )


def document_path(source: Column, lang: Column, doc_id: Column) -> Column:
    """The place of a ``documents`` row in a tree of sources and languages."""
    return F.concat_ws("/", source, lang, F.concat(doc_id.cast("string"), F.lit(".txt")))
