"""License scans by canonical digest lookup, in DataFrame operations only.

A text is brought to a canonical form: lower case, lines that name the
holder taken out (a wrapped sentence of the terms that begins with "copyright" stays), equivalent spellings made one, punctuation and white space runs to one space.
Whole canonical texts are hashed and the digests joined with those of the known
licences. The scan does this for every whole document, and looks digests up in the
same table for every line and
every paragraph (lines between blank ones) of it, each as an entire text, so a
notice at the head or foot of a document is found as well as a licence file.

The known texts are constants of this module, their digests a table of as many
rows as there are texts, which bounds the broadcast. Texts stay where they are
read; nothing is shuffled.

Null and empty texts have no licence and a null digest. A text is read whole. A
licence found more than once counts once. Repeated rows give repeated rows; an
empty table gives an empty table; other columns are ignored. ``known`` may be
given more texts.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pairs of a spelling and the one it is made into, after punctuation and white space are single spaces.
SPELLINGS = [
    ("licence", "license"),
    (" sub license", " sublicense"),
    (" non infringement", " noninfringement"),
    (" non commercial", " noncommercial"),
    (" https ", " http "),
    (" version ", " v"),
    (" v ", " v"),
    (" per cent", " percent"),
    ("favour", "favor"),
    (" whilst ", " while "),
    (" wilful", " willful"),
]
# Words that follow "copyright" in the terms themselves, where a line may begin with it by its wrapping.
TERMS = (
    "act acts and are as disclaimer doctrines for holder holders if in information infringement interest interests is law laws licence licences "
    "license licenses line lines notice notices of on or owner owners ownership permission permissions protection right rights statement statements "
    "that the therein to treaties treaty"
).split()
TERM = "([ \\t]+(" + "|".join(TERMS) + ")\\b)"
#: Lines that name the holder of the rights, not the terms: "copyright" with a sign, a year or a name; a sign with a year.
COPYRIGHT = (
    "^[ \\t#*/;-]*(copyright([ \\t]*(\\(c\\)|\u00a9|:|[0-9]{4})|[ \\t]+[\\p{L}<\\[])|\\(c\\)[ \\t]*[0-9]{4}|\u00a9|all rights reserved)[^\\n]*"
)
#: Stands before a "copyright" that belongs to the terms while such lines are taken out.
KEPT = "\u0001"
TERM_LINE = "^([ \\t#*/;-]*)(copyright" + TERM + ")"
#: A line that says only this names no holder: it is the licence, where nothing else is left of a text.
RESERVED = "all rights reserved"
RESERVED_SQL = "(?m)^[ \\t#*/;-]*" + RESERVED + "[^\\p{L}\\p{N}\\n]*$"
RESERVED_LINE = "(?dm)^[ \\t#*/;-]*" + RESERVED + "[^\\p{L}\\p{N}\\n]*$"
PARAGRAPH = "\\n([ \\t\\r]*\\n)+"

# Public licence texts and the notices that name a licence.
KNOWN = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        """MIT License

Copyright (c) year holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the 3-Clause BSD License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the 2-Clause BSD License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "all-rights-reserved": ["No part of this work may be reproduced without the permission of the author."],
}


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def whole_texts() -> dict[str, list[str]]:
    """Licence files in full; KNOWN has the notices and short texts."""
    out = {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    for name, title, body in (("BSD-2-Clause", "BSD 2-Clause License", _BSD + _BSD_END), ("BSD-3-Clause", "BSD 3-Clause License", _BSD + _BSD_3 + _BSD_END)):
        out[name] = [body, title + "\n\n" + body]
        out[name] += [t.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ") for t in out[name]]
    return out | {"all-rights-reserved": ["All rights reserved."]}


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; empty if nothing is left."""
    out = F.regexp_replace(F.lower(text), "(?dm)" + TERM_LINE, "$1" + KEPT + "$2")
    out = F.replace(F.regexp_replace(out, "(?dm)" + COPYRIGHT, " "), F.lit(KEPT), F.lit(""))
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def digest(text: Column) -> Column:
    """The digest of the canonical form; null if nothing is left."""
    canon = canonical(text)
    reserved = F.when(F.lower(text).rlike(RESERVED_LINE), F.lit(hashlib.sha256(RESERVED.encode()).hexdigest()))
    return F.when(F.length(canon) > 0, F.sha2(canon, 256)).otherwise(reserved)


def variants(text: str) -> list[str]:
    """A known text, and the same without its title where it begins with one."""
    title, _, rest = text.strip().partition("\n\n")
    return [text, rest] if len(rest) > 200 and len(title) < 80 else [text]


def known_rows(known: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    return [(name, v) for group in ([known] if known else [KNOWN, whole_texts()]) for name, texts in group.items() for text in texts for v in variants(text)]


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license): one row for each known text."""
    return spark.createDataFrame(known_rows(known), "license string, text string").select(digest(F.col("text")).alias("digest"), "license").where("digest is not null").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a document: id, text_digest, whole_license, licenses.

    ``whole_license`` is the licence that the whole text is (hash join on its
    digest), ``licenses`` those of the whole and of its lines and paragraphs,
    sorted, joined by a comma.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known)
    lookup = F.create_map(*[F.lit(x) for r in table.orderBy("digest").collect() for x in (r.digest, r.license)])  # as many as known texts
    text = F.col("_text")
    named = lambda unit: lookup[digest(unit)]
    parts = F.array_distinct(F.concat(F.split(text, "\n", -1), F.split(text, PARAGRAPH, -1)))
    parts = F.filter(parts, lambda x: x != text)  # the whole text is looked up by itself
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = slim.select("_id", digest(text).alias("text_digest"), F.transform(parts, named).alias("_parts"))
    rows = found.join(F.broadcast(table.withColumnsRenamed({"digest": "text_digest", "license": "whole_license"})), "text_digest", "left")
    every = F.filter(F.array_append(F.coalesce("_parts", F.array().cast("array<string>")), F.col("whole_license")), lambda x: x.isNotNull())
    return rows.select(F.col("_id").alias(id_col), "text_digest", "whole_license", F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("licenses"))


def oracle() -> str:
    """The scan as DuckDB SQL."""
    quote = lambda x: x.replace("'", "''")

    def canon(x: str) -> str:
        out = f"regexp_replace(lower({x}), '(?m){TERM_LINE}', '\\1' || chr(1) || '\\2', 'g')"
        out = f"replace(regexp_replace({out}, '(?m){COPYRIGHT}', ' ', 'g'), chr(1), '')"
        out = f"regexp_replace(' ' || {out} || ' ', '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"trim({out})"

    def told(x: str) -> str:
        return f"CASE WHEN {canon(x)} <> '' THEN sha256({canon(x)}) WHEN regexp_matches(lower({x}), '{RESERVED_SQL}') THEN sha256('{RESERVED}') END"

    rows = ", ".join(f"('{quote(n)}', '{quote(t)}')" for n, t in known_rows())
    return f"""
WITH k AS (SELECT DISTINCT {told('t')} AS digest, n AS license FROM (VALUES {rows}) v(n, t)),
w AS (SELECT doc_id, text, row_number() OVER () AS r, {told('text')} AS digest FROM documents),
u AS (SELECT r, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '{PARAGRAPH}'))) AS part FROM w WHERE text IS NOT NULL),
h AS (SELECT r, license FROM (SELECT r, {told('part')} AS digest FROM u) x JOIN k USING (digest)
  UNION SELECT r, license FROM w JOIN k USING (digest)),
g AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM h GROUP BY r)
SELECT w.doc_id, w.digest AS text_digest, k.license AS whole_license, coalesce(g.licenses, '') AS licenses
FROM w LEFT JOIN k USING (digest) LEFT JOIN g ON g.r = w.r
"""
