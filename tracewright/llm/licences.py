"""Licence scans by canonical digest: whole texts, and single lines, whose canonical form has a known digest.

Canonical: lower case, without lines of copyright, equivalent spellings made one, everything but letters and digits as one blank. Every text gets
its digest and joins the known ones by hash. Single lines are tried as well, so that a notice inside a document is found; a licence of several lines inside a
longer text is out of the method. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices by SPDX identifier.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
KNOWN: list[tuple[str, str]] = [
    ("BSD-2-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_END])),
    ("BSD-2-Clause", "\n".join(["BSD 2-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_END])),
    ("BSD-3-Clause", "\n".join([_BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END])),
    ("BSD-3-Clause", "\n".join(["BSD 3-Clause License", _BSD_HEAD, _BSD_1, _BSD_2, _BSD_3, _BSD_END])),
    ("0BSD", _ISC.replace("provided that the above copyright notice and this permission notice appear in all copies", "").replace(", .", ".")),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("GPL-3.0-or-later", _GPL),
    ("GPL-2.0-or-later", _GPL.replace("version 3 of", "version 2 of")),
    ("LGPL-3.0-or-later", _GPL.replace("GNU General", "GNU Lesser General")),
    ("AGPL-3.0-or-later", _GPL.replace("GNU General", "GNU Affero General")),
    ("MPL-2.0", _MPL),
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *[(i, f"SPDX-License-Identifier: {i}") for i in ("MIT", "ISC", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0")],
]
# Spellings that mean the same.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("https", "http"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("authorise", "authorize"), ("copyright owner", "copyright holder")]
#: Lines that name the holder of a copyright, not lines of a sentence on copyright; what parts words.
COPYRIGHT = r"(?m)^[^\p{L}\n(]*(?:copyright[ \t]*(?:\(c\)|©|:|by |[<{0-9]|\[)|copr\.|(?:\(c\)|©)[ \t]*(?:copyright[ \t]*)?[0-9]|all rights reserved[^\p{L}\n]*$)[^\n]*$"
PARTS = r"[^\p{L}\p{N}]+"
#: The first two words of a line.
LEAD = r"[\p{L}\p{N}]+(?:[^\p{L}\p{N}]+[\p{L}\p{N}]+)?"
#: Most entries of a table of known texts; all of them are broadcast.
MOST = 10_000


def canonical(text: Column) -> Column:
    """The canonical form of a text: null for null, empty for texts without a letter or digit."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    t = F.btrim(F.regexp_replace(t, PARTS, " "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form of a text. Null for null; texts without a letter or digit share the digest of the empty text."""
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> tuple[dict[str, str], set[str]]:
    """Licence by canonical digest, for a table (license, text) of known texts or the ones above, and the leads of their canonical forms; of two licences with one digest the first by name.
    A table of more than MOST rows is refused."""
    known = spark.createDataFrame(KNOWN, "license string, text string") if known is None else known
    rows = known.where("license is not null").select(digest(F.col("text")).alias("d"), F.substring_index(canonical(F.col("text")), " ", 2).alias("lead"), "license").where("d is not null")
    rows = rows.groupBy("d").agg(F.min("license").alias("license"), F.min("lead").alias("lead")).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} known licence texts")
    return {r["d"]: r["license"] for r in rows}, {x for r in rows for x in spelled(r["lead"])}


def spelled(lead: str) -> set[str]:
    """The first two words that a line may have before spellings are made one, if these are the first two after it."""
    found = {lead}
    for _ in SPELLINGS:  # spellings may meet in one lead
        found |= {x.replace(b, a) for x in found for a, b in SPELLINGS}
    return {" ".join(x.split(" ")[:2]) for x in found} | {x.split(" ")[0] + " " + a.split(" ")[0] for x in found for a, b in SPELLINGS if " " in x and b.startswith(x.split(" ", 1)[1] + " ")}


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license, notices) for every row: the digest of the canonical whole text, the licence that it is, and the distinct
    licences of single lines, sorted and joined by commas. ``known`` is a table (license, text); without it the texts of this module count.

    digest is null for null texts, license is null unless the whole text is known, notices is null if no line is; lines are digested if they start with the first two words of a known text. The whole
    texts join the known digests by hash; the known table has a bounded size and is broadcast. Repeated rows get repeated results.
    """
    found, leads = known_digests(docs.sparkSession, known)
    table = docs.sparkSession.createDataFrame(sorted(found.items()), "known_digest string, license string")
    literal = F.create_map(*[F.lit(x) for kv in sorted(found.items()) for x in kv]) if found else F.create_map().cast("map<string,string>")
    text = F.col(text_col)
    lead = lambda x: F.regexp_replace(F.regexp_extract(F.lower(x), LEAD, 0), PARTS, " ")
    lines = F.filter(F.split(text, "\n"), lambda x: lead(x).isin(sorted(leads)))
    hits = F.filter(F.transform(lines, lambda x: F.try_element_at(literal, digest(x))), lambda x: x.isNotNull())
    notices = F.array_join(F.array_sort(F.array_distinct(hits)), ",")
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), F.nullif(notices, F.lit("")).alias("notices"))
    return rows.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license", "notices")


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def dig(x: str) -> str:
        t = f"trim(regexp_replace(regexp_replace(lower({x}), {q(COPYRIGHT)}, ' ', 'g'), {q(PARTS)}, ' ', 'g'), ' ')"
        for a, b in SPELLINGS:
            t = f"replace({t}, {q(a)}, {q(b)})"
        return f"sha256({t})"

    texts = ", ".join(f"({q(i)}, {q(t)})" for i, t in KNOWN)
    return f"""
WITH texts(license, t) AS (VALUES {texts}), known AS (SELECT {dig('t')} AS kd, min(license) AS license FROM texts GROUP BY 1),
d AS (SELECT doc_id, text, row_number() OVER () AS r FROM {table}),
l AS (SELECT r, {dig('line')} AS ld FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
n AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT r, license FROM l JOIN known ON ld = kd) GROUP BY r)
SELECT doc_id, digest, license, notices
FROM (SELECT doc_id, r, {dig('text')} AS digest FROM d) x LEFT JOIN known ON digest = kd LEFT JOIN n USING (r)"""
