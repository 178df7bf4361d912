"""Licence texts by canonical digest.

A text's canonical form has A-Z in lower case, copyright lines removed, punctuation,
symbols and white space as one space, and equivalent spellings made equal. Two licence
texts that differ only in these are the same text, so the digest of the whole canonical
text is looked up in a table of known digests with a hash join. Two kinds of whole texts
are looked up: each document, and each line of a document that is a notice by itself.

The known table is built from the texts below and by rule from licence names; it has a
few hundred rows whatever the input, so it is broadcast. Lines are matched before
anything is shuffled; only the notices found are gathered by document.

Defined results: a null, empty, or canonically empty text has the digest of an empty
text and no licence; a document with several notices lists all, sorted; rows of equal id
and text get equal results; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.llm.common import row_key

# ---------------------------------------------------------------------------
# Public licence texts and names
# ---------------------------------------------------------------------------
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and \
associated documentation files (the "Software"), to deal in the Software without restriction, including without \
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the \
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of \
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO \
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE \
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, \
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE \
SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee \
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
ZERO_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee \
is hereby granted."""
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS \
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR \
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR \
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH \
THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB_TEXT = """This software is provided 'as-is', without any express or implied warranty. In no event will the \
authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to \
alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. \
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is \
not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original \
software.
3. This notice may not be removed or altered from any source distribution."""
BSD_OPENING = """Redistribution and use in source and binary forms, with or without modification, are permitted \
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following \
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the \
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse \
or promote products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR \
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A \
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, \
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF \
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY \
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN \
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except \
in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on \
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the \
specific language governing permissions and limitations under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the \
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

WHOLE_TEXTS = [
    ("MIT", MIT_GRANT), ("MIT", "MIT License\n\n" + MIT_GRANT), ("MIT", "The MIT License (MIT)\n\n" + MIT_GRANT),
    ("ISC", f"{ISC_GRANT}\n\n{ISC_DISCLAIMER}"), ("ISC", f"ISC License\n\n{ISC_GRANT}\n\n{ISC_DISCLAIMER}"),
    ("0BSD", f"{ZERO_GRANT}\n\n{ISC_DISCLAIMER}"),
    ("0BSD", f"BSD Zero Clause License\n\n{ZERO_GRANT}\n\n{ISC_DISCLAIMER}"),
    ("Zlib", ZLIB_TEXT), ("Zlib", "zlib License\n\n" + ZLIB_TEXT),
    ("BSD-2-Clause", f"{BSD_OPENING}\n\n{BSD_DISCLAIMER}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_OPENING}\n\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_OPENING}\n\n{BSD_THIRD}\n\n{BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_OPENING}\n\n{BSD_THIRD}\n\n{BSD_DISCLAIMER}"),
    ("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER),
]
#: SPDX id, then names it goes by in one-line notices.
NAMES = [
    ("MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT", "Expat License"),
    ("Apache-2.0", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    ("GPL-3.0", "GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"),
    ("MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License", "New BSD License"),
    ("ISC", "ISC License"), ("Unlicense", "The Unlicense"),
    ("CC0-1.0", "CC0 1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
]
NOTICES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
           "Distributed under the {}", "Available under the {}", "This work is licensed under {}",
           "This work is licensed under the {}", "This file is licensed under the {}",
           "This software is licensed under the {}", "This project is licensed under the {}"]
#: Spellings made equal, in canonical text, in this order.
SPELLINGS = [("licence", "license"), ("licensor s", "licensors"), ("sub license", "sublicense"),
             ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"),
             ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"),
             ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"),
             ("per cent", "percent"), ("whilst", "while"), ("wilful", "willful"), ("merchantibility", "merchantability"),
             ("http www", "https www")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|©|\(c\)|all rights reserved)[^\n]*"
BREAKS = r"[\p{P}\p{S}\p{Z}\p{C}]+"


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text), from the fixed texts and by rule from the names."""
    out = list(WHOLE_TEXTS)
    for spdx, *names in NAMES:
        out += [(spdx, f"SPDX-License-Identifier: {spdx}{tail}") for tail in ("", "-only", "-or-later")]
        out += [(spdx, form.format(name)) for name in names for form in NOTICES]
        out += [(spdx, name) for name in names if "License" in name]  # a title line; "mit" alone is a German word
    return out


def canonical(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    bare = F.trim(F.regexp_replace(F.regexp_replace(low, COPYRIGHT_LINE, "$1"), BREAKS, " "))
    for old, new in SPELLINGS:
        bare = F.replace(bare, F.lit(old), F.lit(new))
    return bare


def known_digests(spark) -> DataFrame:
    """(digest, license_id) of the known texts, one row for each digest."""
    texts = spark.createDataFrame(known_texts(), "license_id string, text string")
    return (texts.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notices), one row for each document."""
    known = F.broadcast(known_digests(docs.sparkSession))
    rows = docs.select("doc_id", *row_key(), "text")
    whole = rows.select("doc_id", "doc_key", "text_key", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    lines = rows.select("doc_key", "text_key", F.explode(F.split("text", "\n")).alias("line"))
    notices = (lines.withColumn("digest", F.sha2(canonical(F.col("line")), 256)).join(known, "digest")
               .groupBy("doc_key", "text_key").agg(F.collect_set("license_id").alias("found")))
    return (whole.join(known, "digest", "left").join(notices, ["doc_key", "text_key"], "left")
            .select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id",
                    F.coalesce(F.array_join(F.array_sort("found"), ","), F.lit("")).alias("notices")))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(column: str) -> str:
    out = f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"trim(regexp_replace({out}, '{BREAKS}', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


ORACLE = f"""
WITH texts(license_id, text) AS (VALUES {', '.join(f'({_sql_text(i)}, {_sql_text(t)})' for i, t in known_texts())}
), known AS (
  SELECT sha256({_sql_canonical('text')}) AS digest, min(license_id) AS license_id FROM texts GROUP BY 1
), lines AS (
  SELECT doc_id, sha256({_sql_canonical('line')}) AS digest
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
), found AS (
  SELECT doc_id, string_agg(license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT DISTINCT doc_id, license_id FROM lines JOIN known USING (digest)) GROUP BY doc_id
), whole AS (SELECT doc_id, sha256({_sql_canonical('text')}) AS digest FROM documents)
SELECT doc_id, digest AS canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""
