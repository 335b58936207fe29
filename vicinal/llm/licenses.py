"""Licence scans by canonical digest lookup, in SQL functions alone."""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of short licences and usual notices, as their owners publish them.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD_GRANT = _ISC_GRANT.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB_GRANT = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
KNOWN_LICENSES: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License\n\n" + _MIT_GRANT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("ISC", "ISC License\n\n" + _ISC_GRANT),
    ("ISC", _ISC_GRANT),
    ("0BSD", "BSD Zero Clause License\n\n" + _ZERO_BSD_GRANT),
    ("0BSD", _ZERO_BSD_GRANT),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-2-Clause", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_CONDITIONS + _BSD_NAMES + _BSD_DISCLAIMER),
    ("Zlib", "zlib License\n\n" + _ZLIB_GRANT),
    ("Zlib", _ZLIB_GRANT),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

# Spellings that licence matching guidelines hold to be equal.
EQUIVALENT: tuple[tuple[str, str], ...] = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noninfringement", "non infringement"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("https", "http"),
)

#: A line that only names the owner, with a sign or a year; a broken line that goes on with the word "copyright" counts.
OWNER_LINE = r"(?im)^[ \t*#/;-]*(copyright([ \t:]*(\(c\)|©|by[ \t])|[^\n]*[0-9]{4})|\(c\)[ \t]*(copyright|[0-9])|©)[^\n]*$|^[ \t*#/;-]*all rights reserved\.?[ \t]*$"


def canonical(text: Column) -> Column:
    """Lower case, without owner lines, each run of other characters one blank, and one spelling of each word."""
    out = F.lower(F.regexp_replace(text, OWNER_LINE, " "))
    # Two blanks between words: each word has both of its own, also beside one that was replaced.
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for other, word in EQUIVALENT:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {word} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def canonical_text(text: str) -> str:
    """What ``canonical`` makes of a text, for the table of known licences."""
    out = re.sub(OWNER_LINE, " ", text).lower()
    out = " " + re.sub(r"[\W_]+", "  ", out).strip() + " "
    for other, word in EQUIVALENT:
        out = out.replace(f" {other} ", f" {word} ")
    return out.replace("  ", " ").strip()


@functools.cache
def known_digests(known: tuple[tuple[str, str], ...] = KNOWN_LICENSES) -> dict[str, str]:
    return {hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in known}


def scan_licenses(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] = KNOWN_LICENSES) -> DataFrame:
    """doc_id, digest, license of the entire text, notices: licences of its entire lines.

    The canonical digest of each entire text meets the table of known licences
    in a hash join; that table is a constant of this module, so it is
    broadcast.  Entire lines that speak of a licence are looked up in the same
    table.  Null or wordless texts have no digest and no licence; repeated rows
    are scanned one by one.  Other columns of ``docs`` are left out.
    """
    table = known_digests(known)
    licenses = spark.createDataFrame(sorted(table.items()), "known_digest string, license string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    mapping = F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])
    lines = F.filter(F.split("text", "\n"), lambda line: F.contains(F.lower(line), F.lit("licen")))
    names = F.transform(lines, lambda line: F.try_element_at(mapping, F.sha2(canonical(line), 256)))
    whole = F.when(canonical(F.col("text")) != "", F.sha2(canonical(F.col("text")), 256))
    found = rows.select(
        "doc_id",
        whole.alias("digest"),
        F.when(F.contains(F.lower("text"), F.lit("licen")), F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>")).alias("notices"),
    )
    return found.join(F.broadcast(licenses), F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license", F.concat_ws(",", F.coalesce("notices", F.array().cast("array<string>"))).alias("notices"))


def oracle_op9(known: tuple[tuple[str, str], ...] = KNOWN_LICENSES) -> str:
    """SQL for the rows of ``scan_licenses`` over ``documents``."""

    def form(text: str) -> str:
        out = f"' ' || trim(regexp_replace(lower(regexp_replace({text}, '{OWNER_LINE}', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
        for other, word in EQUIVALENT:
            out = f"replace({out}, ' {other} ', ' {word} ')"
        return f"trim(replace({out}, '  ', ' '))"

    rows = ", ".join(f"('{digest}', '{name}')" for digest, name in sorted(known_digests(known).items()))
    return f"""WITH known(known_digest, name) AS (VALUES {rows}),
t AS (SELECT doc_id, {form('text')} AS c FROM documents),
w AS (SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM t),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'licen')),
n AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices FROM (SELECT doc_id, sha256({form('line')}) AS d FROM l) JOIN known ON d = known_digest GROUP BY doc_id)
SELECT w.doc_id, w.digest, name AS license, coalesce(notices, '') AS notices FROM w LEFT JOIN known ON digest = known_digest LEFT JOIN n ON n.doc_id = w.doc_id"""
