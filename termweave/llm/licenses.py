"""License scan by canonical digests, in DataFrame functions only.

Texts are normalised once (case, copyright lines, equivalent spellings, punctuation, white space) and hashed; whole
texts, and each whole line of them, are joined to the digests of known licences and notices. The digest table is
normalised by the same expressions, so a text and its registry entry always agree.

Defined cases: a null text counts as the empty one, which is no licence. Repeated rows, and rows that share a doc_id,
stay, each with the findings of its own text. Where two licences have one digest the first by name counts. Very long
texts are scanned whole. Other columns of the input stay out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The registry is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000

#: Texts of short licences, and the notices by which texts name longer ones.
MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_AS_IS = (
    '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
BSD_2 = _BSD + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS " + _AS_IS
BSD_3 = (
    _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS " + _AS_IS
)
ZERO_BSD = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution."
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
LICENCES: tuple[tuple[str, str], ...] = (
    ("BSD-2-Clause", BSD_2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_2),
    ("BSD-3-Clause", BSD_3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD_3),
    ("0BSD", ZERO_BSD),
    ("0BSD", "BSD Zero Clause License\n" + ZERO_BSD),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Unlicense", UNLICENSE),
    ("Unlicense", UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"),
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Proprietary", "All rights reserved."),
)
#: Spellings that count as the same.
SAME: tuple[tuple[str, str], ...] = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("organisation", "organization"), ("authorisation", "authorization"),
    ("favour", "favor"), ("honour", "honor"), ("fulfil ", "fulfill "), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("https:", "http:"),
)
#: A line that is a copyright statement (RE2 and Java agree on it).
COPYRIGHT = r"(?m)^[^a-z0-9\n©(]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|\(c\)[ \t]*(?:copyright|[0-9])|©)[^\n]*$"
SPACED = r"[^\p{L}\p{N}\n]+"


def normal_lines(text: Column) -> Column:
    """The text with line breaks kept and all else normalised."""
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    for a, b in SAME:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(x, SPACED, " "), r"(?m)^ | $", "")


def whole(lines: Column) -> Column:
    """Normalised lines as one: breaks become spaces."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def registry(spark: SparkSession, licences: Sequence[tuple[str, str]] = LICENCES) -> DataFrame:
    """digest, license: one row for each digest; of several licences with one digest the first by name."""
    rows = spark.createDataFrame(list(licences), "license string, text string")
    rows = rows.select("license", whole(normal_lines(F.col("text"))).alias("n")).where("n <> ''")
    return rows.groupBy(F.sha2("n", 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the whole normalised text), license (whose whole text it is, else null), line_licenses (of whole lines, sorted, joined by commas, else null)."""
    spark = docs.sparkSession
    known = registry(spark) if known is None else known
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = F.broadcast(known) if small else known
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", normal_lines(F.col("text")).alias("lines"))
    each = F.transform(F.filter(F.split("lines", "\n"), lambda x: x != ""), lambda x: F.struct(F.lit(False).alias("whole"), F.sha2(x, 256).alias("digest")))
    all_ = F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.sha2(whole(F.col("lines")), 256).alias("digest"))), each)
    found = rows.select("row", "doc_id", F.explode(all_).alias("x")).select("row", "doc_id", "x.whole", "x.digest").join(known, "digest", "left")
    found = found.where(F.col("whole") | F.col("license").isNotNull()).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))).alias("lines"),
    )
    return found.select("doc_id", "digest", "license", F.when(F.size("lines") > 0, F.array_join("lines", ",")).alias("line_licenses"))


def oracle(licences: Sequence[tuple[str, str]] = LICENCES) -> str:
    """The same over a table documents, for DuckDB."""

    def q(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        x = f"regexp_replace(lower(coalesce({x}, '')), {q(COPYRIGHT)}, '', 'g')"
        for a, b in SAME:
            x = f"replace({x}, {q(a)}, {q(b)})"
        return f"regexp_replace(regexp_replace({x}, {q(SPACED)}, ' ', 'g'), '(?m)^ | $', '', 'g')"

    def one(x: str) -> str:
        return f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'), ' ')"

    values = ", ".join(f"({q(k)}, {q(t)})" for k, t in licences)
    return f"""
    WITH known AS (SELECT sha256(n) AS digest, min(license) AS license FROM (SELECT license, {one(lines("text"))} AS n FROM (VALUES {values}) AS v(license, text)) WHERE n <> '' GROUP BY 1),
    rows_ AS (SELECT row_number() OVER () AS r, doc_id, {lines("text")} AS lines FROM documents),
    split_ AS (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM rows_),
    found AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM (SELECT r, sha256(line) AS digest FROM split_ WHERE line <> '') JOIN known USING (digest) GROUP BY r)
    SELECT t.doc_id, t.digest, k.license, f.line_licenses FROM (SELECT r, doc_id, sha256({one("lines")}) AS digest FROM rows_) t
    LEFT JOIN known k ON t.digest = k.digest LEFT JOIN found f ON t.r = f.r"""
