"""License scans by canonical digest lookup (operator 4).

A text is normalised - lower case, copyright lines removed, punctuation and blanks
collapsed, equivalent spellings unified word by word - and hashed with SHA-256; the
digest of the entire text is hash-joined to the digests of known licences.  Known
licences are a table (license_id, text), normalised and hashed by the same expression;
``known_licenses`` makes one of the short licences below under their usual headings,
and longer ones are added as rows.  Texts that carry a licence notice as a line of their
own are scanned line by line with the same normal form and a literal table of notices.
DataFrame functions only, one pass over the texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm.common import cut_lineage, doc_frame

#: One-line notices by SPDX licence id.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License."],
}

#: The usual headings of licences, the empty one included.
HEADINGS = {
    "0BSD": ["", "BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["", "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["", "BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"],
    "ISC": ["", "ISC License", "The ISC License"],
    "MIT": ["", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "Unlicense": ["", "The Unlicense"],
    "Zlib": ["", "zlib License", "The zlib License"],
}

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Whole licences by SPDX id, without headings and copyright lines.
LICENSES = {
    "0BSD": _PERMISSION + "." + _AUTHOR_AS_IS,
    "BSD-2-Clause": _BSD + _BSD_AS_IS,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_AS_IS,
    "ISC": _PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies." + _AUTHOR_AS_IS,
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

#: Equivalent spellings, applied in order to whole lower-case words.
SPELLINGS = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("recognise", "recognize"), ("favour", "favor"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent")]

#: A line that starts with a copyright mark; lines end with a line feed.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$"
NOT_WORD = "[^a-z0-9\u0080-\U0010ffff]+"

#: Words stand between two blanks each while spellings are replaced, so that a word's blanks are its own.
_SPACED = [(" " + old.replace(" ", "  ") + " ", " " + new.replace(" ", "  ") + " ") for old, new in SPELLINGS]


def normalise(text: str) -> str:
    """The normal form of a text, as ``normal_form`` gives it."""
    out = re.sub(NOT_WORD, " ", re.sub(COPYRIGHT_LINE, "", text.lower())).strip(" ")
    out = " " + out.replace(" ", "  ") + " "
    for old, new in _SPACED:
        out = out.replace(old, new)
    return out.replace("  ", " ").strip(" ")


def normal_form(text: Column) -> Column:
    """Lower case, no copyright lines, runs of punctuation and blanks as one blank, unified spellings."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE.replace("(?m)", "(?md)"), "")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    out = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for old, new in _SPACED:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """SHA-256 of a text's normal form."""
    return F.sha2(normal_form(text).cast("binary"), 256)


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the whole licences under each of their headings, and of the notices."""
    whole = [(name, f"{heading}\n\n{text}") for name, text in LICENSES.items() for heading in HEADINGS[name]]
    return whole + [(name, line) for name, lines in NOTICES.items() for line in lines]


def known_licenses(spark: SparkSession) -> DataFrame:
    """The licences of this module as a table (license_id, text)."""
    return spark.createDataFrame(known_texts(), "license_id string, text string")


def license_scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_digest, license_id, line_licenses, n_license_lines) of every document.

    licenses: known licences and notices (license_id, text), those of ``known_licenses`` if none
    are given; of texts with one normal form the smallest id counts, and rows with a null
    are left out.  license_id: the licence that the entire text is, null if none.
    line_licenses: the sorted ids of the known texts that whole lines are, joined by commas,
    empty if none; lines with "licen" in them are looked up.  Null texts count as empty; repeated
    rows are returned as often as they occur; an empty table gives an empty result.

    Texts are read once and leave their digest and those of such lines; both are joined with
    the digests of the table.
    """
    known = licenses if licenses is not None else known_licenses(docs.sparkSession)
    known = cut_lineage(known.dropna(subset=["license_id", "text"]).groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id")))
    d = doc_frame(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # every spelling of the word for a licence has "licen" in it
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.lower(x).contains("licen")), digest)
    marked = d.select("doc_id", digest(F.col("text")).alias("text_digest"), F.when(F.lower("text").contains("licen"), lines).otherwise(F.array().cast("array<string>")).alias("lines"))
    rows = cut_lineage(marked.withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", F.explode("lines").alias("digest")).join(known, "digest").groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("line_licenses"), F.count(F.lit(1)).alias("n_license_lines"))
    whole = rows.join(known, F.col("text_digest") == F.col("digest"), "left").select("row", "doc_id", "text_digest", "license_id")
    return whole.join(found, "row", "left").select("doc_id", "text_digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"), F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"))
