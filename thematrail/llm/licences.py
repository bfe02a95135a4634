"""Licence scan by canonical digest lookup.

A text is brought to a canonical form in which copies of a licence agree however they are typed, and its digest is looked
up among the digests of known licences and notices. Whole texts are compared, never parts: a document is looked up as
it is, and so is each of its lines.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thematrail.functions import bound

from .store import written

# Public licence texts and common notices, by SPDX identifier.
LICENCES = {
    "0BSD": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute
it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
LICENCES["BSD-3-Clause"] = LICENCES["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED BY", """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY""", 1)
# Title lines that copies of these texts may start with.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License", "BSD 0-Clause License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense", "The Unlicense (Unlicense)"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
}
# Long texts lie in files that start with so many title lines; an appendix on how to apply them starts with the line that holds these words.
FILES = {
    "Apache-2.0": (3, "APPENDIX: How to apply"), "CC0-1.0": (2, None), "GPL-2.0": (2, "How to Apply These Terms"), "GPL-3.0": (2, "How to Apply These Terms"),
    "LGPL-2.1": (2, "How to Apply These Terms"), "LGPL-3.0": (2, None), "MPL-2.0": (2, "Exhibit A - "),
}
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
]

# Spellings that count as one, as patterns on the canonical form, with strings of which a match holds one.
SPELLINGS = [
    (r"\b(?:(sub|un) ?)?licen[cs](e|es|ed|ing|ee|ees|able)\b", "$1licens$2", ["licen"]),
    (r"\b([a-z]{3,})is(e|es|ed|ing|ation|ations)\b", "$1iz$2", ["ise", "ising", "isation"]),
    (r"\b(hon|fav|lab|col)our", "$1or", ["our"]),
    (r"\bwhilst\b", "while", ["whilst"]),
    (r"\bper cent\b", "percent", ["per cent"]),
    (r"\b(acknowledg|judg)ement", "$1ment", ["gement"]),
    (r"\bcopyright owner", "copyright holder", ["copyright owner"]),
    (r"\bnon (commercial|infringement|exclusive)", "non$1", ["non "]),
    (r"\b(program|catalog|analog)(me|ue)(s?)\b", "$1$3", ["program", "catalog", "analog"]),
    (r"\bhttps?( www)?\b", "http", ["http"]),
]

# A copyright statement at the start of a line, on lower case: the mark and years, then the holder up to the end of the sentence or
# line or up to the words of a notice. A bare word "copyright" needs years right after it, or a short holder and a year that ends the statement.
_YEARS = r"[0-9]{4}(?:[ \t]*(?:,|-|–|—|to|and)[ \t]*(?:[0-9]{4}|[0-9]{2}|present|now)\b)*+[.,]?"
_NOTICE = r"(?:(?:and |is |are )?(?:dual[- ])?(?:licen[cs]ed|released|distributed|published|provided)|permission|redistribution|this|all rights reserved)\b"
_MARK = rf"(?:(?:copyright[ \t]*(?:\(c\)|©)|©|(?:copyright|\(c\))[ \t:,]*(?:by[ \t]+)?(?={_YEARS}))[ \t:,]*(?:{_YEARS})?|copyright[ \t:]+[^\n.;]{{1,80}}?[ \t,.]+{_YEARS}(?=[ \t.;]*(?:$|{_NOTICE})))"
_ABBREVIATED = r"(?<!\b(?:\p{L}|inc|ltd|corp|co|llc|jr|sr|dr|st|prof|al))"
# Groups repeat possessively: Java goes through such a loop without recursion, so the number of years or statements on a line is not bounded
# by the stack. Runs of punctuation or blanks are entered at their beginning only, so a long run is not searched again from each of its places.
_RUN = "[.,;:–-]"
_BEFORE = rf"(?:(?<!{_RUN}){_RUN}++[ \t]++|(?<![ \t.,;:–-])[ \t]++)(?={_NOTICE})"
_END = rf"(?:{_RUN}*+[ \t]++(?={_NOTICE})|[^\n]*?(?:$|{_BEFORE}|{_ABBREVIATED}[.;](?=[ \t]+[^ \t\n])))"
_STATEMENT = rf"(?m)^[^\n\p{{L}}]*(?:{_MARK}{_END}[ \t]*(?:all rights reserved\b[.,;!]*[ \t]*)?)++"
_RESERVED = r"(?m)^[^\n\p{L}]*all rights reserved[^\n\p{L}]*$"


def _where(value: Column, signs: list[str], pattern: str, one: str) -> Column:
    """Replace a pattern; texts without any of the signs hold no match and skip the search. The text is worked out once."""
    def replaced(v: Column) -> Column:
        some = reduce(lambda a, b: a | b, [F.contains(v, F.lit(s)) for s in signs])
        return F.when(some, F.regexp_replace(v, pattern, one)).otherwise(v)

    return bound(value, replaced)


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, blank ones left out.

    Lower case; copyright statements at the start of a line and lines that only reserve all rights are dropped, what follows a statement
    stays; whatever is no letter or digit becomes a single space; equivalent spellings become one.
    """
    value = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    value = _where(value, ["copyright", "(c)", "©"], _STATEMENT, "")
    value = _where(value, ["all rights reserved"], _RESERVED, "")
    value = F.regexp_replace(value, r"[^\p{L}\p{N}\n]+", " ")
    for pattern, one, signs in SPELLINGS:
        value = _where(value, signs, pattern, one)
    return F.filter(F.transform(F.split(value, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def canonical_digest(lines: Column) -> Column:
    """SHA-256 of canonical lines, however the text was broken into lines."""
    return F.sha2(F.array_join(lines, " "), 256)


def licence_texts() -> list[tuple[str, str]]:
    """(licence, text) of every known text: with each of its titles and without, with and without its appendix."""
    found = [(name, f"{title}\n{text}") for name, text in LICENCES.items() for title in ["", *TITLES[name]]]
    for name, (titles, appendix) in FILES.items():
        lines = [x for x in (Path(__file__).parent / "licence_texts" / name).read_text("utf-8").splitlines() if x.strip()]
        ends = [len(lines)]
        if appendix:
            at = next(i for i, x in enumerate(lines) if appendix in x)
            ends += [at, at - 1] if "END OF TERMS" in lines[at - 1] else [at]
        found += [(name, "\n".join(lines[start:end])) for start in (0, titles) for end in ends]
    return found


def known_digests(spark: SparkSession, licences: DataFrame | None = None) -> DataFrame:
    """(known, licence) for (licence, text) rows; by default the licences and notices of this module."""
    if licences is None:
        licences = spark.createDataFrame([*licence_texts(), *NOTICES], "licence string, text string")
    return licences.select(canonical_digest(canonical_lines(F.col("text"))).alias("known"), "licence").groupBy("known").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, licences: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_digest, licence, notices, n_notices) of every document.

    ``licence`` is the known licence or notice that the whole text is, else null; ``notices`` are the licences, sorted and joined
    by commas, of the lines that are a known licence or notice (empty if none), ``n_notices`` the number of such
    lines. Null and empty texts have the digest of the empty text and no licence. Repeated rows are scanned each,
    also with equal or null ids; other columns are left out; an empty table gives none.

    Known digests are a library that does not grow with the documents; they are joined by a hash join left to Spark.
    Only lines that are found are ever grouped.
    """
    known = known_digests(docs.sparkSession, licences)
    digests = bound(
        canonical_lines(F.col(text)),
        lambda lines: F.struct(canonical_digest(lines).alias("whole"), F.transform(lines, lambda x: F.unhex(F.sha2(x, 256))).alias("lines")),
    )
    rows = docs.select(F.col(doc_id).alias("doc_id"), digests.alias("d"))
    rows = written(rows.select("doc_id", F.col("d.whole").alias("text_digest"), F.col("d.lines").alias("lines")), "line-digests")
    found = rows.select("doc_id", "text_digest", F.posexplode("lines").alias("at", "line"))
    found = found.withColumn("known", F.lower(F.hex("line"))).drop("line").join(known, "known").dropDuplicates(["doc_id", "text_digest", "at"])
    found = found.groupBy("doc_id", "text_digest").agg(
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("notices"), F.count(F.lit(1)).alias("n_notices")
    )
    found = found.select(F.col("doc_id").alias("of"), F.col("text_digest").alias("of_digest"), "notices", "n_notices")
    whole = rows.drop("lines").join(known, F.col("text_digest") == F.col("known"), "left").drop("known")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_digest") == F.col("of_digest"))
    return whole.join(found, same, "left").select(
        "doc_id", "text_digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0).cast("bigint")).alias("n_notices")
    )
