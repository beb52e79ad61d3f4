"""License scans by canonical digest: normalised whole texts are hash-joined to the digests of known licences.

All in DataFrame expressions. The canonical form lowers case, drops copyright lines, unifies equivalent spellings and
reduces everything but letters and digits to single spaces; two texts match if its SHA-256 is the same. Texts are
normalised once, line by line; the form of a whole text is that of its lines put together.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.llm.common import cut, picked

# Spellings that licence texts use for the same word, old and new, after case and punctuation are gone.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("emphasis", "emphasiz"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("initialis", "initializ"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"), ("organis", "organiz"), ("per cent", "percent"),
    ("programme", "program"), ("recognis", "recogniz"), ("sub license", "sublicense"), ("utilis", "utiliz"), ("whilst", "while"),
    ("copyright owner", "copyright holder"), ("https", "http"),
)
#: A copyright line: it begins with the sign, with (c) and has a year (else it is a list item), or with the word and then a sign, a year or what stands for one, or a
#: year ends it; sentences that go on with "copyright notice" or "copyright holders" are none, wherever they are wrapped.
COPYRIGHT = r"^[^\p{L}\p{N}\n]*(?:\(c\)[^\n]*(?:19|20)[0-9]{2}|©|all rights reserved|copyright[^\p{L}\p{N}\n]*(?:c\)|©|<|\[|\{|by |year|yyyy|[0-9]{4})|copyright [^\n]*(?:19|20)[0-9]{2}[^\p{L}\n]*$)[^\n]*$"

# Public licence texts, and the one-line notices that name a licence.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"
_APACHE_NOTICE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
#: Licence, the titles that its text may stand under, and the text; each is known under each title and without one.
TEXTS = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), f"{_MIT_GRANT}, subject to the following conditions:\n\n{_MIT_NOTICE}\n\n{_MIT_WARRANTY}"),
    ("MIT-0", ("MIT No Attribution", "MIT No Attribution License"), f"{_MIT_GRANT}.\n\n{_MIT_WARRANTY}"),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)"), f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"), f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"), f"{_BSD_GRANT}\n\n1. {_BSD_SOURCE}\n\n2. {_BSD_BINARY}\n\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", ("BSD 2-Clause License",), f"{_BSD_GRANT}\n\n* {_BSD_SOURCE}\n\n* {_BSD_BINARY}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License"), f"{_BSD_GRANT}\n\n1. {_BSD_SOURCE}\n\n2. {_BSD_BINARY}\n\n3. {_BSD_NAME}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", ("BSD 3-Clause License",), f"{_BSD_GRANT}\n\n* {_BSD_SOURCE}\n\n* {_BSD_BINARY}\n\n* {_BSD_NAME}\n\n{_BSD_WARRANTY}"),
    ("Zlib", ("zlib License", "The zlib/libpng License"), _ZLIB),
    ("Unlicense", (), _UNLICENSE),
    ("Apache-2.0", (), _APACHE_NOTICE),
    ("WTFPL", (), "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
)
#: One-line notices.
NOTICES = (
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "Licensed under CC0 1.0."),
)


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all known texts: TEXTS, NOTICES and the long ones in license_texts, which count without what follows their terms too."""
    found = [(name, "\n\n".join((*title, text))) for name, titles, text in TEXTS for title in [(), *((t,) for t in titles)]]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text, end = path.read_text(), "END OF TERMS AND CONDITIONS"
        found.append((path.stem, text))
        if end in text:
            found.append((path.stem, text[: text.index(end) + len(end)]))
    return [*found, *NOTICES]


def _lines_form(text: Column) -> Column:
    """The text with each line in canonical form but for spaces at its ends; copyright lines are blank."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT, " ")
    out = F.regexp_replace(kept, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _whole_form(lines_form: Column) -> Column:
    """The canonical form of a text from that of its lines: spellings of several words may stand across a line end."""
    out = F.regexp_replace(lines_form, r"[ \n]+", " ")
    for old, new in EQUIVALENT:
        if " " in old:
            out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """The canonical form; a null text has the empty one."""
    return _whole_form(_lines_form(text))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license string, text string").coalesce(1)


def digests(known: DataFrame) -> DataFrame:
    """(digest, license, chars) of known texts (license, text): the first name in order where two canonical forms agree; empty ones are left out."""
    form = known.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.first(F.char_length("form")).alias("chars"))


def _lengths(known: DataFrame) -> Column:
    """A condition on a form's length that every known form meets: one of theirs, or between the least and the most if there are over 1,000."""
    found = [r.chars for r in known.select("chars").distinct().limit(1001).collect()]
    if len(found) > 1000:
        least, most = known.agg(F.min("chars"), F.max("chars")).first()
        return lambda form: F.char_length(form).between(least, most)
    return lambda form: F.char_length(form).isin(found) if found else F.lit(False)


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, canonical_chars, license) for each row: license is null where no known text has the digest.

    Null, empty and letterless texts have the empty form, which matches nothing. Ties between known names go to the first
    in order; repeated rows and null ids stay. The known side is what its caller gives; Spark broadcasts it only if its
    measured size allows, and else deals both sides by digest, where AQE splits the groups of equal documents.
    """
    known = digests(known if known is not None else known_licenses(docs.sparkSession)).drop("chars")
    form = picked(docs, doc_id=id_col, text=text_col).select("doc_id", canonical(F.col("text")).alias("form"))
    rows = form.select("doc_id", F.sha2("form", 256).alias("digest"), F.char_length("form").cast("bigint").alias("canonical_chars"))
    return rows.join(known, "digest", "left").select("doc_id", "digest", "canonical_chars", "license")


def report(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """scan() with notice_lines and notice_licenses: how many whole lines (cut at line feeds) of the texts of an id are a known text or notice, and their licences in order with commas (null: none).

    A line can only match if its form is as long as a known one, so just those go on to be hashed and joined. What each
    text's one normalisation gives, its digest and the digests of such lines, is written to the shared folder.
    """
    known = cut(digests(known if known is not None else known_licenses(docs.sparkSession)), "known")
    fits = _lengths(known)
    lines = picked(docs, doc_id=id_col, text=text_col).select("doc_id", _lines_form(F.col("text")).alias("lines"))
    some = F.transform(F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), fits), lambda x: F.sha2(x, 256))
    form = lines.select("doc_id", _whole_form(F.col("lines")).alias("form"), some.alias("some"))
    rows = cut(form.select("doc_id", F.sha2("form", 256).alias("digest"), F.char_length("form").cast("bigint").alias("canonical_chars"), "some"), "forms")
    hits = rows.select(F.col("doc_id").alias("its_id"), F.explode("some").alias("digest")).join(known, "digest").groupBy("its_id", "license").agg(F.count("*").alias("n"))
    found = hits.groupBy("its_id").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notice_licenses"))
    out = rows.join(known, "digest", "left").join(found, F.col("doc_id").eqNullSafe(F.col("its_id")), "left")
    return out.select("doc_id", "digest", "canonical_chars", "license", F.coalesce("n", F.lit(0)).alias("notice_lines"), "notice_licenses")


def sql() -> str:
    """report() over documents in DuckDB's SQL."""

    def form(text: str) -> str:
        out = rf"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '(?m){COPYRIGHT}', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
        for old, new in EQUIVALENT:
            out = f"replace({out}, '{old}', '{new}')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known_texts())
    return f"""
WITH known AS (SELECT sha256(form) AS digest, min(license) AS license
               FROM (SELECT license, {form("text")} AS form FROM (VALUES {values}) AS v(license, text)) WHERE form <> '' GROUP BY 1),
rows AS (SELECT doc_id, sha256(form) AS digest, length(form) AS canonical_chars
         FROM (SELECT doc_id, {form("text")} AS form FROM documents)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, license FROM (SELECT doc_id, sha256({form("line")}) AS digest FROM lines) JOIN known USING (digest)),
found AS (SELECT doc_id AS its_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notice_licenses FROM hits GROUP BY doc_id)
SELECT doc_id, digest, canonical_chars, license, coalesce(n, 0)::BIGINT AS notice_lines, notice_licenses
FROM rows LEFT JOIN known USING (digest) LEFT JOIN found ON doc_id IS NOT DISTINCT FROM its_id
"""
