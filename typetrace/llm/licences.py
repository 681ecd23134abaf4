"""Licence scan by canonical digests.

A text is made canonical: copyright lines go, letters are lower-cased, everything but letters and
digits is one space, and equivalent spellings become one. The digest of the whole canonical text of a document, and of
each of its lines, is looked up among the digests of known licence texts and notices by a hash join.
There is no search inside a text, so a hit is the licence text itself, whatever its case,
punctuation, line breaks or copyright holder.

The catalogue is any table (``licence``, ``text``); ``known_licences`` makes one of short licence texts and of
the notices ``NOTICES`` x names in ``NAMES``. It is small, so Spark sends it to all executors by its size.
Short texts count with and without a title; of long licences only headings on one line and notices are known, not the full text.
A line is one of copyright if a year, a sign, "by" or a capitalised holder follows the word.

Defined results: null or empty texts hold no licence; a text that is nothing but copyright lines matches
nothing; a document that holds a licence several times counts each line; rows repeated with their id are
answered from all texts of that id. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typetrace.llm.common import stored

# Identifiers of public licences with the names they go by.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "3-clause BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
# Forms of a notice.
NOTICES = (
    "{name}", "Licensed under {name}", "Licensed under the {name}", "Released under {name}", "Released under the {name}",
    "Distributed under {name}", "Distributed under the {name}", "Available under {name}", "Available under the {name}",
    "This work is licensed under {name}", "This work is licensed under the {name}", "This work is licensed under a {name}",
    "This project is licensed under {name}", "This project is licensed under the {name}",
    "This software is released under the {name}", "License: {name}", "SPDX-License-Identifier: {id}",
)
# Short licence texts.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
# Titles that usual licence files begin with, beside the names above.
TITLES = {"MIT": ("The MIT License (MIT)", "The MIT License"), "MIT-0": ("MIT No Attribution",), "ISC": ("ISC License (ISC)",), "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"),
          "BSD-2-Clause": ('BSD 2-Clause "Simplified" License',), "BSD-3-Clause": ('BSD 3-Clause "New" or "Revised" License',), "Zlib": ("zlib License",)}
# Headings of long licences, as their files and notices write them.
HEADINGS = {"Apache-2.0": "Apache License Version 2.0, January 2004", "GPL-2.0": "GNU General Public License Version 2, June 1991", "GPL-3.0": "GNU General Public License Version 3, 29 June 2007",
            "MPL-2.0": "Mozilla Public License Version 2.0"}
# Spellings that count as one, as whole words of canonical text.
SPELLINGS = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "noncommercial": "non commercial",
             "sharealike": "share alike", "acknowledgement": "acknowledgment", "favour": "favor", "organisation": "organization",
             "redistributions": "redistribution", "whilst": "while", "centre": "center", "judgement": "judgment", "authorised": "authorized"}
# A line is one of copyright if a year, a sign, "by" or a capitalised holder follows: wrapping may begin any line of a text with the bare word.
_COPYRIGHT = (r"(?:^|\n)[ \t\r]*(?:(?i:copyright[ \t:,]*(?:\(c\)|©|[0-9]{4}|by\b|<|\[)|\(c\)|©|all rights reserved)|Copyright[ \t]+[A-Z])[^\n]*")
_WORDS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a whole text: its words, each between spaces. No words: a single space."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, _COPYRIGHT, "\n")), _WORDS, " ")
    plain = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    for one, other in SPELLINGS.items():
        plain = F.replace(plain, F.lit(f" {one} "), F.lit(f" {other} "))
    return plain


def known_texts() -> list[tuple[str, str]]:
    notices = {(i, form.format(name=name, id=i)) for i, names in NAMES.items() for name in names for form in NOTICES}
    titled = {(i, f"{title}\n{text}") for i, text in TEXTS.items() for title in (*NAMES.get(i, ()), *TITLES.get(i, ()))}
    return sorted(notices) + sorted(TEXTS.items()) + sorted(titled) + sorted(HEADINGS.items())


def known_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "licence string, text string")


def scan_licences(docs: DataFrame, catalogue: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row: ``doc_id``, ``licences`` (joined by commas, in order), ``n_notices`` (lines), ``whole_licence`` (or null)."""
    # Written first, so that its size is known when the join is planned and the texts are read once.
    digests = stored(catalogue.select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).filter(F.col("digest") != F.sha2(F.lit("  "), 256))
                     .groupBy("digest").agg(F.min("licence").alias("licence")), "licence-digests")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("t")))
    units = texts.select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("t").alias("t"))), lines)).alias("u"))
    hits = (units.select("doc_id", "u.whole", F.sha2(canonical(F.col("u.t")), 256).alias("digest")).join(digests, "digest")
            .groupBy("doc_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("licences"),
                                   F.count_if(~F.col("whole")).alias("n_notices"),
                                   F.min(F.when(F.col("whole"), F.col("licence"))).alias("whole_licence")))
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    return (texts.select("doc_id").alias("d").join(hits.alias("h"), same, "left")
            .select("d.doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "whole_licence"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql() -> str:
    """The scan as SQL that compares canonical texts instead of digests."""
    def canon(c: str) -> str:
        plain = f"regexp_replace(lower(regexp_replace({c}, {_quoted(_COPYRIGHT)}, chr(10), 'g')), {_quoted(_WORDS)}, ' ', 'g')"
        plain = f"' ' || trim({plain}) || ' '"
        for one, other in SPELLINGS.items():
            plain = f"replace({plain}, ' {one} ', ' {other} ')"
        return plain

    values = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in known_texts())
    return f"""
WITH known AS (SELECT min(licence) AS licence, {canon('text')} AS canon FROM (VALUES {values}) AS k(licence, text) GROUP BY 2),
units AS (SELECT doc_id, true AS whole, coalesce(text, '') AS t FROM documents
          UNION ALL SELECT doc_id, false, unnest(string_split(coalesce(text, ''), chr(10))) FROM documents),
canonical AS (SELECT doc_id, whole, {canon('t')} AS canon FROM units),
hits AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) FILTER (WHERE NOT whole) AS n_notices,
                min(licence) FILTER (WHERE whole) AS whole_licence
         FROM canonical JOIN known USING (canon) WHERE canon <> '  ' GROUP BY doc_id)
SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(n_notices, 0)::BIGINT AS n_notices, whole_licence
FROM documents d LEFT JOIN hits h ON d.doc_id IS NOT DISTINCT FROM h.doc_id
"""

