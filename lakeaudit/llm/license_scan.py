"""Licence scan by canonical digests.

A text is brought to a canonical form -- lower case, copyright lines dropped
(behind the signs of a comment too), equivalent spellings made one, punctuation and line breaks to single blanks
-- and its digest is looked up among the digests of known licences by a hash
join.  Entire texts are compared: the whole document, each of its paragraphs
and each of its lines (a notice on a line of its own is a text of its own);
nothing matches in part.

Only units with one of the ``MARKERS`` enter the canonical form; every known
licence is required to hold one that no spelling rule touches, so none can be
missed by that.

Defined cases: null, empty and blank texts, and texts that consist of
copyright lines only, have no licence; of equal units all count; rows sharing
an id share their findings; a licence known under two names is reported under
both; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import documents, text_or_empty
from lakeaudit.llm.license_texts import TEXTS
from lakeaudit.operators.joins import broadcast_if_small

# words one of which every licence has, in any spelling
MARKERS = "licen|permi|warrant|redistribut|public domain"

# equivalent spellings: (regular expression on lower case, replacement)
SPELLINGS = [
    ("licence", "license"), ("sub[- ]license", "sublicense"), ("non[- ]commercial", "noncommercial"),
    ("copyright (holder|owner)s?", "copyright holder"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"),
    ("favour", "favor"), ("while ?st", "while"), ("fulfil\\b", "fulfill"), ("per ?cent\\b", "percent"),
    ("http://", "https://"), ("gnu gpl\\b", "gnu general public license"), ("\\(c\\)|©", "copyright"), ("&", "and"),
]

# a line that only says whose the text is, alone or in a comment
COPYRIGHT_LINE = r"(?m)^[ \t#*;%/!<|-]*((copyright|\(c\)|©)( |$|\()|all rights reserved)[^\n]*$"

_MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_2_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3_CONDITION = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_REGENTS = [("the copyright holder nor", "the University nor"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS"),
            ("COPYRIGHT HOLDER OR CONTRIBUTORS", "REGENTS OR CONTRIBUTORS")]

# titles that the short licences usually carry ('' for none)
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", ""),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", ""),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "0BSD License", ""),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License",
                     'BSD 2-Clause "Simplified" License', "FreeBSD License", ""),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License",
                     "The New BSD License", "Revised BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License", ""),
}


def _numbered(text: str) -> list[str]:
    """The text with its conditions as 1. 2. 3., as (a) (b) (c), and as
    bullets, which the canonical form drops."""
    letters = {"1": "(a)", "2": "(b)", "3": "(c)"}
    return [text, re.sub(r"(?m)^([123])\.", lambda m: letters[m[1]], text), re.sub(r"(?m)^[123]\.", "*", text)]


def _short(name: str, text: str) -> list[tuple[str, str]]:
    return [(name, f"{title}\n\n{t}".strip()) for t in dict.fromkeys(_numbered(text)) for title in TITLES[name]]


def _bsd(name: str, text: str) -> list[tuple[str, str]]:
    """With the holders as in the template, and as in the first licences."""
    regents = text
    for a, b in _REGENTS:
        regents = regents.replace(a, b)
    return [*_short(name, text), *_short(name, regents)]


def _published(name: str, text: str) -> list[tuple[str, str]]:
    """The text as published, and without what follows its terms."""
    terms = re.match(r"(?s)(.*?\n *END OF TERMS AND CONDITIONS)", text)
    ends = [] if not terms else [terms[1], terms[1].rpartition("\n")[0]]
    notice = re.match(r"(?s)(.*?)\n+(?:Exhibit A - Source Code Form License Notice|EXHIBIT A -Mozilla Public License)", text)
    how = re.match(r"(?s)(.*?)\n+ADDENDUM: How to use this License", text)
    return [(name, t) for t in (text, *ends, *(m[1] for m in (notice, how) if m))]


# fixed values: known licences, as (name, entire text of the licence or of
# its usual notice)
KNOWN = [
    ("MIT", _MIT), ("MIT", _MIT.partition("\n\n")[2]),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}"),
    ("BSD-2-Clause", f"{_BSD_2_CONDITIONS}\n\n{_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_2_CONDITIONS}\n\n{_BSD_3_CONDITION}\n\n{_BSD_DISCLAIMER}"),
    ("MIT", "Licensed under the MIT License"), ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    *[(f"CC-{kind.replace(' ', '-')}-4.0", f"{verb} under CC {kind} 4.0") for kind in
      ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for verb in ("Licensed", "This work is licensed")],
    *_short("MIT", _MIT.partition("\n\n")[2]),
    *_short("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_DISCLAIMER}"),
    *_short("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_DISCLAIMER}"),
    *_bsd("BSD-2-Clause", f"{_BSD_2_CONDITIONS}\n\n{_BSD_DISCLAIMER}"),
    *_bsd("BSD-3-Clause", f"{_BSD_2_CONDITIONS}\n\n{_BSD_3_CONDITION}\n\n{_BSD_DISCLAIMER}"),
    *[known for name, text in TEXTS for known in _published(name, text)],
]


def _check_known(known: list[tuple[str, str]]) -> None:
    for name, text in known:
        if not re.search(MARKERS, text.lower()):
            raise ValueError(f"the text known as {name} has none of the words that mark a licence")


def canonical(text: Column) -> Column:
    """The canonical form of a text; '' when nothing is left."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    for rule, to in SPELLINGS:
        out = F.regexp_replace(out, rule, to)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, license`` of the known texts (a parameter, not data)."""
    known = KNOWN if known is None else known
    _check_known(known)
    rows = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in known])
    one = spark.range(1).select(F.explode(rows).alias("k")).select("k.*")
    return one.select(F.md5(canonical(F.col("text"))).alias("digest"), "license").distinct()


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit, whole``: the document, its paragraphs and its lines,
    each different one once per document, as far as they hold a marker."""
    text = text_or_empty(text_col)
    marked = docs.where(F.lower(text).rlike(MARKERS)).select(F.col(id_col).alias("doc_id"), text.alias("t"))
    parts = F.array_distinct(F.concat(F.array(F.col("t")), F.split("t", r"\n[ \t\r]*\n"), F.split("t", "\n")))
    one = marked.select("doc_id", "t", F.explode(parts).alias("unit"))
    return one.where(F.lower("unit").rlike(MARKERS)).select("doc_id", "unit", (F.col("unit") == F.col("t")).alias("whole"))


def matches(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit, whole, license`` of every unit that is a known text."""
    found = units(docs, id_col, text_col).withColumn("digest", F.md5(canonical(F.col("unit"))))
    return found.join(broadcast_if_small(known), "digest").drop("digest")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Per document ``licenses`` (names in order, comma-joined), ``n_units``
    matched, ``whole`` (the entire document is a known licence)."""
    per_doc = matches(docs, known).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count_distinct("unit").alias("n_units"), F.max("whole").alias("whole")).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id")
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"),
                      F.coalesce("n_units", F.lit(0)).cast("bigint").alias("n_units"),
                      F.coalesce("whole", F.lit(False)).alias("whole"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the known licences among its texts."""
    return scan(documents(spark, sf_dir), known_digests(spark))


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    out = rf"regexp_replace({out}, '[ \t\r\n]+', ' ', 'g')"
    for rule, to in SPELLINGS:
        out = f"regexp_replace({out}, '{rule}', '{to}', 'g')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    known = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return rf"""
WITH known AS (SELECT DISTINCT md5({_sql_canonical('t')}) AS digest, license FROM (VALUES {known}) v(license, t)),
marked AS (SELECT doc_id, text AS t FROM documents WHERE regexp_matches(lower(text), '{MARKERS}')),
parts AS (
  SELECT DISTINCT doc_id, t, u FROM (
    SELECT doc_id, t, unnest(list_concat([t], regexp_split_to_array(t, '\n[ \t\r]*\n'), string_split(t, chr(10)))) AS u FROM marked)
  WHERE regexp_matches(lower(u), '{MARKERS}')),
hits AS (SELECT doc_id, u, u = t AS whole, license FROM parts JOIN known ON known.digest = md5({_sql_canonical('u')})),
per AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT u) AS n_units, max(whole) AS whole
        FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(licenses, '') AS licenses, coalesce(n_units, 0) AS n_units, coalesce(whole, false) AS whole
FROM documents d LEFT JOIN per ON per.doc_id IS NOT DISTINCT FROM d.doc_id"""
