"""Licence texts by the digest of their canonical form, with DataFrame functions only.

Texts that differ in case, punctuation, layout, copyright lines or equivalent spellings have one canonical form. Its
digest is joined to the digests of known texts: licences and the notices that stand for them. Whole documents are
looked up, and every line by itself, as a notice is often a line of a longer text. Nothing is searched within a unit: a
unit matches if all of it is a known text.

The full texts of licences are in ``license_texts``. As a layout may put any word at the start of a line, whole documents
are looked up a second time in a form that leaves out only lines that name a holder.
"""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lines that name the holder, not the licence.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
# Lines and phrases that name a holder: one with a sign, a year or a place for it, the foundation of the GNU
# licences, and the examples in them.
HOLDER_LINE = (
    r"(?m)^[ \t/*#;-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|[<\[{])|\(c\)[ \t]*(copyright|[0-9]{4}|[<\[{])|©|all rights reserved[.]?[ \t]*$)[^\n]*$"
)
HOLDER_PHRASE = (
    r"copyright\s+\(c\)\s+((<year>|19yy|19xx|year)\s+(<?name\s+of\s+author>?|your\s+name[.]?)|_+"
    r"|[0-9]{4}[0-9,\s-]*free\s+software\s+foundation,\s+inc[.]?,?([\s*/#;]+<https?://(www[.])?fsf[.]org/?>)?([\s*/#;]+(51\s+franklin|59\s+temple|675\s+mass)[\s\S]{0,120}?usa)?)"
)
# Titles that stand before short licences, besides their identifier and the word license.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT License (Expat)", "Expat License"],
    "ISC": ["The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "The 3-Clause BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "Zlib": ["zlib License", "The zlib License", "The zlib/libpng License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
# Spellings that licence texts treat as equal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog",
    "authorisation": "authorization", "favour": "favor", "fulfil": "fulfill", "judgement": "judgment", "merchantibility": "merchantability",
    "noncommercial": "non  commercial", "noninfringement": "non  infringement", "organisation": "organization", "recognise": "recognize",
    "ver": "version", "v": "version", "https": "http",
}
# Known texts by licence.
TEXTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, two spaces around every word, one spelling; empty for null.

    With a space of its own on either side of a word, a plain replacement of `` word `` meets every such word.
    """
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for other, one in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """``digest, license`` of known texts; one row per digest."""
    rows = F.inline(F.array(*(F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts)))
    return spark.range(1).select(rows).groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def words(text: Column) -> Column:
    """The words of a text in one spelling, but for those that name a holder, whatever the layout."""
    out = F.regexp_replace(F.lower(text), HOLDER_PHRASE, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(out, HOLDER_LINE, ""), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for other, one in SPELLINGS.items():
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(out)


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of all shipped licences: with and without their titles and the appendix on how to apply them."""
    out = []
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name, text = file.name.removesuffix(".txt").split("~")[0], file.read_text(encoding="utf-8").strip("\n\f")
        out.append((name, text))
        if name in TITLES:
            out += [(name, f"{title}\n\n{text}") for title in [*TITLES[name], name, f"{name} License"]]
            continue
        parts = re.split(r"(?i)(end of terms and conditions)", text)
        heads = [text, *(["".join(parts[:2]), parts[0]] if len(parts) == 3 else [])]
        out += [(name, h) for h in heads[1:]] + [(name, re.sub(r"\A.*?\n[ \t]*\n", "", h, flags=re.S)) for h in heads]
    return out


def full_digests() -> list[tuple[str, str]]:
    """(licence, digest) of the shipped texts in the form of ``words``; a text on one line has it as its canonical form too."""
    found = {}
    for name, text in full_texts():
        out = re.sub(HOLDER_LINE, "", re.sub(HOLDER_PHRASE, " ", text.lower()))
        plain = "  ".join(SPELLINGS.get(w, w) for w in re.split(r"[\W_]+", out) if w)
        found.setdefault(hashlib.sha256(plain.encode()).hexdigest(), name)
    return sorted((name, d) for d, name in found.items())


def licenses(docs: DataFrame, row_id: str = "doc_id", text: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, digest`` of the whole text, ``license`` (null if it is no known text),
    ``n_notices`` (lines that are known texts) and ``notices`` (their licences, sorted, each once, joined by commas).

    Null text is empty; an empty or blank text or line is no known text. Null ids and repeated rows are rows like others,
    other columns are ignored, an empty table gives none. Long texts are taken whole, each by one task; of several licences
    with one digest the first by name counts. ``texts`` are known texts as (licence, text), a fixed list;
    without it, ``TEXTS`` and the full texts of ``license_texts``.
    """
    known = known_digests(docs.sparkSession, texts or TEXTS)
    if not texts:
        full = F.inline(F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(name).alias("license")) for name, d in full_digests())))
        both = known.unionByName(docs.sparkSession.range(1).select(full))
        known = both.groupBy("digest").agg(F.min("license").alias("license"))
    content = F.coalesce(F.col(text), F.lit(""))
    unit = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("unit"))
    lines = F.transform(F.split(content, "\n"), lambda line: unit("line", line))
    whole = F.array(unit("whole", content))
    if not texts:
        # all shipped texts speak of licences or of who is liable, other documents need no second look
        again = F.when(F.lower(content).rlike("licen|liab"), F.array(unit("whole", content), unit("words", content)))
        whole = F.coalesce(again, whole)
    rows = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(whole, lines).alias("units"))
    form = F.when(F.col("kind") == "words", F.sha2(words(F.col("unit")), 256)).otherwise(digest(F.col("unit")))
    units = rows.select("doc_id", "row", F.inline("units")).select("doc_id", "row", "kind", form.alias("digest"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    line = (F.col("kind") == "line") & F.col("license").isNotNull()
    # all units of a row are in one task, so they are combined to one row before the shuffle
    return units.join(known, "digest", "left").groupBy("row", "doc_id").agg(
        of("whole", "digest").alias("digest"),
        F.coalesce(of("whole", "license"), of("words", "license")).alias("license"),
        F.sum(line.cast("long")).alias("n_notices"),
        F.collect_set(F.when(line, F.col("license"))).alias("found"),
    ).select("doc_id", "digest", "license", "n_notices", F.array_join(F.array_sort("found"), ",").alias("notices"))


def canonical_sql(text: str) -> str:
    """The canonical form as SQL of DuckDB."""
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', '', 'g')"
    out = rf"concat(' ', regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', '  ', 'g'), ' ')"
    for other, one in SPELLINGS.items():
        out = f"replace({out}, ' {other} ', ' {one} ')"
    return f"trim({out})"


def licenses_sql() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEXTS)
    return rf"""
WITH known AS (SELECT sha256({canonical_sql("text")}) AS digest, min(license) AS license FROM (VALUES {values}) AS t(license, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, sha256({canonical_sql("text")}) AS digest FROM d),
l AS (SELECT r, sha256({canonical_sql("line")}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
n AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN known USING (digest) GROUP BY r)
SELECT doc_id, w.digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM w LEFT JOIN known USING (digest) LEFT JOIN n USING (r)"""
