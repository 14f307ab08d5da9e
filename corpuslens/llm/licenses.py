"""Licence scans by canonical digest lookup (operator 8), with DataFrame functions only.

A text's canonical form: lower case (A-Z), lines of copyright notices dropped, equivalent spellings replaced,
everything but letters a-z and digits turned into single spaces. Entire texts are joined by the digest of this
form with the digests of known licences; entire lines are compared with known one-line notices the same way.

Null and empty texts have the digest of the empty form and no licence. Repeated rows are scanned each; known
licences with equal forms give the smallest name. Texts of any length are formed and hashed whole. Other columns are
left aside, so their names cannot clash. An empty table gives an empty result.

LICENSES are the texts that the SQL lists too; DIGESTS and NOTICES are known besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.known_licenses import DIGESTS

# Public licence texts, without their copyright lines, and common one-line notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
LICENSES = {
    "MIT": MIT,
    "MIT (titled)": "MIT License\n" + MIT,
    "ISC": ISC,
    "ISC (titled)": "ISC License\n" + ISC,
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}
# Further spellings of one-line notices; %s is a licence's name.
NAMES = [
    "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "MIT License", "BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "ISC License",
    *[f"GNU {kind} Public License{v}" for kind, versions in (("General", "23"), ("Lesser General", "3"), ("Affero General", "3")) for n in versions for v in (f", version {n}", f", version {n} or later", f" v{n}.0", f" version {n}")],
    "GNU Lesser General Public License, version 2.1", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", *[f"{kind} {v}" for kind in ("GPL", "AGPL", "LGPL") for v in ("v3", "3.0", "v3.0")], "GPL v2", "GPL 2.0", "LGPL 2.1", "MPL 2.0",
    *[f"{cc}{kind} {v}" for cc in ("CC ", "Creative Commons ") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0")],
    *[f"Creative Commons {kind} 4.0 International License" for kind in ("Attribution", "Attribution-ShareAlike", "Attribution-NonCommercial", "Attribution-NoDerivatives", "Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-NoDerivatives")],
]
OPENINGS = ["Licensed under %s", "Licensed under the %s", "Released under %s", "Released under the %s", "Distributed under the %s"]
OPENINGS += [f"This {thing} is {done} under {the}%s" for thing in ("work", "software", "project", "file") for done in ("licensed", "released", "distributed") for the in ("", "the ")]
SPDX = ["MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "Zlib", "BSL-1.0", "EPL-2.0", *[f"{k}{end}" for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for end in ("", "-only", "-or-later")]]
NOTICES = [o % n for o in OPENINGS for n in NAMES] + [f"SPDX-License-Identifier: {n}" for n in SPDX]
# Spellings that count as equal, left as found, right as kept.
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("behaviour", "behavior"), ("favour", "favor"), ("organisation", "organization"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder")]
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]*(\(c\)|©|[0-9:])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"


def canonical_lines(text: Column) -> Column:
    """The canonical form with line breaks kept."""
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, r"[^a-z0-9\n]+", " ")
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(found), F.lit(kept))
    return out


def canonical(lines: Column) -> Column:
    """The canonical form of a whole text from its canonical lines."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known(spark, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """digest, license, size: one row for each canonical form."""
    table = spark.createDataFrame(sorted(licenses.items()), "license string, text string")
    form = canonical(canonical_lines(F.col("text")))
    return table.select("license", form.alias("form")).groupBy(F.md5("form").alias("digest")).agg(F.min("license").alias("license"), F.max(F.length("form")).alias("size"))


def scan(docs: DataFrame, licenses: dict[str, str] = LICENSES, key: str = "doc_id", text: str = "text", digests: dict[str, list[str]] = DIGESTS, further: list[str] = NOTICES) -> DataFrame:
    """key, digest, license (null: unknown), n_notice_lines: lines that are a known one-line text.

    digests: of further whole texts, by name; further: one-line notices whose whole texts have no name here.
    """
    spark = docs.sparkSession
    more = spark.createDataFrame([(d, name) for name, own in digests.items() for d in own], "digest string, license string")
    lookup = known(spark, licenses).select("digest", "license").unionByName(more).groupBy("digest").agg(F.min("license").alias("license"))
    one_line = {k: v for k, v in licenses.items() if "\n" not in v and len(v) < 200} | {v: v for v in further}
    forms = [r[0] for r in spark.createDataFrame(sorted(one_line.items()), "k string, text string").select(canonical(canonical_lines(F.col("text")))).distinct().collect()] if one_line else []
    lines = docs.select(key, canonical_lines(F.col(text)).alias("lines"))
    notices = F.size(F.filter(F.split("lines", "\n"), lambda x: F.trim(x).isin(forms))) if forms else F.lit(0)
    digested = lines.select(key, F.md5(canonical(F.col("lines"))).alias("digest"), notices.cast("long").alias("n_notice_lines"))
    # The licence list is a constant of this module or the caller's own dictionary: its size is known here.
    small = sum(map(len, licenses.values())) < 4_000_000
    return digested.join(F.broadcast(lookup) if small else lookup, "digest", "left").select(key, "digest", "license", "n_notice_lines")
