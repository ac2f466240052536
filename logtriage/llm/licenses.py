"""Licence scans by canonical digest.

A text is written in a canonical form: lower case, no copyright lines, one spelling for words that are written in
several ways, no punctuation, single blanks. The SHA-256 of that form is joined with the digests of known licences.
Whole documents are looked up, and every whole line as well, since texts often carry a one-line notice. The known
texts go through the same functions, so they can be given as they are published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtriage.llm.common import ascii_lower
from logtriage.session import BROADCAST_BYTES, measured_bytes

_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Known texts as published (fixed values). Copyright lines are left out, as in the canonical form.
_UNTITLED = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", f"{_BSD_2}\n\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD_2}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{_BSD_AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
)
# Titles that whole texts are published under (fixed values).
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
}
KNOWN = _UNTITLED + tuple((name, f"{title}\n\n{text}") for name, text in _UNTITLED if "\n" in text for title in TITLES[name])
# Spellings that count as equal (fixed values): pattern of canonical text, what it becomes.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("wilful", "willful"), ("fulfil", "fulfill"), ("per cent", "percent"), ("https", "http"))
# A line is a notice if a sign, (c) or a year (or its placeholder) follows the word, or a year the sign; body text may begin with the word alone.
_YEAR = r"[\[<{(]?((19|20)[0-9]{2}|y{4}|year)"
COPYRIGHT_LINE = rf"(?im)^[ \t#*/;-]*(copyright[ \t:,]*(\(c\)|©|&copy;|{_YEAR})|\(c\)[ \t]*(copyright|{_YEAR})|©|all rights reserved[.! \t\r]*$)[^\n]*$"
# Everything but ASCII letters and digits, and other characters that are no general punctuation.
SEPARATORS = r"[^a-z0-9\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, "")
    return canonical_words(ascii_lower(kept))


def canonical_words(lowered: Column) -> Column:
    form = F.concat(F.lit(" "), F.regexp_replace(lowered, SEPARATORS, " "), F.lit(" "))
    for other, usual in SPELLINGS:
        form = F.replace(form, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(F.regexp_replace(form, " +", " "))


def known_licenses(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license_id, text) from pairs, built without Python workers."""
    rows = F.array(*[F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in known])
    return spark.range(1).select(F.inline(rows))


def digests(licenses: DataFrame) -> DataFrame:
    """Distinct (digest, license_id); of several names for one digest the smallest stays; empty forms are left out."""
    form = canonical(F.col("text"))
    rows = licenses.where(form != "").select(F.sha2(form, 256).alias("_digest"), "license_id")
    return rows.groupBy("_digest").agg(F.min("license_id").alias("_license"))


def scan(docs: DataFrame, licenses: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) once, with digest, canonical_chars, license_id and notices.

    digest is the SHA-256 of the whole text's canonical form, license_id the known licence with it, else null.
    notices are the sorted distinct licence ids of whole lines that are known texts. Null and empty texts have the
    empty form, no licence and no notices; repeated rows stay. The known digests are broadcast if their
    measured size allows, else joined by shuffle.
    """
    known = digests(licenses)
    small = measured_bytes(known, F.length("_license") + 80) <= BROADCAST_BYTES
    hinted = F.broadcast(known) if small else known
    form = canonical(F.col("text"))
    whole = docs.select("doc_id", form.alias("_form"), "text")
    whole = whole.select("doc_id", "text", F.sha2("_form", 256).alias("digest"), F.length("_form").cast("long").alias("canonical_chars"))
    found = whole.join(hinted.withColumnRenamed("_digest", "digest"), "digest", "left").withColumnRenamed("_license", "license_id")
    key = F.xxhash64("text")
    lines = docs.select("doc_id", key.alias("_key"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    lines = lines.select("doc_id", "_key", F.sha2(canonical(F.col("text")), 256).alias("_digest")).join(hinted, "_digest")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name")
    notices = lines.groupBy(name, "_key").agg(F.array_sort(F.collect_set("_license")).alias("_notices"))
    keyed = found.select(name, key.alias("_key"), "doc_id", "digest", "canonical_chars", "license_id")
    joined = keyed.join(notices, ["_name", "_key"], "left")
    return joined.select("doc_id", "digest", "canonical_chars", "license_id", F.coalesce("_notices", F.array().cast("array<string>")).alias("notices"))
