"""Licence scans by canonical digest.

A whole text is normalised (letter case, copyright lines, equivalent spellings,
punctuation, white space) and its SHA-256 is hash-joined to the digests of known
licence texts, normalised by the same expression. Only the small table of known
digests is broadcast; documents are neither shuffled nor copied.

Notices within other text are found by the digests of single lines and paragraphs,
exploded and hash-joined to the digests of known notices.
"""

from __future__ import annotations

import itertools
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Applied in this order, everywhere in the text. The patterns are common to Java and RE2.
STEPS = (
    (r"(^|\n)[ \t]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9])[^\n]*", "\n"),
    (r"(^|\n)[ \t]*all rights reserved\.?[ \t]*", "\n"),
    (r"licence", "license"),
    (r"acknowledgement", "acknowledgment"),
    (r"favour", "favor"),
    (r"organisation", "organization"),
    (r"merchantibility", "merchantability"),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
)

# Public licence texts, line breaks do not matter.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
    "the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution. "
)
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
KNOWN: dict[str, str] = {
    "MIT": f"MIT License {_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-untitled": f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MIT-0": f"MIT No Attribution {_MIT}. {_AS_IS}",
    "BSD-2-Clause": _BSD_START + _BSD_END,
    "BSD-3-Clause": _BSD_START
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _BSD_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies." + _ISC_END,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + _ISC_END,
}

# Names of the stored texts, the addresses of the FSF through the years, titles of short texts, wording of notices.
_STORED = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0",
    "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "675 Mass Ave, Cambridge, MA 02139, USA", "31 Milk Street, # 960789, Boston, MA 02196 USA",
)
_TITLES = {
    "MIT-untitled": ("The MIT License (MIT)", "The MIT License"), "MIT-0": ("MIT-0",), "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
}
_LEADS = ("", *(f"{a} is " for a in ("this work", "this software", "this program", "this project", "this code", "this file", "this document", "this library")))
_VERBS = ("licensed under", "released under", "distributed under", "available under", "made available under", "published under")
_MIDS = ("", "the", "the terms of the")


def _versions(name: str, short: str, versions: str, of: str = "") -> dict[str, tuple[str, ...]]:
    return {
        f"{short}-{v if '.' in v else v + '.0'}": tuple(f"{n}{x}{v}" for n in (f"{name} license", f"{name} license ({short})", short, *([of] if of else [])) for x in (", version ", " version ", " v", " ", "-"))
        + ((f"{name} license, version {v} or later", f"{name} license, version {v} or any later version", f"{short}-{v}+", f"{short} v{v} or later", f"{short}-{v}.0-only", f"{short}-{v}.0-or-later") if short.endswith("GPL") else ())
        for v in versions.split()
    }


#: Names by which notices refer to a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "MIT license", "MIT license (MIT)"), "ISC": ("ISC", "ISC license"), "0BSD": ("0BSD", "0BSD license"), "Unlicense": ("Unlicense",),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD-2-Clause license", "BSD 2-Clause simplified license", "simplified BSD license"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD-3-Clause license", "new BSD license", "modified BSD license", "revised BSD license"), "BSD": ("BSD", "BSD license"),
    "Apache-2.0": ("Apache license, version 2.0", "Apache license 2.0", "Apache license v2.0", "Apache license, version 2", "Apache 2.0 license", "Apache-2.0", "Apache-2.0 license", "Apache 2 license"),
    "Apache": ("Apache license",), "GPL": ("GNU general public license", "GPL", "GNU GPL"), "LGPL": ("GNU lesser general public license", "LGPL", "GNU LGPL"),
    "AGPL": ("GNU affero general public license", "AGPL", "GNU AGPL"), "MPL": ("Mozilla public license", "MPL"),
    **_versions("GNU general public", "GPL", "1 2 3", "GNU GPL"), **_versions("GNU lesser general public", "LGPL", "2.1 3", "GNU LGPL"), **_versions("GNU library general public", "LGPL", "2"),
    **_versions("GNU affero general public", "AGPL", "3", "GNU AGPL"), **_versions("GNU free documentation", "GFDL", "1.2 1.3", "GNU FDL"), **_versions("Mozilla public", "MPL", "1.1 2.0"),
    "CC0-1.0": ("CC0", "CC0 1.0", "CC0 license", "CC0 1.0 universal", "creative commons CC0 1.0 universal", "creative commons zero license"),
    **{
        f"CC-{k}-{v}": (f"CC {k} {v}", f"CC {k} {v} license", f"CC {k} {v} international", f"creative commons {w} {v}", f"creative commons {w} {v} license", f"creative commons {w} {v} international", f"creative commons {w} {v} international license")
        for k, w in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"))
        for v in ("2.0", "2.5", "3.0", "4.0")
    },
}


def _gnu(what: str, name: str, versions: dict[str, str], verb: str = "redistribute it and/or modify") -> list[tuple[str, str]]:
    return [
        (f"{i}", f"This {what} is free software{dot} you can {verb} it under the terms of the GNU {name} License as published by the Free Software Foundation{end}")
        for v, i in versions.items()
        for dot in (";", ":")
        for end in (f"; either version {v} of the License, or (at your option) any later version.", f", either version {v} of the License, or (at your option) any later version.", f"; version {v} of the License.", f"; version {v}.", f"; version {v} only.")
    ]


#: Paragraphs by which a text is put under a licence, or that open a whole licence; ``(license_id, text)``.
PARAGRAPHS: list[tuple[str, str]] = [
    ("MIT", f"{_MIT}, subject to the following conditions:"), ("MIT-0", f"{_MIT}."), ("ISC", KNOWN["ISC"][: -len(_ISC_END)]), ("0BSD", KNOWN["0BSD"][: -len(_ISC_END)]),
    ("BSD", _BSD_START[: _BSD_START.index(" 1. ")]),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    *(("Apache-2.0", f'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {h}://www.apache.org/licenses/LICENSE-2.0') for h in ("http", "https")),
    *((("Apache-2.0", f'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {h}://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.')) for h in ("http", "https")),
    *(("MPL-2.0", f"This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {h}://mozilla.org/MPL/2.0/.") for h in ("http", "https")),
    *_gnu("program", "General Public", {"1": "GPL-1.0", "2": "GPL-2.0", "3": "GPL-3.0"}), *_gnu("program", "Affero General Public", {"3": "AGPL-3.0"}),
    *_gnu("library", "Library General Public", {"2": "LGPL-2.0"}), *_gnu("library", "Lesser General Public", {"2.1": "LGPL-2.1", "3": "LGPL-3.0"}), *_gnu("program", "Lesser General Public", {"2.1": "LGPL-2.1", "3": "LGPL-3.0"}),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"), ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
]
#: Every known notice has one of these in its lines, in any case; others need no digest.
HINT = r"(?i)licen[cs]e|under|permission|redistribution"


def whole_texts() -> list[tuple[str, str]]:
    """``(license_id, text)`` of all known whole texts: short ones with their usual titles, stored ones with each known address and scheme, with and without the appendix."""
    out = [*KNOWN.items()]
    out += [(k, re.sub(r"(?<=[.:] )[123]\. ", "", v)) for k, v in KNOWN.items() if k in ("BSD-2-Clause", "BSD-3-Clause")]
    out += [(k.removesuffix("-untitled"), f"{title} {v}") for k, v in out for title in _TITLES.get(k, ())]
    for file, name in _STORED.items():
        text = (Path(__file__).parent / "license_texts" / f"{file}.txt").read_text()
        ends = [text]
        if (at := re.search(r"END OF TERMS AND CONDITIONS", text)) is not None:
            ends += [text[: at.end()], text[: at.start()]]
        for t in ends:
            moved = {t, re.sub(rf"(?m)^\s*{_ADDRESS.pattern}$", "", t, count=1), *(_ADDRESS.sub(a, t) for a in _ADDRESSES)}
            out += [(name, x) for m in sorted(moved) for x in (m, m.replace("https://", "http://"))]
    return out


def notices() -> list[tuple[str, str]]:
    """``(license_id, text)`` of all known notices of one line or paragraph."""
    said = [(i, f"{lead}{verb} {mid} {n}") for lead, verb, mid in itertools.product(_LEADS, _VERBS, _MIDS) for i, ns in NAMES.items() for n in ns]
    tags = [(i, f"{tag}: {n}") for i, ns in NAMES.items() for n in ns for tag in ("SPDX-License-Identifier", "License")]
    return said + tags + PARAGRAPHS


def canonical(text: Column) -> Column:
    """The normalised text; null and empty texts are empty."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``(digest, license_id)`` of known texts; of equal ones the first name stays."""
    return _digests(spark, list(texts.items()) if texts else whole_texts())


def known_notices(spark: SparkSession) -> DataFrame:
    """``(digest, license_id)`` of known notices, some ten thousands."""
    return _digests(spark, notices())


def _digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    rows = spark.createDataFrame(texts, "license_id string, text string")
    return rows.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, digest, license_id)`` for each row of ``docs(doc_id, text)``; ``license_id`` is null for other texts.

    Null, empty and purely punctuated texts share the digest of the empty text, which
    is no licence. Repeated rows are rows of their own; other columns are ignored.
    ``known`` is the bounded table of ``known_digests``.
    """
    read = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return read.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id")


def scan_notices(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, digest, license_id)`` for each distinct known notice of each row of ``docs(doc_id, text)``.

    A notice is a line, or a paragraph between blank lines, whose canonical text is
    known; other rows of the document do not matter. Repeated rows are rows of their own.
    """
    units = F.concat(F.split("text", r"\n"), F.split("text", r"\n[ \t\r]*\n"))
    hinted = docs.select("doc_id", F.array_distinct(F.filter(units, lambda u: u.rlike(HINT))).alias("units")).where("size(units) > 0")
    # distinct once more: lines that differ in case or punctuation have one digest
    read = hinted.select("doc_id", F.explode(F.array_distinct(F.transform("units", lambda u: F.sha2(canonical(u), 256)))).alias("digest"))
    return read.join(F.broadcast(known), "digest").select("doc_id", "digest", "license_id")


def _canon(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')".replace("'\n'", "chr(10)")
    return f"sha256(trim({out}))"


def notices_sql() -> str:
    """DuckDB SQL of ``scan_notices`` over ``documents``."""

    def rows(pairs) -> str:
        return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in pairs)

    def values(texts) -> str:
        return ", ".join(f"('{t}')" for t in texts)

    names = [(i, n) for i, ns in NAMES.items() for n in ns]
    return (
        f"WITH n AS (SELECT * FROM (VALUES {rows(names)}) v(k, t)), said AS (SELECT k, a || b || ' ' || c || ' ' || t AS t FROM n, (VALUES {values(_LEADS)}) l(a), (VALUES {values(_VERBS)}) w(b), (VALUES {values(_MIDS)}) m(c) "
        f"UNION ALL SELECT k, tag || ': ' || t FROM n, (VALUES ('SPDX-License-Identifier'), ('License')) g(tag) UNION ALL SELECT * FROM (VALUES {rows(PARAGRAPHS)}) p(k, t)), "
        f"known AS (SELECT {_canon('t')} AS digest, min(k) AS license_id FROM said GROUP BY 1), "
        "numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), "
        "units AS (SELECT r, doc_id, unnest(string_split(text, chr(10)) || string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS u FROM numbered), "
        f"d AS (SELECT DISTINCT r, doc_id, {_canon('u')} AS digest FROM units) SELECT doc_id, d.digest, license_id FROM d JOIN known ON d.digest = known.digest"
    )


def oracle_sql() -> str:
    """DuckDB SQL of ``scan`` over ``documents`` with the texts of ``KNOWN`` only; the stored texts are not in it."""

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in KNOWN.items())
    return (
        f"WITH known AS (SELECT {_canon('t')} AS digest, min(k) AS license_id FROM (VALUES {values}) v(k, t) GROUP BY 1), "
        f"d AS (SELECT doc_id, {_canon('text')} AS digest FROM documents) SELECT doc_id, d.digest, license_id FROM d LEFT JOIN known ON d.digest = known.digest"
    )
