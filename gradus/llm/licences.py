"""Licence scans: whole texts and lines against digests of known licences, by DataFrame functions alone."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, the second of each pair is kept.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("centre", "center"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("noncommercial", "non commercial"),
    ("offence", "offense"), ("organisation", "organization"), ("organisations", "organizations"), ("practise", "practice"),
    ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("sublicence", "sublicense"), ("whilst", "while"), ("wilful", "willful"),
)
# Fixed patterns: lines that name a holder.
HOLDER = r"(?m)^[^a-z0-9\n]*(copyright +(\(c\)|©|[0-9<\[])|\(c\) +[0-9<\[]|©)[^\n]*$"
RESERVED = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
#: Licence id and whole text. Holder lines fall away, so one text serves every holder.
LICENCES = {
    "MIT": "MIT License\n\n" + _PERMISSION,
    "MIT-untitled": _PERMISSION,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote\nproducts derived from this software without specific prior written permission.\n" + _BSD_TAIL,
    "ISC": _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"),
    "0BSD": _ISC.format(""),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
}
_TEXTS = Path(__file__).with_name("licence_texts")
_END = "END OF TERMS AND CONDITIONS"
# Title lines that files put before a text.
_TITLES = {
    "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "MIT": ("The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
}
# How notices name a licence, and the sentences that name it.
_NAMES = {
    "MIT": ("MIT License", "MIT"), "ISC": ("ISC License", "ISC"), "0BSD": ("0BSD License", "BSD Zero Clause License"), "Unlicense": ("Unlicense", "The Unlicense License"), "Zlib": ("zlib License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License, Version 2.0 (the License)", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "Apache License v2.0", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero v1.0 Universal"),
    **{
        f"{short}-{v}{tail}": tuple(n for v1 in dict.fromkeys((v, v.removesuffix(".0"))) for n in (f"{name}, version {v1}{words}", f"{name} version {v1}{words}", f"{name} v{v1}{words}", f"{short} v{v1}{words}", f"{short}v{v1}{words}", f"{short}-{v1}{words}"))
        + ((f"{short}-{v}-or-later",) if tail else (f"{short}-{v}-only",))
        for short, name, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)))
        for v in versions for tail, words in (("", ""), ("-or-later", " or later"))
    },
    **{
        f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}", f"CC {k} {v} License", f"Creative Commons {name} {v}", f"Creative Commons {name} {v} License", f"Creative Commons {name} {v} {area}", f"Creative Commons {name} {v} {area} License")
        for k, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for v, area in (("4.0", "International"), ("3.0", "Unported"))
    },
}
_SENTENCES = (
    "Licensed under {}.", "Licensed under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under {}.", "This project is licensed under the {}.",
    "This software is licensed under the {}.", "This file is licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under {}.", "Distributed under the {}.", "License: {}", "SPDX-License-Identifier: {}",
    "Available under the {}.", "Published under the {}.", "Content licensed under {}.", "Code licensed under the {}.", "Text licensed under {}.", "Dual licensed under the {}.",
)


def common() -> dict[str, list[str]]:
    """``LICENCES`` and more: texts of common licences, also without appendix and with usual titles, and notices of each."""
    out = {k: [v] for k, v in LICENCES.items()}
    for path in sorted(_TEXTS.glob("*.txt")):
        text = path.read_text("utf-8")
        head, end, _ = text.partition(_END)
        out[path.stem] = [text, *([head + end, head] if end else [])]
    for name, titles in _TITLES.items():
        body = _PERMISSION if name == "MIT" else out[name][0].partition("\n\n")[2] if name == "Zlib" else out[name][0]
        out[name] += [f"{t}\n\n{body}" for t in titles]
    for name, names in _NAMES.items():
        said = [x for s in _SENTENCES for n in names if LINE_MARK in (x := s.format(n)).lower()]
        out.setdefault(f"{name}-notice", []).extend(said)
    return out


def _texts(licences: dict[str, str | list[str]]) -> list[tuple[str, str]]:
    return [(k, x) for k, v in licences.items() for x in ([v] if isinstance(v, str) else v)]


#: Of lines, only those with this string once lower-cased can be a notice; ``registry`` makes sure of it.
LINE_MARK = "licen"


def canonical(text: Column) -> Column:
    """Lower case, no holder lines, words joined by one space, equivalent spellings made equal; one look-up a word."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), HOLDER, ""), RESERVED, "")
    kept = F.create_map(*[F.lit(x) for pair in EQUIVALENT for x in pair])
    return F.trim(F.array_join(F.transform(F.split(t, "[^a-z0-9]+"), lambda w: F.coalesce(F.element_at(kept, w), w)), " "))


def registry(spark: SparkSession, licences: dict[str, str | list[str]] | None = None) -> DataFrame:
    """Id and digest of each known licence, which is a text or a list of them. The table is a parameter of the operator: at most 10,000 texts."""
    licences = LICENCES if licences is None else licences
    texts = _texts(licences)
    if len(texts) > 10_000:
        raise ValueError("at most 10,000 licences")
    rows = spark.createDataFrame(texts, "licence string, _text string")
    return rows.groupBy(F.sha2(canonical(F.col("_text")), 256).alias("licence_digest")).agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, licences: dict[str, str | list[str]] | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the digest of its canonical text, the licence that it is (or null), and the notices among its lines.

    ``n_notices`` counts lines that are a known notice, ``notices`` lists their ids in order, without repeats. A null
    text has null digest and licence and no notices; a text without letters or digits has the digest of the empty text.
    Rows that repeat give rows that repeat; other columns are ignored; an empty table gives an empty one. The known
    digests, at most 10,000 rows, are broadcast: no text is shuffled.
    """
    licences = LICENCES if licences is None else licences
    if any(LINE_MARK not in x.lower() for k, x in _texts(licences) if k.endswith("-notice")):
        raise ValueError(f"a notice must hold {LINE_MARK!r}")
    known = registry(docs.sparkSession, licences)
    notices = [F.lit(x) for row in known.where(F.col("licence").endswith("-notice")).collect() for x in (row.licence_digest, row.licence)]
    ids = F.create_map(*notices) if notices else F.lit(None).cast("map<string,string>")
    lines = F.filter(F.split(F.lower("_text"), "\n"), lambda x: x.contains(LINE_MARK))
    found = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.element_at(ids, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    own = own.select("doc_id", F.sha2(canonical(F.col("_text")), 256).alias("digest"), found.alias("_found"))
    own = own.join(F.broadcast(known), own.digest == known.licence_digest, "left")  # at most 10,000 rows
    return own.select("doc_id", "digest", "licence", F.size("_found").cast("bigint").alias("n_notices"), F.concat_ws(",", F.array_sort(F.array_distinct("_found"))).alias("notices"))
