"""License scans by canonical digests (DataFrame functions only).

A text is brought to a canonical form: lower case, copyright lines dropped, punctuation and white
space to single blanks, equivalent spellings to one. The digests of whole canonical texts are
joined to those of known licences. Two units are looked up: the whole document, which finds licence
files however they are laid out, and each whole line, which finds licence notices inside prose.
"""

from __future__ import annotations

import re
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm.common import let

# Spellings that count as equal, from the public guidelines for matching licence texts.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses",
    "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "sublicence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

# Names under which notices refer to licences.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
    "MIT": ("MIT License", "terms of the MIT License"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
}
SUBJECTS = ("", "This work is ", "This file is ", "This software is ", "This document is ", "The text is ")
VERBS = ("licensed", "released", "distributed", "available")

# The wording of short licences.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
BSD_BEGIN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE {whom} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {who} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: The wording of longer licences, as published, in a file each.
FOLDER = Path(__file__).with_name("license_texts")
# Titles that files put before short licences, and the lines of title that longer ones begin with.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
}
TITLE_LINES = {"Apache-2.0": 3, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-3.0": 2, "MPL-2.0": 2, "CC0-1.0": 2, "CC-BY-SA-4.0": 2}
#: What follows is advice on the use of the licence, which files may leave out, with or without the line before it.
APPENDIX = r"(?:(?P<end>\n\s*END OF TERMS AND CONDITIONS)\s*)?\n\s*(?:APPENDIX: How to apply the Apache|How to Apply These Terms)"
# Lines that name their licence in the headers that licences ask for, wrapped as published and not.
HEADERS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License");', "http://www.apache.org/licenses/LICENSE-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    ),
    "MPL-2.0": (
        "License, v. 2.0. If a copy of the MPL was not distributed with this", "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
} | {
    f"{short}-{v}.0": tuple(
        f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{which}"
        for what, mark, which in product(("program", "library", "software", "file"), (":", ";"), (f", either version {v} of the License, or (at your option) any later version.", f"; either version {v} of the License, or (at your option) any later version.", f", version {v}.", f", version {v} of the License."))
    )
    for short, name, v in (("GPL", "GNU General Public License", 2), ("GPL", "GNU General Public License", 3), ("LGPL", "GNU Lesser General Public License", 3))
}

#: A line of its own that states a copyright is no part of the wording. A title is: texts are known with and without theirs.
COPYRIGHT_LINE = r"^[^\p{L}\p{N}©(]*(?:copyright\s+(?!notice|holder|owner)\S|\(c\)\s*(?:copyright\b|\d{4})|©|all rights reserved\b|portions copyright\s)"
#: Known digests up to this many are broadcast (about 150 bytes each); more are joined by shuffle.
BROADCAST_KNOWN = 50_000


def canonical_words(line: Column) -> Column:
    """Array of a lower-case line's words in canonical spelling."""
    spelling = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    words = F.filter(F.split(F.regexp_replace(line, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.coalesce(spelling[w], w))


def canonical_lines(text: Column) -> Column:
    """Array of the canonical forms of a text's lines, "" where nothing is left."""
    lines = F.split(F.lower(text), r"\r\n|\n|\r", -1)
    return F.transform(lines, lambda x: F.when(x.rlike(COPYRIGHT_LINE), "").otherwise(F.array_join(canonical_words(x), " ")))


def canonical_digest(text: Column) -> Column:
    """Digest of a whole text's canonical form; null for null."""
    return F.sha2(F.array_join(F.filter(canonical_lines(text), lambda x: x != ""), " "), 256)


def unwrapped(text: str) -> str:
    """The text with a line for each paragraph."""
    return "\n".join(" ".join(x.split()) for x in re.split(r"\n[ \t]*\n", text))


def long_wordings(license_id: str, text: str) -> list[str]:
    """A text with all, some and none of its title lines, with and without its appendix, wrapped and not."""
    found = re.search(APPENDIX, text)
    ends = [text, text[: found.start()], text[: found.end("end")]] if found and found["end"] else [text]
    out, lines = [], [len(m[0]) + m.start() for m in re.finditer(r"\s*\S[^\n]*\n", text)]
    for end, n in product(ends, range(TITLE_LINES[license_id] + 1)):
        part = end[lines[n - 1] if n else 0 :]
        out += [part, unwrapped(part)]
    return out


def bsd_wordings(clauses: int) -> list[str]:
    """The licence with its clauses numbered or not, and what it is known to call the holder."""
    names = ("copyright holder", "University", "organization", "<organization>") if clauses == 3 else ("",)
    whose = [("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("REGENTS", "REGENTS"), ("AUTHOR", "AUTHOR")]
    out = []
    for name, (whom, who), marks in product(dict.fromkeys(names), whose, (("1. ", "2. ", "3. "), ("", "", ""), ("(1) ", "(2) ", "(3) "))):
        listed = [m + c.format(name=name) for m, c in zip(marks, BSD_CLAUSES[:clauses])]
        out.append("\n\n".join([BSD_BEGIN, *listed, BSD_END.format(whom=whom, who=who)]))
    return out


def wordings() -> list[tuple[str, str]]:
    """(license, text) of whole documents."""
    short = [*TEXTS.items(), *[(f"BSD-{n}-Clause", x) for n in (2, 3) for x in bsd_wordings(n)]]
    rows = [(k, title + x) for k, x in short for title in ("", *[f"{t}\n" for t in TITLES[k]])]
    rows += [(k, x) for k in TITLE_LINES for x in long_wordings(k, (FOLDER / f"{k}.txt").read_text("utf-8"))]
    return list(dict.fromkeys(rows))


def known_rows() -> list[tuple[str, str, str]]:
    """(license, unit, text): wordings of whole documents, and notices and header lines that stand as a line."""
    rows = [(k, "document", v) for k, v in wordings()]
    rows += [(k, "line", x) for k, lines in HEADERS.items() for x in lines]
    for license_id, names in NAMES.items():
        tags = [license_id] + [f"{license_id}-{x}" for x in ("only", "or-later") if "GPL" in license_id]
        rows += [(license_id, "line", f"SPDX-License-Identifier: {x}") for x in tags]
        rows += [(license_id, "line", f"{s}{v} under {t}{n}") for n, s, v, t in product(names, SUBJECTS, VERBS, ("", "the "))]
    return rows


def known_licenses(spark: SparkSession) -> DataFrame:
    """known_rows() as a table."""
    return spark.createDataFrame(known_rows(), "license string, unit string, text string")


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, digest (of its whole canonical text), license (the whole text is one), notices.

    notices: sorted licences of which a notice stands as a whole line; empty if none. Where several
    known texts share a digest, the first by name counts. known: (license, unit, text); unit is
    "document" or "line"; rows with a null, or whose canonical form is empty, match nothing.

    Null text: null digest, no licence. Empty text or one of copyright lines only: the digest of "",
    no licence. Null and repeated ids: rows alike in id and text come out as often as they came in,
    others apart. Empty tables: no rows, or no matches. Other columns are not read.
    """
    empty = F.sha2(F.lit(""), 256)
    listed = known.select(F.col("unit").alias("unit"), canonical_digest(F.col("text")).alias("digest"), F.col("license").alias("known")).na.drop().filter(F.col("digest") != empty)
    listed = listed.groupBy("unit", "digest").agg(F.min("known").alias("known"))
    if listed.limit(BROADCAST_KNOWN + 1).count() <= BROADCAST_KNOWN:
        listed = F.broadcast(listed)

    def units(lines):
        whole = F.sha2(F.array_join(F.filter(lines, lambda x: x != ""), " "), 256)
        alone = F.transform(F.filter(F.array_distinct(lines), lambda x: x != ""), lambda x: F.struct(F.lit("line").alias("unit"), F.sha2(x, 256).alias("digest")))
        return F.concat(F.array(F.struct(F.lit("document").alias("unit"), whole.alias("digest"))), alone)

    found = F.coalesce(let(canonical_lines(F.col(text_col)), units), F.array(F.struct(F.lit("document").alias("unit"), F.lit(None).cast("string").alias("digest"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.inline(found))
    rows = rows.join(listed, ["unit", "digest"], "left")
    whole = F.col("unit") == "document"
    out = rows.groupBy("doc_id", "text_hash").agg(
        F.max(F.when(whole, F.col("digest"))).alias("digest"),
        F.max(F.when(whole, F.col("known"))).alias("license"),
        F.array_sort(F.collect_set(F.when(~whole, F.col("known")))).alias("notices"),
        F.count(F.when(whole, 1)).alias("n"),
    )
    return out.select("doc_id", "digest", "license", "notices", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).drop("copy")
