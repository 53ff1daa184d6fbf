"""Licence scan: canonical texts are hashed and joined to the digests of known licences.

Canonical: copyright lines go, letters in lower case, equivalent spellings as one, words
(letters and digits) joined by single blanks. Whole texts are compared, and whole lines
that may be notices; a text that merely contains a licence among other prose has another
digest.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings (left is written as right).
SPELLINGS = """
acknowledgement acknowledgment
analogue analog
analyse analyze
artefact artifact
authorisation authorization
authorised authorized
calibre caliber
cancelled canceled
capitalisations capitalizations
catalogue catalog
categorise categorize
centre center
emphasised emphasized
favour favor
favourite favorite
fulfil fulfill
fulfilment fulfillment
initialise initialize
judgement judgment
labelling labeling
labour labor
licence license
licenced licensed
licences licenses
maximise maximize
modelled modeled
modelling modeling
offence offense
optimise optimize
organisation organization
organise organize
practise practice
programme program
realise realize
recognise recognize
signalling signaling
utilisation utilization
whilst while
wilful willful
"""
# Spellings of several words, after punctuation is gone.
PHRASES = {"sub license": "sublicense", "sub licensed": "sublicensed", "non commercial": "noncommercial", "per cent": "percent", "copyright owner": "copyright holder", "copyright owners": "copyright holders", "http www": "https www", "http": "https"}

# Licence texts and notices.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
}
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}

THIRD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Longer texts, a file for each SPDX id; a text may end at its last term.
FOLDER, LAST_TERM = Path(__file__).parent / "texts", "END OF TERMS AND CONDITIONS"


def shipped() -> dict[str, list[str]]:
    """The texts and notices of each SPDX id, with its identifier line."""
    out = {k: [v] for k, v in TEXTS.items()}
    for path in sorted(FOLDER.glob("*.txt")):
        text = path.read_text()
        head, mark, _ = text.partition(LAST_TERM)
        out[path.stem] = [text, head, head + mark] if mark else [text]
    # the third clause stands before the disclaimer
    terms, mark, disclaimer = TEXTS["BSD-2-Clause"].partition("THIS SOFTWARE IS")
    out["BSD-3-Clause"] = [*out.get("BSD-3-Clause", []), f"{terms}{THIRD_CLAUSE}\n{mark}{disclaimer}"]
    for k, v in NOTICES.items():
        out[k] = out.get(k, []) + v
    return {k: [*v, f"SPDX-License-Identifier: {k}"] for k, v in out.items()}


COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n©(]*(?:(?:©|\(c\))\s*[0-9]{4}|copyright\s+(?:©|\(c\)|[0-9]{4})|all rights reserved\.?\s*$)[^\n]*$"
#: A line without one of these in it is no notice.
NOTICE_WORDS = "(?i)licen[sc]e"


def canonical(text: Column) -> Column:
    """Null for null."""
    pairs = [line.split() for line in SPELLINGS.split("\n") if line]
    words = F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, COPYRIGHT_LINE, " "), r"[^\p{L}\p{N}]+", " ")))
    # most texts have no variant at all; only the others go through every replacement
    known = "|".join([*(a for a, _ in pairs), *PHRASES])
    spelled = words
    for a, b in [*pairs, *PHRASES.items()]:
        spelled = F.regexp_replace(spelled, rf"(?<![\p{{L}}\p{{N}}]){a}(?![\p{{L}}\p{{N}}])", b)
    return F.when(words.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{known})(?![\p{{L}}\p{{N}}])"), spelled).otherwise(words)


def known_licenses(spark: SparkSession, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(digest, license_id) of the given texts, by default the built-in ones. Two ids of
    one digest: the smaller one."""
    if texts is None:
        texts = shipped()
    rows = [(k, t) for k, ts in texts.items() for t in ts]
    df = spark.createDataFrame(rows, "license_id string, text string")
    return df.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id, notices) for each row of docs(doc_id, text).

    digest: SHA-256 of the canonical text (null for null text; of the empty string where
    nothing is left). license_id: of an equal digest in known(digest, license_id), else
    null. notices: sorted ids of lines whose canonical form is known. A digest that known
    has twice counts with its smallest id. Repeated rows are alike; other columns are not
    read; an empty table gives an empty one.
    """
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = rows.where(F.col("text").rlike(NOTICE_WORDS)).select(F.xxhash64("text").alias("_th"), F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.col("line").rlike(NOTICE_WORDS)).select("_th", F.sha2(canonical(F.col("line")).cast("binary"), 256).alias("digest"))
    notices = lines.distinct().join(known, "digest").groupBy("_th").agg(F.array_sort(F.collect_set("license_id")).alias("notices"))
    out = rows.select("doc_id", F.xxhash64("text").alias("_th"), F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"))
    out = out.join(known, "digest", "left").join(notices, "_th", "left")
    return out.select("doc_id", "digest", "license_id", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))
