"""License scans by canonical digest lookup.

A text is put into canonical form (case, punctuation, white space, copyright lines and
equivalent spellings are levelled out), the whole of it is digested, and the digest is
hash-joined to the digests of known licence texts, canonicalised by the same function.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import broadcast_up_to

#: Rows of the licence table up to which it is broadcast.
MAX_BROADCAST_LICENSES = 10_000

#: Equivalent words, the first form for each second; whole words only.
SPELLINGS = (
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"), ("authorization", "authorisation"),
    ("authorized", "authorised"), ("caliber", "calibre"), ("canceled", "cancelled"), ("catalog", "catalogue"), ("categorize", "categorise"),
    ("center", "centre"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("emphasized", "emphasised"), ("favor", "favour"),
    ("favorite", "favourite"), ("fulfill", "fulfil"), ("fulfills", "fulfils"), ("fulfillment", "fulfilment"), ("honor", "honour"), ("initialize", "initialise"),
    ("judgment", "judgement"), ("labeling", "labelling"), ("labor", "labour"), ("license", "licence"), ("licensed", "licenced"), ("licenses", "licences"),
    ("maximize", "maximise"), ("merchantability", "merchantibility"), ("modeled", "modelled"), ("modeling", "modelling"), ("noncommercial", "non commercial"),
    ("offense", "offence"), ("optimize", "optimise"), ("organization", "organisation"), ("organizations", "organisations"), ("organize", "organise"),
    ("percent", "per cent"), ("practice", "practise"), ("program", "programme"), ("realize", "realise"), ("recognize", "recognise"), ("signaling", "signalling"),
    ("sublicense", "sub license"), ("sublicense", "sub licence"), ("sublicense", "sublicence"), ("sublicenses", "sublicences"), ("sublicensed", "sublicenced"),
    ("utilization", "utilisation"), ("while", "whilst"), ("willful", "wilful"),
)
#: Signs that stand for words.
SIGNS = (("and", "&"), ("c", "©"))

#: Public licence texts and notices, by SPDX identifier.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "FSFAP": """Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.""",
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
}

#: Files of whole licence texts beside this module, named by SPDX identifier.
FOLDER = "licences"

#: Lines that state who holds a copyright: marks and a year (or where one goes), the word
#: and the sign, or "all rights reserved". A line of a sentence, such as "copyright notice
#: and this permission notice", has one mark and no year, and stays.
_MARK = r"(?:copyright|\(c\)|©)"
_GAP = r"[^\p{L}\p{N}\n]*"
COPYRIGHT_LINE = (
    rf"(?m)^{_GAP}{_MARK}(?:{_GAP}{_MARK})*{_GAP}(?:year|yyyy|(?:19|20)[0-9][0-9])\b[^\n]*$"
    rf"|^{_GAP}(?:copyright[ \t]*(?:\(c\)|©)|©|\(c\)[ \t]*copyright)[^\n]*$"
    rf"|^{_GAP}all rights reserved{_GAP}$"
)
#: A first line of a few words, "under" not among them, that names a licence; text follows.
TITLE = (
    r"\A(?![^\p{L}\p{N}]*[^\n]*\bunder\b)[^\p{L}\p{N}]*(?:[\p{L}\p{N}.-]+[ \t]+){0,6}licen[cs]e"
    r"(?:[ \t,(]+[\p{L}\p{N}.-]+\)?){0,4}[^\p{L}\p{N}\n]*\n"
)


def canonical(text: Column) -> Column:
    """Canonical form: lower case, words of letters and digits joined by single spaces.

    A title line, lines that state a copyright and lines "all rights reserved" are left
    out, and the whole words of ``SPELLINGS`` replaced. Null gives the empty form.
    """
    t = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, TITLE, ""), COPYRIGHT_LINE.replace("(?m)", "(?md)", 1), "")
    for to, sign in SIGNS:
        t = F.replace(t, F.lit(sign), F.lit(f" {to} "))
    # two spaces between words, so that neighbours do not share one
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for to, like in SPELLINGS:
        t = F.replace(t, F.lit(f" {like} ".replace(" ", "  ")[1:-1]), F.lit(f" {to} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def known_texts() -> dict[str, str]:
    """Licence texts by name: ``TEXTS`` and the files of ``FOLDER``."""
    files = resources.files(__package__) / FOLDER
    return TEXTS | {f.name[: -len(".txt")]: f.read_text("utf-8") for f in sorted(files.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def known_digests(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """(digest, license): SHA-256 of the canonical form; of equal texts the least name."""
    rows = spark.createDataFrame(sorted((texts if texts is not None else known_texts()).items()), "license string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest, n_canonical (code points), license (null: none known), per row of ``docs``.

    Entire texts are compared: a text that quotes a licence among others is not that
    licence. Null ids stay. Null and empty texts have the digest of the empty form
    and no licence (the empty form is never known). Repeated rows stay; an empty table
    gives an empty result; other columns are not read.
    """
    c = docs.select("doc_id", canonical(F.col("text")).alias("_canonical"))
    c = c.select("doc_id", F.sha2("_canonical", 256).alias("digest"), F.length("_canonical").cast("long").alias("n_canonical"))
    known = known_digests(docs.sparkSession, texts).select(F.col("digest").alias("_known"), "license")
    known = broadcast_up_to(known, MAX_BROADCAST_LICENSES)
    return c.join(known, (c["digest"] == F.col("_known")) & (F.col("n_canonical") > 0), "left").select("doc_id", "digest", "n_canonical", "license")
