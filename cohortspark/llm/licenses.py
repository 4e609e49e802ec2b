"""License scans by canonical digest lookup.

A text is made canonical: lower case, copyright lines gone, equivalent
spellings made one, everything but letters and digits one space.  The SHA-256
of the result is hash-joined to the digests of known licence texts, so a
document that is a licence from end to end is named, however it was wrapped,
punctuated or dated.  A licence has many forms that are told apart by words:
with a heading or without, with an appendix or without, with another address or
holder; ``variants`` lists those, and full texts lie in ``license_texts``.

Scale: one narrow projection over the texts and a join on the digest; the
registry is broadcast only up to ``BROADCAST_LICENSES`` rows (counted first),
beyond that the join is shuffled and adaptive execution splits a digest that
many documents share.

Cases: a null text has a null digest and no licence; an empty canonical text
has the digest of nothing and no licence; of registry texts with the same
canonical form the least identifier counts; repeated rows are judged alike; a very
long text is made canonical whole; empty tables give empty results;
other columns are never read.
"""

from __future__ import annotations

import itertools
import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LICENSES = 100_000

#: Spellings that count as the same (second stands for first).
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("merchantibility", "merchantability"), ("modelling", "modeling"), ("noncommercial", "non commercial"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)

#: A line that is a copyright notice: the word or sign first, then a year or another sign.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;%-]*(copyright[^\n]*([0-9]{4}|\(c\)|©|<year>|\[year\])|\(c\)|©|all rights reserved)[^\n]*"
NOT_WORDS = r"[^\p{L}\p{N}]+"

_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Known licence texts and notices by identifier.
REGISTRY = {
    "MIT": _PERMISSION + _AS_IS,
    "ISC": _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END,
    "0BSD": _ISC + ".\n\n" + _ISC_END,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_END,
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
}

#: Headings that stand above a text, by identifier.
HEADINGS = {
    "MIT": ("MIT", "MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "License: MIT", "MIT/Expat License", "Expat License"),
    "MIT-0": ("MIT-0", "MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)"),
    "Zlib": ("Zlib", "zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "BSD-2-Clause": ("BSD License", "The BSD License", "BSD-2-Clause", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "The Simplified BSD License", "FreeBSD License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD License", "The BSD License", "BSD-3-Clause", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "3-Clause BSD License"),
    "Unlicense": ("Unlicense", "The Unlicense", "UNLICENSE"),
    "BSL-1.0": ("Boost Software License", "Boost Software License 1.0", "Boost Software License - Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
}

_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n" + _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
_BOOST = "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_NAMED = ("the copyright holder nor the names of its contributors", "the copyright holders nor the names of its contributors", "the copyright holder nor the names of contributors", "the University nor the names of its contributors", "the organization nor the names of its contributors", "the author nor the names of its contributors", "the project nor the names of its contributors")
_BSD_BY = (("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR"))
_FSF_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,? MA\s+02110-1301\s+USA")
_FSF_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
#: Where a full text's appendix for users of the licence begins.
_APPENDIX = re.compile(r"\n[^\n]*(?:END OF TERMS AND CONDITIONS()|()ADDENDUM: How to use|()EXHIBIT A -Mozilla|()Exhibit A - Source Code Form)")


def _bodies() -> dict[str, list[str]]:
    """The short licences' texts without headings: their usual wordings."""
    out = {k: [v] for k, v in REGISTRY.items() if not k.startswith("notice:")}
    out["ISC"].append(out["ISC"][0].replace("and/or distribute", "and distribute"))
    out["MIT-0"] = [_PERMISSION.split(", subject to")[0] + ".\n\n" + _AS_IS]
    out["Unlicense"] = [_UNLICENSE, *(f"{_UNLICENSE}\n\nFor more information, please refer to <{p}://unlicense.org{e}>" for p in ("http", "https") for e in ("", "/"))]
    out["BSL-1.0"] = [_BOOST]
    for name, named in (("BSD-2-Clause", [""]), ("BSD-3-Clause", [_BSD_NAMES.replace(_BSD_NAMED[0], x) for x in _BSD_NAMED])):
        for names, (by, whom) in itertools.product(named, _BSD_BY):
            text = _BSD + names + _BSD_END.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", by).replace("COPYRIGHT HOLDER OR", whom)
            out[name] += [text, re.sub(r"(?m)^[123]\. ", "* ", text)]
    return out


def _forms(name: str, text: str) -> list[str]:
    """A full text as it stands, without its appendix, with other addresses of its steward and other schemes of its links."""
    forms = [text]
    if end := _APPENDIX.search(text):
        closing = end.end() if end[1] is not None else end.start()
        forms += [text[:closing], text[: end.start()]]
    if name == "Apache-2.0":  # the appendix as filled in: its notice is a copyright line
        forms.append(re.sub(r"\n[^\n]*\[yyyy\][^\n]*", "", text))
    if name == "CC0-1.0":
        own = text[text.index("Statement of Purpose") :]
        forms += [own, f"CC0 1.0 Universal\n\n{own}", f"Creative Commons CC0 1.0 Universal\n\n{own}"]
    if name.startswith(("GPL", "LGPL")):
        forms += [_FSF_ADDRESS.sub(a, f) for f in forms for a in _FSF_ADDRESSES]
    return forms + [f.replace(a, b) for f in forms for a, b in (("http://", "https://"), ("https://", "http://"))]


def variants() -> list[tuple[str, str]]:
    """(license_id, text): every wording and form of the known licences and notices."""
    out = set(REGISTRY.items())
    for name, texts in _bodies().items():
        out |= {(name, head + text) for text in texts for head in ("", *(f"{h}\n\n" for h in HEADINGS[name]))}
    for file in resources.files(__package__).joinpath("license_texts").iterdir():
        name = file.name.removesuffix(".txt")
        out |= {(name, form) for form in _forms(name, file.read_text("utf-8"))}
    return sorted(out)


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    t = F.trim(F.regexp_replace(t, NOT_WORDS, " "))
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    for old, new in EQUIVALENT:  # a word that stands twice in a row needs two rounds
        padded = F.replace(F.replace(padded, F.lit(f" {old} "), F.lit(f" {new} ")), F.lit(f" {old} "), F.lit(f" {new} "))
    some = t.rlike(r"\b(" + "|".join(old for old, _ in EQUIVALENT) + r")\b")
    return F.when(some, F.trim(padded)).otherwise(t)


def registry(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, text) of the known licences: those given, or all of ``variants``."""
    return spark.createDataFrame(sorted(texts.items()) if texts else variants(), "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_licenses: int = BROADCAST_LICENSES) -> DataFrame:
    """(doc_id, n_canonical, digest, license_id), one row for each input row."""
    form = canonical(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), form.alias("form")).select("doc_id", F.length("form").cast("long").alias("n_canonical"), F.sha2("form", 256).alias("digest"))
    entries = known.where(F.length(canonical(F.col("text"))) > 0).groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    small = known.limit(broadcast_licenses + 1).count() <= broadcast_licenses
    return rows.join(F.broadcast(entries) if small else entries, "digest", "left").select("doc_id", "n_canonical", "digest", "license_id")
