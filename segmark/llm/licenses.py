"""Licence scan: whole texts against known licences by the digest of a canonical form, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, after punctuation has become blanks.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authoris", "authoriz"), ("behaviour", "behavior"), ("catalogue", "catalog"), ("centre", "center"),
    ("colour", "color"), ("favour", "favor"), ("fulfill", "fulfil"), ("initialis", "initializ"), ("judgement", "judgment"),
    ("labell", "label"), ("labour", "labor"), ("non commercial", "noncommercial"), ("organis", "organiz"), ("per cent", "percent"),
    ("practise", "practice"), ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("utilis", "utiliz"),
    ("whilst", "while"), ("willful", "wilful"), ("https", "http"),
]
# A line that names a copyright and its year or sign, or that reserves all rights.
NOTICE = r"(^|\n)[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|<year>|[0-9]{4})|\(c\)[ \t]|©|all rights reserved\.?[ \t]*(?:\n|$))[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"

# The texts of licences and of their usual notices.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_LAST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_FIRST = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_LAST = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = [
    ("MIT", _GRANT),
    ("MIT", "MIT License\n\n" + _GRANT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_LAST),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_LAST),
    ("BSD-2-Clause", _BSD_FIRST + _BSD_LAST),
    ("BSD-3-Clause", _BSD_FIRST + _BSD_THIRD + _BSD_LAST),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("MIT notice", "Released under the MIT License."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0 notice", "This work is licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
]
# Digests of the canonical forms of whole licences that are too long to state here. Two of one name: with
# the appendix on how to apply it, and up to the end of its terms.
DIGESTS = [
    ("Apache-2.0", "84ed161685d232dab5187a7a7101279668d583e8fcead2d41433e4fd4a1dbe68"),
    ("Apache-2.0", "0b8c1a9e0ec99ab3b27e123e667fe4843df4dd7e6c667ccdc634dd6878c5dd6c"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "0a85ab25a52f42a58c2cc4bf76b4808eb5d0505467f60ad614ac4d676f443478"),
    ("GPL-3.0", "7d75204ed685fd08ff55e7de654cd69da831b4d875c3d2c2e69d04d738cccc3e"),
    ("LGPL-2.0", "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "c79a43890898fa82523112bbaa333007e51067add616404aa40df8240afd1f57"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
]


def canonical(text: Column) -> Column:
    """Lower case, copyright lines gone, punctuation and blanks one blank each, equivalent spellings made one.

    A null text is taken as the empty one.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOTICE, "$1")
    words = F.regexp_replace(plain, OTHER, " ")
    for own, common in SPELLINGS:
        words = F.replace(words, F.lit(own), F.lit(common))
    return F.trim(words)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """(license, text, digest): licences by their text, or by the digest of its canonical form where the text is null."""
    rows = [(name, text, None) for name, text in KNOWN] + [(name, None, digest) for name, digest in DIGESTS]
    return spark.createDataFrame(rows, "license string, text string, digest string")


def scan(docs: DataFrame, licenses: DataFrame, most_sent: int = 100_000) -> DataFrame:
    """(doc_id, digest, license): the licence whose canonical form the whole text has, or null.

    ``licenses`` (license, text) may hold several texts of one licence; a text of several licences has the first
    name in code point order. A column ``digest`` may stand in for null texts. Up to ``most_sent`` distinct licence texts are counted and sent to all tasks; more are
    joined by hash like any table. A text without words matches nothing. Every row of ``docs`` gives one row.
    """
    names = named(licenses, most_sent)
    return docs.select("doc_id", digest(F.col("text")).alias("digest")).join(names, "digest", "left").select("doc_id", "digest", "license")


#: What a text is cut at for each kind of part; a run is what stands between blank lines.
PARTS = {"line": r"\n", "run": r"\n[ \t\r]*\n"}


def parts(docs: DataFrame, licenses: DataFrame, most_sent: int = 100_000) -> DataFrame:
    """(doc_id, part, license, n): how many lines and runs of a document's text have the canonical form of a licence.

    ``part`` is line or run; only what is found gives rows, and rows of one id count together. Licences of several
    runs are found in a longer text only where it keeps them as one run.
    """
    names, text = named(licenses, most_sent), F.coalesce("text", F.lit(""))
    own = None
    for part, mark in PARTS.items():
        some = docs.select("doc_id", F.lit(part).alias("part"), F.explode(F.split(text, mark)).alias("text"))
        own = some if own is None else own.union(some)
    found = own.select("doc_id", "part", digest(F.col("text")).alias("digest")).join(names, "digest")
    return found.groupBy("doc_id", "part", "license").agg(F.count("*").alias("n"))


def named(licenses: DataFrame, most_sent: int) -> DataFrame:
    """(digest, license) of the texts that have words, marked for sending if they are few."""
    own, form = digest(F.col("text")), canonical(F.col("text"))
    if "digest" in licenses.columns:
        given = F.col("text").isNull() & F.col("digest").isNotNull()
        own, form = F.when(given, F.lower("digest")).otherwise(own), F.when(given, F.col("digest")).otherwise(form)
    names = licenses.select("license", own.alias("digest"), form.alias("form")).filter("form <> ''")
    names = names.groupBy("digest").agg(F.min("license").alias("license"))
    if names.limit(most_sent + 1).count() <= most_sent:
        names = F.broadcast(names)
    return names


def canonical_sql(text: str) -> str:
    """The canonical form in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = rf"regexp_replace(regexp_replace(lower(coalesce({text}, '')), {quote(NOTICE)}, '\1', 'g'), {quote(OTHER)}, ' ', 'g')"
    for own, common in SPELLINGS:
        out = f"replace({out}, {quote(own)}, {quote(common)})"
    return f"trim({out}, ' ')"


def _known_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    digests = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in DIGESTS)
    return f"""known as (
  select digest, min(license) as license
  from (select license, sha256({canonical_sql('text')}) as digest from (values {texts}) v(license, text)
        union all select license, digest from (values {digests}) v(license, digest)) group by digest
)"""


def scan_sql() -> str:
    return f"""
with {_known_sql()}, own as (select doc_id, sha256({canonical_sql('text')}) as digest from documents)
select doc_id, digest, license from own left join known using (digest)
"""


def parts_sql() -> str:
    cuts = " union all ".join(
        f"select doc_id, '{part}' as part, unnest(string_split_regex(text, '{mark}')) as text from documents where text is not null"
        for part, mark in PARTS.items()
    )
    return f"""
with {_known_sql()}, cuts as ({cuts}),
own as (select doc_id, part, sha256({canonical_sql('text')}) as digest from cuts)
select doc_id, part, license, count(*) as n from own join known using (digest) group by doc_id, part, license
"""
