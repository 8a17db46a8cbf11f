"""Licence scans by canonical digests (operator 2)."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Equivalent spellings, the left one becoming the right one (fixed values, after the public SPDX matching guidelines).
SPELLINGS = {
    "licence": "license", "sub-license": "sublicense", "sub license": "sublicense", "acknowledgement": "acknowledgment", "analogue": "analog",
    "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "maximise": "maximize", "modelled": "modeled",
    "noncommercial": "non commercial", "non-commercial": "non commercial", "optimise": "optimize", "organisation": "organization",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful", "https://": "http://", "per cent": "percent", "copyright owner": "copyright holder",
}
#: Lines that state a copyright, whole.
COPYRIGHT = r"(?:^|\n)[ \t]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Lower-cased letters outside A-Z stay as they are.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ZERO_BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
""" + _MIT[_MIT.index("THE SOFTWARE IS PROVIDED") :].replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Known texts, entire, by licence: full texts and the notices that stand for one.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT), ("ISC", _ISC), ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ZERO_BSD), ("0BSD", "Zero-Clause BSD\n" + _ZERO_BSD), ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <https://unlicense.org/>"), ("Unlicense", _UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", _BOOST), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BOOST),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)

#: Canonical digests of entire licence files: with and without what follows the terms, with and without a title (BSD).
#: Taken from /usr/share/common-licenses and the licence files of installed packages (packaging, requests, xxhash, pygments,
#: zstandard, idna, psutil). AGPL-3.0 and Unlicense are not among them.
FULL_TEXTS = (
    ("Apache-2.0", "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da"),
    ("Apache-2.0", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"),
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9"),
    ("BSD-2-Clause", "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "49cf0d0fa485e32b5c15753b9c8e5c55a3023a06b7a3b5dd83a6078c8b266725"),
    ("BSD-3-Clause", "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "ce1fbaffac9693dbaec03cc34ce3d04dc46f630d58e7bcbb6579c3f8277f0aa9"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0-only", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"),
    ("GPL-1.0-only", "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb"),
    ("GPL-1.0-only", "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a"),
    ("GPL-2.0-only", "178d586a448701f01712744f9de166175b5625d05f71dd532a3d694e2b935def"),
    ("GPL-2.0-only", "ae49934a47b15ec36e1ce1eb7504b3439c29f0e9be2ed0f60ba20ad7124dcb7c"),
    ("GPL-2.0-only", "c230c00f329737cb7ce3d97a266318b4c9d4c1fd321335e592b2ce1112179b88"),
    ("GPL-3.0-only", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),
    ("GPL-3.0-only", "3d4de016a08e1d98b27dec755cdf4530b92807d97aaa185b32e12d52942b1943"),
    ("GPL-3.0-only", "3dcf77ad8c25248618918aaff1de8a2cb80cea6ca922ef4a7a389cca96a7560b"),
    ("LGPL-2.0-only", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),
    ("LGPL-2.0-only", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    ("LGPL-2.0-only", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c"),
    ("LGPL-2.1-only", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c"),
    ("LGPL-2.1-only", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    ("LGPL-2.1-only", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)

#: What replaces what in turn, in Java's, Python's and RE2's dialect alike.
SPELL_STEPS = tuple((r"\b" + re.escape(a) + ("" if a.endswith("/") else r"\b"), b) for a, b in SPELLINGS.items())
STEPS = (
    (COPYRIGHT, ""),
    *SPELL_STEPS,
    (r"[!-/:-@\[-`{-~“”‘’–—]+", " "),
    (r"[ \t\n\x0B\f\r]+", " "),
)
_ANY_SPELLING = r"\b(?:" + "|".join(re.escape(a) for a in SPELLINGS) + ")"


def canonical_text(text: str) -> str:
    """The canonical form of a text, as ``canonical`` makes it of a column."""
    out = text.translate(str.maketrans(_UPPER, _LOWER))
    for pattern, by in STEPS:
        out = re.sub(pattern, by, out, flags=re.A)
    return out.strip(" ")


def digest_text(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def canonical(text: Column) -> Column:
    """ASCII lower case, without copyright lines, one spelling, punctuation and white space as single blanks."""
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), COPYRIGHT, "")
    spelled = out
    for pattern, by in SPELL_STEPS:
        spelled = F.regexp_replace(spelled, pattern, by)
    out = F.when(out.rlike(_ANY_SPELLING), spelled).otherwise(out)  # few texts hold any of them
    for pattern, by in STEPS[1 + len(SPELL_STEPS) :]:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def known_digests() -> dict[str, str]:
    """Digest -> licence; a fixed table."""
    return {digest_text(text): name for name, text in KNOWN} | {digest: name for name, digest in FULL_TEXTS}


#: A line without one of these, in whatever case, holds no known text: each of ``KNOWN`` has one, as have the licences of
#: ``FULL_TEXTS`` ("permitted" in the shortest of them, "licens" in the others); tests hold this against the texts.
HINTS = ("licens", "licenc", "cc0", "permi", "software")
_HINT = "|".join(HINTS)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the canonical whole text), license (that the whole text is), n_notices, notices.

    The whole text's canonical digest is hash-joined to the fixed table of known texts, which is broadcast (its rows are
    the entries of ``KNOWN`` and ``FULL_TEXTS``). Each line's digest is looked up in the same table: ``n_notices`` lines are known texts by
    themselves, ``notices`` lists their licences, distinct and sorted, comma-joined.

    Defined results: null and empty texts, and texts of nothing but copyright lines and punctuation, have the digest of
    the empty text and no licence; null doc_ids and repeated rows are rows like others; an empty table gives no rows;
    other columns are ignored.
    """
    known = known_digests()
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(sorted(known.items()), "__digest string, license string"))
    by_digest = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.lower(x).rlike(_HINT))
    found = F.filter(F.transform(lines, lambda x: by_digest[F.sha2(F.encode(canonical(x), "UTF-8"), 256)]), lambda x: x.isNotNull())
    out = pick(docs, "doc_id", "text").select("doc_id", F.sha2(F.encode(canonical(text), "UTF-8"), 256).alias("digest"), found.alias("__found"))
    out = out.join(table, F.col("digest") == F.col("__digest"), "left")
    return out.select("doc_id", "digest", "license", F.size("__found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("__found")), ",").alias("notices"))
