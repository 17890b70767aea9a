"""License scan by canonical digests.

A text is brought to a canonical form: A-Z lower-cased, copyright lines dropped, equivalent
spellings made one, punctuation and white space (and with them comment marks) reduced to single
blanks. The SHA-256 of an entire text is then joined to the digests of known license texts and
notices. Entire texts are the documents, the same without lines that are a license's title or
reserve all rights, and, as notices stand on lines of their own, every one of their lines.

A copyright line is one that begins, behind comment marks at most, with ``copyright`` and has a year,
``(c)`` or the sign, or with one of the latter two and has a year: a sentence of a license that is
wrapped at the word ``copyright`` stays.
"""

from __future__ import annotations

import hashlib
import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as one: fixed values.
SPELLINGS = (("sublicence", "sublicense"), ("licence", "license"), ("organisation", "organization"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("copyright holder", "copyright owner"), ("per cent", "percent"))

#: Lines that are a license's title, or that reserve all rights, in canonical form: fixed values.
TITLES = (
    "mit license", "the mit license", "the mit license mit", "mit license mit", "expat license", "isc license", "the isc license", "isc license isc", "bsd 2 clause license", "the bsd 2 clause license", "bsd 2 clause simplified license", "simplified bsd license",
    "bsd 3 clause license", "the bsd 3 clause license", "bsd 3 clause new or revised license", "new bsd license", "modified bsd license", "bsd license", "the bsd license", "bsd zero clause license", "zero clause bsd", "zlib license", "the zlib license", "mit no attribution", "the unlicense", "all rights reserved",
)

#: Known texts: fixed values. Notices first, then whole short licenses.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
)

#: SHA-256 of the canonical form of whole license files as their stewards publish them: fixed values.
PUBLISHED = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127"),
    ("GFDL-1.3", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "42de4913c0ec220db6e274a84efcdc7a52715762d22943334032232048072bc1"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copyright lines; a line ends at a line feed alone.
_COPYRIGHT = r"(?m)^[ \t\r#*/;%!<>.-]*(dnl |rem )?[ \t]*(copyright[^\n]*([0-9][0-9][0-9][0-9]|\(c\)|©|yyyy|<year>)|(\(c\)|©)[^\n]*[0-9][0-9][0-9][0-9])[^\n]*$"
_BREAKS = r"[\s!-/:-@\[-`{-~“”‘’–—©]+"


#: The same without the line feed, so that a text is brought to its form once and its lines are still there.
_BREAKS_IN_LINE = _BREAKS.replace(r"\s", r" \t\x0B\f\r")


def _spelled(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _in_lines(text: Column) -> Column:
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), _COPYRIGHT.replace("(?m)", "(?md)"), " ")
    return F.regexp_replace(out, _BREAKS_IN_LINE, " ")


def canonical(text: Column) -> Column:
    return _whole(_in_lines(text))


def _whole(lines: Column) -> Column:
    return _spelled(F.trim(F.regexp_replace(lines, "[ \n]+", " ")))


def _each(lines: Column) -> Column:
    return F.transform(F.split(lines, "\n"), lambda x: _spelled(F.trim(x)))


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line."""
    return _each(_in_lines(text))


def _bare(lines: Column) -> Column:
    """From canonical lines, the text without titles."""
    return _spelled(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin(*TITLES)), " "))


def canonical_text(text: str) -> str:
    """The same form on the driver, for the known texts."""
    out = re.sub(_COPYRIGHT, " ", text.translate(str.maketrans(_UPPER, _LOWER)))
    out = re.sub(_BREAKS, " ", out, flags=re.ASCII).strip(" ")
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def bare_text(text: str) -> str:
    """The canonical form without title lines, on the driver."""
    lines = re.sub(_COPYRIGHT, " ", text.translate(str.maketrans(_UPPER, _LOWER))).split("\n")
    out = " ".join(x for x in map(canonical_text, lines) if x and x not in TITLES)
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    return out


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: What tells the digest of a text without titles from that of a whole text.
_MARK = "without titles: "


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """``(digest, license)``, one row per digest; of texts with one form the first listed names it (the least name, in a table)."""
    if isinstance(known, DataFrame):
        text = known.filter("text is not null").select("license", _in_lines(F.col("text")).alias("lines"))
        forms = text.select("license", F.explode(F.array(_whole(F.col("lines")), F.concat(F.lit(_MARK), _bare(_each(F.col("lines")))))).alias("form")).filter(F.col("form") != _MARK)
        return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))
    rows = {d: name for name, d in PUBLISHED} if known is KNOWN else {}
    for name, t in reversed(known):
        rows[_sha(canonical_text(t))] = name
        if bare := bare_text(t):
            rows[_sha(_MARK + bare)] = name
    return F.broadcast(spark.createDataFrame(sorted(rows.items()), "digest string, license string"))  # a list in this process: small


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Sequence[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """Per row ``doc_id, digest, license, notices, n_notices``.

    ``known`` is a list of ``(license, text)`` or a table with these columns, of any size. ``digest``
    is the canonical whole text's, ``license`` the known text it is, if need be without its titles,
    else null; ``notices`` are the
    names of known texts that are lines of it, sorted, joined by ``;``. Null text has a null digest
    and no notices; empty text has the digest of nothing. Rows that repeat are each answered; extra
    columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("same"), (F.col("text") == "").alias("blank"), _in_lines(F.col("text")).alias("flat"))
    rows = rows.select("doc_id", "same", "blank", _whole(F.col("flat")).alias("whole"), F.coalesce(_each(F.col("flat")), F.array().cast("array<string>")).alias("lines"))
    # Place 0 is the whole text, 1 the same without titles, the others its lines: one scan, and only digests are joined and grouped.
    bare = F.concat(F.lit(_MARK), _bare(F.col("lines")))
    entire = F.concat(F.array("whole", F.when(bare != _MARK, bare)), F.filter("lines", lambda x: x != ""))
    digests = rows.select("doc_id", "same", "blank", F.posexplode(F.transform(entire, lambda x: F.sha2(x, 256))).alias("place", "digest")).filter("place = 0 or digest is not null")
    found = digests.join(known_digests(docs.sparkSession, known), "digest", "left").filter("place = 0 or license is not null and not blank")
    at = F.col("place")
    out = found.groupBy("doc_id", "same").agg(
        F.max(F.when(at == 0, F.col("digest"))).alias("digest"), F.coalesce(F.max(F.when(at == 0, F.col("license"))), F.max(F.when(at == 1, F.col("license")))).alias("license"),
        F.sort_array(F.collect_set(F.when(at > 1, F.col("license")))).alias("names"), F.count_if(at == 0).alias("copies"),
    )
    return out.select("doc_id", "digest", "license", F.array_join("names", ";").alias("notices"), F.size("names").cast("long").alias("n_notices"), F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col")


def oracle(known=KNOWN) -> str:
    """The same rows in DuckDB SQL."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), {quoted(_COPYRIGHT)}, ' ', 'g')"
        out = f"trim(regexp_replace({out}, {quoted(_BREAKS)}, ' ', 'g'), ' ')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    titles = ", ".join(map(quoted, TITLES))
    cut = lambda x: f"regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), {quoted(_COPYRIGHT)}, ' ', 'g')"

    def spelled(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, '{a}', '{b}')"
        return x

    bare = lambda x: spelled(f"list_aggregate(list_filter(list_transform(string_split({cut(x)}, chr(10)), lambda l: {form('l')}), lambda l: l <> '' and l not in ({titles})), 'string_agg', ' ')")
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(known))
    more = "".join(f" union all select {len(known) + i}, {quoted(n)}, '{d}'" for i, (n, d) in enumerate(PUBLISHED)) if known is KNOWN else ""
    return f"""with texts(pos, license, text) as (values {rows}),
forms as (select pos, license, sha256({form('text')}) as digest from texts union all select pos, license, sha256('{_MARK}' || {bare('text')}) from texts where coalesce({bare('text')}, '') <> ''{more}),
known as (select digest, arg_min(license, pos) as license from forms group by digest),
docs as (select row_number() over () as rid, doc_id, text, sha256({form('text')}) as digest, sha256('{_MARK}' || nullif({bare('text')}, '')) as bare from documents),
lines as (select rid, unnest(string_split(text, chr(10))) as line from docs),
found as (select rid, string_agg(distinct license, ';' order by license) as notices, count(distinct license) as n
  from lines join known on sha256({form('line')}) = known.digest where line <> '' group by rid)
select d.doc_id, d.digest, coalesce(k.license, b.license) as license, coalesce(f.notices, '') as notices, coalesce(f.n, 0)::bigint as n_notices
from docs d left join known k on d.digest = k.digest left join known b on d.bare = b.digest left join found f on f.rid = d.rid"""
