"""Licence scans by canonical digests.

A text is normalised: lines of copyright notices go, letters become lower case, all but letters and digits
becomes one space, and spellings that licence matching counts as equal become one, word by word. Lines are normalised once, and the whole
text is made of them. The digest of the whole normalised text, and of each of its lines, is then joined to the digests of known licences and notices. The
known table is fixed and small, so it is broadcast. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents

#: Spellings that the SPDX matching guidelines count as equal (a part), each with its main form.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("licenced", "licensed"), ("licences", "licenses"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

#: Notices of one line, by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
]

#: Short licences in full, by SPDX identifier: title, and the text below the copyright notice.
TEXTS = [
    ("ISC", "ISC License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", "BSD Zero Clause License", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "MIT License", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT-0", "MIT No Attribution", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", "BSD 2-Clause License", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", "BSD 3-Clause License", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", "zlib License", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", "The Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <http://unlicense.org/>"""),
]

#: SHA-256 digests of the normalised whole texts of longer licences, as Linux distributions ship them.
DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3-only", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]

#: Known texts: the notices, and the licences with their titles and without.
KNOWN = NOTICES + [(a, f"{title}\n{text}") for a, title, text in TEXTS] + [(a, text) for a, _, text in TEXTS]

#: A line that is a copyright notice by its form: the word or sign with a year, a sign or a blank to fill in.
COPYRIGHT = r"^\s*([*#/;-]+\s*)?(copyright\s*:?\s*(\(c\)|©|[0-9]{4}|[<{\[(]\s*(year|yyyy|date))|(\(c\)|©)\s*(copyright|[0-9]{4}|[<{\[(]\s*(year|yyyy|date))|all rights reserved[.\s]*$)"


def _plain(line: Column) -> Column:
    """Letters and digits of a line in lower case, other characters as single spaces; empty for a copyright notice."""
    low = F.lower(line)
    return F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")))


#: Words that begin an equal spelling: a text without them is left as it is.
_SOME = "|".join(dict.fromkeys(a.split()[0] for a, _ in EQUIVALENT))


def _spelt(plain: Column) -> Column:
    """Equal spellings made one, word by word: each word has two spaces of its own, so neighbours are replaced too."""
    said = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in EQUIVALENT:
        said = F.replace(said, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(said, F.lit("  "), F.lit(" ")))


def _canonical(lines: Column) -> tuple[Column, Column]:
    """The normalised forms of a text and of its lines, from the lines' plain ones. Most texts have no other spellings."""
    whole = F.array_join(F.filter(lines, lambda x: x != ""), " ")
    other = whole.rlike(rf"\b({_SOME})")
    return F.when(other, _spelt(whole)).otherwise(whole), F.when(other, F.transform(lines, lambda x: F.when(x.rlike(rf"\b({_SOME})"), _spelt(x)).otherwise(x))).otherwise(lines)


def canonical(text: Column) -> Column:
    """The normalised form of a whole text; null stays null."""
    return _canonical(F.transform(F.split(text, "\n"), _plain))[0]


def known(spark: SparkSession) -> DataFrame:
    """(license, digest) of KNOWN, by the same normalisation, and of DIGESTS."""
    table = spark.range(len(KNOWN)).select(F.element_at(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in KNOWN]), F.col("id").cast("int") + 1).alias("k"))
    texts = table.select("k.license", F.sha2(canonical(F.col("k.text")), 256).alias("digest"))
    rest = spark.range(len(DIGESTS)).select(F.element_at(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("digest")) for a, b in DIGESTS]), F.col("id").cast("int") + 1).alias("k")).select("k.license", "k.digest")
    return texts.union(rest).distinct()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, license (of the whole text, or null), n_lines (lines that are a notice), licenses.

    ``licenses`` names all that were found, in order, with commas; it is empty for most texts, as for null
    and empty ones. Rows of equal ids or texts are judged each; an empty table gives an empty table.
    """
    spark = df.sparkSession
    table = F.broadcast(known(spark))  # fixed: one row per entry of KNOWN and DIGESTS
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), _plain)
    rows = df.select(F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n")).alias("row"), lines.alias("lines"))
    whole, said = _canonical(F.col("lines"))
    rows = rows.select("row", whole.alias("whole"), said.alias("said"))
    unit = lambda whole, x: F.struct(F.lit(whole).alias("whole"), x.alias("text"))
    units = F.concat(F.array(unit(True, F.col("whole"))), F.transform("said", lambda x: unit(False, x)))
    each = rows.select("row", F.explode(units).alias("u")).select("row", "u.whole", F.sha2("u.text", 256).alias("digest"))
    hits = each.join(table, "digest", "left")
    found = hits.groupBy("row").agg(F.min(F.when(F.col("whole"), F.col("license"))).alias("license"), F.count_if(~F.col("whole") & F.col("license").isNotNull()).alias("n_lines"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"))
    return found.select(F.col("row.id").alias(id_col), "license", "n_lines", "licenses")


def op6_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan(documents(spark, sf_dir))


def _sql_plain(line: str) -> str:
    return f"case when regexp_matches(lower({line}), '{COPYRIGHT}') then '' else trim(regexp_replace(lower({line}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) end"


def _sql_spelt(plain: str) -> str:
    said = f"' ' || replace({plain}, ' ', '  ') || ' '"
    for a, b in EQUIVALENT:
        said = f"replace({said}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"trim(replace({said}, '  ', ' '))"


def oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values, digests = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN), ", ".join(f"({q(a)}, {q(b)})" for a, b in DIGESTS)
    lines = lambda text: f"list_transform(string_split({text}, chr(10)), lambda x: {_sql_plain('x')})"
    joined = lambda lines: f"array_to_string(list_filter({lines}, lambda x: x <> ''), ' ')"
    return f"""
    with known as (select distinct license, sha256({_sql_spelt(joined(lines('t')))}) as digest from (values {values}) v(license, t) union select * from (values {digests}) w(license, digest)),
    plain as (select doc_id, {lines('text')} as lines from documents where text is not null),
    units as (select doc_id, true as whole, {joined('lines')} as t from plain union all select doc_id, false, unnest(lines) from plain),
    hits as (select doc_id, whole, license from (select doc_id, whole, sha256({_sql_spelt('t')}) as digest from units) join known using (digest)),
    found as (select doc_id, min(license) filter (whole) as license, count(*) filter (not whole) as n_lines, array_to_string(list_sort(list(distinct license)), ',') as licenses from hits group by doc_id)
    select d.doc_id, f.license, coalesce(f.n_lines, 0) as n_lines, coalesce(f.licenses, '') as licenses from documents d left join found f using (doc_id)"""
