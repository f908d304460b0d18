"""Operator 7: licence scans by canonical digest, with DataFrame functions only.

A whole text is brought to a canonical form: lower case, no copyright lines, no
title line, one spelling of equivalent words, words only.  Its SHA-256 is looked
up among the digests of known licences by a hash join.  The list here holds short
licences and the notices of long ones; ``licence_files`` reads whole long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Whole texts of known licences, by SPDX identifier.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

_GNU = """This {what} is free software{semi} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{version}.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}{end}"""
_LATER = "; either version {}, or (at your option) any later version"
_STREET = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_GENERAL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"


def _gnu(name: str, version: str, end: str, what: str = "program") -> str:
    return _GNU.format(what=what, semi=";" if end == _STREET else ":", name=name, version=version, end=end)


_MIT_HEAD = TEXTS["MIT"].split("\n")[0]
_MIT_TAIL = TEXTS["MIT"].split("\n")[2]
_AS_IS_SHORT = 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.'

TEXTS |= {
    "MIT-0": _MIT_HEAD.replace(", subject to the following conditions:", ".") + "\n" + _MIT_TAIL,
    "X11": TEXTS["MIT"].replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM") + "\nExcept as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    "JSON": TEXTS["MIT"].replace("\nTHE SOFTWARE IS", "\nThe Software shall be used for Good, not Evil.\nTHE SOFTWARE IS"),
    "NCSA": _MIT_HEAD.replace("this software and associated documentation files (the \"Software\"), to deal in", "this software and associated documentation files (the \"Software\"), to deal with") + """
* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers.
* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution.
* Neither the names of the copyright holders, nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.
""" + _MIT_TAIL.replace("AUTHORS OR COPYRIGHT HOLDERS", "CONTRIBUTORS OR COPYRIGHT HOLDERS").replace("DEALINGS IN THE SOFTWARE", "DEALINGS WITH THE SOFTWARE"),
    "BSD-1-Clause": _BSD_HEAD.split("\n2.")[0] + "\n" + _BSD_TAIL,
    "BSD-4-Clause": _BSD_HEAD + "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.\n" + _BSD_THIRD.replace("3.", "4.") + _BSD_TAIL,
    "BSD-3-Clause-Clear": _BSD_HEAD.replace("are permitted provided", "are permitted (subject to the limitations in the disclaimer below) provided") + _BSD_THIRD + "NO EXPRESS OR IMPLIED LICENSES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICENSE. " + _BSD_TAIL,
    "BSD-2-Clause-Views": _BSD_HEAD + _BSD_TAIL + "\nThe views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies, either expressed or implied, of the copyright holders or contributors.",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "WTFPL": """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO.""",
    "curl": """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.""",
    "FSFAP": "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    "Fair": 'Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument.\nDISCLAIMER: THE WORKS ARE WITHOUT WARRANTY.',
    "NTP": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies and that both the copyright notice and this permission notice appear in supporting documentation, and that the name (TrademarkedName) not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission. (TrademarkedName) makes no representations about the suitability this software for any purpose. It is provided \"as is\" without express or implied warranty.",
    "Zlib-acknowledgement": _AS_IS_SHORT + """
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment (see the following) in the product documentation is required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    # the notices by which longer licences are applied to a work
    "Apache-2.0 notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-only notice": _gnu(_GENERAL, "; version 2", _STREET),
    "GPL-2.0-or-later notice": _gnu(_GENERAL, _LATER.format("2 of the License"), _STREET),
    "GPL-3.0-only notice": _gnu(_GENERAL, ", version 3", _SEE),
    "GPL-3.0-or-later notice": _gnu(_GENERAL, ", either version 3 of the License, or (at your option) any later version", _SEE),
    "LGPL-2.1-only notice": _gnu(_LESSER, "; version 2.1", _STREET, "library"),
    "LGPL-2.1-or-later notice": _gnu(_LESSER, _LATER.format("2.1 of the License"), _STREET, "library"),
    "LGPL-3.0-or-later notice": _gnu(_LESSER, ", either version 3 of the License, or (at your option) any later version", _SEE),
    "AGPL-3.0-only notice": _gnu(_AFFERO, ", version 3", _SEE),
    "AGPL-3.0-or-later notice": _gnu(_AFFERO, ", either version 3 of the License, or (at your option) any later version", _SEE),
    "CC0-1.0 notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.\nYou should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
}

#: (pattern, replacement), in order; what both regular expression dialects share.  No
#: pattern can run over the end of a line and fail, so time is in proportion to length.
STEPS = (
    # 'copyright' within a sentence, at the start of a wrapped line, is no notice
    (r"\bcopyright([^\S\n]+)(notice|holder|owner|law|statement|licen|interest|and |or |in |is |as |of |to |for )", "copyright_$1$2"),
    (r"(?m)^[^\p{L}\n]*copyright[^_\n\p{L}][^\n]*[\p{L}\p{N}][^\n]*$", " "),
    (r"(?m)^[^\p{L}\n]*(\(c\)|©)[^\p{L}\n]*[0-9]{4}[^\n]*$", " "),
    (r"(?m)^[^\p{L}\n]*all rights reserved[^\n]*$", " "),
    # a title: a short first line that names a licence, if text follows it
    (r"^\s*[^\n(\x22;]{0,60}\blicen[cs]e( *\([^()\n]{0,30}\))?[^\p{L}\n]{0,20}\n", " "),
    (r"(?m)^[^\S\n]*([0-9]{1,2}[.)]|[*•-])[^\S\n]", " "),
    (r"[^\p{L}\p{N}]+", " "),
    (r"\b(sub |sub)?licence", "$1license"),
    (r"\b(sub|non) (licen|infringement|commercial|exclusive)", "$1$2"),
    (r"\b(acknowledg|judg)ement", "$1ment"),
    (r"\b(author|organ|recogn|util|public|initial|custom)is(e|ing|ation)", "$1iz$2"),
    (r"\b(fav|lab|hon|neighb)our", "$1or"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bhttps? (www )?", "http "),
    (r"\bmerchantibility\b", "merchantability"),
    (r"^ +| +$", ""),
)


def canonical(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def licence_files(spark: SparkSession, path: str) -> DataFrame:
    """(licence, digest) of a folder of licence texts, such as a copy of a public list, named by file name without extension."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("text"))
    return files.select(F.regexp_replace("file", r"\.[^.0-9][^.]*$", "").alias("licence"), digest(F.col("text")).alias("digest"))


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(licence, digest) of the known texts: a table as long as the list in this module."""
    rows = spark.createDataFrame(sorted((texts or TEXTS).items()), "licence string, text string")
    return rows.select("licence", digest(F.col("text")).alias("digest"))


def scan_licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest and licence (null if none) for each row of ``docs``.

    Only a text that is a licence as a whole matches.  Null and empty texts have the
    digest of the empty text, which is no licence's.  The join is broadcast only
    for the list of this module, whose size is fixed; a larger ``known`` table is
    joined as Spark chooses.  Repeated rows stay; further columns are ignored.
    """
    listed = F.broadcast(known_digests(docs.sparkSession)) if known is None else known.select("licence", "digest")
    rows = docs.select("doc_id", digest(F.col("text")).alias("digest"))
    return rows.join(listed.groupBy("digest").agg(F.min("licence").alias("licence")), "digest", "left").select("doc_id", "digest", "licence")
