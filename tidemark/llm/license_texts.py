"""Licence names, and the wordings by which texts are placed under them.

A record says which wordings stand for a licence. `marks` is a pattern that a matching segment of
the text must hold, in lower case, so that close relatives (versions, lesser, affero, share-alike)
are told apart; `scope` and `without` are patterns that the whole text must and must not hold, for
licences that differ by a clause only. Short statements, titles and tags are built from `titles`
and `ids` by rule; `texts` are the licences' own notices, or their opening where they are long.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class License:
    name: str
    marks: str
    titles: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    scope: str = ""
    without: str = ""


@dataclass(frozen=True)
class Template:
    name: str
    text: str
    marks: str
    scope: str = ""
    without: str = ""
    tag: bool = field(default=False)


# Wordings of public licences.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:"""
_BSD_ONE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer."""
_BSD_TWO = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THREE = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_REST = """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
for the specific language governing permissions and limitations under the License."""
_FREE_SOFTWARE = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU
{kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at
your option) any later version."""
_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General
Public License version {version} as published by the Free Software Foundation."""
_EVERYONE = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GPL3_PREAMBLE = """The GNU {kind}General Public License is a free, copyleft license for software and other kinds of works{end}"""

_GNU_BARS = r"(?!.*(lesser|library general|affero|lgpl|agpl))"
_V2, _V3 = r"(version 2(?![.\d])|v\.? ?2(?!\.1|\d)|gpl[- ]?v?2(?!\.1|\d))", r"(version 3(?!\d)|v\.? ?3(?!\d)|gpl[- ]?v?3(?!\d)|license 3(?!\d))"


def _gnu(kind: str, version: str) -> tuple[str, ...]:
    return tuple(_FREE_SOFTWARE.format(colon=c, kind=kind, version=version) for c in (":", ";")) + (_ONLY.format(kind=kind, version=version),)


LICENSES = [
    License(
        "Apache-2.0",
        r"apache.{0,60}?(version 2|license,? v?2|-2\.0|2\.0)",
        ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"),
        ("Apache-2.0",),
        (
            _APACHE_NOTICE,
            f"{_APACHE_NOTICE} {_APACHE_REST}",
            "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
            "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        ),
    ),
    License(
        "BSD-2-Clause",
        r"redistribution and use in source and binary forms|bsd[ -]?2|2[ -]clause|two[ -]clause|simplified bsd|freebsd license",
        ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"),
        ("BSD-2-Clause",),
        (_BSD_GRANT, f"{_BSD_GRANT} 1. {_BSD_ONE} 2. {_BSD_TWO}", f"{_BSD_GRANT} 1. {_BSD_ONE} 2. {_BSD_TWO} {_BSD_WARRANTY}"),
        without=r"endorse or promote|mentioning features or use",
    ),
    License(
        "BSD-3-Clause",
        r"redistribution and use in source and binary forms|endorse or promote products|bsd[ -]?3|3[ -]clause|three[ -]clause|(new|revised|modified) bsd",
        ("BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD license"),
        ("BSD-3-Clause",),
        (_BSD_GRANT, _BSD_THREE, f"{_BSD_GRANT} 1. {_BSD_ONE} 2. {_BSD_TWO} 3. {_BSD_THREE}", f"{_BSD_GRANT} 1. {_BSD_ONE} 2. {_BSD_TWO} 3. {_BSD_THREE} {_BSD_WARRANTY}"),
        scope=r"endorse or promote|bsd[ -]?3|3[ -]clause|three[ -]clause|(new|revised|modified) bsd",
        without=r"mentioning features or use",
    ),
    License(
        "BSD-3-Clause",
        r"governed by a bsd-style license",
        texts=("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    ),
    License(
        "MIT",
        r"permission is hereby granted, free of charge|\bmit licen[cs]e|licen[cs]e: *mit\b|licen[cs]ed under (the )?mit\b",
        ("MIT License", "MIT license"),
        ("MIT",),
        (
            "License: MIT",
            _MIT_GRANT,
            f"{_MIT_GRANT} {_MIT_NOTICE}",
            f"MIT License {_MIT_GRANT} {_MIT_NOTICE} {_WARRANTY}",
        ),
    ),
    License(
        "ISC",
        r"permission to use, copy, modify,? and(/or)? distribute this software for any purpose|\bisc licen[cs]e",
        ("ISC License",),
        ("ISC",),
        (_ISC_GRANT + _ISC_NOTICE, f"ISC License {_ISC_GRANT}{_ISC_NOTICE} {_ISC_WARRANTY}"),
        scope=r"appear in all copies|\bisc licen[cs]e",
    ),
    License(
        "0BSD",
        r"permission to use, copy, modify,? and(/or)? distribute this software for any purpose|zero[ -]clause|\b0bsd",
        ("Zero-Clause BSD license", "BSD Zero Clause License"),
        ("0BSD",),
        (f"{_ISC_GRANT}.", f"{_ISC_GRANT}. {_ISC_WARRANTY}"),
        without=r"appear in all copies",
    ),
    License(
        "Unlicense",
        r"free and unencumbered software|\bunlicense\b",
        ("Unlicense", "The Unlicense"),
        ("Unlicense",),
        (
            "This is free and unencumbered software released into the public domain.",
            """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
            publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
            binary, for any purpose, commercial or non-commercial, and by any means.""",
        ),
    ),
    License(
        "Zlib",
        r"plainly marked|must not be misrepresented|\bzlib licen[cs]e|provided 'as-is'",
        ("zlib License",),
        ("Zlib",),
        (
            """Permission is granted to anyone to use this software for any purpose, including commercial applications,
            and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
            software must not be misrepresented; you must not claim that you wrote the original software. If you use
            this software in a product, an acknowledgment in the product documentation would be appreciated but is not
            required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
            the original software. 3. This notice may not be removed or altered from any source distribution.""",
            """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
            be held liable for any damages arising from the use of this software.""",
            """The origin of this software must not be misrepresented; you must not claim that you wrote the original
            software. If you use this software in a product, an acknowledgment in the product documentation would be
            appreciated but is not required.""",
            "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        ),
    ),
    License(
        "BSL-1.0",
        r"boost software license",
        ("Boost Software License, Version 1.0",),
        ("BSL-1.0",),
        (
            "Boost Software License - Version 1.0 - August 17th, 2003",
            "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        ),
    ),
    License(
        "MPL-2.0",
        r"(mozilla public license|\bmpl).{0,20}?2(\.0)?",
        ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
        ("MPL-2.0",),
        (
            """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
            not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Mozilla Public License Version 2.0 1. Definitions",
        ),
    ),
    License("MPL-1.1", r"mozilla public license.{0,20}?1\.1", ("Mozilla Public License, version 1.1",), ("MPL-1.1",)),
    License(
        "EPL-2.0",
        r"(eclipse public license|\bepl).{0,20}?2(\.0)?",
        ("Eclipse Public License 2.0", "Eclipse Public License - v 2.0"),
        ("EPL-2.0",),
        (
            """This program and the accompanying materials are made available under the terms of the Eclipse Public License
            2.0 which is available at https://www.eclipse.org/legal/epl-2.0/""",
            """THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE,
            REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT.
            Eclipse Public License - v 2.0""",
        ),
    ),
    License(
        "EPL-1.0",
        r"(eclipse public license|\bepl).{0,20}?1\.0",
        ("Eclipse Public License 1.0", "Eclipse Public License - v 1.0"),
        ("EPL-1.0",),
        ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which is available at http://www.eclipse.org/legal/epl-v10.html",),
    ),
    License(
        "GPL-2.0",
        _GNU_BARS + rf"(?=.*(general public|gpl))(?=.*{_V2})",
        ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GNU GPL version 2"),
        ("GPL-2.0",),
        (*_gnu("", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 {_EVERYONE}"),
    ),
    License(
        "GPL-3.0",
        _GNU_BARS + rf"(?=.*(general public|gpl))(?=.*{_V3})",
        ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GNU GPL version 3"),
        ("GPL-3.0",),
        (*_gnu("", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_EVERYONE}"),
    ),
    License(
        "LGPL-2.0",
        rf"(?=.*library general public)(?=.*{_V2})",
        ("GNU Library General Public License, version 2",),
        ("LGPL-2.0",),
        (*_gnu("Library ", "2"), "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ),
    License(
        "LGPL-2.1",
        r"(?=.*(lesser|lgpl))(?=.*2\.1)",
        ("GNU Lesser General Public License, version 2.1", "LGPL 2.1", "LGPLv2.1"),
        ("LGPL-2.1",),
        (*_gnu("Lesser ", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 {_EVERYONE}"),
    ),
    License(
        "LGPL-3.0",
        rf"(?=.*(lesser|lgpl))(?=.*{_V3})",
        ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
        ("LGPL-3.0",),
        (*_gnu("Lesser ", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_EVERYONE}"),
    ),
    License(
        "AGPL-3.0",
        rf"(?=.*(affero|agpl))(?=.*{_V3})",
        ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
        ("AGPL-3.0",),
        (*_gnu("Affero ", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_EVERYONE}"),
    ),
    License(
        "CC0-1.0",
        r"\bcc0\b|waived all copyright",
        ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
        ("CC0-1.0",),
        (
            "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
            "Creative Commons Legal Code CC0 1.0 Universal",
            "CC0 public domain dedication",
        ),
    ),
]


def _creative_commons() -> list[License]:
    """Attribution licences by rule: each set of terms in each version."""
    words = {"sa": ("ShareAlike", r"share[ -]?alike|\b(by|nc)[ -]sa\b"), "nc": ("NonCommercial", r"non[ -]?commercial|\bby[ -]nc\b"), "nd": ("NoDerivatives", r"no[ -]?deriv|\b(by|nc)[ -]nd\b")}
    out = []
    for terms in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            short = "-".join(["BY", *(t.upper() for t in terms)])
            long = "-".join(["Attribution", *(words[t][0] for t in terms)])
            kind = "International" if version == "4.0" else "Unported"
            there = "".join(rf"(?=.*({words[t][1]}))" for t in terms)
            not_there = "".join(rf"(?!.*({words[t][1]}))" for t in words if t not in terms)
            titles = (f"CC {short} {version}", f"CC-{short}-{version} license", f"Creative Commons {long} {version} {kind} License", f"Creative Commons {long} {version} license")
            texts = (f"Attribution{long.removeprefix('Attribution')} {version} {kind}", f"Creative Commons {long} {version} {kind} Public License")
            marks = not_there + there + rf"(?=.*{version.replace('.', '[.]')})(?=.*(creative commons|\bcc[ -]by|attribution))"
            out.append(License(f"CC-{short}-{version}", marks, titles, (f"CC-{short}-{version}",), texts))
    return out


#: Ways to say that a work is under a licence, by its title.
_FORMS = (
    "{}",
    "Released under the {}.",
    "Licensed under {}.",
    "Licensed under the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "This project is licensed under the {} - see the LICENSE file for details.",
    "Distributed under the terms of the {}.",
    "This software is made available under the {}.",
)


def templates() -> list[Template]:
    out = []
    for record in [*LICENSES, *_creative_commons()]:
        wordings = [*record.texts, *(form.format(title) for title in record.titles for form in _FORMS)]
        out += [Template(record.name, " ".join(w.split()), record.marks, record.scope, record.without) for w in dict.fromkeys(wordings)]
        for own in record.ids:
            for spelt in (own, *((f"{own}-only", f"{own}-or-later", f"{own}+") if "GPL" in own else ())):
                out.append(Template(record.name, f"SPDX-License-Identifier: {spelt}", rf"spdx-license-identifier:.*(?<![\w.+-]){spelt.lower().replace('.', '[.]').replace('+', '[+]')}(?![\w.+-])", tag=True))
    return out
