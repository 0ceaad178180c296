"""Further license templates: names with versions, notices, short full texts; long full texts lie in ``licenses/``."""

from __future__ import annotations

from pathlib import Path

#: Words that name one license and not its neighbours: a run may not hold one more often than the template has it.
NAMES = frozenset(
    "0bsd affero agpl agplv3 apache artistic boost bsd cc0 cddl clause eclipse epl eupl gfdl gpl gplv2 gplv3 isc lesser lgpl lgplv2"
    " lgplv3 mit mozilla mpl nc nd noncommercial noderivatives noderivs ofl sa sharealike unlicense wtfpl zlib".split()
)
#: Of a short form these words, the NAMES and all numbers must be matched.
IDENTITY = frozenset(
    "attribution bsl cc creative development european font general gnu modified new original psf public python simplified"
    " spdx zero".split()
)
#: Words of a longer license whose text holds all of a shorter one: no run of the shorter one may hold them.
LONGER = {"0BSD": ("appear",), "BSD-2-Clause": ("endorse", "advertising"), "BSD-3-Clause": ("advertising",), "MIT-0": ("portions",)}

#: license: the names that a work gives it after "licensed under the" and the like.
_CALLED = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPL 3.0", "AGPLv3"],
    "Apache-1.1": ["Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "Artistic-1.0": ["Artistic License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"],
    "0BSD": ["Zero-Clause BSD License", "0BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "CDDL-1.0": ["Common Development and Distribution License, version 1.0", "CDDL 1.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0", "EPL 1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "EPL 2.0"],
    "EUPL-1.2": ["European Union Public Licence, version 1.2", "EUPL 1.2"],
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2", "GFDL 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3", "GFDL 1.3"],
    "GPL-1.0": ["GNU General Public License, version 1"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL version 2", "GPL 2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL version 3", "GPL 3.0", "GPLv3"],
    "ISC": ["ISC License"],
    "LGPL-2.0": ["GNU Library General Public License, version 2"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPL 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPL 3.0", "LGPLv3"],
    "MIT": ["MIT License"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "OFL 1.1"],
    "PSF-2.0": ["Python Software Foundation License, version 2"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL"],
    "Zlib": ["zlib License"],
}
_CC = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
_CC_KINDS = ("BY", "BY-NC", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")
_VERBS = ("licensed under the", "released under the", "distributed under the", "available under the")

_GNU = (
    "{this} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public"
    " License as published by the Free Software Foundation; either version {version} of the License, or (at your option)"
    " any later version."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
    " following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of"
    " conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,"
    " this list of conditions and the following disclaimer in the documentation and/or other materials provided with the"
    " distribution."
)
_BSD_ADVERTISING = (
    " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement:"
    " This product includes software developed by the organization."
)
_BSD_NAME = (
    " {n}. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission."
)
_BSD_TAIL = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_TAIL = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
    " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF"
    " THIS SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation the'
    " rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
    " persons to whom the Software is furnished to do so"
)
_MIT_NOTICE = (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all"
    " copies or substantial portions of the Software."
)
_MIT_TAIL = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE'
    " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR"
    " COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
    " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


def forms() -> list[tuple[str, str]]:
    """(license, text) of all forms in this module and all texts in ``licenses/``."""
    out = [(name, f"{verb} {called}") for name, all_called in _CALLED.items() for called in all_called for verb in _VERBS]
    out += [(name, f"SPDX-License-Identifier: {name}") for name in _CALLED if name != "BSD"]
    for kind in _CC_KINDS:
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"CC-{kind}-{version}"
            for words in {"-".join(_CC[k] for k in kind.split("-")), "-".join(_CC[k] for k in kind.split("-")).replace("NoDerivatives", "NoDerivs")}:
                out.append((name, f"licensed under a Creative Commons {words} {version} International License"))
                out.append((name, f"Creative Commons {words} {version}"))
            out.append((name, f"licensed under CC {kind} {version}"))
            out.append((name, f"SPDX-License-Identifier: {name}"))
    for name, kind, versions in (("GPL", "", "23"), ("AGPL", "Affero ", "3"), ("LGPL", "Lesser ", ("2.1", "3")), ("LGPL", "Library ", "2")):
        for version in versions:
            full = f"{name}-{version if '.' in version else version + '.0'}-notice"
            out += [(full, _GNU.format(this=this, mark=":", kind=kind, version=version)) for this in ("This program", "This library")]
    out.append(("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"))
    out.append(("MPL-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"))
    out += [
        ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
        ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME.format(n=3) + _BSD_TAIL),
        ("BSD-4-Clause", _BSD_HEAD + _BSD_ADVERTISING + _BSD_NAME.format(n=4) + _BSD_TAIL),
        ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
        ("0BSD", _ISC + "." + _ISC_TAIL),
        ("MIT", _MIT + _MIT_NOTICE + _MIT_TAIL),
        ("MIT-0", _MIT + "." + _MIT_TAIL),
    ]
    out += [(path.stem, path.read_text("utf-8")) for path in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    return out
