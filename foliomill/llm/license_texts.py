"""Wordings of licences by SPDX name: one-line notices, file headers and whole texts.

Whole texts are the files of ``licences``, as published; so is the text of AGPL-3.0 but for what it
changes in GPL-3.0, which is put in here.
"""

from __future__ import annotations

from pathlib import Path

FOLDER = Path(__file__).with_name("licences")

# What a one-line notice calls a licence; the first is the template.
NOTICES = {
    "MIT": ("the MIT License", "the MIT licence", "an MIT license", "MIT", "the MIT open source license"),
    "Apache-2.0": (
        "the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0",
        "Apache-2.0", "the Apache License v2.0", "the Apache Software License, Version 2.0"),
    "Apache-1.1": ("the Apache License, Version 1.1", "the Apache Software License, Version 1.1"),
    "BSD": ("the BSD License", "a BSD license", "a BSD-style license"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": (
        "the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License", "BSD-3-Clause"),
    "ISC": ("the ISC License", "ISC"),
    "MPL-1.1": ("the Mozilla Public License, Version 1.1", "the Mozilla Public License 1.1", "MPL-1.1"),
    "MPL-2.0": (
        "the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0",
        "the Mozilla Public License v2.0", "MPL-2.0", "the MPL 2.0"),
    "EPL-1.0": ("the Eclipse Public License, Version 1.0", "the Eclipse Public License 1.0", "EPL-1.0"),
    "EPL-2.0": ("the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0", "the Eclipse Public License v2.0", "EPL-2.0"),
    "Unlicense": ("the Unlicense", "The Unlicense License"),
    "Zlib": ("the zlib License", "the zlib/libpng License"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"),
    "CC0-1.0": (
        "the Creative Commons CC0 1.0 Universal License", "CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 License",
        "the Creative Commons Zero v1.0 Universal License"),
    "GFDL": ("the GNU Free Documentation License",),
    "GPL": ("the GNU General Public License", "the GPL", "the GNU GPL"),
    "LGPL": ("the GNU Lesser General Public License", "the LGPL", "the GNU LGPL"),
    "AGPL": ("the GNU Affero General Public License", "the AGPL", "the GNU AGPL"),
}
for _short, _long, _versions in (
    ("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")),
    ("AGPL", "GNU Affero General Public License", ("3.0",)),
):
    for _version in _versions:
        _n = _version.removesuffix(".0")
        NOTICES[f"{_short}-{_version}"] = (
            f"the {_long}, version {_n}", f"the {_long} v{_n}", f"the {_long} v{_version}", f"the {_long} {_version}", f"version {_n} of the {_long}",
            f"the {_long}, version {_n} or later", f"the {_long}, either version {_n} of the License, or (at your option) any later version",
            f"the {_short} v{_n}", f"the {_short}v{_n}", f"{_short}v{_n}", f"{_short}-{_version}", f"the GNU {_short} v{_n}",
            f"the {_short}, version {_n}", f"the {_short} version {_n} or later", f"{_short}-{_version}-or-later", f"{_short}-{_version}-only",
        )
_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
    _name = "-".join(_PARTS[part] for part in _kind.split("-"))
    for _version, _port in (("4.0", " International"), ("3.0", " Unported"), ("2.5", " Generic"), ("2.0", " Generic")):
        _names = (_name, _name.replace("NonCommercial", "Noncommercial"), _name.replace("ShareAlike", "Share Alike"))
        NOTICES[f"CC-{_kind}-{_version}"] = tuple(dict.fromkeys(
            f"{article} Creative Commons {name} {_version}{port} License"
            for article in ("a", "the") for name in _names for port in (_port, ""))) + (
            f"CC {_kind} {_version}", f"a CC {_kind} {_version} license", f"the CC {_kind} {_version} License")
LEADS = tuple(
    f"{verb} under {terms}" for verb in ("licensed", "released", "distributed", "available", "published", "provided")
    for terms in ("", "the terms of "))
# Of a longer name, the coefficient bears another lead.
LONG = 7

_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
_NO_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. ")
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")


def _gnu_header(name: str, version: str, what: str = "program") -> str:
    return (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This "
        f"{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty "
        f"of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.")


HEADERS = {
    "GPL-2.0-or-later": _gnu_header("GNU General Public License", "2"),
    "LGPL-2.1-or-later": _gnu_header("GNU Lesser General Public License", "2.1", "library"),
    "LGPL-3.0-or-later": _gnu_header("GNU Lesser General Public License", "3", "library"),
    "AGPL-3.0-or-later": _gnu_header("GNU Affero General Public License", "3"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "BSD-2-Clause": _BSD + _DISCLAIMER,
    "BSD-3-Clause": _BSD + _NO_ENDORSEMENT + _DISCLAIMER,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, "
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all "
        "copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
        "works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE "
        "IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS "
        "OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
}
# Other wordings of a licence, found under the same name.
OTHERS = (
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_DISCLAIMER),
    *((name, text.replace("is free software:", "is free software;").replace("This library", "This program"))
      for name, text in HEADERS.items() if name.startswith("LGPL")),
)


def whole_texts() -> dict[str, str]:
    """Whole texts by SPDX name and ``-text``, as published."""
    texts = {path.stem: path.read_text("utf-8", "replace") for path in sorted(FOLDER.glob("*.txt"))}
    gpl = texts["GPL-3.0"]
    start = gpl.index("13. Use with the GNU Affero")
    end = gpl.index("14. Revised Versions")
    named = gpl[:start] + gpl[end:]
    affero = named.replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General\nPublic", "GNU Affero General\nPublic").replace(
        "GNU General Public", "GNU Affero General Public")
    section = (
        "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this "
        "License, if you modify the Program, your modified version must prominently offer all users interacting with it "
        "remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
        "Corresponding Source of your version by providing access to the Corresponding Source from a network server at no "
        "charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall "
        "include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is "
        "incorporated pursuant to the following paragraph.\n")
    at = affero.index("14. Revised Versions")
    texts["AGPL-3.0"] = affero[:at] + section + affero[at:]
    return {name if name in ("0BSD", "Unlicense") else f"{name}-text": text for name, text in texts.items()}


def notices() -> list[tuple[str, str]]:
    """(name, wording) of one-line notices and tags."""
    found = []
    for name, phrases in NOTICES.items():
        for phrase in phrases:
            leads = LEADS if len(phrase.replace("-", " ").replace(".", " ").split()) < LONG else LEADS[:2]
            found += [(f"{name}-notice", f"{lead}{phrase}") for lead in leads]
        found += [(f"{name}-notice", f"is {short} licensed") for short in {name, *SHORT.get(name, ())}]
    return found + [(f"{name}-notice", f"SPDX-License-Identifier: {tag}") for name in TAGGED for tag in _tags(name)]


# What a licence is called in "is ... licensed", beside its own name.
SHORT = {"Apache-2.0": ("Apache", "Apache 2.0"), "GPL-3.0": ("GPLv3",), "GPL-2.0": ("GPLv2",)}
# Licences with a tag, by SPDX name: those with a notice that names one, and those with a text alone.
TAGGED = [name for name in NOTICES if name not in ("BSD", "GFDL", "GPL", "LGPL", "AGPL")] + [
    "0BSD", "Artistic-1.0-Perl", "GFDL-1.2", "GFDL-1.3", "LGPL-2.0"]


def _tags(name: str) -> tuple[str, ...]:
    """The tags of a licence; GNU's say which later versions count."""
    return (name, f"{name}-only", f"{name}-or-later") if name.startswith(("GPL-", "LGPL-", "AGPL-", "GFDL-")) else (name,)
