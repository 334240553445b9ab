"""The catalogue of licences: notices by name and wording, and whole texts with and without their titles."""

from __future__ import annotations

import re

from .license_texts import TEXTS

#: Names that notices use, by SPDX id (families without a version under the family's name).
NAMES = {
    "MIT": ("MIT", "MIT/X11", "Expat"), "ISC": ("ISC",), "0BSD": ("0BSD", "Zero-Clause BSD", "BSD Zero Clause"),
    "BSD": ("BSD",), "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD", "BSD 2-Clause \"Simplified\""),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD", "BSD 3-Clause \"New\" or \"Revised\""), "BSD-4-Clause": ("BSD-4-Clause", "BSD 4-Clause", "4-Clause BSD", "Original BSD"),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache 2", "Apache License 2.0", "Apache License Version 2.0", "Apache License, v2.0", "Apache v2", "Apache v2.0", "Apache Software License 2.0", "Apache Software License, Version 2.0", "ASL 2.0"),
    "MPL-1.1": ("MPL-1.1", "MPL v1.1", "Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", "Mozilla Public License, v. 1.1"), "MPL-2.0": ("MPL-2.0", "MPL v2.0", "MPL v2", "MPL 2", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    "Unlicense": ("Unlicense",), "Zlib": ("Zlib",), "BSL-1.0": ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0", "Boost Software"), "BUSL-1.1": ("BUSL-1.1", "Business Source License 1.1"),
    "WTFPL": ("WTFPL", "Do What The F*ck You Want To Public"), "EPL-1.0": ("EPL-1.0", "Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0"), "EPL-2.0": ("EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("EUPL-1.2", "European Union Public Licence 1.2", "European Union Public Licence v1.2", "EUPL v1.2"), "Artistic-1.0-Perl": ("Artistic-1.0-Perl",), "Artistic-2.0": ("Artistic-2.0", "Artistic License 2.0"), "PSF-2.0": ("PSF-2.0", "PSF", "Python Software Foundation"),
    "OFL-1.1": ("OFL-1.1", "SIL Open Font License 1.1", "SIL Open Font License, Version 1.1", "SIL OFL 1.1"), "CDDL-1.0": ("CDDL-1.0", "Common Development and Distribution License 1.0"), "ODbL-1.0": ("ODbL-1.0", "ODbL", "Open Database License", "Open Data Commons Open Database"),
    "ODC-By-1.0": ("ODC-By-1.0", "ODC-BY", "Open Data Commons Attribution"), "PDDL-1.0": ("PDDL-1.0", "PDDL"), "GFDL-1.2": ("GFDL-1.2", "GNU Free Documentation License 1.2", "GNU Free Documentation License, Version 1.2"), "GFDL-1.3": ("GFDL-1.3", "GNU Free Documentation License 1.3", "GNU Free Documentation License, Version 1.3"),
    "CC0-1.0": ("CC0-1.0", "CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "Creative Commons CC0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"),
    "CC-PDM-1.0": ("Public Domain Mark 1.0",),
}
_PARTS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
for _kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    _long = "Creative Commons " + "-".join(_PARTS[p] for p in _kind.split("-"))
    for _v, _port in (("4.0", " International"), ("3.0", " Unported"), ("2.5", " Generic"), ("2.0", " Generic")):
        NAMES[f"CC-{_kind}-{_v}"] = (f"CC {_kind} {_v}", f"Creative Commons {_kind} {_v}", f"{_long} {_v}", f"{_long} {_v}{_port}")
for _short, _full, _versions in (("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", ("3",))):
    NAMES[_short] = (_short, f"GNU {_short}", _full)
    for _v in _versions:
        _all = {_v, _v if "." in _v else f"{_v}.0"}
        _bases = sorted(f"{s}{x}" for x in _all for s in (f"{_short}v", f"{_short} ", f"GNU {_short} v", f"GNU {_short} version ", f"{_full} v", f"{_full} ", f"{_full} version "))
        _id = f"{_short}-{max(_all, key=len)}"
        NAMES[_id] = tuple(_bases)
        NAMES[f"{_id}-or-later"] = tuple(b + t for b in _bases for t in (" or later", " or (at your option) any later version"))

#: What notices say before the name.
LEADS = ("Licensed", "Released", "Distributed", "Available", "This project is licensed", "This project is released", "This work is licensed", "This software is licensed", "This software is released",
         "This code is licensed", "This file is licensed", "This program is licensed", "This dataset is licensed")


def notices() -> list[tuple[str, str]]:
    """(license, line) for all names after all leads, and for SPDX tags.  Marks and case do not matter."""
    found = []
    for license, names in NAMES.items():
        base = license.removesuffix("-or-later")
        gnu = "GPL-" in license
        # "X+" reads as "X": the canonical form has no marks.
        tags = (license, f"{license}-only") if gnu and base == license else (license,)
        found += [(license, f"SPDX-License-Identifier: {tag}") for tag in tags if tag not in ("BSD", "GPL", "LGPL", "AGPL")]
        for name in names:
            forms = (name, f"the {name}") if "licen" in name.lower() or base != license else (name, f"the {name}", f"{name} license", f"the {name} license")
            found += [(license, f"{lead} under {form}") for form in forms for lead in LEADS]
    return found


_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "Neither the name of {} may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE {0} AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
            "IN NO EVENT SHALL THE {1} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _bsd() -> list[tuple[str, str]]:
    found = []
    holders = (("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("COPYRIGHT HOLDER", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT OWNER"), ("REGENTS", "REGENTS"), ("AUTHOR", "AUTHOR"))
    for one, two, three in (("1. ", "2. ", "3. "), ("* ", "* ", "* ")):
        for holder in holders:
            end = _BSD_END.format(*holder)
            found.append(("BSD-2-Clause", _BSD_HEAD + one + _BSD_1 + two + _BSD_2 + end))
            found += [("BSD-3-Clause", _BSD_HEAD + one + _BSD_1 + two + _BSD_2 + three + _BSD_3.format(who) + end)
                      for who in ("the copyright holder nor the names of its contributors", "the University nor the names of its contributors", "the author nor the names of its contributors", "the copyright holders nor the names of its contributors")]
    return found


#: Title lines of the short licences.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
          "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License")}
#: Addresses of the FSF over the years.
_FSF = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
#: Where the text starts without its title, and where it may end.
_STARTS = {"Apache-2.0": "TERMS AND CONDITIONS FOR USE", "Artistic-1.0-Perl": "Preamble", "CC0-1.0": "Statement of Purpose", "MPL-1.1": "1. Definitions", "MPL-2.0": "1. Definitions"}
_END = "END OF TERMS AND CONDITIONS"


def whole_texts(short: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(license, text): ``short`` bodies and BSD under their titles, and the long texts with and without title and appendix."""
    bodies = [*short, *_bsd()]
    found = [*_bsd(), *((name, f"{title}\n\n{body}") for name, body in bodies for title in TITLES.get(name, ()))]
    for name, text in TEXTS.items():
        lines = text.split("\n")
        mark = _STARTS.get(name, "Copyright (C)")
        at = next(k for k, line in enumerate(lines) if line.strip().startswith(mark))
        for body in ("\n".join(lines), "\n".join(lines[at:])):
            ends = [body] + ([body[: body.index(_END) + len(_END)], body[: body.index(_END)]] if _END in body else [])
            found += [(name, e.replace(_FSF[0], old)) for e in ends for old in (_FSF if _FSF[0] in e else _FSF[:1])]
    return found


def paragraphs(texts: list[tuple[str, str]], least: int) -> list[tuple[str, str]]:
    """(license, paragraph) of whole texts: those of ``least`` characters that stand under one name only.

    Short bodies have a paragraph a line; in long texts a blank line ends one.
    """
    names: dict[str, set[str]] = {}
    first: dict[str, tuple[str, str]] = {}
    for name, text in texts:
        for part in re.split(r"\n[ \t]*\n" if "\n\n" in text.strip() and text.count("\n") > 40 else r"\n", text):
            key = " ".join(re.findall("[0-9a-z]+", part.lower()))
            if len(key) >= least:
                names.setdefault(key, set()).add(name.removesuffix("-or-later"))
                first.setdefault(key, (name, part))
    return [first[key] for key, own in names.items() if len(own) == 1]
