"""Known licence texts and notices, and spellings counted as the same.

Fixed values: the wording of public licences. Long ones lie in license_data."""

import functools
import pkgutil

# letters and phrases written alike in all texts before digests are taken; the
# rules are coarse on purpose (both sides pass through them)
SPELLINGS = [
    ("z", "s"), ("ce", "se"), ("our", "or"), ("ll", "l"), ("ogue", "og"), ("dgement", "dgment"),
    ("tre ", "ter "), ("sub lisense", "sublisense"), ("non infringement", "noninfringement"),
    ("per sent", "persent"), ("copyright owner", "copyright holder"), ("whilst", "while"),
]

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_MIT = f"""{_MIT_GRANT}, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

{_AS_IS}"""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted"""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

TEXTS = {
    "MIT": [_MIT, f"MIT License\n\n{_MIT}", f"The MIT License (MIT)\n\n{_MIT}"],
    "MIT-0": [f"{_MIT_GRANT}.\n\n{_AS_IS}", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_AS_IS}"],
    "ISC": [f"{head}{_ISC_GRANT}, provided that the above copyright notice and this permission notice "
            f"appear in all copies.\n\n{_ISC_AS_IS}" for head in ("", "ISC License\n\n")],
    "0BSD": [f"{head}{_ISC_GRANT}.\n\n{_ISC_AS_IS}" for head in ("", "BSD Zero Clause License\n\n")],
    "BSD-2-Clause": [f"{head}{_BSD_HEAD}\n\n{_BSD_AS_IS}" for head in ("", "BSD 2-Clause License\n\n")],
    "BSD-3-Clause": [f"{head}{_BSD_HEAD}\n\n{_BSD_NAMES}\n\n{_BSD_AS_IS}"
                     for head in ("", "BSD 3-Clause License\n\n")],
    "Zlib": [_ZLIB, f"zlib License\n\n{_ZLIB}"],
}

NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\");",
                   "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "SPDX-License-Identifier: MIT"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                     "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "Licensed under the GNU General Public License, version 3.",
                "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["SPDX-License-Identifier: ISC"],
}

FULL = ["Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
_END = "END OF TERMS AND CONDITIONS"
_APACHE_BLANK = "   Copyright [yyyy] [name of copyright owner]\n"


@functools.cache
def full_texts() -> dict[str, list[str]]:
    """Entire texts of the long licences: as published, without what follows
    the terms, and with the blank copyright line filled in (such lines are
    dropped from canonical forms)."""
    out = {}
    for name in FULL:
        text = pkgutil.get_data(__package__, f"license_data/{name}.txt").decode("utf-8")
        forms = [text, text.replace(_APACHE_BLANK, "")]
        if _END in text:
            terms = text[:text.index(_END)]
            forms += [terms, terms + _END]
        out[name] = list(dict.fromkeys(forms))
    return out
