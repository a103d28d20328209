"""Texts and notices of public licenses, which are fixed values: family -> name -> text.

Of a family's templates only the best match is reported. The bodies of the short licenses are whole; the long ones
(GPL, LGPL, AGPL, Apache, MPL, EPL, CDDL and others) are found by the notices that their appendices prescribe.
``licenses.read_templates`` adds whole texts from a folder of license files.
"""

from __future__ import annotations

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_MIT_CONDITION = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce "
    "the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by "
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
    "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu(name: str, version: str, later: bool) -> str:
    """The notice of a GNU license."""
    terms = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return (
        f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; {terms}. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program"
    )


def _gnu_family(short: str, name: str, versions: tuple[str, ...]) -> dict[str, str]:
    """Notices of all versions, for that version alone and for later ones too; and the short form of each."""
    out = {f"{short}-{v}-{'or-later' if later else 'only'}": _gnu(name, v.removesuffix(".0"), later) for v in versions for later in (False, True)}
    out |= {f"{short}-{v}-grant": f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {v.removesuffix('.0')} of the License, or (at your option) any later version." for v in versions}
    return out | {f"{short}-{v}": f"This work is licensed under the GNU {name}, version {v.removesuffix('.0')}." for v in versions}


TEMPLATES: dict[str, dict[str, str]] = {
    "all-rights-reserved": {"all-rights-reserved": "All rights reserved."},
    "mit": {
        "mit": "Released under the MIT License.",
        "mit-text": f"{_MIT_GRANT}{_MIT_CONDITION}{_MIT_WARRANTY}",
        "mit-grant": f"{_MIT_GRANT}{_MIT_CONDITION}",
        "mit-0": f"{_MIT_GRANT}. {_MIT_WARRANTY}",
        "x11": f"{_MIT_GRANT}{_MIT_CONDITION}{_MIT_WARRANTY} Except as contained in this notice, the name of the copyright holders shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization.",
        "json": f"{_MIT_GRANT}{_MIT_CONDITION}The Software shall be used for Good, not Evil. {_MIT_WARRANTY}",
        "ncsa": f"{_MIT_GRANT}, subject to the following conditions: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution. Neither the names of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission. {_MIT_WARRANTY}",
    },
    "bsd": {
        "bsd": _BSD_GRANT,
        "bsd-2-clause": f"{_BSD_GRANT}{_BSD_TWO}{_BSD_WARRANTY}",
        "bsd-3-clause": f"{_BSD_GRANT}{_BSD_TWO}3. {_BSD_NAMES}{_BSD_WARRANTY}",
        "bsd-4-clause": f"{_BSD_GRANT}{_BSD_TWO}3. {_BSD_ADVERTISING}the organization. 4. {_BSD_NAMES}{_BSD_WARRANTY}",
    },
    "isc": {
        "isc": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
        "isc-grant": _ISC_GRANT,
        "0bsd": f"{_ISC_GRANT}. {_ISC_WARRANTY}",
    },
    "zlib": {
        "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    },
    "bsl": {
        "bsl-1.0": "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "bsl-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    },
    "unlicense": {
        "unlicense": "This is free and unencumbered software released into the public domain.",
        "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    },
    "wtfpl": {"wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."},
    "beerware": {"beerware": "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return."},
    "postgresql": {
        "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    },
    "hpnd": {
        "hpnd": "Permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies, and that both that the copyright notice and this permission notice appear in supporting documentation, and that the name of the copyright holder not be used in advertising or publicity pertaining to distribution of the software without specific, written prior permission.",
    },
    "apache": {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "apache-2.0-where": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "asf": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0",
        "apache-1.1": f"{_BSD_GRANT}{_BSD_TWO}3. The end-user documentation included with the redistribution, if any, must include the following acknowledgment: This product includes software developed by the Apache Software Foundation. Alternately, this acknowledgment may appear in the software itself, if and wherever such third-party acknowledgments normally appear.",
    },
    "gnu": _gnu_family("gpl", "General Public License", ("1.0", "2.0", "3.0"))
    | _gnu_family("lgpl", "Lesser General Public License", ("2.1", "3.0"))
    | _gnu_family("lgpl", "Library General Public License", ("2.0",))
    | _gnu_family("agpl", "Affero General Public License", ("3.0",)),
    "gfdl": {
        f"gfdl-{v}": f"Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {v} or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."
        for v in ("1.1", "1.2", "1.3")
    },
    "mpl": {
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl-1.1": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.',
    },
    "epl": {
        "epl-1.0": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
        "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    },
    "cddl": {
        "cddl-1.0": 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.',
    },
    "eupl": {
        f"eupl-{v}": f"Licensed under the EUPL, Version {v} or - as soon they will be approved by the European Commission - subsequent versions of the EUPL. You may not use this work except in compliance with the Licence."
        for v in ("1.1", "1.2")
    },
    "ofl": {"ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL"},
    "artistic": {"artistic-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."},
    "perl": {"perl": "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself."},
    "python": {
        "psf-2.0": 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software in source or binary form and its associated documentation.',
    },
    "cc0": {
        "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "cc0-1.0-notice": "Licensed under CC0 1.0.",
    },
    "cc": {
        f"cc-{kind}-{v}": f"Licensed under CC {kind.upper()} {v}." for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("2.0", "3.0", "4.0")
    }
    | {
        f"cc-{kind}-{v}-notice": f"This work is licensed under a Creative Commons {words} {v} International License."
        for kind, words in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))
        for v in ("4.0",)
    },
}
