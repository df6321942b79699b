"""Public licence texts and notices, their titles, and digests of long ones."""

from __future__ import annotations

_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ONE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_TWO = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Texts as they stand below their title and copyright lines, by SPDX id; several where a licence is commonly written in several ways.
LICENSES = {
    "0BSD": [f"{_ISC_GRANT}. {_ISC_REST}"],
    "Apache-2.0-line": ["Licensed under the Apache License, Version 2.0."],
    "Apache-2.0-notice": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "BSD-2-Clause": [f"{_BSD_HEAD} {a} {_BSD_ONE} {b} {_BSD_TWO} {_BSD_REST}" for a, b in (("1.", "2."), ("*", "*"))],
    "BSD-3-Clause": [f"{_BSD_HEAD} {a} {_BSD_ONE} {b} {_BSD_TWO} {c} {_BSD_THREE} {_BSD_REST}" for a, b, c in (("1.", "2.", "3."), ("*", "*", "*"))],
    "CC-BY-NC-4.0-line": ["Licensed under CC BY-NC 4.0."],
    "GPL-3.0-line": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_REST}", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_REST}".replace("and/or distribute", "and distribute")],
    "MIT": [_MIT, _MIT.replace("copyright notice and this permission notice shall", "copyright notice and this permission notice (including the next paragraph) shall")],
    "MIT-line": ["Released under the MIT License."],
    "Unlicense": ['This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to ' + site for site in ("<https://unlicense.org>", "<https://unlicense.org/>")],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
}
#: Titles that may stand before the text. Each text is known without a title and with each of its licence's.
TITLES = {
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib License (Zlib)"],
}
#: SHA-256 of the canonical form of long texts, each as its publisher distributes the whole file, and up to its end of terms where it has one.
DIGESTS = {
    "Apache-2.0": ["e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"],
    "Artistic-1.0-Perl": ["08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"],
    "CC0-1.0": ["96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"],
    "GFDL-1.2": ["94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"],
    "GFDL-1.3": ["a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"],
    "GPL-1.0": ["ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a", "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b"],
    "GPL-2.0": ["331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6", "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca"],
    "GPL-3.0": ["eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"],
    "LGPL-2.0": ["61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"],
    "LGPL-2.1": ["4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"],
    "LGPL-3.0": ["aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"],
    "MPL-1.1": ["cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"],
    "MPL-2.0": ["f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"],
}
