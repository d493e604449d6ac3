"""Texts of licences and their notices, cut into clauses, by label.

Upper case and punctuation do not matter to the scan.  A caller may pass other tables.
"""

from __future__ import annotations

CLAUSES: dict[str, list[str]] = {
    "mit": [
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": [
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
    ],
    "bsd": [
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage",
    ],
    "zlib": [
        "this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required",
        "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. this notice may not be removed or altered from any source distribution",
    ],
    "boost": [
        "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the software) to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so",
        "the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "in jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    ],
    "apache": [
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license",
        "subject to the terms and conditions of this license, each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare derivative works of, publicly display, publicly perform, sublicense, and distribute the work and such derivative works in source or object form",
        "you may reproduce and distribute copies of the work or derivative works thereof in any medium, with or without modifications, and in source or object form, provided that you meet the following conditions",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
        "unless required by applicable law or agreed to in writing, licensor provides the work (and each contributor provides its contributions) on an as is basis, without warranties or conditions of any kind, either express or implied, including, without limitation, any warranties or conditions of title, non-infringement, merchantability, or fitness for a particular purpose",
    ],
    "gpl": [
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
        "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program. if not, see http://www.gnu.org/licenses/",
        "the gnu general public license is a free, copyleft license for software and other kinds of works. the licenses for most software and other practical works are designed to take away your freedom to share and change the works",
        "you may convey verbatim copies of the program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this license and any non-permissive terms added in accord with section 7 apply to the code",
        "you may copy and distribute verbatim copies of the program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty",
    ],
    "lgpl": [
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version",
        "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions listed below",
    ],
    "agpl": [
        "you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version",
        "the gnu affero general public license is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/",
        "each contributor hereby grants you a world-wide, royalty-free, non-exclusive license under intellectual property rights (other than patent or trademark) licensable by such contributor to use, reproduce, make available, modify, display, perform, distribute, and otherwise exploit its contributions",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "the accompanying program is provided under the terms of this eclipse public license (agreement). any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement",
    ],
    "cc0": [
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law",
    ],
}

_TERMS = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
_VARIANTS = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def templates() -> dict[str, list[str]]:
    """The clauses, and short names of licences made by rule: variants of Creative Commons and versions of the GNU licences."""
    out = {label: list(texts) for label, texts in CLAUSES.items()}
    for v in _VARIANTS:
        name = "-".join(_TERMS[t] for t in v.split("-"))
        out[f"cc-{v}"] = [text for n in _VERSIONS for text in (f"cc {v} {n}", f"creative commons {name} {n}")]
    for label, name in (("gpl", "gnu general"), ("lgpl", "gnu lesser general"), ("agpl", "gnu affero general")):
        out[label] += [f"{name} public license version {n}" for n in ("2", "2.1", "3")]
    out["apache"].append("apache license version 2.0")
    out["mpl"].append("mozilla public license version 2.0")
    out["epl"].append("eclipse public license version 2.0")
    return out
