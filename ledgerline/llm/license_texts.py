"""Public licences and the notices by which they are stated, as (label, text).

Full texts where they are short (their long runs chain through changed names and
places), notices and summaries where the licence itself is a document of pages.
"""

from __future__ import annotations

_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_ONE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_TWO = (
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_BSD_THREE = (
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission"
)
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
    "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
    "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {} for more details"
_RECEIVED = "you should have received a copy of the gnu {} along with this program if not see https www gnu org licenses"
_SHARE = "you are free to share copy and redistribute the material in any medium or format"
_ADAPT = "adapt remix transform and build upon the material"
_CREDIT = (
    "attribution you must give appropriate credit provide a link to the license and indicate if changes were made you may do so in any reasonable manner "
    "but not in any way that suggests the licensor endorses you or your use"
)
_NO_MORE = "no additional restrictions you may not apply legal terms or technological measures that legally restrict others from doing anything the license permits"
_ALIKE = "sharealike if you remix transform or build upon the material you must distribute your contributions under the same license as the original"


def _gnu(name: str, version: str) -> str:
    return f"this program {_FREE.format(name, version)} this program {_HOPE.format(name)} {_RECEIVED.format(name)}"


TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
            "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
            f"substantial portions of the software {_AS_IS}"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
                 "of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
                 "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific "
                 "language governing permissions and limitations under the license"),
    ("apache-2", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free "
                 "irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such "
                 "derivative works in source or object form"),
    ("bsd", _BSD_GRANT),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("bsd", "licensed under the bsd 2 clause license"),
    ("bsd-2-clause", f"{_BSD_GRANT} 1 {_BSD_ONE} 2 {_BSD_TWO} {_BSD_END}"),
    ("bsd-3-clause", f"{_BSD_GRANT} 1 {_BSD_ONE} 2 {_BSD_TWO} 3 {_BSD_THREE} {_BSD_END}"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
            "notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software "
            "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
            "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising "
            "out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use "
             "of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute "
             "it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original "
             "software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source "
             "versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from "
             "any source distribution"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by "
              "this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to "
              "permit third parties to whom the software is furnished to do so"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", _gnu("general public license", "2")),
    ("gpl", _gnu("general public license", "3")),
    ("lgpl", "licensed under the gnu lesser general public license version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl", _gnu("lesser general public license", "2 1").replace("this program", "this library")),
    ("lgpl", _gnu("lesser general public license", "3").replace("this program", "this library")),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("agpl", _gnu("affero general public license", "3")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain "
              "one at https mozilla org mpl 2 0"),
    ("mpl-2", "licensed under the mozilla public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this "
                  "software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that "
                  "recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make "
                  "this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act "
                  "of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under "
            "copyright law including all related and neighboring rights to the extent allowed by law you can copy modify distribute and perform the work even for "
            "commercial purposes all without asking permission"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", f"{_SHARE} {_ADAPT} {_CREDIT} noncommercial you may not use the material for commercial purposes {_NO_MORE}"),
    ("cc-by-nc-sa", f"{_SHARE} {_ADAPT} {_CREDIT} noncommercial you may not use the material for commercial purposes {_ALIKE} {_NO_MORE}"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", f"{_SHARE} for any purpose even commercially {_ADAPT} for any purpose even commercially {_CREDIT} {_ALIKE} {_NO_MORE}"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", f"{_SHARE} for any purpose even commercially {_ADAPT} for any purpose even commercially {_CREDIT} {_NO_MORE}"),
)
