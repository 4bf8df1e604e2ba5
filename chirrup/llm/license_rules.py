"""Signature rules of licences: label, keyword that every match holds, pattern over lower-case words.

Words in a pattern stand for whole words; one space is whatever parts them in the text. Rules of one
block have its priority (and its weight, 0 to 100). In a block the order does not matter: of two
detections in the same place the longer wins, then the earlier rule.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    number: int


#: Tags that name a licence for machines.
TAGS = """
mit | spdx | spdx license identifier mit
mit-0 | spdx | spdx license identifier mit 0
apache-2 | spdx | spdx license identifier apache 2(?: 0)?
apache-1.1 | spdx | spdx license identifier apache 1 1
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
unlicense | spdx | spdx license identifier unlicense
wtfpl | spdx | spdx license identifier wtfpl
cc0-1.0 | spdx | spdx license identifier cc0(?: 1 0)?
cc-by-4.0 | spdx | spdx license identifier cc by 4 0
cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | spdx | spdx license identifier cc by nc 4 0
gpl-1.0 | spdx | spdx license identifier gpl 1 0(?: only)?
gpl-1.0-or-later | spdx | spdx license identifier gpl 1 0 or later
gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
lgpl-2.0 | spdx | spdx license identifier lgpl 2 0(?: only)?
lgpl-2.0-or-later | spdx | spdx license identifier lgpl 2 0 or later
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | spdx | spdx license identifier lgpl 3 0 or later
agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | spdx | spdx license identifier agpl 3 0 or later
mpl-1.1 | spdx | spdx license identifier mpl 1 1
mpl-2.0 | spdx | spdx license identifier mpl 2 0
epl-1.0 | spdx | spdx license identifier epl 1 0
epl-2.0 | spdx | spdx license identifier epl 2 0
cddl-1.0 | spdx | spdx license identifier cddl 1 0
cddl-1.1 | spdx | spdx license identifier cddl 1 1
artistic-2.0 | spdx | spdx license identifier artistic 2 0
bsl-1.0 | spdx | spdx license identifier bsl 1 0
busl-1.1 | spdx | spdx license identifier busl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
ofl-1.1 | spdx | spdx license identifier ofl 1 1
odbl-1.0 | spdx | spdx license identifier odbl 1 0
psf-2.0 | spdx | spdx license identifier (?:psf|python) 2 0
ncsa | spdx | spdx license identifier ncsa
postgresql | spdx | spdx license identifier postgresql
upl-1.0 | spdx | spdx license identifier upl 1 0
ms-pl | spdx | spdx license identifier ms pl
sspl-1.0 | spdx | spdx license identifier sspl 1 0
mulanpsl-2.0 | spdx | spdx license identifier mulanpsl 2 0
other-tagged | spdx | spdx license identifier [a-z0-9]+
mit | classifier | classifier license osi approved mit license
apache-2 | classifier | classifier license osi approved apache software license
bsd | classifier | classifier license osi approved bsd license
gpl-2.0 | classifier | classifier license osi approved gnu general public license v2(?: gplv2)?
gpl-3.0 | classifier | classifier license osi approved gnu general public license v3(?: gplv3)?
lgpl-3.0 | classifier | classifier license osi approved gnu lesser general public license v3(?: lgplv3)?
mpl-2.0 | classifier | classifier license osi approved mozilla public license 2 0(?: mpl 2 0)?
psf-2.0 | classifier | classifier license osi approved python software foundation license
"""

#: Sentences of the licences' own texts.
TEXTS = """
mit | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | the above copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){1,60}to do so the software is provided
isc | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | neither the name | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | contributors may be | the names? of (?:[^ ]+ ){1,12}contributors may be used to endorse or promote products derived from this software
bsd-4-clause | all advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
apache-2 | apache license | apache license version 2 0 january 2004
apache-2 | apache | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2 | grant of | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants
apache-1.1 | apache software | this product includes software developed by the apache software foundation
gpl | general public | you should have received a copy of the gnu general public license along with
gpl-2.0-or-later | version 2 | gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | version 3 | gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
gpl-2.0 | version 2 | gnu general public license version 2 june 1991
gpl-3.0 | version 3 | gnu general public license version 3 29 june 2007
gpl-2.0 | version 2 | gnu general public license version 2 (?:only )?as published by the free software foundation
lgpl-2.1-or-later | version 2 1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or (?:at your option )?any later version
lgpl-3.0-or-later | version 3 | gnu lesser general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
lgpl-2.1 | version 2 1 | gnu lesser general public license version 2 1 february 1999
lgpl-3.0 | version 3 | gnu lesser general public license version 3 29 june 2007
lgpl-2.0 | library general | gnu library general public license version 2 june 1991
agpl-3.0-or-later | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version
agpl-3.0 | affero | gnu affero general public license version 3 19 november 2007
mpl-2.0 | mozilla public | this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public license version 1 1
epl-1.0 | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0
epl-2.0 | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion)? ?)?2 0
cddl-1.0 | common development | the contents of this file are subject to the terms of the common development and distribution license
zlib | altered source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | as is | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
bsl-1.0 | boost | distributed under the boost software license version 1 0
bsl-1.0 | permission is hereby | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
unlicense | public domain | this is free and unencumbered software released into the public domain
wtfpl | what the | you just do what the f[a-z]+ you want to
cc0-1.0 | to the extent | to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights
ofl-1.1 | font software | this font software is licensed under the sil open font license version 1 1
artistic-2.0 | artistic | everyone is permitted to copy and distribute verbatim copies of this license document (?:[^ ]+ ){1,30}artistic
psf-2.0 | python software | this license agreement is between the python software foundation
postgresql | postgresql | postgresql database management system formerly known as postgres
ncsa | university of illinois | university of illinois ncsa open source license
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php | this product includes php software freely available from
busl-1.1 | business source | use limitation (?:[^ ]+ ){0,20}business source license
commons-clause | commons clause | the software is provided to you by the licensor under the license as defined below subject to the following condition (?:[^ ]+ ){0,40}commons clause
commons-clause | commons clause | commons clause license condition v?1 0
jsw | good not evil | the software shall be used for good not evil
"""

#: Notices: a name with its version.
NAMES = """
apache-2 | apache | (?:the )?apache (?:software )?license v(?:ersion)? ?2(?: 0)?
apache-2 | apache | apache license 2 0
apache-2 | apache | apache 2(?: 0)? license
apache-2 | asl | asl 2 0
apache-1.1 | apache | apache (?:software )?license v(?:ersion)? ?1 1
apache-1.0 | apache | apache (?:software )?license v(?:ersion)? ?1 0
gpl-1.0 | general public | gnu general public license v(?:ersion)? ?1(?: 0)?
gpl-2.0 | general public | gnu general public license v(?:ersion)? ?2(?: 0)?
gpl-3.0 | general public | gnu general public license v(?:ersion)? ?3(?: 0)?
gpl-2.0-or-later | general public | gnu general public license v(?:ersion)? ?2(?: 0)? or (?:any )?later
gpl-3.0-or-later | general public | gnu general public license v(?:ersion)? ?3(?: 0)? or (?:any )?later
gpl-2.0 | gpl | gpl ?v(?:ersion)? ?2(?: 0)?
gpl-2.0 | gpl | gpl 2(?: 0)?
gpl-3.0 | gpl | gpl ?v(?:ersion)? ?3(?: 0)?
gpl-3.0 | gpl | gpl 3(?: 0)?
gpl-2.0-or-later | gpl | gpl ?v?2(?: 0)? or later
gpl-3.0-or-later | gpl | gpl ?v?3(?: 0)? or later
lgpl-2.0 | library general | gnu library general public license(?: v(?:ersion)? ?2(?: 0)?)?
lgpl-2.1 | lesser general | gnu lesser general public license v(?:ersion)? ?2 1
lgpl-3.0 | lesser general | gnu lesser general public license v(?:ersion)? ?3(?: 0)?
lgpl-2.1 | lgpl | lgpl ?v?(?:ersion )?2 1
lgpl-3.0 | lgpl | lgpl ?v?(?:ersion )?3(?: 0)?
agpl-3.0 | affero | (?:gnu )?affero general public license v(?:ersion)? ?3(?: 0)?
agpl-3.0 | agpl | agpl ?v?3(?: 0)?
mpl-1.0 | mozilla public | mozilla public license v(?:ersion)? ?1 0
mpl-1.1 | mozilla public | mozilla public license v(?:ersion)? ?1 1
mpl-2.0 | mozilla public | mozilla public license v(?:ersion)? ?2 0
mpl-2.0 | mpl | mpl 2 0
epl-1.0 | eclipse public | eclipse public license v(?:ersion)? ?1 0
epl-2.0 | eclipse public | eclipse public license (?:v(?:ersion)? ?)?2 0
cddl-1.0 | common development | common development and distribution license v(?:ersion)? ?1 0
cddl-1.1 | common development | common development and distribution license v(?:ersion)? ?1 1
bsd-2-clause | bsd | (?:the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license
bsd-3-clause | bsd | (?:the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license
bsd-4-clause | bsd | (?:the )?(?:bsd 4 clause|4 clause bsd|original bsd) license
0bsd | bsd | (?:zero clause bsd|bsd zero clause|0 clause bsd) license
bsl-1.0 | boost | boost software license(?: v(?:ersion)? ?1 0)?
zlib | zlib | (?:the )?zlib(?: libpng)? license
isc | isc | (?:the )?isc license
mit-0 | mit | mit no attribution(?: license)?
mit | expat | (?:the )?expat license
artistic-1.0 | artistic | artistic license (?:v(?:ersion)? ?)?1 0
artistic-2.0 | artistic | artistic license (?:v(?:ersion)? ?)?2 0
eupl-1.1 | european union public | european union public licence v(?:ersion)? ?1 1
eupl-1.2 | european union public | european union public licence v(?:ersion)? ?1 2
eupl-1.2 | eupl | eupl v?1 2
ofl-1.1 | open font | (?:sil )?open font license(?: v(?:ersion)? ?1 1)?
odbl-1.0 | open database | open database license(?: odbl)?(?: v?1 0)?
odc-by-1.0 | open data commons | open data commons attribution license(?: v?1 0)?
pddl-1.0 | public domain dedication | (?:open data commons )?public domain dedication and license
psf-2.0 | python software | python software foundation license(?: v(?:ersion)? ?2)?
ms-pl | microsoft public | microsoft public license
ms-rl | microsoft reciprocal | microsoft reciprocal license
upl-1.0 | universal permissive | universal permissive license
sspl-1.0 | server side | server side public license(?: v(?:ersion)? ?1)?
busl-1.1 | business source | business source license(?: 1 1)?
elastic-2.0 | elastic license | elastic license(?: v?2 0| 2)?
mulanpsl-2.0 | mulan | mulan permissive software license(?: v2)?
wtfpl | do what the | do what the f[a-z]+ you want to public license
unlicense | unlicense | (?:the )?unlicense license
unlicense | unlicense | under the unlicense
ncsa | illinois | (?:university of )?illinois(?: ncsa)? open source license
php-3.01 | php | php license(?: v(?:ersion)? ?3 01)?
ruby | ruby | ruby license
vim | vim | vim license
postgresql | postgresql | postgresql licen[sc]e
openssl | openssl | openssl license
cecill-2.1 | cecill | cecill(?: free software license agreement)? v?(?:ersion )?2 1
cpl-1.0 | common public | common public license v(?:ersion)? ?1 0
cpal-1.0 | common public attribution | common public attribution license(?: v(?:ersion)? ?1 0)?
osl-3.0 | open software | open software license (?:v(?:ersion)? ?)?3 0
afl-3.0 | academic free | academic free license (?:v(?:ersion)? ?)?3 0
ipl-1.0 | ibm public | ibm public license(?: v(?:ersion)? ?1 0)?
gfdl-1.2 | free documentation | gnu free documentation license v(?:ersion)? ?1 2
gfdl-1.3 | free documentation | gnu free documentation license v(?:ersion)? ?1 3
openrail | openrail | (?:bigscience |creativeml )?openrail(?: m| m license)?
llama | llama | llama [0-9]+(?: [0-9]+)? community license(?: agreement)?
"""

#: Shared texts and data: the family by its words, any version.
SHARED = """
cc-by | creative commons | creative commons attribution(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-sa | creative commons | creative commons attribution share ?alike(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nc | creative commons | creative commons attribution non ?commercial(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [0-9] [0-9])?(?: (?:international|unported|generic))?(?: (?:public )?license)?
cc-by | cc by | cc by(?: [0-9] [0-9])?
cc-by-sa | cc by | cc by sa(?: [0-9] [0-9])?
cc-by-nc | cc by | cc by nc(?: [0-9] [0-9])?
cc-by-nd | cc by | cc by nd(?: [0-9] [0-9])?
cc-by-nc-sa | cc by | cc by nc sa(?: [0-9] [0-9])?
cc-by-nc-nd | cc by | cc by nc nd(?: [0-9] [0-9])?
cc0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc-by | creativecommons | creativecommons org licenses by [0-9] [0-9]
cc-by-sa | creativecommons | creativecommons org licenses by sa [0-9] [0-9]
cc-by-nc | creativecommons | creativecommons org licenses by nc [0-9] [0-9]
cc-by-nd | creativecommons | creativecommons org licenses by nd [0-9] [0-9]
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [0-9] [0-9]
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [0-9] [0-9]
cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | creativecommons org publicdomain mark 1 0
public-domain | public domain | (?:released|dedicated|placed|put)(?: in)?(?: to)?(?: into)? the public domain
public-domain | public domain | (?:is|are) in the public domain
"""

#: Names without a version, in words that grant.
MENTIONS = """
mit | mit | mit licen[sc]e
mit | mit | licen[sc]ed? under (?:the )?(?:terms of (?:the )?)?mit
mit | mit | mit x11 licen[sc]e
x11 | x11 | x11 licen[sc]e
apache | apache | apache (?:software )?licen[sc]e
bsd | bsd | bsd(?: style)? licen[sc]e
gpl | general public | gnu general public licen[sc]e
gpl | gpl | (?:gnu )?gpl(?: licen[sc]e)?
lgpl | lesser general | gnu lesser general public licen[sc]e
lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]e)?
agpl | affero | (?:gnu )?affero general public licen[sc]e
agpl | agpl | (?:gnu )?agpl(?: licen[sc]e)?
mpl | mozilla public | mozilla public licen[sc]e
epl | eclipse public | eclipse public licen[sc]e
cddl | common development | common development and distribution licen[sc]e
artistic | artistic | artistic licen[sc]e
gfdl | free documentation | gnu free documentation licen[sc]e
creative-commons | creative commons | creative commons licen[sc]e
eupl | european union public | european union public licen[sc]e
proprietary | proprietary | proprietary and confidential
proprietary | unauthorized copying | unauthorized copying of this (?:file|work|software)
all-rights-reserved | all rights | all rights reserved
"""

#: Of each block: priority.
BLOCKS = ((100, TAGS), (90, TEXTS), (80, NAMES), (70, SHARED), (50, MENTIONS))
#: What the base counts: a phrase's words in a row, and its label.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def _rules() -> tuple[Rule, ...]:
    lines = [(priority, *line.split(" | ")) for priority, block in BLOCKS for line in block.strip().split("\n")]
    return tuple(Rule(label, keyword, pattern, priority, k) for k, (priority, label, keyword, pattern) in enumerate(lines))


RULES = _rules()
