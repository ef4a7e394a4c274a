"""Signature rules of the license scan.

Rules are regexes over the words of a text: lower case, joined by one space
(so ``Version 2.0`` reads ``version 2 0``).  A line of ``LICENSES`` is

    label | keyword | name patterns, separated by ;

From every name pattern come a mention rule and a notice rule; ``TEXTS`` holds
sentences of license texts, ``TAGS`` the identifiers that tags name, also in
short notices (``Licensed under Apache-2.0``).  A rule is tried only where its
keyword stands in the text; every match of the rule holds it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

# Priorities: a detection inside one of higher priority is dropped.
NAME, NOTICE, TEXT, TAG = 1, 2, 3, 4

LICENSES = r"""
0bsd | bsd | (?:zero clause|0) bsd(?: license)? ; bsd zero clause license
afl-3.0 | academic | academic free license(?: v(?:ersion)? ?3 0)?
afl-3.0 | afl | afl v?3 0
agpl-3.0 | affero | (?:gnu )?affero general public license(?:,? v(?:ersion)? ?3(?: 0)?)? ; affero gpl(?: v?3)?
apache-1.1 | apache | apache (?:software )?license(?: version)? 1 1
apache-2.0 | apache | apache (?:software )?license(?: version)? (?:v )?2(?: 0)? ; apache 2(?: 0)? license ; apache v2(?: 0)?
apache | apache | apache (?:software )?license
apsl-2.0 | apple | apple public source license(?: version)?(?: 2 0)?
artistic-2.0 | artistic | (?:perl )?artistic license(?: version)? 2 0
artistic-1.0 | artistic | (?:perl )?artistic license(?: version)?(?: 1 0)?
bsd-2-clause | bsd | (?:simplified|2 clause|two clause|freebsd) bsd(?: style)?(?: license)? ; bsd 2 clause(?: license)?
bsd-3-clause | bsd | (?:new|modified|revised|3 clause|three clause) bsd(?: style)?(?: license)? ; bsd 3 clause(?: license)?
bsd-4-clause | bsd | (?:original|old|4 clause|four clause) bsd(?: license)? ; bsd 4 clause(?: license)?
bsd | bsd | bsd(?: style)? licen[sc]e
bsl-1.0 | boost | boost software license(?: version)?(?: 1 0)?
busl-1.1 | business | business source license(?: version)?(?: 1 1)?
cc-by-4.0 | by | (?:cc|creative commons) by 4 0
cc-by-4.0 | attribution | creative commons attribution 4 0(?: international)?
cc-by-3.0 | by | (?:cc|creative commons) by 3 0
cc-by-3.0 | attribution | creative commons attribution 3 0(?: unported)?
cc-by-2.0 | by | (?:cc|creative commons) by 2 [05]
cc-by-2.0 | attribution | creative commons attribution 2 [05]
cc-by-sa-4.0 | sa | (?:cc|creative commons) by sa 4 0
cc-by-sa-3.0 | sa | (?:cc|creative commons) by sa 3 0
cc-by-sa | sa | (?:cc|creative commons) by sa
cc-by-sa | share | creative commons attribution share ?alike(?: [234] [05])?
cc-by-nc-4.0 | nc | (?:cc|creative commons) by nc 4 0
cc-by-nc-3.0 | nc | (?:cc|creative commons) by nc 3 0
cc-by-nc | nc | (?:cc|creative commons) by nc
cc-by-nc | commercial | creative commons attribution non ?commercial(?: [234] [05])?
cc-by-nc-sa-4.0 | nc | (?:cc|creative commons) by nc sa 4 0
cc-by-nc-sa | nc | (?:cc|creative commons) by nc sa
cc-by-nc-sa | share | creative commons attribution non ?commercial share ?alike(?: [234] [05])?
cc-by-nc-nd-4.0 | nc | (?:cc|creative commons) by nc nd 4 0
cc-by-nc-nd | nd | (?:cc|creative commons) by nc nd
cc-by-nc-nd | deriv | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [234] [05])?
cc-by-nd-4.0 | nd | (?:cc|creative commons) by nd 4 0
cc-by-nd | nd | (?:cc|creative commons) by nd
cc-by-nd | deriv | creative commons attribution no ?deriv(?:ative)?s?(?: [234] [05])?
cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | zero | (?:cc|creative commons) zero(?: 1 0)?
cc-by | attribution | creative commons attribution(?: licen[sc]e)?
cddl-1.0 | distribution | common development and distribution license(?: version)?(?: 1 [01])?
cecill-2.1 | cecill | cecill(?: [abc])?(?: licen[sc]e)?(?: version)?(?: 2 [01])?
cpl-1.0 | common | common public license(?: version)?(?: 1 0)?
ecl-2.0 | educational | educational community license(?: version)?(?: 2 0)?
epl-1.0 | eclipse | eclipse public license(?: version)?(?: v)? v?1 0
epl-1.0 | epl | epl v?1 0
epl-2.0 | eclipse | eclipse public license(?: version)?(?: v)? v?2 0
epl-2.0 | epl | epl v?2 0
epl | eclipse | eclipse public license
eupl-1.2 | european | european union public licen[cs]e(?: version)?(?: v)?(?: v?1 [012])?
eupl-1.2 | eupl | eupl(?: v)?(?: 1 [012])?
fdl-1.3 | documentation | (?:gnu )?free documentation license(?: version)?(?: 1 [123])?
fdl-1.3 | gfdl | gfdl(?: 1 [123])?
gpl-1.0 | general | (?:gnu )?general public license(?: version)?(?: v)? v?1(?: 0)?
gpl-2.0 | general | (?:gnu )?general public license(?: version)?(?: v)? v?2(?: 0)?
gpl-2.0 | gpl | (?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?
gpl-3.0 | general | (?:gnu )?general public license(?: version)?(?: v)? v?3(?: 0)?
gpl-3.0 | gpl | (?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?
gpl | general | gnu general public licen[cs]e
gpl | gpl | gnu gpl
hpnd | historical | historical permission notice and disclaimer
ijg | jpeg | independent jpeg group(?: s)?(?: software| licen[sc]e)?
ipl-1.0 | ibm | ibm public license(?: version)?(?: 1 0)?
isc | isc | isc licen[sc]e
isc | consortium | internet (?:software|systems) consortium licen[sc]e
lgpl-2.0 | general | (?:gnu )?library general public license(?: version)?(?: v)?(?: v?2(?: 0)?)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public license(?: version)?(?: v)? v?2(?: 1)?
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?(?:version |v )?v?2(?: 1)?
lgpl-3.0 | lesser | (?:gnu )?lesser general public license(?: version)?(?: v)? v?3(?: 0)?
lgpl-3.0 | lgpl | (?:gnu )?lgpl ?(?:version |v )?v?3(?: 0)?
lgpl | lesser | (?:gnu )?lesser general public license
lppl-1.3c | latex | latex project public license(?: version)?(?: 1 [0123]c?)?
mit | mit | (?:the )?mit(?: x11| expat)? licen[sc]e ; mit licen[sc]ed
mit-0 | mit | mit no attribution(?: licen[sc]e)?
mit | expat | expat licen[sc]e
mpl-1.1 | mozilla | mozilla public license(?: version)?(?: v)? v?1 [01]
mpl-2.0 | mozilla | mozilla public license(?: version)?(?: v)? v?2 0
mpl | mozilla | mozilla public license
ms-pl | microsoft | microsoft public license(?: ms pl)?
ms-rl | microsoft | microsoft reciprocal license(?: ms rl)?
mulanpsl-2.0 | mulan | mulan (?:permissive software license|psl)(?: v?2)?
ncsa | illinois | university of illinois(?: ncsa)? open source license
odbl-1.0 | database | open (?:data commons open )?database license(?: version)?(?: v)?(?: v?1 0)?
odc-by-1.0 | commons | open data commons attribution license(?: v?1 0)?
ofl-1.1 | font | (?:sil )?open font license(?: version)?(?: 1 [01])?
openssl | openssl | openssl licen[sc]e
osl-3.0 | open | open software license(?: version)?(?: v)?(?: v?[123] [01])?
pddl-1.0 | dedication | (?:open data commons )?public domain dedication and licen[sc]e
php-3.01 | php | php license(?: version)?(?: 3 0 ?1?)?
postgresql | postgresql | postgresql licen[sc]e
psf-2.0 | python | python software foundation license(?: version)?(?: 2)?
psf-2.0 | psf | psf license(?: agreement)?
public-domain | domain | (?:released|dedicated|placed|put) (?:in|in ?to) the public domain ; public domain work
python-2.0 | python | python license(?: version)?(?: 2 0)?
qpl-1.0 | public | q public license(?: version)?(?: 1 0)?
ruby | ruby | ruby (?:s )?licen[sc]e
sleepycat | sleepycat | sleepycat (?:public |software )?licen[sc]e
sspl-1.0 | server | server side public license(?: version)?(?: v)?(?: v?1)?
unicode | unicode | unicode (?:data files and software )?license(?: agreement)?
unlicense | unlicense | (?:the )?unlicense
upl-1.0 | universal | universal permissive license(?: version)?(?: v)?(?: v?1 0)?
vim | vim | vim licen[sc]e
w3c | w3c | w3c (?:r )?software (?:notice and )?licen[sc]e
wtfpl | wtfpl | wtfpl(?: v(?:ersion)? ?2)?
wtfpl | want | do what the f ?\w+ you want to public license
x11 | x11 | x11 licen[sc]e
zlib | zlib | zlib(?: libpng)? licen[sc]e
zpl-2.1 | zope | zope public license(?: version)?(?: [12] [01])?
""".strip().splitlines()

TEXTS = r"""
apache-2.0 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | warranties | distributed on an as is basis without warranties or conditions of any kind
bsd-3-clause | endorse | neither the name of .{1,80}? may be used to endorse or promote products derived from this software
bsd | redistributions | redistributions of source code must retain the above copyright notice
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsl-1.0 | obtaining | to any person or organization obtaining a copy of the software and accompanying documentation
gpl | redistribute | you can redistribute it and or modify it under the terms of the (?:gnu )?general public license
gpl-2.0 | either | general public license as published by the free software foundation either version 2
gpl-3.0 | either | general public license as published by the free software foundation either version 3
gpl | hope | distributed in the hope that it will be useful but without any warranty
gpl | received | you should have received a copy of the gnu general public license
lgpl | received | you should have received a copy of the gnu lesser general public license
agpl-3.0 | received | you should have received a copy of the gnu affero general public license
isc | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | substantial | shall be included in all copies or substantial portions of the software
mpl-2.0 | source | this source code form is subject to the terms of the mozilla public license v 2 0
unlicense | unencumbered | free and unencumbered software released into the public domain
zlib | misrepresented | origin of this software must not be misrepresented
cc-by | licensed | this work is licensed under a creative commons attribution
ofl-1.1 | font | this font software is licensed under the sil open font license
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use)(?: \w+){0,6} (?:is )?(?:strictly )?prohibited
proprietary | part | no part of this (?:publication|work|document|book)(?: \w+){0,8} (?:reproduced|copied)
proprietary | without | may not be (?:reproduced|copied|distributed|disclosed)(?: \w+){0,8} without(?: \w+){0,4} (?:permission|consent)
proprietary | without | (?:copied|distributed|disclosed) without(?: the)?(?: \w+){0,3} written (?:permission|consent)
proprietary | internal | (?:is )?for internal use only
proprietary | secrets | (?:contains|constitutes)(?: \w+){0,4} trade secrets
proprietary | permission | reproduced (?:only )?with (?:the )?(?:kind |written )?permission
agpl-3.0 | affero | the gnu affero general public license is a free copyleft license for software
apache-2.0 | contributor | licensed to the apache software foundation(?: asf)? under one or more contributor license agreements
apache-2.0 | unless | unless required by applicable law or agreed to in writing software distributed under the license is distributed
artistic-2.0 | establishes | this license establishes the terms under which a given free software package may be copied
bsd | contributors | provided by the (?:copyright holders|regents)(?: and| or)+ contributors as is and any express or implied warranties
cc-by-nc | non | licensed under a creative commons attribution non ?commercial
cc-by-sa | share | licensed under a creative commons attribution share ?alike
cc0-1.0 | waived | to the extent possible under law .{1,80}? waived all copyright and related or neighboring rights
cddl-1.0 | distribution | subject to the terms of the common development and distribution license
epl-1.0 | accompanying | the accompanying materials are made available under the terms of the eclipse public license v(?:ersion )?1 0
epl-2.0 | accompanying | the accompanying materials are made available under the terms of the eclipse public license(?: v)? 2 0
gpl-2.0 | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
isc | disclaims | the software is provided as is and .{1,60}? disclaims all warranties with regard to this software
lgpl | lesser | terms of the gnu lesser general public license as published by the free software foundation
mit | merchantability | without warranty of any kind express or implied including but not limited to the warranties of merchantability
mpl-1.1 | mozilla | contents of this file are subject to the mozilla public license version 1 1
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
ofl-1.1 | reserved | with reserved font names?
unlicense | anyone | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | verbatim | verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
zlib | altered | altered source versions must be plainly marked as such
copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)?\d\d)?
copyright | copyright | copyright (?:c )?(?:by|held by)
""".strip().splitlines()

TAGS = """
0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 bsd-2-clause bsd-3-clause bsd-4-clause
bsl-1.0 busl-1.1 cc-by-2.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-sa-4.0
cc-by-nc-nd-4.0 cc-by-nd-4.0 cc0-1.0 cddl-1.0 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.2 gpl-1.0 gpl-2.0
gpl-3.0 hpnd ijg ipl-1.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0
ncsa odbl-1.0 odc-by-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat
sspl-1.0 unlicense upl-1.0 vim wtfpl x11 zlib zpl-2.1
""".split()


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    priority: int
    regex: re.Pattern


def _compiled(label: str, keyword: str, priority: int, pattern: str) -> Rule:
    return Rule(label, keyword, priority, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first, in the order they are written."""
    found = []
    for tag in TAGS:
        words = re.escape(re.sub("[^a-z0-9]+", " ", tag)).replace(r"\ ", " ")
        found.append(_compiled(tag, "spdx", TAG, rf"spdx license identifier {words}(?: only| or later)?"))
    for tag in TAGS:
        words = re.escape(re.sub("[^a-z0-9]+", " ", tag)).replace(r"\ ", " ")
        found.append(_compiled(tag, words.split()[0], NOTICE,
                               rf"licen[sc]ed?(?: is| as)?(?: under)?(?: the)?(?: terms of)?(?: the)? {words}(?: only| or later)?"))
    for line in TEXTS:
        label, keyword, pattern = (part.strip() for part in line.split("|", 2))
        found.append(_compiled(label, keyword, TEXT, pattern))
    for priority in (NOTICE, NAME):
        for line in LICENSES:
            label, keyword, names = (part.strip() for part in line.split("|", 2))
            for name in re.split(r" ; ", names):
                lead = (r"(?:(?:dual )?licen[sc]ed|released|distributed|available|published|provided|covered|governed)"
                        r"(?: to you)?(?: only)? (?:under|by) (?:the )?(?:terms of )?(?:the |an? )?(?:gnu )?"
                        if priority == NOTICE else "")
                found.append(_compiled(label, keyword, priority, lead + rf"(?:{name.strip()})"))
    return tuple(found)
