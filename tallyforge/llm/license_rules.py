"""Signatures of licences, by hand, in the order in which they take precedence.

Each line has a keyword that a text must hold before the pattern is tried, the label and
the pattern.  Patterns see lower-cased words with one space between them (``version 2.0``
reads ``version 2 0``) and match whole words.  A section gives its lines' confidence.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TABLE = r"""
= 1.0 texts and headers
hereby granted | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
permission notice | mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
without restriction including | mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
hereby granted | isc | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
hereby granted | hpnd | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose is hereby granted without fee
redistributions | bsd-2-clause | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions | bsd-2-clause | redistributions in binary form must reproduce the above copyright notice
endorse or promote | bsd-3-clause | may be used to endorse or promote products derived from this software without specific prior written permission
advertising materials | bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
redistribution and use | bsd | redistribution and use in source and binary forms with or without modification are permitted
apache license | apache-2.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache org | apache-2.0 | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache software | apache-1.1 | this product includes software developed by the apache software foundation
free software foundation | gpl-2.0-or-later | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
free software foundation | gpl-3.0-or-later | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
free software foundation | gpl-2.0 | under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation
free software foundation | lgpl-2.1-or-later | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
free software foundation | lgpl-3.0-or-later | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
free software foundation | lgpl-2.0-or-later | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
free software foundation | agpl-3.0-or-later | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
free documentation | gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mozilla public | mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mozilla public | mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
eclipse public | epl-2.0 | made available under the terms of the eclipse public license (?:v ?)?2 0
eclipse public | epl-1.0 | made available under the terms of the eclipse public license v1 0
common development | cddl-1.0 | subject to the terms of the common development and distribution license
boost software | bsl-1.0 | distributed under the boost software license version 1 0
free and unencumbered | unlicense | this is free and unencumbered software released into the public domain
as is | zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
misrepresented | zlib | the origin of this software must not be misrepresented
do what the fuck | wtfpl | do what the fuck you want to public license
beer | beerware | the beer ?ware license
under the same terms as perl | artistic-perl | (?:free software )?you can redistribute it and or modify it under the same terms as perl itself
written agreement | postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
unicode | unicode-dfs | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
reserved font name | ofl-1.1 | with reserved font name
sil open font | ofl-1.1 | this font software is licensed under the sil open font license version 1 1
python software foundation | python-2.0 | python software foundation license version 2
has waived | cc0-1.0 | has waived all copyright and related or neighboring rights
hosted or managed | elastic-2.0 | you may not provide the software to third parties as a hosted or managed service
to third parties | sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service
non production use | busl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
common public attribution | cpal-1.0 | subject to the common public attribution license version 1 0
academic free | afl-3.0 | licensed under the academic free license version 3 0
open software license | osl-3.0 | licensed under the open software license version 3 0
eupl | eupl-1.2 | licensed under the eupl (?:v ?|version )?1 2
fee or royalty | w3c | permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
= 1.0 identifiers
spdx license | mit | spdx license identifier mit
spdx license | mit-0 | spdx license identifier mit 0
spdx license | isc | spdx license identifier isc
spdx license | bsd-2-clause | spdx license identifier bsd 2 clause
spdx license | bsd-3-clause | spdx license identifier bsd 3 clause
spdx license | 0bsd | spdx license identifier 0bsd
spdx license | apache-2.0 | spdx license identifier apache 2 0
spdx license | gpl-2.0 | spdx license identifier gpl 2 0(?: only)?
spdx license | gpl-2.0-or-later | spdx license identifier gpl 2 0 or later
spdx license | gpl-3.0 | spdx license identifier gpl 3 0(?: only)?
spdx license | gpl-3.0-or-later | spdx license identifier gpl 3 0 or later
spdx license | lgpl-2.1 | spdx license identifier lgpl 2 1(?: only)?
spdx license | lgpl-2.1-or-later | spdx license identifier lgpl 2 1 or later
spdx license | lgpl-3.0 | spdx license identifier lgpl 3 0(?: only)?
spdx license | lgpl-3.0-or-later | spdx license identifier lgpl 3 0 or later
spdx license | agpl-3.0 | spdx license identifier agpl 3 0(?: only)?
spdx license | agpl-3.0-or-later | spdx license identifier agpl 3 0 or later
spdx license | mpl-2.0 | spdx license identifier mpl 2 0
spdx license | epl-2.0 | spdx license identifier epl 2 0
spdx license | cddl-1.0 | spdx license identifier cddl 1 0
spdx license | bsl-1.0 | spdx license identifier bsl 1 0
spdx license | unlicense | spdx license identifier unlicense
spdx license | zlib | spdx license identifier zlib
spdx license | cc0-1.0 | spdx license identifier cc0 1 0
spdx license | cc-by-4.0 | spdx license identifier cc by 4 0
spdx license | cc-by-sa-4.0 | spdx license identifier cc by sa 4 0
spdx license | ofl-1.1 | spdx license identifier ofl 1 1
spdx license | eupl-1.2 | spdx license identifier eupl 1 2
spdx license | busl-1.1 | spdx license identifier busl 1 1
spdx license | sspl-1.0 | spdx license identifier sspl 1 0
spdx license | elastic-2.0 | spdx license identifier elastic 2 0
spdx license | wtfpl | spdx license identifier wtfpl
= 0.9 links
creativecommons | cc-by-4.0 | creativecommons org licenses by 4 0
creativecommons | cc-by-3.0 | creativecommons org licenses by 3 0
creativecommons | cc-by-2.0 | creativecommons org licenses by 2 [05]
creativecommons | cc-by-sa-4.0 | creativecommons org licenses by sa 4 0
creativecommons | cc-by-sa-3.0 | creativecommons org licenses by sa 3 0
creativecommons | cc-by-sa-2.0 | creativecommons org licenses by sa 2 [05]
creativecommons | cc-by-nc-4.0 | creativecommons org licenses by nc 4 0
creativecommons | cc-by-nc-3.0 | creativecommons org licenses by nc 3 0
creativecommons | cc-by-nd-4.0 | creativecommons org licenses by nd 4 0
creativecommons | cc-by-nd-3.0 | creativecommons org licenses by nd 3 0
creativecommons | cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa 4 0
creativecommons | cc-by-nc-sa-3.0 | creativecommons org licenses by nc sa 3 0
creativecommons | cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd 4 0
creativecommons | cc-by-nc-nd-3.0 | creativecommons org licenses by nc nd 3 0
creativecommons | cc0-1.0 | creativecommons org publicdomain zero 1 0
creativecommons | public-domain | creativecommons org publicdomain mark 1 0
apache org | apache-2.0 | apache org licenses license 2 0
gnu org | gpl-2.0 | gnu org licenses (?:old licenses )?gpl 2 0
gnu org | gpl-3.0 | gnu org licenses gpl 3 0
gnu org | lgpl-2.1 | gnu org licenses (?:old licenses )?lgpl 2 1
gnu org | lgpl-3.0 | gnu org licenses lgpl 3 0
gnu org | agpl-3.0 | gnu org licenses agpl 3 0
gnu org | gfdl | gnu org (?:licenses|copyleft) fdl
gnu org | gpl | gnu org (?:licenses|copyleft) gpl
gnu org | lgpl | gnu org (?:licenses|copyleft) lesser
opensource org | mit | opensource org licenses mit(?: license)?
opensource org | bsd-2-clause | opensource org licenses bsd 2 clause
opensource org | bsd-3-clause | opensource org licenses bsd 3 clause
opensource org | isc | opensource org licenses isc(?: license)?
opensource org | apache-2.0 | opensource org licenses apache 2 0
opensource org | artistic-2.0 | opensource org licenses artistic(?: license)? 2 0
opensource org | zlib | opensource org licenses zlib
mozilla org | mpl-2.0 | mozilla org (?:en us )?mpl 2 0
mozilla org | mpl-1.1 | mozilla org mpl mpl 1 1
eclipse org | epl-2.0 | eclipse org legal epl (?:v20|2 0)
eclipse org | epl-1.0 | eclipse org legal epl v10
boost org | bsl-1.0 | boost org license 1 0
unlicense org | unlicense | unlicense org
opendatacommons | odbl-1.0 | opendatacommons org licenses odbl(?: 1 0)?
opendatacommons | odc-by-1.0 | opendatacommons org licenses by(?: 1 0)?
opendatacommons | pddl-1.0 | opendatacommons org licenses pddl(?: 1 0)?
sil org | ofl-1.1 | scripts sil org ofl
wtfpl net | wtfpl | wtfpl net
= 0.8 names with a version
mit licen | mit | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of the )?mit licen[cs]e
mit 0 | mit-0 | mit 0 licen[cs]e
mit no attribution | mit-0 | mit no attribution
isc licen | isc | (?:licensed|released|distributed) under (?:the )?isc licen[cs]e
bsd | bsd-2-clause | (?:2|two) clause bsd(?: licen[cs]e)?|bsd (?:2|two) clause(?: licen[cs]e)?|simplified bsd licen[cs]e|freebsd licen[cs]e
bsd | bsd-3-clause | (?:3|three) clause bsd(?: licen[cs]e)?|bsd (?:3|three) clause(?: licen[cs]e)?|(?:new|revised|modified) bsd licen[cs]e
bsd | bsd-4-clause | (?:4|four) clause bsd(?: licen[cs]e)?|bsd (?:4|four) clause(?: licen[cs]e)?|original bsd licen[cs]e
bsd | 0bsd | zero clause bsd|0bsd|bsd zero clause
apache | apache-2.0 | (?:licensed under (?:the )?)?apache (?:software )?licen[cs]e (?:version |v ?)?2(?: 0)?|(?:licensed under (?:the )?)?apache 2(?: 0)?(?: licen[cs]e)?
apache | apache-1.1 | apache (?:software )?licen[cs]e (?:version |v ?)?1 1
general public | gpl-2.0-or-later | (?:gnu )?general public licen[cs]e (?:version |v ?)2(?: 0)? or (?:at your option any )?(?:any )?later(?: version)?
general public | gpl-3.0-or-later | (?:gnu )?general public licen[cs]e (?:version |v ?)3(?: 0)? or (?:at your option any )?(?:any )?later(?: version)?
general public | gpl-1.0 | (?:gnu )?general public licen[cs]e (?:version |v ?)1(?: 0)?
general public | gpl-2.0 | (?:gnu )?general public licen[cs]e (?:version |v ?)?2(?: 0)?
general public | gpl-3.0 | (?:gnu )?general public licen[cs]e (?:version |v ?)?3(?: 0)?
gpl | gpl-2.0-or-later | (?:gnu )?gpl ?v?2(?: 0)?(?: or later| plus)
gpl | gpl-3.0-or-later | (?:gnu )?gpl ?v?3(?: 0)?(?: or later| plus)
gpl | gpl-2.0 | (?:gnu )?gpl (?:version |v ?)?2(?: 0)?(?: only)?|gplv2
gpl | gpl-3.0 | (?:gnu )?gpl (?:version |v ?)?3(?: 0)?(?: only)?|gplv3
lesser general | lgpl-2.1 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?2 1
lesser general | lgpl-3.0 | (?:gnu )?lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
library general | lgpl-2.0 | (?:gnu )?library general public licen[cs]e (?:version |v ?)?2(?: 0)?
lgpl | lgpl-2.1 | (?:gnu )?lgpl (?:version |v ?)?2 1(?: only)?
lgpl | lgpl-3.0 | (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?(?: only)?|lgplv3
affero | agpl-3.0 | (?:gnu )?affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
affero | agpl-1.0 | affero general public licen[cs]e (?:version |v ?)?1(?: 0)?
agpl | agpl-3.0 | (?:gnu )?agpl (?:version |v ?)?3(?: 0)?|agplv3
free documentation | gfdl-1.3 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 3
free documentation | gfdl-1.2 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 2
free documentation | gfdl-1.1 | (?:gnu )?free documentation licen[cs]e (?:version |v ?)?1 1
mozilla | mpl-2.0 | mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
mozilla | mpl-1.1 | mozilla public licen[cs]e (?:version |v ?)?1 1
mozilla | mpl-1.0 | mozilla public licen[cs]e (?:version |v ?)?1 0
mpl | mpl-2.0 | mpl (?:version |v ?)?2(?: 0)?
eclipse | epl-2.0 | eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
eclipse | epl-1.0 | eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
eclipse | edl-1.0 | eclipse distribution licen[cs]e (?:version |v ?)?1(?: 0)?
common public | cpl-1.0 | common public licen[cs]e (?:version |v ?)?1(?: 0)?
common development | cddl-1.1 | common development and distribution licen[cs]e (?:version |v ?)?1 1
common development | cddl-1.0 | common development and distribution licen[cs]e (?:version |v ?)?1 0
boost software | bsl-1.0 | boost software licen[cs]e (?:version |v ?)?1(?: 0)?
artistic | artistic-2.0 | artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic | artistic-1.0 | artistic licen[cs]e (?:version |v ?)?1(?: 0)?
open font | ofl-1.1 | (?:sil )?open font licen[cs]e (?:version |v ?)?1 1
academic free | afl-3.0 | academic free licen[cs]e (?:version |v ?)?3(?: 0)?
academic free | afl-2.1 | academic free licen[cs]e (?:version |v ?)?2 1
open software | osl-3.0 | open software licen[cs]e (?:version |v ?)?3(?: 0)?
european union public | eupl-1.2 | european union public licen[cs]e (?:version |v ?)?1 2
european union public | eupl-1.1 | european union public licen[cs]e (?:version |v ?)?1 1
server side public | sspl-1.0 | server side public licen[cs]e (?:version |v ?)?1(?: 0)?
business source | busl-1.1 | business source licen[cs]e (?:version |v ?)?1 1
elastic | elastic-2.0 | elastic licen[cs]e (?:version |v ?)?2(?: 0)?
microsoft | ms-pl | microsoft public licen[cs]e
microsoft | ms-rl | microsoft reciprocal licen[cs]e
open database | odbl-1.0 | open database licen[cs]e(?: (?:version |v ?)?1 0)?
open data commons | odc-by-1.0 | open data commons attribution licen[cs]e
community data | cdla-permissive-2.0 | community data licen[cs]e agreement permissive (?:version )?2 0
community data | cdla-sharing-1.0 | community data licen[cs]e agreement sharing (?:version )?1 0
rail | openrail | (?:bigscience )?(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?
open government | ogl-uk-3.0 | open government licen[cs]e (?:for public sector information )?(?:version |v ?)?3(?: 0)?
open government | ogl-uk-2.0 | open government licen[cs]e (?:version |v ?)?2(?: 0)?
licence ouverte | etalab-2.0 | (?:etalab )?licence ouverte (?:etalab )?(?:version |v ?)?2 0
cc by | cc-by-nc-nd-4.0 | (?:licensed under )?cc by nc nd 4(?: 0)?
cc by | cc-by-nc-nd-3.0 | (?:licensed under )?cc by nc nd 3(?: 0)?
cc by | cc-by-nc-sa-4.0 | (?:licensed under )?cc by nc sa 4(?: 0)?
cc by | cc-by-nc-sa-3.0 | (?:licensed under )?cc by nc sa 3(?: 0)?
cc by | cc-by-nc-4.0 | (?:licensed under )?cc by nc 4(?: 0)?
cc by | cc-by-nc-3.0 | (?:licensed under )?cc by nc 3(?: 0)?
cc by | cc-by-nd-4.0 | (?:licensed under )?cc by nd 4(?: 0)?
cc by | cc-by-nd-3.0 | (?:licensed under )?cc by nd 3(?: 0)?
cc by | cc-by-sa-4.0 | (?:licensed under )?cc by sa 4(?: 0)?
cc by | cc-by-sa-3.0 | (?:licensed under )?cc by sa 3(?: 0)?
cc by | cc-by-4.0 | (?:licensed under )?cc by 4(?: 0)?
cc by | cc-by-3.0 | (?:licensed under )?cc by 3(?: 0)?
cc0 | cc0-1.0 | cc0(?: 1 0)?(?: universal)?
cc zero | cc0-1.0 | cc zero
creative commons | cc-by-nc-nd-4.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s? (?:works )?4 0(?: international)?
creative commons | cc-by-nc-sa-4.0 | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
creative commons | cc-by-nc-4.0 | creative commons attribution non ?commercial 4 0(?: international)?
creative commons | cc-by-nd-4.0 | creative commons attribution no ?deriv(?:ative)?s? (?:works )?4 0(?: international)?
creative commons | cc-by-sa-4.0 | creative commons attribution share ?alike 4 0(?: international)?
creative commons | cc-by-4.0 | creative commons attribution 4 0(?: international)?
creative commons | cc-by-sa-3.0 | creative commons attribution share ?alike 3 0(?: unported)?
creative commons | cc-by-3.0 | creative commons attribution 3 0(?: unported)?
= 0.6 names
mit licen | mit | (?:the )?mit licen[cs]e
expat | mit | expat licen[cs]e
x11 | x11 | x11 licen[cs]e
isc licen | isc | (?:the )?isc licen[cs]e
bsd | bsd | bsd (?:style )?licen[cs]e
apache | apache | apache (?:software )?licen[cs]e
lesser general | lgpl | (?:gnu )?lesser general public licen[cs]e
library general | lgpl | (?:gnu )?library general public licen[cs]e
affero | agpl | (?:gnu )?affero general public licen[cs]e
general public | gpl | (?:gnu )?general public licen[cs]e
lgpl | lgpl | (?:gnu )?lgpl
agpl | agpl | (?:gnu )?agpl
gnu gpl | gpl | gnu gpl
free documentation | gfdl | (?:gnu )?free documentation licen[cs]e
mozilla | mpl | mozilla public licen[cs]e
eclipse | epl | eclipse public licen[cs]e
common development | cddl | common development and distribution licen[cs]e
artistic | artistic | artistic licen[cs]e
zlib | zlib | zlib (?:libpng )?licen[cs]e
unlicense | unlicense | the unlicense
wtfpl | wtfpl | wtfpl
open font | ofl | (?:sil )?open font licen[cs]e
python software foundation | python-2.0 | python software foundation licen[cs]e
ruby | ruby | ruby licen[cs]e
php licen | php-3.01 | php licen[cs]e
openssl | openssl | openssl licen[cs]e
cc by | cc-by-nc-nd | cc by nc nd
cc by | cc-by-nc-sa | cc by nc sa
cc by | cc-by-nc | cc by nc
cc by | cc-by-nd | cc by nd
cc by | cc-by-sa | cc by sa
cc by | cc-by | cc by
creative commons | cc-by-nc | creative commons attribution non ?commercial
creative commons | cc-by-sa | creative commons attribution share ?alike
creative commons | cc-by | creative commons attribution
public domain | public-domain | (?:is |are |been )?(?:in|into|dedicated to|released (?:in)?to) the public domain
= 0.3 hints
all rights reserved | reserved | (?:copyright (?:c )?(?:(?:19|20)\d\d )+(?:\S+ ){0,6})?all rights reserved
tous droits | reserved | tous droits réservés
alle rechte | reserved | alle rechte vorbehalten
derechos reservados | reserved | todos los derechos reservados
tutti i diritti | reserved | tutti i diritti riservati
copyright | copyright | copyright (?:c )?(?:by )?(?:19|20)\d\d
proprietary | proprietary | (?:proprietary and confidential|confidential and proprietary)
may not be reproduced | proprietary | may not be reproduced (?:or transmitted )?in any form
personal | non-commercial | (?:for )?personal (?:and )?non ?commercial use only
creative commons | creative-commons | creative commons(?: licen[cs]e)?
licensed under | unknown | licensed under (?:the terms of )?(?:this|our|a|an|its own) (?:\S+ ){0,3}?licen[cs]e
open source | unknown | open source licen[cs]e
released under | unknown | released under (?:the terms of )?(?:this|our|a|an|its own) (?:\S+ ){0,3}?licen[cs]e
see the | unknown | see the (?:file )?licen[cs]e (?:file )?for (?:more )?details
end user | eula | end user licen[cs]e agreement
"""


class Rule(NamedTuple):
    order: int
    #: Rules of one section are equals; of two sections the first takes precedence.
    section: int
    confidence: float
    keyword: bytes
    label: str
    pattern: re.Pattern[bytes]


def whole_words(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")


def read(table: str = TABLE) -> list[Rule]:
    rules, section, confidence = [], 0, 0.0
    for line in table.strip().splitlines():
        if line.startswith("="):
            section, confidence = section + 1, float(line.split()[1])
            continue
        keyword, label, pattern = line.split(" | ", 2)
        rules.append(Rule(len(rules), section, confidence, keyword.encode(), label, whole_words(pattern)))
    return rules
