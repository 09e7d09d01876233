"""License scans by ordered signature rules, in DataFrame expressions alone.

Texts are brought to lower-case words with one blank between; a '+' right after a GNU name or version reads as "or later". A gate of a
few dozen stems decides which texts are looked at, and which stretches of them: REACH words on either side of each stem, stretches
that touch being one. Equal stretches are matched once. Each rule is a regular expression over words, with a keyword without which it isn't
tried, a priority (0 is the strongest) and a confidence. Of overlapping detections, one that lies inside another of the same or a stronger
priority is suppressed. Base phrases are counted on their own over the whole text and always stay.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import text_of
from corpusloom.sources.shared import materialise

BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
BASE_CONFIDENCE = 0.9
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A '+' after the version of a GNU license is marked by this sign and a blank, which end the version's word, before punctuation goes: words stay as many.
PLUS = "\u207a"
PLUS_AFTER = r"((?:gpl|general[^a-z0-9]{1,8}public[^a-z0-9]{1,8}licen[sc]e)[^a-z0-9]{0,8}(?:version|v)?[^a-z0-9]{0,4}[0-9](?:\.[0-9])?)\+"

# Identifiers whose tag names a license outright.
SPDX_IDS = """0BSD AFL-3.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause
BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0
EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-2.0 GPL-3.0 IPL-1.0 ISC LGPL-2.1 LGPL-3.0 LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0
NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PHP-3.01 PostgreSQL Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
CC_TERMS = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
GNU = {"gpl": ("general public license", ("1", "2", "3")), "lgpl": ("(?:lesser|library) general public license", ("2", "2 1", "3")), "agpl": ("affero general public license", ("1", "3"))}
#: label: (name, versions); a version follows the name, with or without the word. The keyword is what the name begins with.
VERSIONED = {
    "apache": ("apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0")), "mpl": ("mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    "epl": ("eclipse public licen[sc]e", ("1 0", "2 0")), "cddl": ("common development and distribution licen[sc]e", ("1 0", "1 1")),
    "eupl": ("european union public licen[sc]e", ("1 0", "1 1", "1 2")), "artistic": ("artistic licen[sc]e", ("1 0", "2 0")),
    "ofl": ("sil open font licen[sc]e", ("1 0", "1 1")), "osl": ("open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    "afl": ("academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")), "boost": ("boost software licen[sc]e", ("1 0",)),
    "php": ("php licen[sc]e", ("2 02", "3 0", "3 01")), "cpl": ("common public licen[sc]e", ("0 5", "1 0")), "busl": ("business source licen[sc]e", ("1 0", "1 1")),
    "sspl": ("server side public licen[sc]e", ("1",)), "elastic": ("elastic licen[sc]e", ("1 0", "2 0")), "odbl": ("open database licen[sc]e", ("1 0",)),
    "zpl": ("zope public licen[sc]e", ("1 1", "2 0", "2 1")), "ecl": ("educational community licen[sc]e", ("1 0", "2 0")), "lppl": ("latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3")),
    "qpl": ("q public licen[sc]e", ("1 0",)), "python": ("python(?: software foundation)? licen[sc]e", ("2 0", "2")), "upl": ("universal permissive licen[sc]e", ("1 0",)),
}
#: Signatures written one by one: label | gate | keyword | priority | confidence | pattern over words. Every match holds the gate, at the
#: beginning of a word, and the keyword.
SIGNATURES = """
mit | licen | mit licen | 1 | 0.9 | (?:the )?mit licen[sc]e
mit-released | licen | the mit licen | 1 | 0.95 | (?:released|licen[sc]ed|distributed|available|provided|published) under (?:the terms of )?the mit licen[sc]e
mit-expat | licen | expat licen | 2 | 0.9 | expat licen[sc]e
mit-text | permission | hereby granted | 1 | 0.95 | permission is hereby granted free of charge to any person obtaining a copy
mit-text | permission | to deal in the software | 2 | 0.8 | permission is hereby granted(?: [^ ]+){0,24} to deal in the software without restriction
mit-notice | permission | this permission notice | 2 | 0.7 | (?:the above copyright notice and )?this permission notice shall be included in all copies
mit-0 | licen | mit no attribution | 1 | 0.95 | mit no attribution licen[sc]e
mit-or-apache | licen | apache | 1 | 0.95 | licen[sc]ed under (?:either )?(?:the )?mit(?: licen[sc]e)? or (?:the )?apache(?: licen[sc]e)?(?: version)?(?: 2 0)?
isc | licen | isc licen | 1 | 0.9 | isc licen[sc]e
isc-text | permission | permission to use copy modify and | 1 | 0.9 | permission to use copy modify and(?: or)? distribute this software(?: and its documentation)? for any purpose
hpnd-text | permission | and its documentation | 2 | 0.8 | permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation
bsd-0-clause | bsd | clause | 1 | 0.95 | (?:bsd 0 clause|0 clause bsd|zero clause bsd)
bsd-1-clause | bsd | clause | 1 | 0.95 | (?:bsd 1 clause|1 clause bsd)
bsd-2-clause | bsd | bsd | 1 | 0.95 | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)
bsd-2-clause | freebsd | freebsd licen | 1 | 0.9 | freebsd licen[sc]e
bsd-3-clause | bsd | bsd | 1 | 0.95 | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)
bsd-4-clause | bsd | bsd | 1 | 0.95 | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)
bsd | bsd | bsd | 2 | 0.8 | bsd (?:style )?licen[sc]ed?
bsd | bsd | under | 2 | 0.8 | under (?:the terms of )?(?:the |a )?bsd(?: style)? licen[sc]e
bsd-text | redistribution | source and binary forms | 1 | 0.95 | redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?
bsd-source-clause | redistribution | redistributions of source code | 2 | 0.8 | redistributions of source code must retain the (?:above )?copyright notice
bsd-binary-clause | redistribution | redistributions in binary form | 2 | 0.8 | redistributions in binary form must reproduce the above copyright notice
bsd-no-endorsement | permission | endorse or promote products | 2 | 0.7 | endorse or promote products derived from this software without specific prior written permission
bsd-4-clause-advertising | licen | acknowledg | 5 | 0.3 | all advertising materials mentioning features(?: [^ ]+){0,12} acknowledg[^ ]+(?: [^ ]+){0,12} licen[sc]e[^ ]*
apache-header | licen | licensed under the apache | 1 | 0.95 | licensed under the apache licen[sc]e version 2 0(?: the licen[sc]e)?(?: you may not use this file except in compliance with the licen[sc]e)?
apache-compliance | licen | except in compliance | 2 | 0.8 | you may not use this file except in compliance with the licen[sc]e
apache-copy | licen | obtain a copy of the licen | 3 | 0.5 | you may obtain a copy of the licen[sc]e at
apache-basis | licen | as is basis | 2 | 0.8 | distributed under the licen[sc]e is distributed on an as is basis
apache-asf | licen | apache software foundation | 2 | 0.8 | licensed to the apache software foundation(?: asf)? under one or more contributor licen[sc]e agreements
apache-2.0 | licen | l 2 0 licen | 1 | 0.8 | (?:asl|al) 2 0 licen[sc]e
gnu-any | gnu | public licen | 3 | 0.6 | gnu (?:affero |lesser |library )?general public licen[sc]e
gpl-header | gnu | redistribute it and or modify it | 2 | 0.8 | (?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu (?:affero |lesser |library )?general public licen[sc]e
gpl-no-warranty | gnu | see the gnu | 3 | 0.6 | see the gnu (?:affero |lesser |library )?general public licen[sc]e for more details
gpl-received | licen | you should have received | 3 | 0.6 | you should have received a copy of the gnu (?:affero |lesser |library )?general public licen[sc]e
gpl-exception | gpl | exception | 1 | 0.9 | gpl(?: v?[23](?: 0)?)? with (?:the )?(?:classpath|linking|runtime library|font|autoconf|bison)(?: [^ ]+)? exception
classpath-exception | licen | classpath exception | 1 | 0.9 | general public licen[sc]e(?: version 2)? with (?:the )?classpath exception
gfdl-any | gnu | free documentation | 2 | 0.8 | gnu free documentation licen[sc]e
gfdl-1.3 | gnu | free documentation | 1 | 0.95 | gnu free documentation licen[sc]e version 1 3
gfdl-1.2 | gnu | free documentation | 1 | 0.95 | gnu free documentation licen[sc]e version 1 2
gfdl-1.1 | gnu | free documentation | 1 | 0.95 | gnu free documentation licen[sc]e version 1 1
gfdl-text | permission | copy distribute and or modify this document | 1 | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gnu-all-permissive | copying | copying and distribution of this file | 1 | 0.9 | copying and distribution of this file with or without modification are permitted in any medium
no-warranty | warrant | without warrant | 3 | 0.5 | without warrant(?:y|ies)(?: or conditions)? of any kind
as-is | warrant | provided as is | 3 | 0.5 | provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)
as-is | warrant | provided as is | 3 | 0.5 | provided as is and any express or implied warrant(?:y|ies)
no-merchantability | warrant | merchantability | 4 | 0.3 | implied warrant(?:y|ies) of merchantability(?: (?:and|or) fitness for a particular purpose)?
zlib | licen | zlib | 1 | 0.9 | zlib(?: libpng)? licen[sc]e
zlib-text | permission | permission is granted to anyone | 1 | 0.95 | permission is granted to anyone to use this software for any purpose including commercial applications
zlib-text | warrant | express or implied warrant | 3 | 0.5 | this software is provided as is without any express or implied warrant(?:y|ies)
libpng | licen | libpng licen | 1 | 0.9 | libpng licen[sc]e(?: version 2)?
x11 | licen | x11 licen | 1 | 0.9 | x11 licen[sc]e
ncsa | licen | university of illinois | 1 | 0.9 | university of illinois(?: ncsa)? open source licen[sc]e
boost-text | permission | obtaining a copy of the software and accompanying | 1 | 0.95 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
boost-header | licen | distributed under the boost | 1 | 0.95 | distributed under the boost software licen[sc]e(?: version)?(?: 1 0)?
unlicense | unlicense | unlicense | 1 | 0.95 | (?:the )?unlicense
unlicense-text | public domain | unencumbered | 1 | 0.95 | free and unencumbered software released into the public domain
wtfpl | wtfpl | wtfpl | 1 | 0.95 | wtfpl(?: version 2| v?2)?
vim | licen | vim licen | 1 | 0.9 | vim licen[sc]e
ruby | licen | ruby licen | 1 | 0.9 | ruby licen[sc]e
ruby | licen | same terms as ruby | 1 | 0.8 | licen[sc]ed? under the same terms as ruby
perl | licen | same terms as perl | 1 | 0.9 | (?:under the same terms as perl itself|licen[sc]ed? under the same terms as perl)(?: [^ ]+){0,8} licen[sc]e
openssl | licen | openssl licen | 1 | 0.9 | openssl licen[sc]e
ssleay | licen | ssleay licen | 1 | 0.9 | (?:original )?ssleay licen[sc]e
postgresql | licen | postgresql licen | 1 | 0.9 | postgresql licen[sc]e
ms-pl | licen | microsoft public | 1 | 0.9 | microsoft public licen[sc]e(?: ms pl)?
ms-rl | licen | microsoft reciprocal | 1 | 0.9 | microsoft reciprocal licen[sc]e(?: ms rl)?
ms-eula | licen | microsoft software licen | 2 | 0.8 | microsoft software licen[sc]e terms
curl | licen | curl licen | 1 | 0.9 | curl licen[sc]e
icu | licen | icu licen | 1 | 0.9 | icu licen[sc]e(?: icu 1 8 1 and later)?
unicode | licen | unicode | 1 | 0.9 | unicode(?: inc)?(?: terms of use)? licen[sc]e(?: agreement)?(?: v3)?
ijg | licen | jpeg group | 1 | 0.9 | independent jpeg group(?: s)? licen[sc]e
ftl | licen | freetype | 1 | 0.9 | (?:the )?freetype (?:project )?licen[sc]e
imagemagick | licen | imagemagick licen | 1 | 0.9 | imagemagick licen[sc]e
json | licen | json licen | 1 | 0.9 | json licen[sc]e
json-text | shall be used | good not evil | 1 | 0.9 | (?:the software )?shall be used for good not evil
blueoak-1.0.0 | licen | blue oak model | 1 | 0.95 | blue oak model licen[sc]e(?: version)?(?: 1 0 0)?
beerware | licen | beer ware | 1 | 0.9 | (?:the )?beer ware licen[sc]e
beerware | licen | beerware | 1 | 0.9 | (?:the )?beerware licen[sc]e
nasa-1.3 | licen | nasa open source | 1 | 0.9 | nasa open source agreement(?: [^ ]+){0,6} licen[sc]e
ipa | licen | ipa font licen | 1 | 0.9 | ipa font licen[sc]e(?: agreement)?(?: v?1 0)?
bitstream-vera | copyright | bitstream | 2 | 0.8 | copyright(?: c)?(?: [12][0-9]{3})? by bitstream
sleepycat | licen | sleepycat | 1 | 0.9 | sleepycat licen[sc]e
intel | licen | intel open source | 1 | 0.9 | intel open source licen[sc]e
sun-bcl | licen | binary code licen | 1 | 0.9 | (?:oracle |sun )?binary code licen[sc]e(?: agreement)?
commons-clause | commons clause | commons clause | 1 | 0.9 | commons clause(?: licen[sc]e condition)?(?: v?1 0)?
polyform-noncommercial | licen | polyform | 1 | 0.95 | polyform noncommercial licen[sc]e(?: 1 0 0)?
polyform-small-business | licen | polyform | 1 | 0.95 | polyform small business licen[sc]e(?: 1 0 0)?
polyform-strict | licen | polyform | 1 | 0.95 | polyform strict licen[sc]e(?: 1 0 0)?
openrail | licen | rail | 1 | 0.9 | (?:bigscience |creativeml )?(?:open)?rail(?: ?[+ms]+)? licen[sc]e
llama | licen | llama | 1 | 0.9 | llama(?: [0-9](?: [0-9])?)? community licen[sc]e(?: agreement)?
gemma | licen | gemma | 1 | 0.9 | gemma (?:terms of use )?licen[sc]e
cdla-permissive | licen | data licen | 1 | 0.95 | community data licen[sc]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | licen | data licen | 1 | 0.95 | community data licen[sc]e agreement sharing(?: version)?(?: 1 0)?
odc-by | licen | open data commons | 1 | 0.95 | open data commons attribution licen[sc]e(?: v?1 0)?
pddl | licen | open data commons | 1 | 0.95 | open data commons public domain dedication and licen[sc]e
ogl-uk | licen | open government | 1 | 0.9 | open government licen[sc]e(?: v?[123] 0)?
etalab | licen | licence ouverte | 1 | 0.9 | licence ouverte(?: etalab)?(?: v?[12] 0)?
cecill | licen | licence cecill | 1 | 0.9 | licence cecill(?: [bc])?
public-domain | public domain | public domain | 2 | 0.8 | (?:in|into|to) the public domain
public-domain-mark | public domain | public domain mark | 1 | 0.9 | public domain mark(?: 1 0)?
public-domain-dedication | public domain | dedicat | 1 | 0.9 | (?:public domain dedication|dedicated to the public domain)
cc0 | cc0 | cc0 | 1 | 0.95 | cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0 | creative commons | creative commons zero | 1 | 0.95 | creative commons zero(?: v?1 0)?(?: universal)?
cc-any | creative commons | creative commons | 3 | 0.6 | creative commons(?: licen[sc]e)?
cc-url | licen | creativecommons org | 2 | 0.8 | creativecommons org licen[sc]es by(?: (?:sa|nd|nc|nc sa|nc nd))?(?: [1-4] [05])?
cc-url | creativecommons | publicdomain | 2 | 0.8 | creativecommons org publicdomain (?:zero|mark) 1 0
apache-url | licen | apache org licen | 2 | 0.8 | apache org licen[sc]es licen[sc]e 2 0
gnu-url | gnu | gnu org licen | 2 | 0.8 | gnu org licen[sc]es(?: (?:old licen[sc]es )?(?:a|l)?gpl(?: [123] [01])?)?
osi-url | licen | opensource org licen | 2 | 0.8 | opensource org licen[sc]es (?:mit|bsd|isc|apache|gpl|lgpl|mpl|zlib)(?: licen[sc]e)?
mpl-header | source code | subject to the terms of the mozilla | 1 | 0.95 | this source code form is subject to the terms of the mozilla public licen[sc]e(?: v(?:ersion)?)?(?: 2 0)?
mpl-header | licen | contents of this file are subject | 2 | 0.8 | the contents of this file are subject to the (?:mozilla|netscape|sun|common) public licen[sc]e
npl-any | licen | netscape public | 1 | 0.9 | netscape public licen[sc]e(?: version)?(?: 1 [01])?
epl-header | licen | made available under the | 2 | 0.8 | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
cddl-header | licen | subject to the terms of the common development | 2 | 0.8 | subject to the terms of the common development and distribution licen[sc]e
eupl-header | licen | licensed under the eupl | 1 | 0.9 | licensed under the eupl(?: version)?(?: 1 [012])?
ofl-header | licen | this font software is licensed | 1 | 0.95 | this font software is licensed under the sil open font licen[sc]e(?: version 1 1)?
proprietary | proprietary | proprietary | 2 | 0.8 | (?:confidential and proprietary|proprietary and confidential|proprietary licen[sc]e)
trade-secret | proprietary | trade secret | 2 | 0.7 | proprietary(?: and confidential)?(?: information)?(?: [^ ]+){0,6} trade secrets?
no-copying | unauthorized | unauthorized | 2 | 0.8 | unauthorized (?:copying|reproduction|use|distribution)(?: [^ ]+){0,6} (?:prohibited|forbidden)
no-reproduction | permission | no part of this | 2 | 0.8 | no part of this (?:publication|book|work|document|file) may be reproduced(?: [^ ]+){0,24} permission
with-permission | permission | permission of the | 4 | 0.3 | (?:reprinted|reproduced|used) (?:with|by) (?:the )?(?:kind )?permission of the (?:author|publisher|copyright holder)s?
non-commercial | commercial use | commercial use | 3 | 0.5 | (?:for )?non commercial use only
no-commercial-use | commercial use | commercial use | 3 | 0.5 | commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not allowed|not permitted)
evaluation-only | licen | licen | 2 | 0.7 | (?:trial|evaluation) licen[sc]e(?: agreement)?
eula | licen | end user licen | 2 | 0.7 | end user licen[sc]e agreement
dual-licensed | licen | dual licen | 3 | 0.5 | dual licen[sc]ed?(?: under)?
copyright | copyright | copyright | 3 | 0.4 | copyright(?: c)? [12][0-9]{3}(?: [12][0-9]{3})*
copyright-notice | copyright | copyright notice | 4 | 0.3 | (?:the )?(?:above )?copyright notice
copyright-holder | copyright | copyright holder | 4 | 0.3 | copyright holders?
licensed-under | licen | under | 4 | 0.4 | licen[sc]ed under(?: the)?
see-license | licen | see | 4 | 0.3 | see (?:the )?licen[sc]e(?: file)?
see-copying | copying | copying file | 4 | 0.3 | see (?:the )?copying file
license-terms | licen | terms | 4 | 0.3 | (?:under|to) the (?:terms|terms and conditions) of (?:the|this) licen[sc]e
all-rights | licen | rights not expressly granted | 3 | 0.4 | (?:all )?rights not expressly granted(?: [^ ]+){0,8} licen[sc]e
"""
#: Stems that open a text and its stretches: each begins a word in every match of its rules.
GATES = (
    "licen", "gpl", "lgpl", "agpl", "gnu", "spdx", "cc by", "creative commons", "creativecommons", "cc0", "bsd", "freebsd", "permission", "redistribution",
    "warrant", "copyright", "copying", "public domain", "proprietary", "unauthorized", "unlicense", "wtfpl", "commons clause", "commercial use", "shall be used", "source code",
)
#: Words kept on either side of a stem; no rule reaches further from its own.
REACH = 40


def _signatures() -> list[tuple]:
    rows = [tuple(cell.strip() for cell in line.split(" | ")) for line in SIGNATURES.strip().splitlines()]
    return [(label, int(p), float(c), gate, keyword, pattern) for label, gate, keyword, p, c, pattern in rows]


def rules() -> list[dict]:
    """The ordered rules: number, label, priority, confidence, gate, keyword, pattern over words."""
    out: list[tuple] = []
    for name in SPDX_IDS:
        words = re.sub(r"[^a-z0-9]+", " ", name.lower())
        tag, keyword = f"spdx licen[sc]e identifier {words}", f"identifier {words}"
        if "gpl" in words:
            out += [(f"{name.lower()}-or-later", 0, 1.0, "spdx", keyword, f"{tag}(?:{PLUS}| or later)"), (f"{name.lower()}-only", 0, 1.0, "spdx", keyword, f"{tag} only"), (name.lower(), 0, 1.0, "spdx", keyword, tag)]
        else:
            out.append((name.lower(), 0, 1.0, "spdx", keyword, f"{tag}(?: only| or later)?"))
    for short, long in CC_TERMS.items():
        label, begin = "cc-" + short.replace(" ", "-"), "creative commons attribution"
        for v in CC_VERSIONS:
            out.append((f"{label}-{v.replace(' ', '.')}", 1, 0.95, "cc by", f"cc {short} {v}", f"cc {short} {v}"))
            out.append((f"{label}-{v.replace(' ', '.')}", 1, 0.95, "creative commons", begin, f"creative commons {long}(?: {v} (?:international|unported|generic)|(?: licen[sc]e)?(?: version)? {v})"))
        out.append((f"{label}-any", 2, 0.8, "cc by", f"cc {short}", f"cc {short}"))
        out.append((f"{label}-any", 2, 0.8, "creative commons", begin, f"creative commons {long}(?: licen[sc]e)?"))
    for short, (name, versions) in GNU.items():
        keyword = "affero general public" if short == "agpl" else "general public"
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}{'' if ' ' in v else '.0'}"
            for tail, end in (("-or-later", f"(?:{PLUS}| or (?:at your option )?(?:any )?later(?: version)?)"), ("-only", " only"), ("", "")):
                out.append((label + tail, 1, 0.95, "licen", keyword, f"(?:gnu )?{name}(?: as published by the free software foundation)?(?: either)? (?:version |v)?{v}(?: 0)?(?: of the licen[sc]e)?{end}"))
                out.append((label + tail, 1, 0.95, short, short, f"(?:gnu )?{short} ?(?:version |v)?{v}(?: 0)?{end}"))
        out.append((f"{short}-any", 2, 0.8, "licen", keyword, f"(?:gnu )?{name}"))
    for short, (name, versions) in VERSIONED.items():
        keyword = re.match("[a-z ]+", name)[0]
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}"
            out.append((label, 1, 0.95, "licen", keyword, f"{name}(?: version| v)? {v}"))
            out.append((label, 1, 0.9, "licen", keyword, f"{name} v{v}"))
        out.append((f"{short}-any", 2, 0.8, "licen", keyword, name))
    out += _signatures()
    return [{"rule": n, "label": label, "priority": p, "confidence": c, "gate": g, "keyword": k, "pattern": f"(?<![^ ])(?:{pattern})(?![^ ])"} for n, (label, p, c, g, k, pattern) in enumerate(out)]


RULE_TYPE = "array<struct<rule:int,label:string,priority:int,confidence:double,pattern:string>>"
PRIORITIES = 6


def word_count(text: Column) -> Column:
    """Words of a text that has one blank between them and none at its ends."""
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def lowered(text: Column) -> Column:
    """Small letters for A-Z. Two signs whose small letters would be, or begin with, one of a-z stay outside of them."""
    for sign, other in (("\u0130", "\u0131"), ("\u212a", "\u0138")):
        text = F.when(F.contains(text, F.lit(sign)), F.replace(text, F.lit(sign), F.lit(other))).otherwise(text)
    return F.lower(text)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts and base phrases, and the stretches around the stems of the gate, each with the word that it begins with."""
    low = lowered(text_of(text_col))
    marked = F.when(F.contains(low, F.lit("+")) & (F.contains(low, F.lit("gpl")) | F.contains(low, F.lit("general"))), F.regexp_replace(low, PLUS_AFTER, f"$1{PLUS} ")).otherwise(low)
    words = F.trim(F.regexp_replace(marked, NOT_A_WORD, " "))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).withColumn("n_words", word_count(F.col("words")))
    # a stem that another one begins with, or ends with, needs no search of its own
    stems = [g for g in GATES if not any(h != g and h in g for h in GATES)]
    open_ = reduce(or_, [F.contains("words", F.lit(g)) for g in stems])
    base = F.array_compact(F.array(*[F.when(F.contains(F.concat(F.lit(" "), "words", F.lit(" ")), F.lit(f" {p} ")), F.lit(name)) for name, p in sorted(BASE.items())]))
    rows = rows.withColumns({"open": open_, "base": base})
    # each word with a blank of its own on either side, so that neighbouring phrases don't share one
    spaced = F.concat(F.lit(" "), F.replace("words", F.lit(" "), F.lit("  ")), F.lit(" "))
    parts = {name: F.split(spaced, f" {p.replace(' ', '  ')} ", -1) for name, p in BASE.items()}
    size = {name: p.count(" ") + 1 for name, p in BASE.items()}
    inside = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))  # noqa: E731  two for each word
    found = F.struct(
        *[(F.size(parts[n]) - 1).cast("long").alias(f"n{k}") for k, n in enumerate(BASE)],
        *[F.when(F.size(parts[n]) > 1, inside(F.element_at(parts[n], 1)) / 2).cast("long").alias(f"first{k}") for k, n in enumerate(BASE)],
        *[F.when(F.size(parts[n]) > 1, F.col("n_words") - inside(F.element_at(parts[n], -1)) / 2 - size[n]).cast("long").alias(f"last{k}") for k, n in enumerate(BASE)],
    )
    rows = rows.withColumn("found", F.when(F.size("base") > 0, found))
    each = range(len(BASE))
    return rows.select(
        "doc_id", F.xxhash64("words").alias("th"), "n_words", "base",
        F.coalesce(reduce(add, [F.col(f"found.n{k}") for k in each]), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[F.col(f"found.first{k}") for k in each]).alias("first_word"), F.greatest(*[F.col(f"found.last{k}") for k in each]).alias("last_word"),
        F.when(F.col("open"), stretches(F.col("words"))).alias("stretches"),
    )


CUT, STEM = "\u0002", "\u0001"


def stretches(words: Column) -> Column:
    """Stretches of REACH words on either side of each stem, and between them the numbers of words left out.

    The words are cut before each word that begins with a stem. Of the piece before the first one the end stays, of the last one the
    beginning, of one between two stems both, unless they meet.
    """
    pieces = F.split(F.regexp_replace(words, f"(^| )(?={'|'.join(GATES)})", f"$1{STEM}"), STEM, -1)
    head, tail = lambda p: F.substring_index(p, " ", REACH), lambda p: F.substring_index(p, " ", -REACH)

    def kept(piece: Column, k: Column) -> Column:
        p = F.trim(piece)
        n, left_out = word_count(p), lambda few: F.concat(F.lit(CUT), (word_count(p) - few).cast("string"), F.lit(CUT))
        whole = F.when(p == "", F.lit("")).otherwise(F.concat(p, F.lit(" ")))
        long_ = F.when(k == 0, F.concat(left_out(REACH), tail(p), F.lit(" "))).when(n > 2 * REACH, F.concat(head(p), left_out(2 * REACH), tail(p), F.lit(" "))).otherwise(whole)
        return F.when(n > REACH, long_).otherwise(whole)

    last = F.trim(F.element_at(pieces, -1))
    between = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), kept)
    return F.when(F.size(pieces) > 1, F.split(F.concat(F.array_join(between, ""), head(last)), CUT, -1))


def detections(rows: DataFrame) -> DataFrame:
    """(doc_id, th, rule, label, priority, confidence, begin, stop) of the rules that match and aren't suppressed, in words of the text."""
    each = rows.where("stretches is not null").select("doc_id", "th", F.posexplode("stretches").alias("k", "part"))
    # stretches and numbers of words left out take turns
    each = each.withColumn("words", F.when(F.col("k") % 2 == 1, F.col("part").cast("long")).otherwise(word_count(F.trim("part"))))
    upto = Window.partitionBy("doc_id", "th").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("at", F.coalesce(F.sum("words").over(upto), F.lit(0))).where("k % 2 = 0 and part <> ''")
    each = each.select("doc_id", "th", "at", F.trim("part").alias("stretch"))
    found = matched(each.select("stretch").distinct())
    return each.join(found, "stretch").select("doc_id", "th", "rule", "label", "priority", "confidence", (F.col("at") + F.col("begin")).alias("begin"), (F.col("at") + F.col("stop")).alias("stop"))


def matched(distinct: DataFrame) -> DataFrame:
    """(stretch, rule, label, priority, confidence, begin, stop): what stays of the rules' matches in each of ``distinct(stretch)``."""
    session, all_rules = distinct.sparkSession, rules()
    by_keyword: dict[str, list] = {}
    for r in all_rules:
        by_keyword.setdefault(r["keyword"], []).append(r)
    none = F.array().cast("array<int>")
    tried = [
        F.when(F.contains("stretch", F.lit(keyword)), F.array_compact(F.array(*[F.when(F.rlike("stretch", F.lit(r["pattern"])), F.lit(r["rule"])) for r in some]))).otherwise(none)
        for keyword, some in by_keyword.items()
    ]
    table = session.range(1).select(F.inline(F.from_json(F.lit(json.dumps(all_rules)), RULE_TYPE)))
    # the rules are a fixed table of a few hundred short rows
    hits = distinct.select("stretch", F.explode(F.flatten(F.array(*tried))).alias("rule")).join(F.broadcast(table), "rule")
    # what stands before each match, and the match, one after another: their word counts add up to places
    pieces = F.expr(r"regexp_extract_all(stretch, concat('(?s)(.*?)(', pattern, ')'), 1)")
    matches = F.expr("regexp_extract_all(stretch, pattern, 0)")
    names = ["stretch", "rule", "label", "priority", "confidence"]
    each = hits.select(*names, F.posexplode(F.arrays_zip(pieces.alias("before"), matches.alias("match"))).alias("k", "m"))
    each = each.select(*names, "k", word_count(F.trim("m.before")).alias("skip"), word_count(F.trim("m.match")).alias("len"))
    run = Window.partitionBy("stretch", "rule").orderBy("k")
    begin = F.sum("skip").over(run) + F.sum("len").over(run) - F.col("len")
    return surviving(each.withColumn("begin", begin).withColumn("stop", F.col("begin") + F.col("len")).drop("k", "skip", "len"))


def surviving(found: DataFrame) -> DataFrame:
    """Detections that don't lie inside another of the same stretch with the same or a stronger priority (of equals, the earlier rule)."""
    before = Window.partitionBy("stretch").orderBy("begin", F.col("stop").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.coalesce(F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(before), F.lit(-1))) for p in range(PRIORITIES)])
    return found.withColumn("reach", reach).where("reach < stop").drop("reach")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the confidence of the surest detection that stays, 0 without one. Null and empty texts have no words and empty
    labels. Rows that share id and words get the same labels; each stays a row of its own. Texts of any length are read whole; empty tables give no
    rows, and further columns, whatever their names, are ignored.
    """
    rows = materialise(scanned(docs, id_col, text_col), "license-scan")
    kept = detections(rows)
    per = kept.groupBy("doc_id", "th").agg(F.collect_set("label").alias("more"), F.max("confidence").alias("sure")).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "more", "sure")
    joined = rows.drop("stretches").join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    sure = F.greatest(F.coalesce("sure", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), sure.alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
