"""The signature rules of the license scan: hand-written names, links and phrasings.

Each license has an identifier, patterns for its name, and the links that
quote it. Four ways in which texts refer to a license turn these into rules.
Further rules are signatures of what licenses and notices say themselves, and
general statements about rights. A rule's priority is its way's: the lower,
the more exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# identifier | name patterns, ";"-separated | link patterns, ";"-separated | keywords of name and links, ","-separated
_LICENSES = r"""
apache-2.0 | apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?;apache[- ]2\.0 | apache\.org/licenses/license-2\.0 | apache
apache-1.1 | apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.1 | apache\.org/licenses/license-1\.1 | apache
apache-1.0 | apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.0 | apache\.org/licenses/license-1\.0 | apache
mit | (?:the )?mit(?:/expat)? licen[cs]e;expat licen[cs]e | opensource\.org/licenses?/mit;mit-license\.org | mit licen,expat licen,mit/expat,licenses/mit,license/mit,mit-license
mit-0 | mit no attribution(?: licen[cs]e)?;mit-0 licen[cs]e | opensource\.org/licenses?/mit-0 | mit no attribution,mit-0
bsd-2-clause | (?:simplified |free)bsd licen[cs]e;(?:2|two)[- ]clause bsd(?: licen[cs]e)?;bsd[- ]2[- ]clause | opensource\.org/licenses?/bsd-2-clause | bsd
bsd-3-clause | (?:new|modified|revised) bsd licen[cs]e;(?:3|three)[- ]clause bsd(?: licen[cs]e)?;bsd[- ]3[- ]clause | opensource\.org/licenses?/bsd-3-clause | bsd
bsd-4-clause | original bsd licen[cs]e;(?:4|four)[- ]clause bsd(?: licen[cs]e)?;bsd[- ]4[- ]clause | directory\.fsf\.org/wiki/license:bsd-4-clause | bsd
0bsd | zero[- ]clause bsd(?: licen[cs]e)?;bsd zero clause licen[cs]e | opensource\.org/licenses?/0bsd | bsd
isc | (?:the )?isc licen[cs]e;internet systems consortium licen[cs]e | opensource\.org/licenses?/isc | isc licen,internet systems,licenses/isc,license/isc
gpl-1.0 | gnu general public licen[cs]e,? ?(?:version |v\.? ?)?1;gpl ?v?\.?1 | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0 | general public,gpl
gpl-2.0 | gnu general public licen[cs]e,? ?(?:version |v\.? ?)?2;gpl ?v?\.?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0 | general public,gpl
gpl-3.0 | gnu general public licen[cs]e,? ?(?:version |v\.? ?)?3;gpl ?v?\.?3(?:\.0)? | gnu\.org/licenses/gpl-3\.0 | general public,gpl
lgpl-2.0 | (?:library|lesser) general public licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?;lgpl ?v?2(?:\.0)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0 | general public,lgpl
lgpl-2.1 | lesser general public licen[cs]e,? ?(?:version |v\.? ?)?2\.1;lgpl ?v?2\.1 | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1 | general public,lgpl
lgpl-3.0 | lesser general public licen[cs]e,? ?(?:version |v\.? ?)?3;lgpl ?v?3(?:\.0)? | gnu\.org/licenses/lgpl-3\.0 | general public,lgpl
agpl-3.0 | affero general public licen[cs]e,? ?(?:version |v\.? ?)?3;agpl ?v?3(?:\.0)? | gnu\.org/licenses/agpl-3\.0 | affero,agpl
agpl-1.0 | affero general public licen[cs]e,? ?(?:version |v\.? ?)?1;agpl ?v?1(?:\.0)? | affero\.org/oagpl | affero,agpl
gfdl-1.2 | gnu free documentation licen[cs]e,? ?(?:version |v\.? ?)?1\.2 | gnu\.org/licenses/old-licenses/fdl-1\.2 | free documentation,fdl
gfdl-1.3 | gnu free documentation licen[cs]e(?:,? ?(?:version |v\.? ?)?1\.3)?;gfdl | gnu\.org/licenses/fdl-1\.3 | free documentation,fdl
mpl-1.0 | mozilla public licen[cs]e,? ?(?:version |v\.? ?)?1\.0;mpl ?v?1\.0 | mozilla\.org/mpl/1\.0 | mozilla,mpl
mpl-1.1 | mozilla public licen[cs]e,? ?(?:version |v\.? ?)?1\.1;mpl ?v?1\.1 | mozilla\.org/mpl/1\.1 | mozilla,mpl
mpl-2.0 | mozilla public licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?;mpl ?v?2\.0 | mozilla\.org/(?:en-us/)?mpl/2\.0 | mozilla,mpl
epl-1.0 | eclipse public licen[cs]e,? ?(?:-|version |v\.? ?)* ?1(?:\.0)?;epl ?v?1\.0 | eclipse\.org/legal/epl-v10 | eclipse,epl
epl-2.0 | eclipse public licen[cs]e,? ?(?:-|version |v\.? ?)* ?2(?:\.0)?;epl ?v?2\.0 | eclipse\.org/legal/epl-(?:v20|2\.0) | eclipse,epl
edl-1.0 | eclipse distribution licen[cs]e | eclipse\.org/org/documents/edl-v10 | eclipse
cddl-1.0 | common development and distribution licen[cs]e(?:,? ?(?:version |v\.? ?)?1\.0)?;cddl ?v?1\.0 | opensource\.org/licenses?/cddl-1\.0 | common development,cddl
cddl-1.1 | common development and distribution licen[cs]e,? ?(?:version |v\.? ?)?1\.1;cddl ?v?1\.1 | oracle\.com/\S{0,40}cddl | common development,cddl
cpl-1.0 | common public licen[cs]e | opensource\.org/licenses?/cpl1\.0 | common public,cpl
eupl-1.1 | european union public licen[cs]e,? ?(?:version |v\.? ?)?1\.1;eupl ?v?1\.1 | opensource\.org/licenses?/eupl-1\.1 | european union public,eupl
eupl-1.2 | european union public licen[cs]e,? ?(?:version |v\.? ?)?1\.2;eupl ?v?1\.2 | joinup\.ec\.europa\.eu/\S{0,60}eupl | european union public,eupl
cc0-1.0 | creative commons zero(?: v?1\.0)?;cc0(?: 1\.0)?(?: universal)? | creativecommons\.org/publicdomain/zero | creative commons zero,cc0,publicdomain/zero
cc-by-1.0 | creative commons attribution(?: \w+)? 1\.0;cc[- ]by 1\.0 | creativecommons\.org/licenses/by/1\.0 | creative,cc by,cc-by
cc-by-2.0 | creative commons attribution(?: \w+)? 2\.0;cc[- ]by 2\.0 | creativecommons\.org/licenses/by/2\.0 | creative,cc by,cc-by
cc-by-2.5 | creative commons attribution(?: \w+)? 2\.5;cc[- ]by 2\.5 | creativecommons\.org/licenses/by/2\.5 | creative,cc by,cc-by
cc-by-3.0 | creative commons attribution(?: \w+)? 3\.0;cc[- ]by 3\.0 | creativecommons\.org/licenses/by/3\.0 | creative,cc by,cc-by
cc-by-4.0 | creative commons attribution(?: \w+)? 4\.0;cc[- ]by 4\.0 | creativecommons\.org/licenses/by/4\.0 | creative,cc by,cc-by
cc-by-sa-2.0 | creative commons attribution[- ]share-?alike(?: \w+)? 2\.0;cc[- ]by[- ]sa 2\.0 | creativecommons\.org/licenses/by-sa/2\.0 | creative,cc by,cc-by
cc-by-sa-3.0 | creative commons attribution[- ]share-?alike(?: \w+)? 3\.0;cc[- ]by[- ]sa 3\.0 | creativecommons\.org/licenses/by-sa/3\.0 | creative,cc by,cc-by
cc-by-sa-4.0 | creative commons attribution[- ]share-?alike(?: \w+)? 4\.0;cc[- ]by[- ]sa 4\.0 | creativecommons\.org/licenses/by-sa/4\.0 | creative,cc by,cc-by
cc-by-nd-3.0 | creative commons attribution[- ]no-?derivatives(?: \w+)? 3\.0;cc[- ]by[- ]nd 3\.0 | creativecommons\.org/licenses/by-nd/3\.0 | creative,cc by,cc-by
cc-by-nd-4.0 | creative commons attribution[- ]no-?derivatives(?: \w+)? 4\.0;cc[- ]by[- ]nd 4\.0 | creativecommons\.org/licenses/by-nd/4\.0 | creative,cc by,cc-by
cc-by-nc-2.0 | creative commons attribution[- ]non-?commercial(?: \w+)? 2\.0;cc[- ]by[- ]nc 2\.0 | creativecommons\.org/licenses/by-nc/2\.0 | creative,cc by,cc-by
cc-by-nc-3.0 | creative commons attribution[- ]non-?commercial(?: \w+)? 3\.0;cc[- ]by[- ]nc 3\.0 | creativecommons\.org/licenses/by-nc/3\.0 | creative,cc by,cc-by
cc-by-nc-4.0 | creative commons attribution[- ]non-?commercial(?: \w+)? 4\.0;cc[- ]by[- ]nc 4\.0 | creativecommons\.org/licenses/by-nc/4\.0 | creative,cc by,cc-by
cc-by-nc-sa-3.0 | creative commons attribution[- ]non-?commercial[- ]share-?alike(?: \w+)? 3\.0;cc[- ]by[- ]nc[- ]sa 3\.0 | creativecommons\.org/licenses/by-nc-sa/3\.0 | creative,cc by,cc-by
cc-by-nc-sa-4.0 | creative commons attribution[- ]non-?commercial[- ]share-?alike(?: \w+)? 4\.0;cc[- ]by[- ]nc[- ]sa 4\.0 | creativecommons\.org/licenses/by-nc-sa/4\.0 | creative,cc by,cc-by
cc-by-nc-nd-4.0 | creative commons attribution[- ]non-?commercial[- ]no-?derivatives(?: \w+)? 4\.0;cc[- ]by[- ]nc[- ]nd 4\.0 | creativecommons\.org/licenses/by-nc-nd/4\.0 | creative,cc by,cc-by
artistic-1.0 | artistic licen[cs]e,? ?(?:version |v\.? ?)?1(?:\.0)? | opensource\.org/licenses?/artistic-1\.0 | artistic
artistic-2.0 | artistic licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)? | opensource\.org/licenses?/artistic-2\.0 | artistic
bsl-1.0 | boost software licen[cs]e(?:,? ?(?:-|version |v\.? ?)* ?1\.0)? | boost\.org/license_1_0 | boost
zlib | (?:the )?zlib(?:/libpng)? licen[cs]e | zlib\.net/zlib_license;opensource\.org/licenses?/zlib | zlib
libpng | libpng licen[cs]e | libpng\.org/pub/png/src/libpng-license | libpng
unlicense | (?:the )?unlicen[cs]e;released into the public domain | unlicense\.org | unlicen,public domain
wtfpl | do what the f\S{0,6} you want to public licen[cs]e;wtfpl | wtfpl\.net | do what the,wtfpl
ofl-1.1 | sil open font licen[cs]e(?:,? ?(?:version |v\.? ?)?1\.1)? | scripts\.sil\.org/ofl;openfontlicense\.org | open font,sil.org/ofl,openfont
python-2.0 | python software foundation licen[cs]e;psf licen[cs]e | docs\.python\.org/3/license | python software,psf licen,python.org
ruby | (?:the )?ruby licen[cs]e | ruby-lang\.org/en/about/license | ruby
php-3.01 | php licen[cs]e(?:,? ?(?:version |v\.? ?)?3\.01)? | php\.net/license/3_01 | php
postgresql | (?:the )?postgresql licen[cs]e | postgresql\.org/about/licen[cs]e | postgresql
odbl-1.0 | open (?:data commons )?(?:open )?database licen[cs]e;odbl ?v?1\.0 | opendatacommons\.org/licenses/odbl | database licen,odbl
odc-by-1.0 | open data commons attribution licen[cs]e;odc-by | opendatacommons\.org/licenses/by | open data commons,odc-by,opendatacommons
pddl-1.0 | public domain dedication and licen[cs]e;pddl | opendatacommons\.org/licenses/pddl | public domain dedication,pddl
sspl-1.0 | server side public licen[cs]e;sspl ?v?1 | mongodb\.com/licensing/server-side-public-license | server side public,sspl,server-side-public
busl-1.1 | business source licen[cs]e(?:,? ?(?:version |v\.? ?)?1\.1)? | mariadb\.com/bsl11 | business source,bsl11
elastic-2.0 | elastic licen[cs]e(?:,? ?(?:version |v\.? ?)?2(?:\.0)?)? | elastic\.co/licensing/elastic-license | elastic
upl-1.0 | universal permissive licen[cs]e | opensource\.org/licenses?/upl | universal permissive,/upl
ms-pl | microsoft public licen[cs]e;ms-pl | opensource\.org/licenses?/ms-pl | microsoft public,ms-pl
ms-rl | microsoft reciprocal licen[cs]e;ms-rl | opensource\.org/licenses?/ms-rl | microsoft reciprocal,ms-rl
openrail-m | (?:creativeml |bigscience )?open ?rail(?:\+\+)?-m | huggingface\.co/spaces/\S{0,40}license | openrail,open rail,huggingface
"""

# way | priority | confidence | pattern around NAME, ID or LINK
_WAYS = r"""
tag | 1 | 0.99 | spdx-license-identifier: ?ID
link | 2 | 0.95 | (?:https?://)?(?:www\.)?LINK[^\s"'<>)]*
grant | 3 | 0.9 | (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?NAME
name | 4 | 0.7 | (?<![0-9a-z\x80-\U0010ffff])NAME(?![0-9a-z\x80-\U0010ffff])
"""

_TEXT_PRIORITY = 3

# Signatures of license texts and notices, whose sentences rules see with single spaces:
# label | confidence | pattern | keyword
_TEXTS = r"""
mit | 0.9 | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files | hereby granted
mit | 0.8 | the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software | permission notice
mit | 0.6 | the software is provided ["“']?as is["”']?, without warranty of any kind, express or implied | without warranty of any kind
x11 | 0.8 | except as contained in this notice, the names? of [^.]{1,100}? shall not be used in advertising | contained in this notice
bsl-1.0 | 0.9 | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation | hereby granted
unicode-dfs | 0.9 | permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files | hereby granted
json | 0.9 | the software shall be used for good, not evil | good, not evil
isc | 0.9 | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies | hereby granted
0bsd | 0.85 | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. | hereby granted
isc | 0.6 | the author disclaims all warranties with regard to this software | disclaims all warranties
hpnd | 0.8 | permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and )?(?:with or )?without fee is hereby granted | hereby granted
postgresql | 0.9 | permission to use, copy, modify,? and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted | hereby granted
bsd | 0.7 | redistributions? of source code must retain the (?:above )?copyright notice | redistribution
bsd | 0.7 | redistributions? in binary form must reproduce the (?:above )?copyright notice | redistribution
bsd-3-clause | 0.9 | neither the names? of [^.]{1,120}? nor the names of (?:its|the|their) contributors may be used to endorse or promote products | endorse or promote
bsd-3-clause | 0.8 | the names? of [^.]{1,80}? may not be used to endorse or promote products derived from this software | endorse or promote
bsd-4-clause | 0.9 | all advertising materials mentioning features or use of this software must display | advertising materials
bsd | 0.6 | this software is provided by [^.]{1,100}? ["“'`]{0,2}as is["”']{0,2} and any express or implied warranties | express or implied
bsd-2-clause | 0.8 | the views and conclusions contained in the software and documentation are those of the authors | views and conclusions
bsd-3-clause-clear | 0.9 | no express or implied licenses to any party's patent rights are granted | patent rights
apache-2.0 | 0.95 | licensed under the apache licen[cs]e, version 2\.0 \(the ["“]licen[cs]e["”]\) | apache
apache-2.0 | 0.9 | software distributed under the licen[cs]e is distributed on an ["“]as is["”] basis, without warranties or conditions of any kind | without warranties or conditions
apache-2.0 | 0.8 | terms and conditions for use, reproduction, and distribution | terms and conditions for use
apache-2.0 | 0.9 | each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable | each contributor hereby grants
apache-1.1 | 0.8 | this product includes software developed by the apache software foundation | apache
apache-1.0 | 0.8 | this product includes software developed by the apache group | apache
openssl | 0.9 | this product includes software developed by the openssl project | openssl
ssleay | 0.9 | this product includes cryptographic software written by eric young | eric young
gpl | 0.85 | this (?:program|file|software|package) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e | free software
lgpl | 0.85 | this (?:library|program|file|software) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e | free software
agpl | 0.85 | this (?:program|file|software) is free software[;:,] you can redistribute it and/or modify it under the terms of the gnu affero general public licen[cs]e | free software
gpl-1.0-or-later | 0.9 | gnu general public licen[cs]e as published by the free software foundation[;,] either version 1(?: of the licen[cs]e)?,? or \(at your option\) any later version | general public
gpl-2.0-or-later | 0.95 | gnu general public licen[cs]e as published by the free software foundation[;,] either version 2(?: of the licen[cs]e)?,? or \(at your option\) any later version | general public
gpl-3.0-or-later | 0.95 | gnu general public licen[cs]e as published by the free software foundation[;,] either version 3(?: of the licen[cs]e)?,? or \(at your option\) any later version | general public
lgpl-2.0-or-later | 0.95 | gnu library general public licen[cs]e as published by the free software foundation[;,] either version 2(?: of the licen[cs]e)?,? or \(at your option\) any later version | general public
lgpl-2.1-or-later | 0.95 | gnu lesser general public licen[cs]e as published by the free software foundation[;,] either version 2\.1(?: of the licen[cs]e)?,? or \(at your option\) any later version | general public
lgpl-3.0-or-later | 0.95 | gnu lesser general public licen[cs]e as published by the free software foundation[;,] either version 3(?: of the licen[cs]e)?,? or \(at your option\) any later version | general public
agpl-3.0-or-later | 0.95 | gnu affero general public licen[cs]e as published by the free software foundation[;,] either version 3(?: of the licen[cs]e)?,? or \(at your option\) any later version | affero
gpl-2.0-only | 0.85 | gnu general public licen[cs]e,? version 2,? as published by the free software foundation | general public
gpl-3.0-only | 0.85 | gnu general public licen[cs]e,? version 3,? as published by the free software foundation | general public
gpl-2.0 | 0.8 | version 2 of the gnu general public licen[cs]e | general public
gpl-3.0 | 0.8 | version 3 of the gnu general public licen[cs]e | general public
gpl | 0.7 | you should have received a copy of the gnu general public licen[cs]e along with | general public
lgpl | 0.7 | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with | general public
agpl | 0.7 | you should have received a copy of the gnu affero general public licen[cs]e along with | affero
gpl-2.0 | 0.95 | gnu general public licen[cs]e version 2, june 1991 | general public
gpl-3.0 | 0.95 | gnu general public licen[cs]e version 3, 29 june 2007 | general public
lgpl-2.1 | 0.95 | gnu lesser general public licen[cs]e version 2\.1, february 1999 | general public
lgpl-3.0 | 0.95 | gnu lesser general public licen[cs]e version 3, 29 june 2007 | general public
agpl-3.0 | 0.95 | gnu affero general public licen[cs]e version 3, 19 november 2007 | affero
gpl | 0.8 | the licenses for most software are designed to take away your freedom to share and change it | your freedom to share
gpl-3.0 | 0.9 | the gnu general public licen[cs]e is a free, copyleft licen[cs]e for software and other kinds of works | general public
agpl-3.0 | 0.9 | remote network interaction; use with the gnu general public licen[cs]e | remote network interaction
gfdl | 0.9 | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation licen[cs]e | free documentation
gnu-text | 0.6 | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document | verbatim copies
classpath-exception | 0.85 | as a special exception, the copyright holders of this library give you permission to link this library | special exception
bison-exception | 0.85 | as a special exception, you may create a larger work that contains part or all of the bison parser skeleton | special exception
gcc-exception | 0.8 | gcc runtime library exception | runtime library exception
mpl-2.0 | 0.95 | this source code form is subject to the terms of the mozilla public licen[cs]e, v\. ?2\.0 | mozilla
mpl-2.0 | 0.8 | if a copy of the mpl was not distributed with this file | copy of the mpl
mpl-2.0-no-copyleft-exception | 0.8 | this source code form is ["“]incompatible with secondary licenses["”] | secondary licenses
mpl-1.1 | 0.95 | the contents of this file are subject to the mozilla public licen[cs]e,? version 1\.1 | mozilla
mpl-1.0 | 0.95 | the contents of this file are subject to the mozilla public licen[cs]e,? version 1\.0 | mozilla
epl-1.0 | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v ?1\.0 | eclipse
epl-2.0 | 0.95 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v ?)?2\.0 | eclipse
epl | 0.8 | the accompanying program is provided under the terms of this eclipse public licen[cs]e | eclipse
cpl-1.0 | 0.9 | the accompanying program is provided under the terms of this common public licen[cs]e | common public
cddl | 0.9 | the contents of this file are subject to the terms of the common development and distribution licen[cs]e | common development
zlib | 0.8 | this software is provided ["“'‘]as-is["”'’], without any express or implied warranty | express or implied
zlib | 0.85 | altered source versions must be plainly marked as such | plainly marked
zlib | 0.85 | the origin of this software must not be misrepresented | must not be misrepresented
unlicense | 0.95 | this is free and unencumbered software released into the public domain | unencumbered software
unlicense | 0.85 | anyone is free to copy, modify, publish, use, compile, sell, or distribute this software | anyone is free to copy
wtfpl | 0.9 | you just do what the f\S{0,6} you want to | just do what the
beerware | 0.9 | as long as you retain this notice you can do whatever you want with this stuff | retain this notice
artistic-1.0 | 0.85 | the intent of this document is to state the conditions under which a package may be copied | intent of this document
artistic-2.0 | 0.85 | this licen[cs]e establishes the terms under which a given free software package may be copied | free software package
perl | 0.85 | this (?:library|program|module) is free software[;,] you (?:can|may) redistribute it and/or modify it under the same terms as perl itself | as perl itself
ofl-1.1 | 0.9 | this font software is licensed under the sil open font licen[cs]e | open font
ofl-1.1 | 0.85 | the font software may be sold as part of a larger software package but may not be sold by itself | font software
python-2.0 | 0.9 | this licen[cs]e agreement is between the python software foundation | python software
ijg | 0.8 | this software is based in part on the work of the independent jpeg group | independent jpeg
freetype | 0.8 | portions of this software are copyright [^.]{0,60}? the freetype project | freetype
cc0-1.0 | 0.9 | the person who associated a work with this deed has dedicated the work to the public domain | associated a work with this deed
cc0-1.0 | 0.9 | to the extent possible under law, [^.]{1,120}? (?:has|have) waived all copyright and related or neighbou?ring rights | waived all copyright
cc-by | 0.8 | you must give appropriate credit, provide a link to the licen[cs]e, and indicate if changes were made | appropriate credit
cc-by-sa | 0.8 | if you remix, transform, or build upon the material, you must distribute your contributions under the same licen[cs]e | build upon the material
cc-by-nd | 0.8 | if you remix, transform, or build upon the material, you may not distribute the modified material | build upon the material
cc-by-nc | 0.8 | you may not use the material for commercial purposes | use the material
sspl-1.0 | 0.9 | if you make the functionality of the program or a modified version available to third parties as a service | third parties as a service
busl-1.1 | 0.9 | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work | non-production use
elastic-2.0 | 0.9 | you may not provide the software to third parties as a hosted or managed service | hosted or managed service
commons-clause | 0.9 | the grant of rights under the licen[cs]e will not include, and the licen[cs]e does not grant to you, the right to sell the software | right to sell the software
ms-pl | 0.8 | if you bring a patent claim against any contributor over patents that you claim are infringed by the software | patent claim
proprietary | 0.8 | unauthorized copying of this file,? via any medium,? is strictly prohibited | unauthorized copying
proprietary | 0.7 | (?:confidential and proprietary|proprietary and confidential)(?: information| property)?(?: of)? | confidential
proprietary | 0.7 | may not be (?:reproduced|copied|distributed|republished|used)[^.]{0,80}? without (?:the )?(?:prior |express |explicit )*written (?:permission|consent) | written
no-training | 0.8 | may not be used (?:to train|for (?:the )?training(?: of)?|in the training of) (?:any )?(?:ai|artificial intelligence|machine learning|language) | may not be used
noncommercial | 0.7 | for (?:personal,? |private,? |academic,? |educational,? |and )*non-?commercial (?:use|purposes?) only | commercial
research-only | 0.7 | for (?:academic |scientific |research |educational |and )+(?:use|purposes?) only | only
us-government | 0.7 | (?:this|a|is a) work of the (?:u\.s\.|united states) government | government
"""

# Rules of any license: label | priority | confidence | pattern | keyword
_GENERAL = r"""
reserved | 5 | 0.6 | all rights reserved | rights
copyright | 6 | 0.4 | copyright (?:\(c\) |© )?(?:19|20)[0-9]{2} | copyright
licensed | 7 | 0.3 | (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?[^\s.;]{1,60} | licen
public-domain | 5 | 0.6 | (?:in|into|to) the public domain | public domain
no-warranty | 6 | 0.5 | (?:provided )?"?as is"?,? without (?:any )?warranty | without
permission | 5 | 0.6 | permission is hereby granted, free of charge | hereby granted
redistribution | 5 | 0.6 | redistribution and use in source and binary forms | redistribution
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    pattern: re.Pattern
    keywords: tuple[str, ...]


def _rows(table: str) -> list[list[str]]:
    return [re.split(r" \| ", line.strip()) for line in table.strip().splitlines()]


def build_rules() -> list[Rule]:
    """All rules, in order of priority."""
    rules = []
    for label, names, links, keywords in _rows(_LICENSES):
        words = tuple(k.strip() for k in keywords.split(","))
        name, link = f"(?:{names.strip().replace(';', '|')})", f"(?:{links.strip().replace(';', '|')})"
        for way, priority, confidence, pattern in _rows(_WAYS):
            filled = pattern.replace("NAME", name).replace("LINK", link).replace("ID", re.escape(label) + "(?![0-9a-z.-]*[0-9a-z])")
            gate = ("spdx-license-identifier",) if way == "tag" else words
            rules.append(Rule(label, int(priority), float(confidence), re.compile(filled), gate))
    for label, confidence, pattern, keyword in _rows(_TEXTS):
        rules.append(Rule(label, _TEXT_PRIORITY, float(confidence), re.compile(pattern), (keyword,)))
    for label, priority, confidence, pattern, keyword in _rows(_GENERAL):
        rules.append(Rule(label, int(priority), float(confidence), re.compile(pattern), (keyword,)))
    return sorted(rules, key=lambda rule: (rule.priority, rule.label))
