"""Signature rules of the license scan: license, keywords in lower case, and what to look for.

One of a rule's keywords (separated by ";") must occur in a text (in any case, with any white space as one space) wherever
the rule's regular expression can match; regular expressions ignore case. Kinds, from the strongest: ``tag`` (a machine-readable identifier), ``text`` (words of the license itself), ``url``,
``name`` (a mention). Of one kind, the rule listed first is preferred.
"""

from __future__ import annotations

KINDS = {"tag": 100, "text": 80, "url": 60, "name": 40}

#: license | keywords | name | url (an empty field: no such rule)
NAMES = r"""
Apache-2.0 | apache | \bapache(?:\s+software)?\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*2(?:\.0)?\b | apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-1.1 | apache | \bapache\s+software\s+licen[cs]e,?\s*(?:version|v\.?)?\s*1\.1\b | apache\.org/licenses/license-1\.1
Apache-1.0 | apache | \bapache\s+software\s+licen[cs]e,?\s*(?:version|v\.?)?\s*1\.0\b | apache\.org/licenses/license-1\.0
LicenseRef-Apache | apache | \bapache(?:\s+software)?\s+licen[cs]e\b | apache\.org/licenses/?(?![\w-])
MIT | mit licen | \bmit\s+licen[cs]e\b | opensource\.org/licenses?/mit\b
MIT-0 | mit no | \bmit\s+no\s+attribution\b | opensource\.org/licenses?/mit-0\b
X11 | x11 licen | \bx11\s+licen[cs]e\b | spdx\.org/licenses/x11\b
Expat | expat | \bexpat\s+licen[cs]e\b | jclark\.com/xml/copying\.txt
ISC | isc licen | \bisc\s+licen[cs]e\b | opensource\.org/licenses?/isc\b
0BSD | bsd | \b(?:zero[- ]clause\s+bsd|bsd\s+zero[- ]clause|0bsd)(?:\s+licen[cs]e)?\b | opensource\.org/licenses?/0bsd\b
BSD-2-Clause | bsd | \b(?:bsd[- ]2[- ]clause|(?:2|two)[- ]clause\s+bsd|simplified\s+bsd|freebsd)\s+licen[cs]e\b | opensource\.org/licenses?/bsd-2-clause\b
BSD-3-Clause | bsd | \b(?:bsd[- ]3[- ]clause|(?:3|three)[- ]clause\s+bsd|(?:new|revised|modified)\s+bsd)\s+licen[cs]e\b | opensource\.org/licenses?/bsd-3-clause\b
BSD-4-Clause | bsd | \b(?:bsd[- ]4[- ]clause|(?:4|four)[- ]clause\s+bsd|original\s+bsd)\s+licen[cs]e\b | spdx\.org/licenses/bsd-4-clause\b
BSD-3-Clause-Clear | bsd | \bclear\s+bsd\s+licen[cs]e\b | spdx\.org/licenses/bsd-3-clause-clear\b
LicenseRef-BSD | bsd | \bbsd(?:[- ]style)?\s+licen[cs]e\b | opensource\.org/licenses?/bsd-license
AGPL-3.0 | affero | \b(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*3(?:\.0)?\b | gnu\.org/licenses/agpl(?:-3\.0)?
AGPL-1.0 | affero | \baffero\s+general\s+public\s+licen[cs]e,?\s*(?:version|v\.?)?\s*1(?:\.0)?\b | affero\.org/oagpl
LicenseRef-AGPL | affero | \b(?:gnu\s+)?affero\s+(?:general\s+public\s+licen[cs]e|gpl)\b | affero\.org/?(?![\w/])
LGPL-3.0 | lesser | \b(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*3(?:\.0)?\b | gnu\.org/(?:licenses/lgpl-3\.0|copyleft/lesser)
LGPL-2.1 | lesser | \b(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*2\.1\b | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
LGPL-2.0 | library | \b(?:gnu\s+)?library\s+general\s+public\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*2(?:\.0)?\b | gnu\.org/licenses/old-licenses/lgpl-2\.0
LicenseRef-LGPL | lesser | \b(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e\b | gnu\.org/licenses/lgpl(?:\.html|\.txt)?(?![\w.-])
LicenseRef-LGPL | lgpl | \blgpl\b |
LGPL-2.1 | lgpl | \blgpl[- ]?v?2\.1(?:\+|\b) |
LGPL-3.0 | lgpl | \blgpl[- ]?v?3(?:\.0)?(?:\+|\b) |
GPL-1.0 | general public | \b(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*1(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0
GPL-2.0 | general public | \b(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*2(?:\.0)?\b | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
GPL-3.0 | general public | \b(?:gnu\s+)?general\s+public\s+licen[cs]e,?\s*\(?(?:version|ver\.?|v\.?)?\s*3(?:\.0)?\b | gnu\.org/licenses/gpl-3\.0
LicenseRef-GPL | general public | \b(?:gnu\s+)?general\s+public\s+licen[cs]e\b | gnu\.org/licenses/gpl(?:\.html|\.txt)?(?![\w.-])
GPL-2.0 | gpl | \b(?:gnu\s+)?gpl[- ]?v?2(?:\.0)?(?:\+|\b) |
GPL-3.0 | gpl | \b(?:gnu\s+)?gpl[- ]?v?3(?:\.0)?(?:\+|\b) |
AGPL-3.0 | agpl | \b(?:gnu\s+)?agpl[- ]?v?3(?:\.0)?(?:\+|\b) |
LicenseRef-GPL | gpl | \bgnu\s+gpl\b |
GFDL-1.3 | free documentation | \b(?:gnu\s+)?free\s+documentation\s+licen[cs]e,?\s*\(?(?:version|v\.?)?\s*1\.3\b | gnu\.org/licenses/fdl-1\.3
GFDL-1.2 | free documentation | \b(?:gnu\s+)?free\s+documentation\s+licen[cs]e,?\s*\(?(?:version|v\.?)?\s*1\.2\b | gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2
LicenseRef-GFDL | free documentation | \b(?:gnu\s+)?free\s+documentation\s+licen[cs]e\b | gnu\.org/(?:copyleft|licenses)/fdl(?:\.html|\.txt)?(?![\w.-])
MPL-1.0 | mozilla | \bmozilla\s+public\s+licen[cs]e,?\s*\(?(?:version|v\.?)?\s*1\.0\b | mozilla\.org/mpl/1\.0
MPL-1.1 | mozilla | \bmozilla\s+public\s+licen[cs]e,?\s*\(?(?:version|v\.?)?\s*1\.1\b | mozilla\.org/mpl/(?:1\.1|mpl-1\.1)
MPL-2.0 | mozilla | \bmozilla\s+public\s+licen[cs]e,?\s*\(?(?:version|v\.?)?\s*2(?:\.0)?\b | mozilla\.org/(?:en-us/)?mpl/2\.0
LicenseRef-MPL | mozilla | \bmozilla\s+public\s+licen[cs]e\b | mozilla\.org/mpl/?(?![\w/])
EPL-1.0 | eclipse | \beclipse\s+public\s+licen[cs]e,?\s*(?:-|\()?\s*(?:version|v\.?)?\s*1\.0\b | eclipse\.org/legal/epl-v10
EPL-2.0 | eclipse | \beclipse\s+public\s+licen[cs]e,?\s*(?:-|\()?\s*(?:version|v\.?)?\s*2\.0\b | eclipse\.org/legal/epl-(?:v20|2\.0)
EDL-1.0 | eclipse | \beclipse\s+distribution\s+licen[cs]e\b | eclipse\.org/org/documents/edl-v10
CDDL-1.0 | common development | \bcommon\s+development\s+and\s+distribution\s+licen[cs]e,?\s*(?:\(cddl\),?\s*)?(?:version|v\.?)?\s*1\.0\b | opensource\.org/licenses?/cddl-?1
CDDL-1.1 | common development | \bcommon\s+development\s+and\s+distribution\s+licen[cs]e,?\s*(?:\(cddl\),?\s*)?(?:version|v\.?)?\s*1\.1\b | glassfish\.java\.net/public/cddl
CPL-1.0 | common public | \bcommon\s+public\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*1\.0)? | opensource\.org/licenses?/cpl1\.0
CPAL-1.0 | common public attribution | \bcommon\s+public\s+attribution\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*1\.0)? | opensource\.org/licenses?/cpal_?-?1\.0
EUPL-1.1 | european union public | \beuropean\s+union\s+public\s+licen[cs]e,?\s*(?:version|v\.?)?\s*1\.1\b | joinup\.ec\.europa\.eu/software/page/eupl
EUPL-1.2 | european union public | \beuropean\s+union\s+public\s+licen[cs]e,?\s*(?:version|v\.?)?\s*1\.2\b | joinup\.ec\.europa\.eu/collection/eupl
Artistic-1.0 | artistic | \bartistic\s+licen[cs]e,?\s*(?:version|v\.?)?\s*1(?:\.0)?\b | opensource\.org/licenses?/artistic-license-1\.0
Artistic-2.0 | artistic | \bartistic\s+licen[cs]e,?\s*(?:version|v\.?)?\s*2(?:\.0)?\b | (?:opensource\.org/licenses?/artistic-license-2\.0|perlfoundation\.org/artistic_license_2_0)
LicenseRef-Artistic | artistic | \b(?:perl\s+)?artistic\s+licen[cs]e\b | dev\.perl\.org/licenses
BSL-1.0 | boost | \bboost\s+software\s+licen[cs]e\b(?:,?\s*(?:-\s*)?(?:version|v\.?)?\s*1\.0)? | boost\.org/license_1_0\.txt
Zlib | zlib | \bzlib(?:/libpng)?\s+licen[cs]e\b | opensource\.org/licenses?/zlib\b
Libpng | libpng | \blibpng\s+licen[cs]e\b | libpng\.org/pub/png/src/libpng-license
Unlicense | unlicense | \bthe\s+unlicense\b | unlicense\.org
WTFPL | wtfpl | \bwtfpl\b(?:\s+(?:version|v\.?)?\s*2)? | wtfpl\.net
WTFPL | do what the | \bdo\s+what\s+the\s+f\S{1,3}k\s+you\s+want\s+to\s+public\s+licen[cs]e\b | sam\.zoy\.org/wtfpl
CC0-1.0 | cc0 | \bcc0(?:\s+1\.0)?(?:\s+universal)?\b |
CC0-1.0 | creative | \bcreative\s+commons\s+(?:zero|cc0)\b(?:\s+v?1\.0)?(?:\s+universal)? |
CC0-1.0 | creativecommons | | creativecommons\.org/publicdomain/zero/1\.0
CC-PDDC | creativecommons | | creativecommons\.org/licenses/publicdomain
CC-BY-4.0 | cc by; cc-by | \bcc[- ]by[- ]4\.0\b |
CC-BY-4.0 | cc-by | \bcc-by[- ]4\.0\b |
CC-BY-3.0 | cc by | \bcc\s+by[- ]3\.0\b |
CC-BY-3.0 | cc-by | \bcc-by[- ]3\.0\b |
CC-BY-2.0 | cc by | \bcc\s+by[- ]2\.0\b |
CC-BY-SA-4.0 | cc by | \bcc\s+by-sa[- ]4\.0\b |
CC-BY-SA-4.0 | cc-by | \bcc-by-sa[- ]4\.0\b |
CC-BY-SA-3.0 | cc by | \bcc\s+by-sa[- ]3\.0\b |
CC-BY-SA-3.0 | cc-by | \bcc-by-sa[- ]3\.0\b |
CC-BY-NC-4.0 | cc by | \bcc\s+by-nc[- ]4\.0\b |
CC-BY-NC-4.0 | cc-by | \bcc-by-nc[- ]4\.0\b |
CC-BY-NC-3.0 | cc by | \bcc\s+by-nc[- ]3\.0\b |
CC-BY-ND-4.0 | cc by | \bcc\s+by-nd[- ]4\.0\b |
CC-BY-NC-SA-4.0 | cc by | \bcc\s+by-nc-sa[- ]4\.0\b |
CC-BY-NC-SA-4.0 | cc-by | \bcc-by-nc-sa[- ]4\.0\b |
CC-BY-NC-SA-3.0 | cc by | \bcc\s+by-nc-sa[- ]3\.0\b |
CC-BY-NC-ND-4.0 | cc by | \bcc\s+by-nc-nd[- ]4\.0\b |
CC-BY-NC-ND-4.0 | cc-by | \bcc-by-nc-nd[- ]4\.0\b |
CC-BY-4.0 | attribution | \bcreative\s+commons\s+attribution\s+4\.0\b(?:\s+international)? | creativecommons\.org/licenses/by/4\.0
CC-BY-3.0 | attribution | \bcreative\s+commons\s+attribution\s+3\.0\b(?:\s+unported)? | creativecommons\.org/licenses/by/3\.0
CC-BY-SA-4.0 | sharealike | \bcreative\s+commons\s+attribution[- ]sharealike\s+4\.0\b(?:\s+international)? |
CC-BY-SA-3.0 | sharealike | \bcreative\s+commons\s+attribution[- ]sharealike\s+3\.0\b(?:\s+unported)? |
CC-BY-NC-4.0 | noncommercial | \bcreative\s+commons\s+attribution[- ]noncommercial\s+4\.0\b(?:\s+international)? |
CC-BY-ND-4.0 | noderiv | \bcreative\s+commons\s+attribution[- ]noderiv(?:ative)?s\s+4\.0\b(?:\s+international)? |
CC-BY-NC-SA-4.0 | noncommercial | \bcreative\s+commons\s+attribution[- ]noncommercial[- ]sharealike\s+4\.0\b(?:\s+international)? |
CC-BY-NC-ND-4.0 | noncommercial | \bcreative\s+commons\s+attribution[- ]noncommercial[- ]noderiv(?:ative)?s\s+4\.0\b(?:\s+international)? |
CC-BY-SA-4.0 | creativecommons | | creativecommons\.org/licenses/by-sa/4\.0
CC-BY-SA-3.0 | creativecommons | | creativecommons\.org/licenses/by-sa/3\.0
CC-BY-NC-4.0 | creativecommons | | creativecommons\.org/licenses/by-nc/4\.0
CC-BY-ND-4.0 | creativecommons | | creativecommons\.org/licenses/by-nd/4\.0
CC-BY-NC-SA-4.0 | creativecommons | | creativecommons\.org/licenses/by-nc-sa/4\.0
CC-BY-NC-ND-4.0 | creativecommons | | creativecommons\.org/licenses/by-nc-nd/4\.0
LicenseRef-CC | creative | \bcreative\s+commons(?:\s+licen[cs]e)?\b | creativecommons\.org/licenses/?(?!\w)
LicenseRef-CC | cc by | \bcc\s+by(?:-\w\w){0,2}(?:\s+licen[cs]e)?\b |
LicenseRef-PublicDomain | public domain | \b(?:released|placed|dedicated|put)\s+(?:in)?to?\s*the\s+public\s+domain\b |
LicenseRef-PublicDomain | domaine public | \bdomaine\s+public\b |
LicenseRef-PublicDomain | gemeinfrei | \bgemeinfrei(?:es|e|er)?\b |
PSF-2.0 | python software | \bpython\s+software\s+foundation\s+licen[cs]e(?:\s+version\s+2)? | docs\.python\.org/3/license\.html
Python-2.0 | python licen | \bpython\s+licen[cs]e\s*(?:,?\s*version)?\s*2\.0 | opensource\.org/licenses?/python-2\.0
PHP-3.01 | php | \bphp\s+licen[cs]e,?\s*(?:version|v\.?)?\s*3\.01\b | php\.net/license/3_01
PHP-3.0 | php | \bphp\s+licen[cs]e,?\s*(?:version|v\.?)?\s*3\.0\b | php\.net/license/3_0\b
Ruby | ruby | \bruby(?:'s)?\s+licen[cs]e\b | ruby-lang\.org/en/about/license
OpenSSL | openssl | \bopenssl\s+licen[cs]e\b | openssl\.org/source/license
OFL-1.1 | open font | \b(?:sil\s+)?open\s+font\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*1\.1)? | scripts\.sil\.org/ofl
OFL-1.1 | openfontlicense | | openfontlicense\.org
MS-PL | microsoft public | \bmicrosoft\s+public\s+licen[cs]e\b | opensource\.org/licenses?/ms-pl
MS-RL | microsoft reciprocal | \bmicrosoft\s+reciprocal\s+licen[cs]e\b | opensource\.org/licenses?/ms-rl
ECL-2.0 | educational community | \beducational\s+community\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*2\.0)? | opensource\.org/licenses?/ecl-?2
AFL-3.0 | academic free | \bacademic\s+free\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*3\.0)? | opensource\.org/licenses?/afl-3\.0
OSL-3.0 | open software | \bopen\s+software\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*3\.0)? | opensource\.org/licenses?/osl-3\.0
NCSA | ncsa | \b(?:university\s+of\s+illinois/)?ncsa\s+(?:open\s+source\s+)?licen[cs]e\b | opensource\.org/licenses?/ncsa
UPL-1.0 | universal permissive | \buniversal\s+permissive\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*1\.0)? | oss\.oracle\.com/licenses/upl
PostgreSQL | postgresql | \bpostgresql\s+licen[cs]e\b | postgresql\.org/about/licence
Vim | vim licen | \bvim\s+licen[cs]e\b | vimdoc\.sourceforge\.net/htmldoc/uganda
LPPL-1.3c | latex project | \blatex\s+project\s+public\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*1\.3c?)? | latex-project\.org/lppl
ODbL-1.0 | database licen | \bopen\s+(?:data\s+commons\s+)?(?:open\s+)?database\s+licen[cs]e\b | opendatacommons\.org/licenses/odbl
ODC-By-1.0 | open data commons | \bopen\s+data\s+commons\s+attribution\s+licen[cs]e\b | opendatacommons\.org/licenses/by
PDDL-1.0 | public domain dedication | \bpublic\s+domain\s+dedication\s+and\s+licen[cs]e\b | opendatacommons\.org/licenses/pddl
OGL-UK-3.0 | open government | \bopen\s+government\s+licen[cs]e\b(?:,?\s*v?3\.0)? | nationalarchives\.gov\.uk/doc/open-government-licence
etalab-2.0 | licence ouverte | \blicence\s+ouverte\b(?:\s*/?\s*open\s+licen[cs]e)?(?:\s+(?:version\s+)?2\.0)? | etalab\.gouv\.fr/licence-ouverte
DL-DE-BY-2.0 | datenlizenz | \bdatenlizenz\s+deutschland\b | govdata\.de/dl-de/by-2-0
CECILL-2.1 | cecill | \bcecill(?:\s+(?:free\s+software\s+)?licen[cs]e)?(?:\s+(?:agreement|version|v\.?)?\s*2\.1)?\b | cecill\.info/licences
BUSL-1.1 | business source | \bbusiness\s+source\s+licen[cs]e\b(?:\s+1\.1)? | mariadb\.com/bsl11
SSPL-1.0 | server side public | \bserver\s+side\s+public\s+licen[cs]e\b(?:,?\s*(?:version|v\.?)?\s*1)? | mongodb\.com/licensing/server-side-public-license
Elastic-2.0 | elastic | \belastic\s+licen[cs]e\b(?:\s+(?:version|v\.?)?\s*2\.0)? | elastic\.co/licensing/elastic-license
JSON | json | \bjson\s+licen[cs]e\b | json\.org/license\.html
Beerware | beer | \bbeer-?ware\s+licen[cs]e\b | people\.freebsd\.org/~phk
BlueOak-1.0.0 | blue oak | \bblue\s+oak\s+model\s+licen[cs]e\b(?:\s+1\.0\.0)? | blueoakcouncil\.org/license/1\.0\.0
MulanPSL-2.0 | mulan | \bmulan\s+(?:permissive\s+software\s+licen[cs]e|psl),?\s*v?(?:ersion)?\s*2\b | license\.coscl\.org\.cn/mulanpsl2
OpenRAIL | openrail; open rail | \b(?:creativeml\s+|bigscience\s+)?open\s?rail(?:\+\+)?-?m?(?:\s+licen[cs]e)?\b | huggingface\.co/spaces/\w+/license
LicenseRef-Proprietary | proprietary | \bproprietary\s+(?:and\s+confidential|licen[cs]e|software)\b |
LicenseRef-AllRightsReserved | all rights | \ball\s+rights\s+reserved\b |
LicenseRef-AllRightsReserved | alle rechte | \balle\s+rechte\s+vorbehalten\b |
LicenseRef-AllRightsReserved | tous droits | \btous\s+droits\s+r[ée]serv[ée]s\b |
LicenseRef-AllRightsReserved | todos los derechos | \btodos\s+los\s+derechos\s+reservados\b |
"""

#: license | keywords | words of the license or of its notice
TEXTS = r"""
MIT | permission is hereby granted | permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy
MIT | permission notice | the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included
MIT | the mit licen | (?:released|licensed|distributed)\s+under\s+(?:the\s+terms\s+of\s+)?the\s+mit\s+licen[cs]e
ISC | permission to use | permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee
Apache-2.0 | apache | licensed\s+under\s+the\s+apache\s+licen[cs]e,?\s+version\s+2\.0(?:\s+\(the\s+.licen[cs]e.\))?
Apache-2.0 | except in compliance | you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[cs]e
GPL-3.0-or-later | general public | gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation,?\s+either\s+version\s+3
GPL-2.0-or-later | general public | gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]?\s+either\s+version\s+2
GPL-2.0-only | general public | gnu\s+general\s+public\s+licen[cs]e\s+version\s+2\s+(?:only|as\s+published)
GPL-3.0 | general public | licen[cs]ed\s+under\s+the\s+gnu\s+general\s+public\s+licen[cs]e,?\s+version\s+3
GPL-2.0 | general public | licen[cs]ed\s+under\s+the\s+gnu\s+general\s+public\s+licen[cs]e,?\s+version\s+2
AGPL-3.0-or-later | affero | gnu\s+affero\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation,?\s+either\s+version\s+3
LGPL-2.1-or-later | lesser | gnu\s+lesser\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]?\s+either\s+version\s+2\.1
LGPL-3.0-or-later | lesser | gnu\s+lesser\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation[;,]?\s+either\s+version\s+3
LicenseRef-GPL | without even the implied | without\s+even\s+the\s+implied\s+warranty\s+of\s+merchantability\s+or\s+fitness\s+for\s+a\s+particular\s+purpose
BSD-2-Clause | redistribution and use | redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification
BSD-3-Clause | endorse or promote | neither\s+the\s+names?\s+of\s+[\s\S]{1,80}?\s+(?:may|nor)\b[\s\S]{0,80}?endorse\s+or\s+promote\s+products
BSD-4-Clause | advertising materials | all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software
MPL-2.0 | mozilla | this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[cs]e,?\s+v\.?\s*2\.0
MPL-1.1 | mozilla | the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+licen[cs]e\s+version\s+1\.1
EPL-2.0 | eclipse | made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+2\.0
EPL-1.0 | eclipse | made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+v1\.0
BSL-1.0 | boost | distributed\s+under\s+the\s+boost\s+software\s+licen[cs]e,?\s+version\s+1\.0
Zlib | as-is | this\s+software\s+is\s+provided\s+.as-is.,?\s+without\s+any\s+express\s+or\s+implied\s+warranty
Unlicense | unencumbered | this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain
CC0-1.0 | waived all copyright | waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights
CC-BY-4.0 | licensed under | licensed\s+under\s+(?:a\s+|the\s+)?cc[- ]by[- ]4\.0
CC-BY-SA-4.0 | licensed under | licensed\s+under\s+(?:a\s+|the\s+)?cc[- ]by-sa[- ]4\.0
CC-BY-NC-4.0 | licensed under | licensed\s+under\s+(?:a\s+|the\s+)?cc[- ]by-nc[- ]4\.0
CC-BY-ND-4.0 | licensed under | licensed\s+under\s+(?:a\s+|the\s+)?cc[- ]by-nd[- ]4\.0
CC-BY-NC-SA-4.0 | licensed under | licensed\s+under\s+(?:a\s+|the\s+)?cc[- ]by-nc-sa[- ]4\.0
CC-BY-NC-ND-4.0 | licensed under | licensed\s+under\s+(?:a\s+|the\s+)?cc[- ]by-nc-nd[- ]4\.0
OFL-1.1 | open font | this\s+font\s+software\s+is\s+licen[cs]ed\s+under\s+the\s+sil\s+open\s+font\s+licen[cs]e,?\s+version\s+1\.1
WTFPL | do what the | you\s+just\s+do\s+what\s+the\s+f\S{1,3}k\s+you\s+want\s+to
JSON | for good, not evil | the\s+software\s+shall\s+be\s+used\s+for\s+good,\s+not\s+evil
Beerware | buy me a beer | as\s+long\s+as\s+you\s+retain\s+this\s+notice\s+you\s+can\s+do\s+whatever[\s\S]{0,120}?buy\s+me\s+a\s+beer
OpenSSL | the openssl project | this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project
LicenseRef-Proprietary | unauthorized copying | unauthorized\s+copying\s+of\s+this\s+file[\s\S]{0,60}?is\s+strictly\s+prohibited
LicenseRef-Proprietary | without the prior written | (?:reproduced|distributed|copied)\b[\s\S]{0,80}?without\s+the\s+prior\s+written\s+(?:permission|consent)
LicenseRef-Proprietary | trade secret | contains?\s+(?:the\s+)?(?:confidential\s+information\s+and\s+)?trade\s+secrets?\s+of
"""

#: identifiers after "SPDX-License-Identifier:" and in "license: ..." lines
TAGS = """Apache-2.0 Apache-1.1 Apache-1.0 MIT MIT-0 X11 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause BSD-3-Clause-Clear
AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-1.0 LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only
LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later GFDL-1.2 GFDL-1.3 MPL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 CPAL-1.0
EUPL-1.1 EUPL-1.2 Artistic-1.0 Artistic-2.0 BSL-1.0 Zlib Libpng Unlicense WTFPL CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0
CC-BY-SA-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 PSF-2.0 Python-2.0
PHP-3.0 PHP-3.01 Ruby OpenSSL OFL-1.1 MS-PL MS-RL ECL-2.0 AFL-3.0 OSL-3.0 NCSA UPL-1.0 PostgreSQL Vim LPPL-1.3c ODbL-1.0
ODC-By-1.0 PDDL-1.0 OGL-UK-3.0 etalab-2.0 CECILL-2.1 BUSL-1.1 SSPL-1.0 Elastic-2.0 JSON Beerware BlueOak-1.0.0 MulanPSL-2.0"""
