"""Signature rules of licenses, written by hand.

A line is ``label | kind | head | rest``. The head is a run of literal words: the
keywords whose presence gates the rule. The rest is a regular expression that must
match right behind the head and end with a word. Both are held against texts in
normal form: A-Z in lower case, words of ``0-9a-z`` and characters from U+0080 on,
one blank between them, so that ``CC BY-NC 4.0`` reads ``cc by nc 4 0``. ``<2.1>``
stands for a version with or without the word, ``<3>`` and ``<3.0>`` for one whose
zero may be missing; ``<any>`` for any version.

Kinds, in the order of their priority: ``text`` is a sentence of the license itself,
``spdx`` a machine-readable tag, ``notice`` a grant that names the license, ``name``
its full name, ``mention`` a short one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Kind: (priority, weight in the score).
KINDS = {"text": (1, 1.0), "spdx": (2, 0.95), "notice": (3, 0.9), "name": (4, 0.7), "mention": (5, 0.4)}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    head: str
    rest: str

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def weight(self) -> float:
        return KINDS[self.kind][1]


TABLE = r"""
gpl-1.0 | name | gnu general public license | <1>
gpl-2.0 | name | gnu general public license | <2>
gpl-3.0 | name | gnu general public license | <3>
gpl-2.0-or-later | notice | gnu general public license | as published by the free software foundation either<2>(?: of the license)? or(?: at your option)? any later
gpl-3.0-or-later | notice | gnu general public license | as published by the free software foundation either<3>(?: of the license)? or(?: at your option)? any later
gpl-2.0-only | notice | gnu general public license | as published by the free software foundation<2>(?: only)?
gpl-3.0-only | notice | gnu general public license | as published by the free software foundation<3>(?: only)?
gpl-2.0-or-later | notice | gnu general public license | <2>(?: of the license)? or(?: at your option)?(?: any)? later
gpl-3.0-or-later | notice | gnu general public license | <3>(?: of the license)? or(?: at your option)?(?: any)? later
gpl | notice | licensed under the gnu general public license |
gpl | notice | under the terms of the gnu general public license |
gpl | notice | licensed under the gpl |
gpl-2.0 | notice | licensed under the gnu general public license | <2>
gpl-3.0 | notice | licensed under the gnu general public license | <3>
gpl-2.0 | notice | licensed under the gpl | <2>
gpl-3.0 | notice | licensed under the gpl | <3>
gpl-2.0 | notice | licensed under gpl | <2>
gpl-3.0 | notice | licensed under gpl | <3>
gpl-2.0 | name | gnu gpl | <2>
gpl-3.0 | name | gnu gpl | <3>
gpl | name | gnu gpl |
gpl-2.0 | mention | gpl | <2>
gpl-3.0 | mention | gpl | <3>
gpl-2.0 | mention | gplv2 |
gpl-3.0 | mention | gplv3 |
gpl-2.0-or-later | mention | gplv2 | or later
gpl-3.0-or-later | mention | gplv3 | or later
gpl | text | the gnu general public license is a free copyleft license for software and other kinds of works |
gpl-2.0 | text | this license applies to any program or other work which contains a notice placed by the copyright holder |
gpl-3.0 | text | each contributor grants you a non exclusive worldwide royalty free patent license under the contributor s essential patent claims |
gpl | text | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license |
gpl-with-classpath-exception | name | classpath exception | (?: 2 0)?
gpl-with-font-exception | name | gpl font exception |
lgpl-2.0 | name | gnu library general public license | <2>
lgpl | name | gnu library general public license |
lgpl-2.1 | name | gnu lesser general public license | <2.1>
lgpl-3.0 | name | gnu lesser general public license | <3>
lgpl | name | gnu lesser general public license |
lgpl-2.1-or-later | notice | gnu lesser general public license | as published by the free software foundation either<2.1>(?: of the license)? or(?: at your option)? any later
lgpl-3.0-or-later | notice | gnu lesser general public license | as published by the free software foundation either<3>(?: of the license)? or(?: at your option)? any later
lgpl | notice | licensed under the lgpl |
lgpl-2.1 | mention | lgpl | <2.1>
lgpl-3.0 | mention | lgpl | <3>
lgpl-3.0 | mention | lgplv3 |
lgpl-2.1 | mention | lgplv2 1 |
lgpl | text | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license |
agpl-3.0 | name | gnu affero general public license | <3>
agpl | name | gnu affero general public license |
agpl-3.0-or-later | notice | gnu affero general public license | as published by the free software foundation either<3>(?: of the license)? or(?: at your option)? any later
agpl-1.0 | name | affero general public license | <1>
agpl-3.0 | mention | agpl | <3>
agpl-3.0 | mention | agplv3 |
agpl | text | remote network interaction use with the gnu general public license |
gfdl-1.1 | name | gnu free documentation license | <1.1>
gfdl-1.2 | name | gnu free documentation license | <1.2>
gfdl-1.3 | name | gnu free documentation license | <1.3>
gfdl | name | gnu free documentation license |
gfdl | text | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license |
fsf-all-permissive | text | copying and distribution of this file with or without modification are permitted in any medium without royalty |
apache-1.0 | name | apache license | <1>
apache-1.1 | name | apache license | <1.1>
apache-2.0 | name | apache license | <2>
apache-1.1 | name | apache software license | <1.1>
apache-2.0 | name | apache software license | <2>
apache | name | apache software license |
apache-2.0 | notice | licensed under the apache license | <2>
apache | notice | licensed under the apache license |
apache-2.0 | notice | under the apache license | <2>
apache-2.0 | mention | apache | (?: license| licence| software license)?<2>
apache-2.0 | mention | asl | <2>
apache | mention | apache licence |
apache-2.0 | text | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 |
apache-2.0 | text | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis |
apache-2.0 | text | terms and conditions for use reproduction and distribution 1 definitions license shall mean |
apache-1.1 | text | this product includes software developed by the apache software foundation |
llvm-exception | name | llvm exceptions | (?: to the apache 2 0 license)?
mit | notice | released under the mit | (?: license| licence)?
mit | notice | licensed under the mit | (?: license| licence)?
mit | notice | licensed under mit | (?: license| licence)?
mit | notice | distributed under the mit | (?: license| licence)?
mit | notice | available under the mit | (?: license| licence)?
mit | notice | under the terms of the mit | (?: license| licence)
mit | notice | license mit |
mit | name | the mit license |
mit | name | mit licence |
x11 | name | x11 license |
x11 | name | mit x11 | (?: license)?
mit | name | expat license |
mit | text | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files |
mit | text | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software |
mit-0 | name | mit no attribution |
mit-0 | text | permission is hereby granted free of charge to any person obtaining a copy of this software | (?: and associated documentation files the software)? to deal in the software without restriction(?: [^ ]+){0,30} to whom the software is furnished to do so the software is provided
x11 | text | the name of the x consortium shall not be used in advertising |
isc | name | isc license |
isc | notice | licensed under the isc | (?: license)?
isc | text | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies |
0bsd | text | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided |
0bsd | name | zero clause bsd | (?: license)?
0bsd | mention | 0bsd |
bsd-2-clause | name | bsd 2 clause | (?: license)?
bsd-3-clause | name | bsd 3 clause | (?: license)?
bsd-4-clause | name | bsd 4 clause | (?: license)?
bsd-2-clause | name | simplified bsd | (?: license)?
bsd-3-clause | name | modified bsd | (?: license)?
bsd-3-clause | name | new bsd | (?: license)?
bsd-3-clause | name | revised bsd | (?: license)?
bsd-4-clause | name | original bsd | (?: license)?
bsd-2-clause | name | freebsd license |
bsd-2-clause | name | two clause bsd | (?: license)?
bsd-3-clause | name | three clause bsd | (?: license)?
bsd-4-clause | name | four clause bsd | (?: license)?
bsd-2-clause | name | 2 clause bsd | (?: license)?
bsd-3-clause | name | 3 clause bsd | (?: license)?
bsd | name | bsd license |
bsd | name | bsd style license |
bsd | notice | licensed under the bsd | (?: license)?
bsd | notice | released under the bsd | (?: license)?
bsd | text | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met |
bsd-3-clause | text | neither the name of | (?: [^ ]+){1,12} nor the names of(?: its| any| other)? contributors may be used to endorse or promote products
bsd-4-clause | text | all advertising materials mentioning features or use of this software must display the following acknowledgement |
bsd-3-clause-clear | text | no express or implied licenses to any party s patent rights are granted by this license |
bsd-2-clause-patent | name | bsd 2 clause plus patent | (?: license)?
bsd-protection | name | bsd protection license |
bsd-source-code | name | bsd source code attribution |
mpl-1.0 | name | mozilla public license | <1>
mpl-1.1 | name | mozilla public license | <1.1>
mpl-2.0 | name | mozilla public license | <2>
mpl | name | mozilla public license |
mpl-2.0 | notice | subject to the terms of the mozilla public license | <2>
mpl-1.1 | notice | the contents of this file are subject to the mozilla public license | <1.1>
mpl-2.0 | text | this source code form is subject to the terms of the mozilla public license |
mpl-1.1 | mention | mpl | <1.1>
mpl-2.0 | mention | mpl | <2>
mpl-2.0 | text | incompatible with secondary licenses |
npl | name | netscape public license | (?:<any>)?
epl-1.0 | name | eclipse public license | <1>
epl-2.0 | name | eclipse public license | <2>
epl | name | eclipse public license |
edl-1.0 | name | eclipse distribution license | <1>
epl-1.0 | mention | epl | <1>
epl-2.0 | mention | epl | <2>
epl | text | this program and the accompanying materials are made available under the terms of the eclipse public license |
cpl-1.0 | name | common public license | <1>
cpl | name | common public license |
ibm-pl | name | ibm public license | (?:<any>)?
cddl-1.0 | name | common development and distribution license | <1>
cddl-1.1 | name | common development and distribution license | <1.1>
cddl | name | common development and distribution license |
cddl-1.0 | mention | cddl | <1>
cddl-1.1 | mention | cddl | <1.1>
cpal-1.0 | name | common public attribution license | (?:<any>)?
eupl-1.0 | name | european union public licence | <1>
eupl-1.1 | name | european union public licence | <1.1>
eupl-1.2 | name | european union public licence | <1.2>
eupl | name | european union public licence |
eupl | name | european union public license |
eupl-1.2 | mention | eupl | <1.2>
eupl-1.1 | mention | eupl | <1.1>
cecill-2.1 | name | cecill | <2.1>
cecill-2.0 | name | cecill | <2>
cecill-b | name | cecill b | (?: license)?
cecill-c | name | cecill c | (?: license)?
cecill | name | cecill license |
artistic-1.0 | name | artistic license | <1>
artistic-2.0 | name | artistic license | <2>
artistic | name | artistic license |
clarified-artistic | name | clarified artistic license |
perl | notice | under the same terms as perl | (?: itself)?
psf-2.0 | name | python software foundation license | (?:<any>)?
psf-2.0 | name | psf license agreement | (?: for python [0-9]+(?: [0-9]+)*)?
psf-2.0 | text | psf is making python available to licensee on an as is basis |
cnri-python | name | cnri open source license agreement |
ruby | name | ruby license |
ruby | notice | under the same terms as ruby | (?: itself)?
php-3.01 | name | php license | <3.01>
php-3.0 | name | php license | <3>
php | name | php license |
php | text | this product includes php software freely available from |
zend-2.0 | name | zend engine license | (?:<any>)?
zlib | name | zlib license |
zlib | name | zlib libpng license |
zlib | text | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software |
libpng | name | libpng license | (?:<any>)?
libtiff | name | libtiff license |
ijg | text | this software is based in part on the work of the independent jpeg group |
bsl-1.0 | name | boost software license | (?:<1>)?
bsl-1.0 | notice | distributed under the boost software license | (?:<1>)?
bsl-1.0 | text | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license |
unlicense | name | the unlicense |
unlicense | text | this is free and unencumbered software released into the public domain |
wtfpl | name | do what the fuck you want to public license | (?:<any>)?
wtfpl | mention | wtfpl | (?:<any>)?
beerware | name | beer ware license | (?: revision [0-9]+)?
beerware | name | beerware license |
public-domain | notice | released into the public domain |
public-domain | notice | placed in the public domain |
public-domain | notice | dedicated to the public domain |
public-domain | mention | public domain dedication |
cc0-1.0 | name | cc0 | (?:<1>)?(?: universal)?
cc0-1.0 | name | creative commons zero | (?:<1>)?(?: universal)?
cc0-1.0 | text | the person who associated a work with this deed has dedicated the work to the public domain |
cc-by-1.0 | name | cc by | <1>
cc-by-2.0 | name | cc by | <2>
cc-by-2.5 | name | cc by | <2.5>
cc-by-3.0 | name | cc by | <3>
cc-by-4.0 | name | cc by | <4>
cc-by-sa-2.0 | name | cc by sa | <2>
cc-by-sa-2.5 | name | cc by sa | <2.5>
cc-by-sa-3.0 | name | cc by sa | <3>
cc-by-sa-4.0 | name | cc by sa | <4>
cc-by-sa | mention | cc by sa |
cc-by-nd-3.0 | name | cc by nd | <3>
cc-by-nd-4.0 | name | cc by nd | <4>
cc-by-nd | mention | cc by nd |
cc-by-nc-2.0 | name | cc by nc | <2>
cc-by-nc-2.5 | name | cc by nc | <2.5>
cc-by-nc-3.0 | name | cc by nc | <3>
cc-by-nc-4.0 | name | cc by nc | <4>
cc-by-nc | mention | cc by nc |
cc-by-nc-sa-2.0 | name | cc by nc sa | <2>
cc-by-nc-sa-3.0 | name | cc by nc sa | <3>
cc-by-nc-sa-4.0 | name | cc by nc sa | <4>
cc-by-nc-sa | mention | cc by nc sa |
cc-by-nc-nd-2.0 | name | cc by nc nd | <2>
cc-by-nc-nd-3.0 | name | cc by nc nd | <3>
cc-by-nc-nd-4.0 | name | cc by nc nd | <4>
cc-by-nc-nd | mention | cc by nc nd |
cc-by-nc-4.0 | notice | licensed under cc by nc | <4>
cc-by-sa-4.0 | notice | licensed under cc by sa | <4>
cc-by-4.0 | notice | licensed under cc by | <4>
cc-by-4.0 | name | creative commons attribution | <4>(?: international)?
cc-by-3.0 | name | creative commons attribution | <3>(?: unported)?
cc-by | name | creative commons attribution |
cc-by-4.0 | name | attribution 4 0 international |
cc-by-sa-4.0 | name | creative commons attribution sharealike | <4>(?: international)?
cc-by-sa-3.0 | name | creative commons attribution sharealike | <3>(?: unported)?
cc-by-sa | name | creative commons attribution sharealike |
cc-by-sa | name | creative commons attribution share alike |
cc-by-nd | name | creative commons attribution noderivatives |
cc-by-nc-4.0 | name | creative commons attribution noncommercial | <4>(?: international)?
cc-by-nc | name | creative commons attribution noncommercial |
cc-by-nc | name | creative commons attribution non commercial |
cc-by-nc-sa | name | creative commons attribution noncommercial sharealike |
cc-by-nc-nd | name | creative commons attribution noncommercial noderivatives |
cc-by-nc-nd | name | creative commons attribution noncommercial noderivs |
cc | mention | creative commons license |
cc | mention | creative commons licence |
ofl-1.0 | name | sil open font license | <1>
ofl-1.1 | name | sil open font license | <1.1>
ofl | name | sil open font license |
ofl-1.1 | notice | this font software is licensed under the sil open font license | (?:<1.1>)?
ubuntu-font-1.0 | name | ubuntu font licence | (?:<any>)?
bitstream-vera | name | bitstream vera fonts copyright |
odbl-1.0 | name | open database license | (?: odbl)?(?:<1>)?
odbl-1.0 | mention | odbl | (?:<1>)?
odc-by-1.0 | name | open data commons attribution license | (?:<1>)?
pddl-1.0 | name | open data commons public domain dedication | (?: and license)?(?:<1>)?
ogl-uk-3.0 | name | open government licence | <3>
ogl-uk-2.0 | name | open government licence | <2>
ogl-uk | name | open government licence |
cdla-permissive | name | community data license agreement permissive | (?:<any>)?
cdla-sharing | name | community data license agreement sharing | (?:<any>)?
afl-2.1 | name | academic free license | <2.1>
afl-3.0 | name | academic free license | <3>
afl | name | academic free license |
osl-2.1 | name | open software license | <2.1>
osl-3.0 | name | open software license | <3>
osl | name | open software license |
apsl-1.0 | name | apple public source license | <1>
apsl-2.0 | name | apple public source license | <2>
apsl | name | apple public source license |
lppl-1.3 | name | latex project public license | <1.3c>
lppl | name | latex project public license |
ms-pl | name | microsoft public license |
ms-rl | name | microsoft reciprocal license |
ms-pl | mention | ms pl |
ms-rl | mention | ms rl |
ncsa | name | university of illinois ncsa open source license |
ncsa | name | ncsa open source license |
openssl | name | openssl license |
openssl | text | this product includes software developed by the openssl project |
ssleay | name | original ssleay license |
openldap | name | openldap public license | (?:<any>)?
postgresql | name | postgresql license |
postgresql | name | postgresql licence |
vim | name | vim license |
w3c | name | w3c software notice and license |
w3c | name | w3c software and document license |
w3c | name | w3c document license |
zpl-2.0 | name | zope public license | <2>
zpl-2.1 | name | zope public license | <2.1>
zpl | name | zope public license |
qpl-1.0 | name | q public license | (?:<any>)?
sleepycat | name | sleepycat license |
nasa-1.3 | name | nasa open source agreement | (?:<any>)?
nokia | name | nokia open source license | (?:<any>)?
rpl-1.5 | name | reciprocal public license | (?:<any>)?
rpsl-1.0 | name | realnetworks public source license | (?:<any>)?
sissl | name | sun industry standards source license | (?:<any>)?
spl-1.0 | name | sun public license | (?:<any>)?
watcom-1.0 | name | sybase open watcom public license | (?:<any>)?
upl-1.0 | name | universal permissive license | (?:<any>)?
vsl-1.0 | name | vovida software license | (?:<any>)?
xnet | name | x net license |
intel | name | intel open source license |
ipa | name | ipa font license |
json | text | the software shall be used for good not evil |
hpnd | name | historical permission notice and disclaimer |
ntp | name | ntp license |
naist | name | nara institute of science and technology license |
fair | name | fair license |
ecl-2.0 | name | educational community license | (?:<any>)?
efl-2.0 | name | eiffel forum license | (?:<any>)?
entessa | name | entessa public license | (?:<any>)?
eudatagrid | name | eu datagrid software license |
frameworx | name | frameworx open license | (?:<any>)?
lucent | name | lucent public license | (?:<any>)?
motosoto | name | motosoto open source license | (?:<any>)?
multics | name | multics license |
mulan-psl-1.0 | name | mulan permissive software license | <1>
mulan-psl-2.0 | name | mulan permissive software license | <2>
mulan-psl | name | mulan permissive software license |
mulan-psl-2.0 | mention | mulan psl | <2>
miros | name | miros licence |
ngpl | name | nethack general public license |
oclc-2.0 | name | oclc research public license | (?:<any>)?
ogtsl | name | open group test suite license |
blueoak-1.0.0 | name | blue oak model license | (?:<any>)?
catosl-1.1 | name | computer associates trusted open source license | (?:<any>)?
cua-opl-1.0 | name | cua office public license | (?:<any>)?
liliq-p | name | licence libre du quebec permissive |
simpl-2.0 | name | simple public license | (?:<any>)?
unicode | name | unicode license agreement |
unicode | name | unicode terms of use |
icu | name | icu license |
curl | name | curl license |
info-zip | name | info zip license |
bzip2 | name | bzip2 license |
tcl | name | tcl tk license |
sgi-b | name | sgi free software license b | (?:<any>)?
sspl-1.0 | name | server side public license | (?:<any>)?
sspl-1.0 | mention | sspl | (?:<1>)?
busl-1.1 | name | business source license | (?:<1.1>)?
busl-1.1 | mention | busl | (?:<1.1>)?
elastic-2.0 | name | elastic license | (?:<any>)?
confluent | name | confluent community license | (?:<any>)?
commons-clause | name | commons clause | (?: license condition)?(?:<any>)?
polyform-noncommercial | name | polyform noncommercial license | (?:<any>)?
polyform-small-business | name | polyform small business license | (?:<any>)?
hippocratic | name | hippocratic license | (?:<any>)?
anti-996 | name | anti 996 license | (?:<any>)?
parity | name | parity public license | (?:<any>)?
openrail | name | openrail m license |
openrail | name | bigscience openrail | (?: m)?
openrail | name | responsible ai license |
llama | name | llama | (?: [0-9]+)*(?: community)? license(?: agreement)?
unsplash | name | unsplash license |
pixabay | name | pixabay license |
jquery | name | jquery license |
gpl-2.0-only | spdx | spdx license identifier gpl 2 0 | (?: only)?
gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 | or later
gpl-3.0-only | spdx | spdx license identifier gpl 3 0 | (?: only)?
gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 | or later
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1 | (?: only| or later)?
lgpl-3.0 | spdx | spdx license identifier lgpl 3 0 | (?: only| or later)?
agpl-3.0 | spdx | spdx license identifier agpl 3 0 | (?: only| or later)?
apache-2.0 | spdx | spdx license identifier apache 2 0 |
mit | spdx | spdx license identifier mit |
isc | spdx | spdx license identifier isc |
bsd-2-clause | spdx | spdx license identifier bsd 2 clause |
bsd-3-clause | spdx | spdx license identifier bsd 3 clause |
mpl-2.0 | spdx | spdx license identifier mpl 2 0 |
epl-2.0 | spdx | spdx license identifier epl 2 0 |
unlicense | spdx | spdx license identifier unlicense |
zlib | spdx | spdx license identifier zlib |
bsl-1.0 | spdx | spdx license identifier bsl 1 0 |
cc0-1.0 | spdx | spdx license identifier cc0 1 0 |
cc-by | spdx | spdx license identifier cc by | (?: nc)?(?: sa| nd)?(?: [1-4] [05])?
other | spdx | spdx license identifier | (?: [^ ]+)
all-rights-reserved | mention | all rights reserved |
proprietary | notice | proprietary and confidential |
proprietary | notice | this software is proprietary |
proprietary | notice | unauthorized copying of this file | (?: via any medium)? is strictly prohibited
non-commercial | notice | for non commercial use only |
non-commercial | notice | for noncommercial use only |
research-only | notice | for research purposes only |
no-derivatives | notice | no derivative works | (?: are)? permitted
warranty-disclaimer | mention | without warranty of any kind |
warranty-disclaimer | mention | without any warranty |
"""


def version(match: re.Match) -> str:
    """The expression of a version: ``3`` and ``3.0`` are one."""
    number = match[1]
    lead = " (?:version |ver |v |v)?"
    if number == "any":
        return lead + "[0-9]+(?: [0-9]+)*"
    major, *rest = number.split(".")
    return lead + major + "".join(f"(?: {r})?" if r == "0" else f" {r}" for r in rest or ["0"])


def parse(table: str) -> list[Rule]:
    out = []
    for line in table.strip().splitlines():
        label, kind, head, rest = (x.strip() for x in line.split(" | ") + [""] * (3 - line.count(" | ")))
        head = head.removesuffix(" |").strip()
        if rest and rest[0] not in "(<":
            rest = " " + rest  # the blank behind the head
        out.append(Rule(label, kind, head, re.sub(r"<([^>]+)>", version, rest)))
    return out


RULES = parse(TABLE)
#: Base phrases and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
