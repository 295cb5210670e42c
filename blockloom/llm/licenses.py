"""License scans: ordered signature rules with a keyword prefilter.

A text is lower-cased (A-Z) and cut into words of letters, digits and
non-ASCII characters; rules are regular expressions over the words joined by
single spaces.  The rules are written by hand, with a priority and a confidence, and every rule
names a keyword that each of its matches contains.  A scan of the raw bytes
for roots derived from the keywords skips most texts; in the others only rules
whose keyword is present run.

Detections are resolved in the order of priority, then length, then place: one
that lies inside an accepted detection is suppressed, which takes n log n time
in the detections of a text.  The base phrases (see
``BASE``) are counted at every place, suppressed or not, and their labels stay.

The score is one minus the product of (1 - confidence) over accepted detections.

Defined cases: null and empty texts have no words, no labels and the score 0;
repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.common import ship, table
from blockloom.llm.words import byte_class, flat, slices, spans

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Signatures in the form "label | priority | confidence | keyword | pattern over words"; every match of a pattern holds the keyword.
#: {l} stands for license or licence, {v} for a word before a version's number, {later} for an option of later versions.
SIGNATURES = r"""
apache-2.0 | 90 | 0.99 | apache | licensed under (?:the )?apache {l}{v}2 0
apache-2.0 | 85 | 0.98 | apache | apache {l}{v}2(?: 0)?
apache-2.0 | 85 | 0.98 | apache | apache software {l}{v}2(?: 0)?
apache-2.0 | 80 | 0.95 | apache | apache{v}2 0
apache-2.0 | 90 | 0.99 | apache org licenses | apache org licenses license 2 0
apache-2.0 | 70 | 0.9 | asl 2 0 | asl 2 0
apache-1.1 | 85 | 0.98 | apache | apache (?:software )?{l}{v}1 1
apache-1.0 | 85 | 0.98 | apache | apache (?:software )?{l}{v}1 0
apache | 45 | 0.7 | apache | apache (?:software |style )?{l}
apache | 60 | 0.85 | under the apache | under the apache
apache | 60 | 0.8 | under apache | (?:licensed|released|available|distributed|published) under apache
mit | 90 | 0.99 | hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy
mit | 75 | 0.9 | copyright notice and this permission notice | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included
mit | 60 | 0.9 | mit licen | mit {l}
mit | 65 | 0.9 | mit licen | mit licensed
mit | 60 | 0.85 | mit style | mit style {l}
mit | 70 | 0.9 | under the mit | under the mit(?: {l})?
mit | 65 | 0.85 | under mit | under mit(?: {l})?
mit | 65 | 0.85 | terms of the mit | terms of the mit(?: {l})?
mit | 65 | 0.85 | terms of mit | terms of mit(?: {l})?
mit | 80 | 0.95 | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php)?
mit | 60 | 0.85 | expat licen | expat {l}
mit | 60 | 0.85 | x11 licen | x11 {l}
mit-0 | 75 | 0.9 | mit no attribution | mit no attribution(?: {l})?
mit-0 | 70 | 0.9 | mit 0 | mit 0(?: {l})?
bsd | 80 | 0.9 | redistribution and use in source | redistribution and use in source and binary forms with or without modification
bsd | 70 | 0.85 | redistributions of source code must | redistributions of source code must retain the (?:above )?copyright notice
bsd | 70 | 0.85 | redistributions in binary form must | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | 80 | 0.95 | endorse or promote products | (?:neither the name|the names?) of .{1,120}? (?:endorse|be used to endorse) or promote products
bsd-4-clause | 80 | 0.95 | advertising materials mentioning features | all advertising materials mentioning features or use of this software
bsd-2-clause | 75 | 0.95 | bsd 2 clause | bsd 2 clause(?: {l})?
bsd-2-clause | 75 | 0.95 | 2 clause bsd | 2 clause bsd(?: {l})?
bsd-2-clause | 70 | 0.9 | simplified bsd | simplified bsd {l}
bsd-2-clause | 70 | 0.9 | freebsd licen | freebsd {l}
bsd-3-clause | 75 | 0.95 | bsd 3 clause | bsd 3 clause(?: {l})?
bsd-3-clause | 75 | 0.95 | 3 clause bsd | 3 clause bsd(?: {l})?
bsd-3-clause | 70 | 0.9 | new bsd | new bsd {l}
bsd-3-clause | 70 | 0.9 | modified bsd | modified bsd {l}
bsd-3-clause | 70 | 0.9 | revised bsd | revised bsd {l}
bsd-4-clause | 75 | 0.95 | bsd 4 clause | bsd 4 clause(?: {l})?
bsd-4-clause | 70 | 0.9 | original bsd | original bsd {l}
0bsd | 75 | 0.95 | zero clause bsd | zero clause bsd(?: {l})?
0bsd | 70 | 0.95 | 0bsd | 0bsd
bsd | 45 | 0.8 | bsd licen | bsd licen[sc]ed?
bsd | 45 | 0.75 | bsd style | bsd style {l}
bsd | 50 | 0.75 | under the bsd | under the bsd
gpl-1.0 | 85 | 0.98 | general public licen | (?:gnu )?general public {l}{v}1(?: 0)?{later}
gpl-2.0 | 85 | 0.98 | general public licen | (?:gnu )?general public {l}{v}2(?: 0)?{later}
gpl-3.0 | 85 | 0.98 | general public licen | (?:gnu )?general public {l}{v}3(?: 0)?{later}
gpl-1.0 | 80 | 0.95 | gpl | (?:gnu )?gpl{v}1(?: 0)?{later}
gpl-2.0 | 80 | 0.95 | gpl | (?:gnu )?gpl{v}2(?: 0)?{later}
gpl-3.0 | 80 | 0.95 | gpl | (?:gnu )?gpl{v}3(?: 0)?{later}
gpl-2.0 | 75 | 0.95 | gplv2 | (?:gnu )?gplv2{later}
gpl-3.0 | 75 | 0.95 | gplv3 | (?:gnu )?gplv3{later}
gpl-2.0 | 88 | 0.98 | free software foundation either version 2 | free software foundation either version 2 of the {l}
gpl-3.0 | 88 | 0.98 | free software foundation either version 3 | free software foundation either version 3 of the {l}
gpl | 70 | 0.9 | redistribute it and or modify it under the terms | redistribute it and or modify it under the terms of the gnu general public {l}
gpl | 50 | 0.9 | general public licen | (?:gnu )?general public {l}
gpl | 50 | 0.85 | gnu gpl | gnu gpl
gpl | 35 | 0.7 | gpl | gpl(?: {l}| licensed)?
gpl | 75 | 0.95 | gnu org | gnu org (?:copyleft|licenses) gpl(?: (?:2|3) 0)?(?: en)?(?: html)?
lgpl-2.0 | 88 | 0.98 | library general public licen | (?:gnu )?library general public {l}{v}2(?: 0)?{later}
lgpl-2.1 | 88 | 0.98 | lesser general public licen | (?:gnu )?lesser general public {l}{v}2 1{later}
lgpl-3.0 | 88 | 0.98 | lesser general public licen | (?:gnu )?lesser general public {l}{v}3(?: 0)?{later}
lgpl-2.1 | 82 | 0.95 | lgpl | (?:gnu )?lgpl{v}2 1{later}
lgpl-2.0 | 80 | 0.95 | lgpl | (?:gnu )?lgpl{v}2(?: 0)?{later}
lgpl-3.0 | 82 | 0.95 | lgpl | (?:gnu )?lgpl{v}3(?: 0)?{later}
lgpl | 60 | 0.9 | lesser general public licen | (?:gnu )?lesser general public {l}
lgpl | 60 | 0.9 | library general public licen | (?:gnu )?library general public {l}
lgpl | 45 | 0.85 | lgpl | (?:gnu )?lgpl(?:v2|v3)?(?: {l}| licensed)?
agpl-3.0 | 88 | 0.98 | affero general public licen | (?:gnu )?affero general public {l}{v}3(?: 0)?{later}
agpl-3.0 | 82 | 0.95 | agpl | (?:gnu )?agpl(?:{v}3(?: 0)?|v3){later}
agpl-1.0 | 88 | 0.98 | affero general public licen | affero general public {l}{v}1(?: 0)?
agpl | 60 | 0.9 | affero general public licen | (?:gnu )?affero general public {l}
agpl | 45 | 0.85 | agpl | (?:gnu )?agpl(?: {l}| licensed)?
gpl-classpath | 90 | 0.97 | classpath exception | (?:with )?(?:the )?classpath exception
gpl-linking | 80 | 0.9 | linking exception | (?:static |runtime |gcc )?linking exception
fdl-1.1 | 85 | 0.97 | free documentation licen | (?:gnu )?free documentation {l}{v}1 1{later}
fdl-1.2 | 85 | 0.97 | free documentation licen | (?:gnu )?free documentation {l}{v}1 2{later}
fdl-1.3 | 85 | 0.97 | free documentation licen | (?:gnu )?free documentation {l}{v}1 3{later}
fdl | 60 | 0.9 | free documentation licen | (?:gnu )?free documentation {l}
fdl | 50 | 0.85 | gfdl | gfdl(?: 1 [123])?
mpl-2.0 | 85 | 0.98 | mozilla public licen | mozilla public {l}{v}2(?: 0)?
mpl-1.1 | 85 | 0.98 | mozilla public licen | mozilla public {l}{v}1 1
mpl-1.0 | 85 | 0.98 | mozilla public licen | mozilla public {l}{v}1 0
mpl-2.0 | 88 | 0.98 | source code form is subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public {l}
mpl-2.0 | 75 | 0.95 | mpl | mpl{v}2(?: 0)?
mpl-1.1 | 75 | 0.95 | mpl | mpl{v}1 1
mpl | 60 | 0.9 | mozilla public licen | mozilla public {l}
mpl | 35 | 0.6 | mpl | mpl(?: {l}| licensed)?
npl | 70 | 0.9 | netscape public licen | netscape public {l}(?:{v}1 [01])?
epl-2.0 | 85 | 0.98 | eclipse public licen | eclipse public {l}{v}2(?: 0)?
epl-1.0 | 85 | 0.98 | eclipse public licen | eclipse public {l}{v}1(?: 0)?
epl-2.0 | 75 | 0.95 | epl | epl{v}2(?: 0)?
epl-1.0 | 75 | 0.95 | epl | epl{v}1(?: 0)?
epl | 60 | 0.9 | eclipse public licen | eclipse public {l}
epl | 30 | 0.5 | epl | epl(?: {l}| licensed)?
edl-1.0 | 70 | 0.9 | eclipse distribution licen | eclipse distribution {l}(?:{v}1 0)?
cddl-1.1 | 85 | 0.97 | common development and distribution licen | common development and distribution {l}{v}1 1
cddl-1.0 | 85 | 0.97 | common development and distribution licen | common development and distribution {l}{v}1 0
cddl-1.1 | 75 | 0.95 | cddl | cddl{v}1 1
cddl-1.0 | 75 | 0.95 | cddl | cddl{v}1 0
cddl | 60 | 0.9 | common development and distribution licen | common development and distribution {l}
cddl | 45 | 0.85 | cddl | cddl
cpl-1.0 | 70 | 0.9 | common public licen | common public {l}(?:{v}1 0)?
cpal-1.0 | 75 | 0.9 | common public attribution licen | common public attribution {l}(?:{v}1 0)?
eupl-1.1 | 85 | 0.97 | european union public licen | european union public {l}{v}1 1
eupl-1.2 | 85 | 0.97 | european union public licen | european union public {l}{v}1 2
eupl-1.2 | 75 | 0.95 | eupl | eupl{v}1 2
eupl-1.1 | 75 | 0.95 | eupl | eupl{v}1 1
eupl | 60 | 0.9 | european union public licen | european union public {l}
eupl | 45 | 0.85 | eupl | eupl
isc | 85 | 0.95 | use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose
isc | 60 | 0.9 | isc licen | isc {l}
isc | 60 | 0.9 | internet systems consortium licen | internet systems consortium {l}
zlib | 70 | 0.9 | zlib licen | zlib {l}
zlib | 70 | 0.9 | zlib libpng licen | zlib libpng {l}
zlib | 80 | 0.95 | provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty
zlib | 75 | 0.9 | altered source versions must be plainly marked | altered source versions must be plainly marked as such
libpng | 65 | 0.9 | libpng licen | libpng {l}(?: (?:version )?2)?
boost-1.0 | 80 | 0.97 | boost software licen | boost software {l}(?:{v}1 0)?
boost-1.0 | 70 | 0.9 | bsl 1 0 | bsl 1 0
boost | 50 | 0.8 | boost licen | boost {l}
artistic-2.0 | 80 | 0.95 | artistic licen | artistic {l}{v}2(?: 0)?
artistic-1.0 | 80 | 0.95 | artistic licen | artistic {l}{v}1(?: 0)?
artistic | 55 | 0.85 | artistic licen | (?:perl )?artistic {l}
perl | 70 | 0.9 | same terms as perl | (?:under )?the same terms as perl(?: itself)?
python-2.0 | 75 | 0.93 | python software foundation licen | python software foundation {l}(?:{v}2(?: 0)?)?
python | 60 | 0.85 | psf licen | psf {l}(?: (?:version )?2)?
python | 50 | 0.75 | python licen | python {l}(?: 2 0)?
cnri | 65 | 0.85 | cnri | cnri (?:python |jython )?{l}
php-3.01 | 75 | 0.95 | php licen | php {l}{v}3 01
php-3.0 | 70 | 0.95 | php licen | php {l}{v}3(?: 0)?
php | 50 | 0.8 | php licen | php {l}
ruby | 50 | 0.8 | ruby licen | ruby {l}
w3c | 60 | 0.9 | w3c | w3c (?:software |document |software and document |software notice and )?{l}
wtfpl | 75 | 0.95 | do what the fuck you want | do what the fuck you want to(?: public {l})?
wtfpl | 60 | 0.95 | wtfpl | wtfpl(?: (?:version )?2)?
unlicense | 70 | 0.93 | unlicense | (?:the )?unlicense
unlicense | 85 | 0.97 | free and unencumbered software released into | this is free and unencumbered software released into the public domain
ofl-1.1 | 85 | 0.97 | open font licen | (?:sil )?open font {l}{v}1 1
ofl-1.0 | 85 | 0.97 | open font licen | (?:sil )?open font {l}{v}1 0
ofl-1.1 | 70 | 0.93 | ofl | ofl{v}1 1
ofl-1.0 | 70 | 0.93 | ofl | ofl{v}1 0
ofl | 60 | 0.9 | open font licen | (?:sil )?open font {l}
ofl | 30 | 0.6 | ofl | ofl
ubuntu-font | 65 | 0.9 | ubuntu font licen | ubuntu font {l}(?: (?:version )?1 0)?
openssl | 65 | 0.9 | openssl licen | openssl {l}
ssleay | 65 | 0.9 | ssleay licen | (?:original )?ssleay {l}
osl-3.0 | 75 | 0.95 | open software licen | open software {l}{v}3 0
osl-2.1 | 75 | 0.95 | open software licen | open software {l}{v}2 1
osl | 50 | 0.8 | open software licen | open software {l}
afl-3.0 | 75 | 0.95 | academic free licen | academic free {l}{v}3 0
afl-2.1 | 75 | 0.95 | academic free licen | academic free {l}{v}2 1
afl | 55 | 0.85 | academic free licen | academic free {l}
ms-pl | 65 | 0.92 | microsoft public licen | microsoft public {l}
ms-pl | 50 | 0.8 | ms pl | ms pl
ms-rl | 65 | 0.92 | microsoft reciprocal licen | microsoft reciprocal {l}
odbl-1.0 | 75 | 0.93 | open database licen | (?:odc )?open database {l}(?:{v}1 0)?
odbl | 45 | 0.85 | odbl | odbl(?: 1 0)?
odc-by-1.0 | 75 | 0.93 | open data commons attribution | open data commons attribution {l}(?:{v}1 0)?
odc-by | 50 | 0.85 | odc by | odc by(?: 1 0)?
pddl-1.0 | 75 | 0.93 | public domain dedication and licen | (?:odc )?public domain dedication and {l}(?:{v}1 0)?
pddl | 45 | 0.85 | pddl | pddl(?: 1 0)?
dbcl | 55 | 0.85 | database contents licen | database contents {l}(?: 1 0)?
cdla-permissive | 70 | 0.93 | community data licen | community data {l} agreement permissive(?:{v}[12] 0)?
cdla-sharing | 70 | 0.93 | community data licen | community data {l} agreement sharing(?:{v}1 0)?
cdla | 50 | 0.85 | community data licen | community data {l} agreement
ncsa | 65 | 0.92 | ncsa open source licen | (?:university of illinois )?(?:illinois )?ncsa open source {l}
upl-1.0 | 65 | 0.92 | universal permissive licen | universal permissive {l}(?:{v}1 0)?
vim | 50 | 0.85 | vim licen | vim {l}
qpl-1.0 | 65 | 0.92 | q public licen | q public {l}(?:{v}1 0)?
openrail | 65 | 0.92 | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: {l})?
llama | 65 | 0.92 | community licen | llama ?(?:2|3)?(?: [123])? community {l}(?: agreement)?
busl-1.1 | 75 | 0.95 | business source licen | business source {l}(?:{v}1 1)?
sspl-1.0 | 75 | 0.95 | server side public licen | server side public {l}(?:{v}1)?
sspl | 50 | 0.85 | sspl | sspl(?: (?:v1|1 0))?
elastic-2.0 | 70 | 0.93 | elastic licen | elastic {l}(?:{v}2(?: 0)?)?
commons-clause | 70 | 0.9 | commons clause | commons clause(?: {l})?(?: condition)?
polyform | 70 | 0.9 | polyform | polyform (?:noncommercial|small business|shield|strict|internal use|free trial|perimeter)(?: {l})?
prosperity | 65 | 0.85 | prosperity public licen | prosperity public {l}
parity | 65 | 0.85 | parity public licen | parity public {l}
hippocratic | 65 | 0.88 | hippocratic licen | hippocratic {l}
jsr | 60 | 0.85 | used for good not evil | the software shall be used for good not evil
ipl-1.0 | 65 | 0.9 | ibm public licen | ibm public {l}(?:{v}1 0)?
apsl-2.0 | 65 | 0.9 | apple public source licen | apple public source {l}(?:{v}[12] [0-2])?
sun | 60 | 0.85 | licen | sun (?:industry standards source|public) {l}
lppl | 70 | 0.92 | latex project public licen | latex project public {l}(?:{v}1 [0-3]c?)?
cecill | 65 | 0.9 | cecill | cecill(?: [bc])?(?: {l})?(?: 2 [01])?
mulan-2.0 | 70 | 0.92 | mulan permissive | mulan permissive software {l}(?:{v}[12])?
ecl-2.0 | 65 | 0.9 | educational community licen | educational community {l}(?:{v}[12] 0)?
postgresql | 65 | 0.9 | postgresql licen | postgresql {l}
icu | 60 | 0.88 | icu licen | icu {l}
unicode | 65 | 0.9 | unicode licen | unicode {l}(?: v3| agreement)?
curl | 60 | 0.88 | curl licen | curl {l}
beerware | 65 | 0.88 | beer ware licen | (?:the )?beer ware {l}
beerware | 65 | 0.88 | beerware | (?:the )?beerware(?: {l})?
sleepycat | 65 | 0.9 | sleepycat licen | sleepycat {l}
zope | 65 | 0.9 | zope public licen | zope public {l}(?:{v}2 [01])?
tcl | 55 | 0.85 | tcl tk licen | tcl tk {l}
ijg | 60 | 0.88 | independent jpeg group | independent jpeg group(?: s)?(?: {l})?
bittorrent | 60 | 0.88 | bittorrent open source licen | bittorrent open source {l}
cern-ohl | 70 | 0.92 | cern open hardware licen | cern open hardware {l}(?:{v}[12](?: [02])?)?(?: (?:strongly|weakly) reciprocal| permissive)?
tapr-ohl | 65 | 0.9 | tapr open hardware licen | tapr open hardware {l}
solderpad | 60 | 0.88 | solderpad | solderpad(?: hardware)? {l}
fair | 50 | 0.7 | fair licen | fair {l}
ogl-uk | 70 | 0.92 | open government licen | open government {l}(?:{v}[123](?: 0)?)?
etalab | 65 | 0.9 | etalab | (?:etalab )?(?:licence ouverte )?etalab(?: 2 0)?
dl-de | 65 | 0.9 | datenlizenz deutschland | datenlizenz deutschland(?: namensnennung| zero)?(?:{v}2 0)?
kopimi | 50 | 0.8 | kopimi | kopimi
cc0-1.0 | 85 | 0.98 | cc0 | cc0(?:{v}1 0)(?: universal)?
cc0 | 70 | 0.95 | cc0 | cc0(?: universal)?
cc0 | 75 | 0.95 | creative commons zero | creative commons zero(?:{v}1 0)?(?: universal)?
cc0 | 85 | 0.97 | creativecommons org publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-pdm | 80 | 0.95 | creativecommons org publicdomain mark | creativecommons org publicdomain mark(?: 1 0)?
cc-by | 50 | 0.8 | cc by | cc by
cc-by | 55 | 0.85 | creative commons by | creative commons by
cc-by | 60 | 0.9 | creative commons attribution | creative commons attribution(?: {l})?
cc-by-1.0 | 80 | 0.95 | cc by | cc by{v}1 0
cc-by-2.0 | 80 | 0.95 | cc by | cc by{v}2 0
cc-by-2.5 | 80 | 0.95 | cc by | cc by{v}2 5
cc-by-3.0 | 80 | 0.95 | cc by | cc by{v}3 0(?: unported)?
cc-by-4.0 | 80 | 0.95 | cc by | cc by{v}4 0(?: international)?
cc-by-3.0 | 85 | 0.97 | creative commons attribution | creative commons attribution{v}3 0(?: unported)?(?: {l})?
cc-by-4.0 | 85 | 0.97 | creative commons attribution | creative commons attribution{v}4 0(?: international)?(?: {l})?
cc-by-sa | 60 | 0.88 | cc by sa | cc by sa
cc-by-sa-2.0 | 85 | 0.97 | cc by sa | cc by sa{v}2 0
cc-by-sa-2.5 | 85 | 0.97 | cc by sa | cc by sa{v}2 5
cc-by-sa-3.0 | 85 | 0.97 | cc by sa | cc by sa{v}3 0(?: unported)?
cc-by-sa-4.0 | 85 | 0.97 | cc by sa | cc by sa{v}4 0(?: international)?
cc-by-sa | 70 | 0.92 | attribution sharealike | (?:creative commons )?attribution sharealike(?: {l})?
cc-by-sa | 70 | 0.92 | attribution share alike | (?:creative commons )?attribution share alike(?: {l})?
cc-by-sa-3.0 | 88 | 0.97 | attribution share | (?:creative commons )?attribution share ?alike{v}3 0(?: unported)?(?: {l})?
cc-by-sa-4.0 | 88 | 0.97 | attribution share | (?:creative commons )?attribution share ?alike{v}4 0(?: international)?(?: {l})?
cc-by-nd | 60 | 0.88 | cc by nd | cc by nd
cc-by-nd-3.0 | 85 | 0.97 | cc by nd | cc by nd{v}3 0(?: unported)?
cc-by-nd-4.0 | 85 | 0.97 | cc by nd | cc by nd{v}4 0(?: international)?
cc-by-nd | 70 | 0.92 | attribution no | (?:creative commons )?attribution no ?deriv(?:ative)?s(?: (?:works))?(?: [2-4] [05])?
cc-by-nc | 60 | 0.88 | cc by nc | cc by nc
cc-by-nc-2.0 | 85 | 0.97 | cc by nc | cc by nc{v}2 0
cc-by-nc-3.0 | 85 | 0.97 | cc by nc | cc by nc{v}3 0(?: unported)?
cc-by-nc-4.0 | 85 | 0.97 | cc by nc | cc by nc{v}4 0(?: international)?
cc-by-nc | 70 | 0.92 | attribution non | (?:creative commons )?attribution non ?commercial(?: {l})?
cc-by-nc-3.0 | 88 | 0.97 | attribution non | (?:creative commons )?attribution non ?commercial{v}3 0(?: unported)?
cc-by-nc-4.0 | 88 | 0.97 | attribution non | (?:creative commons )?attribution non ?commercial{v}4 0(?: international)?
cc-by-nc-sa | 65 | 0.9 | cc by nc sa | cc by nc sa
cc-by-nc-sa-3.0 | 88 | 0.97 | cc by nc sa | cc by nc sa{v}3 0(?: unported)?
cc-by-nc-sa-4.0 | 88 | 0.97 | cc by nc sa | cc by nc sa{v}4 0(?: international)?
cc-by-nc-sa | 78 | 0.93 | attribution non | (?:creative commons )?attribution non ?commercial share ?alike(?: [2-4] [05])?(?: {l})?
cc-by-nc-nd | 65 | 0.9 | cc by nc nd | cc by nc nd
cc-by-nc-nd-3.0 | 88 | 0.97 | cc by nc nd | cc by nc nd{v}3 0(?: unported)?
cc-by-nc-nd-4.0 | 88 | 0.97 | cc by nc nd | cc by nc nd{v}4 0(?: international)?
cc-by-nc-nd | 78 | 0.93 | attribution non | (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [2-4] [05])?
cc-by | 90 | 0.97 | creativecommons org licenses by | creativecommons org licenses by(?: [1-4] [05])?
cc-by-sa | 92 | 0.97 | creativecommons org licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd | 92 | 0.97 | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-nc | 92 | 0.97 | creativecommons org licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nc-sa | 94 | 0.97 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc-nd | 94 | 0.97 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
creative-commons | 40 | 0.7 | creative commons | creative commons(?: {l})?
spdx | 95 | 1.0 | spdx licen | spdx {l} identifier [0-9a-z]+(?: [0-9]+)*(?: only| or later)?
spdx | 60 | 0.9 | spdx | spdx filecopyrighttext
public-domain | 65 | 0.9 | the public domain | (?:released|dedicated|placed|put|are|is|falls|now) (?:in|into|to) the public domain
public-domain | 20 | 0.5 | public domain | public domain
reserved | 40 | 0.7 | rights | (?:all|some) rights (?:are )?reserved
reserved | 65 | 0.9 | may be reproduced | no part of this (?:publication|work|book|document|site|website|report) may be reproduced
reserved | 65 | 0.85 | without the prior written | without the prior written (?:permission|consent)
reserved | 55 | 0.75 | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication)
reserved | 60 | 0.85 | strictly prohibited | (?:reproduction|distribution|copying|redistribution) (?:is|are) strictly prohibited
copyright | 30 | 0.6 | copyright | copyright (?:c )?(?:by )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*
copyright | 25 | 0.5 | copyright | copyright (?:c|holders?|owners?|notice|law)
copyright | 25 | 0.55 | copyrighted | (?:is|are|this) copyrighted (?:material|work|by)
proprietary | 65 | 0.9 | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | 55 | 0.8 | proprietary | proprietary (?:{l}|software|information of)
eula | 60 | 0.85 | end user licen | end user {l}(?: agreement)?
non-commercial | 50 | 0.75 | non commercial | for non commercial (?:use|purposes)(?: only)?
non-commercial | 50 | 0.75 | noncommercial | for noncommercial (?:use|purposes)(?: only)?
personal-use | 50 | 0.75 | personal use only | for (?:your )?personal use only
research-only | 50 | 0.75 | research purposes only | for (?:academic )?research purposes only
freeware | 40 | 0.7 | freeware | (?:is|as) freeware
shareware | 40 | 0.7 | shareware | (?:is|as) shareware
warranty | 15 | 0.3 | without warrant | without warrant(?:y|ies) of any kind
warranty | 15 | 0.3 | implied warranties of merchantability | (?:the )?implied warranties of merchantability
as-is | 15 | 0.3 | provided | (?:is )?provided (?:on an )?as is(?: basis)?
liability | 15 | 0.3 | no event shall | in no event shall the (?:authors?|copyright holders?)
patent | 20 | 0.4 | patent licen | (?:royalty free )?patent {l}
licensed | 5 | 0.3 | licen | licen[sc]ed under
licensed | 5 | 0.2 | licen | (?:under|see|subject to) the (?:terms of the )?{l}
"""
_MACROS = {"{later}": r"(?: or (?:at your option )?(?:any )?later(?: versions?)?)?", "{v}": r"(?: version)? (?:v ?)?", "{l}": r"licen[sc]e"}

WORD = byte_class(bytes([*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]))
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = [(re.compile(rb"(?<![^ ])" + p.encode() + rb"(?![^ ])"), label) for p, label in BASE.items()]
#: Words that say little about licenses: no root is one of them.
PLAIN = frozenset("free good have made notice only open same shall software source terms that this under used version with without".split())
#: Keywords of a root that are looked for before its text is scanned; a root of more keywords is telling by itself.
MOST_NEEDS = 12

RESULT = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Rule:
    """A signature over words; larger priorities win."""

    label: str
    pattern: re.Pattern[bytes]
    keyword: bytes
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in the order of priority; the base phrases are keywords of their own (see ``keywords``)."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, confidence, keyword, pattern = line.split(" | ")
        for k, v in _MACROS.items():
            pattern = pattern.replace(k, v)
        out.append(Rule(label, re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])"), keyword.encode(), int(priority), float(confidence)))
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(maxsize=1)
def ordered_rules() -> tuple[Rule, ...]:
    return tuple(rules())


@lru_cache(maxsize=1)
def rules_by_keyword() -> list[tuple[bytes, list[tuple[int, Rule]]]]:
    out: dict[bytes, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(ordered_rules()):
        out.setdefault(r.keyword, []).append((i, r))
    return list(out.items())


@lru_cache(maxsize=1)
def roots() -> list[tuple[bytes, re.Pattern[bytes] | None]]:
    """(root, what its text must match): byte strings one of which is in every text that a rule or base phrase matches.

    Each keyword gives one of its words, the one that most keywords share; of a root
    of few keywords a text must hold a whole keyword, its words parted by
    anything that isn't a word.
    """
    left = {k for k, _ in rules_by_keyword()} | {p.encode() for p in BASE}
    out = []
    while left:
        shared = Counter(w for k in left for w in set(k.split()) if len(w) > 3 and w.decode() not in PLAIN)
        if shared:
            root = max(shared, key=lambda w: (shared[w], len(w), w))
            own = {k for k in left if root in k}
        else:  # short and plain words only
            one = min(left)
            root = min(one.split(), key=lambda w: (w.decode() in PLAIN or w in (b"the", b"of"), -len(w)))
            own = {k for k in left if root in k.split()}
        gap = rb"[^0-9a-z\x80-\xff]+"
        whole = b"|".join(gap.join(map(re.escape, k.split())) for k in sorted(own))
        if len(root) <= 3:  # also the end of many words
            whole = rb"(?<![0-9a-z\x80-\xff])(?:" + whole + rb")(?![0-9a-z\x80-\xff])"
        out.append((root, re.compile(whole) if len(own) <= MOST_NEEDS else None))
        left -= own
    return out


class _Reach:
    """The largest end among intervals that start at or before a place: a binary indexed tree over the known starts."""

    def __init__(self, starts: list[int]) -> None:
        self.starts = sorted(set(starts))
        self.most = [0] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_left(self.starts, start) + 1
        while i < len(self.most):
            self.most[i] = max(self.most[i], end)
            i += i & -i

    def up_to(self, start: int) -> int:
        i, out = bisect.bisect_right(self.starts, start), 0
        while i:
            out = max(out, self.most[i])
            i -= i & -i
        return out


def detections(joined: bytes) -> list[tuple[int, int, Rule]]:
    """Accepted detections (start, end, rule) in words joined by single spaces."""
    found = [(-r.priority, m.start() - m.end(), m.start(), i, m.end()) for k, own in rules_by_keyword() if k in joined for i, r in own for m in r.pattern.finditer(joined)]
    found.sort()
    accepted: list[tuple[int, int, Rule]] = []
    reach = _Reach([x[2] for x in found])
    for _, _, start, i, end in found:
        if reach.up_to(start) < end:
            accepted.append((start, end, ordered_rules()[i]))
            reach.add(start, end)
    return sorted(accepted, key=lambda x: x[:2])


def scan(text: bytes) -> tuple[int, int | None, int | None, str, str, float]:
    """(n_base, first_word, last_word, base_labels, labels, score) of a lower-cased text."""
    joined = b" ".join(_WORDS.findall(text))
    places, base = [], set()
    for pattern, label in _BASE:
        word, at = 0, 0
        for m in pattern.finditer(joined):
            word, at = word + joined.count(b" ", at, m.start()), m.start()
            places.append(word)
            base.add(label)
    got = detections(joined)
    miss = 1.0
    for _, _, r in got:
        miss *= 1 - r.confidence
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in got})), 1 - miss


def candidates(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Texts of lower-cased ``data`` that hold a root and what it needs."""
    hit = np.zeros(len(offsets) - 1, bool)
    for root, need in roots():
        at = data.find(root)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, "right")) - 1
            if not hit[text] and (need is None or need.search(data[offsets[text] : offsets[text + 1]])):
                hit[text] = True
            at = data.find(root, int(offsets[text + 1]))
    return np.flatnonzero(hit)


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``RESULT`` columns of every row."""
    ship(df.sparkSession)
    from pyspark.sql import functions as F

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            buf, offsets = flat(batch.column("text"))
            data = buf.tobytes().lower()
            _, _, first = spans(np.frombuffer(data, np.uint8), offsets, WORD)
            out: list[list] = [[0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows, [""] * batch.num_rows, [""] * batch.num_rows, [0.0] * batch.num_rows]
            for i in candidates(data, offsets):
                for column, value in zip(out, scan(data[offsets[i] : offsets[i + 1]]), strict=True):
                    column[i] = value
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, RESULT.format(rows.schema["doc_id"].dataType.simpleString()))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scanned(table(spark, sf_dir, "documents"), "doc_id", "text")
