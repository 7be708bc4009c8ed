"""License scans: an ordered list of signature rules behind a keyword prefilter."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from re import _constants as op
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.arrow_batches import bounded, small_batches

# The phrases that are looked for as they stand, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Kinds of rules: priority (higher wins where one detection contains another) and confidence.
KINDS = {"spdx": (90, 1.0), "body": (80, 0.98), "notice": (70, 0.95), "url": (60, 0.9), "name": (40, 0.8), "tag": (20, 0.6)}

# Fixed values, written by hand: below each label its rules, as "kind: regex over lower-cased words with one space between
# them". {under} stands for the ways of saying that something is licensed.
UNDER = r"(?:(?:is |are )?(?:re)?(?:licensed|released|distributed|available|published|provided|shared|covered|governed|usable) (?:under|by|subject to|according to|in accordance with) |(?:under|subject to|accept) (?=the terms))(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
SIGNATURES = r"""
mit
  body: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
  body: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
  body: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
  notice: {under}(?:mit|expat)(?: x11)?(?: style)?(?: open source)?(?: licen[cs]e)?
  url: opensource org licenses? mit(?: license)?(?: php| html)?
  url: mit license org
  name: (?:mit|expat) licen[cs]e
  tag: licen[cs]ed? mit
  tag: mit licensed
mit-0
  notice: {under}mit (?:no attribution|0)(?: licen[cs]e)?
  url: opensource org licenses? mit 0
  name: mit no attribution(?: licen[cs]e)?
x11
  body: except as contained in this notice the name of the x consortium shall not be used in advertising
  notice: {under}x11 licen[cs]e
  name: x11 licen[cs]e
isc
  body: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
  body: the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
  notice: {under}isc(?: licen[cs]e)?
  url: opensource org licenses? isc
  name: isc licen[cs]e
apache-1.1
  body: this product includes software developed by the apache software foundation
  notice: {under}apache(?: software)? licen[cs]e(?: version| v)? 1 1
  url: apache org licenses license 1 1
  name: apache(?: software)? licen[cs]e(?: version| v)? 1 1
apache-2
  body: you may not use this file except in compliance with the license you may obtain a copy of the license at http s? ?(?:www )?apache org
  body: grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide
  body: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
  notice: {under}apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?v?2(?: 0)?(?: licen[cs]e)?
  notice: {under}asl ?2(?: 0)?
  url: apache org licenses license 2(?: 0)?
  url: opensource org licenses? apache 2 0
  name: apache(?: software)? licen[cs]e(?: version| v)? ?v?2(?: 0)?
  tag: (?:apache|asl) ?2 0
gpl-1
  notice: {under}(?:gnu )?general public licen[cs]e(?: version| v)? ?v?1(?: 0)?
  notice: {under}(?:gnu )?gpl(?: version| v)? ?v?1(?: 0)?
  name: gnu general public licen[cs]e(?: version| v)? ?v?1(?: 0)?
gpl-2
  body: gnu general public license version 2 june 1991
  notice: {under}(?:gnu )?general public licen[cs]e(?: version| v)? ?v?2(?: 0)?(?: only)?
  notice: {under}(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?(?: only)?
  url: gnu org licenses (?:old licenses )?gpl 2 0
  url: opensource org licenses? gpl 2 0
  name: (?:gnu )?general public licen[cs]e(?: version| v)? ?v?2(?: 0)?(?: only)?
  name: (?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?(?: only| licen[cs]ed?)?
  tag: gplv2(?: only)?
gpl-2-or-later
  body: either version 2 of the license or at your option any later version
  notice: {under}(?:gnu )?general public licen[cs]e(?: version| v)? ?v?2(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  notice: {under}(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?general public licen[cs]e(?: version| v)? ?v?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?gpl(?: version| v)? ?v?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
  tag: gplv2 or later
gpl-3
  body: gnu general public license version 3 29 june 2007
  notice: {under}(?:gnu )?general public licen[cs]e(?: version| v)? ?v?3(?: 0)?(?: only)?
  notice: {under}(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?(?: only)?
  url: gnu org licenses gpl 3 0
  url: opensource org licenses? gpl 3 0
  name: (?:gnu )?general public licen[cs]e(?: version| v)? ?v?3(?: 0)?(?: only)?
  name: (?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?(?: only| licen[cs]ed?)?
  tag: gplv3(?: only)?
gpl-3-or-later
  body: either version 3 of the license or at your option any later version
  notice: {under}(?:gnu )?general public licen[cs]e(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  notice: {under}(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?general public licen[cs]e(?: version| v)? ?v?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?gpl(?: version| v)? ?v?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)?
  tag: gplv3 or later
gpl
  body: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
  body: you should have received a copy of the gnu general public license along with this program
  url: gnu org copyleft gpl html
  name: gnu general public licen[cs]e
  tag: gnu gpl
lgpl-2.1
  body: gnu lesser general public license version 2 1 february 1999
  notice: {under}(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?v?2 1
  notice: {under}(?:gnu )?lgpl(?: version| v)? ?v?2 1
  url: gnu org licenses (?:old licenses )?lgpl 2 1
  name: (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?v?2 1
  name: (?:gnu )?lgpl(?: version| v)? ?v?2 1
  tag: lgplv2 1
lgpl-2.1-or-later
  notice: {under}(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?2 1 (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  notice: {under}(?:gnu )?lgpl(?: version| v)? ?v?2 1 (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?2 1 (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?lgpl(?: version| v)? ?v?2 1 (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  tag: lgplv2 1 or later
lgpl-2-or-later
  notice: {under}(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?2(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  notice: {under}(?:gnu )?lgpl(?: version| v)? ?v?2(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?2(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?lgpl(?: version| v)? ?v?2(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  tag: lgplv2 or later
lgpl-2
  notice: {under}(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?2(?: 0)?
  notice: {under}(?:gnu )?lgpl(?: version| v)? ?v?2(?: 0)?
  name: (?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?v?2(?: 0)?
  name: (?:gnu )?lgpl(?: version| v)? ?v?2(?: 0)?
lgpl-3-or-later
  notice: {under}(?:gnu )?(?:lesser) general public licen[cs]e(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  notice: {under}(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?(?:lesser) general public licen[cs]e(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  tag: lgplv3 or later
lgpl-3
  notice: {under}(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?v?3(?: 0)?
  notice: {under}(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?
  url: gnu org licenses lgpl 3 0
  name: (?:gnu )?lesser general public licen[cs]e(?: version| v)? ?v?3(?: 0)?
  name: (?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?
  tag: lgplv3
lgpl
  body: you can redistribute it and or modify it under the terms of the gnu lesser general public license
  name: gnu library general public licen[cs]e
  name: gnu lesser general public licen[cs]e
  tag: gnu lgpl
agpl-3-or-later
  notice: {under}(?:gnu )?(?:affero) general public licen[cs]e(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  notice: {under}(?:gnu )?agpl(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?(?:affero) general public licen[cs]e(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  name: (?:gnu )?agpl(?: version| v)? ?v?3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?
  tag: agplv3 or later
agpl-3
  body: gnu affero general public license version 3 19 november 2007
  body: you can redistribute it and or modify it under the terms of the gnu affero general public license
  notice: {under}(?:gnu )?affero general public licen[cs]e(?:(?: version| v)? ?v?3(?: 0)?)?
  notice: {under}(?:gnu )?agpl(?:(?: version| v)? ?v?3(?: 0)?)?
  url: gnu org licenses agpl
  name: (?:gnu )?affero general public licen[cs]e(?:(?: version| v)? ?v?3(?: 0)?)?
  name: (?:gnu )?agpl(?: version| v)? ?v?3(?: 0)?
  tag: agpl ?v?3(?: 0)?
gfdl
  notice: {under}(?:gnu )?free documentation licen[cs]e(?:(?: version| v)? ?v?1 [0-9])?
  url: gnu org licenses fdl
  name: (?:gnu )?free documentation licen[cs]e(?:(?: version| v)? ?v?1 [0-9])?
  tag: gfdl
classpath-exception
  body: as a special exception the copyright holders of this library give you permission to link this library with independent modules
  name: gpl(?: version| v)? ?v?2(?: 0)? with (?:the )?classpath exception
  name: general public license(?: version| v)? ?v?2(?: 0)? with (?:the )?classpath exception
  tag: classpath exception(?: 2 0)?
gcc-exception
  name: gcc runtime library exception(?: version 3 1)?
linking-exception
  body: linking this library statically or dynamically with other modules is making a combined work based on this library
llvm-exception
  name: apache(?: license)?(?: version| v)? ?v?2(?: 0)? with llvm exceptions?
bsd-0
  body: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
  notice: {under}(?:zero clause bsd|0 ?bsd|bsd zero clause)(?: licen[cs]e)?
  name: (?:zero clause bsd|bsd zero clause|0bsd) licen[cs]e
bsd-2
  notice: {under}(?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause)(?: licen[cs]e)?
  url: opensource org licenses? bsd 2 clause
  name: (?:(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause)(?: licen[cs]e)?
bsd-3
  body: neither the name of (?:the )?(?:[^ ]{1,30} ){1,12}?nor the names of its contributors may be used to endorse or promote products derived from this software
  notice: {under}(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause)(?: licen[cs]e)?
  url: opensource org licenses? bsd 3 clause
  name: (?:(?:new|modified|revised|3 clause|three clause) bsd|bsd (?:3|three) clause)(?: licen[cs]e)?
bsd-4
  body: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
  notice: {under}(?:(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause)(?: licen[cs]e)?
  name: (?:(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause)(?: licen[cs]e)?
bsd
  body: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
  body: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
  body: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
  notice: {under}bsd(?: style)? licen[cs]e
  url: opensource org licenses? bsd license
  name: bsd(?: style)? licen[cs]e
mpl-1.1
  body: the contents of this file are subject to the mozilla public license version 1 1
  notice: {under}mozilla public licen[cs]e(?: version| v)? ?v?1 1
  notice: {under}mpl(?: version| v)? ?v?1 1
  url: mozilla org mpl 1 1
  name: mozilla public licen[cs]e(?: version| v)? ?v?1 1
mpl-2
  body: this source code form is subject to the terms of the mozilla public license v 2 0
  body: if a copy of the mpl was not distributed with this file you can obtain one at
  notice: {under}mozilla public licen[cs]e(?: version| v)? ?v?2(?: 0)?
  notice: {under}mpl(?: version| v)? ?v?2(?: 0)?
  url: mozilla org (?:en us )?mpl 2 0
  name: mozilla public licen[cs]e(?: version| v)? ?v?2(?: 0)?
  tag: mpl ?v?2 0
epl-1
  body: this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
  notice: {under}eclipse public licen[cs]e(?: version| v)? ?v?1(?: 0)?
  notice: {under}epl(?: version| v)? ?v?1(?: 0)?
  url: eclipse org legal epl v10
  name: eclipse public licen[cs]e(?: version| v)? ?v?1(?: 0)?
epl-2
  notice: {under}eclipse public licen[cs]e(?: version| v)? ?v?2(?: 0)?
  notice: {under}epl(?: version| v)? ?v?2(?: 0)?
  url: eclipse org legal epl (?:2 0|v20)
  name: eclipse public licen[cs]e(?: version| v)? ?v?2(?: 0)?
edl-1
  name: eclipse distribution licen[cs]e(?: version| v)? ?v?1(?: 0)?
cddl-1
  body: the contents of this file are subject to the terms of the common development and distribution license
  notice: {under}common development and distribution licen[cs]e(?:(?: version| v)? ?v?1(?: [01])?)?
  notice: {under}cddl(?:(?: version| v)? ?v?1(?: [01])?)?
  name: common development and distribution licen[cs]e(?:(?: version| v)? ?v?1(?: [01])?)?
cpl-1
  name: common public licen[cs]e(?: version| v)? ?v?1(?: 0)?
cc0
  body: to the extent possible under law (?:the )?(?:[^ ]{1,30} ){1,10}?(?:has|have) waived all copyright and related or neighboring rights
  notice: {under}(?:creative commons )?cc ?(?:0|zero)(?: 1 0)?
  url: creativecommons org publicdomain zero 1 0
  name: (?:creative commons zero|cc0 1 0 universal|cc zero|cc0)(?: licen[cs]e)?
cc-by
  notice: {under}(?:creative commons attribution|cc by)(?: [1-4] 0)?(?: international| unported| generic)?(?: licen[cs]e)?
  url: creativecommons org licenses by [1-4] 0
  name: creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?(?: licen[cs]e)?
  name: cc by [1-4] 0
  tag: cc by
cc-by-sa
  notice: {under}(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] 0)?(?: international| unported| generic)?(?: licen[cs]e)?
  url: creativecommons org licenses by sa [1-4] 0
  name: (?:creative commons )?attribution share ?alike(?: [1-4] 0)?(?: international| unported| generic)?(?: licen[cs]e)?
  name: cc by sa(?: [1-4] 0)?
cc-by-nc
  notice: {under}(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] 0)?(?: international| unported| generic)?(?: licen[cs]e)?
  url: creativecommons org licenses by nc [1-4] 0
  name: (?:creative commons )?attribution non ?commercial(?: [1-4] 0)?(?: international| unported| generic)?(?: licen[cs]e)?
  name: cc by nc(?: [1-4] 0)?
cc-by-nd
  notice: {under}(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1-4] 0)?
  url: creativecommons org licenses by nd [1-4] 0
  name: (?:creative commons )?attribution no ?deriv(?:ative)?s(?: [1-4] 0)?
  name: cc by nd(?: [1-4] 0)?
cc-by-nc-sa
  notice: {under}(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] 0)?
  url: creativecommons org licenses by nc sa [1-4] 0
  name: attribution non ?commercial share ?alike(?: [1-4] 0)?
  name: cc by nc sa(?: [1-4] 0)?
cc-by-nc-nd
  notice: {under}(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1-4] 0)?
  url: creativecommons org licenses by nc nd [1-4] 0
  name: attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] 0)?
  name: cc by nc nd(?: [1-4] 0)?
cc
  name: (?:under|with) a creative commons licen[cs]e
unlicense
  body: this is free and unencumbered software released into the public domain
  notice: {under}unlicense
  url: unlicense org
  name: the unlicense
public-domain
  body: (?:released|dedicated|placed|donated) (?:in)?to the public domain
  name: (?:is|are|this work is|this file is) in the public domain
  tag: public domain
wtfpl
  body: do what the fuck you want to public license
  notice: {under}wtfpl
  name: wtfpl(?: licen[cs]e| version 2)?
zlib
  body: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
  body: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
  notice: {under}zlib(?: libpng)?(?: licen[cs]e)?
  name: zlib(?: libpng)? licen[cs]e
bsl-1
  body: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
  notice: {under}boost(?: software)? licen[cs]e(?: version)?(?: 1 0)?
  url: boost org license 1 0
  name: boost software licen[cs]e(?: version)?(?: 1 0)?
busl-1.1
  name: business source licen[cs]e(?: version)?(?: 1 1)?
sspl-1
  name: server side public licen[cs]e(?: version| v)? ?v?1?
elastic-2
  name: elastic licen[cs]e(?: version| v)? ?v?2(?: 0)?
artistic-1
  notice: {under}artistic licen[cs]e(?: version| v)? ?1(?: 0)?
  name: artistic licen[cs]e(?: version| v)? ?1(?: 0)?
artistic-2
  notice: {under}artistic licen[cs]e(?: version| v)? ?2(?: 0)?
  url: opensource org licenses? artistic 2 0
  name: artistic licen[cs]e(?: version| v)? ?2(?: 0)?
perl
  body: you (?:can|may) redistribute it and or modify it under the same terms as perl itself
eupl-1.2
  notice: {under}european union public licen[cs]e(?: version| v)? ?v?1 2
  notice: {under}eupl(?: version| v)? ?v?1 2
  name: european union public licen[cs]e(?: version| v)? ?v?1 2
  name: eupl(?: version| v)? ?v?1 2
eupl-1.1
  name: european union public licen[cs]e(?: version| v)? ?v?1 1
  name: eupl(?: version| v)? ?v?1 1
ofl-1.1
  body: this font software is licensed under the sil open font license version 1 1
  notice: {under}(?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
  url: scripts sil org ofl
  name: (?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
odbl-1
  url: opendatacommons org licenses odbl
  name: open (?:data commons open )?database licen[cs]e(?: version| v)?(?: 1 0)?
odc-by-1
  url: opendatacommons org licenses by
  name: open data commons attribution licen[cs]e
pddl-1
  name: (?:open data commons )?public domain dedication and licen[cs]e
psf-2
  notice: {under}python software foundation licen[cs]e(?: version| agreement)?(?: 2)?
  notice: {under}psf licen[cs]e(?: version| agreement)?(?: 2)?
  name: python software foundation licen[cs]e(?: version)?(?: 2)?
php-3
  body: this product includes php software freely available from
  name: php licen[cs]e(?: version)?(?: 3(?: 0[01]?)?)
postgresql
  notice: {under}postgresql licen[cs]e
  name: postgresql licen[cs]e
ncsa
  name: (?:university of illinois )?ncsa(?: open source)? licen[cs]e
afl-3
  name: academic free licen[cs]e(?: version| v)? ?v?3(?: 0)?
upl-1
  name: universal permissive licen[cs]e(?: version| v)?(?: 1 0)?
ms-pl
  notice: {under}microsoft public licen[cs]e
  notice: {under}ms pl
  name: microsoft public licen[cs]e(?: ms pl)?
ms-rl
  name: microsoft reciprocal licen[cs]e(?: ms rl)?
openssl
  body: this product includes software developed by the openssl project for use in the openssl toolkit
  name: openssl licen[cs]e
vim
  name: vim licen[cs]e
w3c
  name: w3c(?: software)?(?: notice and)? licen[cs]e
unicode
  name: unicode(?: data files and software)? licen[cs]e(?: agreement)?
beerware
  body: if we meet some day and you think this stuff is worth it you can buy me a beer in return
  name: beerware licen[cs]e
json
  body: the software shall be used for good not evil
proprietary
  body: unauthorized copying of this file via any medium is strictly prohibited
  body: this software is the confidential and proprietary information of
  notice: (?:proprietary|commercial) licen[cs]e agreement
  tag: all rights reserved
"""

# Identifiers of the SPDX list as their words, and the label of each.
SPDX = {
    "mit": "mit", "mit 0": "mit-0", "x11": "x11", "isc": "isc", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2", "gpl 1 0": "gpl-1",
    "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3", "agpl 3 0": "agpl-3", "0bsd": "bsd-0",
    "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "bsd 4 clause": "bsd-4", "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2", "epl 1 0": "epl-1",
    "epl 2 0": "epl-2", "cddl 1 0": "cddl-1", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc",
    "cc by nd 4 0": "cc-by-nd", "cc by nc sa 4 0": "cc-by-nc-sa", "cc by nc nd 4 0": "cc-by-nc-nd", "unlicense": "unlicense", "wtfpl": "wtfpl",
    "zlib": "zlib", "bsl 1 0": "bsl-1", "busl 1 1": "busl-1.1", "sspl 1 0": "sspl-1", "artistic 2 0": "artistic-2", "eupl 1 2": "eupl-1.2",
    "ofl 1 1": "ofl-1.1", "odbl 1 0": "odbl-1", "psf 2 0": "psf-2", "php 3 01": "php-3", "postgresql": "postgresql", "ncsa": "ncsa",
    "afl 3 0": "afl-3", "upl 1 0": "upl-1", "ms pl": "ms-pl", "ms rl": "ms-rl", "openssl": "openssl", "vim": "vim",
}


def literals(pattern: str) -> list[str]:
    """Strings one of which any match of ``pattern`` holds, from the parsed pattern: of a sequence the run of characters
    or the alternation with the longest shortest string, of an alternation those of all its branches."""

    def best(choices: list[list[str]]) -> list[str]:
        return max(choices, key=lambda c: (min(map(len, c)), -len(c)))

    def of(items) -> list[str]:
        choices, run = [[""]], ""
        for kind, value in items:
            if kind is op.LITERAL:
                run += chr(value)
                choices.append([run])
                continue
            run = ""
            if kind is op.SUBPATTERN:
                choices.append(of(value[-1]))
            elif kind is op.BRANCH:
                choices.append([x for branch in value[1] for x in of(branch)])
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                choices.append(of(value[2]))
        return best(choices)

    found = of(_parser.parse(pattern))
    if min(map(len, found)) < 2:
        raise ValueError(f"no keyword is part of every match of {pattern}")
    return sorted(set(found))


class Rule:
    """One signature: one of ``keywords`` stands in any match of ``pattern``, which is tried only where one does. A
    detection is the match, or its group ``at``."""

    def __init__(self, rank: int, label: str, kind: str, pattern: str):
        self.rank, self.label = rank, label
        self.priority, self.confidence = KINDS[kind]
        full = pattern.replace("{under}", UNDER)
        self.pattern = re.compile(rf" (?:{full})(?= )")
        self.keywords = literals(pattern.replace("{under}", ""))  # every match holds one of what follows, too
        self.reach = _parser.parse(full).getwidth()[1] + 2
        if self.reach > 5_000:
            raise ValueError(f"a match of {pattern} may be too long: bound its repetitions")
        self.group = self.pattern.groupindex.get("at", 0)


@functools.lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules in order; a lower place wins among equal priorities and lengths."""
    made = []
    for line in SIGNATURES.strip("\n").split("\n"):
        if not line.startswith(" "):
            label = line
        else:
            kind, pattern = line.strip().split(": ", 1)
            made.append((label, kind, pattern))
    any_id = "|".join(sorted(SPDX, key=lambda x: (-len(x), x)))
    later = "(?: only| or later)?"
    before = rf"spdx license identifier (?:(?:{any_id}){later}(?: with [a-z]{{1,30}} exception(?: [0-9]){{0,2}})? (?:or|and) ){{0,4}}"
    for words, label in SPDX.items():
        if "gpl" in label:
            made.append((f"{label}-or-later", "spdx", rf"{before}(?P<at>{words} or later)"))
            made.append((label, "spdx", rf"{before}(?P<at>{words}(?: only)?)"))
        else:
            made.append((label, "spdx", rf"{before}(?P<at>{words}{later})"))
    return [Rule(i, *r) for i, r in enumerate(made)]


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str | None) -> str:
    """The text's words with one space before, between and behind them; a character stands for a byte of UTF-8."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    return f" {b' '.join(words).decode('latin-1')} "


def suppressed(found: list[tuple]) -> list[tuple]:
    """Of (priority, rank, first, last, ...) detections those that stay: of two one of which contains the other, that of
    higher priority, else the longer, else that of the earlier rule.

    No detection that stays contains another, so ordered by start they are ordered by end as well, and a new one need be
    compared with its two neighbours only.
    """
    kept: list[tuple[int, int]] = []
    out = []
    for f in sorted(found, key=lambda x: (-x[0], x[2] - x[3], x[1], x[2])):
        a, b = f[2], f[3]
        i = bisect_left(kept, (a, -1))
        if (i and kept[i - 1][1] >= b) or (i < len(kept) and (kept[i][0] == a or kept[i][1] <= b)):
            continue
        insort(kept, (a, b))
        out.append(f)
    return out


class LicenseScanner:
    """Detections in one text: keyword automaton, then the rules around their keywords, then suppression."""

    def __init__(self) -> None:
        self.rules = rules()
        self.base = {f" {p} ": label for p, label in BASE.items()}
        gated: dict[str, list[int]] = {}
        for r in self.rules:
            for key in r.keywords:
                gated.setdefault(key, []).append(r.rank)
        self.keys = ahocorasick.Automaton()
        for key, some in gated.items():
            self.keys.add_word(key, some)
        self.keys.make_automaton()

    def found(self, line: str, gate: bool = True) -> list[tuple[int, int, int, int]]:
        """(priority, rank, first, last character) of all rules' matches, before suppression. Without ``gate`` every rule
        is tried on all of the line: the same matches, more slowly."""
        near: dict[int, list[int]] = {}
        if gate:
            for end, some in self.keys.iter(line):
                for rank in some:
                    near.setdefault(rank, []).append(end)
        else:
            near = {r.rank: [] for r in self.rules}
        out = []
        for rank, ends in near.items():
            r = self.rules[rank]
            spans = [[0, len(line)]]
            if gate:
                spans = []
                for end in sorted(ends):  # a match has one of its keywords inside, so it lies within reach of it
                    low, high = max(0, end - r.reach - 1), min(len(line), end + r.reach + 2)
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = high
                    else:
                        spans.append([low, high])
            for low, high in spans:
                for m in r.pattern.finditer(line, low, high):
                    a, b = m.span(r.group)
                    out.append((r.priority, rank, a + (not r.group), b))
        return out

    def scan(self, text: str | None, gate: bool = True) -> dict:
        """Words, base places and kept detections (label, first word, last word, confidence) of the whole text."""
        line = folded(text)
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        places: list[tuple[int, str]] = []
        for phrase, label in self.base.items():
            at, starts = line.find(phrase), []
            while at >= 0:
                starts.append(at)
                at = line.find(phrase, at + 1)
            places += [(w, label) for w in np.searchsorted(spaces, starts).tolist()]
        kept = suppressed(self.found(line, gate))
        first = (np.searchsorted(spaces, [f[2] for f in kept]) - 1).tolist()
        last = np.searchsorted(spaces, [f[3] for f in kept]).tolist()
        named = [(a, b, self.rules[f[1]].label, self.rules[f[1]].confidence) for a, b, f in zip(first, last, kept, strict=True)]
        return {"n_words": len(spaces) - 1 if len(line) > 2 else 0, "places": sorted(places), "detections": sorted(named)}


@functools.lru_cache(maxsize=1)
def scanner() -> LicenseScanner:
    return LicenseScanner()


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of each whole text.

    Words are runs of 0-9, a-z (A-Z lower-cased) and characters above U+007F. Base places are those where a phrase of
    ``BASE`` stands as consecutive words. The rules of ``SIGNATURES`` (license bodies, notices, addresses, names) and of
    ``SPDX`` identifiers are tried only around the places where an automaton finds one of their keywords, which are
    derived from the rules; of two detections one of which contains the other, the one of higher priority stays, else
    the longer, else that of the earlier rule. ``labels`` holds the base labels and those of kept detections, ``score``
    the largest confidence (1.0 for a base place, 0.0 for none), ``detections`` each kept label with its words [first,
    last) and confidence.

    Cases: null and empty texts have no words, null first_word and last_word, empty label strings and score 0; very long
    texts take time and memory in proportion to their length; repeated rows and ids are scanned row by row; other
    columns, whatever their names, are ignored; an empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    spot = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in bounded(batches, 1):
            got = [s.scan(t) for t in b.column(1).to_pylist()]
            base = [[label for _, label in g["places"]] for g in got]
            score = [1.0 if g["places"] else max((d[3] for d in g["detections"]), default=0.0) for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g["n_words"] for g in got], pa.int64()),
                    pa.array([len(g["places"]) for g in got], pa.int64()),
                    pa.array([g["places"][0][0] if g["places"] else None for g in got], pa.int64()),
                    pa.array([g["places"][-1][0] if g["places"] else None for g in got], pa.int64()),
                    pa.array([",".join(sorted(set(x))) for x in base], pa.string()),
                    pa.array([",".join(sorted({*x, *(d[2] for d in g["detections"])})) for x, g in zip(base, got, strict=True)], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([[{"label": d[2], "first": d[0], "last": d[1], "confidence": d[3]} for d in g["detections"]] for g in got], pa.list_(spot)),
                ],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    return df.select(id_col, text_col).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, detections array<struct<label: string, first: long, last: long, confidence: double>>",
    )
