"""Signatures of licences, one a line: label | version | kind | keyword | regex.

Regexes are over lower-cased text. A blank stands for any white space, hyphens and comment marks; `{v}` is a version,
with or without `version` or `v` before it, `{n}` one alone. The keyword is what every match holds, from the beginning
of a word on, with a blank for anything between words. Kinds, strongest first: `tag`
(only after SPDX-License-Identifier), `text` (words of the licence), `notice`, `url`, `id` (an identifier, stronger
after the tag), `named` (a name with its version), `name`.
"""

# Public identifiers, names, addresses and wordings of licences.
SIGNATURES = r"""
gpl | 1 | id | gpl | gpl-?v?1(?:\.0)?(?:-only|-or-later|\+)?
gpl | 2 | id | gpl | gpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?
gpl | 3 | id | gpl | gpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?
lgpl | 2 | id | lgpl | lgpl-?v?2(?:\.0)?(?:-only|-or-later|\+)?
lgpl | 2.1 | id | lgpl | lgpl-?v?2\.1(?:-only|-or-later|\+)?
lgpl | 3 | id | lgpl | lgpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?
agpl | 1 | id | agpl | agpl-?v?1(?:\.0)?(?:-only|-or-later|\+)?
agpl | 3 | id | agpl | agpl-?v?3(?:\.0)?(?:-only|-or-later|\+)?
gfdl | 1.1 | id | gfdl | gfdl-?v?1\.1(?:-invariants|-no-invariants)?(?:-only|-or-later)?
gfdl | 1.2 | id | gfdl | gfdl-?v?1\.2(?:-invariants|-no-invariants)?(?:-only|-or-later)?
gfdl | 1.3 | id | gfdl | gfdl-?v?1\.3(?:-invariants|-no-invariants)?(?:-only|-or-later)?
apache | 1.0 | id | apache | apache-1\.0
apache | 1.1 | id | apache | apache-1\.1
apache | 2.0 | id | apache | apache-?2(?:\.0)?
apache | 2.0 | id | asl | asl-?2\.0
mit | | tag | spdx | mit
mit-0 | | id | mit-0 | mit-0
mit | | id | x11-mit | x11-mit
x11 | | tag | spdx | x11
bsd | | id | 0bsd | 0bsd
bsd | 1-clause | id | bsd-1 | bsd-1-clause
bsd | 2-clause | id | bsd-2 | bsd-2-clause(?:-freebsd|-patent|-views)?
bsd | 3-clause | id | bsd-3 | bsd-3-clause(?:-clear|-lbnl|-attribution)?
bsd | 4-clause | id | bsd-4 | bsd-4-clause(?:-uc)?
mpl | 1.0 | id | mpl | mpl-?1\.0
mpl | 1.1 | id | mpl | mpl-?1\.1
mpl | 2.0 | id | mpl | mpl-?2\.0(?:-no-copyleft-exception)?
epl | 1.0 | id | epl | epl-?v?1\.0
epl | 2.0 | id | epl | epl-?v?2\.0
cddl | 1.0 | id | cddl | cddl-?1\.0
cddl | 1.1 | id | cddl | cddl-?1\.1
cpl | 1.0 | id | cpl | cpl-1\.0
ipl | 1.0 | id | ipl | ipl-1\.0
eupl | 1.0 | id | eupl | eupl-?1\.0
eupl | 1.1 | id | eupl | eupl-?1\.1
eupl | 1.2 | id | eupl | eupl-?1\.2(?:-or-later)?
isc | | tag | spdx | isc
zlib | | tag | spdx | zlib(?:-acknowledgement)?
libpng | | tag | spdx | libpng(?:-2\.0)?
boost | 1.0 | id | bsl | bsl-1\.0
busl | 1.1 | id | busl | busl-1\.1
artistic | 1.0 | id | artistic | artistic-1\.0(?:-perl|-cl8)?
artistic | 2.0 | id | artistic | artistic-2\.0
unlicense | | tag | spdx | unlicense
wtfpl | | id | wtfpl | wtfpl
ofl | 1.0 | id | ofl | ofl-1\.0(?:-rfn|-no-rfn)?
ofl | 1.1 | id | ofl | ofl-1\.1(?:-rfn|-no-rfn)?
odbl | 1.0 | id | odbl | odbl-1\.0
odc-by | 1.0 | id | odc | odc-by-1\.0
pddl | 1.0 | id | pddl | pddl-1\.0
psf | 2.0 | id | psf | psf-2\.0
psf | 2.0 | id | python-2 | python-2\.0(?:\.1)?
php | 3.0 | id | php | php-3\.0
php | 3.01 | id | php | php-3\.01
ruby | | tag | spdx | ruby
perl | | tag | spdx | artistic or gpl
postgresql | | tag | spdx | postgresql
upl | 1.0 | id | upl | upl-1\.0
cc0 | 1.0 | id | cc0 | cc0-1\.0
cc-by | 1.0 | id | cc-by | cc-by-1\.0
cc-by | 2.0 | id | cc-by | cc-by-2\.0
cc-by | 2.5 | id | cc-by | cc-by-2\.5
cc-by | 3.0 | id | cc-by | cc-by-3\.0(?:-[a-z]{2,3})?
cc-by | 4.0 | id | cc-by | cc-by-4\.0
cc-by-sa | 1.0 | id | cc-by | cc-by-sa-1\.0
cc-by-sa | 2.0 | id | cc-by | cc-by-sa-2\.0
cc-by-sa | 2.5 | id | cc-by | cc-by-sa-2\.5
cc-by-sa | 3.0 | id | cc-by | cc-by-sa-3\.0(?:-[a-z]{2,3})?
cc-by-sa | 4.0 | id | cc-by | cc-by-sa-4\.0
cc-by-nc | 1.0 | id | cc-by | cc-by-nc-1\.0
cc-by-nc | 2.0 | id | cc-by | cc-by-nc-2\.0
cc-by-nc | 2.5 | id | cc-by | cc-by-nc-2\.5
cc-by-nc | 3.0 | id | cc-by | cc-by-nc-3\.0
cc-by-nc | 4.0 | id | cc-by | cc-by-nc-4\.0
cc-by-nd | 1.0 | id | cc-by | cc-by-nd-1\.0
cc-by-nd | 2.0 | id | cc-by | cc-by-nd-2\.0
cc-by-nd | 2.5 | id | cc-by | cc-by-nd-2\.5
cc-by-nd | 3.0 | id | cc-by | cc-by-nd-3\.0
cc-by-nd | 4.0 | id | cc-by | cc-by-nd-4\.0
cc-by-nc-sa | 1.0 | id | cc-by | cc-by-nc-sa-1\.0
cc-by-nc-sa | 2.0 | id | cc-by | cc-by-nc-sa-2\.0
cc-by-nc-sa | 2.5 | id | cc-by | cc-by-nc-sa-2\.5
cc-by-nc-sa | 3.0 | id | cc-by | cc-by-nc-sa-3\.0
cc-by-nc-sa | 4.0 | id | cc-by | cc-by-nc-sa-4\.0
cc-by-nc-nd | 1.0 | id | cc-by | cc-by-(?:nc-nd|nd-nc)-1\.0
cc-by-nc-nd | 2.0 | id | cc-by | cc-by-nc-nd-2\.0
cc-by-nc-nd | 2.5 | id | cc-by | cc-by-nc-nd-2\.5
cc-by-nc-nd | 3.0 | id | cc-by | cc-by-nc-nd-3\.0
cc-by-nc-nd | 4.0 | id | cc-by | cc-by-nc-nd-4\.0
ms-pl | | id | ms-pl | ms-pl
ms-rl | | id | ms-rl | ms-rl
ncsa | | tag | spdx | ncsa
afl | 3.0 | id | afl | afl-3\.0
afl | 2.1 | id | afl | afl-2\.1
osl | 3.0 | id | osl | osl-3\.0
osl | 2.1 | id | osl | osl-2\.1
apsl | 2.0 | id | apsl | apsl-2\.0
qpl | 1.0 | id | qpl | qpl-1\.0
lppl | 1.3c | id | lppl | lppl-1\.3[ac]?
cecill | 2.1 | id | cecill | cecill-2\.[01]
cecill-b | | id | cecill | cecill-b
cecill-c | | id | cecill | cecill-c
mulan | 2.0 | id | mulanpsl | mulanpsl-2\.0
mulan | 1.0 | id | mulanpsl | mulanpsl-1\.0
sspl | 1.0 | id | sspl | sspl-1\.0
elastic | 2.0 | id | elastic | elastic-2\.0
hpnd | | tag | spdx | hpnd(?:-sell-variant)?
ntp | | tag | spdx | ntp
openssl | | tag | spdx | openssl
curl | | tag | spdx | curl
w3c | | tag | spdx | w3c
zpl | 2.1 | id | zpl | zpl-2\.[01]
vim | | tag | spdx | vim
beerware | | tag | spdx | beerware
json | | tag | spdx | json
icu | | tag | spdx | icu
tcl | | tag | spdx | tcl
unicode | | id | unicode | unicode-(?:dfs-20\d\d|3\.0)
blueoak | 1.0.0 | id | blueoak | blueoak-1\.0\.0
fsfap | | id | fsfap | fsfap
nasa | 1.3 | id | nasa | nasa-1\.3
sleepycat | | tag | spdx | sleepycat
ecl | 2.0 | id | ecl | ecl-2\.0
gpl | | text | redistribute it | redistribute it and/or modify it under the terms of (?:version [\d.]+ of )?the gnu general public license
gpl | 1 | text | redistribute it | redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 1
gpl | 2 | text | redistribute it | redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 2(?:\.0)?
gpl | 3 | text | redistribute it | redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] (?:either )?version 3(?:\.0)?
gpl | 2 | text | june | gnu general public license version 2,? june 1991
gpl | 3 | text | june | gnu general public license version 3,? 29 june 2007
gpl | | text | general public | the gnu general public license is (?:a free, copyleft license for software|intended to guarantee your freedom)
lgpl | | text | redistribute it | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | 2 | text | redistribute it | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation[;,] (?:either )?version 2(?:\.0)?
lgpl | 2.1 | text | redistribute it | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation[;,] (?:either )?version 2\.1
lgpl | 3 | text | redistribute it | redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation[;,] (?:either )?version 3(?:\.0)?
agpl | | text | redistribute it | redistribute it and/or modify it under the terms of the gnu affero general public license
agpl | 3 | text | redistribute it | redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation[;,] (?:either )?version 3(?:\.0)?
gfdl | | text | documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
mit | | text | hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | | text | hereby granted | permission is hereby granted, without written agreement and without license or royalty fees, to use, copy, modify, and distribute this software
mit | | text | merchantability | the software is provided .?as is.?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
boost | 1.0 | text | hereby granted | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
bsd | | text | redistribution | redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd | | text | redistributions | redistributions (?:of source code must retain the|in binary form must reproduce the) above copyright notice
bsd | 3-clause | text | endorse | neither the names? of [\w ,.<>]{0,80}nor the names of (?:its|their|the)? ?contributors may be used to endorse or promote products
bsd | 4-clause | text | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc | | text | any purpose | permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
hpnd | | text | any purpose | permission to use, copy, modify,? and distribute this software and its documentation for any purpose and without fee is hereby granted
postgresql | | text | any purpose | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
zlib | | text | implied warranty | this software is provided .?as-is.?, without any express or implied warranty\. in no event will the authors be held liable
zlib | | text | misrepresented | the origin of this software must not be misrepresented
apache | 2.0 | text | compliance | licensed under the apache license, version 2\.0 \(the .?license.?\);? you may not use this file except in compliance with the license
apache | 2.0 | text | apache | apache license version 2\.0, january 2004
apache | 1.1 | text | apache | this product includes software developed by the apache software foundation
mpl | 2.0 | text | mozilla | this source code form is subject to the terms of the mozilla public license,? v(?:ersion|\.)? ?2\.0
mpl | 1.1 | text | mozilla | the contents of this file are subject to the mozilla public license version 1\.1
mpl | 1.0 | text | mozilla | the contents of this file are subject to the mozilla public license version 1\.0
epl | | text | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | 1.0 | text | eclipse | made available under the terms of the eclipse public license v(?:ersion)? ?1\.0
epl | 2.0 | text | eclipse | made available under the terms of the eclipse public license v?(?:ersion)? ?2\.0
cddl | | text | distribution | the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only.{0,40})?the common development and distribution license
unlicense | | text | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | 2 | text | fuck | do what the fuck you want to public license,? version 2
cc0 | 1.0 | text | dedicated | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | 1.0 | text | waive | to the extent possible under law, [\w ,.]{0,80}(?:has|have) waived all copyright and related or neighboring rights
ofl | 1.1 | text | font | this font software is licensed under the sil open font license, version 1\.1
beerware | | text | beer | you can buy me a beer in return
json | | text | evil | the software shall be used for good, not evil
openssl | | text | openssl | this product includes software developed by the openssl project
php | | text | php | this product includes php software, freely available from
ncsa | | text | illinois | developed by:? [\w ,.]{0,80}university of illinois/ncsa open source license
ijg | | text | jpeg | this software is based in part on the work of the independent jpeg group
freetype | | text | freetype | portions of this software are copyright .{0,20}the freetype project
unicode | | text | unicode | permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files
psf | | text | python | psf is making python available to licensee on an .?as is.? basis
libpng | | text | libpng | this code is released under the libpng license
vim | | text | vim | there are no restrictions on distributing unmodified copies of vim
sspl | 1.0 | text | a service | if you make the functionality of the program or a modified version available to third parties as a service
busl | 1.1 | text | licensor | the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non production use of the licensed work
elastic | 2.0 | text | hosted | you may not provide the software to third parties as a hosted or managed service
commons-clause | | text | to sell | the license does not include,? and the license does not grant (?:to )?you,? the right to sell the software
proprietary | | text | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | | text | unauthori | unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|program|document)[\w ,]{0,40} is (?:strictly )?prohibited
apache | {v} | notice | apache | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?(?:licen[sc]e,? ?)?{v}
apache | | notice | apache | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[sc]e
mit | | notice | mit | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mit(?:/x11)?(?: licen[sc]e)?
mit | | notice | mit | mit licen[sc]ed
bsd | | notice | bsd | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the |a )?(?:new |modified |simplified )?bsd(?: style)?(?: licen[sc]e)?
bsd | | notice | bsd | bsd licen[sc]ed
gpl | {v} | notice | gpl | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl,? ?{v}
gpl | | notice | gpl | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl | {v} | notice | general public | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e,? ?(?:\(gpl\),? ?)?{v}
gpl | | notice | general public | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e
lgpl | {v} | notice | general public | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e,? ?{v}
lgpl | | notice | general public | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e
agpl | {v} | notice | affero | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[sc]e,? ?{v}
cc-by | {v} | notice | cc by | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?cc by(?: licen[sc]e)?,? ?{v}
cc-by | | notice | cc by | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?cc by
cc-by-sa | {v} | notice | cc by | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?cc by sa(?: licen[sc]e)?,? ?{v}
cc-by-sa | | notice | cc by | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?cc by sa
cc-by-nc | {v} | notice | cc by | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?cc by nc(?: licen[sc]e)?,? ?{v}
cc-by-nc | | notice | cc by | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?cc by nc
mpl | {v} | notice | mozilla | (?:licen[sc]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e,? ?{v}
public-domain | | notice | public domain | (?:released|dedicated|placed|put) (?:in|into|to) the public domain
public-domain | | notice | public domain | (?:this (?:work|file|software|text|code) is|is hereby) in the public domain
gpl | 3 | url | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-3\.0(?:\.[a-z-]+)*
gpl | 2 | url | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.[a-z-]+)*
gpl | | url | gnu.org | gnu\.org/(?:licenses|copyleft)/gpl(?:\.[a-z-]+)*
lgpl | 2.1 | url | gnu.org | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.[a-z-]+)*
lgpl | 3 | url | gnu.org | gnu\.org/licenses/lgpl-3\.0(?:\.[a-z-]+)*
lgpl | | url | gnu.org | gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)(?:\.[a-z-]+)*
agpl | 3 | url | gnu.org | gnu\.org/licenses/agpl(?:-3\.0)?(?:\.[a-z-]+)*
gfdl | | url | gnu.org | gnu\.org/(?:licenses|copyleft)/fdl(?:-1\.[123])?(?:\.[a-z-]+)*
apache | 2.0 | url | apache.org | apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
apache | 1.1 | url | apache.org | apache\.org/licenses/license-1\.1(?:\.txt)?
mit | | url | opensource.org | opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
bsd | 2-clause | url | opensource.org | opensource\.org/licenses?/bsd-2-clause
bsd | 3-clause | url | opensource.org | opensource\.org/licenses?/bsd-3-clause
bsd | | url | opensource.org | opensource\.org/licenses?/bsd-license(?:\.php)?
isc | | url | opensource.org | opensource\.org/licenses?/isc(?:-license)?(?:\.txt)?
zlib | | url | opensource.org | opensource\.org/licenses?/zlib
apache | 2.0 | url | opensource.org | opensource\.org/licenses?/apache-2\.0
gpl | | url | opensource.org | opensource\.org/licenses?/gpl(?:-[23]\.0|-license)?
mpl | 2.0 | url | mozilla.org | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl | 1.1 | url | mozilla.org | mozilla\.org/mpl/(?:mpl-)?1\.1
epl | 1.0 | url | eclipse.org | eclipse\.org/(?:legal|org/documents)/epl-v10(?:\.html)?
epl | 2.0 | url | eclipse.org | eclipse\.org/legal/epl-(?:2\.0|v20)(?:\.html)?
boost | 1.0 | url | boost.org | boost\.org/license_1_0(?:\.txt)?
unlicense | | url | unlicense.org | unlicense\.org
wtfpl | 2 | url | wtfpl.net | wtfpl\.net
ofl | 1.1 | url | sil.org | scripts\.sil\.org/ofl
odbl | 1.0 | url | opendatacommons | opendatacommons\.org/licenses/odbl(?:/1[.-]0)?
odc-by | 1.0 | url | opendatacommons | opendatacommons\.org/licenses/by(?:/1[.-]0)?
pddl | 1.0 | url | opendatacommons | opendatacommons\.org/licenses/pddl(?:/1[.-]0)?
cc-by | {n} | url | creativecommons | creativecommons\.org/licenses/by(?:/{n})?
cc-by-sa | {n} | url | creativecommons | creativecommons\.org/licenses/by-sa(?:/{n})?
cc-by-nc | {n} | url | creativecommons | creativecommons\.org/licenses/by-nc(?:/{n})?
cc-by-nd | {n} | url | creativecommons | creativecommons\.org/licenses/by-nd(?:/{n})?
cc-by-nc-sa | {n} | url | creativecommons | creativecommons\.org/licenses/by-nc-sa(?:/{n})?
cc-by-nc-nd | {n} | url | creativecommons | creativecommons\.org/licenses/by-nc-nd(?:/{n})?
cc0 | 1.0 | url | creativecommons | creativecommons\.org/publicdomain/zero(?:/1\.0)?
public-domain | | url | creativecommons | creativecommons\.org/publicdomain/mark(?:/1\.0)?
gpl | {v} | named | general public | (?:gnu )?general public licen[sc]e,? ?(?:\(gpl\),? ?)?{v}
gpl | {v} | named | gpl | (?:gnu )?gpl,? ?{v}
lgpl | {v} | named | general public | (?:gnu )?(?:lesser|library) general public licen[sc]e,? ?{v}
lgpl | {v} | named | lgpl | (?:gnu )?lgpl,? ?{v}
agpl | {v} | named | affero | (?:gnu )?affero general public licen[sc]e,? ?{v}
agpl | {v} | named | agpl | (?:gnu )?agpl,? ?{v}
gfdl | {v} | named | documentation | (?:gnu )?free documentation licen[sc]e,? ?{v}
apache | {v} | named | apache | apache (?:software )?licen[sc]e,? ?{v}
mpl | {v} | named | mozilla | mozilla public licen[sc]e,? ?{v}
epl | {v} | named | eclipse | eclipse public licen[sc]e,? ?{v}
cddl | {v} | named | distribution | common development and distribution licen[sc]e,? ?{v}
eupl | {v} | named | european union | european union public licen[sc]e,? ?{v}
boost | {v} | named | boost | boost software licen[sc]e,? ?{v}
artistic | {v} | named | artistic | artistic licen[sc]e,? ?{v}
ofl | {v} | named | font | sil open font licen[sc]e,? ?{v}
cc-by | {v} | named | commons attribution | creative commons attribution,? ?{v}
cc-by | {v} | named | cc by | cc by(?: licen[sc]e)?,? ?{v}
cc-by-sa | {v} | named | commons attribution | creative commons attribution share ?alike,? ?{v}
cc-by-sa | {v} | named | cc by | cc by sa(?: licen[sc]e)?,? ?{v}
cc-by-nc | {v} | named | commons attribution | creative commons attribution non ?commercial,? ?{v}
cc-by-nc | {v} | named | cc by | cc by nc(?: licen[sc]e)?,? ?{v}
cc-by-nd | {v} | named | commons attribution | creative commons attribution no ?deriv(?:ative)?s?,? ?{v}
cc-by-nd | {v} | named | cc by | cc by nd(?: licen[sc]e)?,? ?{v}
cc-by-nc-sa | {v} | named | commons attribution | creative commons attribution non ?commercial share ?alike,? ?{v}
cc-by-nc-sa | {v} | named | cc by | cc by nc sa(?: licen[sc]e)?,? ?{v}
cc-by-nc-nd | {v} | named | commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?,? ?{v}
cc-by-nc-nd | {v} | named | cc by | cc by nc nd(?: licen[sc]e)?,? ?{v}
cc0 | {v} | named | cc0 | cc0,? ?{v}
gpl | | name | general public | (?:gnu )?general public licen[sc]e
gpl | | name | gpl | (?:gnu )?gpl
lgpl | | name | general public | (?:gnu )?(?:lesser|library) general public licen[sc]e
lgpl | | name | lgpl | (?:gnu )?lgpl
lgpl | | name | gpl | (?:gnu )?(?:lesser|library) gpl
agpl | | name | affero | (?:gnu )?affero (?:general public licen[sc]e|gpl)
agpl | | name | agpl | (?:gnu )?agpl
gfdl | | name | documentation | (?:gnu )?free documentation licen[sc]e
apache | | name | apache | apache (?:software )?licen[sc]e
mit | | name | mit | mit(?:/x11)? licen[sc]e
bsd | | name | bsd | (?:new |modified |simplified |original )?bsd(?: style)? licen[sc]e
bsd | 2-clause | name | bsd | (?:2|two) clause bsd licen[sc]e
bsd | 3-clause | name | bsd | (?:3|three) clause bsd licen[sc]e
bsd | 2-clause | name | bsd | bsd (?:2|two) clause licen[sc]e
bsd | 3-clause | name | bsd | bsd (?:3|three) clause licen[sc]e
bsd | 4-clause | name | bsd | bsd (?:4|four) clause licen[sc]e
mpl | | name | mozilla | mozilla public licen[sc]e
epl | | name | eclipse | eclipse public licen[sc]e
cddl | | name | distribution | common development and distribution licen[sc]e
cpl | | name | common public | common public licen[sc]e
eupl | | name | european union | european union public licen[sc]e
isc | | name | isc | isc licen[sc]e
zlib | | name | zlib | zlib(?:/libpng)? licen[sc]e
boost | | name | boost | boost software licen[sc]e
artistic | | name | artistic | artistic licen[sc]e
unlicense | | name | unlicense | the unlicense
wtfpl | | name | fuck | do what the fuck you want to public licen[sc]e
ofl | | name | font | (?:sil )?open font licen[sc]e
odbl | | name | open database | open database licen[sc]e
psf | | name | python | python software foundation licen[sc]e
php | | name | php | php licen[sc]e
ruby | | name | ruby | ruby licen[sc]e
postgresql | | name | postgresql | postgresql licen[sc]e
upl | | name | universal permissive | universal permissive licen[sc]e
ms-pl | | name | microsoft | microsoft public licen[sc]e
ms-rl | | name | microsoft | microsoft reciprocal licen[sc]e
afl | | name | academic free | academic free licen[sc]e
osl | | name | open software | open software licen[sc]e
ncsa | | name | ncsa | (?:university of illinois/)?ncsa open source licen[sc]e
lppl | | name | latex | latex project public licen[sc]e
cecill | | name | cecill | cecill(?: free software)? licen[sc]e
sspl | | name | server side | server side public licen[sc]e
busl | | name | business source | business source licen[sc]e
elastic | | name | elastic | elastic licen[sc]e
commons-clause | | name | commons clause | commons clause
cc-by | | name | cc by | cc by
cc-by | | name | commons attribution | creative commons attribution
cc-by-sa | | name | cc by | cc by sa
cc-by-sa | | name | commons attribution | creative commons attribution share ?alike
cc-by-nc | | name | cc by | cc by nc
cc-by-nc | | name | commons attribution | creative commons attribution non ?commercial
cc-by-nd | | name | cc by | cc by nd
cc-by-nd | | name | commons attribution | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
cc-by-nc-sa | | name | cc by | cc by nc sa
cc-by-nc-sa | | name | commons attribution | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | | name | cc by | cc by nc nd
cc-by-nc-nd | | name | commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc0 | | name | cc0 | cc0
cc0 | | name | commons zero | creative commons zero
proprietary | | name | rights reserved | all rights reserved
"""
