"""Signature rules of the license scan: one hand-written regular expression a line.

A line is ``priority label keyword: expression``.  Expressions read normalised words
(lower case, one blank between words, punctuation gone: "2.0" is "2 0"); the keyword
is a word that every match holds.  Lines stand in order: of two detections of one
interval and priority the first line's stays.  Priorities: 1 machine-readable tags,
2 titles with a version and whole notices, 3 addresses, 4 names, 5 general remarks.

Shorthands: <v> an optional "version" or "v" before a number, <l> licence or license,
<0> an optional minor zero, <..> up to four other words.
"""

from __future__ import annotations

SHORT = {"<v>": r"(?:(?:version|ver|v) )?v?", "<l>": r"licen[cs]e", "<0>": r"(?: 0)?", "<..>": r"(?:\S+ ){0,4}?"}

#: Phrases and labels that a scan always counts, whatever else covers them.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

RULES = r"""
1 spdx-mit spdx: spdx <l> identifier mit
1 spdx-apache-2.0 spdx: spdx <l> identifier apache 2 0
1 spdx-gpl-2.0-only spdx: spdx <l> identifier gpl 2 0(?: only)?
1 spdx-gpl-2.0-or-later spdx: spdx <l> identifier gpl 2 0 or later
1 spdx-gpl-3.0-only spdx: spdx <l> identifier gpl 3 0(?: only)?
1 spdx-gpl-3.0-or-later spdx: spdx <l> identifier gpl 3 0 or later
1 spdx-lgpl-2.1 spdx: spdx <l> identifier lgpl 2 1(?: only| or later)?
1 spdx-lgpl-3.0 spdx: spdx <l> identifier lgpl 3 0(?: only| or later)?
1 spdx-agpl-3.0 spdx: spdx <l> identifier agpl 3 0(?: only| or later)?
1 spdx-mpl-2.0 spdx: spdx <l> identifier mpl 2 0
1 spdx-epl-2.0 spdx: spdx <l> identifier epl 2 0
1 spdx-eupl-1.2 spdx: spdx <l> identifier eupl 1 2
1 spdx-bsd-2-clause spdx: spdx <l> identifier bsd 2 clause
1 spdx-bsd-3-clause spdx: spdx <l> identifier bsd 3 clause
1 spdx-isc spdx: spdx <l> identifier isc
1 spdx-zlib spdx: spdx <l> identifier zlib
1 spdx-bsl-1.0 spdx: spdx <l> identifier bsl 1 0
1 spdx-unlicense spdx: spdx <l> identifier unlicense
1 spdx-0bsd spdx: spdx <l> identifier 0bsd
1 spdx-cc0-1.0 spdx: spdx <l> identifier cc0 1 0
1 spdx-cc-by spdx: spdx <l> identifier cc by \d \d
1 spdx-cc-by-sa spdx: spdx <l> identifier cc by sa \d \d
1 spdx-cc-by-nc spdx: spdx <l> identifier cc by nc(?: sa| nd)? \d \d
1 spdx-ofl-1.1 spdx: spdx <l> identifier ofl 1 1
1 spdx-wtfpl spdx: spdx <l> identifier wtfpl
1 spdx-psf-2.0 spdx: spdx <l> identifier (?:psf|python) 2 0
1 spdx-artistic-2.0 spdx: spdx <l> identifier artistic 2 0
1 spdx-other spdx: spdx <l> identifier \S+(?: \d)*
2 apache-2.0 apache: apache <l> <v>2<0>
2 apache-2.0 apache: apache software <l> <v>2<0>
2 apache-1.1 apache: apache (?:software )?<l> <v>1 1
2 apache-1.0 apache: apache (?:software )?<l> <v>1 0
2 apache-2.0 warranties: distributed on an as is basis without warranties or conditions of any kind
2 apache-2.0 compliance: you may not use this file except in compliance with the <l>
2 apache-2.0 perpetual: perpetual worldwide non exclusive no charge royalty free irrevocable copyright <l>
3 apache-2.0 apache: (?:www )?apache org <l>s <l> 2 0(?: txt| html)?
3 apache-2.0 apache: opensource org <l>s apache 2 0
4 apache apache: (?:the )?apache(?: software)? <l>
4 apache apache: apache licensed
4 apache-2.0 apache: apache 2 0
2 mit mit: released under the (?:terms of the )?mit <l>
2 mit mit: licensed under the (?:terms of the )?mit <l>
2 mit mit: distributed under the (?:terms of the )?mit <l>
2 mit granted: permission is hereby granted free of charge to any person obtaining a copy of this software
2 mit sublicense: (?:without limitation )?the rights to use copy modify merge publish distribute sublicense and or sell copies
2 mit noninfringement: merchantability fitness for a particular purpose and noninfringement
3 mit mit: opensource org <l>s mit(?: <l>)?(?: php| html)?
3 mit mit: mit <l> org
4 mit mit: (?:the )?mit <l>
4 mit mit: mit licensed
4 mit-0 attribution: mit no attribution
4 mit expat: expat <l>
4 x11 x11: (?:the )?(?:mit )?x11 <l>
4 x11 consortium: x consortium <l>
2 gpl-1.0 gnu: gnu general public <l> <v>1<0>
2 gpl-2.0 gnu: gnu general public <l>(?: gpl)? <v>2<0>
2 gpl-3.0 gnu: gnu general public <l>(?: gpl)? <v>3<0>
2 gpl-2.0-or-later gnu: gnu general public <l> <..>either version 2 of the <l> or (?:at your option )?any later version
2 gpl-3.0-or-later gnu: gnu general public <l> <..>either version 3 of the <l> or (?:at your option )?any later version
2 gpl-2.0-or-later later: version 2 of the <l> or (?:at your option )?any later version
2 gpl-3.0-or-later later: version 3 of the <l> or (?:at your option )?any later version
2 gpl received: you should have received a copy of the gnu general public <l>
2 gpl redistribute: you can redistribute it and or modify it under the terms of the gnu general public <l>
2 gpl-classpath classpath: gnu general public <l> <..>with (?:the )?classpath exception
2 gpl-classpath linking: linking this library statically or dynamically with other modules
2 gpl-2.0 gplv2: gplv2(?: 0)?
2 gpl-3.0 gplv3: gplv3(?: 0)?
2 gpl-2.0 gpl: gpl <v>2<0>
2 gpl-3.0 gpl: gpl <v>3<0>
2 gpl-2.0-or-later gpl: gpl <v>2<0> (?:or later|or any later version|plus)
2 gpl-3.0-or-later gpl: gpl <v>3<0> (?:or later|or any later version|plus)
3 gpl gnu: (?:www )?gnu org (?:copyleft|<l>s) gpl(?: \d \d)?(?: html| txt)?
3 gpl-2.0 gnu: (?:www )?gnu org <l>s (?:old <l>s )?gpl 2 0(?: html| txt)?
3 gpl-3.0 gnu: (?:www )?gnu org <l>s gpl 3 0(?: html| txt)?
3 gpl gpl: opensource org <l>s gpl <l>
4 gpl gnu: gnu general public <l>
4 gpl gnu: gnu gpl
4 gpl gpl: (?:the )?gpl <l>
4 gpl gpl: gpl licensed
2 lgpl-2.0 lesser: gnu (?:library|lesser) general public <l> <v>2<0>
2 lgpl-2.1 lesser: gnu lesser general public <l> <v>2 1
2 lgpl-3.0 lesser: gnu lesser general public <l> <v>3<0>
2 lgpl received: you should have received a copy of the gnu (?:lesser|library) general public <l>
2 lgpl-2.1 lgplv2: lgplv2(?: 1)?
2 lgpl-3.0 lgplv3: lgplv3(?: 0)?
2 lgpl-2.1 lgpl: lgpl <v>2 1
2 lgpl-3.0 lgpl: lgpl <v>3<0>
3 lgpl lgpl: (?:www )?gnu org (?:copyleft lesser|<l>s lgpl)(?: \d \d)?(?: html| txt)?
4 lgpl lesser: gnu lesser general public <l>
4 lgpl library: gnu library general public <l>
4 lgpl lgpl: (?:gnu )?lgpl(?: <l>)?
2 agpl-3.0 affero: (?:gnu )?affero general public <l> <v>3<0>
2 agpl-1.0 affero: affero general public <l> <v>1<0>
2 agpl-3.0 agplv3: (?:gnu )?agplv3(?: 0)?
2 agpl-3.0 agpl: agpl <v>3<0>
3 agpl agpl: (?:www )?gnu org <l>s agpl(?: \d \d)?(?: html| txt)?
4 agpl affero: (?:gnu )?affero general public <l>
4 agpl agpl: (?:gnu )?agpl(?: <l>)?
2 gfdl-1.3 documentation: gnu free documentation <l> <v>1 3
2 gfdl-1.2 documentation: gnu free documentation <l> <v>1 2
2 gfdl-1.1 documentation: gnu free documentation <l> <v>1 1
2 gfdl invariant: with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
4 gfdl documentation: gnu free documentation <l>
4 gfdl gfdl: gfdl
2 bsd-2-clause bsd: (?:2|two) clause bsd(?: <l>)?
2 bsd-2-clause bsd: bsd (?:2|two) clause(?: <l>)?
2 bsd-2-clause bsd: simplified bsd <l>
2 bsd-3-clause bsd: (?:3|three) clause bsd(?: <l>)?
2 bsd-3-clause bsd: bsd (?:3|three) clause(?: <l>)?
2 bsd-3-clause bsd: (?:new|modified|revised) bsd(?: style)? <l>
2 bsd-4-clause bsd: (?:4|four) clause bsd(?: <l>)?
2 bsd-4-clause bsd: bsd (?:4|four) clause(?: <l>)?
2 bsd-4-clause bsd: original bsd <l>
2 bsd-4-clause advertising: all advertising materials mentioning features or use of this software must display
2 0bsd bsd: (?:zero clause bsd|bsd (?:0|zero) clause)(?: <l>)?
2 bsd-2-clause redistribution: redistribution and use in source and binary forms with or without modification are permitted
2 bsd-3-clause endorse: may be used to endorse or promote products derived from this software without specific prior written permission
2 bsd retain: redistributions of source code must retain the above copyright notice
2 bsd reproduce: redistributions in binary form must reproduce the above copyright notice
3 bsd-3-clause bsd: opensource org <l>s bsd 3 clause
3 bsd-2-clause bsd: opensource org <l>s bsd 2 clause
4 bsd bsd: (?:the )?bsd(?: style| type| like)? <l>
4 bsd bsd: bsd licensed
4 0bsd 0bsd: 0bsd
4 freebsd freebsd: freebsd (?:documentation )?<l>
2 mpl-1.0 mozilla: mozilla public <l> <v>1 0
2 mpl-1.1 mozilla: mozilla public <l> <v>1 1
2 mpl-2.0 mozilla: mozilla public <l> <v>2<0>
2 mpl-2.0 mpl: this source code form is subject to the terms of the mozilla public <l> v 2 0 if a copy of the mpl was not distributed
2 mpl-1.1 mpl: mpl <v>1 1
2 mpl-2.0 mpl: mpl <v>2<0>
3 mpl-2.0 mozilla: (?:www )?mozilla org (?:en us )?mpl 2 0
3 mpl-2.0 mozilla: mozilla org mpl 2 0
4 mpl mozilla: mozilla public <l>
4 npl netscape: netscape public <l>
2 epl-1.0 eclipse: eclipse public <l> <v>1<0>
2 epl-2.0 eclipse: eclipse public <l> <v>2<0>
2 edl-1.0 eclipse: eclipse distribution <l> <v>1<0>
3 epl eclipse: (?:www )?eclipse org legal epl (?:v10|v20|2 0)(?: html)?
4 epl eclipse: eclipse public <l>
2 cddl-1.0 development: common development and distribution <l> <v>1<0>
2 cddl-1.1 development: common development and distribution <l> <v>1 1
4 cddl development: common development and distribution <l>
4 cddl cddl: cddl(?: \d \d)?
2 cpl-1.0 common: common public <l> <v>1<0>
4 cpl common: common public <l>
4 cpal attribution: common public attribution <l>(?: version)?(?: 1 0)?
2 eupl-1.1 european: european union public <l> <v>1 1
2 eupl-1.2 european: european union public <l> <v>1 2
4 eupl european: european union public <l>
4 eupl eupl: eupl(?: v?\d \d)?
2 cc-by-1.0 cc: cc by 1 0
2 cc-by-2.0 cc: cc by 2 0
2 cc-by-2.5 cc: cc by 2 5
2 cc-by-3.0 cc: cc by 3 0
2 cc-by-4.0 cc: cc by 4 0
2 cc-by-sa-3.0 cc: cc by sa 3 0
2 cc-by-sa-4.0 cc: cc by sa 4 0
2 cc-by-sa cc: cc by sa
2 cc-by-nc-2.0 cc: cc by nc 2 0
2 cc-by-nc-3.0 cc: cc by nc 3 0
2 cc-by-nc-4.0 cc: cc by nc 4 0
2 cc-by-nc cc: cc by nc
2 cc-by-nd-4.0 cc: cc by nd 4 0
2 cc-by-nd cc: cc by nd
2 cc-by-nc-sa-4.0 cc: cc by nc sa 4 0
2 cc-by-nc-sa cc: cc by nc sa
2 cc-by-nc-nd-4.0 cc: cc by nc nd 4 0
2 cc-by-nc-nd cc: cc by nc nd
2 cc-by-4.0 commons: creative commons attribution 4 0(?: international)?(?: public)?(?: <l>)?
2 cc-by-3.0 commons: creative commons attribution 3 0(?: unported)?(?: <l>)?
2 cc-by-sa-4.0 commons: creative commons attribution share ?alike 4 0(?: international)?(?: <l>)?
2 cc-by-sa-3.0 commons: creative commons attribution share ?alike 3 0(?: unported)?(?: <l>)?
2 cc-by-nc-4.0 commons: creative commons attribution non ?commercial 4 0(?: international)?(?: <l>)?
2 cc-by-nc-sa-4.0 commons: creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: <l>)?
2 cc-by-nc-nd-4.0 commons: creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: <l>)?
2 cc-by-nd-4.0 commons: creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: <l>)?
2 cc-by-sa commons: creative commons attribution share ?alike
2 cc-by-nc commons: creative commons attribution non ?commercial
2 cc-by-nd commons: creative commons attribution no ?deriv(?:ative)?s
3 cc-by creativecommons: creativecommons org <l>s by \d \d
3 cc-by-sa creativecommons: creativecommons org <l>s by sa \d \d
3 cc-by-nc creativecommons: creativecommons org <l>s by nc \d \d
3 cc-by-nd creativecommons: creativecommons org <l>s by nd \d \d
3 cc-by-nc-sa creativecommons: creativecommons org <l>s by nc sa \d \d
3 cc-by-nc-nd creativecommons: creativecommons org <l>s by nc nd \d \d
3 cc0-1.0 creativecommons: creativecommons org publicdomain zero 1 0
3 public-domain creativecommons: creativecommons org publicdomain mark 1 0
2 cc0-1.0 cc0: cc0 1 0(?: universal)?
4 cc0 cc0: cc0
4 cc-by attribution: creative commons attribution(?: <l>)?
4 cc commons: creative commons(?: <l>)?
2 isc granted: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc isc: (?:the )?isc <l>
2 zlib zlib: zlib(?: libpng)? <l>
2 zlib altered: altered source versions must be plainly marked as such
2 libpng libpng: libpng <l>
2 bsl-1.0 boost: boost software <l>(?: <v>1<0>)?
3 bsl-1.0 boost: (?:www )?boost org license 1 0 txt
2 unlicense unencumbered: this is free and unencumbered software released into the public domain
3 unlicense unlicense: (?:www )?unlicense org
4 unlicense unlicense: (?:the )?unlicense
2 wtfpl wtfpl: (?:the )?wtfpl(?: version 2)?
2 ofl-1.1 ofl: (?:sil )?ofl <v>1 1
2 ofl-1.1 sil: sil open font <l>(?: <v>1 1)?
4 ofl font: open font <l>
2 psf-2.0 python: python software foundation <l>(?: <v>2)?
4 psf psf: psf <l>(?: agreement)?
4 python python: python <l>
2 artistic-1.0 artistic: artistic <l> <v>1<0>
2 artistic-2.0 artistic: artistic <l> <v>2<0>
4 artistic artistic: (?:the )?(?:perl )?artistic <l>
4 perl perl: (?:under )?the same terms as perl(?: itself)?
4 php php: php <l>(?: <v>\d(?: \d+)?)?
4 ruby ruby: ruby <l>
4 ruby ruby: ruby s <l>
4 openssl openssl: openssl(?: ssleay)? <l>
4 postgresql postgresql: postgresql <l>
4 ncsa ncsa: (?:university of illinois )?(?:uiuc )?ncsa(?: open source)? <l>
4 ms-pl microsoft: microsoft public <l>
4 ms-rl microsoft: microsoft reciprocal <l>
4 osl-3.0 open: open software <l>(?: <v>3 0)?
4 afl-3.0 academic: academic free <l>(?: <v>3 0)?
4 upl-1.0 universal: universal permissive <l>(?: <v>1 0)?
4 qpl qt: qt public <l>
4 qpl q: q public <l>
4 ibm-pl ibm: ibm public <l>
4 sleepycat sleepycat: sleepycat <l>
4 vim vim: vim <l>
4 w3c w3c: w3c (?:software (?:notice and )?)?(?:document )?<l>
4 odbl odbl: odbl(?: v?1 0)?
4 odbl database: open database <l>
4 odc-by commons: open data commons attribution <l>
4 pddl commons: open data commons public domain dedication(?: and <l>)?
4 ogl government: open government <l>(?: <v>\d(?: \d)?)?
2 busl-1.1 business: business source <l>(?: <v>1 1)?
2 sspl-1.0 server: server side public <l>(?: <v>1)?
2 elastic-2.0 elastic: elastic <l>(?: <v>2 0)?
2 commons-clause clause: commons clause(?: <l>)?(?: condition)?
2 polyform polyform: polyform (?:noncommercial|small business|shield|perimeter|strict|internal use)(?: <l>)?
2 llama meta: meta llama \S+(?: \d)? community <l>
2 openrail rail: (?:creativeml )?open rail(?: m)?(?: <l>)?
2 openrail openrail: (?:bigscience |creativeml )?openrail(?: m)?(?: <l>)?
2 hippocratic hippocratic: hippocratic <l>(?: <v>\d(?: \d)?)?
2 json evil: the software shall be used for good not evil
2 beerware beer: the beer ware <l>
4 proprietary proprietary: (?:proprietary and confidential|confidential and proprietary)
4 proprietary proprietary: (?:this is )?proprietary software
4 proprietary unauthorized: unauthorized (?:copying|use|distribution|reproduction) (?:\S+ ){0,6}?(?:is )?(?:strictly )?prohibited
4 proprietary reproduced: no part of this (?:publication|work|book|document) may be reproduced
4 proprietary eula: end user <l> agreement eula
4 proprietary agreement: end user <l> agreement
4 public-domain domain: (?:released|placed|dedicated) (?:in|into|to) the public domain
4 public-domain domain: this (?:work|file|software|text) is in the public domain
4 noncommercial commercial: for non ?commercial (?:use|purposes) only
4 noncommercial commercial: not for commercial use
4 noncommercial noncommercial: for noncommercial (?:use|purposes) only
4 evaluation evaluation: for evaluation (?:use|purposes) only
5 copyright copyright: copyright (?:c )?\d{4}(?: \d{4})?
5 copyright copyright: copyright (?:c )?by \S+
5 copyright copyrighted: copyrighted (?:material|work|by)
5 reserved reserved: (?:some|no) rights reserved
5 licensed licensed: (?:is |are )?licensed under(?: the)?
5 licensed released: released under (?:the )?(?:terms of )?(?:the )?\S+ <l>
5 licensed distributed: distributed under (?:the )?(?:terms of )?(?:the )?\S+ <l>
5 licensed license: see (?:the )?license(?: file| txt| md)? for (?:more )?(?:details|information)
5 licensed license: see (?:the )?(?:file )?license(?: txt| md)
5 licensed license: subject to the terms (?:and conditions )?of (?:the|this) license
5 dual-licensed dual: dual licen[cs]ed
5 permission permission: (?:used|reprinted|reproduced) (?:with|by) permission
5 trademark trademark: (?:registered )?trademark of
"""


def rules(text: str = RULES) -> list[tuple[str, str, str, int, int]]:
    """(keyword, expression, label, priority, place) of each line, in order."""
    out = []
    for line in text.strip().splitlines():
        head, expression = line.split(": ", 1)
        priority, label, keyword = head.split(" ")
        for short, long in SHORT.items():
            expression = expression.replace(short, long)
        out.append((keyword, rf"(?<= )(?:{expression})(?= )", label, int(priority), len(out)))
    return out
