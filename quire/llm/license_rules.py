"""Signature rules for licence scans, over text as lower-case words with one space between.

A rule is (priority, label, keywords, regex): the regex is tried only where one of the keywords occurs. Keywords are
read off the regex, so that each of its matches contains one. Priorities: 4 a machine readable tag, 3 a link or a passage
of the licence itself, 2 the licence's name, 1 a general mention. The first four tables are written out by hand; tag,
link and Creative Commons forms follow from the tables by rule.
"""

from __future__ import annotations

import functools
import re._constants as sre
import re._parser as parser

TAG, PASSAGE, NAME, MENTION = 4, 3, 2, 1
WEIGHTS = {TAG: 0.99, PASSAGE: 0.95, NAME: 0.9, MENTION: 0.6}

V = r"(?:version |v ?)?"
LIC = r"(?: public| software| open source)? licen[sc]e"

# Label, identifier in tags as words, and how the name is written in running text.
NAMES = [
    ("mit", "mit", r"(?:mit|expat)(?: x11)?" + LIC),
    ("mit-0", "mit 0", r"mit no attribution"),
    ("apache-1.0", "apache 1 0", r"apache(?: software)? licen[sc]e " + V + "1 0"),
    ("apache-1.1", "apache 1 1", r"apache(?: software)? licen[sc]e " + V + "1 1"),
    ("apache-2.0", "apache 2 0", r"apache(?:(?: software)? licen[sc]e " + V + "2(?: 0)?| 2 0 licen[sc]e)"),
    ("bsd-2-clause", "bsd 2 clause", r"(?:bsd 2 clause|simplified bsd|freebsd)" + LIC),
    ("bsd-3-clause", "bsd 3 clause", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd)" + LIC),
    ("bsd-4-clause", "bsd 4 clause", r"(?:bsd 4 clause|original bsd|old bsd)" + LIC),
    ("0bsd", "0bsd", r"(?:bsd zero clause|zero clause bsd)" + LIC),
    ("gpl-1.0", "gpl 1 0", r"(?:gnu )?(?:general public licen[sc]e|gpl) " + V + "1(?: 0)?"),
    ("gpl-2.0", "gpl 2 0", r"(?:gnu )?(?:general public licen[sc]e|gpl) " + V + "2(?: 0)?"),
    ("gpl-3.0", "gpl 3 0", r"(?:gnu )?(?:general public licen[sc]e|gpl) " + V + "3(?: 0)?"),
    ("lgpl-2.0", "lgpl 2 0", r"(?:gnu )?(?:library general public licen[sc]e|lgpl) " + V + "2(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) " + V + "2 1"),
    ("lgpl-3.0", "lgpl 3 0", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl) " + V + "3(?: 0)?"),
    ("agpl-1.0", "agpl 1 0", r"affero general public licen[sc]e " + V + "1(?: 0)?"),
    ("agpl-3.0", "agpl 3 0", r"(?:gnu )?(?:affero general public licen[sc]e|agpl) " + V + "3(?: 0)?"),
    ("gfdl-1.1", "gfdl 1 1", r"(?:gnu )?free documentation licen[sc]e " + V + "1 1"),
    ("gfdl-1.2", "gfdl 1 2", r"(?:gnu )?free documentation licen[sc]e " + V + "1 2"),
    ("gfdl-1.3", "gfdl 1 3", r"(?:gnu )?free documentation licen[sc]e " + V + "1 3"),
    ("mpl-1.0", "mpl 1 0", r"mozilla public licen[sc]e " + V + "1 0"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public licen[sc]e " + V + "1 1"),
    ("mpl-2.0", "mpl 2 0", r"mozilla public licen[sc]e " + V + "2(?: 0)?"),
    ("epl-1.0", "epl 1 0", r"eclipse public licen[sc]e " + V + "1(?: 0)?"),
    ("epl-2.0", "epl 2 0", r"eclipse public licen[sc]e " + V + "2(?: 0)?"),
    ("cddl-1.0", "cddl 1 0", r"common development and distribution licen[sc]e " + V + "1 0"),
    ("cddl-1.1", "cddl 1 1", r"common development and distribution licen[sc]e " + V + "1 1"),
    ("cpl-1.0", "cpl 1 0", r"common public licen[sc]e(?: " + V + "1 0)?"),
    ("isc", "isc", r"isc" + LIC),
    ("zlib", "zlib", r"zlib(?: libpng)?" + LIC),
    ("libpng", "libpng", r"(?:png reference library|libpng)" + LIC),
    ("unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "wtfpl", r"do what the f[^ ]* you want to public licen[sc]e"),
    ("artistic-1.0", "artistic 1 0", r"artistic licen[sc]e(?: " + V + "1 0)?"),
    ("artistic-2.0", "artistic 2 0", r"artistic licen[sc]e " + V + "2 0"),
    ("bsl-1.0", "bsl 1 0", r"boost software licen[sc]e(?: " + V + "1 0)?"),
    ("afl-3.0", "afl 3 0", r"academic free licen[sc]e(?: " + V + "3 0)?"),
    ("osl-3.0", "osl 3 0", r"open software licen[sc]e(?: " + V + "3 0)?"),
    ("eupl-1.1", "eupl 1 1", r"european union public licen[sc]e " + V + "1 1"),
    ("eupl-1.2", "eupl 1 2", r"european union public licen[sc]e " + V + "1 2"),
    ("odbl-1.0", "odbl 1 0", r"open (?:data commons open )?database licen[sc]e"),
    ("odc-by-1.0", "odc by 1 0", r"open data commons attribution licen[sc]e"),
    ("pddl-1.0", "pddl 1 0", r"public domain dedication and licen[sc]e"),
    ("ofl-1.0", "ofl 1 0", r"(?:sil )?open font licen[sc]e " + V + "1 0"),
    ("ofl-1.1", "ofl 1 1", r"(?:sil )?open font licen[sc]e(?: " + V + "1 1)?"),
    ("ms-pl", "ms pl", r"microsoft public licen[sc]e"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[sc]e"),
    ("python-2.0", "python 2 0", r"python(?: software foundation)? licen[sc]e"),
    ("php-3.01", "php 3 01", r"php licen[sc]e(?: " + V + "3(?: 01)?)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("openssl", "openssl", r"openssl(?: ssleay)? licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("w3c", "w3c", r"w3c software(?: notice)?(?: and)? licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("json", "json", r"json licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("beerware", "beerware", r"beer ?ware licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("qpl-1.0", "qpl 1 0", r"q public licen[sc]e"),
    ("ipl-1.0", "ipl 1 0", r"ibm public licen[sc]e"),
    ("apsl-2.0", "apsl 2 0", r"apple public source licen[sc]e"),
    ("upl-1.0", "upl 1 0", r"universal permissive licen[sc]e"),
    ("mulanpsl-2.0", "mulanpsl 2 0", r"mulan psl v?2|mulan permissive software licen[sc]e"),
    ("cecill-2.1", "cecill 2 1", r"cecill(?: free software)? licen[sc]e"),
    ("cecill-b", "cecill b", r"cecill b"),
    ("cecill-c", "cecill c", r"cecill c"),
    ("blueoak-1.0.0", "blueoak 1 0 0", r"blue oak model licen[sc]e"),
    ("busl-1.1", "busl 1 1", r"business source licen[sc]e"),
    ("elastic-2.0", "elastic 2 0", r"elastic licen[sc]e"),
    ("sspl-1.0", "sspl 1 0", r"server side public licen[sc]e"),
    ("parity-7.0.0", "parity 7 0 0", r"parity public licen[sc]e"),
    ("lppl-1.3c", "lppl 1 3c", r"latex project public licen[sc]e"),
    ("openrail", "openrail", r"open ?rail(?: m)? licen[sc]e|responsible ai licen[sc]e"),
    ("hippocratic-2.1", "hippocratic 2 1", r"hippocratic licen[sc]e"),
    ("cc0-1.0", "cc0 1 0", r"(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)?(?: licen[sc]e)?"),
    ("adobe-2006", "adobe 2006", r"adobe systems incorporated(?: open source)? licen[sc]e"),
    ("aladdin", "aladdin", r"aladdin free public licen[sc]e"),
    ("apl-1.0", "apl 1 0", r"adaptive public licen[sc]e"),
    ("apsl-1.0", "apsl 1 0", r"apple public source licen[sc]e " + V + "1 0"),
    ("bittorrent-1.1", "bittorrent 1 1", r"bittorrent open source licen[sc]e"),
    ("borceux", "borceux", r"borceux licen[sc]e"),
    ("cal-1.0", "cal 1 0", r"cryptographic autonomy licen[sc]e"),
    ("catosl-1.1", "catosl 1 1", r"computer associates trusted open source licen[sc]e"),
    ("cdla-permissive", "cdla permissive 2 0", r"community data licen[sc]e agreement permissive"),
    ("cdla-sharing", "cdla sharing 1 0", r"community data licen[sc]e agreement sharing"),
    ("cern-ohl-p", "cern ohl p 2 0", r"cern open hardware licen[sc]e(?: " + V + "2)? permissive"),
    ("cern-ohl-s", "cern ohl s 2 0", r"cern open hardware licen[sc]e(?: " + V + "2)? strongly reciprocal"),
    ("cern-ohl-w", "cern ohl w 2 0", r"cern open hardware licen[sc]e(?: " + V + "2)? weakly reciprocal"),
    ("clartistic", "clartistic", r"clarified artistic licen[sc]e"),
    ("cnri-python", "cnri python", r"cnri (?:open source )?licen[sc]e agreement"),
    ("condor-1.1", "condor 1 1", r"condor public licen[sc]e"),
    ("cpal-1.0", "cpal 1 0", r"common public attribution licen[sc]e"),
    ("cpol-1.02", "cpol 1 02", r"code project open licen[sc]e"),
    ("cua-opl-1.0", "cua opl 1 0", r"cua office public licen[sc]e"),
    ("d-fsl-1.0", "d fsl 1 0", r"deutsche freie software lizenz licen[sc]e"),
    ("ecl-2.0", "ecl 2 0", r"educational community licen[sc]e"),
    ("efl-2.0", "efl 2 0", r"eiffel forum licen[sc]e"),
    ("entessa", "entessa", r"entessa public licen[sc]e"),
    ("etalab-2.0", "etalab 2 0", r"etalab open licen[sc]e"),
    ("eudatagrid", "eudatagrid", r"eu datagrid software licen[sc]e"),
    ("fair", "fair", r"fair licen[sc]e"),
    ("frameworx-1.0", "frameworx 1 0", r"frameworx open licen[sc]e"),
    ("ftl", "ftl", r"freetype(?: project)? licen[sc]e"),
    ("hpnd", "hpnd", r"historical permission notice and disclaimer"),
    ("icu", "icu", r"icu licen[sc]e"),
    ("ijg", "ijg", r"independent jpeg group licen[sc]e"),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"),
    ("intel", "intel", r"intel open source licen[sc]e"),
    ("ipa", "ipa", r"ipa font licen[sc]e"),
    ("jasper-2.0", "jasper 2 0", r"jasper licen[sc]e"),
    ("liliq-p-1.1", "liliq p 1 1", r"licence libre du quebec permissive"),
    ("lpl-1.02", "lpl 1 02", r"lucent public licen[sc]e"),
    ("miros", "miros", r"miros licen[sc]e"),
    ("motosoto", "motosoto", r"motosoto open source licen[sc]e"),
    ("multics", "multics", r"multics licen[sc]e"),
    ("nasa-1.3", "nasa 1 3", r"nasa open source(?: agreement)? licen[sc]e"),
    ("naumen", "naumen", r"naumen public licen[sc]e"),
    ("netcdf", "netcdf", r"netcdf licen[sc]e"),
    ("ngpl", "ngpl", r"nethack general public licen[sc]e"),
    ("nokia", "nokia", r"nokia open source licen[sc]e"),
    ("nosl", "nosl", r"netizen open source licen[sc]e"),
    ("npl-1.1", "npl 1 1", r"netscape public licen[sc]e"),
    ("nposl-3.0", "nposl 3 0", r"non profit open software licen[sc]e"),
    ("ntp", "ntp", r"ntp licen[sc]e"),
    ("oclc-2.0", "oclc 2 0", r"oclc research public licen[sc]e"),
    ("ogc-1.0", "ogc 1 0", r"ogc software licen[sc]e"),
    ("ogl-uk-3.0", "ogl uk 3 0", r"open government licen[sc]e(?: " + V + "3 0)?"),
    ("ogtsl", "ogtsl", r"open group test suite licen[sc]e"),
    ("oldap-2.8", "oldap 2 8", r"openldap public licen[sc]e"),
    ("oset-pl-2.1", "oset pl 2 1", r"oset(?: foundation)? public licen[sc]e"),
    ("polyform-nc-1.0.0", "polyform noncommercial 1 0 0", r"polyform noncommercial licen[sc]e"),
    ("polyform-sb-1.0.0", "polyform small business 1 0 0", r"polyform small business licen[sc]e"),
    ("ppl", "ppl", r"peer production licen[sc]e"),
    ("rpl-1.5", "rpl 1 5", r"reciprocal public licen[sc]e"),
    ("rpsl-1.0", "rpsl 1 0", r"realnetworks public source licen[sc]e"),
    ("rscpl", "rscpl", r"ricoh source code public licen[sc]e"),
    ("sgi-b-2.0", "sgi b 2 0", r"sgi free software licen[sc]e b"),
    ("simpl-2.0", "simpl 2 0", r"simple public licen[sc]e"),
    ("sissl", "sissl", r"sun industry standards source licen[sc]e"),
    ("spl-1.0", "spl 1 0", r"sun public licen[sc]e"),
    ("tcl", "tcl", r"tcl tk licen[sc]e"),
    ("ucl-1.0", "ucl 1 0", r"upstream compatibility licen[sc]e"),
    ("unicode-dfs-2016", "unicode dfs 2016", r"unicode licen[sc]e agreement"),
    ("vsl-1.0", "vsl 1 0", r"vovida software licen[sc]e"),
    ("watcom-1.0", "watcom 1 0", r"sybase open watcom public licen[sc]e"),
    ("wxwindows", "wxwindows", r"wxwindows library licen[sc]e"),
    ("xfree86-1.1", "xfree86 1 1", r"xfree86 licen[sc]e"),
    ("xnet", "xnet", r"x net licen[sc]e"),
    ("yahoo-1.1", "ypl 1 1", r"yahoo public licen[sc]e"),
    ("zend-2.0", "zend 2 0", r"zend(?: engine)? licen[sc]e"),
    ("zimbra-1.3", "zimbra 1 3", r"zimbra public licen[sc]e"),
    ("zpl-2.1", "zpl 2 1", r"zope public licen[sc]e"),
]

# Passages of the licences themselves (label, regex).
PASSAGES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", r"neither the name of(?: [^ ]+){1,12} nor the names of its contributors"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", r"licensed under the apache license version 2 0 the license"),
    ("apache-2.0", r"you may not use this file except in compliance with the license"),
    ("gpl", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", r"you should have received a copy of the gnu general public license along with"),
    ("gpl-2.0-or-later", r"version 2(?: 0)? of the license or at your option any later version"),
    ("gpl-3.0-or-later", r"version 3(?: 0)? of the license or at your option any later version"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license"),
    ("epl-2.0", r"accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("bsl-1.0", r"distributed under the boost software license"),
    ("wtfpl", r"you just do what the f[^ ]* you want to"),
    ("json", r"the software shall be used for good not evil"),
    ("beerware", r"you can buy me a beer in return"),
    ("cc0-1.0", r"has waived all copyright and related or neighboring rights"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("ofl-1.1", r"this font software is licensed under the sil open font license"),
    ("warranty", r"without warranty of any kind(?: either)? express or implied"),
    ("warranty", r"without any warranty without even the implied warranty of merchantability"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction)(?: or distribution)? of this(?: [^ ]+){1,4} is (?:strictly )?prohibited"),
    ("proprietary", r"(?:no part of this [^ ]+ )?may not be reproduced(?: [^ ]+){0,12} without(?: the)?(?: prior)?(?: written)? permission"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license"),
    ("npl-1.1", r"the contents of this file are subject to the netscape public license"),
    ("cecill", r"this software is governed by the cecill(?: [bc])? license under french law"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee"),
    ("hpnd", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("ncsa", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with"),
    ("libpng", r"permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose"),
    ("openssl", r"redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the openssl project"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("eupl", r"licensed under the eupl"),
    ("cc-by-sa", r"permission is granted(?: [^ ]+){0,6} under the creative commons attribution share ?alike"),
    ("public-domain", r"the author(?:s)? (?:of this [^ ]+ )?disclaims? copyright to this source code"),
    ("proprietary", r"trade secrets?(?: [^ ]+){0,6} may not be disclosed without(?: prior)? written permission"),
]

# General mentions (label, regex).
MENTIONS = [
    ("gpl", r"(?:gnu )?general public license"),
    ("lgpl", r"(?:gnu )?lesser general public license"),
    ("agpl", r"(?:gnu )?affero general public license"),
    ("gpl", r"gnu gpl"),
    ("lgpl", r"gnu lgpl"),
    ("apache", r"apache license"),
    ("bsd", r"bsd(?: style)? license"),
    ("mpl", r"mozilla public license"),
    ("epl", r"eclipse public license"),
    ("eupl", r"european union public licen[sc]e"),
    ("gfdl", r"(?:gnu )?free documentation license"),
    ("cc", r"creative commons(?: licen[sc]e)?"),
    ("public-domain", r"(?:in|into|to) the public domain|public domain (?:mark|work|dedication)"),
    ("copyleft", r"copyleft"),
    ("copyright", r"(?:copyright|copr)(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)?[0-9]{2})?"),
    ("copyright", r"(?:is|are) copyright(?:ed)?(?: by)?"),
    ("reserved", r"all rights (?:are )?reserved"),
    ("some-reserved", r"some rights reserved"),
    ("no-reserved", r"no rights reserved"),
    ("licensed", r"(?:is|are)? ?licensed under(?: the| a)?(?: [^ ]+){1,6}? licen[sc]e"),
    ("licensed", r"(?:released|distributed|available|published) under(?: the| a)?(?: [^ ]+){1,6}? licen[sc]e"),
    ("licensed", r"(?:under|to) the terms of (?:the|this) licen[sc]e"),
    ("licensed", r"see (?:the )?licen[sc]e(?: file| txt| md)?"),
    ("dual", r"dual licen[sc]ed"),
    ("non-commercial", r"(?:non commercial|noncommercial) use(?: only)?"),
    ("research-only", r"(?:for )?(?:academic|research) purposes only"),
    ("freeware", r"freeware"),
    ("shareware", r"shareware"),
    ("proprietary", r"proprietary licen[sc]e"),
    ("eula", r"end user licen[sc]e agreement"),
]

# Parts of the Creative Commons licences, as written in identifiers and in names.
CC_KINDS = {
    "by": "attribution",
    "by sa": "attribution share ?alike",
    "by nd": "attribution no ?deriv(?:ative)?s?",
    "by nc": "attribution non ?commercial",
    "by nc sa": "attribution non ?commercial share ?alike",
    "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: No rule matches where none of these occurs.
ANCHORS = ("licen", "copyright", "spdx", "commons", "public domain", "rights", "copyleft", "warrant", "permi", "prohibited", "without permission", "gpl", " cc", "cecill", "mulan", "no attribution", "advertising", "redistribut", "freeware", "shareware", "confidential", "good not evil", "a beer", "you want", "purposes only", "cc0", "nor the names", "commercial use", "copr ")


#: Most keywords of a rule, and a length from which fewer keywords are better than longer ones.
MOST, LONG = 6, 12


def _choice(tokens) -> tuple[set[str] | None, set[str] | None]:
    """(all strings that a pattern matches, if they are at most MOST; the best set of which each match contains one)."""
    best, whole, now = None, True, {""}

    def offer(words: set[str] | None) -> None:
        nonlocal best
        rank = lambda x: (min(LONG, min(map(len, x))), -len(x), min(map(len, x)))
        if words and "" not in words:
            words = {w for w in words if not any(o != w and o in w for o in words)}
            best = words if best is None else max(best, words, key=rank)

    for op, arg in tokens:
        words = inner = None
        if op is sre.LITERAL:
            words = {chr(arg)}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            words = {chr(c) for _, c in arg}
        elif op is sre.SUBPATTERN:
            words, inner = _choice(arg[3])
        elif op is sre.BRANCH:
            each = [_choice(x) for x in arg[1]]
            words = None if any(w is None for w, _ in each) else set().union(*(w for w, _ in each))
            inner = None if any(i is None for _, i in each) else set().union(*(i for _, i in each))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, item = arg
            words, inner = _choice(item)
            words = words | {""} if words is not None and (least, most) == (0, 1) else None
            inner = inner if least else None
        if words is not None and len(now) * len(words) <= MOST:
            offer(now)
            now = {a + b for a in now for b in words}
        else:
            offer(now)
            whole, now = False, words if words is not None and len(words) <= MOST else {""}
        offer(inner)
    offer(now)
    return (now if whole else None), best


def keywords(regex: str) -> tuple[str, ...]:
    """Words of which every match of the regex, with the spaces around it, contains one."""
    return tuple(sorted(_choice(parser.parse(f" (?:{regex}) "))[1]))


@functools.cache
def rules() -> list[tuple[int, str, tuple[str, ...], str]]:
    """All rules in order; of two equal spans of one priority the earlier rule stays."""
    out = []
    for label, tag, name in NAMES:
        out += [
            (TAG, label, rf"spdx license identifier {tag}"),
            (PASSAGE, label, rf"(?:opensource|spdx) org licenses {tag}"),
            (NAME, label, name),
        ]
    for kind, name in CC_KINDS.items():
        for version in CC_VERSIONS:
            label = f"cc {kind} {version}".replace(" ", "-").replace("-".join(version.split()), ".".join(version.split()))
            out += [
                (PASSAGE, label, rf"creativecommons org licenses {kind} {version}"),
                (NAME, label, rf"cc {kind} {version}"),
                (NAME, label, rf"creative commons {name} {version}"),
            ]
        out.append((MENTION, f"cc {kind}".replace(" ", "-"), rf"creative commons {name}"))
        out.append((MENTION, f"cc {kind}".replace(" ", "-"), rf"cc {kind}"))
    out += [(PASSAGE, *p) for p in PASSAGES] + [(MENTION, *m) for m in MENTIONS]
    return [(priority, label, keywords(regex), regex) for priority, label, regex in out]
