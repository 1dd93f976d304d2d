"""Signature rules for licenses, in order: hand-written patterns over normalised text, each behind a keyword gate.

Normalised text is lower-case in A-Z and has one space between words of letters, digits and bytes beyond ASCII, so
"CC-BY 4.0" reads "cc by 4 0". A family has a pattern for its name, one for its SPDX id and, where it has a page of its
own, one for the address; each gives up to four rules: name, notice ("licensed under ..."), tag and address. Sentences
of license bodies and general statements are rules of their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The phrases of the base rules and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Kinds of rules: priority (smaller goes first) and how sure a detection is.
TAG, ADDRESS, NOTICE_OF_VERSION, VERSION, BODY, NOTICE, NAME, GENERAL = range(8)
SURE = (0.99, 0.97, 0.97, 0.95, 0.93, 0.93, 0.85, 0.4)
KINDS = ("tag", "address", "notice", "name", "body", "notice", "name", "general")

UNDER = (
    r"(?:(?:dual )?licen[cs]ed|released|distributed|published|available|provided|covered|issued|shared|offered|redistributed|veröffentlicht|lizenziert|publié|distribué|publicado|distribuido)"
    r"(?: [^ ]+){0,2}? (?:under|unter|sous|bajo)(?: (?:the|der|la|el|an?|either|both))?(?: (?:terms|conditions)(?: and conditions)? of)?(?: (?:the|version [^ ]+ of the))?(?: licen[cs]e)?"
)
LICENSE = r"(?:public )?(?:software )?(?:licen[cs]es?|lizenz|licencia|licences?)"


def version(major: str, minor: str = "0") -> str:
    """A version after a name: "version 2", "v2", "2 0"; a minor number that is not 0 has to be there."""
    return rf"(?: version| ver| v)? v?{major}" + (rf"(?: {minor})?" if minor == "0" else rf" {minor}")


@dataclass(frozen=True)
class Rule:
    """``needs``: groups of words; a text is searched only if it has a word of each group. ``base`` detections are never suppressed."""

    name: str
    label: str
    kind: int
    pattern: re.Pattern
    needs: tuple[frozenset, ...]
    base: bool = False


@dataclass(frozen=True)
class Family:
    label: str
    words: str
    title: str
    tag: str = ""
    address: str = ""
    versioned: bool = True


GNU = r"(?:gnu )?general public licen[cs]e"
LESSER = r"(?:gnu )?(?:lesser|library) general public licen[cs]e"
AFFERO = r"(?:gnu )?affero general public licen[cs]e"
BSD = r"(?:bsd licen[cs]e|bsd style licen[cs]e|berkeley software distribution licen[cs]e|bsd)"
PUBLIC = r"public licen[cs]e"

# label, gate words, title, SPDX tag, address, whether the title names a version
FAMILIES = tuple(Family(*x) for x in (
    ("gpl-1.0", "gpl gplv1 general", rf"(?:{GNU}|gnu gpl|gpl){version('1')}|gplv1", "gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "gpl gplv2 general", rf"(?:{GNU}|gnu gpl|gpl){version('2')}|gplv2", "gpl 2 0(?: only)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-2.0-or-later", "gpl gplv2 general", rf"(?:{GNU}|gnu gpl|gpl){version('2')} or (?:any )?later|gplv2 or later", "gpl 2 0 or later"),
    ("gpl-3.0", "gpl gplv3 general", rf"(?:{GNU}|gnu gpl|gpl){version('3')}|gplv3", "gpl 3 0(?: only)?", r"gnu org licenses gpl(?: 3 0)?"),
    ("gpl-3.0-or-later", "gpl gplv3 general", rf"(?:{GNU}|gnu gpl|gpl){version('3')} or (?:any )?later|gplv3 or later", "gpl 3 0 or later"),
    ("lgpl-2.0", "lgpl lgplv2 lesser library", rf"(?:{LESSER}|gnu lgpl|lgpl){version('2')}|lgplv2", "lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lgpl lgplv2 lesser library", rf"(?:{LESSER}|gnu lgpl|lgpl){version('2', '1')}|lgplv2 1", "lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "lgpl lgplv3 lesser library", rf"(?:{LESSER}|gnu lgpl|lgpl){version('3')}|lgplv3", "lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl(?: 3 0)?"),
    ("lgpl", "lgpl lesser library", rf"{LESSER}|gnu lgpl", "lgpl", "", False),
    ("agpl-1.0", "agpl affero", rf"(?:affero {PUBLIC}|{AFFERO}|agpl){version('1')}", "agpl 1 0(?: only| or later)?"),
    ("agpl-3.0", "agpl agplv3 affero", rf"(?:{AFFERO}|gnu agpl|agpl){version('3')}|agplv3", "agpl 3 0(?: only| or later)?", r"gnu org licenses agpl(?: 3 0)?"),
    ("agpl", "agpl affero", rf"{AFFERO}|gnu agpl", "agpl", "", False),
    ("gfdl-1.1", "gfdl free", rf"(?:gnu free documentation licen[cs]e|gfdl){version('1', '1')}", "gfdl 1 1(?: only| or later)?"),
    ("gfdl-1.2", "gfdl free", rf"(?:gnu free documentation licen[cs]e|gfdl){version('1', '2')}", "gfdl 1 2(?: only| or later)?"),
    ("gfdl-1.3", "gfdl free", rf"(?:gnu free documentation licen[cs]e|gfdl){version('1', '3')}", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl(?: 1 3)?"),
    ("gfdl", "gfdl documentation", r"gnu free documentation licen[cs]e", "gfdl", "", False),
    ("gpl", "gnu gpl", r"gnu gpl|gnu public licen[cs]e", "gpl", "", False),
    ("apache-1.0", "apache", rf"apache (?:software )?licen[cs]e{version('1')}", "apache 1 0", "apache org licenses license 1 0"),
    ("apache-1.1", "apache", rf"apache (?:software )?licen[cs]e{version('1', '1')}", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache asl", rf"apache (?:software |public )?licen[cs]e{version('2')}|apache 2 0|asl 2 0", "apache 2 0", "apache org licenses license 2 0"),
    ("apache", "apache", r"apache (?:software|public) licen[cs]e|apache lizenz|licencia apache|licence apache", "apache", "apache org licenses", False),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?", "mit 0", "", False),
    ("mit", "mit expat", r"(?:the )?(?:mit|expat) (?:style |x11 )?(?:licen[cs]e|lizenz)|licen(?:cia|ce) mit", "mit", "opensource org licen[cs]es? mit", False),
    ("x11", "x11", r"x11 licen[cs]e", "x11", "", False),
    ("isc", "isc", r"isc licen[cs]e", "isc", "opensource org licen[cs]es? isc", False),
    ("bsd-2-clause", "bsd freebsd berkeley", rf"(?:2|two) clause {BSD}|{BSD} (?:2|two) clause|simplified bsd licen[cs]e|freebsd licen[cs]e", "bsd 2 clause(?: patent)?", "opensource org licen[cs]es? bsd 2 clause"),
    ("bsd-3-clause", "bsd berkeley", rf"(?:3|three) clause {BSD}|{BSD} (?:3|three) clause|(?:new|revised|modified) bsd licen[cs]e", "bsd 3 clause(?: clear| lbnl)?", "opensource org licen[cs]es? bsd 3 clause"),
    ("bsd-4-clause", "bsd berkeley", rf"(?:4|four) clause {BSD}|{BSD} (?:4|four) clause|original bsd licen[cs]e", "bsd 4 clause(?: uc)?"),
    ("0bsd", "0bsd bsd berkeley", rf"0bsd|(?:0|zero) clause {BSD}|{BSD} (?:0|zero) clause", "0bsd"),
    ("bsd", "bsd berkeley", r"bsd (?:style )?licen[cs]e|berkeley software distribution licen[cs]e", "bsd", "", False),
    ("mpl-1.0", "mozilla mpl", rf"(?:mozilla {PUBLIC}|mpl){version('1')}", "mpl 1 0", "mozilla org mpl 1 0"),
    ("mpl-1.1", "mozilla mpl", rf"(?:mozilla {PUBLIC}|mpl){version('1', '1')}", "mpl 1 1", "mozilla org mpl (?:mpl )?1 1"),
    ("mpl-2.0", "mozilla mpl", rf"(?:mozilla {PUBLIC}|mpl){version('2')}", "mpl 2 0(?: no copyleft exception)?", "mozilla org mpl 2 0"),
    ("mpl", "mozilla", rf"mozilla {PUBLIC}", "mpl", "mozilla org mpl", False),
    ("npl-1.1", "netscape", rf"netscape {PUBLIC}(?:{version('1', '1')})?", "npl 1 1"),
    ("epl-1.0", "eclipse epl", rf"(?:eclipse {PUBLIC}|epl){version('1')}", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse epl", rf"(?:eclipse {PUBLIC}|epl){version('2')}", "epl 2 0", "eclipse org legal epl (?:v20|2 0)"),
    ("epl", "eclipse", rf"eclipse {PUBLIC}", "epl", "", False),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[cs]e(?: v1 0| 1 0| version 1 0)?", "edl 1 0", "eclipse org org documents edl v10"),
    ("cddl-1.0", "cddl common", rf"(?:common development and distribution licen[cs]e|cddl){version('1')}", "cddl 1 0"),
    ("cddl-1.1", "cddl common", rf"(?:common development and distribution licen[cs]e|cddl){version('1', '1')}", "cddl 1 1"),
    ("cddl", "development", r"common development and distribution licen[cs]e", "cddl", "", False),
    ("cpl-1.0", "common", rf"common {PUBLIC}(?:{version('1')})?", "cpl 1 0"),
    ("cpal-1.0", "attribution cpal", rf"common public attribution licen[cs]e(?:{version('1')})?", "cpal 1 0"),
    ("eupl-1.1", "eupl european", rf"(?:european union {PUBLIC}|eupl){version('1', '1')}", "eupl 1 1"),
    ("eupl-1.2", "eupl european", rf"(?:european union {PUBLIC}|eupl){version('1', '2')}", "eupl 1 2"),
    ("eupl", "european", rf"european union {PUBLIC}", "eupl", "", False),
    ("artistic-1.0", "artistic", rf"artistic licen[cs]e{version('1')}", "artistic 1 0(?: cl8| perl)?"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{version('2')}", "artistic 2 0"),
    ("artistic", "artistic", r"(?:clarified )?artistic licen[cs]e", "artistic", "", False),
    ("bsl-1.0", "boost", rf"boost software licen[cs]e(?:{version('1')})?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", "business busl", rf"business source licen[cs]e(?:{version('1', '1')})?", "busl 1 1", "mariadb com bsl11"),
    ("zlib", "zlib", r"zlib (?:libpng )?licen[cs]e", "zlib(?: acknowledgement)?", "", False),
    ("libpng", "libpng", r"libpng licen[cs]e(?:(?: version)? 2)?", "libpng(?: 2 0)?", "", False),
    ("libtiff", "libtiff", r"libtiff licen[cs]e", "libtiff", "", False),
    ("ijg", "jpeg", r"independent jpeg group licen[cs]e", "ijg", "", False),
    ("ftl", "freetype", r"freetype (?:project )?licen[cs]e", "ftl", "", False),
    ("bzip2", "bzip2", r"bzip2 licen[cs]e", "bzip2 1 0 [56]", "", False),
    ("curl", "curl", r"curl licen[cs]e", "curl", "", False),
    ("openssl", "openssl", r"openssl licen[cs]e", "openssl", "", False),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e", "ssleay", "", False),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org", False),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2| v2)?", "wtfpl", "wtfpl net", False),
    ("beerware", "beerware beer", r"beerware licen[cs]e|beer ware licen[cs]e", "beerware", "", False),
    ("json", "json", r"json licen[cs]e", "json", "json org license", False),
    ("vim", "vim", r"vim licen[cs]e", "vim", "", False),
    ("w3c", "w3c", r"w3c (?:r )?software (?:notice and |and document )*licen[cs]e", "w3c(?: 19980720| 20150513)?", "w3 org consortium legal", False),
    ("unicode", "unicode", r"unicode (?:license agreement data files and software|inc licen[cs]e agreement|dfs 2016|licen[cs]e v3)", "unicode (?:dfs 201[56]|tou|3 0)", "unicode org (?:copyright|license)", False),
    ("icu", "icu", r"icu licen[cs]e", "icu", "", False),
    ("psf-2.0", "python psf", r"python software foundation licen[cs]e(?:(?: version)? 2)?|psf licen[cs]e", "(?:psf 2 0|python 2 0(?: 1)?)", "docs python org \\d(?: \\d+)? license", False),
    ("php-3.0", "php", rf"php licen[cs]e{version('3')}", "php 3 0", "php net license 3 0 txt"),
    ("php-3.01", "php", rf"php licen[cs]e{version('3', '01')}", "php 3 01", "php net license 3 01"),
    ("php", "php", r"php licen[cs]e", "php", "php net license", False),
    ("ruby", "ruby", r"ruby licen[cs]e|same terms as ruby itself", "ruby", "", False),
    ("perl", "perl", r"same terms as (?:the )?perl(?: 5)?(?: programming language system)?(?: itself)?|perl 5 licen[cs]e", "artistic 1 0 perl or gpl", "", False),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql", "", False),
    ("ncsa", "ncsa illinois", r"(?:university of illinois )?ncsa open source licen[cs]e|uoi ncsa licen[cs]e", "ncsa", "", False),
    ("afl-2.1", "academic afl", rf"(?:academic free licen[cs]e|afl){version('2', '1')}", "afl 2 1"),
    ("afl-3.0", "academic afl", rf"(?:academic free licen[cs]e|afl){version('3')}", "afl 3 0"),
    ("osl-3.0", "open osl", rf"(?:open software licen[cs]e|osl){version('3')}", "osl 3 0"),
    ("ecl-2.0", "educational", rf"educational community licen[cs]e(?:{version('2')})?", "ecl 2 0"),
    ("sleepycat", "sleepycat", r"sleepycat (?:public )?licen[cs]e", "sleepycat", "", False),
    ("qpl-1.0", "q qpl", rf"q {PUBLIC}(?:{version('1')})?|qpl 1 0", "qpl 1 0"),
    ("ipl-1.0", "ibm", rf"ibm {PUBLIC}(?:{version('1')})?", "ipl 1 0"),
    ("spl-1.0", "sun", rf"sun {PUBLIC}(?:{version('1')})?", "spl 1 0"),
    ("sissl", "sun sissl", r"sun industry standards source licen[cs]e(?: 1 1| 1 2)?", "sissl(?: 1 2)?", "", False),
    ("apsl-2.0", "apple", rf"apple public source licen[cs]e(?:{version('2')})?", "apsl 2 0", "opensource apple com apsl"),
    ("nokia", "nokia", r"nokia open source licen[cs]e", "nokia", "", False),
    ("rpl-1.5", "reciprocal", rf"reciprocal {PUBLIC}(?: 1 5)?", "rpl 1 [15]"),
    ("zpl-2.1", "zope", rf"zope {PUBLIC}(?: 2 [01]| version 2 [01])?", "zpl 2 [01]"),
    ("cecill-2.1", "cecill", r"cecill(?: free software licen[cs]e agreement)?(?: version)? v?2(?: 1)?|licence cecill", "cecill 2 [01]", "cecill info licences"),
    ("cecill-b", "cecill", r"cecill b(?: licen[cs]e)?", "cecill b", "cecill info licences licence cecill b"),
    ("cecill-c", "cecill", r"cecill c(?: licen[cs]e)?", "cecill c", "cecill info licences licence cecill c"),
    ("sspl-1.0", "server sspl", rf"(?:server side {PUBLIC}|sspl)(?:{version('1')})?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", rf"elastic licen[cs]e(?:{version('2')})?", "elastic 2 0", "elastic co licensing elastic license"),
    ("commons-clause", "commons", r"commons clause(?: licen[cs]e condition)?(?: v1 0)?", "", "commonsclause com", False),
    ("upl-1.0", "universal upl", rf"universal permissive licen[cs]e(?:{version('1')})?", "upl 1 0", "oss oracle com licenses upl"),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2| 2 0)?", "mulanpsl [12] 0", "license coscl org cn mulanpsl2"),
    ("blueoak-1.0.0", "blue blueoak", r"blue oak model licen[cs]e(?: 1 0 0)?", "blueoak 1 0 0", "blueoakcouncil org license"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|free trial|perimeter|internal use) licen[cs]e(?: 1 0 0)?", "polyform (?:noncommercial|small business) 1 0 0", "polyformproject org licenses"),
    ("ms-pl", "microsoft ms", rf"microsoft {PUBLIC}|ms pl", "ms pl", "", False),
    ("ms-rl", "microsoft ms", r"microsoft reciprocal licen[cs]e|ms rl", "ms rl", "", False),
    ("intel", "intel", r"intel (?:open source|simplified software) licen[cs]e", "intel", "", False),
    ("tcl", "tcl", r"tcl tk licen[cs]e|tcl licen[cs]e", "tcl", "", False),
    ("hpnd", "historical hpnd", r"historical permission notice and disclaimer", "hpnd", "", False),
    ("ofl-1.0", "ofl open", rf"(?:sil )?open font licen[cs]e{version('1')}", "ofl 1 0"),
    ("ofl-1.1", "ofl open", rf"(?:sil )?(?:open font licen[cs]e|ofl){version('1', '1')}", "ofl 1 1", "scripts sil org ofl"),
    ("ofl", "font", r"(?:sil )?open font licen[cs]e", "ofl", "openfontlicense org", False),
    ("cc0-1.0", "cc0 zero", r"cc0(?: 1 0(?: universal)?)?|creative commons zero(?: v1 0| 1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero"),
    ("public-domain-mark", "domain publicdomain", r"public domain mark(?: 1 0)?", "", "creativecommons org publicdomain mark", False),
    ("pddl-1.0", "pddl domain", r"public domain dedication and licen[cs]e(?: v?1 0)?|pddl", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("odbl-1.0", "odbl database", r"open (?:data commons )?(?:open )?database licen[cs]e(?: v?1 0)?|odbl", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "odc commons", r"open data commons attribution licen[cs]e(?: v?1 0)?|odc by", "odc by 1 0", "opendatacommons org licenses by"),
    ("cdla-permissive", "cdla community", r"community data licen[cs]e agreement permissive(?: (?:version )?[12] 0)?|cdla permissive", "cdla permissive [12] 0", "cdla dev permissive"),
    ("cdla-sharing", "cdla community", r"community data licen[cs]e agreement sharing(?: (?:version )?1 0)?|cdla sharing", "cdla sharing 1 0", "cdla dev sharing"),
    ("ogl-uk", "government ogl", r"open government licen[cs]e(?: v?[123](?: 0)?| version [123](?: 0)?)?", "ogl uk [123] 0", "nationalarchives gov uk doc open government licence", False),
    ("etalab-2.0", "etalab ouverte", r"licence ouverte(?: etalab)?(?: 2 0| version 2 0)?|etalab (?:open licen[cs]e )?2 0", "etalab 2 0", "etalab gouv fr", False),
    ("dl-de-by-2.0", "datenlizenz dl", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?|dl de by 2 0", "dl de by 2 0", "govdata de dl de by 2 0", False),
    ("dl-de-zero-2.0", "datenlizenz dl", r"datenlizenz deutschland zero(?: version)?(?: 2 0)?|dl de zero 2 0", "dl de zero 2 0", "govdata de dl de zero 2 0", False),
    ("openrail", "openrail", r"(?:bigscience |creativeml |bigcode )?openrail(?: m| \+\+)?(?: licen[cs]e)?", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?", "", False),
))

# The kinds of Creative Commons licenses: label, letters, words.
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative|ative work|ativework)?s?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative|ative work|ativework)?s?"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
COMMONS_PORTS = "(?: (?:international|unported|generic|deed|legal code|intl|igo|de|fr|es|us|uk|at|ch))?"

# label, gate words (two groups), a sentence of the license's body
BODIES = (
    ("mit", "permission", "granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", "portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission", "granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission", "granted", r"permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("bsd", "redistribution", "permitted", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "endorse", "promote", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", "redistribute", "foundation", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl-2.0-or-later", "foundation", "later", r"free software foundation either version 2 of the licen[cs]e or (?:at your option )?any later version"),
    ("gpl-3.0-or-later", "foundation", "later", r"free software foundation either version 3 of the licen[cs]e or (?:at your option )?any later version"),
    ("lgpl", "redistribute", "lesser", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation"),
    ("agpl", "redistribute", "affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("gfdl", "permission", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl-no-invariants", "invariant", "sections", r"with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts"),
    ("apache-2.0", "compliance", "license", r"you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "warranties", "license", r"distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mpl-2.0", "mozilla", "source", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "eclipse", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("bsl-1.0", "boost", "accompanying", r"distributed under the boost software license version 1 0 see accompanying file license"),
    ("zlib", "liable", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "misrepresented", "origin", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "unencumbered", "domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "want", r"you just do what the fuck you want to"),
    ("beerware", "retain", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0-1.0", "waived", "neighboring", r"has waived all copyright and related or neighboring rights to this work"),
    ("ofl", "sil", "font", r"this font software is licensed under the sil open font license"),
    ("artistic", "perl", "redistribute", r"you can redistribute it and or modify it under the same terms as perl itself"),
    ("postgresql", "permission", "granted", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("json", "evil", "good", r"the software shall be used for good not evil"),
)

# label, gate words (two groups), a notice that names the license by a word that says nothing elsewhere
SHORT_NOTICES = (
    ("mit", "mit", "under unter sous bajo", UNDER + " mit"),
    ("gpl", "gpl", "under unter sous bajo", UNDER + " gpl"),
    ("lgpl", "lgpl", "under unter sous bajo", UNDER + " lgpl"),
    ("agpl", "agpl", "under unter sous bajo", UNDER + " agpl"),
    ("bsd", "bsd", "under unter sous bajo", UNDER + " bsd"),
    ("apache", "apache", "under unter sous bajo", UNDER + " apache"),
    ("isc", "isc", "under unter sous bajo", UNDER + " isc"),
    ("zlib", "zlib", "under unter sous bajo", UNDER + " zlib"),
)

# label, gate words (two groups), a general statement
GENERALS = (
    ("public-domain", "domain", "public", r"(?:is|are|placed|released|dedicated|donated)(?: hereby)?(?: in| into| to)? the public domain"),
    ("public-domain", "gemeinfrei", "gemeinfrei", r"(?:ist|sind) gemeinfrei"),
    ("all-rights-reserved", "rights", "reserved", r"all rights reserved"),
    ("all-rights-reserved", "rechte", "vorbehalten", r"alle rechte vorbehalten"),
    ("all-rights-reserved", "droits", "réservés", r"tous droits réservés"),
    ("all-rights-reserved", "derechos", "reservados", r"todos los derechos reservados"),
    ("proprietary", "proprietary", "confidential", r"proprietary and confidential|confidential and proprietary"),
    ("proprietary", "proprietary commercial", "license", r"(?:under|subject to) (?:a|the) (?:proprietary|commercial) license"),
    ("noncommercial", "commercial noncommercial", "only", r"for (?:personal and )?non ?commercial use only"),
    ("no-derivatives", "redistributed", "may", r"may not be (?:copied |modified |sold |or ){1,4}redistributed"),
    ("royalty-free", "royalty", "free", r"royalty free (?:worldwide )?(?:perpetual )?licen[cs]e"),
    ("copyright-notice", "copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?"),
    ("other-license", "license licence licenses licences lizenz licencia", "under unter sous bajo", UNDER + r"(?: [^ ]+){1,5}? " + LICENSE),
    ("other-license", "spdx", "identifier", r"spdx licen[cs]e identifier(?: [^ ]+){1,4}"),
    ("see-license-file", "license licence", "see", r"see (?:the )?(?:accompanying |file )?licen[cs]e(?: md| txt| file)? (?:for (?:more )?(?:details|information|copying)|file)"),
)


def _rule(name: str, label: str, kind: int, pattern: str, *needs: str, base: bool = False) -> Rule:
    return Rule(name, label, kind, re.compile(rf"(?<= )(?:{pattern})(?= )".encode()), tuple(frozenset(x.encode() for x in n.split()) for n in needs), base)


def _of_family(f: Family) -> list[Rule]:
    # Gates are words without which the pattern cannot match.
    out = []
    if f.tag:
        out.append(_rule(f"{f.label}/tag", f.label, TAG, rf"spdx licen[cs]e identifier {f.tag}", "spdx"))
    if f.address:
        out.append(_rule(f"{f.label}/address", f.label, ADDRESS, rf"(?:https? )?(?:www )?{f.address}(?: html| txt| en html| php)?", f.address.split()[0]))
    under = "under unter sous bajo"
    out.append(_rule(f"{f.label}/notice", f.label, NOTICE_OF_VERSION if f.versioned else NOTICE, rf"{UNDER} (?:{f.title})", f.words, under))
    out.append(_rule(f"{f.label}/name", f.label, VERSION if f.versioned else NAME, f.title, f.words))
    return out


def _of_commons() -> list[Rule]:
    out = []
    for label, letters, title in COMMONS:
        for v in (*COMMONS_VERSIONS, ""):
            number = " " + v.replace(".", r" ") if v else ""
            of = f"{label}-{v}" if v else label
            name = rf"cc {letters}{number}|creative commons {title}(?: licen[cs]e)?(?: version)?{number}|creative commons {letters}{number}"
            out.append(_rule(f"{of}/name", of, VERSION if v else NAME, f"(?:{name}){COMMONS_PORTS}", "cc creative"))
            out.append(_rule(f"{of}/notice", of, NOTICE_OF_VERSION if v else NOTICE, rf"{UNDER}(?: an?)? (?:{name}){COMMONS_PORTS}", "cc creative", "under unter sous bajo"))
            if v:
                out.append(_rule(f"{of}/tag", of, TAG, rf"spdx licen[cs]e identifier cc {letters}{number}", "spdx"))
                out.append(_rule(f"{of}/address", of, ADDRESS, rf"(?:https? )?(?:www )?creativecommons org licenses {letters}{number}", "creativecommons"))
    return out


def rules() -> tuple[Rule, ...]:
    """All rules in their order."""
    out = [_rule(f"{label}/base", label, NAME, phrase, *phrase.split(), base=True) for phrase, label in BASE]
    for f in FAMILIES:
        out += _of_family(f)
    out += _of_commons()
    out += [_rule(f"{label}/body-{k}", label, BODY, body, *gate) for k, (label, *gate, body) in enumerate(BODIES)]
    out += [_rule(f"{label}/short-{k}", label, NOTICE, text, *gate) for k, (label, *gate, text) in enumerate(SHORT_NOTICES)]
    out += [_rule(f"{label}/general-{k}", label, GENERAL, text, *gate) for k, (label, *gate, text) in enumerate(GENERALS)]
    return tuple(out)
