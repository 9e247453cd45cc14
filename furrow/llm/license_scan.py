"""License scans with ordered signature rules.

A rule is a regular expression over the text's words (lower-case, joined by single
blanks), with a priority and a confidence. It is tried where the literals that its expression needs,
which are read off the expression itself, all occur.
Some 200 rules are notices, sentences and addresses written by hand; the others put each of 130 names into the phrases that licenses are
named by. Detections are taken in order of priority, then length, then place; one that lies within an interval
taken before is suppressed. A list (``A or B``, ``A and B licenses``) adds the names that follow a detection. Base phrases are searched besides and always count.

Defined results: a null or wordless text has no words, no labels and score 0; rows that repeat an id are each scanned; a null id is kept; a long text is scanned whole; an
empty table gives an empty result; only the named columns are read, so other columns can have any name; score is the highest
confidence among the detections that stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as constants
from re._parser import parse
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases of words and their labels; fixed by the result's definition.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_SCORE = 0.95

# Names as words: label, expression of the name.
_V = r"(?:v|version|ver)?\s?"
NAMES = (
    ("mit", r"mit(?: x11)?"), ("mit-0", r"mit (?:0|no attribution|zero)"), ("x11", r"x11"), ("expat", r"expat"),
    ("isc", r"isc"), ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause|bsd 0 clause)"), ("bsd-1-clause", r"(?:bsd 1 clause|1 clause bsd|one clause bsd)"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)"), ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)"), ("bsd", r"bsd"), ("apache-1.0", rf"apache (?:software )?(?:license )?{_V}1 0"), ("apache-1.1", rf"apache (?:software )?(?:license )?{_V}1 1"),
    ("apache-2", rf"apache (?:software )?(?:license )?{_V}2(?: 0)?"), ("apache", r"apache(?: software)?"),
    ("gpl-1.0", rf"(?:gnu )?(?:gpl|general public license) ?{_V}1(?: 0)?"), ("gpl-2.0", rf"(?:gnu )?(?:gpl|general public license) ?{_V}2(?: 0)?"), ("gpl-3.0", rf"(?:gnu )?(?:gpl|general public license) ?{_V}3(?: 0)?"),
    ("gpl", r"(?:gnu gpl|gpl|gnu general public license)"), ("lgpl-2.0", rf"(?:gnu )?(?:lgpl|library general public license) ?{_V}2(?: 0)?"), ("lgpl-2.1", rf"(?:gnu )?(?:lgpl|lesser general public license) ?{_V}2 1"),
    ("lgpl-3.0", rf"(?:gnu )?(?:lgpl|lesser general public license) ?{_V}3(?: 0)?"), ("lgpl", r"(?:gnu lgpl|lgpl|gnu lesser general public license)"), ("agpl-1.0", rf"(?:affero gpl|affero general public license|agpl) ?{_V}1(?: 0)?"),
    ("agpl-3.0", rf"(?:gnu )?(?:agpl|affero gpl|affero general public license) ?{_V}3(?: 0)?"), ("agpl", r"(?:gnu agpl|agpl|gnu affero general public license)"), ("gfdl-1.1", rf"(?:gnu )?(?:fdl|gfdl|free documentation license) ?{_V}1 1"),
    ("gfdl-1.2", rf"(?:gnu )?(?:fdl|gfdl|free documentation license) ?{_V}1 2"), ("gfdl-1.3", rf"(?:gnu )?(?:fdl|gfdl|free documentation license) ?{_V}1 3"), ("gfdl", r"gfdl"),
    ("mpl-1.0", rf"(?:mpl|mozilla public license) ?{_V}1 0"), ("mpl-1.1", rf"(?:mpl|mozilla public license) ?{_V}1 1"), ("mpl-2.0", rf"(?:mpl|mozilla public license) ?{_V}2(?: 0)?"), ("mpl", r"mozilla public"),
    ("epl-1.0", rf"(?:epl|eclipse public license) ?{_V}1(?: 0)?"), ("epl-2.0", rf"(?:epl|eclipse public license) ?{_V}2(?: 0)?"), ("edl-1.0", rf"(?:edl|eclipse distribution license) ?{_V}1(?: 0)?"),
    ("cpl-1.0", rf"(?:cpl|common public license) ?{_V}1(?: 0)?"), ("ipl-1.0", rf"ibm public license ?{_V}1(?: 0)?"), ("cddl-1.0", rf"(?:cddl|common development and distribution license) ?{_V}1 0"), ("cddl-1.1", rf"(?:cddl|common development and distribution license) ?{_V}1 1"),
    ("eupl-1.1", rf"(?:eupl|european union public licen[cs]e) ?{_V}1 1"), ("eupl-1.2", rf"(?:eupl|european union public licen[cs]e) ?{_V}1 2"), ("cecill-2.1", rf"cecill ?{_V}2 1"), ("cecill-b", r"cecill b"), ("cecill-c", r"cecill c"), ("cecill", r"cecill"),
    ("artistic-1.0", rf"artistic (?:license )?{_V}1(?: 0)?"), ("artistic-2.0", rf"artistic (?:license )?{_V}2(?: 0)?"), ("perl", r"same terms as perl(?: itself)?"), ("psf-2.0", rf"(?:psf|python software foundation)(?: license)? ?{_V}2(?: 0)?"), ("python", r"python software foundation"),
    ("php-3.0", rf"php (?:license )?{_V}3 0"), ("php-3.01", rf"php (?:license )?{_V}3 01"), ("ruby", r"ruby"), ("zlib", r"zlib(?: libpng)?"), ("libpng", r"libpng(?: 2 0)?"), ("boost-1.0", rf"boost (?:software )?(?:license )?(?:{_V}1 0)?"), ("bsl-1.0", r"bsl 1 0"),
    ("busl-1.1", rf"(?:busl|business source license) ?{_V}1 1"), ("sspl-1.0", rf"(?:sspl|server side public license)(?: {_V}1(?: 0)?)?"), ("elastic-2.0", rf"elastic (?:license )?{_V}2(?: 0)?"), ("ms-pl", r"microsoft public"), ("ms-rl", r"microsoft reciprocal"),
    ("afl-3.0", rf"(?:afl|academic free license) ?{_V}3 0"), ("osl-3.0", rf"(?:osl|open software license) ?{_V}3 0"), ("apsl-2.0", rf"apple public source (?:license )?{_V}2 0"), ("ncsa", r"(?:ncsa|university of illinois ncsa)(?: open source)?"), ("unicode", r"unicode(?: dfs 2016| inc)?"), ("curl", r"curl"),
    ("openssl", r"openssl"), ("postgresql", r"postgresql"), ("vim", r"vim"), ("w3c", r"w3c(?: software)?"), ("ofl-1.1", rf"(?:ofl|sil open font license|open font license) ?{_V}1 1"), ("ofl", r"sil open font"), ("unlicense", r"unlicense"), ("wtfpl", r"wtfpl"),
    ("odbl-1.0", rf"(?:odbl|open database license)(?: {_V}1(?: 0)?)?"), ("odc-by-1.0", rf"(?:odc by|open data commons attribution)(?: {_V}1(?: 0)?)?"), ("pddl-1.0", rf"(?:pddl|public domain dedication and license)(?: {_V}1(?: 0)?)?"), ("cc0-1.0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?"), ("cdla-permissive-2.0", r"cdla permissive 2 0"), ("cdla-sharing-1.0", r"cdla sharing 1 0"),
    ("llama", r"llama(?: [23])?(?: community)?"), ("openrail", r"(?:open ?rail(?: m)?|bigscience rail)"), ("mulan-psl-2", rf"mulan (?:psl|permissive software license) ?{_V}2"), ("ogl-3.0", rf"open government licen[cs]e ?{_V}3(?: 0)?"), ("blueoak-1.0", r"blue ?oak(?: model)?(?: 1 0 0)?"), ("upl-1.0", r"universal permissive(?: 1 0)?"),
)
_CC = (("by", r"(?:by|attribution)"), ("by-sa", r"(?:by sa|attribution share ?alike)"), ("by-nd", r"(?:by nd|attribution no ?deriv(?:ative)?s?)"), ("by-nc", r"(?:by nc|attribution non ?commercial)"), ("by-nc-sa", r"(?:by nc sa|attribution non ?commercial share ?alike)"), ("by-nc-nd", r"(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s?)"))
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Sentences of license texts and notices: label, expression, confidence.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 0.98), ("mit", r"the above copyright notice and this permission notice shall be included in all copies", 0.97),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.97), ("apache-2", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2", r"(?:www )?apache org licenses license 2 0", 0.98), ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("bsd-3-clause", r"neither the name of .{1,80}? may be used to endorse or promote products", 0.95), ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 0.95),
    ("gpl", r"this program is free software you can redistribute it and or modify it", 0.95), ("lgpl", r"this library is free software you can redistribute it and or modify it", 0.95), ("gpl", r"(?:www )?gnu org licenses(?: old licenses)?(?: gpl)?", 0.85),
    ("gpl-3.0-or-later", r"either version 3 of the license or (?:at your option )?any later version", 0.97), ("gpl-2.0-or-later", r"either version 2 of the license or (?:at your option )?any later version", 0.97),
    ("agpl-3.0", r"interact with it remotely through a computer network", 0.8), ("mpl-2.0", r"subject to the terms of the mozilla public license v 2 0", 0.98), ("unlicense", r"this is free and unencumbered software released into the public domain", 0.98),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95), ("boost-1.0", r"(?:www )?boost org license 1 0 txt", 0.98), ("wtfpl", r"do what the fuck you want to public license", 0.98),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain", 0.85), ("public-domain", r"this work is in the public domain", 0.9), ("public-domain", r"no known copyright restrictions", 0.7),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", 0.98), ("public-domain", r"creativecommons org publicdomain mark 1 0", 0.95), ("proprietary", r"all rights reserved", 0.6), ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)", 0.8),
    ("proprietary", r"may not be (?:reproduced|copied|distributed) (?:without|in whole or in part)", 0.7), ("proprietary", r"without the prior written permission", 0.6), ("copyright", r"copyright (?:c )?(?:19|20)\d\d", 0.5), ("copyright", r"copyright holders?", 0.4),
    ("open-source", r"opensource org licenses [a-z0-9]+", 0.8), ("unknown-license", r"licen[cs]ed under (?:the )?terms", 0.4), ("unknown-license", r"(?:see|refer to) the licen[cs]e(?: file)?", 0.4), ("gpl", r"copyleft", 0.5),
)


# Further notices, headers and addresses as they stand in files: label, expression, confidence. Fixed wordings; under 0.7 they give way to a named version.
NOTICES = (
    ("gpl", r"(?:the )?gnu general public licen[cs]e", 0.65), ("lgpl", r"(?:the )?gnu lesser general public licen[cs]e", 0.65), ("lgpl", r"(?:the )?gnu library general public licen[cs]e", 0.65), ("agpl", r"(?:the )?gnu affero general public licen[cs]e", 0.65),
    ("gfdl", r"(?:the )?gnu free documentation licen[cs]e", 0.65), ("mpl", r"(?:the )?mozilla public licen[cs]e", 0.65), ("epl", r"(?:the )?eclipse public licen[cs]e", 0.65), ("cpl", r"(?:the )?common public licen[cs]e", 0.65), ("cddl", r"(?:the )?common development and distribution licen[cs]e", 0.65),
    ("eupl", r"(?:the )?european union public licen[cs]e", 0.65), ("sspl", r"(?:the )?server side public licen[cs]e", 0.65), ("busl", r"(?:the )?business source licen[cs]e", 0.65), ("osl", r"(?:the )?open software licen[cs]e", 0.65), ("afl", r"(?:the )?academic free licen[cs]e", 0.65), ("artistic", r"(?:the )?artistic licen[cs]e", 0.65),
    ("odbl", r"(?:the )?open database licen[cs]e", 0.65), ("ofl", r"(?:the )?open font licen[cs]e", 0.65), ("psf", r"(?:the )?python software foundation licen[cs]e", 0.65), ("ms-pl", r"(?:the )?microsoft public licen[cs]e", 0.65), ("ms-rl", r"(?:the )?microsoft reciprocal licen[cs]e", 0.65),
    ("apsl", r"(?:the )?apple public source licen[cs]e", 0.65), ("npl", r"(?:the )?netscape public licen[cs]e", 0.65), ("qpl", r"(?:the )?q public licen[cs]e", 0.65), ("sissl", r"sun industry standards source licen[cs]e", 0.65), ("lppl", r"latex project public licen[cs]e", 0.65),
    ("zpl", r"zope public licen[cs]e", 0.65), ("sleepycat", r"sleepycat licen[cs]e", 0.65), ("rpl", r"reciprocal public licen[cs]e", 0.65), ("nasa", r"nasa open source agreement", 0.65), ("ecl", r"educational community licen[cs]e", 0.65), ("cpal", r"common public attribution licen[cs]e", 0.65),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e along with this", 0.69), ("lgpl", r"you should have received a copy of the gnu lesser general public licen[cs]e along with this", 0.69), ("agpl", r"you should have received a copy of the gnu affero general public licen[cs]e along with this", 0.69),
    ("gpl", r"under the terms of the gnu general public licen[cs]e as published by the free software foundation", 0.69), ("lgpl", r"under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation", 0.69),
    ("agpl", r"under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", 0.69), ("lgpl", r"under the terms of the gnu library general public licen[cs]e as published by the free software foundation", 0.69),
    ("gpl-2.0", r"either version 2 of the license or (?:at your option )?version 3", 0.9), ("gpl-2.0", r"version 2 of the license as published by the free software foundation", 0.9), ("gpl-3.0", r"version 3 of the license as published by the free software foundation", 0.9),
    ("lgpl-2.1", r"either version 2 1 of the license or (?:at your option )?any later version", 0.95), ("lgpl-2.1", r"version 2 1 of the license as published by the free software foundation", 0.9), ("gpl-2.0", r"gnu org licenses old licenses gpl 2 0", 0.95), ("lgpl-2.1", r"gnu org licenses old licenses lgpl 2 1", 0.95),
    ("gpl-3.0", r"gnu org licenses gpl 3 0", 0.95), ("lgpl-3.0", r"gnu org licenses lgpl 3 0", 0.95), ("agpl-3.0", r"gnu org licenses agpl 3 0", 0.95), ("lgpl", r"gnu org licenses lgpl", 0.85), ("agpl", r"gnu org licenses agpl", 0.85), ("gfdl", r"gnu org licenses fdl", 0.85), ("gpl", r"gnu org copyleft gpl", 0.85), ("lgpl", r"gnu org copyleft lesser", 0.85),
    ("gpl-exception", r"as a special exception .{1,60}? gives? (?:you )?(?:unlimited )?permission to (?:link|copy)", 0.75), ("gpl-2.0-classpath", r"classpath exception", 0.8), ("gpl-linking", r"linking this library statically or dynamically with other modules", 0.85), ("linux-syscall", r"linux syscall note", 0.85),
    ("mit", r"opensource org licenses mit", 0.95), ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.75), ("mit", r"mit license see license", 0.9), ("mit", r"licensed mit", 0.85), ("mit", r"license mit", 0.9), ("mit", r"mit opensource org", 0.9),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use", 0.95), ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", 0.7),
    ("mit-modern", r"permission to use copy modify and distribute this software and its documentation for any purpose", 0.8), ("hpnd", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 0.9), ("isc", r"opensource org licenses isc", 0.95), ("isc", r"isc license", 0.9),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", 0.9), ("0bsd", r"opensource org licenses 0bsd", 0.95), ("bsd-2-clause", r"opensource org licenses bsd 2 clause", 0.95), ("bsd-3-clause", r"opensource org licenses bsd 3 clause", 0.95), ("bsd", r"opensource org licenses bsd license", 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 0.85), ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 0.85), ("bsd", r"use of this source code is governed by a bsd style license", 0.95), ("bsd", r"bsd style licen[cs]e", 0.8), ("bsd", r"licensed bsd", 0.8), ("bsd", r"license bsd", 0.8),
    ("bsd-3-clause", r"neither the name of the copyright holder nor the names of its contributors", 0.95), ("bsd-3-clause", r"the name of the author may not be used to endorse or promote products", 0.9), ("bsd-2-clause-patent", r"bsd 2 clause patent", 0.9), ("bsd-clear", r"no express or implied licenses to any party s patent rights are granted", 0.9),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95), ("apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", 0.97), ("apache-2", r"opensource org licenses apache 2 0", 0.95), ("apache-2", r"apache org licenses license 2 0 txt", 0.98),
    ("apache-1.1", r"apache org licenses license 1 1", 0.95), ("apache-1.0", r"apache org licenses license 1 0", 0.95), ("apache-1.1", r"this product includes software developed by the apache software foundation", 0.85), ("apache-2", r"license apache 2 0", 0.9), ("apache-2", r"aslv? ?2(?: 0)?", 0.75), ("apache-2", r"apache2 licen[cs]e", 0.85), ("apache-llvm", r"apache 2 0 with llvm exceptions?", 0.95), ("llvm", r"llvm org license txt", 0.9),
    ("mpl-2.0", r"mozilla org mpl 2 0", 0.98), ("mpl-1.1", r"mozilla org mpl 1 1", 0.95), ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 0.98), ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", 0.95), ("mpl-2.0", r"incompatible with secondary licenses as defined by the mozilla public license", 0.95), ("mpl", r"mozilla org mpl", 0.8),
    ("epl-1.0", r"eclipse org legal epl v10", 0.98), ("epl-2.0", r"eclipse org legal epl 2 0", 0.98), ("edl-1.0", r"eclipse org org documents edl v10", 0.98), ("cpl-1.0", r"opensource org licenses cpl1 0", 0.95), ("cddl-1.0", r"opensource org licenses cddl1", 0.95), ("cddl", r"glassfish dev java net public cddl", 0.9), ("eupl-1.2", r"joinup ec europa eu .{0,40}? eupl", 0.85), ("cecill", r"cecill info licences", 0.9),
    ("boost-1.0", r"distributed under the boost software license", 0.95), ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 0.97), ("unlicense", r"unlicense org", 0.95), ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.97), ("wtfpl", r"wtfpl net", 0.95), ("beerware", r"(?:beer ?ware)", 0.8), ("beerware", r"you can buy me a beer in return", 0.85),
    ("zlib", r"this notice may not be removed or altered from any source distribution", 0.9), ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications", 0.93), ("zlib", r"altered source versions must be plainly marked as such", 0.9), ("openssl", r"this product includes software developed by the openssl project", 0.95), ("openssl", r"this product includes cryptographic software written by eric young", 0.9),
    ("artistic-2.0", r"opensource org licenses artistic 2 0", 0.95), ("artistic-2.0", r"perlfoundation org artistic license 2 0", 0.95), ("perl", r"you (?:can|may) redistribute it and or modify it under the same terms as perl", 0.95), ("php-3.01", r"php net license 3 01", 0.95), ("php-3.0", r"php net license 3 0", 0.95), ("ruby", r"ruby lang org .{0,20}? license", 0.85), ("psf-2.0", r"psf license agreement for python", 0.9), ("curl", r"curl haxx se docs copyright", 0.95), ("w3c", r"w3 org consortium legal", 0.85), ("unicode", r"unicode org copyright", 0.85),
    ("ofl-1.1", r"scripts sil org ofl", 0.95), ("ofl-1.1", r"reserved font name", 0.8), ("odbl-1.0", r"opendatacommons org licenses odbl", 0.95), ("odc-by-1.0", r"opendatacommons org licenses by", 0.95), ("pddl-1.0", r"opendatacommons org licenses pddl", 0.95), ("ogl-3.0", r"nationalarchives gov uk doc open government licence version 3", 0.95), ("etalab-2.0", r"etalab (?:open )?licen[cs]e", 0.85), ("cdla", r"cdla (?:permissive|sharing)", 0.8),
    ("public-domain", r"(?:this|the) (?:file|code|program|software|text|document|work|book) is (?:hereby )?(?:in|placed in|released into|dedicated to) the public domain", 0.9), ("public-domain", r"no rights reserved", 0.75), ("public-domain", r"public domain mark", 0.8), ("public-domain", r"project gutenberg", 0.7), ("public-domain", r"i hereby place .{1,40}? in the public domain", 0.9), ("public-domain", r"not subject to copyright protection", 0.75), ("us-government", r"work of the united states government", 0.8),
    ("cc0-1.0", r"to the extent possible under law .{1,120}? has waived all copyright", 0.95), ("cc0-1.0", r"cc zero", 0.8), ("cc0-1.0", r"cc0", 0.85), ("cc", r"some rights reserved", 0.6), ("cc", r"licensed under a creative commons licen[cs]e", 0.8), ("cc", r"creative commons licen[cs]e", 0.65), ("cc", r"creativecommons org licenses", 0.65),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|document)", 0.8), ("proprietary", r"this software is (?:the )?(?:confidential|proprietary) (?:and proprietary )?information", 0.85), ("proprietary", r"end user licen[cs]e agreement", 0.7), ("proprietary", r"no part of this (?:publication|document|book|work) may be reproduced", 0.85), ("proprietary", r"for internal use only", 0.65), ("proprietary", r"trade secrets?", 0.5), ("proprietary", r"not for redistribution", 0.65),
    ("non-commercial", r"for non ?commercial (?:use|purposes?) only", 0.8), ("non-commercial", r"free for (?:personal|academic|non ?commercial) use", 0.75), ("research-only", r"for research (?:use|purposes?) only", 0.8), ("no-ai-training", r"may not be used (?:to train|for training)", 0.75), ("llama", r"llama (?:2|3|3 1|3 2)? ?community licen[cs]e agreement", 0.9), ("openrail", r"use based restrictions", 0.7), ("gemma", r"gemma terms of use", 0.9),
    ("commons-clause", r"commons clause", 0.85), ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service", 0.95), ("busl-1.1", r"change date .{1,80}? change license", 0.9), ("sspl-1.0", r"offering the software as a service", 0.6), ("json", r"the software shall be used for good not evil", 0.98), ("dual", r"dual licen[cs]ed", 0.6), ("freeware", r"this (?:program|software) is freeware", 0.75), ("shareware", r"this (?:program|software) is shareware", 0.75),
    ("unknown-license", r"distributed under (?:the )?(?:same )?licen[cs]e", 0.4), ("unknown-license", r"this (?:file|program|software|work) is licen[cs]ed under", 0.4), ("unknown-license", r"licen[cs]e agreement", 0.4), ("unknown-license", r"permission is (?:hereby )?granted", 0.4), ("unknown-license", r"released under an? open source licen[cs]e", 0.5), ("unknown-license", r"terms and conditions for use reproduction and distribution", 0.5),
)


class Rule(NamedTuple):
    label: str
    priority: int
    score: float
    needs: tuple[tuple[bytes, ...], ...]
    pattern: re.Pattern


class Found(NamedTuple):
    start: int
    end: int
    rule: Rule


def needs(pattern: str) -> tuple[tuple[bytes, ...], ...]:
    """Sets of literals, read off an expression: every text that it matches has one of each set. The longest come first."""
    found: list[tuple[str, ...]] = []

    def walk(items) -> None:
        run = ""
        for kind, value in [*items, (None, None)]:
            if kind is constants.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append((run,))
                run = ""
            if kind is constants.SUBPATTERN:
                walk(value[3])
            elif kind in (constants.MAX_REPEAT, constants.MIN_REPEAT) and value[0]:
                walk(value[2])
            elif kind is constants.BRANCH:
                best = [needs_of(branch) for branch in value[1]]
                if all(best):
                    found.append(tuple(sorted({x for b in best for x in b[0]})))

    def needs_of(items) -> list[tuple[str, ...]]:
        nonlocal found
        before, found = found, []
        walk(items)
        mine, found = found, before
        return sorted(mine, key=lambda c: -min(map(len, c)))

    every = list(dict.fromkeys(needs_of(parse(pattern))))
    return tuple(tuple(x.encode() for x in c) for c in every if min(map(len, c)) > 1 or c == every[0])


def _names() -> list[tuple[str, str]]:
    """All licenses with a name: label, expression."""
    versions = [(f"cc-{k}-{v.replace(' ', '.')}", rf"(?:cc|creative commons) {n}(?: {v}| licen[cs]e {v})") for k, n in _CC for v in _CC_VERSIONS]
    return [*NAMES, ("artistic", "artistic"), *versions, *((f"cc-{k}", rf"(?:cc|creative commons) {n}") for k, n in _CC)]


@lru_cache(maxsize=1)
def _listed() -> tuple[tuple[str, float, re.Pattern], ...]:
    """What may follow a license in a list: ``or`` or ``and``, and a name."""
    return tuple((label, 0.8 if re.search(r"\d", label) else 0.6, re.compile(rf"(?:or|and) (?:the )?{name}(?: licen[cs]es?)?(?= )".encode())) for label, name in _names())


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: full notices and tags, then sentences, then titles."""
    out: list[Rule] = []

    def add(label: str, priority: int, score: float, pattern: str) -> None:
        out.append(Rule(label, priority, score, needs(pattern), re.compile(rf"(?<= ){pattern}(?= )".encode())))

    for label, name in _names():
        exact = bool(re.search(r"\d", label))
        add(label, 40 - (not exact), 0.99 if exact else 0.9, rf"(?:re)?licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?{name}(?: licen[cs]e)?")
        add(label, 38 - (not exact), 0.98, rf"spdx license identifier {name}(?: (?:only|or later))?")
        add(label, 20 - (not exact), 0.8 if exact else 0.6, rf"(?:the )?{name} licen[cs]e[ds]?(?: {_V}\d(?: \d)?)?")
        add(label, 19, 0.6, rf"under (?:the )?{name} (?:and|or)")
        if exact and len(label) > 4:
            add(label, 21, 0.7, name)
    for k, _ in _CC:
        for v in _CC_VERSIONS:
            add(f"cc-{k}-{v.replace(' ', '.')}", 39, 0.99, rf"creativecommons org licenses {k.replace('-', ' ')} {v}")
    for k, n in _CC:
        add(f"cc-{k}", 18, 0.7, rf"cc {n}")
    for label, pattern, score in (*SENTENCES, *NOTICES):
        add(label, 30 if score >= 0.7 else 10, score, pattern)
    return tuple(sorted(out, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def _gate() -> tuple[ahocorasick.Automaton, tuple[tuple[tuple[int, Rule], ...], ...]]:
    """An automaton over the literals that a rule needs first, and the rules of each literal."""
    by: dict[bytes, list] = {}
    for k, r in enumerate(rules()):
        for x in r.needs[0]:
            by.setdefault(x, []).append((k, r))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, x in enumerate(by):
        automaton.add_word(x.decode("latin-1"), k)
    automaton.make_automaton()
    return automaton, tuple(map(tuple, by.values()))


def candidates(padded: bytes) -> list[Rule]:
    """The rules whose literals occur, in order; no other rule can match."""
    automaton, by = _gate()
    seen = {k for _, k in automaton.iter(padded.decode("latin-1"))}
    found = {k: r for x in seen for k, r in by[x] if all(any(y in padded for y in c) for c in r.needs[1:])}
    return [found[k] for k in sorted(found)]


_CLEAN = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def detect(padded: bytes) -> list[Found]:
    """The detections that stay; ``padded`` is the words joined by single blanks, with one at each end."""
    hits = [Found(m.start(), m.end(), r) for r in candidates(padded) for m in r.pattern.finditer(padded)]
    kept: list[Found] = []
    starts, ends = [], []  # of kept intervals that lie in no other; both ascend
    for h in sorted(hits, key=lambda h: (-h.rule.priority, h.start - h.end, h.start, h.rule.label)):
        at = bisect_right(starts, h.start)
        if at and ends[at - 1] >= h.end:
            continue
        kept.append(h)
        inner, behind = bisect_left(starts, h.start), bisect_right(ends, h.end)
        starts[inner:behind], ends[inner:behind] = [h.start], [h.end]
    return kept


def listed(padded: bytes, kept: list[Found]) -> list[Found]:
    """Licenses that a list adds behind a detection (``Apache-2.0 OR MIT``): at each place the longest name, the first label among equals, until none follows.

    A name that lies within a detection is not added again.
    """
    out: list[Found] = []
    for h in kept:
        word = padded[padded.rindex(b" ", 0, h.end) : h.end]
        at = h.end - len(word) * (word in (b" and", b" or"))  # a rule may end with the list's first link
        while padded[at + 1 : at + 4] == b"or " or padded[at + 1 : at + 5] == b"and ":
            found = [(m.end(), -k, label, score, p) for k, (label, score, p) in enumerate(_listed()) if (m := p.match(padded, at + 1))]
            if not found:
                break
            end, _, label, score, pattern = max(found, key=lambda f: f[:2])
            begin = padded.index(b" ", at + 1) + 1
            if not any(o.start <= begin and end <= o.end for o in (*kept, *out)):
                out.append(Found(begin, end, Rule(label, 0, score, (), pattern)))
            at = end
    return out


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN).split()
    padded = b" " + b" ".join(tokens) + b" "
    places, base = [], set()
    for phrase, label in BASE:
        want, at = f" {phrase} ".encode(), -1
        while (at := padded.find(want, at + 1)) >= 0:
            places.append(at)
            base.add(label)
    kept = detect(padded)
    kept += listed(padded, kept)
    if not places and not kept:
        return len(tokens), 0, None, None, "", "", 0.0, []
    blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
    word = lambda at: int(np.searchsorted(blanks, at))  # noqa: E731  blanks before a place
    labels = base | {k.rule.label for k in kept}
    score = max([BASE_SCORE * bool(base), *(k.rule.score for k in kept)])
    spans = [f"{k.rule.label}:{word(k.start) - 1}:{word(k.end) - 1}" for k in sorted(kept, key=lambda k: (k.start, k.end, k.rule.label))]
    first, last = (word(min(places)), word(max(places))) if places else (None, None)
    return len(tokens), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), float(score), spans


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<string>"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts and places of base phrases, labels, score and detected spans (label:first:behind, in words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            columns = list(zip(*(scan(t.as_py()) for t in b.column(1)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)
