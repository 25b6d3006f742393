"""License scans by ordered signature rules.

A text becomes its lower-case words joined by single spaces, so every rule is a regular
expression over words and a match is an interval of words. One Aho-Corasick pass over
the joined words finds the keywords that occur; only rules that have their keyword run. Rules are ordered by
priority. A detection that lies inside the interval of a kept detection of higher priority is suppressed
(a shorter name inside a longer one). The base phrases are rules of the first priority that nothing suppresses.

The signatures are written by hand: names of licenses, as expressions or word for word; short names that count only after words that declare a license
(SPDX ids such as MIT or EPL-2.0); sentences of license texts and notices, as expressions or word for word; exceptions and
statements of a license without its name. The rules for names are their product with
the contexts in which a name is a license statement; contexts change a match's score and interval and find no further licenses. ``SIGNATURES``
is the number of signatures, not of that product.

Defined results: null is an empty text: no words, no labels, score 0; texts are scanned whole;
equal rows get equal results; other columns pass through, and one named like a new
column, in any case, is kept under its name with underscores.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import LOWER, UPPER, set_aside

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, keyword that every match contains, and the names as expressions over words.
LICENSES = [
    ("agpl-3", "affero", r"(?:gnu )?affero general public license(?: version)?(?: v?3)?(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?2 1"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public license(?: version)? v?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license"),
    ("gpl-2", "general", r"(?:gnu )?general public license(?: version)? v?2(?: 0)?"),
    ("gpl-3", "general", r"(?:gnu )?general public license(?: version)? v?3(?: 0)?"),
    ("gpl", "general", r"(?:gnu )?general public license"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?"),
    ("fdl", "documentation", r"(?:gnu )?free documentation license(?: version \d(?: \d)?)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)? ?v?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1"),
    ("apache", "apache", r"apache(?: software)? license"),
    ("mit", "mit", r"mit(?: x11)? license"),
    ("mit", "expat", r"expat license"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:modified|revised|new|3 clause|three clause) bsd license|bsd 3 clause(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd license|bsd 4 clause(?: license)?"),
    ("bsd", "bsd", r"bsd(?: style)? license"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1 1"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("mpl-2", "mpl", r"mpl ?v?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl", "distribution", r"common development and distribution license"),
    ("cpl", "common", r"common public license"),
    ("eupl", "union", r"european union public license(?: v?1 [0-2])?"),
    ("isc", "isc", r"isc license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("bsl-1", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-2", "artistic", r"artistic license(?: version)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("python", "python", r"python software foundation license(?: version 2)?"),
    ("php", "php", r"php license(?: version)?(?: 3 01?)?"),
    ("ruby", "ruby", r"ruby license"),
    ("openssl", "openssl", r"openssl license"),
    ("ofl", "font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("odbl", "database", r"open database license(?: v?1 0)?"),
    ("odc-by", "attribution", r"open data commons attribution license"),
    ("cc-by-nc-nd", "nc", r"(?:cc|creative commons) by nc nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "nc", r"(?:cc|creative commons) by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "nc", r"(?:cc|creative commons) by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "nd", r"(?:cc|creative commons) by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "sa", r"(?:cc|creative commons) by sa(?: [1-4](?: [05])?)?"),
    ("cc-by", "by", r"(?:cc|creative commons) by(?: [1-4](?: [05])?)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "noncommercial", r"creative commons attribution noncommercial no ?derivatives"),
    ("cc-by-nc-sa", "noncommercial", r"creative commons attribution noncommercial share ?alike"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution noncommercial"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike"),
    ("cc-by", "commons", r"creative commons attribution"),
    ("public-domain", "domain", r"public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
]
# Label, keyword and a license's name word for word.
NAMES = [
    ("ms-pl", "microsoft", "microsoft public license"), ("ms-rl", "reciprocal", "microsoft reciprocal license"), ("ipl-1", "ibm", "ibm public license"), ("spl-1", "sun", "sun public license"), ("sleepycat", "sleepycat", "sleepycat license"),
    ("afl-3", "academic", "academic free license"), ("osl-3", "software", "open software license"), ("rpl-1.5", "reciprocal", "reciprocal public license"), ("qpl-1", "q", "q public license"), ("zpl-2", "zope", "zope public license"),
    ("apsl-2", "apple", "apple public source license"), ("nasa-1.3", "nasa", "nasa open source agreement"), ("cecill-2", "cecill", "cecill"), ("cecill-b", "cecill", "cecill b"), ("cecill-c", "cecill", "cecill c"),
    ("mulan-psl-2", "mulan", "mulan permissive software license"), ("blueoak-1", "oak", "blue oak model license"), ("busl-1.1", "business", "business source license"), ("sspl-1", "side", "server side public license"), ("elastic-2", "elastic", "elastic license"),
    ("commons-clause", "clause", "commons clause"), ("polyform-noncommercial", "polyform", "polyform noncommercial license"), ("polyform-small-business", "polyform", "polyform small business license"), ("openrail", "openrail", "openrail"), ("openrail-m", "openrail", "openrail m"),
    ("bigscience-rail", "rail", "bigscience rail license"), ("llama-2", "llama", "llama 2 community license"), ("llama-3", "llama", "llama 3 community license"), ("gemma", "gemma", "gemma terms of use"), ("ogl-3", "government", "open government licence"),
    ("x11", "x11", "x11 license"), ("mit-0", "attribution", "mit no attribution"), ("beerware", "beerware", "beerware license"), ("beerware", "beer", "beer ware license"), ("ncsa", "ncsa", "ncsa open source license"), ("ncsa", "illinois", "university of illinois open source license"),
    ("vim", "vim", "vim license"), ("w3c", "w3c", "w3c software notice and license"), ("unicode", "unicode", "unicode license"), ("icu", "icu", "icu license"), ("ftl", "freetype", "freetype license"), ("libpng", "libpng", "libpng license"), ("curl", "curl", "curl license"),
    ("bzip2", "bzip2", "bzip2 license"), ("info-zip", "zip", "info zip license"), ("lppl-1.3", "latex", "latex project public license"), ("erlpl-1.1", "erlang", "erlang public license"), ("cpal-1", "attribution", "common public attribution license"),
    ("ecl-2", "educational", "educational community license"), ("upl-1", "universal", "universal permissive license"), ("ecos-2", "ecos", "ecos license"), ("efl-2", "eiffel", "eiffel forum license"), ("fair", "fair", "fair license"), ("hpnd", "historical", "historical permission notice and disclaimer"),
    ("lpl-1", "lucent", "lucent public license"), ("motosoto", "motosoto", "motosoto open source license"), ("naumen", "naumen", "naumen public license"), ("nokia", "nokia", "nokia open source license"), ("oclc-2", "oclc", "oclc research public license"),
    ("rscpl", "ricoh", "ricoh source code public license"), ("watcom-1", "watcom", "sybase open watcom public license"), ("vsl-1", "vovida", "vovida software license"), ("wxwindows", "wxwindows", "wxwindows library licence"), ("pddl-1", "dedication", "open data commons public domain dedication"),
    ("cdla-permissive", "community", "community data license agreement permissive"), ("cdla-sharing", "community", "community data license agreement sharing"), ("cern-ohl", "cern", "cern open hardware licence"), ("solderpad", "solderpad", "solderpad hardware license"), ("lal-1.3", "art", "free art license"),
    ("dsl", "science", "design science license"), ("tapr-ohl", "tapr", "tapr open hardware license"), ("intel", "intel", "intel open source license"), ("json", "json", "json license"), ("hippocratic", "hippocratic", "hippocratic license"), ("anti-996", "996", "anti 996 license"),
]
# Label, keyword and a sentence of a license's text or notice, an exception or a statement, word for word.
TEXTS = [
    ("apache-2", "compliance", "you may not use this file except in compliance with the license"), ("apache-2", "agreed", "unless required by applicable law or agreed to in writing software"), ("apache-2", "contributor", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license"), ("mpl-2", "mpl", "if a copy of the mpl was not distributed with this file"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"), ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"), ("lgpl", "library", "under the terms of the gnu library general public license"),
    ("gpl", "received", "you should have received a copy of the gnu general public license"), ("lgpl", "received", "you should have received a copy of the gnu lesser general public license"), ("agpl-3", "received", "you should have received a copy of the gnu affero general public license"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"), ("fdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("mit", "portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"), ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "merchantability", "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"), ("x11", "advertising", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("bsd", "retain", "redistributions of source code must retain the above copyright notice this list of conditions"), ("bsd", "reproduce", "redistributions in binary form must reproduce the above copyright notice"), ("bsd", "holders", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-2-clause", "representing", "should not be interpreted as representing official policies"), ("bsd-3-clause-clear", "patent", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"), ("zlib", "plainly", "altered source versions must be plainly marked as such"), ("libpng", "png", "the png reference library is supplied as is"),
    ("isc", "author", "the software is provided as is and the author disclaims all warranties with regard to this software"), ("ncsa", "disclaimers", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("cc0", "waived", "has waived all copyright and related or neighboring rights"), ("cc0", "dedicate", "dedicate any and all copyright interest in the software to the public domain"), ("unlicense", "compile", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "verbatim", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"), ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("artistic", "perl", "you can redistribute it and or modify it under the same terms as perl itself"), ("artistic", "perl", "under the same terms as perl"), ("bsl-1", "boost", "distributed under the boost software license"), ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("python", "python", "psf is making python available to licensee on an as is basis"), ("openssl", "toolkit", "for use in the openssl toolkit"), ("openssl", "ssl", "this package is an ssl implementation written by"), ("php", "php", "this product includes php software freely available from"),
    ("w3c", "modification", "permission to copy modify and distribute this work with or without modification for any purpose"), ("unicode", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"), ("ruby", "bsdl", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl"),
    ("curl", "advertising", "the name of a copyright holder shall not be used in advertising or otherwise to promote the sale use"), ("ijg", "independent", "this software is based in part on the work of the independent jpeg group"), ("beerware", "beer", "you can buy me a beer in return"), ("json", "evil", "the software shall be used for good not evil"),
    ("commons-clause", "sell", "the license does not grant to you the right to sell the software"), ("busl-1.1", "change", "change date change license"), ("sspl-1", "service", "if you make the functionality of the program available to third parties as a service"), ("elastic-2", "hosted", "you may not provide the software to third parties as a hosted or managed service"),
    ("classpath-exception-2", "classpath", "classpath exception"), ("gcc-exception-3.1", "gcc", "gcc runtime library exception"), ("autoconf-exception", "autoconf", "autoconf exception"), ("bison-exception-2.2", "bison", "bison exception"), ("font-exception-2", "font", "font exception"),
    ("llvm-exception", "llvm", "llvm exception"), ("linking-exception", "linking", "linking exception"), ("openssl-exception", "openssl", "openssl exception"), ("foss-exception", "foss", "universal foss exception"), ("u-boot-exception-2", "boot", "u boot exception"), ("qt-lgpl-exception-1.1", "qt", "qt lgpl exception"), ("swift-exception", "swift", "swift exception"), ("linux-syscall-note", "syscall", "linux syscall note"),
    ("public-domain", "domain", "released into the public domain"), ("public-domain", "domain", "placed in the public domain"), ("public-domain", "domain", "dedicated to the public domain"), ("public-domain", "copyright", "no copyright is claimed"), ("us-government-work", "government", "a work of the united states government"),
    ("proprietary", "proprietary", "confidential and proprietary"), ("proprietary", "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"), ("proprietary", "reproduced", "no part of this publication may be reproduced"), ("proprietary", "permission", "may not be reproduced without written permission"), ("proprietary", "secrets", "contains trade secrets"),
    ("non-commercial", "commercial", "for non commercial use only"), ("non-commercial", "commercial", "not for commercial use"), ("non-commercial", "noncommercial", "for noncommercial purposes only"), ("non-commercial", "personal", "free for personal use"), ("non-commercial", "academic", "free for academic use"), ("non-commercial", "research", "for research purposes only"), ("non-commercial", "evaluation", "for evaluation purposes only"),
    ("unspecified", "author", "with the permission of the author"), ("unspecified", "attribution", "attribution is required"), ("unspecified", "redistributed", "may be freely redistributed"), ("unspecified", "copied", "may be freely copied"),
]
#: Keywords that may go on within their word, such as gplv3.
OPEN = {"agpl", "apache", "gpl", "lgpl", "mpl"}
# Contexts, strongest first, with the score of a match (a choice of this scanner); {} stands for the name.
CONTEXTS = [
    (r"spdx license identifier {}", 1.0),
    (r"(?:licen[sc]ed|released|distributed|available|published|offered|provided)(?: to you)? under (?:the )?(?:terms of )?(?:the )?{}", 0.95),
    (r"(?:subject to|according to|governed by|covered by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}", 0.9),
    (r"licen[sc]e(?:s)? (?:is |type |name )?(?:the )?{}", 0.8),
    (r"{}", 0.6),
]
# Label, keyword and a sentence of the license's text or notice over words.
_FSF = r"as published by the free software foundation (?:either )?version"
SENTENCES = [
    ("agpl-3", "affero", rf"(?:gnu )?affero general public license {_FSF} 3"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public license {_FSF} 2 1"),
    ("lgpl-3", "lesser", rf"(?:gnu )?lesser general public license {_FSF} 3"),
    ("gpl-2", "general", rf"(?:gnu |(?<!lesser )(?<!affero ))general public license {_FSF} 2(?! 1)"),
    ("gpl-3", "general", rf"(?:gnu |(?<!lesser )(?<!affero ))general public license {_FSF} 3"),
    ("mit", "hereby", r"permission is hereby granted free of charge(?: to any person obtaining a copy)?(?! to any person or organization)"),
    ("bsl-1", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("isc", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:[^ ]+ ){1,16}?may be used to endorse or promote products"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms"),
    ("zlib", "implied", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("apache-2", "basis", r"software distributed under the license is distributed on an as is basis"),
    ("mpl-2", "mozilla", r"subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("cc0", "publicdomain", r"creativecommons org publicdomain zero"),
    *((f"cc-{x.replace(' ', '-')}", "creativecommons", rf"creativecommons org licenses {x} [1-4] [05]") for x in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")),
    ("unspecified", "warranty", r"without warranty of any kind"),
]
SENTENCE_SCORE = 0.9
#: Labels of sentences that name no license.
WEAK = {"unspecified", "non-commercial", "proprietary", "public-domain"}
# Label and short name, longer ones first; they count only where DECLARATIONS end.
_LATER = r"(?: only| or later)?"
SHORT_NAMES = [
    *((f"{x}-{n}", rf"{x} ?v?{n}(?: 0)?{_LATER}") for x in ("agpl", "gpl", "lgpl") for n in (3, 2) if (x, n) not in (("agpl", 2), ("lgpl", 2))),
    ("lgpl-2.1", rf"lgpl ?v?2 1{_LATER}"), ("lgpl", rf"lgpl(?: ?v?2(?: 0)?)?{_LATER}"), ("gpl", "gpl"), ("apache-1.1", "apache 1 1"), ("apache-2", "apache ?v?2(?: 0)?"), ("apache", "apache"),
    ("mit", "mit"), ("mit", "expat"), ("0bsd", "0bsd"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("bsd", "bsd"),
    ("isc", "isc"), ("zlib", "zlib"), ("mpl-1.1", "mpl 1 1"), ("mpl-2", "mpl ?v?2(?: 0)?"), ("mpl", "mpl"), ("epl-1", "epl ?v?1(?: 0)?"), ("epl-2", "epl ?v?2(?: 0)?"), ("epl", "epl"),
    ("bsl-1", "bsl 1 0"), ("artistic-2", "artistic 2 0"), ("artistic", "artistic(?: 1 0)?"), ("cddl", "cddl(?: 1 [01])?"), ("cpl", "cpl 1 0"), ("eupl", "eupl(?: 1 [0-2])?"),
    ("fdl", rf"gfdl(?: 1 [123])?{_LATER}"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("postgresql", "postgresql"), ("python", "psf 2 0|python 2 0"), ("php", "php 3 01?"), ("ruby", "ruby"), ("openssl", "openssl"),
    ("ofl", "ofl(?: 1 [01])?"), ("odbl", "odbl(?: 1 0)?"), ("odc-by", "odc by(?: 1 0)?"), ("cc0", "cc0(?: 1 0)?"),
    *((f"cc-{x.replace(' ', '-')}", rf"cc {x}(?: [1-4](?: [05])?)?") for x in ("by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by")),
]
# Words that declare a license, with the score of a short name after them (a choice of this scanner), and the words that one of them holds.
DECLARATIONS = [
    (r"spdx license identifier", 1.0),
    (r"(?:(?:dual|double|multi) )?(?:licen[sc]ed|released|distributed|available|published|offered|provided)(?: to you)? under(?: the)?(?: terms of)?(?: the)?(?: gnu)?", 0.95),
    (r"org licenses", 0.95),
    (r"licen[sc]e(?: is| type| name| id| expression)?(?: the)?(?: gnu)?", 0.8),
]
DECLARING = ["license", "licence", "licenses", "licensed", "licenced", "released", "distributed", "available", "published", "offered", "provided"]
SIGNATURES = len(LICENSES) + len(NAMES) + len(SHORT_NAMES) + len(SENTENCES) + len(TEXTS)


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    match: re.Pattern
    score: float
    base: bool = False
    words: int = 0


def rules() -> list[Rule]:
    out = [Rule(0, label, phrase.split()[-1], re.compile(rf"(?<![^ ])(?={re.escape(phrase)}(?![^ ]))"), 1.0, True, len(phrase.split())) for phrase, label in BASE.items()]
    for label, keyword, sentence in [*SENTENCES, *((a, b, re.escape(c)) for a, b, c in sorted(TEXTS, key=lambda x: -len(x[2])))]:
        out.append(Rule(len(out), label, keyword, re.compile(rf"(?<![^ ])(?:{sentence})(?![^ ])"), 0.5 if label in WEAK else SENTENCE_SCORE))
    for context, score in CONTEXTS:
        for label, keyword, name in [*((a, b, re.escape(c)) for a, b, c in sorted(NAMES, key=lambda x: -len(x[2]))), *LICENSES]:
            out.append(Rule(len(out), label, keyword, re.compile(rf"(?<![^ ])(?:{context.format(f'(?:{name})')})(?![^ ])"), score))
    return out


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.machine = ahocorasick.Automaton()
        for word in {r.keyword for r in self.rules}:
            self.machine.add_word(f" {word}" if word in OPEN else f" {word} ", word)
        for word in DECLARING:
            self.machine.add_word(f" {word} ", word)
        self.machine.make_automaton()
        self.declared = [(re.compile(rf"(?<![^ ]){x} "), score) for x, score in DECLARATIONS]
        self.short = re.compile("(?:" + "|".join(f"({x})" for _, x in SHORT_NAMES) + ")(?![^ ])")
        self.joint = re.compile(r" (?:and |or |with )+(?:the )?(?:gnu )?")
        self.table = str.maketrans(UPPER, LOWER)
        self.find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Words of the text; (start, label) of each base place; kept detections (start, end, label, score)."""
        words = self.find(text.translate(self.table)) if text else []
        line = " ".join(words)
        present = {w for _, w in self.machine.iter(f" {line} ")}
        if not present:
            return len(words), [], []
        base, kept = [], []
        spaces = [m.start() for m in re.finditer(" ", line)]
        reach: dict[int, int] = {}  # the furthest end of a kept detection, by its start
        longest = 0
        for rule in self.rules:
            if rule.keyword not in present:
                continue
            for m in rule.match.finditer(line):
                start = bisect_left(spaces, m.start())
                if rule.base:
                    base.append((start, rule.label))
                    end = start + rule.words
                else:
                    end = start + m.group().strip(" ").count(" ") + 1
                    if any(reach.get(a, 0) >= end for a in range(start - longest, start + 1)):
                        continue
                kept.append((start, end, rule.label, rule.score))
                reach[start] = max(end, reach.get(start, 0))
                longest = max(longest, end - start)
        if not present.isdisjoint(DECLARING):
            for start, end, label, score in self.short_names(line, spaces):
                if not any(reach.get(a, 0) >= end for a in range(start - longest, start + 1)):
                    kept.append((start, end, label, score))
                    reach[start] = max(end, reach.get(start, 0))
                    longest = max(longest, end - start)
        return len(words), sorted(base), sorted(kept)

    def short_names(self, line: str, spaces: list[int]):
        """(start, end, label, score) of the short names after each declaration, and of those joined to them by and, or."""
        for declared, score in self.declared:
            for m in declared.finditer(line):
                at = m.end()
                while found := self.short.match(line, at):
                    start = bisect_left(spaces, at)
                    yield start, start + found.group().count(" ") + 1, SHORT_NAMES[found.lastindex - 1][0], score
                    joint = self.joint.match(line, found.end())
                    if not joint:
                        break
                    at = joint.end()


def scan_licenses(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels and score of ``text``.

    score is that of the strongest detection, 0 without any."""
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType())]
    names = [f.name for f in new]
    df = set_aside(df, *names)
    schema = T.StructType([*(f for f in df.schema.fields if f.name not in names), *new])

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for t in batch.column(text).to_pylist():
                n, base, found = scanner.scan(t)
                rows.append((n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted({x[2] for x in found})), max((x[3] for x in found), default=0.0)))
            kept = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([r[i] for r in rows], k) for i, k in enumerate([pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]))], [*kept, *names])

    return df.mapInArrow(run, schema)
