"""The signature rules of the license scan, built from families and forms.

A rule is a regular expression over the lower-cased UTF-8 bytes of a text, a
keyword that must occur, blank runs read as one space, before the expression is tried, a label, a priority (a
smaller number wins) and a weight between 0 and 1.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    keyword: bytes
    pattern: re.Pattern


# Label, SPDX identifier, name as a pattern, keyword of the name, versions.
FAMILIES = [
    ("mit", "mit", r"(?:mit|expat)[ -]license", b"license", ()),
    ("apache", "apache", r"apache (?:software )?license", b"apache", ("1.0", "1.1", "2.0")),
    ("gpl", "gpl", r"gnu (?:general public license|gpl)", b"gnu g", ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", r"gnu (?:lesser|library) general public license", b"general public", ("2.0", "2.1", "3.0")),
    ("agpl", "agpl", r"gnu affero general public license", b"affero", ("1.0", "3.0")),
    ("fdl", "gfdl", r"gnu free documentation license", b"free documentation", ("1.1", "1.2", "1.3")),
    ("mpl", "mpl", r"mozilla public license", b"mozilla", ("1.0", "1.1", "2.0")),
    ("epl", "epl", r"eclipse public license", b"eclipse", ("1.0", "2.0")),
    ("cddl", "cddl", r"common development and distribution license", b"common development", ("1.0", "1.1")),
    ("cpl", "cpl", r"common public license", b"common public", ("1.0",)),
    ("eupl", "eupl", r"european union public licen[cs]e", b"european union", ("1.0", "1.1", "1.2")),
    ("bsd-2-clause", "bsd-2-clause", r"(?:bsd[ -]2[ -]clause|simplified bsd|freebsd) license", b"bsd", ()),
    ("bsd-3-clause", "bsd-3-clause", r"(?:bsd[ -]3[ -]clause|(?:new|revised|modified) bsd) license", b"bsd", ()),
    ("bsd-4-clause", "bsd-4-clause", r"(?:bsd[ -]4[ -]clause|original bsd) license", b"bsd", ()),
    ("bsd", "0bsd", r"(?:zero[ -]clause )?bsd license", b"bsd", ()),
    ("isc", "isc", r"isc license", b"isc license", ()),
    ("zlib", "zlib", r"zlib(?:/libpng)? license", b"zlib", ()),
    ("boost", "bsl", r"boost software license", b"boost", ("1.0",)),
    ("artistic", "artistic", r"artistic license", b"artistic", ("1.0", "2.0")),
    ("unlicense", "unlicense", r"the unlicense", b"unlicense", ()),
    ("wtfpl", "wtfpl", r"do what the f\w+ you want to public license", b"do what the", ()),
    ("cc0", "cc0", r"cc ?(?:0|zero)", b"cc", ("1.0",)),
    ("cc0", "cc0", r"creative commons zero", b"creative commons", ("1.0",)),
    ("python", "psf", r"python software foundation license", b"python software", ("2.0",)),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", b"postgresql", ()),
    ("openssl", "openssl", r"openssl license", b"openssl", ()),
    ("ofl", "ofl", r"sil open font license", b"open font", ("1.0", "1.1")),
    ("ms-pl", "ms-pl", r"microsoft public license", b"microsoft", ()),
    ("ms-rl", "ms-rl", r"microsoft reciprocal license", b"microsoft", ()),
    ("afl", "afl", r"academic free license", b"academic free", ("2.1", "3.0")),
    ("osl", "osl", r"open software license", b"open software", ("2.1", "3.0")),
    ("ncsa", "ncsa", r"university of illinois/ncsa open source license", b"ncsa", ()),
    ("cecill", "cecill", r"cecill(?: free software)? licen[cs]e", b"cecill", ("2.0", "2.1")),
    ("ecl", "ecl", r"educational community license", b"educational community", ("1.0", "2.0")),
    ("odbl", "odbl", r"open database licen[cs]e", b"open database", ("1.0",)),
    ("pddl", "pddl", r"public domain dedication and licen[cs]e", b"public domain", ("1.0",)),
    ("mulan", "mulanpsl", r"mulan permissive software license", b"mulan", ("1.0", "2.0")),
    ("upl", "upl", r"universal permissive license", b"universal permissive", ("1.0",)),
    ("busl", "busl", r"business source license", b"business source", ("1.1",)),
    ("sspl", "sspl", r"server side public license", b"server side", ("1.0",)),
    ("elastic", "elastic", r"elastic license", b"elastic", ("2.0",)),
]

# Creative Commons conditions as written short and in full, and their versions.
COMMONS = {
    "cc-by": "attribution", "cc-by-sa": "attribution[ -]share ?-?alike", "cc-by-nd": "attribution[ -]no ?-?deriv(?:ative)?s(?: works)?",
    "cc-by-nc": "attribution[ -]non ?-?commercial", "cc-by-nc-sa": "attribution[ -]non ?-?commercial[ -]share ?-?alike",
    "cc-by-nc-nd": "attribution[ -]non ?-?commercial[ -]no ?-?deriv(?:ative)?s(?: works)?",
}
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Sentences of full license texts.
SENTENCES = [
    ("mit", b"permission", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("isc", b"permission", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose"),
    ("bsd", b"redistribution", r"redistribution and use in source and binary forms,? with or without modification"),
    ("apache", b"compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", b"redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", b"redistribute", r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", b"redistribute", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("mpl", b"source code form", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", b"unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", b"as-is", r"this software is provided 'as-is',? without any express or implied warranty"),
    ("boost", b"derivative works", r"copies of the software,? in whole or in part,? and all derivative works of the software"),
    ("public-domain", b"public domain", r"(?:dedicated|released|placed) (?:in|in ?to) the public domain"),
    ("proprietary", b"confidential and", r"confidential and proprietary"),
    ("proprietary", b"all rights reserved", r"all rights reserved\. no part of"),
]
NOTICE = r"(?:licensed|released|distributed|available|provided|published|offered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:a )?"


def _pattern(text: str) -> re.Pattern:
    """Blanks match any run of blanks; a match does not begin or end inside a word."""
    text = text.replace("[ -]", r"[\x20\t\r\n-]").replace(" ?", r"[\x20\t\r\n]*").replace(" ", r"[\x20\t\r\n]+")
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + text.encode() + rb")(?![0-9a-z\x80-\xff])")


def _version(version: str) -> str:
    major, minor = version.split(".")
    tail = rf"(?:\.{minor})?" if minor == "0" else rf"\.{minor}"
    return rf",? ?(?:\([a-z]?gpl\) ?)?(?:version |v\.? ?)?{major}{tail}"


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in their order. Priorities: identifiers, full sentences, versioned notices, notices, versions, bare names."""
    out: list[Rule] = []
    for label, spdx, name, keyword, versions in FAMILIES:
        ident = re.escape(spdx) + (r"-[0-9.]+" if versions else "") + r"(?:-only|-or-later|\+)?"
        out.append(Rule(label, 10, 1.0, b"spdx", _pattern(rf"spdx-license-identifier: ?{ident}")))
        for version in versions:
            full = f"{label}-{version}"
            out.append(Rule(full, 5, 1.0, b"spdx", _pattern(rf"spdx-license-identifier: ?{re.escape(spdx)}-{re.escape(version)}(?:-only|-or-later|\+)?")))
            out.append(Rule(full, 30, 0.9, keyword, _pattern(NOTICE + name + _version(version))))
            out.append(Rule(full, 50, 0.7, keyword, _pattern(name + _version(version))))
        out.append(Rule(label, 40, 0.8, keyword, _pattern(NOTICE + name)))
        out.append(Rule(label, 60, 0.5, keyword, _pattern(name)))
    for label, words in COMMONS.items():
        short = label.replace("-", "[ -]")
        for version in COMMONS_VERSIONS:
            number = re.escape(version)
            out.append(Rule(f"{label}-{version}", 30, 0.9, b"cc", _pattern(rf"{NOTICE}{short}[ -]?{number}")))
            out.append(Rule(f"{label}-{version}", 50, 0.7, b"cc", _pattern(rf"{short}[ -]?{number}")))
            out.append(Rule(f"{label}-{version}", 50, 0.7, b"creative commons", _pattern(rf"creative commons {words}(?: license)?,? (?:version )?{number}")))
        out.append(Rule(label, 45, 0.8, b"creativecommons.org", _pattern(rf"creativecommons\.org/licenses/{label[3:]}/[0-9.]+")))
        out.append(Rule(label, 60, 0.5, b"cc", _pattern(short)))
        out.append(Rule(label, 60, 0.5, b"creative commons", _pattern(rf"creative commons {words}")))
    for label, keyword, text in SENTENCES:
        out.append(Rule(label, 20, 0.95, keyword, _pattern(text)))
    return tuple(sorted(out, key=lambda r: (r.priority, r.label)))
