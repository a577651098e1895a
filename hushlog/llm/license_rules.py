"""Signature rules for licences, written by hand over normalised words.

A pattern sees lower-case words with one space between any two. A family has a label, a keyword that
every text with one of its names holds, and its names. Forms turn a name into signatures of falling
certainty; notices are sentences of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Priorities with the certainty of each.
CERTAINTY = {4: 0.98, 3: 0.9, 2: 0.75, 1: 0.5}


@dataclass(frozen=True)
class Signature:
    label: str
    priority: int
    keyword: str
    pattern: str


V = r"(?:version |v ?)?"
LATER = r"(?: (?:or|and) (?:\(at your option\) |at your option )?(?:any )?later(?: versions?)?| plus)"
GPL, GPL_SHORT = r"(?:gnu )?general public licen[sc]e", r"(?:gnu )?gpl"
LGPL, LGPL_SHORT = r"(?:gnu )?(?:lesser|library) (?:general )?public licen[sc]e", r"(?:gnu )?lgpl"
AGPL, AGPL_SHORT = r"(?:gnu )?affero (?:general )?public licen[sc]e", r"(?:gnu )?agpl"
FDL = r"(?:gnu )?free documentation licen[sc]e"
OF_CC = r"(?: licen[sc]e)?"

#: label, keyword, name of the licence
FAMILIES: tuple[tuple[str, str, str], ...] = (
    ("gpl-1.0", "general public", rf"{GPL} {V}1(?: 0)?"),
    ("gpl-2.0", "general public", rf"{GPL} {V}2(?: 0)?"),
    ("gpl-2.0-or-later", "general public", rf"{GPL} {V}2(?: 0)?{LATER}"),
    ("gpl-3.0", "general public", rf"{GPL} {V}3(?: 0)?"),
    ("gpl-3.0-or-later", "general public", rf"{GPL} {V}3(?: 0)?{LATER}"),
    ("gpl-1.0", "gpl", rf"{GPL_SHORT} {V}1(?: 0)?"),
    ("gpl-2.0", "gpl", rf"(?:{GPL_SHORT} {V}2(?: 0)?|gplv2)"),
    ("gpl-2.0-or-later", "gpl", rf"(?:{GPL_SHORT} {V}2(?: 0)?|gplv2){LATER}"),
    ("gpl-3.0", "gpl", rf"(?:{GPL_SHORT} {V}3(?: 0)?|gplv3)"),
    ("gpl-3.0-or-later", "gpl", rf"(?:{GPL_SHORT} {V}3(?: 0)?|gplv3){LATER}"),
    ("gpl", "general public", r"gnu general public licen[sc]e"),
    ("lgpl-2.0", "public", rf"{LGPL} {V}2(?: 0)?"),
    ("lgpl-2.1", "public", rf"{LGPL} {V}2 1"),
    ("lgpl-2.1-or-later", "public", rf"{LGPL} {V}2 1{LATER}"),
    ("lgpl-3.0", "public", rf"{LGPL} {V}3(?: 0)?"),
    ("lgpl-3.0-or-later", "public", rf"{LGPL} {V}3(?: 0)?{LATER}"),
    ("lgpl-2.0", "lgpl", rf"(?:{LGPL_SHORT} {V}2(?: 0)?|lgplv2)"),
    ("lgpl-2.1", "lgpl", rf"(?:{LGPL_SHORT} {V}2 1|lgplv2 1)"),
    ("lgpl-2.1-or-later", "lgpl", rf"(?:{LGPL_SHORT} {V}2 1|lgplv2 1){LATER}"),
    ("lgpl-3.0", "lgpl", rf"(?:{LGPL_SHORT} {V}3(?: 0)?|lgplv3)"),
    ("lgpl-3.0-or-later", "lgpl", rf"(?:{LGPL_SHORT} {V}3(?: 0)?|lgplv3){LATER}"),
    ("lgpl", "lesser general", r"gnu lesser general public licen[sc]e"),
    ("agpl-1.0", "affero", rf"{AGPL} {V}1(?: 0)?"),
    ("agpl-3.0", "affero", rf"{AGPL} {V}3(?: 0)?"),
    ("agpl-3.0-or-later", "affero", rf"{AGPL} {V}3(?: 0)?{LATER}"),
    ("agpl-1.0", "agpl", rf"{AGPL_SHORT} {V}1(?: 0)?"),
    ("agpl-3.0", "agpl", rf"(?:{AGPL_SHORT} {V}3(?: 0)?|agplv3)"),
    ("agpl-3.0-or-later", "agpl", rf"(?:{AGPL_SHORT} {V}3(?: 0)?|agplv3){LATER}"),
    ("agpl", "affero", AGPL),
    ("agpl", "agpl", AGPL_SHORT),
    ("gfdl-1.1", "free documentation", rf"{FDL} {V}1 1"),
    ("gfdl-1.2", "free documentation", rf"{FDL} {V}1 2"),
    ("gfdl-1.3", "free documentation", rf"{FDL} {V}1 3"),
    *[
        (f"gfdl-1.{minor}", short, rf"(?:gnu )?{short} {V}1 {minor}")
        for short in ("gfdl", "fdl")
        for minor in (1, 2, 3)
    ],
    ("gfdl", "free documentation", r"gnu free documentation licen[sc]e"),
    ("apache-1.0", "apache", rf"apache(?: software)? licen[sc]e {V}1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[sc]e {V}1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)? licen[sc]e {V}2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)?"),
    ("apache", "apache", r"apache software licen[sc]e"),
    ("mit", "mit", r"(?:the )?mit licen[sc]e"),
    ("mit-0", "mit no", r"mit no attribution(?: licen[sc]e)?"),
    ("x11", "x11", r"(?:mit )?x11 licen[sc]e"),
    ("bsd-0-clause", "bsd", r"(?:bsd 0 clause|0 clause bsd|zero clause bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?"),
    ("bsd-2-clause", "freebsd", r"freebsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|(?:new|modified|revised) bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?"),
    ("bsd", "bsd", r"(?:the )?bsd licen[sc]e"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("mpl-1.0", "mozilla", rf"mozilla public licen[sc]e {V}1 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[sc]e {V}1 1"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[sc]e {V}2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("mpl-1.1", "mpl", r"mpl (?:v )?1 1"),
    ("mpl-2.0", "mpl", r"mpl (?:v )?2(?: 0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[sc]e {V}1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[sc]e {V}2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e(?: version 1| v 1)?(?: 0)?"),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?: version 1| v 1)?(?: 0)?"),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e(?: version 1)?(?: 0)?"),
    ("cddl-1.0", "common development", rf"common development and distribution licen[sc]e(?: {V}1 0)?"),
    ("cddl-1.1", "common development", rf"common development and distribution licen[sc]e {V}1 1"),
    ("eupl-1.1", "european union public", rf"european union public licen[sc]e {V}1 1"),
    ("eupl-1.2", "european union public", rf"european union public licen[sc]e {V}1 2"),
    ("eupl", "european union public", r"european union public licen[sc]e"),
    ("artistic-1.0", "artistic", rf"artistic licen[sc]e {V}1(?: 0)?"),
    ("artistic-2.0", "artistic", rf"artistic licen[sc]e {V}2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: version 1)?(?: 0)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: version 1 1| 1 1)?"),
    ("elastic-2.0", "elastic licen", r"elastic licen[sc]e(?: version 2| 2)?(?: 0)?"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?: version 1| v1)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: version 1 1| 1 1)?"),
    ("unlicense", "unlicen", r"the unlicen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl(?: version 2| v2)?"),
    ("python-2.0", "python", r"python software foundation licen[sc]e(?: version 2)?"),
    ("python-2.0", "psf", r"psf licen[sc]e(?: version 2)?"),
    ("php-3.01", "php", r"php licen[sc]e(?: version)? 3 0?1"),
    ("php-3.0", "php", r"php licen[sc]e(?: version)? 3 0"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("perl", "perl", r"(?:same terms as perl itself|terms of perl itself)"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("osl-3.0", "open software", rf"open software licen[sc]e(?: {V}3 0)?"),
    ("afl-3.0", "academic free", rf"academic free licen[sc]e(?: {V}3 0)?"),
    ("qpl-1.0", "q public", rf"q public licen[sc]e(?: {V}1 0)?"),
    ("lppl-1.3", "latex", r"latex project public licen[sc]e(?: version 1 3[ac]?)?"),
    ("odbl-1.0", "open database", r"open database licen[sc]e(?: v1 0| 1 0)?"),
    ("odbl-1.0", "open open database", r"open open database licen[sc]e(?: v1 0| 1 0)?"),
    ("odbl-1.0", "open data commons", r"open data commons (?:open )?database licen[sc]e(?: v1 0| 1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e(?: v1 0| 1 0)?"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[sc]e(?: v1 0| 1 0)?"),
    ("cdla-permissive-2.0", "community data", r"community data licen[sc]e agreement permissive(?: version)? 2 0"),
    ("cdla-sharing-1.0", "community data", r"community data licen[sc]e agreement sharing(?: version)? 1 0"),
    ("openrail", "openrail", r"(?:creativeml )?openrail(?: m| s)?(?: licen[sc]e)?"),
    ("llama-community", "llama", r"llama(?: \d+(?: \d+)?)? community licen[sc]e(?: agreement)?"),
    ("ogl-3.0", "open government", r"open government licen[sc]e(?: v3| version 3)?(?: 0)?"),
    ("vim", "vim licen", r"vim licen[sc]e"),
    ("beerware", "beer", r"beer ?ware licen[sc]e"),
    ("json", "json", r"json licen[sc]e"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[sc]e"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e(?: v 1 0| version 1 0)?"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:permissive software licen[sc]e|psl) v?2"),
    ("cecill-2.1", "cecill", r"cecill(?: licen[sc]e)?(?: version)? 2 1"),
    ("cecill", "cecill", r"cecill(?: free software)? licen[sc]e"),
    *[
        (f"cc-{label}-{v}", f"{cc} {word}", rf"{cc} {names} {v.replace('.', ' ')}(?: (?:international|unported|generic))?")
        for cc in ("cc", "creative commons")
        for label, word, names in (
            ("by", "by", r"by"),
            ("by-sa", "by", r"by sa"),
            ("by-nc", "by", r"by nc"),
            ("by-nd", "by", r"by nd"),
            ("by-nc-sa", "by", r"by nc sa"),
            ("by-nc-nd", "by", r"by nc nd"),
            ("by", "attribution", rf"attribution{OF_CC}"),
            ("by-sa", "attribution", rf"attribution share ?alike{OF_CC}"),
            ("by-nc", "attribution", rf"attribution non ?commercial{OF_CC}"),
            ("by-nd", "attribution", rf"attribution no ?deriv(?:ative)?s?(?: works)?{OF_CC}"),
            ("by-nc-sa", "attribution", rf"attribution non ?commercial share ?alike{OF_CC}"),
            ("by-nc-nd", "attribution", rf"attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?{OF_CC}"),
        )
        for v in ("2.0", "3.0", "4.0")
    ],
    ("cc-by-sa", "cc by sa", r"cc by sa"),
    ("cc-by-nc", "cc by nc", r"cc by nc"),
    ("cc-by-nd", "cc by nd", r"cc by nd"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
)

GRANT = (
    r"(?:licen[sc]ed|released|distributed|published|available|provided|offered|covered|redistributed?)"
    r"(?: to you)? (?:under|by|subject to)(?: the)?(?: terms (?:and conditions )?of)?(?: the| a| an)?"
)

#: label, priority, keyword, pattern
NOTICES: tuple[tuple[str, int, str, str], ...] = (
    ("mit", 3, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 3, "the software is provided", r"the software is provided as is without warranty of any kind express or implied"),
    ("isc", 3, "permission to use", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 3, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 3, "endorse or promote", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 3, "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("gpl", 3, "free software", r"this program is free software you can redistribute it and or modify"),
    ("gpl-2.0-or-later", 3, "either version", r"either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", 3, "either version", r"either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl", 3, "free software", r"this library is free software you can redistribute it and or modify"),
    ("gpl", 2, "gnu org licenses", r"www gnu org licenses gpl(?: \d 0)?(?: html| txt)?"),
    ("lgpl", 2, "gnu org licenses", r"www gnu org licenses lgpl(?: \d \d)?(?: html| txt)?"),
    ("agpl", 2, "gnu org licenses", r"www gnu org licenses agpl(?: \d 0)?(?: html| txt)?"),
    ("gfdl", 2, "gnu org licenses", r"www gnu org licenses fdl(?: \d \d)?(?: html| txt)?"),
    ("apache-2.0", 2, "apache org licenses", r"www apache org licenses licen[sc]e 2 0(?: html| txt)?"),
    ("mpl-2.0", 2, "mozilla org", r"mozilla org mpl 2 0"),
    ("mit", 2, "opensource org", r"opensource org licenses? mit(?: licen[sc]e)?"),
    ("bsd-3-clause", 2, "opensource org", r"opensource org licenses? bsd 3 clause"),
    ("bsd-2-clause", 2, "opensource org", r"opensource org licenses? bsd 2 clause"),
    ("zlib", 3, "in no event will the authors", r"in no event will the authors be held liable for any damages arising from the use"),
    ("bsl-1.0", 3, "boost", r"boost software licen[sc]e version 1 0 august 17th 2003"),
    ("unlicense", 3, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 3, "what the", r"do what the f\S* you want to public licen[sc]e"),
    ("public-domain", 2, "public domain", r"(?:released|placed|dedicated)(?: in)?(?: in)?to the public domain"),
    ("public-domain", 1, "public domain", r"(?:is|are) in the public domain"),
    ("proprietary", 2, "all rights reserved", r"all rights reserved"),
    ("proprietary", 3, "proprietary and confidential", r"proprietary and confidential"),
    ("proprietary", 3, "confidential and proprietary", r"confidential and proprietary"),
    ("proprietary", 2, "may not be", r"may not be (?:reproduced|copied)(?: or (?:distributed|transmitted))?(?: in any form)?(?: without| in whole)"),
    ("copyright", 1, "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", 1, "copyright", r"copyright holders?"),
    *[
        (f"cc-{kind}", 2, "creativecommons org", rf"creativecommons org licenses {kind.replace('-', ' ')} \d 0(?: \w\w)?")
        for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
    ],
    ("cc0-1.0", 2, "creativecommons org", r"creativecommons org publicdomain zero 1 0"),
)

#: Phrases whose places are always counted and whose labels always stay.
BASE: tuple[tuple[str, str], ...] = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

#: Labels that are no SPDX identifier, with the identifiers they have, if any.
OTHER_IDS: dict[str, tuple[str, ...]] = {
    "bsd-0-clause": ("0bsd",),
    "lppl-1.3": ("lppl-1.3a", "lppl-1.3c"),
    "mulan-psl-2.0": ("mulanpsl-2.0",),
    "ogl-3.0": ("ogl-uk-3.0",),
    "python-2.0": ("python-2.0", "psf-2.0"),
} | dict.fromkeys(
    ("gpl", "lgpl", "agpl", "gfdl", "apache", "bsd", "mpl", "epl", "eupl", "artistic", "cecill", "edl-1.0", "perl", "openrail",
     "llama-community", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"), ()
)


def signatures() -> list[Signature]:
    """All rules in order: of two on the same words, the one with the higher priority comes first."""
    rules = [Signature(label, priority, keyword, pattern) for label, priority, keyword, pattern in NOTICES]
    for label, keyword, name in FAMILIES:
        rules.append(Signature(label, 4, keyword, rf"spdx licen[sc]e identifier {name}"))
        rules.append(Signature(label, 3, keyword, rf"{GRANT} {name}"))
        rules.append(Signature(label, 1, keyword, name))
    for label in dict.fromkeys(label for label, _, _ in FAMILIES):
        for name in OTHER_IDS.get(label, (label,)):
            words = name.replace("-", " ").replace(".", " ")
            rules.append(Signature(label, 4, "spdx licen", rf"spdx licen[sc]e identifier {words}(?: only)?"))
    return sorted(rules, key=lambda r: -r.priority)
