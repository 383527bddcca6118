"""Signatures of licences over normalised text: lower-case words (digits, a-z, non-ASCII) with one space between."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    """``pattern`` is looked for only in texts that contain ``keyword``. Priority 1 is the best."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


#: One of these is in every text that any rule can match.
STEMS = (
    "licen", "gpl", "copyright", "copyleft", "public domain", "publicdomain", "permission", "redistribut", "spdx", "rights reserved", "warrant", "cc0",
    "creative commons", "cc by", "liable", " bsd", "substantial portions", "endorse", "advertising", "remotely", "misrepresented", "you want to", "reserved font",
    "openssl", "beer", "for good", "proprietary", "commercial use", "derivative", "no attribution",
)

#: Label, keyword, and how the licence is named in running text.
NAMES = (
    ("mit", "licen", "(?:mit|x11|expat) licen[cs]e"),
    ("mit-0", "no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("apache-1.0", "apache", "apache(?: software)? licen[cs]e(?: version)? 1 0"),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version)? 1 1"),
    ("apache-2.0", "apache", "apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("apache", "apache", "apache(?: software)? licen[cs]e"),
    ("bsd-1-clause", "bsd", "(?:1|one) clause bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", "(?:(?:2|two) clause|simplified|freebsd) bsd(?: licen[cs]e)?"),
    ("bsd-3-clause", "bsd", "(?:(?:3|three) clause|new|revised|modified) bsd(?: licen[cs]e)?"),
    ("bsd-4-clause", "bsd", "(?:(?:4|four) clause|original|old) bsd(?: licen[cs]e)?"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e"),
    ("0bsd", "bsd", "(?:0|zero) clause bsd(?: licen[cs]e)?"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("gpl", "general public", "(?:gnu )?general public licen[cs]e"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl(?: version| v|v)? ?2(?: 0)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl(?: version| v|v)? ?3(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.0", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("lgpl-2.1", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?2 1"),
    ("lgpl-3.0", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version| v|v)? ?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl(?: version| v|v)? ?3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", "(?:gnu )?agpl(?:(?: version| v|v)? ?3(?: 0)?)?"),
    ("gfdl-1.1", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 1"),
    ("gfdl-1.2", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 2"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 3"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e"),
    ("mpl-1.0", "mozilla", "mozilla public licen[cs]e(?: version| v)? ?1 0"),
    ("mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version| v)? ?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("epl", "eclipse", "eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?"),
    ("eupl-1.1", "european union", "european union public licen[cs]e(?: version| v)? ?1 1"),
    ("eupl-1.2", "european union", "european union public licen[cs]e(?: version| v)? ?1 2"),
    ("cddl-1.0", "common development", "common development and distribution licen[cs]e(?:(?: version| v)? ?1 0)?"),
    ("cddl-1.1", "common development", "common development and distribution licen[cs]e(?: version| v)? ?1 1"),
    ("cpl-1.0", "common public", "common public licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e"),
    ("isc", "isc", "isc licen[cs]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("libpng", "libpng", "libpng licen[cs]e"),
    ("boost-1.0", "boost", "boost software licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?"),
    ("unlicense", "unlicen", "(?:the )?unlicen[cs]e"),
    ("wtfpl", "do what", "do what the .{1,8} you want to public licen[cs]e"),
    ("artistic-1.0", "artistic", "artistic licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("artistic", "artistic", "artistic licen[cs]e"),
    ("psf-2.0", "python", "python(?: software foundation)? licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?"),
    ("php-3.01", "php", "php licen[cs]e(?:(?: version| v)? ?3 01)?"),
    ("ruby", "ruby", "ruby(?: s)? licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("ofl-1.1", "open font", "(?:sil )?open font licen[cs]e(?:(?: version| v)? ?1 1)?"),
    ("afl-3.0", "academic free", "academic free licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?"),
    ("osl-3.0", "open software", "open software licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?"),
    ("upl-1.0", "universal permissive", "universal permissive licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[cs]e"),
    ("bsl-1.1", "business source", "business source licen[cs]e(?:(?: version| v)? ?1 1)?"),
    ("sspl-1.0", "server side", "server side public licen[cs]e(?:(?: version| v)? ?1)?"),
    ("elastic-2.0", "elastic", "elastic licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?"),
    ("mulan-2.0", "mulan", "mulan(?: permissive software)? licen[cs]e(?:(?: version| v)? ?2)?"),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?"),
    ("w3c", "w3c", "w3c software(?: notice and)? licen[cs]e"),
    ("vim", "vim", "vim licen[cs]e"),
    ("beerware", "beer", "beer ?ware licen[cs]e"),
    ("json", "json", "json licen[cs]e"),
    ("odbl-1.0", "open database", "open database licen[cs]e(?:(?: version| v)? ?1 0)?"),
    ("odc-by-1.0", "data commons", "open data commons attribution licen[cs]e(?:(?: version| v)? ?1 0)?"),
    ("pddl-1.0", "public domain", "public domain dedication and licen[cs]e"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?derivs?(?:atives)?(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?derivs?(?:atives)?(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?"),
    ("cc", "creative commons", "creative commons licen[cs]e"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?"),
)

#: Identifiers after "SPDX-License-Identifier:".
SPDX = (
    "mit", "mit-0", "apache-1.0", "apache-1.1", "apache-2.0", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd",
    "gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-1.0", "agpl-3.0", "gfdl-1.1", "gfdl-1.2", "gfdl-1.3",
    "mpl-1.0", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "eupl-1.1", "eupl-1.2", "cddl-1.0", "cddl-1.1", "cpl-1.0", "ms-pl", "ms-rl",
    "isc", "zlib", "libpng", "bsl-1.0", "unlicense", "wtfpl", "artistic-1.0", "artistic-2.0", "psf-2.0", "php-3.01", "ruby", "postgresql",
    "openssl", "ofl-1.1", "afl-3.0", "osl-3.0", "upl-1.0", "ncsa", "busl-1.1", "sspl-1.0", "elastic-2.0", "cecill-2.1", "w3c", "vim", "json",
    "odbl-1.0", "odc-by-1.0", "pddl-1.0", "cc0-1.0", "cc-by-3.0", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0",
    "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0",
)

#: Sentences of licence texts and notices: label, keyword, pattern.
SENTENCES = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "apache", "you may not use this file except in compliance with the licen[cs]e .{0,80}apache"),
    ("apache-2.0", "perpetual", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("gpl", "useful", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "everyone is permitted", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("agpl", "remotely", "interacting with it remotely through a computer network"),
    ("mpl-2.0", "mozilla", "subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("boost-1.0", "boost", "distributed under the boost software licen[cs]e version 1 0"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("wtfpl", "you want to", "you just do what the .{1,8} you want to"),
    ("public-domain", "public domain", "(?:released|placed|dedicated|is)(?: in| into| to)? the public domain"),
    ("public-domain", "public domain", "no copyright is claimed .{0,80}public domain"),
    ("cc", "creativecommons", "creativecommons org licen[cs]es (?:by|by sa|by nc|by nd|by nc sa|by nc nd) [1-4] [05]"),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", "waived", "waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "reserved font", "with reserved font name"),
    ("psf-2.0", "python software", "python software foundation all rights reserved"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("json", "for good", "the software shall be used for good not evil"),
    ("w3c", "being provided", "this work is being provided by the copyright holders under the following licen[cs]e"),
    ("warranty-disclaimer", "as is", "(?:software|work|program|file) is provided as is without warrant(?:y|ies) of any kind"),
    ("warranty-disclaimer", "merchantability", "implied warrant(?:y|ies) of merchantability"),
    ("warranty-disclaimer", "liable", "in no event shall .{1,80} be liable for any"),
    ("copyright-notice", "copyright", "copyright(?: c| ©)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright-notice", "copyright", "(?:c|©) copyright"),
    ("reserved", "rights reserved", "(?:all|some|no) rights reserved"),
    ("reserved", "written permission", "without (?:the )?(?:prior |express )*written permission of the (?:copyright )?(?:owner|holder|publisher|author)s?"),
    ("proprietary", "proprietary", "(?:confidential and proprietary|proprietary and confidential|proprietary licen[cs]e)"),
    ("commercial", "commercial licen", "(?:under a |a )?commercial licen[cs]e(?: agreement)?"),
    ("non-commercial", "commercial use", "(?:for )?non ?commercial use only"),
    ("eula", "end user", "end user licen[cs]e agreement"),
    ("dual", "dual licen", "dual licen[cs]ed"),
    ("copyleft", "copyleft", "(?:strong |weak )?copyleft"),
    ("see-license", "licen", "(?:see|read) (?:the )?licen(?:[cs]e|[cs]ing)(?: file| txt| md| terms| information| for details)+"),
    ("redistribution", "redistribut", "may (?:not )?be (?:freely )?redistributed"),
    ("no-derivatives", "derivative", "no derivative works"),
)

GRANT = "(?:re)?(?:licen[cs]ed|released|distributed|available|provided|published|redistributable|covered|governed|made available)(?: to you| only)? (?:under|by)(?: the terms of| the conditions of| a| an)?(?: the)? "


def rules() -> list[Rule]:
    """All rules in order: identifiers, grants by name, sentences, bare names."""
    found = [Rule(name, "spdx", f"spdx licen[cs]e identifier {name.replace('-', ' ').replace('.', ' ')}", 1, 1.0) for name in SPDX]
    found += [Rule(label, keyword, GRANT + name, 2, 0.95) for label, keyword, name in NAMES]
    found += [Rule(label, keyword, pattern, 2, 0.9) for label, keyword, pattern in SENTENCES]
    found += [Rule(label, keyword, name, 3, 0.7) for label, keyword, name in NAMES]
    return found
