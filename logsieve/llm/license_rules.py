"""Signature rules for license texts, notices, names and tags, as data.

Patterns are written over words with one space between them; a rule's keyword stands in every text that the rule matches. A lower
level wins over a higher one. Notices, tags and links are formed from each license's names, since they differ in nothing else.
"""

from typing import NamedTuple

#: Levels with the confidence of a detection: a sentence of the text itself or a tag, a notice, a link, a name, a mere hint.
TEXT, NOTICE, LINK, NAME, HINT = range(5)
CONFIDENCE = (1.0, 0.95, 0.9, 0.8, 0.4)


class Rule(NamedTuple):
    label: str
    level: int
    keyword: str
    pattern: str
    base: bool = False


#: The three phrases that are searched for literally; their labels are never suppressed.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: label, keyword, regex of the name, regex of the tag (identifier without punctuation)
NAMES = (
    ("mit", "mit licen", r"(the )?mit licen[sc]e", r"mit"),
    ("mit-0", "no attribution", r"mit no attribution( licen[sc]e)?", r"mit 0"),
    ("apache-2", "apache", r"apache( software)? licen[sc]e( version| v)? ?2( 0)?|apache 2( 0)?( licen[sc]e)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache( software)? licen[sc]e( version| v)? ?1 1|apache 1 1", r"apache 1 1"),
    ("apache-1.0", "apache", r"apache( software)? licen[sc]e( version| v)? ?1 0|apache 1 0", r"apache 1 0"),
    ("gpl-3", "general public licen", r"(gnu )?general public licen[sc]e( version| v)? ?3( 0)?", r"gpl 3 0( only)?"),
    ("gpl-2", "general public licen", r"(gnu )?general public licen[sc]e( version| v)? ?2( 0)?", r"gpl 2 0( only)?"),
    ("gpl-1", "general public licen", r"(gnu )?general public licen[sc]e( version| v)? ?1( 0)?", r"gpl 1 0( only)?"),
    ("gpl-3-or-later", "general public licen", r"(gnu )?general public licen[sc]e( version| v)? ?3( 0)? or( any)? later( version)?", r"gpl 3 0 or later"),
    ("gpl-2-or-later", "general public licen", r"(gnu )?general public licen[sc]e( version| v)? ?2( 0)? or( any)? later( version)?", r"gpl 2 0 or later"),
    ("lgpl-3", "general public licen", r"(gnu )?lesser general public licen[sc]e( version| v)? ?3( 0)?", r"lgpl 3 0( only| or later)?"),
    ("lgpl-2.1", "general public licen", r"(gnu )?lesser general public licen[sc]e( version| v)? ?2 1", r"lgpl 2 1( only| or later)?"),
    ("lgpl-2", "general public licen", r"(gnu )?library general public licen[sc]e( version| v)? ?2( 0)?", r"lgpl 2 0( only| or later)?"),
    ("agpl-3", "general public licen", r"(gnu )?affero general public licen[sc]e( version| v)? ?3( 0)?", r"agpl 3 0( only| or later)?"),
    ("agpl-1", "general public licen", r"affero general public licen[sc]e( version| v)? ?1( 0)?", r"agpl 1 0( only| or later)?"),
    ("gfdl-1.3", "documentation licen", r"(gnu )?free documentation licen[sc]e( version| v)? ?1 3", r"gfdl 1 3( only| or later)?"),
    ("gfdl-1.2", "documentation licen", r"(gnu )?free documentation licen[sc]e( version| v)? ?1 2", r"gfdl 1 2( only| or later)?"),
    ("bsd-2", "bsd", r"(bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( licen[sc]e)?", r"bsd 2 clause"),
    ("bsd-3", "bsd", r"(bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( licen[sc]e)?", r"bsd 3 clause"),
    ("bsd-4", "bsd", r"(bsd 4 clause|4 clause bsd|original bsd)( licen[sc]e)?", r"bsd 4 clause"),
    ("bsd-0", "bsd", r"(zero clause bsd|0 clause bsd|bsd 0 clause)( licen[sc]e)?", r"0bsd"),
    ("mpl-2", "mozilla public", r"mozilla public licen[sc]e( version| v)? ?2( 0)?", r"mpl 2 0( no copyleft exception)?"),
    ("mpl-1.1", "mozilla public", r"mozilla public licen[sc]e( version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-1.0", "mozilla public", r"mozilla public licen[sc]e( version| v)? ?1 0", r"mpl 1 0"),
    ("epl-2", "eclipse public", r"eclipse public licen[sc]e( version| v)? ?2( 0)?", r"epl 2 0"),
    ("epl-1", "eclipse public", r"eclipse public licen[sc]e( version| v)? ?1( 0)?", r"epl 1 0"),
    ("eupl-1.2", "european union public", r"european union public licen[sc]e( version| v)? ?1 2", r"eupl 1 2"),
    ("eupl-1.1", "european union public", r"european union public licen[sc]e( version| v)? ?1 1", r"eupl 1 1"),
    ("cddl-1.1", "development and distribution", r"common development and distribution licen[sc]e( version| v)? ?1 1", r"cddl 1 1"),
    ("cddl-1.0", "development and distribution", r"common development and distribution licen[sc]e( version| v)? ?1 0", r"cddl 1 0"),
    ("cpl-1.0", "common public", r"common public licen[sc]e( version| v)? ?1 0", r"cpl 1 0"),
    ("cecill-2.1", "cecill", r"cecill( free software licen[sc]e agreement)?( version| v)? ?2 1", r"cecill 2 1"),
    ("cecill-b", "cecill", r"cecill b( licen[sc]e)?", r"cecill b"),
    ("cecill-c", "cecill", r"cecill c( licen[sc]e)?", r"cecill c"),
    ("isc", "isc licen", r"isc licen[sc]e", r"isc"),
    ("zlib", "zlib", r"zlib licen[sc]e|zlib libpng licen[sc]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[sc]e", r"libpng( 2 0)?"),
    ("boost-1.0", "boost", r"boost software licen[sc]e( version| v)?( 1 0)?", r"bsl 1 0"),
    ("artistic-2", "artistic", r"artistic licen[sc]e( version| v)? ?2( 0)?", r"artistic 2 0"),
    ("artistic-1", "artistic", r"artistic licen[sc]e( version| v)? ?1( 0)?", r"artistic 1 0( perl| cl8)?"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]e", r"wtfpl"),
    ("postgresql", "postgresql licen", r"postgresql licen[sc]e", r"postgresql"),
    ("python-2", "python", r"python software foundation licen[sc]e( version| v)?( 2)?", r"python 2 0( 1)?|psf 2 0"),
    ("php-3", "php licen", r"php licen[sc]e( version| v)? ?3( 0)?( 1| 01)?", r"php 3 0( 1)?"),
    ("ruby", "ruby licen", r"ruby licen[sc]e", r"ruby"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl"),
    ("ncsa", "ncsa", r"(university of illinois )?ncsa open source licen[sc]e", r"ncsa"),
    ("ofl-1.1", "open font", r"(sil )?open font licen[sc]e( version| v)?( 1 1)?", r"ofl 1 1"),
    ("osl-3", "open software licen", r"open software licen[sc]e( version| v)? ?3( 0)?", r"osl 3 0"),
    ("afl-3", "academic free", r"academic free licen[sc]e( version| v)? ?3( 0)?", r"afl 3 0"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[sc]e( version| v)?( 1 0)?", r"upl 1 0"),
    ("bsl-1.1", "business source", r"business source licen[sc]e( version| v)?( 1 1)?", r"busl 1 1"),
    ("sspl-1", "server side public", r"server side public licen[sc]e( version| v)?( 1)?", r"sspl 1 0"),
    ("elastic-2", "elastic licen", r"elastic licen[sc]e( version| v)? ?2( 0)?", r"elastic 2 0"),
    ("vim", "vim licen", r"vim licen[sc]e", r"vim"),
    ("curl", "curl licen", r"curl licen[sc]e", r"curl"),
    ("json", "json licen", r"json licen[sc]e", r"json"),
    ("beerware", "beerware", r"beerware licen[sc]e", r"beerware"),
    ("blueoak-1.0", "blue oak", r"blue oak model licen[sc]e( version| v)?( 1 0 0)?", r"blueoak 1 0 0"),
    ("mulan-2", "mulan", r"mulan permissive software licen[sc]e( version| v)? ?2", r"mulanpsl 2 0"),
    ("odbl-1.0", "open database licen", r"open database licen[sc]e( version| v)?( 1 0)?", r"odbl 1 0"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e( version| v)?( 1 0)?", r"odc by 1 0"),
    ("pddl-1.0", "public domain dedication", r"(open data commons )?public domain dedication and licen[sc]e( version| v)?( 1 0)?", r"pddl 1 0"),
    ("cdla-permissive-2", "community data licen", r"community data licen[sc]e agreement permissive( version| v)?( 2 0)?", r"cdla permissive 2 0"),
    ("cdla-sharing-1", "community data licen", r"community data licen[sc]e agreement sharing( version| v)?( 1 0)?", r"cdla sharing 1 0"),
    ("cc0-1.0", "cc0", r"cc0( 1 0)?( universal)?", r"cc0 1 0"),
    ("cc-by-4.0", "creative commons", r"creative commons attribution( licen[sc]e)? 4 0( international)?( licen[sc]e)?", r"cc by 4 0"),
    ("cc-by-3.0", "creative commons", r"creative commons attribution( licen[sc]e)? 3 0( unported)?( licen[sc]e)?", r"cc by 3 0"),
    ("cc-by-2.0", "creative commons", r"creative commons attribution( licen[sc]e)? 2 0( generic)?( licen[sc]e)?", r"cc by 2 0"),
    ("cc-by-sa-4.0", "creative commons", r"creative commons attribution share ?alike( licen[sc]e)? 4 0( international)?( licen[sc]e)?", r"cc by sa 4 0"),
    ("cc-by-sa-3.0", "creative commons", r"creative commons attribution share ?alike( licen[sc]e)? 3 0( unported)?( licen[sc]e)?", r"cc by sa 3 0"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial( licen[sc]e)?( [234] 0)?( international| unported| generic)?( licen[sc]e)?", r"cc by nc [234] 0"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(ative|ativ)e?s?( works)?( [234] 0)?( international| unported| generic)?", r"cc by nd [234] 0"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike( [234] 0)?( international| unported| generic)?", r"cc by nc sa [234] 0"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?derivatives?( works)?( [234] 0)?( international| unported| generic)?", r"cc by nc nd [234] 0"),
    ("openrail-m", "openrail", r"(bigscience |creativeml )?openrail m( licen[sc]e)?", r"openrail m"),
    ("llama", "community licen", r"llama( [234])? community licen[sc]e( agreement)?", r"llama [234] community"),
)

#: label, keyword, words of the license's address
LINKS = (
    ("mit", "opensource org", r"opensource org licenses? mit( licen[sc]e)?"), ("apache-2", "apache org", r"apache org licenses licen[sc]e 2 0"),
    ("bsd-2", "opensource org", r"opensource org licenses? bsd 2 clause"), ("bsd-3", "opensource org", r"opensource org licenses? bsd 3 clause"),
    ("isc", "opensource org", r"opensource org licenses? isc"), ("gpl-3", "gnu org", r"gnu org licenses (old licenses )?gpl 3 0"),
    ("gpl-2", "gnu org", r"gnu org licenses (old licenses )?gpl 2 0"), ("lgpl-3", "gnu org", r"gnu org licenses (old licenses )?lgpl 3 0"),
    ("lgpl-2.1", "gnu org", r"gnu org licenses (old licenses )?lgpl 2 1"), ("agpl-3", "gnu org", r"gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "gnu org", r"gnu org licenses fdl 1 3"), ("mpl-2", "mozilla org", r"mozilla org (en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org", r"mozilla org mpl mpl 1 1"), ("epl-2", "eclipse org", r"eclipse org (legal|org documents) epl (v20|2 0)"),
    ("epl-1", "eclipse org", r"eclipse org (legal|org documents) epl (v10|1 0)"), ("boost-1.0", "boost org", r"boost org licen[sc]e 1 0"),
    ("unlicense", "unlicense org", r"unlicense org"), ("ofl-1.1", "sil org", r"scripts sil org ofl"),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0"), ("public-domain", "creativecommons org", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-4.0", "creativecommons org", r"creativecommons org licenses by 4 0"), ("cc-by-3.0", "creativecommons org", r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4.0", "creativecommons org", r"creativecommons org licenses by sa 4 0"), ("cc-by-sa-3.0", "creativecommons org", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [234] [05]"), ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [234] [05]"),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [234] [05]"), ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [234] [05]"),
    ("odbl-1.0", "opendatacommons org", r"opendatacommons org licenses odbl( 1 0)?"), ("odc-by-1.0", "opendatacommons org", r"opendatacommons org licenses by( 1 0)?"),
    ("pddl-1.0", "opendatacommons org", r"opendatacommons org licenses pddl( 1 0)?"),
)

#: label, keyword, a sentence that only this license's text has
TEXTS = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2", "redistributi", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "endorse or promote", r"neither the names? of .{1,200}? may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2", "apache licen", r"licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2", "compliance with the licen", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("gpl-3-or-later", "free software foundation", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("gpl-2-or-later", "free software foundation", r"under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("lgpl-3", "free software foundation", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3"),
    ("lgpl-2.1", "free software foundation", r"under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1"),
    ("agpl-3", "free software foundation", r"under the terms of the gnu affero general public licen[sc]e as published by the free software foundation either version 3"),
    ("gfdl-1.3", "documentation licen", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e version 1 3"),
    ("gfdl-1.2", "documentation licen", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e version 1 2"),
    ("mpl-2", "mozilla public", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("mpl-1.1", "mozilla public", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("epl-2", "eclipse public", r"accompanying materials are made available under the terms of the eclipse public licen[sc]e (v|version )?2 0"),
    ("epl-1", "eclipse public", r"accompanying materials are made available under the terms of the eclipse public licen[sc]e (v|version )?1 0"),
    ("cddl-1.0", "development and distribution", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("boost-1.0", "boost", r"distributed under the boost software licen[sc]e version 1 0"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
    ("artistic-2", "artistic", r"everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document.{0,200}? artistic"),
    ("ofl-1.1", "open font", r"this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("python-2", "python software foundation", r"copyright c [0-9 ]{4,80} python software foundation all rights reserved"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("beerware", "beer in return", r"you can buy me a beer in return"),
    ("ms-pl", "microsoft public", r"this licen[sc]e governs use of the accompanying software.{0,200}? microsoft public licen[sc]e"),
    ("postgresql", "paragraphs appear in all copies", r"provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ncsa", "illinois", r"developed by .{1,120}? university of illinois"),
    ("cc0-1.0", "public domain", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-4.0", "creative commons", r"this work is licensed under a creative commons attribution 4 0 international licen[sc]e"),
    ("bsl-1.1", "production use", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("blueoak-1.0", "everyone needs permission", r"everyone needs permission to use this software"),
    ("curl", "copyright notice and this permission notice", r"permission to use copy modify and distribute this software .{0,120}?provided that the above copyright notice and this permission notice appear in all copies"),
)

#: label, keyword, words that hint at terms without naming a license exactly
HINTS = (
    ("gpl", "general public licen", r"(gnu )?general public licen[sc]e"), ("gpl", "gpl", r"(gnu )?gpl( ?v ?[123])?"),
    ("lgpl", "lgpl", r"(gnu )?lgpl( ?v ?[23])?"), ("agpl", "agpl", r"(gnu )?agpl( ?v ?[13])?"),
    ("bsd", "bsd licen", r"bsd licen[sc]e"), ("bsd", "bsd style", r"bsd style( licen[sc]e)?"), ("apache", "apache licen", r"apache licen[sc]e"),
    ("mozilla", "mozilla public", r"mozilla public licen[sc]e"), ("creative-commons", "creative commons", r"creative commons( licen[sc]e)?"),
    ("cc-by", "cc by", r"cc by( [234] 0)?"), ("cc-by-sa", "cc by sa", r"cc by sa( [234] 0)?"), ("cc-by-nd", "cc by nd", r"cc by nd( [234] 0)?"),
    ("cc-by-nc-sa", "cc by nc sa", r"cc by nc sa( [234] 0)?"), ("cc-by-nc-nd", "cc by nc nd", r"cc by nc nd( [234] 0)?"),
    ("public-domain", "public domain", r"(in|into|to) the public domain"), ("all-rights-reserved", "all rights", r"all rights( are)? reserved"),
    ("proprietary", "proprietary", r"(confidential and proprietary|proprietary and confidential)"), ("proprietary", "proprietary licen", r"proprietary licen[sc]e"),
    ("commercial", "commercial licen", r"commercial licen[sc]e"), ("eula", "user licen", r"end user licen[sc]e agreement"),
    ("non-commercial", "non commercial", r"(for )?non commercial use only"), ("research-only", "research", r"for research (use|purposes) only"), ("academic-only", "academic", r"for academic (use|purposes) only"),
    ("odbl-1.0", "odbl", r"odbl( v)?( 1 0)?"), ("python-2", "psf licen", r"psf licen[sc]e( agreement)?"),
    ("see-license", "licen", r"see (the )?(file )?licen[sc]e( file| txt| md)?( for details)?"),
    ("permission-required", "written permission", r"without( the)?( express| prior| specific)? written permission"),
)

#: Every keyword holds one of these, so a text without any of them is passed over.
GATES = (
    "licen", "spdx", "all rights", "gpl", "bsd", "cc0", "cc by", "cecill", "creative commons", "public domain", "proprietary", "non commercial", "written permission",
    "opensource org", "apache", "gnu org", "mozilla", "eclipse", "boost", "sil org", "creativecommons org", "opendatacommons org", "free of charge", "substantial portions",
    "permission", "redistributi", "endorse or promote", "advertising materials", "free software foundation", "development and distribution", "altered source versions",
    "what the fuck", "artistic", "open font", "python", "openssl", "good not evil", "beer", "microsoft", "paragraphs appear in all copies", "illinois", "production use",
    "hosted or managed service", "research", "openrail", "no attribution", "european union public", "common public", "zlib", "libpng", "ncsa", "academic", "odbl",
    "universal permissive", "business source", "server side public", "blue oak", "mulan", "open data commons",
)

#: What stands before a name in a notice.
_GRANT = r"(licensed|released|distributed|available|provided|published|covered|governed|shared|issued|offered)( to you)? (under|by)( the| a| an)?( terms( and conditions)? of( the)?)? "


def _apart(words: str) -> str:
    """Over words with a blank on either side of each: two blanks where one separates words."""
    return words.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")


def _rules() -> tuple[Rule, ...]:
    found = [Rule(label, TEXT, words, words, True) for label, words in BASE]
    found += [Rule(label, TEXT, key, words) for label, key, words in TEXTS]
    found += [Rule(label, TEXT, "spdx licen", f"spdx licen[sc]e identifier ({tag})") for label, _, _, tag in NAMES]
    found += [Rule(label, NOTICE, key, f"{_GRANT}({name})") for label, key, name, _ in NAMES]
    found += [Rule(label, LINK, key, words) for label, key, words in LINKS]
    found += [Rule(label, NAME, key, name) for label, key, name, _ in NAMES]
    found += [Rule(label, HINT, key, words) for label, key, words in HINTS]
    return tuple(r._replace(keyword=r.keyword.replace(" ", "  "), pattern=f" (?:{_apart(r.pattern)}) ") for r in found)


RULES = _rules()
