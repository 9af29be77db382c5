"""License scans with ordered signature rules over the words of a text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.ascii import word_case

# Fixed values of the base: phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What separates words.
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Names of licenses by label, as they read in words, and identifiers.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("mit licen[cs]e", "mit x11 licen[cs]e", "expat licen[cs]e", "x11 licen[cs]e"),
    "apache-2": ("apache licen[cs]e (?:v|version )?2(?: 0)?", "apache software licen[cs]e (?:v|version )?2(?: 0)?", "apache 2 0 licen[cs]e", "asl 2 0"),
    "apache-1.1": ("apache (?:software )?licen[cs]e (?:v|version )?1 1",),
    "gpl-2": ("gnu general public licen[cs]e (?:v|version )?2", "gnu gpl (?:v|version )?2", "gpl ?v?2(?: 0)?", "general public licen[cs]e version 2"),
    "gpl-3": ("gnu general public licen[cs]e (?:v|version )?3", "gnu gpl (?:v|version )?3", "gpl ?v?3(?: 0)?", "general public licen[cs]e version 3"),
    "gpl": ("gnu general public licen[cs]e", "gnu gpl"),
    "lgpl-2.1": ("gnu lesser general public licen[cs]e (?:v|version )?2 1", "gnu lgpl (?:v|version )?2 1", "lgpl ?v?2 1"),
    "lgpl-3": ("gnu lesser general public licen[cs]e (?:v|version )?3", "gnu lgpl (?:v|version )?3", "lgpl ?v?3"),
    "lgpl": ("gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "gnu lgpl"),
    "agpl-3": ("gnu affero general public licen[cs]e(?: (?:v|version )?3)?", "affero general public licen[cs]e", "agpl ?v?3"),
    "bsd-2": ("bsd 2 clause licen[cs]e", "2 clause bsd licen[cs]e", "two clause bsd licen[cs]e", "simplified bsd licen[cs]e", "freebsd licen[cs]e"),
    "bsd-3": ("bsd 3 clause licen[cs]e", "3 clause bsd licen[cs]e", "three clause bsd licen[cs]e", "new bsd licen[cs]e", "modified bsd licen[cs]e"),
    "bsd-4": ("bsd 4 clause licen[cs]e", "4 clause bsd licen[cs]e", "original bsd licen[cs]e"),
    "bsd": ("bsd licen[cs]e", "bsd style licen[cs]e"),
    "mpl-2": ("mozilla public licen[cs]e (?:v|version )?2(?: 0)?", "mpl (?:v|version )?2(?: 0)?"),
    "mpl-1.1": ("mozilla public licen[cs]e (?:v|version )?1 1", "mpl (?:v|version )?1 1"),
    "epl-1": ("eclipse public licen[cs]e (?:v|version )?1(?: 0)?", "epl (?:v|version )?1 0"),
    "epl-2": ("eclipse public licen[cs]e (?:v|version )?2(?: 0)?", "epl (?:v|version )?2 0"),
    "cddl-1": ("common development and distribution licen[cs]e", "cddl (?:v|version )?1 0"),
    "isc": ("isc licen[cs]e", "internet systems consortium licen[cs]e"),
    "zlib": ("zlib licen[cs]e", "zlib libpng licen[cs]e"),
    "unlicense": ("the unlicense", "unlicense licen[cs]e"),
    "cc0": ("cc0 1 0(?: universal)?", "creative commons zero", "cc0 public domain dedication"),
    "cc-by": ("cc by(?: [1-4] [05])?", "creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    "cc-by-sa": ("cc by sa(?: [1-4] [05])?", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    "cc-by-nd": ("cc by nd(?: [1-4] [05])?", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    "cc-by-nc": ("cc by nc(?: [1-4] [05])?", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    "cc-by-nc-sa": ("cc by nc sa(?: [1-4] [05])?", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    "cc-by-nc-nd": ("cc by nc nd(?: [1-4] [05])?", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    "wtfpl": ("do what the fuck you want to public licen[cs]e", "wtfpl"),
    "boost-1": ("boost software licen[cs]e(?: version 1 0)?", "bsl 1 0"),
    "artistic-2": ("artistic licen[cs]e (?:v|version )?2(?: 0)?",),
    "ofl-1.1": ("sil open font licen[cs]e(?: version 1 1)?", "ofl 1 1"),
    "odbl-1": ("open database licen[cs]e", "odbl 1 0"),
    "psf-2": ("python software foundation licen[cs]e(?: version 2)?", "psf licen[cs]e"),
    "eupl-1.2": ("european union public licen[cs]e(?: (?:v|version )?1 2)?", "eupl 1 2"),
    "public-domain": ("released into the public domain", "dedicated to the public domain"),
    "proprietary": ("all rights reserved",),
}
# What stands before a name, by priority, the higher the surer, with the score it gives.
WORDINGS: tuple[tuple[int, float, str], ...] = (
    (4, 1.0, "spdx licen[cs]e identifier"),
    (3, 0.95, "(?:re)?licen[cs]ed under(?: the)?(?: terms of)?(?: the)?"),
    (3, 0.9, "(?:released|distributed|published|available|made available|provided|covered|shared) (?:under|by)(?: the)?(?: terms of)?(?: the)?"),
    (2, 0.85, "(?:under|subject to|governed by|permitted by)(?: the)?(?: terms of)?(?: the)?"),
    (2, 0.8, "(?:licen[cs]es?|spdx)(?: is| type| name| id)?"),
    (2, 0.8, "see(?: the)?(?: terms of)?(?: the)?"),
)
#: The last words of all wordings, one of which stands before an identifier.
LAST = ("identifier", "license", "licence", "licenses", "licences", "under", "by", "the", "of", "to", "is", "type", "name", "id", "spdx", "see")
#: Priority and score of a name that stands alone.
BARE = (1, 0.6)
# Identifiers by label that are too short or too common to stand without a wording.
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "mit": ("mit(?: 0)?", "x11"),
    "apache-2": ("apache 2(?: 0)?",),
    "apache-1.1": ("apache 1 1",),
    "bsd-2": ("bsd 2 clause",),
    "bsd-3": ("bsd 3 clause",),
    "bsd-4": ("bsd 4 clause",),
    "isc": ("isc",),
    "zlib": ("zlib",),
    "unlicense": ("unlicense",),
    "artistic-2": ("artistic 2(?: 0)?",),
    "psf-2": ("psf 2 0", "python 2 0"),
}
#: Priorities and scores of the families of whole signatures: bodies, notices, addresses, and remarks.
BODY, NOTICE, ADDRESS, REMARK = (6, 1.0), (5, 0.95), (4, 0.9), (1, 0.6)
# Signatures written by hand, (label, keyword, pattern) over words with one blank between them. The
# keyword stands in every match, so texts without it are not searched.
BODIES: tuple[tuple[str, str, str], ...] = (
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy(?: of this software)?"),
    ("mit", "permission notice shall", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "deal in the software", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("boost-1", "free of charge", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("ofl-1.1", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ncsa", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software"),
    ("curl", "permission to use", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("isc", "permission to use", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("hpnd", "permission to use", "permission to use copy modify (?:and )?(?:distribute )?(?:and )?(?:sell )?this software and its documentation for any purpose is hereby granted without fee"),
    ("0bsd", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("zlib", "provided as is without", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "must not be misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source", "redistributions of source code must retain the (?:above )?copyright notice this list of conditions"),
    ("bsd", "redistributions in binary", "redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions"),
    ("bsd-3", "endorse or promote", "neither the names? of (?:the )?(?:[^ ]+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-3", "endorse or promote", "the names? of (?:the )?(?:[^ ]+ ){1,8}may not be used to endorse or promote products"),
    ("bsd-3-lbnl", "no obligation whatsoever", "you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance"),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clear", "patent rights", "no express or implied licen[cs]es to any party s patent rights are granted"),
    ("apache-2", "agreed to in writing", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2", "except in compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2", "each contributor hereby", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) licen[cs]e"),
    ("apache-1.1", "apache software foundation", "this product includes software developed by the apache software foundation"),
    ("gpl", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("gpl", "free software you can", "this (?:program|software|library|file|package) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-2", "free software you can", "(?:this (?:program|software|library|file|package) )?is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2"),
    ("gpl-2", "free software you can", "(?:this (?:program|software|library|file|package) )?is free software you can redistribute it and or modify it under the terms of (?:version 2 of the gnu general public licen[cs]e|the gnu general public licen[cs]e version 2)"),
    ("gpl-3", "free software you can", "(?:this (?:program|software|library|file|package) )?is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3"),
    ("gpl", "copy of the gnu", "you should have received a copy of the gnu general public licen[cs]e along with"),
    ("lgpl", "copy of the gnu", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with"),
    ("agpl-3", "copy of the gnu", "you should have received a copy of the gnu affero general public licen[cs]e along with"),
    ("lgpl", "free software you can", "(?:this (?:program|software|library|file|package) )?is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl-2.1", "free software you can", "(?:this (?:program|software|library|file|package) )?is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1"),
    ("lgpl-3", "free software you can", "(?:this (?:program|software|library|file|package) )?is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3"),
    ("agpl-3", "free software you can", "(?:this (?:program|software|library|file|package) )?is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl-classpath", "special exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gfdl", "permission is granted to copy", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0"),
    ("mpl-2", "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-1.1", "may not use this file", "you may not use this file except in compliance with the licen[cs]e you may obtain a copy of the licen[cs]e at http www mozilla org mpl"),
    ("epl-1", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?1 0"),
    ("epl-2", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v(?:ersion)? )?2 0"),
    ("cddl-1", "common development", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cpl-1", "common public", "this program and the accompanying materials are made available under the terms of the common public licen[cs]e"),
    ("artistic-2", "artistic", "this program is free software you can redistribute it and or modify it under the terms of the (?:the )?artistic licen[cs]e 2 0"),
    ("perl", "same terms as perl", "you (?:can|may) redistribute it and or modify it under the same terms as perl(?: 5)? itself"),
    ("artistic-1", "intent of this document", "the intent of this document is to state the conditions under which a package may be copied"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what", "you just do what the fuck you want to"),
    ("beerware", "buy me a beer", "you can buy me a beer in return"),
    ("json", "for good not evil", "the software shall be used for good not evil"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("ms-pl", "accompanying software", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("php-3", "php software", "this product includes php software freely available from"),
    ("psf-2", "python software foundation", "this licen[cs]e agreement is between the python software foundation psf and the individual or organization licensee"),
    ("ofl-1.1", "font software", "the font software may be (?:modified altered or added to|sold as part of a larger software package)"),
    ("odbl-1", "database", "you are free to share create and adapt the database as long as you attribute share alike and keep open"),
    ("cc0", "work to the public domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc0", "copyright and related", "to the extent possible under law (?:[^ ]+ ){1,8}(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc-by", "redistribute the material", "you are free to share copy and redistribute the material in any medium or format"),
    ("public-domain", "placed in the public domain", "(?:has been |is hereby |is )?placed in the public domain"),
    ("public-domain", "disclaims copyright", "the author disclaims copyright to this source code"),
    ("sleepycat", "redistributions in any form", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("eupl-1.2", "european commission", "licen[cs]ed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("afl-3", "academic free", "licen[cs]ed under the academic free licen[cs]e version 3 0"),
    ("upl-1", "condition set forth", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("icu", "unicode data files", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("proprietary", "strictly prohibited", "(?:unauthori[sz]ed )?(?:copying|reproduction|distribution|use) of this (?:file|software|document|program)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "confidential", "(?:proprietary and )?confidential(?: and proprietary)(?: information| property)?"),
    ("proprietary", "may not be", "may not be (?:reproduced|copied|distributed|used|disclosed)(?: [^ ]+){0,8} without the (?:express |prior )+written (?:permission|consent)"),
    ("proprietary", "reverse engineer", "you may not reverse engineer decompile or disassemble the software"),
    ("non-commercial", "non commercial|noncommercial", "(?:for|limited to) (?:personal and |educational and )?non ?commercial (?:use|purposes) only"),
    ("evaluation", "evaluation", "for (?:internal )?evaluation purposes only"),
)
NOTICES: tuple[tuple[str, str, str], ...] = (
    ("mit", "licensed mit|licenced mit", "(?:is )?(?:dual |multi )?licen[cs]ed mit"),
    ("mit", "mit or apache", "mit or apache 2 0"),
    ("apache-2", "apache", "(?:mit|bsd) (?:or|and) apache 2 0"),
    ("apache-2", "apache", "apache 2 0 with llvm exception"),
    ("apache-2", "apache", "apache licen[cs]e 2 0 the licen[cs]e"),
    ("gpl-2", "gpl", "gpl 2 0 (?:only|or later|with classpath exception)"),
    ("gpl-2", "gpl", "gplv2(?: or later| only)?"),
    ("gpl-3", "gpl", "gpl 3 0 (?:only|or later)"),
    ("gpl-3", "gpl", "gplv3(?: or later| only)?"),
    ("lgpl-2.1", "lgpl", "lgpl 2 1 (?:only|or later)"),
    ("lgpl-2.1", "lgpl", "lgplv2 1"),
    ("lgpl-3", "lgpl", "lgpl 3 0 (?:only|or later)"),
    ("lgpl-3", "lgpl", "lgplv3"),
    ("agpl-3", "agpl", "agpl 3 0 (?:only|or later)"),
    ("agpl-3", "agpl", "agplv3"),
    ("gpl-2", "gnu general public", "version 2 of the gnu general public licen[cs]e"),
    ("gpl-3", "gnu general public", "version 3 of the gnu general public licen[cs]e"),
    ("lgpl-2.1", "gnu lesser", "version 2 1 of the gnu lesser general public licen[cs]e"),
    ("lgpl-3", "gnu lesser", "version 3 of the gnu lesser general public licen[cs]e"),
    ("gfdl", "gnu free documentation", "gnu free documentation licen[cs]e(?: version 1 [123])?"),
    ("gfdl", "gfdl", "gfdl (?:v(?:ersion)? ?)?1 [123]"),
    ("bsd", "governed by a bsd", "use of this source code is governed by a bsd style licen[cs]e"),
    ("mit", "governed by an mit", "use of this source code is governed by an mit style licen[cs]e"),
    ("apache-2", "governed by the apache", "use of this source code is governed by the apache 2 0 licen[cs]e"),
    ("0bsd", "zero clause|0bsd", "(?:zero clause bsd|0bsd)(?: licen[cs]e)?"),
    ("cc-by", "some rights reserved", "some rights reserved"),
    ("cc-by", "creative commons attribution", "licen[cs]ed under a creative commons attribution [1-4] [05] (?:international|unported|generic)"),
    ("cc-by-sa", "creative commons", "this work is licen[cs]ed under (?:a|the) creative commons attribution share ?alike"),
    ("cc-by-nc", "creative commons", "this work is licen[cs]ed under (?:a|the) creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", "creative commons", "this work is licen[cs]ed under (?:a|the) creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative commons", "this work is licen[cs]ed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nd", "creative commons", "this work is licen[cs]ed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by", "creative commons", "this work is licen[cs]ed under (?:a|the) creative commons attribution"),
    ("ms-pl", "ms pl", "ms pl"),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e"),
    ("ruby", "terms as ruby", "same terms as ruby"),
    ("artistic-1", "artistic", "artistic licen[cs]e 1 0"),
    ("openssl", "openssl", "openssl licen[cs]e"),
    ("postgresql", "postgresql", "postgresql licen[cs]e"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"),
    ("bsl-1.1", "business source", "business source licen[cs]e(?: 1 1)?"),
    ("sspl-1", "server side public", "server side public licen[cs]e"),
    ("elastic-2", "elastic", "elastic licen[cs]e 2 0"),
    ("polyform", "polyform", "polyform (?:noncommercial|shield|small business|internal use) licen[cs]e"),
    ("openrail", "openrail|open rail", "(?:creativeml )?(?:open ?rail)(?: m)?(?: licen[cs]e)?"),
    ("hippocratic", "hippocratic", "hippocratic licen[cs]e"),
    ("cecill", "cecill", "cecill(?: b| c)?(?: licen[cs]e)?"),
    ("osl-3", "open software", "open software licen[cs]e(?: v| version)? 3 0"),
    ("ibm-pl", "ibm public", "ibm public licen[cs]e"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[cs]e"),
    ("odc-by", "open data commons", "open data commons attribution licen[cs]e"),
    ("pddl", "open data commons", "open data commons public domain dedication"),
    ("cdla-permissive", "community data", "community data licen[cs]e agreement permissive"),
)
ADDRESSES: tuple[tuple[str, str, str], ...] = (
    ("mit", "opensource org", "opensource org licen[cs]es? mit(?: licen[cs]e)?"),
    ("apache-2", "opensource org", "opensource org licen[cs]es? apache 2 0"),
    ("bsd-2", "opensource org", "opensource org licen[cs]es? bsd 2 clause"),
    ("bsd-3", "opensource org", "opensource org licen[cs]es? bsd 3 clause"),
    ("bsd", "opensource org", "opensource org licen[cs]es? bsd licen[cs]e"),
    ("isc", "opensource org", "opensource org licen[cs]es? isc"),
    ("zlib", "opensource org", "opensource org licen[cs]es? zlib"),
    ("gpl-2", "opensource org", "opensource org licen[cs]es? gpl 2 0"),
    ("gpl-3", "opensource org", "opensource org licen[cs]es? gpl 3 0"),
    ("lgpl-2.1", "opensource org", "opensource org licen[cs]es? lgpl 2 1"),
    ("lgpl-3", "opensource org", "opensource org licen[cs]es? lgpl 3 0"),
    ("mpl-2", "opensource org", "opensource org licen[cs]es? mpl 2 0"),
    ("epl-1", "opensource org", "opensource org licen[cs]es? epl 1 0"),
    ("apache-2", "apache org", "(?:www )?apache org licen[cs]es? (?:licen[cs]e )?2 0"),
    ("apache-1.1", "apache org", "(?:www )?apache org licen[cs]es? (?:licen[cs]e )?1 1"),
    ("gpl-2", "gnu org", "(?:www )?gnu org licen[cs]es? (?:old licen[cs]es )?gpl 2 0"),
    ("gpl-3", "gnu org", "(?:www )?gnu org licen[cs]es? gpl 3 0"),
    ("gpl", "gnu org", "(?:www )?gnu org (?:licen[cs]es?|copyleft) gpl"),
    ("lgpl-2.1", "gnu org", "(?:www )?gnu org licen[cs]es? (?:old licen[cs]es )?lgpl 2 1"),
    ("lgpl-3", "gnu org", "(?:www )?gnu org licen[cs]es? lgpl 3 0"),
    ("lgpl", "gnu org", "(?:www )?gnu org (?:licen[cs]es?|copyleft) (?:lgpl|lesser)"),
    ("agpl-3", "gnu org", "(?:www )?gnu org licen[cs]es? agpl(?: 3 0)?"),
    ("gfdl", "gnu org", "(?:www )?gnu org (?:licen[cs]es?|copyleft) fdl"),
    ("mpl-2", "mozilla org", "(?:www )?mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla org", "(?:www )?mozilla org mpl (?:mpl )?1 1"),
    ("epl-1", "eclipse org", "(?:www )?eclipse org legal epl v10"),
    ("epl-2", "eclipse org", "(?:www )?eclipse org legal epl (?:v20|2 0)"),
    ("boost-1", "boost org", "(?:www )?boost org licen[cs]e 1 0"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl", "wtfpl net", "(?:www )?wtfpl net"),
    ("ofl-1.1", "scripts sil", "scripts sil org ofl"),
    ("cc0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons org", "creativecommons org licen[cs]es by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org", "creativecommons org licen[cs]es by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons org", "creativecommons org licen[cs]es by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons org", "creativecommons org licen[cs]es by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licen[cs]es by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licen[cs]es by nc nd [1-4] [05]"),
    ("odbl-1", "opendatacommons org", "opendatacommons org licen[cs]es odbl"),
    ("odc-by", "opendatacommons org", "opendatacommons org licen[cs]es by"),
    ("mit", "spdx org", "spdx org licen[cs]es mit"),
    ("apache-2", "spdx org", "spdx org licen[cs]es apache 2 0"),
    ("bsd-3", "spdx org", "spdx org licen[cs]es bsd 3 clause"),
    ("bsd-2", "spdx org", "spdx org licen[cs]es bsd 2 clause"),
    ("mit", "choosealicense com", "choosealicense com licen[cs]es mit"),
    ("apache-2", "choosealicense com", "choosealicense com licen[cs]es apache 2 0"),
    ("gpl-3", "choosealicense com", "choosealicense com licen[cs]es gpl 3 0"),
)
#: Letters of a root, by which texts are first told apart.
_ROOT = 5
#: Characters before a name in which its wording is looked for.
_REACH = 160
#: Score of a text whose only finds are base phrases.
BASE_SCORE = 0.85
#: Words of names that don't tell licenses apart.
_COMMON = {"licen", "e", "general", "public", "software", "license", "version", "clause", "creative", "commons", "attribution", "the"}


@dataclass(frozen=True)
class Rule:
    """A signature: pattern over words with one blank of its own on each side, in texts that hold the keyword.

    A name takes its priority and score from the wording before it, if any; `alone` tells whether it counts
    without one.
    """

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float
    is_name: bool = False
    alone: bool = True


def _spaced(pattern: str) -> str:
    """A pattern over words with one blank between them as one over a line where each word has two."""
    return pattern.replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?").replace("[^  ]", "[^ ]")


def _keyword(name: str) -> str:
    """The longest literal run of whole words of a name that tells it apart, as the line has it."""
    plain = re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)(?:\?|\{[^}]*\})?|[a-z0-9]*\[[^]]*\]\??[a-z0-9]*|[a-z0-9 ]\?", "|", name)
    runs = [r.strip() for r in plain.split("|") if r.strip()]
    return max([r for r in runs if set(r.split()) - _COMMON] or runs, key=len)


def _literals(pattern: str) -> list[str]:
    """The literal runs that stand in every match of a pattern."""
    return re.sub(r"\(\?:(?:[^()]|\([^()]*\))*\)(?:\?|\{[^}]*\}|\+)?|\[[^]]*\][+?]?|.\?", "|", pattern).split("|")


def _roots(rules: tuple[Rule, ...]) -> dict[int, list[str]]:
    """For each rule literals of which every match holds one, few in all: the beginnings of words that most rules share.

    Roots stand at the beginning of words. A text is searched for all of them first, by one pattern, and then
    for each, so the keywords of rules cost nothing where their root is missing.
    """
    words = [{w[:_ROOT] for run in _literals(r.pattern) for w in re.findall("(?<= )[a-z0-9]+", run) if len(w) >= _ROOT} for r in rules]
    open_, found = {k for k, w in enumerate(words) if w}, {}
    for k in set(range(len(rules))) - open_:
        keys = [_spaced(x) for x in rules[k].keyword.split("|")]
        found[k] = keys if rules[k].alone else [f"{w}  {x}" for w in LAST for x in keys]
    while open_:
        count = Counter(w for k in sorted(open_) for w in sorted(words[k]))
        best = max(sorted(count), key=count.__getitem__)
        found |= {k: [best] for k in open_ if best in words[k]}
        open_ -= found.keys()
    return found


def _any_of(literals: list[str]) -> str:
    """A pattern of one of the literals, by their common beginnings, so that few are tried at a place."""
    if "" in literals:
        return ""
    heads = sorted({x[0] for x in literals})
    each = [h + _any_of(sorted({x[1:] for x in literals if x[0] == h})) for h in heads]
    return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"


@lru_cache(maxsize=1)
def signatures() -> tuple[Rule, ...]:
    """Every rule: the signatures by hand, the names of licenses, and the identifiers that need a wording."""
    rules = []
    for family, (priority, score) in ((BODIES, BODY), (NOTICES, NOTICE), (ADDRESSES, ADDRESS)):
        rules += [Rule(label, key, f" {_spaced(pattern)} ", priority, score) for label, key, pattern in family]
    for table, alone in ((NAMES, True), (IDENTIFIERS, False)):
        rules += [Rule(label, _keyword(name), f" {_spaced(name)} ", *BARE, True, alone) for label, names in table.items() for name in names]
    return tuple(rules)


def words_line(text: Column) -> Column:
    """The lower-cased words of a text in a line, each with a blank of its own on either side; blanks alone if none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(word_case(F.coalesce(text, F.lit(""))), _GAPS, "  ")), F.lit(" "))


def _count(line: Column) -> Column:
    """Words of a line or of a piece between words: each has two blanks."""
    blanks = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.floor(blanks / 2).cast("long")


def _own(phrase: str) -> str:
    words = phrase.split(" ")
    if any(words[:k] == words[-k:] for k in range(1, len(words))):
        raise ValueError(f"a base phrase must not overlap itself: {phrase}")
    return f" {'  '.join(words)} "


_HIT = "array<struct<start:int,stop:int,priority:int,score:double,label:string>>"


def _places(line: Column, found: Column) -> Column:
    """The intervals of the matches of found (rule number, matches), left to right.

    Matches of a rule don't overlap; one holds the blanks of its words, so where its string first stands again
    is where the match is.
    """
    spans = F.array().cast("array<struct<start:int,stop:int,rule:int>>")

    def step(acc, m):
        start = F.call_function("locate", m, line, acc["at"])
        stop = start + F.length(m)
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), found["rule"].alias("rule")))).alias("spans"))

    return F.aggregate(found["matches"], F.struct(F.lit(1).alias("at"), spans.alias("spans")), step)["spans"]


def _judged(line: Column, place: Column, rules: tuple[Rule, ...]) -> Column:
    """The hit (start, -stop, -priority, score, label) of a place, its wording included; null for an identifier without one."""
    at = lambda kind, values: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), place["rule"] + 1)
    lo = F.greatest(place["start"] - _REACH, F.lit(1))
    before = F.concat(F.substr(line, lo, place["start"] - lo), F.lit(" "))
    hit = lambda start, priority, score: F.struct(start.cast("int").alias("start"), (-place["stop"]).alias("stop"), (-priority).cast("int").alias("priority"), score.cast("double").alias("score"), at("string", [r.label for r in rules]).alias("label"))
    bare = F.when(at("boolean", [r.alone for r in rules]), hit(place["start"], at("int", [r.priority for r in rules]), at("double", [r.score for r in rules])))
    worded = None
    for priority, score, wording in WORDINGS:
        had = F.regexp_extract(before, f" {_spaced(wording)}  $", 0)
        case = (had != "", hit(place["start"] + 1 - F.length(had), F.lit(priority), F.lit(score)))
        worded = F.when(*case) if worded is None else worded.when(*case)
    return F.when(at("boolean", [r.is_name for r in rules]), worded.otherwise(bare)).otherwise(bare)


def hits(line: Column) -> Column:
    """All finds of the rules whose keyword the line holds, sorted by start, then the longer, then the higher priority.

    Each pattern is a literal of its own, compiled once a task, and is tried on the texts of its keyword alone.
    """
    rules = signatures()
    roots = _roots(rules)
    groups: dict[tuple, dict[str, list[int]]] = {}
    for k, rule in enumerate(rules):
        groups.setdefault(tuple(roots[k]), {}).setdefault(rule.keyword, []).append(k)
    none = F.array().cast("array<struct<rule:int,matches:array<string>>>")
    holds = lambda some: reduce(or_, (F.contains(line, F.lit(k)) for k in some))
    tries = lambda some: F.array(*(F.struct(F.lit(k).alias("rule"), F.regexp_extract_all(line, F.lit(rules[k].pattern), F.lit(0)).alias("matches")) for k in some))
    tried = []
    for root, keywords in groups.items():
        own = [F.when(holds(_spaced(k) for k in keyword.split("|")), tries(some)).otherwise(none) for keyword, some in keywords.items()]
        tried.append(F.when(holds(root), F.concat(*own)).otherwise(none))
    gate = " " + _any_of(sorted({x for some in roots.values() for x in some}))
    found = F.when(line.rlike(gate), F.filter(F.concat(*tried), lambda x: F.size(x["matches"]) > 0)).otherwise(none)
    places = F.flatten(F.transform(found, lambda x: _places(line, x)))
    return F.array_sort(F.array_compact(F.transform(places, lambda p: _judged(line, p, rules))).cast(_HIT))


def resolved(found: Column) -> Column:
    """(end, labels, score) of what stays of sorted hits: one inside the interval of another is dropped, of equal ones the first stays."""
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def keep(acc, h):
        inside = -h["stop"] <= acc["end"]
        return F.struct(F.when(inside, acc["end"]).otherwise(-h["stop"]).alias("end"), F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(h["label"]))).alias("labels"), F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], h["score"])).alias("score"))

    return F.aggregate(found, start, keep)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    Base phrases are found wherever their words stand consecutively. Signature rules whose keyword a text holds
    are matched too; a name with a wording before it (an SPDX tag, "licensed under the") reaches over it and is
    surer for it. Of the finds, one inside another's interval is dropped, and of equal intervals the rule of
    higher priority stays. labels are the distinct labels of what stays and of the base, sorted; score is that
    of the surest find, BASE_SCORE at least with a base phrase, 0 with none. Whole texts are read, however
    long; a null text counts as empty: no words, null first_word and last_word, empty labels. Rows stay as
    many as they are, repeated ones and those of null id too; an empty table gives an empty one; extra columns
    are not read.
    """
    line = F.col("line")
    rows = docs.select(F.col(id_col).alias("id"), words_line(F.col(text_col)).alias("line"))
    phrases = {p: (_own(p), len(p.split(" ")), label) for p, label in BASE.items()}
    n_words = _count(line)
    counts, firsts, lasts, labels = [], [], [], []
    for own, size, label in phrases.values():
        has = F.contains(line, F.lit(own))
        pieces = (F.length(line) - F.length(F.replace(line, F.lit(own), F.lit("")))) / len(own)
        counts.append(F.when(has, pieces.cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(has, _count(F.substring_index(line, own, 1))))
        lasts.append(F.when(has, n_words - _count(F.substring_index(line, own, -1)) - size))
        labels.append(F.when(has, F.lit(label)))
    found = rows.select(
        "id", F.when(line == "  ", F.lit(0).cast("long")).otherwise(n_words).alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"), hits(line).alias("hits"),
    )
    joined = found.withColumn("kept", resolved(F.col("hits")))
    every = F.array_sort(F.array_distinct(F.concat("base", "kept.labels")))
    score = F.greatest(F.when(F.size("base") > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0)), F.col("kept.score"))
    return joined.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
