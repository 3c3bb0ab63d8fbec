"""Licence scan by sentence rules.

A text is cut into sentences, each sentence is normalised (lower case, runs of anything but ASCII
letters and digits become one space, "this project is licensed under the terms of the" and its like
become "under") and looked up among the known licence sentences.  The identifiers found, in their
order, are then matched against ordered licence rules: a rule asks for its identifiers one after the
other, other known sentences between them aside, the first rules are the most specific, and what a
rule has matched is taken out before the next is tried.

Before the cutting, the colon of an SPDX tag and the full stop of "v. 2.0" go, since they end no
sentence, each operand of an SPDX expression, however long it is, gets a tag of its own, and
"License: X" becomes "licensed under X".  After "under" every listed name counts ("the MIT License and
the Apache License, Version 2.0"), of several that begin alike the longest, and a notice may go on
after it ("see the LICENSE file for details").  Some notices are published
with a semicolon or a comma at one place; they are known both whole and by their parts.

Licence files break lines inside sentences, notices put one sentence on a line.  So a text is read
twice, with line breaks as ends of sentences and as spaces, and the licences of both are reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# SPDX identifiers and the names by which notices call the licences, normalised.
NAMES = {
    "0BSD": ["bsd zero clause license", "zero clause bsd license"],
    "AFL-3.0": ["academic free license version 3 0", "academic free license v3 0"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "gnu affero general public license v3 0", "gnu agplv3", "agplv3 license"],
    "AGPL-3.0-or-later": ["gnu affero general public license version 3 or later", "gnu affero general public license v3 0 or later"],
    "Apache-1.1": ["apache software license version 1 1"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license 2 0", "apache license version 2 0 the license"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "2 clause bsd license", "bsd 2 clause simplified license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause new or revised license"],
    "BSD-4-Clause": ["bsd 4 clause license", "original bsd license", "bsd 4 clause original or old license"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0"],
    "BlueOak-1.0.0": ["blue oak model license 1 0 0"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"],
    "CC-BY-3.0": ["cc by 3 0", "creative commons attribution 3 0 unported license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution share alike 4 0 international license"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution share alike 3 0 unported license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution non commercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal public domain dedication"],
    "CDDL-1.0": ["common development and distribution license version 1 0", "common development and distribution license 1 0"],
    "ECL-2.0": ["educational community license version 2 0"],
    "EPL-1.0": ["eclipse public license v1 0", "eclipse public license version 1 0", "eclipse public license 1 0"],
    "EPL-2.0": ["eclipse public license v2 0", "eclipse public license version 2 0", "eclipse public license 2 0"],
    "EUPL-1.2": ["european union public licence v 1 2", "european union public licence version 1 2", "eupl version 1 2"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gpl version 2", "gplv2 license"],
    "GPL-2.0-or-later": ["gnu general public license version 2 or later", "gnu general public license v2 0 or later", "gnu general public license version 2 or any later version"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl v3", "gpl version 3", "gplv3 license"],
    "GPL-3.0-or-later": ["gnu general public license version 3 or later", "gnu general public license v3 0 or later", "gnu general public license version 3 or any later version"],
    "ISC": ["isc license", "isc license isc"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl v2 1", "lgpl version 2 1"],
    "LGPL-2.1-or-later": ["gnu lesser general public license version 2 1 or later", "gnu lesser general public license v2 1 or later"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "gnu lesser general public license v3 0", "gnu lgpl v3", "lgpl version 3"],
    "LGPL-3.0-or-later": ["gnu lesser general public license version 3 or later", "gnu lesser general public license v3 0 or later"],
    "MIT": ["mit license", "mit license mit", "expat license", "mit expat license"],
    "MIT-0": ["mit no attribution license", "mit no attribution", "mit 0 license"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v2 0", "mozilla public license v 2 0"],
    "MS-PL": ["microsoft public license ms pl", "microsoft public license"],
    "NCSA": ["university of illinois ncsa open source license"],
    "ODbL-1.0": ["open database license odbl v1 0", "open data commons open database license odbl v1 0"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license 1 1"],
    "OSL-3.0": ["open software license version 3 0", "open software license v 3 0"],
    "PostgreSQL": ["postgresql license"],
    "PSF-2.0": ["python software foundation license version 2", "python software foundation license"],
    "Unlicense": ["unlicense"],
    "UPL-1.0": ["universal permissive license v 1 0", "universal permissive license version 1 0"],
    "WTFPL": ["do what the fuck you want to public license"],
    "Zlib": ["zlib license", "zlib libpng license"],
    "ZPL-2.1": ["zope public license zpl version 2 1"],
}
# Older SPDX identifiers and what they are called now.
OLDER = {
    "GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only",
}
# Sentences of published licence texts and notices, by identifier.
TEXTS = {
    "apache2-title": ["Apache License Version 2.0, January 2004"],
    "apache2-title-name": ["Apache License"],
    "apache2-title-date": ["Version 2.0, January 2004"],
    "apache2-comply": ["you may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache2-law": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache2-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-grant-0": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "postgresql-grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "gpl-published": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl-published": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl-published": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "gpl-3-or-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-2-or-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gpl-2-alone": ["you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "lgpl-3-or-later": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "agpl-3-or-later": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "later-2": ["either version 2 of the License, or (at your option) any later version"],
    "later-2.1": ["either version 2.1 of the License, or (at your option) any later version"],
    "later-3": ["either version 3 of the License, or (at your option) any later version"],
    "gpl-title": ["GNU General Public License"],
    "lgpl-title": ["GNU Lesser General Public License"],
    "agpl-title": ["GNU Affero General Public License"],
    "date-gpl2": ["Version 2, June 1991"],
    "date-lgpl2.1": ["Version 2.1, February 1999"],
    "date-gpl3": ["Version 3, 29 June 2007"],
    "date-agpl3": ["Version 3, 19 November 2007"],
    "gpl2-title": ["GNU General Public License Version 2, June 1991"],
    "gpl3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "lgpl2.1-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "lgpl3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "agpl3-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY, without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v 2.0"],
    "epl1-form": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl2-form": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "bsl-form": ["Distributed under the Boost Software License, Version 1.0"],
    "bsl-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib-origin": ["The origin of this software must not be misrepresented", "1. The origin of this software must not be misrepresented"],
    "ncsa-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "ofl-form": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "wtfpl-do": ["You just DO WHAT THE FUCK YOU WANT TO", "0. You just DO WHAT THE FUCK YOU WANT TO"],
    "cc0-waive": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
}
# Fixed values: (licence, identifiers in order), the most specific rules first.
TEXT_RULES = [
    ("Apache-2.0", ["under:Apache-2.0", "apache2-comply", "apache2-copy", "apache2-law", "apache2-see"]),
    ("Apache-2.0", ["under:Apache-2.0", "apache2-comply", "apache2-copy"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("MIT", ["name:MIT", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT-0", ["mit-grant-0", "mit-warranty"]),
    ("GPL-3.0-or-later", ["gpl-published", "later-3", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-published", "later-2", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-3-or-later", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-2-or-later", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl-2-alone", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl-published", "later-2.1"]),
    ("LGPL-3.0-or-later", ["lgpl-published", "later-3"]),
    ("AGPL-3.0-or-later", ["agpl-published", "later-3"]),
    ("GPL-3.0-or-later", ["gpl-published", "later-3"]),
    ("GPL-2.0-or-later", ["gpl-published", "later-2"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("NCSA", ["ncsa-grant", "mit-warranty"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
    ("Apache-2.0", ["apache2-title-name", "apache2-title-date"]),
    ("GPL-2.0-only", ["gpl-title", "date-gpl2"]),
    ("GPL-3.0-only", ["gpl-title", "date-gpl3"]),
    ("LGPL-2.1-only", ["lgpl-title", "date-lgpl2.1"]),
    ("LGPL-3.0-only", ["lgpl-title", "date-gpl3"]),
    ("AGPL-3.0-only", ["agpl-title", "date-agpl3"]),
    ("Apache-2.0", ["apache2-title"]),
    ("GPL-2.0-only", ["gpl2-title"]),
    ("GPL-3.0-only", ["gpl3-title"]),
    ("LGPL-2.1-only", ["lgpl2.1-title"]),
    ("LGPL-3.0-only", ["lgpl3-title"]),
    ("AGPL-3.0-only", ["agpl3-title"]),
    ("GPL-3.0-or-later", ["gpl-3-or-later"]),
    ("GPL-2.0-or-later", ["gpl-2-or-later"]),
    ("GPL-2.0-only", ["gpl-2-alone"]),
    ("LGPL-3.0-or-later", ["lgpl-3-or-later"]),
    ("AGPL-3.0-or-later", ["agpl-3-or-later"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("PostgreSQL", ["postgresql-grant"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("EPL-1.0", ["epl1-form"]),
    ("EPL-2.0", ["epl2-form"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["bsl-form"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("OFL-1.1", ["ofl-form"]),
    ("WTFPL", ["wtfpl-do"]),
    ("CC0-1.0", ["cc0-waive"]),
]

#: What "or later" is called after a licence's name.
LATER = ("or later", "or any later version", "or at your option any later version", "or newer", "or above")
VERBS = "licensed|released|distributed|available|published|provided"
#: What notices put before a licence's name becomes "under"; sentences are normalised already.
FORM = (
    "^(?:and )?(?:(?:(?:this|the|all|our|its) )?(?:[a-z]+ ){1,3}(?:is|are) |it is )?(?:(?:dual|also|made|double) )?"
    f"(?:{VERBS}) under (?:(?:either|both) )?(?:of )?(?:the )?(?:terms of )?(?:either )?(?:the )?(?:following license )?"
)
#: Words that a name may follow in the list after "under"; what shows that a name is not at its end; words of the longest name.
LISTED = ("under", "and", "or", "the", "either", "both", "license", "licenses", "of")
GOES_ON = "^(?:[0-9].*|v[0-9].*|version|later|newer)$"
MOST_WORDS = 14
#: Operators of SPDX expressions, the tag with its colon, and lines that begin with "License:".
TAG = "SPDX-License-Identifier"
OPERATORS = r"[\x20\t]+(?:OR|AND|WITH)[\x20\t]+"
TAGGED = rf"(?i){TAG}:[\x20\t]*"
#: (pattern, replacement) before the cutting.
BEFORE = (
    (r"(?i)(^|[\r\n])([^A-Za-z0-9\r\n]*)licen[sc]es?[\x20\t]*:{1,2}[\x20\t]*(?:OSI[\x20\t]+Approved[\x20\t]*::[\x20\t]*)?([^\x20\t\r\n])", "$1$2licensed under $3"),
    ("(?i)\\bv\\.[\\x20\\x09-\\x0D]+([0-9])", "v $1"),
)
#: Ends of sentences, with line breaks as ends and as spaces (a line without letters, blank or with a
#: comment's signs, always ends one).
#: Signs between a full stop and the white space after it belong to the end.
END = r"[.!?;:][^A-Za-z0-9\x20\x09-\x0D]*[\x20\x09-\x0D]+"
BREAKS = (END + r"|[\x0A-\x0D]+", END + r"|[\x0A\x0D][^A-Za-z0-9]*[\x0A\x0D]")


def plain(sentence: str) -> str:
    """A sentence normalised as the scan does it, before its form is looked at."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def names() -> dict[str, list[str]]:
    """Names by licence: the fixed ones, and for each "or later" those of the version alone with what ``LATER`` lists."""
    out = {k: list(own) for k, own in NAMES.items()}
    for spdx, own in NAMES.items():
        later = spdx.replace("-only", "-or-later")
        if later != spdx:
            out[later] += [f"{n} {more}" for n in own for more in LATER if f"{n} {more}" not in out[later]]
    return out


def listed_names() -> dict[str, str]:
    """Names and SPDX identifiers, normalised, as they stand after "under", with the identifiers of their sentences."""
    out = {n: f"under:{spdx}" for spdx, own in names().items() for n in own}
    for spdx in NAMES:
        out.setdefault(plain(spdx), f"under:{spdx}")
    for old, spdx in OLDER.items():
        out.setdefault(plain(old), f"under:{spdx}")
    return out


def default_sentences() -> dict[str, list[str]]:
    """The known sentences, normalised, by identifier: texts, names alone, names after "under", SPDX tags."""
    out = {k: [re.sub(FORM, "under ", plain(s)) for s in own] for k, own in TEXTS.items()}
    for spdx, own in names().items():
        out[f"name:{spdx}"] = [form + n for n in own for form in ("", "the ")]
        out[f"under:{spdx}"] = ["under " + n for n, k in LISTED_NAMES.items() if k == f"under:{spdx}"]
        out[f"spdx:{spdx}"] = [plain(f"{TAG} {spdx}")]
    for old, spdx in OLDER.items():
        out[f"spdx:{spdx}"].append(plain(f"{TAG} {old}"))
    taken = {s for k, own in out.items() if k in TEXTS for s in own}
    return {k: own if k in TEXTS else [s for s in own if s not in taken] for k, own in out.items()}


LISTED_NAMES = listed_names()
SENTENCES = default_sentences()
RULES = TEXT_RULES + [(spdx, [f"{kind}:{spdx}"]) for kind in ("spdx", "under", "name") for spdx in NAMES]


def by_sentence(sentences: dict[str, list[str]]) -> dict[str, str]:
    return {s: name for name, known in sentences.items() for s in known}


def hints(sentences: dict[str, list[str]]) -> list[str]:
    """Patterns of which every text with a known sentence matches one: some word, or the first two, of each sentence.

    Words are taken one by one, the one that the most remaining sentences have first.  Long words are
    preferred, and "under" is none, since a form stands for it.
    """
    left = {}
    for s in by_sentence(sentences):
        words = [w for w in s.split() if w != "under"]
        most = max(map(len, words))
        if most > 3:
            left[s] = {w for w in words if len(w) >= min(6, most)}
        else:  # a short name alone, such as MIT: what must stand before it
            left[s] = {f"(?:{VERBS})[^A-Za-z0-9]+under|licen[sc]es?[ \\t]*:"} if s.startswith("under ") else {"[^A-Za-z0-9]+".join(words[:2])}
    chosen = []
    while left:
        count: dict[str, int] = {}
        for words in left.values():
            for w in words:
                count[w] = count.get(w, 0) + 1
        best = max(sorted(count), key=count.__getitem__)
        chosen.append(best)
        left = {s: words for s, words in left.items() if best not in words and best not in s}
    return chosen


def hint(sentences: dict[str, list[str]]) -> str:
    return "(?i)" + "|".join(hints(sentences))


def hinted(low: Column, sentences: dict[str, list[str]]) -> Column:
    """Whether a text in lower case matches the hint; words are looked for as they are, which is faster than a pattern."""
    own = hints(sentences)
    out = F.lit(False)
    for w in own:
        if w.isalnum():
            out = out | F.contains(low, F.lit(w))
    pairs = [w for w in own if not w.isalnum()]
    return out | F.rlike(low, F.lit("(?i)" + "|".join(pairs))) if pairs else out


def operands(text: Column) -> Column:
    """The text with a tag, without its colon, before every operand of the expression that follows a tag on its line."""
    parts = F.split(text, TAGGED)

    def own(part: Column) -> Column:
        line = F.regexp_extract(part, r"^[^\r\n]*", 0)
        later = F.regexp_replace(line, r"([0-9])\+", "$1-or-later")
        return F.concat(F.lit(f"{TAG} "), F.regexp_replace(later, OPERATORS, f"\n{TAG} "), F.regexp_replace(part, r"^[^\r\n]*", ""))

    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), own), ""))


def before(text: Column) -> Column:
    """The text as it is cut; tags are rare, and other texts are spared their pass."""
    out = F.when(F.rlike(text, F.lit(TAGGED)), operands(text)).otherwise(text)
    for pattern, new in BEFORE:
        out = F.regexp_replace(out, pattern, new)
    return out


def normalised(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " ")), FORM, "under ")


def _texts(values) -> Column:
    """A constant array of texts without line breaks, as one literal."""
    return F.split(F.lit("\n".join(values)), "\n")


def listed(words: Column, known: Column) -> Column:
    """Identifiers of the names in the list after "under", in order; at each place the longest."""

    def at(p: Column) -> Column:
        sizes = F.sequence(F.least(F.lit(MOST_WORDS), F.size(words) - p), F.lit(1), F.lit(-1))
        found = F.transform(
            sizes,
            lambda k: F.when(~F.coalesce(F.rlike(F.get(words, p + k), F.lit(GOES_ON)), F.lit(False)), F.element_at(known, F.array_join(F.slice(words, p + 1, k), " "))),
        )
        return F.get(F.array_compact(found), 0)

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: (p > 0) & F.get(words, p - 1).isin(*LISTED))
    return F.array_compact(F.transform(places, at))


def identifiers(text: Column, breaks: str, sentences: dict[str, list[str]], names: dict[str, str]) -> Column:
    """Array of the identifiers of the known sentences, and of the names in other notices, in order."""
    table = by_sentence(sentences)
    known = F.map_from_arrays(_texts(table), _texts(table.values()))
    known_names = F.map_from_arrays(_texts(names), _texts(names.values())) if names else None

    def of(s: Column) -> Column:
        whole = F.array_compact(F.array(F.element_at(known, s)))
        if known_names is None:
            return whole
        return F.when(F.startswith(s, F.lit("under ")) & (F.size(whole) == 0), listed(F.split(s, " "), known_names)).otherwise(whole)

    return F.flatten(F.transform(F.transform(F.split(text, breaks), normalised), of))


def rule_pattern(seq: list[str]) -> tuple[str, str]:
    """Pattern of the identifiers in order with others between them, and what stays of a match."""
    parts = ["\\|" + re.sub(r"([^A-Za-z0-9:-])", r"\\\1", i) + "\\|" for i in seq]
    return "(.*?)".join(parts), "".join(f"${k + 1}" for k in range(len(seq) - 1))


def linear_pattern(seq: list[str]) -> tuple[str, str]:
    """The same matches in one pass: each begins where the last ended, and no part is ever tried again.

    If the first place of an identifier leads to no match, a later one does not either.
    """
    parts = ["\\|" + re.sub(r"([^A-Za-z0-9:-])", r"\\\1", i) + "\\|" for i in seq]
    return "\\G" + "".join(f"(?>(.*?){p})" for p in parts), "".join(f"${k + 1}" for k in range(len(seq)))


def matched(ids: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Array of the licences whose rules match, in the order of the rules.

    The sequence is a string of identifiers, each between bars; what a rule has matched is taken out,
    wherever it matches, before the next rule is tried.
    """
    text = F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|"))
    state = F.struct(text.alias("left"), F.array().cast("array<string>").alias("out"))
    columns = zip(*[(name, *linear_pattern(seq)) for name, seq in rules])
    table = F.arrays_zip(*[_texts(c).alias(k) for k, c in zip(("name", "seq", "rest"), columns)])

    def step(acc: Column, rule: Column) -> Column:
        hit = F.rlike(acc["left"], rule["seq"])
        return F.struct(
            F.when(hit, F.regexp_replace(acc["left"], rule["seq"], rule["rest"])).otherwise(acc["left"]).alias("left"),
            F.when(hit, F.concat(acc["out"], F.array(rule["name"]))).otherwise(acc["out"]).alias("out"),
        )

    return F.when(F.size(ids) > 0, F.aggregate(table, state, step)["out"]).otherwise(F.array().cast("array<string>"))


def scan(
    docs: DataFrame, id: str = "doc_id", text: str = "text", sentences: dict[str, list[str]] | None = None, rules: list | None = None,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``sentence_ids`` and ``licenses`` (arrays of strings).

    ``sentence_ids`` are in the order of the text, of the reading that knows more sentences (of
    equal ones, the reading by lines).  ``licenses`` are distinct and sorted.  Null and empty texts
    have neither; repeated rows are scanned alike; extra columns are ignored; an empty table gives
    no rows.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    if names is None:
        names = LISTED_NAMES if sentences is SENTENCES else {}
    none = F.array().cast("array<string>")
    # one step after the other: what a later step reads more than once is computed once
    out = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.lower(text).alias("low"))
    out = out.select("id", F.when(hinted(F.col("low"), sentences), before(F.col("text"))).alias("chosen"))
    out = out.select("id", *[identifiers(F.col("chosen"), b, sentences, names).alias(f"ids{k}") for k, b in enumerate(BREAKS)])
    more = F.when(F.size("ids1") > F.size("ids0"), F.col("ids1")).otherwise(F.col("ids0"))
    both = F.array_sort(F.array_union(matched(F.col("ids0"), rules), matched(F.col("ids1"), rules)))
    return out.select(F.col("id").alias(id), F.coalesce(more, none).alias("sentence_ids"), F.coalesce(both, none).alias("licenses"))


def digest(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    return scanned.select(
        id, F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"),
        F.size("sentence_ids").cast("long").alias("n_sentences"),
    )


def oracle_sql(sentences=SENTENCES, rules=RULES, names=LISTED_NAMES) -> str:
    """The same scan of ``documents`` in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    back = lambda s: quote(re.sub(r"\$([0-9])", r"\\\1", s))
    known = "MAP {" + ", ".join(f"{quote(s)}: {quote(n)}" for s, n in by_sentence(sentences).items()) + "}"
    listed = "MAP {" + ", ".join(f"{quote(s)}: {quote(n)}" for s, n in names.items()) + "}"
    chosen = f"CASE WHEN regexp_matches(coalesce(text, ''), {quote(hint(sentences))}) THEN text ELSE '' END"
    line = "regexp_extract(x, '^[^\\r\\n]*')"
    own = (
        f"{quote(TAG + ' ')} || regexp_replace(regexp_replace({line}, '([0-9])\\+', '\\1-or-later', 'g'), {quote(OPERATORS)}, chr(10) || {quote(TAG + ' ')}, 'g')"
        " || regexp_replace(x, '^[^\\r\\n]*', '')"
    )
    text = f"p[1] || array_to_string(list_transform(p[2:], lambda x: {own}), '')"
    for pattern, new in BEFORE:
        text = f"regexp_replace({text}, {quote(pattern)}, {back(new)}, 'g')"
    norm = f"regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), {quote(FORM)}, 'under ')"
    longest = (
        f"list_filter(list_transform(range(least({MOST_WORDS}, len(w) - q + 1), 0, -1), lambda j:"
        f" CASE WHEN NOT coalesce(regexp_full_match(w[q + j], {quote(GOES_ON)}), false) THEN n[array_to_string(w[q : q + j - 1], ' ')] END), lambda y: y IS NOT NULL)[1]"
    )
    words = ", ".join(map(quote, LISTED))
    in_list = f"list_filter(list_transform(list_filter(range(2, len(w) + 1), lambda q: w[q - 1] IN ({words})), lambda q: {longest}), lambda y: y IS NOT NULL)"
    of = (
        f"CASE WHEN k[u] IS NOT NULL THEN [k[u]] WHEN starts_with(u, 'under ') THEN list_transform([string_split(u, ' ')], lambda w: {in_list})[1]"
        " ELSE CAST([] AS VARCHAR[]) END"
    )
    ids = lambda b: f"flatten(list_transform(list_transform(regexp_split_to_array(t, {quote(b)}), lambda s: {norm}), lambda u: {of}))"
    steps = []
    for name, seq in rules:
        p, rest = rule_pattern(seq)
        steps.append(f"{{'name': {quote(name)}, 'seq': {quote(p)}, 'rest': {back(rest)}}}")
    hits = lambda ids: (
        f"list_reduce(list_transform([{', '.join(steps)}], lambda r: {{'left': '', 'out': [r.name], 'seq': r.seq, 'rest': r.rest}}),"
        f" lambda a, r: {{'left': CASE WHEN regexp_matches(a.left, r.seq) THEN regexp_replace(a.left, r.seq, r.rest, 'g') ELSE a.left END,"
        f" 'out': CASE WHEN regexp_matches(a.left, r.seq) THEN list_concat(a.out, r.out) ELSE a.out END, 'seq': '', 'rest': ''}},"
        f" {{'left': '|' || array_to_string({ids}, '||') || '|', 'out': CAST([] AS VARCHAR[]), 'seq': '', 'rest': ''}}).out"
    )
    return f"""WITH g AS (SELECT doc_id, regexp_split_to_array({chosen}, {quote(TAGGED)}) AS p FROM documents
), h AS (SELECT doc_id, {text} AS t, {known} AS k, {listed} AS n FROM g
), i AS (SELECT doc_id, {ids(BREAKS[0])} AS ids0, {ids(BREAKS[1])} AS ids1 FROM h
), m AS (SELECT doc_id, ids0, ids1, CASE WHEN len(ids0) + len(ids1) > 0 THEN list_concat({hits("ids0")}, {hits("ids1")}) ELSE [] END AS out FROM i)
SELECT doc_id, array_to_string(CASE WHEN len(ids1) > len(ids0) THEN ids1 ELSE ids0 END, ',') AS sentence_ids,
       array_to_string(list_sort(list_distinct(out)), ',') AS licenses,
       CAST(greatest(len(ids0), len(ids1)) AS BIGINT) AS n_sentences
FROM m"""
