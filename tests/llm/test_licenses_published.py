"""Notices as they are published, with the ends of sentences inside them."""

import re

import duckdb
import pytest

from noticeflow.llm import licenses

GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD4 = """
3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.
"""
MIT = """{}Copyright (c) 2019 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so{}.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
MIT_END = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
FULL = [
    ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS", "Apache-2.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "GPL-3.0-only"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989", "GPL-2.0-only"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n", "LGPL-2.1-only"),
    ("                   GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n", "AGPL-3.0-only"),
]
OTHER = [
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at\n// http://www.boost.org/LICENSE_1_0.txt)", "BSL-1.0"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttp://www.eclipse.org/legal/epl-2.0.\n", "EPL-2.0"),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below", "OFL-1.1"),
    ("The MIT License (MIT)", "MIT"), ("MIT License", "MIT"), ("Licensed under the terms of the zlib license.", "Zlib"),
    ("Dual licensed under the MIT License.", "MIT"), ("The code is available under the Artistic License 2.0.", "Artistic-2.0"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "Apache-2.0,MIT"), ("// SPDX-License-Identifier: GPL-2.0+\n", "GPL-2.0-or-later"),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note\n", "GPL-2.0-only"),
    ("SPDX-License-Identifier: MIT AND ISC AND Zlib AND BSD-3-Clause", "BSD-3-Clause,ISC,MIT,Zlib"), ("SPDX-License-Identifier: GPL-2.0", "GPL-2.0-only"),
    ("the MIT licensee left; SPDX is a format", ""), ("License: see below", ""), ("version 2", ""),
    (MIT.format("MIT License\n\n", MIT_END).replace("furnished to do so", "furnished to do so"), "MIT"), (MIT.format("", MIT_END), "MIT"), (MIT.format("", ""), "MIT-0"),
    (BSD.format(""), "BSD-2-Clause"), (BSD.format(BSD3), "BSD-3-Clause"), (BSD.format(BSD4), "BSD-4-Clause"),
    (ISC.format(", provided that the above\ncopyright notice and this permission notice appear in all copies"), "ISC"), (ISC.format(""), "0BSD"),
    (ZLIB, "Zlib"), (LGPL, "LGPL-2.1-or-later"), (AGPL, "AGPL-3.0-or-later"),
    # other known sentences stand between those of a rule
    (BSD.format(BSD3).replace("1. Redis", "The MIT License\n\n1. Redis"), "BSD-3-Clause,MIT"),
]
SPDX = list(licenses.NAMES)
NOTICES = [(GPL.format(";", ";", 2), "GPL-2.0-or-later"), (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (MPL, "MPL-2.0"), (UNLICENSE, "Unlicense")]
NOTICES += [(re.sub("(?m)^", " * ", n), x) for n, x in NOTICES]
NOTICES += [(form.format(x), x) for x in SPDX for form in ("SPDX-License-Identifier: {}", "#!/bin/sh\n# SPDX-License-Identifier: {}\n\nset -e\n", "/* SPDX-License-Identifier:\t{} */\nint x;", "SPDX-License-Identifier:{}")]
NOTICES += FULL + OTHER + [(re.sub("(?m)^", "# ", n), x) for n, x in FULL[:2] + OTHER[18:26]]
NOTICES += [(f"This project is licensed under the {names[0]}.", x) for x, names in licenses.NAMES.items()]
NOTICES += [("wir gehen\nmit\nihm", ""), ("MIT", ""), ("The Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "")]


def test_published_notices(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(docs)).collect()}
    assert [(t, got[i].licenses) for i, (t, _) in enumerate(NOTICES)] == NOTICES
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(NOTICES)])
    columns = ["doc_id", "sentence_ids", "licenses", "n_sentences"]
    rows = con.sql(f"SELECT {', '.join(columns)} FROM ({licenses.oracle_sql()}) ORDER BY doc_id").fetchall()
    assert rows == [tuple(got[i][c] for c in columns) for i in sorted(got)]


@pytest.mark.parametrize("notice", [n for n, x in NOTICES if x])
def test_the_hint_lets_notices_pass(notice):
    assert re.search(licenses.hint(licenses.SENTENCES), notice)
