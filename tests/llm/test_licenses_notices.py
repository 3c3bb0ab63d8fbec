"""Notices as people write them, expressions of any length, and time that grows with the text alone."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeflow.llm import licenses

NOTICES = [
    ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", ["MIT"]),
    ("Dual licensed under MIT or Apache-2.0", ["Apache-2.0", "MIT"]),
    ("Licensed under the MIT license and the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    ("License: MIT", ["MIT"]),
    ("  * License: Apache-2.0\nmore", ["Apache-2.0"]),
    ("Code is available under the terms of the Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("Licensed under either of the Apache License, Version 2.0 or the MIT license at your option.", ["Apache-2.0", "MIT"]),
    ("License :: OSI Approved :: MIT License", ["MIT"]),
    ("This library is distributed under the GNU General Public License version 2 or later, see COPYING.", ["GPL-2.0-or-later"]),
    ("Released under the GNU GPL v3 or any later version.", ["GPL-3.0-or-later"]),
    ("All files are released under the BSD 3-Clause License (see LICENSE).", ["BSD-3-Clause"]),
    ("It is licensed under the ISC License. See LICENSE for more.", ["ISC"]),
    ("The software is published under the GNU General Public License version 2.1 of the future.", []),
    ("Your driver's license: expired", []),
    ("It was released under pressure and the mitten was lost.", []),
    ("The report is available under embargo.", []),
    ("Licensed under mitigation rules", []),
]
IDS = ["MIT", "Apache-2.0", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "Unlicense", "NCSA", "PostgreSQL", "0BSD", "BSL-1.0", "CC0-1.0", "EPL-2.0", "OFL-1.1", "WTFPL", "UPL-1.0", "AFL-3.0", "OSL-3.0", "ECL-2.0", "MS-PL"]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.licenses for r in licenses.scan(docs).collect()}


def test_notices(spark):
    got = found(spark, [t for t, _ in NOTICES])
    assert [(NOTICES[i][0], got[i]) for i in range(len(NOTICES))] == [(t, sorted(w)) for t, w in NOTICES]


@pytest.mark.parametrize("joint", [" OR ", " AND ", " OR\t"])
def test_expressions_of_any_length(spark, joint):
    sizes = [1, 2, 3, 7, 8, 9, 10, 20]
    texts = [f"x OR y\n// SPDX-License-Identifier: ({joint.join(IDS[:n])})\nA OR B" for n in sizes]
    texts += ["SPDX-License-Identifier: " + joint.join(IDS * 2), "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", "spdx-license-identifier:MIT"]
    got = found(spark, texts)
    for i, n in enumerate(sizes):
        assert got[i] == sorted(IDS[:n])
    assert got[len(sizes)] == sorted(IDS) and got[len(sizes) + 1] == ["GPL-2.0-or-later"] and got[len(sizes) + 2] == ["MIT"]


def test_sql_reads_notices_alike(spark):
    texts = [t for t, _ in NOTICES] + [f"a SPDX-License-Identifier: {' OR '.join(IDS)} \n b", "", None, "under", "licensed under ", "License:", "License:\nMIT"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licenses.digest(licenses.scan(docs)).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == sorted(con.execute(licenses.oracle_sql()).fetchall())


def test_matches_of_rules_are_those_of_the_pattern(spark):
    """The one-pass pattern against the plain one, on sequences where identifiers repeat and overlap."""
    import random
    import re

    rng = random.Random(3)
    rules = [("X", ["a", "b", "c"]), ("Y", ["a", "b"]), ("Z", ["b", "b"]), ("W", ["c"])]
    sequences = [rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(300)]

    def plain(ids):
        left, out = "|" + "||".join(ids) + "|", []
        for name, seq in rules:
            p, rest = licenses.rule_pattern(seq)
            if ids and re.search(p, left):
                left = re.sub(p, re.sub(r"\$(\d)", r"\\\1", rest), left)
                out.append(name)
        return out

    rows = spark.createDataFrame(list(enumerate(sequences)), "i int, ids array<string>")
    got = {r.i: r.m for r in rows.select("i", licenses.matched(F.col("ids"), rules).alias("m")).collect()}
    assert [got[i] for i in range(len(sequences))] == [plain(s) for s in sequences]


def test_time_doubles_with_the_text(spark):
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    took = []
    for n in (1000, 2000, 4000, 8000):
        docs = spark.createDataFrame([(1, grant * n)], "doc_id long, text string")
        began = time.time()
        licenses.scan(docs).collect()
        took.append(time.time() - began)
    assert took[3] < 2.6 * took[2] + 1 and took[2] < 2.6 * took[1] + 1
