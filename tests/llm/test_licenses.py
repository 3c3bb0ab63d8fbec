import re

from pyspark.sql import functions as F

from noticeflow.llm import licenses

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = licenses.SENTENCES["mit-grant"][0] + ":\n\n" + licenses.SENTENCES["mit-notice"][0] + ".\n\n" + licenses.SENTENCES["mit-warranty"][0] + "."
TEXTS = {
    1: (APACHE, "Apache-2.0"), 2: (MIT.replace(" of ", "\nof "), "MIT"), 3: ("Ea thing.\nReleased under the MIT License.", "MIT"),
    4: ("no end of line\nLicensed under CC BY-NC 4.0.\nnext", "CC-BY-NC-4.0"), 5: (None, ""), 6: ("", ""), 7: ("the license of poets", ""),
    8: ("Released$$$ under&&& the%%% MIT### License.*** and so on", "MIT"), 9: ("word " * 50000 + ". " + "Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    10: ("This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.", "GPL-3.0-only,MIT"),
    11: (licenses.SENTENCES["mit-notice"][0] + ". " + licenses.SENTENCES["mit-grant"][0] + ".", ""), 12: ("SPDX-License-Identifier: MIT\n", "MIT"),
    13: ("Released under the MIT License.\n" * 3, "MIT"), 14: ("not Released under the MIT License.", ""),
}


def normalised(s):
    return re.sub(licenses.FORM, "under ", re.sub("[^a-z0-9]+", " ", s.lower()).strip())


def tagged(text):
    """A tag before each operand, typed out without patterns over the whole text."""
    first, *parts = re.split(licenses.TAGGED, text)
    for p in parts:
        line = re.match(r"[^\r\n]*", p)[0]
        operands = re.split(licenses.OPERATORS, re.sub(r"([0-9])\+", r"\1-or-later", line))
        first += "\n".join(f"{licenses.TAG} {o}" for o in operands) + p[len(line) :]
    return first


def known_in(sentence, known):
    if sentence in known:
        return [known[sentence]]
    words, out = sentence.split(" "), []
    for q in range(1, len(words)) if words[0] == "under" else ():
        if words[q - 1] in licenses.LISTED:
            for k in range(min(licenses.MOST_WORDS, len(words) - q), 0, -1):
                name, after = " ".join(words[q : q + k]), " ".join(words[q + k : q + k + 1])
                if name in licenses.LISTED_NAMES and not re.search(licenses.GOES_ON, after):
                    out.append(licenses.LISTED_NAMES[name])
                    break
    return out


def brute(text):
    best, found = [], set()
    known = licenses.by_sentence(licenses.SENTENCES)
    text = tagged(text or "")
    for pattern, new in licenses.BEFORE:
        text = re.sub(pattern, re.sub(r"\$", r"\\", new), text)
    for b in licenses.BREAKS:
        ids = [i for s in re.split(b, text) for i in known_in(normalised(s), known)]
        best = list(ids) if len(ids) > len(best) else best
        for name, seq in licenses.RULES:
            at = 0
            while True:  # each identifier at its first place after the one before
                places, p = [], at
                for i in seq:
                    if i not in ids[p:]:
                        break
                    p = ids.index(i, p) + 1
                    places.append(p - 1)
                if len(places) < len(seq):
                    break
                found.add(name)
                for q in places:
                    ids[q] = None
                at = p
            ids = [i for i in ids if i]
    return best, sorted(found)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in TEXTS.items()], "doc_id long, text string").withColumn("ids0", F.lit(1))
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, (text, want) in TEXTS.items():
        assert (got[i].sentence_ids, got[i].licenses) == brute(text), i
        assert ",".join(got[i].licenses) == want, i
    assert licenses.scan(docs.limit(0)).count() == 0


def test_own_tables(spark):
    """The prefilter follows the table that is given."""
    docs = spark.createDataFrame([(1, "Gebt es weiter.\nNichts sonst.\nOhne Gewähr"), (2, "Gebt es weiter."), (3, "MIT License")], "doc_id long, text string")
    sentences, rules = {"pass": ["gebt es weiter"], "none": ["ohne gew hr"]}, [("Own", ["pass", "none"])]
    got = {r.doc_id: r for r in licenses.scan(docs, sentences=sentences, rules=rules).collect()}
    assert (got[1].licenses, got[2].licenses, got[2].sentence_ids, got[3].licenses) == (["Own"], [], ["pass"], [])


def test_tables():
    known = licenses.by_sentence(licenses.SENTENCES)
    # what "under" stands for is in the text
    whole = lambda s: "licensed " + s if s.startswith("under ") else s
    assert all(re.search(licenses.hint(licenses.SENTENCES), whole(s)) and s == normalised(s) for s in known)
    assert {i for _, seq in licenses.RULES for i in seq} <= set(licenses.SENTENCES)
    assert sum(map(len, licenses.SENTENCES.values())) == len(known)  # no sentence has two identifiers
    assert len({name for name, _ in licenses.RULES}) >= 50
