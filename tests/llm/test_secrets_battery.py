"""Recall of the battery by alphabet and length, and its false finds among words, identifiers and paths."""

import builtins
import random
import re
import string
import sys
import uuid

import pytest

from noticeflow.llm import secrets

ALPHABETS = {
    16: "0123456789ABCDEF", 26: string.ascii_uppercase, 32: string.ascii_uppercase + "234567", 36: string.ascii_lowercase + string.digits,
    52: string.ascii_letters, 62: string.ascii_letters + string.digits, 64: string.ascii_letters + string.digits + "+/",
}
#: Least recall at 20, 32, 40 and 64 characters.  Short strings over small alphabets cannot be told from
#: words; digits alone never are.
LEAST = {16: (0.4, 0.8, 0.9, 0.95), 26: (0.1, 0.4, 0.65, 0.95), 32: (0.15, 0.6, 0.85, 0.95), 36: (0.2, 0.8, 0.9, 0.95), 52: (0.1, 0.8, 0.9, 0.95), 62: (0.4, 0.9, 0.95, 0.95), 64: (0.4, 0.9, 0.95, 0.95)}


def words():
    names = {w.lower() for n in [*sys.stdlib_module_names, *dir(builtins), *dir(str), *dir(dict), *dir(random), *dir(re), *dir(string), *dir(sys)] for w in re.findall("[A-Z]?[a-z]+", n)}
    return sorted(w for w in names if 3 <= len(w) <= 12)


def natural(count, rng):
    """Identifiers, paths, dates, dashed UUIDs and long words."""
    own, out = words(), []
    while len(out) < count:
        w = rng.choices(own, k=rng.randint(3, 7))
        text = rng.choice([
            lambda: w[0] + "".join(map(str.capitalize, w[1:])), lambda: "_".join(w), lambda: "-".join(w), lambda: "/".join(w), lambda: "_".join(w).upper(),
            lambda: "".join(map(str.capitalize, w)) + str(rng.randint(1, 99)), lambda: "".join(w), lambda: f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}/" + w[0] + "-" + w[1],
            lambda: str(uuid.UUID(int=rng.getrandbits(128))), lambda: "src/main/java/" + "/".join(w[:3]) + "/" + "".join(map(str.capitalize, w[:2])) + "2" + w[2].capitalize(),
        ])()
        if re.fullmatch("[A-Za-z0-9+/_-]{20,}", text):
            out.append(text)
    return out


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(12)
    planted = {(a, n): ["".join(rng.choices(s, k=n)) for _ in range(40)] for a, s in ALPHABETS.items() for n in (20, 32, 40, 64)}
    null = natural(5000, rng)
    rows = [(k, "see " + t + " here") for k, t in enumerate(null)] + [(10_000 + k, "see " + t + " here") for k, t in enumerate(t for own in planted.values() for t in own)]
    found = {r.doc_id for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id").where("n_random > 0").collect()}
    return planted, null, found


def test_recall(scanned):
    planted, null, found = scanned
    k, low = 10_000, []
    for (a, n), own in planted.items():
        recall = sum(i in found for i in range(k, k + len(own))) / len(own)
        k += len(own)
        print(a, n, recall)
        if recall < LEAST[a][(20, 32, 40, 64).index(n)]:
            low.append((a, n, recall))
    assert not low


def test_false_finds(scanned):
    _, null, found = scanned
    false = [null[i] for i in found if i < 10_000]
    print(len(false), len(found), false[:20])
    assert len(false) <= 2 * secrets.FALSE_SHARE * len(found)


def test_named_cases(spark):
    texts = ["theQuickBrownFoxJumpsOver", "camelCaseIdentifierNamesAreCommonInCode", "src/main/java/com/example/app/Foo2Bar", "123e4567-e89b-12d3-a456-426614174000", "a1-b2-c3-d4-e5-f6-g7-h8-i9", "QWJLZMXPVTRKHNYBGCFDSQAEWIUOXZKJ"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(natural(300, random.Random(1)))]
    found = {r.doc_id for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id").where("n_random > 0").collect()}
    assert found == {5}
