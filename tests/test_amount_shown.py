"""Amounts for display against the standard library's formats, halves and large amounts among them."""

import random

from noticeflow.operators.sections import amount_shown


def test_one_decimal_of_the_double(spark):
    rng = random.Random(1)
    values = [100_000_000 + 5_000_000 * k for k in range(400)] + [10 ** rng.randint(8, 18) + 5_000_000 * rng.randrange(10**6) for _ in range(300)]
    values += [rng.randrange(10**8, 10**17) for _ in range(300)] + [115_000_000, 125_000_000, 199_999_999, 995_000_000, 99_999_999, 0, -5, -1_234_567]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", amount_shown("v").alias("s")).collect()
    exact = lambda v: int(float(v))
    want = {v: "-" if v == 0 else f"{exact(v) / 1e8:.1f}억 원" if exact(v) >= 10**8 else f"{exact(v):,}원" for v in values}
    assert {r.v: r.s for r in rows} == want
