"""Amounts of statements against every amount and difference of their evidence."""

from __future__ import annotations

import random
import re

from tallymark.operators import advice


def by_hand(text, amounts):
    valid = {x for v in amounts if v is not None for x in (abs(v), abs(v) // 100)}
    held = sorted(valid)
    valid |= {x for a in held for b in held if a >= b for x in (a - b, (a - b) // 100)}
    out = []
    for place, said in enumerate(re.findall(r"(?:₹|Rs\.?\s*)([0-9,]+(?:\.[0-9]{2})?)", text or "")):
        if digits := said.replace(",", ""):
            paise = round(float(digits) * 100)
            out.append((place, paise, paise <= 100 or paise in valid or paise // 100 in valid))
    return out


def test_amounts_against_all_differences(spark):
    rng = random.Random(4)
    statements, evidence, want = [], [], []
    for k in range(80):
        amounts = [rng.choice([rng.randint(0, 400), rng.randint(10_000, 99_999), -rng.randint(100, 5_000), None]) for _ in range(rng.randint(0, 5))]
        known = [abs(a) for a in amounts if a is not None] or [7]
        said = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice([rng.choice(known), abs(rng.choice(known) - rng.choice(known)), rng.choice(known) // 100 * 100, abs(rng.choice(known) - rng.choice(known)) // 100 * 100 + 1, rng.randint(0, 99_999)])
            said.append(rng.choice([f"₹{p // 100:,}.{p % 100:02d}", f"Rs. {p // 100}.{p % 100:02d}", f"Rs{p // 100}", f"Rs {p // 100:,}", f"{p}"]))
        text = " and ".join(said) if said else rng.choice(["", None, "nothing", "₹,"])
        statements.append((f"s{k}", text))
        evidence += [(f"s{k}", a) for a in amounts]
        want += [(f"s{k}", *x) for x in by_hand(text, amounts)]
    evidence.append(("other", 5))
    make = spark.createDataFrame
    got = advice.grounded_amounts(make(statements, "statement_id string, text string"), make(evidence, "statement_id string, paise long")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[3] for w in want} == {True, False}
    assert advice.grounded_amounts(make([], "statement_id string, text string"), make(evidence, "statement_id string, paise long")).count() == 0
