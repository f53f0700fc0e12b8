"""Counts of the corruption score against regular expressions, one pass for all of them."""

import random
import re

from tessera.functions import text


def python(pattern):
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))


def test_counts():
    rng = random.Random(9)
    other = text.OTHER
    patterns = [python(p) for p in (f"{other}+", f"(?<!{other}){other}{{1,2}}(?!{other})", f"(?<!{other})[0-9]{{1,3}}(?!{other})", text.SINGLE_LETTERS, text.MIXED_LETTERS, text.SIGNS)]
    for _ in range(3000):
        t = "".join(rng.choice("بتث  \u00a0\u3000AB1#x\n") for _ in range(rng.randrange(60)))
        assert text._corruption(t) == (len(t), *(len(p.findall(t)) for p in patterns))


def test_one_pass(spark):
    """Counts come from one step, not from an expression for each use."""
    plan = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(text.corruption_score("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp" not in plan
