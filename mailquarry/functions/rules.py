"""Detection rules as column expressions: each text is tested once, in its own row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailquarry import lexicon as lx
from mailquarry.functions.text import has_any
from mailquarry.lexicon import Rule

MATCH = "struct<rule_name:string,category:string,severity:string,score:double>"


def rule_matches(text: Column, lowered: Column, rule: Rule) -> Column:
    if rule.pattern is not None:
        return F.regexp_count(text, F.lit(rule.pattern)) > rule.more_than
    if not rule.groups:
        return F.lit(False)
    return reduce(lambda a, b: a & b, [has_any(lowered, [s.lower() for s in g]) for g in rule.groups])


def with_matches(texts: DataFrame, text: str, lowered: str, rules: list[Rule] | None = None) -> DataFrame:
    """Adds ``matches``, array<struct<rule_name, category, severity, score>> of the rules that match, and ``rule_score``, their highest
    severity score (0 for none).

    Each rule is a column of its own first. Both results read it there, so a text is searched once for each string and in generated code.
    """
    rules = lx.RULES if rules is None else rules
    names = [f"_rule_{i}" for i in range(len(rules))]
    tested = texts.withColumns({n: F.coalesce(rule_matches(F.col(text), F.col(lowered), r), F.lit(False)) for n, r in zip(names, rules, strict=True)})
    found = [
        F.when(F.col(n), F.struct(
            F.lit(r.name).alias("rule_name"), F.lit(r.category).alias("category"),
            F.lit(r.severity).alias("severity"), F.lit(r.score).alias("score")))
        for n, r in zip(names, rules, strict=True)
    ]
    scores = [F.when(F.col(n), F.lit(float(r.score))).otherwise(F.lit(0.0)) for n, r in zip(names, rules, strict=True)]
    return tested.withColumns({
        "matches": F.coalesce(F.array_compact(F.array(*found)), F.array().cast(f"array<{MATCH}>")),
        "rule_score": F.greatest(F.lit(0.0), F.lit(0.0), *scores),
    }).drop(*names)
