"""The space of options against brute force."""

import itertools

import pytest

from granary.operators import choices
from granary.plans import similar  # noqa: F401
from granary.plans.queries import ORACLES, QUERIES
from tests.conftest import comparable

GROUPS = ["a", "b", "c"]
RULES = [{"when": {"a": ["1"], "c": ["2"]}, "disable": {"b": ["1", "3"]}}, {"when": {}, "disable": {"c": ["3"]}}, {"when": {"b": ["2"]}, "disable": {"b": ["2"], "a": ["2"]}}, {"when": {"gone": ["1"]}, "disable": {"a": ["1"]}}]
ROWS = [(p, g, o) for p in ("x", "y") for g in GROUPS for o in "123"][:-2] + [("x", "a", "1"), ("z", "a", "1"), ("x", "a", None), (None, "a", "1")]
SCHEMA = "product string, group_id string, option_id string"


def allowed(state):
    for rule in RULES:
        for g, listed in rule["disable"].items():
            if state[g] in listed and g not in rule["when"] and all(state.get(k) in v for k, v in rule["when"].items()):
                return False
    return True


def by_hand(product):
    given = [sorted({o for p, h, o in ROWS if p == product and h == g and o}) for g in GROUPS]
    return [dict(zip(GROUPS, x, strict=True)) for x in itertools.product(*given)]


def test_space_by_brute_force(spark):
    options = spark.createDataFrame(ROWS, SCHEMA)
    want = sorted((p, *s.values()) for p in "xyz" for s in by_hand(p) if allowed(s))
    assert sorted(map(tuple, choices.configurations(options, GROUPS, RULES).collect())) == want
    use = {tuple(r)[:3]: r.states for r in choices.option_use(options, GROUPS, RULES).collect()}
    assert use == {(p, g, o): sum(w[0] == p and w[1 + GROUPS.index(g)] == o for w in want) for p, g, o in ROWS if p and o}
    assert use["x", "c", "3"] == 0 and use["z", "a", "1"] == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert choices.option_use(empty, GROUPS, RULES).count() == 0


def test_templates(spark):
    options = spark.createDataFrame(ROWS, SCHEMA)
    given = [("x", "{a}/{b}-{a}"), ("x", "{a}/{b}-{a}"), ("x", "no {name}"), ("x", ""), ("x", None), ("z", "{b}"), ("z", "k{a}"), ("new", "as is"), ("new", "{a}")]
    got = sorted(map(tuple, choices.expanded(spark.createDataFrame(given, "product string, template string"), options, GROUPS).collect()))
    assert got == sorted([("x", f"{a}/{b}-{a}") for a in "123" for b in "123"] + [("x", "no {name}"), ("z", "k1"), ("new", "as is")])


def test_rule_faults(spark):
    rules = spark.createDataFrame([(1, "when", "a", "1"), (1, "disable", "a", "9"), (2, "when", "gone", "1"), (2, "disable", "b", "2")], "rule int, part string, group_id string, option_id string")
    got = {tuple(r) for r in choices.rule_faults(rules, spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {(1, "disable", "a", None, "group in both parts"), (1, "disable", "a", "9", "no such option"), (2, "when", "gone", None, "no such group")}


@pytest.mark.parametrize("name", ["option_space", "option_paths", "options_settled"])
def test_queries_match_sql(spark, duck, sf, name):
    assert comparable(QUERIES[name](spark, sf).toPandas()) == comparable(duck.execute(ORACLES[name]).fetchdf())
