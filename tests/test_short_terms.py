"""Short terms, which nearly every text holds."""

import pytest

from memloom.operators import recall

TEXTS = [("a", "wide river", "an old boat"), ("b", "wide road", "in town"), ("c", "on", "at it"), ("d", "RIVER", "boat an"), ("e", "ri", "ver")]


def hits(spark, sets):
    names = ["owner_agent_id", "task_id"]
    m = spark.createDataFrame([(i, 1, "u", "user", None, None, "public", True, k, "x", v) for i, k, v in TEXTS], f"memory_id string, updated_at long, user_id string, scope string, {names[0]} string, {names[1]} string, sensitivity string, user_confirmed boolean, memory_key string, kind string, value string")
    asked = spark.createDataFrame([(s,) for s in sets], "terms array<string>")
    rows = recall.text_hits(m, asked.selectExpr("explode(terms) AS term", "false AS worded"), asked).where("memory_id IS NOT NULL").collect()
    return {(r.memory_id, r.term) for r in rows}


@pytest.mark.parametrize("automaton", [True, False])
def test_told_only_where_all_that_is_asked_for_together_occurs(spark, monkeypatch, automaton):
    if not automaton:
        monkeypatch.setattr(recall, "ahocorasick", None)
    sets = [["river", "an"], ["wide", "in"], ["at", "on"], ["an", "in"], ["river", "boat", "zz"], ["", "it"], ["e", None]]
    want = set()
    for i, k, v in TEXTS:
        has = lambda t, k=k.lower(), v=v.lower(): t in k or t in v
        want |= {(i, t) for s in sets for t in s if t and len(t) >= 3 and has(t)}
        want |= {(i, t) for s in sets if all(s) and all(map(has, s)) for t in s}
    assert hits(spark, sets) == want and ("b", "an") not in want and ("d", "an") in want
