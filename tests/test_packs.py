"""Packs and rule files: typed rows, all faults, sections in words."""

import pytest
import yaml

from veldrin.operators import calls
from veldrin.sources import packs as P

GOOD = {
    "pack_id": "good", "version": 1.5, "business_unit": "u1", "language": "en", "persona": {"name": "M", "style": ["short"]}, "opening": " Hi. \n",
    "slots": [{"name": "age", "ask": "How old are you?", "required": True, "expects": ["how old"]}, {"name": "plan_interest", "ask": "Which plan?", "maps_to": "plan"}, {"name": "home", "ask": "Where?", "required": True}],
    "flow": [{"state": "start", "goal": "g", "collect": ["age"], "next": "end"}, {"state": "end", "goal": "g"}], "grounding": {"unsupported": ["I do not know."]}, "objections": {}, "escalation": {"immediate": ["E1"], "detect": {"E2": ["a person"], "E1": ["complain", "sue"]}},
    "business_action": {}, "closing": {"escalated": "One\n moment."}, "service": {"not_understood": "Sorry?", "trouble": "Wait."}, "must_never": ["Lie."], "regional": {"variants": {"east": {"greeting": "yo", "markers": ["yo"], "politeness": ["pls"]}}}}


def write(folder, **docs):
    for name, doc in docs.items():
        (folder / f"{name}.yaml").write_text(doc if isinstance(doc, str) else yaml.safe_dump(doc, sort_keys=False, allow_unicode=True), encoding="utf-8")
    return str(folder)


def test_good_pack(spark, tmp_path):
    packs = P.scan_packs(spark, write(tmp_path, good=GOOD))
    assert P.faults(packs).count() == 0
    pack = P.load_pack(packs, "good")
    assert (pack.opening, pack.required, pack.names["plan_interest"], list(pack.detect), pack.closing["escalated"], pack.variants["east"]["markers"]) == ("Hi.", ("age", "home"), "plan", ["E2", "E1"], "One moment.", ["yo"])
    assert [(r.ord, r.name, r.fact, r.required) for r in P.slots(packs).orderBy("ord").collect()] == [(0, "age", "age", True), (1, "plan_interest", "plan", None), (2, "home", "home", True)]
    assert [(r.ord, r.trigger, r.phrase) for r in P.triggers(packs).orderBy("ord", "phrase").collect()] == [(0, "E2", "a person"), (1, "E1", "complain"), (1, "E1", "sue")]
    row = spark.sql("select map('age', '5', 'plan_interest', 'Max', 'x', 'y') as m, array('age') as filled, array() as up").select(
        calls.to_facts(P.F.col("m"), pack.names).alias("facts"), calls.next_slot(P.F.array(*[P.F.lit(n) for n in pack.required]), P.F.col("filled"), P.F.col("up").cast("array<string>")).alias("next")).first()
    assert row.facts == {"age": "5", "plan": "Max", "x": "y"} and row.next == "home"


def test_every_fault_is_a_row(spark, tmp_path):
    bad = {k: v for k, v in GOOD.items() if k not in ("objections", "version")} | {
        "pack_id": "bad", "grounding": {}, "escalation": {"detect": {}}, "service": {"trouble": ""}, "flow": [{"state": "s", "collect": ["age", "shoe"]}, {"state": "t", "collect": ["hat"]}],
        "slots": [{"name": "age", "ask": "?", "colour": "red"}, {"ask": "?"}, "x"]}
    packs = P.scan_packs(spark, write(tmp_path, bad=bad, broken="a: [", empty="# nothing\n", listed="- a"))
    found = {}
    for r in P.faults(packs).collect():
        found.setdefault(r.pack_id, set()).add(r.fault)
    assert {"missing: objections", "missing: version", "no responses to unsupported questions", "no escalation triggers", "no service line: not_understood", "no service line: trouble",
            "slot age has an unknown key: colour", "slot 2 has no name", "slot 3 is no map"} <= found["bad"]
    assert {f"state {s} collects {c}, which is no declared slot" for s, c in (("s", "shoe"), ("t", "hat"))} <= found["bad"]
    assert all(len(found[p]) == 1 and next(iter(found[p])).startswith("unreadable") for p in ("broken", "empty", "listed"))
    assert P.slots(packs).count() == P.triggers(packs).count() == 0
    with pytest.raises(P.PackError, match="missing: version; .*hat"):
        P.load_pack(packs, "bad")
    with pytest.raises(P.PackError, match="no pack"):
        P.load_pack(packs, "other")


RULES = {
    "version": 3, "units": {"u1": {"name": "Unit one", "hard_rules": [{"id": "A", "field": "age", "test": "18 <= age <= 60", "on_fail": "decline", "reason": "Too young.", "applies_to": ["x", "y"]}], "soft_rules": [{"id": "B", "test": "a == 1", "on_pass": "note", "reason": "So."}],
                           "tenor_months": {"car": "12, 24", "bike": 6}}, "u2": {"down_payment_minimum": {"car": "10%"}}},
    "outcomes": {"decline": {"action": "Say no."}}, "escalation_triggers": [{"id": "E1", "when": "asked.", "action": "transfer"}], "prohibited": ["lie", "guess"]}


def test_rules_to_sections_and_rows(spark, tmp_path):
    docs = P.scan_rules(spark, write(tmp_path, r=RULES, broken="a: ["))
    sections = P.rule_sections(docs, "now")
    assert [(r.source_ref, r.title, r.content) for r in sections.orderBy("source_origin", "place").collect()] == [
        ("rules/r.yaml#u1.hard_rules", "Unit one: criteria that must pass", "A: Too young. Applies to x, y. Condition 18 <= age <= 60, outcome decline."),
        ("rules/r.yaml#u1.soft_rules", "Unit one: criteria that reviewed", "B: So. Condition a == 1, outcome note."),
        ("rules/r.yaml#u1.tenor_months", "Unit one: Available terms", "Available terms by product.\ncar: 12, 24\nbike: 6"),
        ("rules/r.yaml#u2.down_payment_minimum", "u2: Minimum down payment", "Minimum down payment by product.\ncar: 10%"),
        ("rules/r.yaml#E1", "Escalation: E1", "When asked. Action: transfer"),
        ("rules/r.yaml#prohibited", "Actions the agent must never take", "The agent must never do any of the following.\n- lie\n- guess")]
    assert sections.where("array_contains(quality_flags, 'rules_version_3')").count() == 2
    assert [(r.unit, r.kind, r.ord, r.id, r.applies_to) for r in P.rule_rows(docs).orderBy("kind").collect()] == [("u1", "hard", 0, "A", ["x", "y"]), ("u1", "soft", 0, "B", None)]
    got = {r.origin: r for r in P.rule_reports(docs, sections).collect()}
    assert got["rules/r.yaml"].ok and got["rules/r.yaml"].sections == 6 and not got["rules/broken.yaml"].ok and got["rules/broken.yaml"].flags == ["unreadable_source"]
