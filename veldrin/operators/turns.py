"""The state of a conversation, turn by turn: slots and corrections, region, questions asked, what went unanswered.

What a turn says by itself is read by columns. What it means for the conversation depends on the turns before: a slot
keeps its first answer until the caller corrects it, a yes counts only if it was asked for, a question that was refused
before and comes again is handed to a person. That is one fold, `Call`, over sorted partitions in batch and over keyed
state in a stream (streaming.turns); assessments are columns again, over the fold's slots.

Turns without a text count as empty ones. Equal (conv_id, turn) rows are taken one after the other, by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.packs import Pack
from . import calls, leads, rules, speech
from . import conversation as C

# Slots that are answered by yes or no, and what a residency answer counts as; cues of an income and its
# least amount; the levels of plans; the trigger of a question asked again in vain; how often a slot is asked.
YES_NO = ("residency", "currently_admitted")
RESIDENT = "PH"
INCOME_CUE = r"(?i)\b(income|earn|salary|month|monthly|sweldo|gaji|penghasilan|thousand|ribu|k\b)\b"
LEAST_INCOME = 1000
PLANS = ("Essential", "Plus", "Max")
ASKED_AGAIN = "ESC-UNKNOWN-REPEAT"
MOST_ASKED = 2
ASK_TAIL, ASK_STEM = 40, 24

READ = (
    "conv_id long, turn long, caller string, refused boolean, trigger string, region string, correcting boolean, age string, age_if_asked string, yes_no boolean, income string, "
    "plan string, full_name string, contact_number string, stems array<string>, asks string")
OUT = (
    "conv_id long, turn long, trigger string, filled map<string,string>, slots map<string,string>, corrections array<string>, region string, asked map<string,int>, given_up array<string>, "
    "unanswered array<string>, assessed map<string,string>, last_asked string")
_MAP = pa.map_(pa.string(), pa.string())
_TYPES = [pa.int64(), pa.int64(), pa.string(), _MAP, _MAP, pa.list_(pa.string()), pa.string(), pa.map_(pa.string(), pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), _MAP, pa.string()]
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
READ_NAMES = [c.split()[0] for c in READ.split(", ")]


def asks(agent: Column, pack: Pack) -> Column:
    """The slot that a reply asks for, by the pack's cues and then by the end of the scripted question; else empty."""
    said, out = F.lower(F.coalesce(agent, F.lit(""))), F.lit("")
    tails = [(s.name, s.ask.lower().split("?")[0][-ASK_TAIL:].strip()[:ASK_STEM]) for s in pack.slots]
    for name, tail in reversed(tails):
        if tail:
            out = F.when(F.contains(said, F.lit(tail)), F.lit(name)).otherwise(out)
    for s in reversed(pack.slots):
        for cue in s.expects:
            out = F.when(F.contains(said, F.lit(cue)), F.lit(s.name)).otherwise(out)
    return out


def plan(text: Column) -> Column:
    """The level that a text names, the last of PLANS if several."""
    return F.coalesce(*[F.when(text.rlike(rf"\b{p}\b"), F.lit(p)) for p in reversed(PLANS)])


def readings(turns: DataFrame, pack: Pack) -> DataFrame:
    """READ from (conv_id, turn, caller, agent, grounded, sought): what each turn says by itself."""
    caller, agent = (F.coalesce(c, F.lit("")) for c in (F.trim("caller"), F.col("agent")))
    amount = C.read_money(caller)
    refused = C.is_refusal(agent, F.coalesce("grounded", F.lit(False)), F.coalesce("sought", F.lit(False)))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), caller.alias("caller"), refused.alias("refused"),
        (C.escalation(caller, {k: list(v) for k, v in pack.detect.items()}) if pack.detect else F.lit("")).alias("trigger"),
        speech.region(caller, {k: list(v.get("markers") or ()) for k, v in pack.variants.items()}).alias("region"), C.is_correction(caller).alias("correcting"),
        C.read_age(caller).cast("string").alias("age"), C.read_age(caller, expecting=True).cast("string").alias("age_if_asked"), C.read_yes_no(caller).alias("yes_no"),
        F.when(caller.rlike(INCOME_CUE) & (amount >= LEAST_INCOME), amount.cast("string")).alias("income"), plan(caller).alias("plan"),
        leads.contact_name(caller).alias("full_name"), leads.contact_number(caller).alias("contact_number"), C.stems(caller).alias("stems"), asks(agent, pack).alias("asks"))


@dataclass
class Call:
    """Where a conversation is. unanswered holds the questions that were refused, with their stems."""

    slots: dict[str, str] = field(default_factory=dict)
    asked: dict[str, int] = field(default_factory=dict)
    given_up: list[str] = field(default_factory=list)
    corrections: list[str] = field(default_factory=list)
    unanswered: list[tuple[str, list[str]]] = field(default_factory=list)
    region: str = "standard"
    last_asked: str = ""
    assessed: dict[str, str] | None = None

    def _filled(self, r: dict) -> dict[str, str]:
        out: dict[str, str] = {}
        open_ = lambda name: name not in self.slots
        if open_("age") or r["correcting"]:
            age = r["age_if_asked"] if r["correcting"] or self.last_asked == "age" else r["age"]
            if age is not None and age != self.slots.get("age"):
                out["age"] = age
        if self.last_asked in YES_NO and open_(self.last_asked) and r["yes_no"] is not None:
            out[self.last_asked] = RESIDENT if self.last_asked == YES_NO[0] else str(r["yes_no"]).lower()
        for name, value in (("monthly_income", r["income"]), ("plan_interest", r["plan"]), ("full_name", r["full_name"]), ("contact_number", r["contact_number"])):
            if value is not None and open_(name):
                out[name] = value
        return out

    def _asked_before(self, stems: list[str]) -> bool:
        now = set(stems)
        return bool(now) and any(old and len(now & set(old)) / min(len(now), len(old)) >= 0.5 for _, old in self.unanswered)

    def turn(self, r: dict) -> tuple:
        """One turn, a row of READ, to the values of a row of OUT after its key."""
        if r["region"] not in ("standard", self.region):
            self.region = r["region"]
        trigger = r["trigger"] or (ASKED_AGAIN if self._asked_before(r["stems"]) else "")
        filled = self._filled(r)
        self.corrections += [f"{k}: {self.slots[k]} -> {v}" for k, v in filled.items() if k in self.slots]
        self.slots.update(filled)
        self.last_asked = slot = r["asks"]
        if not trigger:  # a call that is handed over neither counts what the closing line asks nor is assessed again
            if r["refused"]:
                self.unanswered.append((r["caller"], list(r["stems"])))
            if slot:
                self.asked[slot] = self.asked.get(slot, 0) + 1
                if self.asked[slot] >= MOST_ASKED and slot not in self.slots and slot not in self.given_up:
                    self.given_up.append(slot)
            self.assessed = dict(self.slots)
        return (
            trigger, filled, dict(self.slots), list(self.corrections), self.region, dict(self.asked), list(self.given_up), [q for q, _ in self.unanswered],
            None if self.assessed is None else dict(self.assessed), self.last_asked)


def fold(turns: DataFrame, pack: Pack) -> DataFrame:
    """OUT for every turn of whole conversations; a task holds the state of one at a time."""
    rows = readings(turns, pack).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "caller", "asks", "refused")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, call = None, Call()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["conv_id"] != conv:
                    conv, call = r["conv_id"], Call()
                out.append((r["conv_id"], r["turn"], *call.turn(r)))
            columns = list(zip(*out, strict=True)) or [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(columns, _TYPES, strict=True)], names=OUT_NAMES)

    return rows.mapInArrow(step, OUT)


def assessed(folded: DataFrame, pack: Pack, rule_list: list[dict]) -> DataFrame:
    """folded with `next_slot` and the assessment after each turn that wasn't handed over (null before the first):
    eligible, decided, missing, requirements, notes, decline_reason, declined_by."""
    none = F.array().cast("array<string>")
    rows = folded.withColumn("next_slot", calls.next_slot(F.array(*[F.lit(n) for n in pack.required]) if pack.required else none, F.map_keys("slots"), F.col("given_up")))
    facts = calls.to_facts(F.coalesce("assessed", F.create_map().cast("map<string,string>")), pack.names)
    callers = rows.where("assessed is not null").select(F.struct("conv_id", "turn").alias("at"), F.lit(pack.business_unit).alias("unit"), facts.alias("facts")).dropDuplicates(["at"])
    found = rules.assess(callers, rule_list, key="at").drop("unit").withColumnsRenamed({"at": "_at"})
    return rows.join(found, (F.col("conv_id") == F.col("_at.conv_id")) & (F.col("turn") == F.col("_at.turn")), "left").drop("_at")
