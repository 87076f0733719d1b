"""Calls to leads: contacts that callers give, what a call came to, what is to be done next, one row a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How callers give a name or a number, and the wording of what is to be done.
NAME_CUE = r"\b(?:my name is|this is|it'?s|i am|i'm)\s+([A-Z][a-z']+(?:\s+[A-Z][a-z']+){0,2})\b"
NUMBER = r"(\+?\d[\d\s\-]{8,15}\d)"
FEWEST_DIGITS, MOST_DIGITS = 9, 15
HANDED_OVER = "Handed to a person during the call. No callback needed."
INCOMPLETE = ("Call back to complete qualification. Still needed: ", ".", "the remaining questions")
DECLINED = "Do not quote. Send the declined-applicant letter and offer the alternatives."
QUOTE_THEN = ("Quote from the rate table, then arrange: ", ".")
QUOTE = "Quote from the rate table and call back within one working day."
NOTE_LANGUAGE = {"en": "English", "fil": "Filipino", "id": "Bahasa Indonesia"}
OTHER_NOTE_LANGUAGE = "English"


def contact_name(text: Column) -> Column:
    """The name after the first cue that a capitalised name follows, else null."""
    return F.nullif(F.regexp_extract(text, NAME_CUE, 1), F.lit(""))


def contact_number(text: Column) -> Column:
    """The first run of digits, blanks and dashes that can be a number, if it has 9 to 15 digits; else null."""
    found = F.regexp_extract(text, NUMBER, 1)
    digits = F.length(F.regexp_replace(found, r"\D", ""))
    return F.when(digits.between(FEWEST_DIGITS, MOST_DIGITS), F.trim(found))


def _given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def outcome(escalated_to: Column, decided: Column, eligible: Column) -> Column:
    """escalated, incomplete, qualified or declined; nulls are blank or false."""
    return F.when(_given(escalated_to), F.lit("escalated")).when(~F.coalesce(decided, F.lit(False)), F.lit("incomplete")).when(eligible, F.lit("qualified")).otherwise(F.lit("declined"))


def next_action(escalated_to: Column, decided: Column, eligible: Column, missing: Column, requirements: Column) -> Column:
    """What is to happen; missing and requirements are arrays, null ones empty."""
    lead, end, rest = INCOMPLETE
    needed = F.array_join(missing, ", ")
    arranged = F.array_join(F.transform(requirements, lambda r: F.replace(r, F.lit("_"), F.lit(" "))), ", ")
    by_outcome = {
        "escalated": F.lit(HANDED_OVER),
        "incomplete": F.concat(F.lit(lead), F.when(_given(needed), needed).otherwise(F.lit(rest)), F.lit(end)),
        "declined": F.lit(DECLINED),
        "qualified": F.when(_given(arranged), F.concat(F.lit(QUOTE_THEN[0]), arranged, F.lit(QUOTE_THEN[1]))).otherwise(F.lit(QUOTE))}
    kind = outcome(escalated_to, decided, eligible)
    out = F.lit(None).cast("string")
    for name, text in by_outcome.items():
        out = F.when(kind == name, text).otherwise(out)
    return out


def note_language(language: Column) -> Column:
    """The language that notes are written in, by the pack's."""
    known = F.create_map(*[F.lit(x) for kv in NOTE_LANGUAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.coalesce(language, F.lit(""))), F.lit(OTHER_NOTE_LANGUAGE))


def call_summaries(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per call of `turns` (conv_id, turn, caller): turns; the name and number that were given last; collected,
    a map of slots to their last values, from `answers` (conv_id, turn, slot, value). Aggregates only, so a call with
    very many turns is no single task's; the map is bounded by the number of slots. Of answers at one turn the greatest
    value counts; null slots and values are no answers; a call without answers has an empty map."""
    said = turns.select("conv_id", "turn", contact_name(F.col("caller")).alias("name"), contact_number(F.col("caller")).alias("number"))
    calls = said.groupBy("conv_id").agg(F.count("*").alias("turns"), *[
        F.max(F.when(F.col(c).isNotNull(), F.struct("turn", c)))[c].alias(to) for c, to in (("name", "full_name"), ("number", "contact_number"))])
    last = answers.where("slot is not null and value is not null").groupBy("conv_id", "slot").agg(F.max(F.struct("turn", "value"))["value"].alias("value"))
    held = last.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot", "value")))).alias("collected"))
    return calls.join(held, "conv_id", "left").withColumn("collected", F.coalesce("collected", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def create_leads(calls: DataFrame, on: str) -> DataFrame:
    """Calls (conv_id, escalated_to, decided, eligible, missing, requirements and more) with lead_id, outcome and
    next_action. Ids follow from the day and the call, so a rerun gives the same ones."""
    state = [F.col(c) for c in ("escalated_to", "decided", "eligible")]
    return calls.withColumns({
        "lead_id": F.concat(F.lit(f"LD-{on}-"), F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 16)),
        "outcome": outcome(*state), "next_action": next_action(*state, F.col("missing"), F.col("requirements"))})
