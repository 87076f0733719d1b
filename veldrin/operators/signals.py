"""Signals of a conversation's turns, as expressions over the turn's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import text as X

SIGNAL = "struct<kind:string,confidence:double,evidence:string,speaker:string,detail:string,matched:array<string>,deliberated:boolean>"


def hits(text: Column, listed: list[str]) -> Column:
    """The listed phrases that occur in the text, in the list's order."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    return X.let(padded, lambda t: F.filter(F.array(*[F.lit(p) for p in listed]), lambda p: F.contains(t, p)))


def _all(groups: dict[str, list[str]]) -> list[str]:
    return [p for group in groups.values() for p in group]


def _signal(kind: str, confidence, evidence: Column, speaker: str = "caller", detail: str = "", matched: Column | None = None) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(
        F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), evidence.cast("string").alias("evidence"), F.lit(speaker).alias("speaker"),
        F.lit(detail).alias("detail"), (matched if matched is not None else F.array().cast("array<string>")).alias("matched"), F.lit(False).alias("deliberated"))


def followed_up(agent: Column) -> Column:
    """Whether the agent's reply takes a mention up: whole words, with a-z as the letters."""
    words = "|".join(w.replace(" ", r"\x20") for w in P.FOLLOWED_UP)
    return F.lower(F.coalesce(agent, F.lit(""))).rlike(f"(?<![a-z])(?:{words})(?![a-z])")


def content_words(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in P.STOPWORDS])
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z']+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def repeat_of(text: Column, earlier: Column) -> Column:
    """The first earlier question that shares half of the smaller question's content words; empty if there is none."""
    def same(words: Column, e: Column) -> Column:
        return X.let(content_words(e), lambda o: (F.size(o) > 0) & (F.size(F.array_intersect(words, o)) / F.greatest(F.lit(1), F.least(F.size(words), F.size(o))) >= 0.5))

    def first(words: Column) -> Column:
        found = F.filter(F.coalesce(earlier, F.array().cast("array<string>")), lambda e: same(words, e))
        return F.when(F.size(words) >= 2, F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))).otherwise(F.lit(""))

    return X.let(content_words(text), first)


def lexical(turns: DataFrame) -> DataFrame:
    """turns with `signals`. Columns read, where they exist: caller, agent, agent_refused, escalated_to, corrections,
    silence_ms, asked_before."""
    have = set(turns.columns)

    def col(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    caller, agent = F.coalesce(col("caller", "string"), F.lit("")), F.coalesce(col("agent", "string"), F.lit(""))
    rows = turns.withColumns({f"_h_{k}": hits(caller, _all(g)) for k, g in P.CALLER.items()} | {f"_o_{k}": hits(caller, _all(g)) for k, g in P.OPPORTUNITY.items()} | {f"_r_{k}": hits(agent, g) for k, g in P.AGENT_RISK.items()} | {"_decision": hits(agent, P.DECISION), "_repeat": repeat_of(caller, col("asked_before", "array<string>"))})
    made = []

    def add(when: Column, signal: Column) -> None:
        made.append(F.when(when, signal))

    def first(name: str) -> Column:
        return F.try_element_at(F.col(name), F.lit(1))

    for k in P.CALLER:
        h = F.col(f"_h_{k}")
        add(F.size(h) > 0, _signal(k, F.when(F.size(h) == 1, F.lit(0.72)).otherwise(F.lit(0.88)), first(f"_h_{k}"), matched=h))
    for k in P.OPPORTUNITY:
        add((F.size(f"_o_{k}") > 0) & ~followed_up(agent), _signal("missed_opportunity", 0.74, first(f"_o_{k}"), detail=k, matched=F.col(f"_o_{k}")))
    for k in P.AGENT_RISK:
        add(F.size(f"_r_{k}") > 0, _signal(f"agent_{k}", 0.9, first(f"_r_{k}"), "agent", matched=F.col(f"_r_{k}")))
    add((F.size("_decision") > 0) & (F.size(hits(agent, P.QUALIFIER)) == 0), _signal("missing_disclosure", 0.85, first("_decision"), "agent", matched=F.col("_decision")))
    add(F.coalesce(col("agent_refused", "boolean"), F.lit(False)), _signal("knowledge_gap", 1.0, caller, "agent"))
    add(F.coalesce(col("escalated_to", "string"), F.lit("")) != "", _signal("escalation", 1.0, col("escalated_to", "string"), "agent"))
    add(F.coalesce(F.size(col("corrections", "array<string>")), F.lit(0)) > 0, _signal("data_conflict", 1.0, F.try_element_at(col("corrections", "array<string>"), F.lit(-1))))
    silence = col("silence_ms", "double")
    add(F.coalesce(silence, F.lit(0.0)) >= 4000, _signal("dead_air", 1.0, F.format_string("%.1fs", silence / 1000)))
    add(F.col("_repeat") != "", _signal("repeated_question", 0.8, F.col("_repeat")))
    rows = rows.withColumn("signals", F.array_compact(F.array(*made)))
    return rows.select(*[c for c in turns.columns if c != "signals"], "signals")


def needs_deliberation(caller: Column, signals: Column) -> Column:
    """Whether a model should be asked: after kinds that phrases can't settle, or a long turn in which none was found."""
    kinds = F.transform(signals, lambda s: s["kind"])
    words = F.size(F.regexp_extract_all(F.coalesce(caller, F.lit("")), F.lit(r"\S+"), F.lit(0)))
    return F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in P.DELIBERATE])) | ((words >= 12) & (F.size(kinds) == 0))


def deliberated(reply: Column) -> Column:
    """Signals of a model's reply, sentiment | intent | at risk; a reply of fewer fields has none."""
    parts = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\|"), lambda p: F.lower(F.trim(p)))

    def one(kind: str, confidence: float, value: Column, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), value.alias("evidence"), F.lit("caller").alias("speaker"), detail.alias("detail"), F.array().cast("array<string>").alias("matched"), F.lit(True).alias("deliberated"))

    said = [F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3)]
    risk = F.when(F.startswith(said[2], F.lit("yes")), one("churn_risk", 0.75, F.lit("model judged the caller likely to hang up"), F.lit("")))
    return F.when(F.size(parts) >= 3, F.array_compact(F.array(one("sentiment", 0.7, said[0], said[0]), one("intent", 0.7, said[1], said[1]), risk))).otherwise(F.array().cast(f"array<{SIGNAL}>"))


def asked_before(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "caller") -> DataFrame:
    """(conv, turn, repeat_of): for each turn the first earlier one of its conversation that asks the same. An equi-join
    on conversation and content word, so no turn is compared with one that it shares no word with."""
    words = turns.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.col(text).alias("s"), content_words(F.col(text)).alias("w"))
    items = words.select("c", "t", "s", F.size("w").alias("n"), F.explode("w").alias("x"))
    now, past = items.select("c", "x", "t", "n"), items.select("c", "x", F.col("t").alias("t0"), F.col("n").alias("n0"), F.col("s").alias("s0"))
    shared = now.where("n >= 2").join(past, ["c", "x"]).where("t0 < t").groupBy("c", "t", "t0", "n", "n0").agg(F.count("*").alias("k"), F.first("s0").alias("s0"))
    found = shared.where("k / least(n, n0) >= 0.5").groupBy("c", "t").agg(F.min_by("s0", "t0").alias("repeat_of"), F.min("t0").alias("repeat_turn"))
    return found.select(F.col("c").alias(conversation), F.col("t").alias(turn), "repeat_turn", "repeat_of")
