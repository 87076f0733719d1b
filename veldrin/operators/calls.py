"""State of calls: what is still to be asked, questions asked again in vain, and audio that is the agent's own echo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import conversation

# 16-bit mono audio at 16 kHz, MP3 at 48 kbit a second, the room's tail after a reply.
SAMPLE_RATE, SAMPLE_BYTES, MP3_BYTES_PER_SECOND, SETTLE_SECONDS = 16_000, 2, 6_000, 0.4
# Parts of errors that are worth another try, and the delay that a service asks for.
TRANSIENT = ("429", "resource_exhausted", "500", "502", "503", "504", "unavailable", "deadline", "timeout", "overloaded")
RETRY_DELAY = r"'retryDelay':\s*'(\d+(?:\.\d+)?)s'"


def next_slot(required: Column, filled: Column, given_up: Column) -> Column:
    """The first required slot that is neither filled nor given up, else null; all are arrays, null ones empty."""
    none = F.array().cast("array<string>")
    closed = F.concat(F.coalesce(filled, none), F.coalesce(given_up, none))
    return F.try_element_at(F.array_except(F.coalesce(required, none), closed), F.lit(1))


def asked_in_vain(unanswered: Column, text: Column) -> Column:
    """Is the text one of the questions (an array) that got no answer, asked again?"""
    return F.coalesce(F.exists(unanswered, lambda q: conversation.same_question(q, text)), F.lit(False))


def to_facts(collected: Column, names: dict[str, str]) -> Column:
    """A map of slots with the keys that rules use; slots that `names` hasn't keep their own."""
    if not names:
        return collected
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform_keys(collected, lambda k, _: F.coalesce(F.try_element_at(known, k), k))


def duration_ms(n_bytes: Column, rate: int = SAMPLE_RATE) -> Column:
    return n_bytes / (rate * SAMPLE_BYTES) * 1000


def mp3_ms(n_bytes: Column) -> Column:
    return F.coalesce(n_bytes / MP3_BYTES_PER_SECOND * 1000, F.lit(0.0))


def echoes(rows: DataFrame) -> DataFrame:
    """rows (call_id, at in seconds, seq, spoken_ms of a reply or null, n_bytes of a chunk of audio or null) with `echo`:
    is the chunk to be thrown away, as the last reply before it is still in the room? A reply's budget of bytes or of
    time, whichever is used up first, ends it; a chunk that begins within both is an echo. Ties of `at` go by seq."""
    ordered = Window.partitionBy("call_id").orderBy("at", "seq")
    reply = F.col("spoken_ms").isNotNull()
    seconds = F.col("spoken_ms") / 1000 + SETTLE_SECONDS
    rows = rows.withColumns({
        "_reply": F.sum(reply.cast("long")).over(ordered),
        "_until": F.last(F.when(reply, F.col("at") + seconds), ignorenulls=True).over(ordered),
        "_budget": F.last(F.when(reply, F.floor(seconds * SAMPLE_RATE * SAMPLE_BYTES)), ignorenulls=True).over(ordered)})
    heard = Window.partitionBy("call_id", "_reply").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_bytes").over(heard), F.lit(0))
    echo = F.coalesce(F.col("n_bytes").isNotNull() & (before < F.col("_budget")) & (F.col("at") < F.col("_until")), F.lit(False))
    return rows.withColumn("echo", echo).drop("_reply", "_until", "_budget")


def is_transient(error: Column) -> Column:
    found = F.lit(False)
    for part in TRANSIENT:
        found = found | F.contains(F.lower(error), F.lit(part))
    return F.coalesce(found, F.lit(False))


def suggested_wait(error: Column) -> Column:
    """Seconds that the service asked for, else null."""
    return F.nullif(F.regexp_extract(error, RETRY_DELAY, 1), F.lit("")).cast("double")
