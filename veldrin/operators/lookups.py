"""Small dimensions beside rows, with a default where a key is unknown: recognition settings by market, voices by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How each market's recogniser is set up: label, language (none where callers switch), words that it needs
# help with, whether switches are expected, regional varieties; and the market that stands in for others.
MARKETS = {
    "health_ph_en": ("English, Philippines", "en", "Solara Health Shield, pre-existing condition, bancassurance", False, []),
    "life_ph": ("Taglish, Philippines", None, "Solara Life, magkano, hulog, benepisyaryo, ma-lapse, reinstatement, bancassurance, sum assured, kada buwan", True, []),
    "multifinance_id": ("Bahasa Indonesia", "id", "Solara Multifinance, cicilan, angsuran, jatuh tempo, pembiayaan, BPKB, plafon, restrukturisasi, nuwun sewu, monggo, nggih, punten, hatur nuhun", False, ["javanese", "sundanese"]),
}
DEFAULT_MARKET, DEFAULT_LANGUAGE = "health_ph_en", "en"
MARKET = "unit string, label string, language_hint string, prompt string, expects_code_switching boolean, regional_varieties array<string>"
#: Rows of a dimension up to which it is broadcast.
SENT = 100_000


def looked_up(rows: DataFrame, key: str, dimension: DataFrame, dimension_key: str, default: object) -> DataFrame:
    """rows with the dimension's other columns, those of its row `default` where the key is null or unknown, and `known`.
    The dimension has a row for each key; it is counted before it is broadcast, and shuffled if it is large."""
    others = [c for c in dimension.columns if c != dimension_key]
    whole = dimension.select(F.col(f"`{dimension_key}`").alias("_key"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_found"))
    sent = F.broadcast(whole) if whole.limit(SENT + 1).count() <= SENT else whole
    stand_in = whole.where(F.col("_key") == F.lit(default)).select(F.col("_found").alias("_default")).limit(1)
    out = rows.join(sent, F.col(f"`{key}`") == F.col("_key"), "left").join(F.broadcast(stand_in), F.lit(True), "left")
    value = F.coalesce("_found", "_default")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[value.getField(c).alias(c) for c in others], F.col("_key").isNotNull().alias("known"))


def markets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(unit, *values) for unit, values in MARKETS.items()], MARKET)


def hints(rows: DataFrame, unit: str = "business_unit") -> DataFrame:
    """rows with their market's recognition settings, those of DEFAULT_MARKET for other units."""
    return looked_up(rows, unit, markets(rows.sparkSession), "unit", DEFAULT_MARKET)


def voices(rows: DataFrame, voice_of: dict[str, str], language: str = "language") -> DataFrame:
    """rows with `voice`, English where a language has none, and `known`, whether it has one."""
    given = rows.sparkSession.createDataFrame(list(voice_of.items()), "lang string, voice string")
    return looked_up(rows, language, given, "lang", DEFAULT_LANGUAGE)


def _percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100).cast("long").cast("string"), F.lit("%"))


def described(switch: Column) -> Column:
    """In words, what speech.code_switch found."""
    named = F.transform(switch["languages"], lambda lang: F.concat(lang, F.lit(" "), _percent(F.element_at(switch["shares"], lang))))
    return F.when(F.size(switch["languages"]) == 0, F.lit("nothing recognisable")).when(~switch["switched"], F.concat(F.element_at(switch["languages"], 1), F.lit(" throughout"))).otherwise(
        F.concat(F.lit("switched between "), F.array_join(named, ", ")))


def explained(register: Column, formal: Column, informal: Column) -> Column:
    """In words, what speech.register found; formal and informal are the words of address found."""
    def listed(words: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(words)), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", "), F.lit("]"))

    parts = F.array_compact(F.array(
        F.when(register["mixed"], F.concat(F.lit("mixes formal "), listed(formal), F.lit(" with informal "), listed(informal))),
        F.when(F.size(register["drift"]) > 0, F.concat(F.lit("drifts into English: "), listed(register["drift"])))))
    return F.when(F.size(parts) == 0, F.lit("consistent")).otherwise(F.array_join(parts, "; "))
