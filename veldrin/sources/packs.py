"""Conversation packs and rule files: YAML or JSON files to typed rows, with every fault of a file as a row.

Files are read as binary rows and parsed where Spark puts them. Maps whose order counts (triggers, regional variants,
products) become lists. What is wrong with a file is told in full, not at the first fault; a file that can't be parsed
is a row with that fault; one without a byte is no row. Extra keys are kept out of the typed columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a pack must have, and the lines that it must be able to say when the service fails.
REQUIRED = (
    "pack_id", "version", "business_unit", "language", "persona", "opening", "slots", "flow", "grounding", "objections", "escalation",
    "business_action", "closing", "service", "must_never",
)
SERVICE_LINES = ("not_understood", "trouble")
SLOT_KEYS = ("name", "ask", "required", "type", "validate", "why", "sensitive", "may_refuse", "on_invalid", "on_refusal", "maps_to", "expects")
# Kinds of rules and per-product maps of a unit, with how sections name them.
RULE_KINDS = (("hard_rules", "must pass"), ("soft_rules", "reviewed"))
PRODUCT_MAPS = (("down_payment_minimum", "Minimum down payment"), ("tenor_months", "Available terms"))

_SLOT = "struct<name: string, ask: string, required: boolean, type: string, validate: string, why: string, sensitive: boolean, may_refuse: boolean, on_invalid: string, on_refusal: string, maps_to: string, expects: array<string>>"
_VARIANT = "struct<region: string, greeting: string, thanks: string, politeness: array<string>, markers: array<string>, note: string>"
PACK = (
    f"pack_id string, version string, business_unit string, language string, opening string, persona map<string, string>, slots array<{_SLOT}>, "
    "flow array<struct<state: string, goal: string, next: string, collect: array<string>>>, detect array<struct<trigger: string, phrases: array<string>>>, immediate array<string>, "
    f"unsupported array<string>, closing map<string, string>, service map<string, string>, must_never array<string>, variants array<{_VARIANT}>"
)
_RULE = "struct<id: string, field: string, test: string, on_fail: string, on_pass: string, applies_to: array<string>, reason: string>"
_PRODUCTS = "array<struct<product: string, value: string>>"
RULES = (
    f"version string, units array<struct<code: string, name: string, hard_rules: array<{_RULE}>, soft_rules: array<{_RULE}>, down_payment_minimum: {_PRODUCTS}, tenor_months: {_PRODUCTS}>>, "
    "outcomes array<struct<outcome: string, action: string>>, triggers array<struct<id: string, when: string, action: string>>, prohibited array<string>"
)


def _listed(value: object, key: str, rest: str | None = None) -> list | None:
    """A map as a list of its entries, in order."""
    if not isinstance(value, dict):
        return None
    return [{key: k} | ({rest: v} if rest else v if isinstance(v, dict) else {}) for k, v in value.items()]


def _pack_doc(doc: dict) -> dict:
    part = lambda name: doc[name] if isinstance(doc.get(name), dict) else {}
    flat = lambda d: {k: " ".join(v.split()) for k, v in d.items() if isinstance(v, str)}
    return doc | {
        "version": str(doc.get("version", "")), "opening": str(doc.get("opening") or "").strip(), "persona": {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in part("persona").items()},
        "detect": _listed(part("escalation").get("detect") or {}, "trigger", "phrases"), "immediate": part("escalation").get("immediate"), "unsupported": part("grounding").get("unsupported"),
        "closing": flat(part("closing")), "service": flat(part("service")), "variants": _listed(part("regional").get("variants") or {}, "region")}


def _rules_doc(doc: dict) -> dict:
    units = _listed(doc.get("units") or {}, "code") or []
    for unit in units:
        unit["name"] = unit.get("name", unit["code"])
        for key, _ in PRODUCT_MAPS:
            unit[key] = _listed({k: str(v) for k, v in (unit.get(key) or {}).items()}, "product", "value")
    return {"version": str(doc.get("version", "unknown")), "units": units, "outcomes": _listed(doc.get("outcomes") or {}, "outcome"), "triggers": doc.get("escalation_triggers"), "prohibited": doc.get("prohibited")}


def _pack_faults(doc: dict) -> list[str]:
    """What is wrong with the shape of a pack; what depends on its typed contents is told by columns."""
    out = [f"missing: {k}" for k in REQUIRED if k not in doc]
    for k, kind, name in (("slots", list, "list"), ("flow", list, "list"), ("persona", dict, "map"), ("grounding", dict, "map"), ("escalation", dict, "map"), ("closing", dict, "map"), ("must_never", list, "list")):
        if k in doc and not isinstance(doc[k], kind):
            out.append(f"{k} is no {name}")
    for i, slot in enumerate(doc.get("slots") if isinstance(doc.get("slots"), list) else []):
        if not isinstance(slot, dict):
            out.append(f"slot {i + 1} is no map")
            continue
        out += [f"slot {slot.get('name', i + 1)} has no {k}" for k in ("name", "ask") if not slot.get(k)]
        out += [f"slot {slot.get('name', i + 1)} has an unknown key: {k}" for k in slot if k not in SLOT_KEYS]
    return out


def _scan(spark: SparkSession, path: str, made, faults, schema: str) -> DataFrame:
    """(origin, doc, keys, faults, error) of a folder's or glob's YAML and JSON files, sorted names by the caller if it cares."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml,json}").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for batch in batches:
            rows = []
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    doc = yaml.safe_load(content.decode("utf-8"))
                    if not isinstance(doc, dict):
                        raise ValueError("the file holds no map")
                    rows.append((name, json.dumps(made(doc), ensure_ascii=False, default=str), faults(doc), None))
                except (yaml.YAMLError, UnicodeDecodeError, ValueError) as e:
                    rows.append((name, None, [f"unreadable: {type(e).__name__}: {str(e)[:60]}"], f"{type(e).__name__}: {str(e)[:60]}"))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.string())], names=["path", "json", "faults", "error"])

    rows = files.mapInArrow(parse, "path string, json string, faults array<string>, error string")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("origin"), F.from_json("json", schema).alias("doc"), "faults", "error")


def scan_packs(spark: SparkSession, path: str) -> DataFrame:
    """(origin, pack_id, doc, faults) of every pack file; a pack is usable if faults is empty."""
    rows = _scan(spark, path, _pack_doc, _pack_faults, PACK)
    declared = F.transform("doc.slots", lambda s: s["name"])
    collected = F.flatten(F.transform(F.coalesce("doc.flow", F.array()), lambda s: F.transform(F.coalesce(s["collect"], F.array().cast("array<string>")), lambda c: F.struct(s["state"].alias("state"), c.alias("slot")))))
    undeclared = F.transform(F.filter(collected, lambda c: ~F.coalesce(F.array_contains(declared, c["slot"]), F.lit(False))), lambda c: F.concat(F.lit("state "), c["state"], F.lit(" collects "), c["slot"], F.lit(", which is no declared slot")))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    told = F.array_compact(F.array(
        F.when(empty("doc.unsupported"), F.lit("no responses to unsupported questions")), F.when(empty("doc.immediate"), F.lit("no escalation triggers")),
        *[F.when(F.coalesce(F.try_element_at("doc.service", F.lit(line)), F.lit("")) == "", F.lit(f"no service line: {line}")) for line in SERVICE_LINES]))
    typed = F.when(F.col("doc").isNotNull(), F.concat(told, undeclared)).otherwise(F.array().cast("array<string>"))
    return rows.select("origin", F.coalesce("doc.pack_id", F.regexp_replace("origin", r"\.[a-z]+$", "")).alias("pack_id"), "doc", F.concat("faults", typed).alias("faults"))


def faults(packs: DataFrame) -> DataFrame:
    """(origin, pack_id, fault): a row for each fault of each file."""
    return packs.select("origin", "pack_id", F.explode("faults").alias("fault"))


def slots(packs: DataFrame) -> DataFrame:
    """(pack_id, ord, name, ask, ..., fact): the slots of usable packs in order; fact is the name that rules use."""
    rows = packs.where(F.size("faults") == 0).select("pack_id", F.posexplode("doc.slots").alias("ord", "s")).select("pack_id", "ord", "s.*")
    return rows.withColumn("fact", F.coalesce(F.nullif(F.col("maps_to"), F.lit("")), F.col("name")))


def triggers(packs: DataFrame) -> DataFrame:
    """(pack_id, ord, trigger, phrase) of usable packs; a text's trigger is the first of which a phrase occurs."""
    rows = packs.where(F.size("faults") == 0).select("pack_id", F.posexplode("doc.detect").alias("ord", "d"))
    return rows.select("pack_id", "ord", "d.trigger", F.explode("d.phrases").alias("phrase"))


@dataclass(frozen=True)
class Slot:
    name: str
    ask: str = ""
    required: bool = False
    maps_to: str = ""
    expects: tuple[str, ...] = ()

    @property
    def fact(self) -> str:
        return self.maps_to or self.name


@dataclass(frozen=True)
class Pack:
    """A usable pack on the driver, where its few values become literals of plans."""

    pack_id: str
    business_unit: str = ""
    language: str = "en"
    opening: str = ""
    slots: tuple[Slot, ...] = ()
    detect: dict[str, tuple[str, ...]] = field(default_factory=dict)
    variants: dict[str, dict] = field(default_factory=dict)
    unsupported: tuple[str, ...] = ()
    closing: dict[str, str] = field(default_factory=dict)
    service: dict[str, str] = field(default_factory=dict)
    must_never: tuple[str, ...] = ()

    @property
    def names(self) -> dict[str, str]:
        """Slots' names to those of facts, for calls.to_facts."""
        return {s.name: s.fact for s in self.slots}

    @property
    def required(self) -> tuple[str, ...]:
        """For calls.next_slot, in order."""
        return tuple(s.name for s in self.slots if s.required)


class PackError(ValueError):
    """A pack that is missing or has faults; the message holds all of them."""


def load_pack(packs: DataFrame, pack_id: str) -> Pack:
    """The usable pack of that id; one row comes to the driver."""
    found = packs.where(F.col("pack_id") == pack_id).take(1)
    if not found:
        raise PackError(f"no pack {pack_id!r}")
    if found[0].faults:
        raise PackError(f"{pack_id}: " + "; ".join(found[0].faults))
    d = found[0].doc
    return Pack(
        d.pack_id, d.business_unit, d.language, d.opening, tuple(Slot(s.name, s.ask or "", bool(s.required), s.maps_to or "", tuple(s.expects or ())) for s in d.slots),
        {x.trigger: tuple(x.phrases or ()) for x in d.detect or ()}, {v.region: v.asDict() for v in d.variants or ()}, tuple(d.unsupported), d.closing or {}, d.service or {}, tuple(d.must_never or ()))


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """(origin, doc, error) of every rules file; error is null if it could be read."""
    return _scan(spark, path, _rules_doc, lambda doc: [], RULES).select(F.concat(F.lit("rules/"), "origin").alias("origin"), "doc", "error")


def rule_rows(docs: DataFrame) -> DataFrame:
    """Flat rules (unit, kind, ord, id, field, test, on_fail, on_pass, applies_to, reason), as operators.rules takes them."""
    unit = docs.select(F.explode("doc.units").alias("u"))
    kinds = [unit.select(F.col("u.code").alias("unit"), F.lit(kind.split("_")[0]).alias("kind"), F.posexplode(f"u.{kind}").alias("ord", "r")) for kind, _ in RULE_KINDS]
    return kinds[0].unionByName(kinds[1]).select("unit", "kind", "ord", "r.*")


def rule_sections(docs: DataFrame, retrieved_at: str) -> DataFrame:
    """Sections that say the rules in words: by unit and kind, per-product values, triggers, what must never be done; with `place`, their order in a file."""
    def scope(r: Column) -> Column:
        listed = F.array_join(r["applies_to"], ", ")
        return F.when(F.coalesce(F.size(r["applies_to"]), F.lit(0)) > 0, F.concat(F.lit(" Applies to "), listed, F.lit("."))).otherwise(F.lit(""))

    def said(r: Column) -> Column:
        outcome = F.coalesce(F.nullif(r["on_fail"], F.lit("")), r["on_pass"], F.lit(""))
        return F.concat(r["id"], F.lit(": "), F.coalesce(r["reason"], F.lit("")), scope(r), F.lit(" Condition "), F.coalesce(r["test"], F.lit("")), F.lit(", outcome "), outcome, F.lit("."))

    def section(place: list[Column], ref: Column, title: Column, content: Column, level: int, flags: Column | None = None) -> Column:
        return F.struct(
            F.array(*place).alias("place"), F.concat("origin", F.lit("#"), ref).alias("source_ref"), title.alias("title"), content.alias("content"), F.lit(level).alias("heading_level"),
            (F.array().cast("array<string>") if flags is None else flags).alias("quality_flags"))

    def of_unit(u: Column, at: Column) -> Column:
        kinds = [F.when(F.coalesce(F.size(u[kind]), F.lit(0)) > 0, section(
            [F.lit(0), at, F.lit(n)], F.concat(u["code"], F.lit(f".{kind}")), F.concat(u["name"], F.lit(f": criteria that {label}")), F.array_join(F.transform(u[kind], said), "\n"), 2,
            F.array(F.concat(F.lit("rules_version_"), F.col("doc.version"))))) for n, (kind, label) in enumerate(RULE_KINDS)]
        maps = [F.when(F.coalesce(F.size(u[key]), F.lit(0)) > 0, section(
            [F.lit(0), at, F.lit(2 + n)], F.concat(u["code"], F.lit(f".{key}")), F.concat(u["name"], F.lit(f": {label}")),
            F.concat(F.lit(f"{label} by product.\n"), F.array_join(F.transform(u[key], lambda p: F.concat(p["product"], F.lit(": "), p["value"])), "\n")), 3)) for n, (key, label) in enumerate(PRODUCT_MAPS)]
        return F.array(*kinds, *maps)

    none = F.array()
    units = F.flatten(F.transform(F.coalesce("doc.units", none), of_unit))
    listed = F.transform(F.coalesce("doc.triggers", none), lambda t, at: section([F.lit(1), at, F.lit(0)], t["id"], F.concat(F.lit("Escalation: "), t["id"]), F.concat(F.lit("When "), t["when"], F.lit(" Action: "), t["action"]), 3))
    never = F.when(F.coalesce(F.size("doc.prohibited"), F.lit(0)) > 0, F.array(section(
        [F.lit(2), F.lit(0), F.lit(0)], F.lit("prohibited"), F.lit("Actions the agent must never take"),
        F.concat(F.lit("The agent must never do any of the following.\n"), F.array_join(F.transform("doc.prohibited", lambda p: F.concat(F.lit("- "), p)), "\n")), 2))).otherwise(F.array())
    rows = docs.where("doc is not null").select("origin", F.explode(F.array_compact(F.concat(units, listed, never))).alias("s"))
    return rows.select(
        F.lit("rules_file").alias("source_type"), "s.source_ref", F.col("origin").alias("source_origin"), "s.title", "s.content", "s.heading_level", F.lit("en").alias("language"), F.lit(retrieved_at).alias("retrieved_at"),
        F.lit("yaml").alias("extraction_method"), F.length("s.content").alias("char_count"), "s.quality_flags", "s.place")


def rule_reports(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(origin, ok, sections, error, flags): a row for each file, those that couldn't be read or gave nothing included."""
    n = sections.groupBy(F.col("source_origin").alias("_o")).agg(F.count("*").alias("n"))
    rows = docs.join(F.broadcast(n), F.col("origin") == F.col("_o"), "left")
    flags = F.when(F.col("error").isNotNull(), F.array(F.lit("unreadable_source"))).otherwise(F.array().cast("array<string>"))
    return rows.select("origin", (F.coalesce("n", F.lit(0)) > 0).alias("ok"), F.coalesce("n", F.lit(0)).alias("sections"), "error", flags.alias("flags"))
