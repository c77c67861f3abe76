"""Rule files: a JSON (or, where PyYAML is installed, YAML) object with a list ``rules``.

A rule's ``severity`` and texts replace the built-in ones, and the values of ``expected_value`` and ``tolerance`` that ``VALUES`` names
are what the rule compares with."""

from __future__ import annotations

import copy
import hashlib
import json
import math
import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import EXPECTED, FOUNDATION, RULE_COLUMNS, check_rules, rules_table


def _read(spark: SparkSession, path: str) -> bytes | None:
    """The bytes of one file wherever Spark can read it; None if there is no such file."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.format("binaryFile").load(path).select("content").head(1)
    except AnalysisException:
        return None
    return bytes(rows[0].content) if rows else None


def _parsed(data: bytes, path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML rule files need PyYAML; JSON ones don't") from e
        return yaml.safe_load(data)
    return json.loads(data)


#: What is read of a rule: its name and severity, and texts, of which one in the local language counts before the other.
_TEXTS = {"category": "category", "object_type": "object_type", "expected": "expected_value", "source": "source", "suggestion": "suggestion"}
_RULE = "struct<" + ", ".join(f"{n}: variant" for n in ("rule_id", "severity", *(f"{v}{end}" for v in _TEXTS.values() for end in ("_zh", "")))) + ">"


def _text(c: Column) -> Column:
    """A value as text: a string as it is, anything else as JSON; empty ones and null are none."""
    shown = F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string")).otherwise(F.to_json(c))
    return F.when(~F.is_variant_null(c) & (shown != ""), shown)


def rules_of(spark: SparkSession, config: dict) -> DataFrame:
    """The rules of a configuration in its order, with ``RULE_COLUMNS``, not checked: what a rule leaves out comes from the built-in one."""
    one = spark.createDataFrame([(json.dumps(config.get("rules"), ensure_ascii=False),)], "j string")
    listed = F.from_json("j", f"array<{_RULE}>")
    rows = one.select(F.posexplode(listed).alias("ordinal", "r")).select("ordinal", "r.*")
    own = {"severity": _text(F.col("severity"))} | {k: F.coalesce(_text(F.col(f"{v}_zh")), _text(F.col(v))) for k, v in _TEXTS.items()}
    rows = rows.select("ordinal", _text(F.col("rule_id")).alias("rule_id"), *[v.alias(k) for k, v in own.items()])
    known = rules_table(spark).select("rule_id", F.col("engine"), *[F.col(k).alias(f"_{k}") for k in own])
    prefix = F.substring_index("rule_id", "-", 1)
    fallback = {"category": prefix, "source": F.lit("built-in rules")}
    filled = {k: F.coalesce(k, f"_{k}", fallback.get(k, F.lit(None).cast("string"))) for k in own}
    out = rows.join(known, "rule_id", "left").withColumns(filled).withColumn("engine", F.coalesce("engine", F.lit("advanced")))
    return out.select(*[F.col(n).cast(k) for n, k in (c.split() for c in RULE_COLUMNS.split(", "))])


def check_origin(spark: SparkSession, path: str, config: dict) -> None:
    """A file that was made from another one beside it (``runtime_mirror``: source_file, source_sha256) is refused once that has changed."""
    made_from = config.get("runtime_mirror") or {}
    name, digest = made_from.get("source_file"), made_from.get("source_sha256")
    origin = _read(spark, posixpath.join(posixpath.dirname(path), name)) if name and digest else None
    if origin is not None and hashlib.sha256(origin).hexdigest() != digest.lower():
        raise ValueError(f"{name} has changed since {path} was made from it")


# What rule files call the values that a rule compares with, and where these are in ``EXPECTED``.
VALUES = {
    "PAGE-001": {"expected_value.width_inches": "page.width_inches", "expected_value.height_inches": "page.height_inches", "expected_value.orientation": "page.orientation", "tolerance.twips": "page.twips"},
    "PAGE-002": {**{f"expected_value.{side}_inches": f"margins.{side}" for side in ("top", "bottom", "left", "right")}, "tolerance.twips": "margins.twips"},
    "PAGE-003": {"expected_value.header_distance_pt": "distances.header", "expected_value.footer_distance_pt": "distances.footer", "tolerance.twips": "distances.twips"},
    "HF-001": {"expected_value.east_asian_font": "header.font", "expected_value.size_pt": "header.size_pt", "expected_value.text": "header.text", "tolerance.size_pt": "header.allowed"},
    "HF-002": {"expected_value.rule_count": "header.rules"},
    "FONT-001": {"expected_value.east_asian_font": "body.east", "expected_value.latin_font": "body.latin", "expected_value.size_pt": "body.size_pt", "tolerance.size_pt": "body.allowed"},
    "PARA-001": {"expected_value.line_spacing": "paragraph.line_multiple", "tolerance.line_spacing_twips": "paragraph.twips"},
    **{
        f"HEAD-00{level}": {"expected_value.size_pt": f"headings.{level}", "expected_value.east_asian_font": f"heading_font.{level}", "tolerance.size_pt": f"heading_allowed.{level}"}
        for level in (1, 2, 3)
    },
}


def _value(given: object, present: object, what: str) -> object:
    """``given`` as a value of the kind of ``present``; a number may be written with a unit behind it, as in "1.5 lines"."""
    if isinstance(present, str):
        if isinstance(given, str) and given.strip():
            return given.strip()
        raise ValueError(f"{what} must be a text, not {given!r}")
    if isinstance(given, str) and (m := re.match(r"\s*(\d+(?:\.\d+)?)(?![\d.])", given)):
        given = float(m[1])
    if isinstance(given, bool) or not isinstance(given, (int, float)) or not math.isfinite(given) or given < 0:
        raise ValueError(f"{what} must be a number from zero on, not {given!r}")
    return given


def expected_of(config: dict, default: dict = EXPECTED) -> dict:
    """``default`` with the values that a configuration's rules state. A rule whose ``expected_value`` or ``tolerance`` is a sentence, or
    lacks a value, keeps the built-in one; a value of the wrong kind is refused."""
    out = copy.deepcopy(default)
    for name in ("heading_font", "heading_allowed"):
        if not isinstance(out[name], dict):
            out[name] = dict.fromkeys(out["headings"], out[name])
    for rule in config.get("rules") or ():
        for source, place in VALUES.get(rule.get("rule_id") if isinstance(rule, dict) else None, {}).items():
            (block, field), (group, key) = source.split("."), place.split(".")
            stated = rule.get(block)
            if isinstance(stated, dict) and stated.get(field) is not None:
                at = int(key) if key.isdigit() else key
                out[group][at] = _value(stated[field], out[group][at], f"{rule['rule_id']}: {source}")
    return out


def read_config(spark: SparkSession, path: str) -> dict:
    """The configuration in a file; refused without a list of rules, and by ``check_origin``."""
    data = _read(spark, path)
    if data is None:
        raise ValueError(f"there is no rule file {path}")
    config = _parsed(data, path)
    check_origin(spark, path, config)
    if not isinstance(config.get("rules"), list):
        raise ValueError(f"{path} has no list of rules")
    return config


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rules of a file, in its order, with ``RULE_COLUMNS``, and the values that they compare with; what a rule leaves out comes from
    the built-in one. Refused is what ``read_config``, ``check_rules`` and ``expected_of`` refuse."""
    config = read_config(spark, path)
    rules = rules_of(spark, config)
    check_rules(rules, needed=FOUNDATION)
    return rules, expected_of(config)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a file alone."""
    return load(spark, path)[0]
