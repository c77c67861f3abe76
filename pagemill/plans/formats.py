"""Effective formats: document defaults, table style, paragraph style, character style, direct formatting, in that order.

Styles are resolved once for each combination of styles that a document uses; a run or paragraph then adds its direct formatting.
Every value keeps the layer that set it. Missing values stay null: unresolved isn't wrong. Styles of many documents from one template take
little room in files and much in memory, so none of these joins goes by the size of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.layers import tinted

FLAGS = ("b", "bCs", "i", "iCs", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "smallCaps", "caps", "vanish", "webHidden", "noProof")
SLOTS = ("ascii", "hAnsi", "eastAsia", "cs")
#: Names of theme colours that differ from the theme part's.
COLOUR_ALIASES = {"text1": "dk1", "text2": "dk2", "background1": "lt1", "background2": "lt2", "followedHyperlink": "folHlink"}
_MAP = "map<string,struct<v:string,source:string>>"


def _get(m: Column, key: Column | str) -> Column:
    return F.try_element_at(m, F.lit(key) if isinstance(key, str) else key)


def _whole_number(c: Column) -> Column:
    return F.when(c.try_cast("int").isNotNull(), c)


def _theme_font(theme: Column, token: Column, slot: str) -> Column:
    low = F.lower(token)
    kind = F.when(low.startswith("major"), "major.").otherwise("minor.")
    family = F.when(low.contains("eastasia"), "eastAsia").when(low.contains("bidi"), "cs").otherwise({"eastAsia": "eastAsia", "cs": "cs"}.get(slot, "latin"))
    return F.when(token != "", _get(theme, F.concat(kind, family)))


def _colour(m: Column, theme: Column) -> Column:
    direct, token = _get(m, "color.val"), _get(m, "color.themeColor")
    name = token
    for alias, own in COLOUR_ALIASES.items():
        name = F.when(token == alias, own).otherwise(name)
    byte = lambda c: F.when(c.rlike("^[0-9A-Fa-f]{1,2}$"), c)
    base = _get(theme, F.concat(F.lit("color."), name))
    themed = F.when(F.length(base) == 6, tinted(base, byte(_get(m, "color.themeTint")), byte(_get(m, "color.themeShade")))).otherwise(base)
    plain = F.when((direct != "") & (F.lower(direct) != "auto"), F.upper(direct))
    return F.coalesce(plain, themed, F.when(F.lower(direct) == "auto", "auto"))


def _layer(pairs: dict[str, Column]) -> Column:
    """A map of those pairs that have a value."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def run_layer(m: Column, theme: Column) -> Column:
    """One ``rPr``: fonts by slot, flags, sizes and the colour, each resolved within the layer."""
    pairs = {f"font.{s}": F.coalesce(F.nullif(_get(m, f"fonts.{s}"), F.lit("")), _theme_font(theme, _get(m, f"fonts.{s}Theme"), s)) for s in SLOTS}
    pairs |= {f: _get(m, f) for f in (*FLAGS, "u", "vertAlign", "highlight")}
    pairs |= {n: _whole_number(_get(m, n)) for n in ("sz", "szCs", "spacing", "w", "position")}
    return _layer(pairs | {"colour": _colour(m, theme)})


def paragraph_layer(m: Column) -> Column:
    """One ``pPr``; ``line`` is rule and value together, so a later layer replaces both."""
    pairs = {n: _get(m, n) for n in ("jc", "keepNext", "keepLines", "widowControl", "pageBreakBefore", "contextualSpacing", "suppressLineNumbers", "bidi", "tabs", "textDirection")}
    numbers = ("spacing.before", "spacing.after", "ind.left", "ind.right", "ind.firstLine", "ind.hanging", "outlineLvl", "ilvl", "numId")
    pairs |= {n: _whole_number(_get(m, n)) for n in numbers}
    line = _whole_number(_get(m, "spacing.line"))
    rule = F.coalesce(_get(m, "spacing.lineRule"), F.lit("auto"))
    return _layer(pairs | {"line": F.when(line.isNotNull(), F.concat_ws(":", rule, line))})


def fold(layers: Column) -> Column:
    """The merge of ordered layers (array of struct(m, toggles, source)): later values win; in toggling layers a true flag inverts."""

    def merge(acc: Column, layer: Column) -> Column:
        def value(k: Column, v: Column) -> Column:
            inverted = layer["toggles"] & k.isin(*FLAGS) & (v == "1") & F.map_contains_key(acc, k)
            return F.struct(F.when(inverted, F.when(F.try_element_at(acc, k)["v"] == "1", "0").otherwise("1")).otherwise(v).alias("v"), layer["source"].alias("source"))

        new = F.transform_values(layer["m"], value)
        return F.map_concat(F.map_filter(acc, lambda k, v: ~F.map_contains_key(layer["m"], k)), new)

    return F.aggregate(layers, F.create_map().cast(_MAP), merge)


def styles_of(docs: DataFrame) -> DataFrame:
    """One row a document: ``styles``, a map from type:id to its chain (base first) of struct(source, ppr, rpr, whole_ppr, whole_rpr)."""
    theme = F.col("theme")
    own = F.transform("styles", lambda s: F.struct(
        F.concat_ws(":", s["type"], s["style_id"]).alias("key"),
        F.struct(
            F.concat_ws(":", s["type"], s["based_on"]).alias("up"), s["name"].alias("name"), F.concat(s["type"], F.lit("-style:"), s["style_id"]).alias("source"),
            paragraph_layer(s["ppr"]).alias("ppr"), run_layer(s["rpr"], theme).alias("rpr"),
            paragraph_layer(s["whole_ppr"]).alias("whole_ppr"), run_layer(s["whole_rpr"], theme).alias("whole_rpr"),
        ).alias("value"),
    ))
    default = lambda kind: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("styles", lambda s: s["is_default"] & (s["type"] == kind)), lambda s: s["style_id"])), -1)
    docs = docs.filter("error is null").select(
        "doc_id", F.map_from_entries(own).alias("styles"), run_layer(F.col("default_rpr"), theme).alias("default_rpr"), paragraph_layer(F.col("default_ppr")).alias("default_ppr"), "theme",
        *[default(k).alias(f"default_{k}") for k in ("paragraph", "character", "table")],
    )
    return docs


def _chain(kind: str, style_id: Column) -> Column:
    """The keys of a style and its ancestors, base first; it ends at an unknown style or one that it has had."""
    start = F.concat(F.lit(f"{kind}:"), F.coalesce(F.nullif(style_id, F.lit("")), F.col(f"default_{kind}")))
    first = F.filter(F.array(start), lambda k: k.isNotNull() & F.map_contains_key("styles", F.coalesce(k, F.lit(""))))
    step = lambda acc, _: F.when(
        (F.size(acc) > 0) & F.map_contains_key("styles", F.coalesce(F.try_element_at(F.col("styles"), F.get(acc, F.lit(0)))["up"], F.lit(""))),
        F.when(F.array_contains(acc, F.try_element_at(F.col("styles"), F.get(acc, F.lit(0)))["up"]), acc).otherwise(F.concat(F.array(F.try_element_at(F.col("styles"), F.get(acc, F.lit(0)))["up"]), acc)),
    ).otherwise(acc)
    return F.aggregate(F.filter(F.sequence(F.lit(1), F.size("styles") + 1), lambda i: i <= F.size("styles")), first, step)


def _style_layers(kind: str, keys: Column, part: str) -> Column:
    def of(key: Column) -> Column:
        s = F.try_element_at(F.col("styles"), key)
        one = F.struct(s[part].alias("m"), F.lit(True).alias("toggles"), s["source"].alias("source"))
        if kind != "table":
            return F.array(one)
        return F.array(one, F.struct(s[f"whole_{part}"].alias("m"), F.lit(True).alias("toggles"), F.concat(s["source"], F.lit(":wholeTable")).alias("source")))

    return F.flatten(F.transform(keys, of))


def _base(default: str, part: str, kinds: dict[str, str]) -> Column:
    first = F.array(F.struct(F.col(default).alias("m"), F.lit(False).alias("toggles"), F.lit("document-defaults").alias("source")))
    return F.concat(first, *[_style_layers(k, _chain(k, F.col(c)), part) for k, c in kinds.items()])


def run_formats(docs: DataFrame, runs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``runs`` with ``fmt`` (map of struct(v, source)) and its common values: east, latin, size_pt, bold, colour."""
    rows = runs.join(paragraphs.select("doc_id", "part_name", F.col("idx").alias("p_idx"), F.col("style_id").alias("p_style"), "table_style"), ["doc_id", "part_name", "p_idx"])
    used = rows.select("doc_id", "table_style", "p_style", F.col("style_id").alias("r_style")).distinct()
    base = _base("default_rpr", "rpr", {"table": "table_style", "paragraph": "p_style", "character": "r_style"})
    folded = used.join(styles_of(docs).hint("merge"), "doc_id").select("doc_id", F.col("table_style").alias("t"), F.col("p_style").alias("p"), F.col("r_style").alias("r"), fold(base).alias("base"), "theme")
    same = (rows["doc_id"] == F.col("d")) & rows["table_style"].eqNullSafe(F.col("t")) & rows["p_style"].eqNullSafe(F.col("p")) & rows["style_id"].eqNullSafe(F.col("r"))
    out = rows.join(folded.withColumnRenamed("doc_id", "d").hint("merge"), same)
    direct = F.transform_values(run_layer(F.col("rpr"), F.col("theme")), lambda k, v: F.struct(v.alias("v"), F.lit("direct-run").alias("source")))
    out = out.withColumn("_direct", direct)
    out = out.withColumn("fmt", F.map_concat(F.map_filter("base", lambda k, v: ~F.map_contains_key("_direct", k)), F.col("_direct")))
    v = lambda k: _get(F.col("fmt"), k)["v"]
    return out.withColumns({"east": v("font.eastAsia"), "latin": F.coalesce(v("font.hAnsi"), v("font.ascii")), "size_pt": v("sz").cast("int") / 2, "bold": v("b") == "1", "colour": v("colour")}).drop("d", "t", "p", "r", "base", "theme", "_direct")


def paragraph_formats(docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` with ``fmt`` and its common values: alignment, line_multiple, line_pt, outline_level, numbering_id, left_pt, first_pt, tabs; and ``style_name``."""
    used = paragraphs.select("doc_id", "table_style", F.col("style_id").alias("p_style")).distinct()
    base = _base("default_ppr", "ppr", {"table": "table_style", "paragraph": "p_style"})
    name = F.coalesce(_get(F.col("styles"), F.concat(F.lit("paragraph:"), F.col("p_style")))["name"], F.col("p_style"), F.lit(""))
    folded = used.join(styles_of(docs).hint("merge"), "doc_id").select(F.col("doc_id").alias("d"), F.col("table_style").alias("t"), F.col("p_style").alias("p"), fold(base).alias("base"), name.alias("style_name"))
    out = paragraphs.join(folded.hint("merge"), (paragraphs["doc_id"] == F.col("d")) & paragraphs["table_style"].eqNullSafe(F.col("t")) & paragraphs["style_id"].eqNullSafe(F.col("p")))
    direct = F.transform_values(paragraph_layer(F.col("ppr")), lambda k, v: F.struct(v.alias("v"), F.lit("direct-paragraph").alias("source")))
    out = out.withColumn("_direct", direct)
    out = out.withColumn("fmt", F.map_concat(F.map_filter("base", lambda k, v: ~F.map_contains_key("_direct", k)), F.col("_direct")))
    v = lambda k: _get(F.col("fmt"), k)["v"]
    line = F.split(v("line"), ":")
    auto, n = F.get(line, F.lit(0)) == "auto", F.get(line, F.lit(1)).cast("double")
    return out.withColumns({
        "alignment": v("jc"), "line_multiple": F.when(auto, n / 240), "line_pt": F.when(~auto, n / 20), "outline_level": v("outlineLvl").cast("int"), "numbering_id": v("numId").cast("int"),
        "left_pt": v("ind.left").cast("int") / 20, "first_pt": v("ind.firstLine").cast("int") / 20, "tabs": v("tabs"),
    }).drop("d", "t", "p", "base", "_direct")
