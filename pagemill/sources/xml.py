"""XML as a table, without a parser: tags and texts are cut by one pattern, and windows over them find levels, ends and parents.

A node is an element (``name``, ``attrs``) or a text (``name`` is ``#text``). ``pos`` is its place among the pieces of its document, ``end``
that of its end tag; ``parent`` and ``parent_name`` are the place and name of the element it lies in, null at the root. So what lies inside an element are the nodes
between ``pos`` and ``end``, and its children are an equi-join on ``parent``. Nothing here runs outside the JVM.

Names have the prefix that the caller's ``names`` give a namespace, whatever prefix the document uses. ``error`` of a document says why it
isn't well formed, has a document type, or binds one prefix twice; what nodes such a document has mean nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_QUOTED = r"""(?:"[^"]*+"|'[^']*+')"""
_PIECE = rf"""<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>|<(?:[^<>"']++|{_QUOTED})*+>|[^<]++|<"""
_ATTRIBUTE = rf"""[^\s="'<>/]+\s*=\s*{_QUOTED}"""
_DECLARED = rf"""\sxmlns(?::[^\s="'<>/]+)?\s*=\s*{_QUOTED}"""
_ENTITY = r"&(?:amp|lt|gt|quot|apos|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});"
TEXT = "#text"


def utf8(content: Column) -> Column:
    """The text of a part's bytes, with their byte order mark's encoding, else UTF-8; null where they aren't that."""
    mark = F.hex(F.substring(content, 1, 2))
    plain = F.try_validate_utf8(content.cast("string"))
    wide = F.when(mark.isin("FFFE", "FEFF") & (F.octet_length(content) % 2 == 0), F.decode(content, "UTF-16"))
    return F.regexp_replace(F.when(mark.isin("FFFE", "FEFF"), wide).otherwise(plain), "^﻿", "")


def _character(digits: Column, base: int) -> Column:
    code = F.conv(digits, base, 10).cast("int")
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def unescaped(text: Column) -> Column:
    """``text`` with references decoded and line ends as in XML."""
    lines = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    return F.when(text.contains("&"), _decoded(lines)).otherwise(lines)


def _decoded(text: Column) -> Column:
    def piece(p: Column) -> Column:
        out = F.when(p.startswith("&#x"), _character(F.regexp_extract(p, "^&#x([0-9A-Fa-f]+);$", 1), 16)).when(p.startswith("&#"), _character(F.regexp_extract(p, "^&#([0-9]+);$", 1), 10))
        for name, own in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
            out = out.when(p == f"&{name};", own)
        return out.otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY + "|[^&]+|&"), F.lit(0)), piece), "")


def _value(attribute: Column) -> Column:
    """What stands between the quotes of ``name="value"``."""
    value = F.translate(F.regexp_extract(attribute, r"""^[^"']*+["']([\s\S]*)["']$""", 1), "\t\n\r", "   ")
    return F.when(attribute.contains("&"), _decoded(value)).otherwise(value)


def _named(raw: Column, renames: Column, bare: bool) -> Column:
    """A name with its prefix renamed; ``bare``: whether names without a prefix are in the default namespace."""
    prefix = F.when(raw.contains(":"), F.substring_index(raw, ":", 1)).otherwise("")
    local = F.substring_index(raw, ":", -1)
    to = F.get(F.filter(renames, lambda r: r["own"] == prefix), F.lit(0))["to"]
    new = F.when(F.lit(not bare) & (prefix == ""), raw).when(to == "", local).when(to.isNotNull(), F.concat_ws(":", to, local)).otherwise(raw)
    return F.when(F.size(renames) == 0, raw).otherwise(new)


def pieces(documents: DataFrame, keys: Sequence[str], xml: str, names: dict[str, str], kept: Sequence[str] = ()) -> DataFrame:
    """The nodes of ``documents`` (keys, ``xml``) and what shows that one can't be read; see ``nodes`` and ``errors``. ``names``: prefixes by
    namespace; ``kept``: columns that go along.

    Documents that are dealt by ``keys``, or by some of them, stay where they are: they are cut there, and all windows follow those keys."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    declared = F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(_DECLARED), F.lit(0)), lambda d: F.struct(F.regexp_extract(d, r"^\sxmlns:?([^\s=]*)", 1).alias("own"), _value(d).alias("uri"))))

    def to(d: Column) -> Column:
        prefix = F.try_element_at(known, d["uri"])
        new = F.when(prefix.isNotNull(), prefix).when(d["own"].isin(*names.values()), F.concat(F.lit("_"), d["own"])).otherwise(d["own"])
        return F.named_struct(F.lit("own"), d["own"], F.lit("to"), new)

    keys, kept = list(keys), list(kept)
    docs = documents.select(*keys, *kept, F.col(xml).alias("_xml"), declared.alias("_declared"))
    twice = F.size(F.array_distinct(F.transform("_declared", lambda d: d["own"]))) < F.size("_declared")
    early = F.when(F.col("_xml").isNull(), "not text").when(F.col("_xml").rlike("<!(?i:DOCTYPE)"), "it has a document type").when(twice, "a prefix is bound twice")
    renames = F.filter(F.transform("_declared", to), lambda r: r["own"] != r["to"])
    cut = F.when(F.col("_error").isNull(), F.regexp_extract_all("_xml", F.lit(_PIECE), F.lit(0))).otherwise(F.array(F.lit("")))
    docs = docs.withColumn("_error", early).select(*keys, *kept, "_error", renames.alias("_renames"), F.posexplode_outer(cut).alias("pos", "_piece"))
    rows = docs.select(*keys, *kept, "_error", "_renames", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("_piece", F.lit("")).alias("_piece"))
    piece = F.col("_piece")
    data = piece.startswith("<![CDATA[")
    kind = F.when(piece == "", "other").when(~piece.startswith("<") | data, "text").when(piece.startswith("</"), "end").when(piece.startswith("<!") | piece.startswith("<?"), "other").when(piece == "<", "bad")
    kind = kind.when(piece.endswith("/>"), "empty").otherwise("begin")
    raw = F.regexp_extract(piece, r"^</?([^\s/>]+)", 1)
    is_text, tag = F.col("_kind") == "text", F.col("_kind").isin("begin", "end", "empty")
    text = F.when(data, F.regexp_replace(piece, r"^<!\[CDATA\[|\]\]>$", "")).otherwise(unescaped(piece))
    own = F.transform(F.regexp_extract_all(piece, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: F.struct(_named(F.rtrim(F.substring_index(a, "=", 1), F.lit(" \t\n\x0b\f\r")), F.col("_renames"), False).alias("k"), _value(a).alias("v")))
    attributes = F.when(piece.contains("="), F.map_from_entries(own)).otherwise(F.create_map().cast("map<string,string>"))
    unknown = ~data & F.col("_kind").isin("text", "begin", "empty") & piece.contains("&") & piece.rlike("&(?!" + _ENTITY[1:] + ")")
    rows = rows.withColumn("_kind", kind).select(
        *keys, *kept, "_error", "pos", "_kind", F.when(tag, _named(raw, F.col("_renames"), True)).alias("_name"), F.when(F.col("_kind").isin("begin", "empty"), attributes).alias("attrs"), F.when(is_text, text).alias("text"),
        F.coalesce(unknown, F.lit(False)).alias("_unknown"), (is_text & piece.rlike(r"\S")).alias("_says"),
    )
    # One window for depths and for the last tag. Depths below zero are those of documents with a loose end, which are no documents.
    so_far, step = W.partitionBy(*keys).orderBy("pos"), F.when(F.col("_kind") == "begin", 1).when(F.col("_kind") == "end", -1).otherwise(0)
    depth, last = F.sum(step).over(so_far.rowsBetween(W.unboundedPreceding, 0)), F.last(F.when(tag, F.struct("_kind", "pos", "_name")), ignorenulls=True).over(so_far.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"_depth": depth.cast("int"), "_last": last})

    # A slot holds what lies right in the elements of one level, and those elements' own ends. So behind a begin its end is the next there,
    # and the parent is that of the last first child: what comes right behind a begin lies in it.
    slot = F.when(F.col("_kind") == "begin", F.col("_depth")).when(F.col("_kind").isin("end", "empty", "text"), F.col("_depth") + 1)
    began = F.when((F.col("_last._kind") == "begin") & F.col("_kind").isin("begin", "empty", "text") & (F.col("_slot") > 1), F.struct(F.col("_last.pos").alias("pos"), F.col("_last._name").alias("name")))
    beside = W.partitionBy(*keys, "_slot").orderBy("pos")
    rows = rows.withColumn("_slot", slot).withColumn("_began", began)
    rows = rows.withColumns({"_next": F.lead(F.struct("pos", "_name")).over(beside), "_up": F.last("_began", ignorenulls=True).over(beside.rowsBetween(W.unboundedPreceding, 0))})

    begins, node = F.col("_kind") == "begin", F.col("_kind").isin("begin", "empty", "text")
    lost = begins & (F.col("_next").isNull() | ~F.col("_name").eqNullSafe(F.col("_next._name")))
    loose = (F.col("_kind") == "end") & (F.col("_depth") < 0) | (F.col("_kind") == "bad")
    outside = F.col("_says") & (F.col("_depth") == 0)
    fault = F.coalesce("_error", F.when(F.coalesce(lost | loose | outside | F.col("_unknown"), F.lit(False)), "not well formed"))
    root = begins & (F.col("_depth") == 1) | (F.col("_kind") == "empty") & (F.col("_depth") == 0)
    return rows.select(
        *keys, *kept, "pos", F.when(begins, F.col("_next.pos")).otherwise(F.col("pos")).alias("end"), F.col("_slot").alias("level"), F.col("_up.pos").alias("parent"), F.col("_up.name").alias("parent_name"),
        F.when(is_text, F.lit(TEXT)).when(node, F.col("_name")).alias("name"), "attrs", "text", F.when(is_text, F.col("_last._kind") == "begin").alias("first"), fault.alias("fault"), root.alias("root"),
    ).filter("name is not null or fault is not null or pos = 0")


def nodes(pieces: DataFrame) -> DataFrame:
    """The nodes among ``pieces``: keys, pos, end, level, parent, parent_name, name, attrs (map), text, first (of a text: it comes before its
    element's first child)."""
    return pieces.filter("name is not null").drop("fault", "root")


def errors(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, error) of the documents of ``pieces`` that can't be read."""
    early = F.max(F.when(F.col("fault") != "not well formed", F.col("fault")))
    bad = F.bool_or(F.col("fault").isNotNull()) | (F.count_if("root") != 1)
    return pieces.groupBy(*keys).agg(F.coalesce(early, F.when(bad, "not well formed")).alias("error")).filter("error is not null")
