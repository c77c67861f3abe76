"""Word packages to documents as relational plans: from the table of parts (``sources.parts``) to the rows of ``docx.SCHEMA``.

Every part that matters is a table of nodes (``sources.xml``); what a document has is found by equi-joins on parents, by windows over places,
and by nesting (``operators.nesting``): what lies in a paragraph, a run or a table is what lies between its begin and its end. Nothing here
runs outside the JVM. Parts and nodes are written once; each group of columns is a query over them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import nesting as N
from ..storage import bucketed, discard, scratch, staged, together
from . import xml
from .docx import MAIN, SCHEMA

K = ["doc_id", "part_name"]
# The namespaces of Word packages, with the prefixes that this library uses for them.
NAMESPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w", "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a", "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp", "urn:schemas-microsoft-com:vml": "v", "urn:schemas-microsoft-com:office:office": "o",
    "http://schemas.openxmlformats.org/drawingml/2006/diagram": "dgm", "http://schemas.openxmlformats.org/package/2006/relationships": "rel",
}
_NOTES = ("footnotes", "endnotes", "comments")
_RUN_FLAGS = ("b", "bCs", "i", "iCs", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "smallCaps", "caps", "vanish", "webHidden", "noProof")
_PARAGRAPH_FLAGS = ("keepNext", "keepLines", "widowControl", "pageBreakBefore", "contextualSpacing", "suppressLineNumbers", "bidi")
_SAYING = ("w:t", "w:delText", "w:instrText", "w:delInstrText")
_COVERING = ("w:hyperlink", "w:fldSimple", "w:ins", "w:del")
_UNREAD = ("docProps/", "customXml/", "_rels/")
# Bytes of parts in a bucket of nodes: BUCKET in large inputs; in small ones fewer, so that all cores have some.
BUCKET, LEAST_BUCKET = 1 << 23, 1 << 19


def attr(name: str) -> Column:
    """An attribute of a node, by its name with prefix (``w:`` if it has none; ``@name`` for one in no namespace)."""
    return F.try_element_at("attrs", F.lit(name[1:] if name.startswith("@") else name if ":" in name else f"w:{name}"))


def _whole(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def _on(value: Column) -> Column:
    return F.when(value.isin("0", "false", "off", "no"), "0").otherwise("1")


def _by_place(value: Column | str, where: Column | None = None, place: str = "pos") -> Column:
    """``value`` of the rows ``where``, as an array in the order of their places."""
    pair = F.struct(F.col(place).alias("o"), (F.col(value) if isinstance(value, str) else value).alias("x"))
    listed = F.array_sort(F.collect_list(pair if where is None else F.when(where, pair)), lambda a, b: a["o"] - b["o"])
    return F.transform(listed, lambda p: p["x"])


def _map(entries: str = "e") -> Column:
    """A map of collected structs (pos, key, value): of one key the first counts."""
    return F.map_from_entries(F.transform(F.sort_array(F.collect_list(entries), asc=False), lambda x: F.struct(x["key"], x["value"])))


def _entries(pairs: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs]), lambda x: x["value"].isNotNull())


class Nodes:
    """The parts and nodes of documents, and what their relationships say."""

    def __init__(self, parts: DataFrame, folder: str, contents: bool = True):
        """``contents``: keep the parts' bytes in ``files`` and ``parts``; else they go as soon as they are cut."""
        self.folder = folder
        self.files = staged(parts, folder, "parts")
        names = self.files.drop("content")
        first = names.filter("part_name is not null").groupBy("doc_id").agg(F.min("path").alias("path"))
        size = names.agg(F.sum("part_size")).first()[0] or 0
        most = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(1, min(-(-size // LEAST_BUCKET), max(most, -(-size // BUCKET))))
        # The bytes are dealt by document once; all that follows stays there.
        dealt = self.files.filter(F.col("part_name").isNotNull()).repartition(self.buckets, "doc_id").join(first.hint("shuffle_hash"), ["doc_id", "path"], "left_semi")
        unread = reduce(Column.__or__, [F.startswith("part_name", F.lit(p)) for p in _UNREAD])
        read = dealt.filter(F.col("content").isNotNull() & ~unread)
        self.parts = dealt
        named = staged(names.filter("part_name is not null").join(first, ["doc_id", "path"], "left_semi"), folder, "names")
        self.names = named.select(*K)
        is_rels = F.col("part_name").endswith(".rels")
        rels = self._cut(read.filter(is_rels).withColumn("told", F.lit(False)), "rel-nodes")
        self.rels = self._rels(xml.nodes(rels))
        self.stories = staged(self._stories(), folder, "stories")
        told = self.stories.select(*K, F.lit(True).alias("_told"))
        others = self._cut(read.filter(~is_rels).join(told.hint("shuffle_hash"), K, "left").withColumn("told", F.coalesce("_told", F.lit(False))), "nodes")
        self.bad = staged(xml.errors(rels, K).unionByName(xml.errors(others, K)), folder, "bad")
        self.nodes = xml.nodes(others).drop("told")
        self.told = xml.nodes(others.filter("told")).drop("told")
        if not contents:
            self.files, self.parts = staged(names, folder, "files"), named
            discard(parts.sparkSession, f"{folder.rstrip('/')}/parts")

    def _cut(self, read: DataFrame, name: str) -> DataFrame:
        rows = xml.pieces(read.select(*K, "told", xml.utf8(F.col("content")).alias("xml")), K, "xml", NAMESPACES, ("told",))
        return bucketed(rows, self.folder, name, self.buckets, ["doc_id"], ["told"])

    def _rels(self, nodes: DataFrame) -> DataFrame:
        rows = nodes.filter("name = 'rel:Relationship'")
        source = F.regexp_replace("part_name", r"_rels/([^/]*)\.rels$", "$1")
        external, target = attr("@TargetMode").eqNullSafe("External"), F.coalesce(attr("@Target"), F.lit(""))
        rows = rows.select("doc_id", source.alias("source_part"), "pos", F.coalesce(attr("@Id"), F.lit("")).alias("rel_id"), F.coalesce(attr("@Type"), F.lit("")).alias("type"), target.alias("target"), external.alias("external"))
        base = F.regexp_extract("source_part", r"^(.*/)?[^/]*$", 1)
        steps = F.split(F.concat(base, F.col("target")), "/")
        up = F.aggregate(steps, F.array().cast("array<string>"), lambda at, x: F.when(x.isin("", "."), at).when(x == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.array_append(at, x)))
        part = F.when(F.startswith("target", F.lit("/")), F.regexp_replace("target", "^/+", "")).otherwise(F.array_join(up, "/"))
        rows = rows.withColumn("target_part", F.when(~F.col("external"), part))
        last = F.max_by(F.struct("pos", "type", "target", "target_part", "external"), "pos").alias("r")
        return rows.groupBy("doc_id", "source_part", "rel_id").agg(last).select("doc_id", "source_part", "rel_id", "r.*")

    def _stories(self) -> DataFrame:
        """(doc_id, part_name, story): the parts with paragraphs, main first."""
        main = self.names.filter(F.col("part_name") == MAIN).withColumn("story", F.lit(-1))
        kind = F.element_at(F.split("type", "/"), -1)
        related = self.rels.filter((F.col("source_part") == MAIN) & kind.isin("header", "footer")).select("doc_id", F.col("target_part").alias("part_name"), F.col("pos").alias("story"))
        fixed = reduce(lambda c, n: c.when(F.col("part_name") == f"word/{n[1]}.xml", n[0]), list(enumerate(_NOTES, 1 << 30)), F.when(F.lit(False), 0))
        notes = self.names.withColumn("story", fixed).filter("story is not null")
        rows = main.unionByName(related.join(self.names, K, "left_semi")).unionByName(notes)
        return rows.groupBy(*K).agg(F.min("story").alias("story"))

    def special(self, kind: str, fallback: str) -> DataFrame:
        """(doc_id, part_name): the part that the main part names as its ``kind``, else ``fallback``, where there is such a part."""
        own = self.rels.filter((F.col("source_part") == MAIN) & F.col("type").endswith(f"/{kind}") & F.col("target_part").isNotNull())
        own = own.groupBy("doc_id").agg(F.min_by("target_part", "pos").alias("_own"))
        docs = self.names.select("doc_id").distinct().join(own, "doc_id", "left").select("doc_id", F.coalesce("_own", F.lit(fallback)).alias("part_name"))
        return docs.join(self.names, K, "left_semi")

    def of(self, parts: DataFrame) -> DataFrame:
        return self.nodes.join(parts.select(*K), K, "left_semi")

    def readable(self) -> DataFrame:
        """(doc_id, path) of the files whose documents can be read."""
        return self.files.select("doc_id", "path").distinct().join(self.errors(), "doc_id", "left_anti")

    def errors(self) -> DataFrame:
        """(doc_id, error) of the documents that can't be read."""
        broken = self.files.filter("error is not null").select("doc_id", "error")
        have = self.names.groupBy("doc_id").agg(*[F.bool_or(F.col("part_name") == n).alias(f"_{i}") for i, n in enumerate(("[Content_Types].xml", MAIN))])
        lack = have.filter("not (_0 and _1)").select("doc_id", F.when(~F.col("_0"), "the package has no [Content_Types].xml").otherwise(f"the package has no {MAIN}").alias("error"))
        rels = self.stories.select("doc_id", F.regexp_replace("part_name", "([^/]*)$", "_rels/$1.rels").alias("part_name"))
        fixed = self.names.filter(F.col("part_name").isin("word/settings.xml", "word/numbering.xml"))
        needed = reduce(DataFrame.unionByName, [self.stories.select(*K), rels, fixed, self.special("styles", "word/styles.xml"), self.special("theme", "word/theme/theme1.xml")]).distinct()
        unfit = self.bad.join(needed, K, "left_semi").select("doc_id", F.concat_ws(": ", "part_name", "error").alias("error"))
        return broken.unionByName(lack).unionByName(unfit).groupBy("doc_id").agg(F.min("error").alias("error"))


def properties(nodes: DataFrame) -> DataFrame:
    """(K, owner, props, style, vanish, sect) of each pPr, rPr and tblPr at ``owner``: its values as flat strings (see ``docx``), the style it names, and whether it hides or ends a section."""
    val = attr("val")
    spaced = [(f"{n}.{a}", F.when(F.col("name") == f"w:{n}", attr(a))) for n, names in (("spacing", ("before", "after", "line", "lineRule")), ("ind", ("left", "right", "firstLine", "hanging"))) for a in names]
    named = lambda names, value: [(n, F.when(F.col("name") == f"w:{n}", value)) for n in names]
    in_paragraph = spaced + named(("jc", "outlineLvl", "textDirection"), val) + named(_PARAGRAPH_FLAGS, _on(val))
    in_run = named(_RUN_FLAGS, _on(val)) + named(("sz", "szCs", "vertAlign", "spacing", "w", "position", "highlight"), F.nullif(val, F.lit(""))) + named(("u",), F.coalesce(F.nullif(val, F.lit("")), F.lit("single")))
    in_run += [(f"color.{k}", F.when(F.col("name") == "w:color", attr(k))) for k in ("val", "themeColor", "themeTint", "themeShade")]
    faces = F.transform(F.map_entries(F.map_filter("attrs", lambda k, v: k.startswith("w:"))), lambda x: F.struct(F.concat(F.lit("fonts."), F.substring(x["key"], 3, 100)).alias("key"), x["value"].alias("value")))
    own = F.when(F.col("parent_name") == "w:pPr", _entries(in_paragraph)).when(F.col("parent_name") == "w:rPr", F.when(F.col("name") == "w:rFonts", faces).otherwise(_entries(in_run)))
    direct = nodes.filter("parent_name in ('w:pPr', 'w:rPr', 'w:tblPr') and attrs is not null")
    style = F.when(F.col("name").isin("w:pStyle", "w:rStyle", "w:tblStyle"), val)
    direct = direct.select(*K, F.col("parent").alias("owner"), "pos", F.col("name"), own.alias("own"), style.alias("style"))
    # Numbering and tabs are a level further down: their owner is the parent of their parent.
    deep = nodes.filter("parent_name in ('w:numPr', 'w:tabs')").select(*K, F.col("parent").alias("_up"), "pos", F.col("name"), val.alias("val"), F.concat_ws(",", *[F.coalesce(attr(a), F.lit("")) for a in ("val", "pos", "leader")]).alias("tab"))
    middle = nodes.filter("name in ('w:numPr', 'w:tabs') and parent_name = 'w:pPr'").select(*K, F.col("pos").alias("_up"), F.col("parent").alias("owner"), F.col("name").alias("_kind"))
    both = middle.join(deep, [*K, "_up"], "left").groupBy(*K, "owner", "_up", "_kind").agg(
        F.array_join(_by_place("tab", F.col("name") == "w:tab"), ";").alias("tabs"), *[F.min_by(F.when(F.col("name") == f"w:{n}", F.col("val")), F.when(F.col("name") == f"w:{n}", F.col("pos"))).alias(n) for n in ("ilvl", "numId")]
    )
    tabs = F.when(F.col("_kind") == "w:tabs", F.col("tabs"))
    both = both.select(*K, "owner", F.col("_up").alias("pos"), F.col("_kind").alias("name"), _entries([("ilvl", F.col("ilvl")), ("numId", F.col("numId")), ("tabs", tabs)]).alias("own"), F.lit(None).cast("string").alias("style"))
    rows = direct.unionByName(both)
    pairs = rows.select(*K, "owner", "pos", F.explode("own").alias("x")).select(*K, "owner", F.struct("pos", "x.key", "x.value").alias("e")).groupBy(*K, "owner").agg(_map().alias("props"))
    flags = rows.groupBy(*K, "owner").agg(F.min_by("style", F.when(F.col("style").isNotNull(), F.col("pos"))).alias("style"), F.bool_or(F.col("name") == "w:vanish").alias("vanish"), F.bool_or(F.col("name") == "w:sectPr").alias("sect"))
    none = F.create_map().cast("map<string,string>")
    return flags.join(pairs, [*K, "owner"], "left").withColumn("props", F.coalesce("props", none))


def owned(nodes: DataFrame, props: DataFrame, name: str, parent: str, prefix: str) -> DataFrame:
    """(K, of, <prefix>props, ...): the properties of the first ``name`` right below each ``parent``, which is at ``of``."""
    first = nodes.filter((F.col("name") == name) & (F.col("parent_name") == parent)).groupBy(*K, F.col("parent").alias("of")).agg(F.min("pos").alias("owner"))
    none = F.create_map().cast("map<string,string>")
    return first.join(props, [*K, "owner"], "left").select(*K, "of", F.coalesce("props", none).alias(f"{prefix}props"), F.col("style").alias(f"{prefix}style"), F.coalesce("vanish", F.lit(False)).alias(f"{prefix}vanish"), F.coalesce("sect", F.lit(False)).alias(f"{prefix}sect"))


def _events(nodes: DataFrame, name: str, points: DataFrame) -> DataFrame:
    """Begins and ends of the elements ``name`` among ``points`` (K, at, ...)."""
    marks = nodes.filter((F.col("name") == name) & (F.col("end") > F.col("pos"))).select(*K, F.inline(F.array(F.struct(F.col("pos").alias("at"), F.lit(1).alias("_step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("_step")))))
    return points.withColumn("_step", F.lit(0)).unionByName(marks, allowMissingColumns=True)


def inside(nodes: DataFrame, name: str, points: DataFrame) -> DataFrame:
    """``points`` (K, at, ...) once for each element ``name`` around them, with its place ``begin`` and ``level`` (1: the outermost)."""
    rows = _events(nodes, name, points)
    return N.contents(rows, K, "at", F.col("_step") == 1, F.col("_step") == -1, every_level=True).drop("_step")


#: What holds other nodes, by name: paragraphs, runs and tables have rows of their own in ``held``.
_HOLDERS = {"w:p": 1, "w:r": 2, "w:tbl": 3}
_RUN_TYPE = "struct<idx:int,text:string,style_id:string,direct_child:boolean,no_colour:boolean,rpr:map<string,string>>"


def held(nodes: DataFrame, kinds: Sequence[str] = tuple(_HOLDERS)) -> DataFrame:
    """One row for each paragraph, run and table (K, kind, begin, end, parent, number) with what lies in it and around it: ``text``, ``break_types``,
    ``instructions``, ``has_omml``, ``has_picture`` and ``has_anchor`` at any depth; ``owner``, the place of the first properties right below it; ``marked``: it has
    marks of fields right below it; ``at_runs``, the places of a paragraph's runs; ``cells``, those of the paragraphs that have the table as their
    innermost; ``in_table``, ``in_sdt``, ``in_revision``, ``covered``: what is around it. ``number``: it is the how manieth of its part.

    Two windows do it: depths are running sums over places, and of what lies at one depth in elements of one kind, the last that began holds it."""
    name, parent = F.col("name"), F.col("parent_name")
    kind = F.coalesce(*[F.when(name == n, k) for n, k in _HOLDERS.items() if n in kinds])
    spoken = F.coalesce(F.col("first") & parent.isin("w:t", "w:delText"), F.lit(False))
    told = {
        "said": F.when(F.col("first") & parent.isin(*_SAYING), F.col("text")).when(name == "w:tab", "\t").when(name == "w:br", "\n"), "broken": F.when((name == "w:br") & attr("type").isin("page", "column"), attr("type")),
        "simple": F.when(name == "w:fldSimple", F.coalesce(attr("instr"), F.lit(""))), "code": F.when(F.col("first") & (parent == "w:instrText"), F.col("text")),
    }
    flags = {"omml": name.isin("m:oMath", "m:oMathPara"), "picture": name.isin("w:drawing", "w:pict"), "anchor": name == "wp:anchor"}
    yes = lambda c: F.coalesce(c, F.lit(False))
    below = lambda n, up: yes((name == n) & (parent == up))
    marks = yes(name.isin("w:fldChar", "w:instrText") & (parent == "w:r"))
    points = {
        1: yes(reduce(Column.__or__, [*[c.isNotNull() for c in told.values()], *flags.values()])) | below("w:pPr", "w:p") | ((name == "w:r") if "w:r" in kinds else F.lit(False)),
        2: spoken | below("w:rPr", "w:r") | marks, 3: (name == "w:p") | below("w:tblPr", "w:tbl"),
    }
    points = {k: points[k] for n, k in _HOLDERS.items() if n in kinds}
    groups = {"in_table": ("w:tc",), "in_sdt": ("w:sdt",), "in_revision": ("w:ins", "w:del"), "covered": _COVERING} if "w:r" in kinds else {}
    opening = yes(name.isin(*kinds, *[n for group in groups.values() for n in group]) & (F.col("end") > F.col("pos")))
    step = lambda at, n: F.struct(F.col(at).alias("at"), F.lit(n).alias("_step"))
    rows = nodes.select(
        *K, "pos", "end", "parent", kind.alias("_kind"), *[c.alias(k) for k, c in told.items()], *[yes(c).alias(k) for k, c in flags.items()], marks.alias("_marks"), below("w:pPr", "w:p").alias("_ppr"),
        (below("w:rPr", "w:r") | below("w:tblPr", "w:tbl")).alias("_pr"), (name == "w:r").alias("_run"), opening.alias("_opening"), *[c.alias(f"_in{k}") for k, c in points.items()], *[name.isin(*g).alias(f"_{k}") for k, g in groups.items()],
    ).filter(reduce(Column.__or__, [F.col(f"_in{k}") for k in points], F.col("_kind").isNotNull() | F.col("_opening")))
    rows = rows.withColumn("_e", F.explode(F.when(F.col("_opening"), F.array(step("pos", 1), step("end", -1))).otherwise(F.array(step("pos", 0))))).select("*", "_e.*").drop("_e", "pos", "_opening")
    so_far = W.partitionBy(*K).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    sums = {f"_depth{k}": F.sum(F.when(F.col("_kind") == k, F.col("_step")).otherwise(0)).over(so_far).cast("int") for k in points}
    sums |= {f"_number{k}": F.count_if((F.col("_kind") == k) & (F.col("_step") >= 0)).over(so_far).cast("int") for k in points}
    sums |= {f"_around_{k}": F.sum(F.when(F.col(f"_{k}"), F.col("_step")).otherwise(0)).over(so_far) for k in groups}
    rows = rows.withColumns(sums).filter("_step >= 0")
    # A slot is four times a depth plus a kind; tables take only those that lie right in them.
    none = F.array().cast("array<int>")
    own = [F.when(F.col("_kind") == k, F.array(4 * (F.col(f"_depth{k}") + F.when(F.col("_step") > 0, 0).otherwise(1)) + k)) for k in points]
    slots = [F.coalesce(*own, none)]
    for k in points:
        depth = F.col(f"_depth{k}")
        slots.append(F.when(F.col(f"_in{k}") & (depth > 0), F.array(4 * depth + k) if k == 3 else F.sequence(F.lit(4 + k), 4 * depth + k, F.lit(4))).otherwise(none))
    rows = rows.withColumn("_slot", F.explode(F.concat(*slots))).withColumn("kind", F.col("_slot") % 4)
    opens = yes(F.col("_kind") == F.col("kind"))
    rows = rows.withColumn("_opens", opens).withColumn("begin", F.last(F.when(opens, F.col("at")), ignorenulls=True).over(W.partitionBy(*K, "_slot").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c))))[c]
    number = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"_number{k}")) for k in points])
    right = F.col("parent") == F.col("begin")
    places = lambda where: F.sort_array(F.collect_list(F.when(where, F.col("at"))))
    return rows.groupBy(*K, "kind", "begin").agg(
        F.max(F.when(F.col("_opens"), F.col("end"))).alias("end"), F.max(F.when(F.col("_opens"), F.col("parent"))).alias("parent"), F.max(F.when(F.col("_opens"), number)).alias("number"),
        F.array_join(listed("said"), "").alias("text"), listed("broken").alias("break_types"), F.concat(listed("simple"), listed("code")).alias("instructions"), *[F.bool_or(k).alias(f"has_{k}") for k in flags],
        F.min(F.when((F.col("_ppr") | F.col("_pr")) & right, F.col("at"))).alias("owner"), F.bool_or(F.col("_marks") & right).alias("marked"), places((F.col("kind") == 1) & F.col("_run")).alias("at_runs"),
        places((F.col("kind") == 3) & (F.col("_kind") == 1)).alias("cells"), *[F.bool_or(F.col("_opens") & (F.col(f"_around_{k}") > 0)).alias(k) for k in groups],
    )


def _runs(whole: DataFrame, props: DataFrame) -> DataFrame:
    """(K, begin, o, run): the runs of the paragraphs that begin at ``begin``, of all that ``held`` finds."""
    rows = whole.filter("kind = 1").select(*K, "begin", F.posexplode("at_runs").alias("o", "at"))
    told = whole.filter("kind = 2").select(*K, F.col("begin").alias("at"), "text", "parent", "marked", "covered", "owner").join(props.select(*K, "owner", "style", "vanish", "props"), [*K, "owner"], "left")
    rows = rows.join(told, [*K, "at"])
    hidden = F.col("covered") | F.col("marked") | F.coalesce("vanish", F.lit(False))
    run = F.struct(F.col("o").alias("idx"), "text", F.col("style").alias("style_id"), (F.col("parent") == F.col("begin")).alias("direct_child"), hidden.alias("no_colour"), F.coalesce("props", F.create_map().cast("map<string,string>")).alias("rpr"))
    return rows.select(*K, "begin", "o", run.alias("run"))


def _found(n: Nodes) -> tuple[DataFrame, DataFrame]:
    """What ``held`` and ``properties`` say of the stories, written."""
    props = bucketed(properties(n.told).repartition(n.buckets, "doc_id"), n.folder, "properties", n.buckets, ["doc_id"])
    return bucketed(held(n.told), n.folder, "held", n.buckets, ["doc_id"]), props


def paragraphs(n: Nodes) -> DataFrame:
    """(doc_id, story, begin, parent, part_name, and the columns of the documents' paragraphs) of all stories."""
    whole, props = _found(n)
    runs = _runs(whole, props).groupBy(*K, "begin").agg(F.collect_list(F.struct("o", "run")).alias("runs"))
    runs = runs.select(*K, "begin", F.transform(F.array_sort("runs", lambda a, b: a["o"] - b["o"]), lambda x: x["run"]).alias("runs"))
    return _paragraphs(n, whole, props).join(runs, [*K, "begin"], "left").withColumn("runs", F.coalesce("runs", F.array().cast(f"array<{_RUN_TYPE}>"))).select(
        "doc_id", "story", "begin", "parent", "part_name", *_TOLD, "runs"
    )


_TOLD = "idx text style_id section_index in_table in_sdt in_revision table_idx table_style break_types has_omml has_picture has_anchor instructions ppr".split()


def _paragraphs(n: Nodes, whole: DataFrame, props: DataFrame) -> DataFrame:
    """``paragraphs`` without their runs."""
    tables = whole.filter("kind = 3").select(*K, "owner", (F.col("number") - 1).alias("table_idx"), "cells").join(props.select(*K, "owner", F.col("style").alias("table_style")), [*K, "owner"], "left")
    within = tables.select(*K, "table_idx", "table_style", F.explode("cells").alias("begin"))
    rows = whole.filter("kind = 1").join(props.select(*K, "owner", "style", "sect", "props"), [*K, "owner"], "left").join(within, [*K, "begin"], "left").join(n.stories, K)
    ended = F.sum(F.when(F.coalesce("sect", F.lit(False)), 1).otherwise(0)).over(W.partitionBy(*K).orderBy("begin").rowsBetween(W.unboundedPreceding, -1))
    section = F.when(F.col("part_name") == MAIN, F.coalesce(ended, F.lit(0)).cast("int"))
    return rows.select(
        "doc_id", "story", "begin", "parent", "part_name", (F.col("number") - 1).alias("idx"), "text", F.col("style").alias("style_id"), section.alias("section_index"), "in_table", "in_sdt", "in_revision", "table_idx", "table_style", "break_types",
        "has_omml", "has_picture", "has_anchor", "instructions", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("ppr"),
    )


def run_rows(n: Nodes) -> tuple[DataFrame, DataFrame]:
    """The columns of ``docx.runs`` and ``docx.paragraphs`` without ``runs`` in those: no run takes the way through its paragraph's list."""
    whole, props = _found(n)
    kept = bucketed(_paragraphs(n, whole, props), n.folder, "paragraphs", n.buckets, ["doc_id"])
    runs = _runs(whole, props).join(kept.select(*K, "begin", F.col("idx").alias("p_idx")), [*K, "begin"])
    return runs.select("doc_id", "part_name", "p_idx", "run.*"), kept.drop("story", "begin", "parent")


def paragraph_rows(n: Nodes) -> tuple[DataFrame, DataFrame]:
    """``docx.runs`` and ``docx.paragraphs`` of the documents, without the way through one row a document; they stay dealt by document."""
    kept = bucketed(paragraphs(n), n.folder, "paragraphs", n.buckets, ["doc_id"])
    runs = kept.select("doc_id", "part_name", F.col("idx").alias("p_idx"), F.explode("runs").alias("r"))
    return runs.select("doc_id", "part_name", "p_idx", "r.*"), kept.drop("story", "begin", "parent")


def tables(n: Nodes, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, tables) of the main parts."""
    nodes = n.told.filter(F.col("part_name") == MAIN)
    own = nodes.filter("name = 'w:tbl'").select(*K, F.col("pos").alias("t"), "parent", (F.row_number().over(W.partitionBy(*K).orderBy("pos")) - 1).alias("table_idx"))
    lines = nodes.filter("name = 'w:tr' and parent_name = 'w:tbl'").groupBy(*K, F.col("parent").alias("t")).agg(F.count(F.lit(1)).cast("int").alias("rows"), F.min("pos").alias("tr"))
    under = lambda name, parent: nodes.filter((F.col("name") == name) & (F.col("parent_name") == parent)).select(*K, F.col("pos").alias("_p"), F.col("parent").alias("_up"))
    repeat = under("w:tblHeader", "w:trPr").select(*K, F.col("_up").alias("_p")).join(under("w:trPr", "w:tr").select(*K, "_p", F.col("_up").alias("tr")), [*K, "_p"]).select(*K, "tr").distinct().withColumn("repeat_header", F.lit(True))
    drawn = ~F.coalesce(attr("val").isin("nil", "none"), F.lit(False))
    edges = nodes.filter("parent_name in ('w:tblBorders', 'w:tcBorders') and attrs is not null").select(*K, F.col("parent").alias("_p"), "pos", F.substring(F.col("name"), 3, 100).alias("edge"), drawn.alias("drawn"), F.col("parent_name").alias("kind"))
    of_table = under("w:tblBorders", "w:tblPr").join(under("w:tblPr", "w:tbl").select(*K, F.col("_p").alias("_up"), F.col("_up").alias("t")), [*K, "_up"]).select(*K, "_p", "t")
    cells = nodes.filter("name = 'w:tcBorders'").select(*K, F.col("pos").alias("at"))
    of_cells = inside(nodes, "w:tbl", cells).select(*K, F.col("at").alias("_p"), F.col("begin").alias("t"))
    borders = edges.join(of_table.unionByName(of_cells), [*K, "_p"]).groupBy(*K, "t", "edge").agg(F.max(F.when(F.col("drawn"), "1").otherwise("0")).alias("v"))
    borders = borders.groupBy(*K, "t").agg(F.map_from_entries(F.collect_list(F.struct("edge", "v"))).alias("borders"))
    # The cells of first rows: their texts, and their bottom borders.
    heads = nodes.filter("name = 'w:tc' and parent_name = 'w:tr'").select(*K, F.col("pos").alias("tc"), F.col("parent").alias("tr")).join(lines.select(*K, "tr", "t"), [*K, "tr"])
    says = nodes.filter("first and parent_name = 'w:t'").select(*K, F.col("pos").alias("at"), "text")
    texts = inside(nodes, "w:tc", says).groupBy(*K, F.col("begin").alias("tc")).agg(F.array_join(_by_place("text", place="at"), "").alias("text"))
    bottoms = under("w:tcBorders", "w:tcPr").join(under("w:tcPr", "w:tc").select(*K, F.col("_p").alias("_up"), F.col("_up").alias("tc")), [*K, "_up"])
    bottoms = edges.filter("edge = 'bottom' and kind = 'w:tcBorders'").join(bottoms.select(*K, "_p", "tc"), [*K, "_p"]).groupBy(*K, "tc").agg(F.bool_or("drawn").alias("bottom"))
    stripped = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    heads = heads.join(texts, [*K, "tc"], "left").join(bottoms, [*K, "tc"], "left").groupBy(*K, "t").agg(F.bool_or(F.coalesce("bottom", F.lit(False))).alias("header_bottom"), _by_place(stripped, place="tc").alias("header_cells"))
    # The paragraphs before and after a table among what lies in the same element.
    main = paragraphs.filter(F.col("part_name") == MAIN)
    beside = own.select(*K, F.col("t").alias("pos"), "parent", F.lit(None).cast("int").alias("idx")).unionByName(main.select(*K, F.col("begin").alias("pos"), "parent", "idx"))
    order = W.partitionBy(*K, "parent").orderBy("pos")
    beside = beside.withColumns({"before_idx": F.lag("idx").over(order), "after_idx": F.lead("idx").over(order)}).filter("idx is null").select(*K, F.col("pos").alias("t"), "before_idx", "after_idx")
    held = inside(nodes, "w:tbl", main.select(*K, F.col("begin").alias("at"), "idx")).groupBy(*K, F.col("begin").alias("t")).agg(F.array_sort(F.collect_list("idx")).alias("cells"))
    rows = own
    for more in (lines, borders, heads, beside, held):
        rows = rows.join(more, [*K, "t"], "left")
    rows = rows.join(repeat, [*K, "tr"], "left")
    no = F.array().cast("array<string>")
    one = F.struct(
        F.col("table_idx").cast("int").alias("table_idx"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("repeat_header", F.lit(False)).alias("repeat_header"), F.coalesce("borders", F.create_map().cast("map<string,string>")).alias("borders"),
        F.coalesce("header_bottom", F.lit(False)).alias("header_bottom"), "before_idx", "after_idx", F.coalesce("cells", F.array().cast("array<int>")).alias("cells"), F.coalesce("header_cells", no).alias("header_cells"),
    )
    return rows.groupBy("doc_id").agg(_by_place(one, place="t").alias("tables"))


def sections(n: Nodes) -> DataFrame:
    """(doc_id, sections) of the main parts."""
    nodes = n.told.filter(F.col("part_name") == MAIN)
    own = nodes.filter("name = 'w:sectPr'").select("doc_id", F.col("pos").alias("s"), (F.row_number().over(W.partitionBy("doc_id").orderBy("pos")) - 1).cast("int").alias("section_index"))
    kids = nodes.filter("parent_name = 'w:sectPr' and attrs is not null")
    first = lambda name, value: F.min_by(F.when(F.col("name") == f"w:{name}", value), F.when(F.col("name") == f"w:{name}", F.col("pos")))
    whole = lambda name, a, other=None: F.coalesce(first(name, _whole(attr(a))), F.lit(other).cast("int"))
    has = lambda name: F.bool_or(F.col("name") == f"w:{name}")
    page = kids.groupBy("doc_id", F.col("parent").alias("s")).agg(
        whole("pgSz", "w").alias("width"), whole("pgSz", "h").alias("height"), F.when(has("pgSz"), F.coalesce(F.nullif(first("pgSz", attr("orient")), F.lit("")), F.lit("portrait"))).alias("orientation"),
        *[whole("pgMar", a).alias(a) for a in ("top", "right", "bottom", "left")], whole("pgMar", "gutter", 0).alias("gutter"), whole("pgMar", "header").alias("header"), whole("pgMar", "footer").alias("footer"),
        F.coalesce(F.nullif(first("type", attr("val")), F.lit("")), F.lit("nextPage")).alias("start"), has("titlePg").alias("title_page"), first("pgNumType", attr("fmt")).alias("number_format"), whole("pgNumType", "start").alias("number_start"),
    )
    refs = kids.filter("name in ('w:headerReference', 'w:footerReference')").select("doc_id", F.col("parent").alias("s"), "pos", "name", F.coalesce(F.nullif(attr("type"), F.lit("")), F.lit("default")).alias("key"), attr("r:id").alias("rel_id"))
    targets = n.rels.filter((F.col("source_part") == MAIN) & (F.col("target_part") != "")).select("doc_id", "rel_id", F.col("target_part").alias("value"))
    refs = refs.join(targets, ["doc_id", "rel_id"])
    last = lambda kind: F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == f"w:{kind}Reference", F.struct("pos", "key", "value")))), lambda x: F.struct(x["key"], x["value"])))
    refs = refs.groupBy("doc_id", "s").agg(last("header").alias("headers"), last("footer").alias("footers"))
    none = F.create_map().cast("map<string,string>")
    rows = own.join(page, ["doc_id", "s"], "left").join(refs, ["doc_id", "s"], "left")
    filled = {"gutter": F.lit(0), "start": F.lit("nextPage"), "title_page": F.lit(False), "headers": none, "footers": none}
    names = "section_index width height orientation top right bottom left gutter header footer start title_page number_format number_start headers footers".split()
    one = F.struct(*[F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in names])
    return rows.groupBy("doc_id").agg(_by_place(one, place="s").alias("sections"))


def styles(n: Nodes) -> DataFrame:
    """(doc_id, styles, default_ppr, default_rpr)."""
    nodes = staged(n.of(n.special("styles", "word/styles.xml")), n.folder, "style-nodes")
    props = staged(properties(nodes), n.folder, "style-properties")
    val = attr("val")
    own = nodes.filter("name = 'w:style' and level = 2").select(*K, F.col("pos").alias("s"), attr("type").alias("type"), attr("styleId").alias("style_id"), F.coalesce(attr("default").isin("1", "true", "on"), F.lit(False)).alias("is_default")).filter("type <> '' and style_id <> ''")
    first = lambda name: F.min_by(F.when(F.col("name") == name, val), F.when(F.col("name") == name, F.col("pos")))
    told = nodes.filter("parent_name = 'w:style' and name in ('w:name', 'w:basedOn')").groupBy(*K, F.col("parent").alias("s")).agg(first("w:name").alias("name"), first("w:basedOn").alias("based_on"))
    whole = nodes.filter("name = 'w:tblStylePr' and parent_name = 'w:style'").filter(attr("type") == "wholeTable").groupBy(*K, F.col("parent").alias("s")).agg(F.min("pos").alias("w"))
    rows = own.join(told, [*K, "s"], "left").join(whole, [*K, "s"], "left")
    for kind in ("p", "r"):
        rows = rows.join(owned(nodes, props, f"w:{kind}Pr", "w:style", "").select(*K, F.col("of").alias("s"), F.col("props").alias(f"{kind}pr")), [*K, "s"], "left")
        rows = rows.join(owned(nodes, props, f"w:{kind}Pr", "w:tblStylePr", "").select(*K, F.col("of").alias("w"), F.col("props").alias(f"whole_{kind}pr")), [*K, "w"], "left")
    none = F.create_map().cast("map<string,string>")
    maps = {f"{w}{k}pr": F.coalesce(f"{w}{k}pr", none) for w in ("", "whole_") for k in ("p", "r")}
    one = F.struct("type", "style_id", "name", "based_on", "is_default", *[v.alias(k) for k, v in maps.items()])
    last = F.row_number().over(W.partitionBy("doc_id", "type", "style_id").orderBy(F.desc("s")))
    listed = rows.select("doc_id", "s", one.alias("one"), last.alias("_last")).filter("_last = 1").groupBy("doc_id").agg(_by_place("one", place="s").alias("styles"))
    defaults = nodes.select("doc_id").distinct()
    for kind in ("p", "r"):
        # docDefaults/pPrDefault/pPr
        own = owned(nodes, props, f"w:{kind}Pr", f"w:{kind}PrDefault", "").groupBy("doc_id").agg(F.min_by("props", "of").alias(f"default_{kind}pr"))
        defaults = defaults.join(own, "doc_id", "left")
    return defaults.join(listed, "doc_id", "left")


def theme(n: Nodes) -> DataFrame:
    """(doc_id, theme)."""
    nodes = n.of(n.special("theme", "word/theme/theme1.xml"))
    schemes = nodes.filter("name in ('a:fontScheme', 'a:clrScheme')").groupBy(*K, "name").agg(F.min("pos").alias("_up")).select(*K, "_up", F.col("name").alias("_in"))
    kids = nodes.filter("attrs is not null").withColumnRenamed("parent", "_up").join(schemes, [*K, "_up"])
    face = attr("@typeface")
    groups = kids.filter("name in ('a:majorFont', 'a:minorFont')").groupBy(*K, "name").agg(F.min("pos").alias("_up")).select(*K, "_up", F.regexp_extract("name", "^a:(major|minor)Font$", 1).alias("kind"))
    faces = nodes.filter("parent_name in ('a:majorFont', 'a:minorFont')").withColumnRenamed("parent", "_up").join(groups, [*K, "_up"])
    one = lambda name, where=None: F.min_by(F.when((F.col("name") == name) & (F.lit(True) if where is None else where), F.coalesce(face, F.lit(""))), F.when((F.col("name") == name) & (F.lit(True) if where is None else where), F.col("pos")))
    faces = faces.groupBy(*K, "kind").agg(one("a:latin").alias("latin"), one("a:ea").alias("ea"), one("a:cs").alias("cs"), one("a:font", attr("@script") == "Hans").alias("hans"))
    full = lambda c: F.nullif(c, F.lit(""))
    faces = faces.select("doc_id", F.inline(F.array(*[F.struct(F.concat("kind", F.lit(f".{k}")).alias("key"), v.alias("value")) for k, v in (("latin", full(F.col("latin"))), ("eastAsia", F.coalesce(full(F.col("ea")), full(F.col("hans")))), ("cs", full(F.col("cs"))))]))).filter("value is not null")
    colours = kids.filter("_in = 'a:clrScheme'").select(*K, F.col("pos").alias("_p"), F.concat(F.lit("color."), F.substring(F.col("name"), 3, 100)).alias("key"))
    values = nodes.filter("name in ('a:srgbClr', 'a:sysClr')").select(*K, F.col("parent").alias("_p"), F.when(F.col("name") == "a:srgbClr", full(attr("@val"))).alias("rgb"), F.when(F.col("name") == "a:sysClr", F.coalesce(full(attr("@lastClr")), full(attr("@val")))).alias("system"), "pos")
    values = values.groupBy(*K, "_p").agg(F.min_by("rgb", F.when(F.col("rgb").isNotNull(), F.col("pos"))).alias("rgb"), F.min_by("system", F.when(F.col("system").isNotNull(), F.col("pos"))).alias("system"))
    colours = colours.join(values, [*K, "_p"]).select("doc_id", "key", F.upper(F.coalesce("rgb", "system")).alias("value")).filter("value is not null")
    return faces.unionByName(colours).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("theme"))


def settings(n: Nodes) -> DataFrame:
    """(doc_id, settings)."""
    nodes = n.nodes.filter("part_name = 'word/settings.xml' and attrs is not null")
    top = F.col("level") == 2
    has = lambda name: F.bool_or(top & (F.col("name") == f"w:{name}")).cast("int").cast("string")
    first = lambda name, value, where=None: F.min_by(F.when((F.col("name") == f"w:{name}") & (top if where is None else where), value), F.when((F.col("name") == f"w:{name}") & (top if where is None else where), F.col("pos")))
    mode = (F.col("name") == "w:compatSetting") & (attr("name") == "compatibilityMode")
    rows = nodes.groupBy("doc_id").agg(
        has("evenAndOddHeaders").alias("even_and_odd_headers"), has("trackRevisions").alias("track_revisions"), has("mirrorMargins").alias("mirror_margins"), F.coalesce(first("updateFields", _on(attr("val"))), F.lit("0")).alias("update_fields_on_open"),
        first("defaultTabStop", _whole(attr("val"))).cast("string").alias("default_tab_stop"), F.max_by(F.when(mode, attr("val")), F.when(mode, F.col("pos"))).alias("compatibility_mode"),
        F.nullif(first("numRestart", attr("val"), F.col("parent_name") == "w:footnotePr"), F.lit("")).alias("footnote_restart"),
    )
    return rows.select("doc_id", F.map_from_entries(_entries([(c, F.col(c)) for c in rows.columns[1:]])).alias("settings"))


def numbering(n: Nodes) -> DataFrame:
    """(doc_id, numbering, abstract_numbering, numbering_instances)."""
    nodes = n.nodes.filter("part_name = 'word/numbering.xml' and attrs is not null")
    first = lambda name, value: F.min_by(F.when(F.col("name") == f"w:{name}", value), F.when(F.col("name") == f"w:{name}", F.col("pos")))
    told = nodes.filter("parent_name = 'w:lvl'").groupBy("doc_id", F.col("parent").alias("l")).agg(first("numFmt", attr("val")).alias("format"), first("lvlText", attr("val")).alias("text"), first("start", _whole(attr("val"))).alias("start"))
    kinds = nodes.filter("name = 'w:abstractNum' and level = 2").select("doc_id", F.col("pos").alias("a"), _whole(attr("abstractNumId")).alias("abstract_id"))
    levels = nodes.filter("name = 'w:lvl' and parent_name = 'w:abstractNum'").select("doc_id", F.col("pos").alias("l"), F.col("parent").alias("a"), _whole(attr("ilvl")).alias("level"))
    rows = levels.join(kinds, ["doc_id", "a"]).join(told, ["doc_id", "l"], "left").groupBy("doc_id").agg(_by_place(F.struct("abstract_id", "level", "format", "text", "start"), place="l").alias("numbering"))
    counts = nodes.groupBy("doc_id").agg(F.count_if((F.col("name") == "w:abstractNum") & (F.col("level") == 2)).alias("abstract_numbering"), F.count_if((F.col("name") == "w:num") & (F.col("level") == 2)).alias("numbering_instances"))
    return counts.join(rows, "doc_id", "left")


def field_marks(nodes: DataFrame) -> DataFrame:
    """(K, pos, mark, code): where fields begin and end, and what they say; mark ``whole``: a field of one element."""
    kind, name = attr("fldCharType"), F.col("name")
    mark = F.when((name == "w:fldChar") & kind.isin("begin", "end"), kind).when(F.col("first") & F.col("parent_name").isin("w:instrText", "w:delInstrText"), "code").when(name == "w:fldSimple", "whole")
    return nodes.select(*K, "pos", mark.alias("mark"), F.when(name == "w:fldSimple", F.coalesce(attr("instr"), F.lit(""))).otherwise(F.col("text")).alias("code")).filter("mark is not null")


def commands(marks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at, command): the first word of every field that is closed, in upper case; ``at``: where it ends. A field's code is what is
    said right in it, not what the fields in it say."""
    codes = N.pieces_joined(marks.filter("mark <> 'whole'"), keys, "pos", F.col("mark") == "begin", F.col("mark") == "end", "code").select(*keys, F.col("end").alias("at"), F.col("joined").alias("code"))
    rows = codes.unionByName(marks.filter("mark = 'whole'").select(*keys, F.col("pos").alias("at"), "code"))
    word = F.regexp_extract("code", r"(?U)^\s*(\S+)", 1)
    return rows.select(*keys, "at", F.upper(word).alias("command")).filter("command <> ''")


def counts(n: Nodes, paragraphs: DataFrame) -> DataFrame:
    """(doc_id, counts, red_rules, bookmarks)."""
    nodes, name, main = n.told, F.col("name"), F.col("part_name") == MAIN
    # The names of the counts.
    counted = {
        "content_controls": ("w:sdt",), "tracked_insertions": ("w:ins",), "tracked_deletions": ("w:del",), "drawings_inline": ("wp:inline",), "drawings_anchor": ("wp:anchor",), "vml_shapes": ("v:shape",),
        "omml_objects": ("m:oMath", "m:oMathPara"), "bookmarks": ("w:bookmarkStart",), "hyperlinks": ("w:hyperlink",), "ole_objects": ("o:OLEObject",), "text_boxes": ("w:txbxContent",),
        "smartart_relationship_markers": ("dgm:relIds",), "moves": ("w:moveFrom", "w:moveTo"), "comment_ranges": ("w:commentRangeStart",),
    }
    in_main = {
        "main_shapes": ("wp:anchor", "wp:inline", "w:pict", "v:shape", "w:txbxContent"), "main_revisions": ("w:ins", "w:del", "w:moveFrom", "w:moveTo"), "main_controls": ("w:sdt",),
        "main_comment_ranges": ("w:commentRangeStart",), "tables": ("w:tbl",), "sections": ("w:sectPr",),
    }
    said = F.when(F.col("first") & F.col("parent_name").isin("w:t", "w:delText"), F.col("text"))
    kind = F.when(name == "w:br", F.coalesce(F.nullif(attr("type"), F.lit("")), F.lit("textWrapping")))
    each = {k: F.count_if(name.isin(*v)) for k, v in counted.items()} | {k: F.count_if(main & name.isin(*v)) for k, v in in_main.items()}
    each |= {k: F.count_if(kind == v) for k, v in (("soft_line_breaks", "textWrapping"), ("manual_page_breaks", "page"), ("manual_column_breaks", "column"))}
    each |= {k: F.sum(F.coalesce(F.regexp_count(said, F.lit(v)), F.lit(0))) for k, v in (("nonbreaking_spaces", " "), ("fullwidth_spaces", "　"), ("consecutive_space_sequences", " {2,}"))}
    each["paragraph_section_breaks"] = F.count_distinct(F.when(main & (name == "w:sectPr") & (F.col("parent_name") == "w:pPr"), F.col("parent")))
    note = lambda k: (F.col("part_name") == f"word/{k}.xml") & (name == f"w:{k[:-1]}") & (F.lit(True) if k == "comments" else F.coalesce(_whole(attr("id")) > 0, F.lit(True)))
    each |= {k: F.count_if(note(k)) for k in _NOTES}
    rows = nodes.groupBy("doc_id").agg(*[v.cast("long").alias(k) for k, v in each.items()], _by_place(attr("name"), main & (name == "w:bookmarkStart") & (attr("name") != "")).alias("_marks"))
    hidden = nodes.filter("name = 'w:vanish' and parent_name = 'w:rPr'").select(*K, F.col("parent").alias("pos")).join(nodes.filter("name = 'w:rPr' and parent_name = 'w:r'").select(*K, "pos", F.col("parent").alias("r")), [*K, "pos"])
    hidden = hidden.groupBy("doc_id").agg(F.count_distinct("part_name", "r").alias("hidden_runs"))
    strip = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    of_paragraphs = paragraphs.groupBy("doc_id").agg(F.count_if(main).alias("paragraphs_body"), F.count(F.lit(1)).alias("paragraphs_all"), F.count_if(strip == "").alias("empty_paragraphs"))
    packed = n.names.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))
    numbers = numbering(n).select("doc_id", "abstract_numbering", "numbering_instances")
    stroke = F.regexp_replace(F.lower(F.trim(attr("@strokecolor"))), "^#+", "")
    reds = n.stories.select(*K).join(nodes.filter("name in ('v:line', 'v:shape')").filter(stroke.isin("ff0000", "red")).groupBy(*K).agg(F.count(F.lit(1)).cast("int").alias("n")), K, "left")
    reds = reds.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part_name", F.coalesce("n", F.lit(0))))).alias("red_rules"))
    names = [*each, "hidden_runs", "paragraphs_body", "paragraphs_all", "empty_paragraphs", "parts", "abstract_numbering", "numbering_instances"]
    for more in (hidden, of_paragraphs, packed, numbers, reds):
        rows = rows.join(more, "doc_id", "left")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k), F.lit(0)).cast("long").alias("value")) for k in names])
    return rows.select("doc_id", F.map_from_entries(pairs).alias("counts"), "red_rules", F.col("_marks").alias("bookmarks"))


def texts(n: Nodes) -> DataFrame:
    """(doc_id, part_name, idx, begin, end, text) of the paragraphs of all stories."""
    return held(n.told, ("w:p",)).select(*K, (F.col("number") - 1).alias("idx"), "begin", "end", "text")


def scan_parts(parts: DataFrame, folder: str | None = None) -> DataFrame:
    """The documents of ``parts``, one row a file; see ``docx.SCHEMA``. Files of equal bytes are scanned once."""
    return documents(Nodes(parts, folder or scratch(parts.sparkSession, "scan")))


def documents(n: Nodes, only: Sequence[str] | None = None) -> DataFrame:
    """The documents whose parts and nodes ``n`` has; see ``scan_parts``. ``only``: the columns that are wanted; the others are empty, and
    what they take isn't run."""
    folder = n.folder
    told = staged(paragraphs(n), folder, "paragraphs") if only is None or {"paragraphs", "tables", "counts"} & set(only) else None
    kept = [c.split(":")[0] for c in "part_name idx text style_id section_index in_table in_sdt in_revision table_idx table_style break_types has_omml has_picture has_anchor instructions ppr runs".split()]
    in_order = lambda rows, *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, F.struct(*rows).alias("x"))), lambda a, b: _compared(a, b, by)), lambda x: x["x"])
    files = n.files.groupBy("doc_id", "path").agg(F.max("size").alias("size"))
    sources = n.stories.withColumnRenamed("part_name", "source_part")
    told_rels = ["source_part", "rel_id", "type", "target", "target_part", "external"]
    per = lambda rows, name, column: rows.groupBy("doc_id").agg(column.alias(name))
    rows = files.join(n.errors(), "doc_id", "left")
    groups = {
        ("parts",): lambda: per(n.parts, "parts", F.array_sort(F.collect_list(F.struct("part_name", F.col("part_size").alias("size"), "sha256")))),
        ("rels",): lambda: per(n.rels.join(sources, ["doc_id", "source_part"]), "rels", in_order(told_rels, "story", "pos")),
        ("paragraphs",): lambda: per(told, "paragraphs", in_order(kept, "story", "idx")), ("sections",): lambda: sections(n), ("styles", "default_ppr", "default_rpr"): lambda: styles(n), ("theme",): lambda: theme(n),
        ("settings",): lambda: settings(n), ("numbering",): lambda: numbering(n).select("doc_id", "numbering"), ("tables",): lambda: tables(n, told), ("counts", "red_rules", "bookmarks"): lambda: counts(n, told),
        ("fields",): lambda: per(commands(field_marks(n.told), K).join(n.stories, K), "fields", in_order(["part_name", "command"], "story", "at")),
    }
    wanted = [(f"documents-{names[0]}", group) for names, group in groups.items() if only is None or set(names) & set(only)]
    for more in together(wanted, folder).values():
        rows = rows.join(more, "doc_id", "left")
    kinds = {f.name: f.dataType for f in _schema()}
    fixed = {"settings": F.create_map(*[F.lit(x) for k in ("even_and_odd_headers", "track_revisions", "update_fields_on_open", "mirror_margins") for x in (k, "0")])}
    out = []
    for name, kind in kinds.items():
        if name in ("doc_id", "path", "size", "error"):
            out.append(F.col(name))
            continue
        empty = F.create_map() if kind.typeName() == "map" else F.array()
        found = [F.col(name)] if name in rows.columns else []
        out.append(F.when(F.col("error").isNull(), F.coalesce(*found, fixed.get(name, empty.cast(kind)))).cast(kind).alias(name))
    return staged(rows.select(*out), folder, "documents")


def _compared(a: Column, b: Column, by: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for c in reversed(by):
        out = F.when(a[c] < b[c], -1).when(a[c] > b[c], 1).otherwise(out)
    return out


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA.replace("\n", " "))
