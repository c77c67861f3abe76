"""The scan of Word packages as queries on plain tables: every document becomes a package whose parts are expressions over its lines, and the
scan has to find in it what the SQL says of the lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scan
from ..sources.docx import MAIN
from ..storage import discard, scratch, staged
from . import formats, roles
from .queries import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_STYLES = f"""<w:styles xmlns:w="{_W}"><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="24"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:jc w:val="both"/></w:pPr></w:pPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="Normal"><w:name w:val="Normal"/><w:rPr><w:color w:val="112233"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Base"><w:name w:val="Base"/><w:basedOn w:val="Normal"/><w:pPr><w:jc w:val="center"/></w:pPr><w:rPr><w:b/><w:color w:themeColor="accent1" w:themeTint="80"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="Base"/><w:rPr><w:sz w:val="32"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="Quote"><w:name w:val="Quote"/><w:basedOn w:val="Base"/><w:rPr><w:b/><w:sz w:val="18"/></w:rPr></w:style></w:styles>"""
_THEME = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements><a:clrScheme><a:accent1><a:srgbClr val="336699"/></a:accent1></a:clrScheme></a:themeElements></a:theme>'
_RELS = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Type="{_OFFICE}/styles" Target="../word/./styles.xml"/><Relationship Id="b" Type="{_OFFICE}/theme" Target="/word/theme.xml"/></Relationships>'
#: What formats need of documents besides paragraphs.
_STYLED = ("styles", "default_ppr", "default_rpr", "theme")
#: Lines that stand for others, by place, so that documents have titles and parts.
_TITLES = {2: "Abstract", 4: "Key words: a; b", 6: "目录", 9: "1 Results", 12: "图 1-1 Scheme", 15: "致谢", 18: "参考文献", 19: "[1] A. Title", 21: "附录 A"}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def _paragraph(line: Column, i: Column) -> Column:
    """A line as a paragraph: two runs, between them a break, behind them a field in a field, around it a table."""
    tag = lambda name, text: F.concat(F.lit(f'<w:{name} xml:space="preserve">'), F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;")), F.lit(f"</w:{name}>"))
    when = lambda test, text: F.when(test, F.lit(text)).otherwise("")
    style = F.when(i % 7 == 0, '<w:pStyle w:val="H1"/>').when(i % 7 == 3, '<w:pStyle w:val="Quote"/>').otherwise("")
    ppr = F.concat(F.lit("<w:pPr>"), style, when(i % 13 == 12, "<w:sectPr/>"), F.lit("</w:pPr>"))
    bold = F.when(i % 6 == 0, '<w:b w:val="0"/>').when(i % 3 == 0, "<w:b/>").otherwise("")
    size = F.when(i % 4 == 1, F.concat(F.lit('<w:sz w:val="'), (20 + i % 5 * 2).cast("string"), F.lit('"/>'))).otherwise("")
    first = F.concat(F.lit("<w:r><w:rPr>"), bold, size, F.lit("</w:rPr>"), tag("t", F.substring(line, 1, 10)), F.lit("</w:r>"))
    second = F.concat(F.lit("<w:r>"), tag("t", F.substring(line, 11, 1 << 30)), F.lit("</w:r>"))
    linked = F.when(i % 5 == 4, F.concat(F.lit("<w:hyperlink>"), second, F.lit("</w:hyperlink>"))).otherwise(second)
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    code = lambda text: F.concat(F.lit("<w:r>"), tag("instrText", text), F.lit("</w:r>"))
    field = F.concat(F.lit(mark("begin")), code(F.concat(F.lit(" ref x"), i.cast("string"))), F.lit(mark("begin")), code(F.lit("PAGE ")), F.lit(mark("end") * 2))
    out = F.concat(F.lit("<w:p>"), ppr, first, when(i % 9 == 8, "<w:r><w:br/></w:r>"), linked, F.when(i % 6 == 5, field).otherwise(""), F.lit("</w:p>"))
    return F.when(i % 11 == 10, F.concat(F.lit("<w:tbl><w:tr><w:tc>"), out, F.lit("</w:tc></w:tr></w:tbl>"))).otherwise(out)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as the parts of packages (see ``sources.parts``)."""
    titled = lambda x, i: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in _TITLES.items() for v in pair]), i), x)
    lines = F.transform(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n"), titled)
    body = F.array_join(F.transform(lines, lambda x, i: _paragraph(x, i)), "")
    main = F.concat(F.lit(f'<?xml version="1.0"?><w:document xmlns:w="{_W}"><w:body>'), body, F.lit("<w:sectPr/></w:body></w:document>"))
    parts = {"[Content_Types].xml": F.lit("<Types/>"), MAIN: main, "word/styles.xml": F.lit(_STYLES), "word/theme.xml": F.lit(_THEME), "word/_rels/document.xml.rels": F.lit(_RELS)}
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("part_name"), F.encode(v, "UTF-8").alias("content")) for k, v in parts.items()]))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), listed.alias("p"))
    size = F.octet_length("p.content").cast("long")
    return rows.select(F.col("doc_id").alias("path"), "doc_id", F.lit(0).cast("long").alias("size"), "p.part_name", size.alias("part_size"), F.sha2("p.content", 256).alias("sha256"), "p.content", F.lit(None).cast("string").alias("error"))


def answered(spark: SparkSession, sf_dir: str, rows: Callable[[scan.Nodes], DataFrame]) -> DataFrame:
    """``rows`` of the packages' nodes, written; all other tables of the scan go."""
    folder = scratch(spark, "queries")
    out = staged(rows(scan.Nodes(packages(spark, sf_dir), f"{folder}/scan", contents=False)), folder, "answer")
    discard(spark, f"{folder}/scan")
    return out


_TITLED = "CASE i " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _TITLES.items()) + " ELSE x END"
_LINES = f"""l AS (
  SELECT doc_id, CAST(i AS INTEGER) AS i, {_TITLED} AS t FROM (
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS s FROM documents))
), p AS (
  SELECT *, substr(t, 1, 10) AS a, substr(t, 11) AS b, CASE WHEN i % 7 = 0 THEN 'H1' WHEN i % 7 = 3 THEN 'Quote' END AS style FROM l
)"""


@query(f"""WITH {_LINES} SELECT doc_id, i AS idx, a || CASE WHEN i % 9 = 8 THEN chr(10) ELSE '' END || b || CASE WHEN i % 6 = 5 THEN ' ref x' || i || 'PAGE ' ELSE '' END AS text, style AS style_id,
  CAST(count(*) FILTER (i % 13 = 12) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS section_index, i % 11 = 10 AS in_table,
  CASE WHEN i % 11 = 10 THEN CAST((i - 10) // 11 AS INTEGER) END AS table_idx, CAST(2 + CASE WHEN i % 9 = 8 THEN 1 ELSE 0 END + CASE WHEN i % 6 = 5 THEN 6 ELSE 0 END AS INTEGER) AS runs FROM p""")
def word_paragraphs(spark, sf_dir):
    return answered(spark, sf_dir, lambda n: scan.paragraphs(n).select("doc_id", "idx", "text", "style_id", "section_index", "in_table", "table_idx", F.size("runs").alias("runs")))


@query(f"""WITH {_LINES}, r AS (
  SELECT doc_id, i, 0 AS idx, a AS text, TRUE AS direct_child, FALSE AS no_colour, CASE WHEN i % 6 = 0 THEN '0' WHEN i % 3 = 0 THEN '1' END AS b, CASE WHEN i % 4 = 1 THEN CAST(20 + i % 5 * 2 AS VARCHAR) END AS sz FROM p
  UNION ALL SELECT doc_id, i, 1, '', TRUE, FALSE, NULL, NULL FROM p WHERE i % 9 = 8
  UNION ALL SELECT doc_id, i, CASE WHEN i % 9 = 8 THEN 2 ELSE 1 END, b, i % 5 <> 4, i % 5 = 4, NULL, NULL FROM p
  UNION ALL SELECT doc_id, i, CASE WHEN i % 9 = 8 THEN 3 ELSE 2 END + k, '', TRUE, TRUE, NULL, NULL FROM p, range(6) f(k) WHERE i % 6 = 5
) SELECT doc_id, i AS p_idx, CAST(idx AS INTEGER) AS idx, text, direct_child, no_colour, b, sz FROM r""")
def word_runs(spark, sf_dir):
    return answered(spark, sf_dir, lambda n: scan.run_rows(n)[0].select("doc_id", "p_idx", "idx", "text", "direct_child", "no_colour", *[F.try_element_at("rpr", F.lit(k)).alias(k) for k in ("b", "sz")]))


@query(f"WITH {_LINES} SELECT doc_id, command, count(*) AS n FROM (SELECT doc_id, unnest(['REF', 'PAGE']) AS command FROM p WHERE i % 6 = 5) GROUP BY ALL")
def word_fields(spark, sf_dir):
    return answered(spark, sf_dir, lambda n: scan.commands(scan.field_marks(n.told), scan.K).groupBy("doc_id", "command").agg(F.count(F.lit(1)).alias("n")))


_COUNTED = {
    "parts": "5", "paragraphs_body": "count(*)", "paragraphs_all": "count(*)", "tables": "count(*) FILTER (i % 11 = 10)", "sections": "1 + count(*) FILTER (i % 13 = 12)", "paragraph_section_breaks": "count(*) FILTER (i % 13 = 12)",
    "hyperlinks": "count(*) FILTER (i % 5 = 4)", "soft_line_breaks": "count(*) FILTER (i % 9 = 8)", "bookmarks": "0", "hidden_runs": "0", "comments": "0",
    "empty_paragraphs": "count(*) FILTER (regexp_matches(t, '^[\\s\\u00a0\\u3000]*$') AND i % 6 <> 5)", "nonbreaking_spaces": "sum(length(t) - length(replace(t, chr(160), '')))", "fullwidth_spaces": "sum(length(t) - length(replace(t, chr(12288), '')))",
    "consecutive_space_sequences": "sum(len(regexp_extract_all(a, ' {2,}')) + len(regexp_extract_all(b, ' {2,}')))",
}


@query(f"WITH {_LINES} " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, CAST({v.replace(chr(92) + 'u00a0', chr(160)).replace(chr(92) + 'u3000', chr(12288))} AS BIGINT) AS n FROM p GROUP BY doc_id" for k, v in _COUNTED.items()))
def word_counts(spark, sf_dir):
    rows = lambda n: scan.counts(n, scan.texts(n)).select("doc_id", F.explode("counts").alias("key", "n"))
    return answered(spark, sf_dir, lambda n: rows(n).filter(F.col("key").isin(*_COUNTED)))


# In styles a true flag inverts what is set, so Quote, bold on the bold Base, is not bold; direct formatting replaces.
@query(f"""WITH {_LINES}, r AS (
  SELECT doc_id, i, 0 AS half, a AS text, style FROM p UNION ALL SELECT doc_id, i, 1, b, style FROM p
) SELECT doc_id, i AS p_idx, text, CASE WHEN half = 0 AND i % 4 = 1 THEN (20 + i % 5 * 2) / 2.0 WHEN style = 'H1' THEN 16.0 WHEN style = 'Quote' THEN 9.0 ELSE 12.0 END::DOUBLE AS size_pt,
  CASE WHEN half = 0 AND i % 4 = 1 THEN 'direct-run' WHEN style IS NULL THEN 'document-defaults' ELSE 'paragraph-style:' || style END AS size_from,
  CASE WHEN half = 0 AND i % 6 = 0 THEN FALSE WHEN half = 0 AND i % 3 = 0 THEN TRUE WHEN style = 'H1' THEN TRUE WHEN style = 'Quote' THEN FALSE END AS bold,
  CASE WHEN style IS NULL THEN '112233' ELSE '99B3CC' END AS colour FROM r WHERE text <> ''""")
def word_formats(spark, sf_dir):
    def rows(n: scan.Nodes) -> DataFrame:
        runs, paragraphs = scan.run_rows(n)
        out = formats.run_formats(scan.documents(n, only=_STYLED), runs.filter("text <> ''"), paragraphs)
        return out.select("doc_id", "p_idx", "text", "size_pt", F.try_element_at("fmt", F.lit("sz"))["source"].alias("size_from"), "bold", "colour")

    return answered(spark, sf_dir, rows)


_FREE = """CASE WHEN s = '' THEN 'empty' WHEN lower(c) = 'abstract' THEN 'abstract_title_en' WHEN regexp_matches(s, '^(?i:key\\s*words?\\s*[:：])') THEN 'keywords_en' WHEN c = '目录' THEN 'toc_title'
    WHEN c = '参考文献' THEN 'references_title' WHEN c = '致谢' THEN 'acknowledgements_title' WHEN starts_with(s, '附录') THEN 'appendix_heading' WHEN regexp_matches(s, '^图\\s*[0-9]+\\s*-\\s*[0-9]+') THEN 'figure_caption' END"""


@query(f"""WITH {_LINES}, t AS (
  SELECT doc_id, i, style, trim(x, ' ' || chr(9) || chr(10) || chr(160) || chr(12288)) AS s, regexp_replace(x, '[\\s]+', '', 'g') AS c FROM (
    SELECT *, a || CASE WHEN i % 9 = 8 THEN chr(10) ELSE '' END || b || CASE WHEN i % 6 = 5 THEN ' ref x' || i || 'PAGE ' ELSE '' END AS x FROM p)
), f AS (
  SELECT *, {_FREE} AS free FROM t
), g AS (
  SELECT *, CASE free WHEN 'abstract_title_en' THEN 'abstract_en' WHEN 'toc_title' THEN 'toc' WHEN 'references_title' THEN 'references' WHEN 'acknowledgements_title' THEN 'acknowledgements' WHEN 'appendix_heading' THEN 'appendix' END AS sets FROM f
), h AS (
  SELECT *, count(sets) OVER w AS segment, coalesce(last_value(sets IGNORE NULLS) OVER w, 'front') AS base FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), k AS (
  SELECT *, free IS NULL AND (regexp_matches(s, '^[\\[［【]\\s*[0-9]+\\s*[\\]］】]') OR base = 'references') AS entry FROM h
), m AS (
  SELECT *, free IS NULL AND NOT entry AND style IS NOT DISTINCT FROM 'H1' AS heading FROM k
), o AS (
  SELECT *, coalesce(max(heading AND (regexp_matches(s, '^[0-9]+(\\s+|[、.．])') OR base = 'toc')) OVER (PARTITION BY doc_id, segment ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS opened FROM m
) SELECT doc_id, i AS idx, CASE WHEN free IS NOT NULL THEN free WHEN entry THEN 'reference_entry' WHEN heading THEN 'heading_1' WHEN opened THEN 'body' ELSE CASE base WHEN 'abstract_en' THEN 'abstract_body_en' WHEN 'toc' THEN 'toc_related_text'
  WHEN 'acknowledgements' THEN 'acknowledgements_body' WHEN 'appendix' THEN 'appendix_body' ELSE 'body' END END AS role FROM o""")
def word_roles(spark, sf_dir):
    def rows(n: scan.Nodes) -> DataFrame:
        paragraphs = scan.run_rows(n)[1].filter(F.col("part_name") == MAIN)
        return roles.classify(formats.paragraph_formats(scan.documents(n, only=_STYLED), paragraphs)).select("doc_id", "idx", "role")

    return answered(spark, sf_dir, rows)
