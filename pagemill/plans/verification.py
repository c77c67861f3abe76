"""Whether commented copies lost anything: counts, parts, texts and comments of sources and copies as tables, compared by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import scan
from ..sources.annotate import TOUCHED
from ..sources.docx import MAIN

# The counts that comments don't change.
PRESERVED = (
    "paragraphs_body", "tables", "sections", "content_controls", "tracked_insertions", "tracked_deletions", "drawings_inline", "drawings_anchor", "vml_shapes", "omml_objects", "fields", "bookmarks",
    "hyperlinks", "footnotes", "endnotes", "hidden_runs", "manual_page_breaks", "manual_column_breaks", "paragraph_section_breaks", "ole_objects", "text_boxes", "smartart_relationship_markers",
)


def _counts(rows: DataFrame) -> DataFrame:
    """(path, key, value) of ``rows`` (path, counts, commands): what is preserved, and the fields by what they do."""
    fields = F.array_join(F.array_sort("commands"), " ")
    own = rows.select("path", F.explode("counts").alias("key", "n")).filter(F.col("key").isin(*PRESERVED)).select("path", "key", F.col("n").cast("string").alias("value"))
    return own.unionByName(rows.select("path", F.lit("fields").alias("key"), F.coalesce(fields, F.lit("")).alias("value")))


def verified(documents: DataFrame, copies: DataFrame, folder: str) -> DataFrame:
    """(path, problems, evaluated_count) of each copy: what differs from the source in more than comments, and how many counts were compared.

    ``documents``: the sources as scanned (see ``docx.SCHEMA``), with a row for each path. ``copies``: path, content, comments (how many were
    added). Checked are the counts of ``PRESERVED``, the number of comments, the main part's texts by place, all parts that comments don't
    touch by their hashes, and that the archive and the touched parts can be read."""
    from ..sources.parts import parts_of
    from ..storage import staged

    n = scan.Nodes(parts_of(copies.select("path", "content")), folder)
    paths = n.files.select("doc_id", "path").distinct()
    texts = staged(scan.texts(n), folder, "texts")
    told = scan.counts(n, texts).select("doc_id", "counts")
    commands = scan.commands(scan.field_marks(n.told), scan.K).groupBy("doc_id").agg(F.collect_list("command").alias("commands"))
    after = staged(paths.join(told, "doc_id", "left").join(commands, "doc_id", "left").select("path", "counts", F.coalesce("commands", F.array().cast("array<string>")).alias("commands")), folder, "after")
    before = documents.join(copies.select("path"), "path", "left_semi").select("path", "counts", F.col("fields.command").alias("commands"), "parts", "paragraphs")

    def found(rows: DataFrame, said: Column) -> DataFrame:
        return rows.select("path", said.alias("problem"))

    show = lambda c: F.coalesce(F.col(c), F.lit("none"))
    lost = found(R.inventory_diff(_counts(before), _counts(after), ["path", "key"], "value"), F.concat(F.lit("count "), "key", F.lit(": "), show("before"), F.lit(" then "), show("after")))
    number = lambda: F.try_element_at("counts", F.lit("comments"))
    added = before.select("path", number().alias("old")).join(after.select("path", number().alias("new")), "path").join(copies.select("path", "comments"), "path")
    missing = found(added.filter(~F.col("new").eqNullSafe(F.col("old") + F.col("comments"))), F.lit("comments are missing"))
    main = before.select("path", F.inline("paragraphs")).filter(F.col("part_name") == MAIN).select("path", "idx", "text")
    own = texts.filter(F.col("part_name") == MAIN).join(paths, "doc_id").select("path", "idx", "text")
    changed = found(R.inventory_diff(main, own, ["path", "idx"], "text"), F.lit("texts differ")).distinct()
    parts = lambda rows: rows.filter(~F.col("part_name").isin(*TOUCHED)).select("path", "part_name", "sha256")
    other = R.inventory_diff(parts(before.select("path", F.inline("parts"))), parts(n.files.filter("part_name is not null")), ["path", "part_name"], "sha256")
    differ = found(other, F.concat(F.lit("untouched parts differ: "), "part_name"))
    torn = found(n.bad.filter(F.col("part_name").isin(*TOUCHED)).join(paths, "doc_id"), F.concat_ws(": ", "part_name", "error"))
    unread = found(n.errors().join(paths, "doc_id"), F.col("error"))
    problems = reduce(DataFrame.unionByName, [lost, missing, changed, differ, torn, unread]).groupBy("path").agg(F.array_sort(F.collect_set("problem")).alias("problems"))
    compared = _counts(before).groupBy("path").agg(F.count(F.lit(1)).cast("long").alias("evaluated_count"))
    return copies.select("path").join(problems, "path", "left").join(compared, "path", "left").select("path", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"), "evaluated_count")
