"""Page, header, typography, paragraph and heading rules as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pattern as P
from ..operators import sequence as S
from ..sources import docx
from .rules import EXPECTED, emit

CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def font_key(name: Column) -> Column:
    """Font names that mean the same font compare equal."""
    key = F.lower(F.regexp_replace(name, r"(?U)[\s_-]+", ""))
    return F.when(key == "simsun", "宋体").when(key == "simhei", "黑体").otherwise(key)


def _key(name: str) -> str:
    return "".join(c for c in name.lower() if not c.isspace() and c not in "_-")


def off(actual: Column, expected: float | Column, allowed: float | Column) -> Column:
    return F.abs(actual - expected) > allowed


def page_rules(sections: DataFrame, firsts: DataFrame, e: dict = EXPECTED) -> list[DataFrame]:
    """``firsts``: doc_id, section_index of each document's first main section."""
    out = []
    page, margins, distances = e["page"], e["margins"], e["distances"]
    size = [(n, F.col(n), page[f"{n}_inches"] * 1440, page["twips"]) for n in ("width", "height")]
    checks = {
        "PAGE-001": size,
        "PAGE-002": [(n, F.col(n), margins[n] * 1440, margins["twips"]) for n in ("top", "bottom", "left", "right")],
        "PAGE-003": [(n, F.col(n), distances[n] * 20, distances["twips"]) for n in ("header", "footer")],
    }
    for k, (rule, values) in enumerate(checks.items()):
        wrong = [F.when(off(c, want, allowed), F.lit(n)) for n, c, want, allowed in values]
        lack = [F.when(c.isNull(), F.lit(n)) for n, c, _, _ in values]
        if rule == "PAGE-001":
            wrong.append(F.when(F.col("orientation") != page["orientation"], F.lit("orientation")))
            lack.append(F.when(F.col("orientation").isNull(), F.lit("orientation")))
        rows = sections.withColumn("wrong", F.array_compact(F.array(*wrong))).withColumn("lack", F.array_compact(F.array(*lack))).filter("size(wrong) + size(lack) > 0")
        values_ = F.to_json(F.struct("wrong", "lack", *[c.alias(n) for n, c, _, _ in values]))
        each = lambda number: F.struct(*[number(c, want, allowed).alias(n) for n, c, want, allowed in sorted(values, key=lambda v: v[0])])  # noqa: E731, B023
        compared = F.struct(each(lambda c, want, allowed: F.lit(allowed)).alias("allowed_twips"), each(lambda c, want, allowed: F.lit(want)).alias("expected_twips"), F.col("wrong").alias("mismatched_properties"), each(lambda c, want, allowed: c).alias("measured_twips"), F.col("lack").alias("unresolved_properties"))
        out.append(emit(rows, rule, 1, F.when(F.size("wrong") > 0, "page setup differs from the rule").otherwise("page setup isn't stated"), values_, F.when(F.size("wrong") == 0, "MANUAL_REVIEW"), k2=k, scope="section", evidence=compared))
    listed = F.to_json(F.array_sort(F.collect_list(F.struct("section_index", "start", "number_format", "number_start"))))
    out.append(emit(sections.groupBy("doc_id").agg(listed.alias("v")), "PAGE-004", 2, "pagination needs a rendered page", F.col("v"), "MANUAL_REVIEW", scope="document"))
    first = sections.join(firsts, ["doc_id", "section_index"]).filter("coalesce(number_format, 'decimal') <> 'decimal' or coalesce(number_start, 1) <> 1")
    out.append(emit(first, "PAGE-004", 2, "page numbers of the first main section may be wrong", F.to_json(F.struct("number_format", "number_start")), "WARNING", k1=F.lit(1), scope="section"))
    return out


def _active(sections: DataFrame, settings: DataFrame, kind: str) -> DataFrame:
    """(doc_id, part_name): headers or footers that main sections show."""
    refs = sections.join(settings, "doc_id").select("doc_id", "title_page", "even_odd", F.explode(f"effective_{kind}").alias("type", "part_name"))
    return refs.filter("type = 'default' or (type = 'even' and even_odd) or (type = 'first' and title_page)").select("doc_id", "part_name").distinct()


def header_rules(docs: DataFrame, main_sections: DataFrame, paragraphs: DataFrame, runs: DataFrame, e: dict = EXPECTED) -> tuple[list[DataFrame], list[DataFrame]]:
    """``paragraphs`` and ``runs`` have formats. Returns findings and evaluated counts."""
    want = e["header"]
    settings = docs.select("doc_id", (F.try_element_at("settings", F.lit("even_and_odd_headers")) == "1").alias("even_odd"))
    heads, feet = _active(main_sections, settings, "headers"), _active(main_sections, settings, "footers")
    first = S.first_match(main_sections, ["doc_id"], ["section_index"], F.lit(True))
    no_head, no_foot = first.join(heads, "doc_id", "left_anti"), first.join(feet, "doc_id", "left_anti")
    out = [
        emit(no_head, "HF-001", 3, "main sections have no header", F.lit("none"), scope="section"),
        emit(no_head, "HF-002", 3, "without a header its look can't be checked", F.lit("none"), k2=1, scope="section"),
        emit(no_foot, "HF-003", 5, "main sections have no footer", F.lit("none"), scope="section"),
    ]
    text = P.compact(F.col("text"))
    own = heads.join(paragraphs, ["doc_id", "part_name"]).filter(P.stripped(F.col("text")) != "")
    chosen = S.first_match(own.withColumn("_other", (text != _squeezed(want["text"])).cast("int")), ["doc_id", "part_name"], ["_other", "idx"], F.lit(True))
    visible = runs.filter(P.stripped(F.col("text")) != "")
    bad_font = P.found(F.col("text"), CJK) & ~font_key(F.col("east")).eqNullSafe(F.lit(_key(want["font"])))
    bad_size = F.col("size_pt").isNull() | off(F.col("size_pt"), want["size_pt"], want["allowed"])
    looks = visible.join(heads, ["doc_id", "part_name"], "left_semi").groupBy("doc_id", "part_name", F.col("p_idx").alias("idx")).agg(
        F.array_compact(F.collect_list(F.when(bad_font | bad_size, F.col("idx")))).alias("bad"), F.count_if(~F.col("colour").eqNullSafe(F.lit("FF0000"))).alias("not_red"), F.count(F.lit(1)).alias("n"),
    )
    reds = docs.select("doc_id", F.explode("red_rules").alias("part_name", "reds"))
    heads = heads.join(chosen.drop("section_index"), ["doc_id", "part_name"], "left").join(looks, ["doc_id", "part_name", "idx"], "left").join(reds, ["doc_id", "part_name"], "left")
    heads = heads.withColumn("section_index", F.lit(None).cast("int"))
    wrong = ~text.eqNullSafe(F.lit(_squeezed(want["text"]))) | (F.size(F.coalesce("bad", F.array().cast("array<int>"))) > 0)
    out.append(emit(heads.filter(wrong), "HF-001", 4, "header text or format differs from the rule", F.to_json(F.struct("bad", text.alias("text"))), runs=F.col("bad"), evidence=F.struct(F.struct(F.lit(want["font"]).alias("east"), F.lit(want["size_pt"]).alias("size_pt"), F.lit(want["text"]).alias("text")).alias("expected"), F.col("bad").alias("mismatched_runs"), "part_name", text.alias("text"))))
    plain = (F.coalesce("n", F.lit(0)) == 0) | (F.col("not_red") > 0) | (F.coalesce("reds", F.lit(0)) < want["rules"])
    out.append(emit(heads.filter(plain), "HF-002", 4, "header isn't red, or lacks its two red rules", F.to_json(F.struct("not_red", "reds")), k2=1, evidence=F.struct(F.lit(want["rules"]).alias("expected_rules"), "part_name", F.col("reds").alias("red_rules"), F.col("not_red").alias("runs_not_red"), F.col("n").alias("runs_seen"))))
    page = paragraphs.filter(F.exists("instructions", lambda c: P.found(c, r"(?i)\bPAGE\b")))
    centred = (F.col("alignment") == "center") | F.exists(F.split(F.coalesce("tabs", F.lit("")), ";"), lambda t: F.split(t, ",")[0] == "center")
    numbers = page.groupBy("doc_id", "part_name").agg(F.bool_or(F.coalesce(centred, F.lit(False))).alias("centred"), F.max("idx").alias("idx"), F.max_by("text", "idx").alias("text"))
    feet_ = feet.join(numbers, ["doc_id", "part_name"], "left").withColumn("section_index", F.lit(None).cast("int"))
    out.append(emit(feet_.filter(~F.coalesce("centred", F.lit(False))), "HF-003", 5, "footer has no centred PAGE field", F.to_json(F.struct(F.col("idx").isNotNull().alias("page"), "centred")), k2=1))
    broken = first.filter("(header_linked and size(effective_headers) = 0) or (footer_linked and size(effective_footers) = 0)")
    out.append(emit(broken, "HF-004", 6, "linked to a section without headers or footers", scope="section"))
    marks = []
    for rules, parts in ((("HF-001", "HF-002"), heads), (("HF-003",), feet)):
        n = first.select("doc_id").join(parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")), "doc_id", "left").select("doc_id", F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)).alias("n"))
        marks += [n.select("doc_id", F.lit(r).alias("rule_id"), "n") for r in rules]
    marks.append(main_sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit("HF-004").alias("rule_id"), "n"))
    return out, marks


def _squeezed(text: str) -> str:
    return "".join(text.split())


def body_rules(main: DataFrame, runs: DataFrame, e: dict = EXPECTED) -> tuple[list[DataFrame], list[DataFrame]]:
    """``main``: classified main-part paragraphs with formats and in_main."""
    want, para = e["body"], e["paragraph"]
    body = main.filter("in_main and role = 'body' and not in_table and stripped <> ''")
    own = runs.filter((F.col("part_name") == docx.MAIN) & (P.stripped(F.col("text")) != ""))
    east, latin = P.found(F.col("text"), CJK), F.col("text").rlike("[A-Za-z0-9]")
    wrong_font = (east & (font_key(F.col("east")) != _key(want["east"]))) | (latin & (font_key(F.col("latin")) != _key(want["latin"])))
    open_font = (east & F.col("east").isNull()) | (latin & F.col("latin").isNull())
    false = lambda c: F.coalesce(c, F.lit(False))
    own = own.withColumns({
        "_wrong_font": false(wrong_font), "_open_font": false(open_font), "_wrong_size": false(off(F.col("size_pt"), want["size_pt"], want["allowed"])), "_open_size": F.col("size_pt").isNull(),
        "_mixed": east & latin, "_colour": ~F.col("no_colour") & ~F.coalesce("colour", F.lit("auto")).isin("auto", "000000"),
    })
    wrong, open_ = F.col("_wrong_font") | F.col("_wrong_size"), F.col("_open_font") | F.col("_open_size")
    mixed = F.col("_mixed") & (F.col("_wrong_font") | F.col("_open_font"))
    source = lambda k: F.try_element_at("fmt", F.lit(k))["source"]
    sources = F.struct(source("colour").alias("colour"), source("font.eastAsia").alias("east"), F.coalesce(source("font.hAnsi"), source("font.ascii")).alias("latin"), source("sz").alias("size_pt"))
    amiss = lambda tests: F.array_compact(F.array(*[F.when(false(t), F.lit(n)) for n, t in tests]))
    east_off, latin_off = east & (font_key(F.col("east")) != _key(want["east"])), latin & (font_key(F.col("latin")) != _key(want["latin"]))
    mismatched = amiss([("east", east_off), ("latin", latin_off), ("size_pt", F.col("_wrong_size"))])
    unresolved = amiss([("east", east & F.col("east").isNull()), ("latin", latin & F.col("latin").isNull()), ("size_pt", F.col("_open_size"))])
    # Fields in the order of their names, as JSON readers compare them; the run's number comes first to sort by.
    sample = F.struct("idx", F.struct("east", "latin", mismatched.alias("mismatched_properties"), F.col("idx").alias("run_index"), "size_pt", F.substring("text", 1, 30).alias("text"), unresolved.alias("unresolved_properties")).alias("x"), sources.alias("sources"))
    listed = lambda test: F.array_sort(F.array_compact(F.collect_list(F.when(test, sample))))
    told = lambda c: F.to_json(F.transform(c, lambda r: r["x"]))
    picked = lambda c: F.array_sort(F.array_compact(F.collect_list(F.when(c, F.col("idx")))))
    by = own.groupBy("doc_id", F.col("p_idx").alias("idx")).agg(
        picked(wrong | open_).alias("bad"), F.bool_or(wrong).alias("any_wrong"), picked(mixed).alias("mixed_bad"), F.bool_or(mixed & wrong).alias("mixed_wrong"),
        picked(F.col("_colour")).alias("coloured"), F.count_if(F.col("_mixed")).alias("n_mixed"),
        listed(wrong | open_).alias("samples"), listed(mixed).alias("mixed_samples"), F.count(F.lit(1)).alias("n_runs"),
        F.array_sort(F.collect_list(F.when(F.col("_colour"), F.struct(F.col("idx").alias("run_index"), "colour", F.substring("text", 1, 30).alias("text"), source("colour").alias("source"))))).alias("colours"),
    )
    rows = body.join(by, ["doc_id", "idx"], "left")
    known = F.struct("confidence", F.col("evidence").alias("reason"), "role").alias("classification")
    fonts = F.struct(F.lit(want["east"]).alias("east"), F.lit(want["latin"]).alias("latin"), F.lit(want["size_pt"]).alias("size_pt"), F.lit(want["allowed"]).alias("size_allowed")).alias("expected")
    origins = lambda c: F.transform(c, lambda r: F.struct(r["x"]["run_index"].alias("run_index"), r["sources"].alias("sources"))).alias("provenance")
    from_ = lambda k: F.try_element_at("fmt", F.lit(k))["source"]
    lines = F.struct(F.lit(["both", "justified"]).alias("alignment"), F.lit(para["line_multiple"]).alias("line_multiple")).alias("expected")
    manual = lambda c: F.when(~F.coalesce(c, F.lit(False)), "MANUAL_REVIEW")
    line_off = off(F.col("line_multiple"), para["line_multiple"], para["twips"] / 240)
    wrong_p = false(~F.col("alignment").isin("both", "justified")) | false(line_off)
    open_p = F.col("alignment").isNull() | F.col("line_multiple").isNull()
    out = [
        emit(rows.filter("size(bad) > 0"), "FONT-001", 7, "body font or size differs from the rule", told("samples"), manual(F.col("any_wrong")), runs=F.col("bad"), evidence=F.struct(known, F.col("n_runs").alias("effective_formats_compared"), fonts, origins("samples"))),
        emit(rows.filter("size(coloured) > 0"), "FONT-002", 7, "body text isn't black", F.to_json(F.transform("colours", lambda r: F.struct(r["colour"].alias("colour"), r["run_index"].alias("run_index"), r["text"].alias("text")))), k2=1, runs=F.col("coloured"), evidence=F.struct(F.lit(["field", "hidden text", "hyperlink", "revision"]).alias("excluded_contexts"), F.transform("colours", lambda r: F.struct(r["run_index"].alias("run_index"), r["source"].alias("source"))).alias("provenance"))),
        emit(rows.filter("size(mixed_bad) > 0"), "FONT-003", 7, "a run of both scripts lacks the font of one", told("mixed_samples"), manual(F.col("mixed_wrong")), k2=2, runs=F.col("mixed_bad"), evidence=F.struct(fonts, origins("mixed_samples"), F.lit("CJK and Latin letters or digits in one run").alias("script_detection"))),
        emit(rows.filter(wrong_p | open_p), "PARA-001", 7, "body alignment or line spacing differs from the rule", F.to_json(F.struct("alignment", "line_multiple", "line_pt")), manual(wrong_p), k2=3, evidence=F.struct(known, lines, F.struct(from_("jc").alias("alignment"), from_("line").alias("line")).alias("provenance"))),
    ]
    marks = [body.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select("doc_id", F.lit(r).alias("rule_id"), "n") for r in ("FONT-001", "FONT-002", "PARA-001")]
    marks.append(rows.groupBy("doc_id").agg(F.sum("n_mixed").alias("n")).select("doc_id", F.lit("FONT-003").alias("rule_id"), "n"))
    return out, marks


def spacing_rules(main: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    empty = F.col("in_main") & ~F.col("in_table") & (F.col("stripped") == "")
    runs = S.islands(main, ["doc_id"], ["idx"], empty).select("doc_id", F.col("first").alias("idx"), "last", "n")
    runs = runs.join(main.select("doc_id", "idx", "text", "part_name", "section_index"), ["doc_id", "idx"])
    spaced = main.filter(F.col("in_main") & (F.col("stripped") != "") & F.col("text").rlike(" {2,}|　"))
    breaks = main.filter(F.size("break_types") > 0)
    out = [
        emit(runs, "PARA-002", 8, "consecutive empty paragraphs", F.to_json(F.struct("idx", "last", "n")), k1=F.col("last") + 1),
        emit(spaced, "PARA-002", 8, "consecutive or full-width spaces", F.substring("text", 1, 80), k2=1),
        emit(breaks, "PARA-003", 8, "a manual break needs a rendered page", F.to_json("break_types"), "MANUAL_REVIEW", k2=2),
    ]
    n = main.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return out, [n.select("doc_id", F.lit(r).alias("rule_id"), "n") for r in ("PARA-002", "PARA-003")]


def heading_rules(main: DataFrame, runs: DataFrame, e: dict = EXPECTED) -> tuple[list[DataFrame], list[DataFrame]]:
    heads = main.filter("in_main and role in ('heading_1', 'heading_2', 'heading_3')").withColumn("level", F.substring("role", -1, 1).cast("int"))
    written = P.group(F.col("text"), r"\A\s*(\d+(?:[.．]\d+)*)", 1)
    number = F.transform(F.split(written, "[.．]"), lambda x: x.try_cast("int"))
    heads = heads.withColumn("number", F.when(written.isNotNull(), number))
    heads = heads.withColumn("mode", F.when(F.col("numbering_id").isNotNull(), "automatic").when(F.col("number").isNotNull(), "manual").otherwise("missing"))
    # A font or an allowance is one for all levels, or one a level.
    by_level = lambda v, kind: F.element_at(F.create_map(*[F.lit(x) for k in e["headings"] for x in (k, kind(v[k] if isinstance(v, dict) else v))]), F.col("level"))
    want, font, allowed = by_level(e["headings"], float), by_level(e["heading_font"], str), by_level(e["heading_allowed"], float)
    own = runs.filter((F.col("part_name") == docx.MAIN) & (P.stripped(F.col("text")) != "")).select("doc_id", F.col("p_idx").alias("idx"), F.col("idx").alias("run"), F.col("text").alias("run_text"), "east", "size_pt", "bold")
    rows = own.join(heads.select("doc_id", "idx", "level"), ["doc_id", "idx"])
    bad = (P.found(F.col("run_text"), CJK) & ~font_key(F.col("east")).eqNullSafe(font_key(font))) | F.col("size_pt").isNull()
    bad = bad | off(F.col("size_pt"), want, allowed) | ~F.coalesce("bold", F.lit(False))
    bad_runs = rows.filter(bad).groupBy("doc_id", "idx").agg(F.array_sort(F.collect_list("run")).alias("bad"))
    heads = heads.join(bad_runs, ["doc_id", "idx"], "left")
    not_centred = (F.col("level") == 1) & ~F.col("alignment").eqNullSafe(F.lit("center"))
    misnumbered = (F.col("mode") == "missing") | (F.col("number").isNotNull() & (F.size("number") != F.col("level")))
    rule = F.concat(F.lit("HEAD-00"), F.col("level"))
    asked = F.struct(F.when(F.col("level") == 1, "center").alias("alignment"), F.lit(True).alias("bold"), font.alias("east"), want.alias("size_pt"), allowed.alias("size_allowed"))
    compared = F.struct("alignment", asked.alias("expected"), "level", F.col("bad").alias("mismatched_runs"), F.col("mode").alias("numbering"), "number")
    told = F.to_json(F.struct("bad", not_centred.alias("not_centred"), misnumbered.alias("misnumbered"), "number"))
    out = [emit(heads.filter(not_centred | misnumbered | (F.size(F.coalesce("bad", F.array().cast("array<int>"))) > 0)), rule, 9, "heading format or number differs from the rule", told, runs=F.col("bad"), evidence=compared)]
    jumps = S.level_jumps(heads, ["doc_id"], ["idx"], "level")
    out.append(emit(jumps, "HEAD-004", 10, "heading level skips one", F.to_json(F.struct("previous", "level"))))
    numbers = S.continuity(heads, ["doc_id"], ["idx"], "level", "number", 3).filter("not continuous")
    out.append(emit(numbers, "HEAD-004", 10, "heading number isn't continuous", F.to_json(F.struct("number", "expected")), k2=1))
    modes = heads.filter("mode <> 'missing'").groupBy("doc_id").agg(F.array_sort(F.collect_set("mode")).alias("modes")).filter("size(modes) > 1")
    first = S.first_match(heads, ["doc_id"], ["idx"], F.lit(True)).join(modes, "doc_id")
    out.append(emit(first, "HEAD-004", 10, "automatic and manual numbers are mixed", F.to_json("modes"), k2=2))
    title = F.regexp_replace(F.regexp_replace("text", P.unicode(r"\A\s*\d+(?:[.．]\d+)*\s*"), ""), "^[ ：:、。.．]+|[ ：:、。.．]+$", "")
    out.append(emit(heads.filter(F.col("level").isin(2, 3) & title.isin(*e["generic_titles"])), "HEAD-005", 10, "heading says little", title, k2=3))
    marks = [heads.groupBy("doc_id", rule.alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))]
    counts = heads.groupBy("doc_id").agg(F.count(F.lit(1)).alias("a"), F.count_if(F.col("level") > 1).alias("b"))
    marks += [counts.select("doc_id", F.lit(r).alias("rule_id"), F.col(c).alias("n")) for r, c in (("HEAD-004", "a"), ("HEAD-005", "b"))]
    return out, marks


def review(docs: DataFrame, main: DataFrame, paragraphs: DataFrame, runs: DataFrame, e: dict = EXPECTED) -> dict[str, tuple[list[DataFrame], list[DataFrame]]]:
    """Findings (not yet numbered) and evaluated counts of the foundation rules, by group."""
    sections = docx.sections(docs)
    wanted = main.filter("in_main and section_index is not null").select("doc_id", "section_index").distinct()
    firsts = wanted.groupBy("doc_id").agg(F.min("section_index").alias("section_index"))
    n = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    marks = [n.select("doc_id", F.lit(r).alias("rule_id"), "n") for r in ("PAGE-001", "PAGE-002", "PAGE-003")]
    marks.append(docs.filter("error is null").select("doc_id", F.lit("PAGE-004").alias("rule_id"), F.lit(1).cast("long").alias("n")))
    return {
        "pages": (page_rules(sections, firsts, e), marks),
        "headers": header_rules(docs, sections.join(wanted, ["doc_id", "section_index"]), paragraphs, runs, e),
        "body": body_rules(main, runs, e),
        "spacing": spacing_rules(main),
        "headings": heading_rules(main, runs, e),
    }
