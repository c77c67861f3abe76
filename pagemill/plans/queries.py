"""The operators on plain tables: each query with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pattern as P
from ..operators import layers as L
from ..operators import nesting as N
from ..operators import relational as R
from ..operators import sequence as S
from . import reporting

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as paragraphs: doc_id, idx, text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))


_LINES = """lines AS (
  SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
)"""


@query(f"WITH {_LINES} SELECT doc_id, CAST(idx AS INTEGER) AS idx, text, CAST(length(text) AS INTEGER) AS n FROM lines")
def paragraph_scan(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "idx", "text", F.char_length("text").alias("n"))


@query("""SELECT tag, count(*) AS n, count(DISTINCT page_id) AS pages FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z0-9]+)', 1)) AS tag FROM pages) GROUP BY tag""")
def page_tag_inventory(spark, sf_dir):
    tags = F.explode(F.regexp_extract_all("html", F.lit("<([a-zA-Z0-9]+)"), F.lit(1))).alias("tag")
    # Counted by page first, so that the distinct count needs no second shuffle of the tags.
    by_page = table(spark, sf_dir, "pages").select("page_id", tags).groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("n"))
    return by_page.groupBy("tag").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pages"))


@query("""WITH e AS (
  SELECT *, CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN event_type END AS s FROM events
), g AS (
  SELECT *, sum(CASE WHEN s IS NULL THEN 0 ELSE 1 END) OVER w AS segment, last_value(s IGNORE NULLS) OVER w AS base FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), m AS (
  SELECT *, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g
)
SELECT event_id, user_id, CAST(segment AS BIGINT) AS segment, CASE WHEN seen = 1 THEN 'active' ELSE coalesce(base, 'front') END AS state FROM m""")
def state_context(spark, sf_dir):
    kind = F.col("event_type")
    setter = F.when(kind.isin("signup", "purchase", "error"), kind)
    out = S.state_context(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], setter, kind == "click", "active", "front")
    return out.select("event_id", "user_id", "segment", "state")


@query("""SELECT conv_id, turn, role, last_value(CASE WHEN role <> 'assistant' THEN turn END IGNORE NULLS) OVER w AS asked_at,
  last_value(CASE WHEN role = 'system' THEN turn END IGNORE NULLS) OVER w AS system_at FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def role_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    rows = rows.withColumns({"_a": F.when(F.col("role") != "assistant", F.col("turn")), "_s": F.when(F.col("role") == "system", F.col("turn"))})
    return S.carry_forward(rows, ["conv_id"], ["turn"], {"asked_at": "_a", "system_at": "_s"}).select("conv_id", "turn", "role", "asked_at", "system_at")


@query(f"""WITH {_LINES}, f AS (
  SELECT *, length(text) < 60 AS flag, sum(CASE WHEN length(text) < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx
    ROWS UNBOUNDED PRECEDING) AS island FROM lines
)
SELECT doc_id, CAST(min(idx) AS INTEGER) AS first, CAST(max(idx) AS INTEGER) AS last, count(*) AS n FROM f WHERE flag
GROUP BY doc_id, island HAVING count(*) >= 2""")
def short_line_islands(spark, sf_dir):
    return S.islands(lines(spark, sf_dir), ["doc_id"], ["idx"], F.char_length("text") < 60)


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def neighbour_roles(spark, sf_dir):
    return S.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE l_linenumber > previous + 1""")
def level_jumps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return S.level_jumps(rows, ["l_orderkey"], ["l_linenumber"], "l_linenumber")


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, max(l_linenumber) = count(*) AS consecutive
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY l_orderkey""")
def consecutive_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return S.consecutive(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", F.size("numbers").cast("long").alias("n"), "consecutive")


_HEADS = """h AS (
  SELECT l_orderkey, idx, CAST(1 + idx % 3 AS INTEGER) AS level, CAST(l_linenumber AS INTEGER) AS a, CAST(1 + l_partkey % 3 AS INTEGER) AS b
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS idx FROM lineitem)
), n AS (
  SELECT *, CASE level WHEN 1 THEN [a] WHEN 2 THEN [a, b] ELSE [a, b, a] END AS number FROM h
)"""


@query(f"""WITH {_HEADS}, p AS (
  SELECT *, last_value(CASE WHEN level = 1 THEN idx END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN level = 2 THEN idx END IGNORE NULLS) OVER w AS a2,
    last_value(CASE WHEN level = 3 THEN idx END IGNORE NULLS) OVER w AS a3, last_value(CASE WHEN level = 1 THEN number END IGNORE NULLS) OVER w AS n1,
    last_value(CASE WHEN level = 2 THEN number END IGNORE NULLS) OVER w AS n2, last_value(CASE WHEN level = 3 THEN number END IGNORE NULLS) OVER w AS n3
  FROM n WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), q AS (
  SELECT *, CASE level WHEN 1 THEN n1 WHEN 2 THEN CASE WHEN a2 > coalesce(a1, -1) THEN n2 END
    ELSE CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN n3 END END AS prev FROM p
), r AS (
  SELECT *, CASE WHEN prev IS NOT NULL AND prev[1:level - 1] = number[1:level - 1] THEN prev[level] + 1 ELSE 1 END AS expected FROM q
)
SELECT l_orderkey, CAST(idx AS INTEGER) AS idx, level, CAST(expected AS INTEGER) AS expected, number[level] = expected AS continuous FROM r""")
def number_continuity(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(order) - 1)
    level, a, b = (1 + F.col("idx") % 3).cast("int"), F.col("l_linenumber").cast("int"), (1 + F.col("l_partkey") % 3).cast("int")
    rows = rows.select("l_orderkey", "idx", level.alias("level"), F.slice(F.array(a, b, a), 1, level).alias("number"))
    return S.continuity(rows, ["l_orderkey"], ["idx"], "level", "number", 3).select("l_orderkey", "idx", "level", "expected", "continuous")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_reference(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.missing(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), items, ["o_orderkey"])


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled_documents(spark, sf_dir):
    return R.missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""SELECT b.p_brand, r.p_type FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT DISTINCT p_type FROM part UNION SELECT 'PAPER') r
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND p.p_type = r.p_type)""")
def required_parts(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type")
    required = part.select("p_type").distinct().union(spark.createDataFrame([("PAPER",)], "p_type string"))
    return R.missing_required(part, part, required, "p_brand", "p_type")


@query(f"""WITH {_LINES}, t AS (
  SELECT doc_id, idx, unnest(w) AS token, unnest(range(len(w))) AS position
  FROM (SELECT doc_id, idx, regexp_extract_all(text, '[A-Z][A-Z0-9-]{{2,}}') AS w FROM lines)
), f AS (
  SELECT doc_id, token, min((idx, position)) AS first_at FROM t GROUP BY ALL
)
SELECT doc_id, token, CAST(first_at[1] AS INTEGER) AS idx, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_at) AS rank FROM f) WHERE rank <= 30""")
def acronym_first_seen(spark, sf_dir):
    return S.first_seen(lines(spark, sf_dir), ["doc_id"], ["idx"], F.regexp_extract_all("text", F.lit("[A-Z][A-Z0-9-]{2,}"), F.lit(0)), 30)


@query(f"""WITH {_LINES}, p AS (
  SELECT doc_id, idx, text, min(CASE WHEN text LIKE '%The%' THEN idx END) OVER (PARTITION BY doc_id) AS a FROM lines
), q AS (
  SELECT *, min(CASE WHEN idx > a AND length(text) < 60 THEN idx END) OVER (PARTITION BY doc_id) AS b FROM p
)
SELECT doc_id, CAST(idx AS INTEGER) AS idx FROM q WHERE idx > a AND (b IS NULL OR idx < b)""")
def region_slice(spark, sf_dir):
    return S.region(lines(spark, sf_dir), ["doc_id"], "idx", F.col("text").contains("The"), F.char_length("text") < 60).select("doc_id", "idx")


@query(f"""WITH {_LINES} SELECT doc_id, CAST(min(idx) AS INTEGER) AS idx, CAST(arg_min(length(text), idx) AS INTEGER) AS n FROM lines WHERE length(text) BETWEEN 8 AND 45 AND idx < 80 GROUP BY doc_id""")
def first_match(spark, sf_dir):
    rows = lines(spark, sf_dir).filter("idx < 80").withColumn("n", F.char_length("text")).select("doc_id", "idx", "n")
    return S.first_match(rows, ["doc_id"], ["idx"], F.col("n").between(8, 45))


@query("""SELECT user_id, event_id, event_type, modes FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) FILTER (f) OVER (PARTITION BY user_id) AS modes FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS f FROM events)) WHERE r = 1 AND modes > 1""")
def mixed_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return S.mixed_modes(rows, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "modes")


_TAIL = "[.,;:!?。，；：！？]$"


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules over lines, evaluated in one pass: doc_id, idx, rule_id, category, severity."""
    text, n = F.col("text"), F.char_length("text")
    found = F.array_compact(
        F.array(
            F.when(~text.rlike(_TAIL), F.struct(F.lit("PUNCT-001").alias("rule_id"), F.lit("punctuation").alias("category"), F.lit("ERROR").alias("severity"))),
            F.when(n < 20, F.struct(F.lit("LEN-001").alias("rule_id"), F.lit("length").alias("category"), F.lit("WARNING").alias("severity"))),
            F.when(text.rlike("[A-Z][A-Z0-9-]{2,}"), F.struct(F.lit("TERM-001").alias("rule_id"), F.lit("terms").alias("category"), F.lit("MANUAL_REVIEW").alias("severity"))),
        )
    )
    return lines(spark, sf_dir).select("doc_id", "idx", F.inline(found))


_FINDINGS = f"""{_LINES}, findings AS (
  SELECT doc_id, idx, 'PUNCT-001' AS rule_id, 'punctuation' AS category, 'ERROR' AS severity FROM lines WHERE NOT regexp_matches(text, '{_TAIL}')
  UNION ALL SELECT doc_id, idx, 'LEN-001', 'length', 'WARNING' FROM lines WHERE length(text) < 20
  UNION ALL SELECT doc_id, idx, 'TERM-001', 'terms', 'MANUAL_REVIEW' FROM lines WHERE regexp_matches(text, '[A-Z][A-Z0-9-]{{2,}}')
), rules AS (SELECT * FROM (VALUES ('PUNCT-001'), ('LEN-001'), ('TERM-001'), ('NONE-001')) t(rule_id))"""

_RULES = ("PUNCT-001", "LEN-001", "TERM-001", "NONE-001")


@query(f"""WITH {_FINDINGS} SELECT d.doc_id, rules.rule_id, count(f.rule_id) AS finding_count,
  coalesce(max(f.severity), 'PASS') AS status FROM documents d CROSS JOIN rules LEFT JOIN findings f ON f.doc_id = d.doc_id AND f.rule_id = rules.rule_id GROUP BY ALL""")
def severity_rollup(spark, sf_dir):
    rules = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, _RULES))).alias("rule_id"))
    return R.severity_rollup(rules, line_findings(spark, sf_dir), ["doc_id", "rule_id"])


@query(f"""WITH {_FINDINGS} SELECT doc_id, count(*) FILTER (severity = 'PASS') AS pass, count(*) FILTER (severity = 'MANUAL_REVIEW') AS manual_review,
  count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'ERROR') AS error FROM findings GROUP BY doc_id""")
def severity_counts(spark, sf_dir):
    return R.severity_counts(line_findings(spark, sf_dir), ["doc_id"])


@query(f"WITH {_FINDINGS} SELECT category, count(*) AS n FROM findings GROUP BY category")
def category_counts(spark, sf_dir):
    return R.category_counts(line_findings(spark, sf_dir))


@query(f"""WITH {_FINDINGS}, c AS (SELECT doc_id, count(DISTINCT idx) AS n FROM findings GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS total FROM lines GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n, total, round(coalesce(n, 0) * 100.0::DOUBLE / total, 1) AS percent FROM t LEFT JOIN c USING (doc_id)""")
def coverage_ratio(spark, sf_dir):
    hit = line_findings(spark, sf_dir).select("doc_id", "idx").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return total.join(hit, "doc_id", "left").select("doc_id", n.alias("n"), "total", R.coverage(n, F.col("total")).alias("percent"))


@query(f"""WITH {_FINDINGS}, f AS (
  SELECT doc_id, doc_id || ':' || idx || ':' || rule_id AS finding_id, severity,
    CASE WHEN idx % 7 = 3 THEN NULL ELSE idx END AS paragraph_index, CASE WHEN idx % 5 = 4 THEN 'word/header1.xml' ELSE 'word/document.xml' END AS part_name,
    CASE WHEN idx % 11 = 10 THEN 'not there' ELSE '' END AS snippet, CASE WHEN rule_id = 'LEN-001' THEN 0 END AS run_start FROM findings
), p AS (
  SELECT f.*, CASE WHEN severity = 'MANUAL_REVIEW' THEN 'manual_review' WHEN severity NOT IN ('ERROR', 'WARNING') THEN 'unsupported_severity' WHEN paragraph_index IS NULL THEN 'missing_anchor'
    WHEN part_name <> 'word/document.xml' THEN 'unsupported_story_part' WHEN l.text IS NULL THEN 'paragraph_not_found' WHEN snippet = '' THEN NULL
    WHEN NOT contains(l.text, snippet) THEN 'snippet_mismatch' END AS skip_reason
  FROM f LEFT JOIN lines l ON f.doc_id = l.doc_id AND f.paragraph_index = l.idx AND f.part_name = 'word/document.xml'
), g AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1 AS id, min(run_start IS NOT NULL) OVER (PARTITION BY doc_id, paragraph_index) AS ranged
  FROM p WHERE skip_reason IS NULL
)
SELECT doc_id, finding_id, TRUE AS commented, id AS comment_id, CASE WHEN ranged THEN 'run_range' ELSE 'paragraph' END AS anchor_mode, NULL AS skip_reason FROM g
UNION ALL SELECT doc_id, finding_id, FALSE, NULL, NULL, skip_reason FROM p WHERE skip_reason IS NOT NULL""")
def comment_plan(spark, sf_dir):
    idx = F.col("idx")
    part = F.when(idx % 5 == 4, "word/header1.xml").otherwise("word/document.xml")
    start = F.when(F.col("rule_id") == "LEN-001", 0)
    findings = line_findings(spark, sf_dir).select(
        "doc_id", F.concat_ws(":", "doc_id", "idx", "rule_id").alias("finding_id"), "severity", part.alias("part_name"), F.when(idx % 7 != 3, idx).alias("paragraph_index"),
        F.when(idx % 11 == 10, "not there").otherwise("").alias("snippet"), start.alias("run_start"), start.alias("run_end"),
    )
    paragraphs = lines(spark, sf_dir).select("doc_id", F.lit("word/document.xml").alias("part_name"), F.col("idx").alias("paragraph_index"), "text")
    return R.comment_plan(findings, paragraphs)


@query("""SELECT p_partkey, CASE WHEN abs(p_retailprice - 1000) > 400 THEN 'ERROR' WHEN nullif(p_size, 7) IS NULL THEN 'MANUAL_REVIEW'
  WHEN abs(nullif(p_size, 7) - 25) > 20 THEN 'WARNING' ELSE 'PASS' END AS severity FROM part""")
def tolerance_check(spark, sf_dir):
    price = R.graded(R.tolerance(F.col("p_retailprice"), F.lit(1000), 400), "ERROR")
    size = R.graded(R.tolerance(F.nullif(F.col("p_size"), F.lit(7)), F.lit(25), 20), "WARNING")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(price != "PASS", price).otherwise(size).alias("severity"))


@query("""WITH b AS (SELECT n_regionkey, count(*) AS v FROM nation GROUP BY 1), a AS (SELECT n_regionkey, count(*) AS v FROM nation WHERE n_nationkey % 5 <> 1 AND n_regionkey <> 2 GROUP BY 1)
SELECT n_regionkey, b.v AS before, a.v AS after FROM b FULL JOIN a USING (n_regionkey) WHERE b.v IS DISTINCT FROM a.v""")
def inventory_diff(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    counts = lambda df: df.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("v"))
    return R.inventory_diff(counts(nation), counts(nation.filter("n_nationkey % 5 <> 1 and n_regionkey <> 2")), ["n_regionkey"], "v")


@query("""WITH o AS (
  SELECT o_custkey, o_orderkey, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
)
SELECT a.o_custkey, a.o_orderkey AS root, b.o_orderkey AS node, CAST(CASE WHEN b.r <= a.r THEN a.r - b.r ELSE a.r - b.r + a.n END AS INTEGER) AS depth
FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND (b.r <= a.r OR a.o_custkey % 7 = 0)""")
def style_chain(spark, sf_dir):
    """Every order is based on the customer's order before it. The first is based on nothing, on an order that isn't there, or, as a circle, on the last."""
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    last = F.last("o_orderkey").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = F.when(F.col("o_custkey") % 7 == 0, last).when(F.col("o_custkey") % 5 == 1, F.lit(-1))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lag("o_orderkey").over(order), first).alias("up"))
    return L.chains(orders, ["o_custkey"], "o_orderkey", "up")


@query("""SELECT o_custkey, k AS name, arg_max(v, ord) AS value, arg_max(src, ord) AS source FROM (
  SELECT o_custkey, o_orderkey AS ord, o_orderpriority AS src, unnest(['status', 'price']) AS k,
    unnest([CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) END]) AS v FROM orders)
WHERE v IS NOT NULL GROUP BY ALL""")
def layer_merge(spark, sf_dir):
    status, price = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string"))
    layers = table(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("source"),
        F.inline(F.array(F.struct(F.lit("status").alias("name"), status.alias("value")), F.struct(F.lit("price").alias("name"), price.alias("value")))),
    )
    return L.layer_merge(layers, ["o_custkey"], "ord", "name", "value", "source")


@query("""WITH l AS (
  SELECT o_custkey, list({'t': o_orderkey % 4 <> 0, 'v': o_totalprice > 150000} ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey
), s AS (
  SELECT o_custkey, list_reduce(list_prepend({'t': FALSE, 'v': l[1].v}, l[2:]), lambda a, x:
    {'t': FALSE, 'v': CASE WHEN x.t AND x.v THEN NOT a.v ELSE x.v END}) AS r FROM l
) SELECT o_custkey, r.v AS bold FROM s""")
def toggle_fold(spark, sf_dir):
    layers = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") > 150000).alias("bold"), (F.col("o_orderkey") % 4 != 0).alias("toggles"))
    return L.toggle_fold(layers, ["o_custkey"], "o_orderkey", "bold", "toggles")


_CHANNEL = "lpad(printf('%X', CAST(d + ((255 - d) * t + 127) // 255 AS INTEGER)), 2, '0')"


@query("""WITH p AS (SELECT p_partkey, p_partkey % 256 AS r, p_size * 5 % 256 AS g, 153 AS b, p_partkey * 7 % 256 AS t, p_size * 3 % 256 AS s FROM part),
q AS (SELECT *, (r * s + 127) // 255 AS r1, (g * s + 127) // 255 AS g1, (b * s + 127) // 255 AS b1 FROM p)
SELECT p_partkey, """ + " || ".join(_CHANNEL.replace("d +", f"{c} +").replace("- d", f"- {c}") for c in ("r1", "g1", "b1")) + " AS colour FROM q")
def colour_tint(spark, sf_dir):
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    colour = F.concat(two(F.col("p_partkey") % 256), two(F.col("p_size") * 5 % 256), F.lit("99"))
    return table(spark, sf_dir, "part").select("p_partkey", L.tinted(colour, two(F.col("p_partkey") * 7 % 256), two(F.col("p_size") * 3 % 256)).alias("colour"))


@query("""SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n, len(tokens) NOT BETWEEN 3 AND 8 AS wrong_count, regexp_matches(text, '[.;,]$') AS tail FROM (
  SELECT doc_id, text, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> '') AS tokens FROM documents WHERE contains(text, '|'))""")
def keyword_structure(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("|"))
    tokens = F.filter(F.transform(F.split("text", r"\|"), F.trim), lambda x: x != "")
    n = F.size(tokens)
    return docs.select("doc_id", n.cast("long").alias("n"), (~n.between(3, 8)).alias("wrong_count"), F.col("text").rlike(r"[.;,]\z").alias("tail"))


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, idx, length(text) AS n FROM lines WHERE regexp_matches(text, 'tion'))
SELECT doc_id, count(*) AS hits, array_to_string(list_transform((list(idx ORDER BY idx))[1:4], lambda x: CAST(x AS VARCHAR)), ',') AS sample FROM t GROUP BY doc_id""")
def bounded_samples(spark, sf_dir):
    hits = lines(spark, sf_dir).filter(F.col("text").contains("tion"))
    # The four least are kept while rows are grouped; the whole list is never built for the sample alone.
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))
    first = hits.select("doc_id", "idx", rank.alias("r")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list(F.when(F.col("r") <= 4, F.col("idx")))).alias("s"))
    return first.select("doc_id", "hits", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("sample"))


_TAGS = "div|ul|li|section|article|main|nav|header|footer|aside|p|body"
_BEGINS, _ENDS = f"^<({_TAGS})[ >]", f"^</({_TAGS})>"

# Every eleventh token of every fifth page is left out, so that things are left open and others close nothing.
_TOKENS = f"""t AS (
  SELECT page_id, unnest(x) AS tok, unnest(range(len(x))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<[^>]*>|[^<]+') AS x FROM pages)
), k AS (
  SELECT *, regexp_matches(tok, '{_BEGINS}') AS b, regexp_matches(tok, '{_ENDS}') AS e FROM t WHERE NOT (page_id % 5 = 0 AND pos % 11 = 10)
), s AS (
  SELECT *, sum(CASE WHEN b THEN 1 WHEN e THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS total FROM k
), d AS (
  SELECT *, total - least(0, min(total) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM s
), v AS (
  SELECT *, CASE WHEN e THEN nullif(lag(depth, 1, 0) OVER (PARTITION BY page_id ORDER BY pos), 0) ELSE depth END AS level FROM d
), o AS (
  SELECT page_id, pos AS b, level, (SELECT min(c.pos) FROM v c WHERE c.page_id = v.page_id AND c.level = v.level AND c.e AND c.pos > v.pos) AS e FROM v WHERE b
)"""


def tag_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as tags and what stands between them: page_id, pos, tok."""
    tokens = F.posexplode(F.regexp_extract_all("html", F.lit("<[^>]*>|[^<]+"), F.lit(0))).alias("pos", "tok")
    return table(spark, sf_dir, "pages").select("page_id", tokens).filter("not (page_id % 5 = 0 and pos % 11 = 10)")


@query(f"""WITH {_TOKENS}
SELECT page_id, CAST(b AS INTEGER) AS begin, CAST(e AS INTEGER) AS "end", CAST(level AS INTEGER) AS level FROM o""")
def nested_tags(spark, sf_dir):
    return N.spans(tag_tokens(spark, sf_dir), ["page_id"], "pos", F.col("tok").rlike(_BEGINS), F.col("tok").rlike(_ENDS))


@query(f"""WITH {_TOKENS}, i AS (
  SELECT page_id, (SELECT max(o.b) FROM o WHERE o.page_id = v.page_id AND o.b < v.pos AND o.level = v.level) AS b, pos, tok FROM v WHERE NOT b AND NOT e AND level > 0
), j AS (
  SELECT page_id, b, string_agg(tok, '' ORDER BY pos) AS joined FROM i GROUP BY ALL
)
SELECT page_id, CAST(o.b AS INTEGER) AS begin, CAST(e AS INTEGER) AS "end", CAST(level AS INTEGER) AS level, coalesce(joined, '') AS joined FROM o LEFT JOIN j USING (page_id, b) WHERE e IS NOT NULL""")
def nested_contents(spark, sf_dir):
    return N.pieces_joined(tag_tokens(spark, sf_dir), ["page_id"], "pos", F.col("tok").rlike(_BEGINS), F.col("tok").rlike(_ENDS), "tok")


# The rules of the line findings by names that reports have sections for.
_ROUTED = {"PUNCT-001": "PARA-002", "LEN-001": "FIG-001", "TERM-001": "LANG-002"}


@query(f"""WITH {_FINDINGS}, c AS ({ORACLE_SQL["comment_plan"]}
), r AS (
  SELECT f.doc_id, f.severity, f.category, coalesce(c.commented, FALSE) AS commented, CASE WHEN c.commented THEN 'commented' ELSE coalesce(c.skip_reason, 'not_in_manifest') END AS status,
    CASE f.rule_id WHEN 'PUNCT-001' THEN 4 WHEN 'LEN-001' THEN 6 ELSE 3 END AS own FROM findings f LEFT JOIN c ON c.doc_id = f.doc_id AND c.finding_id = f.doc_id || ':' || f.idx || ':' || f.rule_id
), s AS (
  SELECT doc_id, unnest(list_filter([0, 14, own, CASE WHEN severity = 'ERROR' THEN 1 END, CASE WHEN NOT commented THEN 12 END, CASE WHEN severity = 'MANUAL_REVIEW' THEN 13 END], lambda x: x IS NOT NULL)) AS section FROM r
), names AS (
  SELECT [{", ".join(f"'{s[0]}'" for s in reporting.SECTIONS)}] AS l
), n AS (
  SELECT doc_id, 'section' AS kind, l[section + 1] AS name, 1 AS n FROM s, names
  UNION ALL SELECT doc_id, 'severity', severity, 1 FROM r UNION ALL SELECT doc_id, 'category', category, 1 FROM r UNION ALL SELECT doc_id, 'status', status, 1 FROM r UNION ALL SELECT doc_id, 'total', 'findings', 1 FROM r
  UNION ALL SELECT doc_id, 'section', unnest(l), 0 FROM documents, names UNION ALL SELECT doc_id, 'severity', unnest(['ERROR', 'WARNING', 'MANUAL_REVIEW']), 0 FROM documents
  UNION ALL SELECT doc_id, 'status', 'commented', 0 FROM documents UNION ALL SELECT doc_id, 'total', 'findings', 0 FROM documents
) SELECT doc_id, kind, name, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY ALL""")
def report_totals(spark, sf_dir):
    rules = F.create_map(*[F.lit(x) for pair in _ROUTED.items() for x in pair])
    findings = line_findings(spark, sf_dir).select("doc_id", F.concat_ws(":", "doc_id", "idx", "rule_id").alias("finding_id"), F.element_at(rules, F.col("rule_id")).alias("rule_id"), "severity", "category")
    return reporting.totals(findings, comment_plan(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id"))
