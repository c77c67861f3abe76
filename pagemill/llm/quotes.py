r"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

Parsing. Lines that begin with ">" marks are quoted, at the level of their number of marks. An attribution ends with "wrote:" (or its
German, French or Spanish form) or is an "Original Message" rule, and the next line with text is quoted deeper than it is; if it doesn't
begin with "On" (am, le, el) itself, it goes back over the lines of its paragraph to one that does and has a digit. Attributions go with
the quotes. Below an "Original Message" rule with lines of a mail's head (From, Sent, ...), which go too, all text to the end is quoted
without marks, a level deeper with each such rule; without a head nothing says where such a quote ends, and it stays. Lines that begin with
"|" are quoted in messages where one follows an attribution; elsewhere they may be tables. Consecutive lines of one level are a passage; text is normalised by taking marks off, white space to single spaces, and lower
case, so a passage that was wrapped anew is still the same.

Linking. A quoted passage is hashed whole, and for passages that were cut, also by its paragraphs, pairs of consecutive lines, and
lines. The same hashes are taken of what messages wrote themselves: all of a message, its runs between quotes, paragraphs, pairs of
lines, and lines. Of what a passage's hashes find, that of the longest kind counts: whole before paragraphs before pairs before lines.
The original of a hash is the first message of the same conversation that wrote it, if that comes before the quoting message; else, if
only one conversation wrote it, that one's first message that did. What several other conversations wrote says nothing of whom a message
quotes and links nothing. Of the originals that a passage's hashes name, that of most characters is the passage's, and of those that a
message's passages of level one name, that of most characters is what it replies to (ties: its own conversation, then the greatest
conversation and the latest turn). Without a link, a message replies to the turn before it, and without that it is a root.

Threads. Roots are found by pointer doubling. Quotes can run in a circle between conversations; there the message with the least address
is the root. ``position`` numbers a thread's messages by distance from the root, then conversation and turn.

Only DataFrame operations are used. Hashes that many messages share are reduced to a row a conversation, then to a row each, before they
are joined; joins can be split where a hash is hot. Positions come from a range-partitioned sort of all messages, so a thread of any size
is spread over tasks.

Defined cases: null text is an empty message; null ``conv_id`` or ``turn`` links to nothing and is its own root; rows that share
(conv_id, turn) are one address with one parent, and each keeps its own text and has its own position; an empty table gives no rows;
a very long text is parsed whole, in one row; the noncharacters U+FDD0 to U+FDD2 are dropped; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, partitions, table, written

_MARKS = r"^[\s|]*(?:>[\s]?)+"
_BARS = r"^\s*(?:\|\s?)+"
_BARS_BELOW = r"(?im)(?:wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*\r?\n\s*\|"
_HEAD = "From|Sent|Date|To|Cc|Bcc|Subject|Reply-To|Von|Gesendet|Datum|An|Betreff|De|Envoyé|À|Objet|Enviado|Para|Asunto"
_RULE_AND_HEAD = rf"(?im)^[ \t]*-{{2,}}[ \t]*original message[ \t]*-{{2,}}[ \t]*\r?\n(?:[ \t]*\r?\n)*+(?:[ \t]*(?:{_HEAD})[ \t]*:[^\n]*+(?:\n|\z))++"
_SPACES = " \t\n\r\f\x0b"
_ENDS = r"(?i)(?:\b(?:wrote|schrieb|a écrit|escribió)\s*:|^\s*-{2,}\s*original message\s*-{2,})\s*$"
_STARTS = r"(?i)^\s*(?:on|am|le|el)\b"
_RUN, _LEVEL, _LINE = "\ufdd0", "\ufdd1", "\ufdd2"
# The shape of a text: a line's marks and its kind: b blank, e an attribution's end, E one with its start, s a start, o other.
# An end counts if the next line that isn't blank has more marks; lines from a start to a counted end count too.
_COUNTED_END = r"(?m)^(>*)([eE])(?=\n(?:>*b\n)*+\1>)"
_COUNTED_START = r"(?m)^(>*)(s)(?=\n(?:\1o\n)*+\1Ae)|\G(?!\A)(\n)(>*)(o)(?=\n(?:\4o\n)*+\4Ae)"


def _let(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once: Catalyst would copy a column's expression into a lambda that names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _marked(text: Column) -> Column:
    """``text`` with marks before the lines that stand below a rule and a mail's head, as many as there are rules above them."""

    def below(part: Column, i: Column) -> Column:
        rule = F.concat(F.repeat(F.lit(">"), i - 1), F.lit("-----Original Message-----\n"))
        # A rule with nothing below it quotes nothing, and goes.
        return F.when(i == 0, part).when(F.trim(part, F.lit(_SPACES)) == "", "").otherwise(F.concat(rule, F.regexp_replace(part, F.lit("(?m)^"), F.repeat(F.lit(">"), i))))

    return F.when(text.rlike(_RULE_AND_HEAD), F.array_join(F.transform(F.split(text, _RULE_AND_HEAD), below), "\n")).otherwise(text)


def _line(raw: Column, bars: Column) -> Column:
    level = F.length(F.regexp_replace(F.regexp_extract(raw, _MARKS, 0), "[^>]", ""))
    barred = F.when(bars & (level == 0), F.length(F.regexp_replace(F.regexp_extract(raw, _BARS, 0), "[^|]", ""))).otherwise(0)
    said = F.when(barred > 0, F.regexp_replace(raw, _BARS, "")).otherwise(F.regexp_replace(raw, _MARKS, ""))
    return F.struct((level + barred).alias("level"), raw.alias("line"), _squeezed(said).alias("norm"))


def _shape(x: Column) -> Column:
    starts, ends = x["norm"].rlike(_STARTS), x["norm"].rlike(_ENDS)
    kind = F.when(x["norm"] == "", "b").when(ends, F.when(starts, "E").otherwise("e")).when(starts & x["norm"].rlike(r"\d"), "s").otherwise("o")
    return F.concat(F.repeat(F.lit(">"), x["level"]), kind)


def _runs(lines: Column) -> Column:
    """Consecutive lines of one level: array of (level, lines), by way of one string."""

    def put(x: Column, i: Column) -> Column:
        new = F.coalesce(F.get(lines, i - 1)["level"] != x["level"], F.lit(True))
        return F.concat(F.when(new, F.concat(F.lit(_RUN), x["level"].cast("string"), F.lit(_LEVEL))).otherwise(F.lit(_LINE)), x["norm"])

    runs = F.split(F.array_join(F.transform(lines, put), ""), _RUN)
    parts = F.transform(F.filter(runs, lambda r: r != ""), lambda r: F.split(r, _LEVEL))
    return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("level"), F.split(F.get(p, F.lit(1)), _LINE).alias("lines")))


def parse(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) as row, conv_id, turn, role, own_text, max_level, and ``runs``: array of (level, lines), the
    normalised lines of each passage, the message's own at level 0, without attributions."""
    text = _marked(F.translate(F.coalesce("text", F.lit("")), _RUN + _LEVEL + _LINE, ""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", text.alias("text"))
    rows = rows.withColumn("bars", F.col("text").rlike(_BARS_BELOW))
    lines = rows.select("row", "conv_id", "turn", "role", F.transform(F.split("text", "\r?\n"), lambda x: _line(x, F.col("bars"))).alias("lines"))
    shape = F.concat(F.array_join(F.transform("lines", _shape), "\n"), F.lit("\n"))
    shape = F.regexp_replace(F.regexp_replace(shape, _COUNTED_END, "$1A$2"), _COUNTED_START, "$1$3$4A$2$5")
    kept = F.filter(F.arrays_zip("lines", F.split(shape, "\n").alias("shape")), lambda z: z["lines"].isNotNull() & ~F.contains(z["shape"], F.lit("A")))
    lines = lines.select("row", "conv_id", "turn", "role", F.transform(kept, lambda z: z["lines"]).alias("lines"))
    own = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(_SPACES))
    level = F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long")
    return lines.select("row", "conv_id", "turn", "role", own.alias("own_text"), level.alias("max_level"), _let(F.col("lines"), _runs).alias("runs"))


def _said(lines: Column) -> Column:
    """Lines as one normalised text."""
    return F.trim(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def _units(lines: Column) -> Column:
    """The normalised texts by which a passage of ``lines`` is hashed: array of (rank, said)."""
    ranked = lambda said, rank: F.transform(said, lambda x: F.struct(F.lit(rank).alias("rank"), x.alias("said")))
    paragraphs = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+"), lambda p: F.trim(F.regexp_replace(p, "\n", " ")))

    def every(full: Column) -> Column:
        pairs = F.filter(F.transform(full, lambda x, i: F.concat(x, F.lit(" "), F.get(full, i + 1))), lambda x: x.isNotNull())
        return F.concat(ranked(F.array(_said(lines)), 4), ranked(paragraphs, 3), ranked(pairs, 2), ranked(full, 1))

    return F.filter(_let(F.filter(lines, lambda x: x != ""), every), lambda u: u["said"] != "")


def links(messages: DataFrame) -> DataFrame:
    """Per address (conv_id, turn) of ``messages`` (as of ``parse``) with a linked passage: n_linked, and up_conv, up_turn, the address
    that it replies to by its quotes of level one (or nulls)."""
    known = messages.filter("conv_id is not null and turn is not null")
    runs = known.select("row", "conv_id", "turn", F.posexplode("runs").alias("p", "run"))
    asked = runs.filter("run.level > 0").select("row", "conv_id", "turn", "p", "run.level", F.inline(_units(F.col("run.lines"))))
    asked = asked.select("row", "conv_id", "turn", "p", "level", "rank", F.md5("said").alias("key"), F.length("said").cast("long").alias("chars"))
    asked = written(asked, "asked")
    # A message's own words: each run and, as one, all of them.
    own = F.filter("runs", lambda r: r["level"] == 0)
    every = F.concat(F.transform(own, lambda r: r["lines"]), F.array(F.flatten(F.transform(own, lambda r: r["lines"]))))
    mine = known.select("conv_id", "turn", F.explode(F.array_distinct(every)).alias("lines")).select("conv_id", "turn", F.explode(F.array_distinct(F.transform(_units(F.col("lines")), lambda u: u["said"]))).alias("said"))
    mine = mine.select("conv_id", "turn", F.md5("said").alias("key")).join(asked.select("key").distinct(), "key", "left_semi")
    inside = written(mine.groupBy("key", "conv_id").agg(F.min("turn").alias("in_turn")), "originals")
    alone = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "in_turn")).alias("o")).filter("n = 1").select("key", "o")
    found = asked.join(inside, ["key", "conv_id"], "left").join(alone, "key", "left")
    address = lambda conv, turn: F.struct((F.col(conv) == F.col("conv_id")).alias("here"), F.col(conv).alias("up_conv"), F.col(turn).alias("up_turn"))
    here = F.when(F.col("in_turn") < F.col("turn"), address("conv_id", "in_turn"))
    there = F.when(F.col("o.conv_id") != F.col("conv_id"), address("o.conv_id", "o.in_turn"))
    found = found.withColumn("up", F.coalesce(here, there)).filter("up is not null")
    votes = found.groupBy("row", "p", "rank", "up").agg(F.sum("chars").alias("chars"), F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"))
    passages = votes.groupBy("row", "p").agg(F.max(F.struct("rank", "chars", "up")).alias("best"), F.first("conv_id").alias("conv_id"), F.first("turn").alias("turn"), F.first("level").alias("level"))
    direct = F.sum(F.when(F.col("level") == 1, F.col("best.chars")))
    named = passages.groupBy("conv_id", "turn", "best.up").agg(direct.alias("chars"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("chars").isNotNull(), F.struct("chars", "up")))
    return named.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), best.alias("best")).select("conv_id", "turn", "n_linked", "best.up.up_conv", "best.up.up_turn")


def _climb(parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(conv_id, turn, root_conv, root_turn, depth) of all, or the addresses that are least of a circle.

    Each round, an address that hasn't met its root takes its ancestor's ancestor, and the least address among those passed: the rounds
    are the logarithm of the depth, or of a circle's length. An address that is the least of its own ancestors is in a circle."""
    address = lambda conv, turn: F.struct(F.col(conv).alias("c"), F.col(turn).alias("t"))
    top, up = F.col("up_turn").isNull(), address("up_conv", "up_turn")
    now = parents.select("conv_id", "turn", F.when(top, address("conv_id", "turn")).otherwise(up).alias("up"), F.when(~top, up).alias("least"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done"))
    now = written(now, "pointers")
    while not now.filter("not done").isEmpty():
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("next"), F.col("least").alias("below"), F.col("depth").alias("more"), F.col("done").alias("known"))
        moved = now.filter("not done").withColumn("c", F.col("up.c")).withColumn("t", F.col("up.t")).join(above, ["c", "t"])
        moved = moved.select("conv_id", "turn", F.col("next").alias("up"), F.least("least", "below").alias("least"), (F.col("depth") + F.col("more")).alias("depth"), F.col("known").alias("done"))
        before, now = now, written(now.filter("done").unionByName(moved), "pointers")
        discard(before)
        circles = now.filter("not done and least.c = conv_id and least.t = turn")
        if not circles.isEmpty():
            return now, circles.select("conv_id", "turn")
    return now.select("conv_id", "turn", F.col("up.c").alias("root_conv"), F.col("up.t").alias("root_turn"), "depth"), None


def roots(parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, root_conv, root_turn, depth) of ``parents`` (conv_id, turn, up_conv, up_turn; without a parent: nulls; an address
    once), and ``parents`` without the links that closed a circle."""
    while True:
        found, circles = _climb(parents)
        if circles is None:
            return found, parents
        cut = written(circles.withColumn("cut", F.lit(True)), "circles")
        keep = F.col("cut").isNull()
        parents = parents.join(cut, ["conv_id", "turn"], "left").withColumns({c: F.when(keep, F.col(c)) for c in ("up_conv", "up_turn")}).drop("cut")
        parents = written(parents, "cut-links")


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``position`` (from 0) in its thread; threads are never in one task for it."""
    order = ["thread_conv", "thread_turn", "depth", "conv_id", "turn", "row"]
    count = df.count()
    ordered = df.repartitionByRange(partitions(df.sparkSession, count, 1 << 20), *order).sortWithinPartitions(*order)
    ordered = written(ordered.withColumn("n", F.monotonically_increasing_id()), "ordered")
    part, at = F.shiftright("n", 33), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.withColumns({"part": part, "at": at}).drop("n")
    # One row a partition.
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(W.orderBy("part")) - F.col("size")).alias("before"))
    placed = ordered.join(before, "part").withColumn("place", F.col("before") + F.col("at")).drop("part", "at", "before")
    firsts = placed.groupBy(F.col("thread_conv").alias("c"), F.col("thread_turn").alias("t")).agg(F.min("place").alias("first"))
    return placed.join(firsts, F.col("thread_conv").eqNullSafe(F.col("c")) & F.col("thread_turn").eqNullSafe(F.col("t"))).withColumn("position", F.col("place") - F.col("first")).drop("c", "t", "place", "first")


def threads(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (conv_id, turn, role, text): conv_id, turn, role, own_text (without quotes), n_passages, max_level, n_linked
    (passages with an original), parent_conv, parent_turn, thread_conv, thread_turn, depth, position (in the thread's reply order)."""
    df = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    messages = written(parse(df), "messages")
    known = messages.select("conv_id", "turn").distinct()
    before = known.filter("conv_id is not null and turn is not null").select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows"))
    parents = known.join(before, ["conv_id", "turn"], "left").join(written(links(messages), "links"), ["conv_id", "turn"], "left")
    follows = F.col("follows") & F.col("up_turn").isNull()
    parents = parents.select("conv_id", "turn", F.when(follows, F.col("conv_id")).otherwise(F.col("up_conv")).alias("up_conv"), F.when(follows, F.col("turn") - 1).otherwise(F.col("up_turn")).alias("up_turn"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    found, parents = roots(written(parents, "reply-links"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    placed = parents.join(found.withColumnsRenamed({"conv_id": "c", "turn": "t"}), same).drop("c", "t")
    placed = placed.withColumnsRenamed({"conv_id": "c", "turn": "t", "up_conv": "parent_conv", "up_turn": "parent_turn", "root_conv": "thread_conv", "root_turn": "thread_turn"})
    n = F.size(F.filter("runs", lambda r: r["level"] > 0)).cast("long")
    out = messages.select("row", "conv_id", "turn", "role", "own_text", n.alias("n_passages"), "max_level").join(placed, same)
    out = _numbered(out.drop("c", "t"))
    return out.select("conv_id", "turn", "role", "own_text", "n_passages", "max_level", "n_linked", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "position")


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per message, with its position in the reply order of its thread: see ``threads``."""
    return threads(table(spark, sf_dir, "conversations"))
