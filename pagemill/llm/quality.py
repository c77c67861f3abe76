"""Quality rules as a short-circuit cascade.

A rule is a cheap or dear test on a text's features that says whether the text is rejected. On a sample each rule is run alone;
its time per text and its share of rejections are measured there, and the rules are ordered by rejections per second. Over all
rows the rules then run in that order and stop at the first rejection. Features are computed when a rule first asks for them and
kept while the text is in hand. A text is kept if no rule rejects it, so the order changes the time and never the verdict.

Defined cases: null and empty texts have no words and are rejected by ``few_words``; null ``doc_id`` stays null; repeated rows
are judged each; an empty table gives no rows and the rules keep their given order; a very long text is judged whole, by features
whose memory is a few times its words; other columns, whatever their names, are ignored by ``judge`` and kept by ``keep_good``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
#: Rows on which costs and selectivities are estimated: about this share of all, and this many at least. They set the order of the
#: rules and nothing else.
SAMPLE_SHARE, SAMPLE_ROWS = 0.001, 500


class Features:
    """A text's features, each computed once, when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int, int]:
        """Of lines with a word: those that equal an earlier line, the characters of all, the characters of those that repeat."""
        own = [x for x in self.text.split("\n") if x.strip(_SPACE)]
        first = set(own)
        size = sum(map(len, own))
        return len(own) - len(first), size, size - sum(map(len, first))

    @cached_property
    def n_dup_lines(self) -> int:
        return self.lines[0]

    @cached_property
    def n_stutters(self) -> int:
        """Words that equal the word before."""
        return sum(map(bytes.__eq__, self.words[1:], self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of ``WINDOW`` words that occur twice or more. Windows are compared by doubling, without hashes."""
        n = self.n_words - WINDOW + 1
        if n < 2:
            return 0
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in self.words), np.int64, self.n_words)
        # A window can only repeat where its words do: most texts end here or after few windows.
        count = np.bincount(ids)
        single = np.concatenate([[0], np.cumsum(count[ids] == 1)])
        at = np.nonzero(single[WINDOW:] == single[:-WINDOW])[0]
        if len(at) < 2:
            return 0
        base = len(number) + 1
        pairs = ids[:-1] * base + ids[1:]
        width = 2
        while True:
            _, pairs = np.unique(pairs, return_inverse=True)
            if width == WINDOW:
                break
            pairs = pairs[:-width] * (int(pairs.max()) + 1) + pairs[width:]
            width *= 2
        repeated = np.nonzero(np.bincount(pairs)[pairs] > 1)[0]
        marks = np.zeros(self.n_words + 1, np.int64)
        np.add.at(marks, repeated, 1)
        np.add.at(marks, repeated + WINDOW, -1)
        return int((np.cumsum(marks) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


def few_words(f: Features) -> bool:
    return f.n_words < 20


def repeated_windows(f: Features) -> bool:
    return 100 * f.n_repeat_words > 30 * f.n_words


def repeated_lines(f: Features) -> bool:
    """Over 30 % of the characters of lines are in lines that repeat an earlier one."""
    return 100 * f.lines[2] > 30 * f.lines[1]


def symbol_heavy(f: Features) -> bool:
    """Marks glued to words, or columns of cells: over one symbol in four words."""
    return 100 * f.n_symbols > 25 * f.n_words


def stuttering(f: Features) -> bool:
    """Over a fifth of the words equal the word before."""
    return 100 * f.n_stutters > 20 * f.n_words


def odd_words(f: Features) -> bool:
    """Words so short or so long on average that the text is letters set apart, or data."""
    return f.word_chars < 2 * f.n_words or f.word_chars > 60 * f.n_words


BASE = (Rule("few_words", few_words), Rule("repeated_windows", repeated_windows))
RULES = (*BASE, Rule("repeated_lines", repeated_lines), Rule("symbol_heavy", symbol_heavy), Rule("stuttering", stuttering), Rule("odd_words", odd_words))


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, share: float = SAMPLE_SHARE, rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds a text and share rejected, of each rule alone, on a sample of ``df``; each task sums its part, so a rule's row per task
    is all that moves."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            spent, rejected = [], []
            for rule in rules:
                began = time.perf_counter()
                rejected.append(sum(rule.rejects(Features(t)) for t in texts))
                spent.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent, pa.float64()), pa.array(rejected, pa.int64()), pa.array([len(texts)] * len(rules), pa.int64())], ["rule", "s", "rejected", "n"])

    n = df.count()
    if not n:
        return {}
    sample = df.select("text").sample(min(1.0, max(rows / n, share)), seed=8)
    got = sample.mapInArrow(measured, "rule string, s double, rejected long, n long").groupBy("rule").agg(F.sum("s"), F.sum("rejected"), F.sum("n")).collect()
    return {name: (s / n, rejected / n) for name, s, rejected, n in got if n}


def ordered(rules: Sequence[Rule], costs: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; rules without an estimate stay last, as given."""
    worth = {name: share / max(s, 1e-9) for name, (s, share) in costs.items()}
    return sorted(rules, key=lambda r: -worth.get(r.name, -1.0))


def first_rejection(features: Features, rules: Sequence[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(features)), None)


_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, features: bool = False) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, rejected_by (null: kept); with ``features``, all of them, also of rejected texts."""
    order = ordered(rules, estimate(df, rules))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = [], []
            for t in batch.column(1):
                f = Features(t.as_py())
                names.append(first_rejection(f, order))
                if features:
                    rows.append([getattr(f, x) for x in _FEATURES])
            more = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_FEATURES))] if features else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), *more], ["doc_id", "rejected_by", *(_FEATURES if features else ())])

    schema = "doc_id long, rejected_by string" + "".join(f", {x} long" for x in _FEATURES if features)
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(judged, schema)


def keep_good(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` that no rule rejects, with all columns."""
    order, at = ordered(rules, estimate(df, rules)), df.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([first_rejection(Features(t.as_py()), order) is None for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(kept, df.schema)


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    found = judge(table(spark, sf_dir, "documents"), features=True)
    base_failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    return found.select("doc_id", *_FEATURES, base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n
  FROM (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, sum(n) - count(*) AS dup, sum(n * length(line)) AS chars, sum((n - 1) * length(line)) AS dup_chars
  FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line)
  GROUP BY r
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lines.chars, 0) AS chars, coalesce(lines.dup_chars, 0) AS dup_chars,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutters
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * dup_chars > 30 * chars
            OR 100 * n_symbols > 25 * n_words OR 100 * n_stutters > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 60 * n_words) AS kept
FROM f
"""
