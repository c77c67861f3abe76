"""op11, op12 and op13 against brute force, and their odd cases."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from pagemill.llm import codebooks, infill, personal
from pagemill.llm.registry import ORACLE_SQL, QUERIES

from .conftest import clashing, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "table"), [("op11_filtering_lloyd", "embeddings"), ("op13_distinct_text_index", "documents")])
def test_query_equals_its_sql(spark, name, table):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = QUERIES[name](spark, SF)
    want = c.execute(ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert rows_of(got) == sorted(want.fetchall(), key=repr)


# ---- op11


def lloyd(rows, parts, entries, rounds, scale):
    """Plain Lloyd rounds on Python's whole numbers: codes, errors, all components."""
    whole = [[int(np.floor(np.float64(x) * scale)) for x in v] for v in rows]
    width = len(whole[0]) // parts if whole else 0
    books = [[list(v[p * width : (p + 1) * width]) for v in whole[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return [[min((far(v[p * width : (p + 1) * width], e), i) for i, e in enumerate(books[p])) for p in range(parts)] for v in whole]

    for _ in range(rounds):
        own = nearest()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [v[p * width : (p + 1) * width] for v, o in zip(whole, own, strict=True) if o[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = nearest()
    return ["".join(f"{i:02x}" for _, i in o) for o in own], [sum(d for d, _ in o) for o in own], [x for b in books for e in b for x in e]


def vectors(kind, n, width, seed):
    rng = np.random.default_rng(seed)
    if kind == "ties":  # few values, so that boxes are flat and distances equal
        return rng.integers(-2, 3, (n, width)) / 4096.0
    if kind == "one":
        return np.full((n, width), 0.25)
    if kind == "far":
        return rng.normal(size=(n, width)) * 10.0 ** rng.integers(-6, 14, (n, 1))
    return rng.normal(size=(n, width)) * 0.1


@pytest.mark.parametrize("kind", ["plain", "ties", "one", "far"])
@pytest.mark.parametrize("n", [3, 16, 33, 300])
def test_op11_trees_give_plain_lloyds_result(spark, kind, n):
    rows = vectors(kind, n, 24, n).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(rows)], "id long, v array<double>, l int").repartition(3)
    out, books = codebooks.compress(df, "v", "id", "l", rounds=3)
    codes, errors, components = lloyd(rows.tolist(), 8, 16, 3, 4096)
    assert codebooks.listed(books) == ",".join(map(str, components))
    assert rows_of(out.select("id", "code", "error")) == sorted(((i, c, e if e < 1 << 63 else None) for i, (c, e) in enumerate(zip(codes, errors, strict=True))), key=repr)


def test_op11_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000], [10_000, 10_000]])
    rows = centres[rng.integers(0, 4, 4000)] + rng.integers(-50, 50, (4000, 2))
    tree = codebooks.build_tree(rows)
    assert len(tree.boxes) == 8  # 125 leaves of 32 at most
    seen = []
    plain = codebooks._squared
    codebooks._squared = lambda a, b: seen.append(np.broadcast_shapes(a.shape, b.shape)) or plain(a, b)
    try:
        sums, counts, _ = codebooks.assign(tree, centres, False)
    finally:
        codebooks._squared = plain
    assert sum(s[0] for s in seen) < 800  # comparisons with boxes and rows, where plain rounds compare 4000 rows
    own = plain(rows[:, None], centres[None]).argmin(axis=1)
    assert counts.tolist() == np.bincount(own, minlength=4).tolist()
    assert sums.tolist() == [rows[own == i].sum(axis=0).tolist() for i in range(4)]


def test_op11_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    fine = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    twice = fine()
    rows = [(i, fine(), i % 2) for i in range(20)] + [(5, twice, None), (5, twice, None), (None, fine(), None), (None, None, 1)]
    bad = [(90, None, 1), (91, [None] + [0.0] * 7, 1), (92, [float("nan")] + [0.0] * 7, 1), (93, [float("inf")] + [0.0] * 7, 1), (-1, [float("-inf")] + [0.0] * 7, 1)]
    clashing(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = codebooks.op11_filtering_lloyd(spark, str(tmp_path)).collect()
    kept = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    values = [[float(np.float32(x)) for x in v] for _, v, _ in kept]
    codes, errors, components = lloyd(values, 8, 16, 6, 4096)
    by_label = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
    want = [(i, c, e, by_label[label], digest) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_op11_refuses_what_it_cannot_cut(spark):
    rows = lambda *v: spark.createDataFrame([(i, x, 0) for i, x in enumerate(v)], "id long, v array<double>, l int")
    with pytest.raises(ValueError, match="don't divide"):
        codebooks.compress(rows([1.0] * 9), "v", "id", "l")
    with pytest.raises(ValueError, match="different lengths"):
        codebooks.compress(rows([1.0] * 8, [1.0] * 16), "v", "id", "l")


def test_op11_chunks_change_nothing(spark, monkeypatch):
    rows = vectors("plain", 500, 16, 9)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], "id long, v array<double>, l int").coalesce(1)
    results = []
    for cells in (1 << 20, 16 * 70):
        monkeypatch.setattr(codebooks, "_CELLS", cells)
        out, books = codebooks.compress(df, "v", "id", "l", rounds=2)
        results.append((rows_of(out), codebooks.listed(books)))
    assert results[0] == results[1]


# ---- op12

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_of(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if valid(k, m[0])]


@pytest.mark.parametrize("letters", ["a@.-+1", "12.3 ", "+1 (2)-.5", "a1@b.c d", "0 -123456789", "@ab.éİﬁ :", "TEL: tel 12-+"])
def test_op12_base_spans_are_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        base, spans = personal.scan_text(text)
        assert [(personal.KINDS[k], a, b) for k, a, b in base] == base_of(text)
        assert set(base) <= set(spans)
        assert all(0 <= a < b <= len(text) for _, a, b in spans)


def test_op12_query_equals_brute_force(spark, documents):
    folder, rows, _ = documents
    got = sorted((tuple(r)[:6] for r in personal.op12_anchor_expansion(spark, folder).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        base = base_of(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((doc_id, *(sum(k == kind for k, _, _ in base) for kind in PATTERNS), digest))
    assert got == sorted(want, key=repr)


def test_op12_query_on_the_tables(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    n = 0
    for r in personal.op12_anchor_expansion(spark, SF).collect():
        base = base_of(texts[r.doc_id])
        n += len(base)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) or not base
    assert n


@pytest.mark.parametrize(("text", "kind", "span"), [
    ("mail jane (at) corp [dot] com now", "email", "jane (at) corp [dot] com"),
    ("write to jane at corp dot com", "email", "jane at corp dot com"),
    ("jane%40corp.com", "email", "jane%40corp.com"),
    ("an müller@exämple.de", "email", "müller@exämple.de"),
    ('to "john doe"@ex.com.', "email", '"john doe"@ex.com'),
    ("from 2001:db8::1, there", "ip", "2001:db8::1"),
    ("1234567890123456 4845168114407329 x", "card", "4845168114407329"),
    ("amex 378282246310005 ok", "card", "378282246310005"),
    ("Phone: (030) 123-4567", "phone", "(030) 123-4567"),
    ("https://bob:pw@host.com/x", "login", "bob:pw"),
    ("pay GB82 WEST 1234 5698 7654 32 today", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("DE89370400440532013000.", "iban", "DE89370400440532013000"),
    ("ssn 123-45-6789", "ssn", "123-45-6789"),
    ("Passport no. X1234567", "account", "X1234567"),
])
def test_op12_added_kinds(text, kind, span):
    found = [(personal.KINDS[k], text[a:b]) for k, a, b in personal.scan_text(text)[1]]
    assert (kind, span) in found


@pytest.mark.parametrize("text", ["at 12:30:45", "see a:b and std::vector<int>", "room 12 at noon.", "000-12-1234", "GB82 WEST 1234 5698 7654 33", "on account of 3 things", "version 1.2.3", "call me", "999.1.1.1"])
def test_op12_leaves_clean_texts_alone(text):
    assert personal.scan_text(text) == ([], [])


def test_op12_long_texts_take_time_in_proportion():
    import time

    for unit in ("a", "1", "1.", "1 ", "@", "a@", ":", "+1 ", "tel 1 ", " at a", "://a"):
        began = time.perf_counter()
        personal.scan_text(unit * (400_000 // len(unit)))
        assert time.perf_counter() - began < 8, unit


def test_op12_mask_keeps_rows_and_columns(spark):
    df = clashing(spark.createDataFrame([(1, "to a.b@c.de, +1 (212) 555-0100"), (2, None), (None, ""), (2, None)], "doc_id long, text string"))
    out = personal.mask(df)
    assert out.columns == df.columns
    assert rows_of(out.select("doc_id", "text", "spans")) == sorted([(1, "to [EMAIL], [PHONE]", "mine spans"), (2, None, "mine spans"), (None, "", "mine spans"), (2, None, "mine spans")], key=repr)


# ---- op13


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
@pytest.mark.parametrize("gap", [1, 3, 100, 100_000])
def test_op13_lists_give_back_what_they_hold(n, gap):
    rng = random.Random(n * gap)
    numbers = np.cumsum([rng.randint(1, gap) for _ in range(n)]).astype(np.int64)
    coded = infill.EliasFano(numbers)
    assert [coded.select(i) for i in range(n)] == numbers.tolist()
    if n == 1000:
        assert coded.high.nbytes + coded.low.nbytes <= n * (2 + max(0, np.log2(gap))) / 8 + 16


def test_op13_boundaries():
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice("aZ z\n1é日[`{@😀") for _ in range(rng.randint(0, 50)))
        assert infill.boundaries(text).tolist() == [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]


def cut(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 20
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if spm else "psm", len(prefix), len(middle), sha(out), sha(text)


def test_op13_query_equals_brute_force(spark, documents):
    folder, rows, _ = documents
    assert rows_of(infill.op13_distinct_text_index(spark, folder)) == sorted((cut(r[0], r[1]) for r in rows), key=repr)


def test_op13_copies_marks_and_clashes(spark, tmp_path):
    texts = ["one hot text", "a <P> b", "<S>", "x<M>", "< S > <P", "<", "<P", "S>M>"]
    rows = [(i, texts[0] if i % 3 else texts[i % len(texts)]) for i in range(3000)] + [(None, texts[0]), (7, None), (7, None)]
    clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(infill.op13_distinct_text_index(spark, str(tmp_path)))
    assert got == sorted((cut(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_op13_texts_of_one_hash_are_compared(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([4, 4, 4]), pa.array(["a b", "c", "a b"]), pa.array([[1, 2], [3], [None]], pa.list_(pa.int64()))], ["key", "text", "ids"])
    made = []
    monkeypatch.setattr(infill, "boundaries", lambda text, plain=infill.boundaries: made.append(text) or plain(text))
    (out,) = infill._cut(iter([batch]))
    assert made == ["a b", "c"]  # once a text
    assert [(r["doc_id"], r["n"]) for r in out.to_pylist()] == [(1, 3), (2, 3), (3, 1), (None, 3)]


# ---- all


@pytest.mark.parametrize("name", ["op11_filtering_lloyd", "op12_anchor_expansion", "op13_distinct_text_index"])
def test_empty_tables(spark, empty, name):
    out = QUERIES[name](spark, empty)
    assert out.count() == 0
    assert len(out.columns) >= 5
