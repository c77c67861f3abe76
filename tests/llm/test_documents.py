"""Operators over documents against brute force on awkward rows."""

import base64
import bz2
import gzip
import hashlib
import json
import lzma
import random
import re
import time
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard

from pagemill.llm import secret_scan
from pagemill.llm.boilerplate import blocks, covered
from pagemill.llm.components import components
from pagemill.llm.quality import RULES, Features, Rule, estimate, first_rejection, judge, keep_good, op8_rule_cascade, ordered
from pagemill.llm.secret_scan import op7_recursive_decoding, redact, redacted, scan_text
from pagemill.llm.sharding import SEED, op6_stratified_shards, stratified_shards
from pagemill.llm.simhash import _forests, drop_near_copies, least_shared, near_duplicates, op10_simhash_tiles, prefix, similarity
from pagemill.llm.winnowing import contamination, drop_contaminated, op9_winnowing

from .conftest import CLASHES, clashing

SPACE = "\x20\x09-\x0d"


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def test_op6(spark, documents):
    folder, rows, _ = documents
    got = op6_stratified_shards(spark, folder).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(24)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_shards_hold_the_shuffled_order_of_fractions(spark):
    """Placement itself: ranks in each source by the seeded hash, rows by fraction, equal cuts; nulls and repeats of doc_id too."""
    rng = random.Random(2)
    rows = [(None if i % 50 == 0 else i % 700, rng.choice(["hot", "hot", "a", "b", None]), f"text {i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = stratified_shards(clashing(frame), 7)
    assert set(got.columns) == set(clashing(frame).columns) | {"shard", "slot"} and got.filter(" or ".join(f"{c} <> 'mine {c}'" for c in CLASHES if c not in ("shard", "slot"))).isEmpty()
    held = got.select("doc_id", "source", "text", "shard", "slot").collect()
    again = stratified_shards(frame.repartition(3), 7).select("doc_id", "source", "text", "shard", "slot").collect()
    plain = stratified_shards(frame, 7).select("doc_id", "source", "text", "shard", "slot").collect()
    assert sorted(map(str, again)) == sorted(map(str, plain))
    order = sorted(plain, key=lambda r: (r.shard, r.slot))
    assert sorted((str(r.doc_id), str(r.source), r.text) for r in held) == sorted((str(a), str(b), c) for a, b, c in rows)
    sizes, seen, fractions = Counter(r.source for r in order), Counter(), []
    for r in order:
        seen[r.source] += 1
        fractions.append((2 * seen[r.source] - 1) / (2 * sizes[r.source]))
    assert fractions == sorted(fractions)
    for source in sizes:
        own = [r.text for r in order if r.source == source]
        assert own != sorted(own) and len(set(own)) == len(own)
        for shard in range(7):
            assert abs(sum(r.shard == shard and r.source == source for r in order) - sizes[source] / 7) <= 1.5


def brute_spans(t):
    kinds = ((r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6), ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("[0-9a-f]+", lambda m: len(m[0]) >= 24))
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m))


def test_op7(spark, documents):
    folder, rows, _ = documents
    want = []
    for d, t, *_ in rows:
        spans = brute_spans(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((str(d), *(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    got = op7_recursive_decoding(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)


SECRET = 'token = "abcdef0123456789"'
B64 = base64.b64encode(b"hello " + SECRET.encode()).decode()


@pytest.mark.parametrize("hidden", [
    B64, base64.b64encode(gzip.compress(SECRET.encode())).decode(), base64.urlsafe_b64encode(B64.encode()).decode(), urllib.parse.quote(B64, safe=""), "\\u0074oken%3D%22abcdef99",
    "&#116;oken=abcdef1234"[:6] + "oken%253Dabcdef99", base64.b64encode(zlib.compress(base64.b64encode(SECRET.encode()))).decode(),
])
def test_hidden_secrets_have_spans_in_the_text(hidden):
    text = f"before {hidden} after"
    base, spans = scan_text(text)
    assert not base and spans
    assert all(7 <= a < b <= 7 + len(hidden) for a, _, b in spans)
    assert "[REDACTED]" in redacted(text) and redacted(text).startswith("before ") and redacted(text).endswith(" after")


NOISE = " ".join(hashlib.sha1(bytes([i])).hexdigest()[:9] for i in range(99))
XZ = lzma.compress(SECRET.encode())


def _escaped(data):
    return "".join(f"\\x{b:02x}" for b in data)


@pytest.mark.parametrize("hidden", [
    base64.b64encode(gzip.compress(gzip.compress(SECRET.encode()))).decode(), base64.b64encode(bz2.compress(zlib.compress(gzip.compress(SECRET.encode())))).decode(),
    base64.b64encode(gzip.compress(NOISE.encode()) + gzip.compress(SECRET.encode())).decode(), base64.b64encode(lzma.compress(b"one") + XZ).decode(),
    base64.b64encode(b"".join(map(zstandard.compress, (b"one", SECRET.encode())))).decode(), urllib.parse.quote_from_bytes(gzip.compress(SECRET.encode())), _escaped(XZ), repr(gzip.compress(SECRET.encode())),
])
def test_streams_in_streams_members_and_escapes(hidden):
    text = f"before {hidden} after"
    spans = scan_text(text)[1]
    assert spans and all(7 <= a < b <= len(text) for a, _, b in spans)


@pytest.mark.parametrize("hidden", [
    base64.b64encode(b"\xff\xfe\x00 " + SECRET.encode() + b"\x0c\xc2\xa0").decode(), base64.b64encode(SECRET.encode("utf-16")).decode(), base64.b64encode(SECRET.encode("utf-16-be")).decode(),
    *(f"/{'a' * k}/{B64}" for k in range(4)), f"/api/{base64.b64encode(gzip.compress(SECRET.encode())).decode()}", base64.encodebytes(gzip.compress(f"{NOISE} {SECRET}".encode())).decode().strip(),
    base64.encodebytes(f"{'x' * 50} {SECRET}".encode()).decode().strip().replace("\n", "\r\n"),
])
def test_base64_of_any_bytes_alignment_and_lines(hidden):
    text = f"before {hidden} after"
    spans = scan_text(text)[1]
    assert spans and all(7 <= a < b <= 7 + len(hidden) for a, _, b in spans)
    assert redacted(text).startswith("before ") and redacted(text).endswith(" after")


def test_base64_over_a_windows_end(monkeypatch):
    monkeypatch.setattr(secret_scan, "_WINDOW", 5000)
    monkeypatch.setattr(secret_scan, "_OVERLAP", 64)
    inner = base64.b64encode(gzip.compress(random.Random(1).randbytes(9000) + b" " + SECRET.encode())).decode()
    assert scan_text(base64.b64encode(gzip.compress(f"{'x, ' * 1000}{inner} end".encode())).decode())[1]


ENCODE = [
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.urlsafe_b64encode(s.encode()).decode(),
    lambda s: base64.encodebytes(bz2.compress(s.encode())).decode().strip(), lambda s: base64.b64encode(zstandard.compress(s.encode())).decode(), lambda s: base64.b64encode(s.encode("utf-16")).decode(),
    lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"%{b:02X}" for b in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: wrapped(base64.b64encode(s.encode()).decode(), 20, "\\n"), lambda s: wrapped(base64.b64encode(s.encode()).decode(), 10, "\n"), lambda s: "".join(f"%u{ord(c):04X}" for c in s), urllib.parse.quote_plus,
    lambda s: "".join(f"\\{ord(c):03o}" if ord(c) < 256 else c for c in s), lambda s: json.dumps(s)[1:-1], lambda s: s.replace("&", "&amp;").replace("=", "&equals;").replace("%", "&percnt;").replace("+", "&plus;"),
    lambda s: base64.b64encode(bare(s.encode())).decode(),
]


def wrapped(text: str, width: int, end: str) -> str:
    return end.join(text[i : i + width] for i in range(0, len(text), width))


def bare(data: bytes) -> bytes:
    machine = zlib.compressobj(9, zlib.DEFLATED, -15)
    return machine.compress(data) + machine.flush()


@pytest.mark.parametrize(
    "text",
    ["%u0074oken%3Dabcdef99", "token+%3D+abcdef99x", r"\164oken\075abcdef99", "token&equals;abcdef99", r"\\u0074oken=abcdef99", r'{"a": "{\"b\": \"token\\u003dabcdef99\"}"}'],
)
def test_escapes_of_one_secret(text):
    spans = scan_text(text)[1]
    assert spans and all(k == 0 for _, k, _ in spans)


def test_a_secret_across_the_lines_of_a_string():
    body = wrapped(base64.b64encode("a few words before token=abcdef99xyz and after".encode()).decode(), 30, r"\n")
    assert (0, len("token=abcdef99xyz")) in [(k, len("token=abcdef99xyz")) for _, k, _ in scan_text(f'"{body}"')[1]]
    assert max(b - a for a, _, b in scan_text(f'"{body}"')[1]) >= 24


def test_plain_texts_with_such_marks_stay():
    text = "AT&T; Q&A 1+1=2 100% C:\\new\\table &nbsp; a&b\nword\nother\nlines\n" * 3
    assert scan_text(text) == ([], []) and redacted(text) == text


@pytest.mark.parametrize("make", [lambda n: base64.b64encode(b"x^2 + " * n).decode(), lambda n: base64.b64encode("é token=abcdef99 \n".encode() * n).decode(), lambda n: "&amp;+%41\\n" * n])
def test_long_layers_take_time_in_proportion(make):
    def took(n: int) -> float:
        text, began = make(n), time.process_time()
        scan_text(text)
        return time.process_time() - began

    took(500)
    assert min(took(32_000) for _ in range(2)) < 20 * min(took(4_000) for _ in range(2)) + 0.2


def test_counts_of_bytes_are_those_of_prefixes():
    text = "aé漢😀\udc80" * 700
    for name, errors in (("utf-8", "surrogateescape"), ("utf-16-le", "surrogatepass")):
        counts = secret_scan._Bytes(text, name, errors)
        assert all(counts.before(i) == len(text[:i].encode(name, errors)) for i in (*range(0, 3500, 37), len(text)))


def test_any_three_layers_are_unwrapped():
    rng = random.Random(1)
    for i in range(400):
        hidden = f"{'é ' if i % 3 else ''}x {SECRET} y"
        for k in rng.choices(range(len(ENCODE)), k=3):
            hidden = ENCODE[k](f"noise {hidden} more" if rng.random() < 0.5 else hidden)
        spans = scan_text(f"before {hidden} after")[1]
        assert spans and all(7 <= a < b <= 7 + len(hidden) for a, _, b in spans)


def test_spans_are_those_of_the_escapes():
    # Each place where a layer's piece lies is known: the escape, or the base64 quartets of the secret's bytes.
    secret = "AKIA" + "Z9" * 10
    text = f"é %41 {urllib.parse.quote('é')} {''.join(f'%{ord(c):02x}' for c in secret)} é"
    start = text.index("%41%4b") if "%41%4b" in text else text.index("%41", 5)
    assert [(text[a:b], k) for a, k, b in scan_text(text)[1]] == [("".join(f"%{ord(c):02x}" for c in secret), 1)] and start
    for pad in range(7):
        body = base64.b64encode(("." * pad + f" {secret} ok").encode()).decode()
        ((a, kind, b),) = scan_text(f"x {body} y")[1]
        lo, hi = (pad + 1) // 3 * 4, -(-(pad + 1 + len(secret)) // 3) * 4
        assert (a, kind, b) == (2 + lo, 1, 2 + hi)


@pytest.mark.parametrize("border", [-40, -3, 0, 5, 3000])
@pytest.mark.parametrize("wrap", [lambda b: base64.b64encode(b).decode(), lambda b: urllib.parse.quote(b, safe="")])
def test_streams_over_a_windows_end(monkeypatch, border, wrap):
    monkeypatch.setattr(secret_scan, "_WINDOW", 8000)
    monkeypatch.setattr(secret_scan, "_OVERLAP", 64)
    inner = wrap(gzip.compress(random.Random(1).randbytes(7000) + b" " + SECRET.encode()))
    assert scan_text(base64.b64encode(gzip.compress(f"{'ab, ' * ((8000 - border) // 4)}{inner} end".encode())).decode())[1]


def test_decoding_ends(spark, documents):
    assert scan_text("%2525252541" * 50 + "QUFBQUFBQUFBQUFBQUFBQQ==" * 20)[1] == []
    frame = spark.read.parquet(f"{documents[0]}/documents.parquet")
    assert redact(frame).count() == frame.count() and redact(frame).schema == frame.schema


def brute_features(t):
    t = t or ""
    w = re.findall(f"[^{SPACE}]+", t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    own = [x for x in t.split("\n") if re.search(f"[^{SPACE}]", x)]
    return len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(own) - len(set(own)), len(again)


def test_op8(spark, documents):
    folder, rows, _ = documents
    want = []
    for d, t, *_ in rows:
        f = brute_features(t)
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        want.append((str(d), *f, failed, first_rejection(Features(t), RULES) is None))
    got = op8_rule_cascade(spark, folder).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == sorted(want)
    assert all(not (w[-1] and w[-2]) for w in want)


def test_order_of_rules_changes_no_verdict(spark, documents):
    frame = spark.read.parquet(f"{documents[0]}/documents.parquet")
    kept = keep_good(frame).count()
    assert kept == judge(frame, RULES[::-1]).filter("rejected_by is null").count() > 0


def test_dear_rules_run_only_on_what_cheap_ones_leave(spark, documents):
    """The order follows rejections per second, and a rule behind a rejection isn't called."""
    rules = (Rule("dear", lambda f: sum(i * i for i in range(20_000)) < 0), Rule("cheap", lambda f: f.n_words < 60))
    frame = spark.read.parquet(f"{documents[0]}/documents.parquet")
    order = ordered(rules, estimate(frame, rules))
    assert [r.name for r in order] == ["cheap", "dear"]
    called = []
    told = [Rule(r.name, lambda f, r=r: called.append(r.name) or r.rejects(f)) for r in order]
    verdicts = [first_rejection(Features(t), told) for _, t, *_ in documents[1]]
    assert called.count("cheap") == len(verdicts) and called.count("dear") == sum(v != "cheap" for v in verdicts) < len(verdicts)


def test_rules_of_cells_stutters_and_lines():
    rejects = {r.name: r.rejects for r in RULES}
    prose = " ".join(f"word{i}" for i in range(60))
    assert rejects["symbol_heavy"](Features(" | ".join(f"cell{i}" for i in range(60)))) and not rejects["symbol_heavy"](Features(f"{prose} # * |"))
    assert rejects["stuttering"](Features("one one one two two two " * 9)) and not rejects["stuttering"](Features(f"{prose} had had"))
    twice = "a line that stands at both ends\n"
    assert not rejects["repeated_lines"](Features(twice + prose + "\n" + twice)) and rejects["repeated_lines"](Features(twice * 5))


def test_extra_columns_that_clash(spark, documents):
    docs, bench = (spark.read.parquet(f"{documents[0]}/{n}.parquet") for n in ("documents", "benchmark"))
    odd = clashing(docs)
    for plain, clash in (
        (judge(docs, features=True), judge(odd, features=True)), (secret_scan.scan(docs), secret_scan.scan(odd)), (contamination(docs, bench), contamination(odd, clashing(bench))), (near_duplicates(docs), near_duplicates(odd)),
        (keep_good(docs), keep_good(odd).select(docs.columns)), (redact(docs), redact(odd).select(docs.columns)), (drop_contaminated(docs, bench), drop_contaminated(odd, clashing(bench)).select(docs.columns)),
    ):
        assert plain.columns == clash.columns and sorted(map(str, plain.collect())) == sorted(map(str, clash.collect()))
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and kept.filter(" or ".join(f"{c} <> 'mine {c}'" for c in CLASHES)).isEmpty()
    assert kept.count() == drop_near_copies(docs).count()


def brute_hits(t, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    w, hit, found = words(t), set(), set()
    for item, x in items:
        own = words(x)
        size = min(len(own), 10)
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_op9(spark, documents):
    folder, rows, items = documents
    want = sorted((str(d), *brute_hits(t, items)) for d, t, *_ in rows)
    assert sum(w[-1] for w in want) >= 2
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in op9_winnowing(spark, folder).collect()) == want
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    assert drop_contaminated(docs, bench).count() == sum(not w[-1] for w in want)


def brute_print(t):
    w = re.findall(f"[^{SPACE}]+", lower(t))
    own = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op10(spark, documents):
    folder, rows, _ = documents
    prints = np.array([brute_print(t) for _, t, *_ in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    ids = [r[0] for r in rows]
    want = []
    for i in range(len(rows)):
        group, grown = {i}, {i}
        while grown:
            grown = {int(j) for g in grown for j in np.nonzero(near[g])[0]} - group
            group |= grown
        want.append((str(ids[i]), f"{int(prints[i]):016x}", str(min((ids[j] for j in group if ids[j] is not None), default=None))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in op10_simhash_tiles(spark, folder).collect()) == sorted(want)


@pytest.mark.parametrize(("radius", "lanes", "tile"), [(5, 1, 4), (9, 1, 4), (40, 2, 8)])
def test_small_tiles_lose_no_link(spark, radius, lanes, tile):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        t = list(rng.choice(words, 40))
        for _ in range(4):
            texts.append(" ".join(t))
            t[rng.integers(40)] = "zz"
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in near_duplicates(frame, 2, radius, 42, lanes, tile).collect()}
    fp = np.array([[x % 2**64 for x in got[i].fp] for i in range(len(texts))], np.uint64)
    label = np.arange(len(texts))
    near = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2) <= radius
    for _ in range(len(texts)):
        label = np.array([label[near[i]].min() for i in range(len(texts))])
    assert [got[i].component_id for i in range(len(texts))] == label.tolist()
    assert len(set(label.tolist())) < len(texts)


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(3000)]
    base = [list(rng.choice(words, 300)) for _ in range(12)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        near = t[:]
        near[150], near[20] = "changed", "twice"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(t))]
    rows += [rows[-1], (None, "short text"), (None, "short text"), (500, None), (501, "")]
    frame = spark.createDataFrame([(d, t, "row_key") for d, t in rows], "doc_id long, text string, fp string")
    kept = drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(12)), "None", "500"])


def test_near_copies_are_those_of_the_texts(spark):
    rng = np.random.default_rng(6)
    words = [f"v{i}" for i in range(5000)]
    texts = []
    for n in (40, 60, 120, 300, 900):
        for _ in range(4):
            t = list(rng.choice(words, n))
            texts.append(" ".join(t))
            for share in (0.01, 0.02, 0.03, 0.05, 0.08):  # of words changed: similarities on both sides of 0.8
                u = t[:]
                for at in rng.choice(n, max(1, round(share * n)), replace=False):
                    u[at] = rng.choice(words)
                texts.append(" ".join(u))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = np.array([[len(x & y) >= 0.8 * len(x | y) for y in sets] for x in sets])
    label = np.arange(len(texts))
    for _ in texts:
        label = np.array([label[near[i]].min() for i in range(len(texts))])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(set(label.tolist()))
    assert 20 < len(want) < len(texts)
    assert sorted(r.doc_id for r in drop_near_copies(frame).collect()) == want
    assert sorted(r.doc_id for r in drop_near_copies(frame, tile=8).collect()) == want


def test_texts_that_share_only_a_filler_are_no_copies(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join([*rng.choice([f"v{i}" for i in range(90_000)], 800), *["."] * 200]) for _ in range(30)]
    rows = [*enumerate(texts), (40, texts[3].upper()), (41, texts[4] + " .")]  # other texts of the same sets of shingles
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(frame).collect()) == list(range(30))


def test_copies_with_repeats_or_far_fingerprints_are_found(spark):
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(90_000)]
    base = [list(rng.choice(words, 1000)) for _ in range(6)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    rows += [(100 + 10 * i + k, " ".join([*t, *["."] * n])) for i, t in enumerate(base) for k, n in enumerate((50, 100, 200))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(frame).collect()) == list(range(6))
    # Copies of similarity 0.85, none of which the radius holds.
    rows = [(i, " ".join(t)) for i, t in enumerate(base)] + [(10 + i, " ".join([*t[:920], *rng.choice(words, 80)])) for i, t in enumerate(base)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(frame, radius=1).collect()) == list(range(6))


def test_links_in_a_group_of_failing_pairs_are_found(spark):
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(90_000)]
    shared, tails = list(rng.choice(words, 304)), [list(rng.choice(words, 50)) for _ in range(300)]
    for i in range(30):
        tails[270 + i][:13] = tails[i][:13]  # 313 of 387 shingles; all other pairs: 300 of 400
    frame = spark.createDataFrame([(i, " ".join(shared + t)) for i, t in enumerate(tails)], "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_near_copies(frame).collect()) == list(range(270))


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(10)
    for n in [*range(1, 60), 90, 130]:
        common = rng.permutation(200).astype(np.uint64)[:50]
        a = np.sort(rng.choice(200, n, replace=False)).astype(np.uint64)
        for cut in range(n // 5 + 1):
            b = np.setdiff1d(a, rng.choice(a, cut, replace=False))
            if similarity(a, b) >= 0.8:
                assert len(np.intersect1d(prefix(a, 0.8, common), prefix(b, 0.8, common))) >= least_shared(min(len(a), len(b)))


def test_forests_are_thinned_and_disjoint():
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 8, (60, 1)).astype(np.uint64)
    names = np.arange(100, 160)
    edges = _forests(names, fps, fps, True, 1, 3)
    near = {(i + 100, j + 100) for i in range(60) for j in range(i + 1, 60) if (int(fps[i, 0]) ^ int(fps[j, 0])).bit_count() <= 1}
    assert {tuple(e) for e in edges.tolist()} <= near and len({tuple(e) for e in edges.tolist()}) == len(edges) <= 3 * 59
    assert len(_forests(names, fps, fps, True, 1, 1)) == 59
    assert _forests(names[:1], fps[:1], fps[:1], True, 1, 3).shape == (0, 2)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, **{i: 200 for i in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("query", [op6_stratified_shards, op7_recursive_decoding, op8_rule_cascade, op9_winnowing, op10_simhash_tiles])
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).count() == 0


def test_article_blocks():
    html = """<!DOCTYPE html><head><title>no</title></head><body class="has-sidebar"><nav>no</nav><div class="main-sidebar"><p>no</p></div><article><header><h1>A &amp;
     B</h1></header><p>one<b>two</b><br>three&nbsp;x<script>if (a < b) "</p>"</script><aside>no</aside><section id="comments"><p>no</p></section><!-- no --><p>four</article><footer>no</footer>"""
    assert blocks(html) == (["A & B", "onetwo", "three x", "four"], True)
    assert blocks(None) == ([], False) and blocks("<p") == ([], False)
    assert blocks("a < b <i>c</i> & d") == (["a < b c & d"], False)


def test_covered_is_every_window_that_another_stream_has():
    rng = np.random.default_rng(1)
    streams = [list(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(12)]
    for s, c in zip(streams, covered(streams, 4), strict=True):
        own = [tuple(s[i : i + 4]) for i in range(len(s) - 3)]
        others = {tuple(o[i : i + 4]) for o in streams if o is not s for i in range(len(o) - 3)}
        want = {j for i, w in enumerate(own) if w in others for j in range(i, i + 4)}
        assert set(np.nonzero(c)[0].tolist()) == want
