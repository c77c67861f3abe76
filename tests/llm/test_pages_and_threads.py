import gzip
import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from pagemill.llm import boilerplate, warc
from pagemill.llm.boilerplate import main_text, op3_host_suffix_array, parsed_blocks
from pagemill.llm.quotes import op4_quotation_links, threads
from pagemill.llm.shared import new_path, written
from pagemill.llm.warc import LoserTree, capture_history, merge_runs, op5_index_merge, read_record, url_key, write_archives

from .conftest import clashing


@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree_merges(runs):
    got = list(LoserTree([iter(sorted((x,) for x in r)) for r in runs]))
    assert got == sorted((x,) for r in runs for x in r)


def test_url_keys():
    assert url_key("HTTP://www.Blog.Example.com:80/A?b#c") == "com,example,blog)/a?b"
    assert url_key("example.org") == "org,example)/" and url_key("") == ")/"


def test_capture_history(spark):
    long, rng = "é\r\n\r\nWARC/1.1 " * 300, random.Random(2)
    rows = [(i, f"https://{rng.choice('abc')}.com/{i % 5}", f"<p>{i}</p>") for i in range(40)]
    rows += [(50, "http://a.com/1", long), (51, "http://a.com/1", long), (60, None, long), (None, "x\r\ny", long), (70, "http://a.com", None), (71, "http://a.com", ""), (72, "u", "small"), (73, "u", "small")]
    rows.append(rows[3])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = capture_history(frame).orderBy("sequence").collect()
    assert len(got) == len(rows)
    keys = [(r.urlkey, r.timestamp, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    kinds = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got}
    size = len(long.encode())
    assert kinds[60] == ("response", None, size) and kinds[50] == kinds[51] == ("revisit", 60, size) and kinds[None] == ("revisit", 60, size)
    assert kinds[70] == kinds[71] == ("response", None, 0) and kinds[72] == kinds[73] == ("response", None, 5)


def test_loser_tree_takes_new_runs_on_the_way():
    rng = random.Random(4)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 50),) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        runs.sort(key=lambda r: r[:1] or [(99,)])
        tree, got = LoserTree(), []
        for run in runs:
            while run and (head := tree.head()) is not None and head < run[0]:
                got.append(tree.pop())
            tree.add(iter(run))
        assert got + list(tree) == sorted(x for r in runs for x in r)


def test_many_open_runs_merge_in_time():
    def took(k: int) -> float:
        began, tree, got = time.process_time(), LoserTree(), []
        for i in range(k):
            while (head := tree.head()) is not None and head < (i * 10,):
                got.append(tree.pop())
            tree.add(iter([(i * 10 + j * 7, i, j) for j in range(0, 20_000, 1000)]))
        got += tree
        assert len(got) == 20 * k and all(a <= b for a, b in zip(got, got[1:], strict=False))
        return time.process_time() - began

    assert took(8000) < 16 * took(1000) + 0.2


def test_a_record_is_read_alone_and_long_pages_have_their_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "LONG_BYTES", 5000)
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rng = random.Random(6)
    pages = {i: "".join(rng.choice("abc é<>&\r\n") for _ in range(rng.choice((10, 2000, 9000)))) for i in range(60)}
    frame = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i % 4}", h) for i, h in pages.items()], "page_id long, url string, html string").repartition(4)
    path = new_path(spark, "archives")
    write_archives(frame, path)
    files = {r.path.rpartition("/")[2]: bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()}
    assert all(gzip.decompress(b) for b in files.values())
    for r in capture_history(frame).collect():
        assert (r.payload_bytes, r.payload_digest) == (len(pages[r.page_id].encode()), hashlib.sha1(pages[r.page_id].encode()).hexdigest())
    for r in merge_runs(written(warc.index_runs(spark, path), "runs")).collect():
        headers, block, length = read_record(files[r.archive], r.offset)
        assert length == r.length and headers["warc-record-id"] == f"<urn:page:{r.page_id}>"
        assert block.endswith(pages[r.page_id].encode())


def test_a_hot_url_spreads_over_ranges(spark):
    frame = spark.createDataFrame([(i, "http://one.org/", "x") for i in range(3000)], "page_id long, url string, html string").repartition(7)
    got = capture_history(frame).select("page_id", "sequence").orderBy("sequence").collect()
    assert [r.page_id for r in got] == list(range(3000)) and len({r.sequence >> 40 for r in got}) > 1


def brute_repeats(pages, depth, counts):
    """By all substrings of ``depth`` tokens: for each position the longest match on another page, and how many pages that
    count have its window (-1: none is there)."""
    out = []
    for i, own in enumerate(pages):
        for at in range(len(own)):
            longest = 0
            for j, other in enumerate(pages):
                for to in range(len(other) if i != j else 0):
                    n = 0
                    while at + n < len(own) and to + n < len(other) and own[at + n] == other[to + n]:
                        n += 1
                    longest = max(longest, n)
            window = own[at : at + depth]
            holders = sum(c and any(o[k : k + depth] == window for k in range(len(o) - depth + 1)) for o, c in zip(pages, counts.tolist(), strict=True)) if len(window) == depth else -1
            out.append((longest, holders))
        out.append((0, -1))
    return out


def test_longest_repeats_and_their_pages():
    rng = random.Random(3)
    for _ in range(60):
        pages = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        ids, owner, _ = boilerplate._concatenated([[p] for p in pages])
        longest, window = boilerplate.repeats(ids, owner, 4)
        counts = np.array([rng.random() < 0.8 for _ in pages])
        want = brute_repeats(pages, 4, counts)
        assert longest.tolist() == [x for x, _ in want]
        assert [(h if n >= 0 else -1) for h, (_, n) in zip(boilerplate.holders(window, owner, counts).tolist(), want, strict=True)] == [n for _, n in want]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 300):
        ids = rng.integers(0, 2, n) if n % 2 else np.arange(n) % 3
        order, common = boilerplate.suffix_array(np.append(ids, -1))
        suffixes = [tuple(np.append(ids, -1)[i : i + boilerplate.REACH].tolist()) for i in order]
        assert suffixes == sorted(suffixes)
        full = [np.append(ids, -1)[i:].tolist() for i in order]
        for a, b, k in zip(full, full[1:], common[1:].tolist(), strict=False):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert k == same if same < boilerplate.REACH else k >= boilerplate.REACH


FOOT = "read more about us and our many partners on this site today"


def page(i, host="h.com"):
    return (i, f"http://{host}/{i}", f"<div class='x'><p>unique words of number {i} here</p><p>Home</p><p>{FOOT}</p></div>")


@pytest.mark.parametrize("part_bytes", [1 << 23, 400])
def test_repeated_blocks_go_from_open_pages(spark, part_bytes):
    copy = (20, "http://h.com/c", "<div>one page that is copied in full with many words</div>")
    near = [(30 + i, f"http://h.com/n{i}", f"<div><p>a story that {i} other pages of this host tell in almost the same words</p><p>{'and it goes on ' * 5}</p></div>") for i in range(4)]
    rows = [*(page(i) for i in range(12)), page(50, "other.com"), copy, copy, *near, (21, None, None), (22, "http://h.com/a", f"<article>{FOOT}</article>"), (None, "http://h.com/b", "<article>x</article>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text(frame, part_bytes=part_bytes).collect()}
    text = {k: r.text for k, r in got.items()}
    if part_bytes > 400:
        assert all(text[i] == f"unique words of number {i} here" and got[i].n_removed == 13 for i in range(12))
        assert all(got[30 + i].n_repeated > 0 for i in range(4)) and got[50].n_repeated == 0
    assert text[50].endswith(FOOT) and text[20].startswith("one page") and text[21] == "" and text[22] == FOOT and text[None] == "x"
    assert all(text[30 + i].startswith(f"a story that {i} other") and text[30 + i].endswith("goes on") for i in range(4))
    assert sorted(map(str, main_text(clashing(frame), part_bytes=part_bytes).collect())) == sorted(map(str, main_text(frame, part_bytes=part_bytes).collect()))


def host_pages():
    """Pages of one host with articles, open blocks that few or many pages repeat, short ones, near copies and many copies."""
    rng, words = random.Random(11), [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    feet, story = [prose(10) for _ in range(6)], prose(40)
    out = ["<div><p>the same page many times over in full</p><p>Home</p></div>"] * 60
    for i in range(150):
        parts = [prose(rng.randint(3, 30)), feet[min(rng.randrange(30), 5)], rng.choice(("Home", "Top", "a b", prose(2)))]
        parts += [f"{story} {i}"] if i % 15 == 0 else [f"see {feet[5]} {prose(3)}"] if i % 7 == 0 else []
        rng.shuffle(parts)
        out.append(f"<article><p>{prose(20)}</p></article>" * (i % 4 == 0) + "".join(f"<div>{x}</div>" for x in parts))
    return out


def test_parts_of_a_host_change_no_result(spark):
    htmls = host_pages()
    frame = spark.createDataFrame([(i, f"http://h.com/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").coalesce(2)
    want = [(i, *found) for i, found in enumerate(boilerplate.main_texts([parsed_blocks(h) for h in htmls]))]
    assert len({n for *_, n in want}) > 4 and len({n for _, _, n, _ in want}) > 4
    for sizes in ({}, {"part_pages": 90}, {"part_pages": 5}, {"part_bytes": 3000}):
        assert sorted((r.page_id, r.text, r.n_repeated, r.n_removed) for r in main_text(frame, **sizes).collect()) == want


def test_names_and_teasers():
    html = """<article><div class="article-header"><h1>Title</h1></div><h2 id="related-work">Related work</h2><section id="share-of-all"><p>body</p></section>
      <p class="notice-text">x</p><fieldset><p>q</p></fieldset><div class="ad-slot">buy</div><div class="commentList">me too</div><div class="post-footer">filed under a</div></article>"""
    kinds = [(boilerplate.TEXT, t) for t in ("Title", "Related work", "body")] + [(boilerplate.NOT_TEXT, t) for t in ("x", "q", "buy", "me too")]
    assert parsed_blocks(html) == [*kinds, (boilerplate.OPEN, "filed under a")]
    story = " ".join(f"w{i}" for i in range(50))
    teaser = f'<div class="article-body"><p>{story}</p></div><article><p>read this too</p></article><div class="site-footer">f</div>'
    assert boilerplate.main_texts([parsed_blocks(teaser)])[0][0] == f"{story} read this too"
    aside = f"<div><p>posted by a</p></div><article><p>{story}</p></article>"
    assert boilerplate.main_texts([parsed_blocks(aside)])[0][0] == story


def test_names_take_no_text_of_an_article():
    kept = """<p>See <a class="share-link">the report</a> of <span class="form-name">W-2</span>.</p><pre><code>x = 1 <span class="hljs-comment"># adds one</span>
      <div class="comment">y</div></code></pre>"""
    open_ = """<section class="related-work"><h2>Related work</h2><p>Earlier studies</p></section><div class="social-history"><p>none</p></div><p class="form-of-address">Sir</p>"""
    gone = """<div class="related-posts">a</div><div class="share-buttons">b</div><div class="comment">c</div><div class="ad">d</div><form>e</form>"""
    want = [(boilerplate.TEXT, t) for t in ("See the report of W-2.", "x = 1 # adds one", "y")] + [(boilerplate.OPEN, t) for t in ("Related work", "Earlier studies", "none", "Sir")]
    page = f"<article>{kept}{open_}{gone}</article>"
    assert parsed_blocks(page) == want + [(boilerplate.NOT_TEXT, t) for t in "abcde"]
    assert boilerplate.main_texts([parsed_blocks(page)])[0][0] == " ".join(t for _, t in want)
    # What a name leaves open inside articles is decided by repetition.
    unlike = [f"<article><p>{' '.join(f'w{i}x{j}' for j in range(9))}</p><div class='social-history'>{FOOT}</div><p>{FOOT}</p></article>" for i in range(6)]
    assert all(text.count(FOOT) == 1 and removed == len(FOOT.split()) for text, _, removed in boilerplate.main_texts([parsed_blocks(h) for h in unlike]))


def test_op3_is_structure_where_nothing_is_open(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op3_host_suffix_array(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        # The tables' pages have one article of plain markup: an independent reading by a real HTML parser of that part.
        parts, depth = [], [0]

        class Reader(HTMLParser):
            def handle_starttag(self, tag, attrs):
                depth[0] += tag == "article"
                if tag not in ("b", "i", "a", "em", "strong", "span"):
                    parts.append(" ")

            def handle_endtag(self, tag):
                depth[0] -= tag == "article"
                if tag not in ("b", "i", "a", "em", "strong", "span"):
                    parts.append(" ")

            def handle_data(self, data):
                if depth[0] > 0:
                    parts.append(data)

        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        text = " ".join("".join(parts).split())
        assert got[r.page_id] == (r.url, text, len(text))


def test_threads(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow are you?"), (1, 1, "a", "On Monday X wrote:\n> Hello   there\n> how are you?\nfine"), (1, 2, "u", "On Tuesday Y wrote:\n>> Hello there\n> fine\nok good"),
        (1, 3, "a", "> Hello there\n> How are you?\nlate reply"), (2, 0, "u", "> ok good\nnew conversation"), (2, None, "u", None), (None, 0, "a", "x"), (3, 0, "u", "same"), (3, 0, "u", "same"), (5, 4, "u", "gap"),
    ]
    got = threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert [by[1, i].own_text for i in range(4)] == ["Hello there\nHow are you?", "fine", "ok good", "late reply"]
    assert [(by[k].parent_conv, by[k].parent_turn, by[k].depth) for k in ((1, 1), (1, 2), (1, 3), (2, 0))] == [(1, 0, 1), (1, 1, 2), (1, 0, 1), (1, 2, 3)]
    assert by[1, 2].max_level == 2 and by[1, 2].n_linked == 2
    assert all(by[k].depth == 0 and by[k].parent_turn is None for k in ((2, None), (None, 0), (3, 0), (5, 4)))


def test_deep_and_hot_threads(spark):
    rows = [(1, i, "u", f"line {i}") for i in range(300)] + [(2 + i, 0, "u", f"> line 7\nown {i}") for i in range(50)]
    got = {(r.conv_id, r.turn): r for r in threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[1, i].depth == i and got[1, i].thread_turn == 0 for i in range(300))
    assert all((got[2 + i, 0].parent_turn, got[2 + i, 0].thread_conv, got[2 + i, 0].depth) == (7, 1, 8) for i in range(50))


WORDS = [f"{a}{b}" for a in ("ka", "lo", "mé", "tu") for b in ("n", "rt", "sha", "vel", "que")]


def brute_parse(text):
    """(own text, runs of (level, lines)) line by line, apart from the operator's one-string way."""
    lines = []
    for raw in re.split(r"\r?\n", text or ""):
        marks = re.match(r"[\s|]*(?:>\s?)+", raw)
        rest = raw[marks.end() :] if marks else raw
        lines.append([marks[0].count(">") if marks else 0, raw, " ".join(rest.split()).lower(), False])
    starts = lambda n: re.match(r"(?:on|am|le|el)\b", n)
    for i, (level, _, norm, _) in enumerate(lines):
        if re.search(r"\b(?:wrote|schrieb|a écrit|escribió)\s*:$", norm) or re.fullmatch(r"-{2,}\s*original message\s*-{2,}", norm):
            after = next((x for x in lines[i + 1 :] if x[2]), None)
            if after and after[0] > level:
                lines[i][3] = True
                if not starts(norm):
                    j = i - 1
                    ends = lambda n: re.search(r"(?:wrote|schrieb|a écrit|escribió)\s*:$|original message", n)
                    while j >= 0 and lines[j][2] and lines[j][0] == level and not ends(lines[j][2]) and not (starts(lines[j][2]) and re.search(r"\d", lines[j][2])):
                        j -= 1
                    if j >= 0 and lines[j][2] and lines[j][0] == level and not ends(lines[j][2]):
                        for k in range(j, i):
                            lines[k][3] = True
    lines = [x for x in lines if not x[3]]
    runs = []
    for level, _, norm, _ in lines:
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(norm)
    return "\n".join(x[1] for x in lines if x[0] == 0).strip(" \t\n\r\f\v"), runs


def brute_units(lines):
    full = [x for x in lines if x]
    paragraphs, now = [], []
    for x in [*lines, ""]:
        if x:
            now.append(x)
        elif now:
            paragraphs.append(" ".join(now))
            now = []
    return [(r, u) for r, us in ((4, [" ".join(full)]), (3, paragraphs), (2, [f"{a} {b}" for a, b in zip(full, full[1:], strict=False)]), (1, full)) for u in us if u]


def brute_threads(rows):
    parsed = [brute_parse(r[3]) for r in rows]
    originals = defaultdict(dict)
    for (conv, turn, *_), (_, runs) in zip(rows, parsed, strict=True):
        if conv is not None and turn is not None:
            own = [x for level, x in runs if level == 0]
            for lines in [*own, [y for x in own for y in x]]:
                for _, said in brute_units(lines):
                    originals[said][conv] = min(turn, originals[said].get(conv, turn))
    up, linked = {}, Counter()
    direct = defaultdict(Counter)
    for (conv, turn, *_), (_, runs) in zip(rows, parsed, strict=True):
        for level, lines in runs:
            votes = Counter()
            for rank, said in brute_units(lines) if level and conv is not None and turn is not None else ():
                held = originals[said]
                if conv in held and held[conv] < turn:
                    votes[rank, True, conv, held[conv]] += len(said)
                elif len(held) == 1 and conv not in held:
                    votes[rank, False, *next(iter(held.items()))] += len(said)
            if votes:
                rank, here, c, t = max(votes, key=lambda k: (k[0], votes[k], *k[1:]))
                linked[conv, turn] += 1
                if level == 1:
                    direct[conv, turn][here, c, t] += votes[rank, here, c, t]
    known = {(r[0], r[1]) for r in rows}
    for a in known:
        if direct[a]:
            up[a] = max(direct[a], key=lambda k: (direct[a][k], *k))[1:]
        elif None not in a and (a[0], a[1] - 1) in known:
            up[a] = (a[0], a[1] - 1)
    for a in sorted(x for x in known if None not in x):  # circles lose the link of their least address
        path, now = [a], up.get(a)
        while now is not None and now not in path:
            path.append(now)
            now = up.get(now)
        if now is not None:
            circle = path[path.index(now) :]
            del up[min(circle)]
    out = []
    for (conv, turn, *_), (own, runs) in zip(rows, parsed, strict=True):
        root, depth = (conv, turn), 0
        while root in up:
            root, depth = up[root], depth + 1
        parent = up.get((conv, turn), (None, None))
        out.append((conv, turn, own, sum(level > 0 for level, _ in runs), max((level for level, _ in runs), default=0), linked[conv, turn], *parent, *root, depth))
    return out


def quoting(seed):
    """Conversations in which messages quote all or part of others, wrapped anew, at several levels, with and without attributions."""
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, texts = [], {}
    for conv in range(14):
        for turn in range(rng.randint(1, 7)):
            own = "\n".join(rng.choice((say(rng.randint(4, 9)), say(8), "", "thanks,")) for _ in range(rng.randint(1, 5)))
            quoted = ""
            if texts and rng.random() < 0.8:
                source = rng.choice([t for a, t in texts.items() if a[0] == conv] or list(texts.values())) if rng.random() < 0.7 else rng.choice(list(texts.values()))
                lines = source.split("\n")
                cut = lines if rng.random() < 0.5 else lines[(k := rng.randrange(len(lines))) : k + rng.randint(1, 3)]
                if rng.random() < 0.3:
                    flat = " ".join(cut).split()
                    cut = [" ".join(flat[i : i + 5]) for i in range(0, len(flat), 5)]
                head = rng.choice(["", "", "On Monday 3 May, A <a@b.c> wrote:\n", "On 4 May 2020, somebody\nat some place\nwrote:\n\n", "B wrote:\n", "--- Original Message ---\n", "El 4 de mayo, C escribió:\n"])
                quoted = head + "\n".join(rng.choice(("> ", ">", "  > ")) + x for x in cut)
            text = "\n".join([quoted, own] if rng.random() < 0.6 else [own, quoted])
            texts[conv, turn] = text
            rows.append((conv, turn, "u", text))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_threads_of_quoting_messages(spark, seed):
    rows = [*quoting(seed), (None, 1, "u", "> thanks,"), (3, None, "u", None), (90, 0, "u", "only here now"), (91, 0, "u", "> only here now\nand this here"), (90, 1, "u", "> and this here")]
    rows += [(95, 0, "u", "> round and round\nwe go on"), (96, 0, "u", "> we go on\nround and round"), rows[0]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = threads(frame).collect()
    want = brute_threads(rows)
    columns = "conv_id turn own_text n_passages max_level n_linked parent_conv parent_turn thread_conv thread_turn depth".split()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[5] for w in want) > 15 and any(w[4] > 1 for w in want) and {w[8] for w in want if w[0] == 96} == {95}
    by = defaultdict(list)
    for r in got:
        by[r.thread_conv, r.thread_turn].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        order = [(r.depth, r.conv_id is not None, r.conv_id or 0, r.turn is not None, r.turn or 0) for r in own]
        assert order == sorted(order)
    if not seed:
        assert sorted(map(str, threads(clashing(frame)).collect())) == sorted(map(str, threads(frame).collect()))


def test_common_lines_and_long_attributions(spark):
    rows = [
        (1, 0, "u", "Thanks,"), (2, 0, "u", "Thanks,\nfor this"), (7, 0, "u", "ok then\nThanks,"), (20, 0, "u", "> Thanks,\nwelcome"), (30, 0, "u", "> ok then\n> thanks,\nfine"),
        (40, 0, "u", "ok"), (40, 1, "u", "yes"), (40, 2, "u", "ok\nyes"), (40, 3, "u", "> ok\n> yes\nso"), (41, 0, "u", f"On Monday 5, {'x' * 500} <x@y.z>\nwrote:\n> never said\nfine"), (42, 0, "u", "He wrote:\nno quote"),
        (50, 0, "u", "> later words\nfirst"), (60, 0, "u", "later words"), (61, 0, "u", "a\n" * 50_000 + "> b"),
    ]
    got = {(r.conv_id, r.turn): r for r in threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    up = {k: (r.parent_conv, r.parent_turn) for k, r in got.items()}
    assert up[20, 0] == (None, None) and up[30, 0] == (7, 0) and up[40, 3] == (40, 2) and up[50, 0] == (60, 0)
    assert got[41, 0].own_text == "fine" and got[42, 0].own_text == "He wrote:\nno quote" and got[61, 0].n_passages == 1


def test_quotes_without_marks(spark):
    head = "From: A B <a@b.c>\nSent: Monday\nTo: C\nSubject: x"
    mail = f"Sure.\n\n-----Original Message-----\n{head}\n\nshall we meet on the bridge?\nor elsewhere\n\n----- Original Message -----\n{head}\n\n> deeper yet\nwhere is it to be"
    rows = [
        (1, 0, "u", "where is it to be"), (2, 0, "u", "shall we meet on the bridge?\nor elsewhere"), (3, 0, "u", mail), (4, 0, "u", "Sure.\r\n-----original message-----\r\nFrom: a\r\n"), (5, 0, "u", "a\n-----Original Message-----\nno head"),
        (6, 0, "u", "B wrote:\n| shall we meet on the bridge?\n| or elsewhere\n\tyes"), (7, 0, "u", "ls\n| wc -l\n| a | b |"), (8, 0, "u", "wrote:\n> x\n\n> x\nno"), (9, 0, "u", "-----Original Message-----\n> x\nno"), (10, 0, "u", " \n-----Original Message-----\nFrom: a\nb"),
    ]
    got = {r.conv_id: r for r in threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.own_text for k, r in got.items() if k > 2} == {3: "Sure.", 4: "Sure.", 5: rows[4][3], 6: "yes", 7: rows[6][3], 8: "no", 9: "no", 10: ""}
    assert {k: (r.n_passages, r.max_level) for k, r in got.items() if k > 3} == {4: (0, 0), 5: (0, 0), 6: (1, 1), 7: (0, 0), 8: (2, 1), 9: (1, 1), 10: (1, 1)}
    assert got[3].max_level == 3
    assert (got[3].parent_conv, got[6].parent_conv, got[2].parent_conv) == (2, 2, None) and got[3].n_linked >= 2


@pytest.mark.parametrize("query", [op3_host_suffix_array, op4_quotation_links, op5_index_merge])
def test_empty_tables(spark, empty, query):
    assert query(spark, empty).count() == 0
