import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm.packing import CAPACITY, HarmonicBins, cuts, op2_harmonic_packing, pack
from pagemill.llm.planes import join_planes, op1_bit_planes, pack_segment, read_planes, split_planes, unpack_segment, write_planes
from pagemill.llm.tokens import BYTE_MODEL, WORD_MODEL, encoder

from .conftest import clashing

LIBRARY = {}


def by_library(name, text):
    if name not in LIBRARY:
        LIBRARY[name] = Tokenizer.from_file(public_tokenizers.path(name))
        LIBRARY[name].encode_special_tokens = True
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [WORD_MODEL, BYTE_MODEL])
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcXYZ'st012 \n\t\r.,!<|>_éÉßñ日 ́\x85"), max_size=60) | st.text(max_size=40))
def test_ids_are_the_librarys(name, text):
    assert np.frombuffer(encoder(name)(text), "<u4").tolist() == by_library(name, text)


@pytest.mark.parametrize("name", [WORD_MODEL, BYTE_MODEL])
@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "a", " b", "É ", "\n", "it's 12"]), max_size=8).map("".join))
def test_special_tokens_as_text_and_as_tokens(name, text):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    assert np.frombuffer(encoder(name, special_text=False)(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder(name)(text), "<u4").tolist() == by_library(name, text)


def test_segments_of_long_texts_keep_the_ids():
    text = "日本 word, and more é́ text 12\n" * 4000
    for name in (WORD_MODEL, BYTE_MODEL):
        assert np.frombuffer(encoder(name)(text), "<u4").tolist() == by_library(name, text)


@pytest.mark.parametrize("planes", [4, 32])
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_planes_round_trip(planes, ids):
    block = np.array(ids, "<u4")
    assert join_planes(split_planes(block, planes), len(ids)).tolist() == ids


@pytest.mark.parametrize("planes", [4, 32])
def test_segment_round_trip(planes):
    docs = [(None, 3), (-5, 0), (2**40, 1000), (7, 1)]
    ids = [np.arange(n, dtype="<u4").tobytes() for _, n in docs]
    assert list(unpack_segment(pack_segment([d for d, _ in docs], ids, planes, block=64))) == [(d, i) for (d, _), i in zip(docs, ids, strict=True)]
    assert list(unpack_segment(pack_segment([], [], planes))) == []


def expected(rows, name):
    return [(d, np.array([*by_library(name, t), 1], "<u4")) for d, t, *_ in rows]


def test_op1(spark, documents):
    folder, rows, _ = documents
    want = expected(rows, WORD_MODEL)
    got = op1_bit_planes(spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(x), zlib.crc32(x.tobytes())) for d, x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0))


def test_op2(spark, documents):
    folder, rows, _ = documents
    want = defaultdict(list)
    for d, x in expected(rows, BYTE_MODEL):
        want[d].append(x)
    got = op2_harmonic_packing(spark, folder).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for d, texts in want.items():
        assert sum(r.length for r in pieces[d]) == sum(map(len, texts))
        for r in pieces[d]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts)
    # The pieces of all documents with one id and length are those texts' ids, each id once.
    for d, texts in want.items():
        for n in {len(x) for x in texts}:
            spans = sorted((r.start, r.length) for r in pieces[d] if r.doc_tokens == n)
            cover = np.zeros(n + 1, int)
            for a, size in spans:
                cover[a] += 1
                cover[a + size] -= 1
            assert (np.cumsum(cover)[:-1] == sum(len(x) == n for x in texts)).all()
    filled = defaultdict(int)
    for r in got:
        filled[r.sequence_id] += r.length
    padding = sum(CAPACITY - n for n in filled.values() if n & (n - 1))
    assert padding <= sum(filled.values()) / 20
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= CAPACITY


@given(st.integers(1, 9000))
def test_cuts_waste_little(n):
    made = cuts(n)
    assert sum(made) == n
    assert all(CAPACITY - CAPACITY // m * m <= CAPACITY / 64 for m in made if m > 64)


@given(st.lists(st.integers(1, CAPACITY), max_size=60))
def test_a_workers_last_bins_need_no_padding(lengths):
    bins, made = HarmonicBins(), []
    for i, n in enumerate(lengths):
        made += [b] if (b := bins.add((i, 0, n, n, bytes(4 * n)))) else []
    rest = list(bins.close())
    for b in rest:
        total = sum(p[2] for p in b)
        assert total & (total - 1) == 0
    assert sum(p[2] for b in made + rest for p in b) == sum(lengths)


def test_extra_columns_and_hot_ids(spark, documents, tmp_path):
    docs = spark.read.parquet(f"{documents[0]}/documents.parquet")
    assert sorted(map(str, pack(clashing(docs).coalesce(1)).collect())) == sorted(map(str, pack(docs.coalesce(1)).collect()))
    # One id holds all rows: they spread over partitions, and the order is still by id.
    many = clashing(docs).withColumn("doc_id", F.lit(None).cast("long")).crossJoin(spark.range(20)).withColumn("text", F.concat_ws(" ", "text", "id"))
    write_planes(many, f"file://{tmp_path}/planes")
    assert spark.read.parquet(f"file://{tmp_path}/planes").select("part").distinct().count() > 1
    back = read_planes(spark, f"file://{tmp_path}/planes").collect()
    assert len(back) == many.count() and sorted(r.start for r in back)[0] == 0
    encode = encoder(WORD_MODEL)
    assert sorted(bytes(r.ids) for r in back) == sorted(encode(r.text) + b"\1\0\0\0" for r in many.collect())


def test_empty_tables(spark, empty):
    assert op1_bit_planes(spark, empty).count() == 0
    assert op2_harmonic_packing(spark, empty).count() == 0
