import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """A tables folder with awkward documents: nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    import random

    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mé", "tu", "ri", "sö") for b in ("n", "rt", "sha", "vel", "ß", "x1", "que")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = [prose(rng.randint(1, 120)) for _ in range(60)]
    item = prose(25)
    texts = [None, "", " \n\t", "one", "日本語 テキスト é", "a" * 5000, prose(30_000), *base]
    texts += [base[20], base[20], base[21] + " tail", f"{base[22]} {item} end", f"x {' '.join(item.split()[3:17]).upper()}.", "it's 12 DON'T  stop\r\n\x0b end <|endoftext|>"]
    texts += ["\n".join(["same line here"] * 9 + ["other"]), " ".join(["echo this back now"] * 20), "#$%& " * 40 + prose(30), 'token = "abcdef0123456789" AKIA' + "A1" * 10 + " " + "0f" * 13]
    texts += [t + "\n" + f"end {i}" for i, t in enumerate([prose(60)] * 3)]
    rows = [(i * 7 % 101, t, "en", None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no name here", "en", "hot", 12)]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "echo this"), (None, "unnamed item of five words"), (5, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, schema in (("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), rows, [(1, item), (2, None), (3, "echo this"), (None, "unnamed item of five words"), (5, item)]


#: Names that operators use for columns of their own, or did.
CLASHES = "row row_key total position shard slot fp digest root band node _h _b h b f p src told key at list hits n_hit host part kinds texts lines level stream value long up rejected_by base spans ids seg body".split()


def clashing(df):
    """``df`` with extra columns that have the names of operators' own, and values that must come back."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES if c not in df.columns})


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in (
        ("documents", DOCS), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string"),
        ("embeddings", "vec_id long, embedding array<float>, label int"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def same():
    def check(df, columns, expected):
        got = rows_of(df.select(*columns))
        assert got == sorted(map(tuple, expected), key=repr)

    return check


