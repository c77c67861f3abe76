import re

import corpus_pipeline
from pagemill.llm.quality import RULES, Features, first_rejection
from pagemill.llm.secret_scan import redacted
from pagemill.llm.shared import table, written

from .conftest import clashing
from .test_documents import brute_hits


def brute_near_groups(texts):
    """Label of each text: the least that it reaches by Jaccard similarities of 0.8 of five-word shingles."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a and 10 * len(a & sets[j]) >= 8 * len(a | sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_stages_on_a_table_against_brute_force(spark):
    """Near copies and the kept rows of each stage, on all documents of the smallest table, with clashing columns."""
    folder = "/root/testdata/sf0.001"
    docs = clashing(table(spark, folder, "documents"))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    good = corpus_pipeline.quality_rules(spark, docs, folder)
    kept = [r for r in rows if first_rejection(Features(r.text), RULES) is None]
    assert sorted(r.doc_id for r in good.collect()) == [r.doc_id for r in kept]
    near = corpus_pipeline.near_dedup(spark, written(good, "good"), folder)
    label = brute_near_groups([r.text for r in kept])
    stay = [r.doc_id for i, r in enumerate(kept) if label[i] == i]
    assert sorted(r.doc_id for r in near.collect()) == stay and len(stay) < len(kept)
    clean = corpus_pipeline.decontamination(spark, written(near, "near"), folder)
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    texts = {r.doc_id: r.text for r in rows}
    assert sorted(r.doc_id for r in clean.collect()) == [d for d in stay if not brute_hits(texts[d], items)[-1]]
    safe = corpus_pipeline.secret_scan(spark, written(clean, "clean"), folder)
    assert {r.doc_id: (r.text, r.n_chars) for r in safe.collect()} == {r.doc_id: (redacted(r.text), len(redacted(r.text) or "")) for r in clean.collect()}
    assert good.columns == near.columns == clean.columns == safe.columns == docs.columns


def test_stages_keep_columns_and_decide(spark, documents, empty):
    folder, rows, _ = documents
    docs = table(spark, folder, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] == sum(first_rejection(Features(t), RULES) is None for _, t, *_ in rows)
    assert counts[0] > counts[1] > counts[2] == counts[3]
    left = {r.doc_id for r in docs.collect()}
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert corpus_pipeline.run(spark, empty).count() == 0
