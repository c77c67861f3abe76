"""The stream audits each document once, and a batch that fails leaves nothing that counts."""

import os

import pytest

from pagemill.streaming import inbox

from .docx_fixtures import docx, p, section


def run(spark, base):
    q = inbox.watch(spark, f"{base}/in", f"{base}/state", f"{base}/out")
    q.awaitTermination(600)
    return q


def test_documents_are_audited_once_and_failed_batches_run_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    one, two = docx(p("有  两个 空格") + section(w=10000)), docx(p("two") + section())
    (tmp_path / "in" / "a.docx").write_bytes(one)
    (tmp_path / "in" / "broken.docx").write_bytes(b"nothing")
    run(spark, tmp_path)
    first = {r.rule_id: r.status for r in inbox.results(spark, f"{tmp_path}/out", "rule_results").collect()}
    assert len(first) == 76 and first["PAGE-001"] == "ERROR"
    assert [r.path.rsplit("/", 1)[1] for r in inbox.results(spark, f"{tmp_path}/out", "quarantine").collect()] == ["broken.docx"]

    # The second batch has a known document under another name and a new one. It fails once its findings are written.
    (tmp_path / "in" / "again.docx").write_bytes(one)
    (tmp_path / "in" / "b.docx").write_bytes(two)
    folders = []
    own = inbox.scratch
    monkeypatch.setattr(inbox, "scratch", lambda *a: folders.append(own(*a)) or folders[-1])
    with monkeypatch.context() as m:
        m.setattr(inbox, "audit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path)
    assert inbox.results(spark, f"{tmp_path}/out", "findings").select("batch").distinct().count() == 1
    # What a half-done batch left is written over, not added to.
    inbox.results(spark, f"{tmp_path}/out", "rule_results").drop("batch").write.parquet(f"{tmp_path}/out/rule_results/batch=1")
    run(spark, tmp_path)
    rows = inbox.results(spark, f"{tmp_path}/out", "rule_results")
    assert sorted(r["count"] for r in rows.groupBy("doc_id", "batch").count().collect()) == [76, 76]
    assert {(r.path.rsplit("/", 1)[1], r.batch) for r in inbox.seen(spark, f"{tmp_path}/out").collect()} == {("a.docx", 0), ("broken.docx", 0), ("again.docx", 1), ("b.docx", 1)}
    assert folders and not any(os.path.exists(f.removeprefix("file://")) for f in folders)
