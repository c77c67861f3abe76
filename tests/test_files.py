"""Files by name, all of a job or none; rule files."""

import os

import pytest
from pyspark.sql import functions as F

from pagemill.plans.config import rules_of
from pagemill.plans.rules import FOUNDATION, SEVERITY, check_rules
from pagemill.sinks.files import write_files


def files_of(spark, folder, n):
    return spark.range(n).repartition(4).select(F.format_string(f"{folder}/%s/%s.txt", (F.col("id") % 3).cast("string"), F.col("id").cast("string")).alias("target"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))


def found(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.endswith(".crc"))


def test_all_files_are_written_and_nothing_else(spark, tmp_path):
    none = spark.createDataFrame([], "path string")
    assert write_files(files_of(spark, tmp_path, 50), none) == 50
    assert found(tmp_path) == sorted(f"{i % 3}/{i}.txt" for i in range(50))
    assert (tmp_path / "1" / "7.txt").read_bytes() == b"7"
    assert write_files(files_of(spark, tmp_path, 50), none) == 50  # again, over the old ones
    assert len(found(tmp_path)) == 50 and not [d for d in os.listdir(tmp_path) if d.startswith(".")]


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    (tmp_path / "0").mkdir()
    (tmp_path / "0" / "0.txt").write_bytes(b"old")
    rows = files_of(spark, tmp_path, 50)
    # The last row of the last task can't be made; all others are written by then or not at all.
    bad = rows.withColumn("content", F.when(F.col("target").endswith("/49.txt"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        write_files(bad, spark.createDataFrame([], "path string"))
    assert found(tmp_path) == ["0/0.txt"] and (tmp_path / "0" / "0.txt").read_bytes() == b"old"
    assert not [d for d in os.listdir(tmp_path) if d.startswith(".")]


def test_a_worker_that_is_killed_leaves_no_file(spark, tmp_path):
    @F.udf("binary")
    def dying(target):
        if target.endswith("/33.txt"):
            os._exit(9)
        return b"x"

    rows = files_of(spark, tmp_path, 50)
    with pytest.raises(Exception, match="(?i)crash|exit|EOF|abort|fail"):
        write_files(rows.withColumn("content", dying("target")), spark.createDataFrame([], "path string"))
    assert found(tmp_path) == []


def test_rules_of_a_configuration(spark):
    own = [{"rule_id": "FONT-001", "severity": "WARNING", "expected_value": {"size": 12, "a": [1]}, "source_zh": "规范", "source": "x", "category": ""}, {"rule_id": "NEW-1", "severity": "ERROR", "expected_value": 3}]
    rows = {r.rule_id: r for r in rules_of(spark, {"rules": own}).collect()}
    assert (rows["FONT-001"].severity, rows["FONT-001"].source, rows["FONT-001"].category, rows["FONT-001"].engine, rows["FONT-001"].ordinal) == ("WARNING", "规范", "FONT", "foundation", 0)
    assert rows["FONT-001"].expected == '{"a":[1],"size":12}' and rows["FONT-001"].object_type
    assert (rows["NEW-1"].expected, rows["NEW-1"].category, rows["NEW-1"].engine, rows["NEW-1"].source) == ("3", "NEW", "advanced", "built-in rules")


def test_catalogues_are_checked(spark):
    make = lambda rows: spark.createDataFrame(rows, "rule_id string, severity string")
    full = list(SEVERITY.items())
    check_rules(make(full))
    check_rules(make(full[: len(FOUNDATION)]), needed=FOUNDATION)
    for bad, said in ((full[1:], "missing: PAGE-001"), (full + full[:1], "repeated: PAGE-001"), (full + [(" ", "ERROR")], "without a rule_id"), ([("PAGE-001", "x"), *full[1:]], "severity: PAGE-001")):
        with pytest.raises(ValueError, match=said):
            check_rules(make(bad))
