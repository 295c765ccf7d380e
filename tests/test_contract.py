import importlib
import json
import math
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sample_application batch raw_application imports_application application_source class_list country_list eval_item mix_target".split()


def plain(df):
    df = df[sorted(df.columns)]

    def v(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 9) if isinstance(x, float) else bool(x) if type(x).__name__ in ("bool", "bool_") else int(x) if type(x).__name__.startswith(("int", "uint")) else x

    return sorted((tuple(v(x) for x in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, duck, data, name):
    assert plain(entry.queries()[name](spark, data).toPandas()) == plain(duck.execute(entry.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["row_id", "file_name", "overall_result"]


def test_drift_queries_agree_with_the_files(spark, data):
    """Changes are the reported ones, and every record of every file that counts is in the table."""
    from proofmark.operators import drift

    q = entry.queries()
    found = sorted(map(tuple, q["p6_found"](spark, data).collect()))
    kinds = set(drift.CHANGES.values())
    assert found == sorted((r["file_id"], r["change_kind"], r["field"]) for r in q["p6_changes"](spark, data).collect() if r["change_kind"] in kinds) and found
    files = spark.read.parquet(f"{data}/imports_application.parquet").collect()
    first = {}
    for f in sorted(files, key=lambda f: -f["file_id"]):
        first[f["feed"], f["file_no"]] = f
    read = {f["file_id"]: drift.read_file(f["content"], f["file_format"])[0] for f in first.values()}
    table = q["p6_table"](spark, data).collect()
    assert sorted((r["file_id"], r["record_no"]) for r in table) == sorted((k, i + 1) for k, records in read.items() for i in range(len(records)))
    values = lambda r: {v for v in (r["brand_name"], r["class_type"], r["name_address"]) if v}
    for r in table:  # values of text columns stand in their record
        record = json.dumps(read[r["file_id"]][r["record_no"] - 1], ensure_ascii=False)
        assert all(json.dumps(v, ensure_ascii=False)[1:-1] in record or ", " in v for v in values(r))


def test_similarity_scores_every_application(spark, data):
    names = lambda t: spark.read.parquet(f"{data}/{t}.parquet").where("file_name is not null").select("file_name")
    assert entry.queries()["similarity"](spark, data).count() == names("sample_application").join(names("batch"), "file_name").count()


def test_core_without_training_text(monkeypatch):
    """The rest imports and keeps its queries when the subpackage is gone."""
    gone = {m: None for m in list(sys.modules) if m.startswith("proofmark.llm")} | {"proofmark.llm": None, "proofmark.llm.queries": None}
    for m, v in gone.items():
        monkeypatch.setitem(sys.modules, m, v)
    import proofmark

    monkeypatch.delattr(proofmark, "llm", raising=False)
    alone = importlib.reload(entry)
    try:
        names = set(alone.queries())
        assert "p3_found" in names and not any(n.startswith(("p1_", "p2_", "p4_", "p7_", "p8_", "p9_", "p10_")) for n in names)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_stream(spark, data, tmp_path):
    from proofmark.streaming import drop

    texts = spark.read.parquet(f"{data}/batch.parquet").select("row_id", "file_name", "detected_text", "processing_time_s")
    texts.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(f"{data}/sample_application.parquet")
    stream = drop.check_stream(drop.text_stream(spark, str(tmp_path / "in"), texts.schema, 1), rows)
    drop.start(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == drop.check_stream(texts, rows).count() > 0


def test_sinks(spark, data, tmp_path):
    from proofmark import sinks

    q = entry.queries()
    sinks.write_batch_results(q["batch_results"](spark, data), str(tmp_path / "b"), 1)
    sinks.write_check_results(sinks.with_status(q["core_checks"](spark, data)), str(tmp_path / "c"), 1)
    back = spark.read.csv(str(tmp_path / "b"), header=True, multiLine=True, escape='"')
    assert back.columns[0] == "File Name" and "OCR Text Preview" in back.columns and back.count() == 300
