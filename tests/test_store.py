"""CSV loading, workflows, the result store, and the path from upload to report."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescope.operators.association import associations, target_quality_rank
from tablescope.operators.target import infer_problem_type, target_candidates
from tablescope.plans import analysis, insights
from tablescope.sources import csv, export, results, workspace

CSV = """a, b ,c
1,2.5, x
2,3
3,4,y,extra
bad,5,z
4.6,6,
,7,"q,r"
"""


def records_of(spark, folder, content, name="t.csv", chunk=None):
    """Records of a file cut into ranges of ``chunk`` bytes, beside those of the reader that takes a file in one task."""
    path = folder / name
    path.write_bytes(content.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, str(chunk or 1 << 27))
    try:
        texts, unclosed = csv.read_texts(spark, str(path), multiline=True)
        tasks = spark.read.text(str(path)).rdd.getNumPartitions()
        rows = [tuple(r) for r in texts.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = spark.read.schema(texts.schema).csv(
        str(path), header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows, [tuple(r) for r in whole.collect()], unclosed, tasks


@pytest.mark.parametrize("chunk", [7, 40, 333, 1 << 27])
def test_quoted_line_breaks_over_ranges(spark, tmp_path, chunk):
    cells = ['plain', '"a, b"', '"two\nlines"', '"three\n\n""quoted"", lines"', '', '"x\n' + "y\n" * 30 + 'z"', ' "spaces" ', '5" pipe', '""', '"x ""q""\n,y"', '"a""\n"""']
    lines = ["id,first,second"] + [f"{i},{cells[i % 11]},{cells[(i * 7 + i // 11) % 11]}" for i in range(120)]
    rows, whole, unclosed, tasks = records_of(spark, tmp_path, "\n".join(lines) + "\n", chunk=chunk)
    assert sorted(rows, key=repr) == sorted(whole, key=repr) and len(rows) == 120 and unclosed == 0
    assert tasks > 10 or chunk > 300


@pytest.mark.parametrize("chunk", [9, 60, 1 << 27])
def test_unclosed_quote_is_one_rejected_row(spark, tmp_path, chunk):
    content = 'a,b\n1,x\n2,"y\ny"\n3,"never\n4,closed\n' + "5,z\n" * 50
    rows, _, unclosed, _ = records_of(spark, tmp_path, content, chunk=chunk)
    assert sorted(rows) == [("1", "x"), ("2", "y\ny")] and unclosed == 1
    report = csv.csv_ingest(spark, str(tmp_path / "t.csv"), f"unclosed_{chunk}")
    assert (report["rows_read"], report["rows_loaded"], report["rows_rejected"], report["unclosed_quotes"]) == (3, 2, 1, 1)


def test_header_over_ranges_and_several_files(spark, tmp_path):
    rows, whole, _, _ = records_of(spark, tmp_path, '"a\n' + "a" * 50 + '",b\n1,"x\n"\n\n2,y', chunk=8)
    assert sorted(rows) == sorted(whole) == [("1", "x\n"), ("2", "y")]
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(f'a,b\n{i},"u\nv"\n')
    texts = csv.read_text_columns(spark, [str(tmp_path / f"f{i}.csv") for i in range(3)], multiline=True)
    assert sorted(map(tuple, texts.collect())) == [(str(i), "u\nv") for i in range(3)]


def test_tolerant_csv(spark, tmp_path):
    path = tmp_path / "my-data file.csv"
    path.write_text(CSV)
    schema = T.StructType.fromDDL("a bigint, b double, c string")
    report = csv.csv_ingest(spark, str(path), "tolerant", schema)
    assert (report["rows_read"], report["rows_loaded"], report["rows_rejected"]) == (6, 5, 1)
    assert report["rejected_cells"] == {"a": 1, "b": 0, "c": 0}
    rows = [tuple(r) for r in spark.table("tolerant").orderBy("b").collect()]
    assert rows == [(1, 2.5, "x"), (2, 3.0, None), (3, 4.0, "y"), (5, 6.0, None), (None, 7.0, "q,r")]
    assert csv.normalize_table_name(str(path)) == "my_data_file"


def test_schema_inference(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,f,g,b,d,e\n1,1,1.5,True,2024-01-01,\n2,,2,False,x,\n")
    schema = csv.infer_csv_schema(spark, str(path))
    assert [f.dataType.simpleString() for f in schema] == ["bigint", "double", "double", "boolean", "string", "double"]


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('k,text\n1,"one\ntwo"\n2,"a ""quoted"" word"\n3,plain\n')
    report = csv.csv_ingest(spark, str(path), "broken_lines")
    assert report["multiline"] and (report["rows_read"], report["rows_rejected"]) == (3, 0)
    rows = [tuple(r) for r in spark.table("broken_lines").orderBy("k").collect()]
    assert rows == [(1, "one\ntwo"), (2, 'a "quoted" word'), (3, "plain")]


def test_types_are_voted_by_all_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a\n" + "1\n" * 9 + "x\n")
    assert csv.infer_csv_schema(spark, str(path)).simpleString() == "struct<a:string>"
    assert csv.infer_csv_schema(spark, str(path), rows=5).simpleString() == "struct<a:bigint>"
    assert csv.csv_ingest(spark, str(path), "voted")["rows_rejected"] == 0


def test_headers_that_collide(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,A\n1,2\n")
    with pytest.raises(ValueError, match="differ only"):
        csv.read_text_columns(spark, str(path))


def test_workflow_life(spark):
    workflow = workspace.create_workflow(spark, "1a-2b")
    assert workflow == "1a_2b" and workflow in workspace.list_workflows(spark)
    namespace = workspace.workflow_namespace(workflow)
    assert workspace.find_data_table(spark, namespace) is None
    spark.range(3).write.saveAsTable(f"{namespace}.data")
    assert workspace.find_data_table(spark, namespace) == "data"
    assert workspace.table_exists(spark, namespace, "data")[0]
    assert not workspace.table_exists(spark, namespace, "nothing")[0]
    before = spark.catalog.currentDatabase()
    assert workspace.workflow_sql(spark, namespace, "SELECT count(*) AS n FROM data").first()["n"] == 3
    assert spark.catalog.currentDatabase() == before
    assert sorted(r.id for r in workspace.fetch(spark, namespace, "data").collect()) == [0, 1, 2]
    assert results.drop_result_tables(spark, namespace) == []
    assert results.drop_result_tables(spark, namespace, confirm=True)
    workspace.delete_workflow(spark, workflow)
    assert workflow not in workspace.list_workflows(spark)


def test_metadata_upsert(spark):
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    results.put_metadata(spark, namespace, "k", F.struct(F.lit(1).alias("v")))
    results.put_metadata(spark, namespace, "k", F.struct(F.lit(2).alias("v")))
    results.put_metadata(spark, namespace, "other", F.struct(F.lit(3).alias("v")))
    rows = {r["key"]: r["value"] for r in spark.table(f"{namespace}.workflow_metadata").collect()}
    assert rows == {"k": '{"v":2}', "other": '{"v":3}'}


def test_candidates_by_position(spark):
    rows = [(i, i % 2, float(i), "x", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, flag int, price double, name string, same int")
    got = [(r["column_name"], r["rank"], r["importance_score"], r["problem_type"]) for r in target_candidates(df).orderBy("rank").collect()]
    assert got == [("price", 3, 85, "regression"), ("flag", 4, 80, "binary classification"), ("id", 5, 75, "regression")]
    kinds = {r["column_name"]: r["problem_type"] for r in infer_problem_type(df).collect()}
    assert kinds["flag"] == "binary_classification" and kinds["id"] == "regression"
    assert target_candidates(df.select("name")).isEmpty()


def test_association_strength(spark):
    df = spark.range(1000).select(
        (F.col("id") % 4).alias("a"), ((F.col("id") % 4) * 2).alias("copy"), (F.col("id") % 5).alias("free"), F.lit(1).alias("same")
    )
    got = {(r["column_name"], r["partner"]): r["association"] for r in associations(df).collect()}
    assert got["a", "copy"] == 1.0 and got["copy", "a"] == 1.0
    assert got["a", "free"] < 0.01 and got["a", "same"] == 0.0
    ranked = {r["column_name"]: r for r in target_quality_rank(df).collect()}
    assert ranked["a"]["leakage"] == ["copy"] and "same" not in ranked


def test_recommendation_rules(spark):
    ddl = (
        "analysis_id string, model_type string, test_accuracy double, train_accuracy double, tree_depth int, "
        "missing_values_handled int, original_rows int, dropped_columns int, original_features int"
    )
    rows = [
        ("1", "logistic_regression", 0.6, 0.8, None, 20, 100, 4, 10),
        ("2", "decision_tree", 0.8, 0.85, 25, 0, 100, 0, 10),
        ("3", "gradient_boosting", 0.75, 0.95, None, 0, 100, 0, 10),
        ("4", "gradient_boosting", 0.96, 0.97, None, 0, 100, 0, 10),
        ("5", "logistic_regression", 0.96, 0.97, None, 0, 100, 0, 10),
    ]
    got = {}
    for r in insights.model_recommendations(spark.createDataFrame(rows, ddl)).orderBy("analysis_id", "position").collect():
        got.setdefault(r["analysis_id"], []).append(r["code"])
        assert r["recommendation"]
    assert got == {
        "1": ["low_accuracy", "overfitting", "many_missing", "many_dropped"],
        "2": ["deep_tree"],
        "3": ["overfitting", "severe_overfitting"],
        "4": ["excellent"],
        "5": ["good"],
    }


def test_upload_train_report(spark, tmp_path):
    path = tmp_path / "people-list.csv"
    lines = ["row,age,city,bought"]
    lines += [f"{i},{i % 60},{'ABC'[i % 3]},{'yes' if i % 60 > 30 else 'no'}" for i in range(400)]
    path.write_text("\n".join(lines))
    loaded = analysis.upload(spark, str(path))
    assert loaded["table_name"] == "people_list" and loaded["load"]["rows_loaded"] == 400
    assert loaded["targets"].count() >= 1
    workflow = loaded["workflow_id"]
    small = {"gradient_boosting": {"n_estimators": 2, "max_depth": 2}}
    runs = analysis.train_all(spark, workflow, "people_list", "bought", ["row"], small)
    assert {r["model_type"] for r in runs.collect()} == set(insights.MODEL_ORDER)
    namespace = workspace.workflow_namespace(workflow)
    summary = spark.table(f"{namespace}.workflow_eda_summary").first()
    assert (summary["target_column"], summary["problem_type"]) == ("bought", "binary_classification")
    report = json.loads(analysis.report(spark, workflow, "people_list").first()["report"])
    assert set(report) == {"dataset", "preprocessing", "performance", "explainability", "conclusion"}
    assert len(report["performance"]["metrics"]) == 3 and len(report["dataset"]["column_summary"]) == 4
    assert report["conclusion"]["findings"][0]["code"] == "best_model"
    path = str(tmp_path / "out")
    stats = spark.table(f"{namespace}.workflow_eda_column_stats")
    export.export_results(spark.table(f"{namespace}.workflow_eda_summary"), stats, path)
    exported = spark.read.json(path).first()
    assert len(exported["column_statistics"]) == 4
    with pytest.raises(ValueError, match="unsupported"):
        export.export_results(stats, stats, path, "xml")


def summaries(spark, *rows):
    return spark.createDataFrame([(a, t, n) for a, t, n in rows], "analysis_id string, table_name string, total_rows bigint")


def test_interleaved_writers_lose_nothing(spark):
    """Two writers begin, write and publish across each other; a pinned reader sees neither, a later one both."""
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    table = f"{namespace}.workflow_eda_summary"
    results.append_results(summaries(spark, ("a", "t", 1)), namespace, "workflow_eda_summary")
    pinned = results.committed(spark, namespace)
    first, second = results.new_commit(), results.new_commit()
    results.write_change(summaries(spark, ("b", "t", 2)), namespace, "workflow_eda_summary", first)
    results.write_change(summaries(spark, ("c", "t", 3)), namespace, "workflow_eda_summary", second)
    assert [r.analysis_id for r in spark.table(table).collect()] == ["a"]
    results.publish(spark, namespace, second)
    assert sorted(r.analysis_id for r in spark.table(table).collect()) == ["a", "c"]
    results.delete_analysis(spark, namespace, "a")
    results.publish(spark, namespace, first)
    assert sorted(r.analysis_id for r in spark.table(table).collect()) == ["b", "c"]
    old = results.results_at(spark, namespace, "workflow_eda_summary", pinned)
    assert [tuple(r)[:2] for r in old.collect()] == [("a", "t")] and old.columns == spark.table(table).columns
    results.append_results(summaries(spark, ("a", "t", 9)), namespace, "workflow_eda_summary")
    assert {r.analysis_id: r.total_rows for r in spark.table(table).collect()} == {"a": 9, "b": 2, "c": 3}


def test_a_choice_holds_for_the_analyses_so_far(spark):
    namespace = workspace.workflow_namespace(workspace.create_workflow(spark))
    results.append_results(summaries(spark, ("a", "t", 1), ("b", "other", 1)), namespace, "workflow_eda_summary")
    results.select_target(spark, namespace, "t", "x", "regression")
    results.select_target(spark, namespace, "t", "y", "binary_classification", 7)
    results.append_results(summaries(spark, ("c", "t", 1)), namespace, "workflow_eda_summary")
    rows = {r.analysis_id: (r.target_column, r.problem_type) for r in spark.table(f"{namespace}.workflow_eda_summary").collect()}
    assert rows == {"a": ("y", "binary_classification"), "b": (None, None), "c": (None, None)}
    kept = spark.table(f"{namespace}.workflow_metadata").collect()
    assert [(r.key, json.loads(r.value)["variable"]) for r in kept] == [("target_variable", "y")]
    assert workspace.find_data_table(spark, namespace) is None


def test_only_quoted_lines_are_looked_at_one_by_one():
    import pyarrow as pa

    from tablescope.sources import csv_records

    lines = ["h,i", "a,b", "", 'c,"d', "e", 'f",g', "k,l"]
    rows = pa.RecordBatch.from_pydict({"value": lines, "file": ["f"] * 7, "start": [0] * 7})

    class Known:
        value = {("f", 0): csv_records.Range(False, False, False)}

    assert csv_records._quoted(rows.column(0)) == [3, 5]
    for size in (1, 2, 7):
        batches = (rows.slice(i, size) for i in range(0, 7, size))
        found = [r["record"] for b in csv_records._pieces(Known, True)(batches) for r in b.to_pylist()]
        assert found == ["a,b", 'c,"d\ne\nf",g', "k,l"]


def test_a_record_is_parsed_once(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c\n1,2,"x\ny"\n1,bad,z\n')
    schema = T.StructType.fromDDL("a bigint, b double, c string")
    texts = csv.read_text_columns(spark, str(tmp_path / "t.csv"), multiline=True)
    loaded = csv.tolerant_cast(texts, schema)
    assert [tuple(r) for r in loaded.collect()] == [(1, 2.0, "x\ny")]
    assert csv.load_report(texts, schema).first()["rows_rejected"] == 1
    assert loaded._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1


def test_only_lines_with_a_quote_tell_how_ranges_begin(spark, tmp_path):
    from tablescope.sources import csv_records

    ranges = {("f", 10): (False, False, False), ("f", 30): (True, False, False), ("g", 0): (False, True, False)}
    starts = {"f": [10, 30], "g": [0]}
    begins = lambda file, start: tuple(csv_records._begins(ranges, starts, file, start))
    assert [begins("f", s)[0] for s in (0, 10, 20, 30, 40)] == [False, False, True, True, False]
    assert begins("g", 0) == (False, True, False) and begins("g", 5) == (True, False, True) and begins("h", 0) == (False, False, False)
    (tmp_path / "t.csv").write_text("a,b\n" + "1,2\n" * 50)
    assert csv_records.ranges_of(spark, str(tmp_path / "t.csv")) == ({}, 0)
    assert csv.read_text_columns(spark, str(tmp_path / "t.csv"), multiline=True).count() == 50
