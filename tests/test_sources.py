import pytest
from pyspark.sql import functions as F

from tabprep.operators import catalog as ct
from tabprep.operators.privacy import pii_mask, pii_scan
from tabprep.operators.schema import legal_actions, logical_types, select_columns, table_meta
from tabprep.sources import tables as st


def test_csv_options(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("note\nname;n;x;ok;gap\nJosé;1;1.5;True;NA\nAna;2;;False;\n".encode("latin-1"))
    df = st.read_csv(spark, str(path), skip=1, sep=";", encoding="ISO-8859-1")
    assert df.dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("ok", "boolean"), ("gap", "string")]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [("José", 1, 1.5, True, None), ("Ana", 2, None, False, None)]
    assert st.read_csv(spark, str(path), skip=1, sep=";", encoding="ISO-8859-1", nrows=1).count() == 1
    with pytest.raises(ValueError):
        st.skiprows(spark, str(path), 50)
    plain = tmp_path / "b.csv"
    plain.write_text("1,x\n2,y\n")
    assert st.read_csv(spark, str(plain), header=False).columns == ["_c0", "_c1"]
    typed = st.read_csv(spark, str(plain), header=False, schema="_c0 double, _c1 int")
    assert [tuple(r) for r in typed.collect()] == [(1.0, None), (2.0, None)]


def test_versions_are_immutable(spark, cars, tmp_path):
    st.write_version(cars, str(tmp_path), 1, 0)
    with pytest.raises(Exception):
        st.write_version(cars, str(tmp_path), 1, 0)
    assert st.read_version(spark, str(tmp_path), 1, 0).count() == 6
    st.write_version(cars, str(tmp_path), 1, 1, as_csv=True)
    assert st.read_version(spark, str(tmp_path), 1, 1, as_csv=True).count() == 6


def test_json_rows(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert sorted(map(tuple, st.read_json_rows(spark, str(path), "a bigint, b string").collect()), key=str) == [(1, "x"), (2, None)]


def test_logical_types(spark):
    rows = [(i, i % 2, "yes" if i % 2 else "no", "true" if i % 2 else "x", f"2024-01-{i % 28 + 1:02d}", f"t{i}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, few int, cat string, flag string, day string, txt string, num double")
    kinds = {r["column"]: r["kind"] for r in logical_types(df).collect()}
    assert kinds == {"id": "int32", "few": "ordinal", "cat": "category", "flag": "bool", "day": "datetime", "txt": "str", "num": "float64"}
    empty = {r["column"]: r["kind"] for r in logical_types(df.limit(0)).collect()}
    assert empty["txt"] == "str" and empty["num"] == "float64"
    assert table_meta(df).first()["row_count"] == 60
    assert legal_actions("category") == ("encode", "removenull", "impute") and "scale" in legal_actions("float64")
    assert select_columns(df, ["txt", "id"], {"txt": "int"}).first()["txt"] is None


def test_mask(spark):
    long = "z" * 200
    df = spark.createDataFrame([(1, "ann", long), (2, "ann", None), (3, "", "b")], "id int, name string, text string")
    out = {r["id"]: r for r in pii_mask(df, ["name", "text"], "s").collect()}
    assert out[1]["name"] == out[2]["name"] and len(out[1]["name"]) == 3 and out[1]["name"] != "ann"
    assert len(out[1]["text"]) == 200 and out[2]["text"] is None and out[3]["name"] == ""
    assert pii_mask(df, ["id", "name"], "s").columns == ["text", "id", "name"]
    assert pii_mask(df, ["name"], "other").orderBy("id").first()["name"] != out[1]["name"]


def test_scan(spark):
    df = spark.createDataFrame([("a@b.org",), ("call +1 555 123 4567",), ("4111 1111 1111 1111",), ("10.0.0.1",), ("none",)], "t string")
    assert {r["pattern"]: r["matches"] for r in pii_scan(df).collect()} == {"email": 1, "phone": 1, "card": 1, "ip": 1}


def test_lineage_follows_branches(spark):
    versions = spark.createDataFrame(
        [(1, 0, -1, 10), (1, 1, 0, 11), (1, 2, 1, 12), (1, 3, 1, 13), (1, 4, 2, 14), (1, 5, 4, 15)],
        "dataset_id int, version_id int, prev_id int, job_id int",
    )
    jobs = spark.createDataFrame([(i, "preprocess" if i != 14 else "auto_ml") for i in range(10, 16)], "job_id int, job_type string")
    rows = ct.lineage(versions, jobs, dataset_id=1, version_id=5).orderBy("version_id").collect()
    assert [(r["version_id"], r["prev_id"]) for r in rows] == [(2, 1), (5, 4)]
    assert ct.lineage(versions, jobs, dataset_id=1, version_id=3).count() == 1
    assert ct.lineage(versions, jobs, dataset_id=9).count() == 0


def test_catalog_filters(spark):
    versions = spark.createDataFrame([(1, 0), (1, 2), (2, 1)], "dataset_id int, version_id int")
    datasets = spark.createDataFrame([(1,), (2,), (3,)], "dataset_id int")
    assert {tuple(r) for r in ct.latest_version(versions, datasets).collect()} == {(1, 2), (2, 1), (3, -1)}
    with pytest.raises(ValueError):
        ct.job_history(versions, versions, versions, colour="red")
    assert ct.chosen(versions, dataset_id=1001).count() == 0
    assert ct.chosen(versions, dataset_id=None).count() == 3
    assert ct.chosen(versions, dataset_id=[1, 2], version_id=1).count() == 1


def test_long_whole_numbers(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("id,big,mixed\n1234567890123456789,123456789012345678901,1\n1234567890123456788,2,1.5\n")
    df = st.read_csv(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("big", "decimal(38,0)"), ("mixed", "double")]
    assert sorted(r["id"] for r in df.collect()) == [1234567890123456788, 1234567890123456789]


def test_line_ends_inside_quotes(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,note\n1,"a\nb, ""c"""\n2,plain\n')
    assert sorted(map(tuple, st.read_csv(spark, str(path)).collect())) == [(1, 'a\nb, "c"'), (2, "plain")]
    with pytest.raises(ValueError):
        st.read_csv(spark, str(path), skip=1)


def test_empty_header_cell(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("note\na,,c\n1,2,3\n")
    assert st.read_csv(spark, str(path), skip=1).collect()[0].asDict() == {"a": 1, "_c1": 2, "c": 3}
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "1.csv").write_text("x\na,b\n1,2\n")
    (tmp_path / "two" / "2.csv").write_text("x\nb,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        st.read_csv(spark, str(tmp_path / "two"), skip=1)


def test_preview_follows_the_files(spark, tmp_path):
    (tmp_path / "1.csv").write_text("n\n1\n2\n")
    (tmp_path / "2.csv").write_text("n\n" + "".join(f"{i}\n" for i in range(3, 400)))
    assert [r["n"] for r in st.preview(spark, str(tmp_path), 5).collect()] == [1, 2, 3, 4, 5]
    assert [r["n"] for r in st.preview(spark, str(tmp_path), 1).collect()] == [1]


def test_visible_datasets_meet_one_row_per_project(spark):
    """Members of a project are not multiplied with its datasets; nulls and deleted members give no access."""
    sets = spark.range(1, 9).selectExpr("id as dataset_id", "concat('d', id) as name", "1L as user_id", "id as creation_time", "id = 8 as is_deleted", "true as completed")
    versions = spark.range(0, 16).selectExpr("id % 8 + 1 as dataset_id", "id as creation_time")
    mapped = spark.createDataFrame(
        [(1, 1, False), (2, 1, None), (3, 2, True), (4, 2, False), (5, 3, True), (6, None, True), (7, 4, True), (8, 1, True)], "dataset_id long, project_id long, public boolean"
    )
    users = spark.createDataFrame(
        [(1, 7, False), (1, 7, False), (1, 9, False), (2, None, None), (2, 8, False), (3, 7, True), (4, None, False), (None, 7, False)],
        "project_id long, user_id long, is_deleted boolean",
    )
    found = ct.visible_datasets(sets, versions, mapped, users, 7)
    assert sorted((r.dataset_id, r.last_modified) for r in found.collect()) == [(1, 8), (2, 9), (3, 10), (7, 14)]
    assert "Aggregate [project_id" in found._jdf.queryExecution().optimizedPlan().toString()
