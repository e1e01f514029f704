from sparkprep.operators.schema import strptime_to_spark
from sparkprep.plans.suggest import detect_target, is_id_like, suggest_plan
from sparkprep.sources import io


def test_read_csv_markers_sep_encoding(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("id;name;score;flag\n1;Café;1.5;true\n2;NA;n/a;false\n3;  x ;7;\n".encode("latin-1"))
    df = io.read_csv(spark, str(path), sep=";", encoding="latin-1", na_values=["7"])
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "flag": "boolean"}
    assert rows == [(1, "Café", 1.5, True), (2, None, None, False), (3, "  x ", None, None)]


def test_write_and_preview(spark, tmp_path):
    df = spark.createDataFrame([(3, " a "), (1, "b"), (2, None)], "k int, s string")
    out = str(tmp_path / "o")
    io.write_table(df, out, "csv")
    back = io.read_csv(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "b"), (2, None), (3, " a ")]
    assert [r["k"] for r in io.preview(df, 2, ["k"]).collect()] == [1, 2]


def test_strptime_translation():
    assert strptime_to_spark("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss"
    assert strptime_to_spark("%d/%m/%y T%H") == "dd/MM/yy 'T'HH"


def test_target_detection_and_ids():
    assert detect_target(["a", "income", "label"]) == ("income", True)
    assert detect_target(["a", "b"]) == (None, False)
    assert is_id_like("encounter_id", 10, 100) and is_id_like("patient_nbr", 10, 100)
    assert not is_id_like("width", 10, 100) and not is_id_like("valid", 10, 100)
    assert is_id_like("code", 100, 100)


def test_suggest_plan_rules(spark):
    df = spark.createDataFrame(
        [(i, f"c{i % 3}", None if i % 4 == 1 else float(i), None if i < 8 else 1.0, "<=50K" if i % 4 else ">50K") for i in range(10)],
        "encounter_id bigint, color string, x double, mostly_missing double, income string",
    )
    target, _ = detect_target(df.columns)
    plan = suggest_plan(df, target)
    acts = {a.action: a for a in plan.actions}
    assert set(acts["drop_column"].target_columns) == {"encounter_id", "mostly_missing"}
    assert acts["handle_missing"].target_columns == ["x"]
    assert acts["encode_categorical_per_column"].params["column_encodings"] == {"color": "one_hot"}
    tree = {a.action for a in suggest_plan(df, target, "tree").actions}
    assert "scale_features" not in tree and "clip_outliers" not in tree


def test_read_csv_cp1252(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("a,b\n1,caf\xe9 \x80\n".encode("latin-1"))
    rows = io.read_csv(spark, str(path), encoding="cp1252").collect()
    assert rows[0]["b"] == "café €"
