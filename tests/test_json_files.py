import json

from scorelake.sources import json_shapes

SCHEMA = "name string, inputs struct<k:array<bigint>,p:array<string>>"


def test_payload_files_give_the_rows_back(spark, tmp_path):
    rows = [(1, 10, "a\nb", "x"), (1, 20, None, "x"), (2, 5, 'q"ö', "y"), (2, 5, 'q"ö', "y")]
    df = spark.createDataFrame(rows, "g int, k long, p string, name string")
    packed = json_shapes.rows_to_payload(df, ["k", "p"], "k", ["name"], ["g"])
    with_null = packed.select("json").union(spark.createDataFrame([(None,)], "json string"))
    path = str(tmp_path / "lines")
    json_shapes.write_payloads(with_null, path)
    json_shapes.write_payloads(with_null, path)  # a second write replaces the first
    again = json_shapes.read_payloads(spark, path)
    assert again.count() == 2
    got = json_shapes.arrays_to_rows(again, "json", SCHEMA, "inputs").select("name", "k", "p").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((n, k, p) for _, k, p, n in rows), key=str)


def test_files_laid_out_over_lines_and_empty_ones(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"name": "x", "inputs": {"k": [1, 2], "p": ["a", None]}}, indent=2))
    (tmp_path / "none.json").write_text(" \n")
    read = json_shapes.read_payloads(spark, str(tmp_path / "*.json"), whole_files=True)
    got = json_shapes.arrays_to_rows(read, "json", SCHEMA, "inputs").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("x", 0, 1, "a"), ("x", 1, 2, None)]
