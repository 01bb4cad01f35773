"""Files written and read again."""

from graphloom.sources import files


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_nodes_and_edges_in_csv(spark, tmp_path):
    nodes = spark.createDataFrame([("p_1", 'A "quoted" title, long', "x\ny"), ('p_"2"', None, ""), ('"', "z", "z")], "id string, title string, description string")
    files.write_table(nodes.coalesce(1), f"{tmp_path}/n")
    (tmp_path / "plain.csv").write_text('id,title\np_1,"one, two"\np_2,\n"say ""hi""",x\n')
    assert rows(files.read_nodes(spark, f"{tmp_path}/plain.csv", "title"), "id", "title") == [("p_1", "one, two"), ("p_2", None), ('say "hi"', "x")]
    for rel, some in (("pd", [("p_1", "d_1"), ("p_2", "d_1")]), ("pa", [("p_1", "a_1")])):
        files.write_table(spark.createDataFrame(some, "source string, target string"), f"{tmp_path}/{rel}")
    found = files.read_edge_folder(spark, {rel: f"{tmp_path}/{rel}" for rel in ("pd", "pa")})
    assert rows(found, "source", "target", "rel") == [("p_1", "a_1", "pa"), ("p_1", "d_1", "pd"), ("p_2", "d_1", "pd")]
    files.write_table(found, f"{tmp_path}/all", "parquet")
    assert spark.read.parquet(f"{tmp_path}/all").count() == 3


def test_json_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + b'[{"id": 1, "in": {"x": "a", "deep": {"y": 2}}}, {"id": 2, "in": null}]')
    found = files.read_json_records(spark, f"{tmp_path}/a.json")
    assert found.columns == ["id", "in.deep.y", "in.x"]
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 2, "a"), (2, None, None)]
    (tmp_path / "m.json").write_bytes(b"\xef\xbb\xbf" + b'{"p_1": "9", "p_2": null}')
    assert rows(files.read_json_object(spark, f"{tmp_path}/m.json"), "key", "value") == [("p_1", "9"), ("p_2", None)]


def test_walks_vectors_and_maps(spark, tmp_path):
    walks = spark.createDataFrame([("p_1", ["p_1", "d_1", "p_2"]), ("p_3", ["p_3"])], "seed string, path array<string>")
    files.write_walks(walks, f"{tmp_path}/w")
    assert rows(files.read_walks(spark, f"{tmp_path}/w"), "seed", "path") == rows(walks, "seed", "path")
    (tmp_path / "v.txt").write_text("2 3\np_1 0.5 -1 2\nd_1 1e-3 0 4\n")
    vectors = files.read_vectors(spark, f"{tmp_path}/v.txt")
    assert {r.id: [round(v, 4) for v in r.x] for r in vectors.collect()} == {"p_1": [0.5, -1, 2], "d_1": [0.001, 0, 4]}
    (tmp_path / "one.txt").write_text("2 1\np_1 0.5\nd_1 2\n")
    assert {r.id: r.x for r in files.read_vectors(spark, f"{tmp_path}/one.txt").collect()} == {"p_1": [0.5], "d_1": [2.0]}
    files.write_vectors(vectors, f"{tmp_path}/v")
    assert rows(files.read_vector_table(spark, f"{tmp_path}/v"), "id", "x") == rows(vectors, "id", "x")
    files.write_json_map(walks, "seed", "path", f"{tmp_path}/m")
    assert rows(files.read_json_map(spark, f"{tmp_path}/m", "array<string>"), "key", "value") == rows(walks, "seed", "path")
