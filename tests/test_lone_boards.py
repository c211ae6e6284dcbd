from tallyforge.operators import hierarchy
from tallyforge.plans.record_queries import p3_paths

SCHEMA = "scope string, child string, parent string, id int, root string"


def test_lone_nodes_have_paths(spark):
    links = spark.createDataFrame([("s", "b", "a", 0, "")], SCHEMA)
    lone = spark.createDataFrame([("s", "z"), ("s", "z"), ("s", "b"), ("t", "a"), (None, "n"), ("s", None)], "scope string, key string")
    got = sorted((r.scope, r.node, r.root, r.depth, r.path, r.n_below, r.on_circle) for r in hierarchy.forest(links, lone=lone).paths().collect())
    assert got == [
        ("", "n", "n", 0, "n", 0, False), ("s", "a", "a", 0, "a", 1, False), ("s", "b", "a", 1, "a > b", 0, False), ("s", "z", "z", 0, "z", 0, False), ("t", "a", "a", 0, "a", 0, False),
    ]


def test_paths_of_a_board_without_links(spark, tmp_path):
    boards = [("P", "DB-1", "MSB-1"), ("Q", "DB-7", " "), ("Q", "DB-7", None), ("R", None, None), ("R", "TBC", None)]
    spark.createDataFrame(boards, "project_id string, ref string, fed_from_ref string").write.parquet(f"{tmp_path}/boards.parquet")
    spark.createDataFrame([], "project_id string, to_ref string, from_ref string").write.parquet(f"{tmp_path}/feeds.parquet")
    got = sorted((r.project_id, r.board, r.root, r.depth) for r in p3_paths(spark, str(tmp_path)).collect())
    assert got == [("P", "DB1", "MSB1", 1), ("P", "MSB1", "MSB1", 0), ("Q", "DB7", "DB7", 0)]
