import os

import duckdb
import pytest

from quirefold.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql())))
def test_query_equals_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_requests_end_to_end(spark, tmp_path):
    import json

    from quirefold.plans.request import respond
    from quirefold.streaming import pages

    text = "the quick brown fox jumps over the lazy dog and runs away from all of them"
    words = [{"text": w, "bounds": {"left": 0.05 + 0.09 * (k % 10), "top": 0.05 + 0.03 * (k // 10), "width": 0.08, "height": 0.02}, "normalized_conf": 1.0} for k, w in enumerate(text.split())]
    rows = [(1, "blocks", [text], json.dumps(words), 1000, 1000), (2, "nothing", ["x"], "{}", 10, 10), (3, "blocks", [], "[]", 10, 10), (4, "apple", ["x"], "{broken", 10, 10), (5, "blocks", ["x"], json.dumps([{"text": "x", "bounds": {"left": 2}}]), 10, 10), (6, "tesseract", ["x"], '{"words": []}', 10, 10)]
    df = spark.createDataFrame(rows, pages.REQUESTS)
    got = {r["page_id"]: r for r in respond(df).collect()}
    assert got[1]["document"]["text"] == text and got[1]["stats"]["lines_found"] == 1
    assert [got[k]["problem"] for k in range(1, 7)] == [None, "engine", "lines", "input_json", "input_json", "input_json"]
    assert {"canonical_lines", "input_blocks", "lines_found", "lines_unhandled", "lines_split", "lines_reconciled", "line_repairs", "holes_bridged", "holes_filled", "leftover_blocks", "passes", "elapsed_ms"} <= set(got[1]["stats"].asDict())
    token = got[1]["document"]["paragraphs"][0]["tokens"][1]
    assert text.encode()[token["start"] : token["end"]].decode() == token["text"] == "quick"
    df.coalesce(1).write.json(str(tmp_path / "in"))
    pages.run(pages.requests(spark, str(tmp_path / "in")), respond, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 6
