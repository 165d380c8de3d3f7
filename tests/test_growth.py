"""Steps whose memory or time must not grow faster than the tables."""

import json

import pandas as pd
import pytest

from marlstone.edge_queries import QUERIES
from marlstone.operators import models
from marlstone.sources import files, sinks

SF = "/root/testdata/sf0.001"


def _planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["first_n_neighbors", "neighbor_inline", "neighbor_inline_always"])
def test_code_of_neighbours_is_not_broadcast(spark, name):
    plan = _planned(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["first_n_neighbors", "neighbor_inline", "neighbor_inline_always"])
def test_lists_of_neighbours_are_not_broadcast_at_run_time(spark, name):
    """Adaptive execution may choose a join anew, so the plan is looked at as it ran."""
    df = QUERIES[name](spark, SF)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_files_of_parts_follow_rows_not_parts(spark, tmp_path):
    rows = spark.range(3000, numPartitions=3).selectExpr("id div 10 as part", "id % 7 as key", "id as value")
    path = str(tmp_path / "parts")
    sinks.write_parts(rows.dropDuplicates(["part", "key"]).repartition(3), path, "part")
    assert len(list((tmp_path / "parts").rglob("part-*"))) <= 3
    got = sinks.merged_parts(spark, path, "key", "part", "key bigint, value bigint").collect()
    assert sorted(r["key"] for r in got) == list(range(7)) and {r["value"] // 10 for r in got} <= {298, 299}


def test_parts_in_folders_are_merged_too(spark, tmp_path):
    rows = spark.createDataFrame([(9, 1, "old"), (10, 1, "new"), (9, 2, "only")], "part bigint, key bigint, value string")
    rows.write.partitionBy("part").json(str(tmp_path / "parts"))
    got = sinks.merged_parts(spark, str(tmp_path / "parts"), "key", "part", "key bigint, value string").collect()
    assert sorted((r["key"], r["value"]) for r in got) == [(1, "new"), (2, "only")]


def test_judging_makes_a_frame_per_batch_and_a_request_per_pair(spark):
    """Nothing is made anew for each pair but its request; a request that fails spoils its own pair alone."""

    class Rows:
        """Stands for the table: runs what is mapped over it here, on one frame."""

        schema = {"id": spark.range(1).schema["id"]}
        select = lambda self, *_: self

        def mapInPandas(self, run, _):  # noqa: N802  Spark's name
            self.out = list(run(iter([pd.DataFrame({"id": range(500), "prompt": [str(k) for k in range(500)]})])))

    asked = []

    def client(prompts):
        asked.append(prompts)
        if prompts == ["7"]:
            raise OSError("busy")
        return [(p, None) for p in prompts]

    rows = Rows()
    models.complete(rows, "id", "prompt", lambda: client, batch=1)
    assert len(asked) == 500 and all(len(p) == 1 for p in asked)
    assert len(rows.out) == 1
    got = rows.out[0]
    assert got["id"].tolist() == list(range(500))
    assert got["error"].dropna().to_dict() == {7: "busy"} and got["reply"].drop(7).tolist() == [str(k) for k in range(500) if k != 7]


_ODD = {f'f{k} {{é"': {"s": '}{"],\\ \n' * (k % 5), "n": [[k], {"x": {}}]} for k in range(40)}


def _cut(text: str, block: int) -> list[tuple[int, dict]]:
    data = text.encode()
    cutter = files._Cutter("p", len(data))
    read = data if data.endswith(b"}") else data + b"}"  # as pieces are joined
    for a in range(0, len(read), block):
        cutter.take(read[a : a + block])
    return [(b["first"][0].as_py(), json.loads(b["value"][0].as_py())) for b in cutter.objects()]


@pytest.mark.parametrize("block", [1, 7, 64, 100000])
@pytest.mark.parametrize("indent", [None, 4])
def test_a_dump_is_cut_between_records_wherever_blocks_end(monkeypatch, block, indent):
    monkeypatch.setattr(files, "OBJECT", 200)
    got = _cut(json.dumps(_ODD, indent=indent, ensure_ascii=False), block)
    assert len(got) > 5 and max(len(v) for _, v in got) < 10
    assert [kv for _, v in got for kv in v.items()] == list(_ODD.items())
    assert [first for first, _ in got] == [sum(len(v) for _, v in got[:k]) for k in range(len(got))]


@pytest.mark.parametrize("size", [10, 1000])
def test_a_malformed_dump_gives_no_rows(monkeypatch, size):
    monkeypatch.setattr(files, "OBJECT", size)
    good = '{"a": {"x": 1}, "b": {"x": 2}}'
    assert _cut(good, 4) and _cut(good + "\n", 4)
    for bad in [good[:k] for k in range(1, len(good))] + ["[" + good + "]", good.replace("2}", "2},"), good.replace("1}", "1},,"), good.replace("2", "")]:
        assert _cut(bad, 4) == [], bad


def test_no_row_holds_a_large_dump(spark, tmp_path):
    text = json.dumps({f"f{k}": {"k": k, "code": "x{}" * 20} for k in range(30000)})
    (tmp_path / "d.json").write_text(text)
    docs = files.objects(spark, str(tmp_path))
    sizes = [r[0] for r in docs.selectExpr("length(value)").collect()]
    assert len(text) > 2_000_000 and max(sizes) < 600_000
    got = files.records(docs, "struct<k:int>").select("pos", "key", "k").toPandas().sort_values("pos")
    assert got["pos"].tolist() == got["k"].tolist() == list(range(30000))


@pytest.mark.parametrize("name", ["function_dump", "variable_dump"])
def test_dumps_are_read_once_and_not_whole(spark, name):
    plan = _planned(QUERIES[name](spark, SF))
    assert plan.count("FileScan text") == 1 and "MapInArrow" in plan
