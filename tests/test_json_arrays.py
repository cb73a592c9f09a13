"""JSON arrays that are read in parts."""

from __future__ import annotations

import json
import random

import pytest

from custlytics.sources import json_arrays


def thing(r, depth=0):
    if depth > 2 or r.random() < 0.4:
        return r.choice(['a"b', "}", "{", "[]", "\\", '\\"}', "é日🙂", "", "x" * r.randint(0, 80), 1.5, None, True, "line\nfeed"])
    return {f"k{i}": thing(r, depth + 1) for i in range(r.randint(0, 3))} if r.random() < 0.5 else [thing(r, depth + 1) for _ in range(r.randint(0, 3))]


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_objects_at_any_split(spark, tmp_path, split, indent):
    r = random.Random(split)
    files = {f"{n}.json": [{"id": i, "v": thing(r), "w": {"}": "{"}} for i in range(n)] for n in (0, 1, 40)}
    for name, objects in files.items():
        (tmp_path / name).write_text(json.dumps(objects, indent=indent, ensure_ascii=False) + "\n", encoding="utf-8")
    (tmp_path / "one.json").write_text(json.dumps({"id": 99, "v": thing(r)}, indent=indent))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"id": i, "v": "}\"{"}) for i in range(5)))
    files |= {"one": [{"id": 99}], "lines": [{"id": i} for i in range(5)]}
    wanted = sorted(json.dumps(o, sort_keys=True) for name in ("0.json", "1.json", "40.json") for o in files[name])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = [json.loads(x.value) for x in json_arrays.read_json_objects(spark, str(tmp_path)).collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(found) == 47 and sum(o["id"] == 99 for o in found) == 1
    arrays = sorted(json.dumps(o, sort_keys=True) for o in found if "w" in o)
    assert arrays == wanted


def test_rows_of_a_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"a": 1, "b": "x}"},\n 7, "text", {"a": "no", "b": null}\n]')
    rows = json_arrays.read_json_array(spark, str(tmp_path), "a int, b string").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "x}"), (None, None)]
