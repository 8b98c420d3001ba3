"""Streams whose files change shape: steps, types, rescued values, batches that run again."""

import json

import pytest

from sievework.sources import evolving


@pytest.fixture
def place(tmp_path):
    (tmp_path / "feed").mkdir()
    return tmp_path


def deliver(spark, place, name, lines):
    (place / "feed" / f"{name}.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    evolving.load(spark, str(place / "feed"), str(place / "out"), str(place / "log"), str(place / "chk"), availableNow=True).awaitTermination()


def got(spark, place):
    return [r.asDict() for r in evolving.read(spark, str(place / "out"), str(place / "log")).orderBy("batch_id", "id").collect()]


def test_added_and_retyped(spark, place):
    deliver(spark, place, "a", [{"id": 1, "n": 1.5, "flag": True, "at": "2024-01-01T10:00:00", "empty": None}, {"id": 2, "n": 2}])
    deliver(spark, place, "b", [{"id": 3, "n": "many", "flag": "no", "new": {"x": [1]}, "empty": 7}, "broken {", "[1]", {"id": "x4", "at": "yesterday"}, {"id": 5, "n": 1e3}])
    log = str(place / "log")
    assert evolving.columns(spark, log) == {"at": "timestamp_ntz", "flag": "boolean", "id": "bigint", "n": "double", "empty": "bigint", "new": "string"}
    assert [(r.step, r.batch_id) for r in evolving.steps(spark, log).orderBy("step").collect()] == [(0, 0), (1, 1)]
    rows = got(spark, place)
    first, second = [r for r in rows if r["batch_id"] == 0], [r for r in rows if r["batch_id"] == 1]
    assert [(r["id"], r["n"], r["flag"], str(r["at"]), r["_rescued"], r["new"]) for r in first] == [(1, 1.5, True, "2024-01-01 10:00:00", None, None), (2, 2.0, None, "None", None, None)]
    by = {r["id"]: r for r in second if r["id"]}
    assert json.loads(by[3]["_rescued"]) == {"n": "many", "flag": "no"} and json.loads(by[3]["new"]) == {"x": [1]} and by[3]["empty"] == 7
    assert by[5]["n"] == 1000.0 and by[5]["_rescued"] is None
    lost = sorted(r["_rescued"] for r in second if r["id"] is None)
    assert sorted(map(json.loads, lost), key=str) == sorted([{"_line": "[1]"}, {"_line": "broken {"}, {"id": "x4", "at": "yesterday"}], key=str)


def test_numbers_that_do_not_survive_a_cast_are_kept(spark, place):
    deliver(spark, place, "a", [{"id": 1, "n": 1}, {"id": 2, "n": 2}])
    deliver(spark, place, "b", [{"id": 3, "n": 1.5}, {"id": 4, "n": 99999999999999999999}, '{"id": 5, "n": "007"}'])
    rescued = {r["id"]: r["_rescued"] and json.loads(r["_rescued"])["n"] for r in got(spark, place)}
    assert rescued == {1: None, 2: None, 3: "1.5", 4: "99999999999999999999", 5: "007"}


def test_a_batch_that_runs_again(spark, place, monkeypatch):
    """The batch fails after its step is written; the next attempt finds the step and loses nothing."""
    whole, fails = evolving.shaped, [True]

    def shaky(parsed, known):
        if fails and fails.pop():
            raise RuntimeError("lost")
        return whole(parsed, known)

    monkeypatch.setattr(evolving, "shaped", shaky)
    with pytest.raises(Exception, match="lost"):
        deliver(spark, place, "a", [{"id": 1}, {"id": 2, "s": "x"}])
    deliver(spark, place, "later", [{"id": 3, "t": 1}])
    assert sorted((r["id"], r["batch_id"]) for r in got(spark, place)) == [(1, 0), (2, 0), (3, 1)]
    found = evolving.steps(spark, str(place / "log")).orderBy("step").collect()
    assert [[c["name"] for c in r["added"]] for r in found] == [["id", "s"], ["t"]]
