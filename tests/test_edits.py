from helpers import frame, rows

from strataflow.operators import edits as E


def test_applied_changes_and_versions(spark):
    keys = ["spec_id", "uuid"]
    outcomes = frame(spark, [("s", "a", "modified"), ("s", "b", "deleted"), ("s", "c", "added"), ("s", "d", "conflict"), ("t", "e", "unchanged")], "spec_id string, uuid string, outcome string")
    ours = frame(spark, [("s", "a", "old"), ("s", "b", "gone"), ("s", "d", "mine"), ("t", "e", None)], "spec_id string, uuid string, text string")
    theirs = frame(spark, [("s", "a", "new"), ("s", "c", None), ("s", "d", "yours")], "spec_id string, uuid string, text string")
    versions = frame(spark, [("s", "a", 4), ("s", "b", None)], "spec_id string, uuid string, base_version int")
    applied = E.applied_changes(outcomes, ours, theirs, keys, versions)
    assert rows(applied) == sorted([("s", "a", "modified", "old", "new", 5), ("s", "b", "deleted", "gone", None, 2), ("s", "c", "added", None, None, 1)], key=repr)
    specs = frame(spark, [("s", 7), ("t", 3)], "spec_id string, content_version int")
    assert rows(E.bumped_versions(specs, applied, "spec_id")) == [("s", 3, 8), ("t", 0, 3)]


def test_checkpoints_and_positions(spark):
    specs = frame(spark, [("o", "b", 2), ("o", "a", 1), ("o", "a", 5), ("p", "c", None)], "owner string, spec_id string, content_version int")
    assert {r["owner"]: (r["n_specs"], r["content_versions"]) for r in E.checkpoints(specs, "owner").collect()} == {"o": (2, {"a": 5, "b": 2}), "p": (1, {"c": None})}
    assert rows(E.numbered(frame(spark, [("o", "02"), ("o", "01"), ("o", "02"), ("p", "03")], "o string, s string"), ["o"], ["s"])) == [("o", "01", 0), ("o", "02", 1), ("p", "03", 0)]
