import pytest
from helpers import DAY, T0, frame, rows
from pyspark.sql import functions as F

from strataflow.operators import hierarchy as H
from strataflow.operators.orphans import orphan_references, orphans_by_month
from strataflow.operators.snapshots import snapshot_changes, snapshot_intervals

SPEC = "spec_id string, section string, library_id string, project_id string, created_at timestamp, withdrawn_at timestamp, extra string"
REF = "ref_id long, source_spec_id string, target_spec_section string, created_at timestamp, extra string"


def at(n):
    return T0 + n * DAY


@pytest.fixture(scope="module")
def specs(spark):
    data = [
        ("a", "01 00 00", "l1", None, at(0), None, "x"),
        ("a", "01 00 00", "l1", None, at(0), None, "x"),
        ("b", "02 00 00", "l1", None, at(0), at(10), "x"),
        ("c", "03 11 00.10", "l2", None, at(0), None, "x"),
        ("d", "02 00 00", "l1", None, at(20), None, "x"),
        ("e", None, None, None, None, None, None),
    ]
    return frame(spark, data, SPEC)


def test_orphans_cover_never_there_withdrawn_and_later(spark, specs):
    data = [
        (1, "A", "020000", at(5), "y"), (1, "A", "020000", at(5), "y"), (2, "a", "02-00-00 ".replace("-", "."), at(15), "y"), (3, "b", None, at(12), "y"), (4, "ghost", "01 00 00", at(5), "y"),
        (5, "a", "03 11 00", at(5), "y"), (6, "c", "03\xa011\xa000.10", at(5), "y"), (7, None, "01 00 00", at(5), "y"), (8, "a", "01 00 00", None, "y"), (9, "a", "02 00 00", at(20), "y"), (10, "b", "02 00 00", at(10), "y"), (11, "e", "01 00 00", at(1), "y"),
    ]
    found = orphan_references(frame(spark, data, REF), specs)
    assert rows(found.select("ref_id", "ref_field")) == sorted(
        [(2, "target_spec_section"), (3, "source_spec_id"), (4, "source_spec_id"), (5, "target_spec_section"), (8, "source_spec_id"), (8, "target_spec_section"), (10, "source_spec_id"), (10, "target_spec_section"), (11, "source_spec_id"), (11, "target_spec_section")], key=repr
    )
    assert sum(r["n_orphans"] for r in orphans_by_month(frame(spark, data, REF), specs).collect()) == 10


def test_orphans_of_empty_tables(spark, specs):
    assert rows(orphan_references(frame(spark, [], REF), specs)) == []
    assert len(rows(orphan_references(frame(spark, [(1, "a", "01 00 00", at(1), "y")], REF), frame(spark, [], SPEC)))) == 1


SNAP = "spec_id string, snapshot_no int, uuid string, text string, delivered_at timestamp, change_kind string"


def test_snapshot_changes(spark):
    data = [
        ("s", 1, "u1", "a", at(1), "?"), ("s", 1, "U1", "a", at(1), "?"), ("s", 1, "u2", None, at(1), "?"), ("s", 3, "u1", "b", at(3), "?"), ("s", 3, "u1", "old", at(2), "?"), ("s", 3, "u2", None, at(3), "?"), ("s", 3, "u3", "", at(3), "?"),
        ("s", 4, "u2", "", at(4), "?"), ("s", 4, "u3", None, at(4), "?"), ("s", 7, "u1", "b", at(7), "?"), ("s", 7, "u3", None, at(7), "?"), ("t", 2, "u1", "z", at(1), "?"), (None, 1, "u9", "z", at(1), "?"), ("s", None, "u9", "z", at(1), "?"), ("s", 4, None, "z", at(1), "?"),
    ]
    found = snapshot_changes(frame(spark, data, SNAP))
    assert rows(found) == sorted(
        [("s", "u1", 3, "changed"), ("s", "u3", 3, "added"), ("s", "u1", 4, "removed"), ("s", "u2", 4, "changed"), ("s", "u3", 4, "changed"), ("s", "u1", 7, "added"), ("s", "u2", 7, "removed")], key=repr
    )
    assert rows(snapshot_changes(frame(spark, [], SNAP))) == []
    assert len(rows(snapshot_intervals(frame(spark, data, SNAP)))) == 8


def brute(parents):
    out = {}
    for n in parents:
        seen, x = [], n
        while x is not None and x in parents and x not in seen:
            seen.append(x)
            x = parents[x]
        if x in seen:
            out[n] = (min(seen[seen.index(x) :]), -1, None)
        else:
            out[n] = (seen[-1], len(seen) - 1, "/".join(reversed(seen)))
    return out


def test_hierarchy_against_brute_force(spark):
    import random

    pick = random.Random(4)
    ids = [f"n{i:03d}" for i in range(120)]
    parents = {i: pick.choice([None, "gone", *ids]) if pick.random() < 0.2 else pick.choice(ids) for i in ids}
    parents["n000"] = "n000"
    for i in range(1, 40):
        parents[f"n{i:03d}"] = f"n{i + 1:03d}"
    data = [(k.upper(), v, "x", 1) for k, v in parents.items()] + [("N005", parents["n005"], "x", 1), (None, "n001", "x", 1)]
    nodes = H.node_rows(frame(spark, data, "node string, parent_id string, tree string, depth int"), "node", "parent_id")
    found = H.hierarchy(nodes, with_path=True)
    assert {r["id"]: (r["root_id"], r["depth"], r["path"] and "/".join(r["path"])) for r in found.collect()} == brute(parents)
    wanted = brute(parents)
    below = {n: sum(1 for m, (_, d, p) in wanted.items() if d >= 0 and m != n and n in p.split("/")) for n in wanted}
    for r in H.with_descendants(found).collect():
        assert r["n_descendants"] == (below[r["id"]] if r["depth"] >= 0 else None)


def test_hierarchy_of_nothing_and_of_circles_only(spark):
    schema = "node string, parent_id string"
    assert rows(H.hierarchy(H.node_rows(frame(spark, [], schema), "node", "parent_id"))) == []
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)] + [("t", "r3")]
    found = H.hierarchy(H.node_rows(frame(spark, ring, schema), "node", "parent_id"))
    assert {(r["root_id"], r["depth"]) for r in found.collect()} == {("r0", -1)}


def test_orphans_with_filters_of_few_bits(spark, specs, monkeypatch):
    """Many filters and several rounds give the same rows, and the filters still prove most orphans."""
    from strataflow.operators import bloom

    data = [(i, f"ghost{i}" if i % 3 else "a", "01 00 00" if i % 2 else "09 99 99", at(5), "y") for i in range(300)]
    data += [(1000 + i, f"s{i}", "01 00 00", at(5), "y") for i in range(200)]
    more = specs.unionByName(frame(spark, [(f"s{i}", f"{i % 90 + 10} 00 00", "l9", None, at(0), None, "x") for i in range(200)], SPEC))
    refs = frame(spark, data, REF)
    whole = rows(orphan_references(refs, more))
    monkeypatch.setattr(bloom, "MAX_BITS", 256)
    monkeypatch.setattr(bloom, "MAX_FILTERS", 3)
    assert bloom.rounds_for(206) > 1
    assert rows(orphan_references(refs, more)) == whole
    filters = bloom.bloom_filter(more, more["spec_id"])
    assert len(filters) == 3
    passed = refs.where(bloom.might_contain(refs, filters, refs["source_spec_id"]))
    assert passed.where("source_spec_id LIKE 's%' OR source_spec_id = 'a'").count() == 300 and passed.count() < 450


def test_ids_may_hold_the_separator(spark):
    nodes = H.node_rows(frame(spark, [("a/b", None), ("c", "a/b"), ("d/", "c")], "node string, parent_id string"), "node", "parent_id")
    found = {r["id"]: (r["n_children"], r["n_descendants"], r["depth"]) for r in H.with_descendants(H.hierarchy(nodes, with_path=True)).collect()}
    assert found == {"a/b": (1, 2, 0), "c": (1, 1, 1), "d/": (0, 0, 2)}


def test_long_chains_take_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(H, "LEVELS", 3)
    chain = [(f"c{i:04d}", f"c{i - 1:04d}" if i else None) for i in range(300)] + [(f"b{i}", f"c{i * 40:04d}") for i in range(7)] + [("r0", "r1"), ("r1", "r0"), ("t0", "r1"), ("t1", "t0")]
    nodes = H.node_rows(frame(spark, chain, "node string, parent_id string"), "node", "parent_id")
    found = H.hierarchy(nodes, with_path=True).collect()
    wanted = brute(dict(chain))
    assert {r["id"]: (r["root_id"], r["depth"], r["path"] and "/".join(r["path"])) for r in found} == wanted
    plain = H.hierarchy(nodes).collect()
    assert {r["id"]: (r["root_id"], r["depth"]) for r in plain} == {k: v[:2] for k, v in wanted.items()} and len(plain) == len(chain)


def test_carried_values(spark):
    rows = [("a", None, 1), ("b", "a", 10), ("c", "b", 100), ("x", "y", 5), ("y", "x", 5)]
    nodes = frame(spark, [("", *r) for r in rows], "tree string, id string, parent string, n int")
    found = H.hierarchy(nodes, carried=(H.Carried("total", F.col("n"), lambda above: above + F.col("n")),))
    assert {r["id"]: r["total"] for r in found.collect()} == {"a": 1, "b": 11, "c": 111, "x": None, "y": None}
