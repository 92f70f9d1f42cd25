"""Every registered query of the engine against its SQL, on whole tables."""

import pytest

from arbordex import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(agree, name):
    agree(Q.QUERIES[name], Q.ORACLE[name])


def test_all_registered():
    import __spark_entry__ as E

    assert set(Q.QUERIES) <= set(E.queries())
    assert set(Q.QUERIES) == set(Q.ORACLE)


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).columns == ["volume", "record", "rank_bits", "size", "mtime", "is_dir", "size_exact", "path"]


def test_own_writes(spark, sf):
    from arbordex.sources import star

    own, want = set(), set()
    for r in star.changes(spark, sf).orderBy("usn").collect():
        if r["op"] in ("created", "renamed"):
            if r["name"].lower() == "moved_0.dat":
                own.add(r["frn"])
            else:
                want.add((r["usn"], r["op"], r["frn"]))
        elif r["op"] == "deleted":
            if r["frn"] not in own:
                want.add((r["usn"], r["op"], r["frn"]))
            own.discard(r["frn"])
    assert {tuple(r) for r in Q.own_writes(spark, sf).collect()} == want


def test_descendants_of_every_directory(spark, sf):
    rows = Q.catalog(spark, sf).select("volume", "record", "tree_parent", "is_dir").collect()
    up = {(r["volume"], r["record"]): r["tree_parent"] for r in rows}
    dirs = {(r["volume"], r["record"]) for r in rows if r["is_dir"]}
    want = set()
    for volume, record in up:
        at = record
        while at is not None:
            if (volume, at) in dirs:
                want.add((volume, at, record))
            at = up[volume, at]
    got = [(r["volume"], r["root"], r["record"]) for r in Q.descendants_all(spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want and {x[:2] for x in got} == dirs
