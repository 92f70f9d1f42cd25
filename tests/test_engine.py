"""The query language, patterns, scalars, snapshots, sessions, streaming and policies."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arbordex.engine import Catalog, Engine, LocalSearch, NeedsFullIndex, Session, is_refinement
from arbordex.functions import regex as R
from arbordex.functions import scalars as S
from arbordex.operators import intervals as I
from arbordex.operators import overlay as O
from arbordex.operators import search as X
from arbordex.operators import stats, tree
from arbordex.plans import qlang as L
from arbordex.plans import wire as W
from arbordex.sources import raw, snapshots
from arbordex.streaming import changes

TREE = [
    ("C:", 0, 1, None, "C:", True, 0, 0, True), ("C:", 1, 2, 1, "Documents", True, 100, 0, True), ("C:", 2, 3, 2, "report.docx", False, 200, 5000, True),
    ("C:", 3, 4, 2, "report_final.docx", False, 300, 900, False), ("C:", 4, 5, 1, "readme.txt", False, 50, 0, True), ("C:", 5, 6, 1, ".", True, 0, 0, True), ("C:", 6, 7, 6, "ÉTÉ.pdf", False, 10, 1, True),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(Catalog.from_records(spark.createDataFrame(TREE, tree.RECORDS)))


def paths(df):
    return [r["path"] for r in df.collect()]


def test_searches(engine):
    assert paths(engine.prefix("REPORT")) == ["C:\\Documents\\report.docx", "C:\\Documents\\report_final.docx"]
    assert paths(engine.substring("e")) and paths(engine.wildcard("*.docx")) == paths(engine.prefix("report"))
    assert paths(engine.path_terms("documents final")) == ["C:\\Documents\\report_final.docx"]
    assert paths(engine.search("report", order="size")) == ["C:\\Documents\\report.docx", "C:\\Documents\\report_final.docx"]
    assert paths(engine.search("report", order="recent"))[0] == "C:\\Documents\\report_final.docx"
    assert paths(engine.search("été.*", "regex")) == ["C:\\ÉTÉ.pdf"] and paths(engine.substring("été")) == []
    assert paths(engine.search(" ".join("abcdefghijklmnopq"))) == [] and paths(engine.search("")) == [] and paths(engine.search("e", limit=0)) == []
    with pytest.raises(ValueError):
        engine.search("x", order="best")
    engine.register_views()
    assert engine.catalog.base.sparkSession.sql("SELECT count(*) FROM records JOIN paths USING (volume, record)").first()[0] == 7


def test_language():
    q = L.parse("Report type:file ext:.PDF,doc size:>1kb size:<=2MB modified:<1d", 100_000)
    assert q.terms == ("Report",) and q.filter == L.Filter(False, ("pdf", "doc"), 1025, 2 << 20, 100_000 - 86_400, None)
    assert L.parse("type:what ext: size:=5kb modified:>=1d", 0).terms == ("type:what", "ext:", "size:=5kb", "modified:>=1d")
    assert L.parse("type:dir", 0).terms == ("",) and L.parse("size:<0", 0).terms == () and not L.parse("size:<0", 0).filter
    assert L.parse_terms(' alpha   beta ') == ("alpha", "beta") and L.parse_terms('"two words" x') == ("two words", "x") and L.parse_terms('"open end') == ("open end",)
    for text in ("C:\\Program Files\\app", "C:/Program Files/app", '"C:\\Program Files\\app"', "C:\\\\Program Files\\app\\"):
        assert L.parse_terms(text) == ("C:", "Program Files", "app")
    assert L.parse("C:\\Program Files type:file", 0).terms == ("C:", "Program Files type:file")
    assert len(L.parse_terms(" ".join("x" * 16))) == 16
    with pytest.raises(L.TooManyTerms):
        L.parse_terms(" ".join("x" * 17))
    assert L.parse(" ".join("x" * 16) + " type:file", 0).filter
    assert L.infer_kind("a*") == "wildcard" and L.infer_kind("a") == "path_terms" and L.parse_size("4zb") is None and L.parse_age("5") is None
    assert L.parse_size(str(1 << 64)) is None and L.parse_age("3w") == 3 * 604800


def test_patterns():
    assert R.wildcard("a.b*?") == "\\Aa\\.b.*.\\z" and R.java("(?=x)") is None and R.java("(a)\\1") is None and R.java("(") is None
    assert set(R.required_literals("^report.*final$")) == {frozenset(["report"]), frozenset(["final"])}
    assert R.required_literals("a|b") == [] and R.required_literals("(foo|bar)x*") == [frozenset(["foo", "bar"])]
    assert all("k" not in x and "s" not in x for c in R.required_literals("disk_usage_books") for x in c)


def test_scalars(spark):
    rows = [(42, False, True), (0, False, True), (42, True, False), (0, True, False), (9, False, False), (1023, False, True), (1024, False, True), (1_572_864, False, True), (2304, False, True)]
    df = spark.createDataFrame(rows, "n long, d boolean, e boolean").select(S.display_size(F.col("n"), F.col("d"), F.col("e")))
    assert [r[0] for r in df.collect()] == ["42 B", "0 B", "≥42 B", "—", "—", "1023 B", "1 KB", "1.5 MB", "2.2 KB"]
    one = spark.createDataFrame([("a\x07b", "C:\\long\\path.txt", "Été.PDF", 0, (1 << 63) - 1)], "t string, p string, n string, z long, m long")
    r = one.select(S.visible(F.col("t")), S.fit_path(F.col("p"), 9), S.lname(F.col("n")), S.extension(F.lit("foo.")), S.extension(F.lit("foo")), S.filetime_seconds(F.col("z")), S.filetime_seconds(F.col("m")), S.kib(F.col("m")), S.kib(F.lit(1025))).first()
    assert tuple(r) == ("a\ufffdb", "…path.txt", "Été.pdf", "", None, 0, 4294967295, 4294967295, 2)
    assert S.format_duration(900) == "900 µs" and S.format_duration(1500) == "1.5 ms"


def test_raw(spark):
    assert spark.range(1).select(raw.decode_name(F.lit(bytearray("né".encode("utf-16le"))))).first()[0] == "né"
    j = {"volume_serial": 1, "journal_id": 2, "first_usn": 10, "next_usn": 50}
    raw.check_cursor({"volume_serial": 1, "journal_id": 2, "next_usn": 10}, j)
    for cursor, error in (({"volume_serial": 9, "journal_id": 2, "next_usn": 10}, raw.JournalChanged), ({"volume_serial": 1, "journal_id": 2, "next_usn": 9}, raw.JournalAgedOut), ({"volume_serial": 1, "journal_id": 2, "next_usn": 51}, raw.JournalChanged)):
        with pytest.raises(error):
            raw.check_cursor(cursor, j)
    assert raw.unsized(spark.createDataFrame(TREE, tree.RECORDS)).filter("size_exact or size_bytes > 0").count() == 0


def test_snapshots(spark, engine, tmp_path):
    path = f"file://{tmp_path}/cat"
    with pytest.raises(FileNotFoundError):
        Catalog.open(spark, path)
    assert engine.catalog.save(path) == 1 and engine.catalog.save(path) == 2
    found = Catalog.open(spark, path)
    assert found.generation == 2 and sorted(map(tuple, found.base.collect())) == sorted(map(tuple, engine.catalog.base.collect()))
    assert [r["name"] for r in snapshots.names_in(found.base, "C:", 0, 3).collect()] == [".", "C:", "Documents"]
    meta = snapshots.current(spark, path)
    snapshots.publish(spark, path, meta | {"format": 99})
    with pytest.raises(snapshots.WrongFormat):
        Catalog.open(spark, path)


def test_resume(spark, engine, tmp_path):
    path = f"file://{tmp_path}/cat"
    engine.catalog.save(path)
    log = spark.createDataFrame([("C:", u, "created", 50 + u, 2, f"f{u}", False, False, u + 1) for u in range(5)], changes.EVENTS)
    with pytest.raises(NeedsFullIndex):
        Catalog.resume(spark, path, log)
    assert Catalog.resume(spark, path, log.limit(0)).view().count() == 7


def test_sessions(engine):
    assert is_refinement(L.parse("re", 0), L.parse("REp x", 0)) and not is_refinement(L.parse("re x", 0), L.parse("re", 0))
    assert not is_refinement(L.parse("re", 0), L.parse("re type:file", 0)) and not is_refinement(L.to_query("a*", 0), L.to_query("a*b", 0))
    s = Session(engine)
    for text in ("r", "re", "rep", "report f"):
        s.submit(text, now=0)
        assert [r["path"] for r in s.wait_latest(60)] == paths(engine.search(text, limit=12))
    assert s.refined == 3 and not s.is_pending() and s.poll_latest() is not None
    for text in ("d", "do", "doc"):  # superseded requests answer nothing
        s.submit(text, now=0)
    assert [r["path"] for r in s.wait_latest(60)] == paths(engine.search("doc", limit=12))


def test_streaming(spark, tmp_path):
    path, log = f"file://{tmp_path}/cat", f"{tmp_path}/log"
    many = TREE + [("C:", 100 + i, 1000 + i, 2, f"file{i}", False, 0, 10, True) for i in range(100)]
    Catalog.from_records(spark.createDataFrame(many, tree.RECORDS)).save(path)

    def events(rows):
        spark.createDataFrame(rows, changes.EVENTS).coalesce(1).write.mode("append").parquet(log)

    f = changes.Follower(spark, path, rebuild=lambda: spark.createDataFrame(TREE, tree.RECORDS))
    events([("C:", 0, "created", 5000, 2, "streamed", True, False, 1), ("C:", 1, "modified", 3, None, None, None, False, 2)])
    f.start(changes.read_log(spark, log), f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert paths(Engine(f.catalog).search("streamed")) == ["C:\\Documents\\streamed"] and f.compactions == 0
    events([("C:", 2 + i, "created", 6000 + i, 5000, f"inner{i}", False, False, 3 + i) for i in range(8)])
    f.start(changes.read_log(spark, log), f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert f.compactions == 1 and f.catalog.generation == 2 and f.catalog.next_usn == 10
    assert len(paths(Engine(f.catalog).search("streamed inner"))) == 8
    events([("C:", 20, "renamed", 424242, 2, "unknown", None, False, 21)])
    f.start(changes.read_log(spark, log), f"{tmp_path}/cp", available_now=True).awaitTermination()
    assert f.full_indexes == 1 and f.catalog.view().count() == 7
    changes.purge_log(spark, path, 3)


def test_policy():
    p = changes.PersistSchedule()
    assert not p.due(0)
    p.observe(0, False, True)
    assert not p.due(3599) and p.due(3600)
    p.observe(3600, True, False)
    assert not p.due(3700) and p.due(4200)
    p.attempted(4200)
    assert not p.due(4300) and p.due(4500)
    p.persisted()
    assert not p.due(10_000)


def test_stats(spark):
    df = spark.range(2000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("a"))
    last = sorted(i % 7 for i in range(976, 2000))
    r = stats.report(df, ["a"]).first()
    assert tuple(r) == ("a", sum(i % 7 for i in range(2000)), 6, last[512], last[1024 * 99 // 100])
    assert tuple(stats.report(df.limit(0), ["a"]).first()) == ("a", 0, 0, 0, 0)


def test_empty_catalog(spark):
    e = Engine(Catalog.from_records(spark.createDataFrame([], tree.RECORDS)))
    assert paths(e.search("x")) == []


def test_prefix_is_pushed_down(engine, spark, tmp_path):
    path = f"file://{tmp_path}/cat"
    engine.catalog.save(path)
    plan = Engine(Catalog.open(spark, path)).hits("rep", "prefix")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(lname,rep)" in plan and "TakeOrderedAndProject" in plan


def test_lossy_names(spark):
    raw_units = {"né😀": "né😀", "\ud83dx": "\ufffdx", "x\ude00": "x\ufffd", "\ud83d\ud83d\ude00": "\ufffd😀", "\ude00\ud83d": "\ufffd\ufffd", "": "", "\ud83d\ude00\ude00": "😀\ufffd"}
    rows = [(bytearray(k.encode("utf-16le", "surrogatepass")), v) for k, v in raw_units.items()] + [(bytearray("ab".encode("utf-16le") + b"x"), "ab"), (bytearray(b"x"), ""), (None, None)]
    df = spark.createDataFrame(rows, "b binary, want string")
    assert df.filter(~raw.decode_name(F.col("b")).eqNullSafe(F.col("want"))).count() == 0


def test_wire(spark, engine):
    q, order, limit = W.decode_request(W.encode_request("path_terms", "documents type:file", 7, "recent", 100))
    assert q == L.to_query("documents type:file", 100, "path_terms") and (order, limit) == ("recent", 7)
    good = {"kind": "prefix", "pattern": "a", "limit": 1, "order": "relevance", "now": 0}
    for bad in ({"kind": "fuzzy"}, {"order": "best"}, {"limit": "1"}, {"limit": True}, {"extra": 1}):
        with pytest.raises(W.BadRequest):
            W.decode_request(json.dumps(good | bad))
    for text in ("", "[]", "{}", json.dumps({k: v for k, v in good.items() if k != "now"})):
        with pytest.raises(W.BadRequest):
            W.decode_request(text)
    found = engine.search("type:file")
    assert W.decode_results(W.encode_results(found)).collect() == found.collect()
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        W.decode_results(spark.createDataFrame([("{nothing",)], "line string")).collect()


def test_readers_in_turn(spark):
    def broken():
        raise OSError("no volume")

    assert Catalog.from_readers(broken, lambda: spark.createDataFrame(TREE, tree.RECORDS)).base.count() == 7
    with pytest.raises(OSError):
        Catalog.from_readers(broken, broken)


def test_scan_and_counts(engine):
    assert [r["name"] for r in engine.scan("type:file", limit=2).collect()] == ["readme.txt", "report.docx"]
    assert engine.scan("type:file", limit=3, in_order=False).count() == 3 and engine.scan("x" * 40).count() == 0
    assert tuple(engine.counts("report", "prefix", 1).first()) == (7, 2, 1) and tuple(engine.counts("nothing").first()) == (7, 0, 0)
    assert engine.stats()["live"] == {"C:": 7}


@pytest.mark.parametrize("seed", range(3))
def test_interval_sets(spark, seed):
    rng = random.Random(seed)
    sets = [[(v, s, s + rng.randint(-1, 6)) for v in "ab" for s in rng.sample(range(40), rng.randint(0, 9))] for _ in range(2)]
    schema = "volume string, start long, end long"
    a, b = (spark.createDataFrame(x, schema) for x in sets)
    cover = [{(v, p) for v, s, e in x for p in range(s, e)} for x in sets]

    def islands(points):
        out = []
        for v, p in sorted(points):
            if out and out[-1][0] == v and out[-1][2] == p:
                out[-1] = (v, out[-1][1], p + 1)
            else:
                out.append((v, p, p + 1))
        return out

    assert sorted(map(tuple, I.normalise(a).collect())) == islands(cover[0])
    assert sorted(map(tuple, I.union(a, b).collect())) == islands(cover[0] | cover[1])
    assert sorted(map(tuple, I.intersect(a, b).collect())) == islands(cover[0] & cover[1])
    rows = spark.createDataFrame([(v, p, f"x{p}") for v in "abc" for p in range(50)], "volume string, dfs_pos long, name string")
    assert {(r["volume"], r["dfs_pos"]) for r in I.inside(rows, a).collect()} == cover[0]


def test_terms_by_intervals(spark, engine):
    base = engine.catalog.base
    for text in ("documents", "doc", "documents report", "c: .pdf", "c: documents type:dir", "nothing", "", "documents documents"):
        q = L.to_query(text, 0)
        want = sorted(r["record"] for r in X.base_view(base).filter(X.compile_query(q)[0]).collect())
        assert sorted(r["record"] for r in I.below_terms(base, q).collect()) == want, text


def test_stored_overlay(spark, engine, tmp_path):
    path = f"file://{tmp_path}/cat"
    engine.catalog.save(path)
    base = Catalog.open(spark, path)
    log = [("C:", 1, "created", 50, 2, "New", True, False, 2), ("C:", 2, "created", 51, 50, "deep.txt", False, False, 3), ("C:", 3, "deleted", 5, None, None, None, False, 4)]
    changed = base.apply(spark.createDataFrame(log, changes.EVENTS))
    local = LocalSearch(spark, path, clock=lambda: now[0])
    now = [0.0]
    assert local.search("type:file", now=0).count() == 4
    changed.save_overlay(path)
    assert local.search("type:file", now=0).count() == 4  # not stale yet
    now[0] = 0.3
    assert local.search("type:file", now=0).count() == 4 and paths(local.search("deep", now=0)) == ["C:\\Documents\\New\\deep.txt"]
    again = Catalog.open(spark, path)
    rows = lambda c: sorted(map(tuple, c.view().collect()))
    assert again.next_usn == 4 and rows(again) == rows(changed) and again.overlay.reindex.count() == 0
    overlay = changed.overlay
    for bad in (overlay.added.withColumn("parent_idx", F.col("idx")).withColumn("parent_kind", F.lit("delta")), overlay.added.withColumn("parent_idx", F.lit(99).cast("long")).withColumn("parent_kind", F.lit("base"))):
        snapshots.save_overlay(O.Overlay(overlay.tombstones, bad, overlay.reindex), path, base=1, next_usn=4)
        with pytest.raises(snapshots.BadOverlay):
            Catalog.open(spark, path)
    engine.catalog.save(path)  # another generation: the overlay is not its own
    assert Catalog.open(spark, path).overlay is None


def test_lost_events_need_a_full_index(spark, engine, tmp_path):
    lost = spark.createDataFrame([("C:", 9, "overflow", None, None, None, None, False, 10)], changes.EVENTS)
    with pytest.raises(NeedsFullIndex):
        engine.catalog.apply(lost)
    path = f"file://{tmp_path}/cat"
    engine.catalog.save(path)
    with pytest.raises(NeedsFullIndex):
        changes.Follower(spark, path).on_batch(lost, 0)
    follower = changes.Follower(spark, path, rebuild=lambda: spark.createDataFrame(TREE, tree.RECORDS))
    follower.on_batch(lost, 0)
    assert follower.full_indexes == 1 and follower.catalog.next_usn == 10 and follower.catalog.base.count() == 7


def test_marker(spark):
    r = spark.range(1).select(S.display_path(F.lit("a"), F.lit(True)), S.display_path(F.lit("a"), F.lit(False)), S.display_path(F.lit("a"), F.lit(True), "\\")).first()
    assert tuple(r) == ("a/", "a", "a\\")


def test_pointers_are_never_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    for n in range(4):
        snapshots.publish(spark, path, {"n": n})
        assert snapshots.current(spark, path) == {"n": n}
    (tmp_path / "p" / ".CURRENT-half").write_text("{")
    assert snapshots.current(spark, path) == {"n": 3} and len(snapshots._pointers(spark, path, "CURRENT")) == 2
