"""Registered queries of the catalog engine, over catalogs derived from the star-schema tables (see sources.star)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbordex.engine import Catalog, Session, Engine, is_refinement
from arbordex.functions import regex as R
from arbordex.functions import scalars as S
from arbordex.operators import intervals, ordinals, overlay, skipping, stats, tree
from arbordex.operators import search as X
from arbordex.plans import qlang
from arbordex.sources import raw, star
from arbordex.sources import snapshots
from arbordex.sources.snapshots import sorted_by_name
from arbordex.storage import fresh_path, written

NOW = 915_148_800  # 1999-01-01
_BUILT: dict[tuple[str, str, str], object] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """An index is built once per application and data folder, then queried many times. It lies in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "catalog", lambda: written(sorted_by_name(tree.build(star.records(spark, sf_dir))), "catalog"))


def folded(spark: SparkSession, sf_dir: str) -> overlay.Overlay:
    return _kept(spark, sf_dir, "overlay", lambda: overlay.fold(_of(catalog(spark, sf_dir), "V:"), raw.real_changes(star.changes(spark, sf_dir))))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "view", lambda: written(overlay.view(_of(catalog(spark, sf_dir), "V:"), folded(spark, sf_dir)), "view"))


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "compact", lambda: written(tree.build(overlay.compacted(_of(catalog(spark, sf_dir), "V:"), folded(spark, sf_dir))), "compact"))


def _of(df: DataFrame, volume: str) -> DataFrame:
    return df.filter(F.col("volume") == volume)


def _found(view: DataFrame, q: qlang.Query, order: str = "relevance", limit: int = 50, slots: dict[str, int] | None = None) -> DataFrame:
    return X.hits(view, q, order, limit, slots, with_paths=True).select("volume", "record", "rank_bits", "size", "mtime", "is_dir", "size_exact", "path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# --- SQL ---------------------------------------------------------------------------------------------------------

_UP, _LOW = S.UPPER26, S.LOWER26
_KEY = "CAST(('0x' || substr(md5({}), 1, 12)) AS BIGINT) + 1125899906842624"
_T, _B, _L, _SR = _KEY.format("'t/' || p_type"), _KEY.format("'b/' || p_type || '/' || p_brand"), _KEY.format("'l/' || lang"), _KEY.format("'s/' || lang || '/' || source")
_ROOT = "SELECT '{0}' AS volume, 1::BIGINT AS frn, NULL::BIGINT AS parent_frn, '{0}' AS name, true AS is_dir, 0::BIGINT AS mtime, 0::BIGINT AS size_bytes, true AS size_exact"
_RECORDS = {
    "V:": f"""{_ROOT.format("V:")}
  UNION ALL SELECT 'V:', 10 + r_regionkey, 1, r_name, true, 0, 0, true FROM region
  UNION ALL SELECT 'V:', 100 + n_nationkey, 10 + n_regionkey, n_name, true, 0, 0, true FROM nation
  UNION ALL SELECT 'V:', 1000000 + c_custkey, 100 + c_nationkey, c_name, true, 0, 0, true FROM customer
  UNION ALL SELECT 'V:', 1000000000 + o_orderkey, 1000000 + o_custkey, 'Order_' || o_orderkey || '.' || lower(substr(o_orderpriority, 3, 10)), false,
    CAST(epoch(o_orderdate) AS BIGINT), CAST(floor(o_totalprice) AS BIGINT), o_orderstatus <> 'P' FROM orders""",
    "P:": f"""{_ROOT.format("P:")}
  UNION ALL SELECT DISTINCT 'P:', {_T}, 1, p_type, true, 0, 0, true FROM part
  UNION ALL SELECT DISTINCT 'P:', {_B}, {_T}, p_brand, true, 0, 0, true FROM part
  UNION ALL SELECT 'P:', p_partkey + 1000000, {_B}, p_name || '_' || p_partkey || '.' || p_size, false, 0, CAST(floor(p_retailprice * 1000) AS BIGINT), true FROM part""",
    "D:": f"""{_ROOT.format("D:")}
  UNION ALL SELECT DISTINCT 'D:', {_L}, 1, lang, true, 0, 0, true FROM documents
  UNION ALL SELECT DISTINCT 'D:', {_SR}, {_L}, source, true, 0, 0, true FROM documents
  UNION ALL SELECT 'D:', doc_id + 1000000, {_SR}, 'doc_' || doc_id || '.txt', false, 0, n_chars, doc_id IN (SELECT doc_id FROM labels) FROM documents""",
    "C:": """SELECT 'C:' AS volume, p_partkey AS frn,
    CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN p_partkey WHEN p_partkey % 83 = 0 THEN 999999999 ELSE (p_partkey * 7919 + 13) % 1999 + 1 END AS parent_frn,
    'n' || ((p_partkey * 31) % 101) AS name, true AS is_dir, 0::BIGINT AS mtime, p_partkey AS size_bytes, true AS size_exact FROM part""",
}


def _cat(records: str, p: str = "", ord_: str = "frn") -> str:
    """CTEs from records to {p}cat: names, canonical parents, paths, aggregates, preorder."""
    return f"""{p}rec AS ({records}),
{p}num AS (SELECT *, translate(name, '{_UP}', '{_LOW}') AS lname, least((size_bytes + 1023) // 1024, 4294967295) AS own_kib,
  row_number() OVER (PARTITION BY volume ORDER BY translate(name, '{_UP}', '{_LOW}'), {ord_}) - 1 AS record FROM {p}rec),
{p}par AS (SELECT a.*, b.record AS parent FROM {p}num a LEFT JOIN {p}num b ON a.volume = b.volume AND a.parent_frn = b.frn),
{p}up AS (SELECT volume, record, CASE WHEN parent <> record THEN parent END AS anc1 FROM {p}par
  UNION SELECT u.volume, u.record, CASE WHEN q.parent <> q.record THEN q.parent END FROM {p}up u JOIN {p}par q ON q.volume = u.volume AND q.record = u.anc1),
{p}can AS (SELECT volume, record, bool_or(anc1 IS NULL) OR min(anc1) < record AS keeps FROM {p}up GROUP BY volume, record),
{p}tp AS (SELECT q.*, CASE WHEN c.keeps AND q.parent <> q.record THEN q.parent END AS tree_parent, NOT c.keeps AS pseudo FROM {p}par q JOIN {p}can c ON c.volume = q.volume AND c.record = q.record),
{p}ch AS (SELECT volume, record, [record] AS anc, name AS path, CASE WHEN is_dir THEN [lname] ELSE CAST([] AS VARCHAR[]) END AS dirs, CAST([] AS VARCHAR[]) AS above, pseudo AS late FROM {p}tp WHERE tree_parent IS NULL
  UNION ALL SELECT t.volume, t.record, list_append(h.anc, t.record), h.path || '\\' || t.name, CASE WHEN t.is_dir THEN list_append(h.dirs, t.lname) ELSE h.dirs END, h.dirs, h.late
  FROM {p}ch h JOIN {p}tp t ON t.volume = h.volume AND t.tree_parent = h.record),
{p}agg AS (SELECT x.volume, x.a AS record, CAST(least(sum(x.own_kib), 4294967295) AS BIGINT) AS rec_kib, count(*) AS subtree_len, bool_and(x.is_dir OR x.size_exact) AS known
  FROM (SELECT h.volume, unnest(h.anc) AS a, t.own_kib, t.is_dir, t.size_exact FROM {p}ch h JOIN {p}tp t ON t.volume = h.volume AND t.record = h.record) x GROUP BY x.volume, x.a),
{p}cat AS (SELECT t.volume, t.record, t.frn, t.name, t.lname, t.is_dir, t.mtime, CAST(t.own_kib AS BIGINT) AS own_kib, t.parent, t.tree_parent, t.pseudo, h.anc, h.path, h.dirs,
  array_to_string(h.above, chr(0)) AS blob, g.rec_kib, CASE WHEN t.is_dir THEN g.known ELSE t.size_exact END AS size_exact, g.subtree_len,
  row_number() OVER (PARTITION BY t.volume ORDER BY h.late, h.anc) - 1 AS dfs_pos
  FROM {p}tp t JOIN {p}ch h ON h.volume = t.volume AND h.record = t.record JOIN {p}agg g ON g.volume = t.volume AND g.record = t.record)"""


def _with(*volumes: str) -> str:
    return "WITH RECURSIVE " + _cat("\n  UNION ALL ".join(f"({_RECORDS[v]})" for v in volumes))


_VIEW = """v AS (SELECT volume, record, name, lname, is_dir, mtime, rec_kib AS eff, CASE WHEN is_dir THEN rec_kib ELSE own_kib END * 1024 AS size, size_exact, blob, path FROM cat)"""
_RANK = {
    "relevance": "({quality}) * 16777216 + least(strlen(name), 16777215)",
    "recent": "4294967295 - mtime",
    "largest": "4294967295 - CASE WHEN size_exact THEN eff ELSE 0 END",
}


def _top(where: str, quality: str = "0", order: str = "relevance", limit: int = 50, slot: str = "0") -> str:
    return f"""SELECT volume, record, CAST(rank_bits AS BIGINT) AS rank_bits, size, mtime, is_dir, size_exact, path FROM
(SELECT *, {_RANK[order].format(quality=quality)} AS rank_bits, {slot} AS slot FROM v WHERE {where}) ORDER BY rank_bits, slot, record LIMIT {limit}"""


def _has(term: str) -> str:
    return f"(contains(lname, '{term}') OR contains(blob, '{term}'))"


def _missing(*terms: str) -> str:
    return f"{len(terms)} - " + " - ".join(f"CAST(contains(lname, '{t}') AS INTEGER)" for t in terms)


def _name_quality(text: str) -> str:
    return f"CASE WHEN lname = '{text}' THEN 0 WHEN starts_with(lname, '{text}') THEN 1 ELSE 2 END"


# --- searches ----------------------------------------------------------------------------------------------------


def _search(name: str, text: str, where: str, quality: str = "0", *, kind: str | None = None, order: str = "relevance", limit: int = 50, volume: str = "V:") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = X.base_view(_of(catalog(spark, sf_dir), volume))
        return _found(view, qlang.to_query(text, NOW, kind), qlang.parse_order(order), limit)

    QUERIES[name] = run
    ORACLE[name] = f"{_with(volume)}, {_VIEW} {_top(where, quality, order, max(0, min(limit, X.MAX_LIMIT)))}"


for _o in ("relevance", "recent", "largest"):
    _search(f"prefix_{_o}", "order_12", "starts_with(lname, 'order_12')", _name_quality("order_12"), kind="prefix", order=_o)
    _search(f"substring_{_o}", "99.H", "contains(lname, '99.h')", _name_quality("99.h"), kind="substring", order=_o)
    _search(f"path_terms_{_o}", "africa 77", f"{_has('africa')} AND {_has('77')}", _missing("africa", "77"), order=_o)
_search("prefix_empty", "", "true", _name_quality(""), kind="prefix", limit=100)
_search("substring_one_byte", "7", "contains(lname, '7')", _name_quality("7"), kind="substring", limit=200)
_search("substring_empty", "", "true", _name_quality(""), kind="substring")
_search("regex_alt", "^order_(11|22)\\d+\\.(urgent|low)$", "regexp_matches(name, '^order_(11|22)[0-9]+\\.(urgent|low)$', 'i')", "2", kind="regex", limit=1000)
_search("regex_invalid", "order_(?=1", "false", kind="regex")
_search("wildcard_star", "*_1?*.urgent", "regexp_matches(name, '^.*_1..*\\.urgent$', 'i')", "2", limit=500)
_search("wildcard_qmark", "Order_???.low", "regexp_matches(name, '^order_...\\.low$', 'i')", "2", limit=500)
_search("path_terms_1", "customer#000000011", _has("customer#000000011"), _missing("customer#000000011"), limit=1000)
_search("path_terms_dup", "order order 5", f"{_has('order')} AND {_has('5')}", _missing("order", "order", "5"), limit=300)
_search("path_terms_absolute", "V:\\ASIA\\nation", f"{_has('v:')} AND {_has('asia')} AND {_has('nation')}", _missing("v:", "asia", "nation"), limit=500)
_search("path_terms_absent", "nosuchthing", "false")
_search("path_terms_quoted", '"blue an"', _has("blue an"), _missing("blue an"), volume="P:", limit=500)
_search("filter_file", "europe type:file", f"{_has('europe')} AND NOT is_dir", _missing("europe"), limit=500)
_search("filter_dir", "europe type:folder", f"{_has('europe')} AND is_dir", _missing("europe"), limit=500)
_EXT = "regexp_extract(lname, '[.]([^.]*)$', 1)"
_search("filter_ext_multi", "america ext:urgent,.low ext:high", f"{_has('america')} AND NOT is_dir AND contains(lname, '.') AND {_EXT} IN ('urgent', 'low', 'high')", _missing("america"), limit=500)
_search("filter_size_range", "order size:>100kb size:<=200kb", f"{_has('order')} AND size_exact AND eff * 1024 BETWEEN 102401 AND 204800", _missing("order"), order="largest", limit=1000)
_search("filter_size_eq_unmatchable", "size:1500", "size_exact AND eff * 1024 = 1500")
_search("filter_dir_recursive_size", "type:dir size:>1mb", "is_dir AND size_exact AND eff * 1024 >= 1048577", _missing(""), order="largest", limit=500)
_search("filter_modified_lt", "order modified:<52w", f"{_has('order')} AND mtime >= {NOW - 52 * 604800}", _missing("order"), order="recent", limit=500)
_search("filter_modified_gt", "order modified:>200w", f"{_has('order')} AND mtime <= {NOW - 200 * 604800}", _missing("order"), order="recent", limit=500)
_search("predicate_only", "ext:medium", f"NOT is_dir AND contains(lname, '.') AND {_EXT} = 'medium'", _missing(""), limit=300)
_search("limit_zero", "order", "false", limit=0)
_search("flagship", "america nation type:file ext:urgent size:>100kb", f"{_has('america')} AND {_has('nation')} AND NOT is_dir AND contains(lname, '.') AND {_EXT} = 'urgent' AND size_exact AND eff * 1024 >= 102401", _missing("america", "nation"))


def cross_volume_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(X.base_view(catalog(spark, sf_dir)), qlang.to_query("1 type:file", NOW), "relevance", 300, star.SLOTS)


QUERIES["cross_volume_topk"] = cross_volume_topk
ORACLE["cross_volume_topk"] = f"{_with('V:', 'P:', 'D:', 'C:')}, {_VIEW} " + _top(f"{_has('1')} AND NOT is_dir", _missing("1"), limit=300, slot="CASE volume WHEN 'V:' THEN 0 WHEN 'P:' THEN 1 WHEN 'D:' THEN 2 ELSE 3 END")


def refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second keystroke, answered from the first one's candidates."""
    base = _of(catalog(spark, sf_dir), "V:")
    session = Session(Engine(Catalog(base)))
    first, second = qlang.to_query("order_1", NOW), qlang.to_query("order_12 7", NOW)
    if not is_refinement(first, second):
        raise AssertionError("the second query refines the first")
    session.candidates(first, "relevance")
    return _found(session.candidates(second, "relevance"), second, limit=200)


QUERIES["refinement"] = refinement
ORACLE["refinement"] = f"{_with('V:')}, {_VIEW} " + _top(f"{_has('order_12')} AND {_has('7')}", _missing("order_12", "7"), limit=200)


def block_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring search on the blocks that hold its trigrams only."""
    base = _of(catalog(spark, sf_dir), "V:")
    blocks = skipping.candidate_blocks(skipping.block_index(base), [["r_777"]])
    return _found(skipping.skipped(X.base_view(base), blocks), qlang.to_query("r_777", NOW, "substring"), limit=500)


QUERIES["block_skipping"] = block_skipping
ORACLE["block_skipping"] = f"{_with('V:')}, {_VIEW} " + _top("contains(lname, 'r_777')", _name_quality("r_777"), limit=500)


def regex_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular expression on the blocks that its required literals allow."""
    base, pattern = _of(catalog(spark, sf_dir), "V:"), "order_9\\d*1\\.(urgent|medium)"
    clauses = [sorted(c) for c in R.required_literals(pattern)]
    blocks = skipping.candidate_blocks(skipping.block_index(base), clauses)
    return _found(skipping.skipped(X.base_view(base), blocks), qlang.to_query(pattern, NOW, "regex"), limit=1000)


QUERIES["regex_literals"] = regex_literals
ORACLE["regex_literals"] = f"{_with('V:')}, {_VIEW} " + _top("regexp_matches(name, 'order_9[0-9]*1\\.(urgent|medium)', 'i')", "2", limit=1000)


# --- the tree ----------------------------------------------------------------------------------------------------

_ALL = _with("V:", "P:", "D:", "C:")


def _column(name: str, sql: str, *cols: str, volume: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = catalog(spark, sf_dir)
        return (c if volume is None else _of(c, volume)).select("volume", "record", *cols)

    QUERIES[name] = run
    ORACLE[name] = f"{_ALL if volume is None else _with(volume)} SELECT volume, record, {sql} FROM cat"


_column("name_rank", "frn, lname", "frn", "lname")
_column("parent_resolution", "frn, parent", "frn", "parent")
_column("canonical_parent", "parent, tree_parent", "parent", "tree_parent")
_column("full_path", "path", "path")
_column("dfs_interval", "dfs_pos, dfs_pos + subtree_len AS dfs_end", "dfs_pos", "dfs_end")
_column("subtree_count", "subtree_len", "subtree_len")
_column("recursive_size", "own_kib, rec_kib", "own_kib", "rec_kib")
_column("dir_exactness", "is_dir, size_exact", "is_dir", "size_exact")


def descendants_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return tree.descendants(c, c.filter("is_dir and (volume <> 'V:' or lname like 'nation%')"))


QUERIES["descendants_of"] = descendants_of
ORACLE["descendants_of"] = f"""{_ALL} SELECT a.volume, a.record AS root, d.record FROM cat a JOIN cat d ON d.volume = a.volume AND d.dfs_pos >= a.dfs_pos AND d.dfs_pos < a.dfs_pos + a.subtree_len
WHERE a.is_dir AND (a.volume <> 'V:' OR a.lname LIKE 'nation%')"""


def descendants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory of every volume is asked (descendants_of leaves most of V: out, as its SQL does)."""
    c = catalog(spark, sf_dir)
    return tree.descendants(c, c.filter("is_dir"))


QUERIES["descendants_all"] = descendants_all
ORACLE["descendants_all"] = f"""{_ALL} SELECT a.volume, a.record AS root, d.record FROM cat a JOIN cat d ON d.volume = a.volume AND d.dfs_pos >= a.dfs_pos AND d.dfs_pos < a.dfs_pos + a.subtree_len
WHERE a.is_dir"""


def largest_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).filter("is_dir").orderBy(F.desc("rec_kib"), "volume", "record").limit(100).select("volume", "record", "path", "rec_kib", S.human_size(F.col("rec_kib") * 1024).alias("shown"))


QUERIES["largest_dirs"] = largest_dirs
_SHOWN = """CASE WHEN {0} = 0 THEN '0 B' WHEN {0} < 1024 THEN {0} || ' B' ELSE (WITH s AS (SELECT least(6, CAST(floor(log2(greatest({0}, 1))) AS BIGINT) // 10) AS u) SELECT
  CASE WHEN {0} / pow(1024.0, u) >= 10 OR {0} / pow(1024.0, u) - floor({0} / pow(1024.0, u)) < 0.05 THEN CAST(CAST(round_even({0} / pow(1024.0, u), 0) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', {0} / pow(1024.0, u)) END
  || ' ' || ['B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB'][u + 1] FROM s) END"""
ORACLE["largest_dirs"] = f"{_ALL} SELECT volume, record, path, rec_kib, {_SHOWN.format('(rec_kib * 1024)')} AS shown FROM cat WHERE is_dir ORDER BY rec_kib DESC, volume, record LIMIT 100"


def lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    asked = spark.createDataFrame([("V:", "Order_5"), ("V:", "zz"), ("V:", ""), ("P:", "RED"), ("D:", "doc_10")], "volume string, name string")
    return ordinals.lower_bound(c, asked)


QUERIES["lower_bound"] = lower_bound
ORACLE["lower_bound"] = f"""{_ALL}, q AS (SELECT * FROM (VALUES ('V:', 'Order_5'), ('V:', 'zz'), ('V:', ''), ('P:', 'RED'), ('D:', 'doc_10')) t(volume, name))
SELECT volume, name, (SELECT count(*) FROM cat WHERE cat.volume = q.volume AND cat.lname < translate(q.name, '{_UP}', '{_LOW}')) AS bound FROM q"""


def frn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arbordex.sources.snapshots import by_frn

    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("V:").alias("volume"), (1_000_000_000 + F.col("l_orderkey")).alias("frn"))
    return by_frn(catalog(spark, sf_dir), wanted)


QUERIES["frn_lookup"] = frn_lookup
ORACLE["frn_lookup"] = f"{_with('V:')} SELECT volume, frn, record FROM cat WHERE frn IN (SELECT 1000000000 + l_orderkey FROM lineitem)"


def match_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_mask(X.base_view(_of(catalog(spark, sf_dir), "V:")), ["order", "1", "URGENT"])


QUERIES["match_mask"] = match_mask
ORACLE["match_mask"] = f"{_with('V:')} SELECT volume, record, CAST(contains(lname, 'order') AS BIGINT) + 2 * CAST(contains(lname, '1') AS BIGINT) + 4 * CAST(contains(lname, 'urgent') AS BIGINT) AS mask FROM cat"


# --- scalars and raw sources -------------------------------------------------------------------------------------


def _table_query(name: str, table: str, columns: Callable[[], list], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns())
    ORACLE[name] = sql


_table_query("kib_round", "orders", lambda: ["o_orderkey", S.kib(F.floor("o_totalprice")).alias("kib")], "SELECT o_orderkey, CAST(ceil(floor(o_totalprice) / 1024) AS BIGINT) AS kib FROM orders")
_TICKS = "(epoch(ts)::BIGINT - CASE WHEN event_id % 5 = 0 THEN 30000000000 ELSE 0 END + 11644473600) * 10000000 + event_id % 10000000"
_table_query(
    "filetime", "events",
    lambda: ["event_id", S.filetime_seconds((F.unix_seconds(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 5 == 0, 30_000_000_000).otherwise(0) + S.FILETIME_EPOCH) * 10_000_000 + F.col("event_id") % 10_000_000).alias("seconds")],
    f"SELECT event_id, CASE WHEN {_TICKS} <= 0 THEN 0 ELSE greatest(0, least(({_TICKS}) // 10000000 - 11644473600, 4294967295)) END AS seconds FROM events".replace("epoch(ts)::BIGINT", "CAST(floor(epoch(ts)) AS BIGINT)"),
)
_table_query("human_size", "documents", lambda: ["doc_id", S.human_size(F.col("n_chars") * F.col("n_chars")).alias("shown")], f"SELECT doc_id, {_SHOWN.format('(n_chars * n_chars)')} AS shown FROM documents")
_table_query("extension", "pages", lambda: ["page_id", S.extension(S.lname(F.col("url"))).alias("ext")], f"SELECT page_id, CASE WHEN contains(url, '.') THEN translate(split_part(url, '.', -1), '{_UP}', '{_LOW}') END AS ext FROM pages")
_table_query("fit_path", "pages", lambda: ["page_id", S.fit_path(F.col("url"), 20).alias("shown")], "SELECT page_id, CASE WHEN length(url) <= 20 THEN url ELSE '…' || right(url, 19) END AS shown FROM pages")
_table_query("local_time", "orders", lambda: ["o_orderkey", S.local_time(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("shown")], "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS shown FROM orders")
_table_query("visible_text", "conversations", lambda: ["conv_id", "turn", S.visible(F.col("text")).alias("shown")], "SELECT conv_id, turn, regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', chr(65533), 'g') AS shown FROM conversations")


def hardlink_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as links of suppliers' items: lineitem rows are links of part l_partkey."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    links = li.select(F.lit("V:").alias("volume"), F.col("l_partkey").alias("frn"), (F.col("l_orderkey") * 100 + F.col("l_suppkey") * 10000000 + F.col("l_linenumber")).alias("ord"), (F.col("l_linenumber") % 4).cast("int").alias("ns"))
    return raw.pick_link(links)


QUERIES["hardlink_pick"] = hardlink_pick
ORACLE["hardlink_pick"] = """SELECT 'V:' AS volume, frn, (min((CASE WHEN ns IN (1, 3) THEN 0 ELSE 1000000000000000 END) + ord)) % 1000000000000000 AS ord,
CAST(min_by(ns, (CASE WHEN ns IN (1, 3) THEN 0 ELSE 1000000000000000 END) + ord) AS INTEGER) AS ns
FROM (SELECT l_partkey AS frn, l_orderkey * 100 + l_suppkey * 10000000 + l_linenumber AS ord, l_linenumber % 4 AS ns FROM lineitem) WHERE ns <> 2 GROUP BY frn"""


def extension_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = star.records(spark, sf_dir).filter("volume = 'V:'")
    o = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ext = o.select(F.lit("V:").alias("volume"), (1_000_000_000 + F.col("l_orderkey")).alias("base_frn"), F.floor("l_extendedprice").alias("size_bytes"), F.when(F.col("l_linenumber") > 1, F.unix_seconds(F.col("l_shipdate").cast("timestamp"))).alias("mtime"))
    return raw.merge_extensions(base, ext).select("frn", "size_bytes", "mtime", "size_exact")


QUERIES["extension_merge"] = extension_merge
ORACLE["extension_merge"] = f"""WITH r AS ({_RECORDS['V:']}), e AS (SELECT 1000000000 + l_orderkey AS frn, max(CAST(floor(l_extendedprice) AS BIGINT)) AS s, max(CASE WHEN l_linenumber > 1 THEN CAST(epoch(l_shipdate) AS BIGINT) END) AS m FROM lineitem GROUP BY 1)
SELECT r.frn, coalesce(e.s, r.size_bytes) AS size_bytes, coalesce(e.m, r.mtime) AS mtime, r.size_exact OR e.s IS NOT NULL AS size_exact FROM r LEFT JOIN e USING (frn)"""


def root_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.resolve_parents(star.records(spark, sf_dir).filter("volume = 'C:'"), 97).select("frn", "parent_frn")


QUERIES["root_fallback"] = root_fallback
ORACLE["root_fallback"] = f"""WITH r AS ({_RECORDS['C:']}) SELECT frn, CASE WHEN frn = 97 THEN parent_frn WHEN parent_frn = frn OR parent_frn NOT IN (SELECT frn FROM r) OR parent_frn IS NULL THEN 97 ELSE parent_frn END AS parent_frn FROM r"""


def classify_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    j = e.select("event_id", ((F.col("event_id") * 2654435761) % 65536).cast("long").alias("reason"), (F.col("user_id") % 4).alias("source_info"))
    return raw.classify(j.filter(raw.is_structural(F.col("reason"))))


QUERIES["classify_reasons"] = classify_reasons
ORACLE["classify_reasons"] = """SELECT event_id, reason, source_info, CASE WHEN reason & 512 > 0 THEN 'deleted' WHEN reason & 256 > 0 THEN 'created' WHEN reason & 8192 > 0 THEN 'renamed' ELSE 'modified' END AS op, source_info & 2 > 0 AS is_auxiliary
FROM (SELECT event_id, (event_id * 2654435761) % 65536 AS reason, user_id % 4 AS source_info FROM events) WHERE reason & 13056 > 0"""


def own_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.real_changes(star.changes(spark, sf_dir), ["moved_0.dat"]).select("usn", "op", "frn")


QUERIES["own_writes"] = own_writes


def stats_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").alias("price"), (F.col("o_custkey") % 100).alias("cust"))
    return stats.report(li, ["price", "cust"])


QUERIES["stats_percentiles"] = stats_percentiles
ORACLE["stats_percentiles"] = " UNION ALL ".join(
    f"""SELECT '{m}' AS measure, CAST((SELECT sum({e}) FROM orders) AS BIGINT) AS total, CAST((SELECT max({e}) FROM orders) AS BIGINT) AS most,
(SELECT list_sort(list({e}))[count(*) // 2 + 1] FROM (FROM orders ORDER BY o_orderkey DESC LIMIT 1024)) AS p50, (SELECT list_sort(list({e}))[count(*) * 99 // 100 + 1] FROM (FROM orders ORDER BY o_orderkey DESC LIMIT 1024)) AS p99"""
    for m, e in (("price", "CAST(floor(o_totalprice) AS BIGINT)"), ("cust", "o_custkey % 100"))
)

# --- the overlay -------------------------------------------------------------------------------------------------

_CHANGES = """chg AS (SELECT event_id AS usn, op, CASE WHEN op = 'created' THEN 2000000000 + event_id WHEN op = 'renamed' AND event_id % 3 = 0 THEN 2000000000 + event_id - 2 - event_id % 11
    WHEN op = 'deleted' AND event_id % 3 = 1 THEN 2000000000 + event_id - 3 - event_id % 13 ELSE 1000000000 + event_id % 997 END AS frn,
  CASE WHEN event_type = 'purchase' AND event_id - 1 - event_id % 7 IN (SELECT event_id FROM events WHERE event_type = 'signup') THEN 2000000000 + event_id - 1 - event_id % 7 END AS delta_parent,
  1000000 + (SELECT min(c_custkey) FROM customer) + CASE WHEN op = 'renamed' THEN event_id % 2 ELSE user_id % (SELECT count(*) FROM customer) END AS base_parent,
  CASE WHEN event_type = 'signup' THEN 'New_' || event_id WHEN event_type = 'purchase' THEN 'New_' || event_id || '.tmp' WHEN op = 'renamed' THEN 'Moved_' || event_id % 2 || '.dat' END AS name,
  event_type = 'signup' AS is_dir FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'created' WHEN 'click' THEN 'renamed' WHEN 'error' THEN 'deleted' END AS op FROM events) WHERE op IS NOT NULL)"""


def _folding(p: str, source: str) -> str:
    """One step per event of each frn: the state after it. `pref` is the parent as text; null if it is unknown."""
    return f"""{p}seq AS (SELECT s.*, row_number() OVER (PARTITION BY s.frn ORDER BY s.usn) AS i, c.record AS base FROM {source} s LEFT JOIN cat c ON c.frn = s.frn),
{p}st AS (SELECT frn, 0::BIGINT AS i, 0::BIGINT AS usn, NULL::BIGINT AS ver, NULL::VARCHAR AS cname, NULL::VARCHAR AS cref, base IS NOT NULL AS in_base, false AS tomb, false AS makes, false AS lost, false AS from_base, false AS cdir FROM (SELECT DISTINCT frn, base FROM {p}seq)
  UNION ALL SELECT s.frn, s.i, s.usn, CASE WHEN x.mk THEN s.usn WHEN x.op = 'deleted' OR (x.op = 'renamed' AND s.pref IS NULL) THEN NULL ELSE t.ver END,
    CASE WHEN x.mk THEN s.name ELSE t.cname END, CASE WHEN x.mk THEN s.pref ELSE t.cref END, t.in_base, t.tomb OR (t.in_base AND x.op <> 'created'), x.mk, x.ls,
    CASE WHEN x.mk AND x.op = 'created' THEN false WHEN x.mk AND t.ver IS NULL THEN true ELSE t.from_base END, CASE WHEN x.mk AND x.op = 'created' THEN s.is_dir ELSE t.cdir END
  FROM {p}st t JOIN {p}seq s ON s.frn = t.frn AND s.i = t.i + 1,
  LATERAL (SELECT s.op AS op,
    CASE WHEN s.op = 'created' THEN s.pref IS NOT NULL AND t.ver IS NULL AND (NOT t.in_base OR t.tomb)
      WHEN s.op = 'renamed' THEN s.pref IS NOT NULL AND (t.ver IS NOT NULL OR t.in_base) AND NOT (t.ver IS NOT NULL AND t.cname = s.name AND t.cref = s.pref) ELSE false END AS mk,
    CASE WHEN s.op = 'created' THEN s.pref IS NULL AND t.ver IS NULL AND (NOT t.in_base OR t.tomb) WHEN s.op = 'renamed' THEN s.pref IS NULL OR NOT (t.ver IS NOT NULL OR t.in_base) ELSE false END AS ls) x)"""


_FOLD = f"""{_with('V:')}, {_CHANGES},
one AS (SELECT *, base_parent::VARCHAR AS pref FROM chg WHERE frn IN (SELECT frn FROM chg WHERE is_dir) OR delta_parent IS NULL AND frn NOT IN (SELECT frn FROM chg WHERE delta_parent IS NOT NULL)),
{_folding('a', 'one')},
two AS (SELECT c.*, CASE WHEN c.delta_parent IS NULL THEN c.base_parent::VARCHAR ELSE (SELECT 'd' || arg_max(coalesce(a.ver, -1), a.usn) FROM ast a WHERE a.frn = c.delta_parent AND a.i > 0 AND a.usn < c.usn) END AS pref0
  FROM chg c WHERE frn IN (SELECT frn FROM chg WHERE delta_parent IS NOT NULL)),
two2 AS (SELECT * EXCLUDE (pref0), CASE WHEN pref0 = 'd-1' THEN NULL ELSE pref0 END AS pref FROM two),
{_folding('b', 'two2')},
st AS (SELECT * FROM ast UNION ALL SELECT * FROM bst),
fin AS (SELECT frn, arg_max(ver, i) AS ver0, max(i) AS i, bool_or(tomb) AS tomb FROM st GROUP BY frn),
made AS (SELECT s.*, f.record AS base, row_number() OVER (ORDER BY s.usn) - 1 AS idx, coalesce(z.ver = s.usn, false) AS live FROM st s LEFT JOIN cat f ON f.frn = s.frn
  JOIN (SELECT s2.frn, s2.ver FROM st s2 JOIN (SELECT frn, max(i) AS i FROM st GROUP BY frn) m ON m.frn = s2.frn AND m.i = s2.i) z ON z.frn = s.frn WHERE s.makes),
added AS (SELECT 'V:' AS volume, m.idx, m.frn, m.usn, m.cname AS name, CASE WHEN starts_with(m.cref, 'd') THEN 'delta' ELSE 'base' END AS parent_kind,
  CASE WHEN starts_with(m.cref, 'd') THEN q.idx ELSE pb.record END AS parent_idx,
  CASE WHEN m.from_base THEN c.mtime ELSE 0 END AS mtime, CASE WHEN m.from_base THEN c.is_dir ELSE m.cdir END AS is_dir, CASE WHEN m.from_base THEN c.own_kib * 1024 ELSE 0 END AS size_bytes,
  m.from_base AND coalesce(c.size_exact, false) AS size_exact, m.live FROM made m LEFT JOIN cat c ON c.frn = m.frn
  LEFT JOIN made q ON m.cref = 'd' || q.usn LEFT JOIN cat pb ON pb.frn::VARCHAR = m.cref),
tombs AS (SELECT DISTINCT c.record FROM st s JOIN cat c ON c.frn = s.frn WHERE s.tomb),
nb AS (SELECT count(*) AS n FROM cat)"""
_CHANGED = f"""{_FOLD},
v AS (SELECT volume, record, name, lname, is_dir, mtime, rec_kib AS eff, CASE WHEN is_dir THEN rec_kib ELSE own_kib END * 1024 AS size, size_exact, blob, path FROM cat WHERE record NOT IN (SELECT record FROM tombs)
  UNION ALL SELECT a.volume, n + a.idx, a.name, translate(a.name, '{_UP}', '{_LOW}'), a.is_dir, a.mtime, (a.size_bytes + 1023) // 1024, a.size_bytes, a.size_exact,
    CASE WHEN a.parent_kind = 'base' THEN array_to_string(pb.dirs, chr(0)) WHEN p.live AND p.is_dir THEN translate(p.name, '{_UP}', '{_LOW}') || chr(0) || array_to_string(gb.dirs, chr(0)) ELSE '' END,
    CASE WHEN a.parent_kind = 'base' THEN pb.path ELSE gb.path || '\\' || p.name END || '\\' || a.name
  FROM added a CROSS JOIN nb LEFT JOIN cat pb ON a.parent_kind = 'base' AND pb.record = a.parent_idx LEFT JOIN added p ON a.parent_kind = 'delta' AND p.idx = a.parent_idx LEFT JOIN cat gb ON gb.record = p.parent_idx
  WHERE a.live)"""


def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).added


def tombstone_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).tombstones


def reindex_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir).reindex


QUERIES |= {"event_fold": event_fold, "tombstone_view": tombstone_view, "reindex_events": reindex_events}
ORACLE["event_fold"] = f"{_FOLD} SELECT * FROM added"
ORACLE["tombstone_view"] = f"{_FOLD} SELECT 'V:' AS volume, record FROM tombs"
ORACLE["reindex_events"] = f"{_FOLD} SELECT 'V:' AS volume, usn, frn FROM st WHERE lost"


def view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir).select("volume", "record", "path", "size", "mtime", "is_dir", "size_exact")


QUERIES["view_rows"] = view_rows
ORACLE["view_rows"] = f"{_CHANGED} SELECT volume, record, path, size, mtime, is_dir, size_exact FROM v"
for _n, _text, _where, _quality, _kind in (
    ("delta_search", "moved", "contains(lname, 'moved')", _name_quality("moved"), "substring"),
    ("delta_path_terms", "asia new_1", f"{_has('asia')} AND {_has('new_1')}", _missing("asia", "new_1"), None),
    ("rename_visible", "customer#00000000 dat type:file", f"{_has('customer#00000000')} AND {_has('dat')} AND NOT is_dir", _missing("customer#00000000", "dat"), None),
):
    QUERIES[_n] = lambda spark, sf_dir, t=_text, k=_kind: _found(changed(spark, sf_dir), qlang.to_query(t, NOW, k), limit=2000)
    ORACLE[_n] = f"{_CHANGED} {_top(_where, _quality, limit=2000)}"


def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(spark, sf_dir).select("volume", "record", "frn", "name", "path", "rec_kib", "size_exact", "dfs_pos", "subtree_len")


def compaction_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(spark, sf_dir).filter("tree_parent is null").select("volume", "record", "frn", "name")


_NEXT = f"""{_FOLD}, nxt AS (SELECT c.volume, c.record AS ord, c.frn, CASE WHEN p.record NOT IN (SELECT record FROM tombs) THEN p.frn END AS parent_frn, c.name, c.is_dir, c.mtime, c.own_kib * 1024 AS size_bytes, r.size_exact
    FROM cat c JOIN num r ON r.record = c.record LEFT JOIN cat p ON p.record = c.parent WHERE c.record NOT IN (SELECT record FROM tombs)
  UNION ALL SELECT a.volume, n + a.idx, a.frn, CASE WHEN a.parent_kind = 'base' THEN CASE WHEN pb.record NOT IN (SELECT record FROM tombs) THEN pb.frn END WHEN p.live THEN p.frn END, a.name, a.is_dir, a.mtime, a.size_bytes, a.size_exact
    FROM added a CROSS JOIN nb LEFT JOIN cat pb ON a.parent_kind = 'base' AND pb.record = a.parent_idx LEFT JOIN added p ON a.parent_kind = 'delta' AND p.idx = a.parent_idx WHERE a.live),
{_cat("SELECT * FROM nxt", "n_", "ord")}"""
QUERIES |= {"compaction": compaction, "compaction_orphans": compaction_orphans}
ORACLE["compaction"] = f"{_NEXT} SELECT volume, record, frn, name, path, rec_kib, size_exact, dfs_pos, subtree_len FROM n_cat"
ORACLE["compaction_orphans"] = f"{_NEXT} SELECT volume, record, frn, name FROM n_cat WHERE tree_parent IS NULL"


# --- interval sets, scans and counts -----------------------------------------------------------------------------

_ISLANDS = "SELECT volume, min(dfs_pos) AS start, max(dfs_pos) + 1 AS \"end\" FROM (SELECT volume, dfs_pos, dfs_pos - row_number() OVER (PARTITION BY volume ORDER BY dfs_pos) AS i FROM cat WHERE {0}) GROUP BY volume, i"


def _in_or_below(term: str) -> str:
    """SQL: a record that is a directory with the term in its name, or lies below one."""
    return f"(contains(blob, '{term}') OR is_dir AND contains(lname, '{term}'))"


def term_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.term_intervals(catalog(spark, sf_dir), "a")


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return intervals.union(intervals.term_intervals(c, "nation_1"), intervals.term_intervals(c, "blue"))


def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return intervals.intersect(intervals.term_intervals(c, "a"), intervals.term_intervals(c, "1"))


def interval_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return intervals.inside(c.select("volume", "record", "dfs_pos"), intervals.term_intervals(c, "n1")).select("volume", "record", "dfs_pos")


def term_set_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term query with a filter, by one sweep a term."""
    return intervals.below_terms(catalog(spark, sf_dir), qlang.to_query("a 1 type:file size:>1kb", NOW)).select("volume", "record", "path")


QUERIES |= {"term_intervals": term_intervals, "interval_union": interval_union, "interval_intersection": interval_intersection, "interval_members": interval_members, "term_set_search": term_set_search}
ORACLE["term_intervals"] = f"{_ALL} {_ISLANDS.format(_in_or_below('a'))}"
ORACLE["interval_union"] = f"{_ALL} {_ISLANDS.format(_in_or_below('nation_1') + ' OR ' + _in_or_below('blue'))}"
ORACLE["interval_intersection"] = f"{_ALL} {_ISLANDS.format(_in_or_below('a') + ' AND ' + _in_or_below('1'))}"
ORACLE["interval_members"] = f"{_ALL} SELECT volume, record, dfs_pos FROM cat WHERE {_in_or_below('n1')}"
ORACLE["term_set_search"] = f"{_ALL} SELECT volume, record, path FROM cat WHERE {_has('a')} AND {_has('1')} AND NOT is_dir AND size_exact AND rec_kib * 1024 >= 1025"


def scan_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.scan(X.base_view(_of(catalog(spark, sf_dir), "V:")), qlang.to_query("asia 3", NOW), 500)


def scan_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is over the number of matches, so any first matches are all of them."""
    return X.scan(X.base_view(catalog(spark, sf_dir)), qlang.to_query("n77", NOW, "substring"), X.MAX_LIMIT, in_order=False)


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(Catalog(catalog(spark, sf_dir))).counts("order_1", "prefix", 200)


def live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed(spark, sf_dir).groupBy("volume").agg(F.count(F.lit(1)).alias("live"))


def live_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinals.live_ranks(_of(catalog(spark, sf_dir), "V:"), folded(spark, sf_dir).tombstones)


def dfs_running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of all records before each one in preorder: a subtree's sum is the difference of two of them."""
    rows = catalog(spark, sf_dir).select("volume", "record", "dfs_pos", "own_kib")
    return ordinals.ranked(rows, ["dfs_pos"], "dfs_pos", running={"kib_before": "own_kib"}).select("volume", "record", "dfs_pos", "kib_before")


def child_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.children(catalog(spark, sf_dir))


def overlay_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additions of a stored overlay, checked and read back."""
    path = fresh_path(spark, "stored-overlay")
    snapshots.save_overlay(folded(spark, sf_dir), path, base=1, next_usn=0)
    return snapshots.load_overlay(spark, path, _of(catalog(spark, sf_dir), "V:"), 1)[0].added


QUERIES |= {"scan_in_order": scan_in_order, "scan_any": scan_any, "candidate_counts": candidate_counts, "live_count": live_count, "live_ranks": live_ranks, "dfs_running_size": dfs_running_size, "child_table": child_table, "overlay_round_trip": overlay_round_trip}
ORACLE["scan_in_order"] = f"{_with('V:')} SELECT volume, record, name FROM cat WHERE {_has('asia')} AND {_has('3')} ORDER BY record LIMIT 500"
ORACLE["scan_any"] = f"{_ALL} SELECT volume, record, name FROM cat WHERE contains(lname, 'n77')"
ORACLE["candidate_counts"] = f"{_ALL} SELECT count(*) AS seen, count(*) FILTER (starts_with(lname, 'order_1')) AS candidates, least(200, count(*) FILTER (starts_with(lname, 'order_1'))) AS emitted FROM cat"
ORACLE["live_count"] = f"{_CHANGED} SELECT volume, count(*) AS live FROM v GROUP BY volume"
ORACLE["live_ranks"] = f"""{_FOLD} SELECT volume, record, before AS dead_before, CASE WHEN dead = 0 THEN record - before END AS live_rank FROM (SELECT *, CAST(coalesce(sum(dead) OVER (PARTITION BY volume ORDER BY record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
FROM (SELECT volume, record, CAST(record IN (SELECT record FROM tombs) AS INTEGER) AS dead FROM cat))"""
ORACLE["dfs_running_size"] = f"{_ALL} SELECT volume, record, dfs_pos, CAST(coalesce(sum(own_kib) OVER (PARTITION BY volume ORDER BY dfs_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS kib_before FROM cat"
ORACLE["child_table"] = f"{_ALL} SELECT volume, tree_parent AS record, count(*) AS n_children, min(record) AS first_child, max(record) AS last_child FROM cat WHERE tree_parent IS NOT NULL GROUP BY ALL"
ORACLE["overlay_round_trip"] = ORACLE["event_fold"]


# --- readers and display -----------------------------------------------------------------------------------------


def usn_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.unsized(star.records(spark, sf_dir)).select("volume", "frn", "parent_frn", "name", "is_dir", "size_bytes", "size_exact")


def lossy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as little-endian UTF-16, some with half a surrogate pair or an odd byte at the end, decoded again."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k = F.col("conv_id") % 4
    tail = F.when(k == 0, F.unhex(F.lit("3DD8"))).when(k == 1, F.unhex(F.lit("00DE3DD800DE"))).when(k == 2, F.unhex(F.lit("41"))).otherwise(F.unhex(F.lit("")))
    return c.select("conv_id", "turn", raw.decode_name(F.concat(F.encode(F.col("text"), "UTF-16LE"), tail)).alias("name"))


def name_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.names_in(catalog(spark, sf_dir), "V:", 100, 1600)


def name_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.lit("V:").alias("volume"), (F.col("l_partkey") * 3).alias("record"))
    return snapshots.name_of(catalog(spark, sf_dir), wanted)


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return raw.link_counts(li.select(F.lit("V:").alias("volume"), F.col("l_partkey").alias("frn"), (F.col("l_linenumber") % 4).cast("int").alias("ns")))


def marked_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = S.display_path(F.col("path"), F.col("is_dir"), "\\")
    return catalog(spark, sf_dir).select("volume", "record", shown.alias("shown"), S.display_size(F.col("rec_kib") * 1024, F.col("is_dir"), F.col("size_exact")).alias("size"))


QUERIES |= {"usn_listing": usn_listing, "lossy_names": lossy_names, "name_range": name_range, "name_of": name_of, "link_counts": link_counts, "marked_path": marked_path}
ORACLE["usn_listing"] = "SELECT volume, frn, parent_frn, name, is_dir, 0::BIGINT AS size_bytes, false AS size_exact FROM (" + " UNION ALL ".join(f"({r})" for r in _RECORDS.values()) + ")"
ORACLE["lossy_names"] = "SELECT conv_id, turn, text || CASE conv_id % 4 WHEN 0 THEN chr(65533) WHEN 1 THEN chr(65533) || chr(128512) ELSE '' END AS name FROM conversations"
ORACLE["name_range"] = f"{_with('V:')} SELECT record, name FROM cat WHERE record BETWEEN 100 AND 1599"
ORACLE["name_of"] = f"{_with('V:')} SELECT volume, record, name FROM cat WHERE record IN (SELECT l_partkey * 3 FROM lineitem)"
ORACLE["link_counts"] = "SELECT count(*) AS seen, count(*) FILTER (l_linenumber % 4 = 2) AS short_names, count(*) FILTER (l_linenumber % 4 <> 2) AS emitted, count(DISTINCT l_partkey) FILTER (l_linenumber % 4 <> 2) AS records FROM lineitem"
ORACLE["marked_path"] = f"""{_ALL} SELECT volume, record, path || CASE WHEN is_dir THEN chr(92) ELSE '' END AS shown,
CASE WHEN size_exact THEN {_SHOWN.format('(rec_kib * 1024)')} WHEN is_dir AND rec_kib > 0 THEN '≥' || {_SHOWN.format('(rec_kib * 1024)')} ELSE '—' END AS size FROM cat"""
ORACLE["own_writes"] = f"""WITH {_CHANGES},
e AS (SELECT event_id AS usn, op, frn, name, op IN ('created', 'renamed') AS named, coalesce(lower(name) = 'moved_0.dat', false) AS own FROM (SELECT usn AS event_id, * EXCLUDE (usn) FROM chg)),
m AS (SELECT *, last_value(CASE WHEN op = 'deleted' THEN false WHEN named AND own THEN true END IGNORE NULLS) OVER (PARTITION BY frn ORDER BY usn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mine FROM e)
SELECT usn, op, frn FROM m WHERE named AND NOT own OR op = 'deleted' AND NOT coalesce(mine, false)"""
