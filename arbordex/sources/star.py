"""Catalog records derived from the star-schema test tables, and a change log from their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = {"V:": 0, "P:": 1, "D:": 2, "C:": 3}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(volume: str, frn, parent, name, is_dir: bool, mtime, size, exact) -> list:  # noqa: ANN001
    col = lambda x, kind: (F.lit(x) if not hasattr(x, "alias") else x).cast(kind)
    return [
        F.lit(volume).alias("volume"), col(frn, "long").alias("ord"), col(frn, "long").alias("frn"), col(parent, "long").alias("parent_frn"), col(name, "string").alias("name"),
        F.lit(is_dir).alias("is_dir"), col(mtime, "long").alias("mtime"), col(size, "long").alias("size_bytes"), col(exact, "boolean").alias("size_exact"),
    ]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes V: (regions to orders), P: (parts by type and brand), D: (documents by language and source), C: (a graph
    of part keys with cycles, self-pointers and dangling parents)."""
    region, nation, customer, orders, part, documents, labels = (_t(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders", "part", "documents", "labels"))
    c = F.col
    one = spark.range(1)
    v = [
        one.select(*_row("V:", 1, None, "V:", True, 0, 0, True)),
        region.select(*_row("V:", 10 + c("r_regionkey"), 1, c("r_name"), True, 0, 0, True)),
        nation.select(*_row("V:", 100 + c("n_nationkey"), 10 + c("n_regionkey"), c("n_name"), True, 0, 0, True)),
        customer.select(*_row("V:", 1_000_000 + c("c_custkey"), 100 + c("c_nationkey"), c("c_name"), True, 0, 0, True)),
        orders.select(
            *_row(
                "V:", 1_000_000_000 + c("o_orderkey"), 1_000_000 + c("o_custkey"),
                F.concat(F.lit("Order_"), c("o_orderkey").cast("string"), F.lit("."), F.lower(F.substring("o_orderpriority", 3, 10))), False,
                F.unix_seconds(c("o_orderdate").cast("timestamp")), F.floor("o_totalprice"), c("o_orderstatus") != "P",
            )
        ),
    ]
    key = lambda *x: F.conv(F.substring(F.md5(F.concat_ws("/", *x)), 1, 12), 16, 10).cast("long") + (1 << 50)
    p = [
        one.select(*_row("P:", 1, None, "P:", True, 0, 0, True)),
        part.select("p_type").distinct().select(*_row("P:", key(F.lit("t"), "p_type"), 1, c("p_type"), True, 0, 0, True)),
        part.select("p_type", "p_brand").distinct().select(*_row("P:", key(F.lit("b"), "p_type", "p_brand"), key(F.lit("t"), "p_type"), c("p_brand"), True, 0, 0, True)),
        part.select(*_row("P:", c("p_partkey") + 1_000_000, key(F.lit("b"), "p_type", "p_brand"), F.concat_ws("", "p_name", F.lit("_"), c("p_partkey").cast("string"), F.lit("."), c("p_size").cast("string")), False, 0, F.floor(c("p_retailprice") * 1000), True)),
    ]
    known = labels.select(c("doc_id").alias("__l")).distinct()
    docs = documents.join(known, c("doc_id") == c("__l"), "left")
    d = [
        one.select(*_row("D:", 1, None, "D:", True, 0, 0, True)),
        documents.select("lang").distinct().select(*_row("D:", key(F.lit("l"), "lang"), 1, c("lang"), True, 0, 0, True)),
        documents.select("lang", "source").distinct().select(*_row("D:", key(F.lit("s"), "lang", "source"), key(F.lit("l"), "lang"), c("source"), True, 0, 0, True)),
        docs.select(*_row("D:", c("doc_id") + 1_000_000, key(F.lit("s"), "lang", "source"), F.concat(F.lit("doc_"), c("doc_id").cast("string"), F.lit(".txt")), False, 0, c("n_chars"), c("__l").isNotNull())),
    ]
    pk = c("p_partkey")
    raw = F.when(pk % 97 == 0, None).when(pk % 89 == 0, pk).when(pk % 83 == 0, F.lit(999_999_999)).otherwise((pk * 7919 + 13) % 1999 + 1)
    g = [part.select(*_row("C:", pk, raw, F.concat(F.lit("n"), ((pk * 31) % 101).cast("string")), True, 0, pk, True))]
    rows = [*v, *p, *d, *g]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log of V: from events, in order of event_id.

    Signups create directories under customers; purchases create files in the directory of an earlier signup, or under a
    customer if the event that they point at is none; clicks rename and errors delete orders and earlier additions (some
    of them unknown ids); views modify. A few names repeat, so that some renames change nothing.
    """
    e = _t(spark, sf_dir, "events")
    keys = _t(spark, sf_dir, "customer").agg(F.min("c_custkey"), F.count(F.lit(1))).first()  # two numbers
    c = F.col
    op = F.create_map(*[F.lit(x) for kv in {"signup": "created", "purchase": "created", "click": "renamed", "error": "deleted", "view": "modified"}.items() for x in kv])[c("event_type")]
    signups = e.filter("event_type = 'signup'").select(c("event_id").alias("__s"))
    e = e.withColumn("__s", c("event_id") - 1 - c("event_id") % 7)
    e = e.join(signups.withColumn("__is", F.lit(True)), "__s", "left")
    customer = 1_000_000 + keys[0] + c("user_id") % keys[1]
    order = 1_000_000_000 + c("event_id") % 997
    earlier = lambda a, b: 2_000_000_000 + c("event_id") - a - c("event_id") % b
    frn = F.when(op == "created", 2_000_000_000 + c("event_id")).when((op == "renamed") & (c("event_id") % 3 == 0), earlier(2, 11)).when((op == "deleted") & (c("event_id") % 3 == 1), earlier(3, 13)).otherwise(order)
    parent = F.when((c("event_type") == "purchase") & c("__is"), 2_000_000_000 + c("__s")).when(op == "renamed", 1_000_000 + keys[0] + c("event_id") % 2).otherwise(customer)
    created = F.concat(F.lit("New_"), c("event_id").cast("string"), F.when(c("event_type") == "signup", "").otherwise(".tmp"))
    moved = F.concat(F.lit("Moved_"), (c("event_id") % 2).cast("string"), F.lit(".dat"))
    return e.select(
        F.lit("V:").alias("volume"), c("event_id").cast("long").alias("usn"), op.alias("op"), frn.cast("long").alias("frn"),
        F.when(op.isin("created", "renamed"), parent).cast("long").alias("parent_frn"), F.when(op == "created", created).when(op == "renamed", moved).alias("name"),
        F.when(op == "created", c("event_type") == "signup").alias("is_dir"), F.lit(False).alias("is_auxiliary"), (c("event_id") + 1).cast("long").alias("next_usn"),
    )
