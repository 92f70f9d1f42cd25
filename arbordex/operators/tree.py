"""From canonical records to a catalog: ordinals, canonical parents, paths, preorder, subtree aggregates.

Raw parents may be missing, dangling, self-pointing or cyclic. A record's tree parent is its raw parent if its chain
reaches a root; under a cycle, it is kept only if some proper ancestor has a smaller record number (else the record is
a pseudo-root). Ancestor chains come from pointer doubling: each round a row takes over the chain of the row that it
points at, so depth d costs log2(d) self-joins; rows on cycles never run out of pointers, and are told by that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbordex.functions import scalars as S
from arbordex.operators.ordinals import ranked
from arbordex.storage import if_small, release, scratch, written

SEPARATOR = "\\"
MAX_COMPONENTS = 512

RECORDS = "volume string, ord long, frn long, parent_frn long, name string, is_dir boolean, mtime long, size_bytes long, size_exact boolean"
COLUMNS = "volume record frn ord name lname is_dir mtime own_kib own_exact parent tree_parent anc path dir_blob rec_kib size_exact subtree_len dfs_pos dfs_end".split()


def with_ordinals(records: DataFrame) -> DataFrame:
    """Records numbered by folded name, ties by insertion order; raw parents as record numbers (null: none or dangling)."""
    rows = records.select(
        "volume", "ord", "frn", "parent_frn", "name", S.lname(F.col("name")).alias("lname"), "is_dir", "mtime", S.kib(F.col("size_bytes")).alias("own_kib"), F.col("size_exact").alias("own_exact")
    )
    rows = written(ranked(rows, ["lname", "ord"], "record"), "records")
    named = rows.select("volume", F.col("frn").alias("parent_frn"), F.col("record").alias("parent"))
    return rows.join(named, ["volume", "parent_frn"], "left")


def canonical_parents(rows: DataFrame) -> DataFrame:
    """(volume, record, tree_parent, pseudo) from (volume, record, parent).

    Only rows whose chain is open are carried: one that points at a settled row is settled too. A chain settles in the
    logarithm of its length, level by level, so a round that settles nothing has rows on and below cycles only; those go
    on until no smallest ancestor changes.
    """
    start = rows.select("volume", "record", F.when(F.col("parent") != F.col("record"), F.col("parent")).alias("parent"))
    open_ = written(start.filter("parent is not null").select("volume", "record", F.col("parent").alias("up"), F.col("parent").alias("least"), F.lit(True).alias("moved")), "pointers")
    n = open_.count()
    while n:
        far = open_.select("volume", F.col("record").alias("up"), F.col("up").alias("__up"), F.col("least").alias("__least"))
        step = open_.join(far, ["volume", "up"]).select("volume", "record", F.col("__up").alias("up"), F.least("least", "__least").alias("least"), (F.col("__least") < F.col("least")).alias("moved"))
        new = written(step, "pointers")
        left, moved = new.agg(F.count(F.lit(1)), F.max("moved")).first()
        release(open_)
        settled, open_, n = n - left, new, left
        if not settled and not moved:
            break
    ringed = if_small(open_.select("volume", "record", (F.col("least") < F.col("record")).alias("__kept")))
    kept = F.coalesce("__kept", F.lit(True))
    return start.join(ringed, ["volume", "record"], "left").select("volume", "record", F.when(kept, F.col("parent")).alias("tree_parent"), (~kept).alias("pseudo"))


def chains(rows: DataFrame) -> DataFrame:
    """(volume, record, chain): structs (r, name, d) from the root to the record, from acyclic tree_parent.

    Settled rows are written once; each round carries the open ones.
    """
    one = F.array(F.struct(F.col("record").alias("r"), "name", F.col("is_dir").alias("d")))
    first = rows.select("volume", "record", F.col("tree_parent").alias("up"), one.alias("chain"))
    done, open_ = first.filter("up is null"), first.filter("up is not null")
    while open_.limit(1).count():
        far = done.unionByName(open_).select("volume", F.col("record").alias("up"), F.col("up").alias("__up"), F.col("chain").alias("__chain"))
        # Few rows are open after some rounds: they go to the settled ones, which then need not move.
        new = written(far.join(if_small(open_), ["volume", "up"]).select("volume", "record", F.col("__up").alias("up"), F.concat("__chain", "chain").alias("chain")), "chains")
        done, open_ = done.unionByName(new.filter("up is null")), new.filter("up is not null")
    return done.select("volume", "record", "chain")


def path_of(chain: Column) -> Column:
    """At most the last 512 components, without those that are '.', joined by the separator."""
    tail = F.when(F.size(chain) > MAX_COMPONENTS, F.slice(chain, -MAX_COMPONENTS, MAX_COMPONENTS)).otherwise(chain)
    return F.array_join(F.filter(F.transform(tail, lambda x: x["name"]), lambda x: x != "."), SEPARATOR)


def dir_blob(chain: Column) -> Column:
    """Folded names of the proper ancestors that are directories, separated by NUL."""
    above = F.filter(chain, lambda x, i: (i < F.size(chain) - 1) & x["d"])
    return F.array_join(F.transform(above, lambda x: S.lname(x["name"])), "\x00")


def aggregates(rows: DataFrame) -> DataFrame:
    """(volume, record, rec_kib, subtree_len, all_exact) over each record's subtree, itself included."""
    part = rows.select("volume", F.explode("anc").alias("record"), "own_kib", (F.col("is_dir") | F.col("own_exact")).alias("known"))
    total = part.groupBy("volume", "record").agg(F.sum("own_kib").alias("__kib"), F.count(F.lit(1)).alias("subtree_len"), F.bool_and("known").alias("all_exact"))
    return total.select("volume", "record", F.least("__kib", F.lit(S.U32_MAX)).alias("rec_kib"), "subtree_len", "all_exact")


def build(records: DataFrame) -> DataFrame:
    """The catalog (see COLUMNS) of canonical records, any number of volumes, as a table in the shared folder."""
    with scratch() as keep:
        return keep(_built(records))


def _built(records: DataFrame) -> DataFrame:
    rows = written(with_ordinals(records), "numbered")
    parents = canonical_parents(rows.select("volume", "record", "parent"))
    rows = rows.join(parents, ["volume", "record"])
    rows = written(rows.join(chains(rows), ["volume", "record"]).withColumn("anc", F.transform("chain", lambda x: x["r"])), "placed")
    roots = if_small(rows.filter("pseudo").select("volume", F.col("record").alias("__root"), F.lit(True).alias("__late")))
    sized = rows.join(aggregates(rows), ["volume", "record"])
    sized = sized.withColumn("__root", F.element_at("anc", 1)).join(roots, ["volume", "__root"], "left").withColumn("__late", F.coalesce("__late", F.lit(False)))
    sized = written(sized, "sized")  # a range partitioning samples its input first: it must not be made twice
    rows = ranked(sized, ["__late", "anc"], "dfs_pos")
    built = rows.select(
        "volume", "record", "frn", "ord", "name", "lname", "is_dir", "mtime", "own_kib", "own_exact", "parent", "tree_parent", "anc",
        path_of(F.col("chain")).alias("path"), dir_blob(F.col("chain")).alias("dir_blob"), "rec_kib",
        F.when(F.col("is_dir"), F.col("all_exact")).otherwise(F.col("own_exact")).alias("size_exact"),
        "subtree_len", "dfs_pos", (F.col("dfs_pos") + F.col("subtree_len")).alias("dfs_end"),
    )
    return written(built, "built")


def children(catalog: DataFrame) -> DataFrame:
    """(volume, record, n_children, first_child, last_child) of every record with children in the tree."""
    below = catalog.filter("tree_parent is not null").groupBy("volume", F.col("tree_parent").alias("record"))
    return below.agg(F.count(F.lit(1)).alias("n_children"), F.min("record").alias("first_child"), F.max("record").alias("last_child"))


def descendants(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """(volume, root, record) for every record in the subtree of each root (volume, record), itself included.

    An equi-join on exploded ancestors: no range join, and no row for pairs that don't contain each other.
    """
    asked = if_small(roots.select("volume", F.col("record").alias("root")))
    return catalog.select("volume", "record", F.explode("anc").alias("root")).join(asked, ["volume", "root"]).select("volume", "root", "record")
