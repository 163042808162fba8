"""Problem 1: references to records that do not exist.

Parents and children of any number of tables are brought into one long form of tagged keys. Rows are grouped by parent
table and key and read in order of time: recordings of a parent open it, deletions close it, and a reference made while
no recording is open lacks its parent. Keys with very many rows (a hub site, a default value) are cut into slices of
time with about equal numbers of rows; each slice starts from the number of recordings left open by the slices before,
which is summed up per slice first. A slice that is but one moment with very many references is salted: its references
are spread, and the few changes of the parent at that moment go to each part. So no task gets a whole hot key.

Defined results
---------------
* A null or blank name is no reference and gives no row.
* A reference whose scope or time is null can't be resolved and is an orphan (period null).
* A parent without a start time, or closed at or before its start, never exists.
* Repeated child rows each give a row; repeated parent rows change nothing.
* Empty parents: every reference is an orphan. Empty children: no rows.
* Children name the table of their parents; parents of other tables never match them.
* Columns beyond those named are neither read nor returned, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.tables import name_key

#: Keys with fewer rows than this are never cut; the bound grows with all rows, so at most about MOST_HOT keys are cut into as
#: many slices in all, which bounds what is broadcast.
HOT_ROWS, MOST_HOT = 100_000, 10_000
#: Rows of a key at the bound that the sample for finding hot keys should hold. The sample decides on the cut only.
SAMPLE_ROWS = 1_000
#: Groups that references without a scope or time are spread over.
UNRESOLVED_PARTS = 1_024


@dataclass(frozen=True)
class References:
    """A child table: its row id, the columns that name parents (side -> column), their scope and time, and the parents' table."""

    rows: DataFrame
    row_id: str
    refs: Mapping[str, str]
    scope: str
    at: str
    parent_table: str
    child_table: str = ""


@dataclass(frozen=True)
class Parents:
    """A parent table: its name, the columns of scope and name, and the times from and until which a row exists."""

    rows: DataFrame
    table: str
    scope: str
    name: str
    start: str
    end: str


def _tagged_children(c: References, id_type: str) -> DataFrame:
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(n).alias("name")) for s, n in c.refs.items())))
    rows = c.rows.select(F.col(c.row_id).cast(id_type).alias("row_id"), F.col(c.scope).alias("scope"), F.col(c.at).alias("at"), sides.alias("ref"))
    return rows.select(
        F.lit(c.parent_table).alias("parent_table"), "scope", name_key(F.col("ref.name")).alias("key"), "at", F.lit(0).alias("change"), "row_id", F.col("ref.side").alias("side"), F.lit(c.child_table).alias("child_table")
    ).filter("key is not null")


def _tagged_parents(p: Parents, id_type: str) -> DataFrame:
    """One row for each opening (+1) and closing (-1) of a parent."""
    rows = p.rows.select(F.col(p.scope).alias("scope"), name_key(F.col(p.name)).alias("key"), F.col(p.start).alias("s"), F.col(p.end).alias("e"))
    rows = rows.filter("scope is not null and key is not null and s is not null and (e is null or e > s)")
    both = F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("change")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("change"))))
    none = lambda kind: F.lit(None).cast(kind)
    rows = rows.select(F.lit(p.table).alias("parent_table"), "scope", "key", both.alias("x"))
    return rows.select("parent_table", "scope", "key", "x.at", "x.change", none(id_type).alias("row_id"), none("string").alias("side"), none("string").alias("child_table")).filter("at is not null")


def _slices(long: DataFrame, hot_rows: int) -> DataFrame | None:
    """Hashes of hot keys with the ends of their slices in time, from a sample, or None. Two keys with one hash are both cut."""
    share = min(1.0, SAMPLE_ROWS / hot_rows)
    keys = long.filter("scope is not null and at is not null").select(F.xxhash64("parent_table", "scope", "key").alias("h"), "at")
    keys = keys.sample(share, seed=1) if share < 1 else keys
    counts = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot_rows * share)
    if counts.isEmpty():
        return None
    step = max(1, int(hot_rows * share / 2))
    order = Window.partitionBy("h").orderBy("at")
    ends = keys.join(counts, "h").withColumn("i", F.row_number().over(order)).filter(F.col("i") % step == 0)
    return ends.groupBy("h").agg(F.sort_array(F.collect_list("at")).alias("ends"))


def find_orphans(children: Sequence[References], parents: Sequence[Parents], *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """References of the children without a parent of their table, scope and name at their time, in one pass over all tables.

    Returns row_id (as text if the children's ids have several types), side, child_table, parent_table, scope, key, at,
    period (month) and seen_before (a recording was open earlier).
    """
    types = {c.rows.schema[c.row_id].dataType.simpleString() for c in children}
    id_type = types.pop() if len(types) == 1 else "string"
    tagged = [_tagged_children(c, id_type) for c in children] + [_tagged_parents(p, id_type) for p in parents]
    long = reduce(DataFrame.unionAll, tagged)
    total = sum(c.rows.count() * len(c.refs) for c in children)
    hot = _slices(long, max(hot_rows, total // MOST_HOT)) if total >= hot_rows else None
    # references that can't be resolved meet no parent, in groups of their own
    lost = F.col("scope").isNull() | F.col("at").isNull()
    salt = F.when(lost, -1 - F.pmod(F.xxhash64("row_id", "side"), F.lit(UNRESOLVED_PARTS)).cast("int")).otherwise(0)
    long = long.withColumns({"slice": F.lit(0), "salt": salt})
    if hot is not None:
        # at most MOST_HOT ends for each hot_rows rows of the key
        long = long.withColumn("h", F.xxhash64("parent_table", "scope", "key")).join(F.broadcast(hot), "h", "left").drop("h")
        before = F.size(F.filter("ends", lambda e: e < F.col("at")))
        parts = F.greatest(F.size(F.filter("ends", lambda e: e == F.get(F.col("ends"), F.col("slice")))), F.lit(1))
        cut = F.col("ends").isNotNull() & ~lost
        long = long.withColumn("slice", F.when(cut, before).otherwise(0)).withColumn("parts", F.when(cut, parts).otherwise(1)).drop("ends")
    key = ["parent_table", "scope", "key", "slice"]
    seen = F.max(F.when(F.col("change") > 0, 1).otherwise(0))
    if hot is not None:
        sums = long.filter("change <> 0").groupBy(*key).agg(F.sum("change").alias("d"), seen.alias("s"))
        cuts = long.filter("parts > 1 or slice > 0").select(*key).distinct()
        earlier = Window.partitionBy(*key[:3]).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        states = sums.unionByName(cuts.select(*key, F.lit(0).cast("bigint").alias("d"), F.lit(0).alias("s"))).groupBy(*key).agg(F.sum("d").alias("d"), F.max("s").alias("s"))
        carry = states.select(*key, F.sum("d").over(earlier).alias("open0"), F.max("s").over(earlier).alias("seen0")).filter("open0 <> 0 or seen0 <> 0")
        # references go to one part of a salted slice, changes of the parent to all of them
        spread = F.when(F.col("change") == 0, F.array(F.pmod(F.xxhash64("row_id", "side"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        long = long.withColumn("salt", F.explode(F.when(F.col("salt") < 0, F.array("salt")).otherwise(spread))).drop("parts")
    order = Window.partitionBy(*key, "salt").orderBy("at", F.when(F.col("change") == 0, 1).otherwise(0))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    read = long.withColumns({"open": F.sum("change").over(so_far), "seen": seen.over(so_far)}).filter("change = 0")
    if hot is not None:
        read = read.join(carry, key, "left")  # rows without a scope have no carry
        read = read.withColumns({"open": F.col("open") + F.coalesce("open0", F.lit(0)), "seen": F.greatest("seen", F.coalesce("seen0", F.lit(0)))})
    orphans = read.filter("open = 0").withColumn("seen_before", F.col("seen") > 0)
    return orphans.select("row_id", "side", "child_table", "parent_table", "scope", "key", "at", F.date_format("at", "yyyy-MM").alias("period"), "seen_before")


def orphan_references(
    child: DataFrame, parent: DataFrame, *, row_id: str, refs: Mapping[str, str], child_scope: str, at: str,
    parent_scope: str, parent_name: str, start: str, end: str, parent_table: str, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """find_orphans of one child table against one parent table.

    Returns row_id, side, parent_table, scope, key, at, period (month) and seen_before (a recording was open earlier).
    """
    kids, folks = References(child, row_id, refs, child_scope, at, parent_table), Parents(parent, parent_table, parent_scope, parent_name, start, end)
    return find_orphans([kids], [folks], hot_rows=hot_rows).drop("child_table")


def orphan_report(orphans: DataFrame, parent: DataFrame, *, parent_scope: str, parent_name: str) -> DataFrame:
    """Orphans per parent table, side, period and cause.

    Causes: deleted (recorded earlier), not_yet_recorded (recorded only later or never validly), unknown (no such key).
    """
    per_key = orphans.groupBy("parent_table", "side", "scope", "key", "period", "seen_before").agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_scope).alias("scope"), name_key(F.col(parent_name)).alias("key"), F.lit(True).alias("known"))
    known = known.filter("scope is not null and key is not null").distinct()
    cause = F.when(F.col("seen_before"), "deleted").when(F.col("known"), "not_yet_recorded").otherwise("unknown")
    joined = per_key.join(known, ["scope", "key"], "left").withColumn("cause", cause)
    return joined.groupBy("parent_table", "side", "period", "cause").agg(F.sum("n").alias("orphan_refs"), F.count(F.lit(1)).alias("missing_keys"))
