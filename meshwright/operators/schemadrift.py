"""Problem 4: schemas that drift between files.

Each file's schema is a tagged union: per field (path) the set of alternatives, i.e. JSON types, its values take. Schemas
of a feed's files are fused in order of file_seq; alternatives that appear or vanish, and fields that appear, vanish or
change their name, are the changes. Values of conflicting types are kept in typed branches beside their canonical
conversion in one consistent table.

Defined results
---------------
* Field names are trimmed and in lower case; blank names are dropped. If a record has a name twice, both values count.
* Payloads that are null or no JSON object have no fields; their file still counts as a file.
* A field that is null throughout a file has no alternatives there and is neither retyped nor renamed by its values.
* Names are renamed by values only if at least one site of both files has both values.
* A feed's first file has no changes; rows without feed_id or file_seq are left out.
* Repeated records change nothing but the rows of the consistent table, where those without an id and of one content are
  one row. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.functions.geo import dms_to_decimal
from meshwright.tables import checkpoint

#: Properties of the consistent table with their canonical types.
PROPERTIES = {
    "site_name": "string", "site_type": "string", "longitude": "double", "latitude": "double", "altitude": "double",
    "height": "double", "device_sku": "string", "subscribers": "bigint",
}
MOST_ALIASES = 10_000
#: Alternatives a field can have, in order of their bits.
BRANCHES = {"string": "string", "number": "double", "boolean": "boolean"}
KINDS = ("array", "boolean", "number", "object", "string")


def _norm(name: Column) -> Column:
    return F.lower(F.trim(name))


def alias_map(aliases: DataFrame) -> dict[str, str]:
    """The alias table as a dict; it is a fixed table and refused beyond MOST_ALIASES rows."""
    rows = aliases.select(_norm(F.col("alias_name")).alias("a"), F.trim("site_field").alias("f")).filter("a <> '' and f <> ''").groupBy("a").agg(F.min("f").alias("f")).limit(MOST_ALIASES + 1).collect()
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    return {r.a: r.f for r in rows}


def _lookup(aliases: dict[str, str], key: Column) -> Column:
    if not aliases:
        return F.lit(None).cast("string")
    return F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))[key]


def _record_key() -> Column:
    """Tells records without an id apart by what they hold, so that they don't all meet in one group."""
    return F.when(F.col("record_id").isNull(), F.md5(F.coalesce("payload", F.lit(""))))


def _parsed(feed: DataFrame, *columns: str) -> DataFrame:
    """Records of files with their entries: an array of normal names and values."""
    rows = feed.filter("feed_id is not null and file_seq is not null")
    entries = F.transform(F.map_entries(F.from_json("payload", "map<string,variant>")), lambda e: F.struct(_norm(e["key"]).alias("field"), e["value"].alias("value")))
    return rows.select("feed_id", "file_seq", *columns, F.filter(entries, lambda e: e["field"] != "").alias("entries"))


def _kind(schema: Column) -> Column:
    return (
        F.when(schema == "VOID", "null").when(schema == "STRING", "string").when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array").when(schema.startswith("OBJECT"), "object").otherwise("number")
    )


def _text(value: Column, kind: Column) -> Column:
    """A value's text; numbers in the form of a double, so that 1 and 1.0 are one value."""
    number = F.try_variant_get(value, F.lit("$"), "double").cast("string")
    return F.when(kind == "number", number).when(kind != "null", value.cast("string"))


def _site(aliases: dict[str, str]) -> Column:
    """A record's site, from the first of its names that maps to site_name and has a value."""
    names = [a for a, f in aliases.items() if f == "site_name"]
    if not names:
        return F.lit(None).cast("string")
    named = F.filter("entries", lambda e: e["field"].isin(names) & (F.schema_of_variant(e["value"]) != "VOID"))
    return F.trim(F.try_element_at(named, F.lit(1))["value"].cast("string"))


def values(feed: DataFrame) -> DataFrame:
    """Long form: record_id, record_key, feed_id, file_seq, field, kind (string, number, boolean, array, object, null), text.

    A record without any field has one row whose field is null.
    """
    rows = _parsed(feed.withColumn("record_key", _record_key()), "record_id", "record_key")
    told = F.transform("entries", lambda e: F.struct(e["field"].alias("field"), _kind(F.schema_of_variant(e["value"])).alias("kind"), e["value"].alias("value")))
    long = rows.select("record_id", "record_key", "feed_id", "file_seq", F.explode_outer(told).alias("e"))
    return long.select("record_id", "record_key", "feed_id", "file_seq", "e.field", "e.kind", _text(F.col("e.value"), F.col("e.kind")).alias("text"))


def file_schemas(feed: DataFrame) -> DataFrame:
    """Tagged union of each file: feed_id, file_seq, field and kinds, the set of its alternatives as bits of KINDS.

    Sets of bits are combined before rows move.
    """
    schemas = F.transform("entries", lambda e: F.struct(e["field"].alias("field"), F.schema_of_variant(e["value"]).alias("schema")))
    long = _parsed(feed).select("feed_id", "file_seq", F.explode(schemas).alias("e")).select("feed_id", "file_seq", "e.field", _kind(F.col("e.schema")).alias("kind"))
    bit = F.lit(0)
    for i, kind in enumerate(KINDS):
        bit = F.when(F.col("kind") == kind, 1 << i).otherwise(bit)
    return long.groupBy("feed_id", "file_seq", "field").agg(F.bit_or(bit).alias("kinds"))


def kind_names(kinds: Column) -> Column:
    """The alternatives of a set of bits, in order."""
    return F.filter(F.array(*(F.when(kinds.bitwiseAND(1 << i) != 0, k) for i, k in enumerate(KINDS))), lambda k: k.isNotNull())


def _field_states(feed: DataFrame) -> DataFrame:
    """Each field of each file and of the file before: feed_id, file_seq, field, old_kinds, new_kinds (null if it isn't there), own.

    own is the file the field is in, of both the new one. Every file stands once for itself and once for the next one.
    """
    schemas = file_schemas(feed)
    order = Window.partitionBy("feed_id").orderBy("file_seq")
    files = feed.filter("feed_id is not null and file_seq is not null").select("feed_id", "file_seq").distinct()  # without a parse
    steps = files.select("feed_id", "file_seq", F.lag("file_seq").over(order).alias("prev"), F.lead("file_seq").over(order).alias("next"))
    both = schemas.join(steps, ["feed_id", "file_seq"])
    as_new, as_old = F.when(F.col("prev").isNotNull(), F.col("file_seq")), F.col("next")
    states = F.explode(F.array(F.struct(as_new.alias("to"), F.lit(True).alias("is_new")), F.struct(as_old.alias("to"), F.lit(False).alias("is_new")))).alias("s")
    states = both.select("feed_id", F.col("file_seq").alias("own"), "field", "kinds", states).filter("s.to is not null")
    return states.groupBy("feed_id", F.col("s.to").alias("file_seq"), "field").agg(
        F.max(F.when(~F.col("s.is_new"), F.col("kinds"))).alias("old_kinds"), F.max(F.when(F.col("s.is_new"), F.col("kinds"))).alias("new_kinds"), F.max("own").alias("own")
    )


def _moved(states: DataFrame) -> DataFrame:
    return states.filter("(old_kinds is null) <> (new_kinds is null)").withColumn("is_new", F.col("new_kinds").isNotNull())


def renames(feed: DataFrame, states: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """feed_id, file_seq, old_name, new_name of the same property, by alias or by equal values of all common sites.

    states is read twice and should be written down. Values are read of those files only that have gone or new names whose
    property isn't known, and of these names only.
    """
    name = F.struct("field", _lookup(aliases, F.col("field")).alias("property"))
    side = lambda new: F.collect_list(F.when(F.col("is_new") == new, name))
    files = _moved(states).groupBy("feed_id", "file_seq").agg(side(True).alias("new"), side(False).alias("gone"), F.max(F.when(~F.col("is_new"), F.col("own"))).alias("prev"))
    files = files.filter("size(new) > 0 and size(gone) > 0")
    pairs = F.flatten(F.transform("gone", lambda o: F.transform(F.filter("new", lambda n: n["property"] == o["property"]), lambda n: F.struct(o["field"].alias("old_name"), n["field"].alias("new_name")))))
    by_alias = files.select("feed_id", "file_seq", F.explode(pairs).alias("p")).select("feed_id", "file_seq", "p.old_name", "p.new_name")
    # each file is told whose old and whose new state it is, with the names looked for there
    names = lambda c: F.transform(c, lambda x: x["field"])
    open_ended = files.filter(F.exists("new", lambda x: x["property"].isNull()) | F.exists("gone", lambda x: x["property"].isNull()))
    wanted = F.explode(F.array(
        F.struct(F.col("file_seq").alias("own"), F.struct("file_seq", F.lit(True).alias("is_new"), names("new").alias("names")).alias("s")),
        F.struct(F.col("prev").alias("own"), F.struct("file_seq", F.lit(False).alias("is_new"), names("gone").alias("names")).alias("s")),
    )).alias("w")
    wanted = open_ended.select("feed_id", wanted).groupBy("feed_id", F.col("w.own").alias("file_seq")).agg(F.collect_list("w.s").alias("sides"))  # two at most
    rows = _parsed(feed.join(wanted, ["feed_id", "file_seq"]), "sides").select("feed_id", "sides", _site(aliases).alias("site"), "entries").filter("site is not null")
    schema = lambda e: F.schema_of_variant(e["value"])
    of_side = lambda s: F.transform(F.filter("entries", lambda e: F.array_contains(s["names"], e["field"]) & (schema(e) != "VOID")), lambda e: F.struct(s["file_seq"].alias("file_seq"), s["is_new"].alias("is_new"), e["field"].alias("field"), _kind(schema(e)).alias("kind"), e["value"].alias("value")))
    long = rows.select("feed_id", "site", F.explode(F.flatten(F.transform("sides", of_side))).alias("e"))
    told = F.concat("e.kind", F.lit(":"), _text(F.col("e.value"), F.col("e.kind")))
    # values are compared by two 64-bit hashes, which are combined before rows move; unequal ones agree in both once in 10^38
    long = long.select("feed_id", "e.file_seq", "site", "e.is_new", "e.field", F.xxhash64(told).alias("h"), F.xxhash64(told, F.lit(1)).alias("g"))
    each = long.groupBy("feed_id", "file_seq", "site", "is_new", "field").agg(F.min("h").alias("h"), F.min("g").alias("g"), ((F.min("h") == F.max("h")) & (F.min("g") == F.max("g"))).alias("one"))
    site = each.groupBy("feed_id", "file_seq", "site").agg(F.collect_list(F.struct("is_new", "field", "h", "g", "one")).alias("x"))  # a file's moved names at most
    pick = lambda new: F.filter("x", lambda x: x["is_new"] if new else ~x["is_new"])
    same = lambda o, n: o["one"] & n["one"] & (o["h"] == n["h"]) & (o["g"] == n["g"])
    pairs = F.flatten(F.transform(pick(False), lambda o: F.transform(pick(True), lambda n: F.struct(o["field"].alias("old_name"), n["field"].alias("new_name"), same(o, n).alias("same")))))
    by_value = site.select("feed_id", "file_seq", F.explode(pairs).alias("p")).groupBy("feed_id", "file_seq", F.col("p.old_name").alias("old_name"), F.col("p.new_name").alias("new_name")).agg(F.bool_and("p.same").alias("same"))
    unknown = _lookup(aliases, F.col("old_name")).isNull() | _lookup(aliases, F.col("new_name")).isNull()
    # the two sets have no pair in common
    return by_alias.unionAll(by_value.filter(F.col("same") & unknown).drop("same"))


def schema_changes(feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """feed_id, file_seq, change_kind (renamed, added, removed, retyped), field_name, old_name, old_kinds, new_kinds."""
    known = alias_map(aliases)
    states = checkpoint(_field_states(feed))
    named = renames(feed, states, known)
    none, no_kinds = F.lit(None).cast("string"), F.lit(None).cast("int")
    ends = F.explode(F.array(F.struct(F.col("new_name").alias("field"), F.lit(True).alias("is_new"), F.col("old_name").alias("partner")), F.struct(F.col("old_name").alias("field"), F.lit(False).alias("is_new"), F.col("new_name").alias("partner")))).alias("e")
    done = named.select("feed_id", "file_seq", ends).select("feed_id", "file_seq", "e.field", "e.is_new", "e.partner", no_kinds.alias("old_kinds"), no_kinds.alias("new_kinds"))
    moved = _moved(states).select("feed_id", "file_seq", "field", "is_new", none.alias("partner"), "old_kinds", "new_kinds")
    moved = moved.unionAll(done).groupBy("feed_id", "file_seq", "field", "is_new").agg(F.min("partner").alias("partner"), F.max("old_kinds").alias("old_kinds"), F.max("new_kinds").alias("new_kinds"))
    kind = F.when(F.col("partner").isNotNull(), F.when(F.col("is_new"), "renamed")).when(F.col("is_new"), "added").otherwise("removed")
    moved = moved.select("feed_id", "file_seq", kind.alias("change_kind"), F.col("field").alias("field_name"), F.col("partner").alias("old_name"), "old_kinds", "new_kinds").filter("change_kind is not null")
    kept = states.filter("old_kinds > 0 and new_kinds > 0 and old_kinds <> new_kinds")
    kept = kept.select("feed_id", "file_seq", F.lit("retyped").alias("change_kind"), F.col("field").alias("field_name"), none.alias("old_name"), "old_kinds", "new_kinds")
    read = lambda c: F.when(F.col(c).isNotNull(), kind_names(F.col(c))).alias(c)
    return moved.unionAll(kept).select("feed_id", "file_seq", "change_kind", "field_name", "old_name", read("old_kinds"), read("new_kinds"))


def alternatives(feed: DataFrame) -> DataFrame:
    """Fused schema of each feed: every field's alternatives with the files they first and last appear in."""
    each = file_schemas(feed).select("feed_id", "file_seq", F.col("field").alias("field_name"), F.explode(kind_names(F.col("kinds"))).alias("kind"))
    return each.groupBy("feed_id", "field_name", "kind").agg(F.min("file_seq").alias("first_file"), F.max("file_seq").alias("last_file"), F.count(F.lit(1)).alias("files"))


def _meanings(named: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Properties that unknown names of a feed stand for, by the names they were renamed from or to, over any number of renames.

    A name takes the property of its nearest known name, of equally near ones the first; rounds end once no name is added.
    """
    ends = named.select("feed_id", F.explode(F.array(F.struct(F.col("old_name").alias("a"), F.col("new_name").alias("b")), F.struct(F.col("new_name").alias("a"), F.col("old_name").alias("b")))).alias("e"))
    ends = checkpoint(ends.select("feed_id", "e.a", "e.b").distinct())
    known = checkpoint(ends.select("feed_id", "a", _lookup(aliases, F.col("a")).alias("property")).filter("property is not null").distinct())
    added = known
    while not added.isEmpty():
        reached = ends.join(added.select("feed_id", F.col("a").alias("b"), "property"), ["feed_id", "b"]).groupBy("feed_id", "a").agg(F.min("property").alias("property"))
        added = checkpoint(reached.join(known, ["feed_id", "a"], "left_anti"))
        known = known.unionAll(added)
    return known.filter(_lookup(aliases, F.col("a")).isNull()).withColumnRenamed("a", "field")


def consistent_table(feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per record: the canonical properties, typed branches of those in conflict, and all other fields.

    A property is text, number or boolean by its canonical type; values of another kind stand in a column of that kind,
    named by both (height_string, site_name_number ...), beside what the canonical conversion makes of them (null if
    nothing). other_fields is a map, as JSON, of the values of names without a property, and of arrays and objects.
    """
    known = alias_map(aliases)
    named = checkpoint(renames(feed, checkpoint(_field_states(feed)), known))
    meaning = _meanings(named, known).withColumnRenamed("property", "learnt")
    long = values(feed).withColumn("property", _lookup(known, F.col("field")))
    unknown = long.filter("property is null").drop("property").join(meaning, ["feed_id", "field"], "left").withColumnRenamed("learnt", "property")
    columns = ["record_id", "record_key", "feed_id", "file_seq", "field", "kind", "text", "property"]
    long = long.filter("property is not null").select(*columns).unionAll(unknown.select(*columns))
    plain = F.col("kind").isin(*BRANCHES)
    of = lambda p: F.min(F.when((F.col("property") == p) & plain, F.col("text")))

    def convert(p: str, t: str) -> Column:
        if p in ("longitude", "latitude"):
            return F.coalesce(of(p).try_cast("double"), dms_to_decimal(of(p)))
        return of(p).try_cast("double").try_cast("bigint") if t == "bigint" else of(p).try_cast(t)

    def branch(p: str, kind: str) -> Column:
        return F.min(F.when((F.col("property") == p) & (F.col("kind") == kind), F.col("text"))).try_cast(BRANCHES[kind]).alias(f"{p}_{kind}")

    canonical = [convert(p, t).alias(p) for p, t in PROPERTIES.items()]
    branches = [branch(p, k) for p, t in PROPERTIES.items() for k in BRANCHES if k != ("string" if t == "string" else "number")]
    told = F.coalesce(F.col("kind"), F.lit("null")) != "null"
    other = F.collect_set(F.when(told & (F.col("property").isNull() | ~F.col("property").isin(*PROPERTIES) | ~plain), F.struct(F.col("field").alias("k"), F.col("text").alias("v"))))
    rows = long.groupBy("record_id", "record_key", "feed_id", "file_seq").agg(*canonical, *branches, F.sort_array(other).alias("other"))
    # of a name that stands twice in a record the first value by order is kept
    first = F.filter("other", lambda x, i: (i == 0) | (F.get("other", i - 1)["k"] != x["k"]))
    return rows.withColumn("other_fields", F.to_json(F.map_from_entries(first))).drop("record_key", "other")
