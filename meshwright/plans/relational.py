"""Queries of joins, predicates, aggregates, rules, reports, orderings and set operations over sites and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.functions import geo, rf
from meshwright.operators import graph
from meshwright.operators import topology as topo
from meshwright.operators.rangejoin import nearest, radius_join
from meshwright.plans.domain import ACTIVE, BASE_SQL, LINK_TYPE_SQL, RADIO, bearing_sql, delta_sql, hav_sql, length_sql, link_length, link_type, links, raw_links, sites, wireless
from meshwright.plans.scalars import ENDS, r
from meshwright.tables import fixed, name_key, table

ACTIVE_SQL = "('PROPOSED', 'EXISTING')"
SECTORS = {"DN": 4, "POP": 4, "CN": 1}


# --- sites ------------------------------------------------------------------------------------------------------------
def site_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First recording of each distinct site property set."""
    key = ["latitude", "longitude", "altitude", F.upper(F.trim("site_type")).alias("type"), "location_type", name_key(F.col("site_name")).alias("name"), F.lower(F.trim("device_sku")).alias("sku"), "plan_id"]
    rows = table(spark, d, "sites").select("site_row", *key)
    return rows.groupBy(*[c for c in rows.columns if c != "site_row"]).agg(F.min("site_row").alias("site_row"), F.count(F.lit(1)).alias("copies")).select("site_row", "copies")


def site_device_expand(spark: SparkSession, d: str) -> DataFrame:
    """A site with a device keeps it; one without gets a row for each device of its type (devices are a fixed table)."""
    devices = fixed(table(spark, d, "devices").select(F.upper("device_sku").alias("device"), "device_type"))
    ss = sites(spark, d).withColumn("want", F.when(F.col("site_type") == "CN", "CN").otherwise("DN"))
    with_sku = ss.filter("sku is not null").join(devices, F.col("sku") == F.col("device"), "left_semi").select("site_id", "sku")
    free = ss.filter("sku is null").join(devices, F.col("want") == F.col("device_type")).select("site_id", F.col("device").alias("sku"))
    return with_sku.unionAll(free)


def site_unknown_device(spark: SparkSession, d: str) -> DataFrame:
    devices = fixed(table(spark, d, "devices").select(F.upper("device_sku").alias("sku")))
    return sites(spark, d).filter("sku is not null").join(devices, "sku", "left_anti").select("site_id", "sku")


def site_name_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that share plan and name but not the device get the device appended to their name."""
    rows = table(spark, d, "sites").select("site_row", "plan_id", name_key(F.col("site_name")).alias("name"), F.lower(F.trim("device_sku")).alias("sku")).filter("name is not null and plan_id is not null")
    skus = rows.groupBy("plan_id", "name").agg(F.countDistinct("sku").alias("n")).filter("n > 1")
    joined = rows.join(skus, ["plan_id", "name"], "left")
    return joined.select("site_row", F.when(F.col("n").isNotNull(), F.concat_ws("_", "name", "sku")).otherwise(F.col("name")).alias("unique_name"))


def site_colocated_groups(spark: SparkSession, d: str) -> DataFrame:
    """Recordings at one place and altitude."""
    rows = table(spark, d, "sites").filter("latitude is not null and longitude is not null")
    rows = rows.selectExpr("site_row AS site_id", "upper(trim(site_type)) AS site_type", "longitude AS lon", "latitude AS lat", "altitude AS alt")
    return topo.colocated(rows).filter("n > 1").select("first_id", "n", "types")


def _side(axis: str) -> F.Column:
    return F.transform("outer_ring", lambda p: p[axis])


def site_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Sites in each area, by box join and exact test; the areas are a fixed table."""
    areas = table(spark, d, "areas").filter("size(outer_ring) >= 3").select(
        "area_id", "outer_ring", "hole_ring", *(f(_side(k)).alias(f"{k}_{n}") for k in ("lon", "lat") for n, f in (("lo", F.array_min), ("hi", F.array_max)))
    )
    boxed = sites(spark, d).join(fixed(areas), F.expr("lat between lat_lo and lat_hi and lon between lon_lo and lon_hi"))
    inside = geo.in_ring("outer_ring", "lon", "lat") & ~F.coalesce(geo.in_ring("hole_ring", "lon", "lat"), F.lit(False))
    return boxed.filter(inside).select("area_id", "site_id")


def area_measures(spark: SparkSession, d: str) -> DataFrame:
    """Area and centroid of each region's outer ring."""
    lon, lat = geo.ring_centroid("outer_ring")
    areas = table(spark, d, "areas").filter("size(outer_ring) > 3")
    return areas.select("area_id", F.round(geo.ring_area_m2("outer_ring") / 1e6, 3).alias("km2"), r(lon, 8).alias("lon"), r(lat, 8).alias("lat"))


# --- joins --------------------------------------------------------------------------------------------------------------
def join_candidate_links(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sites of one plan 20 to 300 m apart that may be linked: relays and sources both ways, clients as receivers."""
    s = sites(spark, d).filter("status <> 'UNAVAILABLE'")
    a = s.filter("site_type <> 'CN'").select(F.col("site_id").alias("tx_id"), F.col("plan_id").alias("tx_plan"), F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"))
    b = s.select(F.col("site_id").alias("rx_id"), F.col("plan_id").alias("rx_plan"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    pairs = radius_join(a, b, 300.0).filter("tx_id <> rx_id and tx_plan = rx_plan and distance_m >= 20")
    return pairs.select("tx_id", "rx_id", r("distance_m", 2).alias("distance_m"))


def join_reverse_link(spark: SparkSession, d: str) -> DataFrame:
    both = topo.with_reverse(links(spark, d), "link_row", "status")
    return both.select("link_row", "reverse_link_row", (F.col("reverse_status") == F.col("status")).alias("same_status"))


def join_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Number of successors and predecessors of each site, all and wireless."""
    ls = links(spark, d)
    parts = [topo.neighbors(ls, out=o, wireless_only=w).withColumn("k", F.lit(f"{'out' if o else 'in'}{'_wireless' if w else ''}")) for o in (True, False) for w in (False, True)]
    union = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return union.groupBy("site_id").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("out", "out_wireless", "in", "in_wireless")))


def join_radius_demand(spark: SparkSession, d: str) -> DataFrame:
    """Demand points (clients by five-decimal place) and how many relays and sources they reach within 200 m."""
    s = sites(spark, d)
    demand = s.filter("site_type = 'CN'").groupBy(F.round("lon", 5).alias("l_lon"), F.round("lat", 5).alias("l_lat")).agg(F.min("site_id").alias("demand_id"), F.sum(F.coalesce("subscribers", F.lit(1))).alias("subscribers"))
    relays = s.filter("site_type <> 'CN'").select(F.col("site_id").alias("relay_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    return radius_join(demand, relays, 200.0).groupBy("demand_id", "subscribers").agg(F.count(F.lit(1)).alias("reached"))


def join_nearest_site(spark: SparkSession, d: str) -> DataFrame:
    """The nearest relay or source within 500 m of each client."""
    s = sites(spark, d)
    a = s.filter("site_type = 'CN'").select(F.col("site_id").alias("client_id"), F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"))
    b = s.filter("site_type <> 'CN'").select("site_id", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    found = nearest(a, b, 500.0, left_id="client_id", right_id="site_id")
    return found.select("client_id", r("distance_m", 2).alias("distance_m"))


def join_building_rooftop(spark: SparkSession, d: str) -> DataFrame:
    """Other sites on the building of each rooftop site, each pair once."""
    roof = sites(spark, d).filter("location_type = 'ROOFTOP' and building_id >= 0")
    a, b = roof.select("building_id", F.col("site_id").alias("one")), roof.select("building_id", F.col("site_id").alias("other"))
    return a.join(b, "building_id").filter("one < other")


def join_missing_sites_anti(spark: SparkSession, d: str) -> DataFrame:
    """Names of links that no current site has."""
    raw = raw_links(spark, d)
    ends = raw.select("plan_id", F.explode(F.array("tx", "rx")).alias("name")).groupBy("plan_id", "name").agg(F.count(F.lit(1)).alias("link_ends"))
    return ends.join(sites(spark, d).select("plan_id", "name"), ["plan_id", "name"], "left_anti")


def _with_sectors(ls: DataFrame) -> DataFrame:
    """Sectors of both ends: the one whose azimuth is nearest to the link's bearing."""
    ls = ls.filter("is_wireless and (tx_lat <> rx_lat or tx_lon <> rx_lon)").withColumns({"azimuth": geo.bearing(*ENDS), "length_m": link_length()})
    for end in ("tx", "rx"):
        n = F.when(F.col(f"{end}_type") == "CN", SECTORS["CN"]).otherwise(SECTORS["DN"])
        toward = F.col("azimuth") if end == "tx" else F.pmod(F.col("azimuth") + 180, F.lit(360.0))
        ls = ls.withColumn("_n", n).withColumn("_az", topo.sector_azimuths(F.col("_n"))).withColumn("_to", toward)
        ls = ls.withColumn("_s", topo.nearest_sector(F.col("_az"), F.col("_to"), F.lit(360.0) / F.col("_n")))
        ls = ls.withColumns({f"{end}_sector": F.concat_ws("-", f"{end}_id", F.col("_s.position")), f"{end}_off": F.col("_s.off")}).drop("_n", "_az", "_to", "_s")
    return ls


def join_link_sectors_argmin(spark: SparkSession, d: str) -> DataFrame:
    return _with_sectors(links(spark, d)).select("link_row", "tx_sector", "rx_sector", r("tx_off").alias("tx_off"))


# --- aggregates -----------------------------------------------------------------------------------------------------------
def agg_component_counts(spark: SparkSession, d: str) -> DataFrame:
    """Active and all sites by type and status in one pass of grouping sets."""
    s = sites(spark, d).withColumn("active", F.col("status").isin(*ACTIVE))
    out = s.groupingSets([[F.col("site_type"), F.col("status")], [F.col("site_type")], []], F.col("site_type"), F.col("status"))
    return out.agg(F.count(F.lit(1)).alias("total"), F.count_if("active").alias("active"), F.countDistinct("plan_id").alias("plans"))


def agg_links_rollup(spark: SparkSession, d: str) -> DataFrame:
    ls = links(spark, d).withColumn("link_type", link_type())
    return ls.rollup("link_type", "status").agg(F.count(F.lit(1)).alias("links"), r(F.sum("capacity"), 6).alias("gbps"))


def agg_redundant_sites(spark: SparkSession, d: str) -> DataFrame:
    return topo.redundant_sites(sites(spark, d))


def agg_pop_capacity(spark: SparkSession, d: str) -> DataFrame:
    """What each source can send: the best link of each sector, summed up, at most 10 Gbps."""
    out = _with_sectors(links(spark, d)).filter("tx_type = 'POP'").groupBy("tx_id", "tx_sector").agg(F.max(F.coalesce("capacity", F.lit(0.0))).alias("best"))
    return out.groupBy("tx_id").agg(r(F.least(F.sum("best"), F.lit(10.0)), 3).alias("gbps"))


def agg_link_stats(spark: SparkSession, d: str) -> DataFrame:
    ls = links(spark, d).withColumn("m", F.round(link_length(), 6)).withColumn("link_type", link_type())
    return ls.groupBy("link_type").agg(F.count(F.lit(1)).alias("links"), r(F.avg("m"), 2).alias("avg_m"), r(F.min("m"), 2).alias("min_m"), r(F.max("m"), 2).alias("max_m"))


def agg_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of confidence and capacity by status."""
    ls = table(spark, d, "links").filter("link_status is not null")
    q = [F.round(F.percentile("confidence", p), 4).alias(f"confidence_{int(p * 100)}") for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    return ls.groupBy("link_status").agg(*q, F.round(F.percentile("capacity_gbps", 0.5), 4).alias("capacity_50"))


def agg_mcs_histogram(spark: SparkSession, d: str) -> DataFrame:
    return wireless(links(spark, d)).groupBy("mcs").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def agg_links_per_sector(spark: SparkSession, d: str) -> DataFrame:
    per = _with_sectors(links(spark, d)).filter("tx_type <> 'CN'").groupBy("tx_sector").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("sectors"))


def agg_site_flow(spark: SparkSession, d: str) -> DataFrame:
    flow = topo.site_flow(links(spark, d).withColumn("f", F.coalesce("capacity", F.lit(0.0)) * F.coalesce("confidence", F.lit(0.0))), "f")
    return flow.select("site_id", r("flow_in", 8).alias("flow_in"), r("flow_out", 8).alias("flow_out"))


def agg_pivot_types(spark: SparkSession, d: str) -> DataFrame:
    """Sites of each plan by type, as columns."""
    return sites(spark, d).groupBy("plan_id").pivot("site_type", ["POP", "DN", "CN"]).agg(F.count(F.lit(1))).select("plan_id", *(F.coalesce(F.col(t), F.lit(0)).alias(t.lower()) for t in ("POP", "DN", "CN")))


# --- rules ------------------------------------------------------------------------------------------------------------
def _angle_pairs(spark: SparkSession, d: str, limit: float) -> DataFrame:
    ls = _with_sectors(wireless(links(spark, d))).withColumn("azimuth", F.round("azimuth", 6))
    pairs = topo.close_angle_pairs(ls, limit)
    sector = ls.select(F.col("link_row").alias("k"), F.col("tx_sector").alias("sector"))
    pairs = pairs.join(sector.withColumnsRenamed({"k": "first", "sector": "s1"}), "first").join(sector.withColumnsRenamed({"k": "second", "sector": "s2"}), "second")
    return pairs


def rule_angle_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links of one site in different sectors less than 25 degrees apart."""
    return _angle_pairs(spark, d, 25.0).filter("s1 <> s2").select("first", "second", r("angle", 2).alias("angle"))


def rule_violating_links(spark: SparkSession, d: str) -> DataFrame:
    """All links, in both directions, of pairs that break the angle rule."""
    pairs = _angle_pairs(spark, d, 25.0).filter("s1 <> s2").select("first", "second")
    return topo.violating_links(links(spark, d), pairs)


def geo_elevation(spark: SparkSession, d: str) -> DataFrame:
    """Angle of each link over the horizontal."""
    ls = links(spark, d).withColumn("length_m", link_length())
    return ls.select("link_row", r(topo.elevation_off(F.col("rx_alt") - F.col("tx_alt"), F.col("length_m"))).alias("elevation_deg"))


def sites_connectable(spark: SparkSession, d: str) -> DataFrame:
    """Sites in use that sources in use reach over such sites, and the others by whether a link from those leads to them."""
    s = sites(spark, d).withColumn("picked", F.coalesce(F.col("status").isin(*ACTIVE), F.lit(False)))
    ls = links(spark, d).filter("is_wireless and tx_type <> 'CN'").select("tx_id", "rx_id").distinct()
    picked = s.filter("picked")
    among = ls.join(picked.select(F.col("site_id").alias("tx_id")), "tx_id", "left_semi").join(picked.select(F.col("site_id").alias("rx_id")), "rx_id", "left_semi")
    reached = graph.hops(picked.filter("site_type = 'POP'").select(F.col("site_id").alias("node")), among.select(F.col("tx_id").alias("src"), F.col("rx_id").alias("dst")))
    return topo.connectable_status(s, ls, reached)


def rule_near_far_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links of one site up to 45 degrees apart of which one is at least three times as long."""
    ratio = F.greatest("len1", "len2") / F.least("len1", "len2")
    return _angle_pairs(spark, d, 45.0).filter(ratio >= 3).select("first", "second", r("angle", 2).alias("angle"))


def rule_sector_limits(spark: SparkSession, d: str) -> DataFrame:
    """Sectors with more than 2 links to relays or more than 15 in all."""
    per = _with_sectors(wireless(links(spark, d))).groupBy("tx_sector").agg(F.count_if(F.col("rx_type") != "CN").alias("relays"), F.count(F.lit(1)).alias("total"))
    return per.filter("relays > 2 or total > 15")


def rule_status_violations(spark: SparkSession, d: str) -> DataFrame:
    """Links whose status contradicts that of their ends, and active backhaul links without an active reverse."""
    ls = topo.with_reverse(links(spark, d), "status").withColumn("link_type", link_type())
    ends = F.array("tx_status", "rx_status")
    active = F.col("status").isin(*ACTIVE)
    broken = F.when(active & F.exists(ends, lambda s: ~s.isin(*ACTIVE)), "active_link_inactive_site").when(
        (F.col("status") == "EXISTING") & F.exists(ends, lambda s: s != "EXISTING"), "existing_link_new_site"
    ).when(active & (F.col("link_type") == "WIRELESS_BACKHAUL") & ~F.coalesce(F.col("reverse_status").isin(*ACTIVE), F.lit(False)), "one_way_backhaul")
    return ls.select("link_row", broken.alias("rule")).filter("rule is not null")


def rule_los_simple_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which easy check keeps a link from having a line of sight, cheapest first."""
    ls = links(spark, d).withColumn("m", F.round(link_length(), 6))
    rise = F.abs(F.col("rx_alt") - F.col("tx_alt"))
    why = F.when((F.col("tx_lat") == F.col("rx_lat")) & (F.col("tx_lon") == F.col("rx_lon")), "same_place").when(F.col("m") < 20, "too_near").when(F.col("m") > 400, "too_far").when(
        F.degrees(F.asin(F.least(rise / F.col("m"), F.lit(1.0)))) > 25, "too_steep"
    ).otherwise("open")
    return ls.groupBy(why.alias("verdict")).agg(F.count(F.lit(1)).alias("links"))


# --- reports ------------------------------------------------------------------------------------------------------------
def report_links(spark: SparkSession, d: str) -> DataFrame:
    ls = links(spark, d)
    hash_ = F.array_join(F.array_sort(F.array(F.concat_ws("_", geo.geohash("tx_lon", "tx_lat"), "tx_type"), F.concat_ws("_", geo.geohash("rx_lon", "rx_lat"), "rx_type"))), "-")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in ("mcs", "status")]
    return ls.select("link_row", "tx_id", "rx_id", link_type().alias("link_type"), r(link_length(), 2).alias("length_m"), hash_.alias("link_hash"), *fields)


def report_sites(spark: SparkSession, d: str) -> DataFrame:
    ls = links(spark, d)
    flow = topo.site_flow(ls.withColumn("one", F.lit(1.0)), "one")
    clients = F.when(F.col("site_type") == "CN", F.coalesce(F.nullif("subscribers", F.lit(0)), F.lit(1))).otherwise(0)
    return sites(spark, d).join(flow, "site_id", "left").select(
        "site_id", "site_type", F.coalesce("status", F.lit("N/A")).alias("status"), r("lat", 5).alias("lat"), r("lon", 5).alias("lon"), clients.cast("bigint").alias("subscribers"),
        *(F.coalesce(F.col(k), F.lit(0.0)).cast("bigint").alias(a) for k, a in (("flow_in", "links_in"), ("flow_out", "links_out"))),
    )


def report_sectors(spark: SparkSession, d: str) -> DataFrame:
    ls = _with_sectors(links(spark, d))
    return ls.groupBy("tx_sector").agg(F.countDistinct("rx_id").alias("links"), F.countDistinct(F.when(F.col("status").isin(*ACTIVE), F.col("rx_id"))).alias("active_links"), r(F.max("tx_off"), 2).alias("widest"))


def report_bidirectional_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Of each pair of opposite links the one with more capacity, of equal ones the earlier."""
    pair = ["least(tx_id, rx_id) AS a", "greatest(tx_id, rx_id) AS b"]
    ls = links(spark, d).selectExpr(*pair, "link_row", "coalesce(capacity, 0.0D) AS capacity")
    best = ls.groupBy("a", "b").agg(F.min(F.struct((-F.col("capacity")).alias("less"), "link_row")).alias("x"), F.count(F.lit(1)).alias("directions"))
    return best.select("x.link_row", "directions")


# --- orderings and sets ----------------------------------------------------------------------------------------------
def topk_best_site_per_building(spark: SparkSession, d: str) -> DataFrame:
    """Of each building the site with most links, of equal ones the first by id."""
    ls = links(spark, d)
    degree = ls.groupBy(F.col("tx_id").alias("site_id")).agg(F.count(F.lit(1)).alias("degree"))
    roof = sites(spark, d).filter("location_type = 'ROOFTOP' and building_id is not null").join(degree, "site_id", "left")
    best = F.min(F.struct((-F.coalesce("degree", F.lit(0))).alias("less"), "site_id")).alias("best")
    return roof.groupBy("building_id").agg(best).select("building_id", "best.site_id", (-F.col("best.less")).alias("degree"))


def topk_busiest_sites(spark: SparkSession, d: str) -> DataFrame:
    """The 20 sites with most links: a top-k report."""
    return links(spark, d).groupBy("tx_id").agg(F.count(F.lit(1)).alias("links")).orderBy(F.desc("links"), "tx_id").limit(20)


def window_rank_in_plan(spark: SparkSession, d: str) -> DataFrame:
    """Rank of the three best links of each plan by SNR."""
    ls = table(spark, d, "links").filter("snr is not null and plan_id is not null")
    order = Window.partitionBy("plan_id").orderBy(F.desc("snr"), "link_row")
    return ls.select("plan_id", "link_row", F.row_number().over(order).alias("place")).filter("place <= 3")


def set_inactive_links(spark: SparkSession, d: str) -> DataFrame:
    """Links out of use: not active, or without an active end."""
    ls = links(spark, d)
    off = ls.filter(~F.col("status").isin(*ACTIVE)).select("link_row")
    ends = ls.filter(~(F.col("tx_status").isin(*ACTIVE) & F.col("rx_status").isin(*ACTIVE))).select("link_row")
    return off.union(ends).distinct()


def set_candidate_union_active(spark: SparkSession, d: str) -> DataFrame:
    """Sites of candidate links that are on no active link, and the intersection's size beside it."""
    ls = links(spark, d)
    of = lambda cond: ls.filter(cond).select(F.explode(F.array("tx_id", "rx_id")).alias("site_id"))
    candidate, active = of("status = 'CANDIDATE'"), of("status in ('PROPOSED', 'EXISTING')")
    only, both = candidate.exceptAll(active).distinct().subtract(active), candidate.intersect(active)
    return only.withColumn("part", F.lit("only_candidate")).unionAll(both.withColumn("part", F.lit("both")))


def demand_cn(spark: SparkSession, d: str) -> DataFrame:
    """One demand per place of clients: its sites, and subscribers of the first."""
    cn = sites(spark, d).filter("site_type = 'CN'").withColumn("n", F.coalesce(F.nullif("subscribers", F.lit(0)), F.lit(1)))
    out = cn.groupBy("lon", "lat").agg(F.min_by("n", "site_id").alias("subscribers"), F.count(F.lit(1)).alias("sites"), F.min("site_id").alias("demand_id"))
    return out.select("demand_id", "subscribers", "sites")


def demand_connect_colocated(spark: SparkSession, d: str) -> DataFrame:
    """Each demand with all sites at its place that can serve it: its clients, and relays or sources that stand there, too."""
    s = sites(spark, d).filter("status <> 'UNAVAILABLE'")
    demands = s.filter("site_type = 'CN'").groupBy("plan_id", "lon", "lat").agg(F.min("site_id").alias("demand_id"))
    return demands.join(s.select("plan_id", "lon", "lat", "site_id", "site_type"), ["plan_id", "lon", "lat"]).select("demand_id", "site_id", "site_type")


def demand_uniform_grid(spark: SparkSession, d: str) -> DataFrame:
    """Points of a half-degree grid over each plan's box, counted; the box is found with partial aggregation."""
    box = sites(spark, d).groupBy("plan_id").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    n = lambda a, b: F.ceil((F.col(b) - F.col(a)) / F.lit(0.5)).cast("int") + 1
    grid = box.select("plan_id", "x0", "y0", F.explode(F.sequence(F.lit(0), n("x0", "x1") - 1)).alias("i"), n("y0", "y1").alias("rows"))
    points = grid.select("plan_id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("j"), "i")
    return points.groupBy("plan_id").agg(F.count(F.lit(1)).alias("points"), F.max("i").alias("last_column"), F.max("j").alias("last_row"))


QUERIES = {
    f.__name__: f
    for f in (
        site_dedup, site_device_expand, site_unknown_device, site_name_disambiguate, site_colocated_groups, site_point_in_polygon, area_measures, join_candidate_links, join_reverse_link, join_neighbors,
        join_radius_demand, join_nearest_site, join_building_rooftop, join_missing_sites_anti, join_link_sectors_argmin, agg_component_counts, agg_links_rollup, agg_redundant_sites, agg_pop_capacity,
        agg_link_stats, agg_percentiles, agg_mcs_histogram, agg_links_per_sector, agg_site_flow, agg_pivot_types, rule_angle_pairs, rule_violating_links, geo_elevation, sites_connectable, rule_near_far_pairs, rule_sector_limits, rule_status_violations,
        rule_los_simple_checks, report_links, report_sites, report_sectors, report_bidirectional_collapse, topk_best_site_per_building, topk_busiest_sites, window_rank_in_plan, set_inactive_links,
        set_candidate_union_active, demand_cn, demand_connect_colocated, demand_uniform_grid,
    )
}


def _near_sql(a: str, b: str, radius: float) -> str:
    """Pairs of two relations (columns id, lat, lon) within a radius, by bands of latitude."""
    h = hav_sql("a.lon", "a.lat", "b.lon", "b.lat")
    return f"""(SELECT a.id AS a_id, b.id AS b_id, a.plan_id AS a_plan, b.plan_id AS b_plan, {h} AS dist FROM (SELECT *, CAST(floor(lat * 100) AS BIGINT) AS band FROM {a}) a
JOIN (SELECT *, unnest([CAST(floor(lat * 100) AS BIGINT) - 1, CAST(floor(lat * 100) AS BIGINT), CAST(floor(lat * 100) AS BIGINT) + 1]) AS near_band FROM {b}) b ON a.band = b.near_band WHERE {h} <= {radius})"""


def _sector_sql(end: str) -> str:
    n = f"(CASE WHEN {end}_type = 'CN' THEN 1 ELSE 4 END)"
    to = "azimuth" if end == "tx" else "((azimuth + 180) % 360)"
    off = lambda i: f"round(abs({delta_sql(to, f'({i} * 360e0 / {n})')}), 9)"
    offs = ", ".join(f"{{'off': {off(i)}, 'position': {i}}}" for i in range(4))
    return f"list_min(CASE WHEN {end}_type = 'CN' THEN [{{'off': {off(0)}, 'position': 0}}] ELSE [{offs}] END)"


_SECTORED = BASE_SQL + f""", az AS (SELECT *, {bearing_sql(*ENDS)} AS azimuth, {length_sql()} AS length_m FROM ln WHERE is_wireless AND (tx_lat <> rx_lat OR tx_lon <> rx_lon)),
sx AS (SELECT *, {_sector_sql('tx')} AS ts, {_sector_sql('rx')} AS rs FROM az),
sc AS (SELECT *, tx_id || '-' || ts.position AS tx_sector, rx_id || '-' || rs.position AS rx_sector, ts.off AS tx_off FROM sx)
"""
_ANGLES = _SECTORED + f""", w AS (SELECT link_row, tx_id, tx_sector, length_m, round(azimuth, 6) AS az FROM sc WHERE tx_type <> 'CN'),
ap AS (SELECT a.link_row AS first, b.link_row AS second, abs({delta_sql('a.az', 'b.az')}) AS angle, a.tx_sector AS s1, b.tx_sector AS s2, greatest(a.length_m, b.length_m) / least(a.length_m, b.length_m) AS ratio
  FROM w a JOIN w b ON a.tx_id = b.tx_id AND a.link_row < b.link_row)
"""
_GEOHASH = lambda lon, lat: f"array_to_string([substring('0123456789abcdefghijklmnopqrstuv', CAST(list_sum([(((CASE WHEN (5 * i + j) % 2 = 0 THEN least(CAST(floor(({lon} + 180) / 360 * 33554432) AS BIGINT), 33554431) ELSE least(CAST(floor(({lat} + 90) / 180 * 33554432) AS BIGINT), 33554431) END) >> CAST(24 - (5 * i + j) // 2 AS INTEGER)) & 1) * (16 >> CAST(j AS INTEGER)) for j in range(5)]) AS INTEGER) + 1, 1) for i in range(10)], '')"
_REV = ", v AS (SELECT l.*, r.link_row AS reverse_row, r.status AS reverse_status FROM ln l LEFT JOIN ln r ON l.tx_id = r.rx_id AND l.rx_id = r.tx_id)\n"
ORACLES = {
    "site_dedup": "SELECT min(site_row) AS site_row, count(*) AS copies FROM sites GROUP BY latitude, longitude, altitude, upper(trim(site_type)), location_type, nullif(lower(trim(site_name)), ''), lower(trim(device_sku)), plan_id",
    "site_device_expand": BASE_SQL + "SELECT site_id, sku FROM st WHERE sku IN (SELECT upper(device_sku) FROM devices) UNION ALL SELECT site_id, upper(device_sku) FROM st JOIN devices ON device_type = CASE WHEN site_type = 'CN' THEN 'CN' ELSE 'DN' END WHERE sku IS NULL",
    "site_unknown_device": BASE_SQL + "SELECT site_id, sku FROM st WHERE sku IS NOT NULL AND sku NOT IN (SELECT upper(device_sku) FROM devices)",
    "site_name_disambiguate": """WITH x AS (SELECT site_row, plan_id, lower(trim(site_name)) AS name, lower(trim(device_sku)) AS sku FROM sites WHERE trim(site_name) <> '' AND plan_id IS NOT NULL),
n AS (SELECT plan_id, name, count(DISTINCT sku) AS n FROM x GROUP BY 1, 2)
SELECT site_row, CASE WHEN n > 1 THEN concat_ws('_', name, sku) ELSE name END AS unique_name FROM x JOIN n USING (plan_id, name)""",
    "site_colocated_groups": "SELECT min(site_row) AS first_id, count(*) AS n, count(DISTINCT upper(trim(site_type))) AS types FROM sites WHERE latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY longitude, latitude, altitude HAVING count(*) > 1",
    "site_point_in_polygon": BASE_SQL + """, corners AS (SELECT area_id, 'outer' AS part, unnest(outer_ring) AS p, generate_subscripts(outer_ring, 1) AS i FROM areas
  UNION ALL SELECT area_id, 'hole', unnest(hole_ring), generate_subscripts(hole_ring, 1) FROM areas WHERE hole_ring IS NOT NULL),
edges AS (SELECT a.area_id, a.part, a.p.lon AS x1, a.p.lat AS y1, b.p.lon AS x2, b.p.lat AS y2 FROM corners a JOIN corners b ON a.area_id = b.area_id AND a.part = b.part AND b.i = a.i + 1),
crossed AS (SELECT area_id, site_id, count(*) FILTER (part = 'outer') AS o, count(*) FILTER (part = 'hole') AS h FROM edges JOIN st ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL)
SELECT area_id, site_id FROM crossed WHERE o % 2 = 1 AND h % 2 = 0""",
    "area_measures": """WITH p AS (SELECT area_id, outer_ring AS ring, unnest(outer_ring) AS p, generate_subscripts(outer_ring, 1) AS i, outer_ring[1] AS f FROM areas WHERE len(outer_ring) > 3),
e AS (SELECT area_id, f, p.lon - f.lon AS px, p.lat - f.lat AS py, ring[i % len(ring) + 1].lon - f.lon AS qx, ring[i % len(ring) + 1].lat - f.lat AS qy FROM p),
s AS (SELECT area_id, any_value(f) AS f, sum(px * qy - qx * py) AS a, sum((px + qx) * (px * qy - qx * py)) AS x, sum((py + qy) * (px * qy - qx * py)) AS y FROM e GROUP BY 1)
SELECT area_id, round(abs(a) / 2 * cos(radians(f.lat)) * pow(pi() / 180 * 6371000, 2) / 1e6, 3) AS km2, round(f.lon + x / (a * 3), 8) + 0 AS lon, round(f.lat + y / (a * 3), 8) + 0 AS lat FROM s""",
    "join_candidate_links": BASE_SQL + ", k AS (SELECT site_id AS id, plan_id, site_type, lat, lon FROM st WHERE status <> 'UNAVAILABLE'), t AS (SELECT * FROM k WHERE site_type <> 'CN') "
    + f"SELECT a_id AS tx_id, b_id AS rx_id, round(dist, 2) + 0 AS distance_m FROM {_near_sql('t', 'k', 300)} WHERE a_id <> b_id AND a_plan = b_plan AND dist >= 20",
    "join_reverse_link": BASE_SQL + _REV + "SELECT link_row, reverse_row AS reverse_link_row, reverse_status = status AS same_status FROM v",
    "join_neighbors": BASE_SQL + """, n AS (SELECT DISTINCT tx_id AS site_id, rx_id AS o, 'out' AS k FROM ln UNION ALL SELECT DISTINCT tx_id, rx_id, 'out_wireless' FROM ln WHERE is_wireless
UNION ALL SELECT DISTINCT rx_id, tx_id, 'in' FROM ln UNION ALL SELECT DISTINCT rx_id, tx_id, 'in_wireless' FROM ln WHERE is_wireless)
SELECT site_id, count(*) FILTER (k = 'out') AS "out", count(*) FILTER (k = 'out_wireless') AS out_wireless, count(*) FILTER (k = 'in') AS "in", count(*) FILTER (k = 'in_wireless') AS in_wireless FROM n GROUP BY 1""",
    "join_radius_demand": BASE_SQL + ", dm AS (SELECT min(site_id) AS id, '' AS plan_id, round(lon, 5) AS lon, round(lat, 5) AS lat, CAST(sum(coalesce(subscribers, 1)) AS BIGINT) AS subscribers FROM st WHERE site_type = 'CN' GROUP BY round(lon, 5), round(lat, 5)), rs AS (SELECT site_id AS id, plan_id, lat, lon FROM st WHERE site_type <> 'CN') "
    + f"SELECT a_id AS demand_id, subscribers, count(*) AS reached FROM {_near_sql('dm', 'rs', 200)} JOIN dm ON dm.id = a_id GROUP BY 1, 2",
    "join_nearest_site": BASE_SQL + ", cl AS (SELECT site_id AS id, plan_id, lat, lon FROM st WHERE site_type = 'CN'), rs AS (SELECT site_id AS id, plan_id, lat, lon FROM st WHERE site_type <> 'CN') "
    + f"SELECT a_id AS client_id, round(min(dist), 2) + 0 AS distance_m FROM {_near_sql('cl', 'rs', 500)} GROUP BY 1",
    "join_building_rooftop": BASE_SQL + "SELECT a.building_id, a.site_id AS one, b.site_id AS other FROM st a JOIN st b ON a.building_id = b.building_id AND a.location_type = 'ROOFTOP' AND b.location_type = 'ROOFTOP' AND a.site_id < b.site_id WHERE a.building_id >= 0",
    "join_missing_sites_anti": BASE_SQL + ", e AS (SELECT plan_id, tx AS name FROM rl UNION ALL SELECT plan_id, rx FROM rl) SELECT plan_id, name, count(*) AS link_ends FROM e WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.plan_id = e.plan_id AND st.name = e.name) GROUP BY 1, 2",
    "join_link_sectors_argmin": _SECTORED + "SELECT link_row, tx_sector, rx_sector, round(tx_off, 3) + 0 AS tx_off FROM sc",
    "agg_component_counts": BASE_SQL + f"SELECT site_type, status, count(*) AS total, count(*) FILTER (status IN {ACTIVE_SQL}) AS active, count(DISTINCT plan_id) AS plans FROM st GROUP BY GROUPING SETS ((site_type, status), (site_type), ())",
    "agg_links_rollup": BASE_SQL + f", t AS (SELECT *, {LINK_TYPE_SQL} AS link_type FROM ln) SELECT link_type, status, count(*) AS links, round(sum(capacity), 6) + 0 AS gbps FROM t GROUP BY ROLLUP (link_type, status)",
    "agg_redundant_sites": BASE_SQL + ", g AS (SELECT site_type, count(*) AS n FROM st GROUP BY site_type, lon, lat, alt) SELECT site_type, CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS redundant FROM g GROUP BY 1",
    "agg_pop_capacity": _SECTORED + ", g AS (SELECT tx_id, tx_sector, max(coalesce(capacity, 0)) AS best FROM sc WHERE tx_type = 'POP' GROUP BY 1, 2) SELECT tx_id, round(least(sum(best), 10e0), 3) + 0 AS gbps FROM g GROUP BY 1",
    "agg_link_stats": BASE_SQL + f", t AS (SELECT {LINK_TYPE_SQL} AS link_type, round({length_sql()}, 6) AS m FROM ln) SELECT link_type, count(*) AS links, round(avg(m), 2) + 0 AS avg_m, round(min(m), 2) + 0 AS min_m, round(max(m), 2) + 0 AS max_m FROM t GROUP BY 1",
    "agg_percentiles": "SELECT link_status, " + ", ".join(f"round(quantile_cont(confidence, {p}), 4) AS confidence_{int(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0)) + ", round(quantile_cont(capacity_gbps, 0.5), 4) AS capacity_50 FROM links WHERE link_status IS NOT NULL GROUP BY 1",
    "agg_mcs_histogram": BASE_SQL + f"SELECT mcs, count(*) AS links, count(*) FILTER (status IN {ACTIVE_SQL}) AS active FROM ln WHERE is_wireless AND tx_type <> 'CN' GROUP BY 1",
    "agg_links_per_sector": _SECTORED + ", g AS (SELECT tx_sector, count(*) AS n FROM sc WHERE tx_type <> 'CN' GROUP BY 1) SELECT n, count(*) AS sectors FROM g GROUP BY 1",
    "agg_site_flow": BASE_SQL + ", f AS (SELECT tx_id, rx_id, coalesce(capacity, 0) * coalesce(confidence, 0) AS f FROM ln), e AS (SELECT tx_id AS site_id, f AS o, 0e0 AS i FROM f UNION ALL SELECT rx_id, 0e0, f FROM f) SELECT site_id, round(sum(i), 8) + 0 AS flow_in, round(sum(o), 8) + 0 AS flow_out FROM e GROUP BY 1",
    "agg_pivot_types": BASE_SQL + "SELECT plan_id, count(*) FILTER (site_type = 'POP') AS pop, count(*) FILTER (site_type = 'DN') AS dn, count(*) FILTER (site_type = 'CN') AS cn FROM st GROUP BY 1",
    "rule_violating_links": _ANGLES + ", vl AS (SELECT DISTINCT unnest([first, second]) AS link_row FROM ap WHERE angle <= 25 AND s1 <> s2), ve AS (SELECT tx_id, rx_id FROM ln JOIN vl USING (link_row)) SELECT link_row FROM ln WHERE (tx_id, rx_id) IN (SELECT (tx_id, rx_id) FROM ve) OR (rx_id, tx_id) IN (SELECT (tx_id, rx_id) FROM ve)",
    "geo_elevation": BASE_SQL + f"SELECT link_row, round(CASE WHEN {length_sql()} > 0 THEN coalesce(degrees(asin(greatest(least((rx_alt - tx_alt) / {length_sql()}, 1), -1))), 0) ELSE 0 END, 3) + 0 AS elevation_deg FROM ln",
    "sites_connectable": BASE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", pk AS (SELECT * FROM st WHERE status IN {ACTIVE_SQL}), wl AS (SELECT DISTINCT tx_id, rx_id FROM ln WHERE is_wireless AND tx_type <> 'CN'),
h AS (SELECT site_id AS node FROM pk WHERE site_type = 'POP' UNION SELECT rx_id FROM h JOIN wl ON tx_id = node WHERE rx_id IN (SELECT site_id FROM pk))
SELECT site_id, CASE WHEN site_id IN (SELECT site_id FROM pk) THEN CASE WHEN site_id IN (SELECT node FROM h) THEN 'connected' ELSE 'unconnected' END WHEN site_id IN (SELECT rx_id FROM wl JOIN h ON node = tx_id) THEN 'potential_connectable' ELSE 'potential_other' END AS state FROM st""",
    "rule_angle_pairs": _ANGLES + "SELECT first, second, round(angle, 2) + 0 AS angle FROM ap WHERE angle <= 25 AND s1 <> s2",
    "rule_near_far_pairs": _ANGLES + "SELECT first, second, round(angle, 2) + 0 AS angle FROM ap WHERE angle <= 45 AND ratio >= 3",
    "rule_sector_limits": _SECTORED + "SELECT tx_sector, count(*) FILTER (rx_type <> 'CN') AS relays, count(*) AS total FROM sc WHERE tx_type <> 'CN' GROUP BY 1 HAVING count(*) FILTER (rx_type <> 'CN') > 2 OR count(*) > 15",
    "rule_status_violations": BASE_SQL + _REV + f""", q AS (SELECT link_row, CASE WHEN status IN {ACTIVE_SQL} AND (tx_status NOT IN {ACTIVE_SQL} OR rx_status NOT IN {ACTIVE_SQL}) THEN 'active_link_inactive_site'
  WHEN status = 'EXISTING' AND (tx_status <> 'EXISTING' OR rx_status <> 'EXISTING') THEN 'existing_link_new_site'
  WHEN status IN {ACTIVE_SQL} AND {LINK_TYPE_SQL} = 'WIRELESS_BACKHAUL' AND NOT coalesce(reverse_status IN {ACTIVE_SQL}, false) THEN 'one_way_backhaul' END AS rule FROM v) SELECT * FROM q WHERE rule IS NOT NULL""",
    "rule_los_simple_checks": BASE_SQL + f""", m AS (SELECT *, round({length_sql()}, 6) AS m FROM ln) SELECT CASE WHEN tx_lat = rx_lat AND tx_lon = rx_lon THEN 'same_place' WHEN m < 20 THEN 'too_near' WHEN m > 400 THEN 'too_far'
  WHEN degrees(asin(least(abs(rx_alt - tx_alt) / m, 1))) > 25 THEN 'too_steep' ELSE 'open' END AS verdict, count(*) AS links FROM m GROUP BY 1""",
    "report_links": BASE_SQL + f""", h AS (SELECT *, {_GEOHASH('tx_lon', 'tx_lat')} || '_' || tx_type AS a, {_GEOHASH('rx_lon', 'rx_lat')} || '_' || rx_type AS b FROM ln)
SELECT link_row, tx_id, rx_id, {LINK_TYPE_SQL} AS link_type, round({length_sql()}, 2) + 0 AS length_m, least(a, b) || '-' || greatest(a, b) AS link_hash, CAST(mcs AS VARCHAR) AS mcs, coalesce(status, 'N/A') AS status FROM h""",
    "report_sites": BASE_SQL + """, i AS (SELECT rx_id AS site_id, count(*) AS n FROM ln GROUP BY 1), o AS (SELECT tx_id AS site_id, count(*) AS n FROM ln GROUP BY 1)
SELECT site_id, site_type, coalesce(status, 'N/A') AS status, round(lat, 5) + 0 AS lat, round(lon, 5) + 0 AS lon, CAST(CASE WHEN site_type = 'CN' THEN coalesce(nullif(subscribers, 0), 1) ELSE 0 END AS BIGINT) AS subscribers, coalesce(i.n, 0) AS links_in, coalesce(o.n, 0) AS links_out
FROM st LEFT JOIN i USING (site_id) LEFT JOIN o USING (site_id)""",
    "report_sectors": _SECTORED + f"SELECT tx_sector, count(DISTINCT rx_id) AS links, count(DISTINCT CASE WHEN status IN {ACTIVE_SQL} THEN rx_id END) AS active_links, round(max(tx_off), 2) + 0 AS widest FROM sc GROUP BY 1",
    "report_bidirectional_collapse": BASE_SQL + ", w AS (SELECT link_row, row_number() OVER (PARTITION BY least(tx_id, rx_id), greatest(tx_id, rx_id) ORDER BY coalesce(capacity, 0) DESC, link_row) AS k, count(*) OVER (PARTITION BY least(tx_id, rx_id), greatest(tx_id, rx_id)) AS directions FROM ln) SELECT link_row, directions FROM w WHERE k = 1",
    "topk_best_site_per_building": BASE_SQL + """, dg AS (SELECT tx_id AS site_id, count(*) AS degree FROM ln GROUP BY 1),
w AS (SELECT building_id, site_id, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY building_id ORDER BY coalesce(degree, 0) DESC, site_id) AS k FROM st LEFT JOIN dg USING (site_id) WHERE location_type = 'ROOFTOP' AND building_id IS NOT NULL)
SELECT building_id, site_id, degree FROM w WHERE k = 1""",
    "topk_busiest_sites": BASE_SQL + "SELECT tx_id, count(*) AS links FROM ln GROUP BY 1 ORDER BY links DESC, tx_id LIMIT 20",
    "window_rank_in_plan": "SELECT plan_id, link_row, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY snr DESC, link_row) AS INTEGER) AS place FROM links WHERE snr IS NOT NULL AND plan_id IS NOT NULL QUALIFY place <= 3",
    "set_inactive_links": BASE_SQL + f"SELECT link_row FROM ln WHERE status NOT IN {ACTIVE_SQL} OR tx_status NOT IN {ACTIVE_SQL} OR rx_status NOT IN {ACTIVE_SQL}",
    "set_candidate_union_active": BASE_SQL + f", k AS (SELECT unnest([tx_id, rx_id]) AS site_id FROM ln WHERE status = 'CANDIDATE'), a AS (SELECT unnest([tx_id, rx_id]) AS site_id FROM ln WHERE status IN {ACTIVE_SQL}) SELECT site_id, 'only_candidate' AS part FROM (SELECT site_id FROM k EXCEPT SELECT site_id FROM a) UNION ALL SELECT site_id, 'both' FROM (SELECT site_id FROM k INTERSECT SELECT site_id FROM a)",
    "demand_cn": BASE_SQL + "SELECT min(site_id) AS demand_id, arg_min(coalesce(nullif(subscribers, 0), 1), site_id) AS subscribers, count(*) AS sites FROM st WHERE site_type = 'CN' GROUP BY lon, lat",
    "demand_connect_colocated": BASE_SQL + ", a AS (SELECT * FROM st WHERE status <> 'UNAVAILABLE') SELECT demand_id, a.site_id, a.site_type FROM (SELECT plan_id, lon, lat, min(site_id) AS demand_id FROM a WHERE site_type = 'CN' GROUP BY 1, 2, 3) JOIN a USING (plan_id, lon, lat)",
    "demand_uniform_grid": BASE_SQL + """, b AS (SELECT plan_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM st GROUP BY 1),
n AS (SELECT plan_id, CAST(ceil((x1 - x0) / 0.5e0) AS INTEGER) + 1 AS nx, CAST(ceil((y1 - y0) / 0.5e0) AS INTEGER) + 1 AS ny FROM b) SELECT plan_id, CAST(nx AS BIGINT) * ny AS points, nx - 1 AS last_column, ny - 1 AS last_row FROM n""",
}
