"""Planning models as tables: variables, rows and goals of mixed-integer programs over the networks of all plans at once.

A model is three DataFrames in long form: variables (plan_id, variable, kind, low, high), rows (plan_id, row_id, variable,
coefficient, sense, bound; one for each coefficient) and a goal (plan_id, variable, coefficient), which is to be least.
Every rule of a model is one selection and a few terms, so models of all plans are made by joins, without a driver or a
task holding any of them. A sum is written by giving its terms one row_id. `solve` hands the models of single plans to the
exact solver and refuses those that are too large for it, saying so.

Names of variables: site:S, sector:X:c, flow:A>B, time:A>B:c, odd:S, shortage:D, link:A>B, demand:D, and of one
commodity (a relay that is to have two paths) flow:A>B:R.

Defined results
---------------
* Null capacities count as 0, null statuses as candidates. Links whose ends are no sites of the network have no rows.
* Plans without demands have no coverage row; empty networks give empty tables. Repeated links count once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators import planning
from meshwright.operators.graph import SOURCE, prune_loops
from meshwright.tables import checkpoint

ACTIVE, INACTIVE = ("PROPOSED", "EXISTING"), ("UNAVAILABLE", "UNREACHABLE")
RELAYS = ("POP", "DN")
#: A binary variable is taken as 1 above this.
ALMOST_ONE = 1 - 1e-5


@dataclass(frozen=True)
class Network:
    """sites: plan_id, site_id, site_type, status, place, weight. sectors: plan_id, sector_id, site_id, node, site_type, status.

    links: plan_id, src, dst, wired, capacity, status, tx_sector, rx_sector. demands: plan_id, demand, site_id, size.
    """

    sites: DataFrame
    sectors: DataFrame
    links: DataFrame
    demands: DataFrame
    real: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass(frozen=True)
class Rules:
    source_capacity: float = 10.0
    coverage: float = 1.0
    sources_stay: bool = False
    polarities: bool = True
    common_bandwidth: bool = False
    channels: int = 1
    relays_per_sector: int = 2
    links_per_sector: int = 15
    extra_sources: int = 0


def _v(kind: str, *parts) -> Column:
    """A variable's name."""
    return F.concat(F.lit(f"{kind}:"), *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _link(a: str = "src", b: str = "dst") -> Column:
    return F.concat(F.col(a), F.lit(">"), F.col(b))


def _rows(df: DataFrame, row_id: Column, terms: Iterable[tuple[Column, float | Column]], sense: str, bound: float | Column = 0.0) -> DataFrame:
    """Adds each row's terms to the model row of that id."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    each = F.explode(F.array(*(F.struct(v.alias("v"), as_column(c).cast("double").alias("c")) for v, c in terms))).alias("t")
    return df.select("plan_id", row_id.alias("row_id"), each, as_column(bound).cast("double").alias("bound")).select(
        "plan_id", "row_id", F.col("t.v").alias("variable"), F.col("t.c").alias("coefficient"), F.lit(sense).alias("sense"), "bound"
    )


def _all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _numbers(n: Column) -> Column:
    """One row for each number below n, as text."""
    return F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string")))


def _channels(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("c", _numbers(F.lit(n)))


def _status(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.coalesce("status", F.lit("CANDIDATE")))


def prepared(net: Network) -> Network:
    """The network with its real links and all edges written down, which most rules read."""
    if net.real is not None:
        return net
    net = replace(net, real=checkpoint(real_links(net)))
    return replace(net, edges=checkpoint(all_edges(net)))


def real_links(net: Network) -> DataFrame:
    """Links between sites of the network, each once, with both ends' types."""
    if net.real is not None:
        return net.real
    types = lambda k: net.sites.select("plan_id", F.col("site_id").alias(k), F.col("site_type").alias(f"{k}_type"))
    once = _status(net.links).groupBy("plan_id", "src", "dst").agg(F.min(F.struct("wired", F.coalesce("capacity", F.lit(0.0)).alias("capacity"), "status", "tx_sector", "rx_sector")).alias("x"))
    return once.select("plan_id", "src", "dst", "x.*").join(types("src"), ["plan_id", "src"]).join(types("dst"), ["plan_id", "dst"])


def all_edges(net: Network) -> DataFrame:
    """plan_id, src, dst, kind (SOURCE, WIRED, WIRELESS, DEMAND), capacity of everything that flow goes over."""
    if net.edges is not None:
        return net.edges
    none = F.lit(None).cast("double")
    real = real_links(net).select("plan_id", "src", "dst", F.when(F.col("wired"), "WIRED").otherwise("WIRELESS").alias("kind"), "capacity")
    source = net.sites.filter("site_type = 'POP'").select("plan_id", F.lit(SOURCE).alias("src"), F.col("site_id").alias("dst"), F.lit("SOURCE").alias("kind"), none.alias("capacity"))
    demand = net.demands.select("plan_id", F.col("site_id").alias("src"), F.col("demand").alias("dst"), F.lit("DEMAND").alias("kind"), none.alias("capacity"))
    return real.unionAll(source).unionAll(demand)


def totals(net: Network) -> DataFrame:
    """plan_id, total: all demand of a plan, which bounds every flow."""
    return net.demands.select("plan_id", "demand", "size").distinct().groupBy("plan_id").agg(F.sum("size").alias("total"))


def _flow_ends(edges: DataFrame) -> DataFrame:
    """Each edge once for the node it leaves (sign -1) and once for the one it enters (sign 1)."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(-1.0).alias("sign")), F.struct(F.col("dst").alias("node"), F.lit(1.0).alias("sign")))).alias("e")
    return edges.select("*", ends).select("*", "e.node", "e.sign")


# --- variables ----------------------------------------------------------------------------------------------------------
def _variables(df: DataFrame, name: Column, kind: str, low: float | None = 0.0, high: float | Column | None = None) -> DataFrame:
    high = high if isinstance(high, Column) else F.lit(high)
    return df.select("plan_id", name.alias("variable"), F.lit(kind).alias("kind"), F.lit(low).cast("double").alias("low"), high.cast("double").alias("high")).distinct()


def site_variables(net: Network) -> DataFrame:
    return _variables(net.sites, _v("site", F.col("site_id")), "binary", 0.0, 1.0)


def sector_variables(net: Network, rules: Rules) -> DataFrame:
    """A sector of a relay can have any channel, one of a client takes that of its relay."""
    relay = _channels(net.sectors.filter(F.col("site_type").isin(*RELAYS)), rules.channels)
    client = net.sectors.filter(~F.col("site_type").isin(*RELAYS)).withColumn("c", F.lit("0"))
    return _variables(relay.unionByName(client), _v("sector", F.col("sector_id"), ":", F.col("c")), "binary", 0.0, 1.0)


def flow_variables(net: Network, high: float | None = None) -> DataFrame:
    return _variables(all_edges(net), _v("flow", _link()), "continuous", 0.0, high)


def time_variables(net: Network, rules: Rules) -> DataFrame:
    return _variables(_channels(real_links(net).filter("not wired"), rules.channels), _v("time", _link(), ":", F.col("c")), "continuous", 0.0, 1.0)


def polarity_variables(net: Network) -> DataFrame:
    return _variables(net.sites.filter(F.col("site_type").isin(*RELAYS)), _v("odd", F.col("site_id")), "binary", 0.0, 1.0)


def shortage_variables(net: Network) -> DataFrame:
    return _variables(net.demands, _v("shortage", F.col("demand")), "continuous", 0.0, F.col("size"))


# --- rows of the site model ---------------------------------------------------------------------------------------------
def balance_rows(net: Network) -> DataFrame:
    """What comes in less what goes out: a demand's size less its shortage, the source's total in reverse, else 0."""
    flow = _flow_ends(all_edges(net)).join(totals(net), "plan_id", "left")
    size = net.demands.select("plan_id", F.col("demand").alias("node"), "size").distinct()
    flow = flow.join(size, ["plan_id", "node"], "left")
    bound = F.when(F.col("node") == SOURCE, -F.coalesce("total", F.lit(0.0))).otherwise(F.coalesce("size", F.lit(0.0)))
    rows = _rows(flow, _v("balance", F.col("node")), [(_v("flow", _link()), F.col("sign"))], "=", bound)
    demands = net.demands.select("plan_id", "demand", "size").distinct().join(totals(net), "plan_id")
    at_demand = _rows(demands, _v("balance", F.col("demand")), [(_v("shortage", F.col("demand")), 1.0)], "=", F.col("size"))
    # only plans that have a source have a row for it
    sourced = net.sites.filter("site_type = 'POP'").select("plan_id").distinct()
    at_source = _rows(demands.join(sourced, "plan_id"), _v("balance", SOURCE), [(_v("shortage", F.col("demand")), -1.0)], "=", -F.col("total"))
    return _all([rows, at_demand, at_source])


def flow_site_rows(net: Network) -> DataFrame:
    """Flow into and out of a site only if it is built; at source and demands at most the total."""
    ends = _flow_ends(all_edges(net)).join(totals(net), "plan_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    side = F.when(F.col("sign") > 0, "in:").otherwise("out:")
    is_site = ~((F.col("node") == SOURCE) | F.col("node").startswith("demand:"))
    row = F.concat(F.lit("use:"), side, F.col("node"))
    flows = _rows(ends, row, [(_v("flow", _link()), 1.0)], "<=", F.when(is_site, 0.0).otherwise(F.col("total")))
    sites = ends.filter(is_site).select("plan_id", "node", "total", side.alias("side")).distinct()
    return flows.unionByName(_rows(sites, F.concat(F.lit("use:"), "side", "node"), [(_v("site", F.col("node")), -F.col("total"))], "<=", 0.0))


def source_load_rows(net: Network, rules: Rules) -> DataFrame:
    """What a source sends on is at most its capacity."""
    out = all_edges(net).join(net.sites.filter("site_type = 'POP'").select("plan_id", F.col("site_id").alias("src")), ["plan_id", "src"], "left_semi")
    return _rows(out, _v("load", F.col("src")), [(_v("flow", _link()), 1.0)], "<=", rules.source_capacity)


def capacity_rows(net: Network, rules: Rules) -> DataFrame:
    """Wireless flow is at most capacity times the shares of time on all channels; other flow is at most capacity and total."""
    real = real_links(net)
    air = real.filter("not wired")
    flow = _rows(air, _v("capacity", _link()), [(_v("flow", _link()), 1.0)], "<=", 0.0)
    time = _rows(_channels(air, rules.channels), _v("capacity", _link()), [(_v("time", _link(), ":", F.col("c")), -F.col("capacity"))], "<=", 0.0)
    rest = all_edges(net).filter("kind <> 'WIRELESS'").join(totals(net), "plan_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return _all([flow, time, _rows(rest, _v("capacity", _link()), [(_v("flow", _link()), 1.0)], "<=", F.least("capacity", "total"))])


def _between_relays(net: Network) -> DataFrame:
    return real_links(net).filter(F.col("src_type").isin(*RELAYS) & F.col("dst_type").isin(*RELAYS))


def _opposite(df: DataFrame, name: str, terms: list[tuple[Column, float]]) -> DataFrame:
    """The sum of the terms is at most odd + odd and at most 2 - odd - odd of the link's ends."""
    a, b = _v("odd", F.col("src")), _v("odd", F.col("dst"))
    low = _rows(df, _v(f"{name}_low", _link()), [*terms, (a, -1.0), (b, -1.0)], "<=", 0.0)
    return low.unionByName(_rows(df, _v(f"{name}_high", _link()), [*terms, (a, 1.0), (b, 1.0)], "<=", 2.0))


def polarity_rows(net: Network, rules: Rules) -> DataFrame:
    """Links between relays carry only if their ends differ in polarity; the ends of active links do."""
    if not rules.polarities:
        return _rows(net.sites.limit(0), F.lit(""), [(F.lit(""), 0.0)], "=")
    between = _between_relays(net)
    free = between.filter(~F.col("status").isin(*ACTIVE) & ~F.col("wired"))
    times = [(_v("time", _link(), f":{c}"), 1.0) for c in range(rules.channels)]
    return _opposite(free, "polarity", times).unionByName(active_polarity_rows(net))


def active_polarity_rows(net: Network) -> DataFrame:
    return _rows(_between_relays(net).filter(F.col("status").isin(*ACTIVE)), _v("opposite", _link()), [(_v("odd", F.col("src")), 1.0), (_v("odd", F.col("dst")), 1.0)], "=", 1.0)


def idle_link_rows(net: Network, others: DataFrame | None = None) -> DataFrame:
    """No flow on inactive links, nor on others given (plan_id, src, dst), such as those that would disturb active ones."""
    off = real_links(net).filter(F.col("status").isin(*INACTIVE)).select("plan_id", "src", "dst")
    off = off if others is None else off.unionByName(others.select("plan_id", "src", "dst")).distinct()
    return _rows(off, _v("idle", _link()), [(_v("flow", _link()), 1.0)], "=", 0.0)


def sector_rows(net: Network, rules: Rules) -> DataFrame:
    """A sector's time for sending and for receiving is at most its use; it needs its site, equals the others of its node, has one channel."""
    air = _channels(real_links(net).filter("not wired"), rules.channels)
    ends = F.explode(F.array(F.struct(F.lit("tx:").alias("way"), F.col("tx_sector").alias("sector_id")), F.struct(F.lit("rx:").alias("way"), F.col("rx_sector").alias("sector_id")))).alias("s")
    known = sector_variables(net, rules).select("plan_id", F.col("variable").alias("of"))
    used = air.select("plan_id", "src", "dst", "c", ends).filter("s.sector_id is not null").withColumn("of", _v("sector", F.col("s.sector_id"), ":", F.col("c"))).join(known, ["plan_id", "of"], "left_semi")
    row = F.concat(F.lit("time:"), "s.way", "of")
    time = _rows(used, row, [(_v("time", _link(), ":", F.col("c")), 1.0)], "<=", 0.0)
    whole = _rows(used.select("plan_id", "s.way", "of").distinct(), F.concat(F.lit("time:"), "way", "of"), [(F.col("of"), -1.0)], "<=", 0.0)
    channels = F.when(F.col("site_type").isin(*RELAYS), rules.channels).otherwise(1)
    each = _status(net.sectors).withColumn("c", _numbers(channels))
    own = _v("sector", F.col("sector_id"), ":", F.col("c"))
    needs = _rows(each, _v("built", F.col("sector_id")), [(own, 1.0)], "<=", 0.0)
    needs = needs.unionByName(_rows(net.sectors, _v("built", F.col("sector_id")), [(_v("site", F.col("site_id")), -1.0)], "<=", 0.0))
    stays = _rows(each.filter("status = 'PROPOSED'"), _v("stays", F.col("sector_id")), [(own, 1.0)], "=", 1.0)
    single = _rows(each.filter(F.col("site_type").isin(*RELAYS)), _v("channel", F.col("sector_id")), [(own, 1.0)], "<=", 1.0) if rules.channels > 1 else None
    # neighbours in a node are equal, which makes all of them equal
    order = Window.partitionBy("plan_id", "site_id", "node").orderBy("sector_id")
    nodes = net.sectors.withColumn("next", F.lead("sector_id").over(order)).filter("next is not null").withColumn("c", _numbers(channels))
    alike = _rows(nodes, _v("node", F.col("sector_id")), [(own, 1.0), (_v("sector", F.col("next"), ":", F.col("c")), -1.0)], "=", 0.0)
    return _all([x for x in (time, whole, needs, stays, single, alike) if x is not None])


def _in_use(net: Network, rules: Rules) -> DataFrame:
    """Sites with whether they are in use already: by status, by an active link or, if sources stay, as a source."""
    ends = real_links(net).filter(F.col("status").isin(*ACTIVE)).select("plan_id", F.explode(F.array("src", "dst")).alias("site_id")).distinct()
    sites = _status(net.sites).join(ends.withColumn("linked", F.lit(True)), ["plan_id", "site_id"], "left")
    use = F.col("status").isin(*ACTIVE) | F.coalesce("linked", F.lit(False))
    if rules.sources_stay:
        use = use | ((F.col("site_type") == "POP") & ~F.col("status").isin(*INACTIVE))
    place = Window.partitionBy("plan_id", "place")
    rank = F.when(F.col("site_type") == "POP", 3).when(F.col("site_type") == "DN", 2).otherwise(1)
    sites = sites.withColumns({"used": use, "rank": rank}).drop("linked")
    return sites.withColumns({"at_place": F.count(F.lit(1)).over(place), "top": F.max(F.when(F.col("used"), F.col("rank"))).over(place)})


def excluded_sites(net: Network, rules: Rules) -> DataFrame:
    """Sites ruled out by one in use at their place: only a client may be replaced, and by a relay or source only."""
    other = F.when(F.col("top") > 1, F.col("rank") != F.col("top")).otherwise(F.lit(False)) | ((F.col("rank") == F.col("top")) & ~F.col("used"))
    return _in_use(net, rules).filter(F.col("top").isNotNull() & (F.col("at_place") > 1) & other)


def place_rows(net: Network, rules: Rules) -> DataFrame:
    """Of the sites at one place at most one is built, and exactly one if one is in use; excluded ones are not."""
    shared = _in_use(net, rules).filter("at_place > 1")
    site = [(_v("site", F.col("site_id")), 1.0)]
    one = _rows(shared.filter("top is null"), _v("place", F.col("place")), site, "<=", 1.0)
    kept = _rows(shared.filter("top is not null"), _v("place", F.col("place")), site, "=", 1.0)
    return _all([one, kept, _rows(excluded_sites(net, rules), _v("excluded", F.col("place")), site, "=", 0.0)])


def decided_site_rows(net: Network, rules: Rules) -> DataFrame:
    """Sites alone at their place that are in use stay, inactive ones are not built."""
    sites = _in_use(net, rules)
    by_status = F.col("status").isin(*ACTIVE) | ((F.col("site_type") == "POP") & ~F.col("status").isin(*INACTIVE) & F.lit(rules.sources_stay))
    site = [(_v("site", F.col("site_id")), 1.0)]
    on = _rows(sites.filter(by_status & (F.col("at_place") == 1)), _v("decided", F.col("site_id")), site, "=", 1.0)
    return on.unionByName(_rows(sites.filter(F.col("status").isin(*INACTIVE)), _v("decided", F.col("site_id")), site, "=", 0.0))


def coverage_rows(net: Network, rules: Rules, connected: DataFrame | None = None) -> DataFrame:
    """All shortage is at most the part of the demand that may stay open; with a common bandwidth, each connected demand gets its part of the least one."""
    demands = net.demands.select("plan_id", "demand", "size").distinct()
    if rules.common_bandwidth:
        if connected is not None:
            demands = demands.join(connected.select("plan_id", "demand"), ["plan_id", "demand"], "left_semi")
        least = F.min("size").over(Window.partitionBy("plan_id"))
        return _rows(demands.withColumn("least", least), _v("coverage", F.col("demand")), [(_v("shortage", F.col("demand")), 1.0)], "<=", F.col("size") - F.lit(rules.coverage) * F.col("least"))
    return _rows(demands.join(totals(net), "plan_id"), F.lit("coverage"), [(_v("shortage", F.col("demand")), 1.0)], "<=", F.lit(1 - rules.coverage) * F.col("total"))


def common_bandwidth_rows(net: Network, connected: DataFrame) -> DataFrame:
    demands = net.demands.select("plan_id", "demand", "size").distinct().join(connected.select("plan_id", "demand"), ["plan_id", "demand"], "left_semi")
    return _rows(demands, _v("common", F.col("demand")), [(F.lit("bandwidth"), 1.0), (_v("shortage", F.col("demand")), 1.0)], "<=", F.col("size"))


def coverage_goal(net: Network, rules: Rules) -> DataFrame:
    if rules.common_bandwidth:
        return net.demands.select("plan_id", F.lit("bandwidth").alias("variable"), F.lit(-1.0).alias("coefficient")).distinct()
    return net.demands.select("plan_id", _v("shortage", F.col("demand")).alias("variable"), F.lit(1.0).alias("coefficient")).distinct()


def weight_goal(net: Network) -> DataFrame:
    """Weights of the sites that do not exist yet."""
    return _status(net.sites).filter("status <> 'EXISTING'").select("plan_id", _v("site", F.col("site_id")).alias("variable"), F.col("weight").cast("double").alias("coefficient"))


def weight_limit_rows(net: Network, most: float) -> DataFrame:
    return _rows(_status(net.sites).filter("status <> 'EXISTING'"), F.lit("weight"), [(_v("site", F.col("site_id")), F.col("weight"))], "<=", most)


def source_count_rows(net: Network, rules: Rules, inputs: DataFrame) -> DataFrame:
    """Exactly as many sources as the inputs (sites before relays were added as sources) have and the rules add, if there are so many."""
    usable = lambda s: _status(s).filter("site_type = 'POP'").filter(~F.col("status").isin(*INACTIVE))
    have = usable(inputs).groupBy("plan_id").agg(F.count(F.lit(1)).alias("have"))
    could = usable(net.sites).groupBy("plan_id").agg(F.count(F.lit(1)).alias("could"))
    n = could.join(have, "plan_id", "left").select("plan_id", F.least(F.coalesce("have", F.lit(0)) + rules.extra_sources, "could").alias("n")).filter("n > 0")
    return _rows(net.sites.filter("site_type = 'POP'").join(n, "plan_id"), F.lit("sources"), [(_v("site", F.col("site_id")), 1.0)], "=", F.col("n"))


@dataclass(frozen=True)
class Model:
    variables: DataFrame
    rows: DataFrame
    goal: DataFrame


def site_model(net: Network, rules: Rules, goal: str = "weight", *, most_weight: float | None = None, inputs: DataFrame | None = None, connected: DataFrame | None = None, idle: DataFrame | None = None) -> Model:
    """Which sites to build. goal: weight (least weight at the wanted coverage), coverage (within most_weight), or sources (coverage with a number of sources)."""
    net = prepared(net)
    variables = [site_variables(net), sector_variables(net, rules), flow_variables(net), time_variables(net, rules), shortage_variables(net)]
    rows = [
        balance_rows(net), flow_site_rows(net), source_load_rows(net, rules), capacity_rows(net, rules), polarity_rows(net, rules), sector_rows(net, rules),
        place_rows(net, rules), decided_site_rows(net, rules), idle_link_rows(net, idle),
    ]
    # here a sector is used if its site is built
    own = _rows(net.sectors, _v("with_site", F.col("sector_id")), [(_v("sector", F.col("sector_id"), ":0"), 1.0), (_v("site", F.col("site_id")), -1.0)], "=", 0.0)
    rows.append(own)
    if rules.polarities:
        variables.append(polarity_variables(net))
    if goal == "weight":
        rows.append(coverage_rows(net, rules, connected))
    elif most_weight is not None:
        rows.append(weight_limit_rows(net, most_weight))
    if goal == "sources":
        rows.append(source_count_rows(net, rules, net.sites if inputs is None else inputs))
    if goal != "weight" and rules.common_bandwidth:
        rows.append(common_bandwidth_rows(net, net.demands if connected is None else connected))
        variables.append(_variables(net.demands, F.lit("bandwidth"), "continuous", 0.0, None))
    return Model(_all(variables), _all(rows), weight_goal(net) if goal == "weight" else coverage_goal(net, rules))


# --- further models -----------------------------------------------------------------------------------------------------
def demand_model(net: Network, rules: Rules, ignored_sites: DataFrame | None = None, ignored_links: DataFrame | None = None) -> Model:
    """The most demands that can be connected at once, if only that flow reaches them counts."""
    net = prepared(net)
    off = _status(net.sites).filter(F.col("status").isin(*INACTIVE)).select("plan_id", "site_id")
    off = off if ignored_sites is None else off.unionByName(ignored_sites.select("plan_id", "site_id")).distinct()
    closed = off.select("plan_id", F.col("site_id").alias("node"), F.lit(True).alias("off"))
    ends = _flow_ends(all_edges(net)).join(closed, ["plan_id", "node"], "left")
    demand, source = F.col("node").startswith("demand:"), F.col("node") == SOURCE
    flow = _v("flow", _link())
    kept = _rows(ends.filter(~demand & ~source & F.col("off").isNull()), _v("through", F.col("node")), [(flow, F.col("sign"))], "=", 0.0)
    shut = _rows(ends.filter("off"), _v("closed", F.col("node")), [(flow, 1.0)], "=", 0.0)
    many = net.demands.groupBy("plan_id").agg((F.countDistinct("demand") * -10.0).alias("many"))
    reach = _rows(ends.filter(demand).join(many, "plan_id"), _v("reached", F.col("dst")), [(flow, F.col("many"))], "<=", 0.0)
    reach = reach.unionByName(_rows(net.demands.select("plan_id", "demand").distinct(), _v("reached", F.col("demand")), [(_v("demand", F.col("demand")), 1.0)], "<=", 0.0))
    variables = [flow_variables(net, 1.0), _variables(net.demands, _v("demand", F.col("demand")), "binary", 0.0, 1.0)]
    rows = [kept, shut, reach, idle_link_rows(net, ignored_links)]
    if rules.polarities:
        variables.append(polarity_variables(net))
        rows += [_opposite(_between_relays(net).filter(~F.col("wired") & ~F.col("status").isin(*ACTIVE)), "polarity", [(flow, 1.0)]), active_polarity_rows(net)]
    goal = net.demands.select("plan_id", _v("demand", F.col("demand")).alias("variable"), F.lit(-1.0).alias("coefficient")).distinct()
    return Model(_all(variables), _all(rows), goal)


def buffer_model(net: Network, rules: Rules, connected: DataFrame) -> Model:
    """The largest equal flow to all connected demands over active sites and sectors: a linear program."""
    net = prepared(net)
    flow = _v("flow", _link())
    reached = connected.select("plan_id", F.col("demand").alias("node"), F.lit(True).alias("reached"))
    ends = _flow_ends(all_edges(net))
    inner = _rows(ends.filter(F.col("node") != SOURCE), _v("balance", F.col("node")), [(flow, F.col("sign"))], "=", 0.0)
    buffers = _rows(net.demands.select("plan_id", F.col("demand").alias("node")).distinct().join(reached, ["plan_id", "node"]), _v("balance", F.col("node")), [(F.lit("buffer"), -1.0)], "=", 0.0)
    source = _rows(ends.filter(F.col("node") == SOURCE), _v("balance", SOURCE), [(flow, F.col("sign"))], "<=", 0.0)
    in_use = lambda df, kind, name, on: _rows(df, _v("given", F.col(name)), [(_v(kind, F.col(name), *([":0"] if kind == "sector" else [])), 1.0)], "=", F.when(on, 1.0).otherwise(0.0))
    given = [in_use(_status(net.sites), "site", "site_id", F.col("status").isin(*ACTIVE)), in_use(_status(net.sectors), "sector", "sector_id", F.col("status") == "PROPOSED")]
    one = Rules(source_capacity=rules.source_capacity)
    times = sector_rows(net, one).filter("row_id like 'time:%'")
    rows = [inner, buffers, source, *given, times, capacity_rows(net, one), flow_site_rows(net), idle_link_rows(net), source_load_rows(net, one)]
    variables = [site_variables(net), sector_variables(net, one), flow_variables(net), time_variables(net, one), _variables(net.demands, F.lit("buffer"), "continuous", 0.0, None)]
    goal = net.demands.select("plan_id", F.lit("buffer").alias("variable"), F.lit(-1.0).alias("coefficient")).distinct()
    return Model(_all(variables), _all(rows), goal)


def link_rows(net: Network, rules: Rules, sharp: DataFrame | None = None) -> DataFrame:
    """Rules on the links to use. sharp: plan_id, src, dst, dst2, links of one site at too small an angle.

    A link carries and has time only if used; clients have one way in; links are used both ways; sectors and polarities
    fit; a sector has few links; of two sharp links at most one is used on a channel.
    """
    net = prepared(net)
    usable = real_links(net).filter("not wired and capacity > 0 and tx_sector is not null and rx_sector is not null")
    link, flow = _v("link", _link()), _v("flow", _link())
    parts = [
        _rows(usable, _v("carries", _link()), [(flow, 1.0), (link, -F.col("capacity"))], "<=", 0.0),
        _rows(usable, _v("times", _link()), [*((_v("time", _link(), f":{c}"), 1.0) for c in range(rules.channels)), (link, -1.0)], "<=", 0.0),
        _rows(usable.filter("dst_type = 'CN'"), _v("client", F.col("dst")), [(link, 1.0)], "<=", 1.0),
        _rows(usable.filter(F.col("status").isin(*ACTIVE)), _v("keeps", _link()), [(link, 1.0)], "=", 1.0),
        _rows(usable.filter(F.col("status").isin(*INACTIVE)), _v("drops", _link()), [(link, 1.0)], "=", 0.0),
    ]
    back = usable.select("plan_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    parts.append(_rows(usable.join(back, ["plan_id", "src", "dst"], "left_semi").filter("src < dst"), _v("both_ways", _link()), [(link, 1.0), (_v("link", _link("dst", "src")), -1.0)], "=", 0.0))
    if rules.polarities:
        parts.append(_opposite(usable.filter(F.col("src_type").isin(*RELAYS) & F.col("dst_type").isin(*RELAYS) & ~F.col("status").isin(*ACTIVE)), "link_polarity", [(link, 1.0)]))
    for end, kind in (("tx_sector", "src_type"), ("rx_sector", "dst_type")):
        n = F.when(F.col(kind).isin(*RELAYS), rules.channels).otherwise(1)
        each = usable.withColumn("c", _numbers(n))
        row = _v(f"needs_{end}", _link())
        parts += [_rows(usable, row, [(link, 1.0)], "<=", 0.0), _rows(each, row, [(_v("sector", F.col(end), ":", F.col("c")), -1.0)], "<=", 0.0)]
    if rules.channels > 1:
        between = _channels(usable.filter("dst_type <> 'CN'"), rules.channels)
        a, b = (_v("sector", F.col(s), ":", F.col("c")) for s in ("tx_sector", "rx_sector"))
        parts += [_rows(between, _v(f"same_{k}", _link(), ":", F.col("c")), [(link, 1.0), (x, -1.0), (y, 1.0)], "<=", 1.0) for k, x, y in (("tx", a, b), ("rx", b, a))]
    sent = usable.filter(F.col("src_type").isin(*RELAYS))
    for name, most, some in (("relays", rules.relays_per_sector, sent.filter(F.col("dst_type").isin(*RELAYS))), ("links", rules.links_per_sector, sent)):
        full = some.groupBy("plan_id", "tx_sector").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
        row = _v(f"sector_{name}", F.col("tx_sector"))
        parts.append(_rows(some.join(full, ["plan_id", "tx_sector"], "left_semi"), row, [(link, 1.0)], "<=", 0.0))
        parts.append(_rows(_channels(full, rules.channels), row, [(_v("sector", F.col("tx_sector"), ":", F.col("c")), -float(most))], "<=", 0.0))
    if sharp is not None:
        parts.append(_sharp_rows(usable, sharp, rules))
    return _all(parts)


def _sharp_rows(usable: DataFrame, sharp: DataFrame, rules: Rules) -> DataFrame:
    ends = usable.select("plan_id", "src", "dst", "tx_sector", "rx_sector", "dst_type", F.col("status").isin(*ACTIVE).alias("kept"))
    other = ends.select("plan_id", "src", *(F.col(c).alias(f"{c}2") for c in ("dst", "tx_sector", "rx_sector", "dst_type", "kept")))
    pairs = sharp.select("plan_id", "src", "dst", "dst2").join(ends, ["plan_id", "src", "dst"]).join(other, ["plan_id", "src", "dst2"]).filter("not (kept and kept2)")
    row = F.concat(F.lit("sharp:"), _link(), F.lit("|"), "dst2")
    if rules.channels == 1:
        return _rows(pairs, row, [(_v("link", _link()), 1.0), (_v("link", _link("src", "dst2")), 1.0)], "<=", 1.0)
    # a link's use on a channel is the product of its own use and that of both sectors there
    both = pairs.select("plan_id", "src", "dst", "tx_sector", "rx_sector", "dst_type").unionAll(pairs.select("plan_id", "src", F.col("dst2"), "tx_sector2", "rx_sector2", "dst_type2")).distinct()
    use = _channels(both, rules.channels)
    on = _v("used", _link(), ":", F.col("c"))
    rx = _v("sector", F.col("rx_sector"), ":", F.when(F.col("dst_type").isin(*RELAYS), F.col("c")).otherwise("0"))
    factors = [("link", _v("link", _link())), ("tx", _v("sector", F.col("tx_sector"), ":", F.col("c"))), ("rx", rx)]
    parts = [_rows(use, _v(f"used_{k}", _link(), ":", F.col("c")), [(on, 1.0), (v, -1.0)], "<=", 0.0) for k, v in factors]
    parts.append(_rows(use, _v("used_all", _link(), ":", F.col("c")), [(on, -1.0), *((v, 1.0) for _, v in factors)], "<=", 2.0))
    apart = _channels(pairs, rules.channels)
    parts.append(_rows(apart, F.concat(row, F.lit(":"), "c"), [(on, 1.0), (_v("used", _link("src", "dst2"), ":", F.col("c")), 1.0)], "<=", 1.0))
    return _all(parts)


def interference_rows(net: Network, levels: DataFrame) -> DataFrame:
    """Interference on each link of the network as a variable: the sum over disturbing links of their level times their time.

    levels: plan_id, src, dst (the victim), by_src, by_dst (the disturbing link), mw. Disturbers of the victim's own
    polarity only count if they may send while it receives, which their share of time tells.
    """
    row = _v("interference", _link())
    parts = _rows(levels, row, [(_v("time", _link("by_src", "by_dst"), ":0"), F.col("mw"))], "=", 0.0)
    return parts.unionByName(_rows(levels.select("plan_id", "src", "dst").distinct(), row, [(_v("mw", _link()), -1.0)], "=", 0.0))


def redundancy_model(net: Network, ways: DataFrame, rules: Rules, *, paths: float = 2.0, through: float = 1.0, source: float = 100.0, with_shortage: bool = True) -> Model:
    """Which relays to build so that each relay of `ways` has that many paths sharing no other relay.

    ways: plan_id, relay, src, dst: the edges its paths may use (from the pruning by flows), so the model has no flow for
    others. Phase one takes the least shortage as its goal, phase two (with_shortage=False) the least weight.
    """
    net = prepared(net)
    types = net.sites.select("plan_id", "site_id", "site_type")
    state = real_links(net).select("plan_id", "src", "dst", "status", "wired")
    used = ways.select("plan_id", "relay", "src", "dst").distinct().join(state, ["plan_id", "src", "dst"], "left")
    flow = _v("flow", _link(), ":", F.col("relay"))
    ends = _flow_ends(used).join(types.withColumnRenamed("site_id", "node"), ["plan_id", "node"], "left")
    is_source, is_sink = F.col("node") == SOURCE, F.col("node") == F.col("relay")
    key = F.concat("node", F.lit(":"), "relay")
    short = _v("shortage", F.col("relay"))
    relays = used.select("plan_id", "relay").distinct()
    inner = _rows(ends.filter(~is_source & ~is_sink), _v("balance", key), [(flow, F.col("sign"))], "=", 0.0)
    outer = _rows(ends.filter(is_source | is_sink), _v("balance", key), [(flow, F.col("sign"))], ">=", F.when(is_sink, paths).otherwise(-paths))
    cap = F.when(F.col("site_type") == "POP", source).when(is_sink, paths).otherwise(through)
    entering = ends.filter((F.col("sign") > 0) & ~is_source).withColumn("cap", cap)
    use = _rows(entering, _v("use", key), [(flow, 1.0)], "<=", 0.0)
    use = use.unionByName(_rows(entering.select("plan_id", "node", "relay", "cap").distinct(), _v("use", key), [(_v("site", F.col("node")), -F.col("cap"))], "<=", 0.0))
    idle = _rows(used.filter(F.col("status").isin(*INACTIVE)), _v("idle", _link(), ":", F.col("relay")), [(flow, 1.0)], "=", 0.0)
    touched = ends.filter(~is_source).select("plan_id", F.col("node").alias("site_id")).distinct()
    sites = _status(net.sites).join(touched, ["plan_id", "site_id"], "left_semi").withColumn("on", F.when(F.col("status").isin(*ACTIVE), 1.0).when(F.col("status").isin(*INACTIVE) | (F.col("site_type") == "POP"), 0.0))
    site = [(_v("site", F.col("site_id")), 1.0)]
    decided = _rows(sites.filter("on is not null"), _v("decided", F.col("site_id")), site, "=", F.col("on"))
    at_place = _rows(sites.filter(F.col("site_type").isin(*RELAYS)), _v("place", F.col("place")), site, "<=", 1.0)
    rows = [inner, outer, use, idle, decided, at_place]
    variables = [
        _variables(sites, _v("site", F.col("site_id")), "binary", 0.0, 1.0),
        _variables(used, flow, "continuous", 0.0, F.when((F.col("src") == SOURCE) | (F.col("dst") == SOURCE), source).otherwise(1.0)),
    ]
    goal = weight_goal(Network(sites, net.sectors, net.links, net.demands))
    if with_shortage:
        # at the relay the shortage is added to what comes in, at the source it is taken off what goes out
        at = F.explode(F.array(F.struct(F.col("relay").alias("node"), F.lit(1.0).alias("sign")), F.struct(F.lit(SOURCE).alias("node"), F.lit(-1.0).alias("sign")))).alias("a")
        each = relays.select("plan_id", "relay", at).select("plan_id", "relay", "a.node", "a.sign")
        rows.append(_rows(each, _v("balance", key), [(short, F.col("sign"))], ">=", F.when(F.col("sign") > 0, paths).otherwise(-paths)))
        variables.append(_variables(relays, short, "continuous", 0.0, paths))
        goal = relays.select("plan_id", short.alias("variable"), F.lit(1.0).alias("coefficient"))
    if rules.polarities:
        air = used.filter("wired = false")
        a, b = _v("odd", F.col("src")), _v("odd", F.col("dst"))
        free = air.filter(~F.col("status").isin(*ACTIVE))
        tied = air.filter(F.col("status").isin(*ACTIVE)).select("plan_id", "src", "dst").distinct()
        rows += [
            _rows(free, _v("polarity_low", _link(), ":", F.col("relay")), [(flow, 1.0), (a, -1.0), (b, -1.0)], "<=", 0.0),
            _rows(free, _v("polarity_high", _link(), ":", F.col("relay")), [(flow, 1.0), (a, 1.0), (b, 1.0)], "<=", 2.0),
            _rows(tied, _v("opposite", _link()), [(a, 1.0), (b, 1.0)], "=", 1.0),
        ]
        variables.append(_variables(sites.filter(F.col("site_type").isin(*RELAYS)), _v("odd", F.col("site_id")), "binary", 0.0, 1.0))
    return Model(_all(variables), _all(rows), goal)


# --- solving and reading solutions ---------------------------------------------------------------------------------------
SOLUTION = "plan_id string, status string, value double, variable string, amount double"


def _solve_plan(key, rows: pd.DataFrame) -> pd.DataFrame:
    part = lambda k: rows[rows["part"] == k]
    names = sorted(set(part("variable")["variable"]))
    at = {n: i for i, n in enumerate(names)}
    ids = sorted(set(part("row")["row_id"]))
    no_answer = lambda status: pd.DataFrame([(key[0], status, None, None, None)], columns=["plan_id", "status", "value", "variable", "amount"])
    if (len(ids) + 2 * len(names) + 1) * (3 * len(names) + 2 * len(ids) + 1) > planning.MOST_CELLS:
        return no_answer("too_large")
    row_of = {r: i for i, r in enumerate(ids)}
    a, b, senses = np.zeros((len(ids), len(names))), np.zeros(len(ids)), ["="] * len(ids)
    for r, v, c, s, bound in part("row")[["row_id", "variable", "coefficient", "sense", "bound"]].itertuples(index=False, name=None):
        if v in at:
            a[row_of[r], at[v]] += c
        b[row_of[r]], senses[row_of[r]] = bound, s
    c = np.zeros(len(names))
    for v, x in part("goal")[["variable", "coefficient"]].itertuples(index=False, name=None):
        if v in at:
            c[at[v]] += x
    binaries, limits = [], []
    for v, kind, high in part("variable")[["variable", "kind", "high"]].itertuples(index=False, name=None):
        if kind == "binary":
            binaries.append(at[v])
        elif high == high and high is not None:
            limits.append((at[v], high))
    if limits:
        extra = np.zeros((len(limits), len(names)))
        extra[np.arange(len(limits)), [i for i, _ in limits]] = 1.0
        a, b, senses = np.vstack([a, extra]), np.concatenate([b, [h for _, h in limits]]), [*senses, *["<="] * len(limits)]
    status, value, x = planning.branch_and_bound(c, a, b, senses, sorted(binaries))
    if status != "optimal":
        return no_answer(status)
    return pd.DataFrame({"plan_id": key[0], "status": status, "value": value, "variable": names, "amount": x})


def solve(model: Model) -> DataFrame:
    """Exact solution of each plan's model: plan_id, status, value, variable, amount; plans without one have a row with their status."""
    none = lambda kind: F.lit(None).cast(kind)
    v = model.variables.select("plan_id", F.lit("variable").alias("part"), none("string").alias("row_id"), "variable", none("double").alias("coefficient"), none("string").alias("sense"), none("double").alias("bound"), "kind", "high")
    r = model.rows.select("plan_id", F.lit("row").alias("part"), "row_id", "variable", "coefficient", "sense", "bound", none("string").alias("kind"), none("double").alias("high"))
    g = model.goal.select("plan_id", F.lit("goal").alias("part"), none("string").alias("row_id"), "variable", "coefficient", none("string").alias("sense"), none("double").alias("bound"), none("string").alias("kind"), none("double").alias("high"))
    rows = checkpoint(v.unionAll(r).unionAll(g))
    # models beyond the solver are turned away before any task gets them whole
    size = rows.filter("part <> 'goal'").groupBy("plan_id").agg(F.count_if(F.col("part") == "variable").alias("n"), F.approx_count_distinct("row_id").alias("m"))
    fits = (F.col("m") * F.lit(0.8) + F.col("n")) * F.col("n") <= planning.MOST_CELLS
    small = rows.join(size.filter(fits).select("plan_id"), "plan_id", "left_semi").groupBy("plan_id").applyInPandas(_solve_plan, SOLUTION)
    return small.unionAll(size.filter(~fits).select("plan_id", F.lit("too_large"), none("double"), none("string"), none("double")))


def decisions(solution: DataFrame, kind: str) -> DataFrame:
    """Names of a kind (site, sector, link, odd, demand) whose binary variable is 1: plan_id, name."""
    taken = solution.filter(F.col("variable").startswith(f"{kind}:") & (F.col("amount") > ALMOST_ONE))
    return taken.select("plan_id", F.expr(f"substring(variable, {len(kind) + 2})").alias("name"))


def _without_loops(pdf: pd.DataFrame) -> pd.DataFrame:
    kept = prune_loops({tuple(v[5:].split(">", 1)): x for v, x in zip(pdf["variable"], pdf["amount"], strict=True)})
    return pd.DataFrame({"plan_id": pdf["plan_id"].iloc[0], "src": [a for a, _ in kept], "dst": [b for _, b in kept], "flow": list(kept.values())})


def flows(solution: DataFrame) -> DataFrame:
    """Flow of each edge with its loops taken out: plan_id, src, dst, flow."""
    return solution.filter("variable like 'flow:%' and amount > 1e-9").groupBy("plan_id").applyInPandas(_without_loops, "plan_id string, src string, dst string, flow double")


def site_solution(net: Network, rules: Rules, solution: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen sites that are active already or have flow, and the links between them that fit: plan_id, site_id, and plan_id, src, dst.

    A link is used if both ends are chosen, its sectors are there, and it is wired, active, to a client, or its relays
    differ in polarity.
    """
    flow = flows(solution).select("plan_id", F.explode(F.array("src", "dst")).alias("site_id")).distinct()
    chosen = decisions(solution, "site").withColumnRenamed("name", "site_id")
    active = _status(net.sites).filter(F.col("status").isin(*ACTIVE)).select("plan_id", "site_id")
    built = chosen.join(flow.unionByName(active).distinct(), ["plan_id", "site_id"], "left_semi")
    odd = decisions(solution, "odd")
    end = lambda k: built.join(odd.select("plan_id", F.col("name").alias("site_id"), F.lit(True).alias("odd")), ["plan_id", "site_id"], "left").select("plan_id", F.col("site_id").alias(k), F.coalesce("odd", F.lit(False)).alias(f"{k}_odd"))
    links = real_links(net).filter(~F.col("status").isin(*INACTIVE)).join(end("src"), ["plan_id", "src"]).join(end("dst"), ["plan_id", "dst"])
    relays = F.col("src_type").isin(*RELAYS) & F.col("dst_type").isin(*RELAYS)
    fits = F.col("wired") | F.col("status").isin(*ACTIVE) | ~relays | (F.col("src_odd") != F.col("dst_odd")) | F.lit(not rules.polarities)
    sectors = F.col("wired") | (F.col("tx_sector").isNotNull() & F.col("rx_sector").isNotNull())
    return built, links.filter(fits & sectors).select("plan_id", "src", "dst")


#: Shares of the demand that are asked for one after the other until a plan can give one.
COVERAGES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5)


def least_weight_at_best_coverage(net: Network, rules: Rules, **more) -> DataFrame:
    """Each plan's solution of least weight at the highest of COVERAGES that it can reach, with that coverage; else its last status."""
    net = prepared(net)
    out, left = None, net.sites.select("plan_id").distinct()
    for share in COVERAGES:
        part = lambda df: df.join(left, "plan_id", "left_semi")  # noqa: B023, E731
        some = Network(part(net.sites), part(net.sectors), part(net.links), part(net.demands), part(net.real), part(net.edges))
        got = checkpoint(solve(site_model(some, replace(rules, coverage=share), **more)).withColumn("coverage", F.lit(share)))
        last = share == COVERAGES[-1]
        done = got if last else got.filter("status <> 'infeasible'")
        out = done if out is None else out.unionAll(done)
        left = checkpoint(got.filter("status = 'infeasible'").select("plan_id").distinct())
        if left.isEmpty():
            break
    return out


def with_statuses(net: Network, rules: Rules, solution: DataFrame) -> Network:
    """The network with what the solution uses proposed and other proposals made candidates again; existing and unavailable parts stay.

    Plans without a solution stay as they are.
    """
    built, used = site_solution(net, rules, solution)
    solved = solution.filter("status = 'optimal'").select("plan_id").distinct()

    def marked(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
        both = _status(df).join(chosen.select("plan_id", *keys).distinct().withColumn("chosen", F.lit(True)), ["plan_id", *keys], "left").join(solved.withColumn("solved", F.lit(True)), "plan_id", "left")
        free = F.col("solved") & ~F.col("status").isin("EXISTING", "UNAVAILABLE")
        return both.withColumn("status", F.when(free, F.when(F.col("chosen"), "PROPOSED").when(F.col("status") == "PROPOSED", "CANDIDATE").otherwise(F.col("status"))).otherwise(F.col("status"))).select(*df.columns)

    ends = used.join(real_links(net).select("plan_id", "src", "dst", "tx_sector", "rx_sector"), ["plan_id", "src", "dst"])
    sectors = ends.select("plan_id", F.explode(F.array("tx_sector", "rx_sector")).alias("sector_id")).filter("sector_id is not null")
    return Network(marked(net.sites, built, ["site_id"]), marked(net.sectors, sectors, ["sector_id"]), marked(net.links, used, ["src", "dst"]), net.demands)


def relays_as_sources(net: Network, suffix: str = "_source") -> Network:
    """Each relay once more as a source at its place, with copies of its sectors and links; links among relays are left out.

    What remains lets sources reach clients only, so that choosing sources is choosing relays.
    """
    new = lambda c: F.concat(F.col(c), F.lit(suffix))
    relays = _status(net.sites).filter("site_type = 'DN'")
    copies = relays.withColumns({"site_id": new("site_id"), "site_type": F.lit("POP")}).select(*net.sites.columns)
    sectors = net.sectors.filter("site_type = 'DN'").withColumns({"sector_id": new("sector_id"), "site_id": new("site_id"), "site_type": F.lit("POP")})
    of = relays.select("plan_id", F.col("site_id").alias("src"), F.lit(True).alias("relay"))
    clients = net.sites.filter("site_type = 'CN'").select("plan_id", F.col("site_id").alias("dst"))
    links = net.links.join(clients, ["plan_id", "dst"], "left_semi").join(of, ["plan_id", "src"], "left")
    links = links.withColumns({"src": F.when(F.col("relay"), new("src")).otherwise(F.col("src")), "tx_sector": F.when(F.col("relay"), new("tx_sector")).otherwise(F.col("tx_sector"))}).select(*net.links.columns)
    keep = net.sites.filter("site_type <> 'DN'")
    return Network(keep.unionByName(copies), net.sectors.filter("site_type <> 'DN'").unionByName(sectors.select(*net.sectors.columns)), links, net.demands)


def source_can_send(net: Network) -> DataFrame:
    """Plans in which some source has a link with capacity: plan_id."""
    return real_links(net).filter("src_type = 'POP' and capacity > 0").select("plan_id").distinct()


def demand_can_receive(net: Network) -> DataFrame:
    """Plans in which some demand hangs on a source or on a site that a link with capacity leads to: plan_id."""
    into = real_links(net).filter("capacity > 0").select("plan_id", F.col("dst").alias("site_id")).unionByName(net.sites.filter("site_type = 'POP'").select("plan_id", "site_id")).distinct()
    return net.demands.join(into, ["plan_id", "site_id"], "left_semi").select("plan_id").distinct()
