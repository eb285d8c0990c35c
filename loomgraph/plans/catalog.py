"""Registered queries of the graph engine, each with the SQL that gives the same rows.

They exercise the operators over whole tables. Limits stand only where a report is a top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.operators import graph as G
from loomgraph.operators import procedures
from loomgraph.operators import resolve as R
from loomgraph.operators import revisions as V
from loomgraph.operators.scan import scan
from loomgraph.plans import cypher
from loomgraph.plans.tables import purchase_graph, table, trade_graph
from loomgraph.plans.types import nearest_types as nearest
from loomgraph.sources.docs import resolve_mentions

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_BUYS = "b AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase' AND value > 100), e AS (SELECT DISTINCT user_id AS src, nxt AS dst FROM b WHERE nxt IS NOT NULL AND nxt <> user_id)"
_HUB = "hub AS (SELECT dst AS id FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)"
_SUPPLIES = "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem"


# Scans, predicates, ordering


@query("SELECT count(*) AS n FROM orders")
def label_scan_count(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (o:Order) RETURN count(o) AS n")


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def eq_filter_count(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (c:Customer) WHERE c.c_mktsegment = $segment RETURN count(c) AS n", {"segment": "BUILDING"})


@query("SELECT count(*) AS n FROM part WHERE contains(p_name, 'a')")
def contains_filter(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (p:Part) WHERE p.title CONTAINS 'a' RETURN count(p) AS n")


@query("SELECT count(*) AS n FROM part WHERE starts_with(p_brand, 'Brand#1') AND NOT ends_with(p_name, '7')")
def starts_ends_filter(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (p:Part) WHERE p.p_brand STARTS WITH 'Brand#1' AND NOT p.title ENDS WITH '7' RETURN count(*) AS n")


@query("SELECT p_partkey AS id FROM part WHERE regexp_full_match(p_name, '.*[02468]')")
def regex_full_match(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (p:Part) WHERE p.title =~ '.*[02468]' RETURN p.id AS id")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_order_limit(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (o:Order) RETURN o.id AS id, o.o_totalprice AS price ORDER BY price DESC, id ASC LIMIT 20")


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_acctbal > 1000 OR c_custkey < 100) GROUP BY c_nationkey")
def in_list_filter(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] AND (c.c_acctbal > 1000 OR c.id < 100) RETURN c.c_nationkey AS nation, count(*) AS n")


@query("SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders")
def unlabelled_nodes(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS n")


# Hops


@query("SELECT o_custkey AS customer, count(*) AS c FROM orders GROUP BY o_custkey ORDER BY c DESC, customer LIMIT 20")
def defs_per_parent(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.id AS customer, count(o) AS c ORDER BY c DESC, customer ASC LIMIT 20")


@query(f"SELECT count(*) AS n FROM ({_SUPPLIES})")
def edge_scan_count(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (:Supplier)-[:SUPPLIES]->(:Part) RETURN count(*) AS n")


@query(f"WITH e AS ({_SUPPLIES}), {_HUB} SELECT src AS id FROM e JOIN hub ON dst = id")
def anchored_one_hop(spark, d):
    edges = trade_graph(spark, d).pairs("SUPPLIES")
    return G.neighbours(edges, G.hubs(edges, "dst"), reverse=True).select("id")


@query("SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def two_hop_count(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.title AS region, count(*) AS n")


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey = 7")
def reverse_one_hop(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (p:Part)<-[:SUPPLIES]-(s:Supplier {id: 7}) RETURN p.id AS id")


@query("SELECT c_mktsegment AS segment, p_brand AS brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def typed_mix_chain(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS_PART]->(p:Part) RETURN c.c_mktsegment AS segment, p.p_brand AS brand, count(*) AS n")


@query("SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders")
def edge_type_union(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH ()-[r:IN_REGION|IN_NATION|PLACED]->() RETURN type(r) AS t, count(*) AS n")


@query("SELECT DISTINCT n_name AS nation, p_brand AS brand FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey")
def distinct_endpoints(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier)-[:SUPPLIES]->(p:Part) RETURN DISTINCT n.title AS nation, p.p_brand AS brand")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment")
def exists_semi(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000 } RETURN c.c_mktsegment AS segment, count(*) AS n")


@query("SELECT region, count(*) AS nations, CAST(sum(n) AS BIGINT) AS customers FROM (SELECT n_regionkey AS region, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL) WHERE n > 50 GROUP BY region")
def with_then_aggregate(spark, d):
    return cypher.run(trade_graph(spark, d), "MATCH (r:Region)<-[:IN_REGION]-(m:Nation)<-[:IN_NATION]-(c:Customer) WITH r.id AS region, m.id AS nation, count(c) AS n WHERE n > 50 RETURN region, count(*) AS nations, sum(n) AS customers")


# Variable length, hubs, procedures


@query(f"WITH RECURSIVE {_BUYS}, {_HUB}, r AS (SELECT e.src AS id, 1 AS hops FROM e JOIN hub ON e.dst = hub.id UNION SELECT e.src, hops + 1 FROM r JOIN e ON e.dst = r.id WHERE hops < 3) SELECT id, min(hops) AS hops FROM r GROUP BY id")
def varlen_reach_1_3(spark, d):
    edges = purchase_graph(spark, d)
    return G.reach(edges, G.hubs(edges, "dst"), 3, reverse=True)


@query(f"""WITH {_BUYS}, {_HUB}, a AS (SELECT e.src AS x1, e.dst AS x0 FROM e JOIN hub ON e.dst = hub.id), two AS (SELECT a.*, e.src AS x2 FROM a JOIN e ON e.dst = a.x1 WHERE NOT (e.src = a.x1 AND e.dst = a.x0)),
three AS (SELECT two.*, e.src AS x3 FROM two JOIN e ON e.dst = two.x2 WHERE NOT (e.src = two.x1 AND e.dst = two.x0) AND NOT (e.src = two.x2 AND e.dst = two.x1))
SELECT 1 AS hops, count(*) AS n FROM a UNION ALL SELECT 2, count(*) FROM two UNION ALL SELECT 3, count(*) FROM three""")
def varlen_trails_count(spark, d):
    edges = purchase_graph(spark, d)
    return G.trails(edges, G.hubs(edges, "dst"), 1, 3, reverse=True).groupBy("hops").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_BUYS}, {_HUB}, r AS (SELECT e.src AS id, 1 AS hops FROM e JOIN hub ON e.dst = hub.id UNION SELECT e.src, hops + 1 FROM r JOIN e ON e.dst = r.id WHERE hops < 3) SELECT count(DISTINCT id) AS n FROM r")
def varlen_cypher(spark, d):
    edges = purchase_graph(spark, d)
    users = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    g = G.PropertyGraph({"User": users}, {("NEXT", "User", "User"): edges})
    hub = G.hubs(edges, "dst").first()["id"]
    return cypher.run(g, "MATCH (u:User {id: $hub})<-[:NEXT*1..3]-(v:User) RETURN count(DISTINCT v) AS n", {"hub": hub})


@query(f"WITH RECURSIVE {_BUYS}, {_HUB}, r AS (SELECT e.src AS id, 1 AS hops FROM e JOIN hub ON e.dst = hub.id UNION SELECT e.src, hops + 1 FROM r JOIN e ON e.dst = r.id WHERE hops < 10) SELECT DISTINCT id FROM r")
def varlen_1_10(spark, d):
    """Ten hops: each step is settled, so the plan stays as short as one hop's."""
    edges = purchase_graph(spark, d)
    users = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    g = G.PropertyGraph({"User": users}, {("NEXT", "User", "User"): edges})
    hub = G.hubs(edges, "dst").first()["id"]
    return cypher.run(g, "MATCH (u:User {id: $hub})<-[:NEXT*1..10]-(v:User) RETURN DISTINCT v.id AS id", {"hub": hub})


@query(f"WITH {_BUYS}, n AS (SELECT DISTINCT user_id AS id FROM events) SELECT id FROM n WHERE id NOT IN (SELECT dst FROM e) AND id % 7 <> 0")
def dead_code(spark, d):
    """The procedure itself: functions (users here) that nothing calls; each seventh is a test."""
    users = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    nodes = users.select("id", F.concat(F.lit("f"), "id").alias("title"), (F.col("id") % 7 == 0).alias("is_test"))
    g = G.PropertyGraph({"Function": nodes}, {("CALLS", "Function", "Function"): purchase_graph(spark, d)})
    return procedures.dead_code(g).select("id")


@query(f"WITH RECURSIVE {_BUYS}, {_HUB}, r AS (SELECT id FROM hub UNION SELECT e.src FROM r JOIN e ON e.dst = r.id) SELECT DISTINCT 'src/' || id || '.py' AS test_file FROM r WHERE id % 3 = 0")
def affected_tests(spark, d):
    """The procedure itself: test files (each third user here) that import the hub's file, through any number of others."""
    path = lambda c: F.concat(F.lit("src/"), F.col(c).cast("string"), F.lit(".py"))
    edges, users = purchase_graph(spark, d), table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    g = G.PropertyGraph({"File": users.select(path("id").alias("id"), (F.col("id") % 3 == 0).alias("is_test"))}, {("IMPORTS", "File", "File"): edges.select(path("src").alias("src"), path("dst").alias("dst"))})
    return procedures.affected_tests(g, [f"{G.hubs(edges, 'dst').first()['id']}.py"])


@query(f"WITH RECURSIVE {_BUYS}, {_HUB}, r AS (SELECT id, 0 AS hops FROM hub UNION SELECT e.dst, hops + 1 FROM r JOIN e ON e.src = r.id WHERE hops < 4) SELECT id, min(hops) AS hops FROM r GROUP BY id")
def affected_reach(spark, d):
    edges = purchase_graph(spark, d)
    return G.reach(edges, G.hubs(edges, "dst"), 4, include_seeds=True)


@query(f"WITH RECURSIVE {_BUYS}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst) SELECT src, dst FROM r WHERE src <> dst")
def closure(spark, d):
    return G.closure(purchase_graph(spark, d))


@query(f"SELECT * FROM (SELECT dst AS part, count(*) AS in_degree FROM ({_SUPPLIES}) GROUP BY dst ORDER BY in_degree DESC, part LIMIT 10)")
def hub_ranking(spark, d):
    edges = trade_graph(spark, d).pairs("SUPPLIES")
    return G.hubs(edges, "dst", 10).select(F.col("id").alias("part"), F.col("degree").alias("in_degree"))


@query(f"WITH e AS ({_SUPPLIES}) (SELECT 'in' AS side, dst AS id, count(*) AS degree FROM e GROUP BY dst ORDER BY degree DESC, id LIMIT 1) UNION ALL (SELECT 'out', src, count(*) AS degree FROM e GROUP BY src ORDER BY degree DESC, src LIMIT 1)")
def hub_in_out(spark, d):
    edges = trade_graph(spark, d).pairs("SUPPLIES")
    return G.hubs(edges, "dst").select(F.lit("in").alias("side"), "id", "degree").unionByName(G.hubs(edges, "src").select(F.lit("out").alias("side"), "id", "degree"))


@query(f"SELECT 'Nation' AS src_type, 'IN_REGION' AS edge_type, 'Region' AS tgt_type, count(*) AS count FROM nation UNION ALL SELECT 'Customer', 'IN_NATION', 'Nation', count(*) FROM customer UNION ALL SELECT 'Supplier', 'IN_NATION', 'Nation', count(*) FROM supplier UNION ALL SELECT 'Customer', 'PLACED', 'Order', count(*) FROM orders UNION ALL SELECT 'Order', 'CONTAINS_PART', 'Part', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'Supplier', 'SUPPLIES', 'Part', count(*) FROM ({_SUPPLIES})")
def triple_stats(spark, d):
    return cypher.run(trade_graph(spark, d), "CALL refresh_stats() YIELD src_type, edge_type, tgt_type, count")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996)")
def dead_nodes_anti(spark, d):
    sold = table(spark, d, "lineitem").where(F.year("l_shipdate") == 1996).select(F.col("l_partkey").alias("id"))
    return trade_graph(spark, d).nodes("Part").select("id").join(sold, "id", "left_anti")


# Cleaning and aggregation


@query("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem) WHERE rn = 1")
def keep_last_dedup(spark, d):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    return R.keep_last(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)


@query("WITH x AS (SELECT DISTINCT l_orderkey || '.' || l_linenumber AS name, CAST(l_partkey AS VARCHAR) AS signature FROM lineitem) SELECT name, signature, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '#' || sha256(signature) ELSE name END AS entity_id FROM x")
def overload_ids(spark, d):
    named = table(spark, d, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("name"), F.col("l_partkey").cast("string").alias("signature")).distinct()
    return R.overload_ids(named, "name", "signature")


@query("SELECT l_suppkey AS src, l_partkey AS dst, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS sites, count(*) AS site_count FROM (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem) GROUP BY ALL")
def site_aggregate(spark, d):
    return G.one_edge_per_pair(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber"), "l_linenumber")


@query("WITH x AS (SELECT l_suppkey AS src, l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS r, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS l FROM lineitem) SELECT src, dst, min(r) AS best_rank, min(q) AS candidates, string_agg(DISTINCT l, ',' ORDER BY l) AS lines, count(DISTINCT l) AS line_count FROM x GROUP BY ALL")
def min_tier_merge(spark, d):
    rank = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), rank.alias("r"), F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").alias("l"))
    return R.merge_sites(x, ["src", "dst"], "r", "q", "l")


@query("SELECT l_suppkey AS supplier, bit_or(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END) AS positions FROM lineitem GROUP BY ALL")
def bit_or_positions(spark, d):
    bit = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(4)
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.bit_or(bit).alias("positions"))


@query("SELECT n_regionkey AS owner, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS fields FROM nation GROUP BY ALL")
def parent_json(spark, d):
    items = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("owner")).agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["n_nationkey"].cast("string"), x["n_name"])), ",").alias("fields"))


# Resolution kernels


@query("WITH n AS (SELECT p_name, min(p_partkey) AS target FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1) SELECT p_partkey AS site, p_name AS name, target FROM part JOIN n USING (p_name)")
def unique_match_join(spark, d):
    part = table(spark, d, "part")
    sites = part.select(F.col("p_partkey").alias("site"), F.col("p_name").alias("name"))
    return R.unique_match(sites, part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("target")), "name", "target").select("site", "name", "target")


@query("""WITH c AS (SELECT c_custkey AS site, s_suppkey AS target, c_nationkey = s_nationkey AS same_nation, a.n_regionkey = b.n_regionkey AS same_region, c_mktsegment
FROM customer JOIN nation a ON a.n_nationkey = c_nationkey JOIN supplier ON s_suppkey % 50 = c_custkey % 50 JOIN nation b ON b.n_nationkey = s_nationkey),
k AS (SELECT *, count(*) OVER (PARTITION BY site) AS n, bool_or(same_region) OVER (PARTITION BY site) AS any_region FROM c),
k2 AS (SELECT * FROM k WHERE n = 1 OR NOT any_region OR same_region),
k3 AS (SELECT *, count(*) OVER (PARTITION BY site) AS n2, bool_or(same_nation) OVER (PARTITION BY site) AS any_nation FROM k2),
k4 AS (SELECT site, target, CASE WHEN n2 > 1 AND n > 1 AND any_nation THEN 'nation' WHEN n > 1 AND any_region THEN 'region' ELSE 'unique_name' END AS tier FROM k3 WHERE n = 1 OR n2 = 1 OR NOT any_nation OR same_nation),
k5 AS (SELECT *, count(*) OVER (PARTITION BY site) AS candidates FROM k4) SELECT site, target, tier, candidates FROM k5 WHERE candidates <= 5""")
def tiered_resolution(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).alias("name")).join(n, "nation")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).alias("name")).join(n, "nation")
    return R.tiered_match(c, s, ["site"], "name", [("region", "region"), ("nation", "nation")], 5).select("site", "target", "tier", "candidates")


_PATH = "regexp_extract(url, '^https?://([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), k AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS name FROM p),
g AS (SELECT page_id, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS name, n FROM p, unnest(range(1, len(string_split(path, '/')) + 1)) t(n))
SELECT page_id, arg_max(g.name, n) AS name FROM g JOIN k ON g.name = k.name GROUP BY page_id""")
def first_candidate(spark, d):
    path = F.regexp_extract("url", r"^https?://([^?#]*)", 1)
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    known = pages.select(F.regexp_replace("path", "/[^/]*$", "").alias("name"))
    return R.first_candidate(pages.withColumn("generated", R.prefixes(F.col("path"))), ["page_id"], "generated", known, "name")


@query("""WITH c AS (SELECT s_suppkey AS site, n_nationkey AS target, 100 * CAST(s_nationkey % 5 = n_regionkey AS INT) + length(n_name) AS score FROM supplier JOIN nation ON n_nationkey % 5 = s_suppkey % 5)
SELECT site, score, target FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, target DESC) AS rn FROM c) WHERE rn = 1""")
def scored_best(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    c = s.join(n, s["s_suppkey"] % 5 == n["n_nationkey"] % 5).withColumnsRenamed({"s_suppkey": "site", "n_nationkey": "target"})
    return R.scored_best(c, ["site"], F.lit(100) * (F.col("s_nationkey") % 5 == F.col("n_regionkey")).cast("int") + F.length("n_name"), ["target"], "target")


_TEMPLATES = ["/{a}/{b}", "/{kind}/{id}/{part}", "/{only}", "/", "/page/{id}", "/{section}/item/{id}"]


@query("WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://[^/]*|[?#].*$', '', 'g'), '/'), lambda x: x <> '') AS s FROM pages), t AS (SELECT template, list_filter(string_split(template, '/'), lambda x: x <> '') AS s FROM (VALUES " + ", ".join(f"('{t}')" for t in _TEMPLATES) + ") v(template)) SELECT page_id, template FROM p JOIN t ON len(p.s) = len(t.s) WHERE len(p.s) = 0 OR list_bool_and(list_transform(range(1, len(t.s) + 1), lambda i: starts_with(t.s[i], '{') OR t.s[i] = p.s[i]))")
def segment_match(spark, d):
    paths = table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://[^/]*|[?#].*$", "").alias("path"))
    templates = spark.createDataFrame([(t,) for t in _TEMPLATES], "template string")
    return R.segment_match(paths, "path", templates, "template").select("page_id", "template")


@query("WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT e.user_id, count(*) AS n FROM events e JOIN s ON e.user_id = s.user_id AND e.ts BETWEEN a AND b GROUP BY e.user_id")
def range_join(spark, d):
    e = table(spark, d, "events")
    spans = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return e.join(spans, "user_id").where("ts BETWEEN a AND b").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT r_name AS module, segment FROM region, (SELECT DISTINCT c_mktsegment AS segment FROM customer)")
def cross_join_expose(spark, d):
    modules = table(spark, d, "region").select(F.col("r_name").alias("module"))  # five rows: a module exposes every definition
    return modules.crossJoin(table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct())


@query("""WITH v AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(p_type), '[a-z]+')) AS w FROM part)),
u AS (SELECT p_partkey AS site, unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w, 1 AS bit FROM part UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(p_type), '[a-z]+')), 2 FROM part)
SELECT site, w AS used, CASE bit_or(bit) WHEN 3 THEN 'both' WHEN 1 THEN 'name' ELSE 'type' END AS position FROM u JOIN v USING (w) GROUP BY ALL""")
def token_uses(spark, d):
    part, tokens = table(spark, d, "part"), lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    vocabulary = part.select(tokens("p_type").alias("used")).distinct()
    uses = part.select(F.col("p_partkey").alias("site"), tokens("p_name").alias("used"), F.lit(1).alias("bit")).unionByName(part.select(F.col("p_partkey").alias("site"), tokens("p_type").alias("used"), F.lit(2).alias("bit")))
    bits = F.bit_or("bit")
    return uses.join(vocabulary, "used").groupBy("site", "used").agg(F.when(bits == 3, "both").when(bits == 1, "name").otherwise("type").alias("position"))


#: Names to seek: the first word of each benchmark item, and the first two.
_SOUGHT = "SELECT DISTINCT name FROM (SELECT regexp_extract(text, '^[A-Za-z]+') AS name FROM benchmark UNION ALL SELECT regexp_extract(text, '^[A-Za-z]+ [A-Za-z]+') FROM benchmark) WHERE name <> ''"


@query(f"""WITH names AS ({_SOUGHT}), alt AS (SELECT string_agg(name, '|' ORDER BY length(name) DESC, name) AS a FROM names),
parts AS (SELECT doc_id, string_split(regexp_replace(text, '(' || a || ')', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM documents, alt WHERE text IS NOT NULL),
one AS (SELECT doc_id, i, len(p) AS n, replace(p[i - 1], chr(2), '') AS before, split_part(p[i], chr(2), 1) AS name, split_part(p[i], chr(2), 2) AS after FROM parts, unnest(range(2, len(p) + 1)) t(i)),
clear AS (SELECT * FROM one WHERE NOT regexp_matches(right(before, 1), '[A-Za-z0-9_]') AND CASE WHEN after <> '' THEN NOT regexp_matches(left(after, 1), '[A-Za-z0-9_]') ELSE i = n END)
SELECT doc_id, name, count(*) AS n FROM clear GROUP BY ALL""")
def name_scan(spark, d):
    """The scan behind USES_TYPE: names of items in all documents, the longest at each place."""
    text = table(spark, d, "benchmark")
    first = lambda p: text.select(F.regexp_extract("text", p, 0).alias("name"))
    found = scan(table(spark, d, "documents"), "doc_id", "text", first("^[A-Za-z]+").unionByName(first("^[A-Za-z]+ [A-Za-z]+")), "name")
    return found.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


@query(f"WITH p AS (SELECT {_PATH} AS path FROM pages), g AS (SELECT DISTINCT array_to_string(list_slice(s, 1, n), '/') AS module, CAST(n AS INT) AS depth FROM (SELECT string_split(path, '/') AS s FROM p), unnest(range(1, len(s) + 1)) t(n) WHERE NOT regexp_full_match(s[n], '[0-9]+')) SELECT module, depth FROM g")
def prefix_modules(spark, d):
    parts = F.split(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/")
    rows = table(spark, d, "pages").select(F.explode(F.transform(parts, lambda s, i: F.struct(F.array_join(F.slice(parts, 1, i + 1), "/").alias("module"), (i + 1).alias("depth"), s.alias("leaf")))).alias("m"))
    return rows.where(~F.col("m.leaf").rlike("^[0-9]+$")).select("m.module", "m.depth").distinct()


@query("""WITH t AS (SELECT DISTINCT concat_ws('.', p_type, p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS id, split_part(p_name, ' ', 2) AS title,
  CASE WHEN p_size % 2 = 0 THEN 'Class' ELSE 'Interface' END AS label FROM part),
sc AS (SELECT p_brand AS source, p_type || '.' || p_brand AS scope FROM part UNION SELECT p_brand, p_type FROM part WHERE p_size > 25),
s AS (SELECT DISTINCT p_brand AS source, split_part(p_name, ' ', 2) AS target, p_size % 3 = 0 AS prefers_interface FROM part),
near AS (SELECT t.id, sc.source, max(length(scope)) AS n FROM t JOIN sc ON starts_with(t.id, scope || '.') GROUP BY ALL),
c AS (SELECT s.*, t.id, t.label, CASE WHEN (t.label = 'Interface') = prefers_interface THEN 100 ELSE 0 END + coalesce(near.n, 0) AS score
  FROM s JOIN t ON t.title = s.target LEFT JOIN near ON near.id = t.id AND near.source = s.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source, target, prefers_interface ORDER BY score DESC, label = 'Interface' DESC, id DESC) AS pos FROM c)
SELECT source, target, prefers_interface, CAST(score AS BIGINT) AS score, id AS dst, label AS dst_label FROM r WHERE pos = 1""")
def nearest_types(spark, d):
    """The choice behind EXTENDS and IMPLEMENTS: of all parts of a name the one nearest to a brand, by kind and longest scope."""
    part, words = table(spark, d, "part"), F.split("p_name", " ")
    typed = part.select(F.concat_ws(".", "p_type", "p_brand", words[0], words[1]).alias("id"), words[1].alias("title"), F.when(F.col("p_size") % 2 == 0, "Class").otherwise("Interface").alias("label")).distinct()
    scope = part.select(F.col("p_brand").alias("source"), F.concat_ws(".", "p_type", "p_brand").alias("scope")).union(part.where("p_size > 25").select("p_brand", "p_type")).distinct()
    sites = part.select(F.col("p_brand").alias("source"), words[1].alias("target"), (F.col("p_size") % 3 == 0).alias("prefers_interface")).distinct()
    return nearest(sites, typed, scope).withColumn("score", F.col("score").cast("long"))


@query("""WITH sy AS (SELECT DISTINCT concat_ws('.', 'pkg', p_brand, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS id, split_part(p_name, ' ', 2) AS title, 'Constant' AS label FROM part
  UNION ALL SELECT 'lib.Supp' || s_suppkey, 'Supp' || s_suppkey, 'Function' FROM supplier
  UNION ALL SELECT 'lib.Kind.Supp' || s_suppkey, 'Supp' || s_suppkey, 'Function' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT DISTINCT 'lib.Kind', 'Kind', 'Class' FROM supplier),
k AS (SELECT p_type AS src, concat_ws('.', CASE WHEN p_partkey % 3 = 0 THEN 'pkg' END, CASE WHEN p_partkey % 3 < 2 THEN p_brand END, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS token, p_size > 10 AS strong FROM part
  UNION ALL SELECT 'n' || s_nationkey, 'x.Supp' || s_suppkey, true FROM supplier UNION ALL SELECT 'n' || s_nationkey, 'Supp' || s_suppkey, s_suppkey % 5 > 0 FROM supplier),
g AS (SELECT token, bool_or(strong) AS strong, regexp_extract(token, '[^.]*$') AS last, contains(token, '.') AS several FROM k GROUP BY token),
f AS (SELECT g.token, sy.id, ends_with(sy.id, '.' || g.token) AS suf, NOT starts_with(sy.id, 'lib.Kind.') AS free FROM g JOIN sy ON sy.title = g.last WHERE g.strong),
a AS (SELECT token, count(*) AS n, min(id) AS one, count(*) FILTER (suf) AS ns, min(id) FILTER (suf) AS sid, count(*) FILTER (free) AS nf, min(id) FILTER (free) AS fid FROM f GROUP BY token),
r AS (SELECT g.token, CASE WHEN x.id IS NOT NULL THEN 1 WHEN several AND ns = 1 THEN 2 WHEN several AND n = 1 THEN 3 WHEN nf = 1 THEN 4 END AS how, CASE how WHEN 1 THEN x.id WHEN 2 THEN sid WHEN 3 THEN one WHEN 4 THEN fid END AS dst
  FROM g LEFT JOIN sy x ON x.id = g.token LEFT JOIN a ON a.token = g.token)
SELECT k.src, r.dst, sy.label AS dst_label, CASE min(how) WHEN 1 THEN 'exact' WHEN 2 THEN 'suffix' WHEN 3 THEN 'name' ELSE 'module_level' END AS strategy
FROM k JOIN r ON r.token = k.token JOIN sy ON sy.id = r.dst WHERE how IS NOT NULL GROUP BY ALL""")
def mention_strategies(spark, d):
    """The resolution behind MENTIONS: names of parts and suppliers, given in full, in part or bare, by four strategies."""
    part, supplier, words = table(spark, d, "part"), table(spark, d, "supplier"), F.split("p_name", " ")
    supp = F.concat(F.lit("Supp"), F.col("s_suppkey"))
    kind = lambda rows, prefix: rows.select(F.concat(F.lit(prefix), supp).alias("id"), supp.alias("title"), F.lit("Function").alias("label"))
    goods = part.select(F.concat_ws(".", F.lit("pkg"), "p_brand", words[0], words[1]).alias("id"), words[1].alias("title"), F.lit("Constant").alias("label")).distinct()
    owner = supplier.select(F.lit("lib.Kind").alias("id"), F.lit("Kind").alias("title"), F.lit("Class").alias("label")).distinct()
    symbols = goods.unionByName(kind(supplier, "lib.")).unionByName(kind(supplier.where("s_suppkey % 2 = 0"), "lib.Kind.")).unionByName(owner)
    third = F.col("p_partkey") % 3
    named = part.select(F.col("p_type").alias("id"), F.concat_ws(".", F.when(third == 0, "pkg"), F.when(third < 2, F.col("p_brand")), words[0], words[1]).alias("token"), (F.col("p_size") > 10).alias("strong"))
    nation = F.concat(F.lit("n"), F.col("s_nationkey")).alias("id")
    said = supplier.select(nation, F.concat(F.lit("x."), supp).alias("token"), F.lit(True).alias("strong")).union(supplier.select(nation, supp, F.col("s_suppkey") % 5 > 0))
    found = named.union(said).groupBy("id", "token").agg(F.max("strong").alias("strong"))
    return resolve_mentions(found, symbols)


# Pages and documents


@query("SELECT page_id, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pages WHERE regexp_matches(html, '(?i)<h1')")
def html_headings(spark, d):
    return table(spark, d, "pages").where(F.col("html").rlike("(?i)<h1")).select("page_id", F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading"))


@query("SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY ALL")
def html_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def doc_contains(spark, d):
    """Documents that contain a benchmark text: an equi-join on its first 32 characters after white space gives candidates, whose texts are fetched
    once and compared whole. Items without such characters (short ones) are joined on the key of their first character with the documents' characters."""
    docs = table(spark, d, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    size = 32
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item")).where("item <> ''").withColumn("first", F.regexp_extract("item", rf"(?s)(?:\s)(\S.{{{size - 1}}})", 1))
    items = items.withColumn("key", F.xxhash64(F.when(F.col("first") == "", F.left("item", F.lit(1))).otherwise(F.col("first"))))
    starts = F.transform(F.regexp_extract_all("text", F.lit(rf"(?s)\s(?=(\S.{{{size - 1}}}))"), F.lit(1)), lambda x: F.xxhash64(x))
    characters = F.transform(F.array_distinct(F.split("text", "")), lambda x: F.xxhash64(x))
    short = items.where("first = ''").limit(1).count()  # only where there are such items
    keys = F.array_distinct(F.concat(starts, characters) if short else starts)
    found = docs.select("row", F.explode(keys).alias("key")).join(items.select("key", "item_id", "item"), "key").select("row", "item_id", "item")
    every = table(spark, d, "benchmark").where("text = ''").select("item_id", F.lit("").alias("item"))
    found = found.join(docs, "row").where(F.col("text").contains(F.col("item"))).select("row", "doc_id", "item_id").distinct().select("doc_id", "item_id")
    return found if every.isEmpty() else found.unionByName(docs.where("text IS NOT NULL").select("doc_id").crossJoin(every.select("item_id")))


@query("WITH l AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) % 2 AS inside FROM conversations) SELECT conv_id, turn, role, CAST(inside AS INT) AS inside FROM l")
def doc_running_fence(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (F.sum((F.col("role") == "user").cast("int")).over(w) % 2).cast("int").alias("inside"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents) SELECT doc_id, CAST(line_number AS INT) AS line_number, upper(regexp_extract(line, '(?i)(license|copyright|token)', 1)) AS kind, substr(line, 1, 200) AS body FROM l WHERE regexp_matches(line, '(?i)(license|copyright|token)')")
def line_annotations(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").rlike("(?i)license|copyright|token"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike("(?i)(license|copyright|token)"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_number"), F.upper(F.regexp_extract("line", "(?i)(license|copyright|token)", 1)).alias("kind"), F.substring("line", 1, 200).alias("body"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS INT) AS loc FROM documents")
def loc_count(spark, d):
    loc = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.when((F.col("text") != "") & ~F.col("text").endswith("\n"), 1).otherwise(0)
    return table(spark, d, "documents").select("doc_id", loc.alias("loc"))


@query("SELECT doc_id, length(text) >= 1024 AND NOT contains(text, chr(10)) OR list_avg(list_transform(string_split(text, chr(10))[1:50], lambda x: length(x))) > 500 AND len(string_split(text, chr(10))) >= 5 AS generated FROM documents")
def generated_filter(spark, d):
    lines = F.slice(F.split("text", "\n", -1), 1, 50)
    width = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.size(lines)
    return table(spark, d, "documents").select("doc_id", ((F.length("text") >= 1024) & ~F.col("text").contains("\n") | (width > 500) & (F.size(F.split("text", "\n", -1)) >= 5)).alias("generated"))


# Revisions


_YEARS = ("1996", "1997", "1998")


def _revisions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("string").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return [(y, o.where(F.col("y") == y).groupBy("id").agg(F.count("*").alias("n"), F.sum("price").cast("string").alias("total"))) for y in _YEARS]


_REVS = "o AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS VARCHAR) AS y, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL)"


@query(f"WITH {_REVS} SELECT id, arg_max(n, y) AS n, arg_max(total, y) AS total, string_agg(y, ',' ORDER BY y) AS revs FROM o GROUP BY id")
def rev_membership(spark, d):
    return V.merge_nodes(_revisions(spark, d), ["id"], ["n", "total"]).select("id", "n", "total", F.array_join("revs", ",").alias("revs"))


@query(f"WITH {_REVS} SELECT a.id, a.n <> b.n OR a.total <> b.total AS changed FROM o a JOIN o b ON a.id = b.id AND a.y = '1996' AND b.y = '1997'")
def rev_fingerprint_change(spark, d):
    m = V.merge_nodes(_revisions(spark, d)[:2], ["id"], ["n", "total"]).where(F.size("revs") == 2)
    return m.select("id", (F.col("rev_fp")[0] != F.col("rev_fp")[1]).alias("changed"))


@query(f"WITH {_REVS}, a AS (SELECT * FROM o WHERE y = '1996'), b AS (SELECT * FROM o WHERE y = '1998') SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS bucket FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.n <> b.n OR a.total <> b.total")
def rev_diff_buckets(spark, d):
    g = G.PropertyGraph({"Customer": V.merge_nodes(_revisions(spark, d), ["id"], ["n", "total"])})
    return cypher.run(g, "CALL rev_diff({from: '1996', to: '1998', node_type: 'Customer'}) YIELD id, bucket")


@query("""WITH a AS (SELECT p_partkey AS id, p_name AS name, p_brand AS place, p_size AS size FROM part WHERE p_partkey % 10 <> 3), b AS (SELECT CASE WHEN p_partkey % 10 = 4 THEN p_partkey + 1000000 ELSE p_partkey END AS id, p_name AS name, CASE WHEN p_partkey % 10 = 4 THEN 'moved' ELSE p_brand END AS place, CASE WHEN p_partkey % 10 = 5 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 10 <> 2),
g AS (SELECT * FROM a WHERE id NOT IN (SELECT id FROM b)), c AS (SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)), m AS (SELECT g.id AS gid, c.id AS cid, g.place AS op, c.place AS np FROM (SELECT name, min(id) AS id, min(place) AS place FROM g GROUP BY name HAVING count(*) = 1) g JOIN (SELECT name, min(id) AS id, min(place) AS place FROM c GROUP BY name HAVING count(*) = 1) c USING (name))
SELECT 'changed' AS bucket, a.id, a.place AS old_place, b.place AS new_place, 'size' AS fields_changed FROM a JOIN b USING (id) WHERE a.size <> b.size
UNION ALL SELECT 'moved', cid, op, np, '' FROM m UNION ALL SELECT 'removed', id, place, NULL, '' FROM g WHERE id NOT IN (SELECT gid FROM m) UNION ALL SELECT 'added', id, NULL, place, '' FROM c WHERE id NOT IN (SELECT cid FROM m)""")
def graph_diff_moved(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("place"), F.col("p_size").alias("size"))
    k = F.col("id") % 10
    new = p.where(k != 2).select(F.when(k == 4, F.col("id") + 1000000).otherwise(F.col("id")).alias("id"), "name", F.when(k == 4, "moved").otherwise(F.col("place")).alias("place"), F.when(k == 5, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return V.graph_diff(p.where(k != 3), new, ["id"], ["name"], "place", ["size"])


@query("WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_suppkey < 15) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' ELSE 'matched' END AS status FROM a FULL JOIN b ON a.k = b.k")
def match_entities(spark, d):
    return V.match_entities(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").where("s_suppkey < 15").select(F.col("s_nationkey").alias("k")), "k")


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), dst, src)) AS h FROM (SELECT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)))
SELECT count(*) AS rows, concat_ws('-', """ + ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 8 * i}, 8)) AS BIGINT)) AS VARCHAR)" for i in range(4)) + ") AS digest FROM h")
def result_digest(spark, d):
    return G.digest(trade_graph(spark, d).pairs("SUPPLIES"))


# Extensions that come with the platform


@query("WITH x AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_type AS a, nxt AS b, count(*) AS n FROM x WHERE nxt IS NOT NULL GROUP BY ALL")
def user_succession(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"))
    return x.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, CAST(k AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM y GROUP BY ALL")
def session_windows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    x = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(before.isNull() | (F.col("ts") - before > F.expr("INTERVAL 30 MINUTES")), 1).otherwise(0).alias("s"))
    return x.withColumn("session", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    return table(spark, d, "events").groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_totals(spark, d):
    return table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"}).rollup("status", "priority").agg(F.count("*").alias("n"))


@query()
def approx_users(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))
