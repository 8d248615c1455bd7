"""Graph queries over customers, orders, line items and parts as a property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.numeric import r9
from tidewell.operators import gates as gt
from tidewell.operators import graph as gr
from tidewell.operators import profiles as pf
from tidewell.operators import timelines as tl
from tidewell.plans.dataset import SES, idx
from tidewell.plans.registry import add, q9
from tidewell.schemas import TWIN_PROFILES

USERS = "(SELECT 'User:' || c_custkey AS root FROM customer)"
SYM = "sym AS (SELECT DISTINCT * FROM (SELECT src, dst FROM edge UNION ALL SELECT dst, src FROM edge))"


def levels(roots, hops, links="sym"):
    out = [f"d1 AS (SELECT DISTINCT root, dst AS node_id FROM {roots} r JOIN {links} s ON s.src = r.root WHERE dst <> root)"]
    for k in range(2, hops + 1):
        before = " UNION ALL ".join(f"SELECT root, node_id FROM d{j}" for j in range(1, k))
        out.append(f"d{k} AS (SELECT DISTINCT d.root, s.dst AS node_id FROM d{k - 1} d JOIN {links} s ON s.src = d.node_id WHERE s.dst <> d.root AND NOT EXISTS (SELECT 1 FROM ({before}) b WHERE b.root = d.root AND b.node_id = s.dst))")
    return ", ".join(out)


def union_levels(hops):
    return " UNION ALL ".join(f"SELECT root, node_id, {k} AS depth FROM d{k}" for k in range(1, hops + 1))


def graph_sql(ctes, body):
    """Body with the edge and node views and further CTEs in front."""
    from tidewell.bindings import SQL_VIEWS
    return f"WITH edge AS ({SQL_VIEWS['edge']}), node AS ({SQL_VIEWS['node']}), {SYM}, {ctes} {body}"


def users(t):
    return t.customer.select(F.concat(F.lit("User:"), F.col("c_custkey").cast("string")).alias("root"))


def plain_edges(t):
    """Links of users, sessions and predictions only."""
    return t.edge.filter("rel_type <> 'IDENTIFIED'")


add("GR1_user_neighbourhood", lambda t: gr.neighbourhood(t.edge, users(t), 2), graph_sql(levels(USERS, 2), union_levels(2)))
add("GR1_limited_neighbourhood", lambda t: gr.limited(gr.neighbourhood(t.edge, users(t), 2), 20),
    graph_sql(levels(USERS, 2), f"SELECT root, node_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node_id) AS r FROM ({union_levels(2)})) WHERE r <= 20"))
SESSIONS = "(SELECT 'Session:' || o_orderkey AS root FROM orders)"
add("GR2_session_neighbourhood", lambda t: gr.neighbourhood(t.edge, t.orders.select(F.concat(F.lit("Session:"), F.col("o_orderkey").cast("string")).alias("root")), 2),
    graph_sql(levels(SESSIONS, 2), union_levels(2)))
add("GR3_label_radius", lambda t: gr.labelled_within(t.edge, t.node, users(t), "Symptom", 3),
    graph_sql(levels(USERS, 3), f"SELECT root, node_id FROM ({union_levels(3)}) WHERE node_id LIKE 'Symptom:%'"))
SINCE = "(SELECT 'Session:' || o_orderkey AS root FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')"
add("GR4_temporal_radius", lambda t: gr.neighbourhood(t.edge, t.orders.filter("o_orderdate >= '1998-06-01'").select(F.concat(F.lit("Session:"), F.col("o_orderkey").cast("string")).alias("root")), 2),
    graph_sql(levels(SINCE, 2), union_levels(2)))
add("GR5_guarded_subgraph", lambda t: gr.guarded(gr.neighbourhood(t.edge, users(t), 2), 5000).groupBy("root").agg(F.count("*").alias("nodes")),
    graph_sql(levels(USERS, 2), f"SELECT root, count(*) AS nodes FROM ({union_levels(2)}) GROUP BY 1"))
CHAIN = "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"


def chain(t):
    return gr.chain_reach(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


add("GR6_temporal_chain", chain, f"SELECT *, n - pos AS reaches FROM ({CHAIN})")
add("GR6_chain_levels", lambda t: gr.ancestors(t.edge).withColumn("level", F.col("level").cast("long")),
    f"SELECT 'Session:' || o_orderkey AS node_id, pos - 1 AS level FROM ({CHAIN}) WHERE n > 1")
add("JN19_older_temporal_chain", lambda t: chain(t).select("o_custkey", "o_orderkey", "reaches").filter("reaches > 0"),
    f"SELECT a.o_custkey, a.o_orderkey, count(*) AS reaches FROM ({CHAIN}) a JOIN ({CHAIN}) b ON b.o_custkey = a.o_custkey AND b.pos > a.pos GROUP BY 1, 2")
add("JN19_older_subgraph_paths", lambda t: gr.trail_counts(t.edge),
    graph_sql("eid AS MATERIALIZED (SELECT src, dst, row_number() OVER () AS i FROM edge WHERE src <> dst), bw AS MATERIALIZED (SELECT src AS a, dst AS z, i FROM eid UNION ALL SELECT dst, src, i FROM eid)",
              "SELECT node_id, one, coalesce(two, 0) AS two FROM (SELECT a AS node_id, count(*) AS one FROM bw GROUP BY 1) LEFT JOIN (SELECT x.a AS k, count(*) AS two FROM bw x JOIN bw y ON y.a = x.z AND y.i <> x.i GROUP BY 1) ON k = node_id"))
add("GR7_chain_counts", lambda t: gr.chain_counts(chain(t), "o_custkey"), f"SELECT o_custkey, count(*) AS sessions, CAST(sum(n - pos) AS BIGINT) AS temporal_links FROM ({CHAIN}) GROUP BY 1")
add("GR8_node_edge_counts", lambda t: gr.incident_counts(t.edge, users(t), 2),
    graph_sql(levels(USERS, 2) + f", reach AS ({union_levels(2)}), eid AS MATERIALIZED (SELECT src, dst, row_number() OVER () AS i FROM edge)",
              "SELECT root, node_count, rel_count FROM (SELECT root, count(*) AS node_count FROM reach GROUP BY 1) JOIN (SELECT root AS r2, count(DISTINCT i) AS rel_count FROM (SELECT root, i FROM reach JOIN eid ON src = node_id UNION ALL SELECT root, i FROM reach JOIN eid ON dst = node_id) GROUP BY 1) ON r2 = root"))
add("GR8_three_hop_counts", lambda t: gr.incident_counts(t.edge, users(t), 3),
    graph_sql(levels(USERS, 3) + f", reach AS ({union_levels(3)}), eid AS MATERIALIZED (SELECT src, dst, row_number() OVER () AS i FROM edge)",
              "SELECT root, node_count, rel_count FROM (SELECT root, count(*) AS node_count FROM reach GROUP BY 1) JOIN (SELECT root AS r2, count(DISTINCT i) AS rel_count FROM (SELECT root, i FROM reach JOIN eid ON src = node_id UNION ALL SELECT root, i FROM reach JOIN eid ON dst = node_id) GROUP BY 1) ON r2 = root"))
add("GR9_central_nodes", lambda t: gr.central_nodes(t.edge, t.node, users(t)),
    graph_sql("eid AS MATERIALIZED (SELECT src, dst, row_number() OVER () AS i FROM edge), both_ways AS MATERIALIZED (SELECT src, dst, i FROM eid UNION ALL SELECT dst, src, i FROM eid WHERE src <> dst), "
              f"paths AS (SELECT root, dst AS node_id FROM {USERS} r JOIN both_ways a ON a.src = root UNION ALL SELECT root, b.dst FROM {USERS} r JOIN both_ways a ON a.src = root JOIN both_ways b ON b.src = a.dst AND b.i <> a.i)",
              "SELECT * FROM (SELECT root, node_id, degree, split_part(node_id, ':', 1) AS label, row_number() OVER (PARTITION BY root ORDER BY degree DESC, node_id) AS rank FROM (SELECT root, node_id, count(*) AS degree FROM paths WHERE node_id NOT LIKE 'User:%' GROUP BY 1, 2)) WHERE rank <= 10"))
DEG = "SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1"
add("GR10_degrees", lambda t: gr.degrees(t.edge), DEG, "edge")
# without the links to parts, a component is a user with the own sessions and predictions
COMP = ("SELECT DISTINCT node_id, min(node_id) OVER (PARTITION BY g) AS component FROM (SELECT 'User:' || c_custkey AS node_id, c_custkey AS g FROM customer UNION ALL SELECT 'Session:' || o_orderkey, o_custkey FROM orders "
        "UNION ALL SELECT 'Prediction:' || l_orderkey || '-' || l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) UNION ALL SELECT 'Symptom:' || p_partkey, 'Symptom:' || p_partkey FROM part UNION ALL SELECT 'Intervention:' || s_suppkey, 'Intervention:' || s_suppkey FROM supplier")
add("GR11_connected_components", lambda t: gr.connected_components(t.node, plain_edges(t)), COMP)
# labels spread over all links, only where one gets smaller, until none does
SPREAD = ("ids AS (SELECT node_id FROM node UNION SELECT src FROM edge UNION SELECT dst FROM edge), cc(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM ids UNION "
          "SELECT s.dst, min(c.component) FROM cc c JOIN sym s ON s.src = c.node_id JOIN recurring.cc r ON r.node_id = s.dst WHERE c.component < r.component GROUP BY 1)")
add("GR11_whole_graph_components", lambda t: gr.connected_components(t.node, t.edge).groupBy("component").agg(F.count("*").alias("nodes")),
    graph_sql(SPREAD, "SELECT component, count(*) AS nodes FROM cc GROUP BY 1").replace("WITH edge", "WITH RECURSIVE edge", 1))
add("GR11_whole_graph_members", lambda t: gr.connected_components(t.node, t.edge), graph_sql(SPREAD, "SELECT node_id, component FROM cc").replace("WITH edge", "WITH RECURSIVE edge", 1))
SUMM = (f"SELECT nc AS node_count, ec AS edge_count, {q9('md')} AS mean_degree, xd AS max_degree, {q9('tc / CAST(greatest(sc - 1, 1) AS DOUBLE)')} AS temporal_density, {q9('2e0 * ec / (CAST(nc AS DOUBLE) * (nc - 1))')} AS density{{more}} FROM "
        "(SELECT count(*) AS nc, count(CASE WHEN label = 'Session' THEN 1 END) AS sc FROM node), (SELECT count(*) AS ec, count(CASE WHEN rel_type = 'TEMPORALLY_PRECEDES' THEN 1 END) AS tc FROM {edge}), "
        "(SELECT avg(degree) AS md, max(degree) AS xd FROM (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM {edge} UNION ALL SELECT dst FROM {edge}) GROUP BY 1)){extra}")


def rounded(df):
    return df.select(*[r9(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


add("GR12_temporal_density", lambda t: rounded(gr.summary(t.node, t.edge)).select("temporal_density"), f"SELECT temporal_density FROM ({SUMM.format(more='', edge='edge', extra='')})", "node edge")
add("GR13_user_density", lambda t: gr.user_density(t.session), "SELECT user_id, count(*) AS sessions, min(timestamp) AS first_ts, max(timestamp) AS last_ts, CASE WHEN count(*) > 1 THEN CAST(count(*) AS DOUBLE) ELSE 0e0 END AS density FROM session GROUP BY 1", "session")
add("GR14_graph_summary", lambda t: rounded(gr.summary(t.node, plain_edges(t), gr.connected_components(t.node, plain_edges(t)))),
    SUMM.format(more=", k AS num_components", edge="(SELECT * FROM edge WHERE rel_type <> 'IDENTIFIED')", extra=f", (SELECT count(DISTINCT component) AS k FROM ({COMP}))"), "node edge")
add("GR14_whole_graph_summary", lambda t: rounded(gr.summary(t.node, t.edge, gr.connected_components(t.node, t.edge))),
    graph_sql(SPREAD, SUMM.format(more=", k AS num_components", edge="edge", extra=", (SELECT count(DISTINCT component) AS k FROM cc)")).replace("WITH edge", "WITH RECURSIVE edge", 1))
add("GR15_degree_report", lambda t: gr.top_degrees(gr.degrees(t.edge)), f"{DEG} ORDER BY degree DESC, node_id LIMIT 10", "edge")
add("GR16_node_importance", lambda t: gr.importance(gr.degrees(t.edge)).withColumn("importance", r9("importance")), f"SELECT node_id, degree, {q9('degree / CAST(count(*) OVER () AS DOUBLE)')} AS importance FROM ({DEG})", "edge")
BUILT = ("SELECT 'User:' || participant_id AS src, 'Session:' || session_id AS dst, 'HAS_SESSION' AS rel_type FROM {s} UNION ALL SELECT 'Session:' || session_id, 'Dataset:' || dataset, 'PART_OF_DATASET' FROM {s} "
         "UNION ALL SELECT 'Session:' || session_id, 'AudioFeature:' || session_id || '_audio', 'HAS_FEATURE' FROM {s} WHERE has_audio UNION ALL SELECT 'Session:' || session_id, 'VisualFeature:' || session_id || '_visual', 'HAS_FEATURE' FROM {s} WHERE has_visual "
         "UNION ALL SELECT 'Session:' || session_id, 'TextFeature:' || session_id || '_text', 'HAS_FEATURE' FROM {s} WHERE has_transcript UNION ALL SELECT 'Session:' || session_id, 'Prediction:pred_' || session_id, 'PREDICTED' FROM {s}").format(s=SES)
add("GR17_session_graph", lambda t: gr.build_edges(idx(t)), BUILT, "dataset_index")
add("GR17_session_graph_nodes", lambda t: gr.nodes_of(gr.build_edges(idx(t))), f"SELECT DISTINCT node_id, split_part(node_id, ':', 1) AS label FROM (SELECT src AS node_id FROM ({BUILT}) UNION ALL SELECT dst FROM ({BUILT}))", "dataset_index")
PREV = "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders"
add("GR18_temporal_edges", lambda t: gr.temporal_edges(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey"),
    f"SELECT 'Session:' || p AS src, 'Session:' || o_orderkey AS dst, k AS rel_type FROM ({PREV}), (VALUES ('TEMPORALLY_PRECEDES'), ('FOLLOWED_BY')) v(k) WHERE p IS NOT NULL")
add("GR18_remembered_chain", lambda t: gr.remembered_chain(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "rank"),
    "SELECT o_custkey, o_orderkey, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 12")


def clinical(t):
    return t.checkin.selectExpr("id AS session_id", "map(IF(k % 3 = 0, 'Joy', 'Boredom'), k / 100.0D, 'Sadness', value / 500) AS emotions", "map(IF(k % 5 = 0, 'Low Mood', 'Itching'), k / 100.0D) AS symptoms")


CLIN = ("SELECT 'Session:' || id AS src, 'Emotion:' || id || '_Joy' AS dst, 'EXPRESSES' AS rel_type, k / 1e2 AS confidence FROM checkin WHERE k % 3 = 0 UNION ALL SELECT 'Session:' || id, 'Emotion:' || id || '_Sadness', 'EXPRESSES', value / 5e2 FROM checkin "
        "UNION ALL SELECT 'Session:' || id, 'Symptom:' || id || '_Low Mood', 'INDICATES', k / 1e2 FROM checkin WHERE k % 5 = 0")
add("GR19_clinical_edges", lambda t: gr.clinical_edges(clinical(t)), CLIN, "checkin")
add("GR20_research_edges", lambda t: gr.research_edges(idx(t), "study1", "model1"),
    f"SELECT 'User:' || participant_id AS src, d AS dst, k AS rel_type FROM (SELECT DISTINCT participant_id FROM {SES}), (VALUES ('ResearchStudy:study1', 'BELONGS_TO'), ('ModelVersion:model1', 'USES_MODEL')) v(d, k)", "dataset_index")
add("GR21_random_walks", lambda t: gr.random_walks(t.edge, users(t)))
add("GR21_walk_co_occurrence", lambda t: gr.co_occurrence(gr.random_walks(t.edge, users(t))))


def walk_check(t):
    """Walks, rows and steps of each user's walks, and how many steps do not follow a link."""
    rows = gr.walk_steps(gr.random_walks(t.edge, users(t)), t.edge)
    return rows.groupBy("root").agg(F.count_distinct("walk").alias("walks"), F.count("*").alias("rows"), F.count_distinct("step").alias("steps"), F.count_if("broken").alias("broken"))


add("GR21_walk_check", walk_check,
    f"SELECT root, 20 AS walks, CASE WHEN n > 0 THEN 200 ELSE 20 END AS rows, CASE WHEN n > 0 THEN 10 ELSE 1 END AS steps, 0 AS broken FROM (SELECT root, count(src) AS n FROM {USERS} LEFT JOIN edge ON src = root OR dst = root GROUP BY 1)".replace("AS rows", 'AS "rows"')
    .replace("edge ON src = root OR dst = root", "(SELECT src FROM edge UNION ALL SELECT dst FROM edge) ON src = root"), "edge")


def projected_sql(dim, rounds):
    """The vectors of ``projected_vectors`` over the session graph, round by round."""
    p = gr.START_PRIME
    t = f"((s + (d * 12 + {{i}}) * step) % {p})"
    power = f"((({t} * {t} % {p}) * ({t} * {t} % {p}) % {p}) * {t} % {p} / {p}e0)"
    start = " + ".join(power.format(i=i) for i in range(12))
    part = f"CAST('0x' || substr(md5('0:' || node_id), {{0}}, 8) AS BIGINT) % {p}"
    ctes = [
        f"b AS MATERIALIZED ({BUILT})", "l AS MATERIALIZED (SELECT a, z, count(*) AS m FROM (SELECT src AS a, dst AS z FROM b UNION ALL SELECT dst, src FROM b) GROUP BY 1, 2)",
        f"n AS (SELECT node_id, {part.format(1)} AS s, {part.format(9)} AS step FROM (SELECT src AS node_id FROM b UNION SELECT dst FROM b))",
        f"v0 AS MATERIALIZED (SELECT node_id, d, {start} - 6 AS x FROM n, (SELECT unnest(range(0, {dim})) AS d))",
    ]
    for k in range(rounds):
        ctes += [f"y{k} AS (SELECT a, d AS yd, sum(x * m) * 5e-1 AS y FROM l JOIN v{k} ON node_id = z GROUP BY 1, 2)",
                 f"w{k} AS MATERIALIZED (SELECT node_id, d, x + coalesce(y, 0) AS x FROM v{k} LEFT JOIN y{k} ON a = node_id AND yd = d)",
                 f"v{k + 1} AS MATERIALIZED (SELECT node_id, d, x / l AS x FROM w{k} JOIN (SELECT node_id AS o, sqrt(sum(x * x)) + 1e-8 AS l FROM w{k} GROUP BY 1) ON o = node_id)"]
    return f"SELECT * FROM (WITH {', '.join(ctes)} SELECT node_id, CAST(d AS INTEGER) AS d, {q9('x')} AS x FROM v{rounds})"


def session_graph(t):
    return gr.build_edges(idx(t))


add("GR22_projected_vectors", lambda t: gr.projected_vectors(gr.nodes_of(session_graph(t)), session_graph(t)).withColumn("x", r9("x")), projected_sql(64, 3), "dataset_index")


def part_features(t):
    """One feature per node: a price of parts and sessions, a quantity of predictions, a balance of users."""
    line = t.lineitem.selectExpr("concat('Prediction:', l_orderkey, '-', l_linenumber) AS node_id", "l_quantity AS x").groupBy("node_id").agg(F.max("x").alias("x"))
    part = t.part.selectExpr("concat('Symptom:', p_partkey) AS node_id", "p_retailprice AS x")
    session = t.orders.selectExpr("concat('Session:', o_orderkey) AS node_id", "o_totalprice AS x")
    user = t.customer.selectExpr("concat('User:', c_custkey) AS node_id", "c_acctbal AS x")
    return line.unionByName(part).unionByName(session).unionByName(user).select("node_id", F.lit(0).cast("long").alias("d"), "x")


PF = ("SELECT 'Prediction:' || l_orderkey || '-' || l_linenumber AS node_id, max(l_quantity) AS x FROM lineitem GROUP BY 1 UNION ALL SELECT 'Symptom:' || p_partkey, p_retailprice FROM part "
      "UNION ALL SELECT 'Session:' || o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'User:' || c_custkey, c_acctbal FROM customer")
add("GR23_neighbour_mean", lambda t: gr.neighbour_mean(t.edge, part_features(t)).withColumn("x", r9("x")),
    f"SELECT node_id, 0 AS d, {q9('avg(x)')} AS x FROM (SELECT node_id, x FROM ({PF}) UNION ALL SELECT a, x FROM (SELECT DISTINCT src AS a, dst AS b FROM edge UNION SELECT DISTINCT dst, src FROM edge) JOIN ({PF}) ON node_id = b WHERE a <> b) GROUP BY 1", "edge")


def embedding_rows(t):
    return t.embeddings.select(F.col("label").alias("g"), F.posexplode("embedding").alias("d", "x")).select("g", F.col("d").cast("long").alias("d"), F.col("x").cast("double").alias("x"))


add("GR24_graph_vector", lambda t: gr.graph_vector(embedding_rows(t), "g", 70).withColumn("x", r9("x")),
    f"SELECT label AS g, p AS d, {q9('coalesce(avg(CASE WHEN p < 64 THEN e[p + 1] END), 0e0)')} AS x FROM (SELECT label, embedding::DOUBLE[] AS e, unnest(range(0, 70)) AS p FROM embeddings) GROUP BY 1, 2")
add("GR25_two_levels", lambda t: gr.two_levels(t.edge, users(t)),
    f"SELECT root, level1, level2, level1 + level2 AS node_count FROM (SELECT root, count(DISTINCT a.dst) AS level1, count(DISTINCT b.dst) AS level2 FROM {USERS} r LEFT JOIN edge a ON a.src = root LEFT JOIN edge b ON b.src = a.dst GROUP BY 1)", "edge")
add("GR26_session_distance", lambda t: tl.consecutive_sessions(t.session).select("user_id", "pair", "from_session", "to_session", "gap_days"),
    "SELECT user_id, rn - 1 AS pair, from_session, session_id AS to_session, CAST(floor((epoch_us(timestamp) - epoch_us(f)) / 86400e6) AS BIGINT) AS gap_days FROM (SELECT user_id, session_id, timestamp, row_number() OVER w AS rn, lag(session_id) OVER w AS from_session, "
    "lag(timestamp) OVER w AS f FROM session WINDOW w AS (PARTITION BY user_id ORDER BY timestamp, session_id)) WHERE from_session IS NOT NULL", "session")


def versions(t):
    old = t.customer.selectExpr("concat('User:', c_custkey) AS node_id", "'User' AS label", "c_mktsegment AS props", "1 AS arrival")
    new = t.orders.selectExpr("concat('User:', o_custkey) AS node_id", "'User' AS label", "o_orderstatus AS props", "o_orderkey + 2 AS arrival")
    return old.select("node_id", "label", "props", F.col("arrival").cast("long").alias("arrival")), new


add("GR27_upserted_nodes", lambda t: gr.upserted_nodes(*versions(t)),
    "SELECT node_id, 'User' AS label, arg_max(props, arrival) AS props, max(arrival) AS arrival FROM (SELECT 'User:' || c_custkey AS node_id, c_mktsegment AS props, 1 AS arrival FROM customer UNION ALL SELECT 'User:' || o_custkey, o_orderstatus, o_orderkey + 2 FROM orders) GROUP BY 1")
add("GR27_edges_from", lambda t: gr.edges_from(t.edge, "User:7").unionByName(gr.edges_to(t.edge, "Symptom:5")), "SELECT * FROM edge WHERE src = 'User:7' OR dst = 'Symptom:5'", "edge")
add("GR27_nodes_by_label", lambda t: gr.nodes_by_label(t.node, "Symptom"), "SELECT * FROM node WHERE label = 'Symptom'", "node")


def snapshots(table):
    """Two snapshots of a table in one store; the later one has lost some rows."""
    return gr.snapshot(table, "first").unionByName(gr.snapshot(table.filter(F.pmod(F.xxhash64(*table.columns), F.lit(3)) > 0), "second"))


add("GR27_restored_nodes", lambda t: gr.restore(snapshots(t.node), "first"), "SELECT * FROM node", "node")
add("GR27_restored_edges", lambda t: gr.restore(snapshots(t.edge), "first"), "SELECT * FROM edge", "edge")
ADJ = "SELECT DISTINCT g, src, dst FROM (SELECT g, src, dst FROM (SELECT o_custkey % 25 AS g, 'User:' || o_custkey AS src, 'Session:' || o_orderkey AS dst FROM orders) UNION ALL SELECT o_custkey % 25, 'Session:' || o_orderkey, 'User:' || o_custkey FROM orders)"
add("GR28_batched_adjacency", lambda t: gr.batched_adjacency(t.orders.selectExpr("o_custkey % 25 AS g", "concat('User:', o_custkey) AS src", "concat('Session:', o_orderkey) AS dst"), "g"),
    f"SELECT a.g, src, dst, nodes, (SELECT max(n) FROM (SELECT g, count(DISTINCT src) AS n FROM ({ADJ}) GROUP BY 1)) AS padded_to FROM ({ADJ}) a JOIN (SELECT g, count(DISTINCT src) AS nodes FROM ({ADJ}) GROUP BY 1) b ON a.g = b.g")
add("GR29_graph_with_issues", lambda t: gt.graph_issues(gr.nodes_of(gr.build_graph("temporal", idx(t))), gr.build_graph("temporal", idx(t))).groupBy("check").agg(F.count("*").alias("n")).unionByName(
        gr.build_graph("temporal", idx(t)).groupBy(F.col("rel_type").alias("check")).agg(F.count("*").alias("n"))),
    f"SELECT rel_type AS \"check\", count(*) AS n FROM ({BUILT}) GROUP BY 1 UNION ALL SELECT 'temporal', 1 WHERE (SELECT max(k) FROM (SELECT count(*) AS k FROM {SES} GROUP BY participant_id)) = 1", "dataset_index")
add("UDF5_builder_by_name", lambda t: gr.build_graph("research", idx(t), study="s", model="m").groupBy("rel_type").agg(F.count("*").alias("n")),
    f"SELECT rel_type, count(*) AS n FROM (SELECT rel_type FROM ({BUILT}) UNION ALL SELECT k FROM (SELECT DISTINCT participant_id FROM {SES}), (VALUES ('BELONGS_TO'), ('USES_MODEL')) v(k)) GROUP BY 1", "dataset_index")
add("JN14_dangling_edges", lambda t: gr.dangling(t.edge, t.node.filter("label <> 'Session'")),
    "SELECT * FROM edge WHERE src LIKE 'Session:%' OR dst LIKE 'Session:%'", "edge")


def order_pairs(t):
    return t.order_links.selectExpr("concat('Session:', prev_key) AS a", "concat('Session:', o_orderkey) AS b")


add("JN15_unlinked_pairs", lambda t: gr.unlinked_pairs(order_pairs(t), t.edge.filter("substring(dst, -1) <> '7'")),
    f"SELECT 'Session:' || p AS a, 'Session:' || o_orderkey AS b FROM ({PREV}) WHERE p IS NOT NULL AND o_orderkey % 10 = 7")
add("SNK7_graphml_lines", lambda t: gr.graphml_lines(t.node, t.edge),
    """SELECT 1 AS part, '<node id="' || node_id || '"><data key="label">' || label || '</data></node>' AS line FROM node UNION ALL SELECT 2, '<edge source="' || src || '" target="' || dst || '"><data key="type">' || rel_type || '</data></edge>' FROM edge""", "node edge")
add("SNK9_edge_index_sizes", lambda t: gr.edge_index(t.node, t.edge).groupBy("rel_type").agg(F.count("*").alias("edges"), F.count_distinct("src_idx").alias("sources"), F.count_distinct("dst_idx").alias("targets")),
    "SELECT rel_type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edge GROUP BY 1", "edge")
add("SNK9_dense_numbers", lambda t: gr.numbered_nodes(t.node).agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.count_distinct("idx").alias("n")),
    "SELECT 0 AS low, count(DISTINCT node_id) - 1 AS high, count(DISTINCT node_id) AS n FROM node", "node")
add("SNK16_text_rows", lambda t: t.session.select(F.concat_ws(",", F.col("session_id").cast("string"), F.col("user_id").cast("string"), "language").alias("line")),
    "SELECT concat_ws(',', session_id, user_id, language) AS line FROM session", "session")


def twin_facts(t):
    return t.session.groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_distinct("language").alias("languages"))


FACTS = "SELECT user_id, count(*) AS sessions, count(DISTINCT language) AS languages FROM session GROUP BY 1"
NODES = ",".join(f'{{"id":"{k}","label":"{v}"}}' for k, v in TWIN_PROFILES.items())
LINKS = " || ',' || ".join(f"""'{{"source":"' || user_id || '","target":"{k}","type":"HAS_PROFILE"}}'""" for k in TWIN_PROFILES)
add("SNK8_node_link_export", lambda t: pf.node_link(twin_facts(t)),
    f"""SELECT user_id, '{{"directed":true,"multigraph":false,"graph":{{}},"nodes":[{{"id":"' || user_id || '","label":"User"}},{NODES}],"links":[' || {LINKS} || ']}}' AS node_link FROM ({FACTS})""", "session")
add("SNK8_seed_statements", lambda t: pf.seed_statements(twin_facts(t)),
    """SELECT user_id, '// Digital Twin export for ' || user_id || chr(10) || 'MERGE (t:DigitalTwin {user_id: ''' || user_id || '''}) SET t += {"user_id":' || user_id || ',"sessions":' || sessions """
    f"""|| ',"languages":' || languages || '}};' || chr(10) AS statement FROM ({FACTS})""", "session")
add("SNK8_key_value_export", lambda t: t.session.groupBy("user_id").agg(F.count("*").alias("sessions"), F.count_distinct("language").alias("languages")).select(
        "user_id", F.explode(F.create_map(F.lit("sessions"), F.col("sessions"), F.lit("languages"), F.col("languages"))).alias("key", "value")),
    "SELECT user_id, 'sessions' AS key, count(*) AS value FROM session GROUP BY 1 UNION ALL SELECT user_id, 'languages', count(DISTINCT language) FROM session GROUP BY 1", "session")
