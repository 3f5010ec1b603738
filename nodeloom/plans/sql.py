"""SQL of the registered queries, for an engine that holds the driver's tables as views."""

from __future__ import annotations

import re

DEPTH = 9  # levels that are written out; the derived graphs have seven at most
#: Rounds that are written out of the eigenvector (it converges before) and of core numbers (their fixpoint comes before);
#: levels of a network without its removed nodes.
POWER_ROUNDS, CORE_ROUNDS, THIN_DEPTH = 60, 40, 32
PIVOTS, SOURCES, EFFICIENCY_SOURCES, SEED, EIGEN_ROUNDS, STEPS, TOP, ADDED = 100, 32, 30, 42, 20, 150, 50, 100
STRATEGIES = ("Degree", "Betweenness", "Closeness", "MO-Based", "Random")

ROLE = "CASE WHEN p_size <= 4 THEN 'Coordinator' WHEN p_size <= 11 THEN 'Broker' WHEN p_size <= 21 THEN 'Enabler' ELSE 'Peripheral' END"

BASE = f"""
persons AS MATERIALIZED (SELECT p_partkey AS person_id, p_name AS name, {ROLE} AS role, p_type AS community, (25 + p_partkey % 40)::INT AS age FROM part),
returned AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
weights AS (SELECT a.l_partkey AS from_id, b.l_partkey AS to_id, count(*) AS weight FROM returned a JOIN returned b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2),
relations AS MATERIALIZED (SELECT from_id, to_id, weight,
    CASE WHEN 'Coordinator' IN (p.role, q.role) THEN 'hierarchical' WHEN 'Broker' IN (p.role, q.role) THEN 'coordination' ELSE 'operational' END AS relation_type
    FROM weights JOIN persons p ON p.person_id = from_id JOIN persons q ON q.person_id = to_id),
adj AS MATERIALIZED (SELECT from_id AS s, to_id AS t FROM relations UNION ALL SELECT to_id, from_id FROM relations),
deg AS MATERIALIZED (SELECT person_id, count(t) AS degree FROM persons LEFT JOIN adj ON s = person_id GROUP BY 1)
"""

INCIDENTS = f"""
who AS (SELECT l_orderkey, min(l_partkey) AS person_id, string_agg(l_partkey::VARCHAR, ';' ORDER BY l_partkey) AS persons_involved FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1),
incidents AS MATERIALIZED (SELECT o_orderkey AS incident_id, person_id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS crime_type, {ROLE} AS modus_operandi,
    CASE WHEN o_totalprice > 400000 THEN 'Severe' WHEN o_orderstatus = 'P' THEN 'High' WHEN o_orderstatus = 'O' THEN 'Medium' ELSE 'Low' END AS severity,
    'City_' || (o_custkey % 10 + 1)::VARCHAR AS location, persons_involved
    FROM orders JOIN who ON o_orderkey = l_orderkey JOIN part ON p_partkey = person_id),
seen AS (SELECT crime_type, modus_operandi, CASE severity WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 4 END AS s, unnest(string_split(persons_involved, ';'))::BIGINT AS person_id FROM incidents),
behaviour AS MATERIALIZED (SELECT p.person_id, count(s) AS incident_count, count(DISTINCT crime_type) AS crime_diversity, coalesce(avg(s), 0)::DOUBLE AS avg_severity,
    count(*) FILTER (modus_operandi = 'Coordinator') AS coordinator_interactions, count(*) FILTER (modus_operandi = 'Broker') AS broker_interactions,
    count(*) FILTER (modus_operandi = 'Enabler') AS enabler_interactions, count(*) FILTER (modus_operandi = 'Peripheral') AS peripheral_interactions
    FROM persons p LEFT JOIN seen ON seen.person_id = p.person_id GROUP BY 1)
"""

TRIANGLES = """
tri AS MATERIALIZED (SELECT a.from_id AS x, a.to_id AS y, b.to_id AS z FROM relations a JOIN relations b ON a.to_id = b.from_id JOIN relations c ON c.from_id = a.from_id AND c.to_id = b.to_id),
tricount AS (SELECT person_id, count(*) AS triangles FROM (SELECT unnest([x, y, z]) AS person_id FROM tri) GROUP BY 1),
ego AS MATERIALIZED (SELECT d.person_id, degree, coalesce(triangles, 0) AS triangles,
    CASE WHEN degree > 1 THEN 2.0::DOUBLE * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering_coef, degree + 1 AS ego_nodes,
    CASE WHEN degree > 0 THEN 2.0::DOUBLE * (degree + coalesce(triangles, 0)) / ((degree + 1) * degree) ELSE 0 END AS ego_density FROM deg d LEFT JOIN tricount USING (person_id))
"""

COMMUNITY = """
own AS (SELECT p.person_id, p.community, count(q.person_id) AS k, count(*) FILTER (q.community = p.community) AS same
        FROM persons p LEFT JOIN adj ON adj.s = p.person_id LEFT JOIN persons q ON q.person_id = adj.t GROUP BY 1, 2),
squares AS (SELECT person_id, sum(n * n) AS sq FROM (SELECT adj.s AS person_id, q.community, count(*) AS n FROM adj JOIN persons q ON q.person_id = adj.t GROUP BY 1, 2) GROUP BY 1),
stats AS (SELECT community, avg(k) AS mean, stddev_pop(k) AS spread, count(*) AS members FROM own GROUP BY 1),
community_features AS MATERIALIZED (SELECT person_id, same AS same_community_degree, k - same AS cross_community_edges,
    CASE WHEN k > 0 THEN 1 - (same / k) * (same / k) ELSE 0 END::DOUBLE AS participation_coef,
    CASE WHEN k > 0 THEN 1 - sq::DOUBLE / (k * k) ELSE 0 END::DOUBLE AS participation_coef_full,
    CASE WHEN k > 0 AND members > 1 THEN (same - mean) / CASE WHEN spread = 0 THEN 1 ELSE spread END ELSE 0 END::DOUBLE AS within_module_z
    FROM own JOIN stats USING (community) LEFT JOIN squares USING (person_id))
"""

def pivot(k: int) -> str:
    return f"piv AS MATERIALIZED (SELECT person_id FROM persons ORDER BY md5(concat_ws(':', '{SEED}', person_id::VARCHAR)), person_id LIMIT {k})"


PIVOT = pivot(PIVOTS)


def levels(sources: str) -> str:
    """Path counts and predecessors by level, from ``sources``."""
    out = [f"l0 AS MATERIALIZED (SELECT person_id AS s, person_id AS v, 1.0::DOUBLE AS sigma, 0 AS preds FROM {sources})"]
    for k in range(1, DEPTH + 1):
        back = f" AND NOT EXISTS (SELECT 1 FROM l{k - 2} q WHERE q.s = p.s AND q.v = a.t)" if k > 1 else ""
        out.append(f"l{k} AS MATERIALIZED (SELECT p.s, a.t AS v, sum(p.sigma) AS sigma, count(*) AS preds FROM l{k - 1} p JOIN adj a ON a.s = p.v WHERE NOT EXISTS (SELECT 1 FROM l{k - 1} q WHERE q.s = p.s AND q.v = a.t){back} GROUP BY 1, 2)")
    out.append("far AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT s, v, {k} AS d FROM l{k}" for k in range(DEPTH + 1)) + ")")
    return ",\n".join(out)


def flow(sources: int | None = PIVOTS) -> str:
    out = [f"f{DEPTH} AS (SELECT *, 0.0::DOUBLE AS delta, 0.0::DOUBLE AS packets FROM l{DEPTH})"]
    for k in range(DEPTH - 1, 0, -1):
        out.append(f"f{k} AS MATERIALIZED (SELECT l.s, l.v, l.sigma, l.preds, coalesce(sum(l.sigma / w.sigma * (1 + w.delta)), 0) AS delta, coalesce(sum((1 + w.packets) / w.preds), 0) AS packets FROM l{k} l LEFT JOIN (SELECT w.*, a.t FROM f{k + 1} w JOIN adj a ON a.s = w.v) w ON w.s = l.s AND w.t = l.v GROUP BY 1, 2, 3, 4)")
    every = " UNION ALL ".join(f"SELECT v, delta, packets FROM f{k}" for k in range(1, DEPTH + 1))
    out.append(f"""between_ AS MATERIALIZED (SELECT p.person_id, coalesce(sum(delta), 0) * c.scale AS betweenness, coalesce(sum(packets), 0) * c.scale AS load_centrality
    FROM persons p LEFT JOIN ({every}) x ON x.v = p.person_id
    CROSS JOIN (SELECT CASE WHEN count(*) > 2 THEN 1.0::DOUBLE / ((count(*) - 1.0::DOUBLE) * (count(*) - 2)) * (count(*)::DOUBLE / {f'least(count(*), {sources})' if sources else 'count(*)'}) ELSE 0 END AS scale FROM persons) c GROUP BY 1, c.scale)""")
    return ",\n".join(out)


def eigen(rounds: int = EIGEN_ROUNDS) -> str:
    out = ["e0 AS MATERIALIZED (SELECT person_id, 1.0::DOUBLE / (SELECT count(*) FROM persons) AS x FROM persons)"]
    for k in range(1, rounds + 1):
        out.append(f"y{k} AS MATERIALIZED (SELECT e.person_id, e.x + coalesce(sum(o.x), 0) AS y FROM e{k - 1} e LEFT JOIN adj ON adj.s = e.person_id LEFT JOIN e{k - 1} o ON o.person_id = adj.t GROUP BY 1, e.x)")
        out.append(f"e{k} AS MATERIALIZED (SELECT person_id, y / (SELECT sqrt(sum(y * y)) FROM y{k}) AS x FROM y{k})")
    out.append(f"eigen AS (SELECT person_id, x AS eigenvector FROM e{rounds})")
    return ",\n".join(out)


def power(rounds: int = POWER_ROUNDS) -> str:
    """The eigenvector after the first round whose change is under n * 1e-6."""
    out = ["v0 AS MATERIALIZED (SELECT person_id, 1.0::DOUBLE / (SELECT count(*) FROM persons) AS x FROM persons)"]
    for k in range(1, rounds + 1):
        out.append(f"w{k} AS MATERIALIZED (SELECT e.person_id, e.x AS before, e.x + coalesce(sum(o.x), 0) AS y FROM v{k - 1} e LEFT JOIN adj ON adj.s = e.person_id LEFT JOIN v{k - 1} o ON o.person_id = adj.t GROUP BY 1, 2)")
        out.append(f"v{k} AS MATERIALIZED (SELECT person_id, before, y / (SELECT sqrt(sum(y * y)) FROM w{k}) AS x FROM w{k})")
    every = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(x - before)) AS c FROM v{k}" for k in range(1, rounds + 1))
    out.append(f"moved AS MATERIALIZED (SELECT min(k) AS k FROM ({every}) WHERE c < (SELECT count(*) FROM persons) * 1e-6::DOUBLE)")
    out.append("eigen AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT person_id, x AS eigenvector FROM v{k} WHERE {k} = (SELECT k FROM moved)" for k in range(1, rounds + 1)) + ")")
    return ",\n".join(out)


def cores(rounds: int = CORE_ROUNDS) -> str:
    """h-indices of the neighbours' values, from the degrees on."""
    out = ["c0 AS MATERIALIZED (SELECT person_id, degree AS c FROM deg)"]
    for k in range(1, rounds + 1):
        out.append(f"c{k} AS MATERIALIZED (SELECT p.person_id, coalesce(max(least(x.c, x.r)), 0) AS c FROM c{k - 1} p LEFT JOIN (SELECT adj.s, o.c, row_number() OVER (PARTITION BY adj.s ORDER BY o.c DESC) AS r FROM adj JOIN c{k - 1} o ON o.person_id = adj.t) x ON x.s = p.person_id GROUP BY 1)")
    out.append(f"core AS MATERIALIZED (SELECT person_id, c AS core_number FROM c{rounds})")
    return ",\n".join(out)


def cut_edges(depth: int = DEPTH) -> str:
    """Bridges by labels of the cycle space: a tree edge that no other edge's label covers. Needs ``cc``."""
    out = ["t0 AS MATERIALIZED (SELECT person_id AS node, NULL::BIGINT AS parent FROM cc WHERE person_id = component)"]
    for k in range(1, depth + 1):
        back = f" AND NOT EXISTS (SELECT 1 FROM t{k - 2} q WHERE q.node = adj.t)" if k > 1 else ""
        out.append(f"t{k} AS MATERIALIZED (SELECT adj.t AS node, min(p.node) AS parent FROM t{k - 1} p JOIN adj ON adj.s = p.node WHERE NOT EXISTS (SELECT 1 FROM t{k - 1} q WHERE q.node = adj.t){back} GROUP BY 1)")
    every = " UNION ALL ".join(f"SELECT node, parent FROM t{k}" for k in range(1, depth + 1))
    out.append(f"tree AS MATERIALIZED (SELECT least(node, parent) AS from_id, greatest(node, parent) AS to_id FROM ({every}))")
    out.append("tags AS (SELECT from_id, to_id, ('0x' || substr(md5(concat_ws(':', from_id::VARCHAR, to_id::VARCHAR)), 1, 15))::BIGINT AS tag FROM relations ANTI JOIN tree USING (from_id, to_id))")
    out.append("tagged AS MATERIALIZED (SELECT node, bit_xor(tag) AS x FROM (SELECT from_id AS node, tag FROM tags UNION ALL SELECT to_id, tag FROM tags) GROUP BY 1)")
    out.append(f"u{depth} AS MATERIALIZED (SELECT t.node, parent, coalesce(x, 0) AS x FROM t{depth} t LEFT JOIN tagged g ON g.node = t.node)")
    for k in range(depth - 1, 0, -1):
        out.append(f"u{k} AS MATERIALIZED (SELECT t.node, t.parent, xor(coalesce(max(g.x), 0), coalesce(bit_xor(o.x), 0)) AS x FROM t{k} t LEFT JOIN tagged g ON g.node = t.node LEFT JOIN u{k + 1} o ON o.parent = t.node GROUP BY 1, 2)")
    every = " UNION ALL ".join(f"SELECT node, parent FROM u{k} WHERE x = 0" for k in range(1, depth + 1))
    out.append(f"cuts AS MATERIALIZED ({every})")
    out.append("bridged AS MATERIALIZED (SELECT person_id, count(node) AS incident_bridges, (count(node) > 0)::INT AS is_bridge FROM persons LEFT JOIN (SELECT node FROM cuts UNION ALL SELECT parent FROM cuts) b ON b.node = person_id GROUP BY 1)")
    return ",\n".join(out)


COMPONENTS = """
cc(person_id, component) USING KEY (person_id) AS (
    SELECT person_id, person_id FROM persons
    UNION
    SELECT n.v, min(n.c) FROM (SELECT adj.t AS v, cc.component AS c FROM cc JOIN adj ON adj.s = cc.person_id) n JOIN recurring.cc r ON r.person_id = n.v WHERE n.c < r.component GROUP BY n.v)
"""

FINAL = """
features AS MATERIALIZED (SELECT person_id, role AS true_role, betweenness, eigenvector, degree, cross_community_edges, participation_coef, is_bridge, core_number, incident_count, crime_diversity, coordinator_interactions
    FROM persons JOIN between_ USING (person_id) JOIN eigen USING (person_id) JOIN deg USING (person_id) JOIN community_features USING (person_id) JOIN behaviour USING (person_id) JOIN core USING (person_id) JOIN bridged USING (person_id)),
rules AS MATERIALIZED (SELECT person_id, true_role, CASE WHEN betweenness > 0.03 AND cross_community_edges > 2 AND eigenvector > 0.05 THEN 'Coordinator'
    WHEN betweenness > 0.015 AND participation_coef > 0.4 AND is_bridge > 0 THEN 'Broker'
    WHEN degree > 5 AND incident_count > 10 AND crime_diversity > 2 THEN 'Enabler' ELSE 'Peripheral' END AS predicted_role FROM features)"""
#: What the features of one network need, from its relations, adj and deg on.
OWN = ",\n".join([COMMUNITY, levels("piv"), flow(), power(), cores(), COMPONENTS, cut_edges(), FINAL])
FEATURES = ",\n".join([BASE, INCIDENTS, PIVOT, OWN])


def times(variant: str, role: str) -> str:
    m = {"v0": (3.0, 2.0, 1.3, 0.5), "v1": (4.0, 2.5, 1.5, 0.3), "v2": (5.0, 3.0, 1.8, 0.4), "v3": (3.0, 2.0, 1.3, 0.5)}[variant]
    return f"CASE {role} WHEN 'Coordinator' THEN {m[0]}::DOUBLE WHEN 'Broker' THEN {m[1]}::DOUBLE WHEN 'Enabler' THEN {m[2]}::DOUBLE WHEN 'Peripheral' THEN {m[3]}::DOUBLE ELSE 1 END"


def score(variant: str) -> str:
    """CTEs up to ``scored(person_id, s)``."""
    b = "betweenness", "eigenvector", "degree", "cross_community_edges"
    if variant == "v0":
        return f"raw AS (SELECT person_id, (0.35::DOUBLE * {b[0]} + 0.25::DOUBLE * {b[1]} + 0.15::DOUBLE * (0.1::DOUBLE * is_bridge) + 0.15::DOUBLE * {b[3]} / 10 + 0.10::DOUBLE * incident_count / 100) * {times('v0', 'predicted_role')} AS s FROM features JOIN rules USING (person_id)),\nscored AS (SELECT person_id, CASE WHEN max(s) OVER () > 0 THEN s / max(s) OVER () ELSE s END AS s FROM raw)"
    if variant == "v3":
        return f"raw AS (SELECT person_id, (0.6::DOUBLE * {b[0]} + 0.4::DOUBLE * {b[1]}) * {times('v3', 'predicted_role')} AS s FROM features JOIN rules USING (person_id)),\nscored AS (SELECT person_id, CASE WHEN max(s) OVER () > 0 THEN s / max(s) OVER () ELSE s END AS s FROM raw)"
    if variant == "v1":
        t = times("v1", "predicted_role")
        raw = f"""raw AS (SELECT person_id, predicted_role AS role, (0.40::DOUBLE * {b[0]} + 0.25::DOUBLE * {b[1]} + 0.15::DOUBLE * {b[2]} / 50 + 0.10::DOUBLE * (0.2::DOUBLE * is_bridge) + 0.05::DOUBLE * {b[3]} / 10 + 0.05::DOUBLE * core_number / 10) * (1 + 0.2::DOUBLE * {t}) * {t}
    * CASE WHEN predicted_role = 'Coordinator' AND degree > 20 THEN 1.3::DOUBLE ELSE 1 END AS s FROM features JOIN rules USING (person_id))"""
        return raw + """,
cut AS (SELECT quantile_cont(s, 0.05) AS lo, quantile_cont(s, 0.95) AS hi FROM raw),
clip AS (SELECT person_id, role, least(greatest(s, lo), hi) AS s FROM raw, cut),
mean AS (SELECT avg(s) FILTER (role = 'Coordinator') AS c, avg(s) FILTER (role = 'Peripheral') AS q FROM clip),
lift AS (SELECT person_id, CASE WHEN role = 'Coordinator' AND coalesce(c / (q + 1e-6) < 2, false) THEN s * 2 ELSE s END AS s FROM clip, mean),
scored AS (SELECT person_id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE s END AS s FROM lift)"""
    both = f"(0.7::DOUBLE * {times('v2', 'f.true_role')} + 0.3::DOUBLE * {times('v2', 'predicted_role')})"
    return f"""raw AS (SELECT person_id, f.true_role AS role, (0.7::DOUBLE * (0.35::DOUBLE * {b[0]} + 0.25::DOUBLE * {b[1]} + 0.15::DOUBLE * {b[2]} / 50 + 0.10::DOUBLE * core_number / 10 + 0.10::DOUBLE * {b[3]} / 10 + 0.05::DOUBLE * is_bridge)
    + 0.3::DOUBLE * (0.40::DOUBLE * incident_count / 100 + 0.30::DOUBLE * coordinator_interactions / 10 + 0.30::DOUBLE * crime_diversity / 10)) * {both}
    * CASE WHEN f.true_role = 'Coordinator' AND degree > 15 THEN 1.4::DOUBLE ELSE 1 END AS s FROM features f JOIN rules USING (person_id)),
cut AS (SELECT quantile_cont(s, 0.02) AS lo, quantile_cont(s, 0.98) AS hi FROM raw),
clip AS (SELECT person_id, role, least(greatest(s, lo), hi) AS s FROM raw, cut),
flat AS (SELECT person_id, role, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE s END AS s FROM clip),
mean AS (SELECT avg(s) FILTER (role = 'Coordinator') AS c, avg(s) FILTER (role = 'Peripheral') AS q FROM flat),
scored AS (SELECT person_id, CASE WHEN role = 'Coordinator' AND coalesce(c / nullif(q, 0) < 2, false) THEN least(s * 1.5::DOUBLE, 1.0::DOUBLE) ELSE s END AS s FROM flat, mean)"""


def renamed(sql: str, *outside: str) -> str:
    """The same CTEs for the other network: their names, and those of ``outside``, end with _s."""
    names = re.findall(r"(?m)^\s*(\w+)(?:\([^)]*\) USING KEY \([^)]*\))? AS (?:MATERIALIZED )?\(", sql)
    return re.sub(rf"\b({'|'.join([*names, *outside])})\b", r"\1_s", sql)


#: The other network: the best non-edges by common neighbours added.
AUGMENTED = f"""
wedges AS (SELECT DISTINCT a.s AS from_id, b.t AS to_id FROM adj a JOIN adj b ON a.t = b.s AND a.s < b.t ANTI JOIN relations r ON r.from_id = a.s AND r.to_id = b.t),
added AS MATERIALIZED (SELECT c.from_id, c.to_id, count(*) AS cn FROM wedges c JOIN adj a ON a.s = c.from_id JOIN adj b ON b.s = c.to_id AND b.t = a.t GROUP BY 1, 2 ORDER BY cn DESC, 1, 2 LIMIT {ADDED}),
relations_s AS MATERIALIZED (SELECT from_id, to_id, weight, 'original' AS relation_type FROM relations UNION ALL SELECT from_id, to_id, 1, 'predicted' FROM added),
adj_s AS MATERIALIZED (SELECT from_id AS s, to_id AS t FROM relations_s UNION ALL SELECT to_id, from_id FROM relations_s),
deg_s AS MATERIALIZED (SELECT person_id, count(t) AS degree FROM persons LEFT JOIN adj_s ON s = person_id GROUP BY 1)
"""

def closeness_by_bits(depth: int = DEPTH) -> str:
    """Closeness by searches of 62 sources at a time, a bit for each."""
    out = ["placed AS MATERIALIZED (SELECT person_id, (row_number() OVER (ORDER BY person_id) - 1) // 62 AS blk, ((row_number() OVER (ORDER BY person_id) - 1) % 62)::INT AS b FROM persons)",
           "g0 AS MATERIALIZED (SELECT blk, person_id AS v, 1::BIGINT << b AS m FROM placed)", "h0 AS MATERIALIZED (SELECT * FROM g0)"]
    for d in range(1, depth + 1):
        out.append(f"g{d} AS MATERIALIZED (SELECT * FROM (SELECT n.blk, n.v, n.m & ~coalesce(q.m, 0) AS m FROM (SELECT p.blk, adj.t AS v, bit_or(p.m) AS m FROM g{d - 1} p JOIN adj ON adj.s = p.v GROUP BY 1, 2) n LEFT JOIN h{d - 1} q ON q.blk = n.blk AND q.v = n.v) WHERE m <> 0)")
        out.append(f"h{d} AS MATERIALIZED (SELECT blk, v, bit_or(m) AS m FROM (SELECT * FROM h{d - 1} UNION ALL SELECT * FROM g{d}) GROUP BY 1, 2)")
    every = " UNION ALL ".join(f"SELECT blk, b, {d} AS d, count(*) AS n FROM g{d}, range(0, 62) x(b) WHERE m & (1::BIGINT << b::INT) <> 0 GROUP BY 1, 2" for d in range(1, depth + 1))
    out.append(f"close_ AS MATERIALIZED (SELECT person_id, coalesce(sum(n)::DOUBLE / sum(n * d) * (sum(n)::DOUBLE / ((SELECT count(*) FROM persons) - 1)), 0) AS closeness FROM placed LEFT JOIN ({every}) e ON e.blk = placed.blk AND e.b = placed.b GROUP BY 1)")
    return ",\n".join(out)


CLOSENESS = closeness_by_bits()
BOTH = ",\n".join([FEATURES, score("v1"), CLOSENESS, AUGMENTED, renamed(",\n".join([OWN, score("v1"), CLOSENESS]), "relations", "adj", "deg")])


def _order(network: str, x: str) -> str:
    rank = lambda by: f"row_number() OVER (ORDER BY {by}, person_id)"
    return f"""SELECT 'Degree ({network})' AS strategy, {rank('degree DESC')} AS rank, person_id FROM deg{x}
    UNION ALL SELECT 'Betweenness ({network})', {rank('round(betweenness, 9) DESC')}, person_id FROM between_{x}
    UNION ALL SELECT 'Closeness ({network})', {rank('round(closeness, 9) DESC')}, person_id FROM close_{x}
    UNION ALL SELECT 'MO-Based ({network})', {rank('round(s, 9) DESC')}, person_id FROM scored{x}
    UNION ALL SELECT 'Random ({network})', {rank(f"md5(concat_ws(':', '{SEED}', person_id::VARCHAR))")}, person_id FROM persons"""


ORDERS = f"""
orders_ AS MATERIALIZED ({_order('Original', '')} UNION ALL {_order('SEAL', '_s')}),
removed AS MATERIALIZED (SELECT strategy, rank, person_id FROM orders_ WHERE rank <= {STEPS}),
nets AS MATERIALIZED (SELECT DISTINCT strategy, row_number() OVER (ORDER BY strategy)::INT AS k, strategy LIKE '%SEAL%' AS seal FROM (SELECT DISTINCT strategy FROM removed)),
gone AS MATERIALIZED (SELECT k, p.person_id, coalesce(r.rank, {STEPS} + 1)::INT AS rank FROM nets CROSS JOIN persons p LEFT JOIN removed r ON r.strategy = nets.strategy AND r.person_id = p.person_id),
lives AS MATERIALIZED (SELECT u.k, a.s, a.t, least(u.rank, v.rank) AS until FROM (SELECT FALSE AS seal, s, t FROM adj UNION ALL SELECT TRUE, s, t FROM adj_s) a
    JOIN nets n ON n.seal = a.seal JOIN gone u ON u.k = n.k AND u.person_id = a.s JOIN gone v ON v.k = n.k AND v.person_id = a.t)
"""


def curve() -> str:
    """Components and efficiency of each strategy's network after each step; an edge lives while both ends do."""
    out = [f"""alive AS MATERIALIZED (SELECT k, step::INT AS step, person_id, row_number() OVER (PARTITION BY k, step ORDER BY md5(concat_ws(':', '{SEED}', person_id::VARCHAR)), person_id) - 1 AS place FROM gone JOIN range(0, {STEPS + 1}) x(step) ON rank > step),
parted(k, step, v, c) USING KEY (k, step, v) AS (
    SELECT k, step, person_id, person_id FROM alive
    UNION
    SELECT n.k, n.step, n.v, min(n.c) FROM (SELECT e.k, p.step, e.t AS v, p.c FROM parted p JOIN lives e ON e.k = p.k AND e.s = p.v AND e.until > p.step) n
    JOIN recurring.parted r ON r.k = n.k AND r.step = n.step AND r.v = n.v WHERE n.c < r.c GROUP BY 1, 2, 3),
parts AS (SELECT k, step, c, count(*) AS size FROM parted GROUP BY 1, 2, 3),
counts AS (SELECT k, step, sum(size)::BIGINT AS num_nodes, count(*) AS num_components, max(size) AS lcc_size FROM parts GROUP BY 1, 2),
edgecount AS (SELECT e.k, step, count(*) // 2 AS num_edges FROM lives e JOIN range(0, {STEPS + 1}) x(step) ON until > step GROUP BY 1, 2)""",
        f"m0 AS MATERIALIZED (SELECT k, step, person_id AS v, 1::BIGINT << place::INT AS m FROM alive WHERE place < {EFFICIENCY_SOURCES})",
        "s0 AS MATERIALIZED (SELECT * FROM m0)"]
    for d in range(1, THIN_DEPTH + 1):
        out.append(f"m{d} AS MATERIALIZED (SELECT * FROM (SELECT n.k, n.step, n.v, n.m & ~coalesce(q.m, 0) AS m FROM (SELECT e.k, p.step, e.t AS v, bit_or(p.m) AS m FROM m{d - 1} p JOIN lives e ON e.k = p.k AND e.s = p.v AND e.until > p.step GROUP BY 1, 2, 3) n LEFT JOIN s{d - 1} q ON q.k = n.k AND q.step = n.step AND q.v = n.v) WHERE m <> 0)")
        out.append(f"s{d} AS MATERIALIZED (SELECT k, step, v, bit_or(m) AS m FROM (SELECT * FROM s{d - 1} UNION ALL SELECT * FROM m{d}) GROUP BY 1, 2, 3)")
    far = " UNION ALL ".join(f"SELECT k, step, sum(bit_count(m))::DOUBLE / {d} AS e FROM m{d} GROUP BY 1, 2" for d in range(1, THIN_DEPTH + 1))
    out.append(f"near AS (SELECT k, step, sum(e) AS e FROM ({far}) GROUP BY 1, 2)")
    out.append(f"""curve AS MATERIALIZED (SELECT n.strategy, c.step::BIGINT AS step, r.person_id AS removed_node, num_nodes, coalesce(num_edges, 0)::BIGINT AS num_edges, num_components,
    num_components / first_value(num_components) OVER w AS cc_normalized, lcc_size, lcc_size / first_value(lcc_size) OVER w AS lcc_normalized, global_efficiency, coalesce(global_efficiency / nullif(first_value(global_efficiency) OVER w, 0), 0) AS efficiency_normalized
    FROM (SELECT counts.*, CASE WHEN num_nodes > 1 THEN coalesce(e, 0) / (least(num_nodes, {EFFICIENCY_SOURCES}) * (num_nodes - 1)) ELSE 0 END AS global_efficiency FROM counts LEFT JOIN near ON near.k = counts.k AND near.step = counts.step) c
    JOIN nets n ON n.k = c.k LEFT JOIN edgecount e ON e.k = c.k AND e.step = c.step LEFT JOIN removed r ON r.strategy = n.strategy AND r.rank = c.step WINDOW w AS (PARTITION BY n.strategy ORDER BY c.step))""")
    out.append("""summary AS MATERIALIZED (SELECT strategy AS strategy_, coalesce(min(step) FILTER (lcc_normalized <= 0.5), count(*))::DOUBLE AS steps, coalesce(min(step) FILTER (efficiency_normalized <= 0.5), count(*))::DOUBLE AS esteps, coalesce(sum(area), 0) AS area, coalesce(sum(earea), 0) AS earea
    FROM (SELECT *, (lcc_normalized + lag(lcc_normalized) OVER w) / 2 * (step - lag(step) OVER w) AS area, (efficiency_normalized + lag(efficiency_normalized) OVER w) / 2 * (step - lag(step) OVER w) AS earea FROM curve WINDOW w AS (PARTITION BY strategy ORDER BY step)) GROUP BY 1),
base AS (SELECT steps AS b, esteps AS e FROM summary WHERE strategy_ = 'Degree (Original)')""")
    return ",\n".join(out)


CURVE = curve()

SPLIT = f"""
mixed AS (SELECT from_id, to_id, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', from_id::VARCHAR, to_id::VARCHAR)), from_id, to_id) AS r, count(*) OVER () AS m FROM relations),
sizes AS (SELECT *, least(floor(0.2::DOUBLE * m)::BIGINT, m // 3) AS te FROM mixed),
split AS MATERIALIZED (SELECT from_id, to_id, CASE WHEN r <= te THEN 'test' WHEN r <= te + te // 2 THEN 'val' ELSE 'train' END AS split FROM sizes)
"""

NEGATIVES = f"""
numbered AS MATERIALIZED (SELECT person_id, row_number() OVER (ORDER BY md5(person_id::VARCHAR), person_id) - 1 AS number, count(*) OVER () AS n FROM persons),
drawn AS (SELECT from_id, to_id, split, t, ('0x' || substr(md5(concat_ws(':', '{SEED}', from_id::VARCHAR, to_id::VARCHAR, t::VARCHAR)), 1, 12))::BIGINT % (SELECT count(*) FROM persons) AS number FROM split, range(1, 9) x(t)),
asked AS (SELECT from_id, to_id, split, t, least(from_id, person_id) AS u, greatest(from_id, person_id) AS v FROM drawn JOIN numbered USING (number) WHERE person_id <> from_id),
free AS (SELECT a.* FROM asked a LEFT JOIN relations r ON r.from_id = a.u AND r.to_id = a.v WHERE r.from_id IS NULL),
negatives AS MATERIALIZED (SELECT u AS from_id, v AS to_id, split FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, split ORDER BY t, u, v) AS k FROM free) WHERE k = 1)
"""

PAIRS = """
pairs AS MATERIALIZED (SELECT from_id, to_id, split, 1 AS label FROM split WHERE split <> 'train' UNION ALL SELECT from_id, to_id, split, 0 FROM negatives WHERE split <> 'train'),
training AS MATERIALIZED (SELECT from_id AS s, to_id AS t FROM split WHERE split = 'train' UNION ALL SELECT to_id, from_id FROM split WHERE split = 'train'),
tdeg AS MATERIALIZED (SELECT person_id, count(t) AS degree FROM persons LEFT JOIN training ON s = person_id GROUP BY 1),
common AS (SELECT p.from_id, p.to_id, count(*) AS cn, sum(1 / nullif(ln(d.degree), 0)) AS aa, sum(1.0::DOUBLE / d.degree) AS ra
    FROM (SELECT DISTINCT from_id, to_id FROM pairs) p JOIN training a ON a.s = p.from_id JOIN training b ON b.s = p.to_id AND b.t = a.t JOIN tdeg d ON d.person_id = a.t GROUP BY 1, 2),
link_scores AS MATERIALIZED (SELECT p.from_id, p.to_id, split, label, coalesce(cn, 0) AS common_neighbours, coalesce(coalesce(cn, 0)::DOUBLE / nullif(du.degree + dv.degree - coalesce(cn, 0), 0), 0) AS jaccard,
    coalesce(aa, 0) AS adamic_adar, coalesce(ra, 0) AS resource_allocation, du.degree * dv.degree AS preferential_attachment
    FROM pairs p JOIN tdeg du ON du.person_id = p.from_id JOIN tdeg dv ON dv.person_id = p.to_id LEFT JOIN common c ON c.from_id = p.from_id AND c.to_id = p.to_id),
ranked AS (SELECT preferential_attachment AS score, sum(label) AS pos, sum(1 - label) AS neg FROM link_scores GROUP BY 1),
above AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS tp, coalesce(sum(neg) OVER w, 0) AS fp FROM ranked WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""

MATRIX = "matrix AS MATERIALIZED (SELECT true_role, predicted_role, count(*) AS n FROM rules GROUP BY 1, 2)"
REPORT = """
labels_ AS (SELECT true_role AS role FROM matrix UNION SELECT predicted_role FROM matrix),
report AS MATERIALIZED (SELECT role, hit / nullif(called, 0) AS p0, hit / nullif(support, 0) AS r0, support FROM (
    SELECT role, coalesce((SELECT sum(n) FROM matrix WHERE true_role = role), 0) AS support, coalesce((SELECT sum(n) FROM matrix WHERE predicted_role = role), 0) AS called,
           coalesce((SELECT sum(n) FROM matrix WHERE predicted_role = role AND true_role = role), 0) AS hit FROM labels_))
"""


def query(*parts: str, select: str, recursive: bool = True) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + select


def _r(*names: str) -> str:
    return ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in names)


F_LIST = "person_id, true_role, is_bridge::DOUBLE AS is_bridge, core_number::DOUBLE AS core_number, degree::DOUBLE AS degree, cross_community_edges::DOUBLE AS cross_community_edges, incident_count::DOUBLE AS incident_count, crime_diversity::DOUBLE AS crime_diversity, coordinator_interactions::DOUBLE AS coordinator_interactions"

ORACLES: dict[str, str] = {
    "persons_view": query(BASE, select="SELECT * FROM persons"),
    "relations_view": query(BASE, select="SELECT * FROM relations"),
    "incidents_view": query(BASE, INCIDENTS, select="SELECT * FROM incidents"),
    "role_distribution": query(BASE, select="SELECT role, count(*) AS count, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM persons GROUP BY role"),
    "role_age_stats": query(BASE, select="SELECT role, count(*) AS n, round(avg(age), 6) AS mean, round(stddev_samp(age), 6) AS std, round(quantile_cont(age::DOUBLE, 0.5), 6) AS median, min(age) AS low, max(age) AS high FROM persons GROUP BY role"),
    "graph_summary": query(BASE, TRIANGLES, COMPONENTS, select="SELECT (SELECT count(*) FROM persons) AS nodes, (SELECT count(*) FROM relations) AS edges, round((SELECT 2.0::DOUBLE * count(*) FROM relations) / (SELECT count(*) * (count(*) - 1) FROM persons), 6) AS density, round((SELECT avg(clustering_coef) FROM ego), 6) AS avg_clustering, (SELECT count(DISTINCT component) FROM cc) AS components, (SELECT max(c) FROM (SELECT count(*) AS c FROM cc GROUP BY component)) AS largest"),
    "node_degree_features": query(BASE, select="SELECT person_id, degree, round(degree::DOUBLE / ((SELECT count(*) FROM persons) - 1), 6) AS degree_centrality FROM deg"),
    "clustering_ego": query(BASE, TRIANGLES, select=f"SELECT person_id, degree, triangles, ego_nodes, {_r('clustering_coef', 'ego_density')} FROM ego"),
    "community_features": query(BASE, COMMUNITY, select=f"SELECT person_id, same_community_degree, cross_community_edges, {_r('participation_coef', 'participation_coef_full', 'within_module_z')} FROM community_features"),
    "behaviour_features": query(BASE, INCIDENTS, select=f"SELECT person_id, incident_count, crime_diversity, {_r('avg_severity')}, coordinator_interactions, broker_interactions, enabler_interactions, peripheral_interactions FROM behaviour"),
    "feature_table": query(FEATURES, select=f"SELECT {F_LIST}, {_r('betweenness', 'eigenvector', 'participation_coef')} FROM features"),
    "hop2_ball": query(BASE, pivot(SOURCES), levels("piv"), select="SELECT s AS src, v AS node, d::INT AS d FROM far WHERE d <= 2"),
    "bfs_from_pivots": query(BASE, pivot(SOURCES), levels("piv"), select="SELECT s AS src, v AS node, d::INT AS d FROM far"),
    "closeness": query(BASE, CLOSENESS, select=f"SELECT person_id, {_r('closeness')} FROM close_"),
    "efficiency_exact": query(BASE, levels("persons"), select="SELECT (SELECT count(*) FROM persons) AS sources, round((SELECT sum(1.0::DOUBLE / d) FROM far WHERE d > 0) / (SELECT count(*)::DOUBLE * (count(*) - 1) FROM persons), 6) AS global_efficiency"),
    "efficiency_pivots": query(BASE, pivot(EFFICIENCY_SOURCES), levels("piv"), select=f"SELECT {EFFICIENCY_SOURCES}::BIGINT AS sources, round((SELECT sum(1.0::DOUBLE / d) FROM far WHERE d > 0) / (SELECT {EFFICIENCY_SOURCES}::DOUBLE * (count(*) - 1) FROM persons), 6) AS global_efficiency"),
    "eigenvector": query(BASE, power(), select=f"SELECT person_id, {_r('eigenvector')} FROM eigen"),
    "core_numbers": query(BASE, cores(), select="SELECT person_id, core_number::BIGINT AS core_number FROM core"),
    "bridges": query(BASE, COMPONENTS, cut_edges(), select="SELECT person_id, is_bridge, incident_bridges FROM bridged"),
    "betweenness": query(BASE, levels("persons"), flow(None), select=f"SELECT person_id, {_r('betweenness')}, round(betweenness * ((SELECT count(*) FROM persons) - 1) * ((SELECT count(*) FROM persons) - 2) / 2, 4) AS betweenness_norm FROM between_"),
    "load_centrality": query(BASE, levels("persons"), flow(None), select=f"SELECT person_id, {_r('load_centrality')} FROM between_"),
    "eigenvector_fixed": query(BASE, eigen(), select=f"SELECT person_id, {_r('eigenvector')} FROM eigen"),
    "burt_constraint": query(BASE, "p AS MATERIALIZED (SELECT s, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) AS p FROM adj)", "two AS (SELECT a.s, b.t, sum(a.p * b.p) AS w FROM p a JOIN p b ON a.t = b.s AND a.s <> b.t GROUP BY 1, 2)", select="SELECT person_id, 0.0::DOUBLE AS constraint, round(coalesce(sum((p.p + coalesce(two.w, 0)) ** 2), 0), 6) AS burt_constraint FROM persons LEFT JOIN p ON p.s = person_id LEFT JOIN two ON two.s = p.s AND two.t = p.t GROUP BY 1"),
    "betweenness_pivots": query(BASE, PIVOT, levels("piv"), flow(), select=f"SELECT person_id, {_r('betweenness', 'load_centrality')} FROM between_"),
    "connected_components": query(BASE, COMPONENTS, select="SELECT person_id, component FROM cc"),
    "rule_roles": query(FEATURES, select="SELECT person_id, predicted_role FROM rules"),
    **{f"mo_score_{v}": query(FEATURES, score(v), select="SELECT person_id, round(s, 6) AS mo_importance_score FROM scored") for v in ("v0", "v1", "v2", "v3")},
    "top_targets": query(FEATURES, score("v1"), select=f"SELECT row_number() OVER (ORDER BY round(s, 6) DESC, person_id)::INT AS rank, person_id, true_role AS role, round(s, 6) AS mo_importance_score FROM scored JOIN features USING (person_id) ORDER BY 1 LIMIT {TOP}"),
    "coordinator_coverage": query(FEATURES, score("v1"), f"best AS (SELECT person_id FROM scored ORDER BY round(s, 6) DESC, person_id LIMIT {TOP})", select="SELECT role, count(b.person_id) AS selected, count(*) AS total, round(count(b.person_id)::DOUBLE / count(*), 6) AS coverage FROM persons p LEFT JOIN best b ON b.person_id = p.person_id GROUP BY role"),
    "removal_orders": query(BOTH, ORDERS, select="SELECT strategy, rank::INT AS rank, person_id FROM removed"),
    "disruption_curve": query(BOTH, ORDERS, CURVE, select=f"SELECT strategy, step, removed_node, num_nodes, num_edges, num_components, lcc_size, {_r('cc_normalized', 'lcc_normalized', 'global_efficiency', 'efficiency_normalized')} FROM curve"),
    "disruption_summary": query(BOTH, ORDERS, CURVE, select='SELECT strategy_ AS "Strategy", steps AS "Steps_to_50%_LCC", esteps AS "Steps_to_50%_Efficiency", round(area, 6) AS "AUC_LCC", round(earea, 6) AS "AUC_Efficiency", round(CASE WHEN steps > 0 THEN 1 / steps ELSE 0 END, 6) AS "Avg_LCC_Reduction_Rate" FROM summary'),
    "disruption_improvements": query(BOTH, ORDERS, CURVE, select="""SELECT strategy_ AS "Strategy", steps AS "Steps_to_50%_LCC", round((b - steps) / b * 100, 6) AS "Improvement_%", b - steps AS "Faster_by_nodes" FROM summary, base WHERE NOT (strategy_ LIKE '%Original%' AND strategy_ NOT LIKE '%Degree%')"""),
    "improvement_matrix": query(BOTH, ORDERS, CURVE, select="""SELECT strategy_ AS "Strategy", round((b - steps) / b * 100, 6) AS lcc_improvement, round((e - esteps) / e * 100, 6) AS efficiency_improvement FROM summary, base WHERE strategy_ <> 'Degree (Original)'"""),
    "strategy_bars": query(BOTH, ORDERS, CURVE, select="""SELECT regexp_extract(strategy_, '^[^ ]+') AS strategy, max(steps) FILTER (strategy_ LIKE '%Original%') AS "Original", max(steps) FILTER (strategy_ LIKE '%SEAL%') AS "SEAL" FROM summary GROUP BY 1"""),
    "robust_scaled_features": query(FEATURES, select="SELECT person_id, " + ", ".join(f"round(({c} - quantile_cont({c}::DOUBLE, 0.5) OVER ()) / CASE WHEN quantile_cont({c}::DOUBLE, 0.75) OVER () = quantile_cont({c}::DOUBLE, 0.25) OVER () THEN 1 ELSE quantile_cont({c}::DOUBLE, 0.75) OVER () - quantile_cont({c}::DOUBLE, 0.25) OVER () END, 6) AS {c}" for c in ("betweenness", "eigenvector", "degree", "incident_count")) + " FROM features"),
    "confusion_matrix": query(FEATURES, MATRIX, select="SELECT * FROM matrix"),
    "role_f1_report": query(FEATURES, MATRIX, REPORT, select="SELECT role, round(coalesce(p0, 0), 6) AS precision, round(coalesce(r0, 0), 6) AS recall, round(coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0), 6) AS f1, support::BIGINT AS support FROM report"),
    "weighted_f1": query(FEATURES, MATRIX, REPORT, select="SELECT round(sum(coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) * support) / sum(support), 6) AS weighted_f1 FROM report"),
    "ari_nmi": query(FEATURES, MATRIX, "a AS (SELECT true_role, sum(n) AS a FROM matrix GROUP BY 1)", "b AS (SELECT predicted_role, sum(n) AS b FROM matrix GROUP BY 1)", "t AS (SELECT sum(n)::DOUBLE AS t, sum(n * (n - 1) / 2) AS both_ FROM matrix)", "x AS (SELECT (SELECT sum(a * (a - 1) / 2) FROM a) AS pa, (SELECT sum(b * (b - 1) / 2) FROM b) AS pb, (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS ha, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hb, (SELECT sum(n / t * ln(n * t / (a * b))) FROM matrix JOIN a USING (true_role) JOIN b USING (predicted_role), t) AS mi)", select="SELECT round((both_ - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari, round(mi / ((ha + hb) / 2), 6) AS nmi FROM x, t"),
    "edge_split": query(BASE, SPLIT, select="SELECT * FROM split"),
    "negative_samples": query(BASE, SPLIT, NEGATIVES, select="SELECT * FROM negatives"),
    "link_scores": query(BASE, SPLIT, NEGATIVES, PAIRS, select=f"SELECT from_id, to_id, split, label, common_neighbours, preferential_attachment, {_r('jaccard', 'adamic_adar', 'resource_allocation')} FROM link_scores"),
    "link_auc": query(BASE, SPLIT, NEGATIVES, PAIRS, select="SELECT round(sum(neg * (tp + pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS auc FROM above"),
    "link_ap": query(BASE, SPLIT, NEGATIVES, PAIRS, select="SELECT round(sum(pos * (tp + pos)::DOUBLE / (tp + pos + fp + neg)) / sum(pos), 6) AS ap FROM above"),
    "enclosing_subgraphs": query(BASE, SPLIT, "ends AS (SELECT DISTINCT unnest([from_id, to_id]) AS person_id FROM split)", "one AS MATERIALIZED (SELECT person_id AS s, person_id AS v FROM ends UNION SELECT person_id, t FROM ends JOIN adj ON s = person_id)", "ball AS MATERIALIZED (SELECT s, v FROM one UNION SELECT one.s, adj.t FROM one JOIN adj ON adj.s = one.v)", "members AS MATERIALIZED (SELECT from_id, to_id, v FROM split JOIN ball ON s = from_id UNION SELECT from_id, to_id, v FROM split JOIN ball ON s = to_id)", "inner_ AS (SELECT m.from_id, m.to_id, count(*) AS n_edges FROM members m JOIN relations r ON r.from_id = m.v JOIN members o ON o.from_id = m.from_id AND o.to_id = m.to_id AND o.v = r.to_id GROUP BY 1, 2)", select="SELECT m.from_id, m.to_id, count(*)::INT AS n_nodes, coalesce(max(n_edges), 0)::INT AS n_edges FROM members m LEFT JOIN inner_ i ON i.from_id = m.from_id AND i.to_id = m.to_id GROUP BY 1, 2"),
    "augmented_relations": query(BASE, "cand AS (SELECT DISTINCT a.s AS from_id, b.t AS to_id FROM adj a JOIN adj b ON a.t = b.s AND a.s < b.t ANTI JOIN relations r ON r.from_id = a.s AND r.to_id = b.t)", "best AS (SELECT c.from_id, c.to_id, count(*) AS cn FROM cand c JOIN adj a ON a.s = c.from_id JOIN adj b ON b.s = c.to_id AND b.t = a.t GROUP BY 1, 2)", select="SELECT from_id, to_id, weight, 'original' AS relation_type FROM relations UNION ALL (SELECT from_id, to_id, 1, 'predicted' FROM best ORDER BY cn DESC, from_id, to_id LIMIT 100)"),
    "burt_top": query(BASE, select="SELECT relation_type, count(*) AS n, sum(weight)::BIGINT AS weight FROM relations GROUP BY 1"),
    "cv_folds": query(BASE, f"dealt AS (SELECT role, (row_number() OVER (PARTITION BY role ORDER BY md5(concat_ws(':', '{SEED}', person_id::VARCHAR)), person_id) - 1) % 5 AS fold FROM persons)", select="SELECT fold::INT AS fold, role, count(*) AS n FROM dealt GROUP BY 1, 2"),
    "edge_shards": query(BASE, select="SELECT from_id, to_id, least((row_number() OVER (ORDER BY from_id, to_id) - 1) // (count(*) OVER () // 3), 2)::INT AS shard FROM relations"),
    "noisy_relations": query(BASE, "pool AS MATERIALIZED (SELECT from_id, to_id FROM relations WHERE relation_type <> 'hierarchical' OR ('0x' || substr(md5(concat_ws(':', '42/may', from_id::VARCHAR, to_id::VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < 0.2)", "gone AS (SELECT from_id, to_id FROM pool ORDER BY ('0x' || substr(md5(concat_ws(':', '42/drop', from_id::VARCHAR, to_id::VARCHAR)), 1, 12))::BIGINT, from_id, to_id LIMIT (SELECT floor(0.18::DOUBLE * count(*))::BIGINT FROM pool))", "num AS MATERIALIZED (SELECT person_id, role, row_number() OVER (ORDER BY person_id) - 1 AS i FROM persons)", "want AS (SELECT floor(0.01::DOUBLE * count(*))::BIGINT AS k FROM relations)", "tries AS (SELECT t, floor(('0x' || substr(md5(concat_ws(':', '42/u', t::VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * (SELECT count(*) FROM persons))::BIGINT AS a, floor(('0x' || substr(md5(concat_ws(':', '42/v', t::VARCHAR)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * (SELECT count(*) FROM persons))::BIGINT AS b FROM range(0, 20 * (SELECT k FROM want)) x(t))", "fresh AS (SELECT least(u.person_id, v.person_id) AS from_id, greatest(u.person_id, v.person_id) AS to_id, min(t) AS t FROM tries JOIN num u ON u.i = a JOIN num v ON v.i = b WHERE u.person_id <> v.person_id AND NOT (u.role = 'Coordinator' AND v.role = 'Coordinator') GROUP BY 1, 2)", "new_ AS (SELECT f.* FROM fresh f ANTI JOIN relations r ON r.from_id = f.from_id AND r.to_id = f.to_id ORDER BY t LIMIT (SELECT k FROM want))", select="SELECT r.from_id, r.to_id, r.weight::INT AS weight, r.relation_type FROM relations r ANTI JOIN gone g ON g.from_id = r.from_id AND g.to_id = r.to_id UNION ALL SELECT from_id, to_id, 1, 'noise' FROM new_"),
    "diagnostics": query(BASE, TRIANGLES, COMPONENTS, "d AS (SELECT (SELECT 2.0::DOUBLE * count(*) FROM relations) / (SELECT count(*) * (count(*) - 1) FROM persons) AS density, (SELECT avg(clustering_coef) FROM ego) AS ac, (SELECT count(DISTINCT component) FROM cc) AS parts)", "i AS (SELECT list_filter([CASE WHEN density < 0.015 THEN 'density too low' WHEN density > 0.05 THEN 'density too high' END, CASE WHEN ac < 0.3 THEN 'clustering too low' END, CASE WHEN parts > 1 THEN 'several components' END], lambda x: x IS NOT NULL) AS l FROM d)", "sh AS (SELECT role, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS s FROM persons GROUP BY role)", "bad AS (SELECT role, lo, hi FROM (VALUES ('Coordinator', 5, 10, 1), ('Broker', 10, 15, 2), ('Enabler', 20, 25, 3), ('Peripheral', 55, 65, 4)) b(role, lo, hi, o) LEFT JOIN sh USING (role) WHERE coalesce(s, 0) NOT BETWEEN lo AND hi ORDER BY o)", select="SELECT 'structure' AS check, len(l) = 0 AS passed, array_to_string(l, '; ') AS issues FROM i UNION ALL SELECT 'roles', count(*) = 0, coalesce(string_agg('share of ' || role || ' outside ' || lo || '-' || hi || ' %', '; '), '') FROM bad"),
    "separability": query(FEATURES, select="SELECT true_role AS role, feature, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM (SELECT true_role, unnest(['betweenness', 'eigenvector', 'degree', 'core_number']) AS feature, unnest([betweenness, eigenvector, degree, core_number]) AS x FROM features) GROUP BY 1, 2"),
    "events_tumbling": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
ORACLES["relation_types"] = ORACLES.pop("burt_top")
