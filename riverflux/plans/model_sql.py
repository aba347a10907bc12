"""SQL of the iterative models, for tables z (id, a to e, day, label) and lp (profiles)."""

from __future__ import annotations

from riverflux.functions.risk import FEATURES, RISKS
from riverflux.operators.clusters import seed_draws

#: Rounds in which the smallest id spreads over the neighbours and to the root's root: twice as far in each at least.
SPREADS = 24
Z = "[a, b, c, d, e]"


def kmeans(k: int = 3, seed: int = 42, rounds: int = 200) -> str:
    """km: day, label, cluster, km_risk. Seeds are drawn along the running sums of the distances; a recursion moves the means."""
    u = seed_draws(k, seed)
    near = lambda i: "least(" + ", ".join(f"list_distance(z, s{j}.c)" for j in range(i)) + ", 1e308)"
    steps = [f"zk AS MATERIALIZED (SELECT id, day, label, {Z} AS z FROM z)", f"s0 AS MATERIALIZED (SELECT z AS c FROM zk WHERE id = CAST(floor({u[0]!r} * (SELECT count(*) FROM zk)) AS BIGINT) + 1)"]
    for i in range(1, k):
        tables = ", ".join(f"s{j}" for j in range(i))
        steps.append(f"s{i} AS MATERIALIZED (SELECT arg_min(z, id) AS c FROM (SELECT id, z, w, sum(w) OVER (ORDER BY id) AS s, sum(w) OVER () AS t FROM (SELECT id, z, {near(i)} AS w FROM zk, {tables})) WHERE w > 0 AND s > {u[i]!r} * t)")
    centres = [f"c{i}" for i in range(k)]
    pick = lambda c: "CASE " + " ".join(f"WHEN {' AND '.join(f'd{i} <= d{j}' for j in range(i + 1, k)) or 'true'} THEN {i}" for i in range(k)) + " END AS " + c
    to = ", ".join(f"list_distance(z, c{i}) AS d{i}" for i in range(k))
    mean = lambda i: f"CASE WHEN count(*) FILTER (g = {i}) = 0 THEN c{i} ELSE [{', '.join(f'avg(z[{j}]) FILTER (g = {i})' for j in range(1, len(FEATURES) + 1))}] END AS n{i}"
    steps.append(
        f"kr(it, {', '.join(centres)}, moved) AS (SELECT 0, {', '.join(f's{i}.c' for i in range(k))}, true FROM {', '.join(f's{i}' for i in range(k))} UNION ALL "
        f"SELECT it + 1, {', '.join(f'n{i}' for i in range(k))}, greatest({', '.join(f'list_distance(n{i}, c{i})' for i in range(k))}) >= 1e-12 FROM ("
        f"SELECT it, {', '.join(centres)}, {', '.join(mean(i) for i in range(k))} FROM (SELECT *, {pick('g')} FROM (SELECT kr.*, z, {to} FROM kr, zk WHERE moved AND it < {rounds})) GROUP BY it, {', '.join(centres)}))"
    )
    steps.append("kf AS MATERIALIZED (SELECT * FROM kr ORDER BY it DESC LIMIT 1)")
    rank = lambda i: " + ".join(f"(c{j}[1] < c{i}[1] OR c{j}[1] = c{i}[1] AND {j} < {i})::INT" for j in range(k) if j != i)
    risk = "CASE cluster " + " ".join(f"WHEN {i} THEN list_extract({list(RISKS)}, least({rank(i)}, 2) + 1)" for i in range(k)) + " END AS km_risk"
    steps.append(f"km AS MATERIALIZED (SELECT day, label, cluster, {risk} FROM (SELECT *, {pick('cluster')} FROM (SELECT zk.day AS day, zk.label AS label, kf.*, {to} FROM zk, kf)))")
    return ",\n".join(steps)


def dbscan(eps: float = 1.0, least: int = 10) -> str:
    """db: id, day, cluster, n_near, by all pairs of rows; dnear: the pairs."""
    d = " + ".join(f"(x.{c} - y.{c})**2" for c in "abcde")
    steps = [
        f"dnear AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM z x, z y WHERE sqrt({d}) <= {eps})",
        "deg AS MATERIALIZED (SELECT a AS id, count(*) AS n_near FROM dnear GROUP BY 1)",
        f"cores AS MATERIALIZED (SELECT id FROM deg WHERE n_near >= {least})",
        "links AS MATERIALIZED (SELECT a, b FROM dnear WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores))",
        "l0 AS MATERIALIZED (SELECT a AS id, min(b) AS root FROM links GROUP BY 1)",
    ]
    for i in range(SPREADS):
        steps.append(f"l{i + 1} AS MATERIALIZED (SELECT links.a AS id, min(up.root) AS root FROM links JOIN l{i} x ON x.id = links.b JOIN l{i} up ON up.id = x.root GROUP BY 1)")
    steps.append(f"named AS MATERIALIZED (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM l{SPREADS})")
    steps.append("beside AS (SELECT a AS id, min(cluster) AS cluster FROM dnear JOIN named ON named.id = b WHERE a NOT IN (SELECT id FROM cores) GROUP BY 1)")
    steps.append("db AS MATERIALIZED (SELECT z.id AS id, z.day AS day, CAST(coalesce(named.cluster, beside.cluster, -1) AS INTEGER) AS cluster, n_near FROM z JOIN deg ON deg.id = z.id LEFT JOIN named ON named.id = z.id LEFT JOIN beside ON beside.id = z.id)")
    return ",\n".join(steps)


def assessed() -> str:
    """assessed: a row per day with the results of all models, their vote and the travel time (from best, trav)."""
    p = ", ".join(f"max(e) FILTER (o = {i}) AS p_{r.lower()}" for i, r in enumerate(RISKS))
    bn = ", ".join(f"max(q) FILTER (risk = '{r}') AS bn_{r.lower()}" for r in RISKS)
    top = lambda pre: f"CASE WHEN {pre}_normal >= {pre}_erhoht AND {pre}_normal >= {pre}_gefahr THEN 'NORMAL' WHEN {pre}_erhoht >= {pre}_gefahr THEN 'ERHOHT' ELSE 'GEFAHR' END"
    votes = ", ".join(f"(bn_risk = '{r}')::INT * 3 + (nb_risk = '{r}')::INT * 2 + (km_risk = '{r}')::INT AS v{r[0].lower()}" for r in RISKS)
    said = " || ".join(f"CASE WHEN abs({a}) > 2 THEN chr(10) || printf('{c}: %.1f (z=%.1f)', {c}, abs({a})) ELSE '' END" for c, a in zip(FEATURES, "abcde"))
    return f"""nbp AS (SELECT day, {p} FROM (SELECT day, o, exp(j - max(j) OVER w) / sum(exp(j - m)) OVER w AS e FROM (SELECT *, max(j) OVER (PARTITION BY day, label) AS m FROM joint) WINDOW w AS (PARTITION BY day, label)) GROUP BY day),
bnp AS (SELECT day, {bn} FROM (SELECT day, risk, p / sum(p) OVER (PARTITION BY day) AS q FROM (SELECT b.day AS day, r.risk AS risk, sum(s.p * r.p) AS p FROM (SELECT DISTINCT day, rain, season, upstream FROM bins) b JOIN cpt_soil s ON s.rain = b.rain AND s.season = b.season JOIN cpt_risk r ON r.upstream = b.upstream AND r.soil = s.soil GROUP BY 1, 2)) GROUP BY day),
dvote AS (SELECT a AS id, cluster, count(*) AS n FROM dnear JOIN db ON db.id = b WHERE cluster >= 0 GROUP BY 1, 2),
dpick AS (SELECT id, arg_max(cluster, (n, -cluster)) AS dbscan_cluster FROM dvote GROUP BY 1),
travel AS (SELECT CASE WHEN n < 2 THEN 0 ELSE coalesce(s, 0) END AS slope, CASE WHEN n < 2 THEN best.lag ELSE t - coalesce(s, 0) * u END AS intercept FROM best, (SELECT count(*) AS n, regr_slope(travel, up) AS s, avg(travel) AS t, avg(up) AS u FROM trav)),
seen AS (SELECT z.day AS day, lp.upstream_max_cm AS upstream, km_risk, coalesce(dbscan_cluster, -1) AS dbscan_cluster, nullif(ltrim({said}, chr(10)), '') AS said, nbp.* EXCLUDE (day), bnp.* EXCLUDE (day), {top('p')} AS nb_risk, {top('bn')} AS bn_risk
  FROM z JOIN lp ON lp.day = z.day AND lp.label = z.label JOIN km ON km.day = z.day AND km.label = z.label LEFT JOIN dpick ON dpick.id = z.id JOIN nbp ON nbp.day = z.day JOIN bnp ON bnp.day = z.day QUALIFY row_number() OVER (PARTITION BY z.day ORDER BY z.id) = 1),
voted AS (SELECT *, dbscan_cluster = -1 AS is_anomaly, CASE WHEN vn >= ve AND vn >= vg THEN 'NORMAL' WHEN ve >= vg THEN 'ERHOHT' ELSE 'GEFAHR' END AS most FROM (SELECT *, {votes} FROM seen)),
assessed AS MATERIALIZED (SELECT *, CASE WHEN is_anomaly AND most = 'NORMAL' THEN 'ERHOHT' ELSE most END AS risk_level, bn_risk = nb_risk AND nb_risk = km_risk AND NOT is_anomaly AS high_confidence,
  greatest(1, least(48, slope * upstream + intercept)) AS travel_hours, CASE WHEN is_anomaly THEN coalesce(said, 'no single feature stands out') END AS anomaly_text FROM voted, travel)"""


def rounded_p() -> str:
    return ", ".join(f"round(p_{r.lower()}, 6) AS p_{r.lower()}" for r in RISKS)
