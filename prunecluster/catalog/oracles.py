"""SQL twins of the queries, written from the definitions (joins, sorts and window ranks)."""

from __future__ import annotations

SEED, K, DIMS = 7, 5, 4

POINTS = """pts AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS point_id,
         l_quantity AS x0, round(l_extendedprice / 1000) AS x1, round(l_discount * 100) AS x2, round(l_tax * 100) AS x3,
         l_quantity AS w
  FROM lineitem)"""

N = "(SELECT count(*) FROM lineitem)"
COUNTED = f"size AS (SELECT count(*)::DOUBLE AS n FROM lineitem)"


def u(salt: str, key: str = "point_id", part: int = 0) -> str:
    """Hashed uniform number of a row."""
    return (
        f"((('0x' || substr(md5('{SEED}:{salt}:' || {key}), {8 * part + 1}, 8))::BIGINT + 0.5::DOUBLE)"
        " / 4294967296.0::DOUBLE)"
    )


def d2(a: str = "p.x", b: str = "c.x") -> str:
    return "(" + " + ".join(f"({a}{j} - {b}{j}) * ({a}{j} - {b}{j})" for j in range(DIMS)) + ")"


def lowest(name: str, source: str, salt: str, k) -> str:
    """The k rows of source lowest by hash, with center_id 0, 1, ..."""
    return f"""{name} AS (
  SELECT * FROM (SELECT row_number() OVER (ORDER BY {u(salt)}, point_id) - 1 AS center_id, * FROM {source})
  WHERE center_id < {k})"""


def scored(name: str, points: str, centers: str) -> str:
    """Every point with the distance to its nearest centre."""
    return f"""{name} AS (
  SELECT p.point_id, any_value(p.w) AS w, min({d2()}) AS d2,
         any_value(p.x0) AS x0, any_value(p.x1) AS x1, any_value(p.x2) AS x2, any_value(p.x3) AS x3
  FROM {points} p CROSS JOIN {centers} c GROUP BY p.point_id)"""


def assigned(name: str, points: str, centers: str) -> str:
    """Every point with its nearest centre, the lowest id on a tie."""
    return f"""{name} AS (
  SELECT point_id, w, center_id, d2 FROM (
    SELECT p.point_id, p.w, c.center_id, {d2()} AS d2,
           row_number() OVER (PARTITION BY p.point_id ORDER BY {d2()}, c.center_id) AS place
    FROM {points} p CROSS JOIN {centers} c) WHERE place = 1)"""


def query(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def ln_ratio(k: str, other: str) -> str:
    return f"ln(1.1::DOUBLE * {k} / ({other}))"


def max_subset(n: str, k: str, e: str, d: str) -> str:
    return f"CAST(floor(36 * {k} * pow({n}, {e}) * {ln_ratio(k, d)}) AS BIGINT)"


def phi(alpha: str, k: str, e: str, d: str) -> str:
    return f"((6.5::DOUBLE / {alpha}) * {ln_ratio(k, f'{d} * {e}')})"


def outliers(alpha: str, k: str, phi_alpha: str) -> str:
    return f"CAST(floor(1.5::DOUBLE * {alpha} * ({k} + 1) * {phi_alpha}) AS BIGINT)"


D, E = "0.1::DOUBLE", "0.05::DOUBLE"
SUBSET = max_subset("n", "5", E, D)
KPLUS = f"CAST(floor(5 + 9 * {ln_ratio('5', f'{D} * {E}')}) AS BIGINT)"
SETTING = f"""setting AS (
  SELECT n, {SUBSET} AS subset, {KPLUS} AS kplus FROM size)"""


def exactly(salt: str, points: str, alpha: str) -> str:
    """The round(alpha * n) rows of ``points`` lowest by hash."""
    return f"""SELECT * EXCLUDE (hash_rank) FROM (
  SELECT *, row_number() OVER (ORDER BY {u(salt)}, point_id) AS hash_rank FROM {points})
  WHERE hash_rank <= round_even({alpha} * (SELECT count(*) FROM {points}), 0)"""


def one_round(no: int, survivors: str, psi_before: str, exact: bool = False) -> list[str]:
    """Samples, centres, threshold and survivors of round ``no``."""
    end = "" if no == 1 else f"r{no}"
    alpha = f"(SELECT alpha FROM rate{no})"

    def sample(salt):
        return exactly(salt + end, survivors, alpha) if exact else f"SELECT * FROM {survivors} WHERE {u(salt + end)} < {alpha}"

    return [
        f"rate{no} AS (SELECT (SELECT subset FROM setting)::DOUBLE / count(*) AS alpha, count(*) AS remaining FROM {survivors})",
        f"p1_{no} AS ({sample('p1')})",
        f"p2_{no} AS ({sample('p2')})",
        lowest(f"c_{no}", f"p1_{no}", "c", "(SELECT kplus FROM setting)"),
        scored(f"p2scored_{no}", f"p2_{no}", f"c_{no}"),
        f"plan{no} AS (SELECT alpha, {phi('alpha', '5', E, D)} AS phi FROM rate{no})",
        f"allow{no} AS (SELECT {outliers('alpha', '5', 'phi')} AS r FROM plan{no})",
        f"""cut{no} AS (SELECT coalesce(sum(d2), 0) AS truncated FROM (
  SELECT d2, row_number() OVER (ORDER BY d2 DESC) AS place FROM p2scored_{no}) WHERE place > (SELECT r FROM allow{no}))""",
        f"""psi{no} AS (SELECT greatest((2::DOUBLE / (3 * {alpha})) * truncated, {psi_before}) AS psi FROM cut{no})""",
        f"v{no} AS (SELECT (SELECT psi FROM psi{no}) / (5 * (SELECT phi FROM plan{no})) AS v)",
        scored(f"scored_{no}", survivors, f"c_{no}"),
        f"left_{no} AS (SELECT point_id, w, x0, x1, x2, x3, d2 FROM scored_{no} WHERE d2 > (SELECT v FROM v{no}))",
    ]


def round_row(no: int) -> str:
    return f"""SELECT {no}::INTEGER AS round, (SELECT remaining FROM rate{no}) AS remaining,
  (SELECT count(*) FROM p1_{no}) AS p1_rows, (SELECT count(*) FROM p2_{no}) AS p2_rows,
  (SELECT count(*) FROM c_{no})::INTEGER AS center_count, (SELECT r FROM allow{no}) AS r,
  round((SELECT v FROM v{no}), 6) AS v,
  (SELECT count(*) FROM scored_{no} WHERE d2 <= (SELECT v FROM v{no})) AS handled,
  (SELECT count(*) FROM left_{no}) AS survivors,
  CAST((SELECT truncated FROM cut{no}) AS BIGINT) AS truncated_risk,
  CAST((SELECT coalesce(sum(d2), 0) FROM scored_{no} WHERE d2 <= (SELECT v FROM v{no})) AS BIGINT) AS handled_risk"""


ROUND_1 = one_round(1, "pts", "0")
ROUND_2 = one_round(2, "left_1", "(SELECT psi FROM psi1)")
RUN = [POINTS, COUNTED, SETTING, *ROUND_1, *ROUND_2]
LAST = [
    f"""ordered AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN (SELECT count(*) FROM left_2) <= 5 THEN 0 ELSE {u('c')} END, point_id) AS place FROM left_2)""",
    "last AS (SELECT place, x0, x1, x2, x3 FROM ordered WHERE place <= 5)",
]
CANDIDATES = [
    """candidates AS (
  SELECT center_id::BIGINT AS center_id, x0, x1, x2, x3 FROM c_1 UNION ALL
  SELECT center_id + (SELECT count(*) FROM c_1), x0, x1, x2, x3 FROM c_2 UNION ALL
  SELECT place - 1 + (SELECT count(*) FROM c_1) + (SELECT count(*) FROM c_2), x0, x1, x2, x3 FROM last)""",
    assigned("served", "pts", "candidates"),
    """weighted AS (
  SELECT c.center_id, any_value(c.x0) AS x0, any_value(c.x1) AS x1, any_value(c.x2) AS x2, any_value(c.x3) AS x3,
         count(s.point_id) AS weight
  FROM candidates c LEFT JOIN served s ON s.center_id = c.center_id GROUP BY c.center_id)""",
]

BASE = [POINTS, lowest("cen", "pts", "c", K)]
SCORED = [*BASE, scored("scored", "pts", "cen")]


def tail(epsilon: str) -> str:
    return query(
        *BASE, COUNTED,
        f"h AS (SELECT * FROM pts WHERE {u('h')} < (SELECT 4 * pow(n, {epsilon}) * ln(n) / n FROM size))",
        scored("far", "h", "cen"),
        "ranked AS (SELECT d2, row_number() OVER (ORDER BY d2 DESC) AS place FROM far)",
        "rank AS (SELECT floor(8 * ln(n)) AS m FROM size)",
        select="""SELECT CAST(CASE WHEN (SELECT count(*) FROM far) >= (SELECT m FROM rank)
    THEN (SELECT d2 FROM ranked WHERE place = (SELECT m FROM rank)) ELSE (SELECT min(d2) FROM far) END AS BIGINT) AS d2,
  ((SELECT count(*) FROM far) >= (SELECT m FROM rank))::INTEGER AS long_enough""",
    )


PAIR_RATE = f"rate AS (SELECT {SUBSET} / n AS alpha FROM size)"

SETTINGS = f"""settings AS (
  SELECT l_suppkey, nullif(count(*), 1) AS n, max(l_linenumber) AS k, sum(l_quantity) AS cost, max(l_quantity) AS known,
         nullif(count(*) FILTER (l_returnflag <> 'R'), 0) AS remaining,
         CASE l_suppkey % 4 WHEN 0 THEN 0.01::DOUBLE WHEN 1 THEN 0.05::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END AS e
  FROM lineitem GROUP BY l_suppkey),
rates AS (SELECT *, {max_subset('n', 'k', 'e', D)} AS subset, {max_subset('n', 'k', 'e', D)}::DOUBLE / remaining AS alpha FROM settings),
phis AS (SELECT *, {phi('alpha', 'k', 'e', D)} AS phi FROM rates)"""

# sample and prune, first round, epsilon 0.1
PRUNE = [
    POINTS, COUNTED,
    "rates AS (SELECT 9 * 5 * pow(n, 0.1::DOUBLE) * ln(n) / n AS s, 4 * pow(n, 0.1::DOUBLE) * ln(n) / n AS h FROM size)",
    f"s AS (SELECT * FROM pts WHERE {u('s')} < (SELECT s FROM rates))",
    f"h AS (SELECT * FROM pts WHERE {u('h')} < (SELECT h FROM rates))",
    scored("far", "h", "s"),
    "ranked AS (SELECT d2, row_number() OVER (ORDER BY d2 DESC) AS place FROM far)",
    "rank AS (SELECT floor(8 * ln(n)) AS m FROM size)",
    """cutoff AS (SELECT (SELECT count(*) FROM far) >= (SELECT m FROM rank) AS long_enough,
  CASE WHEN (SELECT count(*) FROM far) >= (SELECT m FROM rank)
    THEN (SELECT d2 FROM ranked WHERE place = (SELECT m FROM rank)) ELSE (SELECT min(d2) FROM far) END AS v)""",
    scored("scored", "pts", "s"),
]


def draw(no: int, centers: str, k: int = 10) -> list[str]:
    """Rows drawn in step ``no`` of k-means||."""
    return [
        scored(f"far_{no}", "pts", centers),
        f"""draw_{no} AS (SELECT point_id, x0, x1, x2, x3, place FROM (
  SELECT *, row_number() OVER (ORDER BY -ln({u(f'draw{no}')}) / d2, point_id) AS place FROM far_{no} WHERE d2 > 0)
  WHERE place <= {k})""",
    ]


def prune_round(no: int, survivors: str, known: str, k: int = 1, epsilon: str = "0.2::DOUBLE") -> list[str]:
    """Round ``no`` of sample and prune; ``known`` is the distance so far."""
    end = "" if no == 1 else f"r{no}"
    power = f"pow((SELECT n FROM size), {epsilon}) * ln((SELECT n FROM size))"
    return [
        f"left{no} AS (SELECT count(*)::DOUBLE AS remaining FROM {survivors})",
        f"s{no} AS (SELECT * FROM {survivors} WHERE {u('s' + end)} < (SELECT 9 * {k} * {power} / remaining FROM left{no}))",
        f"h{no} AS (SELECT * FROM {survivors} WHERE {u('h' + end)} < (SELECT 4 * {power} / remaining FROM left{no}))",
        f"""scored{no} AS (SELECT p.point_id, any_value(p.w) AS w, least(min({d2()}), any_value({known})) AS d2,
  any_value(p.x0) AS x0, any_value(p.x1) AS x1, any_value(p.x2) AS x2, any_value(p.x3) AS x3
  FROM {survivors} p CROSS JOIN s{no} c GROUP BY p.point_id)""",
        f"ranked{no} AS (SELECT d2, row_number() OVER (ORDER BY d2 DESC) AS place FROM scored{no} SEMI JOIN h{no} USING (point_id))",
        f"""cutoff{no} AS (SELECT CASE WHEN count(*) >= floor(8 * ln((SELECT n FROM size)))
    THEN min(d2) FILTER (place <= floor(8 * ln((SELECT n FROM size)))) ELSE min(d2) END AS v FROM ranked{no})""",
        f"pruned{no} AS (SELECT * FROM scored{no} WHERE d2 > (SELECT v FROM cutoff{no}))",
    ]


def prune_row(no: int) -> str:
    return f"""SELECT {no}::INTEGER AS round, CAST((SELECT remaining FROM left{no}) AS BIGINT) AS remaining,
  (SELECT count(*) FROM s{no}) AS s_rows, (SELECT count(*) FROM h{no}) AS h_rows,
  ({' + '.join(f'(SELECT count(*) FROM s{i})' for i in range(1, no + 1))})::INTEGER AS sample_rows,
  CAST((SELECT v FROM cutoff{no}) AS BIGINT) AS v, (SELECT count(*) FROM pruned{no}) AS survivors,
  CAST((SELECT coalesce(sum(d2), 0) FROM scored{no} WHERE d2 <= (SELECT v FROM cutoff{no})) AS BIGINT) AS handled_risk,
  (SELECT count(*) FROM everyone) AS centers_in_all, CAST((SELECT sum(d2) FROM ended) AS BIGINT) AS risk"""


FIRST = f"first AS (SELECT point_id, x0, x1, x2, x3 FROM pts ORDER BY {u('first')}, point_id LIMIT 1)"

CENTER = "((('0x' || substr(md5('7:center:' || c.i || ':' || {j}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def gaussian_coordinate(j: int) -> str:
    salt, pair = f"noise{j // 4}", (j % 4) // 2
    wave = "sin" if j % 2 else "cos"
    radius = f"sqrt(-2.0::DOUBLE * ln({u(salt, 'c.o_orderkey', 2 * pair)}))"
    angle = f"(2 * pi() * {u(salt, 'c.o_orderkey', 2 * pair + 1)})"
    return f"round({CENTER.format(j=j)} + 0.001::DOUBLE * ({radius} * {wave}({angle})), 6) AS x{j}"


# the last step after one round
LAST_1 = [
    f"""ordered AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN (SELECT count(*) FROM left_1) <= 5 THEN 0 ELSE {u('c')} END, point_id) AS place FROM left_1)""",
    "last AS (SELECT place, x0, x1, x2, x3 FROM ordered WHERE place <= 5)",
]


def single_run(seed: int) -> str:
    """Metrics of a run of one round: samples drawn with ``seed``, centres taken by hash."""
    parts = query(
        POINTS, COUNTED, SETTING, *ROUND_1,
        # a table that is small enough from the start has no round
        "used AS (SELECT * FROM c_1 WHERE (SELECT n > subset FROM setting))",
        """ended_1 AS (SELECT point_id, x0, x1, x2, x3 FROM left_1 WHERE (SELECT n > subset FROM setting)
  UNION ALL SELECT point_id, x0, x1, x2, x3 FROM pts WHERE (SELECT n <= subset FROM setting))""",
        *[part.replace("left_1", "ended_1") for part in LAST_1],
        """candidates AS (
  SELECT center_id::BIGINT AS center_id, x0, x1, x2, x3 FROM used UNION ALL
  SELECT place - 1 + (SELECT count(*) FROM used), x0, x1, x2, x3 FROM last)""",
        *CANDIDATES[1:],
        """positive AS (SELECT center_id::VARCHAR AS point_id, w, x0, x1, x2, x3 FROM (
  SELECT row_number() OVER (ORDER BY center_id) - 1 AS center_id, weight AS w, x0, x1, x2, x3 FROM weighted WHERE weight > 0))""",
        lowest("final", "positive", "c", K),
        scored("ended", "pts", "final"),
        select="""SELECT (SELECT subset FROM setting)::DOUBLE AS coord_mem, (SELECT count(*) FROM candidates)::DOUBLE AS num_centers,
  (SELECT (n > subset)::INTEGER::DOUBLE FROM setting) AS iterations, (SELECT sum(d2) FROM ended) AS risk_final,
  ((SELECT remaining FROM rate1) * (SELECT count(*) FROM used))::DOUBLE AS comps""",
    )
    return parts.replace(f"md5('{SEED}:p", f"md5('{seed}:p")


def summary_sql() -> str:
    def stats(name, column):
        return f"round(avg({column}), 4) AS {name}_avg, round(stddev_samp({column}), 4) AS {name}_stdv"

    return f"""SELECT 'lineitem' AS dataset, 0::INTEGER AS steps, 'sampled_kmeans' AS algorithm, 5::INTEGER AS k, 0.05::DOUBLE AS epsilon,
  round(max(coord_mem), 4) AS coord_mem, {stats('num_centers', 'num_centers')}, {stats('rounds', 'iterations')},
  {stats('final_risk', 'risk_final')}, {stats('comps_tot', 'comps')}
FROM (SELECT * FROM ({single_run(SEED)}) UNION ALL SELECT * FROM ({single_run(SEED + 1)}))"""


ORDER_POINTS = """pts AS (
  SELECT o_orderkey::VARCHAR AS point_id, round(o_totalprice / 10000) AS x0, (o_custkey % 7)::DOUBLE AS x1,
         (o_custkey % 11)::DOUBLE AS x2, (o_custkey % 13)::DOUBLE AS x3, 1::DOUBLE AS w FROM orders)"""


def steps_sql(points: str, dataset: str, steps: int) -> str:
    """The summary of one k-means|| run of so many steps."""
    parts, before = [points, "size AS (SELECT count(*)::DOUBLE AS n FROM pts)", FIRST], "first"
    taken = ["SELECT 0::BIGINT AS center_id, x0, x1, x2, x3 FROM first"]
    for no in range(1, steps + 1):
        parts += draw(no, before)
        taken.append(f"SELECT place + {10 * (no - 1)}, x0, x1, x2, x3 FROM draw_{no}")
        before = f"after_{no}"
        parts.append(f"{before} AS ({' UNION ALL '.join(t.replace('0::BIGINT AS center_id', '0::BIGINT AS center_id') for t in taken)})")
    parts += [f"candidates AS (SELECT * FROM {before})", *CANDIDATES[1:]]
    parts.append("""positive AS (SELECT center_id::VARCHAR AS point_id, w, x0, x1, x2, x3 FROM (
  SELECT row_number() OVER (ORDER BY center_id) - 1 AS center_id, weight AS w, x0, x1, x2, x3 FROM weighted WHERE weight > 0))""")
    parts += [lowest("final", "positive", "c", K), scored("ended", "pts", "final")]
    work = sum(1 + 10 * no for no in range(steps))
    return query(*parts, select=f"""SELECT '{dataset}' AS dataset, {steps}::INTEGER AS steps, 'kmeans_parallel' AS algorithm, 5::INTEGER AS k,
  0.0::DOUBLE AS epsilon, (SELECT count(*) FROM candidates)::DOUBLE AS num_centers_avg,
  round((SELECT sum(d2) FROM ended), 4) AS final_risk_avg, (SELECT n FROM size) * {work} AS comps_tot_avg""")


SWEEP_TABLES = ((POINTS, "lineitem"), (ORDER_POINTS, "orders"))


def of_this_round(parts: list[str], most: str, *salts: str) -> str:
    """Steps of a first round over the rows ``survivors`` of ``run``, with the draws of whichever round it is.

    The first step counts the survivors; up to ``most`` of them there is no such round.
    """
    steps = ",\n".join([f"{parts[0][:-1]} HAVING count(*) > ({most}))", *parts[1:]])
    for salt in salts:
        steps = steps.replace(f"'{SEED}:{salt}:'", f"'{SEED}:{salt}' || CASE round WHEN 0 THEN '' ELSE 'r' || (round + 1) END || ':'")
    return steps


def sampled_sql(points: str, dataset: str, epsilon: str) -> str:
    """The summary of one sampled run, with as many rounds as it takes; each round adds its centres and survivors to ``run``."""
    row = "p.point_id, p.w, p.x0, p.x1, p.x2, p.x3, step.psi, step.remaining"
    run = query(
        points, f"size AS (SELECT count(*)::DOUBLE AS n FROM {dataset})", SETTING,
        f"""run AS (
  SELECT 0 AS round, NULL::BIGINT AS nth, point_id, w, x0, x1, x2, x3, 0::DOUBLE AS psi, 0::BIGINT AS remaining FROM pts
  UNION ALL (
    WITH survivors AS (SELECT * FROM run WHERE nth IS NULL),
    {of_this_round(one_round(1, "survivors", "(SELECT max(psi) FROM survivors)"), "SELECT subset FROM setting", "p1", "p2")},
    step AS (SELECT (SELECT max(round) + 1 FROM survivors) AS round, psi, remaining FROM psi1, rate1)
    SELECT step.round, center_id, {row} FROM step, c_1 p UNION ALL SELECT step.round, NULL, {row} FROM step, left_1 p))""",
        "ended_1 AS (SELECT * FROM run WHERE nth IS NULL AND round = (SELECT max(round) FROM run))",
        *[part.replace("left_1", "ended_1") for part in LAST_1],
        "used AS (SELECT row_number() OVER (ORDER BY round, nth) - 1 AS center_id, x0, x1, x2, x3, remaining FROM run WHERE nth IS NOT NULL)",
        """candidates AS (
  SELECT center_id, x0, x1, x2, x3 FROM used UNION ALL
  SELECT place - 1 + (SELECT count(*) FROM used), x0, x1, x2, x3 FROM last)""",
        *CANDIDATES[1:],
        """positive AS (SELECT center_id::VARCHAR AS point_id, w, x0, x1, x2, x3 FROM (
  SELECT row_number() OVER (ORDER BY center_id) - 1 AS center_id, weight AS w, x0, x1, x2, x3 FROM weighted WHERE weight > 0))""",
        lowest("final", "positive", "c", K), scored("ended", "pts", "final"),
        select=f"""SELECT '{dataset}' AS dataset, 0::INTEGER AS steps, 'sampled_kmeans' AS algorithm, 5::INTEGER AS k, {epsilon}::DOUBLE AS epsilon,
  (SELECT count(*) FROM candidates)::DOUBLE AS num_centers_avg, round((SELECT sum(d2) FROM ended), 4) AS final_risk_avg,
  (SELECT coalesce(sum(remaining), 0) FROM used)::DOUBLE AS comps_tot_avg""",
    )
    return run.replace("WITH", "WITH RECURSIVE", 1).replace(E, f"{epsilon}::DOUBLE")


def pruned_sql(points: str, dataset: str, epsilon: str) -> str:
    """The summary of one run of sample and prune down to its stop size; each round adds its sample and survivors to ``run``."""
    near = f"""SELECT p.point_id, arg_min(c.center_id, ({d2()}, c.center_id)) AS center_id
  FROM pts p CROSS JOIN candidates c GROUP BY p.point_id"""
    row = "p.point_id, p.w, p.x0, p.x1, p.x2, p.x3, p.d2, step.remaining"
    run = query(
        points, f"size AS (SELECT count(*)::DOUBLE AS n FROM {dataset})",
        f"stop AS (SELECT (4 / {epsilon}::DOUBLE) * 5 * pow(n, {epsilon}::DOUBLE) * ln(n) AS most FROM size)",
        f"""run AS (
  SELECT 0 AS round, false AS drawn, point_id, w, x0, x1, x2, x3, NULL::DOUBLE AS d2, 0::DOUBLE AS remaining FROM pts
  UNION ALL (
    WITH survivors AS (SELECT * FROM run WHERE NOT drawn),
    {of_this_round(prune_round(1, "survivors", "p.d2", K, f"{epsilon}::DOUBLE"), "SELECT most FROM stop", "s", "h")},
    step AS (SELECT (SELECT max(round) + 1 FROM survivors) AS round, remaining FROM left1)
    SELECT step.round, true, {row} FROM step, s1 p UNION ALL SELECT step.round, false, {row} FROM step, pruned1 p))""",
        # survivors of the last round join the samples of all
        """candidates AS (SELECT point_id AS center_id, x0, x1, x2, x3 FROM run
  WHERE drawn OR round = (SELECT max(round) FROM run))""",
        f"served AS ({near})",
        """positive AS (SELECT c.center_id AS point_id, 1::DOUBLE AS w, any_value(c.x0) AS x0, any_value(c.x1) AS x1, any_value(c.x2) AS x2, any_value(c.x3) AS x3
  FROM candidates c JOIN served s ON s.center_id = c.center_id GROUP BY c.center_id)""",
        lowest("final", "positive", "c", K), scored("ended", "pts", "final"),
        select=f"""SELECT '{dataset}' AS dataset, 0::INTEGER AS steps, 'sample_prune' AS algorithm, 5::INTEGER AS k, {epsilon}::DOUBLE AS epsilon,
  (SELECT count(*) FROM candidates)::DOUBLE AS num_centers_avg, round((SELECT sum(d2) FROM ended), 4) AS final_risk_avg,
  (SELECT coalesce(sum(s.remaining), 0) FROM run s WHERE s.drawn) AS comps_tot_avg""",
    )
    return run.replace("WITH", "WITH RECURSIVE", 1)


def sweep_sql() -> str:
    runs = [steps_sql(p, d, n) for p, d in SWEEP_TABLES for n in (1, 2)]
    for way in (sampled_sql, pruned_sql):
        runs += [way(p, d, e) for p, d in SWEEP_TABLES for e in ("0.1", "0.2")]
    return "\nUNION ALL\n".join(f"SELECT * FROM ({r})" for r in runs)


def restart_sql() -> str:
    runs = [steps_sql(p, d, n) for p, d in SWEEP_TABLES for n in (1, 2)]
    return "SELECT *, 1::BIGINT AS runs FROM (" + "\nUNION ALL\n".join(f"SELECT * FROM ({r})" for r in runs) + ")"


SEPARATED = """SELECT count(*) AS size, round(avg(substr(o_orderpriority, 1, 1)::INTEGER * 10000), 6) AS x0,
  round(avg(pow(substr(o_orderpriority, 1, 1)::INTEGER, 2) * 10000), 6) AS x1, round(avg(round(o_totalprice / 10000)), 6) AS x2,
  round(avg(o_custkey % 11), 6) AS x3, 5::INTEGER AS k
FROM orders GROUP BY o_orderpriority"""


NULLS = """joined AS (
  SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)"""

VECTORS = """vec AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS x FROM embeddings)"""


def vector_twin(distance: str, name: str) -> str:
    return query(
        VECTORS,
        f"""cen AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY {u('c')}, point_id) - 1 AS center_id, x FROM vec)
  WHERE center_id < 10)""",
        select=f"""SELECT point_id, center_id::INTEGER AS center_id, round(d, 6) AS {name} FROM (
  SELECT v.point_id, c.center_id, {distance} AS d,
         row_number() OVER (PARTITION BY v.point_id ORDER BY {distance}, c.center_id) AS place
  FROM vec v CROSS JOIN cen c) WHERE place = 1""",
    )


def columns(prefix: str = "c", source: str = "x") -> str:
    return ", ".join(f"{source}{j} AS {prefix}{j}" for j in range(DIMS))


def sparse_items() -> list[str]:
    """Line items against the ten lowest by hash; unlike levels of a column are two coordinates apart by 1 each."""
    d = """(p.q - c.q) * (p.q - c.q) + 2 * ((p.l_orderkey <> c.l_orderkey)::INTEGER + (p.l_partkey <> c.l_partkey)::INTEGER
    + (p.l_suppkey <> c.l_suppkey)::INTEGER)"""
    return [
        """pts AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS point_id,
  l_quantity AS q, l_orderkey, l_partkey, l_suppkey FROM lineitem)""",
        lowest("cen", "pts", "c", 10),
        f"""near AS (SELECT * FROM (SELECT p.point_id, c.center_id, {d} AS d2,
  row_number() OVER (PARTITION BY p.point_id ORDER BY {d}, c.center_id) AS place FROM pts p CROSS JOIN cen c) WHERE place = 1)""",
    ]


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
STATUSES = ["F", "O", "P"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def dummies(column: str, levels: list[str]) -> str:
    return ", ".join(f"({column} = '{v}')::INTEGER AS \"{column}_{v}\"" for v in levels)


ORACLES = {
    "csv_points": "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL",
    "preset_points": f"""SELECT o_custkey, o_totalprice, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS o_orderdate, {dummies('o_orderstatus', STATUSES)}, {dummies('o_orderpriority', PRIORITIES)}
FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL""",
    "csv_skip_line": "SELECT c_custkey, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer",
    "csv_first_rows": """SELECT c_custkey, c_name, c_mktsegment FROM customer
ORDER BY c_custkey LIMIT (SELECT count(*) // 2 FROM customer)""",
    "csv_limit": f"""WITH c AS (SELECT * FROM customer ORDER BY c_custkey LIMIT (SELECT count(*) // 2 FROM customer)),
kept AS (SELECT * FROM c WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL),
r AS (SELECT min(c_nationkey)::DOUBLE AS n0, max(c_nationkey)::DOUBLE AS n1, min(c_acctbal) AS a0, max(c_acctbal) AS a1 FROM kept)
SELECT c_custkey, round((c_nationkey - n0) / (n1 - n0), 9) AS c_nationkey, round((c_acctbal - a0) / (a1 - a0), 9) AS c_acctbal,
  {dummies('c_mktsegment', SEGMENTS)} FROM kept, r""",
    "libsvm_points": "SELECT p_partkey, p_size::DOUBLE AS x0, p_retailprice AS x1 FROM part",
    "gaussian_sizes": """WITH seg AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
ranks AS (SELECT unnest(range(1, 26)) AS i), total AS (SELECT sum(pow(i, 1.5::DOUBLE)) AS t FROM ranks)
SELECT l_returnflag, l_linestatus, i::INTEGER AS cluster, CAST(floor(n * (pow(i, 1.5::DOUBLE) / t)) AS BIGINT) AS size
FROM seg, ranks, total""",
    "gaussian_points": query(
        "size AS (SELECT count(*) AS n FROM orders)", "ks AS (SELECT count(*) AS k FROM nation)",
        "ranks AS (SELECT i FROM ks, unnest(range(1, k + 1)) AS t(i))",
        "total AS (SELECT sum(pow(i, 1.5::DOUBLE)) AS t FROM ranks)",
        "sizes AS (SELECT i, floor(n * (pow(i, 1.5::DOUBLE) / t)) AS s FROM ranks, total, size)",
        "uppers AS (SELECT i - 1 AS i, sum(s) OVER (ORDER BY i) - s AS lower, sum(s) OVER (ORDER BY i) AS upper FROM sizes)",
        "located AS (SELECT o_orderkey, i FROM orders JOIN uppers ON o_orderkey >= lower AND o_orderkey < upper)",
        select="SELECT o_orderkey AS point_id, c.i::INTEGER AS cluster, "
        + ", ".join(gaussian_coordinate(j) for j in range(DIMS)) + " FROM located c",
    ),
    "run_results": query(
        *RUN, *LAST, *CANDIDATES,
        f"""positive AS (SELECT center_id::VARCHAR AS point_id, w, x0, x1, x2, x3 FROM (
  SELECT row_number() OVER (ORDER BY center_id) - 1 AS center_id, weight AS w, x0, x1, x2, x3 FROM weighted WHERE weight > 0))""",
        lowest("final", "positive", "c", K),
        scored("ended", "pts", "final"),
        select="""SELECT 'sampled_kmeans_round_0' AS test_name, 5::INTEGER AS k, 0.1::DOUBLE AS dt, 1::INTEGER AS m,
  0.05::DOUBLE AS ep, -1::INTEGER AS l, (SELECT count(*) FROM candidates)::INTEGER AS num_centers, 2::INTEGER AS iterations,
  CAST((SELECT sum(d2) FROM served) AS BIGINT) AS risk, CAST((SELECT sum(d2) FROM ended) AS BIGINT) AS risk_final""",
    ),
    "run_summary": summary_sql(),
    "shared_summary": summary_sql(),
    "sweep_summary": sweep_sql(),
    "sweep_restart": restart_sql(),
    "numeric_projection": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "drop_nulls": query(NULLS, select="SELECT * FROM joined WHERE l_linenumber IS NOT NULL AND l_quantity IS NOT NULL AND o_orderstatus IS NOT NULL"),
    "one_hot": f"SELECT event_id, {dummies('event_type', EVENT_TYPES)} FROM events",
    "one_hot_sparse": "SELECT o_orderkey, row_number() OVER (ORDER BY 'order ' || o_orderkey) - 1 AS name_index FROM orders",
    "drop_index_column": "SELECT p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "min_max_scale": """WITH r AS (SELECT min(c_nationkey)::DOUBLE AS n0, max(c_nationkey)::DOUBLE AS n1, min(c_acctbal) AS a0, max(c_acctbal) AS a1 FROM customer)
SELECT c_custkey, round((c_nationkey::DOUBLE - n0) / (n1 - n0), 9) AS c_nationkey, round((c_acctbal - a0) / (a1 - a0), 9) AS c_acctbal,
  0.0::DOUBLE AS same FROM customer, r""",
    "min_max_scale_nan": """WITH r AS (SELECT min(c_acctbal) AS a0, max(c_acctbal) AS a1 FROM customer WHERE c_acctbal >= 0)
SELECT c_custkey, (c_acctbal < 0)::INTEGER AS missing,
  CASE WHEN c_acctbal < 0 THEN -1.0::DOUBLE ELSE round((c_acctbal - a0) / (a1 - a0), 9) END AS balance FROM customer, r""",
    "constant_scale": """SELECT vec_id, (i - 1)::INTEGER AS position, round(embedding[i]::DOUBLE / 255, 9) AS value
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
    "assemble_vector": """SELECT p_partkey, 0::INTEGER AS position, p_size::DOUBLE AS value FROM part
UNION ALL SELECT p_partkey, 1::INTEGER, p_retailprice FROM part""",
    "profile_points": query(NULLS, select="""SELECT 'raw' AS stage, count(*) AS row_count, 4::INTEGER AS column_count, 'long,string,integer,double' AS column_types FROM joined
UNION ALL SELECT 'numeric', count(*), 3::INTEGER, 'long,integer,double' FROM joined
UNION ALL SELECT 'clean', count(*), 3::INTEGER, 'long,integer,double' FROM joined WHERE l_linenumber IS NOT NULL AND l_quantity IS NOT NULL"""),
    "survivors": query(*SCORED, select="SELECT point_id, CAST(d2 AS BIGINT) AS d2 FROM scored WHERE d2 > 100"),
    "ene_survivors": query(*PRUNE, select="SELECT point_id, CAST(d2 AS BIGINT) AS d2 FROM scored WHERE d2 > (SELECT v FROM cutoff)"),
    "paired_sample": query(
        POINTS, COUNTED, PAIR_RATE,
        select=f"""SELECT * FROM (SELECT point_id, ({u('p1')} < alpha)::INTEGER AS p1, ({u('p2')} < alpha)::INTEGER AS p2 FROM pts, rate)
WHERE p1 = 1 OR p2 = 1""",
    ),
    "paired_sample_disjoint": query(
        POINTS, COUNTED, PAIR_RATE,
        select=f"""SELECT point_id, ({u('p1')} < alpha)::INTEGER AS p1, ({u('p1')} >= alpha)::INTEGER AS p2
FROM pts, (SELECT least(alpha, 0.5) AS alpha FROM rate) WHERE {u('p1')} < 2 * alpha""",
    ),
    "exact_sample": query(
        POINTS, COUNTED, PAIR_RATE, f"a AS ({exactly('p1', 'pts', '(SELECT alpha FROM rate)')})",
        f"b AS ({exactly('p2', 'pts', '(SELECT alpha FROM rate)')})",
        select="""SELECT coalesce(a.point_id, b.point_id) AS point_id, (a.point_id IS NOT NULL)::INTEGER AS p1, (b.point_id IS NOT NULL)::INTEGER AS p2
FROM a FULL JOIN b ON a.point_id = b.point_id""",
    ),
    "exact_rounds": query(
        POINTS, COUNTED, SETTING, *one_round(1, "pts", "0", True), *one_round(2, "left_1", "(SELECT psi FROM psi1)", True),
        select=f"{round_row(1)}\nUNION ALL\n{round_row(2)}",
    ),
    "ene_sample": query(
        *PRUNE[:3],
        select=f"""SELECT * FROM (SELECT point_id, ({u('s')} < s)::INTEGER AS s, ({u('h')} < h)::INTEGER AS h FROM pts, rates)
WHERE s = 1 OR h = 1""",
    ),
    "first_center": query(POINTS, FIRST, select="SELECT * FROM first"),
    "weighted_sample": query(
        *SCORED,
        select=f"SELECT point_id, CAST(d2 AS BIGINT) AS d2 FROM scored WHERE d2 > 0 ORDER BY -ln({u('draw')}) / d2, point_id LIMIT 10",
    ),
    "squared_distance": query(
        *BASE,
        select="SELECT p.point_id, "
        + ", ".join(f"CAST(max({d2()}) FILTER (c.center_id = {i}) AS BIGINT) AS d2_{i}" for i in range(K))
        + " FROM pts p CROSS JOIN cen c GROUP BY p.point_id",
    ),
    "nearest_distance": query(*SCORED, select="SELECT point_id, CAST(d2 AS BIGINT) AS d2 FROM scored"),
    "assign_nearest": query(*BASE, assigned("a", "pts", "cen"), select="SELECT point_id, center_id::INTEGER AS center_id FROM a"),
    "incremental_distance": query(*SCORED, select="SELECT point_id, CAST(d2 AS BIGINT) AS d2 FROM scored"),
    "nearest_cosine": vector_twin(
        "(1 - list_dot_product(v.x, c.x) / (sqrt(list_dot_product(v.x, v.x)) * sqrt(list_dot_product(c.x, c.x))))", "distance"
    ),
    "nearest_vectors": vector_twin("(SELECT sum((v.x[i] - c.x[i]) * (v.x[i] - c.x[i])) FROM unnest(range(1, len(v.x) + 1)) AS t(i))", "d2"),
    "predict": query(*BASE, assigned("a", "pts", "cen"), select="SELECT point_id, center_id::INTEGER AS prediction FROM a"),
    "predict_cosine": vector_twin(
        "(1 - list_dot_product(v.x, c.x) / (sqrt(list_dot_product(v.x, v.x)) * sqrt(list_dot_product(c.x, c.x))))", "distance"
    ).replace("center_id::INTEGER AS center_id, round(d, 6) AS distance FROM", "center_id::INTEGER AS prediction FROM"),
    "model_round_trip": query(
        *BASE, assigned("a", "pts", "cen"), select="SELECT center_id::INTEGER AS prediction, count(*) AS size FROM a GROUP BY center_id"
    ),
    "scored_schema": f"""SELECT 0::INTEGER AS position, 'point_id' AS field, 'string' AS kind, {N} AS filled
UNION ALL SELECT 1::INTEGER, 'features', 'array<double>', {N} UNION ALL SELECT 2::INTEGER, 'prediction', 'int', {N}""",
    "parameter_errors": """SELECT k, epsilon, CASE WHEN k < 1 THEN 'k' WHEN epsilon <= 0 OR epsilon >= 1 THEN 'epsilon' ELSE '' END AS refused
FROM (SELECT DISTINCT (l_linenumber - 2)::INTEGER AS k, round(l_discount * 10, 1) AS epsilon FROM lineitem)""",
    "weights_in_blocks": query(
        POINTS, lowest("cen", "pts", "c", 20), assigned("a", "pts", "cen"),
        select="SELECT c.center_id::INTEGER AS center_id, count(a.point_id) AS weight FROM cen c LEFT JOIN a ON a.center_id = c.center_id GROUP BY c.center_id",
    ),
    "costs_in_blocks": query(
        POINTS, lowest("cen", "pts", "c", 20),
        "near AS (SELECT " + ", ".join(f"min({d2()}) FILTER (c.center_id < {k}) AS d{k}" for k in (5, 10, 20)) + " FROM pts p CROSS JOIN cen c GROUP BY p.point_id)",
        select=" UNION ALL ".join(f"SELECT {k}::INTEGER AS k, CAST(sum(d{k}) AS BIGINT) AS cost FROM near" for k in (5, 10, 20)),
    ),
    **dict.fromkeys(
        ["sampled_kmeans", "sampled_kmeans_parallel_inner", "inner_kmeans", "weighted_reduce", "plain_kmeans", "kmeans_parallel", "ene_clustering"],
        SEPARATED,
    ),
    "ene_to_stop_size": "SELECT round((4 / 0.2::DOUBLE) * pow(count(*), 0.2::DOUBLE) * ln(count(*)), 6) AS stop_size, 1::INTEGER AS reached, 0::INTEGER AS capped FROM lineitem",
    "compare_runs": query(
        *SCORED, "bound AS (SELECT CAST(sum(d2) AS BIGINT) AS bound FROM scored)",
        select="""SELECT 'lineitem' AS dataset, algorithm, round::INTEGER AS round, 5::INTEGER AS k, 1::INTEGER AS enough, drawn::BIGINT AS drawn, bound,
  1::INTEGER AS below, 1::INTEGER AS candidates_cheaper
FROM bound, (VALUES ('sampled_kmeans', 0), ('kmeans_parallel', 1 + 10 * 5), ('sample_prune', 0)) a(algorithm, drawn), (VALUES (0), (1)) r(round)""",
    ),
    "compare_estimators": query(
        *SCORED,
        select="""SELECT estimator, 5::INTEGER AS num_centers, CAST(sum(d2) AS BIGINT) AS bound, 1::INTEGER AS below
FROM scored, (VALUES ('sampled'), ('plain')) e(estimator) GROUP BY estimator""",
    ),
    "sparse_nearest": query(
        *sparse_items(), select="SELECT point_id, center_id::INTEGER AS center_id, d2::BIGINT AS d2, 4::INTEGER AS entries FROM near",
    ),
    "sparse_risk": query(
        *sparse_items(),
        select="""SELECT CAST((SELECT sum(d2) FROM near) AS BIGINT) AS risk,
  CAST((SELECT sum(d2) FROM (SELECT d2, row_number() OVER (ORDER BY d2 DESC) AS place FROM near) WHERE place > 409) AS BIGINT) AS truncated_risk,
  (1 + count(DISTINCT l_orderkey) + count(DISTINCT l_partkey) + count(DISTINCT l_suppkey))::INTEGER AS dims FROM lineitem""",
    ),
    "sparse_weights": query(
        *sparse_items(),
        select="""SELECT c.center_id::INTEGER AS center_id, count(a.point_id) AS weight, CAST(coalesce(sum(a.d2), 0) AS BIGINT) AS cost
FROM cen c LEFT JOIN near a ON a.center_id = c.center_id GROUP BY c.center_id""",
    ),
    "sparse_libsvm": """SELECT p_partkey, 0::INTEGER AS position, p_size::DOUBLE AS value FROM part WHERE p_size <> 0
UNION ALL SELECT p_partkey, 2::INTEGER, p_retailprice FROM part WHERE p_retailprice <> 0""",
    "sparse_clustering": """SELECT count(*) AS size, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS low,
  (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS high FROM orders GROUP BY o_orderpriority""",
    "risk": query(*SCORED, select="SELECT CAST(sum(d2) AS BIGINT) AS risk FROM scored"),
    "truncated_risk": query(
        *SCORED,
        select="""SELECT CAST(coalesce(sum(d2), 0) AS BIGINT) AS truncated_risk
FROM (SELECT d2, row_number() OVER (ORDER BY d2 DESC) AS place FROM scored) WHERE place > 409""",
    ),
    "truncated_risk_half": query(
        *SCORED, f"half AS (SELECT {N} // 2 AS r)",
        select="""SELECT (SELECT r FROM half) AS r, CAST(sum(d2) AS BIGINT) AS truncated_risk, CAST(sum(d2 * w) AS BIGINT) AS weighted
FROM (SELECT d2, w, row_number() OVER (ORDER BY d2 DESC, w DESC) AS place FROM scored) WHERE place > (SELECT r FROM half)""",
    ),
    "truncated_risk_trivial": query(
        *SCORED, COUNTED,
        f"allow AS (SELECT {outliers('1.0::DOUBLE', 'n', phi('1.0::DOUBLE', 'n', E, D))} AS r FROM size)",
        select="""SELECT (SELECT r FROM allow) AS r, CAST(coalesce(sum(d2), 0) AS BIGINT) AS truncated_risk
FROM (SELECT d2, row_number() OVER (ORDER BY d2 DESC) AS place FROM scored) WHERE place > (SELECT r FROM allow)""",
    ),
    "center_weights": query(
        POINTS, lowest("cen", "pts", "c", 20), assigned("a", "pts", "cen"),
        select="""SELECT c.center_id::INTEGER AS center_id, count(a.point_id) AS weight, CAST(coalesce(sum(a.d2), 0) AS BIGINT) AS cost
FROM cen c LEFT JOIN a ON a.center_id = c.center_id GROUP BY c.center_id""",
    ),
    "weighted_costs": query(
        *SCORED,
        select="""SELECT CAST(sum(w) AS BIGINT) AS weight, CAST(sum(d2 * w) AS BIGINT) AS risk,
  CAST(sum(d2 * w) FILTER (place > 409) AS BIGINT) AS truncated_risk
FROM (SELECT d2, w, row_number() OVER (ORDER BY d2 DESC, w DESC) AS place FROM scored)""",
    ),
    "handled_risk": query(*SCORED, select="SELECT count(*) AS handled, CAST(sum(d2) AS BIGINT) AS handled_risk FROM scored WHERE d2 <= 100"),
    "tail_select": tail("0.2::DOUBLE"),
    "tail_select_short": tail("0.01::DOUBLE"),
    "remaining_count": query(*SCORED, select="SELECT count(*) AS remaining FROM scored WHERE d2 > 100"),
    "cluster_summary": query(
        *BASE, assigned("a", "pts", "cen"),
        select="SELECT center_id::INTEGER AS prediction, count(*) AS size, CAST(sum(d2) AS BIGINT) AS cost, 5::INTEGER AS k FROM a GROUP BY center_id",
    ),
    "comparison_counts": query(
        *RUN,
        *[f"""most{i} AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM {t}
  GROUP BY floor((('0x' || substr(md5('0:machine:' || point_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE * 50)))"""
          for i, t in ((1, "pts"), (2, "left_1"))],
        select=f"""SELECT 'sampled_kmeans' AS algorithm, CAST((SELECT remaining FROM rate1) * (SELECT count(*) FROM c_1)
    + (SELECT remaining FROM rate2) * (SELECT count(*) FROM c_2) AS BIGINT) AS total_comps,
  CAST((SELECT n FROM most1) * (SELECT count(*) FROM c_1) + (SELECT n FROM most2) * (SELECT count(*) FROM c_2) AS BIGINT) AS comps_per_machine
UNION ALL SELECT 'kmeans_parallel', CAST(4 * ({N} // 4 + {N} * 11 // 4 + {N} * 21 // 4) AS BIGINT),
  CAST({N} // 4 + {N} * 11 // 4 + {N} * 21 // 4 AS BIGINT)""",
    ),
    "union_centers": query(
        *BASE, lowest("more", "pts", "c2", K),
        select=f"""SELECT center_id::INTEGER AS center_id, {columns()} FROM cen
UNION ALL SELECT (center_id + 5)::INTEGER, x0, x1, x2, x3 FROM more""",
    ),
    "plan_parameters": query(
        SETTINGS,
        select=f"""SELECT l_suppkey, n, k, remaining, CAST(floor(k + 9 * {ln_ratio('k', f'{D} * e')}) AS BIGINT) AS kplus,
  subset AS max_subset, round(alpha, 6) AS alpha, round(phi, 6) AS phi_alpha, {outliers('alpha', 'k', 'phi')} AS r,
  CAST(2 * k AS BIGINT) AS l FROM phis""",
    ),
    "threshold": query(
        SETTINGS,
        "psis AS (SELECT *, greatest((2::DOUBLE / (3 * alpha)) * cost, known) AS psi FROM phis)",
        select="SELECT l_suppkey, round(psi, 6) AS psi, round(psi / (k * phi), 6) AS v FROM psis",
    ),
    "ene_parameters": query(
        SETTINGS,
        select="""SELECT l_suppkey, round(9 * k * pow(n, e) * ln(n) / remaining, 6) AS alpha_s,
  round(4 * pow(n, e) * ln(n) / remaining, 6) AS alpha_h, round((4 / e) * k * pow(n, e) * ln(n), 6) AS max_subset,
  CAST(floor(8 * ln(n)) AS BIGINT) AS tail_rank FROM settings""",
    ),
    "estimate_step": query(
        POINTS, COUNTED, SETTING, *ROUND_1[:-2],
        select="""SELECT (SELECT count(*) FROM c_1)::INTEGER AS center_count, (SELECT r FROM allow1) AS r,
  CAST((SELECT truncated FROM cut1) AS BIGINT) AS truncated_risk, round((SELECT psi FROM psi1), 6) AS psi,
  round((SELECT v FROM v1), 6) AS v""",
    ),
    "one_round": query(POINTS, COUNTED, SETTING, *ROUND_1, select=round_row(1)),
    "two_rounds": query(*RUN, select=f"{round_row(1)}\nUNION ALL\n{round_row(2)}"),
    "candidate_weights": query(
        *RUN, *LAST, *CANDIDATES, select=f"SELECT center_id::INTEGER AS center_id, weight, {columns()} FROM weighted"
    ),
    "last_step_small": query(*RUN, *LAST, select=f"SELECT {columns()} FROM last"),
    "last_step_large": query(
        POINTS, COUNTED, SETTING, *ROUND_1, *LAST_1,
        select=f"SELECT {columns()}, ((SELECT count(*) FROM left_1) > 5)::INTEGER AS many FROM last",
    ),
    "kmeans_parallel_step": query(
        POINTS, FIRST, *draw(1, "first"),
        "after AS (SELECT x0, x1, x2, x3 FROM first UNION ALL SELECT x0, x1, x2, x3 FROM draw_1)", *draw(2, "after"),
        select="""SELECT 0::INTEGER AS step, point_id FROM first UNION ALL SELECT 1::INTEGER, point_id FROM draw_1
UNION ALL SELECT 2::INTEGER, point_id FROM draw_2""",
    ),
    "ene_two_rounds": query(
        POINTS, COUNTED, *prune_round(1, "pts", "NULL::DOUBLE"), *prune_round(2, "pruned1", "p.d2"),
        """everyone AS (SELECT x0, x1, x2, x3 FROM s1 UNION ALL SELECT x0, x1, x2, x3 FROM s2
  UNION ALL SELECT x0, x1, x2, x3 FROM pruned2)""",
        scored("ended", "pts", "everyone"),
        select=f"{prune_row(1)}\nUNION ALL\n{prune_row(2)}",
    ),
    "kmeans_parallel_carried": query(
        POINTS, FIRST, *draw(1, "first"),
        "after_1 AS (SELECT x0, x1, x2, x3 FROM first UNION ALL SELECT x0, x1, x2, x3 FROM draw_1)", *draw(2, "after_1"),
        "after_2 AS (SELECT * FROM after_1 UNION ALL SELECT x0, x1, x2, x3 FROM draw_2)", *draw(3, "after_2"),
        """candidates AS (SELECT 0 AS center_id, x0, x1, x2, x3 FROM first
  UNION ALL SELECT place, x0, x1, x2, x3 FROM draw_1
  UNION ALL SELECT place + (SELECT count(*) FROM draw_1), x0, x1, x2, x3 FROM draw_2
  UNION ALL SELECT place + (SELECT count(*) FROM draw_1) + (SELECT count(*) FROM draw_2), x0, x1, x2, x3 FROM draw_3)""",
        *CANDIDATES[1:],
        select=f"""SELECT center_id::INTEGER AS center_id, weight, {columns()},
  (SELECT CAST(sum(d2) AS BIGINT) FROM served) AS risk, CAST(4 * ({N} // 4 + 2 * ({N} * 10 // 4)) AS BIGINT) AS total_comps FROM weighted""",
    ),
    "kmeans_parallel_weights": query(
        POINTS, FIRST, *draw(1, "first"),
        "after AS (SELECT x0, x1, x2, x3 FROM first UNION ALL SELECT x0, x1, x2, x3 FROM draw_1)", *draw(2, "after"),
        """candidates AS (SELECT 0 AS center_id, x0, x1, x2, x3 FROM first
  UNION ALL SELECT place, x0, x1, x2, x3 FROM draw_1
  UNION ALL SELECT place + (SELECT count(*) FROM draw_1), x0, x1, x2, x3 FROM draw_2)""",
        *CANDIDATES[1:],
        select=f"SELECT center_id::INTEGER AS center_id, weight, {columns()} FROM weighted",
    ),
    "ene_round": query(
        *PRUNE,
        select="""SELECT (SELECT count(*) FROM s) AS s_rows, (SELECT count(*) FROM h) AS h_rows,
  (SELECT long_enough FROM cutoff)::INTEGER AS long_enough, CAST((SELECT v FROM cutoff) AS BIGINT) AS v,
  (SELECT count(*) FROM scored WHERE d2 > (SELECT v FROM cutoff)) AS survivors,
  CAST((SELECT coalesce(sum(d2), 0) FROM scored WHERE d2 <= (SELECT v FROM cutoff)) AS BIGINT) AS handled_risk""",
    ),
    "sweep_plan": """WITH data AS (
  SELECT DISTINCT CASE WHEN p_type = 'ECONOMY' THEN 'gaussian_' || p_size ELSE concat_ws('/', p_brand, p_type) END AS dataset,
         CASE WHEN p_type = 'ECONOMY' THEN [p_size] ELSE [25, 50, 100, 200] END AS ks FROM part),
ks AS (SELECT dataset, unnest(ks)::INTEGER AS k FROM data),
grid AS (SELECT algorithm, dataset, k, epsilon FROM ks, (VALUES ('sampled_kmeans'), ('sample_prune')) a(algorithm),
  (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) e(epsilon))
SELECT algorithm, dataset, k, epsilon, 0::INTEGER AS steps FROM grid
  WHERE NOT (algorithm = 'sampled_kmeans' AND k = 200 AND epsilon = 0.2::DOUBLE)
UNION ALL SELECT 'kmeans_parallel', dataset, k, 0.0::DOUBLE, steps::INTEGER FROM ks, (VALUES (1), (2), (3), (4), (5)) s(steps)""",
}
