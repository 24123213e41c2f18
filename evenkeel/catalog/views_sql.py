"""The canonical views as DuckDB SQL; each query's SQL begins with those it needs."""

VIEWS = """
interactions AS MATERIALIZED (
    SELECT o_custkey AS user_id, l_partkey AS item_id, max(1 + floor((l_quantity - 1) / 10))::DOUBLE AS rating, max(o_orderdate) AS ts
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
), users AS (
    SELECT c_custkey AS user_id, c_nationkey % 2 = 0 AS sensitive, CASE WHEN c_nationkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
           (18 + c_custkey % 50)::INT AS age FROM customer
), items AS (
    SELECT p_partkey AS item_id, p_type AS category, p_brand AS brand FROM part
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM interactions
), parts AS MATERIALIZED (
    SELECT user_id, item_id, rating, ts,
           CASE WHEN rn <= n - floor(n * 0.1::DOUBLE) - floor(n * 0.2::DOUBLE) THEN 'train'
                WHEN rn <= n - floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM numbered
), train AS (SELECT user_id, item_id, rating, ts FROM parts WHERE part = 'train'),
test AS (SELECT user_id, item_id, rating, ts FROM parts WHERE part = 'test')"""

PREDICTIONS = VIEWS + """, mean AS (SELECT avg(rating) AS mu FROM train),
item_bias AS (SELECT item_id, avg(rating - mu) AS bi FROM train, mean GROUP BY 1),
user_bias AS (SELECT user_id, avg(rating - mu) AS bu FROM train, mean GROUP BY 1),
wanted AS (
    SELECT u.user_id, i.item_id FROM (SELECT DISTINCT user_id FROM parts) u
    JOIN (SELECT DISTINCT item_id FROM parts) i ON (u.user_id * 7919 + i.item_id * 104729) % 1000003 % 20 = 0
    UNION SELECT user_id, item_id FROM test
), fresh AS (SELECT w.* FROM wanted w ANTI JOIN train t ON w.user_id = t.user_id AND w.item_id = t.item_id),
predictions AS MATERIALIZED (
    SELECT f.user_id, f.item_id, round(mu + coalesce(bi, 0) + coalesce(bu, 0), 6) AS score
    FROM fresh f LEFT JOIN item_bias ib ON f.item_id = ib.item_id LEFT JOIN user_bias ub ON f.user_id = ub.user_id, mean
)"""

RANKED = PREDICTIONS + """, ranked AS MATERIALIZED (
    SELECT p.user_id, p.item_id, p.score, row_number() OVER (PARTITION BY p.user_id ORDER BY p.score DESC, p.item_id) AS rank,
           (t.item_id IS NOT NULL)::INT AS hit
    FROM predictions p LEFT JOIN test t ON p.user_id = t.user_id AND p.item_id = t.item_id
), n_items AS (SELECT count(DISTINCT item_id) AS n_items FROM interactions),
counts AS (
    SELECT u.user_id, k, coalesce(tp, 0) AS tp, coalesce(gain, 0) AS gain, coalesce(reciprocal, 0) AS reciprocal, coalesce(n_top, 0) AS n_top,
           coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test, n_items
    FROM users u CROSS JOIN (SELECT unnest([5, 10]) AS k) ks
    LEFT JOIN (SELECT user_id AS uid, kk, count(*) FILTER (hit = 1 AND rank <= kk) AS tp, sum(1 / log2(rank + 1)) FILTER (hit = 1 AND rank <= kk) AS gain,
                      sum(1.0::DOUBLE / rank) FILTER (hit = 1 AND rank <= kk) AS reciprocal, count(*) FILTER (rank <= kk) AS n_top
               FROM ranked, (SELECT unnest([5, 10]) AS kk) GROUP BY 1, 2) r ON r.uid = u.user_id AND r.kk = k
    LEFT JOIN (SELECT user_id AS uid, count(*) AS n_train FROM train GROUP BY 1) a ON a.uid = u.user_id
    LEFT JOIN (SELECT user_id AS uid, count(*) AS n_test FROM test GROUP BY 1) b ON b.uid = u.user_id, n_items
), ideal AS (
    SELECT m, coalesce((SELECT sum(1 / log2(j + 1)) FROM (SELECT unnest(range(1, 11)) AS j) WHERE j <= m), 0) AS best FROM (SELECT unnest(range(0, 11)) AS m)
)"""

SCORED = PREDICTIONS + """, scored AS (
    SELECT p.user_id, p.item_id, p.score, u.sensitive, u.gender, t.rating
    FROM predictions p JOIN users u USING (user_id) LEFT JOIN test t ON p.user_id = t.user_id AND p.item_id = t.item_id
), truth AS (SELECT * FROM scored WHERE rating IS NOT NULL)"""


def negatives_sql(positives: str, known: str, per_positive: int) -> str:
    """Common tables that end in ``negatives`` (user_id, item_id, negative_id): draws by number, then places among unknown items."""
    h = "((p.user_id * 7919 + p.item_id * 104729 + {} * 1299709) % 2147483647) * 48271 % 2147483647"
    m = per_positive
    return f"""+ n AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS number FROM (SELECT DISTINCT item_id FROM interactions)), size AS (SELECT count(*) AS n_items FROM n),
draws AS (SELECT p.user_id, p.item_id, d AS draw, {h.format("d")} % n_items AS number FROM {positives} p, size, (SELECT unnest(range(1, {2 * m} + 1)) AS d)),
found AS (SELECT d.user_id, d.item_id, n.item_id AS negative_id, min(draw) AS draw FROM draws d JOIN n USING (number) ANTI JOIN {known} k ON k.user_id = d.user_id AND k.item_id = n.item_id GROUP BY 1, 2, 3),
short AS MATERIALIZED (SELECT p.user_id, p.item_id FROM {positives} p LEFT JOIN (SELECT user_id, item_id, count(*) AS c FROM found GROUP BY 1, 2) f ON f.user_id = p.user_id AND f.item_id = p.item_id WHERE coalesce(c, 0) < {m}),
free AS (SELECT u.user_id, n.item_id AS negative_id, row_number() OVER (PARTITION BY u.user_id ORDER BY number) - 1 AS place, count(*) OVER (PARTITION BY u.user_id) AS free FROM (SELECT DISTINCT user_id FROM short) u CROSS JOIN n ANTI JOIN {known} k ON k.user_id = u.user_id AND k.item_id = n.item_id),
exact AS (SELECT p.user_id, p.item_id, f.negative_id, {2 * m} + d AS draw FROM short p CROSS JOIN (SELECT unnest(range(1, {m} + 1)) AS d) JOIN free f ON f.user_id = p.user_id AND f.place = ({h.format(0)} % f.free + d) % f.free WHERE d <= f.free),
once AS (SELECT user_id, item_id, negative_id, min(draw) AS draw FROM (SELECT * FROM found UNION ALL SELECT * FROM exact) GROUP BY 1, 2, 3),
negatives AS (SELECT user_id, item_id, negative_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY draw) AS r FROM once) WHERE r <= {m})"""


def sql(body: str, views: str = VIEWS) -> str:
    return f"WITH {views}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"
