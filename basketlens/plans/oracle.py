"""Independent SQL (DuckDB dialect) for every registered query.

The oracle is written the way the questions are usually posed in SQL:
self-joins with ``<`` on the product id and ``COUNT(DISTINCT order_id)``,
windows for positions and ranks.  It shares no plan with the Spark side (which
uses the array plan of ``operators.cooccur``), so agreement checks the algorithm.

The six order tables are rebuilt from the pre-registered TPC-H-style views by
``fixture_ctes`` with the same rules as ``sources.tpch`` (CTE names carry an
``f_`` prefix so they never shadow the views).  Metrics are computed in
doubles in the same operation order as ``functions.metrics``; float averages
are rounded to 9 digits on both sides.
"""

from __future__ import annotations

from typing import List, Optional


def fixture_ctes(dirty: bool = False, grain: str = "name") -> str:
    aisle_text = "CAST(a.aisle_id AS VARCHAR)"
    dept_text = "CAST(d.department_id AS VARCHAR)"
    if dirty:
        aisle_text = f"CASE WHEN i.product_id % 15 = 0 THEN i.product_name ELSE {aisle_text} END"
        dept_text = f"CASE WHEN i.product_id % 10 = 0 THEN i.product_name ELSE {dept_text} END"
    if grain == "part":
        items = """
f_items AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS department, p_brand AS aisle FROM part),
f_part_item AS (SELECT p_partkey, p_partkey AS product_id FROM part),
"""
    else:
        items = """
f_dict AS (
    SELECT p_name AS product_name, MIN(p_partkey) AS product_id FROM part GROUP BY p_name),
f_items AS (
    SELECT product_id, product_name,
           split_part(product_name, ' ', 1) AS department,
           split_part(product_name, ' ', 2) AS aisle
    FROM f_dict),
f_part_item AS (
    SELECT p.p_partkey, d.product_id FROM part p JOIN f_dict d ON p.p_name = d.product_name),
"""
    return items + f"""
f_departments AS (
    SELECT MIN(product_id) AS department_id, department FROM f_items GROUP BY department),
f_aisles AS (
    SELECT MIN(product_id) AS aisle_id, aisle FROM f_items GROUP BY aisle),
f_products AS (
    SELECT i.product_id, i.product_name, {aisle_text} AS aisle_id, {dept_text} AS department_id
    FROM f_items i
    JOIN f_departments d ON i.department = d.department
    JOIN f_aisles a ON i.aisle = a.aisle),
f_products_clean AS (
    SELECT product_id, product_name,
           TRY_CAST(aisle_id AS BIGINT) AS aisle_id,
           TRY_CAST(department_id AS BIGINT) AS department_id
    FROM f_products),
f_orders_seq AS (
    SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_ts,
           ROW_NUMBER() OVER (PARTITION BY o_custkey
                              ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn_desc
    FROM orders),
f_orders AS (
    SELECT order_id, user_id,
           CASE WHEN rn_desc = 1 THEN 'train' ELSE 'prior' END AS eval_set,
           CAST(dayofweek(order_ts) AS INTEGER) AS order_dow,
           CAST(order_id % 24 AS INTEGER) AS order_hour_of_day,
           order_ts
    FROM f_orders_seq),
f_lines0 AS (
    SELECT l.l_orderkey AS order_id, pi.product_id,
           CAST(MIN(l.l_linenumber) AS INTEGER) AS add_to_cart_order
    FROM lineitem l JOIN f_part_item pi ON l.l_partkey = pi.p_partkey
    GROUP BY l.l_orderkey, pi.product_id),
f_lines AS (
    SELECT x.order_id, x.product_id, x.add_to_cart_order, o.eval_set,
           CAST(CASE WHEN ROW_NUMBER() OVER (PARTITION BY o.user_id, x.product_id
                                             ORDER BY o.order_ts, o.order_id) > 1
                     THEN 1 ELSE 0 END AS INTEGER) AS reordered
    FROM f_lines0 x JOIN f_orders o ON x.order_id = o.order_id),
f_prior AS (
    SELECT order_id, product_id, add_to_cart_order, reordered FROM f_lines WHERE eval_set = 'prior'),
f_train AS (
    SELECT order_id, product_id, add_to_cart_order, reordered FROM f_lines WHERE eval_set = 'train')"""


def with_fixture(body_ctes: str, select: str, dirty: bool = False, grain: str = "name") -> str:
    ctes = fixture_ctes(dirty, grain)
    if body_ctes.strip():
        ctes += ",\n" + body_ctes
    return f"WITH {ctes}\n{select}"


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def r9(x: str) -> str:
    return f"ROUND({x}, 9)"


def self_join_sets(n: int, lines: str = "f_prior", having: str = ">= 1",
                   line_filter: Optional[str] = None, key: str = "product_id",
                   extra_select: str = "", extra_group: str = "",
                   join_table: Optional[List[str]] = None) -> str:
    """SELECT i1..in, co FROM n-way self-join with ascending members."""
    tables = join_table or [lines] * n
    sel = ", ".join(f"l{i}.{key} AS i{i}" for i in range(1, n + 1))
    frm = f"{tables[0]} l1"
    for i in range(2, n + 1):
        frm += (f"\n    JOIN {tables[i - 1]} l{i} ON l1.order_id = l{i}.order_id"
                f" AND l{i - 1}.{key} < l{i}.{key}")
    where = ""
    if line_filter:
        where = "WHERE " + " AND ".join(line_filter.format(a=f"l{i}") for i in range(1, n + 1))
    groups = ", ".join(f"l{i}.{key}" for i in range(1, n + 1))
    if extra_group:
        groups = extra_group + ", " + groups
    return (f"SELECT {extra_select}{sel}, COUNT(DISTINCT l1.order_id) AS co\n"
            f"    FROM {frm}\n    {where}\n    GROUP BY {groups}\n"
            f"    HAVING COUNT(DISTINCT l1.order_id) {having}")


def lift_sql(co: str, total: str, supports: List[str]) -> str:
    num = " * ".join([D(co)] + [D(total)] * (len(supports) - 1))
    den = " * ".join(D(s) for s in supports)
    return f"{num} / ({den})"


def conf_sql(co: str, supports: List[str]) -> str:
    least = supports[0] if len(supports) == 1 else f"LEAST({', '.join(supports)})"
    return f"{D(co)} / {D(least)}"


def ids(n: int) -> str:
    return ", ".join(f"sets.i{i}" for i in range(1, n + 1))


def itemsets(n: int, min_co: int, limit: Optional[int] = None, pattern: Optional[str] = None,
             first: str = "", grain: str = "name") -> str:
    body = (f"sets AS (\n    {self_join_sets(n, having=f'>= {min_co}')}),\n"
            "sup AS (SELECT product_id, COUNT(DISTINCT order_id) AS s FROM f_prior GROUP BY product_id),\n"
            "tot AS (SELECT COUNT(DISTINCT order_id) AS total FROM f_prior)")
    sel = ", ".join(f"p{i}.product_name AS product_{i}" for i in range(1, n + 1))
    joins = "".join(f"\n  JOIN f_products p{i} ON sets.i{i} = p{i}.product_id" for i in range(1, n + 1))
    joins += "".join(f"\n  JOIN sup s{i} ON sets.i{i} = s{i}.product_id" for i in range(1, n + 1))
    sup = [f"s{i}.s" for i in range(1, n + 1)]
    where = ""
    if pattern is not None:
        where = "WHERE " + " OR ".join(f"p{i}.product_name LIKE '%{pattern}%'" for i in range(1, n + 1))
    order = f"ORDER BY {first}lift DESC, co_occurrence DESC, " + ids(n)
    lim = "" if limit is None else f"LIMIT {limit}"
    select = (f"SELECT {sel}, sets.co AS co_occurrence,\n"
              f"  {D('sets.co')} / {D('tot.total')} AS support,\n"
              f"  {conf_sql('sets.co', sup[:-1])} AS confidence,\n"
              f"  {lift_sql('sets.co', 'tot.total', sup)} AS lift\n"
              f"FROM sets{joins}\n  CROSS JOIN tot\n{where}\n{order}\n{lim}")
    return with_fixture(body, select, grain=grain)


def top_by(n: int, min_co: int, metric: str, limit: int) -> str:
    return itemsets(n, min_co, limit, first=f"{metric} DESC, ")


def assoc_view(n: int, min_co: int, limit: int) -> str:
    names = [f"product_{i}" for i in range(1, n + 1)]
    sep = " → " if n == 2 else " + "
    label = f" || '{sep}' || ".join(names)
    return f"SELECT *, {label} AS association FROM ({top_by(n, min_co, 'lift', limit)}) v"


def pairs_directed(pattern: str, min_co_exclusive: int, limit: int) -> str:
    body = (f"sets AS (\n    {self_join_sets(2, having=f'> {min_co_exclusive}')}),\n"
            "sup AS (SELECT product_id, COUNT(DISTINCT order_id) AS s FROM f_prior GROUP BY product_id),\n"
            "tot AS (SELECT COUNT(DISTINCT order_id) AS total FROM f_prior)")
    select = (
        "SELECT p1.product_name AS product_1, p2.product_name AS product_2,\n"
        "  sets.co AS co_occurrence_count, s1.s AS product1_count, s2.s AS product2_count,\n"
        f"  {conf_sql('sets.co', ['s1.s'])} AS confidence_1_to_2,\n"
        f"  {conf_sql('sets.co', ['s2.s'])} AS confidence_2_to_1,\n"
        f"  {lift_sql('sets.co', 'tot.total', ['s1.s', 's2.s'])} AS lift\n"
        "FROM sets JOIN f_products p1 ON sets.i1 = p1.product_id\n"
        "  JOIN f_products p2 ON sets.i2 = p2.product_id\n"
        "  JOIN sup s1 ON sets.i1 = s1.product_id JOIN sup s2 ON sets.i2 = s2.product_id\n"
        "  CROSS JOIN tot\n"
        f"WHERE p1.product_name LIKE '%{pattern}%' OR p2.product_name LIKE '%{pattern}%'\n"
        f"ORDER BY lift DESC, {ids(2)}\nLIMIT {limit}")
    return with_fixture(body, select)


DEPT_BASKETS = """db AS (
    SELECT DISTINCT x.order_id, d.department
    FROM f_prior x JOIN f_orders o ON x.order_id = o.order_id
    JOIN f_products_clean p ON x.product_id = p.product_id
    JOIN f_departments d ON p.department_id = d.department_id
    WHERE o.eval_set = 'prior'),
dtot AS (SELECT COUNT(DISTINCT order_id) AS b FROM db)"""

DEPT_OF = """dep AS (
    SELECT p.product_id, d.department FROM f_products_clean p
    LEFT JOIN f_departments d ON p.department_id = d.department_id)"""

HUNDRED = "CAST(100.0 AS DOUBLE)"


def dept_sets(n: int, min_co: int, limit: int = 50) -> str:
    depts = [f"dept_{i}" for i in range(1, n + 1)]
    body = (DEPT_BASKETS + ",\n"
            f"sets AS (\n    {self_join_sets(n, lines='db', key='department', having=f'>= {min_co}')})")
    sel = ", ".join(f"i{i} AS dept_{i}" for i in range(1, n + 1))
    select = (f"SELECT {sel}, co AS co_occurrence, {D('co')} * {HUNDRED} / {D('b')} AS support_pct\n"
              f"FROM sets CROSS JOIN dtot\nORDER BY co_occurrence DESC, {', '.join(depts)}\nLIMIT {limit}")
    return with_fixture(body, select)


def dept_pairs_conf(min_co_exclusive: int, limit: int = 20) -> str:
    body = (DEPT_BASKETS + ",\n"
            f"sets AS (\n    {self_join_sets(2, lines='db', key='department', having=f'> {min_co_exclusive}')}),\n"
            "hold AS (SELECT department, COUNT(DISTINCT order_id) AS h FROM db GROUP BY department)")
    select = (
        "SELECT i1 AS dept1, i2 AS dept2, co AS co_occurrence,\n"
        f"  ({D('co')} / {D('b')}) * {HUNDRED} AS support_pct,\n"
        f"  {D('co')} / {D('h')} AS confidence_dept1_to_dept2\n"
        "FROM sets JOIN hold ON sets.i1 = hold.department CROSS JOIN dtot\n"
        f"ORDER BY co_occurrence DESC, dept1, dept2\nLIMIT {limit}")
    return with_fixture(body, select)


def _names_depts(n: int) -> str:
    j = "".join(f"\n  JOIN f_products p{i} ON sets.i{i} = p{i}.product_id" for i in range(1, n + 1))
    j += "".join(f"\n  LEFT JOIN dep dp{i} ON sets.i{i} = dp{i}.product_id" for i in range(1, n + 1))
    return j


def temporal(n: int, min_count: int, limit: Optional[int] = 200, where: str = "") -> str:
    body = (
        "slots AS (\n"
        "    SELECT order_id,\n"
        "      CASE WHEN order_hour_of_day BETWEEN 6 AND 11 THEN 'Morning (6-11am)'\n"
        "           WHEN order_hour_of_day BETWEEN 12 AND 17 THEN 'Afternoon (12-5pm)'\n"
        "           WHEN order_hour_of_day BETWEEN 18 AND 21 THEN 'Evening (6-9pm)'\n"
        "           ELSE 'Night (10pm-5am)' END AS time_period,\n"
        "      CASE WHEN order_dow IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END AS day_type\n"
        "    FROM f_orders WHERE eval_set = 'prior'),\n"
        "tl AS (SELECT x.order_id, x.product_id, s.time_period, s.day_type\n"
        "       FROM f_prior x JOIN slots s ON x.order_id = s.order_id),\n"
        f"sets AS (\n    {self_join_sets(n, lines='tl', having=f'>= {min_count}', extra_select='l1.time_period, l1.day_type, ', extra_group='l1.time_period, l1.day_type')}),\n"
        + DEPT_OF)
    sel = ", ".join(f"p{i}.product_name AS product_{i}" for i in range(1, n + 1))
    dsel = ", ".join(f"dp{i}.department AS dept_{i}" for i in range(1, n + 1))
    select = (f"SELECT sets.time_period, sets.day_type, {sel}, sets.co AS pattern_count, {dsel},\n"
              "  sets.day_type || ' - ' || sets.time_period AS shopping_context\n"
              f"FROM sets{_names_depts(n)}\n{where}\n"
              f"ORDER BY pattern_count DESC, sets.time_period, sets.day_type, {ids(n)}\n"
              + ("" if limit is None else f"LIMIT {limit}"))
    return with_fixture(body, select)


def sequential(min_count: int, limit: int = 100, grain: str = "name") -> str:
    body = (
        "pos AS (SELECT order_id, product_id, ROW_NUMBER() OVER (\n"
        "          PARTITION BY order_id ORDER BY add_to_cart_order, product_id) AS position\n"
        "        FROM f_prior),\n"
        "seq AS (SELECT a.product_id AS f, b.product_id AS s, COUNT(*) AS sequence_count,\n"
        "               AVG(a.position) AS a1, AVG(b.position) AS a2\n"
        "        FROM pos a JOIN pos b ON a.order_id = b.order_id AND b.position = a.position + 1\n"
        f"        GROUP BY a.product_id, b.product_id HAVING COUNT(*) >= {min_count}),\n"
        "dims AS (SELECT p.product_id, p.product_name, d.department, a.aisle\n"
        "         FROM f_products_clean p\n"
        "         LEFT JOIN f_departments d ON p.department_id = d.department_id\n"
        "         LEFT JOIN f_aisles a ON p.aisle_id = a.aisle_id)")
    select = (
        "SELECT d1.product_name AS first_product, d2.product_name AS second_product,\n"
        "  sequence_count, a1 AS avg_first_pos, a2 AS avg_second_pos,\n"
        "  d1.department AS first_dept, d2.department AS second_dept,\n"
        "  d1.aisle AS first_aisle, d2.aisle AS second_aisle\n"
        "FROM seq JOIN dims d1 ON seq.f = d1.product_id JOIN dims d2 ON seq.s = d2.product_id\n"
        f"ORDER BY sequence_count DESC, seq.f, seq.s\nLIMIT {limit}")
    return with_fixture(body, select, grain=grain)


def reorder(n: int, min_count: int, limit: int = 100) -> str:
    body = ("rl AS (SELECT order_id, product_id FROM f_prior WHERE reordered = 1),\n"
            f"sets AS (\n    {self_join_sets(n, lines='rl', having=f'>= {min_count}')}),\n" + DEPT_OF)
    sel = ", ".join(f"p{i}.product_name AS product_{i}" for i in range(1, n + 1))
    dsel = ", ".join(f"dp{i}.department AS dept_{i}" for i in range(1, n + 1))
    if n == 2:
        loyalty = ("CASE WHEN dp1.department = dp2.department THEN 'Same Department Loyalty'"
                   " ELSE 'Cross Department Loyalty' END")
    else:
        loyalty = "'Multi-Product Loyalty'"
    where = " AND ".join(f"dp{i}.department IS NOT NULL" for i in range(1, n + 1))
    select = (f"SELECT {sel}, sets.co AS reorder_count, {dsel}, {loyalty} AS loyalty_type\n"
              f"FROM sets{_names_depts(n)}\nWHERE {where}\n"
              f"ORDER BY reorder_count DESC, {ids(n)}\nLIMIT {limit}")
    return with_fixture(body, select)


def cross_department(min_lift: float, min_count: int, limit: int = 100) -> str:
    body = (
        "pc AS (SELECT product_id, department_id FROM f_products_clean WHERE department_id IS NOT NULL),\n"
        "sets AS (\n"
        "    SELECT l1.product_id AS i1, l2.product_id AS i2, COUNT(DISTINCT l1.order_id) AS co\n"
        "    FROM f_prior l1 JOIN f_prior l2 ON l1.order_id = l2.order_id AND l1.product_id < l2.product_id\n"
        "    JOIN pc c1 ON l1.product_id = c1.product_id JOIN pc c2 ON l2.product_id = c2.product_id\n"
        "    WHERE c1.department_id <> c2.department_id\n"
        f"    GROUP BY l1.product_id, l2.product_id HAVING COUNT(DISTINCT l1.order_id) >= {min_count}),\n"
        "sup AS (SELECT product_id, COUNT(DISTINCT order_id) AS s FROM f_prior GROUP BY product_id),\n"
        "tot AS (SELECT COUNT(DISTINCT order_id) AS total FROM f_prior)")
    lift = lift_sql("sets.co", "tot.total", ["s1.s", "s2.s"])
    select = (
        "SELECT d1.department AS department_1, d2.department AS department_2,\n"
        "  p1.product_name AS product_1, p2.product_name AS product_2, sets.co AS pair_count,\n"
        f"  {conf_sql('sets.co', ['s1.s'])} AS confidence, {lift} AS lift\n"
        "FROM sets JOIN pc c1 ON sets.i1 = c1.product_id JOIN pc c2 ON sets.i2 = c2.product_id\n"
        "  LEFT JOIN f_departments d1 ON c1.department_id = d1.department_id\n"
        "  LEFT JOIN f_departments d2 ON c2.department_id = d2.department_id\n"
        "  JOIN f_products p1 ON sets.i1 = p1.product_id JOIN f_products p2 ON sets.i2 = p2.product_id\n"
        "  JOIN sup s1 ON sets.i1 = s1.product_id JOIN sup s2 ON sets.i2 = s2.product_id\n"
        "  CROSS JOIN tot\n"
        f"WHERE ROUND({lift}, 2) > {min_lift}\n"
        f"ORDER BY lift DESC, {ids(2)}\nLIMIT {limit}")
    return with_fixture(body, select)


def pair_labels(min_co_exclusive: int, limit: int = 30) -> str:
    body = (f"sets AS (\n    {self_join_sets(2, having=f'> {min_co_exclusive}')}),\n"
            "tot AS (SELECT COUNT(DISTINCT order_id) AS total FROM f_prior)")
    select = (
        "SELECT p1.product_name || ' → ' || p2.product_name AS product_pair,\n"
        f"  sets.co AS co_occurrence, {D('sets.co')} / {D('tot.total')} AS support\n"
        "FROM sets JOIN f_products p1 ON sets.i1 = p1.product_id\n"
        "  JOIN f_products p2 ON sets.i2 = p2.product_id CROSS JOIN tot\n"
        f"ORDER BY co_occurrence DESC, {ids(2)}\nLIMIT {limit}")
    return with_fixture(body, select)


SIZE_CLASS = ("CASE WHEN total_items <= 5 THEN 'Small (1-5 items)'"
              " WHEN total_items <= 15 THEN 'Medium (6-15 items)'"
              " WHEN total_items <= 30 THEN 'Large (16-30 items)'"
              " ELSE 'XLarge (30+ items)' END")


def basket_composition(dirty: bool = True) -> str:
    body = (
        "valid AS (SELECT product_id, department_id, aisle_id FROM f_products\n"
        "          WHERE TRY_CAST(department_id AS BIGINT) IS NOT NULL\n"
        "            AND TRY_CAST(aisle_id AS BIGINT) IS NOT NULL),\n"
        "bs AS (SELECT x.order_id, COUNT(DISTINCT x.product_id) AS total_items,\n"
        "              COUNT(DISTINCT v.department_id) AS unique_departments,\n"
        "              COUNT(DISTINCT v.aisle_id) AS unique_aisles\n"
        "       FROM f_prior x JOIN f_orders o ON x.order_id = o.order_id\n"
        "       JOIN valid v ON x.product_id = v.product_id\n"
        "       WHERE o.eval_set = 'prior' GROUP BY x.order_id),\n"
        f"sc AS (SELECT {SIZE_CLASS} AS basket_size, total_items, unique_departments, unique_aisles FROM bs)")
    select = (
        "SELECT basket_size, COUNT(*) AS basket_count, AVG(total_items) AS avg_items,\n"
        "  AVG(unique_departments) AS avg_departments, AVG(unique_aisles) AS avg_aisles,\n"
        f"  {r9('AVG(' + D('unique_aisles') + ' / ' + D('total_items') + ')')} AS diversity_ratio,\n"
        f"  {D('COUNT(*)')} * {HUNDRED} / {D('SUM(COUNT(*)) OVER ()')} AS pct_of_total\n"
        "FROM sc GROUP BY basket_size")
    return with_fixture(body, select, dirty)


def weekday() -> str:
    names = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
    case = " ".join(f"WHEN order_dow = {i} THEN '{n}'" for i, n in enumerate(names))
    return with_fixture("", f"SELECT COUNT(order_id) AS total_orders, CASE {case} END AS day_of_week\n"
                            "FROM f_orders GROUP BY order_dow ORDER BY order_dow")


def hours() -> str:
    return with_fixture("", "SELECT COUNT(order_id) AS total_orders, order_hour_of_day AS hour\n"
                            "FROM f_orders GROUP BY order_hour_of_day ORDER BY order_hour_of_day")


def top_departments(limit: int = 10, dirty: bool = True) -> str:
    return with_fixture("", (
        "SELECT d.department, COUNT(DISTINCT p.product_id) AS products\n"
        "FROM f_products_clean p JOIN f_departments d ON d.department_id = p.department_id\n"
        f"GROUP BY d.department ORDER BY products DESC, department LIMIT {limit}"), dirty)


def quality(dirty: bool = True) -> str:
    return with_fixture("", (
        "SELECT COUNT(*) AS total_products,\n"
        "  COUNT(CASE WHEN TRY_CAST(department_id AS BIGINT) IS NULL THEN 1 END) AS invalid_dept_ids,\n"
        "  COUNT(CASE WHEN TRY_CAST(aisle_id AS BIGINT) IS NULL THEN 1 END) AS invalid_aisle_ids,\n"
        "  COUNT(CASE WHEN TRY_CAST(department_id AS BIGINT) IS NOT NULL\n"
        "              AND TRY_CAST(aisle_id AS BIGINT) IS NOT NULL THEN 1 END) AS valid_products\n"
        "FROM f_products"), dirty)


def baskets_by_name(grain: str = "name") -> str:
    return with_fixture("", (
        "SELECT x.order_id, array_to_string(list_sort(list(DISTINCT p.product_name)), '|') AS items\n"
        "FROM f_prior x JOIN f_products p ON x.product_id = p.product_id GROUP BY x.order_id"), grain=grain)


def market_baskets() -> str:
    return with_fixture("", (
        "SELECT x.order_id, o.user_id,\n"
        "  string_agg(p.product_name, '|' ORDER BY x.add_to_cart_order, x.product_id) AS products,\n"
        "  string_agg(CAST(x.product_id AS VARCHAR), ',' ORDER BY x.add_to_cart_order, x.product_id)"
        " AS product_ids,\n"
        "  COUNT(*) AS basket_size\n"
        "FROM f_orders o JOIN f_prior x ON o.order_id = x.order_id\n"
        "JOIN f_products p ON x.product_id = p.product_id\n"
        "WHERE o.eval_set = 'prior' GROUP BY x.order_id, o.user_id HAVING COUNT(*) >= 2"))


TX = """tx AS (SELECT x.order_id FROM f_prior x JOIN f_orders o ON x.order_id = o.order_id
       WHERE o.eval_set = 'prior' GROUP BY x.order_id HAVING COUNT(*) >= 2)"""


def transactions() -> str:
    return with_fixture(TX, (
        "SELECT x.order_id, array_to_string(list_sort(list(DISTINCT CAST(x.product_id AS VARCHAR))), ',')"
        " AS items\nFROM f_prior x JOIN tx ON x.order_id = tx.order_id GROUP BY x.order_id"))


def _frequent_itemsets(min_support: float, max_size: int = 10) -> str:
    """All frequent itemsets, level by level: a set of size j is counted only
    when its first j-1 members form a frequent set (exact; fixture baskets hold
    at most 10 items)."""
    m = "(SELECT m FROM nt)"
    ctes = [
        TX,
        "ti AS (SELECT DISTINCT x.order_id, x.product_id FROM f_prior x JOIN tx ON x.order_id = tx.order_id)",
        f"nt AS (SELECT COUNT(*) AS n, CAST(CEIL(CAST({min_support} AS DOUBLE) * COUNT(*)) AS BIGINT) AS m FROM tx)",
        f"f1 AS (SELECT product_id AS i1, COUNT(DISTINCT order_id) AS freq FROM ti GROUP BY product_id"
        f" HAVING COUNT(DISTINCT order_id) >= {m})",
        "o1 AS (SELECT ti.order_id, ti.product_id AS i1 FROM ti JOIN f1 ON ti.product_id = f1.i1)",
    ]
    for j in range(2, max_size + 1):
        prev = ", ".join(f"o.i{i}" for i in range(1, j))
        ctes.append(
            f"f{j} AS (SELECT {prev}, t.product_id AS i{j}, COUNT(DISTINCT o.order_id) AS freq\n"
            f"    FROM o{j - 1} o JOIN ti t ON o.order_id = t.order_id AND t.product_id > o.i{j - 1}\n"
            f"    GROUP BY {prev}, t.product_id HAVING COUNT(DISTINCT o.order_id) >= {m})")
        if j < max_size:
            on = " AND ".join([f"f.i{i} = o.i{i}" for i in range(1, j)] + [f"f.i{j} = t.product_id"])
            ctes.append(
                f"o{j} AS (SELECT o.order_id, {prev}, t.product_id AS i{j}\n"
                f"    FROM o{j - 1} o JOIN ti t ON o.order_id = t.order_id AND t.product_id > o.i{j - 1}\n"
                f"    JOIN f{j} f ON {on})")
    parts = []
    for j in range(1, max_size + 1):
        members = ", ".join(f"CAST(i{i} AS VARCHAR)" for i in range(1, j + 1))
        parts.append(f"SELECT [{members}] AS members, freq FROM f{j}")
    ctes.append("fi AS (" + "\n    UNION ALL ".join(parts) + ")")
    ctes.append("fk AS (SELECT array_to_string(list_sort(members), ',') AS k, members, freq FROM fi)")
    return ",\n".join(ctes)


def fpgrowth_itemsets(min_support: float) -> str:
    return with_fixture(_frequent_itemsets(min_support),
                        "SELECT k AS items, CAST(len(members) AS INTEGER) AS size, freq FROM fk")


def itemsets_of_size(min_support: float, n: int) -> str:
    return with_fixture(_frequent_itemsets(min_support),
                        f"SELECT k AS items, freq FROM fk WHERE len(members) = {n}")


def _rules(min_support: float, min_conf: float, min_lift: float) -> str:
    return (_frequent_itemsets(min_support) + ",\n"
            "ru AS (SELECT freq AS fu, members, UNNEST(members) AS c FROM fk WHERE len(members) >= 2),\n"
            "rv AS (SELECT fu, c, list_filter(members, lambda x: x <> c) AS ante FROM ru),\n"
            "rules AS (\n"
            "  SELECT array_to_string(list_sort(rv.ante), ',') AS antecedent, rv.ante, rv.c AS consequent,\n"
            f"    {D('rv.fu')} / {D('a.freq')} AS confidence,\n"
            f"    ({D('rv.fu')} / {D('a.freq')}) / ({D('cf.freq')} / {D('nt.n')}) AS lift,\n"
            f"    {D('rv.fu')} / {D('nt.n')} AS support\n"
            "  FROM rv JOIN fk a ON a.k = array_to_string(list_sort(rv.ante), ',')\n"
            "  JOIN fk cf ON cf.k = rv.c CROSS JOIN nt\n"
            f"  WHERE {D('rv.fu')} / {D('a.freq')} >= {min_conf}),\n"
            f"kept AS (SELECT * FROM rules WHERE lift >= {min_lift})")


def fpgrowth_rules(min_support: float, min_conf: float, min_lift: float) -> str:
    return with_fixture(_rules(min_support, min_conf, min_lift),
                        "SELECT antecedent, consequent, confidence, lift, support FROM kept")


def rules_named(min_support: float, min_conf: float, min_lift: float) -> str:
    body = (_rules(min_support, min_conf, min_lift) + ",\n"
            "kr AS (SELECT ROW_NUMBER() OVER () AS rid, * FROM kept),\n"
            "an AS (SELECT u.rid, string_agg(u.aid || ':' || p.product_name, ' + ' ORDER BY u.aid) AS names\n"
            "       FROM (SELECT rid, UNNEST(ante) AS aid FROM kr) u\n"
            "       JOIN f_products p ON CAST(p.product_id AS VARCHAR) = u.aid GROUP BY u.rid)")
    select = ("SELECT an.names AS antecedent, p.product_name AS consequent, kr.confidence, kr.lift, kr.support\n"
              "FROM kr JOIN an ON kr.rid = an.rid\n"
              "JOIN f_products p ON CAST(p.product_id AS VARCHAR) = kr.consequent")
    return with_fixture(body, select)


def user_history(user_id: int) -> str:
    return with_fixture("", (
        "SELECT p.product_id, p.product_name, COUNT(*) AS purchase_count\n"
        "FROM f_orders o JOIN f_prior x ON o.order_id = x.order_id\n"
        "JOIN f_products p ON x.product_id = p.product_id\n"
        f"WHERE o.user_id = {user_id} GROUP BY p.product_id, p.product_name"))


def recommendations(user_id: int, n: int = 10) -> str:
    body = (
        "up AS (SELECT DISTINCT x.product_id FROM f_orders o JOIN f_prior x ON o.order_id = x.order_id\n"
        f"       WHERE o.user_id = {user_id}),\n"
        "ap AS (SELECT l2.product_id AS rp, COUNT(DISTINCT l1.order_id) AS s\n"
        "       FROM f_prior l1 JOIN f_prior l2 ON l1.order_id = l2.order_id\n"
        "       WHERE l1.product_id IN (SELECT product_id FROM up)\n"
        "         AND l2.product_id NOT IN (SELECT product_id FROM up)\n"
        "       GROUP BY l2.product_id),\n"
        "ranked AS (\n"
        "  SELECT p.product_name, p.product_id, a.aisle, d.department, ap.s AS association_strength,\n"
        "         CAST(RANK() OVER (ORDER BY ap.s DESC) AS INTEGER) AS rank\n"
        "  FROM ap JOIN f_products_clean p ON ap.rp = p.product_id\n"
        "  JOIN f_aisles a ON p.aisle_id = a.aisle_id\n"
        "  JOIN f_departments d ON p.department_id = d.department_id)")
    return with_fixture(body, f"SELECT * FROM ranked ORDER BY association_strength DESC, product_id LIMIT {n}")


def rec_quality(k: int = 10) -> str:
    hits = "len(list_intersect(t.actual, r.rec))"
    body = (
        "tb AS (SELECT o.user_id, list(DISTINCT x.product_id) AS actual\n"
        "       FROM f_orders o JOIN f_train x ON o.order_id = x.order_id GROUP BY o.user_id),\n"
        "pf AS (SELECT o.user_id, x.product_id, COUNT(*) AS c,\n"
        "              ROW_NUMBER() OVER (PARTITION BY o.user_id ORDER BY COUNT(*) DESC, x.product_id) AS rk\n"
        "       FROM f_orders o JOIN f_prior x ON o.order_id = x.order_id\n"
        "       GROUP BY o.user_id, x.product_id),\n"
        f"rc AS (SELECT user_id, list(product_id) AS rec FROM pf WHERE rk <= {k} GROUP BY user_id)")
    select = (
        f"SELECT COUNT(*) AS total_users, AVG({hits}) AS avg_correct_predictions,\n"
        f"  {r9('AVG(' + D(hits) + ' / ' + D('len(r.rec)') + ')')} AS avg_precision,\n"
        f"  {r9('AVG(' + D(hits) + ' / ' + D('len(t.actual)') + ')')} AS avg_recall\n"
        "FROM tb t JOIN rc r ON t.user_id = r.user_id")
    return with_fixture(body, select)


def top_rules(min_support: float, min_conf: float, min_lift: float, limit: int = 20) -> str:
    # ranked with a window: DuckDB stalls on ORDER BY ... LIMIT over these CTEs
    return with_fixture(_rules(min_support, min_conf, min_lift), (
        "SELECT antecedent, consequent, confidence, lift, support FROM (\n"
        "  SELECT *, ROW_NUMBER() OVER (ORDER BY lift DESC, antecedent, consequent) AS rn FROM kept) r\n"
        f"WHERE rn <= {limit}"))


def itemsets_of_size_top(min_support: float, n: int, limit: int) -> str:
    return with_fixture(_frequent_itemsets(min_support), (
        "SELECT items, freq FROM (\n"
        "  SELECT k AS items, freq, ROW_NUMBER() OVER (ORDER BY freq DESC, k) AS rn\n"
        f"  FROM fk WHERE len(members) = {n}) r\nWHERE rn <= {limit}"))


def temporal_slice(n: int, min_count: int, day_type: str, period: str, limit: int = 15) -> str:
    return temporal(n, min_count, limit, f"WHERE sets.day_type = '{day_type}' AND sets.time_period = '{period}'")


def recommend_many(n: int = 10) -> str:
    body = (
        "up AS (SELECT DISTINCT o.user_id, x.product_id FROM f_orders o JOIN f_prior x ON o.order_id = x.order_id),\n"
        "touch AS (SELECT DISTINCT up.user_id, l.order_id FROM up JOIN f_prior l ON up.product_id = l.product_id),\n"
        "ap AS (SELECT t.user_id, l.product_id, COUNT(DISTINCT l.order_id) AS s\n"
        "       FROM touch t JOIN f_prior l ON t.order_id = l.order_id\n"
        "       WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.user_id = t.user_id AND up.product_id = l.product_id)\n"
        "       GROUP BY t.user_id, l.product_id),\n"
        "ranked AS (\n"
        "  SELECT ap.user_id, p.product_name, p.product_id, a.aisle, d.department, ap.s AS association_strength,\n"
        "         CAST(RANK() OVER (PARTITION BY ap.user_id ORDER BY ap.s DESC) AS INTEGER) AS rank,\n"
        "         ROW_NUMBER() OVER (PARTITION BY ap.user_id ORDER BY ap.s DESC, p.product_id) AS rn\n"
        "  FROM ap JOIN f_products_clean p ON ap.product_id = p.product_id\n"
        "  JOIN f_aisles a ON p.aisle_id = a.aisle_id\n"
        "  JOIN f_departments d ON p.department_id = d.department_id)")
    return with_fixture(body, "SELECT user_id, product_name, product_id, aisle, department, association_strength, rank\n"
                              f"FROM ranked WHERE rn <= {n}")


def rule_predictions(min_support: float, min_conf: float) -> str:
    body = (_rules(min_support, min_conf, 0.0) + ",\n"
            "carts AS (SELECT order_id, list(DISTINCT CAST(product_id AS VARCHAR)) AS held FROM ti GROUP BY order_id),\n"
            "ex AS (SELECT order_id, held, UNNEST(held) AS item FROM carts),\n"
            "said AS (SELECT DISTINCT ex.order_id, r.consequent FROM ex\n"
            "         JOIN rules r ON list_sort(r.ante)[1] = ex.item\n"
            "         WHERE list_has_all(ex.held, r.ante) AND NOT list_contains(ex.held, r.consequent))")
    return with_fixture(body, "SELECT order_id, string_agg(consequent, ',' ORDER BY consequent) AS prediction\n"
                              "FROM said GROUP BY order_id")


def load_quarantine() -> str:
    dow, hour = "order_id % 10 = 3", "order_id % 15 = 3"
    return with_fixture("", (
        f"SELECT order_id, concat_ws(',', CASE WHEN {dow} THEN 'order_dow' END,\n"
        f"    CASE WHEN {hour} THEN 'order_hour_of_day' END) AS columns,\n"
        f"  CASE WHEN {dow} THEN 'day' ELSE CAST(order_dow AS VARCHAR) END AS raw_dow,\n"
        f"  CASE WHEN {hour} THEN '7h' ELSE CAST(order_hour_of_day AS VARCHAR) END AS raw_hour,\n"
        f"  CASE WHEN NOT {dow} THEN order_dow END AS order_dow,\n"
        f"  CASE WHEN NOT {hour} THEN order_hour_of_day END AS order_hour_of_day,\n"
        f"  (SELECT COUNT(*) FROM f_orders WHERE {dow}) AS lost_dow,\n"
        f"  (SELECT COUNT(*) FROM f_orders WHERE {hour}) AS lost_hour\n"
        f"FROM f_orders WHERE {dow} OR {hour}"))
