"""Independent DuckDB SQL for every registered query.

The domain tables are rebuilt from the raw test tables as CTEs (prefixed ``d_``
so they do not shadow the raw views), then each query is plain SQL over them.
Dates are returned as ISO text and money as DOUBLE, matching ``finish``.
"""

from __future__ import annotations

SKU = "CAST({k} AS VARCHAR) || CASE WHEN p_size % 10 = 0 THEN '_old' ELSE '' END"
UOM = ("CASE l_linenumber WHEN 1 THEN 'Case' WHEN 2 THEN 'INF_PROD_CAS' WHEN 3 THEN 'Subcase' "
       "WHEN 4 THEN 'Piece' WHEN 5 THEN NULL ELSE 'Case' END")

DOMAIN = f"""
lines AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_orderdate, p.p_name, p.p_size
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
),
d_invoice AS (
  SELECT CAST(l_shipdate AS DATE) AS txn_date,
         'C' || CAST(o_custkey AS VARCHAR) AS customer_id,
         'CUST-' || CAST(o_custkey AS VARCHAR) AS customer_name,
         {SKU.format(k='l_partkey')} AS sku,
         'IC' || CAST(l_partkey AS VARCHAR) AS item_code,
         p_name AS sku_name,
         {UOM} AS uom,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty,
         CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS amount,
         CASE WHEN l_linenumber = 7 THEN 'ITM_SALES_TAX'
              WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN NULL ELSE 'ITM_GOODS' END AS item_type,
         'INV' || CAST(l_orderkey AS VARCHAR) AS doc_no,
         'SO' || CAST(l_orderkey AS VARCHAR) AS order_no,
         'E' || CAST(l_suppkey AS VARCHAR) AS rep_id
  FROM lines
),
d_returns AS (
  SELECT CAST(l_shipdate AS DATE) AS txn_date,
         'CR' || CAST(l_orderkey AS VARCHAR) AS doc_no,
         'E' || CAST(l_suppkey AS VARCHAR) AS rep_id,
         'C' || CAST(o_custkey AS VARCHAR) AS customer_id,
         'CUST-' || CAST(o_custkey AS VARCHAR) AS customer_name,
         {SKU.format(k='l_partkey')} AS sku,
         p_name AS sku_name,
         CASE l_linenumber WHEN 1 THEN 'MAIN BO' WHEN 2 THEN 'Virtual WH' WHEN 3 THEN 'MAIN FG'
              WHEN 4 THEN 'BO FG' WHEN 5 THEN 'FG_1' WHEN 6 THEN 'VirtualWH' ELSE NULL END AS facility,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS amount,
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 3 THEN NULL ELSE {UOM} END AS uom,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty,
         CASE WHEN l_linestatus = 'F' THEN 'CUSTOMER_RETURN' WHEN l_linenumber = 7 THEN NULL
              ELSE 'BAD_ORDER' END AS return_type
  FROM lines WHERE l_returnflag = 'R'
),
d_sales_order AS (
  SELECT CAST(o_orderdate AS DATE) AS txn_date,
         'C' || CAST(o_custkey AS VARCHAR) AS customer_id,
         {SKU.format(k='l_partkey')} AS sku,
         p_name AS sku_name,
         {UOM} AS uom,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'Invoiced' WHEN 'O' THEN 'Open' ELSE NULL END AS status,
         'SO' || CAST(l_orderkey AS VARCHAR) AS order_no
  FROM lines
),
d_customer_base AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customer_id,
         c_name AS customer_name,
         c_mktsegment AS customer_class,
         CASE WHEN c_acctbal > 5000 THEN 'KEY' ELSE 'REGULAR' END AS account_group,
         CASE WHEN c_nationkey = 0 THEN NULL ELSE 'R' || CAST(c_nationkey AS VARCHAR) END AS rep_id,
         'Rep ' || n_name AS rep_name,
         r_name AS branch,
         'Brgy ' || CAST(c_custkey % 40 AS VARCHAR) AS barangay,
         n_name AS city,
         r_name AS province,
         CASE c_custkey % 3 WHEN 0 THEN 'VAN(EXTRUCK)' WHEN 1 THEN 'BOOK(Booking)' ELSE 'MODERN TRADE' END AS channel,
         CASE WHEN c_acctbal < 0 THEN 'Blocked/On hold' WHEN c_custkey % 20 = 0 THEN 'Approval On Hold'
              WHEN c_custkey % 31 = 0 THEN NULL ELSE 'Active/Approved' END AS status,
         CASE WHEN c_acctbal > 8000 THEN 'URBAN' ELSE 'RURAL' END AS retail_env,
         CASE WHEN c_custkey % 97 = 0 THEN 'N/A'
              ELSE strftime(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER), '%m/%d/%Y') END AS created,
         c_acctbal,
         DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS created_d
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
d_customer AS (
  SELECT customer_id, customer_name, customer_class, account_group, rep_id, rep_name, branch, barangay, city,
         province, channel, status, retail_env, created
  FROM d_customer_base
  UNION ALL
  SELECT customer_id, customer_name, customer_class, account_group, rep_id, rep_name, branch, barangay, city,
         province, channel, 'Active/Approved', retail_env, strftime(created_d - 400, '%m/%d/%Y')
  FROM d_customer_base WHERE c_acctbal > 9900
),
d_route_days AS (
  SELECT c_custkey, c_nationkey,
         CASE c_custkey % 5 WHEN 0 THEN '_WKLY' WHEN 1 THEN '_WK1_WK3' WHEN 2 THEN '_WK2_WK4' WHEN 3 THEN '_WK1'
              ELSE '' END AS weeks,
         ['MON', 'TUE', 'WED', 'THU', 'FRI', 'SAT'] AS days
  FROM customer
),
d_route AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c_custkey % 11 = 0 THEN 'RT' || CAST(c_nationkey AS VARCHAR)
              ELSE 'RT' || CAST(c_nationkey AS VARCHAR) || '_' || days[CAST(c_custkey % 6 AS INTEGER) + 1] || weeks
         END AS route_code
  FROM d_route_days
  UNION ALL
  SELECT 'C' || CAST(c_custkey AS VARCHAR),
         CASE WHEN c_custkey % 11 = 0 THEN 'RT' || CAST(c_nationkey AS VARCHAR)
              ELSE 'RT' || CAST(c_nationkey AS VARCHAR) || '_' || days[CAST((c_custkey + 2) % 6 AS INTEGER) + 1]
                   || weeks
         END
  FROM d_route_days WHERE c_custkey % 13 = 0
),
d_price_u AS (
  SELECT p_partkey, p_name, p_size, p_retailprice, UNNEST(['Case', 'Subcase', 'Piece']) AS uom
  FROM part WHERE p_size <> 4
),
d_price_c AS (SELECT *, UNNEST(['BOOK(Booking)', 'VAN(EXTRUCK)']) AS channel FROM d_price_u),
d_price_k AS (
  SELECT *, UNNEST(['Regular', CASE p_size % 6 WHEN 0 THEN 'BEV Dealer' WHEN 2 THEN 'Wholesale' ELSE NULL END])
            AS price_class
  FROM d_price_c
),
d_price AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS sku_name, uom,
         CAST(p_retailprice AS DECIMAL(12,2))
           * CASE uom WHEN 'Case' THEN CAST('1.00' AS DECIMAL(4,2)) WHEN 'Subcase' THEN CAST('0.25' AS DECIMAL(4,2))
                      ELSE CAST('0.05' AS DECIMAL(4,2)) END
           * CASE WHEN channel = 'VAN(EXTRUCK)' THEN CAST('1.05' AS DECIMAL(3,2)) ELSE 1 END AS price,
         price_class, channel
  FROM d_price_k
  WHERE NOT (channel = 'VAN(EXTRUCK)' AND p_partkey % 9 = 0)
    AND NOT (p_size % 6 IN (3, 4, 5) AND price_class IS NULL)
),
d_category AS (
  SELECT {SKU.format(k='p_partkey')} AS sku, p_name AS sku_name,
         CASE WHEN p_size = 1 THEN '' WHEN p_size = 2 THEN '  ' ELSE p_type END AS category
  FROM part WHERE p_size <> 3
),
d_supervisor AS (
  SELECT CASE WHEN s_nationkey = 1 THEN NULL ELSE 'R' || CAST(s_nationkey AS VARCHAR) END AS rep_id,
         min(s_name) AS supervisor
  FROM supplier GROUP BY s_nationkey
),
d_calendar AS (
  SELECT txn_date, CAST(weekofyear(txn_date) AS INTEGER) AS week
  FROM (SELECT DISTINCT txn_date FROM (
          SELECT CAST(l_shipdate AS DATE) AS txn_date FROM lineitem
          UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders))
  WHERE dayofweek(txn_date) <> 0
),
d_classification AS (
  SELECT DISTINCT c_mktsegment AS customer_class, 'CL-' || substr(c_mktsegment, 1, 3) AS classification
  FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'
),
d_gt_channel AS (
  SELECT DISTINCT c_mktsegment AS customer_class, 'GT-' || c_mktsegment AS gt_channel
  FROM customer WHERE c_mktsegment <> 'MACHINERY'
),
d_new_customer AS (
  SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE c_custkey % 4 WHEN 0 THEN 'NO' WHEN 2 THEN '  ' WHEN 3 THEN 'YES' ELSE NULL END AS is_new
  FROM customer WHERE c_acctbal >= 0
),
d_deductions AS (
  SELECT doc_no || '_' || sku AS invoice_key, CAST(NULL AS VARCHAR) AS return_key FROM d_invoice WHERE qty > 48
  UNION ALL
  SELECT CAST(NULL AS VARCHAR), doc_no || '_' || sku FROM d_returns WHERE qty < 5
),
d_free_goods AS (
  SELECT CAST(p_partkey AS VARCHAR) AS sku,
         CAST(CASE WHEN p_size = 49 THEN NULL ELSE p_size % 5 END AS DECIMAL(12,2)) AS case_size
  FROM part WHERE p_size % 7 = 0
)"""

# Cleaned facts, price lists and the shared enrichment.
STAGES = r"""
inv_clean AS (
  SELECT i.txn_date, i.customer_id, i.sku, i.sku_name, i.uom, i.qty, COALESCE(i.amount, 0) AS served,
         CAST(0 AS DECIMAL(12,2)) AS bad_returns, CAST(0 AS DECIMAL(12,2)) AS good_returns
  FROM d_invoice i
  WHERE i.item_type IS DISTINCT FROM 'ITM_SALES_TAX'
    AND NOT EXISTS (SELECT 1 FROM d_deductions d WHERE d.invoice_key = i.doc_no || '_' || i.sku)
),
ret_clean AS (
  SELECT r.*, NULLIF(regexp_extract(replace(r.facility, 'Virtual', 'FG'), '\b(FG|BO)\b', 1), '') AS facility_class,
         COALESCE(r.amount, 0) * CAST('1.12' AS DECIMAL(3,2)) AS amount_vat
  FROM d_returns r
  WHERE NOT EXISTS (SELECT 1 FROM d_deductions d WHERE d.return_key = r.doc_no || '_' || r.sku)
),
ret_pivot AS (
  SELECT txn_date, customer_id, sku, sku_name, uom, qty,
         COALESCE(SUM(CASE WHEN facility_class = 'BO' THEN amount_vat END), 0) AS bad_returns,
         COALESCE(SUM(CASE WHEN facility_class = 'FG' THEN amount_vat END), 0) AS good_returns
  FROM ret_clean
  WHERE txn_date IS NOT NULL AND customer_id IS NOT NULL AND sku IS NOT NULL AND sku_name IS NOT NULL
    AND uom IS NOT NULL AND qty IS NOT NULL AND facility_class IN ('BO', 'FG')
  GROUP BY txn_date, customer_id, sku, sku_name, uom, qty
),
deducted_order_keys AS (
  SELECT i.order_no || '_' || i.sku AS order_key
  FROM d_invoice i
  WHERE i.item_type IS DISTINCT FROM 'ITM_SALES_TAX'
    AND EXISTS (SELECT 1 FROM d_deductions d WHERE d.invoice_key = i.doc_no || '_' || i.sku)
),
so_clean AS (
  SELECT s.txn_date, s.customer_id, s.sku, s.sku_name, s.uom, s.qty,
         COALESCE(s.amount, 0) * CAST('1.12' AS DECIMAL(3,2)) AS value
  FROM d_sales_order s
  WHERE s.status = 'Invoiced'
    AND NOT EXISTS (SELECT 1 FROM deducted_order_keys k WHERE k.order_key = s.order_no || '_' || s.sku)
),
pl_base AS (
  SELECT *, price * CAST('1.12' AS DECIMAL(3,2)) AS price_vat
  FROM d_price WHERE price_class IS DISTINCT FROM 'BEV Dealer'
),
pl_nonvan AS (
  SELECT sku, sku_name,
         COALESCE(SUM(CASE WHEN uom = 'Case' THEN price_vat END), 0) AS case_price,
         COALESCE(SUM(CASE WHEN uom = 'Subcase' THEN price_vat END), 0) AS subcase_price,
         COALESCE(SUM(CASE WHEN uom = 'Piece' THEN price_vat END), 0) AS piece_price
  FROM pl_base
  WHERE channel IS DISTINCT FROM 'VAN(EXTRUCK)' AND sku IS NOT NULL AND sku_name IS NOT NULL AND uom IS NOT NULL
  GROUP BY sku, sku_name
),
pl_van AS (
  SELECT sku, sku_name,
         COALESCE(SUM(CASE WHEN uom = 'Case' THEN price_vat END), 0) AS case_price,
         COALESCE(SUM(CASE WHEN uom = 'Subcase' THEN price_vat END), 0) AS subcase_price,
         COALESCE(SUM(CASE WHEN uom = 'Piece' THEN price_vat END), 0) AS piece_price
  FROM pl_base
  WHERE channel = 'VAN(EXTRUCK)' AND sku IS NOT NULL AND sku_name IS NOT NULL AND uom IS NOT NULL
  GROUP BY sku, sku_name
),
price_ref AS (
  SELECT sku, a.nonvan_price, b.van_price
  FROM (SELECT sku, case_price AS nonvan_price FROM pl_nonvan) a
  FULL OUTER JOIN (SELECT sku, case_price AS van_price FROM pl_van) b USING (sku)
)"""


def enriched(facts: str) -> str:
    """Calendar (inner), customer, category on the raw SKU, supervisor; prices and free goods on the stripped SKU."""
    return f"""
  SELECT x.*, pr.nonvan_price, pr.van_price, fg.case_size
  FROM (
    SELECT f.* EXCLUDE (sku), replace(f.sku, '_old', '') AS sku, cal.week,
           c.customer_name, c.customer_class, c.account_group, c.rep_id, c.rep_name, c.branch, c.barangay,
           c.city, c.province, c.channel, cat.category, sup.supervisor
    FROM {facts} f
    JOIN d_calendar cal ON cal.txn_date = f.txn_date
    LEFT JOIN d_customer c ON c.customer_id = f.customer_id
    LEFT JOIN d_category cat ON cat.sku = f.sku
    LEFT JOIN d_supervisor sup ON sup.rep_id = c.rep_id
  ) x
  LEFT JOIN price_ref pr ON pr.sku = x.sku
  LEFT JOIN d_free_goods fg ON fg.sku = x.sku"""


def volume(value: str) -> str:
    return f"""CASE
      WHEN case_size IS NOT NULL AND COALESCE(uom IN ('Case', 'INF_PROD_CAS'), false) THEN TRY_CAST(qty AS DOUBLE)
      WHEN case_size IS NOT NULL AND NOT COALESCE(uom IN ('Case', 'INF_PROD_CAS'), false)
           AND CAST(case_size AS DOUBLE) > 0 THEN TRY_CAST(qty AS DOUBLE) / CAST(case_size AS DOUBLE)
      WHEN channel = 'VAN(EXTRUCK)' AND COALESCE(TRY_CAST(van_price AS DOUBLE), 0) <> 0
           THEN CAST({value} AS DOUBLE) / CAST(van_price AS DOUBLE)
      WHEN channel = 'BOOK(Booking)' AND COALESCE(TRY_CAST(nonvan_price AS DOUBLE), 0) <> 0
           THEN CAST({value} AS DOUBLE) / CAST(nonvan_price AS DOUBLE)
      ELSE 0.0 END"""


def _with(*extra: str) -> str:
    parts = [DOMAIN.strip(), STAGES.strip(), *[e.strip() for e in extra]]
    return "WITH " + ",\n".join(parts) + "\n"


NET_INVOICED = _with(
    f"""net_facts AS (
  SELECT txn_date, customer_id, sku, sku_name, uom, qty, served, bad_returns, good_returns FROM inv_clean
  UNION ALL
  SELECT txn_date, customer_id, sku, sku_name, uom, qty, CAST(0 AS DECIMAL(12,2)), bad_returns, good_returns
  FROM ret_pivot
)""",
    f"""net_enriched AS ({enriched('net_facts')}
)""",
) + f"""
SELECT 'Demo Distributor' AS distributor, CAST(e.txn_date AS VARCHAR) AS txn_date, e.week, e.branch, e.rep_id,
       e.rep_name, e.account_group, e.customer_id, e.customer_name, e.category, e.sku, e.sku_name,
       {volume('e.served - e.bad_returns - e.good_returns')} AS volume,
       CAST(e.served - e.bad_returns - e.good_returns AS DOUBLE) AS net_value,
       CAST(e.good_returns AS DOUBLE) AS good_returns, CAST(e.bad_returns AS DOUBLE) AS bad_returns,
       e.customer_class, e.barangay, e.city AS town, e.province, e.supervisor, e.channel AS route_model,
       g.gt_channel
FROM net_enriched e LEFT JOIN d_gt_channel g ON g.customer_class = e.customer_class
"""


def _order_report(facts: str, value: str) -> str:
    return _with(f"""rep AS ({enriched(facts)}
)""") + f"""
SELECT 'Demo Distributor' AS distributor, CAST(txn_date AS VARCHAR) AS txn_date, week, branch, rep_id, rep_name,
       account_group, customer_id, customer_name, category, sku, sku_name,
       {volume(value)} AS volume, CAST({value} AS DOUBLE) AS value, supervisor, customer_class
FROM rep
"""


SALES_ORDER = _order_report("so_clean", "value")
SERVED_INVOICE = _order_report("inv_clean", "served")

VOLUME_RULE = _with(f"""rep AS ({enriched('inv_clean')}
)""") + f"""
SELECT CAST(txn_date AS VARCHAR) AS txn_date, customer_id, sku, uom, CAST(qty AS DOUBLE) AS qty, channel,
       CAST(nonvan_price AS DOUBLE) AS nonvan_price, CAST(van_price AS DOUBLE) AS van_price,
       CAST(case_size AS DOUBLE) AS case_size, {volume('served')} AS volume
FROM rep
"""

CUSTOMER_MASTER_COLS = [
    "branch", "classification", "supervisor", "channel", "rep_id", "rep_name", "customer_id", "customer_name",
    "barangay", "city", "province", "status", "retail_env", "customer_class", "coverage_day", "coverage_weeks",
    "freq_count", "freq", "is_new",
]
_TIE = [c for c in CUSTOMER_MASTER_COLS if c != "customer_id"] + ["created_on"]

ROUTE_COVERAGE = """route_split AS (
  SELECT customer_id, string_split(route_code, '_') AS parts FROM d_route
),
route_cov0 AS (
  SELECT customer_id, COALESCE(parts[2], '') AS coverage_day, array_to_string(parts[3:], '_') AS raw_weeks
  FROM route_split
),
route_cov AS (
  SELECT customer_id, coverage_day,
         CASE raw_weeks WHEN 'WK1_WK3' THEN 'W1&W3' WHEN 'WK2_WK4' THEN 'W2&W4' ELSE raw_weeks END AS coverage_weeks
  FROM route_cov0
),
route_freq AS (
  SELECT customer_id, coverage_day, coverage_weeks,
         CASE WHEN contains(coverage_weeks, 'WKLY') THEN 'F4'
              WHEN contains(coverage_weeks, 'WK') OR contains(coverage_weeks, '&') THEN 'F2' ELSE '' END AS freq
  FROM route_cov
)"""

CUSTOMER_MASTER = _with(ROUTE_COVERAGE, r"""cml0 AS (
  SELECT c.branch, c.channel, c.rep_id, c.rep_name, c.customer_id, c.customer_name, c.barangay, c.city,
         c.province, c.status, c.retail_env, c.customer_class, c.created,
         CASE WHEN c.status = 'Blocked/On hold' THEN 'NA' ELSE r.coverage_day END AS coverage_day,
         CASE WHEN c.status = 'Blocked/On hold' THEN 'NA' ELSE r.coverage_weeks END AS coverage_weeks,
         CASE WHEN c.status = 'Blocked/On hold' THEN 'NA' ELSE r.freq END AS freq,
         CAST(CASE WHEN c.status = 'Active/Approved' THEN 1 ELSE 0 END AS BIGINT) AS freq_count
  FROM d_customer c LEFT JOIN route_freq r ON r.customer_id = c.customer_id
  WHERE c.status IS DISTINCT FROM 'Approval On Hold'
),
cml1 AS (
  SELECT m.*,
         CASE WHEN m.customer_id IN ('C7', 'C11', 'C300') THEN 'H ACCT' ELSE cl.classification END AS classification,
         s.supervisor,
         CASE WHEN n.is_new IS NULL OR regexp_matches(n.is_new, '^\s*$') THEN 'YES' ELSE n.is_new END AS is_new,
         CAST(try_strptime(m.created, '%m/%d/%Y') AS DATE) AS created_on
  FROM cml0 m
  LEFT JOIN (SELECT customer_class, classification FROM d_classification
             WHERE customer_class IS NOT NULL AND classification IS NOT NULL) cl ON cl.customer_class = m.customer_class
  LEFT JOIN (SELECT rep_id, supervisor FROM d_supervisor WHERE rep_id IS NOT NULL AND supervisor IS NOT NULL) s
         ON s.rep_id = m.rep_id
  LEFT JOIN d_new_customer n ON n.customer_id = m.customer_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_on ASC NULLS LAST, """
    + ", ".join(f"{c} ASC NULLS FIRST" for c in _TIE) + """) AS rn
  FROM cml1
)""") + "SELECT " + ", ".join(CUSTOMER_MASTER_COLS) + " FROM ranked WHERE rn = 1\n"

NET_SELLOUT_BODY = """
SELECT doc_no, CAST(txn_date AS VARCHAR) AS txn_date, rep_id, customer_id, customer_name, item_code AS sku, sku_name,
       uom, CAST(qty AS DOUBLE) AS qty
FROM d_invoice WHERE item_type IS DISTINCT FROM 'ITM_SALES_TAX' AND COALESCE(contains(item_code, '12'), false)
UNION ALL
SELECT doc_no, CAST(txn_date AS VARCHAR), rep_id, customer_id, customer_name, sku, sku_name, uom,
       CAST(-abs(qty) AS DOUBLE)
FROM d_returns WHERE return_type IS DISTINCT FROM 'CUSTOMER_RETURN' AND COALESCE(contains(sku, '12'), false)
"""
NET_SELLOUT = _with() + NET_SELLOUT_BODY

CATALOGUE = """catalogue_src AS (
  SELECT sku, sku_name, 0 AS source FROM inv_clean
  UNION ALL SELECT sku, sku_name, 1 FROM ret_pivot
  UNION ALL SELECT sku, sku_name, 2 FROM so_clean
),
catalogue AS (
  SELECT sku, sku_name FROM (
    SELECT sku, sku_name, row_number() OVER (PARTITION BY sku ORDER BY source, sku_name ASC NULLS LAST) AS rn
    FROM catalogue_src) WHERE rn = 1
),
uncategorized AS (
  SELECT DISTINCT sku, sku_name FROM catalogue c
  WHERE NOT EXISTS (SELECT 1 FROM d_category k
                    WHERE k.sku = c.sku AND k.category IS NOT NULL AND NOT regexp_matches(k.category, '^\\s*$'))
)"""


def _loss() -> str:
    keys = ["txn_date", "customer_id", "sku", "sku_name", "uom", "qty"]
    missing = " OR ".join(f"{k} IS NULL" for k in keys)

    def fanout(table: str, key: str, name: str) -> str:
        return (f"SELECT '{name}' AS metric, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS rows FROM "
                f"(SELECT count(*) AS n FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})")

    def not_in_cal(table: str, name: str) -> str:
        return (f"SELECT '{name}', CAST(count(*) AS BIGINT) FROM {table} t "
                f"WHERE NOT EXISTS (SELECT 1 FROM d_calendar c WHERE c.txn_date = t.txn_date)")

    return _with() + "\nUNION ALL\n".join([
        f"SELECT 'returns_missing_pivot_key' AS metric, CAST(count(*) FILTER (WHERE {missing}) AS BIGINT) AS rows "
        f"FROM ret_clean",
        f"SELECT 'returns_unknown_facility', CAST(count(*) FILTER (WHERE NOT ({missing}) AND facility_class IS NULL) "
        f"AS BIGINT) FROM ret_clean",
        not_in_cal("inv_clean", "invoices_not_in_calendar"),
        not_in_cal("ret_pivot", "returns_not_in_calendar"),
        not_in_cal("so_clean", "orders_not_in_calendar"),
        "SELECT 'created_date_rejects', CAST(count(*) FILTER (WHERE try_strptime(created, '%m/%d/%Y') IS NULL) "
        "AS BIGINT) FROM d_customer",
        fanout("d_customer", "customer_id", "customer_key_fanout"),
        fanout("d_category", "sku", "category_key_fanout"),
        fanout("d_supervisor", "rep_id", "supervisor_key_fanout"),
        fanout("d_free_goods", "sku", "free_goods_key_fanout"),
        fanout("d_calendar", "txn_date", "calendar_key_fanout"),
        fanout("d_gt_channel", "customer_class", "gt_channel_key_fanout"),
        fanout("d_classification", "customer_class", "classification_key_fanout"),
        fanout("d_route", "customer_id", "route_key_fanout"),
        fanout("d_new_customer", "customer_id", "new_customer_key_fanout"),
    ]) + "\n"


def _price_fanout() -> str:
    surplus = "\nUNION ALL\n".join(
        f"SELECT '{name}_key_fanout' AS metric, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS rows "
        f"FROM (SELECT count(*) AS n FROM {table} GROUP BY sku)"
        for name, table in [("price_nonvan", "one"), ("price_van", "two"), ("price_reference", "joined")])
    return _with("""relabelled AS (
  SELECT sku, sku_name, channel FROM d_price WHERE price_class IS DISTINCT FROM 'BEV Dealer'
  UNION ALL
  SELECT sku, sku_name || ' (new label)', channel FROM d_price
  WHERE price_class IS DISTINCT FROM 'BEV Dealer' AND sku LIKE '%7'
),
one AS (SELECT DISTINCT sku, sku_name FROM relabelled WHERE channel IS DISTINCT FROM 'VAN(EXTRUCK)'),
two AS (SELECT DISTINCT sku, sku_name FROM relabelled WHERE channel = 'VAN(EXTRUCK)'),
joined AS (SELECT sku FROM one FULL OUTER JOIN two USING (sku))""") + surplus


def _daily_totals() -> str:
    reports = [("net_invoiced", NET_INVOICED, ["net_value", "good_returns", "bad_returns", "volume"]),
               ("sales_order", SALES_ORDER, ["value", "volume"]), ("served_invoice", SERVED_INVOICE, ["value", "volume"]),
               ("net_sellout", NET_SELLOUT, ["qty"])]
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS report, '{c}' AS column_name, "
        f"round(CAST(SUM({c if c == 'volume' else f'CAST({c} AS DECIMAL(28,8))'}) AS DOUBLE), 4) AS total FROM ({sql})"
        for name, sql, cols in reports for c in cols)


def _missing(table: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) "
        f"AS missing FROM d_{table}" for c in cols)


ORACLE_SQL: dict[str, str] = {
    "empty_rerun": _with() + """
SELECT d.report_date, CAST(0 AS BIGINT) AS first_rows, CAST(CASE WHEN d.kept THEN s.n ELSE 0 END AS BIGINT) AS rows,
       CASE WHEN d.kept THEN s.qty END AS qty
FROM (VALUES ('2026-01-01', false), ('2026-01-02', false), ('2026-01-03', true)) AS d(report_date, kept),
     (SELECT count(*) AS n, SUM(qty) AS qty FROM (""" + NET_SELLOUT_BODY + """)) s""",
    "checked_parquet": _with() + "SELECT sku, CAST(CAST(case_size AS INTEGER) AS DOUBLE) AS case_size FROM d_free_goods",
    "rejected_cells": _with() + """
SELECT doc_no, sku, 'qty' AS column_name, sku || ' pcs' AS text FROM d_invoice WHERE uom = 'Subcase' AND sku IS NOT NULL
UNION ALL
SELECT doc_no, sku, 'txn_date', 'day ' || doc_no FROM d_invoice WHERE uom = 'Piece' AND doc_no IS NOT NULL""",
    "report_rollup": "SELECT CAST(bit_count(GROUPING_ID(branch, rep_id)) AS INTEGER) AS level, branch, rep_id, CAST(count(*) AS BIGINT) AS rows, "
                     "CAST(SUM(net_value_d) AS DOUBLE) AS net_value, CAST(SUM(good_d) AS DOUBLE) AS good_returns, "
                     "CAST(SUM(bad_d) AS DOUBLE) AS bad_returns FROM ("
                     + NET_INVOICED.replace(
                         "CAST(e.served - e.bad_returns - e.good_returns AS DOUBLE) AS net_value,",
                         "e.served - e.bad_returns - e.good_returns AS net_value_d, e.good_returns AS good_d, "
                         "e.bad_returns AS bad_d, CAST(e.served - e.bad_returns - e.good_returns AS DOUBLE) "
                         "AS net_value,") + ") GROUP BY ROLLUP (branch, rep_id)",
    "ordered_write": _with() + """
SELECT txn_date, doc_no, sku, qty,
       row_number() OVER (ORDER BY txn_date ASC NULLS LAST, doc_no ASC NULLS LAST, sku ASC NULLS LAST, qty ASC NULLS LAST) AS place
FROM (""" + NET_SELLOUT_BODY + """)""",
    "csv_read_by_name": _with() + """
SELECT sku, sku_name, uom, CAST(price AS DOUBLE) AS price, price_class, channel FROM d_price""",
    "optional_source": _with() + """
SELECT 'present' AS table_name, CAST(count(*) AS BIGINT) AS rows FROM d_route
UNION ALL SELECT 'absent', CAST(0 AS BIGINT)""",
    "header_offset_ingest": _with() + "SELECT CAST(txn_date AS VARCHAR) AS txn_date, week FROM d_calendar",
    "positional_ingest": _with() + "SELECT customer_id AS owner, route_code AS code FROM d_route",
    "missing_tokens": _with() + "SELECT customer_id, NULLIF(created, 'N/A') AS created FROM d_customer",
    "workbook_columns": _with() + """
SELECT 'invoice' AS extract, sku, CAST(count(*) AS BIGINT) AS rows FROM d_invoice GROUP BY sku
UNION ALL SELECT 'returns', sku, CAST(count(*) AS BIGINT) FROM d_returns GROUP BY sku""",
    "tolerant_text": _with() + """
SELECT doc_no, sku, uom, TRY_CAST(CASE uom WHEN 'Subcase' THEN CAST(qty AS VARCHAR) || ' pcs' WHEN 'Piece' THEN ''
                                  ELSE CAST(qty AS VARCHAR) END AS DOUBLE) AS qty
FROM d_invoice""",
    "complete_references": _with() + """
SELECT 'free_goods' AS table_name, sku AS key FROM d_free_goods WHERE sku IS NOT NULL AND case_size IS NOT NULL
UNION ALL SELECT 'customer', customer_id FROM d_customer WHERE rep_id IS NOT NULL AND status IS NOT NULL""",
    "price_fanout": _price_fanout(),
    "daily_totals": _daily_totals(),
    "required_values": _with() + "\nUNION ALL\n".join([
        _missing("invoice", ["txn_date", "customer_id", "sku", "uom", "qty", "item_type"]),
        _missing("returns", ["txn_date", "customer_id", "sku", "uom", "facility", "return_type"]),
        _missing("sales_order", ["txn_date", "customer_id", "sku", "uom", "status"]),
        _missing("customer", ["customer_id", "rep_id", "status", "created"]),
    ]),
    "null_keeping_filter": _with() + """
SELECT doc_no, sku, item_type, CAST(qty AS DOUBLE) AS qty FROM d_invoice
WHERE item_type IS DISTINCT FROM 'ITM_SALES_TAX'""",
    "token_filter": _with() + "SELECT doc_no, item_code FROM d_invoice WHERE COALESCE(contains(item_code, '12'), false)",
    "vat_amount": _with() + """
SELECT doc_no, sku, CAST(COALESCE(amount, 0) * CAST('1.12' AS DECIMAL(3,2)) AS DOUBLE) AS amount_vat FROM d_returns""",
    "enrich_left": _with() + """
SELECT i.customer_id, i.doc_no, i.sku, CAST(i.qty AS DOUBLE) AS qty, c.channel, c.rep_id
FROM d_invoice i LEFT JOIN d_customer c ON c.customer_id = i.customer_id""",
    "calendar_inner": _with() + """
SELECT CAST(s.txn_date AS VARCHAR) AS txn_date, s.order_no, s.sku, c.week
FROM d_sales_order s JOIN d_calendar c ON c.txn_date = s.txn_date""",
    "price_outer": _with() + """
SELECT sku, CAST(nonvan_price AS DOUBLE) AS nonvan_price, CAST(van_price AS DOUBLE) AS van_price FROM price_ref""",
    "deduct_invoices": _with() + """
SELECT i.doc_no, i.sku, CAST(i.qty AS DOUBLE) AS qty FROM d_invoice i
WHERE NOT EXISTS (SELECT 1 FROM d_deductions d WHERE d.invoice_key = i.doc_no || '_' || i.sku)""",
    "deducted_only": _with() + """
SELECT i.doc_no, i.sku, CAST(i.qty AS DOUBLE) AS qty FROM d_invoice i
WHERE EXISTS (SELECT 1 FROM d_deductions d WHERE d.invoice_key = i.doc_no || '_' || i.sku)""",
    "deduct_orders": _with() + """
SELECT CAST(txn_date AS VARCHAR) AS txn_date, customer_id, sku, sku_name, uom, CAST(qty AS DOUBLE) AS qty,
       CAST(value AS DOUBLE) AS value FROM so_clean""",
    "uncategorized_skus": _with(CATALOGUE) + "SELECT sku, sku_name FROM uncategorized",
    "returns_pivot": _with() + """
SELECT CAST(txn_date AS VARCHAR) AS txn_date, customer_id, sku, sku_name, uom, CAST(qty AS DOUBLE) AS qty,
       CAST(bad_returns AS DOUBLE) AS bad_returns, CAST(good_returns AS DOUBLE) AS good_returns FROM ret_pivot""",
    "returns_pivot_coarse": _with() + """
SELECT customer_id, strftime(txn_date, '%Y-%m') AS month,
       CAST(COALESCE(SUM(CASE WHEN facility_class = 'BO' THEN amount_vat END), 0) AS DOUBLE) AS bad_returns,
       CAST(COALESCE(SUM(CASE WHEN facility_class = 'FG' THEN amount_vat END), 0) AS DOUBLE) AS good_returns
FROM ret_clean
WHERE customer_id IS NOT NULL AND txn_date IS NOT NULL AND facility_class IN ('BO', 'FG')
GROUP BY customer_id, strftime(txn_date, '%Y-%m')""",
    "price_list_nonvan": _with() + """
SELECT sku, sku_name, CAST(case_price AS DOUBLE) AS case_price, CAST(subcase_price AS DOUBLE) AS subcase_price,
       CAST(piece_price AS DOUBLE) AS piece_price FROM pl_nonvan""",
    "price_list_van": _with() + """
SELECT sku, sku_name, CAST(case_price AS DOUBLE) AS case_price, CAST(subcase_price AS DOUBLE) AS subcase_price,
       CAST(piece_price AS DOUBLE) AS piece_price FROM pl_van""",
    "non_null_counts": _with() + """
SELECT CAST(count(invoice_key) AS BIGINT) AS invoice_key, CAST(count(return_key) AS BIGINT) AS return_key
FROM d_deductions""",
    "report_totals": "SELECT CAST(SUM(net_value_d) AS DOUBLE) AS net_value, CAST(SUM(good_d) AS DOUBLE) AS "
                     "good_returns, CAST(SUM(bad_d) AS DOUBLE) AS bad_returns, round(SUM(volume), 4) AS volume FROM ("
                     + NET_INVOICED.replace(
                         "CAST(e.served - e.bad_returns - e.good_returns AS DOUBLE) AS net_value,",
                         "e.served - e.bad_returns - e.good_returns AS net_value_d, e.good_returns AS good_d, "
                         "e.bad_returns AS bad_d, CAST(e.served - e.bad_returns - e.good_returns AS DOUBLE) "
                         "AS net_value,") + ")",
    "extract_counts": _with() + "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS rows FROM d_{t}"
        for t in ["invoice", "returns", "sales_order", "customer", "route", "price", "deductions"]),
    "column_profile": "SELECT column_name, CAST(width AS BIGINT) AS width FROM (SELECT "
                      + ", ".join(f"COALESCE(max(length(CAST({c} AS VARCHAR))), 0) + 2 AS {c}"
                                  for c in ["branch", "customer_name", "category", "sku", "sku_name", "gt_channel"])
                      + " FROM (" + NET_INVOICED + ")) UNPIVOT (width FOR column_name IN ("
                      + ", ".join(["branch", "customer_name", "category", "sku", "sku_name", "gt_channel"]) + "))",
    "latest_customer_row": _with() + """
SELECT customer_id, status, created, CAST(created_on AS VARCHAR) AS created_on FROM (
  SELECT customer_id, status, created, CAST(try_strptime(created, '%m/%d/%Y') AS DATE) AS created_on,
         row_number() OVER (PARTITION BY customer_id ORDER BY CAST(try_strptime(created, '%m/%d/%Y') AS DATE)
                            ASC NULLS LAST, status ASC NULLS FIRST, created ASC NULLS FIRST) AS rn
  FROM d_customer) WHERE rn = 1""",
    "sku_union_first": _with(CATALOGUE) + "SELECT sku, sku_name FROM catalogue",
    "sorted_report": NET_SELLOUT,
    "union_by_name": _with() + """
SELECT doc_no, sku, CAST(qty AS DOUBLE) AS qty, item_type, CAST(NULL AS VARCHAR) AS return_type FROM d_invoice
UNION ALL
SELECT doc_no, sku, CAST(qty AS DOUBLE), NULL, return_type FROM d_returns""",
    "category_upsert": _with(CATALOGUE) + """
SELECT COALESCE(c.sku, u.sku) AS sku,
       CASE WHEN u.sku IS NOT NULL THEN 'UNASSIGNED' ELSE c.category END AS category,
       CASE WHEN u.sku IS NOT NULL THEN u.sku_name ELSE c.sku_name END AS sku_name
FROM d_category c FULL OUTER JOIN (
  SELECT sku, sku_name FROM (
    SELECT sku, sku_name, row_number() OVER (PARTITION BY sku ORDER BY sku_name ASC NULLS FIRST) AS rn
    FROM uncategorized) WHERE rn = 1) u ON u.sku = c.sku""",
    "category_versions": _with(CATALOGUE) + """
SELECT COALESCE(c.sku, u.sku) AS sku,
       CASE WHEN c.sku LIKE '%3' THEN 'THREE' WHEN u.sku IS NOT NULL THEN 'UNASSIGNED' ELSE c.category END AS category,
       CASE WHEN c.sku LIKE '%3' THEN c.sku_name WHEN u.sku IS NOT NULL THEN u.sku_name ELSE c.sku_name END AS sku_name
FROM d_category c FULL OUTER JOIN (
  SELECT sku, sku_name FROM (
    SELECT sku, sku_name, row_number() OVER (PARTITION BY sku ORDER BY sku_name ASC NULLS FIRST) AS rn
    FROM uncategorized) WHERE rn = 1) u ON u.sku = c.sku""",
    "deduct_sieved": _with() + """
SELECT i.doc_no, i.sku, CAST(i.qty AS DOUBLE) AS qty FROM d_invoice i
WHERE NOT EXISTS (SELECT 1 FROM d_deductions d WHERE d.invoice_key = i.doc_no || '_' || i.sku)""",
    "facility_extract": _with() + r"""
SELECT doc_no, sku, facility,
       NULLIF(regexp_extract(replace(facility, 'Virtual', 'FG'), '\b(FG|BO)\b', 1), '') AS facility_class
FROM d_returns""",
    "route_decode": _with(ROUTE_COVERAGE) + """
SELECT customer_id, route_code, coverage_day, coverage_weeks,
       CASE WHEN contains(coverage_weeks, 'WKLY') THEN 'F4'
            WHEN contains(coverage_weeks, 'WK') OR contains(coverage_weeks, '&') THEN 'F2' ELSE '' END AS freq
FROM (
  SELECT customer_id, route_code, COALESCE(parts[2], '') AS coverage_day,
         CASE array_to_string(parts[3:], '_') WHEN 'WK1_WK3' THEN 'W1&W3' WHEN 'WK2_WK4' THEN 'W2&W4'
              ELSE array_to_string(parts[3:], '_') END AS coverage_weeks
  FROM (SELECT customer_id, route_code, string_split(route_code, '_') AS parts FROM d_route))""",
    "blank_default": _with() + r"""
SELECT customer_id, is_new AS is_new_raw,
       CASE WHEN is_new IS NULL OR regexp_matches(is_new, '^\s*$') THEN 'YES' ELSE is_new END AS is_new
FROM d_new_customer""",
    "tolerant_numeric": _with() + """
SELECT i.doc_no, replace(i.sku, '_old', '') AS sku, CAST(i.qty AS DOUBLE) AS qty, CAST(f.case_size AS DOUBLE) AS case_size,
       CASE WHEN CAST(f.case_size AS DOUBLE) <> 0 THEN TRY_CAST(i.qty AS DOUBLE) / CAST(f.case_size AS DOUBLE) END
         AS per_case
FROM d_invoice i JOIN d_free_goods f ON f.sku = replace(i.sku, '_old', '')""",
    "date_parse_format": _with() + """
SELECT customer_id, created, CAST(d AS VARCHAR) AS created_on, strftime(d, '%B %-d, %Y') AS created_label,
       d IS NULL AS rejected
FROM (SELECT customer_id, created, CAST(try_strptime(created, '%m/%d/%Y') AS DATE) AS d FROM d_customer)""",
    "volume_rule": VOLUME_RULE,
    "net_invoiced": NET_INVOICED,
    "sales_order": SALES_ORDER,
    "served_invoice": SERVED_INVOICE,
    "customer_master": CUSTOMER_MASTER,
    "net_sellout": NET_SELLOUT,
    "loss_metrics": _loss(),
    "partition_roundtrip": NET_SELLOUT,
    "renamed_report": "SELECT doc_no AS document, txn_date AS transaction_date, rep_id AS employee, customer_id, "
                      "customer_name, sku, sku_name, uom, qty AS quantity FROM (" + NET_SELLOUT + ")",
    "workbook_ingest": _with() + """
SELECT customer_id, customer_name, customer_class, account_group, rep_id, rep_name, branch, barangay, city, province,
       channel, status, retail_env, created FROM d_customer""",
}
