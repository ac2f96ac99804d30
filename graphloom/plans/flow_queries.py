"""Queries that run data flows on the order tables: look-ups, splits, merges, ratios, windows and sub-queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import dataflow as flow
from graphloom.plans.tables import table

_MONEY = "decimal(18,2)"
_money = lambda c: F.round(F.col(c) if isinstance(c, str) else c, 2).cast(_MONEY)
_sum = lambda c: F.sum(_money(c)).cast("decimal(28,2)")
_M = lambda e: f"CAST(round({e}, 2) AS DECIMAL(18,2))"
_S = lambda e: f"CAST(sum({_M(e)}) AS DECIMAL(28,2))"


def lookup_redirect(spark: SparkSession, d: str) -> DataFrame:
    """Orders with and without a customer of a segment."""
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    match, missing = flow.lookup(orders, customers, F.col("o_custkey") == F.col("c_custkey"))
    both = match.withColumn("way", F.lit("match")).unionByName(missing.withColumn("way", F.lit("redirect")))
    return both.groupBy("way", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), _sum("o_totalprice").alias("total"))


LOOKUP_REDIRECT = f"SELECT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'match' ELSE 'redirect' END AS way, o_orderstatus, count(*) AS n, {_S('o_totalprice')} AS total FROM orders GROUP BY 1, 2"


def conditional_split(spark: SparkSession, d: str) -> DataFrame:
    valid = (F.col("l_quantity") > 0) & (F.col("l_discount") <= 0.05) & F.col("l_returnflag").isin("N", "R")
    good, bad = flow.split(table(spark, d, "lineitem"), valid)
    both = good.withColumn("way", F.lit("valid")).unionByName(bad.withColumn("way", F.lit("invalid")))
    return both.groupBy("way").agg(F.count(F.lit(1)).alias("n"), _sum("l_extendedprice").alias("total"))


CONDITIONAL_SPLIT = f"SELECT CASE WHEN l_quantity > 0 AND l_discount <= 0.05 AND l_returnflag IN ('N', 'R') THEN 'valid' ELSE 'invalid' END AS way, count(*) AS n, {_S('l_extendedprice')} AS total FROM lineitem GROUP BY 1"


def quarantine_union(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    no_tax = lines.filter("l_tax = 0").select(F.col("l_orderkey").alias("key"))
    cheap = orders.filter("o_totalprice < 5000").select(F.col("o_orderkey").alias("key"))
    return flow.quarantine(("no tax", no_tax), ("cheap", cheap)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"))


QUARANTINE_UNION = "SELECT reason, count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT 'no tax' AS reason, l_orderkey AS key FROM lineitem WHERE l_tax = 0 UNION ALL SELECT 'cheap', o_orderkey FROM orders WHERE o_totalprice < 5000) GROUP BY reason"


def match_merge_recon(spark: SparkSession, d: str) -> DataFrame:
    """Orders against the totals of their lines."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), _money("o_totalprice").alias("order_total"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(_sum("l_extendedprice").alias("line_total"))
    merged = flow.match_merge(orders, lines, "key")
    off = F.abs(F.coalesce("order_total", F.lit(0)) - F.coalesce("line_total", F.lit(0))) > 0.01
    return merged.groupBy("match_state").agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("differ"), F.sum("order_total").cast("decimal(28,2)").alias("order_total"), F.sum("line_total").cast("decimal(28,2)").alias("line_total"))


MATCH_MERGE = f"""WITH o AS (SELECT o_orderkey AS key, {_M('o_totalprice')} AS ot FROM orders), l AS (SELECT l_orderkey AS key, {_S('l_extendedprice')} AS lt FROM lineitem GROUP BY 1)
SELECT CASE WHEN l.key IS NULL THEN 'MISSING' WHEN o.key IS NULL THEN 'ORPHAN' ELSE 'MATCHED' END AS match_state, count(*) AS n, count(*) FILTER (WHERE abs(coalesce(ot, 0) - coalesce(lt, 0)) > 0.01) AS differ, CAST(sum(ot) AS DECIMAL(28,2)) AS order_total, CAST(sum(lt) AS DECIMAL(28,2)) AS line_total FROM o FULL JOIN l ON o.key = l.key GROUP BY 1"""


def control_totals(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), _sum(F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).otherwise(0)).alias("returned"), _sum(F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")).otherwise(0)).alias("kept"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))


CONTROL_TOTALS = f"SELECT l_linestatus, count(*) AS n, {_S('CASE WHEN l_returnflag = ' + chr(39) + 'A' + chr(39) + ' THEN l_extendedprice ELSE 0 END')} AS returned, {_S('CASE WHEN l_returnflag <> ' + chr(39) + 'A' + chr(39) + ' THEN l_extendedprice ELSE 0 END')} AS kept, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1"


def kpi_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Losses and commissions against premiums, guarded against nothing."""
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(_sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0)).alias("incurred"), _sum(F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).otherwise(0)).alias("earned"))
    ratio = flow.ratio_percent(F.col("incurred").cast("double"), F.col("earned").cast("double"))
    return sums.select("l_suppkey", "incurred", "earned", F.round(ratio, 4).alias("loss_ratio"), (F.col("earned") - F.col("incurred")).cast("decimal(28,2)").alias("profit"))


KPI_RATIOS = f"""WITH s AS (SELECT l_suppkey, {_S("CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END")} AS incurred, {_S("CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0 END")} AS earned FROM lineitem GROUP BY 1)
SELECT l_suppkey, incurred, earned, round(CASE WHEN earned = 0 THEN 0.0 ELSE CAST(incurred AS DOUBLE) / CAST(earned AS DOUBLE) * 100 END, 4) AS loss_ratio, CAST(earned - incurred AS DECIMAL(28,2)) AS profit FROM s"""


def retention_by_month(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    counts = orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return counts.withColumn("retention", F.round(flow.ratio_percent(F.col("done").cast("double"), F.col("n").cast("double")), 4))


RETENTION = "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100, 4) AS retention FROM orders GROUP BY 1, 2"


def earned_prorata(spark: SparkSession, d: str) -> DataFrame:
    """Order totals earned over a year, up to a day."""
    begin = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", flow.earned(F.floor("o_totalprice").cast(_MONEY), begin, F.date_add(begin, 364), F.lit("1998-06-30").cast("date")).alias("earned"))


EARNED = """SELECT o_orderkey, CAST(least(greatest(round(w * least(greatest(date_diff('day', b, DATE '1998-06-30') + 1, 0), 365) / 365.0, 2), 0), w) AS DECIMAL(18,2)) AS earned FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS DECIMAL(18,2)) AS w, CAST(o_orderdate AS DATE) AS b FROM orders)"""


def status_derivation(spark: SparkSession, d: str) -> DataFrame:
    begin = F.to_date("o_orderdate")
    status = flow.policy_status(F.when(F.col("o_orderpriority") == "1-URGENT", "CN").otherwise("AC"), begin, F.date_add(begin, 364), F.lit("1998-01-01").cast("date"))
    return table(spark, d, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


STATUS = "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'CN' WHEN DATE '1998-01-01' < b THEN 'PN' WHEN DATE '1998-01-01' > b + 364 THEN 'EX' ELSE 'AC' END AS status, count(*) AS n FROM (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS b FROM orders) GROUP BY 1"


def claims_rollup_having(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    amount = _sum(F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")))
    return joined.groupBy("p_brand", "s_nationkey").agg(amount.alias("amount")).filter("amount <> 0 AND amount > 100000").distinct()


CLAIMS_ROLLUP = f"""SELECT DISTINCT p_brand, s_nationkey, {_S("CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END")} AS amount FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 HAVING amount <> 0 AND amount > 100000"""


def row_number_case(spark: SparkSession, d: str) -> DataFrame:
    """The first order of a customer is new, later ones renew."""
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.when(n == 1, "NEW").otherwise("RENEWAL").alias("kind"))


ROW_NUMBER = "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'NEW' ELSE 'RENEWAL' END AS kind FROM orders"


def correlated_sum(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the sum of their finished orders, 0 without any."""
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(_sum("o_totalprice").alias("done"))
    return table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("done", F.lit(0)).cast("decimal(28,2)").alias("done"))


CORRELATED_SUM = f"SELECT c_custkey, CAST(coalesce((SELECT {_S('o_totalprice')} FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0) AS DECIMAL(28,2)) AS done FROM customer"


def union_all_branches(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    code = F.concat(F.rpad(F.col("l_returnflag"), 3, " "), F.right(F.rtrim(F.lpad(F.col("l_suppkey").cast("string"), 6, "0")), F.lit(3)), F.date_format("l_shipdate", "MMddyyyy"))
    one = lines.filter("l_quantity BETWEEN 1 AND 5 AND l_returnflag IN ('A', 'R')").select(F.lit("small").alias("branch"), code.alias("code"))
    two = lines.filter("l_quantity > 45 AND l_returnflag NOT IN ('A')").select(F.lit("large").alias("branch"), code.alias("code"))
    return one.unionByName(two).groupBy("branch", "code").agg(F.count(F.lit(1)).alias("n"))


_CODE = "rpad(l_returnflag, 3, ' ') || right(rtrim(lpad(CAST(l_suppkey AS VARCHAR), 6, '0')), 3) || strftime(l_shipdate, '%m%d%Y')"
UNION_ALL = f"SELECT branch, code, count(*) AS n FROM (SELECT 'small' AS branch, {_CODE} AS code FROM lineitem WHERE l_quantity BETWEEN 1 AND 5 AND l_returnflag IN ('A', 'R') UNION ALL SELECT 'large', {_CODE} FROM lineitem WHERE l_quantity > 45 AND l_returnflag NOT IN ('A')) GROUP BY 1, 2"


def sorted_merge_join(spark: SparkSession, d: str) -> DataFrame:
    """Yearly volumes of suppliers beside their nations, the second side optional."""
    volume = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(_sum("l_extendedprice").alias("volume"))
    return volume.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation").filter("n_nationkey < 12"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name", "y").agg(F.sum("volume").cast("decimal(28,2)").alias("volume"), F.count(F.lit(1)).alias("suppliers"))


MERGE_JOIN = f"SELECT n_name, y, CAST(sum(volume) AS DECIMAL(28,2)) AS volume, count(*) AS suppliers FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS y, {_S('l_extendedprice')} AS volume FROM lineitem GROUP BY 1, 2) v JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) n ON s_nationkey = n_nationkey GROUP BY 1, 2"


def keyed_load(spark: SparkSession, d: str) -> DataFrame:
    """Lines loaded by order and number as one key: the first of each, the rest rejected."""
    lines = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "l_partkey", "l_suppkey", "l_shipdate").distinct()
    first, rejected = flow.keyed_load(lines, "key", "l_partkey", "l_suppkey", "l_shipdate")
    return first.withColumn("reject", F.lit("LOADED")).unionByName(rejected).groupBy("reject").agg(F.count(F.lit(1)).alias("n"))


KEYED_LOAD = "SELECT CASE WHEN r = 1 THEN 'LOADED' ELSE 'DUPLICATE' END AS reject, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY key ORDER BY l_partkey, l_suppkey, l_shipdate) AS r FROM (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS key, l_partkey, l_suppkey, l_shipdate FROM lineitem)) GROUP BY 1"


def template_grouped(spark: SparkSession, d: str) -> DataFrame:
    """One row a table of requested fields: brand as table, types as columns."""
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ", ").alias("Columns"))
    return rows.select(F.lit("UNKNOWN / Not specified").alias("Schema"), F.col("p_brand").alias("Table"), "Columns")


TEMPLATE_GROUPED = "SELECT 'UNKNOWN / Not specified' AS \"Schema\", p_brand AS \"Table\", string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS \"Columns\" FROM part GROUP BY p_brand"


def template_row_per_column(spark: SparkSession, d: str) -> DataFrame:
    grouped = template_grouped(spark, d)
    return grouped.select("Table", F.posexplode(F.split("Columns", ", ")).alias("pos", "Column")).select("Table", (F.col("pos") + 1).alias("Order"), "Column")


TEMPLATE_ROWS = f'SELECT "Table", CAST(generate_subscripts(l, 1) AS INTEGER) AS "Order", unnest(l) AS "Column" FROM (SELECT "Table", string_split("Columns", \', \') AS l FROM ({TEMPLATE_GROUPED}) t)'

QUERIES = {
    f.__name__: (f, sql)
    for f, sql in (
        (lookup_redirect, LOOKUP_REDIRECT), (conditional_split, CONDITIONAL_SPLIT), (quarantine_union, QUARANTINE_UNION), (match_merge_recon, MATCH_MERGE), (control_totals, CONTROL_TOTALS),
        (kpi_ratios, KPI_RATIOS), (retention_by_month, RETENTION), (earned_prorata, EARNED), (status_derivation, STATUS), (claims_rollup_having, CLAIMS_ROLLUP), (row_number_case, ROW_NUMBER),
        (correlated_sum, CORRELATED_SUM), (union_all_branches, UNION_ALL), (sorted_merge_join, MERGE_JOIN), (keyed_load, KEYED_LOAD), (template_grouped, TEMPLATE_GROUPED), (template_row_per_column, TEMPLATE_ROWS),
    )
}
