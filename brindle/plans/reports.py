"""The 22 reporting queries and seven micro-benchmarks as parameterised SQL.

``{table}`` marks a view, ``<name>`` a parameter.  Money is summed as DECIMAL
and shown as DOUBLE, so a result does not depend on the order of additions;
averages are sums divided by counts; ties at a limit are broken by a key.

The texts, literals and parameters of `published` are fixed values: they are
those of the published benchmark, and have to be for its results.  Where another
form plans better (one pass in place of a self-join, no forced broadcast),
`sql` holds that form and `published` is what it is tested against.  `standard`
has the parameters of the full schema, `testdata` those that select rows from
the reduced files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from brindle.sources import catalog

VOLUME = "l_extendedprice * (1 - l_discount)"


@dataclass(frozen=True)
class Report:
    sql: str
    standard: dict[str, str] = field(default_factory=dict)
    testdata: dict[str, str] = field(default_factory=dict)
    published: str | None = None

    def text(self, full: bool = False, published: bool = False, **values: str) -> str:
        """The query with its parameters: the standard ones on the full schema, else the test data's, unless given."""
        have = self.standard | ({} if full else self.testdata) | values
        sql = self.published if published and self.published else self.sql
        return re.sub(r"<(\w+)>", lambda m: have[m.group(1)], sql.replace("<VOLUME>", VOLUME))

    @property
    def views(self) -> tuple[str, ...]:
        return catalog.used_views(self.sql)

    def run(self, spark: SparkSession, sf_dir: str, **values: str) -> DataFrame:
        return self.over_views(spark, catalog.load(spark, sf_dir, self.views), **values)

    def over_views(self, spark: SparkSession, full: bool, **values: str) -> DataFrame:
        """The result over views that are registered."""
        return spark.sql(catalog.on_views(self.text(full, **values)))

    def oracle(self, full: bool = False) -> str:
        """One statement for another engine, in the published form; over reduced files unless `full`."""
        text = self.text(full, published=True)
        return catalog.on_views(text) if full else catalog.portable(text)


def _sums(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"CAST(SUM({expr}) AS DOUBLE) AS {name}" for expr, name in pairs)


REPORTS: dict[str, Report] = {
    "q01": Report(
        f"""SELECT l_returnflag, l_linestatus,
            {_sums(("l_quantity", "sum_qty"), ("l_extendedprice", "sum_base_price"), ("<VOLUME>", "sum_disc_price"), ("<VOLUME> * (1 + l_tax)", "sum_charge"))},
            CAST(SUM(l_quantity) AS DOUBLE) / COUNT(*) AS avg_qty, CAST(SUM(l_extendedprice) AS DOUBLE) / COUNT(*) AS avg_price, CAST(SUM(l_discount) AS DOUBLE) / COUNT(*) AS avg_disc,
            COUNT(*) AS count_order
            FROM {{lineitem}} WHERE l_shipdate <= DATE '<until>' - INTERVAL '90' DAY
            GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
        {"until": "1998-12-01"},
    ),
    "q02": Report(
        """WITH offers AS (SELECT s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment, ps_supplycost, MIN(ps_supplycost) OVER (PARTITION BY p_partkey) AS least
                FROM {part}, {partsupp}, {supplier}, {nation}, {region}
                WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = <size> AND p_type LIKE '<type>'
                AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = '<region>')
            SELECT CAST(s_acctbal AS DOUBLE) AS s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment
            FROM offers WHERE ps_supplycost = least ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
        {"size": "15", "type": "%BRASS", "region": "EUROPE"},
        {"type": "%O"},
        published="""SELECT CAST(s_acctbal AS DOUBLE) AS s_acctbal, s_name, n_name, p_partkey, p_mfgr, s_address, s_phone, s_comment
            FROM {part}, {supplier}, {partsupp}, {nation}, {region}
            WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = <size> AND p_type LIKE '<type>'
            AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = '<region>'
            AND ps_supplycost = (SELECT MIN(ps_supplycost) FROM {partsupp}, {supplier}, {nation}, {region}
                WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = '<region>')
            ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    ),
    "q03": Report(
        """SELECT l_orderkey, CAST(SUM(<VOLUME>) AS DOUBLE) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate, o_shippriority
            FROM {customer}, {orders}, {lineitem}
            WHERE c_mktsegment = '<segment>' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '<day>' AND l_shipdate > DATE '<day>'
            GROUP BY l_orderkey, o_orderdate, o_shippriority ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
        {"segment": "BUILDING", "day": "1995-03-15"},
        {"day": "1997-03-15"},
    ),
    "q04": Report(
        """SELECT o_orderpriority, COUNT(*) AS order_count FROM {orders}
            WHERE o_orderdate >= DATE '<day>' AND o_orderdate < DATE '<day>' + INTERVAL '3' MONTH
            AND EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate)
            GROUP BY o_orderpriority ORDER BY o_orderpriority""",
        {"day": "1993-07-01"},
        {"day": "1996-07-01"},
    ),
    "q05": Report(
        """SELECT n_name, CAST(SUM(<VOLUME>) AS DOUBLE) AS revenue
            FROM {region}, {nation}, {customer}, {orders}, {lineitem}, {supplier}
            WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND c_nationkey = n_nationkey
            AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = '<region>'
            AND o_orderdate >= DATE '<day>' AND o_orderdate < DATE '<day>' + INTERVAL '1' YEAR
            GROUP BY n_name ORDER BY revenue DESC, n_name""",
        {"region": "ASIA", "day": "1994-01-01"},
        {"day": "1996-01-01"},
    ),
    "q06": Report(
        """SELECT CAST(SUM(l_extendedprice * l_discount) AS DOUBLE) AS revenue FROM {lineitem}
            WHERE l_shipdate >= DATE '<day>' AND l_shipdate < DATE '<day>' + INTERVAL '1' YEAR
            AND l_discount BETWEEN <discount> - 0.01 AND <discount> + 0.01 AND l_quantity < <quantity>""",
        {"day": "1994-01-01", "discount": "0.06", "quantity": "24"},
        {"day": "1996-01-01"},
    ),
    "q07": Report(
        """SELECT supp_nation, cust_nation, l_year, CAST(SUM(volume) AS DOUBLE) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS INT) AS l_year, <VOLUME> AS volume
            FROM {nation} n1, {supplier}, {lineitem}, {orders}, {customer}, {nation} n2
            WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
            AND ((n1.n_name = '<one>' AND n2.n_name = '<other>') OR (n1.n_name = '<other>' AND n2.n_name = '<one>'))
            AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') AS shipping
            GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
        {"one": "FRANCE", "other": "GERMANY"},
        {"one": "NATION_6", "other": "NATION_7"},
    ),
    "q08": Report(
        """SELECT o_year, CAST(SUM(CASE WHEN nation = '<nation>' THEN volume ELSE 0 END) AS DOUBLE) / CAST(SUM(volume) AS DOUBLE) AS mkt_share FROM (
            SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, <VOLUME> AS volume, n2.n_name AS nation
            FROM {part}, {supplier}, {lineitem}, {orders}, {customer}, {nation} n1, {nation} n2, {region}
            WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
            AND n1.n_regionkey = r_regionkey AND r_name = '<region>' AND s_nationkey = n2.n_nationkey
            AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = '<type>') AS all_nations
            GROUP BY o_year ORDER BY o_year""",
        {"nation": "BRAZIL", "region": "AMERICA", "type": "ECONOMY ANODIZED STEEL"},
        {"nation": "NATION_6", "type": "ECONOMY"},
    ),
    "q09": Report(
        """SELECT nation, o_year, CAST(SUM(amount) AS DOUBLE) AS sum_profit FROM (
            SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS o_year, <VOLUME> - ps_supplycost * l_quantity AS amount
            FROM {part}, {supplier}, {lineitem}, {partsupp}, {orders}, {nation}
            WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
            AND s_nationkey = n_nationkey AND p_name LIKE '%<word>%') AS profit
            GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
        {"word": "green"},
        {"word": "widget"},
    ),
    "q10": Report(
        """SELECT c_custkey, c_name, CAST(SUM(<VOLUME>) AS DOUBLE) AS revenue, CAST(c_acctbal AS DOUBLE) AS c_acctbal, n_name, c_address, c_phone, c_comment
            FROM {customer}, {orders}, {lineitem}, {nation}
            WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '<day>' AND o_orderdate < DATE '<day>' + INTERVAL '3' MONTH
            AND l_returnflag = 'R' AND c_nationkey = n_nationkey
            GROUP BY c_custkey, c_name, c_acctbal, c_phone, n_name, c_address, c_comment ORDER BY revenue DESC, c_custkey LIMIT 20""",
        {"day": "1993-10-01"},
        {"day": "1996-10-01"},
    ),
    "q11": Report(
        """WITH held AS (SELECT ps_partkey, SUM(ps_supplycost * ps_availqty) AS value
                FROM {partsupp}, {supplier}, {nation} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = '<nation>' GROUP BY ps_partkey)
            SELECT ps_partkey, CAST(value AS DOUBLE) AS value FROM held
            WHERE CAST(value AS DOUBLE) > (SELECT CAST(SUM(value) AS DOUBLE) * CAST(<fraction> AS DOUBLE) FROM held)
            ORDER BY value DESC, ps_partkey""",
        {"nation": "GERMANY", "fraction": "0.0001"},
        {"nation": "NATION_7", "fraction": "0.001"},
        published="""SELECT ps_partkey, CAST(SUM(ps_supplycost * ps_availqty) AS DOUBLE) AS value
            FROM {partsupp}, {supplier}, {nation} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = '<nation>'
            GROUP BY ps_partkey
            HAVING CAST(SUM(ps_supplycost * ps_availqty) AS DOUBLE) > (SELECT CAST(SUM(ps_supplycost * ps_availqty) AS DOUBLE) * CAST(<fraction> AS DOUBLE)
                FROM {partsupp}, {supplier}, {nation} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = '<nation>')
            ORDER BY value DESC, ps_partkey""",
    ),
    "q12": Report(
        """SELECT l_shipmode,
            CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
            CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
            FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate
            AND l_receiptdate >= DATE '<day>' AND l_receiptdate < DATE '<day>' + INTERVAL '1' YEAR
            GROUP BY l_shipmode ORDER BY l_shipmode""",
        {"day": "1994-01-01"},
        {"day": "1996-01-01"},
    ),
    "q13": Report(
        """SELECT c_count, COUNT(*) AS custdist FROM (
            SELECT c_custkey, COUNT(o_orderkey) AS c_count FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_comment NOT LIKE '%special%requests%'
            GROUP BY c_custkey) AS c_orders
            GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    ),
    "q14": Report(
        """SELECT CAST(100 AS DOUBLE) * CAST(SUM(CASE WHEN p_type LIKE 'PROMO%' THEN <VOLUME> ELSE 0 END) AS DOUBLE) / CAST(SUM(<VOLUME>) AS DOUBLE) AS promo_revenue
            FROM {lineitem}, {part} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '<day>' AND l_shipdate < DATE '<day>' + INTERVAL '1' MONTH""",
        {"day": "1995-09-01"},
    ),
    "q15": Report(
        """WITH revenue0 AS (SELECT l_suppkey AS supplier_no, SUM(<VOLUME>) AS total_revenue FROM {lineitem}
            WHERE l_shipdate >= DATE '<day>' AND l_shipdate < DATE '<day>' + INTERVAL '3' MONTH GROUP BY l_suppkey),
            ranked AS (SELECT supplier_no, total_revenue, RANK() OVER (ORDER BY total_revenue DESC) AS place FROM revenue0 WHERE total_revenue IS NOT NULL)
            SELECT s_suppkey, s_name, s_address, s_phone, CAST(total_revenue AS DOUBLE) AS total_revenue FROM {supplier}, ranked
            WHERE s_suppkey = supplier_no AND place = 1 ORDER BY s_suppkey""",
        {"day": "1996-01-01"},
        published="""WITH revenue0 AS (SELECT l_suppkey AS supplier_no, SUM(<VOLUME>) AS total_revenue FROM {lineitem}
            WHERE l_shipdate >= DATE '<day>' AND l_shipdate < DATE '<day>' + INTERVAL '3' MONTH GROUP BY l_suppkey)
            SELECT s_suppkey, s_name, s_address, s_phone, CAST(total_revenue AS DOUBLE) AS total_revenue FROM {supplier}, revenue0
            WHERE s_suppkey = supplier_no AND total_revenue = (SELECT MAX(total_revenue) FROM revenue0) ORDER BY s_suppkey""",
    ),
    "q16": Report(
        """SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {partsupp}, {part}
            WHERE p_partkey = ps_partkey AND p_brand <> '<brand>' AND p_type NOT LIKE '<type>%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
            AND NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = ps_suppkey AND s_comment LIKE '%Customer%Complaints%')
            AND (SELECT COUNT(CASE WHEN s_suppkey IS NULL THEN 1 END) FROM {supplier} WHERE s_comment LIKE '%Customer%Complaints%') = 0
            AND (ps_suppkey IS NOT NULL OR (SELECT COUNT(*) FROM {supplier} WHERE s_comment LIKE '%Customer%Complaints%') = 0)
            GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
        {"brand": "Brand#45", "type": "MEDIUM POLISHED"},
        {"brand": "Brand#4", "type": "MEDIUM"},
        published="""SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt FROM {partsupp}, {part}
            WHERE p_partkey = ps_partkey AND p_brand <> '<brand>' AND p_type NOT LIKE '<type>%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
            AND ps_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_comment LIKE '%Customer%Complaints%')
            GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    ),
    "q17": Report(
        """SELECT CAST(SUM(l_extendedprice) AS DOUBLE) / 7.0 AS avg_yearly FROM (
            SELECT l_extendedprice, l_quantity, CAST(0.2 AS DOUBLE) * CAST(SUM(l_quantity) OVER (PARTITION BY l_partkey) AS DOUBLE) / COUNT(l_quantity) OVER (PARTITION BY l_partkey) AS least
            FROM {part}, {lineitem} WHERE p_partkey = l_partkey AND p_brand = '<brand>' AND p_container = '<container>') AS lines
            WHERE CAST(l_quantity AS DOUBLE) < least""",
        {"brand": "Brand#23", "container": "MED BOX"},
        published="""SELECT CAST(SUM(l_extendedprice) AS DOUBLE) / 7.0 AS avg_yearly FROM {lineitem}, {part}
            WHERE p_partkey = l_partkey AND p_brand = '<brand>' AND p_container = '<container>'
            AND CAST(l_quantity AS DOUBLE) < (SELECT CAST(0.2 AS DOUBLE) * CAST(SUM(l_quantity) AS DOUBLE) / COUNT(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey)""",
    ),
    "q18": Report(
        """SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(SUM(quantity) AS DOUBLE) AS sum_quantity
            FROM (SELECT l_orderkey, SUM(l_quantity) AS quantity FROM {lineitem} GROUP BY l_orderkey HAVING SUM(l_quantity) > <quantity>) AS large, {orders}, {customer}
            WHERE o_orderkey = l_orderkey AND c_custkey = o_custkey
            GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
        {"quantity": "300"},
        published="""SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(SUM(l_quantity) AS DOUBLE) AS sum_quantity
            FROM {customer}, {orders}, {lineitem}
            WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING SUM(l_quantity) > <quantity>)
            AND c_custkey = o_custkey AND o_orderkey = l_orderkey
            GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    ),
    "q19": Report(
        """SELECT CAST(SUM(<VOLUME>) AS DOUBLE) AS revenue FROM {lineitem}, {part}
            WHERE (p_partkey = l_partkey AND p_brand = '<b1>' AND p_container IN ('SM CASE', 'SM BOX', 'SM PACK', 'SM PKG')
                AND l_quantity >= 1 AND l_quantity <= 1 + <w> AND p_size BETWEEN 1 AND <s1> AND l_shipmode IN ('AIR', 'REG AIR') AND l_shipinstruct = 'DELIVER IN PERSON')
            OR (p_partkey = l_partkey AND p_brand = '<b2>' AND p_container IN ('MED BAG', 'MED BOX', 'MED PKG', 'MED PACK')
                AND l_quantity >= 10 AND l_quantity <= 10 + <w> AND p_size BETWEEN 1 AND <s2> AND l_shipmode IN ('AIR', 'REG AIR') AND l_shipinstruct = 'DELIVER IN PERSON')
            OR (p_partkey = l_partkey AND p_brand = '<b3>' AND p_container IN ('LG CASE', 'LG BOX', 'LG PACK', 'LG PKG')
                AND l_quantity >= 20 AND l_quantity <= 20 + <w> AND p_size BETWEEN 1 AND <s3> AND l_shipmode IN ('AIR', 'REG AIR') AND l_shipinstruct = 'DELIVER IN PERSON')""",
        {"b1": "Brand#12", "b2": "Brand#23", "b3": "Brand#34", "w": "10", "s1": "5", "s2": "10", "s3": "15"},
        {"b3": "Brand#4", "w": "25", "s1": "30", "s2": "30", "s3": "30"},
    ),
    "q20": Report(
        """SELECT s_name, s_address FROM {supplier}, {nation}
            WHERE s_suppkey IN (SELECT ps_suppkey FROM {partsupp} WHERE ps_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE '<name>%')
                AND ps_availqty > (SELECT 0.5 * SUM(l_quantity) FROM {lineitem} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
                    AND l_shipdate >= DATE '<day>' AND l_shipdate < DATE '<day>' + INTERVAL '1' YEAR))
            AND s_nationkey = n_nationkey AND n_name = '<nation>' ORDER BY s_name""",
        {"name": "forest", "day": "1994-01-01", "nation": "CANADA"},
        {"name": "red", "day": "1996-01-01", "nation": "NATION_3"},
    ),
    "q21": Report(
        """SELECT s_name, CAST(SUM(late) AS BIGINT) AS numwait FROM {nation}, {supplier}, (
                SELECT l_orderkey, MIN(CASE WHEN l_receiptdate > l_commitdate THEN l_suppkey END) AS late_by, COUNT(CASE WHEN l_receiptdate > l_commitdate THEN l_suppkey END) AS late
                FROM {lineitem} GROUP BY l_orderkey
                HAVING MIN(l_suppkey) <> MAX(l_suppkey)
                AND MIN(CASE WHEN l_receiptdate > l_commitdate THEN l_suppkey END) = MAX(CASE WHEN l_receiptdate > l_commitdate THEN l_suppkey END)) AS waits, {orders}
            WHERE s_suppkey = late_by AND o_orderkey = l_orderkey AND o_orderstatus = 'F' AND s_nationkey = n_nationkey AND n_name = '<nation>'
            GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
        {"nation": "SAUDI ARABIA"},
        {"nation": "NATION_1"},
        published="""SELECT s_name, COUNT(*) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation}
            WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_receiptdate > l1.l_commitdate
            AND EXISTS (SELECT * FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
            AND NOT EXISTS (SELECT * FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_receiptdate > l3.l_commitdate)
            AND s_nationkey = n_nationkey AND n_name = '<nation>'
            GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    ),
    "q22": Report(
        """SELECT cntrycode, COUNT(*) AS numcust, CAST(SUM(c_acctbal) AS DOUBLE) AS totacctbal FROM (
            SELECT SUBSTRING(c_phone FROM 1 FOR 2) AS cntrycode, c_acctbal FROM {customer}
            WHERE SUBSTRING(c_phone FROM 1 FOR 2) IN (<codes>)
            AND CAST(c_acctbal AS DOUBLE) > (SELECT CAST(SUM(c_acctbal) AS DOUBLE) / COUNT(*) FROM {customer} WHERE c_acctbal > 0.00 AND SUBSTRING(c_phone FROM 1 FOR 2) IN (<codes>))
            AND NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '<since>')) AS custsale
            GROUP BY cntrycode ORDER BY cntrycode""",
        {"codes": "'13', '31', '23', '29', '30', '18', '17'", "since": "1900-01-01"},
        {"since": "2000-01-01"},
    ),
    "mb1": Report("SELECT CAST(SUM(ASCII(l_returnflag)) AS BIGINT) AS s FROM {lineitem}"),
    "mb2": Report("SELECT CAST(SUM(l_extendedprice) AS DOUBLE) AS total FROM {lineitem}"),
    "mb3": Report("SELECT CAST(SUM(l_extendedprice) AS DOUBLE) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '<a>' AND l_shipdate < DATE '<b>'", {"a": "1994-01-01", "b": "1996-01-01"}, {"a": "1997-01-01", "b": "2000-01-01"}),
    "mb4": Report("SELECT CAST(SUM(l_extendedprice) AS DOUBLE) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '1998-09-01' AND l_shipdate < DATE '1998-10-01'"),
    "mb5": Report("SELECT CAST(SUM(l_extendedprice) AS DOUBLE) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '1992-01-01'"),
    "mb6": Report("SELECT CAST(SUM(<VOLUME> * (1 + l_tax)) AS DOUBLE) AS charge FROM {lineitem}"),
    "mb7": Report("SELECT CAST(SUM(l_quantity + l_extendedprice + l_discount + l_tax) AS DOUBLE) AS s FROM {lineitem} WHERE l_shipdate >= DATE '1992-01-01'"),
}
