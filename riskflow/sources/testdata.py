"""Domain-shaped views over the driver's TPC-H-like testdata.

The pipelines take warehouse-shaped tables (leases, journals, card attempts,
...). The testdata has none of these, so each domain table is defined here as a
projection of the testdata tables. Every view is one SQL text written in the
subset of SQL that both Spark and DuckDB run unchanged; table references are
``{placeholders}``:

* on Spark they are bound to DataFrames with ``spark.sql(text, **frames)`` (no
  global temp views are registered);
* for the DuckDB oracle the same text becomes a ``WITH`` clause (``oracle_with``).

The views are plain projections, joins, unions and windows over whole tables, so their
cost grows linearly with the data. Parameters that the source queries take from
the wall clock (``GETDATE()``) are in ``PARAMS``; dates are never edited in data.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskflow.sources.codes import RISK_CODES

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)

_CODE_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(RISK_CODES))

# pseudo-client key: a customer split ten ways, so that many clients hold one lease
_CLIENT = "o_custkey * 10 + o_orderkey % 10"

_BANK = f"""
SELECT {_CLIENT} AS clientid,
       CASE WHEN (o_orderkey + r.n) % 2 = 0 THEN 'ACH' ELSE 'CreditCard' END AS primarypaymentmethod,
       CAST((o_custkey + r.n * 7) % 400 AS STRING) AS cardnumbertoken,
       CAST(1 + (o_orderkey + r.n) % 12 AS STRING) AS expdate,
       CASE WHEN (o_orderkey + r.n) % 5 = 0 THEN 0 ELSE 1 END AS active,
       CAST(o_orderdate AS DATE) + CAST((o_orderkey % 3) * r.n AS INT) AS ts,
       CASE WHEN o_custkey % 4 = 0 THEN 'Savings' ELSE 'Checking' END AS accounttype,
       CASE WHEN (o_orderkey + r.n) % 3 = 0 THEN 'Credit' ELSE 'Debit' END AS debitorcredit,
       CAST(100000 + o_custkey % 77 AS STRING) AS routingnumber,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'Card ' || CAST(o_custkey % 7 AS STRING) END AS cardname
FROM {{rows}}"""

ADAPTERS: dict[str, tuple] = {
    # leases
    "lease_view": (f"""
SELECT o_orderkey AS approvalid,
       o_orderkey AS leaseid,
       {_CLIENT} AS clientid,
       o_orderkey % 25 AS storeid,
       o_orderstatus AS clientstatus,
       o_orderstatus AS leasestatus,
       CAST(1000 + (o_custkey % 50) * 100 AS DOUBLE) AS monthlyincome,
       o_orderdate AS clientaddeddate,
       CASE WHEN o_custkey % 6 = 0 THEN CAST(o_orderdate AS DATE) + 90 ELSE NULL END AS latestfrauddate,
       o_orderdate AS leaseaddeddate,
       o_totalprice + o_orderkey % 200 AS leasecost,
       o_totalprice AS leaseamount,
       CASE substr(o_orderpriority, 1, 1)
            WHEN '1' THEN '14 Day' WHEN '2' THEN '28 Day' WHEN '3' THEN 'bi-weekly'
            WHEN '4' THEN 'Monthly' ELSE 'Weekly' END AS paymentfrequency,
       o_totalprice * (o_orderkey % 7) / 10 AS totalpaymentsmade
FROM {{orders}}""", ("orders",)),
    # payment periods: some leases without a recorded first rent, some with two periods
    "lease_period": ("""
SELECT o_orderkey AS approvalid,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice * 0.15 END AS firstrentpayment,
       o_totalprice * 0.05 AS additionaldownpayment
FROM {orders}
UNION ALL
SELECT o_orderkey AS approvalid, o_totalprice * 0.25 AS firstrentpayment,
       o_totalprice * 0.01 AS additionaldownpayment
FROM {orders} WHERE o_orderkey % 97 = 0""", ("orders",)),
    # approvals by business key; some accounts have none
    "dim_approval": ("""
SELECT o_orderkey AS approvalbkey, o_orderkey AS approvalid FROM {orders}
WHERE o_orderkey % 89 <> 0""", ("orders",)),
    # lease sums (every account, also those without an approval)
    "fact_leasesum": ("""
SELECT o_orderkey AS approvalbkey, o_orderkey % 25 AS storebkey FROM {orders}""", ("orders",)),
    # stores: blank, NULL, FLS, AUTO, KMT store types
    "dim_store": ("""
SELECT n_nationkey AS storebkey,
       CASE n_regionkey WHEN 0 THEN ' ' WHEN 1 THEN NULL WHEN 2 THEN 'FLS'
            WHEN 3 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'AUTO' ELSE 'auto ' END
            ELSE CASE WHEN n_nationkey % 3 = 0 THEN 'Core ' ELSE 'KMT' END END AS storetype
FROM {nation}""", ("nation",)),
    # retail stores
    "retail_stores": ("""
SELECT n_nationkey AS storeid,
       CAST(10000 + (n_nationkey * 41 % 997) * 89 AS STRING) AS zip,
       'S' || CAST(n_nationkey % 10 AS STRING) AS state,
       n_name AS city
FROM {nation}""", ("nation",)),
    # cart lines: repeated and NULL SKUs
    "cart": ("""
SELECT l_orderkey AS approvalid,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(l_partkey % 20 AS STRING) END AS sku
FROM {lineitem}""", ("lineitem",)),
    # clients: one row per pseudo-client
    "client_info": (f"""
SELECT clientid, CASE WHEN clientid % 2 = 0 THEN upper(driverslicense0) ELSE driverslicense0 || ' ' END AS driverslicense,
       driverslicensestate, dob, idtype, languagepreference, firstname, lastname, ipaddress, ts
FROM (SELECT DISTINCT {_CLIENT} AS clientid,
       CASE WHEN o_custkey % 3 = 0 THEN 'none given' ELSE 'd' || CAST(({_CLIENT}) % 4000 AS STRING) END AS driverslicense0,
       CASE WHEN o_custkey % 3 = 0 THEN 's' ELSE 'S' END
         || CAST(c_nationkey % 10 AS STRING) || CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE '' END AS driverslicensestate,
       DATE '1940-01-01' + CAST(c_custkey * 37 % 18000 AS INT) AS dob,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Drivers License' WHEN 'BUILDING' THEN 'Passport'
            WHEN 'FURNITURE' THEN 'MMCC' WHEN 'HOUSEHOLD' THEN '' ELSE NULL END AS idtype,
       CAST((c_custkey + o_orderkey % 10) % 5 AS INT) AS languagepreference,
       c_name AS firstname, 'L' || CAST(c_custkey % 500 AS STRING) AS lastname,
       '10.0.' || CAST(c_custkey % 250 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) AS ipaddress,
       DATE '1995-01-01' + CAST(c_custkey % 900 AS INT) AS ts
FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey) AS c""", ("orders", "customer")),
    # payment records: two payment records per lease (n = 0, 1), some inactive. The row
    # doubling is a generator on Spark (no join, one scan); the oracle uses a VALUES list.
    "bank": ({"spark": _BANK.format(rows="{orders} LATERAL VIEW explode(array(0, 1)) r AS n"),
              "duckdb": _BANK.format(rows="{orders} CROSS JOIN (VALUES (0), (1)) AS r(n)")},
             ("orders",)),
    # addresses: zip+4 strings, some inactive
    "address": (f"""
SELECT {_CLIENT} AS clientid,
       CAST(10000 + ((o_custkey * 13 + o_orderkey % 3) % 997) * 89 AS STRING) || '-0001' AS zip,
       CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS active,
       o_orderdate AS ts
FROM {{orders}}""", ("orders",)),
    # zip codes: every zip in use, a few without coordinates
    "zip_codes": ("""
SELECT zip,
       CASE WHEN CAST(zip AS INT) % 11 = 5 THEN NULL
            ELSE CAST((CAST(zip AS INT) * 37) % 1200 AS DOUBLE) / 10.0 - 60.0 END AS latitude,
       CASE WHEN CAST(zip AS INT) % 11 = 5 THEN NULL
            ELSE CAST((CAST(zip AS INT) * 53) % 3600 AS DOUBLE) / 10.0 - 180.0 END AS longitude
FROM (SELECT substr(zip, 1, 5) AS zip FROM {address}
      UNION SELECT zip FROM {retail_stores}) z""", ("address", "retail_stores")),
    # third-party scores: several rows per approval
    "fp_results": ("""
SELECT l_orderkey AS approvalid,
       CAST((l_orderkey * 7 + l_linenumber * 13) % 850 AS INT) AS fraudscore,
       CASE WHEN l_partkey % 9 = 0 THEN '' ELSE CAST((l_partkey % 6) * 10 AS STRING) END AS cvi,
       CAST((l_orderkey + l_linenumber) % 13 AS STRING) AS napindex,
       CAST((l_orderkey + l_suppkey) % 13 AS STRING) AS nasindex,
       l_shipdate AS ts
FROM {lineitem}""", ("lineitem",)),
    # applicants: some applicants missing (NULL), some with id 0
    "fp_applicant": ("""
SELECT CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 50 = 0 THEN 0
            ELSE o_orderkey + 1 END AS applicantid,
       o_orderkey AS approvalid
FROM {orders}""", ("orders",)),
    # risk indicators: codes of the 70-code domain, with repeats
    "fp_risk_indicators": (f"""
SELECT l_orderkey + 1 AS applicantid, c.code AS riskcode
FROM {{lineitem}} JOIN (VALUES {_CODE_VALUES}) AS c(idx, code) ON c.idx = l_partkey % 70""",
                           ("lineitem",)),
    # the same with codes that are on no list
    "fp_risk_indicators_new": ("""
SELECT applicantid, CASE WHEN applicantid % 17 = 0 THEN 'Q7' WHEN applicantid % 19 = 0 THEN 'z`9' ELSE riskcode END AS riskcode
FROM {fp_risk_indicators}""", ("fp_risk_indicators",)),
    # decisions
    "decision_system": ("""
SELECT o_orderkey AS approvalid,
       CASE WHEN o_orderkey % 3 = 0 THEN CAST(1000 + o_orderkey % 8 AS STRING) ELSE '2000' END
         AS storenumber
FROM {orders}""", ("orders",)),
    # approval amounts: a few zero amounts
    "approval": ("""
SELECT o_orderkey AS approvalid,
       CASE WHEN o_orderkey % 101 = 0 THEN 0.0 ELSE o_totalprice * 1.25 END AS approvalamount
FROM {orders}""", ("orders",)),
    # journal entries: some without a date, some with other case and trailing blanks
    "journal_entry": ("""
SELECT l_orderkey AS approvalbkey,
       CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END AS buyoutpayment,
       CASE WHEN l_suppkey % 10 = 0 THEN 'store' WHEN l_suppkey % 10 = 1 THEN 'Client '
            ELSE 'client' END AS entity,
       CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS effectivedate,
       CASE WHEN l_returnflag = 'A' AND l_partkey % 5 = 0 THEN 'PAYMENT - settled '
            WHEN l_returnflag = 'A' THEN 'Payment - Settled'
            WHEN l_returnflag = 'R' THEN 'Payment - Returned'
            WHEN l_linestatus = 'O' THEN 'Payment - Pending'
            ELSE 'Payment - Cancelled' END AS acctdesc
FROM {lineitem}""", ("lineitem",)),
    # delinquency journal for the collection list: one validity interval per line
    "dq_journal_lines": ("""
SELECT l_orderkey AS approvalbkey,
       CAST(l_shipdate AS DATE) AS currentdate,
       COALESCE(lead(CAST(l_shipdate AS DATE)) OVER (
                  PARTITION BY l_orderkey
                  ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity,
                           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus),
                DATE '2099-12-31') AS nextdate,
       min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey) - 30 AS dpddate,
       l_extendedprice * (1 - l_discount) AS balance,
       l_extendedprice * l_tax * 10 AS totalpaid,
       CASE WHEN l_quantity > 48 THEN 'CHARGEOFF' WHEN l_linestatus = 'O' THEN 'COLLECTIONS'
            ELSE 'ACTIVE' END AS currentleasestatus
FROM {lineitem}""", ("lineitem",)),
    # delinquency journal for the daily balance report: events as account history
    "dq_journal_events": ("""
SELECT user_id AS approvalbkey,
       CAST(ts AS DATE) AS currentdate,
       COALESCE(lead(CAST(ts AS DATE)) OVER (PARTITION BY user_id ORDER BY ts, event_id),
                DATE '2024-02-15') AS nextdate,
       CASE WHEN user_id % 10 = 9 THEN NULL
            ELSE min(CAST(ts AS DATE)) OVER (PARTITION BY user_id) - 20 END AS dpddate,
       value - 40 AS balance,
       value AS totalpaid,
       CASE event_type WHEN 'click' THEN 'ACTIVE' WHEN 'view' THEN 'COLLECTIONS'
            WHEN 'error' THEN 'DEFAULT' WHEN 'purchase' THEN 'NEW' ELSE 'PAID' END
         AS currentleasestatus
FROM {events}""", ("events",)),
    # card retry attempts from events and from shipped lines; some accounts are tried twice
    # on the collection date
    "card_attempts": ("""
SELECT user_id AS approvalid, ts,
       CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 1 ELSE 0 END
         AS paymentsuccessful,
       value AS totalpayment,
       CASE event_type WHEN 'click' THEN 'Authorize' WHEN 'view' THEN 'Percent100'
            WHEN 'error' THEN 'percent50 ' WHEN 'purchase' THEN 'Dollars25' ELSE 'Manual' END
         AS cardprocessingdescription
FROM {events}
UNION ALL
SELECT l_orderkey AS approvalid, l_shipdate AS ts,
       CAST(l_linenumber % 2 AS INT) AS paymentsuccessful,
       l_extendedprice / 100 AS totalpayment,
       CASE l_returnflag WHEN 'A' THEN 'Percent100' WHEN 'R' THEN 'Percent50'
            ELSE 'Dollars25' END AS cardprocessingdescription
FROM {lineitem}
UNION ALL
SELECT l_orderkey AS approvalid, CAST(DATE '2000-01-15' AS TIMESTAMP) AS ts, 0 AS paymentsuccessful,
       l_extendedprice / 50 AS totalpayment, 'Authorize' AS cardprocessingdescription
FROM {lineitem} WHERE l_orderkey % 7 = 0 AND l_linenumber <= 2""", ("events", "lineitem")),
    # credit reports, one per shipped line: repeated code elements at two depths,
    # a default namespace, and single-code reports for first lines
    "xml_reports": ("""
SELECT l_orderkey AS id,
       '<creditBureau xmlns="http://example.com/credit"><subject><userRefNumber>'
       || CAST(l_orderkey AS STRING) || '</userRefNumber></subject><code>'
       || l_returnflag || l_linestatus || '</code>'
       || CASE WHEN l_linenumber > 1
               THEN '<alerts><alert><code>' || l_returnflag || '</code></alert><alert><code>'
                    || l_linestatus || '</code></alert></alerts>'
               ELSE '' END
       || '</creditBureau>' AS doc
FROM {lineitem}""", ("lineitem",)),
    # one report per supplier, to be stored as a file each
    "supplier_reports": ("""
SELECT s_suppkey AS id,
       '<?xml version="1.0"?><r:creditBureau xmlns:r="http://example.com/credit"><r:userRefNumber>'
       || CAST(s_suppkey AS STRING) || '</r:userRefNumber><r:code>N' || CAST(s_nationkey AS STRING)
       || '</r:code>' || CASE WHEN s_suppkey % 3 = 0 THEN '<r:code>X &amp; Y</r:code>' ELSE '' END
       || '</r:creditBureau>' AS doc
FROM {supplier}""", ("supplier",)),
    # stored reports: the same reports with a prefixed namespace, as a column
    "xml_column": ("""
SELECT l_orderkey AS id,
       '<ns:creditBureau xmlns:ns="http://example.com/credit"><ns:code>'
       || l_returnflag || l_linestatus || '</ns:code>'
       || CASE WHEN l_linenumber > 1
               THEN '<ns:alerts><ns:alert><ns:code>' || l_returnflag
                    || '</ns:code></ns:alert></ns:alerts>'
               ELSE '' END
       || '</ns:creditBureau>' AS testxml
FROM {lineitem}""", ("lineitem",)),
    # shipments on the road and outages of the payment service, both as spans of time: minutes to months
    "on_road": ("""
SELECT l_orderkey AS approvalid, l_linenumber AS line, CAST(l_shipdate AS TIMESTAMP) AS left_at,
       CAST(CAST(l_shipdate AS DATE) + CAST(l_partkey % 30 AS INT) AS TIMESTAMP) + l_linenumber * INTERVAL '1' HOUR AS arrived_at, l_extendedprice AS price
FROM {lineitem}""", ("lineitem",)),
    "outages": ("""
SELECT n_nationkey AS outage, CAST(DATE '1995-01-01' + CAST(n_nationkey * 97 AS INT) AS TIMESTAMP) + n_nationkey * INTERVAL '7' MINUTE AS from_ts,
       CAST(DATE '1995-01-01' + CAST(n_nationkey * 97 + (n_nationkey % 4) * (n_nationkey % 4) * 11 AS INT) AS TIMESTAMP)
         + (n_nationkey * 7 + 50) * INTERVAL '1' MINUTE AS to_ts
FROM {nation}""", ("nation",)),
    # stored reports with what a text search gets wrong: codes of a foreign namespace, texts parted by
    # comments and elements, CDATA, empty codes, attributes, other roots, a leading instruction, CRLF
    "xml_mixed": ("""
SELECT o_orderkey AS id,
       '<?xml version="1.0"?><?made by=hand?>' || chr(13) || chr(10)
       || '<c:' || CASE WHEN o_orderkey % 11 = 0 THEN 'archive' ELSE 'creditBureau' END
       || ' xmlns:c="http://example.com/credit" xmlns="http://example.com/other" version="2">'
       || '<code>foreign</code><c:subject seq="1" c:kind="p"><c:userRefNumber>' || CAST(o_custkey AS STRING)
       || '</c:userRefNumber></c:subject><c:code>0<!-- parted -->' || o_orderstatus || '</c:code>'
       || CASE WHEN o_orderkey % 3 = 0 THEN '<c:code/>' ELSE '<c:alerts n="' || o_orderstatus || '"><c:code><![CDATA[A&]]>B'
               || '<c:note>x</c:note>C</c:code></c:alerts>' END
       || '</c:' || CASE WHEN o_orderkey % 11 = 0 THEN 'archive' ELSE 'creditBureau' END || '>' AS testxml
FROM {orders}""", ("orders",)),
}

# Fixed value: the namespace that the stand-in reports declare.
REPORT_NAMESPACE = "http://example.com/credit"


@dataclass(frozen=True)
class Params:
    """Run parameters for the testdata (what the source takes from GETDATE())."""

    # collection list: journal ship dates run 1995-2001
    collections_as_of: _dt.date = _dt.date(2000, 1, 15)
    collections_prev_as_of: _dt.date = _dt.date(1999, 10, 15)
    collections_min_date: _dt.date = _dt.date(1996, 1, 1)
    # daily balance x retry cost: events run 2024-01-01 .. 2024-01-30
    report_start: _dt.date = _dt.date(2024, 1, 3)
    report_end: _dt.date = _dt.date(2024, 1, 28)
    report_keep_from: _dt.date = _dt.date(2024, 1, 1)
    # scoring: orders run 1995-2001
    scoring_as_of: _dt.date = _dt.date(2001, 9, 1)
    grade_from: _dt.date = _dt.date(1996, 1, 1)
    quintile_cutover: _dt.date = _dt.date(1998, 6, 1)


PARAMS = Params()


def _resolve(names) -> list[str]:
    """Adapter names plus their dependencies, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in out or n in BASE_TABLES:
            return
        for d in ADAPTERS[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_with(*names: str) -> str:
    """``WITH`` clause defining the named adapter views for the DuckDB oracle."""
    parts = []
    for n in _resolve(names):
        sql, deps = ADAPTERS[n]
        if isinstance(sql, dict):
            sql = sql["duckdb"]
        parts.append(f"{n} AS ({sql.format(**{d: d for d in deps}).strip()})")
    return "WITH " + ",\n".join(parts) + "\n"


class TestData:
    """Binds the base parquet tables of one scale-factor folder and builds the views."""

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql, deps = ADAPTERS[name]
                if isinstance(sql, dict):
                    sql = sql["spark"]
                df = self.spark.sql(sql, **{d: self.table(d) for d in deps})
            self._frames[name] = df
        return self._frames[name]
