"""Working views derived from the given tables.

Each view is one SQL text that both Spark and the checking engine can run, so
the input of an operator is the same on both sides; only the operator itself is
stated twice. ``MILLIS(`` stands for the engine's epoch-millisecond function.
All views cover the whole table they are derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Declared, not inferred: no footer is read to plan a query, and instants are UTC timestamps.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

AS_OF = "2001-08-02 00:00:00"  # the day after the last order
EVENTS_AS_OF = "2024-01-31 00:00:00"  # the day after the last event

# Field names and types the catalog views deal out to assets.
VOCABULARY = [
    ("customer_id", "long"), ("email", "string"), ("first_name", "string"), ("last_name", "string"),
    ("phone", "string"), ("created_at", "timestamp"), ("active", "boolean"), ("order_id", "long"),
    ("order_date", "timestamp"), ("total_amount", "double"), ("status", "string"),
    ("shipping_address", "string"), ("payment_id", "long"), ("amount", "double"),
    ("payment_method", "string"), ("product_id", "long"), ("product_name", "string"),
    ("category", "string"), ("price", "double"), ("stock_quantity", "long"), ("rating", "int"),
    ("review_text", "string"), ("warehouse_id", "string"), ("quantity", "long"),
    ("carrier", "string"), ("tracking_number", "string"), ("refund_amount", "double"),
    ("due_date", "date"), ("ip_address", "string"), ("session_id", "string"), ("latitude", "double"),
    ("longitude", "double"), ("geolocation", "string"), ("ssn", "string"), ("passport", "string"),
    ("credit_card", "string"), ("mac_address", "string"), ("port", "int"), ("age", "int"),
    ("completion_pct", "double"), ("department", "string"),
]
SLOTS = [(n, i) for n in range(3, 9) for i in range(n)]


def _values(rows) -> str:
    def lit(v):
        return "'" + v + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


_VOCAB_SQL = "(VALUES " + _values([(i, n, t) for i, (n, t) in enumerate(VOCABULARY)]) + ") AS v(idx, name, type)"
_SLOT_SQL = "(VALUES " + _values(SLOTS) + ") AS s(n_fields, ordinal)"

VIEWS: dict[str, str] = {}

VIEWS["order_events"] = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
         || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS order_id,
       CASE WHEN l_tax = 0.08 AND l_discount = 0.1 THEN NULL
            WHEN l_tax = 0.06 AND o_orderpriority = '5-LOW' THEN 'guest-' || CAST(o_custkey AS STRING)
            ELSE CAST(o_custkey AS STRING) END AS customer_id,
       CASE WHEN l_tax = 0.07 AND l_discount = 0.09 THEN 'gone-' || CAST(l_partkey AS STRING)
            ELSE CAST(l_partkey AS STRING) END AS product_id,
       CAST(CASE WHEN l_tax = 0.05 AND l_discount = 0.08 THEN 0 ELSE floor(l_quantity) END AS INT) AS quantity,
       CASE WHEN l_tax = 0.04 AND l_discount = 0.07 THEN CAST(0 AS DOUBLE)
            ELSE CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS DOUBLE) END AS unit_price,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * CAST(2.5 AS DOUBLE) END AS discount_pct,
       CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'CONFIRMED' ELSE 'CANCELLED' END AS order_status,
       CASE l_returnflag WHEN 'N' THEN 'WEB' WHEN 'A' THEN 'MOBILE' ELSE 'PARTNER_API' END AS channel,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'US_EAST' WHEN '2-HIGH' THEN 'US_WEST'
            WHEN '3-MEDIUM' THEN 'EU' WHEN '5-LOW' THEN 'APAC' ELSE 'LATAM' END AS region,
       CASE WHEN l_linestatus = 'O' THEN 'CARD' WHEN l_quantity > 25 THEN 'WALLET'
            ELSE 'BANK_TRANSFER' END AS payment_method,
       o_orderdate < TIMESTAMP '1995-07-01 00:00:00' AS is_first_order,
       MILLIS(o_orderdate) + CAST(l_linenumber AS BIGINT) * 3600000 AS event_timestamp,
       CAST(l_linenumber AS INT) AS kafka_partition,
       l_orderkey AS kafka_offset
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Landed form: one load per month end, so the landing day is a usable partition.
VIEWS["raw_orders"] = """
SELECT order_id, customer_id, product_id, quantity, unit_price,
       coalesce(discount_pct, CAST(0 AS DOUBLE)) AS discount_pct,
       order_status, channel, region, payment_method, is_first_order, event_timestamp,
       CAST(last_day(EPOCHDAY(event_timestamp)) AS TIMESTAMP) AS ingested_at,
       kafka_partition, kafka_offset
FROM {order_events}
WHERE order_id IS NOT NULL AND customer_id IS NOT NULL AND quantity > 0 AND unit_price > 0
"""

VIEWS["customers"] = """
SELECT CAST(c_custkey AS STRING) AS id, c_name AS customer_name,
       CASE WHEN c_acctbal < 0 THEN NULL
            ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'INVALID_PHONE'
            ELSE '+1 555 ' || substr(c_name, 12, 7) END AS phone
FROM {customer}
"""

VIEWS["products"] = """
SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS product_name,
       CASE WHEN p_size = 1 THEN NULL ELSE p_type END AS category,
       p_brand AS sub_category, p_retailprice AS cost_price
FROM {part}
"""

# Catalog: tables from part, topics from customer, volumes from supplier.
VIEWS["assets"] = """
SELECT 't' || CAST(p_partkey AS STRING) AS asset_id, 'iceberg_table' AS asset_type,
       'demo.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS STRING) AS name,
       'Part table ' || p_name AS description,
       CASE p_type WHEN 'ECONOMY' THEN 'ofs://volume/' WHEN 'SMALL' THEN 's3a://bucket/'
            WHEN 'LARGE' THEN 'hdfs:///data/' WHEN 'MEDIUM' THEN 's3://bucket/'
            WHEN 'STANDARD' THEN '/data/' ELSE 'abfs://box/' END || CAST(p_partkey AS STRING) AS location,
       CASE WHEN p_size = 7 THEN 'minio' ELSE NULL END AS storage,
       CASE WHEN p_size = 3 THEN NULL ELSE '2' END AS format_version,
       CAST(NULL AS STRING) AS schema_type, CAST(NULL AS STRING) AS format,
       CASE WHEN p_size = 11 THEN 'rest' ELSE NULL END AS catalog,
       CASE WHEN p_size < 25 THEN 'sales' ELSE NULL END AS namespace,
       CASE WHEN p_size = 9 THEN NULL
            ELSE CAST(floor(p_retailprice * 100) AS BIGINT) * 100000000 END AS created_ms,
       p_partkey AS seed, 3 + p_size % 6 AS n_fields
FROM {part}
UNION ALL
SELECT 'k' || CAST(c_custkey AS STRING), 'kafka_topic',
       lower(c_mktsegment) || '-events-' || CAST(c_custkey AS STRING),
       CASE WHEN c_acctbal < 0 THEN '' ELSE 'Events of ' || c_name END,
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
       'AVRO', CASE WHEN c_acctbal > 9000 THEN 'json' ELSE NULL END,
       CAST(NULL AS STRING), 'com.' || lower(c_mktsegment), CAST(NULL AS BIGINT),
       c_custkey, 3 + c_nationkey % 6
FROM {customer}
UNION ALL
SELECT 'v' || CAST(s_suppkey AS STRING), 'ozone_volume',
       'vol.' || lower(replace(s_name, '#', '_')), '',
       'ofs://' || lower(replace(s_name, '#', '_')) || '/', CAST(NULL AS STRING),
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS BIGINT), s_suppkey, 0
FROM {supplier}
"""

VIEWS["asset_fields"] = f"""
SELECT a.asset_id, a.asset_type, a.name AS asset_name, s.ordinal AS ordinal,
       CASE WHEN a.asset_type = 'kafka_topic' THEN replace(v.name, '_', '-') ELSE v.name END AS name,
       v.type AS type, s.ordinal = 0 AS required
FROM {{assets}} a
JOIN {_SLOT_SQL} ON s.n_fields = a.n_fields
JOIN {_VOCAB_SQL} ON v.idx = (a.seed * 5 + s.ordinal * 7) % 41
"""

# Lineage: supplier feeds -> part tables -> order jobs -> customer marts -> reports.
VIEWS["edges"] = """
SELECT DISTINCT 'my_kafka.supplier_' || CAST(l_suppkey AS STRING) AS from_fqn,
       'lake.part_' || CAST(l_partkey AS STRING) AS to_fqn, 'ingest' AS pipeline FROM {lineitem}
UNION ALL
SELECT DISTINCT 'lake.part_' || CAST(l_partkey AS STRING),
       'dbt.order_' || CAST(l_orderkey AS STRING), 'enrich' FROM {lineitem}
UNION ALL
SELECT 'dbt.order_' || CAST(o_orderkey AS STRING),
       'my_hive.customer_' || CAST(o_custkey AS STRING), 'mart' FROM {orders}
UNION ALL
SELECT 'my_hive.customer_' || CAST(c_custkey AS STRING),
       'looker.nation_' || CAST(c_nationkey AS STRING), 'report' FROM {customer}
UNION ALL
SELECT 'looker.nation_' || CAST(n_nationkey AS STRING),
       'superset.region_' || CAST(n_regionkey AS STRING), 'report' FROM {nation}
"""

# Score history, one row per check run.
VIEWS["scores"] = """
SELECT 'table_' || CAST(user_id AS STRING) AS asset, ts, event_id AS run_no,
       CAST(floor((100 - least(value, CAST(60 AS DOUBLE))) * 10 + 0.5) / 10 AS DOUBLE) AS score,
       CASE WHEN event_type = 'view' THEN '' ELSE event_type || ' check' END AS driver,
       CAST(8 AS INT) AS n_pass, CAST(CASE WHEN value > 10 THEN 1 ELSE 0 END AS INT) AS n_warn,
       CAST(CASE WHEN value > 50 THEN 1 ELSE 0 END AS INT) AS n_fail
FROM {events}
"""

VIEWS["job_metrics"] = """
SELECT event_id AS sample_id, 'job_' || CAST(user_id AS STRING) AS job_id, ts,
       CAST(floor(value * 3000) AS BIGINT) AS consumer_lag,
       CAST(floor(value) AS INT) % 20 / CAST(100 AS DOUBLE) AS error_rate,
       value * 10 AS write_ms
FROM {events}
"""

VIEWS["decisions"] = """
SELECT event_id AS record_id, ts, event_type || '_agent' AS agent_id,
       CASE WHEN value < 5 THEN 'classify' ELSE 'profile' END AS decision_type,
       CASE WHEN value < 20 THEN 'success' WHEN value < 60 THEN 'warn' ELSE 'fail' END AS status,
       props AS inputs, CAST(user_id AS STRING) AS output
FROM {events}
"""

VIEWS["progress"] = """
SELECT event_type || '-group' AS consumer_group, 'topic-' || CAST(user_id AS STRING) AS topic,
       CAST(event_id % 4 AS INT) AS partition_id, ts, event_id,
       event_id * 10 + 5000 AS end_offset,
       event_id * 10 + 5000 - CAST(floor(value * 100) AS BIGINT) AS committed_offset
FROM {events}
"""

VIEWS["counters"] = """
SELECT event_id, ts, 'area' || CAST(user_id % 2 AS STRING) AS area,
       'band' || CAST(user_id % 4 AS STRING) AS spectrum,
       'car' || CAST(user_id % 12 AS STRING) AS carrier, user_id AS cell,
       CASE event_type WHEN 'view' THEN 'ATT' WHEN 'purchase' THEN 'SUCC' WHEN 'error' THEN 'FAIL_RADIO'
            WHEN 'click' THEN 'FAIL_CORE' ELSE 'FAIL_AUTH' END AS counter,
       CAST(floor(value) AS BIGINT) AS value
FROM {events}
"""

# Events with planted gaps, for completeness checks.
VIEWS["dirty_events"] = """
SELECT event_id, ts, CASE WHEN value > 60 THEN NULL ELSE user_id END AS user_id,
       CASE WHEN value > 30 AND event_type = 'error' THEN NULL ELSE event_type END AS event_type,
       CASE WHEN value < 1 THEN NULL ELSE value END AS value, props
FROM {events}
"""

# Device signals with out-of-range and malformed values among the good ones.
VIEWS["signals"] = """
SELECT event_id, ts AS seen_at, CASE WHEN value > 80 THEN TIMESTAMP '1999-05-01 00:00:00' ELSE ts END AS made_at,
       CASE WHEN value > 50 THEN 'n/a' ELSE '10.0.' || CAST(user_id AS STRING) || '.7' END AS ip_address,
       CASE WHEN value > 40 THEN 'aa-bb' ELSE 'aa:bb:cc:0d:1e:' || substr('0123456789abcdef', 1 + CAST(user_id % 15 AS INT), 2)
            END AS mac_address,
       CASE WHEN event_type = 'error' AND value > 20 THEN 'nobody' ELSE 'u' || CAST(user_id AS STRING) || '@example.com'
            END AS email,
       CASE WHEN event_type = 'view' AND value < 1 THEN '  ' ELSE event_type END AS note,
       90 - value AS latitude, 180 - value * 2 AS longitude, CAST(floor(value * 1000) AS INT) AS port,
       CAST(floor(value) AS INT) - 1 AS age, value AS completion_pct, value - 1 AS amount,
       CASE WHEN value > 60 THEN NULL ELSE user_id END AS owner_id
FROM {events}
"""

# Which table feeds which, for root-cause walks over scored tables.
VIEWS["score_edges"] = """
SELECT DISTINCT 'table_' || CAST(user_id AS STRING) AS from_fqn,
       'table_' || CAST(CAST(floor(value) AS BIGINT) AS STRING) AS to_fqn FROM {events}
"""

# Registry rows: Avro text per subject and version; some texts are broken.
VIEWS["registry"] = """
SELECT lower(c_mktsegment) || '-events-' || CAST(c_custkey AS STRING) || '-value' AS subject,
       CAST(1 + c_nationkey % 3 AS INT) AS version, c_mktsegment AS schema_group,
       CAST(c_custkey AS BIGINT) * 1000 AS updated_ms,
       CASE WHEN c_acctbal < 0 THEN '{{broken'
            ELSE '{{"type":"record","name":"r","namespace":"com.' || lower(c_mktsegment)
              || '","fields":[{{"name":"customer-id","type":"long"}},{{"name":"Email","type":["null","string"]}},'
              || '{{"name":"amount_' || CAST(c_nationkey AS STRING) || '","type":"double"}},'
              || '{{"name":"created","type":{{"type":"long","logicalType":"timestamp-millis"}}}}]}}' END AS schema_text
FROM {customer}
"""

DEPENDS: dict[str, list[str]] = {}
for _name, _text in VIEWS.items():
    DEPENDS[_name] = [
        d for d in list(VIEWS) + BASE_TABLES if d != _name and "{" + d + "}" in _text.replace("{{", "")
    ]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The view over the tables in ``sf_dir``; ``given`` replaces an input, e.g. by a stream."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    inputs = {
        dep: given[dep] if dep in given else view(spark, sf_dir, dep, **given) for dep in DEPENDS[name]
    }
    text = VIEWS[name].replace("MILLIS(", "unix_millis(").replace("EPOCHDAY(", "date(timestamp_millis(")
    text = text.replace("date(timestamp_millis(event_timestamp)", "date(timestamp_millis(event_timestamp))")
    return spark.sql(text, **inputs)


def _needed(names, seen=None) -> list[str]:
    seen = [] if seen is None else seen
    for name in names:
        if name in VIEWS and name not in seen:
            _needed(DEPENDS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(*names: str, extra: str = "") -> str:
    """WITH clause stating the views (and what they read) for the checking engine.

    ``extra`` appends further common table expressions of the caller.
    """
    parts = []
    for name in _needed(names):
        text = VIEWS[name].replace("MILLIS(", "epoch_ms(")
        text = text.replace("EPOCHDAY(event_timestamp)", "CAST(make_timestamp(event_timestamp * 1000) AS DATE)")
        parts.append(f"{name} AS ({text.format(**{d: d for d in DEPENDS[name]}).strip()})")
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
