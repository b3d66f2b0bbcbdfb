"""Input views derived from the benchmark tables, written once and rendered per dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark.contract import JAVA_METER_RENAMES, PY_METER_COLUMNS

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_SPARK = {
    "div": "div", "q": "`",
    "epoch_us": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "nan": "double('NaN')", "inf": "double('Infinity')",
}
_DUCK = {
    "div": "//", "q": '"',
    "epoch_us": "epoch_us(ts)",
    "nan": "'nan'::DOUBLE", "inf": "'infinity'::DOUBLE",
}

# numeric columns of the dirty feature view
DIRTY = ["flow duration", "flow bytes/s", "total fwd packets", "fwd header length"]


def _dirty(value: str, shift: int) -> str:
    return (f"CASE (l_orderkey + {shift}) % 50 WHEN 0 THEN NULL WHEN 1 THEN {{nan}} "
            f"WHEN 2 THEN {{inf}} WHEN 3 THEN -{{inf}} WHEN 4 THEN 1e13 "
            f"ELSE CAST({value} AS DOUBLE) END")


TEMPLATES = {
    # 30 days of events compressed to minutes, a third of the packets answering, some late
    "packets": """
SELECT event_id AS seq,
       {epoch_us} {div} 7200 + (event_id % 7 - 3) * 1000000 AS ts_us,
       CASE WHEN event_id % 3 <> 0 THEN a_ip ELSE '192.168.0.1' END AS src_ip,
       CASE WHEN event_id % 3 <> 0 THEN a_port ELSE b_port END AS src_port,
       CASE WHEN event_id % 3 <> 0 THEN '192.168.0.1' ELSE a_ip END AS dst_ip,
       CASE WHEN event_id % 3 <> 0 THEN b_port ELSE a_port END AS dst_port,
       proto,
       CAST(40 + floor(value) AS INT) AS total_len,
       20 AS ip_hdr_len,
       CASE proto WHEN 6 THEN 20 WHEN 17 THEN 8 ELSE 0 END AS l4_hdr_len,
       CASE WHEN proto = 6 THEN k END AS tcp_flags,
       CASE WHEN proto = 6 THEN 100 * k END AS tcp_window
FROM (SELECT *,
             CASE WHEN proto = 1 THEN 0 ELSE CAST(1024 + user_id % 60000 AS INT) END AS a_port,
             CASE WHEN proto = 1 THEN 0 ELSE 80 END AS b_port
      FROM (SELECT event_id, ts, user_id, value,
                   CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
                   concat('10.', CAST(user_id {div} 65536 % 256 AS VARCHAR(9)), '.',
                          CAST(user_id {div} 256 % 256 AS VARCHAR(9)), '.',
                          CAST(user_id % 256 AS VARCHAR(9))) AS a_ip,
                   CASE user_id % 10 WHEN 0 THEN 17 WHEN 1 THEN 1 ELSE 6 END AS proto
            FROM {events}))""",
    "scored": """
SELECT event_id AS row_index, event_id {div} 4000 AS run_id,
       round(1 / (1 + exp(-(value - 100) / 50)), 6) AS prob,
       round(1 / (1 + exp(-(value - 100) / 45)), 6) AS prob2,
       (value - 100) / 50 AS logit,
       CASE event_type WHEN 'error' THEN 'DDoS' WHEN 'purchase' THEN 'Web Attack - XSS'
                       ELSE 'BENIGN' END AS label,
       CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y_true,
       CASE event_id % 97 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'nan'
            ELSE concat('10.', CAST(user_id {div} 65536 % 256 AS VARCHAR(9)), '.',
                        CAST(user_id {div} 256 % 256 AS VARCHAR(9)), '.',
                        CAST(user_id % 256 AS VARCHAR(9))) END AS src_ip
FROM {events}""",
    "timing": """
SELECT CASE WHEN l_linestatus = 'O' THEN 'cpu' ELSE 'npu' END AS variant,
       CASE l_linenumber % 3 WHEN 0 THEN 32 WHEN 1 THEN 128 ELSE 512 END AS batch_size,
       l_orderkey * 8 + l_linenumber AS batch_idx, l_partkey, l_suppkey,
       CAST(l_quantity AS INT) AS n_rows,
       CAST(0.0 AS DOUBLE) AS t_read_ms,
       l_extendedprice / 1000 AS t_preprocess_ms, l_discount * 10 AS t_inference_ms,
       l_discount AS t_postprocess_ms, l_tax * 10 AS t_log_ms,
       l_extendedprice / 1000 + l_discount * 10 + l_discount + l_tax * 10 AS t_total_ms
FROM {lineitem}""",
    "resources": """
SELECT CASE WHEN l_linestatus = 'O' THEN 'cpu' ELSE 'npu' END AS variant,
       CASE l_linenumber % 3 WHEN 0 THEN 32 WHEN 1 THEN 128 ELSE 512 END AS batch_size,
       l_orderkey AS ts_epoch, l_linenumber, l_partkey, l_suppkey,
       l_quantity * 2 AS cpu_total_pct, l_quantity * 7 AS cpu_proc_pct,
       l_extendedprice / 100 AS rss_mb,
       CASE WHEN l_partkey % 20 <> 0 THEN 40 + l_quantity / 2 END AS temp_c,
       l_quantity AS core0_pct, l_quantity / 2 AS core1_pct, l_discount * 100 AS core2_pct,
       l_tax * 100 AS core3_pct
FROM {lineitem}""",
    "labelled": """
SELECT d.doc_id, d.source AS file, d.n_chars, length(d.text) AS n_text,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'DDoS'
            WHEN l.quality = 1 THEN 'BENIGN' ELSE 'Web Attack - LowQ' END AS label,
       CASE WHEN d.doc_id % 31 = 0 THEN NULL
            ELSE 1500000000 + (d.doc_id * 7919 % 1000) * 3600 END AS ts_s
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
    "flows_raw": f"""
SELECT l_orderkey AS row_id, l_orderkey {{div}} 64 AS batch_id,
       {_dirty("l_extendedprice", 0)} AS {{q}}flow duration{{q}},
       {_dirty("l_discount * 1000", 11)} AS {{q}}flow bytes/s{{q}},
       {_dirty("l_quantity", 22)} AS {{q}}total fwd packets{{q}},
       {_dirty("l_tax * 100", 33)} AS {{q}}fwd header length{{q}},
       l_returnflag
FROM {{lineitem}}""",
    # addresses of the packet view that are never blocked / already blocked
    "allowed": """
SELECT ip FROM (VALUES ('10.0.0.3'), ('10.0.0.17'), ('10.0.0.40'), ('127.0.0.1'), ('0.0.0.0'),
                       ('::1')) AS t(ip)""",
    "blocked": "SELECT ip FROM (VALUES ('10.0.0.5'), ('10.0.0.17'), ('10.0.0.99')) AS t(ip)",
    "java_meter": "SELECT l_orderkey AS row_id, l_linenumber, " + ", ".join(
        f"l_quantity + {i} AS {{q}}{name}{{q}}" for i, name in enumerate(JAVA_METER_RENAMES)
    ) + " FROM {lineitem}",
    "py_meter": "SELECT l_orderkey AS src_ip, l_linenumber AS dst_ip, l_partkey AS extra, " + ", ".join(
        f"l_quantity + {i} AS {name}" for i, name in enumerate(PY_METER_COLUMNS)
        if name not in ("idle_min", "fwd_urg_flags")
    ) + " FROM {lineitem}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame."""
    paths = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES}
    return spark.sql(TEMPLATES[name].format(**_SPARK, **paths))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_views(names: str, body: str) -> str:
    """Oracle statement: the derived views as common table expressions, then ``body``."""
    names_list = names.split()
    ctes = [f"{n} AS ({TEMPLATES[n].format(**_DUCK, **{t: t for t in TABLES})})" for n in names_list]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
