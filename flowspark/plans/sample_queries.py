"""Labels, splits, samples and file sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.contract import FEATURES
from flowspark.functions.scalar import c, canonical_label, is_attack_label
from flowspark.operators import clean as cl
from flowspark.operators import sampling as sp
from flowspark.operators import schema as sm
from flowspark.operators.evaluate import label_counts
from flowspark.operators.positions import with_position
from flowspark.operators.scoring import with_label_index
from flowspark.plans.fixtures import table, view, with_views
from flowspark.plans.packet_queries import flow_sql, shown
from flowspark.plans.registry import query
from flowspark.session import scratch_path
from flowspark.sources import flow_csv
from flowspark.sources.tables import with_row_index, write_flows


def labelled(spark, sf):
    return view(spark, sf, "labelled")


_TEXT = "coalesce(trim(label), 'nan')"


@query("pick_label", with_views("labelled", f"SELECT doc_id, {_TEXT} AS label FROM labelled"))
def pick_label(spark, sf):
    named = labelled(spark, sf).select("doc_id", F.col("label").alias("Attack Type"))
    return sm.unify_label(named, "train")


@query("binary_label", with_views("labelled", f"""
SELECT doc_id, CAST(upper({_TEXT}) <> 'BENIGN' AS INT) AS y_true FROM labelled"""))
def binary_label(spark, sf):
    return sm.binary_label(labelled(spark, sf)).select("doc_id", "y_true")


@query("canonical_label", with_views("labelled", """
SELECT doc_id, regexp_replace(label, '^Web Attack.*', 'WebAttack') AS label FROM labelled"""))
def canonical(spark, sf):
    return labelled(spark, sf).select("doc_id", canonical_label(F.col("label")).alias("label"))


@query("pick_time", with_views("labelled", """
SELECT doc_id, strftime(make_timestamp(ts_s * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM labelled"""))
def pick_time(spark, sf):
    named = labelled(spark, sf).select("doc_id", F.date_format(
        F.timestamp_seconds("ts_s"), "yyyy-MM-dd HH:mm:ss").alias("Flow Start"))
    return named.select("doc_id", F.date_format(sm.event_time(named), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("synthetic_time", """
SELECT event_id, strftime(TIMESTAMP '2017-06-01 00:00:00' + to_seconds(event_id), '%Y-%m-%d %H:%M:%S') AS t
FROM events""")
def synthetic_time(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return rows.select("event_id", F.date_format(
        sm.event_time(rows, "event_id"), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("drop_invalid_labels", with_views("labelled", """
SELECT doc_id, label FROM labelled WHERE label IS NOT NULL AND trim(label) <> '' AND upper(label) <> 'NAN'"""))
def drop_invalid_labels(spark, sf):
    return cl.drop_invalid_labels(labelled(spark, sf)).select("doc_id", "label")


@query("label_counts", with_views("labelled", """
SELECT file, label, count(*) AS n FROM labelled GROUP BY file, label"""))
def counts(spark, sf):
    return label_counts(labelled(spark, sf), ["file"])


@query("label_index", with_views("labelled", f"""
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY {_TEXT}) - 1 AS INT) AS class_idx FROM labelled"""))
def label_index(spark, sf):
    named = sm.unify_label(labelled(spark, sf))
    return with_label_index(named).select("doc_id", "class_idx")


def _written(spark, df, name):
    """What a sorted table looks like once it is written: files in name order, rows in file order."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return with_row_index(spark, path, "position")


@query("sort_by_time", with_views("labelled", """
SELECT doc_id, ts_s, row_number() OVER (ORDER BY ts_s NULLS LAST, doc_id) - 1 AS position FROM labelled"""))
def sort_by_time(spark, sf):
    return _written(spark, sp.sort_by_time(labelled(spark, sf).select("doc_id", "ts_s"), "ts_s", "doc_id"), "sorted")


@query("global_position", with_views("labelled", """
SELECT doc_id, ts_s, row_number() OVER (ORDER BY ts_s NULLS LAST, doc_id) - 1 AS position FROM labelled"""))
def global_position(spark, sf):
    rows = labelled(spark, sf).select("doc_id", "ts_s")
    return with_position(rows, [F.col("ts_s").asc_nulls_last(), F.col("doc_id")])


@query("time_split", with_views("labelled", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY ts_s NULLS LAST, doc_id) - 1 AS i,
                  count(*) OVER () AS n FROM labelled)
SELECT doc_id, CASE WHEN i < CAST(floor(0.7::DOUBLE * n) AS BIGINT) THEN 'train'
                    WHEN i < CAST(floor((0.7::DOUBLE + 0.15::DOUBLE) * n) AS BIGINT) THEN 'validation'
                    ELSE 'test' END AS part FROM o"""))
def time_split(spark, sf):
    return sp.time_split(labelled(spark, sf), F.col("ts_s"), "doc_id").select("doc_id", "part")


_PER_FILE = 300
_PICKED = f"""
valid AS (SELECT * FROM labelled WHERE label IS NOT NULL),
ranked AS (SELECT *, label <> 'BENIGN' AS attack,
             row_number() OVER (PARTITION BY file, label <> 'BENIGN'
               ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) AS rn FROM valid),
caps AS (SELECT file, least(count(*), {_PER_FILE}) AS cap FROM valid WHERE label <> 'BENIGN' GROUP BY file),
picked AS (SELECT r.* FROM ranked r JOIN caps USING (file) WHERE rn <= cap)"""


def _picked(spark, sf):
    valid = cl.drop_invalid_labels(labelled(spark, sf))
    return sp.balanced_sample(valid, "file", "doc_id", per_file=_PER_FILE)


@query("balanced_sample", with_views("labelled", f"WITH {_PICKED} SELECT file, doc_id, label FROM picked"))
def balanced_sample(spark, sf):
    return _picked(spark, sf).select("file", "doc_id", "label")


@query("union_samples", with_views("labelled", f"""
WITH {_PICKED} SELECT label <> 'BENIGN' AS attack, file, doc_id, label FROM picked"""))
def union_samples(spark, sf):
    """The attack and the benign part of the sample, put together again."""
    picked = _picked(spark, sf).select((is_attack_label(F.col("label")) == 1).alias("attack"), "file", "doc_id", "label")
    return picked.filter("attack").unionByName(picked.filter("NOT attack"))


@query("shuffle_rows", with_views("labelled", f"""
WITH {_PICKED} SELECT doc_id, label, row_number() OVER (ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) - 1 AS position
FROM picked"""))
def shuffle_rows(spark, sf):
    return _written(spark, sp.shuffle_rows(_picked(spark, sf), "doc_id", 42).select("doc_id", "label"), "shuffled")


@query("union_by_name", """
SELECT event_id AS id, value, NULL AS label FROM events
UNION ALL SELECT doc_id, NULL, CAST(toxic AS VARCHAR) FROM labels""")
def union_by_name(spark, sf):
    left = table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    right = table(spark, sf, "labels").select(F.col("doc_id").alias("id"),
                                              F.col("toxic").cast("string").alias("label"))
    return left.unionByName(right, allowMissingColumns=True)


@query("dedup_files", """
SELECT split_part(url, '/', 3) AS name, min(page_id) AS ord, arg_min(url, page_id) AS path
FROM pages GROUP BY 1""")
def dedup_files(spark, sf):
    files = table(spark, sf, "pages").select(
        F.get(F.split("url", "/"), F.lit(2)).alias("name"), F.col("page_id").alias("ord"),
        F.col("url").alias("path"))
    return sp.dedup_files(files)


# ---- CSV round trips -----------------------------------------------------------------------

_FLOAT = """CASE WHEN {x} IS NULL OR isnan({x}) THEN 'none' WHEN isinf({x}) THEN
CASE WHEN {x} > 0 THEN 'inf' ELSE '-inf' END ELSE CAST(CAST(round({x}, 2) * 100 AS BIGINT) AS VARCHAR) END"""


def _as_text(x):
    v = c(x)
    return F.when(v.isNull() | F.isnan(v), F.lit("none")) \
        .when(F.abs(v) == F.lit(float("inf")), F.when(v > 0, F.lit("inf")).otherwise(F.lit("-inf"))) \
        .otherwise(F.round(F.round(v, 2) * 100, 0).cast("bigint").cast("string")).alias(x)


@query("read_flow_csv", with_views("flows_raw", "SELECT row_id, " + ", ".join(
    f'{_FLOAT.format(x=chr(34) + x + chr(34))} AS "{x}"'
    for x in ("flow duration", "flow bytes/s", "total fwd packets")) + ", 'ruhig – ähnlich' AS note FROM flows_raw"))
def read_flow_csv(spark, sf):
    """Writes flow CSV in two encodings with dirty headers, then reads the folder back."""
    path = scratch_path(spark, "csv")
    names = ["flow duration", "flow bytes/s", "total fwd packets"]
    rows = view(spark, sf, "flows_raw").select(
        F.col("row_id").alias(" Row_ID "), *[c(x).alias(f" {x.title()}") for x in names],
        F.lit("ruhig – ähnlich").alias("Note"))
    half = F.col("` Row_ID `") % 2
    rows.filter(half == 0).write.option("header", True).csv(f"{path}/part=a")
    # the second folder holds the same note in Windows-1252 bytes
    rows.filter(half == 1).withColumn("Note", F.lit("ruhig \x96 \xe4hnlich")) \
        .write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/part=b")
    df = flow_csv.read_flow_csv(spark, [f"{path}/part=a", f"{path}/part=b"])
    return df.select(c("row_id").cast("bigint").alias("row_id"), *[_as_text(x) for x in names], "note")


@query("write_flows", flow_sql(FEATURES, extra=', f_ip AS "source ip"'))
def write_flow_table(spark, sf):
    from flowspark.operators.flows import flow_table
    path = scratch_path(spark, "flows")
    write_flows(flow_table(view(spark, sf, "packets")), path)
    return shown(flow_csv.read_flow_csv(spark, path, encoding="utf-8"), FEATURES, "source ip")


@query("discover_and_union", with_views("labelled", f"""
SELECT doc_id, {_TEXT} AS label,
       CASE WHEN doc_id % 3 = 2 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS "flow duration" FROM labelled"""))
def discover_and_union(spark, sf):
    """Labelled files of three header layouts in one folder, found and united."""
    folder = scratch_path(spark, "days")
    rows = labelled(spark, sf).select("doc_id", "n_chars", "label")
    layouts = [("flow duration", " Label"), ("Flow Duration ", "attack_cat"), (None, "class")]
    for i, (chars, label) in enumerate(layouts):
        picked = [F.col("doc_id").alias("Doc_Id"), F.col("label").alias(label)]
        if chars:
            picked.append(F.col("n_chars").alias(chars))
        rows.filter(F.col("doc_id") % 3 == i).select(*picked).write.mode("append") \
            .option("header", True).csv(folder)
    df = flow_csv.discover_and_union(spark, folder)
    return df.select(c("doc_id").cast("bigint").alias("doc_id"), "label", c("flow duration"))
