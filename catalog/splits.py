"""Holdout, shuffles, shards and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, table
from strataframe.operators.frame import row_batches
from strataframe.operators.splits import (
    assign_shard, assign_shard_exact, batches, holdout_split, shuffle, shuffled_position, split_counts)
from strataframe.session import scratch_path
from strataframe.sources.files import scan_parquet
from strataframe.sources.shards import export_shards, read_shards, save_manifest

SIZE = 100
MD5 = "md5('42:' || CAST(o_orderkey AS VARCHAR))"
SHARD = "CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % {n}"


def _batched(spark, sf_dir):
    return row_batches(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", SIZE)


def _split_sql(order: str) -> str:
    return f"""
b AS (SELECT o_orderkey, o_orderkey // {SIZE} AS batch_id, o_orderkey // {SIZE} * {SIZE} AS start,
             least((o_orderkey // {SIZE} + 1) * {SIZE} - 1, (SELECT max(o_orderkey) FROM orders)) AS "end"
      FROM orders),
v AS (SELECT batch_id FROM (SELECT DISTINCT batch_id, start, "end" FROM b) ORDER BY {order} DESC LIMIT 5),
s AS (SELECT o_orderkey, batch_id, CASE WHEN batch_id IN (SELECT batch_id FROM v) THEN 'val' ELSE 'train' END AS split
      FROM b)"""


BY_NUMBER = _split_sql("batch_id")
BY_NAME = _split_sql("CAST(start AS VARCHAR) || '_' || CAST(\"end\" AS VARCHAR)")


@query("holdout_split", f"""
WITH {BY_NAME} SELECT o_orderkey, batch_id, 'lexicographic' AS "order", split FROM s
UNION ALL SELECT * FROM (WITH {BY_NUMBER} SELECT o_orderkey, batch_id, 'numeric', split FROM s)""")
def holdout(spark, sf_dir):
    rows = _batched(spark, sf_dir)
    parts = [holdout_split(rows, 5, order).select("o_orderkey", "batch_id", F.lit(order).alias("order"), "split")
             for order in ("lexicographic", "numeric")]
    return parts[0].unionByName(parts[1])


@query("split_manifest", f"WITH {BY_NUMBER} SELECT split, count(*) AS n FROM s GROUP BY split")
def manifest(spark, sf_dir):
    path = scratch_path(spark, "manifest")
    save_manifest(split_counts(holdout_split(_batched(spark, sf_dir), 5)), path)
    return scan_parquet(spark, path)


@query("shuffle_order", f"""
SELECT o_orderkey, {MD5} AS shuffle_key, row_number() OVER (ORDER BY {MD5}) - 1 AS position FROM orders""")
def order(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    places = shuffled_position(orders, "o_orderkey", []).select("o_orderkey", "position")
    return shuffle(places, "o_orderkey").select("o_orderkey", "shuffle_key", "position")


@query("assign_shard", f"SELECT o_orderkey, {SHARD.format(digest=MD5, n=100)} AS shard FROM orders")
def shard(spark, sf_dir):
    return assign_shard(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("assign_shard_exact", f"""
SELECT o_orderkey, o_orderkey // {SIZE} AS batch_id,
       (row_number() OVER (PARTITION BY o_orderkey // {SIZE} ORDER BY {MD5}) - 1) % 100 AS shard FROM orders""")
def shard_exact(spark, sf_dir):
    rows = _batched(spark, sf_dir).select("o_orderkey", "batch_id")
    return assign_shard_exact(rows, "o_orderkey", "batch_id", 100)


@query("batch_ids", f"""
WITH k AS (SELECT o_orderkey, {SHARD.format(digest=MD5, n=7)} AS shard, {MD5} AS digest FROM orders),
p AS (SELECT o_orderkey, shard, row_number() OVER (PARTITION BY shard ORDER BY digest) - 1 AS position,
             count(*) OVER (PARTITION BY shard) AS n FROM k)
SELECT o_orderkey, shard, position // 64 AS batch, position, true AS drop_last FROM p WHERE position // 64 < n // 64
UNION ALL SELECT o_orderkey, shard, position // 64, position, false FROM p""")
def numbered(spark, sf_dir):
    rows = assign_shard(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)
    parts = [batches(rows, "o_orderkey", "shard", 64, drop).withColumn("drop_last", F.lit(drop))
             for drop in (True, False)]
    return parts[0].unionByName(parts[1])


SHARDED = f"""
sh AS (SELECT split, o_orderkey, CASE split WHEN 'train' THEN {SHARD.format(digest=MD5, n=8)}
                                           ELSE {SHARD.format(digest=MD5, n=2)} END AS shard FROM s)"""
COUNTS = {"train": 8, "val": 2}


def _exported(spark, sf_dir, name):
    path = scratch_path(spark, name)
    rows = holdout_split(_batched(spark, sf_dir), 5).select("o_orderkey", "split")
    export_shards(rows, path, "o_orderkey", COUNTS, rows_per_file=5000)
    return path


@query("export_shards", f"WITH {BY_NUMBER}, {SHARDED} SELECT split, CAST(shard AS INTEGER) AS shard, o_orderkey FROM sh")
def exported(spark, sf_dir):
    return scan_parquet(spark, _exported(spark, sf_dir, "shards")).select("split", "shard", "o_orderkey")


@query("sample_shards", f"""
WITH {BY_NUMBER}, {SHARDED},
picked AS (SELECT DISTINCT shard, md5('7:' || CAST(shard AS VARCHAR)) AS h FROM sh WHERE split = 'train' ORDER BY h LIMIT 3)
SELECT CAST(shard AS INTEGER) AS shard, o_orderkey FROM sh
WHERE split = 'train' AND shard IN (SELECT shard FROM picked)""")
def sampled(spark, sf_dir):
    path = _exported(spark, sf_dir, "sampled")
    return read_shards(spark, path, "train", 3, seed=7).select("shard", "o_orderkey")


@query("export_shards_exact", f"""
WITH {BY_NUMBER}, n AS (
  SELECT split, o_orderkey, row_number() OVER (PARTITION BY split ORDER BY {MD5}, o_orderkey) - 1 AS position,
         count(*) OVER (PARTITION BY split) AS n FROM s)
SELECT split, CAST(position * CASE split WHEN 'train' THEN 8 ELSE 2 END // n AS INTEGER) AS shard, o_orderkey FROM n""")
def exported_exact(spark, sf_dir):
    """Shards that differ by one row at most."""
    path = scratch_path(spark, "exact")
    rows = holdout_split(_batched(spark, sf_dir), 5).select("o_orderkey", "split")
    export_shards(rows, path, "o_orderkey", COUNTS, rows_per_file=500, balance="exact")
    return scan_parquet(spark, path).select("split", "shard", "o_orderkey")
