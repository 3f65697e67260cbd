"""The eight scalers, forward and back, for columns and for packed profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    SAMPLE_COLUMNS, SAMPLES, query, r6, rounded, samples, stats_sql, table)
from strataframe.functions.scaling import collect_stats, scale, scale_vector
from strataframe.operators.stats import column_stats, level_stats

# SQL of each method over {c} with statistics {c}__*.
METHODS = {
    "standard": "({c} - {c}__mean) / greatest({c}__std, 1e-52)",
    "robust": "({c} - {c}__q2) / greatest({c}__q3 - {c}__q1, 1e-52)",
    "minmax": "({c} - {c}__min) / greatest({c}__max - {c}__min, 1e-52)",
    "minmaxmean": "({c} - {c}__mean) / greatest({c}__max - {c}__min, 1e-52)",
    "minmaxzero": "{c} / greatest({c}__max - {c}__min, 1e-52)",
    "exp": "1 - exp(-{c}__lambda * {c})",
    "std": "{c} / greatest({c}__std, 1e-52)",
    "standard_y": "({c} - {c}__mean) / greatest({c}__std_y, 1e-52)",
}


def _stats(spark, sf_dir):
    return column_stats(samples(spark, sf_dir), SAMPLE_COLUMNS, quantile="exact")


def _register(method: str, sql: str) -> None:
    scaled = ", ".join(f"round({sql.format(c=c)}, 6) AS {c}" for c in SAMPLE_COLUMNS)

    @query(f"scale_{method}", f"WITH {SAMPLES}, {stats_sql('samples', SAMPLE_COLUMNS)} "
                              f"SELECT sample_id, {scaled} FROM samples, st")
    def run(spark, sf_dir):
        rows = samples(spark, sf_dir).drop("o_orderkey")
        # `f` stands for its family and `absent` for nothing.
        return rounded(scale(rows, {method: ["day", "f", "absent"]}, _stats(spark, sf_dir)))


for _method, _sql in METHODS.items():
    _register(_method, _sql)


@query("scale_roundtrip", f"WITH {SAMPLES} SELECT sample_id, "
       + ", ".join(f"round(f_0, 6) AS {m}" for m in METHODS) + " FROM samples")
def roundtrip(spark, sf_dir):
    stats = collect_stats(_stats(spark, sf_dir))
    rows = samples(spark, sf_dir).select("sample_id", *[F.col("f_0").alias(m) for m in METHODS])
    methods = {m: [m] for m in METHODS}
    same = {m: stats["f_0"] for m in METHODS}
    return rounded(scale(scale(rows, methods, same), methods, same, reverse=True))


@query("scale_vector", """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS level,
                  CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
st AS (SELECT level, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS mi, max(x) AS ma FROM x GROUP BY level)
SELECT vec_id, CAST(x.level AS INTEGER) AS level, round((x - mean) / greatest(std, 1e-52), 6) AS standard,
       round((x - mi) / greatest(ma - mi, 1e-52), 6) AS minmax, round(x, 6) AS restored
FROM x JOIN st ON x.level = st.level""")
def vector(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    stats = collect_stats(level_stats(emb, ["embedding"]))
    levels = [stats[f"embedding_{i}"] for i in range(len(stats))]
    emb = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    emb = emb.withColumns({n: scale_vector("v", n, levels) for n in ("standard", "minmax")})
    emb = emb.withColumn("restored", scale_vector("standard", "standard", levels, reverse=True))
    zipped = F.arrays_zip("standard", "minmax", "restored")
    exploded = emb.select("vec_id", F.posexplode(zipped).alias("level", "z"))
    return exploded.select("vec_id", "level", *[
        r6(F.col("z")[n]).alias(n) for n in ("standard", "minmax", "restored")])
