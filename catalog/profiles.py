"""Packing, layouts and profile features."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import PROFILES, TWO_PI, profile_table, query, r6, rounded, table
from strataframe.functions.profiles import (
    assemble_flat, assemble_named, assemble_sequential, flipped_diffs, level_rows, output_layout, pack_families,
    profile_diffs, profile_features, profile_stats, stack_outputs, unpack_families)
from strataframe.schema import ProfileSchema

SMALL = ProfileSchema(in_scalars=("s_a", "s_b"), in_families=("v_a", "v_b"), out_scalars=("o_a",),
                      out_families=("o_v",), levels=32)


def _wide(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("emb"))
    return unpack_families(emb, ["emb"], 64)


@query("family_unpack", "SELECT vec_id, " + ", ".join(
    f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS emb_{i}" for i in range(64)) + " FROM embeddings")
def unpacked(spark, sf_dir):
    return rounded(_wide(spark, sf_dir))


@query("family_pack", """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS level,
       round(CAST(unnest(embedding) AS DOUBLE), 6) AS x FROM embeddings""")
def packed(spark, sf_dir):
    """The columns arrive in text order, where emb_10 comes before emb_2."""
    wide = _wide(spark, sf_dir)
    shuffled = wide.select("vec_id", *sorted(c for c in wide.columns if c != "vec_id"))
    profiles = pack_families(shuffled, ["emb"])
    return rounded(profiles.select("vec_id", F.posexplode("emb").alias("level", "x")))


@query("assemble_flat", f"""
WITH {PROFILES},
flat AS (SELECT sample_id, [s_a, s_b] || v_a || v_b AS input, [o_a] || o_v AS labels,
                [lat / 90, cos({TWO_PI} * lon / 360), sin({TWO_PI} * lon / 360), cos({TWO_PI} * hour / 24),
                 sin({TWO_PI} * hour / 24), cos({TWO_PI} * day / 366), sin({TWO_PI} * day / 366)] AS aux
         FROM profiles)
SELECT sample_id, 'input' AS part, CAST(generate_subscripts(input, 1) - 1 AS INTEGER) AS pos,
       round(unnest(input), 5) AS value FROM flat
UNION ALL SELECT sample_id, 'labels', generate_subscripts(labels, 1) - 1, round(unnest(labels), 5) FROM flat
UNION ALL SELECT sample_id, 'aux', generate_subscripts(aux, 1) - 1, round(unnest(aux), 5) FROM flat""")
def flat(spark, sf_dir):
    rows = assemble_flat(profile_table(spark, sf_dir), SMALL, element="double")
    parts = [rows.select("sample_id", F.lit(p).alias("part"),
                         F.posexplode(F.col(p).cast("array<double>")).alias("pos", "value"))
             for p in ("input", "labels", "aux")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 5)


@query("assemble_named", f"""
WITH {PROFILES}
SELECT sample_id, round(s_a, 4) AS s_a, round(v_a[3], 4) AS v_a_2,
       round(list_sum([o_a] || o_v), 4) AS labels_sum, len([o_a] || o_v) AS labels_len FROM profiles""")
def named(spark, sf_dir):
    rows = assemble_named(profile_table(spark, sf_dir), SMALL)
    total = F.aggregate("labels", F.lit(0.0), lambda a, x: a + x)
    return rows.select("sample_id", r6("s_a", 4).alias("s_a"), r6(F.col("v_a")[2], 4).alias("v_a_2"),
                       r6(total, 4).alias("labels_sum"), F.size("labels").cast("long").alias("labels_len"))


@query("assemble_sequential", f"""
WITH {PROFILES},
f AS (SELECT sample_id, s_a, s_b, len(o_v) + 1 AS n_labels, 0 AS family, v_a AS v FROM profiles
      UNION ALL SELECT sample_id, s_a, s_b, len(o_v) + 1, 1, v_b FROM profiles)
SELECT sample_id, round(s_a, 6) AS x_scalar_0, round(s_b, 6) AS x_scalar_1, n_labels,
       CAST(family AS INTEGER) AS family, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS level,
       round(unnest(v), 6) AS x FROM f""")
def sequential(spark, sf_dir):
    rows = assemble_sequential(profile_table(spark, sf_dir), SMALL, element="double")
    families = rows.select(
        "sample_id", F.col("x_scalar")[0].alias("x_scalar_0"), F.col("x_scalar")[1].alias("x_scalar_1"),
        F.size("labels").cast("long").alias("n_labels"), F.posexplode("x_vector").alias("family", "v"))
    return rounded(families.select(
        "sample_id", "x_scalar_0", "x_scalar_1", "n_labels", "family", F.posexplode("v").alias("level", "x")))


LEVEL_ROWS = """
lv AS (SELECT sample_id, s_a, s_b, generate_subscripts(v_a, 1) - 1 AS level, unnest(v_a) AS v_a, unnest(v_b) AS v_b
       FROM profiles)"""


@query("level_rows", f"""
WITH {PROFILES}, {LEVEL_ROWS}
SELECT sample_id, round(s_a, 6) AS s_a, round(s_b, 6) AS s_b, CAST(level AS INTEGER) AS level,
       round(v_a, 6) AS v_a, round(v_b, 6) AS v_b FROM lv""")
def levels(spark, sf_dir):
    return rounded(level_rows(profile_table(spark, sf_dir), "sample_id", ["s_a", "s_b"], ["v_a", "v_b"]))


@query("profile_diffs", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
i AS (SELECT vec_id, v, unnest(range(0, 63)) AS pos FROM e)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v[pos + 2] - v[pos + 1], 6) AS diff,
       round(v[63 - pos] - v[64 - pos], 6) AS flipped FROM i""")
def diffs(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    zipped = F.arrays_zip(profile_diffs(v).alias("diff"), flipped_diffs(v).alias("flipped"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(zipped).alias("pos", "z"))
    return rounded(rows.select("vec_id", "pos", F.col("z.diff").alias("diff"), F.col("z.flipped").alias("flipped")))


@query("profile_stats", """
SELECT vec_id, round(list_min(CAST(embedding AS DOUBLE[])), 6) AS "min",
       round(list_avg(CAST(embedding AS DOUBLE[])), 6) AS mean,
       round(list_max(CAST(embedding AS DOUBLE[])), 6) AS "max" FROM embeddings""")
def stats(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return rounded(table(spark, sf_dir, "embeddings").select(
        "vec_id", *[c.alias(n) for n, c in profile_stats(v).items()]))


@query("profile_features", f"""
WITH {PROFILES},
d AS (SELECT sample_id, [s_a, s_b]
        || list_transform(range(1, 32), lambda i: v_a[i + 1] - v_a[i])
        || list_transform(range(1, 32), lambda i: v_b[i + 1] - v_b[i])
        || list_transform(range(1, 32), lambda i: v_a[32 - i] - v_a[33 - i])
        || list_transform(range(1, 32), lambda i: v_b[32 - i] - v_b[33 - i])
        || [list_min(v_a), list_min(v_b), list_avg(v_a), list_avg(v_b), list_max(v_a), list_max(v_b)] AS f
      FROM profiles)
SELECT sample_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, round(unnest(f), 6) AS value FROM d""")
def features(spark, sf_dir):
    f = profile_features([F.col("s_a"), F.col("s_b")], [F.col("v_a"), F.col("v_b")])
    rows = profile_table(spark, sf_dir).select("sample_id", F.posexplode(f).alias("pos", "value"))
    return rounded(rows)


LAYOUT_SQL = f"""
WITH {PROFILES}, {LEVEL_ROWS},
o AS (SELECT sample_id, [avg(v_a * s_a), avg(v_b - v_a)] || list(v_a + s_b ORDER BY level) || list(v_b ORDER BY level) AS y
      FROM lv GROUP BY sample_id)
SELECT sample_id, CAST(generate_subscripts(y, 1) - 1 AS INTEGER) AS pos, round(unnest(y), 6) AS y FROM o"""


@query("output_layout", LAYOUT_SQL)
def layout(spark, sf_dir):
    """Outputs that are arrays over the levels already are put together without a shuffle."""
    scalars = [F.transform("v_a", lambda v: v * F.col("s_a")), F.zip_with("v_b", "v_a", lambda b, a: b - a)]
    outputs = stack_outputs([F.transform("v_a", lambda v: v + F.col("s_b")), F.col("v_b")], scalars)
    return rounded(profile_table(spark, sf_dir).select("sample_id", F.posexplode(outputs).alias("pos", "y")))


@query("output_layout_levels", LAYOUT_SQL)
def layout_of_levels(spark, sf_dir):
    """The same from one row per sample and level."""
    rows = level_rows(profile_table(spark, sf_dir), "sample_id", ["s_a", "s_b"], ["v_a", "v_b"]).select(
        "sample_id", "level", (F.col("v_a") * F.col("s_a")).alias("y_1"), (F.col("v_b") - F.col("v_a")).alias("y_2"),
        (F.col("v_a") + F.col("s_b")).alias("p_1"), F.col("v_b").alias("p_2"))
    outputs = output_layout(rows, "sample_id", ["y_1", "y_2"], ["p_1", "p_2"])
    return rounded(outputs.select("sample_id", F.posexplode("outputs").alias("pos", "y")))
