"""Queries over embeddings."""

from pyspark.sql import functions as F

from trackmill.functions import vectors
from trackmill.operators import identity as idn
from trackmill.ordered import with_rank_order
from trackmill.plans import bindings as b
from trackmill.plans.registry import query

# mean of unit vectors per key, normalised again
MEANS = """{n}_m AS (SELECT {k}, pos, avg(u) AS m FROM unit {w} GROUP BY ALL),
{n} AS (SELECT {k}, pos, m / (sqrt(sum(m * m) OVER (PARTITION BY {k})) + 1e-9) AS x FROM {n}_m)"""


@query("unit_vector", f"WITH {b.EMBEDDINGS} SELECT clip, round(sum(u), 6) AS total, round(sum(u * u), 6) AS norm FROM unit GROUP BY 1")
def unit_vector(spark, d):
    u = vectors.unit(F.col("emb"))
    return b.embeddings(spark, d).select("clip", u.alias("u")).select(
        "clip", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
        F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("norm"))


PROTO = b.EMBEDDINGS + ", " + MEANS.format(n="proto", k="session, name", w="WHERE clip % 2 = 0")


def gallery(spark, d):
    return b.embeddings(spark, d).where("clip % 2 = 0").select("session", "name", "emb")


@query("prototypes", f"WITH {PROTO} SELECT session, name, pos, round(x, 6) AS x FROM proto")
def prototypes(spark, d):
    p = idn.prototypes(gallery(spark, d))
    return p.select("session", "name", F.posexplode("emb").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("mean_embedding", f"WITH {b.EMBEDDINGS}, {MEANS.format(n='me', k='grp', w='').replace('FROM unit', 'FROM (SELECT clip % 40 AS grp, * FROM unit WHERE clip % 31 + 10 >= 20 AND clip % 13 >= 8)')} "
       "SELECT grp AS clip, pos, round(x, 6) AS x FROM me")
def mean_embedding(spark, d):
    e = b.embeddings(spark, d).select(
        (F.col("clip") % 40).alias("clip"), (F.col("clip") % 31 + 10).alias("h"), (F.col("clip") % 13).alias("w"), "emb")
    return idn.mean_embedding(e).select("clip", F.posexplode("emb").alias("pos", "x")).withColumn("x", F.round("x", 6))


GROUPED = b.EMBEDDINGS + """, lab AS (SELECT DISTINCT session, clip, label, name FROM emb),
grp AS (SELECT session, label, count(*) AS n, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, min(clip)) - 1 AS group_no
  FROM lab GROUP BY 1, 2)"""


@query("group_embeddings", f"WITH {GROUPED} SELECT session, clip, group_no FROM lab JOIN grp USING (session, label)")
def group_embeddings(spark, d):
    return idn.group_embeddings(b.embeddings(spark, d))


@query("group_embeddings_in_rounds", f"WITH {GROUPED} SELECT session, clip, group_no FROM lab JOIN grp USING (session, label)")
def group_embeddings_in_rounds(spark, d):
    """The same groups; sessions of more than 100 points go through rounds of jobs."""
    return idn.group_embeddings(b.embeddings(spark, d), limit=100)


def by_label(spark, d):
    """embeddings grouped by label, numbered like groups: largest first."""
    e = b.embeddings(spark, d)
    n = e.groupBy("session", "label").agg((-F.count("*")).alias("_neg"), F.min("clip").alias("_first"))
    n = with_rank_order(n, ["session"], ["_neg", "_first"], "no").select("session", "label", (F.col("no") - 1).alias("group_no"))
    # labels 0-2 carry a tag on every fourth clip
    tag = F.when((F.col("label") < 3) & (F.col("clip") % 4 == 0), F.concat(F.lit("T"), (F.col("clip") % 3).cast("string")))
    return e.join(n, ["session", "label"]).withColumn("tag", tag)


SIMS = GROUPED + ", " + MEANS.format(n="proto", k="session, name", w="WHERE clip % 2 = 0") + ", " + MEANS.format(
    n="cen", k="session, group_no", w="JOIN grp USING (session, label)") + """, pairs AS (
  SELECT c.session, c.group_no, p.session AS psession, p.name, sum(c.x * p.x) AS sim FROM cen c JOIN proto p USING (pos) GROUP BY ALL),
named AS (SELECT session, group_no, name, max(sim) AS sim FROM pairs GROUP BY ALL),
top2 AS (SELECT *, row_number() OVER (PARTITION BY session, group_no ORDER BY sim DESC, name) AS rank FROM named)"""


@query("name_similarity", f"WITH {SIMS} SELECT session, group_no, rank, name, round(sim, 6) AS sim FROM top2 WHERE rank <= 2")
def name_similarity(spark, d):
    c = idn.centroids(by_label(spark, d))
    out = idn.name_similarity(c, idn.prototypes(gallery(spark, d)))
    return out.select("session", "group_no", "rank", "name", F.round("sim", 6).alias("sim"))


NAMED = SIMS + """, gap AS (SELECT session, group_no, max(name) FILTER (rank = 1) AS name,
  max(sim) FILTER (rank = 1) - greatest(coalesce(max(sim) FILTER (rank = 2), 0.0), 0.86) AS gap FROM top2 GROUP BY 1, 2)"""


@query("name_top2", f"""WITH {NAMED} SELECT session, group_no, CASE WHEN gap >= 0.03 THEN name END AS name, round(gap, 3) AS confidence,
  CASE WHEN gap >= 0.03 THEN 'matched' END AS how FROM gap""")
def name_top2(spark, d):
    c = idn.centroids(by_label(spark, d))
    return idn.name_top2(idn.name_similarity(c, idn.prototypes(gallery(spark, d))))


TAGGED = NAMED + """, votes AS (SELECT session, label, 'T' || clip % 3 AS tag, count(*) AS v, min(clip) AS first FROM lab
  WHERE label < 3 AND clip % 4 = 0 GROUP BY ALL),
won AS (SELECT session, label, arg_max(tag, (v, -first)) AS tag, max(v) AS v FROM votes GROUP BY 1, 2),
ng AS (SELECT g.session, group_no, n AS size, coalesce(tag, CASE WHEN gap >= 0.03 THEN name END) AS name,
  round(CASE WHEN tag IS NOT NULL THEN v / n ELSE gap END, 3) AS confidence,
  CASE WHEN tag IS NOT NULL THEN 'tagged' WHEN gap >= 0.03 THEN 'matched' END AS how
  FROM grp g LEFT JOIN won USING (session, label) LEFT JOIN gap USING (session, group_no))"""


@query("name_groups", f"WITH {TAGGED} SELECT * FROM ng")
def name_groups(spark, d):
    return idn.name_groups(by_label(spark, d), gallery(spark, d))


@query("scan_summary", f"""WITH {TAGGED} SELECT session, CAST(sum(size) AS BIGINT) AS goals, count(*) AS groups,
  CAST(coalesce(sum(size) FILTER (name IS NOT NULL), 0) AS BIGINT) AS named,
  CAST(coalesce(sum(size) FILTER (how = 'tagged'), 0) AS BIGINT) AS tagged FROM ng GROUP BY 1""")
def scan_summary(spark, d):
    return idn.scan_summary(name_groups(spark, d))


@query("refresh_gallery", """SELECT vec_id AS key, CASE WHEN vec_id % 3 = 0 THEN 'T' || label ELSE 'P' || label END AS name, vec_id % 3 AS session
FROM embeddings WHERE CASE WHEN vec_id % 3 <= 1 THEN vec_id % 3 = 0 ELSE vec_id % 2 = 0 END""")
def refresh_gallery(spark, d):
    e = b.embeddings(spark, d).withColumnRenamed("clip", "key")
    old = e.where("key % 2 = 0").select("key", "session", "name", "emb")
    seen = e.where("key % 3 <= 1").select(
        "key", "session", F.when(F.col("key") % 3 == 0, F.concat(F.lit("T"), F.col("label").cast("string"))).alias("tag"), "emb")
    return idn.refresh_gallery(old, seen).select("key", "name", "session")
