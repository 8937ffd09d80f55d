"""Queries of vector indexes, diverse results, clusters and packed lines."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import retrieval, vectors
from ..sources.tables import table
from .registry import query


@query("ivf_search")
def ivf_search(spark, d):
    """Ten neighbours of every hundredth vector from an inverted file that finds nine of ten; tested on these very tables."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.ivf_search(rows, rows.where("vec_id % 100 = 0"), 10)


@query("diverse_results")
def diverse_results(spark, d):
    """Five of the twenty nearest vectors of every hundredth one, that are close to it and not to each other."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    near = retrieval.nearest(rows, rows.where("vec_id % 100 = 0"), 20).join(rows.withColumnRenamed("embedding", "v"), "vec_id")
    return vectors.diverse(near, 5, 0.7)


@query("clusters")
def clusters(spark, d):
    """Clusters of vectors: size, most frequent label, its share, and the mean cosine with the centre."""
    rows = table(spark, d, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").select("vec_id", "label", array_to_vector("embedding").alias("features"), "embedding")
    model = KMeans(k=10, seed=7, distanceMeasure="cosine", maxIter=20).fit(rows)
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    said = model.transform(rows).select("vec_id", "label", "embedding", F.col("prediction").alias("cluster")).join(F.broadcast(centres), "cluster")  # a row for each cluster
    counts = said.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum(retrieval.cosine(F.col("centre"), F.col("embedding"))).alias("s"))
    most = counts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", (-F.col("label")).alias("l"))).alias("label"), F.max("n").alias("m"), F.sum("s").alias("s"))
    return most.select("cluster", "n", "label", F.round(F.col("m") / F.col("n"), 6).alias("purity"), F.round(F.col("s") / F.col("n"), 6).alias("closeness"))


@query(
    "packed_lines",
    """SELECT doc_id, s[2] AS n_chunks, s[1] AS last_chars FROM (SELECT doc_id, list_reduce(list([n, 1]::BIGINT[] ORDER BY i), lambda a, e: CASE WHEN a[1] + 1 + e[1] <= 800 THEN [a[1] + 1 + e[1], a[2]] ELSE [e[1], a[2] + 1] END) AS s
    FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS n, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) GROUP BY doc_id)""",
)
def packed_lines(spark, d):
    """Lines packed one after another into chunks of up to 800 signs; a longer line is a chunk of its own."""
    lines = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long")).alias("n"))
    start = F.struct(F.element_at("n", 1).alias("size"), F.lit(1).cast("long").alias("chunks"))
    longer = lambda a, e: a["size"] + 1 + e
    step = lambda a, e: F.struct(F.when(longer(a, e) <= 800, longer(a, e)).otherwise(e).alias("size"), F.when(longer(a, e) <= 800, a["chunks"]).otherwise(a["chunks"] + 1).alias("chunks"))
    packed = lines.select("doc_id", F.aggregate(F.slice("n", F.lit(2), F.size("n")), start, step).alias("s"))
    return packed.select("doc_id", F.col("s.chunks").alias("n_chunks"), F.col("s.size").alias("last_chars"))


@query(
    "title_groups",
    """SELECT doc_id, g AS section, count(*)::BIGINT AS n_lines, sum(length(t))::BIGINT AS chars FROM (SELECT doc_id, i, t, sum(CASE WHEN length(t) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS g FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)) GROUP BY 1, 2""",
)
def title_groups(spark, d):
    """Sections of a text: a short line begins one, and the lines after it belong to it."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).select("doc_id", "i", F.length("t").alias("c"))
    section = F.sum(F.when(F.col("c") < 60, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("section", section).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum("c").cast("long").alias("chars"))
