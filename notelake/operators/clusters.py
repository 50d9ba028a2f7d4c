"""Clusters of notes, from the specification documents: centroids, evolution, overrides, quality. Density clustering is in ``density``, the reduction in ``layout``; k-means with silhouette, after PCA if asked, is the fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import dot
from ..functions.text import CJK
from .components import components
from .search import blocks, similarities


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def centroids(vectors: DataFrame) -> DataFrame:
    """(cluster, centroid) of vectors(cluster, id, embedding)."""
    parts = vectors.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def representatives(vectors: DataFrame, centers: DataFrame, n: int = 5) -> DataFrame:
    """The n notes nearest to each centroid by dot product."""
    near = vectors.join(centers, "cluster").select("cluster", "id", dot(F.col("embedding"), F.col("centroid")).alias("similarity"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= n)


def assign(vectors: DataFrame, centers: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, cluster, similarity): the nearest centroid, -1 under the threshold. Centroids go in blocks of a bounded number, each of which scans the vectors once."""
    stated = centers.select(F.col("cluster").alias("query_id"), F.col("centroid").alias("query"))
    pairs = similarities(vectors.select("id", "embedding"), stated, "id").select("id", F.col("query_id").alias("cluster"), "similarity")
    best = pairs.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("cluster")).alias("c"))).alias("m"))
    return best.select("id", F.when(F.col("m.similarity") >= least, -F.col("m.c")).otherwise(-1).alias("cluster"), F.col("m.similarity").alias("similarity"))


def evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_cluster, new_cluster, jaccard, change) of memberships(cluster, id): renamed over 0.6, remapped over 0.2, else dissolved."""
    both = old.select(F.col("cluster").alias("o"), "id").join(new.select(F.col("cluster").alias("n"), "id"), "id").groupBy("o", "n").agg(F.count("*").alias("k"))
    size = lambda df, a, b: df.groupBy(F.col("cluster").alias(a)).agg(F.count("*").alias(b))
    scored = both.join(size(old, "o", "so"), "o").join(size(new, "n", "sn"), "n").withColumn("j", F.col("k") / (F.col("so") + F.col("sn") - F.col("k")).cast("double"))
    best = scored.groupBy("o").agg(F.max_by(F.struct("n", "j"), F.struct("j", -F.col("n"))).alias("b"))
    j = F.coalesce("b.j", F.lit(0.0))
    return old.select(F.col("cluster").alias("o")).distinct().join(best, "o", "left").select(F.col("o").alias("old_cluster"), F.when(j > 0.2, F.col("b.n")).otherwise(-1).alias("new_cluster"), j.alias("jaccard"), F.when(j > 0.6, "renamed").when(j > 0.2, "remapped").otherwise("dissolved").alias("change"))


def effective(members: Column, added: Column, removed: Column) -> Column:
    return F.array_except(F.array_union(members, added), removed)


def movements(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes whose cluster differs, null meaning absent."""
    j = old.select("id", F.col("cluster").alias("from_cluster")).join(new.select("id", F.col("cluster").alias("to_cluster")), "id", "full_outer")
    return j.where(~F.col("from_cluster").eqNullSafe(F.col("to_cluster")))


def concept_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """concepts(concept_id, name) before and after: renamed, dissolved, created."""
    j = old.select("concept_id", F.col("name").alias("old_name")).join(new.select("concept_id", F.col("name").alias("new_name")), "concept_id", "full_outer")
    change = F.when(F.col("new_name").isNull(), "dissolved").when(F.col("old_name").isNull(), "created").when(F.col("old_name") != F.col("new_name"), "renamed")
    return j.withColumn("change", change).where("change is not null")


def traits(members: DataFrame, edges: DataFrame, least: float = 0.3) -> DataFrame:
    """Per cluster of members(cluster, id, folder, tags): size, tags of at least 30 % of its notes, its commonest folder, share of possible inner links."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    tag = members.select("cluster", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("cluster", "tag").agg(F.count("*").alias("k")).join(size, "cluster").where(F.col("k") >= least * F.col("size"))
    tags = tag.groupBy("cluster").agg(F.array_sort(F.collect_list("tag")).alias("dominant_tags"))
    folders = members.groupBy("cluster", "folder").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.min_by("folder", F.struct(-F.col("k"), "folder")).alias("folder"))
    who = members.select("id", "cluster")
    inner = edges.join(who.toDF("source", "c1"), "source").join(who.toDF("target", "c2"), "target").where("c1 = c2").groupBy(F.col("c1").alias("cluster")).agg(F.count("*").alias("inner_links"))
    out = size.join(tags, "cluster", "left").join(folders, "cluster").join(inner, "cluster", "left")
    density = F.coalesce(F.try_divide(F.coalesce("inner_links", F.lit(0)).cast("double"), (F.col("size") * (F.col("size") - 1)).cast("double")), F.lit(0.0))
    return out.select("cluster", "size", F.coalesce("dominant_tags", F.array().cast("array<string>")).alias("dominant_tags"), "folder", density.alias("link_density"))


def gini(sizes: DataFrame) -> DataFrame:
    """Gini coefficient of cluster sizes(size). Clusters are few: the ranking is one small task."""
    ranked = sizes.select("size", F.row_number().over(Window.orderBy("size")).alias("r"))
    n, s = F.count("*"), F.sum("size")
    return ranked.agg(((2 * F.sum(F.col("r") * F.col("size"))) / (n * s) - (n + 1) / n).alias("gini"))


def noise_ratio(members: DataFrame) -> DataFrame:
    return members.agg((F.count_if(F.col("cluster") == -1) / F.count("*")).alias("noise_ratio"))


def kmeans(vectors: DataFrame, k: int, dimensions: int | None = None, seed: int = 7) -> tuple[DataFrame, float]:
    """(id, cluster) and the silhouette of vectors(id, embedding), after PCA if asked."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    if dimensions:
        rows = PCA(k=dimensions, inputCol="features", outputCol="reduced").fit(rows).transform(rows).select("id", F.col("reduced").alias("features"))
    made = KMeans(k=k, seed=seed).fit(rows).transform(rows).select("id", "features", F.col("prediction").alias("cluster"))
    return made.select("id", "cluster"), ClusteringEvaluator(predictionCol="cluster").evaluate(made)


def by_folder(notes: DataFrame) -> DataFrame:
    """The first rule-based pass: a cluster per top folder."""
    return notes.select("path", F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("").alias("cluster"))


def needs_refit(old: DataFrame, new: DataFrame, most: float = 0.05) -> DataFrame:
    """One row (changed, total, refit): notes(id, content_hash) that came, went or changed, and whether they are more than so large a share; below it ``assign`` is enough."""
    j = old.select("id", F.col("content_hash").alias("a")).join(new.select("id", F.col("content_hash").alias("b")), "id", "full_outer")
    out = j.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.count("b").alias("total"))
    return out.withColumn("refit", F.col("changed") > most * F.col("total"))


def evolve(concepts: DataFrame, members: DataFrame, new: DataFrame, names: DataFrame) -> DataFrame:
    """Tracked concepts(concept_id, cluster, name) with members(concept_id, id) after a new clustering new(cluster, id) with names(cluster, name).

    (concept_id, cluster, name, from_cluster, change, overlap): the cluster of the largest overlap over 0.2, renamed over 0.6, remapped with the cluster's name under it; null cluster: dissolved."""
    best = evolution(members.select(F.col("concept_id").alias("cluster"), "id"), new)
    j = concepts.join(best, concepts["concept_id"] == best["old_cluster"], "left")
    hit = F.col("change").isin("renamed", "remapped")
    j = j.select("concept_id", F.col("cluster").alias("from_cluster"), "name", F.when(hit, F.col("new_cluster")).alias("cluster"), F.coalesce("change", F.lit("dissolved")).alias("change"), F.coalesce("jaccard", F.lit(0.0)).alias("overlap"))
    j = j.join(names.select("cluster", F.col("name").alias("_n")), "cluster", "left")
    name = F.when((F.col("change") == "remapped") & (F.col("overlap") < 0.6), F.coalesce("_n", "name")).otherwise(F.col("name"))
    return j.select("concept_id", "cluster", name.alias("name"), "from_cluster", "change", "overlap")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0).cast("double"), lambda s, x: s + x))


def compactness(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(cluster, size, compactness): the mean distance of a cluster's vectors to its centroid."""
    near = vectors.join(centers, "cluster").select("cluster", distance(F.col("embedding"), F.col("centroid")).alias("d"))
    return near.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("d").alias("compactness"))


def intra_similarity(vectors: DataFrame) -> DataFrame:
    """(cluster, similarity): the mean cosine of all pairs of a cluster of two or more, from the sum of its unit vectors: (|sum|^2 - n) / (n (n - 1))."""
    unit = vectors.select("cluster", F.transform("embedding", lambda x: x.cast("double") / F.sqrt(dot(F.col("embedding"), F.col("embedding")))).alias("u"))
    sums = unit.select("cluster", F.posexplode("u").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    out = sums.groupBy("cluster").agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.max("n").alias("n"))
    return out.where("n > 1").select("cluster", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def center_pairs(centers: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of centroids, a < b: centroids are the stated query set and go in blocks."""
    plain = centers.select(F.col("cluster").alias("b"), F.col("centroid").alias("embedding"))
    pairs = [plain.crossJoin(F.broadcast(q)) for q in blocks(centers.select(F.col("cluster").alias("query_id"), F.col("centroid").alias("query")))]
    every = reduce(DataFrame.unionAll, pairs)
    return every.where("query_id < b").select(F.col("query_id").alias("a"), "b", distance(F.col("query"), F.col("embedding")).alias("distance"))


def davies_bouldin(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the largest (scatter + scatter) / distance to another cluster; separation: the mean distance of centroids."""
    scatter = compactness(vectors, centers).select("cluster", "compactness")
    pairs = center_pairs(centers).join(scatter.toDF("a", "sa"), "a").join(scatter.toDF("b", "sb"), "b").withColumn("r", F.try_divide(F.col("sa") + F.col("sb"), F.col("distance")))
    worst = pairs.select(F.explode(F.array("a", "b")).alias("cluster"), "r").groupBy("cluster").agg(F.max("r").alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return worst.crossJoin(F.broadcast(pairs.agg(F.avg("distance").alias("separation"))))  # one row each


def silhouette(vectors: DataFrame) -> DataFrame:
    """(id, cluster, silhouette) of vectors(cluster, id, embedding) by mean squared distances, exact without a pair of vectors: a cluster's count, sum and sum of squares give the mean from any vector to all of it.

    0 for the only vector of a cluster and where there is one cluster. Clusters go in blocks of a bounded number, each of which scans the vectors once."""
    square = dot(F.col("embedding"), F.col("embedding"))
    rows = vectors.select("id", F.col("cluster").alias("own"), "embedding", square.alias("q"))
    parts = rows.select("own", F.posexplode("embedding").alias("i", "x")).groupBy("own", "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    sums = parts.groupBy("own").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("query"))
    size = rows.groupBy("own").agg(F.count("*").alias("n"), F.sum("q").alias("total"))
    near = similarities(rows, sums.select(F.col("own").alias("query_id"), "query"), "id").select("id", "own", "q", F.col("query_id").alias("cluster"), "similarity").join(size.toDF("cluster", "n", "total"), "cluster")
    own = F.col("own") == F.col("cluster")
    mean = (F.col("n") * F.col("q") - 2 * F.col("similarity") + F.col("total")) / F.when(own, F.col("n") - 1).otherwise(F.col("n"))
    each = near.withColumn("d", F.when(~own | (F.col("n") > 1), mean))
    out = each.groupBy("id", F.col("own").alias("cluster")).agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    return out.select("id", "cluster", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def tag_homogeneity(members: DataFrame) -> DataFrame:
    """(cluster, homogeneity): the share of a cluster's notes(cluster, id, tags) that have its commonest tag; 0 without tags."""
    size = members.groupBy("cluster").agg(F.count("*").alias("n"))
    tag = members.select("cluster", F.explode(F.array_distinct("tags")).alias("t")).groupBy("cluster", "t").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max("k").alias("k"))
    return size.join(tag, "cluster", "left").select("cluster", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("homogeneity"))


def folder_coherence(members: DataFrame) -> DataFrame:
    """(cluster, coherence): the share of a cluster's notes(cluster, id, folder) in its commonest folder."""
    top = members.groupBy("cluster", "folder").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max("k").alias("k"), F.sum("k").alias("n"))
    return top.select("cluster", (F.col("k") / F.col("n")).alias("coherence"))


def composite(silhouette: Column, noise: Column, tags: Column, links: Column, clusters: Column, gini_: Column) -> Column:
    """The weighted score of a clustering: 1 for 50 to 500 clusters, less in proportion to how far their number is from that."""
    count = F.when(clusters < 50, clusters / F.lit(50.0)).when(clusters > 500, F.lit(500.0) / clusters).otherwise(1.0)
    return 0.35 * ((silhouette + 1) / 2) + 0.20 * (1 - noise) + 0.15 * tags + 0.15 * links + 0.10 * count + 0.05 * (1 - gini_)


# --- rule-based passes ---


def split_by_tag(notes: DataFrame) -> DataFrame:
    """(path, cluster) of notes(path, cluster, tags): a cluster is cut by the tag of each note that is commonest in the cluster; notes without tags stay."""
    tag = notes.select("path", "cluster", F.explode(F.array_distinct("tags")).alias("t"))
    common = tag.groupBy("cluster", "t").agg(F.count("*").alias("k"))
    best = tag.join(common, ["cluster", "t"]).groupBy("path").agg(F.min_by("t", F.struct(-F.col("k"), "t")).alias("t"))
    return notes.join(best, "path", "left").select("path", F.concat_ws("/", "cluster", "t").alias("cluster"))


def link_components(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, cluster, component) of notes(path, cluster): connected components of edges(source, target) within clusters, named by their least path."""
    who = notes.select("path", "cluster")
    inner = edges.join(who.toDF("source", "c1"), "source").join(who.toDF("target", "c2"), "target").where("c1 = c2").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return who.join(components(inner).toDF("path", "component"), "path", "left").select("path", "cluster", F.coalesce("component", "path").alias("component"))


def merge_by_tags(notes: DataFrame, least: float = 0.3) -> DataFrame:
    """(path, cluster) with each cluster taken into the larger one whose tags overlap most, from ``least`` of Jaccard on; clusters that take others stay."""
    tag = notes.select("cluster", F.explode("tags").alias("t")).distinct()
    n, size = tag.groupBy("cluster").agg(F.count("*").alias("n")), notes.groupBy("cluster").agg(F.count("*").alias("size"))
    shared = tag.join(tag.toDF("other", "t"), "t").where("cluster != other").groupBy("cluster", "other").agg(F.count("*").alias("k"))
    scored = shared.join(n, "cluster").join(n.toDF("other", "m"), "other").withColumn("j", F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).where(F.col("j") >= least)
    larger = scored.join(size, "cluster").join(size.toDF("other", "osize"), "other").where("osize > size or (osize = size and other < cluster)")
    into = larger.groupBy("cluster").agg(F.max_by("other", F.struct("j", "osize", "other")).alias("into"))
    stays = into.join(into.select(F.col("into").alias("cluster")).distinct(), "cluster", "left_anti")  # a cluster that takes others is not taken itself
    return notes.join(stays, "cluster", "left").select("path", F.coalesce("into", "cluster").alias("cluster"))


def title_keywords(notes: DataFrame, n: int = 3) -> DataFrame:
    """(cluster, keywords) of notes(path, cluster, title): the words of most TF-IDF weight over clusters; CJK characters are words of their own."""
    words = F.regexp_extract_all(F.lower("title"), F.lit(rf"{CJK}|[^\s\p{{Punct}}{CJK[1:-1]}]+"), F.lit(0))
    tf = notes.select("cluster", F.explode(words).alias("w")).groupBy("cluster", "w").agg(F.count("*").alias("tf"))
    df = tf.groupBy("w").agg(F.count("*").alias("df"))
    total = notes.select("cluster").distinct().agg(F.count("*").alias("total"))
    weight = F.col("tf") * F.log((F.col("total") + 1) / (F.col("df") + 1))
    ranked = tf.join(df, "w").crossJoin(F.broadcast(total)).withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round(weight, 9)), "w"))).where(F.col("_r") <= n)
    return ranked.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "w"))), lambda x: x["w"]).alias("keywords"))


def resized(notes: DataFrame, least: int, most: int) -> DataFrame:
    """(path, cluster): clusters under ``least`` notes become ``misc``, those over ``most`` are cut into numbered parts of about equal size by a hash of the path."""
    size = notes.groupBy("cluster").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("path"), F.ceil(F.col("_n") / most))
    name = F.when(F.col("_n") < least, "misc").when(F.col("_n") > most, F.concat("cluster", F.lit("#"), part.cast("string"))).otherwise(F.col("cluster"))
    return notes.join(size, "cluster").select("path", name.alias("cluster"))
