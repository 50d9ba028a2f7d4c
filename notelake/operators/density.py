"""Density clustering by the hierarchy of mutual reachability, exact and without a pair join.

1. Core distances: exact nearest neighbours (``neighbours``); equal vectors are one node that weighs as many rows as it stands for.
2. Spanning edges of mutual reachability ``max(core, core, distance)``: Boruvka rounds. A component's best known edge, from neighbour lists or from a bounded sample, bounds what its members still
   have to look for; members whose core distance is no less, or whose list of neighbours ends no nearer, are done. Components all whose members are done join by the edge they know. Once they
   are less than half, the members of the others visit blocks, but for those of the component with most to look for: the others join it. Cells of one component tell it nothing. Edges of equal
   weight may close a cycle, which the threshold graphs do not mind.
3. Entry: the least threshold at which a row's component has ``min_size`` rows. Small components follow their least edge; of each tree of such pointers only the bottom merges, and once that is
   large, the whole tree has entered. The bottom grows in each round, so there are at most ``min_size`` rounds.
4. Parts: what hangs together without the edges between two large components. Those edges, at most one for ``min_size`` rows, are the condensed tree; edges of one weight merge at once.
5. Rows climb from their part to the cluster they enter, by pointer doubling; stabilities are sums by cluster; the clusters of most stability are chosen from the bottom (a cluster before its
   children when equal), the root only if asked.

Steps 1 to 4 and the climbing are joins and grouped sums that Spark deals out. The condensed tree itself (three numbers for a split) is put in order and chosen from in one task: its size is the
number of places where a cluster of ``min_size`` rows parts from another, not the number of rows.

Rows whose vector is null or has null or non-finite components, and rows that enter no chosen cluster, are noise (-1). Clusters are numbered from 0 by the least id of their parts. An id names one row;
a null id is left out. Vectors of different dimensions are an error. An empty table gives no rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dropped, stage
from .components import components
from .neighbours import CHUNK, Cells, as_array, exact, matrix, neighbours, one_chunk, placed, rough, unit, visited

NOISE = -1
#: Rows that a component compares itself with when its neighbours are all its own, and neighbours that are listed for each row, at least.
SAMPLE, LISTED = 256, 16


def with_core(rows: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Placed rows with ``core``: the distance within which k other rows are, copies counted; the farthest neighbour where there are fewer; and ``radius``: all vectors that are nearer are in the list."""
    step = F.aggregate("near", F.struct((F.col("n") - 1).alias("c"), F.when(F.col("n") > k, 0.0).alias("d")), lambda s, x: F.struct((s["c"] + x["n"]).alias("c"), F.coalesce(s["d"], F.when(s["c"] + x["n"] >= k, x["d"])).alias("d")))
    last = F.coalesce(F.element_at(F.transform("near", lambda x: x["d"]), -1), F.lit(0.0))
    none = F.when(F.size("near") > 0, last).otherwise(0.0)
    return rows.join(near, "id", "left").withColumn("near", F.coalesce("near", F.array().cast(near.schema["near"].dataType))).withColumns({"core": F.coalesce(step["d"], none), "radius": F.when(F.size("near") >= max(k, LISTED), last).otherwise(float("inf"))}).drop("near")


def spanning_edges(rows: DataFrame, near: DataFrame, cells: Cells) -> DataFrame:
    """Staged (a, b, w) whose threshold graphs hang together as those of all pairs of rows(id, n, v, cell, block, core, radius) do."""
    kind = dict(rows.dtypes)["id"]
    core = rows.select("id", "core")
    listed = near.select("id", F.explode("near").alias("x")).select("id", F.col("x.id").alias("other"), F.col("x.d").alias("d"))
    listed = listed.join(core, "id").join(core.toDF("other", "core2"), "other")
    edges = stage(listed.select(F.col("id").alias("a"), F.col("other").alias("b"), F.greatest("d", "core", "core2").alias("w")), "listed")
    now = stage(rows.select("id", F.col("id").alias("comp")), "comps")
    made: list[DataFrame] = []
    count = now.count()
    while count > 1:
        ends = now.select(F.col("id").alias("a"), F.col("comp").alias("ca")), now.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        then = stage(edges.join(ends[0], "a").join(ends[1], "b").where("ca != cb"), "between")
        dropped(edges)
        edges = then.select("a", "b", "w")
        both = then.select(F.col("ca").alias("comp"), "w", "a", "b", F.col("cb").alias("to")).unionAll(then.select(F.col("cb").alias("comp"), "w", "b", "a", F.col("ca").alias("to")))
        known = stage(best_of(both), "known")
        labelled = stage(rows.join(now, "id"), "labelled")
        reach = F.greatest("core", "radius")
        open_ = stage(labelled.join(known.select("comp", "w"), "comp", "left").where(F.col("w").isNull() | (reach < F.col("w"))).groupBy("comp").agg(F.count("*").alias("asking")), "open")
        unsettled = open_.count()
        settled = known.join(open_, "comp", "left_anti")
        if 2 * unsettled <= count:
            chosen = stage(settled, "chosen")
        else:
            waits = open_.orderBy(F.desc("asking"), "comp").first()["comp"]  # whoever joins it may be anyone's nearest
            search = open_.where(F.col("comp") != F.lit(waits)).select("comp")
            asking = labelled.join(search, "comp", "left_semi")
            bound = known.join(search, "comp", "left_semi")
            if bound.count() < unsettled - 1:  # some component has all its neighbours inside
                bound = best_of(bound.unionByName(sampled(labelled, asking.join(known, "comp", "left_anti"), kind)))
            bound = stage(bound, "bound")
            asking = asking.join(bound.select("comp", F.col("w").alias("within")), "comp", "left").withColumn("within", F.coalesce("within", F.lit(float("inf")))).where(reach < F.col("within"))
            one = {r.cell: r.x for r in labelled.groupBy("cell").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x = y").collect()}  # at most so many rows as pivots
            skip = np.array([one.get(c, NOWHERE) for c in range(len(cells.pivots))], object)
            told = visited(labelled.select("id", "v", "cell", "block", "core", "comp"), asking.select("id", "v", "cell", "core", "comp", "within"), cells, nearest_outside, f"comp {kind}, w double, a {kind}, b {kind}, to {kind}", skip, "comp")
            chosen = stage(best_of(settled.unionByName(bound).unionByName(told)), "chosen")
            dropped(bound, told)
        made.append(stage(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct(), "spanning"))
        joined = components(chosen.select(F.col("comp").alias("a"), F.col("to").alias("b")))
        after = stage(now.join(joined.toDF("comp", "component"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), "comps")
        left = after.select("comp").distinct().count()
        dropped(now, known, labelled, open_, chosen, joined)
        if left == count:
            break  # nothing to join: cannot happen while there are two components
        now, count, edges = after, left, then.select("a", "b", "w")
        edges._staged_path = then._staged_path
    dropped(edges, now)
    if not made:
        return stage(rows.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")).where("false"), "spanning")
    out = stage(reduce(DataFrame.unionAll, made).distinct(), "spanning")
    dropped(*made)
    return out


class Nowhere:
    """No component is equal to it."""

    def __eq__(self, other) -> bool:
        return False

    def __ne__(self, other) -> bool:
        return True

    __hash__ = None


NOWHERE = Nowhere()


def best_of(edges: DataFrame) -> DataFrame:
    """The least edge (comp, w, a, b, to) of each component."""
    return edges.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("comp", "e.*")


def sampled(labelled: DataFrame, asking: DataFrame, kind: str) -> DataFrame:
    """For every asking row its least edge (comp, w, a, b, to) to a row of another component in a sample of at most SAMPLE rows, of which half at least are of no component twice while there are so many."""
    first = labelled.groupBy("comp").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id", "core", "v")).alias("x")).orderBy(F.xxhash64("comp"), "comp").limit(SAMPLE // 2).select("comp", "x.id", "x.core", "x.v")
    other = labelled.select("comp", "id", "core", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE // 2)
    got = first.unionByName(other).toArrow()
    some = (np.array(got.column("comp").to_pylist(), object), got.column("id").to_pylist(), got.column("core").to_numpy(), matrix(got.column("v")))
    sent = labelled.sparkSession.sparkContext.broadcast(some)

    def run(batches):
        comps, ids, cores, x = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            y, own, core = matrix(b.column("v")), np.array(b.column("comp").to_pylist(), object), b.column("core").to_numpy()
            best, at = np.full(len(y), np.inf), np.zeros(len(y), np.int64)
            for j in range(len(ids)):
                w = np.where(own != comps[j], np.maximum(np.maximum(exact(y, x[j][None, :]), core), cores[j]), np.inf)
                at = np.where(w < best, j, at)
                best = np.minimum(best, w)
            keep = np.flatnonzero(np.isfinite(best))
            id_type = b.schema.field("id").type
            yield pa.RecordBatch.from_arrays([b.column("comp").take(pa.array(keep)), pa.array(best[keep]), b.column("id").take(pa.array(keep)), pa.array([ids[j] for j in at[keep]], id_type), pa.array([comps[j] for j in at[keep]], id_type)], ["comp", "w", "a", "b", "to"])

    return asking.select("comp", "id", "core", "v").mapInArrow(run, f"comp {kind}, w double, a {kind}, b {kind}, to {kind}")


def nearest_outside(t: pa.Table, q: pa.Table) -> pa.Table:
    """Of a block of rows and visitors from other components: the least edge of each component that is below what it has."""
    kind = t.schema.field("id").type if t.num_columns else pa.int64()
    target = pa.schema([("comp", kind), ("w", pa.float64()), ("a", kind), ("b", kind), ("to", kind)])
    if not t.num_rows or not q.num_rows:
        return target.empty_table()
    x, y = matrix(t.column("v")), matrix(q.column("v"))
    cores, core, within = t.column("core").to_numpy(), q.column("core").to_numpy(), q.column("within").to_numpy()
    code = pd.factorize(np.concatenate([as_array(t.column("comp")), as_array(q.column("comp"))]))[0]
    comps, own = code[: len(x)], code[len(x) :]
    found, step, few = [], max(1, CHUNK // len(x)), max(1, CHUNK // max(1, x.shape[1]) // 4)
    for a in range(0, len(y), step):
        d2, off = rough(y[a : a + step], x)
        np.maximum(d2, (cores * cores)[None, :], out=d2)
        d2[own[a : a + step, None] == comps[None, :]] = np.inf
        bound = np.minimum(d2.min(1) * (1 + 1e-9) + 2 * off, (within[a : a + step] * (1 + 1e-9)) ** 2 + off)
        row, at = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
        row += a
        d = np.concatenate([exact(x[at[b : b + few]], y[row[b : b + few]]) for b in range(0, len(row), few)] or [np.zeros(0)])
        w = np.maximum(np.maximum(d, core[row]), cores[at])
        good = w < within[row]
        row, at, w = row[good], at[good], w[good]
        least = pd.Series(w).groupby(own[row]).idxmin().to_numpy()  # one for each component
        found.append((row[least], at[least], w[least]))
    row, at, w = map(np.concatenate, zip(*found, strict=True))
    least = pd.Series(w).groupby(own[row]).idxmin().to_numpy()
    row, at = pa.array(row[least]), pa.array(at[least])
    return pa.table([one_chunk(c) for c in (q.column("comp").take(row), pa.array(w[least]), q.column("id").take(row), t.column("id").take(at), t.column("comp").take(at))], schema=target)


def entries(nodes: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """Staged (id, n, e) of nodes(id, n, core): the least threshold at which the component of a row has ``min_size`` rows; null where it never has."""
    now = stage(nodes.select("id", "n", F.col("id").alias("comp"), F.when(F.col("n") >= min_size, F.col("core")).alias("e")), "entries")
    left = stage(edges, "edges")
    while True:
        ends = now.select(F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("e").alias("ea")), now.select(F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("e").alias("eb"))
        then = stage(left.select("a", "b", "w").join(ends[0], "a").join(ends[1], "b").where("(ea is null or eb is null) and (ea is not null or eb is not null or ca != cb)"), "edges")
        dropped(left)
        left = then
        out = then.where("ea is null").select(F.col("ca").alias("comp"), "w", F.col("eb").isNull().cast("int").alias("open"), F.col("cb").alias("to")).unionAll(then.where("eb is null").select(F.col("cb").alias("comp"), "w", F.col("ea").isNull().cast("int").alias("open"), F.col("ca").alias("to")))
        pointer = stage(out.groupBy("comp").agg(F.min(F.struct("w", "open", "to")).alias("p")).select("comp", "p.*"), "pointer")
        if not pointer.head(1):
            dropped(pointer, left)
            return now.select("id", "n", "e")
        tree = components(pointer.where("open = 1").select(F.col("comp").alias("a"), F.col("to").alias("b")))
        size = now.where("e is null").groupBy("comp").agg(F.sum("n").alias("size"))
        each = stage(pointer.join(size, "comp").join(tree.toDF("comp", "tree"), "comp", "left").withColumn("tree", F.coalesce("tree", "comp")), "each")
        low = stage(each.groupBy("tree").agg(F.min("w").alias("low"), F.max(F.col("open") == 0).alias("hit")), "low")
        bottom = each.join(low, "tree").withColumn("is_low", F.col("w") == F.col("low"))
        merged = stage(bottom.groupBy("tree", "low", "hit").agg(F.sum(F.when(F.col("is_low"), F.col("size"))).alias("total"), F.min(F.when(F.col("is_low"), F.col("comp"))).alias("label")), "merged")
        told = each.join(merged, "tree").select("comp", F.when(F.col("hit") | (F.col("total") >= min_size), F.col("w")).alias("e2"), F.when(F.col("w") == F.col("low"), F.col("label")).alias("label"))
        after = stage(now.join(told, "comp", "left").select("id", "n", F.when(F.col("e").isNull() & F.col("e2").isNull(), F.coalesce("label", "comp")).otherwise(F.col("comp")).alias("comp"), F.coalesce("e", "e2").alias("e")), "entries")
        dropped(now, pointer, tree, each, low, merged)
        now = after


def parted(entered: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (id, n, e, part) of the rows that enter a cluster, and (a, b, w): where parts of min_size rows and more meet."""
    big = entered.where("e is not null")
    ends = big.select(F.col("id").alias("a"), F.col("e").alias("ea")), big.select(F.col("id").alias("b"), F.col("e").alias("eb"))
    known = stage(edges.join(ends[0], "a").join(ends[1], "b"), "known")
    together = components(known.where("ea >= w and eb >= w").select("a", "b"))  # rows that enter at one threshold, together
    small = F.when(F.col("ea") >= F.col("w"), F.col("a")).otherwise(F.col("b"))
    large = F.when(F.col("ea") >= F.col("w"), F.col("b")).otherwise(F.col("a"))
    meets = known.where("(ea >= w) != (eb >= w)").select(small.alias("id"), large.alias("to"), "w").join(together, "id", "left").withColumn("g", F.coalesce("component", "id"))
    meets = stage(meets.select("g", "id", "to", "w"), "meets")
    joins = meets.groupBy("g").agg(F.min(F.struct("id", "to")).alias("x"))  # of several large ones that a group meets at once it belongs to one, the others split from it
    joins = stage(joins.select("g", "x.*"), "joins")
    part = components(together.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(joins.select(F.col("id").alias("a"), F.col("to").alias("b"))))
    rows = stage(big.join(part, "id", "left").select("id", "n", "e", F.coalesce("component", "id").alias("part")), "parts")
    apart = meets.join(joins.select("g", "id", "to").withColumn("_j", F.lit(True)), ["g", "id", "to"], "left").where("_j is null").select(F.col("id").alias("a"), F.col("to").alias("b"), "w")
    splits = known.where("ea < w and eb < w").select("a", "b", "w").unionAll(apart)
    of = rows.select(F.col("id").alias("a"), F.col("part").alias("pa")), rows.select(F.col("id").alias("b"), F.col("part").alias("pb"))
    splits = stage(splits.join(of[0], "a").join(of[1], "b").where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")), "splits")
    dropped(known, together, meets, joins, part)
    return rows, splits


def condensed(births: DataFrame, splits: DataFrame) -> DataFrame:
    """Staged (node, parent, low, high, part) of the condensed tree: clusters exist at thresholds from low (included) to high; part: of its leaves; parent null: a root. ``births``: (part, e)."""
    kind = dict(births.dtypes)["part"]
    rows = births.select("part", F.col("e").alias("w"), F.lit(None).cast(kind).alias("b")).unionAll(splits.select("a", "w", "b"))

    def order(f: pd.DataFrame) -> pd.DataFrame:
        leaves = f[f["b"].isna()].sort_values("part")
        number = {p: i for i, p in enumerate(leaves["part"])}
        low, high, parent = list(leaves["w"]), [math.inf] * len(leaves), [None] * len(leaves)
        top, above = list(range(len(leaves))), list(range(len(leaves)))  # top: a tree's newest node; above: union-find over nodes

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for w, same in f[f["b"].notna()].sort_values("w").groupby("w", sort=True):
            met: dict[int, set[int]] = {}
            for a, b in zip(same["part"], same["b"], strict=True):
                x, y = root(number[a]), root(number[b])
                if x != y:
                    met.setdefault(x, {top[x]})
                    met[x] |= met.pop(y, {top[y]})
                    above[y] = x
            for x, kids in met.items():
                node = len(low)
                low.append(w)
                high.append(math.inf)
                parent.append(None)
                for kid in kids:
                    parent[kid], high[kid] = node, w
                top[x] = node
        names = [*leaves["part"], *[None] * (len(low) - len(leaves))]
        return pd.DataFrame({"node": range(len(low)), "parent": pd.array(parent, "Int64"), "low": low, "high": high, "part": pd.Series(names, dtype=object)})

    return stage(rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(order, f"node bigint, parent bigint, low double, high double, part {kind}"), "tree")


def climbed(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """Rows(id, n, e, part) with the node of the tree they enter: up from their leaf while it ends at or below their entry."""
    jump = stage(tree.select("node", F.col("parent").alias("to"), F.col("high").alias("bar")), "jump")
    jumps = [jump]
    while jump.where("to is not null").head(1):
        far = jump.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("bar").alias("bar2"))
        jump = stage(jump.where("to is not null").join(far, "to").select("node", F.col("to2").alias("to"), F.col("bar2").alias("bar")).where("to is not null"), "jump")
        jumps.append(jump)
    now = rows.join(tree.where("part is not null").select("part", "node"), "part").select("id", "n", "e", "node")
    for j in reversed(jumps):
        now = now.join(j, "node", "left").select("id", "n", "e", F.when(F.col("to").isNotNull() & (F.col("bar") <= F.col("e")), F.col("to")).otherwise(F.col("node")).alias("node"))
    out = stage(now, "climbed")
    dropped(*jumps)
    return out


def chosen_clusters(tree: DataFrame, sums: DataFrame, single: bool) -> DataFrame:
    """(node, cluster, stability): the number of the chosen cluster that each node is in, or NOISE. ``sums``: (node, cnt, lam) of the rows that enter at it."""

    def choose(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node").reset_index(drop=True)
        n, kids = len(f), [[] for _ in range(len(f))]
        parent = [-1 if pd.isna(p) else int(p) for p in f["parent"]]
        for i, p in enumerate(parent):
            if p >= 0:
                kids[p].append(i)
        cnt, lam = f["cnt"].fillna(0.0).to_numpy(), f["lam"].fillna(0.0).to_numpy()
        own, best, below, least, keep = np.zeros(n), np.zeros(n), np.zeros(n), list(f["part"]), np.zeros(n, bool)
        for i in range(n):  # children come before parents
            top = 1 / f["high"][i]
            below[i] = sum(below[k] + cnt[k] for k in kids[i])
            own[i] = lam[i] - cnt[i] * top + (below[i] * (1 / f["low"][i] - top) if kids[i] else 0.0)
            if kids[i]:
                least[i] = min(least[k] for k in kids[i])
            under = sum(best[k] for k in kids[i])
            keep[i] = (single or parent[i] >= 0) and not (kids[i] and under > own[i])
            best[i] = own[i] if keep[i] else under
        label, roots = [-1] * n, []
        for i in range(n - 1, -1, -1):
            up = label[parent[i]] if parent[i] >= 0 else -1
            if up >= 0:
                label[i] = up
            elif keep[i]:
                label[i] = i
                roots.append(i)
        number = {i: k for k, i in enumerate(sorted(roots, key=lambda i: least[i]))}
        return pd.DataFrame({"node": f["node"], "cluster": [number[x] if x >= 0 else NOISE for x in label], "stability": own})

    held = tree.join(sums, "node", "left").select("node", "parent", "low", "high", "part", F.col("cnt").cast("double").alias("cnt"), "lam")
    return held.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(choose, "node bigint, cluster int, stability double")


def density_clusters(vectors: DataFrame, min_size: int = 5, min_samples: int = 3, single: bool = False) -> DataFrame:
    """(id, cluster) of vectors(id, embedding) by density: clusters of ``min_size`` rows and more, NOISE for rows in none; ``min_samples``: how many others make a place dense; ``single``: whether all rows may be one cluster."""
    if min_size < 2 or min_samples < 1:
        raise ValueError("clusters have two rows at least, and a place is dense by one other at least")
    named = vectors.select("id", "embedding").where("id is not null")
    nodes = stage(unit(named), "nodes")
    rows, cells = placed(nodes.select("id", "v", "n"))
    if not len(cells.pivots):
        return named.select("id", F.lit(NOISE).alias("cluster"))
    near = neighbours(rows, cells, max(LISTED, min_samples))
    cored = stage(with_core(rows, near, min_samples), "core")
    edges = spanning_edges(cored, near, cells)
    entered = entries(cored, edges, min_size)
    parts, splits = parted(entered, edges)
    tree = condensed(parts.groupBy("part").agg(F.min("e").alias("e")), splits)
    at = climbed(parts, tree)
    lam = F.when(F.col("e") > 0, F.col("n") / F.col("e")).otherwise(float("inf"))
    label = stage(chosen_clusters(tree, at.groupBy("node").agg(F.sum("n").alias("cnt"), F.sum(lam).alias("lam")), single), "label")
    told = stage(nodes.join(at.join(label, "node").select("id", "cluster"), "id", "left").select("v", "cluster"), "clusters")
    dropped(nodes, rows, near, cored, edges, parts, splits, tree, at, label)
    key = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    return named.withColumn("v", key).join(told, "v", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
