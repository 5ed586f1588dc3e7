"""Approximate nearest neighbours: stable projections, a kd-tree, and a chi-square stopping test.

Unit vectors are projected to DIMS dimensions by a Gaussian (2-stable) matrix, so the squared ratio of
projected to true distance is chi-square with DIMS degrees. A kd-tree over the projections deals the
vectors into leaves; its planes are fitted on a bounded sample, but every vector is put into its leaf.
A query takes its projected neighbours one after another and verifies them on the original vectors; it
stops when the next one's projected distance exceeds the distance of its k-th best by so much that a
better one there is less likely than 1 - CONFIDENCE. It starts in its own leaf and then visits those
leaves that the test doesn't rule out.

Work is dealt by leaf, and a leaf's queries by bounded chunks. Equal vectors are one entry that keeps
the k + 1 smallest ids, which is all that a list of k without the query itself can name.

Defined results: vectors that are null or zero, or that hold null or non-finite components, rows with a
null vec_id, and vectors of another length than most take no part. Repeated rows count once; different
vectors under one vec_id are different candidates. A table of one vector gives no rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

DIMS = 12
CONFIDENCE = 0.985
#: Vectors of a leaf, about, and queries that meet it in one task.
LEAF, CHUNK = 4096, 2048
SAMPLE = 20_000


def chi_square(dims: int, confidence: float) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    z, c = NormalDist().inv_cdf(confidence), 2 / (9 * dims)
    return dims * (1 - c + z * c**0.5) ** 3


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay the same."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0.0))[1][:, None])


def matrix(length: int, dims: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v and key (equal for equal vectors)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).withColumn("key", F.md5(F.array_join(F.col("v").cast("array<string>"), ",")))


def planes(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Splits of a complete binary tree, in heap order: at the median of the widest dimension."""
    out: list[tuple[int, float]] = []
    level = [points]
    while len(level) < leaves:
        below = []
        for p in level:
            d = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
            cut = float(np.median(p[:, d])) if len(p) else 0.0
            out.append((d, cut))
            below += [p[p[:, d] <= cut], p[p[:, d] > cut]]
        level = below
    return out


def leaf_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    dims, cuts = np.array([t[0] for t in tree], np.int64), np.array([t[1] for t in tree])
    for _ in range((len(tree) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > cuts[node])
    return node - len(tree)


def boxes(tree: list[tuple[int, float]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the leaves."""
    low, high = [np.full(dims, -np.inf)], [np.full(dims, np.inf)]
    for node, (d, cut) in enumerate(tree):
        left, right = high[node].copy(), low[node].copy()
        left[d], right[d] = cut, cut
        low += [low[node], right]
        high += [left, high[node]]
    return np.array(low[len(tree) :]), np.array(high[len(tree) :])


def _search(k: int, factor: float):
    """Cogroup of a leaf's entries and the queries that visit it: the best k entries' rows for each query."""

    def run(entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(asked):
            entries = entries.sort_values("id")
            x, px = scaled(np.stack(entries["v"])), np.stack(entries["p"])
            norm, ids = np.linalg.norm(x, axis=1), list(entries["ids"])
            for q in asked.itertuples(index=False):
                v, d2 = scaled(np.asarray(q.v)[None])[0], ((px - np.asarray(q.p)) ** 2).sum(axis=1)
                order, size, best, reach = np.argsort(d2, kind="stable"), np.linalg.norm(v), [], q.reach
                at, block = 0, 32
                while at < len(order) and d2[order[at]] <= factor * reach:
                    some = order[at : at + block]
                    cosine = (x[some] * v).sum(axis=1) / (norm[some] * size)
                    floor = best[k - 1][0] if len(best) >= k else 2.0
                    for c, i in zip(cosine, some):
                        if -c <= floor:
                            best += [(-c, int(j)) for j in ids[i]]
                    best = sorted(best)[:k]
                    if len(best) >= k:
                        reach = min(reach, max(0.0, 2 + 2 * best[k - 1][0]))
                    at, block = at + block, min(1024, 2 * block)
                out += [(q.qid, j, -c) for c, j in best]
        return pd.DataFrame(out, columns=["qid", "vec_id", "score"]).astype({"qid": "int64", "vec_id": "int64", "score": "float64"})

    return run


def neighbours(vectors: DataFrame, query_rows=None, k: int = 5, dims: int = DIMS, confidence: float = CONFIDENCE, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of each query; query_rows: a condition on vec_id."""
    wanted = F.col("vec_id") % 50 == 0 if query_rows is None else query_rows
    rows = usable(vectors)
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    spark, empty = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], empty)
    length = length["n"]
    rows = rows.where(F.size("v") == length)
    p = matrix(length, dims)
    factor = chi_square(dims, confidence)

    def projected(batches):
        for b in batches:
            v = np.stack(b["v"]) if len(b) else np.empty((0, length))
            v = scaled(v)
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            yield b.assign(p=list(u @ p))

    # of equal vectors the k + 1 smallest ids; the limit of the window is applied before the shuffle too
    first = rows.withColumn("n", F.dense_rank().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    entries = first.groupBy("key").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    entries = checkpointed(entries.withColumn("id", F.col("ids")[0]).select("id", "ids", "v").mapInPandas(projected, "id long, ids array<long>, v array<double>, p array<double>"))
    n = entries.count()
    leaves = 1 << max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    sample = entries.select("p").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    tree = planes(np.array([r["p"] for r in sample]).reshape(-1, dims), leaves)
    low, high = boxes(tree, dims)

    @F.pandas_udf("int")
    def own_leaf(points: pd.Series) -> pd.Series:
        return pd.Series(leaf_of(np.stack(points), tree) if len(points) else [], dtype="int32")

    @F.pandas_udf("array<int>")
    def other_leaves(points: pd.Series, reach: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for q, r, mine in zip(points, reach, own):
            gap = np.maximum(np.maximum(low - q, q - high), 0)
            near = np.flatnonzero((gap**2).sum(axis=1) <= factor * r)
            out.append(near[near != mine].astype("int32"))
        return pd.Series(out, dtype=object)

    dealt = checkpointed(entries.withColumn("leaf", own_leaf("p")))
    asked = rows.where(wanted).select(F.col("vec_id").alias("query_id"), "key", "v")
    one = asked.groupBy("key").agg(F.min("query_id").alias("qid"), F.first("v").alias("v"))
    names = asked.select("query_id", "key").distinct().join(one.select("key", "qid"), "key").select("query_id", "qid")
    search = one.select("qid", "v").mapInPandas(projected, "qid long, v array<double>, p array<double>")
    search = checkpointed(search.withColumn("leaf", own_leaf("p")))

    def visit(queries: DataFrame) -> DataFrame:
        """Each visited leaf meets its queries in chunks of a bounded size."""
        sizes = queries.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        asked = queries.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int")).drop("chunks")
        held = dealt.join(sizes, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        return held.groupBy("leaf", "chunk").cogroup(asked.groupBy("leaf", "chunk")).applyInPandas(_search(k + 1, factor), "qid long, vec_id long, score double")

    near = checkpointed(visit(search.withColumn("reach", F.lit(4.0))))
    worst = near.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    reach = F.when(F.col("n") > k, F.greatest(F.lit(0.0), 2 - 2 * F.col("s"))).otherwise(4.0)
    further = search.join(worst, "qid", "left").withColumn("reach", F.coalesce(reach, F.lit(4.0)))
    further = further.withColumn("leaf", F.explode(other_leaves("p", "reach", "leaf"))).select("qid", "v", "p", "leaf", "reach")
    found = near.union(visit(checkpointed(further))) if leaves > 1 else near
    best = found.distinct().withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    lists = names.join(best, "qid").where("vec_id <> query_id")
    ranked = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(vectors: DataFrame) -> DataFrame:
    return neighbours(vectors)
