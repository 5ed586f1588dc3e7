"""Near duplicates by MinHash: universal hash minima, banding, verification, connected components.

A document is the set of its distinct five-word shingles (A-Z lower-cased). Documents with equal sets
are folded into one representative first, so copies cost one row each. Representatives whose minima
agree in a whole band share a bucket. Each bucket is a star around its smallest member: pairs are
sifted by their signatures and confirmed on the full sets, and large-star and small-star make components
of the stars. A bucket whose members are then still of several components is looked at again: exact
distances to its centre put its members in rings, and only members of different components in equal or
neighbouring rings can be linked; these are compared on full sets, block against block, in tasks of
bounded size that give back only the links that join something new. So no bucket is capped and no list
of all pairs is written. A centre or band that very many share is dealt to several tasks.

Bands and sift follow from the percent asked for. At 85, with 20 bands of 5 of the 100 minima, a pair at
the threshold shares no band once in 120,000 cases, and the sift (70 equal minima) loses such a pair once
in about 20,000. At 80, with 25 bands of 4 and a sift of 64, it is once in 500,000 and once in about 16,000.

Defined results: null or empty texts and texts without words have no shingles and are linked with
nothing. Rows with a null doc_id take no part in links: component_id is null and kept is true. Rows
that share a doc_id are one node: what links one links all. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import checkpointed, give_back, own_names, slices, spread_join
from plumbline.llm.components import components
from plumbline.shared import written

WORDS = 5
MINIMA = 100
#: Share of pairs at the threshold that may have no band in common, and that the sift may lose.
NO_BAND, NO_SIFT = 1e-5, 1e-4
#: Members and shingles of a block when a bucket is compared member by member, about.
BLOCK, BLOCK_SHINGLES = 128, 200_000
#: Blocks of a bucket that meet all its blocks in one task.
PAIRED = 64
#: Word hashes that a worker keeps.
CACHE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def banding(percent: int) -> tuple[int, int]:
    """Bands and rows: the longest bands of which a pair at the threshold still shares one."""
    rows = max((r for r in range(1, 21) if (1 - (percent / 100) ** r) ** (MINIMA // r) <= NO_BAND), default=1)
    return MINIMA // rows, rows


@lru_cache
def sift(percent: int) -> int:
    """Equal minima that a pair at the threshold has all but surely."""
    p, below, k = percent / 100, 0.0, 0
    while k < MINIMA and (below := below + comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k)) <= NO_SIFT:
        k += 1
    return k


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. bytes.lower() and bytes.split() know ASCII only, as is asked for."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mixed(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n functions x -> (a x + b) mod 2^64, of which the upper half counts."""
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 256):
        x = s[i : i + 256]
        np.minimum(out, (a[:, None] * x + b[:, None]).min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _sign(n: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, (a, b) = _Hashes(), _family(MINIMA)
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingles(text, hashes)
                m = minima(s, a, b) if len(s) else None
                bands = [xxhash.xxh64_intdigest(m[i * width : (i + 1) * width].tobytes(), seed=i) - (1 << 63) for i in range(n)] if len(s) else None
                rows.append((doc_id, len(s), xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None, m.tobytes() if len(s) else None, bands))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_hash", "signature", "bands"]).astype({"doc_id": "Int64"})
        del hashes
        give_back()

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = _Hashes()
    for batch in slices(batches):
        yield pd.DataFrame({"id": batch["doc_id"], "s": [shingles(t, hashes).view(np.int64) for t in batch["text"]]})
    del hashes
    give_back()


def signatures(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, set_hash, signature and bands."""
    return documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(_sign(*banding(percent)), "doc_id long, n_shingles long, set_hash string, signature binary, bands array<long>")


def _sifted(least: int):
    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).sum()) >= least for x, y in zip(a, b)], dtype=bool)

    return run


def _joined_between(percent: int):
    least = sift(percent)

    def run(task: pd.DataFrame) -> pd.DataFrame:
        """Links between the components of a task's two blocks that nothing joins yet; rows sorted, so that the result doesn't depend on their order."""
        task = task.sort_values(["side", "id"]).reset_index(drop=True)
        component, sets = [int(c) for c in task["component"]], [np.asarray(s) for s in task["s"]]
        part = np.array(component)
        signs = np.stack([np.frombuffer(x, np.uint32) for x in task["signature"]])
        root = {c: c for c in component}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        first, second = (np.flatnonzero(task["side"] == side) for side in (0, 1))
        out = []
        for n, x in enumerate(first):
            others = second if len(second) else first[n + 1 :]
            others = others[part[others] != part[x]]
            for y in others[(signs[others] == signs[x]).sum(axis=1) >= least]:
                low, high = sorted((len(sets[x]), len(sets[y])))
                if 100 * low < percent * high or top(component[x]) == top(component[y]):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (low + high - both):
                    root[top(component[x])] = top(component[y])
                    out.append((component[x], component[y]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def _ids(rows: DataFrame, n: int) -> DataFrame:
    """Distinct rows (ids, of about n rows), written, so that Spark knows their size: where that is small, what they are joined with isn't shuffled."""
    return written(rows.distinct().coalesce(n // 500_000 + 1))


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and s, the shingles, of the wanted ids, written once."""
    return written(texts.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInPandas(_sets, "id long, s array<long>"))


def _with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (leader, id) with the sizes of their sets, n and ln, and of what both have. A leader of many is dealt to several tasks."""
    mine = pairs.join(sets, "id")
    theirs = sets.select(F.col("id").alias("leader"), F.col("s").alias("ls"))
    met = spread_join(mine, theirs, "leader", ("id",), counted=pairs)
    return met.select("leader", "id", F.size("s").alias("n"), F.size("ls").alias("ln"), F.size(F.array_intersect("s", "ls")).alias("both"))


def _stars(texts: DataFrame, reps: DataFrame, member: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) between members of a bucket and its centre."""
    pairs = checkpointed(member.select("leader", "id").distinct())
    info = reps.select("id", "n", "signature")
    leaders = _ids(pairs.select(F.col("leader").alias("id")), pairs.count())
    lead = info.join(leaders, "id", "left_semi").select(F.col("id").alias("leader"), F.col("n").alias("ln"), F.col("signature").alias("ls"))
    met = spread_join(pairs.join(info, "id"), lead, "leader", ("id",), counted=pairs).where(100 * F.least("n", "ln") >= percent * F.greatest("n", "ln"))
    near = checkpointed(met.where(_sifted(sift(percent))("signature", "ls")).select("leader", "id"))
    sets = _sets_of(texts, _ids(near.select(F.col("leader").alias("id")).union(near.select("id")), near.count()))
    return checkpointed(_with_both(near, sets).where(100 * F.col("both") >= percent * (F.col("n") + F.col("ln") - F.col("both"))).select(F.col("leader").alias("u"), F.col("id").alias("v")).distinct())


def _blocks(rows: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """The members of large buckets (bucket, leader, id, component) once for each pair of blocks that they are compared in: bucket, block, other, id, component, side. rows: about n."""
    pairs = checkpointed(rows.where("id <> leader").select("leader", "id").distinct(), n)
    rings = _with_both(pairs, sets).select("leader", "id", "n", F.expr(f"int((100 * (n + ln - 2 * both)) div ((n + ln - both) * {100 - percent}))").alias("ring")).withColumnRenamed("id", "of").withColumnRenamed("leader", "around")
    rows = rows.join(rings, (F.col("id") == F.col("of")) & (F.col("leader") == F.col("around")), "left").select("bucket", "id", "component", F.coalesce("ring", F.lit(0)).alias("ring"), F.coalesce("n", F.lit(0)).alias("n"))
    rows = checkpointed(rows, n)
    largest = rows.groupBy("bucket", "component").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max_by("component", F.struct("m", "component")).alias("largest"))
    rows = checkpointed(spread_join(rows, largest, "bucket", ("id",)).select("bucket", "id", "component", "n", F.struct("bucket", "ring", (F.col("component") != F.col("largest")).alias("minor")).alias("part")), n)
    sizes = rows.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # a block: members of one ring, either of the largest component or of the others
    rows = checkpointed(spread_join(rows, sizes, "part", ("id",)).select("bucket", "id", "component", F.struct("part.ring", "part.minor", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("no")).alias("block")), n)
    blocks = rows.select("bucket", "block").distinct()
    # the list of a bucket's pairs of blocks is made in parts, so that no task makes it for a very large bucket alone
    blocks = blocks.join(blocks.groupBy("bucket").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts")), "bucket")
    mine = blocks.where("block.minor").withColumn("deal", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))
    others = blocks.select(F.col("bucket").alias("b2"), F.col("block").alias("other"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d2"))
    tasks = mine.join(others, (F.col("bucket") == F.col("b2")) & (F.col("deal") == F.col("d2")) & (F.abs(F.col("block.ring") - F.col("other.ring")) <= 1)).where("not other.minor or block <= other").select("bucket", "block", "other")
    tasks = checkpointed(tasks, n)
    left = rows.join(tasks, ["bucket", "block"]).select("bucket", "block", "other", "id", "component", F.lit(0).alias("side"))
    right = rows.withColumnRenamed("block", "other").join(tasks.where("block <> other"), ["bucket", "other"]).select("bucket", "block", "other", "id", "component", F.lit(1).alias("side"))
    return left.union(right)


def _between(texts: DataFrame, reps: DataFrame, member: DataFrame, component: DataFrame, percent: int) -> DataFrame | None:
    """Edges (u, v) between components that meet in a bucket and that the stars left apart; None if there are no such buckets.

    Distance is 1 - similarity, a metric: two members can only be linked if their distances to the centre
    differ by no more than linked members are apart. So members are put in rings of that width around
    the centre, and only those of equal and neighbouring rings are compared; of the bucket's largest
    component, no two members are. Pairs are sifted by their signatures before their sets are compared.
    A bucket no larger than a block goes to one task as it is, so that each of its members is sent once.
    """
    if percent >= 100:
        return None
    rows = member.where("size > 2").select("bucket", "leader", "id", "size")
    rows = rows.union(rows.select("bucket", "leader", F.col("leader").alias("id"), "size").distinct())
    rows = rows.join(component.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = checkpointed(rows)
    state = rows.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("open"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("what"), F.first("size").alias("size"), F.first("leader").alias("leader")).where("open")
    # buckets with the same members are compared once
    wanted = checkpointed(state.groupBy("what", "size", "leader").agg(F.min("bucket").alias("bucket")).select("bucket"))
    if wanted.isEmpty():
        return None
    rows = checkpointed(spread_join(rows.drop("size"), wanted, "bucket", ("id",)))
    n = rows.count()
    rows = rows.coalesce(n // 500_000 + 1)
    ids = _ids(rows.select("id"), n)
    sets = _sets_of(texts, ids)
    known = rows.join(sets.groupBy("id").agg(F.sum(F.size("s")).alias("n")), "id")
    fits = known.groupBy("bucket").agg(((F.count("*") <= BLOCK) & (F.sum("n") <= BLOCK_SHINGLES)).alias("fits"))
    rows = checkpointed(spread_join(rows, fits, "bucket", ("id",), rows=n), n)
    whole = F.struct(F.lit(0).alias("ring"), F.lit(True).alias("minor"), F.lit(0).alias("no"))
    compared = rows.where("fits").select("bucket", whole.alias("block"), whole.alias("other"), "id", "component", F.lit(0).alias("side"))
    rows = rows.where("not fits").drop("fits")
    if not rows.isEmpty():
        compared = compared.union(_blocks(rows, sets, percent, n))
    signed = sets.join(reps.select("id", "signature").join(ids, "id", "left_semi"), "id")
    return compared.join(signed, "id").groupBy("bucket", "block", "other").applyInPandas(_joined_between(percent), "u long, v long")


def joined(documents: DataFrame, signed: DataFrame, percent: int = 85) -> DataFrame:
    """node and component of all representatives that are linked with another."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    reps = checkpointed(signed.where("doc_id is not null and n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands")))
    member = checkpointed(reps.select("id", F.explode("bands").alias("bucket")))
    shared = member.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    member = checkpointed(spread_join(member, shared, "bucket", ("id",)).where("id <> leader"))
    # what links one row of a doc_id links its rows with other texts
    several = signed.where("doc_id is not null and set_hash is not null").groupBy("doc_id").agg((F.min("set_hash") < F.max("set_hash")).alias("several")).where("several")
    same = signed.join(several, "doc_id", "left_semi").select("doc_id", "set_hash").join(reps.select("set_hash", "id"), "set_hash").select(F.col("id").alias("u"), F.col("doc_id").alias("v"))
    found = checkpointed(components(_stars(texts, reps, member, percent).union(same.where("u <> v"))))
    between = _between(texts, reps, member, found, percent)
    if between is None:
        return found
    # components that are linked with each other, under the name of the smallest
    renamed = components(between).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    known = found.union(renamed.select(F.col("part").alias("node"), F.col("part").alias("component")).join(found.select("node"), "node", "left_anti"))
    return spread_join(known, renamed.withColumnRenamed("part", "component"), "component", ("node",), how="left", counted=found).select("node", F.coalesce("whole", "component").alias("component"))


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of documents."""
    signed = checkpointed(signatures(documents, percent))
    component = joined(documents, signed, percent)
    reps = signed.where("doc_id is not null and n_shingles > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
    named = reps.join(component, reps["rep"] == component["node"], "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "set_hash")
    some = spread_join(rows.where("set_hash is not null"), named, "set_hash", ("doc_id",), how="left")
    rows = some.select("doc_id", "n_shingles", "component").union(rows.where("set_hash is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    rows = rows.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id; columns as they were."""
    (of,) = own_names(documents, "gone_id")
    gone = near_duplicates(documents, percent).where("not kept").select(F.col("doc_id").alias(of)).distinct()
    return documents.join(gone, documents["doc_id"] == F.col(of), "left_anti")


def query(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents)
