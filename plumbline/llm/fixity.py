"""Merkle fixity audit of archived records.

Records are hashed and put into ordered slots of files; a slot knows its range of offsets in its file.
Trees of a fixed fan-out stand over the slots of a file and over the files. Two replicas are compared
at the root; only children of nodes that differ are read on the next level down, until the slots that
differ are left. They are reported with the range of offsets in the first replica.

A slot is a record id. Records that share an id form a multiset in their slot, whose digest is made of
sums of digest parts, so a very frequent id is aggregated before the shuffle and never gathered.

Defined results: null url and html count as empty; a null id has a slot by its url (in files below all others), and
is reported with a null page_id. The order of rows and extra columns don't matter. Equal replicas, also
two empty ones, give no rows. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

#: Slots of a file, and children of a node.
FILE, FAN = 1024, 16


def _record(url: Column, html: Column) -> Column:
    return F.concat(F.coalesce(url, F.lit("")), F.lit("\r\n\r\n"), F.coalesce(html, F.lit("")))


def slots(pages: DataFrame) -> DataFrame:
    """file, slot, digest and the offsets [begin, end) in the file: the leaves of the tree."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _record(F.col("url"), F.col("html")).alias("record"), F.col("url").alias("url"))
    lost = F.lit(-(1 << 50)) - F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(1 << 30))
    slot = F.coalesce("page_id", lost)
    rows = rows.select("page_id", F.floor(slot / FILE).cast("long").alias("file"), slot.alias("slot"), F.octet_length("record").cast("long").alias("octets"), F.sha2("record", 256).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)]
    digest = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *parts), 256)
    rows = rows.groupBy("file", "slot").agg(digest.alias("digest"), F.sum("octets").alias("octets"), F.max("page_id").alias("page_id"))
    end = F.sum("octets").over(W.partitionBy("file").orderBy("slot"))
    return rows.select("file", "slot", "page_id", "digest", (end - F.col("octets")).alias("begin"), end.alias("end"))


def _above(nodes: DataFrame, parent: list[Column], order: list[str]) -> DataFrame:
    """Parents of nodes; a parent has FAN children at most, in their order."""
    children = F.array_sort(F.collect_list(F.struct(*order, "digest")))
    return nodes.groupBy(*parent).agg(F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256).alias("digest"))


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels from the leaves up: first within files (file, node), then over files (file only); the last has few nodes."""
    levels = [leaves.withColumn("node", F.pmod("slot", F.lit(FILE)))]
    width = FILE
    while width > 1:
        levels.append(_above(levels[-1], [F.col("file"), F.floor(F.col("node") / FAN).cast("long").alias("node")], ["node"]))
        width = -(-width // FAN)
    top = _above(levels[-1], [F.floor(F.col("file") / FAN).cast("long").alias("file")], ["file"])
    levels.append(top)
    span = leaves.agg(F.max(F.abs("file"))).first()[0] or 0
    while span >= FAN:
        levels.append(_above(levels[-1], [F.floor(F.col("file") / FAN).cast("long").alias("file")], ["file"]))
        span //= FAN
    return levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    b = b.select(*[F.col(k).alias(f"{k}_b") for k in keys], F.col("digest").alias("digest_b"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_b"))
    rows = a.select(*keys, "digest").join(b, on, "full_outer").where(~F.col("digest").eqNullSafe(F.col("digest_b")))
    return rows.select(*[F.coalesce(k, f"{k}_b").alias(k) for k in keys], F.when(F.col("digest").isNull(), "extra").when(F.col("digest_b").isNull(), "missing").otherwise("changed").alias("state"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Slots of which the replicas differ: page_id, file, begin, end (offsets in the first replica; in the second for `extra`), state."""
    one, two = checkpointed(slots(first)), checkpointed(slots(second))
    a, b = tree(one), tree(two)
    while len(a) != len(b):  # the taller tree has files that the other lacks
        short = a if len(a) < len(b) else b
        short.append(_above(short[-1], [F.floor(F.col("file") / FAN).cast("long").alias("file")], ["file"]))
    inner = 0
    width = FILE
    while width > 1:
        inner, width = inner + 1, -(-width // FAN)
    suspects = _differing(a[-1], b[-1], ["file"])
    for level in range(len(a) - 2, -1, -1):
        keys = ["file", "node"] if level <= inner else ["file"]
        if level > inner:
            up = [F.floor(F.col("file") / FAN).cast("long") == F.col("up_file")]
        elif level == inner:
            up = [F.floor(F.col("file") / FAN).cast("long") == F.col("up_file")]
        else:
            up = [F.col("file") == F.col("up_file"), F.floor(F.col("node") / FAN).cast("long") == F.col("up_node")]
        names = ["file", "node"] if level < inner else ["file"]
        above = suspects.select(*[F.col(k).alias(f"up_{k}") for k in names]).distinct()
        below = [x[level].join(above, up, "left_semi") for x in (a, b)]
        suspects = checkpointed(_differing(below[0], below[1], keys))
    facts = one.withColumn("own", F.lit(0)).unionByName(two.withColumn("own", F.lit(1))).withColumn("node", F.pmod("slot", F.lit(FILE)))
    hit = facts.join(suspects, ["file", "node"]).where((F.col("own") == 0) | (F.col("state") == "extra"))
    return hit.select("page_id", "file", "begin", "end", "state")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known faults, derived from pages: every 40th record is altered in one place, every 250th is lost."""
    rows = pages.where("page_id is null or page_id % 250 <> 11")
    hurt = F.col("page_id").isNotNull() & (F.col("page_id") % 40 == 7)
    return rows.withColumn("html", F.when(hurt, F.concat(F.col("html"), F.lit("\x00"))).otherwise(F.col("html")))


def query(pages: DataFrame) -> DataFrame:
    return audit(pages, damaged(pages))


#: DuckDB SQL for the query's rows, given unique ids.
ORACLE = r"""
WITH r AS (SELECT page_id, page_id // 1024 AS file, (strlen(coalesce(url, '')) + 4 + strlen(coalesce(html, '')))::BIGINT AS n FROM pages),
o AS (SELECT *, (sum(n) OVER (PARTITION BY file ORDER BY page_id))::BIGINT AS e FROM r)
SELECT page_id, file, (e - n)::BIGINT AS begin, e AS "end", CASE WHEN page_id % 250 = 11 THEN 'missing' ELSE 'changed' END AS state
FROM o WHERE page_id % 250 = 11 OR page_id % 40 = 7
"""
