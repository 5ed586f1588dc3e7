"""Text preparation and retrieval as corpus jobs.

Chunks: doc_id, chunk_no, header, text, is_preamble, made of a document without a shuffle. Units are the
chunks that are searched, with the tokens of their body and of their fields, written once (`postings`). Document
frequencies come from the units' distinct tokens; only tokens that queries have meet queries, summed per
unit before anything is ranked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.shared import written

# Parameters of scores.
K1, B, FIELD_WEIGHT, FLOOR = 1.5, 0.75, 2.0, 0.25
#: Query tokens up to which they go to every task.
SENT = 200_000
# Ends of lines; tokens of articles; short labels, with and without CJK characters.
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ARTICLE = "第[一二三四五六七八九十百千]+条"
# Fixed value: how citations are marked.
BRACKET = "【([^【】]+)】"
LABEL, LATIN_LABEL = r"^[\u4e00-\u9fffA-Za-z0-9，、（）()\s%．.]{1,14}$", r"^[\sA-Za-z0-9$_(),.%/\-'\"]{1,48}$"
# Cells of flattened tables, and ends of sentences.
CELL, SENTENCE_END = r"^[\sA-Za-z0-9$_(),.%:/×\-—–&;'\"]{1,60}$", r"[.。;；]\s*$"
# Terms that stand for each other in queries.
SYNONYMS = (
    ("revenue", "revenues", "net sales", "total revenue", "net revenues"), ("net income", "net earnings", "net profit"), ("operating income", "income from operations", "operating profit"),
    ("earnings per share", "diluted eps", "eps"), ("cash flow", "cash flows from operating", "operating cash flow"), ("shareholders equity", "stockholders equity", "total equity"),
    ("cost of revenue", "cost of sales", "cost of goods sold", "cogs"), ("gross margin", "gross profit"), ("research and development", "r&d"), ("long-term debt", "long term debt", "notes payable"),
)
# Patterns of personal data, in the order in which they are masked: identity numbers, mobile numbers, addresses, card numbers in one piece and in groups.
PII = (
    r"\b\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:[0-2]\d|3[01])\d{3}[\dXx]\b", r"\b1[3-9]\d{9}\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b\d{16,19}\b", r"\b\d{4} \d{4} \d{4} \d{4}(?: \d{1,3})?\b",
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    """Lines of a text; an end of line at its end begins no other."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), LINE_ENDS, "\n")
    return F.when(t == "", _none()).otherwise(F.split(F.regexp_replace(t, r"\n$", ""), "\n"))


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


#: Fixed value: white space as Unicode has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def split_long(lines: Column, cap: int, overlap: int = 2) -> Column:
    """Pieces of lines of about cap characters. The last `overlap` lines of a piece begin the next; a longer line stands alone, cut hard; a tail of less than a quarter joins the piece before it."""
    start = F.struct(_none().alias("done"), _none().alias("now"), F.lit(0).alias("size"))
    flushed = lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], "\n")))).otherwise(s["done"])
    state = lambda done, now, size: F.struct(done.alias("done"), now.alias("now"), size.alias("size"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda n, l: n + F.length(l))

    def add(s, line):
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(line) / cap).cast("int") - 1, F.lit(0))), lambda i: F.substring(line, i * cap + 1, F.lit(cap)))
        kept = F.slice(s["now"], F.greatest(F.size(s["now"]) - overlap + 1, F.lit(1)), overlap)
        alone = state(F.concat(flushed(s), cut), _none(), F.lit(0))
        full = state(flushed(s), F.concat(kept, F.array(line)), total(kept) + F.length(line))
        more = state(s["done"], F.concat(s["now"], F.array(line)), s["size"] + F.length(line))
        return F.when(F.length(line) > cap, alone).when((F.size(s["now"]) > 0) & (s["size"] + F.length(line) > cap), full).otherwise(more)

    def end(s):
        tail, n = F.array_join(s["now"], "\n"), F.size(s["done"])
        joins = (n > 0) & (F.length(tail) < cap // 4)
        joined = F.concat(F.slice(s["done"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws("\n", F.element_at(s["done"], -1), tail)))
        return F.when(F.size(s["now"]) == 0, s["done"]).when(joins, joined).otherwise(F.concat(s["done"], F.array(tail)))

    return F.aggregate(lines, start, add, end)


#: Single characters that end a line, beside the line feed.
ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_LINE_ENDS = re.compile(LINE_ENDS)


def chunks_of(text: str | None) -> list[tuple[str, str, bool]]:
    """As `chunks` without a cap, of one text: header, text, is_preamble."""
    text = text or ""
    if any(c in text for c in ENDS):
        text = _LINE_ENDS.sub("\n", text)
    title, _, rest = text.partition("\n")
    first, *parts = f"\n{rest}".split("\n## ")
    out = [(title.lstrip("# ").strip(SPACES), first.strip(SPACES), True)]
    for part in parts:
        header, _, body = part.partition("\n")
        out.append((header.strip(SPACES), body.strip(SPACES), False))
    return [x for x in out if x[1]]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 200):
            docs = whole.slice(i, 200)
            found = [chunks_of(t) for t in docs.column("text").to_pylist()]
            rows = [(n, *x) for one in found for n, x in enumerate(one, 1)]
            columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            at = pa.array([n for n, one in enumerate(found) for _ in one], pa.int32())
            yield pa.RecordBatch.from_arrays([docs.column("doc_id").take(at), *columns], ["doc_id", "chunk_no", "header", "text", "is_preamble"])


def chunks(docs: DataFrame, cap: int = 0) -> DataFrame:
    """Blocks at lines that begin with "## "; the first line is the title, what follows it the preamble. Empty blocks go; with a cap, long ones are split and numbered."""
    if not cap:
        return docs.select("doc_id", "text").mapInArrow(_chunked, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_no long, header string, text string, is_preamble boolean")
    lines = lines_of(F.col("text"))
    d = docs.select("doc_id", F.array_join(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), "\n").alias("rest"), F.coalesce(F.get(lines, F.lit(0)), F.col("doc_id").cast("string")).alias("title"))
    title = _bare(F.regexp_replace("title", "^[# ]+", ""))

    def block(x, i):
        # after the first, a part begins with its header
        body = _bare(F.when(i == 0, x).otherwise(F.substring(x, F.length(F.substring_index(x, "\n", 1)) + 1, F.length(x))))
        return F.struct(F.when(i == 0, title).otherwise(_bare(F.substring_index(x, "\n", 1))).alias("header"), body.alias("body"), (i == 0).alias("is_preamble"))

    blocks = F.filter(F.transform(F.split(F.concat(F.lit("\n"), "rest"), "\n## "), block), lambda b: b["body"] != "")
    named = lambda p, n, i: F.when(n > 1, F.concat(F.format_string("（%d/%d）\n", i + 1, n), p)).otherwise(p)
    pieces = lambda b: split_long(F.split(b["body"], "\n"), cap)
    numbered = lambda b, ps: F.transform(ps, lambda p, i: F.struct(b["header"].alias("header"), named(p, F.size(ps), i).alias("text"), b["is_preamble"].alias("is_preamble")))
    parts = F.flatten(F.transform(blocks, lambda b: _let(pieces(b), lambda ps: numbered(b, ps))))
    # outer, as else the parts are made once more to tell the documents that have any
    return d.select("doc_id", F.posexplode_outer(parts).alias("n", "c")).where("n is not null").select("doc_id", (F.col("n") + 1).cast("long").alias("chunk_no"), "c.header", "c.text", "c.is_preamble")


def tokens(text: Column) -> Column:
    """Article numbers, Latin words with light plural folding, and bigrams of CJK characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    articles = F.regexp_extract_all(low, F.lit(ARTICLE), F.lit(0))
    ends = lambda w, *tails: F.substring(w, -len(tails[0]), len(tails[0])).isin(*tails)
    less = lambda w, n: F.substring(w, 1, F.length(w) - n)
    folded = lambda w: F.when(F.length(w) <= 4, w).when(ends(w, "ies"), F.concat(less(w, 3), F.lit("y"))).when(ends(w, "es") & ~ends(w, "ses"), less(w, 2)).when(ends(w, "s") & ~ends(w, "ss"), less(w, 1)).otherwise(w)
    latin = F.transform(F.regexp_extract_all(low, F.lit(r"[a-z0-9]+"), F.lit(0)), folded)
    cjk = F.regexp_replace(low, "[^一-鿿]", "")
    grams = F.when(F.length(cjk) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(cjk) - 1, F.lit(1))), lambda i: F.substring(cjk, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(articles, latin, grams)


def expand(text: Column, groups: tuple = SYNONYMS) -> Column:
    """The query with the other terms of each group of which it holds one as whole words, once."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)\s+", " "), F.lit(" "))
    escaped = lambda t: "".join(c if c.isalnum() or c == " " else "\\" + c for c in t)
    hit = {t: low.rlike(r"(?<![a-z0-9])" + escaped(t) + r"(?![a-z0-9])") for g in groups for t in g}
    some = [F.when(F.greatest(*[hit[t] for t in g]), F.array(*[F.when(~hit[t], F.lit(t)) for t in g])).otherwise(_none()) for g in groups]
    return F.concat_ws(" ", text, F.nullif(F.array_join(F.array_distinct(F.array_compact(F.flatten(F.array(*some)))), " "), F.lit("")))


def field_tokens(header: Column, text: Column) -> Column:
    """Tokens of the header and of short labels: lines, or cells of lines with a bar. Without CJK characters a label needs a letter."""
    cells = F.flatten(F.transform(lines_of(text), lambda l: F.split(l, r"\|")))
    labels = F.filter(F.transform(cells, _bare), lambda c: F.when(c.rlike("[一-鿿]"), c.rlike("(?U)" + LABEL)).otherwise(c.rlike("(?U)" + LATIN_LABEL) & c.rlike("[A-Za-z]")))
    return F.concat(tokens(header), F.flatten(F.transform(labels, tokens)))


def bm25(searched: DataFrame, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, chunk_no, score of units that share a token with a query (query_id, text): body plus FIELD_WEIGHT times fields.

    Okapi; a negative idf becomes FLOOR of the channel's mean idf. Queries are expanded. within: only these
    documents (query_id, doc_id). All scores are computed; for the best k alone see `postings`.
    """
    each = lambda what: F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.size(c).alias("len"), what(c).alias("t")) for c in ("body", "field")]))
    stats = searched.select(each(lambda c: F.lit(0)).alias("x")).groupBy("x.channel").agg(F.count("*").alias("n"), F.avg("x.len").alias("mean_len"))
    df = searched.select(each(F.array_distinct).alias("x")).select("x.channel", F.explode("x.t").alias("token")).groupBy("channel", "token").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(stats), "channel").withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # a row for each channel
    idf = written(idf)
    mean = idf.groupBy("channel").agg(F.avg("raw").alias("mean_idf"))
    idf = idf.join(F.broadcast(mean), "channel").withColumn("idf", F.when(F.col("raw") < 0, FLOOR * F.col("mean_idf")).otherwise(F.col("raw")))
    asked = queries.select("query_id", F.explode(tokens(expand(F.col("text")))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    q = written(asked.join(idf.select("channel", "token", "idf", "mean_len"), "token"))
    few = lambda d: F.broadcast(d) if d.count() <= SENT else d
    wanted = q.select("token").distinct()
    found = searched.select("doc_id", "chunk_no", each(F.col).alias("x")).select("doc_id", "chunk_no", "x.channel", "x.len", F.explode("x.t").alias("token")).join(few(wanted), "token", "left_semi")
    tf = found.groupBy("doc_id", "chunk_no", "channel", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    weight = F.when(F.col("channel") == "field", FIELD_WEIGHT).otherwise(1.0)
    met = tf.join(few(q), ["channel", "token"])
    met = met if within is None else met.join(within, ["query_id", "doc_id"], "left_semi")
    return met.groupBy("query_id", "doc_id", "chunk_no").agg(F.sum(weight * part).alias("score"))


def top(scores: DataFrame, k: int, per: list[str], *ties: str) -> DataFrame:
    w = W.partitionBy(*per).orderBy(F.desc("score"), *ties)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def document_scores(scores: DataFrame, best: int = 3) -> DataFrame:
    """query_id, doc_id, score: the sum of the best chunks (query_id, doc_id, chunk_no, score)."""
    return top(scores, best, ["query_id", "doc_id"], "chunk_no").groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def rotating(ranked: DataFrame, cap: int, ids: tuple[str, ...] = ("doc_id", "chunk_no")) -> DataFrame:
    """group_id, ids, place: lists of several queries (group_id, query_no, rank, ids) merged in turns, each chunk once, cut at cap."""
    first = ranked.withColumn("n", F.row_number().over(W.partitionBy("group_id", *ids).orderBy("rank", "query_no"))).where("n = 1")
    return first.withColumn("place", F.row_number().over(W.partitionBy("group_id").orderBy("rank", "query_no"))).where(F.col("place") <= cap).select("group_id", *ids, "place")


#: Queries that go to every task at once.
AT_ONCE = 4096


def _nearest(shared, k: int):
    """The k nearest of each query among a task's vectors; by score, then by id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best: list[list[tuple]] = [[] for _ in ids]
        for rows in batches if ids else ():
            for i in range(0, len(rows), 2048):
                part = rows.iloc[i : i + 2048]
                v = np.stack([np.asarray(x, float) for x in part["v"]])
                size = np.sqrt((v * v).sum(axis=1))
                some = size > 0
                scores, found = np.round(q @ (v[some] / size[some, None]).T, 6), part["id"].to_numpy()[some]
                for n, s in enumerate(scores):
                    floor = -best[n][-1][0] if len(best[n]) == k else -np.inf
                    if len(s) > k:
                        floor = max(floor, np.partition(s, len(s) - k)[len(s) - k])
                    at = np.flatnonzero(s >= floor)
                    best[n] = sorted([*best[n], *zip((-s[at]).tolist(), found[at].tolist())])[:k]
        out = [(ids[n], x, -s) for n, mine in enumerate(best) for s, x in mine]
        yield pd.DataFrame(out, columns=["query_id", "id", "score"])

    return run


def cosine(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank: the k nearest (id, v) of each query (query_id, q), by comparison with all, six decimals; vectors that are null or zero take no part.

    Queries go to every task, AT_ONCE of them at a time; a task multiplies matrices and gives back k rows for a query.
    """
    spark = vectors.sparkSession
    asked = written(queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q")))
    v = vectors.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double"
    out, groups = None, asked.count() // AT_ONCE + 1
    for g in range(groups):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).collect()  # about AT_ONCE rows
        q = np.array([r["q"] for r in rows], float) if rows else np.zeros((0, 1))
        size = np.sqrt((q * q).sum(axis=1))
        shared = spark.sparkContext.broadcast(([r["query_id"] for r, s in zip(rows, size) if s > 0], q[size > 0] / size[size > 0, None]))
        found = v.mapInPandas(_nearest(shared, k), kinds)
        out = found if out is None else out.union(found)
    return top(out, k, ["query_id"], "id")


def fused(a: DataFrame, b: DataFrame, weight_a: float = 1.0, weight_b: float = 1.0, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank)."""
    x = a.select("query_id", "id", F.col("rank").alias("ra")).join(b.select("query_id", "id", F.col("rank").alias("rb")), ["query_id", "id"], "full_outer")
    return x.select("query_id", "id", (F.coalesce(weight_a / (k + F.col("ra")), F.lit(0.0)) + F.coalesce(weight_b / (k + F.col("rb")), F.lit(0.0))).alias("score"))


def hash_embedding(rows: DataFrame, dims: int = 256) -> DataFrame:
    """id, bucket, weight: bigrams within Latin words and of CJK characters in a row, hashed by sha256, L2 normalised, 6 decimals (rows: id, text). Sparse; hash_vectors makes arrays."""
    grams = lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))).otherwise(_none())
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    g = rows.select("id", F.explode(F.concat(F.flatten(F.transform(words, grams)), grams(F.regexp_replace("text", "[^一-鿿]", "")))).alias("g"))
    bucket = (F.conv(F.substring(F.sha2("g", 256), 1, 16), 16, 10).cast("decimal(20,0)") % dims).cast("int")
    n = g.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    norm = n.groupBy("id").agg(F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double"))).alias("norm"))
    return n.join(norm, "id").select("id", "bucket", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def hash_vectors(sparse: DataFrame, dims: int = 256) -> DataFrame:
    m = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return m.select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("v"))


def cache_fill(texts: DataFrame, cache: DataFrame, kind: str, embed) -> DataFrame:
    """The cache with new entries: only texts whose digest is unseen go to embed (a DataFrame function text_key, text -> text_key, v)."""
    keyed = texts.select(F.sha2(F.concat(F.lit(kind), "text"), 256).alias("text_key"), "text").dropDuplicates(["text_key"])
    return cache.unionByName(embed(keyed.join(cache.select("text_key"), "text_key", "left_anti")))


def recall(evidence: DataFrame, contexts: DataFrame, ks: tuple[int, ...] = (4, 8, 16), threshold: float = 0.8) -> DataFrame:
    """q_id, k, coverage, hit, answered: what the first k contexts (q_id, rank, text) hold of the evidence (q_id, text, answer).

    coverage is the share of the evidence's words; each word counts from the least rank that holds it, so all k
    come from one aggregate. An answer is held if one of its numbers is, without signs and thousands marks; one
    without numbers if the contexts, put together, hold its text. answered is null without an answer.
    """
    split = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    words = lambda c: split(F.lower(c), "[a-z0-9]+")
    numbers = lambda c: split(F.regexp_replace(F.coalesce(c, F.lit("")), "[,$%]", ""), r"\d+(?:\.\d+)?")
    terms = lambda w, n: F.explode(F.concat(F.transform(w, lambda x: F.concat(F.lit("w"), x)), F.transform(n, lambda x: F.concat(F.lit("n"), x)))).alias("term")
    c = contexts.where(F.col("rank") <= max(ks))
    held = c.select("q_id", "rank", terms(words(F.col("text")), numbers(F.col("text")))).groupBy("q_id", "term").agg(F.min("rank").alias("at"))
    found = evidence.select("q_id", terms(words(F.col("text")), numbers(F.col("answer")))).join(held, ["q_id", "term"], "left")
    of, least = F.col("term").startswith("w"), F.coalesce("at", F.lit(1 << 30))
    ranks = found.groupBy("q_id").agg(F.count_if(of).alias("n"), *[F.count_if(of & (least <= k)).alias(f"w{k}") for k in ks], F.min(F.when(~of, least)).alias("number_at"))
    plain = lambda t: _bare(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))
    wordy = evidence.where((F.coalesce("answer", F.lit("")) != "") & (F.size(numbers(F.col("answer"))) == 0)).select("q_id", plain(F.col("answer")).alias("a"))
    together = c.join(wordy, "q_id").groupBy("q_id", "a").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))  # as many texts as the largest k
    joined = lambda k: plain(F.array_join(F.transform(F.filter("x", lambda s: s["rank"] <= k), lambda s: s["text"]), "\n"))
    texts = together.select("q_id", *[F.contains(joined(k), F.col("a")).alias(f"t{k}") for k in ks])
    rows = evidence.select("q_id", "answer").join(c.select("q_id").distinct(), "q_id", "left_semi").join(ranks, "q_id", "left").join(texts, "q_id", "left")
    answered = lambda k: F.when(F.coalesce("answer", F.lit("")) != "", F.when(F.size(numbers(F.col("answer"))) > 0, F.coalesce(F.col("number_at") <= k, F.lit(False))).otherwise(F.coalesce(f"t{k}", F.lit(False))))
    cover = lambda k: F.coalesce(F.col(f"w{k}") / F.nullif("n", F.lit(0)), F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), cover(k).alias("coverage"), (cover(k) >= threshold).alias("hit"), answered(k).alias("answered")) for k in ks])).alias("x")
    return rows.select("q_id", each).select("q_id", "x.*")


def recall_rates(rows: DataFrame) -> DataFrame:
    """k, evaluated, hits, answers and their rates, four decimals (rows: of recall)."""
    g = rows.groupBy("k").agg(F.count("*").alias("evaluated"), F.count_if("hit").alias("hits"), F.count_if("answered").alias("answers"))
    return g.withColumn("recall", F.round(F.col("hits") / F.col("evaluated"), 4)).withColumn("answer_rate", F.round(F.col("answers") / F.col("evaluated"), 4))


def rebuilt_tables(docs: DataFrame, least: int = 4, width: int = 8) -> DataFrame:
    """doc_id, text: runs of at least `least` cell lines, blank lines between them aside, become piped rows of `width` cells.

    A cell is a short line of letters, digits and signs that doesn't end a sentence. Cells of shorter runs
    stay, with a blank line between them; three and more ends of line become two.
    """
    # the end is told before the lines part, as else each line would carry the whole text
    l = docs.select("doc_id", F.right(F.coalesce(F.col("text"), F.lit("")), F.lit(1)).alias("end"), lines_of(F.col("text")).alias("_lines")).select("doc_id", "end", F.posexplode_outer("_lines").alias("pos", "line"))
    bare = F.col("bare")  # made once for a line
    cell = (F.length(bare) <= 60) & bare.rlike("[A-Za-z0-9]") & ~F.col("line").rlike(SENTENCE_END) & bare.rlike(CELL)
    l = l.withColumn("bare", _bare(F.col("line"))).withColumn("kind", F.when(F.col("line").isNull(), None).when(bare == "", "blank").when(cell, "cell").otherwise("text"))
    # a segment: a line of text and the cells and blank lines after it
    l = l.withColumn("segment", F.sum((F.col("kind") == "text").cast("int")).over(W.partitionBy("doc_id").orderBy("pos")))
    one = F.struct("pos", "kind", F.when(F.col("kind") == "text", F.col("line")).when(F.col("kind") == "cell", bare).alias("value"))
    g = l.groupBy("doc_id", "end", "segment").agg(F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("x"), F.min(F.when(F.col("kind") == "cell", F.col("pos"))).alias("at"))
    g = g.withColumn("last", F.col("segment").eqNullSafe(F.max("segment").over(W.partitionBy("doc_id"))))
    of = lambda kind: F.transform(F.filter("x", lambda s: s["kind"] == kind), lambda s: s["value"])
    g = g.select("doc_id", "end", "segment", "last", of("text").alias("text"), of("cell").alias("cells"), F.filter("x", lambda s: (s["kind"] == "blank") & (s["pos"] < F.coalesce("at", F.lit(1 << 30)))).alias("blanks"))
    lead = F.transform("blanks", lambda i: F.lit(""))
    n, none = F.size("cells"), _none()
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / width).cast("int") - 1, F.lit(0))), lambda i: F.concat(F.lit("| "), F.array_join(F.slice("cells", i * width + 1, F.lit(width)), " | "), F.lit(" |")))
    kept = F.concat(F.split(F.array_join("cells", "\n\n"), "\n"), F.when(F.col("last"), none).otherwise(F.array(F.lit(""))))
    table = F.when(n >= least, F.concat(rows, F.array(F.lit("")))).when(n > 0, kept).otherwise(none)
    g = g.select("doc_id", "end", "segment", F.concat("text", lead, table).alias("lines"))
    out = g.groupBy("doc_id", "end").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("segment", "lines"))), lambda s: s["lines"])).alias("lines"))
    text = F.regexp_replace(F.array_join("lines", "\n"), r"\n{3,}", "\n\n")
    return out.select("doc_id", F.concat(text, F.when((F.col("end") == "\n") & ~text.endswith("\n"), "\n").otherwise("")).alias("text"))


def masked(text: Column) -> Column:
    """text and hits: the text with personal data masked (3 first and 2 last characters stay, all of up to 5 go) and the number of places. Only the places found are changed. Words are as in Unicode."""
    mask = lambda x: F.when(F.length(x) <= 5, F.repeat(F.lit("*"), F.length(x))).otherwise(F.concat(F.substring(x, 1, 3), F.repeat(F.lit("*"), F.length(x) - 5), F.substring(x, -2, 2)))
    # a text is its parts between the places and the places themselves, in turn
    joined = lambda parts, found: F.array_join(F.zip_with(parts, F.transform(found, mask), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    state = F.struct(text.alias("text"), F.lit(0).alias("hits"))
    for p in PII:
        state = _let(state, _masking("(?U)" + p, joined))
    return state


def _masking(pattern: str, joined):
    def one(s: Column) -> Column:
        cut = lambda found: F.struct(joined(F.split(s["text"], pattern), found).alias("text"), (s["hits"] + F.size(found)).alias("hits"))
        return F.when(s["text"].rlike(pattern), _let(F.regexp_extract_all(s["text"], F.lit(pattern), F.lit(0)), cut)).otherwise(s)

    return one


def is_verbatim(header: Column, text: Column) -> Column:
    """Articles, and texts of which four hundredths are digits (of any script)."""
    digits = F.length(text) - F.length(F.regexp_replace(text, r"(?U)\d", ""))
    return header.rlike(f"^{ARTICLE}$") | (digits >= 0.04 * F.greatest(F.length(text), F.lit(1)))


def fact_lines(facts: DataFrame) -> DataFrame:
    """q_id, line_no, doc_id, header, chars of lines that begin with 【doc·header】; other lines have no doc_id and header, and their characters can't be attributed."""
    l = facts.select("q_id", F.posexplode(lines_of(F.col("text"))).alias("line_no", "line"))
    inside = F.regexp_extract(_bare(F.col("line")), "^【([^【】]+)】", 1)
    ours = F.contains(inside, F.lit("·"))
    doc = F.substring_index(inside, "·", 1)
    header = F.substring(inside, F.length(doc) + 2, F.length(inside))
    return l.select("q_id", "line_no", F.when(ours, _bare(doc)).alias("doc_id"), F.when(ours, _bare(header)).alias("header"), F.length("line").alias("chars"))


def citations(reply: Column) -> Column:
    """What stands in 【】, then article numbers and numbers like 3.2 outside of them; as often as they stand there."""
    all_of = lambda text, pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    outside = F.regexp_replace(reply, BRACKET, " ")
    return F.concat(all_of(reply, BRACKET, 1), all_of(outside, ARTICLE, 0), all_of(outside, r"(?U)\d+\.\d+", 0))


def match_citations(cited: DataFrame, units: DataFrame) -> DataFrame:
    """q_id, rank, doc_id, header of fed units (q_id, rank, doc_id, header) that a citation (q_id, citation) names.

    Spaces don't count. "doc · header" names a unit whose document it holds on the left and whose header and it
    begin alike; without the dot the header alone decides, in all documents.
    """
    close = lambda c: F.regexp_replace(c, "[ \u3000]", "")
    c = cited.select("q_id", close(F.col("citation")).alias("cite")).distinct().withColumn("doc", F.when(F.contains("cite", F.lit("·")), F.substring_index("cite", "·", 1)))
    c = c.withColumn("head", F.when(F.col("doc").isNull(), F.col("cite")).otherwise(F.expr("substring(cite, length(doc) + 2)"))).where("head <> ''")
    u = units.select(F.col("q_id").alias("u_q"), "rank", "doc_id", "header", close(F.col("header")).alias("h"), close(F.col("doc_id").cast("string")).alias("d"))
    alike = F.startswith("h", "head") | F.startswith("head", "h")
    return c.join(u, (F.col("q_id") == F.col("u_q")) & (F.col("doc").isNull() | F.contains("doc", "d")) & alike).select("q_id", "rank", "doc_id", "header").distinct()


def usage(units: DataFrame, used: DataFrame) -> DataFrame:
    """rank (null: all), fed, used, rate, characters that were fed and not used (units: q_id, rank, chars)."""
    j = units.join(used.select("q_id", "rank").distinct().withColumn("u", F.lit(1)), ["q_id", "rank"], "left")
    out = j.rollup("rank").agg(F.count("*").alias("fed"), F.count("u").alias("used"), F.sum(F.when(F.col("u").isNull(), F.col("chars")).otherwise(0)).alias("wasted"), F.sum("chars").alias("chars"))
    return out.withColumn("rate", F.col("used") / F.col("fed")).withColumn("wasted_share", F.col("wasted") / F.nullif("chars", F.lit(0)))


def answer_numbers(answer: Column) -> Column:
    """Numbers of an answer without thousands marks; single digits don't count."""
    found = F.regexp_extract_all(F.regexp_replace(answer, r"(?<=\d),(?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.filter(F.array_distinct(found), lambda n: F.length(n) > 1)


def citation_coverage(rows: DataFrame) -> DataFrame:
    """q_id, share of the answer's numbers that the cited text holds, and those that it lacks (rows: q_id, answer, cited)."""
    r = rows.withColumn("n", answer_numbers(F.col("answer"))).withColumn("lacking", F.filter("n", lambda x: ~F.contains(F.col("cited"), x)))
    return r.select("q_id", F.when(F.size("n") > 0, 1 - F.size("lacking") / F.size("n")).alias("coverage"), F.array_join("lacking", ",").alias("lacking"))


def assembled(verdicts: DataFrame) -> DataFrame:
    """q_id, multi (all true letters) and single (the letter, if exactly one is true) of option verdicts (q_id, letter, reply); the last mark of a reply counts."""
    mark = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all("reply", F.lit(r"(?i)VERDICT:\s*(TRUE|FALSE)"), F.lit(1))), -1)
    g = verdicts.withColumn("v", F.upper(mark)).groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("v") == "TRUE", F.col("letter")))), "").alias("multi"))
    return g.withColumn("single", F.when(F.length("multi") == 1, F.col("multi")).otherwise(""))


def option_queries(questions: DataFrame) -> DataFrame:
    """q_id, query_no, text: one query for each option, one for a true/false question (questions: q_id, question, options map, kind)."""
    q = questions.withColumn("o", F.array_sort(F.map_entries("options")))
    many = q.where("kind <> 'tf'").select("q_id", F.posexplode("o").alias("query_no", "x"), "question").select("q_id", "query_no", F.concat_ws(" ", "question", "x.value").alias("text"))
    return many.unionByName(q.where("kind = 'tf'").select("q_id", F.lit(0).alias("query_no"), F.col("question").alias("text")))


def normalized_answer(answer: Column, single: Column) -> Column:
    """Letters A to D; the first for single choice, else sorted and distinct."""
    letters = F.regexp_extract_all(F.upper(F.coalesce(answer, F.lit(""))), F.lit("[A-D]"), F.lit(0))
    return F.when(single, F.coalesce(F.get(letters, F.lit(0)), F.lit(""))).otherwise(F.array_join(F.array_sort(F.array_distinct(letters)), ""))


def score_report(results: DataFrame, budget: float) -> DataFrame:
    """domain (null: all), n, accuracy, tokens, final: 100 * accuracy * (0.7 + 0.3 * token score) with the token score clipped to 0..1 (results: domain, correct, tokens)."""
    g = results.rollup("domain").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum("tokens").alias("tokens"))
    ts = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("tokens") / F.lit(float(budget))))
    return g.withColumn("final", 100 * F.col("accuracy") * (0.7 + 0.3 * ts))


def paired_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts over questions of both runs (q_id, correct, tokens)."""
    j = a.select("q_id", F.col("correct").alias("x"), F.col("tokens").alias("tx")).join(b.select("q_id", F.col("correct").alias("y"), F.col("tokens").alias("ty")), "q_id")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("a_better"), F.count_if(~F.col("x") & F.col("y")).alias("b_better"), F.count_if(~F.col("x") & ~F.col("y")).alias("both_wrong"), F.sum(F.col("ty") - F.col("tx")).alias("token_difference"))


def evidence_export(used: DataFrame, chunks: DataFrame, most: int = 300) -> DataFrame:
    """q_id, evidence: used units (q_id, rank, doc_id, header) with quoted text, as JSON in order of rank."""
    c = chunks.select("doc_id", "header", F.substring("text", 1, most).alias("quote"))
    j = used.join(c, ["doc_id", "header"], "left")
    return j.groupBy("q_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "header", "quote")))).alias("evidence"))
