"""Queries over documents, benchmark passages, pages and embeddings: text preparation, retrieval, citations, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import postings
from plumbline.operators import retrieval as re_
from plumbline.plans.registry import query
from plumbline.shared import written

FOLD = "CASE WHEN length(w) <= 4 THEN w WHEN w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN w LIKE '%es' AND w NOT LIKE '%ses' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END"


def toks(x):
    return f"list_transform(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: {FOLD})"


# Every other line becomes a heading; documents of two lines have a preamble only.
MD = "md AS (SELECT doc_id, regexp_replace(text, '\n([^\n]*\n)', chr(10) || '## \\1', 'g') AS text FROM documents)"


def md(t, docs=None):
    return (t.documents if docs is None else docs).select("doc_id", F.regexp_replace("text", r"\n([^\n]*\n)", "\n## $1").alias("text"))


BARE = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
CHUNKS = f"""{MD}, li AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM md))), bl AS (SELECT *, sum((i > 1 AND line LIKE '## %')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM li),
bk AS (SELECT doc_id, block, arg_min(line, i) AS first, coalesce({BARE.format("string_agg(CASE WHEN i = 1 OR i > 1 AND line LIKE '## %' THEN NULL ELSE line END, chr(10) ORDER BY i)")}, '') AS text FROM bl GROUP BY 1, 2),
ck AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS chunk_no, CASE WHEN block > 0 THEN {BARE.format("substr(first, 4)")} ELSE {BARE.format("ltrim(first, '# ')")} END AS header, text, block = 0 AS is_preamble FROM bk WHERE text <> '')"""


@query("q150_heading_chunks", f"WITH {CHUNKS} SELECT * FROM ck")
def _(t):
    return re_.chunks(md(t))


@query("q151_long_block_split")
def _(t):
    return re_.chunks(md(t), cap=400)


@query("q152_tokens", f"SELECT doc_id, array_to_string({toks('text')}, ' ') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(re_.tokens(F.col("text")), " ").alias("tokens"))


SYN = "sy AS (SELECT * FROM (VALUES " + ", ".join(f"({g}, {i}, '{w}')" for g, words in enumerate(re_.SYNONYMS) for i, w in enumerate(words)) + ") AS x(grp, ord, term))"
ASKED = "aq AS (SELECT item_id AS query_id, text || CASE item_id % 4 WHEN 0 THEN ' Net  Sales and EPS?' WHEN 1 THEN ' epsilon of r&d, long-term debt' ELSE '' END AS text FROM benchmark)"
EXPANDED = f"""{SYN}, {ASKED}, ah AS (SELECT query_id, grp, ord, term, regexp_matches(' ' || regexp_replace(lower(text), '\\s+', ' ', 'g') || ' ', '[^a-z0-9]' || regexp_escape(term) || '[^a-z0-9]') AS hit FROM aq, sy),
ax AS (SELECT query_id, string_agg(term, ' ' ORDER BY grp, ord) FILTER (NOT hit) AS extra FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id, grp) AS named FROM ah) WHERE named GROUP BY 1), eq AS (SELECT query_id, concat_ws(' ', text, extra) AS text FROM aq LEFT JOIN ax USING (query_id))"""


def asked(t):
    more = F.when(F.col("item_id") % 4 == 0, " Net  Sales and EPS?").when(F.col("item_id") % 4 == 1, " epsilon of r&d, long-term debt").otherwise("")
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat("text", more).alias("text"))


@query("q153_query_expansion", f"WITH {EXPANDED} SELECT * FROM eq")
def _(t):
    return asked(t).select("query_id", re_.expand(F.col("text")).alias("text"))


# Chunks whose last line is a label line and a row of cells, so that fields have something to tell.
LABELLED = rf"""{CHUNKS}, lb AS (SELECT doc_id, chunk_no, is_preamble, header, text || chr(10) || 'Total net sales' || chr(10) || substr(text, 1, 20) || ' | ' || doc_id || ' | 2018 | ' || substr(text, 5, 60) AS text FROM ck),
lc AS (SELECT doc_id, chunk_no, header, text, is_preamble, list_filter(list_transform(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, '|'))), lambda c: {BARE.format("c")}), lambda c: regexp_full_match(c, '[\sA-Za-z0-9$_(),.%/\-''"]{{1,48}}') AND regexp_matches(c, '[A-Za-z]')) AS labels FROM lb),
fi AS (SELECT doc_id, chunk_no, text, is_preamble, list_concat({toks("header")}, flatten(list_transform(labels, lambda c: {toks("c")}))) AS field FROM lc)"""


def labelled(t, docs=None):
    row = F.concat(F.substring("text", 1, 20), F.lit(" | "), F.col("doc_id").cast("string"), F.lit(" | 2018 | "), F.substring("text", 5, 60))
    return re_.chunks(md(t, docs)).withColumn("text", F.concat_ws("\n", "text", F.lit("Total net sales"), row))


@query("q154_field_text", f"WITH {LABELLED} SELECT doc_id, chunk_no, array_to_string(field, ' ') AS fields FROM fi")
def _(t):
    return labelled(t).select("doc_id", "chunk_no", F.array_join(re_.field_tokens(F.col("header"), F.col("text")), " ").alias("fields"))


BM25 = f"""{LABELLED}, {EXPANDED}, un AS (SELECT doc_id, chunk_no, {toks('text')} AS body, field FROM (SELECT *, bool_or(NOT is_preamble) OVER (PARTITION BY doc_id) AS more FROM fi) WHERE NOT is_preamble OR NOT more),
ch AS (SELECT doc_id, chunk_no, 'body' AS channel, body AS t FROM un UNION ALL SELECT doc_id, chunk_no, 'field', field FROM un), st AS (SELECT channel, count(*) AS n, avg(len(t)) AS mean_len FROM ch GROUP BY 1),
po AS (SELECT doc_id, chunk_no, channel, token, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, chunk_no, channel, len(t) AS len, unnest(t) AS token FROM ch) GROUP BY 1, 2, 3, 4),
df AS (SELECT channel, token, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM po JOIN st USING (channel) GROUP BY 1, 2), idf AS (SELECT channel, token, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY channel) ELSE raw END AS idf FROM df),
qt AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({toks('text')}) AS token FROM eq) GROUP BY 1, 2),
sc AS (SELECT query_id, doc_id, chunk_no, sum(CASE channel WHEN 'field' THEN 2.0 ELSE 1.0 END * qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_len))) AS score FROM qt JOIN idf USING (token) JOIN po USING (token, channel) JOIN st USING (channel) GROUP BY 1, 2, 3)"""


def indexed(t):
    return postings.index(postings.units(labelled(t)))


def best(t, k, named=None):
    units = postings.units(labelled(t))
    return postings.top_units(postings.index(units), asked(t), k, named, units)


def rounded(df, places):
    return df.withColumn("score", F.round("score", places))


@query("q155_bm25", f"WITH {BM25} SELECT query_id, doc_id, chunk_no, round(score, 4) AS score FROM sc")
def _(t):
    return postings.scores(indexed(t), asked(t), 4)


@query("q156_document_scores", f"WITH {BM25}, d AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 6) DESC, chunk_no) AS r FROM sc) SELECT query_id, doc_id, round(sum(round(score, 6)), 3) AS score FROM d WHERE r <= 3 GROUP BY 1, 2")
def _(t):
    return rounded(postings.document_scores(indexed(t), asked(t)), 3)


# Even queries name the documents in which they search.
NAMED = "al AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % 7 = item_id % 7 WHERE item_id % 2 = 0), sa AS (SELECT sc.* FROM sc WHERE query_id % 2 = 1 OR EXISTS (SELECT 1 FROM al WHERE al.query_id = sc.query_id AND al.doc_id = sc.doc_id))"


@query("q157_top_k", f"WITH {BM25}, {NAMED} SELECT query_id, doc_id, chunk_no, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, chunk_no) AS rank FROM sa QUALIFY rank <= 8")
def _(t):
    sevens = t.documents.select("doc_id", (F.col("doc_id") % 7).alias("seven"))
    names = t.benchmark.where("item_id % 2 = 0").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 7).alias("seven")).join(sevens, "seven").select("query_id", "doc_id")
    return best(t, 8, names).select("query_id", "doc_id", "chunk_no", "rank")


RANKED = f"{BM25}, rk AS (SELECT query_id // 4 AS group_id, query_id AS query_no, doc_id, chunk_no, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, chunk_no) AS rank FROM sc QUALIFY rank <= 8)"


@query("q158_rotating_merge", f"WITH {RANKED}, f AS (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY group_id, doc_id, chunk_no ORDER BY rank, query_no) = 1) SELECT group_id, doc_id, chunk_no, row_number() OVER (PARTITION BY group_id ORDER BY rank, query_no) AS place FROM f QUALIFY place <= 12")
def _(t):
    r = best(t, 8)
    return re_.rotating(r.select(F.floor(F.col("query_id") / 4).alias("group_id"), F.col("query_id").alias("query_no"), "doc_id", "chunk_no", "rank"), 12)


COSINES = """cs AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
ct AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 20)"""


def cosines(t):
    e = t.embeddings
    return re_.cosine(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


@query("q159_cosine", f"WITH {COSINES} SELECT query_id, id, score, rank FROM ct")
def _(t):
    return cosines(t)


# Documents by text and by vector; a vector belongs to the document of its number, and every query has one.
FUSED = f"""{BM25}, {COSINES}, d AS (SELECT query_id, doc_id AS id, round(sum(round(score, 6)), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY round(score, 6) DESC, chunk_no) AS r FROM sc) WHERE r <= 3 GROUP BY 1, 2),
a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM d QUALIFY r <= 20), b AS (SELECT query_id // 50 AS query_id, id, rank AS r FROM ct)"""


@query("q160_rank_fusion", f"WITH {FUSED} SELECT query_id, id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(0.5 / (60 + b.r), 0), 8)::DOUBLE AS score FROM a FULL JOIN b USING (query_id, id)")
def _(t):
    d = rounded(postings.document_scores(indexed(t), asked(t), k=20, places=4), 4).withColumnRenamed("doc_id", "id")
    b = cosines(t).withColumn("query_id", F.floor(F.col("query_id") / 50))
    return rounded(re_.fused(re_.top(d, 20, ["query_id"], "id"), b, 1.0, 0.5), 8)


@query("q161_hash_embedding", """WITH w AS (SELECT item_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), g AS (SELECT id, substr(w, i, 2) AS g FROM (SELECT id, w, unnest(range(1, length(w))) AS i FROM w)),
b AS (SELECT id, ('0x' || substr(sha256(g), 15, 2))::INT AS bucket, count(*) AS n FROM g GROUP BY 1, 2) SELECT id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS weight FROM b""")
def _(t):
    return re_.hash_embedding(t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("q162_embedding_cache", "WITH k AS (SELECT DISTINCT sha256('len' || text) AS text_key, length(text)::DOUBLE AS v, min(doc_id) OVER (PARTITION BY text) AS d FROM documents) SELECT DISTINCT text_key, CASE WHEN d % 3 = 0 THEN -1.0 ELSE v END AS v FROM k")
def _(t):
    d = t.documents.select("doc_id", "text")
    old = d.groupBy("text").agg(F.min("doc_id").alias("d")).where("d % 3 = 0").select(F.sha2(F.concat(F.lit("len"), "text"), 256).alias("text_key"), F.lit(-1.0).alias("v"))
    return re_.cache_fill(d.select("text"), old, "len", lambda new: new.select("text_key", F.length("text").cast("double").alias("v")))


# Answers: a number of every chunk, one of few, and the beginning of the passage as words.
WORDS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
NUMBERS = r"list_distinct(regexp_extract_all(regexp_replace({x}, '[,$%]', '', 'g'), '[0-9]+(?:\.[0-9]+)?'))"
SPACED = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
RECALL = f"""{BM25}, tk AS (SELECT query_id AS q_id, doc_id, chunk_no, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, chunk_no) AS rank FROM sc QUALIFY rank <= 16),
ev AS (SELECT item_id AS q_id, text, CASE item_id % 4 WHEN 0 THEN 'about $2,018' WHEN 1 THEN item_id || '%' WHEN 2 THEN upper(substr(text, 1, 24)) END AS answer FROM benchmark),
cx AS (SELECT q_id, k, string_agg(fi.text, chr(10) ORDER BY rank) AS text FROM tk JOIN fi USING (doc_id, chunk_no) JOIN (VALUES (4), (8), (16)) AS x(k) ON rank <= k GROUP BY 1, 2),
rc AS (SELECT q_id, k, len(list_intersect({WORDS.format(x="ev.text")}, {WORDS.format(x="cx.text")})) / greatest(len({WORDS.format(x="ev.text")}), 1) AS coverage,
  CASE WHEN answer <> '' THEN CASE WHEN len({NUMBERS.format(x="answer")}) > 0 THEN len(list_intersect({NUMBERS.format(x="answer")}, {NUMBERS.format(x="cx.text")})) > 0 ELSE contains({SPACED.format(x="cx.text")}, {SPACED.format(x="answer")}) END END AS answered FROM cx JOIN ev USING (q_id))"""


@query("q163_evidence_coverage", f"WITH {RECALL} SELECT q_id, k, round(coverage, 6) AS coverage, coverage >= 0.8 AS hit, answered FROM rc")
def _(t):
    top = written(best(t, 16).select(F.col("query_id").alias("q_id"), "rank", "doc_id", "chunk_no"))
    few = F.broadcast if top.count() <= postings.SENT else lambda d: d
    found = labelled(t, t.documents.join(few(top.select("doc_id").distinct()), "doc_id", "left_semi"))  # only these documents are cut into chunks again
    top = found.select("doc_id", "chunk_no", "text").join(few(top), ["doc_id", "chunk_no"])
    kind = F.col("item_id") % 4
    answer = F.when(kind == 0, "about $2,018").when(kind == 1, F.concat(F.col("item_id").cast("string"), F.lit("%"))).when(kind == 2, F.upper(F.substring("text", 1, 24)))
    return re_.recall(t.benchmark.select(F.col("item_id").alias("q_id"), "text", answer.alias("answer")), top).withColumn("coverage", F.round("coverage", 6))


# Every third document is a flattened table of its words.
FLAT = r"""fl AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, ' ', chr(10)) ELSE text END AS text FROM documents), li AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM fl WHERE text <> ''))),
ki AS (SELECT *, trim(line) AS bare, CASE WHEN trim(line) = '' THEN 'blank' WHEN length(trim(line)) <= 60 AND regexp_matches(line, '[A-Za-z0-9]') AND NOT regexp_matches(line, '[.。;；]\s*$') AND regexp_full_match(trim(line), '[\sA-Za-z0-9$_(),.%:/×\-—–&;''"]{1,60}') THEN 'cell' ELSE 'text' END AS kind FROM li),
sg AS (SELECT *, sum((kind = 'text')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS seg FROM ki), sn AS (SELECT *, count(*) FILTER (kind = 'cell') OVER (PARTITION BY doc_id, seg) AS n, min(i) FILTER (kind = 'cell') OVER (PARTITION BY doc_id, seg) AS c0, max(seg) OVER (PARTITION BY doc_id) AS top, sum((kind = 'cell')::INT) OVER (PARTITION BY doc_id, seg ORDER BY i) - 1 AS k FROM sg),
ou AS (SELECT doc_id, seg, 0 AS a, 0.0 AS b, line FROM sn WHERE kind = 'text' UNION ALL SELECT doc_id, seg, 1, i, '' FROM sn WHERE kind = 'blank' AND (c0 IS NULL OR i < c0)
  UNION ALL SELECT doc_id, seg, 2, k // 8, '| ' || string_agg(bare, ' | ' ORDER BY i) || ' |' FROM sn WHERE kind = 'cell' AND n >= 4 GROUP BY doc_id, seg, k // 8 UNION ALL SELECT DISTINCT doc_id, seg, 3, 0.0, '' FROM sn WHERE n >= 4 OR n > 0 AND seg < top
  UNION ALL SELECT doc_id, seg, 2, k, bare FROM sn WHERE kind = 'cell' AND n < 4 UNION ALL SELECT doc_id, seg, 2, k + 0.5, '' FROM sn WHERE kind = 'cell' AND n < 4 AND k < n - 1),
jo AS (SELECT doc_id, regexp_replace(string_agg(line, chr(10) ORDER BY seg, a, b), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM ou GROUP BY 1)"""


@query("q164_flattened_tables", f"WITH {FLAT} SELECT doc_id, md5(coalesce(t, '') || CASE WHEN right(text, 1) = chr(10) AND NOT coalesce(t, '') LIKE '%' || chr(10) THEN chr(10) ELSE '' END) AS rebuilt FROM fl LEFT JOIN jo USING (doc_id)")
def _(t):
    text = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.col("text"))
    return re_.rebuilt_tables(t.documents.select("doc_id", text.alias("text"))).select("doc_id", F.md5("text").alias("rebuilt"))


MASK_CTE = []
for _i, _p in enumerate(re_.PII):
    _from = f"m{_i - 1}" if _i else "(SELECT doc_id, 0 AS hits, text FROM documents)"
    MASK_CTE.append(f"""m{_i} AS (SELECT doc_id, hits + len(ms) AS hits, CASE WHEN len(ms) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(CASE WHEN length(ms[i]) <= 5 THEN repeat('*', length(ms[i]))
  ELSE substr(ms[i], 1, 3) || repeat('*', length(ms[i]) - 5) || substr(ms[i], -2) END, '')), '') END AS text FROM (SELECT *, regexp_split_to_array(text, '{_p}') AS parts, regexp_extract_all(text, '{_p}') AS ms FROM {_from}))""")


@query("q165_pii_masking", "WITH " + ", ".join(MASK_CTE) + f" SELECT doc_id, hits, md5(text) AS masked FROM m{len(re_.PII) - 1}")
def _(t):
    return t.documents.select("doc_id", re_.masked(F.col("text")).alias("m")).select("doc_id", F.col("m.hits").cast("long").alias("hits"), F.md5("m.text").alias("masked"))


# Headers of chunks; every seventh document's are article numbers, or nearly.
VERBATIM = f"{CHUNKS}, vb AS (SELECT doc_id, chunk_no, CASE WHEN doc_id % 7 = 0 THEN CASE chunk_no % 3 WHEN 0 THEN '第十二条' WHEN 1 THEN '第三条 总则' ELSE '第五章' END ELSE header END AS header, text FROM ck)"


@query("q166_verbatim_flag", f"WITH {VERBATIM} SELECT doc_id, chunk_no, regexp_full_match(header, '第[一二三四五六七八九十百千]+条') OR length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) >= 0.04 * greatest(length(text), 1) AS verbatim FROM vb")
def _(t):
    third = F.col("chunk_no") % 3
    header = F.when(F.col("doc_id") % 7 == 0, F.when(third == 0, "第十二条").when(third == 1, "第三条 总则").otherwise("第五章")).otherwise(F.col("header"))
    return re_.chunks(md(t)).select("doc_id", "chunk_no", re_.is_verbatim(header, F.col("text")).alias("verbatim"))


FACTS = """fa AS (SELECT o_orderkey AS q_id, CASE o_orderkey % 3 WHEN 0 THEN 'free words 【d|h】' || chr(10) || o_orderpriority ELSE ' 【d' || (o_custkey % 5) || ' · h' || (o_custkey % 3) || '·x 】 fact ' || o_orderpriority || chr(10) || chr(10) || 'other' END AS text FROM orders),
fl AS (SELECT q_id, unnest(range(len(l)))::INT AS line_no, unnest(l) AS line FROM (SELECT q_id, string_split(text, chr(10)) AS l FROM fa)), fp AS (SELECT q_id, line_no, line, regexp_extract(trim(line), '^【([^【】]+)】', 1) AS inside FROM fl)"""


def facts(t):
    c = F.col("o_custkey")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("free words 【d|h】\n"), "o_orderpriority")).otherwise(F.concat(F.lit(" 【d"), (c % 5).cast("string"), F.lit(" · h"), (c % 3).cast("string"), F.lit("·x 】 fact "), "o_orderpriority", F.lit("\n\nother")))
    return t.orders.select(F.col("o_orderkey").alias("q_id"), text.alias("text"))


@query("q167_fact_lines", f"WITH {FACTS} SELECT q_id, line_no, CASE WHEN contains(inside, '·') THEN trim(split_part(inside, '·', 1)) END AS doc_id, CASE WHEN contains(inside, '·') THEN trim(substr(inside, instr(inside, '·') + 1)) END AS header, length(line) AS chars FROM fp")
def _(t):
    return re_.fact_lines(facts(t))


DIGIT = "CASE {x} WHEN 0 THEN '一' WHEN 1 THEN '二' ELSE '三十' END"
REPLY = f"""rp AS (SELECT o_orderkey AS q_id, '依据【d' || (o_custkey % 5) || ' · 第 ' || {DIGIT.format(x="o_custkey % 3")} || ' 条】 and ' || (o_custkey % 4) || '.1 but 【x】, 第' || {DIGIT.format(x="(o_custkey + 1) % 3")} || '条 and 12.50, see ' || o_orderpriority AS reply FROM orders),
ro AS (SELECT q_id, reply, regexp_replace(reply, '【[^【】]+】', ' ', 'g') AS outside FROM rp), ci AS (SELECT q_id, list_concat(list_concat(regexp_extract_all(reply, '【([^【】]+)】', 1), regexp_extract_all(outside, '第[一二三四五六七八九十百千]+条')), regexp_extract_all(outside, '[0-9]+[.][0-9]+')) AS cs FROM ro)"""


def _numeral(x):
    return F.when(x == 0, "一").when(x == 1, "二").otherwise("三十")


def replies(t):
    c = F.col("o_custkey")
    parts = [F.lit("依据【d"), (c % 5).cast("string"), F.lit(" · 第 "), _numeral(c % 3), F.lit(" 条】 and "), (c % 4).cast("string"), F.lit(".1 but 【x】, 第"), _numeral((c + 1) % 3), F.lit("条 and 12.50, see "), F.col("o_orderpriority")]
    return t.orders.select(F.col("o_orderkey").alias("q_id"), F.concat(*parts).alias("reply"))


@query("q168_citation_extract", f"WITH {REPLY} SELECT q_id, array_to_string(cs, ';') AS citations FROM ci")
def _(t):
    return replies(t).select("q_id", F.array_join(re_.citations(F.col("reply")), ";").alias("citations"))


UNITS = f"""un AS (SELECT o_orderkey AS q_id, r AS rank, 'd' || (o_custkey + r) % 5 AS doc_id, CASE r WHEN 1 THEN '第' || {DIGIT.format(x="o_orderkey % 3")} || '条' WHEN 3 THEN (o_orderkey % 4) || '.1 scope' WHEN 4 THEN '第' || {DIGIT.format(x="o_custkey % 3")} || '条 总则' ELSE '' END AS header, 10 * r AS chars
  FROM orders, (VALUES (1), (2), (3), (4), (5)) AS x(r))"""
USED = f"""{REPLY}, cc AS (SELECT DISTINCT q_id, replace(replace(unnest(cs), ' ', ''), '　', '') AS cite FROM ci), cd AS (SELECT q_id, CASE WHEN contains(cite, '·') THEN split_part(cite, '·', 1) END AS doc, CASE WHEN contains(cite, '·') THEN substr(cite, instr(cite, '·') + 1) ELSE cite END AS head FROM cc),
us AS (SELECT DISTINCT un.q_id, rank, doc_id, header FROM un JOIN cd USING (q_id) WHERE head <> '' AND (doc IS NULL OR contains(doc, doc_id)) AND (starts_with(replace(header, ' ', ''), head) OR starts_with(head, replace(header, ' ', ''))))"""


def units(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("rank"))
    article = lambda x, end: F.concat(F.lit("第"), _numeral(x % 3), F.lit(end))
    head = F.when(F.col("rank") == 1, article(F.col("o_orderkey"), "条")).when(F.col("rank") == 3, F.concat((F.col("o_orderkey") % 4).cast("string"), F.lit(".1 scope"))).when(F.col("rank") == 4, article(F.col("o_custkey"), "条 总则")).otherwise("")
    return o.select(F.col("o_orderkey").alias("q_id"), "rank", F.concat(F.lit("d"), ((F.col("o_custkey") + F.col("rank")) % 5).cast("string")).alias("doc_id"), head.alias("header"), (10 * F.col("rank")).alias("chars"))


def used(t):
    c = replies(t).select("q_id", F.explode(re_.citations(F.col("reply"))).alias("citation"))
    return re_.match_citations(c, units(t))


@query("q169_citation_match", f"WITH {UNITS}, {USED} SELECT * FROM us")
def _(t):
    return used(t)


@query("q170_usage_statistics", f"WITH {UNITS}, {USED}, j AS (SELECT un.rank, chars, us.rank IS NOT NULL AS u FROM un LEFT JOIN us USING (q_id, rank)) SELECT rank, count(*) AS fed, count(*) FILTER (u) AS used, coalesce(sum(chars) FILTER (NOT u), 0)::BIGINT AS wasted, sum(chars)::BIGINT AS chars, round(count(*) FILTER (u) / count(*), 6) AS rate FROM j GROUP BY ROLLUP (rank)")
def _(t):
    return re_.usage(units(t), used(t)).drop("wasted_share").withColumn("rate", F.round("rate", 6))


@query("q171_citation_coverage", "SELECT o_orderkey AS q_id, round(CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.5 END, 6)::DOUBLE AS coverage, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '77.25' END AS lacking FROM orders")
def _(t):
    k = (F.col("o_orderkey") + 1000).cast("string")
    rows = t.orders.select(F.col("o_orderkey").alias("q_id"), F.concat(F.lit("total "), k, F.when(F.col("o_orderkey") % 2 == 0, " in 3").otherwise(" or 77.25 in 3")).alias("answer"), F.concat(F.lit("we saw "), k).alias("cited"))
    return re_.citation_coverage(rows).withColumn("coverage", F.round("coverage", 6))


@query("q172_option_assembly", "SELECT o_orderkey AS q_id, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'A' END, CASE WHEN o_orderkey % 3 = 0 THEN 'B' END) AS multi, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN 'A' WHEN o_orderkey % 3 = 0 THEN 'B' ELSE '' END AS single FROM orders")
def _(t):
    v = t.orders.select(F.col("o_orderkey").alias("q_id"), F.explode(F.array(*[F.struct(F.lit(l).alias("letter"), F.when(F.col("o_orderkey") % m == 0, "verdict: false. VERDICT: TRUE").otherwise("VERDICT: TRUE no, VERDICT: false").alias("reply")) for l, m in (("A", 2), ("B", 3))])).alias("x"))
    return re_.assembled(v.select("q_id", "x.*"))


@query("q173_option_queries", "SELECT o_orderkey AS q_id, i AS query_no, 'q' || o_custkey || CASE i WHEN 0 THEN ' yes' ELSE ' no' END AS text FROM orders, (VALUES (0), (1)) AS x(i) WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 0, 'q' || o_custkey FROM orders WHERE o_orderkey % 4 = 0")
def _(t):
    q = t.orders.select(F.col("o_orderkey").alias("q_id"), F.concat(F.lit("q"), F.col("o_custkey").cast("string")).alias("question"), F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.lit("yes")).alias("options"), F.when(F.col("o_orderkey") % 4 == 0, "tf").otherwise("mcq").alias("kind"))
    return re_.option_queries(q)


ANSWERS = "an AS (SELECT o_orderkey AS q_id, CASE o_custkey % 4 WHEN 0 THEN 'b, a + B' WHEN 1 THEN 'C' WHEN 2 THEN NULL ELSE 'zzz' END AS answer, o_orderkey % 2 = 0 AS one FROM orders), no AS (SELECT q_id, CASE WHEN answer LIKE 'b%' THEN CASE WHEN one THEN 'B' ELSE 'AB' END WHEN answer = 'C' THEN 'C' ELSE '' END AS answer FROM an)"


def normalised(t):
    m = F.col("o_custkey") % 4
    a = F.when(m == 0, "b, a + B").when(m == 1, "C").when(m == 3, "zzz")
    return t.orders.select(F.col("o_orderkey").alias("q_id"), re_.normalized_answer(a, F.col("o_orderkey") % 2 == 0).alias("answer"), "o_custkey", "o_orderpriority")


@query("q174_answer_normalise", f"WITH {ANSWERS} SELECT * FROM no")
def _(t):
    return normalised(t).select("q_id", "answer")


RESULTS = "rs AS (SELECT o_orderkey AS q_id, o_orderpriority AS domain, o_custkey % 4 = 1 AS correct, o_custkey % 100 AS tokens FROM orders)"


def results(t):
    return t.orders.select(F.col("o_orderkey").alias("q_id"), F.col("o_orderpriority").alias("domain"), (F.col("o_custkey") % 4 == 1).alias("correct"), (F.col("o_custkey") % 100).alias("tokens"))


@query("q175_score_report", f"WITH {RESULTS} SELECT domain, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, sum(tokens)::BIGINT AS tokens, round(100 * avg(correct::INT) * (0.7 + 0.3 * greatest(0.0, least(1.0, 1 - sum(tokens) / 500000.0))), 4) AS final FROM rs GROUP BY ROLLUP (domain)")
def _(t):
    return re_.score_report(results(t), 500_000).withColumn("accuracy", F.round("accuracy", 6)).withColumn("final", F.round("final", 4))


@query("q176_paired_runs", f"WITH {RESULTS}, b AS (SELECT q_id, correct <> (q_id % 10 = 0) AS y, tokens + q_id % 3 AS t FROM rs) SELECT count(*) AS n, count(*) FILTER (correct AND NOT y) AS a_better, count(*) FILTER (NOT correct AND y) AS b_better, count(*) FILTER (NOT correct AND NOT y) AS both_wrong, sum(t - tokens)::BIGINT AS token_difference FROM rs JOIN b USING (q_id)")
def _(t):
    a = results(t)
    b = a.withColumn("correct", F.col("correct") != (F.col("q_id") % 10 == 0)).withColumn("tokens", F.col("tokens") + F.col("q_id") % 3)
    return re_.paired_runs(a, b)


@query("q177_evidence_export", f"""WITH {UNITS}, {USED} SELECT q_id, '[' || string_agg('{{"rank":' || rank || ',"doc_id":"' || doc_id || '","header":"' || header || '","quote":"text of ' || doc_id || '"}}', ',' ORDER BY rank, doc_id) || ']' AS evidence FROM us WHERE header = '' GROUP BY 1""")
def _(t):
    c = units(t).select("doc_id").distinct().select("doc_id", F.lit("").alias("header"), F.concat(F.lit("text of "), "doc_id").alias("text"))
    return re_.evidence_export(used(t).where("header = ''"), c)
