"""The pipeline over a small table with clashing columns, against plain versions of its rules."""

import hashlib
import random

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from plumbline.llm import mixing, piece_bpe, toxicity
from tests.llm.test_llm_text import compared, frame, without_later_runs


def test_stages_in_their_order(spark, tmp_path):
    r = random.Random(17)
    word = lambda: f"{r.choice('abcdefgh')}{r.randrange(3000)}"
    passage = " ".join(word() for _ in range(60))
    bad = ["vile", "scum", "filth", "wretch"]
    rows = []
    for i in range(120):
        words = [word() for _ in range(70)]
        if i % 4 == 0:
            for _ in range(20):
                words[r.randrange(70)] = r.choice(bad)
        lines = [" ".join(words)]
        if i % 5 == 1:
            lines.insert(0, passage)
        rows.append((i, "\n".join(lines), f"s{i % 3}" if i % 2 else "hot"))
    for i in range(30):  # near and exact copies
        words = rows[i][1].split(" ")
        if i % 2:
            words[3] = "changed"
        rows.append((200 + i, " ".join(words), "s1"))
    rows += [(300, None, None), (301, "", "s2")]
    docs = frame(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("toxic_score", "gone_id", "mix_source", "lines_own", "mix_pass", "Mix_Key", "lines_runs", "mix_block", "mix_pass_")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = frame(spark, rows).where("doc_id < 200").select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        assert {tuple(r) for r in found.select(*[c for c in docs.columns if c.lower().split("_")[0] in ("toxic", "gone", "mix", "lines")]).distinct().collect()} == {(1,) * 9}, name

    model = toxicity.fit(docs, labels)
    left = [(i, t, s) for i, t, s in rows if model.score(t) < 0.5]
    assert not {i for i, _, _ in left} & set(range(0, 120, 4)) and {i for i, _, _ in left} >= {i for i in range(120) if i % 4}
    cut = without_later_runs([(i, t) for i, t, _ in left if t is not None]) | {i: None for i, t, _ in left if t is None}
    left = [(i, cut[i], s) for i, t, s in left if cut[i] == t or cut[i].split()]
    groups = compared([(i, t) for i, t, _ in left], 80)
    left = [(i, t, s) for i, t, s in left if groups[i] == i]
    times = {(x["source"]): (x["whole"], x["cut"]) for x in mixing.plan(mixing.counted(frame(spark, left))).collect()}
    last = lambda i, s: times[s][1] is not None and hashlib.md5(f"7:{times[s][0] + 1}:{i}".encode()).hexdigest() <= times[s][1]
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())
    want = []
    for i, t, s in left:
        ids = sp.encode(t or "")
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        want += [row] * (times[s][0] + last(i, s))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({x[0] for x in want}) == len(left)
