"""The pipeline against plain Python, stage by stage, on a small corpus."""

import hashlib
import math
import random
from collections import Counter

import corpus_pipeline
from test_llm_text import plain_near, plain_repeats, words

from evenhand.llm.chunk_bpe import Encoder
from evenhand.llm.queries import vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(11)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = []
    for i in range(120):
        body = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 90))]
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body)), passage)
        rows.append((i, " ".join(body), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", None]), 0))
    for k in range(20):  # exact and near copies
        i, text, lang, source, _ = rng.choice(rows[:120])
        rows.append((200 + k, text if k % 2 else text + " tail", lang, source, 0))
    rows += [(300, None, None, "b", 0), (301, "12 !!", "en", "b", 0), (302, "", "en", None, 0), rows[7]]
    rng.shuffle(rows)
    return rows


def plain_mix(docs, labels):
    """Copies per row index."""
    size = [len(words(t)) for _, t, _, _, _ in docs]
    by = Counter()
    for n, d in zip(size, docs):
        by[d[3]] += n
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        level = (sum(by.values()) - sum(3 * by[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * by[s]}
        if not more:
            break
        capped |= more
    copies = [0] * len(docs)
    for s in order:
        target = 3 * by[s] if s in capped else level * weight[s]
        mine, keys = [k for k, d in enumerate(docs) if d[3] == s], {}
        whole = math.floor(target / by[s]) if by[s] else 0
        for k in mine:
            u = (int(hashlib.md5(f"{docs[k][0]}:10".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            keys[k] = (-math.log(u) / labels.get(docs[k][0], 1.0), docs[k][0], size[k])
        end, budget = 0, target - whole * by[s]
        for k in sorted(mine, key=keys.get):
            end += size[k]
            copies[k] = whole + (budget > 0 and end - size[k] / 2 <= budget)
    return copies


def test_pipeline_matches_plain(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, 0) for i in range(0, 120, 3)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    near = plain_near([(d[0], d[1]) for d in docs])
    docs = [d for d in dict.fromkeys(docs) if near[d[0]][1] == d[0]]
    cut = {i: kept for i, _, gone, kept in plain_repeats([(d[0], d[1]) for d in docs], 20) if gone}
    docs = [(d[0], cut.get(d[0], d[1]), *d[2:]) for d in docs]
    copies = plain_mix(docs, {i: 0.5 + 1.5 * q for i, q, _ in labels})
    enc, want = Encoder.get(vocabulary()), Counter()
    for d, n in zip(docs, copies):
        ids = tuple(enc.plain([d[1].encode()])[0])
        want[d[0], d[3], len(ids), ids] += n
    assert got == +want and sum(copies) > 0


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).collect() == []
