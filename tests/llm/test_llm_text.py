"""Text operators against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from evenhand.llm import blocks, chunk_bpe, ngram_trie
from evenhand.llm.chunk_bpe import Chunks, Encoder, assemble, decode, encode, repaired
from evenhand.llm.language import fit_profiles, held_out, predict, rank_texts
from evenhand.llm.mixing import mix
from evenhand.llm.ngram_trie import Sets, Trie, linked, near_classes
from evenhand.llm.queries import vocabulary
from evenhand.llm.substring import remove_repeats, repeated_spans
from evenhand.llm.words import split_words

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id bigint, text string"


def words(text):
    return WORD.findall(text or "")


# --- plain versions ------------------------------------------------------------------------------

def plain_repeats(docs, k):
    """doc_id, kept words and removed count for (id, text) rows."""
    low = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            first[key] = min(first.get(key, (low(i), p)), (low(i), p))
    out = []
    for i, t in docs:
        w = words(t)
        dead = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < (low(i), p):
                dead |= set(range(p, p + k))
        out.append((i, len(w), len(dead), " ".join(x for p, x in enumerate(w) if p not in dead)))
    return out


def plain_sets(text, k=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def plain_near(docs, k=5, num=75, den=100):
    sets = {i: plain_sets(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, n, size, vocab=400, edits=6):
    """Texts that are edits of a few others: linked, nearly linked and unrelated ones."""
    bases = [[f"w{rng.randrange(vocab)}" for _ in range(size)] for _ in range(4)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


# --- words ---------------------------------------------------------------------------------------

def test_words_split_on_six_bytes_only():
    texts = ["a b\tc\nd\x0be\x0cf\rg", "no break em\x1cfs\x85nel", "", None, "  lead trail  ", "é ß"]
    w = split_words([None if t is None else t.encode() for t in texts])
    got = [[w.buf[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]


def test_equal_windows_hash_alike_and_others_do_not():
    w = split_words([b"q a b c d", b"a b c", b"ab c a b c"])
    at = w.windows(3)
    seen = {}
    for h, i in zip(w.window_hashes(at, 3).tolist(), at.tolist()):
        seen.setdefault(b" ".join(w.buf[a:b].tobytes() for a, b in zip(w.start[i : i + 3], w.end[i : i + 3])), set()).add(h)
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)


def test_sketch_never_underestimates():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    parts = [rng.choice(keys, 1500, replace=False) for _ in range(4)]
    true = Counter(x for p in parts for x in p.tolist())
    tables = [blocks.report(b, p, 3) for b, p in enumerate(parts)]
    total = {}
    for t in tables:
        for s, r, c in zip(t["shard"].to_pylist(), t["row"].to_pylist(), t["cells"].to_pylist()):
            np.add.at(total.setdefault((s, r), np.zeros(blocks.WIDTH, int)), blocks.unpack(c), 1)
    for p, t in zip(parts, tables):
        replies = []
        for s, r, c in zip(t["shard"].to_pylist(), t["row"].to_pylist(), t["cells"].to_pylist()):
            n = total[s, r][blocks.unpack(c)]
            replies.append((r, s, np.packbits(n > 1).tobytes(), n[n > 1].astype(np.uint16).tobytes()))
        est = blocks.estimates(p, 3, replies, True)
        assert all(e >= true[k] for e, k in zip(est.tolist(), p.tolist()))


# --- substring dedup ------------------------------------------------------------------------------

@pytest.mark.parametrize("window,vocab", [(3, 6), (20, 400)])
def test_repeats_match_plain(spark, window, vocab):
    rng = random.Random(window)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(vocab)}" for _ in range(rng.randrange(80))]
        if rng.random() < 0.5:
            w.insert(rng.randrange(len(w) + 1), passage)
        docs.append((rng.randrange(10**6), rng.choice([" ", "\n", "  ", "\t\x0b"]).join(w)))
    docs += [(5, None), (6, ""), (7, " \n "), (None, passage), (8, passage + " " + passage), (9, passage), (9, passage), (-3, passage), (10, "long " * 5000)]
    got = repeated_spans(spark.createDataFrame(docs, DOCS).repartition(5), window).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(plain_repeats(docs, window), key=key)


def test_repeats_keep_columns_and_untouched_texts(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, "as  it\tis ", "b", 1), (2, passage, "b", 2), (3, f"x {passage}\ty", None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, block string, n_words int")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == ["as  it\tis ", passage, "x y"]
    assert got[3]["block"] is None and got[3]["n_words"] == 3 and remove_repeats(df).columns == df.columns
    assert remove_repeats(df.limit(0)).collect() == []


# --- n-gram join ----------------------------------------------------------------------------------

@pytest.mark.parametrize("hide", [False, True])
def test_trie_finds_what_all_pairs_find(hide):
    rng = random.Random(3)
    for _ in range(20):
        pool = [sorted(rng.sample(range(60), rng.randrange(5, 30))) for _ in range(5)]
        sets, sizes, beyond = [], [], []
        for _ in range(25):
            s = sorted(set(rng.choice(pool)) ^ set(rng.sample(range(60), rng.randrange(4))))
            show = rng.randrange(1, len(s) + 1) if hide else len(s)
            sets.append(np.array(s[:show])), sizes.append(len(s)), beyond.append(len(s) - show)
            if not hide:
                sizes[-1] += rng.randrange(3)  # tokens that no other set has
        full = [set(s.tolist()) for s in sets]
        parent = list(range(25))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in Trie(sets, sizes, (75, 100), beyond).joins(list(range(25)), 60):
            parent[max(root(i), root(j))] = min(root(i), root(j))
        for i in range(25):
            for j in range(i):
                if linked(len(full[i] & full[j]), sizes[i], sizes[j], (75, 100)):
                    assert root(i) == root(j)
        if not hide:
            comp = {i: root(i) for i in range(25)}
            true = list(range(25))
            for _ in range(25):
                for i in range(25):
                    for j in range(25):
                        if linked(len(full[i] & full[j]), sizes[i], sizes[j], (75, 100)):
                            true[i] = true[j] = min(true[i], true[j])
            assert all((comp[i] == comp[j]) == (true[i] == true[j]) for i in range(25) for j in range(25))


@pytest.mark.parametrize("chunk", [64, 4])
def test_near_classes_match_plain(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_trie, "CHUNK", chunk)
    rng = random.Random(5)
    texts = family(rng, 45, 40, edits=9) + family(rng, 25, 12, edits=3) + ["one two", "One TWO", "one", "", None, " \t", "a b c d e", "a b c d e f", "É x", "é x"]
    texts += [texts[3]] * 4 + ["z " * 3000]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in near_classes(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert got == plain_near(docs)


def test_near_classes_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (None, None)], DOCS)
    got = sorted(((r["id"], r["n_shingles"], r["component"]) for r in near_classes(df).collect()), key=str)
    assert got == sorted([(None, 2, None), (4, 2, None), (4, 2, None), (9, 0, 9), (None, 0, None)], key=str)
    assert near_classes(df.limit(0)).collect() == []


def test_fingerprints_do_not_see_order_or_repeats():
    s = Sets([b"a b c d e f a b c d e", b"A b c d e f a b c d e a b c d e f", b"b a"], 5)
    p, q = s.prints()
    assert s.sizes.tolist() == [len(plain_sets("a b c d e f a b c d e")), len(plain_sets("a b c d e f a b c d e a b c d e f")), 1]
    assert (p[0] == p[1]) == (plain_sets("a b c d e f a b c d e") == plain_sets("a b c d e f a b c d e a b c d e f"))


# --- mixing ---------------------------------------------------------------------------------------

def test_mix_shares_and_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", "é", None]), "w " * rng.randrange(30)) for i in range(400)] + [(900, "tiny", "one two"), (901, "none", ""), (902, "none", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df.repartition(7)).collect()), key=str)
    size = {}
    for i, s, t in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped = set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not more:
            break
        capped |= more
    for s in order:
        mine = [r for r in got if r["source"] == s]
        target = 3 * size[s] if s in capped else level * weight[s]
        assert mine[0]["target"] == pytest.approx(target) and mine[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in mine) - target) <= max([r["size"] for r in mine]) / 2 + 1e-9
        assert {r["copies"] for r in mine if r["size"]} <= {int(target // size[s]) + x for x in (0, 1)} if size[s] else True
    assert all(r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)


def test_mix_prefers_good_documents_and_takes_empty_tables(spark):
    rows = [(i, "a" if i < 200 else "b", "w " * 10) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    quality = spark.createDataFrame([(i, 50.0 if i % 2 else 0.02) for i in range(400)] + [(3, None), (7, float("nan"))], "id bigint, weight double")
    taken = [(r["id"], r["copies"]) for r in mix(df, quality=quality).filter("source = 'b'").collect()]
    good, poor = (sum(c for i, c in taken if i % 2 == x) for x in (1, 0))
    assert good > 5 * poor and mix(df.limit(0)).collect() == []


# --- language -------------------------------------------------------------------------------------

def plain_grams(text):
    t = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    out = Counter(c for c in t if c != " ")
    if not out:
        return out
    out.update(t[i : i + 2] for i in range(len(t) - 1))
    out.update(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " ")
    return out


def ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:top]]


LANGS = {"aa": "the cat sat on the mat and the dog ran", "bb": "der hund und die katze über größe ßx", "cc": "αβγ δεζ ηθι κλμ"}


def test_profiles_and_distances_match_plain(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(LANGS[x].split(), k=20)) + rng.choice(["", "!", " 12"]), x) for i in range(60) for x in [rng.choice(list(LANGS))]]
    rows += [(100, None, "aa"), (101, "zz zz", None), (102, "", "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    top = 30
    profiles = fit_profiles(df, top=top)
    for x in LANGS:
        assert profiles[x] == ranked(sum((plain_grams(t) for _, t, lang in rows if lang == x), Counter()), top)
    texts = [t for _, t, _ in rows] + ["...", "日本語 text", "İstanbul", "a" * 50_000]
    dist, size = rank_texts(texts, profiles, top)
    for t, d, n in zip(texts, dist, size):
        mine = ranked(plain_grams(t), top)
        assert n == len(mine)
        for j, x in enumerate(profiles):
            place = {g: k for k, g in enumerate(profiles[x])}
            assert d[j] == sum(abs(place[g] - k) if g in place else top for k, g in enumerate(mine))


def test_predictions_and_undetermined(spark):
    rows = [(i, t, x) for i, (x, t) in enumerate(LANGS.items())] + [(7, None, None), (8, "123 !", "aa"), (9, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string")
    profiles = fit_profiles(df, lang_col="lang_pred")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(df, profiles, keep=["doc_id"]).collect()}
    assert [got[i][0] for i in range(3)] == list(LANGS) and all(got[i] == ("und", 0.0) for i in (7, 8, 9))
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in predict(df, {}, keep=["doc_id"]).collect()} == {"und"}
    assert predict(df.limit(0), profiles, keep=["doc_id"]).collect() == [] and fit_profiles(df.limit(0)) == {} if "lang" in df.columns else True
    import zlib

    folds = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert [r["h"] for r in folds] == [zlib.crc32(str(r["id"]).encode()) % 5 == 0 for r in folds]


# --- BPE ------------------------------------------------------------------------------------------

def odd_texts():
    rng = random.Random(9)
    shared = " ".join(f"common{rng.randrange(50)} text" for _ in range(1200))
    texts = [None, "", "  ", "a", "it's 12 don't", "x" * 9000, "é <|endoftext|>b<|startoftext|>c", "İΣ ÇA \x1cz q", "日本 語　文", shared]
    return texts + [f"{i} {shared}{i} tail {rng.random()}" for i in range(6)] + [shared.replace(" ", "") * 2, shared.replace(" ", "\n")]


def test_encoding_and_decoding_match_the_library(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], DOCS).repartition(4)
    tok = Encoder.get(vocabulary()).tok
    got = decode(encode(df, vocabulary()), vocabulary()).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = tok.encode(texts[r["id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == tok.decode(ids, skip_special_tokens=False)
    one = {r["id"]: r for r in encode(df, vocabulary(), digests=True).collect()}
    for r in got:
        assert one[r["id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert one[r["id"]]["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert encode(df.limit(0), vocabulary()).collect() == []


def shuffled(spark):
    """Bytes written to shuffles, by stage; old stages are forgotten in long sessions."""
    none, store = spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, none, None)
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_texts_move_once(spark):
    rng = random.Random(4)
    passage = " ".join(str(rng.random()) for _ in range(600))
    texts = [" ".join(str(rng.random()) for _ in range(1000)) + passage * (i % 8 == 0) for i in range(120)] + ["", None]
    packed = sum(len(zstandard.compress((t or "").encode())) for t in texts)
    before = max(shuffled(spark), default=-1)
    got = encode(spark.createDataFrame(list(enumerate(texts)), DOCS), vocabulary()).collect()
    assert {r["id"]: r["ids"] for r in got} == dict(enumerate(Encoder.get(vocabulary()).plain([(t or "").encode() for t in texts])))
    assert 0.9 * packed < sum(n for s, n in shuffled(spark).items() if s > before) < 1.5 * packed


def test_chunks_follow_content_and_pieces_agree():
    texts = [(t or "").encode() for t in odd_texts()]
    ch = Chunks(texts)
    for t, a, b in zip(texts, ch.first[:-1], ch.first[1:]):
        assert (ch.bytes_of(a, b) if b > a else b"") == t
    shared = [{tuple(k) for k in zip(ch.keys[0][a:b], ch.keys[1][a:b])} for a, b in zip(ch.first[10:15], ch.first[11:16])]
    assert len(set.intersection(*shared)) > 3  # the same passage gives the same chunks at other places
    enc = Encoder.get(vocabulary())
    pieces = [[(t[i : i + 7], None) for i in range(0, len(t), 7)] for t in texts[:10]]  # cuts inside words
    assert assemble(pieces, enc) == enc.plain(texts[:10])


def test_repair_grows_until_it_agrees(monkeypatch):
    enc = Encoder.get(vocabulary())
    plan = [([b"alpha", b"beta"] * 5, None, False), ([b"joined"], None, True), ([b"gamma"] * 9, None, False)]
    whole = b" ".join(w for part, _, _ in plan for w in part)
    assert repaired(plan, enc) == enc.plain([whole])[0]
    asked = []
    real = enc.plain
    monkeypatch.setattr(enc, "plain", lambda t: asked.append(t) or [[*x, 0] if len(asked) == 2 else x for x in real(t)])
    assert repaired(plan, enc) == real([whole])[0] and len(asked) > 4


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "MEMO", 10)
    enc = Encoder(vocabulary())
    for k in range(5):
        batch = {b"w%d" % i for i in range(k * 8, k * 8 + 12)}
        enc.learn(batch)
        assert enc.ids(sorted(batch)) == [x for ids in enc.plain(sorted(batch)) for x in ids]
    assert len(enc.memo) + len(enc.old) <= 2 * (10 + 12)


@pytest.mark.parametrize("carry", [False, True])
@pytest.mark.parametrize("ident", [7, None])
def test_mix_cuts_between_repeated_rows(spark, ident, carry):
    """A budget that ends within the repeats of one row takes as many of them as fit."""
    rows = [(ident, "a", "one two three")] * 60 + [(i, "b", "w " * 10) for i in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = mix(df, carry=carry).collect()
    assert len(got) == 90
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= mine[0]["size"] / 2
    assert len({r["copies"] for r in got if r["source"] == "b"}) == 2
