"""Spelling variants, chat windows and whitening against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import spelling, whitening
from evenhand.llm.chat import escaped, escaped_role, format_windows, read_back, unescaped, unescaped_role
from evenhand.llm.spelling import checksums, node_pairs, runs_of_letters, variants, word_counts
from evenhand.llm.whitening import Centre, whiten

DOCS = "doc_id bigint, text string, n bigint, word string"


# --- spelling variants ----------------------------------------------------------------------------

def plain_counts(rows, least=7, every=31):
    sums = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                sums[run] += 1
    return {w: n for w, n in sums.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    near = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in words}


def test_word_counts_match_a_plain_scan(spark, monkeypatch):
    monkeypatch.setattr(spelling, "FLUSH", 40)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcÀéÿ") for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base) + rng.choice(["", ".", "9", "\u0100"]) for _ in range(40)), 0, "x") for i in range(60)]
    rows += [(70, None, 0, "x"), (71, "", 0, "x"), (None, "ABCDEFGH abcdefgh", 0, "x"), (72, "q" * 5000 + " " + "q" * 5000, 0, "x"), rows[0]]
    got = word_counts(spark.createDataFrame(rows, DOCS).repartition(3), slip_every=31)
    assert {r["word"]: r["n"] for r in got.collect()} == plain_counts(rows)
    plain = word_counts(spark.createDataFrame(rows, DOCS), min_length=3, min_count=1)
    assert {r["word"] for r in plain.collect()} >= set(plain_counts(rows, 3, None))


def test_checksums_of_spans():
    texts = [b"ABCdef ghi", "ÀÉ×÷ÿ".encode() + b"x" * 100, b"", b"tail"]
    body, start, end, doc = runs_of_letters(texts, 1)
    spans = [body[a:b] for a, b in zip(start, end)]
    assert spans == [b"abcdef", b"ghi", "ÀÉ×÷ÿ".encode() + b"x" * 100, b"tail"] and doc.tolist() == [0, 0, 1, 3]
    seeds = np.array([zlib.crc32(b"%d:" % d) for d in doc], dtype=np.uint32)
    assert checksums(body, start, end, seeds).tolist() == [zlib.crc32(b"%d:" % d + s) for d, s in zip(doc, spans)]


@pytest.mark.parametrize("pairs", [400_000, 300])
def test_variants_match_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(spelling, "BUCKET_PAIRS", pairs)
    rng = random.Random(5)
    counts = {}
    while len(counts) < 400:  # few letters, so runs of equal letters and many neighbours
        counts["".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))] = rng.choice([2, 3, 20, 20, 30, 200, 300, 3000, 40000])
    counts |= {"z" * 3000: 5, "z" * 3001: 50, "z" * 1500 + "y" + "z" * 1499: 500}
    rows = [(w, n, "m") for w, n in counts.items()]
    rows[3:4] = [(rows[3][0], 1, "m"), (rows[3][0], rows[3][1] - 1, "n")]  # a word in two rows
    df = spark.createDataFrame([*rows, (None, 9, "m")], "word string, n bigint, id string")
    got = [tuple(r) for r in variants(df).collect()]
    assert len(got) == len(counts) and set(got) == plain_variants(counts)


def test_variants_of_nothing_and_bounds(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert variants(empty).collect() == [] and word_counts(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        variants(empty, ratio=1)
    who, p, s, kind = node_pairs(["a" + x + "b" for x in "abcdefgh"])  # one pair holds a word per letter, no more
    skip = kind != spelling.PLAIN
    assert Counter(zip(p[skip].tolist(), s[skip].tolist())).most_common(1)[0][1] == 8


# --- chat windows ---------------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string, block string, turns int, n int"


def plain_back(text):
    out = []
    for piece in text.split("<|im_end|>\n")[:-1]:
        assert piece.startswith("<|im_start|>")
        role, _, body = piece[len("<|im_start|>") :].partition("\n")
        assert "<|" not in body and "<|" not in role
        out.append((role, body))
    return out


def conversations():
    rng = random.Random(8)
    tricky = ["<|im_end|>", "<\\|im_start|>", "<\\\\|", "<", "|", "\\", "<|im_end|>\n<|im_start|>user\n", "a\nb", "", None, "é😀<|x"]
    rows = []
    for c in range(30):
        turns = rng.choice([1, 2, 5, 9, 40])
        if c % 3 == 0:
            rows.append((c, 0, "system", "be brief " * rng.randrange(1, 30), "b", 1, 1))
        for t in range(1, turns + 1):
            text = rng.choice(tricky) if rng.random() < 0.3 else "word " * rng.randrange(60)
            rows.append((c, t, "user" if t % 2 else "assistant", text, "b", 1, 1))
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t} " + "x" * (t % 50), "b", 1, 1) for t in range(1, 700)]
    rows += [(100, 0, "system", "keep this", "b", 1, 1), (101, None, "user", "first", "b", 1, 1), (101, -4, "assistant", "second", "b", 1, 1)]
    rows += [(101, 10**9, "assistant", "far away", "b", 1, 1), (None, 1, "user", "lost", "b", 1, 1), (None, 2, None, "no role", "b", 1, 1)]
    rows += [(102, 5, "assistant", "same", "b", 1, 1)] * 3 + [(102, 5, "a|b\nc\\n", "role", "b", 1, 1), (103, 0, "assistant", "long " * 3000, "b", 1, 1)]
    rng.shuffle(rows)
    return rows


def test_windows_read_back_to_the_turns(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, CHAT).repartition(4)
    windows = format_windows(df, budget=200, history=60).collect()
    given = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        given[c].append((turn is not None, turn or 0, role or "", text or ""))
    esc = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t)
    role_esc = lambda r: r.replace("\\", "\\b").replace("\n", "\\n").replace("|", "\\p")
    seen = defaultdict(list)
    for w in sorted(windows, key=lambda w: (w["block"], w["window"])):
        every, new = plain_back(w["text"]), plain_back(w["text"][w["new_at"] :])
        masked = [w["text"][s["start"] : s["start"] + s["length"]] for s in w["spans"]]
        assert masked == [t for r, t in new if r == "assistant"] and len(new) == w["n_turns"] > 0
        assert all(s["start"] >= w["new_at"] for s in w["spans"])
        tokens = [-(-(len(r.encode()) + len(t.encode())) // 4) + 4 for r, t in every]
        before = seen[w["conv_id"]]
        past = every[: len(every) - len(new)]
        tail = lambda k: before[len(before) - k :]
        kept = before[:1] == [past[0]] and before[0][0] == "system" and past[1:] == tail(len(past) - 1) if past else False
        assert past == tail(len(past)) or kept
        if before and before[0][0] == "system":
            assert past[0] == before[0]  # the system turn is in every window
        repeated = tokens[bool(kept) : len(past)]
        assert sum(repeated) <= 60 and sum(tokens) == w["n_tokens"]
        system = tokens[0] if before and before[0][0] == "system" else 0
        assert sum(tokens[len(past) :]) <= max(200 - 60 - system, 50) or len(new) == 1 or (not before and new[0][0] == "system")
        before += new
    order = lambda x: (*x[:2], role_esc(x[2]), esc(x[3]))
    for c, turns in given.items():
        assert seen[c] == [(role_esc(r), esc(t)) for *_, r, t in sorted(turns, key=order)], c
    back = {r["conv_id"]: r for r in read_back(format_windows(df, budget=200, history=60)).collect()}
    for c, turns in given.items():
        own = [(r, t) for *_, r, t in sorted(turns, key=order)]
        assert back[c]["turns"] == "".join(f"{r}\n{t}\n" for r, t in own) and back[c]["n_turns"] == len(own)
        assert back[c]["loss"] == "".join(t for r, t in own if r == "assistant")
        assert back[c]["formatted_chars"] == sum(len(w["text"]) for w in windows if w["conv_id"] == c)
    assert set(back) == set(given)


def test_windows_of_exact_counts_and_of_nothing(spark):
    rows = [(1, t, "user", "x", "b", 1, n) for t, n in enumerate([5, 5, 5, 30, 1, None, 1])]
    df = spark.createDataFrame(rows, CHAT)
    got = sorted((w["window"], w["n_turns"], w["n_tokens"]) for w in format_windows(df, budget=14, history=4, count_col="n").collect())
    assert got == [(0, 2, 10), (1, 1, 5), (2, 1, 30), (3, 3, 2)]
    assert format_windows(df.limit(0)).collect() == [] and read_back(format_windows(df.limit(0))).collect() == []


def test_windows_are_native_and_no_group_holds_a_long_conversation(spark):
    plan = format_windows(spark.createDataFrame(conversations(), CHAT))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "block" in plan


def test_escapes_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|<|<\\|", "<<||", "a<\\", "|", "\\p", "\\b\\n", "r|\n\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", unescaped(escaped(F.col("t"))).alias("a"), unescaped_role(escaped_role(F.col("t"))).alias("b"), escaped(F.col("t")).alias("c")).collect()
    assert all(r["t"] == r["a"] == r["b"] and "<|" not in r["c"] for r in got)


# --- whitening ------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, component int, n string"


def check_whitening(rows, vectors, components=16):
    """Rows of one length against an eigendecomposition of the exact covariance."""
    x = {i: np.floor(64 * np.float32(v).astype(float)).astype(np.int64) + 1_000_000 for i, v in vectors}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, sums = len(fit), [int(s) for s in fit.astype(object).sum(axis=0)]
    centred = (fit * n - np.array(sums)) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    keep = min(components, int((values > 1e-9 * values[0]).sum()))
    by = defaultdict(list)
    for r in rows:
        by[r["id"], r["component"]].append(r)
    assert {i for i, _ in by} == set(x) and {c for _, c in by} == set(range(1, keep + 1))
    for c in range(1, keep + 1):
        got = np.array([by[i, c][0]["whitened"] for i in x])
        want = np.array([((x[i] * n - np.array(sums)) / n) @ vecs[:, c - 1] / np.sqrt(values[c - 1]) for i in x])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6
    for i in x:
        one = by[i, 1][0]
        assert int(one["deviation"]) == sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums)) and one["n"] == n
        assert abs(one["explained"] - values[0] / values.sum()) < 1e-9 and one["identity_error"] < 1e-6


def test_whitening_matches_an_eigendecomposition(spark):
    rng = np.random.default_rng(6)
    spread = rng.normal(size=(200, 20)) * np.geomspace(30, 0.3, 20)
    vectors = [(i, v.tolist()) for i, v in enumerate(spread @ np.linalg.qr(rng.normal(size=(20, 20)))[0])]
    vectors += [(300 + i, vectors[0][1]) for i in range(50)]
    bad = [(400, None), (401, [None] + [1.0] * 19), (402, [float("nan")] * 20), (403, [float("inf")] * 20), (404, []), (405, [3e38] * 20)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in vectors + bad], VECTORS).repartition(5)
    rows = whiten(df).collect()
    check_whitening(rows, vectors)
    again = spark.createDataFrame([(1, vectors[5][1], 7, "x")], VECTORS)
    assert len(whiten(df.union(again)).filter("id = 1").collect()) == 32  # a repeated id is whitened row by row


def test_whitening_without_full_rank_and_by_length(spark):
    rng = np.random.default_rng(7)
    flat = rng.integers(-50, 50, size=(90, 3)) @ rng.integers(-3, 4, size=(3, 8))
    vectors = [(i, (v / 64).tolist()) for i, v in enumerate(flat)]
    short = [(500 + i, (v / 64).tolist()) for i, v in enumerate(rng.integers(-9, 9, size=(30, 2)))]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in vectors + short], VECTORS)
    rows = whiten(df).collect()
    check_whitening([r for r in rows if r["id"] < 500], vectors)
    check_whitening([r for r in rows if r["id"] >= 500], short)
    single = spark.createDataFrame([(1, [1.0, 2.0], 7, "x"), (2, [1.0, 2.0], 7, "x")], VECTORS)
    assert whiten(single).collect() == [] and whiten(df.limit(0)).collect() == []


def test_whitening_of_ill_scaled_and_large_values(spark):
    rng = np.random.default_rng(9)
    wide = rng.normal(size=(120, 4)) * np.array([1e9, 1e4, 10.0, 1.0])
    vectors = [(i, np.float32(v).tolist()) for i, v in enumerate(wide)]
    rows = whiten(spark.createDataFrame([(i, v, 7, "x") for i, v in vectors], VECTORS)).collect()
    assert max(r["identity_error"] for r in rows) < 1e-6 and {r["component"] for r in rows} == {1, 2, 3, 4}
    x = {i: np.floor(64 * np.float32(v).astype(float)).astype(np.int64) + 1_000_000 for i, v in vectors}
    n, sums = len(x), [sum(int(v[d]) for v in x.values()) for d in range(4)]
    exact = {i: sum((n * int(a) - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    assert all(int(r["deviation"]) == exact[r["id"]] for r in rows) and max(exact.values()) > 1 << 63
    assert not Centre(n, tuple(sums), 1 << 40).small


def test_digests_of_the_query_are_of_whole_texts(spark):
    rows = [(1, 0, "assistant", "é<|", "b", 1, 1)]
    back = read_back(format_windows(spark.createDataFrame(rows, CHAT))).select(F.sha2("loss", 256).alias("h"), F.length("loss").alias("n")).first()
    assert back["h"] == hashlib.sha256("é<|".encode()).hexdigest() and back["n"] == 3
