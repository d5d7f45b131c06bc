"""Vectors, graphs, archive records, pages and token files against plain Python."""

import html.parser
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import components as graph
from evenhand.llm import flat_graph, revisits, token_files, va_search
from evenhand.llm.flat_graph import near_vectors, recall
from evenhand.llm.html_layout import extract, render
from evenhand.llm.queries import vocabulary
from evenhand.llm.revisits import canonical, resolve
from evenhand.llm.token_files import count_tokens, scan_blocks, token_counts_of
from evenhand.llm.va_search import top_k

def vectors(spark, rows):
    """Rows as a table of vectors; components become floats."""
    real = [(i, None if v is None else [None if x is None else float(x) for x in v], n) for i, v, n in rows]
    return spark.createDataFrame(real, VECTORS)


VECTORS = "vec_id bigint, embedding array<float>, label int"


# --- components -----------------------------------------------------------------------------------

@pytest.mark.parametrize("one_task", [500_000, 20])
def test_components_match_union_find(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)]
    edges += [(2000, x) for x in range(2001, 2100)] + [(-5, -7), (3000, 3000), (None, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


# --- top-k ----------------------------------------------------------------------------------------

def test_top_k_matches_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(va_search, "QUERIES", 7)
    monkeypatch.setattr(va_search, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, (np.round(rng.normal(size=6) * 8) / 8).tolist(), 0) for i in range(150)]  # many ties
    rows += [(200, None, 0), (220, [1.0, None, 0, 0, 0, 0], 0), (240, [float("nan")] * 6, 0), (260, [float("inf")] + [0.0] * 5, 1)]
    rows += [(280, [1.0, 2.0], 0), (281, [3.0, -1.0], 0), (300, [1e30] * 6, 0), (320, [4096.0] * 6, 0), (340, [], 0), (None, [1.0] * 6, 0)]
    df = vectors(spark, rows).withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).repartition(5)  # clashing names
    got = {}
    for r in top_k(df, F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int) for i, v, _ in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and all(abs(x) < 1e17 for x in v)}
    for q in good:
        if q % 20 == 0:
            exact = lambda v: sum(int(a) * int(b) for a, b in zip(good[q], v))
            want = sorted((-exact(v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert set(got) <= set(good) and top_k(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_top_k_of_large_components_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.5], 0), (1, [5e6, 1.0], 0), (2, [2.0, 2.0], 0), (2, [2.0, 2.0], 0), (3, [1e15, -1e15], 0), (4, [-1e15, 1.0], 0), (5, [3.0, 0.0], 0)]
    got = [(r["rank"], r["vec_id"]) for r in top_k(vectors(spark, rows), F.col("id") == 0, k=5).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 1), (3, 5), (4, 2), (5, 2)] or got == [(1, 3), (2, 1), (3, 2), (4, 2), (5, 5)]
    scores = {r["vec_id"]: r["score"] for r in top_k(vectors(spark, rows), F.col("id") == 0, k=9).collect()}
    whole = lambda v: [int(np.floor(64 * float(np.float32(x)))) for x in v]
    assert scores == {i: sum(a * b for a, b in zip(whole(v), whole(rows[0][1]))) for i, v, _ in rows[1:]}
    with pytest.raises(Exception, match="does not fit 64 bits"):
        top_k(vectors(spark, rows), F.col("id") == 3, k=1).collect()
    a, b = np.array([[1 << 40, 3], [2, -5]]), np.array([[1 << 20, -7], [1, 1]])
    assert va_search.inner_products(a, b).tolist() == [(1 << 60) - 21, -3]


# --- embedding near-dedup -------------------------------------------------------------------------

def test_links_of_planted_copies(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "PART", 64)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 24))
    for a in range(0, 150):  # one large group, a chain of looser ones
        v[a] = v[0] + rng.normal(size=24) * 0.02
    for a in range(200, 260):
        v[a] = v[a - 1] + rng.normal(size=24) * 0.35
    v[300] = v[301] * 7
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(600, [0.0] * 24, 0), (601, None, 0), (602, [None] + [1.0] * 23, 0), (603, [float("nan")] * 24, 0), (604, [1.0, 0.0], 0), (605, [2.0, 0.0], 0), (606, [], 0), (None, v[0].tolist(), 0)]
    df = vectors(spark, rows)
    got = {r["id"]: r for r in near_vectors(df).collect() if r["id"] is not None}
    unit = {i: np.array(x, np.float32).astype(float) for i, x, _ in rows if i is not None and i < 500}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    sims = np.array(list(unit.values()))
    sims = sims @ sims.T
    true = {i: int((sims[i] >= 0.9).sum()) - 1 for i in range(500)}
    assert all(got[i]["n_links"] <= true[i] for i in true)
    assert sum(got[i]["n_links"] for i in true) >= 0.95 * sum(true.values())
    assert {got[i]["component"] for i in range(150)} == {0} and got[300]["component"] == got[301]["component"]
    assert [(got[i]["n_links"], got[i]["component"]) for i in (600, 601, 602, 603, 604, 605, 606)] == [(0, 600), (0, 601), (0, 602), (0, 603), (1, 604), (1, 604), (0, 606)]
    assert recall(df.filter("vec_id < 500"), near_vectors(df.filter("vec_id < 500"))) >= 0.9
    assert near_vectors(df.limit(0)).collect() == []


def test_exact_search_finds_links_across_shards(spark, monkeypatch):
    """Far links run between vectors that share no shard; parts of 100 make several tiles of them."""
    monkeypatch.setattr(flat_graph, "PAIRED", 100)
    x = np.random.default_rng(7).normal(size=(900, 24)).astype(np.float32)
    x[1] = x[0]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    sims = unit @ unit.T >= 0.5
    low = np.arange(900)
    for _ in range(900):
        low = np.where(sims, low[None, :], 900).min(axis=1)
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)])
    got = {r["id"]: (r["n_links"], r["component"]) for r in near_vectors(df, threshold=0.5, exact=True).collect()}
    assert got == {i: (int(sims[i].sum()) - 1, int(low[i])) for i in range(900)}
    assert sum(n for n, _ in got.values()) > sum(r["n_links"] for r in near_vectors(df, threshold=0.5).collect())


def test_exact_search_moves_no_vector_for_a_pair(spark, monkeypatch):
    """Smaller blocks make more pairs of blocks, but neither more shuffle nor another result."""
    x = np.random.default_rng(9).normal(size=(800, 48)).astype(np.float32)
    df = vectors(spark, [(i, v, 0) for i, v in enumerate(x)])

    def moved():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    found, bytes_moved = [], []
    for paired in (800, 20):
        monkeypatch.setattr(flat_graph, "PAIRED", paired)
        before = moved()
        found.append(sorted(r[:] for r in near_vectors(df, threshold=0.4, exact=True).collect()))
        bytes_moved.append(moved() - before)
    assert found[0] == found[1] and bytes_moved[1] < 1.5 * bytes_moved[0]


def test_cosines_at_the_threshold_are_decided_in_double():
    x = np.random.default_rng(3).normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = np.einsum("ik,jk->ij", x, x)
    for threshold in np.sort(sims[:20, 100:].ravel())[::97]:  # each is a cosine of the table
        a, b = flat_graph._close_pairs(x, x, float(threshold))
        assert len(a) == (np.einsum("ik,jk->ij", x, x) >= threshold).sum()


# --- revisits -------------------------------------------------------------------------------------

def test_canonical_urls(spark):
    cases = {
        "http://WWW.Example.com:80/a/?b=2&a=1#x": "example.com/a?a=1&b=2", "https://example.com/a?utm_source=q&a=1&b=2": "example.com/a?a=1&b=2",
        " https://user:pw@example.com. ": "example.com", "example.com/A/": "example.com/A", "http://example.com:8080/?ref=x": "example.com:8080", "": "", None: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "url string").select("url", canonical(F.col("url")).alias("c")).collect()
    assert {r["url"]: r["c"] for r in got} == cases


RECORDS = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, payload string, found string"


def test_repeated_records_are_one(spark):
    schema = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, payload string"
    page, other = (1, "http://a.b/x", 10, "response", 200, {"etag": "e"}, "body"), (1, "http://a.b/x", 12, "response", 200, {"etag": "e"}, "later")
    again, lost = (2, "http://a.b/x", 20, "revisit", 304, {"etag": "e"}, None), (None, "http://a.b/x", 21, "revisit", 304, {"etag": "e"}, None)
    rows = [page, page, other, again, again, again, lost, lost, (1, "http://a.b/x", 30, "revisit", 304, {"etag": "e"}, None)]
    got = sorted((r["revisit_id"] or 0, r["outcome"], r["payload"] or "") for r in resolve(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "no_response", ""), (0, "no_response", ""), (1, "resolved", "body"), (2, "resolved", "body")]


def test_vectors_given_twice_are_one(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0), (3, [0.0, 1.0], 0)]
    df = vectors(spark, rows).withColumn("rep", F.lit(1)).withColumn("unit", F.lit("x"))
    got = sorted((r["id"], r["n_links"], r["component"]) for r in near_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3)]


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    page = lambda i, ts, tag, body, status=200, url="http://a.b/x": (i, url, ts, "response", status, {"ETag": tag, "Content-Type": "html", "Date": "d", "Last-Modified": "m"}, body, "")
    again = lambda i, ts, h, url="https://www.a.b/x#f": (i, url, ts, "revisit", 304, h, None, "")
    rows = [
        page(1, 10, '"1"', "one"), page(2, 20, '"2"', "two"), page(3, 25, '"p"', "part", 206), page(4, 30, '"2"', "same time"),
        again(5, 21, {"etag": 'W/"2"', "DATE": "new", "Content-Type": "no", "X": "no", "Vary": None}), again(6, 15, {"ETag": '"2"'}), again(7, 9, {"ETag": '"1"'}),
        again(8, 28, {"Last-Modified": "m"}), again(9, 28, {"last-modified": "other"}), again(10, 28, {}), again(11, 28, None), again(12, 28, {"ETag": '"2"'}, None),
        again(13, 30, {"ETag": '"2"'}), again(14, None, {"ETag": '"2"'}),
    ]
    got = {r["revisit_id"]: r for r in resolve(spark.createDataFrame(rows, RECORDS)).collect()}
    assert {i: (r["outcome"], r["response_id"]) for i, r in got.items()} == {
        5: ("resolved", 2), 6: ("changed", 1), 7: ("no_response", None), 8: ("resolved", 2), 9: ("changed", 2), 10: ("no_validator", 2),
        11: ("no_validator", 2), 12: ("no_response", None), 13: ("resolved", 4), 14: ("no_response", None)}
    assert got[5]["payload"] == "two" and got[5]["headers"] == {"etag": 'W/"2"', "content-type": "html", "date": "new", "last-modified": "m"}
    assert got[6]["payload"] is None and resolve(spark.createDataFrame([], RECORDS)).collect() == []


def test_a_hot_url_is_spread_over_slices(spark, monkeypatch):
    monkeypatch.setattr(revisits, "SLICE_ROWS", 5)
    rng = random.Random(6)
    rows, full = [], []
    for i in range(600):
        ts, kind = rng.randrange(5000), rng.choice(["response", "revisit", "revisit"])
        rows.append((i, "http://hot/", ts, kind, 200 if kind == "response" else 304, {}, "", ""))
        if kind == "response":
            full.append((ts, i))
    got = {r["revisit_id"]: r["response_id"] for r in revisits.earlier_responses(spark.createDataFrame(rows, RECORDS)).collect()}
    for i, _, ts, kind, *_ in rows:
        if kind == "revisit":
            assert got[i] == max((x for x in full if x < (ts, i)), default=(0, None))[1]


# --- pages ----------------------------------------------------------------------------------------

CASES = [
    ("<p>One<p>Two<br>b", "One\n\nTwo\nb"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f", "- a\n- b\n  3. c\n  4. d\n- e\n\nf"),
    ("<table><tr><th>Name<th>N<tr><td>apple pie<td>3<tr><td>b<br>c<td>44</table>", "Name       N\napple pie  3\nb          44\nc"),
    ("<table><tr><td colspan=2>wide cell here<td>x<tr><td>a<td>b<td>c</table>", "wide cell here  x\na  b  c"),
    ("<pre>\n a\n  b</pre>x", " a\n  b\n\nx"),
    ("a<script>if(1<2)'</p>'</script><style>.z{display:none}#q{visibility:hidden}</style>b<i class='y z'>no</i><b id=q>no<u style='visibility:visible'>yes</u></b>", "abyes"),
    ("<div hidden>no</div><div style='Display : none'>no<p>no</div><template>no</template><noscript>no</noscript>ok", "ok"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("1 < 2 &amp; 3 &gt; 2 &copy;<!-- no --><!--> yes", "1 < 2 & 3 > 2 © yes"),
    ("<head><title>no</title><meta x>body <b>bo</b>ld</div>  text</span>", "body bold text"),
    ("<dl><dt>T<dd>D<dt>U</dl><blockquote>q<p>r</blockquote>", "T\n  D\nU\n\n  q\n\n  r"),
    ("<textarea><b>x</textarea><input type=hidden value=no><input type=submit value=Go>", "<b>x Go"),
    ("<td>loose<div>x<a href='unclosed>y", "loose\nxy"), ("", ""), (None, ""), ("<p></p>", ""), ("<a\nb='>'>t</a>", "t"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert render(page) == text


def test_deep_and_long_pages():
    assert render("<div>" * 30_000 + "x") == "x"
    assert render("<b" * 20_000 + "x").count("x") <= 1
    assert len(render("<p>word " * 20_000).split()) == 20_000


class Seen(html.parser.HTMLParser):
    """Visible words in order, for pages without hidden parts."""

    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title")

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_no_visible_word_is_lost(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the test tables")
    pages = spark.read.parquet(path).withColumn("text", F.lit(1))
    out = {r["page_id"]: r for r in extract(pages).collect()}
    assert extract(pages).columns == ["page_id", "url", "text_in", "text"]
    for r in pages.collect():
        p = Seen()
        p.feed(r["html"])
        p.close()
        got = [w for w in out[r["page_id"]]["text"].split() if w != "-"]
        assert "".join(got) == "".join(w for w in p.words if w != "-")

CSS_WRAPS = [("{}", True), ("@media print{{{}}}", False), ("@media screen{{{}}}", True), ("@media (max-width:40em){{{}}}", None), ("@media not print{{{}}}", True)]
CSS_PROPS = [("display", "none"), ("display", "block"), ("visibility", "hidden"), ("visibility", "visible")]


@pytest.mark.parametrize("seed", range(8))
def test_css_rules_by_brute_force(seed):
    """Random sheets of simple selectors: rules for print do not count, those for some screens only show, the cascade picks the rest."""
    rng = random.Random(seed)
    for _ in range(60):
        rules = [(rng.choice(["p", ".a", ".b", "#i", "p.a", ".a.b", "div .a", "div > .b"]), *rng.choice(CSS_PROPS), rng.random() < 0.2, *rng.choice(CSS_WRAPS))
                 for _ in range(rng.randrange(6))]
        css = "".join(w.format(f"{s} {{ {k} : {v}{' !important' * strong}; color:red }}") for s, k, v, strong, w, _ in rules)
        body, seen = "", []
        for n in range(8):
            classes, ident, hidden, deep = rng.sample(["a", "b"], rng.randrange(3)), rng.random() < 0.3, rng.random() < 0.2, rng.randrange(3)
            own = f"<p class='{' '.join(classes)}'{' id=i' * ident}{' hidden' * hidden}>w{n}</p>"
            body += f"<div><section>{own}</section></div>" if deep == 2 else f"<div>{own}</div>" if deep else own
            won = {}
            for at, (s, k, v, strong, _, on) in enumerate(rules):
                marks = set(classes)
                fits = {"p": True, ".a": "a" in marks, ".b": "b" in marks, "#i": ident, "p.a": "a" in marks, ".a.b": len(marks) == 2,
                        "div .a": "a" in marks and deep > 0, "div > .b": "b" in marks and deep == 1}[s]
                if fits and on is not False and (on or v not in ("none", "hidden")):
                    weight = (strong, s.count("#"), s.count("."), len(re.findall(r"\b(?:p|div)\b", s)), at)
                    won[k] = max(won.get(k, ((), "")), (weight, v))
            display = won["display"][1] if "display" in won else "none" if hidden else "block"
            if display != "none" and won.get("visibility", (0, "visible"))[1] == "visible":
                seen.append(f"w{n}")
        assert render(f"<style>{css}</style>{body}").split() == seen, (css, body)


@pytest.mark.parametrize("page, text", [
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<noscript><style>p{display:none}</style></noscript><p>a", "a"),
    ("<style>@keyframes k{from{visibility:hidden}}@supports (x:y){p{display:none}}</style><p>a", "a"),
    ("<style>.x::before{content:'}{'}.hidden{display:none}@media (min-width:9em){.md\\:block{display:block}}</style><p class='hidden md:block'>a<p class=hidden>b", "a"),
    ("<style>body .x{display:none}html > body > .y{display:block}</style><p class='x y'>a<p class=x>b", "a"),
    ("<style>@layer u{.x{display:none}}.x{display:block}</style><p class=x>a", "a"),
    ("<style>.x{display:none}.x:not(.q){display:block}.x:hover{display:block}</style><p class=x>a", "a"),
    ("<p>See <svg><defs><text>no</text></defs><title>no</title><path/><g/><text>one <tspan>two</tspan></text><text>three</text></svg> end", "See one two three end"),
    ("<svg><foreignObject><p>in</p></foreignObject><text display=none>no</text><p>out", "in\n\nout"),
    ("<p>Let <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>tex</annotation></semantics></math> be", "Let x=1 be"),
])
def test_css_and_drawings(page, text):
    assert render(page) == text


# --- token files ----------------------------------------------------------------------------------

def plain_counts(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + [(start, len(ids) - start, False)] * (start < len(ids))


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separators_across_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    files = [[rng.choice([7, 7, 1, 2, 3]) for _ in range(rng.randrange(1, 120))] for _ in range(4)] + [[], [7], [1], [1] * 50, [7] * 40]
    for i, ids in enumerate(files):
        np.array(ids, dtype="<u2").tofile(tmp_path / f"part-{i:02d}")
    got = {}
    for r in count_tokens(scan_blocks(spark, str(tmp_path), 7, 2, block)).collect():
        got.setdefault(int(r["file"][-2:]), []).append((r["doc"], r["start"], r["n_tokens"], r["ended"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: [(k, *x) for k, x in enumerate(plain_counts(ids, 7))] for i, ids in enumerate(files) if ids}


def test_token_files_of_documents(spark, tmp_path):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    texts = ["hello world", None, "", "<|endoftext|> é\n\r\n日本", "a" * 3000]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, ids int").coalesce(1)
    got = token_counts_of(df, f"file://{tmp_path}/tokens", path, public_tokenizers.PATTERN, 50256).orderBy("file", "doc").collect()
    enc = token_files.encoder(path, public_tokenizers.PATTERN)
    assert [r["n_tokens"] for r in got] == [len(enc.encode_ordinary(t or "")) for t in texts] and not os.path.exists(tmp_path / "tokens")
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "part-0").write_bytes(b"abc")
    with pytest.raises(Exception, match="no file of 2-byte tokens"):
        scan_blocks(spark, str(tmp_path / "odd"), 7).collect()


def test_deep_nesting_costs_no_more_than_its_depth():
    import time

    for page in ("<div>" * 40_000 + "x", "<b><span>" * 20_000 + "</q></p>" * 20_000 + "x", "<p>a<table><td>" + "<div>" * 40_000 + "x", "<li>" * 40_000 + "x"):
        start = time.perf_counter()
        assert render(page).endswith("x")
        assert time.perf_counter() - start < 10


def test_cells_that_reach_down_keep_columns_aligned():
    """Against a plain grid: every cell's text starts where its column does."""
    assert render("<table><tr><td>a<td rowspan=2>b<td>z<tr><td>c<td>d</table>") == "a  b  z\nc     d"
    rng = random.Random(12)
    for _ in range(60):
        n_rows, taken, page, want = rng.randrange(1, 6), {}, "<table>", {}
        for r in range(n_rows):
            page += "<tr>"
            c = 0
            for k in range(rng.randrange(1, 5)):
                while (r, c) in taken:
                    c += 1
                wide, tall, text = 1, rng.choice([1, 1, 2, 3]), f"r{r}k{k}x"
                if any((r, c + i) in taken for i in range(wide)):
                    wide = 1
                page += f"<td colspan={wide} rowspan={tall}>{text}"
                want[text] = (r, c)
                for i in range(wide):
                    for j in range(tall):
                        taken[r + j, c + i] = text
                c += wide
        lines = render(page + "</table>").split("\n")
        at = {t: (i, line.index(t)) for t in want for i, line in enumerate(lines) if t in line.split()}
        assert set(at) == set(want)
        alone = {c for _, c in want.values()}
        starts = {c: {at[t][1] for t in want if want[t][1] == c} for c in alone}
        assert all(len(x) == 1 for x in starts.values()), (page, lines)
        assert [starts[c] for c in sorted(starts)] == sorted(starts.values(), key=min)
