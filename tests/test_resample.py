"""Laws of the replicate draws: cells and slots agree in distribution, clusters stay whole."""

import statistics

import pytest
from pyspark.sql import functions as F

from evenhand.operators import resample as B
from evenhand.operators.cells import confusion_cells


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, i % 2, (i // 2 + i // 5) % 2, "A" if i % 3 else "B") for i in range(120)]
    return spark.createDataFrame(rows, "row_id int, y_true int, y_pred int, grp string")


def moments(reps, grp="A"):
    v = [r.tp for r in reps.filter(F.col("grp") == grp).collect()]
    return statistics.mean(v), statistics.pstdev(v)


def test_row_replicates_have_the_binomial_law(labelled):
    cells = confusion_cells(labelled)
    a = cells.filter("grp = 'A'").first()
    p = a.tp / a.n
    want = (a.n * p, (a.n * p * (1 - p)) ** 0.5)
    for draw in (B.row_replicates_cells, B.row_replicates_slots):
        reps = draw(cells, 300, 7)
        sizes = {(r.grp, r.n) for r in reps.select("grp", "n").distinct().collect()}
        assert sizes == {("A", a.n), ("B", 120 - a.n)}  # strata keep their size
        mean, std = moments(reps)
        assert mean == pytest.approx(want[0], abs=4 * want[1] / 300**0.5)
        assert std == pytest.approx(want[1], rel=0.2)


def test_replicates_do_not_depend_on_partitioning(labelled):
    for draw in (B.row_replicates_cells, B.row_replicates_slots):
        one = sorted(map(tuple, draw(confusion_cells(labelled.repartition(1)), 10, 3).collect()))
        many = sorted(map(tuple, draw(confusion_cells(labelled.repartition(13)), 10, 3).collect()))
        assert one == many


@pytest.fixture(scope="module")
def clustered(spark):
    """20 clusters of 10 rows; a cluster is all right or all wrong."""
    rows = [
        (c * 10 + i, i % 2, (i % 2) if c % 3 else 1 - (i % 2), "A" if c % 2 else "B", c) for c in range(20) for i in range(10)
    ]
    return spark.createDataFrame(rows, "row_id int, y_true int, y_pred int, grp string, cluster_id int")


def test_cluster_replicates_hold_whole_clusters(clustered):
    per = B.cluster_cells(clustered)
    for draw in (B.cluster_replicates_cells, B.cluster_replicates_slots):
        reps = draw(per, 50, "cluster_id", 11)
        totals = reps.groupBy("b").agg(F.sum("n").alias("n")).collect()
        assert {r.n for r in totals} == {200}
        assert all(r.n % 10 == 0 for r in reps.collect())
    spread = draw(per, 200, "cluster_id", 5).filter("grp = 'A'").agg(F.avg("n"), F.stddev_pop("n")).first()
    bucketed = B.cluster_replicates_cells(per, 200, "cluster_id", 5, depth=3).filter("grp = 'A'").agg(F.avg("n"), F.stddev_pop("n")).first()
    assert spread[0] == pytest.approx(100, abs=6) and bucketed[0] == pytest.approx(100, abs=6)
    # ten of twenty clusters are A: n is 10 * Binomial(20, 1/2)
    assert spread[1] == pytest.approx(10 * 5**0.5, rel=0.2) and bucketed[1] == pytest.approx(10 * 5**0.5, rel=0.2)


def test_bucket_shares_are_one_multinomial_draw(spark):
    """All buckets see the same draws, so shares add up; their means and spreads are the multinomial's."""
    weights = {0: 5, 1: 1, 2: 30, 5: 14, 7: 50}
    paths = {r.bucket: r for r in B.bucket_paths(spark.createDataFrame(list(weights.items()), "bucket bigint, c bigint"), 3).collect()}
    assert set(paths) == set(weights) and all(r.total == 100 and len(r.path) == 3 for r in paths.values())
    shares = {k: [B.bucket_share(r.path, r.total, b, 9) for b in range(2000)] for k, r in paths.items()}
    assert all(sum(x) == 100 for x in zip(*shares.values()))
    for k, w in weights.items():
        mean = sum(shares[k]) / 2000
        var = sum((x - mean) ** 2 for x in shares[k]) / 2000
        assert mean == pytest.approx(w, abs=0.5) and var == pytest.approx(w * (100 - w) / 100, rel=0.2)


def test_cluster_interval_is_wider(clustered):
    rows = {r.metric: r for r in B.bootstrap(clustered, 200).collect()}
    clusters = {r.metric: r for r in B.cluster_bootstrap(clustered, replicates=200).collect()}
    m = "Selection Rate (A)"
    assert rows[m].support_status == "VALID"
    width = lambda r: r.ci_high - r.ci_low
    assert width(clusters["TPR (A)"]) >= 0.9 * width(rows["TPR (A)"])
    assert rows[m].ci_low <= rows[m].point_estimate <= rows[m].ci_high


def test_few_clusters_and_missing_column(clustered):
    few = B.cluster_bootstrap(clustered.filter("cluster_id < 3"), replicates=20).collect()
    assert {r.support_status for r in few} == {"INSUFFICIENT_BOOTSTRAP_SUPPORT"} and all(r.ci_low is None for r in few)
    with pytest.raises(ValueError):
        B.cluster_bootstrap(clustered.drop("cluster_id"), replicates=5)


def test_discards_are_counted(spark):
    rows = [(i, 1 if i == 0 else 0, i % 2, "A") for i in range(6)] + [(i, i % 2, i % 2, "B") for i in range(6, 16)]
    df = spark.createDataFrame(rows, "row_id int, y_true int, y_pred int, grp string")
    got = {r.metric: r for r in B.bootstrap(df, 200).collect()}
    odds = got["Equalized Odds Diff"]
    assert odds.discarded > 0 and odds.successful + odds.discarded == 200
    assert sum(odds.discard_reasons.values()) == odds.discarded
    # A misses its only positive with probability (5/6)**6
    assert got["TPR (A)"].discard_reasons["ZERO_POSITIVES_IN_SAMPLE"] == pytest.approx(200 * (5 / 6) ** 6, abs=30)
    assert odds.support_status == "INSUFFICIENT_BOOTSTRAP_SUPPORT" and odds.ci_low is None


def test_permutations_keep_margins(labelled):
    want = {r.grp: r.n for r in confusion_cells(labelled).collect()}
    total = labelled.filter("y_true = 1 AND y_pred = 1").count()
    for reps in (B.permuted_replicates_slots(labelled, 8), B.permuted_replicates_cells(labelled, 8)):
        for b in range(8):
            part = reps.filter(F.col("b") == b).collect()
            assert {r.grp: r.n for r in part} == want and sum(r.tp for r in part) == total


def test_permutation_matches_plain_shuffle(labelled):
    """Cuts give the same labels as numbering all rows."""
    import hashlib

    rows = labelled.collect()
    got = {(r.b, r.grp): r.tp for r in B.permuted_replicates_slots(labelled, 3).collect()}
    labels = sorted(r.grp for r in rows)
    for b in range(3):
        order = sorted(rows, key=lambda r: hashlib.md5(f"42|{b}|{r.row_id}".encode()).hexdigest())
        want = {}
        for r, g in zip(order, labels):
            want[g] = want.get(g, 0) + (r.y_true & r.y_pred)
        assert {g: got[(b, g)] for g in want} == want


def test_controls(labelled):
    perm = B.permutation_control(labelled, 50).first()
    rand = B.random_group_control(labelled, 50).first()
    feat = B.feature_group_control(labelled, "row_id").first()
    assert 0 <= perm.p_value <= 1 and perm.explained == (perm.p_value > 0.05)
    assert rand.explained is False and feat.explained is True and feat.p_value is None
    strong = labelled.withColumn("y_pred", (F.col("grp") == "A").cast("int"))
    assert B.permutation_control(strong, 50).first().p_value == 0.0


def test_production_bootstraps_draw_500_replicates(spark):
    from evenhand.catalog import load
    from evenhand.catalog.registry import QUERIES

    load()
    for name in ("bootstrap_ci_fast", "cluster_bootstrap_ci_fast"):
        assert {r["requested"] for r in QUERIES[name](spark, "/root/testdata/sf0.001").select("requested").collect()} == {500}


def test_digests_of_whole_columns():
    """Words of every length and number of blocks are those of hashlib."""
    import hashlib

    from evenhand.functions.draws import decimal_tails, draw_end, draws60, md5_words, text_tails

    for prefix in (b"", b"42|3|q1|", b"x" * 50, b"y" * 61, b"z" * 130):
        for first, tails in decimal_tails(7, 1203):
            words = md5_words(prefix, tails)
            want = [hashlib.md5(prefix + str(first + i).encode()).hexdigest() for i in range(len(tails))]
            assert [w.tobytes().hex() for w in words.T.astype("<u4")] == want
            assert draws60(words).tolist() == [int(h[:15], 16) for h in want]
    texts = ["é", None, "", "ab", "cd", "abc"]
    seen = {int(p): bytes(t) for places, tails in text_tails(texts) for p, t in zip(places, tails)}
    assert seen == {i: (x or "").encode() for i, x in enumerate(texts)}
    for size in (1, 7, 10**9 + 7, 2**62):
        for index in (0, 1, size // 3, size - 1, size):
            end = draw_end(index, size)
            assert (end == 0 or ((end - 1) * size) >> 60 < index) and (end == 1 << 60 or (end * size) >> 60 >= index)


def test_slots_replay_by_hand(spark):
    """Chunks of draws and long labels give the draws of every single slot."""
    import hashlib

    cells = spark.createDataFrame([("g" * 70, 40, 5, 0, 25, 10), ("b", 3, 0, 3, 0, 0)], "grp string, n bigint, tn bigint, fp bigint, fn bigint, tp bigint")
    got = {(r.b, r.grp): (r.tn, r.fp, r.fn, r.tp) for r in B.row_replicates_slots(cells, 4).collect()}
    for r in cells.collect():
        ends = [r.tn, r.tn + r.fp, r.tn + r.fp + r.fn, r.n]
        for b in range(4):
            want = [0, 0, 0, 0]
            for i in range(r.n):
                u = (int(hashlib.md5(f"42|{b}|{r.grp}|{i}".encode()).hexdigest()[:15], 16) * r.n) >> 60
                want[next(k for k, e in enumerate(ends) if u < e)] += 1
            assert got[b, r.grp] == tuple(want)


@pytest.mark.parametrize("reach", [8, 0])
def test_folded_permutation_deals_as_the_whole_order(spark, monkeypatch, reach):
    """Rows between the windows are never ordered one by one; a rank outside its window is found by cuts."""
    import hashlib

    monkeypatch.setattr(B, "REACH", reach)
    rows = [(f"k{i}", i % 2, i % 3 % 2, "AB"[i % 5 == 0]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "row_id string, y_true int, y_pred int, grp string")
    if reach == 8:
        low, high = B.rank_windows([16_000], 20_000)[0]
        assert (high - low) / (1 << 60) < 0.05  # what is ordered shrinks with the root of the rows
    got = {(r.b, r.grp): (r.n, r.tp, r.tn) for r in B.permuted_replicates_slots(df, 2).collect()}
    for b in range(2):
        order = sorted(rows, key=lambda r: hashlib.md5(f"42|{b}|{r[0]}".encode()).hexdigest())
        for g, part in (("A", order[:16_000]), ("B", order[16_000:])):
            assert got[b, g] == (len(part), sum(r[1] & r[2] for r in part), sum((1 - r[1]) & (1 - r[2]) for r in part))


def test_random_groups_by_hand(spark):
    """Null ids and labels that are null count as they do row by row."""
    import hashlib

    rows = [(str(i) if i % 4 else None, i % 2, None if i == 3 else i % 3 % 2, "ABC"[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id string, y_true int, y_pred int, grp string")
    got = {(r.b, r.grp): (r.n, r.tp, r.sel_n, r.pos_n) for r in B.random_group_replicates(df, 3).collect()}
    want = {}
    for b in range(3):
        for i, y, p, _ in rows:
            key = f"42r|{b}" + (f"|{i}" if i is not None else "")
            u = (int(hashlib.md5(key.encode()).hexdigest()[:15], 16) * 40) >> 60
            g = "A" if u < 14 else "B" if u < 27 else "C"
            n, tp, s, q = want.get((b, g), (0, 0, 0, 0))
            want[b, g] = (n + 1, tp + (y == 1 and p == 1), s + (p == 1), q + (y == 1))
    assert got == want
