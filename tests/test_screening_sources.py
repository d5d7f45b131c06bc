import json

import pytest
from pyspark.sql import functions as F

from evenhand.functions.special import f_tail
from evenhand.operators import leakage as G
from evenhand.operators import quality as Q
from evenhand.operators.frames import ColumnRoles
from evenhand.plans import benchmark as B
from evenhand.sources import readers as R
from evenhand.sources import registry as REG
from evenhand.sources import sinks as S


def findings(df, **kw):
    return {r.feature_name: r for r in G.feature_findings(df, "y", **kw).collect()}


def test_leakage_kinds(spark):
    y = [i % 2 for i in range(100)]
    rows = [(v, v, 1 - v, float(i), float(i % 7), v + ((i * 37 % 100) - 50) / 1e4, i % 3, "t") for i, v in enumerate(y)]
    df = spark.createDataFrame(
        rows,
        "y int, copy int, inv int, actual_time double, segment_deviation double, noisy double, post_completion_status int, txt string",
    )
    got = findings(df)
    assert got["copy"].severity == "CRITICAL" and got["copy"].status == "CONFIRMED_LEAKAGE"
    assert got["inv"].metric_value == -1.0
    assert got["actual_time"].status == "CONFIRMED_LEAKAGE" and got["segment_deviation"].severity == "HIGH"
    assert got["post_completion_status"].status == "SUSPICIOUS_FEATURE"
    assert got["noisy"].severity in ("HIGH", "CRITICAL") and abs(got["noisy"].metric_value) > 0.98
    assert "txt" not in got
    # a caller's list replaces the default one
    assert findings(df, known=["txt"])["actual_time"].status == "SUSPICIOUS_FEATURE"


def test_split_overlap_counts_pairs(spark):
    rows = [("train", a, b) for a, b in zip((1, 2, 3, 4), (10, 20, 30, 40))]
    rows += [("test", a, b) for a, b in zip((3, 5, 6), (30, 50, 60))]
    df = spark.createDataFrame(rows, "split string, a int, b int")
    r = G.split_overlap(df, ["a", "b"]).collect()
    assert len(r) == 1 and r[0].overlap_count == 1 and r[0].status == "CONFIRMED_LEAKAGE" and r[0].severity == "CRITICAL"
    many = df.unionByName(df.filter("a = 3"))
    assert G.split_overlap(many, ["a", "b"]).first().overlap_count == 4
    nulls = df.withColumn("a", F.lit(None).cast("int"))
    assert G.split_overlap(nulls, ["a", "b"]).count() == 0


def test_contamination(spark):
    rows = []
    for i in range(300):
        dist, time, clean = float(i % 50), float((i * 13) % 60), float((i * 7919) % 101)
        rows.append(("hi" if dist + time > 52 else "lo", dist, time, clean))
    df = spark.createDataFrame(rows, "grp string, route_distance double, actual_time double, clean double")
    got = {r.feature_name: r for r in G.contamination_report(df).collect()}
    assert got["route_distance"].heavily_contaminated and got["actual_time"].heavily_contaminated
    assert not got["clean"].heavily_contaminated


def test_f_tail_known_values():
    # quantiles from printed F tables
    assert f_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert f_tail(3.0984, 3, 20) == pytest.approx(0.05, abs=1e-4)
    assert f_tail(5.8183, 4, 12) == pytest.approx(0.0077, abs=2e-3)
    assert f_tail(0.0, 2, 5) == 1.0 and f_tail(float("inf"), 2, 5) == 0.0
    # exact: F(2, d2) has tail (1 + 2 f / d2) ** (-d2 / 2)
    assert f_tail(3.7, 2, 9) == pytest.approx((1 + 2 * 3.7 / 9) ** -4.5, rel=1e-10)


def test_anova_matches_hand_computation(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", v) for v in (3.0, 4.0, 5.0, 6.0)] + [("c", 1.0)] * 3
    df = spark.createDataFrame(rows, "grp string, x double")
    r = G.group_separation(df, ["x"]).first()
    assert r.groups == 2 and r.f_statistic == pytest.approx(4.8)


def test_duplicates_and_fingerprint(spark):
    df = spark.createDataFrame([(1, "a", None)] * 3 + [(2, "b", 0.5)], "i int, s string, x double")
    r = Q.duplicate_rows(df).first()
    assert r.duplicate_count == 2 and r.duplicate_fraction == pytest.approx(0.5)
    a = Q.table_fingerprint(df).first().fingerprint
    assert a == Q.table_fingerprint(df.repartition(3)).first().fingerprint
    assert a != Q.table_fingerprint(df.limit(3)).first().fingerprint


@pytest.mark.parametrize(
    "text, depth",
    [('{"k": 1}', 2), ("5", 1), ("{}", 1), ("[]", 1), ('{"a": {}}', 2), ('{"a": {"b": [1, 2]}}', 4), ('{"a{[": "}]"}', 2),
     ('[[], [{"x": "\\"{"}]]', 4)],
)
def test_json_depth(spark, text, depth):
    def reference(o, d=1):
        kids = o.values() if isinstance(o, dict) else o if isinstance(o, list) else None
        return d if kids is None else max([reference(k, d + 1) for k in kids], default=d)

    assert reference(json.loads(text)) == depth
    assert spark.createDataFrame([(text,)], "t string").select(Q.json_depth("t")).first()[0] == depth


def ingest_table(spark, **extra):
    rows = [(float(i), 5.0 + i, f"s{i % 3}", "am" if i % 2 else "pm", i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "planned_distance double, planned_time double, station_code string, shift string, ok int")
    for k, v in extra.items():
        df = df.withColumn(k, v)
    return df


ROLES = ColumnRoles(target="ok", sensitive=["shift"], unit_key="station_code")


def test_ingest_verdicts(spark):
    ok = Q.ingest_manifest(ingest_table(spark, shift=F.lit("x")), "t", ROLES).first()
    assert ok.status == "PASSED_WITH_WARNINGS" and ok.row_count == 8 and ok.entity_count == 3
    neg = Q.ingest_manifest(ingest_table(spark, planned_time=F.lit(-1.0), shift=F.lit("x")), "t", ROLES).first()
    assert any("negative" in m for m in neg.validation_messages)
    banned = Q.ingest_manifest(ingest_table(spark, actual_time=F.col("planned_time")), "t", ROLES, banned=["actual_time"])
    assert banned.first().status == "REJECTED_LEAKAGE"
    assert Q.ingest_manifest(ingest_table(spark).drop("shift"), "t", ROLES).first().status == "REJECTED_SCHEMA"
    assert Q.ingest_manifest(ingest_table(spark), "t", ROLES, max_rows=3).first().status == "REJECTED_SIZE"
    assert Q.ingest_manifest(ingest_table(spark), "t", ROLES, malformed_rows=2).first().status == "REJECTED_MALFORMED"
    with pytest.raises(B.LeakageRefusal):
        B.run_suite(ingest_table(spark), ["planned_time"], manifest=banned)


def test_hygiene(spark):
    rows = [
        (1, "all fine here"),
        (2, r"mail jo.doe@example.org or see C:\Users\jo\notes.txt and /home/jo/x"),
        (3, "paths /home/... and /home/placeholder/x stay; key sk-abcdefghijklmnop1234 goes"),
        (4, "twice a@b.io a@b.io ghp_ABCDEFGHIJKLMNOPQRST -----BEGIN RSA PRIVATE KEY-----"),
    ]
    got = {r.id: r for r in Q.hygiene_scan(spark.createDataFrame(rows, "id int, t string"), "t", ["id"]).collect()}
    assert got[1].clean and got[1].sanitized == rows[0][1]
    assert got[2].emails == ["jo.doe@example.org"] and len(got[2].local_paths) == 2
    assert got[2].sanitized == "mail [EMAIL_REDACTED] or see [PATH_REDACTED] and [PATH_REDACTED]"
    assert got[3].local_paths == [] and got[3].total_found == 1 and "[SECRET_REDACTED]" in got[3].sanitized
    assert got[4].emails == ["a@b.io"] and got[4].total_found == 3


def test_csv_guard_and_malformed(spark, tmp_path):
    df = spark.createDataFrame([(1, "=sum(a)"), (2, "ok"), (3, "-x"), (4, 'say "hi", you'), (5, "@me")], "i int, s string")
    S.write_csv(df, str(tmp_path / "out"), sanitize=True)
    back = R.read_csv(spark, str(tmp_path / "out"), "i int, s string")
    assert {r.i: r.s for r in R.good_rows(back).collect()} == {1: "'=sum(a)", 2: "ok", 3: "'-x", 4: 'say "hi", you', 5: "'@me"}
    bad = tmp_path / "bad.csv"
    bad.write_text("i,s\n1,a\nx,b\n3,c\n")
    got = R.read_csv(spark, str(bad), "i int, s string")
    assert R.malformed_count(got) == 1 and R.good_rows(got).count() == 2


def test_headerless_csv(spark, tmp_path):
    (tmp_path / "a.data").write_text("39, Private, <=50K\n40, ?, >50K\n")
    (tmp_path / "b.test").write_text("|1x3 Cross validator\n25, Local, <=50K.\n")
    df = R.read_headerless_csv(
        spark, [str(tmp_path / "a.data"), str(tmp_path / "b.test")], "age int, work string, income string", label="income"
    )
    rows = sorted((r.age, r.work, r.income) for r in df.collect())
    assert rows == [(25, "Local", "<=50K"), (39, "Private", "<=50K"), (40, None, ">50K")]


def test_json_array_and_routes(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"x1": 1.0, "group": "a", "target": 1}, {"x1": 2.0, "group": "b", "target": 0}]))
    assert R.read_json_records(spark, str(tmp_path / "r.json"), "x1 double, group string, target int").count() == 2
    stops = {
        "p": {"lat": 1.0, "lng": 2.0, "type": "Station"}, "q": {"lat": 3.0, "lng": 6.0, "type": "Dropoff"},
        "bad": {"lat": "n/a", "lng": 1.0, "type": "Dropoff"}, "none": {"lat": None, "lng": 1.0, "type": "Dropoff"},
    }
    routes = {
        "r1": {"route_score": "High", "station_code": "S", "departure_time_utc": "07:30:00", "stops": stops},
        "r2": {"route_score": " ", "stops": stops},
        "r3": {"route_score": "Low", "stops": {"p": {"lat": 1, "lng": 1, "type": "x"}}},
    }
    (tmp_path / "routes.json").write_text(json.dumps(routes))
    got = R.nested_stop_features(R.read_routes(spark, str(tmp_path / "routes.json"))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.route_id, r.num_stops_total, r.num_dropoffs, r.lat_mean, r.lng_mean) == ("r1", 2.0, 1.0, 2.0, 4.0)
    assert (r.lat_std, r.lng_std, r.bbox_area) == (1.0, 2.0, 8.0) and r.radial_dispersion == pytest.approx(5**0.5)


def test_registry(spark, tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text(
        "provenance_records:\n"
        "  - {dataset_name: orders, dataset_type: REAL_EXTERNAL, sensitive_origin: REPORTED_DEMOGRAPHIC}\n"
    )
    reg = REG.load_provenance(spark, str(path))
    r = reg.first()
    assert (r.dataset_type, r.sensitive_origin, r.redistribution_status) == ("REAL_DATA", "REAL_OBSERVED", "RESTRICTED")
    df = spark.createDataFrame([("orders",), ("other",)], "name string")
    got = {x.name: x.sensitive_origin for x in REG.lookup(df, reg, "name").collect()}
    assert got == {"orders": "REAL_OBSERVED", "other": None}


def test_json_sink_keeps_nulls_and_order(spark, tmp_path):
    S.write_json(spark.createDataFrame([(2, None)], "b int, a string"), str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert text.strip() == '{"a":null,"b":2}'
