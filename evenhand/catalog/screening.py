"""Data quality, leakage, contamination, split overlap, text hygiene, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.catalog.registry import EVENT_SQL, ORDER_SQL, event_frame, order_frame, query, table
from evenhand.operators import leakage as G
from evenhand.operators import quality as Q
from evenhand.operators.frames import ColumnRoles


def copies(spark, sf):
    """Line items without the key columns: repeated rows exist."""
    return table(spark, sf, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")


@query(
    "duplicate_rows",
    """WITH G AS (SELECT count(*) AS k FROM lineitem GROUP BY l_linenumber, l_quantity, l_discount, l_tax, l_returnflag)
SELECT CAST(sum(k) AS BIGINT) AS row_count, CAST(sum(k - 1) AS BIGINT) AS duplicate_count,
  sum(k - 1) / sum(k) AS duplicate_fraction FROM G""",
)
def duplicate_rows(spark, sf):
    return Q.duplicate_rows(copies(spark, sf))


@query(
    "duplicate_documents",
    """WITH G AS (SELECT count(*) AS k FROM documents GROUP BY text, lang)
SELECT CAST(sum(k) AS BIGINT) AS row_count, CAST(sum(k - 1) AS BIGINT) AS duplicate_count,
  sum(k - 1) / sum(k) AS duplicate_fraction FROM G""",
)
def duplicate_documents(spark, sf):
    return Q.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


@query(
    "domain_negatives",
    """SELECT 'trip_distance' AS column_name, count(*) FILTER (WHERE value - 40 < 0) AS negative_count FROM events UNION ALL
SELECT 'travel_time', count(*) FILTER (WHERE value - 5 < 0) FROM events""",
)
def domain_negatives(spark, sf):
    v = F.col("value")
    e = table(spark, sf, "events").select(
        "event_id", (v - 40).alias("trip_distance"), (v - 5).alias("travel_time"), (v - 9).alias("balance")
    )
    return Q.negative_values(e)


@query(
    "json_depth",
    """SELECT depth, count(*) AS n FROM (SELECT CASE WHEN json_type(props) IN ('OBJECT', 'ARRAY')
  THEN 2 ELSE 1 END AS depth FROM events) GROUP BY depth""",
)
def json_depth(spark, sf):
    e = table(spark, sf, "events").select(Q.json_depth("props").alias("depth"))
    return e.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_depth_nested",
    """SELECT depth, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 4 WHEN 'error' THEN 1
  WHEN 'click' THEN 2 ELSE 3 END AS depth FROM events) GROUP BY depth""",
)
def json_depth_nested(spark, sf):
    """The JSON text of every event wrapped to a depth that follows from its type."""
    e = nested_props(spark, sf).select(Q.json_depth("props").alias("depth"))
    return e.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("json_depth_limit", "SELECT event_id, event_type = 'view' AS too_deep FROM events")
def json_depth_limit(spark, sf):
    """Events whose text nests deeper than three levels."""
    return Q.within_depth(nested_props(spark, sf), "props", 3).select("event_id", "too_deep")


def nested_props(spark, sf):
    p = F.col("props")
    wrapped = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('{"a{[": ['), p, F.lit(", {}]}")))
        .when(F.col("event_type") == "error", F.lit("{ }"))
        .when(F.col("event_type") == "click", p)
        .otherwise(F.concat(F.lit('{"q\\"}": '), p, F.lit(', "z": []}')))
    )
    return table(spark, sf, "events").select("event_id", "event_type", wrapped.alias("props"))


def feature_table(spark, sf):
    """Orders with a copy, an inverse, a near copy and honest features."""
    o = order_frame(spark, sf)
    return o.select(
        "y_true",
        F.col("y_true").alias("flag_copy"),
        (1 - F.col("y_true")).alias("flag_inverse"),
        (F.col("y_true") + F.col("c_acctbal") / 1e6).alias("near_copy"),
        F.col("o_totalprice").alias("actual_time"),
        F.col("c_acctbal").alias("future_outcome_flag"),
        "o_totalprice",
        "nation",
        F.col("o_orderpriority").alias("priority_label"),
    )


FEATURES_SQL = f"""WITH {ORDER_SQL}, X AS (SELECT y_true, y_true AS flag_copy, 1 - y_true AS flag_inverse,
  y_true + c_acctbal / 1e6 AS near_copy, o_totalprice AS actual_time, c_acctbal AS future_outcome_flag, o_totalprice,
  nation, o_orderpriority AS priority_label FROM O)"""


@query(
    "target_copy_check",
    f"""{FEATURES_SQL}
SELECT 'flag_copy' AS feature_name, count(*) FILTER (WHERE flag_copy <> y_true) = 0 AS is_copy,
  count(*) FILTER (WHERE flag_copy <> 1 - y_true) = 0 AS is_inverse FROM X UNION ALL
SELECT 'flag_inverse', count(*) FILTER (WHERE flag_inverse <> y_true) = 0, count(*) FILTER (WHERE flag_inverse <> 1 - y_true) = 0 FROM X UNION ALL
SELECT 'near_copy', count(*) FILTER (WHERE near_copy <> y_true) = 0, count(*) FILTER (WHERE near_copy <> 1 - y_true) = 0 FROM X UNION ALL
SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice <> y_true) = 0, count(*) FILTER (WHERE o_totalprice <> 1 - y_true) = 0 FROM X""",
)
def target_copy_check(spark, sf):
    stats = G.target_statistics(
        feature_table(spark, sf), "y_true", ["flag_copy", "flag_inverse", "near_copy", "o_totalprice"]
    )
    return stats.select("feature_name", "is_copy", "is_inverse")


@query(
    "target_correlation",
    f"""{FEATURES_SQL}
SELECT 'near_copy' AS feature_name, count(*) AS pairs, round(corr(near_copy, y_true), 8) AS correlation FROM X UNION ALL
SELECT 'actual_time', count(*), round(corr(actual_time, y_true), 8) FROM X UNION ALL
SELECT 'nation', count(*), round(corr(nation, y_true), 8) FROM X UNION ALL
SELECT 'priority_label', CAST(0 AS BIGINT), NULL FROM X GROUP BY 1""",
)
def target_correlation(spark, sf):
    stats = G.target_statistics(
        feature_table(spark, sf), "y_true", ["near_copy", "actual_time", "nation", "priority_label"]
    )
    return stats.select("feature_name", "pairs", F.round("correlation", 8).alias("correlation"))


@query(
    "name_semantics",
    f"""{FEATURES_SQL}, N AS (SELECT unnest(['flag_copy', 'flag_inverse', 'near_copy', 'actual_time', 'future_outcome_flag',
  'o_totalprice', 'nation', 'priority_label']) AS feature_name), K AS (SELECT count(*) AS n FROM X)
SELECT feature_name, feature_name = 'actual_time' AS post_outcome,
  CASE feature_name WHEN 'actual_time' THEN 'actual_time' WHEN 'future_outcome_flag' THEN 'outcome,future_outcome'
       WHEN 'priority_label' THEN 'label' ELSE '' END AS words, n AS pairs_checked FROM N, K""",
)
def name_semantics(spark, sf):
    frame = feature_table(spark, sf)
    stats = G.name_semantics(G.target_statistics(frame, "y_true", [c for c in frame.columns if c != "y_true"]))
    return stats.select(
        "feature_name", "post_outcome", F.array_join("suspicious_words", ",").alias("words"),
        F.col("rows").alias("pairs_checked"),
    )


@query(
    "leakage_findings",
    f"""{FEATURES_SQL}, C AS (SELECT corr(near_copy, y_true) AS r FROM X)
SELECT 'flag_copy' AS feature_name, 'CONFIRMED_LEAKAGE' AS status, 'CRITICAL' AS severity, 1.0::DOUBLE AS metric_value UNION ALL
SELECT 'flag_inverse', 'CONFIRMED_LEAKAGE', 'CRITICAL', -1.0 UNION ALL
SELECT 'near_copy', CASE WHEN abs(r) > 0.999 THEN 'CONFIRMED_LEAKAGE' ELSE 'SUSPICIOUS_FEATURE' END,
  CASE WHEN abs(r) > 0.999 THEN 'CRITICAL' ELSE 'HIGH' END, round(r, 8) FROM C WHERE abs(r) >= 0.98 UNION ALL
SELECT 'actual_time', 'CONFIRMED_LEAKAGE', 'HIGH', NULL UNION ALL
SELECT 'future_outcome_flag', 'SUSPICIOUS_FEATURE', 'HIGH', NULL UNION ALL
SELECT 'priority_label', 'SUSPICIOUS_FEATURE', 'HIGH', NULL""",
)
def leakage_findings(spark, sf):
    found = G.feature_findings(feature_table(spark, sf), "y_true")
    return found.select("feature_name", "status", "severity", F.round("metric_value", 8).alias("metric_value"))


NUMBERS = ["o_totalprice", "c_acctbal", "nation"]


@query(
    "group_contamination",
    f"""WITH {ORDER_SQL}, K AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS code FROM (SELECT DISTINCT grp FROM O)),
X AS (SELECT O.*, code FROM O JOIN K USING (grp))
SELECT 'o_totalprice' AS feature_name, count(*) AS pairs, round(corr(o_totalprice, code), 7) AS correlation,
  abs(corr(o_totalprice, code)) >= 0.2 AS contaminated FROM X UNION ALL
SELECT 'c_acctbal', count(*), round(corr(c_acctbal, code), 7), abs(corr(c_acctbal, code)) >= 0.2 FROM X UNION ALL
SELECT 'nation', count(*), round(corr(nation, code), 7), abs(corr(nation, code)) >= 0.2 FROM X""",
)
def group_contamination(spark, sf):
    out = G.group_correlations(order_frame(spark, sf), NUMBERS)
    return out.withColumn("correlation", F.round("correlation", 7))


def _anova_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature_name, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n,
  round((sum(n * (m - t) * (m - t)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))), 5) AS f_statistic
FROM (SELECT grp, count({c}) AS n, avg({c}) AS m, sum(({c} - gm) * ({c} - gm)) AS ss, any_value(tm) AS t
      FROM (SELECT grp, {c}, avg({c}) OVER (PARTITION BY grp) AS gm, avg({c}) OVER () AS tm FROM O) GROUP BY grp)"""


@query("anova_f", f"WITH {ORDER_SQL} " + " UNION ALL ".join(_anova_sql(c) for c in NUMBERS))
def anova_f(spark, sf):
    out = G.group_separation(order_frame(spark, sf), NUMBERS)
    return out.select("feature_name", "groups", "n", F.round("f_statistic", 5).alias("f_statistic"))


def _shift_sql(c: str) -> str:
    return _anova_sql(c).replace(f"'{c}' AS", f"'{c}_shifted' AS")


@query("anova_f_shifted", f"WITH {ORDER_SQL} " + " UNION ALL ".join(_shift_sql(c) for c in ("nation", "y_true")))
def anova_f_shifted(spark, sf):
    """Features moved by 2**50, as times in microseconds are: the F ratio must not change."""
    o = order_frame(spark, sf)
    moved = o.select("grp", *[(F.col(c).cast("double") + F.lit(float(1 << 50))).alias(f"{c}_shifted") for c in ("nation", "y_true")])
    out = G.group_separation(moved, ["nation_shifted", "y_true_shifted"])
    return out.select("feature_name", "groups", "n", F.round("f_statistic", 5).alias("f_statistic"))


@query(
    "group_contamination_numeric",
    f"""WITH {ORDER_SQL} SELECT 'o_totalprice' AS feature_name, count(*) AS pairs, round(corr(o_totalprice, nation), 7) AS correlation,
  abs(corr(o_totalprice, nation)) >= 0.2 AS contaminated FROM O UNION ALL
SELECT 'nation', count(*), round(corr(nation, nation), 7), abs(corr(nation, nation)) >= 0.2 FROM O""",
)
def group_contamination_numeric(spark, sf):
    """A numeric group counts with its value, not with its place among the labels."""
    o = order_frame(spark, sf).withColumn("grp", F.col("nation"))
    out = G.group_correlations(o, ["o_totalprice", "nation"])
    return out.withColumn("correlation", F.round("correlation", 7))


def _report_sql() -> str:
    """The F tail by the continued fraction of the incomplete beta function, 400 terms of a recursive table."""
    anova = " UNION ALL ".join(_anova_sql(c).replace(", 5) AS f_statistic", ", 15) AS f") for c in NUMBERS)
    corr = " UNION ALL ".join(f"SELECT '{c}' AS feature_name, count(*) AS pairs, corr({c}, code) AS r FROM X" for c in NUMBERS)
    return f"""WITH RECURSIVE {ORDER_SQL}, K AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS code FROM (SELECT DISTINCT grp FROM O)),
X AS (SELECT O.*, code FROM O JOIN K USING (grp)), RR AS ({corr}),
A AS (SELECT feature_name, f, (groups - 1)::DOUBLE AS d1, (n - groups)::DOUBLE AS d2 FROM ({anova})),
B AS (SELECT *, d2 / 2 AS a, d1 / 2 AS b, d2 / (d2 + d1 * f) AS x FROM A),
P AS (SELECT *, x < (a + 1) / (a + b + 2) AS low, CASE WHEN x < (a + 1) / (a + b + 2) THEN a ELSE b END AS p, CASE WHEN x < (a + 1) / (a + b + 2) THEN b ELSE a END AS q,
  CASE WHEN x < (a + 1) / (a + b + 2) THEN x ELSE 1 - x END AS y FROM B),
T AS (SELECT feature_name, 0 AS m, 1.0::DOUBLE AS c, 1 / (1 - (p + q) * y / (p + 1)) AS d, 1 / (1 - (p + q) * y / (p + 1)) AS h FROM P
  UNION ALL SELECT feature_name, m + 1, 1 + odd / c1, 1 / (1 + odd * d1), h1 * (1 + odd / c1) / (1 + odd * d1) FROM (
    SELECT feature_name, m, odd, 1 + even / c AS c1, 1 / (1 + even * d) AS d1, h * (1 + even / c) / (1 + even * d) AS h1 FROM (
      SELECT T.*, (m + 1) * (q - m - 1) * y / ((p + 2 * m + 1) * (p + 2 * m + 2)) AS even, -(p + m + 1) * (p + q + m + 1) * y / ((p + 2 * m + 2) * (p + 2 * m + 3)) AS odd
      FROM T JOIN P USING (feature_name) WHERE m < 400))),
Q AS (SELECT feature_name, f, CASE WHEN low THEN v ELSE 1 - v END AS pv FROM (
  SELECT P.*, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / p AS v FROM P JOIN T USING (feature_name) WHERE m = 400))
SELECT feature_name, pairs, round(r, 7) AS correlation, abs(r) >= 0.2 AS contaminated, round(f, 5) AS f_statistic, round(pv, 9) AS p_value,
  pv < 0.001 AS separated, abs(r) >= 0.2 OR pv < 0.001 AS heavily_contaminated FROM RR JOIN Q USING (feature_name)"""


@query("contamination_report", _report_sql())
def contamination_report(spark, sf):
    """Correlation and ANOVA verdicts with the p-value of the F ratio."""
    out = G.contamination_report(order_frame(spark, sf), NUMBERS)
    return out.withColumns({"correlation": F.round("correlation", 7), "f_statistic": F.round("f_statistic", 5), "p_value": F.round("p_value", 9)})


SPLIT_SQL = f"""WITH {EVENT_SQL}, X AS (SELECT *, CASE WHEN row_id % 5 < 3 THEN 'train' WHEN row_id % 5 = 3 THEN 'val'
  ELSE 'test' END AS split FROM E)"""


def split_events(spark, sf):
    """All events, split by key remainder; users cross the splits."""
    part = F.pmod("row_id", F.lit(5))
    return event_frame(spark, sf).withColumn(
        "split", F.when(part < 3, "train").when(part == 3, "val").otherwise("test")
    )


def _pair_sql(name: str, a: str, b: str) -> str:
    return f"""SELECT '{name}' AS split_pair, (SELECT count(*) FROM X a JOIN X b ON a.entity_id = b.entity_id
    AND a.event_type = b.event_type AND a.split = '{a}' AND b.split = '{b}') AS overlap_count,
  (SELECT count(*) FROM X b WHERE b.split = '{b}' AND EXISTS (SELECT 1 FROM X a WHERE a.split = '{a}'
    AND a.entity_id = b.entity_id AND a.event_type = b.event_type)) AS overlap_rows,
  (SELECT count(*) FROM X WHERE split = '{b}') AS right_rows"""


@query(
    "split_overlap",
    f"""{SPLIT_SQL}, P AS ({_pair_sql("Train vs Test", "train", "test")} UNION ALL
{_pair_sql("Train vs Validation", "train", "val")} UNION ALL {_pair_sql("Validation vs Test", "val", "test")})
SELECT split_pair, overlap_count, overlap_count / right_rows AS overlap_fraction, overlap_rows,
  overlap_rows / right_rows AS overlap_row_fraction, 'CONFIRMED_LEAKAGE' AS status,
  CASE WHEN overlap_count / right_rows > 0.05 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM P""",
)
def split_overlap(spark, sf):
    out = G.split_overlap(split_events(spark, sf), ["entity_id", "event_type"]).drop("dataset")
    return out.withColumn("overlap_count", F.col("overlap_count").cast("bigint"))


@query(
    "integrity_report",
    f"""{SPLIT_SQL}, P AS (SELECT 'Train vs Test' AS s, 'train' AS a, 'test' AS b UNION ALL
  SELECT 'Train vs Validation', 'train', 'val' UNION ALL SELECT 'Validation vs Test', 'val', 'test'),
K AS (SELECT split, ts, value, count(*) AS n FROM X GROUP BY split, ts, value),
J AS (SELECT s, sum(ka.n * kb.n) AS c FROM P JOIN K ka ON ka.split = a JOIN K kb ON kb.split = b
      AND ka.ts = kb.ts AND ka.value = kb.value GROUP BY s)
SELECT 'split' AS kind, s AS subject, 'CONFIRMED_LEAKAGE' AS status, 'HIGH' AS severity, CAST(c AS DOUBLE) AS value,
  true AS critical FROM J UNION ALL
SELECT 'feature', 'event_label', 'SUSPICIOUS_FEATURE', 'HIGH', NULL, false FROM (SELECT count(*) FROM X)""",
)
def integrity_report(spark, sf):
    frame = split_events(spark, sf).select(
        "y_true", "split", "ts", "value", F.col("event_type").alias("event_label")
    )
    return G.integrity_report(frame, "y_true", keys=["ts", "value"])


@query(
    "ingest_manifest",
    """WITH P AS (SELECT o_custkey, count(*) AS r FROM orders GROUP BY o_custkey), T AS (SELECT count(*) AS n FROM orders)
SELECT 'orders' AS dataset_name, n AS row_count, 7 AS column_count, CAST(0 AS BIGINT) AS duplicate_row_count,
  (SELECT count(*) FROM P) AS entity_count, (SELECT min(r) FROM P) AS min_rows_per_entity,
  (SELECT avg(r) FROM P) AS mean_rows_per_entity, (SELECT max(r) FROM P) AS max_rows_per_entity,
  CAST(0 AS BIGINT) AS leakage_findings_count, false AS has_critical_leakage, 'PASSED_WITH_WARNINGS' AS status,
  1 AS message_count FROM T""",
)
def ingest_manifest(spark, sf):
    frame = table(spark, sf, "orders").withColumn("decided", (F.col("o_orderstatus") == "F").cast("int"))
    m = Q.ingest_manifest(
        frame.drop("o_orderstatus").withColumn("lane", F.substring("o_orderpriority", 1, 1)),
        "orders",
        ColumnRoles(target="decided", sensitive=["o_orderpriority"], grouping="o_custkey", unit_key="o_custkey"),
    )
    return m.select(
        "dataset_name", "row_count", "column_count", "duplicate_row_count", "entity_count", "min_rows_per_entity",
        "mean_rows_per_entity", "max_rows_per_entity", "leakage_findings_count", "has_critical_leakage", "status",
        F.size("validation_messages").alias("message_count"),
    )


@query(
    "ingest_rejections",
    """WITH T AS (SELECT count(*) AS n FROM orders)
SELECT 'absent' AS dataset_name, CAST(0 AS BIGINT) AS row_count, 'REJECTED_SCHEMA' AS status FROM T UNION ALL
SELECT 'banned', n, 'REJECTED_LEAKAGE' FROM T UNION ALL
SELECT 'one_class', n, 'REJECTED_MALFORMED' FROM T UNION ALL
SELECT 'large', CAST(0 AS BIGINT), 'REJECTED_SIZE' FROM T""",
)
def ingest_rejections(spark, sf):
    o = table(spark, sf, "orders").withColumn("decided", (F.col("o_orderstatus") == "F").cast("int"))
    roles = ColumnRoles(target="decided", sensitive=["o_orderpriority"])
    frame = o.drop("o_orderstatus")
    cases = [
        Q.ingest_manifest(frame, "absent", ColumnRoles(target="nothing", sensitive=["o_orderpriority"])),
        Q.ingest_manifest(frame.withColumnRenamed("o_orderdate", "actual_time"), "banned", roles, banned=["actual_time"]),
        Q.ingest_manifest(frame.withColumn("decided", F.lit(1)), "one_class", roles),
        Q.ingest_manifest(frame, "large", roles, max_rows=10),
    ]
    out = cases[0]
    for c in cases[1:]:
        out = out.unionByName(c)
    return out.select("dataset_name", "row_count", "status")


@query(
    "required_columns",
    """SELECT role, column_name, (SELECT count(*) FROM orders) AS table_rows FROM (VALUES ('target', 'decided'),
  ('sensitive', 'region'), ('unit_key', 'trip')) t(role, column_name)""",
)
def required_columns(spark, sf):
    from evenhand.operators.frames import missing_columns

    orders = table(spark, sf, "orders")
    roles = ColumnRoles(target="decided", sensitive=["region", "o_orderpriority"], unit_key="trip")
    found = spark.createDataFrame([(m,) for m in missing_columns(orders, roles)], "message string")
    n = orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.select(
        F.element_at(F.split("message", " "), 1).alias("role"),
        F.regexp_extract("message", "'(.*)'", 1).alias("column_name"),
        n.alias("table_rows"),
    )


# --- text hygiene ------------------------------------------------------------------------------

E_RE = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
S_RE = r"(?:(?:sk|ghp|AKIA)[-_a-zA-Z0-9]{16,}|-----BEGIN (?:RSA )?PRIVATE KEY-----)"
# the SQL engine has no look-behind: the character before a path is a group of its own
P_RE = r"""([\s"\''(=]|^)((?:[a-zA-Z]:[\\/]|/(?:home|Users))[a-zA-Z0-9_\\/.-]+)"""


def _hygiene_sql(name: str, keys: str, text: str) -> str:
    return f"""WITH X AS (SELECT {keys}, list_sort(list_distinct(regexp_extract_all({text}, '{E_RE}'))) AS e,
  list_sort(list_distinct(list_filter(regexp_extract_all({text}, '{P_RE}', 2),
    lambda q: NOT (q LIKE '%..' OR lower(q) LIKE '%placeholder%')))) AS p,
  list_sort(list_distinct(regexp_extract_all({text}, '{S_RE}'))) AS s FROM {name})
SELECT {keys}, array_to_string(e, '|') AS emails, array_to_string(p, '|') AS local_paths,
  array_to_string(s, '|') AS secrets, CAST(len(e) + len(p) + len(s) AS INT) AS total_found,
  len(e) + len(p) + len(s) = 0 AS clean FROM X"""


def _hygiene(spark, sf, name, keys, text):
    out = Q.hygiene_scan(table(spark, sf, name), text, keys, sanitize=False)
    return out.select(
        *keys,
        *[F.array_join(c, "|").alias(c) for c in ("emails", "local_paths", "secrets")],
        "total_found",
        "clean",
    )


@query("hygiene_scan", _hygiene_sql("documents", "doc_id", "text"))
def hygiene_scan(spark, sf):
    return _hygiene(spark, sf, "documents", ["doc_id"], "text")


@query("hygiene_scan_pages", _hygiene_sql("pages", "page_id", "html"))
def hygiene_scan_pages(spark, sf):
    return _hygiene(spark, sf, "pages", ["page_id"], "html")


@query("hygiene_scan_conversations", _hygiene_sql("conversations", "conv_id, turn", "text"))
def hygiene_scan_conversations(spark, sf):
    return _hygiene(spark, sf, "conversations", ["conv_id", "turn"], "text")


@query(
    "hygiene_redacted",
    f"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{E_RE}', '[EMAIL_REDACTED]', 'g'),
  '{P_RE}', '\\1[PATH_REDACTED]', 'g'), '{S_RE}', '[SECRET_REDACTED]', 'g')) AS redacted FROM documents""",
)
def hygiene_redacted(spark, sf):
    out = Q.hygiene_scan(table(spark, sf, "documents"), "text", ["doc_id"])
    return out.select("doc_id", F.md5("sanitized").alias("redacted"))


@query(
    "table_fingerprint",
    """WITH X AS (SELECT sha256(concat('{"c_custkey":', c_custkey, ',"c_nationkey":', c_nationkey,
    ',"c_mktsegment":"', c_mktsegment, '"}')) AS d FROM customer)
SELECT count(*) AS row_count, CAST(sum(('0x' || substr(d, 1, 8))::BIGINT) AS BIGINT) AS part_0,
  CAST(sum(('0x' || substr(d, 9, 8))::BIGINT) AS BIGINT) AS part_1,
  CAST(sum(('0x' || substr(d, 17, 8))::BIGINT) AS BIGINT) AS part_2,
  CAST(sum(('0x' || substr(d, 25, 8))::BIGINT) AS BIGINT) AS part_3 FROM X""",
)
def table_fingerprint(spark, sf):
    out = Q.table_fingerprint(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    return out.select("row_count", *[F.col(f"part_{i}").cast("bigint").alias(f"part_{i}") for i in range(4)])
