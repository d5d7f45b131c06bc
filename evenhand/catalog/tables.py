"""Readers and sinks: what is written must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenhand.catalog.governance import SOURCES, source_suites
from evenhand.catalog.registry import query, table
from evenhand.catalog.reporting import governed
from evenhand.operators.frames import ColumnRoles, audit_frame
from evenhand.plans import documents as D
from evenhand.sources import readers as R
from evenhand.sources import sinks as S


@query("parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def parquet_scan(spark, sf):
    """Two columns and the filter reach the scan."""
    o = R.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])
    return o.filter(F.col("o_totalprice") > 250000)


@query("csv_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def csv_scan(spark, sf):
    path = S.scratch_path(spark, "orders-csv")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    S.write_csv(o, path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return R.good_rows(R.read_csv(spark, path, schema))


@query(
    "csv_malformed",
    "SELECT count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS malformed, count(*) AS n FROM orders",
)
def csv_malformed(spark, sf):
    """Low-priority orders carry a price that is no number."""
    path = S.scratch_path(spark, "orders-bad")
    low = F.col("o_orderpriority") == "5-LOW"
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(low, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice")
    )
    S.write_csv(o, path)
    df = R.read_csv(spark, path, "o_orderkey bigint, o_totalprice double")
    return R.parse_report(df).select("malformed", "n")


@query(
    "csv_headerless",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN c_acctbal > 0 THEN 'up' ELSE 'down' END AS label FROM customer UNION ALL
SELECT c_custkey, c_mktsegment, 'again' FROM customer""",
)
def csv_headerless(spark, sf):
    """Two stacked files without header; one with a banner line, ``?`` and dotted labels."""
    c = table(spark, sf, "customer")
    first = S.scratch_path(spark, "adult-a")
    second = S.scratch_path(spark, "adult-b")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "?").otherwise(F.col("c_mktsegment"))
    lines = c.select(
        F.concat(
            F.col("c_custkey").cast("string"), F.lit(", "), segment, F.lit(", "),
            F.when(F.col("c_acctbal") > 0, "up.").otherwise("down."),
        ).alias("value")
    )
    banner = spark.createDataFrame([("|1x3 Cross validator",)], "value string")
    banner.unionByName(lines).write.text(first)
    c.select(F.concat_ws(", ", F.col("c_custkey").cast("string"), "c_mktsegment", F.lit("again")).alias("value")).write.text(second)
    return R.good_rows(R.read_headerless_csv(
        spark, [first, second], "c_custkey bigint, segment string, label string", label="label"
    ))


@query("json_records", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def json_records(spark, sf):
    """Arrays of records, one file per supplier nation."""
    s = table(spark, sf, "supplier")
    path = S.scratch_path(spark, "suppliers-json")
    arrays = s.groupBy("s_nationkey").agg(
        F.to_json(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))).alias("value")
    )
    arrays.repartition(4).select("value").write.option("lineSep", "\n").text(path)
    return R.read_json_lines(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("json_array", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def json_array(spark, sf):
    """Every document through array files that are read by byte range."""
    path = S.scratch_path(spark, "documents-array")
    S.write_json_array(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", "text"), path)
    back = R.read_json_records(spark, path, "doc_id bigint, lang string, source string, n_chars bigint, text string")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "json_malformed",
    r"""WITH M AS (SELECT event_id, event_id % 7 AS k, event_type FROM events),
T AS (SELECT *, CASE k WHEN 1 THEN '{"event_id" ' || event_id || '}' WHEN 2 THEN '{"event_id": "no", "event_type": "' || event_type || '"}'
  WHEN 3 THEN '[' || event_id || ', tru]' WHEN 4 THEN '"say \"hi, ]{' || event_id || '" : x' END AS kept FROM M)
SELECT CASE WHEN kept IS NULL THEN 'parsed' ELSE 'kept' END AS outcome, CASE WHEN k IN (1, 3, 4) THEN NULL ELSE event_type END AS event_type,
  count(*) AS n, CAST(sum(CASE WHEN kept IS NULL THEN event_id END) AS BIGINT) AS ids, CAST(sum(length(kept)) AS BIGINT) AS kept_chars FROM T GROUP BY 1, 2""",
)
def json_malformed(spark, sf):
    """Arrays with broken entries between good ones: unclosed pairs, wrong types, bad words, brackets inside strings."""
    path = S.scratch_path(spark, "events-malformed")
    k, i, e = F.pmod("event_id", F.lit(7)), F.col("event_id").cast("string"), F.col("event_type")
    text = (
        F.when(k == 1, F.concat(F.lit('{"event_id" '), i, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"event_id": "no", "event_type": "'), e, F.lit('"}')))
        .when(k == 3, F.concat(F.lit("["), i, F.lit(", tru]")))
        .when(k == 4, F.concat(F.lit('"say \\"hi, ]{'), i, F.lit('" : x')))
        .otherwise(F.to_json(F.struct("event_id", "event_type")))
    )
    S.write_framed_json(table(spark, sf, "events").select(text.alias("value")), path)
    rows = R.read_json_array(spark, path, "event_id bigint, event_type string")
    outcome = F.when(F.col(R.BAD).isNull(), "parsed").otherwise("kept")
    return rows.groupBy(outcome.alias("outcome"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.sum(F.length(R.BAD)).cast("bigint").alias("kept_chars")
    )


@query("json_sink", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def json_sink(spark, sf):
    path = S.scratch_path(spark, "customer-json")
    S.write_json(table(spark, sf, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), path)
    return R.read_json_lines(spark, path, "c_custkey bigint, c_acctbal double, c_mktsegment string")


@query(
    "keyed_json",
    "SELECT event_id, 'k' AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS record FROM events",
)
def keyed_json(spark, sf):
    return R.explode_keyed(table(spark, sf, "events").select("event_id", "props"), "props", "bigint").drop("props")


@query(
    "sanitized_csv",
    """SELECT doc_id, CASE WHEN regexp_matches(head, '^[=+\\-@\\t\\r]') THEN '''' || head ELSE head END AS head FROM
(SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN ';' ELSE 'x' END
  || lang AS head FROM documents)""",
)
def sanitized_csv(spark, sf):
    path = S.scratch_path(spark, "documents-safe")
    k = F.pmod("doc_id", F.lit(7))
    lead = F.when(k == 0, "=").when(k == 1, "+").when(k == 2, "-").when(k == 3, "@").when(k == 4, ";").otherwise("x")
    d = table(spark, sf, "documents").select("doc_id", F.concat(lead, "lang").alias("head"))
    S.write_csv(d, path, sanitize=True)
    return R.good_rows(R.read_csv(spark, path, "doc_id bigint, head string"))


@query("stable_cap", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def stable_cap(spark, sf):
    """A row-capped read is the feature here; the order makes the cap repeatable."""
    e = table(spark, sf, "events").select("event_id", "value")
    return R.stable_cap(e, [F.desc("value"), F.asc("event_id")], 100)


STOPS = """X AS (SELECT o_custkey AS route_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 7919 END AS lat,
  CAST(o_orderkey % 180 AS DOUBLE) AS lng, CASE WHEN o_orderstatus = 'F' THEN 'Dropoff' ELSE 'Station' END AS type FROM orders)"""


@query(
    "stop_features",
    f"""WITH {STOPS}, V AS (SELECT * FROM X WHERE lat IS NOT NULL),
B AS (SELECT route_id, count(*) AS k, avg(lat) AS la, avg(lng) AS lo FROM V GROUP BY route_id HAVING count(*) >= 2)
SELECT V.route_id, CAST(any_value(k) AS DOUBLE) AS num_stops_total,
  CAST(count(*) FILTER (WHERE type = 'Dropoff') AS DOUBLE) AS num_dropoffs, round(any_value(la), 7) AS lat_mean,
  round(any_value(lo), 7) AS lng_mean, round(stddev_pop(lat), 7) AS lat_std, round(stddev_pop(lng), 7) AS lng_std,
  round((max(lat) - min(lat)) * (max(lng) - min(lng)), 6) AS bbox_area,
  round(avg(sqrt((lat - la) ** 2 + (lng - lo) ** 2)), 7) AS radial_dispersion
FROM V JOIN B ON V.route_id = B.route_id GROUP BY V.route_id""",
)
def stop_features(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("route_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 7919).alias("lat"),
        F.pmod("o_orderkey", F.lit(180)).cast("double").alias("lng"),
        F.when(F.col("o_orderstatus") == "F", "Dropoff").otherwise("Station").alias("type"),
    )
    out = R.stop_features(o)
    digits = {"bbox_area": 6}
    return out.select(
        "route_id", "num_stops_total", "num_dropoffs",
        *[
            F.round(c, digits.get(c, 7)).alias(c)
            for c in ("lat_mean", "lng_mean", "lat_std", "lng_std", "bbox_area", "radial_dispersion")
        ],
    )


SHAPES = ["num_stops_total", "num_dropoffs", "lat_mean", "lng_mean", "lat_std", "lng_std", "bbox_area", "radial_dispersion"]


@query(
    "routes_json",
    f"""WITH {STOPS}, V AS (SELECT * FROM X WHERE lat IS NOT NULL AND route_id % 11 <> 0),
B AS (SELECT route_id, count(*) AS k, avg(lat) AS la, avg(lng) AS lo FROM V GROUP BY route_id HAVING count(*) >= 2)
SELECT CAST(V.route_id AS VARCHAR) AS route_id, any_value(c_mktsegment) AS route_score, 'N' || any_value(c_nationkey) AS station_code,
  CAST(any_value(k) AS DOUBLE) AS num_stops_total,
  CAST(count(*) FILTER (WHERE type = 'Dropoff') AS DOUBLE) AS num_dropoffs, round(any_value(la), 7) AS lat_mean,
  round(any_value(lo), 7) AS lng_mean, round(stddev_pop(lat), 7) AS lat_std, round(stddev_pop(lng), 7) AS lng_std,
  round((max(lat) - min(lat)) * (max(lng) - min(lng)), 6) AS bbox_area,
  round(avg(sqrt((lat - la) ** 2 + (lng - lo) ** 2)), 7) AS radial_dispersion
FROM V JOIN B ON V.route_id = B.route_id JOIN customer ON c_custkey = V.route_id GROUP BY V.route_id""",
)
def routes_json(spark, sf):
    """Route maps written as large keyed files and read by byte range; blank scores and routes with a point or none fall away."""
    stop = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 7919).cast("string").alias("lat"),
        F.pmod("o_orderkey", F.lit(180)).cast("string").alias("lng"),
        F.when(F.col("o_orderstatus") == "F", "Dropoff").otherwise("Station").alias("type"),
    )
    key = F.col("o_orderkey").cast("string")
    stops = table(spark, sf, "orders").groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(key, stop))).alias("stops"))
    score = F.when(F.pmod("c_custkey", F.lit(11)) == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))
    routes = stops.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_custkey").alias("route_id"), score.alias("route_score"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("station_code"), "stops"
    )
    path = S.scratch_path(spark, "routes-json")
    S.write_keyed_json(routes, "route_id", path)
    out = R.nested_stop_features(R.read_routes(spark, path))
    return out.select("route_id", "route_score", "station_code", *[F.round(c, 6 if c == "bbox_area" else 7).alias(c) for c in SHAPES])


@query(
    "score_lookup",
    """SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def score_lookup(spark, sf):
    scores = table(spark, sf, "labels").select("doc_id", "quality")
    return R.attach_scores(table(spark, sf, "documents").select("doc_id"), scores, "doc_id")


@query(
    "audit_input",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true, o_orderpriority || '_x_' || o_orderstatus AS grp,
  o_orderkey AS row_id, o_custkey AS holdout_key, o_totalprice FROM orders""",
)
def audit_input(spark, sf):
    o = table(spark, sf, "orders").withColumn("decided", (F.col("o_orderstatus") == "F").cast("int"))
    roles = ColumnRoles(
        target="decided", sensitive=["o_orderpriority", "o_orderstatus"], row_id="o_orderkey", grouping="o_custkey",
        features=["o_totalprice"],
    )
    return audit_frame(o, roles)


@query(
    "documents_roundtrip",
    f"{SOURCES} SELECT run, n AS total_records, true AS has_taxonomy, CAST(0 AS BIGINT) AS errors FROM S",
)
def documents_roundtrip(spark, sf):
    """Documents written, read back and checked."""
    docs = D.documents_as_json(
        D.build_documents(governed(source_suites(spark, sf)), "documents", "length rule", "2026-01-01T00:00:00Z")
    )
    path = S.scratch_path(spark, "audit-documents")
    S.write_documents(docs, path)
    back = R.read_documents(spark, path).withColumn("run", F.substring(F.get_json_object("document", "$.audit_id"), 7, 100))
    parsed = D.with_sections(back)
    errors = D.validate_documents(back).groupBy("run").agg(F.count(F.lit(1)).alias("errors"))
    out = parsed.select(
        "run", F.col("dataset")["total_records"].cast("bigint").alias("total_records"),
        F.col("taxonomy_state").isNotNull().alias("has_taxonomy"),
    ).join(errors, "run", "left")
    return out.withColumn("errors", F.coalesce("errors", F.lit(0)))
