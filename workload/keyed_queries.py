"""Keyed de-duplication, checks, lookups, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens.functions.codes import degree_type_std
from admitlens.operators import joins, keyed, quality
from admitlens.plans import integrate
from admitlens.plans.load import with_new_ids
from admitlens.sources import sinks
from admitlens.sources.readers import union_ids
from admitlens.streaming import resume
from workload.list_queries import SOURCES, source_documents
from workload.registry import query
from workload.views import Views, with_views


def bronze(v: Views) -> DataFrame:
    """Events as raw rows: the key repeats, the event id is the line."""
    e = v.table("events")
    return e.select(
        F.col("event_id").alias("line"), "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


BRONZE = """bronze AS (SELECT event_id AS line, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, value,
  CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"""
KEY = ["user_id", "event_type", "day"]


@query(
    "first_wins", "W2 W4 W19",
    f"WITH {BRONZE} SELECT * FROM bronze QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY line) = 1",
)
def first_wins(v: Views) -> DataFrame:
    return keyed.first_wins(bronze(v), KEY, "line")


@query(
    "last_wins", "W10 W20",
    f"WITH {BRONZE} SELECT * FROM bronze QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY line DESC) = 1",
)
def last_wins(v: Views) -> DataFrame:
    return keyed.last_wins(bronze(v), KEY, "line")


@query(
    "duplicate_rows", "W2 W3",
    f"WITH {BRONZE} SELECT * FROM bronze QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY line) > 1",
)
def duplicate_rows(v: Views) -> DataFrame:
    return keyed.later_rows(bronze(v), KEY, "line")


@query(
    "surplus_count", "A15",
    f"WITH {BRONZE} SELECT CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM bronze GROUP BY user_id, event_type, day)",
)
def surplus_count(v: Views) -> DataFrame:
    return keyed.surplus_count(bronze(v), KEY)


@query(
    "best_row", "W5 W6 W7 W9",
    """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_returnflag <> 'R', l_quantity DESC, year(l_shipdate) DESC,
      l_orderkey, l_linenumber, l_extendedprice) = 1""",
)
def best_row(v: Views) -> DataFrame:
    li = v.table("lineitem")
    rank = [F.col("l_returnflag") != "R", F.col("l_quantity").desc(), F.year("l_shipdate").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    kept = keyed.best_row(li, ["l_suppkey", "l_partkey"], rank, "l_extendedprice")
    return kept.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    "best_line", "W8 C18",
    with_views(
        "raw_lines",
        """SELECT year, line_type, university_id, partkey, total, margin FROM (SELECT *, l_returnflag AS line_type, total - p_size AS margin FROM raw_lines)
        QUALIFY row_number() OVER (PARTITION BY year, line_type, university_id, partkey ORDER BY total DESC, margin DESC) = 1""",
    ),
)
def best_line(v: Views) -> DataFrame:
    li = v.table("lineitem").join(v.part, F.col("l_partkey") == F.col("partkey"))
    rows = li.select(
        F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("line_type"), F.col("l_suppkey").alias("university_id"), "partkey",
        F.floor(F.col("l_extendedprice") / 210).cast("int").alias("total"), "p_size",
    ).withColumn("margin", F.col("total") - F.col("p_size"))
    order = [F.coalesce("total", F.lit(0)).desc(), F.coalesce("margin", F.lit(0)).desc()]
    return keyed.top_n(rows, ["year", "line_type", "university_id", "partkey"], order).drop("p_size")


@query(
    "collapsed_plans", "A13 C17",
    (
        """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS university_id, l_partkey AS major_id,
          CAST(sum(CASE WHEN l_discount > 0.05 THEN NULL ELSE l_quantity END) AS INTEGER) AS plan_count,
          arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS first_order, count(*) - 1 AS collapsed
        FROM lineitem GROUP BY 1, 2, 3"""
    ),
)
def collapsed_plans(v: Views) -> DataFrame:
    li = v.table("lineitem")
    count = F.when(~(F.col("l_discount") > 0.05), F.col("l_quantity"))
    return li.groupBy(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("university_id"), F.col("l_partkey").alias("major_id")).agg(
        F.sum(count).cast("int").alias("plan_count"),
        F.min_by("l_orderkey", F.struct("l_orderkey", "l_linenumber")).alias("first_order"),
        (F.count(F.lit(1)) - 1).alias("collapsed"),
    )


@query(
    "missing_schools", "J15",
    "SELECT c_custkey AS school_id, c_name AS school_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def missing_schools(v: Views) -> DataFrame:
    listed = v.table("customer").select(F.col("c_custkey").alias("school_id"), F.col("c_name").alias("school_name"))
    seen = v.table("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("school_id")).distinct()
    return keyed.null_safe_join(listed, seen, ["school_id"], "left_anti")


@query(
    "unresolved_keys", "V7 U5 U4",
    """SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
    UNION SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def unresolved_keys(v: Views) -> DataFrame:
    """Keys without a finished order."""
    a = v.table("lineitem").select(F.col("l_orderkey").cast("string").alias("key"))
    b = v.table("labels").select(F.col("doc_id").cast("string").alias("key"))
    keys = union_ids([a, b], "key")
    known = v.table("orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").cast("string").alias("key"), F.lit(1).alias("id"))
    return joins.unresolved(keys, known, ["key"]).select(F.col("key").cast("bigint").alias("key"))


@query(
    "surrogate_ids", "J11",
    with_views(
        "majors",
        """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_extendedprice, m.id AS major_id FROM lineitem
        LEFT JOIN (SELECT * FROM majors WHERE major_category <> 'PROMO') m
          ON m.university_id = l_suppkey AND m.major_code = CAST(l_partkey AS VARCHAR)""",
    ),
)
def surrogate_ids(v: Views) -> DataFrame:
    facts = v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", F.col("l_suppkey").alias("university_id"),
        F.col("l_partkey").cast("string").alias("major_code"),
    )
    dim = v.majors.filter(F.col("major_category") != "PROMO").select("university_id", "major_code", F.col("id").alias("major_id"))
    return joins.resolve(facts, dim, ["university_id", "major_code"], "major_id").drop("university_id", "major_code")


@query(
    "preview_ids", "J12",
    f"""WITH {BRONZE} SELECT user_id, event_type, -row_number() OVER (ORDER BY first_line) AS new_id FROM
      (SELECT user_id, event_type, min(line) AS first_line FROM bronze GROUP BY 1, 2)
    WHERE event_type <> 'view'""",
)
def preview_ids(v: Views) -> DataFrame:
    rows = bronze(v)
    known = rows.filter(F.col("event_type") == "view").select("user_id", "event_type").distinct()
    return keyed.new_key_ids(rows, known, ["user_id", "event_type"], "line", "new_id")


@query(
    "unique_key_match", "J9",
    """SELECT o.o_orderkey, x.l_linenumber, x.l_extendedprice FROM orders o LEFT JOIN
      (SELECT l_orderkey, max(l_linenumber) AS l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1 HAVING count(*) = 1) x
      ON x.l_orderkey = o.o_orderkey""",
)
def unique_key_match(v: Views) -> DataFrame:
    left = v.table("orders").select("o_orderkey", F.col("o_orderkey").alias("key"))
    right = v.table("lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_extendedprice")
    return joins.unique_match(left, right, ["key"]).drop("key")


@query(
    "code_fallback_match", "J10",
    """WITH levels AS (SELECT p_brand, p_name, arg_max(p_size, p_partkey) AS size, max(p_partkey) AS k FROM part WHERE p_size <= 30 GROUP BY 1, 2)
    SELECT p.p_partkey, coalesce(a.p_name, b.p_name) AS code, coalesce(a.size, b.size) AS size FROM part p
    LEFT JOIN levels a ON a.p_brand = p.p_brand AND a.p_name = p.p_name
    LEFT JOIN levels b ON b.p_brand = p.p_brand AND b.p_name = 'red ' || split_part(p.p_name, ' ', 2)""",
)
def code_fallback_match(v: Views) -> DataFrame:
    p = v.table("part")
    left = p.select(
        "p_partkey", "p_brand", F.col("p_name").alias("level2"), F.concat(F.lit("red "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("level1")
    )
    right = p.filter(F.col("p_size") <= 30).select("p_brand", F.col("p_name").alias("code"), F.col("p_size").alias("size"), F.col("p_partkey").alias("line"))
    return joins.first_code_match(left, right, ["p_brand"], ["level2", "level1"], "code", "line").select("p_partkey", "code", "size")


@query(
    "rating_conflicts", "A14",
    """SELECT p_brand, p_type, string_agg(level, '/' ORDER BY level) AS values, count(*) AS value_count FROM
      (SELECT DISTINCT p_brand, p_type, CASE WHEN p_size <= 10 THEN 'A' WHEN p_size <= 20 THEN 'B+' WHEN p_size <= 30 THEN 'B' END AS level FROM part)
    WHERE level IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
)
def rating_conflicts(v: Views) -> DataFrame:
    size = F.col("p_size")
    level = F.when(size <= 10, "A").when(size <= 20, "B+").when(size <= 30, "B")
    return quality.conflicting_values(v.table("part").withColumn("level", level), ["p_brand", "p_type"], "level")


@query(
    "one_to_one", "V6",
    """WITH pairs AS (SELECT DISTINCT p_name AS l, p_brand AS r FROM part)
    SELECT l AS value, count(*) AS partners, 'p_name' AS side FROM pairs GROUP BY 1 HAVING count(*) > 1
    UNION ALL SELECT r, count(*), 'p_brand' FROM pairs GROUP BY 1 HAVING count(*) > 1""",
)
def one_to_one(v: Views) -> DataFrame:
    return quality.not_one_to_one(v.table("part"), "p_name", "p_brand")


CHECKS = f"""WITH {BRONZE}, checked AS (
  SELECT line, 0 AS ord, 'k' AS field_name, 'invalid_range' AS issue_type, CAST(k AS VARCHAR) AS raw_value FROM bronze WHERE k NOT BETWEEN 10 AND 90
  UNION ALL SELECT line, 1, 'event_type', 'invalid_domain', event_type FROM bronze WHERE event_type NOT IN ('view', 'click', 'purchase')
  UNION ALL SELECT line, 2, 'value', 'missing_optional', '' FROM bronze WHERE value < 1.0)"""


def _issues(v: Views) -> DataFrame:
    rows = bronze(v).withColumn("value", F.when(F.col("value") >= 1.0, F.col("value")))
    key = F.concat(F.lit("line="), F.col("line"))
    checks = [
        F.when(~F.col("k").between(10, 90), quality.issue("events", "k", "invalid_range", F.col("k"), key, "check")),
        quality.domain_check("event_type", ["view", "click", "purchase"], "events", key, "invalid_domain", "check"),
        *quality.missing_checks(["value"], {"value": F.lit(None)}, "events", key, "missing_optional", "check"),
    ]
    return quality.collect_issues(rows, checks, ["line"])


@query(
    "quality_issues", "V1 V2 V3 V4 V5",
    CHECKS + """ SELECT row_number() OVER (ORDER BY line, ord) AS issue_id, line, field_name, issue_type, raw_value, 'line=' || line AS record_key FROM checked""",
)
def quality_issues(v: Views) -> DataFrame:
    staged = _issues(v).withColumn("_stage", F.lit(0))
    ids = keyed.consecutive_ids(staged, "_stage", "line", ["_ordinal"], "issue_id")
    return ids.select("issue_id", "line", "field_name", "issue_type", "raw_value", "record_key")


@query("issue_summary", "A16", CHECKS + " SELECT issue_type, count(*) AS n FROM checked GROUP BY 1")
def issue_summary(v: Views) -> DataFrame:
    return _issues(v).groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "constraint_violations", "V8",
    """SELECT 's_acctbal' AS field_name, 'invalid_format' AS issue_type, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS raw_value, s_name AS record_key
    FROM supplier WHERE floor(s_acctbal) < 0""",
)
def constraint_violations(v: Views) -> DataFrame:
    s = v.table("supplier").withColumn("s_acctbal", F.floor("s_acctbal"))
    found = quality.constraint_violations(s, "supplier", {"s_acctbal": F.col("s_acctbal") >= 0}, F.col("s_name"))
    return found.select("field_name", "issue_type", "raw_value", "record_key")


@query(
    "upsert_snapshot", "K3",
    """SELECT coalesce(t.id, s.id) AS id, CASE WHEN s.id IS NOT NULL THEN s.status ELSE t.status END AS status,
      CASE WHEN t.id IS NOT NULL THEN t.priority ELSE s.priority END AS priority
    FROM (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderdate < DATE '1999-01-01') t
    FULL JOIN (SELECT o_orderkey AS id, 'N' AS status, 'new' AS priority FROM orders WHERE o_orderdate >= DATE '1998-01-01') s ON s.id = t.id""",
)
def upsert_snapshot(v: Views) -> DataFrame:
    o = v.table("orders")
    target = o.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    )
    source = o.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        F.col("o_orderkey").alias("id"), F.lit("N").alias("status"), F.lit("new").alias("priority")
    )
    return sinks.upsert(target, source, ["id"], ["status"])


@query(
    "append_new", "K4",
    f"""WITH {BRONZE} SELECT * FROM (SELECT * FROM bronze WHERE day > '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY line DESC) = 1) s
    WHERE NOT EXISTS (SELECT 1 FROM bronze t WHERE t.day <= '2024-01-10' AND t.user_id = s.user_id AND t.event_type = s.event_type)""",
)
def append_new(v: Views) -> DataFrame:
    rows = bronze(v)
    return sinks.append_new(rows.filter("day <= '2024-01-10'"), rows.filter("day > '2024-01-10'"), ["user_id", "event_type"], "line")


@query(
    "new_ids", "K3",
    """SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS low, max(id) AS high FROM
      (SELECT row_number() OVER () AS id FROM part)""",
)
def new_ids(v: Views) -> DataFrame:
    """Ids of rows without one continue after the largest id and are dense."""
    p = v.table("part").select(
        F.when(F.col("p_partkey") < 100, F.col("p_partkey") + 1).alias("id"), F.col("p_partkey").alias("key")
    )
    ids = with_new_ids(p, ["key"])
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high"))


@query(
    "run_record", "K5 A25",
    """SELECT 'load' AS task_name, 'load' AS task_type, 'failed' AS status, 'in' AS input_path, 'out' AS output_path, count(*) AS total_count,
      count(*) FILTER (event_type <> 'error') AS success_count, count(*) FILTER (event_type = 'error') AS failed_count FROM events""",
)
def run_record(v: Views) -> DataFrame:
    return sinks.run_record(v.table("events"), F.col("event_type") == "error", "load", "load", "in", "out")


@query(
    "latest_source", "J19",
    with_views(
        "universities",
        "SELECT u.candidate_school_id, max(s.id) AS source_id FROM sources s JOIN universities u ON u.id = s.university_id WHERE s.document_type = 'school_list' GROUP BY 1",
        SOURCES,
    ),
)
def latest_source(v: Views) -> DataFrame:
    docs = source_documents(v).filter(F.col("document_type") == "school_list").withColumnRenamed("id", "source_id")
    return joins.latest_lookup(docs, v.universities, "university_id", "id", "candidate_school_id", "source_id")


@query(
    "resume_pending", "J20",
    """SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' AND (l_orderkey, l_suppkey) NOT IN
      (SELECT (l_orderkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R' OR l_shipdate < TIMESTAMP '1996-01-01')""",
)
def resume_pending(v: Views) -> DataFrame:
    """Work of an earlier run is done, and so are the keys that this run has marked."""
    status = F.when(F.col("l_returnflag") == "R", "success").otherwise("error").alias("status")
    li = v.table("lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", status)
    keys = ["l_orderkey", "l_suppkey"]
    done = resume.completed_keys(li.filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")).select(*keys), li, keys, "status")
    return resume.pending(li.select(*keys).distinct(), done, keys)


@query(
    "record_dedup", "W18 A25",
    """SELECT l_suppkey AS school_id, l_partkey AS code, l_returnflag AS degree_type, l_linestatus AS rate, min(l_orderkey * 100 + l_linenumber) AS line
    FROM lineitem GROUP BY 1, 2, 3, 4""",
)
def record_dedup(v: Views) -> DataFrame:
    rows = v.table("lineitem").select(
        F.col("l_suppkey").alias("school_id"), F.col("l_partkey").alias("code"), F.col("l_returnflag").alias("degree_type"),
        F.col("l_linestatus").alias("rate"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line"),
    )
    return integrate.first_records(rows, "levels", "line")


@query(
    "block_counts", "A25",
    """SELECT count(*) AS count, count(*) FILTER (l_returnflag = 'A') AS success_count, count(*) FILTER (l_returnflag = 'R') AS error_count,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem)) AS duplicate_count FROM lineitem""",
)
def block_counts(v: Views) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = v.table("lineitem").select(
        F.col("l_suppkey").alias("school_id"), F.col("l_partkey").alias("year"), flag.alias("plan_id"),
        F.when(flag == "A", "success").when(flag == "R", "error").alias("status"),
    )
    return integrate.block_counts(rows, "status", "plans")


@query(
    "degree_codes", "C6",
    """SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN 'professional' WHEN 2 THEN 'academic' WHEN 3 THEN 'academic' END AS degree FROM part""",
)
def degree_codes(v: Views) -> DataFrame:
    raw = F.when(F.col("p_size") % 4 == 3, "学术学位").otherwise((F.col("p_size") % 4).cast("string"))
    return v.table("part").select("p_partkey", degree_type_std(raw).alias("degree"))
