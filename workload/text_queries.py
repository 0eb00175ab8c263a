"""Text and code expressions over whole documents, pages and events."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from admitlens import schemas
from admitlens.functions import codes, text
from admitlens.plans import evidence
from admitlens.sources import sinks
from admitlens.sources.ranges import read_csv_ranges
from admitlens.sources.readers import declare_csv_table, read_integrated, store_typed_table, typed
from admitlens.sources.stage import stage_folder
from workload.registry import query
from workload.views import Views

SPACE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WIDE, NARROW = text.FULL_WIDTH, text.HALF_WIDTH
CLEAN = f"nullif(trim(regexp_replace(translate(text, '{WIDE}', '{NARROW}'), '{SPACE}+', ' ', 'g')), '')"


@query("clean_text", "C1 P2", f"SELECT doc_id, {CLEAN} AS clean FROM (SELECT doc_id, '　Ａ１ ' || text AS text FROM documents)")
def clean_text(v: Views) -> DataFrame:
    wide = F.concat(F.lit("　Ａ１ "), F.col("text"))
    return v.table("documents").select("doc_id", text.clean_text(wide).alias("clean"))


@query("first_int", "C2", f"SELECT doc_id, TRY_CAST(nullif(regexp_extract({CLEAN}, '-?[0-9]+'), '') AS BIGINT) AS number FROM documents")
def first_int(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.first_int(F.col("text")).alias("number"))


@query(
    "clean_html", "C11",
    f"""SELECT page_id, nullif(array_to_string(list_filter(list_transform(string_split_regex(
      regexp_replace(regexp_replace(html, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
      lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> ''), chr(10)), '') AS plain FROM pages""",
)
def clean_html(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.clean_html(F.col("html")).alias("plain"))


@query(
    "number_parsers", "C3 M4",
    """SELECT event_id, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(t AS BIGINT) END AS strict,
      CAST(trunc(TRY_CAST(t AS DOUBLE)) AS BIGINT) AS cut, TRY_CAST(t AS DOUBLE) AS number
    FROM (SELECT event_id, CASE event_type WHEN 'view' THEN ' ' || CAST(json_extract(props, '$.k') AS VARCHAR) WHEN 'error' THEN 'n/a'
      ELSE CAST(json_extract(props, '$.k') AS VARCHAR) || '.5' END AS t0, trim(t0) AS t FROM events)""",
)
def number_parsers(v: Views) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    t = F.when(F.col("event_type") == "view", F.concat(F.lit(" "), k)).when(F.col("event_type") == "error", "n/a").otherwise(F.concat(k, F.lit(".5")))
    return v.table("events").select(
        "event_id", text.strict_int(t).alias("strict"), text.float_int(t).alias("cut"), text.to_float(t).alias("number")
    )


@query(
    "code_values", "C4 C5",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 ELSE 0 END AS flag,
      CASE event_type WHEN 'view' THEN 'major' WHEN 'click' THEN 'university' WHEN 'error' THEN 'national' WHEN 'signup' THEN 'major' ELSE 'purchase' END AS line_type
    FROM events""",
)
def code_values(v: Views) -> DataFrame:
    e = F.col("event_type")
    flag = F.when(e == "view", "是").when(e == "click", "yes").when(e == "error", "no")
    kind = F.when(e == "view", "专业线").when(e == "click", " school ").when(e == "error", "国家线").when(e == "signup", "").otherwise(e)
    return v.table("events").select("event_id", text.bool_int(flag).alias("flag"), codes.line_type_std(kind).alias("line_type"))


@query(
    "school_codes", "C7 C8 C9 C10",
    """SELECT s_suppkey, level, CASE WHEN contains(level, '985') THEN 'P0' WHEN contains(level, '211') OR contains(level, '双一流') THEN 'P1' ELSE 'P2' END AS priority,
      CASE WHEN n < 5 THEN 'A区' WHEN n < 10 THEN 'B区' WHEN n < 15 THEN 'A区' ELSE 'NATION_' || n END AS area,
      CASE WHEN n % 3 = 0 THEN 'part_time' WHEN n % 3 = 1 THEN 'full_time' END AS mode
    FROM (SELECT s_suppkey, s_nationkey AS n, coalesce(nullif(concat_ws(' / ', CASE WHEN s_acctbal > 8000 THEN '985' END, CASE WHEN s_acctbal > 6000 THEN '211' END,
      CASE WHEN s_acctbal > 4000 THEN '双一流' END), ''), '普通院校') AS level FROM supplier)""",
)
def school_codes(v: Views) -> DataFrame:
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    flags = {"is_985": (b > 8000).cast("int"), "is_211": (b > 6000).cast("int"), "syl": (b > 4000).cast("int")}
    level = codes.school_level(flags)
    area = F.when(n < 5, "A").when(n < 10, "B区").when(n < 15, "").otherwise(F.concat(F.lit("NATION_"), n))
    mode = F.when(n % 3 == 0, "非全日制").when(n % 3 == 1, "全日制")
    return v.table("supplier").select(
        "s_suppkey", level.alias("level"), codes.coverage_priority(level).alias("priority"), codes.province_area(area).alias("area"),
        codes.study_mode_std(mode).alias("mode"),
    )


@query(
    "issue_keys", "C15 C16",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS school_id,
      CASE WHEN event_type = 'view' THEN 'raw | school_id=' || user_id || '|event=' || event_id WHEN event_type = 'click' THEN user_id || ' name' ELSE 'text' END AS combined,
      CASE event_type WHEN 'view' THEN 'missing' ELSE substr(event_type || repeat('x', 60), 1, 50) END AS kind FROM events""",
)
def issue_keys(v: Views) -> DataFrame:
    e = F.col("event_type")
    key = F.when(e == "view", text.composite_key({"school_id": F.col("user_id"), "event": F.col("event_id")})).otherwise("")
    raw = F.when(e == "view", "raw").when(e == "click", F.concat(F.col("user_id"), F.lit(" name"))).otherwise("text")
    kind = F.when(e == "view", " ").otherwise(F.concat(e, F.repeat(F.lit("x"), F.lit(60))))
    return v.table("events").select(
        "event_id", text.school_id_from_issue(key, raw).alias("school_id"), text.combined_raw_value(raw, key).alias("combined"),
        text.issue_type_std(kind).alias("kind"),
    )


@query(
    "batch_ids", "C19 S8",
    """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'full_' || event_id ELSE strftime(ts, '%Y%m%d_%H%M%S') END AS batch,
      CASE WHEN event_type NOT IN ('error', 'view') THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS started FROM events""",
)
def batch_ids(v: Views) -> DataFrame:
    stamp = F.date_format("ts", "yyyyMMdd_HHmmss")
    e = F.col("event_type")
    path = (
        F.when(e == "error", "/data/other.csv").when(e == "view", F.concat(F.lit("/raw/full_"), F.col("event_id"), F.lit("/school_list/school_list.json")))
        .otherwise(F.concat(F.lit("/data/integrated_"), stamp, F.lit(".csv")))
    )
    batch = text.batch_from_path(path, "integrated_")
    return v.table("events").select(
        "event_id", batch.alias("batch"), F.date_format(text.batch_time(batch), "yyyy-MM-dd HH:mm:ss").alias("started")
    )


@query(
    "disciplines", "C14 S10",
    """SELECT p_partkey, CASE p_size % 15 WHEN 1 THEN '哲学' WHEN 2 THEN '经济学' WHEN 3 THEN '法学' WHEN 4 THEN '教育学' WHEN 5 THEN '文学' WHEN 6 THEN '历史学'
      WHEN 7 THEN '理学' WHEN 8 THEN '工学' WHEN 9 THEN '农学' WHEN 10 THEN '医学' WHEN 11 THEN '军事学' WHEN 12 THEN '管理学' WHEN 13 THEN '交叉学科' END AS discipline FROM part""",
)
def disciplines(v: Views) -> DataFrame:
    code = F.concat(F.lpad((F.col("p_size") % 15).cast("string"), 2, "0"), F.lit("0100"))
    return v.table("part").select("p_partkey", codes.discipline(code).alias("discipline"))


@query(
    "json_text", "C12",
    """SELECT p_partkey, CASE WHEN p_size <= 40 THEN '[' || p_size || ',' || p_partkey || ']' END AS body FROM part""",
)
def json_text(v: Views) -> DataFrame:
    pair = F.when(F.col("p_size") <= 40, F.array(F.col("p_size").cast("bigint"), F.col("p_partkey"))).otherwise(F.array().cast("array<bigint>"))
    return v.table("part").select("p_partkey", text.json_compact(pair).alias("body"))


@query(
    "research_area_explode", "C13 S5",
    """SELECT event_id, unnest(CASE WHEN k < 30 THEN ['own ' || k] WHEN k < 60 THEN ['def ' || k, 'def2 ' || k] WHEN k < 80 THEN ['all ' || k] ELSE [NULL] END) AS area
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)""",
)
def research_area_explode(v: Views) -> DataFrame:
    """Own year, default year, an empty own year that falls through to all years, and no areas at all."""
    k = F.get_json_object("props", "$.k").cast("int")
    areas = (
        F.when(k < 30, F.create_map(F.lit("2024"), F.array(F.concat(F.lit("own "), k)), F.lit("2023"), F.array(F.lit("old"))))
        .when(k < 60, F.create_map(F.lit("2025"), F.array(F.concat(F.lit("def "), k), F.concat(F.lit("def2 "), k)), F.lit("2023"), F.array(F.lit("old"))))
        .when(k < 80, F.create_map(F.lit("2024"), F.array().cast("array<string>"), F.lit("2023"), F.array(F.concat(F.lit("all "), k))))
    )
    found = codes.research_areas(areas, F.lit("2024"), F.lit("2025"))
    return v.table("events").select("event_id", F.explode_outer(found).alias("area"))


@query(
    "readable_names", "F9",
    """SELECT p_partkey, p_size % 3 = 0 AS readable FROM part""",
)
def readable_names(v: Views) -> DataFrame:
    third = F.col("p_size") % 3
    name = F.when(third == 0, F.concat(F.lit(" 工学"), F.col("p_name"))).when(third == 1, F.concat(F.lit("工é"), F.col("p_name"))).otherwise(F.col("p_name"))
    return v.table("part").select("p_partkey", text.readable_category(name).alias("readable"))


@query(
    "text_chunks", "C33",
    """SELECT doc_id, i // 440 AS chunk_no, md5(substr(text, i + 1, 520)) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 520 THEN 1 ELSE length(text) END, 440)) AS i FROM documents)""",
)
def text_chunks(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", F.posexplode(text.text_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("digest"))


WORDS = ["the", "ing", "en"]


@query(
    "keyword_hits", "C34",
    "SELECT doc_id, CAST(" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in WORDS) + " AS INTEGER) AS hits FROM documents",
)
def keyword_hits(v: Views) -> DataFrame:
    words = F.array(*[F.lit(w) for w in WORDS])
    return v.table("documents").select("doc_id", text.keyword_hits(F.col("text"), words).alias("hits"))


@query(
    "snippets", "C35",
    f"""SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE substr(t, 1, 219) || '…' END AS snippet
    FROM (SELECT doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) AS t FROM documents)""",
)
def snippets(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query(
    "file_matches", "C36",
    """SELECT i.major_name, i.target_year, p.p_partkey AS doc_id FROM (SELECT DISTINCT p_name AS major_name, CAST(year(l_shipdate) AS INTEGER) AS target_year
      FROM lineitem JOIN part ON l_partkey = p_partkey) i JOIN part p
    ON contains(replace(p.p_brand || ' ' || p.p_name || ' ' || (1995 + p.p_size % 7) || '.txt', ' ', ''), replace(i.major_name, ' ', ''))
      AND contains(p.p_brand || p.p_name || (1995 + p.p_size % 7), CAST(i.target_year AS VARCHAR))""",
)
def file_matches(v: Views) -> DataFrame:
    p = v.table("part")
    li = v.table("lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    items = li.select(
        F.lit(None).cast("string").alias("university_name"), F.col("p_name").alias("major_name"), F.year("l_shipdate").alias("target_year")
    ).distinct()
    name = F.concat(F.concat_ws(" ", "p_brand", "p_name", (F.lit(1995) + F.col("p_size") % 7).cast("string")), F.lit(".txt"))
    files = p.select(F.col("p_partkey").alias("doc_id"), name.alias("file_name"))
    return evidence.named_documents(items, files).select("major_name", "target_year", "doc_id")


def evidence_documents(v: Views) -> DataFrame:
    return v.table("documents").select(
        F.col("doc_id").alias("id"), F.substring("source", 4, 10).cast("bigint").alias("university_id"),
        F.when(F.col("doc_id") % 5 != 0, (F.lit(1995) + F.col("doc_id") % 7).cast("int")).alias("year"), F.lit("plan").alias("document_type"),
        F.concat(F.lit("document "), F.col("doc_id")).alias("document_title"), F.lit(None).cast("string").alias("source_url"),
        F.concat(F.lit("/docs/"), F.col("doc_id")).alias("local_path"), "text",
    )


def evidence_items(v: Views) -> DataFrame:
    words = F.array_distinct(F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w) >= 8))
    return v.table("benchmark").select(
        "item_id", (F.col("item_id") % 20).alias("university_id"), (F.lit(1995) + F.col("item_id") % 7).cast("int").alias("target_year"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("university_name"), F.concat(F.lit("major"), F.col("item_id") % 13).alias("major_name"),
        words.alias("keywords"), F.lit(70.0).alias("recommend_score"), F.lit(92.0).alias("data_quality_score"), F.array().cast("array<string>").alias("warnings"),
    )


ITEMS = """items AS (SELECT item_id, item_id % 20 AS university_id, 1995 + item_id % 7 AS target_year, 'src' || item_id % 20 AS school, 'major' || item_id % 13 AS major,
    list_distinct(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) >= 8)) AS kw FROM benchmark)"""
DOCS = f"""docs AS (SELECT doc_id, CAST(substr(source, 4) AS BIGINT) AS university_id, CASE WHEN doc_id % 5 <> 0 THEN 1995 + doc_id % 7 END AS year,
    'src' || n_chars % 23 || 'major' || doc_id % 17 || (1995 + n_chars % 7) || '.pdf' AS file, regexp_replace(text, '{SPACE}+', ' ', 'g') AS t FROM documents)"""
REGISTERED = """SELECT i.item_id, d.doc_id, 0 AS list, -coalesce(d.year, -1) AS by_year, -d.doc_id AS by_id FROM items i
    JOIN docs d ON d.university_id = i.university_id AND (d.year IS NULL OR d.year BETWEEN i.target_year - 1 AND i.target_year)"""
NAMED = """SELECT i.item_id, d.doc_id, 1, 0, d.doc_id FROM items i JOIN docs d ON contains(file, school) OR contains(file, major) AND contains(file, target_year::VARCHAR)"""


def hits_sql(pairs: str) -> str:
    """The best three documents of each item among (item_id, doc_id, list, by_year, by_id)."""
    return f"""WITH {ITEMS}, {DOCS}, listed AS ({pairs}),
  pairs AS (SELECT l.*, kw, t FROM (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY list) = 1) l JOIN items USING (item_id) JOIN docs USING (doc_id)),
  pieces AS (SELECT item_id, doc_id, list, by_year, by_id, kw, s, substr(t, s + 1, 520) AS chunk
    FROM (SELECT *, unnest(range(0, CASE WHEN length(t) <= 520 THEN 1 ELSE length(t) END, 440)) AS s FROM pairs)),
  scored AS (SELECT *, coalesce(list_sum(list_transform(kw, lambda k: (length(chunk) - length(replace(chunk, k, ''))) // length(k))), 0) AS score FROM pieces),
  best AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, s) = 1),
  top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, list, by_year, by_id) AS position FROM best QUALIFY position <= 3),
  hits AS (SELECT *, CASE WHEN length(trim(chunk)) <= 220 THEN trim(chunk) ELSE substr(trim(chunk), 1, 219) || '…' END AS snippet FROM top)"""


HITS = hits_sql(REGISTERED)
TOP_HITS = " SELECT item_id, doc_id, position, CAST(score AS INTEGER) AS score, snippet FROM hits"


def named_files(v: Views) -> DataFrame:
    """Files outside the register, under the same paths."""
    chars = F.col("n_chars")
    name = F.concat(F.lit("src"), chars % 23, F.lit(" major"), F.col("doc_id") % 17, F.lit(" "), chars % 7 + 1995, F.lit(".pdf"))
    return v.table("documents").select(F.col("doc_id").alias("id"), name.alias("file_name"), F.concat(F.lit("/DOCS/"), F.col("doc_id")).alias("path"), "text")


def top_hits(out: DataFrame) -> DataFrame:
    rows = out.select("item_id", F.explode("local_hits").alias("h"))
    return rows.select("item_id", "h.doc_id", F.col("h._pos").alias("position"), "h.score", "h.snippet")


@query("evidence_topk", "X10 C33 C34", HITS + TOP_HITS)
def evidence_topk(v: Views) -> DataFrame:
    return top_hits(evidence.attach_evidence(evidence_items(v), evidence_documents(v)))


@query("evidence_files", "X10 U7 C36", hits_sql(f"{REGISTERED} UNION ALL {NAMED}") + TOP_HITS)
def evidence_files(v: Views) -> DataFrame:
    """Registered documents and files by name, without limits."""
    return top_hits(evidence.attach_evidence(evidence_items(v), evidence_documents(v), files=named_files(v)))


@query(
    "evidence_merged", "X10 U7 C36",
    hits_sql(f"""SELECT * FROM (
      SELECT * FROM (SELECT * FROM (SELECT * FROM ({REGISTERED}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY by_year, by_id) <= 20) UNION ALL {NAMED})
      QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY list) = 1) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY list, by_year, by_id) <= 50""") + TOP_HITS,
)
def evidence_merged(v: Views) -> DataFrame:
    """The newest 20 registered documents, then files by name, 50 together."""
    return top_hits(evidence.attach_evidence(evidence_items(v), evidence_documents(v), files=named_files(v), doc_limit=20, list_limit=50))


@query(
    "evidence_scores", "X10 C37 C38",
    HITS + """ SELECT i.item_id, least(5.0, 2.0 * coalesce(n, 0)) AS agent_adjustment_score, CASE WHEN n > 0 THEN 'medium' ELSE 'unknown' END AS source_confidence,
      CASE WHEN n > 0 THEN '本地资料匹配：document ' || doc_id || '。' || snippet ELSE '暂无招生简章或招生计划证据匹配。' END AS evidence_summary,
      70.0 + least(5.0, 2.0 * coalesce(n, 0)) AS recommend_score, least(100.0, 92.0 + least(5.0, 2.0 * coalesce(n, 0))) AS data_quality_score,
      CASE WHEN n > 0 THEN 0 ELSE 1 END AS warning_count
    FROM items i LEFT JOIN (SELECT item_id, count(*) AS n FROM hits GROUP BY 1) c USING (item_id) LEFT JOIN (SELECT * FROM hits WHERE position = 1) h USING (item_id)""",
)
def evidence_scores(v: Views) -> DataFrame:
    out = evidence.attach_evidence(evidence_items(v), evidence_documents(v), doc_limit=None)
    return out.select(
        "item_id", "agent_adjustment_score", "source_confidence", "evidence_summary", "recommend_score", "data_quality_score",
        F.size("warnings").alias("warning_count"),
    )


@query(
    "typed_columns", "S3 S7 P1",
    """SELECT event_id AS plan_id, CASE WHEN event_type = 'view' THEN 2024 END AS year, CAST(json_extract(props, '$.k') AS INTEGER) AS plan_count FROM events""",
)
def typed_columns(v: Views) -> DataFrame:
    """Text columns read with the declared types of a cleaned table; unreadable numbers are NULL."""
    raw = v.table("events").select(
        F.col("event_id").cast("string").alias("plan_id"), F.when(F.col("event_type") == "view", "2024").otherwise("n/a").alias("year"),
        F.get_json_object("props", "$.k").alias("plan_count"),
    )
    return typed(raw, "enrollment_plans").select("plan_id", "year", "plan_count")


@query("csv_round_trip", "S2 S3 K2", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, nullif(text, '') AS text FROM documents""")
def csv_round_trip(v: Views) -> DataFrame:
    """Whole texts, with their quotes and line breaks, to CSV files of a fixed column order and back, read in ranges."""
    path = f"{stage_folder(v.spark)}/csv/{uuid4().hex}"
    sinks.write_csv(v.table("documents").withColumn("extra", F.lit(1)), path, ["doc_id", "lang", "text"])
    return read_csv_ranges(v.spark, path).select("doc_id", "lang", "text")


@query(
    "csv_single_file", "S2 K1 K2 L1",
    """SELECT row_number() OVER (ORDER BY p_name, p_partkey) + 1 AS line_no, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part""",
)
def csv_single_file(v: Views) -> DataFrame:
    """An ordered export as one file; the line numbers come back with the records."""
    path = f"{stage_folder(v.spark)}/csv/{uuid4().hex}"
    sinks.write_csv(v.table("part").orderBy("p_name", "p_partkey"), path, ["p_partkey", "p_name", "p_brand"], single_file=True)
    return read_integrated(v.spark, path).select(F.col("_line_no").alias("line_no"), "p_partkey", "p_name", "p_brand")


@query(
    "catalog_table", "S7",
    """SELECT event_id AS plan_id, CAST(json_extract(props, '$.k') AS INTEGER) AS plan_count FROM events WHERE event_type = 'view'""",
)
def catalog_table(v: Views) -> DataFrame:
    """CSV files declared as a table, copied to a typed table in folders by year, of which one year is read."""
    run, folder = uuid4().hex, f"{stage_folder(v.spark)}/catalog"
    rows = v.table("events").select(
        F.col("event_id").cast("string").alias("plan_id"), F.when(F.col("event_type") == "view", "2024").otherwise("2023").alias("year"),
        F.get_json_object("props", "$.k").alias("plan_count"),
    )
    columns = schemas.CLEANED["enrollment_plans"]
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])
    sinks.write_csv(full, f"{folder}/csv_{run}", columns)
    declare_csv_table(v.spark, f"plans_csv_{run}", "enrollment_plans", f"{folder}/csv_{run}")
    store_typed_table(v.spark, f"plans_csv_{run}", f"plans_{run}", "enrollment_plans", f"{folder}/plans_{run}", "year")
    return v.spark.table(f"plans_{run}").filter(F.col("year") == 2024).select("plan_id", "plan_count")


@query(
    "null_sums", "C17",
    """SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + b END AS total
    FROM (SELECT l_orderkey, l_linenumber, nullif(l_partkey % 3, 0) AS a, nullif(l_suppkey % 4, 0) AS b FROM lineitem)""",
)
def null_sums(v: Views) -> DataFrame:
    part, supplier = (F.nullif(F.col(c) % n, F.lit(0)) for c, n in (("l_partkey", 3), ("l_suppkey", 4)))
    return v.table("lineitem").select("l_orderkey", "l_linenumber", text.null_add(part, supplier).alias("total"))


@query(
    "null_free_keys", "C18",
    """SELECT o_orderkey, coalesce(nullif(o_custkey % 3, 1), 0) AS id_key, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, '') AS text_key FROM orders""",
)
def null_free_keys(v: Views) -> DataFrame:
    number, name = F.nullif(F.col("o_custkey") % 3, F.lit(1)), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    return v.table("orders").select("o_orderkey", text.unique_key(number, "id").alias("id_key"), text.unique_key(name, "text").alias("text_key"))
