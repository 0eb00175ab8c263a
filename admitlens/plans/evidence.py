"""Document evidence for recommended items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from admitlens.functions.scoring import evidence_bonus, evidence_summary, source_confidence
from admitlens.functions.text import WHITE, bound, missing_to_null, snippet, squeezed, strip
from admitlens.operators.bloom import prefiltered
from admitlens.operators.joins import substring_matches
from admitlens.operators.keyed import first_wins, null_safe_join, top_n
from admitlens.operators.postings import best_documents, passage_terms
from admitlens.rules import EVIDENCE_TYPES, EVIDENCE_WORDS
from admitlens.sources.stage import staged

SEARCH = ["university_id", "target_year", "keywords"]


def item_keywords(*columns: Column, words: Sequence[str] = tuple(EVIDENCE_WORDS)) -> Column:
    """Search words of an item: its own values and the fixed words, without missing ones."""
    values = [strip(c.cast("string")) for c in columns] + [F.lit(w) for w in words]
    return F.filter(F.array(*values), lambda k: k.isNotNull() & (k != ""))


def registered_documents(
    wanted: DataFrame, documents: DataFrame, limit: int | None = None, types: Sequence[str] | None = tuple(EVIDENCE_TYPES)
) -> DataFrame:
    """Documents of each (university, target year): this year, the year before, or no year.

    Only the allowed types count; of those the newest `limit`, or all.
    """
    docs = documents.filter(F.col("local_path") != "").select(
        F.col("id").alias("doc_id"), F.col("university_id"), F.col("year").alias("_year"), "document_type",
    )
    keys = ["university_id", "target_year"]
    dated = docs.filter(F.col("_year").isNotNull()).withColumn("target_year", F.explode(F.array(F.col("_year"), F.col("_year") + 1)))
    undated = docs.filter(F.col("_year").isNull())
    pool = dated.join(wanted, keys).unionByName(undated.join(wanted, "university_id").select(*dated.columns))
    if types is not None:
        pool = pool.filter(F.col("document_type").isin(list(types)))
    if limit is not None:
        pool = top_n(pool, keys, [F.col("_year").desc_nulls_last(), F.col("doc_id").desc()], limit)
    return pool.select(*keys, "doc_id", F.lit(0).alias("_source"), F.coalesce("_year", F.lit(-1)).alias("_order"))


def squeeze_name(c: str) -> Column:
    """A name without white space; missing is empty."""
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), f"{WHITE}+", "")


def named_documents(items: DataFrame, files: DataFrame) -> DataFrame:
    """(school, major, year) with the files whose name has the school, or the major and the year.

    `files` has doc_id and file_name. Names are matched by equality of substrings, not by comparing all pairs.
    """

    named = files.withColumn("_file", squeeze_name("file_name"))
    who = items.select("university_name", "major_name", "target_year").distinct().withColumns(
        {"_school": squeeze_name("university_name"), "_major": squeeze_name("major_name"), "_y": squeeze_name("target_year")}
    )
    by_school = who.join(substring_matches(who, "_school", named, "_file"), "_school")
    by_major = who.join(substring_matches(who, "_major", named, "_file"), "_major").filter(
        (F.col("_y") == "") | F.col("_file").contains(F.col("_y"))
    )
    hits = by_school.select(*who.columns, "_file").unionByName(by_major.select(*who.columns, "_file")).distinct()
    return hits.join(named.select("doc_id", "_file"), "_file").select("university_name", "major_name", "target_year", "doc_id")


def merged_documents(first: DataFrame, second: DataFrame, keys: Sequence[str], path: str, order: str, limit: int | None = None) -> DataFrame:
    """Both document lists without repeated paths (the first list wins), the first `limit` per key or all."""
    both = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    ranked = both.withColumn("_place", F.struct("_list", order)).withColumn("_path", F.lower(path))
    once = first_wins(ranked, [*keys, "_path"], "_place")
    kept = once if limit is None else top_n(once, keys, [F.col("_place")], limit)
    return kept.drop("_list", "_place", "_path")


def _group(*parts: Column | str) -> Column:
    return F.concat_ws("\x1f", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _open_pools(searches: DataFrame, documents: DataFrame, files: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(groups of each search, members of each group) without limits: a document is in the group of its school and year, a file in
    those of the names it holds, so no document is listed once per search."""
    school, year = F.col("university_id"), F.col("target_year")
    slots = F.array(year, year - 1, F.lit(None).cast(searches.schema["target_year"].dataType))
    wanted = searches.filter(school.isNotNull()).select("sid", F.explode(F.transform(slots, lambda y: _group("year", school, y))).alias("grp")).distinct()
    members = documents.select(_group("year", school, F.col("year")).alias("grp"), "doc", "path", "tie")
    if files is None:
        return wanted, members
    named = files.withColumn("_file", squeeze_name("file_name"))
    who = searches.withColumns({"_school": squeeze_name("university_name"), "_major": squeeze_name("major_name"), "_y": squeeze_name("target_year")})
    by_school = substring_matches(who, "_school", named, "_file").select(_group("school", F.col("_school")).alias("grp"), "_file")
    pairs = who.select("_major", "_y").distinct().join(substring_matches(who, "_major", named, "_file"), "_major")
    by_major = pairs.filter(F.col("_file").contains(F.col("_y"))).select(_group("major", F.col("_major"), F.col("_y")).alias("grp"), "_file")
    both = F.array(F.when(F.col("_school") != "", _group("school", F.col("_school"))), F.when(F.col("_major") != "", _group("major", F.col("_major"), F.col("_y"))))
    wanted = wanted.union(who.select("sid", F.explode(F.array_compact(both)).alias("grp")).distinct())
    more = by_school.union(by_major).join(named.select("_file", "doc", "path", "tie"), "_file").drop("_file")
    return wanted, members.unionByName(more)


def _limited_pools(searches: DataFrame, documents: DataFrame, files: DataFrame | None, doc_limit: int | None, list_limit: int | None) -> tuple[DataFrame, DataFrame]:
    """As `_open_pools` where only the newest `doc_limit` documents count, and the first `list_limit` of both lists together."""
    keys = ["university_id", "target_year"]
    pool = registered_documents(searches.select(*keys).distinct(), documents, doc_limit, None).select(*keys, F.col("doc_id").alias("id"))
    listed = pool.join(documents.select("id", "doc", "path", "tie"), "id").drop("id")
    if list_limit is None and files is None:
        return searches.select("sid", _group("pool", *map(F.col, keys)).alias("grp")), listed.select(_group("pool", *map(F.col, keys)).alias("grp"), "doc", "path", "tie")
    first = searches.select("sid", *keys).join(listed, keys).drop(*keys)
    second = first.limit(0)
    if files is not None:
        who = ["university_name", "major_name", "target_year"]
        hits = named_documents(searches, files.select("file_name", F.col("id").alias("doc_id"))).withColumnRenamed("doc_id", "id")
        second = null_safe_join(searches.select("sid", *who), hits, who, "inner").select("sid", "id").join(files.select("id", "doc", "path", "tie"), "id").drop("id")
    both = merged_documents(first, second, ["sid"], "path", "tie", list_limit)
    return searches.select("sid", F.col("sid").alias("grp")), both.select(F.col("sid").alias("grp"), "doc", "path", "tie")


def best_passages(
    searches: DataFrame, documents: DataFrame, files: DataFrame | None = None, top_k: int = 3, snippet_length: int = 220,
    doc_limit: int | None = None, list_limit: int | None = None, types: Sequence[str] | None = tuple(EVIDENCE_TYPES),
) -> DataFrame:
    """Per search: the best documents by their best chunk, as an array of at most `top_k` hits.

    searches: rows (sid, university_id, target_year, keywords), with files also university_name and major_name. Whole texts are read
    once, for the index; of the winners a second time.
    """
    searches = staged(searches.withColumn("words", F.filter("keywords", lambda k: F.length(k) > 0)))
    asked = staged(searches.select(F.explode("words").alias("word")).distinct())
    allowed = documents.filter(F.col("local_path") != "")
    if types is not None:
        allowed = allowed.filter(F.col("document_type").isin(list(types)))
    allowed = prefiltered(allowed, "university_id", searches.select(F.col("university_id").cast(documents.schema["university_id"].dataType)))
    sources = [allowed.select(F.concat(F.lit("d"), "id").alias("doc"), F.lower("local_path").alias("path"), "text", "document_title", "source_url", F.struct(F.lit(0).alias("list"), (-F.coalesce(F.col("year"), F.lit(-1))).cast("long").alias("year"), (-F.col("id")).alias("id")).alias("tie"), *["id", "university_id", "year", "document_type", "local_path"])]
    if files is not None:
        stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
        sources.append(files.select(F.concat(F.lit("f"), "id").alias("doc"), F.lower("path").alias("path"), "text", stem.alias("document_title"), F.lit(None).cast("string").alias("source_url"), F.struct(F.lit(1).alias("list"), F.lit(0).cast("long").alias("year"), F.col("id").alias("id")).alias("tie"), "id", "file_name"))
    terms = staged(reduce(DataFrame.union, [passage_terms(s.select("doc", squeezed(F.col("text")).alias("text")), "text", asked, "word") for s in sources]))
    plain = [s.drop("text", "document_title", "source_url") for s in sources] + [None]
    if doc_limit is None and list_limit is None:
        wanted, members = _open_pools(searches, plain[0], plain[1])
    else:
        wanted, members = _limited_pools(searches, plain[0], plain[1], doc_limit, list_limit)
    best = staged(best_documents(searches.select("sid", "words"), wanted, members, terms, max(1, top_k)))

    # of the texts only the winners' leave the scan
    winners = best.select("doc").distinct()
    texts = reduce(DataFrame.union, [prefiltered(s.select("doc", "text", "document_title", "source_url"), "doc", winners) for s in sources])
    step = F.col("passage_no") * 440 + 1
    chunk = bound(squeezed(F.col("text")), lambda t: F.when(F.length(t) <= 520, t).otherwise(F.substring(t, step, F.lit(520))))
    shown = best.join(texts, "doc")
    hit = F.struct(
        F.col("place").alias("_pos"), F.substring("doc", 2, 40).cast("bigint").alias("doc_id"), F.coalesce("document_title", F.lit("本地来源资料")).alias("title"), "source_url",
        "score", snippet(chunk, snippet_length).alias("snippet"),
    )
    return shown.groupBy("sid").agg(F.sort_array(F.collect_list(hit)).alias("local_hits"))


def attach_evidence(
    items: DataFrame, documents: DataFrame, web_hits: DataFrame | None = None, item_id: str = "item_id", top_k: int = 3,
    doc_limit: int | None = None, types: Sequence[str] | None = tuple(EVIDENCE_TYPES), files: DataFrame | None = None, list_limit: int | None = None,
) -> DataFrame:
    """Items with local and web hits, confidence, summary and raised scores.

    items need SEARCH, recommend_score, data_quality_score and warnings; with `files` also university_name and major_name. documents:
    the registered ones. files: rows (id, file_name, path, text) that count for an item by their name; a path that is
    registered for it too counts once. web_hits: rows (item id, position, title, snippet); the first `top_k` per item count.
    Items that search for the same thing are searched once.
    """
    keys = [*SEARCH, *(["university_name", "major_name"] if files is not None else [])]
    named = items.withColumn("sid", F.md5(F.to_json(F.struct(*keys))))
    local = best_passages(named.select("sid", *keys).dropDuplicates(["sid"]), documents, files, top_k, 220, doc_limit, list_limit, types)
    out = named.join(local, "sid", "left").drop("sid")
    if web_hits is not None:
        best = top_n(web_hits, [item_id], [F.col("position")], max(1, top_k))
        per_item = best.groupBy(item_id).agg(F.sort_array(F.collect_list(F.struct("position", "title", "snippet"))).alias("web_hits"))
        out = out.join(per_item, item_id, "left")
    else:
        out = out.withColumn("web_hits", F.lit(None).cast("array<struct<position:int,title:string,snippet:string>>"))
    return with_evidence(out)


def with_evidence(df: DataFrame) -> DataFrame:
    """Confidence, summary, bonus and messages from the hit arrays `local_hits` and `web_hits`."""
    n_local = F.when(F.col("local_hits").isNull(), 0).otherwise(F.size("local_hits"))
    n_web = F.when(F.col("web_hits").isNull(), 0).otherwise(F.size("web_hits"))
    bonus = evidence_bonus(n_local, n_web)
    none = F.when((n_local == 0) & (n_web == 0), F.array(F.lit("未检索到本地 PDF 或联网搜索证据，建议人工核对最新招生简章。")))
    return df.withColumns(
        {
            "agent_adjustment_score": bonus,
            "source_confidence": source_confidence(n_local, n_web),
            "evidence_summary": evidence_summary(F.get("local_hits", F.lit(0)), F.get("web_hits", F.lit(0))),
            "recommend_score": F.when(bonus > 0, F.bround(F.coalesce("recommend_score", F.lit(0.0)) + bonus, 2)).otherwise(F.col("recommend_score")),
            "data_quality_score": F.when(
                bonus > 0, F.bround(F.least(F.lit(100.0), F.coalesce("data_quality_score", F.lit(0.0)) + bonus), 2)
            ).otherwise(F.col("data_quality_score")),
            "warnings": F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.coalesce(none, F.array().cast("array<string>"))),
        }
    )


def web_search_text(*columns: Column) -> Column:
    """The query text for a web search (fixed ending)."""
    return F.concat_ws(" ", *[missing_to_null(c.cast("string")) for c in columns], F.lit("研究生 招生简章 招生计划 复试线"))
