"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitlens.llm import chosenpath, decontaminate, licenses, linedup, mixing, packing, pqlinks, prefixtrie, quality, sharding, suffixes, toxicity, whitening

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def _query(name: str, tables: str = "documents", sql: str | None = None) -> Callable:
    """Register a function of one or more tables."""

    def wrap(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        LLM_QUERIES[name] = lambda spark, sf_dir: make(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()])
        if sql is not None:
            LLM_ORACLE[name] = sql
        return make

    return wrap


_RULES = quality.QualityRules()
_FENCES = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {end} END) AS {m}_{end}" for m in quality.MEASURES for end in ("low", "high"))
_PAIRS = ", ".join(f"{{'measure': '{m}', 'v': {c} * 1000 // greatest(n_words, 1)}}" for m, (c, _) in quality.MEASURES.items())
_INSIDE = " AND ".join(f"{c} * 1000 // greatest(n_words, 1) BETWEEN {f'{m}_low' if low else '0'} AND {m}_high" for m, (c, low) in quality.MEASURES.items())
_LEAST = " ".join(f"WHEN '{m}' THEN {x}" for m, x in _RULES.least)


def _quartiles(by: str) -> str:
    """Quarter points of the histograms merged to some columns."""
    value = "min(CASE WHEN 4 * upto >= {k} * total THEN cell END)"
    q = lambda k: (lambda c: f"CASE WHEN {c} < 64 THEN {c} ELSE ({c} % 32 + 32) << ({c} // 32 - 1)::INTEGER END")(value.format(k=k))
    return f"""SELECT {by} measure, {q(1)} AS q1, {q(3)} AS q3, max(total) AS total FROM (
      SELECT *, sum(n) OVER (PARTITION BY {by} measure ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY {by} measure) AS total
      FROM (SELECT {by} measure, cell, sum(n)::BIGINT AS n FROM cells GROUP BY {by} measure, cell)) GROUP BY {by} measure"""


@_query("op1_quality_rules", sql=f"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT b.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)),
rows AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed FROM counts),
measured AS (SELECT lang, source, p.measure, p.v FROM (SELECT lang, source, unnest([{_PAIRS}]) AS p FROM rows WHERE NOT base_failed)),
cells AS (
  SELECT lang, source, measure, 32 * shift + (v >> shift) AS cell, count(*) AS n
  FROM (SELECT *, greatest(length(ltrim(bin(v), '0')) - 6, 0)::INTEGER AS shift FROM measured) GROUP BY ALL),
own AS ({_quartiles('lang, source,')}), by_lang AS ({_quartiles('lang,')}), by_all AS ({_quartiles('')}),
used AS (
  SELECT o.lang, o.source, measure, CASE WHEN o.total >= {_RULES.min_group} THEN o.q1 WHEN l.total >= {_RULES.min_group} THEN l.q1 ELSE a.q1 END AS q1,
    CASE WHEN o.total >= {_RULES.min_group} THEN o.q3 WHEN l.total >= {_RULES.min_group} THEN l.q3 ELSE a.q3 END AS q3
  FROM own o JOIN by_lang l USING (measure) JOIN by_all a USING (measure) WHERE o.lang IS NOT DISTINCT FROM l.lang),
wide AS (SELECT *, greatest({_RULES.spread} * (q3 - q1), CASE measure {_LEAST} END) AS far FROM used),
fences AS (SELECT lang, source, {_FENCES} FROM (SELECT lang, source, measure, q1 - far AS low, q3 + far AS high FROM wide) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_INSIDE}, false) AS kept
FROM rows r LEFT JOIN fences f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source""")
def quality_rules(docs: DataFrame) -> DataFrame:
    return quality.quality_verdicts(docs)


@_query("op2_line_dedup", sql=r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT k.*, f.first IS NOT NULL AND doc_id > f.first AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def line_dedup(docs: DataFrame) -> DataFrame:
    verdicts = linedup.line_verdicts(docs)
    return verdicts.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op10_ngram_jaccard_join")
def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    return chosenpath.links_of_documents(docs)


@_query("op3_differencing_shards")
def differencing_shards(docs: DataFrame) -> DataFrame:
    shards = sharding.shards_of(docs)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@_query("op4_toxicity", "documents labels")
def toxicity_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity.toxicity_scores(docs, labels)


_NORMAL = "trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
_LONGEST = max(len(ids) for _, ids in licenses.ALL_RULES)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@_query("op5_license_scan", sql=f"""
WITH known AS (SELECT known, {_NORMAL.format('raw')} AS sentence FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in licenses.ALL_SENTENCES)}) AS s(known, raw)),
rules AS (SELECT * FROM (VALUES {', '.join(f'({_quoted(name)}, [{", ".join(map(_quoted, ids))}])' for name, ids in licenses.ALL_RULES)}) AS r(license, ids)),
parts AS (
  SELECT doc_id, unnest(p) AS body, generate_subscripts(p, 1) AS part
  FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[.;:!?]+[\x20\x09-\x0D]+') AS p FROM documents)),
lines AS (
  SELECT doc_id, part, unnest(l) AS raw, generate_subscripts(l, 1) AS line
  FROM (SELECT doc_id, part, flatten(list_transform(regexp_split_to_array(body, '\\n[\\x20\\x09-\\x0D]*\\n'),
    lambda p: CASE WHEN contains(p, chr(10)) THEN list_concat([p], string_split(p, chr(10))) ELSE [p] END)) AS l FROM parts)),
hits AS (SELECT doc_id, part, line, known FROM (SELECT doc_id, part, line, {_NORMAL.format('raw')} AS sentence FROM lines) JOIN known USING (sentence)),
seen AS (
  SELECT doc_id, row_number() OVER w AS first, [{', '.join(f'lead(known, {k}) OVER w' for k in range(_LONGEST))}] AS ids, [{', '.join(f'lead(part, {k}) OVER w' for k in range(_LONGEST))}] AS parts
  FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY part, line, known)),
found AS (
  SELECT doc_id, license, first, first + len(r.ids) - 1 AS last
  FROM seen s JOIN rules r ON s.ids[1:len(r.ids)] = r.ids AND len(list_filter(range(2, len(r.ids) + 1), lambda k: s.parts[k] - s.parts[k - 1] > 3)) = 0),
best AS (
  SELECT * FROM (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last DESC, license ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM found)
  WHERE reached IS NULL OR last > reached),
named AS (SELECT doc_id, license, min(first) AS first, count(*) AS n FROM best GROUP BY doc_id, license)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_matches, coalesce(string_agg(license, ',' ORDER BY first), '') AS licenses
FROM documents d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id""")
def license_scan(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    found = licenses.licenses_of(docs, licenses.sentence_table(spark), licenses.rule_table(spark))
    return found.select("doc_id", "n_matches", F.array_join("licenses", ",").alias("licenses"))


@_query("op6_source_mixing")
def source_mixing(docs: DataFrame) -> DataFrame:
    taken = (F.col("size") * F.size("taken")).cast("long").alias("taken")
    return mixing.draws(docs).select("doc_id", "size", "source_size", "target", taken, F.col("taken.shard").alias("shards"))


@_query("op7_repeated_spans")
def repeated_spans(docs: DataFrame) -> DataFrame:
    return suffixes.repeated_bytes(docs)


@_query("op8_embedding_pq", "embeddings")
def embedding_pq(vectors: DataFrame) -> DataFrame:
    return pqlinks.embedding_links(vectors)


@_query("op9_best_fit_packing")
def best_fit_packing(docs: DataFrame) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


@_query("op13_embedding_whitening", "embeddings")
def embedding_whitening(vectors: DataFrame) -> DataFrame:
    out = whitening.whitened_embeddings(vectors)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query("op11_benchmark_decontamination", "documents benchmark", sql=f"""
WITH items AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, phrase)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = decontaminate.contamination(docs, benchmark)
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids, (F.col("n_hit") > 0).alias("contaminated"))


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295)"""


@_query("op12_conversation_trie", "conversations", sql=f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS head, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, i, role, text FROM convs c JOIN turns t ON t.conv_id = c.head AND i <= h
  UNION ALL SELECT c.conv_id, i + 1000000000, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND i > h),
seqs AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs),
members AS (SELECT conv_id, d, s[1:d] AS p, d = len(s) AS ends FROM prefixes),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS own
  FROM members GROUP BY d, p),
families AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
sized AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN families f ON f.p = n.p),
sums AS (
  SELECT q, sum((k = 0)::INTEGER)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved
  FROM (SELECT p[1:a] AS q, k, own FROM (SELECT p, k, own, unnest(range(0, d + 1)) AS a FROM sized)) GROUP BY q)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n.k::BIGINT AS n_children, n_leaves, saved AS saved_tokens, n.ends_sha256
FROM sized n JOIN sums ON q = n.p LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]""")
def conversation_trie(turns: DataFrame) -> DataFrame:
    return prefixtrie.prefix_nodes(turns)
