"""Keyed operators, joins and sinks: properties and comparison with plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from admitlens.operators import joins, keyed, quality
from admitlens.operators.candidates import Filter, attach, candidates
from admitlens.plans import recommend
from admitlens.sources import sinks


def rows_with_hot_key(n=600, seed=1):
    """A third of the rows share one key; some keys are NULL."""
    rnd = random.Random(seed)
    out = []
    for line in range(n):
        key = "hot" if rnd.random() < 0.34 else rnd.choice(["a", "b", "c", None, "d", "e"])
        out.append((line, key, rnd.randint(1, 4), rnd.randint(0, 50)))
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def sample(spark):
    return rows_with_hot_key(), spark.createDataFrame(rows_with_hot_key(), "line long, key string, year int, value int").repartition(4)


def test_first_and_later_rows_partition_the_input(sample):
    rows, df = sample
    first = {r.line for r in keyed.first_wins(df, ["key", "year"], "line").collect()}
    later = [r.line for r in keyed.later_rows(df, ["key", "year"], "line").collect()]
    want = {}
    for line, key, year, _ in sorted(rows):
        want.setdefault((key, year), line)
    assert first == set(want.values())
    assert len(later) == len(set(later)) and first | set(later) == {r[0] for r in rows} and not first & set(later)


def test_best_and_last_rows(sample):
    rows, df = sample
    best = {(r.key): r.line for r in keyed.best_row(df, ["key"], [F.col("value").desc()], "line").collect()}
    last = {r.key: r.line for r in keyed.last_wins(df, ["key"], "line").collect()}
    for k in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == k]
        assert best[k] == min(mine, key=lambda r: (-r[3], r[0]))[0] and last[k] == max(r[0] for r in mine)


def test_limit_is_applied_before_the_shuffle(sample):
    _, df = sample
    plan = keyed.top_n(df, ["key"], [F.col("line")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_previous_in_order_equals_a_plain_lag(sample):
    rows, df = sample
    got = {r.line: r.prev for r in keyed.previous_in_order(df, ["key"], ["year"], ["line"], "value", "prev").collect()}
    by_key = {}
    for line, key, year, value in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[line] == by_key.get(key)
        by_key[key] = value


def test_consecutive_ids(sample):
    rows, df = sample
    ids = keyed.consecutive_ids(df, "year", "line", ["value"], "id").collect()
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), start=1)}
    assert {r.line: r.id for r in ids} == want


def test_unique_match_and_code_fallback(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert {r.id: r.v for r in joins.unique_match(left, right, ["k"]).collect()} == {1: None, 2: 3, 3: 4}
    plans = spark.createDataFrame([(1, 9, "x", "y"), (2, 9, None, "y"), (3, 9, "q", None), (4, 8, "x", "y")], "id int, s int, c2 string, c1 string")
    levels = spark.createDataFrame([(9, "x", "A", 1), (9, "x", "B", 2), (9, "y", "C", 3), (9, "", "D", 4)], "s int, code string, rate string, line int")
    got = {r.id: (r.code, r.rate) for r in joins.first_code_match(plans, levels, ["s"], ["c2", "c1"], "code", "line").collect()}
    assert got == {1: ("x", "B"), 2: ("y", "C"), 3: (None, None), 4: (None, None)}


def test_substring_matches_equal_contains(spark):
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    needles = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 4))) for _ in range(25)]
    got = joins.substring_matches(
        spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame([(n,) for n in names], "h string"), "h"
    )
    want = {(n, h) for n in needles for h in names if n and n in h}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_upsert_is_idempotent_and_keeps_other_columns(spark):
    target = spark.createDataFrame([(1, "a", "x", "keep"), (2, None, "y", "keep")], "id int, k string, v string, w string")
    source = spark.createDataFrame([("a", "new", "no"), (None, "null", "no"), ("z", "add", "w")], "k string, v string, w string")
    once = sinks.upsert(target, source, ["k"], ["v"])
    twice = sinks.upsert(once, source, ["k"], ["v"])
    want = {(1, "a", "new", "keep"), (2, None, "null", "keep"), (None, "z", "add", "w")}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in twice.collect()}


def test_append_new_ignores_known_and_repeated_keys(spark):
    target = spark.createDataFrame([("a", None)], "k string, m string")
    source = spark.createDataFrame([("a", None, 1), ("b", "x", 2), ("b", "x", 3)], "k string, m string, line int")
    assert [tuple(r) for r in sinks.append_new(target, source, ["k", "m"], "line").collect()] == [("b", "x", 3)]


def test_checks(spark):
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "id string, name string")
    assert [(r.value, r.side) for r in quality.not_one_to_one(pairs, "id", "name").collect()] == [("1", "id")]
    with pytest.raises(quality.DataCheckError):
        quality.raise_if_any(pairs, "bad")
    quality.raise_if_any(pairs.filter("false"), "bad")


def test_candidates_equal_brute_force(spark):
    """Random requests and lines against nested loops; one profile is shared by a third of the requests."""
    rnd = random.Random(5)
    names = ["red ring", "hot ring", "old rod", "hot rod", None]
    lines = [(i, rnd.choice([1, 2]), rnd.choice("AB"), rnd.choice(names), rnd.choice(["985 / 211", "211", "x"]), rnd.choice("PQ"), rnd.choice("PQR"), rnd.randint(0, 30)) for i in range(300)]
    reqs = []
    for i in range(80):
        hot = i % 3 == 0
        reqs.append((
            i, 1 if hot else rnd.choice([1, 2]), "A" if hot else rnd.choice(["A", None]), None if hot else rnd.choice(["ring", "hot", "rod", None]),
            None if hot else rnd.choice([["985"], ["985", "211"], [], None]), None if hot else rnd.choice(["P", None]),
        ))
    filters = [Filter("prov", ("lprov",)), Filter("name", ("lname",), "contains"), Filter("levels", ("llevel",), "any_contains"), Filter("cat", ("lc1", "lc2"), "either")]
    ldf = spark.createDataFrame(lines, "lid int, lyear int, lprov string, lname string, llevel string, lc1 string, lc2 string, total int")
    rdf = spark.createDataFrame(reqs, "rid int, year int, prov string, name string, levels array<string>, cat string")
    met = candidates(rdf, ldf, filters, [("year", "lyear")], [("total", "desc"), ("lid", "asc")], overrides={"cat": ("name",)})
    got, every = {}, {}
    for limit, out in ((7, got), (None, every)):
        for r in attach(met.asked.select("rid", "_profile"), met.best(limit, ["lid"]), ["rid"]).collect():
            out.setdefault(r.rid, []).append((r._rank, r.lid))
    for rid, year, prov, name, levels, cat in reqs:
        ok = [
            x for x in lines
            if x[1] == year and (prov is None or x[2] == prov) and (name is None or (x[3] and name in x[3]))
            and (not levels or any(w in x[4] for w in levels)) and (cat is None or name is not None or cat in (x[5], x[6]))
        ]
        ok.sort(key=lambda x: (-x[7], x[0]))
        assert sorted(got.get(rid, [])) == [(k, x[0]) for k, x in enumerate(ok[:7], start=1)]
        assert sorted(every.get(rid, [])) == [(k, x[0]) for k, x in enumerate(ok, start=1)]


def test_upsert_with_repeated_source_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    source = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 4), (2, "e", 3)], "k int, v string, line int")
    assert sorted(map(tuple, sinks.upsert(target, source, ["k"], ["v"], line="line").collect())) == [(1, "c"), (2, "d")]
    with pytest.raises(Exception, match="a key occurs twice"):
        sinks.upsert(target, source, ["k"], ["v"]).collect()


def test_later_rows_of_a_hot_key(spark):
    rows = spark.range(2000).selectExpr("id as line", "if(id % 10 < 9, null, id % 70) as k")
    later = keyed.later_rows(rows, ["k"], "line")
    assert later.columns == rows.columns
    firsts = {}
    for line in range(2000):
        firsts.setdefault(None if line % 10 < 9 else line % 70, line)
    assert sorted(r.line for r in later.collect()) == sorted(set(range(2000)) - set(firsts.values()))


def test_ids_of_far_apart_positions(spark):
    rows = spark.range(500).selectExpr("0 as stage", "(id * 7919 % 500) * 1000000000000 as at")
    got = keyed.consecutive_ids(rows, "stage", "at", [], "n").orderBy("at").collect()
    assert [r.n for r in got] == list(range(1, 501))
    assert keyed.consecutive_ids(rows.limit(0), "stage", "at", [], "n").count() == 0


def test_audited_write(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "if(id < 3, null, id) as v")
    out = str(tmp_path / "t")
    save = lambda df: df.write.mode("errorifexists").parquet(out)
    first = sinks.audited_write(rows, F.col("v").isNull(), save, "load", "batch", "in", out).first()
    assert (first.status, first.total_count, first.success_count, first.failed_count, first.error_message) == ("partial", 10, 7, 3, None)
    assert first.start_time <= first.end_time and spark.read.parquet(out).count() == 10
    again = sinks.audited_write(rows, F.col("v").isNull(), save, "load", "batch", "in", out).first()
    assert again.status == "failed" and "PATH_ALREADY_EXISTS" in again.error_message and again.total_count is None
    assert sinks.audited_write(rows, F.lit(False), lambda df: df.write.format("noop").mode("overwrite").save(), "n", "t", "", "").first().status == "success"


def test_skip_completed(spark):
    work = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, None)], "k int, s string")
    done = spark.range(3000).selectExpr("cast(id as int) as k", "'x' as s").union(spark.createDataFrame([(1, None), (2, "b")], "k int, s string"))
    assert sorted(map(str, joins.skip_completed(work, done, ["k", "s"]).collect())) == ["Row(k=1, s='a')", "Row(k=None, s=None)"]


def test_numbers_in_an_order(spark):
    rows = spark.range(3000).selectExpr("id", "cast(if(id % 3 = 0, 7, id % 50) as int) as k")
    got = keyed.numbered_in(rows, [F.col("k").desc(), F.col("id")], "n", 0).collect()
    want = sorted(((7 if i % 3 == 0 else i % 50, i) for i in range(3000)), key=lambda x: (-x[0], x[1]))
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.n)] == want and {r.n for r in got} == set(range(3000))


def test_report_records(spark):
    rows = spark.createDataFrame([("t", 1, "x", None, "text")], "trace_id string, recommendation_log_id int, a string, b string, report_content string")
    r = recommend.report_records(rows, ["a", "b"]).first()
    assert (r.trace_id, r.report_type, r.prompt_json, r.report_content) == ("t", "recommendation", '{"a":"x","b":null}', "text")


def test_staging_leaves_no_shuffle_files(spark):
    from admitlens.sources.stage import staged

    def shuffle_files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = shuffle_files()
    rows = staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffle_files() <= before and rows.agg(F.sum("count")).first()[0] == 1000


def test_only_rows_that_need_a_code_are_shuffled_for_it(spark):
    from admitlens.sources.stage import staged

    kept = []
    plans = spark.createDataFrame([(1, 9, "x", "y"), (2, 9, None, "y"), (3, 9, "", None), (4, None, "x", "y"), (5, 9, "q", "y")], "id int, s int, c2 string, c1 string")
    levels = spark.createDataFrame([(9, "x", "A", 1), (9, "y", "C", 2), (None, "y", "N", 3)], "s int, code string, rate string, line int")
    out = joins.first_code_match(plans, levels, ["s"], ["c2", "c1"], "code", "line", lambda df: kept.append(staged(df)) or kept[-1])
    assert {r.id: r.rate for r in out.collect()} == {1: "A", 2: "C", 3: None, 4: "N", 5: "C"}
    assert [sorted(r.id for r in df.collect()) for df in kept if "c1" in df.columns][1:] == [[1, 4, 5], [2, 4, 5]]


def test_later_rows_without_repeats_move_no_rows(spark):
    rows = spark.range(50).select((F.col("id") % 49).alias("k"), F.col("id").alias("line"), F.lit("wide").alias("w"))
    later = keyed.later_rows(rows, ["k"], "line")
    assert [r.line for r in later.collect()] == [49]
    assert "Exchange hashpartitioning" not in later._jdf.queryExecution().executedPlan().toString()


def test_numbering_removes_what_only_its_rows_read(spark):
    """Tables that are spent are gone before the rows are dealt by ranges."""
    from pathlib import Path

    from admitlens.sources.stage import staged

    source = staged(spark.range(50).withColumnRenamed("id", "n"))
    numbered = keyed.numbered_in(source, [F.col("n").desc()], "no", spent=[source])
    assert not Path(source.staged_path).exists()
    assert {(r.n, r.no) for r in numbered.collect()} == {(49 - i, i + 1) for i in range(50)}


def test_staged_writes_interpret_no_long_methods(spark):
    from admitlens.sources.stage import _write_settings

    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    with _write_settings(spark):
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == before
