"""Every registered query against its DuckDB oracle (sf0.001), plan checks,
and batch = stream."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from scorelake.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.queries()) & set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name, sf_dir=SF_SMALL):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=repr)
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "mean_wer" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_plan_is_jvm_only_and_filters_do_not_recompute(spark):
    plan = _plan(QUERIES["utterance_error_rates"](spark, SF_SMALL))
    # One Arrow batch, for pairs that are long; no row at a time.
    assert plan.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in plan
    assert "commons.lang3" in plan
    # The distances are computed once, under a Generate, never in a Filter.
    for line in plan.splitlines():
        if "Filter" in line:
            assert "levenshtein" not in line.lower()


def test_summary_is_partial_then_final_aggregate(spark):
    plan = _plan(QUERIES["corpus_summary"](spark, SF_SMALL))
    assert plan.count("HashAggregate") >= 2


def test_scan_prunes_columns(spark):
    df = QUERIES["run_slug"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def _distances(df):
    return _plan(df).lower().count("levenshtein")


def test_only_the_wanted_distances_are_planned(spark):
    every = _distances(QUERIES["scored_records"](spark, SF_SMALL))
    words = QUERIES["word_edit_distance"](spark, SF_SMALL)
    assert _distances(words) < every and _distances(QUERIES["run_ranking"](spark, SF_SMALL)) < _distances(words)
    assert "array_distinct" not in _plan(QUERIES["char_edit_distance"](spark, SF_SMALL))


def test_a_text_is_handed_to_the_alignment_once(spark):
    """All four distances come from one call, whatever they share."""
    plan = _plan(QUERIES["scored_records"](spark, SF_SMALL))
    (step,) = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert step.count("udf(") == 1


def test_a_large_role_is_many_files(spark, monkeypatch):
    """A run of the matrix reads its role file by file, so the largest is no single task."""
    from scorelake.plans import queries

    monkeypatch.setattr(queries, "TURNS_PER_FILE", 10)
    source = queries._role_datasets(spark, SF_SMALL)
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").groupBy("role").count().collect()
    for role, n in turns:
        files = source.scans[f"{role}:test"].inputFiles()
        assert len(files) >= n / 10 and source.scans[f"{role}:test"].count() == n


def test_queries_leave_the_session_alone(spark):
    before = dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.shuffle.partitions")
    for name in ("first_n_rows", "transcribe_batch", "stream_running_summary"):
        QUERIES[name](spark, SF_SMALL)
    after = dict(spark.sparkContext._conf.getAll()), spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.sql.shuffle.partitions")
    assert before == after


# ---- tables of several files ----------------------------------------------------


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The small tables again, the turns in seven files in order, the rest in three each."""
    import os

    root = str(tmp_path_factory.mktemp("many"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        df = df.repartitionByRange(7, "conv_id", "turn").sortWithinPartitions("conv_id", "turn") if t == "conversations" else df.repartition(3)
        df.write.parquet(f"{root}/{t}.parquet")
    assert len([f for f in os.listdir(f"{root}/conversations.parquet") if f.startswith("part-")]) == 7
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_several_files(spark, con, many_files, name):
    test_query_matches_oracle(spark, con, name, many_files)


def test_limit_opens_only_the_files_it_needs(spark, many_files):
    from scorelake.sources.tables import read_first_rows

    path = f"{many_files}/conversations.parquet"
    whole = sorted(tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn").collect())
    for limit in (1, 10, 30, 500):
        head = read_first_rows(spark, path, limit, ["conv_id", "turn"])
        rows = sorted(head.collect(), key=lambda r: r["row_index"])
        assert [(r["conv_id"], r["turn"], r["row_index"]) for r in rows] == [(*w, i) for i, w in enumerate(whole[:limit])]
        assert len(head.inputFiles()) == {1: 1, 10: 1, 30: 3}.get(limit, 7)


def test_streams_of_several_batches(spark, many_files):
    """One file a batch: the keys stay unique and the summary is that of the whole table."""
    from scorelake.plans import queries as q
    from scorelake.streaming.stream import run_scored_stream, run_summary_stream

    path = f"{many_files}/conversations.parquet"
    got = run_scored_stream(spark, path, q._stream_records, q._TURN, max_files_per_trigger=1)
    keys = ["run_name", "row_index", "conv_id", "turn", "wer"]
    want = QUERIES["scored_records"](spark, many_files).where("run_name <> 'edge-cases'")
    assert sorted(map(repr, got.select(*keys).collect())) == sorted(map(repr, want.select(*keys).collect()))
    assert got.select("run_name", "row_index").distinct().count() == got.count()
    summary = run_summary_stream(spark, path, q._stream_records, q._TURN, max_files_per_trigger=2)
    want = QUERIES["corpus_summary"](spark, many_files).where("run_name <> 'edge-cases'")
    assert sorted(map(repr, summary.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_spread_starts_no_job(spark, many_files):
    from scorelake.plans.parallel import spread

    spark.sparkContext.setJobGroup("spread", "none expected")
    rows = spread(spark.read.schema("conv_id long").parquet(f"{many_files}/conversations.parquet"))
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows.rdd.getNumPartitions() == 32


def test_scoring_is_dealt_out_evenly_whatever_the_splits(spark):
    """More splits than cores, of which one gets the only row group, and fewer splits than tasks."""
    from scorelake.plans import parallel, pairs
    from scorelake.sources.tables import read_table, split_count
    from scorelake.streaming import stream

    sf, size = "/root/testdata/sf0.01", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = read_table(spark, sf, "conversations").select("conv_id", "turn", "text")
        assert split_count(table) >= 32
        assert max(table.rdd.glom().map(len).collect()) == table.count()
        sizes = pairs.conversation_pairs(spark, sf).select("conv_id").rdd.glom().map(len).collect()
        assert sum(sizes) == 3 * table.count() and max(sizes) <= 3 * 2 * -(-table.count() // len(sizes))
        assert "Repartition" in stream.read_utterance_stream(spark, f"{sf}/conversations.parquet")._jdf.queryExecution().analyzed().toString()
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(-(-int(os.path.getsize(f"{sf}/conversations.parquet")) // 20)))
        assert 8 <= split_count(table) < 32 and parallel.spread(table).rdd.getNumPartitions() == 32
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
