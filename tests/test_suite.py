"""Registered queries against their SQL twins on tables made for what the given ones lack."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from segmark.functions.labels import CustomRules
from segmark.plans import evaluation
from tests import oracle


def agrees(spark, sf_dir, name):
    con = oracle.connect(sf_dir)
    problems, rows, _, _ = oracle.compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert not problems
    return rows


def with_events(tmp_path, sql):
    """A data folder whose events are what ``sql`` says; the other tables are empty."""
    con = oracle.connect("/root/testdata/sf0.001")
    for t in oracle.TABLES:
        con.execute(f"copy ({sql if t == 'events' else f'select * from {t} limit 0'}) to '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


def test_segments_beyond_the_size_are_packed_whole(spark, tmp_path):
    # Scores (event_id * 7919 % 1000 / 1000): 0.9 for 60 frames of six seconds, then 0.1.
    events = """select (case when i between 3 and 62 then 100 else 900 end + 1000 * i)::bigint as event_id,
                       timestamp '2024-01-01' + to_seconds(i) as ts, 7::bigint as user_id, 'view' as event_type,
                       9.0::double as value, '{}' as props
                from range(70) r(i)"""
    assert agrees(spark, with_events(tmp_path, events), "q_vad_merge") == 1


def test_counting_the_recordings_of_a_store_runs_no_rule_again(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(label):
        calls.add(1)
        return label if label != "-" else None

    rules = CustomRules(F.udf(counted, "string"))
    rows = [(u, k, label, float(k), k + 1.0) for u, labels in (("u1", "ab"), ("u2", "-a"), ("u3", "--")) for k, label in enumerate(labels)]
    raw = spark.createDataFrame(rows, "utt string, pos long, label string, start_s double, end_s double")
    samples = raw.select("utt", F.col("utt").alias("file"), F.lit("ALL").alias("style")).distinct()
    store = evaluation.build_store(samples, raw, raw, None, evaluation.EvaluationOptions(ref_rules=rules, hyp_rules=rules))
    before = calls.value
    assert before > 0
    assert sorted(r[0] for r in store.recordings.collect()) == ["u1", "u2"] and calls.value == before
    assert sorted(r[0] for r in store.intervals.select("utt").distinct().collect()) == ["u1", "u2"]
