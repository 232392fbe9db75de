"""Annotation and timeline files as Spark formats."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmark.operators import intervals as iv
from segmark.sources import formats, reports, stores, textgrid
from segmark.sources.textgrid import TierChoice
from tests.test_sources import LONG, SHORT, grid, values

COLUMNS = ("path", "pos", "label", "start_s", "end_s")


@pytest.fixture()
def folder(spark, tmp_path):
    formats.register(spark)
    inside = tmp_path / "a b#%20"
    inside.mkdir()
    twice = SHORT.replace("<exists>\n1\n", "<exists>\n2\n") + SHORT.split("<exists>\n1\n")[1].replace('"b"', '"d"')
    texts = {
        "long": LONG, "twice": twice, "swapped": SHORT.replace('0\n0.5\n"b"', '0\n"b"\n0.5'), "cut": SHORT.replace('\n"c"\n', "\n"),
        "unquoted": SHORT.replace('"c"', "7"), "none": SHORT.split("<exists>\n")[0] + "<exists>\n0\n", "bad": "nothing here", "void": "",
        "empty": grid([]), "blank": grid([(" ", 0, 1), (" sil ", 1, 2), ('x ""y""', 2, 3)], "PHONES"),
        "minus": SHORT.replace("\n2\n0\n", "\n-2\n0\n"), "dotted": SHORT.replace("\n2\n0\n", "\n2.0\n0\n"),
    }
    for k, (name, text) in enumerate(texts.items()):
        ((inside if k % 2 else tmp_path) / f"{name}.TextGrid").write_text(text, encoding="utf-8")
    (tmp_path / "short.TEXTGRID").write_text(SHORT, encoding="utf-16")
    (tmp_path / "bytes.TextGrid").write_bytes(b"\xc3\x28\xa0")
    (tmp_path / "other.txt").write_text("no annotation")
    return str(tmp_path)


@pytest.mark.parametrize(
    "choice, options",
    [
        (TierChoice(), {}), (TierChoice(index=-1), {"tierIndex": "-1"}), (TierChoice(index=5), {"tierIndex": "5"}),
        (TierChoice(tier="x_2"), {"tier": "x_2"}), (TierChoice(contains="PHON"), {"tierContains": "PHON"}),
        (TierChoice(contains="PHON", index=0), {"tierContains": "PHON", "tierIndex": "0"}),
        (TierChoice(tier="x_2", rename_duplicates=False), {"tier": "x_2", "renameDuplicates": "false"}),
    ],
)
@pytest.mark.parametrize("silence", [True, False])
def test_format_reads_what_the_operators_read(spark, folder, choice, options, silence):
    texts = textgrid.read_texts(spark, folder).filter("lower(path) like '%.textgrid'")
    found = textgrid.tiers(texts, "path", choice.rename_duplicates)
    rows, failures = textgrid.read_intervals(found, choice, "path", silence)
    got = spark.read.format("segmark_textgrid").options(**options).option("removeSilence", str(silence)).load(folder)
    assert values(got.filter("error is null"), *COLUMNS) == values(rows, *COLUMNS)
    assert values(got.filter("error is not null"), "path", "error") == values(failures, "path", "reason")


def test_listing_slices_schema_and_modes(spark, folder):
    whole = spark.read.format("segmark_textgrid").load(folder)
    files = stores.list_paths(spark, folder).filter("lower(path) like '%.textgrid'")
    sliced = formats.read_annotations(spark, files, filesPerTask="3")
    assert sliced.rdd.getNumPartitions() >= 5 and values(sliced, *sliced.columns) == values(whole, *sliced.columns)
    narrow = formats.read_annotations(spark, files, "label string, path string", mode="dropmalformed")
    assert narrow.columns == ["label", "path"] and values(narrow, "path", "label") == values(whole.filter("error is null"), "path", "label")
    with pytest.raises(Exception, match="no such columns"):
        formats.read_annotations(spark, files, "other string").collect()
    with pytest.raises(Exception, match="readable|UTF-16|no tiers"):
        formats.read_annotations(spark, files, mode="failfast").collect()
    none = formats.read_annotations(spark, files.filter("false"))
    assert none.count() == 0 and none.columns == whole.columns


def test_format_in_sql(spark, folder):
    spark.sql(f"create or replace temporary view grids using segmark_textgrid options (path '{folder}', tierContains 'phon')")
    got = [tuple(r) for r in spark.sql("select label, end_s - start_s from grids where path like '%long%' order by pos").collect()]
    assert got == [("a", 0.5), ('say "9 1" now', 0.5)]


def lines(path):
    names = sorted(n for n in os.listdir(path) if n.endswith(".etf"))
    return "".join(open(f"{path}/{n}", encoding="utf-8").read() for n in names).splitlines()


def test_timeline_is_written_in_order_and_read_back(spark, tmp_path):
    formats.register(spark)
    rows = [(f"u {k % 7}", k, x, k / 10, (k + 1) / 10) for k, x in enumerate("abcab é"[k % 7] for k in range(300))]
    timeline = iv.etf_rows(spark.createDataFrame(rows, "utt string, pos int, phoneme string, start_s double, end_s double"))
    path = str(tmp_path / "out")
    formats.write_timeline(timeline, path)
    want = [r["value"] for r in reports.etf_lines(timeline).orderBy("utt", "target", "start_s").collect()]
    assert lines(path) == want and not [n for n in os.listdir(path) if n.startswith(formats.PENDING)]
    back = spark.read.format("segmark_etf").load(path)
    six = lambda df: values(df.withColumns({c: F.round(c, 5) for c in ("start_s", "duration_s")}), *back.columns)
    assert six(back) == six(timeline)
    formats.write_timeline(timeline.filter("target = 'a'"), path)
    assert len(lines(path)) == timeline.filter("target = 'a'").count()
    formats.write_timeline(timeline.filter("target = 'b'"), path, "append")
    assert len(lines(path)) == timeline.filter("target in ('a', 'b')").count()
    formats.write_timeline(timeline.filter("false"), path)
    assert lines(path) == [] and spark.read.format("segmark_etf").load(path).count() == 0


def test_failed_write_leaves_the_former_timeline(spark, tmp_path):
    formats.register(spark)
    path, make = str(tmp_path / "out"), F.when(F.col("id") == 700, F.raise_error(F.lit("a row at fault")).cast("double")).otherwise(F.col("id") / 10)
    base = spark.range(0, 1000, 1, 4).select(F.format_string("u%03d", "id").alias("utt"), "id", F.lit(0.1).alias("duration_s"), F.lit("x").alias("target"), F.lit("t").alias("decision"))
    good = base.withColumn("start_s", F.col("id") / 10).drop("id")
    good.write.format("segmark_etf").mode("overwrite").save(path)
    files = lambda: sorted(n for n in os.listdir(path) if not n.startswith(formats.PENDING))
    before = files()
    with pytest.raises(Exception, match="a row at fault"):
        base.withColumn("start_s", make).drop("id").write.format("segmark_etf").mode("overwrite").save(path)
    assert files() == before and spark.read.format("segmark_etf").load(path).count() == 1000
    with pytest.raises(Exception, match="a timeline has the columns"):
        good.drop("target").write.format("segmark_etf").mode("append").save(path)
    assert files() == before
    good.filter("utt < 'u500'").write.format("segmark_etf").mode("overwrite").save(path)
    assert len(lines(path)) == 500 and not set(before[1:]) & set(files()) and not [n for n in os.listdir(path) if n.startswith(formats.PENDING)]


def test_timeline_lines_in_batches():
    rng = random.Random(5)
    times = [0.0, -0.0, 1e-7, 0.0000005, 0.0000015, 2.5, 1234567.1234565, -3.25, *(rng.uniform(-9, 9) for _ in range(200))]
    names = ["u1", "a 1 0.000000 1.000000 sc - b", "é ẽ", "", "x - y"]
    rows = [(rng.choice(names), rng.choice(times), rng.choice(times), rng.choice(names), rng.choice("tf")) for _ in range(2000)]
    batch = pa.RecordBatch.from_pylist([dict(zip(formats.TIMELINE, r)) for r in rows], schema=pa.schema([(n, formats.ARROW[k]) for n, k in formats.TIMELINE.items()]))
    lines = [f"{u} 1 {a:.6f} {b:.6f} sc - {t} - {d}\n" for u, a, b, t, d in rows]
    assert formats.lines_of(batch).to_pylist() == lines
    back = formats.rows_of_lines([x[:-1].encode() for x in lines], "p")
    plain = re.compile(r"(.*) 1 (-?\d+\.\d{6}) (-?\d+\.\d{6}) sc - (.*) - ([tf])")
    want = [(m[1], float(m[2]), float(m[3]), m[4], m[5]) for m in (plain.fullmatch(x[:-1]) for x in lines)]
    assert [tuple(r.values()) for r in back.to_pylist()] == want
    with pytest.raises(ValueError, match="not a line of a timeline in p: 'odd'"):
        formats.rows_of_lines([lines[0][:-1].encode(), b"odd"], "p")
    with pytest.raises(TypeError):
        formats.lines_of(batch.set_column(1, "start_s", pa.nulls(len(rows), pa.float64())))
