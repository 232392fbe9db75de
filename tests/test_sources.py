"""Readers, writers and the whole job over real files."""

import json
import os
import struct
import wave

import pytest
from pyspark.sql import functions as F

from segmark.operators import dataset as ds
from segmark.operators import frames as fr
from segmark.operators import metrics, seqalign
from segmark.operators.metrics import ScoreOptions
from segmark.plans.evaluation import EvaluationJob, EvaluationOptions, rescore
from segmark.sources import audio, manifest, reports, runstore, stores, tables, textgrid


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


LONG = '''File type = "ooTextFile"
Object class = "TextGrid"

xmin = 0
xmax = 1.5
tiers? <exists>
size = 2
item []:
    item [1]:
        class = "TextTier"
        name = "marks"
        xmin = 0
        xmax = 1.5
        points: size = 1
        points [1]:
            number = 0.25
            mark = "p"
    item [2]:
        class = "IntervalTier"
        name = "Phones"
        xmin = 0
        xmax = 1.5
        intervals: size = 4
        intervals [1]:
            xmin = 0
            xmax = 0.5
            text = " a "
        intervals [2]:
            xmin = 0.5
            xmax = 0.75
            text = "SIL"
        intervals [3]:
            xmin = 0.75
            xmax = 1
            text = ""
        intervals [4]:
            xmin = 1
            xmax = 1.5
            text = "say ""9 1"" now"
'''

SHORT = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n1\n<exists>\n1\n"IntervalTier"\n"x"\n0\n1\n2\n0\n0.5\n"b"\n0.5\n1\n"c"\n'


def grid(labels, tier="phones"):
    items = "".join(f'{s}\n{e}\n"{x}"\n' for x, s, e in labels)
    end = labels[-1][2] if labels else 1
    return f'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n{end}\n<exists>\n1\n"IntervalTier"\n"{tier}"\n0\n{end}\n{len(labels)}\n{items}'


def sound(path, seconds, rate=16000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * int(seconds * rate))


@pytest.fixture()
def grids(spark, tmp_path):
    (tmp_path / "long.TextGrid").write_text(LONG, encoding="utf-8")
    (tmp_path / "short.TextGrid").write_text(SHORT, encoding="utf-16")
    (tmp_path / "bad.TextGrid").write_text("nothing here", encoding="utf-8")
    (tmp_path / "bytes.TextGrid").write_bytes(b"\xc3\x28\xa0")
    texts = textgrid.read_texts(spark, str(tmp_path))
    return texts.withColumn("utt", F.regexp_extract("path", r"([^/]+)\.TextGrid$", 1))


def test_long_and_short_text(grids):
    rows, failures = textgrid.read_intervals(textgrid.tiers(grids))
    assert values(rows, "utt", "pos", "label", "start_s", "end_s") == [
        ("long", 0, "a", 0.0, 0.5),
        ("long", 3, 'say "9 1" now', 1.0, 1.5),
        ("short", 0, "b", 0.0, 0.5),
        ("short", 1, "c", 0.5, 1.0),
    ]
    assert [r["utt"] for r in failures.orderBy("utt").collect()] == ["bad", "bytes"]
    kept, _ = textgrid.read_intervals(textgrid.tiers(grids), remove_silence=False)
    assert ("long", "SIL") in values(kept, "utt", "label")


def test_tier_choices(grids):
    found = textgrid.tiers(grids)
    assert values(textgrid.tier_names(found), "utt", "tier_pos", "tier_name") == [
        ("long", 0, "marks"), ("long", 1, "Phones"), ("short", 0, "x")]
    reasons = dict(values(textgrid.read_intervals(found, textgrid.TierChoice(index=0))[1], "utt", "reason"))
    assert "points" in reasons["long"] and "short" not in reasons
    reasons = dict(values(textgrid.read_intervals(found, textgrid.TierChoice(tier="Phones"))[1], "utt", "reason"))
    assert reasons["short"].startswith("KeyError")
    rows, failures = textgrid.read_intervals(found, textgrid.TierChoice(contains="PHON", index=-1))
    assert {r["utt"] for r in rows.collect()} == {"long", "short"}
    assert "short" not in dict(values(failures, "utt", "reason"))


def test_repeated_tier_names(spark):
    twice = SHORT.replace("<exists>\n1\n", "<exists>\n2\n") + SHORT.split("<exists>\n1\n")[1].replace('"b"', '"d"')
    texts = spark.createDataFrame([("u", twice, None)], "utt string, content string, error string")
    assert values(textgrid.tier_names(textgrid.tiers(texts)), "tier_name") == [("x",), ("x_2",)]
    assert values(textgrid.tier_names(textgrid.tiers(texts, rename_duplicates=False)), "tier_name") == [("x",), ("x",)]


def test_durations(spark, tmp_path):
    sound(tmp_path / "a.wav", 1.5)
    info = bytearray(34)
    info[10:18] = ((44100 << 44) | 22050).to_bytes(8, "big")
    (tmp_path / "b.flac").write_bytes(b"fLaC\x00\x00\x00\x22" + bytes(info))
    (tmp_path / "c.wav").write_bytes(b"RIFF" + struct.pack("<I", 4) + b"WAVE")
    got = audio.durations(manifest.list_files(spark, str(tmp_path)))
    name = F.element_at(F.split("path", "/"), -1).alias("n")
    assert values(got, name, "duration_s") == [("a.wav", 1.5), ("b.flac", 0.5), ("c.wav", None)]
    assert got.filter("error is not null").count() == 1


def ogg(head, granule):
    page = lambda g, body: b"OggS\0\0" + struct.pack("<qIIIBB", g, 1, 0, 0, 1, len(body)) + body
    return page(0, head) + page(100, b"x" * 200) + page(granule, b"y" * 9)


def mp3(frames, tag=b"", kbps=9, version=3):
    # 128 kbit/s, 44100 samples/s, stereo: 417 bytes a frame.
    head = (0x7FF << 21 | version << 19 | 1 << 17 | 1 << 16 | kbps << 12).to_bytes(4, "big")
    first = head + (b"\0" * 32 + tag).ljust(413, b"\0")
    return first + (head + b"\0" * 413) * (frames - 1)


def test_ogg_and_mp3_durations(spark, tmp_path):
    vorbis = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 22050) + b"\0" * 14
    opus = b"OpusHead" + struct.pack("<BBHI", 1, 2, 312, 44100) + b"\0" * 3
    (tmp_path / "v.ogg").write_bytes(ogg(vorbis, 33075))
    (tmp_path / "o.ogg").write_bytes(ogg(opus, 48000 + 312))
    (tmp_path / "c.mp3").write_bytes(b"ID3\x04\0\0\0\0\0\x0a" + b"\0" * 10 + mp3(100) + b"TAG" + b"\0" * 125)
    (tmp_path / "x.mp3").write_bytes(mp3(3, b"Xing" + struct.pack(">II", 1, 49)))
    lame = (b"Xing" + struct.pack(">II", 1, 50)).ljust(120, b"\0") + b"LAME" + b"\0" * 17 + (576 << 12 | 600).to_bytes(3, "big")
    (tmp_path / "l.mp3").write_bytes(mp3(2, lame))
    (tmp_path / "bad.ogg").write_bytes(b"OggS" + b"\0" * 60)
    (tmp_path / "bad.mp3").write_bytes(b"\xff\xe0" + b"\0" * 60)
    got = {r["path"].rpartition("/")[2]: r["duration_s"] for r in audio.durations(manifest.list_files(spark, str(tmp_path))).collect()}
    assert got["v.ogg"] == 1.5 and got["o.ogg"] == 1.0 and got["bad.ogg"] is None and got["bad.mp3"] is None
    assert got["c.mp3"] == pytest.approx(41700 * 8 / 128000) and got["x.mp3"] == pytest.approx(49 * 1152 / 44100)
    assert got["l.mp3"] == pytest.approx((50 * 1152 - 1176) / 44100)


def test_names_of_every_kind(spark, tmp_path):
    names = ["_a.wav", "b c.wav", "d#e.wav", "f%20g.wav", "ħé漢.wav", "sub/_h/i.wav", "sub/j k/_l#%.wav"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        sound(tmp_path / n, 0.5)
    (tmp_path / ".hidden.wav").write_bytes(b"")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):
        listed = manifest.index_by_stem(manifest.list_files(spark, root), manifest.AUDIO_EXTENSIONS)
        assert {r["stem"] for r in listed.collect()} == {n.rpartition("/")[2][:-4] for n in names}
        assert values(audio.durations(listed), "duration_s", "error") == [(0.5, None)] * len(names)
    flat = manifest.list_files(spark, str(tmp_path), recursive=False)
    assert flat.count() == 6


def test_tokens_out_of_order_fail_alone(spark):
    good = SHORT
    swapped = SHORT.replace('0\n0.5\n"b"', '0\n"b"\n0.5')
    short = SHORT.replace('\n"c"\n', "\n")
    unquoted = SHORT.replace('"c"', "7")
    texts = spark.createDataFrame([(k, x, None) for k, x in zip("abcd", (good, swapped, short, unquoted))], "utt string, content string, error string")
    rows, failures = textgrid.read_intervals(textgrid.tiers(texts))
    assert {r["utt"] for r in rows.collect()} == {"a"}
    assert values(failures, "utt") == [("b",), ("c",), ("d",)]


def test_file_order(spark, tmp_path):
    for k in range(3):
        lines = "\n".join(f"f{k}_{i}.wav,{'' if i % 4 == 3 else 'NA b'}" for i in range(50))
        (tmp_path / f"part{k}.csv").write_text("path,phonemes\n" + lines + "\n")
    rows = ds.load_split(tables.read_csv(spark, str(tmp_path)), "/clips", "path", "phonemes").orderBy("row_idx").collect()
    want = [f"/clips/f{k}_{i}.wav" for k in range(3) for i in range(50) if i % 4 != 3]
    assert [r["audio"] for r in rows] == want
    assert [r["row_idx"] for r in rows] == list(range(len(want)))
    assert {r["phonemes"] for r in rows} == {"NA b"}
    with pytest.raises(ValueError):
        ds.training_rows(spark.createDataFrame([(1,)], "x int"), "c")


def test_group_file(spark, tmp_path):
    (tmp_path / "g.csv").write_text('file,style\n a ,x\nb,\na,"y, z"\n,w\n')
    lines = tables.read_group_rows(spark, str(tmp_path / "g.csv"))
    assert values(manifest.group_map(lines), "key", "group") == [("a", "y, z"), ("b", "ALL")]
    with pytest.raises(KeyError):
        manifest.group_map(lines, "nope")


def test_vocab_files(spark, tmp_path):
    rows = spark.createDataFrame([("b a",), ("a ʁ",)], "phonemes string")
    vocab = ds.build_vocab(rows)
    tables.write_vocab(vocab, str(tmp_path / "v"))
    part = next((tmp_path / "v").glob("part-*"))
    assert json.loads(part.read_text()) == {"a": 0, "b": 1, "ʁ": 2, "[UNK]": 3, "[PAD]": 4}
    assert values(tables.read_vocab(spark, str(tmp_path / "v")), "token", "id") == values(vocab, "token", "id")
    known = spark.createDataFrame([("[UNK] a",)], "phonemes string")
    assert dict(values(ds.build_vocab(known), "token", "id")) == {"a": 1, "[UNK]": 2, "[PAD]": 2}
    (tmp_path / "m.json").write_text("[1]")
    with pytest.raises(ValueError):
        tables.read_label_map(spark, str(tmp_path / "m.json"))


def test_chunks_resume(spark, tmp_path):
    rows = spark.range(100).selectExpr("id AS row_idx", "CAST(IF(id % 10 = 0, 10, 32000) AS INT) AS input_length")
    path = str(tmp_path / "chunks")
    with pytest.raises(FileNotFoundError):
        ds.read_chunks(spark, path)
    ds.write_chunks(rows.filter("row_idx < 50"), path, 25)
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "chunks").rglob("*.parquet")}
    ds.write_chunks(rows, path, 25)
    got = ds.read_chunks(spark, path)
    assert got.count() == 90 and got.select("chunk_id").distinct().count() == 4
    later = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "chunks").rglob("*.parquet")}
    assert first.items() <= later.items()
    ds.write_once(rows, str(tmp_path / "eval"))
    ds.write_once(rows.limit(1), str(tmp_path / "eval"))
    assert spark.read.parquet(str(tmp_path / "eval")).count() == 100


@pytest.mark.parametrize("together", [None, 1, 3])
def test_chunks_are_committed_one_by_one(spark, tmp_path, together):
    """Emptied chunks are done too; a chunk without a record is replaced, one with a record is left alone."""
    rows = spark.range(100).selectExpr("id AS row_idx", "CAST(IF(id BETWEEN 20 AND 39, 10, 32000) AS INT) AS input_length")
    path = tmp_path / "chunks"
    ds.write_chunks(rows, str(path), 20, together=together)
    assert values(ds.committed_chunks(spark, str(path)), "chunk_id", "n") == [(0, 20), (1, 0), (2, 20), (3, 20), (4, 20)]
    stamps = {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    ds.write_chunks(rows.withColumn("input_length", F.lit(32000)), str(path), 20, together=together)
    assert ds.read_chunks(spark, str(path)).count() == 80  # the emptied chunk was not looked at again
    # A run that died: chunk 2 has some of its rows and no record.
    log = ds.committed_chunks(spark, str(path)).filter("chunk_id <> 2").collect()
    spark.createDataFrame(log).coalesce(1).write.mode("overwrite").parquet(str(path / "_commits"))
    for p in list((path / "chunk_id=2").glob("*.parquet"))[:1]:
        spark.read.parquet(str(p)).limit(5).write.mode("append").parquet(str(path / "chunk_id=2"))
    ds.write_chunks(rows, str(path), 20, together=together)
    got = ds.read_chunks(spark, str(path))
    assert sorted(r.row_idx for r in got.collect()) == [k for k in range(100) if not 20 <= k <= 39]
    left = {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "chunk_id=2" not in str(p) and "_commits" not in str(p)}
    assert left.items() <= stamps.items()


def test_corpus_error_rate(spark):
    schema = "labels array<int>, predicted array<int>"
    rows = spark.createDataFrame([([1, 1, 2, -100], [1, 1, 0, 1, 3, 0]), ([-100, 0], [2, 2])], schema)
    assert ds.corpus_error_rate(rows, 0).first()[0] == pytest.approx(1 / 3)
    assert ds.corpus_error_rate(rows.limit(0), 0).first()[0] == 1.0


@pytest.fixture()
def corpus(tmp_path):
    for folder in ("wav", "ref", "hyp"):
        (tmp_path / folder).mkdir()
    for k in range(4):
        sound(tmp_path / "wav" / f"s{k}.wav", 1.0)
        # s1 keeps the clock of a longer session.
        t = 30.0 if k == 1 else 0.0
        seq = [("A", t + 0.0, t + 0.3), ("sil", t + 0.3, t + 0.4), ("R", t + 0.4, t + 0.9)]
        (tmp_path / "ref" / f"s{k}-ref.TextGrid").write_text(grid(seq, "sampa"))
        labels = [("%", 0.0, 0.9)] if k == 2 else [("a", 0.0, 0.31), ("ʁ", 0.41, 0.9)]
        (tmp_path / "hyp" / f"s{k}.TextGrid").write_text(grid(labels))
    (tmp_path / "ref" / "lonely.TextGrid").write_text(SHORT)
    (tmp_path / "styles.csv").write_text("file,style\ns0,read\ns1.wav,free\n")
    return tmp_path


def options(corpus, **more):
    return EvaluationOptions(
        audio_dir=str(corpus / "wav"), ref_dir=str(corpus / "ref"), ref_stem_suffix="-ref", ref_preset="french-sampa",
        groups_csv=str(corpus / "styles.csv"), out_dir=str(corpus / "out"), **more
    )


def test_job_over_folders(spark, corpus):
    job = EvaluationJob(options(corpus, hyp_dir=str(corpus / "hyp"), exclude=["s3"], per_phoneme=True, etf=True))
    assert values(manifest.skipped(job.pairs(spark)), "*") == [("lonely", "no audio file"), ("s3", "excluded")]
    result = job.run(spark)
    assert [r["utt"] for r in result.failures.collect()] == ["s2"]
    assert "2 in the reference, 0 in the hypothesis" in result.failures.first()["reason"]
    rows = {r["group"]: r for r in result.report.collect()}
    assert set(rows) == {"s0", "s1", "STYLE_read", "STYLE_free", "GLOBAL"}
    # The second recording is re-anchored before scoring, so both agree.
    for name in ("s0", "s1"):
        assert rows[name]["k"] == 2 and rows[name]["aas_ms"] == pytest.approx(5.0)
        assert rows[name]["per_pct"] == 0.0
    out = corpus / "out"
    csv = spark.read.option("header", True).csv(str(out / "metrics_textgrid.csv"))
    assert csv.columns[:4] == ["group", "style", "K", "AAS (ms)"] and csv.columns[-1] == "F1@50ms (%)"
    # The order of the lines: files, styles, the overall row.
    assert [r[0] for r in csv.collect()] == ["s0", "s1", "STYLE_free", "STYLE_read", "GLOBAL"]
    assert values(spark.read.option("header", True).csv(str(out / "predictions_textgrid.csv")), "*") == [("s0", "a ʁ"), ("s1", "a ʁ")]
    etf = [r[0] for r in spark.read.text(str(out / "hyp_textgrid.etf")).collect()]
    assert len(etf) == 8 and "s0 1 0.000000 0.310000 sc - a - t" in etf and "s0 1 0.000000 0.310000 sc - ʁ - f" in etf
    report = [r[0] for r in spark.read.text(str(out / "inventory_textgrid.txt")).collect()]
    assert report[:3] == ["Reference inventory: 2 symbols", "Hypothesis inventory: 2 symbols", "Shared: 2 symbols"]
    assert "Inventories are identical." in report
    table = spark.read.option("header", True).csv(str(out / "per_phoneme_textgrid.csv"))
    assert table.columns[:2] == ["phoneme", "K"] and table.count() == 2
    again = rescore(spark, str(out / "alignment_textgrid"), ScoreOptions((0.005,), None))
    row = again.filter("level = 'global'").first()
    assert row["n_ref"] == 4 and row["r_5ms_pct"] == pytest.approx(4 / 6 * 100)


def test_limit_opens_no_other_file(spark, corpus):
    # Unreadable files beyond the limit would fail if they were opened.
    for folder, name in (("wav", "z.wav"), ("ref", "z-ref.TextGrid"), ("hyp", "z.TextGrid")):
        (corpus / folder / name).symlink_to(corpus / folder / "s0.none")
    job = EvaluationJob(options(corpus, hyp_dir=str(corpus / "hyp"), limit=3))
    rows = job._samples(spark, job.pairs(spark))
    assert values(rows, "stem") == [("s0",), ("s1",), ("s2",)]
    seen = textgrid.read_paths(rows.select("utt", F.col("ref_path").alias("path")))
    assert seen.count() == 3 and "binaryFile" not in seen._jdf.queryExecution().executedPlan().toString()


def test_accounts_of_a_run(spark, corpus):
    lengths = spark.createDataFrame([("s1", 1.0)], "utt string, duration_s double")
    (corpus / "wav" / "s1.wav").write_bytes(b"not a sound")
    job = EvaluationJob(options(corpus, hyp_dir=str(corpus / "hyp"), exclude=["s3"]), durations=lengths)
    result = job.run(spark)
    assert values(result.skipped, "stem") == [("lonely",), ("s3",)]
    assert values(result.ungrouped, "stem") == [("s2",)]
    assert dict(values(result.summary, "what", "n")) == {"skipped: excluded": 1, "skipped: no audio file": 1, "evaluated": 2, "failed": 1}
    assert spark.read.parquet(str(corpus / "out" / "summary_textgrid")).count() == 4
    with pytest.raises(ValueError):
        options(corpus, ref_offset="x")
    with pytest.raises(ValueError):
        options(corpus, decoder="x")


def test_fail_fast(spark, corpus):
    wrong = options(corpus, hyp_dir=str(corpus / "hyp"), ref_tier=textgrid.TierChoice(tier="nope"))
    with pytest.raises(RuntimeError, match="no recording of the first 3"):
        EvaluationJob(wrong).run(spark)
    with pytest.raises(RuntimeError, match="no audio/reference pairs"):
        EvaluationJob(options(corpus, hyp_dir=str(corpus / "hyp"), exclude=["s0", "s1", "s2", "s3"])).run(spark)


def test_job_from_posteriors(spark, corpus):
    vocab = spark.createDataFrame([(0, "[PAD]"), (1, "a"), (2, "ʁ"), (3, "[UNK]")], "id int, token string")
    best = [1] * 15 + [0] * 5 + [2] * 25 + [0] * 5
    rows = [(f"s{k}", 0, f, [1.0 if c == b else 0.0 for c in range(4)]) for k in range(4) for f, b in enumerate(best)]
    frames = spark.createDataFrame(rows, "utt string, chunk int, frame int, logits array<float>")
    job = EvaluationJob(
        options(corpus, hypothesis="ctc"), frames=frames, vocab=vocab, ctc=fr.ctc_options("wav2vec2", unk_id=3)
    )
    result = job.run(spark)
    rows = {r["group"]: r for r in result.report.collect()}
    assert rows["GLOBAL"]["per_pct"] == 0.0 and rows["GLOBAL"]["k"] == 8
    assert rows["s0"]["aas_ms"] == pytest.approx(0.0, abs=1e-6)
    assert values(result.predictions, "utt", "phonemes")[0] == ("s0", "a ʁ")


def test_inventory_lines_differ(spark):
    inv = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True)], "phoneme string, in_ref boolean, in_hyp boolean")
    lines = [r["value"] for r in reports.inventory_lines(inv).orderBy("line_no").collect()]
    assert lines == [
        "Reference inventory: 2 symbols", "Hypothesis inventory: 2 symbols", "Shared: 1 symbols", "",
        "Inventories differ.", "", "Only in REFERENCE:", "  b", "", "Only in HYPOTHESIS:", "  c", "",
        "REFERENCE:  a b", "HYPOTHESIS: a c"]


@pytest.mark.parametrize("slice_", [10_000, 7])
def test_listing_by_levels(spark, tmp_path, monkeypatch, slice_):
    """A flat folder, a deep one, odd names, links back to a folder above: every file once, in slices."""
    monkeypatch.setattr(stores, "SLICE", slice_)
    want = set()
    for name in [*(f"flat/{i}.wav" for i in range(300)), "/".join("abcdefghijkl") + "/deep.wav", "a/b/#x %20 y.wav", "a/.hidden", "top.wav"]:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"")
        want.add(str(path))
    (tmp_path / "empty" / "inner").mkdir(parents=True)
    (tmp_path / "a" / "loop").symlink_to(tmp_path, target_is_directory=True)
    got = [r.path for r in stores.list_paths(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert [r.path for r in stores.list_paths(spark, f"file://{tmp_path}", recursive=False).collect()] == [f"file://{tmp_path}/top.wav"]


# ---- stored runs --------------------------------------------------------------------------------


def _both(spark, utts=40, labels=6):
    rows = spark.range(utts).selectExpr("concat('u', id) AS utt", "id")
    sides = "explode(array('ref', 'hyp')) AS side"
    n = f"explode(sequence(0L, {labels - 1}L + IF(id = 7, 50, 0))) AS pos"
    rows = rows.selectExpr("*", sides).selectExpr("*", n)
    return rows.selectExpr(
        "utt", "concat(utt, '.wav') AS file", "IF(id % 2 = 0, 'a', 'b') AS style", "side", "pos",
        "IF(side = 'hyp' AND (pos + id) % 5 = 0, 'x', concat('p', pos % 3)) AS phoneme",
        "pos * 0.1D + IF(side = 'hyp', 0.01D, 0D) AS start_s", "pos * 0.1D + 0.1D AS end_s", "'more' AS extra",
    )


def _plain(df):
    rows = (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    return sorted(rows, key=repr)


def test_stored_run_is_scored_without_an_exchange(spark, tmp_path):
    both = _both(spark).cache()
    path = f"{tmp_path}/a 'store'"
    runstore.write_store(both, path, bucket_rows=64)
    run = runstore.read_split(spark, path)
    assert run.long is None and run.longest == 56
    assert _plain(runstore.read_store(spark, path)) == _plain(both.select(*runstore.COLUMNS))
    plans = [seqalign.gather(df)._jdf.queryExecution().executedPlan().toString() for df in (run.short, both)]
    assert ["Exchange" in p for p in plans] == [False, True] and "Bucketed: true" in plans[0]
    files = [f for f in os.listdir(f"{path}/{[d for d in os.listdir(path) if d.startswith('short')][0]}") if f.endswith(".parquet")]
    buckets = -(-both.count() // 64)
    assert 1 < len(files) <= buckets  # one file a bucket
    options = ScoreOptions((0.005,), None)
    assert _plain(rescore(spark, path, options)) == _plain(metrics.report(metrics.score(both.drop("extra"), options)))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_stored_run_keeps_long_recordings_apart(spark, tmp_path):
    both, path = _both(spark), f"{tmp_path}/store"
    runstore.write_store(both, path, limit=20)
    run = runstore.read_split(spark, path)
    assert [r.utt for r in run.long.select("utt").distinct().collect()] == ["u7"]
    assert run.short.filter("utt = 'u7'").count() == 0
    assert _plain(run.short.unionByName(run.long)) == _plain(both.select(*runstore.COLUMNS))
    for limit in (20, 1000):  # by its parts, and under another limit than the store's
        options = ScoreOptions((0.005,), None, limit)
        assert _plain(rescore(spark, path, options)) == _plain(metrics.report(metrics.score(both.drop("extra"), options)))


def test_stored_run_is_replaced_whole(spark, tmp_path):
    both, path = _both(spark), f"{tmp_path}/store"
    with pytest.raises(FileNotFoundError):
        runstore.read_store(spark, path)
    runstore.write_store(both, path, limit=20)
    failing = both.withColumn("phoneme", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        runstore.write_store(failing, path)
    (tmp_path / "store" / "_store-9.json").write_text('{"short": "sho')  # a record cut off
    assert runstore.read_store(spark, path).count() == both.count()
    runstore.write_store(both.filter("utt = 'u1'"), path)
    assert runstore.read_store(spark, path).count() == 12
    assert not [d for d in os.listdir(path) if d.startswith("long")]
    runstore.write_store(both.limit(0), path)
    assert runstore.read_store(spark, path).count() == 0
    assert runstore.read_store(spark, path).columns == list(runstore.COLUMNS)


def test_intervals_that_are_written_are_found_once(spark):
    texts = spark.createDataFrame([("u1", SHORT, None), ("u2", "nothing", None), ("u3", LONG, None)], "utt string, content string, error string")
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    found = textgrid.tiers(texts.mapInPandas(seen, texts.schema))
    rows, failures = textgrid.read_intervals(found, write=True)
    plain = textgrid.read_intervals(textgrid.tiers(texts))
    assert [values(t, *t.columns) for t in (rows, failures)] == [values(t, *t.columns) for t in plain]
    assert calls.value == 3 and rows.count() > 0 and failures.count() == 1
