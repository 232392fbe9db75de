"""Quality rules, line dedup, licences."""

import hashlib
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from segmark.llm import licenses, linededup, quality
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("seed", range(30))
def test_counts_against_plain_loops(seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(["a ", "b ", "é|", "a\n", "\t", "#", "a b\n", "\x0b", "\x85", " "], k=rng.randint(0, 120)))
    assert quality.counts_of(text.encode())[:5] == plain_counts(text)


def test_counts_of_odd_rows(odd, crowded):
    for docs in (odd, crowded):
        judged, name = quality.judge(docs, [])
        rows = judged.collect()
        assert judged.columns[:-1] == docs.columns and name not in docs.columns
        got = sorted((r["doc_id"] or 0, *(r[name][c] for c in quality.COUNTS[:5]), r[name]["kept"]) for r in rows)
        want = sorted((d[0] or 0, *(c := plain_counts(d[1])), not (c[0] < 10 or 100 * c[4] > 20 * c[0])) for d in ODD)
        assert got == want


def test_list_finds_planted_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((6000, 4))
    bad = (x[:, 1] > 0.8) | ((x[:, 2] <= 0.2) & (x[:, 0] > 0.5))
    rules = quality.learn(x, bad)
    fresh = rng.random((4000, 4))
    hit = np.any([quality.covers(r, fresh) for r in rules], axis=0)
    truth = (fresh[:, 1] > 0.8) | ((fresh[:, 2] <= 0.2) & (fresh[:, 0] > 0.5))
    assert (hit == truth).mean() > 0.97 and hit[~truth].mean() < 0.02


@pytest.mark.parametrize("bad", [[], [0] * 50, [1] * 50])
def test_one_class_or_no_rows_gives_no_rules(bad):
    assert quality.learn(np.zeros((len(bad), 3)), np.array(bad, bool)) == []


def test_fit_without_labels_keeps_everything(spark, odd, empty):
    none = spark.createDataFrame([(1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, none) == []
    assert quality.judge(empty, quality.fit(empty, none))[0].count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality.fit(docs.filter("doc_id % 2 = 0"), labels)
    judged, name = quality.judge(docs.filter("doc_id % 2 = 1"), rules)
    rows = judged.join(labels, "doc_id").filter(f"not {name}.base_failed").groupBy("quality", f"{name}.kept").count().collect()
    counts = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert counts.get((1, False), 0) <= 0.01 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.05 * counts[0, False]


def plain_lines(rows, shortest=10):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    ident = lambda d: 2**63 if d is None else d
    docs = {}
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(ident(d))
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(k := key(x)) < shortest or min(docs[k]) == ident(d)]
        out.append((d or 0, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_lines_of_odd_rows(odd, crowded, empty):
    for docs in (odd, crowded):
        out, name = linededup.deduplicate(docs)
        assert out.columns[:-1] == docs.columns
        got = sorted((r["doc_id"] or 0, r[name]["n_lines"], r[name]["n_dropped"], r["text"] or "") for r in out.collect())
        assert got == plain_lines(ODD)
    assert linededup.deduplicate(empty)[0].count() == 0


def test_line_in_every_document_spreads(spark):
    rows = [(i, f"own line number {i} of this\nthe line that all of them have\nanother line number {i % 7} here") for i in range(3000)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out, name = linededup.deduplicate(docs)
    got = sorted((r["doc_id"], r[name]["n_lines"], r[name]["n_dropped"], r["text"]) for r in out.collect())
    assert got == plain_lines(rows)
    lines = linededup.line_rows(docs, 10)
    ranged = lines.repartitionByRange(6, *linededup.KEY)
    sizes = [len(x) for x in ranged.rdd.glom().collect()]
    assert max(sizes) < 2 * 9000 / 6


def test_license_spellings(spark, crowded, empty):
    mit = licenses.KNOWN[0][1]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Someone\nCopyright 2021 Others\n\n" + mit.upper()), (3, mit.replace("sublicense", "sub-licence").replace(", ", " -- ")),
        (4, mit + " But not quite."), (5, None), (6, ""), (7, "© 1999 x\n"), (None, mit), (1, mit), (8, "released under the mit licence"),
    ]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark))
    got = sorted(((r["doc_id"] or 0), r["license"]) for r in out.collect() if r["license"])
    assert got == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (8, "MIT notice")]
    assert out.count() == len(rows) and licenses.scan(crowded, licenses.known(spark)).count() == len(ODD)
    assert licenses.scan(empty, licenses.known(spark)).count() == 0
    many = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark), most_sent=1)
    assert sorted(((r["doc_id"] or 0), r["license"]) for r in many.collect() if r["license"]) == got


def test_license_plan_has_no_python(spark, odd):
    plan = licenses.scan(odd, licenses.known(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert hashlib.sha256(b"").hexdigest() in [r["digest"] for r in licenses.scan(odd, licenses.known(spark)).collect()]


def test_licenses_in_lines_and_runs_of_texts(spark, odd, crowded, empty):
    isc = dict(licenses.KNOWN)["ISC"].replace("\n\n", "\n")
    rows = [(1, "Some prose.\nReleased under the  MIT licence!"), (2, f"Prose.\n \n{isc}\n\nlast"), (3, "Released under the MIT License. Or not."), (None, "a\nLicensed under CC BY-NC 4.0.\nb\nlicensed under CC BY-NC 4.0"), (4, None)]
    got = licenses.parts(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark)).collect()
    assert {tuple(r) for r in got} == {(1, "line", "MIT notice", 1), (2, "run", "ISC", 1), (None, "line", "CC-BY-NC-4.0 notice", 2)} and len(got) == 3
    assert all(licenses.parts(d, licenses.known(spark)).count() == 0 for d in (odd, crowded, empty))


# Spellings that count as equal, stated again for the plain version.
SAME = """licence license;sub license sublicense;copyright owner copyright holder;acknowledgement acknowledgment;analogue analog;
authoris authoriz;behaviour behavior;catalogue catalog;centre center;colour color;favour favor;fulfill fulfil;initialis initializ;
judgement judgment;labell label;labour labor;non commercial noncommercial;organis organiz;per cent percent;practise practice;
programme program;realis realiz;recognis recogniz;utilis utiliz;whilst while;willful wilful;https http"""
#: Spellings of two words.
TWO = ("sub license", "copyright owner", "non commercial", "per cent")


def plain_form(text):
    """The canonical form in plain Python: lines of copyright go one by one, then words are spelled alike."""
    kept = []
    for line in text.lower().split("\n"):
        head = line.lstrip(" \t*#/;-")
        if re.match(r"copyright[ \t]*(\(c\)|©|<year>|[0-9]{4})|\(c\)[ \t]|©|all rights reserved\.?[ \t]*$", head):
            line = ""
        kept.append(line)
    words = " ".join("".join(c if c.isalpha() or unicodedata.category(c)[0] == "N" else " " for c in "\n".join(kept)).split())
    for pair in SAME.replace("\n", "").split(";"):
        own, common = next(((t, pair[len(t) + 1 :]) for t in TWO if pair.startswith(t + " ")), None) or pair.split()
        words = words.replace(own, common)
    return words


COMMON = "/usr/share/common-licenses"
#: File of each whole licence known by digest.
FILES = {
    "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3",
    "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0",
    "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
}


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts on this machine")
def test_whole_licenses_known_by_digest(spark):
    """Whole public texts as they are, wrapped anew, in capitals, with a notice in front, up to their last term, and changed."""
    rows, want, end = [], {}, "END OF TERMS AND CONDITIONS"
    for file, name in FILES.items():
        if not os.path.exists(f"{COMMON}/{file}"):
            continue
        text = open(f"{COMMON}/{file}", encoding="utf-8").read()
        forms = [text, text.replace("license", "licence"), "Copyright 2024 Some One\nAll rights reserved.\n\n" + text, text.upper()]
        forms += [text[: text.index(end) + len(end)]] if end in text else []
        forms += ["* " + text.replace("\n", "\n * ")]
        for form in forms:
            want[len(rows)] = name
            rows.append((len(rows), form))
        rows += [(len(rows), text + " One more term."), (len(rows) + 1, text[: len(text) // 2])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark)).filter("license is not null").collect()
    assert {r["doc_id"]: r["license"] for r in got} == want
    assert {hashlib.sha256(plain_form(t).encode()).hexdigest() for _, t in rows} >= {d for _, d in licenses.DIGESTS}


def test_license_parts_against_plain_python(spark, small):
    """Lines and runs of the given table, with licences planted in prose, by a form and digests of their own."""
    texts = [(n, t) for n, t in licenses.KNOWN]
    planted = [
        (10_000_000 + k, f"Some prose before.\n\n{t.upper() if k % 2 else t}\n\nAnd after.\n{t.split(chr(10))[0]}\nReleased under the MIT Licence")
        for k, (_, t) in enumerate(texts)
    ]
    docs = small.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    names = {}
    for n, t in sorted(texts, reverse=True):
        names[plain_form(t)] = n
    want = Counter()
    for r in docs.collect():
        for part, mark in (("line", r"\n"), ("run", r"\n[ \t\r]*\n")):
            for piece in re.split(mark, r["text"] or ""):
                form = plain_form(piece)
                if form and form in names:
                    want[r["doc_id"], part, names[form]] += 1
    got = licenses.parts(docs, licenses.known(spark)).collect()
    assert len(got) == len(want) and all(want[r["doc_id"], r["part"], r["license"]] == r["n"] for r in got)
    assert {n for _, _, n in want} >= {"MIT notice", "Apache-2.0 notice", "CC-BY-4.0 notice"} and any(d < 10_000_000 for d, _, _ in want)


def test_license_digests_given_by_the_caller(spark):
    rows = [("own", None, hashlib.sha256(b"two words").hexdigest().upper()), ("none", None, None), ("text", "Three more words", "ab")]
    known = spark.createDataFrame(rows, "license string, text string, digest string")
    docs = spark.createDataFrame([(1, "Two, words!"), (2, None), (3, "three more WORDS"), (4, "")], "doc_id long, text string")
    for most in (10, 1):
        got = {r["doc_id"]: r["license"] for r in licenses.scan(docs, known, most_sent=most).collect()}
        assert got == {1: "own", 2: None, 3: "text", 4: None}
