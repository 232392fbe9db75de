"""Min-max hashing, importance resampling, filter audit: each against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from segmark.llm import audit, minmax, resample
from tests.llm.conftest import ODD, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def plain_groups(rows):
    """(id, set size, smallest id reached, kept) of each row, by all pairs of sets that share a shingle."""
    sets = defaultdict(list)
    for doc, text in rows:
        sets[plain_set(text)].append(LAST if doc is None else doc)
    own = [s for s in sets if s]
    parent, holding = {s: s for s in own}, defaultdict(list)

    def top(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for s in own:
        for other, both in Counter(o for g in s for o in holding[g]).items():
            if 100 * both >= 85 * (len(s) + len(other) - both):
                parent[top(s)] = top(other)
        for g in s:
            holding[g].append(s)
    least = defaultdict(lambda: LAST)
    for s in own:
        least[top(s)] = min(least[top(s)], *sets[s])
    out = []
    for doc, text in rows:
        s, known = plain_set(text), LAST if doc is None else doc
        reached = least[top(s)] if s else known
        out.append((doc, len(s), None if reached == LAST else reached, known == reached))
    return Counter(out)


def shown(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def near_copies(rng, groups, size, edits):
    """Rows of groups whose members differ from their group's text in up to ``edits`` words."""
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_sets_are_those_of_plain_loops():
    rng = random.Random(1)
    texts = ["".join(rng.choices(["a ", "B", "b\n", "é ", "  ", "\x1c", "\x85", "Z\t", "İ "], k=rng.randint(0, 40))) for _ in range(500)]
    sets = minmax.shingle_sets(pa.array([*texts, None]))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in [*texts, None]]
    same = defaultdict(set)
    for t, s in zip(texts, sets):
        same[plain_set(t)].add(s.tobytes())
    assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85, 0.95):
        got = []
        for _ in range(60):
            both, n = rng.integers(0, 1 << 63, 400, np.uint64), int(400 * (1 / share - 1) / 2)
            a, b = (np.unique(np.append(both, rng.integers(0, 1 << 63, n, np.uint64))) for _ in range(2))
            x, y = minmax.signatures([a, b])
            got.append((x == y).mean())
        assert abs(np.mean(got) - share) < 0.015


@pytest.mark.parametrize("size,edits", [(2, 6), (30, 4), (200, 9)])
def test_groups_against_all_pairs(spark, monkeypatch, size, edits):
    rows = near_copies(random.Random(size), 400 // size, size, edits)
    assert shown(minmax.group(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_groups(rows)


def test_groups_in_small_stars_and_cells(spark, monkeypatch):
    monkeypatch.setattr(minmax, "STAR", 7)
    monkeypatch.setattr(minmax, "CHUNK", 2000)
    rows = near_copies(random.Random(5), 2, 150, 12)
    assert shown(minmax.group(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_groups(rows)


def test_groups_of_odd_rows(spark, odd, crowded, empty):
    want = plain_groups([d[:2] for d in ODD])
    assert shown(minmax.group(odd)) == want and shown(minmax.group(crowded)) == want
    assert minmax.group(empty).count() == 0
    rows = [(None, "one text of null ids here")] * 500 + [(7, "one text of null ids here")] * 300 + [(None, "other words stand in this one")] * 300 + [(None, None)] * 50
    assert shown(minmax.group(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_groups(rows)


TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    words = TERM.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target):
    corpus, goal = Counter(), Counter()
    for _, text in rows:
        corpus.update(plain_features(text)[1])
    for text in target:
        goal.update(plain_features(text)[1])
    big_s, big_t = sum(corpus.values()), sum(goal.values())
    scored = []
    for k, (doc, text) in enumerate(rows):
        words, found = plain_features(text)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1) * (big_s + 10000) / ((corpus[b] + 1) * (big_t + 10000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words, k))
    able = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[5]))
    ranks = {r[5]: i for i, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return Counter((*r[:4], ranks.get(r[5])) for r in scored)


def drawn(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_checksums_of_joined_strings():
    rng, sums = random.Random(3), resample.Checksums()
    strings = [bytes(rng.choices(range(256), k=rng.choice([0, 1, 5, 63, 64, 65, 66, 67, 300, 70000]))) for _ in range(200)]
    raw = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    own = sums.of(raw, np.cumsum(lengths) - lengths, lengths)
    assert own.tolist() == [zlib.crc32(s) for s in strings]
    joined = sums.shift(own[:-1], lengths[1:]) ^ own[1:]
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(strings, strings[1:])]


def test_features_are_those_of_plain_loops():
    rng = random.Random(4)
    texts = ["".join(rng.choices(["ab ", "B", "1", "é", "漢", " ", "_", "\n", "İ", "z" * 70, "Q-"], k=rng.randint(0, 60))) for _ in range(400)] + [None, ""]
    words, n, found = resample.features(pa.array(texts), 10000, 3)
    at = 0
    for t, w, k in zip(texts, words.tolist(), n.tolist()):
        assert (w, sorted(found[at : at + k].tolist())) == (lambda x: (x[0], sorted(x[1])))(plain_features(t))
        at += k


def test_resampling_against_plain_loops(spark, small, odd, crowded, empty):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    target = [r.text for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert drawn(resample.resample(small, bench)) == plain_resample(rows, target)
    want = plain_resample([d[:2] for d in ODD], target)
    assert drawn(resample.resample(odd, bench)) == want and drawn(resample.resample(crowded, bench)) == want
    assert resample.resample(empty, bench).count() == 0
    assert drawn(resample.resample(odd, empty)) == plain_resample([d[:2] for d in ODD], [])


def test_resampling_of_many_equal_rows(spark):
    text = " ".join(f"word{i}" for i in range(25))
    rows = [(None, text)] * 300 + [(5, text)] * 300 + [(k, text) for k in range(100, 300)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("word1 word2",)], "text string"))
    assert drawn(got) == plain_resample(rows, ["word1 word2"])


@pytest.mark.parametrize("samples", [1, 40, 10**6])
def test_ranks_by_regular_samples(spark, samples):
    rng = random.Random(6)
    rows = [(rng.choice([0, 0, 0, rng.randint(-9, 9), rng.randint(-(2**60), 2**60)]), k) for k in range(3000)]
    out = resample.regular_ranks(spark.createDataFrame(rows, "v long, uid long").repartition(7), ["v", "uid"], "rank", samples=samples)
    assert [(r.v, r.uid) for r in sorted(out.collect(), key=lambda r: r["rank"])] == sorted(rows)
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, 3001))


def plain_audit(rows, good, toxic):
    """rows: (id, text, lang)."""
    first = {}
    for doc, text, _ in rows:
        known = LAST if doc is None else doc
        first[text or ""] = min(first.get(text or "", known), known)
    docs = []
    for doc, text, lang in rows:
        t = text or ""
        words = WORD.findall(t)
        failing = set()
        if len(words) < 100:
            failing.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            failing.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            failing.add("C")
        if re.search(r"[#$%&*|]", t):
            failing.add("D")
        if (LAST if doc is None else doc) > first[t]:
            failing.add("E")
        docs.append((doc, lang or "", failing))
    out = set()
    for part in {d[1] for d in docs}:
        table, shapley = {}, Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = [d for d in docs if d[1] == part], []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[2]]
                redundant = sum(f in d[2] for d in gone)
                left = [d for d in left if f not in d[2]]
                gone += here
                shapley[f] += len(here)
                alone = sum(d[1] == part and d[2] == {f} for d in docs)
                table[order, step] = (len(left), len(here), redundant, alone, sum(d[0] in good for d in here), sum(d[0] in toxic for d in here))
        out |= {(part, order, step, *v, shapley[order[step - 1]]) for (order, step), v in table.items()}
    return out


def audited(df):
    rows = [tuple(r) for r in df.select("part", "filter_order", "step", *audit.COUNTS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


LABELS = "doc_id long, quality int, toxic int"


def test_audit_against_plain_loops(spark, small):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    marks = labels.collect()
    rows = [(r.doc_id, r.text, r.lang) for r in small.collect()]
    got = audited(audit.audit(small, labels))
    assert got == plain_audit(rows, {m.doc_id for m in marks if m.quality == 1}, {m.doc_id for m in marks if m.toxic == 1})


def test_audit_of_odd_rows(spark, odd, crowded, empty):
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, None), (2, None, 0), (None, 1, 1), (6, 0, 1), (8, 1, None), (99, 1, 1)]
    labels = spark.createDataFrame(marks, LABELS)
    want = plain_audit([(d[0], d[1], d[2]) for d in ODD], {1, 2, 8}, {2, 6})
    assert audited(audit.audit(odd, labels)) == want and audited(audit.audit(crowded, labels)) == want
    assert audit.audit(empty, labels).count() == 0
    none = spark.createDataFrame([], LABELS)
    assert audited(audit.audit(odd, none)) == plain_audit([(d[0], d[1], d[2]) for d in ODD], set(), set())


@pytest.mark.parametrize("seed", range(4))
def test_audit_of_random_rows(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(150):
        words = rng.choices(["a", "B", "cc", "#", "ÉÉ", "DDD", "\x85"], k=rng.choice([0, 3, 150])) + [f"w{i}" for i in range(rng.choice([0, 120]))]
        rows.append((rng.choice([k, k // 3, None]), rng.choice([None, "", " ".join(words), "same words"]), rng.choice(["en", "de", None, ""])))
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 150, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = audited(audit.audit(df, spark.createDataFrame(marks, LABELS)))
    assert got == plain_audit(rows, {m[0] for m in marks if m[1] == 1}, {m[0] for m in marks if m[2] == 1})
