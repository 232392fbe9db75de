"""Token files, SentencePiece, suffix arrays."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from segmark.llm import lyndon, pieces, suffixes, tokenfiles
from tests.llm.conftest import ODD

WORDS = public_tokenizers.path("word_bpe_49k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [*"abzAé \n\t0.,'’ß①漢́​!?\x85\x1c\x00▁", "the ", "'s ", "İ", "Σ", "ς", "क़", "<|endoftext|>", "...", "  ", "    ", "👍"]


@pytest.mark.parametrize("width", [1, 3, 8, 16, 31, 32])
def test_pack_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, 2**width, n)
        ids[rng.random(n) < 0.02] = 2**32 - 1
        data = tokenfiles.pack(ids)
        assert (tokenfiles.unpack(data) == ids).all()
        if n > 2048:
            assert (tokenfiles.unpack_block(data, 1) == ids[1024:2048]).all()


def test_words_encode_like_texts():
    rng, plain, own = random.Random(1), Tokenizer.from_file(WORDS), tokenfiles.Encoder(WORDS)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 30))) for _ in range(3000)]
    ids, lengths = own.encode(pa.array(texts))
    ends = np.cumsum(lengths)
    for t, a, b in zip(texts, ends - lengths, ends):
        assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_encoder_forgets_and_still_agrees(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MOST_WORDS", 80)
    monkeypatch.setattr(tokenfiles, "MOST_STEMS", 20)
    own, plain = tokenfiles.Encoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [" ".join(f"word{i * k % 97}." for i in range(60)) for k in range(1, 9)]
    for t in texts:
        assert own.encode(pa.array([t]))[0].tolist() == plain.encode(t, add_special_tokens=False).ids
    ids, lengths = own.encode(pa.array(texts))
    assert ids.tolist() == [x for t in texts for x in plain.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("chunk", [1, 1000, 1 << 16])
def test_token_files(spark, odd, crowded, empty, tmp_path, chunk):
    plain = Tokenizer.from_file(WORDS)
    for docs in (odd, crowded):
        tokenfiles.write(docs, str(tmp_path / "t"), WORDS, chunk=chunk)
        got = tokenfiles.read(spark, str(tmp_path / "t")).collect()
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.n_tokens for r in got)
        coded = [(d[0], plain.encode(d[1] or "", add_special_tokens=False).ids + [2]) for d in ODD]
        crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, i in coded)
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens
        ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
        assert ids == sorted(ids, key=lambda d: (d is None, d))
    tokenfiles.write(empty, str(tmp_path / "e"), WORDS)
    assert tokenfiles.read(spark, str(tmp_path / "e")).count() == 0


def test_token_files_of_repeated_ids(spark, tmp_path):
    """Null and repeated ids: the same starts on every run, over several tasks."""
    rows = [(None, f"text {i} without id") for i in range(300)] + [(4, f"text {i % 90} of one id") for i in range(300)] + [(1, None), (1, "")]
    runs = []
    for k in range(2):
        random.Random(k).shuffle(rows)
        tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3 + k), str(tmp_path / str(k)), WORDS, chunk=100)
        files = spark.read.parquet(str(tmp_path / str(k)))
        assert files.select("part").distinct().count() > 2
        runs.append(sorted((r.start, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in tokenfiles.read(spark, str(tmp_path / str(k)), with_ids=False).collect()))
    assert runs[0] == runs[1] and len(runs[0]) == 602


def test_transducer_gives_the_library_s_pieces():
    rng, own, library = random.Random(2), pieces.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["".join(rng.choices(SIGNS, k=rng.randint(0, 40))) for _ in range(3000)] + [d[1] or "" for d in ODD]
    got, want = own.encode(pa.array(texts)), library.encode(texts, num_threads=1)
    assert [g.tolist() for g in got] == want
    assert [own.decode(g) for g in got] == [library.decode(w) for w in want]


def test_transducer_on_the_documents(small):
    own, library = pieces.Transducer(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [r.text for r in small.collect()]
    assert [g.tolist() for g in own.encode(pa.array(texts))] == library.encode(texts, num_threads=1)


def test_path_is_what_the_merges_leave():
    own, rng = pieces.Transducer(MODEL), random.Random(3)
    for _ in range(500):
        text = "".join(rng.choices("▁aehinorst.漢①", k=rng.randint(1, 14)))
        assert own.path(text) == own.merged(text)


def test_pieces_of_odd_rows(odd, crowded, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (odd, crowded):
        coded, ids = pieces.encode(docs, MODEL)
        both, text = pieces.decode(coded, MODEL, ids)
        assert both.columns[: len(docs.columns)] == docs.columns
        for r in both.collect():
            assert r[ids] == library.encode(r["text"] or "") and r[text] == (r["text"] or "").replace("▁", " ")
    coded, ids = pieces.encode(empty, MODEL)
    assert pieces.decode(coded, MODEL, ids)[0].count() == 0


def test_suffix_orders():
    rng = random.Random(4)
    for trial in range(120):
        texts = [bytes(rng.choices(b"ab" if trial % 3 else b"abcde", k=rng.randint(1, 40))) * rng.randint(1, 3) for _ in range(rng.randint(1, 20))]
        got = lyndon.suffix_orders(np.frombuffer(b"".join(texts), np.uint8).astype(np.int64), np.array([len(t) for t in texts]))
        at = 0
        for t in texts:
            assert (got[at : at + len(t)] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
            at += len(t)


def plain_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, end = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [8192, 300, 0])
def test_repeated_bytes(spark, most):
    """Planted passages, periods and copies, with every group sorted, some or none; all agree."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 8)))
    passage = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"{a} {passage} {b}" for a, b in zip(texts[:20], texts[20:40])] + ["ab " * 90, "x" * 220, "abcdefgh" * 30 + "tail", texts[0] * 3]
    texts += [t[:100] + "!" + t[101:] for t in texts[40:60]] + texts[5:9]
    want = sorted(plain_removed([t.encode() for t in texts], 60))
    out = suffixes.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), 60, 16, most)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect())
    assert got == want


def test_bytes_of_odd_rows(odd, crowded, empty):
    rows = [(d[1] or "").encode() if d[0] not in (6, 7) else b"" for d in ODD]
    want = Counter(plain_removed(rows, 200))
    for docs in (odd, crowded):
        got = suffixes.remove(docs).collect()
        long = [r for r in got if r.doc_id in (6, 7)]
        assert all(r.n_removed == r.n_bytes > 100_000 and r.n_spans == 1 and not r.kept for r in long) and len(long) == 2
        assert Counter((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got if r.doc_id not in (6, 7)) + Counter({want_empty(): 2}) == want
    assert suffixes.remove(empty).count() == 0


def test_bytes_of_many_repeated_rows(spark):
    """20,000 rows of one id and text, of null ids and of own ids: work grows with the rows, not with their pairs."""
    rng = random.Random(8)
    text = " ".join(f"word{rng.randrange(10**6)}" for _ in range(250))
    other = " ".join(f"term{rng.randrange(10**6)}" for _ in range(60))
    rows = [(1, text)] * 20_000 + [(None, text[500:1500])] * 5_000 + [(k, text) for k in range(2, 1000)] + [(5000, other + text[:300]), (5001, other)]
    out = suffixes.remove(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in out.select("doc_id", "n_bytes", "n_removed").collect())
    want = Counter((d, len(t), len(t)) for d, t in rows)
    assert got == want


@pytest.mark.parametrize("length, gram", [(60, 16), (200, 64), (130, 64), (64, 64)])
def test_equal_windows_have_one_key_and_different_runs(length, gram):
    rng = random.Random(9)
    for _ in range(40):
        unit = "".join(rng.choices("ab", k=rng.randint(1, 300)))
        raw = (unit * rng.randint(1, 40) + "".join(rng.choices("abc", k=rng.randint(0, 300))) + unit * 3).encode()[: rng.choice([300, 6000])]
        key, lo, n = suffixes.runs(raw, length, gram)
        assert n.sum() == max(0, len(raw) - length + 1) and (np.cumsum(n) - n == lo).all()
        of, at = {}, np.repeat(np.arange(len(n)), n)
        for i, r in enumerate(at.tolist()):
            of.setdefault(raw[i : i + length], []).append(r)
        for same in of.values():
            assert len(set(same)) == len(same) and len(set(key[same].tolist())) == 1


def want_empty():
    return (0, 0, 0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("length, gram", [(31, 32), (2080, 32), (100, 48)])
def test_lengths_refused(odd, length, gram):
    with pytest.raises(ValueError):
        suffixes.remove(odd, length, gram)


def test_special_tokens_match_by_case():
    plain, own = Tokenizer.from_file(WORDS), tokenfiles.Encoder(WORDS)
    signs = ["<|EndOfText|>", "<|ENDOFTEXT|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "A", "b.", " ", "<|", "|>", "É"]
    rng = random.Random(2)
    texts = ["a <|EndOfText|> b"] + ["".join(rng.choices(signs, k=rng.randint(1, 9))) for _ in range(1000)]
    ids, lengths = own.encode(pa.array(texts))
    ends = np.cumsum(lengths)
    for t, a, b in zip(texts, ends - lengths, ends):
        assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t
