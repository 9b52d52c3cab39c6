"""Substring, suffix, token and license operators against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import connect, diff
from trackmill.llm import licenses, substrings, suffixes, tokens
from trackmill.llm.arrays import Sums, byte_values

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x).hexdigest()


def ordered(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))


def plain_words(rows, window):
    seen, out = set(), []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = bytearray(len(w))
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(key)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def plain_bytes(rows, window):
    seen, out = set(), []
    for i, text in rows:
        b = (text or "").encode()
        gone, new = bytearray(len(b)), []
        for p in range(len(b) - window + 1):
            key = b[p : p + window]
            if key in seen:
                gone[p : p + window] = b"\1" * window
            else:
                new.append(key)
        seen.update(new)
        out.append((i, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


@pytest.fixture(scope="module")
def mixed(make_docs):
    """Copies, shared passages, runs and overlaps within and across documents."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    passage = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(4)
            if kind == 0:
                parts.append(rng.choice(passage))
            elif kind == 1:
                p = rng.choice(passage).split()
                p[rng.randrange(len(p))] = "edit"
                parts.append(" ".join(p[rng.randrange(10) :]))
            elif kind == 2:
                parts.append("ab " * rng.randrange(1, 60))
            else:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))))
        rows.append((i, "\n".join(parts)))
    return make_docs(*rows, *((100 + i, rows[i][1]) for i in range(10)))


@pytest.mark.parametrize("fixture", ["mixed", "odd_docs"])
def test_substrings(request, fixture):
    docs = request.getfixturevalue(fixture)
    got = [tuple(r) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(plain_words(ordered(docs), 20), key=str)


@pytest.mark.parametrize("fixture", ["mixed", "odd_docs"])
@pytest.mark.parametrize("batches", [1, 4, 7])
def test_suffixes(request, fixture, batches):
    docs = request.getfixturevalue(fixture)
    got = [tuple(r) for r in suffixes.remove_earlier(docs, batches=batches).collect()]
    assert sorted(got, key=str) == sorted(plain_bytes(ordered(docs), 50), key=str)


def test_suffix_pieces(make_docs):
    """Entries travel in pieces, not one by one, and those of copies no further than the task that reads them."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(3)]
    docs = make_docs(*((i, texts[i % 3]) for i in range(30))).coalesce(1).select(F.col("doc_id").alias("rid"), "text")
    rows = docs.mapInArrow(suffixes._pieces(suffixes._entries(50, 24), 8), suffixes.PIECES).collect()
    new = np.concatenate([np.frombuffer(r["data"], suffixes.ENTRY) for r in rows if r["what"] == suffixes.NEW])
    gone = np.concatenate([np.frombuffer(r["data"], suffixes.PLACE) for r in rows if r["what"] == suffixes.COVERED])
    assert len(rows) <= 9
    assert set(new["rid"].tolist()) == {0, 1, 2} and set(gone["rid"].tolist()) == set(range(3, 30))
    assert len(gone) == 9 * len(new)
    windows = sorted((r, lo + i) for r, lo, n in zip(new["rid"].tolist(), new["lo"].tolist(), new["n"].tolist()) for i in range(n))
    assert windows == [(r, i) for r in range(3) for i in range(20_000 - 49)]


def test_short_windows(mixed):
    got = [tuple(r) for r in substrings.remove_repeats(mixed, window=6).collect()]
    assert sorted(got) == sorted(plain_words(ordered(mixed), 6))


def test_empty_tables(make_docs):
    docs = make_docs()
    assert substrings.remove_repeats(docs).count() == 0
    assert suffixes.remove_earlier(docs).count() == 0
    assert tokens.tokens(docs, tokens.tokenizer_path()).count() == 0
    assert licenses.scan(docs).count() == 0


def test_tokens(spark, odd_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.tokenizer_path())
    docs = odd_docs.unionByName(
        odd_docs.sparkSession.createDataFrame([(50, "a  b\n c\t d e<|endoftext|> x' I'll 12,3%%% \x1c\x85 İK  "), (51, "  <|endoftext|>  ")], "doc_id long, text string"), allowMissingColumns=True
    )
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.tokens(docs, tokens.tokenizer_path(), shard_bytes=100_000).collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_units(monkeypatch):
    """Cuts of units at odd characters and at the ends of texts and blocks leave the library's ids as they are."""
    import pyarrow as pa

    draw = random.Random(5)
    parts = ["a", "don", "the", "'s", "'t", "'", "é", "Ⅷ", "ciónmente", "12", "²", "．", ".", "%%%", "…", " ", "  ", "\n", "\t\r", "\x0b", "\x1c", "\x00", "\x85", "\xa0", "\u1680", "\u2003", "\u2029", "\u200b", "\u3000", "語。", "\u0301", "🙂", "x" * 70]
    texts = ["".join(draw.choices(parts, k=draw.randrange(12))) for _ in range(3000)] + [None, "", "<|endoftext|> a", "end"]
    encoder = tokens.Encoder(tokens.tokenizer_path(), 2)
    want = [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    for block in (1, 200, 1 << 20):
        monkeypatch.setattr(tokens, "UNIT_BLOCK", block)
        assert list(encoder.encode_all(batch)) == want
    assert encoder.encode("") == b"" and max(map(len, encoder.units)) <= tokens.LONGEST_KEPT


def test_token_units_kept(monkeypatch):
    """Among ever new words the frequent ones are encoded once, and words with marks never by the whole tokenizer."""

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.model, self.seen = tokenizer, self, {}

        def tokenize(self, piece):
            self.seen[piece] = self.seen.get(piece, 0) + 1
            return self.tokenizer.model.tokenize(piece)

        def encode_batch_fast(self, texts, **options):
            self.seen["whole"] = self.seen.get("whole", 0) + 1
            return self.tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokens, "CACHED_UNITS", 500)
    encoder = tokens.Encoder(tokens.tokenizer_path(), 2)
    plain = encoder.tokenizer
    encoder.tokenizer = encoder.model = counted = Counted(plain)
    name = ["".join("bcdfghklmn"[int(d)] for d in f"{i:05d}") for i in range(2100)]
    for i in range(20):
        text = "".join(f" {w}" for w in name[:100]) + "".join(f" {w}%%% {w}é!!" for w in name[100 + 100 * i : 200 + 100 * i])
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert [counted.seen["Ġ" + w] for w in name[:100]] == [1] * 100
    assert "whole" not in counted.seen
    assert len(encoder.units) + len(encoder.older) <= 1000


def test_select(spark, make_docs, tmp_path):
    texts = [(i, "word " * (i % 7)) for i in range(1500)]
    folder = f"file://{tmp_path}/t"
    manifest = tokens.write(make_docs(*texts), folder, tokens.tokenizer_path()).collect()
    assert len(manifest) == 1
    encoder = tokens.Encoder(tokens.tokenizer_path(), 2)
    for i in (0, 1, 255, 256, 257, 1000, 1499):
        want = np.frombuffer(encoder.encode(texts[i][1]), "<u2").tolist() + [2]
        assert tokens.read_document(folder, manifest[0]["shard"], i).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    coded, _ = tokens.EliasFano.from_bytes(tokens.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes(), 0)
    assert coded.all().tolist() == values
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]


def test_licenses(spark, make_docs, odd_docs):
    from pyspark.sql import Row

    text = "x\nReleased under the MIT License.\nmit license MIT LICENSE\nThis work: licensed GNU General Public License, version 3\nLicensed under CC BY-NC 4.0"
    r = licenses.scan(make_docs((1, text))).first()
    assert r["base_labels"] == "gpl,mit" and r["labels"] == "cc-by-nc,gpl,mit" and r["n_base"] == 4
    assert (r["first_word"], r["last_word"], r["score"]) == (4, 14, 1.0)
    rows = {r["doc_id"]: r for r in licenses.scan(odd_docs).collect() if r["doc_id"] is not None}
    assert rows[1] == Row(doc_id=1, n_words=0, n_base=0, first_word=None, last_word=None, base_labels="", labels="", score=0.0)
    assert rows[5]["n_words"] == 40_000
    part = licenses.scan(make_docs((1, "Permission is hereby granted free of charge to any person having a copy of this software"))).first()
    assert part["labels"] == "mit" and part["score"] == pytest.approx(14 / 15)


def test_licenses_wrapped(make_docs):
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. */"
    lgpl = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published"
    far = "Redistribution and use in source and binary\n" + "other words in between " * 10 + "\nforms with or without modification are permitted"
    texts = [bsd, mpl, lgpl, far, "word " * 50 + bsd.replace(" ", "\r\n") + " word" * 50]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(make_docs(*enumerate(texts))).collect()}
    assert got[0] == ("bsd", 1.0) and got[1] == ("mpl", 1.0) and got[3] == ("", 0.0) and got[4] == ("bsd", 1.0)
    assert "lgpl" in got[2][0].split(",")


def test_licenses_counts_words(make_docs):
    """Words and wanted words of odd texts; counting takes one split, no list of a pattern's matches."""
    texts = ["", " ", "license", "a LiCense.", ".a", "a.", "..a--b..", "sublicensed", "lice nse", "\u00e9license \u212a", "copy_of", "\U0001f600form 2", "FREE\nfree\n", "\x00a\x7fb", "\u0130 Form"]
    wanted = {"license", "copy", "form", "free", "\u00e9license"}
    docs = make_docs(*enumerate(texts)).select("doc_id", licenses.count_words(F.col("text")).alias("n"), licenses.may_hold(F.col("text"), wanted).alias("may"))
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]
    assert {r["doc_id"]: (r["n"], r["may"]) for r in docs.collect()} == {i: (len(licenses.all_words(t)), any(w in t for w in wanted)) for i, t in enumerate(lowered)}
    assert "regexp_extract_all" not in docs._jdf.queryExecution().optimizedPlan().toString()


def test_licenses_sql(spark):
    assert diff(licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")), connect(SF), licenses.sql()) is None


def test_fingerprints_of_equal_ranges():
    data = np.frombuffer(b"abcabcab", dtype=np.uint8)
    s = Sums(byte_values(data))
    a = s.of(np.array([0, 1, 3]), np.array([3, 4, 6]))
    assert a[0] == a[2] and a[0] != a[1]
