"""Phrases, token counts and fill-in-the-middle against plain versions."""

import hashlib
import re
from collections import Counter

import pytest

from tests.compare import connect, diff
from trackmill.llm import counts, infill, phrases

SF = "/root/testdata/sf0.001"


def plain_phrases(rows, least, keep=2000):
    """Counts of all phrases by looking at every place, then the rules of scores and explained phrases."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for size in range(1, 5):
                    if i + size <= len(w):
                        f[lang, tuple(w[i : i + size])] += 1
    frequent = {k: c for k, c in f.items() if c >= least}
    most = {}
    for (lang, p), c in frequent.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                most[lang, p[i : i + size]] = max(c, most.get((lang, p[i : i + size]), 0))
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) > 1 and 100 * most.get((lang, p), 0) < 80 * a:
            score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -score) for lang, found in out.items() for rank, (score, a, p, l, r) in enumerate(sorted(found)[:keep], 1)
    )


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("shard_bytes", [1 << 12, 1 << 24])
def test_phrases(given, shard_bytes):
    got = sorted(tuple(r) for r in phrases.collocations(given, least=5, shard_bytes=shard_bytes).collect())
    assert got == plain_phrases([(r["lang"], r["text"]) for r in given.select("lang", "text").collect()], 5)
    assert len({r[0] for r in got}) == 4 and {len(r[2].split(" ")) for r in got} == {2, 3, 4}


def test_phrases_odd(spark, odd_docs):
    rows = [
        ("en", "a a a a a a a"), ("en", "A a. a\ta, B\x0bb b  b"), (None, "x y z x y z x y z"), ("und", "x y z"), ("é", "é ß é ß\u0085 q"), ("en", None), ("", "p q p q"), ("en", ""),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, shard int")
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=2, keep=5, shard_bytes=8).collect())
    assert got == plain_phrases(rows, 2, 5)
    assert phrases.collocations(docs.limit(0)).count() == 0
    same = [tuple(r) for r in phrases.collocations(odd_docs, least=50).collect()]
    assert sorted(same) == plain_phrases([(r["lang"], r["text"]) for r in odd_docs.collect()], 50)


def test_transform_of_many_words(monkeypatch):
    """The ranked way of sorting, for vocabularies too large to pack, gives a valid index too."""
    import numpy as np

    sequence = np.concatenate([[0], np.random.default_rng(2).integers(1, 5, 400), [0], [1 << 20]]).astype(np.int32)
    index = phrases.Index(phrases.transform(sequence))
    text = sequence.tolist() * 2
    for p in ([1], [2, 3], [4, 4, 1], [1, 2, 3]):
        low, high = index.find(np.array([p]))
        assert high[0] - low[0] == sum(text[i : i + len(p)] == p for i in range(len(sequence)))
        _, symbol, c = index.before(low, high)
        assert dict(zip(symbol.tolist(), c.tolist(), strict=True)) == Counter(x for i in range(len(sequence)) if text[i : i + len(p)] == p and (x := text[i - 1]))
    wide = np.array([[1 << 30, 1 << 30, 5], [7, 1 << 30, 1 << 30]], dtype=np.int64)
    assert phrases.contained(wide, wide[::-1]).all() and not phrases.contained(wide, wide[:, ::-1] + 1).any()


ODD_TEXTS = [
    "Hello  World", "hello world", " hello\tworld\r\n", "HELLO <|endoftext|> x", "hello <|ENDOFTEXT|> x", "H̱ T̈", "ẖ ẗ", "́a ́", "Don't DON'T don't", "İİ", "\x1c\x85a　b", "ǰ J̌",
    "12,3%% x'll", "a<|endoftext|>b\t<|startoftext|>", "a\u2028b\xa0c\u200bd", "﻿\x00 a", "KK k",
]


def test_token_counts(spark, make_docs, odd_docs, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(counts.tokenizer_path())
    docs = odd_docs.union(make_docs(*enumerate(ODD_TEXTS, 100)))
    want = []
    for r in docs.collect():
        n = len(plain.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 2048))
    cache = str(tmp_path / "cache")
    got = [tuple(r) for r in counts.count_tokens(docs, counts.tokenizer_path(), counts.spaces_and_case, cache, apart=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() < docs.select("text").distinct().count()
    # a second run finds all but the new text in the cache
    more = docs.union(make_docs((200, "a new text"), (201, "A  new text")))
    assert counts.count_tokens(more, counts.tokenizer_path(), counts.spaces_and_case, cache, apart=True).count() == docs.count() + 2
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # stored counts are used as they are, also if one was stored twice; another version has its own
    spark.read.parquet(cache).selectExpr("version", "digest", "7L AS n_tokens").write.parquet(str(tmp_path / "sevens"))
    spark.read.parquet(str(tmp_path / "sevens")).write.mode("append").parquet(str(tmp_path / "sevens"))
    sevens = counts.count_tokens(docs, counts.tokenizer_path(), counts.spaces_and_case, str(tmp_path / "sevens"), apart=True)
    assert {r["n_tokens"] for r in sevens.collect()} == {7} and sevens.count() == docs.count()
    own = counts.count_tokens(docs, counts.tokenizer_path(), folder=str(tmp_path / "sevens"))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in own.filter("doc_id > 0").collect()) == sorted((w[0], w[2]) for w in want if (w[0] or 0) > 0)
    assert counts.count_tokens(make_docs(), counts.tokenizer_path()).count() == 0


def test_other_tokenizers(make_docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = make_docs((1, "Hello  World"), (2, "hello world"), (3, None), (4, "</s> é"))
    got = sorted((r["doc_id"], r["n_tokens"]) for r in counts.count_tokens(docs, path).collect())
    assert got == [(i, len(plain.encode(t))) for i, t in ((1, "Hello  World"), (2, "hello world"), (3, ""), (4, "</s> é"))]


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def lines(make_docs, odd_docs):
    import random

    rng = random.Random(5)
    made = ["".join(rng.choice(["a", "é", "\n", "𝄞 ", "<P", ">", "<S", "\r"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    long = ["é" * 100_000, "\n".join("x" * rng.randrange(60_000) for _ in range(12)), "\n" * 200_000, "a <M> b\n" * 20_000, "y" * 65_535 + "é" + "z\n" * 9]
    return odd_docs.union(make_docs(*enumerate(made + long, 1000), *((2000, made[3]) for _ in range(5)))).repartition(3)


def test_infill(lines):
    want = [plain_infill(r["doc_id"], r["text"]) for r in lines.collect()]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    texts = infill.transform(lines)
    assert sorted((tuple(r) for r in texts.collect()), key=str) == sorted(want, key=str)
    back = sorted(((r["doc_id"], r["text"]) for r in infill.restore(texts).collect()), key=str)
    assert back == sorted(((r["doc_id"], r["text"] or "") for r in lines.collect()), key=str)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    held = sorted((r["doc_id"] is None, r["doc_id"] or 0, sha(r["text"] or "")) for r in lines.collect())
    got = infill.digests(lines).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(((*w[:5], sha(w[5])) for w in want), key=str)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["restored_sha256"]) for r in got) == held


def test_infill_options(spark, make_docs, lines):
    assert {r["form"] for r in infill.digests(lines, rate=0).collect()} == {"plain"}
    assert "psm" not in {r["form"] for r in infill.digests(lines, spm_rate=100).collect()}
    assert infill.digests(make_docs()).count() == 0 and infill.transform(make_docs()).count() == 0
    con = connect(SF)
    assert diff(infill.digests(spark.read.parquet(f"{SF}/documents.parquet")), con, infill.sql()) is None


@pytest.mark.parametrize("top", [1 << 8, 1 << 40, (1 << 64) - 1])
def test_packed_fingerprints(top):
    import numpy as np

    rng = np.random.default_rng(top % 1000)
    values = np.unique(rng.integers(0, top, 300, dtype=np.uint64, endpoint=True))
    checks, counts = rng.integers(0, 1 << 16, len(values)).astype(np.uint64), rng.integers(0, top >> 2, len(values), endpoint=True).astype(np.int64)
    for n in (len(values), 1):
        got = phrases.unpack(phrases.pack(values[:n], checks[:n], counts[:n]))
        assert all((a == b[:n]).all() for a, b in zip(got, (values, checks, counts), strict=True))
    # equal values with other checks are other phrases
    one = phrases.pack(np.array([5, 5, 9], np.uint64), np.array([1, 2, 0], np.uint64), np.array([3, 4, 2]))
    two = phrases.pack(np.array([5, 9], np.uint64), np.array([2, 0], np.uint64), np.array([1, 1]))
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([7, 8]), pa.array([one, two])], names=["part", "shard", "packed"])
    out = {s: [x.tolist() for x in phrases.unpack(r)] for b in phrases._sums(3)([rows]) for s, r in zip(*(b.column(c).to_pylist() for c in ("shard", "reply")), strict=True)}
    assert out == {7: [[5, 5, 9], [1, 2, 0], [7, 11, 7]], 8: [[5, 9], [2, 0], [10, 6]]}
