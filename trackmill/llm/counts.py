"""Token counts through a cache of digests.

The cache is a Parquet table of (version, digest, n_tokens): `version` is the digest of all that
decides on a count besides the text (the vocabulary file, the library and its version, the name
of the normal form), `digest` the SHA-256 of a text's normalised content. Texts of one digest have
one count, so

1. every document is reduced to its digest (JVM-side);
2. digests of this version that the cache lacks are the misses; of each, one content is kept,
   chosen within the map tasks before anything is exchanged;
3. only these are encoded, and their counts are appended to the cache; where a tokenizer treats the
   words between white space one by one, a task encodes each distinct word once and adds up;
4. documents meet their counts by digest; the digests of large groups of copies by broadcast
   (see meet), so no group of copies lands in one task.

Appending is one commit of Spark's file writer: a lost executor leaves no half-written rows. Two
runs at once may append one digest twice; the counts are equal, and reading folds them.

Nulls: a null text counts as an empty one, with 0 bytes and 0 tokens. Rows with a null or repeated
doc_id are counted like all others, one output row each. An empty table gives no rows and appends
nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmill.llm.arrays import table_bytes, text_blocks, words_of
from trackmill.llm.meet import meet
from trackmill.llm.scratch import CLEAN, Scratch, setting

LIMIT = 2048
CACHE = "version string, digest binary, n_tokens long"
WORD = ~table_bytes(b" \t\n\x0b\x0c\r")
KEPT_WORDS = 500_000
_WORDS: dict[str, dict[str, int]] = {}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def unchanged(text: Column) -> Column:
    """The normal form for tokenizers that tell every two texts apart."""
    return text


def spaces_and_case(text: Column) -> Column:
    """One form of texts that differ in ASCII white space or letter case, for word_bpe_49k.json, which drops both.

    Case stays where it may matter: a mark can join a capital but not the small letter (or the
    other way round), and strings of special tokens are looked for before letters are lowered.
    """
    squeezed = F.trim(F.regexp_replace(text, "[ \\t-\\r]+", " "))
    return F.when(squeezed.rlike("\\p{M}|<\\|"), squeezed).otherwise(F.translate(squeezed, UPPER, LOWER))


def version(tokenizer_file: str, normal: Callable[[Column], Column]) -> str:
    """Digest of the vocabulary file, the library's version and the normal form."""
    if tokenizer_file.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(tokenizer_file, "rb") as f:
        data = f.read()
    return hashlib.sha256(b"\0".join([data, library.__name__.encode(), library.__version__.encode(), normal.__name__.encode()])).hexdigest()


def counter(tokenizer_file: str) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts, without begin, end or added special tokens, truncation or padding."""
    if tokenizer_file.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file)
        return lambda texts: [len(ids) for ids in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def by_word(column: pa.Array, count: Callable[[list[str]], list[int]], known: dict[str, int]) -> list[int]:
    """Counts of whole texts as sums over their words, each distinct word being encoded once; known is kept and bounded."""
    out = []
    for _, _, data, offsets in text_blocks(pa.record_batch([column], names=["x"]), "x"):
        starts, ends, at = words_of(data, offsets, WORD)
        sizes = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(ends - starts, out=sizes[1:])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(data[WORD[data]])).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(known) > KEPT_WORDS:
            known.clear()
        new = [w for w in distinct if w not in known]
        for first in range(0, len(new), 4096):
            part = new[first : first + 4096]
            known.update(zip(part, count(part), strict=True))
        total = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(np.array([known[w] for w in distinct], dtype=np.int64)[words.indices.to_numpy()], out=total[1:])
        out += (total[at[1:]] - total[at[:-1]]).tolist()
    return out


def _encode(tokenizer_file: str, apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_file)
        for batch in batches:
            if apart:
                found = by_word(batch.column("content"), count, _WORDS.setdefault(tokenizer_file, {}))
            else:
                found = [n for first in range(0, batch.num_rows, 64) for n in count(batch.column("content").slice(first, 64).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.int64())], names=["digest", "n_tokens"])

    return run


class Cache:
    """Stored counts of one tokenizer version, in a folder of Parquet files."""

    def __init__(self, spark, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder, version

    def read(self) -> DataFrame:
        """digest, n_tokens: one row per stored digest."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "digest binary, n_tokens long")
        rows = self.spark.read.schema(CACHE).parquet(self.folder).filter(F.col("version") == self.version)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame) -> None:
        counts.select(F.lit(self.version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(self.folder)


def count_tokens(docs: DataFrame, tokenizer_file: str, normal: Callable[[Column], Column] = unchanged, folder: str | None = None, limit: int = LIMIT, apart: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    normal maps texts to a form that has the same count. folder: where the cache is kept; by
    default a new one, so that all distinct contents are misses. apart: the tokenizer drops white
    space before it merges, so a text has the sum of its words' tokens (true of word_bpe_49k.json).
    Building the result runs the jobs that fill the cache.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cache = Cache(spark, folder or f"{scratch.root}/counts", version(tokenizer_file, normal))
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), normal(text).alias("content"))
    named = named.withColumn("digest", F.unhex(F.sha2("content", 256)))
    rows = scratch.save("digests", named.select("doc_id", "n_bytes", "digest"))

    stored = cache.read()
    one = named.select("digest", "content").dropDuplicates(["digest"])
    misses = one.join(stored.select("digest"), "digest", "left_anti")
    with setting(spark, CLEAN, "true"):
        cache.append(misses.mapInArrow(_encode(tokenizer_file, apart), "digest binary, n_tokens long"))

    met = meet(rows, cache.read(), ["digest"])
    return met.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def tokenizer_path() -> str:
    """The vocabulary with word ends among the installed tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
