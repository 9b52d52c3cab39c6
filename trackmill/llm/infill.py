"""Fill-in-the-middle rearrangement of documents, and its reversal, by secondary sort.

Every document is cut into units (lines), two cuts are drawn from a digest of its id, and the
three parts are put in another order behind marks:

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

A document that is empty or contains a mark stays plain.

The tasks that read documents emit pieces: whole units, up to PIECE_BYTES of them (a longer unit is
cut), under the document's key and the position in the output. One exchange deals pieces by key and
sorts them by (key, position) within partitions (the DataFrame form of
repartitionAndSortWithinPartitions); a task then streams the pieces into one incremental digest per
document, or joins them to its text. Restoration reads that output stream and the form only: marks
at the head of a piece say which part follows, and a second sort of the same partitions by
(key, part, position), without another exchange, brings the text back in its own order.

A key is (doc_id, 128 bits of the text's digest, input partition), so it is the same when a task
runs again. Rows equal in all three send the same pieces; they are folded while streaming and give as
many output rows as there were copies. Nulls: a null text is an empty one; a null doc_id is drawn as
the text "7:null". Repeated ids are documents of their own with the same draws. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 7
RATE, SPM_RATE = 100, 50
PIECE_BYTES = 1 << 16
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
#: Which part a mark announces; parts are prefix, middle, suffix in the order of the text.
MARKS = {b"<P>": 0, b"<M>": 1, b"<S>": 2}
ORDER = {"psm": (b"<P>", b"<S>", b"<M>"), "spm": (b"<S>", b"<P>", b"<M>")}

KEY = "doc_id long, k1 long, k2 long, home int"
FACTS = "n long, form string, prefix_chars long, middle_chars long"
PIECES = f"{KEY}, part int, at int, piece binary, {FACTS}"
NAMES = [c.split()[0] for c in PIECES.split(", ")]


def characters(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


def cuts(doc_id: int | None, n: int, seed: int = SEED) -> tuple[int, int, int, int]:
    """Where prefix and middle end, in units, and the two draws of the form, in per cent."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3 % 100, h4 % 100


def chunks(data: bytes, begin: int, end: int, stops: np.ndarray) -> Iterator[bytes]:
    """data[begin:end] in pieces of whole units; stops are the ends of all units."""
    while begin < end:
        stop = min(end, begin + PIECE_BYTES)
        if stop < end:
            i = int(np.searchsorted(stops, stop, "right")) - 1
            if i >= 0 and stops[i] > begin:
                stop = int(stops[i])
        yield data[begin:stop]
        begin = stop


def arranged(doc_id: int | None, data: bytes, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, Iterator[tuple[int, bytes]]]:
    """Units, form, lengths of prefix and middle, and (part, piece) in the order of the output."""
    flat = np.frombuffer(data, dtype=np.uint8)
    stops = np.flatnonzero(flat == 10) + 1
    if len(data) and not (len(stops) and stops[-1] == len(data)):
        stops = np.append(stops, len(data))
    n = len(stops)
    a, b, draw, kind = cuts(doc_id, n, seed)
    if not data or any(m in data for m in MARKS) or draw >= rate:
        return n, "plain", None, None, ((0, c) for c in (chunks(data, 0, len(data), stops) if data else [b""]))
    edges = [0, int(stops[a - 1]) if a else 0, int(stops[b - 1]) if b else 0, len(data)]

    def pieces(order):
        for mark in order:
            part, head = MARKS[mark], mark
            for c in chunks(data, edges[part], edges[part + 1], stops):
                yield part, head + c
                head = b""
            if head:
                yield part, head

    form = "spm" if kind < spm_rate else "psm"
    return n, form, characters(flat[: edges[1]]), characters(flat[edges[1] : edges[2]]), pieces(ORDER[form])


class Rows:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> pa.RecordBatch | None:
        self.rows.append(row)
        self.bytes += size
        return self.flush() if len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES else None

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def pieces(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The pieces of all documents; the first piece of each also carries n, form and the two lengths."""

    def run(batches):
        from pyspark import TaskContext

        home, out = TaskContext.get().partitionId(), Rows(_schema(PIECES))
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = batch.column("doc_id")[i].as_py(), batch.column("text")[i]
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                digest = hashlib.sha256(data).digest()
                key = (doc_id, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True), home)
                *facts, parts = arranged(doc_id, data, seed, rate, spm_rate)
                for at, (part, piece) in enumerate(parts):
                    if (full := out.add((*key, part, at, piece, *(facts if not at else (None,) * 4)), len(piece))) is not None:
                        yield full
        if (full := out.flush()) is not None:
            yield full

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def by_position(rows: DataFrame) -> DataFrame:
    """Pieces dealt by document, sorted by their place in the output."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "doc_id", "k1", "k2", "home").sortWithinPartitions("doc_id", "k1", "k2", "home", "at")


def by_part(rows: DataFrame) -> DataFrame:
    """The same partitions, sorted by place in the text."""
    return rows.sortWithinPartitions("doc_id", "k1", "k2", "home", "part", "at")


def documents_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """(key, position, copies of it in a row, *named columns) of sorted pieces; copies of a piece are folded."""
    held, copies = None, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2", "home", "at", *names)]
        for row in zip(*columns, strict=True):
            if held is not None and held[:5] == row[:5]:
                copies += 1
                continue
            if held is not None:
                yield held[:4], held[4], copies, *held[5:]
            held, copies = row, 1
    if held is not None:
        yield held[:4], held[4], copies, *held[5:]


def _read_output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces in output order: their part, as the marks in the output tell, and the digest so far at the last piece.

    Only form and output bytes are used; the part that the writer noted is replaced.
    """
    out = Rows(_schema(f"{KEY}, part int, at int, piece binary, copies int, {FACTS}, output_sha256 string"))
    last = None  # the piece before, kept until it is known whether its document ends

    def send(piece, digest=None):
        key, at, copies, part, data, facts = piece
        return out.add((*key, part, at, data, copies, *facts, digest), len(data))

    key, form, part, state = None, None, 0, None
    for k, at, copies, data, *facts in documents_of(batches, ["piece", *(c.split()[0] for c in FACTS.split(", "))]):
        if last is not None and (full := send(last, state.hexdigest() if k != key else None)) is not None:
            yield full
        if k != key:
            key, form, part, state = k, facts[1], 0, hashlib.sha256()
        state.update(data)
        if form != "plain" and data[:3] in MARKS:
            part, data = MARKS[data[:3]], data[3:]
        last = (k, at, copies, part, data, facts)
    if last is not None and (full := send(last, state.hexdigest())) is not None:
        yield full
    if (full := out.flush()) is not None:
        yield full


def _digest_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (as many as it has copies) from pieces in text order."""
    out = Rows(_schema(f"doc_id long, {FACTS}, output_sha256 string, restored_sha256 string"))
    key, state, copies, facts, written = None, None, 0, None, None

    def send():
        for _ in range(copies):
            if (full := out.add((key[0], *facts, written, state.hexdigest()))) is not None:
                yield full

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in batch.schema.names]
        for doc_id, k1, k2, home, _, _, piece, c, *rest in zip(*columns, strict=True):
            if (doc_id, k1, k2, home) != key:
                if key is not None:
                    yield from send()
                key, state, copies = (doc_id, k1, k2, home), hashlib.sha256(), c
            state.update(piece)
            if rest[1] is not None:
                facts = rest[:4]
            if rest[4] is not None:
                written = rest[4]
    if key is not None:
        yield from send()
    if (full := out.flush()) is not None:
        yield full


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text."""
    written = by_position(pieces(docs, **options)).mapInArrow(_read_output, f"{KEY}, part int, at int, piece binary, copies int, {FACTS}, output_sha256 string")
    return by_part(written).mapInArrow(_digest_text, f"doc_id long, {FACTS}, output_sha256 string, restored_sha256 string")


def transform(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output text of every document."""

    def run(batches):
        out = Rows(_schema(f"doc_id long, {FACTS}, output string"))
        key, parts, copies, facts = None, [], 0, None

        def send():
            text = b"".join(parts).decode()
            for _ in range(copies):
                if (full := out.add((key[0], *facts, text), len(text))) is not None:
                    yield full

        for k, _, c, data, *rest in documents_of(batches, ["piece", *(x.split()[0] for x in FACTS.split(", "))]):
            if k != key:
                if key is not None:
                    yield from send()
                key, parts, copies, facts = k, [], c, rest
            parts.append(data)
        if key is not None:
            yield from send()
        if (full := out.flush()) is not None:
            yield full

    return by_position(pieces(docs, **options)).mapInArrow(run, f"doc_id long, {FACTS}, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """doc_id and text of transformed documents, from their columns form and output."""
    text, form = F.col("output"), F.col("form")

    def after(mark: str, until: str | None):
        tail = F.substring_index(text, mark, -1)
        return F.substring_index(tail, until, 1) if until else tail

    psm = F.concat(after("<P>", "<S>"), after("<M>", None), after("<S>", "<M>"))
    spm = F.concat(after("<P>", "<M>"), after("<M>", None), after("<S>", "<P>"))
    return outputs.select("doc_id", F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text).alias("text"))


def sql(seed: int = SEED, spm_rate: int = SPM_RATE) -> str:
    """DuckDB SQL of digests()."""
    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS units
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parted AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(units[greatest(a, b) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
FROM parted"""
