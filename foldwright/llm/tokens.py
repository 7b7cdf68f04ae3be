"""Token ids as files: frequency-ranked, byte-aligned, separate control bytes.

Ids are replaced by their rank in the corpus' token frequencies (ties by id), so
the commonest 256 take one byte.  A block holds whole documents in order: a
control stream (two bits a value, four values a byte: its length in bytes less
one) and a data stream (1 to 4 little-endian bytes a value).  Decoding looks the
control bytes up in a 256 x 4 table of lengths and gathers with numpy.

File format: a folder of Parquet files of blocks (shard, skip: ids of the
shard before it, doc_ids, n_tokens, control, data) beside a ``ranks`` table (rank, id).  Spark's writers
place them, so any store that Spark reaches will do, and a lost executor's
files are never half visible.

The vocabulary bounds every table that is sent around (ranks: one int per id).

Defined cases: null or empty text has the end id alone; rows of equal id keep
an order by the text's hash; null ids come first; an empty table gives an empty
folder and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import discard, materialize, scratch, table

END_ID = 2
BLOCK_TOKENS = 1 << 18
CACHE_PIECES = 1_000_000
_TAIL = "!.,%&$*#|?;:"
_SMALL = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_PLAIN = re.compile(f"[{_SMALL}]+").fullmatch


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others,
    in order, for the characters from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


_AS_BYTES = str.maketrans({c: "".join(map(_byte_alphabet().__getitem__, c.encode())) for c in _SMALL})
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
BLOCKS = "shard int, skip long, doc_ids array<long>, n_tokens array<int>, control binary, data binary"


class WordTokens(dict):
    """Ids (little-endian uint32 bytes) of the pieces of a text between spaces.

    The tokenizer drops white space, and neither its normaliser nor its
    splitting looks across it, so pieces are encoded apart and remembered, in two
    generations of CACHE_PIECES.  Within a piece, a tail of ASCII symbols after
    a letter is a word of its own, and capitals are those of their small letters;
    a plain word of small letters goes to the library's model without the
    normaliser.  Everything else goes through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._old: dict[str, bytes] = {}
        self.dtype = "<u2" if self._tokenizer.get_vocab_size() < 1 << 16 else "<u4"

    def __missing__(self, piece: str) -> bytes:
        got = self._old.get(piece)
        if got is None:
            got = self._encode(piece)
        if len(self) > CACHE_PIECES:
            self._old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got

    def _encode(self, piece: str) -> bytes:
        if _PLAIN(piece):
            return array("I", [t.id for t in self._tokenizer.model.tokenize(piece.translate(_AS_BYTES))]).tobytes()
        word = piece.rstrip(_TAIL)
        if word and len(word) < len(piece) and word[-1].isalpha():
            return self[word] + self[piece[len(word) :]]
        if _PLAIN(small := piece.lower()):
            return self[small]
        return array("I", self._tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join([self[p] for p in text.replace("\n", " ").split(" ")])


_tokenizers: dict[str, WordTokens] = {}


def _words(path: str) -> WordTokens:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit values."""
    v = values.astype("<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4) <= code[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length) - length
    d = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = d[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, str, str]:
    """Rows (doc_id, salt, ids) of all documents in the shared folder; the type of
    its ids (of two bytes if the vocabulary allows)."""
    kind = _words(path).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, end = _words(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                ids = [np.frombuffer(w.encode(t) + end, "<u4").astype(kind).tobytes() for t in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(ids, pa.binary())], ["doc_id", "salt", "ids"])

    salted = docs.select("doc_id", F.xxhash64("text").alias("salt"), "text")
    out, folder = materialize(salted.mapInArrow(run, "doc_id long, salt long, ids binary"), "ids")
    return out, folder, kind


def frequencies(encoded: DataFrame, kind: str, end_id: int = END_ID) -> np.ndarray:
    """Count of every id over all documents; a task sends a row per used id."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end_id + 1, np.int64)
        for b in batches:
            for ids in b.column(0):
                c = np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=len(total))
                c[: len(total)] += total
                total = c
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    out = np.zeros(max(end_id, *rows["id"], 0) + 1, np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every text and write the blocks in ascending order of id."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spark = df.sparkSession
    encoded, encoded_folder, kind = _encoded(docs, path, end_id)
    freq = frequencies(encoded, kind, end_id)
    by_rank = np.lexsort((np.arange(len(freq)), -freq))
    rank_of = np.empty(len(freq), np.uint32)
    rank_of[by_rank] = np.arange(len(freq), dtype=np.uint32)
    spark.createDataFrame([(by_rank.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, skip, held = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            control, data = pack(rank_of[np.concatenate(parts)])
            n = [len(p) for p in parts]
            return pa.record_batch([pa.array([shard], pa.int32()), pa.array([skip], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["shard", "skip", "doc_ids", "n_tokens", "control", "data"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(ids, kind)
                if parts and held + len(ids) > BLOCK_TOKENS:
                    yield flush()
                    docs, parts, held, skip = [], [], 0, skip + held
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield flush()

    ordered = encoded.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "ids")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(spark, encoded_folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids): ids as little-endian uint32 bytes."""
    return _read(spark, folder, lambda ids: ids.tobytes(), "ids", "binary", pa.binary())


def _read(spark: SparkSession, folder: str, value, name: str, kind: str, arrow) -> DataFrame:
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    by_rank = np.frombuffer(spark.read.parquet(f"{folder}/ranks").head()[0], "<u4")
    # one row per shard: the number of output files bounds this table
    sizes = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n")).orderBy("shard").collect()
    starts, at = {}, 0
    for r in sizes:
        starts[r["shard"]] = at
        at += r["n"]
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["n_tokens"], np.int64)
                ids = by_rank[unpack(r["control"], r["data"], int(n.sum()))]
                cut = np.concatenate([[0], np.cumsum(n)])
                out = [value(ids[cut[k] : cut[k + 1]]) for k in range(len(n))]
                first = starts[r["shard"]] + r["skip"]
                yield pa.record_batch([pa.array(r["doc_ids"], pa.int64()), pa.array(first + cut[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(out, arrow)], ["doc_id", "start", "n_tokens", name])

    return blocks.mapInArrow(decode, f"doc_id long, start long, n_tokens long, {name} {kind}")


def default_tokenizer() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), folder, default_tokenizer())
    return _read(spark, folder, lambda ids: zlib.crc32(ids.tobytes()), "ids_crc32", "long", pa.int64())
