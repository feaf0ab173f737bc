"""Token ids as files: frequency-ranked ids in byte-aligned variable-length code, control bytes apart.

Ids are replaced by their rank in the corpus (0: most frequent), so that most take one byte. Four ranks share a
control byte with two bits each for the bytes they take (1 to 4); control bytes and data bytes stand apart, so that
a reader finds all lengths by one table lookup per control byte and gathers the data without a loop.

A file, little-endian: magic, number of documents and ids and data bytes and vocabulary entries (u64 each), whether
each doc_id is null (u8 each), doc_ids (i64), ids per document (u64), id of each rank (u32), control bytes, data.
Files hold whole documents in ascending (doc_id, text hash) order, their names sort the same way, and each is written
under a temporary name and moved, so that a repeated task replaces its files by equal ones.

Defined results: a null or empty text is its end id alone; a null doc_id comes first; repeated rows are all written;
other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, fresh_path, id_text, write_table
from .kernels import PIECE, pieces, utf8
from .tokens import encoder, vocab_path

MAGIC = b"RANKVB01"
#: Bytes that each of a control byte's four ranks takes.
_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long, n_bytes long"
DECODED = "part int, seq int, doc_id long, in_file long, n_tokens long, ids_crc32 long"


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes."""
    lens = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    code = np.concatenate([lens - 1, np.zeros(-len(lens) % 4, np.uint8)]).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    rows = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control, rows[np.arange(4) < lens[:, None]]


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks; lengths come from a table of all 256 control bytes."""
    lens = _LENGTHS[control].reshape(-1)[:n]
    rows = np.zeros((n, 4), np.uint8)
    rows[np.arange(4) < lens[:, None]] = data
    return rows.view("<u4").reshape(-1)


def write_block(doc_ids: list, counts: np.ndarray, ranks: np.ndarray, id_of: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(data), len(id_of)], "<u8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, head, null.tobytes(), ids.tobytes(), counts.astype("<u8").tobytes(), id_of.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def read_block(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, ids per document and all ids of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a ranked id file")
    docs, n, size, vocab = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40
    null = np.frombuffer(raw, np.uint8, docs, at)
    ids = np.frombuffer(raw, "<i8", docs, at := at + docs)
    counts = np.frombuffer(raw, "<u8", docs, at := at + 8 * docs).astype(np.int64)
    id_of = np.frombuffer(raw, "<u4", vocab, at := at + 8 * docs)
    control = np.frombuffer(raw, np.uint8, -(-n // 4), at := at + 4 * vocab)
    data = np.frombuffer(raw, np.uint8, size, at + len(control))
    return [None if z else int(d) for d, z in zip(ids, null, strict=True)], counts, id_of[decode_ranks(control, data, n)]


def _width(vocab: str) -> np.dtype:
    """Two bytes hold an id of most vocabularies."""
    return np.dtype("<u2" if encoder(vocab).size <= 1 << 16 else "<u4")


def coded(docs: DataFrame, end_id: int, vocab: str) -> DataFrame:
    """doc_id, h (the text's hash) and ids, as bytes, with the end id; from id_text(). Texts are encoded here, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = encoder(vocab), _width(vocab)
        for b in pieces(batches, "text"):
            ids, off = enc.encode(*utf8(b.column(2)))
            data = np.insert(ids, off[1:], end_id).astype(width)
            ends = ((off + np.arange(len(off))) * width.itemsize).astype(np.int32)
            column = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), column], names=["doc_id", "h", "ids"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, ids binary")


def _stored(column: pa.Array, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of ids, and how many each row has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return raw.view(width), np.diff(off) // width.itemsize


def _planes(n: np.ndarray, width: np.dtype) -> np.ndarray:
    """Where the bytes of rows of n numbers stand if each row has all first bytes, then all second ones, and so on."""
    first = np.cumsum(n) - n
    at = np.repeat((width.itemsize - 1) * first, n) + np.arange(int(n.sum()))
    return at[:, None] + np.repeat(n, n)[:, None] * np.arange(width.itemsize)


def in_rank_planes(codes: DataFrame, id_of: np.ndarray, vocab: str) -> DataFrame:
    """codes with the ids as ranks, byte plane by byte plane: ranks are small, so that a shuffle compresses them well."""
    sent = codes.sparkSession.sparkContext.broadcast(id_of)  # of the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, rank_of = _width(vocab), np.empty(len(sent.value), np.uint32)
        rank_of[sent.value] = np.arange(len(rank_of), dtype=np.uint32)
        for b in pieces(batches, "ids"):
            ids, n = _stored(b.column(2), width)
            out = np.empty(len(ids) * width.itemsize, np.uint8)
            out[_planes(n, width)] = rank_of[ids].astype(width).view(np.uint8).reshape(-1, width.itemsize)
            ends = (np.concatenate([[0], np.cumsum(n)]) * width.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out)])], names=["doc_id", "h", "ids"])

    return codes.mapInArrow(run, "doc_id long, h long, ids binary")


def frequency_ranks(codes: DataFrame, vocab: str) -> np.ndarray:
    """All ids of the vocabulary by falling frequency, ties by id; the vocabulary bounds what reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, total = _width(vocab), None
        for b in pieces(batches, "ids"):
            found = np.bincount(_stored(b.column(0), width)[0], minlength=encoder(vocab).size)
            total = found if total is None else total + found
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    size = encoder(vocab).size
    counts = np.zeros(size, np.int64)
    got = codes.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return np.argsort(-counts, kind="stable").astype(np.uint32)


def write_ids(docs: DataFrame, folder: str, end_id: int = 0, vocab: str | None = None, file_ids: int = 4_000_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the files and the manifest (folder/manifest, Parquet); returns the manifest.

    Ids are kept as a table between counting and writing, so that no text is encoded twice or shuffled.
    """
    spark, path = docs.sparkSession, vocab or vocab_path()
    codes, codes_path = write_table(coded(id_text(docs, text, key), end_id, path), "codes", compression="zstd")
    id_of = frequency_ranks(codes, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, part, seq = _width(path), TaskContext.get().partitionId(), 0
        fs, root = pafs.FileSystem.from_uri(folder)
        doc_ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            counts, ranks = (np.concatenate(x) for x in zip(*held, strict=True))
            raw = write_block(doc_ids, counts, ranks, id_of)
            name = f"ids-{part:06d}-{seq:06d}.bin"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(temp := f"{root}/.{name}.{uuid.uuid4().hex}") as out:
                out.write(raw)
            fs.move(temp, f"{root}/{name}")
            row = [part, seq, name, len(doc_ids), len(ranks), len(raw)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

        for b in pieces(batches, "ids", min(PIECE, 2 * file_ids)):
            raw, n = _stored(b.column(1), width)
            ranks = raw.view(np.uint8)[_planes(n, width)].reshape(-1).view(width).astype(np.uint32)
            doc_ids += b.column(0).to_pylist()
            held.append((n, ranks))
            if sum(len(r) for _, r in held) >= file_ids:
                yield flush()
                doc_ids, held, seq = [], [], seq + 1
        if held:
            yield flush()

    ordered = in_rank_planes(codes, id_of, path).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    drop_path(spark, codes_path)  # nothing that is still to run reads it
    return spark.read.parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document from the files: doc_id, start (ids before it), n_tokens and its ids' crc32."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task of the writer
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(parts, "part").select("part", "seq", (F.col("base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                _, part, seq = b.column(0)[k].as_py().rpartition("/")[2].removesuffix(".bin").split("-")
                doc_ids, counts, ids = read_block(b.column(1)[k].as_buffer().to_pybytes())
                at = np.cumsum(counts) - counts
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at.tolist(), counts.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, int(part)), pa.int32()), pa.array(np.full(n, int(seq)), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at), pa.array(counts), pa.array(crc, pa.int64())],
                    names=[f.split()[0] for f in DECODED.split(", ")],
                )

    raw = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "ids-*.bin").load(folder).select("path", "content")
    return raw.mapInArrow(run, DECODED).join(files, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 0, vocab: str | None = None) -> DataFrame:
    """write_ids() into a new folder of the shared one, and read_ids() from there."""
    folder = fresh_path(docs.sparkSession, "ids")
    write_ids(docs, folder, end_id, vocab)
    return read_ids(docs.sparkSession, folder)
