"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames of a fixed number of ids, one skippable frame with the
index of its documents, and the seek table of the public Zstandard Seekable Format at its end: each
frame's compressed and decompressed size and the low 32 bits of the XXH64 of its content. A reader finds
the frames of a document from the table and decompresses only those, checking each sum.

Cases: a null or empty text is one end token; null ids come first and rows that repeat are written each;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.bpe import encode_stream
from panelforge.llm.common import keyed_text

# Fixed values of the public format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_DOC_ID = -(2**63)


def _store(uri: str):
    """File system and path of a folder's URI; what Arrow reaches: local, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; ids come as little-endian unsigned 32-bit bytes, a document at a time."""

    def __init__(self, out, ids_a_frame: int = 65_536, level: int = 3):
        import zstandard

        self.out, self.limit = out, 4 * ids_a_frame
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size, self.frames, self.docs, self.ends, self.n = [], 0, [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.n += len(ids) // 4
        self.docs.append(NO_DOC_ID if doc_id is None else int(doc_id))
        self.ends.append(self.n)
        if self.size >= self.limit:
            raw = b"".join(self.held)
            whole = len(raw) - len(raw) % self.limit
            for at in range(0, whole, self.limit):
                self._frame(raw[at : at + self.limit])
            self.held, self.size = [raw[whole:]], len(raw) - whole

    def _frame(self, raw: bytes) -> None:
        import xxhash

        # the four bytes of all ids are laid out by significance, which compresses better
        planes = np.frombuffer(raw, "u1").reshape(-1, 4).T.tobytes()
        packed = self.zip.compress(planes)
        self.out.write(packed)
        self.frames.append((len(packed), len(planes), xxhash.xxh64_intdigest(planes) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        index = self.zip.compress(np.array(self.docs, "<i8").tobytes() + np.array(self.ends, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 8) + index + struct.pack("<Q", len(self.docs)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END))


class FrameReader:
    """Random access to one file by its seek table."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_END:
            raise ValueError("no seek table at the end of the file")
        raw = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.place = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).astype("i8")
        self.first = np.concatenate([[0], np.cumsum([f[1] for f in self.frames])]).astype("i8")
        at = int(self.place[-1])
        kind, length = struct.unpack("<II", self._at(at, 8))
        body = self._at(at + 8, length)
        count = struct.unpack("<Q", body[-8:])[0]
        index = np.frombuffer(self.unzip.decompress(body[:-8]), "<i8") if kind == SKIPPABLE_INDEX else np.zeros(0, "i8")
        self.docs, self.ends = index[:count], index[count:]
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype("i8")[:count]
        self.kept: tuple[int, bytes] = (-1, b"")

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash

        if self.kept[0] != k:
            size, whole, check = self.frames[k]
            planes = self.unzip.decompress(self._at(int(self.place[k]), size), max_output_size=whole)
            if xxhash.xxh64_intdigest(planes) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} has another checksum than the seek table")
            self.kept = (k, np.frombuffer(planes, "u1").reshape(4, -1).T.tobytes())
        return self.kept[1]

    def ids(self, i: int) -> bytes:
        """The ids of the i-th document, from the frames that hold them."""
        a, b, out = 4 * int(self.starts[i]), 4 * int(self.ends[i]), []
        k = int(np.searchsorted(self.first, a, side="right")) - 1
        while a < b:
            low, high = int(self.first[k]), int(self.first[k + 1])
            out.append(self.frame(k)[a - low : min(b, high) - low])
            a, k = min(b, high), k + 1
        return b"".join(out)


def _writer(folder: str, tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        shard = TaskContext.get().partitionId()
        name, draft = f"{path}/shard-{shard:06d}.zst", f"{path}/draft-{uuid.uuid4().hex}"
        writer, first, last = None, None, None
        for pdf in batches:
            for doc_id, ids in zip(pdf["doc_id"], encode_stream(pdf["text"], tokenizer)):
                if writer is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(draft)
                    writer = FrameWriter(out)
                writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            out.close()
            store.move(draft, name)  # a task that runs again puts the same file in its place
            yield pd.DataFrame({"shard": [shard], "file": [name.rsplit("/", 1)[1]], "n_docs": [len(writer.docs)], "n_tokens": [writer.n]})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, docs_a_file: int = 8192) -> DataFrame:
    """Write all documents, in ascending ``doc_id`` over the files in their order; returns the manifest, one row a file."""
    spark = docs.sparkSession
    rows = keyed_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_DOC_ID).cast("long")))  # a null would make floats of all ids
    files = max(1, -(-rows.select("doc_id").count() // docs_a_file))
    dealt = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInPandas(_writer(folder, tokenizer), "shard int, file string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")
    return spark.read.schema("shard int, file string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")


def _reader(folder: str, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _store(folder)
        for pdf in batches:
            for shard, file in zip(pdf["shard"], pdf["file"]):
                at = f"{path}/{file}"
                with store.open_input_file(at) as source:
                    reader = FrameReader(source, source.size())
                    for low in range(0, len(reader.docs), 2048):
                        span = range(low, min(low + 2048, len(reader.docs)))
                        ids = [reader.ids(i) for i in span]
                        docs = pd.array(reader.docs[low : span.stop], dtype="Int64")
                        docs[reader.docs[low : span.stop] == NO_DOC_ID] = pd.NA
                        out = {"doc_id": docs, "shard": shard, "local_start": reader.starts[low : span.stop], "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids]}
                        yield pd.DataFrame(out | ({"ids": ids} if with_ids else {}))

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row a document, read back from the files: its place among all ids, their number and their crc32."""
    manifest = spark.read.schema("shard int, file string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")
    ahead = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    places = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("base"))
    schema = "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    files = manifest.select("shard", "file").repartitionByRange(max(1, manifest.count()), "shard")
    rows = files.mapInPandas(_reader(folder, with_ids), schema)
    out = rows.join(places, "shard").withColumn("start", F.col("base") + F.col("local_start"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", *(["ids"] if with_ids else []))


def read_document(folder: str, file: str, doc_id: int) -> np.ndarray:
    """Ids of one document, decompressing the frames it lies in and no others."""
    store, path = _store(folder)
    with store.open_input_file(f"{path}/{file}") as source:
        reader = FrameReader(source, source.size())
        found = np.flatnonzero(reader.docs == doc_id)
        if not len(found):
            raise KeyError(doc_id)
        return np.frombuffer(reader.ids(int(found[0])), "<u4")


def file_bytes(rows: list[tuple[int | None, bytes]], ids_a_frame: int = 65_536) -> bytes:
    """A whole file in memory, for small inputs and tests."""
    out = io.BytesIO()
    writer = FrameWriter(out, ids_a_frame)
    for doc_id, ids in rows:
        writer.add(doc_id, ids)
    writer.close()
    return out.getvalue()
