"""Token-id output: flat unsigned integer files with 64-bit document offsets, memory-mapped when read.

A data set is a folder: ``ids-<task>.bin`` holds token ids as flat little-endian unsigned integers (16 bits wide if
the vocabulary allows, else 32), documents one after another in ascending order; ``ids-<task>.idx`` holds one
unsigned 64-bit word more than documents, the places at which they begin in that file; ``ids-<task>.doc`` holds their
document ids (signed 64-bit). ``parts.json`` lists the files that count, in order, with each one's base: the number of
ids in all files before it, by prefix sums over one row for each file. A file of an attempt that was lost or repeated
is in no list and so never read.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from marlstone.llm.common import release, shared_dir, slices
from marlstone.llm.parts import Parts, plain_split

#: Bytes of text that one file's share should not exceed by far.
PART_BYTES = 256 << 20
READ_SCHEMA = "doc_id long, start long, ids binary"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class _Written(WriterCommitMessage):
    name: str
    first: tuple
    docs: int
    ids: int
    nulls: int


@dataclass
class _Part(InputPartition):
    name: str
    base: int
    docs: int
    nulls: int


class TokenFiles(DataSource):
    """Options: path; to write also vocabulary, end_id and width (bytes of an id, 2 or 4).

    Rows to write (part, doc_id, text) must come in ascending order, as ``write_token_files`` deals them.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return READ_SCHEMA

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options["vocabulary"], int(self.options["end_id"]), int(self.options.get("width", 4)))

    def reader(self, schema):
        return _Reader(self.options["path"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: str, end_id: int, width: int):
        self.path, self.vocabulary, self.end_id, self.width = path, vocabulary, end_id, width

    def write(self, iterator):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name, first, docs, ids, nulls = f"ids-{uuid.uuid4().hex}", None, 0, 0, 0
        kind, coder = np.dtype(f"<u{self.width}"), library_encoder(self.vocabulary)
        with fs.open_output_stream(f"{root}/{name}.bin") as flat, fs.open_output_stream(f"{root}/{name}.idx") as places, fs.open_output_stream(f"{root}/{name}.doc") as keys:
            places.write(np.zeros(1, "<u8").tobytes())
            for whole in iterator:
                for batch in slices(whole, whole.schema.get_field_index("text")):
                    if first is None:
                        first = (batch.column("part")[0].as_py(),)
                    made, counts = coder.encode(batch.column("text"))
                    if max(int(made.max(initial=0)), self.end_id) >= 1 << (8 * self.width):
                        raise ValueError(f"an id does not fit in {self.width} bytes")
                    ends = np.cumsum(counts + 1)
                    joined = np.full(len(made) + len(counts), self.end_id, kind)
                    inside = np.ones(len(joined), bool)
                    inside[ends - 1] = False
                    joined[inside] = made
                    flat.write(joined.data)
                    places.write((ids + ends).astype("<u8").data)
                    keys.write(batch.column("doc_id").fill_null(0).to_numpy().astype("<i8").data)
                    nulls += batch.column("doc_id").null_count
                    docs += len(counts)
                    ids += len(joined)
        release()
        return _Written(name, first or (-1,), docs, ids, nulls)

    def commit(self, messages):
        parts = sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.first)
        bases = np.concatenate(([0], np.cumsum([m.ids for m in parts], dtype=np.int64))).tolist()
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        listed = {"width": self.width, "ids": bases[-1], "parts": [{"name": m.name, "base": b, "docs": m.docs, "ids": m.ids, "nulls": m.nulls} for m, b in zip(parts, bases, strict=False)]}
        with fs.open_output_stream(f"{root}/parts.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages):
        """Removes what tasks that had ended have written; files of broken attempts stay, in no list."""
        fs, root = _fs(self.path)
        for m in messages:
            if m is not None:
                for kind in ("bin", "idx", "doc"):
                    fs.delete_file(f"{root}/{m.name}.{kind}")


class _Flat:
    """A flat file of numbers: memory-mapped where it is local, else read in the ranges asked for."""

    def __init__(self, path: str, name: str, kind: str):
        fs, root = _fs(path)
        self.kind, self.file, self.map = np.dtype(kind), None, None
        if isinstance(fs, pafs.LocalFileSystem):
            self.map = np.memmap(f"{root}/{name}", kind, "r") if os.path.getsize(f"{root}/{name}") else np.zeros(0, kind)
        else:
            self.file = fs.open_input_file(f"{root}/{name}")

    def __getitem__(self, at: slice) -> np.ndarray:
        if self.file is None:
            return self.map[at]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((at.stop - at.start) * size, at.start * size), self.kind)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        fs, root = _fs(path)
        with fs.open_input_stream(f"{root}/parts.json") as file:
            listed = json.loads(file.read())
        self.width, self.parts = listed["width"], [_Part(x["name"], x["base"], x["docs"], x["nulls"]) for x in listed["parts"]]

    def partitions(self):
        return self.parts or [_Part("", 0, 0, 0)]

    def read(self, partition):
        if not partition.name:
            return
        ids, places, keys = (_Flat(self.path, f"{partition.name}.{end}", kind) for end, kind in (("bin", f"<u{self.width}"), ("idx", "<u8"), ("doc", "<i8")))
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        for k in range(0, partition.docs, 512):
            last = min(k + 512, partition.docs)
            cut = places[k : last + 1].astype(np.int64)
            rows = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            docs = pa.array(np.array(keys[k:last]), pa.int64(), mask=np.arange(k, last) < partition.nulls)
            yield pa.RecordBatch.from_arrays([docs, pa.array(cut[:-1] + partition.base), pa.array(rows, pa.binary())], schema=schema)


class LibraryEncoder:
    """The tokenizers library, run once for each distinct part of the texts (see ``parts``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            plain = plain_split(json.load(file))
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        mark = self._ids("\n").tolist()
        self.mark = mark[0] if plain and len(mark) == 1 else None
        self.parts = Parts(self._learn, self._ids, [t.content for t in self.tok.get_added_tokens_decoder().values()])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, parts: list[str]) -> list[np.ndarray]:
        """Many parts in one call, a new line before each, which is a token of its own there; white space alone by itself."""
        out: list = [None if not p[-1].isspace() else self._ids(p) for p in parts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), 20_000):
            some = rest[k : k + 20_000]
            (made,) = self.tok.encode_batch_fast(["\n" + "\n".join([parts[j] for j in some])], add_special_tokens=False)
            ids = np.array(made.ids, np.uint32)
            heads = np.flatnonzero(ids == self.mark)
            for j, row in zip(some, np.split(ids, heads)[1:], strict=True):
                out[j] = row[1:]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, number of ids of each)."""
        if self.mark is not None:
            return self.parts.encode_texts(texts)
        rows = [self._ids(t or "") for t in texts.to_pylist()]
        return (np.concatenate(rows) if rows else np.zeros(0, np.uint32)), np.array([len(r) for r in rows], np.int64)


@lru_cache(2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(df: DataFrame, vocabulary: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", width: int = 2, partitions: int | None = None) -> None:
    """Encodes whole texts and writes the data set ``path`` in ascending order of ``doc_id``.

    Null texts count as empty and hold ``end_id`` alone; rows without a doc_id come first; equal ids are ordered by
    their text. ``width`` is checked against every id. A path that holds a data set already is an error. An empty table
    gives a data set without files. Repeated rows are documents of their own; extra columns are left out. One shuffle by
    ranges deals the rows out, ids with the same doc_id included (the text's hash is part of the range key), so no key
    fills one task; there are as many parts as the session's shuffles have, more where a part would have to hold much
    more than PART_BYTES of text.
    """
    spark = df.sparkSession
    fs, root = _fs(path)
    if fs.get_file_info(f"{root}/parts.json").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{path} holds a data set")
    spark.dataSource.register(TokenFiles)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("tie"))
    if not partitions:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    dealt = rows.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    dealt.write.format("token_files").mode("append").options(path=path, vocabulary=vocabulary, end_id=end_id, width=width).save()


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary, little-endian unsigned 32-bit), from the files."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("path", path).load()


def token_file_round(df: DataFrame, vocabulary: str, end_id: int, width: int = 2) -> DataFrame:
    """Writes ``df`` to a new data set in the shared folder and returns what reading it gives."""
    path = f"{shared_dir(df.sparkSession)}/tokens"
    write_token_files(df, vocabulary, path, end_id, width=width)
    return read_token_files(df.sparkSession, path)
