"""Ids by distinct parts equal the tokenizers library's, whatever white space and marks stand where; tables that fill up."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from marlstone.llm import bpe, hdlang, parts, queries, token_files

LETTERS = ["a", "b", " ", "  ", "\n", "\t", "\r\n", ",", ".", "!", "'s", "'", "é", "中", "\u00a0", "\u3000", "\x1c", "\x85", "\u2003", "<|endoftext|>", "<", "1", "23", "word", "Ω", "“", "”", "🙂", "A", "\x00"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + [None, "", " ", "\n", "  ", "x" * 5000, "a," * 100_000 + " b"]


@pytest.fixture(scope="module")
def wanted(texts):
    library = Tokenizer.from_file(queries.BYTE_BPE)
    return [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def rows(made):
    ids, counts = made
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


@pytest.mark.parametrize("kind", [token_files.LibraryEncoder, bpe.SegmentTreeBpe])
def test_any_white_space(texts, wanted, kind):
    assert rows(kind(queries.BYTE_BPE).encode(pa.array(texts))) == wanted


@pytest.mark.parametrize("window", [7, 64, 1 << 20])
def test_small_windows_and_full_tables(texts, wanted, window, monkeypatch):
    monkeypatch.setattr(parts, "WINDOW", window)
    coder = bpe.SegmentTreeBpe(queries.BYTE_BPE)
    coder.parts.bits = 4
    coder.parts.clear()
    some = slice(0, 600)
    assert rows(coder.encode(pa.array(texts[some]))) == wanted[some]
    assert coder.parts.count <= 8


def test_ranges_of_remote_files(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(-(2**63), "smallest id"), (None, "no id"), (3, None), (3, "b"), (3, "b")], "doc_id long, text string")
    token_files.write_token_files(df, queries.BYTE_BPE, f"file://{tmp_path}/t", 2, partitions=2)
    with pytest.raises(FileExistsError):
        token_files.write_token_files(df, queries.BYTE_BPE, f"file://{tmp_path}/t", 2)
    local = [tuple(r) for r in token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()]
    assert [r[0] for r in local] == [None, -(2**63), 3, 3, 3]
    monkeypatch.setattr(token_files, "_fs", lambda path: (pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), "t"))  # not taken for local, so read by ranges
    reader = token_files._Reader("t")
    far = [tuple(x.values()) for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert sorted(far, key=lambda r: r[1]) == local


def test_language_vector_by_strides(monkeypatch):
    text = "Ein langer  Text, mit  Wörtern und 12 Zahlen. " * 40
    whole = hdlang.Space(64, 3, 1).vector(text)
    monkeypatch.setattr(hdlang, "STRIDE", 17)
    small = hdlang.Space(64, 3, 1, limit=4096)
    assert np.allclose(small.vector(text), whole) and small.vector(" 12 ,") is None and small.vector("") is None and small.vector("a") is not None
