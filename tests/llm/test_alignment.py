"""Aligned tokens of two vocabularies against a plain version over the libraries; perfect hashing; odd texts."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marlstone.llm import alignment, queries
from marlstone.llm.bpe import byte_letters

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  ", "\n", " \n a", "a  b", "a \n b\t c ", "<|endoftext|> x <s> </s>", "é漢字🙂 \x1c\t", "x" * 3000, "a  b　 c\x85 d", "▁ up", "a ▁b c", "“q” — ‘r’ … s", "token: token: abcdef", "\x00 null", "🙂🙂 🙂" * 50, "ﬁ é ñ", "word " * 400]


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(queries.BYTE_BPE)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)


def plain(texts, libraries):
    tok, sp = libraries
    back = {c: b for b, c in enumerate(byte_letters())}
    groups_of = []
    for t in texts:
        groups = []
        if t:
            raw = (" " + t).encode()
            a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + t, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(t)]
            if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
                ends = lambda xs: np.cumsum([len(x) for _, x in xs]).tolist()
                ends_a, ends_b = ends(a), ends(b)
                last = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for (i, _), e in zip(a, ends_a, strict=True) if last < e <= cut] if len(a) < 400 else None, cut))
                    last = cut
                inside = lambda xs, es: np.split(np.array([i for i, _ in xs]), np.flatnonzero(np.isin(es, [c for _, c in groups]))[:-1] + 1)
                groups = [(x.tolist(), y.tolist()) for x, y in zip(inside(a, ends_a), inside(b, ends_b), strict=True)]
        groups_of.append(groups)
    counts = collections.Counter()
    for groups in groups_of:
        counts.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for groups in groups_of:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), told))
    return out, counts


def test_documents_equal_the_libraries(spark, libraries):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want, _ = plain([r.text for r in docs], libraries)
    sha = lambda told: hashlib.sha256(told.encode()).hexdigest() if told else ""
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_alignment(spark, DATA).collect()}
    assert got == {r.doc_id: (*w[:6], sha(w[6])) for r, w in zip(docs, want, strict=True)}


def odd_rows(spark):
    rng = random.Random(3)
    letters = [" ", "  ", "\n", "a", "the", "é", "漢", "🙂", ".", "'s", " ", "12", "<|endoftext|>", "ing", "▁"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["word word", "word word"]
    return texts, spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_a string, groups int").repartition(7)


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, libraries, monkeypatch, small):
    if small:  # tables that fill up, runs of links cut, pairs flushed, shards evicted
        for name, n in (("SEGMENTS", 20), ("LINKS", 5), ("HELD", 40), ("CACHE", 100)):
            monkeypatch.setattr(alignment, name, n)
    texts, df = odd_rows(spark)
    want, counts = plain(texts, libraries)
    out = alignment.align_documents(df, queries.BYTE_BPE, queries.PIECES)
    assert out.columns == ["doc_id", "text", *alignment.COUNTS, "groups"]
    got = {r.doc_id: (*(r[c] for c in alignment.COUNTS), r.groups) for r in out.collect()}
    for k, w in enumerate(want):
        assert got[k] == w, texts[k]
    tables = alignment.count_pairs(df, queries.BYTE_BPE, queries.PIECES)
    assert {(r.a_id, r.b_id): r.n_docs for r in alignment.pair_counts(spark, tables, queries.BYTE_BPE, queries.PIECES).collect()} == counts


def test_small_limits_in_one_process(libraries, monkeypatch):
    """The limits of the workers hold in this process, where they can be set."""
    texts = [t for t in ODD if t]
    whole = alignment.Aligner(alignment.vocabularies(queries.BYTE_BPE, queries.PIECES))
    import pyarrow as pa

    ids, counts = whole.encode(pa.array(texts))
    monkeypatch.setattr(alignment, "LINKS", 3)
    cut = alignment.Aligner(alignment.vocabularies(queries.BYTE_BPE, queries.PIECES))
    ids_2, counts_2 = cut.encode(pa.array(texts))
    assert counts.tolist() == counts_2.tolist() and (whole.rows[ids][:, [0, 2, 3, 4, 5]] == cut.rows[ids_2][:, [0, 2, 3, 4, 5]]).all()
    keys = lambda a, k: set(a.pool[a.at[k] : a.at[k] + a.rows[k, 1]].tolist())
    assert all(keys(whole, a) == keys(cut, b) for a, b in zip(ids.tolist(), ids_2.tolist(), strict=True))
    monkeypatch.setattr(alignment, "SEGMENTS", 1)
    again, _ = whole.encode(pa.array(texts))
    assert whole.count <= len(texts) * 200 and again.max() < whole.count


def test_empty_tables(spark):
    df = spark.createDataFrame([], "text string, doc_id long")
    assert alignment.align_documents(df, queries.BYTE_BPE, queries.PIECES).count() == 0
    none = alignment.align_documents(spark.createDataFrame([(None,), ("",)], "text string"), queries.BYTE_BPE, queries.PIECES).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 2


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**40, n).astype(np.uint64))
    made = alignment.PerfectHash.build(keys)
    assert sorted(made.index(keys).tolist()) == list(range(len(keys)))
    strange = np.setdiff1d(np.arange(500, dtype=np.uint64), keys)
    at = made.index(strange)
    assert ((at >= -1) & (at < max(len(keys), 0))).all()


def test_sums_of_vectors(spark):
    rows = [(s, b, np.full(5, s + b, np.int64).tobytes()) for s in range(3) for b in range(4) for _ in range(6)]
    df = spark.createDataFrame(rows, "shard int, branch int, sums binary").repartition(5)
    out = alignment._summed(alignment._summed(df, ["shard", "branch"]), ["shard"]).collect()
    assert {r.shard: np.frombuffer(r.sums, np.int64).tolist() for r in out} == {s: [6 * (4 * s + 6)] * 5 for s in range(3)}
