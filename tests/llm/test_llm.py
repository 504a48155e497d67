"""The ten operators: against libraries, brute force, round trips and held-out accuracy; nulls, empty and odd inputs."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, decontam, hdlang, html_blocks, licenses, neardup, quality, queries, secrets, token_files
from marlstone.llm.common import bucket_df, text_array, word_blocks

DATA = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "  two  blanks\n\n ", "<|endoftext|> x<|endoftext|>", "é漢字🙂 \x1c\t", "token: token: abcdef", "x" * 5000, "a b c " * 2000, "*** ### %%%", "𝒳𝒴"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a repeated row, a null id, and columns whose names clash with results."""
    rows = [(k, t, "x", 1, "y") for k, t in enumerate(ODD)] + [(4, "a", "x", 1, "y"), (None, "a", "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, secrets string, ids int, licenses string")


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.BYTE_BPE)


def test_bpe_equals_the_library(spark, docs, odd, library):
    for table in (docs, odd):
        got = bpe.bpe_round_trip(table.select("doc_id", "text"), queries.BYTE_BPE).collect()
        assert len(got) == table.count()
        for r in got:
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    apart = bpe.bpe_decode(bpe.bpe_encode(odd, queries.BYTE_BPE), queries.BYTE_BPE).select("ids", "decoded").collect()
    assert apart == bpe.bpe_round_trip(odd, queries.BYTE_BPE).select("ids", "decoded").collect()
    none = bpe.bpe_round_trip(odd.limit(0), queries.BYTE_BPE)
    assert none.count() == 0 and set(odd.columns) <= set(none.columns)


def test_segment_tree_on_long_pieces(library):
    coder = bpe.SegmentTreeBpe(queries.BYTE_BPE)
    for text in ("a" * 9999, "ab" * 5000, "".join(chr(97 + k * k % 26) for k in range(3000))):
        assert coder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.decode([222]) == "�"


def test_token_files(spark, docs, odd, library):
    for table in (docs, odd, odd.limit(0)):
        got = sorted(token_files.token_file_round(table, queries.BYTE_BPE, 2).collect(), key=lambda r: r.start)
        want = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert [r.doc_id for r in got] == [r.doc_id for r in want]
        start = 0
        for g in got:
            ids = np.frombuffer(g.ids, "<u4")
            assert g.start == start and ids[-1] == 2
            start += len(ids)
        texts = collections.Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in want)
        assert texts == collections.Counter((g.doc_id, tuple(np.frombuffer(g.ids, "<u4").tolist())) for g in got)


def base_spans(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[2]) >= 6]
    for k, (name, pattern, least) in enumerate((("access", secrets.ACCESS, 20), ("hex", secrets.HEX, 24)), 1):
        spans += [(m.start(), k, name, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(spans))


def test_secrets(spark, docs, odd):
    random = hashlib.sha256(b"1").hexdigest()[:40]
    key = "q7Zr2LkX9vBt4NmC8wYd1HsJ6fGp3TaE5uKo0RiV"
    more = [f"🙂 password = '{random}'", f"AKIA{'A1' * 10} and {random}", f"see {key} here", "internationalizationalisation " * 3, "tOkEn:abc", f"secret={random} secret={random}"]
    extra = spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string")
    for table in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        found = secrets.scan_secrets(table).select("text", secrets.span_text(F.col("secrets"), True).alias("b"), secrets.span_text(F.col("secrets")).alias("s")).collect()
        for r in found:
            assert r.b == base_spans(r.text or "")
            assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
        if table is extra:
            spans = {r.text: r.s for r in found}
            assert spans[more[2]] == "random:4:44" and not spans[more[3]]
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan_secrets(extra)).collect()}
    assert clean[102] == "see [SECRET] here" and clean[103] == more[3] and random not in clean[105]
    assert secrets.scan_secrets(odd.limit(0)).count() == 0


def test_quality_and_chat_match_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, DATA), c.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, want.fetchall()))


def test_quality_repeats(spark, odd):
    got = {r.doc_id: r.quality_measures for r in quality.judge_quality(odd).collect()}
    assert got[10].n_repeat_words == 6000 and got[0].n_words == 0 and got[11].n_symbols == 9
    assert quality.judge_quality(odd.limit(0)).count() == 0


def test_chat_parts_and_escapes(spark):
    nasty = "\\h ### </turn>\n<|image:0|> \\"
    parts = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    rows = [
        (1, 1, "assistant", [("text", nasty, None, None), ("text", "#", None, None), ("image", None, "i.png", None), ("document", None, "d.pdf", 9), ("text", "#", None, None)]),
        (1, 0, "us\ner", [("text", "hi", None, None)]),
        (1, None, None, None),
        (None, 0, "user", []),
    ]
    made = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}"), text=None, parts="parts").collect()}
    r = made[1]
    assert [(a.type, a.ref, a.tokens, a.slot) for a in r.attachments] == [("image", "i.png", 256, 0), ("document", "d.pdf", 9, 1)]
    assert chat.read_turns(r.formatted) == [("", ""), ("us\ner", "hi"), ("assistant", nasty + "#<|image:0|><|document:1|>#")]
    assert chat.unescape(r.formatted[r.loss[0].start : r.loss[0].end]).startswith(nasty)
    assert made[None].n_turns == 1


def words(text):
    return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", text.lower()).split()


def test_word_hashes_and_frequencies(spark, docs):
    texts = [r.text for r in docs.select("text").collect()] + [t or "" for t in ODD]
    met = {}
    for first, last, hashes, counts, starts, ends in word_blocks(text_array(pa.array(texts))):
        said = [w for t in texts[first:last] for w in words(t)]
        assert counts.tolist() == [len(words(t)) for t in texts[first:last]]
        for w, h in zip(said, hashes.tolist(), strict=True):
            assert met.setdefault(w, h) == h
    assert len(set(met.values())) == len(met)
    table, n = bucket_df(docs.repartition(3), "text", 16)
    want = collections.Counter(b for r in docs.collect() for b in {met[w] >> 48 for w in words(r.text)})
    assert n == docs.count() and {k: v for k, v in enumerate(table.tolist()) if v} == dict(want)


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    ids = np.arange(300, dtype=np.uint64) * np.uint64(7919)
    a, b = rng.uniform(0.5, 5, 300), rng.uniform(0.5, 5, 300)
    s = [neardup.consistent_samples(ids, w, np.array([0]), 2000)[0] for w in (a, b)]
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def brute_classes(texts):
    """Classes by weighted Jaccard of all pairs that share a shingle; word frequencies by bucket, as defined."""
    said = {k: words(t or "") for k, t in texts.items()}
    known = sorted({w for v in said.values() for w in v})
    cell = {}
    for first, last, hashes, _, _, _ in word_blocks(text_array(pa.array(known))):
        cell |= dict(zip(known[first:last], (hashes >> np.uint64(64 - neardup.BITS)).tolist(), strict=True))
    df = collections.Counter(b for v in said.values() for b in {cell[w] for w in v})
    idf = {w: 1 + np.log((1 + len(texts)) / (1 + df[cell[w]])) for w in known}
    sets, index = {}, collections.defaultdict(set)
    for k, v in said.items():
        grams = collections.Counter(tuple(v[i : i + 5]) for i in range(max(1, len(v) - 4))) if v else {}
        sets[k] = {g: n * np.mean([idf[w] for w in g]) for g, n in grams.items()}
        for g in sets[k]:
            index[g].add(k)
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = {}
    for pair in {(min(a, b), max(a, b)) for v in index.values() for a in v for b in v if a != b}:
        x, y = sets[pair[0]], sets[pair[1]]
        low = sum(min(x[g], y[g]) for g in x.keys() & y.keys())
        near[pair] = low / (sum(x.values()) + sum(y.values()) - low)
    equal = collections.defaultdict(list)
    for k, t in texts.items():
        equal[t or ""].append(k)
    links = [p for p, s in near.items() if s >= 0.8] + [(v[0], k) for v in equal.values() for k in v]
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {k: find(k) for k in texts}


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(3000, size=120)]
    copies = []
    for k in range(60):  # one hot group: a hub with near and not so near copies
        t = base.copy()
        for i in rng.integers(120, size=int(rng.integers(1, 7))):
            t[i] = f"e{k}_{i}"
        copies.append((10_000 + k, " ".join(t)))
    copies += [(10_100, " ".join(base)), (10_101, " ".join(base)), (10_102, None), (10_103, ""), (10_104, "***"), (10_105, "one"), (10_106, "ONE!")]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(table).collect()}
    want = brute_classes({r.doc_id: r.text for r in table.collect()})
    wrong = [k for k in want if got[k] != want[k]]
    assert len(got) == len(want) and len(wrong) <= 1, wrong
    assert got[10_102] == got[10_103] == 10_102 and got[10_106] == 10_105


def test_near_duplicates_odd_inputs(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 2
    assert {r.class_id for r in got if r.doc_id is None} == {4}
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = {r.item_id: words(r.text) for r in bench.collect()}
    planted = [(20_000 + i, "filler words come first here and go on " * 6 + " ".join(w[:3] + ["other"] + w[4:]) + " and more filler comes after it " * 6) for i, w in items.items() if len(w) >= 20]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    got = {r.doc_id: {x["item_id"] for x in r["items"]} for r in decontam.find_contamination(table, bench).collect()}
    for r in table.collect():
        said = f" {' '.join(words(r.text))} "
        hits = {i for i, w in items.items() if f" {' '.join(w)} " in said}
        if r.doc_id >= 20_000:
            hits.add(r.doc_id - 20_000)
        assert hits <= got[r.doc_id]
        assert r.doc_id >= 20_000 or got[r.doc_id] == hits
    assert not any(r.contaminated for r in decontam.find_contamination(odd, bench, keep=odd.columns).collect())
    assert not any(r.contaminated for r in decontam.find_contamination(odd, bench.limit(0)).collect())
    assert decontam.find_contamination(odd.limit(0), bench).count() == 0


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(5, size=rng.integers(1, 30)).tolist(), rng.integers(5, size=rng.integers(0, 40)).tolist()
        assert decontam.lcs_length(a, b) == plain(a, b)


def test_randomized_svd(spark):
    rng = np.random.default_rng(0)
    dense = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 64))
    rows = spark.createDataFrame([(list(range(64)), [float(x) for x in r]) for r in dense], "at array<int>, v array<float>")
    basis, values = decontam.randomized_svd(rows, 64, 6, extra=4)
    assert np.allclose(values, np.linalg.svd(dense)[1][:6], rtol=1e-3)
    assert np.allclose(dense @ basis @ basis.T, dense, atol=1e-2)


def test_licenses(spark, docs, odd):
    pattern = "General Public License, version 3|CC BY-NC 4.0|under the MIT License|Apache License, Version 2.0"
    for r in licenses.scan_licenses(docs).collect():
        assert bool(r.licenses) == bool(re.search(pattern, r.text))
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT")
    changed = "🙂 İ before " + mit.replace("free of charge", "at no cost").replace("deal in the Software", "deal in it") + " after"
    got = licenses.scan_licenses(spark.createDataFrame([(changed,), ((changed + " x ") * 3,)], "text string")).collect()
    m = got[0].licenses[0]
    assert m.license == "MIT" and 0.9 < m.coverage < 1 and changed[m.start : m.end].startswith("Permission") and changed[m.start : m.end].endswith("Software")
    assert [x.license for x in got[1].licenses] == ["MIT"] * 3
    assert not any(r.licenses for r in licenses.scan_licenses(odd).collect())


def test_language_on_held_out_documents(spark, docs, odd):
    got = queries.op10_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert out and np.mean([r.lang_pred == r.lang for r in out]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    prototypes = hdlang.fit_prototypes(docs)
    strange = {r.doc_id: r.lang_pred for r in hdlang.identify_language(odd, prototypes).collect()}
    assert strange[0] == strange[1] == strange[11] == "und" and strange[9] != "und"
    assert hdlang.fit_prototypes(docs.limit(0)) == {} and hdlang.identify_language(odd, {}).where("lang_pred <> 'und'").count() == 0


@pytest.fixture(scope="module")
def weights():
    return html_blocks.train([f"word{k}" for k in range(200)] + ["le", "la", "and,"], pages=400, epochs=8)


def test_html_blocks():
    page = "<html><body><nav><a href=x>Home</a> &amp;</nav><!-- <p>no</p> --><script>var a='</p><p>';</script><article><p>One &lt;b&gt;<br>two<p>A <b>bo</b>ld<div>x</div></article><footer>&copy;"
    got = [(b.path[-1], b.text) for b in html_blocks.blocks_of(page)]
    assert got == [("nav", "Home &"), ("p", "One <b> two"), ("p", "A bold"), ("div", "x"), ("footer", "©")]
    assert html_blocks.blocks_of(None) == [] and html_blocks.blocks_of("<script>x") == [] and html_blocks.blocks_of("a<!-- b") [0].text == "a"


def test_html_main_text(spark, weights):
    page = "<html><body><header><a>Site</a></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>Title</h1>" + "".join(f"<p>Sentence number {k} says something about the matter.</p>" for k in range(6)) + "</article><div class='sidebar'><a>Other</a></div><div class='comments'><p>I like it.</p></div><form>Name</form><footer>All rights reserved</footer></body></html>"
    rows = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (1, page, "x")], "page_id int, html string, text string")
    got = html_blocks.extract_main_text(rows, weights).collect()
    want = "Title " + " ".join(f"Sentence number {k} says something about the matter." for k in range(6))
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == [want, want, "", ""]


def test_html_held_out_layouts(weights):
    rng, features, wrong, total = np.random.default_rng(77), html_blocks.Features(), 0, 0
    for _ in range(100):
        blocks, labels = html_blocks._compose([f"other{k}" for k in range(100)], rng)
        p = html_blocks.scores([features.page(blocks)], weights)[0]
        wrong += int(((p >= 0.5) != np.array(labels, bool)).sum())
        total += len(labels)
    assert wrong / total < 0.04


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.select("doc_id").join(before, "doc_id", "left_anti").count() == 0
        if name != "BPE":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "near-dedup":
            classes = brute_classes({r.doc_id: r.text for r in before.collect()})
            assert abs(docs.count() - len(set(classes.values()))) <= 1
        if name == "secret scan":
            assert docs.count() == before.count() and not any(base_spans(r.text) for r in docs.collect())
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
