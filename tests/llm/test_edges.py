"""Nulls, repeats, ties, clashing names and empty tables; statistics and alignments against plain versions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import chat, decontam, hdlang, html_blocks, licenses, neardup, quality, secrets

DATA = "/root/testdata/sf0.001"


def text_of(rng, n):
    return " ".join(f"w{k}" for k in rng.integers(5000, size=n))


def changed(text, at, word="other"):
    words = text.split()
    words[at] = word
    return " ".join(words)


def test_texts_that_share_an_id_are_each_compared(spark):
    rng = np.random.default_rng(1)
    a, b = text_of(rng, 80), text_of(rng, 80)
    rows = [(1, a), (1, b), (2, changed(a, 3)), (3, changed(b, 70)), (4, text_of(rng, 60)), (None, a), (1, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    keys = {(r.doc_id, bytes(r.digest)): bytes(r.class_key) for r in got}
    assert len(got) == 7 and len(set(keys.values())) == 3
    by_id = {r.doc_id: r for r in got if r.doc_id in (2, 3, 4)}
    assert by_id[2].class_key != by_id[3].class_key and by_id[2].class_id == by_id[3].class_id == 1
    assert by_id[2].texts == 2 and by_id[4].texts == 1 and not by_id[4].similar
    assert sorted((r.doc_id, r.chosen) for r in got if r.chosen) == [(1, True), (1, True), (1, True), (4, True)]


def test_quality_whatever_the_columns_are_called(spark):
    df = spark.createDataFrame([("a b c " * 30, 1, 2, 3), (None, 1, 2, 3), ("a b c " * 30, 1, 2, 3)], "text string, __words int, __row int, __n int")
    got = quality.judge_quality(df).collect()
    assert [r["__words"] for r in got] == [1, 1, 1] and [r.quality_measures.n_words for r in got] == [90, 0, 90] and got[0]["__row"] == 2


def test_secrets_whatever_the_columns_are_called(spark):
    df = spark.createDataFrame([("password=abcdef12", 1, 2), (None, 1, 2)], "text string, __found int, __base int")
    got = secrets.scan_secrets(df).collect()
    assert [len(r.secrets) for r in got] == [1, 0] and [r["__base"] for r in got] == [2, 2]


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def plain_battery(body):
    letters, same = next((x, c) for _, x, c in secrets.ENCODINGS if set(body) <= set(x))
    n, m = len(body), len(letters)
    at = np.array([letters.index(c) for c in body], float)
    chi = sum((np.sum(at == k) - n / m) ** 2 / (n / m) for k in range(m))
    over = n * (m * same - 1)
    p = phi((chi - (m - 1) - over) / math.sqrt(2 * (m - 1 + 2 * over)))
    up = at > (m - 1) / 2
    high = int(up.sum())
    expected = 1 + 2 * high * (n - high) / n
    runs = (1 + int(np.sum(up[1:] != up[:-1])) - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    d = at - at.mean()
    serial = np.sum(d[:-1] * d[1:]) / max(np.sum(d[:-1] ** 2), 1e-9) * math.sqrt(n)
    return p, 2 * phi(-abs(runs)), 2 * phi(-abs(serial))


def test_battery_against_numpy(spark):
    rng = np.random.default_rng(6)
    bodies = ["".join(rng.choice(list(x), size=int(rng.integers(20, 70)))) for _, x, _ in secrets.ENCODINGS for _ in range(4)] + ["thequickbrownfoxjumpsover", "a" * 30, "abababababababababababab"]
    for r in spark.createDataFrame([(b,) for b in bodies], "b string").select("b", secrets.battery(F.col("b")).alias("t")).collect():
        assert np.allclose((r.t.p, r.t.p_runs, r.t.p_serial), plain_battery(r.b), atol=1e-3), r.b


def test_step_up_against_a_plain_version(spark):
    rng = np.random.default_rng(9)
    letters = list(secrets.ENCODINGS[-1][1][:62])
    bodies = ["".join(rng.choice(letters, size=int(n))) for n in rng.integers(20, 60, size=12)] + ["internationalizationand", "thisisanordinarysentenceofwords"]
    text = " ".join(bodies)
    family = [(b, plain_battery(b)) for b in bodies]
    family = [(b, t[0]) for b, t in family if 2 * min(t[1:]) >= 0.002]
    mean = np.mean([len(b) for b, _ in family])
    ranked = sorted((p * mean / len(b), b) for b, p in family)
    last = max((k for k, (p, _) in enumerate(ranked) if p * len(ranked) <= 0.01 * (k + 1)), default=-1)
    want = {b for _, b in ranked[: last + 1]}
    found = secrets.scan_secrets(spark.createDataFrame([(text,)], "text string")).first().secrets
    assert {text[s.start : s.end] for s in found if s.rank == 3} == want and want


def test_no_run_that_passes_the_tests(spark):
    df = spark.createDataFrame([("a" * 40 + " and " + "ab" * 30,), ("z" * 30,), ("g" * 40 + " and " + "gh" * 30,)], "text string")
    got = [[tuple(s) for s in r.secrets] for r in secrets.scan_secrets(df).collect()]
    assert got == [[(0, 2, 40), (45, 2, 105)], [], []]  # base spans (hex) stay, none is added


def test_chat_other_parts_ties_and_empty_tables(spark):
    parts = "array<struct<type:string,text:string,ref:string,tokens:int>>"
    rows = [(1, 0, "user", [("audio", None, "a.wav", None), ("vid|>eo", None, "v", None), ("text", "x", None, None)]), (1, 0, "user", [("text", "same", None, None)]), (1, 0, "user", [("text", "same", None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}").withColumns({"formatted": F.lit(1), "loss": F.lit(2)})
    r = chat.format_conversations(df, text=None, parts="parts").first()
    assert [(a.type, a.tokens) for a in r.attachments] == [("audio", 128), ("vid|>eo", 0)] and r.n_turns == 3
    turns = chat.read_turns(r.formatted)
    assert sorted(t for _, t in turns) == ["<|audio:0|><|vid|>eo:1|>x", "same", "same"]
    assert chat.format_conversations(df.limit(0), text=None, parts="parts").count() == 0
    none = spark.createDataFrame([(5, None, None)], "conv_id long, formatted string, loss array<struct<start:int,end:int>>")
    assert chat.read_conversations(none).first().n_turns == 0


def test_decontamination_items_without_id_and_with_one_id(spark):
    rng = np.random.default_rng(3)
    a, b = text_of(rng, 40), text_of(rng, 40)
    bench = spark.createDataFrame([(None, a), (7, b), (7, text_of(rng, 30)), (8, None), (9, "***")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {a} after"), (2, f"x {b} y"), (2, f"x {b} y"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, [x["item_id"] for x in r["items"]]) for r in decontam.find_contamination(docs, bench).collect())
    assert got == [(1, []), (2, [7]), (2, [7]), (3, [])]
    with pytest.raises(ValueError):
        decontam.find_contamination(docs, bench, most_bytes=10)


def test_decontamination_of_graded_paraphrases(spark):
    """Items with a share of their words replaced by others: all with a tenth, at least 0.9 with a fifth (an item counts
    where 0.7 of its words in order and half of its answer words are left), none with a half."""
    rng = np.random.default_rng(12)
    items = [text_of(rng, 45) for _ in range(40)]
    rows = []
    for share in (0, 10, 20, 50):
        for k, t in enumerate(items):
            words = t.split()
            for i in rng.permutation(45)[: 45 * share // 100]:
                words[i] = f"other{rng.integers(10**6)}"
            rows.append((share * 1000 + k, f"{text_of(rng, 50)} {' '.join(words)} {text_of(rng, 50)}"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: {x["item_id"] for x in r["items"]} for r in decontam.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    recall = {s: np.mean([k in got[s * 1000 + k] for k in range(40)]) for s in (0, 10, 20, 50)}
    assert recall[0] == 1 and recall[10] == 1 and recall[20] >= 0.9 and recall[50] == 0
    assert all(found <= {d % 1000} for d, found in got.items())


def best_local(template, words):
    """Score of the best local alignment by full dynamic programming: +2, -1, -1."""
    row, best = [0] * (len(words) + 1), 0
    for t in template:
        new = [0]
        for j, w in enumerate(words):
            new.append(max(0, row[j] + (2 if t == w else -1), row[j + 1] - 1, new[-1] - 1))
            best = max(best, new[-1])
        row = new
    return best


def test_banded_alignment_against_the_full_one():
    rng = np.random.default_rng(4)
    for _ in range(40):
        template = rng.integers(1000, size=int(rng.integers(6, 30)))
        words = template.copy()
        words = words[rng.random(len(words)) > 0.1]
        words[rng.random(len(words)) < 0.1] = 5000
        text = np.concatenate((rng.integers(2000, 3000, size=10), words, rng.integers(2000, 3000, size=10)))
        made = licenses.align(template, text, -len(template) + 1, len(text) - 1, 1)
        matched, first, last = max(made)
        full = best_local(template, text)
        assert full == best_local(template, text[first:last]) and matched == max(m for m, _, _ in made)


def test_all_licenses_repeats_and_empty_tables(spark):
    rows = [(k, f"some words first {t} and some last") for k, (_, t) in enumerate(licenses.TEMPLATES)] + [(0, f"some words first {licenses.TEMPLATES[0][1]} and some last"), (99, None)]
    df = spark.createDataFrame(rows, "k int, text string").withColumn("__found", F.lit(1))
    got = licenses.scan_licenses(df).collect()
    for r in got:
        assert [m.license for m in r.licenses] == ([] if r.k == 99 else [licenses.TEMPLATES[r.k][0]]), r.k
    assert all(m.coverage == 1.0 for r in got for m in r.licenses) and licenses.scan_licenses(df.limit(0)).count() == 0


def test_quotes_in_attributes():
    said = lambda h: [b.text for b in html_blocks.blocks_of(h)]
    assert said("<p title=it's>Hello world</p><p>More text</p>") == ["Hello world", "More text"]
    assert said("<p a='x>y' b=\"1>2\">One</p>") == ["One"] and said("<p a=\"x>Two</p><p>Three</p>") == ["Two", "Three"]
    assert said("<p>Four</p><p class=") == ["Four"] and said("a < b <3 c") == ["a < b <3 c"]


def test_pages_against_their_article_element(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = html_blocks.extract_main_text(pages, html_blocks.fit_labeller(pages)).collect()
    with_article = [r for r in got if re.search(r"<article[ >]", r.html or "")]
    right = 0
    for r in with_article:
        inside = re.search(r"<article[ >].*</article>", r.html, re.S)[0]
        right += all(b.text in r.text for b in html_blocks.blocks_of(inside) if b.path[-1].startswith("p")) and len(r.text) > 0
    assert with_article and right / len(with_article) > 0.97
    assert html_blocks.extract_main_text(pages.limit(0), html_blocks.train(["a"], pages=40, epochs=1)).count() == 0


def test_language_ties_clashes_and_empty_tables(spark):
    v = hdlang.Space(1024, 3, 11).vector("some english words")
    same = {"aa": v / np.linalg.norm(v), "bb": v / np.linalg.norm(v)}
    df = spark.createDataFrame([("some english words", 1, "z"), (None, 1, "z"), ("some english words", 1, "z")], "text string, score int, lang_pred string")
    got = hdlang.identify_language(df, same).collect()
    assert [r.lang_pred for r in got] == ["aa", "und", "aa"] and got[0].score > 0.99 and got[1].score == 0
    assert hdlang.identify_language(df.limit(0), same).count() == 0


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    rows = [(None, "no id here but words enough", "en", "s", 5), (-5, None, None, None, None), (-6, "", "en", "s", 0), (-7, "Anlish the of inger token: abcdef123 and", "en", "s", 40), (-7, "Anlish the of inger token: abcdef123 and", "en", "s", 40)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumns({"secrets": F.lit(1), "digest": F.lit(2), "ids": F.lit(3), "items": F.lit(4), "lang_pred": F.lit(5)})
    for name, stage in corpus_pipeline.STAGES:
        full = stage(spark, odd, DATA)
        assert "secrets" not in full.columns and stage(spark, odd.limit(0), DATA).count() == 0
        if name == "near-dedup":
            kept = [r.doc_id for r in full.collect()]
            assert kept.count(-7) == 1 and kept.count(None) == 1 and kept.count(-6) == 1 and -5 not in kept or kept.count(-5) + kept.count(-6) == 1
        if name == "secret scan":
            assert full.count() == odd.count() and any(r.text is None for r in full.collect())
