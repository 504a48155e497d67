"""The registered queries of this subpackage and their SQL: thin contracts over the operators' own results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import alignment, bpe, chat, decontam, hdlang, html_blocks, licenses, neardup, prefix_trie, quality, secrets, suffix_dedup, token_files
from marlstone.llm.common import staged

#: A vocabulary file of the public tokenizers that the machine offers; never copied here.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_blocks.extract_main_text(pages, html_blocks.fit_labeller(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.span_text(F.col("secrets"), base_only=True), 256).alias("base_sha256"), secrets.span_text(F.col("secrets")).alias("spans")
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_files.token_file_round(_table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "licenses")
    told = F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], F.round(m["coverage"], 4).cast("string"), m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), told.alias("matches"), F.coalesce(F.array_max(F.transform("licenses", lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema))
    return chat.read_conversations(staged(chat.format_conversations(rows), "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("quality_measures")
    return out.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    told = F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",")
    return found.select("doc_id", "contaminated", F.transform("items", lambda x: x["item_id"]).alias("item_ids"), told.alias("items"), F.round("best", 6).alias("best"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE)
    told = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(told, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "similar", "texts")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = hdlang.fit_prototypes(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return hdlang.identify_language(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """The turns of conversations rebuilt as the contract says: the first h of conversation c - c % 5, then c's own after its
    first h. A row without digest stands for the conversation itself."""
    h, base = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, F.col("conv_id") - F.col("conv_id") % 5
    ids = turns.where("pos = 1").select("conv_id", base.alias("base"), h.alias("h"))
    first = turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") <= 8)).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    taken = ids.join(first, "base").where("pos <= h").select("conv_id", "pos", "digest", "bytes")
    itself = ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return itself.unionByName(taken).unionByName(turns.where(F.col("pos") > h))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(prefix_trie.ordered_turns(_table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie_of(rebuilt_turns(turns)).drop("node", "parent")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, PIECES, digest=True)
    return found.select("doc_id", *alignment.COUNTS, F.col("groups").alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_secret_scan, op3_token_files, op4_license_scan, op5_chat_format, op6_quality_rules, op7_decontamination, op8_bpe, op9_near_duplicates, op10_language_id, op11_prefix_trie, op12_suffix_dedup, op13_token_alignment)}


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
ORACLES = {
    "op5_chat_format": r"""
        with rows as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -7, 0, 'user', '\### Assistant: </turn> ok'
          union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        sized as (
          select *, length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<|', '\p')) as n from rows)
        select conv_id, count(*) as n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
          cast(sum(4 + length(role) + 1 + n + 9) as bigint) as formatted_chars
        from sized group by conv_id""",
    "op11_prefix_trie": r"""
        with turns as (
          select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
            row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
          from conversations where conv_id is not null),
        coded as (
          -- crc32, bit by bit: an element below 256 is a character to take in, 256 is one shift
          select conv_id, conv_id - conv_id % 5 as base,
            xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''),
                lambda c: [ascii(c)::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))),
              lambda a, x: case when x < 256 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295) % 9 as h
          from (select distinct conv_id from turns)),
        rebuilt as (
          select c.conv_id, t.role, t.text, t.pos from coded c join turns t on t.conv_id = c.base and t.pos <= c.h
          union all select c.conv_id, t.role, t.text, t.pos from coded c join turns t on t.conv_id = c.conv_id and t.pos > c.h),
        placed as (
          select conv_id, text, row_number() over o as depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over o) as node
          from rebuilt window o as (partition by conv_id order by pos)),
        paths as (
          select conv_id, depth, node, octet_length(encode(text)) as bytes from placed
          union all select conv_id, 0, 'root', 0 from coded),
        lasts as (select conv_id, max(depth) as depth from paths group by conv_id),
        ending as (select node, string_agg(conv_id::varchar, ',' order by conv_id) as ids from paths join lasts using (conv_id, depth) group by node),
        nodes as (select node, min(conv_id) as conv_id, min(depth) as depth, count(*) as n_convs, (count(*) - 1) * min(bytes) as saved from paths group by node),
        ups as (select n.node, n.saved, n.depth, p.node as above, p.depth as above_depth from nodes n join paths p on p.conv_id = n.conv_id and p.depth <= n.depth),
        kids as (select above as node, count(*) as n from ups where above_depth = depth - 1 group by above),
        totals as (select above as node, sum(saved) as saved, count(*) filter (where ups.node not in (select node from kids)) as leaves from ups group by above),
        parents as (select u.node, p.conv_id as parent_conv_id from ups u join nodes p on p.node = u.above where u.above_depth = u.depth - 1)
        select n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(k.n, 0) as n_children, t.leaves as n_leaves,
          cast(t.saved as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
        from nodes n join totals t using (node) left join kids k using (node) left join parents p using (node) left join ending e using (node)""",
    "op6_quality_rules": rf"""
        with split as (
          select doc_id, coalesce(text, '') as text,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
          from documents),
        words as (select row_number() over () as k, * from split),
        placed as (select k, unnest(words) as w, generate_subscripts(words, 1) as i from words),
        windows as (
          select k, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from placed window o as (partition by k order by i)),
        again as (select k, i from (select k, i, count(*) over (partition by k, g) as n from windows where g is not null) where n > 1),
        covered as (select k, count(distinct i + d) as n from again, (values (0), (1), (2)) as s(d) group by k),
        stops as (select k, count(*) as n from placed where lower(w) in ({_STOPS}) group by k),
        base as (
          select doc_id, cast(len(words) as bigint) as n_words,
            cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
            cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
            cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
            cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, coalesce(stops.n, 0) as n_stop,
            length(regexp_replace(text, '[^A-Z]+', '', 'g')) as n_upper
          from words left join covered using (k) left join stops using (k)),
        judged as (
          select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
            case when n_words > 0 then word_chars / n_words else 0 end as mean_word_chars,
            case when n_words > 0 then n_symbols / n_words else 0 end as symbol_ratio,
            case when n_words > 0 then n_stop / n_words else 0 end as stop_ratio,
            case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_line_ratio,
            case when word_chars > 0 then n_upper / word_chars else 0 end as upper_ratio
          from base)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          not base_failed and {" and ".join(c for _, r, lo, hi in quality.THRESHOLDS for c in ([f"{r} >= {lo}"] if lo is not None else []) + ([f"{r} <= {hi}"] if hi is not None else []))} as kept
        from judged""",
}
