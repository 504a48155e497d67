"""The registered queries over the library's operators, each with SQL that DuckDB runs where SQL can say it.

Doubles are rounded where a query ends, because two engines add them up in different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import expr as X
from marlstone.functions.shared import shared_path, written
from marlstone.operators import agg, conformal, drift, gram, joins, metrics, model, order, reshape, rules, split, text, verify
from marlstone.plans.frames import FRAMES, duck, frame
from marlstone.sources import measurements
from marlstone.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; sql may start from the frames m, p, g, t and c."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            used = [k for k in FRAMES if f" {k.lower()} " in f" {sql} ".replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " , ") and not re.search(rf"(with|,)\s+{k.lower()} as \(", sql)]
            ORACLES[name] = ("with " + ", ".join(f"{k.lower()} as ({duck(FRAMES[k])})" for k in used) + (", " if sql.lstrip().startswith("with ") else " ") + (sql.lstrip()[5:] if sql.lstrip().startswith("with ") else sql)) if used else sql
        return fn

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(c), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def measured(spark: SparkSession, d: str) -> DataFrame:
    """M with parsed endpoints (structs)."""
    return frame(spark, d, "M").withColumns({e: X.parse_qualified(f"{e}_txt") for e in ("ic50", "ki", "kd")})


def long_measured(spark: SparkSession, d: str) -> DataFrame:
    """compound, target, endpoint, value, weight (with penalties), sign."""
    m = measured(spark, d).withColumn("penalty", X.range_penalty({"ph": (5.5, 8.5), "temp_c": (33.0, 45.0)}))
    cells = F.array(*(F.struct(F.lit(e).alias("endpoint"), F.col(e)["value"].alias("value"), (F.col(e)["weight"] * F.col("penalty")).alias("weight"), F.col(e)["sign"].alias("sign")) for e in ("ic50", "ki", "kd")))
    return m.select("compound", "target", F.explode(cells).alias("x")).select("compound", "target", "x.*").where("value is not null")


#: The same in DuckDB: relation ``lm``.
LONG = """pen as (select *, (case when ph < 5.5 or ph > 8.5 then 0.8e0 else 1e0 end) * (case when temp_c < 33 or temp_c > 45 then 0.8e0 else 1e0 end) as penalty from m),
  raw as (select compound, target, 'ic50' as endpoint, ic50_txt as x, penalty from pen union all select compound, target, 'ki', ki_txt, penalty from pen union all select compound, target, 'kd', kd_txt, penalty from pen),
  signed as (select *, try_cast(nullif(regexp_extract(x, '[0-9.]+'), '') as double) as value,
    case when x like '>=%' then '>=' when x like '<=%' then '<=' when x like '>%' then '>' when x like '<%' then '<' when x like '~%' then '≈' else '=' end as sign from raw where x is not null),
  lm as (select compound, target, endpoint, value, sign, penalty * case sign when '=' then 1.0e0 when '≈' then 0.95e0 when '>' then 1.3e0 when '<' then 0.7e0 when '>=' then 1.15e0 else 0.85e0 end as weight from signed where value is not null)"""
_WP = """wv as (select compound, target, endpoint, value, sum(weight) as w from {src} group by 1, 2, 3, 4),
  wc as (select *, sum(w) over (partition by compound, target, endpoint order by value) / sum(w) over (partition by compound, target, endpoint) as cdf from wv),
  wl as (select *, lag(value) over o as pv, lag(cdf) over o as pc from wc window o as (partition by compound, target, endpoint order by value)),
  wp as (select compound, target, endpoint, coalesce(pv + (0.5 - pc) / (cdf - pc) * (value - pv), value) as value from wl where cdf >= 0.5 - 1e-12 and coalesce(pc < 0.5 - 1e-12, true))"""
_BAD = """spread as (select compound, target, endpoint, max(-log10(value / 1e9)) - min(-log10(value / 1e9)) as s from lm group by 1, 2, 3),
  bad as (select distinct compound, target from spread where s > 1.0)"""
_SIGN_PLACE = "case sign when '=' then 1 when '≈' then 2 when '>' then 3 when '<' then 4 when '>=' then 5 else 6 end"

# --- B: expressions --------------------------------------------------------------------------------------------------


@query(
    "b01_text_cleaning",
    r"""select doc_id, trim(split_part(source || ' |' || endpoint, '|', 1)) as stripped,
      regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as alphabet,
      upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as letters, source || '|' || endpoint as joined, source as first_token,
      case when doc_id % 2 = 0 then 'ABCDXYZ' else '' end as chain from t """,
)
def b01(spark, d):
    t = frame(spark, d, "T")
    chains = F.when(F.col("doc_id") % 2 == 0, F.lit("ABCDXYZ|ABCEXYZ")).otherwise(F.lit("ABCDXYZ|ABCDXYZW"))
    return t.select(
        "doc_id", X.strip_suffix(F.concat_ws(" |", "source", "endpoint")).alias("stripped"), X.keep_alphabet("text").alias("alphabet"), X.letters_upper("text").alias("letters"), X.join_nonempty(["source", F.lit(" "), F.lit("nan"), "endpoint"]).alias("joined"),
        X.first_token(F.concat(F.lit(" |nan|"), F.col("source"))).alias("first_token"), X.collapse_equivalent(chains).alias("chain"),
    )


@query("b06_qualified", f"with {LONG} select compound, target, endpoint, sign, count(*) as n, round(sum(value), 2) as total, round(sum(weight), 6) as weight, round(avg(-log10(value / 1e9)), 6) as p_value from lm group by 1, 2, 3, 4")
def b06(spark, d):
    g = long_measured(spark, d).groupBy("compound", "target", "endpoint", "sign")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum("weight"), 6).alias("weight"), F.round(F.avg(X.p_scale("value")), 6).alias("p_value"))


@query("b08_units", "select compound, target, rep, round(ph * 1000, 4) as milli, ph as plain from m ")
def b08(spark, d):
    units = {"mM": 1000.0, "M": 1.0}
    m = frame(spark, d, "M")
    return m.select("compound", "target", "rep", F.round(X.parse_with_unit(F.concat(F.col("ph").cast("string"), F.lit(" mM")), units), 4).alias("milli"), X.parse_with_unit(F.col("ph").cast("string"), units).alias("plain"))


_ERFC = "(1e0/(1e0+0.3275911*z))*(0.254829592+(1e0/(1e0+0.3275911*z))*(-0.284496736+(1e0/(1e0+0.3275911*z))*(1.421413741+(1e0/(1e0+0.3275911*z))*(-1.453152027+(1e0/(1e0+0.3275911*z))*1.061405429))))*exp(-z*z)"


@query(
    "b16_prediction_export",
    f"""with s as (select *, abs((3.0 - y_pred) / sigma) / sqrt(2e0) as z from p ), e as (select *, case when y_pred <= 3.0 then 0.5 * {_ERFC} else 1 - 0.5 * {_ERFC} end as q from s)
      select uid, cast(y_true >= 3.0 as int) as strong, round(q, 5) as prob, round(y_pred - 1.6448536269514722 * sigma, 6) as lo, round(y_pred + 1.6448536269514722 * sigma, 6) as hi,
        round(greatest(0e0, least(6e0, y_pred * 1.1 - 0.2)), 6) as mapped, round(least(-0.5 * (y_pred - sigma) + 1, -0.5 * (y_pred + sigma) + 1), 6) as flip_lo,
        round(exp(greatest(-50, least(50, ln((y_true - y_pred) * (y_true - y_pred) + 1e-6))) / 2), 6) as sigma_back, round(abs(y_true - y_pred), 6) as abs_err from e""",
)
def b16(spark, d):
    interval, flip = X.gaussian_interval("y_pred", "sigma", 0.9), X.affine_interval(F.col("y_pred") - F.col("sigma"), F.col("y_pred") + F.col("sigma"), 1.0, -0.5)
    out = frame(spark, d, "P").where(X.finite("y_true", "y_pred")).select(
        "uid", X.binarize("y_true", 3.0).alias("strong"), F.round(X.prob_ge("y_pred", "sigma", 3.0), 5).alias("prob"), interval["lo"].alias("lo"), interval["hi"].alias("hi"), X.apply_affine("y_pred", -0.2, 1.1, (0.0, 6.0)).alias("mapped"), flip["lo"].alias("flip_lo"),
        X.sigma_from_log(X.residual_target("y_true", "y_pred"), low=0.0).alias("sigma_back"), F.abs(F.col("y_true") - F.col("y_pred")).alias("abs_err"),
    )
    return rounded(out)


@query(
    "b12_labels",
    """select compound, target, rep, case when ic50_txt is not null then 'IC50' when ki_txt is not null then 'Ki' when kd_txt is not null then 'Kd' else 'NA' end as kind,
      cast(compound as varchar) || '||' || cast(target as varchar) as pair, case when rep % 2 = 0 then 'pIC50' else 'pKi' end as endpoint,
      case when rep = 1 then 'seen' when rep = 2 then 'invalid' when rep = 3 then 'acyclic' when rep = 4 then 'known_scaffold' else 'novel_scaffold' end as novelty,
      case when rep = 1 then 'seen' when ph >= 9 then '>=0.90' when ph >= 7 then '>=0.70' else 'low' end as similarity from m """,
)
def b12(spark, d):
    m, rep = frame(spark, d, "M"), F.col("rep")
    return m.select(
        "compound", "target", "rep", X.present_columns(["ic50_txt", "ki_txt", "kd_txt"], ["IC50", "Ki", "Kd"]).alias("kind"), X.pair_key("compound", "target").alias("pair"), X.normalize_endpoint(F.when(rep % 2 == 0, "p_ic-50").otherwise("P-Ki")).alias("endpoint"),
        X.novelty_label(rep == 1, rep != 2, rep == 3, rep == 4).alias("novelty"), X.similarity_label(rep == 1, F.col("ph") / 10).alias("similarity"),
    )


@query(
    "b20_quantile_bins",
    """with s as (select endpoint, quantile_cont(y_true, [0.05, 0.25, 0.5, 0.75, 0.95]) as q from p group by 1)
      select endpoint, case when y_true < q[1] then '<q05' when y_true < q[2] then 'q05-q25' when y_true < q[3] then 'q25-q50' when y_true < q[4] then 'q50-q75' when y_true <= q[5] then 'q75-q95' else '>q95' end as bin,
        count(*) as n, round(avg(abs(y_true - q[3]) / greatest(q[4] - q[2], 1e-8)), 6) as distance from p join s using (endpoint) group by 1, 2""",
)
def b20(spark, d):
    p = frame(spark, d, "P")
    rows = p.join(F.broadcast(agg.quantile_spec(p, "y_true", ["endpoint"])), "endpoint")
    rows = rows.withColumn("bin", X.quantile_bin_label("y_true", F.struct("q05", "q25", "q50", "q75", "q95")))
    return rows.groupBy("endpoint", "bin").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y_true") - F.col("q50")) / F.col("iqr")), 6).alias("distance"))


# --- C, A8: rules ----------------------------------------------------------------------------------------------------


def _rules():
    return [("no_endpoint", rules.any_present(["ic50", "ki", "kd"])), ("no_target", rules.nonempty(["target"])), ("out_of_range", rules.in_range_or_null({"ic50": (1e3, 5e4), "ki": (1e3, 5e4), "kd": (1e3, 5e4)}))]


def _values(spark, d):
    return measured(spark, d).select("compound", "target", "rep", *(F.col(e)["value"].alias(e) for e in ("ic50", "ki", "kd")))


_TAGGED = """v as (select compound, target, rep, try_cast(regexp_extract(ic50_txt, '[0-9.]+') as double) as ic50, try_cast(regexp_extract(ki_txt, '[0-9.]+') as double) as ki, try_cast(regexp_extract(kd_txt, '[0-9.]+') as double) as kd from m ),
  tagged as (select *, case when ic50 is null and ki is null and kd is null then 'no_endpoint' when target is null then 'no_target'
    when not (coalesce(ic50 between 1e3 and 5e4, true) and coalesce(ki between 1e3 and 5e4, true) and coalesce(kd between 1e3 and 5e4, true)) then 'out_of_range' end as reason from v)"""


@query("a08_rejects", f"with {_TAGGED} select distinct compound, target, reason as filter_reason from tagged where reason is not null")
def a08(spark, d):
    return rules.with_rejects(_values(spark, d), _rules(), ["compound", "target"])[1]


@query("c03_kept", f"with {_TAGGED} select compound, target, count(*) as n, round(sum(coalesce(ic50, ki, kd)), 2) as total from tagged where reason is null group by 1, 2")
def c03(spark, d):
    kept = rules.with_rejects(_values(spark, d), _rules(), ["compound", "target"])[0]
    return kept.groupBy("compound", "target").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("ic50", "ki", "kd")), 2).alias("total"))


@query(
    "c06_rule_counts",
    f"""with {_TAGGED}, n as (select (select count(*) from tagged) as total, (select count(*) from tagged where reason = 'no_endpoint') as a, (select count(*) from tagged where reason = 'no_target') as b, (select count(*) from tagged where reason = 'out_of_range') as c)
      select 0 as step, 'no_endpoint' as rule, total as before, a as removed, total - a as after from n union all select 1, 'no_target', total - a, b, total - a - b from n union all select 2, 'out_of_range', total - a - b, c, total - a - b - c from n""",
)
def c06(spark, d):
    return rules.rule_counts(_values(spark, d), _rules())


@query("c04_model_input", "select row_key, compound, y, case when row_key % 5 = 0 then 1e0 else w end as w from g where row_key % 11 <> 0")
def c04(spark, d):
    g = frame(spark, d, "G")
    holes = g.withColumns({"y": F.when(F.col("row_key") % 11 != 0, F.col("y")), "w": F.when(F.col("row_key") % 5 == 0, F.lit(-1.0)).otherwise(F.col("w"))})
    return rules.model_input(holes, "target", "compound", "y", "w").select("row_key", "compound", "y", "w")


@query("c05_accept", "select endpoint, sigma * 2 <= 0.5 as accepted, count(*) as n from p group by 1, 2")
def c05(spark, d):
    p = frame(spark, d, "P").withColumn("bound", F.col("sigma") * 2)
    return p.groupBy("endpoint", rules.accept("bound", 0.5).alias("accepted")).agg(F.count("*").alias("n"))


# --- D: reshape ------------------------------------------------------------------------------------------------------


@query("d01_unpivot", f"with {LONG} select endpoint, target, count(*) as n, round(sum(value), 2) as total, round(sum(weight), 5) as weight from lm group by 1, 2")
def d01(spark, d):
    m = measured(spark, d).withColumn("penalty", X.range_penalty({"ph": (5.5, 8.5), "temp_c": (33.0, 45.0)}))
    wide = m.select("target", *(F.col(e)["value"].alias(e) for e in ("ic50", "ki", "kd")), *((F.col(e)["weight"] * F.col("penalty")).alias(f"w_{e}") for e in ("ic50", "ki", "kd")))
    rows = reshape.unpivot_endpoints(wide, {e: e for e in ("ic50", "ki", "kd")}, {e: f"w_{e}" for e in ("ic50", "ki", "kd")}, ["target"])
    return rows.groupBy("endpoint", "target").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.round(F.sum("weight"), 5).alias("weight"))


@query("d02_one_hot", "select uid, cast(endpoint = 'pIC50' as int) as endpoint_pIC50, cast(endpoint = 'pKi' as int) as endpoint_pKi, cast(dataset = 'random_validation' as int) as dataset_random_validation, cast(dataset = 'temporal' as int) as dataset_temporal from p ")
def d02(spark, d):
    p = reshape.dummies(reshape.one_hot(frame(spark, d, "P"), "endpoint", ["pIC50", "pKi"]), "dataset")
    return p.select("uid", "endpoint_pIC50", "endpoint_pKi", "dataset_random_validation", "dataset_temporal")


@query(
    "d04_pivot_share",
    """with c as (select dataset, endpoint as level, count(*) / sum(count(*)) over (partition by dataset) as share from p group by 1, 2)
      select level, round(max(share) filter (where dataset = 'random_validation'), 6) as random_validation, round(max(share) filter (where dataset = 'temporal'), 6) as temporal from c group by 1""",
)
def d04(spark, d):
    shares = agg.composition(frame(spark, d, "P"), "dataset", ["endpoint"])
    return rounded(reshape.pivot_share(shares, ["level"], "dataset", "share", ["random_validation", "temporal"]))


@query("d05_flatten", "select round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 6) as overall_rmse, round(avg(abs(y_true - y_pred)) filter (where endpoint = 'pKi'), 6) as pki_mae from p ".replace("pki_mae", '"pKi_mae"'))
def d05(spark, d):
    wide = metrics.regression_metrics(frame(spark, d, "P"), "y_true", "y_pred", "endpoint")
    long = wide.unpivot(["subset"], ["rmse", "mae"], "metric", "value")
    return rounded(reshape.flatten_metrics(long, "subset", "metric", "value", ["overall_rmse", "pKi_mae"]))


@query("d06_impute", "with h as (select uid, case when uid % 3 <> 0 then y_true end as y from p ) select uid, round(coalesce(y, (select quantile_cont(y, 0.5) from h)), 6) as y from h")
def d06(spark, d):
    p = frame(spark, d, "P").select("uid", F.when(F.col("uid") % 3 != 0, F.col("y_true")).alias("y"))
    return rounded(reshape.impute_median(p, ["y"]))


# --- E, O: joins and sets --------------------------------------------------------------------------------------------


@query("e01_xref", "select distinct p_partkey as part, n_name from part join supplier on p_partkey % 100 = s_suppkey % 100 join nation on s_nationkey = n_nationkey where p_size < 10")
def e01(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    keys = t("part").where("p_size < 10").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 100).alias("slot"))
    return joins.xref(keys, [(t("supplier").withColumn("slot", F.col("s_suppkey") % 100), "slot"), (t("nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")], ["part", "n_name"])


@query(
    "e02_map_tokens",
    """with k as (select distinct compound, accession, tokens from c ), w as (select compound, trim(unnest(string_split(tokens, '|'))) as tok from k), mp as (select distinct accession as tok, n_name as v from c )
      select k.compound, coalesce(string_agg(distinct mp.v, '|' order by mp.v), '') as mapped from k left join w on w.compound = k.compound and w.tok not in ('', 'nan') left join mp on mp.tok = w.tok group by 1""",
)
def e02(spark, d):
    c = frame(spark, d, "C")
    return joins.map_tokens(c.select("compound", "tokens").distinct(), "compound", "tokens", c.select("accession", "n_name").distinct(), "accession", "n_name")


@query("e03_attach", "select endpoint, count(*) as n, round(sum(y_true - y_pred), 4) as total from p where uid % 10 <> 0 group by 1")
def e03(spark, d):
    p = frame(spark, d, "P")
    both = joins.attach_predictions(p.select("uid", "endpoint", "y_true"), p.where("uid % 10 <> 0").select("uid", "endpoint", "y_pred"), "uid")
    return both.groupBy("endpoint").agg(F.count("*").alias("n"), F.round(F.sum(F.col("y_true") - F.col("y_pred")), 4).alias("total"))


@query("e04_seen", "with r as (select distinct compound, target from m where rep < 3) select rep, exists(select 1 from r where r.compound = m.compound) as seen_compound, exists(select 1 from r where r.compound = m.compound and r.target = m.target) as seen_pair, count(*) as n from m group by all")
def e04(spark, d):
    m = frame(spark, d, "M")
    ref = m.where("rep < 3")
    out = joins.seen_flag(joins.seen_flag(m, ref, ["compound"], "seen_compound"), ref, ["compound", "target"], "seen_pair")
    return out.groupBy("rep", "seen_compound", "seen_pair").agg(F.count("*").alias("n"))


@query("e05_dimension", "select o_orderkey as row_key, coalesce(c.c_mktsegment, 'none') as segment from orders o left join customer c on o.o_custkey = c.c_custkey and c.c_acctbal > 0")
def e05(spark, d):
    dim = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("compound"), F.col("c_mktsegment").alias("segment"))
    return joins.attach_dimension(frame(spark, d, "G"), dim, "compound", {"segment": "none"}).select("row_key", "segment")


@query("e06_alignment", "select (select count(*) from p where uid % 7 <> 0) as n_both, (select count(*) from p where uid % 7 = 0) as n_only_a, 0 as n_only_b, 0.25e0 as worst, false as ok")
def e06(spark, d):
    p = frame(spark, d, "P")
    other = p.where("uid % 7 <> 0").withColumn("y_true", F.col("y_true") + 0.25)
    return rounded(joins.check_alignment(p, other, "uid", "y_true", 1e-6))


@query("q05_check_keys", "select count(*) as n_labels, cast(sum(case when uid % 9 = 0 then 0 else 1 end) + 1 as bigint) as n_preds, 0 as n_duplicates, cast(sum(cast(uid % 9 = 0 as int)) as bigint) as n_missing, 1 as n_extra from p ")
def q05(spark, d):
    p = frame(spark, d, "P").select("uid")
    return joins.check_keys(p, p.where("uid % 9 <> 0").union(p.agg(F.lit(-1).cast("long"))), "uid")


@query("e07_select_by_key", "select uid, endpoint, target, y_true from p where uid % 50 = 3")
def e07(spark, d):
    p = frame(spark, d, "P").select("uid", "endpoint", "target", "y_true")
    return joins.select_by_key(p.union(p.where("uid % 100 = 3")), p.where("uid % 50 = 3"), ["uid", "endpoint", "target"])


@query("e08_map_distinct", "select doc_id, length(regexp_replace(text, '[^aeiou]', '', 'g')) as vowels from t ")
def e08(spark, d):
    return joins.map_distinct(frame(spark, d, "T").select("doc_id", "text"), "text", lambda c: F.length(F.regexp_replace(c, "[^aeiou]", "")), "vowels").select("doc_id", "vowels")


@query("e09_edges", "select cast(y_true >= 2 as int) + cast(y_true >= 3 as int) + cast(y_true >= 4 as int) as bin, count(*) as n from p group by 1")
def e09(spark, d):
    return joins.edge_lookup(frame(spark, d, "P"), "y_true", [1.0, 2.0, 3.0, 4.0, 5.0]).groupBy("bin").agg(F.count("*").alias("n"))


@query("o01_sets", "select 'union' as op, count(*) as n from (select compound from m union all select compound from g ) union all select 'intersect', count(*) from (select compound from m intersect select compound from g ) union all select 'except', count(*) from (select compound from m where compound not in (select compound from g )) union all select 'distinct', count(distinct compound) from m ")
def o01(spark, d):
    m, g = frame(spark, d, "M").select("compound"), frame(spark, d, "G").select("compound")
    n = lambda name, x: x.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return joins.union_all(n("union", joins.union_all(m, g)), n("intersect", joins.overlap(m, g, ["compound"])), n("except", joins.outside(m, g, ["compound"])), n("distinct", joins.distinct_keys(m, ["compound"])))


# --- F: aggregation --------------------------------------------------------------------------------------------------


@query(
    "f01_replicates",
    f"""with {LONG}, {_BAD}, kept as (select lm.* from lm anti join bad using (compound, target)), {_WP.format(src="kept")},
      cnt as (select compound, target, endpoint, count(*) as n, max(weight) * (1 + log10(count(*))) as weight from kept group by 1, 2, 3),
      sg as (select compound, target, endpoint, sign, count(*) as k, {_SIGN_PLACE} as place from kept group by all),
      ss as (select compound, target, endpoint, string_agg(sign, '|' order by place) as sign_set, arg_min(sign, -k * 10 + place) as sign from sg group by 1, 2, 3)
      select compound, target, endpoint, n, round(weight, 6) as weight, round(ln(value), 6) as ln_value, sign_set, sign, round(-log10(value / 1e9), 6) as p_value from cnt join wp using (compound, target, endpoint) join ss using (compound, target, endpoint)""",
)
def f01(spark, d):
    out = agg.aggregate_replicates(long_measured(spark, d), ["compound", "target"], tolerance=1.0)
    return rounded(out.withColumn("ln_value", F.log("value")).drop("value"))


@query("f02_weighted_percentile", f"with {LONG}, {_WP.format(src='lm')} select compound, target, endpoint, round(ln(value), 6) as ln_value from wp")
def f02(spark, d):
    out = agg.weighted_percentile(long_measured(spark, d), ["compound", "target", "endpoint"], "value", "weight")
    return rounded(out.select("compound", "target", "endpoint", F.log("value").alias("ln_value")))


@query("f03_conflicts", f"with {LONG}, {_BAD} select compound, target from bad")
def f03(spark, d):
    return agg.conflicting(long_measured(spark, d), ["compound", "target"], "endpoint", "value", 1.0)


@query("f04_signs", f"with {LONG}, sg as (select target, endpoint, sign, count(*) as k, {_SIGN_PLACE} as place from lm group by all) select target, endpoint, string_agg(sign, '|' order by place) as sign_set, arg_min(sign, -k * 10 + place) as sign from sg group by 1, 2")
def f04(spark, d):
    return agg.sign_summary(long_measured(spark, d), ["target", "endpoint"], "sign")


@query("f06_numeric_summary", "select compound, count(ph) as n, min(ph) as min, round(quantile_cont(ph, 0.5), 6) as median, max(ph) as max, count(*) filter (where ph < 5.5 or ph > 8.5) as n_outside from m group by 1")
def f06(spark, d):
    return rounded(agg.numeric_summary(frame(spark, d, "M"), ["compound"], "ph", 5.5, 8.5))


@query("f07_compact_set", "with v as (select distinct compound, target, ph from m ) select compound, target, case when count(*) <= 5 then string_agg(printf('%.2f', ph), '|' order by ph) else printf('nuniq=%d;min=%.2f;max=%.2f', count(*), min(ph), max(ph)) end as text from v group by 1, 2")
def f07(spark, d):
    return agg.compact_set(frame(spark, d, "M"), ["compound", "target"], "ph")


@query(
    "f08_penalties",
    "with v as (select target, (case when ph < 5.5 or ph > 8.5 then 0.8e0 else 1e0 end) * (case when temp_c < 33 or temp_c > 45 then 0.8e0 else 1e0 end) as p from m ), u as (select distinct target, round(p, 2) as r from v), s as (select target, string_agg(printf('%.2f', r), '|' order by r) as text from u group by 1) select target, count(*) as n, round(min(p), 6) as min, round(avg(p), 6) as mean, max(p) as max, count(*) filter (where p < 1 - 1e-12) as n_penalised, text from v join s using (target) group by target, text",
)
def f08(spark, d):
    m = frame(spark, d, "M").withColumn("penalty", X.range_penalty({"ph": (5.5, 8.5), "temp_c": (33.0, 45.0)}))
    return rounded(agg.penalty_summary(m, ["target"], "penalty"))


@query(
    "f09_profile",
    """with s as (select count(*) as total, count(y_true) as non_null, min(y_true) as mn, max(y_true) as mx, avg(y_true) as mean, stddev_samp(y_true) as sd, quantile_cont(y_true, 0.25) as q25, quantile_cont(y_true, 0.5) as q50, quantile_cont(y_true, 0.75) as q75, count(distinct target) as dt, count(target) as nt from p )
      select 'y_true' as "column", unnest(['total', 'non_null', 'null_ratio', 'min', 'max', 'mean', 'sd', 'q25', 'median', 'q75']) as stat, round(unnest([total, non_null, 1 - non_null / total, mn, mx, mean, sd, q25, q50, q75]), 6) as value from s
      union all select 'target', unnest(['total', 'distinct', 'non_null']), unnest([total, dt, nt]) from s""",
)
def f09(spark, d):
    return rounded(agg.profile(frame(spark, d, "P"), ["y_true"], ["target"]))


@query(
    "f09_profile_many",
    " union all ".join(f"""select '{c}' as "column", unnest(['total', 'non_null', 'null_ratio', 'min', 'max', 'mean', 'sd', 'q25', 'median', 'q75']) as stat, round(unnest([count(*), count({c}), 1 - count({c}) / count(*), min({c}), max({c}), avg({c}), stddev_samp({c}), quantile_cont({c}, 0.25), quantile_cont({c}, 0.5), quantile_cont({c}, 0.75)]), 6) as value from (select y_true, y_pred, sigma, case when uid % 3 = 0 then null else uid % 17 end as part, cast(null as double) as none from p ) as z""" for c in ("y_true", "y_pred", "sigma", "part", "none")),
)
def f09_many(spark, d):
    """Five columns, one with gaps and one without a value, from one running count."""
    rows = frame(spark, d, "P").withColumns({"part": F.when(F.col("uid") % 3 != 0, F.col("uid") % 17), "none": F.lit(None).cast("double")})
    return rounded(agg.profile(rows, ["y_true", "y_pred", "sigma", "part", "none"]))


@query("f10_correlations", "select 'y_true' as a, 'y_pred' as b, round(corr(y_true, y_pred), 6) as r from p union all select 'y_true', 'sigma', round(corr(y_true, sigma), 6) from p union all select 'y_pred', 'sigma', round(corr(y_pred, sigma), 6) from p ")
def f10(spark, d):
    return rounded(agg.correlation_matrix(frame(spark, d, "P"), ["y_true", "y_pred", "sigma"]))


@query("f11_distributions", f"with {LONG} select endpoint, sign, count(*) as n, round(min(weight), 6) as w_min, round(max(weight), 6) as w_max, round(avg(weight), 6) as w_mean, round(count(*) / sum(count(*)) over (partition by endpoint), 6) as share from lm group by 1, 2")
def f11(spark, d):
    return rounded(agg.distribution_audit(long_measured(spark, d)))


@query("f12_composition", "with x as (select dataset, 'endpoint' as factor, endpoint as level from p union all select dataset, 'target', target from p ) select dataset, factor, level, count(*) as n, round(count(*) / sum(count(*)) over (partition by dataset, factor), 6) as share from x group by 1, 2, 3")
def f12(spark, d):
    return rounded(agg.composition(frame(spark, d, "P"), "dataset", ["endpoint", "target"]))


@query("f15_subset_audit", "select endpoint, target, count(y) as n, round(avg(y), 6) as mean, round(stddev_samp(y), 6) as sd, min(y) as min, max(y) as max, round(count(y) / sum(count(y)) over (partition by endpoint), 6) as share from g group by 1, 2")
def f15(spark, d):
    return rounded(agg.subset_audit(frame(spark, d, "G"), ["endpoint", "target"], "y"))


@query("f16_reference", "select count(*) as n_rows, count(distinct compound) as n_compounds, count(distinct target) as n_targets, (select count(*) from (select distinct compound, target from m )) as n_pairs from m ")
def f16(spark, d):
    return agg.reference_stats(frame(spark, d, "M"), "compound", "target")


@query("f17_quantiles", "with s as (select endpoint, quantile_cont(y_true, [0.05, 0.25, 0.5, 0.75, 0.95]) as q from p group by 1) select endpoint, round(q[1], 6) as q05, round(q[2], 6) as q25, round(q[3], 6) as q50, round(q[4], 6) as q75, round(q[5], 6) as q95, round(greatest(q[4] - q[2], 1e-8), 6) as iqr from s")
def f17(spark, d):
    return rounded(agg.quantile_spec(frame(spark, d, "P"), "y_true", ["endpoint"]))


@query("f18_folds", "with f as (select uid % 5 as fold, sqrt(avg((y_true - y_pred) ** 2)) as rmse, avg(abs(y_true - y_pred)) as mae from p group by 1) select 'rmse' as metric, round(avg(rmse), 6) as mean, round(stddev_pop(rmse), 6) as sd, count(*) as n from f union all select 'mae', round(avg(mae), 6), round(stddev_pop(mae), 6), count(*) from f")
def f18(spark, d):
    p = frame(spark, d, "P").withColumn("fold", F.col("uid") % 5)
    folds = metrics.regression_metrics(p, "y_true", "y_pred", "fold").where("subset <> 'overall'")
    return rounded(agg.fold_summary(folds, ["rmse", "mae"]))


@query("f19_histogram", "with e as (select min(y_true) as a, max(y_true) as b from p ), h as (select cast(least(19, floor((y_true - a) * 20 / (b - a))) as int) as bin, a, (b - a) / 20 as w from p , e) select bin, round(a + bin * w, 6) as lo, round(a + (bin + 1) * w, 6) as hi, count(*) as n from h group by bin, a, w")
def f19(spark, d):
    return rounded(agg.histogram(frame(spark, d, "P"), "y_true", 20))


@query("f21_grid", "with e as (select least(min(y_true), min(y_pred)) as a, greatest(max(y_true), max(y_pred)) as b from p ) select endpoint, cast(least(11, floor((y_true - a) * 12 / (b - a))) as int) as x_bin, cast(least(11, floor((y_pred - a) * 12 / (b - a))) as int) as y_bin, count(*) as n from p , e group by 1, 2, 3")
def f21(spark, d):
    return agg.grid_counts(frame(spark, d, "P"), "y_true", "y_pred", 12, ["endpoint"])


# --- G: order --------------------------------------------------------------------------------------------------------


@query("g01_average_rank", "select uid, rank() over (order by y_true) + (count(*) over (partition by y_true) - 1) / 2 as rank_all, rank() over (partition by endpoint order by y_true) + (count(*) over (partition by endpoint, y_true) - 1) / 2 as rank_endpoint from p ")
def g01(spark, d):
    p = frame(spark, d, "P").select("uid", "endpoint", "y_true")
    return order.average_rank(order.average_rank(p, "y_true", "rank_all"), "y_true", "rank_endpoint", ["endpoint"]).select("uid", "rank_all", "rank_endpoint")


@query("g02_keep_best", "select compound, target, uid from (select *, row_number() over (partition by compound, target order by abs(y_true - y_pred), uid) as k from p ) where k = 1")
def g02(spark, d):
    p = frame(spark, d, "P")
    return order.keep_best(p, ["compound", "target"], [F.abs(F.col("y_true") - F.col("y_pred")), F.col("uid")]).select("compound", "target", "uid")


@query("g03_qcut", "with e as (select endpoint, list_distinct(quantile_cont(sigma, [0.2, 0.4, 0.6, 0.8])) as q from p group by 1) select endpoint, len(list_filter(q, lambda x: x < sigma)) as bin, count(*) as n from p join e using (endpoint) group by 1, 2")
def g03(spark, d):
    return order.qcut(frame(spark, d, "P"), "sigma", 5, "bin", ["endpoint"]).groupBy("endpoint", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("g04_error_cdf", "with c as (select floor(round(abs(y_true - y_pred) * 10000) / 100) as error, count(*) as n from p group by 1) select error, n, round(100 * sum(n) over (order by error) / sum(n) over (), 6) as percent, error in (10, 20, 30) as is_key_threshold from c")
def g04(spark, d):
    p = frame(spark, d, "P").withColumn("error", F.floor(F.round(F.abs(F.col("y_true") - F.col("y_pred")) * 10000) / 100).cast("double"))
    return rounded(order.error_cdf(p, "error", (10.0, 20.0, 30.0)))


@query("g05_quantile_higher", "with r as (select y_true, row_number() over (order by y_true) as k, count(*) over () as n from p ) select min(y_true) filter (where k >= ceil(0.9 * (n - 1)) + 1) as value, max(n) as n from r")
def g05(spark, d):
    return order.quantile_higher(frame(spark, d, "P"), "y_true", 0.9)


@query("g06_quantile_conformal", "with r as (select endpoint, y_true, row_number() over (partition by endpoint order by y_true) as k, count(*) over (partition by endpoint) as n from p ) select endpoint, min(y_true) filter (where k >= least(n, ceil((n + 1) * 0.95))) as value, max(n) as n from r group by 1")
def g06(spark, d):
    return order.quantile_conformal(frame(spark, d, "P"), "y_true", 0.95, ["endpoint"])


@query("g07_top_n", "select endpoint, uid, y_true from (select *, row_number() over (partition by endpoint order by y_true desc, sigma, uid) as k from p ) where k <= 20")
def g07(spark, d):
    return order.top_n(frame(spark, d, "P"), [F.desc("y_true"), F.col("sigma"), F.col("uid")], 20, ["endpoint"]).select("endpoint", "uid", "y_true")


@query("g08_select_best", "with s as (select uid % 13 as stage, sqrt(avg((y_true - y_pred) ** 2)) as rmse from p group by 1) select stage, round(rmse, 6) as rmse from s order by rmse, stage limit 1")
def g08(spark, d):
    p = frame(spark, d, "P").groupBy((F.col("uid") % 13).alias("stage")).agg(F.sqrt(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), F.lit(2.0)))).alias("rmse"))
    return rounded(order.select_best(p, "rmse", "stage", higher=False))


@query("g09_auto_grid", "select list_aggregate(list_sort(list_distinct(list_transform(quantile_cont(sigma, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 3)))), 'string_agg', '|') as grid from p ")
def g09(spark, d):
    return order.auto_grid(frame(spark, d, "P"), "sigma").select(F.array_join(F.transform("grid", lambda x: x.cast("string")), "|").alias("grid"))


# --- H: metrics ------------------------------------------------------------------------------------------------------

_SUB = "s as (select 'overall' as subset, * from p union all select endpoint, * from p )"


@query(
    "h01_regression",
    f"with {_SUB}, mu as (select subset, avg(y_true) as my, avg(y_pred) as mp from s group by 1) select subset, count(*) as n, round(sqrt(avg((y_true - y_pred) ** 2)), 6) as rmse, round(avg((y_true - y_pred) ** 2), 6) as mse, round(avg(abs(y_true - y_pred)), 6) as mae, round(1 - sum((y_true - y_pred) ** 2) / sum((y_true - my) ** 2), 6) as r2, round(avg(y_pred - y_true), 6) as bias, round(corr(y_true, y_pred), 6) as pearson from s join mu using (subset) group by 1",
)
def h01(spark, d):
    return rounded(metrics.regression_metrics(frame(spark, d, "P"), "y_true", "y_pred", "endpoint"))


@query(
    "h03_spearman",
    f"with {_SUB}, r as (select subset, rank() over (partition by subset order by y_true) + (count(*) over (partition by subset, y_true) - 1) / 2 as a, rank() over (partition by subset order by y_pred) + (count(*) over (partition by subset, y_pred) - 1) / 2 as b from s) select subset, round(corr(a, b), 6) as spearman from r group by 1",
)
def h03(spark, d):
    return rounded(metrics.spearman(frame(spark, d, "P"), "y_true", "y_pred", "endpoint"))


@query(
    "h04_concordance",
    "with v as (select floor(round(y_true * 10000) / 100) as y, floor(round(y_pred * 10000) / 100) as q, count(*) as n from p group by 1, 2) select cast(sum(a.n * b.n) as bigint) as n_pairs, round(sum(a.n * b.n * case when a.q = b.q then 0.5e0 when (a.y < b.y) = (a.q < b.q) then 1e0 else 0e0 end) / sum(a.n * b.n), 9) as ci from v a join v b on a.y < b.y",
)
def h04(spark, d):
    p = frame(spark, d, "P").select(*(F.floor(F.round(F.col(c) * 10000) / 100).alias(n) for c, n in (("y_true", "y"), ("y_pred", "q"))))
    return rounded(metrics.concordance(p, "y", "q"), 9)


@query("h05_concordance_sampled")
def h05(spark, d):
    return metrics.concordance_sampled(frame(spark, d, "P"), "uid", "y_true", "y_pred", 20_000)


@query(
    "h06_rm2",
    f"""with {_SUB}, mu as (select subset, avg(y_true) as my, avg(y_pred) as mp, sum(y_true*y_pred)/sum(y_pred*y_pred) as k, sum(y_true*y_pred)/sum(y_true*y_true) as ki from s group by 1),
      v as (select subset, 1 - sum((y_true-y_pred)**2)/(sum((y_true-my)**2)+1e-12) as r2, any_value(k) as k, any_value(ki) as ki, 1 - sum((y_true-k*y_pred)**2)/(sum((y_true-my)**2)+1e-12) as r0, 1 - sum((y_pred-ki*y_true)**2)/(sum((y_pred-mp)**2)+1e-12) as ri from s join mu using (subset) group by 1),
      w as (select *, r2*(1-sqrt(abs(r2-r0))) as a, r2*(1-sqrt(abs(r2-ri))) as b from v)
      select subset, round(r2, 6) as r2, round(k, 6) as k, round(ki, 6) as k_inverse, round(r0, 6) as r02, round(ri, 6) as r02_inverse, round(a, 6) as rm2, round(b, 6) as rm2_inverse, round((a+b)/2, 6) as rm2_mean, round(abs(a-b), 6) as rm2_delta from w""",
)
def h06(spark, d):
    return rounded(metrics.rm2(frame(spark, d, "P"), "y_true", "y_pred", "endpoint"))


@query(
    "h07_error_shares",
    f"with {_SUB}, e as (select subset, abs(y_true - y_pred) as e, row_number() over (partition by subset order by abs(y_true - y_pred)) as k, count(*) over (partition by subset) as n from s) select subset, round(avg(cast(e <= 0.5 as int)), 6) as within_0_5, round(avg(cast(e <= 1.0 as int)), 6) as within_1_0, round(avg(cast(e <= 1.5 as int)), 6) as within_1_5, round(min(e) filter (where k >= ceil(0.9 * (n - 1)) + 1), 6) as ae_q90 from e group by 1",
)
def h07(spark, d):
    return rounded(metrics.abs_error_shares(frame(spark, d, "P"), "y_true", "y_pred", by="endpoint"))


_SCORES = f"{_SUB}, c as (select subset, y_pred as x, count(*) filter (where y_true >= 3) as pos, count(*) filter (where y_true < 3) as neg from s group by 1, 2), u as (select *, sum(pos) over o as tp, sum(neg) over o as fp, sum(pos) over (partition by subset) as np, sum(neg) over (partition by subset) as nn from c window o as (partition by subset order by x desc)), w as (select *, tp / (tp + fp) as pr, coalesce(lag(tp / (tp + fp)) over (partition by subset order by x desc), 1) as pp from u)"


@query("h08_roc_auc", f"with {_SCORES} select subset, round(sum(neg * (tp - pos / 2)) / max(np * nn), 6) as auc from w group by 1")
def h08(spark, d):
    return rounded(metrics.roc_auc(frame(spark, d, "P"), F.col("y_true") >= 3, "y_pred", "endpoint"))


@query("h09_pr_auc", f"with {_SCORES} select subset, round(sum(pr * pos) / max(np), 6) as aupr, round(sum((pr + pp) / 2 * pos) / max(np), 6) as trapezoid from w group by 1")
def h09(spark, d):
    p, label = frame(spark, d, "P"), F.col("y_true") >= 3
    both = metrics.pr_auc(p, label, "y_pred", "step", "endpoint").join(metrics.pr_auc(p, label, "y_pred", "trapezoid", "endpoint").withColumnRenamed("aupr", "trapezoid"), "subset")
    return rounded(both)


_Q = "least(0.999, greatest(0.001, y_pred / 6))"


@query(
    "h10_probability",
    f"""with q as (select endpoint, y_true, {_Q} as q from p ), s as (select 'overall' as subset, * from q union all select endpoint, * from q),
      b as (select subset, cast(least(19, floor(q * 20)) as int) as b, count(*) as n, avg(cast(y_true >= 3 as int)) as y, avg(q) as m from s group by 1, 2), e as (select subset, sum(n * abs(y - m)) / sum(n) as ece from b group by 1)
      select subset, round(ece, 6) as ece, round(avg((q - cast(y_true >= 3 as int)) ** 2), 6) as brier, round(-avg(case when y_true >= 3 then ln(q) else ln(1 - q) end), 6) as log_loss from s join e using (subset) group by subset, ece""",
)
def h10(spark, d):
    p = frame(spark, d, "P").withColumn("q", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("y_pred") / 6)))
    label = F.col("y_true") >= 3
    return rounded(metrics.ece(p, label, "q", by="endpoint").join(metrics.probability_scores(p, label, "q", "endpoint"), "subset"))


@query(
    "h12_intervals",
    f"with {_SUB}, i as (select *, y_pred - 1.5 * sigma as lo, y_pred + 1.5 * sigma as hi from s) select subset, count(*) as n, round(avg(cast(y_true between lo and hi as int)), 6) as coverage, round(avg(hi - lo), 6) as width_mean, round(quantile_cont(hi - lo, 0.5), 6) as width_median, round(avg(cast(y_true < lo as int)), 6) as below, round(avg(cast(y_true > hi as int)), 6) as above from i group by 1",
)
def h12(spark, d):
    p = frame(spark, d, "P").withColumns({"lo": F.col("y_pred") - 1.5 * F.col("sigma"), "hi": F.col("y_pred") + 1.5 * F.col("sigma")})
    return rounded(metrics.interval_metrics(p, "y_true", "lo", "hi", "endpoint"))


@query(
    "h13_coverage",
    """with s as (select endpoint, count(*) as n, sum(cast(abs(y_true - y_pred) <= sigma as int)) as c, avg(2 * sigma) as wm, quantile_cont(2 * sigma, 0.5) as w5, quantile_cont(2 * sigma, 0.9) as w9, sqrt(avg((y_true - y_pred) ** 2)) as rmse, avg(abs(y_true - y_pred)) as mae, avg(2 * sigma + greatest(0, abs(y_true - y_pred) - sigma) * 2 / (1 - 0.8e0)) as sc from p group by 1), z as (select *, c / n as q, 1.959963984540054e0 as z from s)
      select endpoint, n, cast(c as bigint) as covered, round(q, 6) as coverage, round(q - 0.8, 6) as gap, round(((q + z*z/(2*n)) - z * sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) as wilson_lo, round(((q + z*z/(2*n)) + z * sqrt(q*(1-q)/n + z*z/(4*n*n))) / (1 + z*z/n), 6) as wilson_hi, round(wm, 6) as width_mean, round(w5, 6) as width_median, round(w9, 6) as width_p90, round(rmse, 6) as rmse, round(mae, 6) as mae, round(sc, 6) as interval_score from z""",
)
def h13(spark, d):
    return rounded(metrics.coverage_metrics(frame(spark, d, "P"), "y_true", "y_pred", "sigma", F.lit(0.8), ["endpoint"]))


@query("h14_widths", "select endpoint, count(*) as n, round(avg(sigma), 6) as mean, round(stddev_pop(sigma), 6) as sd, round(min(sigma), 6) as min, round(max(sigma), 6) as max, " + ", ".join(f"round(quantile_cont(sigma, {q}), 6) as p{round(100 * q):02d}" for q in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " from p group by 1")
def h14(spark, d):
    return rounded(metrics.width_distribution(frame(spark, d, "P"), "sigma", ["endpoint"]))


@query(
    "h15_uncertainty",
    "with q as (select endpoint, sigma, round(abs(y_true - y_pred), 4) as e from p ), s as (select 'overall' as subset, * from q union all select endpoint, * from q), r as (select *, rank() over (partition by subset order by sigma) + (count(*) over (partition by subset, sigma) - 1) / 2 as a, rank() over (partition by subset order by e) + (count(*) over (partition by subset, e) - 1) / 2 as b from s) select subset, count(*) as n, round(corr(sigma, e), 6) as pearson, round(avg(sigma), 6) as sigma_mean, round(avg(e), 6) as error_mean, round(corr(a, b), 6) as spearman from r group by 1",
)
def h15(spark, d):
    p = frame(spark, d, "P").select("endpoint", "sigma", F.lit(0.0).alias("zero"), F.round(F.abs(F.col("y_true") - F.col("y_pred")), 4).alias("e"))
    return rounded(metrics.uncertainty_quality(p, "e", "zero", "sigma", "endpoint"))


@query("h16_prevalence", f"with {_SUB} select subset, count(*) as n, round(avg(cast(y_true >= 3 as int)), 6) as positive_rate, round(avg(cast(sigma <= 0.3 as int)), 6) as accepted_rate, count(*) filter (where sigma <= 0.3) as n_accepted from s group by 1")
def h16(spark, d):
    return rounded(metrics.prevalence(frame(spark, d, "P"), F.col("y_true") >= 3, F.col("sigma") <= 0.3, "endpoint"))


@query(
    "h17_pack",
    f"""with {_SUB}, mu as (select subset, avg(y_true) as my, avg(y_pred) as mp, sum(y_true*y_pred)/sum(y_pred*y_pred) as k, sum(y_true*y_pred)/sum(y_true*y_true) as ki from s group by 1),
      v as (select subset, count(*) as n, sum((y_true-y_pred)**2) as sse, sum(abs(y_true-y_pred)) as sae, avg(y_pred-y_true) as bias, corr(y_true, y_pred) as pearson, sum((y_true-my)**2) as syy, any_value(k) as k, any_value(ki) as ki, 1 - sum((y_true-y_pred)**2)/(sum((y_true-my)**2)+1e-12) as r2, 1 - sum((y_true-k*y_pred)**2)/(sum((y_true-my)**2)+1e-12) as r0, 1 - sum((y_pred-ki*y_true)**2)/(sum((y_pred-mp)**2)+1e-12) as ri from s join mu using (subset) group by 1),
      w as (select *, r2*(1-sqrt(abs(r2-r0))) as a, r2*(1-sqrt(abs(r2-ri))) as b from v),
      sp as (select subset, corr(a, b) as spearman from (select subset, rank() over (partition by subset order by y_true) + (count(*) over (partition by subset, y_true) - 1) / 2 as a, rank() over (partition by subset order by y_pred) + (count(*) over (partition by subset, y_pred) - 1) / 2 as b from s) group by 1),
      e as (select subset, abs(y_true - y_pred) as e, row_number() over (partition by subset order by abs(y_true - y_pred)) as k, count(*) over (partition by subset) as n from s),
      es as (select subset, avg(cast(e <= 0.5 as int)) as w1, avg(cast(e <= 1.0 as int)) as w2, avg(cast(e <= 1.5 as int)) as w3, min(e) filter (where k >= ceil(0.99 * (n - 1)) + 1) as q from e group by 1),
      sc as (select subset, y_pred as x, count(*) filter (where y_true >= 3) as pos, count(*) filter (where y_true < 3) as neg from s group by 1, 2), su as (select *, sum(pos) over o as tp, sum(neg) over o as fp, sum(pos) over (partition by subset) as np, sum(neg) over (partition by subset) as nn from sc window o as (partition by subset order by x desc)),
      au as (select subset, sum(neg * (tp - pos / 2)) / max(np * nn) as auc, sum(tp / (tp + fp) * pos) / max(np) as aupr from su group by 1),
      pt as (select subset, y_true as y, y_pred as q, count(*) as n from s group by all),
      ci as (select a.subset, sum(a.n * b.n * case when a.q = b.q then 0.5e0 when a.q < b.q then 1e0 else 0e0 end) / sum(a.n * b.n) as ci from pt a join pt b on a.subset = b.subset and a.y < b.y group by 1)
      select subset, n, round(sqrt(sse / n), 6) as rmse, round(sse / n, 6) as mse, round(sae / n, 6) as mae, round(1 - sse / syy, 6) as r2, round(bias, 6) as bias, round(pearson, 6) as pearson, round(spearman, 6) as spearman, round(k, 6) as k, round(ki, 6) as k_inverse, round(r0, 6) as r02, round(ri, 6) as r02_inverse,
        round(a, 6) as rm2, round(b, 6) as rm2_inverse, round((a + b) / 2, 6) as rm2_mean, round(abs(a - b), 6) as rm2_delta, round(w1, 6) as within_0_5, round(w2, 6) as within_1_0, round(w3, 6) as within_1_5, round(q, 6) as ae_q99, round(ci, 6) as ci, round(auc, 6) as auc, round(aupr, 6) as aupr, 0e0 as pearson_p, 0e0 as spearman_p, 0.99e0 as q_used
      from w join sp using (subset) join es using (subset) join au using (subset) join ci using (subset)""",
)
def h17(spark, d):
    return rounded(metrics.metric_pack(frame(spark, d, "P"), "y_true", "y_pred", 3.0, "endpoint"))


@query("f13_strata", "select subset, count(*) as n, round(sqrt(avg((y_true - y_pred) ** 2)), 6) as rmse from (select 'overall' as subset, y_true, y_pred from p union all select target, y_true, y_pred from p ) group by 1")
def f13(spark, d):
    return rounded(metrics.regression_metrics(frame(spark, d, "P"), "y_true", "y_pred", "target").select("subset", "n", "rmse"))


# --- I: calibration --------------------------------------------------------------------------------------------------


@query("i01_affine", "select endpoint, round(regr_intercept(y_true, y_pred), 6) as a, round(regr_slope(y_true, y_pred), 6) as b, count(*) as n from p where dataset = 'random_validation' group by 1")
def i01(spark, d):
    return rounded(conformal.fit_affine(frame(spark, d, "P").where("dataset = 'random_validation'"), "y_true", "y_pred", ["endpoint"]))


@query(
    "i02_binned",
    """with f as (select y_pred as x, abs(y_true - y_pred) as e from p ), e as (select quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from f), b as (select len(list_filter(list_distinct(q), lambda v: v <= x)) as bin, e from f, e)
      select cast(bin as int) as bin, count(*) as n, round(quantile_cont(e, 0.9), 6) as q from b group by 1""",
)
def i02(spark, d):
    return rounded(conformal.fit_binned_conformal(frame(spark, d, "P"), "y_true", "y_pred").select("bin", "n", "q"))


@query("i03_sigma", "select round(quantile_cont(abs(y_true - y_pred) / sigma, 0.9), 6) as q_scale, count(*) as n from p ")
def i03(spark, d):
    return rounded(conformal.fit_sigma_conformal(frame(spark, d, "P"), "y_true", "y_pred", "sigma"))


_SPLITFIT = """cal as (select *, abs(y_true - y_pred) as e, abs(y_true - y_pred) / sigma as sc from p where uid % 2 = 0), lv as (select unnest([0.8e0, 0.9e0, 0.95e0]) as level),
  u as (select 'normalised' as method, 'all' as endpoint, sc as v from cal union all select 'global', 'all', e from cal union all select 'endpoint', endpoint, e from cal),
  r as (select *, row_number() over (partition by method, endpoint order by v) as k, count(*) over (partition by method, endpoint) as n from u),
  fit as (select level, method, endpoint, min(v) filter (where k >= greatest(1, least(n, ceil(round((n + 1) * level, 9))))) as q, max(n) as n from r, lv group by 1, 2, 3)"""


@query("i04_split_conformal", f"with {_SPLITFIT} select level, method, endpoint, round(q, 6) as q, n from fit")
def i04(spark, d):
    return rounded(conformal.fit_split_conformal(frame(spark, d, "P").where("uid % 2 = 0"), "y_true", "y_pred", "sigma", "endpoint"))


@query(
    "i05_evaluate",
    f"""with {_SPLITFIT}, w as (select f.level, f.method, p.endpoint, abs(y_true - y_pred) as e, case when f.method = 'normalised' then q * sigma else q end as half from p join fit f on f.endpoint in ('all', p.endpoint) where uid % 2 = 1)
      select level, method, endpoint, count(*) as n, count(*) filter (where e <= half) as covered, round(avg(2 * half), 5) as width_mean from w group by 1, 2, 3""",
)
def i05(spark, d):
    p = frame(spark, d, "P")
    fitted = conformal.fit_split_conformal(p.where("uid % 2 = 0"), "y_true", "y_pred", "sigma", "endpoint")
    return rounded(conformal.evaluate_conformal(p.where("uid % 2 = 1"), fitted, "y_true", "y_pred", "sigma", "endpoint").select("level", "method", "endpoint", "n", "covered", "width_mean"), 5)


@query("i06_deciles", "with e as (select list_distinct(quantile_cont(sigma, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as q from p ) select cast(len(list_filter(q, lambda x: x < sigma)) as int) as decile, count(*) as n, count(*) filter (where abs(y_true - y_pred) <= 1.5 * sigma) as covered, round(avg(abs(y_true - y_pred)), 6) as mae from p , e group by 1")
def i06(spark, d):
    return rounded(conformal.uncertainty_deciles(frame(spark, d, "P"), "y_true", "y_pred", "sigma", 1.5, 0.9).select("decile", "n", "covered", "mae"))


@query(
    "i07_selective",
    """with t as (select unnest([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0]) as threshold), h as (select threshold, y_true as y, y_pred as q, abs(y_true - y_pred) as e, avg(y_true) over (partition by threshold) as m, row_number() over (partition by threshold order by abs(y_true - y_pred)) as k, count(*) over (partition by threshold) as n from t join p on sigma <= threshold)
      select threshold, count(*) as accepted, (select count(*) from p ) as total, round(count(*) / (select count(*) from p ), 6) as coverage, round(1 - count(*) / (select count(*) from p ), 6) as reject_rate, round(sqrt(avg((y - q) ** 2)), 6) as rmse, round(1 - sum((y - q) ** 2) / sum((y - m) ** 2), 6) as r2, round(min(e) filter (where k >= ceil(0.99 * (n - 1)) + 1), 6) as ae_q99 from h group by 1""",
)
def i07(spark, d):
    grid = spark.range(1, 6).select((F.col("id") / 10).alias("threshold"))
    return rounded(conformal.selective_table(frame(spark, d, "P"), grid, "y_true", "y_pred", "sigma"))


@query(
    "i08_curve",
    """with q as (select unnest(quantile_cont(sigma, [0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0])) as threshold from p union all select quantile_cont(sigma, 0.95) from p), t as (select distinct threshold from q where threshold not in (select quantile_cont(sigma, 0.0) from p))
      select round(threshold, 6) as threshold, count(*) as accepted, round(sqrt(avg((y_true - y_pred) ** 2)), 6) as rmse from t join p on sigma <= threshold group by t.threshold""".replace("[0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0]", "[" + ", ".join(repr(0.95 * (k + 1) / 19) for k in range(18)) + "]"),
)
def i08_curve(spark, d):
    return rounded(conformal.selective_curve(frame(spark, d, "P"), "y_true", "y_pred", "sigma").select("threshold", "accepted", "rmse"))


@query("i08_err_max", "select unnest([0.5e0, 0.8e0, 0.95e0]) as target, round(unnest(quantile_cont(sigma, [0.5, 0.8, 0.95])), 6) as err_max from p ")
def i08(spark, d):
    return rounded(conformal.err_max_for_coverage(frame(spark, d, "P"), "sigma", [0.5, 0.8, 0.95]))


@query("i09_calibrated", "select uid, round(y_pred * -1.2 + 0.5, 6) as p_cal, round((y_pred + sigma) * -1.2 + 0.5, 6) as lo_cal, round((y_pred - sigma) * -1.2 + 0.5, 6) as hi_cal, round(sigma * 1.2, 6) as half_cal from p ")
def i09(spark, d):
    p = frame(spark, d, "P").withColumns({"lo": F.col("y_pred") - F.col("sigma"), "hi": F.when(F.col("uid") % 2 == 0, F.col("y_pred") + F.col("sigma"))}).withColumn("lo", F.when(F.col("uid") % 2 == 0, F.col("lo")))
    return rounded(conformal.calibrate_intervals(p, 0.5, -1.2, "y_pred", "lo", "hi", sigma="sigma").select("uid", "p_cal", "lo_cal", "hi_cal", "half_cal"))


@query("i10_replay", "select 0e0 as worst, true as ok")
def i10(spark, d):
    p = frame(spark, d, "P").withColumn("stored", F.col("y_pred") * 1.25 + 0.5)
    return rounded(conformal.replay_mapping(p, 0.5, 1.25, "y_pred", "stored"))


#: The rules of candidates in SQL, from their description: best row of a key, thresholds, three classes with their orders.
_CANDIDATES = """with b as (select * from (select *, abs(y_true - y_pred) as e, row_number() over (partition by compound, target, endpoint order by abs(y_true - y_pred), sigma, uid, endpoint, y_true, y_pred, dataset) as k from p ) where k = 1),
      q as (select greatest(3.0, quantile_cont(y_pred, 0.9)) as high, greatest(3.2, quantile_cont(y_pred, 0.95)) as very, quantile_cont(sigma, 0.25) as narrow, quantile_cont(sigma, 0.75) as wide from b),
      a1 as (select 'narrow_good' as candidate_class, b.*, row_number() over (order by y_pred desc, e, sigma, compound, target, endpoint) as r from b, q where y_pred >= high and sigma <= narrow and e <= 0.3),
      a2 as (select 'wide_good' as candidate_class, b.*, row_number() over (order by y_pred desc, e, sigma desc, compound, target, endpoint) as r from b, q where y_pred >= high and sigma >= wide and e <= 0.3),
      a3 as (select 'wide_far' as candidate_class, b.*, row_number() over (order by y_pred desc, e desc, sigma desc, compound, target, endpoint) as r from b, q where y_pred >= high and sigma >= wide and e >= 0.4),
      a4 as (select * from a1 union all select * from a2 union all select * from a3)"""
_CANDIDATE_ARGS = {"n": 20, "floors": (3.0, 3.2), "errors": (0.3, 0.4, 0.45)}  # errors of P end near a half


def _candidate_rows(spark, d):
    return frame(spark, d, "P").withColumn("e", F.abs(F.col("y_true") - F.col("y_pred"))).select("uid", "endpoint", "y_true", "y_pred", "dataset", "sigma", "e", "compound", "target")


@query("i11_candidates", f"{_CANDIDATES} select candidate_class, compound, target, uid from a4 where r <= 20")
def i11(spark, d):
    found = conformal.select_candidates(_candidate_rows(spark, d), ["compound", "target", "endpoint"], "y_pred", "sigma", "e", **_CANDIDATE_ARGS)
    return found.select("candidate_class", "compound", "target", "uid")


@query(
    "i11_summary",
    f"""{_CANDIDATES}, k as (select count(*) filter (where candidate_class = 'narrow_good') as n1, count(*) filter (where candidate_class = 'wide_good') as n2, count(*) filter (where candidate_class = 'wide_far') as n3, count(*) as n4 from a4 where r <= 20)
      select 'rows' as section, 'all' as name, count(*) * 1e0 as value from b union all select 'endpoint', endpoint, count(*) from b group by 2
      union all select 'threshold', unnest(['high', 'very', 'narrow', 'wide', 'good', 'moderate', 'bad']), round(unnest([high, very, narrow, wide, 0.3, 0.4, 0.45]), 6) from q
      union all select 'class', unnest(['narrow_good', 'wide_good', 'wide_far', 'all']), unnest([n1, n2, n3, n4]) * 1e0 from k""",
)
def i11_summary(spark, d):
    return rounded(conformal.candidate_summary(_candidate_rows(spark, d), ["compound", "target", "endpoint"], "endpoint", "y_pred", "sigma", "e", **_CANDIDATE_ARGS))


@query("i12_half_width", "select count(*) as n, round(sum(sigma), 4) as total, count(*) as n_consistent from p ")
def i12(spark, d):
    p = frame(spark, d, "P").withColumns({"lo": F.col("y_pred") - F.col("sigma"), "hi": F.col("y_pred") + F.col("sigma")})
    return conformal.half_width(p, "lo", "hi", "y_pred").agg(F.count("*").alias("n"), F.round(F.sum("half_width"), 4).alias("total"), F.count_if("consistent").alias("n_consistent"))


# --- J, K: splits and weights ----------------------------------------------------------------------------------------

_H = "md5(cast(row_key as varchar) || ':5313')"


@query("j01_random_split", f"select row_key, case when row_number() over (order by {_H}, row_key) <= ceil(count(*) over () * 0.2) then 'valid' else 'train' end as split from g ")
def j01(spark, d):
    return split.random_split(frame(spark, d, "G").select("row_key"), "row_key", 0.2, 5313)


@query(
    "j03_group_split",
    """with gm as (select compound, quantile_cont(y, 0.5) as m from g group by 1), e as (select list_distinct(quantile_cont(m, [0.2, 0.4, 0.6, 0.8])) as q from gm),
      b as (select compound, len(list_filter(q, lambda x: x < m)) as bin, md5(cast(compound as varchar) || ':5313') as h from gm, e),
      r as (select *, row_number() over (partition by bin order by h, compound) as k, count(*) over (partition by bin) as n from b), c as (select *, k <= greatest(1, cast(round_even(n * 0.2, 0) as int)) as inn from r),
      o as (select compound, row_number() over (order by case when inn then 0 else 1 end, h, compound) as z, count(*) over () as total from c)
      select row_key, case when z <= round_even(total * 0.2, 0) then 'valid' else 'train' end as split from g join o using (compound)""",
)
def j03(spark, d):
    return split.group_stratified_split(frame(spark, d, "G"), "compound", "y", 0.2, 5313).select("row_key", "split")


@query(
    "j04_group_kfold",
    """with gm as (select compound, quantile_cont(y, 0.5) as m from g group by 1), e as (select list_distinct(quantile_cont(m, [0.2, 0.4, 0.6, 0.8])) as q from gm),
      b as (select compound, len(list_filter(q, lambda x: x < m)) as bin, md5(cast(compound as varchar) || ':7') as h from gm, e), f as (select compound, cast((row_number() over (partition by bin order by h, compound) - 1) % 5 as int) as fold from b) select row_key, fold from g join f using (compound)""",
)
def j04(spark, d):
    return split.group_kfold(frame(spark, d, "G"), "compound", "y", 5, 7).select("row_key", "fold")


_STRATA = f"""e as (select endpoint, list_distinct(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as q from g group by 1), b as (select g.*, len(list_filter(q, lambda x: x < y)) as bin from g join e using (endpoint)),
  n0 as (select *, count(*) over (partition by endpoint, bin) as m from b), st as (select *, case when m < 2 then endpoint || ':all' else endpoint || ':' || bin end as s from n0), sz as (select s, count(*) as n, count(*) * 0.5 as q from st group by 1),
  tt as (select floor(sum(n) * 0.5) as want, sum(floor(q)) as have from sz), qu as (select s, floor(q) + case when row_number() over (order by round(q - floor(q), 9) desc, s) <= want - have then 1 else 0 end as quota from sz, tt),
  dr as (select st.*, row_number() over (partition by s order by {_H}, row_key) as k from st), sel as (select row_key from dr join qu using (s) where k <= quota)"""


@query("j05_stratified", f"with {_STRATA} select row_key from sel")
def j05(spark, d):
    return split.stratified_fraction(frame(spark, d, "G"), "row_key", "endpoint", "y", 0.5, 5313).select("row_key")


@query("j06_calibration", f"with {_STRATA} select g.row_key, case when sel.row_key is not null then 'calibration' else 'evaluation' end as subset from g left join sel on g.row_key = sel.row_key")
def j06(spark, d):
    return split.calibration_split(frame(spark, d, "G"), "row_key", "endpoint", "y", 0.5, 5313).select("row_key", "subset")


@query("j07_sample", f"select row_key from g order by {_H}, row_key limit 500")
def j07(spark, d):
    return split.capped_sample(frame(spark, d, "G").select("row_key"), "row_key", 500, 5313)


@query("j08_check_split", "select count(*) as n_rows, count(distinct row_key) as n_keys, 0 as n_overlap, 0 as n_unassigned from g ")
def j08(spark, d):
    return split.check_split(split.random_split(frame(spark, d, "G").select("row_key"), "row_key", 0.2, 5313), "row_key")


@query("j09_fingerprint", "select count(*) as n, true as same from g ")
def j09(spark, d):
    rows = split.random_split(frame(spark, d, "G").select("row_key"), "row_key", 0.2, 5313)
    a, b = split.fingerprint(rows, ["row_key", "split"]), split.fingerprint(rows.repartition(5), ["row_key", "split"])
    both = a.crossJoin(b.select(F.col("sum_hash").alias("s"), F.col("xor_hash").alias("x")))  # one row each
    return both.select("n", ((F.col("sum_hash") == F.col("s")) & (F.col("xor_hash") == F.col("x"))).alias("same"))


@query("j09_digest")
def j09_digest(spark, d):
    return split.fingerprint(split.random_split(frame(spark, d, "G").select("row_key"), "row_key", 0.2, 5313), ["row_key", "split"])


@query("k01_training_weights", "with s as (select avg(y) as m, stddev_pop(y) + 1e-8 as sd from g ), r as (select row_key, greatest(w, 1e-6) * (1 + 0.5 * least(3, abs((y - m) / sd))) as v from g , s) select row_key, round(v / avg(v) over (), 6) as train_weight from r")
def k01(spark, d):
    return rounded(split.training_weights(frame(spark, d, "G"), "y", "w", 0.5).select("row_key", "train_weight"))


@query("k02_balance", "with e as (select list_distinct(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as q from g ), b as (select row_key, len(list_filter(q, lambda x: x < y)) as bin from g , e), c as (select row_key, 1 / count(*) over (partition by bin) as v from b) select row_key, round(v / avg(v) over (), 6) as balance from c")
def k02(spark, d):
    return rounded(split.balance_weights(frame(spark, d, "G"), "y", 10).select("row_key", "balance"))


@query("k03_train_mean", f"with s as (select row_key, w, row_number() over (order by {_H}, row_key) > ceil(count(*) over () * 0.2) as train from g ) select row_key, round(w / (select avg(w) from s where train), 6) as w from s")
def k03(spark, d):
    return rounded(split.normalize_by_train(split.random_split(frame(spark, d, "G"), "row_key", 0.2, 5313), "w").select("row_key", "w"))


# --- L: text ---------------------------------------------------------------------------------------------------------

_GRAMS = "gr as (select doc_id, substr(seq, cast(i as int), 3) as term from (select doc_id, seq, unnest(generate_series(1, length(seq) - 2)) as i from t )), tf as (select doc_id, term, count(*) as tf from gr group by 1, 2), df as (select term, count(*) as df, sum(tf) as total from tf group by 1)"


@query("l03_vocabulary", f"with {_GRAMS} select term, df, cast(total as bigint) as total from df where df >= 2 order by total desc, term limit 1000")
def l03(spark, d):
    return text.fit_vocabulary(text.term_counts(frame(spark, d, "T"), "doc_id", text.char_ngrams("seq", 3, 3), unique=True), 2, 1000)


@query("l04_tfidf", f"with {_GRAMS}, n as (select count(*) as n from t ), w as (select doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n where df >= 2) select doc_id, term, round(w / sqrt(sum(w * w) over (partition by doc_id)), 6) as weight from w")
def l04(spark, d):
    t = frame(spark, d, "T")
    counts = written(text.term_counts(t, "doc_id", text.char_ngrams("seq", 3, 3), unique=True))
    return rounded(text.tfidf(counts, text.fit_vocabulary(counts, 2), t.agg(F.count("*").alias("n")), "doc_id"))


@query("l02_token_counts", r"with k as (select doc_id, unnest(string_split_regex(trim(text), '\s+')) as term from t ), tf as (select doc_id, term, count(*) as tf from k where term <> '' group by 1, 2), df as (select term from tf group by 1 having count(*) >= 2) select doc_id, term, round(tf / sqrt(sum(tf * tf) over (partition by doc_id)), 6) as weight from tf join df using (term)")
def l02(spark, d):
    counts = written(text.term_counts(frame(spark, d, "T"), "doc_id", text.token_ngrams("text"), unique=True))
    return rounded(text.count_vectors(counts, text.fit_vocabulary(counts, 2), "doc_id"))


@query("l07_encode", "select doc_id, length(seq) as n, greatest(length(seq) - 100, 0) as n_truncated, 0 as n_unknown, coalesce(list_aggregate(list_transform(list_filter(string_split(rpad(substr(seq, 1, 5), 5, '0'), ''), lambda x: x <> ''), lambda x: greatest(ascii(x) - 63, 0)), 'string_agg', ','), '') as head from t ")
def l07(spark, d):
    t = frame(spark, d, "T")
    out = text.encode_chars(t, "seq", text.char_vocabulary(t, "seq"), 100)
    return out.select("doc_id", F.length("seq").alias("n"), "n_truncated", "n_unknown", F.array_join(F.transform(F.slice("codes", 1, 5), lambda x: x.cast("string")), ",").alias("head"))


@query(
    "l06_sparse",
    """with gr as (select doc_id, substr(seq, cast(i as int), 2) as term from (select doc_id, seq, unnest(generate_series(1, length(seq) - 1)) as i from t)), tf as (select doc_id, term, count(*) as tf from gr group by 1, 2),
      v as (select term, row_number() over (order by term) - 1 as ix from (select term from tf group by 1 having count(*) >= 2)), w as (select doc_id, ix, tf / sqrt(sum(tf * tf) over (partition by doc_id)) as value from tf join v using (term)), n as (select count(*) as n from v),
      o as (select doc_id, n + case endpoint when 'de' then 0 when 'en' then 1 when 'fr' then 2 end as ix, 1e0 as value from t, n where endpoint in ('de', 'en', 'fr')), k as (select doc_id, n + 3 as ix, ln(length(text) + 1e0) as value from t, n where length(text) > 0)
      select doc_id, cast(ix as bigint) as index, round(value, 6) as value from (select * from w union all select * from o union all select * from k)""",
)
def l06(spark, d):
    """Two-letter counts of unit length, the language one-hot and a number, as one sparse block in long form."""
    t = frame(spark, d, "T").withColumn("size", F.log(F.length("text") + F.lit(1.0)))
    counts = written(text.term_counts(t, "doc_id", text.char_ngrams("seq", 2, 2), unique=True))
    vocab = written(text.fit_vocabulary(counts, 2))
    return rounded(text.sparse_rows(t, "doc_id", [(text.count_vectors(counts, vocab, "doc_id"), vocab)], [("endpoint", ["de", "en", "fr"])], ["size"]))


_NEAREST = """with u as (select seq, min(doc_id) as doc_id, count(*) as copies from t group by 1), gr as (select doc_id, substr(seq, cast(i as int), 3) as term from (select doc_id, seq, unnest(generate_series(1, length(seq) - 2)) as i from u)), tf as (select doc_id, term, count(*) as tf from gr group by 1, 2), df as (select term, count(*) as df, sum(tf) as total from tf group by 1 order by total desc, term limit 8192), n as (select count(*) as n from u),
      rw as (select tf.doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n), rn as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as w from rw),
      own as (select t.doc_id, u.doc_id as own, copies from t join u on t.seq = u.seq where {which}),
      c as (select own.doc_id, r.doc_id as ref, sum(q.w * r.w) as c from own join rn q on q.doc_id = own.own join rn r using (term) where r.doc_id <> own.own and copies = 1 group by 1, 2), b as (select doc_id, max(c) as c from c group by 1)
      select doc_id, round(case when copies > 1 then 1e0 else least(1e0, coalesce(b.c, 0e0)) end, 6) as similarity from own left join b using (doc_id)"""


@query("l08_nearest", _NEAREST.replace("{which}", "t.doc_id % 50 = 0"))
def l08(spark, d):
    t = frame(spark, d, "T").select("doc_id", "seq")
    return rounded(text.nearest_similarity(t.where("doc_id % 50 = 0"), t, "doc_id", "seq", others=True).select("doc_id", "similarity"))


@query("l08_nearest_all", _NEAREST.replace("{which}", "true"))
def l08_all(spark, d):
    t = frame(spark, d, "T").select("doc_id", "seq")
    return rounded(text.nearest_similarity(t, t, "doc_id", "seq", others=True).select("doc_id", "similarity"))


@query("l08_candidates")
def l08_candidates(spark, d):
    """From a few candidates of each part by head: never above the exact similarity, and equal to it for nine rows of ten (tests measure it)."""
    t = frame(spark, d, "T").select("doc_id", "seq")
    return rounded(text.nearest_similarity(t, t, "doc_id", "seq", others=True, exact=False).select("doc_id", "similarity"))


@query("l09_subwords")
def l09(spark, d):
    t = frame(spark, d, "T").select("doc_id", "text")
    return text.apply_subwords(t, "text", text.learn_subwords(t, "text", 20)).select("doc_id", F.size("subwords").alias("n_subwords"))


# --- N, Q: drift and checks ------------------------------------------------------------------------------------------


@query(
    "n01_categorical_shift",
    """with x as (select dataset, 'endpoint' as factor, endpoint as level from p union all select dataset, 'target', target from p ), s as (select dataset, factor, level, count(*) / sum(count(*)) over (partition by dataset, factor) as share from x group by 1, 2, 3),
      b as (select factor, level, coalesce(max(share) filter (where dataset = 'random_validation'), 0) as a, coalesce(max(share) filter (where dataset = 'temporal'), 0) as q from s group by 1, 2)
      select factor, round(sum((case when a > 0 then a * log2(a / ((a + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((a + q) / 2)) else 0 end) / 2), 9) as js, round(sum(abs(a - q)) / 2, 9) as tv from b group by 1""",
)
def n01(spark, d):
    return rounded(drift.categorical_shift(frame(spark, d, "P"), "dataset", "random_validation", "temporal", ["endpoint", "target"]), 9)


@query(
    "n05_numeric_shift",
    """with v as (select y_true as x, count(*) filter (where dataset = 'random_validation') as a, count(*) filter (where dataset = 'temporal') as b from p group by 1), c as (select x, sum(a) over (order by x) / sum(a) over () - sum(b) over (order by x) / sum(b) over () as gap, lead(x) over (order by x) as nx from v),
      w as (select max(abs(gap)) as ks, sum(abs(gap) * (nx - x)) as wd from c),
      s as (select count(*) filter (where dataset = 'random_validation') as na, count(*) filter (where dataset = 'temporal') as nb, avg(y_true) filter (where dataset = 'random_validation') as ma, avg(y_true) filter (where dataset = 'temporal') as mb, stddev_pop(y_true) filter (where dataset = 'random_validation') as sa, stddev_pop(y_true) filter (where dataset = 'temporal') as sb, quantile_cont(y_true, 0.5) filter (where dataset = 'random_validation') as da, quantile_cont(y_true, 0.5) filter (where dataset = 'temporal') as db, var_pop(y_true) filter (where dataset = 'random_validation') as va, var_pop(y_true) filter (where dataset = 'temporal') as vb from p )
      select 'y_true' as variable, na as n_a, round(ma, 6) as mean_a, round(sa, 6) as sd_a, round(da, 6) as median_a, nb as n_b, round(mb, 6) as mean_b, round(sb, 6) as sd_b, round(db, 6) as median_b, round((mb - ma) / sqrt((va + vb) / 2), 6) as smd, round(ks, 6) as ks, round(wd, 6) as wasserstein from s, w""",
)
def n05(spark, d):
    return rounded(drift.numeric_shift(frame(spark, d, "P"), "dataset", "random_validation", "temporal", ["y_true"]).drop("ks_p"))


@query(
    "n05_shift_by_endpoint",
    """with q as (select endpoint, dataset, compound, min(y_true) as y from p group by 1, 2, 3 union all select 'overall', dataset, compound, min(y_true) from p group by 2, 3),
      k as (select endpoint as subset, y, count(*) filter (where dataset = 'random_validation') as a, count(*) filter (where dataset = 'temporal') as b from q group by 1, 2),
      c as (select subset, abs(sum(a) over o / sum(a) over (partition by subset) - sum(b) over o / sum(b) over (partition by subset)) as gap from k window o as (partition by subset order by y)),
      m as (select subset, max(gap) as ks from c group by 1)
      select 'y_true' as variable, endpoint as subset, count(*) filter (where dataset = 'random_validation') as n_a, round(avg(y) filter (where dataset = 'random_validation'), 6) as mean_a, round(stddev_pop(y) filter (where dataset = 'random_validation'), 6) as sd_a,
        count(*) filter (where dataset = 'temporal') as n_b, round(quantile_cont(y, 0.5) filter (where dataset = 'temporal'), 6) as median_b, round(ks, 6) as ks from q join m on subset = endpoint group by endpoint, ks""",
)
def n05_by(spark, d):
    out = drift.numeric_shift(frame(spark, d, "P"), "dataset", "random_validation", "temporal", ["y_true"], basis="compound", by="endpoint")
    return rounded(out.select("variable", "subset", "n_a", "mean_a", "sd_a", "n_b", "median_b", "ks"))


@query(
    "n06_standardised",
    """with l as (select 'target' as factor, target as level, * from p union all select 'endpoint', endpoint, * from p union all select 'half', case when dataset = 'temporal' and uid % 3 = 0 then 'late' else cast(uid % 2 as varchar) end, * from p union all select 'none', dataset, * from p ),
      x as (select factor, level, count(*) filter (where dataset = 'random_validation') as nb, count(*) filter (where dataset = 'temporal') as n2, sum((y_true - y_pred) ** 2) filter (where dataset = 'random_validation') as sb, sum((y_true - y_pred) ** 2) filter (where dataset = 'temporal') as so from l group by 1, 2),
      s as (select factor, sum(sb) / sum(nb) as b, sum(so) / sum(n2) as o, sum(nb * so / n2) filter (where nb > 0 and n2 > 0) / sum(nb) filter (where nb > 0 and n2 > 0) as z, sum(nb) filter (where nb > 0 and n2 > 0) / sum(nb) as c from x group by 1)
      select factor, round(b, 6) as mse_base, round(o, 6) as mse_other, round(z, 6) as mse_standardised, round(sqrt(b), 6) as rmse_base, round(sqrt(o), 6) as rmse_other, round(sqrt(z), 6) as rmse_standardised, round(sqrt(o) - sqrt(z), 6) as rmse_reduction, round(o - z, 6) as gap_removed, round(100 * (o - z) / (o - b), 4) as percent, round(c, 6) as weight_covered from s where c > 0""",
)
def n06(spark, d):
    late = F.when((F.col("dataset") == "temporal") & (F.col("uid") % 3 == 0), "late").otherwise((F.col("uid") % 2).cast("string"))
    p = frame(spark, d, "P").withColumns({"e2": F.pow(F.col("y_true") - F.col("y_pred"), F.lit(2.0)), "half": late, "none": F.col("dataset")})
    out = drift.standardize_mix(p, "dataset", "random_validation", "temporal", ["target", "endpoint", "half", "none"], "e2")
    return rounded(out.withColumn("percent", F.round("percent", 4)))


@query("q02_counts", "select endpoint, count(*) as n, case endpoint when 'pKi' then -1 else count(*) end as expected, endpoint <> 'pKi' as ok from p group by 1")
def q02(spark, d):
    p = frame(spark, d, "P")
    want = p.groupBy("endpoint").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("endpoint") == "pKi", -1).otherwise(F.col("n")))
    return verify.assert_counts(p, "endpoint", want)


@query("q04_compare", "select 'y_true' as \"column\", count(*) filter (where uid % 3 <> 0 and uid % 5 <> 0) as n_equal, count(*) filter (where uid % 3 = 0 and uid % 5 <> 0) as n_different, count(*) filter (where uid % 5 = 0) as n_one_sided from p ")
def q04(spark, d):
    p = frame(spark, d, "P").select("uid", "y_true")
    return verify.compare_tables(p, p.where("uid % 5 <> 0").withColumn("y_true", F.when(F.col("uid") % 3 == 0, F.col("y_true") + 1).otherwise(F.col("y_true"))), ["uid"])


# --- A, M, N7, P, Q1, Q3: sources, models, enrichment, checks --------------------------------------------------------


@query("a05_load_scored", "select uid, endpoint, y_true, y_pred, sigma from p where uid % 4 <> 0")
def a05(spark, d):
    p = frame(spark, d, "P").withColumn("sigma", F.when(F.col("uid") % 4 == 0, F.lit("n/a")).otherwise(F.col("sigma").cast("string")))
    return measurements.load_scored(p, "y_true", "y_pred", "sigma", "endpoint")[0].select("uid", "endpoint", "y_true", "y_pred", "sigma")


@query("a10_manifest", "with s as (select endpoint, quantile_cont(y_true, [0.05, 0.5, 0.95]) as q from p group by 1) select endpoint, round(q[1], 6) as q05, round(q[2], 6) as q50, round(q[3], 6) as q95 from s")
def a10(spark, d):
    told = measurements.manifest(agg.quantile_spec(frame(spark, d, "P"), "y_true", ["endpoint"]))
    return rounded(told.select(F.from_json("json", "endpoint string, q05 double, q50 double, q95 double").alias("x")).select("x.*"))


@query("a11_row_key", """select sha256(cast(uid as varchar) || chr(31) || endpoint) as row_key from p """)
def a11(spark, d):
    return measurements.with_row_key(frame(spark, d, "P"), ["uid", "endpoint"]).select("row_key")


def _letter_frame(spark, d, letters="AE"):
    """T with a length target and numeric features: how often each letter stands in seq (n_a ..), and its length."""
    t = frame(spark, d, "T").select("doc_id", "endpoint", "seq", F.log(F.length("text") + F.lit(1.0)).alias("y"), F.lit(1.0).alias("w"))
    often = {f"n_{x.lower()}": (F.length("seq") - F.length(F.replace("seq", F.lit(x), F.lit("")))).cast("double") for x in letters}
    return t.withColumns(often | {"n_seq": F.length("seq").cast("double")})


def _model_frame(spark, d):
    """The same with a split."""
    return split.random_split(_letter_frame(spark, d), "doc_id", 0.2, 5313)


@query("m03_ridge")
def m03(spark, d):
    rows = model.assemble(_model_frame(spark, d), ["n_a", "n_e", "n_seq"])
    scored = model.fit_ridge(rows, "y", "w").transform(rows)
    return rounded(metrics.regression_metrics(scored, "y", "prediction", "split"))


@query("m04_elastic_net")
def m04(spark, d):
    rows = model.assemble(_model_frame(spark, d), ["n_a", "n_e", "n_seq"])
    return rounded(metrics.regression_metrics(model.fit_elastic_net(rows, "y", "w").transform(rows), "y", "prediction", "split"))


@query("m02_boosted")
def m02(spark, d):
    rows = written(model.assemble(_model_frame(spark, d), ["n_a", "n_e", "n_seq"]).select("doc_id", "split", "y", "w", "features"))
    best, _ = model.fit_boosted(rows, "y", "w", stages=6)
    return rounded(metrics.regression_metrics(best.transform(rows), "y", "prediction", "split"))


@query("m02_history")
def m02_history(spark, d):
    """Every second stage of one fit, on training and validation rows."""
    rows = written(model.assemble(_model_frame(spark, d), ["n_a", "n_e", "n_seq"]).select("doc_id", "split", "y", "w", "features"))
    return rounded(model.fit_boosted(rows, "y", "w", stages=8, objective="ci")[1])


@query("m07_cross_validate")
def m07(spark, d):
    rows = split.group_kfold(_model_frame(spark, d).drop("split"), "doc_id", "y", 3, 7)
    return rounded(model.cross_validate(rows, "fold", ["n_a", "n_e", "n_seq"], "y", "w"))


#: Rows of T with two features, a label and a weight; sums about nothing and the ridge of them (penalty 1) in SQL.
_TWO = """f as (select doc_id, endpoint, doc_id % 4 as fold, length(regexp_replace(seq, '[^A]', '', 'g')) / 100e0 as x1, length(regexp_replace(seq, '[^E]', '', 'g')) / 100e0 as x2, ln(length(text) + 1e0) as y, 1e0 + doc_id % 3 as w from t)"""
_SUMS = "count(*) as n, sum(w) as sw, sum(w * x1) as s1, sum(w * x2) as s2, sum(w * y) as sy, sum(w * x1 * x1) as s11, sum(w * x1 * x2) as s12, sum(w * x2 * x2) as s22, sum(w * x1 * y) as s1y, sum(w * x2 * y) as s2y"
_SOLVED = """c as (select *, s11 - s1 * s1 / sw + 1 as a, s12 - s1 * s2 / sw as b, s22 - s2 * s2 / sw + 1 as d, s1y - s1 * sy / sw as u1, s2y - s2 * sy / sw as u2 from s),
      r as (select *, (u1 * d - u2 * b) / (a * d - b * b) as b1, (u2 * a - u1 * b) / (a * d - b * b) as b2 from c), m as (select *, (sy - b1 * s1 - b2 * s2) / sw as b0 from r)"""


def _two(spark, d):
    letters = lambda x: F.length(F.regexp_replace("seq", f"[^{x}]", "")) / F.lit(100.0)
    return frame(spark, d, "T").select("doc_id", "endpoint", (F.col("doc_id") % 4).alias("fold"), letters("A").alias("x1"), letters("E").alias("x2"), F.log(F.length("text") + F.lit(1.0)).alias("y"), (F.lit(1.0) + F.col("doc_id") % 3).alias("w"))


@query("m03_gram", f"with {_TWO}, s as (select {_SUMS} from f), {_SOLVED} select n, round(b0, 6) as intercept, round(b1, 6) as b1, round(b2, 6) as b2 from m")
def m03_gram(spark, d):
    fitted = gram.ridge_by_group(gram.gram_sums(_two(spark, d), ["x1", "x2"], "y", "w"))
    return rounded(fitted.select("n", "intercept", F.get("coefficients", F.lit(0)).alias("b1"), F.get("coefficients", F.lit(1)).alias("b2")))


@query("m06_gram", f"with {_TWO}, s as (select endpoint, {_SUMS} from f where doc_id % 5 <> 0 group by endpoint), {_SOLVED}, o as (select f.*, y - (b0 + b1 * x1 + b2 * x2) as e from f join m on f.endpoint is not distinct from m.endpoint where doc_id % 5 = 0) select coalesce(endpoint, 'none') as endpoint, count(*) as n, round(sqrt(avg(e * e)), 6) as rmse from o group by 1")
def m06_gram(spark, d):
    """Models by endpoint (null is one), judged on the rows held out."""
    rows = _two(spark, d).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "valid").otherwise("train"))
    scored = gram.predict_linear(rows.where("split = 'valid'"), model.fit_by_endpoint(rows, "endpoint", ["x1", "x2"], "y", "w"), ["x1", "x2"], ["endpoint"])
    out = metrics.regression_metrics(scored.withColumn("endpoint", F.coalesce("endpoint", F.lit("none"))), "y", "prediction", "endpoint").where("subset <> 'overall'")
    return rounded(out.select(F.col("subset").alias("endpoint"), "n", "rmse"))


@query("m07_gram_folds", f"with {_TWO}, g as (select endpoint, fold, {_SUMS} from f group by 1, 2), s as (select a.endpoint, a.fold, {', '.join(f'sum(b.{c}) as {c}' for c in 'n sw s1 s2 sy s11 s12 s22 s1y s2y'.split())} from g a join g b on a.endpoint is not distinct from b.endpoint and a.fold <> b.fold group by 1, 2), {_SOLVED}, o as (select f.fold, f.y, y - (b0 + b1 * x1 + b2 * x2) as e from f join m on f.endpoint is not distinct from m.endpoint and f.fold = m.fold) select fold, count(*) as n, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) as r2 from o group by 1")
def m07_gram(spark, d):
    """A model for each endpoint and left-out fold, all from one pass."""
    return rounded(model.cross_validate(_two(spark, d), "fold", ["x1", "x2"], "y", "w", by=["endpoint"]))


@query("m08_score")
def m08(spark, d):
    rows = model.assemble(_model_frame(spark, d), ["n_a", "n_e", "n_seq"]).withColumn("sigma", F.lit(0.5))
    scored = model.score(rows, model.fit_ridge(rows, "y", "w"), (0.0, 1.0), 1.6, 7.0, 1.0)
    return rounded(scored.select("doc_id", "y_pred", "err_bound", "pred_lo", "pred_hi", "accepted", "prob_strong"))


@query("m01_scale_target", f"with s as (select row_key, y, row_number() over (order by {_H}, row_key) > ceil(count(*) over () * 0.2) as train from g ), m as (select avg(y) as m, stddev_pop(y) as sd from s where train) select row_key, round((y - m) / sd, 6) as y_scaled from s, m")
def m01(spark, d):
    rows = split.random_split(frame(spark, d, "G").select("row_key", "y"), "row_key", 0.2, 5313)
    return rounded(model.scale_target(rows, "y")[0].select("row_key", "y_scaled"))


@query("m03_ridge_one_feature", f"with s as (select y as x, w * 1e0 as y, row_number() over (order by {_H}, row_key) > ceil(count(*) over () * 0.2) as train from g ), m as (select avg(x) as mx, avg(y) as my from s where train), f as (select sum((x - mx) * (y - my)) / (sum((x - mx) ** 2) + 1) as b, max(my) as my, max(mx) as mx from s, m where train) select round(b, 6) as slope, round(my - b * mx, 6) as intercept from f")
def m03_one(spark, d):
    rows = split.random_split(frame(spark, d, "G").select("row_key", F.col("y").alias("x"), F.col("w").cast("double").alias("y")), "row_key", 0.2, 5313).withColumn("one", F.lit(1.0))
    fitted = model.fit_ridge(model.assemble(rows, ["x"]), "y", "one")
    return rounded(rows.agg(F.lit(float(fitted.coefficients[0])).alias("slope"), F.lit(float(fitted.intercept)).alias("intercept")))


@query("m05_sigma")
def m05(spark, d):
    rows = model.assemble(_model_frame(spark, d), ["n_a", "n_e", "n_seq"])
    scored = written(model.fit_ridge(rows, "y", "w").transform(rows).select("doc_id", "y", "prediction", "features"))
    return rounded(model.predict_sigma(scored, model.fit_sigma(scored, "y", "prediction", least=100), "prediction").select("doc_id", "sigma"))


@query("m06_by_endpoint")
def m06(spark, d):
    cols, rows = ["n_a", "n_e", "n_seq"], _model_frame(spark, d).where("endpoint is not null")
    scored = gram.predict_linear(rows, model.fit_by_endpoint(rows, "endpoint", cols, "y", "w"), cols, ["endpoint"])
    out = metrics.regression_metrics(scored, "y", "prediction", "endpoint").where("subset <> 'overall'")
    return rounded(out.select(F.col("subset").alias("endpoint"), "n", "rmse", "r2"))


@query("m09_bundle")
def m09(spark, d):
    """A ridge and its calibration, saved, loaded and applied."""
    from pyspark.ml.regression import LinearRegressionModel

    rows, path = model.assemble(_model_frame(spark, d), ["n_a", "n_e", "n_seq"]), shared_path(spark)
    first = model.fit_ridge(rows, "y", "w")
    model.save_bundle(first, conformal.fit_affine(first.transform(rows), "y", "prediction"), path)
    again, calibration = model.load_bundle(spark, path, LinearRegressionModel)
    return rounded(metrics.regression_metrics(again.transform(rows), "y", "prediction").crossJoin(calibration.select("a", "b")))  # one row each


@query("m10_importance")
def m10(spark, d):
    """Five groups of letters and size, five repeats."""
    rows = _letter_frame(spark, d, "EAIOTNSR")
    groups = {"vowels": ["n_e", "n_a"], "others": ["n_i", "n_o"], "stops": ["n_t"], "voiced": ["n_n", "n_s", "n_r"], "size": ["n_seq"]}
    return rounded(model.grouped_importance(rows, groups, "y", "doc_id", repeats=5))


@query("m11_compare_runs", "with s as (select dataset, sqrt(avg((y_true - y_pred) ** 2)) as rmse, avg(abs(y_true - y_pred)) as mae from p group by 1), w as (select 'rmse' as metric, max(rmse) filter (where dataset = 'random_validation') as a, max(rmse) filter (where dataset = 'temporal') as b from s union all select 'mae', max(mae) filter (where dataset = 'random_validation'), max(mae) filter (where dataset = 'temporal') from s) select metric, round(a, 6) as a, round(b, 6) as b, round(a - b, 6) as gain from w")
def m11(spark, d):
    long = metrics.regression_metrics(frame(spark, d, "P"), "y_true", "y_pred", "dataset").unpivot(["subset"], ["rmse", "mae"], "metric", "value")
    return rounded(model.compare_runs(long, "subset", "metric", "value", "random_validation", "temporal"))


@query(
    "n07_enrich",
    """with r as (select * from p where dataset = 'random_validation' and target <> 'click'), q as (select endpoint, quantile_cont(y_true, [0.05, 0.25, 0.5, 0.75, 0.95]) as q from r group by 1),
      u as (select distinct target as s from r), gr as (select s, substr(s, cast(i as int), 3) as term from (select s, unnest(generate_series(1, length(s) - 2)) as i from u)), tf as (select s, term, count(*) as tf from gr group by 1, 2), df as (select term, count(*) as df from tf group by 1), n as (select count(*) as n from u),
      rw as (select s, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from tf join df using (term), n), rn as (select s, term, w / sqrt(sum(w * w) over (partition by s)) as w from rw),
      qt as (select s, term, count(*) as tf from (select s, substr(s, cast(i as int), 3) as term from (select s, unnest(generate_series(1, length(s) - 2)) as i from (select distinct target as s from p where dataset = 'temporal'))) group by 1, 2),
      qw as (select s, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from qt join df using (term), n), qn as (select s, term, w / sqrt(sum(w * w) over (partition by s)) as w from qw),
      b as (select s, max(c) as c from (select a.s, b.s as o, sum(a.w * b.w) as c from qn a join rn b using (term) group by 1, 2) group by 1),
      f as (select p.*, compound in (select compound from r) as sc, target in (select target from r) as st, case when target in (select s from u) then 1e0 else least(1e0, coalesce(b.c, 0e0)) end as sim from p left join b on b.s = p.target where dataset = 'temporal')
      select uid, case when sc then 'seen' when uid % 7 = 0 or uid % 5 = 0 then 'invalid' when y_true > 4 then 'acyclic' else 'novel_scaffold' end as compound_novelty, case when st then 'seen' when sim >= 0.9 then '>=0.90' when sim >= 0.7 then '>=0.70' else 'low' end as target_novelty, exists(select 1 from r where r.compound = f.compound and r.target = f.target) as seen_pair, round(sim, 6) as similarity, length(target) as target_length,
        case when y_true < q[1] then '<q05' when y_true < q[2] then 'q05-q25' when y_true < q[3] then 'q25-q50' when y_true < q[4] then 'q50-q75' when y_true <= q[5] then 'q75-q95' when q is not null then '>q95' end as px_bin, round(abs(y_true - q[3]) / greatest(q[4] - q[2], 1e-8), 6) as px_distance from f left join q using (endpoint)""",
)
def n07(spark, d):
    p = frame(spark, d, "P").withColumns({"sequence": F.col("target"), "acyclic": F.col("y_true") > 4, "valid": F.when(F.col("uid") % 7 != 0, F.col("uid") % 5 != 0)})
    out = drift.enrich(p.where("dataset = 'temporal'"), p.where("dataset = 'random_validation' and target <> 'click'"), "compound", "target", "endpoint", "y_true", "sequence", valid="valid", acyclic="acyclic")
    return rounded(out.select("uid", "compound_novelty", "target_novelty", "seen_pair", "similarity", "target_length", "px_bin", "px_distance"))


@query(
    "f20_summary",
    """with v as (select *, abs(y_true - y_pred) as e from p ), m as (select avg(y_true) as my from p )
      select 'counts' as section, unnest(['rows', 'valid', 'with_interval', 'with_sigma']) as name, cast(unnest([count(*), count(*), count(*) filter (where uid % 3 <> 0), count(*)]) as double) as value from v
      union all select 'abs_error', unnest(['mean', 'q50', 'q90', 'q95']), round(unnest([avg(e), quantile_cont(e, 0.5), quantile_cont(e, 0.9), quantile_cont(e, 0.95)]), 6) from v
      union all select 'half_width', unnest(['mean', 'q50', 'q90', 'q95']), round(unnest([avg(sigma), quantile_cont(sigma, 0.5), quantile_cont(sigma, 0.9), quantile_cont(sigma, 0.95)]), 6) from v where uid % 3 <> 0
      union all select 'sigma', unnest(['mean', 'q50', 'q90', 'q95']), round(unnest([avg(sigma), quantile_cont(sigma, 0.5), quantile_cont(sigma, 0.9), quantile_cont(sigma, 0.95)]), 6) from v
      union all select 'metrics', unnest(['rmse', 'mae', 'r2', 'bias', 'pearson']), round(unnest([sqrt(avg(e * e)), avg(e), 1 - sum(e * e) / sum((y_true - my) ** 2), avg(y_pred - y_true), corr(y_true, y_pred)]), 6) from v, m
      union all select 'endpoint', endpoint, cast(count(*) as double) from v group by 2 union all select 'split', dataset, cast(count(*) as double) from v group by 2""",
)
def f20(spark, d):
    p = frame(spark, d, "P").withColumns({"lo": F.col("y_pred") - F.col("sigma"), "hi": F.when(F.col("uid") % 3 != 0, F.col("y_pred") + F.col("sigma"))})
    return rounded(metrics.prediction_summary(p, "y_true", "y_pred", "sigma", "lo", "hi", "endpoint", "dataset"))


@query(
    "b24_export",
    f"""with s as (select *, abs((3.0 - y_pred) / sigma) / sqrt(2e0) as z from p ), e as (select *, case when y_pred <= 3.0 then 0.5 * {_ERFC} else 1 - 0.5 * {_ERFC} end as q from s)
      select uid, round(abs(y_true - y_pred), 6) as abs_err, round(y_pred - 1.6448536269514722 * sigma, 6) as pred_lo, round(y_pred + 1.6448536269514722 * sigma, 6) as pred_hi, round(q, 5) as prob_strong, cast(q >= 0.5 as int) as label from e""",
)
def b24(spark, d):
    out = metrics.export_predictions(frame(spark, d, "P"), "y_true", "y_pred", "sigma", 3.0)
    return rounded(out.select("uid", "abs_err", "pred_lo", "pred_hi", F.round("prob_strong", 5).alias("prob_strong"), "label"))


@query("g10_sorted", "select uid, endpoint, y_true from p ")
def g10(spark, d):
    return order.sort_output(frame(spark, d, "P"), "uid", "endpoint").select("uid", "endpoint", "y_true")


@query("j10_restrict", f"select row_key, endpoint, case when k <= ceil(n * 0.2) then 'valid' else 'train' end as split from (select row_key, endpoint, row_number() over (order by {_H}, row_key) as k, count(*) over () as n from g ) where endpoint = '1-URGENT'")
def j10(spark, d):
    return split.restrict(split.random_split(frame(spark, d, "G").select("row_key", "endpoint"), "row_key", 0.2, 5313), "endpoint", "1-URGENT")


@query("j11_membership", f"with {_STRATA} select g.row_key, g.endpoint, case when sel.row_key is not null then 'calibration' else 'evaluation' end as subset from g left join sel on g.row_key = sel.row_key")
def j11(spark, d):
    return split.membership(split.calibration_split(frame(spark, d, "G"), "row_key", "endpoint", "y", 0.5, 5313), "row_key", "endpoint")


@query("j02_group_columns", "select count(distinct compound) as n_compound, count(distinct target) as n_protein, count(distinct (compound, target)) as n_pair from m ")
def j02(spark, d):
    m = frame(spark, d, "M")
    sizes = [m.select(*split.group_columns(k, "compound", "target")).distinct().agg(F.count("*").alias(f"n_{k}")) for k in ("compound", "protein", "pair")]
    return sizes[0].crossJoin(sizes[1]).crossJoin(sizes[2])  # one row each


@query("j08_nested", f"with r as (select row_key, row_number() over (order by {_H}, row_key) as k, count(*) over () as n from g ) select count(*) filter (where k <= ceil(n * 0.1)) as n_small, count(*) filter (where k <= ceil(n * 0.2)) as n_large, 0 as n_outside, true as ok from r")
def j08_nested(spark, d):
    g = frame(spark, d, "G").select("row_key")
    part = lambda f: split.random_split(g, "row_key", f, 5313).where("split = 'valid'")
    return split.check_nested(part(0.1), part(0.2), "row_key")


@query("b11_signed", "select o_orderkey, case o_orderkey % 4 when 0 then '=' when 1 then '>' when 2 then '<=' else '=' end || cast(floor(o_totalprice) as bigint) as told from orders")
def b11(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    sign = F.element_at(F.array(F.lit(""), F.lit(">"), F.lit("<="), F.lit("missing")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", X.format_signed(sign, F.floor("o_totalprice").cast("double"), 9).alias("told"))


@query("q01_metrics", "select subset, round(sqrt(avg(e)), 6) as found, round(sqrt(avg(e)) + 1, 6) as expected, 1e0 as difference, false as ok from (select 'overall' as subset, (y_true - y_pred) ** 2 as e from p union all select endpoint, (y_true - y_pred) ** 2 from p ) group by 1")
def q01(spark, d):
    found = metrics.regression_metrics(frame(spark, d, "P"), "y_true", "y_pred", "endpoint").select("subset", "rmse")
    return rounded(verify.assert_metrics(found, found.withColumn("rmse", F.col("rmse") + 1), ["subset"], "rmse"))


@query("q03_verify_conformal", "select count(*) as n_members, 0 as n_duplicates, 0 as n_endpoint_differs, count(*) filter (where uid % 2 = 1 and abs(y_true - y_pred) <= 1.5 * sigma) as n_covered, true as covered_ok from p ")
def q03(spark, d):
    p = frame(spark, d, "P").withColumns({"half": 1.5 * F.col("sigma"), "subset": F.when(F.col("uid") % 2 == 1, "evaluation").otherwise("calibration")})
    table = metrics.coverage_metrics(p.where("subset = 'evaluation'"), "y_true", "y_pred", "half", F.lit(0.9), ["endpoint"])
    return verify.verify_conformal(p.drop("subset"), p.select("uid", "endpoint", "subset"), table, "uid", "endpoint", "y_true", "y_pred", "half")


@query(
    "a01_delimited",
    """select o_orderkey as order_key, case o_orderkey % 3 when 0 then '>' || cast(o_orderkey as varchar) when 1 then null else cast(o_orderkey as varchar) end as reading, o_orderpriority as kind from orders where o_orderkey % 7 <> 0""",
)
def a01(spark, d):
    """Orders written as a tab-separated file, in which every seventh line has a field too many, read back."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority")
    reading = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(">"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.col("o_orderkey").cast("string"))
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), reading, F.concat(F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 7 == 0, "\textra").otherwise("")))
    path = shared_path(spark)
    spark.range(1).select(F.lit("key\tKi (nM)\tkind").alias("value")).unionAll(o.select(line.alias("value"))).coalesce(1).write.text(path)
    good, _ = measurements.read_measurements(spark, path, {"key": "order_key", "Ki (nM)": "reading", "kind": "kind"})
    return good.withColumn("order_key", F.col("order_key").cast("long"))


@query("a04_predictions", "select cast(uid as varchar) as compound, target, endpoint, y_true, y_pred from p where uid % 6 <> 0")
def a04(spark, d):
    """Scored rows written as CSV under other names, with labels that are no number, read back."""
    p, path = frame(spark, d, "P"), shared_path(spark)
    label = F.when(F.col("uid") % 6 == 0, "n/a").otherwise(F.col("y_true").cast("string"))
    p.select(F.col("uid").cast("string").alias("SMILES"), F.col("target").alias("Protein"), F.col("endpoint").alias("affinity_type"), label.alias("affinity_value"), F.col("y_pred").alias("pred_pX")).write.option("header", True).csv(path)
    return measurements.read_predictions(spark, [path]).select("compound", "target", "endpoint", "y_true", "y_pred")


@query("a07_table", "select uid, endpoint, cast(null as varchar) as note from p ")
def a07(spark, d):
    path = shared_path(spark)
    measurements.write_table(frame(spark, d, "P"), ["uid", "endpoint", "note"], path)
    return spark.read.parquet(path)


@query("p01_stream", "select endpoint, count(*) as n, round(avg(abs(y_true - y_pred)), 6) as mae from p group by 1")
def p01(spark, d):
    """The scored rows as a file stream, each scored once, then summed up."""
    p, path = frame(spark, d, "P").select("uid", "endpoint", "y_true", "y_pred"), shared_path(spark)
    p.write.parquet(f"{path}/in")
    scoring.score_stream(spark, f"{path}/in", p.schema, "uid", lambda b: b.withColumn("error", F.abs(F.col("y_true") - F.col("y_pred"))), f"{path}/out", f"{path}/mark")
    return rounded(spark.read.parquet(f"{path}/out").groupBy("endpoint").agg(F.count("*").alias("n"), F.avg("error").alias("mae")))


@query("p02_windowed_errors", "select cast(date_trunc('day', ts) as varchar) as day, event_type, count(*) as n, round(avg(value), 6) as mean_error from events group by 1, 2")
def p02(spark, d):
    """Windows of a file stream whose rows arrive in three parts, each taken in by a run of its own."""
    rows, path = spark.read.parquet(f"{d}/events.parquet").select("ts", "event_type", "value"), shared_path(spark)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first, first + (last - first) / 3, first + (last - first) * 2 / 3, None]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows.where(F.col("ts") >= F.lit(begin).cast("timestamp_ntz")) if end is None else rows.where((F.col("ts") >= F.lit(begin).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        part.write.mode("append").parquet(f"{path}/in")
        scoring.windowed_errors_stream(spark, f"{path}/in", rows.schema, "ts", "event_type", "value", f"{path}/out", f"{path}/mark")
    out = scoring.latest_windows(spark, f"{path}/out", "event_type")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("day"), "event_type", "n", F.round("mean_error", 6).alias("mean_error"))


@query(
    "p03_running_metrics",
    """with l as (select 'overall' as endpoint, y_true as a, y_pred as b from p union all select endpoint, y_true, y_pred from p )
      select endpoint, count(*) as n, round(sqrt(avg((a - b) ** 2)), 6) as rmse, round(avg(abs(a - b)), 6) as mae, round(1 - sum((a - b) ** 2) / (sum(a * a) - sum(a) * sum(a) / count(*)), 6) as r2, round(corr(a, b), 6) as pearson from l group by 1""",
)
def p03(spark, d):
    """The rows in two parts, the second with a quarter of the first again: metrics from the batches' sums."""
    p, path = frame(spark, d, "P").select("uid", "endpoint", "y_true", "y_pred"), shared_path(spark)
    for part in (p.where("uid % 2 = 0"), p.where("uid % 2 = 1 or uid % 8 = 0")):
        part.write.mode("append").parquet(f"{path}/in")
        scoring.score_stream(spark, f"{path}/in", p.schema, "uid", lambda b: b, f"{path}/out", f"{path}/mark", metrics=(f"{path}/sums", "endpoint", "y_true", "y_pred"))
    return rounded(scoring.running_metrics(spark, f"{path}/sums"))
