"""Input frames that the registered queries derive from the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FRAMES = {
    "M": """select l_partkey as compound, l_suppkey % 5 as target, l_linenumber as rep,
      case when l_returnflag='A' then concat(case l_linenumber % 6 when 0 then '>=' when 1 then '' when 2 then '<' when 3 then '~' when 4 then '>' else '<=' end, cast(l_extendedprice as $STR)) end as ic50_txt,
      case when l_returnflag='N' then concat(case l_linenumber % 3 when 0 then '>' when 1 then '' else '<' end, cast(l_extendedprice as $STR)) end as ki_txt,
      case when l_returnflag='R' and l_linenumber % 7 <> 0 then cast(l_extendedprice as $STR) end as kd_txt,
      round(5 + l_discount * 40, 2) as ph, round(30 + l_tax * 250, 2) as temp_c from {lineitem}""",
    "P": """select event_id as uid,
      case event_type when 'view' then 'pIC50' when 'click' then 'pIC50' when 'signup' then 'pIC50' when 'purchase' then 'pKi' else 'pKd' end as endpoint,
      round(ln(1+value),4) as y_true, round(ln(1+value)*0.8e0 + ((event_id*7919)%1000-500)/1000e0, 4) as y_pred,
      0.05e0 + ((event_id*104729)%997)/1994e0 as sigma,
      case when ts < timestamp '2024-01-20 00:00:00' then 'random_validation' else 'temporal' end as dataset,
      user_id as compound, event_type as target from {events}""",
    "G": """select o_orderkey as row_key, o_custkey as compound, o_orderpriority as endpoint, o_orderstatus as target,
      round(log10(o_totalprice),4) as y, 0.5e0 + (o_orderkey % 7)/4e0 as w from {orders}""",
    "T": """select doc_id, lang as endpoint, source, upper(regexp_replace(text,'[^A-Za-z]',''$G)) as seq, text from {documents}""",
    "C": """select p.p_partkey as compound, p.p_brand as accession, concat(p.p_brand,'|',p.p_type,'| |nan') as tokens, s.s_suppkey as xid, n.n_name, r.r_name
      from {part} p join {supplier} s on p.p_partkey % 100 = s.s_suppkey % 100 join {nation} n on s.s_nationkey=n.n_nationkey join {region} r on n.n_regionkey=r.r_regionkey""",
}


def duck(sql: str) -> str:
    """A frame as DuckDB SQL over the registered views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql.replace("$STR", "varchar(30)").replace("$G", ",'g'"))


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FRAMES[name].replace("$STR", "string").replace("$G", "")
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))})
