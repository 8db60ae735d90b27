"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree by weight; a child can take as much as all
leaves below it hold in `max_epochs` passes. What a short child leaves goes to its siblings by weight, and only what
all siblings can't take leaves their parent short in turn. Shares are whole tokens, rounded down.

A leaf with an allotment takes whole epochs while they fit, and of the epoch after those the documents in the order of
md5(seed|epoch|doc_id), then doc_id, while their running sum of tokens stays within the rest. The running sum is
taken over the first BUCKET hex digits of the order first, so only the rows of one bucket per leaf are sorted, and no
leaf is gathered in one task, however many rows it has.

Tokens are words `[^\\x20\\x09-\\x0D]+`. Null language, source or id count as ''; a null text has no tokens. Documents
without tokens come along with the prefix they stand in. Rows with equal ids and tokens are told apart by nothing and
may stand for one another. An empty table gives an empty result. Weights are positive whole numbers; tokens times the
sum of siblings' weights must fit in 64 bits, else an overflow error is raised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import written

BUCKET = 3
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    domain: dict[str, int] = field(default_factory=lambda: {"0": 3, "1": 2})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2})
    source: dict[str, int] = field(default_factory=lambda: {"src0": 2})
    other: int = 1
    #: The budget as a percentage of all tokens.
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 42


def default_domain() -> Column:
    """Sources whose names end alike are one domain here; tables with a domain column pass their own."""
    return F.right(F.coalesce(F.col("source"), F.lit("")), F.lit(1))


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(mix.other)
    for name, w in sorted(getattr(mix, level).items()):
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def poured(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent columns, name, cap, w, budget of the parent) with `share`: budget by weight, none over its cap."""
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap") / F.col("w"), F.col(name))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    out = nodes.withColumn("_c", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("w").over(after))
    out = out.withColumn("_full", F.col("cap") * F.col("_w") <= (F.col("budget") - F.col("_c")) * F.col("w"))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(by), F.lit(0))
    weights = F.sum(F.when(~F.col("_full"), F.col("w"))).over(by)
    out = out.withColumn("_rest", rest).withColumn("_weights", weights)
    return out.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("(_rest * w) div _weights"))).drop("_c", "_w", "_full", "_rest", "_weights")


def allotments(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `allotment`."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0L) * {mix.budget_percent} div 100").alias("budget"))
    above, parent = total, []
    for level in LEVELS:
        nodes = leaves.groupBy(*parent, level).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, mix))
        nodes = nodes.join(above, parent) if parent else nodes.crossJoin(F.broadcast(above))  # above: one row
        parent_now, parent = parent, [*parent, level]
        above = poured(nodes, parent_now, level).select(*parent, F.col("share").alias("budget"))
    return leaves.drop("cap").join(above.withColumnRenamed("budget", "allotment"), list(LEVELS))


def mixed(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """(doc_id, domain, lang, source, n_tokens, copies): each document taken at least once, and how often."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (default_domain() if domain is None else domain).alias("domain"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = written(rows, "tokens")
    leaves = written(allotments(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), mix), "leaves")
    leaves = leaves.withColumn("full", F.when(F.col("tokens") > 0, F.expr("allotment div tokens")).otherwise(0)).withColumn("rest", F.expr("allotment - full * tokens"))
    order = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), (F.col("full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.join(leaves.drop("tokens", "allotment"), list(LEVELS)).withColumn("_order", order).withColumn("_bucket", F.substring("_order", 1, BUCKET))
    rows = written(rows, "ordered")
    sums = rows.groupBy(*LEVELS, "_bucket").agg(F.sum("n_tokens").alias("_sum"), F.first("rest").alias("rest"))
    upto = F.sum("_sum").over(W.partitionBy(*LEVELS).orderBy("_bucket"))
    cut = sums.withColumn("_upto", upto).filter("_upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("_bucket", "_upto", "_sum")).alias("cut"))
    cut = written(cut.select(*LEVELS, F.col("cut._bucket").alias("_at"), F.expr("cut._upto - cut._sum").alias("_base")), "cuts")
    rows = rows.join(cut, list(LEVELS), "left")
    sure = rows.filter("_at is null or _bucket <> _at").withColumn("_more", F.expr("if(_at is null or _bucket < _at, 1, 0)"))
    edge = rows.filter("_bucket = _at")
    running = F.sum("n_tokens").over(W.partitionBy(*LEVELS).orderBy("_order", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    edge = edge.withColumn("_more", F.when(F.col("_base") + running <= F.col("rest"), 1).otherwise(0))
    return sure.unionByName(edge).withColumn("copies", (F.col("full") + F.col("_more")).cast("long")).filter("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_weight(level: str, mix: Mix) -> str:
    return "case " + " ".join(f"when {level} = '{k}' then {v}" for k, v in sorted(getattr(mix, level).items())) + f" else {mix.other} end"


def _sql_pour(out: str, nodes: str, parent: str, name: str) -> str:
    by = f"partition by {parent}" if parent else ""
    order = f"{by} order by cap / w, {name} rows between"
    return f"""
{out}_a as (select *, coalesce(sum(cap) over ({order} unbounded preceding and 1 preceding), 0) as c_, sum(w) over ({order} current row and unbounded following) as w_ from {nodes}),
{out}_b as (select *, cap * w_ <= (budget - c_) * w as full_ from {out}_a),
{out} as (select * exclude (budget, c_, w_, full_), case when full_ then cap else ((budget - coalesce(sum(case when full_ then cap end) over ({by}), 0)) * w) // sum(case when not full_ then w end) over ({by}) end as budget from {out}_b)"""


def sql(docs: str = "documents", mix: Mix = Mix()) -> str:  # noqa: B008
    """DuckDB SQL for what mixed() gives over a table or subquery."""
    return rf"""
with t as (select doc_id, right(coalesce(source, ''), 1) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as n_tokens from {docs}),
leaf as (select domain, lang, source, cast(sum(n_tokens) as hugeint) as tokens, cast(sum(n_tokens) as hugeint) * {mix.max_epochs} as cap from t group by all),
n1 as (select domain, sum(cap) as cap, {_sql_weight("domain", mix)} as w, (select cast(sum(tokens) as hugeint) * {mix.budget_percent} // 100 from leaf) as budget from leaf group by domain),
{_sql_pour("d1", "n1", "", "domain")},
n2 as (select l.*, d1.budget from (select domain, lang, sum(cap) as cap, {_sql_weight("lang", mix)} as w from leaf group by domain, lang) l join d1 using (domain)),
{_sql_pour("d2", "n2", "domain", "lang")},
n3 as (select l.*, d2.budget from (select domain, lang, source, tokens, cap, {_sql_weight("source", mix)} as w from leaf) l join d2 using (domain, lang)),
{_sql_pour("d3", "n3", "domain, lang", "source")},
e as (select domain, lang, source, case when tokens > 0 then budget // tokens else 0 end as full_, budget - (case when tokens > 0 then budget // tokens else 0 end) * tokens as rest from d3),
r as (select t.*, full_, rest, sum(n_tokens) over (partition by domain, lang, source order by md5('{mix.seed}|' || cast(full_ + 1 as varchar) || '|' || coalesce(cast(doc_id as varchar), '')), doc_id rows unbounded preceding) as running
      from t join e using (domain, lang, source))
select doc_id, domain, lang, source, cast(n_tokens as bigint) as n_tokens, cast(full_ + case when running <= rest then 1 else 0 end as bigint) as copies
from r where full_ + case when running <= rest then 1 else 0 end > 0
"""
