"""Chat formatting with tool calls: link, order, validate, serialise.

Calls and results are hash-joined by conversation and call id. Calls are ordered so that each stands after those it
depends on. Where all calls of a conversation depend on earlier positions only, position order is such an order and is
taken, then id. In the others a call's level is one more than the highest level below it; they go by level, position
and id. The levels of a conversation of GROUP calls at most are found within one row; larger ones in rounds over the
calls not yet ordered, as many rounds as their longest chain, without a limit. Arguments are checked against a schema
per tool and written as canonical JSON: keys in order, no blanks.

Defined results: a call without result has linked = false and result null; of several results the one of highest
position, then greatest content, is taken; a result without call gives no row (see `orphans`). Of calls with one id in
one conversation, that of least position counts, then of least arguments. A dependency on an unknown call is void.
Calls in a cycle, or above one, get no level, order null and valid = false. Null or broken argument JSON is invalid
and written as null. Calls with a null conversation id or call id are rows of their own, each, without link, order
or validity. Extra columns are ignored.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import written

#: Calls of a conversation whose levels are found within one row; positions in one block when calls are numbered.
GROUP, BLOCK = 128, 1024
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "boolean": ["BOOLEAN"], "null": ["VOID"]}


@dataclass(frozen=True)
class Property:
    """What a schema says of one argument. kind: string, integer, number, boolean, array, object or any."""

    name: str
    kind: str = "any"
    required: bool = False
    min_length: int = 0
    least: int | None = None
    options: tuple[str, ...] = ()


@dataclass(frozen=True)
class Tool:
    name: str
    properties: tuple[Property, ...]
    others: bool = False


def canonical(json: Column) -> Column:
    """The JSON text with keys in order and without blanks; null where it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def _typed(variant: Column, kind: str) -> Column:
    of = F.schema_of_variant(variant)
    if kind == "any":
        return F.lit(True)
    if kind == "number":
        return of.isin("BIGINT", "DOUBLE", "FLOAT") | of.startswith("DECIMAL")
    if kind in ("array", "object"):
        return of.startswith(kind.upper())
    return of.isin(*_TYPES[kind])


def fits(arguments: Column, tool: Tool) -> Column:
    """Whether the argument JSON keeps to the tool's schema."""
    whole = F.try_parse_json(arguments)
    good = F.schema_of_variant(whole).startswith("OBJECT")
    for p in tool.properties:
        path = f"$['{p.name}']"
        there = F.array_contains(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), p.name)
        value = F.try_variant_get(whole, path, "variant")
        ok = F.coalesce(_typed(value, p.kind), F.lit(False))
        if p.min_length:
            ok &= F.coalesce(F.length(F.try_variant_get(whole, path, "string")) >= p.min_length, F.lit(False))
        if p.least is not None:
            ok &= F.coalesce(F.try_variant_get(whole, path, "double") >= p.least, F.lit(False))
        if p.options:
            ok &= F.coalesce(F.try_variant_get(whole, path, "string").isin(*p.options), F.lit(False))
        good &= ok if p.required else (~there | ok)
    if not tool.others:
        names = F.array(*[F.lit(p.name) for p in tool.properties]) if tool.properties else F.array().cast("array<string>")
        good &= F.coalesce(F.size(F.array_except(F.json_object_keys(arguments), names)) == 0, F.lit(False))
    return F.coalesce(good, F.lit(False))


def _within(calls: DataFrame) -> DataFrame:
    """levels() of conversations of GROUP calls at most: a row each, calls by index; in round k the calls get level k whose
    needs all have a lower one."""
    rows = calls.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("call_id", "needs"))).alias("c"))  # GROUP calls at most
    ids = F.transform("c", lambda x: x["call_id"])
    rows = rows.select("conv_id", ids.alias("ids"), F.transform("c", lambda x: F.transform(x["needs"], lambda y: F.array_position(ids, y).cast("int") - 1)).alias("needs"))
    met = lambda acc, k, i: F.forall(F.get("needs", i), lambda j: F.coalesce(F.get(acc, j) < k, F.lit(False)))
    step = lambda acc, k: F.transform(acc, lambda at, i: F.coalesce(at, F.when(met(acc, k, i), k)))
    found = F.aggregate(F.sequence(F.lit(0), F.size("ids") - 1), F.transform("ids", lambda _: F.lit(None).cast("int")), step)
    return rows.select("conv_id", F.explode(F.arrays_zip("ids", found.alias("levels"))).alias("e")).select("conv_id", F.col("e.ids").alias("call_id"), F.col("e.levels").alias("level")).filter("level is not null")


def levels(calls: DataFrame, group: int = GROUP) -> DataFrame:
    """(conv_id, call_id, level) of the calls whose dependencies end; calls has conv_id, call_id, position, depends_on."""
    key = ["conv_id", "call_id"]
    needs = calls.select(*key, "position", F.explode(F.array_distinct("depends_on")).alias("needs"))
    known = calls.select("conv_id", F.col("call_id").alias("needs"), F.col("position").alias("_where"))
    needs = written(needs.join(known, ["conv_id", "needs"]), "needs")
    # a conversation without a need at the same or a later position is in order as it stands
    unsettled = needs.filter("not coalesce(_where < position, false)").select("conv_id").distinct()
    unsettled = written(unsettled.join(calls.groupBy("conv_id").agg(F.count("*").alias("size")), "conv_id"), "unsettled")
    settled = calls.select(*key).join(unsettled, "conv_id", "left_anti").withColumn("level", F.lit(0))
    needs, calls = (x.join(unsettled, "conv_id").select(*columns, "size") for x, columns in ((needs, [*key, "needs"]), (calls, key)))
    small = needs.filter(F.col("size") <= group).groupBy(*key).agg(F.collect_set("needs").alias("needs"))
    small = calls.filter(F.col("size") <= group).select(*key).join(small, key, "left").withColumn("needs", F.coalesce("needs", F.array().cast("array<string>")))
    out = settled.union(_within(small))
    if unsettled.filter(F.col("size") > group).isEmpty():
        return out
    calls, needs = calls.filter(F.col("size") > group), written(needs.filter(F.col("size") > group).drop("size"), "needs")
    done = written(calls.select(*key).join(needs.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0)), "levels")
    level = 0
    while not done.isEmpty():
        # a need that was met in the last round goes; calls without needs left are of the next level
        out, level = out.union(done), level + 1
        met = done.select("conv_id", F.col("call_id").alias("needs"))
        left = written(needs.join(met, ["conv_id", "needs"], "left_anti"), "needs")
        done = written(needs.select(*key).distinct().join(left.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(level)), "levels")
        needs = left
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """rows (conv_id, call_id, level, position, ...) with call_order: 1, 2, ... by level, position and id in each
    conversation, calls without level aside. Rows are sorted within blocks of positions only, and what stands before a
    block is summed over the blocks' counts, so that no conversation is sorted in one task."""
    by = ["conv_id", "level", "_block"]
    rows = rows.withColumn("_block", F.floor(F.col("position") / BLOCK))
    before = W.partitionBy("conv_id").orderBy("level", "_block").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.filter("level is not null").groupBy(*by).agg(F.count("*").alias("_n"))
    counts = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    joined = rows.alias("r").join(counts.alias("c"), same, "left").select("r.*", "_before")
    place = F.row_number().over(W.partitionBy(*by).orderBy("position", "call_id"))
    return joined.withColumn("call_order", F.when(F.col("level").isNotNull(), place + F.col("_before")).cast("long")).drop("_block", "_before")


def linked(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """calls (conv_id, call_id, position, name, arguments, depends_on), results (conv_id, call_id, position, content)
    -> (conv_id, call_id, call_order, linked, valid, message)."""
    key = ["conv_id", "call_id"]
    asked = F.struct("position", "arguments", "name", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))
    nameless = calls.filter("conv_id is null or call_id is null").select(*key, asked.alias("c")).select(*key, "c.*")
    calls, results = (x.filter("conv_id is not null and call_id is not null") for x in (calls, results))
    kept = calls.groupBy(*key).agg(F.min(asked).alias("c"))
    calls = written(kept.select(*key, "c.*"), "calls")
    answer = results.groupBy(*key).agg(F.max(F.struct("position", "content")).alias("a")).select(*key, F.col("a.content").alias("result"), F.lit(True).alias("linked"))
    rows = calls.join(answer, key, "left").join(levels(calls), key, "left")
    rows = numbered(rows).unionByName(nameless, allowMissingColumns=True).withColumn("linked", F.coalesce("linked", F.lit(False)))
    good = F.lit(False)
    for t in tools:
        good = F.when(F.col("name") == t.name, fits(F.col("arguments"), t)).otherwise(good)
    rows = rows.withColumn("valid", F.coalesce(good, F.lit(False)) & F.col("call_order").isNotNull())
    text = lambda c: F.coalesce(F.to_json(F.array(c), {"ignoreNullFields": "false"}), F.lit("[null]"))
    plain = lambda c: F.regexp_replace(text(c), r"(?s)^\[(.*)\]$", "$1")
    fields = {
        "arguments": F.coalesce(canonical(F.col("arguments")), F.lit("null")),
        "depends_on": F.to_json(F.array_sort("depends_on")),
        "id": plain(F.col("call_id")),
        "name": plain(F.col("name")),
        "order": F.coalesce(F.col("call_order").cast("string"), F.lit("null")),
        "result": plain(F.col("result")),
    }
    parts = [x for i, (k, v) in enumerate(fields.items()) for x in (F.lit(f'{"," if i else "{"}"{k}":'), v)]
    return rows.select(*key, "call_order", "linked", "valid", F.concat(*parts, F.lit("}")).alias("message"))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that no call asked for."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")


TOOLS = [
    Tool("answer", (Property("prompt", "string", True, min_length=1), Property("turn", "integer", True, least=0))),
    Tool("configure", (Property("instructions", "string", True, min_length=1),)),
]


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, turn, role, text) as calls and results: a system turn calls `configure`, a user turn `answer`
    with its text; an assistant turn is the result of the call of the turn before it. What a call depends on goes by its
    text's bytes modulo 4: the calls of the two turns before it (0), of the turn after the next (1), none (2), of the
    turn before the last (3). So there are needs of later calls, chains of them, and cycles."""
    call = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    system, turn, way = F.col("role") == "system", F.col("turn"), F.coalesce(F.octet_length("text"), F.lit(0)) % 4
    arguments = F.when(system, F.to_json(F.struct(F.col("text").alias("instructions")))).otherwise(F.to_json(F.struct(F.col("turn"), F.col("text").alias("prompt"))))
    needs = F.when(way == 0, F.array(call(turn - 1), call(turn - 2))).when(way == 1, F.array(call(turn + 2))).when(way == 3, F.array(call(turn - 2))).otherwise(F.array().cast("array<string>"))
    calls = turns.filter("role in ('system', 'user')").select(
        "conv_id", call(turn).alias("call_id"), turn.alias("position"), F.when(system, "configure").otherwise("answer").alias("name"), arguments.alias("arguments"), needs.alias("depends_on")
    )
    results = turns.filter("role = 'assistant'").select("conv_id", call(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return calls, results


def op9_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return linked(calls, results, TOOLS)


#: Levels are the longest walks down the needs; a walk of more steps than a conversation has calls is in a cycle.
OP9_SQL = """
with recursive
c as (select conv_id, turn, 'call_' || turn as call_id, role, text, coalesce(strlen(text), 0) % 4 as way from conversations where role in ('system', 'user')),
d as (select *, case way when 0 then ['call_' || (turn - 1), 'call_' || (turn - 2)] when 1 then ['call_' || (turn + 2)] when 3 then ['call_' || (turn - 2)] else []::varchar[] end as needs from c),
e as (select x.conv_id, x.call_id, x.turn, y.call_id as need, y.turn as need_turn from (select *, unnest(needs) as n from d) x join c y on x.conv_id = y.conv_id and y.call_id = x.n),
size as (select conv_id, count(*) as n from c group by 1),
late as (select distinct conv_id from e where need_turn >= turn),
walk as (select conv_id, call_id, call_id as at, 0 as steps from c where conv_id in (select conv_id from late)
         union select w.conv_id, w.call_id, e.need, steps + 1 from walk w join e on e.conv_id = w.conv_id and e.call_id = w.at join size s on s.conv_id = w.conv_id where steps <= s.n),
level as (select conv_id, call_id, case when max(steps) <= any_value(n) then max(steps) end as level from walk join size using (conv_id) group by 1, 2),
a as (select conv_id, 'call_' || (turn - 1) as call_id, text as result from conversations where role = 'assistant'),
o as (select d.*, a.result, a.call_id is not null as linked, case when late.conv_id is null then 0 else level end as level
      from d left join a on d.conv_id = a.conv_id and d.call_id = a.call_id left join late on late.conv_id = d.conv_id left join level l on l.conv_id = d.conv_id and l.call_id = d.call_id),
p as (select *, case when level is not null then row_number() over (partition by conv_id, level is null order by level, turn, call_id) end as call_order from o),
j as (select *, case when role = 'system' then '{"instructions":' || to_json(text) || '}' else '{"prompt":' || to_json(text) || ',"turn":' || turn || '}' end as args,
             array_to_string(list_transform(list_sort(needs), lambda x: '"' || x || '"'), ',') as needed from p)
select conv_id, call_id, call_order, linked, length(text) > 0 and call_order is not null as valid,
       '{"arguments":' || args || ',"depends_on":[' || needed || '],"id":"' || call_id || '","name":"' || case when role = 'system' then 'configure' else 'answer' end
       || '","order":' || coalesce(cast(call_order as varchar), 'null') || ',"result":' || coalesce(cast(to_json(result) as varchar), 'null') || '}' as message
from j
"""
