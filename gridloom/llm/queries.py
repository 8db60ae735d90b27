"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

import importlib

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = rf"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     ig as (select item_id, least(10, len(w)) as m, w from iw where len(w) > 0),
     iwin as (select distinct item_id, m, array_to_string(w[q : q + m - 1], ' ') as g from (select *, unnest(range(1, len(w) - m + 2)) as q from ig)),
     dwin as (select doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') as g
              from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as p from dw, (select distinct m from ig))),
     hit as (select doc_id, item_id, p, d.m from dwin d join iwin i on d.m = i.m and d.g = i.g),
     places as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(p, p + m)) as place from hit) group by doc_id),
     named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw d left join places p on d.doc_id = p.doc_id left join named n on d.doc_id = n.doc_id
"""

_WHERE = {
    "op1_warc": "warc",
    "op2_simhash": "simhash",
    "op3_decontaminate": "winnow",
    "op4_embedding_dedup": "cosine",
    "op5_language": "langid",
    "op6_mix_sources": "mixing",
    "op7_url_filter": "urlfilter",
    "op8_toxicity": "toxicity",
    "op9_tool_calls": "toolcalls",
    "op10_mixing_lm": "mixlm",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gridloom.llm.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from gridloom.llm import mixing
    from gridloom.llm.cosine import OP4_SQL
    from gridloom.llm.toolcalls import OP9_SQL
    from gridloom.llm.warc import OP1_SQL

    return {"op1_warc": OP1_SQL, "op3_decontaminate": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op6_mix_sources": mixing.sql(), "op9_tool_calls": OP9_SQL}
