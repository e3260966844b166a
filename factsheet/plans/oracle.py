"""The same queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from factsheet.functions.text import SPACE
from factsheet.operators.catalog import INTENTS
from factsheet.plans.queries import COMPARISON_NAMES, DIMENSION, TABLES, THRESHOLD

ORACLE: dict[str, str] = {}

# Averages

ORACLE["compare_averages_two"] = """
select 'customer' as file_id, round(avg(c_acctbal), 4) as average from customer
union all select 'supplier', round(avg(s_acctbal), 4) from supplier"""

ORACLE["compare_averages_two_numbers"] = """
with a as (select avg(c_acctbal) as x from customer), b as (select avg(s_acctbal) as y from supplier)
select round(x, 4) as customer_average, round(y, 4) as supplier_average, round(x - y, 4) as difference,
       round(case when y = 0 then 0 else (x - y) / y * 100 end, 4) as percent_difference
from a, b"""

ORACLE["compare_averages_group"] = """
select l_returnflag, round(avg(l_extendedprice), 4) as average from lineitem group by l_returnflag"""

ORACLE["compare_averages_group_numbers"] = """
with g as (select l_returnflag, avg(l_extendedprice) as m from lineitem group by l_returnflag)
select (select round(avg(l_extendedprice), 4) from lineitem) as overall_average,
       round(max(m), 4) as max_average, round(min(m), 4) as min_average
from g"""
ORACLE["compare_averages_many_groups"] = """
select o_custkey::varchar as o_custkey, round(avg(o_totalprice), 4) as average from orders group by 1"""
for _name, _test in {"integer": ">= 3", "fraction": "> 3.5", "beyond_doubles": "< 9007199254740994", "not_equal": "is distinct from 7"}.items():
    ORACLE[f"filter_bigint_{_name}"] = f"select event_id, user_id from events where user_id {_test}"

ORACLE["compare_averages_single"] = """
with s as (select avg(l_extendedprice) as a, stddev_samp(l_extendedprice) as s, min(l_extendedprice) as lo,
                  max(l_extendedprice) as hi, count(*) as n from lineitem)
select 'average' as metric, round(a, 4) as value from s
union all select 'std_dev', round(s, 4) from s
union all select 'min', round(lo, 4) from s
union all select 'max', round(hi, 4) from s
union all select 'count', n::double from s"""

ORACLE["compare_averages_single_numbers"] = """
select round(avg(l_extendedprice), 4) as average, round(stddev_samp(l_extendedprice), 4) as std_dev,
       min(l_extendedprice) as min, max(l_extendedprice) as max, count(*) as count
from lineitem"""

# Filters, sorts, top lists

GAPPED = """(select event_id, ts::varchar as ts, user_id, event_type,
  case when event_type <> 'error' then value end as value, props from events)"""

for _name, _op in COMPARISON_NAMES.items():
    _sql = {"==": "=", "!=": "is distinct from"}.get(_op, _op)
    ORACLE[f"filter_{_name}"] = f"""
select * from {GAPPED} e where value {_sql} {THRESHOLD}::double order by event_id limit 100"""
    ORACLE[f"filter_{_name}_numbers"] = f"""
with e as {GAPPED},
m as (select event_id from e where value {_sql} {THRESHOLD}::double order by event_id limit 100)
select count(*) as total_rows, count(*) filter (where value {_sql} {THRESHOLD}::double) as filtered_rows,
       'value' as filter_column, '{_op}' as filter_operator, {THRESHOLD}::double as filter_value,
       round(count(*) filter (where value {_sql} {THRESHOLD}::double) * 100.0::double / count(*), 4) as percentage_matched,
       (select coalesce(string_agg(event_id::varchar, ',' order by event_id), '') from m) as row_indices
from e"""

ORACLE["filter_rows"] = """
select l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45"""

ORACLE["sort_asc"] = f"select * from {GAPPED} e order by value asc nulls last, event_id"
ORACLE["sort_desc_limit"] = f"select * from {GAPPED} e order by value desc nulls last, event_id limit 25"
ORACLE["sort_numbers"] = f"""
with e as {GAPPED}
select count(*) as total_rows, count(*) as returned_rows, 'value' as sort_column, true as ascending,
       (select value from e order by value asc nulls last, event_id limit 1) as first_value,
       (select value from e order by value desc nulls first, event_id limit 1) as last_value
from e"""
ORACLE["sort_desc_limit_numbers"] = f"""
with e as {GAPPED},
t as (select *, row_number() over (order by value desc nulls last, event_id) as pos from e
      order by value desc nulls last, event_id limit 25)
select (select count(*) from e) as total_rows, count(*) as returned_rows, 'value' as sort_column,
       false as ascending, min_by(value, pos) as first_value, max_by(value, pos) as last_value,
       string_agg(event_id::varchar, ',' order by pos) as row_indices
from t"""
ORACLE["sort_text_numbers"] = """
select count(*) as total_rows, count(*) as returned_rows, 'p_name' as sort_column, true as ascending,
       min(p_name) as first_value, max(p_name) as last_value
from part"""

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _top(direction: str) -> str:
    return f"select {ORDER_COLUMNS} from orders order by o_totalprice {direction}, o_orderkey limit 5"


def _top_numbers(direction: str) -> str:
    return f"""
with t as (select *, row_number() over (order by o_totalprice {direction}, o_orderkey) as pos from ({_top(direction)}))
select 5 as n, 'o_totalprice' as "column",
       string_agg(o_totalprice::decimal(18,2)::varchar, ',' order by pos) as top_values,
       string_agg(o_orderkey::varchar, ',' order by pos) as top_indices,
       min_by(o_totalprice, pos) as highest_value, max_by(o_totalprice, pos) as lowest_in_top,
       round(avg(o_totalprice), 4) as average_of_top
from t"""


ORACLE["top_n"], ORACLE["bottom_n"] = _top("desc"), _top("asc")
ORACLE["top_n_numbers"], ORACLE["bottom_n_numbers"] = _top_numbers("desc"), _top_numbers("asc")
ORACLE["top_n_lineitem"] = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem
order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity limit 20"""

_TOPS = """
c as (select row_number() over (order by c_acctbal desc, c_custkey) as rank, c_acctbal as v, c_custkey as id
      from (select * from customer order by c_acctbal desc, c_custkey limit 10)),
s as (select row_number() over (order by s_acctbal desc, s_suppkey) as rank, s_acctbal as v, s_suppkey as id
      from (select * from supplier order by s_acctbal desc, s_suppkey limit 10))"""
ORACLE["compare_top"] = f"""
with {_TOPS}
select r.rank::int as rank, c.v as customer_acctbal, c.id as customer_index, s.v as supplier_acctbal, s.id as supplier_index
from range(1, 11) r(rank) left join c on c.rank = r.rank left join s on s.rank = r.rank"""
ORACLE["compare_top_numbers"] = f"""
with {_TOPS}
select 10 as n, 'acctbal' as "column",
  (select string_agg(v::decimal(18,2)::varchar, ',' order by rank) from c) as customer_top_values,
  (select string_agg(v::decimal(18,2)::varchar, ',' order by rank) from s) as supplier_top_values,
  (select round(avg(v), 4) from c) as customer_average, (select round(avg(v), 4) from s) as supplier_average,
  (select max(v) from c) as customer_max, (select max(v) from s) as supplier_max"""

_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity"


def _half(direction: str) -> str:
    return f"""
select row_number() over (order by l_extendedprice {direction}, {_LINE_ORDER}) as rank, * from lineitem
order by l_extendedprice {direction}, {_LINE_ORDER} limit (select count(*) // 2 from lineitem)"""


ORACLE["top_half_ranks"] = f"select rank, l_extendedprice as value, l_orderkey, l_linenumber, l_quantity from ({_half('desc')})"
ORACLE["top_half_numbers"] = f"""
select (select count(*) // 2 from lineitem) as n, 'l_extendedprice' as "column", min_by(l_extendedprice, rank) as highest_value,
       max_by(l_extendedprice, rank) as lowest_in_top, round(avg(l_extendedprice), 4) as average_of_top
from ({_half('asc')})"""
ORACLE["sort_half_rows"] = f"select l_orderkey, l_linenumber, l_quantity, l_extendedprice from ({_half('asc')})"
ORACLE["rank_all_rows"] = f"""
select row_number() over (order by value asc nulls last, event_id) as rank, value, event_id as id from {GAPPED} e"""
_SIDE = f"select row_number() over (order by l_extendedprice desc, {_LINE_ORDER}) as rank, * from lineitem where l_returnflag"
ORACLE["compare_top_half"] = f"""
with a as ({_SIDE} = 'N'), b as ({_SIDE} <> 'N')
select r.rank::int as rank, a.l_extendedprice as new_l_extendedprice, b.l_extendedprice as old_l_extendedprice,
       a.l_orderkey as new_order, b.l_orderkey as old_order
from (select unnest(range(1, (select count(*) // 2 from lineitem) + 1)) as rank) r
left join a on a.rank = r.rank left join b on b.rank = r.rank"""

# Profiles

# The schemas of the given tables.
SCHEMAS = {
    "region": "r_regionkey=int32 r_name=object",
    "nation": "n_nationkey=int32 n_name=object n_regionkey=int32",
    "customer": "c_custkey=int64 c_name=object c_nationkey=int32 c_acctbal=float64 c_mktsegment=object",
    "supplier": "s_suppkey=int64 s_name=object s_nationkey=int32 s_acctbal=float64",
    "part": "p_partkey=int64 p_name=object p_brand=object p_type=object p_size=int32 p_retailprice=float64",
    "orders": "o_orderkey=int64 o_custkey=int64 o_orderstatus=object o_totalprice=float64 o_orderdate=datetime64[ns] "
    "o_orderpriority=object",
    "lineitem": "l_orderkey=int64 l_partkey=int64 l_suppkey=int64 l_linenumber=int32 l_quantity=float64 "
    "l_extendedprice=float64 l_discount=float64 l_tax=float64 l_returnflag=object l_linestatus=object "
    "l_shipdate=datetime64[ns]",
    "events": "event_id=int64 ts=datetime64[ns] user_id=int64 event_type=object value=float64 props=object",
    "documents": "doc_id=int64 text=object lang=object source=object n_chars=int64",
    "embeddings": "vec_id=int64 embedding=object label=int32",
    "pages": "page_id=int64 url=object html=object",
    "benchmark": "item_id=int64 text=object",
    "labels": "doc_id=int64 quality=int32 toxic=int32",
    "conversations": "conv_id=int64 turn=int64 role=object text=object",
}


def _columns(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split("=")) for c in SCHEMAS[table].split()]


def _is_numeric(dtype: str) -> bool:
    return dtype.startswith(("int", "float"))


_part = _columns("part")
ORACLE["profile_schema"] = f"""
select 'part' as file_id, 'part.csv' as filename, count(*) as num_rows, {len(_part)} as num_columns,
       '{",".join(n for n, _ in _part)}' as columns, '{",".join(f"{n}={t}" for n, t in _part)}' as column_types,
       '{",".join(n for n, t in _part if _is_numeric(t))}' as numeric_columns,
       '{",".join(n for n, t in _part if not _is_numeric(t))}' as text_columns
from part"""


def _numeric(columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", round(min({c})::double, 4) as min, round(max({c})::double, 4) as max,
 round(avg({c}), 4) as mean, round(median({c})::double, 4) as median from lineitem"""
        for c in columns
    )


ORACLE["profile_numeric"] = _numeric(["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"])
ORACLE["profile_numeric_by_intervals"] = _numeric(["l_quantity", "l_extendedprice", "l_partkey"])


def _top_three(table: str, c: str, key: str) -> str:
    return f"""(select string_agg(v, '{{sep}}' order by n desc, k, v) from
 (select {c} as v, count(*) as n, min({key}) as k from {table} group by 1 order by n desc, k, v limit 3))"""


ORACLE["profile_categorical"] = " union all ".join(
    f"""select '{c}' as "column", (select count(distinct {c}) from orders) as unique_values,
 {_top_three("orders", c, "o_orderkey").format(sep=",")} as top_values"""
    for c in ("o_orderstatus", "o_orderpriority")
)


def _summaries(table: str, key: str) -> str:
    parts = []
    for c, t in _columns(table):
        if _is_numeric(t):
            text = f"""'Column {c}: numeric. Min: ' || min({c})::varchar || ', Max: ' || max({c})::varchar
 || ', Mean: ' || printf('%.2f', avg({c})) || ', Median: ' || median({c})::double::varchar"""
        else:
            text = f"""'Column {c}: text/categorical. Unique values: ' || count(distinct {c})::varchar
 || '. Top values: ' || {_top_three(table, c, key).format(sep=", ")}"""
        parts.append(f"select '{c}' as column_name, {text} as summary from {table}")
    return " union all ".join(parts)


ORACLE["column_summaries"] = _summaries("part", "p_partkey")

_ROW = """'c_custkey: ' || c_custkey::varchar || ' | c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey::varchar
 || ' | c_acctbal: ' || c_acctbal::varchar || ' | c_mktsegment: ' || c_mktsegment"""
ORACLE["row_text"] = f"select c_custkey, {_ROW} as row_text, substr({_ROW}, 1, 500) as stored_text from customer"
ORACLE["row_text_numbers_only"] = """
select c_custkey, 'c_custkey: ' || c_custkey::double::varchar || ' | c_nationkey: ' || c_nationkey::double::varchar
 || ' | c_acctbal: ' || c_acctbal::varchar as row_text from customer"""


def _clean(v: str) -> str:
    t0 = f"trim({v}, '{SPACE}')"
    t1 = f"(case when ends_with({t0}, '-') then '-' || substr({t0}, 1, length({t0}) - 1) else {t0} end)"
    t2 = f"regexp_replace({t1}, '[^0-9.\\-eE+]', '', 'g')"
    p = f"regexp_extract({t2}, '^-?[0-9]+\\.?[0-9]*')"
    dots = f"length({t2}) - length(replace({t2}, '.', ''))"
    dash = f"length({t2}) - length(replace({t2}, '-', ''))"
    broken = f"({dots} > 1 or ({dash} > 1 and not starts_with({t2}, '-'))) and {p} <> ''"
    return f"try_cast(case when {broken} then {p} else {t2} end as double)"


ORACLE["clean_numeric"] = f"""
select o_orderkey, {_clean("o_orderpriority")} as priority,
       {_clean("'$ ' || o_totalprice::decimal(18,2)::varchar || '-'")} as negative_price
from orders"""


ORACLE["clean_table"] = f"""
select p_partkey, p_name, {_clean("p_brand")} as p_brand, p_type, p_size, p_retailprice from part"""


def _fingerprint(source: str, columns: list[str]) -> str:
    """(num_rows, digest_sum, fingerprint) of the rows of a source."""
    cells = " || chr(31) || ".join(f"coalesce({c}::varchar, chr(0))" for c in columns)
    header = " || chr(30) || ".join(f"'{c}'" for c in columns)
    return f"""
select n as num_rows, s::varchar as digest_sum,
       md5({header} || chr(31) || n::varchar || chr(31) || s::varchar) as fingerprint
from (select count(*) as n, sum(('0x' || substr(md5({cells}), 1, 12))::bigint)::hugeint as s from {source})"""


ORACLE["fingerprint"] = _fingerprint("customer", [n for n, _ in _columns("customer")])

# Documents

_WORD_GAP = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _chunks(source: str, size: int = 1000, words: int = 40, name: str = "") -> str:
    """CTEs ending in ch(doc_id, chunk_idx, chunk), or ``name`` and ch: one paragraph per recursion step."""
    opened = "p"
    if words:
        kept = f"array_to_string(list_filter(regexp_split_to_array(c, '{_WORD_GAP}'), lambda w: w <> '')[-{words}:], ' ')"
        opened = f"{kept} || ' ' || p"
    return f"""
{name}ps as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{SPACE}')),
              lambda x: x <> '') as ps from {source}),
{name}r as (select doc_id, ps, 1 as i, '' as c, null::varchar as e, -1 as pos from {name}ps
  union all select doc_id, ps, i + 1,
    case when length(c) + length(p) > {size} and c <> '' then {opened} when c <> '' then c || chr(10) || p else p end,
    case when length(c) + length(p) > {size} and c <> '' then c end,
    case when length(c) + length(p) > {size} and c <> '' then pos + 1 else pos end
  from (select *, ps[i] as p from {name}r where i <= len(ps))),
{name}ch as (select doc_id, pos as chunk_idx, e as chunk from {name}r where e is not null
  union all select doc_id, pos + 1, c from {name}r where i = len(ps) + 1 and c <> '')"""


ORACLE["chunk_text"] = f"with recursive {_chunks('documents')} select doc_id, chunk_idx, chunk from ch"
ORACLE["chunk_text_small"] = f"with recursive {_chunks('documents', 300, 0)} select doc_id, chunk_idx, chunk from ch"

# A conversation is a document; its question/answer pairs are the user turns up to an answer.
_QA = f"""
turns as (select conv_id, turn, role, text,
            count(*) filter (where role = 'assistant') over (partition by conv_id order by turn) -
            (role = 'assistant')::int as g from conversations),
qs as (select conv_id, g, string_agg(case when nth = 1 then text else 'Q' || turn || ': ' || text end, chr(10) order by turn) as q
       from (select *, row_number() over (partition by conv_id, g order by turn) as nth from turns where role = 'user')
       group by conv_id, g),
ans as (select conv_id, g, text, length(text)::varchar || ' characters' as analysis from turns where role = 'assistant'),
qa as (select qs.conv_id as doc_id, row_number() over (partition by qs.conv_id order by qs.g)::int - 1 as qa_idx,
         trim(q, '{SPACE}') as question, trim(coalesce(ans.text, ''), '{SPACE}') as answer,
         coalesce(analysis, '') as analysis
       from qs left join ans on ans.conv_id = qs.conv_id and ans.g = qs.g)"""
ORACLE["extract_qa"] = f"with {_QA} select * from qa"

ORACLE["document_units"] = f"""
with recursive {_chunks("documents")}
select doc_id, chunk_idx, 'text' as chunk_type, chunk as full_text, substr(chunk, 1, 500) as original_text,
       null::varchar as question_text, null::varchar as answer_text, null::varchar as analysis_text
from ch"""

_QA_TEXT = """'Question: ' || question || chr(10) || 'Answer: ' || answer ||
 case when analysis <> '' then chr(10) || 'Analysis: ' || analysis else '' end"""
ORACLE["document_metadata"] = f"""
with recursive {_chunks("documents")}, n as (select doc_id, count(*) as n from ch group by doc_id)
select d.doc_id, length(text)::bigint as num_characters, coalesce(n.n, 0)::int as num_chunks, 0::int as num_qa_pairs,
       false as has_questions
from documents d left join n on n.doc_id = d.doc_id"""

_QA_DOCUMENTS = """(select conv_id as doc_id, string_agg(case role
  when 'user' then 'Q' || turn || ': ' || text || chr(10)
  when 'assistant' then chr(10) || chr(10) || 'Ans: ' || text || chr(10) || chr(10) || 'ANALYSIS: ' || length(text)
                        || ' characters' || chr(10)
  else text || chr(10) end, '' order by turn) as text from conversations group by conv_id)"""
# Vectors


def _weights(name: str, source: str, ids: str, text: str) -> str:
    """CTE of (ids, bucket, w): the non-zero cells of unit-length bag-of-words vectors."""
    return f"""
{name}_c as (select {ids}, ('0x' || substr(md5(t), 1, 7))::bigint % {DIMENSION} as bucket, count(*) as n
  from (select {ids}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) as t from {source}) group by all),
{name}_f as (select {ids}, bucket, (n / sqrt(sum(n * n) over (partition by {ids})))::float as f from {name}_c),
{name} as (select {ids}, bucket, f, f::double / sqrt(sum(f::double * f::double) over (partition by {ids})) as w
  from {name}_f)"""


ORACLE["embed_text"] = f"""
with {_weights("v", "documents", "doc_id", "text")}
select doc_id, bucket::int as bucket, round(f::double, 4) as weight from v"""

_PAIRS = """select q.vec_id as query_id, b.vec_id as vec_id, round(list_sum(list_transform(list_zip(q.u, b.u),
  lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) as d from u q, u b"""
_UNIT = """u as (select vec_id, label, list_transform(embedding, lambda x: x::double
  / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u from embeddings)"""


def _knn(where: str) -> str:
    return f"""
with {_UNIT}, pairs as ({_PAIRS} {where}),
ranked as (select *, row_number() over (partition by query_id order by d, vec_id) as rank from pairs)"""


ORACLE["knn"] = f"""{_knn("")}
select query_id, rank::int as rank, vec_id, round(1 - d, 6) as similarity, round(1 - d / 2, 6) as cosine
from ranked where rank <= 5"""
ORACLE["knn_by_cells"] = ORACLE["knn"]
ORACLE["knn_in_file"] = f"""{_knn("where b.label = 3")}
select query_id, rank::int as rank, vec_id, round(d, 6) as distance from ranked where rank <= 5"""
ORACLE["vectors_of_file"] = "select vec_id, label as file_id from embeddings where label = 3"
ORACLE["store_list"] = "select label as file_id, count(*) as num_vectors from embeddings group by label"
ORACLE["store_stats"] = """
select count(distinct label) as collections, count(*) as num_vectors, sum(len(embedding) * 4)::bigint as size_bytes
from embeddings"""
ORACLE["vector_store_round_trip"] = """
select vec_id, 'f' || label as file_id, len(embedding)::int as dimension, 1.0::double as norm from embeddings"""

ORACLE["vector_store_one_file"] = """
select vec_id, 'f' || label as file_id, 1.0::double as norm from embeddings where label = 3"""
ORACLE["vector_store_reload"] = """
select vec_id, 'f' || label as file_id, len(embedding)::int as dimension from embeddings where label <> 3 or vec_id % 2 = 0"""

_UNITS = f"""
units as (select 'customer' as file_id, c_custkey as row_idx, null::varchar as column_name, true as is_row_vector,
    {_ROW} as full_text from customer
  union all select 'customer', -1, column_name, false, summary from ({_summaries("customer", "c_custkey")}))"""
ORACLE["row_units"] = f"""
with {_UNITS}
select file_id, row_idx, column_name, is_row_vector,
       case when is_row_vector then substr(full_text, 1, 500) else full_text end as original_text
from units"""


def _search(queries: str, query_id: str, query_text: str, units: str, ids: str, text: str, k: int) -> str:
    """CTE ranked(query_id, ids, d, rank): nearest units by the words they share with a query."""
    listed = ", ".join(f"b.{i.strip()}" for i in ids.split(","))
    return f"""
{_weights("qw", queries, query_id, query_text)},
{_weights("uw", units, ids, text)},
dots as (select a.{query_id} as query_id, {listed}, round(greatest(2 - 2 * sum(a.w * b.w), 0), 9) as d
  from qw a join uw b on a.bucket = b.bucket group by all),
ranked as (select * from (select *, row_number() over (partition by query_id order by d, {ids} nulls first) as rank
  from dots) where rank <= {k})"""


_EXPLAINED = f"""
with {_UNITS},
nq as (select n_nationkey, 'c_nationkey ' || n_nationkey || ' c_mktsegment BUILDING' as q from nation),
{_search("nq", "n_nationkey", "q", "units", "row_idx, column_name", "full_text", 3)}"""
ORACLE["explain_row"] = f"""{_EXPLAINED}
select query_id, rank::int as rank, c.*, row_idx as _row_index, round(1 - d, 6) as _similarity_score
from ranked join customer c on c.c_custkey = row_idx where row_idx >= 0"""
ORACLE["explain_row_numbers"] = f"""{_EXPLAINED},
h as (select * from ranked where row_idx >= 0)
select n_nationkey as query_id, 3 as top_k,
       coalesce(string_agg(row_idx::varchar, ',' order by rank), '') as row_indices,
       coalesce(string_agg((1 - d)::decimal(18,4)::varchar, ',' order by rank), '') as similarity_scores,
       max(case when rank is not null then 'customer' end) as file_id
from nation left join h on h.query_id = n_nationkey group by n_nationkey"""

_FOUND = f"""
with recursive {_chunks("documents")},
{_search("benchmark", "item_id", "text", "ch", "doc_id, chunk_idx", "chunk", 3)},
hits as (select query_id, rank::int as rank, r.doc_id as file_id, r.chunk_idx, 1 - d as s, substr(chunk, 1, 500) as content
  from ranked r join ch on ch.doc_id = r.doc_id and ch.chunk_idx = r.chunk_idx)"""
ORACLE["document_query"] = f"""{_FOUND}
select query_id, rank, file_id, chunk_idx, 'text' as chunk_type, round(s, 6) as similarity, content from hits"""
ORACLE["document_query_by_cells"] = ORACLE["document_query"]
ORACLE["document_query_numbers"] = f"""{_FOUND}
select item_id as query_id, count(s) as num_results, round(coalesce(avg(s), 0), 6) as avg_similarity,
       (select coalesce(string_agg(f::varchar, ',' order by f), '')
        from (select distinct file_id as f from hits h where h.query_id = item_id)) as file_ids
from benchmark left join hits on hits.query_id = item_id group by item_id"""
ORACLE["document_context_text"] = f"""{_FOUND}
select query_id, string_agg('[Relevance: ' || printf('%.2f', s) || '] ' || content, chr(10) || chr(10) order by rank)
       as context_text
from hits group by query_id"""

_QA_UNITS = f"""
qd as {_QA_DOCUMENTS},
{_chunks("qd")},
{_QA.strip()},
sizes as (select doc_id, count(*) as n from ch group by doc_id),
un as (select doc_id, chunk_idx, 'text' as chunk_type, chunk as full_text, null::varchar as question,
         null::varchar as answer, null::varchar as analysis from ch
  union all select qa.doc_id, n + qa_idx, 'qa_pair', {_QA_TEXT}, question, answer, analysis
  from qa join sizes on sizes.doc_id = qa.doc_id)"""
ORACLE["qa_units"] = f"""
with recursive {_QA_UNITS.strip()}
select doc_id, chunk_idx::int as chunk_idx, chunk_type, full_text, substr(full_text, 1, 500) as original_text,
       question as question_text, answer as answer_text, analysis as analysis_text
from un"""
ORACLE["qa_document_metadata"] = f"""
with recursive {_QA_UNITS.strip()},
pairs as (select doc_id, count(*) as p from qa group by doc_id)
select qd.doc_id, length(text)::bigint as num_characters, coalesce(n, 0)::int as num_chunks, coalesce(p, 0)::int as num_qa_pairs,
       coalesce(p, 0) > 0 as has_questions
from qd left join sizes on sizes.doc_id = qd.doc_id left join pairs on pairs.doc_id = qd.doc_id"""
_FOUND_QA = f"""
with recursive {_QA_UNITS.strip()},
{_search("benchmark", "item_id", "text", "un", "doc_id, chunk_idx", "full_text", 5)},
hits as (select query_id, rank::int as rank, r.doc_id as file_id, r.chunk_idx::int as chunk_idx, chunk_type, 1 - d as s,
    substr(full_text, 1, 500) as content, question, answer, analysis
  from ranked r join un on un.doc_id = r.doc_id and un.chunk_idx = r.chunk_idx)"""
ORACLE["document_query_qa"] = f"""{_FOUND_QA}
select query_id, rank, file_id, chunk_idx, chunk_type, printf('%.4f', s) as similarity_score, content, question, answer, analysis
from hits"""
ORACLE["document_context"] = f"""{_FOUND_QA},
p as (select *, row_number() over (partition by query_id order by rank) as nth from hits
      where question <> '' and answer <> ''),
b as (select query_id, string_agg('Q: ' || question || chr(10) || 'A: ' || answer ||
        case when analysis <> '' then chr(10) || 'Analysis: ' || analysis else '' end, chr(10) || chr(10) order by rank) as t
      from p where nth <= 3 group by query_id),
n as (select query_id, string_agg('[Relevance: ' || printf('%.2f', s) || '] ' || content, chr(10) || chr(10) order by rank) as context_text
      from hits group by query_id)
select n.query_id, coalesce(chr(10) || chr(10) || 'Relevant Q&A pairs from analysis:' || chr(10) || t, '') as qa_context, context_text
from n left join b on b.query_id = n.query_id"""
ORACLE["vector_store_two_streams"] = f"""
with recursive {_QA_UNITS.strip()},
{_chunks("(select item_id as doc_id, text from benchmark)", name="item_").strip()},
both_units as (select chunk_idx, chunk_type, full_text, question, answer, analysis from un
  union all select chunk_idx, 'text', chunk, null, null, null from item_ch)
select t as "table", chunk_idx, chunk_type, substr(full_text, 1, 500) as original_text, question as question_text,
       answer as answer_text, analysis as analysis_text
from both_units, (select unnest(['loads', 'compacted']) as t)"""

# Catalog

ORACLE["catalog_list"] = " union all ".join(
    f"""select '{t}' as file_id, '{t}.csv' as filename, count(*) as rows, {len(_columns(t))} as columns,
 '{",".join(n for n, d in _columns(t) if _is_numeric(d))}' as numeric_columns from {t}"""
    for t in TABLES
)
ORACLE["document_list"] = f"""
with recursive {_chunks("documents")}, n as (select doc_id, count(*) as n from ch group by doc_id)
select d.doc_id as file_id, 'doc_' || d.doc_id || '.txt' as filename, 'txt' as type, length(text)::bigint as characters,
       coalesce(n.n, 0)::int as chunks, 0::int as qa_pairs
from documents d left join n on n.doc_id = d.doc_id"""
ORACLE["catalog_summary"] = f"""
select {len(TABLES)}::bigint as csv_files, (select count(*) from documents) as document_files,
       ({" + ".join(f"(select count(*) from {t})" for t in TABLES)})::bigint as total_rows"""
ORACLE["status_counts"] = f"""
select 'table' as kind, {len(TABLES)}::bigint as n union all select 'document', count(*) from documents
union all select 'vector_store', count(distinct label) from embeddings union all select 'intent', {len(INTENTS)}"""
ORACLE["document_lookup"] = f"""
with recursive {_chunks("documents")}
select doc_id as file_id, chunk_idx, chunk from ch where doc_id = 17"""
ORACLE["sample_head"] = "select * from customer order by c_custkey limit 3"
ORACLE["sample_heads"] = """
select 'customer' as "table", c_custkey as key, to_json(c)::varchar as row from (select * from customer order by c_custkey limit 3) c
union all select 'part', p_partkey, to_json(p)::varchar from (select * from part order by p_partkey limit 3) p"""


def _report(name: str, source: str) -> str:
    columns = [n for n, _ in _columns(name)]
    return f"""select '{name}' as name, '{name}' as file_id, 'success' as status, num_rows as rows_read, {len(columns)} as columns_read,
 num_rows as rows_cleaned, {len(columns)} as columns_cleaned, fingerprint, 'csv' as type, null::varchar as error
from ({_fingerprint(source, columns)})"""


ORACLE["load_report"] = (
    _report("customer", "customer")
    + " union all " + _report("part", f"({ORACLE['clean_table']})")
    + """ union all select 'd' || doc_id, doc_id::varchar, 'success', null, null, null, null, null, 'document', null from documents
 union all select 'broken.csv', null, 'error', null, null, null, null, null, 'csv', 'no rows'"""
)
ORACLE["load_report_all_tables"] = " union all ".join(
    f"""select '{t}' as name, '{t}' as file_id, 'success' as status, count(*) as rows_read, {len(_columns(t))} as columns_read,
 'csv' as type from {t}"""
    for t in TABLES
)

# Files

ORACLE["csv_round_trip"] = """
select 'part' as file_id, p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice from part"""
ORACLE["csv_row_positions"] = """
select 'orders' as file_id, row_number() over (order by o_orderkey) - 1 as _row_index, o_orderkey, o_custkey, o_orderstatus,
       o_totalprice, o_orderpriority from orders"""
ORACLE["csv_odd_headers"] = "select p_partkey, p_name from part"
ORACLE["json_round_trip"] = "select * from customer"
ORACLE["txt_round_trip"] = f"""
with recursive {_chunks("(select item_id as doc_id, text from benchmark)")}
select 'txt' as document_type, false as has_questions, count(*) as documents,
       sum(length(text) + 1)::bigint as characters, (select count(*) from ch) as chunks
from benchmark"""
_ITEMS = """(select item_id || '.txt' as name, item_id::varchar as stem, text || chr(10) as text, 'txt' as kind from benchmark where item_id % 2 = 0
  union all select item_id || '.docx', item_id::varchar, text, 'docx' from benchmark where item_id % 2 = 1)"""
ORACLE["documents_by_dispatch"] = f"""
select name as filename, kind as document_type, 'doc_' || stem as file_id, text, null::varchar as error from {_ITEMS}
union all select 'broken.docx', null, null, null, 'BadZipFile'"""
ORACLE["documents_same_name"] = f"""
with recursive {_chunks("(select item_id as doc_id, text from benchmark)")}, n as (select doc_id, count(*) as n from ch group by doc_id)
select item_id || '.txt' as filename, 2::bigint as ids, (2 * coalesce(n, 0))::bigint as chunks, (2 * coalesce(n, 0))::bigint as vectors
from benchmark left join n on n.doc_id = item_id"""
_TABLES_READ = " union all ".join(
    f"select '{t}.csv' as name, file_id, status, rows_read, columns_read, rows_cleaned, columns_cleaned, fingerprint, type, error, "
    f"rows_read + columns_read as vectors from ({_report(t, source)})"
    for t, source in (("customer", "customer"), ("part", f"({ORACLE['clean_table']})"), ("nation", f"(select n_nationkey, {_clean('n_name')} as n_name, n_regionkey from nation)"))
)
ORACLE["load_files"] = f"""
{_TABLES_READ}
union all select 'empty.csv', 'empty', 'success', 0, {len(_columns("customer"))}, 0, {len(_columns("customer"))}, null, 'csv', null, null
union all select 'broken.csv', null, 'error', null, null, null, null, null, 'csv', 'rows have more fields than the header''s 2', null
union all select 'missing.csv', null, 'error', null, null, null, null, null, 'csv', 'no such file', null
union all select 'broken.docx', null, 'error', null, null, null, null, null, 'document', 'BadZipFile', null
union all select name, 'doc_' || stem, 'success', null, null, null, null, md5(text), 'document', null, null from {_ITEMS}"""


def _listed(name: str) -> str:
    """One row of the list of tables, as read from CSV and cleaned."""
    cleaned = {"part": ["p_partkey", "p_brand", "p_size", "p_retailprice"]}.get(name, [n for n, d in _columns(name) if _is_numeric(d)])
    return f"""select '{name}_table' as file_id, '{name} table.csv' as filename, count(*) as rows, {len(_columns(name))} as columns,
 '{",".join(cleaned)}' as numeric_columns, null::varchar as type, null::bigint as characters, null::int as chunks, null::int as qa_pairs,
 null::bigint as csv_files, null::bigint as document_files, null::bigint as total_rows from {name}"""


ORACLE["catalog_of_loads"] = f"""
with recursive {_chunks("(select name as doc_id, text from " + _ITEMS + ")")}, n as (select doc_id, count(*) as n from ch group by doc_id)
{_listed("customer")} union all {_listed("part")}
union all select 'doc_' || stem, name, null, null, null, kind, length(text)::bigint, coalesce(n, 0)::int, 0, null, null, null
  from {_ITEMS} left join n on n.doc_id = name
union all select null, null, null, null, null, null, null, null, null, 2, (select count(*) from benchmark),
  (select count(*) from customer) + (select count(*) from part)"""
ORACLE["status_of_loads"] = f"""
select 'table' as kind, 'nation' as id union all select 'vector_store', 'nation'
union all select 'document', 'doc_' || item_id from benchmark where item_id % 2 = 0
union all select 'vector_store', 'doc_' || item_id from benchmark where item_id % 2 = 0
union all select 'intent', unnest([{", ".join(f"'{i}'" for i in INTENTS)}])"""
