"""SQL that gives the same rows as the registered queries, for DuckDB."""

from __future__ import annotations

import json

from colmap.functions import vocab
from colmap.operators import prompts
from workload import inputs
from workload.queries import DECODED, DIGITS, GRID_METHODS, TASK_WORDS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rows(*values) -> str:
    return ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in values)


def by_style(cases: list[str]) -> str:
    return "case style " + " ".join(f"when {i} then {c}" for i, c in enumerate(cases)) + " end"


def json_object(fields: dict[str, str]) -> str:
    return "json_object(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")::varchar"


# ---- shared inputs

DOCS = f"""docs as (
  select *, substr(text, length(head) + 1) as tail from (
    select *, case when n_chars % 7 > 1 then n_chars % 2 end as grade,
           cast(substr(source, 4) as int) % {inputs.STYLES} as style,
           source || '/' || lang as dataset, split_part(text, '. ', 1) as head
    from documents))"""

_raw = [json_object(s) for s in inputs.RECORD_STYLES]
_raw[6] = ("case when grade is null then json_object('body_md', text, 'lang', lang)::varchar else "
           "json_object('body_md', text, 'lang', lang, 'flag', grade)::varchar end")
RAW = f"raw as (select dataset, doc_id as row_id, {by_style(_raw)} as row from docs)"

_single = json_object({"text": "text", "label": inputs.GOOD, "text_type": "'document'",
                       "metadata": "json_object('id', doc_id)"})
_pair = json_object({"text_a": "head", "text_b": "tail", "label": inputs.GOOD,
                     "classes": "json_array('bad', 'good')", "type_of_relation": "'follows'"})
_qa = json_object({"question": "head", "answer": "tail", "metadata": "json_object('id', doc_id)"})
_gen = json_object({"input": "head", "output": "tail",
                    "data_classification_policy": "json_array('public')"})
GT = ("gt as (select dataset, doc_id as row_id, "
      f"{by_style([_single, _single, _pair, _qa, _pair, _gen, _single])} as task_data from docs)")

# the same rows without null labels
LATE = ("raw as (select dataset, row_id, regexp_replace(row, "
        "',\"(label|target|class|labels)\":null\\}$', '}') as row from allraw)")

# records that can be read; broken ones count as rows without keys
READABLE = """gt as (select w.dataset, row_id,
    case when cast(substr(d.source, 4) as int) % 3 = 0 and row_id % 11 between 1 and 4
      then '{}' else task_data end as task_data
  from whole w join documents d on d.doc_id = w.row_id)"""

# columns of the first row of each dataset
COLS = """cols as (
  select dataset, cast(unnest(range(len(ks))) as int) as pos, unnest(ks) as col, row from (
    select dataset, json_keys(arg_min(row, row_id)) as ks, arg_min(row, row_id) as row
    from raw group by dataset))"""

SYN = ("syn(fpos, field, syn) as (values "
       + rows(*[(i, f, w) for i, (f, ws) in enumerate(vocab.FIELD_SYNONYMS.items()) for w in ws])
       + ")")

# mapping in long form: field, value; the task comes last
KW = """found as (
  select dataset, fpos, field, arg_min(col, pos) as value
  from cols join syn on lower(col) = syn group by all),
kwtask as (
  select dataset, case
      when count(*) filter (where field in ('text_a', 'text_b')) > 0 then 'nli'
      else 'classification' end as task
  from (select distinct dataset from raw) left join found using (dataset) group by dataset),
kw as (
  select dataset, cast(row_number() over (partition by dataset order by fpos) - 1 as int) as pos,
         field, value
  from (select dataset, fpos, field, value from found
        union all select dataset, 99, 'task', task from kwtask))"""

PLAN = """plan as (
  select dataset, coalesce(
      string_agg('Rename(field=''' || value || ''', to_field=''' || field || ''')', ', '
                 order by pos) filter (where field <> 'task' and value <> field),
      '# No rename steps needed') as code
  from kw group by dataset)"""

MAPPING = """mapping as (
  select dataset, '{' || string_agg('"' || field || '": "' || value || '"', ', ' order by pos) || '}'
    as mapping from kw group by dataset)"""


def ctes(*names: str) -> str:
    return "with " + ", ".join(names) + "\n"


BASE = (DOCS, RAW, COLS, SYN, KW)


def is_annotation(field: str) -> str:
    return (f"({field} in ('classes', 'type_of_class', 'type_of_relation') "
            f"or {field} like '%\\_type' escape '\\')")


def overlap(n: int | None, raw: str = "raw", gt: str = "gt") -> str:
    """CTEs up to ``matches(dataset, field, pos, n_gt, col, hits)``."""
    limit = "" if n is None else f" qualify row_number() over (partition by dataset order by row_id) <= {n}"
    return f"""fields as (
  select dataset, pos, field from (
    select dataset, cast(unnest(range(len(ks))) as int) as pos, unnest(ks) as field from (
      select dataset, json_keys(arg_min(task_data, row_id)) as ks from {gt} group by dataset))
  where field not in ('metadata', 'data_classification_policy')
    and not {is_annotation('field')}),
rawn as (select * from {raw}{limit}),
gtn as (select * from {gt}{limit}),
rawc as (
  select dataset, row_id, unnest(json_keys(row)) as col, unnest(range(len(json_keys(row)))) as p,
         row from rawn),
rawv as (
  select distinct dataset, col, json_extract_string(row, '$."' || col || '"') as val from rawc),
places as (
  select dataset, col, min((row_id, p)) as place from rawc group by all),
gtv as (
  select distinct dataset, field, val from (
    select dataset, field, json_extract_string(task_data, '$."' || field || '"') as val
    from (select dataset, task_data, unnest(json_keys(task_data)) as field from gtn))
  where val is not null),
sizes as (select dataset, field, count(*) as n from gtv group by all),
hit as (
  select dataset, field, col, count(*) as hits
  from gtv join rawv using (dataset, val) group by all),
best as (
  select dataset, field, arg_min(col, place) as col, arg_min(hits, place) as hits
  from hit join sizes using (dataset, field) join places using (dataset, col)
  where hits >= greatest(1, n // 2) group by all),
matches as (
  select f.dataset, f.field, f.pos, coalesce(n, 0) as n_gt, col, coalesce(hits, 0) as hits
  from fields f left join sizes using (dataset, field) left join best using (dataset, field))"""


FALLBACK = """filled as (
  select m.dataset, m.field,
    coalesce(m.col, same.col, case when m.field in ('label', 'labels', 'target', 'answer', 'class')
                              then near.col end) as col,
    case when m.col is not null then 'values'
         when same.col is not null then 'name'
         when m.field in ('label', 'labels', 'target', 'answer', 'class')
              and near.col is not null then 'name' end as how
  from matches m
  left join places same on same.dataset = m.dataset and same.col = m.field
  left join (
    select dataset, arg_min(col, list_position(
        ['label', 'labels', 'target', 'answer', 'class'], col)) as col
    from places where col in ('label', 'labels', 'target', 'answer', 'class') group by dataset
  ) near on near.dataset = m.dataset)"""

SCORED = """truth as (
  select dataset, coalesce(list_sort(list(distinct col) filter (where col is not null)), []) as gt_cols
  from filled group by dataset),
pred as (
  select dataset, coalesce(list_sort(list(distinct value) filter (where field <> 'task')), [])
    as pred_cols from kw group by dataset),
scored as (
  select dataset, gt_cols, pred_cols, round_even(case
      when len(gt_cols) = 0 and len(pred_cols) = 0 then 1.0
      else len(list_intersect(gt_cols, pred_cols)) * 1.0
           / len(list_distinct(list_concat(gt_cols, pred_cols))) end, 3) as score
  from truth join pred using (dataset))"""

EVAL = (*BASE, GT, overlap(None), FALLBACK, SCORED)

# proposals of all methods in long form, by letters as well as by synonyms
LETTERS = f"""stdfields(fpos, field) as (values {rows(*enumerate(vocab.STANDARD_FIELDS))}),
vec as (
  select distinct name, list_transform(range(97, 123), lambda c:
    (length(lower(name)) - length(replace(lower(name), chr(c::int), '')))::double) as v
  from (select col as name from cols union select field from stdfields)),
sims as (
  select dataset, pos, col, fpos, field, list_cosine_similarity(a.v, b.v) as sim
  from cols join vec a on a.name = col, stdfields join vec b on b.name = field),
near as (
  select dataset, fpos, field, col as value from sims
  qualify row_number() over (partition by dataset, field order by sim desc, pos) = 1
    and sim >= 0.6)"""

PROPOSED = f"""neartask as (
  select dataset, case {' '.join(
    f"when count(*) filter (where field in ({', '.join(lit(k) for k in keys)})) > 0 then {lit(t)}"
    for t, keys in vocab.TASK_KEYS.items())} else {lit(vocab.DEFAULT_TASK)} end as task
  from (select distinct dataset from raw) left join near using (dataset) group by dataset),
proposed as (
  select dataset, method, pos, field, value from kw, (values ('keyword'), ('local_llm')) m(method)
  union all
  select dataset, 'embedding', row_number() over (partition by dataset order by fpos) - 1, field,
    value
  from (select * from near union all select dataset, 99, 'task', task from neartask)
  union all
  select dataset, 'ends', p, case p when 0 then 'text' else 'label' end,
    case p when 0 then arg_min(col, pos) else arg_max(col, pos) end
  from cols, (values (0), (1)) e(p) group by dataset, p having not bool_or(col = 'idx'))"""

GRID = """picked as (
  select dataset, method, coalesce(list_sort(list(distinct value) filter (where field <> 'task')), [])
    as pred_cols,
    coalesce(string_agg('Rename(field=''' || value || ''', to_field=''' || field || ''')', ', '
      order by pos) filter (where field <> 'task' and value <> field),
      '# No rename steps needed') as code,
    '{' || string_agg('"' || field || '": "' || value || '"', ', ' order by pos) || '}' as mapping
  from proposed group by all),
grid as (
  select t.dataset, m.method, case when pred_cols is not null then round_even(
      case when len(gt_cols) = 0 and len(pred_cols) = 0 then 1.0
      else len(list_intersect(gt_cols, pred_cols)) * 1.0
           / len(list_distinct(list_concat(gt_cols, pred_cols))) end, 3) end as score,
    case when pred_cols is not null then gt_cols end as gt_cols, pred_cols, mapping, code,
    case when m.method = 'api_llm' then 'ValueError: no service'
      when pred_cols is null then 'ValueError: indexed' end as error
  from truth t cross join (values """ + rows(*[(m,) for m in GRID_METHODS]) + """) m(method)
  left join picked p on p.dataset = t.dataset and p.method = m.method)"""

_wide = ", ".join(f"{{0}} filter (where method = '{m}') as {m}" for m in GRID_METHODS)
_mean = ", ".join(f"round_even(avg(score) filter (where method = '{m}'), 3)" for m in GRID_METHODS)

DOCQ = """docq as (
  select doc_id, text as body, lang, quality as target from documents join labels using (doc_id))"""

_docstd = "body as text, {label} as label, 'body' as text_type, 'english' as language"

# ---- specs

_specs = [lit(json.dumps(s)) for _, s in inputs.SPECS]
_kinds = [lit(t) for t, _ in inputs.SPECS]
SPECS = f"""specs as (
  select dataset, {by_style(_specs)} as spec, {by_style(_kinds)} as task_type from (
    select distinct source || '/' || lang as dataset,
           cast(substr(source, 4) as int) % {inputs.STYLES} as style from documents)),
defaults(dpos, field, def) as (values {rows(*[
    (i, f, d) for i, (f, d) in enumerate(vocab.SPEC_DEFAULTS.items())])}),
stated as (
  select dataset, task_type, cast(unnest(range(len(ks))) as int) as spos, unnest(ks) as field, spec
  from (select *, json_keys(spec) as ks from specs)),
spectruth as (
  select s.dataset, task_type,
    cast(row_number() over (partition by s.dataset order by coalesce(dpos, 100 + spos)) - 1 as int)
      as pos, s.field, value
  from (select *, json_extract_string(spec, '$.' || field) as value from stated
        where json_type(spec, '$.' || field) = 'VARCHAR') s
  left join defaults d on d.field = s.field
  left join cols c on c.dataset = s.dataset and c.col = s.value
  where (d.field is not null and (value <> def or c.col is not null)) or s.field like 'choice%')"""

# ---- prompts


def prompt(backend: str, note: str, extra: str, method: str, fmt: str) -> str:
    head = ("Work out the NLP task of this dataset and map its columns to standard fields.\n\n"
            "Dataset:\n- Columns: [")
    tail = (f"{extra}\n\nTask types are for example classification, nli, regression, translation, "
            "summarization.\nReply with a single valid JSON object, no explanation, no markdown."
            f"\n\n{prompts._FORMATS[backend]}\n\n{prompts._RULES}")
    return f"""select dataset, {lit(method)} as method, md5({lit(head)} || names || {lit(']' + chr(10) + '- Types: {')}
        || types || {lit('}' + chr(10) + '- Rows:' + chr(10))} || lines || {lit(tail)}) as user_md5,
      {len(prompts.SYSTEM[backend])} as system_length, {fmt} as response_format
    from dtypes join lines using (dataset)"""


DTYPES = """dtypes as (
  select dataset, string_agg('"' || col || '"', ', ' order by pos) as names,
    string_agg('"' || col || '": "' || case json_type(row, '$.' || col)
        when 'VARCHAR' then 'str' when 'UBIGINT' then 'int' when 'BIGINT' then 'int'
        when 'NULL' then 'NoneType' end || '"', ', ' order by pos) as types
  from cols group by dataset),
lines as (
  select dataset, string_agg(row, chr(10) order by row_id) as lines from (
    select * from raw qualify row_number() over (partition by dataset order by row_id) <= 5)
  group by dataset)"""

# ---- replies

_ok_strict = "(kind not in (7, 8, 9, 13))"
_ok_lenient = "(kind not in (5, 7, 8, 9, 12, 13))"


def reply(ok: str) -> str:
    js = "to_json({})::varchar"
    return f"""select doc_id, {ok} as ok,
      case when {ok} then case kind when 5 then 3 when 6 then 2 else 4 end else 0 end as n_fields,
      case when {ok} then case kind when 5 then '"nli"' when 6 then '"a}}b{{"' when 11 then '"qa"'
           else '"classification"' end end as task,
      case when {ok} and kind not in (5, 11) then {js.format('source')} end as text,
      case when {ok} and kind = 5 then {js.format('source')} end as text_a,
      case when {ok} and kind <> 6 then {js.format('lang')} end as label,
      case when {ok} then case kind when 5 then null when 6 then null
           when 11 then '{{"k": {{"z": 1}}}}' else cast(n_chars as varchar) end end as size,
      case when {ok} and kind = 11 then '["bad", "good"]' end as classes
    from (select *, doc_id % {inputs.REPLY_KINDS} as kind from documents)"""


def rename(field: str, value: str) -> str:
    return f"'Rename(field=''' || {value} || ''', to_field=''{field}'')'"


_two = f"{rename('text', 'source')} || ', ' || {rename('label', 'lang')}"

# ---- cards

_card_tasks = [
    "tasks.classification.binary", "tasks.classification.multi_class.relation", "tasks.qa.open",
    "tasks.summarization.abstractive", "tasks.regression",
]


def card_query(families: dict[str, str], second: str) -> str:
    """Expected cards: those usable in the first catalog, else the copies."""
    whens = " ".join(f"when {lit(t)} then {lit(f)}" for t, f in families.items())
    return f"""select lower(p_type) || '.' || p_partkey as card_id,
      case when fam is not null then p_name else 'copy' end as name,
      case when fam is not null and p_size > 25 then p_brand end as config,
      coalesce(fam, {second}) as task_type
    from (select *, case when p_partkey % 11 in (7, 8, 9, 10) then null else
            case case p_partkey % 5 {' '.join(f'when {i} then {lit(t)}' for i, t in enumerate(_card_tasks))} end
            {whens} end end as fam from part)
    where coalesce(fam, {second}) is not null"""


# ---- tables

def quoted_dtype() -> str:
    return """case data_type when 'INTEGER' then 'int' when 'BIGINT' then 'bigint'
      when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' when 'FLOAT[]' then 'array<float>'
      when 'TIMESTAMP' then 'timestamp_ntz' when 'TIMESTAMP_NS' then 'timestamp_ntz' end"""


COLUMN_NAMES = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
                "l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def per_column(value: str) -> str:
    parts = []
    for name, cols in COLUMN_NAMES.items():
        for c in cols.split():
            parts.append(f"select '{name}' as dataset, '{c}' as col, {value.format(c=c)} from {name}")
    return " union all ".join(parts)


def field_counts() -> str:
    chosen = [("documents", "text", 0, "text", "nli"), ("documents", "text_a", 1, "source", "nli"),
              ("embeddings", "label", 0, "label", "classification"),
              ("benchmark", "text", 0, "text", "classification"),
              ("conversations", "text", 0, "text", "classification")]
    return " union all ".join(
        f"select '{t}' as dataset, {p} as pos, '{f}' as col, count(*) as n_rows, "
        f"count({c}) as n_values, '{k}' as task from {t}" for t, f, p, c, k in chosen)


LINE_REF = """raw as (
  select 'lineitem' as dataset, row_number() over () as row_id, l_orderkey, l_partkey, l_suppkey,
    l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    l_shipdate from lineitem)"""


def typed_overlap(table: str, columns: list[str], fields: list[tuple[str, str]], name: str) -> str:
    raw = " union ".join(
        f"select {i} as place, '{c}' as col, cast({c} as varchar) as val from {table}"
        for i, c in enumerate(columns))
    gt = " union ".join(
        f"select {i} as pos, '{f}' as field, cast({e} as varchar) as val from {table}"
        for i, (f, e) in enumerate(fields))
    return f"""with rawv as (select * from ({raw}) where val is not null),
      gtv as (select * from ({gt}) where val is not null),
      sizes as (select field, pos, count(*) as n from gtv group by all),
      hit as (select field, col, place, count(*) as hits from gtv join rawv using (val) group by all),
      best as (select field, arg_min(col, place) as col, arg_min(hits, place) as hits
        from hit join sizes using (field) where hits >= greatest(1, n // 2) group by field)
      select '{name}' as dataset, field, pos, n as n_gt, col, coalesce(hits, 0) as hits
      from sizes left join best using (field)"""


ORACLES = {
    "catalog_columns": f"""
      select v.dataset, ordinal_position - 1 as pos, v.col, {quoted_dtype()} as dtype, n_rows, n_values
      from ({per_column('count(*) as n_rows, count({c}) as n_values')}) v
      join information_schema.columns c on c.table_name = v.dataset and c.column_name = v.col""",
    "catalog_cells": f"""
      select v.dataset, ordinal_position - 1 as pos, v.col, n_values
      from ({per_column('count(distinct {c}) as n_values')}) v
      join information_schema.columns c on c.table_name = v.dataset and c.column_name = v.col""",
    "row_columns": ctes(DOCS, RAW, COLS) + """
      select dataset, pos, col, case json_type(row, '$.' || col) when 'VARCHAR' then 'str'
        when 'NULL' then 'NoneType' else 'int' end as dtype from cols""",
    "split_fallback": """
      select source, lang, count(*) as n, cast(sum(n_chars) as bigint) as chars
      from documents group by all""",
    "card_discovery": card_query({
        "tasks.classification.binary": "classification",
        "tasks.classification.multi_class.relation": "nli",
        "tasks.qa.open": "qa",
        "tasks.summarization.abstractive": "generation"}, "'generation'"),
    "card_discovery_ordered": card_query({
        "tasks.classification.multi_class.relation": "nli",
        "tasks.summarization.abstractive": "generation"}, "'generation'"),
    "task_registry": """
      select p_partkey as id, p_name as name,
        case when p_size % 5 <> 0 then cast(cast(p_size as double) as varchar) end as config,
        case p_type when 'ECONOMY' then 'Classification' else 'TokenClassification' end as task_type,
        '{"sentence1": "' || p_brand || '"}' as spec
      from part where p_type in ('ECONOMY', 'MEDIUM')""",
    "seeded_sample": "select doc_id from documents order by md5('42' || doc_id) limit 20",
    "csv_sink": ctes(DOCQ) + f"""
      select {_docstd.format(label="case target when 1 then 'good' else 'bad' end")},
        {lit(str(DECODED['classes']))} as classes from docq""",
    "keyword_match": ctes(*BASE) + "select dataset, pos, field, value from kw",
    "keyword_task": ctes(*BASE) + "select dataset, task, 'ok' as status from kwtask",
    "table_fields": field_counts(),
    "embedding_match": """
      with means as (
        select label, list(x order by i) as v from (
          select label, i, avg(x::double) as x from (
            select label, unnest(range(len(embedding))) as i, unnest(embedding) as x from embeddings)
          group by all) group by label),
      sims as (
        select 'label' || e.label as dataset, 'like' || m.label as field, 'vec' || vec_id as col,
          vec_id, list_cosine_similarity(embedding::double[], v) as sim
        from embeddings e, means m),
      best as (
        select dataset, field, first(col order by sim desc, vec_id) as value, max(sim) as sim
        from sims group by all)
      select dataset, field, value from best where sim >= 0.35
      union all select distinct 'label' || label, 'task', 'classification' from embeddings""",
    "prompt_inputs": ctes(DOCS, RAW, COLS, DTYPES)
    + prompt("api", "", "\n- Note: All rows are invented.", "api_llm", "'json_object'")
    + " union all " + prompt("local", "", "", "local_llm", "null"),
    "infer_resume": ctes(*BASE) + """
      select dataset, case when list_contains(ks, 'idx') then 'RuntimeError: busy' end as first_error,
        'ok' as status, task
      from kwtask join (select dataset, list(col) as ks from cols group by dataset) using (dataset)""",
    "standardize_rows": ctes(*BASE) + """,
      std as (
        select r.dataset, row_id, field, json_extract_string(row, '$."' || value || '"') as v
        from raw r join kw using (dataset) where field <> 'task'
        union all select dataset, row_id, 'text_type', 'document' from raw
        union all select dataset, row_id, 'classes', '[''bad'', ''good'']' from raw)
      select dataset, row_id, field, md5(case when field = 'label' and v = '0' then 'bad'
        when field = 'label' and v = '1' then 'good' else v end) as value_md5 from std""",
    "embedding_names": ctes(DOCS, RAW, COLS, LETTERS) + "select dataset, field, value from near",
    "infer_stub": ctes(*BASE, PLAN, MAPPING) + """,
      refs as (
        select kw.dataset, kw.value from kw join cols
          on cols.dataset = kw.dataset and cols.col = kw.value where field <> 'task'),
      near as (select * from raw qualify row_number() over (partition by dataset order by row_id) <= 10),
      full_rows as (
        select near.dataset, row_id, bool_and(coalesce(list_contains(json_keys(row), value), true)) as ok
        from near left join refs using (dataset) group by all),
      share as (select dataset, count(*) filter (where ok) / 10 as score from full_rows group by all)
      select dataset, 'local_llm' as method, mapping, task, 'ok' as status, code, score,
        case task when 'nli' then 'tasks.classification.multi_class'
                  else 'tasks.classification.binary' end as catalog_task
      from mapping join kwtask using (dataset) join plan using (dataset) join share using (dataset)
      """,
    "infer_errors": """
      select distinct source || '/' || lang as dataset, 'api_llm' as method,
        cast(null as varchar) as task, 'failed' as status, '# Error: LLM/API failed' as code,
        'RuntimeError: no such model' as error from documents""",
    "response_extract": reply(_ok_strict),
    "response_lenient": reply(_ok_lenient),
    "response_failures": f"""
      select 'local_llm' as method, status, code, count(*) as n from (
        select case when {_ok_strict} then 'ok' else 'failed' end as status,
          case when not {_ok_strict} then '# Error: local LLM failed'
            when kind = 5 then {rename('text_a', 'source')} || ', ' || {rename('label', 'lang')}
            when kind = 6 then {rename('text', 'source')}
            when kind = 11 then {rename('label', 'lang')}
            else {_two} end as code
        from (select *, doc_id % {inputs.REPLY_KINDS} as kind from documents)
        union all select 'failed', '# Error: no features' from documents)
      group by all""",
    "task_family": """
      select doc_id, task, case lower(task) when 'nli' then 'tasks.classification.multi_class'
        when 'generation' then 'tasks.generation'
        when 'summarization' then 'tasks.summarization.abstractive'
        when 'regression' then 'tasks.regression' else 'tasks.classification.binary' end
        as catalog_task
      from (select doc_id, ['NLI', 'classification', 'Generation', 'summarization', 'qa',
                            'regression'][(doc_id % 7) + 1] as task from documents)""",
    "standardize_single": ctes(DOCQ) + f"select {_docstd.format(label='target')} from docq",
    "standardize_pair": """
      select u.text as text_a, a.text as text_b, u.conv_id as id, 'question' as text_a_type
      from conversations u join conversations a
        on a.conv_id = u.conv_id and a.turn = u.turn + 1
      where u.role = 'user' and a.role = 'assistant'""",
    "standardize_dup_ref": ctes(DOCQ) + "select body as label, doc_id as id from docq",
    "label_decode": ctes(DOCQ) + f"""
      select {_docstd.format(label="case target when 1 then 'good' else 'bad' end")},
        {lit(str(DECODED['classes']))} as classes from docq""",
    "label_out_of_range": f"""
      select vec_id as id, case when label between 0 and 6
          then {DIGITS}[label + 1] else cast(label as varchar) end as label,
        {lit(str(DIGITS))} as classes from embeddings""",
    "resolve_entries": ctes(DOCS, RAW, COLS) + """
      select d.dataset, 'hand' as method, m.pos, m.field, m.value, case
          when m.field in ('classes', 'task') then 'ignored'
          when c.col is not null and m.field <> 'text_type' then 'column'
          else 'constant' end as kind
      from (select distinct dataset from raw) d,
        (values (0, 'text', 'sentence'), (1, 'label', 'label'), (2, 'text_type', 'label'),
                (3, 'classes', 'label'), (4, 'task', 'label'), (5, 'tone', 'warm')) m(pos, field, value)
      left join cols c on c.dataset = d.dataset and c.col = m.value""",
    "rename_plan": ctes(*BASE, PLAN) + "select dataset, 'keyword' as method, code from plan",
    "taskdata_expand": ctes(DOCQ) + """
      select body as text, case target when 1 then 'good' else 'bad' end as label,
        'document' as text_type from docq""",
    "taskdata_props": "select json_extract_string(props, '$.k') as k from events",
    "taskdata_fields": ctes(DOCS, GT) + """
      select dataset, pos, field from (
        select dataset, cast(unnest(range(len(ks))) as int) as pos, unnest(ks) as field from (
          select dataset, json_keys(arg_min(task_data, row_id)) as ks from gt group by dataset))
      where field not in ('metadata', 'data_classification_policy')""",
    "value_overlap_10": ctes(DOCS, RAW, GT, overlap(10)) + "select * from matches",
    "value_overlap_full": ctes(DOCS, RAW, GT, overlap(None)) + "select * from matches",
    "value_overlap_table": typed_overlap(
        "(select doc_id, text as body, lang, quality as target from documents join labels using (doc_id))",
        ["doc_id", "body", "lang", "target"],
        [("text", "body"), ("label", "case target when 1 then 'good' else 'bad' end")],
        "doc_quality"),
    "value_overlap_lineitem": typed_overlap(
        "lineitem", COLUMN_NAMES["lineitem"].split(),
        [("order", "l_orderkey"), ("amount", "l_quantity"), ("rebate", "l_discount"),
         ("flag", "l_returnflag"), ("day", "l_shipdate")], "lineitem"),
    "overlap_malformed": ctes(DOCS, RAW, GT.replace("gt as", "whole as"), READABLE, overlap(None))
    + "select dataset, field, pos, n_gt, col, hits from matches",
    "unreadable_truth": ctes(DOCS, RAW, GT.replace("gt as", "whole as"), READABLE, overlap(None),
                             FALLBACK) + """,
      sets as (
        select dataset, coalesce(string_agg(distinct col, ',' order by col), '') as gt_cols
        from filled group by dataset),
      broken as (
        select distinct dataset from docs
        where cast(substr(source, 4) as int) % 3 = 0 and doc_id % 11 between 1 and 4)
      select d.dataset, case when b.dataset is null then coalesce(gt_cols, '') end as gt_cols,
        case when b.dataset is not null then 'ValueError: a reference record is not a JSON object'
        end as error
      from (select distinct dataset from docs) d left join sets using (dataset)
      left join broken b on b.dataset = d.dataset""",
    "label_fallback": ctes(DOCS, RAW.replace("raw as", "allraw as"), LATE, GT, overlap(None), FALLBACK)
    + "select dataset, field, col, how from filled",
    "spec_ground_truth": ctes(DOCS, RAW, COLS, SPECS)
    + "select dataset, pos, field, value from spectruth",
    "spec_unknown_columns": ctes(DOCS, "cols as (select '' as dataset, '' as col where false)", SPECS)
    + """select dataset, coalesce(string_agg(distinct value, ',' order by value), '') as gt_cols,
        case when bool_or(field = 'sentence2') then 'paired' else 'single' end as structure
      from specs left join spectruth using (dataset) group by dataset""",
    "spec_structure": ctes(DOCS, RAW, COLS, SPECS) + """
      select s.dataset as id, s.task_type || '/' || case when bool_or(field = 'sentence2')
          then 'paired' else 'single' end as type,
        coalesce(string_agg(field || '←' || value, '  ' order by pos), '') as truth,
        any_value(raw_columns) as raw_columns
      from specs s left join spectruth t on t.dataset = s.dataset
      left join (select dataset, '{' || string_agg(col, ', ' order by col) || '}' as raw_columns
                 from cols group by dataset) c on c.dataset = s.dataset
      group by s.dataset, s.task_type""",
    "presence_score": """
      with shown as (
        select event_type as dataset, event_id % 5 <> 4 as has,
          row_number() over (partition by event_type order by event_id) as r from events),
      need as (select dataset, bool_or(has and r = 1) as needed from shown group by all)
      select dataset, method, n, case method when 'empty' then 0.0
          when 'task_only' then count(*) filter (where r <= n) / n
          else count(*) filter (where r <= n and (has or not needed)) / n end as score
      from shown join need using (dataset),
        (values ('column'), ('task_only'), ('empty')) m(method),
        (values (10), (1000000)) s(n)
      group by dataset, method, n""",
    "presence_records": ctes(DOCS, RAW, COLS) + """
      select dataset, count(*) filter (where not needed or has) / 20 as score from (
        select dataset, list_contains(json_keys(row), 'flag') as has,
          dataset in (select dataset from cols where col = 'flag') as needed
        from raw qualify row_number() over (partition by dataset order by row_id) <= 20)
      group by dataset""",
    "jaccard_scores": ctes(*EVAL) + """
      select dataset, 'keyword' as method, score, array_to_string(gt_cols, ',') as gt_cols,
        array_to_string(pred_cols, ',') as pred_cols from scored""",
    "spec_scores": ctes(*BASE, SPECS, """truth as (
        select dataset, coalesce(list_sort(list(distinct value) filter (where value is not null)), [])
          as gt_cols
        from specs left join spectruth using (dataset) group by dataset)""",
                        SCORED[SCORED.index("pred as"):]) + """
      select dataset, 'keyword' as method, score, array_to_string(gt_cols, ',') as gt_cols
      from scored""",
    "task_match": f"""
      select doc_id, gt_task, pred_task,
        (regexp_matches(g, 'classification|binary|multi_class|sentiment')
          and regexp_matches(p, 'classification|binary|multi_class|sentiment'))
        or (regexp_matches(g, 'nli|entailment') and regexp_matches(p, 'nli|entailment'))
        or (regexp_matches(g, 'qa|question_answering') and regexp_matches(p, 'qa|question_answering'))
        or (regexp_matches(g, 'generation|summarization|translation')
          and regexp_matches(p, 'generation|summarization|translation'))
        or g = p as same
      from (select *, lower(gt_task) as g, lower(pred_task) as p from (
        select doc_id, {TASK_WORDS}[(doc_id % 8) + 1] as gt_task,
          {TASK_WORDS}[(n_chars % 8) + 1] as pred_task from documents))""",
    "columns_valid": ctes(*BASE, MAPPING) + """
      select dataset, mapping, true as valid from mapping
      union all
      select dataset, '{"task": "qa", "text": "text", "label": "label"}',
        count(*) filter (where col = 'text') > 0 and count(*) filter (where col = 'label') > 0
      from cols group by dataset""",
    "mapping_recall": ctes(*BASE, GT) + """
      select dataset, round_even(count(k.field) / count(*), 6) as recall, 0.0::double as without_truth
      from (
        select dataset, field from (
          select dataset, unnest(json_keys(arg_min(task_data, row_id))) as field
          from gt group by dataset)
        where field not in ('metadata', 'data_classification_policy')) f
      left join (select dataset, field from kw where field <> 'task') k using (dataset, field)
      group by dataset""",
    "eval_grid": ctes(*EVAL, LETTERS, PROPOSED, GRID)
    + "select dataset, method, score, score as struct_score, error from grid",
    "eval_report": ctes(*EVAL, LETTERS, PROPOSED, GRID) + """
      select dataset, method, coalesce(score, 0.0) as score,
        coalesce(array_to_string(gt_cols, ','), '') as gt_cols,
        coalesce(array_to_string(pred_cols, ','), '') as pred_cols,
        coalesce(mapping, '{}') as mapping, coalesce(code, '') as code, error
      from grid""",
    "score_pivot": ctes(*EVAL, LETTERS, PROPOSED, GRID)
    + f"select dataset, {_wide.format('max(score)')} from grid group by dataset",
    "score_table": ctes(*EVAL, LETTERS, PROPOSED, GRID) + f"""
      select dataset, {_wide.format('max(score)')} from grid group by dataset
      union all select 'Average', {_mean} from grid""",
    "method_average": ctes(*EVAL, LETTERS, PROPOSED, GRID)
    + "select method, round_even(avg(score), 3) as score from grid group by method",
    "stream_standardize": """
      select event_id as id, event_type as text, value as label, 'number' as label_type
      from events""",
    "stream_extract": "select event_id, props from events",
}

# typed tables: matches as above, names for what no values matched, then set similarity
_tables = {"doc_quality": "doc_id body lang target".split(),
           "lineitem": COLUMN_NAMES["lineitem"].split()}
ORACLES["eval_tables"] = f"""
with cols(dataset, pos, col) as (values {rows(*[
    (d, i, c) for d, cs in _tables.items() for i, c in enumerate(cs)])}),
m as (select * from ({ORACLES["value_overlap_table"]})
      union all select * from ({ORACLES["value_overlap_lineitem"]})),
filled as (
  select m.dataset, coalesce(m.col, same.col, case when m.field = 'label' then near.col end) as col
  from m left join cols same on same.dataset = m.dataset and same.col = m.field
  left join (select dataset, arg_min(col, list_position(
      ['label', 'labels', 'target', 'answer', 'class'], col)) as col from cols
      where col in ('label', 'labels', 'target', 'answer', 'class') group by dataset) near
    on near.dataset = m.dataset),
truth as (select dataset, list_sort(list(distinct col) filter (where col is not null)) as g
          from filled group by dataset),
syn(fpos, field, syn) as (values {rows(*[
    (i, f, w) for i, (f, ws) in enumerate(vocab.FIELD_SYNONYMS.items()) for w in ws])}),
fields(fpos, field) as (values {rows(*enumerate(vocab.STANDARD_FIELDS))}),
vec as (
  select distinct name, list_transform(range(97, 123), lambda c:
    (length(name) - length(replace(name, chr(c::int), '')))::double) as v
  from (select col as name from cols union select field from fields)),
near as (
  select dataset, field, col, list_cosine_similarity(a.v, b.v) as sim
  from cols join vec a on a.name = col, fields join vec b on b.name = field
  qualify row_number() over (partition by dataset, field order by sim desc, pos) = 1),
chosen as (
  select dataset, 'keyword' as method, arg_min(col, pos) as col
  from cols join syn on lower(col) = syn group by dataset, field
  union all select dataset, 'letters', col from near where sim >= 0.6),
pred as (select dataset, method, list(distinct col) as p from chosen group by all),
pairs as (select dataset, method from truth, (values ('keyword'), ('letters'), ('api_llm')) t(method))
select dataset, method, case when method <> 'api_llm' then round_even(
    len(list_intersect(g, coalesce(p, []))) * 1.0
    / greatest(1, len(list_distinct(list_concat(g, coalesce(p, []))))), 3) end as score,
  case when method <> 'api_llm' then array_to_string(g, ',') end as gt_cols,
  case when method = 'api_llm' then 'ValueError: no service' end as error
from pairs join truth using (dataset) left join pred using (dataset, method)"""

NEW_GT = """gt as (
  select dataset, row_id, case when dataset = (select min(dataset) from docs)
    then '{"nothing": "x"}' else task_data end as task_data from whole)"""

ORACLES.update({
    "split_corrupt": "select doc_id, lang, n_chars from documents",
    "config_pick": "select doc_id, source from documents where lang = 'de'",
    "limited_rows": "select doc_id, n_chars from documents order by n_chars, doc_id limit 150",
    "dataset_columns": "select 'docs' as name, unnest(['doc_id', 'lang', 'n_chars', 'source', "
                       "'text']) as col",
    "card_files": """
      select s_name as name, 'catalog' || pos as config,
        case s_nationkey % 3 when 0 then 'qa' else 'classification' end as task_type
      from supplier, (values (0), (1)) c(pos)
      where s_suppkey % 3 >= pos and s_nationkey % 3 < 2""",
    "card_stream": ORACLES["card_discovery"],
    "load_standardized": """
      select text, quality as label, 1.0::double as score
      from documents join labels using (doc_id)""",
    "evaluate_named": """
      select 'card' as dataset, 1.0::double as score, 'body,target' as gt_cols,
        'body,target' as pred_cols,
        '{"text": "body", "label": "target", "task": "classification"}' as mapping,
        least(100, count(*)) as n_rows
      from documents join labels using (doc_id)""",
    "row_schemas": ctes(DOCS) + """,
      cells as (
        select dataset, doc_id, 0 as p, 'text' as col, 'STRING' as kind from docs
        union all select dataset, doc_id, 1, 'n', case when doc_id % 5 = 2 then 'STRING'
          else 'BIGINT' end from docs
        union all select dataset, doc_id, 2, 'grade', case when grade is null then 'VOID'
          else 'BIGINT' end from docs
        union all select dataset, doc_id, 3, 'ok', 'BOOLEAN' from docs
        union all select dataset, doc_id, 4, 'ids', 'ARRAY<BIGINT>' from docs
        union all select dataset, doc_id, 5, 'meta', 'OBJECT<id: BIGINT>' from docs
        union all select dataset, doc_id, 6, 'late', 'STRING' from docs where doc_id % 4 = 3),
      kinds as (
        select dataset, col, min((doc_id, p)) as place,
          count(distinct kind) filter (where kind <> 'VOID') as n,
          any_value(kind) filter (where kind <> 'VOID') as kind
        from cells group by all)
      select dataset, cast(row_number() over (partition by dataset order by place) - 1 as int)
        as pos, col, case n when 0 then 'VOID' when 1 then kind else 'VARIANT' end as dtype
      from kinds""",
    "catalog_sink": ctes(*BASE) + """,
      std as (
        select r.dataset, row_id, field, json_type(row, '$."' || value || '"') as t,
          json_extract_string(row, '$."' || value || '"') as v
        from raw r join kw using (dataset) where field <> 'task'),
      named as (
        select *, case when t = 'VARCHAR' then 'STRING' when t <> 'NULL' then 'BIGINT' end as kind
        from std)
      select dataset, 'keyword' as method, row_id, field, coalesce(max(kind) over (
        partition by dataset, field), 'VOID') as dtype, kind, md5(v) as value_md5
      from named""",
    "infer_waves": ORACLES["infer_resume"],
    "stream_catalog": """
      select event_type as dataset, event_id as row_id, array_to_string(list_sort([
        'classes=[''bad'', ''good'']', 'label=' || case user_id when 0 then 'bad' when 1 then 'good'
          else user_id::varchar end, 'text=' || event_type, 'text_type=document']), ';') as fields
      from events""",
    "eval_incremental": ctes(*BASE, GT.replace("gt as", "whole as"), NEW_GT, overlap(None), FALLBACK,
                             SCORED, LETTERS, PROPOSED, GRID) + """
      select dataset, method, score, error,
        case when dataset = (select min(dataset) from docs) then 'second' else 'first' end as run
      from grid where method in ('keyword', 'ends')""",
})
