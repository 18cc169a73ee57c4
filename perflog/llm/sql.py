"""DuckDB SQL of the operators that SQL can express on whole tables in seconds."""

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

_RULES = ("base", "short", "repeated", "duplicate_lines", "symbols")
_POSTERIOR = ("(n_{0} + mean_{0} * s_{0}) / (n_docs + s_{0})")
_STRENGTH = "greatest(1.0, least(1000.0, case when var_{0} > 0 then mean_{0} * (1 - mean_{0}) / var_{0} - 1 else 1000.0 end)) as s_{0}"

HOST_RULES = rf"""
with w as (select row_number() over () as id, doc_id, source, coalesce(text, '') as text, {WORDS} as ws from documents),
g as (select id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as gram
      from (select id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
r as (select id, count(distinct i + k) as n from (select id, i, count(*) over (partition by id, gram) as c from g), range(0, 3) t(k)
      where c > 1 group by id),
l as (select id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from w),
f as (select w.id, doc_id, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
        cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words
      from w join l using (id) left join r using (id)),
x as (select *, n_words < 50 as f_short, 100 * n_repeat_words > 50 * n_words as f_repeated, 100 * n_symbols > 10 * word_chars as f_symbols,
        100 * n_dup_lines > 30 * n_words as f_duplicate_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as f_base from f),
h as (select source, count(*) as n_docs, {', '.join(f"cast(sum(cast(f_{k} as int)) as double) as n_{k}" for k in _RULES)} from x group by source),
m as (select {', '.join(f"avg(n_{k} / n_docs) as mean_{k}, var_samp(n_{k} / n_docs) as var_{k}" for k in _RULES)} from h),
p as (select *, {' and '.join(f"rate_{k} <= least(0.5, greatest(0.2, 4 * mean_{k}))" for k in _RULES)} as host_kept from (
      select source, n_docs, {', '.join(f"{_POSTERIOR.format(k)} as rate_{k}, mean_{k}" for k in _RULES)}
      from h, (select *, {', '.join(_STRENGTH.format(k) for k in _RULES)} from m)))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base as base_failed, not f_base and host_kept as kept, host_kept,
  n_docs as host_docs, {', '.join(f"round(rate_{k}, 6) as host_rate_{k}" for k in _RULES)}
from x join p on x.source is not distinct from p.source
"""

WINDOW_DEDUP = rf"""
with w as (select row_number() over () as id, doc_id, {WORDS} as ws from documents),
g as (select id, doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') as gram
      from (select id, doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) > 12)),
d as (select id, i from (select id, i, doc_id, min(doc_id) over (partition by gram) as least from g) where doc_id > least or (doc_id is null and least is not null)),
c as (select distinct id, i + k as at from d, range(0, 13) t(k)),
t as (select id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
k as (select t.id, string_agg(word, ' ' order by i) as kept, count(*) as n from t anti join c on c.id = t.id and c.at = t.i group by t.id)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join k using (id)
"""

NGRAM_JOIN = rf"""
with recursive w as (select row_number() over () as id, doc_id,
    list_transform({WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ws from documents),
s as (select distinct id, gram from (
        select id, array_to_string(list_slice(ws, i, i + 4), ' ') as gram from (select id, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) > 4)
        union all select id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4)),
n as (select id, count(*) as n from s group by id),
p as (select a.id as a, b.id as b, count(*) as shared from s a join s b on a.gram = b.gram and a.id < b.id group by all),
e as (select a, b from p join n x on x.id = a join n y on y.id = b where 100 * shared >= 80 * (x.n + y.n - shared)),
u as (select a, b from e union all select b, a from e),
reach as (select id as x, id as y from n union select reach.x, u.b from reach join u on u.a = reach.y),
c as (select x, min(doc_id) as component_id from reach join w on w.id = reach.y group by x)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, case when n.n is null then doc_id else component_id end as component_id
from w left join n using (id) left join c on c.x = w.id
"""

COLLOCATIONS = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
n as (select lang, sum(len(ws)) as n from w group by lang),
g as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase
      from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from w, range(1, 6) r(m) where len(ws) >= m)),
f as (select lang, m, phrase, count(*) as a from g group by all having count(*) >= 100),
p as (select lang, m, phrase, a, string_split(phrase, ' ') as ws from f where m > 1),
c as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as x, array_to_string(ws[k + 1:], ' ') as y
      from (select *, unnest(range(1, m)) as k from p)),
s as (select c.lang, c.phrase, c.a, c.k, l.a as l, r.a as r, n.n, cast(1000 as hugeint) * c.a * n.n // (cast(l.a as hugeint) * r.a) as score
      from c join f l on c.lang = l.lang and c.x = l.phrase join f r on c.lang = r.lang and c.y = r.phrase join n on c.lang = n.lang),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as best from s) where best = 1),
o as (select lang, phrase, max(a) as most from (
        select lang, a, array_to_string(ws[i:i + j - 1], ' ') as phrase from (
          select *, unnest(range(1, m - j + 2)) as i from (select *, unnest(range(2, m)) as j from p where m > 2))) group by all),
k as (select b.* from b left join o using (lang, phrase) where most is null or 100 * most < 100 * b.a),
t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from t where rank <= 2000
"""


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


def _levels(name: str, leaves: str) -> str:
    return f"""{name}(k, level, i, d, n) as (select k, 0, i, d, n from {leaves} union all
  select k, level + 1, i // 3, sha256(string_agg(d, '' order by i)), any_value((n + 2) // 3) from {name} where n > 1 group by k, level, i // 3)"""


def _path(rows: str, nodes: str) -> str:
    return f"""select x.id, t.level, coalesce(string_agg(t.d, '' order by t.i) filter (where t.i < x.i // pow(3, t.level)::bigint), '') as before,
  coalesce(string_agg(t.d, '' order by t.i) filter (where t.i > x.i // pow(3, t.level)::bigint), '') as after
from {rows} x join {nodes} t on x.k = t.k and t.n > 1 and t.i // 3 = x.i // pow(3, t.level + 1)::bigint group by x.id, t.level"""


MERKLE = f"""
with recursive h as (select row_number() over () as id, doc_id, coalesce('=' || source, '-') as k, {_leaf('text')} as leaf,
        case when doc_id is not null and {_CRC} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} else {_leaf('text')} end as claimed from documents),
v as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as i, leaf as d, count(*) over (partition by k) as n from h),
{_levels('t', 'v')},
s as (select row_number() over (order by k) as id, '' as k, k as source, row_number() over (order by k) - 1 as i, d, count(*) over () as n from t where n = 1),
{_levels('u', 's')},
a as ({_path('v', 't')}), b as ({_path('s', 'u')}),
q as (select a.id, level as step, before, after from a union all
      select v.id, 1000 + level, before, after from v join s on v.k = s.source join b on b.id = s.id),
z as (select id, string_agg(before || after, '' order by step) as proof, list(before || '|' || after order by step) as steps from q group by id)
select doc_id, leaf, s.d as subroot, w.d as root, sha256(coalesce(proof, '')) as proof_sha256,
  list_reduce(list_prepend(claimed, coalesce(steps, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) as folded_root,
  folded_root = w.d as verified
from v join s on v.k = s.source left join z on v.id = z.id, (select d from u where n = 1) w
"""
