"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from trafficlens.llm import quality_rules as rules

_GRID = ", ".join(f"('{rule}', {j}, {c})" for rule, cutoffs in rules.GRID.items() for j, c in enumerate(cutoffs))

QUALITY = rf"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
starts as (select doc_id, unnest(range(1, len(w) - 6)) as i,
    unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as x from d where len(w) >= 8),
wins as (select doc_id, i, count(*) over (partition by doc_id, x) as c from starts),
reps as (select doc_id, cast(sum(gap) as bigint) as n from (
    select doc_id, least(8, i - lag(i, 1, -8) over (partition by doc_id order by i)) as gap from wins where c > 1) group by doc_id),
s as (select d.doc_id, stratum, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    coalesce(reps.n, 0) as n_repeat_words,
    len(ls) as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
    length(regexp_replace(text, '[^!?]', '', 'g')) as n_marks, len(list_distinct(w)) as n_distinct
  from d join l using (doc_id) left join reps using (doc_id)),
f as (select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed,
  case when n_words > 0 then n_symbols / n_words else 0 end as symbols,
  case when n_words > 0 then n_repeat_words / n_words else 0 end as repeats,
  case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_lines,
  case when word_chars > 0 then n_upper / word_chars else 0 end as shouting,
  case when n_words > 0 then n_marks / n_words else 0 end as marks,
  case when n_words > 0 then (n_words - n_distinct) / n_words else 0 end as sameness from s),
sc as (unpivot (select doc_id, stratum, base_failed, cast(symbols as double) as symbols, cast(repeats as double) as repeats,
  cast(dup_lines as double) as dup_lines, cast(shouting as double) as shouting, cast(marks as double) as marks,
  cast(sameness as double) as sameness from f) on symbols, repeats, dup_lines, shouting, marks, sameness into name rule value score),
good as (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1),
sizes as (select stratum, count(*) as good from f join good using (doc_id) where not base_failed group by stratum),
own as (select stratum from sizes where pow(1 - {rules.ALPHA}, good)
  <= {rules.DELTA} / ({len(rules.GRID)} * (select count(*) from sizes as larger where larger.good >= sizes.good))),
h as (select stratum, rule, score from sc join good using (doc_id) where not base_failed and stratum in (select stratum from own)),
grid(rule, j, cutoff) as (values {_GRID}),
tests as (select stratum, rule, j, cutoff, count(*) as n, count(*) filter (score > cutoff) as k
  from h join grid using (rule) group by all),
m as (select count(distinct stratum) * {len(rules.GRID)} as m from h),
passed as (select stratum, rule, min(cutoff) as cutoff from tests, m
  where k < n * {rules.ALPHA} and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({rules.ALPHA}) + (n - i) * ln(1 - {rules.ALPHA})))) <= {rules.DELTA} / m group by stratum, rule),
hits as (select doc_id, string_agg(sc.rule, ',' order by list_position({list(rules.GRID)}, sc.rule)) as rejected_by
  from sc join passed on passed.rule = sc.rule and passed.stratum = sc.stratum and score > cutoff group by doc_id)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by
from f left join hits using (doc_id)
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Five hex digits are four letters of base 32.
_DIGEST = " || ".join(
    f"substr('{_BASE32}', 1 + cast((cast('0x' || substr(x, {5 * i + 1}, 5) as bigint) >> {shift}) & 31 as integer), 1)"
    for i in range(8) for shift in (15, 10, 5, 0)
)

WARC = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as x from pages),
d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, {_DIGEST} as payload_digest,
  min(page_id) over (partition by html) as original from p)
select page_id, payload_bytes, payload_digest,
  case when page_id = original then 'response' else 'revisit' end as record_type,
  case when page_id <> original then original end as refers_to from d
"""

JACCARD = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as x from d),
e as (select doc_id, len(x) as n, unnest(x) as shingle from s),
pairs as (select a.doc_id as a, b.doc_id as b from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach(doc_id, other) as (select doc_id, doc_id from s union select reach.doc_id, links.b from reach join links on links.a = reach.other)
select doc_id, cast(len(x) as bigint) as n_shingles, r.component_id
from s join (select doc_id, min(other) as component_id from reach group by doc_id) r using (doc_id)
"""

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

RANKED = f"""
with d as materialized (select row_number() over () as r, doc_id, {_TERMS} as w from documents),
p as (select r, t, count(*) as tf from (select r, unnest(w) as t from d) group by r, t),
c as (select count(*) as n_docs, cast(sum(len(w)) as bigint) as total from d where len(w) > 0),
i as materialized (select row_number() over () as q, item_id, {_TERMS} as w from benchmark),
q as (select q, t, count(*) as times from (select q, unnest(w) as t from i) group by q, t),
wt as (select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as weight
  from (select t, count(*) as df from p group by t), c),
m as (select r, doc_id, 100 - 75 + ((75 * len(w) * n_docs) // total) as m from d, c where len(w) > 0),
s as (select q, r, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from q join p using (t) join wt using (t) join m using (r) group by q, r),
o as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls last) as rank
  from s join m using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from o join i using (q) where rank <= 10
"""

NEGATIVES = """
with e as materialized (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as a, a.vec_id as anchor_id, e.r, e.vec_id, a.label = e.label as same,
    cast(list_sum(list_transform(range(1, 1 + least(len(a.v), len(e.v))), lambda k: a.v[k] * e.v[k])) as bigint) as score
  from e as a join e on a.r <> e.r where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by a order by score desc, vec_id nulls last, r) as place from s where same),
n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.a, p.place order by s.score desc, s.vec_id nulls last) as rank
  from p join s on p.a = s.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where p.place <= 5)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""

EXACT = r"""
with d as (select doc_id, length(coalesce(text, '')) as n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from d window w as (partition by text_sha256 order by n desc, doc_id nulls last)
"""
