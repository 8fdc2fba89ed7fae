"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
with docs as (select doc_id, {WORDS} as words from documents),
every as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place, len(words) as n from docs),
windows as (
  select doc_id, place, n, string_agg(word, ' ') over (partition by doc_id order by place rows between current row and 19 following) as text
  from every
),
numbered as (select doc_id, place, row_number() over (partition by text order by doc_id, place) as k from windows where place <= n - 19),
gone as (select distinct doc_id, place + j as place from numbered, range(0, 20) as t(j) where k > 1)
select docs.doc_id, count(every.place) as n_words, count(gone.place) as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by every.place) filter (where gone.place is null), '')) as kept_sha256
from docs left join every on docs.doc_id = every.doc_id
left join gone on every.doc_id = gone.doc_id and every.place = gone.place
group by docs.doc_id
"""

OP8 = rf"""
with docs as (select doc_id, source, len({WORDS}) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as number from docs group by source),
weighed as (select *, list_extract([1, 2, 3], cast(number % 3 + 1 as int)) as weight, 3 * source_size as most from sources),
level as (
  select *, sum(source_size) over () as total,
         coalesce(sum(most) over (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as below,
         sum(weight) over (order by most / weight, source nulls last rows between current row and unbounded following) as others
  from weighed
),
capped as (select *, most * others <= (total - below) * weight as is_capped from level),
targets as (
  select source, source_size, number,
         case when is_capped then cast(most as double)
              else cast(total - sum(case when is_capped then most else 0 end) over () as double) * cast(weight as double)
                   / cast(sum(case when is_capped then 0 else weight end) over () as double) end as target
  from capped
),
queue as (
  select doc_id, size, source_size, target, number,
         sum(size) over (partition by docs.source order by md5('mix:' || coalesce(cast(doc_id as varchar), 'null')), doc_id rows unbounded preceding) - size as start
  from docs join targets on docs.source is not distinct from targets.source
),
copies as (
  select doc_id, size, number, cast(start + pass * source_size as bigint) as place, (start + pass * source_size + size) / target as finish
  from queue, range(0, 3) as t(pass) where size > 0
),
mixed as (select *, cast(sum(size) over (order by finish, number, place rows unbounded preceding) as bigint) - size as begins, (select sum(size) from docs) as budget from copies),
taken as (select doc_id, cast(sum(least(size, budget - begins)) as bigint) as taken, min(begins) as begins from mixed where begins < budget group by doc_id)
select queue.doc_id, cast(size as bigint) as size, source_size, target, coalesce(taken, 0) as taken, cast(begins as bigint) as begins
from queue left join taken on queue.doc_id is not distinct from taken.doc_id
"""

OP10 = r"""
with split as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) as place
  from documents
),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from split
),
dropped as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(dropped.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where dropped.key is null), '')) as kept_sha256
from keyed left join dropped on keyed.key = dropped.key
group by doc_id
"""

OP12 = rf"""
with texts as (select row_number() over () as id, doc_id, lang, coalesce(text, '') as text from documents),
split as (select id, {WORDS} as words from texts),
every as (select id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place, len(words) as n from split),
windows as (select id, place, n, string_agg(word, ' ') over (partition by id order by place rows between current row and 4 following) as text from every),
counted as (select id, place, count(*) over (partition by id, text) as k from windows where place <= n - 4),
repeats as (select id, count(distinct place + j) as n_repeat_words from counted, range(0, 5) as t(j) where k > 1 group by id),
lines as (
  select id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select id, unnest(string_split(text, chr(10))) as line from texts) where regexp_matches(line, '[^\x20\x09-\x0D]') group by id
),
base as (
  select texts.id, doc_id, coalesce('=' || lang, '') as stratum, coalesce(len(words), 0) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
         len(regexp_extract_all(text, '\p{{Lu}}')) as n_capitals, len(regexp_extract_all(text, '\p{{P}}')) as n_punctuation
  from texts left join split using (id) left join lines using (id) left join repeats using (id)
),
facts as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         case when word_chars > 0 then 1000 * n_symbols // word_chars else 0 end as symbols, case when n_lines > 0 then 1000 * n_dup_lines // n_lines else 0 end as dup_lines,
         case when n_words > 0 then 1000 * n_repeat_words // n_words else 0 end as repeats, case when word_chars > 0 then 1000 * n_capitals // word_chars else 0 end as capitals,
         case when word_chars > 0 then 1000 * n_punctuation // word_chars else 0 end as punctuation, case when n_words > 0 then 100 * word_chars // n_words else 0 end as long_words,
         case when n_words > 0 then -(100 * word_chars // n_words) else 0 end as short_words
  from base
),
signals as (unpivot (select id, stratum, symbols, dup_lines, repeats, capitals, punctuation, long_words, short_words from facts) on symbols, dup_lines, repeats, capitals, punctuation, long_words, short_words into name signal value value),
judged as (select doc_id as label_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
labelled as (select id, stratum, quality > 0 as good, md5(label_id::varchar) < '8' as fit from facts join judged on doc_id = label_id where not base_failed),
fitted as (
  select stratum, signal, value, count(*) over (partition by stratum, signal) as n,
         count(*) over (partition by stratum, signal order by value desc groups between unbounded preceding and 1 preceding) as above
  from signals join labelled using (id, stratum) where good and fit
),
marks as (
  select stratum, signal, min(value) filter (where above <= 0) as top, min(value) filter (where above <= 0.5 * n) as middle,
         min(value) filter (where above <= 0.001 * n) as s1, min(value) filter (where above <= 0.002 * n) as s2, min(value) filter (where above <= 0.005 * n) as s3,
         min(value) filter (where above <= 0.01 * n) as s4, min(value) filter (where above <= 0.02 * n) as s5
  from fitted group by stratum, signal
),
cutoffs as (
  select stratum, signal, unnest([top + ceil(1.0 * (top - middle))::bigint, top + ceil(0.25 * (top - middle))::bigint, top, s1, s2, s3, s4, s5]) as cutoff, unnest(range(0, 8)) as level
  from marks
),
met as (
  select labelled.id, labelled.stratum, good, fit, coalesce(min(level) filter (where value > cutoff), 8) as level
  from labelled join signals using (id) join cutoffs on cutoffs.stratum = labelled.stratum and cutoffs.signal = signals.signal group by all
),
counts as (
  select stratum, g.level, count(*) filter (where good and not fit and met.level <= g.level) as n_lost, count(*) filter (where good and not fit) as n_good,
         coalesce(count(*) filter (where not good and fit and met.level <= g.level) / nullif(count(*) filter (where not good and fit), 0), 0)
         - 5.0 * coalesce(count(*) filter (where good and fit and met.level <= g.level) / nullif(count(*) filter (where good and fit), 0), 0) as gain
  from met, range(0, 8) as g(level) group by stratum, g.level
),
tested as (
  select *, case when n_lost >= 0.05 * n_good then 1.0 else list_sum(list_transform(range(0, n_lost + 1), lambda i:
              exp(lgamma(n_good + 1) - (case when i > 0 then lgamma(i + 1) else 0 end) - (case when n_good > i then lgamma(n_good - i + 1) else 0 end) + i * ln(0.05) + (n_good - i) * ln(0.95)))) end as tail,
         count(distinct stratum) over () as strata
  from counts
),
usable as (select *, max(case when tail > 0.05 / strata then 1 else 0 end) over (partition by stratum order by level) = 0 as passed from tested),
chosen as (select stratum, arg_max(level, gain * 1000000 - level / 1000) as level from usable where passed and gain > 0 group by stratum),
rejects as (
  select id, string_agg(signal, ',' order by list_position(['symbols', 'dup_lines', 'repeats', 'capitals', 'punctuation', 'long_words', 'short_words'], signal)) as rejected_by
  from signals join chosen using (stratum) join cutoffs using (stratum, level, signal) where value > cutoff group by id
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rejected_by is null as kept, coalesce(rejected_by, '') as rejected_by
from facts left join rejects using (id)
"""

OP13 = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as place
  from conversations where conv_id is not null
),
-- CRC-32 of the decimal number, bit by bit: each byte is taken in before the first of its eight steps.
bits as (
  select conv_id, conv_id - conv_id % 100 as donor,
         [4294967295] || [case when i % 8 = 0 then ord(substr(conv_id::varchar, (i // 8 + 1)::int, 1)) else 0 end for i in range(0, 8 * length(conv_id::varchar))]::bigint[] as steps
  from (select distinct conv_id from turns)
),
heads as (
  select conv_id, donor, xor(list_reduce(steps, lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 6 as h from bits
),
rebuilt as (
  select heads.conv_id, place, role, text from heads join turns on turns.conv_id = heads.donor where place < h
  union all
  select heads.conv_id, place, role, text from heads join turns using (conv_id) where place >= h
),
numbered as (select *, row_number() over (partition by conv_id order by place) as depth from rebuilt),
members as (
  select conv_id, depth, length(text) as size, string_agg(md5(length(role)::varchar || ':' || role || text), '') over (partition by conv_id order by depth) as prefix from numbered
  union all
  select conv_id, 0, 0, '' from heads
),
whole as (select conv_id, max(depth) as n from members group by conv_id),
nodes as (
  select prefix, any_value(depth) as depth, any_value(size) as size, min(conv_id) as least, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = n), '')) as ends_sha256
  from members join whole using (conv_id) group by prefix
),
children as (select left(prefix, length(prefix) - 32) as prefix, count(*) as n_children from nodes where depth > 0 group by 1),
sums as (
  select above.prefix, sum(case when n_children is null then 1 else 0 end) as n_leaves, sum((nodes.n_convs - 1) * nodes.size) as saved_tokens
  from nodes left join children using (prefix) join members above on above.conv_id = nodes.least and above.depth <= nodes.depth group by above.prefix
)
select nodes.least as conv_id, nodes.depth::bigint as depth, parent.least as parent_conv_id, nodes.n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves,
       saved_tokens::bigint as saved_tokens, nodes.ends_sha256
from nodes join sums using (prefix) left join children using (prefix)
left join nodes parent on nodes.depth > 0 and parent.prefix = left(nodes.prefix, length(nodes.prefix) - 32)
"""
