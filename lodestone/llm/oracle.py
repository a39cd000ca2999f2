"""SQL (DuckDB) of the training-data queries that SQL can express, over whole tables.

Written from the contracts and the methods' formulas; every statement states its result without the
operator's candidate search. Rows are numbered, so repeated ids stay apart.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _numbered(text: str) -> str:
    return f"""rows_ as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as body from documents),
docs_ as (select *, {WORDS.format(text=text)} as words from rows_)"""


def quality_rules(min_words: int, max_repeat: int, max_symbols: int, max_dup: int, mean: tuple[int, int], cutoff: float, z: float) -> str:
    return f"""
with {_numbered('body')},
grams as (
  select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram
  from (select rid, words, unnest(range(1, len(words) - 1)) as i from docs_)
),
again as (select rid, i from grams qualify count(*) over (partition by rid, gram) > 1),
covered as (select rid, count(distinct i + k) as n from again, (values (0), (1), (2)) as steps(k) group by rid),
measured as (
  select d.rid, doc_id, source, len(words) as n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines,
    coalesce(c.n, 0) as n_repeat_words
  from docs_ d left join covered c using (rid)
),
ruled as (
  select *, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words as base_failed
  from measured
),
failing as (
  select *, base_failed or 100 * n_symbols > {max_symbols} * n_words or 100 * n_dup_lines > {max_dup} * len(lines)
    or word_chars < {mean[0]} * n_words or word_chars > {mean[1]} * n_words as failed
  from ruled
),
hosts as (select source, count(*) as n, count(*) filter (failed) as f from failing group by source),
totals as (
  select sum(f) / sum(n) as m, count(*) / sum(n) as per, sum(f * (f / n)) / sum(n) as ff from hosts
),
prior as (
  select round(m, 9) as m,
    round(least(greatest(m * (1 - m) / greatest(ff - m * m - m * (1 - m) * per, 1e-9) - 1, 1.0), 10000.0), 6) as s
  from totals
),
posterior as (
  select source, (m * s + f) / (s + n) as rate, s + n + 1 as weight from hosts, prior
),
rejected as (select source, rate - {z} * sqrt(rate * (1 - rate) / weight) > {cutoff} as bad from posterior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad as kept
from failing join rejected on failing.source is not distinct from rejected.source
"""


def _strength(table: str, n: str, bad: str, mean: str) -> str:
    """Prior strength by the method of moments, between 1 and 10,000."""
    return f"""(select round(coalesce(least(greatest(
      (sum({n} * {mean} * (1 - {mean})) / sum({n}))
      / greatest((sum({n} * power({bad} / {n} - {mean}, 2)) - sum({mean} * (1 - {mean}))) / sum({n}), 1e-9) - 1,
    1.0), 10000.0), 10000.0), 6) as s from {table} where {n} > 0)"""


def url_filter(rules: tuple[tuple[str, str], ...], cutoff: float, z: float) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[1]))

    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"ends_with('.' || host, '.{host}') and starts_with(path, '{slash}{path}')"

    rule = "case " + " ".join(f"when {fits(r)} then '{r}'" for _, r in ordered) + " end"
    kind = "case rule " + " ".join(f"when '{r}' then '{k}'" for k, r in ordered) + " end"
    return f"""
with parsed as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
),
outcomes as (
  select doc_id as page_id, count(*) as n, count(*) filter (coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1) as bad
  from labels where doc_id is not null group by doc_id
),
hosts as (
  select host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain,
    string_split(host, '.')[-1] as suffix, coalesce(sum(n), 0) as n, coalesce(sum(bad), 0) as bad
  from parsed left join outcomes using (page_id) group by host
),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by domain, suffix),
suffixes as (
  select suffix, sum(n) as n, sum(bad) as bad, round(coalesce(sum(sum(bad)) over () / nullif(sum(sum(n)) over (), 0), 0), 9) as m
  from domains group by suffix
),
suffix_rates as (select suffix, (bad + s * m) / (n + s) as m from suffixes, {_strength('suffixes', 'n', 'bad', 'm')}),
shrunk_domains as (select d.*, m from domains d join suffix_rates using (suffix)),
domain_rates as (select domain, (bad + s * m) / (n + s) as m from shrunk_domains, {_strength('shrunk_domains', 'n', 'bad', 'm')}),
shrunk_hosts as (select h.*, m from hosts h join domain_rates using (domain)),
posterior as (select host, (bad + s * m) / (n + s) as rate, n + s + 1 as weight from shrunk_hosts, {_strength('shrunk_hosts', 'n', 'bad', 'm')}),
judged as (select host, round(rate - {z} * sqrt(rate * (1 - rate) / weight), 9) > {cutoff} as blocked from posterior),
ruled as (select *, {rule} as rule from parsed)
select page_id, host, path, rule, coalesce({kind}, case when blocked then 'block' else 'allow' end) as verdict
from ruled join judged using (host)
"""


CHAT_FORMAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, turn, role, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) as v(turn, role)
),
ordered as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as n
  from turns window w as (partition by conv_id order by turn nulls first, role, text)
),
sized as (
  select *, length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))
    + length(regexp_replace(text, '<(\\*\|im_(?:start|end)\|>)', '<\\\1', 'g'))
    + length(replace(regexp_replace(regexp_replace(role, '<(\\*\|im_(?:start|end)\|>)', '<\\\1', 'g'), '<(\\+n>)', '<\\\1', 'g'), chr(10), '<\n>')) as chars
  from ordered
),
prefixed as (select *, sum(chars) over (partition by conv_id order by i) as upto from sized)
select conv_id, max(n) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  sum(case when role = 'assistant' or i = n then upto else 0 end)::bigint as formatted_chars
from prefixed group by conv_id
"""


def substring_dedup(window: int) -> str:
    return f"""
with {_numbered('body')},
starts as (
  select rid, i, sha256(array_to_string(words[i : i + {window - 1}], ' ')) as held
  from (select rid, words, unnest(range(1, len(words) - {window - 2})) as i from docs_ where len(words) >= {window})
),
again as (select rid, i from starts qualify count(*) over (partition by held) > 1),
gone as (select distinct rid, unnest(range(i, i + {window})) as i from again),
places as (select rid, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from docs_),
kept as (
  select rid, count(*) as n, string_agg(word, ' ' order by i) as text from places anti join gone using (rid, i) group by rid
)
select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from docs_ left join kept using (rid)
"""


def jaccard_join(shingle: int, percent: int) -> str:
    """Copies of a set are one representative, which keeps the self-join and the walk over links small."""
    lowered = f"translate(body, '{UPPER}', '{LOWER}')"
    return f"""
with recursive {_numbered(lowered)},
sets as (
  select rid, doc_id, list_sort(list_distinct(case when len(words) between 1 and {shingle - 1} then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - {shingle - 2}), lambda i: array_to_string(words[i : i + {shingle - 1}], ' ')) end)) as held
  from docs_
),
keyed as (select *, sha256(array_to_string(held, chr(10))) as key, len(held) as n from sets),
members as (select key, n, min(doc_id) as least_id, any_value(held) as held from keyed where n > 0 group by key, n),
shingles as (select key, n, unnest(held) as s from members),
links as (
  select a.key as x, b.key as y from shingles a join shingles b on a.s = b.s and a.key <> b.key
  where 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  group by a.key, b.key, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))
),
reach(x, y) as (
  select key, key from members
  union
  select r.x, l.y from reach r join links l on r.y = l.x
),
components as (select x as key, min(least_id) as component_id from reach join members on members.key = reach.y group by x)
select doc_id, n as n_shingles, coalesce(component_id, doc_id) as component_id
from keyed left join components on keyed.key = components.key and keyed.n > 0
"""


def suffix_dedup(window: int) -> str:
    """Bytes as pairs of hexadecimal digits; windows are taken from chunks of twice their length."""
    return f"""
with rows_ as (
  select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as digits from documents
),
chunks as (
  select rid, c, substr(digits, c * {2 * window} + 1, {4 * window}) as chunk
  from (select rid, digits, unnest(range(0, length(digits) // {2 * window} + 1)) as c from rows_)
),
starts as (
  select rid, c * {window} + j as i, md5(substr(chunk, 2 * j + 1, {2 * window})) as held
  from (select rid, c, chunk, unnest(range(0, least({window}, length(chunk) // 2 - {window - 1}))) as j from chunks
    where length(chunk) >= {2 * window})
),
again as (select rid, i from starts qualify count(*) over (partition by held) > 1),
marked as (
  select rid, i, coalesce(i > lag(i) over (partition by rid order by i) + {window}, true) as opens from again
),
numbered as (select rid, i, sum(opens::int) over (partition by rid order by i) as run from marked),
runs as (select rid, min(i) as a, max(i) + {window} as b from numbered group by rid, run),
gaps as (
  select rid, coalesce(lag(b) over (partition by rid order by a), 0) as a, a as b from runs
  union all
  select rid, max(b), null from runs group by rid
  union all
  select rid, 0, null from rows_ anti join runs using (rid)
),
kept as (
  select rid, string_agg(substr(digits, 2 * a + 1, coalesce(2 * (b - a), length(digits))::bigint), '' order by a) as digits
  from gaps join rows_ using (rid) group by rid
),
spans as (select rid, count(*) as n, sum(b - a)::bigint as removed from runs group by rid)
select doc_id, length(r.digits) // 2 as n_bytes, coalesce(removed, 0) as n_removed, coalesce(n, 0) as n_spans,
  sha256(unhex(k.digits)) as kept_sha256
from rows_ r join kept k using (rid) left join spans using (rid)
"""


def phrase_mining(least: int, cover: int, top: int) -> str:
    return rf"""
with pieces_ as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
),
lists_ as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces_),
grams_ as (
  select lang, 1 as words, unnest(w) as phrase from lists_
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from lists_
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from lists_
),
f as materialized (select lang, words, phrase, count(*) as f from grams_ group by all),
totals as (select lang, sum(f) as n from f where words = 1 group by lang),
candidates as (select lang, words, phrase, f as a, string_split(phrase, ' ') as w from f where words > 1 and f >= {least}),
cuts as (
  select lang, words, phrase, a, w, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail
  from (select *, unnest(range(1, words)) as k from candidates)
),
scored as (
  select c.*, x.f as l, y.f as r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) as score
  from cuts c join f x on x.lang = c.lang and x.phrase = head join f y on y.lang = c.lang and y.phrase = tail
),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as longer from (select *, unnest([1, 2]) as i from candidates where words = 3) group by all
),
kept as (select o.* from lowest o left join inner_ i on i.lang = o.lang and i.phrase = o.phrase and o.words = 2 where longer is null or 100 * longer < {cover} * a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from ranked join totals using (lang) where rank <= {top}
"""


def spelling_variants(noise: int, min_chars: int, min_count: int, ratio: int) -> str:
    return rf"""
with recursive crc(i, c, k) as (
  select i, i, 0 from range(256) as t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8
),
crc_table as (select list(c order by i) as tab from crc where k = 8),
runs_ as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run
  from documents
),
distinct_ as (select id, run, count(*) as n, hex(encode(id || ':' || run)) as h from runs_ group by all),
hashed as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda a, b: xor(tab[1 + (xor(a, b) & 255)], a >> 8))) as crc
  from distinct_, crc_table
),
observed as (
  select case when crc % {noise} = 0 then substr(run, 1, (crc % length(run))::bigint) || substr(run, (crc % length(run))::bigint + 2) else run end as word, n from hashed
),
words_ as materialized (select word, sum(n)::bigint as n from observed where length(word) >= {min_chars} group by word having sum(n) >= {min_count}),
holes as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words_)
),
near as (
  select a.word, b.word as other, b.n as m from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select a.word, b.word, b.n from holes a join words_ b on a.rest = b.word
  union select b.word, a.word, a.n from holes a join words_ b on a.rest = b.word
),
counts as (select word, count(*) as n_near from near group by word),
best as (select word, other, m from near qualify row_number() over (partition by word order by m desc, other) = 1),
forms as (
  select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when m >= {ratio} * n then other end as form, case when m >= {ratio} * n then m end as form_n
  from words_ w left join counts using (word) left join best using (word)
),
chain(word, stop) as (select word, word from forms union all select c.word, f.form from chain c join forms f on f.word = c.stop where f.form is not null)
select f.word, f.n, f.n_near, f.form, f.form_n, c.stop as root
from forms f join chain c on c.word = f.word join forms e on e.word = c.stop where e.form is null
"""


def warc_pages(least: int) -> str:
    return f"""
select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
  case when again then 'revisit' else 'response' end as record_type, case when again then first_id end as refers_to
from (
  select *, octet_length(encode(coalesce(html, ''))) >= {least} and row_number() over same > 1 as again, first_value(page_id) over same as first_id
  from pages window same as (partition by coalesce(html, '') order by page_id nulls last)
)
"""
