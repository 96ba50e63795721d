"""DuckDB SQL for the queries of this folder that SQL can express: it restates what they compute, by plain means."""

from __future__ import annotations

import math

from kinchart.llm import odd_sketch, repeats, repetition, secrets

WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- repetition: every window as text, no hashes ------------------------------------------------------


def _coverage(size: int) -> str:
    """Characters of the words inside windows of ``size`` words that occur twice or more in their document."""
    window = " || ' ' || ".join(f"lead(word, {k}) over w" if k else "word" for k in range(size))
    return f"""cover{size} as (
      select doc_id, count(*) as words, sum(size) as chars from words where (doc_id, i) in (
        select doc_id, i + k from (
          select doc_id, i, count(*) over (partition by doc_id, g) as n from (
            select doc_id, i, {window} as g from words window w as (partition by doc_id order by i)) where g is not null),
          (select unnest(range({size})) as k) where n > 1)
      group by 1)"""


_SIZES = (3, *repetition.LIMITS)
_SHARES = {n: f"coalesce(cover{n}.chars, 0) / cast(greatest(1, word_chars) as double)" for n in repetition.LIMITS}
REPETITION = f"""with words as (
    select doc_id, i, ws[i] as word, length(ws[i]) as size from (
      select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from (
        select doc_id, regexp_extract_all(text, '{WORD}') as ws from documents))),
  lines as (
    select doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) as size,
      row_number() over (partition by doc_id, line) as n
    from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '{WORD}')),
  repeats as (select doc_id, count(*) as n_dup, sum(size) as chars from lines where n > 1 group by 1),
  totals as (select doc_id, count(*) as n_words, sum(size) as word_chars from words group by 1),
  {", ".join(_coverage(n) for n in _SIZES)},
  base as (
    select d.doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
      length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
      coalesce(n_dup, 0) as n_dup_lines, coalesce(cover3.words, 0) as n_repeat_words,
      greatest({", ".join(_SHARES.values())}) as gram_coverage,
      coalesce(repeats.chars, 0) / cast(greatest(1, word_chars) as double) as line_coverage,
      {" or ".join(f"{share} > cast({repetition.LIMITS[n]} as double)" for n, share in _SHARES.items())} as excess
    from documents d left join totals using (doc_id) left join repeats using (doc_id)
      {" ".join(f"left join cover{n} using (doc_id)" for n in _SIZES)})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {repetition.MIN_WORDS} or 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words as base_failed,
  gram_coverage, coalesce(line_coverage, 0) as line_coverage,
  not (n_words < {repetition.MIN_WORDS} or 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words or excess
    or coalesce(line_coverage, 0) > cast({repetition.LINE_LIMIT} as double)) as kept
from base"""


# --- secrets: each window counted anew ----------------------------------------------------------------


def _found(pattern: str) -> str:
    """Rows (doc_id, start, m) of all matches: their places follow from what is left when they are cut out."""
    p = _quoted(pattern)
    return f"""select doc_id, cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as int) as start, ms[i] as m
      from (select doc_id, g, ms, unnest(range(1, len(ms) + 1)) as i from (
        select doc_id, regexp_extract_all(text, {p}) as ms, regexp_split_to_array(text, {p}) as g from documents)
        where len(ms) > 0)"""


def _all_parts(pattern: str) -> str:
    return f"len(list_filter(string_split_regex(m, '{secrets.SIGNS}'), lambda p: p <> '' and not regexp_matches(p, '{pattern}'))) = 0"


_ALLOWED = f"""regexp_matches(m, {_quoted(secrets.ALLOWED)}) or {_all_parts(secrets.WORD)}
  or (regexp_matches(m, '^[A-Za-z]') and {_all_parts(secrets.LETTERS)})"""


def _entropy(kind: secrets.CharacterClass) -> str:
    width = kind.window
    logs = [0, *[round(c * math.log2(c) * secrets.SCALE) for c in range(1, width + 1)]]
    window = f"m[i + 1:i + {width}]"
    total = f"list_sum(list_transform(list_distinct(string_split({window}, '')), lambda c: [{', '.join(map(str, logs))}][1 + {width} - length(replace({window}, c, ''))]))"
    return f"""select doc_id, start + min(i) as start, start + max(i) + {width} as "end" from (
        select doc_id, start, m, unnest(range(length(m) - {width - 1})) as i from ({_found(f"[{kind.signs}]{{{width},}}")})
        where regexp_matches(m, '[0-9]') and not ({_ALLOWED}))
      where {total} <= {kind.largest_sum()} group by doc_id, start, m"""


_ASSIGN = f"(?i){secrets.ASSIGN}"
_COVERED = """not exists (select 1 from {spans} o where o.doc_id = n.doc_id and o.start <= n.start and n."end" <= o."end")"""
SECRETS = f"""with base as (
    select doc_id, start, 0 as rank, 'assign' as kind, start + length(m) as "end" from ({_found(_ASSIGN)})
      where length(regexp_extract(m, {_quoted(_ASSIGN)}, 1)) >= {secrets.MIN_VALUE}
    union all select doc_id, start, 1, 'access', start + length(m) from ({_found(secrets.ACCESS)})
    union all select doc_id, start, 2, 'hex', start + length(m) from ({_found(secrets.HEX)})),
  first as (
    select * from base union all select doc_id, start, 3, '{secrets.CLASSES[0].kind}', "end" from (
      select * from ({_entropy(secrets.CLASSES[0])}) n where {_COVERED.format(spans="base")})),
  spans as (
    select * from first union all select doc_id, start, 4, '{secrets.CLASSES[1].kind}', "end" from (
      select * from ({_entropy(secrets.CLASSES[1])}) n where {_COVERED.format(spans="first")}))
select d.doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank) filter (rank < 3), '')) as base_sha256,
  coalesce(string_agg(kind || ':' || start || ':' || "end", ',' order by start, rank), '') as spans
from documents d left join spans s on s.doc_id = d.doc_id group by 1"""


# --- near copies: every pair of documents that share a shingle ------------------------------------------

NEAR_COPIES = f"""with recursive words as (
    select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws
    from documents),
  shingles as (
    select distinct doc_id, unnest(case when len(ws) < {odd_sketch.WORDS} then [list_aggregate(ws, 'string_agg', ' ')]
      else list_transform(range(1, len(ws) - {odd_sketch.WORDS - 2}), lambda i: list_aggregate(ws[i:i + {odd_sketch.WORDS - 1}], 'string_agg', ' ')) end) as g
    from words where len(ws) > 0),
  sizes as (select doc_id, count(*) as n from shingles group by 1),
  links as (
    select a, b from (
      select x.doc_id as a, y.doc_id as b, count(*) as shared from shingles x join shingles y on x.g = y.g and x.doc_id <> y.doc_id
      group by 1, 2)
    join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 100 * shared >= {odd_sketch.PERCENT} * (p.n + q.n - shared)),
  reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on links.a = reach.b)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id
  join (select a, min(b) as component_id from reach group by 1) c on c.a = d.doc_id"""


# --- vector codes: all distances, over vectors of 64 components ------------------------------------------

_PARTS, _ENTRIES, _ROUNDS, _WIDTH = 4, 256, 4, 16
_APART = " + ".join(f"(x.v[{i}] - b.v[{i}]) * (x.v[{i}] - b.v[{i}])" for i in range(1, _WIDTH + 1))


def _round(k: int) -> str:
    return f"""near{k} as materialized (
    select vec_id, p, min({_APART}) as d, arg_min(e, ({_APART}) * {_ENTRIES} + e) as e
    from points x join book{k} b using (p) group by 1, 2),
  means{k} as (
    select p, e, list((s - ((s % n) + n) % n) // n order by i) as v from (
      select p, e, i, cast(sum(x.v[i]) as bigint) as s, count(*) as n
      from near{k} join points x using (vec_id, p), (select unnest(range(1, {_WIDTH + 1})) as i) group by 1, 2, 3) group by 1, 2),
  book{k + 1} as materialized (select p, e, coalesce(m.v, b.v) as v from book{k} b left join means{k} m using (p, e))"""


VECTOR_CODES = f"""with kept as (
    select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  places as (select unnest(range({_PARTS})) as p),
  points as materialized (select vec_id, p, v[p * {_WIDTH} + 1:(p + 1) * {_WIDTH}] as v from kept, places),
  book0 as materialized (
    select p, e, v from points join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept) using (vec_id)
    where e < {_ENTRIES}),
  {", ".join(_round(k) for k in range(_ROUNDS + 1))},
  coded as (
    select vec_id, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{_ROUNDS} group by 1),
  labels as (select label, cast(sum(error) as bigint) as label_error from coded join kept using (vec_id) group by 1)
select c.vec_id, code, error, label_error, (
    select sha256(string_agg(x, ',' order by p, e, i)) from (
      select p, e, unnest(v) as x, unnest(range({_WIDTH})) as i from book{_ROUNDS})) as codebooks_sha256
from coded c join kept using (vec_id) join labels l on l.label is not distinct from kept.label"""


# --- fill-in-middle --------------------------------------------------------------------------------------

FILL_MIDDLE = """with drawn as (
    select doc_id, t, length(t) as n, cast(cast('0x' || h[1:8] as ubigint) % (length(t) + 1) as bigint) as h1,
      cast(cast('0x' || h[9:16] as ubigint) % (length(t) + 1) as bigint) as h2, cast('0x' || h[17:24] as ubigint) as h3,
      cast('0x' || h[25:32] as ubigint) as h4
    from (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents)),
  cut as (
    select doc_id, t, n, least(h1, h2) as a, greatest(h1, h2) as b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
        when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
  parts as (select *, substr(t, 1, a) as pre, substr(t, a + 1, b - a) as mid, substr(t, b + 1) as suf from cut)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256
from parts"""


# --- repeated strings: every string of the length by its digest -------------------------------------------

_N = repeats.LENGTH
REPEATS = f"""with texts as (
    select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
  starts as (
    select doc_id, i, md5(substr(h, 2 * i + 1, {2 * _N})) as m from (
      select doc_id, h, unnest(range(n - {_N - 1})) as i from texts where n >= {_N})),
  twice as (
    select doc_id, i, lag(i) over (partition by doc_id order by i) as before from (
      select doc_id, i, count(*) over (partition by m) as c from starts) where c > 1),
  spans as (
    select doc_id, min(i) as s, max(i) + {_N} as e from (
      select doc_id, i, sum(case when i <= before + {_N} then 0 else 1 end) over (partition by doc_id order by i) as g from twice)
    group by doc_id, g),
  pieces as (
    select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as last from spans),
  cut as (
    select doc_id, sum(e - s) as n_removed, count(*) as n_spans, max(e) as tail,
      string_agg(substr(h, 2 * last + 1, 2 * (s - last)), '' order by s) as front
    from pieces join texts using (doc_id) group by 1)
select doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(tail, 0) + 1))) as kept_sha256
from texts left join cut using (doc_id)"""

ORACLES: dict[str, str] = {
    "op6_odd_sketches": NEAR_COPIES,
    "op9_entropy_secrets": SECRETS,
    "op10_repetition_coverage": REPETITION,
    "op11_vector_codes": VECTOR_CODES,
    "op12_fill_middle": FILL_MIDDLE,
    "op13_sampled_suffixes": REPEATS,
}
