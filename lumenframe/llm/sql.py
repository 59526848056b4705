"""What the queries return, said in SQL."""

from __future__ import annotations

from .mixing import PASSES, STEPS

OP1_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), r as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to
from r
"""

OP3_SQL = """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), k as (
  select doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
), f as (
  select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), m as (
  select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id <> f.keeper as gone
  from k left join f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[', '&lb;'), ']', '&rb;')"

OP8_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), p as (
  select *, (length(text) + 3) // 4 + 4 as tokens,
         row_number() over (partition by conv_id order by turn, role, text) - 1 as idx
  from t
), q as (
  select *, sum(tokens) over (partition by conv_id order by idx) as upto from p
), s as (
  select * from q where idx = 0 and role = 'system'
), b as (
  select q.conv_id, q.idx, q.role, q.text, q.tokens, q.upto - coalesce(s.tokens, 0) as fin,
         greatest(1024 - 256 - coalesce(s.tokens, 0), 256) as room
  from q left join s on q.conv_id = s.conv_id
  where not (q.idx = 0 and q.role = 'system')
), c as (
  select *, fin - tokens as start, (fin - 1) // room as slot from b
), d as (
  select *, 2 * slot + case when sum(tokens) over (partition by conv_id, slot) > room
                            then case when start < slot * room then 0 else 1 end else 1 end as win
  from c
), w as (
  select conv_id, win, min(idx) as first, min(start) as at from d group by conv_id, win
), parts as (
  select conv_id, win, role, text from d
  union all
  select w.conv_id, w.win, d.role, d.text from w join d
    on d.conv_id = w.conv_id and d.idx < w.first and d.idx >= w.first - 4 and w.at - d.start <= 256
  union all
  select s.conv_id, coalesce(w.win, 0), s.role, s.text from s left join w on s.conv_id = w.conv_id
), sizes as (
  select conv_id, sum(14 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) + 7 * count(distinct win) as formatted_chars
  from parts group by conv_id
), said as (
  select conv_id, count(*) as n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' order by idx)) as turns_sha256,
         coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as loss_chars,
         sha256(coalesce(string_agg(text, '' order by idx) filter (where role = 'assistant'), '')) as loss_sha256
  from p group by conv_id
)
select said.conv_id, n_turns, turns_sha256, loss_chars::bigint as loss_chars, loss_sha256, formatted_chars::bigint as formatted_chars
from said join sizes on said.conv_id = sizes.conv_id
"""


def _bisections(name: str, condition: str) -> str:
    """The passes of one bisection as a chain of common table expressions, ending in ``name`` (x)."""
    out = [f"{name}0 as (select 0.0::double as low, 1.0::double as high)"]
    for k in range(PASSES):
        out.append(f"""{name}g{k} as (
  select low, high, i, low + (high - low) * i / {STEPS} as x from {name}{k}, range({STEPS + 1}) r(i)
), {name}m{k} as (
  select low, high, i, x, ln(sum(pow(share, x))) - x * sum(pow(share, x) * ln(share)) / sum(pow(share, x)) as h,
         max(pow(share, x - 1)) / min(pow(share, x - 1)) as rep
  from {name}g{k}, shares group by low, high, i, x
), {name}{k + 1} as (
  select any_value(low) + (any_value(high) - any_value(low)) * greatest(coalesce(min(i) filter (where {condition}), {STEPS}) - 1, 0) / {STEPS} as low,
         any_value(low) + (any_value(high) - any_value(low)) * coalesce(min(i) filter (where {condition}), {STEPS}) / {STEPS} as high
  from {name}m{k}
)""")
    return ",\n".join(out)


def mixing_sql(target_entropy: float = 0.95, max_repetition: float = 4.0, block_tokens: int = 1_000_000, bucket_docs: int = 2048, seed: int = 17) -> str:
    draw = "('0x' || substr(md5({0} || ':' || epoch || ':' || coalesce(doc_id::varchar, '')), 1, 13))::bigint"
    goal = f"(select ln(count(*)::double) * {target_entropy} from shares)"
    return f"""
with lengths as (
  select doc_id, source, coalesce('=' || source, '') as key,
         (len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) + 1)::bigint as n_tokens
  from documents
), everything as (select sum(n_tokens)::double as n from lengths),
shares as (
  select key, sum(n_tokens)::bigint as total, count(*) as docs, sum(n_tokens) / (select n from everything) as share
  from lengths group by key
), {_bisections("e", f"h < {goal}")}, {_bisections("r", f"rep <= {max_repetition}")},
chosen as (
  select case when (select count(*) from shares) < 2 then 1.0 else greatest((select high from e{PASSES}), (select high from r{PASSES})) end as x
), weighed as (
  select key, total, docs, share, pow(share, x) / (select sum(pow(share, x)) from shares, chosen) as weight from shares, chosen
), budgeted as (select round(max(share / weight) * (select n from everything)) as budget from weighed),
planned as (
  select key, total, docs, round(weight * budget)::bigint as target,
         greatest(1, ceil(budget / {block_tokens})) as blocks from weighed, budgeted
), plan as (
  select *, target // total as whole, target - (target // total) * total as rest from planned
), drawn as (
  select l.*, p.*  exclude (key), e.epoch from lengths l join plan p on l.key = p.key,
         unnest(range(case when p.rest > 0 then p.whole + 1 else p.whole end)) as e(epoch)
), hashed as (
  select *, {draw.format(f"'{seed}'")} as draw, {draw.format(f"'{seed}/block'")} as shuffle from drawn
), placed as (
  select *, sum(n_tokens) over (partition by key, epoch order by draw, doc_id, n_tokens rows unbounded preceding) as upto from hashed
), blocked as (
  select *, floor((epoch * total + upto - n_tokens)::double / target * blocks)::bigint as block
  from placed where epoch < whole or upto <= rest
)
select doc_id, source, epoch, block,
       row_number() over (partition by block order by shuffle, key, epoch, doc_id, n_tokens) as position, n_tokens
from blocked
"""


def _tree(name: str, fanout: int, levels: int) -> str:
    """A forest's levels over ``name``0 (tree, i, d), and their runs: ``name``r0, ``name``1, ``name``r1 and so on."""
    out = []
    for k in range(levels):
        out.append(f"""{name}r{k} as (
  select tree, i // {fanout} as parent, list(d order by i) as run, max(i) as last from {name}{k}
  where tree in (select tree from {name}{k} group by tree having count(*) > 1) group by tree, i // {fanout}
), {name}{k + 1} as (
  select tree, parent as i, sha256(array_to_string(run, '')) as d from {name}r{k}
  union all select tree, i, d from {name}{k} where tree not in (select tree from {name}r{k})
)""")
    return ",\n".join(out)


def _folds(start: str, name: str, result: str, fanout: int, levels: int) -> str:
    """From ``start`` (row_no, tree, i, folded, proof): each level's siblings put to proof and folded in, ending in ``result``."""
    out, now = [], start
    for k in range(levels):
        then = f"{result}{k}" if k < levels - 1 else result
        left, right = f"array_to_string(run[1:i % {fanout}], '')", f"array_to_string(run[i % {fanout} + 2:], '')"
        out.append(f"""{then} as (
  select row_no, {now}.tree, case when run is null then i else i // {fanout} end as i,
         case when run is null then folded else sha256({left} || folded || {right}) end as folded,
         proof || case when run is null then '' else {left} || {right} end as proof
  from {now} left join {name}r{k} on {now}.tree = {name}r{k}.tree and i // {fanout} = parent
)""")
        now = then
    return ",\n".join(out)


def merkle_sql(fanout: int = 8, levels: int = 9, top_levels: int = 3) -> str:
    """Up to ``fanout ** levels`` rows of a language and ``fanout ** top_levels`` languages; CRC-32 goes bit by bit."""
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    turned = "list_reduce(list_prepend({0}, range(8)::bigint[]), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)))"
    byte = turned.format("xor(c, ascii(x)::bigint)")
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, x: {byte.replace('ascii(x)::bigint', 'x')}))"
    return f"""
with leaves as (
  select *, row_number() over () as row_no, {leaf("text")} as leaf,
         case when {crc} % 3 = 0 then {leaf(lower)} else {leaf("text")} end as tampered
  from documents
), langs as (
  select lang, row_number() over (order by lang nulls first) - 1 as tree from (select distinct lang from documents)
), placed as (
  select leaves.*, tree, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as i
  from leaves join langs on leaves.lang is not distinct from langs.lang
), a0 as (select tree, i, leaf as d from placed),
{_tree("a", fanout, levels)},
b0 as (select 0 as tree, tree as i, d from a{levels}),
{_tree("b", fanout, top_levels)},
s as (select row_no, tree, i, tampered as folded, '' as proof from placed),
{_folds("s", "a", "f", fanout, levels)},
u as (select row_no, 0 as tree, tree as i, folded, proof from f),
{_folds("u", "b", "g", fanout, top_levels)}
select doc_id, leaf, a{levels}.d as subroot, b{top_levels}.d as root, sha256(proof) as proof_sha256, folded as folded_root, folded = b{top_levels}.d as verified
from placed join g on placed.row_no = g.row_no join a{levels} on placed.tree = a{levels}.tree, b{top_levels}
"""


OP13_SQL = """
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as key,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units
  from documents
), h as (
  select *, len(units) as n, ('0x' || substr(key, 1, 8))::bigint as h1, ('0x' || substr(key, 9, 8))::bigint as h2,
         ('0x' || substr(key, 17, 8))::bigint as h3, ('0x' || substr(key, 25, 8))::bigint as h4
  from d
), c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain'
              when h4 % 100 < 50 then 'spm' else 'psm' end as form
  from h
), p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix
  from c
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL, "op3_line_dedup": OP3_SQL, "op8_chat_windows": OP8_SQL, "op9_mixing": mixing_sql(),
        "op12_merkle": merkle_sql(), "op13_fill_in_middle": OP13_SQL,
    }
