"""DuckDB SQL for the queries that SQL can express."""

_W = r"'[^\x20\x09-\x0D]+'"

_LEDGER = rf"""
with d as (select doc_id, row_number() over () as k, coalesce(text, '') as text from documents),
w as (select k, doc_id, text, regexp_extract_all(text, {_W}) as w from d),
tri as (select k, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g
        from (select k, w, unnest(generate_series(1, len(w) - 2)) as i from w)),
dup as (select k, i from (select k, i, count(*) over (partition by k, g) as n from tri) where n > 1),
rep as (select k, count(distinct p) as n_repeat_words from (select k, unnest([i, i + 1, i + 2]) as p from dup) group by k),
ln as (select k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_W})) as l from d),
m as (select doc_id, len(w) as n_words, len(array_to_string(w, '')) as word_chars,
        len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
        len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) as n_alpha_words,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[\x{{2022}}\x{{2023}}\x{{25CF}}\x{{25E6}}*\-]'))) as n_bullet_lines,
        len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|\x{{2026}})[\x20\x09-\x0D]*\z'))) as n_ellipsis_lines
      from w join ln using (k) left join rep using (k)),
b as (select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (10 * n_symbols > n_words)::int
        + 8 * (word_chars < 2 * n_words)::int + 16 * (word_chars > 15 * n_words)::int
        + 32 * (n_lines >= 10 and 2 * n_dup_lines > n_lines)::int + 64 * (10 * n_alpha_words < 8 * n_words)::int
        + 128 * (n_lines >= 3 and 10 * n_bullet_lines > 9 * n_lines)::int + 256 * (n_lines >= 3 and 10 * n_ellipsis_lines > 3 * n_lines)::int as bits from m)
"""

OP9 = (
    _LEDGER
    + """
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, (bits & 3) <> 0 as base_failed,
  (bits & 63) = 0 as kept, bits::bigint as failed_bits, 'v2' as policy
from b
"""
)

ABLATIONS = (
    _LEDGER
    + """,
r(rule, bit) as (values ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('repeated_lines', 32),
  ('few_letters', 64), ('bullets', 128), ('ellipses', 256)),
n as (select rule, count_if(bits & bit <> 0) as n_failed, count_if(bits = bit) as n_only_this, count_if(bits <> 0 and bits <> bit) as n_rejected_without
      from r, b group by rule)
select rule, n_failed::bigint as n_failed, n_only_this::bigint as n_only_this, n_rejected_without::bigint as n_rejected_without from n
"""
)

_T = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP8 = f"""
with d as (select row_number() over () as k, doc_id, coalesce({_T.format('text')}, []) as w from documents),
b as (select item_id, {_T.format('text')} as w from benchmark where item_id is not null and text is not null),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + 9], ' ') as g
       from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
dw as (select k, i, n, array_to_string(w[i:i + n - 1], ' ') as g
       from (select k, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from bw))),
hit as (select k, i, bw.n, item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
pos as (select k, count(distinct p) as n_hit from (select k, unnest(generate_series(i, i + n - 1)) as p from hit) group by k),
its as (select k, count(*) as n_items, string_agg(item, ',' order by item) as items
        from (select distinct k, item_id::varchar as item from hit) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (k) left join its using (k)
"""

_OWN = "(((rank + 1) * 48271 + 7 * 39373) % 2147483647)"
_KEY = "((" + _OWN + " + {r1} * 69621) % 2147483647 * 16807 % 2147483647 % blocks)"


def _mix() -> str:
    steps, x = [], "slots"
    for r in range(8):
        key = _KEY.format(r1=r + 1)
        steps.append(f"y{r} as (select *, ({key} - x + blocks) % blocks as y from {x})")
        bit = f"((greatest(x, y) % 2147483647 * 1103515245 + {_OWN} + {r} * 12345) % 2147483647 * 48271 % 2147483647) // 32768 % 2"
        steps.append(f"x{r} as (select rank, blocks, case when {bit} = 1 then y else x end as x from y{r})")
        x = f"x{r}"
    return ",\n".join(steps)


OP7 = rf"""
with d as (select row_number() over () as k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_W})) as size,
             md5(coalesce(doc_id::varchar, 't' || text, '')) as h from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, row_number() over (order by encode(source) nulls last) - 1 as rank from s0),
s2 as (select *, [5, 2, 1][(rank % 3 + 1)::int]::bigint as w from s1),
s3 as (select *, sum(source_size) over ()::bigint as total,
         coalesce(sum(3 * source_size) over o, 0)::bigint as capped_before, sum(w) over ()::bigint - coalesce(sum(w) over o, 0)::bigint as w_left
       from s2 window o as (order by source_size::double / w, rank rows between unbounded preceding and 1 preceding)),
s4 as (select *, (total - capped_before) * w > 3 * source_size * w_left as capped from s3),
s5 as (select rank, source, source_size, total, w, capped,
         sum(case when capped then 3 * source_size else 0 end) over ()::bigint as cap_sum, sum(case when capped then 0 else w end) over ()::bigint as free
       from s4),
s6 as (select rank, source, source_size, case when capped then (3 * source_size)::double else (total - cap_sum) * w::double / free end as target,
         (source_size + 63) // 64 as blocks from s5),
s7 as (select *, case when source_size = 0 then 0 else least(3 * blocks, floor(target * blocks / source_size + 0.5)::bigint) end as slots from s6),
slots as (select rank, blocks, unnest(generate_series(0, slots - 1)) % blocks as x from s7 where slots > 0),
{_mix()},
times as (select rank, x as index, count(*) as times from x7 group by all),
p as (select k, doc_id, size, s7.rank, source_size, target,
        sum(size) over (partition by s7.rank order by h, doc_id, size rows unbounded preceding) - size as start
      from d join s7 on d.source is not distinct from s7.source),
o as (select k, rank, start, size, unnest(generate_series(start::bigint // 64, (start + size - 1)::bigint // 64)) as index from p where size > 0),
g as (select k, sum((least((o.index + 1) * 64, start + size) - greatest(o.index * 64, start)) * times) as taken
      from o join times t on o.rank = t.rank and o.index = t.index group by k)
select p.doc_id, size::bigint as size, source_size, target, coalesce(taken, 0)::bigint as taken, source
from p left join g using (k) join (select rank, source from s7) z using (rank)
"""

OP6 = r"""
with t as (select (conv_id - ((conv_id % 2) + 2) % 2) // 2 as pair_id, ((conv_id % 2) + 2) % 2 as side, conv_id,
             role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as r
           from (select conv_id, turn, replace(coalesce(role, ''), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text
                 from conversations where conv_id is not null)),
a as (select * from t where side = 0), b as (select * from t where side = 1),
n as (select pair_id, max(r) as n, max(case when side = 0 then conv_id end) as chosen_id, max(case when side = 1 then conv_id end) as rejected_id
      from t group by pair_id),
d as (select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.r, b.r)) - 1 as k
      from a full join b on a.pair_id = b.pair_id and a.r = b.r
      where a.role is distinct from b.role or a.text is distinct from b.text group by 1),
p as (select n.*, coalesce(k, n) as k from n left join d using (pair_id)),
c as (select t.*, k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as piece,
        len(role) + 13 as head, len(text) as body from t join p using (pair_id)),
e as (select *, sum(head + body + 11) over (partition by pair_id, side order by r) - sum(case when r <= k then head + body + 11 else 0 end) over (partition by pair_id, side) as upto
      from c),
g as (select pair_id,
        string_agg(piece, '' order by r) filter (side = 0 and r <= k) as prompt,
        string_agg(piece, '' order by r) filter (side = 0 and r > k) as chosen,
        string_agg(piece, '' order by r) filter (side = 1 and r > k) as rejected,
        string_agg((upto - 11 - body)::bigint || '-' || (upto - 1)::bigint, ',' order by r) filter (side = 0 and r > k and role = 'assistant') as chosen_learn,
        string_agg((upto - 11 - body)::bigint || '-' || (upto - 1)::bigint, ',' order by r) filter (side = 1 and r > k and role = 'assistant') as rejected_learn
      from e group by pair_id)
select pair_id, chosen_id, rejected_id, k::int as n_prefix, coalesce(prompt, '') as prompt,
  case when chosen_id is not null then coalesce(chosen, '') end as chosen,
  case when rejected_id is not null then coalesce(rejected, '') end as rejected,
  case when chosen_id is not null then coalesce(chosen_learn, '') end as chosen_learn,
  case when rejected_id is not null then coalesce(rejected_learn, '') end as rejected_learn,
  chosen_learn is not null and rejected_learn is not null as usable
from p join g using (pair_id)
"""



def _licenses() -> str:
    from .op2_licenses import NOTICES

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in NOTICES.items())
    words = r"list_filter(regexp_split_to_array(lower({}), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '')"
    return f"""
with n(license_id, text) as (values {values}),
tw as (select license_id, {words.format('text')} as w from n),
ts as (select distinct license_id, array_to_string(w[i:i + 4], ' ') as g from (select license_id, w, unnest(generate_series(1, len(w) - 4)) as i from tw)),
tc as (select license_id, count(*) as n, (2 ** ceil(log2(2.5 * count(*))))::bigint as size from ts group by license_id),
d as (select row_number() over () as k, doc_id, {words.format("coalesce(text, '')")} as w from documents),
ds as (select k, i - 1 as i, len(w) - 4 as len, array_to_string(w[i:i + 4], ' ') as g from (select k, w, unnest(generate_series(1, len(w) - 4)) as i from d)),
hit as (select k, license_id, n, size, i, len, ds.g from ds join ts on ds.g = ts.g join tc using (license_id)),
win as (select distinct k, license_id, n, size, g, least(w, greatest(ceil((len - size) / (size / 2.0)), 0))::bigint as w
        from (select *, unnest([i // (size // 2), i // (size // 2) - 1]) as w from hit)),
got as (select k, license_id, n, size, w, count(*) as hits from win where w >= 0 group by all having count(*) * 10 >= n * 8),
best as (select *, row_number() over (partition by k, license_id order by hits desc, w) as r from got),
per as (select k, count(*) as c, string_agg(license_id, ',' order by license_id) as l,
          string_agg((w * (size // 2)) || '-' || (w * (size // 2) + size + 4), ',' order by license_id) as p from best where r = 1 group by k)
select doc_id, coalesce(c, 0)::bigint as n_licenses, coalesce(l, '') as licenses, coalesce(p, '') as places from d left join per using (k)
"""


ORACLE = {"op2_license_windows": _licenses(), "op6_preference_pairs": OP6, "op7_mix_blocks": OP7, "op8_wu_manber": OP8, "op9_rule_ledger": OP9, "rule_ablations": ABLATIONS}
