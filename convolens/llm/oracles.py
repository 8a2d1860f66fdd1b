"""DuckDB SQL for the queries that SQL can express; ids are unique in the tables that it is run on."""

QUALITY = r"""with d as (select *, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 g as (select doc_id, i, array_to_string(w[i:i+4], ' ') as gram from d, unnest(range(1, len(w) - 3)) as u(i)),
 again as (select doc_id, gram from g group by all having count(*) > 1),
 rep as (select doc_id, count(distinct i + k) as n from g join again using (doc_id, gram), unnest(range(5)) as u(k) group by doc_id),
 f as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(rep.n, 0)::bigint as n_repeat_words from d left join rep on rep.doc_id = d.doc_id),
 m as (select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, word_chars * 100 // greatest(n_words, 1) as word_length, n_symbols * 10000 // greatest(word_chars, 1) as symbol_rate, n_repeat_words * 10000 // greatest(n_words, 1) as repeat_rate,
   (len(lines) - len(list_distinct(lines))) * 10000 // greatest(len(lines), 1) as dup_line_rate from f),
 long as (select doc_id, lang, source, 'word_length' as rule, word_length as v from m union all select doc_id, lang, source, 'symbol_rate', symbol_rate from m union all select doc_id, lang, source, 'dup_line_rate', dup_line_rate from m union all select doc_id, lang, source, 'repeat_rate', repeat_rate from m),
 sh as (select *, greatest(length(bin(v)) - 6, 0) as s from long where doc_id not in (select doc_id from m where n_words < 10 or 100 * n_repeat_words > 20 * n_words)), b as (select *, 32 * s + (v >> s) as bin from sh),
 sk as (select lang, source, rule, bin, count(*) as n from b group by all),
 lev as (select 0 as lev, lang, source, rule, bin, sum(n) as n from sk group by all union all select 1, lang, null, rule, bin, sum(n) from sk group by all union all select 2, null, null, rule, bin, sum(n) from sk group by all),
 run as (select *, (bin - 32 * greatest(bin // 32 - 1, 0)) * pow(2, greatest(bin // 32 - 1, 0)) as v, sum(n) over w as upto, sum(n) over (partition by lev, lang, source, rule) as rows from lev where bin > 0 or rule in ('word_length', 'symbol_rate') window w as (partition by lev, lang, source, rule order by bin)),
 nx as (select *, lead(v) over (partition by lev, lang, source, rule order by bin) as nxt from run),
 q as (select lev, lang, source, rule, max(rows) as rows, min(v) filter (upto * 100 >= rows * 25) as q1, min(v) filter (upto * 100 >= rows * 75) as q3, min({'a': v, 'b': nxt}) filter (upto * 100 >= rows * 75 and nxt > 2 * v + 100) as gap from nx group by lev, lang, source, rule),
 sides as (select *, case when rule = 'word_length' then q1 - greatest(3 * (q3 - q1), floor(q3 / 3)) end as low,
   case when rule = 'word_length' then q3 + greatest(3 * (q3 - q1), floor(q3 / 3)) when rule = 'symbol_rate' then floor((gap.a + gap.b) / 2) else floor(q3 * q3 / q1) end as high from q),
 lim as (select g.lang, g.source, r.rule, case when x.rows >= 100 then x.low when y.rows >= 100 then y.low else z.low end as low, case when x.rows >= 100 then x.high when y.rows >= 100 then y.high else z.high end as high
   from (select distinct lang, source from sk) g cross join (select distinct rule from sk) r left join sides x on x.lev = 0 and x.rule = r.rule and x.lang is not distinct from g.lang and x.source is not distinct from g.source
   left join sides y on y.lev = 1 and y.rule = r.rule and y.lang is not distinct from g.lang left join sides z on z.lev = 2 and z.rule = r.rule),
 bad as (select distinct doc_id from long join lim on lim.lang is not distinct from long.lang and lim.source is not distinct from long.source and lim.rule = long.rule where long.v > high or long.v < low)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
   not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and doc_id not in (select doc_id from bad) as kept from m"""

MIX = """with recursive n as (select source, count(*) as n from documents group by source),
 weights as (select source, greatest(1, round(1000 * pow(n, 0.5) / sum(pow(n, 0.5)) over ()))::bigint as units from n),
 src as (select list(source order by source) as s, list(units order by source) as u, sum(units)::bigint as p from weights),
 r as (select -1::bigint as t, list_transform(u, lambda x: 0::bigint) as turn, 0::bigint as pick, s, u, p from src
  union all select t + 1, list_transform(turn, lambda k, i: case when i = x.best then k + 1 else k end), x.best, s, u, p from r,
   lateral (select list_min(list_filter(list_transform(range(1, len(u) + 1), lambda i: case when turn[i] < u[i] and turn[i] * p // u[i] <= t + 1 then {'due': ((turn[i] + 1) * p + u[i] - 1) // u[i], 'i': i} end), lambda b: b is not null)).i as best) x where t + 1 < p),
 pat as (select s[pick] as source, t as off, row_number() over (partition by pick order by t) - 1 as turn, u[pick] as units, p from r where t >= 0),
 o as (select doc_id, source, row_number() over (partition by source order by ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint, doc_id) - 1 as k from documents),
 pl as (select doc_id, o.source, k // 32 as block, k % 32 as inside, k // 32 // units * p as base, pat.* exclude (source) from o join pat on pat.source = o.source and pat.turn = k // 32 % units),
 sl as (select doc_id, source, block, inside, base + off as slot, base + turn * p // units as release, base + ((turn + 1) * p + units - 1) // units as deadline from pl),
 c as (select slot, sum(count(*)) over (order by slot) - count(*) as start from sl group by slot)
 select doc_id, source, block::bigint as block, sl.slot::bigint as slot, release::bigint as release, deadline::bigint as deadline, (start + inside)::bigint as position from sl join c on c.slot = sl.slot"""

JACCARD = r"""with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 sh as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as s from d, unnest(range(1, greatest(len(w) - 3, 2))) as u(i) where len(w) > 0),
 n as (select doc_id, count(*) as n from sh group by doc_id),
 met as (select a.doc_id as a, b.doc_id as b, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
 links as (select a, b from met join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
 reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
 comp as (select a, min(b) as c from reach group by a), deg as (select a, count(*) as k from links group by a)
 select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) as component_id, coalesce(deg.k, 0)::bigint as n_links from d left join n on n.doc_id = d.doc_id left join comp on comp.a = d.doc_id left join deg on deg.a = d.doc_id"""

_TOKENS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
DECONTAMINATE = rf"""with d as (select doc_id, {_TOKENS} as w from documents), b as (select item_id, {_TOKENS} as w from benchmark),
 win as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i+least(len(w), 10)-1], ' ') as s from b, unnest(range(1, greatest(len(w) - 8, 2))) as u(i) where len(w) > 0),
 sizes as (select distinct n from win),
 dw as (select doc_id, i, n, array_to_string(w[i:i+n-1], ' ') as s from d, sizes, unnest(range(1, len(w) - n + 2)) as u(i)),
 h as (select doc_id, i, dw.n, item_id from dw join win on win.n = dw.n and win.s = dw.s),
 r as (select doc_id, count(distinct i + k) as n_hit from h, unnest(range(n)) as u(k) group by doc_id),
 it as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from h group by doc_id),
 dt as (select doc_id, len(w) as n_words, i - 1 as p, w[i] as t from d, unnest(range(1, len(w) + 1)) as u(i)),
 bt as (select distinct w as k, len(w) as m, o - 1 as o, w[o] as t from b, unnest(range(1, len(w) + 1)) as u(o)),
 al as (select doc_id, n_words, k, m, least(m, 10) as n, greatest(least(2, least(m, 10) // 2 - 1), 0) as others, p - o as shift, list(o) as os from dt join bt using (t) group by all having count(*) >= least(m, 10) - others),
 wn as (select doc_id, n_words, n, shift + s as p0 from al, unnest(range(0, m - n + 1)) as u(s) where len(list_filter(os, lambda x: x >= s and x < s + n)) >= n - others),
 nr as (select doc_id, count(distinct p0 + k) as n_near from wn, unnest(range(n)) as u(k) where p0 + k between 0 and n_words - 1 group by doc_id)
 select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_near, 0)::bigint as n_near, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
 from d left join r on r.doc_id = d.doc_id left join it on it.doc_id = d.doc_id left join nr on nr.doc_id = d.doc_id"""

#: The published generator in numbers of 128 bits; a text's CRC-32 byte by byte from its hexadecimal form.
SHARD = """with recursive crc as (select i as n, i::bigint as c, 0 as k from range(256) t(i) union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8),
 tab as (select list(c order by n) as t from crc where k = 8),
 d as (select doc_id, coalesce(text, '') as x from documents),
 s as (select doc_id, octet_length(encode(x))::bigint + 16 as size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda p: ('0x' || p)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as text_crc32 from d, tab),
 w as (select doc_id, doc_id::hugeint as key, 0::bigint as j, 0::bigint as near, 0::bigint as grown from d
  union all select doc_id, nk, nj, case when nj < 40 then nj else near end, case when nj < 41 then nj else grown end
   from (select *, floor((grown + 1) * (2147483648.0::double / ((nk // 8589934592) + 1)::double))::bigint as nj from (select *, (key * 2862933555777941757 + 1) % 18446744073709551616 as nk from w where j < 41))),
 e as (select doc_id, near, grown from w where j >= 41)
 select s.doc_id, size, text_crc32, 'key' as law, near::int as shard, row_number() over (partition by near order by ('0x' || substr(md5(s.doc_id::varchar), 1, 15))::bigint, s.doc_id) - 1 as slot, grown::int as grown_shard from s join e on e.doc_id = s.doc_id"""

LINES = r"""with d as (select doc_id, text, string_split(text, chr(10)) as l from documents),
 p as (select doc_id, i - 1 as i, 2 as n, l[i] || chr(10) || l[i + 1] as b from d, unnest(range(1, len(l))) as u(i) where text is not null
  union all select doc_id, i - 1, 1, l[i] from d, unnest(range(1, len(l) + 1)) as u(i) where text is not null and len(list_filter(string_split_regex(l[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) > 50),
 f as (select *, min({'d': doc_id, 'i': i}) over (partition by n, b) as first from p),
 g as (select distinct doc_id, i + k as line from f, unnest(range(n)) as u(k) where (first.d <> doc_id or first.i <> i) and not (first.d = doc_id and i < first.i + n)),
 r as (select doc_id, list(line) as gone from g group by doc_id)
 select d.doc_id, coalesce(len(l), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as removed_lines,
  sha256(coalesce(case when gone is null then text else array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: not list_contains(gone, i - 1)), lambda i: l[i]), chr(10)) end, '')) as text_sha256
 from d left join r on r.doc_id = d.doc_id"""

AUDIT = r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
 f as (select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t))::int
   + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * (doc_id > min(doc_id) over (partition by t))::int as m from d),
 l as (select f.*, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic from f left join labels on labels.doc_id = f.doc_id),
 b as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as x(c, bit)),
 o as (select p.c || q.c || r.c || s.c || t.c as filter_order from b p, b q, b r, b s, b t where len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
 st as (select filter_order, i::int as step, substr(filter_order, i, 1) as letter, bit, (select coalesce(sum(y.bit), 0)::int from b y where instr(filter_order, y.c) < i) as before from o, unnest(range(1, 6)) as u(i) join b on b.c = substr(filter_order, i, 1)),
 g as (select part, filter_order, step, letter, count(*) filter (m & (bit | before) = 0) as kept, count(*) filter (m & bit <> 0 and m & before = 0) as removed, count(*) filter (m & bit <> 0 and m & before <> 0) as redundant,
   count(*) filter (m = bit) as unique_fails, count(*) filter (m & bit <> 0 and m & before = 0 and good) as good_lost, count(*) filter (m & bit <> 0 and m & before = 0 and toxic) as toxic_lost from l, st group by all)
 select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, letter)::bigint as shapley from g"""

COLLOCATIONS = r"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as s from documents),
 w as (select lang, list_filter(string_split_regex(s, '[\x20\x09]+'), lambda x: x <> '') as w from p),
 f as (select lang, k, array_to_string(w[i:i+k-1], ' ') as phrase, count(*) as f from w, unnest(range(1, 6)) as a(k), unnest(range(1, len(w) - k + 2)) as u(i) group by all),
 t as (select lang, sum(f)::hugeint as n from f where k = 1 group by lang),
 c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 100),
 inner_ as (select lang, array_to_string(w[i:i+m-1], ' ') as phrase, max(a) as most from c, unnest(range(2, k)) as x(m), unnest(range(1, k - m + 2)) as u(i) group by all),
 left_ as (select c.* from c left join inner_ i on i.lang = c.lang and i.phrase = c.phrase where i.most is null or 100 * i.most < 100 * c.a),
 cut as (select c.lang, c.phrase, c.a, x.f as l, y.f as r, t.n, q.cut, (1000 * c.a::hugeint * t.n // (x.f::hugeint * y.f::hugeint))::bigint as score from left_ c, unnest(range(1, k)) as q(cut)
   join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:q.cut], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[q.cut+1:], ' ') join t on t.lang = c.lang),
 best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
 rk as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
 select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score from rk where rank <= 2000"""
