"""DuckDB SQL for the operators that SQL can express."""

from .license_texts import LICENSES, SPELLINGS, whole_texts

LINE_DEDUP = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place
  from documents where text is not null),
ink as (select *, doc_id * 1000000 + place as pos from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
d as (select line, min(pos) as pos, length(line) as n from ink group by line),
s as (select *, unnest([n, n - 1]) as short from d where n >= 20),
k as (
  select line, pos, n, unnest(['p' || short || '|' || substring(line, 1, short // 2), 's' || short || '|' || substring(line, n - (short - short // 2) + 1, short - short // 2)]) as half
  from s),
c as (select distinct x.pos, x.line, x.n, y.line as other, y.n as m from k x join k y on x.half = y.half and y.pos < x.pos and abs(x.n - y.n) <= 1),
p as (
  select *, coalesce(list_position([substring(line, i, 1) <> substring(other, i, 1) for i in generate_series(1, least(n, m))], true) - 1, least(n, m)) as same
  from c),
edited as (
  select distinct pos from p
  where (n = m and substring(line, same + 2) = substring(other, same + 2)) or (n = m + 1 and substring(line, same + 2) = substring(other, same + 1)) or (m = n + 1 and substring(line, same + 1) = substring(other, same + 2))),
gone as (select i.doc_id, i.place from ink i join d using (line) where i.pos > d.pos or d.pos in (select pos from edited)),
t as (
  select l.doc_id, count(*) as n_lines, count(g.place) as n_dropped, coalesce(string_agg(l.line, chr(10) order by l.place) filter (g.place is null), '') as kept
  from l left join gone g on l.doc_id = g.doc_id and l.place = g.place group by l.doc_id)
select doc_id, case when coalesce(text, '') = '' then 0 else n_lines end as n_lines, coalesce(n_dropped, 0) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256
from documents left join t using (doc_id)
"""


def _canonical(text: str) -> str:
    out = rf"regexp_replace(lower({text}), '(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$', ' ', 'g')"
    out = rf"' ' || trim(regexp_replace({out}, '[^a-z0-9\x{{80}}-\x{{10ffff}}]+', ' ', 'g')) || ' '"
    for spelling, usual in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{usual}')"
    return f"trim({out})"


_KNOWN = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in LICENSES + whole_texts() if k)
LICENSE_SCAN = f"""
with known as (
  select sha256({_canonical("t")}) as digest, min(license_id) as license_id from (values {_KNOWN}) v(license_id, t) group by 1),
d as (select doc_id, coalesce(text, '') as text, sha256({_canonical("coalesce(text, '')")}) as digest from documents),
n as (
  select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
  join known on sha256({_canonical("line")}) = known.digest
  group by doc_id)
select d.doc_id, d.digest, known.license_id, coalesce(notices, '') as notices
from d left join known using (digest) left join n on d.doc_id = n.doc_id
"""

#: crc32 of each distinct word byte by byte, from the table of the reversed polynomial; DuckDB's hex() gives the UTF-8 bytes.
IMPORTANCE = r"""
with recursive step as (
  select i as first, i as c, 0 as k from range(256) t(i)
  union all select first, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by first) as lut from step where k = 8),
w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from documents),
q as (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
d as (select distinct word from (select word from w union all select word from q)),
b as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(word)) + 1), lambda i: ('0x' || substr(hex(word), 2 * i - 1, 2))::bigint)),
    lambda c, x: xor(c >> 8, lut[xor(c, x) % 256 + 1])), 4294967295) % 10000 as bucket
  from d, crc),
s as (select bucket, count(*) as s from w join b using (word) group by bucket),
t as (select bucket, count(*) as t from q join b using (word) group by bucket),
g as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from w) + 10000)::double / ((coalesce(s, 0) + 1)::double * ((select count(*) from q) + 10000)::double)))::bigint as gain
  from s full join t using (bucket)),
f as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from w join b using (word) join g using (bucket) group by doc_id),
a as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents left join f using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from a where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from r) then rank end as rank
from a left join r using (doc_id)
"""

FILTER_AUDIT = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
x as (
  select doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by text), false)] as fails
  from t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by doc_id),
m as (select part, fails, count(*) as n, count(*) filter (good = 1) as good, count(*) filter (bad = 1) as bad from x left join l using (doc_id) group by all),
f as (select unnest([1, 2, 3, 4, 5]) as f),
o as (
  select [a.f, b.f, c.f, d.f, e.f] as o from f a, f b, f c, f d, f e where a.f not in (b.f, c.f, d.f, e.f) and b.f not in (c.f, d.f, e.f) and c.f not in (d.f, e.f) and d.f <> e.f),
s as (
  select part, list_aggregate(list_transform(o, lambda i: chr(64 + i)), 'string_agg', '') as filter_order, step::int as step, o[step] as letter, n, good, bad, fails[o[step]] as failed,
    list_bool_or(list_transform(o[1:step - 1], lambda i: fails[i])) as earlier, len(list_filter(fails, lambda b: b)) as many
  from m, o, unnest([1, 2, 3, 4, 5]) u(step)),
r as (
  select part, filter_order, step, letter, coalesce(sum(n) filter (not failed and not coalesce(earlier, false)), 0)::bigint as kept, coalesce(sum(n) filter (failed and not coalesce(earlier, false)), 0)::bigint as removed,
    coalesce(sum(n) filter (failed and earlier), 0)::bigint as redundant, coalesce(sum(n) filter (failed and many = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (failed and not coalesce(earlier, false)), 0)::bigint as good_lost, coalesce(sum(bad) filter (failed and not coalesce(earlier, false)), 0)::bigint as toxic_lost
  from s group by all)
select * exclude (letter), (sum(removed) over (partition by part, letter))::bigint as shapley from r
"""
