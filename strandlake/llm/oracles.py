r"""DuckDB SQL of training-data queries, written from their contracts and not from the operators' code."""

from __future__ import annotations

WARC_SQL = """with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as last from pages),
b as (select *, array_to_string(list_transform(string_split(sha1(html), ''), lambda d: printf('%04d', (bin(('0x' || d)::int))::int)), '') as bits from p)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_reduce(list_transform(string_split(substr(bits, (5 * i + 1)::int, 5), ''), lambda x: x::int), lambda a, x: 2 * a + x), 1)), '') as payload_digest,
  case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from b"""


def near_duplicates_sql(percent: int = 85) -> str:
    """Every pair of documents that share a shingle, and the closure of the links."""
    return rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select distinct doc_id, unnest(case when len(w) < 5 then [w] else list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) end) as shingle from w where len(w) > 0),
h as materialized (select doc_id, md5(array_to_string(shingle, ' ')) as h from s),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as common from h a join h b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= {percent} * (x.n + y.n - common)),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as reach from n union select r.doc_id, e.b from r join e on r.reach = e.a),
k as (select doc_id, min(reach) as component_id from r group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(k.component_id, d.doc_id) as component_id, coalesce(k.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n on n.doc_id = d.doc_id left join k on k.doc_id = d.doc_id"""


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then substr(reverse(d), i::int, 1)::int when substr(reverse(d), i::int, 1)::int > 4 then 2 * substr(reverse(d), i::int, 1)::int - 9 else 2 * substr(reverse(d), i::int, 1)::int end)) % 10 = 0"
_MOD97 = """list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: case when c between '0' and '9' then c::int else ascii(c) - 55 end),
  lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97, 0) = 1"""


def _near(words: str) -> str:
    """Whether one of the words stands within 40 code points of a match ``m`` at ``s`` of ``text``."""
    left = "lpad(substr(text, greatest(s - 41, 0)::bigint + 1, least(s, 41)::bigint), 41, ' ')"
    return f"regexp_matches(lower({left} || ' ' || rpad(substr(text, s + length(m) + 1, 41), 41, ' ')), '[^a-z](?:{words})s?[^a-z]')"


#: Kind, expression, test of a match ``m`` with digits ``d``, and the base kind that takes precedence.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", None),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 or (length(ltrim(x, '0')) = 3 and ltrim(x, '0') > '255'))) = 0", None),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length(d) between 16 and 19 and {_LUHN}", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 8 and 15", None),
    ("card_run", r"[0-9]+", f"length(d) between 15 and 16 and {_LUHN}", "card"),
    ("phone_run", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "true", "phone"),
    ("secret", r'(?i:token|key|secret|password) ?[=:] ?"[^"\s]{8,}"?', "true", None),
    ("phone_local", r"[0-9]+(?:[.-][0-9]+)*", f"regexp_full_match(m, '[0-9]{{3}}[.-][0-9]{{3}}[.-][0-9]{{4}}') and {_near('phone|telephone|call|tel|fax|mobile')}", "phone"),
    ("id_number", r"[0-9]+(?:[.-][0-9]+)*", f"regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') and {_near('ssn|social security|tax|insurance')}", "phone"),
)
#: Place of account numbers among the kinds.
_ACCOUNT = 6
#: The longest match from every place, cut at the last word end that passes (a match that ends inside a word counts last); none starts inside the one before.
_ACCOUNTS = rf"""a as (select doc_id, text, unnest(range(0, length(text)))::bigint as s from (select doc_id, coalesce(text, '') as text from documents) where regexp_matches(text, '[A-Z]{{2}}[0-9]{{2}}')),
am as (select doc_id, text, s, regexp_extract(substr(text, s + 1, 43), '^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?') as whole from a where regexp_matches(substr(text, s + 1, 4), '[A-Z]{{2}}[0-9]{{2}}')),
ac as (select doc_id, s, whole as m, case when regexp_matches(substr(text, s + 1 + length(whole), 1), '[A-Za-z0-9]') then 0 else 100 end as rank from am where whole <> ''
  union all select doc_id, s, substr(whole, 1, i), i from (select doc_id, s, whole, unnest(range(1, length(whole))) as i from am) where substr(whole, i + 1, 1) = ' ' and length(replace(substr(whole, 1, i), ' ', '')) >= 12),
ab as materialized (select doc_id, s, s + length(arg_max(m, rank)) as e from ac where {_MOD97} group by doc_id, s),
an as materialized (select x.doc_id, x.s, x.e, min(y.s) as next from ab x left join ab y on y.doc_id = x.doc_id and y.s >= x.e group by all),
ak as (select an.* from an join (select doc_id, min(s) as s from ab group by doc_id) using (doc_id, s) union all select an.* from ak join an on an.doc_id = ak.doc_id and an.s = ak.next)"""


def pii_sql() -> str:
    """Matches are marked and the text is cut at the marks; places are sums of the pieces' lengths."""
    found = []
    for n, (kind, pattern, test, _) in enumerate(_KINDS):
        k = n + (n >= _ACCOUNT)
        found.append(f"""select {k} as k, '{kind}' as kind, doc_id, s, s + length(m) as e from (
  select doc_id, text, split_part(p, chr(2), 1) as m, regexp_replace(split_part(p, chr(2), 1), '[^0-9]', '', 'g') as d,
    (sum(length(p) - (i > 1)::int) over (partition by doc_id order by i) - length(p) + (i > 1)::int)::bigint as s, i
  from (select doc_id, text, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as i
        from (select doc_id, coalesce(text, '') as text, string_split(regexp_replace(coalesce(text, ''), '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as ps from documents))) where i > 1 and {test}""")
    union = "\nunion all ".join([*found, f"select {_ACCOUNT} as k, 'iban' as kind, doc_id, s, e from ak"])
    beside = " ".join(f"when '{kind}' then '{other}'" for kind, _, _, other in _KINDS if other)
    counts = ", ".join(f"count(*) filter (kind = '{_KINDS[k][0]}') as n_{_KINDS[k][0]}" for k in range(4))
    listed = "string_agg(kind || ':' || s || ':' || e, ',' order by k, s)"
    return f"""with recursive {_ACCOUNTS},
f as materialized ({union}),
g as (select * from f where not exists (select 1 from f b where b.doc_id = f.doc_id and b.kind = case f.kind {beside} end and b.s <= f.s and f.e <= b.e)),
t as (select doc_id, {counts}, {listed} filter (k < 4) as base, {listed} as spans from g group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{_KINDS[k][0]}, 0)::bigint as n_{_KINDS[k][0]}" for k in range(4))}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join t on t.doc_id = d.doc_id"""
