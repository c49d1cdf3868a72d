"""DuckDB statements for the operators that SQL expresses."""

from __future__ import annotations

from quillmesh.llm import quality_rules, secrets

_ROWS = "select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(source, chr(0)) as owner from documents"


def _quality() -> str:
    bits = " + ".join(f"case when {rule} then {1 << k} else 0 end" for k, rule in enumerate(quality_rules.RULES.values()))
    base = quality_rules.policy_mask(quality_rules.BASE)
    policy = quality_rules.policy_mask(quality_rules.POLICIES["v2"])
    return f"""
with d as ({_ROWS}),
cut as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
               list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
word as (select rid, unnest(w) as x, unnest(range(len(w))) as i from cut),
gram as (select rid, i, x as a, lead(x) over o as b, lead(x, 2) over o as c, lead(i, 2) over o as last
         from word window o as (partition by rid order by i)),
often as (select rid, i, count(*) over (partition by rid, a, b, c) as n from gram where last is not null),
covered as (select rid, count(*) as n from (select distinct rid, i + k as j from often, range(3) r(k) where n > 1) group by rid),
measured as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
         len(lines)::bigint as n_lines, len(regexp_extract_all(t, '\\p{{Lu}}'))::bigint as n_upper,
         length(regexp_replace(t, '\\P{{L}}+', '', 'g'))::bigint as n_letters
  from cut left join covered using (rid)),
judged as (select *, ({bits})::bigint as rule_mask from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (rule_mask & {base}) <> 0 as base_failed, (rule_mask & {policy}) = 0 as kept, rule_mask
from judged"""


def _secrets() -> str:
    found = []
    for no, (kind, pattern, group, least) in enumerate(secrets.PLAIN_KINDS):
        p = pattern.replace("'", "''")
        found.append(f"""
  select rid, owner, md5(t) as text_key, doc_id, {no} as kind_no, '{kind}' as kind, {least} as least, string_split_regex(t, '{p}') as gaps,
         regexp_extract_all(t, '{p}') as hits, regexp_extract_all(t, '{p}', {group}) as vals
  from d where regexp_matches(t, '{p}')""")
    base = f"kind_no < {len(secrets.KINDS)}"
    around = secrets._AROUND_KEY
    return f"""
with d as ({_ROWS}),
raw as ({" union all ".join(found)}),
each as (select *, unnest(range(1, len(hits) + 1)) as i from raw),
hit as (
  select rid, owner, text_key, doc_id, kind_no, kind, length(hits[i]) as len,
         case when starts_with(vals[i], '-----BEGIN') then regexp_replace(vals[i], '{around}', '', 'g') else vals[i] end as value,
         length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) as start
  from each where length(vals[i]) >= least),
owned as (select value, count(distinct owner) as n_owners, count(distinct (owner, text_key)) as n_repositories from hit group by value),
looked as (
  select *, start + len as stop, n_owners > {secrets.MAX_OWNERS} or n_repositories > {secrets.MAX_REPOSITORIES} as copied,
         len(list_distinct(string_split(value, ''))) as different,
         regexp_matches(value, '[a-z]')::int + regexp_matches(value, '[A-Z]')::int + regexp_matches(value, '[0-9]')::int
           + regexp_matches(value, '[+/_.=-]')::int as mixed
  from hit join owned using (value)),
judged as (
  select *, not copied and (different >= 8 or (kind_no = 0 and mixed >= 2 and 4 * different >= 3 * length(value))) as live from looked),
per_row as (
  select rid, count(*) filter (kind_no = 0) as n_assign, count(*) filter (kind_no = 1) as n_access,
         count(*) filter (kind_no = 2) as n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) filter ({base}) as base,
         string_agg(kind || ':' || start || ':' || stop, ',' order by start, kind_no) as spans,
         count(*) filter (live) as n_live, count(*) filter (copied) as n_copied,
         max(n_owners) as most_owners, max(n_repositories) as most_repositories
  from judged where {base} or live group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live,
       coalesce(n_copied, 0) as n_copied, coalesce(most_owners, 0) as most_owners, coalesce(most_repositories, 0) as most_repositories
from d left join per_row using (rid)"""


_JACCARD = """
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as g from d),
c as (select g, min(doc_id) as class_id, len(g) as n from s where len(g) > 0 group by g),
e as (select class_id, n, unnest(g) as x from c),
p as (select a.class_id as a, b.class_id as b, a.n as na, b.n as nb, count(*) as k
      from e a join e b on a.x = b.x and a.class_id < b.class_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      group by all),
l as (select a, b from p where 100 * k >= 90 * (na + nb - k) union all select b, a from p where 100 * k >= 90 * (na + nb - k)),
r as (select class_id as a, class_id as b from c union select r.a, l.b from r join l on r.b = l.a),
m as (select a as class_id, min(b) as component_id from r group by a)
select doc_id, len(s.g)::bigint as n_shingles, coalesce(class_id, doc_id) as class_id, coalesce(component_id, doc_id) as component_id
from s left join c on s.g = c.g left join m using (class_id)"""

_JACCARD_LINKS = _JACCARD.rsplit("\nselect doc_id", 1)[0] + """,
k as (select a as class_id, count(*) as n_links from l group by a)
select doc_id, len(s.g)::bigint as n_shingles, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0)::bigint as n_links
from s left join c on s.g = c.g left join k using (class_id)"""

ORACLES = {
    "op6_secret_scans": _secrets(),
    "op7_quality_rules": _quality(),
    "op8_jaccard_join": _JACCARD,
    "jaccard_link_counts": _JACCARD_LINKS,
}
