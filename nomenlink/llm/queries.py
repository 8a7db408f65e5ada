"""The corpus queries and, where SQL can say it, their twins."""

from __future__ import annotations

from nomenlink.llm.attention_quality import op7_attention_quality
from nomenlink.llm.decontaminate import op9_decontaminate
from nomenlink.llm.doubling_windows import op6_substring_dedup
from nomenlink.llm.exact_copies import OP8_SQL, op8_exact_dedup
from nomenlink.llm.fair_mix import OP13_SQL, op13_fair_mix
from nomenlink.llm.html_templates import op1_template_extraction
from nomenlink.llm.packing import op3_best_fit_packing
from nomenlink.llm.radix_windows import op4_suffix_dedup
from nomenlink.llm.secret_scan import op10_secret_scan
from nomenlink.llm.sketch_join import op2_sketch_join
from nomenlink.llm.turn_repair import OP11_SQL, op11_turn_repair
from nomenlink.llm.url_rules import op5_url_rules
from nomenlink.llm.whitening import op12_whitening

QUERIES = {
    query.__name__: query
    for query in (
        op1_template_extraction,
        op2_sketch_join,
        op3_best_fit_packing,
        op4_suffix_dedup,
        op5_url_rules,
        op6_substring_dedup,
        op7_attention_quality,
        op8_exact_dedup,
        op9_decontaminate,
        op10_secret_scan,
        op11_turn_repair,
        op12_whitening,
        op13_fair_mix,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP2_SQL = f"""
with recursive listed as (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents
), shingled as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
  from listed
), sets as materialized (select distinct doc_id, s from shingled),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
common as materialized (
  select x.doc_id as a, y.doc_id as b, count(*) as i from sets x join sets y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2
), links as materialized (
  select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * i >= 85 * (p.n + q.n - i)
), reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other
)
select r.doc_id, coalesce(any_value(z.n), 0)::bigint as n_shingles, min(r.other) as component_id
from reach r left join sizes z on z.doc_id = r.doc_id group by r.doc_id
"""

_OP5_SQL = r"""
with recursive rules(verdict, host, path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), links as (
  select url as a, unnest(regexp_extract_all(html, '<link[^>]*rel="canonical"[^>]*href="([^"]*://[^"]*)"', 1)) as b from pages
), urls as (
  select url from pages union select b from links
), parsed as (
  select url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from urls)
), judged as (
  select p.url, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) as rule,
    max_by(r.verdict, length(r.host || r.path)) as own
  from parsed p left join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
  group by all
), reach(url, other) as (
  select url, url from urls where url is not null
  union select r.url, case when l.a = r.other then l.b else l.a end from reach r join links l on l.a = r.other or l.b = r.other
), spread as (
  select reach.url, min(own) as alias from reach join judged on judged.url = reach.other group by 1
)
select page_id, host, path, rule, coalesce(own, alias, 'allow') as verdict
from pages left join judged on judged.url is not distinct from pages.url left join spread on spread.url = pages.url
"""

_OP6_SQL = f"""
with listed as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 33)) as s from listed),
windows as materialized (select doc_id, s, array_to_string(w[s:s + 34], ' ') as seen from starts),
repeated as materialized (
  select doc_id, s from windows where seen in (select seen from windows group by seen having count(*) > 1)
), gone as materialized (select distinct doc_id, unnest(range(s, s + 35)) as i from repeated),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from listed),
kept as (
  select doc_id, count(*) as n, string_agg(word, ' ' order by i) as text
  from words anti join gone using (doc_id, i) group by doc_id
)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from listed left join kept using (doc_id)
"""

ORACLES = {
    "op2_sketch_join": _OP2_SQL,
    "op5_url_rules": _OP5_SQL,
    "op6_substring_dedup": _OP6_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_turn_repair": OP11_SQL,
    "op13_fair_mix": OP13_SQL,
}
