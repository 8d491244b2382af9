"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables.

Not expressible: fingerprints and SimHash (XXH64), the language model (quantised counts), the
classifier, and tokenizers. tests/llm holds those against brute force, exact round trips or
held-out accuracy.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES: dict[str, str] = {}

# five hex digits make four characters of base32
_GROUP = "('0x' || substr(h, (5 * g + 1)::int, 5))::int"
_BASE32 = "array_to_string(list_transform(range(0, 8), lambda g: " + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_GROUP} // {32**k}) % 32 + 1)::int, 1)" for k in (3, 2, 1, 0)) + "), '')"
ORACLES["op6_warc"] = f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages), q as (select page_id, strlen(payload)::bigint as payload_bytes, h, max(page_id) over (partition by payload) as top from p)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from q"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op7_decontaminate"] = f"""
with d as (select doc_id, {_WORDS} as w from documents), t as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
n as (select item_id, w, least(13, len(w)) as n from t where len(w) > 0),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as x from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from n)),
places as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as x from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from windows))),
hits as (select distinct doc_id, i, n, item_id from places join windows using (n, x)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from hits group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

ORACLES["op8_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as x from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
least_doc as (select x, min(doc_id) as first from windows group by x),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from windows join least_doc using (x) where first < doc_id),
words as (select doc_id, w, unnest(w) as word, generate_subscripts(w, 1) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)"""

ORACLES["op9_url_filter"] = rf"""
with u as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(action, rh, rp) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (select page_id, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(action, length(rh || rp)) as action from u, r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from u left join best using (page_id)"""
