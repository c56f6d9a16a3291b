"""DuckDB SQL for the operators that SQL can express.

Operators 1, 3, 7, 8, 9 and 10 rest on a tokenizer, trained models, an iterative
solver or hashes that the SQL engine lacks; ``tests/llm`` holds them against
brute force instead.
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = """
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint n, sha1(coalesce(html, '')) d, url from pages),
k as (select d, max(page_id) keep from p where n >= 1000 group by d)
select page_id, url, n payload_bytes, d payload_digest, case when keep is not null and page_id <> keep then 'revisit' else 'response' end record_type,
  case when page_id <> keep then keep end refers_to
from p left join k using (d)"""

OP4 = f"""
with items as (select item_id::varchar item, {WORDS} w from benchmark),
wins as (select distinct item, least(len(w), 8) k, w[i:i + least(len(w), 8) - 1] win from (select item, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) i from items where len(w) > 0)),
ks as (select distinct k from wins),
docs as (select row_number() over () r, doc_id, {WORDS} w from documents),
places as (select r, k, i, w[i:i + k - 1] win from (select r, k, w, unnest(range(1, len(w) - k + 2)) i from docs, ks where len(w) >= k)),
hits as (select r, item, places.k, i from places join wins on places.k = wins.k and places.win = wins.win),
covered as (select r, count(distinct x) n from (select r, unnest(range(i, i + k)) x from hits) group by r),
found as (select r, count(distinct item) n, string_agg(distinct item, ',' order by item) ids from hits group by r)
select doc_id, len(w)::bigint n_words, coalesce(covered.n, 0)::bigint n_hit, coalesce(found.n, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(found.n, 0) >= 2 contaminated
from docs left join covered using (r) left join found using (r)"""

OP5 = r"""
with d as (select doc_id, list_filter(string_split(regexp_replace(replace(coalesce(text, ''), chr(31), ' '), '([.!?]+ +|\n+)', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') s from documents),
s as (select doc_id, i, s[i] piece, lower(trim(regexp_replace(s[i], '[ \t\n\r\f\x0b]+', ' ', 'g'), ' ')) plain from (select doc_id, s, unnest(range(1, len(s) + 1)) i from d)),
c as (select *, sum(case when plain = '' then 0 else len(plain) - len(replace(plain, ' ', '')) + 1 end) over (partition by doc_id order by i) upto,
  sum(case when plain = '' then 0 else len(plain) - len(replace(plain, ' ', '')) + 1 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) before from s),
ends as (select a.doc_id, a.i, min(b.i) e from c a join c b on a.doc_id = b.doc_id and b.i > a.i and b.upto - coalesce(a.before, 0) >= 12 group by 1, 2),
spans as (select x.doc_id, x.i, x.e, string_agg(c.plain, chr(10) order by c.i) body from ends x join c on c.doc_id = x.doc_id and c.i between x.i and x.e group by 1, 2, 3),
later as (select doc_id, i, e from (select *, row_number() over (partition by body order by doc_id, i) n from spans) where n > 1),
gone as (select distinct doc_id, unnest(range(i, e + 1)) i from later),
kept as (select s.doc_id, count(*) n, count(gone.i) cut, string_agg(case when gone.i is null then piece else '' end, '' order by s.i) body from s left join gone on gone.doc_id = s.doc_id and gone.i = s.i group by 1)
select d.doc_id, coalesce(n, 0)::bigint n_sentences, coalesce(cut, 0)::bigint n_removed, coalesce(cut, 0) > 0 repeated, sha256(coalesce(body, '')) text_sha256 from d left join kept using (doc_id)"""

OP6 = r"""
with t as (select row_number() over () r, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<title\b.*?</title\s*>|<!--.*?-->', ' ', 'g'),
    '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|table|tr|nav|article|section|header|footer|body|html|head|main|aside|pre|blockquote|hr)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') x from pages),
l as (select r, page_id, host, list_filter(string_split(regexp_replace(trim(x, ' '), '[ \t\r\f\x0B]*\n\s*', chr(10), 'g'), chr(10)), lambda y: y <> '') ls from t),
total as (select host, count(*) pages from l group by host),
seen as (select host, line, count(*) n from (select distinct r, host, unnest(ls) line from l) group by 1, 2),
bad as (select host, line from seen join total using (host) where n >= 3 and n > 0.1 * pages),
row_lines as (select r, host, i, ls[i] line from (select r, host, ls, unnest(range(1, len(ls) + 1)) i from l)),
kept as (select r, count(*) n, count(bad.line) dropped, string_agg(case when bad.line is null then row_lines.line end, chr(10) order by i) body from row_lines left join bad on bad.host = row_lines.host and bad.line = row_lines.line group by r)
select page_id, host, coalesce(n, 0)::bigint n_lines, coalesce(dropped, 0)::bigint n_dropped, sha256(coalesce(body, '')) text_sha256 from l left join kept using (r)"""

ORACLES: dict[str, str] = {"op2_warc": OP2, "op4_decontaminate": OP4, "op5_sentence_spans": OP5, "op6_site_lines": OP6}
