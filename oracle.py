"""The same queries as SQL over the given tables, written from the rules.

Shared steps are common table expressions; ``_sql`` puts the ones a query names, and
the ones those name, in front of it.
"""

from __future__ import annotations

import re

from segue.functions import fixed_values as fv


# --------------------------------------------------------------------------- expressions
def norm(x: str) -> str:
    folded = f"replace(replace(lower(strip_accents({x})), '&', 'and'), '’', '''')"
    return rf"trim(regexp_replace({folded}, '[^\p{{L}}\p{{N}}_'']+', ' ', 'g'))"


_JUNK = rf"\s*[\(\[\-–—]\s*({'|'.join(fv.TITLE_JUNK_WORDS)})[^\)\]]*[\)\]]?\s*$"


def clean_title(x: str) -> str:
    for _ in range(6):  # segments are cut one by one
        x = f"regexp_replace({x}, '{_JUNK}', '', 'i')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_artist(x: str) -> str:
    lead = rf"regexp_replace({x}, '\s+(feat\.?|ft\.?|featuring)\s+.*$', '', 'i')"
    first = rf"trim(regexp_split_to_array({lead}, '\s*[,&/]\s*|\s+x\s+')[1])"
    return f"coalesce(nullif({first}, ''), {lead})"


def words(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> '')))"


STEPS: dict[str, str] = {}

# --------------------------------------------------------------------------- texts
STEPS["doc_lines"] = """
select doc_id, lang, source, line_no, line from (
  select doc_id, lang, source, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as line_no
  from documents) where trim(line) <> ''"""
STEPS["doc_tracks"] = """
select source as library_id, concat_ws('-', doc_id, line_no) as track_id,
       doc_id * 1000000 + line_no as pos, doc_id::varchar as playlist_id, line as name, lang as artist,
       source as album, lang as album_artist, length(line) * 100 as duration_ms,
       coalesce(quality = 1, false) as loved,
       case when quality is not null then upper(md5(line)) end as isrc
from doc_lines left join (select distinct doc_id, quality from labels) using (doc_id)"""
STEPS["page_titles"] = """
select page_id, replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&amp;', '&') as title,
       split_part(url, '/', 3) as host, split_part(url, '/', 4) as lang, length(html) as n_html
from pages"""
STEPS["catalog"] = f"""
select page_id::varchar as cand_id, title as name, lang as artist, concat_ws('/', host, lang) as album_id,
       length(title) / 10.0 as duration_s, n_html as popularity, upper(md5(title)) as isrc,
       {norm(clean_title('title'))} as c_title, {norm('title')} as c_name, {norm('lang')} as c_artist,
       {norm(clean_artist('lang'))} as c_lead, {norm(clean_title('host'))} as c_album
from page_titles"""
STEPS["keyed"] = f"""
select *, case when isrc is not null then 'isrc:' || upper(isrc) else 'q:' || t_lead || '|' || t_title end as key
from (select *, {norm(clean_title('name'))} as t_title, {norm(clean_artist('artist'))} as t_lead from doc_tracks)"""
STEPS["reps"] = f"""
select *, {norm('name')} as t_name, {norm('artist')} as t_artist, {norm(clean_title('album'))} as t_album
from (select * from keyed qualify row_number() over (partition by key order by library_id, pos) = 1)"""
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
STEPS["asked"] = f"""
select key, query, query_no, {words(norm('query'))} as terms from (
  select key, unnest(qs) as query, unnest(range(len(qs))) as query_no from (
    select key, list_filter(qs, lambda q: q <> '') as qs0,
           list_filter(qs, lambda q, i: q <> '' and list_position(qs, q) = i) as qs from (
      select key, [{_TRIM.format("lead || ' ' || title")}, {_TRIM.format("artist || ' ' || name")},
                   {_TRIM.format("title || ' ' || album_lead")}, {_TRIM.format("title")}] as qs
      from (select key, artist, name, {clean_artist('artist')} as lead, {clean_title('name')} as title,
                   {clean_artist('album_artist')} as album_lead from reps))))"""
STEPS["entry_words"] = f"select cand_id, {words(chr(39).join(['c_name || ', ' ', ' || c_artist']))} as terms from catalog"
STEPS["frequency"] = """
select term, 1000000000000 // count(*) as w
from (select unnest(terms) as term from (select distinct terms from entry_words)) group by term"""
STEPS["asked_words"] = """
select key, query_no, term, w
from (select key, query_no, unnest(terms) as term from asked) join frequency using (term)"""
STEPS["found"] = """
select key, query_no, cand_id, weight::bigint as weight,
       row_number() over (partition by key, query_no order by weight desc, popularity desc, cand_id) as rank
from (select key, query_no, cand_id, sum(w) as weight
      from asked_words join (select cand_id, unnest(terms) as term from entry_words) using (term)
      group by key, query_no, cand_id) join (select cand_id, popularity from catalog) using (cand_id)
qualify rank <= 12"""
STEPS["firsts"] = """
select key, cand_id, query_no, rank from found
qualify row_number() over (partition by key, cand_id order by query_no, rank) = 1"""

# token-set ratio of distinct string pairs; the common subsequence by one machine word
STEPS["both_sides"] = """
select key, cand_id, query_no, rank, t_title, t_name, t_artist, t_lead, t_album, duration_ms,
       c_title, c_name, c_artist, c_lead, c_album, duration_s
from firsts join (select key, t_title, t_name, t_artist, t_lead, t_album, duration_ms from reps) using (key)
     join catalog using (cand_id)"""
_CODED = """
select key, cand_id, popularity, t_title, t_name, t_artist, t_lead, t_album, duration_ms, c_title, c_name,
       c_artist, c_lead, c_album, duration_s
from (select key, upper(isrc) as isrc, t_title, t_name, t_artist, t_lead, t_album, duration_ms from reps
      where isrc is not null) join (select * exclude (name, artist, album_id) from catalog) using (isrc)"""
STEPS["coded_sides"] = _CODED


def _ratio_steps(prefix: str, sides: str) -> None:
    STEPS[f"{prefix}_pairs"] = f"""
select distinct a, b, {words('a')} as wa, {words('b')} as wb from (
  select t_title as a, c_title as b from {sides} union select t_artist, c_artist from {sides}
  union select t_lead, c_lead from {sides} union select t_album, c_album from {sides})"""
    STEPS[f"{prefix}_parts"] = f"""
select *, length(array_to_string(common, ' ')) as s,
       case when length(da) <= length(db) then da else db end as short,
       case when length(da) <= length(db) then db else da end as long from (
  select a, b, wa, wb, list_filter(wa, lambda w: list_contains(wb, w)) as common,
         array_to_string(list_filter(wa, lambda w: not list_contains(wb, w)), ' ') as da,
         array_to_string(list_filter(wb, lambda w: not list_contains(wa, w)), ' ') as db
  from {prefix}_pairs)"""
    STEPS[f"{prefix}_lcs"] = f"""
select *, case when short = '' then 0 else length(short) - bit_count(list_reduce(
    list_transform(string_split(long, ''), lambda c: list_sum(list_transform(range(length(short)),
      lambda i: case when short[i + 1] = c then 1::hugeint << i::integer else 0::hugeint end))::hugeint),
    lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::hugeint << length(short)::integer) - 1),
    (1::hugeint << length(short)::integer) - 1)) end as lcs
from {prefix}_parts"""
    STEPS[f"{prefix}_ratio"] = f"""
select a, b, case when len(wa) = 0 or len(wb) = 0 then 0.0
  when len(common) > 0 and (da = '' or db = '') then 100.0
  when s = 0 then apart
  else greatest(apart, 100.0 * (1.0 - (gap + length(da)) / (s + fa)::double),
                100.0 * (1.0 - (gap + length(db)) / (s + fb)::double)) end as r
from (select *, 100.0 * (1.0 - (length(da) + length(db) - 2 * lcs) / nullif(fa + fb, 0)::double) as apart from (
  select *, case when s > 0 then 1 else 0 end as gap,
         s + case when s > 0 then 1 else 0 end + length(da) as fa,
         s + case when s > 0 then 1 else 0 end + length(db) as fb from {prefix}_lcs))"""
    STEPS[f"{prefix}_scored"] = f"""
select p.*, t.r as ratio, 0.55::double * t.r + 0.35::double * greatest(x.r, y.r) + 0.1::double * z.r
  - case when duration_ms > 0 and duration_s > 0 and abs(duration_ms / 1000.0::double - duration_s::double) > 20 then 25.0
         when duration_ms > 0 and duration_s > 0 and abs(duration_ms / 1000.0::double - duration_s::double) > 5 then 8.0
         else 0.0 end::double
  + case when t_name = c_name then 3.0 else 0.0 end::double as score
from {sides} p
join {prefix}_ratio t on t.a = t_title and t.b = c_title
join {prefix}_ratio x on x.a = t_artist and x.b = c_artist
join {prefix}_ratio y on y.a = t_lead and y.b = c_lead
join {prefix}_ratio z on z.a = t_album and z.b = c_album"""


_ratio_steps("f", "both_sides")
_ratio_steps("i", "coded_sides")
STEPS["stopped"] = """
select * exclude (earlier) from (
  select *, max(score) over (partition by key order by query_no range between unbounded preceding and 1 preceding) as earlier
  from f_scored) where earlier is null or earlier < 92"""
STEPS["by_code"] = """
select key, cand_id as id, 100.0::double as score, name as title, artist, album_id, 78.0::double as threshold
from (select key, cand_id from i_scored
      qualify row_number() over (partition by key order by score desc, popularity desc, cand_id) = 1)
join (select cand_id, name, artist, album_id from catalog) using (cand_id)"""
STEPS["by_search"] = """
select key, c.cand_id as id, coalesce(b.score, 0.0::double) as score, coalesce(c.name, '') as title,
       coalesce(c.artist, '') as artist, c.album_id, 78.0::double as threshold
from reps left join (
  select key, cand_id, score from stopped
  qualify row_number() over (partition by key order by score desc, query_no, rank) = 1) b using (key)
left join catalog c on c.cand_id = b.cand_id and b.score >= 78"""
STEPS["decided"] = """
select * from by_code union all select * from by_search where key not in (select key from by_code)"""

# tracks as they arrive carry no code: the same steps over those
_ARRIVING = ["keyed", "reps", "asked", "asked_words", "found", "firsts", "both_sides", "f_pairs", "f_parts", "f_lcs", "f_ratio", "f_scored", "stopped", "by_search"]
for _name in _ARRIVING:
    _text = re.sub(rf"\b(from|join)(\s+)({'|'.join(_ARRIVING)})\b", r"\1\2arriving_\3", STEPS[_name])
    STEPS[f"arriving_{_name}"] = _text.replace("from doc_tracks", "from (select * replace (null::varchar as isrc) from doc_tracks)")

# --------------------------------------------------------------------------- libraries
STEPS["playlists"] = """
select 'n' || c_nationkey as library_id, o_orderkey::varchar as playlist_id, o_orderkey as pos,
       concat_ws('-', o_custkey, o_orderpriority) as name, o_orderstatus = 'P' as smart,
       o_orderstatus <> 'F' as own, o_orderstatus
from orders join customer on o_custkey = c_custkey"""
STEPS["items"] = """
select library_id, l_orderkey::varchar as playlist_id,
       row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos, l_partkey::varchar as track_id
from lineitem join playlists on playlist_id = l_orderkey::varchar"""
STEPS["lib_tracks"] = f"""
select library_id, p_partkey::varchar as track_id, p_partkey as pos, p_name as name, p_brand as artist, p_type as album,
       p_brand as album_artist, p_size * 1000 as duration_ms, p_size > 40 as loved, p_size,
       'q:' || {norm(clean_artist('p_brand'))} || '|' || {norm(clean_title('p_name'))} as key,
       {norm('p_brand')} as album_artist_key, {norm('p_type')} as album_key
from (select distinct library_id, track_id from items) join part on p_partkey::varchar = track_id"""
STEPS["decisions"] = f"""
select key, case when p_type <> 'LARGE' then 'c' || p_partkey end as id, p_size * 2.0::double as score,
       p_name as title, p_brand as artist,
       case when p_type <> 'LARGE' then concat_ws('-', p_brand, p_type) end as album_id, 78.0::double as threshold
from (select *, 'q:' || {norm(clean_artist('p_brand'))} || '|' || {norm(clean_title('p_name'))} as key from part
      where p_type <> 'SMALL') qualify row_number() over (partition by key order by p_partkey) = 1"""
STEPS["groups"] = """
select key, count(*) as n_tracks, arg_min(track_id, (library_id, pos)) as track_id, min(library_id) as library_id,
       arg_min(name, (library_id, pos)) as name, arg_min(artist, (library_id, pos)) as artist
from lib_tracks group by key"""
STEPS["work"] = """
select g.*, d.key is not null as stale from groups g left join decisions d using (key)
where d.key is null or (d.id is not null) <> (d.score >= 78)"""
STEPS["albums"] = """
select library_id, min(pos) as pos, album as name, artist, count(*) as track_count,
       case when album not in ('SMALL', 'LARGE') then md5(artist || album) end as upc
from lib_tracks group by library_id, artist, album"""
STEPS["upc_catalog"] = """
select md5(p_brand || p_type) as upc, 'u' || p_partkey as album_id, p_partkey as pos from part where p_type <> 'ECONOMY'"""
STEPS["upc_memo"] = """
select md5(p_brand || p_type) as upc, case when p_type = 'PROMO' then 'm' || min(p_partkey) end as album_id
from part where p_type in ('PROMO', 'MEDIUM') group by p_brand, p_type"""
STEPS["upc_found"] = """
select upc, album_id from (select distinct upc from albums where upc is not null)
left join (select upc, arg_min(album_id, pos) as album_id from upc_catalog group by upc) using (upc)"""
STEPS["upc_all"] = """
select upc, album_id from upc_memo
union all select upc, album_id from upc_found where upc not in (select upc from upc_memo)"""
STEPS["votes"] = """
select library_id, album_artist_key, album_key, d.album_id, count(*) as n
from lib_tracks left join decisions d using (key) where album <> ''
group by all"""
STEPS["album_groups"] = """
select library_id, album_artist_key, album_key, count(*) as n_tracks, min(pos) as pos,
       arg_min(album, pos) as album, arg_min(album_artist, pos) as album_artist
from lib_tracks where album <> '' group by all"""
STEPS["majority"] = """
select library_id, album_artist_key, album_key, sum(n)::bigint as n_tracks,
       coalesce(sum(n) filter (album_id is not null), 0)::bigint as n_matched,
       case when 2 * max(n) filter (album_id is not null) > sum(n) filter (album_id is not null)
            then arg_max(album_id, n) filter (album_id is not null) end as album_id
from votes group by library_id, album_artist_key, album_key"""
STEPS["resolved"] = f"""
select library_id, pos, name, artist, track_count, album_id, source from (
  select a.*, coalesce(u.album_id, m.album_id) as album_id,
         case when u.album_id is not null then 'upc' else 'tracks' end as source
  from albums a left join upc_all u using (upc)
  left join majority m on m.library_id = a.library_id and m.album_artist_key = {norm('a.artist')} and m.album_key = {norm('a.name')})
where album_id is not null qualify row_number() over (partition by library_id, album_id order by pos) = 1"""
STEPS["track_ids"] = "select library_id, track_id, d.id from lib_tracks left join decisions d using (key)"
STEPS["matched"] = "select i.*, t.id from items i left join track_ids t using (library_id, track_id)"
STEPS["plan"] = """
select p.*, n_items, n_kept, n_items - n_kept as n_missing, n_kept = 0 as skip
from playlists p join (select library_id, playlist_id, count(*) as n_items, count(distinct id) as n_kept
                       from matched group by all) using (library_id, playlist_id)"""
STEPS["favorites"] = """
select 'n' || c_nationkey as library_id,
       case c_mktsegment when 'HOUSEHOLD' then 'album' when 'MACHINERY' then 'artist' else 'track' end as kind,
       'c' || c_custkey as id, c_name as name, c_custkey as pos from customer"""
STEPS["favorite_ids"] = """
select library_id, id, min(pos) as pos from lib_tracks join track_ids using (library_id, track_id)
where id is not null group by all"""
STEPS["favorite_ranks"] = """
select library_id, id, row_number() over (partition by library_id order by pos) as rank from favorite_ids"""
STEPS["wipe"] = """
select library_id, 'playlist' as kind, playlist_id as id, name, pos from playlists
where own and (library_id, name) in (select (library_id, name) from playlists where smart)
union all select library_id, 'followed', playlist_id, name, pos from playlists where not own
union all select library_id, kind, id, name, pos from favorites"""
STEPS["leftover"] = """
select library_id, 'playlist' as kind, name, pos from playlists where o_orderstatus <> 'P'
  and (library_id, name) in (select (library_id, name) from wipe where kind = 'playlist')
union all select library_id, kind, null, pos from favorites where kind = 'album'"""
STEPS["verified"] = """
select library_id, kind, count(l.pos) as n_left,
       coalesce(string_agg(l.name, ', ' order by l.pos) filter (l.n <= 5 and l.name is not null), '')
         || case when kind = 'playlist' and count(l.pos) > 5 then ' …' else '' end as preview,
       count(l.pos) = 0 as ok
from (select library_id, unnest(['playlist', 'track', 'album']) as kind from (select distinct library_id from wipe))
left join (select *, row_number() over (partition by library_id, kind order by pos) as n from leftover) l using (library_id, kind)
group by library_id, kind"""

# --------------------------------------------------------------------------- exports
STEPS["all_lines"] = """
select doc_id, lang, source, n_chars, unnest(string_split(text, chr(10))) as line,
       unnest(range(len(string_split(text, chr(10))))) as line_no from documents"""
STEPS["song_list"] = """
select doc_id, lang, source, line, line_no as pos from all_lines"""
STEPS["play_list"] = """
select doc_id, lang, source, line, line_no from all_lines
union all
select doc_id, lang, source, line || ' - Live', line_no + count(*) over (partition by doc_id) from all_lines"""
STEPS["songs"] = """
select doc_id::varchar as library_id, md5(line) as track_id, pos, line as name, lang as artist, source as album,
       lang as album_artist, length(line) as duration_ms, false as loved from song_list where line <> ''"""
STEPS["listed"] = """
select doc_id::varchar as library_id, md5(line) as track_id, line_no as pos, line as name, lang as artist, lang as album,
       lang as album_artist, length(line) as duration_ms, false as loved, source from play_list where line <> ''"""
STEPS["plist_tracks"] = """
select doc_id::varchar as library_id, line_no::varchar as track_id, line_no as pos, line as name, lang as artist, '' as album,
       lang as album_artist, length(line) as duration_ms, false as loved, source
from all_lines where line <> '' and not (lang = 'fr' and length(line) < 40)"""
STEPS["dumped"] = """
select source as collection, doc_id * 1000000 + line_no as pos, md5(line) as id, line as name, lang, source, n_chars
from all_lines where trim(line) <> ''"""
STEPS["page_lists"] = """
select source as library_id, doc_id as playlist_pos, doc_id::varchar as playlist_id, source || ' ' || lang as name, doc_id
from documents where lang = 'en' or n_chars > 2000"""
STEPS["page_listed"] = """
select library_id, playlist_pos, playlist_id, l.name as list_name, pos, md5(i.name) as id, i.name, lang, source, n_chars
from (select doc_id, line_no as pos, line as name, lang, source, n_chars from all_lines where trim(line) <> ''
      union all
      select doc_id, line_no + count(*) over (partition by doc_id), line || ' - Live', lang, source, n_chars from all_lines
      qualify trim(line) <> '') i
join page_lists l using (doc_id)
where length(i.name) >= 20 and (i.name like '%.' or i.name not like '%,%')"""
STEPS["reset_left"] = """
select library_id, name from playlists where o_orderstatus <> 'P' and library_id < 'n2'
and (library_id, name) in (select (library_id, name) from wipe where kind = 'playlist')
union all select library_id, null from favorites where kind = 'album' and library_id < 'n2'"""
STEPS["reset_planned"] = """
select library_id, count(*) as n_deleted from wipe where kind in ('playlist', 'track', 'album') group by all"""
STEPS["reset_gates"] = """
select library_id, library_id not in (select library_id from reset_left) as may_import from reset_planned"""
STEPS["reset_backed"] = """
select library_id, sum(n)::bigint as n_backed_up from (
select library_id, greatest(1, (count(track_id) + 999) // 1000) as n
from playlists left join items using (library_id, playlist_id) group by library_id, playlist_id
union all select library_id, (count(*) + 999) // 1000 from favorites group by library_id, kind) group by library_id"""
STEPS["reset_entries"] = """
select library_id, count(*) as n_entries from (select distinct library_id, playlist_id, id from matched where id is not null) group by all"""
STEPS["reset_stars"] = """
select library_id, count(*) as n_favorites from favorite_ids group by all"""


def _sql(query: str) -> str:
    """``query`` with the steps it needs in front."""
    needed: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in STEPS:
            if name not in needed and re.search(rf"\b(?:from|join|,)\s*\(?\s*{name}\b", text):
                visit(STEPS[name])
                needed[name] = None

    visit(query)
    if not needed:
        return query
    return "with " + ",\n".join(f"{n} as materialized ({STEPS[n]})" for n in needed) + "\n" + query


_DECISION = "select key, id, round(score, 6) as score, title, artist, album_id, threshold from "
_METRICS = """
select library_id, sum(n)::bigint as n_needed, sum(c)::bigint as n_isrc, count(*) as n_keys,
       count(*) filter (id is not null) as n_keys_matched, coalesce(sum(n) filter (id is not null), 0)::bigint as n_matched
from (select library_id, key, count(*) as n, count(isrc) as c from keyed group by all) left join decided using (key)
group by library_id"""

ORACLE = {
    name: _sql(query)
    for name, query in {
        "norm_titles": f"select doc_id, line_no, {norm('line')} as normal from doc_lines",
        "norm_dictionary": f"select doc_id, line_no, {norm('line')} as normal from doc_lines",
        "clean_titles": f"""select md5(title) as id, {clean_title('title')} as clean from (
            select line || ' (' || lang || ') - Live [Remix]' as title from doc_lines
            union all select title || ' – Remastered 2011' from page_titles union all select line from doc_lines)""",
        "clean_artists": f"select doc_id, line_no, {clean_artist('line')} as lead from doc_lines",
        "identity_key": "select library_id, track_id, key from keyed",
        "year_prefix": """select o_orderkey, case when o_orderstatus <> 'F'
            then left(strftime(o_orderdate, '%Y-%m-%d'), 4)::bigint end as year from orders""",
        "token_set_ratio_pairs": "select key, cand_id, round(ratio, 6) as ratio from f_scored",
        "score_pairs": "select key, cand_id, query_no, rank, round(score, 6) as score from f_scored",
        "early_stop_window": "select key, cand_id, query_no, round(score, 6) as score from stopped",
        "link_stages": """select query_no, count(distinct key) as n_keys, count(*) as n_pairs,
            count(distinct key) filter (score >= 92) as n_settled from stopped group by query_no""",
        "link_isrc": _DECISION + "by_code",
        "link_fuzzy": _DECISION + "by_search",
        "link_tracks": _DECISION + "decided",
        "stream_link": _DECISION + "arriving_by_search",
        "search_queries": "select key, query_no, query from asked",
        "search_candidates": "select key, query_no, cand_id, weight, rank from found",
        "match_metrics": _METRICS,
        "transfer_summary": f"""select m.*, n_playlists, n_entries, n_missing, coalesce(n_favorites, 0) as n_favorites
            from ({_METRICS}) m
            join (select library_id, count(*) filter (kept > 0) as n_playlists, sum(kept)::bigint as n_entries,
                         sum(n - kept)::bigint as n_missing
                  from (select library_id, playlist_id, count(*) as n, count(distinct id) as kept
                        from keyed left join decided using (key) group by all) group by library_id) using (library_id)
            left join (select library_id, count(distinct id) as n_favorites from keyed join decided using (key)
                       where loved and id is not null group by library_id) using (library_id)""",
        "dedup_groups": "select key, n_tracks, library_id, track_id from groups",
        "decisions_stale": "select key, track_id, stale from work",
        "decisions_merge": """select key, 'x' || track_id as id, 95.0::double as score, name as title, artist,
            null::varchar as album_id, 90.0::double as threshold from work
            union all select * from decisions where key not in (select key from work)""",
        "decisions_rekey": """select key, case when p_type <> 'LARGE' then 'c' || p_partkey end as id,
            p_size * 2.0::double as score, p_name as title, p_brand as artist
            from (select distinct track_id, key from lib_tracks) join part on p_partkey::varchar = track_id
            qualify row_number() over (partition by key order by p_partkey) = 1""",
        "upc_todo": "select distinct upc from albums where upc is not null and upc not in (select upc from upc_memo)",
        "upc_lookup": "select upc, album_id from upc_found",
        "upc_memo": """select upc, album_id from upc_memo where album_id is not null
            or upc not in (select upc from upc_found)
            union all select upc, album_id from upc_found
            where upc not in (select upc from upc_memo where album_id is not null)""",
        "tracks_by_album": """select library_id, album_artist_key, album_key, n_tracks, album, album_artist from album_groups""",
        "album_majority": "select * from majority",
        "resolve_albums": "select * from resolved",
        "guess_albums": """select library_id, pos, album as name, album_artist as artist, n_tracks as track_count, album_id,
            'tracks' as source from (select g.*, m.n_matched, m.album_id from album_groups g
              join majority m using (library_id, album_artist_key, album_key))
            where n_tracks >= 3 and n_matched >= 0.8 * n_tracks and album_id is not null
            qualify row_number() over (partition by library_id, album_id order by pos) = 1""",
        "favorite_albums_plan": """select library_id, album_id, row_number() over (partition by library_id order by pos) as rank
            from resolved where not (library_id in ('n1', 'n2') and album_id in (select album_id from upc_catalog))""",
        "filter_skip_smart": "select library_id, playlist_id, name from playlists where not smart",
        "filter_only_names": """select library_id, playlist_id, name from playlists where lower(name) in
            (select lower(c_custkey || '-1-URGENT') from customer where c_mktsegment = 'BUILDING')""",
        "select_needed_tracks": """select library_id, track_id from items join playlists using (library_id, playlist_id)
            where not smart union select library_id, track_id from lib_tracks where loved""",
        "reset_scope_plan": """select library_id, playlist_id, name from playlists where own
            and (library_id, name) in (select (library_id, name) from playlists where smart)""",
        "ambiguous_names": "select library_id, name, count(*) as n from playlists group by all having count(*) > 1",
        "playlist_plan": "select library_id, playlist_id, n_items, n_kept, n_missing, skip from plan",
        "playlist_entries": """select library_id, playlist_id, id,
            row_number() over (partition by library_id, playlist_id order by min(pos)) as rank
            from matched where id is not null group by library_id, playlist_id, id""",
        "playlist_writes": """select library_id, playlist_id, (rank - 1) // 3 as chunk,
            case when n = 1 and (rank - 1) // 3 = 0 then 'replace' else 'append' end as mode,
            string_agg(id, ',' order by rank) as ids
            from (select library_id, playlist_id, id,
                    row_number() over (partition by library_id, playlist_id order by min(pos)) as rank
                  from matched where id is not null group by library_id, playlist_id, id)
            join playlists using (library_id, playlist_id)
            left join (select library_id, name, count(*) as n from playlists where smart group by all) using (library_id, name)
            where coalesce(n, 0) <= 1 group by library_id, playlist_id, n, (rank - 1) // 3""",
        "playlist_actions": """select library_id, playlist_id, name, case when skip then 'skip_no_match'
            when n > 1 then 'skip_ambiguous' when n = 1 then 'replace' else 'create' end as action
            from plan left join (select library_id, name, count(*) as n from playlists where smart group by all)
            using (library_id, name)""",
        "favorites_plan": "select library_id, id, rank from favorite_ranks",
        "favorites_new_only": """select library_id, id, row_number() over (partition by library_id order by pos) as rank
            from favorite_ids where (library_id, id) not in (select (library_id, id) from favorites where kind = 'track')""",
        "chunk_plan": """select library_id, (rank - 1) // 50 as chunk,
            string_agg('catalog:track:' || id, ',' order by rank) as uris from favorite_ranks group by all""",
        "unmatched_report": """select library_id, track_id, t.artist, t.name as title, album, coalesce(d.score, 0.0) as best_score,
            0::bigint as part, coalesce(names, '') as playlists
            from lib_tracks t left join decisions d using (key)
            left join (select library_id, i.track_id, string_agg(p.name, '; ' order by p.pos) as names
                       from items i join playlists p using (library_id, playlist_id) group by all) using (library_id, track_id)
            where d.id is null""",
        "account_summary": """select library_id, coalesce(n_own, 0) as n_own, coalesce(n_followed, 0) as n_followed,
            coalesce(n_tracks, 0) as n_tracks, coalesce(n_albums, 0) as n_albums, coalesce(n_artists, 0) as n_artists
            from (select library_id, count(*) filter (own) as n_own, count(*) filter (not own) as n_followed
                  from playlists group by all)
            full join (select library_id, count(*) filter (kind = 'track') as n_tracks,
                       count(*) filter (kind = 'album') as n_albums, count(*) filter (kind = 'artist') as n_artists
                       from favorites group by all) using (library_id)""",
        "account_snapshot": """select library_id, 'playlist' as kind, playlist_id as id, name, own, 0::bigint as part,
            count(track_id) as n_items, coalesce(string_agg(track_id || '=' || p_name, ',' order by i.pos), '') as tracks,
            '2024-01-01 00:00:00' as saved_at
            from playlists left join (select library_id, playlist_id, pos, track_id, p_name
              from items join part on p_partkey::varchar = track_id) i using (library_id, playlist_id)
            group by all
            union all select library_id, kind, '', '', true, (n - 1) // 1000, count(*),
              string_agg(id || '=' || name, ',' order by pos), '2024-01-01 00:00:00'
            from (select *, row_number() over (partition by library_id, kind order by pos) as n from favorites)
            group by library_id, kind, (n - 1) // 1000""",
        "wipe_plan": """select library_id, kind, id,
            (row_number() over (partition by library_id, kind order by pos) - 1) // 40 as chunk from wipe""",
        "verify_deletions": "select * from verified",
        "reset_gate": "select library_id, bool_and(ok) as may_import from verified group by library_id",
        "ingest_json_props": "select * from songs",
        "ingest_json_playlists": """select library_id, any_value(source) as name, count(*) as n_items, false as smart
            from listed group by library_id""",
        "ingest_declared_albums": """select doc_id::varchar as library_id, 0::bigint as pos, source as name, lang as artist,
            len(string_split(text, chr(10))) as track_count, md5(source) as upc from documents""",
        "track_union_first_wins": """
            select library_id, track_id, 0::bigint as part, min(pos) as pos, arg_max(name, pos) as name,
              arg_max(artist, pos) as artist, arg_max(album, pos) as album, arg_max(album_artist, pos) as album_artist,
              arg_max(duration_ms, pos) as duration_ms, false as loved from songs group by library_id, track_id
            union all
            select library_id, track_id, 1, min(pos), arg_min(name, pos), arg_min(artist, pos), arg_min(album, pos),
              arg_min(album_artist, pos), arg_min(duration_ms, pos), false from listed
            where (library_id, track_id) not in (select (library_id, track_id) from songs) group by library_id, track_id""",
        "ingest_xml_udtf": "select * exclude (source) from plist_tracks",
        "ingest_xml_items": """select library_id, source as playlist_name, true as smart, pos, track_id from plist_tracks""",
        "filter_media_kind": """select event_id, props as name from events where event_type not in ('view', 'signup')
            and value <= 200 and not (event_type = 'error' and value > 50) and value >= 1""",
        "filter_system_playlists": """select o_orderkey, o_orderpriority as name, o_orderstatus = 'P' as smart from orders
            where o_orderstatus <> 'F' and o_orderpriority <> '4-NOT SPECIFIED'""",
        "semi_valid_items": """select library_id, playlist_id, count(*) as n_items from items
            join part on p_partkey::varchar = track_id where p_type = 'PROMO' group by all""",
        "explode_pages": "select collection, pos, id, name from dumped",
        "ingest_nested_tracks": """select collection, pos, id as track_id, name, lang as artist, source as album,
            lang as album_artist, length(name) as duration_ms,
            try_cast(left(n_chars || '-01', 4) as bigint) as year from dumped
            where length(name) >= 20 and (name like '%.' or name not like '%,%')""",
        "ingest_page_library": """
            select library_id, id as track_id, part::bigint as part, pos, name, lang as artist, source as album, lang as album_artist,
                   length(name) as duration_ms, try_cast(left(n_chars || '-01', 4) as bigint) as year,
                   bool_or(part = 0) over (partition by library_id, id) as loved
            from (select collection as library_id, id, 0 as part, 0 as playlist_pos, pos, name, lang, source, n_chars from dumped
                  where length(name) >= 20 and (name like '%.' or name not like '%,%')
                  union all
                  select library_id, id, 1, playlist_pos, pos, name, lang, source, n_chars from page_listed)
            qualify row_number() over (partition by library_id, id order by part, playlist_pos, pos) = 1""",
        "ingest_page_playlists": """
            select library_id, playlist_id, playlist_pos, list_name as name, count(*) as n_items, count(distinct id) as n_tracks
            from page_listed group by all""",
        "ingest_page_albums": """
            select source as library_id, doc_id as pos, source || ' ' || lang as name, lang as artist,
                   len(string_split(text, chr(10))) as track_count, md5(source) as upc from documents where lang <> 'fr'""",
        "catalog_entries": """
            select page_id::varchar as cand_id, title as name, host || '|' as artists, host as album, host || '/' || lang as album_id,
                   case when lang = 'en' and title <> '' then length(title)::double end as duration_s, n_html as popularity,
                   upper(md5(title)) as isrc
            from page_titles where lang <> 'de' and not (lang = 'fr' and n_html >= 1000)""",
        "ingest_quarantine": """
            select 'json export' as reader, 'malformed' as reason, doc_id::varchar as source, 1::bigint as n from documents where lang = 'de'
            union all select 'page', 'malformed', source, count(*) from documents where source = 'src1' group by source
            union all select 'property list', 'malformed', doc_id::varchar, 1 from documents where lang = 'fr'
            union all select 'decisions', case when album_id is null then 'no key' else 'no score' end,
              case when album_id is not null then key end, count(*) from decisions where album_id is null or score = 20 group by all""",
        "reset_import": """
            select library_id, n_backed_up, may_import, coalesce(n_deleted, 0) as n_deleted,
                   case when coalesce(may_import, true) then coalesce(n_entries, 0) else 0 end as n_entries,
                   case when coalesce(may_import, true) then coalesce(n_favorites, 0) else 0 end as n_favorites
            from reset_backed left join reset_gates using (library_id) left join reset_planned using (library_id)
                 left join reset_entries using (library_id) left join reset_stars using (library_id)""",
        "song_projection": """select source as library_id, doc_id::varchar as track_id, md5(text) as name, lang as artist,
            coalesce(nullif(case when lang = 'en' then n_chars else 0 end, 0), nullif(quality * 1000, 0), 0) as duration_ms,
            case when quality is not null then md5(doc_id::varchar) end as isrc,
            (2000 + toxic)::varchar as year from documents left join labels using (doc_id)""",
        "filter_non_tracks": """select event_id::varchar as id from events where value < 200 and event_type <> 'error'
            and (event_type = 'view' or value >= 5)""",
        "filter_owned": """select o_orderkey from orders
            where (o_orderstatus <> 'O' and o_orderpriority = '1-URGENT') or o_totalprice > 400000""",
        "catalog_projection": """select p_partkey::varchar as cand_id, p_name as name,
            case when p_size > 25 then p_brand || ' ' || p_type else p_brand end as artists, p_brand as artist,
            case when p_type <> 'PROMO' then p_type else '' end as album, p_size::double as duration_s,
            case when p_size > 10 then p_size else 0 end::bigint as popularity from part where p_type <> 'SMALL'""",
        "album_artist_unambiguous": """select p_partkey, p_brand as artist, coalesce(only_artist, p_brand) as album_artist
            from part left join (select p_brand, p_type, p_name, case when count(distinct p_size) = 1
              then min(p_size)::varchar end as only_artist from part group by all) using (p_brand, p_type, p_name)""",
        "loved_flag_join": """select doc_id as track_id, source,
            doc_id in (select doc_id from labels where quality = 1) as loved from documents""",
    }.items()
}
