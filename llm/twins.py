"""DuckDB statements for operators whose whole result SQL can express on the test tables: each recomputes the contract from the
texts themselves (all 100-byte strings, all pairs of shingle sets, all windows, the whole tree), with none of the operators' methods."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUFFIX_SQL = """
with docs as (select doc_id, row_number() over () as rid, hex(encode(coalesce(text, ''))) as code from documents),
     blocks as (select rid, doc_id, code, unnest(range(0, length(code) // 2 - 99, 512)) as block from docs where length(code) >= 200),
     pieces as (select rid, doc_id, block, substring(code, block * 2 + 1, 1222) as piece from blocks),
     starts as (select *, unnest(range(0, length(piece) // 2 - 99)) as inside from pieces),
     strings as (select rid, doc_id, block + inside as pos, md5_number(substring(piece, inside * 2 + 1, 200)) as h from starts),
     first as (select h, min((doc_id, pos)) as least from strings group by h having count(*) > 1),
     again as (select rid, pos from strings join first using (h) where (doc_id, pos) > least),
     edges as (select rid, pos, lag(pos) over (partition by rid order by pos) as before from again),
     runs as (select rid, pos, sum(case when before is null or pos - before > 100 then 1 else 0 end) over (partition by rid order by pos) as run
              from edges),
     spans as (select rid, min(pos) as a, max(pos) + 100 as b from runs group by rid, run),
     gaps as (select rid, coalesce(lag(b) over w, 0) as a, a as b from spans window w as (partition by rid order by a)),
     kept as (select rid, string_agg(substring(code, a * 2 + 1, (b - a) * 2), '' order by a) as head from gaps join docs using (rid) group by rid),
     sums as (select rid, count(*) as n, sum(b - a) as bytes, max(b) as last from spans group by rid)
select doc_id, length(code) // 2 as n_bytes, cast(coalesce(bytes, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans,
       sha256(unhex(coalesce(head || substring(code, last * 2 + 1), code))) as kept_sha256
from docs left join sums using (rid) left join kept using (rid)
"""

NEAR_SQL = rf"""
with recursive
     words as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
     spread as (select doc_id, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as pos from words),
     five as (select doc_id, n, pos, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o
                     || ' ' || lead(word, 4) over o as shingle from spread window o as (partition by doc_id order by pos)),
     single as (select distinct doc_id, shingle from five where n >= 5 and shingle is not null union all
                select doc_id, array_to_string(w, ' ') from words where len(w) between 1 and 4),
     sizes as (select doc_id, count(shingle) as n from words left join single using (doc_id) group by doc_id),
     shared as (select a.doc_id as x, b.doc_id as y, count(*) as same from single a join single b using (shingle)
                where a.doc_id <> b.doc_id group by all),
     links as (select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
               where 100 * same >= 85 * (a.n + b.n - same)),
     reached(doc_id, other) as (select doc_id, doc_id from documents union
                                select doc_id, y from reached join links on x = other),
     least as (select doc_id, min(other) as component_id from reached group by doc_id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join least using (doc_id)
"""

OVERLAP_SQL = rf"""
with words as (select row_number() over () as rid, doc_id,
                      regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
     items as (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
     windows as (select distinct item_id, least(len(w), 10) as size, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
                        for i in range(1, greatest(len(w) - 9, 1) + 1)]) as win from items where len(w) > 0),
     starts as (select rid, size, unnest(range(1, len(w) - size + 2)) as pos, w from words, (select distinct size from windows)
                where len(w) >= size),
     hits as (select rid, pos, size, item_id from starts join windows using (size) where array_to_string(w[pos:pos + size - 1], ' ') = win),
     covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(pos, pos + size)) as p from hits) group by rid),
     found as (select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids
               from (select distinct rid, cast(item_id as varchar) as id from hits) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from words left join covered using (rid) left join found using (rid)
"""


def _leaf(text: str) -> str:
    def part(c):
        return f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || cast({c} as varchar), '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# levels of a source's tree count from 0, those of the tree over the subroots (tree 0) from 1000
MERKLE_SQL = f"""
with recursive
     bytes as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)
                           order by i) as t from range(256) r(i)),
     crcs as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, [ascii(x)::bigint for x in string_split(doc_id::varchar, '')]),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as crc
              from (select distinct doc_id from documents where doc_id is not null), bytes),
     hashed as (select doc_id, source, {_leaf("text")} as leaf, case when crc % 5 = 0 then
                       {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as changed
                from documents left join crcs using (doc_id)),
     leaves as (select *, dense_rank() over (order by source nulls first) as tree,
                       row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place,
                       count(*) over (partition by source) as many from hashed),
     own(level, tree, idx, hash, many) as (
         select 0, tree, place, leaf, many from leaves union all
         select level + 1, tree, idx // 16, sha256(string_agg(hash, '' order by idx)), (any_value(many) + 15) // 16
         from own where many > 1 group by level, tree, idx // 16),
     subroots as (select tree, hash from own where many = 1),
     over_(level, tree, idx, hash, many) as (
         select 1000, 0::bigint, tree - 1, hash, (select count(*) from subroots) from subroots union all
         select level + 1, tree, idx // 16, sha256(string_agg(hash, '' order by idx)), (any_value(many) + 15) // 16
         from over_ where many > 1 group by level, tree, idx // 16),
     runs as (select level, tree, idx, list(hash) over (partition by level, tree, idx // 16 order by idx
                     rows between unbounded preceding and unbounded following) as h, idx % 16 as pos
              from (from own union all from over_) where many > 1),
     steps as (select level, tree, idx, array_to_string(h[1:pos], '') as l, array_to_string(h[pos + 2:], '') as r from runs),
     ways as (select tree, place, list(l || '|' || r order by level) as way from (
                  select a.tree, a.place, s.level, l, r from leaves a join steps s
                  on (s.tree = a.tree and s.idx = a.place // cast(pow(16, s.level) as bigint) and s.level < 1000) union all
                  select a.tree, a.place, s.level, l, r from leaves a join steps s
                  on (s.tree = 0 and s.level >= 1000 and s.idx = (a.tree - 1) // cast(pow(16, s.level - 1000) as bigint)))
              group by tree, place),
     walked as (select doc_id, leaf, tree, coalesce(way, []) as way, list_reduce(list_prepend(coalesce(changed, leaf), coalesce(way, [])),
                       lambda c, s: sha256(split_part(s, '|', 1) || c || split_part(s, '|', 2))) as folded_root
                from leaves left join ways using (tree, place))
select doc_id, leaf, s.hash as subroot, o.hash as root, sha256(replace(array_to_string(way, ''), '|', '')) as proof_sha256, folded_root,
       folded_root = o.hash as verified
from walked join subroots s using (tree), (select hash from over_ where many = 1) o
"""
