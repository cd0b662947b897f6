"""SQL that says what the links, hits, searches, shards and clusters of this subpackage must return."""

from __future__ import annotations

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Rows whose id, size and checksum are equal change places freely, so any order of them is right.
SHARDS = r"""
with recursive bits as (
    select i, i as v, 0 as step from range(256) t(i)
    union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from bits where step < 8
), crcs as (select list(v order by i) as t from bits where step = 8),
raw as (
    select doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 as size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as pairs from documents
), sized as (
    select doc_id, source, size, xor(4294967295, list_reduce(list_transform(pairs, lambda p: cast('0x' || p as bigint)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) as text_crc32
    from raw, crcs
), ranked as (
    select *, count(*) over (partition by source) as n, row_number() over (partition by source
        order by md5('12:' || coalesce(cast(doc_id as varchar), '')), doc_id nulls first, size, text_crc32) as r from sized
), placed as (
    select *, count(*) over () as total, row_number() over (order by (r - 1 + cast('0x' || md5('12:' || coalesce(source, ''))[1:12] as bigint) / 281474976710656.0::double) / n, source nulls first,
        md5('12:' || coalesce(cast(doc_id as varchar), '')), doc_id nulls first, size, text_crc32) - 1 as place from ranked
), cut as (select *, place * 16 // total as shard from placed)
select doc_id, source, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law, cast(shard as int) as shard,
    cast(place - (shard * total + 15) // 16 as bigint) as slot, cast(null as int) as grown_shard
from cut
"""


def _lloyd(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Each round assigns all vectors and averages them, component by component."""
    nearest = "row_number() over (partition by row order by distance, cluster)"
    parts = [
        f"""kept as materialized (
    select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as q from embeddings
    where len(embedding) = {size} and len(list_filter(embedding, lambda x: isfinite(x))) = {size}
), c0 as materialized (
    select row_number() over (order by sha256('3:' || vec_id) nulls last, q) - 1 as cluster, q as c from kept qualify cluster < {k}
)"""
    ]
    for i in range(rounds + 1):
        square = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"
        parts.append(
            f"""a{i} as materialized (
    select row, vec_id, q, cluster, distance from (select *, {nearest} as place from (select row, vec_id, q, cluster, cast({square} as bigint) as distance from kept, c{i})) where place = 1
)"""
        )
        if i < rounds:
            parts.append(
                f"""m{i} as (
    select cluster, list(v order by i) as c from (
        select cluster, i, cast(floor(sum(q[i]) / cast(count(*) as double)) as bigint) as v from a{i}, range(1, {size + 1}) t(i) group by cluster, i
    ) group by cluster
), c{i + 1} as materialized (select c{i}.cluster, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} using (cluster))"""
            )
    return (
        "with "
        + ",\n".join(parts)
        + f"""
select vec_id, cast(a.cluster as int) as cluster, distance, cast(sum(distance) over (partition by a.cluster) as bigint) as cluster_inertia,
    cast(sum(distance) over () as bigint) as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c using (cluster)
"""
    )


CLUSTERS = _lloyd()

SEARCH = rf"""
with words as (
    select doc_id, row, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select doc_id, text, row_number() over () as row from documents)
), counted as (select doc_id, row, term, count(*) as tf from words group by all),
lengths as (select row, cast(sum(tf) as bigint) as n from counted group by row),
corpus as (select count(*) as docs, cast(sum(n) as bigint) as l from lengths),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from counted, corpus group by term, docs),
asked as (
    select item, item_id, term, count(*) as times from (
        select item_id, item, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from (select item_id, text, row_number() over () as item from benchmark)
    ) group by all
), scored as (
    select item, item_id, row, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l)))) as bigint) as score
    from asked join weights using (term) join counted using (term) join lengths using (row), corpus
    group by item, item_id, row, doc_id
)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as int) as rank, doc_id, score
from scored where score > 0 qualify rank <= 10
"""

#: Pairs of linked rows as ``near`` (a, b, both ways) and what each row can reach.
_REACH = "reach as (select a as node, b as other from near union select r.node, n.b from reach r join near n on n.a = r.other)"

VECTORS = f"""
with recursive usable as materialized (
    select vec_id, label, cast(embedding as double[]) as v from embeddings
    where vec_id is not null and label is not null and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0
), near as materialized (
    select x.vec_id as a, y.vec_id as b from usable x join usable y on x.label = y.label and x.vec_id <> y.vec_id and len(x.v) = len(y.v)
    where list_cosine_similarity(x.v, y.v) >= 0.93
), {_REACH},
links as (select a, count(*) as n from near group by 1),
lowest as (select node, min(other) as low from reach group by 1)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(low, vec_id)) as component_id, vec_id = least(vec_id, coalesce(low, vec_id)) as kept
from embeddings left join links on a = vec_id left join lowest on node = vec_id
"""

DUPLICATES = rf"""
with recursive split as materialized (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x20\x09-\x0D]+') as w from documents
), shingles as materialized (
    select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') as s from split, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) where len(w) > 0
), sizes as materialized (select doc_id, count(*) as n from shingles group by 1),
common as (select x.doc_id as a, y.doc_id as b, count(*) as shared from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
near as materialized (
    select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared >= 80 * (p.n + q.n - shared)
), {_REACH},
lowest as (select node, min(other) as low from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
from documents d left join sizes using (doc_id) left join lowest on node = d.doc_id
"""

CONTAMINATION = rf"""
with split as materialized (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), items as (
    select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as materialized (
    select distinct item, least(len(w), 10) as k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as s
    from items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0
), found as materialized (
    select doc_id, i, k, item from (
        select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as s from split, (select distinct k from windows), unnest(range(1, len(w) - k + 2)) t(i)
    ) join windows using (k, s)
), hits as (select doc_id, count(distinct place) as n from (select doc_id, unnest(range(i, i + k)) as place from found) group by 1),
named as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as list from (select distinct doc_id, item from found) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(h.n, 0) as n_hit, coalesce(m.n, 0) as n_items, sha256(coalesce(list, '')) as items_sha256,
    coalesce(h.n, 0) > 0 as contaminated
from split left join hits h using (doc_id) left join named m using (doc_id)
"""
