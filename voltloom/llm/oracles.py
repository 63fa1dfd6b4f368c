"""SQL twins of the operators that SQL can express.

SQL has no tokenizer, XXH64, Viterbi decoding or classifier; the other operators are tested against brute force or held-out labels.
"""

REPEATED_WORDS = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
word as (select doc_id, len(ws) as n, ws, unnest(range(1, len(ws) + 1)) as p from w),
starts as (select doc_id, p, ws[p] as word, case when p + 19 <= n then md5(array_to_string(ws[p:p + 19], ' ')) end as content from word),
seen as (select *, case when content is not null then row_number() over (partition by content order by doc_id, p) end > 1 as again from starts),
marked as (select doc_id, p, word, coalesce(bool_or(again) over (partition by doc_id order by p rows between 19 preceding and current row), false) as gone from seen),
cut as (select doc_id, count(*) as n_words, count_if(gone) as n_removed, coalesce(string_agg(word, ' ' order by p) filter (not gone), '') as kept from marked group by 1)
select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join cut on cut.doc_id = d.doc_id
"""

REPEATED_BYTES = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
byte as (select doc_id, x, length(x) // 2 as n, unnest(range(length(x) // 2)) as p from h),
starts as (select doc_id, p, substr(x, 2 * p + 1, 2) as b, case when p + 200 <= n then md5(substr(x, 2 * p + 1, 400)) end as content from byte),
seen as (select doc_id, p, b, case when content is not null then count(*) over (partition by content) > 1 end as again from starts),
marked as (select doc_id, p, b, coalesce(bool_or(again) over (partition by doc_id order by p rows between 199 preceding and current row), false) as gone from seen),
edged as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as opens from marked),
cut as (select doc_id, count(*) as n_bytes, count_if(gone) as n_removed, count_if(opens) as n_spans, coalesce(string_agg(b, '' order by p) filter (not gone), '') as kept from edged group by 1)
select d.doc_id, coalesce(n_bytes, 0)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256
from documents d left join cut on cut.doc_id = d.doc_id
"""

HARD_NEGATIVES = """
with v as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select a, b, score, row_number() over (partition by a order by score desc, b) as k from s where same),
n as (select p.a, p.b as pos, p.score as ps, s.b as neg, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score where p.k <= 5)
select a as anchor_id, pos as positive_id, rank::int as rank, neg as negative_id, ps as positive_score, ns as negative_score from n where rank <= 3
"""


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


_ROW = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

def _crc_step() -> str:
    """One byte of crc32: exclusive or, then eight shifts with the polynomial. DuckDB has no such function."""
    step = "xor(c, x)"
    for k in range(8):
        step = f"list_transform([{step}], lambda b{k}: case when b{k} % 2 = 1 then xor(b{k} >> 1, 3988292384) else b{k} >> 1 end)[1]"
    return step


MERKLE = f"""
with recursive crc as (select doc_id, xor(c, 4294967295) as bits from (select doc_id, list_reduce(
    list_concat([4294967295::bigint], list_transform(split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, x: {_crc_step()}) as c
  from (select distinct doc_id from documents where doc_id is not null))),
d as (select doc_id, coalesce('=' || source, '') as key, sha256({_ROW} || {_field('text')}) as leaf, sha256({_ROW} || {_field('other')}) as changed
  from (select *, case when bits % 2 = 0 then replace(text, chr(10), '') else text end as other from (select d.*, c.bits from documents d left join crc c on c.doc_id = d.doc_id))),
l as (select *, row_number() over (order by key, doc_id nulls first, leaf) as id, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as r from d),
n(key, level, r, digest, size) as (select key, 0, r, leaf, count(*) over (partition by key) from l
  union all select key, level + 1, r // 3, sha256(string_agg(digest, '' order by r)), max((size + 2) // 3) from n where size > 1 group by key, level, r // 3),
s as (select key, digest, row_number() over (order by key) - 1 as r from n where size = 1),
m(level, r, digest, size) as (select 0, r, digest, count(*) over () from s
  union all select level + 1, r // 3, sha256(string_agg(digest, '' order by r)), max((size + 2) // 3) from m where size > 1 group by level, r // 3),
both_ as (select key, level, r, digest from n where size > 1 union all select 'all', level, r, digest from m where size > 1),
side as (select key, level, r, coalesce(string_agg(digest, '') over (partition by key, level, r // 3 order by r rows between unbounded preceding and 1 preceding), '') as before,
  coalesce(string_agg(digest, '') over (partition by key, level, r // 3 order by r rows between 1 following and unbounded following), '') as after from both_),
way as (select id, level as step, before, after from l join side on side.key = l.key and side.r = l.r // (3 ** level)::bigint
  union all select id, 1000 + level, before, after from l join s on s.key = l.key join side on side.key = 'all' and side.r = s.r // (3 ** level)::bigint),
steps as (select *, row_number() over (partition by id order by step) as k from way),
f(id, k, digest) as (select id, 0, changed from l union all select f.id, f.k + 1, sha256(before || f.digest || after) from f join steps on steps.id = f.id and steps.k = f.k + 1),
folded as (select id, max_by(digest, k) as digest from f group by id),
proof as (select id, string_agg(before || after, '' order by step) as p from way group by id)
select l.doc_id, l.leaf, s.digest as subroot, root.digest as root, sha256(coalesce(p, '')) as proof_sha256, folded.digest as folded_root, folded.digest = root.digest as verified
from l join s on s.key = l.key join folded on folded.id = l.id left join proof on proof.id = l.id, (select digest from m where size = 1) root
"""

EXACT = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
  row_number() over (partition by x order by doc_id desc nulls last) = 1 as kept, sha256(x) as text_sha256 from t
"""
