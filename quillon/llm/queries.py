"""The corpus operators as named queries over the driver's tables, with SQL where it can state them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm import embedding_dedup, exact_dedup, fill_in_middle, fingerprints, jaccard_join, langid, lm_scoring, mixing, substring_dedup, suffix_dedup, unigram, url_filter, vector_codes
from quillon.llm.shared import ship, table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")


def vocabulary() -> str:
    """The SentencePiece model file on the driver; QUILLON_PIECES names another."""
    return os.environ.get("QUILLON_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = unigram.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
    return out.select("doc_id", "ids", "n_tokens", "n_byte_tokens", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.with_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprints.text_form(F.col("vec")).alias("fingerprint"), fingerprints.text_form(F.col("edited_vec")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"), fingerprints.likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lm_scoring.scored(table(spark, sf_dir, "documents"), order=3)


def op7_lm_scoring_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the counts of a training split, two thirds of them: what the others have and these lack is backed off for."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    split = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 3
    return lm_scoring.scored(docs, split != 1, order=3)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    out = langid.classified(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = fill_in_middle.arranged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
with recursive fine as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a as vec_id, min(b)::bigint as component_id from reach group by a)
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links, component_id, vec_id = component_id as kept from least
"""

OP5_SQL = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as s from words),
sizes as (select doc_id, len(s)::bigint as n from sets),
grams as (select doc_id, unnest(s) as g from sets),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as c from grams x join grams y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from sizes union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select s.doc_id, s.n as n_shingles, min(r.b)::bigint as component_id from sizes s join reach r on r.a = s.doc_id group by 1, 2
"""

OP6_SQL = r"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from starts),
firsts as (select h, min(doc_id) as f from windows group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from windows join firsts using (h) where doc_id > f),
each as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as j from words),
kept as (select e.doc_id, string_agg(e.word, ' ' order by e.j) as t, count(*) as n from each e left join gone g on e.doc_id = g.doc_id and e.j = g.j where g.j is null group by e.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from words w left join kept k using (doc_id)
"""

OP7_SQL = r"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
each as (select doc_id, generate_subscripts(w, 1) as j, unnest(w) as a from words),
grams as (select doc_id, j, a, lag(a) over d as b, lag(a, 2) over d as c from each window d as (partition by doc_id order by j)),
c1 as (select a, count(*) as n from grams group by a),
c2 as (select b, a, count(*) as n from grams where b is not null group by all),
c3 as (select c, b, a, count(*) as n from grams where c is not null group by all),
total as (select count(*) as n from grams),
scored as (select g.doc_id, case when c3.n is not null then ln(c3.n / x2.n) when c2.n is not null then ln(c2.n / x1.n) else ln(c1.n / total.n) end as s
  from grams g cross join total join c1 on c1.a = g.a left join c2 on c2.a = g.a and c2.b = g.b left join c1 x1 on x1.a = g.b
  left join c3 on c3.a = g.a and c3.b = g.b and c3.c = g.c left join c2 x2 on x2.a = g.b and x2.b = g.c)
select w.doc_id, len(w.w)::bigint as n_words, round(coalesce(sum(s), 0), 4) as log_score, round(sum(s) / len(w.w), 6) as mean_log_score
from words w left join scored s on s.doc_id = w.doc_id group by w.doc_id, len(w.w)
"""

OP7_HELD_OUT_SQL = rf"""
with words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
each as (select doc_id, generate_subscripts(w, 1) as j, unnest(w) as a from words),
grams as (select doc_id, j, a, lag(a) over d as b, lag(a, 2) over d as c from each window d as (partition by doc_id order by j)),
seen as (select * from grams where ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 3 <> 1),
c1 as (select a, count(*) as n from seen group by a),
c2 as (select b, a, count(*) as n from seen where b is not null group by all),
c3 as (select c, b, a, count(*) as n from seen where c is not null group by all),
total as (select count(*) as n from seen),
scored as (select g.doc_id, case when c3.n is not null then ln(c3.n / x2.n)
  when c2.n is not null then ln(c2.n / x1.n) + case when g.c is not null then ln({lm_scoring.ALPHA}) else 0 end
  else ln(coalesce(c1.n, 1) / total.n) + case when g.c is not null then 2 * ln({lm_scoring.ALPHA}) when g.b is not null then ln({lm_scoring.ALPHA}) else 0 end end as s
  from grams g cross join total left join c1 on c1.a = g.a left join c2 on c2.a = g.a and c2.b = g.b left join c1 x1 on x1.a = g.b
  left join c3 on c3.a = g.a and c3.b = g.b and c3.c = g.c left join c2 x2 on x2.a = g.b and x2.b = g.c)
select w.doc_id, len(w.w)::bigint as n_words, round(coalesce(sum(s), 0), 4) as log_score, round(sum(s) / len(w.w), 6) as mean_log_score
from words w left join scored s on s.doc_id = w.doc_id group by w.doc_id, len(w.w)
"""

OP9_SQL = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as pos from sized group by source),
weighed as (select *, case (pos - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from per),
level as (select *, source_size / weight as ratio, sum(source_size) over () * 1.5::double as budget from weighed),
filled as (select *, (select sum(o.source_size) from level o where o.ratio <= level.ratio) * 2
  + ratio * 2 * (select coalesce(sum(o.weight), 0) from level o where o.ratio > level.ratio) <= budget as fullup from level),
opened as (select *, budget - coalesce(sum(source_size * 2) filter (where fullup) over (), 0) as rest, sum(weight) filter (where not fullup) over () as open_weight from filled),
goals as (select source, pos, source_size, case when fullup then (source_size * 2)::double else weight * (rest::double / open_weight) end as target from opened),
cum as (select *, sum(target) over () as total, sum(target) over (order by pos) as hi, max(pos) over () as maxpos from goals),
spans as (select *, floor((hi - target) / total * 4294967296)::bigint as lo_p, case when pos = maxpos then 4294967296 else floor(hi / total * 4294967296)::bigint end as hi_p from cum where total > 0),
slots as (select i as slot, ((i % 2147483648) * 2654435769) % 4294967296 as point from range((select ceil(sum(target) / 256)::bigint from goals)) r(i)),
owned as (select pos, count(*) as n from slots join spans on point >= lo_p and point < hi_p group by pos),
laid as (select s.doc_id, s.size, g.pos, g.source_size, g.target, coalesce(sum(s.size) over (partition by g.pos order by md5('mix:' || s.doc_id::varchar), s.size rows between unbounded preceding and 1 preceding), 0) as at
  from sized s join goals g on s.source is not distinct from g.source)
select l.doc_id, l.size, l.source_size, l.target,
  (greatest(0, least(l.at + l.size, coalesce(o.n, 0) * 256) - l.at) + greatest(0, least(l.source_size + l.at + l.size, coalesce(o.n, 0) * 256) - l.source_size - l.at))::bigint as taken
from laid l left join owned o on l.pos = o.pos
"""

OP11_SQL = r"""
with h as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(doc_id::varchar, '')) as x from documents),
cut as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as u, [('0x' || x[1:8])::bigint, ('0x' || x[9:16])::bigint, ('0x' || x[17:24])::bigint, ('0x' || x[25:32])::bigint] as r from h),
placed as (select *, len(u) as n, least(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as a, greatest(r[1] % (len(u) + 1), r[2] % (len(u) + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from cut),
part as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from placed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(case form when 'plain' then t else p || m || s end) as restored_sha256 from part
"""


def op12_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """Every distance to every entry, the rounds written out."""
    out = f"""
with fine as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select vec_id, p, q[p * (len(q) // {parts}) + 1:(p + 1) * (len(q) // {parts})] as q from fine cross join range({parts}) r(p)),
book0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, q as c from parts qualify row_number() over (partition by p order by vec_id) <= {entries})"""
    near = "select p.vec_id, p.p, any_value(p.q) as q, min(list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - b.c[i]) * (p.q[i] - b.c[i])))::bigint * 256 + b.e) as best from parts p join book{k} b on p.p = b.p group by p.vec_id, p.p"
    for k in range(rounds):
        out += f""",
near{k} as ({near.format(k=k)}),
cells{k} as (select p, best % 256 as e, generate_subscripts(q, 1) as i, unnest(q) as x from near{k}),
means{k} as (select p, e, list(x order by i) as c from (select p, e, i, floor(sum(x) / count(*))::bigint as x from cells{k} group by p, e, i) group by p, e),
book{k + 1} as (select b.p, b.e, coalesce(m.c, b.c) as c from book{k} b left join means{k} m on b.p = m.p and b.e = m.e)"""
    return out + f""",
final as ({near.format(k=rounds)}),
coded as (select vec_id, string_agg(lpad(lower(to_hex(best % 256)), 2, '0'), '' order by p) as code, sum(best // 256)::bigint as error from final group by vec_id),
flat as (select p, e, generate_subscripts(c, 1) as i, unnest(c) as x from book{rounds}),
books as (select sha256(string_agg(x::varchar, ',' order by p, e, i)) as codebooks_sha256 from flat)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from fine join coded using (vec_id) cross join books
"""


OP13_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_sentencepiece, op3_document_fingerprints, op4_embedding_dedup, op5_ngram_jaccard_join, op6_substring_dedup, op7_lm_scoring, op7_lm_scoring_held_out, op8_suffix_array_dedup, op9_source_mix, op10_language_id, op11_fill_in_middle, op12_vector_codes, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_dedup": OP4_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op7_lm_scoring": OP7_SQL, "op7_lm_scoring_held_out": OP7_HELD_OUT_SQL, "op9_source_mix": OP9_SQL, "op11_fill_in_middle": OP11_SQL, "op12_vector_codes": op12_sql(), "op13_exact_dedup": OP13_SQL}
