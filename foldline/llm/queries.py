"""One registered query for each operator, over its whole table; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldline.llm import decontaminate, html_text, licences, lm, phrases, quality, suffixes, toxicity
from foldline.llm.common import table
from foldline.llm.fingerprints import neighbour_fingerprints
from foldline.llm.packing import pack
from foldline.llm.ranked import ranked_search
from foldline.llm.simhash import fingerprints, near_duplicates, pigeonhole_masks
from foldline.llm.variants import variant_groups


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose fingerprints of 4-word shingles differ in 4 bits or fewer, by component."""
    prints = fingerprints(table(spark, sf, "documents"), words=4)
    found = near_duplicates(prints, radius=4, masks=pigeonhole_masks(4))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents"))


def op4_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Stupid-backoff scores of 3-grams, each half of the documents by the other's counts."""
    scores = lm.score(table(spark, sf, "documents"), order=3)
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf, "documents"))


def op2_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Licences of every document: in how many places, and how well at best."""
    found = licences.scan(table(spark, sf, "documents"))
    return found.select("doc_id", "licence", F.col("n_places").cast("long").alias("n_places"), F.round("dice", 6).alias("best_dice"), F.col("start").cast("long").alias("start"))


def op6_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier."""
    left = suffixes.remove_repeats(table(spark, sf, "documents"), window=100)
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items that occur in documents within 5 % edits."""
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "item_id", "distance", "end")


def categories() -> dict:
    """Categories of the label table in the order of the chain: toxicity sees the probability of low quality."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels"), categories()))


def op10_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the 35-word windows that occur more than once."""
    left = phrases.remove_phrases(table(spark, sf, "documents"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document by a factorisation machine that learns from two thirds of the labelled ids."""
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels"), label="quality"))


def op12_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of seven letters or more, the frequent word one letter away that each is a form of, and the root of its forms."""
    return variant_groups(table(spark, sf, "documents"))


def op13_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=50)


_NORMAL_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_BIGRAMS_SQL = "list_distinct([{0}[i] || ' ' || {0}[i + 1] for i in range(1, len({0}))])"


def _licences_sql() -> str:
    quoted = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}', {licences.window_sizes(v, 0.8)})" for k, v in sorted(licences.TEMPLATES.items()))
    return f"""
with templates as (
  select licence, {_BIGRAMS_SQL.format("w")} as grams, len(w) - 1 as n, sizes
  from (select licence, string_split({_NORMAL_SQL.format("text")}, ' ') as w, sizes from (values {quoted}) t(licence, text, sizes))),
docs as (
  select d, doc_id, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] as bg
  from (select row_number() over () as d, doc_id, string_split({_NORMAL_SQL.format("text")}, ' ') as w from documents)),
hits as (
  select d, licence, p from (select d, unnest(bg) as gram, unnest(range(len(bg))) as p from docs)
  join (select licence, unnest(grams) as gram from templates) using (gram)),
windows as (
  select d, doc_id, licence, p, n, list_distinct(list_slice(bg, p + 1, p + l)) as x, grams
  from (select *, unnest(sizes) as l from hits join templates using (licence)) join docs using (d)),
found as (
  select * from (select d, doc_id, licence, p, n, 2.0::double * len(list_intersect(x, grams)) / (len(x) + len(grams)) as dice from windows) where dice >= 0.8 - 1e-12),
best as (select d, doc_id, licence, max(dice) as dice, min(p) filter (where dice = top) as start from (select *, max(dice) over (partition by d, licence) as top from found) group by 1, 2, 3),
places as (
  select d, licence, count(*) as n_places from (
    select d, licence, n, p - lag(p) over (partition by d, licence order by p) as gap from (select distinct d, licence, n, p from found)) where gap is null or gap >= n group by 1, 2)
select doc_id, licence, n_places, round(dice, 6) as best_dice, start from best join places using (d, licence)"""


_LM_SQL = r"""
with docs as (
  select doc_id, coalesce(doc_id, 0) % 2 as half,
         [x for x in regexp_split_to_array(text, '[\x20\x09-\x0D]+') if x != ''] as w from documents),
words as (
  select doc_id, half, unnest(w) as w3, unnest(range(1, len(w) + 1)) as i, w from docs),
grams as (
  select doc_id, half, i, w3, case when i > 1 then w[i - 1] end as w2, case when i > 2 then w[i - 2] end as w1 from words),
c1 as (select 1 - half as half, w3, count(*) as n from grams group by 1, 2),
c2 as (select 1 - half as half, w2, w3, count(*) as n from grams where w2 is not null group by 1, 2, 3),
c3 as (select 1 - half as half, w1, w2, w3, count(*) as n from grams where w1 is not null group by 1, 2, 3, 4),
total as (select 1 - half as half, count(*) as n from grams group by 1),
scored as (
  select g.doc_id,
         case when c3.n is not null then ln(c3.n / b12.n)
              when c2.n is not null then ln(c2.n / u2.n) + case when g.i > 2 then ln(0.4) else 0 end
              else ln(coalesce(c1.n, 1) / greatest(coalesce(total.n, 0), 1)) + least(g.i - 1, 2) * ln(0.4) end as s
  from grams g
  left join c1 on c1.half = g.half and c1.w3 = g.w3
  left join c2 on c2.half = g.half and c2.w2 = g.w2 and c2.w3 = g.w3
  left join c3 on c3.half = g.half and c3.w1 = g.w1 and c3.w2 = g.w2 and c3.w3 = g.w3
  left join c2 b12 on b12.half = g.half and b12.w2 = g.w1 and b12.w3 = g.w2
  left join c1 u2 on u2.half = g.half and u2.w3 = g.w2
  left join total on total.half = g.half)
select d.doc_id, len(d.w) as n_words, coalesce(round(sum(s.s), 4), 0.0) as log_score
from docs d left join scored s using (doc_id) group by 1, 2"""

_RANKED_SQL = r"""
with terms as (
  select row_number() over () as d, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents),
sizes as (select d, doc_id, ts, len(ts)::bigint as n from terms where len(ts) > 0),
total as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from sizes),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t
  from benchmark where item_id is not null),
tfs as (select d, t, count(*)::bigint as tf from (select d, unnest(ts) as t from sizes) where t in (select t from asked) group by 1, 2),
weights as (
  select t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tfs, total group by t, n_docs),
scored as (
  select a.item_id, s.d, s.doc_id,
         sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 20 * (50 + (50 * s.n * n_docs) // n_terms))))::bigint as score
  from asked a join tfs f using (t) join weights w using (t) join sizes s on s.d = f.d, total
  group by 1, 2, 3),
ranked as (
  select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50"""

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licences": op2_licences,
    "op3_packing": op3_packing,
    "op4_lm_scores": op4_lm_scores,
    "op5_fingerprints": op5_fingerprints,
    "op6_suffixes": op6_suffixes,
    "op7_html_text": op7_html_text,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_phrases": op10_phrases,
    "op11_quality": op11_quality,
    "op12_variants": op12_variants,
    "op13_ranked": op13_ranked,
}
ORACLES: dict[str, str] = {"op2_licences": _licences_sql(), "op4_lm_scores": _LM_SQL, "op13_ranked": _RANKED_SQL}
