"""Queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.llm import (
    bpe, collocations, forest, gnat, licenses, packing, pivots, private, quality, secrets, sharding, suffix_tree, toxicity,
)

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return pivots.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), 16)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.shared_codec(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(_documents(spark, sf_dir), codec)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    sized = docs.select("doc_id", "source", packing.word_count().alias("n_words"), packing.text_cluster().alias("cluster"))
    return packing.pack(sized, size="n_words", cluster="cluster")


def op6_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(_documents(spark, sf_dir), words=2, percent=80)


def op7_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    s = F.col("stats")
    return quality.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", *[s[c].alias(c) for c in quality.BASE], "base_failed", "kept"
    )


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return secrets.digests(docs, secrets.fit(docs))


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    tree, counts = suffix_tree.grow(docs.where(suffix_tree.training()).select("text"))
    return suffix_tree.score(docs, tree, counts)


def op11_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_documents(spark, sf_dir))


def op12_gnat_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; a seventh of the labels is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return gnat.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


def op13_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.digests(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_permutation_index, op2_ftrl_toxicity, op3_lpt_sharding, op4_byte_bpe, op5_best_fit_packing,
        op6_minhash_forest, op7_license_index, op8_decision_list, op9_markov_secrets, op10_suffix_tree,
        op11_de_bruijn_phrases, op12_gnat_negatives, op13_anchor_pii,
    )
}

SQL = {
    "op6_minhash_forest": r"""
        with recursive words as (
            select doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents
        ), sets as (
            select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
                else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
            from words
        ), grams as (select doc_id, len(s) as n, unnest(s) as g from sets
        ), links as (
            select a.doc_id as x, b.doc_id as y from grams a join grams b
            on a.g = b.g and a.doc_id <> b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach as (
            select x as doc_id, y from links union select l.x, r.y from links l join reach r on l.y = r.doc_id
        ), low as (select doc_id, min(y) as y from reach group by doc_id)
        select s.doc_id, len(s.s) as n_shingles, coalesce(least(s.doc_id, low.y), s.doc_id) as component_id,
            coalesce(least(s.doc_id, low.y), s.doc_id) = s.doc_id as kept
        from sets s left join low using (doc_id)
    """,
    "op11_de_bruijn_phrases": r"""
        with pieces as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) as piece
            from documents
        ), walks as (
            select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces
        ), counted as (
            select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, count(*) as f
            from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
                  from walks, (select unnest(range(1, 6)) as k) where len(w) >= k)
            group by all
        ), totals as (select lang, sum(f)::hugeint as n from counted where k = 1 group by lang
        ), often as (select * from counted where f >= 100
        ), inside as (
            select lang, array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' ') as phrase, max(f) as f
            from (select lang, phrase, k, f, m, unnest(range(1, k - m + 2)) as i
                  from often, (select unnest(range(2, 5)) as m) where m < k)
            group by all
        ), cuts as (
            select o.lang, o.phrase, o.f as a, unnest(range(1, o.k)) as c, o.k
            from often o left join inside i using (lang, phrase)
            where o.k > 1 and (i.f is null or 100 * i.f < 100 * o.f)
        ), scored as (
            select c.lang, c.phrase, c.a, x.f as l, y.f as r, t.n, c.c,
                (1000::hugeint * c.a * t.n) // (x.f::hugeint * y.f) as score
            from cuts c join totals t using (lang)
            join often x on x.lang = c.lang and x.phrase = array_to_string(string_split(c.phrase, ' ')[: c.c], ' ')
            join often y on y.lang = c.lang and y.phrase = array_to_string(string_split(c.phrase, ' ')[c.c + 1 :], ' ')
        ), lowest as (
            select *, row_number() over (partition by lang, phrase order by score, c) as place from scored
        ), ranked as (
            select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank,
                phrase, a, l, r, n::bigint as n, score::bigint as score
            from lowest where place = 1
        )
        select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
    """,
    "op12_gnat_negatives": r"""
        with vectors as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                list_transform(embedding, lambda x: floor(256 * x::double)) as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
                list_inner_product(a.v, b.v)::bigint as score
            from vectors a join vectors b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
        ), positives as (
            select anchor_id, vec_id as positive_id, score as positive_score
            from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select p.anchor_id, p.positive_id,
            row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::integer as rank,
            s.vec_id as negative_id, p.positive_score, s.score as negative_score
        from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
            and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
        qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) <= 5
    """,
}
