"""Subword ids, padding, embedding lookup, pooling and dense scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from starsift.catalog.fixtures import view
from starsift.catalog.registry import query
from starsift.catalog.relational import sql_hash
from starsift.catalog.texts import TOKENS_SQL, tokenized
from starsift.functions import text as tx
from starsift.functions.hashing import hash32
from starsift.functions.vectors import argmax, dense, softmax
from starsift.operators import models, numbering, sequence, subwords
from starsift.session import scratch_path, stored

DIMS = 64

# Words, vocabulary and longest-match walk over every word of every document.
WORDPIECE_SQL = r"""with recursive
docs as (select doc_id, regexp_extract_all(strip_accents(lower(regexp_replace(text,
           '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\p{Cf}]', '', 'g'))),
           '[\p{P}$+<=>^`|~]|\p{Han}|[^\s\p{Z}\p{P}$+<=>^`|~\p{Han}]+') as words from documents),
tok as materialized (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from docs),
dw as materialized (select word, count(*) as n from tok where length(word) <= 100 group by word),
freq as (select word from dw where n >= 20),
ch as (select distinct unnest(string_split(word, '')) as c from dw),
pieces as (select word as piece from freq union select c from ch union select '##' || c from ch
           union select '##' || word from freq where length(word) <= 4),
vocab as materialized (select piece, cast(4 + row_number() over (order by piece) as integer) as id from pieces),
edges as materialized (select word, k, max(len) as len, arg_max(id, len) as id from
            (select word, k, len, case when k > 1 then '##' else '' end || substr(word, k, len) as piece
             from dw, unnest(range(1, length(word) + 1)) s(k),
                  unnest(range(1, length(word) - k + 2)) t(len)) x
          join vocab using (piece) group by word, k),
walk as (select word, 1::bigint as k, []::integer[] as ids from dw
         union all
         select w.word, w.k + e.len, list_append(w.ids, e.id)
         from walk w join edges e on e.word = w.word and e.k = w.k),
coded as (select word, ids from walk where k = length(word) + 1),
lines as (select doc_id, flatten(list(coalesce(ids, [1]) order by i)) as ids
          from tok left join coded using (word) group by doc_id),
enc as (select doc_id, list_concat(list_concat([2], coalesce(lines.ids, [])[1:MAX - 2]), [3]) as ids
        from docs left join lines using (doc_id))"""


def _wordpiece_sql(max_length: int) -> str:
    return WORDPIECE_SQL.replace("MAX", str(max_length))


def encoded(spark, sf_dir, max_length=128):
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = subwords.frequency_vocabulary(docs)
    return subwords.wordpiece_encode(docs, vocab, max_length=max_length).drop("text")


def _ids_text(df):
    return df.select(
        "doc_id",
        F.size("input_ids").cast("bigint").alias("n_ids"),
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"),
    )


@query(
    "wordpiece_encode",
    _wordpiece_sql(128)
    + " select doc_id, len(ids) as n_ids, array_to_string(ids, ' ') as ids from enc",
)
def wordpiece_encode(spark, sf_dir):
    return _ids_text(encoded(spark, sf_dir))


@query(
    "pad_to_longest",
    _wordpiece_sql(128)
    + """, width as (select max(len(ids)) as w from enc)
      select doc_id, w as n_ids, array_to_string(list_resize(ids, w, 0), ' ') as ids
      from enc, width""",
)
def pad_to_longest(spark, sf_dir):
    return _ids_text(sequence.pad_to_longest(stored(encoded(spark, sf_dir), "ids")))


@query(
    "pad_per_batch",
    _wordpiece_sql(512)
    + """, b as (select doc_id // 16 as batch, max(len(ids)) as w from enc group by 1)
      select doc_id, w as n_ids, array_to_string(list_resize(ids, w, 0), ' ') as ids
      from enc join b on batch = doc_id // 16""",
)
def pad_per_batch(spark, sf_dir):
    rows = stored(encoded(spark, sf_dir, 512), "ids").withColumn(
        "batch", F.floor(F.col("doc_id") / 16).cast("bigint")
    )
    return _ids_text(sequence.pad_per_batch(rows, "batch"))


PLACES_SQL = f"""places as (select doc_id, i - 1 as pos, {sql_hash('token')} % v as token_id
  from (select doc_id, unnest(words) as token, generate_subscripts(words, 1) as i from
         (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as words from documents) x) y,
       (select count(*) as v from embeddings) z)"""


def with_token_ids(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select("doc_id", "text")
    size = view(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()
    ids = F.transform(tx.word_tokens("text"), lambda t: F.pmod(hash32(t), F.col("_size")))
    rows = docs.withColumn("_size", size).select("doc_id", ids.alias("token_ids"))
    return stored(rows, "ids")


def vectors(spark, sf_dir):
    return view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")


@query(
    "embedding_lookup",
    f"""with {PLACES_SQL}, t as (select vec_id, round(embedding[1]::double, 6) + 0::double as first,
            round(list_sum(embedding::double[]), 6) + 0::double as total from embeddings)
        select doc_id, pos, token_id, first, total
        from places join t on token_id = vec_id""",
)
def embedding_lookup(spark, sf_dir):
    # As in the SQL, what is told of a vector is computed once a vector, not once a place.
    values = F.col("embedding").cast("array<double>")
    total = F.aggregate(values, F.lit(0.0).cast("double"), lambda a, x: a + x)
    table = vectors(spark, sf_dir).withColumns({"first": F.round(values[0], 6), "total": F.round(total, 6)})
    found = sequence.embedding_lookup(with_token_ids(spark, sf_dir), table)
    return found.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token_id", "first", "total")


def _spread(df):
    """Array ``pooled`` as one rounded column per dimension."""
    return df.select(
        "doc_id", *[F.round(F.col("pooled")[i], 6).alias(f"d{i}") for i in range(DIMS)]
    )


def _pool_sql(cell: str) -> str:
    cells = ", ".join(
        f"round({cell.format(x=f'embedding[{i + 1}]::double')}, 6) + 0::double as d{i}"
        for i in range(DIMS)
    )
    return f"""with {PLACES_SQL},
        tf as (select doc_id, token_id, count(*) as n from places group by doc_id, token_id)
        select doc_id, {cells} from tf join embeddings on token_id = vec_id group by doc_id"""


@query("embed_mean_pool", _pool_sql("sum({x} * n) / sum(n)"))
def embed_mean_pool(spark, sf_dir):
    return _spread(sequence.mean_pool(with_token_ids(spark, sf_dir), vectors(spark, sf_dir), DIMS))


@query("embed_max_pool", _pool_sql("max({x})"))
def embed_max_pool(spark, sf_dir):
    return _spread(sequence.max_pool(with_token_ids(spark, sf_dir), vectors(spark, sf_dir), DIMS))


HIDDEN, CLASSES = 16, 5


def weight(i: int, j: int) -> float:
    """A fixed small weight for input i and unit j."""
    return ((7 * i + 13 * j) % 19 - 9) / 20


def head_layers():
    first = [[weight(i, j) for j in range(HIDDEN)] for i in range(DIMS)]
    last = [[weight(i + 3, j + 5) for j in range(CLASSES)] for i in range(HIDDEN)]
    return [
        (first, [weight(j, 1) for j in range(HIDDEN)], "relu"),
        (last, [weight(j, 2) for j in range(CLASSES)], "softmax"),
    ]


def _unit_sql(x: str, column: list[float], bias: float) -> str:
    values = ", ".join(str(w) for w in column)
    return f"list_dot_product({x}, [{values}]::double[]) + ({bias})::double"


def _head_sql() -> str:
    (w1, b1, _), (w2, b2, _) = head_layers()
    hidden = ", ".join(
        f"greatest({_unit_sql('x', [r[j] for r in w1], b1[j])}, 0::double)" for j in range(HIDDEN)
    )
    scores = ", ".join(_unit_sql("h", [r[j] for r in w2], b2[j]) for j in range(CLASSES))
    outs = ", ".join(f"round(p[{j + 1}] / list_sum(p), 6) as p{j}" for j in range(CLASSES))
    return f"""with a as (select vec_id, embedding::double[] as x from embeddings),
        b as (select vec_id, [{hidden}] as h from a),
        c as (select vec_id, [{scores}] as s from b),
        d as (select vec_id, list_transform(s, lambda y: exp(y - list_max(s))) as p from c)
        select vec_id, {outs}, cast(list_position(p, list_max(p)) - 1 as integer) as predicted from d"""


@query("dense_softmax_score", _head_sql())
def dense_softmax_score(spark, sf_dir):
    df = view(spark, sf_dir, "embeddings").select(
        "vec_id", dense("embedding", head_layers()).alias("p")
    )
    return df.select(
        "vec_id",
        *[F.round(F.col("p")[j], 6).alias(f"p{j}") for j in range(CLASSES)],
        argmax("p").alias("predicted"),
    )


@query(
    "argmax_class",
    """select row_id, label, cast(list_position(logits, list_max(logits)) - 1 as integer) as predicted,
              round(list_max(e) / list_sum(e), 6) as confidence
       from (select *, list_transform(logits::double[],
                lambda x: exp(x - list_max(logits)::double)) as e from logits) x""",
    ("logits",),
)
def argmax_class(spark, sf_dir):
    df = view(spark, sf_dir, "logits")
    return df.select(
        "row_id", "label",
        argmax("logits").alias("predicted"),
        F.round(F.array_max(softmax("logits")), 6).alias("confidence"),
    )


def _linear(x):
    import numpy as np

    w = np.array([[weight(i, j) for j in range(CLASSES)] for i in range(DIMS)])
    return x @ w


def _linear_sql() -> str:
    outs = ", ".join(
        f"round({_unit_sql('x', [weight(i, j) for i in range(DIMS)], 0)}, 6) + 0::double as s{j}"
        for j in range(CLASSES)
    )
    return f"select vec_id, {outs} from (select vec_id, embedding::double[] as x from embeddings) y"


@query(
    "batch_score_nulls",
    f"""select vec_id, case when vec_id % 3 > 0 then s0 end as s0, case when vec_id % 3 > 0 then s1 end as s1
        from ({_linear_sql()}) z""",
)
def batch_score_nulls(spark, sf_dir):
    vector = F.when(F.col("vec_id") % 3 > 0, F.col("embedding"))
    df = view(spark, sf_dir, "embeddings").select("vec_id", models.batch_score(vector, _linear).alias("s"))
    return df.select("vec_id", *[F.round(F.col("s")[j], 6).alias(f"s{j}") for j in range(2)])


@query("batch_score_udf", _linear_sql())
def batch_score_udf(spark, sf_dir):
    df = view(spark, sf_dir, "embeddings").select(
        "vec_id", models.batch_score("embedding", _linear).alias("s")
    )
    return df.select(
        "vec_id", *[F.round(F.col("s")[j], 6).alias(f"s{j}") for j in range(CLASSES)]
    )


@query("batch_score_saved", _head_sql())
def batch_score_saved(spark, sf_dir):
    """The head of ``dense_softmax_score``, written to storage and opened by each worker."""
    path = scratch_path(spark, "head")
    models.save_weights(spark, path, head_layers())
    score = models.saved_scorer(path, DIMS, batch_size=256)
    df = view(spark, sf_dir, "embeddings").select("vec_id", score("embedding").alias("p"))
    return df.select(
        "vec_id",
        *[F.round(F.col("p")[j], 6).alias(f"p{j}") for j in range(CLASSES)],
        argmax("p").alias("predicted"),
    )


LENGTHS_SQL = f"""{TOKENS_SQL}, sized as (select review_id, len(tokens) as n_tokens from docs),
    placed as (select *, (row_number() over (order by n_tokens, review_id) - 1) // 32 as by_length,
                 (row_number() over (order by review_id) - 1) // 32 as in_order from sized)"""


def _sized(spark, sf_dir):
    return tokenized(spark, sf_dir).select("review_id", F.size("tokens").cast("bigint").alias("n_tokens"))


@query(
    "length_batches",
    f"with {LENGTHS_SQL} select review_id, n_tokens, by_length as batch from placed",
    ("review_docs",),
)
def length_batches(spark, sf_dir):
    return numbering.length_batches(_sized(spark, sf_dir), 32)


@query(
    "padding_share",
    f"""with {LENGTHS_SQL},
        a as (select by_length, max(n_tokens) * count(*) as cells, sum(n_tokens) as used from placed group by 1),
        b as (select in_order, max(n_tokens) * count(*) as cells, sum(n_tokens) as used from placed group by 1),
        x as (select sum(cells)::bigint as c, sum(cells - used)::bigint as p from a),
        y as (select sum(cells)::bigint as c, sum(cells - used)::bigint as p from b)
        select 'by_length' as batching, c as cells, p as padding, round(p / c::double, 6) as share from x
        union all select 'in_order', c, p, round(p / c::double, 6) from y""",
    ("review_docs",),
)
def padding_share(spark, sf_dir):
    rows = _sized(spark, sf_dir)
    unordered = numbering.numbered(rows, [F.col("review_id")], "_place")
    frames = {
        "by_length": numbering.length_batches(rows, 32),
        "in_order": unordered.select("n_tokens", F.floor(F.col("_place") / 32).alias("batch")),
    }
    parts = [
        numbering.padding_share(df).select(F.lit(name).alias("batching"), "cells", "padding", F.round("share", 6).alias("share"))
        for name, df in frames.items()
    ]
    return parts[0].unionByName(parts[1])
