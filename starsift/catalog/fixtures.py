"""Views that shape the benchmark tables like review files.

Each view is one SELECT with two dialect macros; Spark runs it over DataFrames,
the SQL counterparts inline it as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starsift.sources.files import read_table

VIEWS = {
    "reviews": """
        select md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string),
                 cast(l_partkey as string), cast(l_suppkey as string),
                 cast(cast(round(l_extendedprice*100) as bigint) as string))) as review_id,
               cast(o_custkey % greatest(50, (select cast(floor(count(*)/300) as bigint) from {orders}))
                 as bigint) as customer_id,
               cast(l_partkey % 60 as bigint) as product_id,
               p_name as review_headline,
               concat(p_type, ' ', p_name, ' ', p_brand) as review_body,
               cast((cast(l_quantity as int) - 1) % 5 + 1 as int) as star_rating
        from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey
    """,
    "review_docs": """
        select doc_id as review_id,
               doc_id % 37 as customer_id,
               cast(floor(doc_id / 3) as bigint) % 41 as product_id,
               case when doc_id % 29 = 0 then null else source end as review_headline,
               case when doc_id % 31 = 0 then null else text end as review_body,
               cast(1 + n_chars % 5 as int) as star_rating,
               lang
        from {documents}
    """,
    "review_raw": """
        select doc_id as review_id,
               case when doc_id % 29 = 0 then null else source end as review_headline,
               concat('<p class="x">', substring(text, 1, 100), '</p><br/> ', url, ' ',
                      substring(text, 101)) as review_body,
               cast(1 + n_chars % 5 as int) as star_rating
        from {documents} join {pages} on page_id = doc_id % (select count(*) from {pages})
    """,
    "predictions": """
        select review_id, cast(star_rating as double) as label,
               cast(case when h % 10 < 6 then star_rating else 1 + h % 5 end as double) as prediction,
               h % 7 as grid_id, cast(floor(h / 7) as bigint) % 5 as fold
        from (select review_id, star_rating, {HEX} as h from {reviews}) x
    """,
    "logits": """
        select vec_id as row_id, label, embedding as logits from {embeddings}
    """,
}

TABLES = ["lineitem", "orders", "part", "documents", "pages", "embeddings", "labels"]

_NEEDS = {
    "reviews": ["lineitem", "orders", "part"],
    "review_docs": ["documents"],
    "review_raw": ["documents", "pages"],
    "predictions": ["reviews"],
    "logits": ["embeddings"],
}

_SPARK_MACROS = {
    "HEX": "cast(conv(substr(review_id,1,8),16,10) as bigint)",
}
_SQL_MACROS = {"HEX": "('0x'||substr(review_id,1,8))::BIGINT"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a base table."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    frames = {need: view(spark, sf_dir, need) for need in _NEEDS[name]}
    text = VIEWS[name]
    for macro, body in _SPARK_MACROS.items():
        text = text.replace("{" + macro + "}", body)
    return spark.sql(text, **frames)


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """``sql`` after CTEs for the views it uses; its own CTEs follow them."""
    names: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name in VIEWS and name not in names:
            names.append(name)

    for name in uses:
        add(name)
    ctes = []
    for name in names:
        fill = {n: n for n in [*TABLES, *VIEWS]}
        ctes.append(f"{name} as ({VIEWS[name].format(**fill, **_SQL_MACROS).strip()})")
    body = sql.strip()
    if not ctes:
        return body
    for word in ("with recursive ", "with "):
        if body.lower().startswith(word):
            return word + ", ".join(ctes) + ", " + body[len(word):]
    return "with " + ", ".join(ctes) + " " + body
