"""A catalog export as the rows that the search serves, and the export itself from its source tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import attribute_pairs, clean_tags, collapsed_identity, compose_specs, index_description, normalize, normalize_sku
from .lexicon import joined_names


def server_rows(export: DataFrame, description_chars: int = 0) -> DataFrame:
    """The columns that the search serves, one row per exported product; columns that the export lacks are empty.

    ``export``: product_id, title (or title_fa and title_en), description, brand, category, model, tags,
    attributes (``name: value | ...``), titles (array of feature titles), sku, price, stock, url, image, popularity.
    """
    has = set(export.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has else F.lit("")
    title = text("title") if "title" in has else F.trim(F.concat(text("title_fa"), F.lit(" "), text("title_en")))
    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) if c in has else F.lit(0).cast(kind)
    tags, titles = clean_tags(text("tags")), F.col("titles") if "titles" in has else F.lit(None).cast("array<string>")
    specs = compose_specs(attribute_pairs(text("attributes")), titles)
    rows = export.select(
        F.col("product_id").cast("long").alias("product_id"), title.alias("title"), text("description").alias("description"), specs.alias("specs"), tags.alias("tags"),
        *(text(c).alias(c) for c in ("brand", "category", "model", "sku", "url", "image")), number("price", "double").alias("price"), number("stock", "int").alias("stock"), number("popularity", "long").alias("popularity"),
    )
    return rows.select(
        "product_id", "title", "description", F.trim(F.concat(normalize("title"), F.lit(" "), normalize_sku("sku"))).alias("normalized_title"),
        normalize(index_description("description", description_chars)).alias("normalized_desc"), normalize("specs").alias("normalized_specs"), normalize("tags").alias("normalized_tags"),
        normalize("brand").alias("normalized_brand"), normalize("category").alias("normalized_category"), collapsed_identity("title", "brand", "tags").alias("normalized_collapsed"),
        "tags", "brand", "category", "model", "sku", normalize_sku("sku").alias("normalized_sku"), "price", "stock", "url", "image", "popularity",
    )


def star_export(products: DataFrame, names: dict[str, tuple[DataFrame, str, str]], lists: dict[str, tuple[DataFrame, str, str, str]]) -> DataFrame:
    """SRC1: one row per product, with names looked up and lists of values joined.

    ``names``: column of ``products`` to (table, its key, its name); the name takes the column's place.
    ``lists``: new column to (table, its product key, its value, separator). A product that a table lacks stays.
    """
    out = products
    for column, (table, key, name) in names.items():
        looked = table.groupBy(F.col(key).alias("__key")).agg(F.min(name).alias("__name"))  # a repeated key doesn't repeat products
        out = out.join(looked, F.col(column) == F.col("__key"), "left").withColumn(column, F.coalesce("__name", F.lit(""))).drop("__key", "__name")
    for column, (table, key, value, separator) in lists.items():
        joined = joined_names(table, key, value, separator, 1 << 30).select(F.col(key).alias("__key"), F.col("names").alias("__names"))
        out = out.join(joined, F.col("product_id") == F.col("__key"), "left").withColumn(column, F.coalesce("__names", F.lit(""))).drop("__key", "__names")
    return out


def bounded_count(df: DataFrame, most: int) -> int:
    """The number of rows, or ``most`` if there are as many or more; stops reading there."""
    return df.limit(most).count()


def page_after(df: DataFrame, keys: list[str], after: list | None, size: int) -> DataFrame:
    """The ``size`` rows that follow the key ``after`` in the order of ``keys``; from the start for None."""
    if after is not None:
        some: Column = F.lit(False)
        for i, key in enumerate(keys):
            same: Column = F.lit(True)
            for k, v in zip(keys[:i], after):
                same = same & (F.col(k) == F.lit(v))
            some = some | (same & (F.col(key) > F.lit(after[i])))
        df = df.where(some)
    return df.orderBy(*keys).limit(size)
