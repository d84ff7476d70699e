"""What the catalog says about its words: frequencies, spelling dictionary, brands, synonym groups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import idf_weight, is_generic
from ..functions.text import normalize, tokenize

FACET_PRODUCTS, AMBIGUOUS_LEAST, AMBIGUOUS_FACTOR, ALIAS_FREQUENCY = 20, 5, 2, 5


def words(*columns) -> Column:
    """The distinct tokens of several fields of a row."""
    return F.array_distinct(F.concat(*(tokenize(normalize(c)) for c in columns)))


def token_df(products: DataFrame, least: int = 2) -> DataFrame:
    """(token, df): products that hold a token in title or tags."""
    return products.select(F.explode(words("title", "tags")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def token_weights(products: DataFrame, ratio: float = 0.15) -> DataFrame:
    """(token, df, generic, weight) of every token of the catalog."""
    n = products.agg(F.count(F.lit(1))).scalar()
    generic = is_generic(F.col("token"), F.col("df"), n, ratio)
    return token_df(products).select("token", "df", generic.alias("generic"), idf_weight(F.col("df"), n, generic).alias("weight"))


def spell_dictionary(products: DataFrame) -> DataFrame:
    """(token, freq): products that hold a token of two or more characters in title, brand or tags."""
    return products.select(F.explode(words("title", "brand", "tags")).alias("token")).where(F.length("token") >= 2).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def with_alias_terms(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """Alias words count as frequent: at least five."""
    alias = terms.select(F.explode(tokenize(normalize("term"))).alias("token")).where(F.length("token") >= 2).distinct().withColumn("alias", F.lit(ALIAS_FREQUENCY))
    return dictionary.join(alias, "token", "full").select("token", F.greatest(F.coalesce("freq", F.lit(0)), F.coalesce("alias", F.lit(0))).alias("freq"))


def facet_terms(products: DataFrame, least: int = FACET_PRODUCTS) -> DataFrame:
    """(term, products): prefixes of at least three characters held by the specs of ``least`` products, among the specs' own tokens."""
    held = products.select("product_id", F.explode(words("specs")).alias("word"))
    tokens = held.select(F.col("word").alias("term")).distinct().where(F.length("term") >= 3)
    met = tokens.join(held.withColumn("key", F.substring("word", 1, 3)), (F.substring("term", 1, 3) == F.col("key")) & F.startswith(F.col("word"), F.col("term")))
    return met.groupBy("term").agg(F.count_distinct("product_id").alias("products")).where(F.col("products") >= least)


def brands(products: DataFrame, seeds: tuple[str, ...] = ()) -> DataFrame:
    """(brand, n, others, ambiguous): ambiguous if products of other brands hold the phrase in title or tags too often."""
    phrase = F.array_join(tokenize(normalize("brand")), " ")
    rows = products.select("product_id", phrase.alias("brand"), F.concat(F.lit(" "), F.array_join(F.concat(tokenize(normalize("title")), tokenize(normalize("tags"))), " "), F.lit(" ")).alias("text"))
    counts = rows.where((F.length("brand") >= 2) & ~F.col("brand").rlike("^[0-9]+$")).groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    # phrases meet texts through their first word, not pair by pair
    names = counts.select(F.col("brand").alias("name"), F.split("brand", " ")[0].alias("word"))
    texts = rows.select("product_id", F.col("brand").alias("own"), "text", F.explode(F.array_distinct(F.split(F.trim("text"), " "))).alias("word"))
    other = texts.join(names, "word").where((F.col("own") != F.col("name")) & F.contains("text", F.concat(F.lit(" "), F.col("name"), F.lit(" "))))
    other = other.groupBy(F.col("name").alias("brand")).agg(F.count(F.lit(1)).alias("others"))
    out = counts.join(other, "brand", "left").withColumn("others", F.coalesce("others", F.lit(0)))
    seeded = F.col("brand").isin(*seeds) if seeds else F.lit(False)
    return out.withColumn("ambiguous", seeded | (F.col("others") >= F.greatest(F.lit(AMBIGUOUS_LEAST), AMBIGUOUS_FACTOR * F.col("n"))))


def titles_with(products: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """Ids of products whose title holds one of the phrases as whole words."""
    text = F.concat(F.lit(" "), F.array_join(tokenize(normalize("title")), " "), F.lit(" "))
    hit = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, F.concat(F.lit(" "), p, F.lit(" "))))
    return products.where(hit).select("product_id")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder that the session names for checkpoints; checkpointed in memory of the plan only where none is named."""
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.persist()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def there(df: DataFrame) -> bool:
    """Whether the first file that ``df`` reads still exists."""
    files, spark = df.inputFiles(), df.sparkSession
    if not files:
        return True
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def groups_of(pairs: DataFrame) -> DataFrame:
    """(node, label): connected components of (a, b) text pairs, each named by its smallest member."""
    both = kept(pairs.union(pairs.select("b", "a")).distinct(), "pairs")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = kept(step, "labels")
        own = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = kept(step.join(own, "label").select("node", "old", F.col("next").alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def synonym_groups(products: DataFrame, key: str, member: str) -> DataFrame:
    """(label, members): members (say categories) that share a key (say a model), directly or through others; groups of two or more."""
    rows = products.select(F.col(key).alias("k"), F.col(member).alias("m")).where("k <> '' and m <> ''").distinct()
    # a star around the smallest member of each key connects what all its pairs would
    star = rows.join(rows.groupBy("k").agg(F.min("m").alias("a")), "k").where("m <> a").select("a", F.col("m").alias("b")).distinct()
    grouped = groups_of(star).groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("node")), ",").alias("members"), F.count(F.lit(1)).alias("size"))
    return grouped.where("size > 1").select("label", "members")


def joined_names(rows: DataFrame, key: str, value: str, separator: str = ", ", limit: int = 255) -> DataFrame:
    """The distinct values of each key in order, joined and cut."""
    return rows.where(F.col(value) != "").groupBy(key).agg(F.substring(F.array_join(F.array_sort(F.collect_set(value)), separator), 1, limit).alias("names"))
