"""Category paths and code enrichment of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions import text
from cartloom.operators import fuzzy

# Dosage-form words whose products are worth a code lookup.
FORM_WORDS = [
    "порошок", "таблетки", "мазь", "средсвто", "каплусы", "раствор", "сироп", "спрей", "капли",
    "жидкость", "крем", "гель", "суспензия", "смесь", "лиофизилат", "бальзам",
    "суппозитории ректальные", "эмульсия",
]

# Column names of the export.
EXPORT_HEADER = [
    "ga:productSku", "ga:productName", "ga:productBrand", "ga:productCategoryHierarchy",
]


def category_path(goods: DataFrame, categories: DataFrame) -> DataFrame:
    """``sku, name, brand, path`` with the path from leaf to grandparent.

    Goods without a category are left out; a missing parent shortens the path.
    The category table joins itself twice first: it is far smaller than goods.
    """
    levels = categories.select("id", "name", F.col("parentId").alias("p1"))
    parents = categories.select(
        F.col("id").alias("p1"), F.col("name").alias("n1"), F.col("parentId").alias("p2")
    )
    tops = categories.select(F.col("id").alias("p2"), F.col("name").alias("n2"))
    paths = (
        levels.join(parents, "p1", "left")
        .join(tops, "p2", "left")
        .select(F.col("id").alias("siteCatId"), F.concat_ws("/", "name", "n1", "n2").alias("path"))
    )
    wanted = goods.where(F.col("siteCatId").isNotNull() & ~F.col("siteCatId").cast("string").isin("", "0"))
    return wanted.join(paths, "siteCatId").select(
        F.col("id").alias("sku"),
        "name",
        F.coalesce("manufacturer", F.lit("-")).alias("brand"),
        "path",
    )


def export_header(paths: DataFrame) -> DataFrame:
    return paths.toDF(*EXPORT_HEADER)


def best_dictionary_match(
    names: DataFrame, dictionary: DataFrame, cutoff: int = 90, scorer: str = "auto"
) -> DataFrame:
    """``name, key, score``: the best dictionary key per name, lower key on ties.

    ``scorer='auto'`` uses the weighted score for names of two to five words
    and the plain ratio otherwise; ``'ratio'`` and ``'weighted'`` force one.
    """
    keys = dictionary.select(F.col("name").alias("right_name")).distinct()
    left = names.select(F.col("name").alias("left_name")).distinct()
    several = F.expr(f"{text.word_count('left_name')} BETWEEN 2 AND 5")
    if scorer == "ratio":
        scored = fuzzy.ratio_pairs(left, keys, cutoff)
    elif scorer == "weighted":
        scored = fuzzy.weighted_pairs(left, keys, cutoff)
    else:
        scored = fuzzy.weighted_pairs(left.where(several), keys, cutoff).unionByName(
            fuzzy.ratio_pairs(left.where(~several), keys, cutoff)
        )
    order = Window.partitionBy("left_name").orderBy(F.desc("score"), "right_name")
    return (
        scored.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") == 1)
        .select(F.col("left_name").alias("name"), F.col("right_name").alias("key"), "score")
    )


def enrich_codes(
    products: DataFrame,
    dictionary: DataFrame,
    form_words: list[str] | None = None,
    cutoff: int = 90,
    scorer: str = "auto",
    registry: DataFrame | None = None,
) -> DataFrame:
    """Products with the column ``atx`` filled from a (name, atx) dictionary.

    Only products whose dosage form contains one of the words take part. The
    name is the trade name, else the name. Short names without a match are
    looked up in the optional ``registry`` (name, atx).
    """
    words = FORM_WORDS if form_words is None else form_words
    vocabulary = F.array(*[F.lit(w) for w in words])
    fits = F.coalesce(F.exists(vocabulary, lambda w: F.contains("medForm", w)), F.lit(False))
    asked = products.drop("atx").withColumn(
        "_name", F.when(fits, F.coalesce("tradeName", "name"))
    )
    names = asked.where(F.col("_name").isNotNull()).select(F.col("_name").alias("name")).distinct()
    # One code per name, the least, or a name listed twice would double its products.
    codes = dictionary.groupBy(F.col("name").alias("key")).agg(F.min("atx").alias("_dict"))
    matched = best_dictionary_match(names, dictionary, cutoff, scorer).join(codes, "key").select(
        F.col("name").alias("_name"), "_dict"
    )
    out = asked.join(matched, "_name", "left")
    found = F.col("_dict")
    if registry is not None:
        listed = registry.groupBy(F.col("name").alias("_name")).agg(F.min("atx").alias("_reg"))
        out = out.join(listed, "_name", "left")
        short = F.expr(f"{text.word_count('_name')} < 5 AND length(_name) > 4")
        found = F.coalesce(found, F.when(short, F.col("_reg")))
        return out.withColumn("atx", found).drop("_name", "_dict", "_reg")
    return out.withColumn("atx", found).drop("_name", "_dict")
