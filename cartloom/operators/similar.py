"""Substitute products: by code, by fuzzy name within equal forms, diversified.

Joins by product, request or code group are shuffled: their sides grow with the catalogue
or the requests, and files of repeated words look small enough to Spark to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartloom.functions import text
from cartloom.operators import fuzzy
from cartloom.session import settle, shuffled

CODE_SCORE = 1.0


def has_code(code: Column) -> Column:
    return F.coalesce(F.length(code) > 0, F.lit(False))


# A limit is one number for the job, or the name of a column of the queries;
# None, NULL and 0 mean no limit.
Limit = int | str | None


def _requests(queries: DataFrame, limit: Limit, request: str) -> DataFrame:
    """``_req, id, _limit`` (0: none), one row per request.

    Requests are told apart by the column ``request``. If that is the id, an
    id asked several times is one request with the largest of its limits.
    """
    bound = F.col(limit).cast("int") if isinstance(limit, str) else F.lit(limit)
    rows = queries.select(F.col(request).alias("_req"), "id", F.coalesce(bound, F.lit(0)).alias("_limit"))
    open_ended = F.max((F.col("_limit") <= 0).cast("int")) == 1
    return rows.groupBy("_req", "id").agg(F.when(open_ended, 0).otherwise(F.max("_limit")).alias("_limit"))


def _named_request(found: DataFrame, request: str) -> DataFrame:
    return found.drop("_req") if request == "id" else found.withColumnRenamed("_req", request)


def similar_by_code(queries: DataFrame, catalogue: DataFrame, limit: Limit = None, request: str = "id") -> DataFrame:
    """``id, similar_id, score``: products whose code agrees up to the last character.

    With a limit the siblings are the first ones by id, the query left out.
    Then only the first rows of each code group can be an answer, one more
    than the largest limit asked of that group, so a huge group is cut before
    the join instead of paired with itself. ``request`` names a column of the
    queries that tells requests for the same id apart; it is then in the answer.
    """
    coded = catalogue.where(has_code(F.col("atx"))).select(
        "id", text.without_last(F.col("atx")).alias("stem")
    )
    asked = _requests(queries, limit, request).join(shuffled(coded), "id")
    siblings = coded.select(F.col("id").alias("similar_id"), "stem")
    score = F.lit(CODE_SCORE).alias("score")
    unlimited = asked.where("_limit <= 0").join(shuffled(siblings), "stem").where("id <> similar_id").select(
        "_req", "id", "similar_id", score
    )
    if not limit:
        return _named_request(unlimited, request)
    limited = asked.where("_limit > 0")
    most = limited.groupBy("stem").agg(F.max("_limit").alias("_most"))
    in_group = Window.partitionBy("stem").orderBy("similar_id")
    heads = siblings.join(shuffled(most), "stem").withColumn("_r", F.row_number().over(in_group)).where("_r <= _most + 1")
    lists = heads.groupBy("stem").agg(F.array_sort(F.collect_list("similar_id")).alias("ids"))
    own = F.filter("ids", lambda x: x != F.col("id"))
    first = limited.join(lists, "stem").select(
        "_req", "id", F.explode(F.slice(own, F.lit(1), F.col("_limit"))).alias("similar_id"), score
    )
    return _named_request(first.unionByName(unlimited), request)


def form_candidates(asked: DataFrame, catalogue: DataFrame, form_map: DataFrame) -> DataFrame:
    """``asked_name, candidate_form``: forms equal to those of the products with that name.

    A product has the name if either its trade name or its normalised name is
    it. A form missing from the map leads nowhere.
    """
    named = (
        catalogue.select(F.col("tradeName").alias("asked_name"), "medForm")
        .unionByName(catalogue.select(F.col("normalized_name").alias("asked_name"), "medForm"))
        .where(F.col("asked_name").isNotNull())
        .distinct()
    )
    wanted = asked.select("asked_name").distinct()
    edges = form_map.select(F.col("form").alias("medForm"), F.col("equal_form").alias("candidate_form"))
    return (
        named.join(wanted, "asked_name", "left_semi")
        .join(edges, "medForm")
        .select("asked_name", "candidate_form")
        .distinct()
    )


def asked_products(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Query products without a code, with the name they're looked up by."""
    plain = catalogue.where(~has_code(F.col("atx")))
    return plain.join(shuffled(queries.select("id").distinct()), "id", "left_semi").select(
        "id",
        F.coalesce("tradeName", "normalized_name").alias("asked_name"),
        F.col("normalized_name").alias("own_name"),
    )


def dosage_forms(queries: DataFrame, catalogue: DataFrame, form_map: DataFrame) -> DataFrame:
    """``id, candidate_form`` for every query product without a code."""
    asked = asked_products(queries, catalogue)
    return asked.join(form_candidates(asked, catalogue, form_map), "asked_name").select(
        "id", "candidate_form"
    )


def _scored_names(
    asked: DataFrame, catalogue: DataFrame, form_map: DataFrame, cutoff: int
) -> tuple[DataFrame, DataFrame]:
    """The asked names with the forms they reach, and each pair of names at the cutoff with the forms it is stocked in.

    ``asked_name, own_name, fs`` and ``own_name, found_name, score, gs``.
    """
    kinds = asked.select("asked_name", "own_name").distinct()
    forms = form_candidates(asked, catalogue, form_map)
    shelf = catalogue.select(F.col("medForm").alias("block"), F.col("normalized_name").alias("right_name")).distinct()
    left = (
        kinds.join(forms, "asked_name")
        .select(F.col("candidate_form").alias("block"), F.col("own_name").alias("left_name"))
        .distinct()
    )
    # Both sides feed several candidate routes: each is built once.
    shelf, forms = settle(shelf, "shelf"), settle(forms, "forms")
    scored = settle(fuzzy.token_set_pairs(settle(left, "asked-names"), shelf, cutoff), "matched-names")
    # Sets of forms: their number is the size of the form vocabulary at most.
    reachable = forms.groupBy("asked_name").agg(F.sort_array(F.collect_set("candidate_form")).alias("fs"))
    stocked = shelf.groupBy("right_name").agg(F.collect_set("block").alias("gs"))
    pairs = scored.join(stocked, "right_name").select(
        F.col("left_name").alias("own_name"), F.col("right_name").alias("found_name"), "score", "gs"
    )
    return kinds.join(reachable, "asked_name"), pairs


def _matched_names(
    asked: DataFrame, catalogue: DataFrame, form_map: DataFrame, cutoff: int
) -> DataFrame:
    """``asked_name, own_name, found_name, score`` once per distinct pair of asked names.

    Products sharing both names share the answer, so copies cost nothing.
    """
    kinds, pairs = _scored_names(asked, catalogue, form_map, cutoff)
    return kinds.join(pairs, "own_name").where(F.arrays_overlap("fs", "gs")).select(
        "asked_name", "own_name", "found_name", "score"
    )


def _first_rows(catalogue: DataFrame) -> DataFrame:
    """The lowest id of each name stands for the name."""
    return catalogue.groupBy(F.col("normalized_name").alias("found_name")).agg(
        F.min("id").alias("similar_id"), F.min_by("company_name", "id").alias("company")
    )


def similar_fuzzy(
    queries: DataFrame,
    catalogue: DataFrame,
    form_map: DataFrame,
    cutoff: int = 80,
    limit: Limit = None,
    request: str = "id",
) -> DataFrame:
    """``id, similar_id, score, rnk`` for query products without a code (score 0-100).

    Matches are found once per id, and ranked for each request.
    """
    asked = settle(asked_products(queries, catalogue), "asked-products")
    found = _matched_names(asked, catalogue, form_map, cutoff).join(_first_rows(catalogue), "found_name")
    rows = shuffled(asked).join(found, ["asked_name", "own_name"]).where(F.col("id") != F.col("similar_id"))
    matches = rows.select("id", "similar_id", "score", "company").join(shuffled(_requests(queries, limit, request)), "id")
    ranked = diversify(matches, "_limit" if limit else None, "_req")
    return _named_request(ranked.select("_req", "id", "similar_id", "score", "rnk"), request)


def diversify(matches: DataFrame, limit: Limit = None, key: str = "id") -> DataFrame:
    """Rank the matches of each query; with a limit, spread them over companies.

    With more matches than the limit, a company may place
    ``ceil(limit / companies)`` rows before others fill up by score; at a
    share of one or less it's the plain best ``limit`` rows. A missing company
    is the company ''.
    """
    by_score = [F.desc("score"), F.asc("similar_id")]
    per_query = Window.partitionBy(key)
    if not limit:
        return matches.withColumn("rnk", F.row_number().over(per_query.orderBy(*by_score)))
    matches = matches.withColumn("_company", F.coalesce("company", F.lit("")))
    totals = matches.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("_company").alias("_companies")
    )
    bound = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    bound = F.when(bound > 0, bound)
    share = F.ceil(bound / F.col("_companies"))
    place = F.row_number().over(Window.partitionBy(key, "_company").orderBy(*by_score))
    spread = F.coalesce((F.col("_n") > bound) & (F.col("_share") > 1), F.lit(False))
    first = F.when(~spread | (F.col("_place") <= F.col("_share")), 0).otherwise(1)
    return (
        matches.withColumn("_place", place)
        .join(shuffled(totals), key)
        .withColumn("_share", share)
        .withColumn("_late", first)
        .withColumn("rnk", F.row_number().over(per_query.orderBy("_late", *by_score)))
        .where(bound.isNull() | (F.col("rnk") <= bound))
        .drop("_place", "_n", "_company", "_companies", "_share", "_late")
    )


def similar_products(
    queries: DataFrame,
    catalogue: DataFrame,
    form_map: DataFrame,
    cutoff: int = 80,
    limit: Limit = None,
    request: str = "id",
) -> DataFrame:
    """``id, similar_id, name, score``: by code if the product has one, else by name.

    Unknown ids give no row. Codes found elsewhere are joined to the catalogue
    first (``catalog.enrich_codes``). With ``request``, a column that tells
    requests apart, the answer has that column too.
    """
    own = [] if request == "id" else [request]
    by_code = similar_by_code(queries, catalogue, limit, request)
    by_name = similar_fuzzy(queries, catalogue, form_map, cutoff, limit, request).select(
        *own, "id", "similar_id", (F.col("score") / 100).alias("score")
    )
    names = catalogue.select(F.col("id").alias("similar_id"), F.col("normalized_name").alias("name"))
    return by_code.unionByName(by_name).join(shuffled(names), "similar_id").select(
        *own, "id", "similar_id", "name", "score"
    )


def similar_counts(catalogue: DataFrame, form_map: DataFrame, cutoff: int = 75) -> DataFrame:
    """``id, n_similar`` of every product, without listing the pairs.

    A coded product has its group's size minus one. The others' matches are
    counted by names: once for each own name and set of forms that its products
    reach, however many products or asked names lead there, minus the product
    itself where it stands for its own name.
    """
    stem = text.without_last(F.col("atx"))
    coded = catalogue.where(has_code(F.col("atx"))).select("id", stem.alias("stem"))
    groups = coded.groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    by_code = coded.join(groups, "stem").select("id", (F.col("n") - 1).alias("n_similar"))

    asked = settle(asked_products(catalogue, catalogue), "asked-products")
    kinds, pairs = _scored_names(asked, catalogue, form_map, cutoff)
    kinds = settle(kinds, "asked-kinds")
    itself = F.max((F.col("found_name") == F.col("own_name")).cast("int")).alias("itself")
    counted = (
        kinds.select("own_name", "fs").distinct()
        .join(pairs, "own_name")
        .where(F.arrays_overlap("fs", "gs"))
        .groupBy("own_name", "fs")
        .agg(F.count(F.lit(1)).alias("n"), itself)
    )
    first = _first_rows(catalogue).select(F.col("found_name").alias("own_name"), "similar_id")
    own = F.when(F.col("id") == F.col("similar_id"), F.col("itself")).otherwise(0)
    by_name = (
        asked.join(kinds, ["asked_name", "own_name"], "left")
        .join(counted, ["own_name", "fs"], "left")
        .join(first, "own_name", "left")
        .select("id", F.coalesce(F.col("n") - own, F.lit(0)).alias("n_similar"))
    )
    return by_code.unionByName(by_name)
