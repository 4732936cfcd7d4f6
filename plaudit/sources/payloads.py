"""API payloads: JSON text to flat rows and rejects. A payload is one page of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plaudit import schemas
from plaudit.functions.missing import null_to_na

FACET_FIELDS = list(schemas.FACETS)

# The parser puts the text of a payload that does not fit the schema here.
CORRUPT = "_corrupt"


def parse_payloads(payloads: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """``payloads`` with ``_body``; its field ``_corrupt`` is not null where the text does not fit the schema."""
    whole = T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])
    return payloads.withColumn("_body", F.from_json(payload, whole, {"columnNameOfCorruptRecord": CORRUPT}))


def _rejected(reason: Column) -> Column:
    """Reason of a payload that cannot be read at all, else ``reason``."""
    return F.when(F.col("_body").isNull() | F.col(f"_body.{CORRUPT}").isNotNull(), "not a payload").otherwise(reason)


def split_review_payload(
    payloads: DataFrame, payload: str = "payload", offset: str | None = None, page: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The (rows, rejects) of review payloads: one row per review, absent or null fields as ``NA``.

    No more results than the total beyond ``offset`` are taken, and no more than ``page`` if the
    caller asked the service for pages of that length. A total of 0 is an answer without reviews.
    Rejects keep their columns and a ``reason``: text that is no such payload, a payload without
    a total, and one with a total but no list of results.
    """
    parsed = parse_payloads(payloads, payload, schemas.REVIEW_PAYLOAD)
    total, results = F.col("_body.TotalResults"), F.col("_body.Results")
    reason = _rejected(F.when(total.isNull(), "no total").when((total > 0) & results.isNull(), "no results"))
    left = total - (F.col(offset) if offset else F.lit(0))
    left = (left if page is None else F.least(left, F.lit(page))).cast("int")
    # What is taken tells rows from rejects, so the text is parsed once.
    taken = F.when(reason.isNull() & (total > 0) & (left > 0), F.slice(results, F.lit(1), left))
    kept = [c for c in payloads.columns if c not in (payload, offset)]

    def facet(name: str) -> Column:
        value = F.try_element_at(F.col("_r.ContextDataValues"), F.lit(name))
        return null_to_na(value.getField("ValueLabel")).alias(name)

    rows = (parsed.select(*kept, F.explode_outer(taken).alias("_r")).where("_r IS NOT NULL")
            .select(*kept,
                    null_to_na("_r.UserNickname").alias("userNickname"),
                    null_to_na("_r.Rating").alias("rating"),
                    *[facet(name) for name in FACET_FIELDS],
                    null_to_na("_r.ReviewText").alias("review")))
    return rows, _rejects(parsed, reason)


def split_product_payload(
    payloads: DataFrame, payload: str = "payload", brand_id: str = "Brand_id", pages: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The (rows, rejects) of product listings: one row per listed product, a null name as ``NA``.

    No more products than the total are taken; a total of 0 is an empty listing. Rejects keep
    their columns and a ``reason``: text that is no such payload, a listing without a total, and
    one whose total is not the number of products given. With ``pages`` the payloads of a brand
    are the pages of one listing, and their products are counted together; else each is a listing
    of its own. Products of a listing that disagrees are rows all the same.
    """
    parsed = parse_payloads(payloads, payload, schemas.PRODUCT_PAYLOAD)
    total, products = F.col("_body.total_products"), F.col("_body.products")
    missing = _rejected(F.when(total.isNull(), "no total"))
    taken = F.when(missing.isNull() & (total > 0), F.slice(products, F.lit(1), total.cast("int")))
    listing = parsed.select(F.col(brand_id).alias("Brand_id"), F.col("_body.brand.brand_name").alias("brand_name"),
                            F.explode_outer(taken).alias("_p"))
    rows = listing.where("_p IS NOT NULL").select(
        F.col("_p.id").alias("ProductID"), null_to_na("_p.display_name").alias("Product_name"),
        "Brand_id", null_to_na("brand_name").alias("Brand_name"))
    given = F.coalesce(F.size(products), F.lit(0))
    if not pages:
        return rows, _rejects(parsed, F.coalesce(missing, _disagrees(total, given)))
    sums = parsed.where(missing.isNull()).groupBy(F.col(brand_id).alias("_brand")).agg(
        F.max(total).alias("_total"), F.sum(given).alias("_given"))
    summed = parsed.join(sums, F.col(brand_id).eqNullSafe(F.col("_brand")), "left")
    return rows, _rejects(summed, F.coalesce(missing, _disagrees(F.col("_total"), F.col("_given")))).drop("_brand", "_total", "_given")


def _disagrees(total: Column, given: Column) -> Column:
    return F.when(total != given, F.concat(F.lit("total "), total, F.lit(", given "), given))


def _rejects(parsed: DataFrame, reason: Column) -> DataFrame:
    return parsed.withColumn("reason", reason).where("reason IS NOT NULL").drop("_body")


def flatten_review_payload(
    payloads: DataFrame, payload: str = "payload", offset: str | None = None, page: int | None = None,
) -> DataFrame:
    """The rows of ``split_review_payload``."""
    return split_review_payload(payloads, payload, offset, page)[0]


def flatten_product_payload(
    payloads: DataFrame, payload: str = "payload", brand_id: str = "Brand_id",
) -> DataFrame:
    """The rows of ``split_product_payload``."""
    return split_product_payload(payloads, payload, brand_id)[0]
