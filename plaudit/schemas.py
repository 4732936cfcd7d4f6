"""Table schemas, payload schemas and the closed facet domains."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# The nine fields of a stored review, in file order.
REVIEW_FIELDS = [
    "productID", "userNickname", "rating", "age", "eyeColor",
    "hairColor", "skinTone", "skinType", "review",
]

REVIEW = T.StructType([T.StructField("fileIndex", T.LongType()), *_strings(*REVIEW_FIELDS)])
PRODUCT = _strings("ID", "Product_name", "Brand_id", "Brand_name")
BRAND_URL = _strings("Brand_ID", "Brand_URL")
POLARITY_SAMPLE = _strings("rating", "review")

_CONTEXT_VALUE = T.StructType([T.StructField("ValueLabel", T.StringType())])
REVIEW_PAYLOAD = T.StructType([
    T.StructField("TotalResults", T.LongType()),
    T.StructField("Results", T.ArrayType(T.StructType([
        T.StructField("UserNickname", T.StringType()),
        T.StructField("Rating", T.StringType()),
        T.StructField("ReviewText", T.StringType()),
        T.StructField("ContextDataValues", T.MapType(T.StringType(), _CONTEXT_VALUE)),
    ]))),
])

PRODUCT_PAYLOAD = T.StructType([
    T.StructField("page_size", T.LongType()),
    T.StructField("total_products", T.LongType()),
    T.StructField("brand", T.StructType([T.StructField("brand_name", T.StringType())])),
    T.StructField("products", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("display_name", T.StringType()),
    ]))),
])

# The closed list of each customer facet.
FACETS = {
    "age": ("13-17", "18-24", "25-34", "35-44", "45-54", "over 54"),
    "eyeColor": ("Brown", "Blue", "Hazel", "Green", "Gray"),
    "hairColor": ("Brunette", "Auburn", "Black", "Red", "Gray", "Blonde"),
    "skinTone": ("Olive", "Light", "Medium", "Fair", "Porcelain", "Deep", "Tan", "Dark", "Ebony"),
    "skinType": ("Normal", "Combination", "Dry", "Oily"),
}
