"""Origin-destination tables of several countries as one schema: ORIG_CODE, DEST_CODE, trip_count, motive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import code, number, zero_fill

TARGET = ("ORIG_CODE", "DEST_CODE", "trip_count", "motive")
# fixed values: headers of the countries' tables
HEADERS = {
    "RS": {"opstina_stanovanja": "ORIG_CODE", "opstina_rada": "DEST_CODE", "broj": "trip_count"},
    "GB": {
        "Middle layer Super Output Areas code": "ORIG_CODE",
        "MSOA of workplace code": "DEST_CODE",
        "Count": "trip_count",
        "usual_residence": "ORIG_CODE",
        "place_of_work": "DEST_CODE",
        "obs_value": "trip_count",
    },
    "JP": {"residence_code": "ORIG_CODE", "work_school_code": "DEST_CODE", "value": "trip_count"},
    "NL": {"woongemeente": "ORIG_CODE", "werkgemeente": "DEST_CODE", "aantal": "trip_count"},
}
#: Width that codes are filled to with zeros.
WIDTH = {"JP": 5}


def standardize_od(rows: DataFrame, country: str) -> DataFrame:
    """Known headers are renamed where they are there, motive is work where there is none, codes are trimmed text, trips positive
    numbers. Rows without a code or number go. An unknown country is a KeyError, a missing column a ValueError."""
    key = country.upper()
    if key not in HEADERS:
        raise KeyError(f"no headers for {key}; known: {sorted(HEADERS)}")
    named = rows.withColumnsRenamed({k: v for k, v in HEADERS[key].items() if k in rows.columns})
    if "motive" not in named.columns:
        named = named.withColumn("motive", F.lit("work"))
    missing = [c for c in TARGET if c not in named.columns]
    if missing:
        raise ValueError(f"{key}: missing columns {missing}")

    def clean(c: str):  # noqa: ANN202
        text = F.col(c).cast("string")
        return code(zero_fill(text, WIDTH[key]) if key in WIDTH else text).alias(c)

    out = named.select(clean("ORIG_CODE"), clean("DEST_CODE"), number(F.col("trip_count")).alias("trip_count"), "motive")
    return out.where("ORIG_CODE IS NOT NULL AND DEST_CODE IS NOT NULL AND trip_count > 0")
