"""Payment-level features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions import exprs as X


def payment_frequency(payments: DataFrame, key: str = "npi") -> DataFrame:
    """Payments of each id over the whole table; null ids are dropped, 0 is counted."""
    return payments.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("payment_frequency"))


def payment_features(payments: DataFrame) -> DataFrame:
    """The feature row of each payment; unknown frequencies stay null.

    Reads record_id, npi, amount, n_payments, form, nature, specialty, manufacturer, date_text, ownership,
    third_party, charity, related and disputed.
    """
    on = X.parse_date(F.col("date_text"))
    flags = {"is_ownership_interest": "ownership", "is_charity": "charity", "is_related_product": "related", "is_disputed": "disputed"}
    return payments.join(payment_frequency(payments), "npi", "left").select(
        "record_id", F.col("amount").alias("payment_amount"), X.log_amount(F.col("amount")).alias("payment_amount_log"), F.col("n_payments").alias("num_payments_included"), F.col("form").alias("payment_form"), F.col("nature").alias("payment_nature"), F.col("specialty").alias("recipient_specialty"), F.col("manufacturer").alias("manufacturer_name"),
        F.month(on).alias("payment_month"), F.weekday(on).alias("payment_day_of_week"), *(X.yes_flag(F.col(c)).alias(n) for n, c in flags.items()), X.third_party_flag(F.col("third_party")).alias("is_third_party_payment"), "payment_frequency",
    )


def feature_table(features: DataFrame, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Features with their labels; a payment without labels keeps nulls."""
    return features.join(labels, key, "left")
