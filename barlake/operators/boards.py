"""Quote, index and macro boards over landed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlake.functions import first_truthy, percent_change, round_places
from barlake.operators.decode import parse_once
from barlake.operators.latest import top_per_key
from barlake.schemas import OBSERVATION_DOCUMENT


def _field(name: str) -> Column:
    """A metadata field as a variant, null when it is absent."""
    return F.try_variant_get("meta", f"$.{name}", "variant")


def _number(field: str) -> Column:
    """A variant column as a double, null unless it holds a JSON number."""
    kind = F.schema_of_variant(field)
    is_number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(is_number, F.try_variant_get(field, "$", "double"))


def quote_metadata(documents: DataFrame) -> DataFrame:
    """Quote documents (`value`) with the metadata object of their first result added.

    A variant keeps what a typed parse loses: whether a field is absent, null, or not a number.
    """
    meta = F.try_variant_get(F.try_parse_json("value"), "$.chart.result[0].meta", "variant")
    return parse_once(documents, meta, "meta")


def quote_changes(documents: DataFrame) -> DataFrame:
    """Price, previous close, percent change and currency of every quote document.

    The price falls back to the previous close when it is absent, null or zero. An absent previous
    close counts as the price itself, one that is there but null makes the quote unusable.
    """
    fields = quote_metadata(documents).withColumns({
        "quoted_field": _field("regularMarketPrice"),
        "closed_field": _field("previousClose"),
        "currency_field": _field("currency"),
    }).withColumns({
        "quoted": _number("quoted_field"),
        "closed": _number("closed_field"),
    })
    # Text or an object in place of the price cannot be computed with; null and absent fall back.
    not_a_price = (F.col("quoted_field").isNotNull() & F.col("quoted").isNull()
                   & ~F.is_variant_null("quoted_field"))
    priced = (fields
              .withColumn("price_raw", F.when(~not_a_price, first_truthy("quoted", "closed")))
              .withColumn("prev_raw", F.when(F.col("closed_field").isNull(), F.col("price_raw"))
                          .otherwise(F.col("closed")))
              .withColumn("change_raw", percent_change("price_raw", "prev_raw")))
    usable = F.col("price_raw").isNotNull() & F.col("prev_raw").isNotNull()
    currency = F.when(F.col("currency_field").isNull(), F.lit("USD")).otherwise(
        F.try_variant_get("currency_field", "$", "string"))
    return priced.select(
        *documents.columns,
        F.when(usable, round_places("price_raw", 4)).alias("price"),
        F.when(usable, round_places("prev_raw", 4)).alias("prev_close"),
        F.when(usable, round_places("change_raw", 4)).alias("change_pct"),
        F.when(usable, currency).alias("currency"),
        F.when(~usable, F.lit("fetch_failed")).alias("error"))


def index_changes(documents: DataFrame) -> DataFrame:
    """Value, change, percent change and sign of every index document that can be read."""
    fields = quote_metadata(documents).withColumns({
        "val_raw": F.try_variant_get("meta", "$.regularMarketPrice", "double"),
        "chart_prev": F.try_variant_get("meta", "$.chartPreviousClose", "double"),
        "prev": F.try_variant_get("meta", "$.previousClose", "double"),
    })
    changed = (fields.filter(F.col("val_raw").isNotNull())
               .withColumn("base", first_truthy("chart_prev", "prev", "val_raw"))
               .withColumns({"chg_raw": F.col("val_raw") - F.col("base"),
                             "pct_raw": percent_change("val_raw", "base")}))
    return changed.select(
        *documents.columns,
        round_places("val_raw", 2).alias("val"),
        round_places("chg_raw", 2).alias("chg"),
        round_places("pct_raw", 2).alias("pct"),
        (F.col("chg_raw") >= 0).alias("pos"))


def observations(documents: DataFrame) -> DataFrame:
    """Series documents (`series_id`, `seq`, `value`) to one row per observation.

    Values stay text, as published. `place` is the observation's position in its document.
    """
    parsed = parse_once(documents, F.from_json("value", OBSERVATION_DOCUMENT), "document")
    listed = parsed.select(
        "series_id", "seq", F.posexplode("document.observations").alias("place", "observation"))
    return listed.select("series_id", "seq", "place", "observation.date", "observation.value")


def latest_of_documents(documents: DataFrame) -> DataFrame:
    """The newest observation per series, straight from the documents.

    Each document is reduced to its own newest observation inside its row, so the aggregate, which has
    to sort as its buffer holds text, sees one row per document and not one per observation.
    """
    parsed = parse_once(documents, F.from_json("value", OBSERVATION_DOCUMENT), "document")
    listed = F.transform("document.observations", lambda observation, place: F.struct(
        observation["date"].alias("date"), F.col("seq").alias("seq"), (-place).alias("place"),
        observation["value"].alias("value")))
    own = parsed.select("series_id", F.array_max(listed).alias("own")).filter("own is not null")
    return own.groupBy("series_id").agg(F.max("own").alias("newest")).select(
        "series_id", "newest.value", "newest.date")


def latest_observation(rows: DataFrame) -> DataFrame:
    """The newest observation per series; of several for one date, the one landed last."""
    newest = F.max(F.struct("date", "seq", -F.col("place"), "value"))
    return rows.groupBy("series_id").agg(newest.alias("newest")).select(
        "series_id", "newest.value", "newest.date")


def newest_observations(rows: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` observations per series, newest first by `place`."""
    ranked = top_per_key(
        rows.withColumnRenamed("place", "listed_at"), ["series_id"],
        [F.col("date").desc_nulls_last(), F.col("seq").desc(), F.col("listed_at").asc()], limit)
    return ranked.select("series_id", "date", "value", "place")
