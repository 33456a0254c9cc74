"""Raw records to enriched ones: one projection, no shuffle."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import app_of_file_name, app_of_text, classify, is_browser, label_of_package
from ..operators.entities import with_entities
from ..operators.layout import headline, page_link
from ..sources.store import INDEXED


def enrich(raw: DataFrame, today: date, zone: str = "UTC", version: int = 1) -> DataFrame:
    """raw: id, name (of the file), ocr_text and lines (array<struct<text, top, bottom>>). The app is the file name's, else the interface's."""
    hint = app_of_file_name(F.col("name"))
    df = raw.withColumn("_hint", hint)
    df = df.withColumns(
        {
            "app_package": F.col("_hint.package"),
            "app": F.coalesce("_hint.label", label_of_package(F.col("_hint.package")), app_of_text(F.col("ocr_text")))
        }
    )
    source = F.when(F.col("_hint").isNotNull(), "name").when(F.col("app").isNotNull(), "text")
    df = df.withColumns(
        {
            "app_source": source, "page_url": page_link(F.col("lines"), is_browser(F.col("app"), F.col("app_package"))),
            "headline": headline(F.col("lines")), "categories": classify(F.col("ocr_text"), F.col("app"))
        }
    )
    return with_entities(df, "ocr_text", today, zone).withColumns({"state": F.lit(INDEXED), "index_version": F.lit(version)}).drop("_hint")
