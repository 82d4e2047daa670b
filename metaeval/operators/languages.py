"""Language display names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from metaeval.operators.lookup import attach


_NAMES: list = []


def iso_languages(spark: SparkSession) -> DataFrame:
    """``lang`` and English ``lang_name`` of ISO codes and of tags with region or script.

    The Java runtime knows them: codes of two and three letters, and the tags of
    its locales. They are some two thousand rows, asked for once.
    """
    if not _NAMES:
        locale = spark._jvm.java.util.Locale
        found = {tag.toLanguageTag(): tag.getDisplayName(locale.ENGLISH) for tag in locale.getAvailableLocales()}
        for code in locale.getISOLanguages():
            one = locale(code)
            found[code] = one.getDisplayLanguage(locale.ENGLISH)
            found.setdefault(one.getISO3Language(), found[code])
        found.pop("und", None)
        _NAMES.extend(sorted(found.items()))
    return spark.createDataFrame(_NAMES, "lang string, lang_name string")


def with_language_name(rows: DataFrame, languages: DataFrame | None = None, lang: str = "lang",
                       spread=None, name: str = "lang_name") -> DataFrame:
    """Add the display name of the language code; an unknown code names itself.

    Without ``languages`` the fixed ISO table is broadcast, which also works on
    streams. A table of one's own is measured before it is broadcast.
    """
    if languages is None:
        table = iso_languages(rows.sparkSession).select(
            F.col("lang").alias(lang), F.col("lang_name").alias("_name"))
        named = rows.join(F.broadcast(table), lang, "left")
    else:
        table = languages.select(F.col("lang").alias(lang), F.col("lang_name").alias("_name"))
        named = attach(rows, table, on=[lang], spread=spread or rows.columns)
    return named.withColumn(name, F.coalesce("_name", lang)).drop("_name")
