"""Scalar functions over fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemap.functions import clock, geo, labels

TIMES = ("00:00:00", "08:15:30", "25:10:00", "7:05:09", "08:15", "", None, "aa:bb:cc", "100:00:01")
FORM_TIMES = ("08:15", "23:59", "7", "", None, ":30", "12:")
NAMES = ("Genève, Cornavin", 'A & "B" <C>', "", "&amp;", "it's")


def gtfs_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TIMES)], "k int, t string")
    return rows.select("k", clock.parse_service_time(F.col("t")).alias("seconds"))


def departure_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(FORM_TIMES)], "k int, t string")
    return rows.select("k", clock.parse_departure(F.col("t")).alias("seconds"))


def clock_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(0, 180_000, 997).select(F.col("id").alias("seconds"))
    return rows.select("seconds", clock.format_clock(F.col("seconds")).alias("text"), clock.whole_minutes(F.col("seconds")).alias("minutes"))


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(-40, 41).select(F.col("id").alias("k"), (F.col("id") / 4.0).alias("x"))
    return rows.select("k", geo.round_half_up(F.col("x")).alias("rounded"), geo.cell(F.col("k"), 7).alias("cell"))


def walk_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 301, 3).select(F.col("id").alias("metres"), geo.walk_seconds(F.col("id").cast("double")).alias("seconds"))


def hues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-600, 7201, 300).select(F.col("id").alias("elapsed"), F.round(geo.elapsed_hue(F.col("id").cast("double"), F.lit(5400.0)), 6).alias("hue"))


def escaped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(NAMES)], "k int, t string")
    return rows.select("k", labels.escape_html(F.col("t")).alias("html"), labels.fill(F.lit("{a} {name}"), name=F.col("t")).alias("filled"))


def mode_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(-1, 12).select(F.col("id").cast("int").alias("mode"))
    return rows.select("mode", *(labels.mode_label(F.col("mode"), lang).alias(f"label_{lang}") for lang in labels.TEXTS), labels.mode_colour(F.col("mode")).alias("colour"), *(labels.change_text(F.col("mode"), lang).alias(f"changes_{lang}") for lang in labels.TEXTS))


QUERIES = {f.__name__: f for f in (gtfs_time_parse, departure_parse, clock_format, rounding, walk_times, hues, escaped_names, mode_texts)}


def _values(rows: tuple) -> str:
    quoted = ["NULL" if r is None else "'" + r.replace("'", "''") + "'" for r in rows]
    return "(VALUES " + ", ".join(f"({k}, {q})" for k, q in enumerate(quoted)) + ") v(k, t)"


def _mode_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    columns = []
    for lang, texts in labels.TEXTS.items():
        columns.append("CASE i " + " ".join(f"WHEN {m} THEN {quote(texts[key])}" for m, (key, _) in labels.MODES.items()) + f" ELSE {quote(texts['mode.transit'])} END AS label_{lang}")
        columns.append(f"CASE WHEN i <= 0 THEN '' WHEN i = 1 THEN replace({quote(texts['journey.change.one'])}, '{{count}}', CAST(i AS VARCHAR)) ELSE replace({quote(texts['journey.change.other'])}, '{{count}}', CAST(i AS VARCHAR)) END AS changes_{lang}")
    colour = "CASE i " + " ".join(f"WHEN {m} THEN '{c}'" for m, (_, c) in labels.MODES.items()) + f" ELSE '{labels.OTHER_MODE[1]}' END AS colour"
    return f"SELECT CAST(i AS INT) AS mode, {', '.join(columns)}, {colour} FROM range(-1, 12) r(i)"


ORACLES = {
    "gtfs_time_parse": f"SELECT k, CASE WHEN regexp_matches(t, '^\\s*\\d+:\\d+:\\d+\\s*$') THEN CAST(split_part(t, ':', 1) AS INT) * 3600 + CAST(split_part(t, ':', 2) AS INT) * 60 + CAST(split_part(t, ':', 3) AS INT) END AS seconds FROM {_values(TIMES)}",
    "departure_parse": f"SELECT k, CASE WHEN t IS NULL THEN 28800 ELSE CASE WHEN split_part(t, ':', 1) = '' THEN 0 ELSE CAST(split_part(t, ':', 1) AS INT) END * 3600 + CASE WHEN NOT contains(t, ':') OR split_part(t, ':', 2) = '' THEN 0 ELSE CAST(split_part(t, ':', 2) AS INT) END * 60 END AS seconds FROM {_values(FORM_TIMES)}",
    "clock_format": "SELECT i AS seconds, lpad(CAST(i // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(i % 3600 // 60 AS VARCHAR), 2, '0') AS text, greatest(1, CAST(ceil(i / 60.0) AS BIGINT)) AS minutes FROM range(0, 180000, 997) r(i)",
    "rounding": "SELECT i AS k, CAST(floor(i / 4.0::DOUBLE + 0.5) AS BIGINT) AS rounded, CAST(floor(i / 7.0::DOUBLE) AS INT) AS cell FROM range(-40, 41) r(i)",
    "walk_times": "SELECT i AS metres, CAST(floor(i / 1.2::DOUBLE + 0.5) + 60 AS INT) AS seconds FROM range(0, 301, 3) r(i)",
    "hues": "SELECT i AS elapsed, round(130 * (1 - least(greatest(i / 5400::DOUBLE, 0), 1)), 6) AS hue FROM range(-600, 7201, 300) r(i)",
    "escaped_names": f"SELECT k, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html, '{{a}} ' || t AS filled FROM {_values(NAMES)}",
    "mode_texts": _mode_sql(),
}
