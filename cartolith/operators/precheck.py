"""Pre-ingestion aggregates over a table of files; ``by`` columns give one result for each repository."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config, scalars
from ..storage import written


def file_metrics(
    files: DataFrame, ignore: Sequence[str] = config.IGNORE_FOLDERS, languages: Mapping[str, str] = config.LANGUAGES, tokens: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """A1: path, tokens, language label and supported of every file that is not excluded."""
    found = scalars.language(F.col("path"), languages)
    counted = scalars.count_tokens(F.col("content")) if tokens is None else tokens
    return files.where(~scalars.is_excluded(F.col("path"), ignore)).select(
        *by, "path", counted.cast("long").alias("tokens"), scalars.language_label(found).alias("language"), found.isNotNull().alias("supported")
    )


def scan_stats(files: DataFrame, ignore: Sequence[str] = config.IGNORE_FOLDERS, by: Sequence[str] = ()) -> DataFrame:
    """A2: files seen, tokenized, unreadable (null content) and excluded."""
    excluded = scalars.is_excluded(F.col("path"), ignore)
    return files.groupBy(*by).agg(
        F.count("*").alias("total_files_seen"),
        F.count_if(~excluded & F.col("content").isNotNull()).alias("total_files_tokenized"),
        F.count_if(~excluded & F.col("content").isNull()).alias("tokenization_errors"),
        F.count_if(excluded).alias("excluded_file_count"),
    )


def excluded_paths_top(files: DataFrame, ignore: Sequence[str] = config.IGNORE_FOLDERS, n: int = 10) -> DataFrame:
    """A3: the top folders that hold most excluded files."""
    first = scalars.parts(F.col("path"))[0]
    return files.where(scalars.is_excluded(F.col("path"), ignore)).groupBy(first.alias("folder")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(n)


def by_language(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A4: tokens and files of each label."""
    return metrics.groupBy(*by, "language").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("files"), F.bool_or("supported").alias("supported"))


def totals(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals, supported share, largest and truncated mean tokens."""
    tokens = F.col("tokens")
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return metrics.groupBy(*by).agg(
        some(F.sum(tokens)).alias("total_tokens"),
        some(F.sum(F.when(F.col("supported"), tokens))).alias("supported_tokens"),
        some(F.sum(F.when(~F.col("supported"), tokens))).alias("unsupported_tokens"),
        F.count_if("supported").alias("supported_file_count"),
        F.count_if(~F.col("supported")).alias("unsupported_file_count"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("supported"), tokens).otherwise(0)).cast("double"), F.sum(tokens).cast("double")), F.lit(0.0)).alias("supported_ratio"),
        some(F.max(tokens)).alias("max_file_tokens"),
        some(F.floor(F.try_divide(F.sum(tokens), F.count("*")))).alias("avg_tokens_per_file"),
    )


def largest_files(metrics: DataFrame, n: int = 10) -> DataFrame:
    """A7"""
    return metrics.orderBy(F.desc("tokens"), "path").limit(n)


def primary_language(languages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The supported label with most tokens, else any; ties to the first in order."""
    best = Window.partitionBy(*by, "supported").orderBy(F.desc("tokens"), "language")
    first = languages.withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return first.groupBy(*by).agg(F.max_by("language", F.col("supported").cast("int")).alias("primary_language"))


def language_distribution(languages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A10: each supported label's per cent of the supported tokens, two decimals, halves to even."""
    total = F.sum("tokens").over(Window.partitionBy(*by))
    shares = languages.where("supported").withColumn("_total", total).where("_total > 0")
    return shares.select(*by, "language", F.bround(F.col("tokens") / F.col("_total") * 100, 2).alias("pct"))


def single_language_dominant(distribution: DataFrame, by: Sequence[str] = (), least: float = config.DOMINANT_PCT) -> DataFrame:
    """A11"""
    return distribution.groupBy(*by).agg(F.coalesce(F.max("pct") >= least, F.lit(False)).alias("single_language_dominant"))


def precheck_summary(files: DataFrame, ignore: Sequence[str] = config.IGNORE_FOLDERS, languages: Mapping[str, str] = config.LANGUAGES, least: float = config.MIN_SUPPORTED_RATIO) -> DataFrame:
    """One nested row of all the above. Tokens are counted in one pass, whose rows are written; all else is derived from them."""
    metrics = written(file_metrics(files, ignore, languages), "metrics")
    langs = by_language(metrics)
    listed = lambda df, order, *columns: df.agg(F.sort_array(F.collect_list(F.struct(*order, *columns))).alias("x"))
    largest = listed(largest_files(metrics).withColumn("_o", -F.col("tokens")), ["_o", "path"], "tokens", "language", "supported").select(
        F.transform("x", lambda s: F.struct(s["path"].alias("path"), s["tokens"].alias("tokens"), s["language"].alias("language"), s["supported"].alias("supported"))).alias("largest_files")
    )
    excluded = listed(excluded_paths_top(files, ignore).withColumn("_o", -F.col("files")), ["_o", "folder"], "files").select(
        F.transform("x", lambda s: F.struct(s["folder"].alias("path"), s["files"].alias("count"))).alias("excluded_paths_top")
    )
    distribution = language_distribution(langs)
    maps = langs.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "tokens")))).alias("tokens_by_lang"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "files")))).alias("files_by_lang")
    )
    pct = distribution.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "pct")))).alias("language_distribution_pct"))
    one = scan_stats(files, ignore)
    for part in (totals(metrics), primary_language(langs), pct, single_language_dominant(distribution), maps, largest, excluded):
        one = one.crossJoin(part)  # each side is one row
    return one.withColumns(
        {
            "min_supported_ratio": F.lit(least),
            "supported_languages": F.array(*(F.lit(x) for x in sorted(set(languages.values())))),
            "passes_precheck": (F.col("total_tokens") > 0) & (F.col("supported_ratio") >= least),
        }
    )


def precheck_verdict(totals_: DataFrame, least: float = config.MIN_SUPPORTED_RATIO, excluded: Column | None = None) -> DataFrame:
    """Code, message and recommendations of each row of ``totals``; ``excluded``: whether files were left out."""
    none, mixed = F.col("total_tokens") <= 0, F.col("supported_ratio") < least
    pct = F.bround(F.col("supported_ratio") * 100, 2)
    left_out = F.lit(False) if excluded is None else excluded
    advice = F.when(none, F.array(F.lit("Every file was empty, unreadable or left out: look at the paths that were given and at what is ignored."))).when(
        mixed,
        F.array_compact(
            F.array(
                F.when(left_out, F.lit("Files were left out; see whether they should have been.")),
                F.lit("Add languages to the map, or ignore folders that are no source."),
                F.when(F.col("max_file_tokens") > 0, F.lit("See whether a few large files make up most of the rest.")),
            )
        ),
    )
    return totals_.select(
        "*",
        F.when(none, "NO_TOKENS_COUNTED").when(mixed, "UNSUPPORTED_LANGUAGE_MIX").alias("code"),
        (~(none | mixed)).alias("passes_precheck"),
        F.when(none, F.lit("nothing to analyse")).when(mixed, F.concat(F.lit("only "), pct.cast("string"), F.lit(" % of all tokens are in a language of the map"))).alias("message"),
        F.coalesce(advice, F.array().cast("array<string>")).alias("recommendations"),
    )


def compression_ratio(raw_tokens: DataFrame, context_tokens: DataFrame) -> DataFrame:
    """Raw tokens for each context token; null without context."""
    return raw_tokens.crossJoin(context_tokens).select("total_tokens", "context_tokens", F.try_divide(F.col("total_tokens").cast("double"), F.col("context_tokens").cast("double")).alias("ratio"))  # one row each
