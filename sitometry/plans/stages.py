"""The stages from files to files: each reads its inputs, makes its tables and writes them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Clean, Extract, Gold, Harvest, Recall, Sample, Stage, Trends, Windows, checked
from ..functions.numbers import truthy
from ..operators import analysis, harvest, recall, sampling, windows
from ..sources import epidoc, tables
from ..sources.scratch import stored
from ..vocab import GREEK, Profile
from . import flows, statements

Tables = dict[str, DataFrame]


def run(spark: SparkSession, stage: Stage, profile: Profile = GREEK) -> Tables:
    """Writes the stage's tables below its ``out`` and returns them as read from there."""
    made = _MAKERS[type(stage)](spark, stage, profile)
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{stage.out}/{name}")
        made[name] = spark.read.schema(df.schema).parquet(f"{stage.out}/{name}")
        if stage.csv:
            tables.write_csv(made[name], f"{stage.out}/{name}.csv")
    return made


def _input(spark: SparkSession, stage: Stage, name: str) -> DataFrame:
    path = getattr(stage, name)
    return checked(tables.read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path), stage, name)


def _blocks(spark: SparkSession, texts: str, ids: DataFrame, commentary: bool = False, max_docs: int = 0) -> DataFrame:
    """The blocks of the documents with the given ids, or of the first ``max_docs`` of them."""
    wanted = ids.select("ddb_id").distinct()
    wanted = tables.first_rows(wanted, max_docs, ["ddb_id"]) if max_docs else wanted
    return epidoc.blocks_of(epidoc.parsed(epidoc.read_xml(spark, texts), commentary)).join(wanted, "ddb_id", "left_semi")


def _harvest(spark: SparkSession, s: Harvest, profile: Profile) -> Tables:
    documents = epidoc.parsed(epidoc.read_xml(spark, s.texts), s.commentary)
    found = harvest.candidates(epidoc.blocks_of(documents), profile, s.snippets, need_number=not s.any_number, need_unit=s.need_unit)
    about = epidoc.metadata(epidoc.read_xml(spark, s.headers))
    return {"candidates": harvest.ranked(harvest.with_metadata(found, about)), "errors": epidoc.errors_of(documents)}


def _extract(spark: SparkSession, s: Extract, profile: Profile) -> Tables:
    found = _input(spark, s, "candidates")
    about = found.select("ddb_id", *[(F.col(c) if c in found.columns else F.lit("")).alias(c) for c in statements.METADATA.values()]).dropDuplicates(["ddb_id"])
    blocks = _blocks(spark, s.texts, found, s.commentary, s.max_docs)
    return statements.statements(blocks, profile, about, s.need_unit, s.window, s.least, s.several, top=s.top, primary=s.primary)._asdict()


def _windows(spark: SparkSession, s: Windows, profile: Profile) -> Tables:
    texts = windows.joined_text(_blocks(spark, s.texts, _input(spark, s, "candidates"), max_docs=s.max_docs))
    found = windows.top_windows(windows.windows(texts, profile, s.width, not s.any_window, s.written_place), s.most)
    if not s.client:
        return {"judged": windows.judged(windows.asked(found, None)).drop("prompt")}
    module, _, name = s.client.partition(":")
    client = getattr(import_module(module), name)
    return {"judged": windows.judged(windows.answered(found, client, f"{s.out}/answers")).drop("prompt")}


def _yes(df: DataFrame, column: str) -> Column:
    """Whether a yes-or-no column says yes; NULL where it says nothing or is not there."""
    return F.lower(F.trim(F.nullif(F.col(column), F.lit("")))) == "yes" if column in df.columns else F.lit(None).cast("boolean")


def _clean(spark: SparkSession, s: Clean, profile: Profile) -> Tables:
    rows = _input(spark, s, "linked")
    number = lambda c: F.col(c).try_cast("double") if c in rows.columns else F.lit(None).cast("double")
    rows = rows.withColumns({"score": number("score"), "dist_gp": number("dist_gp"), "span_toks": number("span_toks"), "signal_strength": number("signal_strength")})
    keys = [c for c in ("ddb_id", "mention_id", "grain_index") if c in rows.columns]
    flag, rank = ("is_primary" if "is_primary" in rows.columns else None), ("candidate_rank" if "candidate_rank" in rows.columns else None)
    first = analysis.primary_rows(rows, keys, "score", ["grain_form", "price_value"], flag, rank)
    ambiguous = F.coalesce(_yes(rows, "ambiguous"), F.lit(False))
    # both are read by several tables
    primary = stored(analysis.tiered(flows.cleaned_rows(first, profile, s.year_bin), "score", s.least, ambiguous), "primary")
    context = "context_type" if "context_type" in rows.columns and not s.any_context else None
    main = analysis.main_dataset(primary, "score", s.least, context, ambiguous if s.drop_ambiguous else None)
    names = ["grain", "unit", "currency"]
    main = analysis.robust_outliers(main, names, "unit_price_raw", s.outlier_z).withColumnsRenamed({"robust_z": "raw_z", "outlier": "outlier_raw"})
    main = analysis.robust_outliers(main, names, "price_per_litre", s.outlier_z).withColumnsRenamed({"robust_z": "std_z", "outlier": "outlier_std"})
    main = stored(main, "main")
    series = flows.main_series(main)
    trend = analysis.price_index(analysis.trend(series, "unit_price_raw", "year_bin", width=s.smooth), "year_bin", s.baseline_start, s.baseline_end)
    queue = main.withColumns({"ambiguous": ambiguous, "span": F.col("span_toks"), "dist": F.col("dist_gp"), "priceword": _yes(rows, "priceword_near"), "strength": F.col("signal_strength"), "price": F.col("unit_price_raw"), **({} if "neg_signals" in rows.columns else {"neg_signals": F.lit("")})})
    review = analysis.review_queue(queue, s.review, keys)
    return {"primary": primary, "main": main, "trend": trend, "trend_by_place": analysis.trend(series, "unit_price_raw", "year_bin", ["place_canon"], s.smooth), "review": review}


def _trends(spark: SparkSession, s: Trends, profile: Profile) -> Tables:
    rows = _input(spark, s, "primary")
    rows = analysis.main_dataset(rows, "score", s.least, ambiguous=F.coalesce(_yes(rows, "ambiguous"), F.lit(False)) if s.drop_ambiguous else None)
    rows = analysis.year_range(rows, "year", s.year_min, s.year_max)
    focus = analysis.only(rows, grain=s.grain)
    summed = lambda df, keys: analysis.robust_summary(df.filter(F.col("year_bin").isNotNull()), keys, "price_per_artaba", s.mad_z or float("inf"), s.winsor, s.min_n)
    return {
        "trend": summed(focus, ["year_bin"]), "trend_by_place": summed(analysis.top_groups(focus, "place_canon", s.places), ["place_canon", "year_bin"]), "extremes": analysis.extremes(focus, "price_per_artaba", s.extremes, ["ddb_id"]),
        "scatter": analysis.scatter(focus, "year", "price_per_artaba"), "grains": analysis.value_counts(rows, "grain", 20), "prices": analysis.histogram(focus, "price_per_artaba", 30, True),
    }


def _sample(spark: SparkSession, s: Sample, profile: Profile) -> Tables:
    rows = _input(spark, s, "linked").withColumn("score", F.col("score").try_cast("double"))
    rows = rows.withColumn("_key", F.concat_ws(":", *[F.col(c) for c in ("ddb_id", "mention_id", "grain_index", "candidate_rank") if c in rows.columns]))
    primary = "is_primary" if "is_primary" in rows.columns else None
    return {"sample": sampling.by_score_and_clarity(rows, s.per_bin, "_key", fill=s.fill, most=s.max_score, seed=s.seed, primary=primary).drop("_key")}


def _gold(spark: SparkSession, s: Gold, profile: Profile) -> Tables:
    w, rules = _input(spark, s, "windows"), _input(spark, s, "linked")
    w = w.withColumns({"key": F.concat_ws(":", "ddb_id", "char_offset"), "has_money": truthy(F.col("has_money"))})
    linked = rules.select(F.col("ddb_id").alias("DDB_ID"), F.col("is_primary").alias("Is_Primary"), *[(F.col(c.lower()) if c.lower() in rules.columns else F.lit("")).alias(c) for c in sampling.BY_RULES], *[F.col(c) for c in ("mention_id", "grain_index") if c in rules.columns])
    none = spark.createDataFrame([], "ddb_id string, label_form string, label string, priority int")
    labels = _input(spark, s, "labels") if s.labels else none
    order = [c for c in ("mention_id", "grain_index") if c in rules.columns] or ["Price_Value"]
    return {"sheet": sampling.gold_sheet(sampling.gold_sample(w, rules, s.n, "key", seed=s.seed), linked, labels, "key", order)}


def _recall(spark: SparkSession, s: Recall, profile: Profile) -> Tables:
    entries = _input(spark, s, "entries")
    entries = entries if "entry" in entries.columns else entries.withColumn("entry", F.monotonically_increasing_id())
    sets = {name: _input(spark, s, name).select("ddb_id").distinct() for name in ("candidates", "linked")}
    if s.judged:
        sets["judged"] = windows.priced(_input(spark, s, "judged").withColumn("is_price", truthy(F.col("is_price")))).select("ddb_id").distinct()
    report = recall.recall_report(entries, sets)
    return {"report": report, "summary": recall.recall_summary(report)}


_MAKERS: dict[type[Stage], Callable[[SparkSession, Stage, Profile], Tables]] = {Harvest: _harvest, Extract: _extract, Windows: _windows, Clean: _clean, Trends: _trends, Sample: _sample, Gold: _gold, Recall: _recall}
