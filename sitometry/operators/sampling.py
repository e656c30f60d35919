"""Stratified samples, gold sheets, label joins and quality of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ambiguous_group, bin_labels, score_bin
from ..sources.scratch import stored
from .quantile import matched, sized


#: Of a stratum so many times the quota and so many rows more are taken up, by their hash, before any sort.
SPARE, MORE = 2, 50


def drawn(df: DataFrame, strata: list[str], quota: Column | int, key: str, seed: int = 42) -> DataFrame:
    """The first ``quota`` rows of each stratum by a seeded hash of the key: the same on every run.

    The quota is one for each stratum; a stratum with fewer rows is taken whole. Counts give each stratum a bound for the
    hash under which somewhat more rows than its quota lie, and only these are sorted; a stratum that comes out
    short gets a wider bound. So no task holds a stratum, whatever its size.
    """
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    unit = F.conv(F.left(place, F.lit(8)), 16, 10).cast("long") / F.lit(float(1 << 32))
    rows = df.withColumns({"_place": place, "_unit": unit})
    counts = sized(rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"), F.max(quota if isinstance(quota, Column) else F.lit(quota)).alias("_quota")), "strata")
    wider = 1
    while True:
        share = (F.col("_quota") * SPARE + MORE) * wider / F.col("_size")
        near = stored(matched(rows, counts, strata, strata).filter(F.col("_unit") < share), "drawn")
        got = near.groupBy(*strata).agg(F.count(F.lit(1)).alias("_got"))
        short = matched(counts, got, strata, strata, "left").filter(F.coalesce("_got", F.lit(0)) < F.least("_quota", "_size"))
        if short.isEmpty():
            break
        wider *= 4
    order = Window.partitionBy(*strata).orderBy("_place", key)
    first = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= F.col("_quota"))
    return first.drop("_n", "_place", "_unit", "_size", "_quota")


def by_score_and_clarity(df: DataFrame, per_bin: int, key: str, score: str = "score", ambiguous: str = "ambiguous", fill: bool = False, most: int = 80, seed: int = 42, primary: str | None = None) -> DataFrame:
    """Half of each score bin from clear rows and half from ambiguous ones; ``fill`` tops up.

    ``primary``: a column that must say "yes", where there is one.
    """
    if primary:
        df = df.filter(F.lower(F.trim(primary)) == "yes")
    rows = df.withColumns({"bin": score_bin(F.col(score), most), "group": ambiguous_group(F.col(ambiguous))}).filter(F.col("bin").isin(bin_labels(most)))
    quota = F.when(F.col("group") == "ambiguous_yes", per_bin // 2).otherwise(per_bin - per_bin // 2)
    picked = drawn(rows, ["bin", "group"], quota, key, seed)
    if not fill:
        return picked
    got = picked.groupBy("bin").agg(F.count(F.lit(1)).alias("_got"))
    rest = rows.join(picked.select(key), key, "left_anti").join(F.broadcast(got), "bin", "left")
    return picked.unionByName(drawn(rest, ["bin"], per_bin - F.coalesce("_got", F.lit(0)), key, seed).drop("_got"))


def quotas(n: int) -> dict[tuple[str, bool], int]:
    """60 % of a gold sample from stratum A and the rest from B; of each, 70 % with money words."""
    a = int(n * 0.6)
    return {(s, money): (int(k * 0.7) if money else k - int(k * 0.7)) for s, k in (("A", a), ("B", n - a)) for money in (True, False)}


def gold_sample(windows: DataFrame, found_docs: DataFrame, n: int, key: str, doc: str = "ddb_id", money: str = "has_money", seed: int = 42) -> DataFrame:
    """Windows of documents that the rules found (``stratum`` A) and of others (B), by the quotas or as many
    as there are."""
    found = found_docs.select(F.col(doc).alias("_doc")).distinct()
    rows = windows.join(found, F.col(doc) == F.col("_doc"), "left").withColumns({"stratum": F.when(F.col("_doc").isNotNull(), "A").otherwise("B"), "_money": F.coalesce(F.col(money), F.lit(False))}).drop("_doc")
    quota = F.lit(0)
    for (stratum, with_money), k in quotas(n).items():
        quota = F.when((F.col("stratum") == stratum) & (F.col("_money") == with_money), k).otherwise(quota)
    return drawn(rows, ["stratum", "_money"], quota, key, seed).drop("_money")


# The sheet's columns in their order; what is read from the sample, from the rules' row, and left blank
SAMPLED = {"DDB_ID": "ddb_id", "Title": "title", "Place": "place", "Date_NotBefore": "date_notbefore", "Date_NotAfter": "date_notafter", "Grain_Form": "grain_form", "Context_Window": "window_text", "Has_Money_Cue": "has_money", "Has_Unit_Cue": "has_unit", "Has_Number": "has_number"}
BY_HAND = ("Human_Commodity", "Human_Qty", "Human_Unit", "Human_Price", "Human_Currency", "Human_Notes")
BY_RULES = ("Grain_Form", "Qty_Value", "Qty_Unit", "Price_Value", "Price_Cur", "Score", "Priceword_Near", "Context_Type", "Signal_Type", "Signal_Strength", "Neg_Signals")
BY_MODEL = ("LLM_Is_Price", "LLM_Confidence", "LLM_Commodity", "LLM_Qty", "LLM_Unit", "LLM_Price", "LLM_Currency", "LLM_Reasoning")


def gold_sheet(sample: DataFrame, linked: DataFrame, labels: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The annotator's sheet of a ``gold_sample``: 38 columns.

    ``Human_Label`` is filled from ``labels(ddb_id, label_form, label, priority)`` where one fits, the ``RB_`` columns from
    the first primary row, by ``order``, of the document among ``linked`` (as ``statements`` makes it); the rest is blank. Rows are
    numbered by stratum and ``key``: the sample is as small as its quotas.
    """
    has = {c.lower(): c for c in sample.columns}
    docs = sample.select(F.col("ddb_id").alias("DDB_ID")).distinct()
    primary = linked.filter(F.lower("Is_Primary") == "yes").join(docs, "DDB_ID", "left_semi")
    first = with_first_row(sample.select("ddb_id", key), primary.select(F.col("DDB_ID").alias("ddb_id"), *[F.col(c).alias(f"RB_{c}") for c in BY_RULES], *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)]), "ddb_id", [f"_o{k}" for k in range(len(order))])
    rows = with_labels(sample, labels, "ddb_id", "grain_form").join(first.select(key, *[f"RB_{c}" for c in BY_RULES]), key, "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    number = F.row_number().over(Window.orderBy("stratum", key))
    return rows.select(
        number.alias("Sample_ID"), F.col("stratum").alias("Sample_Stratum"), *[(F.col(c) if c in has else F.lit("")).alias(name) for name, c in SAMPLED.items()],
        text("label").alias("Human_Label"), *[F.lit("").alias(c) for c in BY_HAND], *[text(f"RB_{c}").alias(f"RB_{c}") for c in BY_RULES], *[F.lit("").alias(c) for c in BY_MODEL],
    )


def with_first_row(sample: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each sampled row with the first of the rows of its key."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
    return sample.join(first, key, "left")


def with_labels(df: DataFrame, labels: DataFrame, key: str, form: str, width: int = 4) -> DataFrame:
    """The first label, by priority, of the same id whose first ``width`` letters begin the form.

    ``labels(key, label_form, label, priority)`` is a hand-made list, gathered to one row a key; a
    shorter label form must begin the form whole.
    """
    known = labels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("priority", F.left("label_form", F.lit(width)).alias("begins"), "label"))).alias("_known"))
    first = F.get(F.filter("_known", lambda k: F.col(form).startswith(k["begins"])), F.lit(0))
    return df.join(known, key, "left").withColumn("label", first["label"]).drop("_known")


def confusion(df: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """Counts and precision and recall of a flag against human labels; NULL labels are left out."""
    rows = df.filter(truth.isNotNull())
    counts = rows.agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"), F.count_if(~predicted & ~truth).alias("tn"))
    ratio = lambda a, b: F.col(a).cast("double") / F.nullif((F.col(a) + F.col(b)).cast("double"), F.lit(0.0))
    return counts.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")
