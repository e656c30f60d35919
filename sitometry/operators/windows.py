"""Text windows around commodity words, prompts, and scoring by a pluggable model."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.aligned import normalized_with_map, written_place
from ..functions.numbers import held
from ..functions.text import json_object, matches, normalized
from ..sources.scratch import stored
from ..vocab import Profile

ANSWER = "is_price boolean, price_value double, price_unit string, qty_value double, qty_unit string, confidence double, reason string"
SYSTEM = "You read passages of historical documents and say whether they state a price of a commodity."
QUESTION = "Document: {doc}\nCommodity word: {form}\nPassage: {text}\nAnswer with one JSON object with the keys is_price, price_value, price_unit, qty_value, qty_unit, confidence and reason."


class RateLimit(Exception):
    """Raised by a client when it must stop."""


def joined_text(blocks: DataFrame, text: str = "bar_text") -> DataFrame:
    """One text per document: its non-empty blocks in order."""
    good = blocks.filter(F.trim(text) != "")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block_no", F.col(text).alias("t")))), lambda s: s["t"])
    return good.groupBy("ddb_id").agg(F.array_join(parts, " ||| ").alias("text"))


def windows(docs: DataFrame, profile: Profile, width: int = 200, need_number: bool = True, fixed: bool = False) -> DataFrame:
    """Windows of ``docs(ddb_id, text)`` around commodity words, at most one for each 50 characters.

    A word's place is that in normalised text; the window is cut from the original at that place, which
    misses the word where normalisation changes lengths. ``fixed``: at the place where the word is written. A
    window without a number still takes its place's turn.
    """
    half = width // 2
    if fixed:
        d = docs.withColumn("_map", normalized_with_map("text")).select("*", F.col("_map.norm").alias("_norm"), F.col("_map.breaks").alias("_breaks")).filter(F.col("_norm").rlike(profile.grain))
    else:
        d = docs.withColumn("_norm", normalized("text")).filter(F.col("_norm").rlike(profile.grain))
    # a document's own list of words is thinned before it is spread: what is cut and shuffled is one narrow row a window
    found = held(d, _found=matches(F.col("_norm"), profile.grain))
    apart = lambda m, i: (i == 0) | (F.floor(m["start"] / 50) != F.floor(F.get("_found", i - 1)["start"] / 50))
    w = found.withColumn("m", F.explode(F.filter("_found", apart)))
    w = w.withColumn("char_offset", F.col("m.start")).withColumn("bucket", F.floor(F.col("char_offset") / 50))
    low = F.greatest(F.col("char_offset") - half, F.lit(0))
    size = F.col("char_offset") + F.length("m.found") + half - low
    w = w.withColumns({"_low": low, "_size": size})
    if fixed:
        first_letter, last_letter = (written_place(F.col("_breaks"), c) for c in (F.col("char_offset"), F.col("char_offset") + F.length("m.found") - 1))
        w = w.withColumn("_low", F.greatest(first_letter - half, F.lit(0))).withColumn("_size", last_letter + 1 + half - F.col("_low"))
    w = w.withColumns({"window_text": F.trim(F.substring("text", F.col("_low") + 1, F.col("_size"))), "_w": F.substring("_norm", low + 1, size)})
    w = w.select("ddb_id", "bucket", F.col("m.found").alias("grain_form"), "char_offset", "window_text", F.col("_w").rlike(profile.money).alias("has_money"), F.col("_w").rlike(profile.unit).alias("has_unit"), F.col("window_text").rlike("[0-9]").alias("has_number"), F.col("_w").rlike(profile.priceword).alias("has_priceword"))
    # rows that repeat an id share their places
    first = Window.partitionBy("ddb_id", "bucket").orderBy("char_offset")
    w = w.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "bucket")
    return w.filter("has_number") if need_number else w


def top_windows(w: DataFrame, k: int = 20) -> DataFrame:
    """At most k windows of a document, those with more cues first; without too many, text order.

    ``grain_index`` counts from 0 in that order.
    """
    per = Window.partitionBy("ddb_id")
    many = w.withColumn("_many", F.count(F.lit(1)).over(per) > k)
    cue = lambda c: F.when(F.col("_many"), F.col(c).cast("int")).otherwise(0)
    order = per.orderBy(F.desc("_m"), F.desc("_p"), F.desc("_u"), "char_offset")
    out = many.withColumns({"_m": cue("has_money"), "_p": cue("has_priceword"), "_u": cue("has_unit")}).withColumn("grain_index", F.row_number().over(order) - 1)
    return out.filter(F.col("grain_index") < k).drop("_many", "_m", "_p", "_u")


def prompted(w: DataFrame, question: str = QUESTION) -> DataFrame:
    text = F.lit(question)
    for name, column in (("doc", "ddb_id"), ("form", "grain_form"), ("text", "window_text")):
        text = F.replace(text, F.lit("{" + name + "}"), F.col(column))
    return w.withColumn("prompt", text)


def asked(w: DataFrame, client: Callable[[str, str], str] | None, retries: int = 5, pause: float = 1.0) -> DataFrame:
    """Each window with the model's raw ``answer`` and ``error``; without a client both are NULL.

    Runs in the executors, batch by batch. Failures are retried with growing pauses and end as an
    error in their row; after a rate limit the rest of the task's rows carry that error.
    """
    out = prompted(w)
    if client is None:
        return out.withColumns({"answer": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for b in batches:
            answers, errors = [], []
            for prompt in b["prompt"]:
                answer, error = None, stopped
                for k in range(0 if stopped else retries):
                    try:
                        answer, error = client(SYSTEM, prompt), None
                        break
                    except RateLimit as e:
                        stopped = error = f"rate limit: {e}"
                        break
                    except Exception as e:
                        error = str(e)
                        if pause and k + 1 < retries:
                            time.sleep(pause * (2**k + random.random()))
                answers.append(answer)
                errors.append(error)
            b["answer"], b["error"] = answers, errors
            yield b

    schema = ", ".join(f"`{n}` {t}" for n, t in out.dtypes) + ", answer string, error string"
    return out.mapInPandas(run, schema)


def answered(w: DataFrame, client: Callable[[str, str], str], path: str, retries: int = 5, pause: float = 1.0, wave: int = 1000) -> DataFrame:
    """Each window with its ``answer``, ``error`` and ``asked``, by way of a table of answers at ``path``.

    A window is told by the digest of its prompt. Windows with a stored answer or error are not asked again,
    and equal ones are asked once. The others go out in waves of about ``wave`` windows; each wave's answers are
    appended before the next one starts, so a run that fails loses at most the wave it is in, and a plan that is
    evaluated twice reads the table. A rate limit ends the calls of its task at once and all calls after the wave: what
    was not asked has ``asked`` false, and another run takes it up.
    """
    spark = w.sparkSession
    rows = prompted(w).withColumn("digest", F.sha2("prompt", 256))
    shape = "digest string, answer string, error string"
    _ready(spark, path, shape)
    known = spark.read.schema(shape).parquet(path)
    todo = rows.select("digest", "prompt").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    waves = max(1, -(-todo.count() // wave))
    todo = stored(todo.withColumn("wave", F.pmod(F.xxhash64("digest"), F.lit(waves)).cast("int")), "prompts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for b in batches:
            said = []
            for prompt in b["prompt"]:
                answer, error, stopped = (None, None, True) if stopped else _called(client, prompt, retries, pause)
                said.append((answer, error, stopped))
            b["answer"], b["error"], b["left"] = zip(*said) if said else ([], [], [])
            yield b[["digest", "answer", "error", "left"]]

    for k in range(waves):
        left = Observation()
        out = todo.filter(F.col("wave") == k).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, f"{shape}, left boolean")
        out.observe(left, F.count_if(F.col("left")).alias("left")).filter("not left").drop("left").write.mode("append").parquet(path)
        if left.get["left"]:
            break
    now = spark.read.schema(shape).parquet(path).withColumn("asked", F.lit(True))
    return rows.join(now, "digest", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))


def _ready(spark: SparkSession, path: str, shape: str) -> None:
    """An empty table where there is none."""
    spark.createDataFrame([], shape).write.mode("append").parquet(path)


def _called(client: Callable[[str, str], str], prompt: str, retries: int, pause: float) -> tuple[str | None, str | None, bool]:
    """Answer, error and whether the client must stop; failures are tried again with growing pauses."""
    error = None
    for k in range(retries):
        try:
            return client(SYSTEM, prompt), None, False
        except RateLimit:
            return None, None, True
        except Exception as e:
            error = str(e)
            if pause and k + 1 < retries:
                time.sleep(pause * (2**k + random.random()))
    return None, error, False


def judged(answers: DataFrame) -> DataFrame:
    """Answers parsed by ``ANSWER``'s keys; one that is no JSON object is an error and no price."""
    parsed = answers.withColumn("_j", F.from_json(json_object(F.col("answer")), ANSWER))
    bad = F.col("answer").isNotNull() & F.col("_j.is_price").isNull()
    error = F.coalesce("error", F.when(bad, F.lit("not a JSON object")))
    out = parsed.withColumn("error", error).select(*answers.drop("error").columns, "error", "_j.*")
    return out.withColumn("is_price", F.when(F.col("error").isNotNull(), F.lit(False)).otherwise(F.col("is_price")))


def priced(judgements: DataFrame) -> DataFrame:
    return judgements.filter("is_price")


def echo_client(system: str, prompt: str) -> str:
    """A stand-in that calls any passage with a number a price."""
    return json.dumps({"is_price": any(c.isdigit() for c in prompt), "confidence": 0.5})
