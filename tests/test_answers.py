import pytest
from pyspark.sql import functions as F

from sitometry.operators import funnel, harvest, windows
from sitometry.vocab import GREEK


def prompts(spark, n):
    return spark.range(n).select(F.lit("d").alias("ddb_id"), F.lit("πυρου").alias("grain_form"), F.format_string("πυρου %d", F.col("id") % (n - 1)).alias("window_text"))


def logged(log, most):
    """A client that answers and writes down each passage it was asked about; it stops once so many were."""

    def client(system, prompt, log=str(log)):
        with open(log, "a+", encoding="utf-8") as f:
            f.seek(0)
            if len(f.readlines()) >= most:
                raise windows.RateLimit("later")
            f.write(prompt.split("Passage: ")[1].split("\n")[0] + "\n")
        return '{"is_price": true}'

    return client


def asked(log):
    return log.read_text(encoding="utf-8").splitlines() if log.exists() else []


@pytest.mark.parametrize("wave", [7, 1000])
def test_each_window_is_asked_once_over_a_stopped_and_a_resumed_run(spark, tmp_path, wave):
    log, path, w = tmp_path / "log", str(tmp_path / "answers"), prompts(spark, 41)
    first = windows.answered(w, logged(log, 15), path, pause=0, wave=wave)
    done = first.filter("asked").count()
    # tasks run at once, so a few calls may pass the mark together; nothing answered is lost
    assert 15 <= len(asked(log)) < 25 and len(set(asked(log))) == len(asked(log)) and done in (len(asked(log)), len(asked(log)) + 1)
    assert first.filter("not asked and (answer is not null or error is not null)").count() == 0
    again = windows.answered(w, logged(log, 10**6), path, pause=0, wave=wave)
    assert again.filter("asked").count() == 41 and again.count() == again.count() == 41
    assert sorted(asked(log)) == sorted(f"πυρου {k}" for k in range(40))
    assert windows.judged(again).filter("is_price").count() == 41
    windows.answered(w, logged(log, 0), path, pause=0, wave=wave).collect()
    assert len(asked(log)) == 40


def test_failures_are_stored_and_nothing_to_ask(spark, tmp_path):
    def broken(system, prompt):
        raise ValueError("no model")

    path = str(tmp_path / "answers")
    rows = windows.answered(prompts(spark, 3), broken, path, retries=2, pause=0).collect()
    assert [(r["asked"], r["answer"], r["error"]) for r in rows] == [(True, None, "no model")] * 3
    assert windows.answered(prompts(spark, 3).limit(0), broken, path).count() == 0


def test_funnel_counts_in_one_pass(spark):
    rows = [("a", "πυρου δραχμαι 3\nλογοσ\nπυρου δραχμαι 4"), ("b", "πυρου"), ("c", None), ("d", "πυρου 1 δραχμαι")]
    f = funnel.Funnel()
    docs = f.watched(spark.createDataFrame(rows, "id string, text string"), "documents", empty=F.col("text").isNull())
    gated = f.watched(harvest.gated_blocks(f.watched(harvest.text_blocks(docs, "id", "text"), "blocks"), GREEK), "gated")
    out = f.watched(harvest.gathered(gated, GREEK), "candidates", good=F.col("score") >= 9)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    out.collect()
    assert f.counts() == {"documents": {"rows": 4, "empty": 1}, "blocks": {"rows": 5}, "gated": {"rows": 3}, "candidates": {"rows": 2, "good": 0}}
    assert [(r["stage"], r["measure"], r["share"]) for r in f.table(spark).collect()][-2:] == [("candidates", "rows", 0.5), ("candidates", "good", 0.0)]


def test_funnel_of_nothing(spark):
    f = funnel.Funnel()
    f.watched(spark.createDataFrame([], "id string"), "documents").collect()
    assert [(r["n"], r["share"]) for r in f.table(spark).collect()] == [(0, None)]
