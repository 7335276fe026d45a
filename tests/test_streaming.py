import datetime as dt

from tessella.streaming.late import answer_stream, strategy_counts, with_late_responses


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def run(query, name, mode="append"):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def stream(spark, path, schema, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


EVENTS = "event_id long, ts timestamp, user_id long, event_type string"


def test_late_responses_meet_their_answers(spark, tmp_path):
    answers = answer_stream(stream(spark, tmp_path / "a", EVENTS, [(1, at(0), 5, "view"), (2, at(1), 6, "buy")], [(3, at(600), 5, "view")]))
    responses = stream(spark, tmp_path / "r", "answer_id string, recorded_at timestamp, response_text string", [("ans:1", at(30), "late"), ("ans:2", at(90), "too late")], [("ans:3", at(601), "ok")])
    run(with_late_responses(answers, responses), "late")
    got = {(r.answer_id, r.response_text) for r in spark.table("late").collect()}
    assert ("ans:1", "late") in got and ("ans:3", "ok") in got and ("ans:2", "too late") not in got


def test_counts_per_window(spark, tmp_path):
    answers = answer_stream(stream(spark, tmp_path / "a", EVENTS, [(1, at(0), 5, "view"), (2, at(1), 6, "view"), (3, at(2), 6, "buy")], [(4, at(3000), 5, "view")]))
    run(strategy_counts(answers), "counts", "complete")
    got = {(r.window.start, r.render_strategy): r.answers for r in spark.table("counts").collect()}
    assert got == {(at(0), "view"): 2, (at(0), "buy"): 1, (dt.datetime(2024, 1, 3), "view"): 1}
