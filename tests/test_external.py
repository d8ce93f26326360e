from lexisift.operators import external


def test_respond_isolates_failures(spark):
    def call(p: str) -> str:
        if p == "bad":
            raise ValueError("session limit reached")
        return p.upper()

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "id long, p string")
    got = external.respond(df, "id", "p", call, attempts=2, delay=0.0)
    rows = {r.id: r for r in got.withColumn("quota", external.is_quota_error(got.error)).collect()}
    assert (rows[1].raw, rows[1].status) == ("A", "ok") and (rows[2].status, rows[2].quota) == ("failed", True) and rows[3].status == "skipped"


def test_gate_and_totals(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    r = external.gate(plan, plan.filter("id = 'a'"), ["id"]).first()
    assert (r.planned, r.done, r.missing, r.complete) == (2, 1, 1, False)
    registry = spark.createDataFrame([("x", 3, "s", "open"), ("y", 2, "s", "open"), ("z", 1, "s", "closed")], "name string, n int, subdir string, license_class string")
    assert {(r.license_class, r.documents) for r in external.planned_documents(registry).collect()} == {("open", 5), ("closed", 1), (None, 6)}


def test_fill_and_table_function(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(external.fill("Hi {n}!", {"n": F.lit("x")})).first()[0] == "Hi x!"
    external.register_sql(spark)
    assert [r[0] for r in spark.sql("SELECT * FROM ngrams('The quick, brown 42 fox', 2)").collect()] == ["the quick", "quick brown", "brown fox"]
    assert spark.sql("SELECT ngram_array('The quick, brown 42 fox', 2)").first()[0] == ["the quick", "quick brown", "brown fox"]
    assert [spark.sql(f"SELECT ngram_array({t}, 3)").first()[0] for t in ("'a one'", "''", "NULL")] == [[], [], []]


def test_calls_that_hang(spark):
    import time

    def call(p: str) -> str:
        time.sleep(30 if p == "slow" else 0)
        return p

    got = {r.id: r.status for r in external.respond(spark.createDataFrame([(1, "a"), (2, "slow")], "id long, p string"), "id", "p", call, attempts=1, timeout=0.5).collect()}
    assert got == {1: "ok", 2: "failed"}


def test_checked_scores(spark):
    df = spark.createDataFrame([(1, 5), (0, 5), (None, 5), (10, 11)], "a int, b int")
    assert [r.valid for r in external.checked_scores(df, ["a", "b"]).collect()] == [True, False, False, False]
