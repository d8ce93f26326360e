import random
import unicodedata
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexisift.llm import terms

SCHEMA = "run_id string, ngram string, ai_count long, human_count long, mark string"


def brute(rows):
    total, reports = defaultdict(int), defaultdict(set)
    for run, gram, a, h, _ in set(rows):
        if gram is not None:
            t = unicodedata.normalize("NFC", gram.strip().lower())
            total[t] += (a or 0) + (h or 0)
            reports[t] |= {run} - {None}
    return {t: (total[t], len(reports[t])) for t in total}


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["r1", "r2", "r3", None]), st.sampled_from(["a", "A ", "ä", "ä", "", None, "b c"]), st.sampled_from([None, 0, 1, 7]), st.sampled_from([None, 2]), st.just("x")), max_size=40))
def test_counts_match_sets(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.term: (r.occurrences, r.records) for r in terms.term_counts(df, "ngram", "run_id", ["ai_count", "human_count"]).collect()}
    assert got == brute(rows)


def test_hot_term_and_marks(spark):
    rng = random.Random(1)
    rows = [(f"r{rng.randrange(40)}", rng.choice(["hot", "hot", "hot", f"t{rng.randrange(900)}"]), rng.randrange(3), None, None) for _ in range(6000)]
    got = {r.term: r for r in terms.marked_terms(spark.createDataFrame(rows, SCHEMA), "ngram", "run_id", ["ai_count", "human_count"]).collect()}
    want = brute(rows)
    assert {t: (r.occurrences, r.records) for t, r in got.items()} == want
    assert got["hot"].mark == "common" and {r.mark for t, r in got.items() if want[t][0] < 5} == {"rare"}


def test_empty_table_and_plain_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert terms.term_counts(df, "ngram", "run_id").count() == 0
    one = spark.createDataFrame([("r", "x" * 100_000, 1, 1, None)], SCHEMA)
    assert terms.term_counts(one, "ngram", "run_id").first().occurrences == 1


def test_batches_carry_on():
    """A term and a record that span Arrow batches are counted once."""
    import pyarrow as pa

    rows = [("a", "r1", 1), ("a", "r1", 2), ("a", "r2", 1), ("b", None, 5), ("b", "r1", 1)]
    for cut in range(len(rows) + 1):
        parts = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in p], pa.string()), pa.array([x[1] for x in p], pa.string()), pa.array([x[2] for x in p], pa.int64())], ["term", "record", "n"]) for p in (rows[:cut], rows[cut:])]
        assert [tuple(r.values()) for b in terms._last_seen(iter(parts)) for r in b.to_pylist()] == [("a", 4, 2), ("b", 6, 1)]


def test_query_matches_sql(spark, data, duck):
    pytest.importorskip("duckdb")
    from helpers import rows_of

    from lexisift.llm import queries

    for name, sql in queries.SQL.items():
        assert rows_of(queries.QUERIES[name](spark, data).toPandas()) == rows_of(duck.execute(sql).df()), name
