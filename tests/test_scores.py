"""Quality, validation and run logs against small brute-force versions."""

import random

import pytest

from tablewash.operators import quality, runlog, validate
from tablewash.sources.tables import Relationship, TableSet


def brute_matches(a, b, numeric):
    shorter = min(len(a), len(b))
    if numeric:
        x, y = sorted(v for v in a if v is not None), sorted(v for v in b if v is not None)
        hits = sum(abs(p - q) < 1e-6 for p, q in zip(x[:shorter], y[:shorter]))
        return min(hits + min(a.count(None), b.count(None)), shorter)
    x, y = (sorted("__NULL__" if v is None else v for v in side) for side in (a, b))
    return sum(p == q for p, q in zip(x[:shorter], y[:shorter]))


@pytest.mark.parametrize("buckets", [1, 5])
@pytest.mark.parametrize("seed, n, m", [(1, 60, 60), (2, 80, 50), (3, 40, 70)])
def test_matches(spark, seed, n, m, buckets):
    rng = random.Random(seed)
    def side(size):
        return [(None if rng.random() < 0.2 else rng.randrange(15) + rng.choice([0.0, 4e-7, 3e-6]),
                 None if rng.random() < 0.2 else rng.choice("abcdefg")) for _ in range(size)]
    a, b = side(n), side(m)
    schema = "x double, s string"
    got = {r["column"]: r["matches"] for r in quality.column_matches(
        spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), buckets).collect()}
    assert got == {"x": brute_matches([r[0] for r in a], [r[0] for r in b], True),
                   "s": brute_matches([r[1] for r in a], [r[1] for r in b], False)}


@pytest.fixture
def clean(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", 3.0)], "k int, s string, x double")


def test_score_of_a_table_against_itself(clean):
    assert tuple(quality.score_quality(clean, clean).first()) == (0.9999,) * 4


def test_score_corner_cases(spark, clean):
    nothing = spark.createDataFrame([(None, None, None)] * 3, "k int, s string, x double")
    assert quality.score_quality(nothing, clean).first()["completeness"] < 0.5
    assert tuple(quality.score_quality(clean.limit(0), clean).first()) == (1e-4,) * 4
    assert tuple(quality.score_quality(clean.select("k"), clean.select("s")).first()) == (1e-4,) * 4


def test_completeness_is_quadratic(spark):
    rows = [(i, None if i == 0 else i) for i in range(10)]  # 5% of the cells
    score = quality.completeness(spark.createDataFrame(rows, "k int, v int")).first()
    assert score["completeness"] == pytest.approx(0.6 * 0.5625 + 0.4)


def test_row_count_and_schema_lower_the_score(clean):
    twice = clean.union(clean)
    assert quality.score_quality(twice, clean).first()["correctness"] < 0.6
    assert quality.schema_accuracy(clean.selectExpr("cast(k as string) k", "s", "cast(x as int) x"), clean) == pytest.approx(2 / 3)


def test_score_of_a_set(clean):
    links = (Relationship("t", "k", "t", "k"),)
    score = quality.score_quality_set(TableSet({"t": clean}, links), {"t": clean, "gone": clean}).first()
    assert score["overall"] == pytest.approx(0.9 * (0.9999 + 1e-4) / 2 + 0.1, abs=1e-6)
    assert score["fk_integrity"] == 0.9999


def test_rules(spark, clean):
    hints = {"s": "Some missing values", "x": "nothing to do"}
    good = validate.validate_table(clean, clean, hints)
    assert good.where("passed").count() == good.count() == 1 + 1 + 3 + 2 + 1
    assert validate.validation_score(good).first()["validation_score"] == 0.9999
    bad = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (3, "c", 999.0), (3, "d", None)], "k string, s string, x double")
    failed = {(r["rule"], r["column"]): r["violating"] for r in validate.validate_table(bad, clean, hints).where("not passed").collect()}
    assert failed == {("NULL_REMAINING", "s"): 2, ("DUPLICATES", None): 1, ("TYPE_MISMATCH", "k"): 0,
                      ("RANGE_VIOLATION", "x"): 1, ("ROW_COUNT", None): 0}
    none = clean.selectExpr("k", "s", "cast(null as double) x")
    assert validate.validate_table(none, clean, {}).where("rule = 'RANGE_EMPTY' and not passed").count() == 1


def test_dates_may_stand_as_text(clean):
    dated = clean.selectExpr("k", "timestamp'2020-01-01' s", "x")
    assert validate.validate_table(dated, clean, {}).where("not passed and rule = 'TYPE_MISMATCH'").count() == 0
    assert quality.schema_accuracy(dated, clean) == pytest.approx(2 / 3)


LOG = "run_id int, step int, action_type string, column string, valid boolean, cost int, initial_budget int, quality double"


def test_run_log(spark):
    log = spark.createDataFrame([
        (1, 1, "drop_duplicates", None, True, 1, 20, 0.5), (1, 2, "drop_duplicates", None, True, 1, 20, 0.5),
        (1, 3, "fill_null", "a", True, 1, 20, 0.7), (1, 4, "drop_duplicates", None, True, 1, 20, 0.7),
        (1, 5, "fill_null", "a", True, 1, 20, 0.7), (1, 6, "fill_null", "b", False, 1, 20, 0.7),
        (1, 7, "normalize", "a", True, 2, 20, 0.6), (2, 1, "fill_null", "a", True, 1, 0, 0.2)], LOG)
    steps = [r for r in runlog.score_steps(log, buckets=4).orderBy("run_id", "step").collect()]
    assert [r["redundant"] for r in steps] == [False, True, False, False, True, False, False, False]
    assert [round(r["gain"], 6) for r in steps] == [0.5, 0, 0.2, 0, 0, 0, 0, 0.2]
    assert [round(r["penalty"], 6) for r in steps] == [0, 0.1, 0, 0, 0.1, 0.5, 0.4, 0]
    assert steps[0]["reward"] == pytest.approx(5 - 0.05) and steps[7]["reward"] == pytest.approx(2 - 1)
    assert [r["used"] for r in steps] == [1, 2, 3, 4, 5, 6, 8, 1]
    quality_of = {r["run_id"]: r["action_quality"] for r in runlog.action_quality(log).collect()}
    assert quality_of == {1: pytest.approx(1 - 3 / 7), 2: 1.0}
    left = {r["run_id"]: r["efficiency"] for r in runlog.efficiency(log).collect()}
    assert left == {1: pytest.approx(1 - 8 / 20), 2: 1.0}


def test_final_score(spark):
    log = spark.createDataFrame([(1, 1, "fill_null", "a", True, 1, 10, 1.0)], LOG)
    results = spark.createDataFrame([(1, 1.0, 1.0, 1.0)], "run_id int, quality double, validation double, schema_accuracy double")
    done = runlog.final_scores(log, results)
    assert done.first()["score"] == pytest.approx(0.4 * 0.9999 + 0.2 * 0.9999 + 0.15 * 0.9 + 0.1 * 0.9999 + 0.15 * 0.9999, abs=1e-6)
    assert runlog.leaderboard(done).first()["budget"] == "1/10"
    assert runlog.average_score(done).first()["runs"] == 1
