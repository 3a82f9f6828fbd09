"""Joins that must refuse what does not belong together, and deduplication by hand cases."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import alignment as A
from tessera.operators import corpus as K
from tessera.operators import indexing as I

REC = "source_index long, question string, context string, history array<array<string>>, human_answer string"
PRE = "source_index long, instruction string, input string, history array<array<string>>, reference_output string, prediction string"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(0, "q0", "", [], "a0"), (1, "q1", "c", [["u", "v"]], "a1"), (2, "q2", "", [], "")], REC)


def preds(spark, *rows):
    return spark.createDataFrame(list(rows), PRE)


GOOD = [(0, "q0", "", [], "a0", "p0"), (1, "q1", "c", [["u", "v"]], "a1", "a1"), (2, "", None, None, "", "p2")]


def test_strict_pairs(spark, records):
    assert [(r.source_index, r.chosen, r.rejected) for r in A.strict_pairs(records, preds(spark, *GOOD)).collect()] == [(0, "a0", "p0")]
    bad = {
        "duplicate": [*GOOD, GOOD[0]], "missing": GOOD[:2], "out_of_range": [*GOOD, (7, "", "", [], "", "x")], "missing_source_index": [*GOOD, (None, "", "", [], "", "x")],
        "mismatch": [GOOD[0], (1, "q1", "c", [["u", "w"]], "a1", "x"), GOOD[2]],
    }
    for name, rows in bad.items():
        with pytest.raises(ValueError, match=name):
            A.strict_pairs(records, preds(spark, *rows))


def test_lenient_pairs(spark, records):
    rows = [GOOD[0], GOOD[0], (0, "other", "", [], "", "p"), (1, "q1", "", [], "", " a1\n"), (1, "", "", [], "", "  "), (2, "", "", [], "", "x")]
    judged = A.judged_pairs(records, preds(spark, *rows))
    assert sorted(r.status for r in judged.collect()) == ["empty_chosen", "empty_rejected", "exact_match", "mismatch", "paired", "paired"]
    assert A.lenient_pairs(judged).count() == 2 and A.lenient_pairs(judged, keep_exact_match=True).count() == 3 and A.lenient_pairs(judged, keep_mismatched=True).count() == 3
    empty = A.pair_counters(A.judged_pairs(records, preds(spark, *rows).limit(0)), 3).first()
    assert (empty.source_records, empty.prediction_rows, empty.missing_source_indices) == (3, 0, 3)


def test_strict_joins(spark):
    left = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "ordinal long, id string, x int")
    right = spark.createDataFrame([(0, "a", 5), (1, "b", 6)], "ordinal long, id string, y int")
    assert [tuple(r) for r in A.strict_zip(left, right).orderBy("ordinal").collect()] == [(0, "a", 1, 5), (1, "b", 2, 6)]
    assert [tuple(r) for r in A.one_to_one(left.select("id", "x"), right.select("id", "y")).orderBy("id").collect()] == [("a", 1, 5), ("b", 2, 6)]
    for other in (right.limit(1), right.union(right.limit(1)), right.withColumn("id", F.lit("a"))):
        with pytest.raises(Exception, match="do not pair"):
            A.strict_zip(left, other).collect()
    with pytest.raises(Exception, match="repeats"):
        A.one_to_one(left.select("id", "x"), right.withColumn("id", F.lit("a")).select("id", "y")).collect()


def test_required_alignment(spark, records):
    view = records.select("source_index", F.col("question").alias("instruction"), F.col("context").alias("input"), "history", F.col("human_answer").alias("output"))
    exact = view.withColumnRenamed("output", "reference_output").withColumn("prediction", F.lit("p"))
    assert A.require_aligned(A.alignment_report(view, exact, records))["n_prediction_rows"] == 3
    with pytest.raises(ValueError, match="missing_index_count"):
        A.require_aligned(A.alignment_report(view, exact.limit(2), records))


def test_dedup_by_hand(spark):
    """Groups go to their best split before anything is seen; all seven fields count; cases and blanks do not."""
    made = [  # dataset, split, question, answer, dialogue, history
        ("coqa", "train", "q", "a", "g1", []), ("coqa", "test", "q2", "b", "g1", []),  # the group is in test
        ("squad_v2", "train", "Q ", " a", None, []), ("squad_v2", "dev", "q", "A", None, []),  # dev wins; the conflicting row keeps nothing out
        ("squad_v2", "train", "another", "a", None, []), ("squad_v2", "train", "q", "a", None, [("user", "hi")]), ("dolly", "train", "q", "a", None, [("user", ""), ("", "x")]),
        ("dolly", "train", "another", "a", None, []),
    ]
    rows = [(str(i), ds, sp, "en", "single", "qa", "qa_search", q, "", h, a, g, i) for i, (ds, sp, q, a, g, h) in enumerate(made)]
    frame = spark.createDataFrame(rows, f"id string, dataset string, split string, language string, track string, family string, style_bucket string, question string, context string, dialogue_history {K.TURNS}, human_answer string, g string, ordinal long")
    records = K.build_records(frame, {"conversation_id": F.col("g"), "ordinal": F.col("ordinal")}).withColumn("ordinal", F.get_json_object("meta", "$.ordinal").cast("long"))
    assert ", ".join(f"{n} {t}" for n, t in records.drop("ordinal").dtypes) == K.RECORD
    assert {r.id for r in K.dedup(records).collect()} == {"1", "3", "5", "7"}
    report = K.removal_report(K.mark_duplicates(records)).first()
    assert (report.original_total, report.final_total, report.group_split_conflicts_removed, report.exact_duplicates_removed) == (8, 4, 1, 3)
    assert (report.same_split_duplicates_removed, report.cross_split_duplicates_removed, report.cross_dataset_duplicates_removed) == (1, 2, 2)
    assert K.removal_report(K.mark_duplicates(records.limit(0))).first().duplicate_rate == 0


def test_places(spark):
    rows = spark.createDataFrame([(i * 3, "x") for i in (5, 1, 4, 2, 9, 0, 7)], "k long, v string").repartition(3)
    assert [(r.k, r.source_index) for r in I.with_row_index(rows, "k").orderBy("k").collect()] == [(k, i) for i, k in enumerate((0, 3, 6, 12, 15, 21, 27))]
    assert I.with_row_index(rows.limit(0), "k").count() == 0
    assert I.first_n(rows, "k", 0).count() == 7 and I.random_n(rows, "k", -1).count() == 7
    assert spark.range(1).select(I.merge_in_order(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("b"))).alias("m")).first().m == ["b", "a", "c"]
