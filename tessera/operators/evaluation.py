"""Evaluation operators: tiered matching, turn dynamics, naturalness index, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import answer_words
from tessera.operators import buckets as B
from tessera.operators.metrics import STAGES

#: Bucket tables are products of small domains; a larger one is not a bucket table.
MAX_BUCKETS = 100_000


def tiered_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, tier) for each row of ``left``: its partner and how it was found.

    Both sides are (index, exact, prompt).  Rows pair at the same index with the
    same exact signature; then first with first among equal exact signatures; then
    among equal prompt signatures.  Each row is used once; tiers run one after the
    other; a row without a partner has a null ``r`` and tier ``missing``.
    """
    a = left.select(F.col("index").alias("l"), "exact", "prompt")
    b = right.select(F.col("index").alias("r"), "exact", "prompt")
    found = None
    for tier, key in (("position_exact", None), ("signature_exact", "exact"), ("prompt_fallback", "prompt")):
        if found is not None:
            rest_a, rest_b = a.join(found, "l", "left_anti"), b.join(found, "r", "left_anti")
        else:
            rest_a, rest_b = a, b
        if key is None:
            hits = rest_a.alias("x").join(rest_b.alias("y"), (F.col("x.l") == F.col("y.r")) & (F.col("x.exact") == F.col("y.exact"))).select("l", "r")
        else:
            place = lambda rows, index: rows.select(index, key, F.row_number().over(Window.partitionBy(key).orderBy(index)).alias("_n"))
            hits = place(rest_a, "l").join(place(rest_b, "r"), [key, "_n"]).select("l", "r")
        hits = hits.withColumn("tier", F.lit(tier))
        found = hits if found is None else found.unionByName(hits)
    return a.select("l").join(found, "l", "left").withColumn("tier", F.coalesce("tier", F.lit("missing")))


def similarity(gap: Column) -> Column:
    return F.when(gap.isNotNull() & ~F.isnan(gap), 1 / (1 + gap))


def _terms(rows: DataFrame, bits: int) -> DataFrame:
    """(id, side, slot, w): tf-idf of hashed words, each text scaled to length 1."""
    sides = F.explode(F.create_map(*[x for s in ("question", "human", "generated") for x in (F.lit(s[0]), F.col(s))]))
    words = rows.select("id", sides.alias("side", "text")).select("id", "side", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("t"))
    tf = words.groupBy("id", "side", F.pmod(F.xxhash64("t"), F.lit(1 << bits)).cast("int").alias("slot")).agg(F.count("*").alias("tf"))
    df = tf.groupBy("slot").agg(F.count("*").alias("df"))
    n = 3 * rows.count()
    weighted = tf.join(df, "slot").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1))
    norms = weighted.groupBy("id", "side").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, ["id", "side"]).select("id", "side", "slot", (F.col("w") / F.col("norm")).alias("w"))


def _directions(terms: DataFrame, n_rows: int, bits: int, rank: int) -> np.ndarray:
    """First right singular vectors of the questions, at most ``2 ** bits`` by ``rank``."""
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.linalg.distributed import RowMatrix

    size = 1 << bits
    rows = terms.where("side = 'q'").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("v"))
    vectors = rows.rdd.map(lambda r: SparseVector(size, [(e[0], e[1]) for e in r.v])).cache()
    try:
        return RowMatrix(vectors, n_rows, size).computeSVD(rank, computeU=False).V.toArray()
    finally:
        vectors.unpersist()


def turn_dynamics(rows: DataFrame, least: int = 20, rank: int = 64, bits: int = 16) -> DataFrame:
    """Four likenesses of generated and human turns to their questions, by bucket.

    ``rows`` is (id, bucket_id, question, human, generated) with unique ids.  Words
    are hashed to ``2 ** bits`` slots, so that the singular vectors which the driver
    holds stay below 8 * rank * 2 ** bits bytes.  Cross-covariances are summed per
    batch and then by bucket; no bucket is gathered in one task.
    """
    rows = rows.select("id", "bucket_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("question", "human", "generated")]).persist()
    n_rows = rows.count()
    terms = _terms(rows, bits).persist()
    n_slots = terms.select("slot").distinct().count()
    rank = min(rank, n_rows - 1, n_slots - 1)
    if rank < 2:
        # two slots or at most two rows: an orthonormal basis that holds every text whole
        held = terms.where(f"{n_rows} <= 2").collect() if n_slots > 3 else []
        at = {k: i for i, k in enumerate(sorted({(r.id, r.side) for r in held}))}
        spanned = np.zeros((1 << bits, len(at)))
        for r in held:
            spanned[r.slot, at[r.id, r.side]] = r.w
        slots = [r.slot for r in terms.select("slot").distinct().collect()] if not held else []
        directions = np.linalg.qr(spanned)[0] if held else np.eye(1 << bits, 1 if not slots else 0)
        for slot in slots:
            directions = np.column_stack([directions, np.arange(1 << bits) == slot])
    else:
        directions = _directions(terms, n_rows, bits, rank)
    width = directions.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    vectors = terms.groupBy("id").pivot("side", ["q", "h", "g"]).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))))
    words = lambda c: F.size(answer_words(F.col(c))).cast("double")
    ratio = lambda c: (words(c) / F.greatest(words("question"), F.lit(1.0))).alias(f"{c}_length")
    joined = rows.select("id", "bucket_id", ratio("human"), ratio("generated")).join(vectors, "id", "left")

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis = shared.value
        for frame in frames:
            maps = {s: [dict(m) if m is not None else {} for m in frame[s]] for s in "qhg"}
            latent = {s: np.array([basis[list(m)].T @ np.fromiter(m.values(), float) if m else np.zeros(width) for m in v]).reshape(len(v), width) for s, v in maps.items()}
            made = {"id": frame["id"], "bucket_id": frame["bucket_id"], "human_length": frame["human_length"], "generated_length": frame["generated_length"]}
            for s, name in (("h", "human"), ("g", "generated")):
                made[f"{name}_lexical"] = [sum(w * b.get(k, 0.0) for k, w in a.items()) for a, b in zip(maps["q"], maps[s], strict=True)]
                norm = np.linalg.norm(latent["q"], axis=1) * np.linalg.norm(latent[s], axis=1)
                made[f"{name}_latent"] = (latent["q"] * latent[s]).sum(axis=1) / np.where(norm > 0, norm, 1.0)
            yield pd.DataFrame(made | {s: list(latent[s]) for s in "qhg"})

    kinds = ("length", "lexical", "latent")
    schema = "id long, bucket_id string, " + ", ".join(f"{n}_{k} double" for k in kinds for n in ("human", "generated")) + ", q array<double>, h array<double>, g array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    scored = joined.select("id", "bucket_id", "human_length", "generated_length", "q", "h", "g").mapInPandas(lambda fs: (f[names] for f in project(fs)), schema).persist()
    big = scored.groupBy("bucket_id").agg(F.count("*").alias("n_examples"), *[F.stddev_pop(f"human_{k}").alias(f"{k}_std") for k in kinds]).where(F.col("n_examples") >= least)

    values = scored.select("bucket_id", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.lit(i).alias("side"), F.col(f"{n}_{k}").alias("value")) for k in kinds for i, n in enumerate(("generated", "human"))])).alias("v")).select("bucket_id", "v.*")
    gaps = B.wasserstein(values, ["bucket_id", "feature"]).groupBy("bucket_id").pivot("feature", list(kinds)).agg(F.first("w1"))

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bucket, part in frame.groupby("bucket_id"):
                q, h, g = (np.stack(part[s].to_list()) for s in "qhg")
                flat = np.concatenate([q.sum(0), h.sum(0), g.sum(0), (q.T @ h).ravel(), (q.T @ g).ravel()])
                yield pd.DataFrame({"bucket_id": bucket, "at": np.arange(len(flat), dtype=np.int64), "total": flat})

    sums = scored.select("bucket_id", "q", "h", "g").mapInPandas(moments, "bucket_id string, at long, total double").groupBy("bucket_id", "at").agg(F.sum("total").alias("total"))

    def transition(frame: pd.DataFrame) -> pd.DataFrame:
        """One bucket: 3 * width + 2 * width ** 2 sums, whatever its number of rows."""
        flat = frame.sort_values("at")["total"].to_numpy()
        n = float(frame["n_examples"].iloc[0])
        q, h, g = (flat[i * width : (i + 1) * width] for i in range(3))
        qh, qg = (flat[3 * width + i * width**2 : 3 * width + (i + 1) * width**2].reshape(width, width) for i in range(2))
        human, generated = qh / n - np.outer(q, h) / n**2, qg / n - np.outer(q, g) / n**2
        size = float(np.linalg.norm(human))
        return pd.DataFrame({"bucket_id": [frame["bucket_id"].iloc[0]], "transition_gap": [float(np.linalg.norm(generated - human)) / (size if size > 1e-12 else 1.0)]})

    moved = sums.join(F.broadcast(big.select("bucket_id", "n_examples")), "bucket_id").groupBy("bucket_id").applyInPandas(transition, "bucket_id string, transition_gap double")
    scale = lambda k: F.when(F.col(f"{k}_std") > 1e-12, F.col(f"{k}_std")).otherwise(1.0)
    whole = big.join(gaps, "bucket_id").join(moved, "bucket_id")
    likes = [similarity(F.col(k) / scale(k)).alias(f"{k}_similarity") for k in kinds] + [similarity(F.col("transition_gap")).alias("transition_similarity")]
    done = whole.select("bucket_id", "n_examples", *likes)
    return done.withColumn("tdm", sum((F.col(f"{k}_similarity") for k in (*kinds, "transition")), F.lit(0.0)) / 4)


def naturalness_index(table: DataFrame, utility: str, columns: list[str], lower_is_better: tuple[str, ...] = ("bng",)) -> DataFrame:
    """Adds ``naturalness_index``: the first principal score of the columns, from 0 to 1.

    ``table`` has one row a bucket.  Columns that are wholly null are left out; rows
    with a null in the rest or in ``utility`` get a null.  The sign is such that the
    index rises with the mean of the standardised columns.
    """
    frame = table.limit(MAX_BUCKETS + 1).toPandas()
    if len(frame) > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    used = [c for c in columns if c in frame and frame[c].notna().any()]
    rows = frame.dropna(subset=[utility, *used]) if used else frame.iloc[:0]
    index = pd.Series(np.nan, index=frame.index)
    if len(rows):
        x = np.column_stack([rows[c].to_numpy(float) * (-1 if c in lower_is_better else 1) for c in used])
        std = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(std > 0, std, 1.0)
        score = z[:, 0] if z.shape[1] == 1 else z @ np.linalg.svd(z, full_matrices=False)[2][0]
        mean = z.mean(axis=1)
        if z.shape[1] > 1 and ((score - score.mean()) * (mean - mean.mean())).sum() < 0:
            score = -score
        low, high = score.min(), score.max()
        index[rows.index] = (score - low) / (high - low) if high - low > 1e-12 else 1.0
    names = [f"{n} {t}" for n, t in table.dtypes] + ["naturalness_index double"]
    values = [[None if pd.isna(v) else v for v in r] for r in frame.assign(naturalness_index=index).astype(object).itertuples(index=False)]
    return table.sparkSession.createDataFrame(values, ", ".join(names))


def detector_summary(scored: DataFrame) -> DataFrame:
    """By source: rows with both score and verdict, the rest, verdict counts, rate, mean."""
    good = F.col("score_ai").isNotNull() & ~F.isnan("score_ai") & F.col("predicted_ai").isNotNull()
    n = F.count_if(good)
    ai = F.count_if(good & F.col("predicted_ai"))
    return scored.groupBy("source_id").agg(
        n.alias("n_scored"), F.count_if(~good).alias("n_errors_or_unscored"), ai.alias("predicted_ai_count"), F.count_if(good & ~F.col("predicted_ai")).alias("predicted_human_count"),
        F.round(F.try_divide(ai, n), 6).alias("predicted_ai_rate"), F.round(F.avg(F.when(good, F.col("score_ai"))), 6).alias("score_ai_mean"),
    )


def row_counts_agree(rows: DataFrame) -> DataFrame:
    """(n_sources, least, most, consistent) of the row counts of all sources."""
    counts = rows.groupBy("source_id").agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_sources"), F.min("n").alias("least"), F.max("n").alias("most"), (F.count_distinct("n") <= 1).alias("consistent"))


def stage_trend(summaries: DataFrame, value: str) -> DataFrame:
    """By model: stages in their fixed order, their values, and whether none falls."""
    order = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    points = summaries.where(F.col(value).isNotNull()).withColumn("_o", order).where("_o > 0")
    before = F.lag(value).over(Window.partitionBy("model_key").orderBy("_o"))
    points = points.withColumn("_up", F.coalesce(F.col(value) >= before, F.lit(True)))
    rows = points.groupBy("model_key").agg(F.array_sort(F.collect_list(F.struct("_o", "stage", F.col(value).alias("v")))).alias("p"), F.bool_and("_up").alias("never_falls"))
    return rows.select("model_key", F.array_join(F.transform("p", lambda x: x["stage"]), ",").alias("stages"), F.array_join(F.transform("p", lambda x: x["v"].cast("string")), ",").alias("points"), "never_falls")


def score_diagnostics(pairs: DataFrame, tie: float = 1e-10) -> DataFrame:
    """One row over (chosen, rejected, chosen_score, rejected_score); ``collapsed`` if at
    least four pairs of unlike texts all tie."""
    tied = F.abs(F.col("chosen_score") - F.col("rejected_score")) <= tie
    unlike = ~F.col("chosen").eqNullSafe(F.col("rejected"))
    both = F.array("chosen_score", "rejected_score")
    a, b = F.col("chosen_score"), F.col("rejected_score")
    n = F.count("chosen_score") + F.count("rejected_score")
    total, square = F.sum(a) + F.sum(b), F.sum(a * a) + F.sum(b * b)
    row = pairs.agg(
        F.min(F.array_min(both)).alias("score_min"), F.max(F.array_max(both)).alias("score_max"), F.sqrt(F.greatest(F.lit(0.0), square / n - (total / n) * (total / n))).alias("std"),
        F.count_if(tied).alias("equal_score_records"), F.count_if(unlike).alias("distinct_text_pairs"), F.count_if(unlike & tied).alias("distinct_text_equal_score_records"),
    )
    all_tied = F.coalesce(F.col("score_max") - F.col("score_min") <= tie, F.lit(False))
    collapsed = (F.col("distinct_text_pairs") >= 4) & (all_tied | (F.col("distinct_text_pairs") == F.col("distinct_text_equal_score_records")))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return row.select(
        r(F.col("score_min")).alias("score_min"), r(F.col("score_max")).alias("score_max"), r(F.col("score_max") - F.col("score_min")).alias("score_range"), r(F.col("std")).alias("score_std"),
        "equal_score_records", "distinct_text_pairs", "distinct_text_equal_score_records", all_tied.alias("all_scores_tied"), collapsed.alias("collapsed"),
    )
