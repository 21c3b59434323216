"""Guards that keep broadcasts and driver-side state bounded."""

import pytest
from pyspark.sql import functions as F


def test_bounded_broadcast_hints_only_small_sides(spark):
    from scrutin.session import bounded_broadcast
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only hints broadcast
    try:
        left = spark.range(5000)
        small = left.join(bounded_broadcast(spark.range(10), max_rows=100), "id")
        big = left.join(bounded_broadcast(spark.range(1000), max_rows=100), "id")
        assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in big._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_weight_matrix_size_is_checked(spark):
    from scrutin.operators import som as S
    cfg = S.SomConfig(width=1000, height=1000)
    with pytest.raises(ValueError):
        S.weight_matrix(S.initial_weights(spark, cfg, 1000), cfg, dims=1000)


@pytest.fixture
def map_data(spark):
    from scrutin.operators import som as S
    rng = __import__("random").Random(4)
    cfg = S.SomConfig(width=5, height=4, max_radius=2, min_radius=0, max_alpha=0.3, min_alpha=0.1, iterations=4)
    rows = [(str(i), sorted(rng.sample(range(11), rng.randrange(0, 6)))) for i in range(150)]
    return cfg, spark.createDataFrame(rows, "ID string, features array<int>")


def _map(spark, vec, cfg, **kw):
    import numpy as np
    from scrutin.operators import som as S
    t = S.train(vec, cfg, 11, **kw)
    cells = {r["ID"]: (r["cell"], r["som_x"], r["som_y"], r["som_cell_distance"] and round(r["som_cell_distance"], 9))
             for r in S.assign(vec, t).collect()}
    return np.round(S.weight_matrix(t.weights, cfg, 11), 9).tolist(), cells


def test_map_of_many_blocks_equals_one_block(spark, monkeypatch, map_data):
    """Blocks of three cells and of few features, and documents in many
    groups: weights and assignments as with one block."""
    from scrutin.operators import som as S
    cfg, vec = map_data
    whole = _map(spark, vec, cfg)
    monkeypatch.setattr(S, "BLOCK_BYTES", 8 * 11 * 3)
    monkeypatch.setattr(S, "GROUP_DOCS", 20)
    b = S.Blocks.of(cfg, 11)
    assert b.cblocks == 7 and b.fblocks == 11
    assert _map(spark, vec, cfg) == whole
    # a map that does not fit the bound of a collected matrix trains too
    monkeypatch.setattr(S, "MAX_MATRIX_BYTES", 8)
    assert S.train(vec, cfg, 11).weights.count() == cfg.cells
    # weights that are given are cut to the same blocks
    w = S.initial_weights(spark, cfg, 11)
    assert sorted(map(tuple, S.cell_rows(S.blocks_from(w, b), b).collect())) == sorted(map(tuple, w.collect()))


def test_nearest_k_cells_against_brute_force(spark, monkeypatch, map_data):
    """In one block and in blocks of three cells; ties go to the lower cell."""
    import numpy as np
    from scrutin.operators import som as S
    cfg, vec = map_data
    rows = {r["ID"]: r["features"] for r in vec.collect() if r["features"]}
    mat = S.initial_matrix(cfg, 11)
    mat[3], mat[17] = mat[5], mat[5]
    want = set()
    for i, f in rows.items():
        x = np.zeros(11)
        x[f] = 1
        d = [(round(float(((x - w) ** 2).sum()), 9), c) for c, w in enumerate(mat)]
        want |= {(i, r, c, v) for r, (v, c) in enumerate(sorted(d)[:4], 1)}
    for size in (16 << 20, 8 * 11 * 3):
        monkeypatch.setattr(S, "BLOCK_BYTES", size)
        b = S.Blocks.of(cfg, 11)
        docs, groups = S.grouped(vec, len(rows))
        near = S.nearest_k(docs, groups, S.blocks_from(S.matrix_frame(spark, mat), b), b, 4)
        assert {(r["ID"], r["rank"], r["cell"], round(r["distance"], 9)) for r in near.collect()} == want


def test_training_against_the_dense_form(spark, map_data):
    """Epochs as one dense step each, from the same counts."""
    import numpy as np
    from scrutin.operators import som as S
    cfg, vec = map_data
    mat = S.initial_matrix(cfg, 11)
    for alpha, radius in cfg.schedule():
        counts = S.winner_counts(vec, spark.sparkContext.broadcast(mat), 11).toArrow()
        mat = S.epoch_update(mat, counts, cfg, alpha, radius)
    assert np.allclose(mat, _map(spark, vec, cfg)[0], atol=1e-8)


def test_training_resumes_behind_the_last_epoch(spark, tmp_path, monkeypatch, map_data):
    from scrutin.operators import som as S
    cfg, vec = map_data
    whole, path, update, ran = _map(spark, vec, cfg), f"{tmp_path}/training", S.updated_blocks, []

    def dies(*a):
        ran.append(1)
        if len(ran) == 3:
            raise KeyboardInterrupt
        return update(*a)

    monkeypatch.setattr(S, "updated_blocks", dies)
    with pytest.raises(KeyboardInterrupt):
        S.train(vec, cfg, 11, path=path)
    assert S._finished(spark, path) == 1
    (tmp_path / "training" / "epoch-00002").mkdir()  # begun, not finished
    assert _map(spark, vec, cfg, path=path) == whole
    assert len(ran) == 5  # two epochs, the one that died, and the two that were left
    assert _map(spark, vec, cfg, path=path) == whole and len(ran) == 5


def test_a_map_without_feature_terms(spark):
    from scrutin.operators import som as S
    cfg = S.SomConfig(width=2, height=2)
    vec = spark.createDataFrame([("1", []), ("2", [])], "ID string, features array<int>")
    t = S.train(vec, cfg, 0)
    assert sorted((r["ID"], r["cell"]) for r in S.assign(vec, t).collect()) == [("1", "-1"), ("2", "-1")]
    assert t.weights.count() == 4 and t.epochs.count() == cfg.iterations


def test_literal_frames_stay_in_the_jvm(spark):
    from scrutin.session import literal_frame
    df = literal_frame(spark, ["a", "b"], "term")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and sorted(r["term"] for r in df.collect()) == ["a", "b"]
    assert literal_frame(spark, [], "term").count() == 0
    assert df.where(F.col("term") == "a").count() == 1


def test_texts_are_dealt_to_tasks_by_their_size(spark, tmp_path, monkeypatch):
    """More tasks than the session's partitions where texts are large."""
    from scrutin import session
    from scrutin.operators import analysis as A
    from scrutin.operators import hits as H
    spark.range(2000).select(F.col("id").cast("string").alias("ID"), F.sha2(F.col("id").cast("string"), 256).alias("body")) \
        .write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert session.tasks_for(docs) == 4
    rows = spark.createDataFrame([("1", "a b")], "ID string, body string")
    assert session.tasks_for(rows) == 4 and A.raw_tokens(A.by_document(rows)).count() == 2
    monkeypatch.setattr(session, "TASK_BYTES", 10_000)
    assert session.tasks_for(docs) > 10
    assert A.by_document(docs).rdd.getNumPartitions() == H.sentence_chunks(docs).rdd.getNumPartitions() == session.tasks_for(docs)
