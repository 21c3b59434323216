"""Byte-statistics file typing.

B11 counts byte unigrams (256) and bigrams (65,536) over the whole content
with numpy inside Arrow batches (one ``bincount`` per document), emitting
sparse (ID, feature, count) rows. B12 trains a multinomial logistic
regression (pyspark.ml) on those counts, assembled to vectors in the same
batch — no pretrained model exists, so labels come from the caller. The model
can be saved and loaded; predictions are made in the batch that counts, from
its coefficients (classes × features, fixed by the label set). Empty content
is of the unknown class 0. B13 maps a class number to an extension through a
49-row dimension table; B14 lets the class override unallocated files'
extensions, in the record job too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K

NUM_FEATURES = 256 + 256 * 256


#: Rows whose features are in memory together.
SLICE_ROWS = 128


def in_slices(batches):
    """Arrow batches in pieces of ``SLICE_ROWS`` rows: a content's features may
    take many times its bytes."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(at, SLICE_ROWS)


def byte_ngram_counts(docs: DataFrame, id_col: str = "ID", content_col: str = "content") -> DataFrame:
    """(ID, feature, count); feature b for byte b, 256 + 256·a + b for
    the adjacent pair (a, b). Empty content yields no rows (class 0)."""
    def run(batches):
        for b in in_slices(batches):
            ids = b.column(b.schema.get_field_index(id_col)).to_pylist()
            col = b.column(b.schema.get_field_index(content_col))
            out_id, out_f, out_c = [], [], []
            for i, doc in enumerate(ids):
                v = col[i].as_py()
                if not v:
                    continue
                a = np.frombuffer(v, dtype=np.uint8).astype(np.int64)
                keys = np.concatenate([a, 256 + a[:-1] * 256 + a[1:]])
                u, c = np.unique(keys, return_counts=True)
                out_id.extend([doc] * len(u))
                out_f.append(u.astype(np.int32))
                out_c.append(c.astype(np.int64))
            if out_id:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out_id, pa.string()), pa.array(np.concatenate(out_f)),
                     pa.array(np.concatenate(out_c))], names=[id_col, "feature", "count"])

    from ..session import spread
    return spread(docs.select(F.col(id_col).cast("string").alias(id_col), content_col)).mapInArrow(
        run, f"{id_col} string, feature int, count long")


def _features(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and log-scaled counts (which keep long documents from
    dominating) of a content."""
    a = np.frombuffer(content or b"", dtype=np.uint8).astype(np.int64)
    u, c = np.unique(np.concatenate([a, 256 + a[:-1] * 256 + a[1:]]), return_counts=True)
    return u, np.log1p(c.astype(np.float64))


def byte_vectors(docs: DataFrame, id_col: str = "ID", content_col: str = "content") -> DataFrame:
    """(ID, features): sparse vectors, made in the batch that counts."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    parts = [("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]

    def run(batches):
        for b in in_slices(batches):
            rows = [_features(v) for v in b.column(1).to_pylist()]
            vec = pa.StructArray.from_arrays(
                [pa.array([0] * len(rows), pa.int8()), pa.array([NUM_FEATURES] * len(rows), pa.int32()),
                 pa.array([u.astype(np.int32) for u, _ in rows], pa.list_(pa.int32())),
                 pa.array([v for _, v in rows], pa.list_(pa.float64()))], fields=[pa.field(*p) for p in parts])
            yield pa.RecordBatch.from_arrays([b.column(0), vec], names=[id_col, "features"])

    schema = T.StructType([T.StructField(id_col, T.StringType()), T.StructField("features", VectorUDT())])
    return docs.select(F.col(id_col).cast("string").alias(id_col), content_col).mapInArrow(run, schema)


def train_classifier(docs: DataFrame, id_col: str = "ID", content_col: str = "content",
                     label_col: str = "label", max_iter: int = 50):
    """B12 (re-aimed): fit a multinomial logistic regression on the byte
    n-gram counts of ``docs`` (ID, content, label string)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    data = byte_vectors(docs, id_col, content_col).join(
        docs.select(F.col(id_col).cast("string").alias(id_col), label_col), id_col)
    pipe = Pipeline(stages=[
        StringIndexer(inputCol=label_col, outputCol="label_idx", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="features", labelCol="label_idx", maxIter=max_iter,
                           regParam=1e-3, family="multinomial")])
    return pipe.fit(data)


def save_classifier(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def _classes(model, df: DataFrame, content_col: str, where_col: str | None = None) -> DataFrame:
    """``df`` with the class number of its content: 0 for empty content, else 1
    and up in the order of the labels. Rows where ``where_col`` does not hold
    get null."""
    import pyspark.sql.types as T
    lr = model.stages[1]
    weights, bias = lr.coefficientMatrix.toArray().T.copy(), lr.interceptVector.toArray()
    shared = df.sparkSession.sparkContext.broadcast((weights, bias))  # features × classes
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("class", T.IntegerType())])

    def one(content):
        if not content:
            return 0
        w, b = shared.value
        idx, val = _features(content)
        return int(np.argmax(val @ w[idx] + b)) + 1

    def run(batches):
        for b in in_slices(batches):
            content = b.column(names.index(content_col)).to_pylist()
            wanted = b.column(names.index(where_col)).to_pylist() if where_col else [True] * len(content)
            out = [one(c) if w else None for c, w in zip(content, wanted)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*names, "class"])

    return df.mapInArrow(run, schema)


def predict(model, docs: DataFrame, id_col: str = "ID", content_col: str = "content") -> DataFrame:
    """(ID, class, predicted): class number and label; empty content is of
    class 0 and has no label."""
    labels = F.array(F.lit(None).cast("string"), *[F.lit(x) for x in model.stages[0].labels])
    got = _classes(model, docs.select(F.col(id_col).cast("string").alias(id_col), content_col), content_col)
    return got.select(id_col, "class", F.element_at(labels, F.col("class") + 1).alias("predicted"))


def classes(model):
    """What the record job calls: records of unallocated space get the
    extension of their content's class (B12–B14), by ``extension_override``."""
    def run(parsed: DataFrame) -> DataFrame:
        from ..functions.text import is_unallocated
        got = _classes(model, parsed.withColumn("_un", is_unallocated(F.col("path"))), "content", "_un")
        return class_extension(got).select(*parsed.columns, F.when(
            F.col("_un"), F.col("class_extension")).alias("extension_override"))
    return run


def class_table(spark: SparkSession) -> DataFrame:
    """B13 dimension table: (class, extension); class 0 is UNKNOWN → ""."""
    rows = [(i, "" if i == 0 else e) for i, e in enumerate(K.FILE_TYPE_CLASSES)]
    return spark.createDataFrame(rows, "class_id int, class_extension string")


def class_extension(df: DataFrame, class_col: str = "class") -> DataFrame:
    """Extension of a class number; 0 or out of range → "". The
    dimension table has 49 rows, broadcast by construction."""
    t = F.broadcast(class_table(df.sparkSession))
    j = df.join(t, df[class_col] == t["class_id"], "left").drop("class_id")
    return j.withColumn("class_extension", F.coalesce("class_extension", F.lit("")))


def override_extension(docs: DataFrame, ext_col: str = "class_extension") -> DataFrame:
    """Unallocated documents take the classified extension."""
    return docs.withColumn("extension", F.when(F.col("is_unallocated"), F.col(ext_col))
                           .otherwise(F.col("extension")))
