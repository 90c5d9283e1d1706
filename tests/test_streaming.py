import numpy as np

from statloom import KMeans, fit_gaussian, fit_linear, grow_tree
from statloom.streaming import score_stream


def test_models_score_a_stream(spark, tmp_path):
    rows = [(i, float(i), float(i % 3), 2.0 * i, i % 2) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, y double, c int")
    source = str(tmp_path / "in")
    frame.repartition(3).write.parquet(source)
    models = [
        fit_linear(frame, ["a", "b"], "y"),
        fit_gaussian(frame, ["a", "b"], "c"),
        grow_tree(frame, "c", ["a", "b"], [], max_depth=3),
        KMeans(spark).create_model(frame, ["a", "b"], 2, "m", "z-score"),
    ]
    for n, model in enumerate(models):
        stream = spark.readStream.schema(frame.schema).parquet(source)
        query = score_stream(model, stream, str(tmp_path / f"out{n}"), str(tmp_path / f"state{n}"), available_now=True)
        query.awaitTermination(60)
        found = spark.read.parquet(str(tmp_path / f"out{n}")).orderBy("id").toPandas()
        expected = model.transform(frame).orderBy("id").toPandas()
        assert list(found.columns) == list(expected.columns)
        for column in found.columns:
            same = np.isclose(found[column], expected[column]) if found[column].dtype == float else found[column] == expected[column]
            assert same.all()
