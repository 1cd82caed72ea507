"""The binary fit hashes its texts once, whatever the number of candidates."""

from __future__ import annotations

from tidesift.operators import cascade


def test_grams_are_hashed_once(spark):
    rows = [(i, "flood water rises" if i % 2 else "sunny day out", None if i == 9 else i % 2 == 1, 1.0 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "uid long, tweet_text string, informative boolean, w double")
    hashed = []

    class Counting(cascade.HashingTF):
        def transform(self, *args, **kwargs):
            hashed.append(1)
            return super().transform(*args, **kwargs)

    kept, cascade.HashingTF = cascade.HashingTF, Counting
    try:
        model, history = cascade.fit_binary(df, df, ({"regParam": 0.1}, {"regParam": 0.01}), weight="w", num_features=1 << 10)
    finally:
        cascade.HashingTF = kept
    assert len(hashed) == 2 and len(history) == 2  # one for each table, none for a candidate
    right = cascade.predict_binary(model, df).filter("predicted = cast(informative as int)").count()
    assert right == 59
