from __future__ import annotations

from evidra.operators import quality as qu
from evidra.plans import audits


def test_order_breaks(spark):
    order = [0, 1, 5, 4, 7, 8, 2, 3, 9]
    want = sum(b <= a for a, b in zip(order, order[1:]))
    df = spark.createDataFrame([(s, o * 3) for o, s in enumerate(order)], "s long, o long").repartition(4)
    for size in (1, 3, 4, 7, 100):
        r = qu.order_breaks(df, "s", "o", size).first()
        assert (r.n, r.out_of_order) == (9, want)


def test_shuffled_output_is_seen(spark, tmp_path):
    order = [0, 1, 5, 4, 7, 8, 2, 3, 9]
    spark.createDataFrame([(i,) for i in range(10)], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i,) for i in order], "doc_id long").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    r = audits.order_kept(spark, str(tmp_path)).first()
    assert (r.n, r.out_of_order) == (9, 2)
