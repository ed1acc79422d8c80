import random

import duckdb

from skyloom.plans import image_queries as I
from skyloom.plans import registry


def test_second_pass_where_the_residual_has_no_background(spark, tmp_path):
    """Boxes whose residual has a median of exactly 0 keep their own noise."""
    rng = random.Random(1)
    rows = [(j, [0.5 if 100 <= j < 200 and rng.random() < 0.4 else rng.random() for _ in range(64)]) for j in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(x, y): (b, s) for x, y, b, s in duckdb.sql(registry.ORACLE["d02_second_pass"]).fetchall()}
    got = {(r.ix, r.iy): (r.bkg, r.rms) for r in I.d02(spark, str(tmp_path)).collect()}
    assert got == want
