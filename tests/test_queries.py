"""Every registered core query against its SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connection

from gatewise.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert name in registry.ORACLES
    mine, theirs = compare(df, connection(sf_dir), registry.ORACLES[name])
    assert mine == theirs
    assert mine[1]


@pytest.mark.parametrize("pixels", [[i / 64 for i in range(-14, 15)], [float("nan"), -0.2, 0.2, 0.0], [float("inf"), float("-inf"), 0.1], [0.1, None, 0.05], [], None], ids=["halves", "nan", "infinite", "null pixel", "empty", "null"])
def test_img_color_of_odd_pixels(spark, tmp_path, pixels):
    """Halves of the last digit (odd 64ths) are rounded up and NaN is above all pixels, as in the SQL; nulls stay."""
    pq.write_table(pa.table({"vec_id": [1, 2, 3], "embedding": pa.array([[0.05, -0.1], pixels, [0.15]], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    mine, theirs = compare(registry.QUERIES["img_color"](spark, str(tmp_path)), connection(tmp_path), registry.ORACLES["img_color"])
    assert mine == theirs and len(mine[1]) == 3
