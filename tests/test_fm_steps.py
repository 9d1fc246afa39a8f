"""The number of sequential steps of an FM fit does not depend on the number of shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.models import fm


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    out = []
    for split, n in (("train", 4000), ("valid", 800)):
        for i in range(n):
            item = int(rng.integers(0, 40))
            out.append((split, i, f"u{i % 40}", f"v{item}", int(rng.random() < 0.4 + item / 80)))
    return spark.createDataFrame(
        out, "split string, row_id long, user_id string, cat_item string, long_view int"
    ).cache()


def bias(model):
    return model.params.where(F.col("id") == fm.BIAS).first()["w"]


def test_shards_take_the_steps_of_one(rows):
    args = dict(k=2, lr=0.001, epochs=1, batch_size=100)
    one = fm.fit_fm(rows, ["cat_item"], **args)
    many = fm.fit_fm(rows, ["cat_item"], shard_batch=25, **args)
    # 40 steps for 1 shard and for 4; a shard's 25 rows a step are noisier, which Adam damps
    assert bias(one) > 0.02
    assert 0.8 * bias(one) < bias(many) < 1.1 * bias(one)


def test_shards_rank_as_well_as_one(rows):
    args = dict(k=2, lr=0.01, epochs=3, batch_size=100)
    found = {n: max(fm.fit_fm(rows, ["cat_item"], shard_batch=n, **args).history) for n in (100, 10)}
    print("valid primary", found)
    assert found[10] > found[100] - 0.01
