import random

import pandas as pd

from silverline.operators.asof import asof_join


def test_asof_matches_pandas_merge_asof(spark):
    rnd = random.Random(7)
    left = [(rnd.choice(["hot"] * 5 + ["a", "b"]), rnd.randint(0, 100_000), i) for i in range(800)]
    right = [(rnd.choice(["hot"] * 5 + ["a", "c"]), rnd.randint(0, 100_000), 1000 + i) for i in range(600)]
    ldf = spark.createDataFrame(left, "k string, t bigint, lid bigint")
    rdf = spark.createDataFrame(right, "k string, rt bigint, rid bigint")
    got = asof_join(ldf, rdf, ["k"], "t", "rt", bucket_seconds=5000).toPandas()
    lp = pd.DataFrame(left, columns=["k", "t", "lid"]).sort_values("t")
    rp = pd.DataFrame(right, columns=["k", "rt", "rid"]).sort_values(["rt", "rid"], ascending=[True, False])
    rp = rp.drop_duplicates(["k", "rt"]).sort_values("rt")
    want = pd.merge_asof(lp, rp, left_on="t", right_on="rt", by="k", direction="backward")
    g = got.set_index("lid")["rid"].fillna(-1).astype(int)
    w = want.set_index("lid")["rid"].fillna(-1).astype(int)
    assert len(got) == len(left)
    assert (g.sort_index() == w.sort_index()).all()
