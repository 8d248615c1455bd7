"""Seeded sampling with replacement."""

from collections import Counter

from tidewell.operators import dataset as ds


def test_classes_and_rows_are_drawn_alike(spark):
    rows = [(k, "common") for k in range(900)] + [(k, "rare") for k in range(900, 909)] + [(999, "single"), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    got = [tuple(r) for r in ds.weighted_sample(df, "label", "doc_id", draws=9000).select("draw", "label", "doc_id").collect()]
    assert sorted(d for d, *_ in got) == list(range(9000))
    classes = Counter(c for _, c, _ in got)
    assert set(classes) == {"common", "rare", "single"} and all(abs(n - 3000) < 5 * 45 for n in classes.values())
    assert all((r, c) in rows for _, c, r in got)
    rare = Counter(r for _, c, r in got if c == "rare")
    assert len(rare) == 9 and all(abs(n - 3000 / 9) < 5 * 18.3 for n in rare.values())
    common = Counter(r for _, c, r in got if c == "common")
    assert max(common.values()) > 5 and 0 < 900 - len(common) < 100  # with replacement, some rows come often and some never
    assert sorted(got) == sorted(tuple(r) for r in ds.weighted_sample(df.repartition(7), "label", "doc_id", draws=9000, slice_rows=50).select("draw", "label", "doc_id").collect())
    assert ds.weighted_sample(df, "label", "doc_id").count() == 910
    assert ds.weighted_sample(df.limit(0), "label", "doc_id").count() == 0
