"""Labels of components over several rounds of links."""

from orbitloom.llm import common, ngram_join


def test_rounds_keep_one_table(spark):
    links = lambda *pairs: spark.createDataFrame(pairs, "a long, b long")
    scratch = common.Scratch()
    labels: list = []
    for more in (links((1, 2), (5, 6)), links((2, 9), (7, 8)), links((6, 8), (1, 2)), links((20, 9))):
        labels = ngram_join._merged(more, labels, scratch)
        assert len(labels) == 1
    rows = ngram_join._labelled(spark.range(1, 22).withColumnRenamed("id", "set_id"), labels, "set_id").collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["label"], set()).add(r["set_id"])
    assert len(rows) == 21 and sorted(map(sorted, (g for g in groups.values() if len(g) > 1))) == [[1, 2, 9, 20], [5, 6, 7, 8]]
