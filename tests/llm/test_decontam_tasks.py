"""How many tasks decontamination's candidates take."""

from __future__ import annotations

from tallyforge.llm import decontam


def test_candidates_come_back_in_few_tasks(spark):
    """However many partitions a shuffle has, the few candidates are read in a few tasks."""
    item = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(k, f"a{k} {item} b{k}") for k in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([("i", item)], "item_id string, text string")
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        _, hits = decontam.contaminated_windows(docs, items)
        assert hits.count() == 20 * 5
        assert hits.rdd.getNumPartitions() < 32
        assert decontam.drop_contaminated(docs, items).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_only_texts_with_candidates_move(spark, monkeypatch):
    """Texts without a candidate stay out of the join, and moving all of them gives the same rows."""
    item = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"a {item} b"), (2, "w0 w1 w2 other"), (3, "nothing here"), (None, item), (1, "another text"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("i", item), ("j", "nothing here at all")], "item_id string, text string")
    _, hits = decontam.contaminated_windows(docs, items)
    moved = decontam.moved_texts(docs, hits).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in moved) == [(0, 14), (1, 2), (1, 16), (2, 4), (3, 2), (4, 0)]
    assert {r["text"] for r in moved} == {f"a {item} b", item, "another text", None}
    rows = lambda: sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.decontaminate(docs, items).collect())
    few = rows()
    assert few == [(0, 14, 14, ("i",)), (1, 2, 0, ()), (1, 16, 14, ("i",)), (2, 4, 0, ()), (3, 2, 0, ()), (4, 0, 0, ())]
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    assert rows() == few
