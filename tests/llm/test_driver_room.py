"""The driver reads edges once a round, counts them once, and drops what it holds of frames out of use."""

import weakref

from tessera.llm import common, ngrams, toxicity


def parts(df):
    return df.rdd.getNumPartitions()


def test_edges_are_read_once_for_both_directions(spark):
    edges = spark.range(0, 90, numPartitions=3).selectExpr("id + 1 as a", "id as b")
    both = common.both_ways(edges)
    assert parts(both) == parts(edges) == 3
    assert sorted(map(tuple, both.collect())) == sorted([(i + 1, i) for i in range(90)] + [(i, i + 1) for i in range(90)])
    assert both.columns == ["a", "b"]


def test_links_are_labelled_as_before(spark):
    members = spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id long")
    links = spark.createDataFrame([(1, 4), (4, 2), (5, 6)], "a long, b long")
    assert dict(map(tuple, ngrams.labelled(members, links).collect())) == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5, 6: 5}


def test_one_count_tells_edges_and_chains(spark):
    made = lambda rows: common.edge_counts(spark.createDataFrame(rows, "a long, b long"))
    assert made([]) == (0, 0)
    # 2 is a leaf of 1 and the centre of 3 and 4
    assert made([(2, 1), (3, 2), (4, 2), (9, 8)]) == (4, 1)
    assert made([(2, 1), (3, 1), (9, 8)]) == (3, 0)


def test_a_chain_ends_in_one_component(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 5), (7, None), (3, 3)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


class Ring:
    pass


def test_the_driver_forgets_what_is_out_of_use(spark):
    ring = Ring()
    ring.own, gone = ring, weakref.ref(ring)
    del ring
    common.forget(spark)
    assert gone() is None


def test_components_and_training_forget(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "forget", lambda s: calls.append("components"))
    monkeypatch.setattr(toxicity, "forget", lambda s: calls.append("training"))
    monkeypatch.setattr(toxicity, "hand_back", lambda: calls.append("trained"))
    common.connected_components(spark.createDataFrame([(1, 2)], "a long, b long")).collect()
    docs = spark.createDataFrame([(i, f"word{i % 3} and text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 40
    assert calls == ["components", "training", "trained"]
