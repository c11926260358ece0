from quarrylight.operators.leiden import leiden_communities, partition_report


def test_three_cliques_at_rest(spark):
    edges = [(f"{t}{i}", f"{t}{j}", 4) for t in "abc" for i in range(4) for j in range(i + 1, 4)]
    edges += [("a0", "b0", 1), ("b1", "c0", 1)]
    frame = spark.createDataFrame(edges, "a string, b string, weight int")
    labels = leiden_communities(frame)
    groups = {}
    for node, community in labels.collect():
        groups.setdefault(community, []).append(node)
    assert sorted(map(sorted, groups.values())) == [[f"{t}{i}" for i in range(4)] for t in "abc"]
    report = partition_report(frame, labels).collect()
    assert all(r["parts"] == 1 and r["gaining"] == 0 and r["inside"] == 24 for r in report)
    none = spark.createDataFrame([], "a string, b string, weight int")
    assert leiden_communities(none).count() == 0


def test_report_sees_split_and_gaining_communities(spark):
    edges = spark.createDataFrame([("a", "b", 5), ("c", "d", 5), ("b", "c", 1)], "a string, b string, weight int")
    labels = spark.createDataFrame([("a", "x"), ("d", "x"), ("b", "y"), ("c", "y")], "concept string, community string")
    report = {r["community"]: r for r in partition_report(edges, labels).collect()}
    assert report["x"]["parts"] == 2 and report["x"]["gaining"] == 2 and report["x"]["inside"] == 0
    assert report["y"]["parts"] == 1 and report["y"]["inside"] == 1
