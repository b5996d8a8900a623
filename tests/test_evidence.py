"""R10's evidence, R14's sources and G23's topics on small tables, odd rows among them."""

from caselens.operators import hypergraph, retrieval

ENTRIES = "owner long, pos long, path string, excerpt string"


def test_best_evidence(spark):
    entries = [
        (1, 0, "Alpha -> Beta", None), (1, 1, "Alpha -> Beta", "x"), (1, 2, "gamma", "alpha BETA, alpha"), (1, 3, "gamma", "alpha beta alpha"),
        (2, 0, None, " "), (2, 1, "b", " "), (3, 0, "p", " kept "),
    ]
    asked = [(1, "Alpha, Beta!"), (1, "alpha"), (1, "ALPHA"), (1, " ?! "), (2, None), (9, "beta"), (10, "beta")]
    texts = [(1, "never: has entries."), (9, "First one. A beta! beta beta"), (10, ""), (11, "No words asked. Second."), (12, None), (9, "…")]
    got = retrieval.best_evidence(
        spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(asked, "owner long, keyword string"), spark.createDataFrame(texts[:-1], "owner long, text string")
    ).collect()
    assert {r.owner: (r.path, r.excerpt, r.score) for r in got} == {
        # two keywords, in the path and in a text that is there; the first of equals
        1: ("Alpha -> Beta", "x", 4), 2: (None, "", 0), 3: ("p", "kept", 2), 9: ("ProjectExcerpt", "A beta!", 1), 11: ("ProjectExcerpt", "No words asked.", 0),
    }
    assert len(got) == 5
    none = spark.createDataFrame([], ENTRIES)
    assert retrieval.best_evidence(none, spark.createDataFrame(asked, "owner long, keyword string")).count() == 0


def test_quotes_in_order_of_their_sources(spark):
    messages = spark.createDataFrame([(1, 2, "User", "second"), (1, 0, "user", " first "), (1, 1, "assistant", "not mine"), (1, 3, "user", None)], "owner long, turn long, role string, text string")
    given = spark.createDataFrame([(1, 0, "given"), (1, 1, "first"), (1, 2, " ")], "owner long, pos long, text string")
    logs = spark.createDataFrame([(1, 0, "", "raw"), (1, 1, "asked", "unseen"), (1, 2, None, None), (1, 3, "given", None)], "owner long, pos long, user_prompt string, raw_message string")
    long = "".join(f"sentence number {i}." for i in range(11))
    sources = spark.createDataFrame([(1, "short. A longer sentence here! "), (2, long), (3, None)], "owner long, text string")
    got = retrieval.quotes(messages, sources, given, logs).orderBy("owner", "place").collect()
    assert [r.quote for r in got if r.owner == 1] == ["first", "second", "given", "raw", "asked", "A longer sentence here!"]
    assert [r.quote for r in got if r.owner == 2] == [f"sentence number {i}." for i in range(10)] + [long[:200]]
    assert [r.place for r in got if r.owner == 1] == list(range(1, 7)) and not [r for r in got if r.owner == 3]


def test_semantic_check(spark):
    edges = spark.createDataFrame([("e1", "Funding  round"), ("e2", "PCB and equity"), ("e3", "nothing"), ("e4", "融资"), ("e5", None)], "edge_id string, text string")
    members = spark.createDataFrame([("e1", "a"), ("e1", "a"), ("e1", "b"), ("e2", "b"), ("e2", "gone"), ("e3", "a")], "edge_id string, node_id string")
    nodes = spark.createDataFrame([("a", "our Investor"), ("b", "firmware\n debug"), ("c", None)], "node_id string, text string")
    got = {(r.edge_id, r.intent): (r.coverage, r.missing, r.forbidden) for r in hypergraph.semantic_check(edges, members, nodes).collect()}
    assert got == {
        ("e1", "financing_edge"): (1.0, "", "hardware"), ("e2", "financing_edge"): (0.0, "financing", "hardware"),
        ("e2", "hardware_edge"): (1.0, "", ""), ("e4", "financing_edge"): (0.0, "financing", ""),
    }
    free = hypergraph.semantic_check(edges, members, nodes, intents={"any": (["nothing"], [], ["financing"])}).collect()
    assert [(r.edge_id, r.coverage, r.missing, r.forbidden) for r in free] == [("e3", 1.0, "", "financing")]
