"""The block matrix against the list it is made of."""

import random

from caselens.operators import incidence


def test_blocks_and_columns(spark):
    r = random.Random(1)
    rows = [(r.randrange(30), "r", r.choice([*range(50), None])) for _ in range(400)] + [(None, "r", 1), (5, "r", 7), (5, "q", 7)]
    members = spark.createDataFrame(rows, "edge_id long, role string, node_id long")
    nodes = spark.createDataFrame([(k,) for k in range(40)] + [(None,), (3,)], "node_id long")
    listed = {}
    for e, _, n in rows:
        if e is not None:
            listed.setdefault(e, set()).add(n)
    for side in (3, 4096):
        m = incidence.build(members, nodes, side)
        assert sorted((x.node_id, x.row) for x in m.rows.collect()) == [(k, k) for k in range(40)]
        assert sorted((x.edge_id, x.col) for x in m.columns.collect()) == [(e, k) for k, e in enumerate(sorted(listed))]
        got = [(x.edge_id, x.node_id) for x in incidence.entries(m, side).collect()]
        assert len(got) == len(set(got)) and set(got) == {(e, n) for e, ns in listed.items() for n in ns if n is not None and n < 40}
        for x in incidence.verify(m, members, side).collect():
            held = {n for n in listed[x.edge_id] if n is not None and n < 40}
            assert (x.listed, x.held, x.missing, x.surplus) == (len(listed[x.edge_id]), len(held), len(listed[x.edge_id] - held), 0)
    # a cell that is not on the list shows, too
    less = members.where("NOT (edge_id = 5 AND node_id = 7)")
    assert {(x.edge_id, x.surplus) for x in incidence.verify(incidence.build(members, nodes), less).where("surplus > 0").collect()} == {(5, 1)}
