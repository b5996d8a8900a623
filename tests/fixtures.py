"""Small case files of our own, in the two layouts."""

import json


def node(id_, kind, name, description="", **more):
    return {"id": id_, "node_type": kind, "name": name, "description": description, "tags": more.pop("tags", []), "metadata": more.pop("metadata", {}), **more}


def metric(case, key, value):
    return node(f"metric_{case}_{key.lower()}", "Metric", key, metric_key=key, value=value)


def healthy():
    """A case without a market or unit-economics fault."""
    c = "c1"
    nodes = [
        node("p_c1", "Project", "Light lunches", "Meals for offices", stage="growth", metadata={
            "customer_profiles": [{"segment": "office staff"}], "value_propositions": [{"name": "fast meals"}], "primary_channels": ["canteen"], "pricing_model": "subscription",
            "rubric_required_evidence": ["deck"], "attachments": ["Deck"]}),
        node("n_customer", "Concept", "Office customer segment", "persona"),
        node("n_value", "Concept", "Meal solution", "benefit"),
        node("n_channel", "Concept", "Canteen channel", "distribution"),
        node("n_proof", "Evidence", "Interview notes", "willingness to pay survey", confidence=0.9),
        node("n_artifact", "Artifact", "Menu prototype", "report"),
        *(metric(c, k, v) for k, v in (("TAM", 100.0), ("SAM", 80.0), ("SOM", 10.0), ("CAC", 5.0), ("LTV", 30.0))),
    ]
    relations = [{"id": "r1", "source_id": "p_c1", "target_id": "n_customer", "relation_type": "PREREQ", "weight": 0.5}, {"id": "r2", "source_id": "n_value", "target_id": "n_proof", "relation_type": "EVIDENCED_BY", "weight": 0.9},
                 {"id": "r3", "source_id": "n_value", "target_id": "nowhere", "relation_type": "PREREQ", "weight": 0.5}]
    edges = [{"id": "e1", "edge_type": "Value_Loop_Edge", "name": "loop", "participants": {"customer": "p_c1", "value": ["n_value", "n_artifact"], "channel": "n_channel"}, "fit_score": 0.8}]
    return {"case_id": "C1", "title": "Lunch", "description": "A plan", "nodes": nodes, "relations": relations, "hyperedges": edges}


def faulty():
    """Heavy machines sold on social media, markets upside down, no evidence."""
    card = node("k1", "KnowledgeCard", "Channel card", industry_benchmarks={"channel_fit_data": [{"channel": "社交媒体", "fit_score": 0.1, "customer_segments": ["buyers"], "applicable_scenarios": []}]})
    project = node("p_c2", "Project", "工业设备 plan", "采购 by factories", stage="mvp", metadata={
        "customer_profiles": [{"segment": "buyers"}], "value_propositions": [{"name": "steady"}], "primary_channels": ["社交媒体"], "competitor_analysis_required": True})
    nodes = [project, card, node("m", "Mistake", "No survey"), *(metric("c2", k, v) for k, v in (("TAM", 100.0), ("SAM", 80.0), ("SOM", 120.0), ("CAC", 0.0), ("LTV", 9.0)))]
    return {"case_id": "C2", "title": "Machines", "description": "全国 expansion", "nodes": nodes, "relations": [], "hyperedges": []}


def bare():
    return {"case_id": "C3", "title": "Empty", "description": "", "nodes": [], "relations": [], "hyperedges": []}


def write(folder):
    for c in (healthy(), faulty(), bare()):
        (folder / f"{c['case_id']}.json").write_text(json.dumps(c, ensure_ascii=False, indent=1))
    (folder / "._C1.json").write_text("{}")
    (folder / "_failed_runs_1.json").write_text("{}")
    return str(folder)
