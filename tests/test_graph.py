import json

from tidemark.operators import enrich, graph

NODE = {"node_guid": "e", "class_path": "/Script/BlueprintGraph.K2Node_Event", "title": "Begin", "event_ref": {"member_name": "ReceiveBeginPlay", "member_parent": "/Script/Engine.Actor"}, "pins": []}
CALL = {"node_guid": "c", "class_path": "/Script/BlueprintGraph.K2Node_CallFunction", "title": "Print", "function": {"member_name": "PrintString", "member_parent": "/Script/Engine.KismetSystemLibrary"}, "pins": [{"name": "InString", "direction": "in", "default_value": "Hello"}, {"name": "then", "direction": "out", "type_obj": "x"}, {"name": "Out", "direction": "out", "type_obj": "/Script/A.B"}]}
SET = {"node_guid": "s", "class_path": "/Script/BlueprintGraph.K2Node_VariableSet", "title": "Set", "variable_ref": {"member_name": "Health"}}
KNOT = {"node_guid": "k", "class_path": "/Script/BlueprintGraph.K2Node_Knot", "title": "Knot"}
LINKS = [{"from_node_guid": a, "from_pin_name": p, "to_node_guid": b} for a, p, b in (("e", "then", "c"), ("c", "then", "s"), ("s", "then", "c"), ("c", "Data", "k"))]
DOC = {"asset_name": "BP_Thing", "asset_path": "/Game/X/BP_Thing", "graphs": [{"name": "EventGraph", "nodes": [NODE, CALL, SET, KNOT, {**CALL, "title": "again"}], "links": LINKS}], "variables": [{"var_name": "Health", "var_type": {"category": "float"}}, {"var_name": "Odd"}]}


def test_structural_facts(spark):
    rows = [(1, "﻿" + json.dumps(DOC)), (2, "{bad"), (3, "{}"), (4, None), (5, json.dumps({"asset_name": "GA_Empty"}))]
    got = {r.asset_name: r for r in graph.structural_facts(spark.createDataFrame(rows, "doc_id long, json string")).collect()}
    assert set(got) == {"BP_Thing", "GA_Empty"}
    f = got["BP_Thing"]
    assert (f.kind, f.parent_class_hint, f.node_count, f.link_count) == ("actor_blueprint", "Actor", 5, 4)
    assert f.calls == ["PrintString"] and f.call_owners == ["KismetSystemLibrary"] and f.sets_variables == ["Health"] and f.events == ["ReceiveBeginPlay"]
    assert [(c.event, c.chain) for c in f.exec_chains] == [("ReceiveBeginPlay", "PrintString → Set Health")]
    assert [(v.name, v.type) for v in f.variables] == [("Health", "float"), ("Odd", "unknown")] and len(f.structural_hash) == 16
    assert got["GA_Empty"].kind == "gameplay_ability" and got["GA_Empty"].exec_chains == []


def test_compression_and_chunks():
    small = json.loads(graph.compress_document(json.dumps(DOC)))
    nodes = small["graphs"][0]["nodes"]
    assert len(nodes) == 4 and nodes[1]["params"] == {"InString": "Hello"} and nodes[1]["typed_pins"] == [{"name": "Out", "type": "B"}]
    text = json.dumps(small)
    assert [g for _, g, _ in graph.chunk_document(text, 10_000)] == [""]
    parts = list(graph.chunk_document(text, 30))
    assert sum(len(json.loads(t)["nodes"]) for t, _, _ in parts) == 4 and {g for _, g, _ in parts} == {"EventGraph"}
    assert [x[0] for x in graph.chunk_document("{bad", 3)] == ["{bad"] and list(graph.chunk_document("")) == []


def test_patches():
    want = {"graphs": [{"name": "EventGraph", "remove_nodes": ["Set"], "add_nodes": [{"ref": "b", "type": "Branch"}], "add_links": [{"from": "existing:Print", "from_pin": "then", "to": "b", "to_pin": "execute"}], "set_defaults": [{"node": "b", "pin": "Condition", "value": "true"}]}], "variables": [{"var_name": "Health", "default_value": "5"}, {"var_name": "New"}]}
    out, said, error = graph.patch_document(json.dumps(DOC), json.dumps(want))
    doc = json.loads(out)
    assert error is None and said == "Patched EventGraph: 1 nodes added, 1 links added, 1 nodes removed"
    assert len(doc["graphs"][0]["links"]) == 3 and [v["var_name"] for v in doc["variables"]] == ["Health", "Odd", "New"]
    assert graph.patch_document(json.dumps(DOC), json.dumps(want))[0] == out
    assert "unknown node type" in graph.patch_document(json.dumps(DOC), '{"graphs": [{"name": "g", "add_nodes": [{"type": "X"}]}]}')[2]
    assert graph.patch_document(None, '{"graphs": []}')[2] and json.loads(graph.patch_document(None, '{"create": true, "target": "/Game/A.B"}')[0])["asset_name"] == "B"


def test_declaration_facts():
    text = 'UCLASS(Blueprintable, meta=(A="b,c"))\nclass GAME_API AThing : public AActor, private IFoo {\n UPROPERTY(EditAnywhere,\n   Category = "Stats")\n\n TArray<int> Items = {};\n UFUNCTION()\n virtual void Tick(float D);\n};\n#include "A/B.h"\n'
    got = list(enrich.declaration_facts(text, "x.h"))
    assert ("cpp:AThing", "inherits", "IFoo") in got and ("cpp:AThing", "api_macro", "GAME_API") in got and ("cpp:AThing", "specifiers", "Blueprintable") in got
    assert ("cpp:AThing.Items", "category", "Stats") in got and ("cpp:AThing.Items", "type", "TArray<int>") in got
    assert ("cpp:AThing::Tick", "returns", "void") in got and ("file:x.h", "includes", "A/B.h") in got


def test_model_facts(spark):
    chunks = spark.createDataFrame([("c", "x.bpl_json", "", 1, 2, "t"), ("d", "y.cpp", "", 1, 2, "fail")], "chunk_id string, relative_path string, symbol string, line_start int, line_end int, text string")

    def generate(prompt):
        if prompt.endswith("fail"):
            raise OSError
        return '<think>[1]</think> sure: [{"entity": "A", "attribute": "calls", "value": "then"}, {"entity": "A", "attribute": "is", "value": "b"}]'

    assert [(r.entity, r.attribute, r.value) for r in enrich.model_facts(chunks, generate).collect()] == [("bp:A", "is", "b")]
