"""Graph documents (nested JSON): facts, execution chains, compression, chunks and patches."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import short_path
from tidemark.operators.common import made_once
from tidemark.schema import GRAPH_DOCUMENT

# Names in exported graphs.
CALLS = ("K2Node_CallFunction", "K2Node_CallParentFunction", "K2Node_LatentAbilityCall")
EVENTS = ("K2Node_Event", "K2Node_CustomEvent")
EXEC_PINS = ("then", "True", "False", "Completed", "OnFailed", "OnSuccess", "OnFinish")
NOISE_PINS = ("then", "execute", "self", "ReturnValue", "OutputDelegate")
TRIVIAL = ("", "false", "False", "FALSE", "None", "none", "NONE", "0", "0.0", "0.000000")
NODE_TYPES = {
    "CallFunction": "K2Node_CallFunction", "CallParentFunction": "K2Node_CallParentFunction", "Event": "K2Node_Event", "CustomEvent": "K2Node_CustomEvent",
    "VariableGet": "K2Node_VariableGet", "VariableSet": "K2Node_VariableSet", "Branch": "K2Node_IfThenElse", "Sequence": "K2Node_ExecutionSequence",
    "Cast": "K2Node_DynamicCast", "MacroInstance": "K2Node_MacroInstance", "FunctionEntry": "K2Node_FunctionEntry", "FunctionResult": "K2Node_FunctionResult",
    "Select": "K2Node_Select", "ComponentBoundEvent": "K2Node_ComponentBoundEvent",
}
NO_GUID = "0" * 32


def is_exec_pin(name: Column) -> Column:
    return name.isin(*EXEC_PINS) | F.startswith(name, F.lit("then_")) | F.startswith(name, F.lit("Then "))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _short(c: Column) -> Column:
    return short_path(_text(c))


def _or_none(c: Column) -> Column:
    return F.when(c != "", c)


def _node(n: Column, g: Column) -> Column:
    call, event = n["function"], n["event_ref"]
    kind = _short(n["class_path"])
    name = F.coalesce(_or_none(_text(event["member_name"])), _or_none(_text(call["member_name"])))
    variable = F.coalesce(_or_none(_text(n["var_name"])), F.get_json_object(n["variable_ref"], "$.member_name"), F.when(~F.startswith(_text(n["variable_ref"]), F.lit("{")), _or_none(_text(n["variable_ref"]))))
    macro = _or_none(_short(F.coalesce(F.get_json_object(n["macro_ref"], "$.macro_blueprint"), F.when(~F.startswith(_text(n["macro_ref"]), F.lit("{")), n["macro_ref"]))))
    cast = _or_none(_short(n["cast_target"]))
    custom = F.when(~_text(n["custom_function_name"]).isin("", "None"), n["custom_function_name"])
    label = (
        F.when(kind.isin(*CALLS), F.coalesce(name, n["title"], F.lit("")))
        .when(kind == "K2Node_VariableSet", F.concat(F.lit("Set "), F.coalesce(variable, F.lit("?"))))
        .when(kind == "K2Node_VariableGet", F.concat(F.lit("Get "), F.coalesce(variable, F.lit("?"))))
        .when(kind == "K2Node_DynamicCast", F.concat(F.lit("Cast<"), F.coalesce(cast, F.lit("?")), F.lit(">")))
        .when(kind == "K2Node_IfThenElse", "Branch").when(kind == "K2Node_ExecutionSequence", "Sequence")
        .when(kind == "K2Node_MacroInstance", F.concat(F.lit("Macro:"), F.coalesce(macro, F.lit("?"))))
        .otherwise(kind)
    )
    owner = F.coalesce(_or_none(_short(event["member_parent"])), _or_none(_short(call["member_parent"])))
    return F.struct(_text(n["node_guid"]).alias("guid"), g.alias("g"), kind.alias("kind"), name.alias("name"), owner.alias("owner"), custom.alias("custom"), variable.alias("variable"), cast.alias("cast"), macro.alias("macro"), label.alias("label"))


def read_documents(raw: DataFrame, column: str = "json") -> DataFrame:
    """``doc`` beside the input's columns; rows whose JSON is no object with an ``asset_name`` are left out."""
    stripped = F.regexp_replace(F.col(column), "^﻿", "")
    return raw.withColumn("doc", F.from_json(stripped, GRAPH_DOCUMENT, {"mode": "PERMISSIVE"})).filter("coalesce(doc.asset_name, '') <> ''")


def asset_kind(name: Column, events: Column) -> Column:
    starts = lambda *p: F.lit(False) if not p else name.rlike("^(" + "|".join(p) + ")")
    return (
        F.when(F.array_contains(events, "K2_ActivateAbility") | F.array_contains(events, "K2_OnEndAbility") | starts("GA_"), "gameplay_ability")
        .when(starts("GE_"), "gameplay_effect").when(starts("GC_", "GCNL_"), "gameplay_cue").when(starts("ABP_", "ALI_"), "anim_blueprint")
        .when(starts("AN_"), "anim_notify").when(starts("W_", "WBP_"), "widget").when(starts("BP_", "B_"), "actor_blueprint").otherwise("blueprint")
    )


def structural_facts(raw: DataFrame, column: str = "json", depth: int = 16) -> DataFrame:
    """One row of facts per graph document, all from array functions over the parsed document.

    Nodes count once by guid, the first winning.  A chain follows the first execution link of each node, whose graph is
    the node's own or a later one, for up to ``depth`` nodes or until it comes back.
    """
    rows = read_documents(raw, column).select("doc")
    graphs = F.coalesce(F.col("doc.graphs"), F.array().cast(GRAPH_DOCUMENT["graphs"].dataType))
    listed = F.flatten(F.transform(graphs, lambda g, i: F.transform(F.coalesce(g["nodes"], F.array().cast(GRAPH_DOCUMENT["graphs"].dataType.elementType["nodes"].dataType)), lambda n: _node(n, i))))
    links = F.flatten(F.transform(graphs, lambda g, i: F.transform(F.coalesce(g["links"], F.array().cast(GRAPH_DOCUMENT["graphs"].dataType.elementType["links"].dataType)), lambda x: F.struct(i.alias("g"), _text(x["from_node_guid"]).alias("a"), _text(x["to_node_guid"]).alias("b"), _text(x["from_pin_name"]).alias("pin")))))
    rows = made_once(rows, graphs=F.transform(graphs, lambda g: _text(g["name"])), listed=listed, links=links)
    rows = made_once(rows, guids=F.transform("listed", lambda n: n["guid"]), steps=F.filter("links", lambda x: (x["a"] != "") & (x["b"] != "") & is_exec_pin(x["pin"])))
    rows = made_once(rows, nodes=F.filter("listed", lambda n, i: (n["guid"] != "") & (F.array_position("guids", n["guid"]) == i + 1)))
    first = lambda n: F.get(F.filter("steps", lambda x: (x["a"] == n["guid"]) & (x["g"] >= n["g"])), F.lit(0))["b"]
    rows = made_once(rows, walk=F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["guid"], F.struct(n["kind"].alias("kind"), n["label"].alias("label"), first(n).alias("next"))))))

    def chain(start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("seen"))

        def step(s: Column, _: Column) -> Column:
            node = F.col("walk")[s["at"]]
            stop = s["at"].isNull() | F.array_contains(s["seen"], s["at"]) | node.isNull()
            path = F.when(node["kind"].isin(*EVENTS), s["path"]).otherwise(F.array_append(s["path"], node["label"]))
            return F.struct(F.when(stop, F.lit(None).cast("string")).otherwise(node["next"]).alias("at"), F.when(stop, s["path"]).otherwise(path).alias("path"), F.when(stop, s["seen"]).otherwise(F.array_append(s["seen"], s["at"])).alias("seen"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), state, step, lambda s: F.array_join(s["path"], " → "))

    def names(field: str, *kinds: str) -> Column:
        return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter("nodes", lambda n: n["kind"].isin(*kinds)), lambda n: n[field]))))

    lists = {
        "events": names("name", "K2Node_Event"), "event_owners": names("owner", "K2Node_Event"), "custom_events": names("custom", "K2Node_CustomEvent"),
        "calls": names("name", *CALLS), "call_owners": names("owner", *CALLS), "gets_variables": names("variable", "K2Node_VariableGet"), "sets_variables": names("variable", "K2Node_VariableSet"),
        "casts_to": names("cast", "K2Node_DynamicCast"), "macros": names("macro", "K2Node_MacroInstance"),
    }
    rows = made_once(rows, **lists)
    starts = F.filter(F.transform(F.filter("nodes", lambda n: n["kind"].isin(*EVENTS)), lambda n: F.struct(F.coalesce(n["name"], n["custom"], F.lit("")).alias("event"), chain(n["guid"]).alias("chain"))), lambda s: ~s["event"].isin("", "None") & (s["chain"] != ""))
    rows = made_once(rows, starts=starts)
    events = F.transform("starts", lambda s: s["event"])
    rows = rows.withColumn("exec_chains", F.array_sort(F.filter("starts", lambda s, i: F.array_position(events, s["event"]) == i + 1)))
    variables = F.filter(F.coalesce(F.col("doc.variables"), F.array().cast(GRAPH_DOCUMENT["variables"].dataType)), lambda v: _text(v["var_name"]) != "")
    rows = rows.withColumns({
        "variables": F.transform(variables, lambda v: F.struct(v["var_name"].alias("name"), F.coalesce(_or_none(_text(v["var_type"]["category"])), F.lit("unknown")).alias("type"))),
        "kind": asset_kind(F.col("doc.asset_name"), F.col("events")),
        "parent_class_hint": F.coalesce(F.array_min(F.filter("event_owners", lambda o: (o != "") & (o != "Object"))), F.lit("")),
        "node_count": F.size("listed"), "link_count": F.size("links"),
    })
    out = rows.select(F.concat(F.lit("bp:"), F.col("doc.asset_name")).alias("entity"), F.col("doc.asset_name").alias("asset_name"), _text(F.col("doc.asset_path")).alias("asset_path"), "kind", "parent_class_hint", "node_count", "link_count", "graphs", *lists, "variables", "exec_chains")
    return out.withColumn("structural_hash", F.substring(F.sha2(F.to_json(F.struct("*")), 256), 1, 16))


def kind_distribution(facts: DataFrame) -> DataFrame:
    return facts.groupBy("kind").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "kind")


# ---- per-document work on JSON, whose shape is open


def _tail(path: str) -> str:
    for mark in "./":
        head, found, rest = path.rpartition(mark)
        if found and rest:
            return rest
    return path


def tokens_of(text: str) -> int:
    return len(re.findall(r"[^\s{}\[\],:\"](?=[\s{}\[\],:\"])", text)) + 1


def compress_node(node: dict) -> dict | None:
    """What a node means, without layout, identifiers and idle pins; None if nothing is left to say."""
    out: dict = {}
    if "title" in node:
        out["title"] = node["title"]
    if "class_path" in node:
        out["class"] = _tail(node["class_path"])
    call, event = node.get("function") or {}, node.get("event_ref") or {}
    for key, value in (("calls", call.get("member_name")), ("from", call.get("member_parent") and _tail(call["member_parent"])), ("event", event.get("member_name"))):
        if value is not None:
            out[key] = value
    if node.get("custom_function_name") not in (None, "", "None"):
        out["custom_event"] = node["custom_function_name"]
    for key in ("variable_ref", "var_name", "cast_target", "macro_ref", "properties"):
        if key in node:
            value = node[key]
            if isinstance(value, dict) and key in ("variable_ref", "macro_ref"):
                value = value.get("member_name") or value.get("macro_blueprint") or ""
            out[key] = _tail(value) if key == "cast_target" else value
    typed, params = [], {}
    for pin in node.get("pins") or []:
        name, way, value = pin.get("name", ""), pin.get("direction", ""), pin.get("default_value") or ""
        if name in NOISE_PINS:
            continue
        if way == "in" and value not in TRIVIAL:
            params[name] = value
        elif way == "out" and pin.get("type_obj"):
            typed.append({"name": name, "type": _tail(pin["type_obj"])})
    out |= ({"typed_pins": typed} if typed else {}) | ({"params": params} if params else {})
    idle = set(out) == {"title", "class"} and out["class"] in ("K2Node_FunctionResult", "K2Node_Knot")
    return None if idle or not out else out


def compress_document(text: str) -> str | None:
    """The document with compressed nodes and no links; None if it is no JSON object."""
    try:
        doc = json.loads(text.removeprefix("﻿"))
    except ValueError:
        return None
    if not isinstance(doc, dict):
        return None
    keep = {k: doc[k] for k in ("asset_name", "asset_path", "asset_class", "asset_kind", "properties", "variables") if k in doc}
    graphs = [{"name": g.get("name", ""), "nodes": [n for n in map(compress_node, g.get("nodes") or []) if n]} for g in doc.get("graphs") or []]
    return json.dumps(keep | ({"graphs": graphs} if graphs else {}), ensure_ascii=False, separators=(",", ":"))


def chunk_document(text: str, target: int = 3000) -> Iterator[tuple[str, str, int]]:
    """``(text, graph, tokens)``: the whole if it fits, else its properties and nodes packed greedily, graph by graph."""
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    if not text:
        return
    try:
        doc = json.loads(text)
        if not isinstance(doc, dict):
            return
    except ValueError:
        yield text, "", tokens_of(text)
        return
    if (n := tokens_of(text)) <= target:
        yield text, "", n
        return
    head = {k: doc[k] for k in ("asset_name", "asset_kind") if doc.get(k)}
    if "properties" in doc:
        part = dump(head | ({"asset_class": doc["asset_class"]} if doc.get("asset_class") else {}) | {"properties": doc["properties"]})
        yield part, "_properties", tokens_of(part)
    for graph in doc.get("graphs") or []:
        name, crumb = graph.get("name", ""), head | {"graph": graph.get("name", ""), "nodes": []}
        cost = tokens_of(dump(crumb))
        held, total = [], cost
        for node in graph.get("nodes") or []:
            n = tokens_of(dump(node))
            alone = n + cost > target
            if held and (alone or total + n > target):
                yield dump(crumb | {"nodes": held}), name, total
                held, total = [], cost
            if alone:
                yield dump(crumb | {"nodes": [node]}), name, n + cost
            else:
                held.append(node)
                total += n
        if held:
            yield dump(crumb | {"nodes": held}), name, total


class PatchError(ValueError):
    pass


def _title(node: dict) -> str:
    return node.get("title", "")


def _find(nodes: list[dict], ref: str, made: dict[str, str]) -> str:
    """The guid behind a reference: a node of the patch, or one that stands there, by title."""
    if ref.startswith("existing:"):
        for n in nodes:
            if _title(n) == ref.removeprefix("existing:"):
                return n.get("node_guid", "")
        raise PatchError(f"no node titled {ref.removeprefix('existing:')!r}; there are {sorted(map(_title, nodes))}")
    if ref not in made:
        raise PatchError(f"no added node {ref!r}; there are {sorted(made)}")
    return made[ref]


def _build(spec: dict, x: int, y: int, guid: str) -> dict:
    kind, get = spec.get("type", ""), lambda k, default="": spec.get(k) or default
    if kind not in NODE_TYPES:
        raise PatchError(f"unknown node type {kind!r}; types are {sorted(NODE_TYPES)}")
    node = {"node_guid": guid, "class_path": f"/Script/BlueprintGraph.{NODE_TYPES[kind]}", "pos_x": x, "pos_y": y, "comment": "", "pins": []}
    reference = lambda name, parent: {"member_name": name, "member_parent": parent, "member_guid": NO_GUID}
    title = {
        "CallFunction": get("function"), "CallParentFunction": get("function"), "Event": get("event"), "CustomEvent": get("event_name", get("title")), "VariableGet": get("variable"),
        "VariableSet": get("variable"), "Cast": "Cast To " + get("cast_target"), "MacroInstance": get("macro"), "Branch": "Branch", "Sequence": "Sequence",
    }.get(kind, "")
    if kind in ("CallFunction", "CallParentFunction"):
        node["function"] = reference(get("function"), get("function_owner"))
    elif kind == "Event":
        node["event_ref"] = reference(get("event"), get("event_owner", "/Script/Engine.Actor"))
    elif kind == "CustomEvent":
        node["custom_function_name"] = title
    elif kind in ("VariableGet", "VariableSet"):
        node |= {"variable_ref": get("variable"), "var_name": get("variable")}
    elif kind == "Cast":
        node["cast_target"] = get("cast_target")
    elif kind == "MacroInstance":
        node["macro_ref"] = get("macro")
    return node | {"title": get("title", title)}


def patch_document(existing: str | None, intent: str) -> tuple[str | None, str | None, str | None]:
    """``(json, summary, error)`` of a patch: nodes and links taken out and put in, pin defaults and variables set.

    New guids come from the patch itself, so a patch that is applied again gives the same document.
    """
    try:
        want = json.loads(intent)
        if want.get("create"):
            target = want.get("target", "")
            name = target.rsplit("/", 1)[-1].rsplit(".", 1)[-1]
            doc = {"blueprint": target, "asset_path": target, "asset_name": name, "asset_class": want.get("parent_class") or "/Script/Engine.Blueprint", "asset_kind": "blueprint", "graphs": [], "variables": []}
        elif not existing:
            raise PatchError("there is no document and the patch does not create one")
        else:
            doc = json.loads(existing.removeprefix("﻿"))
        fresh = iter(range(1 << 30))
        guid = lambda: uuid.uuid5(uuid.NAMESPACE_OID, f"{intent}#{next(fresh)}").hex.upper()
        count, touched = dict.fromkeys(("nodes added", "links added", "nodes removed", "links removed"), 0), []
        for change in want.get("graphs") or []:
            name = change.get("name", "")
            graph = next((g for g in doc.setdefault("graphs", []) if g.get("name", "") == name), None)
            if graph is None:
                graph = {"name": name, "graph_guid": guid(), "schema_class": "/Script/BlueprintGraph.EdGraphSchema_K2", "nodes": [], "links": []}
                doc["graphs"].append(graph)
            nodes, links, made = graph.setdefault("nodes", []), graph.setdefault("links", []), {}
            for item in change.get("remove_nodes") or []:
                title = item if isinstance(item, str) else item.get("title", "")
                gone = next((n for n in nodes if title and _title(n) == title), None)
                if gone is not None:
                    nodes.remove(gone)
                    links[:] = [x for x in links if gone.get("node_guid", "") not in (x.get("from_node_guid", ""), x.get("to_node_guid", ""))]
                    count["nodes removed"] += 1
            for item in change.get("remove_links") or []:
                key = (_find(nodes, item.get("from", ""), {}), item.get("from_pin", ""), _find(nodes, item.get("to", ""), {}), item.get("to_pin", ""))
                kept = [x for x in links if tuple(x.get(k, "") for k in ("from_node_guid", "from_pin_name", "to_node_guid", "to_pin_name")) != key]
                count["links removed"] += len(links) - len(kept)
                links[:] = kept
            refs = [a["ref"] for a in change.get("add_nodes") or [] if a.get("ref")]
            if doubled := {r for r in refs if refs.count(r) > 1}:
                raise PatchError(f"references used twice: {sorted(doubled)}")
            right = max([0, *(n.get("pos_x") or 0 for n in nodes)]) + 300
            for row, spec in enumerate(change.get("add_nodes") or []):
                node = _build(spec, right, 200 * row, guid())
                nodes.append(node)
                if spec.get("ref"):
                    made[spec["ref"]] = node["node_guid"]
                count["nodes added"] += 1
            for item in change.get("set_defaults") or []:
                try:
                    target = _find(nodes, item.get("node", ""), made)
                except PatchError:
                    continue
                pins = next(n for n in nodes if n.get("node_guid", "") == target).setdefault("pins", [])
                pin = next((p for p in pins if p.get("name", "") == item.get("pin", "")), None)
                if pin is None:
                    pin = {"pin_id": NO_GUID, "name": item.get("pin", ""), "direction": "in", "type_cat": "none"}
                    pins.append(pin)
                pin["default_value"] = item.get("value", "")
            for item in change.get("add_links") or []:
                ends = _find(nodes, item.get("from", ""), made), _find(nodes, item.get("to", ""), made)
                links.append({"from_node_guid": ends[0], "from_pin_name": item.get("from_pin", ""), "from_pin_id": NO_GUID, "to_node_guid": ends[1], "to_pin_name": item.get("to_pin", ""), "to_pin_id": NO_GUID})
                count["links added"] += 1
            touched.append(name)
        for v in want.get("variables") or []:
            if v.get("var_name"):
                known = next((x for x in doc.setdefault("variables", []) if x.get("var_name") == v["var_name"]), None)
                if known is not None:
                    known |= {k: v[k] for k in ("var_type", "default_value") if k in v}
                else:
                    doc["variables"].append({"var_name": v["var_name"], "var_guid": guid(), "var_type": v.get("var_type", {}), "default_value": v.get("default_value", ""), "property_flags": v.get("property_flags", 0)})
        said = ", ".join(f"{n} {k}" for k, n in count.items() if n) or "no changes"
        return json.dumps(doc, ensure_ascii=False, indent=1), f"Patched {', '.join(touched)}: {said}", None
    except PatchError as e:
        return None, None, str(e)
    except (ValueError, AttributeError, TypeError) as e:
        return None, None, f"patch cannot be read: {e}"


def compress(raw: DataFrame, column: str = "json", key: str = "doc_id") -> DataFrame:
    """``(key, compressed, tokens_before, tokens_after)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, c, tokens_of(t or ""), tokens_of(c or "")) for k, t in zip(pdf[key], pdf[column], strict=True) for c in [compress_document(t or "")]]
            yield pd.DataFrame(out, columns=[key, "compressed", "tokens_before", "tokens_after"])

    return raw.select(key, column).mapInPandas(run, f"{key} {dict(raw.dtypes)[key]}, compressed string, tokens_before long, tokens_after long")


def chunk(compressed: DataFrame, target: int = 3000, column: str = "compressed", key: str = "doc_id") -> DataFrame:
    """``(key, chunk, graph, tokens, text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, g, n, t) for k, text in zip(pdf[key], pdf[column], strict=True) for i, (t, g, n) in enumerate(chunk_document(text or "", target))]
            yield pd.DataFrame(out, columns=[key, "chunk", "graph", "tokens", "text"])

    return compressed.select(key, column).mapInPandas(run, f"{key} {dict(compressed.dtypes)[key]}, chunk int, graph string, tokens long, text string")


def patch(documents: DataFrame, intents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, json, summary, error)`` of ``documents(key, json)`` and ``intents(key, intent)``; documents may be missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *patch_document(j, i)) for k, j, i in zip(pdf[key], pdf["json"], pdf["intent"], strict=True)], columns=[key, "json", "summary", "error"])

    joined = intents.join(documents.select(key, "json"), key, "left")
    return joined.select(key, "json", "intent").mapInPandas(run, f"{key} {dict(intents.dtypes)[key]}, json string, summary string, error string")
