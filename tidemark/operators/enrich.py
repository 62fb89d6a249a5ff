"""Facts from chunks: rules for C++ declarations, pluggable models, and what goes around them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTS = "entity string, attribute string, value string, source_path string, source_lines string, chunk_id string"
_COLUMNS = ["entity", "attribute", "value", "source_path", "source_lines", "chunk_id"]
_INCLUDE = re.compile(r"#include\s*(?:\"([^\"]+)\"|<([^>]+)>)")
_MACRO = re.compile(r"(UCLASS|USTRUCT|UENUM|UPROPERTY|UFUNCTION) ?\(")
_TYPE = re.compile(r"(?:enum (?:class|struct)|class|struct|enum)(?=[\s(:{]|$)\s*(?:([A-Z0-9_]+_API)\s+)?(\w+)?", re.A)
_SKIPPED = ("//", "/*", "UPROPERTY", "UFUNCTION", "GENERATED")
#: Lines that may lie between a macro and its declaration.
PATIENCE = {"UCLASS": 5, "USTRUCT": 5, "UENUM": 5, "UPROPERTY": 3, "UFUNCTION": 3}


def split_top(text: str) -> list[str]:
    """Parts between commas outside parentheses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and (depth == 0 or i == len(text)):
            parts.append(text[start:i].strip())
            start = i + 1
    return [p for p in parts if p]


def _balanced(lines: list[str], at: int, column: int) -> tuple[str, int]:
    """What stands in the parentheses that open there, lines joined by blanks, and the line where they close."""
    text, depth, out = "", 0, []
    for n in range(at, len(lines)):
        for c in lines[n][column if n == at else 0 :]:
            if c == "(":
                depth += 1
                if depth == 1:
                    continue
            elif c == ")":
                depth -= 1
                if not depth:
                    return text.join(out), n
            if depth:
                out.append(c)
        out.append(" ")
    return "", at


def _specifier_facts(entity: str, specifiers: list[str], with_category: bool) -> Iterator[tuple[str, str, str]]:
    plain = [s for s in specifiers if not s.startswith(("Category", "meta"))]
    if plain:
        yield entity, "specifiers", ",".join(plain)
    category = next((s.split("=", 1)[1].strip() for s in specifiers if s.startswith("Category") and "=" in s), "")
    if with_category and (category := category[1:-1] if len(category) > 1 and category[0] == category[-1] == '"' else category):
        yield entity, "category", category


def declaration_facts(text: str, path: str, symbol: str = "") -> Iterator[tuple[str, str, str]]:
    """``(entity, attribute, value)`` of includes, reflected types, properties and functions."""
    lines, owner, macro, specifiers, patience, n = (text or "").split("\n"), symbol or "", "", [], 0, -1
    if lines and not lines[-1]:
        lines.pop()
    while (n := n + 1) < len(lines):
        line = lines[n].strip()
        if not line:
            if macro and (patience := patience - 1) <= 0:
                macro = ""
        elif line.startswith("#include"):
            if m := _INCLUDE.match(line):
                yield f"file:{path}", "includes", m[1] or m[2]
        elif not macro:
            if m := _MACRO.match(line):
                content, n = _balanced(lines, n, lines[n].find("("))
                macro, specifiers, patience = m[1], split_top(content), PATIENCE[m[1]]
        elif macro in ("UCLASS", "USTRUCT", "UENUM"):
            if (m := _TYPE.match(line)) and m[2]:
                owner = m[2]
                entity = f"cpp:{owner}"
                yield entity, "kind", macro.lower()
                if m[1]:
                    yield entity, "api_macro", m[1]
                yield from _specifier_facts(entity, specifiers, False)
                _, colon, bases = line[m.end() :].partition(":")
                for base in split_top(bases.split("{")[0]) if colon else []:
                    if b := re.match(r"(?:(?:public|protected|private)\s+)?(\w+)", base, re.A):
                        yield entity, "inherits", b[1]
                macro = ""
            elif (patience := patience - 1) <= 0 or m:
                macro = ""
        elif line.startswith(_SKIPPED):
            if (patience := patience - 1) <= 0:
                macro = ""
        elif macro == "UPROPERTY":
            if m := re.search(r"(\w+)$", re.split("[;=]", line)[0].rstrip(), re.A):
                declared = re.split("[;=]", line)[0].rstrip()
                entity = f"cpp:{owner}.{m[1]}"
                if kind := declared[: m.start()].strip():
                    yield entity, "type", kind
                yield from _specifier_facts(entity, specifiers, True)
                yield entity, "kind", "uproperty"
            macro = ""
        else:
            signature = re.sub(r"^(?:virtual\s+)?(?:static\s+)?", "", line)
            opened = signature.find("(")
            if opened <= 0:
                if (patience := patience - 1) <= 0:
                    macro = ""
                continue
            if m := re.search(r"(\w+)\s*$", signature[:opened], re.A):
                entity = f"cpp:{owner}::{m[1]}"
                if returned := signature[: m.start()].strip():
                    yield entity, "returns", returned
                yield from _specifier_facts(entity, specifiers, True)
                yield entity, "kind", "ufunction"
            macro = ""


def _facts(chunks: DataFrame, find: Callable[[str, str, str], Iterator[tuple[str, str, str]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                (*fact, path, f"{a}-{b}", key)
                for key, path, symbol, a, b, text in zip(*(pdf[c] for c in ("chunk_id", "relative_path", "symbol", "line_start", "line_end", "text")), strict=True)
                for fact in find(text, path, symbol)
            ]
            yield pd.DataFrame(out, columns=_COLUMNS)

    return chunks.select("chunk_id", "relative_path", "symbol", "line_start", "line_end", "text").mapInPandas(run, FACTS)


def rule_facts(chunks: DataFrame) -> DataFrame:
    return _facts(chunks, declaration_facts)


def includes(files: DataFrame) -> DataFrame:
    """``(relative_path, include)`` without leaving the JVM."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*#include\s*[\"<]([^\">\n]+)[\">]"), F.lit(1))
    return files.select("relative_path", F.explode(found).alias("include"))


# ---- models


def strip_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def looks_like_guid(text: Column) -> Column:
    return text.rlike(r"^[0-9A-Fa-f-]{16,}$") & (F.length(F.regexp_replace(text, "-", "")) >= 16)


def first_json_array(text: str) -> list | None:
    """The first balanced JSON array in a model's answer."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\[", text or ""):
        try:
            value, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(value, list):
            return value
    return None


def model_facts(chunks: DataFrame, generate: Callable[[str], str], prompt: Callable[[str, str], str] | None = None, skip_errors: bool = True) -> DataFrame:
    """Facts that a model returns as a JSON array of entity, attribute, value; guids and pin names are no facts."""
    make = prompt or (lambda path, text: f"List the facts of this source as a JSON array of objects with entity, attribute and value.\nFile: {path}\n\n{text}")

    def find(text: str, path: str, symbol: str) -> Iterator[tuple[str, str, str]]:
        try:
            answer = re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", generate(make(path, text)))
        except OSError:
            if skip_errors:
                return
            raise
        for item in first_json_array(answer) or []:
            if isinstance(item, dict) and all(isinstance(item.get(k), str) and item[k].strip() for k in ("entity", "attribute", "value")):
                entity, attribute, value = (item[k].strip() for k in ("entity", "attribute", "value"))
                if re.fullmatch(r"[0-9A-Fa-f-]{16,}", value) or attribute in ("calls", "has_event") and value in ("then", "execute", "self", "ReturnValue", "OutputDelegate"):
                    continue
                yield entity if entity.startswith(("cpp:", "bp:", "file:")) else f"{'bp' if path.endswith('.bpl_json') else 'cpp'}:{entity}", attribute, value

    return _facts(chunks, find)


def run_pipeline(chunks: DataFrame, enrichers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """All enrichers' facts of the same chunks."""
    return reduce(DataFrame.unionByName, [e(chunks) for e in enrichers])


def useful_graph_chunk(text: Column) -> Column:
    """True for chunks of graph exports that say something: references, named nodes, or nothing but a header."""
    any_field = lambda *names: text.rlike('"(' + "|".join(names) + ')":')
    anchors = any_field("function", "variable_ref", "custom_function_name", "macro_ref", "cast_target", "properties", "var_name")
    nodes = text.rlike("K2Node_(CallFunction|VariableGet|VariableSet|Event|MacroInstance|DynamicCast)")
    headers = F.regexp_count(text, F.lit('"(blueprint|asset_path|asset_name|asset_class|asset_kind)":'))
    noise = any_field(*"pin_id direction type_cat type_sub container_type from_node_guid to_node_guid from_pin_name to_pin_name default_value default_object default_text graph_guid node_guid member_guid".split())
    return anchors | (nodes & any_field("title")) | ((headers >= 4) & ~noise)


def with_purposes(facts: DataFrame, purposes: DataFrame) -> DataFrame:
    """Facts with the cached one-line purpose, empty where there is none; stale where the document has changed since."""
    own = purposes.select("entity", "purpose", F.col("structural_hash").alias("_hash"))
    joined = facts.join(own, "entity", "left")
    return joined.withColumns({"purpose": F.coalesce("purpose", F.lit("")), "purpose_stale": F.col("_hash").isNotNull() & (F.col("_hash") != F.col("structural_hash"))}).drop("_hash")


def clean_purpose(text: Column) -> Column:
    """A model's one-liner without fences, quotes, generic openings and a last full stop."""
    bare = F.regexp_replace(F.regexp_replace(strip_thinking(text), r"(?s)```[a-z]*|`", ""), r"\s+", " ")
    bare = F.regexp_replace(F.trim(bare), "^[\"']+|[\"']+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)^(this|the) (blueprint|asset|class|graph) (is|does|handles|implements|defines|represents)( an?| the)? ", ""), r"\.+$", "")


def purpose_prompt(facts: DataFrame) -> DataFrame:
    """``(entity, structural_hash, prompt)``: what a model is asked for an asset's one-line purpose."""
    line = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(F.slice(c, 1, n), ", ")))
    parts = F.array_compact(F.array(F.lit("Say in one sentence what this asset does."), F.concat(F.lit("Name: "), "asset_name"), F.concat(F.lit("Kind: "), "kind"), F.concat(F.lit("Folder: "), folder_hint(F.col("asset_path"))), line("Events", F.col("events"), 20), line("Calls", F.col("calls"), 30)))
    return facts.select("entity", "structural_hash", F.array_join(parts, "\n").alias("prompt"))


def generate_purposes(prompts: DataFrame, cache: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """``(entity, structural_hash, purpose)`` for every row of ``prompts(entity, structural_hash, prompt)``.

    Only assets that the cache does not hold with the same hash go to the model; written as the next cache, the result
    lets a later run, or one that broke off, begin where this one ended.
    """
    known = prompts.select("entity", "structural_hash").join(cache.select("entity", "structural_hash", "purpose").dropDuplicates(["entity", "structural_hash"]), ["entity", "structural_hash"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"entity": pdf["entity"], "structural_hash": pdf["structural_hash"], "answer": [generate(x) for x in pdf["prompt"]]})

    asked = prompts.select("entity", "structural_hash", "prompt").join(known, ["entity", "structural_hash"], "left_anti")
    made = asked.mapInPandas(run, "entity string, structural_hash string, answer string")
    return known.unionByName(made.select("entity", "structural_hash", clean_purpose(F.col("answer")).alias("purpose")))


def stitch(facts: DataFrame, recalled: DataFrame, prefixes: list[str], keywords: list[str]) -> DataFrame:
    """``(entity, attribute, value)``: facts under the prefixes and recalled texts that hold a keyword, each line once.

    ``recalled(frame_id, text)`` are what queries brought up; they become facts ``frame:<id>``, ``text``.
    """
    own = facts.filter(reduce(lambda a, b: a | b, [F.startswith("entity", F.lit(p)) for p in prefixes], F.lit(False))).select("entity", "attribute", "value")
    texts = recalled.select(F.concat(F.lit("frame:"), F.col("frame_id").cast("string")).alias("entity"), F.lit("text").alias("attribute"), F.col("text").alias("value"))
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    line = F.concat_ws("|", norm("entity"), norm("attribute"), norm("value"))
    rows = keyword_facts(own.unionByName(texts), keywords).withColumn("line", line)
    return rows.groupBy("line").agg(F.min(F.struct("entity", "attribute", "value")).alias("first")).select("first.*")


def embedding_text(facts: DataFrame) -> DataFrame:
    """``(entity, text)``: name, kind, purpose, up to three chains, up to fifteen calls, events and casts in one line."""
    joined = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    part = lambda label, c, n: F.when(F.size(c) > 0, F.concat(F.lit(label), joined(c, n)))
    chains = F.transform(F.slice("exec_chains", 1, 3), lambda x: F.concat(F.lit("on "), x["event"], F.lit(": "), x["chain"]))
    pieces = F.array_compact(F.array(F.col("asset_name"), F.col("kind"), F.when(F.col("purpose") != "", F.col("purpose")), F.when(F.size(chains) > 0, F.array_join(chains, ". ")), part("calls ", F.col("calls"), 15), part("events ", F.col("events"), 100), part("casts to ", F.col("casts_to"), 100)))
    return facts.select("entity", F.array_join(pieces, ". ").alias("text"))


def folder_hint(path: Column) -> Column:
    """The last two folders of an asset path."""
    folders = F.filter(F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/"), lambda x: x != "")
    return F.array_join(F.slice(folders, -F.least(F.size(folders), F.lit(2)), F.lit(2)), "/")


def export_name(path: Column) -> Column:
    return F.concat(F.regexp_replace(F.translate(path, "/.", "__"), "^_+", ""), F.lit(".bpl_json"))


def find_export(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``(entity, file)``: the shortest export named for the asset twice, or else once."""
    name = F.regexp_replace("entity", "^bp:", "")
    pairs = entities.select("entity", name.alias("asset")).join(files.select("file", F.regexp_extract("file", r"([^/_]+)\.bpl_json$", 1).alias("asset")), "asset")
    double = F.endswith("file", F.concat(F.lit("_"), F.col("asset"), F.lit("_"), F.col("asset"), F.lit(".bpl_json")))
    return pairs.groupBy("entity").agg(F.min_by("file", F.struct((~double).alias("single"), F.length("file"), "file")).alias("file"))


def keyword_facts(facts: DataFrame, keywords: list[str]) -> DataFrame:
    """Facts with one of the keywords anywhere in them."""
    line = F.lower(F.concat_ws(" ", "entity", "attribute", "value"))
    return facts.filter(line.rlike("|".join(re.escape(k) for k in keywords)))
