"""Facts about JSON, YAML and TOML files."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions.text import all_matches, let
from tomewright.operators.facts.kinds import KINDS, Facts, code, listed, lists_type

# --- Fixed values ----------------------------------------------------------------------------
YAML_KEY = r"^(\w[\w-]*):"
TOML_SECTION = r"^\[([^\]]+)\]"
TOOL_KEY, TOOL_LABEL = "pi", "Pi config"
DEPENDENCY_LABELS = [  # (key of a package manifest, label, names shown)
    ("dependencies", "Dependencies", 15), ("devDependencies", "Dev dependencies", 15),
    ("peerDependencies", "Peer dependencies", 10),
]
MALFORMED = "JSON configuration file (possibly malformed)."


def yaml_facts(content: Column) -> Column:
    keys = all_matches(content, YAML_KEY, 1, "m")
    about = let(keys, lambda k: F.when(F.size(k) > 0, F.concat(
        F.lit("YAML configuration covering: "), listed(k, 10), F.lit("."))))
    return Facts(about).add("configuration", F.transform(F.slice(keys, 1, 15), code)).column()


def toml_facts(content: Column) -> Column:
    sections = all_matches(content, TOML_SECTION, 0, "m")
    about = let(sections, lambda s: F.when(F.size(s) > 0, F.concat(
        F.lit("TOML configuration with sections: "), F.array_join(s, ", "), F.lit("."))))
    return Facts(about).add("configuration", F.transform(sections, code)).column()


# --- JSON: values as a script would print them -----------------------------------------------

def _reject(token: str):
    raise ValueError(token)


def _ordered(pairs: list) -> dict:
    """Keys as a script enumerates them: whole numbers by size, then the rest as written."""
    found = dict(pairs)
    numbers = sorted((k for k in found if k.isascii() and k.isdigit()
                      and (k == "0" or k[0] != "0") and int(k) < 2**32 - 1), key=int)
    return {**{k: found[k] for k in numbers}, **{k: v for k, v in found.items()
                                                 if k not in set(numbers)}}


def _number(value) -> str:
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def _show(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, list):
        return ",".join("" if v is None else _show(v) for v in value)
    return "[object Object]" if isinstance(value, dict) else value


def _type(value) -> str:
    if isinstance(value, list):
        return f"array ({len(value)} items)"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    return "number" if isinstance(value, (int, float)) else "object"


def _entries(value) -> list[tuple[str, object]]:
    """Keys and values; places and members for lists and strings."""
    if isinstance(value, dict):
        return list(value.items())
    return [(str(i), v) for i, v in enumerate(value)] if isinstance(value, (list, str)) else []


def _manifest(data: dict, add) -> str:
    version = data.get("version") or "0.0.0"
    about = (f"{_show(data['description'])} — v{_show(version)}." if data.get("description") else
             f"Node.js package manifest for `{_show(data.get('name') or 'unknown')}` "
             f"(v{_show(version)}).")
    scripts = _entries(data.get("scripts"))
    if scripts:
        add("configuration", "Scripts: " + ", ".join(
            f"`{k}`: {_show(v)}" for k, v in scripts[:10]))
    for key, label, limit in DEPENDENCY_LABELS:
        names = [k for k, _ in _entries(data.get(key))]
        if names:
            add("dependencyPurposes", f"{label}: " + ", ".join(names[:limit]))
    if data.get("main"):
        add("keyConcepts", f"Entry point: `{_show(data['main'])}`")
    if data.get("type"):
        add("keyConcepts", f"Module type: {_show(data['type'])}")
    if data.get(TOOL_KEY):
        shown = [f"{k}: {json.dumps(v, ensure_ascii=False, separators=(',', ':'))}"
                 for k, v in _entries(data[TOOL_KEY])]
        add("configuration", f"{TOOL_LABEL}: " + ", ".join(shown[:10]))
    return about


def _compiler(data: dict, add) -> None:
    if data.get("compilerOptions"):
        shown = [f"{k}: {_show(v)}" for k, v in _entries(data["compilerOptions"])]
        add("configuration", "Compiler options: " + ", ".join(shown[:12]))
    for key, label in (("include", "Includes"), ("exclude", "Excludes")):
        if data.get(key):
            if not isinstance(data[key], list):
                raise ValueError(key)
            add("configuration", f"{label}: " + ", ".join(
                "" if v is None else _show(v) for v in data[key]))


def _json_file(name: str, content: str) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {k: [] for k in KINDS}

    def add(kind: str, value: str) -> None:
        found[kind].append(value)

    try:
        data = json.loads(content, object_pairs_hook=_ordered, parse_constant=_reject)
        if data is None:
            raise ValueError("no object")
        fields = data if isinstance(data, dict) else {}
        if name == "package.json":
            about = _manifest(fields, add)
        elif name == "tsconfig.json":
            about = "TypeScript compiler configuration."
            _compiler(fields, add)
        else:
            entries = _entries(data)[:10]
            about = f"Configuration file with keys: {', '.join(k for k, _ in entries)}."
            for k, v in entries:
                add("configuration", f"`{k}`: {_type(v)}")
    except (ValueError, RecursionError):
        about = MALFORMED
    found["purpose"] = [about]
    return found


#: Files that are turned into Python values at once.
_FILES_AT_ONCE = 64


@F.arrow_udf(lists_type(KINDS))
def json_facts(files: pa.Array) -> pa.Array:
    """Facts of JSON files; their keys matter in the order in which they are written.

    A few files at a time leave Arrow's memory, however many a batch holds.
    """
    kind = pa.struct([(k, pa.list_(pa.string())) for k in KINDS])
    done = [pa.array([], kind)]
    for at in range(0, len(files), _FILES_AT_ONCE):
        rows = files.slice(at, _FILES_AT_ONCE).to_pylist()
        done.append(pa.array([
            {k: [] for k in KINDS} if f is None or f["content"] is None
            else _json_file(f["name"], f["content"]) for f in rows], kind))
    return pa.concat_arrays(done)
