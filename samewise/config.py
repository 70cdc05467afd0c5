"""Configuration: reading, defaults, checks, and the order of several runs."""

from __future__ import annotations

import os
from copy import deepcopy
from pathlib import Path
from typing import Any

from samewise.sources.listfiles import local

TASKS = ("smatch", "evaluation", "batch", "llm-train", "llm-test")
_COMMON = {
    "output_file_name": "test",
    "log": {"path": "pipeline/logging"},
    "graph": {"meta_path": [], "node_types": ["7#__tn", "7$__tt", "5$__st", "3$__idx", "1$__cid"], "flatten": "tt", "smoothing_method": "no", "directed": False},
    "walks": {"write_walks": True, "walk_length": 60, "walks_number": 20, "backtrack": False, "rw_stat": False},
    "embeddings": {"learning_method": "skipgram", "window_size": 3, "negative": 5, "epochs": 5, "inc_epochs": 10, "min_count": 0, "n_dimensions": 300, "training_algorithm": "word2vec", "sampling_factor": 0.001},
}
DEFAULTS: dict[str, dict[str, Any]] = {
    "batch": _COMMON,
    "smatch": _COMMON
    | {
        "similarity_list": {"top_k": 3, "simlist_n": 3, "simlist_show": 3, "strategy_suppl": "basic", "output_format": "graphml", "sim_structure": "graph"},
        "kafka": {"topicid": "entity_resolution_process", "groupid": "er_group", "bootstrap_servers": "localhost", "port": 9092, "window_strategy": "count", "window_count": 50, "update_frequency": 0, "idle_seconds": 30},
    },
    "evaluation": {"output_file_name": "test", "log": {"path": "pipeline/logging"}, "source_a": 0, "eva": {"n_first": 3, "approximate": 16}},
    "llm-train": {},
    "llm-test": {},
}


def scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        parts, depth, start = [], 0, 1
        for i, c in enumerate(text[1:-1] + ",", 1):
            depth += (c == "[") - (c == "]")
            if c == "," and not depth:
                parts.append(text[start:i])
                start = i + 1
        return [scalar(p) for p in parts if p.strip()]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if text in ("", "null", "~"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parsed(text: str) -> dict[str, Any]:
    """Nested mappings and lists of scalars by indentation, which is all of YAML that configurations use."""
    lines = []
    for raw in text.splitlines():
        body = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if body.strip():
            lines.append((len(body) - len(body.lstrip()), body.strip()))

    def block(at: int, indent: int) -> tuple[Any, int]:
        if lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                items.append(scalar(lines[at][1][2:]))
                at += 1
            return items, at
        out: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == indent and not lines[at][1].startswith("- "):
            key, sep, rest = lines[at][1].partition(":")
            if not sep:
                raise ValueError(f"not a mapping: {lines[at][1]!r}")
            at += 1
            deeper = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ")))
            if not rest.strip() and deeper:
                out[scalar(key)], at = block(at, lines[at][0])
            else:
                out[scalar(key)] = scalar(rest)
        return out, at

    if not lines:
        return {}
    found, at = block(0, lines[0][0])
    if at != len(lines):
        raise ValueError(f"wrong indentation: {lines[at][1]!r}")
    return found


def read(path: str) -> dict[str, Any]:
    return parsed(Path(path).read_text(encoding="utf-8"))


def merged(given: dict[str, Any], default: dict[str, Any]) -> dict[str, Any]:
    """The defaults with what is given; given values win, mappings merge."""
    out = deepcopy(default)
    for key, value in given.items():
        out[key] = merged(value, out[key]) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _one_of(config: dict[str, Any], section: str, key: str, allowed: tuple[str, ...]) -> None:
    if config[section][key] not in allowed:
        raise ValueError(f"{section}.{key} is {config[section][key]!r}; it must be one of {', '.join(allowed)}")


def flatten_types(value: Any) -> list[str]:
    """``no`` flattens nothing, ``all`` every kind of value, a name or list those named."""
    if value in (None, False, "no", []):
        return []
    if value in (True, "all"):
        return ["tt", "tn"]
    found = [value] if isinstance(value, str) else list(value)
    if set(found) - {"tt", "tn"}:
        raise ValueError(f"unknown kind to flatten: {value!r}")
    return found


def checked(given: dict[str, Any]) -> dict[str, Any]:
    """Defaults are merged first, then everything is checked, before anything runs."""
    task = given.get("task")
    if task not in TASKS:
        raise ValueError(f"task is {task!r}; it must be one of {', '.join(TASKS)}")
    config = merged(given, DEFAULTS[task])
    if task in ("batch", "smatch"):
        _one_of(config, "graph", "smoothing_method", ("log", "no", "IDF", "ICF"))
        _one_of(config, "embeddings", "training_algorithm", ("word2vec", "fasttext"))
        _one_of(config, "embeddings", "learning_method", ("skipgram", "CBOW"))
        config["graph"]["flatten"] = flatten_types(config["graph"]["flatten"])
    if task == "smatch":
        _one_of(config, "kafka", "window_strategy", ("count", "time"))
        wanted = f"window_{config['kafka']['window_strategy']}"
        if wanted not in config["kafka"]:
            raise ValueError(f"kafka.{wanted} is missing")
        _one_of(config, "similarity_list", "output_format", ("db", "json", "parquet", "graphml"))
        if config["similarity_list"]["output_format"] == "db":
            local(config["output_file_name"])
        _one_of(config, "similarity_list", "strategy_suppl", ("faiss", "basic"))
    for name in {"batch": ("dataset_file",), "evaluation": ("similarity_file", "match_file")}.get(task, ()):
        if not config.get(name):
            raise ValueError(f"{name} is missing")
        if "://" not in str(config[name]) and not os.path.exists(config[name]):
            raise FileNotFoundError(config[name])
    if task == "evaluation":
        config["output_format"] = Path(config["similarity_file"]).suffix[1:]
    return config


def files(folder: str) -> list[str]:
    """The configurations of a folder in order, without defaults."""
    return sorted(str(p) for p in Path(folder).glob("*.yaml") if not p.name.startswith("default"))
