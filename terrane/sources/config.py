"""Layered settings: files that extend others, references to the environment, no key that isn't known.

Layers are tables of leaves, each named by its path, so that laying one over another is a union of tables in which the
later layer's leaves take the place of whatever stood at, above or below them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping
from pathlib import Path
from types import SimpleNamespace

# The settings' names and defaults.
DEFAULTS = {
    ("budget",): 15_000,
    ("workers",): 1,
    ("seed",): 0,
    ("hyper", "k_exhausted_attempts"): 10,
    ("hyper", "tau_density"): 50,
    ("hyper", "delta_min_distance"): 0.2,
    ("hyper", "r_refinement_rounds"): 3,
    ("hyper", "bootstrap_cells_per_family"): 3,
    ("hyper", "bootstrap_patience"): 3,
}

Leaves = dict[tuple[str, ...], object]


def filled(text: str, env: Mapping[str, str]) -> str:
    """``text`` with ``${NAME}`` and ``${NAME:-default}`` replaced; a variable that is set but empty stays empty."""
    done, rest = "", text
    while True:
        before, opened, rest = rest.partition("${")
        done += before
        if not opened:
            return done
        inside, closed, behind = rest.partition("}")
        name, _, default = inside.partition(":-")
        if closed and name.isascii() and name.isidentifier():
            done, rest = done + env.get(name, default), behind
        else:
            done += opened


def _all_filled(value, env: Mapping[str, str]):
    if isinstance(value, str):
        return filled(value, env)
    return [_all_filled(v, env) for v in value] if isinstance(value, list) else {k: _all_filled(v, env) for k, v in value.items()} if isinstance(value, dict) else value


def leaves(tree: Mapping, above: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Every value that isn't a mapping, by its path."""
    for name, value in tree.items():
        if isinstance(value, Mapping):
            yield from leaves(value, (*above, name))
        else:
            yield (*above, name), value


def over(below: Leaves, above: Leaves) -> Leaves:
    """``below`` under ``above``."""
    hidden = {path[:n] for path in above for n in range(1, len(path) + 1)}
    kept = {path: v for path, v in below.items() if path not in hidden and not any(path[:n] in above for n in range(1, len(path)))}
    return kept | above


def nested(flat: Leaves) -> dict:
    """The tree of a table of leaves."""
    tree: dict = {}
    for path, value in flat.items():
        at = tree
        for name in path[:-1]:
            at = at.setdefault(name, {})
        at[path[-1]] = value
    return tree


def parse(text: str) -> dict:
    """A mapping from JSON, or from YAML where a YAML parser is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("this configuration needs a YAML parser; JSON works without") from e
        return yaml.safe_load(text) or {}


def layers(path: str | Path) -> list[dict]:
    """A file's tree and those it extends, the deepest first."""
    found, at = [], Path(path)
    while at is not None:
        tree = parse(at.read_text())
        parent = tree.pop("extends", None)
        found.insert(0, tree)
        at = at.parent / parent if parent else None
    return found


def load(path: str | Path, env: Mapping[str, str] | None = None) -> dict:
    """The tree of a file over those it extends."""
    flat: Leaves = {}
    for tree in layers(path):
        flat = over(flat, dict(leaves(_all_filled(tree, os.environ if env is None else env))))
    return nested(flat)


def settings(*trees: Mapping, defaults: Leaves = DEFAULTS) -> SimpleNamespace:
    """The settings with each tree's values over the defaults and the trees before; an unknown key is an error."""
    flat = dict(defaults)
    for tree in trees:
        given = dict(leaves(tree))
        if unknown := sorted(".".join(path) for path in given if path not in defaults):
            raise ValueError(f"unknown keys: {', '.join(unknown)}")
        flat = over(flat, given)

    def spaced(tree: dict) -> SimpleNamespace:
        return SimpleNamespace(**{k: spaced(v) if isinstance(v, dict) else v for k, v in tree.items()})

    return spaced(nested(flat))


def version_mismatches(expected: Mapping[str, str], actual: Mapping[str, str]) -> list[str]:
    """The tools whose actual version doesn't contain the expected one, or that are missing."""
    return [tool for tool, version in expected.items() if version not in actual.get(tool, "")]
