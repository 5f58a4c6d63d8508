"""Selections, overrides and nested settings, as plain values on the driver; they describe queries and hold no rows."""

from __future__ import annotations

import re
from collections.abc import Iterable


def parse_selection(texts: Iterable[str], known: Iterable[str], prefix: str = "e") -> tuple[list[str], list[str]]:
    """(selected, unsupported): '01', 'e01', '03-05' and comma lists, in order and once each."""
    names = list(known)
    wanted: list[str] = []
    for part in (p.strip() for t in texts for p in t.split(",")):
        if not part:
            continue
        m = re.fullmatch(rf"{prefix}?(\d+)(?:-{prefix}?(\d+))?", part)
        if not m:
            raise ValueError(f"{part!r} is no number or range")
        first, last = int(m[1]), int(m[2] or m[1])
        if last < first:
            raise ValueError(f"{part!r} ends before it starts")
        wanted += [f"{prefix}{k:02d}" for k in range(first, last + 1)]
    once = list(dict.fromkeys(wanted))
    return [w for w in once if w in names], [w for w in once if w not in names]


def parse_seeds(texts: Iterable[str], allowed: Iterable[int]) -> list[int]:
    may, out = set(allowed), []
    for part in (p.strip() for t in texts for p in t.split(",")):
        first, _, last = part.partition("-")
        out += range(int(first), int(last or first) + 1)
    if unknown := [s for s in out if s not in may]:
        raise ValueError(f"no such seeds: {unknown}")
    return list(dict.fromkeys(out))


def merged(left: dict, right: dict) -> dict:
    """Nested maps merged, the right one wins."""
    out = dict(left)
    for k, v in right.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def overridden(settings: dict, pairs: Iterable[str]) -> dict:
    """Settings with dotted ``a.b=value`` pairs applied; the values stay text."""
    for pair in pairs:
        key, eq, value = pair.partition("=")
        if not eq or not key:
            raise ValueError(f"{pair!r} is no KEY=VALUE")
        nested: dict | str = value
        for step in reversed(key.split(".")):
            nested = {step: nested}
        settings = merged(settings, nested)
    return settings


def flattened(settings: dict, separator: str = "/") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in settings.items():
        if isinstance(v, dict) and v:
            out |= {f"{k}{separator}{x}": y for x, y in flattened(v, separator).items()}
        else:
            out[k] = v
    return out


def in_order(parents: dict[str, list[str]], wanted: Iterable[str]) -> list[str]:
    """The wanted names and all they depend on, parents first; cycles are cut where they close."""
    out: list[str] = []
    seen: set[str] = set()
    todo = [(w, False) for w in reversed(list(wanted))]
    while todo:
        name, done = todo.pop()
        if done:
            out.append(name)
        elif name not in seen:
            seen.add(name)
            todo.append((name, True))
            todo += [(p, False) for p in reversed(parents.get(name, []))]
    return out
