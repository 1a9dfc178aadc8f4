"""Pipelines: parsing into stages, and rewriting before they are compiled.

Spark plans what is compiled, so only what Spark can't see is rewritten here: joins that a lookup hides in an array.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from ..errors import BadValue, UnsupportedOperator

STAGES = ("$match", "$sort", "$skip", "$limit", "$count", "$project", "$addFields", "$unset", "$replaceRoot", "$unwind", "$group", "$sortByCount", "$lookup")
SAME_AS = {"$set": "$addFields", "$replaceWith": "$replaceRoot"}


@dataclass(frozen=True)
class Stage:
    name: str
    spec: object
    #: What a rewriting has added: how a lookup joins, and which fields of its documents are used.
    notes: dict = field(default_factory=dict)


def whole(value: object, least: int, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < least:
        raise BadValue(f"{what} needs a whole number from {least} on")
    return int(value)


def name_of(value: object, what: str) -> str:
    if not isinstance(value, str) or not value or value.startswith("$"):
        raise BadValue(f"{what} needs a name")
    return value


def path_of(value: object, what: str) -> str:
    if not isinstance(value, str) or not value.startswith("$") or len(value) < 2:
        raise BadValue(f"{what} needs a field path that begins with $")
    return value[1:]


def parse_sort(spec: object) -> tuple[tuple[str, int], ...]:
    if not isinstance(spec, dict) or not spec:
        raise BadValue("a sort names fields")
    for direction in spec.values():
        if isinstance(direction, bool) or direction not in (1, -1):
            raise BadValue("a sort's direction is 1 or -1")
    return tuple((path, int(d)) for path, d in spec.items())


def _unwind(spec: object) -> dict:
    spec = {"path": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or "path" not in spec or set(spec) - {"path", "includeArrayIndex", "preserveNullAndEmptyArrays"}:
        raise BadValue("$unwind needs a path")
    keep = spec.get("preserveNullAndEmptyArrays", False)
    if not isinstance(keep, bool):
        raise BadValue("preserveNullAndEmptyArrays is a boolean")
    index = spec.get("includeArrayIndex")
    return {"path": path_of(spec["path"], "$unwind"), "keep": keep, "index": None if index is None else name_of(index, "includeArrayIndex")}


def _lookup(spec: object) -> dict:
    if not isinstance(spec, dict):
        raise BadValue("$lookup needs a document")
    if {"let", "pipeline"} & set(spec):
        raise UnsupportedOperator("$lookup joins by equality of two fields")
    if set(spec) != {"from", "localField", "foreignField", "as"}:
        raise BadValue("$lookup needs from, localField, foreignField and as")
    return {k: name_of(v, f"$lookup {k}") for k, v in spec.items()}


def _project(spec: object) -> dict:
    if not isinstance(spec, dict) or not spec:
        raise BadValue("$project needs fields")
    return spec


def _fields(spec: object) -> dict:
    if not isinstance(spec, dict) or not spec or any(not k or k.startswith("$") for k in spec):
        raise BadValue("$addFields needs fields")
    return spec


def _unset(spec: object) -> list[str]:
    names = [spec] if isinstance(spec, str) else spec
    if not isinstance(names, (list, tuple)) or not names:
        raise BadValue("$unset needs field names")
    return [name_of(n, "$unset") for n in names]


def _group(spec: object) -> dict:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise BadValue("$group needs _id")
    if any("." in k or k.startswith("$") for k in spec):
        raise BadValue("a group's fields are plain names")
    return spec


def _filter(spec: object) -> dict:
    if not isinstance(spec, dict):
        raise BadValue("$match needs a filter")
    return spec


def _count(spec: object) -> str:
    if "." in name_of(spec, "$count"):
        raise BadValue("$count needs a plain name")
    return spec


def _root(spec: object, name: str) -> object:
    if name == "$replaceWith":
        return spec
    if not isinstance(spec, dict) or set(spec) != {"newRoot"}:
        raise BadValue("$replaceRoot needs newRoot")
    return spec["newRoot"]


def parse(pipeline: list[dict]) -> list[Stage]:
    """The stages of a pipeline, their shapes checked."""
    if not isinstance(pipeline, (list, tuple)):
        raise BadValue("a pipeline is an array of stages")
    out = []
    for one in pipeline:
        if not isinstance(one, dict) or len(one) != 1:
            raise BadValue("a stage has one name")
        given, spec = next(iter(one.items()))
        name = SAME_AS.get(given, given)
        if name not in STAGES:
            raise UnsupportedOperator(f"unsupported stage {given}")
        checked = {
            "$match": _filter, "$sort": parse_sort, "$skip": lambda s: whole(s, 0, "$skip"), "$limit": lambda s: whole(s, 1, "$limit"), "$count": _count, "$project": _project,
            "$addFields": _fields, "$unset": _unset, "$replaceRoot": lambda s, g=given: _root(s, g), "$unwind": _unwind, "$group": _group, "$sortByCount": lambda s: s, "$lookup": _lookup,
        }[name](spec)
        out.append(Stage(name, checked))
    return out


def _uses(stages: list[Stage], name: str) -> set[str] | None:
    """The fields below `name` that stages use; None where the whole value may be used."""
    found: set[str] = set()
    for s in stages:
        text = json.dumps(s.spec, default=str)
        if s.name in ("$project", "$group") and f'"{name}"' not in text and f'"${name}"' not in text and "$$" not in text:
            found |= _paths(s.spec, name)
            kept = s.name == "$group" or any(not isinstance(v, (bool, int, float)) or v for k, v in s.spec.items() if k != "_id")
            if kept:
                return found  # nothing else of it goes on from here
            continue
        if s.name in ("$match", "$sort", "$skip", "$limit", "$addFields", "$unwind") and f'"{name}"' not in text and f'"${name}"' not in text and "$$" not in text:
            found |= _paths(s.spec, name)
            continue
        return None
    return None


def _paths(spec: object, name: str) -> set[str]:
    if isinstance(spec, dict):
        return {p for k, v in spec.items() for p in _paths(k, name) | _paths(v, name)}
    if isinstance(spec, (list, tuple)):
        return {p for v in spec for p in _paths(v, name)}
    if isinstance(spec, str):
        bare = spec.lstrip("$")
        return {bare.split(".")[1]} if bare.startswith(f"{name}.") else set()
    return set()


def rewrite(stages: list[Stage]) -> list[Stage]:
    """Fuse neighbouring matches, and turn lookups whose array is not needed as such into plain joins.

    A lookup and an unwind of its result is an inner join, or a left one where the unwind keeps empty results. A lookup
    and a match on an empty result, with the result unused later, is an anti-join; on one that isn't empty, a semi-join.
    """
    out: list[Stage] = []
    i = 0
    while i < len(stages):
        s, after = stages[i], stages[i + 1] if i + 1 < len(stages) else None
        if s.name == "$match" and out and out[-1].name == "$match":
            out[-1] = Stage("$match", {"$and": [out[-1].spec, s.spec]})
        elif s.name == "$lookup" and after and after.name == "$unwind" and after.spec["path"] == s.spec["as"] and not after.spec["index"]:
            used = _uses(stages[i + 2 :], s.spec["as"])
            out.append(replace(s, notes={"join": "left" if after.spec["keep"] else "inner", "used": used}))
            i += 1
        elif s.name == "$lookup" and after and after.name == "$match" and after.spec in ({s.spec["as"]: {"$size": 0}}, {s.spec["as"]: []}, {s.spec["as"]: {"$ne": []}}) and _dead(stages[i + 2 :], s.spec["as"]):
            out.append(replace(s, notes={"join": "semi" if after.spec == {s.spec["as"]: {"$ne": []}} else "anti"}))
            i += 1
        else:
            if s.name == "$lookup":
                s = replace(s, notes={"used": _uses(stages[i + 1 :], s.spec["as"])})
            out.append(s)
        i += 1
    return out


def _dead(stages: list[Stage], name: str) -> bool:
    """Whether no later stage, nor the result, has the field."""
    for s in stages:
        text = json.dumps(s.spec, default=str)
        if f'"{name}"' in text or f'"${name}' in text or f'"{name}.' in text or "$$" in text:
            return s.name == "$unset" and s.spec == [name]
        if s.name in ("$group", "$count", "$sortByCount") or s.name == "$project" and any(not isinstance(v, (bool, int, float)) or v for k, v in s.spec.items() if k != "_id"):
            return True
    return False
