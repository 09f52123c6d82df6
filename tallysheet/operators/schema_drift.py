"""Schemas that drift between files: one consistent table and a report of each change.

Method: similarity flooding. The base schema and a file's own schema are turned into labelled
graphs of levels, fields, JSON types, value kinds, nested members, the order of fields and the order of
numbers (x1 < x2). Pairs of nodes start with a similarity of their names (words, synonyms, spelling),
which is then propagated along equally labelled edges until it converges. From the converged scores
consistent correspondences are selected per level (greedy by score, one base field per name; two names
may share a base field only when no object holds both).

A name need not resemble the base field's: any name whose values fit a vacant base field is a
candidate. Whether such a name is a rename or a field of its own is told by the corpus: a name that
stands beside the base field in objects of other files is a field of its own. So files are surveyed in
one pass that gives the changes of every file without such doubts, the counts of names beside base fields,
and the schemas in doubt; only the latter are joined with the counts and flooded again.

Bodies are parsed once, in Arrow batches; files with the same schema signature share one flooding
run (memo per worker), so the cost of the fixpoint follows the number of distinct schemas.

Defined results: NULL, empty, cut-off or otherwise invalid bodies give no rows; NULL entries hold
their position; repeated rows are read once (by ``file_id``); of two arrays of detections in one entry
both are read, each with its own positions; an empty table gives empty results; extra columns are
ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.session import written

# The base shape, level -> field -> JSON type.
BASE = {
    "top": {"pdf": "string", "dpi": "number", "funnel": "object", "tag_diagnostics": "object", "pages": "object"},
    "entry": {},
    "det": {"cls": "string", "tag": "string", "tag_method": "string", "untagged_reason": "string", "conf": "number", "x1": "number", "y1": "number", "x2": "number", "y2": "number"},
}
# Kinds of values of the base fields, and nested members seen below them.
BASE_KINDS = {
    "pdf": ("path", "{name", "{size_mb"),
    "dpi": ("count", "numtext"),
    "funnel": ("{schedule_tags", "{detections", "{tagged"),
    "tag_diagnostics": ("{totals", "{by_class"),
    "pages": ("pagemap",),
    "cls": ("caps", "{name", "{family"),
    "tag": ("mark", "null", "list"),
    "tag_method": ("snake", "null", "{name", "{level"),
    "untagged_reason": ("snake", "null", "count"),
    "conf": ("unit", "numtext"),
    "x1": ("big", "numtext"),
    "y1": ("big", "numtext"),
    "x2": ("big", "numtext"),
    "y2": ("big", "numtext"),
}
# Words that mean the same in names.
SYNONYMS = {
    "pdf": ("pdf", "file", "path", "document", "plan", "source", "filename"),
    "dpi": ("dpi", "resolution", "res", "ppi"),
    "funnel": ("funnel", "counts", "count", "totals", "summary"),
    "tag_diagnostics": ("tag", "diagnostics", "diag", "diagnosis"),
    "pages": ("pages", "sheets", "page", "sheet"),
    "cls": ("cls", "class", "label", "category", "name", "klass", "type"),
    "tag": ("tag", "mark", "equip", "equipment", "symbol", "id"),
    "tag_method": ("tag", "method", "source", "how"),
    "untagged_reason": ("untagged", "reason", "why"),
    "conf": ("conf", "confidence", "score", "prob", "probability"),
    "x1": ("x1", "xmin", "left", "x0", "minx"),
    "y1": ("y1", "ymin", "top", "y0", "miny"),
    "x2": ("x2", "xmax", "right", "maxx"),
    "y2": ("y2", "ymax", "bottom", "maxy"),
}
NESTED = {k for kinds in BASE_KINDS.values() for k in kinds if k[0] == "{"}
ASCENDING = (("x1", "x2"), ("y1", "y2"))  # base fields whose values stand in this order
_ORDERED = {f for p in ASCENDING for f in p}
LISTED = 0.5  # similarity from which a name alone speaks for a base field
BESIDE = 0.01  # share of its objects in which a name beside a base field is a field of its own
CONTAINER_NAMES = {"page", "detections", "candidates"}  # named by the task: never a base field

_MARK = re.compile(r"^[A-Za-z]{1,5}-?[A-Za-z]?\d+[A-Za-z]?$")
_SNAKE = re.compile(r"^[a-z]+(_[a-z0-9]+)*$")
_CAPS = re.compile(r"^[A-Z0-9][A-Z0-9 /\-\"'.&]*$")
_NUM = re.compile(r"^-?\d+(\.\d+)?$")


def json_type(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def _kind(v: object) -> str:
    if isinstance(v, bool):
        return "flag"
    if isinstance(v, (int, float)):
        return "unit" if isinstance(v, float) and 0 <= v <= 1 else "count" if isinstance(v, int) else "big"
    if isinstance(v, str):
        if _NUM.match(v):
            return "numtext"
        if "/" in v and "." in v or v.lower().endswith(".pdf"):
            return "path"
        if _MARK.match(v):
            return "mark"
        if _SNAKE.match(v):
            return "snake"
        return "caps" if _CAPS.match(v) else "text"
    return "list" if isinstance(v, list) else "null"


@lru_cache(maxsize=50_000)
def _string_kind(v: str) -> str:
    return _kind(v)


def parse(body: str | None) -> object | None:
    """The JSON value of a body (object or array); None when it is not valid JSON."""
    if not body or not body.strip():
        return None
    try:
        j = json.loads(body)
    except (ValueError, RecursionError):
        return None
    return j if isinstance(j, (dict, list)) else None


def _pages_like(v: object) -> bool:
    if isinstance(v, dict):
        return bool(v) and all(re.fullmatch(r"\d+", k) for k in v) and all(isinstance(x, (list, dict)) or x is None for x in v.values())
    return isinstance(v, list) and any(isinstance(x, (list, dict)) for x in v)


def pages_member(j: dict) -> str | None:
    """The name of the top-level member that carries the pages, under any name."""
    if "pages" in j:
        return "pages"
    for k, v in j.items():
        if _pages_like(v):
            return k
    for k in ("sheets",):
        if k in j:
            return k
    return None


def walk(j: object) -> Iterator[tuple[str, int, int, object, dict | None]]:
    """(kind, page_index, position, value, entry) of pages, their entries and items of detection arrays.

    A page comes with its entry in the last place, if it has one. kind is ``page``, ``entry`` (an object that wraps a page's detections) or ``item``. Page numbers as
    keys count from 0, a member ``page`` from 1, positions in an array of pages from 0.
    """
    pages = j if isinstance(j, list) else j.get(pages_member(j)) if isinstance(j, dict) else None
    if isinstance(pages, dict):
        for at, (k, v) in enumerate(pages.items()):
            yield from _entry(int(k) if re.fullmatch(r"\d+", k) else at, v)
    elif isinstance(pages, list):
        flat = [x for x in pages if isinstance(x, dict) and not _wraps(x)]
        for at, v in enumerate(pages):
            if isinstance(v, dict):
                n = v.get("page")
                page = int(n) - 1 if isinstance(n, int) and not isinstance(n, bool) or isinstance(n, str) and n.isdigit() else at
                if _wraps(v):
                    yield from _entry(page, v)
                else:
                    yield "item", page, at, v, None
            elif isinstance(v, list):
                yield from _entry(at, v)
            elif flat:
                yield "item", at, at, v, None


_LIKE: dict[tuple, bool] = {}


def _detection_like(v: dict) -> bool:
    """Whether an object has the shape of a detection: names of three base fields, or four numbers."""
    key = tuple(v)
    if key not in _LIKE:
        if len(_LIKE) > 20_000:
            _LIKE.clear()
        explained = {f for k in key for f in BASE["det"] if name_similarity(f, k) >= LISTED}
        _LIKE[key] = len(explained) >= 3
    return _LIKE[key] or sum(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v.values()) >= 4


def _objects(x: object) -> bool:
    """An array that holds nothing but objects and NULLs."""
    return isinstance(x, list) and all(i is None or isinstance(i, dict) for i in x)


def _detection_arrays(v: dict) -> list[list]:
    """The arrays of an entry that hold detections, by name or by the shape of what they hold."""
    arrays = {k: x for k, x in v.items() if k != "candidates" and _objects(x)}
    named = [v["detections"]] if isinstance(v.get("detections"), list) else []
    shaped = [x for k, x in arrays.items() if k != "detections" and any(i and _detection_like(i) for i in x)]
    return named + shaped or list(arrays.values())


def _wraps(v: dict) -> bool:
    """An entry of pages that holds its detections in an array, and is no detection itself."""
    return isinstance(v.get("detections"), list) or (any(k != "candidates" and _objects(x) for k, x in v.items()) and not _detection_like(v))


def _entry(page: int, v: object) -> Iterator[tuple[str, int, int, object, dict | None]]:
    yield "page", page, -1, None, v if isinstance(v, dict) else None
    if isinstance(v, list):
        for at, x in enumerate(v):
            yield "item", page, at, x, None
    elif isinstance(v, dict):
        yield "entry", page, -1, v, None
        for arr in _detection_arrays(v):
            for at, x in enumerate(arr):
                yield "item", page, at, x, v


def describe(j: object) -> dict:
    """The schema of one file: level -> name -> (types, kinds and nested members), and what stands together."""
    levels: dict[str, dict[str, tuple[set, set]]] = {"top": {}, "entry": {}, "det": {}}
    together: dict[str, set[tuple[str, str]]] = {"top": set(), "det": set()}
    follows: dict[str, set[tuple[str, str]]] = {"top": set(), "det": set()}
    less: dict[tuple[str, str], bool] = {}

    seen: set[tuple] = set()

    def note(level: str, o: dict) -> None:
        fields = levels[level]
        for k, v in o.items():
            got = fields.get(k)
            if got is None:
                got = fields[k] = (set(), set())
            t = type(v)
            if t is float:
                got[0].add("number")
                got[1].add("unit" if 0 <= v <= 1 else "big")
            elif t is str:
                got[0].add("string")
                got[1].add(_string_kind(v) if len(v) < 64 else _kind(v))
            else:
                got[0].add(json_type(v))
                if t is dict:
                    got[1].add("pagemap") if level == "top" and _pages_like(v) else got[1].update(NESTED & {"{" + x for x in v} or {"{"})
                elif level == "top" and _pages_like(v):
                    got[1].add("pagemap")
                else:
                    got[1].add(_kind(v))
        if level == "entry":
            return
        names = tuple(o)
        strange = [k for k in names if k not in BASE[level] and k not in CONTAINER_NAMES and not _listed(level, k)]
        if names not in seen:
            seen.add(names)
            own = [k for k in names if k not in BASE[level]]
            together[level].update((min(a, b), max(a, b)) for a in own for b in names if a != b and _rivals(level, a, b))
        if strange:
            numbers = {k: v for k, v in o.items() if isinstance(v, (int, float)) and not isinstance(v, bool)}
            for a in numbers:
                for b in numbers:
                    if a != b and (a in strange or b in strange) and all(x in strange or x in _ORDERED for x in (a, b)):
                        less[a, b] = less.get((a, b), True) and numbers[a] < numbers[b]
            # several nameless numbers at once (a box): their place in the object tells them apart
            if level == "det" and sum(k in numbers for k in strange) >= 3:
                follows[level].update(p for p in zip(names, names[1:], strict=False) if p[0] in strange or p[1] in strange)

    if isinstance(j, dict):
        note("top", j)
    dets = 0
    for kind, _, _, v, _ in walk(j):
        if kind == "entry":
            note("entry", v)
        elif isinstance(v, dict):
            dets += 1
            note("det", v)
    p = pages_member(j) if isinstance(j, dict) else None
    container = j.get(p) if p else None
    plain = isinstance(container, dict) and all(isinstance(x, list) for x in container.values())
    return {
        # a base field's own name settles it: only the kinds of other names are evidence
        "levels": {lv: {k: [sorted(t - {"null"}), [] if k in BASE[lv] else sorted(s - {"null"})] for k, (t, s) in sorted(fs.items())} for lv, fs in levels.items()},
        "together": {lv: sorted(map(list, ps)) for lv, ps in together.items()},
        "follows": {lv: sorted(map(list, ps)) for lv, ps in follows.items()},
        "less": sorted([a, b] for (a, b), ok in less.items() if ok),
        "array": isinstance(j, list),
        "dets": dets > 0,
        "plain": plain,
        "pages": p,
        "pages_null": p is not None and container is None,
    }


def signature(d: dict) -> str:
    return json.dumps(d, separators=(",", ":"))


def _tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()) if t]


@cache
def _spelling(base: str, whole: str) -> float:
    return max(SequenceMatcher(None, w, whole).ratio() for w in SYNONYMS[base])


_NAMES: dict[tuple[str, str], float] = {}


def name_similarity(base: str, name: str) -> float:
    """1 for equal names; from LISTED on the share of the name's words that the base field's words explain;
    below it how alike the spellings are."""
    got = _NAMES.get((base, name))
    if got is None:
        if len(_NAMES) > 200_000:
            _NAMES.clear()
        got = _NAMES[base, name] = _name_similarity(base, name)
    return got


def _name_similarity(base: str, name: str) -> float:
    if base == name:
        return 1.0
    own, words = _tokens(name), SYNONYMS[base]
    whole = "".join(own)
    if whole in words:
        return 0.9
    hits = sum(t in words for t in own)
    share = 0.85 * hits / max(1, len(own)) if own else 0.0
    return share if share >= LISTED else max(share, 0.45 * _spelling(base, whole[:40]) if whole else 0.0)


@lru_cache(maxsize=50_000)
def _speaks_for(level: str, name: str) -> frozenset[str]:
    """The base fields of a level that the name alone speaks for."""
    return frozenset(f for f in BASE[level] if name_similarity(f, name) >= LISTED)


def _listed(level: str, name: str) -> bool:
    return bool(_speaks_for(level, name))


@lru_cache(maxsize=200_000)
def _rivals(level: str, a: str, b: str) -> bool:
    """Whether two names may claim one base field; a name that speaks for none may claim any."""
    x, y = _speaks_for(level, a), _speaks_for(level, b)
    return not x or not y or bool(x & y)


def _names_another(level: str, base: str, name: str) -> bool:
    """A name of several words one of which is another base field's own name speaks of that field."""
    own = _tokens(name)
    return len(own) > 1 and any(t in BASE[level] and t != base for t in own)


def flood(d: dict, beside: dict[tuple[str, str], set[str]] | None = None, rounds: int = 40, eps: float = 1e-4) -> dict[str, dict[str, str]]:
    """Level -> name -> base field, by similarity flooding between the base schema and a file's.

    ``beside``: (level, name) -> base fields that the corpus shows beside the name; such a name is none of them.
    """
    beside = beside or {}

    def edges(levels: dict, follows: dict, less: list) -> list[tuple[str, str, str]]:
        out = []
        for lv, fields in levels.items():
            for name, (types, kinds) in fields.items():
                node = f"{lv}.{name}"
                out.append((f"@{lv}", "field", node))
                out += [(node, "type", f"#{t}") for t in types if t != "null"]
                out += [(node, "kind", f"%{k}") for k in kinds if k != "null"]
            out += [(f"{lv}.{x}", "next", f"{lv}.{y}") for x, y in follows.get(lv, ()) if x in fields and y in fields]
        return out + [(f"det.{x}", "less", f"det.{y}") for x, y in less if x in levels["det"] and y in levels["det"]]

    base_levels = {lv: {f: ({t}, set(BASE_KINDS[f])) for f, t in fs.items()} for lv, fs in BASE.items()}
    file_levels = {lv: {k: v for k, v in fs.items() if k not in CONTAINER_NAMES or k in BASE.get(lv, {})} for lv, fs in d["levels"].items()}
    in_order = {lv: list(zip(list(fs), list(fs)[1:], strict=False)) for lv, fs in BASE.items()}
    strange = any(d["follows"].values())
    ea = edges(base_levels, in_order if strange else {}, list(ASCENDING) if strange else [])
    eb = edges(file_levels, d["follows"], d["less"])
    by = defaultdict(list)
    for s, lb, t in eb:
        by[lb].append((s, t))
    index: dict[tuple[str, str], int] = {}
    links: list[tuple[int, int]] = []
    labelled: list[int] = []

    def pair(a: str, b: str) -> int:
        return index.setdefault((a, b), len(index))

    for s, lb, t in ea:
        for s2, t2 in by[lb]:
            if lb == "field" and s != s2:
                continue
            if lb in ("type", "kind") and t != t2:
                continue
            if lb == "next" and s.split(".")[0] != s2.split(".")[0]:
                continue
            links.append((pair(s, s2), pair(t, t2)))
            labelled.append(("field", "type", "kind", "next", "less").index(lb))
    if not links:
        return {lv: {} for lv in d["levels"]}
    start = np.zeros(len(index))
    for (a, b), i in index.items():
        if a[0] in "@#%":
            start[i] = 1.0 if a == b else 0.0
        else:
            start[i] = name_similarity(a.split(".", 1)[1], b.split(".", 1)[1])
    u, v = np.array(links).T
    both = np.concatenate([u, v]), np.concatenate([v, u])
    # propagation coefficients: a pair spreads its similarity evenly over its links of one label and direction
    labels = np.array(labelled)
    key = np.concatenate([u * 10 + labels, v * 10 + 5 + labels])
    counts = np.bincount(key, minlength=len(index) * 10)
    weight = 1.0 / counts[key]
    sim = start.copy()
    for _ in range(rounds):
        nxt = start + sim + np.bincount(both[1], weights=weight * sim[both[0]], minlength=len(index))
        nxt /= nxt.max()
        if np.abs(nxt - sim).max() < eps:
            sim = nxt
            break
        sim = nxt
    chosen: dict[str, dict[str, str]] = {lv: {} for lv in d["levels"]}
    together = {lv: {tuple(p) for p in ps} for lv, ps in d["together"].items()}
    per_level = defaultdict(list)
    for (a, b), i in index.items():
        if a[0] not in "@#%":
            lv, name = b.split(".", 1)
            if a.split(".", 1)[0] == lv:
                named = start[i]
                per_level[lv].append((named == 1.0, named >= LISTED, start[i] + sim[i], a.split(".", 1)[1], name))
    for lv, cands in per_level.items():
        for exact, listed, _, base, name in sorted(cands, key=lambda c: (not c[0], not c[1], -c[2], c[3], c[4])):
            if name in chosen[lv] or (not exact and name in BASE[lv]):
                continue
            rivals = [n for n, f in chosen[lv].items() if f == base]
            if rivals and (lv != "det" or any((min(n, name), max(n, name)) in together[lv] for n in rivals)):
                continue
            if not exact and not _fits(base, d["levels"][lv][name]):
                continue
            if not exact and not listed:
                kinds = set(d["levels"][lv][name][1]) - {"null"}
                if not kinds or rivals or base in beside.get((lv, name), ()) or _names_another(lv, base, name):
                    continue
            chosen[lv][name] = base
    return chosen


def _fits(base: str, shape: list) -> bool:
    """A renamed field must hold a kind of value that the base field is known to hold."""
    kinds = set(shape[1]) - {"null"}
    return not kinds or bool(kinds & set(BASE_KINDS[base])) or (base in ("x1", "y1", "x2", "y2") and "count" in kinds)


def doubts(d: dict, match: dict[str, dict[str, str]]) -> list[tuple[str, str]]:
    """(level, name) of all names that may be renames by more than their name, if any is taken for one."""
    if all(name_similarity(f, n) >= LISTED for m in match.values() for n, f in m.items()):
        return []
    return [(lv, n) for lv in BASE for n in d["levels"][lv] if n not in BASE[lv] and n not in CONTAINER_NAMES and not _listed(lv, n)]


def changes(d: dict, match: dict[str, dict[str, str]]) -> list[tuple[str, str]]:
    """The (field_name, change_kind) rows of a file with this schema."""
    out = set()
    for lv, fields in BASE.items():
        if lv == "top" and d["array"]:
            out |= {(f, "removed") for f in fields}
            continue
        if lv == "det" and not d["dets"]:
            continue
        carried = set(match[lv].values())
        out |= {(f, "removed") for f in fields if f not in carried}
        for name, (types, _) in d["levels"][lv].items():
            base = match[lv].get(name)
            if base is None:
                out.add((name, "added"))
                continue
            if base != name:
                out.add((base, "renamed"))
            if lv == "top" and base == "pages":
                if not d["plain"] and not d["pages_null"]:
                    out.add(("pages", "retyped"))
            elif set(types) - {"null", fields[base]}:
                out.add((base, "retyped"))
    for name in d["levels"]["entry"]:
        out.add((name, "added"))
    return sorted(out)


_MEMO: dict[str, tuple[dict, list, list]] = {}


def resolve(d: dict, key: str | None = None) -> tuple[dict[str, dict[str, str]], list[tuple[str, str]], list[tuple[str, str]]]:
    """Correspondences, changes and doubts of a schema; one flooding run per distinct schema and worker."""
    key = key or signature(d)
    if key not in _MEMO:
        if len(_MEMO) > 20_000:
            _MEMO.clear()
        match = flood(d)
        _MEMO[key] = (match, changes(d, match), doubts(d, match))
    return _MEMO[key]


def _files(detections: DataFrame) -> DataFrame:
    """Valid candidates, once per file; bodies that are NULL or blank never reach Python."""
    return detections.where("file_id is not null and body is not null and trim(body) <> ''").select("file_id", "body")


SURVEY = "what string, file_id bigint, name string, other string, n bigint, names array<string>"
_SURVEY = pa.schema([("what", pa.string()), ("file_id", pa.int64()), ("name", pa.string()), ("other", pa.string()), ("n", pa.int64()), ("names", pa.list_(pa.string()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def survey(detections: DataFrame) -> DataFrame:
    """One pass over all files: ``change`` rows (file_id, field, kind) of files without doubt, ``doubt`` rows
    (file_id, schema, level.name of the doubtful names) and ``beside`` counts (level.name, base field, objects;
    an empty base field counts all objects)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside: dict[tuple[str, str], int] = defaultdict(int)
        for b in batches:
            rows: list[tuple] = []
            for fid, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                j = parse(body)
                if j is None:
                    continue
                d = describe(j)
                key = signature(d)
                _, found, doubtful = resolve(d, key)
                if doubtful:
                    rows.append(("doubt", fid, key, None, None, [f"{lv}.{n}" for lv, n in doubtful]))
                else:
                    rows += [("change", fid, f, k, None, None) for f, k in found]
                for lv, pairs in d["together"].items():
                    strange = {n for n in d["levels"][lv] if n not in BASE[lv] and n not in CONTAINER_NAMES and not _listed(lv, n)}
                    for n in strange:
                        beside[f"{lv}.{n}", ""] += 1
                    for x, y in pairs:
                        for n, f in ((x, y), (y, x)):
                            if n in strange and f in BASE[lv]:
                                beside[f"{lv}.{n}", f] += 1
            if len(beside) > 50_000:
                rows += [("beside", None, n, f, c, None) for (n, f), c in beside.items()]
                beside.clear()
            yield _batch(rows, _SURVEY)
        yield _batch([("beside", None, n, f, c, None) for (n, f), c in beside.items()], _SURVEY)

    return written(_files(detections).mapInArrow(run, SURVEY), "drift-survey")


def settled(seen: DataFrame) -> DataFrame:
    """(file_id, schema, beside): the files in doubt with what the corpus says of their doubtful names,
    as texts ``level.name base``."""
    counts = seen.where("what = 'beside'").groupBy("name", "other").agg(F.sum("n").alias("n"))
    total = counts.where("other = ''").select("name", F.col("n").alias("total"))
    own = counts.where("other <> ''").join(total, "name").where(F.col("n") >= BESIDE * F.col("total")).groupBy("name").agg(F.collect_set("other").alias("bases"))  # base fields only
    doubt = seen.where("what = 'doubt'").select("file_id", F.col("name").alias("schema"), "names")
    facts = doubt.select("file_id", F.explode("names").alias("name")).distinct().join(own, "name").select("file_id", F.explode(F.transform("bases", lambda f: F.concat_ws(" ", F.col("name"), f))).alias("fact"))
    return doubt.drop("names").dropDuplicates(["file_id"]).join(facts.groupBy("file_id").agg(F.collect_set("fact").alias("beside")), "file_id", "left")


def _beside(facts: list[str] | None) -> dict[tuple[str, str], set[str]]:
    out: dict[tuple[str, str], set[str]] = defaultdict(set)
    for f in facts or []:
        where, base = f.rsplit(" ", 1)
        lv, name = where.split(".", 1)
        out[lv, name].add(base)
    return out


_AGAIN: dict[tuple, dict] = {}


def _resettle(schema: str, facts: list[str] | None) -> tuple[dict, dict]:
    """(schema, correspondences) of a schema in doubt with the corpus' word on it."""
    key = (schema, tuple(sorted(facts or [])))
    if key not in _AGAIN:
        if len(_AGAIN) > 20_000:
            _AGAIN.clear()
        _AGAIN[key] = flood(json.loads(schema), _beside(facts))
    return json.loads(schema), _AGAIN[key]


_CHANGE = pa.schema([("file_id", pa.int64()), ("field_name", pa.string()), ("change_kind", pa.string())])


def drift_report(detections: DataFrame) -> DataFrame:
    """(file_id, field_name, change_kind): every change of a file against the base shape."""
    seen = survey(detections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(fid, f, k) for fid, schema, facts in zip(*(c.to_pylist() for c in b.columns), strict=True) for f, k in changes(*_resettle(schema, facts))], _CHANGE)

    sure = seen.where("what = 'change'").select("file_id", F.col("name").alias("field_name"), F.col("other").alias("change_kind"))
    return sure.unionByName(settled(seen).mapInArrow(run, "file_id bigint, field_name string, change_kind string")).distinct()


def renames(detections: DataFrame) -> DataFrame:
    """(file_id, match): the correspondences of detection fields of the files in doubt, as JSON."""
    schema = pa.schema([("file_id", pa.int64()), ("match", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([(fid, json.dumps(_resettle(s, facts)[1]["det"])) for fid, s, facts in zip(*(c.to_pylist() for c in b.columns), strict=True)], schema)

    return settled(survey(detections)).mapInArrow(run, "file_id bigint, match string")


def matched_files(detections: DataFrame) -> DataFrame:
    """(file_id, body, match) once per file; match is NULL where the file's own schema settles it."""
    return _files(detections).dropDuplicates(["file_id"]).join(renames(detections), "file_id", "left")


def matches_of(j: object, match: str | None) -> dict[str, str]:
    """Name -> base field of a file's detections."""
    return resolve(describe(j))[0]["det"] if match is None else json.loads(match)


def _number(v: object) -> float | None:
    if isinstance(v, bool) or v is None:
        return None
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _string(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, dict):
        return v.get("name") if isinstance(v.get("name"), str) else json.dumps(v, sort_keys=True)
    if isinstance(v, list):
        return _string(v[0]) if len(v) == 1 else json.dumps(v) if v else None
    return str(v)


DETECTION_SCHEMA = "file_id bigint, page_index int, det_index int, cls string, tag string, tag_method string, untagged_reason string, conf double, x1 double, y1 double, x2 double, y2 double"
_TEXT, _NUMS = ("cls", "tag", "tag_method", "untagged_reason"), ("conf", "x1", "y1", "x2", "y2")


def unified_detections(detections: DataFrame) -> DataFrame:
    """All detections of all files in the base shape, cast and unioned; one row per detection."""
    schema = pa.schema([("file_id", pa.int64()), ("page_index", pa.int32()), ("det_index", pa.int32()), *((c, pa.string()) for c in _TEXT), *((c, pa.float64()) for c in _NUMS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for fid, body, told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                j = parse(body)
                if j is None:
                    continue
                match = matches_of(j, told)
                for kind, page, at, v, _ in walk(j):
                    if kind != "item" or not isinstance(v, dict):
                        continue
                    row: dict[str, object] = {}
                    for k, x in v.items():
                        if (f := match.get(k)) and row.get(f) is None:
                            row[f] = x
                    for c, x in zip(cols, (fid, page, at, *(_string(row.get(f)) for f in _TEXT), *(_number(row.get(f)) for f in _NUMS)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return matched_files(detections).mapInArrow(run, DETECTION_SCHEMA)


def change_totals(detections: DataFrame) -> DataFrame:
    """How many files show each change."""
    return drift_report(detections).groupBy("field_name", "change_kind").agg(F.count("*").alias("files"))
