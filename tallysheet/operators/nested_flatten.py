"""Deeply nested records turned into related flat tables that keep parent-child links.

Method: a depth-first traversal gives every node of a record (the file, its pages, detections and
candidates, and every member, object, array and scalar below any of them) an interval label, its pre-order
and post-order number. Nodes go out as one row each with their type, and the tables per type are linked by
interval containment: a node's parent is the innermost interval around its own. The traversal has those
intervals open on its stack, so it writes the parent's label beside the node's, and no file is gathered or
sorted again however large it is. Ancestors of any type are found by ``pre`` and ``post`` alone.

Pages are nodes of their own also where a file names them only by a number in each detection.

Defined results: NULL, empty or invalid bodies give no rows; NULL entries take a position but are no
nodes; absent or NULL ``candidates`` give no rows; repeated files are read once; an empty table gives
empty results; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.operators.schema_drift import _batch, _detection_arrays, _files, _number, _string, json_type, matched_files, matches_of, pages_member, parse, walk

NODE_SCHEMA = "file_id bigint, kind string, pre int, post int, parent_pre int, depth int, page_index int, det_index int, position int, member string, json_type string, value string, cls string, tag string, tag_method string, score double"
_ARROW = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("pre", pa.int32()), ("post", pa.int32()), ("parent_pre", pa.int32()), ("depth", pa.int32()), ("page_index", pa.int32()), ("det_index", pa.int32()), ("position", pa.int32()), ("member", pa.string()), ("json_type", pa.string()), ("value", pa.string()), ("cls", pa.string()), ("tag", pa.string()), ("tag_method", pa.string()), ("score", pa.float64())])
KINDS = ("file", "page", "detection", "candidate", "member")


class Labels:
    """Depth-first traversal of one record; ``out`` has the nodes of the wanted kinds."""

    def __init__(self, match: dict[str, str], only: Collection[str]):
        self.match, self.only = match, only
        self.members = "member" in only
        self.clock = 0
        self.stack: list[int] = []
        self.out: list[tuple] = []

    def open(self) -> int:
        self.stack.append(self.clock)
        self.clock += 1
        return self.clock - 1

    def close(self, kind: str, page: int | None, det: int | None, position: int | None, member: str | None = None, typed: str | None = None, value: str | None = None, known: tuple = (None, None, None, None)) -> None:
        pre = self.stack.pop()
        if kind in self.only:
            self.out.append((kind, pre, self.clock, self.stack[-1] if self.stack else None, len(self.stack), page, det, position, member, typed, value, *known))
        self.clock += 1

    def below(self, v: object, page: int | None, det: int | None, position: int, member: str | None) -> None:
        """Any value and all that stands below it."""
        if not self.members:
            self.clock += 2 * _nodes(v)
            return
        todo: list[tuple] = [(v, position, member)]
        while todo:  # an explicit stack: records may be nested as deep as the parser allows
            x = todo.pop()
            if len(x) == 2:
                self.close("member", page, det, *x[1])
                continue
            v, position, member = x
            self.open()
            text = None if v is None or isinstance(v, (dict, list)) else v if isinstance(v, str) else json.dumps(v)
            todo.append((None, (position, member, json_type(v), text)))
            children = [(y, i, k) for i, (k, y) in enumerate(v.items())] if isinstance(v, dict) else [(y, i, None) for i, y in enumerate(v)] if isinstance(v, list) else []
            todo += reversed(children)

    def detection(self, det: dict, page: int, at: int) -> None:
        self.open()
        known: dict[str, object] = {}
        for i, (k, x) in enumerate(det.items()):
            if k != "candidates":
                self.below(x, page, at, i, k)
            if (f := self.match.get(k)) and known.get(f) is None:
                known[f] = x
        cands = det.get("candidates")
        for c_at, c in enumerate(cands if isinstance(cands, list) else []):
            if c is None:
                continue
            self.open()
            if isinstance(c, dict):
                for i, (k, x) in enumerate(c.items()):
                    self.below(x, page, at, i, k)
            tag, score = (c.get("tag"), c.get("score")) if isinstance(c, dict) else (c, None)
            self.close("candidate", page, at, c_at, None, json_type(c), None, (None, _string(tag), None, _number(score)))
        self.close("detection", page, at, at, None, "object", None, (_string(known.get("cls")), _string(known.get("tag")), _string(known.get("tag_method")), _number(known.get("conf"))))

    def record(self, j: object) -> list[tuple]:
        pages: dict[int, tuple[list[dict], list[tuple[int, dict]]]] = {}
        for kind, page, at, v, entry in walk(j):
            entries, items = pages.setdefault(page, ([], []))
            if kind == "page" and entry is not None:
                entries.append(entry)
            elif kind == "item" and isinstance(v, dict):
                items.append((at, v))
        self.open()
        if isinstance(j, dict):
            own = pages_member(j)
            for i, (k, x) in enumerate(j.items()):
                if k != own or not pages:
                    self.below(x, None, None, i, k)
        for page, (entries, items) in pages.items():
            self.open()
            for e in entries:
                held = {id(a) for a in _detection_arrays(e)}
                for i, (k, x) in enumerate(e.items()):
                    if id(x) not in held:
                        self.below(x, page, None, i, k)
            for at, det in items:
                self.detection(det, page, at)
            self.close("page", page, None, page)
        self.close("file", None, None, None, None, json_type(j))
        return self.out


def _nodes(v: object) -> int:
    """How many nodes a value and all below it are."""
    n, todo = 0, [v]
    while todo:
        x = todo.pop()
        n += 1
        if isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return n


def label_nodes(j: object, match: dict[str, str], only: Collection[str] = KINDS) -> list[tuple]:
    """The nodes of the wanted kinds; labels count all nodes whatever is wanted."""
    return Labels(match, only).record(j)


def node_table(detections: DataFrame, only: Collection[str] = KINDS) -> DataFrame:
    """Every node as one row with its interval label and its parent's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for fid, body, told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                j = parse(body)
                if j is not None:
                    rows += [(fid, *node) for node in label_nodes(j, matches_of(j, told), only)]
            yield _batch(rows, _ARROW)

    return matched_files(detections).mapInArrow(run, NODE_SCHEMA)


def flat_tables(detections: DataFrame) -> dict[str, DataFrame]:
    """files, pages, detections, candidates and members; each child row carries its parent's label."""
    of = lambda kind: node_table(detections, (kind,))
    label = ("file_id", "pre", "post", "parent_pre")
    return {
        "files": of("file").select("file_id", "pre", "post"),
        "pages": of("page").select(*label, "page_index"),
        "detections": of("detection").select(*label, "page_index", "det_index", "cls", "tag", "tag_method", F.col("score").alias("conf")),
        "candidates": of("candidate").select(*label, "page_index", "det_index", F.col("position").alias("cand_index"), "tag", "score"),
        "members": of("member").select(*label, "depth", "page_index", "det_index", "position", "member", "json_type", "value"),
    }


_POSITIONS = pa.schema([("file_id", pa.int64()), ("page_index", pa.int32()), ("det_index", pa.int32()), ("cand_index", pa.int32())])


def detection_positions(detections: DataFrame) -> DataFrame:
    """(file_id, page_index, det_index, cand_index): detections (cand_index -1) and their candidates.

    Positions need no field names, so the schemas are not compared here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for fid, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                j = parse(body)
                if j is not None:
                    rows += [(fid, n[5], n[6], -1 if n[0] == "detection" else n[7]) for n in label_nodes(j, {}, ("detection", "candidate"))]
            yield _batch(rows, _POSITIONS)

    return _files(detections).mapInArrow(run, "file_id bigint, page_index int, det_index int, cand_index int").distinct()
