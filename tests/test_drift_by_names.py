"""The drift report against a plain reading of the bodies with the names known for these test tables."""

import json
import os

import pyarrow.parquet as pq
import pytest

from tallysheet.operators.schema_drift import drift_report

PATH = "/root/testdata/sf0.001/detections.parquet"
TOP = {"pdf": ({"pdf", "pdf_path", "file"}, str), "dpi": ({"dpi", "resolution"}, (int, float)), "funnel": ({"funnel", "counts"}, dict), "tag_diagnostics": ({"tag_diagnostics"}, dict), "pages": ({"pages", "sheets"}, dict)}
NUM = (int, float)
DET = {
    "cls": ({"cls", "class", "label", "cls_name"}, str), "tag": ({"tag", "mark", "equip_tag"}, str), "tag_method": ({"tag_method", "method", "tag_source"}, str), "untagged_reason": ({"untagged_reason", "reason", "why_untagged"}, str), "conf": ({"conf", "confidence", "score"}, NUM),
    "x1": ({"x1", "xmin", "left"}, NUM), "y1": ({"y1", "ymin", "top"}, NUM), "x2": ({"x2", "xmax", "right"}, NUM), "y2": ({"y2", "ymax", "bottom"}, NUM),
}


def level(objects, fields, skip=()):
    out = set()
    for f, (names, kind) in fields.items():
        held = [(k, v) for o in objects for k, v in o.items() if k in names]
        if not held:
            out.add((f, "removed"))
        if any(k != f for k, _ in held):
            out.add((f, "renamed"))
        if f not in skip and any(v is not None and (not isinstance(v, kind) or isinstance(v, bool)) for _, v in held):
            out.add((f, "retyped"))
    known = set().union(*(n for n, _ in fields.values()))
    return out | {(k, "added") for o in objects for k in o if k not in known}


def expected(j):
    out, dets = set(), []
    if isinstance(j, list):
        out |= {(f, "removed") for f in TOP}
        pages = j
    else:
        out |= level([j], TOP, skip=("pages",))
        pages = next((j[k] for k in ("pages", "sheets") if k in j), None)
        if pages is not None and not (isinstance(pages, dict) and all(isinstance(v, list) for v in pages.values())):
            out.add(("pages", "retyped"))
    for v in pages.values() if isinstance(pages, dict) else pages or []:
        if isinstance(v, list):
            dets += v
        elif isinstance(v, dict) and isinstance(v.get("detections"), list):
            out |= {(k, "added") for k in v}
            dets += v["detections"]
        elif isinstance(v, dict):
            dets.append(v)
    dets = [d for d in dets if isinstance(d, dict)]
    return out | (level(dets, DET) if dets else set())


@pytest.mark.skipif(not os.path.isfile(PATH), reason="no test tables here")
def test_report_equals_a_plain_reading(spark):
    want = set()
    for r in pq.read_table(PATH, columns=["file_id", "body"]).to_pylist():
        try:
            j = json.loads(r["body"])
        except (TypeError, ValueError):
            continue
        want |= {(r["file_id"], *c) for c in expected(j)}
    got = {tuple(r) for r in drift_report(spark.read.parquet(PATH)).collect()}
    assert got == want
