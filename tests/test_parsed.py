import json

import pytest

from tesserae.operators.parsed import parsed_chunks


def place(page, left=0, top=800, origin=None, **more):
    return {"page_no": page, "bbox": {"l": left, "r": left + 100, "t": top, "b": top - 20} | ({"coord_origin": origin} if origin else {})} | more


DOCUMENT = {
    "pages": {"1": {"width": 1000.0, "height": 1000.0}, "3": {"width": None}},
    "items": [
        {"kind": "text", "label": "section_header", "text": "One", "prov": [place(1)]},
        {"kind": "text", "label": "paragraph", "text": "first", "prov": [place(1, 100), place(2)], "extra": {"deep": [1]}},
        {"kind": "text", "label": "text", "text": "  \n\t "},
        {"kind": "text", "label": "text", "text": "second", "prov": [place(1), {"page_no": 9}]},
        {"kind": "text", "label": "text", "text": "third", "prov": [place(2, origin="TOPLEFT")]},
        {"kind": "table", "rows": [["a", "b"], ["1", None]], "prov": [place(3, 2000, 5000)]},
        {"kind": "table", "rows": []},
        {"kind": "picture"},
        {"kind": "picture", "caption": "a view"},
        {"kind": "formula"},
        {"kind": "formula", "text": "x = 1"},
        {"kind": "text", "label": "title", "text": "Two"},
        {"kind": "text", "text": "no label"},
    ],
}


def test_rules(spark):
    rows = [("d", json.dumps(DOCUMENT), 1), ("broken", "{not json", 2), ("none", None, 3), ("empty", "{}", 4), ("blank", '{"items": []}', 5)]
    got = parsed_chunks(spark.createDataFrame(rows, "id string, parsed string, text int")).orderBy("order").collect()
    assert {r.id for r in got} == {"d"}
    assert [(r.order, r.text, r.element_type, r.chapter, r.physical_page, r.paragraph_number) for r in got] == [
        (0, "One", "section_header", "One", 1, None),
        (1, "first", "paragraph", "One", 2, 1),  # the last place counts
        (3, "second", "text", "One", 1, 1),  # a place without a box is none
        (4, "third", "text", "One", 2, 2),
        (5, "| a | b |\n| --- | --- |\n| 1 |  |", "table", "One", 3, None),
        (7, "[Picture 7]", "picture", "One", 0, None),
        (8, "a view", "picture", "One", 0, None),
        (10, "x = 1", "formula", "One", 0, None),
        (11, "Two", "title", "Two", 0, None),
        (12, "no label", "text", "Two", 0, 1),
    ]
    at = {r.order: r.positions for r in got}
    assert at[0] == [[1.0, 0.0, 0.1, pytest.approx(0.2), pytest.approx(0.22)]]
    assert at[1][1] == [2.0, 0.0, pytest.approx(100 / 595), pytest.approx(42 / 842), pytest.approx(62 / 842)]  # A4 without a size
    assert at[4][0][3:] == [pytest.approx(780 / 842), pytest.approx(800 / 842)]
    assert at[5] == [[3.0, 1.0, 1.0, 0.0, 0.0]]  # clamped
    assert at[7] == []


def test_json_is_read_once_a_document(spark):
    docs = spark.createDataFrame([("a", json.dumps(DOCUMENT))], "id string, parsed string")
    plan = parsed_chunks(docs)._jdf.queryExecution().optimizedPlan().toString()
    before, after = plan.split("Generate ")
    assert "$.pages" in after and "$.pages" not in before
