"""Each code of the objects, structure flags and tables of tagged documents, firing and not firing."""

from tessella.operators import pdf_objects as po

OBJECTS = "doc long, object string, kind string, id string, name string, has_state boolean, file_name string, unicode_name string, content string, permissions long, subtype string, code int, n int"


def _o(spark, *rows):
    names = [c.split()[0] for c in OBJECTS.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], OBJECTS)


def test_objects(spark):
    right = [
        {"kind": "note", "id": "a"}, {"kind": "note", "id": "b"}, {"kind": "layers", "name": "l", "has_state": False}, {"kind": "default-layers", "name": "d"},
        {"kind": "attachment", "unicode_name": "u"}, {"kind": "attachment", "file_name": "f"}, {"kind": "form-config", "content": "<dynamicRender>forbidden</dynamicRender>"},
        {"kind": "encryption", "permissions": -1340}, {"kind": "xobject", "subtype": "Form"}, {"kind": "xobject"}, {"kind": None}, {"kind": "other"}, {"kind": "form-config"},
    ]
    assert po.check_objects(_o(spark, *[{"doc": 1, "object": f"o{i}", **r} for i, r in enumerate(right)]), ["doc"]).count() == 0
    wrong = [
        ({"kind": "note", "id": " "}, "19-003"), ({"kind": "note"}, "19-003"), ({"kind": "layers", "name": "", "has_state": True}, "20-001"), ({"kind": "default-layers"}, "20-002"),
        ({"kind": "default-layers", "name": "x", "has_state": True}, "20-003"), ({"kind": "attachment"}, "21-001"), ({"kind": "form-config", "content": "a<dynamicRender> required </dynamicRender>"}, "25-001"),
        ({"kind": "encryption"}, "26-001"), ({"kind": "encryption", "permissions": -3904 & ~512}, "26-002"), ({"kind": "xobject", "subtype": "Reference"}, "30-001"),
    ]
    rows = [{"doc": 2, "object": f"o{i}", **r} for i, (r, _) in enumerate(wrong)]
    notes = [{"doc": 2, "object": f"n{i}", "kind": "note", "id": "same"} for i in range(3)] + [{"doc": d, "object": "m", "kind": "note", "id": "same"} for d in (3, None)]
    got = sorted((r["doc"], r["object"], r["code"], r["n"]) for r in po.check_objects(_o(spark, *rows, *notes), ["doc"]).collect())
    want = [(2, f"o{i}", c, 1) for i, (_, c) in enumerate(wrong)] + [(2, "o2", "20-003", 1), (2, "n0", "19-004", 3)]
    assert got == sorted(want)
    assert po.check_objects(_o(spark, *rows).limit(0), ["doc"]).count() == 0


def test_structure(spark):
    f = spark.createDataFrame([(1, True, True, True, 3), (2, False, True, False, 3), (3, None, None, None, None), (4, True, False, True, 9), (5, None, False, True, 0), (6, None, None, None, 1)], "id long, tagged boolean, suspect boolean, logical_order boolean, lists int")
    assert sorted(map(tuple, po.check_structure(f, ["id"]).collect())) == [(1, "01-004"), (2, "12-001"), (2, "LIST-NOT-TAGGED"), (6, "LIST-NOT-TAGGED")]


def test_tables(spark):
    names = "id long, file_tagged boolean, tagged boolean, n_rows long, n_columns long, header_row boolean, header_column boolean, scoped boolean, irregular boolean, summary string, caption string"
    rows = {
        1: ((True, True, 6, 6, True, True, True, False, "s", None), []),
        2: ((True, False, 4, 3, True, False, True, False, None, None), ["15-001"]),
        3: ((True, True, 6, 6, False, False, True, False, None, "c"), ["15-002"]),
        4: ((True, True, 6, 6, False, False, True, False, "s", None), ["15-002"]),
        5: ((True, True, 5, 5, True, False, None, False, "s", None), ["TABLE-HEADERS-INCOMPLETE"]),
        6: ((True, True, 5, 5, False, True, True, False, "s", None), ["TABLE-HEADERS-INCOMPLETE"]),
        7: ((True, True, 4, 2, True, False, False, False, "s", None), ["15-004"]),
        8: ((False, None, 4, 2, True, False, False, False, "s", None), []),
        9: ((True, True, 3, 3, True, False, False, True, "s", None), ["15-003"]),
        10: ((True, True, 3, 1, False, False, None, True, None, None), ["15-005"]),
        11: ((False, True, 3, 1, False, False, None, True, None, None), []),
        12: ((True, True, 2, 5, True, True, True, False, " ", ""), ["TABLE-MISSING-SUMMARY"]),
        13: ((None, None, 2, 2, None, None, None, None, None, None), []),
    }
    t = spark.createDataFrame([(i, *r) for i, (r, _) in rows.items()], names)
    got = sorted(map(tuple, po.check_table_shapes(t, ["id"]).collect()))
    # 13 has 20 points for no headers and 15 for its size: layout, in a file without tags
    assert got == sorted((i, c) for i, (_, cs) in rows.items() for c in cs)


def test_facts(spark):
    cells = [(1, 0, c, True) for c in range(3)] + [(1, r, c, c == 0) for r in (1, 2) for c in range(3)] + [(2, 5, 1, True), (2, 5, 0, None), (2, 7, 0, True), (3, 0, 0, False)]
    got = {r["k"]: tuple(r)[1:] for r in po.table_facts(spark.createDataFrame(cells, "k long, row_no int, column_no int, header boolean"), ["k"]).collect()}
    assert got == {1: (3, 3, True, True, False), 2: (2, 2, False, False, True), 3: (1, 1, False, False, False)}
