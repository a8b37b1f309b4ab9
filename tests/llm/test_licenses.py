from weirflow.llm import license_scan as ls
from weirflow.llm.queries import QUERIES


def scanned(spark, rows):
    return {r["fid"]: (r["license"], r["origin"], r["folder"]) for r in ls.scan(spark.createDataFrame(rows, "fid long, path string, text string")).collect()}


def test_nearest_directory_gives_its_license(spark):
    code = "def f():\n    return 1\n" * 20
    found = scanned(spark, [
        (1, "LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction\n"),
        (2, "a.py", code),
        (3, "lib/b.py", code),
        (4, "lib/deep/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (5, "lib/deep/er/c.py", code),
        (6, "lib/deep/er/d.py", "# Licensed under the Apache License, Version 2.0.\n" + code),
        (7, "lib/deeper/e.py", code),
        (8, None, code),
        (9, "x/y.py", None),
        (None, "x/z.py", "SPDX-License-Identifier: MIT"),
    ])
    assert found == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", ""), 3: ("MIT", "inherited", ""), 4: ("GPL-3.0", "own", None),
        5: ("GPL-3.0", "inherited", "lib/deep"), 6: ("Apache-2.0", "own", None), 7: ("MIT", "inherited", ""), 8: (None, None, None),
        9: ("MIT", "inherited", ""), None: ("MIT", "inherited", ""),
    }


def test_no_license_anywhere_ties_and_repeats(spark):
    rows = [(1, "a/b", "plain"), (1, "a/b", "plain"), (2, "", "licence unknown to anyone at all here")]
    df = spark.createDataFrame(rows, "fid long, path string, text string")
    assert sorted((r["fid"], r["license"]) for r in ls.scan(df).collect()) == [(1, None), (1, None), (2, None)]
    assert ls.scan(df.where("false")).count() == 0


def test_no_python_on_the_main_path(spark, data):
    plan = QUERIES["op6_license_scan"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_templates_find_themselves(spark):
    found = scanned(spark, [(i, f"d{i}/f", f"code\n// {t}\ncode") for i, (_, t) in enumerate(ls.TEMPLATES)])
    assert [found[i][0] for i in range(len(ls.TEMPLATES))] == [n for n, _ in ls.TEMPLATES]


def test_whole_licence_files_and_headers_of_several_lines(spark):
    rows, want = [], {}
    for i, (name, text) in enumerate(ls.texts()):
        rows.append((i, f"d{i}/COPYING", f"Copyright 2001 Some One, all of them\n\n{text}"))
        rows.append((100 + i, f"d{i}/sub/a.c", "int x;\n"))
        want |= {i: (name, "own", None), 100 + i: (name, "inherited", f"d{i}")}
    head = dict((f.name, f.read_text()) for f in ls.Path(ls.__file__).with_name("licences").glob("*.header.txt"))
    marks = {"Apache-2.0": "# {}", "GPL-2.0": " * {}", "MPL-2.0": "// {}", "LGPL-2.1": "{}"}
    for i, (name, mark) in enumerate(marks.items(), 200):
        lines = "\n".join(mark.format(x) for x in head[f"{name}.header.txt"].split("\n"))
        rows.append((i, f"x{i}/a.c", f"/*\n{lines}\n*/\nint x;\n" if "#" not in mark else f"{lines}\nint x;\n"))
        want[i] = (name, "own", None)
    rows.append((300, "y/license_scan.py", "def license(path):\n    return path\n" * 9))
    want[300] = (None, None, None)
    assert scanned(spark, rows) == want
