from tracewell.llm.authored import find_not_authored, judged_files

FILES = "file_id bigint, root string, path string, text string, evidence int"
HAND = "def load(path):\n    # read it\n    return open(path).read()\n" * 8
MIN = "!function(e,t){" + "".join(f"var a{i}=e?t.b{i}:void 0;for(i=0;i<t.length;)t(e[i++]);" for i in range(40)) + "}();"
YES = [
    ("web/node_modules/a/i.js", HAND), ("x\\vendor\\b\\c.go", HAND), ("./gen/../dist/a.js", HAND), ("a/package-lock.json", "{}"), ("go.sum", ""), ("s/x.min.js", HAND), ("p/x_pb2.py", HAND), ("a/x.pb.go", HAND), ("d/x.designer.cs", HAND), ("js/lib-1.2.3.js", HAND),
    ("l/a.py", "# Code generated by x 1.2. DO NOT EDIT.\n" + HAND), ("l/b.py", "// Copyright\n/* @generated by x from schema y */\n" + HAND), ("l/c.py", "# Diese Datei wurde von x erzeugt und darf nicht von Hand geändert werden.\n" + HAND),
    ("l/d.py", "/*! Third-party code: x, see NOTICE. */\n" + HAND), ("l/e.js", MIN), ("l/f.py", "x = [\n" + "0x1d, 0xdf, 0x49, 0xfe,\n" * 60 + "]"), ("l/g.py", 'x = "' + "Ab3+" * 200 + '"'), ("l/h.js", "/******/ (() => { // bootstrap\n/***/ function a() {}\n"), ("l/t/target/classes/a.java", HAND),
]
NO = [
    ("src/vendors/a.py", HAND), ("src/generator/a.py", HAND), ("src/targets/a.py", HAND), ("lib/minify/a.py", HAND), ("lib/lockfile_parser.py", HAND), ("lib/generated_ids_check.py", HAND), ("l/a.py", "# we used to vendor this, now it is ours\n" + HAND), ("l/b.py", HAND + 'x = "Code generated by"  # text that y writes\n'),
    ("l/c.py", "# not generated: keep in step with x\n" + HAND), ("l/d.py", "# Copyright (c) 2025 X\n# SPDX-License-Identifier: MIT\n" + HAND), ("l/e.py", HAND + "x = '" + "word and more words " * 14 + "'\n"), ("l/f.py", "# do not minify, the stack traces need names\n" + HAND), ("l/g.py", ""), ("l/h.py", None), (None, HAND),
]


def test_files(spark):
    rows = [(i, "r", p, t, 0) for i, (p, t) in enumerate(YES)] + [(100 + i, "r", p, t, 0) for i, (p, t) in enumerate(NO)]
    df = spark.createDataFrame([*rows, rows[0]], FILES)
    got = {r.file_id: r.evidence for r in judged_files(df).collect()}
    assert len(got) == len(rows)
    assert [YES[i][0] for i in range(len(YES)) if got[i] is None] == []
    assert [(NO[i - 100][0], got[i]) for i in range(100, 100 + len(NO)) if got[i] is not None] == []


def test_shared_subtrees_of_unrelated_owners_are_copies(spark):
    lib = [("lib/thing/one.py", HAND + "# 1\n"), ("lib/thing/sub/two.py", HAND + "# 2\n")]
    rows = [(10 * k + i, root, f"{base}/{p}", t, 0) for k, (root, base) in enumerate([("a/x", "src"), ("b/y", "other/place"), ("b/z", "src")]) for i, (p, t) in enumerate(lib)]
    rows += [(90, "a/x", "src/lib/own.py", HAND + "# own\n", 0), (91, "c/q", "k/lib/thing/one.py", HAND + "# 1\n", 0)]
    got = {r.file_id: r.evidence for r in judged_files(spark.createDataFrame(rows, FILES)).collect()}
    # 91 is one file of the library with its name; 90 is the owner's own
    assert {i for i, e in got.items() if e == "shared subtree"} == {0, 1, 10, 11, 20, 21, 91}
    crlf = [(200, "d/w", "z/lib/thing/sub/two.py", lib[1][1].replace("\n", "  \r\n") + "\n", 0), (201, "d/w", "z/other.py", lib[1][1], 0), (202, "d/w", "z/one.py", "# marker\n", 0), (203, "e/w", "q/one.py", "# marker\n", 0)]
    got = {r.file_id: r.evidence for r in judged_files(spark.createDataFrame(rows + crlf, FILES)).collect()}
    assert got[200] == "shared subtree" and got[201] is None and got[202] is None
    only = spark.createDataFrame([r for r in rows if r[1].startswith("b/")], FILES)
    assert all(r.evidence is None for r in judged_files(only).collect())


def test_findings_take_the_files_judgement(spark):
    files = spark.createDataFrame([(1, "r", "a/b.py", "# @generated by x\n" + HAND, 0), (2, "r", "./c/d.py", HAND, 0)], FILES)
    f = spark.createDataFrame([(1, "r", "a\\b.py"), (2, "r", "c/d.py"), (3, "other", "vendor/x.py"), (4, "other", "src/x.py"), (5, None, None), (1, "r", "a\\b.py")], "finding_id bigint, target string, path string")
    got = sorted((r.tab, r.rec_id) for r in find_not_authored(files, f).collect())
    assert got == [("files", 1), ("findings", 1), ("findings", 3)]
    assert find_not_authored(files.limit(0), f.limit(0)).count() == 0


def test_headers_behind_remarks_of_any_length(spark):
    plain = "".join(f"// licence line {i}\n" for i in range(60))
    block = "/*\n" + "".join(f"   licence line {i}\n" for i in range(15)) + "*/\n\n"
    code = "func load() {\n\treturn open()\n}\n" * 12
    mark = "// Code generated by client-gen. DO NOT EDIT.\n"
    yes = [plain + "\n" + mark + code, block + mark + code, block.replace("*/", " * @generated by x\n */") + code, "#!/bin/sh\n" + "# licence\n" * 5000 + "# Code generated by x. DO NOT EDIT.\n" + code, code + "//# sourceMappingURL=a.js.map\n" + plain + block]
    no = [plain + code + mark + code, block + "const t = `\n" + code + mark + "`;\n", block + 'x = "Code generated by y. DO NOT EDIT."\n' + code, plain + "// this is not generated, edit it\n" + code, code + "//# sourceMappingURL=a.js.map\n" + code, code + 'x = "sourceMappingURL="\n' + plain]
    df = spark.createDataFrame([(i, f"r{i}", f"l/{i}.go", t, 0) for i, t in enumerate(yes + no)], FILES)
    got = {r.file_id: r.evidence for r in judged_files(df).collect()}
    assert [i for i in range(len(yes)) if got[i] is None] == []
    assert [(i, got[i]) for i in range(len(yes), len(got)) if got[i] is not None] == []
