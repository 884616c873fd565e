import random

from pyspark.sql import functions as F

from lodestone.llm import handwritten as h

RNG = random.Random(3)
WORDS = "order index chunk record batch ledger route planner merge vector page token".split()


def _name():
    return "_".join(RNG.choices(WORDS, k=2))


def _python(n=12):
    kinds = ["x = {}({})", "if {} is None: return {}", "for a in {}.items(): {}.append(a)", "# keep {} near {}", "raise ValueError({}, {})", "with {} as f: f.read({})", "{}[{}] += 1", "assert {} <= {}", "return [{} for y in {}]", "del {}, {}", "log.info('z', {}, {})", "{} = not {}"]
    names = [_name() for _ in range(6)]  # who writes by hand uses names again
    return f"def {_name()}(self):\n" + "\n".join("    " + RNG.choice(kinds).format(*RNG.choices(names, k=2)) for _ in range(n)) + "\n"


def _minified():
    return "".join(f"function {c}{d}(a,b){{return a.{RNG.choice(WORDS)}?b.q{i}:{c}{d}(a,{i})}}" for i, (c, d) in enumerate((RNG.choice("abcxyz"), RNG.choice("QZXt")) for _ in range(60)))


CASES = {
    "a/one.py": (_python(), "handwritten"),
    "a/two.js": (_minified(), "minified"),
    "web/app.min.js": ("let a = 1", "minified"),
    "vendor/lib/three.py": (_python(), "vendored"),
    "vendor_portal/four.py": (_python(), "handwritten"),
    "generators/five.py": ("# the report generated here goes to owners\n" + _python(), "handwritten"),
    "a/six.py": ("# Code generated by tool v1. DO NOT EDIT.\n" + _python(), "generated"),
    "a/seven.py": ('s = "# Code generated by tool. DO NOT EDIT."\n' + _python(), "handwritten"),
    "a/eight.go": ("var T = []byte{\n" + "    0x1f, 0x2e, 0xaa, 0x01, 0x90, 0x3c,\n" * 40 + "}\n", "data"),
    "a/nine.py": ("\n".join(f"{a}_{b}_{i} = make_descriptor(name='x', index={i}, number={i + 3}, kind={b}_{a}_type_{i})" for i, (a, b) in enumerate(zip(RNG.choices(WORDS, k=30), RNG.choices(WORDS, k=30)))), "generated"),
    "a/ten.py": ("# Local copy of lib at tag v2, taken over as is\n" + _python(), "vendored"),
    "a/eleven.py": ("\n".join(f"{a}Of{b.title()} = {b}For{a.title()}({i})" for i in range(20) for a, b in [RNG.choices(WORDS[:3], k=2)]) + "\nif a:\n  b\nelse:\n  c\ndel d\n(e)\n[f]\n", "vendored"),
    "a/readme.md": ("# generated files are described here\n", "handwritten"),
    "a/empty.py": ("", "handwritten"),
    "a/none.py": (None, "handwritten"),
    "x/y_pb2.py": (None, "generated"),
}


def _frame(spark, cases):
    rows = [("o/r", p, "PYTHON ", f"c{i}", t, 1, 0.0) for i, (p, (t, _)) in enumerate(cases.items())]
    rows += [("o/r", f"fill/f{i}.py", "python", f"f{i}", _python(20), 1, 0.0) for i in range(60)]
    rows += [("o/r", f"fill/g{i}.js", None, f"g{i}", "\n".join(f"const {a}{b.title()} = {b}.{a}({i});" for _ in range(8 + i % 5) for a, b in [RNG.choices(WORDS[:3], k=2)]) + "\nif (a) {\nreturn b;\n}\nfor (const c of d) { e(c); }\nawait f();\n", 1, 0.0) for i in range(60)]
    rows += [("o/r", f"vendor/lib/v{i}.py", "python", f"v{i}", f"# Local copy of lib{i} at tag v{i}, taken over as is\n" + _python(), 1, 0.0) for i in range(5)]
    rows += [("o/r", f"fill/h{i}.py", "python", f"h{i}", "# what follows is a local rule\n" + _python(), 1, 0.0) for i in range(5)]
    rows += [(None, "a", "python", "z", "x", 1, 0.0), ("o/r", None, "python", "z2", "x", 1, 0.0), rows[0]]
    return spark.createDataFrame(rows, "repository string, file_path string, prog_lang string, chunk_id string, content string, created_at int, runs double").withColumns({"created_at": F.timestamp_seconds("created_at"), "start_line": F.lit(None).cast("int"), "n": F.lit(1)})


def test_kinds(spark):
    got = {r.file_path: r.kind for r in h.classified_files(_frame(spark, CASES)).collect()}
    assert {p: got[p] for p in CASES} == {p: k for p, (_, k) in CASES.items()}
    assert {p: k for p, k in got.items() if p.startswith("fill/") and k != "handwritten"} == {}


def test_empty_and_languages(spark):
    assert h.classified_files(_frame(spark, CASES).limit(0)).collect() == []
    assert [h.language_of(*x) for x in (("a/b.PY", None), ("a", " Go"), ("a.env.4k", "dotenv"), ("x", None))] == ["python", "go", "other", "other"]


def _model(pairs=()):
    import numpy as np

    return h.Names(*(np.array(x) for x in zip(*pairs))) if pairs else h.Names(np.array([]), np.array([]), np.array([]))


def test_costs_are_those_of_a_plain_model():
    import math
    from collections import Counter

    names = ["getValue", "set_value2", "x", "A" * 300, "q99z", "__"]
    code = lambda c: 0 if c == "$" else 27 if c == "_" else 28 if c == "0" else ord(c) - 96
    plain = lambda n: "$" + h._DIGITS.sub("0", n.lower()) + "$"
    grams = Counter(plain(n)[i : i + 3] for n in names for i in range(len(plain(n)) - 2))
    model = _model([("go", (code(g[0]) * 29 + code(g[1])) * 29 + code(g[2]), k) for g, k in grams.items()])
    before = Counter()
    for g, k in grams.items():
        before[g[:2]] += k
    bits, letters = model.cost("go", [*names, "unseen"])
    for name, b, n in zip([*names, "unseen"], bits, letters):
        each = [plain(name)[i : i + 3] for i in range(len(plain(name)) - 2)]
        want = sum(-math.log2((grams[g] + 0.1) / (before[g[:2]] + 2.9)) for g in each)
        assert n == len(each) and math.isclose(b, want, rel_tol=1e-4)


def test_very_long_text_and_name():
    m = dict(zip(h._FEATURES, h.measure(_model(), "javascript", "a.b(c);" * 200_000)[0]))
    assert m["names"] == m["tiny"] == 600_000 and m["chars"] == 1_400_000
    m = dict(zip(h._FEATURES, h.measure(_model(), "go", "x" * 1_000_000)[0]))
    assert m["letters"] == 1_000_000


def test_repeats_of_a_template_are_not_diverse():
    even = dict(zip(h._FEATURES, h.measure(_model(), "go", "\n".join(f"func getA{i}B{i}() {{ x.setC{i}D{i} }}" for i in range(50)))[0]))
    assert even["runs_bits"] < 0.6 * even["runs_most"] and even["once"] == even["kinds"]


def test_markers_after_long_leading_comments():
    n = _model()
    says = lambda text, lang="go": h.measure(n, lang, text)[0][h._FEATURES.index("published")] > 0
    licence = [f"licence line {i}" for i in range(40)]
    mark, code = "Code generated by deepcopy-gen. DO NOT EDIT.", "package a\n" + "x := 1\n" * 20
    assert says("/*\n" + "\n".join(licence) + "\n*/\n\n// " + mark + "\n" + code)
    assert says("/*\n" + "\n".join(licence) + "\n" + mark + "\n*/\n" + code)
    assert says("<?php\n" + "\n".join("// " + x for x in licence) + "\n// " + mark + "\n", "php")
    assert says("#!/bin/sh\n" + "\n".join("# " + x for x in licence) + "\n# " + mark + "\nset -e\n", "other")
    assert not says("/*\n" + "\n".join(licence) + "\n*/\n" + code + "// " + mark + "\n")
    assert not says("\n".join("// " + x for x in licence) + "\ns := 1\n// " + mark + "\n")
    assert not says("/* " + licence[0] + " */\n" + "\n".join("#include <a>" for _ in range(15)) + "\n// " + mark + "\n", "c")
