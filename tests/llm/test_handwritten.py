from pyspark.sql import functions as F

from tarnwork.llm.handwritten import attribute_rules, code_runs, declared_paths, grams, known_files, marks, mined_patterns, not_hand_written, patterns_of, piece_marks, rules_of
from tests.conftest import rows

HAND = "import os\n\ndef f(a):\n    # the template puts 'DO NOT EDIT' at the top\n    if a:\n        return g(a, 1)\n    for i in a:\n        h(i)\n    x = a[1:2]\n    return x\n"
STUB = "".join(f"proto.Slot.prototype.getA{i} = function() {{ return proto.field(this, {i}, 0); }};\n" for i in range(20))
MINI = "".join(f"if(a{i}(b)){{c();d({i})}}else e=null;" for i in range(40))
DATA = "X = [\n" + "  0.50488, 0.88826, 0.98510, -0.43078, -0.92587,\n" * 30 + "]\n"
OTHER = "# Part of the foo project. See LICENCE in the foo 1.2.3 distribution.\n" + HAND + "\ndef other(b):\n    return [b, 'and some more code to make this piece long enough to compare']\n"


def why(text):
    lines, chars, tight, data, shaped, *_ = marks(text, True)
    return "mini" if tight > chars / 2 else "data" if data > chars / 2 else "shape" if shaped > 0.6 * max(1, lines) else None


def test_marks():
    assert why(HAND) is None and why("") is None and why(OTHER) is None
    assert why(STUB) == "shape" and why(MINI) == "mini" and why(DATA) == "data"
    assert why('KEY = "' + "a b c " * 100 + '"\n' + HAND) is None
    assert grams("// Code generated by x v1. DO NOT EDIT.") == ["code generated by", "generated by x", "by x v", "x v do", "v do not", "do not edit"] and grams("# ---") == [] and grams("# a b") == ["a b"]
    assert marks("# one two three\n" + HAND, True)[5] == ["one two three"] and marks("# one two three\n" + HAND, False)[5] == []


def test_copies_share_runs():
    lines = [f"x{i} = f(y{i * 7 % 13})" for i in range(40)]
    whole = set(code_runs(lines))
    for a in range(0, 33):
        assert whole & set(code_runs(["other = 1", *lines[a : a + 7], "more = 2"])), a
    assert not whole & set(code_runs([f"z{i}" for i in range(40)])) and code_runs(lines[:3]) == []


F_ = "project_id string, path string, language string, content_hash string"
C_ = "project_id string, path string, file_hash string, chunk_id string, start_line int, text string, lines int"


def body(n):
    return "".join(f"def part{n}_{i}(a, b):\n    c = helper{n}_{i}(a) + {i}\n    if c > b:\n        return other{n}(c, {i * n})\n    return [c, b, {i}]\n" for i in range(6))


def test_operator(spark):
    files, texts = [], {}

    def put(project, path, text, language="python"):
        files.append((project, path, language, "h"))
        texts[project, path] = text

    for i in range(12):  # in each of 12 projects: a tool's file, a third party's, hand-written ones
        put(f"p{i}", f"out{i}/a{i}_pb2.py", f"# Made by the x tool from a.idl\n{STUB}")
        put(f"p{i}", f"third/v{i}.py", f"# Part of the foo project, see licence {i}\n{body(99)}")
        put(f"p{i}", f"src/hand{i}.py", f"# helpers; the x tool reads this\n{body(i)}")
    put("p0", "here.py", f"# Made by the x tool from b.idl\n{body(50)}")  # only its comment gives it away
    put("p1", "out/late_pb2.py", body(51))  # only its name does
    put("p2", "third/patched.py", body(99).replace("part99_2", "mine"))
    put("p3", "src/data.py", DATA)
    put("p3", "src/mini.py", MINI)
    put("q", "gen/a.py", body(52))
    put("q", "third/kept/b.py", body(99))
    put("q", "y.yaml", STUB, "yaml")
    files += [("q", "gen/a.py", "python", "h"), ("q", "nochunk.py", "python", "h"), ("q", "n.py", None, "h"), (None, "n.py", "python", "h"), ("q", "old.py", "python", "now")]
    chunks = [(a, b, "h", a + b, 1, t, 0) for (a, b), t in texts.items()] * 2 + [("q", "old.py", "was", "o", 1, STUB, 0), ("q", "gen/a.py", "was", "z", 1, STUB, 0), ("q", "nul.py", "h", "q", None, None, 0)]
    chunks += [("q", ".gitattributes", "h", "g", 1, "gen/** linguist-generated\n*.js text\n", 0), ("q", "third/.gitattributes", "h", "g2", 1, "# c\nkept/** -linguist-vendored\n", 0)]
    pieces = piece_marks(spark.createDataFrame(chunks, C_)).cache()
    df = spark.createDataFrame(files, F_)
    rules = [r[0] for r in rows(rules_of(known_files(df, pieces, ["python"])))]
    assert "_pb2.py" in rules and "third/" in rules and "# the x tool" not in rules and "# made by the" in rules and "src/" not in rules
    got = {(a, b): c for a, b, c in rows(not_hand_written(df, pieces, ["python"]))}
    assert got.pop(("p0", "here.py")) == "mined" and got.pop(("p1", "out/late_pb2.py")) == "mined" and got.pop(("p2", "third/patched.py")) == "mined"
    assert got.pop(("p3", "src/data.py")) == "data" and got.pop(("p3", "src/mini.py")) == "minified" and got.pop(("q", "gen/a.py")) == "declared" and got.pop(("q", "old.py")) == "shape"
    assert len(got) == 24 and set(got.values()) == {"mined"} and not any("hand" in b for _, b in got)
    none = not_hand_written(df, pieces, ["python"], rules=spark.createDataFrame([], "pattern string"))
    assert sorted({r[2] for r in rows(none)}) == ["copy", "data", "declared", "minified", "shape"]
    empty = piece_marks(spark.createDataFrame([], C_))
    assert not_hand_written(spark.createDataFrame([], F_), empty, ["python"]).count() == 0


def test_attribute_precedence(spark):
    declared = spark.createDataFrame([("p", ".gitattributes", "*.pb.go linguist-generated\nlib/* linguist-vendored=true\nlib/mine.c linguist-vendored=false\n"), ("p", "sub/.gitattributes", "*.pb.go linguist-generated=false\n")], "project_id string, path string, declared string")
    files = spark.createDataFrame([("p", x) for x in ("a.pb.go", "x/b.pb.go", "sub/c.pb.go", "lib/a.c", "lib/mine.c", "lib/deep/a.c", "q.c")] + [("other", "a.pb.go")], "project_id string, path string")
    got = rows(declared_paths(files, attribute_rules(declared)), "path", "declared")
    assert got == [("a.pb.go", True), ("lib/a.c", True), ("lib/mine.c", False), ("sub/c.pb.go", False), ("x/b.pb.go", True)]


def test_mined_patterns(spark):
    known = [(f"p{i % 5}", f"src{i}/thirdparty_x/a{i}.py", True) for i in range(40)] + [(f"p{i % 5}", f"lib/a{i}.py", i % 2 == 0) for i in range(40)] + [("p1", f"only/one{i}.py", True) for i in range(40)] + [(f"p{i % 5}", f"a/m{i}_pb2.py", True) for i in range(30)]
    df = spark.createDataFrame(known, "project_id string, path string, known boolean").withColumn("pattern", F.explode(patterns_of(F.col("path"))))
    assert rows(mined_patterns(df)) == [("_pb2.py",), ("a/",), ("thirdparty_x/",)]


def test_attribute_files_are_read_whole_and_in_their_current_content(spark):
    files = [("p", x, "python", "h") for x in ("gen/a.py", "gen/mine.py", "lib/b.py", "lib/c.py", "old/d.py")] + [("p", ".gitattributes", None, "h"), ("p", "lib/.gitattributes", None, "h"), ("p", "old/.gitattributes", None, "empty"), ("q", "x/e.py", "python", "h")]
    chunks = [("p", p, "h", p, 1, HAND, 0) for p in ("gen/a.py", "gen/mine.py", "lib/b.py", "lib/c.py", "old/d.py")] + [("q", "x/e.py", "h", "e", 1, body(7), 0)]
    chunks += [("p", ".gitattributes", "h", "z1", 1, "# a\n# b\ngen/** linguist-generated\nlib/b.py lingu", 0), ("p", ".gitattributes", "h", "a2", 4, "ist-vendored\ngen/mine.py -linguist-generated\n", 0)] * 2
    chunks += [("p", ".gitattributes", "was", "w", 1, "lib/c.py linguist-vendored\n", 0), ("p", "lib/.gitattributes", "was", "w2", 1, "c.py linguist-vendored\n", 0), ("p", "old/.gitattributes", "was", "w3", 1, "* linguist-vendored\n", 0)]
    chunks += [("q", ".gitattributes", None, "n", None, "x/* linguist-generated\n", 0)]
    pieces = piece_marks(spark.createDataFrame(chunks, C_)).cache()
    got = rows(not_hand_written(spark.createDataFrame(files, F_), pieces, ["python"]), "path", "reason")
    assert got == [("gen/a.py", "declared"), ("lib/b.py", "declared"), ("x/e.py", "declared")]
