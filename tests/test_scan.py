import pytest

from sparkloom.operators import graph
from sparkloom.plans.scan import scan
from sparkloom.sources import parsers

SPARE = "def spare(a, b):\n    c = a + b\n    return c\n"
SMALL = {"shop/cart.py": "def total(rows):\n    return tax(rows)\n\ndef tax(rows):\n    return 0\n", "shop/report.py": SPARE, "shop/again.py": SPARE, "logo.png": b"\x89PNG"}


@pytest.mark.parametrize("mode, score, dead", [("intended", 40.0, 3), ("compat", 70.0, 0)])
def test_small_repository(spark, tree, mode, score, dead):
    got = scan(spark, tree(SMALL), mode=mode)
    report = got.to_dict()
    assert report["summary"] == {"total_files": 3, "total_lines": 14, "languages_detected": ["python"], "total_functions": 4, "total_classes": 0, "total_imports": 0}
    assert len(report["duplicates"]) == 1 and len(report["duplicates"][0]["locations"]) == 2
    assert len(report["dead_code"]) == dead
    assert got.health().first()["score"] == score
    got.release()


def test_empty_tree(spark, tree):
    got = scan(spark, tree({"readme.md": "x"}))
    report = got.to_dict()
    assert report["summary"]["total_files"] == 0 and report["dead_code"] == [] and report["dep_graph"]["circular"] == []
    assert got.health().first()["score"] == 100.0
    assert got.architecture().first()["entry_points"] == []


def test_subprojects(spark, tree):
    root = tree({
        "pyproject.toml": "", "services/auth/pyproject.toml": "", "services/auth/setup.py": "", "packages/ui/package.json": "{}", "packages/ui/tsconfig.json": "{}",
        "worker/go.mod": "", "node_modules/x/package.json": "{}", "web/tsconfig.json": "{}",
    })
    got = scan(spark, root).to_dict()["subprojects"]
    assert [(r["root"], r["language"], r["test_command"]) for r in got] == [("services/auth", "python", "pytest"), ("packages/ui", "javascript", "npm test"), ("web", "typescript", "npm test"), ("worker", "go", "go test ./...")]


def test_cycles_dotted_and_relative_imports(spark, tree):
    root = tree({
        "pkg/__init__.py": "", "pkg/a.py": "from . import b\n", "pkg/b.py": "import pkg.c\n", "pkg/c.py": "from pkg.a import x\n",
        "pkg/self_import.py": "from .self_import import y\n", "one.py": "import two\n", "two.py": "import one\nimport bridge\n", "bridge.py": "import pkg.a\n", "free.py": "import os\n",
    })
    got = scan(spark, root)
    edges = {(e["from"], e["to"]) for e in got.to_dict()["dep_graph"]["edges"]}
    assert {("pkg/a.py", "pkg/b.py"), ("pkg/b.py", "pkg/c.py"), ("pkg/c.py", "pkg/a.py"), ("one.py", "two.py")} <= edges
    assert got.circular() == [["one.py", "two.py", "one.py"], ["pkg/a.py", "pkg/b.py", "pkg/c.py", "pkg/a.py"], ["pkg/self_import.py", "pkg/self_import.py"]]
    assert sorted(r["file"] for r in got.cycle_files().collect()) == ["one.py", "pkg/a.py", "pkg/b.py", "pkg/c.py", "pkg/self_import.py", "two.py"]
    compat = scan(spark, tree({"p.py": "from q import x\n", "q.py": "from p import x\nfrom q import z\n"}), mode="compat")
    assert [c for c in compat.circular() if "q.py" in c] == [["q.py", "q.py"]]


def test_rings_of_any_length_are_listed(spark, tree):
    files = {f"f{i:02}.py": f"import f{(i + 1) % 11:02}\n" for i in range(11)}
    files |= {"g0.py": "import g1\n", "g1.py": "import g0\nimport f00\n"}
    got = scan(spark, tree(files))
    ring = [f"f{i:02}.py" for i in range(11)]
    assert got.circular() == [[*ring, ring[0]], ["g0.py", "g1.py", "g0.py"]]
    assert got.health().first()["circular_count"] == 2


def test_depth_first_cycles():
    assert graph.first_search_cycles(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("b", "b")]) == [["a", "b", "c", "a"], ["b", "c", "b"], ["b", "b"]]


def test_dead_code_exclusions(spark, tree):
    root = tree({
        "m.py": "__all__ = ['exported']\n\n@app.route('/x')\ndef handler():\n    pass\n\nclass K:\n    def __init__(self):\n        pass\n\n    def method(self):\n        return go(1)\n\n    @staticmethod\n    def st():\n        pass\n\n\ndef main():\n    K().method()\n\n\ndef exported():\n    pass\n\n\ndef go(x):\n    # unused(\n    return x\n\n\ndef unused():\n    pass\n",
        "broken.py": "def (:\n", "latin.py": b"x = '\xe9'\n", "bom.py": b"\xef\xbb\xbfx = 1\r\n", "empty.py": "",
    })
    report = scan(spark, root).to_dict()
    assert [(d["symbol"], d["line"]) for d in report["dead_code"]] == [("unused", 32)]
    assert report["summary"]["total_files"] == 5
    assert "broken.py" not in report["dep_graph"]["nodes"] and "bom.py" in report["dep_graph"]["nodes"]


def test_god_files_are_strict(spark, tree):
    root = tree({"a.py": "x = 1\n" * 499, "b.py": "x = 1\n" * 500, "c.py": "".join(f"def f{i}(): pass\n" for i in range(11)), "d.py": "".join(f"def g{i}(): pass\n" for i in range(10))})
    assert [g["file"] for g in scan(spark, root).to_dict()["god_files"]] == ["b.py", "c.py"]


def test_filters(spark, tree):
    root = tree({"a.py": "x\n", "b.go": "package b\n", "d/e/f.py": "x\n", "tests/test_a.py": "x\n", "scan.toml": "[scan]\nignore = ['gen']\n", "gen/g.py": "x\n", "_p.py": "x\n", "yarn.lock": ""})
    nodes = lambda **k: [r["file"] for r in scan(spark, root, **k).nodes.orderBy("file").collect()]
    assert nodes() == ["_p.py", "a.py", "b.go", "d/e/f.py", "tests/test_a.py"]
    assert nodes(languages=["go"]) == ["b.go"]
    assert nodes(languages=["cobol"]) == []
    assert nodes(include_tests=False, max_depth=2) == ["_p.py", "a.py", "b.go"]


def test_python_parser():
    got = parsers.parse_python("import a.b as c\nfrom ..x import y as z, w\n@d.e(1)\nasync def f(a):\n    '''doc'''\n    def g(): return 1\nclass K(B):\n    @property\n    def p(self): ...\n")
    assert [(f["name"], f["start_line"], f["end_line"], f["decorators"]) for f in got["functions"]] == [("f", 4, 6, ["d.e"]), ("g", 6, 6, []), ("p", 9, 9, ["property"])]
    assert got["functions"][1]["body"] == "return 1"
    assert got["classes"] == [{"name": "K", "start_line": 7, "end_line": 9, "methods": ["p"]}]
    assert [(i["names"], i["from_module"], i["alias"]) for i in got["imports"]] == [(["a.b"], None, "c"), (["y", "w"], "..x", None)]


def test_script_parser():
    text = """import D, {a as b, c} from './x'
import * as ns from "y"
import 'bare'
// function no1() {}
const s = "function no2() {}", t = `function no3() {}`, r = /[{]"/
class A extends B {
  constructor(x) { super(x); if (x) { y() } }
  get v() { return 1 }
  static m(a, b = {}) { return () => 1 }
}
export async function f({ a, b }, c = "}") { return a }
export const g = async (x) => { return x }
const h = x => { return x }
const k = (x) => x
function* gen() { yield /}/ }
"""
    got = parsers.parse_script(text)
    assert [f["name"] for f in got["functions"]] == ["constructor", "v", "m", "f", "g", "h", "gen"]
    assert [(c["name"], c["methods"], c["start_line"], c["end_line"]) for c in got["classes"]] == [("A", ["constructor", "v", "m"], 6, 10)]
    assert [(i["names"], i["from_module"], i["line"]) for i in got["imports"]] == [(["*", "a", "b", "c"], "./x", 1), (["ns"], "y", 2)]


def test_typed_script_and_go():
    got = parsers.parse_script("class S<T> {\n  private n(x: number): Map<string, T> { return this.q }\n}\nexport function id<T>(x: T): T { return x }\nconst f = (a: number): string => { return '' }\n")
    assert [f["name"] for f in got["functions"]] == ["n", "id", "f"]
    go = parsers.parse_go('package m\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\nimport "os"\n\ntype T struct {\n\tA int\n}\n\ntype I interface{ F() }\n\nfunc (t *T) Run(a int) (int, error) {\n\treturn 1, nil\n}\n\nfunc Map[K any](k K) K { return k }\n')
    assert [(f["name"], f["start_line"], f["end_line"]) for f in go["functions"]] == [("Run", 15, 17), ("Map", 19, 19)]
    assert [(c["name"], c["start_line"], c["end_line"]) for c in go["classes"]] == [("T", 9, 11), ("I", 13, 13)]
    assert [i["from_module"] for i in go["imports"]] == ["fmt", "net/http", "os"]


def test_new_language(spark, tree):
    parsers.register("go", lambda text: {"functions": [], "classes": [], "imports": [], "exported": [text[:3]]})
    try:
        assert parsers._REGISTRY["go"]("abcdef")["exported"] == ["abc"]
    finally:
        parsers.register("go", parsers.parse_go)


def test_a_long_ring_is_reported_and_costs_health(spark, tree):
    """Nine files in a ring, most of them on a short cycle too: the ring is listed, and both kinds count."""
    files = {f"m{k}.py": f"import m{(k + 1) % 9}\n" + (f"import m{k - 1}\n" if k % 2 else "") for k in range(9)}
    s = scan(spark, tree(files))
    cycles = s.circular()
    assert [f"m{k}.py" for k in (*range(9), 0)] in cycles and ["m0.py", "m1.py", "m0.py"] in cycles and len(cycles) == 5
    assert {r["file"] for r in s.cycle_files().collect()} == set(files)
    assert s.health().first()["circular_count"] == 5
    s.release()


def test_parsed_files_leave_a_worker_bit_by_bit(spark):
    import pandas as pd

    from sparkloom.sources import parsers

    body = b"def f(x):\n    return g(x) + 1\n" * 4000
    files = pd.DataFrame({"file": [f"{i}.py" for i in range(60)], "language": "python", "content": [body] * 60, "error": None})
    got = [(len(b), b["text"].str.len().sum()) for b in parsers.parsed_batches(iter([files]), parsers.parsers_now())]
    assert sum(n for n, _ in got) == 60 and max(size for _, size in got) < parsers.TOGETHER + len(body)


def test_files_of_one_partition_are_parsed_by_all_cores(spark):
    from pyspark.sql import functions as F

    from sparkloom.sources import parsers

    files = spark.range(400, numPartitions=1).select(F.concat("id", F.lit(".py")).alias("file"), F.lit("python").alias("language"), F.lit(b"def f(): pass\n").alias("content"), F.lit(None).cast("string").alias("error"))
    got = parsers.parse_files(files).select(F.spark_partition_id().alias("p")).distinct().count()
    assert got >= spark.sparkContext.defaultParallelism
