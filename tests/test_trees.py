"""Walking source trees: what is left out by default, by ignore files, and what is read."""

import hashlib

import pytest

from quarrylake.sources import trees


def _put(root, path, content="x = 1\n"):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_bytes(content if isinstance(content, bytes) else content.encode())


@pytest.mark.parametrize("path, out", [
    ("src/main.rs", False), ("project/node_modules/pkg/index.js", True), (".git/config", True), ("a/target/debug/main", True), ("a/.env", True), (".env.local", True),
    ("MSTRG/Evidence_20251002/RawEvidence.json", True), ("Raw_Evidence/AC.json", True), ("Cargo.lock", True), ("x/YARN.LOCK", True), ("package-lock.json", True),
    ("my-Lock.json", True), ("lock.json", False), ("app.min.js", True), ("a/b/Style.MIN.css", True), ("min.js", False), (".github/workflows/ci.yml", False), ("a/.github/x.md", False),
    (".gitignore", False), (".mypy_cache/a.py", True), ("Thumbs.db", True), (".DS_Store", True), ("a/__pycache__/b.py", True), ("__init__.py", False), ("_build/x.py", False), ("targets/a.py", False),
])
def test_left_out_by_default(path, out):
    assert trees.default_ignored(path) is out


def test_rules_of_ignore_files():
    rules = [{"folder": "", "line": x} for x in ("*.log", "out/", "/top.py", "doc/**/draft", "!keep.log", "# note", "")] + [{"folder": "sub", "line": "*.py"}, {"folder": "sub", "line": "!a.py"}]
    say = lambda p, folder=False: trees.is_ignored(p, folder, rules)
    assert say("a.log") and say("x/y/a.log") and not say("x/keep.log")
    assert say("out", True) and say("x/out", True) and not say("out")  # a file of that name stays
    assert say("top.py") and not say("x/top.py") and say("doc/a/b/draft") and say("doc/draft")
    assert say("sub/b.py") and not say("sub/a.py") and not say("b.py") and not say("subb/b.py")


def test_scan_of_a_tree(spark, tmp_path):
    for p in (
        "pkg/__init__.py", "pkg/a.PY", "_private/b.rs", ".github/workflows/ci.yml", ".hidden/c.py", "node_modules/d.js", "app.min.js", "yarn.lock", "package-lock.json",
        "gen/e.py", "gen/deep/f.py", "sub/g.go", "sub/h.go", "sub/deep/er/i.go", "notes.txt", "noext", "ué/日.py", "build.py/j.py",
    ):
        _put(tmp_path, p)
    _put(tmp_path, ".gitignore", "gen/\n!gen/e.py\n\\#x\n")
    _put(tmp_path, "sub/.gitignore", "/h.go\n")
    _put(tmp_path, "sub/deep/.ignore", "*\n!*.go\n")
    _put(tmp_path, "big.py", "x" * 300)
    _put(tmp_path, "latin.py", b"# \xe9\n")
    root = f"file://{tmp_path}"
    got = {r["path"]: r for r in trees.scan(spark, root, max_bytes=200).collect()}
    # an ignored folder is not entered, whatever is taken back in below it
    assert set(got) == {"pkg/__init__.py", "pkg/a.PY", "_private/b.rs", ".github/workflows/ci.yml", "sub/g.go", "ué/日.py", "build.py/j.py"}
    assert got["pkg/a.PY"]["language"] == "python" and got["_private/b.rs"]["hash"] == hashlib.sha256(b"x = 1\n").hexdigest() and got["sub/g.go"]["size"] == 6
    assert got["sub/g.go"]["mtime"] == int((tmp_path / "sub/g.go").stat().st_mtime)
    every = {r["path"] for r in trees.scan(spark, root, ignore_files=False).collect()}
    assert every == set(got) | {"gen/e.py", "gen/deep/f.py", "sub/h.go", "sub/deep/er/i.go", "big.py"}
    # skipped: the big one, notes.txt, noext and both .gitignore; what is no UTF-8 shows only when it is read
    assert trees.scan_report(spark, root, 200).first() == (13, 8, 5)


def test_a_tree_that_is_empty_or_missing(spark, tmp_path):
    assert trees.scan(spark, f"file://{tmp_path}").count() == 0 and trees.scan(spark, f"file://{tmp_path}/none").count() == 0
