"""Parsing and fragments against fixed cases."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fragments
from sparkloom.sources import project

F1 = "<template>\n  <li>{{ todo.title }}</li>\n</template>\n<script>\nexport default {\n  name: 'TodoItem',\n  components: { Badge: BadgeView, Icon },\n  props: { todo: { type: Object, required: true }, dense: Boolean }\n}\n</script>\n<style scoped>\n.done { color: gray }\n</style>\n"
F2 = "<template>\n <div><template #hd>x</template>tail</div>\n</template>\n<script setup>\nconst a = 1\n</script>\n"
F3 = "<script>\nexport default { data: () => ({ filename: 'x.txt' }), props: ['items', \"sel\"], components: { Row, Cell } }\n</script>"
F4 = '<template></template><style lang="scss"></style>'
F5 = "<script>props: { 할일: Object, todo: {type: X, required: true} }</script>"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("project") / "web"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, data in {
        "TodoItem.vue": F1, "Card.vue": F2, "List.vue": F3, "Empty.vue": F4, "Prop.vue": F5, "a.js": "let a = 1\r\nlet b\r", "builder.js": "x", ".h.js": "hidden", "_h.ts": "hidden", "s.css": "p{}", "no.html": "<p>", "B.VUE": F1,
    }.items():
        (root / "src" / name).write_bytes(data.encode())
    (root / "src" / "bom.ts").write_bytes(b"\xef\xbb\xbfa\r\n")
    (root / "src" / "bad.js").write_bytes(b"\xff\xfea")
    (root / "node_modules" / "m.js").write_text("x")
    return root


@pytest.fixture(scope="module")
def parsed(spark, tree):
    return {r["file_name"]: r for r in project.parse(project.read_project_local(spark, str(tree))).collect()}


def test_scan(spark, tree, parsed):
    assert set(parsed) == {"TodoItem.vue", "Card.vue", "List.vue", "Empty.vue", "Prop.vue", "a.js", ".h.js", "_h.ts", "s.css", "bom.ts", "bad.js"}
    assert parsed["a.js"]["raw_content"] == "let a = 1\nlet b\n"
    assert parsed["bom.ts"]["raw_content"] == "﻿a\n"
    assert parsed["bad.js"]["error"] and parsed["bad.js"]["raw_content"] is None
    by_spark = {r["file_name"] for r in project.read_project(spark, str(tree)).collect()}
    assert by_spark == set(parsed) - {".h.js", "_h.ts"}


def test_missing_and_ignored_files(spark, tree):
    rows = {r["file_name"]: r for r in project.read_files(spark, [str(tree / "src" / "builder.js"), str(tree / "none.js")]).collect()}
    assert rows["builder.js"]["ignored"] and rows["builder.js"]["raw_content"] is None
    assert rows["none.js"]["error"] and rows["none.js"]["size"] == 0


def test_sections(parsed):
    a = parsed["TodoItem.vue"]
    assert a["template"] == "<li>{{ todo.title }}</li>" and a["style"] == ".done { color: gray }"
    assert (a["component_name"], a["props"], a["components"]) == ("TodoItem", ["todo", "type", "required"], ["Badge"])
    b = parsed["Card.vue"]
    assert (b["template"], b["script"], b["component_name"], b["props"]) == ("<div><template #hd>x", None, "Card", [])
    c = parsed["List.vue"]
    assert (c["component_name"], c["props"], c["components"], c["template"]) == ("x.txt", ["items", "sel"], [], None)
    d = parsed["Empty.vue"]
    assert (d["template"], d["style"], d["component_name"]) == ("", "", "Empty")
    assert parsed["Prop.vue"]["props"] == ["할일", "todo", "type", "required"]
    assert parsed["a.js"]["template"] is None and parsed["a.js"]["component_name"] is None


def test_fragments(spark, tree):
    files = project.parse(project.read_project_local(spark, str(tree)))
    frags = fragments.fragments(files)
    got = {}
    for r in frags.orderBy("part").collect():
        got.setdefault(r["metadata"]["file_name"], []).append((r["type"], r["name"]))
    assert got["TodoItem.vue"] == [("component", "TodoItem"), ("template", "TodoItem_template"), ("script", "TodoItem_script"), ("style", "TodoItem_style")]
    assert [t for t, _ in got["Card.vue"]] == ["component", "template"]
    assert [t for t, _ in got["List.vue"]] == ["component", "script"]
    assert got["Empty.vue"] == [("component", "Empty")] and got["a.js"] == [("javascript", "a.js")] and got["s.css"] == [("css", "s.css")]
    assert "bad.js" not in got
    style = frags.where("type = 'style'").first()["content"]
    assert style == "<style scoped>\n.done { color: gray }\n</style>"
    ids = [r["id"] for r in frags.collect()]
    assert len(set(ids)) == len(ids)
    stats = fragments.fragment_stats(frags).first()
    assert (stats["has_props"], stats["has_components"]) == (3, 1)
    per_file = {r["path"].rsplit("/", 1)[1]: r["n_fragments"] for r in fragments.fragments_per_file(files).collect()}
    assert per_file["bad.js"] == 0 and per_file["TodoItem.vue"] == 4


@pytest.mark.parametrize(
    "path, ignored",
    [("src/builder.js", True), ("src/distance.js", True), (".github/x.js", True), ("src/.envrc.js", True), ("node_modules/a.js", True), ("src/redist/a.css", True), (".gitignore.js", True), ("src/App.vue", False), ("src/Build.js", False)],
)
def test_ignored(spark, path, ignored):
    assert spark.range(1).select(project.is_ignored(F.lit(path))).first()[0] is ignored


def test_scan_of_a_uri(spark, tree):
    """Hidden names are read through a URI too; nothing is joined with itself; files are dealt by size."""
    df = project.read_any(spark, f"file:{tree}")
    assert {r["file_name"] for r in df.collect()} >= {".h.js", "_h.ts", "a.js"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("BatchScan") == 1
    every = {r["path"]: r for r in project.read_tree(spark, str(tree)).collect()}
    assert {r["path"]: r for r in df.collect()} == every
    from sparkloom.sources import files

    small = files.project_files(spark, str(tree), target_bytes=1)
    assert small.rdd.getNumPartitions() == len(every) and small.count() == len(every)
    with pytest.raises(Exception, match="no such folder"):
        project.read_tree(spark, str(tree / "nothing")).collect()


def test_files_are_dealt_by_size():
    from sparkloom.sources.files import OPENING_BYTES, dealt

    sizes = [(f"p{k:02}", f"p{k:02}", (k * 37 % 11) * 100_000) for k in range(40)] + [("huge", "huge", 10_000_000)]
    parts = dealt(sizes, 1_000_000)
    of = {p: n for p, _, n in sizes}
    assert sorted(p for part in parts for p, _ in part) == sorted(of)
    assert all(len(part) == 1 or sum(of[p] + OPENING_BYTES for p, _ in part) <= 1_000_000 for part in parts)
    assert dealt([], 5) == []


def test_a_file_is_read_once(spark, tree):
    """Fragments of a tree come from one scan; what can't be opened is a row of its own."""
    found = fragments.fragments(project.parse(project.read_tree(spark, str(tree))))
    assert found._jdf.queryExecution().executedPlan().toString().count("BatchScan") == 1
    rows = {r["path"]: r for r in project.read_files(spark, [str(tree / "none.js"), str(tree), str(tree / "src" / "a.js")]).collect()}
    assert rows[str(tree / "none.js")]["error"].startswith("can't be read") and rows[str(tree)]["error"].startswith("can't be read")
