"""Rebuild of subtrees in place: the spliced table is the new version, and what is written follows the change."""

from graphtide.operators import frontends as fe
from graphtide.operators import splice
from graphtide.runtime import cut


def _files(spark, texts):
    return cut(fe.build(spark.createDataFrame(list(texts.items()), "graph_id string, text string")))


def _same(got, want):
    cols = want.columns
    a, b = (sorted(map(tuple, d.select(*cols).collect()), key=str) for d in (got, want))
    assert a == b


def _function(k, body=""):
    return f"int f{k}(int a) {{\n  int v = a + {k};\n{body}  return v;\n}}\n"


def _file(ks, bodies=None):
    return "".join(_function(k, (bodies or {}).get(k, "")) for k in ks)


def test_rows_number_back(spark):
    nodes = _files(spark, {"a": _file(range(5)), "b": "// only a comment\n", "c": "", "d": _file([1], {1: "  if (v > 3) { v = v - 1; } else { v = 0; }\n"})})
    _same(splice.renumbered(splice.rows(nodes)), nodes)


OLD = _file(range(40))
CASES = {
    "constant": (_file(range(20)) + _function(20).replace("+ 20", "+ 12345") + _file(range(21, 40)), 30, 12),
    "statement": (_file(range(40), {7: "  while (v) { v = g(v); }\n"}), 60, 40),
    "inserted": (_file([*range(20), 99, *range(20, 40)]), 40, 40),
    "deleted": (_file([*range(20), *range(21, 40)]), 40, 40),
    "first and last": (_file([77, *range(1, 39), 78]), 90, 60),
    "appended": (OLD + _file([50, 51]), 70, 40),
    "moved": (_file([5, *range(5), *range(6, 40)]), 300, 300),
    "blank": (OLD.replace("int f9(", "\n\nint f9("), 10, 0),
    "equal": (OLD, 0, 0),
    "emptied": ("", 5, 10_000),
}


def test_spliced_is_the_new_version(spark):
    """Every case is one graph; others stay as they are. Bounds on the rows written and removed (a file has over 500)."""
    old = cut(splice.rows(_files(spark, {c: OLD for c in CASES} | {"other": _file([3])})))
    new = _files(spark, {c: text for c, (text, _, _) in CASES.items()})
    change = splice.splice(old, new)
    table = cut(splice.spliced(old, change))
    _same(splice.renumbered(table).filter("graph_id <> 'other'"), new)
    _same(table.filter("graph_id = 'other'"), old.filter("graph_id = 'other'"))
    assert old.filter("graph_id = 'equal'").count() > 500
    written, removed = ({r["graph_id"]: r["count"] for r in d.groupBy("graph_id").count().collect()} for d in (change.written, change.removed))
    for case, (_, most_written, most_removed) in CASES.items():
        assert written.get(case, 0) <= most_written and removed.get(case, 0) <= most_removed, (case, written, removed)


def test_labels_run_out_and_versions_follow_each_other(spark, monkeypatch):
    """With room for one label between siblings, inserts at one place write the children anew; every version is whole."""
    monkeypatch.setattr(splice, "GAP", 2)
    table, ks = cut(splice.rows(_files(spark, {"x": _file([0, 1])}))), [0, 1]
    for k in (2, 3):
        ks = [0, k, *ks[1:]]
        new = _files(spark, {"x": _file(ks)})
        table = cut(splice.spliced(table, splice.splice(table, new)))
        _same(splice.renumbered(table), new)
        assert table.select("graph_id", "path").distinct().count() == table.count()


def test_new_graphs_and_empty_tables(spark):
    nodes = _files(spark, {"a": _file([1])})
    none = splice.rows(nodes).limit(0)
    _same(splice.renumbered(splice.spliced(none, splice.splice(none, nodes))), nodes)
    table = cut(splice.rows(nodes))
    change = splice.splice(table, nodes.limit(0))
    assert change.written.count() == change.removed.count() == 0
    _same(splice.spliced(table, change), table)


def test_jobs_do_not_follow_the_depth(spark):
    """One pass by graph: a level of the tree costs no jobs of its own (there were some ten a level)."""
    deep = "int f(int a) {\n" + "  if (a > 1) { " * 12 + "a = 2;" + " }" * 12 + "\n  return a;\n}\n"
    old, new = _files(spark, {"x": deep}), _files(spark, {"x": deep.replace("a = 2", "a = 345")})
    table = cut(splice.rows(old))
    sc = spark.sparkContext
    sc.setJobGroup("splice", "")
    got = splice.renumbered(splice.spliced(table, splice.splice(table, new))).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("splice"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(str, got)) == sorted(map(str, new.select(*got[0].__fields__).collect()))
    assert 0 < jobs <= 20
