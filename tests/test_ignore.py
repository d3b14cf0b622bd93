"""Ignore rules: own cases for every form of rule, pruning, reports, and the
document fixture.  (Random trees against a direct model: test_ignore_property.)"""

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import ignore as I
from lakeaudit.plans import fixtures as FX

from conftest import SF001


def kept(spark, paths, rules, **kw):
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    return sorted(r[0] for r in I.apply_ignore(listing, spark.createDataFrame(rules, "dir string, pattern string"), **kw).collect())


@pytest.mark.parametrize("rule,hits,misses", [
    (("", "*.tmp"), ["u.tmp", "in/v.tmp"], ["u.tmpx", "tmp"]),          # a name anywhere below
    (("", "/log"), ["log", "log/x"], ["in/log"]),                       # only in the rule's own directory
    (("in", "old/*"), ["in/old/q"], ["old/q", "in/deep/old/q/r"]),      # a path below the rule's directory
    (("in", "q?"), ["in/q1", "in/deep/qq"], ["q1", "in/q12"]),
    (("", "[xyz].md"), ["x.md", "in/z.md"], ["w.md", "xy.md"]),
    (("", "\\*lit"), ["*lit"], ["alit"]),
    (("", "\t*.csv\t"), ["a.csv"], ["a.csv2"]),                         # any white space around
    (("./", "r1"), ["r1"], ["r2"]),
    ((".", "r1"), ["in/r1"], ["in/r2"]),
    (("/in/", "/r1"), ["in/r1"], ["r1"]),
    (("", "# r1"), [], ["# r1", "r1"]),
    (("", " \t"), [], ["r1"]),
])
def test_one_rule(spark, rule, hits, misses):
    assert kept(spark, hits + misses, [rule]) == sorted(misses)


def test_rules_of_a_dot_directory_stay_there(spark):
    assert kept(spark, [".box/a.tmp", "box/a.tmp"], [(".box", "*.tmp")], include_dot=True) == ["box/a.tmp"]


def test_names_of_manifest_files_are_a_setting(spark):
    paths = [".idx", ".idx-db", ".rules", ".lakeindex", "z"]
    assert kept(spark, paths, [], include_dot=True, index_name=".idx", ignore_name=".rules") == [".lakeindex", "z"]


def test_pruning_and_report(spark):
    rows = [("cellar", "dir"), ("cellar/jam", "file"), ("cellar/crate", "dir"), ("cellar/crate/pear", "file"),
            ("cellar/crate/low/fig", "file"), (".attic", "dir"), (".attic/hat", "file"), ("hall/.lakeindex", "file"),
            ("hall/.lakeindex.d", "dir"), ("hall/mat", "file")]
    listing = spark.createDataFrame(rows, "path string, kind string")
    rules = spark.createDataFrame([("cellar", "/crate")], "dir string, pattern string")
    assert sorted(r["path"] for r in I.apply_ignore(listing, rules).collect()) == ["cellar", "cellar/jam", "hall/mat"]
    # each topmost ignored entry once, with its own kind; manifest files are not
    # reported, a directory with such a name is
    shown = sorted((r["path"], r["kind"]) for r in I.show_ignored(listing, rules).collect())
    assert shown == [(".attic", "dir"), ("cellar/crate", "dir"), ("hall/.lakeindex.d", "dir")]


def test_global_rules(spark):
    listing = spark.createDataFrame([("x/a.log",), ("x/b.txt",), ("y.log",)], "path string")
    g = spark.createDataFrame([("", "*.log"), ("", "root/x/b.txt"), ("", "/b.txt")], "dir string, pattern string")
    left = sorted(r[0] for r in I.apply_ignore(listing, None, global_rules=g, root_name="root").collect())
    assert left == []


def test_max_depth(spark):
    listing = spark.createDataFrame([("a",), ("d/b",), ("d/e/c",)], "path string")
    assert [I.max_depth(listing, n).count() for n in (1, 2, 0)] == [1, 2, 3]


def test_document_rules_fixture(spark):
    left = I.apply_ignore(FX.observed(spark, SF001), FX.rules(spark))
    assert left.count() == 165 and left.where(F.col("path").isNull()).count() == 0
