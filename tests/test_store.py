"""The content-addressed store: what it returns equals the full run, whatever was edited before."""

from random import Random

from siltstone.sources import snapshot as S
from siltstone.sources import store

COLUMNS = ["path", "module", "language", "sha256", "parsed", "symbols", "calls", "usages", "names", "targets"]


def body(r):
    return "".join(f"def f{r.randint(0, 30)}(x):\n    return g{r.randint(0, 9)}(x)\n" for _ in range(r.randint(0, 3)))


def rows(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


def test_facts_equal_the_full_run_after_random_edits(spark, tmp_path):
    r, path = Random(3), str(tmp_path / "facts")
    files, seen = {f"d{i % 3}/m{i}.{('py', 'ts', 'go')[i % 3]}": body(r) for i in range(15)}, set()
    for step in range(4):
        of = S.files(spark.createDataFrame(list(files.items()), "path string, content string"))
        found = store.facts(of, path)
        assert rows(found.rows) == rows(S.facts(of))
        keys = {(x.language, x.module, x.sha256) for x in of.select("language", "module", "sha256").collect()}
        assert (found.computed, found.known) == (len(keys - seen), len(keys & seen))
        assert found.rate == (len(keys & seen) / len(keys))
        seen |= keys
        assert spark.read.parquet(path).count() == len(seen)
        for name in r.sample(sorted(files), 4):
            files[name] = body(r)
        files[f"new{step}.py"] = body(r)
        del files[r.choice(sorted(files))]


def test_known_files_reach_no_python_worker(spark, tmp_path):
    of = S.files(spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.py", "(")], "path string, content string"))
    path = str(tmp_path / "facts")
    assert store.facts(of, path).computed == 2
    again = store.facts(of, path)
    plan = again.rows._jdf.queryExecution().executedPlan().toString()
    assert (again.computed, again.known, again.rate) == (0, 2, 1.0) and "Python" not in plan and "Arrow" not in plan
    assert len([f for f in (tmp_path / "facts").rglob("*.parquet")]) == 1  # nothing was appended


def test_one_content_in_many_places_is_read_once(spark, tmp_path):
    of = spark.createDataFrame([(i, "same" if i % 3 else None if i == 9 else f"t{i}") for i in range(30)], "i int, t string")
    found = store.reused(of, ["t"], lambda x: x.selectExpr("t", "length(t) as n"), str(tmp_path / "n"))
    assert (found.computed, found.rows.count()) == (10, 29) and {r.n for r in found.rows.collect()} == {2, 3, 4}
    none = store.reused(of.limit(0), ["t"], lambda x: x.selectExpr("t", "length(t) as n"), str(tmp_path / "none"))
    assert (none.computed, none.known, none.rate, none.rows.count()) == (0, 0, 1.0, 0)
