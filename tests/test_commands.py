"""Every command over the index of a small tree: it runs, and the telling ones give what they must."""

import pytest

from lexispan.plans.build import Store
from lexispan.plans.commands import COMMANDS, Index, run
from test_build import TREE, contents

ARGS = {"callers": ["load"], "call-tree": ["load"], "provides": ["Repo"], "inject": ["Repo"], "annotations": ["Inject"], "extensions": ["String"], "search": ["Repo"], "file": ["repo"], "symbol": ["Rep"], "class": ["RealRepo"], "implementations": ["Repo"], "hierarchy": ["Repo"], "refs": ["RealRepo"], "usages": ["RealRepo"], "module": ["co"], "deps": ["app"], "dependents": ["core"], "api": ["core"], "resource-usages": ["@string/a"], "asset-usages": ["x"], "outline": ["core/src/Repo.kt"], "imports": ["core/src/Repo.kt"], "query": ["SELECT kind, count(*) AS n FROM symbols GROUP BY kind"]}
WANT = {"callers": 1, "call-tree": 1, "class": 1, "implementations": 1, "deps": 2, "dependents": 1, "unused-deps": 2, "xml-usages": 1, "api": 3, "file": 1, "outline": 3}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    tree = contents(spark, {k: v for k, v in TREE.items() if "node_modules" not in k}).cache()
    store = Store(spark, f"file://{tmp_path_factory.mktemp('index')}")
    store.rebuild(tree)
    return Index(store, tree)


@pytest.mark.parametrize("name", sorted(set(COMMANDS) - {"changed"}))
def test_command(name, index):
    rows = run(index, name, *ARGS.get(name, [])).collect()
    if name in WANT:
        assert len(rows) == WANT[name], rows


def test_changed(index, spark):
    assert run(index, "changed", spark.createDataFrame([("core/src/Repo.kt",)], "path string")).count() == 3


def test_unused_deps(index):
    got = {(r.module, r.dependency): r.verdict for r in run(index, "unused-deps").collect()}
    assert got == {("app", "core"): "used_direct", ("app", "ui"): "exported"}


def test_json(index):
    import json

    rows = [json.loads(r.json) for r in run(index, "class", "RealRepo", as_json=True).collect()]
    assert [(r["name"], r["kind"], r["path"]) for r in rows] == [("RealRepo", "class", "core/src/Repo.kt")]
