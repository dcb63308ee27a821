import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assetloom import storage
from assetloom.operators import graph, plugins
from assetloom.schemas import MODELS

EDGES = "scan_id string, source_id string, relationship string, target_id string, evidence string"


def models(spark, rows, kind="Endpoint"):
    return graph.model(spark.createDataFrame(rows, "id string, value string"), kind)


def observed(spark, rows, seq, scan="s"):
    return graph.observations(models(spark, rows), "Endpoint", scan, F.lit(seq).cast("long"))


def test_first_id_stays_and_attributes_are_the_latest(spark):
    both = observed(spark, [("1", "/a"), ("2", "/b")], 1).unionByName(observed(spark, [("9", "/a")], 2))
    nodes = {r.id: r for r in graph.store(both).collect()}
    assert set(nodes) == {"1", "2"} and '"id":"9"' in nodes["1"].attributes_json and '"id"' not in nodes["1"].natural_key
    again = graph.store(observed(spark, [("10", "/a")], 3), graph.store(both)).collect()
    assert {r.id for r in again} == {"1", "2"}
    changed = graph.store(observed(spark, [("1", "/a")], 1).unionByName(graph.observations(models(spark, [("3", "/a")]).withColumn("confidence", F.lit(5)), "Endpoint", "s", F.lit(2).cast("long"))))
    assert changed.count() == 2


def test_one_id_under_two_keys_is_an_integrity_error(spark):
    for bad in (observed(spark, [("1", "/a"), ("1", "/b")], 1), observed(spark, [("1", "/a")], 1).unionByName(observed(spark, [("1", "/a")], 1, "other"))):
        with pytest.raises(PySparkException, match="several keys"):
            graph.store(bad).collect()


def test_relate_is_insert_or_ignore_and_needs_both_ends(spark):
    nodes = graph.store(observed(spark, [("1", "/a"), ("2", "/b")], 1))
    keys = {r.id: r.natural_key for r in nodes.collect()}
    row = lambda a, b, e: ("s", "Endpoint", a, "reaches", "Endpoint", b, e)
    schema = "scan_id string, source_type string, source_key string, relationship string, target_type string, target_key string, evidence string"
    pairs = spark.createDataFrame([row(keys["1"], keys["2"], None), row(keys["1"], keys["2"], ""), row(keys["1"], keys["2"], "e")], schema)
    edges = graph.relate(nodes, pairs)
    assert sorted(map(tuple, edges.collect())) == [("s", "1", "reaches", "2", ""), ("s", "1", "reaches", "2", "e")]
    assert graph.relate(nodes, pairs, edges).count() == 2
    with pytest.raises(PySparkException, match="not stored"):
        graph.relate(nodes, spark.createDataFrame([row(keys["1"], "none", "")], schema)).collect()


def test_traversal_repeats_paths_and_stops_at_depth(spark):
    pairs = [("a", "b"), ("a", "d"), ("b", "c"), ("d", "c"), ("c", "a")]
    edges = spark.createDataFrame([("s", x, "to", y, "") for x, y in pairs] + [("t", "a", "to", "z", "")], EDGES)
    depth = lambda n: [(r.source_id, r.target_id, r.depth) for r in graph.traverse(edges, "s", "a", n).collect()]
    assert sorted(depth(1)) == [("a", "b", "1"), ("a", "d", "1")]
    assert sorted(x for x in depth(3) if x[2] == "2") == [("b", "c", "2"), ("d", "c", "2")]
    assert [x for x in depth(3) if x[2] == "3"] == [("c", "a", "3")] * 2
    assert len(depth(4)) == 10
    with pytest.raises(ValueError, match="max_depth"):
        graph.traverse(edges, "s", "a", 0)


def test_saved_edges_are_read_by_scan(spark, tmp_path):
    edges = spark.createDataFrame([(s, str(i), "to", "x", "") for s in "ab" for i in range(5)], EDGES)
    graph.save_edges(edges, f"{tmp_path}/edges")
    back = spark.read.parquet(f"{tmp_path}/edges").select(*edges.columns)
    assert graph.traverse(back, "a", "3", 2).count() == 1 and back.count() == 10
    assert "scan_id=a" in "".join(os.listdir(f"{tmp_path}/edges"))


def test_models_take_their_defaults(spark):
    for kind in MODELS:
        df = graph.model(spark.createDataFrame([("1",)], "id string"), kind)
        assert df.schema.names == MODELS[kind].names and df.count() == 1
    assert graph.model(spark.createDataFrame([("1",)], "id string"), "JavaScriptAsset").first().asset_type == "javascript"


def test_scans_are_registered_once(spark):
    one = spark.createDataFrame([("1", "t")], "id string, target string")
    assert graph.register_scan(graph.register_scan(one, one), spark.createDataFrame([("2", "t")], "id string, target string")).count() == 2


def plugin(name, needs=(), fail=False, seen=None):
    class P(plugins.Plugin):
        id, version, dependencies = name, "1", tuple(needs)

        def run(self, assets, context):
            if fail:
                raise RuntimeError
            return plugins.Result(records=[assets], warnings=["w"])

        def cleanup(self, context):
            if seen is not None:
                seen.append(name)

    return P()


def ids(found):
    return [p.id for p in found]


def test_plugin_order():
    r = plugins.Registry([plugin("dependent", ["base"]), plugin("base"), plugin("free")])
    assert ids(r.ordered()) == ["base", "dependent", "free"] and ids(r.ordered(["free"])) == ["free"]
    diamond = plugins.Registry([plugin("a", ["b", "c"]), plugin("b", ["d"]), plugin("c", ["d"]), plugin("d")])
    assert ids(diamond.ordered()) == ["d", "b", "c", "a"]
    chain = plugins.Registry([plugin(str(i), [str(i + 1)]) for i in range(5000)] + [plugin("5000")])
    assert ids(chain.ordered(["0"]))[0] == "5000"


def test_plugin_errors():
    with pytest.raises(ValueError, match="already"):
        plugins.Registry([plugin("a"), plugin("a")])
    with pytest.raises(ValueError, match="needs an id"):
        plugins.Registry([plugin("")])
    with pytest.raises(KeyError):
        plugins.Registry([plugin("a", ["x"])]).ordered()
    for cycle in ([plugin("a", ["b"]), plugin("b", ["a"])], [plugin("a", ["a"])]):
        with pytest.raises(ValueError, match="depend on each other"):
            plugins.Registry(cycle).ordered()


def test_plugin_runs(spark):
    seen = []
    r = plugins.Registry([plugin("good", seen=seen), plugin("bad", fail=True, seen=seen), plugin("after", ["bad"], seen=seen)])
    results, runs = plugins.run(r, spark.createDataFrame([("javascript",)], "type string"), plugins.Context("s"))
    assert list(results) == ["good"] and [(x.plugin_id, x.plugin_version, x.status, x.warning_count) for x in runs] == [("good", "1", "completed", 1), ("bad", "1", "failed", 0), ("after", "1", "skipped", 0)]
    assert seen == ["good", "bad"]


@pytest.mark.parametrize(("value", "fits"), [({"n": 3}, True), ({"n": 3, "s": "a"}, True), ({}, False), ({"n": 0}, False), ({"n": True}, False), ({"n": "3"}, False), ({"n": 3, "s": "c"}, False), ({"n": 3, "x": 1}, False), ({"n": 3, "l": [1, "a"]}, False), ({"n": 3, "l": [1, 2]}, True), ([], False)])
def test_configurations_are_checked(value, fits):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "minimum": 1}, "s": {"enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": ["integer", "null"]}}}}
    if fits:
        plugins.check(value, schema)
    else:
        with pytest.raises(ValueError, match="configuration"):
            plugins.check(value, schema)


def test_what_plugins_find_is_stored_and_lazy_failures_are_theirs(spark, tmp_path):
    class Finder(plugins.Plugin):
        id, version = "finder", "2"

        def run(self, assets, context):
            nodes = graph.observations(models(spark, [("1", "/a"), ("2", "/b")]), "Endpoint", context.scan_id, F.lit(1).cast("long"))
            k = {r.id: r.natural_key for r in nodes.collect()}
            pairs = spark.createDataFrame([("s", "Endpoint", k["1"], "reaches", "Endpoint", k["2"], None)], "scan_id string, source_type string, source_key string, relationship string, target_type string, target_key string, evidence string")
            return plugins.Result([nodes], [pairs], ["w"])

    class Lazy(plugins.Plugin):
        id = "lazy"

        def run(self, assets, context):
            return plugins.Result([assets.select(F.raise_error(F.lit("late")).alias("id"))])

    class Strict(plugins.Plugin):
        id = "strict"
        schema = {"type": "object", "required": ["n"]}

        def initialize(self, context):
            raise AssertionError("not with this configuration")

    assets = spark.createDataFrame([("javascript",)], "type string")
    for scans in (1, 2):
        runs = plugins.run_and_store(plugins.Registry([Lazy(), Strict(), Finder()]), assets, plugins.Context("s"), str(tmp_path))
        assert [(r.plugin_id, r.status) for r in runs] == [("lazy", "failed"), ("strict", "failed"), ("finder", "completed")] and "lacks 'n'" in runs[1].message
        t = storage.open_tables(spark, str(tmp_path))
        assert t["graph_nodes"].count() == 2 and [(r.source_id, r.target_id) for r in t["graph_edges"].collect()] == [("1", "2")]
        assert sorted((r.id, r.status, r.warning_count) for r in t["plugin_runs"].collect())[-1] == (3 * scans, "completed", 1)


def test_plugin_levels_in_a_table(spark):
    df = spark.createDataFrame([("a", ["b"]), ("b", []), ("c", ["a", "b"])], "id string, dependencies array<string>")
    assert sorted(map(tuple, plugins.order_levels(df).collect())) == [("a", 1), ("b", 0), ("c", 2)]
    with pytest.raises(ValueError, match="depend on each other"):
        plugins.order_levels(spark.createDataFrame([("a", ["b"]), ("b", ["a"])], "id string, dependencies array<string>"))


def test_a_long_chain_of_plugins_is_no_cycle(spark):
    n = 66
    df = spark.createDataFrame([(f"p{i}", [f"p{i - 1}"] if i else []) for i in range(n)], "id string, dependencies array<string>")
    assert {r.id: r.level for r in plugins.order_levels(df).collect()} == {f"p{i}": i for i in range(n)}
