"""What must not grow with the input: broadcasts of listings, rows of one task, looks at what is present."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from assetloom import workload
from assetloom.operators import files, hierarchy, integrity, textures
from assetloom.sources import layers
from assetloom.sources.shared import dealt

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(capsys):
    def of(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    return of


def test_listings_are_not_broadcast(spark, plan):
    """Their size is guessed by the small file that they are made of."""
    listed, texts = workload.kind_files(spark, SF, "road"), workload.kind_texts(spark, SF, "road")
    mapping = files.material_map(listed, "road")
    plants, unpacked = workload._plants(spark, SF, "tree")
    for found in (
        files.load_materials(mapping, listed, "road", listed.select("name")), textures.channel_urls(texts, listed, "material_road_mdl", "http://h"), hierarchy.unknown_names(listed, mapping),
        files.load_vegetation(files.vegetation_map(plants, "tree"), unpacked, "tree"), workload.preview_textures(spark, SF), workload.bound_textures(spark, SF), integrity.status(*workload.eleven_kinds(spark, SF)[:2]),
    ):
        assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)


def test_rows_are_dealt_before_they_grow(spark, monkeypatch):
    assert dealt(spark.range(45).coalesce(1), "id", most=10).rdd.getNumPartitions() == 5
    assert dealt(spark.range(0), "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(workload, "dealt", partial(dealt, most=50))
    for made in (workload.scaled_layers, workload.layer_edges, workload.material_files, workload.plant_files, partial(workload.kind_files, kind="sky")):
        rows = made(spark, SF)
        if made is not workload.layer_edges:
            assert rows.rdd.getNumPartitions() == 4


def test_sorts_of_flattened_lists_are_bounded(spark, plan, monkeypatch):
    monkeypatch.setattr(workload, "dealt", lambda rows, *keys, most: dealt(rows, *keys, most=most // 500))
    assert "hashpartitioning(l_orderkey" in (found := plan(workload.catalog_flatten(spark, SF))) and "6), REPARTITION_BY_NUM" in found


def test_items_of_small_layers_share_batches(spark):
    """In each batch that goes out are the items of many layers, but of no more than fill it."""
    import pyarrow as pa

    texts = [(f"l{i}", 'def "A" { int a = 1; int b = 2 }') for i in range(30)] + [("none", None), ("empty", "")]

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, work, schema):  # noqa: N802
            return list(work(iter([pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*texts, strict=True)], ["layer", "value"])])))

    (batch,) = layers.layer_items(Rows())
    assert batch.num_rows == 60 and batch.column(0).to_pylist() == [f"l{i // 2}" for i in range(60)]
    assert layers.layer_items(spark.createDataFrame(texts, "layer string, value string")).count() == 60


def test_rows_without_a_path_are_kept_and_spread(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else f"p{i % 8}") for i in range(40)], "key long, path string")
    found = files.looked_up(rows, spark.createDataFrame([("p0",), ("\n1",)], "there string"), "path", "there", "key")
    assert {(r["key"], r["there"]) for r in found.collect()} == {(i, "p0" if i % 8 == 0 else None) for i in range(40)} and found.columns == ["key", "path", "there"]


def test_unknown_names_with_null(spark):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in hierarchy.unknown_names(rows("b", "a", None, "a", "c"), rows("c", None, "d")).collect()] == ["a", "b"]
    assert [r[0] for r in hierarchy.unknown_names(rows("a", None), rows("a")).collect()] == [None]


def test_a_repair_looks_once_at_what_is_there(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(integrity, "written", lambda df, label, f=integrity.written: labels.append(label) or f(df, label))
    assert workload.repair_report(spark, SF).where("kind is null").select(F.col("expected") > 0).first()[0]
    assert len(labels) == 2
