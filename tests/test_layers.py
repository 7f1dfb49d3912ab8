"""Layer texts: what is read from them, what an upgrade writes."""

import itertools

import pytest
from pyspark.sql import functions as F

from assetloom.operators import graph, scene
from assetloom.sources.layers import attributes, layer_items, read_layer

TEXT = '''#usda 1.0
(
    defaultPrim = "World"  # a comment with { and "
    subLayers = [
        @./a.usd@ (offset = 1),
        @b.usda@
    ]
    customLayerData = { string x = "} @no@" asset y = @not.usd@ }
)

def Xform "World" (
    doc = """text { with
    @nothing@ and "quotes" """
    prepend references = @./x.usd@</P> (offset = 3)
    references = </Internal>
    append payload = [ @p1.usd@, @@@p@2.usd@@@</Q> ]
    variants = { string v = "a" }
    prepend variantSets = "v"
)
{
    custom float2 inputs:texture_scale = (1, 2.5)
    float plain
    uniform token info:id = "x" (
        doc = "a ) b"
    )
    asset inputs:diffuse = @./t.png@
    float3[] pts = [(1,2,3), (4,5,6)]
    double time.timeSamples = { 0: 1, 1: 2 }
    reorder nameChildren = ["a", "b"]
    def Shader "S" (
        delete references = @gone.usd@
    )
    {
        int inputs:texture_scale = 3 (
            connectability = "interfaceOnly"
        )
    }
    variantSet "v" = {
        "a" (
            add references = @va.usd@
        ) {
            over "K" { half inputs:texture_scale = -1.5e-1
            }
        }
        "b" { float inputs:texture_scale = None
        }
    }
    float after = 1; float second = 2
}
class "C" { string inputs:texture_scale = "a" }
'''


def test_items_of_a_layer():
    items = read_layer(TEXT)
    arcs = [(i[0], i[1], i[4], i[5]) for i in items if i[0] != "attribute"]
    assert arcs == [
        ("sublayer", "", "explicit", "./a.usd"), ("sublayer", "", "explicit", "b.usda"), ("reference", "/World", "prepend", "./x.usd"), ("payload", "/World", "append", "p1.usd"),
        ("payload", "/World", "append", "p@2.usd"), ("reference", "/World/S", "delete", "gone.usd"), ("reference", "/World{v=a}", "add", "va.usd"),
    ]
    scales = {i[1]: (i[3], i[5]) for i in items if i[2] == "inputs:texture_scale"}
    assert scales == {"/World": ("float2", "(1, 2.5)"), "/World/S": ("int", "3"), "/World{v=a}/K": ("half", "-1.5e-1"), "/World{v=b}": ("float", None), "/C": ("string", '"a"')}
    names = [i[2] for i in items if i[0] == "attribute" and i[1] == "/World"]
    assert names == ["inputs:texture_scale", "plain", "info:id", "inputs:diffuse", "pts", "time.timeSamples", "after", "second"]
    for item in items:  # places in the text
        assert item[8] is None or item[5] is None or TEXT[item[8] : item[9]] == item[5]
        assert item[6] is None or TEXT[item[6] : item[7]] == item[3]


def test_broken_texts_end():
    """Whatever is cut off or put in: the reader comes to an end, and what stands before is read as before."""
    whole = read_layer(TEXT)
    for cut in range(0, len(TEXT), 7):
        found = read_layer(TEXT[:cut])
        sure = [i for i in whole if max(x for x in i[6:] if x is not None) < cut - 40]
        assert found[: len(sure)] == sure or '"""' in TEXT[cut - 120 : cut]
    for noise in itertools.product("{}()[]=@\"'<#\n x", repeat=3):
        read_layer("".join(noise) + 'def "A" {')


def test_deep_nesting():
    depth = 3000
    text = "".join(f'def "p{i}" {{\n' for i in range(depth)) + "int v = 1\n" + "}" * depth
    (item,) = read_layer(text)
    assert item[1].count("/") == depth


def test_attribute_values(spark):
    values = ["3", "-1.5e-1", "(1, 2)", "( 1.5 ,-2e3 )", '"x"', "(1, 2, 3)", "[1]", ".5", "None", "@a@"]
    text = "\n".join(f'def "p{i}" {{\nfloat s = {v}\n}}' for i, v in enumerate(values))
    rows = {r["prim"]: (r["x"], r["y"]) for r in attributes(layer_items(spark.createDataFrame([("l", text)], "layer string, value string")), "s").collect()}
    assert [rows[f"/p{i}"] for i in range(len(values))] == [(3, None), (-0.15, None), (1, 2), (1.5, -2000), (None, None), (None, None), (None, None), (0.5, None), (None, None), (None, None)]


def layer(scale=None, *arcs, kind="float"):
    named = ", ".join(f"@{a}@" for a in arcs)
    body = f'def "M" {{ {kind} inputs:texture_scale = {scale} }}' if scale is not None else ""
    return f"#usda 1.0\n(\n subLayers = [{named}]\n)\n{body}\n# ü @b.usd@\n"


LAYERS = {
    "s/root.usd": layer(None, "./a.usd", "b.usd"),
    "s/a.usd": layer(None, "sub/c.usd", "./sub/c.usd", "gone.usd"),
    "s/b.usd": layer(None, "t.png"),
    "s/sub/c.usd": layer("2", "../a.usd"),  # a cycle
    "s/d.usd": layer("(4, 4)", "a.usd", kind="float2"),  # the root doesn't lead here
    "s/e.usd": layer('"x"', kind="string"),
    "s/empty.usd": "",
    "s/null.usd": None,
}


def upgraded(spark, **options):
    texts = spark.createDataFrame(list(LAYERS.items()), "layer string, value string").withColumns({"kind": F.lit(1), "edits": F.lit(2)})
    return {r["layer"]: r for r in scene.upgrade(texts, **options).collect()}


def test_copies_name_each_other(spark):
    root = spark.createDataFrame([("s/root.usd",)], "node string")
    found = upgraded(spark, root=root, suffix="_5")
    assert set(found) == {"s/root.usd", "s/a.usd", "s/sub/c.usd"}
    assert {k: (r["target"], r["fixed"], r["rewrote"]) for k, r in found.items()} == {"s/root.usd": ("s/root_5.usd", 0, 1), "s/a.usd": ("s/a_5.usd", 0, 2), "s/sub/c.usd": ("s/sub/c_5.usd", 1, 1)}
    assert found["s/root.usd"]["value"] == layer(None, "./a_5.usd", "b.usd")
    assert found["s/a.usd"]["value"] == layer(None, "sub/c_5.usd", "./sub/c_5.usd", "gone.usd")
    assert found["s/sub/c.usd"]["value"] == layer("(2, 2)", "../a_5.usd", kind="float2")
    dry = upgraded(spark, root=root, suffix="_5", dry_run=True)
    assert {k: tuple(r) for k, r in dry.items()} == {k: tuple(r)[:4] for k, r in found.items()}


def test_in_place(spark):
    found = upgraded(spark, scale=3.0)
    assert {k: (r["target"], r["fixed"], r["rewrote"], r["value"]) for k, r in found.items()} == {"s/sub/c.usd": ("s/sub/c.usd", 1, 0, layer("(6, 6)", "../a.usd", kind="float2")), "s/d.usd": ("s/d.usd", 1, 0, layer("(12, 12)", "a.usd", kind="float2"))}
    assert set(upgraded(spark)) == {"s/sub/c.usd"}  # the pair is at its target already
    assert upgraded(spark, override=4.0)["s/sub/c.usd"]["value"] == layer("(4, 4)", "../a.usd", kind="float2")


def test_pairs_at_their_target_still_get_copies(spark):
    """A layer that holds the attribute is copied, also if nothing in it changes but its name."""
    found = upgraded(spark, suffix="_5", override=4.0)
    assert (found["s/d.usd"]["fixed"], found["s/d.usd"]["rewrote"]) == (0, 1) and found["s/d.usd"]["value"] == layer("(4, 4)", "a_5.usd", kind="float2")


def test_no_layers(spark):
    none = spark.createDataFrame([], "layer string, value string")
    assert scene.upgrade(none, suffix="_5").collect() == [] and graph.layer_edges(layer_items(none)).collect() == []


@pytest.mark.parametrize("most", [1, 3, 1_000_000])
def test_triangles_of_whole_batches(spark, most):
    """Whatever goes into one batch: odd counts, nulls, corners that aren't there."""
    meshes = [(1, [0, 1, 2, 3, 5, 6, 7], [4, 3]), (2, None, [3]), (3, [1, 2, 3], None), (4, [], []), (5, [9, 8], [2]), (6, [1, 2, 3, 4], [2, None, 3, -1, 0]), (7, list(range(10)), [10]), (None, [1, 2, 3], [3]), (8, [4, 5, 6, 7], [1, 3])]
    rows = spark.createDataFrame(meshes, "mesh int, indices array<long>, counts array<int>").repartition(2)
    expected = []
    for mesh, indices, counts in meshes:
        at, indices = 0, indices or []
        for face, n in enumerate(counts or []):
            n = max(n or 0, 0)
            for k in range(1, n - 1):
                expected.append((mesh, face, *(indices[at + j] if at + j < len(indices) else None for j in (0, k, k + 1))))
            at += n
    assert sorted(map(tuple, scene.triangles(rows, most).collect()), key=str) == sorted(expected, key=str)
