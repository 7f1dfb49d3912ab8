"""Catalog operators on made-up documents with the awkward cases: nulls, wrong types, repeats, missing files."""

import io
import json
import math
import tarfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetloom.functions import predicates as P
from assetloom.functions import vectors as V
from assetloom.functions.paths import render_name, renamed, stem, without_archive_suffix, without_leading_dots
from assetloom.functions.textures import channels, preview_channel, texture_kind
from assetloom.operators import documents, files, graph, hierarchy, integrity, scene, show, similarity, textures
from assetloom.plans.query import PARAMETERS, AssetQuery, attribute_predicates
from assetloom.schema import ASSET_FIELDS, explain_field
from assetloom.sources import catalog, transfer
from assetloom.streaming import archives
from assetloom.streaming.archives import unpack_arriving

MASTER = {
    "about": {"version": "1", "license": "none"},
    "statistics": {"number_of_assets": 7, "number_of_classes_l1": 2, "number_of_classes_l2": 2, "number_of_classes_l3": 4},
    "annotation": {
        "bench": {"class_name_l1": "Street", "class_name_l2": "furniture", "class_name_l3": "bench", "class_id_l1": 1, "asset_uids": ["a1", "a2", "a7"], "asset_count": 3},
        "cone": {"class_name_l1": "Street", "class_name_l2": "furniture", "class_name_l3": "traffic cone", "asset_uids": ["a3", "a1"], "asset_count": 2},
        "car": {"class_name_l1": "Vehicle", "class_name_l2": "car", "class_name_l3": "Car", "asset_uids": ["a4", "a5", "a6"], "asset_count": 3},
        "street": {"class_name_l1": "Vehicle", "class_name_l2": "car", "class_name_l3": "street", "asset_uids": [], "asset_count": 0},
    },
}
ASSETS = [
    {"uid": "a1", "category": "bench", "height": 0.85, "movable": True, "materials": ["Wood", "steel"], "affordances": ["sittable"], "surface_finish": "matte", "description": "a bench", "attribute_seats": "3"},
    {"uid": "a2", "category": "bench", "height": 1.2, "materials": [], "affordances": [], "attribute_seats": "2", "attribute_age": "old"},
    {"uid": "a3", "category": "traffic cone", "height": 1.2, "movable": False, "materials": [None, "plastic"], "affordances": [None], "surface_finish": "GLOSSY"},
    {"uid": "a4", "category": "car", "height": math.nan, "movable": True, "materials": ["steel"], "affordances": ["drivable", "Sittable"], "surface_finish": "glossy"},
    {"uid": "a5", "category": "car", "height": "2", "movable": True, "materials": "steel", "affordances": ["drivable"], "surface_finish": "smooth"},
    {"uid": "a7", "category": "bench", "height": 0.5, "movable": True, "materials": ["wood"], "affordances": ["sittable"], "surface_finish": "matte", "description_long": "long", "near_synsets": {"seat.n.01": 0.5}},
]


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("catalog")
    (root / "master.json").write_text(json.dumps(MASTER, indent=1))
    (root / "assets").mkdir()
    for a in ASSETS:
        (root / "assets" / f"std_{a['uid']}.json").write_text(json.dumps(a))
    (root / "assets" / "._std_a1.json").write_text("junk")
    with tarfile.open(root / "bundle.tar.gz", "w:gz") as archive:
        for name, text in [(f"pre/std_{a['uid']}.json", json.dumps(a)) for a in ASSETS] + [("pre/._std_a1.json", "junk"), ("pre/read.me", "x")]:
            entry = tarfile.TarInfo(name)
            entry.size = len(text)
            archive.addfile(entry, io.BytesIO(text.encode()))
    for kind in catalog.ASSET_TYPES:
        (root / f"{kind}.json").write_text(json.dumps({a["uid"]: f"{kind}_flat/bucket_1/std_{a['uid']}.x" for a in ASSETS if (kind, a["uid"]) != ("glb", "a2")}))
    return root


@pytest.fixture(scope="module")
def bridge(spark, home):
    return catalog.asset_category(catalog.category_dim(catalog.master(spark, f"{home}/master.json"))).cache()


@pytest.fixture(scope="module")
def assets(spark, home):
    return catalog.asset_documents(spark, f"{home}/assets").cache()


@pytest.fixture(scope="module")
def index(spark, home):
    return catalog.bucket_index(spark, {k: f"{home}/{k}.json" for k in catalog.ASSET_TYPES}).cache()


def column(df, name="uid"):
    return [r[name] for r in df.collect()]


def test_master_and_hierarchy(spark, home, bridge):
    row = catalog.info(catalog.master(spark, f"{home}/master.json")).first()
    assert row.version == "1" and row.statistics.number_of_assets == 7
    assert column(hierarchy.all_uids(bridge)) == ["a1", "a2", "a7", "a3", "a1", "a4", "a5", "a6"]
    assert {r.name: r.uids for r in hierarchy.by_level(bridge, 1).collect()} == {"Street": ["a1", "a2", "a7", "a3", "a1"], "Vehicle": ["a4", "a5", "a6"]}
    assert {r.name: r.n for r in hierarchy.counts(bridge, 3).collect()} == {"bench": 3, "traffic cone": 2, "Car": 3}
    assert sorted(column(hierarchy.in_categories(bridge, ["STREET"]))) == ["a1", "a2", "a3", "a7"]
    assert column(hierarchy.in_categories(bridge, [])) == []
    assert catalog.statistics(bridge).first().number_of_assets == 7
    top = {(r.l1, r.level): r.n for r in hierarchy.distribution(bridge, "l1").collect()}
    assert top == {("Street", 0): 5, ("Vehicle", 0): 3, (None, 1): 8}
    for level in (0, 4):
        with pytest.raises(ValueError):
            hierarchy.by_level(bridge, level)
        with pytest.raises(ValueError):
            hierarchy.counts(bridge, level)
    known = bridge.select(F.col("l3").alias("name"))
    with pytest.raises(ValueError, match="bike"):
        hierarchy.check_names(spark.createDataFrame([("bench",), ("bike",)], "name string"), known)
    hierarchy.check_names(known, known)


def test_assets_keep_other_fields_where_one_is_of_a_wrong_type(spark, home, assets):
    rows = {r.uid: r for r in assets.collect()}
    assert set(rows) == {"a1", "a2", "a3", "a4", "a5", "a7"}
    assert rows["a5"].height is None and rows["a5"].materials is None and rows["a5"].surface_finish == "smooth"
    assert rows["a2"].attributes == {"attribute_seats": "2", "attribute_age": "old"} and rows["a3"].attributes == {}
    assert rows["a7"].near_synsets == {"seat.n.01": 0.5}
    members = catalog.bundle_members(spark, f"{home}/bundle.tar.gz")
    assert sorted(column(members, "name")) == sorted(f"std_{a['uid']}.json" for a in ASSETS)
    stored = catalog.ingest_assets(members, f"{home}/stored")
    assert {r.uid: r.dominant_materials_lc for r in stored.collect()} == {"a1": "wood", "a2": None, "a3": "none", "a4": "steel", "a5": None, "a7": "wood"}
    texts = spark.read.text(f"{home}/assets", wholetext=True, pathGlobFilter="*.json")
    bad = {r.field: r.unreadable for r in catalog.quality_counts(texts).where("unreadable > 0").collect()}
    assert bad["materials"] == 1 and bad["height"] >= 1
    assert {r.name: r.n for r in catalog.attribute_names(assets).collect()} == {"attribute_seats": 2, "attribute_age": 1}


def test_schema_doc(spark):
    assert explain_field(spark).count() == len(ASSET_FIELDS) + 1
    assert column(explain_field(spark, "mass"), "type") == ["double"]
    assert column(explain_field(spark, "attribute_seats"), "field") == ["attribute_*"]
    with pytest.raises(ValueError):
        explain_field(spark, "colour")


CASES = [
    ({"height_range": (0.5, 1.2)}, "a1 a2 a3 a7"),
    ({"height_range": (-math.inf, math.inf)}, "a1 a2 a3 a7"),
    ({"movable": False}, "a2 a3"),
    ({"movable": True}, "a1 a4 a5 a7"),
    ({"affordances": ["SITTABLE"]}, "a1 a4 a7"),
    ({"affordances": ["none"]}, "a3"),
    ({"affordances": []}, ""),
    ({"affordances": None}, "a1 a2 a3 a4 a5 a7"),
    ({"dominant_materials": ["wood"]}, "a1 a7"),
    ({"dominant_materials": ["none"]}, "a3"),
    ({"surface_finish": ["Glossy"]}, "a3 a4"),
    ({"surface_finish": ["matte"], "height_range": (0, 0.6)}, "a7"),
]


@pytest.mark.parametrize("filters,expected", CASES)
def test_filters(bridge, assets, filters, expected):
    found = AssetQuery(bridge, assets).in_categories(["street", "vehicle"]).where(**filters).uids()
    expected = expected.split() + (["a6"] if filters.get("affordances", 0) is None else [])
    assert sorted(column(found)) == sorted(expected)


def test_query_plans_and_ranking(spark, bridge, assets, capsys):
    vectors = spark.createDataFrame([("a1", [1.0, 0.0], [1.0, 0.0]), ("a2", [0.0, 1.0], [1.0, 0.0]), ("a3", [0.0, 1.0], [1.0, 0.0]), ("a4", [math.nan, 0.0], [0.0, 0.0]), ("a6", [1.0, 0.0], [1.0, 0.0]), ("a7", None, [1.0, 0.0])], "uid string, short array<double>, long array<double>")
    query = AssetQuery(bridge, assets, vectors)
    ranked = query.in_categories(["Street", "Vehicle"]).similar_to([1.0, 0.0], None).uids().collect()
    assert [(r.uid, r.score) for r in ranked[:4]] == [("a1", 1.0), ("a2", 0.5), ("a3", 0.5), ("a7", 0.5)] and ranked[4].uid == "a4" and len(ranked) == 5
    assert column(query.in_categories(["street"]).similar_to([1.0, 0.0], 2).uids()) == ["a1", "a2"]
    assert column(query.similar_to([1.0, 0.0], 0).uids()) == []
    assert len(column(query.similar_to([1.0, 0.0], 3).uids())) == 3  # without categories repeats stay
    with pytest.raises(ValueError):
        query.similar_to([1.0], -1)
    with pytest.raises(ValueError):
        query.where(colour="red")
    assert len(PARAMETERS) == 26 and attribute_predicates(movable=None) == []
    with pytest.raises(ValueError):
        similarity.top_k(assets, -1)
    with pytest.raises(ValueError):
        similarity.clamped_top_k(assets, None)
    query.in_categories(["street"]).similar_to([1.0, 0.0], 2).uids().explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_scan_plans(spark, capsys):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    table.where(P.in_range(F.col("label"), (2, 5))).select("vec_id").explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(label,2)" in plan and "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.fixture(scope="module")
def stored(spark, home):
    return catalog.ingest_assets(spark.read.text(f"{home}/assets", wholetext=True, pathGlobFilter="*.json"), f"{home}/stored_assets")


@pytest.mark.parametrize("filters,expected", CASES)
def test_filters_on_stored_assets(bridge, stored, filters, expected):
    """The same answers from the shadow columns."""
    found = AssetQuery(bridge, stored).in_categories(["street", "vehicle"]).where(**filters).uids()
    assert sorted(column(found)) == sorted(expected.split() + (["a6"] if filters.get("affordances", 0) is None else []))


PUSHED = [
    ({"height_range": (0.5, 1.2)}, ["GreaterThanOrEqual(height,0.5)", "LessThanOrEqual(height,1.2)", "IsNotNull(height)"]),
    ({"movable": True}, ["EqualNullSafe(movable,true)"]),
    ({"movable": False}, ["IsNull(movable)", "EqualNullSafe(movable,false)"]),
    ({"affordances": ["Sittable"]}, ["IsNotNull(affordances)"]),
    ({"dominant_materials": ["Wood", "x"]}, ["In(dominant_materials_lc, [wood,x])"]),
    ({"surface_finish": ["Glossy"]}, ["EqualTo(surface_finish_lc,glossy)"]),
]


@pytest.mark.parametrize("filters,wanted", PUSHED)
def test_filters_reach_the_scan(bridge, stored, capsys, filters, wanted):
    AssetQuery(bridge, stored).where(**filters).uids().explain("formatted")
    pushed = "".join(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    for part in wanted:
        assert part in pushed, pushed


def test_query_filters_reach_the_scan(spark, capsys):
    from assetloom import workload

    workload.queries()["range_filter"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert all(part in plan.split("PushedFilters")[1].split("\n")[0] for part in ("GreaterThanOrEqual(l_quantity,10.0)", "LessThanOrEqual(l_discount,0.07)", "LessThanOrEqual(l_extendedprice,30000.0)"))
    workload.queries()["asset_query"](spark, "/root/testdata/sf0.001").explain("formatted")
    assert "GreaterThanOrEqual(p_retailprice,900.0)" in capsys.readouterr().out


values = st.one_of(st.none(), st.sampled_from(["Wood", "wood", "NONE", "None", "steel", "é", "É"]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.lists(values, max_size=3)), st.one_of(st.none(), st.floats(-3, 3), st.just(math.nan)), st.one_of(st.none(), st.booleans()), values), min_size=1, max_size=8), st.lists(values, max_size=3), st.tuples(st.floats(-3, 3), st.floats(-3, 3)))
def test_kernels_equal_plain_python(spark, rows, wanted, bounds):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<string>, x double, b boolean, s string")
    lower = {str(w).lower() for w in wanted}
    text = lambda v: str(v).lower()
    got = df.orderBy("i").select(*map(P.shown, (P.any_of(F.col("l"), wanted), P.dominant_in(F.col("l"), wanted), P.one_of(F.col("s"), wanted), P.in_range(F.col("x"), bounds), P.flag_is(F.col("b"), False)))).collect()
    for r, (l, x, b, s) in zip(got, rows, strict=True):
        assert tuple(r) == (any(text(v) in lower for v in l or []), bool(l) and text(l[0]) in lower, s is not None and text(s) in lower, x is not None and bounds[0] <= x <= bounds[1], not b)


def test_search_box_and_small_kernels(spark):
    df = spark.createDataFrame([("Red Car",), ("blue car",), (None,)], "name string")
    assert hierarchy.search(df, P.contains_text(F.col("name"), " CAR ")).first() == (2, 3)
    assert hierarchy.search(df, P.contains_text(F.col("name"), " ")).first() == (3, 3)
    row = spark.range(1).select(stem(F.lit("a.b.c")).alias("a"), without_archive_suffix(F.lit("x.tgz")).alias("b"), renamed(F.lit("d/x.usd"), "_5").alias("c"), render_name(F.lit(90)).alias("d"), without_leading_dots(F.lit(".././t")).alias("e"), V.cosine(V.literal([0, 0]), V.literal([1, 2])).alias("f"), V.norm(V.unit(V.literal([3, 4]))).alias("g"), P.near(F.lit(1.0), F.lit(1.0 + 1e-10)).alias("h")).first()
    assert tuple(row) == ("a", "x", "d/x_5.usd", "render_90.0.jpg", "t", 0.0, pytest.approx(1.0), True)


def test_load_operators(spark, index, assets):
    uids = spark.createDataFrame([("a1",), ("a2",), ("a1",), ("zz",), ("a3",)], "uid string")
    present = spark.createDataFrame([("glb_flat/bucket_1/std_a1.x",), ("assets/std_a2.json",), ("annotation_flat/bucket_1/std_a1.x",), ("assets/std_a1.json",)], "path string")
    rows = {r.uid: r for r in files.load(uids, index, present).collect()}
    assert set(rows) == {"a1", "a2", "a3", "zz"}
    assert rows["a1"].glb == "glb_flat/bucket_1/std_a1.x" and rows["a1"].annotation == "annotation_flat/bucket_1/std_a1.x" and rows["a2"].annotation == "assets/std_a2.json" and rows["zz"].glb is None
    assert {r.uid: r.path for r in files.load_one(uids, index, present, "glb").collect()}["a3"] is None
    assert sorted(column(files.resolve(uids, index, "glb"))) == ["a1", "a3"]
    assert sorted(column(files.annotations(uids, assets))) == ["a1", "a2", "a3", "zz"] and sorted(column(files.annotations(uids, assets, False))) == ["a1", "a2", "a3"]
    with pytest.raises(ValueError):
        files.load(uids, index, present, ["video"])
    folders = spark.createDataFrame([("a1", "r/a1")], "uid string, folder string")
    there = spark.createDataFrame([("r/a1/render_90.0.jpg",)], "path string")
    found = {r.uid: r.renders for r in files.renders(uids, folders, there, (0, 90)).collect()}
    assert found["a1"] == {0: None, 90: "r/a1/render_90.0.jpg"} and found["zz"] == {0: None, 90: None}
    with pytest.raises(ValueError):
        files.renders(uids, folders, there, (45,))
    strip = documents.image_strip(files.renders(uids, folders, there))
    assert [tuple(r) for r in strip.collect()] == [("a1", 90, "r/a1/render_90.0.jpg")]


def test_batches_pages_and_numbers(spark):
    rows = spark.range(10).select(F.col("id").alias("path"))
    assert [r.batch for r in files.batches(rows, ["path"], 4).orderBy("path").collect()] == [0] * 4 + [1] * 4 + [2] * 2
    assert [r.pos for r in catalog.numbered(rows).orderBy("path").collect()] == list(range(10))
    assert tuple(files.page(rows, "path", 99).first()) == (9, 10, 10, True, False)
    assert tuple(files.page(rows, "path", -3).first()) == (0, 1, 10, False, True)


def test_materials_and_vegetation(spark):
    listed = spark.createDataFrame([(p,) for p in ("material_road_mdl/X.mdl", "material_road_mdl/X.mdl.png", "material_road_mdl/textures/t_diff.png", "material_road_thumbnail/X.png", "material_road_thumbnail/Only.png", "material_road_mdl/Bare.txt", "collected_trees/American_Beech.tar.gz", "collected_trees/deep/Oak.tar.gz", "collected_trees/readme.md")], "path string")
    mapping = files.material_map(listed, "road")
    rows = {r.name: r for r in mapping.collect()}
    assert set(rows) == {"X", "Only", "Bare"} and rows["X"].main_files == ["material_road_mdl/X.mdl", "material_road_mdl/X.mdl.png"] and rows["Only"].main_files == [] and rows["Bare"].thumbnail is None
    assert column(files.names(mapping), "name") == ["Bare", "Only", "X"]
    none = spark.createDataFrame([], "name string")
    assert column(files.material_request(mapping, listed, "road", none), "path") == ["material_road_mdl/textures/t_diff.png"]
    assert sorted(column(files.material_request(mapping, listed, "road", what=["thumbnail"]), "path")) == ["material_road_thumbnail/Only.png", "material_road_thumbnail/X.png"]
    with pytest.raises(ValueError):
        files.material_request(mapping, listed, "road", what=["hdr"])
    loaded = {r.name: (r.main, r.thumbnail) for r in files.load_materials(mapping, listed, "road").collect()}
    assert loaded == {"X": ("material_road_mdl/X.mdl", "material_road_thumbnail/X.png"), "Only": (None, "material_road_thumbnail/Only.png"), "Bare": ("material_road_mdl/Bare.txt", None)}
    trees = files.vegetation_map(listed, "tree")
    assert [tuple(r) for r in trees.collect()] == [("American_Beech", "collected_trees/American_Beech.tar.gz")]
    present = spark.createDataFrame([("collected_trees/American_Beech/a.usd",)], "path string")
    assert tuple(files.load_vegetation(trees, present, "tree").first()) == ("American_Beech", "collected_trees/American_Beech", "collected_trees/American_Beech/a.usd")
    document = json.loads(documents.gathered(documents.material_items(files.load_materials(mapping, listed, "road"), "http://h/"), "Road").first()[0])
    assert [i["name"] for i in document["items"]] == ["Bare", "Only", "X"] and document["items"][1]["url"] is None


def test_textures(spark):
    refs = ["./textures/Wall_diff.png", "X_ORM.png", "X_multi_rough_ao.png", "X_mask.png", "platform.png", "what.png", "a_norm_diff.png", "x_rou.jpg"]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    kinds = [x.k for x in df.select(texture_kind(F.col("r")).alias("k")).collect()]
    assert kinds == ["diffuse", "orm", "ao", "mask", "orm", "unknown", "diffuse", "roughness"]
    fed = [x.c for x in df.select(channels(F.lit("multi"), F.col("r")).alias("c")).collect()]
    assert fed[2] == ["roughness", "ao"] and fed[0] == []
    text = 'diffuse_texture: texture_2d("./t/W_diff.png", x)\nn: texture_2d( "t/Gone_norm.png")\nd: texture_2d("./t/W_diff.png")\no : texture_2d("t/W_ORM.png") basecolor: texture_2d("t/Other_diff.png")'
    texts = spark.createDataFrame([("W", text), ("E", "")], "name string, value string")
    assert [(r.pos, r.ref) for r in textures.references(texts).orderBy("pos").collect()] == [(0, "./t/W_diff.png"), (1, "t/Gone_norm.png"), (3, "t/W_ORM.png"), (4, "t/Other_diff.png")]
    present = spark.createDataFrame([(f"m/t/{n}",) for n in ("W_diff.png", "W_ORM.png", "Other_diff.png")], "path string")
    maps = {r.name: r.textures for r in textures.channel_urls(texts, present, "m", "http://h").collect()}
    assert maps == {"W": {"diffuse": "http://h/m/t/W_diff.png", "roughness": "http://h/m/t/W_ORM.png", "ao": "http://h/m/t/W_ORM.png"}, "E": {}}
    previews = {r.name: (r.diffuse, r.normal) for r in textures.preview_textures(texts, present, "m").collect()}
    assert previews == {"W": ("m/t/W_diff.png", None), "E": (None, None)}
    assert spark.range(1).select(preview_channel(F.lit("Normal_map"), F.lit("x_BaseColor.png"))).first()[0] == "diffuse"


def test_integrity(spark, bridge, index):
    expected = integrity.expected_assets(bridge, index).unionByName(integrity.expected_materials(spark.createDataFrame([("X", ["m/X.mdl"], "t/X.png"), ("Y", [], None)], "name string, main_files array<string>, thumbnail string"), "road")).unionByName(integrity.expected_vegetation(spark.createDataFrame([("Oak",), ("Elm",)], "name string"), "tree", "collected_trees"))
    present = spark.createDataFrame([("m/X.mdl",), ("collected_trees/Oak/x.usd",)] + [(f"glb_flat/bucket_1/std_a{i}.x",) for i in (1, 3)], "path string")
    items = integrity.status(expected, present)
    rows = {(r.kind, r.subkind): (r.expected, r.present, r.missing) for r in integrity.report(items).collect()}
    assert rows["object", "glb"] == (7, 2, 5) and rows["material", "road"] == (2, 1, 1) and rows["vegetation", "tree"] == (2, 1, 1)
    assert all(e == p + m for e, p, m in rows.values()) and rows[None, None][2] == integrity.complete(items).first().missing
    plan = {(r.subkind, r.item, r.path) for r in integrity.repair_plan(expected, present).collect()}
    assert ("road", "X", "t/X.png") in plan and ("road", "X", "m/X.mdl") not in plan and ("annotation", "a1", "annotation_flat/bucket_1/std_a1.x") in plan
    done = present.unionByName(integrity.repair_plan(expected, present).select("path")).unionByName(spark.createDataFrame([("collected_trees/Elm/y",)], "path string"))
    assert {r.item for r in integrity.status(expected, done).where("not there").collect()} == {"a2", "a6"}  # they have no path


def test_repair_loop(spark, tmp_path):
    """Check, fetch, check again: once with a store that lacks a file, then with one that has it."""
    listed = spark.createDataFrame([(p,) for p in ("material_road_mdl/X.mdl", "material_road_thumbnail/X.png", "material_background_hdr/S.hdr", "material_road_mdl/textures/t.png", "collected_trees/Oak.tar.gz", "collected_trees/Elm.tar.gz", "collected_trees/readme.txt", "other/x")], "path string")
    index = spark.createDataFrame([("a1", "glb", "glb/a1.x"), ("a1", "annotation", "annotation/a1.x"), ("a1", "render", "render/a1.tar.gz"), ("a2", "annotation", "annotation/a2.x")], "uid string, asset_type string, path string")
    uids = spark.createDataFrame([("a1",), ("a2",), ("a1",)], "uid string")
    expected = integrity.expected_objects(uids, index).unionByName(integrity.expected_files(listed))
    assert {(r.kind, r.subkind, r.item) for r in expected.where("kind <> 'object'").collect()} == {("material", "road", "X"), ("material", "sky", "S"), ("vegetation", "tree", "Oak"), ("vegetation", "tree", "Elm")}
    store = tmp_path / "store"
    store.mkdir()
    folder = str(store)

    def put(path, content):
        with open(f"{folder}/{path.replace('/', '%')}", "wb") as file:
            file.write(content)

    def fetch(path):
        if "Elm" in path or "sky" in path:
            raise FileNotFoundError(path)
        return b"x"

    present = spark.createDataFrame([("material_road_mdl/X.mdl",), ("assets/std_a2.json",), ("collected_trees/Oak/a/b.usd",), ("glb/a1.x",)], "path string")
    items, results = integrity.repair(expected, present, fetch, put, tries=1)
    state = {(r.subkind, r.item): (r.was, r.there) for r in items.collect()}
    assert state == {
        ("glb", "a1"): (True, True), ("glb", "a2"): (False, False), ("annotation", "a1"): (False, True), ("annotation", "a2"): (True, True), ("thumbnail", "a1"): (False, False), ("thumbnail", "a2"): (False, False),
        ("render", "a1"): (False, True), ("render", "a2"): (False, False), ("road", "X"): (False, True), ("sky", "S"): (False, True), ("tree", "Oak"): (True, True), ("tree", "Elm"): (False, False),
    }
    assert {r.path: r.status for r in results.collect()} == {"annotation/a1.x": "fetched", "assets/std_a1.json": "fetched", "render/a1.tar.gz": "fetched", "material_road_thumbnail/X.png": "fetched", "material_background_hdr/S.hdr": "fetched", "collected_trees/Elm.tar.gz": "failed"}
    total = integrity.delta(items).where("kind is null").first()
    assert (total.expected, total.present, total.repaired, total.missing) == (12, 3, 4, 5)
    # again, with what is there by now and a store that has the rest
    now = present.unionByName(results.where("status = 'fetched'").select(F.regexp_replace("path", r"\.tar\.gz$", "/x").alias("path")))
    again, more = integrity.repair(expected, now, lambda path: b"x", put, tries=1)
    assert [tuple(r) for r in more.select("path", "status").collect()] == [("collected_trees/Elm.tar.gz", "fetched")]
    assert integrity.delta(again).where("kind is null").first().missing == 4  # those without an index entry
    assert sorted(column(integrity.whole_request(expected), "path")) == sorted(["annotation/a1.x", "annotation/a2.x", "assets/std_a1.json", "assets/std_a2.json", "collected_trees/Elm.tar.gz", "collected_trees/Oak.tar.gz", "glb/a1.x", "material_background_hdr/S.hdr", "material_road_mdl/X.mdl", "material_road_thumbnail/X.png", "render/a1.tar.gz"])


def test_shows(spark):
    listed = spark.createDataFrame([("material_road_mdl/X.mdl",), ("material_road_thumbnail/X.png",), ("material_road_mdl/textures/X_diff.png",), ("material_background_hdr/S.hdr",), ("collected_trees/Oak.tar.gz",)], "path string")
    texts = spark.createDataFrame([("X", 'a: texture_2d("./textures/X_diff.png")'), ("Other", 'a: texture_2d("./textures/X_diff.png")')], "name string, value string")
    items = lambda df: [json.loads(r["item"]) for r in df.orderBy("pos").collect()]
    assert items(show.materials("road", listed, listed, "http://h", texts)) == [{"name": "X", "url": "http://h/material_road_mdl/X.mdl", "thumbnail_url": "http://h/material_road_thumbnail/X.png", "textures": {"diffuse": "http://h/material_road_mdl/textures/X_diff.png"}}]
    assert items(show.materials("sky", listed, listed.limit(0), "http://h")) == [{"name": "S", "url": None, "thumbnail_url": None}]
    for names, call in ((["X", "Y"], lambda w: show.materials("road", listed, listed, "http://h", texts, w)), (["Oak", "Elm"], lambda w: show.vegetation("tree", listed, listed, "http://h", w))):
        wanted = spark.createDataFrame([(n,) for n in names], "name string")
        with pytest.raises(ValueError, match=names[1]):
            call(wanted)
        assert [i["name"] for i in items(call(wanted.limit(1)))] == names[:1]
    present = spark.createDataFrame([("collected_trees/Oak/a.usd",), ("collected_trees/Oak/_preview.glb",)], "path string")
    assert items(show.vegetation("tree", listed, present, "http://h")) == [{"name": "Oak", "usd": "collected_trees/Oak/a.usd", "preview_url": "http://h/collected_trees/Oak/_preview.glb"}]
    uids = spark.createDataFrame([("b",), ("a",), ("a",)], "uid string")
    index = spark.createDataFrame([("a", "glb", "g/a.glb"), ("b", "glb", "g/b.glb"), ("a", "thumbnail", "t/a.png")], "uid string, asset_type string, path string")
    there = spark.createDataFrame([("g/a.glb",), ("t/a.png",), ("r/a/render_90.0.jpg",)], "path string")
    words, folders = spark.createDataFrame([("a", "{}")], "uid string, annotation string"), spark.createDataFrame([("a", "r/a")], "uid string, folder string")
    expected = {"annotation": ["{}", None], "glb_url": ["http://h/g/a.glb", None], "thumbnail_url": ["http://h/t/a.png", None], "render_urls": [{"90": "http://h/r/a/render_90.0.jpg"}, {"90": None}]}
    for mode, fields in (("show", list(expected)), ("annotations", ["annotation"]), ("assets", ["glb_url"]), ("thumbnails", ["thumbnail_url"]), ("renders", ["render_urls"])):
        found = items(show.assets(uids, index, there, "http://h", mode, words, folders, (90,)))
        assert found == [{"uid": u} | {f: expected[f][i] for f in fields} for i, u in enumerate("ab")]
    with pytest.raises(ValueError):
        show.assets(uids, index, there, "http://h", "other")


def test_encoded_query_against_brute_force(spark):
    from assetloom import workload

    model = similarity.hashed_terms(64)()
    (asked,) = model(["small ring economy"])
    rows = [(r.p_partkey, f"{r.p_name} {r.p_type} {r.p_brand}") for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()]
    vectors = model([t for _, t in rows]).astype(float)
    scores = [round(float(v @ asked / ((v @ v) * (asked @ asked)) ** 0.5), 6) if v.any() else 0.0 for v in vectors]
    best = sorted(((-s, uid) for s, (uid, _) in zip(scores, rows, strict=True)))[:10]
    found = [(r["uid"], r["score"]) for r in workload.queries()["encoded_topk"](spark, "/root/testdata/sf0.001").collect()]
    assert [u for u, _ in found] == [u for _, u in best] and [s for _, s in found] == pytest.approx([-s for s, _ in best], abs=2e-6)


def test_graph(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("r", "c"), ("c", "b"), ("x", "c"), ("b", "t.png"), (None, "q")], "src string, dst string")
    edges = edges.select(F.concat("src", F.lit(".usd")).alias("src"), F.when(F.col("dst").endswith(".png"), F.col("dst")).otherwise(F.concat("dst", F.lit(".usd"))).alias("dst"), F.concat(F.lit("./"), "dst").alias("authored"))
    start = spark.createDataFrame([("r.usd",)], "node string")
    assert {r.node: r.depth for r in graph.reachable(start, edges).collect()} == {"r.usd": 0, "a.usd": 1, "c.usd": 1, "b.usd": 2, "t.png": 3}
    present = spark.createDataFrame([("r.usd",), ("a.usd",), ("b.usd",), ("t.png",)], "path string")
    assert set(column(graph.layers(start, edges, present), "node")) == {"r.usd", "a.usd", "b.usd"}
    changed = graph.affected(spark.createDataFrame([("c.usd",)], "node string"), edges)
    assert {r.node: r.depth for r in changed.collect()} == {"c.usd": 0, "r.usd": 1, "x.usd": 1}
    named = edges.withColumn("authored", F.col("dst"))
    assert {r.layer: r.renames for r in graph.rewrites(named, changed, "_5").collect()} == {"r.usd": {"c.usd": "c_5.usd"}, "x.usd": {"c.usd": "c_5.usd"}}


def test_scene(spark):
    rows = spark.createDataFrame([("l", str(i), t, x, y) for i, (t, x, y) in enumerate([("int", 2.0, None), ("float2", 2.0, 3.0), ("float2", 0.0, None), ("string", 1.0, None), ("half", None, None), ("float2", 0.0, 0.0)])], "layer string, prim string, type string, x double, y double")
    got = {r.prim: (r.new_type, r.new_x, r.new_y, r.changed) for r in scene.patch(rows, scale=0.5).collect()}
    assert got == {"0": ("float2", 1.0, 1.0, True), "1": ("float2", 1.0, 1.5, True), "2": ("float2", 0.0, 0.0, False), "3": ("string", 1.0, None, False), "4": ("half", None, None, False), "5": ("float2", 0.0, 0.0, False)}
    assert {r.layer: r.fixes for r in scene.fixes(scene.patch(rows, override=4.0)).collect()} == {"l": 4, None: 4}
    assert column(scene.patchable(rows), "node") == ["l"]
    mesh = spark.createDataFrame([("m", [0, 1, 2, 3, 9, 8, 5, 6, 7], [4, 2, 3])], "mesh string, indices array<int>, counts array<int>")
    assert sorted((r.a, r.b, r.c) for r in scene.triangles(mesh).collect()) == [(0, 1, 2), (0, 2, 3), (5, 6, 7)]


def test_fetch_and_archives(spark, tmp_path):
    waits, calls = [], {"n": 0}

    def busy(path):
        calls["n"] += 1
        if calls["n"] <= 6:
            raise transfer.TooManyRequests
        return b"x"

    assert transfer.fetch_one(busy, "p", sleep=waits.append) == b"x" and waits == [2, 4, 8, 16, 32, 60]

    def broken(path):
        raise OSError("no")

    with pytest.raises(OSError):
        transfer.fetch_one(broken, "p", tries=3, sleep=waits.append)
    store = str(tmp_path)

    def fetch(path):
        if path == "gone":
            raise FileNotFoundError(path)
        return path.encode()

    def put(path, data):
        with open(f"{store}/{path}", "wb") as f:
            f.write(data)

    wanted = spark.createDataFrame([("a",), ("b",), ("gone",), ("a",), ("here",)], "path string")
    results = transfer.fetch_missing(wanted, spark.createDataFrame([("here",)], "path string"), fetch, put).collect()
    assert {r.path: r.status for r in results} == {"a": "fetched", "b": "fetched", "gone": "failed", "here": "present"}
    assert tuple(transfer.summary(spark.createDataFrame(results)).first()) == (1, 2, 1)

    (tmp_path / "in").mkdir()
    for i in range(5):
        with tarfile.open(tmp_path / "in" / f"u{i}.tar.gz", "w:gz") as archive:
            for name in (f"d/render_{i}.jpg", "d/note.txt"):
                entry = tarfile.TarInfo(name)
                entry.size = 3
                archive.addfile(entry, io.BytesIO(b"abc"))
    (tmp_path / "in" / "bad.tar.gz").write_bytes(b"nothing")
    wanted = [""] + [f"render_{i}.jpg" for i in range(5)]
    for state in ("state", "state", "afresh"):  # the second run finds nothing new, a new checkpoint unpacks nothing again
        unpack_arriving(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/{state}", batch=2).awaitTermination()
        assert sorted(r.name or "" for r in archives.members(spark, f"{tmp_path}/out").collect()) == wanted
    done = {r.path.rsplit("/", 1)[-1]: r.members for r in archives.unpacked(spark, f"{tmp_path}/out").collect()}
    assert done == {f"u{i}.tar.gz": 1 for i in range(5)} | {"bad.tar.gz": 0}


def tar(*entries):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as archive:
        for name, content in entries:
            entry = tarfile.TarInfo(name)
            entry.size = len(content)
            archive.addfile(entry, io.BytesIO(content))
    return held.getvalue()


def test_batches_that_are_cut_short(spark, tmp_path, monkeypatch):
    """Lost before, between and after the two writes, and run again: no member twice, none lost."""
    target = f"{tmp_path}/out"
    rows = spark.createDataFrame([(f"a{i}", tar((f"x/{i}.jpg", b"1"), ("y.txt", b"2"))) for i in range(4)], "path string, content binary")
    first, second = rows.where("path < 'a2'"), rows
    archives.append_batch(first.unionAll(first), target, "q-0")  # a path that comes twice

    class Lost(Exception):
        pass

    writer = type(rows.write)
    whole = writer.parquet

    def lost(self, path, *args, **kwargs):
        if "/done/" in path:
            raise Lost
        return whole(self, path, *args, **kwargs)

    monkeypatch.setattr(writer, "parquet", lost)
    with pytest.raises(Lost):
        archives.append_batch(second, target, "q-1")
    monkeypatch.undo()
    assert sorted(column(archives.members(spark, target), "path")) == ["a0", "a1"]  # what the lost run left isn't read
    for _ in range(2):
        archives.append_batch(second, target, "q-1")
    archives.append_batch(second, target, "q-2")  # by another checkpoint
    assert sorted(column(archives.members(spark, target), "path")) == ["a0", "a1", "a2", "a3"]
    assert sorted(column(archives.unpacked(spark, target), "path")) == ["a0", "a1", "a2", "a3"]


def test_renders_from_index_to_members(spark, tmp_path, index):
    """Index, what is done, fetch, unpack: a failed fetch and a broken archive are rows."""
    uids = spark.createDataFrame([("a1",), ("a2",), ("a3",), ("a4",), ("zz",)], "uid string")
    target, name = f"{tmp_path}/out", "render_flat/bucket_1/std_{}.x"
    archives.append_batch(spark.createDataFrame([(name.format("a1"), tar(("r.jpg", b"1")))], "path string, content binary"), target, "0")
    wanted = archives.wanted_archives(uids, index, archives.unpacked(spark, target))
    assert sorted(column(wanted)) == ["a2", "a3", "a4"]
    good = tar(("d/r.jpg", b"2"))

    def fetch(path):
        if "a3" in path:
            raise FileNotFoundError(path)
        return good if "a2" in path else b"broken"

    came = transfer.fetched_archives(wanted, fetch).cache()
    assert {r.path: r.error is None for r in came.collect()} == {name.format("a2"): True, name.format("a3"): False, name.format("a4"): True}
    archives.append_batch(came.where("content is not null").select("path", "content"), target, "1")
    assert sorted(column(archives.wanted_archives(uids, index, archives.unpacked(spark, target)))) == ["a3"]
    assert sorted(str(r.name) for r in archives.members(spark, target).collect()) == ["None", "r.jpg", "r.jpg"]


def test_archives_keep_their_folders(spark):
    rows = spark.createDataFrame([("p", tar(("Oak/a.usd", b"1"), ("./Oak/t/x.usd", b"2"), ("../out.usd", b"3"), ("/abs.usd", b"4")))], "path string, content binary")
    assert sorted(column(transfer.archive_members(rows, ".usd", tree=True), "name")) == ["Oak/a.usd", "Oak/t/x.usd"]


def test_plans_of_conversion(spark):
    rows = spark.createDataFrame([("u1", "g1", "s1", True), ("u2", "g2", "s2", True), ("u3", "g3", "s3", False)], "uid string, glb string, usd string, glb_present boolean")
    plan = files.conversion_plan(rows, spark.createDataFrame([("s1",)], "path string"))
    assert {r.uid: r.status for r in plan.collect()} == {"u1": "existing", "u2": "to_do", "u3": "missing"}
    tasks = spark.createDataFrame([("u2", "g2", "s2"), ("u9", "g2", "s9")], "uid string, glb string, usd string")
    done = spark.createDataFrame([("g2", True, None), ("gx", False, "why")], "glb string, ok boolean, error string")
    results = files.conversion_results(tasks, done)
    assert [tuple(r) for r in results.collect()] == [("u2", "s2", None)]
    merged = files.precedence(rows, spark.createDataFrame([("u1", "s1")], "uid string, usd string"), results.select("uid", "usd"), "uid", "usd")
    assert {r.uid: r.usd for r in merged.collect()} == {"u1": "s1", "u2": "s2", "u3": None}


def test_encoders(spark):
    encoders = similarity.Encoders()
    encoders.register("terms", similarity.hashed_terms(64))
    rows = spark.createDataFrame([("a", "red car"), ("b", None), ("c", "red car")], "uid string, description string")
    found = {r.uid: r.vector for r in encoders.encode(rows, "terms", "description").collect()}
    assert found["a"] == found["c"] and sum(x * x for x in found["a"]) == pytest.approx(1) and not any(found["b"])
    many = spark.range(0, 1000, 1, 4).select(F.col("id").alias("uid"), F.concat(F.lit("word "), (F.col("id") % 7).cast("string")).alias("description"))
    calls = {}
    for batch in (1, 64, 5000):
        got = {r.uid: tuple(r.vector) for r in encoders.encode(many, "terms", "description", batch=batch).collect()}
        assert len(got) == 1000 and calls.setdefault("all", got) == got
    model = similarity.hashed_terms(64)()
    for uid, vector in list(got.items())[:20]:
        plain = model([f"word {uid % 7}"])[0]
        assert vector == pytest.approx(tuple(plain / (plain @ plain) ** 0.5))
    assert encoders.encode(rows.limit(0), "terms", "description").collect() == []
    with pytest.raises(ValueError):
        encoders.encode(rows, "other", "description")


def test_documents(spark):
    loaded = spark.createDataFrame([("b", None, None, "t/b.png", {90: None}), ("a", "g/a.glb", "x.json", None, {0: "r/0.jpg"})], "uid string, glb string, annotation string, thumbnail string, renders map<int,string>")
    show = json.loads(documents.gathered(documents.asset_items(loaded, "show", "http://h"), "A \"title\"}").first()[0])
    assert [i["uid"] for i in show["items"]] == ["a", "b"] and show["items"][0]["glb_url"] == "http://h/g/a.glb" and show["items"][1]["render_urls"] == {"90": None}
    assert (show["title"], show["mode"]) == ('A "title"}', "show")
    thumbs = json.loads(documents.gathered(documents.asset_items(loaded, "thumbnails", "http://h"), "T", "thumbnails").first()[0])
    assert set(thumbs["items"][0]) == {"uid", "thumbnail_url"} and documents.has_thumbnails(loaded).first()[0]
    with pytest.raises(ValueError):
        documents.asset_items(loaded, "other", "")
    assert json.loads(documents.gathered(documents.asset_items(loaded.limit(0), "show", "http://h"), "None").first()[0])["items"] == []
    texts = ['{"k": 1, "n": {"x": "y"}, "z": null, "s": "{\\"a\\": 1}", "t": "[2]", "e": {}, "l": [], "m": [[1.5, true], [[]], [{"q": "7"}]]}', "not json", None, "{", "[1, [2]]", "5", '"text"', "null"]
    nested = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "uid string, annotation string").withColumns({"value": F.lit("x"), "path": F.lit("y")})
    found = {}
    for x in documents.annotation_rows(nested).collect():
        found.setdefault(x.uid, set()).add((x.path, x.value))
    assert found["0"] == {("k", "1"), ("n.x", "y"), ("z", None), ("s", '{"a": 1}'), ("t", "[2]"), ("m.0.0", "1.5"), ("m.0.1", "true"), ("m.2.0.q", "7")}
    assert found["4"] == {("0", "1"), ("1.0", "2")} and found["5"] == {("", "5")} and found["6"] == {("", "text")} and found["7"] == {("", None)} and set(found) == {"0", "4", "5", "6", "7"}
    deep = spark.createDataFrame([("d", '{"k":' * 40 + "[[1]]" + "}" * 40)], "uid string, annotation string")
    assert [tuple(x) for x in documents.annotation_rows(deep).collect()] == [("d", ".".join(["k"] * 40) + ".0.0", "1")]
    assert documents.annotation_rows(deep.limit(0)).collect() == []
