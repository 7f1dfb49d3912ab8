"""Archives read by ranges of headers, whatever is in them."""

import io
import tarfile

import pytest

from assetloom.sources import catalog
from assetloom.sources.bundles import Range, _Reader, ranges, register


def add(archive, name, content):
    entry = tarfile.TarInfo(name)
    entry.size = len(content)
    archive.addfile(entry, io.BytesIO(content))


def filled(path, mode, entries, kind=tarfile.PAX_FORMAT):
    with tarfile.open(path, mode, format=kind) as archive:
        for name, content in entries:
            add(archive, name, content)
    return str(path)


ENTRIES = [(f"pre/std_{i}.json", b"%d" % i * (i * 37 % 900)) for i in range(60)] + [("pre/" + "long" * 60 + ".json", b"1"), ("pre/._x.json", b"junk"), ("pre/read.me", b"2"), ("pre/empty.json", b""), ("é.json", "ü".encode())]
WANTED = sorted((n, c) for n, c in ENTRIES if n.endswith(".json") and "._" not in n)


@pytest.mark.parametrize("kind", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
@pytest.mark.parametrize("size", [1, 2000, 1 << 30])
def test_ranges_cover_each_member_once(tmp_path, kind, size):
    """Long names have headers of their own, which stay with their member."""
    path = filled(tmp_path / "a.tar", "w", ENTRIES, kind)
    parts = ranges(path, size)
    assert parts[0].start == 0 and all(a.end == b.start for a, b in zip(parts, parts[1:], strict=False)) and (len(parts) > 20 or size > 1)
    reader = _Reader({"path": path, "suffix": ".json", "range_bytes": str(size)})
    assert sorted((name, content) for p in parts for _, name, content, _ in reader.read(p)) == WANTED


@pytest.mark.parametrize("ending,mode", [("tar", "w"), ("tar.gz", "w:gz"), ("tgz", "w:gz"), ("tar.xz", "w:xz"), ("tar.bz2", "w:bz2")])
def test_members_of_a_file_and_a_folder(spark, tmp_path, ending, mode):
    (tmp_path / "deep").mkdir()
    path = filled(tmp_path / "deep" / f"a.{ending}", mode, ENTRIES)
    (tmp_path / "note.txt").write_text("no archive")
    for place in (path, str(tmp_path), f"file://{tmp_path}"):
        rows = catalog.bundle(spark, place, range_bytes=5000).collect()
        assert sorted((r["name"], bytes(r["value"])) for r in rows) == WANTED and not any(r["error"] for r in rows)
    assert sorted(r["name"] for r in catalog.bundle_members(spark, path).collect()) == sorted(n.rsplit("/", 1)[-1] for n, _ in WANTED)


@pytest.mark.parametrize("ending,mode", [("tar", "w"), ("tar.gz", "w:gz")])
def test_broken_archives_are_rows(spark, tmp_path, ending, mode):
    """Broken off in a member, in a header, or no archive at all: what could be read, and why no more."""
    path = filled(tmp_path / f"a.{ending}", mode, [(f"{i}.json", bytes(range(256)) * 8) for i in range(9)])
    with open(path, "rb") as file:
        whole = file.read()
    for name, content in (("cut", whole[: len(whole) * 2 // 3]), ("inside", whole[: len(whole) // 2 + (700 if mode == "w" else 0)]), ("empty", b""), ("text", b"nothing of the kind " * 99)):
        with open(tmp_path / f"{name}.{ending}", "wb") as file:
            file.write(content)
    rows = catalog.bundle(spark, str(tmp_path)).collect()
    by = {n: [r for r in rows if r["archive"].endswith(f"{n}.{ending}")] for n in ("a", "cut", "inside", "empty", "text")}
    assert len(by["a"]) == 9 and not any(r["error"] for r in by["a"])
    for name in ("cut", "inside", "empty", "text"):
        assert sum(r["error"] is not None for r in by[name]) == 1, name
    read = [r for n in ("cut", "inside") for r in by[n] if r["error"] is None]
    assert len(read) < 18 and all(bytes(r["value"]) == bytes(range(256)) * 8 for r in read)
    assert len(catalog.bundle_members(spark, str(tmp_path)).collect()) == 9 + len(read)


def test_memory_is_that_of_a_member(tmp_path):
    """An archive of 300 MB, plain and compressed, by a reader that never holds more than a few members."""
    import tracemalloc

    member = bytes(1 << 20)
    for name, mode in (("a.tar", "w"), ("a.tar.gz", "w:gz")):
        path = str(tmp_path / name)
        with tarfile.open(path, mode, **({"compresslevel": 1} if mode == "w:gz" else {})) as archive:
            for i in range(300):
                add(archive, f"{i}.bin", member)
        reader = _Reader({"path": path, "suffix": ".json"})
        tracemalloc.start()
        assert [row for part in ranges(path, 1 << 25) for row in reader.read(part)] == []
        reader = _Reader({"path": path})
        assert sum(len(content) for part in ranges(path, 1 << 25) for _, _, content, _ in reader.read(part)) == 300 << 20
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16 << 20, (name, peak)


def test_members_that_are_too_long(tmp_path):
    path = filled(tmp_path / "a.tar", "w", [("a.json", b"x" * 2000), ("b.json", b"y")])
    rows = list(_Reader({"path": path, "longest_member": "1000"}).read(Range(path, 0, ranges(path)[-1].end)))
    assert [(n, c, e) for _, n, c, e in rows] == [("a.json", None, "longer than 1000 bytes"), ("b.json", b"y", None)]


def test_other_suffixes(spark, tmp_path):
    path = filled(tmp_path / "a.tar", "w", ENTRIES)
    register(spark)
    assert [r["name"] for r in spark.read.format("tar_members").option("suffix", ".me").load(path).collect()] == ["pre/read.me"]
