import struct
import warnings

import numpy as np
import pytest

from voxelweave import api, cli
from voxelweave.operators import frames, neighbours, volumes
from voxelweave.sources import arrays, codec, container, nvdb, voxfile

KEYS = ["frame", "x", "y", "z", "r", "g", "b"]


def rows(df):
    return sorted(map(tuple, df.select(KEYS).collect()))


def dot(frame):
    a = np.zeros((16, 16, 16, 4), np.uint8)
    a[frame, 8, 8] = 255
    return a


def chunk(ident, payload):
    return ident + struct.pack("<II", len(payload), 0) + payload


def text(s):
    return struct.pack("<I", len(s)) + s.encode()


def vox_bytes(models, shown, palette=None):
    body = b"".join(chunk(b"SIZE", struct.pack("<III", 8, 8, 8)) + chunk(b"XYZI", struct.pack("<I", len(m)) + b"".join(map(bytes, m))) for m in models)
    node = struct.pack("<I", 3) + struct.pack("<I", 0) + struct.pack("<I", len(shown))
    for model, at in shown:
        node += struct.pack("<I", model) + (struct.pack("<I", 0) if at is None else struct.pack("<I", 1) + text("_f") + text(str(at)))
    body += chunk(b"nSHP", node) + (chunk(b"RGBA", palette) if palette else b"")
    return b"VOX " + struct.pack("<I", 150) + b"MAIN" + struct.pack("<II", 0, len(body)) + body


def test_moving_dot(spark, tmp_path):
    path = str(tmp_path / "dot.voxels")
    enc = api.VoxelEncoder(spark, 16, 16, 16, 1.0, 10, 512, True, path)
    for i in range(16):
        enc.encode_numpy_frame_byte(dot(i))
    enc.finish()
    assert rows(container.read(spark, path)) == [(i, i, 8, 8, 255, 255, 255) for i in range(16)]
    meta = api.get_metadata(spark, path)
    assert (meta["frameCount"], meta["duration"], meta["encodingParams"]["gopSize"]) == (16, 16.0, 10)
    assert container.read(spark, path).where("frame between 12 and 13").count() == 2
    raw = spark.read.format("binaryFile").load(path)
    assert rows(container.read_column(raw)) == rows(container.read(spark, path))
    assert api.split(spark, path, 5.5, str(tmp_path / "parts")) == 4
    back = str(tmp_path / "back.voxels")
    api.concat(spark, [str(tmp_path / f"parts/split_{k:04d}.voxels") for k in range(4)], back)
    assert rows(container.read(spark, back)) == rows(container.read(spark, path))
    with pytest.raises(ValueError, match="closed"):
        enc.encode_numpy_frame_byte(dot(0))


def test_files_by_address(spark, tmp_path):
    out = f"file://{tmp_path}/by/address.voxels"
    e = api.VoxelEncoder(spark, 16, 16, 16, 4.0, output_path=out)
    for k in range(6):
        a = np.zeros((16, 16, 16, 4), np.uint8)
        a[k, 1, 2] = 255
        e.encode_numpy_frame(a)
    assert e.finish() == out
    assert (tmp_path / "by/address.voxels").exists()
    assert api.get_metadata(spark, out)["frameCount"] == 6
    assert api.split(spark, out, 1.0, f"file://{tmp_path}/parts") == 2
    parts = [f"file://{tmp_path}/parts/split_{k:04d}.voxels" for k in range(2)]
    api.concat(spark, parts, f"file://{tmp_path}/back/whole.voxels")
    assert rows(container.read(spark, f"file://{tmp_path}/back/whole.voxels")) == rows(container.read(spark, out))
    assert api.named("s3://bucket/a/b.c.voxels") == ("s3://bucket/a", "b.c", ".voxels") and api.named("x") == (".", "x", "") and api.named("/x.y") == ("/", "x", ".y")


def test_encoder_checks(spark, tmp_path):
    for dims in ((0, 8, 8), (8, 9, 8), (8, 8, -8)):
        with pytest.raises(ValueError):
            api.VoxelEncoder(spark, *dims, 1.0)
    with pytest.raises(ValueError):
        api.VoxelEncoder(spark, 8, 8, 8, 0.0)
    enc = api.VoxelEncoder(spark, 8, 8, 8, 1.0, output_path=str(tmp_path / "x.voxels"))
    with pytest.raises(ValueError):
        enc.encode_numpy_frame_byte(dot(0))
    with pytest.raises(ValueError):
        enc.finish()
    with pytest.warns(UserWarning):
        container.Params(4, 5)


def test_empty_frames(spark, tmp_path):
    path = str(tmp_path / "e.voxels")
    enc = api.VoxelEncoder(spark, 8, 8, 8, 2.0, output_path=path)
    for _ in range(3):
        enc.encode_numpy_frame_byte(np.zeros((8, 8, 8, 4), np.uint8))
    enc.finish()
    assert rows(container.read(spark, path)) == []
    assert api.get_metadata(spark, path)["frameCount"] == 3


@pytest.mark.parametrize(("at", "value"), [(0, 0), (4, 9), (8, 7), (16, 3), (20, 0), (24, 0)])
def test_bad_headers(tmp_path, at, value):
    header = container.Header(8, 8, 8, 1.0, 1, 1.0, container.Params(), 56).pack() + struct.pack("<Q", 56)
    (tmp_path / "h").write_bytes(header)
    with container.open_file(str(tmp_path / "h")) as f:
        assert container.read_header(f).frames == 1
    bad = bytearray(header)
    bad[at : at + 4] = struct.pack("<I", value)
    (tmp_path / "h").write_bytes(bytes(bad))
    with container.open_file(str(tmp_path / "h")) as f, pytest.raises(codec.Damaged):
        container.read_header(f)


def test_older_file_and_upgrade(spark, tmp_path):
    filled, colour = np.zeros(512, bool), np.zeros((512, 3), np.uint8)
    filled[[0, 77]], colour[[0, 77]] = True, 9
    brick = b"\0" + codec.encode_runs(filled) + bytes([4, 4, 4]) + bytes([5] * 6)
    blob = codec.range_encode(brick)
    block = struct.pack("<IQI", 1, 2, 1) + struct.pack("<QQ", 0, 2) + blob
    head = container.OLD_HEADER.pack(container.MAGIC, container.OLD_VERSION, 8, 8, 8, 2.0, 1, 0.5, 1, 256, 48 + len(block))
    path = tmp_path / "old.voxels"
    path.write_bytes(head + block + struct.pack("<Q", 48))
    expected = [(0, 0, 0, 0, 9, 9, 9), (0, 5, 1, 1, 9, 9, 9)]
    assert rows(container.read(spark, str(path))) == expected
    api.upgrade(spark, str(path), str(tmp_path / "new.voxels"))
    assert rows(container.read(spark, str(tmp_path / "new.voxels"))) == expected
    meta = api.get_metadata(spark, str(tmp_path / "new.voxels"))
    assert meta["version"] == "0.3.0.0" and meta["encodingParams"]["motionVectors"]
    assert api.dump_to_nvdb(spark, str(path), str(tmp_path / "grids")) == 1


def test_vox(spark, tmp_path):
    models = [[(1, 2, 3, 1)], [(1, 2, 3, 2), (1, 2, 3, 5)], [(7, 0, 0, 255), (0, 7, 0, 216)]]
    path = str(tmp_path / "a.vox")
    (tmp_path / "a.vox").write_bytes(vox_bytes(models, [(0, 2), (1, 5), (2, 6)]))
    assert api.get_vox_max_dimensions(spark, path) == (8, 8, 8)
    got = rows(voxfile.load(voxfile.files(spark, path), ((0, 0, 0), (7, 7, 7))))
    p = voxfile.default_palette()
    assert len(p) == 256
    assert got == sorted([(f, 1, 3, 2, *p[0]) for f in range(5)] + [(5, 1, 3, 2, *p[4]), (6, 7, 0, 0, *p[254]), (6, 0, 0, 7, *p[215])])
    moved = rows(voxfile.load(voxfile.files(spark, path), ((1, 1, 1), (8, 8, 8))))
    assert {r[1:4] for r in moved} == {(0, 2, 1)}
    (tmp_path / "b.vox").write_bytes(vox_bytes(models[:2], [(1, None), (0, None)], bytes(range(256)) * 4))
    got = rows(voxfile.load(voxfile.files(spark, str(tmp_path / "b.vox")), ((0, 0, 0), (7, 7, 7))))
    assert got == [(0, 1, 3, 2, 16, 17, 18), (1, 1, 3, 2, 0, 1, 2)]
    with pytest.raises(ValueError):
        list(voxfile.chunks(b"no"))


def test_grid_files(spark, tmp_path):
    at = np.array([[0, 0, 0], [9, 1, 2], [-3, 5, 6]])
    values = np.array([[0.5, 0, 1], [0.1, 0.2, 0.3], [1, 1, 1]], np.float32)
    raw = nvdb.file_bytes("colour", nvdb.grid_image(at, values), 3)
    (tmp_path / "g.nvdb").write_bytes(raw)
    files = voxfile.files(spark, str(tmp_path / "g.nvdb"))
    assert nvdb.grid_list(files).first()["grid"] == "colour"
    assert rows(nvdb.load(files, ((0, 0, 0), (15, 15, 15)))) == [(0, 0, 0, 0, 128, 0, 255), (0, 9, 1, 2, 26, 51, 77)]
    # the box's low corner belongs to the output's axes
    assert rows(nvdb.load(files, ((1, 0, 8), (15, 15, 23)), ("z", "y", "x"))) == [(0, 1, 1, 1, 26, 51, 77)]
    for bad in (b"x" * 40, raw[:100], raw[:-10], raw[:8] + struct.pack("<I", 31 << 21) + raw[12:]):
        with pytest.raises((ValueError, struct.error)):
            list(nvdb.grids(bad))
    by_name = nvdb.number_frames(nvdb.load(files, ((0, 0, 0), (15, 15, 15))), files, "s")
    assert by_name.count() == 2


def look_up(image, at):
    """The value at a cell, from the root down by each node's table; None where it isn't active."""
    x, y, z = at
    root = nvdb.GRID_BYTES + struct.unpack_from("<4Q", image, nvdb.GRID_BYTES)[3]
    (n,) = struct.unpack_from("<I", image, root + 24)
    key = (x & 0xFFFFFFFF) >> 12 << 42 | (y & 0xFFFFFFFF) >> 12 << 21 | (z & 0xFFFFFFFF) >> 12
    found = {k: root + c for k, c in (struct.unpack_from("<Qq", image, root + 96 + 32 * i) for i in range(n))}
    node = found.get(key)
    for side, log2, table in ((7, 5, 8256), (3, 4, 1088)):
        if node is None:
            return None
        a, b, c = ((v >> side) & (1 << log2) - 1 for v in at)
        place = a << 2 * log2 | b << log2 | c
        mask = node + 32 + (1 << 3 * log2 - 3)
        node = node + struct.unpack_from("<q", image, node + table + 16 * place)[0] if image[mask + place // 8] >> place % 8 & 1 else None
    if node is None:
        return None
    place = (x & 7) << 6 | (y & 7) << 3 | z & 7
    return struct.unpack_from("<3f", image, node + 128 + 12 * place) if image[node + 16 + place // 8] >> place % 8 & 1 else None


def test_grid_tree_is_walked_from_the_root():
    rng = np.random.default_rng(4)
    at = np.unique(np.concatenate((rng.integers(-20, 20, (300, 3)), rng.integers(-9000, 9000, (20, 3)))), axis=0)
    values = rng.random((len(at), 3)).astype(np.float32)
    image = nvdb.grid_image(at, values)
    assert len(image) % 32 == 0 and nvdb.faults(image) == []
    for p, v in zip(at.tolist(), values.tolist(), strict=True):
        assert look_up(image, p) == tuple(v)
    filled = set(map(tuple, at.tolist()))
    assert all(look_up(image, p) is None for p in rng.integers(-20, 20, (200, 3)).tolist() if tuple(p) not in filled)
    got, v = nvdb.active_cells(image)
    assert dict(zip(map(tuple, got.tolist()), map(tuple, v.tolist()), strict=True)) == dict(zip(map(tuple, at.tolist()), map(tuple, values.tolist()), strict=True))
    assert nvdb.faults(image[:-32]) != [] and nvdb.faults(b"") == ["no grid"]
    bad = bytearray(image)
    bad[nvdb.GRID_BYTES + 56] ^= 1
    assert nvdb.faults(bytes(bad)) == ["the active cells aren't as many as the tree says"]
    empty = nvdb.grid_image(np.zeros((0, 3)), np.zeros((0, 3)))
    assert nvdb.faults(empty) == [] and len(nvdb.active_cells(empty)[0]) == 0


def test_active_tiles_and_zip(spark, tmp_path):
    at, values = np.array([[1, 2, 3], [200, 1, 1]]), np.array([[0.5, 0.5, 0.5], [1, 1, 1]], np.float32)
    image = bytearray(nvdb.grid_image(at, values))
    lower = nvdb.GRID_BYTES + struct.unpack_from("<4Q", image, nvdb.GRID_BYTES)[1]
    place = 0 << 8 | 0 << 4 | 1  # the leaf's place at (0, 0, 8) as an active tile
    image[lower + 32 + place // 8] |= 1 << place % 8
    struct.pack_into("<3f", image, lower + 1088 + 16 * place, 1.0, 0.0, 0.0)
    assert nvdb.faults(bytes(image)) == ["the active cells aren't as many as the tree says"]
    struct.pack_into("<Q", image, nvdb.GRID_BYTES + 56, 2 + 512)
    assert nvdb.faults(bytes(image)) == []
    (tmp_path / "t.nvdb").write_bytes(nvdb.file_bytes("colour", bytes(image), 514, codec=nvdb.ZIP))
    files = voxfile.files(spark, str(tmp_path / "t.nvdb"))
    got = rows(nvdb.load(files, ((0, 0, 0), (255, 3, 12))))
    assert got == sorted([(0, 1, 2, 3, 128, 128, 128), (0, 200, 1, 1, 255, 255, 255), *((0, x, y, z, 255, 0, 0) for x in range(8) for y in range(4) for z in range(8, 13))])
    assert nvdb.cells(files).count() == 514


def test_blosc_chunks():
    import pyarrow as pa

    data = np.arange(512, dtype="<f4").tobytes()
    shuffled = np.frombuffer(data, np.uint8).reshape(-1, 4).T.tobytes()
    stored = bytes([2, 1, 2, 4]) + struct.pack("<3I", len(data), len(data), 16 + len(data)) + data
    assert nvdb.blosc_chunk(stored) == data
    packed = pa.Codec("lz4_raw").compress(shuffled).to_pybytes()
    one = bytes([2, 1, 1 | 16 | 1 << 5, 4]) + struct.pack("<3I", len(data), len(data), 0) + struct.pack("<I", 20) + struct.pack("<i", len(packed)) + packed
    assert nvdb.blosc_chunk(one) == data


def test_arrays(spark):
    a = np.zeros((8, 16, 24, 4), np.float32)
    a[1, 2, 3] = (0.5, 2.0, -1.0, 1.0)
    a[4, 5, 6] = (1, 1, 1, 0.003)
    got = arrays.numpy_frame(spark, a, "s", 3, ("z", "x", "y"))
    assert rows(got) == [(3, 3, 1, 2, 127, 255, 0)]
    with pytest.raises(ValueError):
        arrays.numpy_frame(spark, a[..., :3], "s", 0)
    with pytest.raises(ValueError):
        volumes.permuted(got, ("x", "x", "y"))


@pytest.mark.parametrize(("side", "left"), [(8, 296), (16, 1352)])
def test_solid_cubes(spark, side, left):
    cube = volumes.grid(spark, ((0, 0, 0), (side - 1,) * 3)).selectExpr("'c' scene", "0 frame", "x", "y", "z", "1 r", "1 g", "1 b")
    shell = neighbours.visible(cube)
    assert shell.count() == left
    assert neighbours.visible(shell).count() == left


def test_streams_of_relations(spark):
    v = spark.createDataFrame([("s", f, 0, 0, 0, f, 0, 0) for f in range(10)], "scene string, frame int, x int, y int, z int, r int, g int, b int")
    parts = frames.split(v, 1.0, 4.0)
    assert [r["n"] for r in parts.groupBy("part").count().orderBy("part").selectExpr("count n").collect()] == [4, 4, 2]
    back = frames.concat([parts.where(f"part = {k}").drop("part", "frame").withColumnRenamed("part_frame", "frame") for k in range(3)])
    assert rows(back.selectExpr("int(frame) frame", "x", "y", "z", "r", "g", "b")) == rows(v)
    with pytest.raises(ValueError):
        frames.split(v, 0.1, 4.0)
    with pytest.warns(UserWarning):
        frames.concat([v, v], [4.0, 5.0])
    assert frames.missing_dependencies(frames.frame_index(v.where("frame <> 4"), 5)).count() == 0


def test_command_line(spark, tmp_path):
    (tmp_path / "a b.vox").write_bytes(vox_bytes([[(1, 2, 3, 1)]], [(0, 0)]))
    out = str(tmp_path / "c.voxels")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        session = cli.Session(api.VoxelEncoder(spark, 8, 8, 8, 1.0, 1, 256, False, out))
    assert session.run(f'e_vox "{tmp_path}/a b.vox"') and session.run("r 1") and session.run("a z y x") and session.run("b 0 0 0 7 7 7")
    for bad in ("a x x y", "b 0 0 0 6 7 7", "zzz"):
        with pytest.raises(ValueError):
            session.run(bad)
    assert not session.run("f")
    assert container.read(spark, out).count() == 1
    a = cli.parsed(["-d", "8", "8", "8", "-f", "30", "-o", "x"])
    assert (a.g, a.b, a.m) == (1, 256, "1")


def test_names_and_byte_order():
    assert nvdb.name_hash("") == 0 and nvdb.name_hash("a") == 97 and nvdb.name_hash("ab") == 97 * 67 + 98
    long = "density" * 20
    key = 0
    for c in long.encode():
        key = (key * 67 + c + (key >> 56)) % 2**64
    assert nvdb.name_hash(long) == key
    assert nvdb.reversed_bytes(nvdb.reversed_bytes(0x0102030405060708)) == 0x0102030405060708
    with pytest.raises(ValueError, match="byte order"):
        list(nvdb.grids(nvdb.MAGIC[::-1] + bytes(8)))
