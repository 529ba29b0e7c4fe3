"""The TIFF sources: what they read, what they leave unread, and what they refuse."""

import os
import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from tesserae.sources import tiff


def stack(path, images, **more):
    with open(path, "wb") as f:
        tiff.write_stack(f, images, **more)


def frames_of(df):
    return sorted((r.frame, np.array(r.data, np.float32).reshape(r.h, r.w).tolist()) for r in df.collect())


class Counted:
    """A file that notes what is read of it."""

    def __init__(self, f):
        self.f, self.reads = f, []

    def __getattr__(self, name):
        return getattr(self.f, name)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read(self, n):
        self.reads.append((self.f.tell(), n))
        return self.f.read(n)


@pytest.fixture
def counted(monkeypatch):
    opened = []

    class Local:
        def __getattr__(self, name):
            return getattr(pafs.LocalFileSystem(), name)

        def open_input_file(self, path):
            opened.append(Counted(pafs.LocalFileSystem().open_input_file(path)))
            return opened[-1]

    monkeypatch.setattr(tiff, "file_system", lambda path: (Local(), path))
    return opened


@pytest.mark.parametrize("known", [True, False])
def test_a_task_reads_its_own_directories(tmp_path, counted, known):
    images = [np.full((20, 30), float(k), np.float32) for k in range(200)]
    name = "frames-000000000-000000199-200-x_0_0.tif" if known else "other.tif"
    stack(tmp_path / name, images, frames=list(range(200)) if known else None)
    reader = tiff.TiffReader({"path": str(tmp_path), "chunk": "10"})
    parts = reader.partitions()
    assert len(parts) == 20 and len(counted) == (0 if known else 1)
    counted.clear()
    (batch,) = reader.read(parts[7])
    assert batch["frame"].to_pylist() == list(range(70, 80)) and batch["data"][3].as_py() == [73.0] * 600
    own = sum(n for _, n in counted[0].reads)
    assert own < 11 * (20 * 30 * 4 + 400)  # of 200 pages
    assert len(counted[0].reads) <= 10 * 5 + 4


def test_conditions_on_frame_leave_partitions_out(tmp_path):
    for k in range(4):
        stack(tmp_path / f"{k}.tif", [np.full((2, 2), 10.0 * k + j, np.float32) for j in range(10)])
    reader = tiff.PushingReader({"path": str(tmp_path), "chunk": "5"})
    path = ("frame",)
    left = list(reader.pushFilters([ds.GreaterThanOrEqual(path, 12), ds.LessThan(path, 31), ds.EqualTo(("h",), 2), ds.IsNotNull(path)]))
    assert left == [ds.EqualTo(("h",), 2)]
    parts = reader.partitions()
    assert [p.base + p.first for p in parts] == [10, 15, 20, 25, 30]
    assert [k for p in parts for b in reader.read(p) for k in b["frame"].to_pylist()] == list(range(12, 31))
    reader = tiff.PushingReader({"path": str(tmp_path), "chunk": "5"})
    assert list(reader.pushFilters([ds.In(path, (3, 38, None))])) == []
    assert [k for p in reader.partitions() for b in reader.read(p) for k in b["frame"].to_pylist()] == [3, 38]


def test_spark_hands_conditions_over(spark, tmp_path):
    stack(tmp_path / "a.tif", [np.full((3, 3), float(k), np.float32) for k in range(40)])
    spark.conf.set(tiff.PUSHED, "true")
    try:
        some = tiff.read(spark, str(tmp_path), chunk=4).where("frame between 9 and 13")
        assert some.rdd.getNumPartitions() == 2  # frames 8 to 15
        assert [k for k, _ in frames_of(some)] == [9, 10, 11, 12, 13]
        assert tiff.read(spark, str(tmp_path)).where("frame = 7 or frame = 20").count() == 2
        out = str(tmp_path / "out")
        tiff.read(spark, str(tmp_path)).repartition(3).write.format("tiff").mode("overwrite").save(out)
        assert [k for k, _ in frames_of(tiff.read(spark, out).where("frame > 36"))] == [37, 38, 39]
        assert tiff.read(spark, out, start=5).where("frame < 8").count() == 3
    finally:
        spark.conf.set(tiff.PUSHED, "false")
    assert tiff.read(spark, str(tmp_path)).where("frame < 3").count() == 3


def test_names_with_blanks_survive_an_append(spark, tmp_path):
    stack(tmp_path / "my movie.tif", [np.zeros((2, 2), np.float32)] * 3)
    df = tiff.read(spark, str(tmp_path))
    assert df.count() == 3
    df.limit(1).withColumn("frame", F.lit(3)).write.format("tiff").mode("append").save(str(tmp_path))
    assert [k for k, _ in frames_of(tiff.read(spark, str(tmp_path)))] == [0, 1, 2, 3]


def test_colour_and_labelled_pages(spark, tmp_path):
    spark.dataSource.register(tiff.TiffPages)
    pick = np.random.default_rng(3)
    rows = []
    for k in range(6):
        shape = (5 + k % 2, 7, 3) if k % 3 else (4, 4)
        x = pick.integers(0, 256, shape).astype(np.uint8)
        rows.append((k, shape[0], shape[1], 3 if k % 3 else 1, [None, "reject: value < 0.5", "äé\nzwei"][k % 3], bytearray(x.tobytes())))
    df = spark.createDataFrame(rows, "frame int, h int, w int, samples int, label string, data binary")
    for out in (str(tmp_path / "one"), str(tmp_path / "three")):
        df.repartition(1 if out.endswith("one") else 3).write.format("tiff_pages").mode("overwrite").save(out)
        got = tiff.read(spark, out, kind="tiff_pages", chunk=2)
        assert sorted(map(tuple, got.collect())) == rows
    with pytest.raises(Exception, match="two dimensions"):
        tiff.read(spark, str(tmp_path / "one")).count()


def test_a_movie_has_one_shape(spark, tmp_path):
    stack(tmp_path / "a.tif", [np.zeros((2, 2), np.float32), np.zeros((2, 3), np.float32)])
    with pytest.raises(Exception, match="2 x 3"):
        tiff.read(spark, str(tmp_path)).count()
    (tmp_path / "b").mkdir()
    for k in (2, 3):
        stack(tmp_path / "b" / f"{k}.tif", [np.zeros((2, k), np.float32)])
    with pytest.raises(Exception, match="2 x 3"):
        tiff.read(spark, str(tmp_path / "b")).count()


def packed_words(raw):
    """LZW, as plainly as it goes."""
    out, width, table, word = "", 9, {bytes([k]): k for k in range(256)}, b""
    size = 258
    out += f"{256:09b}"
    for x in raw:
        if word + bytes([x]) in table:
            word += bytes([x])
            continue
        out += f"{table[word]:0{width}b}"
        table[word + bytes([x])] = size
        size += 1
        if size == 4094:
            out += f"{256:012b}"
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = max(9, size.bit_length())
        word = bytes([x])
    out += f"{table[word]:0{width}b}{257:0{max(9, (size + 1).bit_length())}b}"
    return bytes(int(out[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(out), 8))


def packed_bits(raw):
    out, k = b"", 0
    while k < len(raw):
        n = 1
        while k + n < len(raw) and raw[k + n] == raw[k] and n < 128:
            n += 1
        out += bytes([257 - n if n > 1 else 0, raw[k]])
        k += n
    return out + b"\x80"


def foreign(path, image, packing, predictor, rows, tile, end):
    """A file of one page as other programs write it: several strips or tiles, either byte order."""
    h, w = image.shape
    kind = image.dtype.str[1:]
    boxes = [(y, x, tile, tile) for y in range(0, h, tile) for x in range(0, w, tile)] if tile else [(y, 0, min(rows, h - y), w) for y in range(0, h, rows)]
    cells = []
    for y, x, th, tw in boxes:
        part = np.zeros((th, tw), image.dtype)
        part[: min(th, h - y), : min(tw, w - x)] = image[y : y + th, x : x + tw]
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=part.dtype.type(0)).astype(image.dtype)
        raw = part.astype(end + kind).tobytes()
        if predictor == 3:
            planes = part.astype(">" + kind).view(np.uint8).reshape(th, tw, -1).transpose(0, 2, 1).reshape(th, -1)
            raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        cells.append({1: bytes, 5: packed_words, 8: zlib.compress, 32773: packed_bits}[packing](raw))
    at = [8 + sum(map(len, cells[:k])) for k in range(len(cells))]
    lists = 8 + sum(map(len, cells))
    n = len(cells)
    places = struct.pack(f"{end}{n}I", *at) + struct.pack(f"{end}{n}I", *map(len, cells))
    short = lambda v: struct.pack(end + "HH", v, 0)
    long = lambda v: struct.pack(end + "I", v)
    tags = [(256, 4, 1, long(w)), (257, 4, 1, long(h)), (258, 3, 1, short(image.itemsize * 8)), (259, 3, 1, short(packing)), (317, 3, 1, short(predictor))]
    tags.append((339, 3, 1, short({"u": 1, "i": 2, "f": 3}[image.dtype.kind])))
    first, counts = (long(lists), long(lists + 4 * n)) if n > 1 else (long(at[0]), long(len(cells[0])))
    tags += [(322, 4, 1, long(tile)), (323, 4, 1, long(tile)), (324, 4, n, first), (325, 4, n, counts)] if tile else [(273, 4, n, first), (278, 4, 1, long(rows)), (279, 4, n, counts)]
    with open(path, "wb") as f:
        f.write({"<": b"II", ">": b"MM"}[end] + struct.pack(end + "HI", 42, lists + len(places)) + b"".join(cells) + places)
        f.write(struct.pack(end + "H", len(tags)) + b"".join(struct.pack(end + "HHI", *t[:3]) + t[3] for t in sorted(tags)) + struct.pack(end + "I", 0))


@pytest.mark.parametrize("packing", [1, 5, 8, 32773])
@pytest.mark.parametrize("end", ["<", ">"])
def test_packed_pages_of_other_programs(tmp_path, packing, end):
    pick = np.random.default_rng(5)
    for kind, predictors in (("u1", (1, 2)), ("i2", (1, 2)), ("u4", (1, 2)), ("f4", (1, 3)), ("f8", (1, 3))):
        image = (pick.integers(0, 9, (37, 50)) * (1 if kind == "u1" else 25.5)).astype(kind)
        for predictor in predictors:
            for rows, tile in ((37, 0), (10, 0), (0, 16)):
                path = str(tmp_path / "x.tif")
                foreign(path, image, packing, predictor, rows, tile, end)
                reader = tiff.TiffReader({"path": path})
                (batch,) = reader.read(reader.partitions()[0])
                assert batch["data"][0].as_py() == image.astype(np.float32).ravel().tolist(), (kind, predictor, rows, tile)


def test_long_words(tmp_path):
    raw = np.random.default_rng(1).integers(0, 4, 60_000).astype(np.uint8).tobytes() + bytes(9000)
    assert tiff.unpacked_words(packed_words(raw)) == raw


def test_files_of_bytes_are_no_movie(tmp_path):
    (tmp_path / "a.tif").write_bytes(b"no movie at all, only text")
    with pytest.raises(ValueError, match="no TIFF"):
        tiff.TiffReader({"path": str(tmp_path)}).partitions()
    assert tiff.TiffReader({"path": os.path.join(tmp_path, "a.tif")}).files()
