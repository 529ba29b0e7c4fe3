"""TIFF stacks as Spark data sources: frames of a movie, or colour and labelled pages.

    movie = tiff.read(spark, path, chunk=16).where("frame between 200 and 299")    # frame, h, w, data
    movie.write.format("tiff").mode("overwrite").save(folder)
    pages = tiff.read(spark, path, kind="tiff_pages")                              # frame, h, w, samples, label, data
    pages.write.format("tiff_pages").mode("overwrite").save(folder)

A movie has one sample a pixel: 8, 16 or 32-bit integers or floats. Pages have one or three bytes a pixel and may have a
label; they are written deflated. Both are read from classic or BigTIFF files in strips or tiles, plain, deflated, LZW or
PackBits, with or without a predictor.

The driver notes where the directory of each page is, and every partition carries that of its own pages, so a task reads
its own directories only. Files that this module wrote end with a list of these places, which spares the driver the walk
along the pages: a task reads its part of the list. Conditions on `frame` leave out partitions before anything of them is
read, and hold exactly inside; Spark hands them over where `spark.sql.python.filterPushdown.enabled` is set, as
tesserae.session does. Rows go out as Arrow batches of a few megabytes.

The files of a folder are one movie, in the order of their names: frames are counted on from file to file. Pages that this
module wrote know their frame, so the order in which tasks wrote does not matter. All pages of a movie have one shape; one
that has another, or another number of samples, fails. Paths are local or of a file system that pyarrow opens (hdfs://,
s3://, gs://, file://).

An overwrite is one step: the list of the movie's files (`_frames`) is replaced when all new files are there, and old
files go afterwards; a failed or aborted job changes nothing and leaves no file.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import MOVIE, PAGE

#: Tags of the format, fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279
PLANES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 16: "Q"}
PLAIN, LZW, DEFLATED, PACKBITS = 1, 5, (8, 32946), 32773
BIG = 2 << 30  # files of this size on are BigTIFF
LISTED = "_frames"  # the files of a movie, one a line
PLACES = b"\0pages\0\1"  # the end of a file that lists where its directories are
BATCH = 4 << 20  # bytes of pixels that go out together
WALKERS = 16  # files whose pages the driver looks up at once
PUSHED = "spark.sql.python.filterPushdown.enabled"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# ---- reading one file


def _header(f) -> tuple[str, bool, int]:
    """Byte order, whether it is a BigTIFF, and where the first directory is."""
    f.seek(0)
    head = f.read(16)
    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    if end is None:
        raise ValueError("no TIFF file")
    big = struct.unpack(end + "H", head[2:4])[0] == 43
    return end, big, struct.unpack(end + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]


def page_places(f) -> list[int]:
    """Where the directory of each page is, by the chain of directories alone."""
    end, big, at = _header(f)
    out = []
    while at:
        out.append(at)
        f.seek(at)
        entries = struct.unpack(end + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        f.seek(at + (8 + 20 * entries if big else 2 + 12 * entries))
        at = struct.unpack(end + ("Q" if big else "I"), f.read(8 if big else 4))[0]
    return out


def listed_places(f, first: int, last: int) -> list[int] | None:
    """Places of pages [first, last) from the list at the end of a file; None if the file has none."""
    size = f.size()
    if size < 32:
        return None
    f.seek(size - 16)
    n, mark = struct.unpack("<Q8s", f.read(16))
    if mark != PLACES:
        return None
    f.seek(size - 16 - 8 * (n - first))
    return list(struct.unpack(f"<{last - first}Q", f.read(8 * (last - first))))


def page_at(f, at: int, head: tuple[str, bool, int]) -> dict:
    """The directory at a place: shape, samples, dtype, parts, and what its description says."""
    end, big, _ = head
    entry = 20 if big else 12
    f.seek(at)
    n = struct.unpack(end + ("Q" if big else "H"), f.read(8 if big else 2))[0]
    raw, tags = f.read(n * entry), {}
    for k in range(n):
        e = raw[k * entry : (k + 1) * entry]
        tag, kind = struct.unpack(end + "HH", e[:4])
        if kind not in SIZES:
            continue
        count = struct.unpack(end + ("Q" if big else "I"), e[4:12] if big else e[4:8])[0]
        size = struct.calcsize("=" + SIZES[kind]) * count
        value = e[12:] if big else e[8:]
        if size > len(value):
            f.seek(struct.unpack(end + ("Q" if big else "I"), value)[0])
            value = f.read(size)
        tags[tag] = struct.unpack(end + f"{count}{SIZES[kind]}", value[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    samples, bits = one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16, 32, 64) or (samples > 1 and one(PLANES, 1) != 1) or one(COMPRESSION, PLAIN) not in (PLAIN, LZW, PACKBITS, *DEFLATED):
        raise ValueError("pages of whole bytes are read, samples side by side: plain, deflated, LZW or PackBits")
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    tiled = TILE_OFFSETS in tags
    part = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, 1 << 31), one(HEIGHT, 0)), one(WIDTH, 0))
    said = one(DESCRIPTION, b"").split(b"\0")[0]
    frame = re.match(rb"frame=(\d+)", said)
    label = re.search(rb"label=(.*)", said, re.DOTALL)
    return {
        "h": one(HEIGHT, 0), "w": one(WIDTH, 0), "samples": samples, "dtype": f"{kind}{bits // 8}", "end": end, "part": part,
        "parts": list(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS])),
        "packed": one(COMPRESSION, PLAIN), "predictor": one(PREDICTOR, 1), "frame": int(frame[1]) if frame else None,
        "label": label[1].decode("utf-8", "replace") if label else None,
    }


def unpacked_bits(raw: bytes) -> bytes:
    """PackBits: a count below 128 says how many bytes follow as they are, one above how often the next is repeated."""
    out, k = bytearray(), 0
    while k < len(raw):
        n = raw[k]
        if n < 128:
            out += raw[k + 1 : k + 2 + n]
            k += n + 2
        else:
            if n > 128:
                out += raw[k + 1 : k + 2] * (257 - n)
            k += 2 if n > 128 else 1
    return bytes(out)


def unpacked_words(raw: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, high bits first, widened one code early; 256 clears, 257 ends."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]
    table, out, before, width, held, bits = list(single), [], None, 9, 0, 0
    for x in raw:
        held, bits = (held << 8 | x) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = list(single), None, 9
            continue
        if before is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else before + before[:1]
            table.append(before + word[:1])
        out.append(word)
        before = word
        width = min(max(9, (len(table) + 1).bit_length()), 12)
    return b"".join(out)


UNPACK = {PLAIN: bytes, LZW: unpacked_words, PACKBITS: unpacked_bits, **dict.fromkeys(DEFLATED, zlib.decompress)}


def _values(raw: bytes, page: dict, rows: int, columns: int) -> np.ndarray:
    """(rows, columns, samples) of one strip or tile."""
    samples, kind = page["samples"], np.dtype(page["end"] + page["dtype"])
    if page["predictor"] == 3:  # bytes of a row by significance, each less the one a pixel before it
        x = np.frombuffer(raw, np.uint8).reshape(rows, kind.itemsize * columns, samples).cumsum(axis=1, dtype=np.uint8)
        x = x.reshape(rows, kind.itemsize, columns * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(x).view(">" + page["dtype"]).reshape(rows, columns, samples)
    x = np.frombuffer(raw, kind, rows * columns * samples).reshape(rows, columns, samples)
    return x.cumsum(axis=1, dtype=x.dtype) if page["predictor"] == 2 else x


def page_pixels(f, page: dict) -> np.ndarray:
    """(h, w, samples) as the file has them."""
    h, w, (rows, columns) = page["h"], page["w"], page["part"]
    out = np.empty((h, w, page["samples"]), page["dtype"])
    across = -(-w // columns)
    for k, (at, n) in enumerate(page["parts"]):
        y, x = k // across * rows, k % across * columns
        f.seek(at)
        raw = UNPACK[page["packed"]](f.read(n))
        tall = rows if columns != w or len(raw) >= rows * columns * page["samples"] * out.dtype.itemsize else h - y  # the last strip may be short
        out[y : y + rows, x : x + columns] = _values(raw, page, tall, columns)[: h - y, : w - x]
    return out


# ---- the sources


class Pages(InputPartition):
    """Pages [first, last) of a file, with the places of their directories if the driver knows them; the file's first page
    is frame `base` of the movie unless the pages say otherwise.
    """

    def __init__(self, path: str, first: int, last: int, base: int, places: list[int] | None, shape: tuple[int, int] | None):
        self.path, self.first, self.last, self.base, self.places, self.shape = path, first, last, base, places, shape


class TiffReader(DataSourceReader):
    """Frames in [start, end), and in `only` if that is given."""

    def __init__(self, options: dict, pictures: bool = False):
        self.path, self.chunk, self.pictures = options["path"], int(options.get("chunk", 16)), pictures
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", -1))
        self.end = self.end if self.end >= 0 else 1 << 62
        self.only: set[int] | None = None

    def files(self) -> list[str]:
        fs, path = file_system(self.path)
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            return [path]
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File]
        if LISTED in names:
            with fs.open_input_stream(posixpath.join(path, LISTED)) as f:
                names = f.read().decode().split("\n")
        own = [n for n in names if n.lower().endswith((".tif", ".tiff")) and not n.startswith("._")]
        return [posixpath.join(path, n) for n in sorted(own, key=str.lower)]

    def wanted(self, first: int, last: int) -> bool:
        """Whether any frame of [first, last) is asked for."""
        first, last = max(first, self.start), min(last, self.end)
        return first < last and (self.only is None or any(first <= k < last for k in self.only))

    def _planned(self, path: str) -> tuple[list[int] | None, int, tuple[int, int]]:
        """Of a file without frames in its name: places of its directories, pages, and the shape of the first."""
        fs, _ = file_system(self.path)
        with fs.open_input_file(path) as f:
            places, head = page_places(f), _header(f)
            page = page_at(f, places[0], head) if places else {"h": 0, "w": 0, "samples": 1}
        self._fits(page, None, path)
        return places, len(places), (page["h"], page["w"])

    def _fits(self, page: dict, shape: tuple[int, int] | None, path: str) -> None:
        if page["samples"] not in ((1, 3) if self.pictures else (1,)):
            raise ValueError(f"{path}: a movie has frames of two dimensions, not {page['samples']} samples a pixel")
        if shape and not self.pictures and shape != (page["h"], page["w"]):
            raise ValueError(f"{path}: a frame of {page['h']} x {page['w']} pixels in a movie of {shape[0]} x {shape[1]}")

    def partitions(self) -> list[Pages]:
        """Ranges of pages that may hold a frame that is asked for."""
        files = self.files()
        named = {p: re.search(r"frames-(\d+)-(\d+)-(\d+)-\w+\.tif$", p) for p in files}  # first and last frame, and how many, as written here
        with ThreadPoolExecutor(WALKERS) as walkers:
            found = dict(zip(others := [p for p in files if not named[p]], walkers.map(self._planned, others)))
        out, base, shape = [], 0, next((s for _, n, s in found.values() if n), None)
        for path in files:
            if named[path]:
                first, last, n = map(int, named[path].groups())
                for k in range(0, n, self.chunk):
                    stop = min(k + self.chunk, n)
                    low, high = (first + k, first + stop) if last - first + 1 == n else (first, last + 1)  # without gaps, pages are frames
                    if self.wanted(low, high):
                        out.append(Pages(path, k, stop, 0, None, shape))
                continue
            places, n, own = found[path]
            if n and own != shape and not self.pictures:
                raise ValueError(f"{path}: frames of {own[0]} x {own[1]} pixels in a movie of {shape[0]} x {shape[1]}")
            for k in range(0, n, self.chunk):
                stop = min(k + self.chunk, n)
                if self.wanted(base + k, base + stop):
                    out.append(Pages(path, k, stop, base, places[k:stop], shape))
            base += n
        return out

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        held, size = [], 0
        with fs.open_input_file(partition.path) as f:
            head = _header(f)
            places = partition.places or listed_places(f, partition.first, partition.last) or page_places(f)[partition.first : partition.last]
            shape = partition.shape
            for k, at in enumerate(places, partition.first):
                guess = partition.base + k
                if partition.places and not self.wanted(guess, guess + 1):
                    continue
                page = page_at(f, at, head)
                frame = guess if page["frame"] is None else page["frame"]
                self._fits(page, shape, partition.path)
                shape = shape or (page["h"], page["w"])
                if self.wanted(frame, frame + 1):
                    held.append((frame, page, page_pixels(f, page)))
                    size += held[-1][2].size * 4
                    if size >= BATCH:
                        yield self.batch(held)
                        held, size = [], 0
        if held:
            yield self.batch(held)

    def batch(self, held: list[tuple[int, dict, np.ndarray]]) -> pa.RecordBatch:
        ints = lambda values: pa.array(values, pa.int32())
        columns = {"frame": ints([k for k, _, _ in held]), "h": ints([x.shape[0] for _, _, x in held]), "w": ints([x.shape[1] for _, _, x in held])}
        if self.pictures:
            columns |= {"samples": ints([x.shape[2] for _, _, x in held]), "label": pa.array([p["label"] for _, p, _ in held], pa.string())}
            columns["data"] = pa.array([_bytes(x).tobytes() for _, _, x in held], pa.binary())
        else:
            edges = np.cumsum([0, *(x.size for _, _, x in held)]).astype(np.int32)
            values = np.concatenate([x.ravel().astype(np.float32) for _, _, x in held])
            columns["data"] = pa.ListArray.from_arrays(pa.array(edges), pa.array(values))
        return pa.RecordBatch.from_pydict(columns)


def _bytes(x: np.ndarray) -> np.ndarray:
    if x.dtype != np.uint8:
        raise ValueError("pages have one byte a sample")
    return x


class PushingReader(TiffReader):
    """The same, where Spark hands conditions over."""

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("frame",):
                yield f
                continue
            value = getattr(f, "value", None)
            match f:
                case ds.EqualTo() if value is not None:
                    self.start, self.end = max(self.start, value), min(self.end, value + 1)
                case ds.GreaterThan() if value is not None:
                    self.start = max(self.start, value + 1)
                case ds.GreaterThanOrEqual() if value is not None:
                    self.start = max(self.start, value)
                case ds.LessThan() if value is not None:
                    self.end = min(self.end, value)
                case ds.LessThanOrEqual() if value is not None:
                    self.end = min(self.end, value + 1)
                case ds.In():
                    own = {v for v in value if v is not None}
                    self.only = own if self.only is None else self.only & own
                case ds.IsNotNull():
                    pass  # every page has a frame
                case _:
                    yield f


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def write_stack(f, images: list[np.ndarray], frames: list[int] | None = None, labels: list[str | None] | None = None) -> None:
    """Images to an open file, a strip a page, with their frame numbers and labels if given; BigTIFF where it would be large.

    Images of bytes, (h, w) or (h, w, 3), are deflated; all others become plain floats. The places of the directories follow.
    """
    packed = [i.dtype == np.uint8 for i in images]
    cells = [zlib.compress(i.tobytes()) if p else i.astype("<f4").tobytes() for i, p in zip(images, packed)]
    big = sum(map(len, cells)) + 400 * len(cells) >= BIG
    f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if big else struct.pack("<2sHI", b"II", 42, 8))
    at, places = 16 if big else 8, []
    for k, (image, cell) in enumerate(zip(images, cells)):
        (h, w), samples, bits = image.shape[:2], 1 if image.ndim == 2 else image.shape[2], 8 if packed[k] else 32
        said = b"frame=%d" % frames[k] if frames else b""
        said += b"\nlabel=" + labels[k].replace("\0", "").encode() if labels and labels[k] is not None else b""
        said += b"\0" * bool(said)
        long = 16 if big else 4
        sizes = struct.pack(f"<{samples}H", *[bits] * samples)  # three do not fit the place of a value in a classic directory
        entries = [(WIDTH, 4, 1, w), (HEIGHT, 4, 1, h), (BITS, 3, samples, bits), (COMPRESSION, 3, 1, DEFLATED[0] if packed[k] else PLAIN)]
        entries += [(PHOTOMETRIC, 3, 1, 2 if samples == 3 else 1), *[(DESCRIPTION, 2, len(said), None)] * bool(said), (OFFSETS, long, 1, None)]
        entries += [(SAMPLES, 3, 1, samples), (ROWS, 4, 1, h), (COUNTS, long, 1, len(cell)), (FORMAT, 3, 1, 1 if packed[k] else 3)]
        text = at + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4)
        said += b"\0" * (-len(said) % 8 + 8 * bool(said))  # longer than a value's place in the directory, so it stands outside
        beside = sizes + b"\0" * (-len(sizes) % 8) if samples > 1 else b""
        data = text + len(said) + len(beside)
        after = data + len(cell)
        after += after % 2
        places.append(at)
        f.write(struct.pack("<Q" if big else "<H", len(entries)))
        for tag, kind, count, value in entries:
            value = {DESCRIPTION: text, OFFSETS: data}.get(tag, value)
            count = len(said) if tag == DESCRIPTION else count
            if tag == BITS and samples > 1:
                value = struct.unpack("<Q", beside[:8])[0] if big else text + len(said)
            f.write(struct.pack("<HHQQ", tag, kind, count, value) if big else struct.pack("<HHII", tag, kind, count, value))
        f.write(struct.pack("<Q" if big else "<I", after if k + 1 < len(images) else 0))
        f.write(said + beside + cell + b"\0" * (after - data - len(cell)))
        at = after
    f.write(b"\0" * (-at % 8) + struct.pack(f"<{len(places)}QQ8s", *places, len(places), PLACES))


class TiffWriter(DataSourceWriter):
    """Every task writes its frames to files of its own, of `file_mb` megabytes about, which bounds what it holds."""

    def __init__(self, options: dict, overwrite: bool, pictures: bool = False):
        self.path, self.overwrite, self.most = options["path"], overwrite, int(options.get("file_mb", 256)) << 20
        self.job, self.pictures = uuid.uuid4().hex[:12], pictures

    def image(self, r: Row) -> np.ndarray:
        if not self.pictures:
            return np.array(r.data, np.float32).reshape(r.h, r.w)
        shape = (r.h, r.w) if r.samples == 1 else (r.h, r.w, r.samples)
        return np.frombuffer(bytes(r.data), np.uint8).reshape(shape)

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyspark import TaskContext

        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        names, held, size, attempt = [], [], 0, TaskContext.get().taskAttemptId()

        def flush() -> None:
            held.sort(key=lambda x: x[0])
            frames = [k for k, _, _ in held]
            names.append(f"frames-{frames[0]:09d}-{frames[-1]:09d}-{len(frames)}-{self.job}_{attempt}_{len(names)}.tif")
            with fs.open_output_stream(posixpath.join(path, names[-1] + ".part")) as f:
                write_stack(f, [image for _, image, _ in held], frames, [label for _, _, label in held])
            held.clear()

        for r in iterator:
            held.append((r.frame, self.image(r), r.label if self.pictures else None))
            size += held[-1][1].nbytes
            if size >= self.most:
                flush()
                size = 0
        if held:
            flush()
        return Written(names)

    def _names(self) -> list[str]:
        fs, path = file_system(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return [i.base_name for i in found if i.type == pafs.FileType.File]

    def commit(self, messages: list[Written]) -> None:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        new = [n for m in messages if m for n in m.names]
        for n in new:
            fs.move(posixpath.join(path, n + ".part"), posixpath.join(path, n))
        there = self._names()
        before = []
        if not self.overwrite:
            before = [posixpath.basename(p) for p in TiffReader({"path": self.path}).files() if posixpath.basename(p) not in new]
        with fs.open_output_stream(posixpath.join(path, f"{LISTED}.{self.job}.part")) as f:
            f.write("\n".join([*before, *new]).encode())
        fs.move(posixpath.join(path, f"{LISTED}.{self.job}.part"), posixpath.join(path, LISTED))
        self._remove(n for n in there if self.job in n and n.endswith(".part"))  # of attempts that lost
        if self.overwrite:
            self._remove(n for n in there if n.endswith(".tif") and n not in new)

    def abort(self, messages: list[Written]) -> None:
        self._remove(n for n in self._names() if self.job in n)

    def _remove(self, names) -> None:
        fs, path = file_system(self.path)
        for n in names:
            fs.delete_file(posixpath.join(path, n))


class TiffSource(DataSource):
    """Frames of a movie."""

    pictures = False

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self):
        return MOVIE

    def reader(self, schema) -> TiffReader:
        kind = PushingReader if self.options.get("push") == "true" else TiffReader
        return kind(self.options, self.pictures)

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        return TiffWriter(self.options, overwrite, self.pictures)


class TiffPages(TiffSource):
    """Pages of one or three bytes a pixel, with a label each or none."""

    pictures = True

    @classmethod
    def name(cls) -> str:
        return "tiff_pages"

    def schema(self):
        return PAGE


def read(spark: SparkSession, path: str, kind: str = "tiff", **options: int) -> DataFrame:
    """A stack, with conditions on frame handed over where the session allows it. options: chunk, start, end."""
    spark.dataSource.register(TiffSource)
    spark.dataSource.register(TiffPages)
    push = spark.conf.get(PUSHED, "false").lower()
    return spark.read.format(kind).options(push=push, **{k: str(v) for k, v in options.items()}).load(path)
