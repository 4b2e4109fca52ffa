"""Readers and writers of grids: binary files go through binaryFile and Arrow, one row a slice."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: path, the slice's place in its file, its width and height, and its pixels row by row.
SLICES = "path string, z int, w int, h int, px array<double>"

Decoder = Callable[[bytes], Iterator[np.ndarray]]


def _number(kind: str, little: bool) -> np.dtype:
    return np.dtype(kind).newbyteorder("<" if little else ">")


def raw(width: int, height: int, kind: str = "f4", little: bool = True, header: int = 0) -> Decoder:
    """Slices of numbers without any header, or with one that is skipped; a last, partial slice is left out."""

    def run(data: bytes) -> Iterator[np.ndarray]:
        a = np.frombuffer(data, _number(kind, little), offset=header, count=(len(data) - header) // np.dtype(kind).itemsize)
        for z in range(len(a) // (width * height)):
            yield a[z * width * height : (z + 1) * width * height].reshape(height, width)

    return run


def dennerlein(data: bytes) -> Iterator[np.ndarray]:
    """Width, height and number of slices as 16-bit numbers, then 32-bit slices; slices of 3 x 4 hold 64-bit matrices."""
    w, h, n = (int(v) for v in np.frombuffer(data, "<u2", 3))
    kind = "<f8" if (w, h) in ((4, 3), (3, 4)) else "<f4"
    a = np.frombuffer(data, kind, w * h * n, offset=6)
    yield from a.reshape(n, h, w)


def nrrd(data: bytes) -> Iterator[np.ndarray]:
    """NRRD with attached data: raw, gzip or ascii; two or three dimensions, the first running fastest."""
    head, _, body = data.partition(b"\n\n")
    if b"\r\n\r\n" in data[: len(head) + 4]:
        head, _, body = data.partition(b"\r\n\r\n")
    field = {k.strip().lower(): v.strip() for k, v in (ln.split(":", 1) for ln in head.decode("ascii", "replace").splitlines()[1:] if ":" in ln and not ln.startswith("#"))}
    kinds = {"float": "f4", "double": "f8", "uchar": "u1", "unsigned char": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "unsigned int": "u4", "uint32": "u4"}
    sizes = [int(s) for s in field["sizes"].split()]
    kind = kinds[field["type"].lower()]
    how = field.get("encoding", "raw").lower()
    if how in ("txt", "text", "ascii"):
        a = np.array(body.split(), float)
    else:
        a = np.frombuffer(gzip.decompress(body) if how in ("gz", "gzip") else body, _number(kind, field.get("endian", "little").lower() == "little"), int(np.prod(sizes)))
    yield from a.reshape([-1, *sizes[1::-1]])


def metaimage(data: bytes) -> Iterator[np.ndarray]:
    """MetaImage with LOCAL data."""
    at = re.search(rb"ElementDataFile\s*=\s*LOCAL\r?\n", data)
    if not at:
        raise ValueError("only MetaImage files with their data inside can be read by themselves")
    field = {k.strip(): v.strip() for k, v in (ln.split("=", 1) for ln in data[: at.end()].decode("ascii", "replace").splitlines() if "=" in ln)}
    kind = {"MET_FLOAT": "f4", "MET_DOUBLE": "f8", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4"}[field["ElementType"]]
    sizes = [int(s) for s in field["DimSize"].split()]
    body = data[at.end() :]
    if field.get("CompressedData", "False").lower() == "true":
        body = zlib.decompress(body)
    big = field.get("BinaryDataByteOrderMSB", field.get("ElementByteOrderMSB", "False")).lower() == "true"
    yield from np.frombuffer(body, _number(kind, not big), int(np.prod(sizes))).reshape([-1, *sizes[1::-1]])


def tiff(data: bytes) -> Iterator[np.ndarray]:
    """Uncompressed, single-channel TIFF stacks of 8, 16 or 32-bit integers and 32 or 64-bit floats."""
    little = data[:2] == b"II"
    num = lambda at, size: int.from_bytes(data[at : at + size], "little" if little else "big")
    at = num(4, 4)
    while at:
        tags = {}
        for k in range(num(at, 2)):
            e = at + 2 + 12 * k
            tag, kind, n = num(e, 2), num(e + 2, 2), num(e + 4, 4)
            size = {1: 1, 3: 2, 4: 4}.get(kind)
            if size:
                base = e + 8 if n * size <= 4 else num(e + 8, 4)
                tags[tag] = [num(base + i * size, size) for i in range(n)]
        if tags.get(259, [1])[0] != 1:
            raise ValueError("compressed TIFF files cannot be read")
        w, h, bits, form = tags[256][0], tags[257][0], tags.get(258, [1])[0], tags.get(339, [1])[0]
        kind = {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8)
        body = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
        yield np.frombuffer(body, _number(kind, little), w * h).reshape(h, w)
        at = num(at + 2 + 12 * num(at, 2), 4)


def zipped(inner: Decoder) -> Decoder:
    """The slices of all members of a zip file, by name."""

    def run(data: bytes) -> Iterator[np.ndarray]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                yield from inner(z.read(name))

    return run


#: Formats that need no parameters, by ending.
BY_ENDING: dict[str, Decoder] = {".nrrd": nrrd, ".mha": metaimage, ".tif": tiff, ".tiff": tiff, ".viv": dennerlein, ".bin": dennerlein}


def read_slices(spark: SparkSession, path: str, decoder: Decoder | None = None) -> DataFrame:
    """One row a slice of all files at a path, on whatever storage Spark reads; the decoder by the path's ending if none is
    given. A file is decoded by one task."""
    if decoder is None:
        ending = re.search(r"(\.\w+)[^.]*$", path)
        decoder = BY_ENDING.get(ending[1].lower() if ending else "")
        if decoder is None:
            raise ValueError(f"no reader for {path!r}: pass a decoder")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                for z, a in enumerate(decoder(bytes(data))):
                    yield pd.DataFrame({"path": [name], "z": [z], "w": [a.shape[1]], "h": [a.shape[0]], "px": [a.astype(float).ravel()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SLICES)


def number_in_name(path: str = "path"):
    """The digits of a file's name as a number: the order of slices that are files of their own."""
    return F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]+)$", 1), r"[^0-9]", "").cast("long")


def slices_to_long(slices: DataFrame) -> DataFrame:
    return slices.select("z", "w", F.posexplode("px").alias("_i", "v")).select("z", F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"), (F.col("_i") % F.col("w")).alias("x"), "v")


def encode_raw(slices: DataFrame, kind: str = "<f4") -> DataFrame:
    """(z, content): each slice as bytes, without a header; write them with any sink that takes binary."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: np.asarray(p, kind).tobytes())

    return slices.select("z", F.pandas_udf(run, "binary")("px").alias("content"))


def encode_nrrd(px: np.ndarray) -> bytes:
    """A volume (z, y, x) or slice as NRRD bytes, 32-bit, raw."""
    a = np.atleast_3d(px) if px.ndim < 3 else px
    sizes = " ".join(str(n) for n in (px.shape[::-1] if px.ndim < 3 else a.shape[::-1]))
    return f"NRRD0004\ntype: float\ndimension: {px.ndim}\nsizes: {sizes}\nencoding: raw\nendian: little\n\n".encode() + px.astype("<f4").tobytes()


def encode_dennerlein(volume: np.ndarray) -> bytes:
    n, h, w = volume.shape
    kind = "<f8" if (w, h) in ((4, 3), (3, 4)) else "<f4"
    return np.array([w, h, n], "<u2").tobytes() + volume.astype(kind).tobytes()


def write_slices(slices: DataFrame, path: str) -> None:
    """The table's own form: parquet, a folder a slice."""
    slices.write.mode("overwrite").partitionBy("z").parquet(path)
