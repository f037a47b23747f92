"""Scan formats: text with a column order for each format, poses, frames, PLY, KITTI and LAS; and their writers.

A format is a row of a table: suffix, columns and the change of axes and units that brings it into the point model.
Text is read as lines in Spark. Decimal numbers stay in the JVM; hexadecimal ones, which no built-in function reads, go
through one Arrow batch function only if a file has them. Files inside zip archives and binary formats are read whole by
`binaryFile`, one file at a time.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from scanloom import schema

XYZ = ("x", "y", "z")
RGB = ("r", "g", "b")


def _same(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, y, z


def _metres(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return -100 * y, 100 * z, 100 * x


def _ks(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return (x - 70000) * 100, z * 100, (y - 20000) * 100


def _rts(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return 0.1 * y, -0.1 * z, 0.1 * x


def _pts(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return x, y, -z


@dataclass(frozen=True)
class Format:
    columns: tuple[str, ...]
    suffix: str = ".3d"
    axes: Callable[[Column, Column, Column], tuple[Column, Column, Column]] = _same
    prefix: str = "scan"
    valid: Callable[[], Column] | None = None


R, T = ("reflectance",), ("type",)
#: The formats by name. "_" is a column that is read over.
FORMATS: dict[str, Format] = {
    "uos": Format(XYZ), "uosr": Format(XYZ + R), "uos_rgb": Format(XYZ + RGB), "uos_rgbr": Format(XYZ + RGB + R), "uos_rrgb": Format(XYZ + R + RGB),
    "uos_rrgbt": Format(XYZ + R + RGB + ("temperature",)), "uos_normal": Format(XYZ + ("nx", "ny", "nz")), "uosc": Format(XYZ + T),
    **{name: Format(XYZ + rest, ".xyz", _metres) for name, rest in {"xyz": (), "xyzr": R, "xyzc": T, "xyz_rgb": RGB, "xyz_rgba": RGB + R, "xyz_rgbr": RGB + R, "xyz_rrgb": R + RGB}.items()},
    **{name: Format(XYZ + rest, ".pts", _pts) for name, rest in {"pts": (), "ptsr": R, "pts_rgb": RGB, "pts_rgbr": RGB + R, "pts_rrgb": R + RGB}.items()},
    "faro_xyz_rgbr": Format(("_", "_") + XYZ + RGB + R, ".xyz"), "leica_xyzr": Format(XYZ + ("_", "_") + R, ".pts"),
    "ks": Format(XYZ, " - Scan001.txt", _ks, "Stephan"), "ks_rgb": Format(XYZ + RGB + ("amplitude",) + R, " - Scan001.txt", _ks, "Stephan"),
    "riegl_txt": Format(XYZ + ("_", "_", "_") + R, ".txt", _metres), "riegl_rgb": Format(XYZ + ("_", "_", "_") + RGB + R, ".txt", _metres),
    "rts": Format(XYZ + T + ("_", "_"), ".dat", _rts, "scan3d_0_", lambda: F.col("type").bitwiseAND(0x10) == 0),
}

#: Lines at the head of a file that may be no points.
HEADER_LINES = 10


def register(name: str, fmt: Format) -> None:
    FORMATS[name] = fmt


NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*([pP][+-]?\d+)?|inf|nan)$"


def _numbers(line: Column, n: int) -> tuple[Column, Column]:
    """(fields of a line, whether it is a line of n numbers): whitespace between, `#` starts a comment."""
    fields = F.split(F.trim(F.regexp_replace(F.regexp_replace(line, "#.*$", ""), r"[\s]+", " ")), " ")
    return fields, (F.size(fields) == n) & F.forall(fields, lambda x: x.rlike(NUMBER))


@F.pandas_udf(types.ArrayType(types.DoubleType()))
def _hexadecimal(fields: pd.Series) -> pd.Series:
    return fields.map(lambda f: [float.fromhex(x) if "x" in x.lower() else float(x) for x in f])


def read_text(spark: SparkSession, path: str | list[str], fmt: str, scan_id: int | None = None) -> DataFrame:
    """Points of text files. point_id is the line number, which also decides what is a header: up to ten leading lines
    of a file may be no points; any later line that is none, and is not blank or a comment, fails the read.

    The scan's number is the digits after the format's prefix in the file's name unless it is given.
    """
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    files = spark.read.text(path, wholetext=True).select("value", name.alias("file"))
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("point_id", "line"))
    number = F.lit(scan_id) if scan_id is not None else F.regexp_extract("file", r"(\d+)", 1).cast("int")
    return parsed(lines.select(number.alias("scan_id"), F.col("point_id").cast("long").alias("point_id"), "file", "line"), fmt)


def parsed(lines: DataFrame, fmt: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Points from lines (scan_id, point_id, file, line) of a text format; the first HEADER_LINES of a file by point_id
    may be no points. Columns to keep go along with their line."""
    f = FORMATS[fmt]
    fields, ok = _numbers(F.col("line"), len(f.columns))
    blank = F.trim(F.regexp_replace("line", "#.*$", "")) == ""
    rows = lines.select("scan_id", "point_id", *keep, "file", fields.alias("f"), ok.alias("ok"), blank.alias("blank"), "line").where("not blank")
    bad = F.raise_error(F.concat(F.lit("not a line of points in "), F.col("file"), F.lit(": "), F.col("line")))
    rows = rows.where(F.when(F.col("ok"), True).when(F.col("point_id") < HEADER_LINES, False).otherwise(bad.cast("boolean")))
    values = F.when(F.exists("f", lambda x: F.lower(x).contains("x")), _hexadecimal(F.col("f"))).otherwise(F.transform(F.col("f"), lambda x: x.try_cast("double")))
    return modelled(rows.select("scan_id", "point_id", *keep, values.alias("v")), f, keep)


def modelled(rows: DataFrame, f: Format, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (scan_id, point_id, v) in the columns of a format, as the point model."""
    raw = rows.select("scan_id", "point_id", *keep, *[F.element_at("v", k + 1).alias(c) for k, c in enumerate(f.columns) if c != "_"])
    if "type" in f.columns:
        raw = raw.withColumn("type", F.col("type").cast("int"))
    if f.valid:
        raw = raw.where(f.valid())
    x, y, z = f.axes(F.col("x"), F.col("y"), F.col("z"))
    out = raw.withColumns({"x": x, "y": y, "z": z})
    return out.select(*[(F.col(c.name) if c.name in raw.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in schema.POINTS], *keep)


def read_zip(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Points of text files inside zip archives; an archive is one task's work."""
    f = FORMATS[fmt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    for name in sorted(archive.namelist()):
                        base = name.rsplit("/", 1)[-1]
                        if not (base.startswith(f.prefix) and base.endswith(f.suffix)):
                            continue
                        rows = []
                        for k, line in enumerate(archive.read(name).decode().splitlines()):
                            fields = line.split("#")[0].split()
                            try:
                                values = [float.fromhex(x) if "x" in x.lower() else float(x) for x in fields]
                            except ValueError:
                                values = []
                            if fields and len(values) == len(f.columns):
                                rows.append((int("".join(c for c in base[len(f.prefix) :] if c.isdigit())[:3]), k, values))
                            elif fields and k >= HEADER_LINES:
                                raise ValueError(f"not a line of points in {name}: {line}")
                        yield pd.DataFrame(rows, columns=["scan_id", "point_id", "v"])

    return modelled(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "scan_id int, point_id long, v array<double>"), f)


def _stripped(c: str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """scan_id and tx, ty, tz (units of the scan), rx, ry, rz (radians) from pose files in degrees."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return parsed_poses(spark.read.text(path, wholetext=True).select(F.regexp_extract(name, r"(\d+)", 1).cast("int").alias("scan_id"), "value"))


def parsed_poses(texts: DataFrame) -> DataFrame:
    """read_poses() of texts (scan_id, value)."""
    files = texts.select("scan_id", F.split(_stripped("value"), r"\s+").alias("v"))
    v = lambda k: F.element_at("v", k + 1).cast("double")
    return files.select("scan_id", *[v(k).alias(c) for k, c in enumerate(("tx", "ty", "tz"))], *[F.radians(v(k + 3)).alias(c) for k, c in enumerate(("rx", "ry", "rz"))])


def pose_text(poses: DataFrame) -> DataFrame:
    """(scan_id, value): pose files, two lines of position and degrees."""
    line = lambda names, f: F.concat_ws(" ", *[f(F.col(c)).cast("string") for c in names])
    return poses.select("scan_id", F.concat(line(("tx", "ty", "tz"), lambda c: c), F.lit("\n"), line(("rx", "ry", "rz"), F.degrees), F.lit("\n")).alias("value"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """scan_id, seq, m (sixteen numbers, column-major) and algo of frames files."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return parsed_frames(spark.read.text(path, wholetext=True).select(F.regexp_extract(name, r"(\d+)", 1).cast("int").alias("scan_id"), "value"))


def parsed_frames(texts: DataFrame) -> DataFrame:
    """read_frames() of texts (scan_id, value)."""
    files = texts.select("scan_id", F.posexplode(F.split(_stripped("value"), "\r?\n")).alias("seq", "line"))
    v = F.split(_stripped("line"), r"\s+")
    return files.select("scan_id", "seq", F.transform(F.slice(v, 1, 16), lambda x: x.cast("double")).alias("m"), F.element_at(v, 17).cast("int").alias("algo"))


def frame_lines(frames: DataFrame) -> DataFrame:
    """(scan_id, seq, value): the lines of frames files."""
    return frames.select("scan_id", "seq", F.concat_ws(" ", F.transform("m", lambda x: x.cast("string")), F.col("algo").cast("string")).alias("value"))


def with_frame(points: DataFrame, frames: DataFrame, nth: int = 1) -> DataFrame:
    """points moved by the nth frame from the end of their scan."""
    from scanloom.functions import geometry as g
    from scanloom.operators import trajectory

    last = trajectory.last_frames(frames, nth=nth).select("scan_id", "m")
    both = points.join(last, "scan_id")
    x, y, z = g.transform([F.element_at("m", k + 1) for k in range(16)], XYZ)
    return both.withColumns({"x": x, "y": y, "z": z}).drop("m")


def _binary(spark: SparkSession, path: str, decode: Callable[[bytes], pd.DataFrame]) -> DataFrame:
    fields = ", ".join(f"{c.name} {c.dataType.simpleString()}" for c in schema.POINTS)
    names = [c.name for c in schema.POINTS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, blob in zip(pdf["path"], pdf["content"], strict=True):
                out = decode(blob)
                digits = "".join(c for c in file.rsplit("/", 1)[-1] if c.isdigit())
                out["scan_id"], out["point_id"] = int(digits or 0), np.arange(len(out))
                yield out.reindex(columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, fields)


_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def decode_ply(blob: bytes) -> pd.DataFrame:
    head, _, body = blob.partition(b"end_header\n")
    kind, n, fields, here = "ascii", 0, [], ""
    for line in head.decode("ascii").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            kind = word[1]
        elif word[:1] == ["element"]:
            here = word[1]
            n = int(word[2]) if here == "vertex" else n
        elif word[:1] == ["property"] and here == "vertex":
            fields.append((word[2], _PLY[word[1]]))
    if kind == "ascii":
        rows = np.array([line.split()[: len(fields)] for line in body.decode("ascii").splitlines()[:n]], float).reshape(-1, len(fields))
        data = {name: rows[:, k] for k, (name, _) in enumerate(fields)}
    else:
        order = "<" if "little" in kind else ">"
        table = np.frombuffer(body, np.dtype([(name, order + t) for name, t in fields]), n)
        data = {name: table[name].astype(float) for name, _ in fields}
    out = pd.DataFrame({c: data[c] for c in (*XYZ, "nx", "ny", "nz") if c in data})
    for c, long in zip(RGB, ("red", "green", "blue"), strict=True):
        if long in data or c in data:
            out[c] = data.get(long, data.get(c)).astype("int16")
    return out


def decode_kitti(blob: bytes) -> pd.DataFrame:
    """float32 x, y, z (metres, x ahead) and reflectance."""
    p = np.frombuffer(blob, "<f4").reshape(-1, 4).astype(float)
    return pd.DataFrame({"x": -100 * p[:, 1], "y": 100 * p[:, 2], "z": 100 * p[:, 0], "reflectance": p[:, 3].astype("float32")})


def decode_las(blob: bytes) -> pd.DataFrame:
    """Uncompressed LAS 1.0 to 1.3: header-driven offsets, scales and point size."""
    if blob[:4] != b"LASF":
        raise ValueError("not a LAS file")
    start, = struct.unpack_from("<I", blob, 96)
    kind, size, n = struct.unpack_from("<BHI", blob, 104)
    if kind & 0xC0:
        raise ValueError("compressed LAS (LAZ) needs third-party code")
    scale, offset = np.array(struct.unpack_from("<3d", blob, 131)), np.array(struct.unpack_from("<3d", blob, 155))
    rows = np.frombuffer(blob, np.dtype([("p", "<i4", 3), ("i", "<u2"), ("rest", f"V{size - 14}")]), n, start)
    xyz = rows["p"] * scale + offset
    return pd.DataFrame({"x": -100 * xyz[:, 1], "y": 100 * xyz[:, 2], "z": 100 * xyz[:, 0], "reflectance": rows["i"].astype("float32"), "type": np.frombuffer(rows["rest"].tobytes(), np.uint8).reshape(n, -1)[:, 1].astype("int32") if size > 15 else 0})


DECODERS: dict[str, Callable[[bytes], pd.DataFrame]] = {"ply": decode_ply, "kitti": decode_kitti, "las": decode_las}


def read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt in DECODERS:
        return _binary(spark, path, DECODERS[fmt])
    if fmt not in FORMATS:
        raise ValueError(f"no such format: {fmt}; {', '.join([*FORMATS, *DECODERS])}")
    return read_text(spark, path, fmt)


#: Writers turn the axes back.
_BACK: dict[Callable, Callable[[Column, Column, Column], tuple[Column, Column, Column]]] = {
    _same: _same,
    _metres: lambda x, y, z: (z / 100, -x / 100, y / 100),
    _pts: _pts,
    _rts: lambda x, y, z: (10 * z, 10 * x, -10 * y),
    _ks: lambda x, y, z: (x / 100 + 70000, z / 100 + 20000, y / 100),
}


@F.pandas_udf(types.StringType())
def _hex_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: float(v).hex())


def lines(points: DataFrame, fmt: str, hexadecimal: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, value): the text lines of points in a format."""
    f = FORMATS[fmt]
    back = dict(zip(XYZ, _BACK[f.axes](F.col("x"), F.col("y"), F.col("z")), strict=True))
    text = lambda c: _hex_text(back[c]) if hexadecimal and c in back else (back.get(c, F.col(c) if c != "_" else F.lit(0))).cast("string")
    return points.select("scan_id", *keep, F.concat_ws(" ", *[text(c) for c in f.columns]).alias("value"))


def _written(v: pa.Array) -> pa.Array:
    """Numbers as text that reads as the same numbers; a number that is there often is written once."""
    coded = v.dictionary_encode()
    if 4 * len(coded.dictionary) > len(v):
        return pc.cast(v, pa.string())
    return pa.array([repr(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def line_batches(table: pa.Table, names: Sequence[str]) -> Iterator[tuple[str, pa.Array]]:
    """(format, lines) of a batch of points: lines() with numbers that several formats have alike written once. Only the digits of very
    large and very small numbers and of whole ones may look otherwise than there."""
    xyz = [table.column(c) for c in XYZ]
    missing = any(c.null_count for c in xyz)
    xyz = [c.to_numpy() for c in xyz]
    texts: dict[tuple, pa.Array] = {}
    for name in names:
        f, line = FORMATS[name], []
        for c in f.columns:
            key = (f.axes if c in XYZ else None, c)
            if key not in texts:
                v = pa.array(_BACK[f.axes](*xyz)[XYZ.index(c)], from_pandas=missing) if c in XYZ else pa.array(np.zeros(len(table), np.int64)) if c == "_" else table.column(c).combine_chunks()
                texts[key] = _written(v)
            line.append(texts[key])
        yield name, pc.binary_join_element_wise(*line, " ", null_handling="skip")


def _decimals(lines: pa.StringArray, n: int) -> list[np.ndarray] | None:
    """The columns of lines of n finite decimal numbers with a space between; None if some line is not of that kind."""
    if not len(lines):
        return [np.zeros(0)] * n
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer()
    names = [str(k) for k in range(n)]
    convert = csv.ConvertOptions(column_types=dict.fromkeys(names, pa.float64()), null_values=[], strings_can_be_null=False)
    try:
        table = csv.read_csv(pa.BufferReader(text), csv.ReadOptions(use_threads=False, column_names=names), csv.ParseOptions(delimiter=" ", quote_char=False, ignore_empty_lines=False), convert)
    except pa.ArrowInvalid:
        return None
    values = [c.to_numpy() for c in table.columns]
    return values if table.num_rows == len(lines) and all(np.isfinite(v).all() for v in values) else None


def read_lines(lines: pa.StringArray, ids: np.ndarray, fmt: str, file: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(columns of the point model, numbers of the lines that are points) as parsed() has them, before any filter of the format."""
    f = FORMATS[fmt]
    values, kept = _decimals(lines, len(f.columns)), np.arange(len(lines))
    if values is None:
        number, rows, kept = re.compile(NUMBER, re.ASCII), [], []
        for k, line in enumerate(lines.to_pylist()):
            text = re.sub("#.*$", "", line)
            fields = re.sub(r"\s+", " ", text, flags=re.ASCII).strip(" ").split(" ")
            if len(fields) == len(f.columns) and all(number.match(v) for v in fields):
                rows.append([float.fromhex(v) if "x" in v.lower() else float(v) for v in fields])
                kept.append(k)
            elif text.strip(" ") and ids[k] >= HEADER_LINES:
                raise ValueError(f"not a line of points in {file}: {line}")
        values, kept = list(np.array(rows, float).reshape(-1, len(f.columns)).T), np.array(kept, int)
    raw = {c: v for c, v in zip(f.columns, values, strict=True) if c != "_"}
    raw |= dict(zip(XYZ, f.axes(*[raw[c] for c in XYZ]), strict=True))
    kinds = {c.name: c.dataType for c in schema.POINTS}
    return {c: _cast(v, kinds[c]) for c, v in raw.items()}, kept


def _cast(v: np.ndarray, kind: types.DataType) -> np.ndarray:
    if isinstance(kind, (types.ShortType, types.IntegerType)):
        bound = np.iinfo(np.int16 if isinstance(kind, types.ShortType) else np.int32)
        v = np.trunc(v)
        if not ((v >= bound.min) & (v <= bound.max)).all():
            raise OverflowError(f"not a {kind.simpleString()}")
        return v.astype(bound.dtype)
    return v.astype(np.float32) if isinstance(kind, types.FloatType) else v


def _decimal(v: np.ndarray) -> np.ndarray:
    """Doubles of the numbers that the digits of a column say."""
    if v.dtype != np.float32:
        return v.astype(float)
    coded = pa.array(v).dictionary_encode()
    return np.array([float(str(x)) for x in coded.dictionary.to_numpy()])[coded.indices.to_numpy()]


#: Batches of points whose lines are read at once.
BATCHES = 8


def read_back(points: DataFrame, names: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """(format, scan_id, n, sums of x, y, z and the channels): each point is written as a line of each format and read again, in one
    pass over the points. A filter of a format may look at the type."""
    out = [*XYZ, *channels]
    filtered = [name for name in names if FORMATS[name].valid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        while some := list(islice(batches, BATCHES)):
            table = pa.Table.from_batches(some).combine_chunks()
            scans = table.column("scan_id").combine_chunks().dictionary_encode(null_encoding="encode")
            code, ids = scans.indices.to_numpy(), table.column("point_id").fill_null(HEADER_LINES).to_numpy()
            rows = []
            for name, lines in line_batches(table, names):
                read, kept = read_lines(lines, ids, name, "memory")
                of = code[kept]
                kinds, kind = np.unique(read["type"], return_inverse=True) if name in filtered else ([None], 0)
                of = of * len(kinds) + kind
                n = np.bincount(of, minlength=len(scans.dictionary) * len(kinds))
                sums = {c: np.bincount(of, _decimal(read[c]), len(n)).tolist() for c in out if c in read}
                for k in np.flatnonzero(n).tolist():
                    scan, type_ = scans.dictionary[k // len(kinds)].as_py(), kinds[k % len(kinds)]
                    rows.append({"format": name, "scan_id": scan, "type_": None if type_ is None else int(type_), "n": int(n[k])} | {c: sums[c][k] if c in sums else None for c in out})
            kind = pa.schema([("format", pa.string()), ("scan_id", scans.dictionary.type), ("type_", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in out]])
            yield pa.RecordBatch.from_pylist(rows, kind)

    numbers = [F.col(c).cast("double") if points.schema[c].dataType.typeName() == "decimal" else F.col(c) for c in out]
    sums = points.select("scan_id", "point_id", *[v.alias(c) for v, c in zip(numbers, out, strict=True)]).mapInArrow(run, f"format string, scan_id {points.schema['scan_id'].dataType.simpleString()}, type_ int, n long, " + ", ".join(f"{c} double" for c in out))
    for name in filtered:
        right = sums.select(F.col("type_").alias("type"), F.struct("*").alias("s")).where((F.col("s.format") != name) | FORMATS[name].valid())
        sums = right.select("s.*")
    return sums.groupBy("format", "scan_id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in out])


def write(points: DataFrame, path: str, fmt: str, hexadecimal: bool = False) -> None:
    """A folder scan_id=N of text parts for each scan; parts stay parallel, point order in them is the input's."""
    lines(points, fmt, hexadecimal).write.partitionBy("scan_id").text(path)


def export_points(points: DataFrame, frames: DataFrame | None, path: str, fmt: str = "uos", nth: int = 1) -> None:
    """All scans as one folder of text parts, in the global frame of the nth frame from the end if there are frames."""
    world = with_frame(points, frames, nth) if frames is not None else points
    lines(world, fmt).select("value").write.text(path)


def write_frames(frames: DataFrame, path: str, mode: str = "append") -> None:
    frame_lines(frames.orderBy("scan_id", "seq")).select("scan_id", "value").write.mode(mode).partitionBy("scan_id").text(path)


def write_trajectory(poses: DataFrame, path: str, metres: bool = False) -> None:
    """Positions (scan_id, tx, ty, tz) in order, a line each; right-handed metres on request."""
    x, y, z = (F.col("tz") / 100, -F.col("tx") / 100, F.col("ty") / 100) if metres else (F.col("tx"), F.col("ty"), F.col("tz"))
    poses.orderBy("scan_id").select(F.concat_ws(" ", *[c.cast("string") for c in (x, y, z)]).alias("value")).write.text(path)


def modified(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of files, whose contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")


def graph_text(links: DataFrame) -> DataFrame:
    """(a, b, value): the lines of an undirected graph in dot notation, without its braces."""
    return links.select("a", "b", F.concat(F.lit("  "), F.col("a").cast("string"), F.lit(" -- "), F.col("b").cast("string"), F.lit(";")).alias("value"))


def write_features(features: DataFrame, path: str, relation: str | None = None) -> None:
    """Numeric features as CSV parts with a header each, or, with the name of a relation, as parts of an ARFF file's data
    beside its header."""
    if relation is None:
        features.write.option("header", True).csv(path)
        return
    head = [f"@RELATION {relation}", *[f"@ATTRIBUTE {c} NUMERIC" for c in features.columns], "@DATA"]
    features.sparkSession.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.text(f"{path}/header")
    features.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in features.columns]).alias("value")).write.text(f"{path}/data")


def ply_head(n: int, colours: bool) -> str:
    rgb = [f"property uchar {c}" for c in ("red", "green", "blue")] if colours else []
    return "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *[f"property double {c}" for c in XYZ], *rgb, "end_header"])


def ply_lines(points: DataFrame, colours: bool = True) -> DataFrame:
    """(value): the vertex lines of an ASCII PLY."""
    rgb = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in RGB] if colours else []
    return points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in XYZ], *rgb).alias("value"))


def write_ply(points: DataFrame, path: str, colours: bool = True) -> None:
    """An ASCII PLY as a folder: its header, which has the number of points, and its vertices in parallel parts."""
    points.sparkSession.createDataFrame([(ply_head(points.count(), colours),)], "value string").coalesce(1).write.text(f"{path}/header")
    ply_lines(points, colours).write.text(f"{path}/vertices")


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(kind, k, value): the lines of an OBJ file from vertices (k, x, y, z) and faces (k, a, b, c: numbers of vertices,
    from 0), in the order of kind and k."""
    v = vertices.select(F.lit(0).alias("kind"), "k", F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in XYZ]).alias("value"))
    f = faces.select(F.lit(1).alias("kind"), "k", F.concat_ws(" ", F.lit("f"), *[(F.col(c) + 1).cast("string") for c in ("a", "b", "c")]).alias("value"))
    return v.unionByName(f)


def parsed_obj(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: k, x, y, z; triangles: k, a, b, c) from lines (k, value) of an OBJ file, whose k is their order. A face of
    more corners is a fan of triangles; texture and normal numbers are read over, and numbers below 0 count from the last."""
    words = lines.select("k", F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))
    number = F.row_number().over(Window.orderBy("k")) - 1
    v = words.where(F.element_at("w", 1) == "v").select(number.cast("long").alias("k"), *[F.element_at("w", i + 2).cast("double").alias(c) for i, c in enumerate(XYZ)])
    ends = F.transform(F.slice("w", 2, F.size("w") - 1), lambda x: F.split_part(x, F.lit("/"), F.lit(1)).cast("long"))
    f = words.where(F.element_at("w", 1) == "f").select("k", ends.alias("e"))
    n = v.count()
    f = f.select("k", F.transform("e", lambda x: F.when(x < 0, x + n).otherwise(x - 1)).alias("e"))
    fan = f.select("k", "e", F.explode(F.sequence(F.lit(2), F.size("e") - 1)).alias("i"))
    return v, fan.select("k", F.element_at("e", 1).alias("a"), F.element_at("e", F.col("i")).alias("b"), F.element_at("e", F.col("i") + 1).alias("c"))


def parsed_positions(lines: DataFrame) -> DataFrame:
    """(time, lat, lon, alt, quality) from lines (value) of a positions file: date, time, degrees, metres and the quality of
    the fix; lines that begin with % are comments."""
    words = lines.where(~F.trim("value").startswith("%") & (F.trim("value") != "")).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("w"))
    at = lambda k: F.element_at("w", k)
    return words.select(F.try_to_timestamp(F.concat_ws(" ", at(1), at(2)), F.lit("yyyy/MM/dd HH:mm:ss.SSS")).alias("time"), *[at(k + 3).cast("double").alias(c) for k, c in enumerate(("lat", "lon", "alt"))], at(6).cast("int").alias("quality"))
