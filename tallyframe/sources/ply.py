"""PLY point clouds as a Spark data source, and a sink that appends properties.

``spark.read.format("ply").load(path)`` takes the schema from the file's header, splits
the fixed-stride records of the vertex element into byte ranges and yields Arrow
batches of the columns that are asked for, with ``entity`` as the record's position.
Little- and big-endian binary files; list properties of the vertex element and
ASCII files are refused. Paths are opened through Arrow's file systems.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Scalar types of the format, their NumPy codes and Spark types.
TYPES = {
    "char": ("i1", "tinyint"), "int8": ("i1", "tinyint"), "uchar": ("u1", "smallint"), "uint8": ("u1", "smallint"),
    "short": ("i2", "smallint"), "int16": ("i2", "smallint"), "ushort": ("u2", "int"), "uint16": ("u2", "int"),
    "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "bigint"), "uint32": ("u4", "bigint"),
    "float": ("f4", "float"), "float32": ("f4", "float"), "double": ("f8", "double"), "float64": ("f8", "double"),
}
ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
CHUNK = 8 << 20


def _open(path: str):
    from pyarrow import fs

    filesystem, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return filesystem, at


@dataclass(frozen=True)
class Header:
    """What a header says of the first element's records."""

    lines: tuple[str, ...]
    size: int
    order: str
    count: int
    properties: tuple[tuple[str, str], ...]

    @property
    def record(self) -> np.dtype:
        return np.dtype([(n, self.order + TYPES[t][0]) for n, t in self.properties])


def read_header(path: str) -> Header:
    filesystem, at = _open(path)
    with filesystem.open_input_file(at) as f:
        raw = b""
        while b"end_header\n" not in raw:
            piece = f.read(4096)
            if not piece:
                raise ValueError(f"{path}: no end of the header")
            raw += piece
    size = raw.index(b"end_header\n") + len(b"end_header\n")
    lines = raw[:size].decode("ascii").splitlines()
    if lines[0].strip() != "ply":
        raise ValueError(f"{path}: not a PLY file")
    order, count, properties, element = "", 0, [], ""
    for line in lines[1:]:
        part = line.split()
        if part[:1] == ["format"]:
            if part[1] == "ascii":
                raise ValueError(f"{path}: ASCII files are not read")
            order = "<" if part[1] == "binary_little_endian" else ">"
        elif part[:1] == ["element"]:
            if not element and part[1] != "vertex":
                raise ValueError(f"{path}: the first element is not vertex")
            element = part[1]
            count = int(part[2]) if element == "vertex" else count
        elif part[:1] == ["property"] and element == "vertex":
            if part[1] == "list":
                raise ValueError(f"{path}: list properties of vertices are not read")
            properties.append((part[2], part[1]))
    return Header(tuple(lines), size, order, count, tuple(properties))


class PlyPartition(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self):
        count = read_header(self.path).count
        return [PlyPartition(a, min(a + self.rows, count)) for a in range(0, count, self.rows)] or [PlyPartition(0, 0)]

    def read(self, partition):
        header = read_header(self.path)
        step = max(1, CHUNK // header.record.itemsize)
        filesystem, at = _open(self.path)
        with filesystem.open_input_file(at) as f:
            f.seek(header.size + partition.first * header.record.itemsize)
            for a in range(partition.first, partition.last, step):
                n = min(step, partition.last - a)
                data = f.read(n * header.record.itemsize)
                if len(data) != n * header.record.itemsize:
                    raise ValueError(f"{self.path}: shorter than its header says")
                rows = np.frombuffer(data, dtype=header.record)
                types = dict(header.properties)
                columns = [
                    pa.array(np.arange(a, a + n)) if c.name == "entity" else pa.array(rows[c.name].astype(rows[c.name].dtype.newbyteorder("="))).cast(ARROW[TYPES[types[c.name]][1]])
                    for c in self.schema.fields
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.name for c in self.schema.fields])


class PlyDataSource(DataSource):
    """Options: path, and rowsPerPartition."""

    @classmethod
    def name(cls):
        return "ply"

    def schema(self):
        header = read_header(self.options["path"])
        return ", ".join(["entity bigint", *(f"`{n}` {TYPES[t][1]}" for n, t in header.properties)])

    def reader(self, schema):
        return PlyReader(self.options["path"], schema, int(self.options.get("rowsPerPartition", "1000000")))


def read_ply(spark: SparkSession, path: str, rows_per_partition: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(PlyDataSource)
    return spark.read.format("ply").option("rowsPerPartition", rows_per_partition).load(path)


def vertex_count(path: str) -> int:
    return read_header(path).count


def with_property(header: Header, name: str, kind: str) -> list[str]:
    """The header's lines with a property added at the end of the vertex element."""
    if any(n == name for n, _ in header.properties):
        raise ValueError(f"property {name} exists")
    at = max(i for i, line in enumerate(header.lines) if line.startswith("property") and line.split()[-1] == header.properties[-1][0])
    return [*header.lines[: at + 1], f"property {kind} {name}", *header.lines[at + 1 :]]


def write_ply(points: DataFrame, path: str, kinds: dict[str, str], rows_per_part: int = 1_000_000) -> None:
    """Write (entity, columns of ``kinds``) as one little-endian file, entities from 0 without gaps.

    Tasks write the bodies of ranges of entities side by side; the driver puts the
    header before them and joins them as streams. An existing file is refused.
    """
    if not kinds:
        raise ValueError("no property")
    filesystem, at = _open(path)
    from pyarrow import fs

    if filesystem.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    filesystem.create_dir(at.rpartition("/")[0], recursive=True)
    dtype = [(n, "<" + TYPES[t][0]) for n, t in kinds.items()]
    total = points.agg(F.count("*").alias("n"), F.min("entity").alias("a"), F.max("entity").alias("b"), F.countDistinct("entity").alias("u")).first()
    if total["n"] and (total["a"] != 0 or total["b"] != total["n"] - 1 or total["u"] != total["n"]):
        raise ValueError("entities must be 0 to n - 1")

    def run(key, table):
        part = key[0].as_py()
        table = table.sort_by("entity")
        rows = np.empty(table.num_rows, dtype=np.dtype(dtype))
        for n, _ in dtype:
            rows[n] = table.column(n).to_numpy()
        name = f"{at}.part-{part:08d}"
        filesystem_, _ = _open(path)
        # A repeated attempt writes the same bytes under the same name.
        with filesystem_.open_output_stream(name) as out:
            out.write(rows.tobytes())
        return pa.table({"part": pa.array([part], pa.int64()), "name": [name]})

    parts = points.withColumn("part", F.expr(f"entity div {rows_per_part}")).groupBy("part").applyInArrow(run, "part bigint, name string").collect()
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {total['n']}", *(f"property {t} {n}" for n, t in kinds.items()), "end_header"]
    with filesystem.open_output_stream(at + ".partial") as out:
        out.write(("\n".join(lines) + "\n").encode("ascii"))
        for r in sorted(parts):
            with filesystem.open_input_stream(r["name"]) as body:
                while piece := body.read(CHUNK):
                    out.write(piece)
            filesystem.delete_file(r["name"])
    filesystem.move(at + ".partial", at)


def append_property(spark: SparkSession, source: str, target: str, values: DataFrame, name: str, kind: str = "int") -> None:
    """A copy of a point cloud with one more property: (entity, value), 0 where there is none."""
    header = read_header(source)
    with_property(header, name, kind)  # refuses a name that exists
    points = read_ply(spark, source).join(values.select("entity", F.col("value").alias(name)), "entity", "left").fillna(0, [name])
    write_ply(points, target, dict(header.properties) | {name: kind})


def choose_output(folder: str, path: str | None, name: str | None, disabled: bool) -> str | None:
    """Where the final cloud goes: an explicit path, or a name in the folder, or nowhere; not two of them."""
    if sum(map(bool, (path, name, disabled))) > 1:
        raise ValueError("give a path, a name, or disable the output")
    return None if disabled or not (path or name) else path or f"{folder.rstrip('/')}/{name}"
