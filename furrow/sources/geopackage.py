"""A Python data source that reads feature tables of GeoPackage files.

    spark.dataSource.register(GeoPackageSource)
    spark.read.format("gpkg").option("path", p).option("layer", "fields").load()

A GeoPackage is one SQLite file; the reader splits a layer by ranges of its row ids, so tasks read parts of it. The file
must be readable by the executors under the given path.
"""

from __future__ import annotations

import sqlite3
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Fixed values of the GeoPackage binary header: bytes of each kind of envelope.
_ENVELOPE = (0, 32, 48, 48, 64)
_KINDS = {"INTEGER": LongType(), "INT": LongType(), "MEDIUMINT": LongType(), "BOOLEAN": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(), "FLOAT": DoubleType(), "BLOB": BinaryType()}


def wkb_of(blob: bytes | None) -> bytes | None:
    """The WKB behind a GeoPackage geometry header; null for null or empty geometry."""
    if blob is None or len(blob) < 8 or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return bytes(blob[8 + _ENVELOPE[(blob[3] >> 1) & 7] :])


def blob_of(wkb: bytes | None, srs_id: int) -> bytes | None:
    """A GeoPackage geometry without an envelope."""
    return None if wkb is None else b"GP\x00\x01" + struct.pack("<i", srs_id) + wkb


def ring_wkb(points: list[tuple[float, float]]) -> bytes:
    """A polygon of one ring."""
    closed = points if points[0] == points[-1] else [*points, points[0]]
    return struct.pack("<BIII", 1, 3, 1, len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed)


def ring_of(wkb: bytes) -> list[tuple[float, float]]:
    """The outer ring of a little-endian polygon."""
    order, kind, rings, n = struct.unpack_from("<BIII", wkb)
    if order != 1 or kind != 3 or rings < 1:
        raise ValueError("not a little-endian polygon")
    return [struct.unpack_from("<dd", wkb, 13 + 16 * k) for k in range(n)]


def points_of(wkb: bytes | None) -> list[tuple[int, int, int, float, float]]:
    """(part, ring, i, x, y) of a little-endian polygon or multipolygon with holes; closing points are left out."""
    out: list[tuple[int, int, int, float, float]] = []

    def polygon(at: int, part: int) -> int:
        order, kind, rings = struct.unpack_from("<BII", wkb, at)
        if order != 1 or kind != 3:
            raise ValueError("not a little-endian polygon")
        at += 9
        for ring in range(rings):
            (n,) = struct.unpack_from("<I", wkb, at)
            flat = struct.unpack_from(f"<{2 * n}d", wkb, at + 4)
            points = list(zip(flat[::2], flat[1::2], strict=True))
            points = points[:-1] if n > 1 and points[0] == points[-1] else points
            out.extend((part, ring, i, x, y) for i, (x, y) in enumerate(points))
            at += 4 + 16 * n
        return at

    if wkb:
        order, kind, n = struct.unpack_from("<BII", wkb)
        at = 9
        if order == 1 and kind == 6:
            for part in range(n):
                at = polygon(at, part)
        else:
            polygon(0, 0)
    return out


def layer_vertices(df: DataFrame, id_col: str, geom_col: str = "geom") -> DataFrame:
    """(id, part, ring, i, x, y) of the polygons of a layer, holes and all parts; null geometries have none."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [points_of(g) for g in batch.column(1).to_pylist()]
            owner = pa.array([k for k, p in enumerate(found) for _ in p], pa.int64())
            columns = zip(*(p for ps in found for p in ps), strict=True) if any(found) else [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["id", "part", "ring", "i", "x", "y"])

    return df.select(F.col(id_col).alias("id"), F.col(geom_col).alias("geom")).mapInArrow(run, f"id {kind}, part int, ring int, i int, x double, y double").withColumnRenamed("id", id_col)


def write_layer(path: str, layer: str, rows: list[tuple], columns: dict[str, str], srs_id: int = 4326) -> None:
    """Writes a small layer (for exchange and tests): rows of (wkb, *values)."""
    db = sqlite3.connect(path)
    with db:
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, srs_id INT)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?)", (layer, srs_id))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?)", (layer, srs_id))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, geom BLOB, {", ".join(f"{c} {t}" for c, t in columns.items())})')
        db.executemany(f'INSERT INTO "{layer}" (geom, {", ".join(columns)}) VALUES ({", ".join("?" * (1 + len(columns)))})', [(blob_of(r[0], srs_id), *r[1:]) for r in rows])
    db.close()


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _layer(self, db: sqlite3.Connection) -> str:
        layers = [r[0] for r in db.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]
        wanted = self.options.get("layer") or (layers[0] if len(layers) == 1 else None)
        if wanted not in layers:
            raise ValueError(f"layer must be one of {layers}")
        return wanted

    def schema(self) -> StructType:
        db = _open(self.options["path"])
        info = db.execute(f'PRAGMA table_info("{self._layer(db)}")').fetchall()
        db.close()
        return StructType([StructField(c[1], BinaryType() if c[1] == "geom" else _KINDS.get(c[2].upper(), StringType())) for c in info])

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(self.options, schema, self._layer(_open(self.options["path"])))


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType, layer: str):
        self.path, self.columns, self.layer, self.rows = options["path"], schema.names, layer, int(options.get("rowsPerPartition", "10000"))

    def partitions(self) -> list[_Range]:
        lo, hi = _open(self.path).execute(f'SELECT coalesce(min(fid), 0), coalesce(max(fid), -1) FROM "{self.layer}"').fetchone()
        return [_Range(k, min(k + self.rows - 1, hi)) for k in range(lo, hi + 1, self.rows)] or [_Range(0, -1)]

    def read(self, part: _Range):
        db = _open(self.path)
        names = ", ".join(f'"{c}"' for c in self.columns)
        place = self.columns.index("geom") if "geom" in self.columns else None
        for row in db.execute(f'SELECT {names} FROM "{self.layer}" WHERE fid BETWEEN ? AND ? ORDER BY fid', (part.lo, part.hi)):
            yield row if place is None else (*row[:place], wkb_of(row[place]), *row[place + 1 :])
        db.close()
