"""Grids in the public volume file format (.vdb, tree 5/4/3), as a Spark data source and a sink.

Reading: one row per active voxel (grid, i, j, k, v, active), tiles as rows with their span. Every file is a partition of its
own; within a file grids are decoded leaf by leaf. Writing: one file per grid id. Values are numbers or vectors of three
(KINDS), the real ones also at half precision, stored raw or with zlib; other codecs, other value types and point data raise.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: magic number, file version, library version, compression flags, per-node mask kinds.
MAGIC = 0x56444220
FILE_VERSION = 224
LIBRARY = (9, 0)
ZIP, ACTIVE_MASK, BLOSC = 1, 2, 4
NO_MASK_OR_INACTIVE_VALS, NO_MASK_AND_MINUS_BG, NO_MASK_AND_ONE_INACTIVE_VAL = 0, 1, 2
MASK_AND_NO_INACTIVE_VALS, MASK_AND_ONE_INACTIVE_VAL, MASK_AND_TWO_INACTIVE_VALS, NO_MASK_AND_ALL_VALS = 3, 4, 5, 6
KINDS = {"float": "<f4", "double": "<f8", "int32": "<i4", "int64": "<i8", "vec3s": "(3,)<f4", "vec3d": "(3,)<f8", "vec3i": "(3,)<i4"}
HALF = "_HalfFloat"
TREE = "Tree_float_5_4_3"
# log2 of a node's side in children, and of its whole side in voxels.
UPPER, LOWER, LEAF = (5, 12), (4, 7), (3, 3)

GRID_SCHEMA = "path string, grid string, type string, background array<double>, matrix array<double>, metadata map<string,string>, leaves long"


def tree_name(kind: str, half: bool = False) -> str:
    return f"Tree_{kind}_5_4_3" + (HALF if half else "")


def value_kind(tree: str) -> str | None:
    """The value type of a tree that can be decoded, else null."""
    return next((k for k in KINDS if tree in (tree_name(k), tree_name(k, True))), None)


def voxel_schema(kind: str) -> str:
    """Numbers come as v, vectors as x, y, z."""
    spark = {"f4": "float", "f8": "double", "i4": "int", "i8": "long"}[KINDS[kind][-2:]]
    values = ", ".join(f"{c} {spark}" for c in (("x", "y", "z") if kind.startswith("vec") else ("v",)))
    return f"path string, grid string, i int, j int, k int, span int, {values}, active boolean"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return out if len(out) > 1 else out[0]

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.raw(self.take("I")).decode("utf-8", "replace")

    def bits(self, log: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.raw((1 << 3 * log) // 8), np.uint8), bitorder="little").astype(bool)

    def value(self, kind: np.dtype) -> np.ndarray:
        return np.frombuffer(self.raw(kind.itemsize), kind)[0]

    def block(self, n: int, flags: int, stored: np.dtype) -> np.ndarray:
        if flags & BLOSC:
            raise ValueError("blosc blocks are not supported")
        if not flags & ZIP:
            return np.frombuffer(self.raw(stored.itemsize * n), stored)
        size = self.take("q")
        data = self.raw(-size) if size <= 0 else zlib.decompress(self.raw(size))
        return np.frombuffer(data, stored, n)

    def values(self, n: int, mask: np.ndarray, flags: int, background: np.ndarray, kind: np.dtype, stored: np.dtype) -> np.ndarray:
        """A node's values: all of them, or the active ones with how the others are to be filled."""
        how = self.take("b")
        off = on = background  # fills for inactive values whose selection bit is off or on
        if how != NO_MASK_OR_INACTIVE_VALS:
            off = -background
        if how in (NO_MASK_AND_ONE_INACTIVE_VAL, MASK_AND_ONE_INACTIVE_VAL, MASK_AND_TWO_INACTIVE_VALS):
            off = self.value(kind)
        if how == MASK_AND_TWO_INACTIVE_VALS:
            on = self.value(kind)
        chosen = np.zeros(n, bool)
        if how in (MASK_AND_NO_INACTIVE_VALS, MASK_AND_ONE_INACTIVE_VAL, MASK_AND_TWO_INACTIVE_VALS):
            chosen = self.bits({512: 3, 4096: 4, 32768: 5}[n])
        out = np.empty(n, kind)
        if not (flags & ACTIVE_MASK and how != NO_MASK_AND_ALL_VALS):
            out[:] = self.block(n, flags, stored)
            return out
        out[:] = off
        out[chosen] = on
        out[mask] = self.block(int(mask.sum()), flags, stored)
        return out


def _stored(kind: str, half: bool) -> np.dtype:
    """How a block holds its values: real ones at half precision where the tree says so."""
    return np.dtype(KINDS[kind].replace("f8", "f2").replace("f4", "f2") if half else KINDS[kind])


def _metadata(r: _Reader) -> dict[str, str]:
    out = {}
    for _ in range(r.take("I")):
        name, kind, size = r.text(), r.text(), r.take("I")
        data = r.raw(size)
        forms = {"bool": "?", "int32": "i", "int64": "q", "float": "f", "double": "d", "vec3i": "3i", "vec3s": "3f", "vec3d": "3d"}
        if kind == "string":
            out[name] = data.decode("utf-8", "replace")
        elif kind in forms and struct.calcsize("<" + forms[kind]) == size:
            out[name] = " ".join(map(str, struct.unpack("<" + forms[kind], data)))
        else:
            out[name] = data.hex()
    return out


def _matrix(r: _Reader) -> list[float]:
    """A transform as a 4 x 4 matrix by columns."""
    kind = r.text()
    shift, scale = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)
    if kind in ("ScaleTranslateMap", "UniformScaleTranslateMap", "TranslationMap"):
        shift = r.take("3d")
    if kind in ("ScaleMap", "UniformScaleMap", "ScaleTranslateMap", "UniformScaleTranslateMap"):
        scale = r.take("3d")
        r.raw(4 * 24)  # voxel size and three reciprocals that follow from the scale
    elif kind in ("AffineMap", "UnitaryMap"):
        return list(r.take("16d"))
    elif kind != "TranslationMap":
        raise ValueError(f"transform {kind} is not supported")
    return [scale[0], 0, 0, 0, 0, scale[1], 0, 0, 0, 0, scale[2], 0, *shift, 1.0]


def _offsets(log: int, child: int, bits: np.ndarray) -> np.ndarray:
    n = np.flatnonzero(bits)
    side = (1 << log) - 1
    return np.stack([n >> 2 * log, n >> log & side, n & side], 1) << child


def read_grids(data: bytes, voxels: bool = True) -> Iterator[dict]:
    """name, type, background, matrix, metadata and, if asked for, leaves [(origin, values, mask)] and tiles [(origin, span, v, active)]."""
    r = _Reader(data)
    if r.take("q") != MAGIC:
        raise ValueError("not a volume file")
    version = r.take("I")
    if version < 222:
        raise ValueError(f"file version {version} is not supported")
    r.take("2I")
    offsets = r.take("b")
    r.raw(36)
    _metadata(r)
    for _ in range(r.take("I")):
        name, kind, _parent = r.text(), r.text(), r.text()
        start, _blocks, end = r.take("3q")
        if offsets:
            r.at = start
        flags = r.take("I")
        metadata, matrix = _metadata(r), _matrix(r)
        out = {"name": name.split("\x1e")[0], "type": kind, "matrix": matrix, "metadata": metadata, "background": None, "leaves": [], "tiles": []}
        known = value_kind(kind)
        if known:
            r.take("i")
            number, stored = np.dtype(KINDS[known]), _stored(known, kind.endswith(HALF))
            out["background"] = background = r.value(number)
            tiles, children = r.take("2I")
            for _ in range(tiles):
                at, v, active = r.take("3i"), r.value(number), r.take("b")
                out["tiles"].append((at, 4096, v, bool(active)))
            masks = []
            if voxels:
                for _ in range(children):
                    origin = np.array(r.take("3i"))
                    _topology(r, origin, UPPER, flags, background, number, stored, out["tiles"], masks)
                for origin, _ in masks:
                    mask = r.bits(3)
                    out["leaves"].append((origin, r.values(512, mask, flags, background, number, stored), mask))
        elif voxels:
            raise ValueError(f"grid type {kind} is not supported")
        yield out
        if offsets:
            r.at = end


def _topology(r: _Reader, origin: np.ndarray, level, flags, background, number, stored, tiles, leaves) -> None:
    log, span = level
    child, value = r.bits(log), r.bits(log)
    below = LOWER if level == UPPER else LEAF
    values = r.values(1 << 3 * log, value, flags, background, number, stored)
    differs = (values != background).reshape(len(values), -1).any(axis=1)
    open_ = ~child & (value | differs)
    for o, v, on in zip(_offsets(log, below[1], open_), values[open_], value[open_], strict=True):
        tiles.append((tuple(int(x) for x in origin + o), 1 << below[1], v, bool(on)))
    for o in _offsets(log, below[1], child):
        if below == LEAF:
            leaves.append((origin + o, r.bits(3)))
        else:
            _topology(r, origin + o, LOWER, flags, background, number, stored, tiles, leaves)


def _rows(where: str, grid: dict, inactive: bool) -> Iterator[pd.DataFrame]:
    def frame(i, j, k, span, values, active):
        values = np.asarray(values)
        columns = {"v": values} if values.ndim == 1 else {c: values[:, n] for n, c in enumerate("xyz")}
        out = pd.DataFrame({"path": where, "grid": grid["name"], "i": i, "j": j, "k": k, "span": span, **columns, "active": active})
        return out.astype({"i": "int32", "j": "int32", "k": "int32", "span": "int32"})

    for origin, values, mask in grid["leaves"]:
        at = np.flatnonzero(mask | inactive)
        yield frame(origin[0] + (at >> 6), origin[1] + (at >> 3 & 7), origin[2] + (at & 7), 1, values[at], mask[at])
    kept = [t for t in grid["tiles"] if t[3] or inactive]
    if kept:
        at = np.array([t[0] for t in kept])
        yield frame(*at.T, [t[1] for t in kept], np.stack([t[2] for t in kept]), [t[3] for t in kept])


def read_vdb(spark, path: str, inactive: bool = False, kind: str | None = None) -> DataFrame:
    """Voxels and tiles of all files under path. span is 1 for voxels; inactive stored values come only if asked for.

    kind: the value type (KINDS) whose grids are read, with columns of that type; grids of the others are left to other calls.
    Without it all grids must be float ones, else it raises, so that none is missed unseen.
    """

    def decode(batches):
        for b in batches:
            for where, data in zip(b["path"], b["content"], strict=True):
                for g in read_grids(data):
                    held = value_kind(g["type"])
                    if kind is None and held != "float":
                        raise ValueError(f"grid {g['name']} is a {g['type']}; ask for its kind")
                    if held == (kind or "float"):
                        yield from _rows(where, g, inactive)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vdb").load(path)
    return files.select("path", "content").mapInPandas(decode, voxel_schema(kind or "float"))


def read_vdb_grids(spark, path: str) -> DataFrame:
    """The grids of all files under path; no voxel is decoded."""

    def decode(batches):
        for b in batches:
            rows = []
            for where, data in zip(b["path"], b["content"], strict=True):
                for g in read_grids(data, voxels=False):
                    rows.append((where, g["name"], g["type"], None if g["background"] is None else np.atleast_1d(g["background"]).astype(float).tolist(), g["matrix"], g["metadata"], None))
            yield pd.DataFrame(rows, columns=["path", "grid", "type", "background", "matrix", "metadata", "leaves"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vdb").load(path)
    return files.select("path", "content").mapInPandas(decode, GRID_SCHEMA).drop("leaves")


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<I", len(raw)) + raw


def _packed(values: np.ndarray, zipped: bool) -> bytes:
    raw = values.tobytes()
    if not zipped:
        return raw
    small = zlib.compress(raw)
    return struct.pack("<q", len(small)) + small if len(small) < len(raw) else struct.pack("<q", -len(raw)) + raw


def _entry(value) -> tuple[str, bytes]:
    """Type and bytes of a metadata value, by its Python type: text, truth, whole number, number or three of them."""
    if isinstance(value, str):
        return "string", value.encode()
    if isinstance(value, bool):
        return "bool", struct.pack("<?", value)
    if isinstance(value, int):
        return ("int32", struct.pack("<i", value)) if -(1 << 31) <= value < 1 << 31 else ("int64", struct.pack("<q", value))
    if isinstance(value, float):
        return "double", struct.pack("<d", value)
    if all(isinstance(x, int) for x in value):
        return "vec3i", struct.pack("<3i", *value)
    return "vec3d", struct.pack("<3d", *value)


def _mask_bytes(bits: np.ndarray) -> bytes:
    return np.packbits(bits, bitorder="little").tobytes()


def _slots(rest: np.ndarray, log: int) -> np.ndarray:
    return (rest[:, 0] << 2 * log) + (rest[:, 1] << log) + rest[:, 2]


def write_grid(name: str, ijk: np.ndarray, values: np.ndarray, background=0.0, size: float = 1.0, zipped: bool = True, kind: str = "float", half: bool = False, metadata: dict | None = None) -> bytes:
    """A file with one grid of active voxels; of repeated coordinates the first wins.

    kind: of the values, which are rows of three for vectors; half stores real values at half precision. metadata adds to
    or replaces class and name.
    """
    ijk = np.asarray(ijk, np.int64).reshape(-1, 3)
    ijk, first = np.unique(ijk, axis=0, return_index=True)
    number, stored = np.dtype(KINDS[kind]), _stored(kind, half)
    values = np.asarray(values, number.base)[first]
    empty = np.zeros((), number.base) + np.broadcast_to(np.asarray(background, number.base), number.shape)
    flags = ZIP if zipped else 0
    tree, buffers = [struct.pack("<i", 1) + empty.tobytes()], []
    full = lambda n: np.broadcast_to(empty, (n, *number.shape)).copy()
    pack = lambda x: _packed(x.astype(stored.base), zipped)
    roots = np.unique(ijk >> 12, axis=0)
    tree.append(struct.pack("<2I", 0, len(roots)))

    def node(log: int, below: int, rows: np.ndarray, origin: np.ndarray) -> None:
        child = np.zeros(1 << 3 * log, bool)
        slot = _slots((ijk[rows] - origin) >> below, log)
        used = np.unique(slot)
        child[used] = True
        tree.append(_mask_bytes(child) + _mask_bytes(np.zeros_like(child)))
        tree.append(struct.pack("<b", NO_MASK_AND_ALL_VALS) + pack(full(len(child))))
        side = (1 << log) - 1
        order = np.argsort(slot, kind="stable")
        cuts = np.searchsorted(slot[order], used)
        for n, part in zip(used.tolist(), np.split(rows[order], cuts[1:]), strict=True):
            at = origin + (np.array([n >> 2 * log, n >> log & side, n & side]) << below)
            if below == 3:
                mask, leaf = np.zeros(512, bool), full(512)
                own = _slots(ijk[part] - at, 3)
                mask[own], leaf[own] = True, values[part]
                tree.append(_mask_bytes(mask))
                buffers.append(_mask_bytes(mask) + struct.pack("<b", NO_MASK_AND_ALL_VALS) + pack(leaf))
            else:
                node(4, 3, part, at)

    where = ijk >> 12
    for root in roots:
        origin = root << 12
        tree.append(struct.pack("<3i", *map(int, origin)))
        node(5, 7, np.flatnonzero((where == root).all(axis=1)), origin)
    meta = [(n, *_entry(v)) for n, v in ({"class": "unknown", "name": name} | ({"is_saved_as_half_float": True} if half else {}) | (metadata or {})).items()]
    body = struct.pack("<I", flags) + struct.pack("<I", len(meta)) + b"".join(_text(n) + _text(t) + struct.pack("<I", len(v)) + v for n, t, v in meta)
    scale = struct.pack("<15d", *[size] * 3, *[size] * 3, *[1 / size] * 3, *[1 / size**2] * 3, *[0.5 / size] * 3)
    body += _text("UniformScaleMap") + scale
    topology = b"".join(tree)
    head = struct.pack("<qIIIb", MAGIC, FILE_VERSION, *LIBRARY, 1) + str(uuid.uuid5(uuid.NAMESPACE_OID, name)).encode()
    head += struct.pack("<II", 0, 1) + _text(name) + _text(tree_name(kind, half)) + _text("")
    start = len(head) + 24
    blocks = start + len(body) + len(topology)
    data = b"".join(buffers)
    return head + struct.pack("<3q", start, blocks, blocks + len(data)) + body + topology + data


def vdb_files(voxels: DataFrame, background=0.0, size: float = 1.0, kind: str = "float", half: bool = False, metadata: dict | None = None) -> DataFrame:
    """grid, content: one file per grid (a file is one task's by its format). voxels: grid, i, j, k and v, or x, y, z for vectors."""
    columns = ["x", "y", "z"] if kind.startswith("vec") else ["v"]
    number = {"f4": "float", "f8": "double", "i4": "int", "i8": "long"}[KINDS[kind][-2:]]

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows[columns].to_numpy()
        content = write_grid(str(key[0]), rows[["i", "j", "k"]].to_numpy(), values if len(columns) == 3 else values[:, 0], background, size, kind=kind, half=half, metadata=metadata)
        return pd.DataFrame([{"grid": str(key[0]), "content": content}])

    kept = voxels.select(F.col("grid").cast("string").alias("grid"), "i", "j", "k", *(F.col(c).cast(number).alias(c) for c in columns))
    return kept.groupBy("grid").applyInPandas(build, "grid string, content binary")
