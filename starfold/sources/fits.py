"""FITS images: header cards of a gnomonic grid, and a data source that writes one file for each image.

    df.repartition("image").sortWithinPartitions("image", "y", "x").write.format("fits_image").options(ny=..., nx=...).save(path)

``write_images`` does this. A task writes its images under temporary names; they get their names when all tasks are done, and
are removed if the job fails. Paths go through pyarrow's file systems, so shared folders and object stores do.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shared import ship

BLOCK, CARD = 2880, 80


@dataclass(frozen=True)
class Grid:
    """A gnomonic grid: tangent point in degrees, arcseconds a pixel, size, and the tangent point's row and column."""

    ra: float
    dec: float
    scale: float
    ny: int
    nx: int
    row: float
    col: float


def wcs_cards(g: Grid) -> list[tuple[str, str | int | float, str]]:
    """Keyword, value and comment of the thirteen cards of a grid: axis 1 is the column, axis 2 the row, north up and east left."""
    step = g.scale / 3600
    return [
        ("WCSAXES", 2, "number of world coordinate axes"),
        ("CTYPE1", "RA---TAN", "gnomonic projection"), ("CTYPE2", "DEC--TAN", "gnomonic projection"),
        ("CRVAL1", g.ra, "[deg] tangent point"), ("CRVAL2", g.dec, "[deg] tangent point"),
        ("CRPIX1", g.col, "column of the tangent point"), ("CRPIX2", g.row, "row of the tangent point"),
        ("CD1_1", -step, "[deg] a column goes west"), ("CD1_2", 0.0, "[deg]"), ("CD2_1", 0.0, "[deg]"), ("CD2_2", step, "[deg] a row goes north"),
        ("CUNIT1", "deg", "unit of axis 1"), ("CUNIT2", "deg", "unit of axis 2"),
    ]


def card(key: str, value: str | int | float | bool, comment: str = "") -> bytes:
    """One card in fixed format, 80 bytes."""
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, str):
        text = "'" + value.replace("'", "''").ljust(8) + "'"
    elif isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{key} must be finite, got {value}")
    else:
        text = f"{repr(value).upper():>20}"
    line = f"{key:<8}= {text}" + (f" / {comment}" if comment else "")
    if len(key) > 8 or (isinstance(value, str) and len(text) > 70):
        raise ValueError(f"no room for {key} = {value!r} in one card")
    return line[:CARD].ljust(CARD).encode("ascii")


def header(ny: int, nx: int, cards: list[tuple[str, str | int | float, str]]) -> bytes:
    """Header blocks of a primary image of 64-bit floats."""
    fixed = [("SIMPLE", True, "standard FITS"), ("BITPIX", -64, "64-bit floats"), ("NAXIS", 2, ""), ("NAXIS1", nx, "columns"), ("NAXIS2", ny, "rows")]
    raw = b"".join(card(*c) for c in [*fixed, *cards]) + b"END".ljust(CARD)
    return raw + b" " * (-len(raw) % BLOCK)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class FitsWriter(DataSourceArrowWriter):
    """Rows ``image, y, x, v`` sorted by image, row and column; an image's pixels that are absent are NaN."""

    def __init__(self, options: dict[str, str]):
        self.path, self.ny, self.nx = options["path"].rstrip("/"), int(options["ny"]), int(options["nx"])
        self.cards = [tuple(c) for c in json.loads(options.get("cards", "[]"))]
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names: list[tuple[str, str]] = []
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        out, image, line, row = None, None, 0, np.full(self.nx, np.nan)

        def close() -> None:
            nonlocal out
            if out is None:
                return
            flush(self.ny + 1)
            out.write(b"\0" * (-self.ny * self.nx * 8 % BLOCK))
            out.close()
            out = None

        def flush(until: int) -> None:
            nonlocal line
            while line < until - 1:  # rows before ``until``, from 1; those without pixels are all NaN
                out.write(row.astype(">f8").tobytes())
                row[:] = np.nan
                line += 1

        for batch in iterator:
            pixels = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("image", "y", "x", "v"))
            for i, y, x, v in zip(*pixels):
                if out is None or i != image:
                    close()
                    image, line, row[:] = i, 0, np.nan
                    temporary = f"{root}/.{i}-{self.run}-{uuid.uuid4().hex}"
                    names.append((temporary, f"{root}/{i}.fits"))
                    out = store.open_output_stream(temporary)
                    out.write(header(self.ny, self.nx, self.cards))
                if not (1 <= y <= self.ny and 1 <= x <= self.nx):
                    raise ValueError(f"pixel ({y}, {x}) of image {i} is not on a grid of {self.ny} x {self.nx}")
                if y < line + 1:
                    raise ValueError("pixels must be sorted by image and row")
                flush(int(y))
                row[int(x) - 1] = v
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = _open(self.path)
        names = [pair for m in messages if m for pair in m.names]
        if len({final for _, final in names}) != len(names):
            self.abort(messages)
            raise ValueError("the pixels of an image are in several tasks: repartition by image")
        for temporary, final in names:
            store.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what this run has written, whether its task got to its end or not."""
        store, root = _open(self.path)
        for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f"-{self.run}-" in found.base_name:
                store.delete_file(found.path)


class FitsImages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits_image"

    def schema(self) -> str:
        return "image long, y long, x long, v double"

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options)


def write_images(pixels: DataFrame, path: str, grid: Grid, extra: list[tuple[str, str | int | float, str]] | None = None) -> None:
    """``image, y, x, v`` as ``<path>/<image>.fits`` with the grid's cards."""
    spark = pixels.sparkSession
    ship(spark)
    spark.dataSource.register(FitsImages)
    rows = pixels.selectExpr("CAST(image AS LONG) image", "CAST(y AS LONG) y", "CAST(x AS LONG) x", "CAST(v AS DOUBLE) v")
    out = rows.repartition("image").sortWithinPartitions("image", "y", "x").write.format("fits_image").mode("append")
    out.options(ny=grid.ny, nx=grid.nx, cards=json.dumps([*wcs_cards(grid), *(extra or [])])).save(path)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """``path, key, value`` of all cards of the files' first headers."""
    ship(spark)

    def cards(batches):
        import pandas as pd

        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = []
                for at in range(0, len(content), CARD):
                    line = content[at : at + CARD].decode("ascii")
                    if line[:8].strip() == "END":
                        break
                    if line[8:10] == "= ":
                        body = line[10:]
                        value = body[1 : body.index("'", 1)].rstrip() if body.startswith("'") else body.split("/")[0].strip()
                        rows.append((name, line[:8].strip(), value))
                yield pd.DataFrame(rows, columns=["path", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cards, "path string, key string, value string")
