"""Change between the pictures of a run: share of grid cells in which enough pixels change, against the first one."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Grid, change of a pixel (largest of three channels), and share of a cell's pixels.
COLUMNS, ROWS, PIXEL, CELL = 16, 12, 40, 0.08
#: What is not looked at (rows of the task bar, the corner of notifications from these shares of width and
#: height on) and where the icons are (up to these shares).
TASKBAR, TOAST, ICONS = 48, (0.60, 0.66), (0.34, 0.91)
#: Deviation of brightness under which a picture is blank, and share of cells that counts as a change.
BLANK, CHANGED = 6.0, 0.10


def frames(spark: SparkSession, path: str) -> DataFrame:
    """run_id, shot, place, height, width, rgb of the pictures under a folder (.../run/shots/name.png, .jpg or .bmp), as Spark
    reads them; what cannot be read is left out. shot is the name, place its order: numbers first, then other names."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", True).load(path).select("image.*")
    name = F.substring_index("origin", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    run = F.regexp_extract("origin", r"([^/]+)/shots/[^/]+$", 1)
    number = F.when(stem.rlike("^[0-9]+$"), stem).cast("decimal(38,0)")
    channels = {"run_id": "string", "shot": "string", "number": "decimal(38,0)", "height": "int", "width": "int", "rgb": "binary"}

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data in zip(batch.column(6).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(-1, n)  # blue, green, red, and perhaps opacity; or grey
                out.append(np.ascontiguousarray(np.repeat(x, 3, 1) if n == 1 else x[:, 2::-1]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], list(channels))

    plain = found.filter(F.col("origin").rlike(r"(?i)\.(png|jpe?g|bmp)$")).select(run.alias("run_id"), name.alias("shot"), number.alias("number"), "height", "width", "data", "nChannels")
    rows = plain.mapInArrow(run_batches, ", ".join(f"{c} {t}" for c, t in channels.items()))
    return rows.withColumn("place", F.struct(F.col("number").isNull().alias("named"), "number", "shot")).drop("number")


def masked_cells(height: int, width: int, icons: bool) -> np.ndarray:
    """Cells (rows x columns) that are not looked at: the task bar, the corner of notifications, without icons the rest."""
    y, x = np.arange(ROWS)[:, None] * (height // ROWS), np.arange(COLUMNS)[None, :] * (width // COLUMNS)
    out = (y >= height - TASKBAR) | ((x >= int(width * TOAST[0])) & (y >= int(height * TOAST[1])))
    return out | (icons & ((x >= int(width * ICONS[0])) | (y >= int(height * ICONS[1]))))


def changed_cells(first: np.ndarray, later: np.ndarray, mask: np.ndarray | None = None) -> tuple[int, int, int, int]:
    """Cells that changed and cells that count, outside the mask (true: not looked at), and the pixels in these. Cells are
    whole pixels wide, and what is left over at the right and below is in none; a later picture of another size is brought
    to the first one's by nearest pixels."""
    (h, w), (ch, cw) = first.shape[:2], (first.shape[0] // ROWS, first.shape[1] // COLUMNS)
    if not ch or not cw:
        return 0, 0, 0, 0
    if later.shape != first.shape:
        later = later[np.arange(h) * later.shape[0] // h][:, np.arange(w) * later.shape[1] // w]
    hit = np.abs(first.astype(np.int16) - later.astype(np.int16)).max(2) > PIXEL
    counts = hit[: ch * ROWS, : cw * COLUMNS].reshape(ROWS, ch, COLUMNS, cw).sum((1, 3))
    seen = np.ones((ROWS, COLUMNS), bool) if mask is None else ~mask
    return int(((counts / (ch * cw) > CELL) & seen).sum()), int(seen.sum()), int(counts[seen].sum()), int(seen.sum()) * ch * cw


def is_blank(picture: np.ndarray) -> bool:
    return float((picture.reshape(-1, 3) @ np.array([299, 587, 114]) // 1000).std()) < BLANK


def packed(rows: DataFrame) -> DataFrame:
    """`rows` (run_id, shot, h, w, rgb) with their pixels compressed, so that what shuffles and sorts hold of a task's pictures
    is as large as what its partition was sized by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = pa.array([None if x is None else zlib.compress(x, 1) for x in (x.as_py() for x in batch.column(4))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pixels], ["run_id", "shot", "h", "w", "rgb"])

    return rows.select("run_id", "shot", "h", "w", "rgb").mapInArrow(run, "run_id string, shot string, h int, w int, rgb binary")


MEASURED = "run_id string, shot string, i int, cells_changed long, cells_usable long, pixels_changed long, pixels long"


def screen_change(pictures: DataFrame, most: int = 20, icons: bool = True, threshold: float = CHANGED) -> DataFrame:
    """Per run the largest change of its first picture to later ones: run_id, n_shots, cells_changed, cells_usable,
    cell_change_fraction, pixel_change_fraction, visual_change (yes, no, unreadable: nothing could be compared, unknown:
    under two pictures) and peak_shot (of equal changes the first).

    pictures: run_id, shot, height, width, rgb (bytes), and place, their order (shot without it). At most `most` evenly
    spaced later ones count, the last among them, and no blank ones. Places are found without the pictures, and each
    picture, compressed, meets its run's first in a row of its own, so no run's pictures are gathered."""
    rows = pictures.select(F.col("run_id").cast("string").alias("run_id"), F.col("shot").cast("string").alias("shot"), F.col("place" if "place" in pictures.columns else "shot").alias("place"), F.col("height").cast("int").alias("h"), F.col("width").cast("int").alias("w"), "rgb")
    by = Window.partitionBy("run_id")
    places = rows.select("run_id", "shot", "place").withColumn("i", F.row_number().over(by.orderBy("place", "shot")) - 2).withColumn("n", F.count(F.lit(1)).over(by) - 1)
    step = F.greatest(F.col("n"), F.lit(1)) / float(most)
    nth = F.ceil(F.col("i") / step)
    spaced = (F.col("n") <= most) | (F.col("i") == F.col("n") - 1) | ((nth < most - 1) & (F.floor(nth * step) == F.col("i")))
    chosen = places.filter((F.col("i") == -1) | spaced).select("run_id", "shot", "i")
    # A task's work is by far more than its compressed bytes tell, so their number is fixed.
    parts = int(pictures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = packed(rows).join(chosen, ["run_id", "shot"]).repartition(parts, "run_id")
    first = kept.filter("i = -1").select("run_id", F.struct("h", "w", "rgb").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*batch.columns, strict=True):  # one picture at a time
                run_id, shot, i, h, w, rgb, base = (x.as_py() for x in row)
                if rgb is None or base["rgb"] is None:
                    continue
                rgb, whole = zlib.decompress(rgb), zlib.decompress(base["rgb"])
                if h * w * 3 == len(rgb) and base["h"] * base["w"] * 3 == len(whole):
                    a = np.frombuffer(whole, np.uint8).reshape(base["h"], base["w"], 3)
                    b = np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
                    if b.size and not is_blank(b) and (found := changed_cells(a, b, masked_cells(*a.shape[:2], icons)))[1]:
                        out.append((run_id, shot, i, *found))
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in MEASURED.split(", ")])

    each = kept.filter("i >= 0").join(first, "run_id").select("run_id", "shot", "i", "h", "w", "rgb", "first").mapInArrow(run, MEASURED)
    share = F.col("cells_changed") / F.col("cells_usable")
    best = each.groupBy("run_id").agg(F.max_by(F.struct(*each.columns[1:]), F.struct(share, -F.col("i"))).alias("b"))
    cells, pixels = F.col("b.cells_changed") / F.col("b.cells_usable"), F.col("b.pixels_changed") / F.col("b.pixels")
    seen = F.when(F.col("n") < 1, "unknown").when(F.col("b").isNull(), "unreadable").when(cells >= threshold, "yes").otherwise("no")
    return places.filter("i = -1").select("run_id", "n").join(best, "run_id", "left").select(
        "run_id", (F.col("n") + 1).cast("long").alias("n_shots"), "b.cells_changed", "b.cells_usable",
        F.round(cells, 4).alias("cell_change_fraction"), F.round(pixels, 4).alias("pixel_change_fraction"),
        seen.alias("visual_change"), F.col("b.shot").alias("peak_shot"),
    )
