"""Binary frames: raw counts with sidecars, PNG, palettes, packets, calibrations."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe import schema as layouts
from emberframe.functions.numbers import all_reasons, first_reason, is_finite
from emberframe.operators.ordered import Series, neighbours

_PIXELS = T.ArrayType(T.IntegerType())


@F.pandas_udf(_PIXELS)
def u16_little(payload: pd.Series) -> pd.Series:
    """Bytes to unsigned 16-bit little-endian counts."""
    return pd.Series([np.frombuffer(p, dtype="<u2").astype(np.int32) for p in payload])


def raw_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Raw frames joined to their JSON sidecars by capture folder and file name.

    ``folder`` may be a pattern of many capture folders; ``capture`` names each frame's own. A frame whose size does
    not match its sidecar keeps a reason and no pixels.
    """
    capture = lambda path: F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("capture")
    inside = lambda path: F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("_folder")
    read = spark.read.schema(layouts.RAW_SIDECAR).option("multiLine", True).json(f"{folder}/raw_frame_*.json")
    sides = read.select("*", capture("_metadata.file_path"), inside("_metadata.file_path"))
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.bin")
        .load(folder)
        .select(inside("_metadata.file_path"), F.regexp_extract("path", r"([^/]+)$", 1).alias("raw_file"), "content", "length")
    )
    joined = sides.join(files, ["_folder", "raw_file"], "left")
    issue = first_reason(
        (F.col("content").isNull(), "raw_file_missing"),
        (F.col("raw_file").contains("/"), "raw_file_not_plain"),
        ((F.col("dtype") != "uint16") | (F.col("byte_order") != "little"), "not_uint16_little"),
        (F.col("length") != F.col("width") * F.col("height") * 2, "size_mismatch"),
    )
    checked = joined.withColumn("issue", issue)
    usable = F.when(F.col("issue").isNull(), F.col("content")).otherwise(F.lit(b""))
    mapping = F.col("display_mapping")
    fixed = mapping["mode"] == "fixed_raw_counts"
    return checked.select(
        F.col("frame_index").alias("frame"), F.col("monotonic_timestamp_ns").alias("ts_ns"),
        "width", "height", u16_little(usable).alias("pixels"), "ffc_state",
        F.coalesce("repeated_frame_flag", F.lit(False)).alias("repeated"),
        "raw_min", "raw_median", "raw_max", mapping["mode"].alias("display_mode"),
        F.when(fixed, mapping["raw_low"]).alias("raw_low"), F.when(fixed, mapping["raw_high"]).alias("raw_high"),
        "issue", "capture",
    )


def png_pixels(payload: bytes) -> tuple[int, int, int, int, np.ndarray]:
    """Width, height, bit depth, channels and values of a non-interlaced PNG."""
    at, data, head = 8, b"", None
    while at < len(payload):
        size, kind = struct.unpack(">I4s", payload[at : at + 8])
        body = payload[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if channels is None or depth not in (8, 16) or interlaced:
        raise ValueError("unsupported PNG layout")
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 1 + width * step)
    above = np.zeros(width * step, dtype=np.int64)
    image = np.empty((height, width * step), dtype=np.uint8)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 1:
            line = line.reshape(-1, step).cumsum(axis=0).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for i in range(len(line)):
                left = line[i - step] if i >= step else 0
                corner = above[i - step] if i >= step else 0
                if kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    guess = min(
                        (abs(above[i] - corner), 0, left), (abs(left - corner), 1, above[i]),
                        (abs(left + above[i] - 2 * corner), 2, corner),
                    )[2]
                line[i] = (line[i] + guess) & 255
        above = line & 255
        image[y] = above
    values = image.view(">u2") if depth == 16 else image
    return width, height, depth, channels, values.astype(np.int32).ravel()


_PNG = T.StructType(
    [
        T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
        T.StructField("depth", T.IntegerType()), T.StructField("channels", T.IntegerType()),
        T.StructField("pixels", _PIXELS), T.StructField("issue", T.StringType()),
    ]
)


@F.pandas_udf(_PNG)
def decode_png(payload: pd.Series) -> pd.DataFrame:
    """PNG bytes to pixels; 16-bit frames keep all bits. A broken file keeps its reason."""
    rows = []
    for p in payload:
        try:
            rows.append((*png_pixels(p), None))
        except (ValueError, TypeError, struct.error, zlib.error) as exc:
            rows.append((None, None, None, None, None, f"unreadable: {exc}"))
    return pd.DataFrame(rows, columns=[f.name for f in _PNG.fields])


def png_frames(spark: SparkSession, pattern: str, *, thermal: bool = False) -> DataFrame:
    """PNG files as frames; ``thermal`` insists on 160x120 16-bit gray."""
    files = spark.read.format("binaryFile").load(pattern)
    decoded = files.select("path", decode_png("content").alias("_i")).select("path", "_i.*")
    wrong = (F.col("width") != 160) | (F.col("height") != 120) | (F.col("depth") != 16) | (F.col("channels") != 1)
    issue = F.coalesce("issue", F.when(F.lit(thermal) & wrong, "not_a_thermal_frame"))
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).try_cast("int")
    return decoded.withColumns({"issue": issue, "frame": number})


def gray_pixels(pixels: Column, channels: Column) -> Column:
    """Gray values of interleaved red, green, blue pixels; gray frames as they are."""
    from emberframe.functions.arrays import gray

    count = F.floor(F.size(pixels) / 3).cast("int")
    mixed = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: gray(F.get(pixels, i * 3 + 2), F.get(pixels, i * 3 + 1), F.get(pixels, i * 3)),
    )
    return F.when(channels == 3, mixed).otherwise(pixels)


def palette_entries(files: DataFrame, *, exact: int | None = None) -> DataFrame:
    """Palette bytes to (path, idx, r, g, b); a wrong size gives no rows."""
    size = F.octet_length("content")
    fits = (size % 3 == 0) & (size > 0)
    if exact is not None:
        fits = fits & (size == exact * 3)
    byte = lambda p: F.conv(F.hex(F.substring("content", p, 1)), 16, 10).cast("int")
    each = files.filter(fits).select(
        "path", "content", F.explode(F.sequence(F.lit(0), (size / 3).cast("int") - 1)).alias("idx")
    )
    at = F.col("idx") * 3
    return each.select("path", "idx", byte(at + 1).alias("r"), byte(at + 2).alias("g"), byte(at + 3).alias("b"))


# --- packets -----------------------------------------------------------------
# Fixed values of the packet layout.
PACKET_BYTES, HEADER_BYTES = 164, 4
PLAIN_PACKETS, FOOTER_PACKETS = 60, 61
FFC_STATES = ("never_commanded", "imminent", "in_progress", "complete")
RESOLUTIONS = {0: 0.1, 1: 0.01}
SEGMENT_PIXELS = 61 * 80
LAST_SEGMENT_PIXELS = 57 * 80


def datagrams(rows: DataFrame) -> DataFrame:
    """Segment number and packet count of each datagram; null when it is malformed.

    The packet numbers inside must count up from zero.
    """
    size = F.octet_length("payload")
    packets = F.when(size.isin(PLAIN_PACKETS * PACKET_BYTES, FOOTER_PACKETS * PACKET_BYTES), (size / PACKET_BYTES).cast("int"))
    byte = lambda at: F.conv(F.hex(F.substring("payload", at + 1, 1)), 16, 10).cast("int")
    counted = F.forall(
        F.sequence(F.lit(0), packets - 1),
        lambda i: (byte(i * PACKET_BYTES) % 16) * 256 + byte(i * PACKET_BYTES + 1) == i,
    )
    segment = F.floor(byte(F.lit(20 * PACKET_BYTES)) / 16).cast("int")
    good = packets.isNotNull() & counted & segment.between(1, 4)
    return rows.withColumns(
        {"packets": F.when(good, packets), "segment": F.when(good, segment)}
    )


def assembled_frames(rows: DataFrame, series: Series, *, rows_per_chunk: int | None = None) -> DataFrame:
    """Frames from four datagrams in a row numbered 1, 2, 3, 4 in one packet mode.

    Needs segment, packets and payload; anything else between them breaks the frame.
    """

    def build(window):
        before = {}
        for back in (1, 2, 3):
            before[f"_s{back}"] = F.lag("segment", back).over(window)
            before[f"_p{back}"] = F.lag("packets", back).over(window)
            before[f"_b{back}"] = F.lag("payload", back).over(window)
        return before

    near = neighbours(rows, series, 3, build, rows_per_chunk=rows_per_chunk)
    whole = F.col("segment") == 4
    for back in (1, 2, 3):
        whole = whole & (F.col(f"_s{back}") == 4 - back) & (F.col(f"_p{back}") == F.col("packets"))
    return near.filter(whole).select(
        *series.keys, *series.order, "packets", F.concat("_b3", "_b2", "_b1", "payload").alias("payload")
    )


def _packet_words(payload: bytes) -> np.ndarray:
    packets = np.frombuffer(payload, dtype=np.uint8).reshape(-1, PACKET_BYTES)
    return packets[:, HEADER_BYTES:].copy().view(">u2").astype(np.int64)


@F.pandas_udf(_PIXELS)
def packet_pixels(payload: pd.Series) -> pd.Series:
    """160x120 counts of an assembled frame; packets alternate left and right half rows."""

    def one(p: bytes) -> np.ndarray:
        words = _packet_words(p)[:240]
        return np.hstack([words[0::2], words[1::2]]).ravel().astype(np.int32)

    return pd.Series([one(p) for p in payload])


_FOOTER = T.StructType(
    [
        T.StructField("frame_counter", T.LongType()), T.StructField("packet_timestamp_ms", T.LongType()),
        T.StructField("ffc_desired", T.BooleanType()), T.StructField("ffc_state", T.StringType()),
        T.StructField("ffc_in_progress", T.BooleanType()), T.StructField("since_last_ffc_s", T.DoubleType()),
        T.StructField("tlinear_enabled", T.BooleanType()), T.StructField("tlinear_resolution_k", T.DoubleType()),
    ]
)


@F.pandas_udf(_FOOTER)
def packet_telemetry(payload: pd.Series) -> pd.DataFrame:
    """Device telemetry from the footer rows; all null without a footer."""

    def one(p: bytes) -> tuple:
        if len(p) != 4 * FOOTER_PACKETS * PACKET_BYTES:
            return (None,) * 8
        footer = _packet_words(p)[240:]
        wide = lambda at: int(footer[0][at]) + (int(footer[0][at + 1]) << 16)
        status, ms, shutter_ms = wide(3), wide(1), wide(30)
        state = (status >> 4) & 3
        return (
            wide(20), ms, bool((status >> 3) & 1), FFC_STATES[state], state in (1, 2),
            ((ms - shutter_ms) % 2**32) / 1000.0, int(footer[2][48]) == 1, RESOLUTIONS.get(int(footer[2][49])),
        )

    return pd.DataFrame([one(p) for p in payload], columns=[f.name for f in _FOOTER.fields])


#: Frames that a task decodes and hands on at a time, 5 MB of pixels.
_AT_A_TIME = 64


def _grids(decode):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for payload in batches:
            for at in range(0, len(payload), _AT_A_TIME):
                yield pd.Series([decode(p).ravel().astype(np.int32) for p in payload.iloc[at : at + _AT_A_TIME]])

    return F.pandas_udf(run, _PIXELS)


def _split_rows(payload: bytes) -> np.ndarray:
    words = np.frombuffer(payload[: 2 * 164 * 120], dtype="<u2").reshape(120, 164)
    return np.hstack([words[:, 2:82], words[:, 84:164]])


def _doubled_rows(payload: bytes) -> np.ndarray:
    words = np.frombuffer(payload[: 164 * 60], dtype=np.uint8).reshape(60, 164)[:, 4:].copy().view(">u2")
    return words.repeat(2, axis=0).repeat(2, axis=1)


def decode_split_payload(payload: Column) -> Column:
    """160x120 little-endian rows in two halves with a gap between them."""
    return _grids(_split_rows)(payload)


def decode_doubled_payload(payload: Column) -> Column:
    """80x60 big-endian rows, every pixel doubled both ways to 160x120."""
    return _grids(_doubled_rows)(payload)


def renderable_ranges(pixels: Column) -> Column:
    """Per segment the pixel range up to the first zero."""
    sizes = [SEGMENT_PIXELS] * 3 + [LAST_SEGMENT_PIXELS]
    starts = [sum(sizes[:i]) for i in range(4)]

    def one(i: int) -> Column:
        zero = F.array_position(F.slice(pixels, starts[i] + 1, sizes[i]), F.lit(0)).cast("int")
        end = F.when(zero > 0, F.lit(starts[i]) + zero - 1).otherwise(F.lit(starts[i] + sizes[i]))
        return F.struct(F.lit(i + 1).alias("segment"), F.lit(starts[i]).alias("begin"), end.alias("end"))

    return F.array(*[one(i) for i in range(4)])


# --- calibration files ----------------------------------------------------------

def load_calibration(spark: SparkSession, path: str, **gates) -> DataFrame:
    """Stored projection calibration with its failed checks."""
    from emberframe.operators.calibration import calibration_issues

    row = spark.read.schema(layouts.CALIBRATION).option("multiLine", True).json(path)
    issues = F.concat(all_reasons((F.coalesce(F.col("version") != 1, F.lit(True)), "version")), calibration_issues(**gates))
    return row.withColumn("issues", issues)


def frozen_files(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Files whose content hash equals a frozen value; any other content stops the job."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    actual = F.sha2("content", 256)
    refuse = F.raise_error(F.concat(F.lit("content hash mismatch: "), actual)).cast("boolean")
    return files.filter(F.when(actual == sha256, F.lit(True)).otherwise(refuse))


def geometry_issues(files: DataFrame, direction: str, unit: str) -> DataFrame:
    """Matrices of a geometry XML and what is wrong with them.

    Checks sizes, finiteness, an orthonormal rotation (1e-6) of positive
    determinant, and the stated direction and unit.
    """
    text = F.col("content").cast("string")
    numbers = lambda name: F.transform(
        F.filter(F.split(F.xpath_string(text, F.lit(f"opencv_storage/{name}/data")), r"\s+"), lambda v: v != ""),
        lambda v: v.try_cast("double"),
    )
    word = lambda name: F.regexp_replace(F.xpath_string(text, F.lit(f"opencv_storage/{name}")), '^"|"$|\\s', "")
    rows = files.select(
        "path", numbers("R").alias("R"), numbers("T").alias("T"), numbers("thermal_K").alias("K"),
        numbers("thermal_D").alias("D"), word("direction").alias("direction"), word("unit").alias("unit"),
    )
    r = lambda i, j: F.get("R", 3 * i + j)
    off = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            dot = sum(r(k, i) * r(k, j) for k in range(3))
            off = F.greatest(off, F.abs(dot - (1.0 if i == j else 0.0)))
    det = (
        r(0, 0) * (r(1, 1) * r(2, 2) - r(1, 2) * r(2, 1))
        - r(0, 1) * (r(1, 0) * r(2, 2) - r(1, 2) * r(2, 0))
        + r(0, 2) * (r(1, 0) * r(2, 1) - r(1, 1) * r(2, 0))
    )
    shaped = (F.size("R") == 9) & (F.size("T") == 3) & (F.size("K") == 9) & (F.size("D") == 5)
    finite = F.forall(F.concat("R", "T", "K", "D"), is_finite)
    return rows.withColumn(
        "issues",
        all_reasons(
            (~shaped, "shape"),
            (shaped & ~finite, "not_finite"),
            (shaped & finite & (off > 1e-6), "rotation_not_orthonormal"),
            (shaped & finite & (det <= 0), "rotation_is_reflection"),
            (F.col("direction") != direction, "direction"),
            (F.col("unit") != unit, "unit"),
        ),
    )
