"""Dimension tables: sensors, ports, stations, electrodes. All are a few rows, parsed on the driver."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import scalars as S
from rillmark.functions import vocab

SENSORS = "sensor_id string, field_id string, serial_number string, sensor_type string, location string, tag string, treatment string, depth_cm smallint, location_notes string"
PORTS = "logger_serial string, port smallint, sensor_id string, sensor_type string, logger_alias string, logger_location string"
#: Channels that loggers have without an inventory entry: (port, id prefix, type), on all loggers or on one.
INTERNAL = [(7, "BATT", "BATTERY"), (8, "BARO", "BAROMETER")]
EXTERNAL = [("19570", 5, "ATMOS14", "ATMOS14"), ("19570", 6, "ECRN100", "ECRN100")]


def _text(x) -> str | None:
    return x if isinstance(x, str) else None


def _sms(code) -> str | None:
    found = re.fullmatch(r"SMS\s*0*(\d+)", str(code or "").strip().upper())
    return f"SMS{int(found[1]):02d}" if found else None


def _whole(x) -> int | None:
    try:
        return round(float(x))
    except (TypeError, ValueError):
        return None


def metadata(spark: SparkSession, rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(sensors, ports) of the stacked inventory and logger tables of one sheet, given as rows of cells.

    Treatment is the stated one, else that of the location's prefix; forest rows are left out. The first port column of
    the logger table is found by its label. Missing depths and treatments are warned about and kept.
    """
    sensors, ports, loggers = [], [], None
    for i, row in enumerate(rows):
        cells = (*row, *[None] * 12)[:12]
        if str(cells[0] or "").strip().lower() == "dataloggers":
            loggers = i
            continue
        sid = _sms(cells[2])
        if sid is None or "TEROS" not in str(cells[3] or "").upper():
            continue
        location, stated = _text(cells[5]), str(cells[7] or "").strip().lower()
        derived = next((t for p, t in vocab.TREATMENTS.items() if location and location.startswith(p)), None)
        treatment = stated if stated in vocab.TREATMENTS.values() else derived
        if treatment != "forest":
            serial = None if cells[1] is None else str(_whole(cells[1]) if _whole(cells[1]) is not None else cells[1])
            sensors.append((sid, _text(cells[0]), serial, "TEROS12", location, _text(cells[6]) and cells[6].strip(), treatment, _whole(cells[8]), _text(cells[9])))
    if loggers is None:
        raise ValueError("no Dataloggers table")
    first = next((i for i, c in enumerate(rows[loggers]) if str(c or "").strip().lower() == "port 1"), None)
    if first is None:
        raise ValueError("no Port 1 column in the Dataloggers table")
    for row in rows[loggers + 1 :]:
        name = str(row[0] or "") if row else ""
        if not name.upper().startswith("Z6-"):
            continue
        serial = name.split("-", 1)[1].strip().zfill(5)
        if serial in vocab.LOGGERS:
            ports += [(serial, p, _sms(c), "TEROS12") for p, c in enumerate(row[first : first + 6], start=1) if c and _sms(c)]
        elif serial != vocab.EXCLUDED_LOGGER:
            warnings.warn(f"unknown logger {serial}", stacklevel=2)
    ports += [(s, p, f"{prefix}_{s}", kind) for s in vocab.LOGGERS for p, prefix, kind in INTERNAL]
    ports += [(s, p, f"{prefix}_{s}", kind) for s, p, prefix, kind in EXTERNAL]
    for what, at in (("depth", 7), ("treatment", 6)):
        if missing := [s[0] for s in sensors if s[at] is None]:
            warnings.warn(f"sensors without {what}: {missing}", stacklevel=2)
    return spark.createDataFrame(sensors, SENSORS), spark.createDataFrame([(*p, *vocab.LOGGERS[p[0]]) for p in ports], PORTS)


def read_metadata(spark: SparkSession, path: str, sheet: str = "Serials") -> tuple[DataFrame, DataFrame]:
    import openpyxl

    book = openpyxl.load_workbook(path, data_only=True, read_only=True)
    if sheet not in book.sheetnames:
        raise ValueError(f"no sheet {sheet}")
    return metadata(spark, list(book[sheet].iter_rows(values_only=True)))


def read_stations(spark: SparkSession, path: str, sx: int = -1, sy: int = -1) -> DataFrame:
    """(label, sensor_ids, x, y, z, x_std, y_std, z_std, treatment, location) of a locations CSV.

    Headers repeat, so columns go by position: label 0, averages and deviations 10 to 15. Landmarks have no ids.
    """
    raw = spark.read.schema(", ".join(f"c{i} string" for i in range(16))).csv(path)
    number = lambda i: S.to_number(F.col(f"c{i}"))
    ids = S.station_sensors(F.col("c0"))
    x, y = S.canonical_xy(number(10), number(12), sx, sy)
    out = raw.where(number(10).isNotNull() & F.col("c0").isNotNull()).select(F.col("c0").alias("label"), ids.alias("sensor_ids"), x.alias("x"), y.alias("y"), number(14).alias("z"), number(11).alias("x_std"), number(13).alias("y_std"), number(15).alias("z_std"))
    key = F.array_join("sensor_ids", ";")
    return out.withColumns({"treatment": vocab.recode(key, {k: v[0] for k, v in vocab.STATIONS.items()}), "location": vocab.recode(key, {k: v[1] for k, v in vocab.STATIONS.items()})})


def sensor_positions(stations: DataFrame) -> DataFrame:
    return stations.select(F.explode("sensor_ids").alias("sensor_id"), "x", "y", "z")


def read_electrodes(spark: SparkSession, path: str, channel: str) -> DataFrame:
    """(channel, line, x, y, z) of a CSV with the columns Line, X_av, Y_av, Z_av and one, named by `channel`, with channel numbers."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(S.to_number(F.col(f"`{channel}`")).cast("int").alias("channel"), F.col("Line").alias("line"), *(S.to_number(F.col(f"{c.upper()}_av")).alias(c) for c in "xyz"))


def read_sequence(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    return spark.read.schema("a int, b int, m int, n int").option("sep", delimiter).csv(path)


def cable_positions(cables: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Cable electrodes (line, number, channel) with their surveyed coordinates (line, number, x, y, z)."""
    return cables.join(coordinates, ["line", "number"])


