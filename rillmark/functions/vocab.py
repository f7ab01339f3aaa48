"""Controlled vocabularies of logger exports, and recoding of columns by them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels as the loggers and their cloud service export them, and the names used here.
LOGGERS = {"05511": ("Log3", "Control slope"), "19570": ("Log2", "Top of Swale"), "19574": ("Log1", "Bottom of Swale")}
EXCLUDED_LOGGER = "05533"
SENSOR_TYPES = {
    "teros 12": "TEROS12",
    "teros 12 moisture/temp/ec": "TEROS12",
    "atmos 14": "ATMOS14",
    "atmos 14 humidity/temp/barometer": "ATMOS14",
    "ecrn-100": "ECRN100",
    "ecrn-100 precipitation": "ECRN100",
    "battery": "BATTERY",
    "barometer": "BAROMETER",
    "unrecognized": "UNRECOGNIZED",
    "unrecognized sensor": "UNRECOGNIZED",
}
KEPT_TYPES = ("TEROS12", "ATMOS14", "ECRN100", "BATTERY", "BAROMETER")
VARIABLES = {
    "m3/m3 water content": "moisture",
    "m³/m³ water content": "moisture",
    "degree_c soil temperature": "soil_temp",
    "°c soil temperature": "soil_temp",
    "ms/cm saturation extract ec": "sat_extract_ec",
    "ms/cm bulk ec": "bulk_ec",
    "degree_c air temperature": "air_temp",
    "°c air temperature": "air_temp",
    "rh relative humidity": "humidity",
    "kpa vapor pressure": "vapor_pressure",
    "kpa atmospheric pressure": "atm_pressure",
    "kpa vpd": "vpd",
    "mm precipitation": "precipitation",
    "mm/h max precip rate": "max_precip_rate",
    "% battery percent": "battery_pct",
    "mv battery voltage": "battery_mv",
    "kpa reference pressure": "ref_pressure",
    "degree_c logger temperature": "logger_temp",
    "°c logger temperature": "logger_temp",
}
CLOUD_VARIABLES = {
    "Water Content": "moisture",
    "Soil Temperature": "soil_temp",
    "Bulk EC": "bulk_ec",
    "Saturation Extract EC": "sat_extract_ec",
    "Air Temperature": "air_temp",
    "Atmospheric Pressure": "atm_pressure",
    "Relative Humidity": "humidity",
    "VPD": "vpd",
    "Vapor Pressure": "vapor_pressure",
    "Precipitation": "precipitation",
    "Max Precip Rate": "max_precip_rate",
    "Battery Percent": "battery_pct",
    "Battery Voltage": "battery_mv",
    "Reference Pressure": "ref_pressure",
    "Logger Temperature": "logger_temp",
}
CLOUD_TYPES = {"TEROS 12": "TEROS12", "ATMOS 14": "ATMOS14", "ECRN-100": "ECRN100", "Battery": "BATTERY", "Barometer": "BAROMETER", "Signal Strength": "SIGNAL"}
TREATMENTS = {"Sw": "swale", "Con": "control", "For": "forest"}
DISPLAY = {
    "SMS01": "sw_t_10",
    "SMS02": "sw_t_40",
    "SMS04": "sw_m_10",
    "SMS05": "sw_m_40",
    "SMS06": "sw_b1_10",
    "SMS07": "sw_b1_40",
    "SMS08": "sw_b2_10",
    "SMS09": "sw_b2_40",
    "SMS10": "sw_s_40",
    "SMS11": "cn_t_10",
    "SMS12": "cn_t_40",
    "SMS13": "cn_m_10",
    "SMS14": "cn_m_40",
    "SMS15": "cn_b_10",
    "SMS16": "cn_b_40",
}
STATIONS = {
    "SMS01;SMS02": ("swale", "Top slope"),
    "SMS03;SMS04;SMS05": ("swale", "Mound"),
    "SMS06;SMS07": ("swale", "Bottom slope 1"),
    "SMS08;SMS09": ("swale", "Bottom slope 2"),
    "SMS10": ("swale", "Step"),
    "SMS11;SMS12": ("control", "Top slope"),
    "SMS13;SMS14": ("control", "Mid slope"),
    "SMS15;SMS16": ("control", "Bottom slope"),
}
SOURCE_PRIORITY = {"xlsx": 0, "zentracloud": 1, "csv": 2}
ACCUMULATED = ("precipitation",)


def recode(column: Column | str, mapping: dict, default=None) -> Column:
    """column looked up in mapping; missing keys give default (null if not stated)."""
    column = F.col(column) if isinstance(column, str) else column
    found = F.create_map(*map(F.lit, chain(*mapping.items())))[column]
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))
