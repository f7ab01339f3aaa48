import io
import json
import zipfile
from datetime import datetime

import pytest

from rillmark.functions import vocab
from rillmark.operators import clean
from rillmark.sources import archives, config, dims, files, loggers

TYPES = ["TEROS 12 Moisture/Temp/EC"] * 3 + ["ATMOS 14 Humidity/Temp/Barometer"] * 3 + ["ECRN-100 Precipitation"] * 2 + ["Battery"] * 2 + ["Barometer"] * 2
PORTS = ["Port1"] * 3 + ["Port2"] * 3 + ["Port3"] * 2 + ["Port7"] * 2 + ["Port8"] * 2
NAMES = [" m3/m3 Water Content", " degree_C Soil Temperature", " mS/cm Saturation Extract EC", " degree_C Air Temperature", " kPa Vapor Pressure", " kPa Atmospheric Pressure", " mm Precipitation", " mm/h Max Precip Rate", " % Battery Percent", " mV Battery Voltage", " kPa Reference Pressure", " degree_C Logger Temperature"]


def write_csv(path, rows, types=TYPES, ports=PORTS, names=NAMES):
    lines = [["z6-19570", *ports], [f"# Records: {len(rows)}", *types], ["Timestamps", *names], *rows]
    path.write_text("\n".join(",".join(map(str, x)) for x in lines) + "\n")
    return str(path)


def test_csv_becomes_long(spark, tmp_path):
    path = write_csv(tmp_path / "z6-19570 - top-Configuration 1.csv", [["01/02/2024 00:00:00", *range(12)], ["01/02/2024 00:15:00", *range(12)]])
    rows = loggers.read_csv(spark, path).collect()
    assert len(rows) == 24 and {r.error_code for r in rows} == {None} and {r.config_label for r in rows} == {"Configuration 1"}
    assert {r.variable for r in rows if r.port == 1} == {"moisture", "soil_temp", "sat_extract_ec"}
    assert min(r.timestamp for r in rows) == datetime(2024, 2, 1)


def test_csv_drops_unknown_types_bad_times_and_text(spark, tmp_path):
    path = write_csv(tmp_path / "z6-19570.csv", [["02/02/2024 00:00:00", 1, 2, "x"], ["", 1, 2, 3], ["01/02/2024 00:00:00", 4, "", 6]], ["TEROS 12", "TEROS 12", "Mystery"], ["Port1"] * 3, NAMES[:3])
    rows = loggers.read_csv(spark, path).collect()
    assert len(rows) == 4 and len({r.timestamp for r in rows}) == 2 and {r.config_label for r in rows} == {"Config ?"}
    assert sorted(r.value is None for r in rows) == [False, False, False, True]


def test_many_csv_files_are_one_scan(spark, tmp_path):
    (tmp_path / "19570").mkdir()
    a = write_csv(tmp_path / "19570" / "z6-19570 + top-Configuration 1.csv", [["01/02/2024 00:00:00", *range(12)]])
    b = write_csv(tmp_path / "19570" / "z6-19574(1)-Configuration 2.csv", [["01/02/2024 00:15:00", 7, '"8"'], ["01/02/2024 00:30:00", "", 9]], ['"TEROS 12"', "Battery"], ["port 2", '"Port 7"'], [" m3/m3 Water Content", '" % Battery  Percent"'])
    (tmp_path / "19570" / "z6-19574(1)-Configuration 2.csv").write_text("\ufeff" + (tmp_path / "19570" / "z6-19574(1)-Configuration 2.csv").read_text())
    (tmp_path / "19570" / "short.csv").write_text("a\nb\n")
    jobs = loggers.discover(spark, str(tmp_path))
    assert sorted(serial for _, serial, _ in jobs) == ["19570", "19570", "19574"]
    got = loggers.read_all(spark, jobs)
    rows = got.collect()
    assert len(rows) == 16 and {(r.logger_serial, r.source_file.rsplit("-", 1)[-1], r.config_label) for r in rows} == {("19570", "Configuration 1.csv", "Configuration 1"), ("19574", "Configuration 2.csv", "Configuration 2")}
    assert sorted((r.port, r.variable, r.value) for r in rows if r.logger_serial == "19574" and r.value is not None) == [(2, "moisture", 7.0), (7, "battery_pct", 8.0), (7, "battery_pct", 9.0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2  # headers and bodies, whatever the number of files
    assert loggers.read_all(spark, []).count() == 0 and loggers.read_csvs(spark, [a, b]).count() == 16


def cloud(spark, path):
    t = datetime(2024, 5, 1, 6, 30)
    rows = [(t, 1, "TEROS 12", "Water Content", 0.3, 0), (t, 1, "TEROS 12", "Soil Temperature", 25.0, 0), (t, 2, "ATMOS 14", "VPD", 1.0, 0), (t, 7, "Battery", "Battery Percent", 99.0, 0), (t, 1, "TEROS 12", "Bulk EC", 0.0, 137), (t, -1, "Signal Strength", "Signal", 1.0, 0), (t, 1, "TEROS 12", "Raw VWC", 1.0, 0)]
    spark.createDataFrame(rows, "datetime timestamp, port_num long, sensor_name string, measurement string, value double, error_code long").write.mode("overwrite").parquet(str(path))
    return str(path)


def test_cloud_rows_are_mapped_and_local(spark, tmp_path):
    rows = loggers.read_cloud(spark, cloud(spark, tmp_path / "19570.parquet")).collect()
    assert len(rows) == 5 and {r.timestamp for r in rows} == {datetime(2024, 5, 1, 12, 0)}
    assert [r.error_code for r in rows if r.variable == "bulk_ec"] == [137]


def sensors_and_ports(spark):
    rows = [
        ("T12-1", 148668, "SMS 1", "TEROS 12", None, "SwB", " top ", None, 10, "n", "Log2"),
        ("T12-2", 148669, "sms02", "TEROS-12", None, "ForA", None, None, 40, None, "Log9"),
        ("T12-3", None, "SMS3", "TEROS 12", None, "Step", None, "control", -10, None, None),
        ("Dataloggers", None, None, None, None, None, None, None, "Port 1", "Port 2", "Port 3"),
        ("Z6-19570", None, None, None, None, None, None, None, "SMS 1", None, "SMS 3"),
        ("Z6-05533", None, None, None, None, None, None, None, "SMS 2", None, None),
    ]
    return dims.metadata(spark, rows)


def test_metadata(spark):
    sensors, ports = sensors_and_ports(spark)
    got = {r.sensor_id: r for r in sensors.collect()}
    assert set(got) == {"SMS01", "SMS03"} and got["SMS01"].treatment == "swale" and got["SMS03"].treatment == "control"
    assert got["SMS01"].serial_number == "148668" and got["SMS01"].tag == "top" and got["SMS03"].depth_cm == -10
    found = {(r.logger_serial, r.port): r.sensor_id for r in ports.collect()}
    assert found[("19570", 1)] == "SMS01" and found[("19570", 3)] == "SMS03" and found[("05511", 7)] == "BATT_05511" and found[("19570", 5)] == "ATMOS14_19570"
    assert len(found) == 2 + 2 * len(vocab.LOGGERS) + 2
    with pytest.raises(ValueError):
        dims.metadata(spark, [("x", None)])


def test_dataset_prefers_better_sources_and_drops_glitches(spark, tmp_path):
    sensors, ports = sensors_and_ports(spark)
    (tmp_path / "root/19570").mkdir(parents=True)
    write_csv(tmp_path / "root/19570/z6-19570 a-Configuration 1.csv", [["01/05/2024 12:00:00", 0.5, 25, 1], ["01/01/2099 00:00:00", 1, 1, 1], ["01/05/2024 12:30:00", 0.32, 25, 1]], TYPES[:3], PORTS[:3], NAMES[:3])
    write_csv(tmp_path / "root/19570/z6-19570 Raw-Configuration 1.csv", [["01/05/2024 12:00:00", 9, 9, 9]], TYPES[:3], PORTS[:3], NAMES[:3])
    (tmp_path / "cloud").mkdir()
    cloud(spark, tmp_path / "cloud/19570.parquet")
    jobs = loggers.discover(spark, str(tmp_path / "root"), None) + [("cloud", "19570", str(tmp_path / "cloud/19570.parquet"))]
    assert len(jobs) == 2
    rows = loggers.dataset(spark, jobs, sensors, ports)
    assert rows.columns == loggers.COLUMNS
    got = {(r.port, r.variable, r.timestamp): r for r in rows.collect()}
    noon = got[(1, "moisture", datetime(2024, 5, 1, 12, 0))]
    assert (noon.value, noon.source_format, noon.sensor_id, noon.treatment) == (0.3, "zentracloud", "SMS01", "swale")
    assert got[(1, "bulk_ec", datetime(2024, 5, 1, 12, 0))].error_code == 137
    assert max(t for *_, t in got) < datetime(2030, 1, 1)
    with pytest.raises(ValueError):
        loggers.dataset(spark, jobs, sensors, ports, on_conflict="raise")
    full = loggers.dataset(spark, jobs, sensors, ports, step=900).where("variable = 'moisture'").orderBy("timestamp").collect()
    assert [r.value for r in full] == [0.3, None, 0.32] and {r.sensor_id for r in full} == {"SMS01"}
    loggers.write_cache(rows, str(tmp_path / "cache"))
    assert loggers.read_cache(spark, str(tmp_path / "cache")).count() == rows.count()


def test_tolerance_and_ties(spark):
    rows = spark.createDataFrame([("k", 0.301234, "csv"), ("k", 0.3, "zentracloud"), ("j", 0.3, "csv"), ("j", 0.5, "xlsx")], "k string, value double, source string")
    assert [r.k for r in clean.conflicts(rows, ["k"], "value", "source").collect()] == ["j"]
    assert {r.k: r.value for r in clean.priority_dedup(rows, ["k"], "source").collect()} == {"k": 0.3, "j": 0.5}
    gap = spark.createDataFrame([("k", None, "xlsx"), ("k", 1.0, "csv")], "k string, value double, source string")
    assert clean.priority_dedup(gap, ["k"], "source").first().value is None
    assert clean.priority_dedup(gap, ["k"], "source", prefer_non_null="value").first().value == 1.0


def test_points(spark, tmp_path):
    path = tmp_path / "p.xyz"
    path.write_text("1.0, 2.0, 3.0, 9\n4 5 6 9 9 9\nbad line here\n7 8\n")
    assert [tuple(r) for r in files.read_points(spark, str(path)).orderBy("x").collect()] == [(1.0, 3.0, 2.0), (4.0, 6.0, 5.0)]
    files.write_points(files.read_points(spark, str(path)), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_waveform_archives(spark, tmp_path):
    head = "a,b,m,n,injection_id,channel_mn,time,current,voltage,polarity\n"
    name = "dipdip_line_A_results_20250408T235131"
    with zipfile.ZipFile(tmp_path / f"{name}_fw.zip", "w") as z:
        z.writestr("x_fw.csv", head + "1,2,3,4,0,0,0.1,10,5,1\n1,2,3,5,0,0,0.1,10,5,-1\n")
    (tmp_path / "wenner_line_B_results_20250409T000000_fw.zip").write_bytes(b"not a zip")
    (tmp_path / f"{name}.csv").write_text("a,b,m,n,r_[Ohm],vmn_[mV]\n1,2,3,4,10,1\n3,4,1,2,11,x\n")
    index = files.survey_index(spark, str(tmp_path))
    got = {r.line: r for r in index.collect()}
    assert got["A"].timestamp == datetime(2025, 4, 8, 23, 51, 31) and got["A"].results_csv.endswith(".csv") and got["B"].results_csv is None
    rows = files.read_waveforms(spark, index, str(tmp_path)).collect()
    assert {r.quad for r in rows} == {"1_2_3_4", "1_2_3_5"} and {r.line for r in rows} == {"A"}
    assert files.read_waveforms(spark, index, str(tmp_path), ["1_2_3_5"]).count() == 1
    results = {r.quad: r for r in files.read_results(spark, index).collect()}
    assert abs(results["1_2_3_4"].recip_err_pct - 1 / 10.5 * 100) < 1e-9 and results["3_4_1_2"].vmn is None
    members, bad = files.unzip(spark, str(tmp_path))
    assert members.count() == 1 and bad.count() == 1


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_archives_are_read_in_parts_with_the_session_as_it_was(spark, tmp_path):
    head = "a,b,m,n,injection_id,channel_mn,time,current,voltage,polarity\n"
    rows = lambda k: "".join(f"1,2,3,{i % 5},{k},0,{i / 10},10,{i},{1 - i % 3}\n" for i in range(2000))
    a, b = "dipdip_line_A_results_20250408T235131_fw.zip", "wenner_line_B_results_20250409T000000_fw.zip"
    archive(tmp_path / a, {"one_fw.csv": head + rows("p"), "other.txt": "no", "two_fw.csv": head + rows("q") + "1,2,x,4,q,0,no,1e1,+2.5,1.5\n"})
    archive(tmp_path / b, {"bad_fw.csv": head + rows("r"), "empty_fw.csv": "", "head_fw.csv": head, "short_fw.csv": "a,b,time\n1,2,0.5\n"})
    torn = (tmp_path / b).read_bytes()
    (tmp_path / "wenner_line_C_results_20250409T000000_fw.zip").write_bytes(torn[:300] + b"\x00" * 60 + torn[360:])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = files.survey_index(spark, str(tmp_path))
    got = files.read_waveforms(spark, index.where("line <> 'C'"), str(tmp_path))
    assert got.count() == 6002 and got.where("injection_id = 'q'").count() == 2001
    odd = got.where("injection_id = 'q' AND time IS NULL").first()
    assert (odd.a, odd.m, odd.n, odd.current, odd.voltage, odd.polarity, odd.quad) == (1, None, 4, 10.0, 2.5, None, None)
    assert files.read_waveforms(spark, index.where("line <> 'C'"), str(tmp_path), ["1_2_3_4", "1_2_3_0"]).count() == 2400
    problems = files.waveform_problems(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[-1][:13] for r in problems} == {"wenner_line_C"}
    whole, split = (archives.load(spark, "waveforms", str(tmp_path), split=n).where("path NOT LIKE '%line_C%'") for n in (None, "1"))
    assert whole.rdd.getNumPartitions() == 3 and split.rdd.getNumPartitions() == 11  # a task for each archive, or for each member
    assert split.exceptAll(whole).count() == whole.exceptAll(split).count() == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = archives.load(spark, "waveforms", str(tmp_path), ending="_fw.zip")
        assert rows.where("quad = '1_2_3_4'").count() == 1200 and rows.where("quad IN ('1_2_3_4', '1_2_3_0')").where("voltage > 0").count() == 2397
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = archives._PushedWaveforms({"path": str(tmp_path)})
    assert len(reader.partitions()) == 3 and list(reader.pushFilters([archives.In(("quad",), ("x",)), archives.EqualTo(("a",), 1)])) == [archives.EqualTo(("a",), 1)]
    assert reader.quads == {"x"}


def workbook(path, sheets, early=False):
    """A minimal .xlsx; text goes to the shared strings, dates (as serial numbers) get a date style, a tuple is an inline string."""
    strings, parts = [], {}
    column = lambda i: (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)

    def cell(r, i, x):
        at = f'r="{column(i)}{r}"'
        if isinstance(x, datetime):
            days = (x - (datetime(1904, 1, 1) if early else datetime(1899, 12, 30))).total_seconds() / 86400
            return f'<c {at} s="1"><v>{days!r}</v></c>'
        if isinstance(x, tuple):
            return f'<c {at} t="inlineStr"><is><t>{x[0]}</t></is></c>'
        if isinstance(x, str):
            strings.append(x)
            return f'<c {at} t="s"><v>{len(strings) - 1}</v></c>'
        return "" if x is None else f"<c {at}><v>{x}</v></c>"

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    for k, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r}">{"".join(cell(r, i, x) for i, x in enumerate(row))}</row>' for r, row in enumerate(rows, 1) if row)
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><workbookPr{" date1904=" + chr(34) + "1" + chr(34) if early else ""}/><sheets>{names}</sheets></workbook>'
    links = "".join(f'<Relationship Id="rId{k}" Type="worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>'
    parts["xl/styles.xml"] = f'<styleSheet {main}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd &quot;at&quot; hh:mm"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="2"/></cellXfs></styleSheet>'
    parts["xl/sharedStrings.xml"] = f"<sst {main}>{''.join(f'<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>' for s in strings)}</sst>"
    archive(path, parts)
    return str(path)


@pytest.mark.parametrize("early", [False, True])
def test_workbook_sheets_become_long(spark, tmp_path, early):
    names = ["m³/m³ Water Content", "°C Soil Temperature", "mS/cm Bulk EC", "% Battery Percent", "mV Battery Voltage", "kPa Reference Pressure", "°C Logger Temperature"]
    head = [["z6-19570", *["Port 1"] * 3, *["Port 7"] * 2, *["Port 8"] * 2], ["Records", *["TEROS 12"] * 3, *["Battery"] * 2, *["Barometer"] * 2], ["Timestamps", *names]]
    t = datetime(2024, 2, 1, 0, 15)
    rows = [[t, 0.3, 20.5, 0.1, 99, 7000, 100.5, 25], [], ["no time", 1, 2, 3, 4, 5, 6, 7], [datetime(2024, 2, 1, 0, 30), None, ("text",), 0.2, 98, 7001, 100.25, 26]]
    path = workbook(tmp_path / "z6-19570.xlsx", {"Processed Data Config 1": head + rows[:1], "Metadata": [["x"]], "processed data configuration 2 ": head + rows}, early)
    got = loggers.read_workbook(spark, path).collect()
    assert {(r.config_label, r.source_format, r.source_file) for r in got} == {("Config 1", "xlsx", "z6-19570.xlsx"), ("configuration 2", "xlsx", "z6-19570.xlsx")}
    first = {r.variable: (r.timestamp, r.port, r.value) for r in got if r.config_label == "Config 1"}
    assert first == {"moisture": (t, 1, 0.3), "soil_temp": (t, 1, 20.5), "bulk_ec": (t, 1, 0.1), "battery_pct": (t, 7, 99.0), "battery_mv": (t, 7, 7000.0), "ref_pressure": (t, 8, 100.5), "logger_temp": (t, 8, 25.0)}
    second = [r for r in got if r.config_label != "Config 1"]
    assert len(second) == 14 and [r.value for r in second if r.timestamp != t and r.variable in ("moisture", "soil_temp")] == [None, None]
    assert loggers.read_workbook(spark, workbook(tmp_path / "none.xlsx", {"Other": [["x"]]})).count() == 0
    jobs = loggers.discover(spark, str(tmp_path))
    assert [(kind, serial) for kind, serial, _ in jobs] == [("xlsx", "19570")] and loggers.read_all(spark, jobs).count() == 21


def test_stations(spark, tmp_path):
    path = tmp_path / "s.csv"
    row = lambda label, x, y: ",".join([label, *["0"] * 9, str(x), "0.1", str(y), "0.2", "3", "0.3"])
    path.write_text("label," + ",".join(["X", "Y", "Z"] * 5) + "\n" + row("\"'SMS 1, 2'\"", 5, 6) + "\n" + row("Weather", 1, 2) + "\n")
    got = {r.label: r for r in dims.read_stations(spark, str(path)).collect()}
    one = got["'SMS 1, 2'"]
    assert one.sensor_ids == ["SMS01", "SMS02"] and (one.x, one.y, one.z) == (-5.0, -6.0, 3.0) and one.location == "Top slope"
    assert got["Weather"].sensor_ids == [] and dims.sensor_positions(dims.read_stations(spark, str(path))).count() == 2


def test_electrodes_and_sequences(spark, tmp_path):
    (tmp_path / "e.csv").write_text("No,Line,X_av,Y_av,Z_av\n7,A,1,2,3\n")
    got = dims.read_electrodes(spark, str(tmp_path / "e.csv"), "No").first()
    assert tuple(got) == (7, "A", 1.0, 2.0, 3.0)
    (tmp_path / "s.csv").write_text("1 2 3 4\n5 6 7 8\n")
    assert dims.read_sequence(spark, str(tmp_path / "s.csv")).count() == 2
    cables = spark.createDataFrame([("A", 1, 7), ("B", 1, 8)], "line string, number int, channel int")
    places = spark.createDataFrame([("A", 1, 0.0, 0.0, 1.0)], "line string, number int, x double, y double, z double")
    assert [r.channel for r in dims.cable_positions(cables, places).collect()] == [7]


def test_settings(tmp_path):
    (tmp_path / "config").mkdir()
    file = tmp_path / "config/settings.json"
    file.write_text(json.dumps({"equilibration": {"days_default": 7, "days_overrides": {"SMS01": 3}}, "data": {"data_root": "d"}}))
    got = config.load(str(file))
    assert got.equilibration.days == 7 and got.equilibration.overrides == {"SMS01": 3} and got.data_root == str(tmp_path / "d") and got.x_sign == -1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), 1, 2, 3, 4, 5.0, None)] * 6 + [(datetime(2024, 1, 2), 1, 2, 3, 4, 5.0, 8.0)], "timestamp timestamp_ntz, a int, b int, m int, n int, R double, recip_err_pct double")
    files.write_protocol(rows, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).select("value").distinct().collect()[0][0] == "1 2 3 4 5.000000 0.050000"
    (tmp_path / "log.txt").write_text("Iteration: 3\nRMS Misfit: 1.04\n")
    assert files.inversion_rms(spark, str(tmp_path / "log.txt")).first().rms == 1.04
    files.write_csv(rows, str(tmp_path / "c"))
    keys = files.content_key(rows, ["a"], "timestamp", "R", "v1").collect()
    assert len(keys[0].cache_key) == 64 and io


def test_cache_depends_on_parameters(spark, tmp_path):
    calls = []

    def build(n):
        calls.append(n)
        return spark.range(n)

    for n in (3, 3, 4):
        assert files.cached(spark, f"file://{tmp_path}/c", "scan", f"bins={n}", lambda n=n: build(n)).count() == n
    assert calls == [3, 4]
