"""Messages with known records."""

import json

import pytest

from aerolith.decoders import binary, registry
from aerolith.decoders.engine import Format, dispatch, to_java

DECODERS = registry("all")

CASES = [
    ("SQ", "02XAORDKORD04158N08754WV136975/ARINC", "sq", {"iata_code": "ORD", "icao_code": "KORD", "latitude": 41.966667, "longitude": -87.9, "freq_mhz": 136.975}),
    ("SQ", "02XSSYDYSSY03357S15111EV136975/", "sq", {"icao_code": "YSSY", "latitude": -33.95, "longitude": 151.183333}),
    ("SA", "0LS0959482", "mediaadv", {"established": False, "link_time": "09:59:48"}),
    ("22", "N 325338W 971058,-------,182836,9977, ,      , ,M  3,31102  64,,,", "label22", {"latitude": 32.893889, "longitude": -971.096667, "report_time": "182836", "altitude": 9977, "mach": 0.83, "flight_level": 311}),
    ("10", "/N40.024/W073.100/10/0.72/230/430/KISM/2057/0064/00015/ZIZZI/TBONN/1831/", "label10", {"latitude": 40.024, "longitude": -73.1, "mach": 0.72, "heading": 230, "flight_level": 430, "fuel": 64, "distance": 15, "waypoints": [{"name": "ZIZZI"}, {"name": "TBONN", "eta": "1831"}]}),
    ("4T", "AGFSR AC0620/26/26/YYZFLL/1756Z/830/3457.3N07711.0W/300/CRUISE/0122/0071/M37/248095/0300/202/----/----/****", "agfsr", {"latitude": 34.955, "longitude": -77.183333, "mach": 1.17, "wind_dir": 248, "wind_speed": 95, "heading": 300, "ground_speed": 202}),
    ("15", "FST01EGLCEIDWN51420W00049317M020C080301", "fst", {"origin": "EGLC", "latitude": 51.7, "longitude": -0.081667, "flight_level": 317, "temperature": -20}),
    ("83", "001PR29182901N5106.0W11400.4035000", "label83", {"day_of_month": 29, "latitude": 51.1, "longitude": -114.006667, "altitude": 35000}),
    ("5Z", "/ET EXP TIME       / KSNA KIAH 29 182901/EON 1908 AUTO", "eta", {"origin": "KSNA", "destination": "KIAH", "day_of_month": 29, "report_time": "182901", "eta": "1908", "mode": "AUTO"}),
    ("RA", "GATE ASSIGNMENT: B12", "gateassign", {"gate": "B12"}),
    ("H1", "FPN/SN123/FNAAL92:DA:KJFK:AA:KLAX:F:MERIT..DIXIE..WHALE", "fpn", {"flight_num": "AAL92", "origin": "KJFK", "destination": "KLAX", "waypoints": [{"name": "MERIT"}, {"name": "DIXIE"}, {"name": "WHALE"}]}),
    ("H1", "FPN/SN1/FNJST12:DA:YSSY:AA:YMML:F:GUKEB,N33490E034050..DURAN:AP:ILS16L/ZE", "fpn", {"waypoints": [{"name": "GUKEB", "latitude": pytest.approx(33.816667, abs=1e-6), "longitude": pytest.approx(34.083333, abs=1e-6)}, {"name": "DURAN"}], "approach_type": "ILS", "approach_runway": "16L"}),
    ("H1", "#M1BFPN/FNJST12:DA:YSSY:AA:YMML:F:GUKEB", "fpn", {"truncated": True}),
    ("H1", "PWI/TS193835,050625/CB100275026.050205038/WD370,MERIT,270050,350M52.DIXIE,271051,350M53", "pwi", {"report_time": "193835", "climb_winds": [{"flight_level": 100, "wind_dir": 275, "wind_speed": 26}, {"flight_level": 50, "wind_dir": 205, "wind_speed": 38}]}),
    ("H1", "++86501,N8747Q,B7377,261125,WN0057,KDAL,KHOU,1234,TS-1\nN3702.1,W09921.8,120918,39000,-64.3,256,037,CL,00000,0,\n", "trajectory", {"registration": "N8747Q", "distance": 1234}),
    ("H1", "MDC REPORT: ENGINE TREND\r\nL N1 80.0 %\nR N1 80.1 %\nL ITT 706 C\n", "mdc", {"engine_trend": {"left_n1": 80.0, "right_n1": 80.1, "left_itt": 706}}),
    ("3E", "DELAY SUMMARY\nAY1366/26NOV2025 HEL-CDG\nSTD 10:00 DEP DELAY 13 MIN\nARR DELAY 20 MIN\nDL93/11MIN DL81/2MIN", "delay", {"dep_delay_minutes": 13, "arr_delay_minutes": 20, "delay_codes": [{"code": "DL93", "minutes": 11}, {"code": "DL81", "minutes": 2}]}),
    ("3E", "FUEL DELIVERY AY571 OH-LVA 26.11.2025 AMOUNT: 6805 LTRS DENSITY: 807 KG/M3 QTY BEFORE (KG): 2900 KG", "fuel", {"amount_litres": 6805, "density_kg_m3": 807, "qty_before_kg": 2900}),
    ("H1", "HAZARD ALERT FOR KFE300 F1: LMML-LSGG EDR TURBULENCE IS 0.5 EDR", "hazard", {"callsign": "KFE300", "edr": 0.5, "alert_level": "CRITICAL", "origin": "LMML"}),
    ("1E", "PKG INFO MSG ESCALE CDG PARKING AVION: K64 TAPIS A BAGAGES : 330E69", "parking", {"parking_stand": "K64", "baggage_carousel": "330E69"}),
    ("3E", "PAX CONN STATUS\nAB123 26112025 10:00 LHR\nPENDING Y 2 3\n--------------------------------\nAB124 26112025 11:00 CDG\nWILLWAIT Y 5 1", "paxconn", {"pending_count": 2, "will_wait_count": 5, "total_connecting": 7}),
    ("RA", "TAKEOFF DATA GTOW / CG PAX\n 409.3/25.1 226\nLENGTH KPDX SHIFT\n11000 10R 0\nV1 130", "takeoff", {"gtow": 409.3, "cg": 25.1, "pax": 226}),
    ("RA", "DISPATCHER MSG\nASA849 N123AS\nMIN TO FUEL 12", "dispatch", {"flight_number": "ASA849", "category": "FUEL", "ack_required": False}),
    ("A9", "/HKGATYA.TI2/VHHH ARR ATIS G\n0730Z WIND 090/10KT QNH 1015HPA RWY 07C RWY 07R RWY 07C", "atis", {"airport": "VHHH", "atis_letter": "G", "qnh": "1015", "runways": ["07C", "07R"]}),
    ("C1", "LOADSHEET FINAL 1230 EDNO1\nLX123/26 26NOV25\nZRH LHR HB-JCA 2/4\nZFW 39754 MAX 50000\nTOF 4800\nTOW 44554 MAX 60000\nLAW 42554 MAX 52000\nPAX/10/55 TTL 65", "loadsheet", {"format_name": "standard_kg", "zfw": 39754, "tow": 44554, "pax": 65}),
    ("C1", "FINAL LOADSHEET\nREGO: VH-OQA\nFLIGHT: QF11\nQF11 26NOV SYD A380 4/20\nZFW 150.6\nTOF 50.1 TOW 200.7\nTIF 40.0 LAW 160.7", "loadsheet", {"format_name": "qantas_tonnes", "zfw": 150600}),
    ("XX", "PDC 010626\nJST501 A320 YSSY 0630\nCLEARED TO YMML VIA\n16L ABBEY3 DEP WOL:TRAN\nROUTE: DCT WOL H65 RAZZI Q29 BOOIN DCT\nCLIMB VIA SID TO: 5000\nDEP FREQ: 123.000\nSQUAWK 3670", "pdc", {"pdc_format": "australian", "flight_number": "JST501", "origin": "YSSY", "destination": "YMML", "runway": "16L", "sid": "ABBEY3", "squawk": "3670", "route": "DCT WOL H65 RAZZI Q29 BOOIN DCT", "route_waypoints": ["WOL", "RAZZI", "BOOIN"]}),
    ("XX", "/GVADCXA.DC1/CLD 1412 251226 LSZH PDC 054\nEIN34Y CLRD TO EIDW OFF 28 VIA VEBIT4W\nSQUAWK 3041 ADT MDI NEXT FREQ 121.925 ATIS D", "pdc", {"pdc_format": "dc1_clearance", "flight_number": "EIN34Y", "runway": "28", "sid": "VEBIT4W", "squawk": "3041", "atis": "D"}),
]


def test_known_records(spark):
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "delivery_id long, label string, raw_text string")
    found = {(r.delivery_id, r.parser): json.loads(r.result) for r in dispatch(rows, DECODERS).collect()}
    for i, (_, _, parser, expected) in enumerate(CASES):
        record = found[(i, parser)]
        for name, value in expected.items():
            assert record[name] == (pytest.approx(value, abs=1e-6) if isinstance(value, float) else value), (parser, name)


@pytest.mark.parametrize("label, text", [("SQ", "00XS"), ("SQ", None), ("SQ", ""), ("16", "143139,25634"), ("SA", "0LS2559482"), ("99", "02XAORDKORD04158N08754WV136975"), ("B2", "NOTHING HERE"), ("C1", "LOADSHEET FINAL"), ("RA", "NO PDC ON FILE"), ("H1", "FPN/:DA:KJ:AA:KLAX")])
def test_no_record(spark, label, text):
    rows = spark.createDataFrame([(1, label, text)], "delivery_id long, label string, raw_text string")
    assert dispatch(rows, DECODERS).count() == 0


def test_binary_messages_are_dispatched(spark):
    texts = [("B6", "/QUKAXBA.ADS.G-ZBKO072495A7EE7786F6A4D21F7A5D"), ("AA", "/ANCATYA.AT1.N514DN220012E8294A952882D8"), ("RA", "GATE ASSIGNMENT: B12"), (None, "x"), ("BA", None)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "delivery_id long, label string, raw_text string")
    every = binary.dispatch_every(rows, DECODERS).collect()
    assert sorted((r.delivery_id, r.parser) for r in every) == [(0, "adsc"), (1, "cpdlc"), (1, "envelope"), (2, "gateassign")]
    assert json.loads(next(r.result for r in every if r.parser == "adsc"))["altitude"] == 14260
    places = {r.parser: r.ord for r in every}
    assert places["adsc"] < places["cpdlc"] < places["envelope"]
    assert sorted((r.delivery_id, r.parser) for r in binary.dispatch_every(rows, DECODERS, first=True).collect()) == [(0, "adsc"), (1, "cpdlc"), (2, "gateassign")]


def test_reparse_compares_contents(spark, tmp_path):
    from aerolith.plans.decode import reparse_changes

    sheet = '{"message_id":%d,"timestamp":"2025-01-01","gate":"%s","tail":null}'
    log = [(1, "RA", "GATE ASSIGNMENT: B12", "gate_assignment", sheet % (1, "B12")), (2, "RA", "GATE ASSIGNMENT: B13", "gate_assignment", sheet % (2, "B99")), (3, "AA", "/ANCATYA.AT1.N514DN220012E8294A952882D8", "cpdlc", "{}"), (4, "XX", "x", "position", "{}")]
    spark.createDataFrame(log, "delivery_id long, label string, raw_text string, parser_type string, parsed_json string").write.parquet(str(tmp_path / "messages.parquet"))
    found = {(r.result_type, r.change): r.n for r in reparse_changes(spark, str(tmp_path)).collect()}
    assert found == {("gate_assignment", "same"): 1, ("gate_assignment", "changed"): 1, ("cpdlc", "changed"): 1, ("envelope", "improvement"): 1, ("position", "regression"): 1}


def test_translation():
    pattern, names = to_java(r"^(?P<a_b>\s+)[\s,]$")
    assert names == ["a_b"] and pattern == "(?d)^([ \\t\\n\\f\\r]+)[ \\t\\n\\f\\r,]\\z"


def test_long_text_ends_in_time(spark):
    text = "/POS N29.5W95.2" * 20_000
    rows = spark.createDataFrame([(1, "80", text), (2, "H1", "POS" + "N" * 100_000)], "delivery_id long, label string, raw_text string")
    assert dispatch(rows, DECODERS).count() == 0


def test_first_format_wins():
    assert Format("x", "{ICAO}").java()[0].endswith("[A-Z]{3}")


def test_binary_records():
    found = binary.surveillance("/QUKAXBA.ADS.G-ZBKO072495A7EE7786F6A4D21F7A5D")
    assert found["message_type"] == "basic" and found["altitude"] == 14260 and found["latitude"] == pytest.approx(51.447, abs=1e-3) and found["longitude"] == pytest.approx(-3.082, abs=1e-3)
    assert binary.surveillance("/QUKAXBA.ADS.G-ZBKO072495A7EE7786F6A4D21F7A5E") is None and binary.surveillance("x.ADS.") is None
    assert binary.envelope("/YEGE2YA.ADS.HL838207020BCA0C010D010F0110012AA9")["altitude"] == "FL202"
    assert binary.envelope("/PIKCPYA.AT1.F-GSQC214823E24092E7")["tail"] == "F-GSQC"
    for raw, value in ((0, 0.0), (0x080000, 90.0), (0x180000, -90.0), (0x0FFFFF, 180.0)):
        assert binary.scaled((raw << 3).to_bytes(3, "big"), 0, 21, 180.0) == pytest.approx(value, abs=1e-3)


def test_long_adverse_texts(spark):
    rows = spark.createDataFrame([(1, "C1", "LOADSHEET FINAL 1230 " + "AB12/26 26NOV25\nZRH LHR HBJCA 2/4\nZFW 1 MAX 2 TOW " * 600), (2, "3S", "LOADSHEET FINAL 001 1230 " + "ZFW 1 TOW " * 3000), (3, "RA", "PDC 1 " + "CLEARED TO YMML VIA " * 2000)], "delivery_id long, label string, raw_text string")
    assert dispatch(rows, DECODERS).count() == 0


def test_controller_messages():
    found = binary.controller("/SOUCAYA.AT1.HL8251243F880C3D903BB412903604FE326C2479F4A64F7F62528B1A9CF8382738186AC28B16668E013DF464D8A7F0", "AA")
    assert found["registration"] == "HL8251" and found["direction"] == "downlink" and found["elements"][0]["id"] == 48 and found["header"]["msg_id"] == 8 and found["elements"][0]["label"] == "POSITION REPORT [positionreport]"
    assert found["header"] == {"msg_id": 8, "timestamp": {"hours": 15, "minutes": 56, "seconds": 32}}
    assert binary.controller("/ANCATYA.AT1.N514DN220012E8294A952882D8", "AA")["error"] == "decode_failed"
    assert binary.controller("/ANCATYA.AT1.N514DN220012E8294A952882D9", "AA")["error"] == "crc_failed"
    assert binary.controller("HELLO", "AA") is None and binary.direction("BA") == "uplink" and binary.direction("AA", "B") == "uplink" and binary.direction("BA", "5") == "downlink"


def _packed(*fields):
    """Bits from (value, width), a text (seven bits a letter) or a string of bits."""
    out = "".join(f if isinstance(f, str) else f"{f[0]:0{f[1]}b}" for f in fields)
    out += "0" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8)


def _letters(text):
    return "".join(f"{ord(c):07b}" for c in text)


HEADER = "000" + f"{9:06b}"
FL350 = ("110", (320, 10))


@pytest.mark.parametrize(
    "way,fields,text,data",
    [
        ("uplink", [(3, 8)], "ROGER", None),
        ("uplink", [(32, 8), *FL350, "110", (340, 10)], "DESCEND TO AND MAINTAIN BLOCK FL350 TO FL370", {"altitude1": {"type": "flight_level", "value": 350}, "altitude2": {"type": "flight_level", "value": 370}}),
        ("uplink", [(94, 8), "1", "0", (269, 9)], "TURN right HEADING 270M", {"direction": "right", "degrees": {"magnetic": True, "value": 270}}),
        ("uplink", [(64, 8), "0", (19, 7), (0, 4)], "OFFSET 20 nm left OF ROUTE", {"distance": 20, "unit": "nm", "direction": "left"}),
        ("uplink", [(123, 8), (4, 3), (2, 3), (7, 3), (0, 3)], "SQUAWK 4270", {"code": "4270"}),
        ("uplink", [(153, 8), "1", (2632, 13)], "ALTIMETER [altimeter]", {"type": "hpa", "value": 1013.2}),
        ("uplink", [(169, 8), (5, 8), _letters("HELLO")], "HELLO", {"text": "HELLO"}),
        ("uplink", [(171, 8), "0", (15, 6)], "CLIMB AT 1500 ft/min MINIMUM", {"value": 1500}),
        ("uplink", [(26, 8)], "CLIMB TO REACH [altitude] BY [time]", None),
        ("uplink", [(81, 8), (2, 2), "1", (3, 3), _letters("DEP1"), (1, 3), _letters("AB")], "CLEARED DEP1.AB", {"type": "departure", "name": "DEP1", "transition": "AB"}),
        ("uplink", [(80, 8), "1110000100", _letters("KLAXKSFO"), (24, 6), "00", (2, 3), _letters("J501")], "CLEARED [DEP:KLAX DEST:KSFO RWY:25L AWY:J501]", None),
        ("uplink", [(110, 8), "110", (18, 5), "110", (21, 5)], "MAINTAIN M.79 TO M.82", {"speed1": {"type": "mach", "value": 79}, "speed2": {"type": "mach", "value": 82}}),
        ("downlink", [(57, 8), (3, 7), (20, 6), (241, 10)], "3h20m OF FUEL REMAINING AND 241 SOULS ON BOARD", {"remaining_fuel": {"hours": 3, "minutes": 20}, "persons_on_board": {"count": 241}}),
        ("downlink", [(62, 8), (1, 3)], "ERROR logon data not accepted", {"code": 1, "description": "logon data not accepted"}),
        ("downlink", [(78, 8), (12, 5), (30, 6), (0, 6), "0", (120, 14), "1", "000", (4, 3), _letters("DOTTY")], "AT 12:30:00 120 nm from DOTTY", None),
        ("downlink", [(31, 8), "100", "0", (4, 3), _letters("DOTTY"), "0", (89, 9), "0", (25, 14)], "PASSING DOTTY 090/25nm", {"type": "place_bearing_distance", "name": "DOTTY", "bearing": 90, "distance": 25, "distance_unit": "nm"}),
        ("downlink", [(48, 8), "1000100000", "000", (4, 3), _letters("DOTTY"), (1, 5), (2, 6), (3, 6), *FL350], "POSITION REPORT DOTTY at 01:02:03 FL350", None),
        ("downlink", [(100, 8)], "(reserved)", None),
    ],
)
def test_elements(way, fields, text, data):
    from aerolith.decoders import controller

    found = controller.message(_packed(HEADER, *fields), way)
    assert found["formatted_text"] == text and found["header"] == {"msg_id": 9}
    assert data is None or found["elements"][0]["data"] == data


def test_elements_out_of_range_or_short():
    from aerolith.decoders import controller

    for sample, way in ((_packed(HEADER, (183, 8)), "uplink"), (_packed(HEADER, (129, 8)), "downlink"), (_packed(HEADER, (20, 8)), "uplink"), (b"", "uplink")):
        with pytest.raises(ValueError):
            controller.message(sample, way)
    assert len(controller.UPLINK) == 183 and len(controller.DOWNLINK) == 81


def test_airport_codes(spark):
    from pyspark.sql import functions as F

    from aerolith.functions import codes

    assert len(codes.NOT_AIRPORTS) == 105 and len(codes.PREFIXES) == 273
    rows = spark.createDataFrame([(c,) for c in ("KJFK", "EGLL", "TIME", "GJWO", "EGGX", "kjfk", "KJF", "KJFKX", "", None)], "c string")
    assert [r.v for r in rows.select(codes.valid(F.col("c")).alias("v")).collect()] == [True, True, *[False] * 8]


def test_free_text(spark):
    from pyspark.sql import functions as F

    from aerolith.functions import codes

    cases = [
        ("PDC 123 ASA329 B738 KSEA CLRD TO KORD VIA HAROB6 SQUAWK 3670 DEP FREQ 123.75 CLIMB VIA SID TO 5000", {"flight_number": "ASA329", "destination": "KORD", "sid": "HAROB6", "squawk": "3670", "frequency": "123.75", "altitude": "5000"}),
        ("FLT 329 DEPART KSEA ARR KPDX RWY 16L ATIS C EXP 350 10 MIN", {"flight_number": "329", "origin": "KSEA", "destination": "KPDX", "runway": "16L", "atis": "C", "flight_level": "FL350"}),
        ("ROUTE KORD-KJFK SANEG TWO DEP B738/L", {"origin": "KORD", "destination": "KJFK", "sid": "SANEG2", "aircraft_type": "B738"}),
        ("A32AD8 8C3323 nothing here", {"flight_number": None, "origin": None, "destination": None}),
        ("", {"flight_number": None}),
    ]
    made = codes.free_text(F.col("t"))
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string").select("i", *[c.alias(n) for n, c in made.items()]).orderBy("i").collect()
    for r, (_, expected) in zip(rows, cases):
        assert {k: r[k] for k in expected} == expected


def test_route_points(spark):
    from pyspark.sql import functions as F

    from aerolith.decoders.clearances import route_waypoints

    text = "PDC 291826\nB738/L P1830\n310\nHAROB6 ZIZZI MERIT\nDIXIE\nCLEARED HAROB6 DEPARTURE\nLOST\nROUTE: DCT WOL H65 LEECE\nBOOIN\nCLIMB VIA SID\nSQUAWK 3670 ABC"
    rows = spark.createDataFrame([(0, text), (1, "SQUAWK 3670"), (2, None), (3, "ROUTE " + "WOL LEECE\n" * 20_000)], "i long, t string").select("i", route_waypoints(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == [["HAROB6", "ZIZZI", "MERIT", "DIXIE", "WOL", "LEECE", "BOOIN"], None, None, ["WOL", "LEECE"]]


def test_points_of_any_shape(spark):
    from aerolith.operators import extract

    records = [(1, '{"waypoints": [{"name": "A", "latitude": 1, "longitude": 2}, null, {"name": "B"}]}'), (2, '{"waypoints":{"name":"C","latitude":1.5,"longitude":2}}'), (3, json.dumps({"waypoints": json.dumps([{"name": "D", "latitude": 1, "longitude": 2}])})), (4, '{"waypoint":"E","latitude":3,"longitude":4}'), (5, "broken"), (6, None)]
    found = extract.waypoint_updates(spark.createDataFrame(records, "delivery_id long, parsed_json string")).collect()
    assert sorted(r.name for r in found) == ["A", "C", "D", "E"]
