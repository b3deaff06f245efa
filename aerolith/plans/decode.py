"""Decoding queries: messages written from the keys of lineitem, decoded, and their SQL computed from the same keys.

Each query writes one message a row of lineitem as text, so that every decoder runs over a whole
table; the SQL never sees the text. Queries over the message log itself follow.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.decoders import EVERY, registry
from aerolith.decoders.binary import decode_binary, dispatch_every
from aerolith.decoders.engine import decode, explain
from aerolith.sources.ingest import reparse_diff
from aerolith.sources.tables import spread, table

BY_NAME = {d.name: d for d in EVERY}
# Numbers from the keys: degrees, minutes and tenths of a latitude, degrees and minutes of a longitude, sides, a level and an hour with minutes.
KEYS = {
    "a": "l_orderkey % 90", "b": "l_partkey % 60", "c": "l_suppkey % 10", "e": "l_partkey % 180", "f": "l_orderkey % 60", "s": "l_linenumber % 2", "w": "l_suppkey % 2", "n": "100 + l_orderkey % 400", "h": "l_partkey % 24", "m": "l_orderkey % 60", "g": "100 + l_suppkey % 400",
}
LAT = "CASE WHEN s = 0 THEN 'N' ELSE 'S' END"
LON = "CASE WHEN w = 0 THEN 'E' ELSE 'W' END"
D2 = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
D3 = lambda x: f"lpad(CAST({x} AS STRING), 3, '0')"
D4 = lambda x: f"lpad(CAST({x} AS STRING), 4, '0')"
SIDE = {"lat": "(CASE WHEN s = 0 THEN 1 ELSE -1 END)", "lon": "(CASE WHEN w = 0 THEN 1 ELSE -1 END)"}
TENTHS = (f"(a + (b + c / 10.0::DOUBLE) / 60.0::DOUBLE) * {SIDE['lat']}", f"(e + (f + c / 10.0::DOUBLE) / 60.0::DOUBLE) * {SIDE['lon']}")
PLAIN = (f"(a + b / 100.0::DOUBLE) * {SIDE['lat']}", f"(e + f / 100.0::DOUBLE) * {SIDE['lon']}")
P_LAT, P_LON = f"CAST(a AS STRING) || '.' || {D2('b')}", f"CAST(e AS STRING) || '.' || {D2('f')}"

# name: (decoder, label, the text as Spark SQL, {field: the value as the other engine's SQL})
# Each: decoder, label, the text, and the columns with their SQL; lists are compared as text, by a pair of expressions over the record and over the keys.
SPECS: dict[str, tuple[str, str, str, dict[str, str | tuple[str, str]]]] = {
    "decode_sq": (
        "sq", "SQ", f"'02XAORDKORD0' || {D2('a')} || {D2('b')} || {LAT} || {D3('e')} || {D2('f')} || {LON} || 'V136' || {D3('n')} || '/ARINC'",
        {"icao_code": "'KORD'", "latitude": f"(a + b / 60.0::DOUBLE) * {SIDE['lat']}", "longitude": f"(e + f / 60.0::DOUBLE) * {SIDE['lon']}", "freq_mhz": "(136000 + n) / 1000.0::DOUBLE"},
    ),
    "decode_label10": (
        "label10", "10", f"'/' || {LAT} || {P_LAT} || '/' || {LON} || {P_LON} || '/10/0.72/' || {D3('n')} || '/' || {D3('g')} || '/KISM/' || {D2('h')} || {D2('m')} || '/0064/00015/ZIZZI/TBONN/1831'",
        {"latitude": PLAIN[0], "longitude": PLAIN[1], "mach": "0.72::DOUBLE", "heading": "n", "flight_level": "g", "destination": "'KISM'", "eta": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0')", "fuel": "64", "distance": "15", "points": ('to_json(waypoints)', '\'[{"name":"ZIZZI"},{"name":"TBONN","eta":"1831"}]\'')},
    ),
    "decode_label16": (
        "label16", "16", f"{D2('h')} || {D2('m')} || '00,' || CAST(g * 100 AS STRING) || ',' || CAST(n AS STRING) || ',' || CAST(e AS STRING) || ',' || {LAT} || ' 1' || {P_LAT} || ',' || {LON} || {P_LON}",
        {"time": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || '00'", "latitude": f"(10::DOUBLE ** length(CAST(a AS VARCHAR)) + a + b / 100.0::DOUBLE) * {SIDE['lat']}", "longitude": PLAIN[1], "flight_level": "g", "ground_speed": "n", "track": "nullif(e, 0)"},
    ),
    "decode_label21": (
        "label21", "21", f"'POSN ' || {P_LAT} || {LON} || {P_LON} || ', ' || CAST(n AS STRING) || ',1234,' || CAST(g * 100 AS STRING) || ',120, 270 55, -45,1730,KSFO'",
        {"latitude": "a + b / 100.0::DOUBLE", "longitude": PLAIN[1], "heading": "n", "altitude": "g * 100", "fuel_on_board": "120", "wind": "'270 55'", "temperature": "'-45'", "destination": "'KSFO'"},
    ),
    "decode_label22": (
        "label22", "22", f"{LAT} || ' ' || {D2('a')} || {D2('b')} || {D2('f')} || {LON} || ' ' || {D3('e')} || {D2('f')} || {D2('b')} || ',-------,' || {D2('h')} || {D2('m')} || '36,' || CAST(g * 10 AS STRING) || ', ,      , ,M  3,' || {D3('g')} || '02  ,64,'",
        {"latitude": f"(a + b / 60.0::DOUBLE + f / 3600.0::DOUBLE) * {SIDE['lat']}", "longitude": f"(e + f / 60.0::DOUBLE + b / 3600.0::DOUBLE) * {SIDE['lon']}", "altitude": "g * 10", "mach": "0.83::DOUBLE", "flight_level": "g", "ground_speed": "64"},
    ),
    "decode_label4j": (
        "label4j", "4J", f"'POS/PSN' || {D2('a')} || {D2('b')} || c || {LON} || {D3('e')} || {D2('f')} || c || ',182901,' || {D3('n')} || ',ZIZZI,1830,TBONN,M45,' || CAST(g AS STRING) || '/FB' || {D4('n')}",
        {"latitude": "(a + (b + c / 10.0::DOUBLE) / 60.0::DOUBLE)", "longitude": TENTHS[1], "heading": "n", "altitude": "g", "temperature": "'M45'", "current_waypoint": "'ZIZZI'", "next_waypoint": "'TBONN'", "fuel_burn": "n"},
    ),
    "decode_label5l": (
        "label5l", "5L", f"'QFA' || CAST(n AS STRING) || ',VH-' || CAST(g AS STRING) || ',SYD,YSSY,' || CASE WHEN s = 0 THEN '---' ELSE 'LHR' END || ',EGLL,Q' || CAST(n AS STRING) || ',0101,' || {D2('h')} || {D2('m')}",
        {"callsign": "'QFA' || n", "tail": "'VH-' || g", "origin_iata": "'SYD'", "dest_iata": "CASE WHEN s = 0 THEN NULL ELSE 'LHR' END", "dest_icao": "'EGLL'", "flight_id": "'Q' || n", "dep_sched": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0')"},
    ),
    "decode_label80": (
        "label80", "80", f"'3N01 POSRPT 0581/27 KIAH/MSLP .N' || CAST(n AS STRING) || '\\n/POS ' || {LAT} || {P_LAT} || {LON} || {P_LON} || '/ALT +' || CAST(g * 100 AS STRING) || '/MCH ' || CAST(n AS STRING) || '/FOB N' || {D4('g')} || '/ETA ' || {D2('h')} || {D2('m')}",
        {"origin_icao": "'KIAH'", "dest_icao": "'MSLP'", "tail": "'N' || n", "latitude": f"nullif({PLAIN[0]}, 0)", "longitude": f"nullif({PLAIN[1]}, 0)", "altitude": "g * 100", "mach": "CAST(n AS VARCHAR)", "fuel_on_board": "g", "eta": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0')"},
    ),
    "decode_label83": (
        "label83", "83", f"'001PR' || {D2('1 + c')} || '182901' || {LAT} || {D2('a')} || {D2('b')} || '.' || c || {LON} || {D3('e')} || {D2('f')} || '.' || c || '0' || {D3('g')} || '00'",
        {"message_type": "'PR'", "day_of_month": "1 + c", "report_time": "'182901'", "latitude": TENTHS[0], "longitude": TENTHS[1], "altitude": "g * 100"},
    ),
    "decode_labelb2": (
        "labelb2", "B2", f"'QFA' || CAST(n AS STRING) || ' CLRD TO KLAX VIA ' || {D2('a')} || 'S' || {D3('e')} || 'W F' || {D3('g')} || ' M084'",
        {"flight_num": "'QFA' || n", "destination": "'KLAX'", "flight_level": "'FL' || g", "mach": "'M84'", "fixes": ("array_join(oceanic_fixes, ';')", "lpad(CAST(a AS VARCHAR), 2, '0') || 'S' || lpad(CAST(e AS VARCHAR), 3, '0') || 'W'")},
    ),
    "decode_labelb3": (
        "labelb3", "B3", "'UAL' || CAST(n AS STRING) || '-KSFO-GATE B' || CAST(h AS STRING) || '-KLAX ATIS C -TYP/B' || CAST(g AS STRING)",
        {"flight_num": "'UAL' || n", "origin": "'KSFO'", "destination": "'KLAX'", "gate": "'B' || h", "atis": "'C'", "aircraft_type": "'B' || g"},
    ),
    "decode_labelrf": (
        "labelrf", "RF", f"',FDASUB01,SYD,,' || CASE WHEN s = 0 THEN 'LAX' ELSE 'QQQ' END || ',,QFA' || CAST(n AS STRING) || ',260101,' || {D2('h')} || {D2('m')} || ',A388,,VH-OQA,'",
        {"msg_type": "'FDASUB'", "origin_icao": "'YSSY'", "dest_icao": "CASE WHEN s = 0 THEN 'KLAX' END", "flight_num": "'QFA' || n", "time": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0')"},
    ),
    "decode_agfsr": (
        "agfsr", "4T", f"'AGFSR AC0620/' || {D2('1 + c')} || '/26/YYZFLL/1756Z/830/' || {D2('a')} || {D2('b')} || '.' || c || {LAT} || {D3('e')} || {D2('f')} || '.' || c || {LON} || '/' || {D3('g')} || '/CRUISE/' || {D4('n')} || '/0071/M37/' || {D3('n')} || '095/0300/202/----/----/****'",
        {"origin": "'YYZ'", "destination": "'FLL'", "day_of_month": "1 + c", "latitude": f"nullif({TENTHS[0]}, 0)", "longitude": f"nullif({TENTHS[1]}, 0)", "flight_level": "g", "fuel_remain": "n", "mach": "1.17::DOUBLE", "wind_dir": "n", "ground_speed": "202", "unknown2": "'----'", "eta": "CAST(NULL AS VARCHAR)"},
    ),
    "decode_fst": (
        "fst", "15", f"'FST01EGLCEIDW' || {LAT} || {D2('a')} || {D2('b')} || c || {LON} || {D2('a')} || {D2('f')} || c || {D3('g')} || 'M020C080301'",
        {"origin": "'EGLC'", "latitude": f"nullif({TENTHS[0]}, 0)", "longitude": f"nullif((a + (f + c / 10.0::DOUBLE) / 60.0::DOUBLE) * {SIDE['lon']}, 0)", "flight_level": "g", "temperature": "-20"},
    ),
    "decode_eta": (
        "eta", "5Z", f"'/ET EXP TIME       / KSNA KIAH ' || {D2('1 + c')} || ' 182901/EON ' || {D2('h')} || {D2('m')} || ' AUTO'",
        {"message_type": "'ET'", "origin": "'KSNA'", "destination": "'KIAH'", "day_of_month": "1 + c", "eta": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0')", "mode": "'AUTO'"},
    ),
    "decode_h1pos": (
        "h1pos", "H1", f"'POS' || {LAT} || {D2('a')} || {D2('b')} || c || {LON} || {D3('e')} || {D2('f')} || c || ',ZIZZI,182901,' || CAST(g AS STRING) || ',TBONN,1830,ABCDE,M' || {D2('b')} || ',' || {D3('n')} || '55'",
        {"latitude": TENTHS[0], "longitude": TENTHS[1], "report_time": "'182901'", "flight_level": "g", "temperature": "nullif(-b, 0)", "wind_dir": "n", "wind_speed": "55", "third_waypoint": "'ABCDE'"},
    ),
    "decode_h2wind": (
        "h2wind", "H2", f"'02A291829EDDKLSZH' || {LAT} || {D2('a')} || {D2('b')} || c || {LON} || {D3('e')} || {D2('f')} || c || '291829 ' || {D3('g')} || 'M05 ' || {D3('n')} || 'P02'",
        {"origin": "'EDDK'", "destination": "'LSZH'", "latitude": f"nullif({TENTHS[0]}, 0)", "longitude": f"nullif({TENTHS[1]}, 0)", "report_time": "'291829'", "layers": ('to_json(wind_layers)', '\'[{"flight_level":\' || g || \',"temperature":-5,"gusting":false},{"flight_level":\' || n || \',"temperature":2,"gusting":false}]\'')},
    ),
    "decode_mediaadv": (
        "mediaadv", "SA", f"'0' || CASE WHEN s = 0 THEN 'E' ELSE 'L' END || 'S' || {D2('h')} || {D2('m')} || {D2('b')} || 'V2/TEXT ' || CAST(n AS STRING)",
        {"established": "s = 0", "link_time": "lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ':' || lpad(CAST(b AS VARCHAR), 2, '0')", "text": "'TEXT ' || n"},
    ),
    "decode_gate": ("gateassign", "RA", "'PLEASE NOTE\\nGATE ASSIGNMENT: B' || CAST(n AS STRING)", {"gate": "'B' || n"}),
    "decode_fpn": (
        "fpn", "H1", f"'FPN/SN' || CAST(n AS STRING) || '/FNAAL' || CAST(n AS STRING) || ':DA:KJFK:AA:KLAX:D:VUM' || c || '.GUKEB:A:VES7.VED:F:MERIT,N' || {D2('a')} || {D2('b')} || c || 'W' || {D3('e')} || {D2('f')} || c || '..DIXIE:AP:ILS' || {D2('h')} || 'L/ZE'",
        {"flight_num": "'AAL' || n", "origin": "'KJFK'", "destination": "'KLAX'", "departure": "'VUM' || c", "departure_transition": "'GUKEB'", "arrival": "'VES7'", "arrival_transition": "'VED'", "approach_type": "'ILS'", "approach_runway": "lpad(CAST(h AS VARCHAR), 2, '0') || 'L'", "truncated": "CAST(NULL AS BOOLEAN)", "points": ("array_join(transform(waypoints, w -> concat_ws('/', w.name, if(w.latitude IS NULL, NULL, format_string('%.4f', abs(w.latitude))), if(w.longitude IS NULL, NULL, format_string('%.4f', abs(w.longitude))))), ';')", "'MERIT/' || CASE WHEN a + b + c = 0 THEN '' ELSE printf('%.4f', a + (b + c / 10.0::DOUBLE) / 60.0::DOUBLE) || '/' END || CASE WHEN e + f + c = 0 THEN '' ELSE printf('%.4f', e + (f + c / 10.0::DOUBLE) / 60.0::DOUBLE) END || ';DIXIE'")},
    ),
    "decode_pwi": ("pwi", "H1", f"'PWI/TS' || {D2('h')} || {D2('m')} || '00,050625/CB' || {D3('g')} || {D3('n')} || '026/WD370,MERIT,270050,350M52.DIXIE,271051,350M53'", {"report_time": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || '00'", "climb_winds": ('to_json(climb_winds)', '\'[{"flight_level":\' || g || \',"wind_dir":\' || n || \',"wind_speed":26}]\''), "route_winds": ('to_json(route_winds)', '\'[{"flight_level":370,"waypoints":[{"waypoint":"MERIT","wind_dir":270,"wind_speed":50,"temperature":-52},{"waypoint":"DIXIE","wind_dir":271,"wind_speed":51,"temperature":-53}]}]\'')}),
    "decode_trajectory": (
        "trajectory", "H1", f"'++86501,N' || CAST(n AS STRING) || ',B7377,261125,WN' || {D4('g')} || ',KDAL,KHOU,' || CAST(g AS STRING) || ',TS-1\nN' || {D2('a')} || {D2('b')} || '.' || c || ',W' || {D3('e')} || {D2('f')} || '.' || c || ',120918,39000,-64.3,256,037,CL,00000,0,\n'",
        {"registration": "'N' || n", "aircraft_type": "'B7377'", "flight_number": "'WN' || lpad(CAST(g AS VARCHAR), 4, '0')", "origin": "'KDAL'", "destination": "'KHOU'", "distance": "g", "system_id": "'TS-1'", "places": ("array_join(transform(positions, p -> concat_ws('/', format_string('%.4f', abs(p.latitude)), format_string('%.4f', abs(p.longitude)), p.time, p.altitude, p.temperature, p.heading, p.speed, p.phase)), ';')", "printf('%.4f', a + (b + c / 10.0::DOUBLE) / 60.0::DOUBLE) || '/' || printf('%.4f', e + (f + c / 10.0::DOUBLE) / 60.0::DOUBLE) || '/120918/39000/-64.3/256/37/CL'")},
    ),
    "decode_mdc": ("mdc", "H1", f"'MDC REPORT: FAULT HISTORY\nTIME: ' || {D2('h')} || ':' || {D2('m')} || '\nLEG: ' || CAST(n AS STRING) || '\nATA46-22 NAV SENSOR\n'", {"report_type": "'FAULT HISTORY'", "time": "lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0')", "leg_number": "CAST(n AS VARCHAR)", "faults": ('to_json(faults)', '\'[{"ata":"46-22","system":"NAV SENSOR"}]\'')}),
    "decode_delay": (
        "delay", "3E", f"'DELAY SUMMARY\nAY' || CAST(n AS STRING) || '/26NOV2025 HEL-CDG\nSTD ' || {D2('h')} || ':' || {D2('m')} || ' ATD 10:13 DEP DELAY ' || CAST(b AS STRING) || ' MIN\nARR DELAY ' || CAST(f AS STRING) || ' MIN\nDL93/' || CAST(b AS STRING) || 'MIN'",
        {"flight_number": "'AY' || n", "flight_date": "'26NOV2025'", "origin": "'HEL'", "destination": "'CDG'", "std": "lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(m AS VARCHAR), 2, '0')", "atd": "'10:13'", "dep_delay_minutes": "b", "arr_delay_minutes": "f", "delay_codes": ('to_json(delay_codes)', '\'[{"code":"DL93"\' || \',"minutes":\' || b || \'}]\'')},
    ),
    "decode_crew": ("crew", "RA", "'CREW LIST UA' || CAST(n AS STRING) || '/26 KSFO KLAX.\nCA SMITH JOHN \n U' || CAST(g AS STRING) || '\nFA MIN: ' || CAST(1 + c AS STRING)", {"flight_number": "'UA' || n", "flight_date": "'26'", "origin": "'KSFO'", "destination": "'KLAX'", "min_crew": "1 + c", "crew": ('to_json(cockpit_crew)', '\'[{"position":"CA","name":"SMITH JOHN","employee_id":"U\' || g || \'"}]\'')}),
    "decode_dispatch": (
        "dispatch", "RA", "'DISPATCHER MSG\nASA' || CAST(n AS STRING) || ' N' || CAST(g AS STRING) || 'AS\n' || CASE WHEN s = 0 THEN 'MIN TO FUEL' ELSE 'SIGMET A' || c END",
        {"flight_number": "'ASA' || n", "tail": "'N' || g || 'AS'", "ack_required": "false", "category": "CASE WHEN s = 0 THEN 'FUEL' ELSE 'SIGMET' END", "mel_ref": "CAST(NULL AS VARCHAR)"},
    ),
    "decode_fuel": (
        "fuel", "3E", "'FUEL DELIVERY AY' || CAST(n AS STRING) || ' OH-LVA 26.11.2025 DEST: LHR AMOUNT: ' || CAST(n * 10 AS STRING) || ' LTRS DENSITY: ' || CAST(g AS STRING) || ' KG/M3 QTY BEFORE (KG): ' || CAST(n AS STRING) || ' KG'",
        {"flight_number": "'AY' || n", "tail": "'OH-LVA'", "date": "'26.11.2025'", "destination": "'LHR'", "amount_litres": "n * 10", "density_kg_m3": "g", "qty_before_kg": "n"},
    ),
    "decode_hazard": (
        "hazard", "H1", f"'HAZARD ALERT FOR KFE' || CAST(n AS STRING) || ' F' || c || ': LMML-LSGG (' || {D2('h')} || {D2('m')} || 'Z ETD) ' || CASE WHEN s = 0 THEN 'EDR TURBULENCE IS 0.5 EDR' ELSE 'WARNING: WINDS IS ' || CAST(g AS STRING) END",
        {"callsign": "'KFE' || n", "flight_id": "'F' || c", "origin": "'LMML'", "destination": "'LSGG'", "etd": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || 'Z'", "alert_level": "CASE WHEN s = 0 THEN 'CRITICAL' ELSE 'WARNING' END", "wind_warning": "CASE WHEN s = 1 THEN g || ' knots' END"},
    ),
    "decode_parking": ("parking", "1E", "'PKG INFO MSG ESCALE CDG PARKING AVION: K' || CAST(n AS STRING) || ' TAPIS A BAGAGES : ' || CAST(g AS STRING) || 'E'", {"airport": "'CDG'", "parking_stand": "'K' || n", "baggage_carousel": "g || 'E'"}),
    "decode_paxbag": (
        "paxbag", "RA", f"'PAX AND BAG DETAILS\nAY' || CAST(n AS STRING) || ' 26NOV HEL STD' || {D2('h')} || {D2('m')} || ' BOARD 0930 GATE ' || CAST(g AS STRING) || '\nTOTAL PASSENGERS ' || CAST(n AS STRING) || ' PLUS INFANTS ' || c || CASE WHEN s = 0 THEN ' NOT FINALISED' ELSE '' END",
        {"flight_number": "'AY' || n", "origin": "'HEL'", "std": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0')", "gate": "CAST(g AS VARCHAR)", "total_pax": "n", "infants": "nullif(c, 0)", "is_finalised": "s = 1"},
    ),
    "decode_paxconn": (
        "paxconn", "3E", f"'PAX CONN STATUS\nAB' || CAST(n AS STRING) || ' 26112025 10:00 LHR\nPENDING Y ' || CAST(b AS STRING) || ' 3\n' || repeat('-', 32) || '\nAB124 26112025 11:00 CDG\nWILLWAIT Y ' || CAST(f AS STRING) || ' 1'",
        {"missed_count": "0", "pending_count": "b", "will_wait_count": "f", "total_connecting": "b + f", "connections": ("array_join(transform(connections, x -> concat_ws('/', x.flight_number, x.date, x.time, x.destination, x.decision, x.class, x.passengers, x.bags)), ';')", "'AB' || n || '/26112025/10:00/LHR/PENDING/Y/' || b || '/3;AB124/26112025/11:00/CDG/WILLWAIT/Y/' || f || '/1'")},
    ),
    "decode_takeoff": ("takeoff", "RA", "'TAKEOFF DATA GTOW / CG PAX\n ' || CAST(g AS STRING) || '.3/25.1 ' || CAST(n AS STRING) || '\nT/O KPDX 10R'", {"gtow": "g + 0.3::DOUBLE", "cg": "25.1::DOUBLE", "pax": "n", "runways": ('to_json(runways)', '\'[{"airport":"KPDX","runway":"10R"}]\'')}),
    "decode_landing": (
        "landingdata", "C1", f"'LANDING DATA DEN RW ' || {D2('h')} || 'L ' || CAST(g * 10 AS STRING) || ' FT TEMP M' || {D2('b')} || 'C ALT 30.01 WIND ' || {D3('n')} || '/12 MAG'",
        {"airport": "'DEN'", "runway": "lpad(CAST(h AS VARCHAR), 2, '0') || 'L'", "runway_length": "g * 10", "temperature": "nullif(-b, 0)", "altimeter": "30.01::DOUBLE", "wind": "lpad(CAST(n AS VARCHAR), 3, '0') || '/12'"},
    ),
    "decode_turbulence": (
        "turbulence", "C1", f"'TURB ADVISORY ID: ' || CAST(n AS STRING) || ' \nSEVERITY: MOD\nALT: FL' || {D3('g')} || '-FL' || {D3('n')} || '\nVALID: 26' || {D2('h')} || {D2('m')} || 'Z-261600Z'",
        {"id": "CAST(n AS VARCHAR)", "severity": "'MOD'", "altitude_low": "'FL' || g", "altitude_hi": "'FL' || n", "valid_from": "'26' || lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || 'Z'", "valid_to": "'261600Z'"},
    ),
    "decode_pdc": (
        "pdc", "RA", f"'PDC ' || CAST(100000 + n AS STRING) || '\nJST' || CAST(n AS STRING) || ' A320 YSSY ' || {D2('h')} || {D2('m')} || '\nCLEARED TO YMML VIA\n16L ABBEY' || c || ' DEP WOL:TRAN\nROUTE: DCT WOL H65 RAZZI Q29 BOOIN DCT\nCLIMB VIA SID TO: 5000\nDEP FREQ: 123.' || {D3('n')} || '\nSQUAWK 36' || lpad(conv(CAST(f AS STRING), 10, 8), 2, '0')",
        {"flight_number": "'JST' || n", "origin": "'YSSY'", "destination": "'YMML'", "departure_time": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0')", "runway": "'16L'", "sid": "'ABBEY' || c", "departure_freq": "'123.' || n", "initial_altitude": "'5000'", "route": "'DCT WOL H65 RAZZI Q29 BOOIN DCT'", "squawk": "'36' || (f // 8) || (f % 8)", "pdc_format": "'australian'", "points": ("array_join(route_waypoints, ' ')", "'WOL RAZZI BOOIN'")},
    ),
    "decode_loadsheet": (
        "loadsheet", "C1", f"'LOADSHEET FINAL ' || {D2('h')} || {D2('m')} || ' EDNO' || c || '\nLX' || CAST(n AS STRING) || '/26 26NOV25\nZRH LHR HB-JCA 2/4\nZFW ' || CAST(39000 + n AS STRING) || ' MAX 50000\nTOF ' || CAST(g * 10 AS STRING) || '\nTOW ' || CAST(44000 + n AS STRING) || ' MAX 60000\n' || CASE WHEN s = 0 THEN 'TIF 2000\nLAW 42554 MAX 52000\nPAX/10/55 TTL ' || CAST(n AS STRING) ELSE '' END",
        {"format_name": "CASE WHEN s = 0 THEN 'standard_kg' ELSE 'standard_kg_minimal' END", "status": "'FINAL'", "flight": "'LX' || n", "tail": "'HB-JCA'", "crew": "'2/4'", "edition": "CAST(c AS VARCHAR)", "zfw": "39000 + n", "zfw_max": "50000", "tof": "g * 10", "tow": "44000 + n", "tif": "CASE WHEN s = 0 THEN 2000 END", "law": "CASE WHEN s = 0 THEN 42554 END", "pax": "CASE WHEN s = 0 THEN n END"},
    ),
    "decode_atis": (
        "atis", "A9", f"'/HKGATYA.TI2/VHHH ARR ATIS G\n' || {D2('h')} || {D2('m')} || 'Z WIND ' || {D3('n')} || '/10KT VIS 10KM CLD FEW 2000FT T ' || CASE WHEN s = 0 THEN 'MS ' ELSE '' END || {D2('c')} || ' DP 20 QNH ' || CAST(1000 + c AS STRING) || 'HPA RWY 07C ILS APCH.'",
        {"airport": "'VHHH'", "atis_letter": "'G'", "atis_type": "'ARR'", "atis_time": "lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || 'Z'", "wind": "n || '/10KT'", "visibility": "'10KM'", "temperature": "CASE WHEN s = 0 THEN '-' ELSE '' END || lpad(CAST(c AS VARCHAR), 2, '0')", "dew_point": "'20'", "qnh": "CAST(1000 + c AS VARCHAR)", "runways": ('to_json(runways)', '\'["07C"]\''), "approaches": ('to_json(approaches)', '\'["ILS APCH"]\'')},
    ),
    "decode_label44": (
        "label44", "44",
        f"CASE WHEN s = 0 THEN 'YSSY T/O RWYS,16 ' || CAST(1001 + n * 10 AS STRING) || '\n34/AA  X  ' || CAST(1000 + n AS STRING) || '\n  NOTAM ' || CAST(g AS STRING) || '\n07  ' || CAST(1000 + g AS STRING) WHEN w = 0 THEN '/FB 0' || c || '/AD YSSY/' || {LAT} || ' ' || {P_LAT} || ',W ' || {P_LON} || ',QFA' || CAST(n AS STRING) || ',INA0' || c || ',YMML,' || {D2('h')} || {D2('m')} ELSE 'POS01,S' || {D2('a')} || {D2('b')} || c || 'E' || {D3('e')} || {D2('f')} || c || ',' || {D3('g')} || ',YSSY,YMML,' || {D2('h')} || {D2('m')} || ',1530' END",
        {
            "message_type": "CASE WHEN s = 0 THEN 'runway' WHEN w = 0 THEN 'fb' ELSE 'pos' END", "airport": "CASE WHEN s = 0 OR w = 0 THEN 'YSSY' END", "flight_level": "CASE WHEN s = 1 AND w = 1 THEN g END", "origin": "CASE WHEN s = 1 AND w = 1 THEN 'YSSY' END", "destination": "CASE WHEN s = 1 THEN 'YMML' END",
            "callsign": "CASE WHEN s = 1 AND w = 0 THEN 'QFA' || n END", "raw_data": "CASE WHEN s = 1 AND w = 0 THEN 'INA0' || c END", "report_time": "CASE WHEN s = 1 THEN lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') END",
            "latitude": "CASE WHEN s = 1 THEN nullif(CASE WHEN w = 0 THEN -(a + b / 100.0::DOUBLE) ELSE -(a + (b + c / 10.0::DOUBLE) / 60.0::DOUBLE) END, 0) END", "longitude": "CASE WHEN s = 1 THEN nullif(CASE WHEN w = 0 THEN -(e + f / 100.0::DOUBLE) ELSE e + (f + c / 10.0::DOUBLE) / 60.0::DOUBLE END, 0) END",
            "runways": ("to_json(runways)", "CASE WHEN s = 0 THEN '[{\"runway\":\"16\",\"distance\":' || (1001 + n * 10) || '},{\"runway\":\"34\",\"suffix\":\"AA\",\"distance\":' || (1000 + n) || '},{\"runway\":\"07\",\"distance\":' || (1000 + g) || '}]' END"), "procedures": ("array_join(procedures, ';')", "CASE WHEN s = 0 THEN 'NOTAM ' || g END"),
        },
    ),
}


def written(spark: SparkSession, d: str, text: str, label: str) -> DataFrame:
    keys = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in KEYS.items()])
    return spread(keys).select("l_orderkey", "l_linenumber", F.lit(label).alias("label"), F.expr(text).alias("raw_text"))


def _query(name: str):
    decoder, label, text, fields = SPECS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = decode(written(spark, d, text, label), BY_NAME[decoder], keep=("l_orderkey", "l_linenumber"))
        kinds = dict(rows.dtypes)
        shown = [F.expr(e[0]).alias(n) if isinstance(e, tuple) else F.round(n, 6).alias(n) if kinds[n] == "double" else F.col(n) for n, e in fields.items()]
        return rows.select("l_orderkey", "l_linenumber", *shown)

    return run


def _sql(name: str) -> str:
    fields = SPECS[name][3]
    keys = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in KEYS.items())
    typed = lambda e: f"CAST({e} AS BIGINT)" if re.fullmatch(r"-?\d+|CASE WHEN s = 0 THEN \d+ END", e) else e
    fields = {n: e[1] if isinstance(e, tuple) else e for n, e in fields.items()}
    shown = ", ".join(f"round({e}, 6) + 0.0::DOUBLE AS {n}" if "::DOUBLE" in e and "printf" not in e else f"{typed(e)} AS {n}" for n, e in fields.items())
    kept = " WHERE e + f + a + b + c > 0" if name == "decode_label4j" else ""
    return f"SELECT l_orderkey, l_linenumber, {shown} FROM (SELECT l_orderkey, l_linenumber, {keys} FROM lineitem){kept}"


def dispatch_all(spark: SparkSession, d: str) -> DataFrame:
    return dispatch_every(spread(table(spark, d, "messages").select("delivery_id", "label", "raw_text")), registry("all"))


def dispatch_first(spark: SparkSession, d: str) -> DataFrame:
    return dispatch_every(spread(table(spark, d, "messages").select("delivery_id", "label", "raw_text")), registry("all"), first=True)


def _surveillance(spark: SparkSession, d: str) -> DataFrame:
    """Basic surveillance reports with their checksum, written from the keys."""
    from aerolith.functions.crc import crc16, hex_bytes, text_bytes

    keys = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in KEYS.items()])
    field = lambda e, width: F.lpad(F.bin(F.expr(e)), width, "0")
    plain = F.concat(field("a * 5000", 21), field("e * 5000", 21), field("g * 50", 16), field("n * 8", 15), F.lit("0001011"))
    digits = F.concat(F.lit("07"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lpad(F.conv(F.substr(plain, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))
    head = F.lit("ADS.G-ZBKO")
    check = F.lpad(F.hex(crc16(F.concat(text_bytes(head), hex_bytes(digits))).bitwiseXOR(0xFFFF)), 4, "0")
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return keys.select(key.alias("delivery_id"), F.lit("B6").alias("label"), F.concat(F.lit("/QUKAXBA."), head, digits, check).alias("raw_text"))


def decode_adsc(spark: SparkSession, d: str) -> DataFrame:
    shape = "registration string, ground_station string, message_type string, latitude double, longitude double, altitude bigint, report_time_sec double, accuracy bigint, nav_redundancy boolean"
    rows = decode_binary(_surveillance(spark, d), "adsc").select("delivery_id", F.from_json("result", shape).alias("r")).select("delivery_id", "r.*")
    return rows.withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")})


def _controller(spark: SparkSession, d: str) -> DataFrame:
    """Controller-pilot messages with their checksum, written from the keys: uplinks of two elements (climb to a level, then contact a unit on a frequency), downlinks with time and reference (at a place request a climb)."""
    from aerolith.functions.crc import crc16, hex_bytes, text_bytes

    keys = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(f"CAST({e} AS BIGINT)").alias(n) for n, e in KEYS.items()])
    field = lambda e, width: F.lpad(F.bin(F.expr(f"CAST({e} AS BIGINT)")), width, "0")
    ia5 = lambda text: F.lit("".join(f"{ord(c):07b}" for c in text))
    level = [F.lit("110"), field("n - 30", 10)]
    up = F.concat(F.lit("100"), field("f", 6), field("20", 8), *level, F.lit("00"), field("117", 8), ia5("KZAK"), F.lit("01"), field("1000 + n * 25", 15))
    down = F.concat(F.lit("011"), field("f", 6), field("b", 6), field("h", 5), field("m", 6), field("a % 60", 6), field("11", 8), F.lit("011"), field("a", 7), field("b", 6), field("c", 6), field("s", 1), field("e", 8), field("f", 6), field("m", 6), field("w", 1), *level)
    plain = F.when(F.col("s") == 0, up).otherwise(down)
    whole = F.rpad(plain, (F.ceil(F.length(plain) / 8) * 8).cast("int"), F.lit("0"))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), (F.length(whole) / 8 - 1).cast("int")), lambda i: F.lpad(F.conv(F.substr(whole, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), "")
    head = F.lit("AT1.G-ZBKO")
    check = F.lpad(F.hex(crc16(F.concat(text_bytes(head), hex_bytes(digits))).bitwiseXOR(0xFFFF)), 4, "0")
    key = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return keys.select(key.alias("delivery_id"), F.when(F.col("s") == 0, "BA").otherwise("AA").alias("label"), F.concat(F.lit("/OAKODYA."), head, digits, check).alias("raw_text"))


def decode_cpdlc(spark: SparkSession, d: str) -> DataFrame:
    """The elements of each message, one a row, with the values of the second or only one."""
    shape = (
        "direction string, registration string, header struct<msg_id: bigint, msg_ref: bigint, timestamp: struct<hours: bigint, minutes: bigint, seconds: bigint>>, formatted_text string, "
        "elements array<struct<id: bigint, label: string, text: string, data: struct<type: string, value: bigint, unit: string, frequency: struct<value: bigint>, altitude: struct<value: bigint>, position: struct<latitude: double, longitude: double>>>>"
    )
    rows = decode_binary(spread(_controller(spark, d)), "cpdlc").select("delivery_id", F.from_json("result", shape).alias("r")).select("delivery_id", "r.*", F.posexplode("r.elements").alias("place", "x"))
    at = F.col("header.timestamp")
    return rows.select(
        "delivery_id", "place", "direction", "registration", F.col("header.msg_id").alias("msg_id"), F.col("header.msg_ref").alias("msg_ref"), (at["hours"] * 3600 + at["minutes"] * 60 + at["seconds"]).alias("seconds"), F.col("x.id").alias("element_id"),
        F.col("x.label").alias("wording"), "formatted_text", F.coalesce("x.data.value", "x.data.altitude.value").alias("level"), F.col("x.data.frequency.value").alias("frequency"),
        *[F.round(f"x.data.position.{c}", 6).alias(c) for c in ("latitude", "longitude")],
    )


def logged_cpdlc(spark: SparkSession, d: str) -> DataFrame:
    return decode_binary(table(spark, d, "messages"), "cpdlc")


def decode_weather(spark: SparkSession, d: str) -> DataFrame:
    """Observations written from the keys, one row a report."""
    text = f"'METAR KDEN 26' || {D2('h')} || {D2('m')} || 'Z ' || {D3('n')} || {D2('b')} || CASE WHEN s = 0 THEN 'MPS' ELSE 'KT' END || ' 10SM FEW080 M' || {D2('c')} || '/M12 A3001=\\nEGLL 261250Z 24004KT 9999 SCT030 10/08 Q10' || {D2('b')} || '='"
    rows = decode(written(spark, d, text, "C1"), BY_NAME["weather"], keep=("l_orderkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", F.explode("metars").alias("m")).select("l_orderkey", "l_linenumber", *[F.col(f"m.{c}").alias(c) for c in ("airport", "time", "wind_dir", "wind_speed", "visibility", "clouds", "temperature", "qnh")])


def decode_envelope(spark: SparkSession, d: str) -> DataFrame:
    return decode_binary(table(spark, d, "messages"), "envelope")


def dispatch_explain(spark: SparkSession, d: str) -> DataFrame:
    """For each decoder and format, how many of its messages pass the quick check and match."""
    rows = explain(table(spark, d, "messages"), registry("all")).select("parser", "quick_check", F.explode_outer("formats").alias("f"))  # decoders without declared formats have one row
    return rows.groupBy("parser", F.col("f.format").alias("format")).agg(F.count("*").alias("messages"), F.count_if("quick_check").alias("passed"), F.count_if("f.matched").alias("matched"))


def content(record: Column) -> Column:
    """The fields of a JSON record in order of their names, without nulls and without what belongs to the message; other texts as they are."""
    kept = F.map_filter(F.from_json(record, "map<string,string>"), lambda k, v: v.isNotNull() & ~k.isin("message_id", "timestamp"))
    return F.coalesce(F.to_json(F.array_sort(F.map_entries(kept))), record, F.lit(""))


def reparse_changes(spark: SparkSession, d: str) -> DataFrame:
    """The stored records against those of the decoders here, by type and content."""
    log = table(spark, d, "messages")
    stored = log.where("parser_type <> ''").select("delivery_id", F.col("parser_type").alias("result_type"), content(F.col("parsed_json")).alias("result"))
    fresh = dispatch_every(spread(log.select("delivery_id", "label", "raw_text")), registry("all")).select("delivery_id", "result_type", content(F.col("result")).alias("result"))
    return reparse_diff(stored, fresh).groupBy("result_type", "change").agg(F.count("*").alias("n"))


QUERIES = {n: _query(n) for n in SPECS} | {"dispatch_all": dispatch_all, "dispatch_first": dispatch_first, "decode_adsc": decode_adsc, "decode_envelope": decode_envelope, "decode_weather": decode_weather, "decode_cpdlc": decode_cpdlc, "logged_cpdlc": logged_cpdlc, "dispatch_explain": dispatch_explain, "reparse_changes": reparse_changes}
_KEYS_SQL = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in KEYS.items())
SQL = {n: _sql(n) for n in SPECS} | {
    "decode_cpdlc": f"""WITH k AS (SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS delivery_id, {_KEYS_SQL} FROM lineitem),
p AS (SELECT *, (a + b / 60.0::DOUBLE + c / 3600.0::DOUBLE) * (1 - 2 * s) AS lat, (e + f / 60.0::DOUBLE + m / 3600.0::DOUBLE) * (1 - 2 * w) AS lon, 'CLIMB TO AND MAINTAIN FL' || CAST(n AS VARCHAR) AS climb,
  'CONTACT KZAK ' || CAST((118000 + n * 25) // 1000 AS VARCHAR) || '.' || lpad(CAST((118000 + n * 25) % 1000 AS VARCHAR), 3, '0') || ' MHz' AS contact FROM k)
SELECT delivery_id, 0 AS place, 'uplink' AS direction, 'G-ZBKO' AS registration, f AS msg_id, CAST(NULL AS BIGINT) AS msg_ref, CAST(NULL AS BIGINT) AS seconds, 20 AS element_id, 'CLIMB TO AND MAINTAIN [altitude]' AS wording, climb || '; ' || contact AS formatted_text, n AS level, CAST(NULL AS BIGINT) AS frequency, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude FROM p WHERE s = 0
UNION ALL SELECT delivery_id, 1, 'uplink', 'G-ZBKO', f, NULL, NULL, 117, 'CONTACT [icaounitname] [frequency]', climb || '; ' || contact, NULL, 118000 + n * 25, NULL, NULL FROM p WHERE s = 0
UNION ALL SELECT delivery_id, 0, 'downlink', 'G-ZBKO', f, b, h * 3600 + m * 60 + a % 60, 11, 'AT [position] REQUEST CLIMB TO [altitude]', 'AT ' || printf('%.4f', lat) || ',' || printf('%.4f', lon) || ' REQUEST CLIMB TO FL' || CAST(n AS VARCHAR), n, NULL, round(lat, 6), round(lon, 6) FROM p WHERE s = 1""",
    "decode_weather": f"""WITH k AS (SELECT l_orderkey, l_linenumber, {_KEYS_SQL} FROM lineitem)
SELECT l_orderkey, l_linenumber, 'KDEN' AS airport, '26' || lpad(CAST(h AS VARCHAR), 2, '0') || lpad(CAST(m AS VARCHAR), 2, '0') || 'Z' AS time, n AS wind_dir, nullif(CASE WHEN s = 0 THEN CAST(floor(b * 1.944::DOUBLE) AS BIGINT) ELSE b END, 0) AS wind_speed, '10SM' AS visibility,
'FEW080' AS clouds, nullif(-c, 0) AS temperature, CAST(1016 AS BIGINT) AS qnh FROM k UNION ALL SELECT l_orderkey, l_linenumber, 'EGLL', '261250Z', 240, 4, '9999', 'SCT030', 10, 1000 + b FROM k""",
    "decode_adsc": f"""SELECT l_orderkey || '/' || l_linenumber AS delivery_id, 'G-ZBKO' AS registration, 'QUKAXBA' AS ground_station, 'basic' AS message_type, round((180 - 90 / 524288.0::DOUBLE) * a * 5000 / 1048575.0::DOUBLE, 6) + 0.0::DOUBLE AS latitude,
round((180 - 90 / 524288.0::DOUBLE) * e * 5000 / 1048575.0::DOUBLE, 6) AS longitude, g * 100 AS altitude, n * 8 * 0.125::DOUBLE AS report_time_sec, CAST(5 AS BIGINT) AS accuracy, true AS nav_redundancy
FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'CAST({e} AS BIGINT) AS {n}' for n, e in KEYS.items())} FROM lineitem)"""
}
