"""Small schedule pages and sentences with what they say."""

from __future__ import annotations

PAGES = {
    ("S1", 1): [
        "DB REFERENCE: DB-K-02-P", "Way Phase Rating Type Curve Details", "1 L1 10 K C 10 Ra P A 3 2.5 1.5 W N N/A N Office sockets", "L2 20 M B 30 10 Ri P A 3 4 2.5 W N N/A N Kitchen ring",
        "L3 6 K B 10 Ra L B 3 1.5 1.5 X N N/A N Corridor lighting 2 x contactor", "2 L1 32 J C 25 Ra P C 4 10 6 W N N/A N Chiller unit", "L2", "L3", "3 20 M B 30 10 Ri P A 3 4 2.5 W N N/A N Server room",
        "L1", "L2 spare", "L3", "4 L1", "L2", "L3",
    ],
    ("S1", 2): [
        "P1 - MCB Curve Type C", "P2 - RCBO Type A 30 mA", "1 L1 16 P1 Lighting 2.5 T1 1,3", "L2 20 P2 Sockets", "L3 B Fitted blank", "L1 32 P4 Heater TBC", "2 L2 16 P1 Pump", "L1 10 P1 Fan",
    ],
    ("S1", 3): [
        "Way description rating device", "1/L1 16 B 30 NO 3 2.5 1.5 RAD Office sockets", "1/L2 Spare", "2/L1 10 1.5 1.0 XLPE Lighting corridor", "3 L1 Boiler RAD 16 C - YES", "4 Spare 0",
        "5 Water heater 20 B 30 2.5 3 1.5", "6 16A MCB type C fan", "Main switch incoming 100A isolator", "----------", "Note: all ways to be checked", "7 16A MCB pump",
    ],
}

#: file, page, line, way, phase, rating, device, curve, sens, ka, poles, qty, conf, dialect, review
ROWS = [
    ("S1", 1, 2, 1, "L1", 10, "MCB", "C", None, 10, 1, 1, 0.98, "full code", False), ("S1", 1, 3, 1, "L2", 20, "RCBO", "B", 30, 10, 1, 1, 0.98, "full code", False),
    ("S1", 1, 4, 1, "L3", 6, "MCB", "B", None, 10, 1, 1, 0.98, "full code", False), ("S1", 1, 5, 2, "3PH", 32, "MCCB", "C", None, 25, 3, 1, 0.98, "full code", False),
    ("S1", 1, 8, 3, "L1", 20, "RCBO", "B", 30, 10, 1, 1, 0.98, "full code", False), ("S1", 1, 12, 4, None, None, None, None, None, None, 1, 0, 0.98, "full code", False),
    ("S1", 2, 2, 1, "L1", 16, "MCB", "C", None, None, 1, 1, 0.94, "coded list", False), ("S1", 2, 3, 1, "L2", 20, "RCBO", None, 30, None, 1, 1, 0.94, "coded list", False),
    ("S1", 2, 4, 1, "L3", None, None, None, None, None, 1, 0, 0.94, "coded list", True), ("S1", 2, 5, 2, "L1", 32, "Fuse", None, None, None, 1, 1, 0.55, "coded list", True),
    ("S1", 2, 6, 2, "L2", 16, "MCB", "C", None, None, 1, 1, 0.94, "coded list", False), ("S1", 2, 7, 3, "L1", 10, "MCB", "C", None, None, 1, 1, 0.65, "coded list", True),
    ("S1", 3, 1, 1, "L1", 16, "RCBO", "B", 30, None, 1, 1, 0.94, "slash columns", False), ("S1", 3, 2, 1, "L2", None, None, None, None, None, 1, 0, 0.96, "spare", False),
    ("S1", 3, 3, 2, "L1", 10, "MCB", None, None, None, 1, 1, 0.9, "service columns", False), ("S1", 3, 4, 3, "L1", 16, "AFDD+RCBO", "C", None, None, 1, 1, 0.93, "text first", False),
    ("S1", 3, 5, 4, None, None, None, None, None, None, 1, 0, 0.96, "spare", False), ("S1", 3, 6, 5, None, 20, "RCBO", "B", 30, None, 1, 1, 0.91, "no phase", False),
    ("S1", 3, 7, 6, None, 16, "MCB", "C", None, None, None, 1, 0.8, "generic", False), ("S1", 3, 8, None, None, 100, "Isolator", None, None, None, None, 1, 0.65, "generic", False),
]
FEEDERS = [
    (1, "Sub-main to DB-01 in tray", "MSB1"), (2, "DB-02 fed from MSB2", None), (3, "DB-03 supplied from transformer T1", None), (4, "MSB1 supplies DB-04", None), (5, "Outgoing feeder to SMDB-5", None),
    (6, "General lighting as drawing", "MSB1"),
]
FED = [(1, "MSB1", "DB01", 0.85), (2, "MSB2", "DB02", 0.85), (3, "TRANSFORMER", "DB03", 0.85), (4, "MSB1", "DB04", 0.85), (5, None, "SMDB5", 0.6)]
CABLES = [(1, "4C 95mm2 XLPE SWA"), (2, "6242Y 2.5mm2 and 2.5/1.5 mm2"), (3, "4mm CPC"), (4, "no cable"), (5, "3 x 2.5mm² and 3 x 2.5mm²")]
CABLES_FOUND = [
    (1, "4C 95mm2", 4.0, 95.0, None, "XLPE/SWA"), (2, "6242Y 2.5mm2", None, 2.5, None, "6242Y flat T&E"), (2, "2.5/1.5 mm2", None, 2.5, 1.5, None), (3, "4mm CPC", None, None, 4.0, None),
    (5, "3 x 2.5mm²", 3.0, 2.5, None, None),
]
MISREAD = [(1, "Way l: l6A MC8 C curve 1OkA"), (2, "RC8O and MCC8 at l7A"), (3, "Circuit 4: 16A MCB")]
CORRECTED = [(1, "Way 1: 16A MCB C curve 10kA", 4), (2, "RCBO and MCCB at l7A", 2), (3, "Circuit 4: 16A MCB", 0)]
BOARD_LINES = [
    (1, "Distribution board DB-00-SUBEXT on level 0"), (2, "DB Schedule fed from the main LV panel"), (3, "Consumer Unit (Flat 4) and MSB1"), (4, "G1-GF-DB-LL next to SMDB-2A"), (5, "Board Reference: 2A4"),
    (6, "Drawing Reference: E-100"), (7, "no board here"),
]
BOARD_KEYS = [(1, "DB00SUBEXT"), (2, "MAINLVPANEL"), (3, "CUFLAT4"), (3, "MSB1"), (4, "G1GFDBLL"), (4, "SMDB2A"), (5, "2A4")]
CURVES = [(1, "16A MCB Type B"), (2, "C-curve breaker"), (3, "MCB D32"), (4, "Board C12 rev"), (5, "16A MCB"), (6, "RCBO curve: K, 10 kA")]
CURVES_FOUND = [(1, "B", None), (2, "C", None), (3, "D", None), (4, None, None), (5, None, None), (6, "K", 10.0)]
