"""Other names of the entries of the reference list in schedules, for those that no rule gives: word order, endings, typing
errors, abbreviated words, initials and words left out are the matcher's."""

#: Other spellings of reference entries, by field and label.
ALIASES: dict[str, dict[str, tuple[str, ...]]] = {
    "device_class": {
        "MCB": ("miniature circuit breaker", "miniature breaker"),
        "RCBO": ("combined rcd and mcb", "residual current breaker with overcurrent"),
        "AFDD+RCBO": ("arc fault rcbo", "afdd"),
        "MCCB": ("moulded case circuit breaker", "molded case breaker"),
        "ACB": ("air breaker",),
        "RCD": ("rccb", "earth leakage breaker"),
        "SPD": ("surge arrester", "surge protector"),
        "Fuse": ("fuselink",),
        "Switch disconnector": ("disconnector switch", "sw disc"),
        "Isolator": ("isolating switch",),
        "Time clock": ("timeclock",),
        "Photocell": ("pec",),
        "Overload relay": ("overload",),
        "Space": ("blank", "blanked way"),
    },
    "description": {
        "Lighting": ("lights", "luminaires"),
        "Emergency lighting": ("eml", "emergency luminaires", "emergency lights", "em lighting"),
        "Socket outlets": ("sockets", "s o ring", "sso"),
        "Water heater": ("hw heater", "wh"),
        "Hand dryer": ("hand dryers",),
        "Fire alarm panel": ("f a panel",),
        "Access control": ("acs",),
        "Passenger lift": ("lift no", "elevator"),
        "Air handling unit": ("air handler",),
        "Fan coil unit": ("fcus",),
        "Extract fan": ("extractor", "extract"),
        "Circulation pump": ("circulating pump",),
        "EV charger": ("evcp", "car charging point"),
        "Cooker": ("hob and oven",),
        "Data cabinet": ("comms rack", "server rack"),
        "CCTV": ("surveillance cameras",),
        "Trace heating": ("pipe trace heater",),
        "Heat pump": ("ashp",),
        "Solar inverter": ("solar pv inv",),
        "Roller shutter": ("shutter door",),
        "Disabled alarm": ("accessible toilet alarm",),
        "Sub-main feed": ("s main", "submain"),
        "Incoming supply": ("incomer", "main switch"),
        "Spare way": ("spare",),
        "Blank space": ("blank", "space", "blanking plate"),
        "Surge protection": ("spd", "surge protector", "surge arrester"),
    },
}
