"""Fixed trade vocabulary for technical product listings.

The noun phrases, end forms and finishes below are plain dictionary values: the
left side is the canonical term, the right side the wordings the trade uses for
it.  Nothing here depends on a particular data set; callers may pass their own
mapping to ``product_groups``.
"""

# Noun phrases of item kinds and their usual wordings.
KINDS = {
    "gate valve": ["gate valve", "valve gate", "gate vlv", "sluice valve"],
    "ball valve": ["ball valve", "valve ball", "ball vlv"],
    "check valve": ["check valve", "valve check", "check vlv", "non return valve", "nrv"],
    "butterfly valve": ["butterfly valve", "valve butterfly", "b/fly valve", "butterfly vlv"],
    "globe valve": ["globe valve", "valve globe", "globe vlv"],
    "control cable": ["control cable", "cable control", "ctrl cable"],
    "power cable": ["power cable", "cable power", "pwr cable"],
    "gear pump": ["gear pump", "pump gear type", "rotary gear pump", "pump gear"],
    "centrifugal pump": ["centrifugal pump", "pump centrifugal", "centri pump"],
    "air compressor": ["air compressor", "compressor air", "air cmpr"],
    "basket strainer": ["basket strainer", "strainer basket type", "strainer basket", "basket filter"],
    "blind flange": ["blind flange", "flange blind", "blind flg"],
    "seamless pipe": ["seamless pipe", "pipe seamless", "smls pipe"],
    "chain hoist": ["chain hoist", "hoist chain type", "chain pulley hoist", "hoist chain"],
    "helical gearbox": ["helical gearbox", "gearbox helical", "helical gbx"],
    "storage drum": ["storage drum", "drum storage", "storage vessel"],
    "distribution transformer": ["distribution transformer", "transformer distribution", "dist trf"],
    "moulded breaker": ["moulded breaker", "breaker moulded case", "mccb breaker", "moulded case breaker"],
    "spiral gasket": ["spiral gasket", "gasket spiral wound", "spw gasket", "spiral wound gasket"],
    "reducer fitting": ["reducer fitting", "fitting reducer", "reducer"],
    "induction motor": ["induction motor", "motor induction", "ind motor"],
    "roller bearing": ["roller bearing", "bearing roller", "roller brg"],
    "pressure gauge": ["pressure gauge", "gauge pressure", "pr gauge"],
    "jaw coupling": ["jaw coupling", "coupling jaw type", "jaw cplg", "coupling jaw"],
    "steel plate": ["steel plate", "plate steel", "stl plate"],
}

# Mounting, end connections, profiles, protection.
FORMS = {
    "foot": ["foot mounted", "foot mtg", "foot mtd", "base mounted"],
    "skid": ["skid mounted", "skid mtd", "skid mtg", "on skid"],
    "wall": ["wall mounted", "wall mtg", "wall mtd", "for wall fixing"],
    "trolley": ["trolley mounted", "trolley mtd", "on trolley", "wheeled"],
    "panel": ["panel mounted", "panel mtg", "panel mtd", "flush in panel"],
    "flangemount": ["flange mounted", "flange mtg", "flange mtd", "flg mtd"],
    "buttweld": ["butt weld", "butt welded", "bw ends", "butt weld ends"],
    "socketweld": ["socket weld", "socket welded", "sw ends", "socket weld ends"],
    "screwed": ["screwed ends", "scrd", "threaded ends", "screwed"],
    "clamped": ["clamped ends", "clamp connection", "clmp", "clamped"],
    "flanged": ["flanged ends", "flgd", "flanged connection", "flanged"],
    "wafer": ["wafer type", "wafer pattern", "wfr", "wafer"],
    "tee": ["tee profile", "tee section", "t shape", "tee"],
    "hexagonal": ["hexagonal profile", "hexagon", "hex", "hexagonal"],
    "round": ["round profile", "rnd", "round"],
    "square": ["square profile", "sqr", "square"],
    "flat": ["flat profile", "flt", "flat"],
    "oval": ["oval profile", "oval shape", "oval"],
}

# Cable sheath and enclosure terms (a separate attribute beside the mounting form).
SHEATHS = {
    "dustproof": ["dustproof", "dust tight", "dp type", "dust proof"],
    "unarmoured": ["unarmoured", "unarmd", "without armour"],
    "armoured": ["armoured", "armd", "with armour"],
    "fireretardant": ["fire retardant", "fr grade", "flame retardant"],
    "weatherproof": ["weatherproof", "wp type", "outdoor duty", "weather proof"],
    "lowsmoke": ["low smoke", "low smoke sheath", "ls sheath"],
}

# Surface finishes.
FINISHES = {
    "nickel": ["nickel plated", "ni plated", "nickel coated"],
    "phosphated": ["phosphated", "phos treated", "phosphate coated"],
    "polished": ["polished", "buffed", "mirror finish"],
    "rubber": ["rubber lined", "rl", "inside rubber lining"],
    "galvanised": ["galvanised", "galv", "zinc coated", "galvanized"],
    "plain": ["plain finish", "self finish", "uncoated"],
    "epoxy": ["epoxy painted", "epoxy coated", "epoxy ptd"],
}

# Core counts written in words.
CORE_WORDS = {
    "single": 1, "one": 1, "twin": 2, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "ten": 10, "twelve": 12, "nineteen": 19,
}

# Measuring units of item attributes -> (dimension, factor to the dimension's base in micro units).
ITEM_UNITS = {
    "mm": ("length", 1_000), "mms": ("length", 1_000), "millimetre": ("length", 1_000), "millimeter": ("length", 1_000),
    "cm": ("length", 10_000), "cms": ("length", 10_000), "centimetre": ("length", 10_000),
    "m": ("length", 1_000_000), "mtr": ("length", 1_000_000), "mtrs": ("length", 1_000_000), "metre": ("length", 1_000_000), "meter": ("length", 1_000_000),
    "inch": ("length", 25_400), "in": ("length", 25_400),
    "bar": ("pressure", 100_000), "bars": ("pressure", 100_000), "kpa": ("pressure", 1_000), "kilopascal": ("pressure", 1_000),
    "mpa": ("pressure", 1_000_000), "megapascal": ("pressure", 1_000_000), "psi": ("pressure", 6_894.757),
    "kw": ("power", 1_000), "kilowatt": ("power", 1_000), "w": ("power", 1), "watt": ("power", 1), "watts": ("power", 1), "mw": ("power", 1_000_000), "hp": ("power", 745.7),
    "v": ("voltage", 1), "volt": ("voltage", 1), "volts": ("voltage", 1), "kv": ("voltage", 1_000), "kilovolt": ("voltage", 1_000),
    "a": ("current", 1_000), "amp": ("current", 1_000), "amps": ("current", 1_000), "ampere": ("current", 1_000), "ma": ("current", 1), "milliamp": ("current", 1), "ka": ("current", 1_000_000),
    "kg": ("mass", 1_000_000), "kgs": ("mass", 1_000_000), "kilo": ("mass", 1_000_000), "kilogram": ("mass", 1_000_000), "g": ("mass", 1_000), "gm": ("mass", 1_000), "gms": ("mass", 1_000), "gram": ("mass", 1_000), "grams": ("mass", 1_000),
    "l": ("volume", 1_000), "ltr": ("volume", 1_000), "ltrs": ("volume", 1_000), "litre": ("volume", 1_000), "litres": ("volume", 1_000), "liter": ("volume", 1_000), "ml": ("volume", 1), "mls": ("volume", 1), "millilitre": ("volume", 1),
}
