"""Lists, tables, patterns and names that results must agree with."""

# Duration text: a day prefix, and the two accepted clock forms.
DAY_PREFIX = r"^\d+\s+days\s+"
CLOCK_FORM = r"^(\d{2}:)?\d{2}:\d{2}(\.\d+)?$"
EMPTY_DURATIONS = ("", "NaT")
EMPTY_PIT_TIMES = ("", "NaT", "nat", "NAT")

# Defaults of the session keys.
DEFAULT_YEAR = 2023
DEFAULT_GRAND_PRIX = "Unknown"
DEFAULT_SESSION_TYPE = "R"

# Session key -> session name.
SESSION_NAMES = {
    "FP1": "Practice 1",
    "FP2": "Practice 2",
    "FP3": "Practice 3",
    "Q": "Qualifying",
    "S": "Sprint",
    "SQ": "Sprint Qualifying",
    "R": "Race",
}
# Sessions that have a result list.
RESULT_SESSION_TYPES = ("R", "Q", "S", "SQ", "Race", "Qualifying", "Sprint", "Sprint Qualifying")

UNCLASSIFIED_POSITION = 999
MIN_LAP_SECONDS = 30
MAX_LAP_SECONDS = 300

# Standard team name -> spellings that stand for it, tested in this order.
TEAM_SPELLINGS = {
    "McLaren": ["McLaren", "MCL"],
    "Ferrari": ["Ferrari", "FER"],
    "Red Bull Racing": ["Red Bull", "RB", "RBR"],
    "Mercedes": ["Mercedes", "MER"],
    "Aston Martin": ["Aston Martin", "AST", "AM"],
    "Alpine": ["Alpine", "ALP"],
    "Haas": ["Haas", "HAAS"],
    "Racing Bulls": ["RB", "Racing Bulls", "AlphaTauri", "Toro Rosso", "VCARB"],
    "Williams": ["Williams", "WIL"],
    "Kick Sauber": ["Sauber", "Alfa Romeo", "Kick Sauber", "SAU"],
}
# Driver code -> full name.
DRIVER_NAMES = {
    "VER": "Max Verstappen",
    "LEC": "Charles Leclerc",
    "NOR": "Lando Norris",
    "HAM": "Lewis Hamilton",
    "RUS": "George Russell",
    "PIA": "Oscar Piastri",
    "SAI": "Carlos Sainz",
    "ALO": "Fernando Alonso",
    "STR": "Lance Stroll",
    "GAS": "Pierre Gasly",
    "TSU": "Yuki Tsunoda",
    "ALB": "Alexander Albon",
    "OCO": "Esteban Ocon",
    "HUL": "Nico Hülkenberg",
    "BOT": "Valtteri Bottas",
    "ZHO": "Zhou Guanyu",
    "SAR": "Logan Sargeant",
    "RIC": "Daniel Ricciardo",
    "MAG": "Kevin Magnussen",
    "LAW": "Liam Lawson",
    "BEA": "Oliver Bearman",
}
# Next season's line-up.
NEXT_SEASON = 2026
LINEUP = {
    "McLaren": ["Lando Norris", "Oscar Piastri"],
    "Ferrari": ["Charles Leclerc", "Lewis Hamilton"],
    "Red Bull Racing": ["Max Verstappen", "Yuki Tsunoda"],
    "Mercedes": ["George Russell", "Andrea Kimi Antonelli"],
    "Aston Martin": ["Fernando Alonso", "Lance Stroll"],
    "Alpine": ["Pierre Gasly", "Jack Doohan"],
    "Haas": ["Esteban Ocon", "Oliver Bearman"],
    "Racing Bulls": ["Isack Hadjar", "Liam Lawson"],
    "Williams": ["Alexander Albon", "Carlos Sainz"],
    "Kick Sauber": ["Nico Hülkenberg", "Gabriel Bortoleto"],
}
# Grid place assumed for a team without any data, and for a team not listed.
BASELINE_POSITIONS = {
    "McLaren": 1.5,
    "Ferrari": 1.8,
    "Red Bull Racing": 1.2,
    "Mercedes": 2.2,
    "Aston Martin": 4.0,
    "Alpine": 6.0,
    "Williams": 8.0,
    "Racing Bulls": 7.0,
    "Haas": 9.0,
    "Kick Sauber": 10.0,
}
DEFAULT_BASELINE_POSITION = 10.0
ROOKIE_LAP_FACTOR = 1.01
ROOKIE_SPEED_FACTOR = 0.99

# Race -> (laps, average lap seconds, tyre factor), and the default row.
RACE_PARAMETERS = {
    "Australian Grand Prix": (58, 85.0, 0.10),
    "Monaco Grand Prix": (78, 75.0, 0.05),
    "British Grand Prix": (52, 87.0, 0.12),
    "Italian Grand Prix": (53, 82.0, 0.08),
    "Singapore Grand Prix": (62, 95.0, 0.15),
}
DEFAULT_RACE_PARAMETERS = (58, 90.0, 0.10)
# Race -> laps where no lap of the session is known, and the default.
RACE_LAPS = {
    "Saudi Arabian Grand Prix": 50,
    "Bahrain Grand Prix": 57,
    "Australian Grand Prix": 58,
    "Japanese Grand Prix": 53,
    "Chinese Grand Prix": 56,
    "Miami Grand Prix": 57,
    "Emilia Romagna Grand Prix": 63,
    "Monaco Grand Prix": 78,
    "Canadian Grand Prix": 70,
    "Spanish Grand Prix": 66,
    "Austrian Grand Prix": 71,
    "British Grand Prix": 52,
    "Hungarian Grand Prix": 70,
    "Belgian Grand Prix": 44,
    "Dutch Grand Prix": 72,
    "Italian Grand Prix": 53,
    "Azerbaijan Grand Prix": 51,
    "Singapore Grand Prix": 62,
    "United States Grand Prix": 56,
    "Mexico City Grand Prix": 71,
    "São Paulo Grand Prix": 71,
    "Las Vegas Grand Prix": 50,
    "Qatar Grand Prix": 57,
    "Abu Dhabi Grand Prix": 58,
}
DEFAULT_RACE_LAPS = 50

# Team colours: by name fragment (in this order), by id, and by exact name.
DEFAULT_COLOUR = "#FFFFFF"
COLOUR_RULES = [
    ("#3671C6", ["red bull"], []),
    ("#C8C8C8", ["racing bulls", "alpha tauri"], ["rb"]),
    ("#F91536", ["ferrari"], []),
    ("#6CD3BF", ["mercedes"], []),
    ("#F58020", ["mclaren"], []),
    ("#2293D1", ["alpine"], []),
    ("#5E8FAA", ["aston"], []),
    ("#37BEDD", ["williams"], []),
    ("#B6BABD", ["haas"], []),
    ("#00CF46", ["sauber", "alfa"], []),
]
COLOUR_BY_ID = {
    1: "#3671C6",
    2: "#37BEDD",
    3: "#F91536",
    4: "#6CD3BF",
    5: "#2293D1",
    6: "#F58020",
    7: "#5E8FAA",
    8: "#B6BABD",
    9: "#00CF46",
    10: "#C8C8C8",
    0: "#FFFFFF",
}
COLOUR_BY_NAME = {
    "Red Bull Racing": "#3671C6",
    "Ferrari": "#F91536",
    "Aston Martin": "#5E8FAA",
    "McLaren": "#F58020",
    "Mercedes": "#6CD3BF",
    "RB": "#C8C8C8",
    "Haas F1 Team": "#B6BABD",
    "Williams": "#37BEDD",
    "Alpine": "#2293D1",
    "Kick Sauber": "#00CF46",
    "Unknown": "#FFFFFF",
}
