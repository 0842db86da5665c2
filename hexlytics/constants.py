"""Fixed values. They are stated as they must be for results to agree; nothing here is logic."""

# --- fixed values: raw column, standard column, type -------------------------------------------
RAW_COLUMNS = [
    ("id", "id", "string"),
    ("case_number", "case_number", "string"),
    ("date", "created_date", "string"),
    ("block", "block_address", "string"),
    ("iucr", "iucr_code", "string"),
    ("primary_type", "crime_type", "string"),
    ("description", "crime_description", "string"),
    ("location_description", "location_type", "string"),
    ("arrest", "arrest_made", "boolean"),
    ("domestic", "is_domestic", "boolean"),
    ("beat", "beat_id", "bigint"),
    ("district", "district_id", "bigint"),
    ("ward", "ward_id", "bigint"),
    ("community_area", "community_area_id", "bigint"),
    ("fbi_code", "fbi_code", "string"),
    ("x_coordinate", "x_coordinate", "double"),
    ("y_coordinate", "y_coordinate", "double"),
    ("year", "incident_year", "bigint"),
    ("updated_on", "updated_on", "string"),
    ("latitude", "latitude", "double"),
    ("longitude", "longitude", "double"),
    ("location", "location_point", "string"),
]

# --- fixed values: offense types of each category ----------------------------------------------
CATEGORY_TYPES = {
    "Violent": [
        "HOMICIDE", "CRIM SEXUAL ASSAULT", "SEX OFFENSE", "BATTERY", "ASSAULT", "ROBBERY",
        "KIDNAPPING", "HUMAN TRAFFICKING", "ARSON",
    ],
    "Property": [
        "BURGLARY", "THEFT", "MOTOR VEHICLE THEFT", "CRIMINAL DAMAGE", "CRIMINAL TRESPASS",
        "DECEPTIVE PRACTICE", "OTHER OFFENSE", "WEAPONS VIOLATION", "GAMBLING",
    ],
    "Narcotics": ["NARCOTICS", "PUBLIC INDECENCY", "PROSTITUTION"],
    "Disorder": [
        "PUBLIC PEACE VIOLATION", "LIQUOR LAW VIOLATION", "INTERFERENCE WITH PUBLIC OFFICER",
        "OBSCENITY", "INTIMIDATION", "NON-CRIMINAL", "NON - CRIMINAL",
        "CONCEALED CARRY LICENSE VIOLATION", "OFFENSE INVOLVING CHILDREN",
    ],
    "Traffic": ["TRAFFIC VIOLATION", "OTHER NARCOTIC VIOLATION", "RITUALISM"],
}
UNCLASSIFIED = "Unclassified"

# --- fixed values: resolution, label, size -----------------------------------------------------
RESOLUTION_GUIDE = [
    (6, "Citywide", "≈4.7 km across"),
    (7, "District-scale", "≈1.2 km across"),
    (8, "Neighborhood-scale", "≈0.46 km across"),
    (9, "Street-scale", "≈0.17 km across"),
    (10, "Micro-block", "≈0.06 km across"),
]
RESOLUTIONS = [6, 7, 8, 9, 10]

# --- fixed values: coordinate boxes (inclusive), city centre ----------------------------------
BRONZE_BOX = {"lat": (41.0, 42.5), "lon": (-88.5, -87.0)}
CELL_BOX = {"lat": (40.0, 43.0), "lon": (-89.0, -86.0)}
CITY_CENTRE = (41.881832, -87.623177)

# --- fixed values: fills, rates, report sizes -------------------------------------------------
TEXT_FILL_COLUMNS = ["location_type", "block_address", "crime_description"]
ID_FILL_COLUMNS = ["beat_id", "district_id", "ward_id", "community_area_id"]
UNKNOWN = "UNKNOWN"
PRIOR_WEIGHT = 5.0
WILSON_Z = 1.96
LOW_CONFIDENCE_BELOW = 5
ROLLING_DAYS = [7, 14, 30]
MAP_CELL_LIMIT = 600
SHAPIRO_LIMIT = 5000
MIN_CLUSTER_SIZE = 50
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# --- fixed values: accepted column names, first match wins -------------------------------------
ID_NAMES = ["id", "case_number", "incident_id", "incident_number"]
ARREST_NAMES = ["arrest_made", "arrest", "arrested", "was_arrested"]
TYPE_NAMES = ["crime_type", "primary_type", "primarytype", "primary type"]
STREET_NAMES = ["street_norm", "block_address", "block"]

# --- fixed values: planar lattice (km per degree, circumradius of the finest cell in km) -------
KM_PER_LON = 82.9
KM_PER_LAT = 111.2
FINEST_RADIUS_KM = 0.0759
