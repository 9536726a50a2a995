"""Fixed values of the entity-resolution engine: schema, weights, thresholds, tables."""

# Columns of a record, and the labels that only evaluation may see.
OWNER, CODE, LEGACY, RAW = "CPSE", "CPSE Material Code", "Legacy_Sector_Code", "Raw Description"
SECTOR, CATEGORY, UOM = "Sector", "Material Category", "UOM"
ATTRIBUTE_COLUMNS = ["Material/Grade", "Dimensions", "Specification/Standard", "Capacity/Rating", "Operating Parameter"]
LABEL_TEXT, LABEL = "Standardized Description", "GroundTruth_Group"
LABEL_COLUMNS = [LABEL_TEXT, LABEL]
REQUIRED_COLUMNS = [OWNER, CODE, CATEGORY, RAW]
OPTIONAL_COLUMNS = [SECTOR, *ATTRIBUTE_COLUMNS]
DEFAULTED_COLUMNS = [UOM, LEGACY]

# Scores.
CHANNEL_WEIGHTS = {"semantic": 0.35, "string": 0.40, "attribute": 0.25}
CONFLICT_PENALTY = 0.30
TOLERANCE = 0.02
HARD_ATTRIBUTES = ["schedule", "pressure_class", "grade", "spec_standard"]

# Thresholds.
HIGH_PRECISION_TARGET, AUTO_APPROVE_TARGET = 0.95, 0.99
PRETRAINED_MEDIUM, PRETRAINED_HIGH = 0.55, 0.85
FUSED_MEDIUM, FUSED_HIGH = 0.65, 0.85
MIN_KNOWN_FOR_AUTO, COHESION_RATIO = 2, 1.0

# Blocking.
SIZE_BUCKET_MM, MAX_BLOCK = 25.0, 400
DEFAULT_FAMILIES = ["category_size", "category_token"]
# Words that don't tell one category from another.
GENERIC_TOKENS = ["component", "components", "spare", "spares", "part", "parts", "equipment", "industrial", "type", "misc", "general", "assembly"]

# Semantic channel.
WORD_COMPONENTS, CHAR_COMPONENTS = 256, 128

# Runtime model.
BASE_ROWS, BASE_SECONDS, EXPONENT, FIXED_SECONDS, LARGE_ROWS = 5008, 80, 1.3, 4, 20_000

# Codes.
CODE_PREFIX, SEQUENCE_WIDTH, OTHER_SECTOR = "NM", 5, "XX"
SECTOR_CODES = {"Oil & Gas": "OG", "Power": "PW", "Steel": "ST", "Mining": "MN", "Heavy Engineering": "HE"}

# Savings.
ITEM_VALUE, CARRYING_COST, PRICE_BENEFIT = 250_000, 0.08, 0.03

# Review.
MIN_LABELS, BLEND, SEED = 100, 0.25, 42
TEST_FRACTION, VAL_FRACTION = 0.30, 0.15

# Attributes in the order of their flags.
NUMERIC = ["nominal_size_mm", "thickness_mm", "rating_kva", "voltage_kv", "power_hp", "flow_m3hr", "head_m", "capacity_cum", "area_sqmm", "ply", "width_mm"]
CATEGORICAL = ["grade", "spec_standard", "schedule", "pressure_class", "ratio", "material_of_construction"]
ATTRIBUTES = NUMERIC + CATEGORICAL
