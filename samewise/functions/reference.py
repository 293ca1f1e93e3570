"""Fixed values of the matching rules: word lists, aliases, units, weights and caps."""

from __future__ import annotations

# Token aliases, spellings and abbreviations of descriptions and part numbers.
DOMAIN_TOKENS = {
    "dec": "desiccated", "desicated": "desiccated", "decicated": "desiccated", "decicatted": "desiccated",
    "coco": "coconut", "co": "coconut", "c01": "type 1", "co1": "type 1", "c02": "type 2", "co2": "type 2",
    "flt": "filter", "filt": "filter", "gen": "generator", "hvac": "hvac", "ss": "stainless steel",
    "stl": "steel", "bat": "battery", "temp": "temperature", "press": "pressure",
}
SPELLING = {"decicated": "desiccated", "decicatted": "desiccated"}
ABBREVIATIONS = {
    "piece": "pcs", "pieces": "pcs", "pcs": "pcs", "ss": "stainless steel", "mcb": "miniature circuit breaker",
    "cu": "copper", "filtration": "filter", "filtering": "filter", "amp": "amp", "amps": "amp", "a": "amp",
}
# Words that stand for no value, units of measurements, and words that change what an item is.
NULL_WORDS = ["", "nan", "none"]
UNITS = ["mm", "cm", "m", "kg", "g", "l", "ml", "v", "volt", "amp", "ph"]
CRITICAL_MODIFIERS = [
    "oil", "fuel", "air", "water", "hydraulic", "cabin", "lube", "coolant", "stainless", "carbon", "rubber", "copper", "pvc",
    "left", "right", "red", "blue", "green", "yellow", "black", "white", "orange", "purple", "grey", "gray", "brown", "silver", "gold",
]
# Terms that name no item.
GENERIC_TERMS = [
    "label", "labels", "filter", "pipe", "bolt", "nut", "screw", "washer", "cable", "sensor", "paint", "oil", "material", "item",
    "part", "spare", "tool", "kit", "test", "sales", "component", "inventory",
]
# Application contexts, and aliases of retrieval texts and part codes.
CONTEXTS = {
    "gen": "generator", "generator": "generator", "hvac": "hvac", "elec": "electrical", "electrical": "electrical",
    "hyd": "hydraulic", "hydraulic": "hydraulic", "pneu": "pneumatic", "pneumatic": "pneumatic", "auto": "vehicle",
    "veh": "vehicle", "vehicle": "vehicle", "pump": "pump", "comp": "compressor", "compressor": "compressor",
}
RETRIEVAL_ALIASES = {
    "mtr": "motor", "brg": "bearing", "de": "drive end", "nde": "non drive end", "assy": "assembly", "bkt": "bracket",
    "pnl": "panel", "vlv": "valve",
}
PART_CODES = {
    "fp": "fuelpump", "com": "compressor", "stat": "stator", "rot": "rotor", "brg": "bearing", "mtr": "motor", "assy": "assembly",
    "pnl": "panel",
}
# Descriptions and tokens without identity, and opposite terms.
GENERIC_DESCRIPTIONS = [
    "part", "inventory part", "normal time", "sales part", "bracket", "test", "circuit board", "item", "material",
    "miscellaneous", "service",
]
GENERIC_TOKENS = [
    "part", "inventory", "normal", "time", "sales", "test", "item", "material", "miscellaneous", "service", "generic", "board",
    "bracket",
]
OPPOSITES = [("serial", "non serial"), ("left", "right"), ("lh", "rh"), ("inlet", "outlet"), ("male", "female"), ("red", "blue")]

# Variant groups whose values are words of the description.
WORD_GROUPS = {
    "FILTER_FUNCTION": ["air", "fuel", "oil", "water", "hydraulic"],
    "COLOR": ["red", "blue", "green", "black", "white", "yellow"],
    "SENSOR_TYPE": ["temperature", "pressure", "flow", "level"],
    "CONNECTIVITY": ["wired", "wireless"],
    "ENVIRONMENT": ["indoor", "outdoor"],
    "OPERATION_MODE": ["manual", "automatic"],
    "PLACEMENT": ["internal", "external"],
    "HIERARCHY": ["primary", "secondary"],
    "SIGNAL_TYPE": ["analog", "digital"],
    "FLOW_ROLE": ["inlet", "outlet"],
}
# Sides, structural roles, sizes and ordinals.
SIDES = {"left": "left", "lh": "left", "right": "right", "rh": "right", "front": "front", "rear": "rear"}
STRUCTURAL_ROLES = {
    "top": "top", "comp": "component", "component": "component", "assy": "assembly", "assembly": "assembly", "sub": "subassembly",
    "subassembly": "subassembly", "base": "base", "module": "module", "kit": "kit", "rotor": "rotor", "stator": "stator",
}
SIZE_WORDS = {"xs": "extra small", "small": "small", "medium": "medium", "large": "large", "xl": "extra large"}
SIZE_CODES = {"xs": "extra small", "s": "small", "m": "medium", "l": "large", "xl": "extra large", "xxl": "extra extra large"}
ORDINALS = {
    "first": "1", "second": "2", "third": "3", "fourth": "4", "fifth": "5", "sixth": "6", "seventh": "7", "eighth": "8",
    "ninth": "9", "tenth": "10",
}
# Groups that two descriptions must not contradict each other in, with their order.
CRITICAL_GROUPS = [
    "FILTER_FUNCTION", "COLOR", "SIZE", "TYPE_OR_GRADE", "ELECTRICAL_RATING", "DIMENSION", "SENSOR_TYPE", "SIDE",
    "CONNECTIVITY", "ENVIRONMENT", "OPERATION_MODE", "PLACEMENT", "HIERARCHY", "SIGNAL_TYPE",
]
ROLE_GROUPS = ["END_POSITION", "SERIALIZATION_ROLE", "FLOW_ROLE", "ENGINE_COMPONENT_ROLE"]
ONE_SIDED_GROUPS = ["CONNECTIVITY", "ENVIRONMENT", "HIERARCHY", "OPERATION_MODE", "PLACEMENT", "SIGNAL_TYPE"]

# Unit of measure -> (unit, dimension), what stands for none, and the penalty of each relationship.
UOM = {
    "pc": ("piece", "count"), "pcs": ("piece", "count"), "piece": ("piece", "count"), "pieces": ("piece", "count"),
    "ea": ("piece", "count"), "each": ("piece", "count"), "unit": ("piece", "count"), "units": ("piece", "count"),
    "l": ("litre", "volume"), "lt": ("litre", "volume"), "ltr": ("litre", "volume"), "liter": ("litre", "volume"),
    "liters": ("litre", "volume"), "litre": ("litre", "volume"), "litres": ("litre", "volume"), "ml": ("millilitre", "volume"),
    "milliliter": ("millilitre", "volume"), "millilitre": ("millilitre", "volume"), "gal": ("gallon", "volume"),
    "gallon": ("gallon", "volume"), "gallons": ("gallon", "volume"), "qt": ("liquid_quart", "volume"),
    "quart": ("liquid_quart", "volume"), "liquid quart": ("liquid_quart", "volume"), "liq qt": ("liquid_quart", "volume"),
    "m3": ("cubic_metre", "volume"), "kg": ("kilogram", "mass"), "kilogram": ("kilogram", "mass"), "g": ("gram", "mass"),
    "gram": ("gram", "mass"), "lb": ("pound", "mass"), "lbs": ("pound", "mass"), "pound": ("pound", "mass"),
    "m": ("metre", "length"), "meter": ("metre", "length"), "metre": ("metre", "length"), "cm": ("centimetre", "length"),
    "mm": ("millimetre", "length"), "box": ("box", "package"), "pack": ("pack", "package"), "set": ("set", "package"),
    "roll": ("roll", "package"),
}
UOM_NONE = ["", "*", "-", "--", "n/a", "na", "n.a.", "none", "null", "nil"]
UOM_PENALTY = {
    "SAME_UOM": 0.0, "CONVERTIBLE_SAME_DIMENSION": 3.0, "DIFFERENT_DIMENSION_OR_BASIS": 20.0, "MISSING_OR_WILDCARD": 8.0,
    "MALFORMED_OR_UNKNOWN": 12.0,
}

# Weights of the technical token score, of the retrieval channels, and the rank constant of the fusion.
TECHNICAL_WEIGHTS = {"numbers": 40, "measurements": 25, "dimensions": 15, "units": 10, "modifiers": 10}
CHANNEL_WEIGHTS = {"EXACT_DESCRIPTION": 2.4, "PART_NUMBER_FAMILY": 2.2, "TECHNICAL_IDENTITY": 1.8, "LEXICAL": 1.0, "CHAR_VECTOR": 0.9}
RANK_CONSTANT = 60

# Canonical fields, and the header names that stand for them.
FIELDS = [
    "CONTRACT", "PART_NO", "DESCRIPTION", "TYPE_CODE", "UNIT_MEAS", "PRIME_COMMODITY", "SECOND_COMMODITY", "HAZARD_CODE",
    "ACCOUNTING_GROUP", "PART_PRODUCT_CODE", "PART_PRODUCT_FAMILY", "PRODUCT_CATEGORY_ID", "HSN_SAC_CODE", "DEFAULT_UOM",
    "BUYER_ID", "TECH_COORDINATOR", "PURCHASE_GROUP", "ORDER_PROC_TYPE", "SALES_PART_DESCRIPTION", "SALES_UOM", "PRICE_UOM",
    "SALES_PRICE_GROUP", "SALES_GROUP", "INVENTORY_PART_NO", "INVENTORY_PART_FLAG", "SALES_PART_TYPE",
]
HEADER_ALIASES = {
    "PART": "PART_NO", "STOCK_REF": "PART_NO", "PART_NUMBER": "PART_NO", "ITEM_NO": "PART_NO", "ITEM_NUMBER": "PART_NO",
    "ITEM_NARRATIVE": "DESCRIPTION", "PART_DESCRIPTION": "DESCRIPTION", "ITEM_DESCRIPTION": "DESCRIPTION", "SITE": "CONTRACT",
    "SITE_CODE": "CONTRACT", "CONTRACT_CODE": "CONTRACT", "PART_TYPE": "TYPE_CODE", "PURCHASE_TYPE": "TYPE_CODE",
    "INVENTORY_UOM": "UNIT_MEAS", "INVENTORY_UNIT_OF_MEASURE": "UNIT_MEAS", "UNIT_OF_MEASURE": "UNIT_MEAS", "UOM": "UNIT_MEAS",
    "COMMODITY_GROUP_1": "PRIME_COMMODITY", "COM_GROUP_01": "PRIME_COMMODITY", "PRIMARY_COMMODITY": "PRIME_COMMODITY",
    "COMMODITY_GROUP_2": "SECOND_COMMODITY", "COM_GROUP_02": "SECOND_COMMODITY", "SECONDARY_COMMODITY": "SECOND_COMMODITY",
    "SAFETY_CODE": "HAZARD_CODE", "PRODUCT_CODE": "PART_PRODUCT_CODE", "PRODUCT_FAMILY": "PART_PRODUCT_FAMILY",
    "PRODUCT_CATEGORY": "PRODUCT_CATEGORY_ID", "HSN_CODE": "HSN_SAC_CODE", "SAC_CODE": "HSN_SAC_CODE",
    "DEFAULT_UNIT_OF_MEASURE": "DEFAULT_UOM", "PURCHASE_UOM": "DEFAULT_UOM", "DEFAULT_PURCH_UOM": "DEFAULT_UOM", "BUYER": "BUYER_ID",
    "BUYER_CODE": "BUYER_ID", "TECHNICAL_COORDINATOR": "TECH_COORDINATOR", "ORDER_PROCUREMENT_TYPE": "ORDER_PROC_TYPE",
    "ORDER_PROCESSING_TYPE": "ORDER_PROC_TYPE", "PROC_TYPE": "ORDER_PROC_TYPE", "SALES_DESCRIPTION": "SALES_PART_DESCRIPTION",
    "SALES_PART_DESC": "SALES_PART_DESCRIPTION", "INVENTORY_PART": "INVENTORY_PART_FLAG", "TYPE_OF_SALES_PART": "SALES_PART_TYPE",
    "TYPES_OF_SALES_PART": "SALES_PART_TYPE", "CATALOG_TYPE": "SALES_PART_TYPE",
}
FALLBACK_ALIASES = {"PART_DESCRIPTION_IN_USE": "DESCRIPTION", "DESCRIPTION_IN_USE": "DESCRIPTION"}
# Headers of sales tables, markers of inventories and strict fields.
SALES_KEYS = ["SALES_PART_NO", "SALES_PART_NUMBER"]
SALES_ALIASES = {
    "SALES_PART_NO": "PART_NO", "SALES_PART_NUMBER": "PART_NO", "PART_NO": "INVENTORY_PART_NO", "PART_NUMBER": "INVENTORY_PART_NO",
    "PART": "INVENTORY_PART_NO",
}
INVENTORY_MARKERS = {"PURCHASE": ("INVENTORY_PART_FLAG", ["yes"]), "SALES": ("SALES_PART_TYPE", ["inventorypart"])}
STRICT_FIELDS = ["DEFAULT_UOM", "SALES_UOM", "PRICE_UOM"]
