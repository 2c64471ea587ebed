"""Parameters of the operators, as small frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

# The field names of the published registry file, in file order.
REGISTRY_FILE_FIELDS = [
    ("OBJECTID", "long"),
    ("AED_ID", "string"),
    ("OPERATING_HOURS", "string"),
    ("HOUSE_NUMBER", "string"),
    ("ROAD_NAME", "string"),
    ("BUILDING_NAME", "string"),
    ("UNIT_NUMBER", "string"),
    ("POSTAL_CODE", "string"),
    ("AED_LOCATION_DESCRIPTION", "string"),
    ("AED_LOCATION_FLOOR_LEVEL", "string"),
    ("LATITUDE", "double"),
    ("LONGITUDE", "double"),
    ("XVAL", "double"),
    ("YVAL", "double"),
    ("INC_CRC", "string"),
    ("FMEL_UPD_D", "string"),
]

# Penalty weights of the rule score.
RULE_WEIGHTS = {
    "flag_invalid_coords": 0.35,
    "flag_missing_address": 0.25,
    "flag_duplicate_coords": 0.20,
    "flag_fuzzy_duplicate": 0.15,
    "flag_malformed_hours": 0.15,
}

# The text a missing floor or description turns into in "literal" mode.
MISSING_TEXT = "nan"


@dataclass(frozen=True)
class Fields:
    """Column names of a registry table. ``pos`` is the record order, unique per row."""

    pos: str = "pos"
    id: str = "record_id"
    building: str = "building_name"
    road: str = "road_name"
    postal: str = "postal_code"
    hours: str = "operating_hours"
    lat: str = "latitude"
    lon: str = "longitude"
    floor: str = "floor_level"
    descr: str = "location_description"

    @classmethod
    def registry_file(cls) -> "Fields":
        return cls(
            pos="pos",
            id="AED_ID",
            building="BUILDING_NAME",
            road="ROAD_NAME",
            postal="POSTAL_CODE",
            hours="OPERATING_HOURS",
            lat="LATITUDE",
            lon="LONGITUDE",
            floor="AED_LOCATION_FLOOR_LEVEL",
            descr="AED_LOCATION_DESCRIPTION",
        )


@dataclass(frozen=True)
class BoundingBox:
    lat_min: float = 1.1
    lat_max: float = 1.5
    lon_min: float = 103.5
    lon_max: float = 104.2


@dataclass(frozen=True)
class MatchSpec:
    """Near-duplicate matching.

    ``null_units="literal"`` treats a missing floor or description as the text ``nan``;
    ``"unknown"`` treats it as absent. The other values only steer the physical plan and
    never change the result: ``task_pairs`` is how many pairs of a key one task may compare,
    ``first_slice``/``growth`` the slices taken of each block, ``fold_edges`` how many remaining
    edges of a block may be closed in one pass, ``hot_rows`` the size from which a key of the
    joins back to the records is scattered.
    """

    address_threshold: int = 90
    descr_threshold: int = 85
    null_units: str = "literal"
    hot_rows: int = 500_000
    task_pairs: int = 1 << 20
    first_slice: int = 1 << 8
    growth: int = 8
    fold_edges: int = 20_000


@dataclass(frozen=True)
class ScoreSpec:
    weights: dict = field(default_factory=lambda: dict(RULE_WEIGHTS))
    agreement: float = 0.9
    rule_share: float = 0.7
    model_share: float = 0.3


@dataclass(frozen=True)
class ForestSpec:
    trees: int = 100
    sample: int = 256
    contamination: float = 0.03
    seed: int = 42
