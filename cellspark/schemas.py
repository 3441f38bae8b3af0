"""Fixed vocabularies and explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Category names in label order, 0 to 62.
CATEGORIES = (
    "zoo", "wind_farm", "water_treatment_facility", "waste_disposal", "tunnel_opening", "tower", "toll_booth", "swimming_pool",
    "surface_mine", "storage_tank", "stadium", "space_facility", "solar_farm", "smokestack", "single-unit_residential", "shopping_mall",
    "shipyard", "runway", "road_bridge", "recreational_facility", "railway_bridge", "race_track", "prison", "port", "police_station",
    "place_of_worship", "parking_lot_or_garage", "park", "oil_or_gas_facility", "office_building", "nuclear_powerplant",
    "multi-unit_residential", "military_facility", "lighthouse", "lake_or_pond", "interchange", "impoverished_settlement", "hospital",
    "helipad", "ground_transportation_station", "golf_course", "gas_station", "fountain", "flooded_road", "fire_station",
    "factory_or_powerplant", "electric_substation", "educational_institution", "debris_or_rubble", "dam", "crop_field",
    "construction_site", "car_dealership", "burial_site", "border_checkpoint", "barn", "archaeological_site", "aquaculture",
    "amusement_park", "airport_terminal", "airport_hangar", "airport", "false_detection",
)

#: Prefixes of raw paths, longest match not needed as they don't nest.
PREFIXES = ("Hosted-Datasets/fmow/fmow-rgb/", "Hosted-Datasets/fmow/fmow-rgb-prepped/")

#: Class names of the land-use split files, in label order.
FINE_LABELS = (
    "Oil palm plantation", "Timber plantation", "Other large-scale plantations", "Grassland shrubland", "Small-scale agriculture",
    "Small-scale mixed plantation", "Small-scale oil palm plantation", "Mining", "Fish pond", "Logging", "Secondary forest", "Other",
)
MERGED_LABELS = ("Plantation", "Grassland shrubland", "Smallholder agriculture", "Other")

#: Scene themes and the categories that show them.
THEMES = {
    "Water/Harbour": ("port", "shipyard", "lake_or_pond", "aquaculture", "water_treatment_facility"),
    "Airport/Runway": ("airport", "runway", "airport_terminal", "airport_hangar"),
    "Dense Urban": ("office_building", "multi-unit_residential", "parking_lot_or_garage", "shopping_mall", "interchange", "ground_transportation_station"),
    "Dense Forest": ("park", "golf_course"),
    "Farmland/Agriculture": ("crop_field", "barn", "aquaculture"),
    "Desert/Barren": ("surface_mine", "debris_or_rubble", "waste_disposal"),
}

ANNOTATION = "img_width INT, img_height INT, bounding_boxes ARRAY<STRUCT<category: STRING, box: ARRAY<DOUBLE>, raw_location: STRING>>"
CELL = "STRUCT<image_path: STRING, img_path: STRING, json_path: STRING, cell_row: INT, cell_col: INT, cell_x0: DOUBLE, cell_y0: DOUBLE, cell_x1: DOUBLE, cell_y1: DOUBLE, x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE, coords: STRING, dominant_label: INT, n_patches: INT, target_index: INT>"


def category_table(spark: SparkSession) -> DataFrame:
    """``category, label``: 63 rows."""
    return spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category STRING, label INT")
