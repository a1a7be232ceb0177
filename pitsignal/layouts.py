"""Column layouts, labels and allow-lists of the telemetry data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column order of the delimited files, which carry no usable header.
SENSOR_COLUMNS = [
    "ShiftDate", "Shift", "TimeStamp", "RecordDuration", "Equipment",
    "TruckFleet", "FuelLevel", "FuelLevelLiters", "FuelGauge", "Speed",
    "RPM", "Ralenti", "Latitude", "Longitude", "Elevation",
]
TIME_MODEL_COLUMNS = [
    "ShiftDate", "Shift", "TimeStamp", "RecordDuration", "Equipment",
    "TruckFleet", "Status", "Category", "Event",
]
CYCLE_COLUMNS = [
    "ShiftDate", "Shift", "Shovel", "ShovelModel", "Equipment", "TruckFleet",
    "LoadingZone", "Material", "MeasuredTonnage", "ReportedTonnage",
    "DestinationType", "Destination", "TravelingEmpty", "E_TravelingStart",
    "E_TravelingEnd", "WaitingEmpty", "E_WaitingStart", "E_WaitingEnd",
    "SpottingEmpty", "E_SpottingStart", "E_SpottingEnd", "LoadingMaterial",
    "E_LoadingStart", "E_LoadingEnd", "Hauling", "L_HaulingStart",
    "L_HaulingEnd", "WaitingLoad", "L_WaitingStart", "L_WaitingEnd",
    "SpottingLoad", "L_SpottingStart", "L_SpottingEnd", "UnloadingMaterial",
    "L_UnloadingStart", "L_UnloadingEnd", "DistanceEmpty", "DistanceLoaded",
    "G_Latitude", "G_Longitude", "G_Elevation", "D_Latitude", "D_Longitude",
    "D_Elevation",
]
# The older layout, which the training files have.
CYCLE_OLD_COLUMNS = [
    "travel_empty_seconds", "haul_loaded_seconds", "waiting_loader_seconds",
    "spotting_time_seconds", "loading_time_seconds", "waiting_dump_seconds",
    "reversing_seconds", "tipping_time_seconds", "total_travel_time_seconds",
    "operational_time_seconds", "total_cycle_time_seconds", "loaded_distance_m",
    "empty_distance_m", "equivalent_distance_m", "measured_tonnage",
    "reported_tonnage", "loading_easting", "loading_northing",
    "loading_elevation_cm", "loading_slope_percent", "dump_easting",
    "dump_northing", "dump_elevation_cm", "dump_slope_percent",
    "loading_timestamp", "dumping_timestamp", "ShiftDate", "shift_type",
    "truck_name", "truck_model", "fleet_name", "loading_face", "material_type",
    "dump_type", "dump_location", "TimeStamp",
]

# File formats, dataset folders, statuses, vehicle models, labels.
EXTENSIONS = {
    "tabular": [".csv", ".tsv", ".parquet", ".feather", ".xls", ".xlsx"],
    "hierarchical": [".json", ".yaml", ".xml"],
    "binary_columnar": [".parquet", ".feather", ".orc"],
}
DATASETS = ["test_data", "val_data", "train_data"]
WORKING_STATUSES = ["active", "idle"]
VEHICLE_MODELS = ["CAT - 789C", "CAT - 793D"]
MONTHS_ES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]
SPEED_BANDS = ["Muy Baja", "Baja", "Media", "Alta", "Muy Alta"]
# The time zone of the site and the fleet's number ranges.
SITE_ZONE = "America/Santiago"
FLEET_NUMBER_RANGES = [(210, 225), (230, 243)]

# Columns kept after cleaning, and columns each dataset must have.
KEPT_COLUMNS = {
    "sensor": [
        "ShiftYear", "ShiftMonth", "ShiftDay", "Hour",
        "Speed", "RPM", "FuelLevel", "FuelLevelLiters",
    ],
    "time_model": [
        "ShiftYear", "ShiftMonth", "ShiftDay", "Hour",
        "Status", "Category", "Event",
    ],
    "cycle": [],
}
REQUIRED_COLUMNS = {
    "sensor": ["ShiftDate", "TimeStamp", "Speed", "RPM", "FuelLevel"],
    "time_model": ["ShiftDate", "TimeStamp", "Status"],
    "cycle": [],
}

LAYOUTS = {
    "sensor": SENSOR_COLUMNS,
    "time_model": TIME_MODEL_COLUMNS,
    "cycle": CYCLE_COLUMNS,
}
TRAINING_LAYOUTS = {**LAYOUTS, "cycle": CYCLE_OLD_COLUMNS}

_TEXT_COLUMNS = {
    "Shift", "Equipment", "TruckFleet", "Status", "Category", "Event", "Shovel",
    "ShovelModel", "LoadingZone", "Material", "DestinationType", "Destination",
    "shift_type", "truck_name", "truck_model", "fleet_name", "loading_face",
    "material_type", "dump_type", "dump_location",
}


def is_time_column(name: str) -> bool:
    return name in ("ShiftDate", "TimeStamp") or name.endswith(
        ("Start", "End", "_timestamp")
    )


def text_schema(columns: list[str]) -> T.StructType:
    """Every column as text, the form in which delimited files are read."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def typed_schema(columns: list[str]) -> T.StructType:
    """The types the cleaned columns have."""

    def type_of(name: str) -> T.DataType:
        if is_time_column(name):
            return T.TimestampNTZType()
        return T.StringType() if name in _TEXT_COLUMNS else T.DoubleType()

    return T.StructType([T.StructField(c, type_of(c)) for c in columns])
