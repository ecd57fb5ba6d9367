"""Profiles as a table: named sets of what is looked for; three are there from the start and stay."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import fixed_values as V

SCHEMA = "id string, name string, enabled_categories array<string>, masking_style string, confidence_threshold double, detect_names boolean, detect_organizations boolean, company_name string, aliases array<string>, custom_keywords array<string>, custom_mask_template string"
BUILT_IN = [p[0] for p in V.PROFILES]
#: Names of profiles for types of the detectors, where the two differ.
TYPE_OF = {"ip_address": "ip", "date_of_birth": "dob", "driver_license": "drivers_license", "aws_key": "api_key", "person_name": "person", "currency": "financial", "coordinates": "gps", "bank_account": "iban"}


def seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, c.split(), s, t, a, o, None, [], [], None) for i, n, c, s, t, a, o in V.PROFILES], SCHEMA)


def create(profiles: DataFrame, name: str, **config) -> tuple[DataFrame, str]:
    """``profiles`` with a new one, and its id, which passes :func:`hushframe.functions.validate.profile_id`."""
    new = f"custom-{time.time_ns() // 1_000_000}"
    return save(profiles, new, name, **config), new


def save(profiles: DataFrame, id: str, name: str, **config) -> DataFrame:
    """The profile of this id put in or put in its place."""
    row = {"id": id, "name": name, "enabled_categories": [], "masking_style": "brackets", "confidence_threshold": 0.7, "detect_names": True, "detect_organizations": True, "company_name": None, "aliases": [], "custom_keywords": [], "custom_mask_template": None} | config
    fields = [x.split()[0] for x in SCHEMA.split(", ")]
    return profiles.where(F.col("id") != id).unionByName(profiles.sparkSession.createDataFrame([tuple(row[f] for f in fields)], SCHEMA))


def delete(profiles: DataFrame, id: str) -> DataFrame:
    """Without the profile; those of the start stay."""
    return profiles if id in BUILT_IN else profiles.where(F.col("id") != id)


def active(profiles: DataFrame, id: str) -> DataFrame:
    """The profile of this id, else the default one."""
    return profiles.where(F.col("id").isin(id, "default")).orderBy(F.col("id") == "default").limit(1)


def apply(detections: DataFrame, profile: dict, kind: str = "type") -> DataFrame:
    """Detections of the profile's types with enough confidence (0 to 100 against its fraction)."""
    types = [TYPE_OF.get(c, c) for c in profile["enabled_categories"]]
    return detections.where(F.col(kind).isin(types) & (F.col("confidence") >= 100 * profile["confidence_threshold"]))
