"""Library specifications: the built-in ones and custom ones from JSON."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

SPEC = "name string, five_prime_like boolean, CB_tag string, CB_length int, CB_re string, UR_tag string, UR_length int, sample_group string, probe_based boolean, has_bins boolean, random_hex_re string, random_hex_value string"
FIELDS = [x.split()[0] for x in SPEC.split(", ")][1:]

# Patterns of barcodes and the built-in libraries.
SEQUENCE = r"^[ACGT]+-\d+$"
SQUARE = r"^s_\d{3}um_\d{5}_\d{5}-\d+$"
WELLS = r"^\d{1,3}_\d{1,3}_\d{1,3}$"
PRIMER = r"^[^_]+_[^_]+_[^_]+__([RT])__"
BUILT_IN = {
    "10X_3p_v2": (False, "CB", 0, SEQUENCE, "UR", 10, "scrna", False, False, "", ""),
    "10X_3p_v3": (False, "CB", 0, SEQUENCE, "UR", 12, "scrna", False, False, "", ""),
    "10X_3p_v31": (False, "CB", 0, SEQUENCE, "UR", 12, "scrna", False, False, "", ""),
    "10X_3p_v4": (False, "CB", 0, SEQUENCE, "UR", 12, "scrna", False, False, "", ""),
    "10X_5p_v2": (True, "CB", 0, SEQUENCE, "UR", 10, "scrna", False, False, "", ""),
    "10X_5p_v3": (True, "CB", 0, SEQUENCE, "UR", 12, "scrna", False, False, "", ""),
    "10X_flex_v1": (True, "CB", 0, SEQUENCE, "UR", 12, "scrna", True, False, "", ""),
    "10X_visium": (True, "CB", 0, SEQUENCE, "UR", 12, "visium", True, True, "", ""),
    "10X_visium_hd": (True, "CB", 0, SQUARE, "UR", 9, "visium_hd", True, True, "", ""),
    "10X_visium_3p": (False, "CB", 0, SEQUENCE, "UR", 12, "visium", False, True, "", ""),
    "10X_visium_hd_3p": (False, "CB", 0, SQUARE, "UR", 9, "visium_hd", False, True, "", ""),
    "Parse_WT_v3": (False, "CB", 0, WELLS, "pN", 10, "scrna", False, False, PRIMER, "R"),
}


class LibraryError(ValueError):
    """A specification that can't be used."""


def checked(name: str, spec: dict) -> tuple:
    """The specification as a row, or LibraryError with what is wrong."""
    if missing := [f for f in FIELDS if f not in spec]:
        raise LibraryError(f"{name}: missing {', '.join(missing)}")
    kinds = dict(x.split() for x in SPEC.split(", "))
    for field in FIELDS:
        want = {"boolean": bool, "int": int, "string": str}[kinds[field]]
        if not isinstance(spec[field], want) or (want is int and isinstance(spec[field], bool)):
            raise LibraryError(f"{name}: {field} must be of type {want.__name__}")
    for field in ("CB_re", "random_hex_re"):
        try:
            re.compile(spec[field])
        except re.error as error:
            raise LibraryError(f"{name}: {field} is no pattern: {error}") from error
    if not 0 < spec["UR_length"] <= 16 or spec["CB_length"] < 0:
        raise LibraryError(f"{name}: lengths are out of range")
    return tuple(spec[f] for f in FIELDS)


def custom(path: str, override: bool = False) -> dict[str, tuple]:
    """Built-in libraries and those of a JSON file, which replace built-in ones only with `override`."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    if not override and (taken := sorted(given.keys() & BUILT_IN.keys())):
        raise LibraryError(f"already defined: {', '.join(taken)}")
    return BUILT_IN | {name: checked(name, spec) for name, spec in given.items()}


def catalogue(spark: SparkSession, libraries: dict[str, tuple] | None = None) -> DataFrame:
    return spark.createDataFrame([(name, *spec) for name, spec in (libraries or BUILT_IN).items()], SPEC)
