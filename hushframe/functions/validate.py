"""Validation of inputs as columns of (valid, error); the first fault that holds is told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions import fixed_values as V

EXTENSIONS = [*V.DOCUMENT_EXTENSIONS, *V.IMAGE_EXTENSIONS]


def _verdict(*faults: tuple[Column, Column | str]) -> Column:
    error = F.lit(None).cast("string")
    for bad, message in reversed(faults):
        error = F.when(bad, message if isinstance(message, Column) else F.lit(message)).otherwise(error)
    return F.struct(error.isNull().alias("valid"), error.alias("error"))


def extension(name: Column) -> Column:
    """What follows the last dot of the last part, lower-cased; a leading dot alone starts none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))


def _not_allowed(name: Column) -> tuple[Column, Column]:
    ext = extension(name)
    return ~ext.isin(EXTENSIONS), F.concat(F.lit("File extension '"), ext, F.lit(f"' is not allowed. Allowed: {', '.join(EXTENSIONS)}"))


def file_path(path: Column) -> Column:
    forbidden = F.lit(False)
    for p in V.FORBIDDEN_PATHS:
        forbidden = forbidden | F.startswith(F.lower(path), F.lit(p.lower()))
    blank = path.isNull() | (path == "")
    return _verdict((blank, "File path is required"), (path.rlike(r"(^|/)\.\.(/|\z)"), "Path traversal detected"), (~path.startswith("/"), "Path must be absolute"), _not_allowed(path), (forbidden, "Access to system directories is not allowed"))


def dropped_path(path: Column, bases: list[str]) -> Column:
    """As :func:`file_path`, and below one of ``bases``."""
    inside = F.lit(False)
    for b in bases:
        inside = inside | path.startswith(b)
    first = file_path(path)
    return F.when(first["valid"] & ~inside, F.struct(F.lit(False).alias("valid"), F.lit("File must be in a user-accessible directory").alias("error"))).otherwise(first)


def file_name(name: Column) -> Column:
    return _verdict((name.isNull() | (name == ""), "File name is required"), (name.rlike(r"\.\.|[/\\]"), "Invalid file name"), _not_allowed(name))


def base64_size(data: Column) -> Column:
    size = F.ceil(F.length(data) * F.lit(0.75))
    told = F.concat(F.lit("File size ("), F.round(size / 1048576).cast("int").cast("string"), F.lit("MB) exceeds maximum allowed (50MB)"))
    return _verdict((data.isNull() | (data == ""), "Buffer data is required"), (size > V.MAX_FILE_BYTES, told))


def text_input(text: Column) -> Column:
    return _verdict((text.isNull(), "Text must be a string"), (F.length(text) > V.MAX_TEXT, "Text length exceeds maximum allowed (10MB)"))


def profile_id(value: Column) -> Column:
    return _verdict((value.isNull() | (value == ""), "Profile ID is required"), (~value.rlike(r"^[a-zA-Z0-9-]+\z"), "Profile ID contains invalid characters"), (F.length(value) > 100, "Profile ID is too long"))


def threshold(value: Column) -> Column:
    return _verdict((value.isNull() | F.isnan(value.cast("double")), "Threshold must be a number"), (~value.between(0, 100), "Threshold must be between 0 and 100"))


def name_list(names: Column) -> Column:
    """At most 1000 names of at most 200 characters."""
    return _verdict((F.size(names) > 1000, "Too many names"), (F.exists(names, lambda n: F.length(n) > 200), "Name is too long"))


def ocr_language(value: Column) -> Column:
    return value.rlike(r"^[a-z]{3}\z")


def safe_file_name(name: Column) -> Column:
    return F.when(name.isNull() | (name == ""), "document").otherwise(F.substring(F.regexp_replace(name, r'[/\\:*?"<>|\x00]', "_"), 1, 255))
