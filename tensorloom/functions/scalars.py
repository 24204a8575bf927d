"""Scalar functions on tensors' metadata, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dtypes of a safetensors header and the bytes of one element.
WIDTHS = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U64": 8, "U32": 4, "U16": 2, "U8": 1, "BOOL": 1}

#: The units of a size, those of two letters in steps of 1000, those with an i in steps of 1024.
UNITS = {"GiB": 1024**3, "MiB": 1024**2, "KiB": 1024, "GB": 1000**3, "MB": 1000**2, "KB": 1000, "B": 1, "": 1}


def _lookup(key: Column, values: dict[str, int]) -> Column:
    out = None
    for name, value in values.items():
        out = F.when(key == name, F.lit(value).cast("long")) if out is None else out.when(key == name, F.lit(value).cast("long"))
    return out


def dtype_width(dtype: Column) -> Column:
    """Bytes of one element; null for a dtype that is not known."""
    return _lookup(dtype, WIDTHS)


def element_count(shape: Column) -> Column:
    """The product of the dimensions: 1 for a scalar, 0 if any is 0; an error if it doesn't fit 64 bits."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda acc, dim: acc * dim)


def byte_length(shape: Column, dtype: Column) -> Column:
    return element_count(shape) * dtype_width(dtype)


def parse_size(text: Column) -> Column:
    """Bytes of a size such as 4GiB, 100 KB or 12, as DECIMAL(20, 0); null if it is none, or is 2**64 or more. Units have one spelling."""
    trimmed = F.trim(text)
    number = F.regexp_extract(trimmed, "^([0-9]+) *(GiB|MiB|KiB|GB|MB|KB|B|)$", 1)
    unit = F.regexp_extract(trimmed, "^([0-9]+) *(GiB|MiB|KiB|GB|MB|KB|B|)$", 2)
    size = F.try_multiply(number.try_cast("decimal(20,0)"), _lookup(unit, UNITS).cast("decimal(18,0)"))
    return F.when((number != "") & (size < F.lit("18446744073709551616").cast("decimal(20,0)")), size.cast("decimal(20,0)"))


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def is_hex_32(text: Column) -> Column:
    """Whether the text is 32 bytes in strictly lower-case hexadecimal."""
    return F.coalesce(text.rlike("^[0-9a-f]{64}$"), F.lit(False))


def little_endian(data: Column, size: int) -> Column:
    """An unsigned little-endian integer of `size` bytes (8 at most), as DECIMAL(20, 0). Bytes are taken one by one:
    reverse() takes binary for text.
    """
    digits = F.concat(*[F.lpad(F.hex(F.substring(data, k, 1)), 2, "0") for k in range(size, 0, -1)])
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def little_endian_bytes(value: Column, size: int) -> Column:
    """The `size` low bytes of a whole number, the lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(value, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)]))


def chunk_bytes(available: Column, ceiling: int = 4 << 20) -> Column:
    """Bytes of one copying step: what is available, one at least and the ceiling at most."""
    return F.least(F.greatest(available, F.lit(1).cast("long")), F.lit(ceiling).cast("long"))


def natural_field(json_text: Column, name: str) -> Column:
    """A whole, not negative number of a JSON object; anything else counts as missing."""
    found = F.get_json_object(json_text, f"$.{name}")
    return F.when(found.rlike("^[0-9]+$"), found.try_cast("long"))


def architecture_label(config: Column) -> Column:
    """What a config says of its architecture: the model type, else the first of the architectures, else 'unknown'."""
    return F.coalesce(F.get_json_object(config, "$.model_type"), F.get_json_object(config, "$.architectures[0]"), F.lit("unknown"))


def repeats_keys(json_text: Column) -> Column:
    """Whether the outermost object of a JSON text has a key twice."""
    keys = F.json_object_keys(json_text)
    return F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
